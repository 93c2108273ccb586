"""Wide one-hot encoding against a plain version, with nulls, ties and empty columns."""

from tillwise.operators.encoders import level_table, one_hot_sparse
from tillwise.session import Stages


def test_sparse_places(spark):
    rows = [(i, f"n{i % 37:02}" if i % 5 else None, ["b", "a", None][i % 3], None, "same") for i in range(200)]
    df = spark.createDataFrame(rows, "id long, x string, y string, none string, one string").repartition(6)
    columns = ["x", "y", "none", "one"]
    with Stages(spark) as stages:
        place, n = {}, 0
        for c in range(4):
            for level in sorted({r[c + 1] for r in rows if r[c + 1] is not None})[1:]:
                place[c, level] = n
                n += 1
        got = {(r["column"], r["level"]): r["index"] for r in level_table(df, columns, stages).collect()}
        assert got == place
        found = {r["id"]: r["indices"] for r in one_hot_sparse(df, columns, stages).collect()}
        assert found == {r[0]: [place[c, r[c + 1]] for c in range(4) if (c, r[c + 1]) in place] for r in rows}
        assert one_hot_sparse(df.where("id < 0"), columns, stages).count() == 0
