import random

import pytest
from pyspark.sql import types as T

#: Columns beside the contract's, named like the operators' own.
EXTRA = ["id", "uid", "key", "text_key", "size", "slot", "shard", "bucket", "lead", "n_words", "component", "class", "flags", "row", "kept", "ids", "_hit_spans", "spans"]


def odd_documents():
    """Rows with every odd case: null and repeated ids, null, empty, long and repeated texts."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdeghioénst") for _ in range(rng.randint(1, 9)))
    line = lambda n: " ".join(word() for _ in range(n)).capitalize() + "."
    base = ["\n".join(line(rng.randint(6, 14)) for _ in range(rng.randint(5, 12))) for _ in range(8)]
    rows = []
    for i in range(60):
        text = base[rng.randrange(8)]
        if i % 3 == 0:
            text += "\n" + line(9)
        elif i % 3 == 1:
            words = text.split(" ")
            words[rng.randrange(len(words))] = word()
            text = " ".join(words)
        if i % 7 == 0:
            text += "\n  The Shared LINE of many documents \t\n" + "x" * 130
        rows.append((i * 2 + 1, text))
    rows += [(200, None), (201, ""), (202, " \t\n"), (203, "one"), (204, "two words"), (205, "\n\n\n"), (206, "éÉ ÀB ſ K"), (207, base[0])]
    rows += [(None, base[1]), (None, line(70)), (7, base[2]), (7, base[2]), (9, "another text of an id that stands twice " * 9)]
    rows += [(300, " ".join(line(12) for _ in range(1500))), (301, "q" * 40_000), (302, "ab " * 20_000), (-5, base[3])]
    return rows


def frame(spark, rows, key="doc_id", text="text", more=EXTRA):
    schema = T.StructType([T.StructField(key, T.LongType()), *(T.StructField(c, T.StringType()) for c in more), T.StructField(text, T.StringType())])
    return spark.createDataFrame([(d, *("other" for _ in more), t) for d, t in rows], schema).repartition(3)


@pytest.fixture(scope="session")
def odd():
    return odd_documents()


@pytest.fixture(scope="session")
def odd_docs(spark, odd):
    docs = frame(spark, odd)
    docs.count()
    return docs


@pytest.fixture(scope="session")
def no_docs(spark):
    return frame(spark, [])


@pytest.fixture(scope="session")
def documents(spark, sf):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
