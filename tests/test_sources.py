"""Readers, writers, report tables, model catalogue."""

import datetime

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from tillwise.operators import insights, quality
from tillwise.session import materialize, shared_folder
from tillwise.sources import model_store, readers, reports, writers


def test_csv_landing_round_trip(spark, tmp_path):
    src, dst = str(tmp_path / "in"), str(tmp_path / "out")
    df = spark.createDataFrame([(1, 2.5, "a"), (2, None, "b")], "customer_id long, price double, city string")
    df.write.option("header", True).csv(src)
    landed = writers.land_csv(spark, src, dst, df.schema)
    assert sorted(map(tuple, landed.collect())) == sorted(map(tuple, df.collect()))
    inferred = readers.read_csv(spark, src)
    assert [f.dataType.simpleString() for f in inferred.schema.fields] == ["int", "double", "string"]


def test_raw_schema():
    schema = readers.raw_schema(["customer_id", "transaction_date", "gender", "age"], ["gender"])
    assert [f.dataType.simpleString() for f in schema.fields] == ["bigint", "timestamp_ntz", "string", "double"]


def test_missing_input_raises(spark):
    with pytest.raises(AnalysisException):
        readers.read_table(spark, "/nowhere/at/all")


def test_fallback_takes_the_first_readable(spark, sf):
    df = readers.first_readable(spark, ["/nowhere/a", f"{sf}/nation.parquet"])
    assert df.count() == 25
    with pytest.raises(FileNotFoundError):
        readers.first_readable(spark, ["/nowhere/a", "/nowhere/b"])


def test_freshness_has_an_injectable_date(spark, sf):
    nation = readers.read_table(spark, f"{sf}/nation.parquet")
    row = readers.freshness(nation).first()
    later = F.lit(row["last_modified"].date() + datetime.timedelta(days=31))
    aged = readers.freshness(nation, later).first()
    assert (aged["age_days"], aged["stale"]) == (31, True)
    fresh = readers.freshness(nation, F.lit(row["last_modified"].date() + datetime.timedelta(days=30))).first()
    assert fresh["stale"] is False


def test_segment_export(spark, tmp_path):
    rows = [(1.0, 0.2), (5.0, 0.2)]
    df = materialize(spark.createDataFrame(rows, "total_sales double, churn_probability double"), "test")
    for kind in ("csv", "JSON"):
        path = str(tmp_path / kind)
        writers.export_segments(df, path, kind)
        back = readers.read_csv(spark, path) if kind == "csv" else spark.read.json(path)
        assert back.count() == 5 and {"export_date", "total_customers", "all_revenue"} <= set(back.columns)
    with pytest.raises(ValueError):
        writers.export_segments(df, str(tmp_path / "x"), "xml")


def test_report_scan_skips_corrupt_files(spark, tmp_path):
    path = str(tmp_path / "reports")
    df = spark.createDataFrame([(-1.0, 30)], "total_sales double, age int")
    for name in ("one", "two"):
        reports.append_report(quality.quality_report(spark, name, quality.findings(df)), path)
    (tmp_path / "reports" / "part-broken.json").write_text('{"file": "half", "passed": tru')
    got = reports.read_reports(spark, path).collect()
    assert {r["file"] for r in got} == {"one", "two"}
    assert all(r["passed"] is False and r["errors"] == 1 for r in got)
    assert got[0]["issues"][0]["subject"] == "total_sales"
    counts = reports.report_counts(reports.read_reports(spark, path)).first()
    assert (counts["reports"], counts["failed"], counts["latest"]) == (2, 2, "two")
    assert reports.read_reports(spark, path, newest=1).count() == 1


def test_evaluation_report_round_trip(spark, tmp_path):
    path = str(tmp_path / "evaluation")
    clf = spark.createDataFrame(
        [("a", 0.9, 0.5, 0.5, 0.5, (1, 2, 3, 4), "OK"), ("b", 0.8, 0.6, 0.6, 0.6, (1, 2, 3, 4), "OK"),
         ("c", None, None, None, None, None, "load failed")],
        "model string, accuracy double, precision double, recall double, f1_score double, "
        "confusion_matrix struct<TN: long, FP: long, FN: long, TP: long>, status string",
    )
    reg = spark.createDataFrame([("r", 1.0, 1.0, 0.5, 2.0, "OK")], "model string, rmse double, mae double, r2 double, mape double, status string")
    report = reports.evaluation_report(clf, reg)
    reports.append_report(report, path)
    row = report.first()
    assert row["classification"]["best_model"] == "b" and row["classification"]["models_failed"] == 1
    assert row["total_models_evaluated"] == 3
    back_clf, back_reg = reports.latest_metrics(spark, path)
    assert back_clf.count() == 3 and back_reg.first()["r2"] == 0.5
    assert back_clf.where("model = 'a'").first()["confusion_matrix"]["TP"] == 4


def test_metric_log_appends_per_run(spark, tmp_path):
    path = str(tmp_path / "metrics")
    df = spark.createDataFrame([("Random Forest (scratch)", 0.5)], "model string, f1_score double")
    reports.log_metrics(df, ["f1_score"], path, "r1")
    reports.log_metrics(df, ["f1_score"], path, "r2")
    rows = spark.read.parquet(path).collect()
    assert {r["run"] for r in rows} == {"r1", "r2"}
    assert {r["name"] for r in rows} == {"random_forest_scratch_f1_score"}


def test_newest_rows(spark):
    df = spark.createDataFrame([("p", i, f"f{i}") for i in range(9)], "kind string, modified int, path string")
    assert {r["path"] for r in reports.keep_newest(df, "modified").collect()} == {f"f{i}" for i in range(4, 9)}
    assert reports.newest_object(df).first()["path"] == "f8"


def test_catalogue(spark):
    names = [
        "svm_classification_latest.pkl", "linear_regression.pkl", "sklearn_random_forest_latest.pkl",
        "sklearn_xgboost", "sklearn_other", "pca",
    ]
    rows = model_store.catalogue(spark.createDataFrame([(n,) for n in names], "name string")).collect()
    got = {}
    for r in rows:
        got.setdefault(r["task"], []).append(r["model"])
    assert got["classification"] == ["pca", "sklearn_other", "sklearn_random_forest", "svm_classification"]
    assert got["regression"] == ["linear_regression", "pca", "sklearn_other", "sklearn_xgboost"]


def test_shared_folder_follows_the_setting(spark):
    wanted = spark.conf.get("spark.checkpoint.dir", None)
    if wanted:
        assert shared_folder(spark) == wanted
    table = materialize(spark.range(3), "test")
    assert table.inputFiles()[0].replace("file://", "").startswith(shared_folder(spark).replace("file:", ""))


def test_drift_baseline_is_written_once(spark, tmp_path):
    path = str(tmp_path / "baseline")
    first = spark.createDataFrame([(1.0,), (3.0,)], "x double")
    assert quality.drift_against(first, ["x"], path).where("drifted").count() == 0
    second = spark.createDataFrame([(10.0,), (30.0,)], "x double")
    assert quality.drift_against(second, ["x"], path).where("drifted").count() == 2


def test_export_of_empty_segment_rows(spark):
    df = materialize(spark.createDataFrame([(1.0, 0.9)], "total_sales double, churn_probability double"), "test")
    rows = {r["segment"]: r["count"] for r in insights.customer_segments(df).collect()}
    assert rows["At Risk"] == 1 and rows["Champions"] == 0
