import pytest
from pyspark.sql import functions as F

from tabulens.operators import cleaning, correlation, facts, outliers, profile, stats, tools


def test_infinity_counts_as_missing_in_either_plan(spark, monkeypatch):
    rows = [(1.0, 2.0), (2.0, 4.0), (float("inf"), 6.0), (4.0, 9.0), (5.0, float("nan"))]
    df = spark.createDataFrame(rows, "a double, b double")
    small = correlation.correlation_pairs(df, ["a", "b"]).first()
    monkeypatch.setattr(correlation, "EXPRESSION_COLUMNS", 1)
    blocks = correlation.correlation_pairs(df, ["a", "b"]).first()
    assert small["sample_size"] == blocks["sample_size"] == 3
    assert small["correlation"] == pytest.approx(blocks["correlation"]) and small["correlation"] < 1


def test_big_keys_survive_fill_and_cap(spark):
    big = 2 ** 53 + 1
    df = spark.createDataFrame([(big + 2 * i,) for i in range(25)] + [(None,)], "k long")
    filled = cleaning.fill_numbers(df, "zero")
    assert filled.schema["k"].dataType.simpleString() == "bigint"
    assert {r["k"] for r in filled.collect()} == {big + 2 * i for i in range(25)} | {0}
    capped = cleaning.cap_extremes(df, {"k": (float(2 ** 53), 1e300)})
    assert {r["k"] for r in capped.collect()} == {big + 2 * i for i in range(25)} | {None}
    halves = cleaning.fill_numbers(spark.createDataFrame([(1,), (2,), (None,)], "k long"), "median")
    assert sorted(float(r["k"]) for r in halves.collect()) == [1.0, 1.5, 2.0]


def test_rows_that_differ_in_a_map_are_no_duplicates(spark):
    df = spark.sql("SELECT 1 AS a, map('x', 1, 'y', 2) AS m UNION ALL SELECT 1, map('y', 2, 'x', 1)"
                   " UNION ALL SELECT 1, map('x', 3)")
    assert profile.duplicate_rows(df).first()["duplicate_rows"] == 1
    assert cleaning.drop_duplicates(df).count() == 2 and cleaning.drop_duplicates(df).columns == ["a", "m"]


def test_zero_spread_is_not_capped(spark):
    df = spark.createDataFrame([(0.0,)] * 12 + [(float(i),) for i in range(1, 9)], "v double")
    assert outliers.outlier_summary(df, ["v"], "modified_zscore").first()["outlier_count"] == 0
    capped = outliers.remediate(df, "cap", ["v"], "modified_zscore")
    assert sorted(r["v"] for r in capped.collect()) == sorted(r["v"] for r in df.collect())


def test_tables_without_numbers(spark):
    df = spark.createDataFrame([("a", "b")], "x string, y string")
    assert outliers.outlier_summary(df, []).columns == outliers.outlier_summary(
        spark.createDataFrame([(1.0,)], "v double"), ["v"]).columns[:0] + outliers.outlier_summary(df, []).columns
    assert outliers.outlier_summary(df, []).count() == 0
    records = outliers.outlier_records(df, [], id_cols=["x"])
    assert records.columns[0] == "x" and "classification" in records.columns and records.count() == 0
    assert stats.observations(df, [], [], []).count() == 1


def test_recommendations_are_rules_with_arguments(spark):
    issues = spark.createDataFrame([("c", "fill_mode", 3)], "column_name string, action string, affected_rows long")
    pairs = spark.createDataFrame([("a", "b", 0.9, 0.9), ("a", "c", -0.2, 0.2)],
                                  "variable_a string, variable_b string, correlation double, absolute_correlation double")
    totals = spark.createDataFrame([(4,)], "total_outlier_instances long")
    got = {tuple(r) for r in facts.recommendations(issues, pairs, totals).collect()}
    assert got == {("cleaning", "fill_mode", "c", None, 3.0), ("features", "combine", "a", "b", 0.9),
                   ("features", "decorrelate", "a", "b", 0.9), ("modeling", "robust_loss", None, None, 4.0)}
    assert facts.recommendations(issues.limit(0), pairs.limit(0), totals.where(F.lit(False))).count() == 0


def test_names_are_resolved_by_rank():
    columns = ["Order_ID", "Sales_Amount", "Region"]
    assert tools.resolve_name(columns, "Region") == "Region"
    assert tools.resolve_name(columns, "sales amount") == "Sales_Amount"
    assert tools.resolve_name(columns, "amount") == "Sales_Amount"
    assert tools.resolve_name(columns, "???") is None and tools.resolve_name([], "x") is None


def test_no_slice_or_bin_gathers_a_clustered_column(spark):
    """A dense cluster with one far value on either side stays spread over tasks and bins."""
    from tabulens.plans import quantiles
    base = 1_700_000_000_000_000
    df = spark.range(20_000).select(F.timestamp_micros(F.lit(base) + F.col("id") * 60_000_000).alias("ts")) \
        .union(spark.sql("SELECT timestamp'0001-01-02 00:00:00' UNION ALL SELECT timestamp'9999-01-01 00:00:00'"))
    found = stats.datetime_cadence(df, ["ts"]).first()
    assert found["median_gap_seconds"] == 60.0
    values = spark.range(50_000).select((F.lit(1.7e9) + F.col("id")).alias("v")).union(spark.sql("SELECT 1e300D"))
    got = quantiles.column_quantiles(values, ["v"], {"m": 0.5}).first()["m"]
    small = quantiles.quantile_frame(quantiles.long_numbers(values, ["v"]), ["column_name"], "value", {"m": 0.5}, few_rows=100)
    assert got == small.first()["m"] == 1.7e9 + 25_000
