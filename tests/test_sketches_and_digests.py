from functools import reduce

import pytest
from pyspark.sql import DataFrame, functions as F

from tabulens.operators import chartdata, cleaning, quality, stats, tools, types
from tabulens.plans import digests, sketches


def test_planted_equal_digests_do_not_make_rows_equal(spark):
    rows = [("a", None), ("b", 1), (None, "a"), ("a", None), ("long " * 500, 2), ("b", 1), ("c", 3)]
    df = spark.createDataFrame([(x, None if y is None else str(y)) for x, y in rows], "x string, y string")
    same = lambda keys: [F.lit(1).cast("long"), F.lit(2).cast("long")]
    few = lambda keys: [F.length(F.coalesce(keys[0], F.lit(""))).cast("long")]
    for digest in (digests.row_digest, same, few):
        for broadcast_rows in (0, 10):
            got = digests.duplicate_counts(df, digest, broadcast_rows, narrow_bytes=0).first()
            assert tuple(got) == (7, 2)


def test_null_places_and_odd_types_in_row_digests(spark):
    df = spark.createDataFrame([(None, "a", [1, None], {"k": 1}), ("a", None, [1, None], {"k": 1}), ("a", None, [None, 1], {"k": 1}),
                                ("a", None, [1, None], {"k": 1})], "x string, y string, z array<int>, m map<string,int>")
    for narrow_bytes in (0, 1 << 20):
        assert tuple(digests.duplicate_counts(df, narrow_bytes=narrow_bytes).first()) == (4, 1)
    assert tuple(digests.duplicate_counts(df.limit(0)).first()) == (0, 0)


def test_exact_distinct_of_every_type(spark):
    df = spark.createDataFrame([(1, 0.0, "a", [1, None], True), (2, -0.0, "b" * 1000, [None, 1], False), (2, float("nan"), None, None, None),
                                (1, 5.0, "a", [1, None], True)], "i long, d double, s string, arr array<int>, flag boolean")
    got = {r["column_name"]: r["n_distinct"] for r in digests.exact_distinct(df).collect()}
    assert got == {"i": 2, "d": 2, "s": 2, "arr": 2, "flag": 2}


def test_sketches_of_parts_merge_to_the_whole(spark):
    df = spark.range(200_000).select((F.col("id") % 50_000).alias("wide"), (F.col("id") % 7).alias("few"),
                                     F.when(F.col("id") < 0, "x").alias("none"))
    parts = [sketches.distinct_sketches(df.where(F.col("wide") % 3 == k)) for k in range(3)]
    got = {r["column_name"]: r for r in sketches.distinct_bounds(
        sketches.merge_sketches(reduce(DataFrame.unionByName, parts))).collect()}
    assert got["wide"]["at_least"] <= 50_000 <= got["wide"]["at_most"] <= 60_000
    assert got["few"]["at_least"] <= 7 <= got["few"]["at_most"] <= 9
    assert (got["none"]["n_valid"], got["none"]["at_most"]) == (0, 0)


def test_frequent_values_have_exact_counts(spark):
    df = spark.range(100_000).select(
        F.when(F.col("id") % 3 == 0, "hot " * 300).otherwise(F.col("id").cast("string")).alias("t"),
        F.when(F.col("id") % 10 == 0, 2 ** 53 + 1).otherwise(F.col("id") + 2 ** 53 + 5).alias("k"))
    got = {(r["column_name"], r["value"]): r["n"] for r in sketches.frequent_values(df, ["t", "k"], 0.05).collect()}
    assert got == {("t", "hot " * 300): 33_334, ("k", str(2 ** 53 + 1)): 10_000}
    assert sketches.frequent_values(df.limit(0), ["t", "k"]).count() == 0
    with pytest.raises(ValueError):
        sketches.frequent_values(df, ["t"], 1e-6)


def test_modes_settled_by_sketch_and_by_count_agree(spark):
    df = spark.range(30_000).select((F.col("id") % 30_000).alias("once"), (F.col("id") % 11).cast("double").alias("tie"),
                                    F.when(F.col("id") % 2 == 0, -3).otherwise(F.col("id")).cast("decimal(20,2)").alias("dec"),
                                    F.concat(F.lit("$"), F.col("id") % 4).alias("txt"))
    got = {r["column_name"]: (r["distinct_count"], r["mode_value"]) for r in stats.numeric_modes(df, df.columns).collect()}
    assert got == {"once": (30_000, None), "tie": (11, 0.0), "dec": (15_001, -3.0), "txt": (4, 0.0)}


def test_classes_at_the_thresholds_are_exact(spark):
    rows = spark.range(1000)
    for distinct, want in ((50, "Categorical"), (51, "Categorical"), (300, "Categorical"), (301, "Other")):
        df = rows.select(F.concat(F.lit("w"), F.col("id") % distinct).alias("word"))
        assert types.class_map(df) == {"word": want}
    for distinct, want in ((500, "categorical"), (501, "identifier")):
        df = rows.select(F.concat(F.lit("w"), F.col("id") % distinct).alias("word"))
        assert types.role_map(df)["categorical" if want == "categorical" else "identifier"] == ["word"]


def test_keys_that_are_one_double_are_not_constant(spark):
    df = spark.range(100).select((F.col("id") % 2 + 2 ** 53).alias("k"))
    assert not stats.moment_summary(df, ["k"]).first()["is_constant"]
    assert quality.column_issues(df, [quality.constant_rules, quality.near_constant_rules]).count() == 0


@pytest.mark.parametrize("broadcast_bytes", [0, 1 << 20])
def test_split_join_of_a_category_map(spark, broadcast_bytes):
    half = F.when(F.col("id") % 2 == 0, "Common")
    df = spark.range(4000).select(
        half.when(F.col("id") % 8 == 1, "COMMON").when(F.col("id") % 8 == 3, None)
        .otherwise(F.concat(F.lit("val"), F.col("id") % 40)).alias("c"),
        F.when(F.col("id") % 5 == 0, "yes").otherwise("Yes").alias("from"), F.col("id").alias("key"))
    got, changed = cleaning.standardize_categories(df, broadcast_bytes)
    assert changed == {"c": 500, "from": 800} and got.columns == df.columns
    rows = {r["key"]: r for r in got.collect()}
    assert len(rows) == 4000 and {r["from"] for r in rows.values()} == {"Yes"}
    for i, r in rows.items():
        assert r["c"] == ("Common" if i % 2 == 0 or i % 8 == 1 else None if i % 8 == 3 else f"val{i % 40}")


def test_levels_are_kept_in_range_and_columns_are_checked(spark, numbers):
    df = numbers([1, 2, 4, 8, 9])
    width = lambda level: stats.moment_summary(df, ["v"], level).first()["margin_of_error"]
    assert width(2.0) == width(0.999) > width(0.95) > width(0.5) == width(-1.0)
    for call in (lambda: chartdata.custom_chart(df, "bar", "v", "nowhere"), lambda: tools.group_rank(df, "nowhere")):
        with pytest.raises(ValueError, match="nowhere"):
            call()


def test_stratified_sample_does_not_shuffle_the_table(spark, tmp_path):
    spark.range(200_000).selectExpr("id", "id % 3 AS kind").write.parquet(str(tmp_path / "t"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", 50_000)
    try:
        from tabulens.plans import sampling
        sample = sampling.stratified_sample(spark.read.parquet(str(tmp_path / "t")), "kind", ["id"], 100)
        plan = sample._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
        assert {r["kind"]: r["count"] for r in sample.groupBy("kind").count().collect()} == {0: 100, 1: 100, 2: 100}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
