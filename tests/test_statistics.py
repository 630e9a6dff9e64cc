import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulens.functions import formulas
from tabulens.operators import correlation, stats
from tabulens.plans.quantiles import column_quantiles, group_quantiles, quantile_frame


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0].asDict()


def test_ten_values(numbers):
    s = one(stats.numeric_summary(numbers(range(10, 101, 10)), ["v"]))
    assert (s["mean"], s["median"], s["min"], s["max"], s["range"]) == (55, 55, 10, 100, 90)
    assert (s["q1"], s["q3"], s["iqr"]) == (32.5, 77.5, 45)
    assert abs(s["skewness"]) < 0.01 and s["ci_lower"] < 55 < s["ci_upper"]
    assert s["margin_of_error"] == pytest.approx(2.2621571627982 * s["sem"], rel=1e-9)
    assert s["mode"] == 55 and s["k2"] is None


def test_fence_count(numbers):
    s = one(stats.fence_outliers(numbers([*range(20, 31), 150, -80]), ["v"]))
    assert s["outlier_count"] == 2


def test_constant_and_empty(spark):
    df = spark.createDataFrame([(42.0, None)] * 20, "c double, e double")
    s = {r["column_name"]: r for r in stats.numeric_summary(df, ["c", "e"]).collect()}
    assert s["c"]["is_constant"] and s["c"]["std"] == 0 and s["c"]["skewness"] == 0
    assert s["c"]["shape"] == "Constant (Zero Variance)" and s["c"]["margin_of_error"] == 0
    assert s["e"]["is_empty"] and s["e"]["mean"] is None and s["e"]["outlier_count"] == 0


def test_nan_is_missing_and_infinity_is_not(numbers):
    s = one(stats.numeric_summary(numbers([1, 2, float("nan"), 3]), ["v"]))
    assert s["valid_count"] == 3 and s["mean"] == 2
    s = one(stats.moment_summary(numbers([1, 2, 3, float("inf")]), ["v"]))
    assert s["valid_count"] == 4 and s["std"] is None and s["skewness"] == 0


def test_single_and_two_rows(numbers):
    assert one(stats.numeric_summary(numbers([5]), ["v"]))["std"] == 0
    assert one(stats.numeric_summary(numbers([5, 7]), ["v"]))["median"] == 6


@pytest.mark.parametrize("values, zs, zk", [
    (list(range(1, 9)), 1.0108048609177787, None), ([2, 8, 0, 4, 1, 9, 9, 0], 0.44626385374196975, None),
    ([1, 2, 3, 4, 5, 6, 7, 8000], 3.571773510360407, None), (list(range(20)), None, -1.7058104152122062)])
def test_normality_parts(numbers, values, zs, zk):
    m = numbers(values).agg(F.count("v").alias("n"), F.skewness("v").alias("g1"), F.kurtosis("v").alias("g2"))
    r = one(m.selectExpr("*", *formulas.omnibus_k2("n", "g1", "g2", "k2")))
    if zs:
        assert r["_zs"] == pytest.approx(zs, abs=1e-9)
    if zk:
        assert r["_zk"] == pytest.approx(zk, abs=1e-9)


@pytest.mark.parametrize("v, t", [(1, 12.706204736), (2, 4.302652730), (9, 2.262157163), (30, 2.042272456),
                                  (31, 2.039513446), (120, 1.979930405)])
def test_t_quantile(spark, v, t):
    assert spark.range(1).selectExpr(f"{formulas.t_quantile(0.975, str(v))} AS t").first()[0] == pytest.approx(t, abs=1e-6)


@pytest.mark.parametrize("few_rows", [1, 300, 100_000])
def test_quantiles_match_numpy(spark, few_rows):
    rng = random.Random(7)
    families = {
        "heavy": [rng.lognormvariate(0, 4) * rng.choice([-1, 1]) for _ in range(3000)],
        "narrow": [1.7e9 + rng.random() for _ in range(3000)],
        "hot": [3.0] * 1500 + [rng.gauss(0, 1) for _ in range(1500)],
        "tiny": [rng.random() * 1e-300 for _ in range(500)] + [0.0] * 20,
        "few": [2.0, 1.0]}
    rows = [(k, v) for k, vs in families.items() for v in vs]
    probs = {f"p{i}": i / 20 for i in range(21)}
    df = spark.createDataFrame(rows, "k string, v double")
    found = {r["k"]: r for r in quantile_frame(df, ["k"], "v", probs, few_rows=few_rows).collect()}
    for k, vs in families.items():
        assert found[k]["n_values"] == len(vs)
        for name, p in probs.items():
            assert found[k][name] == pytest.approx(float(np.quantile(vs, p)), rel=1e-12, abs=1e-310), (k, p)


def test_weighted_and_infinite_quantiles(spark):
    df = spark.createDataFrame([("a", 1.0, 5), ("a", 10.0, 1), ("a", 20.0, 1)], "k string, v double, w long")
    assert one(quantile_frame(df, ["k"], "v", {"m": 0.5, "top": 1.0}, weight="w"))["m"] == 1.0
    df = spark.createDataFrame([(x,) for x in (float("-inf"), 1.0, 2.0, float("inf"))], "v double")
    r = one(column_quantiles(df, ["v"], {"low": 0.0, "m": 0.5, "high": 1.0}))
    assert (r["low"], r["m"], r["high"]) == (float("-inf"), 1.5, float("inf"))


def test_group_quantiles_many_groups(spark):
    df = spark.range(6000).selectExpr("id % 1500 AS g", "double(id) AS v")
    got = {r["g"]: r["m"] for r in group_quantiles(df, ["g"], "v", {"m": 0.5}).collect()}
    assert len(got) == 1500 and got[3] == float(np.median([3, 1503, 3003, 4503]))


def test_category_shares(spark):
    rows = [("Electronics",)] * 50 + [("Fashion",)] * 30 + [("Books",)] * 15 + [("Toys",)] * 5
    df = spark.createDataFrame(rows, "c string")
    s = one(stats.category_summary(df, ["c"]))
    assert (s["num_categories"], s["most_frequent_category"], s["mode_percentage"]) == (4, "Electronics", 50.0)
    assert s["entropy"] > 0
    top = stats.top_categories(df, ["c"]).orderBy("rank").collect()
    assert [t["cumulative_percentage"] for t in top] == [50.0, 80.0, 95.0, 100.0]


def test_daily_cadence(spark):
    days = [(dt.datetime(2024, 1, 1) + dt.timedelta(days=i),) for i in range(90)]
    df = spark.createDataFrame(days, "d timestamp")
    assert one(stats.datetime_cadence(df, ["d"]))["cadence"] == "Daily"
    assert one(stats.datetime_spans(df, ["d"]))["date_range_days"] == 89


def test_cadence_against_sorted_gaps(spark):
    rng = random.Random(3)
    seconds = sorted(rng.choice([0, 5, 5, 60, 3600, 90000]) for _ in range(400))
    moments = np.cumsum(seconds)
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1) + dt.timedelta(seconds=int(s)),) for s in moments], "d timestamp")
    assert one(stats.datetime_cadence(df, ["d"]))["median_gap_seconds"] == float(np.median(np.diff(np.sort(moments))))


def test_dirty_money(spark):
    df = spark.createDataFrame([("$10.50",), ("20.00",), ("None",), ("$30.25",), (None,), ("40.0%",)], "m string")
    assert one(stats.numeric_summary(df, ["m"]))["valid_count"] == 4


def test_pairwise_gaps(spark):
    a = [1, 2, 3, 4, 5, None, 7, 8]
    b = [2, 4, None, 8, 10, 12, 14, 16]
    df = spark.createDataFrame([(x and float(x), y and float(y)) for x, y in zip(a, b)], "a double, b double")
    r = one(correlation.correlation_pairs(df, ["a", "b"]))
    assert r["correlation"] == pytest.approx(1.0) and r["sample_size"] == 6


def test_correlation_blocks_equal_expressions(spark):
    rng = np.random.default_rng(5)
    data = rng.normal(size=(400, 6)) * [1, 10, 1e3, 1, 1, 1] + [0, 5, 1e6, 0, 0, 42]
    data[:, 1] += 3 * data[:, 0]
    data[:, 5] = 42
    data[::7, 3] = np.nan
    names = [f"c{i}" for i in range(6)]
    df = correlation.normalize(spark.createDataFrame([tuple(map(float, r)) for r in data], ", ".join(f"{n} double" for n in names)))
    plain = {(r[0], r[1]): r for r in correlation._by_expressions(df, names, 2).collect()}
    blocks = {(r[0], r[1]): r for r in correlation._by_blocks(df, names, 2).collect()}
    assert plain.keys() == blocks.keys()
    for k in plain:
        assert blocks[k]["correlation"] == pytest.approx(plain[k]["correlation"], abs=1e-9)
        assert blocks[k]["sample_size"] == plain[k]["sample_size"]
    assert plain[("c0", "c5")]["correlation"] == 0.0


def test_observations_fall_back(spark):
    df = spark.range(100).selectExpr("double(id % 10) AS v")
    assert [r["rule"] for r in stats.observations(df, ["v"], [], []).collect()] == ["unremarkable"]


def test_only_text_columns_are_classed_for_correlations(spark, monkeypatch):
    from tabulens.operators import correlation
    asked, real = [], correlation.class_map
    monkeypatch.setattr(correlation, "class_map", lambda df: asked.append(df.columns) or real(df))
    df = spark.createDataFrame([(i, float(i), i % 2 == 0, f"${i}.50", f"w{i % 3}") for i in range(40)],
                               "a long, b double, c boolean, d string, e string")
    assert correlation.numeric_features(df) == ["a", "b", "c", "d"] and asked == [["d", "e"]]
    assert correlation.numeric_features(df.select("a", "c")) == ["a", "c"] and len(asked) == 1


def test_report_reads_a_stored_table(spark, monkeypatch):
    from tabulens.operators import facts
    seen, real = [], facts.quality.audit
    monkeypatch.setattr(facts.quality, "audit", lambda df: seen.append(df.inputFiles()) or real(df))
    df = spark.createDataFrame([(i, float(i % 7), f"w{i % 3}") for i in range(40)], "a long, b double, e string")
    assert facts.report_facts(df).count() > 0 and seen[0]
