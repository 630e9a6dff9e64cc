"""Descriptive and inferential statistics per column."""

from __future__ import annotations

from decimal import Decimal
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tabulens.functions import formulas
from tabulens.functions.coerce import (as_double, as_timestamp, double_sql, is_numeric, normalize, percent, span_text,
                                       text_literal)
from tabulens.operators.types import class_map
from tabulens.plans.digests import exact_distinct
from tabulens.plans.frequency import mode_of, number_counts, own_number_sql, top_values, value_counts
from tabulens.plans.quantiles import column_quantiles, quantile_frame
from tabulens.plans.sketches import exact_modes
from tabulens.plans.storage import materialize

# Lowest and highest confidence level.
LEVELS = 0.5, 0.999
PERCENTILES = [1, 5, 10, 25, 50, 75, 90, 95, 99]


def _percentile_names() -> dict[str, float]:
    return {f"p{p}": p / 100 for p in PERCENTILES}


# aggregates of one numeric column: {0} are its values as doubles, {1} in their own type
MEASURES = {"valid_count": "count({0})", "mean": "avg({0})", "min": "min({0})", "max": "max({0})", "sum": "sum({0})",
            "std": "stddev_samp({0})", "g1": "skewness({0})", "g2": "kurtosis({0})",
            "zeros_count": "count_if({0} = 0)", "is_constant": "coalesce(min({1}) = max({1}), false)"}

# labels in order; the first that fits wins
SHAPES = [("is_empty", "Undefined (Empty Data)"), ("is_constant", "Constant (Zero Variance)"),
          ("valid_count < 5", "Insufficient Sample Size"),
          ("skewness > 1.5D", "Highly Skewed Right (Positive Tail)"),
          ("skewness < -1.5D", "Highly Skewed Left (Negative Tail)"),
          ("skewness > 0.5D", "Moderately Skewed Right"), ("skewness < -0.5D", "Moderately Skewed Left"),
          ("kurtosis > 2D", "Leptokurtic (Heavy Tails & Sharp Peak)"),
          ("kurtosis < -1D", "Platykurtic (Light Tails & Flat Peak)"),
          ("is_normal", "Approximately Normal (Gaussian)")]


def per_column(df: DataFrame, columns: list[str], measures: dict[str, str]) -> DataFrame:
    """One row per column with the given aggregates, all from one scan."""
    wide = df.selectExpr(*[e for i, c in enumerate(columns)
                           for e in (f"{double_sql(df, c)} AS c{i}", f"{own_number_sql(df, c)} AS o{i}")]).selectExpr(
        "count(1) AS total_count", *[f"{sql.format(f'c{i}', f'o{i}')} AS c{i}_{m}"
                                     for i in range(len(columns)) for m, sql in measures.items()])
    rows = ", ".join("named_struct('column_name', {}, 'total_count', total_count, {})".format(
        text_literal(c), ", ".join(f"'{m}', c{i}_{m}" for m in measures)) for i, c in enumerate(columns))
    return wide.selectExpr(f"inline(array({rows}))")


def moments(df: DataFrame, columns: list[str]) -> DataFrame:
    """Count, mean, extremes, spread and biased shape moments of every column."""
    return per_column(df, columns, MEASURES)


def moment_summary(df: DataFrame, columns: list[str], level: float = 0.95) -> DataFrame:
    """Everything that needs no order statistics: dispersion, shape, interval, normality.

    Infinite values leave no spread (NULL) and count as unskewed.  The level of the interval is kept within
    ``LEVELS``."""
    level = min(max(level, LEVELS[0]), LEVELS[1])
    n = "valid_count"
    flat = "CASE WHEN is_constant THEN 0D ELSE {} END"
    skew, kurt = formulas.adjusted_skewness(n, "g1"), formulas.adjusted_kurtosis(n, "g2")
    share = "coalesce(round(try_divide(double({}), double({})) * 100, 2), 0D) AS {}".format
    shape = " ".join(f"WHEN {when} THEN '{label}'" for when, label in SHAPES)
    staged = moments(df, columns).withColumnsRenamed({"std": "_std"}).selectExpr(
        "*", f"{n} = 0 AS is_empty", f"total_count - {n} AS missing_count",
        share("missing_count", "total_count", "missing_percentage"), "max - min AS range",
        flat.format("nullif(_std, double('NaN'))") + " AS std", "std * std AS variance",
        f"try_divide(std, sqrt({n})) AS sem",
        "CASE WHEN is_constant THEN 0D ELSE round(try_divide(std, abs(mean)) * 100, 2) END AS cv_percentage",
        f"{flat.format(f'nanvl({skew}, 0D)')} AS skewness", f"{flat.format(f'nanvl({kurt}, 0D)')} AS kurtosis",
        share("zeros_count", n, "zeros_percentage"),
        f"CASE WHEN {n} >= 2 THEN {flat.format(f'({formulas.t_quantile((1 + level) / 2, f"({n} - 1)")}) * sem')} END"
        " AS margin_of_error",
        "mean - margin_of_error AS ci_lower", "mean + margin_of_error AS ci_upper",
        *formulas.omnibus_k2(n, "g1", "g2", "_k2"), "CASE WHEN NOT is_constant THEN _k2 END AS k2",
        "exp(-k2 / 2) AS normal_p", "normal_p > 0.05D AS is_normal",
        f"CASE {shape} ELSE 'Symmetric / Non-Gaussian' END AS shape")
    return staged.select(*[c for c in staged.columns if not c.startswith("_") and c not in ("g1", "g2")])


def percentiles(df: DataFrame, columns: list[str]) -> DataFrame:
    """Nine exact percentiles per column, linear interpolation."""
    return column_quantiles(normalize(df), columns, _percentile_names())


def approximate_percentiles(df: DataFrame, columns: list[str], accuracy: int = 10_000) -> DataFrame:
    """The same percentiles from a sketch in one scan; rank error below ``1 / accuracy``."""
    shares = ", ".join(f"{p / 100}D" for p in PERCENTILES)
    found = per_column(normalize(df), columns, {"q": f"percentile_approx({{0}}, array({shares}), {accuracy})"})
    return found.selectExpr("column_name", *[f"q[{k}] AS p{p}" for k, p in enumerate(PERCENTILES)])


def numeric_modes(df: DataFrame, columns: list[str]) -> DataFrame:
    """``(column_name, distinct_count, mode_value, mode_text)``: the smallest most frequent value, NULL when none repeats.

    Values are told apart in their own type; ``mode_text`` has all digits of whole numbers beyond 2^53.  A frequent
    value is found by a sketch and counted in a second scan; only columns without one have all values counted."""
    df = normalize(df)
    spark = df.sparkSession
    typed = [c for c in columns if is_numeric(df.schema[c].dataType)]
    settled = {c: min((v for v, _ in values), key=Decimal) for c, values in exact_modes(df, typed).items()
               if values[0][1] > 1} if typed else {}
    easy = spark.createDataFrame([(c, float(v), v) for c, v in settled.items()],
                                 "column_name string, mode_value double, mode_text string")
    parts = [exact_distinct(df, list(settled)).join(easy, "column_name").selectExpr(
        "column_name", "n_distinct AS distinct_count", "mode_value", "mode_text")] if settled else []
    for counts in number_counts(df, [c for c in columns if c not in settled]):
        parts.append(counts.groupBy("column_name").agg(
            F.count(F.lit(1)).alias("distinct_count"), F.max("n").alias("_most"), mode_of().alias("_mode")).selectExpr(
                "column_name", "distinct_count", "CASE WHEN _most > 1 THEN cast(_mode AS double) END AS mode_value",
                "CASE WHEN _most > 1 THEN cast(_mode AS string) END AS mode_text"))
    return reduce(DataFrame.unionByName, parts)


def fences(quantiles: DataFrame, multiplier: float = 1.5) -> DataFrame:
    """Tukey fences from a frame with ``p25`` and ``p75``."""
    iqr = F.col("p75") - F.col("p25")
    return quantiles.withColumn("iqr", iqr) \
        .withColumn("lower_bound", F.col("p25") - F.lit(multiplier) * F.col("iqr")) \
        .withColumn("upper_bound", F.col("p75") + F.lit(multiplier) * F.col("iqr"))


def fence_outliers(df: DataFrame, columns: list[str], multiplier: float = 1.5) -> DataFrame:
    """Values outside the fences per column.  The fences, one pair per column, become literals."""
    df = normalize(df)
    bounds = {r["column_name"]: r for r in fences(column_quantiles(
        df, columns, {"p25": 0.25, "p50": 0.5, "p75": 0.75}), multiplier).collect()}
    present = [c for c in columns if c in bounds]
    if not present:
        return df.sparkSession.createDataFrame(
            [], "column_name string, valid_count long, q1 double, q3 double, iqr double, lower_bound double,"
                " upper_bound double, outlier_count long, outlier_percentage double")
    values = {c: as_double(df, c) for c in present}
    wide = df.agg(*[F.count_if((values[c] < bounds[c]["lower_bound"]) | (values[c] > bounds[c]["upper_bound"]))
                    .alias(f"c{i}") for i, c in enumerate(present)])
    rows = F.array(*[F.struct(
        F.lit(c).alias("column_name"), F.lit(bounds[c]["n_values"]).cast("long").alias("valid_count"),
        F.lit(bounds[c]["p25"]).alias("q1"), F.lit(bounds[c]["p75"]).alias("q3"), F.lit(bounds[c]["iqr"]).alias("iqr"),
        F.lit(bounds[c]["lower_bound"]).alias("lower_bound"), F.lit(bounds[c]["upper_bound"]).alias("upper_bound"),
        F.col(f"c{i}").alias("outlier_count")) for i, c in enumerate(present)])
    return wide.select(F.inline(rows)).withColumn(
        "outlier_percentage", percent(F.col("outlier_count"), F.col("valid_count")))


def numeric_summary(df: DataFrame, columns: list[str], level: float = 0.95) -> DataFrame:
    """The complete numeric table: moments, percentiles, mode, interval, fences, normality, shape."""
    df = normalize(df)
    base = moment_summary(df, columns, level)
    q = percentiles(df, columns).drop("n_values")
    out = fence_outliers(df, columns).select("column_name", "iqr", "lower_bound", "upper_bound",
                                             "outlier_count", "outlier_percentage")
    joined = base.join(q, "column_name", "left").join(numeric_modes(df, columns).drop("mode_text"), "column_name", "left") \
        .join(out, "column_name", "left")
    return joined.withColumn("median", F.col("p50")).withColumn("q1", F.col("p25")).withColumn("q3", F.col("p75")) \
        .withColumn("mode", F.coalesce("mode_value", "p50")).drop("mode_value") \
        .withColumn("outlier_count", F.coalesce("outlier_count", F.lit(0))) \
        .withColumn("outlier_percentage", F.coalesce("outlier_percentage", F.lit(0.0)))


def category_summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """Category count, mode, entropy and rare categories per column."""
    df = normalize(df)
    counts = value_counts(df, columns)
    totals = counts.groupBy("column_name").agg(F.sum("n").alias("valid_count"))
    share = F.col("n") / F.col("valid_count")
    shared = counts.join(F.broadcast(totals), "column_name").withColumn("p", share)
    entropy = -F.sum(F.col("p") * F.log2(F.col("p") + 1e-12))
    found = shared.groupBy("column_name").agg(
        F.max("valid_count").alias("valid_count"), F.count(F.lit(1)).alias("num_categories"),
        mode_of().alias("most_frequent_category"), F.max("n").alias("mode_frequency"),
        entropy.alias("entropy"), F.count_if(F.col("p") < 0.01).alias("rare_categories_count"))
    names = df.sparkSession.createDataFrame([(c,) for c in columns], "column_name string")
    rows = df.agg(F.count(F.lit(1)).alias("total_count"))
    return names.withColumn("total_count", rows.scalar()).join(found, "column_name", "left").select(
        "column_name", "total_count", F.coalesce("valid_count", F.lit(0)).alias("valid_count"),
        (F.col("total_count") - F.coalesce("valid_count", F.lit(0))).alias("missing_count"),
        F.coalesce("num_categories", F.lit(0)).alias("num_categories"), "most_frequent_category",
        F.coalesce("mode_frequency", F.lit(0)).alias("mode_frequency"),
        percent(F.col("mode_frequency"), F.col("valid_count")).alias("mode_percentage"),
        F.when(F.col("num_categories") == 1, 0.0).otherwise(F.col("entropy")).alias("entropy"),
        F.coalesce("rare_categories_count", F.lit(0)).alias("rare_categories_count"))


def top_categories(df: DataFrame, columns: list[str], top_n: int = 10) -> DataFrame:
    """Most frequent values with share and running share of the rounded shares, capped at 100."""
    counts = value_counts(normalize(df), columns)
    totals = counts.groupBy("column_name").agg(F.sum("n").alias("total"))
    order = Window.partitionBy("column_name").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return top_values(counts, top_n).join(F.broadcast(totals), "column_name") \
        .withColumn("percentage", percent(F.col("n"), F.col("total"))) \
        .withColumn("cumulative_percentage",
                    F.least(F.lit(100.0), F.round(F.sum("percentage").over(order), 2))) \
        .select("column_name", "rank", F.col("value").alias("category"), F.col("n").alias("count"),
                "percentage", "cumulative_percentage")


def _long_times(df: DataFrame, columns: list[str]) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), as_timestamp(df, c).alias("ts")) for c in columns])
    return df.select(F.inline(pairs))


def datetime_spans(df: DataFrame, columns: list[str]) -> DataFrame:
    """Counts, first and last moment, whole days between and a readable span per column."""
    spans = _long_times(df, columns).groupBy("column_name").agg(
        F.count(F.lit(1)).alias("total_count"), F.count("ts").alias("valid_count"),
        F.min("ts").alias("min_date"), F.max("ts").alias("max_date"))
    days = F.floor((F.unix_micros("max_date") - F.unix_micros("min_date")) / F.lit(86_400_000_000))
    return spans.withColumn("missing_count", F.col("total_count") - F.col("valid_count")) \
        .withColumn("missing_percentage", percent(F.col("missing_count"), F.col("total_count"))) \
        .withColumn("date_range_days", F.coalesce(days, F.lit(0)).cast("long")) \
        .withColumn("date_range_formatted", span_text(F.col("date_range_days")))


def cadence_label(seconds: Column) -> Column:
    return (F.when(seconds.between(3500, 3700), "Hourly")
            .when(seconds.between(82800, 90000), "Daily")
            .when(seconds.between(580000, 630000), "Weekly")
            .when(seconds.between(2400000, 2700000), "Monthly")
            .when(seconds >= 30000000, "Annual")
            .otherwise("Irregular / Mixed"))


def _gaps(batches):
    """Gaps between neighbouring moments of one sorted range, and the first and last moment of each column in it."""
    edges: dict[int, list[int]] = {}
    for batch in batches:
        column, us = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        for which in np.unique(column).tolist():
            moments = us[column == which]
            if which in edges:
                moments = np.concatenate([[edges[which][1]], moments])
            else:
                edges[which] = [int(moments[0]), 0]
            edges[which][1] = int(moments[-1])
            gap, weight = np.unique(np.diff(moments), return_counts=True)
            yield pa.RecordBatch.from_pydict({
                "column": pa.array([which] * len(gap), pa.int32()), "gap": pa.array(gap, pa.int64()),
                "weight": pa.array(weight, pa.int64()), "first": pa.nulls(len(gap), pa.int64()), "last": pa.nulls(len(gap), pa.int64())})
    if edges:
        first, last = zip(*edges.values())
        yield pa.RecordBatch.from_pydict({
            "column": pa.array(edges, pa.int32()), "gap": pa.nulls(len(edges), pa.int64()), "weight": pa.nulls(len(edges), pa.int64()),
            "first": pa.array(first, pa.int64()), "last": pa.array(last, pa.int64())})


def datetime_cadence(df: DataFrame, columns: list[str]) -> DataFrame:
    """Median gap between consecutive moments and the recording rhythm it suggests.

    Moments are dealt to ranges once and sorted inside them; one pass over each range counts its gaps and keeps its
    first and last moment, from which the gaps between the ranges follow.  The row number is part of
    the range key, so that a moment with a third of all rows is split like any others."""
    spark = df.sparkSession
    cells = F.array(*[F.struct(F.lit(i).alias("column"), F.unix_micros(as_timestamp(df, c)).alias("us")) for i, c in enumerate(columns)])
    times = df.select(F.inline(cells)).where("us IS NOT NULL").withColumn("row", F.monotonically_increasing_id())
    ranges = times.repartitionByRange("column", "us", "row").sortWithinPartitions("column", "us").select("column", "us")
    found = materialize(ranges.mapInArrow(_gaps, "column int, gap long, weight long, first long, last long"))
    before = F.lag("last").over(Window.partitionBy("column").orderBy("first", "last"))
    between = found.where("first IS NOT NULL").select("column", (F.col("first") - before).alias("gap"), F.lit(1).cast("long").alias("weight"))
    gaps = found.where("gap IS NOT NULL").select("column", "gap", "weight").unionByName(between.where("gap IS NOT NULL")) \
        .groupBy("column", "gap").agg(F.sum("weight").alias("weight"))
    median = quantile_frame(gaps, ["column"], "gap", {"median_gap": 0.5}, weight="weight", few_keys=True)
    names = spark.createDataFrame(list(enumerate(columns)), "column int, column_name string")
    seconds = F.col("median_gap") / 1e6
    return names.join(median, "column", "left").select(
        "column_name", F.when(F.col("n_values") >= 2, seconds).alias("median_gap_seconds"),
        F.when(F.col("n_values") >= 2, cadence_label(seconds)).otherwise("Irregular / Mixed").alias("cadence"))


def records_by(df: DataFrame, column: str, part: str) -> DataFrame:
    """Row counts by ``year``, ``month`` or ``weekday`` (Monday first)."""
    ts = as_timestamp(df, column)
    order, label = {"year": (F.year(ts), F.year(ts).cast("string")),
                    "month": (F.month(ts), F.date_format(ts, "MMM")),
                    "weekday": (F.weekday(ts), F.date_format(ts, "EEEE"))}[part]
    return df.where(ts.isNotNull()).groupBy(order.alias("position"), label.alias(part)) \
        .agg(F.count(F.lit(1)).alias("records"))


def split_by_class(df: DataFrame) -> tuple[list[str], list[str], list[str]]:
    """Numeric, categorical and datetime columns by semantic class; other columns follow their type."""
    classes = class_map(df)
    numeric, categorical, temporal = [], [], []
    for f in df.schema:
        kind = classes[f.name]
        if kind == "Numerical" or (kind == "Other" and isinstance(f.dataType, T.NumericType)):
            numeric.append(f.name)
        elif kind == "Datetime":
            temporal.append(f.name)
        elif not isinstance(f.dataType, (T.MapType, T.VariantType)):
            categorical.append(f.name)
    return numeric, categorical, temporal


def _remark(rule: str, when: Column, severity, value: Column, other: Column | None = None, item: Column | None = None) -> Column:
    """One remark as a struct, NULL where its rule does not hold."""
    severity = F.lit(severity) if isinstance(severity, str) else severity
    other, item = (F.lit(None) if x is None else x for x in (other, item))
    return F.when(when, F.struct(F.lit(rule).alias("rule"), severity.alias("severity"), value.cast("double").alias("value"),
                                 other.cast("double").alias("other"), item.cast("string").alias("item")))


REMARKS = "column_name string, rule string, severity string, value double, other double, item string"


def observations(df: DataFrame, numeric: list[str] | None = None, categorical: list[str] | None = None,
                 temporal: list[str] | None = None, summary: DataFrame | None = None) -> DataFrame:
    """Rule-based remarks as ``(column_name, rule, severity, value, other, item)``.

    ``empty``; ``constant`` (the value); ``skewed`` (skewness, median); ``heavy_tails`` (excess kurtosis); ``outliers``
    (count, percentage); ``dispersed`` (coefficient of variation); ``imbalanced`` (percentage, categories, the
    dominant one); ``many_categories`` (their number); ``time_span`` (days, median gap in seconds, cadence).  A table without any
    remark gets one row ``unremarkable``.  Every summary is computed once; ``summary`` is a
    ``numeric_summary`` made before, if there is one."""
    if numeric is None or categorical is None or temporal is None:
        numeric, categorical, temporal = split_by_class(df)
    df = normalize(df)
    c = F.col
    parts = []
    if numeric:
        varied = ~c("is_empty") & ~c("is_constant")
        level = F.when(c("outlier_percentage") > 5.0, "warning").otherwise("info")
        parts.append((numeric_summary(df, numeric) if summary is None else summary, [
            _remark("empty", c("is_empty"), "high", F.lit(None)),
            _remark("constant", c("is_constant"), "medium", c("mean")),
            _remark("skewed", varied & (F.abs("skewness") >= 1.5), "info", c("skewness"), c("median")),
            _remark("heavy_tails", varied & (c("kurtosis") > 3.0), "info", c("kurtosis")),
            _remark("outliers", varied & (c("outlier_count") > 0) & (c("outlier_percentage") >= 2.0), level, c("outlier_count"),
                    c("outlier_percentage")),
            _remark("dispersed", varied & (c("cv_percentage") > 100.0), "info", c("cv_percentage"))]))
    if categorical:
        parts.append((category_summary(df, categorical), [
            _remark("imbalanced", (c("mode_percentage") >= 70.0) & (c("num_categories") > 1), "warning", c("mode_percentage"),
                    c("num_categories"), c("most_frequent_category")),
            _remark("many_categories", c("num_categories") > 50, "info", c("num_categories"))]))
    if temporal:
        parts.append((datetime_spans(df, temporal).join(datetime_cadence(df, temporal), "column_name"), [
            _remark("time_span", c("valid_count") > 0, "info", c("date_range_days"), c("median_gap_seconds"), c("cadence"))]))
    found = reduce(DataFrame.unionByName, [frame.select("column_name", F.inline(F.array_compact(F.array(*remarks))))
                                           for frame, remarks in parts], df.sparkSession.createDataFrame([], REMARKS))
    found = materialize(found)  # a few rows per column
    if found.count():
        return found
    return df.sparkSession.createDataFrame([("", "unremarkable", "info", None, None, None)], REMARKS)
