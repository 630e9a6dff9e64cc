"""Facts of all families in one long table ``(section, category, subject, metric, value_num, value_text)``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tabulens.functions.coerce import normalize
from tabulens.operators import chartdata, correlation, outliers, profile, quality, stats
from tabulens.operators.types import ROLES, role_map, storage_type
from tabulens.plans.storage import materialize

OBSERVED, ISSUE, READING, ADVICE = "Observed", "Potential issue", "Interpretation", "Recommendation"
SCHEMA = "section string, category string, subject string, metric string, value_num double, value_text string"


def facts_of(frame: DataFrame, section: str, category: str, subject: Column, numbers: list[str] = (),
             texts: list[str] = ()) -> DataFrame:
    """Turn the columns of a small frame into fact rows."""
    null_n, null_t = F.lit(None).cast("double"), F.lit(None).cast("string")
    rows = [F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value_num"), null_t.alias("value_text"))
            for c in numbers]
    rows += [F.struct(F.lit(c).alias("metric"), null_n.alias("value_num"), F.col(c).cast("string").alias("value_text"))
             for c in texts]
    return frame.select(F.lit(section).alias("section"), F.lit(category).alias("category"),
                        subject.cast("string").alias("subject"), F.inline(F.array(*rows)))


def category_distributions(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Distinct values and the five most frequent ones of the categorical columns."""
    if columns is None:
        roles = role_map(df)
        columns = roles["categorical"] + roles["boolean"]
    return profile.category_profile(df, columns, 5)


def time_horizons(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """First and last day, span and row count of date columns."""
    columns = role_map(df)["datetime"] if columns is None else columns
    return stats.datetime_spans(df, columns).select(
        "column_name", F.date_format("min_date", "yyyy-MM-dd").alias("start_date"),
        F.date_format("max_date", "yyyy-MM-dd").alias("end_date"), F.col("date_range_days").alias("total_days_span"),
        F.col("valid_count").alias("records_count"))


def recommendations(issues: DataFrame, pairs: DataFrame, totals: DataFrame, strong: float = 0.85) -> DataFrame:
    """What the findings call for: ``(area, rule, column_a, column_b, value)``.

    ``rule`` is the action of each issue, ``combine`` for the strongest pair, ``decorrelate`` for every
    pair of at least ``strong``, and ``robust_loss`` with the number of outliers where there are any."""
    row = lambda area, rule, a, b, value: [F.lit(area).alias("area"), rule.alias("rule"), a.cast("string").alias("column_a"),
                                           b.cast("string").alias("column_b"), value.cast("double").alias("value")]
    none = F.lit(None)
    parts = [issues.select(*row("cleaning", F.col("action"), F.col("column_name"), none, F.col("affected_rows")))]
    linked = [F.col("variable_a"), F.col("variable_b"), F.col("correlation")]
    top = pairs.orderBy(F.desc("absolute_correlation"), "variable_a", "variable_b").limit(1)
    parts.append(top.select(*row("features", F.lit("combine"), *linked)))
    parts.append(pairs.where(F.col("absolute_correlation") >= strong).select(*row("features", F.lit("decorrelate"), *linked)))
    parts.append(totals.where("total_outlier_instances > 0")
                 .select(*row("modeling", F.lit("robust_loss"), none, none, F.col("total_outlier_instances"))))
    return reduce(DataFrame.unionByName, parts)


def report_facts(df: DataFrame, charts: int | None = None) -> DataFrame:
    """The nine report sections as one long table.

    Results that several sections read (a few rows per column) are stored once and read back, so
    no family is computed twice and the final plan is a union of small tables."""
    df = normalize(df)
    if df.columns and all(storage_type(f.dataType) != "other" for f in df.schema):
        # some thirty passes follow, each over few columns
        df = materialize(df)
    profiled = materialize(profile.column_profile(df))
    columns = profiled.orderBy("position").collect()
    roles = {r: [c["column_name"] for c in columns if c["role"] == r] for r in ROLES}
    numbers, groups, dates = roles["numerical"], roles["categorical"] + roles["boolean"], roles["datetime"]
    kind = {c["column_name"]: c["semantic_type"] for c in columns}
    numeric = [c for c in df.columns if kind.get(c) == "Numerical"]
    temporal = [c for c in df.columns if kind.get(c) == "Datetime"]
    categorical = [c for c in kind if c not in numeric + temporal]
    name, whole = F.col("column_name"), F.lit("dataset")
    issues = materialize(quality.audit(df))
    pairs = materialize(correlation.correlation_pairs(df, numbers))
    totals = materialize(outliers.outlier_totals(df, numbers))
    metrics = materialize(profile.dataset_metrics(df))
    summary = materialize(stats.numeric_summary(df, numeric)) if numeric else None
    checks = metrics.withColumn("empty_columns", F.lit(sum(c["non_null_count"] == 0 for c in columns))) \
        .withColumn("constant_columns", F.lit(sum(c["is_constant"] for c in columns))) \
        .withColumn("skewed_columns", F.lit(0) if summary is None
                    else summary.agg(F.count_if(F.abs("skewness") > 3.0)).scalar())
    parts = [
        facts_of(metrics, "1 overview", OBSERVED, whole,
                 ["total_rows", "total_columns", "missing_cells", "missing_cells_percentage", "duplicate_rows",
                  "duplicate_rows_percentage"]),
        facts_of(profiled, "1 overview", OBSERVED, name, ["missing_percentage", "unique_count"],
                 ["dtype", "semantic_type"]),
        facts_of(profile.score_metrics(checks), "2 quality", OBSERVED, whole,
                 ["health_score", "completeness_score", "uniqueness_score"], ["health_grade", "quality_status"]),
        facts_of(issues.withColumn("subject", F.concat_ws(":", "column_name", "issue_type")), "2 quality", ISSUE,
                 F.col("subject"), ["affected_rows", "percentage_affected"], ["severity"]),
        facts_of(quality.cleaning_preview(df).groupBy("column_name", "category").agg(F.count(F.lit(1)).alias("examples")),
                 "3 cleaning", OBSERVED, name, ["examples"], ["category"]),
        facts_of(pairs.withColumn("pair", F.concat_ws(" / ", "variable_a", "variable_b")), "5 correlation", OBSERVED,
                 F.col("pair"), ["correlation", "sample_size"], ["strength"]),
        facts_of(totals, "6 outliers", OBSERVED, whole,
                 ["total_outlier_instances", "total_confirmed_errors", "affected_rows_count"]),
    ]
    if summary is not None:
        parts.append(facts_of(summary, "4 statistics", OBSERVED, name,
                              ["mean", "median", "std", "skewness", "kurtosis", "ci_lower", "ci_upper"], ["shape"]))
    if numbers:
        parts.append(facts_of(outliers.critical_columns(df, numbers), "6 outliers", ISSUE, name,
                              ["outlier_count", "outlier_percentage"]))
    if groups:
        parts.append(facts_of(category_distributions(df, groups).withColumn(
            "subject", F.concat_ws("=", "column_name", "category")), "4 statistics", OBSERVED, F.col("subject"),
            ["count", "percentage"]))
    if dates:
        parts.append(facts_of(time_horizons(df, dates), "4 statistics", OBSERVED, name, ["total_days_span"],
                              ["start_date", "end_date"]))
    parts += [
        facts_of(chartdata.chart_ranking(df, roles, charts).withColumn("subject", F.array_join("columns_used", ", ")),
                 "7 charts", OBSERVED, F.col("subject"), ["score"], ["chart_type", "priority"]),
        facts_of(stats.observations(df, numeric, categorical, temporal, summary), "8 insights", READING,
                 F.concat_ws(":", "column_name", "rule"), ["value", "other"], ["severity", "item"]),
        facts_of(recommendations(issues, pairs, totals).withColumn("subject", F.concat_ws(":", "area", "column_a", "column_b")),
                 "9 recommendations", ADVICE, F.col("subject"), ["value"], ["rule"]),
    ]
    return reduce(DataFrame.unionByName, parts)
