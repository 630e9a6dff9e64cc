"""Dataset and column profiles, quality score, preview pages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from tabulens.functions.coerce import col, groupable_columns, is_text, normalize, percent, render, to_boolean
from tabulens.operators import stats
from tabulens.operators.types import chart_role, column_features, decided_features, semantic_class
from tabulens.plans.digests import duplicate_counts
from tabulens.plans.frequency import top_values, value_counts
from tabulens.plans.quantiles import column_quantiles

# Lowest score of each grade, and its wording.
GRADES = [(95, "A+", "Excellent Quality"), (85, "A", "High Quality"), (75, "B", "Good Quality"),
          (60, "C", "Moderate Quality"), (45, "D", "Poor Quality")]

TYPE_WIDTH = {"tinyint": 1, "smallint": 2, "int": 4, "bigint": 8, "float": 4, "double": 8, "boolean": 1,
              "date": 4, "timestamp": 8, "timestamp_ntz": 8}


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows equal to an earlier row, NULLs being equal.

    Rows are told by digests, which combine on the map side; the shuffle does not grow with the length of texts."""
    return duplicate_counts(df).withColumn("duplicate_rows_percentage", percent(F.col("duplicate_rows"), F.col("total_rows")))


def _row_bytes(df: DataFrame) -> Column:
    sizes = [F.coalesce(F.octet_length(col(f.name)), F.lit(0)) if is_text(f.dataType)
             else F.lit(TYPE_WIDTH.get(f.dataType.simpleString(), 16)) for f in df.schema]
    return reduce(lambda a, b: a + b, sizes, F.lit(0).cast("long"))


def size_label(size: Column) -> Column:
    kb, mb = F.lit(1024.0), F.lit(1024.0 * 1024.0)
    return (F.when(size < kb, F.concat(size.cast("string"), F.lit(" B")))
            .when(size < mb, F.concat(F.round(size / kb, 2).cast("string"), F.lit(" KB")))
            .otherwise(F.concat(F.round(size / mb, 3).cast("string"), F.lit(" MB"))))


def missing_metrics(df: DataFrame) -> DataFrame:
    """Rows, columns, cells, missing cells, rows with a missing cell and an estimated size, in one scan."""
    df = normalize(df)
    nulls = [col(c).isNull() for c in df.columns]
    cells = reduce(lambda a, b: a + b, [n.cast("long") for n in nulls], F.lit(0).cast("long"))
    anywhere = reduce(lambda a, b: a | b, nulls, F.lit(False))
    found = df.agg(F.count(F.lit(1)).alias("total_rows"), F.coalesce(F.sum(cells), F.lit(0)).alias("missing_cells"),
                   F.count_if(anywhere).alias("rows_with_missing"),
                   F.coalesce(F.sum(_row_bytes(df)), F.lit(0)).alias("estimated_bytes"))
    return found.withColumn("total_columns", F.lit(len(df.columns)).cast("long")) \
        .withColumn("total_cells", F.col("total_rows") * F.col("total_columns")) \
        .withColumn("missing_cells_percentage", percent(F.col("missing_cells"), F.col("total_cells"))) \
        .withColumn("rows_with_missing_percentage", percent(F.col("rows_with_missing"), F.col("total_rows"))) \
        .withColumn("size_label", size_label(F.col("estimated_bytes")))


def dataset_metrics(df: DataFrame) -> DataFrame:
    """The dataset overview: missingness and duplicates in one row."""
    dup = duplicate_rows(df)
    return missing_metrics(df).withColumn("duplicate_rows", dup.select("duplicate_rows").scalar()) \
        .withColumn("duplicate_rows_percentage", percent(F.col("duplicate_rows"), F.col("total_rows")))


def column_profile(df: DataFrame, features: DataFrame | None = None) -> DataFrame:
    """One row per column: counts, shares, distinct and repeated values, class and role."""
    n, rows, distinct = F.col("n_valid"), F.col("n_rows"), F.col("n_distinct")
    repeated = F.greatest(n - distinct, F.lit(0))
    return (column_features(df) if features is None else features).select(
        "position", "column_name", "dtype", semantic_class().alias("semantic_type"), chart_role().alias("role"),
        n.alias("non_null_count"), percent(n, rows).alias("non_null_percentage"),
        (rows - n).alias("missing_count"), percent(rows - n, rows).alias("missing_percentage"),
        distinct.alias("unique_count"), percent(distinct, rows).alias("unique_percentage"),
        repeated.alias("duplicate_count"), percent(repeated, n).alias("duplicate_percentage"),
        (distinct <= 1).alias("is_constant"), ((distinct == rows) & (rows > 0)).alias("is_unique"))


def approximate_distinct(df: DataFrame, rsd: float = 0.05) -> DataFrame:
    """Distinct values per column from sketches in one scan, for columns too wide to count exactly."""
    df = normalize(df)
    names = groupable_columns(df)
    wide = df.agg(*[F.approx_count_distinct(col(c), rsd).alias(f"c{i}") for i, c in enumerate(names)])
    return wide.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"c{i}").alias("unique_count"))
                                          for i, c in enumerate(names)])))


def sample_values(df: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` smallest distinct values of every column, as display text."""
    df = normalize(df)
    names = groupable_columns(df)
    shown = df.select(*[render(df, c).alias(c) for c in names])
    order = Window.partitionBy("column_name").orderBy("value")
    return value_counts(shown, names).withColumn("position", F.row_number().over(order)).where(F.col("position") <= k) \
        .select("column_name", "position", "value")


def numeric_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """Mean, quartiles, spread, shape and zeros of numeric columns."""
    df = normalize(df)
    q = column_quantiles(df, columns, {"q1": 0.25, "median": 0.5, "q3": 0.75}).drop("n_values")
    return stats.moment_summary(df, columns).join(q, "column_name").select(
        "column_name", "mean", "median", F.coalesce("std", F.lit(0.0)).alias("std"), "min", "max", "q1", "q3",
        (F.col("q3") - F.col("q1")).alias("iqr"), F.coalesce("skewness", F.lit(0.0)).alias("skewness"),
        "zeros_count", "zeros_percentage")


def category_profile(df: DataFrame, columns: list[str], k: int = 10) -> DataFrame:
    """Top categories of each column with counts and shares."""
    counts = value_counts(normalize(df), columns)
    totals = counts.groupBy("column_name").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("num_categories"))
    return top_values(counts, k).join(F.broadcast(totals), "column_name").select(
        "column_name", "num_categories", "rank", F.col("value").alias("category"), F.col("n").alias("count"),
        percent(F.col("n"), F.col("total")).alias("percentage"))


def boolean_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    wide = df.agg(*[agg for i, c in enumerate(columns) for agg in (
        F.count(col(c)).alias(f"n{i}"), F.count_if(to_boolean(col(c))).alias(f"t{i}"))])
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"t{i}").alias("true_count"),
                              (F.col(f"n{i}") - F.col(f"t{i}")).alias("false_count"),
                              percent(F.col(f"t{i}"), F.col(f"n{i}")).alias("true_percentage"),
                              percent(F.col(f"n{i}") - F.col(f"t{i}"), F.col(f"n{i}")).alias("false_percentage"))
                     for i, c in enumerate(columns)])
    return wide.select(F.inline(rows))


def text_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    size = lambda c: F.length(col(c).cast("string"))
    wide = df.agg(*[agg for i, c in enumerate(columns) for agg in (
        F.avg(size(c)).alias(f"a{i}"), F.min(size(c)).alias(f"l{i}"), F.max(size(c)).alias(f"h{i}"))])
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.round(F.col(f"a{i}"), 1).alias("avg_length"),
                              F.col(f"l{i}").alias("min_length"), F.col(f"h{i}").alias("max_length"))
                     for i, c in enumerate(columns)])
    return wide.select(F.inline(rows))


def profile_table(df: DataFrame) -> DataFrame:
    """The wide profile: common part for all columns, class-specific fields where they apply."""
    df = normalize(df)
    found = column_features(df)
    features = df.sparkSession.createDataFrame(found.collect(), found.schema)
    classes = {r["column_name"]: r["kind"] for r in features.select("column_name", semantic_class().alias("kind")).collect()}
    of = lambda kind: [c for c in df.columns if classes[c] == kind]
    table = column_profile(df, features)
    if of("Numerical"):
        table = table.join(numeric_profile(df, of("Numerical")), "column_name", "left")
    if of("Categorical"):
        modes = category_profile(df, of("Categorical"), 1).select(
            "column_name", "num_categories", F.col("category").alias("most_frequent_category"),
            F.col("count").alias("mode_frequency"), F.col("percentage").alias("mode_percentage"))
        table = table.join(modes, "column_name", "left")
    if of("Datetime"):
        spans = stats.datetime_spans(df, of("Datetime")).select(
            "column_name", "min_date", "max_date", "date_range_days", "date_range_formatted")
        table = table.join(spans, "column_name", "left")
    if of("Boolean"):
        table = table.join(boolean_profile(df, of("Boolean")), "column_name", "left")
    texts = [c for c in of("Other") if c in groupable_columns(df)]
    if texts:
        table = table.join(text_profile(df, texts), "column_name", "left")
    return table


def columns_of_class(df: DataFrame, kind: str) -> DataFrame:
    """Profile rows of one semantic class, matched without case."""
    return column_profile(df).where(F.lower("semantic_type") == kind.lower())


def quality_score(df: DataFrame) -> DataFrame:
    """Completeness, uniqueness and five checks combined into a score and a grade.

    The per-column verdicts are one row per column, so they are read before the final plan."""
    df = normalize(df)
    columns = decided_features(df, semantic_class(), F.col("n_distinct") <= 1).select(
        "column_name", "n_valid", "n_distinct", semantic_class().alias("kind")).collect()
    numeric = [r["column_name"] for r in columns if r["kind"] == "Numerical"]
    m = dataset_metrics(df) \
        .withColumn("empty_columns", F.lit(sum(r["n_valid"] == 0 for r in columns))) \
        .withColumn("constant_columns", F.lit(sum(r["n_distinct"] <= 1 for r in columns)))
    skewed = F.lit(0)
    if numeric:
        skewed = stats.moment_summary(df, numeric).agg(F.count_if(F.abs("skewness") > 3.0)).scalar()
    return score_metrics(m.withColumn("skewed_columns", skewed))


def score_metrics(m: DataFrame) -> DataFrame:
    """The score over a one-row frame of metrics and check counts."""
    checks = [F.col("missing_cells_percentage") <= 15, F.col("duplicate_rows_percentage") <= 5,
              F.col("empty_columns") == 0, F.col("constant_columns") == 0, F.col("skewed_columns") == 0]
    passed = reduce(lambda a, b: a + b, [c.cast("int") for c in checks])
    empty = F.col("total_rows") == 0
    scored = m.withColumn("completeness_score", F.greatest(F.lit(0.0), F.round(100 - F.col("missing_cells_percentage"), 2))) \
        .withColumn("uniqueness_score", F.greatest(F.lit(0.0), F.round(100 - F.col("duplicate_rows_percentage"), 2))) \
        .withColumn("passed_checks", passed) \
        .withColumn("health_score", F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), (
            F.col("completeness_score") * 0.5 + F.col("uniqueness_score") * 0.3
            + F.col("passed_checks") / F.lit(5) * 100 * 0.2))), 1))
    grade, wording = F.lit("F"), F.lit("Critical Issues")
    for lowest, letter, words in reversed(GRADES):
        grade = F.when(F.col("health_score") >= lowest, letter).otherwise(grade)
        wording = F.when(F.col("health_score") >= lowest, words).otherwise(wording)
    zero = lambda c, z: F.when(empty, F.lit(z)).otherwise(c)
    return scored.select(
        zero(F.col("health_score"), 0.0).alias("health_score"), zero(grade, "F").alias("health_grade"),
        zero(F.col("completeness_score"), 0.0).alias("completeness_score"),
        zero(F.col("uniqueness_score"), 0.0).alias("uniqueness_score"),
        zero(wording, "Empty Dataset").alias("quality_status"),
        zero(F.col("passed_checks"), 0).alias("passed_checks"), F.lit(5).alias("total_checks"))


def column_schema(df: DataFrame, samples: int = 3) -> DataFrame:
    """Role, type, missing and distinct counts and sample values per column."""
    sampled = sample_values(df, samples).groupBy("column_name").agg(
        F.sort_array(F.collect_list(F.struct("position", "value"))).alias("s")) \
        .select("column_name", F.transform("s", lambda x: x["value"]).alias("sample_values"))
    return column_profile(df).join(sampled, "column_name", "left").select(
        "column_name", F.coalesce("role", F.lit("unknown")).alias("role"), "dtype", "missing_count", "unique_count",
        "sample_values")


def preview_page(df: DataFrame, order_by: list[str], page: int = 1, page_size: int = 10) -> DataFrame:
    """One page of rows in key order; page from 1, size clamped to 5..100.

    Only the rows up to the page end travel: the sort is a bounded top-k."""
    size = max(5, min(100, page_size))
    start = (max(1, page) - 1) * size
    return df.orderBy(*[col(c) for c in order_by]).offset(start).limit(size)


def preview_info(df: DataFrame, page: int = 1, page_size: int = 10) -> DataFrame:
    """Page number, total pages and neighbours for ``preview_page``."""
    size, page = max(5, min(100, page_size)), max(1, page)
    pages = F.greatest(F.ceil(F.col("total_rows") / F.lit(size)), F.lit(1)).cast("long")
    return df.agg(F.count(F.lit(1)).alias("total_rows")).select(
        F.lit(page).cast("long").alias("page"), F.lit(size).cast("long").alias("page_size"), "total_rows",
        pages.alias("total_pages"), (F.lit(page) < pages).alias("has_next"), F.lit(page > 1).alias("has_prev"))


def ingestion_summary(df: DataFrame) -> DataFrame:
    """What is shown after loading a table: type, class and missing cells per column."""
    return column_profile(df).select("column_name", "dtype", "semantic_type", "non_null_count", "missing_count",
                                     "missing_percentage", "unique_count")
