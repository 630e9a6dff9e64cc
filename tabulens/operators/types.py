"""Semantic column classes and chart roles.

Shares are sums over the whole column, so the result does not depend on row order; values of columns with many
different ones are not shuffled for them.  The number of distinct values comes from a sketch with bounds; it is counted exactly only
where the bounds leave a rule open."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Row, functions as F, types as T

from tabulens.functions.coerce import (DATE_SEPARATORS, FEW_WORDS, NO_NUMBER, col, groupable_columns, is_numeric, is_temporal,
                                       is_text, normalize, quoted, strip, to_datetime, to_number)
from tabulens.plans.digests import exact_distinct
from tabulens.plans.sketches import FEW_VALUES, column_sizes, high_sql, low_sql, text_values

CLASSES = ["Numerical", "Categorical", "Datetime", "Boolean", "Other"]
ROLES = ["numerical", "categorical", "datetime", "boolean", "identifier"]

# Boolean vocabularies and name fragments.
BOOLEAN_WORDS = [["true", "false"], ["yes", "no"], ["y", "n"], ["t", "f"], ["1", "0"]]
ROLE_BOOLEAN_WORDS = [["true", "false"], ["yes", "no"], ["y", "n"]]
BOOLEAN_NAMES = ["is_", "has_", "flag", "active", "enabled", "selected"]
RATING_NAMES = ["rating", "score", "level", "class"]
ID_NAMES = ["_id", "id_", "uuid", "guid", "code", "identifier", "key", "token"]
ROLE_ID_NAMES = ["_id", "id_", "uuid", "guid", "ssn", "key", "code"]
ZERO_ONE = ["0", "1", "0.0", "1.0"]


def storage_type(dtype: T.DataType) -> str:
    """Short storage type of a column: integer, float, decimal, boolean, text, datetime or other."""
    if isinstance(dtype, T.BooleanType):
        return "boolean"
    if isinstance(dtype, T.IntegralType):
        return "integer"
    if isinstance(dtype, T.DecimalType):
        return "decimal"
    if is_numeric(dtype):
        return "float"
    if is_temporal(dtype):
        return "datetime"
    return "text" if is_text(dtype) else "other"


def schema_frame(df: DataFrame) -> DataFrame:
    """``(position, column_name, dtype, storage)`` of a frame."""
    rows = [(i, f.name, f.dataType.simpleString(), storage_type(f.dataType)) for i, f in enumerate(df.schema)]
    return df.sparkSession.createDataFrame(rows, "position int, column_name string, dtype string, storage string")


BOOLEAN_FLAGS = [f"words_{i}" for i in range(len(BOOLEAN_WORDS))]


def _text_features(df: DataFrame, estimates: dict[str, int], partitions: int) -> DataFrame:
    """Shares and flags of text columns, as sums over their values."""
    v, n = F.col("value"), F.col("n")
    low = F.lower(strip(v))
    words = reduce(lambda rest, i: F.when(low.isin(BOOLEAN_WORDS[i]), i).otherwise(rest), range(len(BOOLEAN_WORDS)), F.lit(-1))
    seen = text_values(df, estimates, partitions).select(
        "column_name", "n", words.alias("words"), v.isin(ZERO_ONE).alias("zero_one"), F.length(v).alias("length"),
        v.rlike(DATE_SEPARATORS).alias("separated"),
        F.when(v.rlike(FEW_WORDS), to_datetime(v).isNotNull()).alias("date"),
        F.when(~v.rlike(NO_NUMBER), to_number(v).isNotNull()).alias("number"))
    share = lambda c: F.sum(F.when(F.col(c), n).otherwise(0)) / F.sum(n)
    return seen.groupBy("column_name").agg(
        F.bool_and("zero_one").alias("only_zero_one"),
        *[F.bool_and(F.col("words") == i).alias(f) for i, f in enumerate(BOOLEAN_FLAGS)],
        F.bool_or("separated").alias("has_separator"), share("date").alias("date_share"),
        share("number").alias("number_share"), (F.sum(F.col("length") * n) / F.sum(n)).alias("mean_length"),
        F.count(F.lit(1)).alias("values"))


def scan_features(df: DataFrame) -> DataFrame:
    """One row per column: what the class and role rules look at, with bounds for the distinct values.

    ``at_least`` and ``at_most`` come from a sketch; they agree for columns without or with one value.  ``counted`` is the
    exact number for text columns of few values, whose values were counted anyway."""
    df = normalize(df)
    spark = df.sparkSession
    kinds = {f.name: storage_type(f.dataType) for f in df.schema}
    sizes = column_sizes(df, groupable_columns(df))
    odd = [c for c in kinds if c not in sizes]
    there = df.agg(F.count(F.lit(1)), *[F.count(col(c)) for c in odd]).first() if odd else []
    n_rows = next((r["n_rows"] for r in sizes.values()), there[0] if odd else 0)
    measured = [(c, n_rows, r["n_valid"], r["estimate"], r["single"], r["zero_one"]) for c, r in sizes.items()] \
        + [(c, n_rows, there[i + 1], 0, False, False) for i, c in enumerate(odd)]
    base = schema_frame(df).join(F.broadcast(spark.createDataFrame(
        measured, "column_name string, n_rows long, n_valid long, estimate long, single boolean, only_zero_one boolean")),
        "column_name").selectExpr(
            "position", "column_name", "dtype", "storage", "n_rows", "n_valid", "only_zero_one",
            "CASE WHEN n_valid = 0 THEN 0L WHEN single THEN 1L END AS known",
            f"coalesce(known, greatest(least({low_sql('estimate')}, n_valid), 2L)) AS at_least",
            f"coalesce(known, greatest(least({high_sql('estimate')}, n_valid), 2L)) AS at_most").drop("known")
    estimates = {c: sizes[c]["estimate"] for c, k in kinds.items() if k == "text"}
    counted = [c for c, n in estimates.items() if n <= FEW_VALUES]
    partitions = next((r["partitions"] for r in sizes.values()), 1)
    texts = _text_features(df, estimates, partitions).withColumn("counted", F.when(F.col("column_name").isin(counted), F.col("values"))).drop("values")
    texts = texts.withColumnRenamed("only_zero_one", "_zero_one")
    return F.broadcast(base).join(texts, "column_name", "left").withColumns(
        {f: F.coalesce(F.col(f), F.lit(False)) for f in ("has_separator", *BOOLEAN_FLAGS)}) \
        .withColumn("only_zero_one", F.coalesce("_zero_one", "only_zero_one")).drop("_zero_one")


def column_features(df: DataFrame) -> DataFrame:
    """``scan_features`` with the exact number of distinct values of every column."""
    found = scan_features(df)
    scanned = df.sparkSession.createDataFrame(found.collect(), found.schema)
    rest = [r["column_name"] for r in scanned.collect() if r["counted"] is None and r["at_least"] < r["at_most"]]
    known = F.when(F.col("at_least") == F.col("at_most"), F.col("at_least"))
    return scanned.join(exact_distinct(df, rest), "column_name", "left") \
        .withColumn("n_distinct", F.coalesce("n_distinct", "counted", known, F.lit(0))).drop("at_least", "at_most", "counted")


def _turning_points(row) -> list[int]:
    """Numbers of distinct values, within the bounds of a column, at which a rule may change its mind."""
    valid, rows = row["n_valid"], row["n_rows"]
    steps = [1, 2, 5, 10, 15, 50, 60, valid, rows, *(valid * x for x in (0.3, 0.4, 0.5)), *(rows * x for x in (0.5, 0.85, 0.95))]
    near = {int(s) + k for s in steps for k in (-1, 0, 1, 2)} | {row["at_least"], row["at_most"]}
    return sorted(x for x in near if row["at_least"] <= x <= row["at_most"])


def decided_features(df: DataFrame, *verdicts: Column) -> DataFrame:
    """Features with ``n_distinct`` near enough to decide the given rules: as many scans as are needed for that.

    Bounds of a sketch settle most columns.  Only where the rules give different answers within the bounds of a
    column are its values counted.  One row per column reaches the driver."""
    spark = df.sparkSession
    scanned = scan_features(df)
    kept = [c for c in scanned.columns if c not in ("at_least", "at_most", "counted")]
    schema = T.StructType([scanned.schema[c] for c in kept] + [T.StructField("n_distinct", T.LongType())])
    rows = [r if r["counted"] is None else Row(**r.asDict() | {"at_least": r["counted"], "at_most": r["counted"]})
            for r in scanned.collect()]
    record = lambda r, n: (*[r[c] for c in kept], n)
    tried = spark.createDataFrame([record(r, n) for r in rows for n in _turning_points(r)], schema)
    answers: dict[str, set[str]] = {}
    for r in tried.select("column_name", F.to_json(F.struct(*verdicts), {"ignoreNullFields": "false"}).alias("answer")).collect():
        answers.setdefault(r["column_name"], set()).add(r["answer"])
    open_columns = [c for c, found in answers.items() if len(found) > 1]
    exact = {r["column_name"]: r["n_distinct"] for r in exact_distinct(df, open_columns).collect()} if open_columns else {}
    return spark.createDataFrame([record(r, exact.get(r["column_name"], r["at_most"])) for r in rows], schema)


def _named(fragments: list[str]) -> Column:
    return F.lower("column_name").rlike("|".join(fragments))


def semantic_class() -> Column:
    """The five profile classes as an ordered rule chain over ``column_features``."""
    ratio = F.try_divide(F.col("n_distinct"), F.col("n_valid"))
    text, number = F.col("storage") == "text", F.col("storage").isin("integer", "float", "decimal")
    words = F.lit(False)
    for i in range(len(BOOLEAN_WORDS)):
        words = words | F.col(f"words_{i}")
    is_id = _named(ID_NAMES) | (F.lower("column_name") == "id")
    return (F.when(F.col("n_valid") == 0, "Other")
            .when(F.col("storage") == "boolean", "Boolean")
            .when(number & F.col("only_zero_one"), "Boolean")
            .when(words, "Boolean")
            .when(F.col("storage") == "datetime", "Datetime")
            .when(text & F.col("has_separator") & (F.col("date_share") >= 0.8), "Datetime")
            .when((F.col("storage") == "integer") & (F.col("n_distinct") <= 5) & (F.col("n_valid") >= 30)
                  & _named(RATING_NAMES), "Categorical")
            .when(number, "Numerical")
            .when(text & (F.col("number_share") >= 0.9), "Numerical")
            .when(is_id & ((ratio >= 0.5) | (F.col("n_distinct") >= 10)), "Other")
            .when((F.col("n_distinct") == F.col("n_valid")) & (F.col("n_valid") >= 15), "Other")
            .when(text & (F.col("mean_length") > 60) & (ratio > 0.4), "Other")
            .when((F.col("n_distinct") <= 50) | (ratio <= 0.30), "Categorical")
            .otherwise("Other"))


def chart_role() -> Column:
    """The five chart roles; an empty or zero-variance column has none."""
    ratio = F.try_divide(F.col("n_distinct"), F.greatest(F.col("n_rows"), F.lit(1)))
    text, number = F.col("storage") == "text", F.col("storage").isin("integer", "float", "decimal")
    words = F.lit(False)
    for i in range(len(ROLE_BOOLEAN_WORDS)):
        words = words | F.col(f"words_{i}")
    is_id = _named(ROLE_ID_NAMES) | (F.lower("column_name") == "id")
    return (F.when(F.col("n_valid") == 0, None)
            .when(F.col("storage") == "datetime", "datetime")
            .when(text & F.col("has_separator") & (F.col("date_share") >= 0.8), "datetime")
            .when(F.col("storage") == "boolean", "boolean")
            .when(number & F.col("only_zero_one") & _named(BOOLEAN_NAMES), "boolean")
            .when(words, "boolean")
            .when(is_id & ~number, "identifier")
            .when(~number & (F.col("n_distinct") > 50) & (ratio >= 0.85), "identifier")
            .when(number & is_id & (ratio >= 0.95), "identifier")
            .when(number & (F.col("n_distinct") > 1), "numerical")
            .when(number, None)
            .when((F.col("n_distinct") <= 60) | (ratio <= 0.5), "categorical")
            .otherwise("identifier"))


def semantic_types(df: DataFrame) -> DataFrame:
    """``(column_name, dtype, semantic_type)``."""
    return decided_features(df, semantic_class()).select("column_name", "dtype", semantic_class().alias("semantic_type"))


def column_roles(df: DataFrame) -> DataFrame:
    """``(column_name, dtype, role)``; the role is NULL for columns that cannot be charted."""
    return decided_features(df, chart_role()).select("column_name", "dtype", chart_role().alias("role"))


def class_counts(df: DataFrame) -> DataFrame:
    """Columns per class, classes without columns included."""
    all_classes = df.sparkSession.createDataFrame([(c,) for c in CLASSES], "semantic_type string")
    found = semantic_types(df).groupBy("semantic_type").agg(F.count(F.lit(1)).alias("n"))
    return all_classes.join(found, "semantic_type", "left") \
        .select("semantic_type", F.coalesce("n", F.lit(0)).alias("column_count"))


def role_map(df: DataFrame) -> dict[str, list[str]]:
    """Column names per role in schema order; one small row per column reaches the driver."""
    roles: dict[str, list[str]] = {r: [] for r in ROLES}
    found = {r["column_name"]: r["role"] for r in column_roles(df).collect()}
    for name in df.columns:
        if found.get(name):
            roles[found[name]].append(name)
    return roles


def class_map(df: DataFrame) -> dict[str, str]:
    """Class per column name."""
    return {r["column_name"]: r["semantic_type"] for r in semantic_types(df).collect()}


def outlier_columns(df: DataFrame) -> list[str]:
    """Numeric columns for outlier work: numeric class or type, without booleans and flags."""
    classes = class_map(df)
    return [f.name for f in df.schema
            if classes[f.name] != "Boolean" and (classes[f.name] == "Numerical" or is_numeric(f.dataType))]
