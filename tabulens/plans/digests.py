"""Fixed-width keys in place of whole values and rows, so that a shuffle does not carry texts.

A cell is told by two 64-bit hashes.  The first alone is exact for every type of at most 64 bits, because
the hash maps such values one to one; other cells count as equal if all 128 bits are.  Where rows
are compared, a second pass looks at the values behind every digest that came more than once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tabulens.functions.coerce import col, groupable_columns, key_columns, normalize, quoted, text_literal
from tabulens.plans.storage import materialize

SECOND_SEED = 7_919
BROADCAST_DIGESTS = 1_000_000  # 16 bytes each
NARROW_ROW = 256
NARROW = (T.IntegralType, T.FloatType, T.DoubleType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType,
          T.DayTimeIntervalType, T.YearMonthIntervalType)
NESTED = (T.ArrayType, T.StructType)


def cell_key_sql(df: DataFrame, name: str) -> tuple[str, str]:
    """SQL of the two halves of a cell's key; the second is 0 where the first is enough."""
    dtype, c = df.schema[name].dataType, quoted(name)
    if isinstance(dtype, NARROW):
        return f"xxhash64({c})", "0L"
    if isinstance(dtype, NESTED):  # the hash of a nested value passes over nulls inside it
        c = f"to_json(struct({c}))"
    return f"xxhash64({c})", f"xxhash64({SECOND_SEED}, {c})"


def exact_distinct(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``(column_name, n_distinct)`` over the non-null values; 16 bytes a cell are shuffled, whatever its length."""
    df = normalize(df)
    columns = groupable_columns(df) if columns is None else columns
    if not columns:
        return df.sparkSession.createDataFrame([], "column_name string, n_distinct long")
    cells = ", ".join("named_struct('column_name', {}, 'there', {} IS NOT NULL, 'k1', {}, 'k2', {})".format(
        text_literal(c), quoted(c), *cell_key_sql(df, c)) for c in columns)
    return df.selectExpr(f"inline(array({cells}))").where("there").select("column_name", "k1", "k2").distinct() \
        .groupBy("column_name").agg(F.count(F.lit(1)).alias("n_distinct"))


def row_digest(keys: list[Column]) -> list[Column]:
    """Two 64-bit hashes of a row; whether a cell is null is hashed with it."""
    marked = [x for k in keys for x in (k.isNull(), k)]
    return [F.xxhash64(*marked), F.xxhash64(F.lit(SECOND_SEED), *marked)]


def _row_bytes(df: DataFrame) -> float:
    """Average bytes of a row: 8 for a cell of fixed width, the length of the others."""
    wide = [f for f in df.schema if not isinstance(f.dataType, NARROW)]
    if not wide:
        return 8.0 * len(df.columns)
    sizes = [F.coalesce(F.octet_length(col(f.name) if isinstance(f.dataType, (T.StringType, T.BinaryType)) else F.to_json(F.struct(f.name))),
                        F.lit(0)) for f in wide]
    return (df.agg(F.avg(sum(sizes[1:], sizes[0]))).first()[0] or 0.0) + 8.0 * (len(df.columns) - len(wide))


def duplicate_counts(df: DataFrame, digest: Callable[[list[Column]], list[Column]] = row_digest,
                     broadcast_rows: int = BROADCAST_DIGESTS, narrow_bytes: int = NARROW_ROW) -> DataFrame:
    """``(total_rows, duplicate_rows)``: rows, and rows equal to another one counted before.

    Rows of few bytes on average are their own keys.  For longer ones, the first pass counts digests and stores those met more than once.  The second pass compares the rows behind
    them: the smallest and the largest row of a digest, combined in each task before they travel.  If the stored
    digests outgrow a broadcast, SHA-256 sums of the rows are compared instead, so that no row is shuffled for its digest.
    Rows of a digest that stands for different rows are grouped by their values."""
    df = normalize(df)
    names = [f"k{i}" for i in range(len(df.columns))]
    keyed = df.select(*[k.alias(n) for k, n in zip(key_columns(df), names)])
    if _row_bytes(keyed) <= narrow_bytes:
        total, extra = F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.col("n") - 1), F.lit(0))
        return keyed.groupBy(*names).agg(F.count(F.lit(1)).alias("n")).agg(total.alias("total_rows"), extra.alias("duplicate_rows"))
    halves = digest([F.col(n) for n in names])
    by = [f"d{i}" for i in range(len(halves))]
    rows = keyed.select(*[h.alias(d) for h, d in zip(halves, by)], *names)
    repeated = materialize(rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*by))
    n = F.count(F.lit(1)).alias("n")
    whole = F.struct(*names)
    if repeated.count() <= broadcast_rows:
        looked = rows.join(F.broadcast(repeated), by, "left_semi").groupBy(*by) \
            .agg(n, F.min(whole).eqNullSafe(F.max(whole)).alias("same"))
    else:
        total = F.sha2(F.to_json(whole), 256)
        looked = rows.groupBy(*by).agg(n, (F.min(total) == F.max(total)).alias("same")).where("n > 1")
    found = looked.agg(F.sum(F.when(F.col("same"), F.col("n") - 1)).alias("extra"), F.count_if(~F.col("same")).alias("mixed")).first()
    extra = found["extra"] or 0
    if found["mixed"]:
        mixed = looked.where("NOT same").select(*by)
        apart = rows.join(mixed, by, "left_semi").groupBy(*by, *names).agg(n)
        extra += apart.agg(F.sum(F.col("n") - 1)).first()[0]
    return df.agg(F.count(F.lit(1)).alias("total_rows")).withColumn("duplicate_rows", F.lit(extra).cast("long"))
