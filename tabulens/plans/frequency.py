"""Value counts of many columns in one shuffle, and small reductions of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tabulens.functions.coerce import double_sql, quoted, text_literal


def long_rows(df: DataFrame, expressions: dict[str, str], value: str = "value") -> DataFrame:
    """``(column_name, value)`` rows of several expressions of a frame, one per name."""
    if not expressions:
        return df.selectExpr("cast(NULL AS string) AS column_name", f"cast(NULL AS string) AS {value}").where("false")
    pairs = ", ".join(f"named_struct('column_name', {text_literal(name)}, '{value}', {sql})"
                      for name, sql in expressions.items())
    return df.selectExpr(f"inline(array({pairs}))")


def _counted(rows: DataFrame) -> DataFrame:
    return rows.where("value IS NOT NULL").groupBy("column_name", "value").agg(F.expr("count(1) AS n"))


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """``(column_name, value, n)`` over the non-null values, as text.

    Counts combine on the map side, so a frequent value costs one row per task."""
    return _counted(long_rows(df, {c: f"cast({quoted(c)} AS string)" for c in columns}))


def number_kind(df: DataFrame, name: str) -> str:
    """The type in which the numbers of a column are told apart: whole and decimal numbers keep all digits."""
    dtype = df.schema[name].dataType
    return "bigint" if isinstance(dtype, T.IntegralType) else "decimal(38,10)" if isinstance(dtype, T.DecimalType) else "double"


def own_number_sql(df: DataFrame, name: str) -> str:
    """SQL of a numeric column in the type of its values."""
    kind = number_kind(df, name)
    return double_sql(df, name) if kind == "double" else f"cast({quoted(name)} AS {kind})"


def number_counts(df: DataFrame, columns: list[str]) -> list[DataFrame]:
    """``(column_name, value, n)`` over numeric values, one frame for each type of value."""
    by_kind: dict[str, dict[str, str]] = {}
    for c in columns:
        by_kind.setdefault(number_kind(df, c), {})[c] = own_number_sql(df, c)
    return [_counted(long_rows(df, expressions)) for expressions in by_kind.values()]


def top_values(counts: DataFrame, k: int, rank: str = "rank") -> DataFrame:
    """The ``k`` most frequent values per column, ties by value.

    ``row_number() <= k`` lets Spark keep ``k`` rows per task before the shuffle."""
    order = Window.partitionBy("column_name").orderBy(F.desc("n"), F.asc("value"))
    return counts.withColumn(rank, F.row_number().over(order)).where(F.col(rank) <= k)


def mode_of(value: str = "value", n: str = "n") -> Column:
    """Aggregate: the most frequent value, the smallest on ties."""
    return F.min_by(value, F.struct(-F.col(n), F.col(value)))
