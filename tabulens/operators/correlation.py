"""Pairwise-complete Pearson correlation, ranked pairs and labels."""

from __future__ import annotations

from itertools import combinations
from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tabulens.functions.coerce import as_double, col, is_numeric, is_text, normalize
from tabulens.operators.types import class_map

EXPRESSION_COLUMNS = 8  # beyond it matrix products are the cheaper plan; the results are the same
PAIR_SCHEMA = "variable_a string, variable_b string, correlation double, sample_size long"


def numeric_features(df: DataFrame) -> list[str]:
    """Columns that take part: numeric class or type; booleans count as 0 and 1."""
    # only the class of a text column is open: numbers and booleans take part whatever theirs is, other types never do
    texts = [f.name for f in df.schema if is_text(f.dataType)]
    classes = class_map(df.select(*map(col, texts))) if texts else {}
    return [f.name for f in df.schema
            if is_numeric(f.dataType) or isinstance(f.dataType, T.BooleanType) or classes.get(f.name) == "Numerical"]


def _value(df: DataFrame, name: str) -> Column:
    """The number that takes part; an infinity counts as missing, like NULL and NaN."""
    if isinstance(df.schema[name].dataType, T.BooleanType):
        return col(name).cast("double")
    value = as_double(df, name)
    return F.when(F.abs(value) < float("inf"), value)


def strength_label(r: Column) -> Column:
    a = F.abs(r)
    return (F.when(r.isNull(), "Undefined").when(a >= 0.80, "Very strong").when(a >= 0.60, "Strong")
            .when(a >= 0.40, "Moderate").when(a >= 0.20, "Weak").otherwise("Very weak"))


def direction_label(r: Column, tolerance: float = 1e-4) -> Column:
    return F.when(r > tolerance, "Positive").when(r < -tolerance, "Negative").otherwise("Neutral")


def _coefficient(n: Column, sxy: Column, sxx: Column, syy: Column, min_periods: int) -> Column:
    """r from centred sums; 0 for a side without variance, too few pairs, or sums beyond double range."""
    r = F.try_divide(sxy, F.sqrt(sxx) * F.sqrt(syy))
    return F.when((n >= min_periods) & (sxx > 0) & (syy > 0) & ~F.isnan(r), F.greatest(F.least(r, F.lit(1.0)), F.lit(-1.0))) \
        .otherwise(0.0)


def _by_expressions(df: DataFrame, columns: list[str], min_periods: int) -> DataFrame:
    """All pairs as aggregate expressions of one scan."""
    values = df.select(*[_value(df, c).alias(f"c{i}") for i, c in enumerate(columns)])
    pairs = list(combinations(range(len(columns)), 2))
    wide = values.agg(*[fn(F.col(f"c{j}"), F.col(f"c{i}")).alias(f"{name}_{i}_{j}") for i, j in pairs
                        for name, fn in (("n", F.regr_count), ("sxy", F.regr_sxy),
                                         ("sxx", F.regr_sxx), ("syy", F.regr_syy))])
    rows = F.array(*[F.struct(
        F.lit(columns[i]).alias("variable_a"), F.lit(columns[j]).alias("variable_b"),
        _coefficient(*[F.col(f"{m}_{i}_{j}") for m in ("n", "sxy", "sxx", "syy")], min_periods).alias("correlation"),
        F.col(f"n_{i}_{j}").alias("sample_size")) for i, j in pairs])
    return wide.select(F.inline(rows))


def _by_blocks(df: DataFrame, columns: list[str], min_periods: int) -> DataFrame:
    """Many columns: every task adds up the products of its rows as matrices, Spark sums the cells.

    Values are shifted by the column mean first, so the sums keep their precision."""
    k = len(columns)
    means = df.agg(*[F.avg(_value(df, c)).alias(f"c{i}") for i, c in enumerate(columns)]).first()
    shifted = df.select(*[(_value(df, c) - F.lit(means[i] or 0.0)).alias(f"c{i}") for i, c in enumerate(columns)])

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = None
        for batch in batches:
            x = batch.to_numpy(dtype=float, na_value=np.nan)
            seen = (~np.isnan(x)).astype(float)
            x = np.nan_to_num(x)
            parts = [seen.T @ seen, x.T @ seen, (x * x).T @ seen, x.T @ x]
            sums = parts if sums is None else [a + b for a, b in zip(sums, parts)]
        if sums is not None:
            n, sx, sxx, sxy = sums
            i, j = np.triu_indices(k, 1)
            yield pd.DataFrame({"i": i, "j": j, "n": n[i, j], "sx": sx[i, j], "sy": sx[j, i],
                                "sxx": sxx[i, j], "syy": sxx[j, i], "sxy": sxy[i, j]})

    cells = shifted.mapInPandas(
        partial, "i int, j int, n double, sx double, sy double, sxx double, syy double, sxy double") \
        .groupBy("i", "j").agg(*[F.sum(m).alias(m) for m in ("n", "sx", "sy", "sxx", "syy", "sxy")])
    names = F.array(*[F.lit(c) for c in columns])
    n = F.col("n")
    centred = lambda s, a, b: F.col(s) - F.try_divide(F.col(a) * F.col(b), n)
    # cancellation noise of a constant side must read as no variance
    clean = lambda c, raw: F.when(c > F.abs(F.col(raw)) * 1e-12, c).otherwise(0.0)
    return cells.select(
        F.element_at(names, F.col("i") + 1).alias("variable_a"), F.element_at(names, F.col("j") + 1).alias("variable_b"),
        _coefficient(n, centred("sxy", "sx", "sy"), clean(centred("sxx", "sx", "sx"), "sxx"),
                     clean(centred("syy", "sy", "sy"), "syy"), min_periods).alias("correlation"),
        n.cast("long").alias("sample_size"))


def correlation_pairs(df: DataFrame, columns: list[str] | None = None, threshold: float = 0.0,
                      min_periods: int = 2) -> DataFrame:
    """Every unordered pair with r, |r|, strength, direction and the number of complete rows."""
    df = normalize(df)
    columns = numeric_features(df) if columns is None else columns
    if len(columns) < 2:
        pairs = df.sparkSession.createDataFrame([], PAIR_SCHEMA)
    elif len(columns) <= EXPRESSION_COLUMNS:
        pairs = _by_expressions(df, columns, min_periods)
    else:
        pairs = _by_blocks(df, columns, min_periods)
    r = F.col("correlation")
    return pairs.where(F.abs(r) >= threshold).select(
        "variable_a", "variable_b", r, F.abs(r).alias("absolute_correlation"),
        strength_label(r).alias("strength"), direction_label(r).alias("direction"), "sample_size")


def ranked_pairs(df: DataFrame, columns: list[str] | None = None, threshold: float = 0.0) -> DataFrame:
    return correlation_pairs(df, columns, threshold).orderBy(
        F.desc("absolute_correlation"), "variable_a", "variable_b")


def key_pairs(df: DataFrame, columns: list[str] | None = None, top_k: int = 5) -> DataFrame:
    """The strongest positive and the strongest negative pairs."""
    signed = correlation_pairs(df, columns).where("correlation <> 0") \
        .withColumn("sign", F.when(F.col("correlation") > 0, "positive").otherwise("negative"))
    order = Window.partitionBy("sign").orderBy(F.desc("absolute_correlation"), "variable_a", "variable_b")
    return signed.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k) \
        .select("sign", "rank", "variable_a", "variable_b", "correlation", "strength", "sample_size")


def strength_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    return correlation_pairs(df, columns).groupBy("strength").agg(F.count(F.lit(1)).alias("pairs"))


def matrix_cells(df: DataFrame, columns: list[str]) -> DataFrame:
    """The full matrix in long form: both triangles and the unit diagonal."""
    upper = correlation_pairs(df, columns).select("variable_a", "variable_b", "correlation", "sample_size")
    lower = upper.select(F.col("variable_b").alias("variable_a"), F.col("variable_a").alias("variable_b"),
                         "correlation", "sample_size")
    counts = df.agg(*[F.count(_value(df, c)).alias(f"c{i}") for i, c in enumerate(columns)])
    diagonal = counts.select(F.inline(F.array(*[F.struct(
        F.lit(c).alias("variable_a"), F.lit(c).alias("variable_b"), F.lit(1.0).alias("correlation"),
        F.col(f"c{i}").alias("sample_size")) for i, c in enumerate(columns)])))
    return upper.unionByName(lower).unionByName(diagonal)


def matrix_frame(df: DataFrame, columns: list[str]) -> DataFrame:
    """The matrix as one row per column."""
    return matrix_cells(df, columns).groupBy("variable_a").pivot("variable_b", columns).agg(F.first("correlation"))


def collinear_pairs(df: DataFrame, columns: list[str] | None = None, threshold: float = 0.85) -> DataFrame:
    return correlation_pairs(df, columns, threshold).select("variable_a", "variable_b", "correlation", "sample_size")


def pair_correlation(df: DataFrame, x: str, y: str) -> DataFrame:
    """One pair, needing three complete rows, with the labels of the pair lookup."""
    a = F.abs("correlation")
    strength = (F.when(a >= 0.8, "Very Strong").when(a >= 0.6, "Strong").when(a >= 0.4, "Moderate")
                .when(a >= 0.2, "Weak").otherwise("Negligible / Very Weak"))
    return correlation_pairs(df, [x, y]).where("sample_size >= 3").select(
        "variable_a", "variable_b", "correlation", strength.alias("strength"),
        F.when(F.col("correlation") >= 0, "Positive").otherwise("Negative").alias("direction"), "sample_size")
