"""Exact quantiles without a global sort and without a value map in one task.

The value at a rank is found by narrowing: a histogram with order-preserving bins (a magnitude
bin first, linear splits of the remaining bins next) tells which bin holds the rank; only the rows
of those bins are kept.  Bins are split again between their own extremes until the fullest one is
small, whatever the number of rows; then the kept rows are counted per distinct value and ordered.
Every pass pre-aggregates on the map side, so a value or bin that holds a third of all rows is one
row per task after it.  The chosen bins of a pass, a few per key, are stored, so no pass repeats an
earlier one."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import DataFrame, functions as F

from tabulens.functions.coerce import double_sql, quoted
from tabulens.plans.frequency import long_rows
from tabulens.plans.storage import materialize

BINS_PER_E = 128
LINEAR_BINS = 4096
BROADCAST_BYTES = 16 << 20
FEW_ROWS = 200_000
MAX_LEVELS = 12


# order-preserving bin number of a double: sign and scaled logarithm, 0 for zero
MAGNITUDE_BIN = ("CASE WHEN _x = 0 THEN 0L ELSE bigint(signum(_x))"
                 " * (floor(least(ln(abs(_x)), 750D) * {}) + 100000) END")
LINEAR_BIN = (f"CASE WHEN _high > _low THEN least(floor((_x - _low) / (_high - _low) * {LINEAR_BINS}),"
              f" {LINEAR_BINS - 1}L) ELSE 0L END")
RUNNING = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"


def quantile_frame(rows: DataFrame, keys: list[str], value: str, probs: dict[str, float],
                   weight: str | None = None, few_rows: int = FEW_ROWS, bins_per_e: int = BINS_PER_E,
                   few_keys: bool = False) -> DataFrame:
    """One row per key with one column per entry of ``probs`` (name -> probability).

    Linear interpolation between neighbouring ranks.  ``weight`` counts a row several times.
    A bin of more than ``few_rows`` rows and more than one value is split again.  The chosen bins are
    broadcast if they take little memory, else joined by shuffle.  ``bins_per_e`` sets how finely
    magnitudes are told apart; it changes the cost, not the result.  ``few_keys`` says that the keys are names of
    columns: their chosen bins, two per key and probability, are then read by the driver instead of being stored."""
    names = [quoted(k) for k in keys]
    by_key = ", ".join(names)
    position = {out: f"({p!r}D * (_total - 1))" for out, p in probs.items()}
    ranks = "array({})".format(", ".join(f"floor({p}), ceil({p})" for p in position.values()))
    inside = "r -> r >= _base AND r < _base + _n"
    count = f"bigint(sum({quoted(weight)})) AS _n" if weight else "count(1) AS _n"
    tallies = [F.expr(e) for e in (count, "min(_x) AS _low", "max(_x) AS _high")]

    cur = rows.selectExpr(*names, f"cast({quoted(value)} AS double) AS _x", *([quoted(weight)] if weight else [])) \
        .where("_x IS NOT NULL").selectExpr("*", f"{MAGNITUDE_BIN.format(bins_per_e)} AS _bin")
    bins = cur.groupBy(*names, "_bin").agg(*tallies).selectExpr(
        "*", f"sum(_n) OVER (PARTITION BY {by_key}) AS _total",
        f"sum(_n) OVER (PARTITION BY {by_key} ORDER BY _bin {RUNNING}) - _n AS _base")
    path = [*keys, "_bin"]

    for _ in range(MAX_LEVELS):
        kept = bins.where(f"exists({ranks}, {inside})")
        kept = cur.sparkSession.createDataFrame(kept.collect(), kept.schema) if few_keys else materialize(kept)
        size = kept.agg(F.max(F.when(F.col("_high") > F.col("_low"), F.col("_n"))), F.count(F.lit(1)),
                        F.sum(reduce(add, [F.octet_length(F.col(n).cast("string")) for n in names], F.lit(64)))).first()
        chosen = kept.drop("_n")
        cur = cur.join(F.broadcast(chosen) if (size[2] or 0) <= BROADCAST_BYTES else chosen, path)
        if (size[0] or 0) <= few_rows:
            break
        # split every bin that was kept between its own extremes
        extra = [quoted(weight)] if weight else []
        cur = cur.selectExpr(*names, "_x", *extra, "_total", "_base AS _parent", f"{LINEAR_BIN} AS _bin")
        path = [*keys, "_total", "_parent", "_bin"]
        bins = cur.groupBy(*[quoted(c) for c in path]).agg(*tallies).selectExpr(
            "*", f"_parent + sum(_n) OVER (PARTITION BY {by_key}, _parent ORDER BY _bin {RUNNING}) - _n AS _base")

    values = cur.groupBy(*names, "_base", "_total", "_x").agg(tallies[0]).selectExpr(
        *names, "_total", "_x", "_n",
        f"_base + sum(_n) OVER (PARTITION BY {by_key}, _base ORDER BY _x {RUNNING}) - _n AS _base")
    ranked = values.selectExpr(*names, "_total", "_x", f"explode(filter(array_distinct({ranks}), {inside})) AS _rank")
    sides = [F.expr(f"max(CASE WHEN _rank = {side}({p}) THEN _x END) AS _{side}_{i}")
             for i, p in enumerate(position.values()) for side in ("floor", "ceil")]
    return ranked.groupBy(*names, "_total").agg(*sides).selectExpr(*names, "_total AS n_values", *[
        f"CASE WHEN _floor_{i} = _ceil_{i} THEN _floor_{i}"
        f" ELSE _floor_{i} + (_ceil_{i} - _floor_{i}) * ({p} - floor({p})) END AS {quoted(out)}"
        for i, (out, p) in enumerate(position.items())])


def long_numbers(df: DataFrame, columns: list[str], finite_only: bool = False) -> DataFrame:
    """Numeric columns as ``(column_name, value)`` rows, NULL and NaN left out."""
    rows = long_rows(df, {c: double_sql(df, c) for c in columns}).where("value IS NOT NULL")
    return rows.where("abs(value) < double('Infinity')") if finite_only else rows


def column_quantiles(df: DataFrame, columns: list[str], probs: dict[str, float],
                     finite_only: bool = False) -> DataFrame:
    """Quantiles of every column: ``(column_name, n_values, <name> ...)``."""
    return quantile_frame(long_numbers(df, columns, finite_only), ["column_name"], "value", probs, few_keys=True)


def collect_quantiles(df: DataFrame, columns: list[str], probs: dict[str, float],
                      finite_only: bool = False) -> dict[str, dict]:
    """The same as a dictionary per column: one small row each, used as literals in later plans."""
    if not columns:
        return {}
    return {r["column_name"]: r.asDict() for r in column_quantiles(df, columns, probs, finite_only).collect()}


def group_quantiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Quantiles per group, with coarse bins first: most groups need no finer ones."""
    rows = df.selectExpr(*[quoted(k) for k in keys], f"{double_sql(df, value)} AS _value")
    return quantile_frame(rows, keys, "_value", probs, bins_per_e=16)
