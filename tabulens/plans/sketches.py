"""Mergeable sketches of columns: distinct counts with bounds, and frequent values made exact.

A sketch is a few kilobytes per column and task.  Sketches can be stored with the day or file they describe and
merged later, so a table that grows is never read again for them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, functions as F

from tabulens.functions.coerce import groupable_columns, is_numeric, normalize, quoted, text_literal
from tabulens.plans.frequency import long_rows, value_counts
from tabulens.plans.storage import spread

LG_REGISTERS = 14
# one standard error of the estimate, and how many of them a bound lies away
STANDARD_ERROR = 1.04 / 2 ** (LG_REGISTERS / 2)
ERRORS = 5
# values a frequent-item sketch tracks; a value above twice its error of 3.5 / 2^k of the rows is always listed
TRACKED = 8192
MISSED_SHARE = 2 * 3.5 / 16384
FEW_VALUES = 10_000


def sketch_sql(name: str) -> str:
    """SQL aggregate: the distinct sketch of a column of any type that can be hashed."""
    c = quoted(name)
    return f"hll_sketch_agg(CASE WHEN {c} IS NOT NULL THEN xxhash64({c}) END, {LG_REGISTERS})"


def low_sql(estimate: str) -> str:
    """Fewest distinct values that go with an estimate."""
    return f"bigint(floor({estimate} / {1 + ERRORS * STANDARD_ERROR}D))"


def high_sql(estimate: str) -> str:
    """Most distinct values that go with an estimate."""
    return f"bigint(ceil({estimate} / {1 - ERRORS * STANDARD_ERROR}D))"


def column_sizes(df: DataFrame, columns: list[str]) -> dict[str, Row]:
    """For each column ``n_rows``, ``n_valid``, ``single`` (one distinct value), ``only_value`` (its text),
    ``zero_one`` (a number column of nothing else), a distinct ``estimate`` and the number of ``partitions`` of the scan.

    One scan; one small row per column reaches the driver."""
    if not columns:
        return {}
    measures = {"n_valid": "count({0})", "single": "coalesce(min({0}) = max({0}), false)",
                "only_value": "CASE WHEN min({0}) = max({0}) THEN cast(min({0}) AS string) END",
                "zero_one": "{2}", "estimate": "coalesce(hll_sketch_estimate({1}), 0L)"}
    flag = lambda c: f"coalesce(bool_and({quoted(c)} IN (0, 1)), false)" if is_numeric(df.schema[c].dataType) else "false"
    part = "part"
    while part in df.columns:
        part = "_" + part
    wide = df.withColumn(part, F.spark_partition_id()).selectExpr(
        "count(1) AS n_rows", f"coalesce(max({quoted(part)}), 0) + 1 AS partitions",
        *[f"{sql.format(quoted(c), sketch_sql(c), flag(c))} AS m{i}_{m}" for i, c in enumerate(columns) for m, sql in measures.items()])
    rows = ", ".join("named_struct('column_name', {}, 'n_rows', n_rows, 'partitions', partitions, {})".format(
        text_literal(c), ", ".join(f"'{m}', m{i}_{m}" for m in measures)) for i, c in enumerate(columns))
    return {r["column_name"]: r for r in wide.selectExpr(f"inline(array({rows}))").collect()}


def text_values(df: DataFrame, estimates: dict[str, int], partitions: int) -> DataFrame:
    """``(column_name, value, n)`` over the non-null cells of text columns, for sums over values.

    Columns of few distinct values are counted first, so that work per value is done once; the cells of the
    others come one by one; they are not shuffled unless the ``partitions`` of the scan leave cores idle."""
    few = [c for c, n in estimates.items() if n <= FEW_VALUES]
    many = long_rows(df, {c: quoted(c) for c in estimates if c not in few}).where("value IS NOT NULL") \
        .selectExpr("column_name", "value", "1L AS n")
    many = spread(many, partitions) if len(few) < len(estimates) else many
    return value_counts(df, few).unionByName(many) if few else many


def distinct_sketches(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``(column_name, n_valid, sketch)`` from one scan."""
    df = normalize(df)
    columns = groupable_columns(df) if columns is None else columns
    wide = df.selectExpr(*[e for i, c in enumerate(columns)
                           for e in (f"count({quoted(c)}) AS n{i}", f"{sketch_sql(c)} AS s{i}")])
    rows = ", ".join(f"named_struct('column_name', {text_literal(c)}, 'n_valid', n{i}, 'sketch', s{i})"
                     for i, c in enumerate(columns))
    return wide.selectExpr(f"inline(array({rows}))")


def merge_sketches(sketches: DataFrame) -> DataFrame:
    """Sketches of several parts of a table as those of the whole."""
    return sketches.groupBy("column_name").agg(F.sum("n_valid").alias("n_valid"), F.expr("hll_union_agg(sketch)").alias("sketch"))


def distinct_bounds(sketches: DataFrame) -> DataFrame:
    """``(column_name, n_valid, estimate, at_least, at_most)``: bounds five standard errors away."""
    return sketches.selectExpr("column_name", "n_valid", "coalesce(hll_sketch_estimate(sketch), 0L) AS estimate") \
        .selectExpr("*", f"least({low_sql('estimate')}, n_valid) AS at_least", f"least({high_sql('estimate')}, n_valid) AS at_most")


def _item_sql(df: DataFrame, name: str) -> tuple[str, str]:
    """SQL of what a sketch tracks for a column, and its type: numbers as they are, other values by their hash."""
    c = quoted(name)
    if is_numeric(df.schema[name].dataType):
        return c, df.schema[name].dataType.simpleString()
    return f"CASE WHEN {c} IS NOT NULL THEN xxhash64({c}) END", "bigint"


def _candidates(df: DataFrame, columns: list[str]) -> dict[str, tuple[int, list[tuple[str, int]]]]:
    """Rows of each column, and its frequent items as text with their estimated counts, most frequent first."""
    wide = df.selectExpr(*[e for i, c in enumerate(columns) for e in (
        f"count({quoted(c)}) AS n{i}", f"approx_top_k({_item_sql(df, c)[0]}, {TRACKED}, {TRACKED}) AS t{i}")])
    rows = ", ".join(f"named_struct('column_name', {text_literal(c)}, 'n', n{i}, 'top', "
                     f"transform(t{i}, x -> named_struct('item', cast(x.item AS string), 'n', x.count)))"
                     for i, c in enumerate(columns))
    found = wide.selectExpr(f"inline(array({rows}))").collect()
    return {r["column_name"]: (r["n"], [(x["item"], x["n"]) for x in r["top"] or [] if x["item"] is not None]) for r in found}


def _recounted(df: DataFrame, wanted: dict[str, list[str]]) -> DataFrame:
    """``(column_name, value, n)``: exact counts of the values behind the given items; nothing else is shuffled."""
    cases = {}
    for c, items in wanted.items():
        if items:
            item, kind = _item_sql(df, c)
            listed = ", ".join(f"cast({text_literal(v)} AS {kind})" for v in items)
            cases[c] = f"CASE WHEN {item} IN ({listed}) THEN cast({quoted(c)} AS string) END"
    return long_rows(df, cases).where("value IS NOT NULL").groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))


def frequent_values(df: DataFrame, columns: list[str], share: float = 0.05) -> DataFrame:
    """``(column_name, value, n)``: every value of a column that holds ``share`` of its non-null rows or more.

    A sketch proposes, a second scan counts.  ``share`` must exceed what the sketch may miss."""
    if share <= MISSED_SHARE:
        raise ValueError(f"share must be above {MISSED_SHARE}")
    df = normalize(df)
    found = _candidates(df, columns)
    wanted = {c: [v for v, m in top if m >= (share - MISSED_SHARE) * n] for c, (n, top) in found.items()}
    if not any(wanted.values()):
        return df.sparkSession.createDataFrame([], "column_name string, value string, n long")
    least = df.sparkSession.createDataFrame([(c, n * share) for c, (n, _) in found.items()], "column_name string, least double")
    return _recounted(df, wanted).join(F.broadcast(least), "column_name").where("n >= least").select("column_name", "value", "n")


def exact_modes(df: DataFrame, columns: list[str]) -> dict[str, list[tuple[str, int]]]:
    """The most frequent values of each column, as text with their exact count, where the sketch settles them.

    A column is settled if its best value holds more rows than any value the sketch may have missed."""
    df = normalize(df)
    found = _candidates(df, columns)
    wanted = {c: [v for v, m in top if m >= top[0][1] - MISSED_SHARE * n] if top and top[0][1] > MISSED_SHARE * n else []
              for c, (n, top) in found.items()}
    if not any(wanted.values()):
        return {}
    best: dict[str, list[tuple[str, int]]] = {}
    for r in _recounted(df, wanted).collect():
        best.setdefault(r["column_name"], []).append((r["value"], r["n"]))
    modes = {c: [x for x in values if x[1] == max(n for _, n in values)] for c, values in best.items()}
    return {c: values for c, values in modes.items() if values[0][1] > MISSED_SHARE * found[c][0]}
