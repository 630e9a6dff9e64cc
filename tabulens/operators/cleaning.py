"""The cleaning steps, each a function of its own, and the configurable chain of all of them.

Values that decide a step (shares, medians, modes, fences) are a few numbers per column; they
are computed on the frame the step sees and become literals of its plan."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tabulens.functions.coerce import (as_double, clipped, col, groupable_columns, key_columns, is_numeric, normalize, numeric_columns,
                                       strip, text_columns, is_missing_word, to_datetime, to_number)
from tabulens.operators.quality import (SENTINEL_NUMBERS, case_variants, is_date_text,
                                        is_numeric_text, is_positive_domain, text_scan)
from tabulens.plans.frequency import mode_of, value_counts
from tabulens.plans.quantiles import BROADCAST_BYTES, collect_quantiles
from tabulens.plans.sketches import frequent_values
from tabulens.plans.storage import materialize

HOT_SHARE = 0.01

# The options and their defaults.
DEFAULTS = {
    "remove_duplicates": True,
    "fill_numeric_missing": "median",
    "fill_categorical_missing": "mode",
    "standardize_whitespace": True,
    "standardize_categorical": True,
    "convert_numeric_strings": True,
    "convert_datetime_strings": True,
    "handle_invalid_numerical": True,
    "drop_high_missing_columns": False,
    "drop_constant_columns": False,
    "cap_outliers": False,
    "high_missing_threshold": 0.5,
    "null_sentinels": False,
}


@dataclass
class CleanResult:
    """The cleaned frame, a one-row summary and a log of ``(column_name, step, affected)``."""

    data: DataFrame
    summary: DataFrame
    log: DataFrame


def _count_per_column(df: DataFrame, flags: dict[str, Column]) -> dict[str, int]:
    """Rows matching each column's flag, in one scan; columns without a match are left out."""
    if not flags:
        return {}
    row = df.agg(*[F.count_if(flag).alias(f"c{i}") for i, flag in enumerate(flags.values())]).first()
    return {name: row[f"c{i}"] for i, name in enumerate(flags) if row[f"c{i}"]}


def padded_cells(df: DataFrame) -> dict[str, Column]:
    return {c: strip(col(c)) != col(c) for c in text_columns(df)}


def strip_whitespace(df: DataFrame) -> DataFrame:
    """Step 1: strip every text cell."""
    names = text_columns(df)
    return df.withColumns({c: strip(col(c)) for c in names}) if names else df


def null_missing_words(df: DataFrame) -> DataFrame:
    """Optional: text cells that spell a missing value become NULL."""
    names = text_columns(df)
    return df.withColumns({c: F.when(~is_missing_word(col(c)), col(c)) for c in names}) if names else df


def category_map(df: DataFrame) -> DataFrame:
    """Step 2, first half: spellings to replace, for text columns with five values and more."""
    counts = value_counts(df, text_columns(df))
    enough = counts.groupBy("column_name").agg(F.sum("n").alias("total")).where("total >= 5").drop("total")
    return case_variants(counts.join(F.broadcast(enough), "column_name", "left_semi")) \
        .select("column_name", "value", "n", "canonical")


def _fresh(df: DataFrame, name: str) -> str:
    """A column name that the frame does not have."""
    while name in df.columns:
        name = "_" + name
    return name


def apply_category_map(df: DataFrame, mapping: DataFrame, columns: list[str], small: bool) -> DataFrame:
    """Step 2, second half: replace the values of the map.

    A map of few bytes is broadcast.  For a larger one the join is split: values that hold ``HOT_SHARE`` of a column
    are replaced (or kept) through a broadcast of these few, all others through a shuffle.  Rows that are
    settled, or have no value, are dealt evenly in it, as their key matches nothing."""
    hot = None if small else materialize(frequent_values(df, columns, HOT_SHARE))
    for c in columns:
        source, target = _fresh(df, "from"), _fresh(df, "to")
        part = mapping.where(F.col("column_name") == c).select(F.col("value").alias(source), F.col("canonical").alias(target))
        if small:
            df = df.join(F.broadcast(part), col(c) == col(source), "left") \
                .withColumn(c, F.coalesce(col(target), col(c))).drop(source, target)
            continue
        value, kept, key = _fresh(df, "hot"), _fresh(df, "kept"), _fresh(df, "key")
        frequent = hot.where(F.col("column_name") == c).select(F.col("value").alias(value))
        frequent = frequent.join(part, col(value) == col(source), "left").select(value, F.coalesce(col(target), col(value)).alias(kept))
        df = df.join(F.broadcast(frequent), col(c) == col(value), "left").drop(value)
        spread = F.concat(F.lit("\0"), (F.monotonically_increasing_id() % 4096).cast("string"))
        df = df.withColumn(key, F.when(col(c).isNotNull() & col(kept).isNull(), col(c)).otherwise(spread))
        df = df.join(part, col(key) == col(source), "left") \
            .withColumn(c, F.coalesce(col(kept), col(target), col(c))).drop(source, target, kept, key)
    return df


def standardize_categories(df: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> tuple[DataFrame, dict[str, int]]:
    """Step 2: unify spellings that differ only by case; returns changed cells per column too.

    The map is written once and its bytes summed: they decide about broadcasting."""
    if not text_columns(df):
        return df, {}
    mapping = materialize(category_map(df))
    size = F.sum(F.octet_length("value") + F.octet_length("canonical") + 32)
    found = mapping.groupBy("column_name").agg(F.sum("n").alias("cells"), size.alias("bytes")).collect()
    small = sum(r["bytes"] for r in found) <= broadcast_bytes
    return apply_category_map(df, mapping, [r["column_name"] for r in found], small), \
        {r["column_name"]: r["cells"] for r in found}


def text_decisions(df: DataFrame) -> tuple[list[str], list[str]]:
    """Text columns that read as numbers, and text columns that read as dates."""
    if not text_columns(df):
        return [], []
    found = text_scan(df.select(*[col(c) for c in text_columns(df)])).select(
        "column_name", is_numeric_text().alias("number"), is_date_text().alias("date")).collect()
    numbers = [r["column_name"] for r in found if r["number"]]
    return numbers, [r["column_name"] for r in found if r["date"]]


def convert_numbers(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Step 3: number-like text columns to double."""
    columns = text_decisions(df)[0] if columns is None else columns
    return df.withColumns({c: to_number(col(c), wide=True) for c in columns}) if columns else df


def convert_dates(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Step 4: date-like text columns to timestamp."""
    columns = text_decisions(df)[1] if columns is None else columns
    return df.withColumns({c: to_datetime(col(c)) for c in columns}) if columns else df


def invalid_flags(df: DataFrame) -> dict[str, Column]:
    """Per numeric column: infinite, a missing code, or negative where that is impossible."""
    flags = {}
    for c in numeric_columns(df):
        v = as_double(df, c)
        flag = (F.abs(v) == float("inf")) | v.isin([float(s) for s in SENTINEL_NUMBERS])
        flags[c] = flag | (v < 0) if is_positive_domain(c) else flag
    return flags


def null_invalid_numbers(df: DataFrame) -> DataFrame:
    """Step 5: invalid numbers become NULL."""
    flags = invalid_flags(df)
    return df.withColumns({c: F.when(~flag, col(c)) for c, flag in flags.items()}) if flags else df


def constant_columns(df: DataFrame) -> list[str]:
    """Columns with at most one distinct value, found from their extremes without counting values."""
    names = groupable_columns(df)
    row = df.agg(*[F.coalesce(F.min(col(c)) == F.max(col(c)), F.lit(True)).alias(f"c{i}")
                   for i, c in enumerate(names)]).first()
    return [c for i, c in enumerate(names) if row[f"c{i}"]]


def sparse_columns(df: DataFrame, threshold: float = 0.5) -> list[str]:
    """Columns whose share of NULLs reaches the threshold."""
    row = df.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(col(c).isNull()).alias(f"c{i}")
                                                 for i, c in enumerate(df.columns)]).first()
    return [c for i, c in enumerate(df.columns) if row["n"] and row[f"c{i}"] / row["n"] >= threshold]


def drop_columns(df: DataFrame, names: list[str]) -> DataFrame:
    return df.select(*[col(c) for c in df.columns if c not in names])


def null_counts(df: DataFrame) -> dict[str, int]:
    return _count_per_column(df, {c: col(c).isNull() for c in df.columns})


def fill_numbers(df: DataFrame, strategy: str = "median", nulls: dict[str, int] | None = None) -> DataFrame:
    """Step 9: fill or drop missing numbers by ``median``, ``mean``, ``zero``, ``drop`` or ``none``."""
    nulls = null_counts(df) if nulls is None else nulls
    names = [c for c in numeric_columns(df) if nulls.get(c)]
    if not names or strategy == "none":
        return df
    if strategy == "drop":
        return df.where(reduce(lambda a, b: a & b, [col(c).isNotNull() for c in names]))
    fill = dict.fromkeys(names, 0.0)
    if strategy == "median":
        fill |= {c: q["v"] for c, q in collect_quantiles(df, names, {"v": 0.5}).items()}
    elif strategy == "mean":
        row = df.agg(*[F.avg(as_double(df, c)).alias(f"c{i}") for i, c in enumerate(names)]).first()
        fill |= {c: row[f"c{i}"] for i, c in enumerate(names) if row[f"c{i}"] is not None}
    return df.withColumns({c: _filled(df, c, fill[c]) for c in names})


def _filled(df: DataFrame, name: str, value: float) -> Column:
    """Missing cells filled without a detour of whole numbers through double: a fractional value makes the column decimal."""
    dtype, c = df.schema[name].dataType, col(name)
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return F.coalesce(c.cast("double"), F.lit(value))
    if isinstance(dtype, T.IntegralType) and not float(value).is_integer():
        return F.coalesce(c.cast("decimal(38,6)"), F.lit(value).cast("decimal(38,6)"))
    return F.coalesce(c, F.lit(value).cast(dtype))


def fill_others(df: DataFrame, strategy: str = "mode", nulls: dict[str, int] | None = None) -> DataFrame:
    """Step 10: fill or drop missing non-numeric cells by ``mode``, ``unknown``, ``drop`` or ``none``."""
    nulls = null_counts(df) if nulls is None else nulls
    names = [f.name for f in df.schema if not is_numeric(f.dataType) and nulls.get(f.name)
             and f.name in groupable_columns(df)]
    if not names or strategy == "none":
        return df
    if strategy == "drop":
        return df.where(reduce(lambda a, b: a & b, [col(c).isNotNull() for c in names]))
    fill = dict.fromkeys(names, "Unknown")
    if strategy == "mode":
        modes = value_counts(df, names).groupBy("column_name").agg(mode_of().alias("m")).collect()
        fill |= {r["column_name"]: r["m"] for r in modes}
    return df.withColumns({c: F.coalesce(col(c), F.lit(fill[c]).try_cast(df.schema[c].dataType)) for c in names})


def cap_limits(df: DataFrame) -> dict[str, tuple[float, float]]:
    """Fences at three interquartile ranges, for columns with twenty values and some spread."""
    found = collect_quantiles(normalize(df), numeric_columns(df), {"q1": 0.25, "q3": 0.75})
    return {c: (q["q1"] - 3.0 * (q["q3"] - q["q1"]), q["q3"] + 3.0 * (q["q3"] - q["q1"])) for c, q in found.items()
            if q["n_values"] >= 20 and q["q3"] > q["q1"]}


def cap_extremes(df: DataFrame, limits: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """Step 11: clip numbers to the fences, NULLs kept."""
    limits = cap_limits(df) if limits is None else limits
    return df.withColumns({c: clipped(df, c, low, high) for c, (low, high) in limits.items()}) if limits else df


def drop_duplicates(df: DataFrame) -> DataFrame:
    """Step 8: one of equal rows; maps and variants count by their content."""
    keys = {f"_key{i}": k for i, (f, k) in enumerate(zip(df.schema, key_columns(df))) if f.name not in groupable_columns(df)}
    return df.withColumns(keys).dropDuplicates([*groupable_columns(df), *keys]).drop(*keys) if keys else df.dropDuplicates()


def clean(df: DataFrame, operations: dict | None = None) -> CleanResult:
    """Run the chosen steps in order on a frame; the input is not changed.

    The frame is written once to shared storage after the duplicates are gone, because the
    fills and the cap read it several times."""
    spark = df.sparkSession
    options = DEFAULTS | (operations or {})
    cur = normalize(df)
    rows_before, columns_before = cur.count(), len(cur.columns)
    log: list[tuple[str, str, int]] = []
    dropped: list[str] = []

    def note(step: str, counts: dict[str, int]):
        log.extend((c, step, int(n)) for c, n in counts.items())

    if options["standardize_whitespace"]:
        note("strip_whitespace", _count_per_column(cur, padded_cells(cur)))
        cur = strip_whitespace(cur)
    if options["null_sentinels"]:
        note("null_sentinels", _count_per_column(cur, {c: is_missing_word(col(c)) for c in text_columns(cur)}))
        cur = null_missing_words(cur)
    if options["standardize_categorical"]:
        cur, changed = standardize_categories(cur)
        note("standardize_categories", changed)
    if options["convert_numeric_strings"] or options["convert_datetime_strings"]:
        numbers, dates = text_decisions(cur)
        if options["convert_numeric_strings"]:
            cur = convert_numbers(cur, numbers)
            note("convert_numbers", dict.fromkeys(numbers, rows_before))
            dates = [c for c in dates if c not in numbers]
        if options["convert_datetime_strings"]:
            cur = convert_dates(cur, dates)
            note("convert_dates", dict.fromkeys(dates, rows_before))
    if options["handle_invalid_numerical"]:
        note("null_invalid_numbers", _count_per_column(cur, invalid_flags(cur)))
        cur = null_invalid_numbers(cur)
    for wanted, find in (("drop_constant_columns", constant_columns),
                         ("drop_high_missing_columns",
                          lambda d: sparse_columns(d, options["high_missing_threshold"]))):
        if options[wanted]:
            names = find(cur)
            dropped += names
            cur = drop_columns(cur, names)
            note(wanted, dict.fromkeys(names, rows_before))
    cur = materialize(drop_duplicates(cur) if options["remove_duplicates"] else cur)
    rows_unique = cur.count()

    handled = 0
    for step, strategy, fill, mine in (
            ("fill_numbers", options["fill_numeric_missing"], fill_numbers, lambda d, c: is_numeric(d.schema[c].dataType)),
            ("fill_others", options["fill_categorical_missing"], fill_others,
             lambda d, c: not is_numeric(d.schema[c].dataType))):
        if strategy and strategy != "none":
            nulls = {c: n for c, n in null_counts(cur).items() if mine(cur, c)}
            note(step, nulls)
            handled += sum(nulls.values())
            cur = fill(cur, strategy, nulls)
    capped = {}
    if options["cap_outliers"]:
        limits = cap_limits(cur)
        capped = _count_per_column(cur, {c: (as_double(cur, c) < low) | (as_double(cur, c) > high)
                                         for c, (low, high) in limits.items()})
        note("cap_extremes", capped)
        cur = cap_extremes(cur, {c: limits[c] for c in capped})

    changed_steps = ("strip_whitespace", "standardize_categories", "null_invalid_numbers")
    rows_after = cur.count() if "drop" in (options["fill_numeric_missing"], options["fill_categorical_missing"]) \
        else rows_unique
    summary = [(rows_before, rows_after, columns_before, len(cur.columns),
                rows_before - rows_unique if options["remove_duplicates"] else 0, handled,
                sum(s in ("convert_numbers", "convert_dates") for _, s, _ in log),
                sum(n for _, s, n in log if s in changed_steps), sum(capped.values()), dropped)]
    return CleanResult(
        cur,
        spark.createDataFrame(summary, "rows_before long, rows_after long, columns_before long, columns_after long,"
                                       " duplicates_removed long, missing_values_handled long,"
                                       " columns_converted long, values_standardized long, outliers_capped long,"
                                       " columns_dropped array<string>"),
        spark.createDataFrame(log, "column_name string, step string, affected long"))
