"""Data-quality detectors and the audit that unites them.

Text rules share one scan of sums over the rows; case variants are counted by digests and dominant values by a
sketch with an exact recount, so that no text is shuffled.  Numeric rules share one scan, plus the quartiles for the
extreme-value rule."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from tabulens.functions.coerce import (DATE_LIKE_NUMBER, DATE_SEPARATORS, FEW_WORDS, NO_NUMBER, col, double_sql,
                                       groupable_columns, is_missing_word, normalize, numeric_columns, percent, strip,
                                       text_columns, text_literal, title_case, to_datetime, to_number)
from tabulens.operators.profile import duplicate_rows
from tabulens.plans.digests import SECOND_SEED
from tabulens.plans.frequency import mode_of, number_kind, own_number_sql, value_counts
from tabulens.plans.quantiles import collect_quantiles
from tabulens.plans.sketches import FEW_VALUES, column_sizes, frequent_values, text_values

# Codes that stand for a missing number, and names of columns that cannot be negative.
SENTINEL_NUMBERS = [-999, -9999, 9999, 99999]
POSITIVE_NAMES = ["age", "price", "cost", "salary", "income", "quantity", "count", "revenue",
                  "amount", "spend", "rate", "distance", "height", "weight", "duration"]

DOMINANT_SHARE = 0.9
EXACT_WHOLE = 2.0 ** 53
WHOLE = "(Entire Dataset)"
SEVERITIES = ["Critical", "High", "Medium", "Low"]
FIELDS = ["column_name", "issue_type", "affected_rows", "percentage_affected", "severity", "action", "details"]


def is_positive_domain(name: str) -> bool:
    return any(part in name.lower() for part in POSITIVE_NAMES)


def _issue(when: Column, kind: str, affected: Column, share: Column, severity, action: str | Column,
           details: dict[str, Column] | None = None) -> Column:
    """One issue as a struct, NULL where its rule does not hold."""
    note = F.to_json(F.struct(*[c.alias(k) for k, c in details.items()])) if details else F.lit("{}")
    severity, action = (F.lit(x) if isinstance(x, str) else x for x in (severity, action))
    return F.when(when, F.struct(
        F.lit(kind).alias("issue_type"), affected.cast("long").alias("affected_rows"),
        share.alias("percentage_affected"), severity.alias("severity"), action.alias("action"),
        note.alias("details")))


def _listed(frame: DataFrame, *issues: Column) -> DataFrame:
    """The issues of a per-column frame, read in one pass whatever the number of rules."""
    return frame.select("column_name", F.inline(F.array_compact(F.array(*issues))))


class TextSizes:
    """What one scan tells of the columns that are no number, and the values of the text columns for further sums."""

    def __init__(self, df: DataFrame):
        self.df, self.texts = df, text_columns(df)
        numbers = numeric_columns(df)
        self.sizes = column_sizes(df, [c for c in groupable_columns(df) if c not in numbers])

    def values(self) -> DataFrame:
        partitions = next((r["partitions"] for r in self.sizes.values()), 1)
        return text_values(self.df, {c: self.sizes[c]["estimate"] for c in self.texts}, partitions)

    def base(self) -> DataFrame:
        return self.df.sparkSession.createDataFrame(
            [(c, c in self.texts, r["n_rows"], r["n_valid"], 0 if not r["n_valid"] else 1 if r["single"] else 2, r["only_value"], False)
             for c, r in self.sizes.items()], "column_name string, is_text boolean, n_rows long, n_valid long, n_distinct long,"
                                              " only_value string, is_number boolean")


def text_scan(df: DataFrame, sizes: TextSizes | None = None) -> DataFrame:
    """One row per column that is no number, with the sums over its cells that the rules need.

    ``n_distinct`` only tells none, one and more apart."""
    sizes = sizes or TextSizes(df)
    v, n = F.col("value"), F.col("n")
    flags = {"missing_words": is_missing_word(v), "padded": strip(v) != v,
             "numbers": F.when(~v.rlike(NO_NUMBER), to_number(v, wide=True).isNotNull()),
             "dates": F.when(v.rlike(FEW_WORDS), to_datetime(v).isNotNull())}
    some = {"separated": v.rlike(DATE_SEPARATORS), "date_like": v.rlike(DATE_LIKE_NUMBER)}
    sums = sizes.values().select("column_name", "n", *[c.alias(f) for f, c in (flags | some).items()]).groupBy("column_name").agg(
        *[F.sum(F.when(F.col(f), n).otherwise(0)).alias(f) for f in flags], *[F.bool_or(f).alias(f) for f in some])
    return F.broadcast(sizes.base()).join(sums, "column_name", "left").withColumns(
        {f: F.coalesce(F.col(f), F.lit(0)) for f in flags} | {f: F.coalesce(F.col(f), F.lit(False)) for f in some})


def spelling_variants(df: DataFrame, sizes: TextSizes | None = None) -> DataFrame:
    """``(column_name, variant_groups, variant_rows)``: forms of a text column with several spellings, and the rows that do
    not have the most frequent value of their form.

    Values, their stripped spellings and their lower-case forms are told by 128-bit digests, so long texts are not shuffled."""
    halves = lambda name, c: [F.xxhash64(c).alias(f"{name}1"), F.xxhash64(F.lit(SECOND_SEED), c).alias(f"{name}2")]
    bare = strip(F.col("value"))
    cells = (sizes or TextSizes(df)).values().select(
        "column_name", "n", (bare != "").alias("filled"), *halves("v", F.col("value")), *halves("b", bare), *halves("f", F.lower(bare)))
    values = cells.groupBy("column_name", "f1", "f2", "v1", "v2", "b1", "b2", "filled").agg(F.sum("n").alias("n"))
    forms = values.groupBy("column_name", "f1", "f2").agg(
        F.sum("n").alias("n"), F.max("n").alias("top"),
        (F.bool_or("filled") & (F.min(F.struct("b1", "b2")) != F.max(F.struct("b1", "b2")))).alias("varied"))
    return forms.groupBy("column_name").agg(
        F.count_if("varied").alias("variant_groups"), F.sum(F.when(F.col("varied"), F.col("n") - F.col("top")).otherwise(0)).alias("variant_rows"))


def dominant_values(df: DataFrame, sizes: TextSizes) -> DataFrame:
    """``(column_name, top_value, top_count)`` of columns in which one value holds ``DOMINANT_SHARE`` or more."""
    few = [c for c, r in sizes.sizes.items() if r["estimate"] <= FEW_VALUES]
    many = [c for c in sizes.sizes if c not in few]
    valid = df.sparkSession.createDataFrame([(c, r["n_valid"]) for c, r in sizes.sizes.items()], "column_name string, _valid long")
    parts = [value_counts(df, few)] if few else []
    if many:
        parts.append(frequent_values(df, many, DOMINANT_SHARE))
    return reduce(DataFrame.unionByName, parts).join(F.broadcast(valid), "column_name") \
        .where(F.col("n") >= F.col("_valid") * DOMINANT_SHARE) \
        .select("column_name", F.col("value").alias("top_value"), F.col("n").alias("top_count"))


def text_features(df: DataFrame, variants: bool = True, dominant: bool = True) -> DataFrame:
    """``text_scan`` with the dominant value of each column and its spelling variants, as far as they are asked for.

    Only a value that holds at least ``DOMINANT_SHARE`` of a column is given with its count; other columns have 0."""
    sizes = TextSizes(df)
    features = text_scan(df, sizes)
    if dominant and sizes.sizes:
        features = features.join(dominant_values(df, sizes), "column_name", "left")
    else:
        features = features.withColumns({"top_value": F.lit(None).cast("string"), "top_count": F.lit(0).cast("long")})
    if variants and sizes.texts:
        features = features.join(spelling_variants(df, sizes), "column_name", "left")
    else:
        features = features.withColumns({c: F.lit(0).cast("long") for c in ("variant_groups", "variant_rows")})
    return features.withColumn("top_value", F.coalesce("top_value", "only_value")).drop("only_value") \
        .withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in ("top_count", "variant_groups", "variant_rows")})


def number_features(df: DataFrame, columns: list[str] | None = None) -> DataFrame | None:
    """One row per numeric column; no value counts are shuffled for it.

    A value that holds 95 % of a column is its median, so the median (or an infinity) is the only
    candidate for the dominant value.  Quartiles are of the finite values."""
    columns = numeric_columns(df) if columns is None else columns
    if not columns:
        return None
    quartiles = collect_quantiles(df, columns, {"q1": 0.25, "mid": 0.5, "q3": 0.75}, finite_only=True)
    # whole numbers that doubles cannot tell apart: the dominant value in their own type
    wide_keys = [c for c, q in quartiles.items() if abs(q["mid"]) >= EXACT_WHOLE and number_kind(df, c) != "double"]
    big = dict.fromkeys(wide_keys, ("", 0)) | {r["column_name"]: (r["value"], r["n"]) for r in frequent_values(
        df, wide_keys, 0.9).collect()} if wide_keys else {}
    parts = []
    for c in columns:
        q, v = quartiles.get(c), double_sql(df, c)
        fence = q and q["n_values"] >= 20 and q["q3"] > q["q1"]
        low, high = (q["q1"] - 3.0 * (q["q3"] - q["q1"]), q["q3"] + 3.0 * (q["q3"] - q["q1"])) if fence else (0.0, 0.0)
        infinite = f"abs({v}) = double('Infinity')"
        parts.append({
            "n_valid": f"count({v})", "single": f"coalesce(min({own_number_sql(df, c)}) = max({own_number_sql(df, c)}), false)",
            "middle": f"{big[c][1]}L" if c in big else f"count_if({v} = {q['mid']!r}D)" if q else "0L", "infinite": f"count_if({infinite})",
            "codes": f"count_if({v} IN ({', '.join(f'{x}D' for x in SENTINEL_NUMBERS)}))",
            "negatives": f"count_if({v} < 0)" if is_positive_domain(c) else "0L",
            "extreme": f"count_if(NOT {infinite} AND ({v} < {low!r}D OR {v} > {high!r}D))" if fence else "0L",
            "top_value": f"'{big[c][0] if c in big else q['mid']}'" if q else "'inf'", "low_fence": f"{low!r}D", "high_fence": f"{high!r}D"})
    wide = df.selectExpr("count(1) AS n_rows", *[f"{sql} AS {m}_{i}" for i, part in enumerate(parts)
                                                 for m, sql in part.items()])
    rows = ", ".join("named_struct('column_name', {}, 'n_rows', n_rows, {})".format(
        text_literal(c), ", ".join(f"'{m}', {m}_{i}" for m in parts[0])) for i, c in enumerate(columns))
    flat = "CASE WHEN n_valid = 0 THEN 0L WHEN single THEN 1L ELSE 2L END AS n_distinct"
    return wide.selectExpr(f"inline(array({rows}))").selectExpr(
        "*", flat, "greatest(middle, infinite) AS top_count", "false AS is_text", "true AS is_number",
        "0L AS missing_words")


def audit_features(df: DataFrame) -> DataFrame:
    """Text and numeric features in one frame, numeric columns with no text counts.

    For a numeric column ``n_distinct`` only tells none, one and more apart."""
    df = normalize(df)
    numbers = number_features(df)
    features = text_features(df)
    return features if numbers is None else features.unionByName(numbers, allowMissingColumns=True)


def _varied() -> Column:
    """Later detectors skip empty and constant columns."""
    return F.col("n_distinct") > 1


def missing_rules() -> list[Column]:
    missing = F.col("n_rows") - F.col("n_valid") + F.col("missing_words")
    share = percent(missing, F.col("n_rows"))
    details = {"standard_nulls": F.col("n_rows") - F.col("n_valid"), "sentinel_nulls": F.col("missing_words")}
    severity = F.when(share >= 20.0, "High").when(share >= 5.0, "Medium").otherwise("Low")
    action = F.when(F.col("is_number"), "fill_median").otherwise("fill_mode")
    return [_issue(share > 40.0, "high_missing_percentage", missing, share, "Critical", "drop_column", details),
            _issue((share <= 40.0) & (missing > 0), "missing_values", missing, share, severity, action, details)]


def constant_rules() -> list[Column]:
    return [_issue(F.col("n_distinct") == 1, "constant_column", F.col("n_rows"), F.lit(100.0), "High", "drop_column",
                   {"constant_value": F.col("top_value")})]


def near_constant_rules() -> list[Column]:
    share = percent(F.col("top_count"), F.col("n_valid"))
    return [_issue(_varied() & (share >= 95.0), "near_constant_column", F.col("top_count"), share, "Low",
                   "review",
                   {"dominant_value": F.col("top_value"), "minority_rows": F.col("n_valid") - F.col("top_count")})]


def whitespace_rules() -> list[Column]:
    return [_issue(F.col("is_text") & _varied() & (F.col("padded") > 0), "leading_trailing_whitespace",
                   F.col("padded"), percent(F.col("padded"), F.col("n_rows")), "Low", "strip")]


def category_rules() -> list[Column]:
    rows = F.col("variant_rows")
    return [_issue(F.col("is_text") & _varied() & (rows > 0), "inconsistent_categorical", rows, percent(rows, F.col("n_rows")), "Medium",
                   "unify_spelling", {"groups": F.col("variant_groups")})]


def is_numeric_text() -> Column:
    """A text column of at least five cells that reads as numbers to 80 %, and never as date parts."""
    return F.col("is_text") & (F.col("n_valid") >= 5) & ~F.col("date_like") \
        & (F.try_divide("numbers", "n_valid") >= 0.8)


def is_date_text() -> Column:
    """A text column of at least five cells with date separators that parses as dates to 80 %."""
    return F.col("is_text") & (F.col("n_valid") >= 5) & F.col("separated") & (F.try_divide("dates", "n_valid") >= 0.8)


def numeric_text_rules() -> list[Column]:
    return [_issue(_varied() & is_numeric_text(), "potential_numeric_as_string",
                   F.col("numbers"), percent(F.col("numbers"), F.col("n_rows")), "High", "cast_number",
                   {"success_ratio": percent(F.col("numbers"), F.col("n_valid"))})]


def date_text_rules() -> list[Column]:
    return [_issue(_varied() & is_date_text(), "potential_datetime_as_string", F.col("dates"),
                   percent(F.col("dates"), F.col("n_rows")), "Medium", "cast_timestamp",
                   {"success_ratio": percent(F.col("dates"), F.col("n_valid"))})]


def mixed_type_rules() -> list[Column]:
    """Text columns where some cells read as numbers and some do not."""
    mixed = (F.col("numbers") > 0) & (F.col("numbers") < F.col("n_valid"))
    return [_issue(F.col("is_text") & _varied() & (F.col("n_valid") >= 10) & mixed, "inconsistent_data_types",
                   F.col("n_rows"), F.lit(100.0), "Medium", "separate_types",
                   {"numeric_cells": F.col("numbers"), "text_cells": F.col("n_valid") - F.col("numbers")})]


def invalid_number_rules() -> list[Column]:
    """Infinities, missing codes and impossible negatives; a value can count under two reasons."""
    total = F.col("infinite") + F.col("codes") + F.col("negatives")
    return [_issue(_varied() & (total > 0), "invalid_numerical_values", total,
                   percent(total, F.col("n_rows")), "High", "null_invalid",
                   {"inf_count": F.col("infinite"), "sentinel_count": F.col("codes"),
                    "negative_count": F.col("negatives")})]


def extreme_value_rules() -> list[Column]:
    """Finite values beyond three interquartile ranges, for twenty finite values and more."""
    return [_issue(_varied() & (F.col("extreme") > 0), "extreme_outliers",
                   F.col("extreme"), percent(F.col("extreme"), F.col("n_rows")), "Low", "cap",
                   {"lower_fence": F.round("low_fence", 2), "upper_fence": F.round("high_fence", 2)})]


SHARED_RULES = [missing_rules, constant_rules, near_constant_rules]
TEXT_RULES = [whitespace_rules, category_rules, numeric_text_rules, date_text_rules, mixed_type_rules]
NUMBER_RULES = [invalid_number_rules, extreme_value_rules]


def duplicate_issues(df: DataFrame) -> DataFrame:
    share = F.col("duplicate_rows_percentage")
    severity = F.when(share >= 5.0, "High").when(share >= 1.0, "Medium").otherwise("Low")
    return _listed(duplicate_rows(df).withColumn("column_name", F.lit(WHOLE)), _issue(
        F.col("duplicate_rows") > 0, "duplicate_rows", F.col("duplicate_rows"), share, severity,
        "drop_duplicates",
        {"duplicate_count": F.col("duplicate_rows"), "total_rows": F.col("total_rows")}))


def _no_issues(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([], "column_name string, issue_type string,"
                                               " affected_rows long, percentage_affected double, severity string,"
                                               " action string, details string")


def column_issues(df: DataFrame, rules: list | None = None) -> DataFrame:
    """Issues of single columns by the given rules, all of them by default."""
    df = normalize(df)
    chosen = lambda group: [i for r in group if rules is None or r in rules for i in r()]
    parts = []
    on_text, on_numbers = chosen(SHARED_RULES + TEXT_RULES), chosen(SHARED_RULES + NUMBER_RULES)
    wanted = lambda rule: rules is None or rule in rules
    if on_text:
        parts.append(_listed(text_features(df, wanted(category_rules), wanted(near_constant_rules)), *on_text))
    if on_numbers:
        numbers = number_features(df)
        if numbers is not None:
            parts.append(_listed(numbers, *on_numbers))
    return reduce(DataFrame.unionByName, parts, _no_issues(df))


def audit(df: DataFrame) -> DataFrame:
    """All issues of a table; nothing for an empty one."""
    return duplicate_issues(df).unionByName(column_issues(df)).where(F.col("affected_rows") > 0)


def severity_counts(issues: DataFrame) -> DataFrame:
    """Issues per severity, with the four levels always present."""
    levels = issues.sparkSession.createDataFrame([(s,) for s in SEVERITIES], "severity string")
    found = issues.groupBy("severity").agg(F.count(F.lit(1)).alias("n"))
    return levels.join(found, "severity", "left").select("severity", F.coalesce("n", F.lit(0)).alias("issue_count"))


def case_variants(counts: DataFrame) -> DataFrame:
    """``(column_name, value, canonical)`` for values whose spelling differs only by case.

    The canonical form is the title case of the most frequent spelling."""
    group = Window.partitionBy("column_name", F.lower("value"))
    best = group.orderBy(F.desc("n"), F.asc("value"))
    return counts.withColumn("spellings", F.count(F.lit(1)).over(group)) \
        .withColumn("canonical", title_case(strip(F.first("value").over(best)))) \
        .where((F.col("spellings") > 1) & (F.col("value") != F.col("canonical"))) \
        .select("column_name", "value", "n", "canonical", F.lower("value").alias("form"))


def _first_pairs(frame: DataFrame, k: int | None) -> DataFrame:
    if k is None:
        return frame
    order = Window.partitionBy("column_name").orderBy("original_value")
    return frame.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= k).drop("_rank")


def cleaning_preview(df: DataFrame, examples: int | None = None) -> DataFrame:
    """Before and after pairs of what the default cleaning would change: all, or ``examples`` per column and kind."""
    df = normalize(df)
    features = audit_features(df)
    decided = {r["column_name"]: r for r in features.select(
        "column_name", "is_text", "is_number", "n_rows", "n_valid", "n_distinct", "missing_words",
        is_numeric_text().alias("numeric_text"), is_date_text().alias("date_text")).collect()}
    live = [c for c, r in decided.items() if r["n_distinct"] > 1]
    texts = [c for c in live if decided[c]["is_text"]]
    parts = []

    def pairs(frame, category, rule):
        return frame.select("column_name", F.lit(category).alias("category"), F.col("original_value"),
                            F.col("cleaned_value").cast("string").alias("cleaned_value"), F.lit(rule).alias("rule"))

    if texts:
        counts = value_counts(df, texts)
        v = F.col("value")
        padded = counts.where(strip(v) != v).select("column_name", v.alias("original_value"),
                                                    strip(v).alias("cleaned_value"))
        parts.append(pairs(_first_pairs(padded, examples), "whitespace",
                           "strip"))
        stripped = counts.groupBy("column_name", strip(v).alias("value")).agg(F.sum("n").alias("n"))
        forms = _first_pairs(case_variants(stripped).select("column_name", F.col("value").alias("original_value"),
                                             F.col("canonical").alias("cleaned_value")), examples)
        parts.append(pairs(forms, "spelling", "title_case"))
        number = to_number(v, wide=True)
        for flag, value, category, rule in (
                ("numeric_text", number.cast("string"), "number",
                 "cast_number"),
                ("date_text", F.date_format(to_datetime(v), "yyyy-MM-dd HH:mm:ss"), "date",
                 "cast_timestamp")):
            names = [c for c in texts if decided[c][flag]]
            if flag == "date_text":
                short = F.regexp_replace(value, " 00:00:00$", "")
                value = short
            if names:
                changed = counts.where(F.col("column_name").isin(names)) \
                    .select("column_name", v.alias("original_value"), value.alias("cleaned_value")) \
                    .where(F.col("cleaned_value").isNotNull() & (F.col("cleaned_value") != F.col("original_value")))
                parts.append(pairs(_first_pairs(changed, examples), category, rule))
    share = {c: round((r["n_rows"] - r["n_valid"] + r["missing_words"]) / r["n_rows"] * 100, 2)
             for c, r in decided.items() if r["n_rows"]}
    filled = [c for c in decided if 0 < share.get(c, 0) <= 40.0]
    numbers = [c for c in filled if decided[c]["is_number"]]
    rows = [(c, "missing", "missing", str(round(q['median'], 2)),
             "fill_median")
            for c, q in collect_quantiles(df, numbers, {"median": 0.5}).items()]
    rows += [(c, "missing", "missing", "0.0", "fill_median")
             for c in numbers if c not in {r[0] for r in rows}]
    schema = "column_name string, category string, original_value string, cleaned_value string, rule string"
    if rows:
        parts.append(df.sparkSession.createDataFrame(rows, schema))
    others = [c for c in filled if not decided[c]["is_number"]]
    if others:
        modes = value_counts(df, others).groupBy("column_name").agg(mode_of().alias("m"))
        parts.append(modes.select("column_name", F.lit("missing").alias("category"),
                                  F.lit("missing").alias("original_value"),
                                  F.col("m").alias("cleaned_value"),
                                  F.lit("fill_mode").alias("rule")))
    invalid = column_issues(df, [invalid_number_rules])
    for key, shown, rule in (("sentinel_count", "code", "null_code"),
                             ("inf_count", "infinity", "null_infinity")):
        parts.append(invalid.where(F.get_json_object("details", f"$.{key}").cast("long") > 0).select(
            "column_name", F.lit("invalid").alias("category"), F.lit(shown).alias("original_value"),
            F.lit("median").alias("cleaned_value"), F.lit(rule).alias("rule")))
    return reduce(DataFrame.unionByName, parts)


def whitespace_examples(df: DataFrame, k: int = 3) -> DataFrame:
    """Up to ``k`` padded values per text column."""
    counts = value_counts(df, text_columns(df)).where(strip(F.col("value")) != F.col("value"))
    return _first_pairs(counts.select("column_name", F.col("value").alias("original_value")), k)
