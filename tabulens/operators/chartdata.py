"""The numbers behind charts: bins, five-number boxes, top categories with the rest, fitted lines,
time lines, cross tabulations, and the ranking of charts worth drawing."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from tabulens.functions.coerce import as_double, as_timestamp, col, normalize, percent, require_columns
from tabulens.operators import correlation, outliers, stats
from tabulens.operators.tools import aggregate_expr, aggregate_name, histogram
from tabulens.operators.types import role_map
from tabulens.plans.frequency import top_values, value_counts
from tabulens.plans.quantiles import column_quantiles, group_quantiles
from tabulens.plans.sampling import hash_sample

OTHER = "Other (Aggregated)"
BOX_POINTS, SCATTER_POINTS = 5000, 3000  # sample sizes unless asked otherwise
FIVE = {"min": 0.0, "q1": 0.25, "median": 0.5, "q3": 0.75, "max": 1.0}


def histogram_bins(df: DataFrame, column: str, bins: int | None = None) -> DataFrame:
    """Histogram with the given bins, or between 12 and 35 by the square root of the values."""
    if bins is None:
        n = df.agg(F.count(as_double(normalize(df), column))).first()[0]
        bins = min(35, max(12, math.isqrt(n)))
    return histogram(df, column, bins)


def histogram_marks(df: DataFrame, column: str) -> DataFrame:
    """Mean, median, valid and missing rows of a histogram."""
    q = column_quantiles(normalize(df), [column], {"median": 0.5}).select("median")
    return stats.moments(normalize(df), [column]).select(
        "column_name", "mean", q.scalar().alias("median"), "valid_count",
        (F.col("total_count") - F.col("valid_count")).alias("missing_count"))


def box_numbers(df: DataFrame, columns: list[str]) -> DataFrame:
    """Minimum, quartiles and maximum per column."""
    return column_quantiles(normalize(df), columns, FIVE)


def box_points(df: DataFrame, column: str, keys: list[str], size: int = BOX_POINTS) -> DataFrame:
    """A fixed sample of a column's values."""
    v = as_double(normalize(df), column)
    return hash_sample(normalize(df).select(*[col(k) for k in keys], v.alias("value")).where("value is not null"),
                       keys, size)


def grouped_box(df: DataFrame, category: str, column: str) -> DataFrame:
    """Five numbers per category."""
    df = normalize(df)
    rows = df.select(col(category).cast("string").alias("group"), as_double(df, column).alias("v")) \
        .where("group is not null and v is not null")
    return group_quantiles(rows, ["group"], "v", FIVE)


def top_and_other(df: DataFrame, column: str, top_n: int = 15, other: str = OTHER) -> DataFrame:
    """The most frequent values, the rest as one row, and shares at one decimal."""
    counts = value_counts(normalize(df), [column])
    top = top_values(counts, top_n).select(F.col("rank"), F.col("value").alias("category"), F.col("n").alias("count"))
    totals = counts.agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("values"))
    rest = top.agg(F.sum("count").alias("shown")).select(
        F.lit(top_n + 1).alias("rank"), F.lit(other).alias("category"),
        (totals.select("total").scalar() - F.col("shown")).alias("count")).where("count > 0")
    return top.unionByName(rest).withColumn(
        "percentage", percent(F.col("count"), totals.select("total").scalar(), 1))


def category_share(df: DataFrame, column: str, top_n: int = 10) -> DataFrame:
    return top_and_other(df, column, top_n)


def relabel_others(df: DataFrame, column: str, top_n: int, other: str = "Other") -> DataFrame:
    """Rows with every value outside the ``top_n`` most frequent replaced by one label."""
    top = top_values(value_counts(df, [column]), top_n).select(F.col("value").alias("_top"))
    text = col(column).cast("string")
    return df.join(F.broadcast(top), text == F.col("_top"), "left") \
        .withColumn(column, F.when(text.isNotNull(), F.coalesce("_top", F.lit(other)))).drop("_top")


def grouped_bar(df: DataFrame, category: str, metric: str, agg: str = "mean", top_n: int = 15) -> DataFrame:
    """One aggregate per category, the best ``top_n`` kept and all other rows aggregated together."""
    kind = aggregate_name(agg, "mean")
    df = normalize(df)
    rows = df.select(col(category).cast("string").alias("category"), as_double(df, metric).alias("v")) \
        .where("category is not null and v is not null")

    def grouped(frame):
        if kind == "median":
            return group_quantiles(frame, ["category"], "v", {"value": 0.5}).select("category", "value")
        value = F.count("v") if kind == "count" else aggregate_expr(kind, F.col("v"))
        return frame.groupBy("category").agg(value.cast("double").alias("value"))

    order = [F.desc_nulls_last("value"), F.asc("category")]
    top = grouped(rows).orderBy(*order).limit(top_n)
    kept = top.select("category", "value", F.lit(False).alias("is_other"))
    rest = rows.join(F.broadcast(top.select("category")), "category", "left_anti")
    others = grouped(rest.withColumn("category", F.lit(OTHER))).select("category", "value", F.lit(True).alias("is_other"))
    return kept.unionByName(others)


def scatter_fit(df: DataFrame, x: str, y: str) -> DataFrame:
    """Complete pairs, r, and the least-squares line where it is defined."""
    df = normalize(df)
    a, b = as_double(df, x), as_double(df, y)
    pairs = df.select(a.alias("x"), b.alias("y")).where("x is not null and y is not null")
    s = pairs.agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("x_min"), F.max("x").alias("x_max"),
                  F.avg("x").alias("mx"), F.avg("y").alias("my"), F.regr_sxx("y", "x").alias("sxx"),
                  F.regr_syy("y", "x").alias("syy"), F.regr_sxy("y", "x").alias("sxy"))
    line = (F.col("n") >= 5) & (F.col("sxx") > 0)
    return s.select("n", "x_min", "x_max",
                    F.try_divide("sxy", F.sqrt("sxx") * F.sqrt("syy")).alias("r"),
                    F.when(line, F.try_divide("sxy", "sxx")).alias("slope"), "mx", "my") \
        .withColumn("intercept", F.col("my") - F.col("slope") * F.col("mx")).drop("mx", "my")


def scatter_line(df: DataFrame, x: str, y: str, points: int = 50) -> DataFrame:
    """The fitted line at evenly spaced positions."""
    i = F.explode(F.sequence(F.lit(0), F.lit(points - 1)))
    at = F.col("x_min") + F.col("i") * (F.col("x_max") - F.col("x_min")) / (points - 1)
    return scatter_fit(df, x, y).where("slope is not null").select("*", i.alias("i")).withColumn("x", at) \
        .select("i", "x", (F.col("intercept") + F.col("slope") * F.col("x")).alias("y"))


def scatter_points(df: DataFrame, x: str, y: str, keys: list[str], color: str | None = None,
                   size: int = SCATTER_POINTS) -> DataFrame:
    """A fixed sample of complete pairs, of all colours."""
    df = normalize(df)
    chosen = df.select(*[col(k) for k in keys], as_double(df, x).alias("x"), as_double(df, y).alias("y"),
                       *([col(color).cast("string").alias("color")] if color else [])).dropna(subset=["x", "y"])
    if color:
        chosen = chosen.where("color is not null")
    return hash_sample(chosen, keys, size)


def line_points(df: DataFrame, date: str, metric: str, agg: str = "mean", raw: bool = False) -> DataFrame:
    """One value per day, or with ``raw`` every point with its moment."""
    df = normalize(df)
    rows = df.select(as_timestamp(df, date).alias("ts"), as_double(df, metric).alias("v")) \
        .where("ts is not null and v is not null")
    if raw:
        return rows.select(F.col("ts").cast("string").alias("period"), F.col("v").alias("value"))
    value = F.sum("v") if agg.lower() == "sum" else F.avg("v")
    return rows.groupBy(F.to_date("ts").cast("string").alias("period")).agg(value.alias("value"))


def time_category(df: DataFrame, date: str, category: str, top_n: int = 6) -> DataFrame:
    """Counts by period and category in long form, absent combinations as 0.

    Months when the span exceeds 180 days, else days; periods without any row stay out."""
    df = normalize(df)
    rows = df.select(as_timestamp(df, date).alias("ts"), col(category).cast("string").alias("category")) \
        .where("ts is not null and category is not null")
    days = stats.datetime_spans(rows, ["ts"]).first()["date_range_days"]
    period = F.date_format("ts", "yyyy-MM" if days > 180 else "yyyy-MM-dd")
    counts = relabel_others(rows, "category", top_n).groupBy(period.alias("period"), "category") \
        .agg(F.count(F.lit(1)).alias("n"))
    names = counts.agg(F.array_sort(F.collect_set("category")))
    held = counts.groupBy("period").agg(F.map_from_entries(F.collect_list(F.struct("category", "n"))).alias("held"))
    return held.select("period", "held", F.explode(names.scalar()).alias("category")) \
        .select("period", "category", F.coalesce(F.element_at("held", F.col("category")), F.lit(0)).alias("count"))


def time_category_table(df: DataFrame, date: str, category: str, top_n: int = 6) -> DataFrame:
    """The same as one row per period and one column per category."""
    return time_category(df, date, category, top_n).groupBy("period").pivot("category").agg(F.first("count"))


def pie_aggregate(df: DataFrame, category: str, metric: str, agg: str = "sum") -> DataFrame:
    """Sum or mean per category."""
    df = normalize(df)
    value = F.sum("v") if agg == "sum" else F.avg("v")
    return df.select(col(category).cast("string").alias("category"), as_double(df, metric).alias("v")) \
        .where("category is not null and v is not null").groupBy("category").agg(value.alias("value"))


def plain_line(df: DataFrame, x: str, y: str, agg: str = "mean") -> DataFrame:
    """Sum, mean or median of y per value of an x that is no date."""
    df = normalize(df)
    rows = df.select(col(x).alias("x"), as_double(df, y).alias("v")).where("x is not null and v is not null")
    if agg == "median":
        return group_quantiles(rows, ["x"], "v", {"value": 0.5}).select("x", "value")
    return rows.groupBy("x").agg((F.sum("v") if agg == "sum" else F.avg("v")).alias("value"))


def custom_chart(df: DataFrame, kind: str, x: str, y: str | None = None, color: str | None = None,
                 agg: str = "none", keys: list[str] = ()) -> DataFrame:
    """The data of a chart chosen by kind and columns."""
    require_columns(df, x, y, color, *keys)
    kind, agg = (kind or "bar").strip().lower(), (agg or "none").strip().lower()
    rows = df.dropna(subset=[c for c in (x, y) if c])
    if kind in ("histogram", "dist"):
        return histogram_bins(rows, x)
    if kind == "box":
        return grouped_box(rows, x, y) if y else box_numbers(rows, [x])
    if kind in ("pie", "donut"):
        return pie_aggregate(rows, x, y, "sum" if agg == "sum" else "mean") if y and agg != "none" \
            else category_share(rows, x)
    if kind == "scatter":
        return scatter_points(rows, x, y, list(keys) or [x, y], color)
    if kind in ("line", "area"):
        if role_map(rows.select(col(x)))["datetime"]:
            return line_points(rows, x, y, "sum" if agg == "sum" else "mean")
        if agg == "none":
            return rows.select(col(x).alias("x"), as_double(rows, y).alias("value"))
        return plain_line(rows, x, y, agg if agg in ("sum", "mean") else "median")
    return grouped_bar(rows, x, y, agg) if y else top_and_other(rows, x)


def heatmap_cells(df: DataFrame, columns: list[str]) -> DataFrame:
    return correlation.matrix_cells(df, columns)


def multi_box(df: DataFrame, columns: list[str]) -> DataFrame:
    """Five numbers of every column."""
    return box_numbers(df, columns)


def outlier_histogram(df: DataFrame, column: str, low: float, high: float, bins: int | None = None) -> DataFrame:
    """Histogram bins with the number of values outside the bounds in each."""
    df = normalize(df)
    found = histogram_bins(df, column, bins)
    limits = found.agg(F.max("bin").alias("last"), F.min("bin_start").alias("a"), F.max("bin_end").alias("b")).first()
    v, k = as_double(df, column), limits["last"] + 1
    outside = df.where((v < low) | (v > high)).groupBy(
        F.least(F.floor((v - limits["a"]) / ((limits["b"] - limits["a"]) / k)), F.lit(k - 1)).cast("int").alias("bin")) \
        .agg(F.count(F.lit(1)).alias("outliers"))
    return found.join(F.broadcast(outside), "bin", "left").withColumn("outliers", F.coalesce("outliers", F.lit(0)))


def _candidates(frame: DataFrame, kind: str, family: str, order: Column, columns: list[Column], score: Column,
                high: Column) -> DataFrame:
    return frame.select(F.lit(kind).alias("chart_type"), F.lit(family).alias("category"),
                        F.array(*columns).alias("columns_used"), F.round(score, 1).alias("score"),
                        high.alias("priority"), order.alias("sequence"))


def chart_candidates(df: DataFrame, roles: dict[str, list[str]] | None = None) -> DataFrame:
    """Every chart worth considering with its score; ``sequence`` breaks ties."""
    df = normalize(df)
    roles = role_map(df) if roles is None else roles
    numbers, dates = roles.get("numerical", []), roles.get("datetime", [])
    groups = roles.get("categorical", []) + roles.get("boolean", [])
    rows = df.agg(F.count(F.lit(1)))
    at = lambda names, c=F.col("column_name"): F.array_position(F.array(*[F.lit(n) for n in names]), c)
    level = lambda score, floor=80: F.when(score >= floor, "High").otherwise("Medium")
    parts = []
    if numbers:
        q = column_quantiles(df, numbers, {"q1": 0.25, "q3": 0.75}).drop("n_values")
        s = stats.moment_summary(df, numbers).join(q, "column_name").where("valid_count >= 3 and std > 0")
        full = F.col("valid_count") / F.col("total_count") * 10
        hist = 65 + F.least(F.lit(25.0), F.abs("skewness") * 10) + full
        box = 60 + F.when(F.col("q3") > F.col("q1"), 15).otherwise(0) + full
        parts += [_candidates(s, "histogram", "Distributions", at(numbers) * 2, [F.col("column_name")], hist, level(hist)),
                  _candidates(s, "box", "Distributions", at(numbers) * 2 + 1, [F.col("column_name")], box, level(box))]
    if groups:
        c = stats.category_summary(df, groups)
        size, top = F.col("num_categories"), F.col("mode_frequency") / F.nullif(F.col("valid_count"), F.lit(0))
        bar = 70 + F.when(size.between(2, 10), 15).otherwise(5) - F.when(top > 0.9, top * 10).otherwise(0)
        donut = 72 + F.when(size.between(2, 6), 15).otherwise(0)
        base = F.lit(10_000)
        parts += [_candidates(c.where(size.between(2, 30)), "bar", "Categorical", base + at(groups) * 2,
                              [F.col("column_name")], bar, level(bar)),
                  _candidates(c.where(size.between(2, 8)), "pie", "Categorical", base + at(groups) * 2 + 1,
                              [F.col("column_name")], donut.cast("double"), level(donut))]
    if len(numbers) > 1:
        p = correlation.correlation_pairs(df, numbers).where("sample_size >= 5")
        r = F.abs("correlation")
        score = 55 + r * 40
        place = F.lit(20_000) + at(numbers, F.col("variable_a")) * 1000 + at(numbers, F.col("variable_b"))
        parts.append(_candidates(p, "scatter", "Relationships", place, [F.col("variable_a"), F.col("variable_b")], score,
                                 F.when((r >= 0.5) | (score >= 80), "High").when(r >= 0.25, "Medium").otherwise("Low")))
    if dates or groups:
        both = [(d, n, "line", "Trends", 85.0, 4, 2_000_000) for d in dates for n in numbers] \
            + [(d, g, "bar", "Trends", 80.0, 8, 4_000_000) for d in dates for g in groups]
        if both:
            complete = df.agg(*[F.count_if(col(a).isNotNull() & col(b).isNotNull()).alias(f"p{i}")
                                for i, (a, b, *_rest) in enumerate(both)])
            pairs = complete.select(F.inline(F.array(*[
                F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(kind).alias("kind"), F.lit(score).alias("score"),
                         F.lit(least).alias("least"), F.col(f"p{i}").alias("n"), F.lit(start + i).alias("sequence"))
                for i, (a, b, kind, _f, score, least, start) in enumerate(both)]))).where("n >= least")
            if groups:
                few = stats.category_summary(df, groups).where(F.col("num_categories").between(2, 8)) \
                    .select(F.col("column_name").alias("b"), F.lit(True).alias("few"))
                pairs = pairs.join(F.broadcast(few), "b", "left").where((F.col("kind") == "line") | F.col("few"))
            parts.append(pairs.select(F.col("kind").alias("chart_type"), F.lit("Trends").alias("category"),
                                      F.array("a", "b").alias("columns_used"), "score", F.lit("High").alias("priority"),
                                      "sequence"))
    if groups and numbers:
        sized = stats.category_summary(df, groups).where(F.col("num_categories").between(2, 20)) \
            .select("column_name", "num_categories")
        cells = df.select(*[as_double(df, n).alias(f"v{i}") for i, n in enumerate(numbers)], F.inline(F.array(*[
            F.struct(F.lit(g).alias("column_name"), col(g).cast("string").alias("value")) for g in groups]))) \
            .where("value is not null").join(F.broadcast(sized), "column_name") \
            .groupBy("column_name", "num_categories", "value").agg(*[x for i in range(len(numbers)) for x in (
                F.avg(f"v{i}").alias(f"m{i}"), F.count(f"v{i}").alias(f"n{i}"))])
        spread = cells.groupBy("column_name", "num_categories").agg(*[x for i in range(len(numbers)) for x in (
            F.stddev_samp(f"m{i}").alias(f"s{i}"), F.sum(f"n{i}").alias(f"n{i}"))]) \
            .select("column_name", "num_categories", F.inline(F.array(*[
                F.struct(F.lit(n).alias("number"), F.col(f"s{i}").alias("s"), F.col(f"n{i}").alias("n"))
                for i, n in enumerate(numbers)]))).where("n >= 5")
        score = 75 + F.when(F.col("s") > 0, 10).otherwise(0) \
            + F.when(F.col("num_categories").between(3, 10), 5).otherwise(0)
        place = F.lit(3_000_000) + at(groups) * 1000 + at(numbers, F.col("number"))
        parts.append(_candidates(spread, "bar", "Categorical", place, [F.col("column_name"), F.col("number")],
                                 score.cast("double"), level(score, 82)))
    schema = "chart_type string, category string, columns_used array<string>, score double, priority string," \
             " sequence long"
    found = df.sparkSession.createDataFrame([], schema)
    for part in parts:
        found = found.unionByName(part.withColumn("sequence", F.col("sequence").cast("long")))
    return found.where(rows.scalar() > 0)


def chart_ranking(df: DataFrame, roles: dict[str, list[str]] | None = None, limit: int | None = 10,
                  category: str | None = None) -> DataFrame:
    """The best charts: at most two per set of columns, and four per type when there is a choice.

    A set of columns never yields more than two candidates, so ranking by set first and by type
    second gives the same picks as taking candidates one by one."""
    found = chart_candidates(df, roles)
    if category:
        found = found.where(F.lower("category") == category.lower())
    best = [F.desc("score"), F.asc("sequence")]
    total = found.agg(F.count(F.lit(1)))
    per_set = Window.partitionBy(F.array_sort("columns_used")).orderBy(*best)
    per_type = Window.partitionBy("chart_type").orderBy(*best)
    kept = found.withColumn("_set", F.row_number().over(per_set)).where("_set <= 2").drop("_set") \
        .withColumn("_type", F.row_number().over(per_type)) \
        .where(F.lit(True) if limit is None else (F.col("_type") <= 4) | (total.scalar() <= limit)).drop("_type")
    top = kept if limit is None else kept.orderBy(*best).limit(limit)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*best))).drop("sequence")


def flagged_points(df: DataFrame, column: str, id_cols: list[str]) -> DataFrame:
    """Outlying values of a column with their keys, to be drawn over its histogram."""
    return outliers.outlier_records(df, [column], id_cols=id_cols)
