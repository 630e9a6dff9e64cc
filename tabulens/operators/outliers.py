"""Outliers by Tukey fences, z-score and median absolute deviation: summaries, records,
error labels and remediation.

Each method reduces a column to a pair of bounds; the bounds, a few numbers per column, go into
the following plan as literals, so flagging rows needs no join."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tabulens.functions import formulas
from tabulens.functions.coerce import as_double, clipped, col, is_numeric, normalize, percent
from tabulens.operators.stats import per_column
from tabulens.operators.types import outlier_columns
from tabulens.plans.quantiles import collect_quantiles

# Name fragments of domains, and codes that stand for a missing number.
NON_NEGATIVE_NAMES = [
    "age", "price", "cost", "salary", "wage", "income", "amount", "revenue",
    "quantity", "qty", "count", "units", "items", "tenure", "experience",
    "duration", "distance", "height", "weight", "length", "width", "depth",
    "speed", "rate_per", "orders", "visits", "clicks", "impressions",
]
PERCENT_NAMES = ["pct", "percent", "percentage", "discount_pct", "tax_rate", "rate_pct"]
SENTINELS = [-999, -9999, -99, -1, 999, 9999, 99999, 999999]

DEFAULT_PARAM = {"iqr": 1.5, "zscore": 3.0, "modified_zscore": 3.5}
MAD_SCALE = 0.6745
ERROR, POTENTIAL = "Confirmed Data Error", "Potential Outlier"


def method_name(method: str) -> str:
    name = str(method).lower().strip()
    return name if name in DEFAULT_PARAM else "iqr"


def is_error(value: Column, name: str, column_max: float) -> Column:
    """Whether an outlying value is impossible for its column, by code, domain or name."""
    low = name.lower()
    rules = [F.bround(value, 0).isin([float(s) for s in SENTINELS]), F.abs(value) == float("inf")]
    if any(f in low for f in NON_NEGATIVE_NAMES):
        rules.append(value < 0)
    if any(f in low for f in PERCENT_NAMES):
        rules.append((value < 0) | (value > (100 if column_max > 1.0 else 1)))
    if "age" in low:
        rules.append((value > 125) | (value < 0))
    if "month" in low:
        rules.append((value < 1) | (value > 12))
    if "hour" in low:
        rules.append((value < 0) | (value > 24))
    return F.coalesce(reduce(lambda a, b: a | b, rules), F.lit(False))


def _finite(*values) -> bool:
    return all(v is not None and not math.isnan(v) for v in values)


def bounds(df: DataFrame, columns: list[str], method: str = "iqr", param: float | None = None) -> dict[str, dict]:
    """Bounds and supporting numbers per column; ``lower`` is None where the method finds nothing."""
    method = method_name(method)
    param = DEFAULT_PARAM[method] if param is None else param
    df = normalize(df)
    found: dict[str, dict] = {c: {"n": 0, "lower": None, "upper": None, "status": "No Data"} for c in columns}
    if method == "zscore":
        measures = {"n": "count({0})", "center": "avg({0})", "scale": "stddev_samp({0})", "min": "min({0})",
                    "max": "max({0})", "g1": "skewness({0})"}
        rows = per_column(df, columns, measures).selectExpr("*", f"{formulas.adjusted_skewness('n', 'g1')} AS skew")
        for row in rows.collect():
            c, s = row["column_name"], {m: row[m] for m in ("n", "center", "scale", "min", "max", "skew")}
            if s["n"]:
                flat = not _finite(s["scale"]) or s["scale"] == 0 or s["min"] == s["max"]
                s |= {"lower": None, "upper": None, "status": "Constant Feature"} if flat else {
                    "lower": s["center"] - param * s["scale"], "upper": s["center"] + param * s["scale"],
                    "status": None}
                found[c] = s
        return found
    probs = {"min": 0.0, "q1": 0.25, "median": 0.5, "q3": 0.75, "max": 1.0}
    quantiles = collect_quantiles(df, columns, probs)
    deviations: dict[str, dict] = {}
    if method == "modified_zscore" and quantiles:
        medians = {c: q["median"] for c, q in quantiles.items()}
        centred = df.select(*[F.abs(as_double(df, c) - F.lit(medians[c])).alias(c) for c in medians])
        deviations = collect_quantiles(centred, list(medians), {"mad": 0.5})
    for c, q in quantiles.items():
        s = {k: q[k] for k in probs} | {"n": q["n_values"], "iqr": q["q3"] - q["q1"], "lower": None, "upper": None,
                                        "status": None}
        if method == "iqr":
            s["lower"], s["upper"] = q["q1"] - param * s["iqr"], q["q3"] + param * s["iqr"]
        else:
            s["mad"] = deviations.get(c, {}).get("mad")
            if _finite(s["mad"]) and s["mad"] > 0:
                delta = param * s["mad"] / MAD_SCALE
                s["lower"], s["upper"] = q["median"] - delta, q["median"] + delta
            else:
                s["status"] = "Zero MAD"
        if s["lower"] is not None and not _finite(s["lower"], s["upper"]):
            s["lower"] = s["upper"] = None
        found[c] = s
    return found


def score(value: Column, s: dict, method: str) -> Column:
    """The number compared with the threshold: z, modified z, or NULL for fences."""
    if method == "zscore" and s["lower"] is not None:
        return (value - F.lit(s["center"])) / F.lit(s["scale"])
    if method == "modified_zscore" and s["lower"] is not None:
        return F.lit(MAD_SCALE) * F.abs(value - F.lit(s["median"])) / F.lit(s["mad"])
    return F.lit(None).cast("double")


def is_outlier(value: Column, s: dict, method: str, param: float) -> Column:
    if s["lower"] is None:
        return F.lit(False)
    if method == "iqr":
        flag = (value < F.lit(s["lower"])) | (value > F.lit(s["upper"]))
    else:
        flag = F.abs(score(value, s, method)) > param
    return F.coalesce(flag, F.lit(False))


def warnings(s: dict, method: str) -> list[str]:
    """Short warning codes for a column's bounds."""
    codes = []
    if s["n"] == 0:
        return ["no_data"]
    if s["n"] < (30 if method == "zscore" else 10):
        codes.append("small_sample")
    if method in ("iqr", "zscore") and (s["min"] == s["max"] or s["status"] == "Constant Feature"):
        codes.append("zero_variance")
    if method == "iqr" and s["iqr"] == 0 and s["min"] != s["max"]:
        codes.append("zero_iqr")
    if method == "modified_zscore" and s["status"] == "Zero MAD":
        codes.append("zero_mad")
    if method == "zscore" and _finite(s.get("skew")) and abs(s["skew"]) > 1.0:
        codes.append("high_skewness")
    return codes


class _Flags:
    """Literal bounds of one call, and the flag expressions made from them."""

    def __init__(self, df, columns, method, param):
        self.method = method_name(method)
        self.param = DEFAULT_PARAM[self.method] if param is None else param
        self.df = normalize(df)
        self.columns = outlier_columns(self.df) if columns is None else columns
        self.bounds = bounds(self.df, self.columns, self.method, self.param)

    def value(self, c: str) -> Column:
        return as_double(self.df, c)

    def outlier(self, c: str) -> Column:
        return is_outlier(self.value(c), self.bounds[c], self.method, self.param)

    def error(self, c: str) -> Column:
        return self.outlier(c) & is_error(self.value(c), c, self.bounds[c].get("max") or 0.0)

    def any(self, kind) -> Column:
        return reduce(lambda a, b: a | b, [kind(c) for c in self.columns], F.lit(False))


SUMMARY_SCHEMA = ("column_name string, method string, total_observations long, valid_observations long, outlier_count long,"
                  " lower_threshold double, upper_threshold double, confirmed_error_count long, warnings array<string>,"
                  " outlier_percentage double, potential_outlier_count long, status string")
RECORD_FIELDS = [("column_name", "string"), ("value", "double"), ("lower_threshold", "double"), ("upper_threshold", "double"),
                 ("direction", "string"), ("deviation", "double"), ("score", "double"), ("is_data_error", "boolean"),
                 ("classification", "string")]


def outlier_summary(df: DataFrame, columns: list[str] | None = None, method: str = "iqr",
                    param: float | None = None) -> DataFrame:
    """One row per column: bounds, outliers, impossible values, warnings and status."""
    f = _Flags(df, columns, method, param)
    if not f.columns:
        return f.df.sparkSession.createDataFrame([], SUMMARY_SCHEMA)
    wide = f.df.agg(F.count(F.lit(1)).alias("total"),
                    *[F.count_if(f.outlier(c)).alias(f"o{i}") for i, c in enumerate(f.columns)],
                    *[F.count_if(f.error(c)).alias(f"e{i}") for i, c in enumerate(f.columns)])
    rows = []
    for i, c in enumerate(f.columns):
        b = f.bounds[c]
        level = b["lower"], b["upper"]
        if b["status"] in ("Constant Feature", "Zero MAD"):
            center = b.get("center", b.get("median"))
            level = center, center
        rows.append(F.struct(
            F.lit(c).alias("column_name"), F.lit(f.method).alias("method"), F.col("total").alias("total_observations"),
            F.lit(b["n"]).cast("long").alias("valid_observations"), F.col(f"o{i}").alias("outlier_count"),
            F.lit(level[0]).cast("double").alias("lower_threshold"),
            F.lit(level[1]).cast("double").alias("upper_threshold"),
            F.col(f"e{i}").alias("confirmed_error_count"), F.lit(b["status"]).cast("string").alias("_status"),
            F.array(*[F.lit(w) for w in warnings(b, f.method)]).cast("array<string>").alias("warnings")))
    found = wide.select(F.inline(F.array(*rows)))
    share = percent(F.col("outlier_count"), F.col("valid_observations"))
    high = F.lit(f.method != "modified_zscore") & (F.col("outlier_percentage") > 5.0)
    status = (F.when(F.col("_status").isNotNull(), F.col("_status"))
              .when(F.col("outlier_count") == 0, "Clean")
              .when(F.col("confirmed_error_count") > 0, "Data Errors Detected")
              .when(high, "High Outliers").otherwise("Moderate Outliers"))
    return found.withColumn("outlier_percentage", share) \
        .withColumn("potential_outlier_count", F.col("outlier_count") - F.col("confirmed_error_count")) \
        .withColumn("status", status).drop("_status").orderBy(F.desc("outlier_count"), "column_name")


def outlier_records(df: DataFrame, columns: list[str] | None = None, method: str = "iqr",
                    param: float | None = None, id_cols: list[str] = ()) -> DataFrame:
    """One row per outlying value with bounds, direction, distance, score and label."""
    f = _Flags(df, columns, method, param)
    parts = []
    for c in f.columns:
        b = f.bounds[c]
        if b["lower"] is None:
            continue
        v = f.value(c)
        below = v < F.lit(b["lower"])
        parts.append(F.when(f.outlier(c), F.struct(
            F.lit(c).alias("column_name"), v.alias("value"), F.lit(b["lower"]).alias("lower_threshold"),
            F.lit(b["upper"]).alias("upper_threshold"),
            F.when(below, "below_lower").otherwise("above_upper").alias("direction"),
            F.abs(v - F.when(below, b["lower"]).otherwise(b["upper"])).alias("deviation"),
            score(v, b, f.method).alias("score"), f.error(c).alias("is_data_error"))))
    keys = [col(k) for k in id_cols]
    if not parts:
        none = [F.lit(None).cast(kind).alias(name) for name, kind in RECORD_FIELDS]
        return f.df.select(*keys, *none).where("false")
    return f.df.where(f.any(f.outlier)).select(*keys, F.inline(F.array_compact(F.array(*parts)))) \
        .withColumn("classification", F.when(F.col("is_data_error"), ERROR).otherwise(POTENTIAL))


def outlier_totals(df: DataFrame, columns: list[str] | None = None, method: str = "iqr",
                   param: float | None = None) -> DataFrame:
    """Dataset totals, with the rows that hold an outlier in any column counted once."""
    f = _Flags(df, columns, method, param)
    instances = reduce(lambda a, b: a + b, [f.outlier(c).cast("long") for c in f.columns], F.lit(0).cast("long"))
    errors = reduce(lambda a, b: a + b, [f.error(c).cast("long") for c in f.columns], F.lit(0).cast("long"))
    touched = reduce(lambda a, b: a + b,
                     [F.coalesce(F.max(f.outlier(c).cast("long")), F.lit(0)) for c in f.columns], F.lit(0))
    return f.df.agg(
        F.count(F.lit(1)).alias("total_rows"), F.count_if(f.any(f.outlier)).alias("affected_rows_count"),
        F.coalesce(F.sum(instances), F.lit(0)).alias("total_outlier_instances"),
        F.coalesce(F.sum(errors), F.lit(0)).alias("total_confirmed_errors"),
        touched.cast("long").alias("columns_with_outliers")) \
        .withColumn("total_potential_outliers", F.col("total_outlier_instances") - F.col("total_confirmed_errors")) \
        .withColumn("affected_rows_percentage", percent(F.col("affected_rows_count"), F.col("total_rows")))


def critical_columns(df: DataFrame, columns: list[str] | None = None, share: float = 3.0) -> DataFrame:
    """Columns whose outliers reach the given percentage."""
    return outlier_summary(df, columns).where(F.col("outlier_percentage") >= share).select(
        "column_name", "outlier_count", "outlier_percentage", "lower_threshold", "upper_threshold")


def _capped(f: _Flags) -> dict[str, tuple[float, float]]:
    """Numeric columns to clip, with their bounds at four decimals."""
    limits = {}
    for c in f.columns:
        b = f.bounds[c]
        low, high = b["lower"], b["upper"]
        if b["status"] in ("Constant Feature", "Zero MAD"):
            continue  # no spread to measure by: nothing is reported as an outlier, so nothing is changed
        if _finite(low, high) and is_numeric(f.df.schema[c].dataType):
            limits[c] = round(low, 4), round(high, 4)
    return limits


def remediate(df: DataFrame, action: str = "remove", columns: list[str] | None = None, method: str = "iqr",
              param: float | None = None) -> DataFrame:
    """``remove`` outlier rows, ``remove_errors_only``, or ``cap`` values to the bounds.  NULLs stay."""
    f = _Flags(df, columns, method, param)
    if action == "remove":
        return f.df.where(~f.any(f.outlier))
    if action == "remove_errors_only":
        return f.df.where(~f.any(f.error))
    if action != "cap":
        return f.df
    limits = _capped(f)
    return f.df.withColumns({c: clipped(f.df, c, low, high) for c, (low, high) in limits.items()}) if limits else f.df


def remediation_summary(df: DataFrame, action: str = "remove", columns: list[str] | None = None,
                        method: str = "iqr", param: float | None = None) -> DataFrame:
    """Rows before, after and dropped, and values capped, in one scan."""
    f = _Flags(df, columns, method, param)
    drop = {"remove": f.any(f.outlier), "remove_errors_only": f.any(f.error)}.get(action, F.lit(False))
    capped = F.lit(0).cast("long")
    if action == "cap":
        for c, (low, high) in _capped(f).items():
            capped = capped + F.coalesce(((f.value(c) < low) | (f.value(c) > high)).cast("long"), F.lit(0))
    return f.df.agg(F.lit(action).alias("action"), F.count(F.lit(1)).alias("rows_before"),
                    F.count_if(drop).alias("rows_dropped"), F.coalesce(F.sum(capped), F.lit(0)).alias("values_capped")) \
        .withColumn("rows_after", F.col("rows_before") - F.col("rows_dropped"))
