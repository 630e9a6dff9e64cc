"""Scalar coercions shared by every operator: text to number, date or boolean,
NaN to NULL, whitespace and category forms.  All are plain ``Column`` expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F, types as T

# Words that stand for a missing cell.
MISSING_WORDS = ["", "na", "n/a", "null", "none", "nan", "nil", "?", "-", "--", "undefined", "#n/a", "#na"]

# Words read as true.
TRUE_WORDS = ["true", "1", "1.0", "yes", "y", "t"]

# Characters removed before a number is parsed.
NUMERIC_NOISE = r"[$,€£%\s]"
NUMERIC_NOISE_WIDE = r"[$,€£¥₹%\s]"

# A cell with one of these may be a date; a cell with the second shape is
# never offered to the numeric conversion.
DATE_SEPARATORS = r"[-/:\s,]"
DATE_LIKE_NUMBER = r"[-/]\d{2,4}"

# a text with a letter that no number holds is not tried as a number, one of more than four words not as a date
NO_NUMBER = "[a-dg-hj-mo-su-xzA-DG-HJ-MO-SU-XZ]"
FEW_WORDS = r"^\s*\S{1,40}(\s+\S{1,40}){0,3}\s*$"

WHITE_SPACE = " \t\n\x0b\f\r"

NUMBER_SHAPE = r"^[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?|(?i:inf|infinity))$"

# (shape, parse pattern): the shape test keeps each parser away from text it cannot read.
DATE_PATTERNS = [
    (r"^\d{4}-\d{1,2}-\d{1,2}$", ["yyyy-M-d"]),
    (r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{2}$", ["yyyy-M-d H:mm"]),
    (r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{2}:\d{2}(\.\d{1,6})?$", ["yyyy-M-d H:mm:ss[.SSSSSS]"]),
    (r"^\d{4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{2}:\d{2}(\.\d{1,6})?$", ["yyyy-M-d'T'H:mm:ss[.SSSSSS]"]),
    (r"^\d{4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{2}:\d{2}(Z|[+-]\d{2}:\d{2})$", ["yyyy-M-d'T'H:mm:ssXXX"]),
    (r"^\d{4}/\d{1,2}/\d{1,2}$", ["yyyy/M/d"]),
    (r"^\d{4}/\d{1,2}/\d{1,2} \d{1,2}:\d{2}:\d{2}$", ["yyyy/M/d H:mm:ss"]),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", ["M/d/yyyy", "d/M/yyyy"]),
    (r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2}:\d{2}$", ["M/d/yyyy H:mm:ss", "d/M/yyyy H:mm:ss"]),
    (r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2}$", ["M/d/yyyy H:mm", "d/M/yyyy H:mm"]),
    (r"^\d{1,2}-\d{1,2}-\d{4}$", ["M-d-yyyy", "d-M-yyyy"]),
    (r"^[A-Za-z]{3} \d{1,2},? \d{4}$", ["MMM d[,] yyyy"]),
    (r"^\d{1,2} [A-Za-z]{3} \d{4}$", ["d MMM yyyy"]),
    (r"^[A-Za-z]{4,9} \d{1,2},? \d{4}$", ["MMMM d[,] yyyy"]),
    (r"^\d{1,2} [A-Za-z]{4,9} \d{4}$", ["d MMMM yyyy"]),
]


def col(name: str) -> Column:
    """Column by exact name, whatever characters the name holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def require_columns(df: DataFrame, *names: str | None) -> None:
    """Raise before anything is computed if a named column is missing; None names nothing."""
    missing = [n for n in names if n is not None and n not in df.columns]
    if missing:
        raise ValueError(f"no such column: {', '.join(missing)}; there are {', '.join(df.columns)}")


def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.NumericType)


def is_text(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.StringType, T.CharType, T.VarcharType))


def is_temporal(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType, T.DayTimeIntervalType))


def numeric_columns(df: DataFrame) -> list[str]:
    """Columns with a numeric type (booleans are not numeric in Spark)."""
    return [f.name for f in df.schema if is_numeric(f.dataType)]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if is_text(f.dataType)]


def groupable_columns(df: DataFrame) -> list[str]:
    """Columns that can be grouped on; maps and variants cannot."""
    return [f.name for f in df.schema if not isinstance(f.dataType, (T.MapType, T.VariantType))]


def key_columns(df: DataFrame) -> list[Column]:
    """What makes two rows equal: every column, maps as their sorted entries, variants as text."""
    def key(f):
        if isinstance(f.dataType, T.VariantType):
            return F.to_json(col(f.name))
        if isinstance(f.dataType, T.MapType):
            plain = not isinstance(f.dataType.valueType, (T.MapType, T.VariantType))
            return F.sort_array(F.map_entries(col(f.name))) if plain else F.to_json(col(f.name))
        return col(f.name)
    return [key(f) for f in df.schema]


def clipped(df: DataFrame, name: str, low: float, high: float) -> Column:
    """A number kept between two bounds in its own type: whole numbers stay whole numbers."""
    c, dtype = col(name), df.schema[name].dataType
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        value = c.cast("double")
        return F.when(c.isNotNull(), F.greatest(F.least(value, F.lit(high)), F.lit(low)))
    whole = isinstance(dtype, T.IntegralType)
    # a bound outside the type bounds nothing
    inside = lambda b: not whole or abs(b) < 2.0 ** 63
    low, high = (F.lit((f(b) if whole else b) if inside(b) else None).try_cast(dtype)
                 for f, b in ((math.ceil, low), (math.floor, high)))
    return F.when(c > high, high).when(c < low, low).otherwise(c)


def quoted(name: str) -> str:
    """A column name inside a SQL expression."""
    return "`" + name.replace("`", "``") + "`"


def text_literal(value: str) -> str:
    """A string constant inside a SQL expression."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def nan_to_null(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def normalize(df: DataFrame) -> DataFrame:
    """NaN becomes NULL in every floating point column; other columns pass through."""
    kinds = {f.name: isinstance(f.dataType, (T.FloatType, T.DoubleType)) for f in df.schema}
    if not any(kinds.values()):
        return df
    return df.selectExpr(*[f"nullif({quoted(c)}, {'double' if isinstance(df.schema[c].dataType, T.DoubleType) else 'float'}"
                           f"('NaN')) AS {quoted(c)}" if floating else quoted(c) for c, floating in kinds.items()])


def to_number(c: Column, wide: bool = False) -> Column:
    """Text to double after removing currency, percent and grouping signs; NULL if it does not parse."""
    cleaned = F.regexp_replace(c, NUMERIC_NOISE_WIDE if wide else NUMERIC_NOISE, "")
    return F.when(cleaned.rlike(NUMBER_SHAPE), cleaned.try_cast("double"))


def double_sql(df: DataFrame, name: str) -> str:
    """SQL of the numeric view of a column: numbers as they are, text parsed, booleans and others NULL."""
    dtype, c = df.schema[name].dataType, quoted(name)
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return f"nullif(cast({c} AS double), double('NaN'))"
    if is_numeric(dtype):
        return f"cast({c} AS double)"
    if is_text(dtype):
        cleaned = f"regexp_replace({c}, r'{NUMERIC_NOISE}', '')"
        return f"CASE WHEN {cleaned} RLIKE r'{NUMBER_SHAPE}' THEN try_cast({cleaned} AS double) END"
    return "cast(NULL AS double)"


def as_double(df: DataFrame, name: str) -> Column:
    """The numeric view of a column as an expression."""
    return F.expr(double_sql(df, name))


def to_datetime(c: Column) -> Column:
    """Text to timestamp over a fixed list of date shapes; NULL if none fits."""
    text = strip(c)
    parsed = F.lit(None).cast("timestamp")
    for shape, patterns in reversed(DATE_PATTERNS):
        attempt = F.coalesce(*[F.try_to_timestamp(text, F.lit(p)) for p in patterns])
        parsed = F.when(text.rlike(shape), attempt).otherwise(parsed)
    return F.when(text.rlike(r"^[0-9A-Za-z]") & text.rlike(DATE_SEPARATORS), parsed)


def as_timestamp(df: DataFrame, name: str) -> Column:
    dtype = df.schema[name].dataType
    if is_text(dtype):
        return to_datetime(col(name))
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return col(name).cast("timestamp")
    return F.lit(None).cast("timestamp")


def to_boolean(c: Column) -> Column:
    """True for the fixed true words, false for every other non-null value."""
    return F.lower(strip(c.cast("string"))).isin(TRUE_WORDS)


def strip(c: Column) -> Column:
    """Remove any whitespace at both ends (plain ``trim`` would only remove spaces)."""
    return F.btrim(c, F.lit(WHITE_SPACE))


def title_case(c: Column) -> Column:
    """Upper case for the first letter of every run of letters, lower case for the others."""
    chars = F.split(F.lower(c), "")
    word_start = lambda i: (i == 0) | ~F.get(chars, i - 1).rlike(r"\p{L}")
    return F.array_join(F.transform(chars, lambda x, i: F.when(word_start(i), F.upper(x)).otherwise(x)), "")


def is_missing_word(c: Column) -> Column:
    return F.lower(strip(c)).isin(MISSING_WORDS)


def render(df: DataFrame, name: str) -> Column:
    """Display text of a value: floats at 4 decimals, non-finite as NULL, timestamps as ISO text."""
    dtype = df.schema[name].dataType
    c = col(name)
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        finite = ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))
        return F.when(finite, F.round(c, 4)).cast("string")
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return F.date_format(c.cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss")
    if isinstance(dtype, T.BooleanType):
        return c.cast("int").cast("string")
    return c.cast("string")


def percent(part: Column, whole: Column, digits: int = 2) -> Column:
    """``part / whole`` in percent, 0 when there is nothing to divide by."""
    return F.coalesce(F.round(F.try_divide(part.cast("double"), whole.cast("double")) * 100, digits), F.lit(0.0))


def span_text(days: Column) -> Column:
    """A number of days as text, with years from 365 days and months from 30."""
    base = F.concat(F.format_number(days, 0), F.lit(" days"))
    years = F.concat(base, F.lit(" (~"), F.round(days / 365.25, 1).cast("string"), F.lit(" years)"))
    months = F.concat(base, F.lit(" (~"), F.round(days / 30.4, 1).cast("string"), F.lit(" months)"))
    return F.when(days >= 365, years).when(days >= 30, months).otherwise(base)
