"""Queries of the text operators, question labelling, column matching, and the catalog."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabulens.functions import coerce, text
from tabulens.operators import tools
from tabulens.sources import catalog
from tabulens.suite.common import DIRTY, dirty, table


def mask_secrets(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(text.mask_credentials(F.col("text"))).alias("masked"))


_MASKED = "text"
for _pattern, _replacement in text.CREDENTIAL_MASKS:
    _flags = "gi" if _pattern.startswith("(?i)") else "g"
    _MASKED = f"regexp_replace({_MASKED}, '{_pattern.removeprefix('(?i)')}', '{_replacement.replace('$1', chr(92) + '1')}', '{_flags}')"
MASK = f"SELECT doc_id, md5({_MASKED}) AS masked FROM documents"


def sanitize_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(text.sanitize_text(F.col("text"))).alias("clean"))


def sanitize_text_cut(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(text.sanitize_text(F.col("text"), 500)).alias("clean"))


UNPRINTABLE = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F\p{Cf}\p{Co}\p{Zl}\p{Zp}\x{A0}\x{1680}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}]"
SANITIZE = rf"SELECT doc_id, md5(regexp_replace(regexp_replace(text, '{UNPRINTABLE}', '', 'g'), '^\s+|\s+$', '', 'g')) AS clean FROM documents"
SANITIZE_CUT = rf"SELECT doc_id, md5(substring(regexp_replace(regexp_replace(text, '{UNPRINTABLE}', '', 'g'), '^\s+|\s+$', '', 'g'), 1, 500)) AS clean FROM documents"


def safe_identifiers(spark, sf):
    names = table(spark, sf, "pages").select("page_id", F.element_at(F.split("url", "/"), -1).alias("name"), "url")
    return names.select("page_id", text.is_safe_identifier(F.col("name")).alias("name_safe"),
                        text.is_safe_identifier(F.col("url")).alias("url_safe"))


SAFE = r"""SELECT page_id, regexp_matches(n, '^[a-zA-Z0-9_\-.]+$') AND NOT contains(n, '..') AS name_safe,
  regexp_matches(url, '^[a-zA-Z0-9_\-.]+$') AND NOT contains(url, '..') AS url_safe
FROM (SELECT page_id, url, str_split(url, '/')[-1] AS n FROM pages)"""


def coerced_values(spark, sf):
    df = dirty(spark, sf)
    return df.select("order_key", coerce.to_number(F.col("price_txt")).alias("price"),
                     F.date_format(coerce.to_datetime(F.col("date_txt")), "yyyy-MM-dd").alias("day"),
                     coerce.is_missing_word(F.col("status")).alias("missing"),
                     coerce.title_case(F.col("priority")).alias("title"),
                     coerce.to_boolean(F.when(F.col("order_key") % 2 == 0, "Yes ").otherwise("off")).alias("truth"),
                     coerce.render(df, "amount").alias("shown_amount")) \
        .withColumn("shown_amount", F.col("shown_amount").isNull())


COERCED = """SELECT order_key, CAST(replace(price_txt, '$', '') AS DOUBLE) AS price, date_txt AS day, status = 'N/A' AS missing,
  array_to_string(list_transform(str_split(lower(priority), ''), lambda x, i: CASE WHEN i = 1 OR NOT
    regexp_matches(str_split(lower(priority), '')[i - 1], '[a-z]') THEN upper(x) ELSE x END), '') AS title,
  order_key % 2 = 0 AS truth, isinf(amount) AS shown_amount FROM dirty"""

INTENT_ROLES = {"numerical": ["Sales_Amount", "Quantity", "Customer_Age"], "categorical": ["Category", "Region"],
                "datetime": ["Order_Date"]}


def intent_label(spark, sf):
    return tools.label_intents(table(spark, sf, "conversations").select("conv_id", "turn", "text"), "text",
                               INTENT_ROLES).drop("text")


def _says(words):
    quoted = [w.replace("'", "''") for w in words]
    return "(" + " OR ".join(f"contains(q, '{w}')" for w in quoted) + ")"


def _mentioned(names):
    return "CASE " + " ".join(
        f"WHEN contains(k, '{n.lower().replace('_', '')}') OR contains(q, '{n.lower()}') THEN '{n}'" for n in names) + " END"


RELATED = r"is\s+(.*?)\s+(?:related to|correlated with|linked to|associated with)\s+(.*?)(?:\?|$)"
NUM, CAT = INTENT_ROLES["numerical"], INTENT_ROLES["categorical"]
EVERY = NUM + CAT + INTENT_ROLES["datetime"]
_W = tools.INTENT_WORDS
INTENTS = f"""WITH t AS (SELECT conv_id, turn, trim(lower(text)) AS q, regexp_replace(lower(text), '[^a-z0-9]', '', 'g') AS k FROM conversations),
f AS (SELECT *, coalesce({_mentioned(CAT)}, CASE WHEN contains(q, 'category') THEN 'Category' WHEN contains(q, 'region') THEN 'Region' END) AS grp,
  coalesce({_mentioned(NUM)}, CASE WHEN {_says(['sales', 'highest', 'perform'])} THEN 'Sales_Amount'
    WHEN contains(q, 'profit') THEN NULL WHEN contains(q, 'revenue') THEN 'Sales_Amount' END) AS met,
  coalesce({_mentioned(EVERY)}, CASE WHEN contains(q, 'profit') THEN 'profit' WHEN contains(q, 'sales') THEN 'Sales_Amount'
    WHEN contains(q, 'revenue') THEN 'Sales_Amount' WHEN contains(q, 'discount') THEN NULL WHEN contains(q, 'age') THEN 'Customer_Age'
    WHEN contains(q, 'quantity') THEN 'Quantity' WHEN contains(q, 'price') THEN NULL END) AS one, {_mentioned(EVERY)} AS men FROM t),
g AS (SELECT *, list_filter([{', '.join(f"CASE WHEN contains(k, '{n.lower().replace('_', '')}') OR contains(q, '{n.lower()}') THEN '{n}' END" for n in EVERY)}], lambda x: x IS NOT NULL) AS named,
  list_filter([CASE WHEN contains(q, 'revenue') OR contains(q, 'sales') THEN 'Sales_Amount' END,
    CASE WHEN contains(q, 'quantity') THEN 'Quantity' END, CASE WHEN contains(q, 'age') THEN 'Customer_Age' END], lambda x: x IS NOT NULL) AS implied FROM f),
l AS (SELECT *, CASE {' '.join(f"WHEN {_says(w)}" + (" AND grp IS NOT NULL" if n == "groupby_analysis" else " AND one IS NOT NULL" if n == "aggregation_analysis" else "") + f" THEN '{n}'" for n, w in _W.items())}
  WHEN men IS NOT NULL THEN 'column_summary' ELSE 'dataset_summary' END AS tool, named || CASE WHEN len(named) < 2 THEN
    list_filter(implied, lambda x: NOT list_contains(named, x)) ELSE []::VARCHAR[] END AS sides FROM g)
SELECT conv_id, turn, tool, CASE WHEN tool = 'groupby_analysis' THEN grp END AS group_column,
  CASE WHEN tool = 'groupby_analysis' THEN met WHEN tool = 'aggregation_analysis' THEN one
    WHEN tool IN ('column_summary', 'outlier_analysis') THEN men WHEN tool = 'distribution_analysis' THEN coalesce(men, 'Sales_Amount')
    WHEN tool = 'correlation_analysis' THEN coalesce(sides[1], CASE WHEN len(sides) = 0 THEN nullif(trim(regexp_extract(q, '{RELATED}', 1)), '') END)
    WHEN tool = 'time_series_analysis' THEN coalesce({_mentioned(NUM)}, CASE WHEN {_says(['sales', 'revenue'])} THEN 'Sales_Amount' END)
    END AS target_column,
  CASE WHEN tool = 'correlation_analysis' THEN coalesce(sides[2], CASE WHEN len(sides) = 0 THEN nullif(trim(regexp_extract(q, '{RELATED}', 2)), '') END)
    WHEN tool = 'time_series_analysis' THEN 'Order_Date' END AS second_column,
  CASE WHEN tool = 'groupby_analysis' THEN CASE WHEN {_says(['average', 'mean', 'avg'])} THEN 'mean' ELSE 'sum' END
    WHEN tool = 'aggregation_analysis' THEN CASE WHEN {_says(['total', 'sum'])} THEN 'sum' WHEN contains(q, 'median') THEN 'median'
      WHEN {_says(['minimum', 'min '])} THEN 'min' WHEN {_says(['maximum', 'max '])} THEN 'max' ELSE 'mean' END END AS aggregate,
  CASE WHEN tool = 'groupby_analysis' THEN NOT {_says(tools.ASCENDING_WORDS)} END AS descending FROM l"""


def last_turns(spark, sf):
    return tools.last_turns(table(spark, sf, "conversations"), "conv_id", "turn", 4).select(
        "conv_id", "turn", "role", "turn_rank")


LAST_TURNS = """WITH r AS (SELECT conv_id, turn, role, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS INTEGER) AS turn_rank
FROM conversations) SELECT * FROM r WHERE turn_rank <= 4"""


def match_columns(spark, sf):
    """Sources act as columns of their language; each document asks for its source in some spelling."""
    docs = table(spark, sf, "documents")
    known = docs.groupBy("lang", "source").agg(F.min("doc_id").alias("position")).select(
        F.col("lang").alias("dataset_id"), "position", F.col("source").alias("column_name"),
        F.lit("categorical").alias("role"))
    k = F.col("doc_id") % 4
    asked = docs.select("doc_id", F.col("lang").alias("dataset_id"), F.when(k == 0, F.col("source"))
                        .when(k == 1, F.concat(F.lit(" "), F.upper("source"), F.lit("!")))
                        .when(k == 2, F.lit("???")).otherwise(F.lit("unseen name")).alias("request"),
                        F.when(k == 3, "categorical").alias("preferred_role"))
    matched = tools.match_columns(asked.select("dataset_id", "request", "preferred_role").distinct(), known)
    return matched.select("dataset_id", "request", "column_name", "matched_by")


MATCH = """WITH k AS (SELECT lang, source, min(doc_id) AS position, regexp_replace(lower(source), '[^a-z0-9]', '', 'g') AS tok FROM documents GROUP BY ALL),
a AS (SELECT DISTINCT lang, CASE doc_id % 4 WHEN 0 THEN source WHEN 1 THEN ' ' || upper(source) || '!' WHEN 2 THEN '???' ELSE 'unseen name' END AS raw,
  CASE WHEN doc_id % 4 = 3 THEN 'categorical' END AS pref FROM documents),
t AS (SELECT lang, trim(raw) AS request, regexp_replace(lower(raw), '[^a-z0-9]', '', 'g') AS tok, pref FROM a),
m AS (SELECT t.*, (SELECT arg_min(k.source, position) FROM k WHERE k.lang = t.lang AND k.source = t.request) AS e,
  (SELECT arg_min(k.source, position) FROM k WHERE k.lang = t.lang AND k.tok = t.tok AND t.tok <> '') AS n,
  (SELECT arg_min(k.source, position) FROM k WHERE k.lang = t.lang AND t.tok <> '' AND k.tok <> '' AND (contains(k.tok, t.tok) OR contains(t.tok, k.tok))) AS s,
  (SELECT arg_min(k.source, position) FROM k WHERE k.lang = t.lang AND t.pref = 'categorical') AS p FROM t)
SELECT lang AS dataset_id, request, coalesce(e, n, s, p) AS column_name, CASE WHEN e IS NOT NULL THEN 'exact'
  WHEN n IS NOT NULL THEN 'normalised' WHEN s IS NOT NULL THEN 'substring' WHEN p IS NOT NULL THEN 'role' END AS matched_by FROM m"""


def _entries(spark, sf):
    """Customers as raw datasets, their orders as processed ones."""
    raw = table(spark, sf, "customer").select(
        F.concat(F.lit("c"), F.col("c_custkey")).alias("dataset_id"), F.lit(None).cast("string").alias("parent_id"),
        F.lit(False).alias("is_processed"), F.lit(None).cast("timestamp").alias("stored_at"))
    processed = table(spark, sf, "orders").select(
        F.concat(F.lit("o"), F.col("o_orderkey")).alias("dataset_id"),
        F.concat(F.lit("c"), F.col("o_custkey")).alias("parent_id"), F.lit(True).alias("is_processed"),
        F.col("o_orderdate").cast("timestamp").alias("stored_at"))
    return raw.unionByName(processed)


def catalog_raw(spark, sf):
    return catalog.raw_datasets(_entries(spark, sf)).select("dataset_id", "is_processed")


def catalog_latest(spark, sf):
    return catalog.latest_processed(_entries(spark, sf)).select("parent_id", "dataset_id")


LATEST = """SELECT 'c' || o_custkey AS parent_id, 'o' || o_orderkey AS dataset_id FROM (SELECT *, row_number() OVER
  (PARTITION BY o_custkey ORDER BY o_orderdate DESC, 'o' || o_orderkey DESC) AS k FROM orders) WHERE k = 1"""


def catalog_with_child(spark, sf):
    return catalog.with_latest_processed(_entries(spark, sf)).select("dataset_id", "processed_id")


WITH_CHILD = f"""WITH l AS ({LATEST}) SELECT 'c' || c_custkey AS dataset_id, l.dataset_id AS processed_id
FROM customer LEFT JOIN l ON l.parent_id = 'c' || c_custkey"""

QUERIES = {
    "mask_secrets": (mask_secrets, MASK),
    "sanitize_text": (sanitize_text, SANITIZE),
    "sanitize_text_cut": (sanitize_text_cut, SANITIZE_CUT),
    "safe_identifiers": (safe_identifiers, SAFE),
    "coerced_values": (coerced_values, f"WITH {DIRTY} {COERCED}"),
    "intent_label": (intent_label, INTENTS),
    "last_turns": (last_turns, LAST_TURNS),
    "match_columns": (match_columns, MATCH),
    "catalog_raw": (catalog_raw, "SELECT 'c' || c_custkey AS dataset_id, false AS is_processed FROM customer"),
    "catalog_latest": (catalog_latest, LATEST),
    "catalog_with_child": (catalog_with_child, WITH_CHILD),
}
