"""The rules for CSV files over the texts and names of the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tabulens.sources import csvfiles
from tabulens.plans.storage import shared_folder
from tabulens.suite.common import table


def csv_delimiter(spark, sf):
    line = F.regexp_extract("text", r"^\s*([^\r\n]*)", 1)
    return table(spark, sf, "documents").select("doc_id", csvfiles.delimiter_of(line).alias("delimiter"))


DELIMITER = r"""WITH l AS (SELECT doc_id, regexp_extract(text, '^\s*([^\r\n]*)', 1) AS line FROM documents),
n AS (SELECT doc_id, len(line) - len(replace(line, ',', '')) AS a, len(line) - len(replace(line, ';', '')) AS b,
  len(line) - len(replace(line, chr(9), '')) AS c, len(line) - len(replace(line, '|', '')) AS d FROM l)
SELECT doc_id, CASE WHEN greatest(a, b, c, d) IN (0, a) THEN ',' WHEN greatest(a, b, c, d) = b THEN ';'
  WHEN greatest(a, b, c, d) = c THEN chr(9) ELSE '|' END AS delimiter FROM n"""


def binary_payload(spark, sf):
    head = F.when(F.col("doc_id") % 3 == 0, F.unhex(F.lit("4D5A"))).when(F.col("doc_id") % 3 == 1, F.unhex(F.lit("00" * 20))) \
        .otherwise(F.unhex(F.lit("")))
    return table(spark, sf, "documents").select(
        "doc_id", csvfiles.is_binary(F.concat(head, F.col("text").cast("binary"))).alias("is_binary"))


# the texts hold no zero bytes, so the share of zeros among the first 512 bytes follows from their length
BINARY = """SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN true
  WHEN 1 THEN 20.0 / least(512, 20 + octet_length(encode(text))) > 0.05 ELSE false END AS is_binary FROM documents"""

ENDINGS = [".csv", ".EXE.csv", "  report 1.CSV ", "", "%00.csv", ".php.txt.csv"]


def file_names(spark, sf):
    ending = F.element_at(F.array(*[F.lit(e) for e in ENDINGS]), (F.col("page_id") % len(ENDINGS) + 1).cast("int"))
    name = F.concat(F.element_at(F.split("url", "/"), -1), ending)
    return table(spark, sf, "pages").select("page_id", csvfiles.is_allowed_name(name).alias("allowed"),
                                            csvfiles.safe_name(name).alias("safe"))


NAMES = f"""WITH n AS (SELECT page_id, str_split(url, '/')[-1] || [{', '.join(f"'{e}'" for e in ENDINGS)}][page_id % {len(ENDINGS)} + 1] AS n FROM pages),
s AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace(regexp_replace(n, '%00', '', 'g'), '[/\\\\]', ' ', 'g')),
  '\\s+', '_', 'g'), '[^A-Za-z0-9_.\\-]', '', 'g'), '^[._]+|[._]+$', '', 'g') AS bare FROM n)
SELECT page_id, lower(trim(n)) LIKE '%.csv' AND lower(trim(n)) NOT LIKE '.%' AND NOT contains(n, '%00')
  AND NOT regexp_matches(lower(trim(n)), '\\.({'|'.join(csvfiles.DANGEROUS_EXTENSIONS)})\\.') AS allowed,
  CASE WHEN bare IN ('', 'csv') THEN 'dataset.csv' WHEN lower(bare) LIKE '%.csv' THEN bare ELSE bare || '.csv' END AS safe FROM s"""


def ragged_text(spark, sf):
    return csvfiles.ragged_rows(table(spark, sf, "documents"), "text").select("doc_id", "row_count", "column_count", "ragged_rows")


RAGGED = """WITH l AS (SELECT doc_id, list_transform(list_filter(str_split(text, chr(10)), lambda x: trim(x) <> ''),
  lambda x: len(regexp_replace(x, '"[^"]*"', '', 'g')) - len(replace(regexp_replace(x, '"[^"]*"', '', 'g'), ',', '')) + 1) AS c FROM documents)
SELECT doc_id, CAST(greatest(len(c) - 1, 0) AS BIGINT) AS row_count, CAST(coalesce(c[1], 0) AS BIGINT) AS column_count,
  CAST(len(list_filter(c, lambda x: x <> c[1])) AS BIGINT) AS ragged_rows FROM l"""

def csv_round_trip(spark, sf):
    """Whole texts, line breaks and quotes included, written as CSV and read back in blocks."""
    folder = f"{shared_folder(spark)}/csv-{uuid.uuid4().hex}"
    csvfiles.write_csv(table(spark, sf, "documents").select("doc_id", "text", "source", "lang"), folder)
    back = csvfiles.typed(csvfiles.read_csv(spark, folder, multiline=True))
    return back.select("doc_id", F.sha2("text", 256).alias("text_sha256"), "source", "lang")


CSV_ROUND_TRIP = "SELECT doc_id, sha256(text) AS text_sha256, source, lang FROM documents"


def structure_report(spark, sf):
    """A folder with a three-cell and a two-cell file, each judged by its own first line."""
    folder = f"{shared_folder(spark)}/csv-{uuid.uuid4().hex}"
    table(spark, sf, "orders").orderBy("o_orderkey").selectExpr(
        "concat_ws(',', o_orderkey, o_orderstatus, IF(o_orderkey % 10 = 5, 'x,y', 'z')) AS value").coalesce(1).write.text(f"{folder}/wide")
    table(spark, sf, "customer").selectExpr("concat_ws(',', c_custkey, concat('\"', c_name, ',', c_mktsegment, '\"')) AS value") \
        .coalesce(1).write.text(f"{folder}/narrow")
    return csvfiles.structure_report(spark, f"{folder}/*").select(
        F.regexp_extract("path", "(wide|narrow)/[^/]*$", 1).alias("name"), "row_count", "ragged_rows", "column_count", "accepted")


STRUCTURE_REPORT = """SELECT 'wide' AS name, count(*) - 1 AS row_count, count(*) FILTER (o_orderkey % 10 = 5) AS ragged_rows, 3 AS column_count,
  true AS accepted FROM orders UNION ALL SELECT 'narrow', count(*) - 1, 0, 2, true FROM customer"""

QUERIES = {
    "csv_round_trip": (csv_round_trip, CSV_ROUND_TRIP),
    "structure_report": (structure_report, STRUCTURE_REPORT),
    "csv_delimiter": (csv_delimiter, DELIMITER),
    "binary_payload": (binary_payload, BINARY),
    "file_names": (file_names, NAMES),
    "ragged_text": (ragged_text, RAGGED),
}
