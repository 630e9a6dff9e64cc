import os

import pytest
from pyspark.sql import functions as F

from tabulens.functions import coerce, text
from tabulens.operators import chartdata, tools
from tabulens.plans.sampling import hash_sample
from tabulens.sources import catalog, csvfiles, samples

SALES = {"numerical": ["Sales_Amount", "Quantity", "Profit"], "categorical": ["Category", "Region"],
         "datetime": ["Order_Date"]}


@pytest.mark.parametrize("question, tool, group, target, agg, desc", [
    ("Which category has the highest sales?", "groupby_analysis", "Category", "Sales_Amount", "sum", True),
    ("Which region has the lowest average quantity?", "groupby_analysis", "Region", "Quantity", "mean", False),
    ("What is the average profit?", "aggregation_analysis", None, "Profit", "mean", None),
    ("Give me an overview", "dataset_summary", None, None, None, None),
    ("Are there unusual values in Quantity?", "outlier_analysis", None, "Quantity", None, None),
    ("How has revenue changed over time?", "time_series_analysis", None, "Sales_Amount", None, None),
    ("Show the distribution of Sales_Amount", "distribution_analysis", None, "Sales_Amount", None, None),
    ("What should I investigate next?", "investigate_further", None, None, None, None)])
def test_intents(spark, question, tool, group, target, agg, desc):
    df = spark.createDataFrame([(question,)], "q string")
    r = tools.label_intents(df, "q", SALES).first()
    assert (r["tool"], r["group_column"], r["target_column"], r["aggregate"], r["descending"]) == (tool, group, target, agg, desc)


def test_match_columns(spark):
    known = spark.createDataFrame([("d", i, c, r) for i, (c, r) in enumerate(
        [("Order_Date", "datetime"), ("Sales_Amount", "numerical"), ("Region", "categorical")])],
        "dataset_id string, position int, column_name string, role string")
    asked = spark.createDataFrame([("d", "Region", None), ("d", "sales amount", None), ("d", "sale", None),
                                   ("d", "turnover", None), ("d", "zzz", "datetime"), ("d", "qqq", None)],
                                  "dataset_id string, request string, preferred_role string")
    got = {r["request"]: (r["column_name"], r["matched_by"]) for r in tools.match_columns(asked, known).collect()}
    assert got == {"Region": ("Region", "exact"), "sales amount": ("Sales_Amount", "normalised"),
                   "sale": ("Sales_Amount", "substring"), "turnover": ("Sales_Amount", "alias"),
                   "zzz": ("Order_Date", "role"), "qqq": (None, None)}


def test_group_rank_ties_and_nulls(spark):
    df = spark.createDataFrame([("b", 1.0), ("a", 1.0), (None, 9.0), ("c", None), ("d", 3.0)], "g string, v double")
    rows = tools.group_rank(df, "g", "v").orderBy("rank").collect()
    assert [r["group"] for r in rows] == ["d", "a", "b"] and rows[0]["percentage_of_total"] == 60.0
    ends = {r["position"]: r["group"] for r in tools.group_extremes(df, "g", "v").collect()}
    assert ends == {"top": "d", "bottom": "b"}


def test_time_series_fills_sums_only(spark):
    df = spark.createDataFrame([("2024-01-31", 1.0), ("2024-04-02", 3.0)], "d string, v double")
    total = tools.time_series(df, "d", "v", "month").orderBy("period").collect()
    assert [(r["period"], r["value"]) for r in total] == [("2024-01", 1.0), ("2024-02", 0.0), ("2024-03", 0.0), ("2024-04", 3.0)]
    assert tools.time_series(df, "d", "v", "month", "mean").count() == 2
    assert tools.time_series_growth(df, "d", "v", "month").first()["growth_pct"] == 200.0


def test_histogram_closed_last_bin(numbers):
    rows = tools.histogram(numbers([0, 1, 2, 3, 4, 10]), "v", 5).orderBy("bin").collect()
    assert [r["count"] for r in rows] == [2, 2, 1, 0, 1]
    assert [r["count"] for r in tools.histogram(numbers([7, 7]), "v", 4).orderBy("bin").collect()] == [0, 0, 2, 0]


def test_hash_sample_is_exact_and_stable(spark):
    df = spark.range(20000).withColumn("h", F.xxhash64(F.lit(42), F.col("id")))
    want = {r["id"] for r in df.orderBy("h").limit(500).collect()}
    assert {r["id"] for r in hash_sample(df.drop("h"), ["id"], 500).collect()} == want
    assert hash_sample(spark.range(10), ["id"], 500).count() == 10
    assert hash_sample(spark.range(1000).selectExpr("1 AS k"), ["k"], 5).count() == 5


def test_other_bucket_is_built_from_rows(spark):
    df = spark.createDataFrame([("a", 10.0), ("b", 8.0), ("c", 1.0), ("c", 3.0), ("d", 2.0)], "g string, v double")
    got = {r["category"]: r["value"] for r in chartdata.grouped_bar(df, "g", "v", "mean", 2).collect()}
    assert got == {"a": 10.0, "b": 8.0, chartdata.OTHER: 2.0}


def test_scatter_line_needs_spread(spark):
    flat = spark.createDataFrame([(1.0, float(i)) for i in range(10)], "x double, y double")
    assert chartdata.scatter_line(flat, "x", "y").count() == 0


def test_masking_and_identifiers(spark):
    key, bearer = "sk-" + "a" * 24, "Authorization: Bearer abc.def-123"
    df = spark.createDataFrame([(key,), ("AIza" + "b" * 35,), ("ant-" + "c" * 24,), (bearer,), ("u?key=topsecret&x=1",)], "t string")
    assert all("[REDACTED" in r[0] for r in df.select(text.mask_credentials(F.col("t"))).collect())
    ids = spark.createDataFrame([("ok_1.csv",), ("../x",), ("a/b",), ("",), (None,), ("a..b",)], "t string")
    assert [r[0] for r in ids.select(text.is_safe_identifier(F.col("t"))).collect()] == [True, False, False, False, False, False]
    raw = spark.createDataFrame([("  a\u0000b\tc​d  ",)], "t string")
    assert raw.select(text.sanitize_text(F.col("t"))).first()[0] == "ab\tcd"


def test_dates(spark):
    cases = {"2024-01-05": "2024-01-05", "2024-02-30": None, "1/2/2024": "2024-01-02", "25/12/2024": "2024-12-25",
             "Jan 5, 2024": "2024-01-05", "5 January 2024": "2024-01-05", "2024": None, "12:30": None,
             "9999-99-99": None, "not_a_date": None, "2024-01-05T10:11:12Z": "2024-01-05"}
    df = spark.createDataFrame([(c,) for c in cases], "t string")
    got = {r[0]: r[1] for r in df.select("t", F.date_format(coerce.to_datetime(F.col("t")), "yyyy-MM-dd")).collect()}
    assert got == cases


def test_title_case(spark):
    df = spark.createDataFrame([("o'NEIL x-ray 3d",)], "t string")
    assert df.select(coerce.title_case(F.col("t"))).first()[0] == "O'Neil X-Ray 3D"


def test_csv_reading(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a,b,c\n1,x,2\n3,y\n4,z,5,6\n7,,NA\n")
    df = csvfiles.read_csv(spark, str(tmp_path / "a.csv"))
    assert [tuple(r) for r in df.orderBy("a").collect()] == [("1", "x", "2"), ("3", "y", None), ("7", None, None)]
    assert dict(csvfiles.typed(df).dtypes) == {"a": "bigint", "b": "string", "c": "double"}
    report = csvfiles.structure_report(spark, str(tmp_path / "a.csv")).first()
    assert (report["row_count"], report["ragged_rows"], report["column_count"], report["accepted"]) == (4, 2, 3, True)


def test_file_audit(spark, tmp_path):
    (tmp_path / "good.csv").write_text("ProductID;Title;Price\n1;x;2\n")
    (tmp_path / "latin.csv").write_bytes("City,N\nMünchen,1\n".encode("latin-1"))
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "blank.csv").write_text(",,\n1,2,3\n")
    (tmp_path / "evil.php.csv").write_text("a,b\n")
    (tmp_path / "app.csv").write_bytes(b"MZ\x90\x00abc")
    (tmp_path / "zeros.csv").write_bytes(b"a,b\n" + b"\x00" * 50)
    (tmp_path / "notes.txt").write_text("hello")
    rows = {r["name"]: r for r in csvfiles.audit_files(spark, str(tmp_path)).collect()}
    assert rows["good.csv"]["accepted"] and rows["good.csv"]["delimiter"] == ";"
    assert rows["latin.csv"]["encoding"] == "ISO-8859-1" and rows["latin.csv"]["accepted"]
    assert {n: r["reason"] for n, r in rows.items() if not r["accepted"]} == {
        "empty.csv": "empty file", "blank.csv": "header missing or blank", "evil.php.csv": "file name not allowed",
        "app.csv": "binary content", "zeros.csv": "binary content", "notes.txt": "file name not allowed"}
    assert csvfiles.expired_totals(spark, str(tmp_path), 1).count() == 0


def test_store_and_catalog(spark, tmp_path):
    book = str(tmp_path / "catalog")
    raw = catalog.store(spark.range(5).toDF("x"), str(tmp_path / "data"), book)
    child = catalog.store(spark.range(3).toDF("x"), str(tmp_path / "data"), book, parent_id=raw, fmt="csv")
    entries = catalog.read_catalog(spark, book)
    assert [r["dataset_id"] for r in catalog.raw_datasets(entries).collect()] == [raw]
    row = catalog.with_latest_processed(entries).first()
    assert (row["processed_id"], row["rows"]) == (child, 5)
    assert len(os.listdir(tmp_path / "data")) == 2


def test_samples_and_report_sink(spark, tmp_path):
    shop = samples.ecommerce(spark)
    assert shop.count() == 250 and shop.where("Customer_Age IS NULL").count() == 8
    assert samples.employee(spark).where("Salary IS NULL").count() == 6
    csvfiles.write_report(shop.limit(3), str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).count() == 3


def test_last_turns(spark):
    df = spark.range(250).selectExpr("id % 2 AS c", "id AS t")
    assert tools.last_turns(df, "c", "t").count() == 200


def test_ragged_rows_cuts_lines_once(spark):
    from tabulens.sources import csvfiles
    rows = [(1, 'a,b\n"x,y",2\n\n1,2,3'), (2, None), (3, 'one;two\n1;2;"3;4"')]
    df = spark.createDataFrame(rows, "id long, cells_ string")
    found = csvfiles.ragged_rows(df, "cells_")
    assert found.columns == ["id", "cells_", "row_count", "column_count", "ragged_rows"]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
    assert [tuple(r)[2:] for r in found.orderBy("id").collect()] == [(2, 2, 1), (0, 0, 0), (1, 1, 0)]
    assert [tuple(r)[2:] for r in csvfiles.ragged_rows(df, "cells_", ";").where("id = 3").collect()] == [(1, 2, 1)]
