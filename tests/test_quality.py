import datetime as dt

import pytest
from pyspark.sql import functions as F

from tabulens.operators import cleaning, outliers, profile, quality, types


def issues(df):
    return {(r["column_name"], r["issue_type"]): r for r in quality.audit(df).collect()}


def test_duplicates(spark):
    df = spark.createDataFrame([(1, "x"), (2, "y"), (1, "x"), (2, "y"), (3, "z")], "a long, b string")
    found = issues(df)[(quality.WHOLE, "duplicate_rows")]
    assert (found["affected_rows"], found["percentage_affected"], found["severity"]) == (2, 40.0, "High")


def test_missing_levels(spark):
    df = spark.createDataFrame([(None, None, 1), (None, None, 2), (1, None, 3), (2, None, 4), (3, 1, 5)],
                               "moderate long, critical long, clean long")
    found = issues(df)
    assert ("moderate", "missing_values") in found
    assert found[("critical", "high_missing_percentage")]["percentage_affected"] == 80.0
    assert not [k for k in found if k[0] == "clean"]


def test_near_constant_text_and_number(spark):
    df = spark.createDataFrame([("c", "a" if i else "b", str(i), 7.0 if i else 9.0) for i in range(20)],
                               "const string, near string, distinct string, num double")
    found = issues(df)
    assert ("const", "constant_column") in found and ("near", "near_constant_column") in found
    assert found[("num", "near_constant_column")]["affected_rows"] == 19
    assert ("distinct", "near_constant_column") not in found


def test_case_and_space(spark):
    values = [" male ", "Male", "male", "Female", " female ", "FEMALE"] * 4
    df = spark.createDataFrame([(v,) for v in values], "category string")
    found = issues(df)
    assert found[("category", "leading_trailing_whitespace")]["affected_rows"] == 8
    assert found[("category", "inconsistent_categorical")]["affected_rows"] == 16


def test_text_types(spark):
    df = spark.createDataFrame([("$1,000.50", f"2024-01-{i + 1:02d}", i) for i in range(20)],
                               "m string, dates string, k long").withColumn(
        "money", F.concat("m", F.col("k").cast("string"))).drop("m", "k")
    kinds = {k[1] for k in issues(df) if k[1].startswith("potential")}
    assert kinds == {"potential_numeric_as_string", "potential_datetime_as_string"}


def test_invalid_numbers(spark):
    rows = [(-5, float("inf")), (-999, float("-inf"))] + [(i + 20, float(i)) for i in range(8)]
    df = spark.createDataFrame(rows, "age long, score double")
    found = issues(df)
    assert found[("age", "invalid_numerical_values")]["affected_rows"] == 3  # -999 counts as code and as negative
    assert found[("score", "invalid_numerical_values")]["affected_rows"] == 2


def test_one_extreme(spark):
    df = spark.createDataFrame([(45.0 + i % 10,) for i in range(30)] + [(1000.0,)], "metric double")
    assert issues(df)[("metric", "extreme_outliers")]["affected_rows"] == 1


def test_empty_frames(spark):
    empty = spark.createDataFrame([], "a long, b string, c double")
    assert quality.audit(empty).count() == 0
    assert profile.quality_score(empty).first()["health_score"] == 0
    assert profile.quality_score(empty).first()["health_grade"] == "F"


def messy(spark):
    rows = []
    for i in range(40):
        rows.append((None if i == 5 else [" male ", "Male", "Female", "female", "FEMALE"][i % 5],
                     "$1,200.50" if i == 0 else f"${i + 100}.25", f"2024-02-{i % 28 + 1:02d}",
                     -999.0 if i == 1 else None if i == 2 else 150.0 if i == 3 else 20.0 + i,
                     -15.0 if i == 4 else float("inf") if i == 6 else 10.0 + i, "US", i != 7,
                     None if i < 25 else f"n{i % 3}", f"C{i:03d}"))
    return spark.createDataFrame(rows, "gender string, revenue string, signup_date string, age double, price double,"
                                       " country string, is_verified boolean, optional_notes string, customer_id string")


def test_cleaning_messy(spark):
    df = messy(spark)
    before = df.count()
    result = cleaning.clean(df, {"drop_constant_columns": True, "drop_high_missing_columns": True})
    data = result.data
    kinds = dict(data.dtypes)
    assert kinds["revenue"] == "double" and kinds["signup_date"] == "timestamp"
    assert "country" not in kinds and "optional_notes" not in kinds
    assert {r[0] for r in data.select("gender").distinct().collect()} == {"Male", "Female"}
    assert data.where("revenue = 1200.5").count() == 1
    assert data.where("age = -999 OR price < 0 OR price = double('Infinity')").count() == 0
    assert data.where(" OR ".join(f"`{c}` IS NULL" for c in data.columns)).count() == 0
    assert df.count() == before and df.schema["revenue"].dataType.simpleString() == "string"
    s = result.summary.first()
    assert s["columns_before"] - s["columns_after"] == 2 and s["columns_converted"] == 2
    assert s["rows_before"] == s["rows_after"] + s["duplicates_removed"]


def test_fill_strategies(spark):
    df = spark.createDataFrame([(1.0, "a"), (None, "a"), (3.0, None)], "x double, c string")
    assert cleaning.fill_numbers(df, "mean").agg(F.sum("x")).first()[0] == 6.0
    assert cleaning.fill_numbers(df, "zero").agg(F.sum("x")).first()[0] == 4.0
    assert cleaning.fill_numbers(df, "drop").count() == 2
    assert cleaning.fill_others(df, "mode").where("c = 'a'").count() == 3
    assert cleaning.fill_others(df, "unknown").where("c = 'Unknown'").count() == 1
    assert cleaning.fill_others(df, "none").where("c IS NULL").count() == 1


def bench_frame(spark):
    score = [15.0, 130.0] + [70.0 + i % 9 for i in range(20)]
    age = [-15.0, -999.0] + [30.0 + i % 7 for i in range(20)]
    pct = [250.0] + [10.0 + i % 5 for i in range(21)]
    zero = [0.0] * 16 + [10.0, 20.0, 30.0, 40.0, 50.0, 60.0]
    rows = [(score[i], age[i], pct[i], 42.0, zero[i], "AB"[i % 2]) for i in range(22)]
    return spark.createDataFrame(rows, "Exam_Score double, Customer_Age double, Discount_Pct double,"
                                       " Constant_Col double, Zero_IQR_Col double, Category string")


def test_three_methods_and_warnings(spark):
    df = bench_frame(spark)
    names = ["Exam_Score", "Customer_Age", "Discount_Pct", "Constant_Col", "Zero_IQR_Col"]
    iqr = {r["column_name"]: r for r in outliers.outlier_summary(df, names).collect()}
    assert iqr["Exam_Score"]["outlier_count"] == 2 and "zero_iqr" not in iqr["Exam_Score"]["warnings"]
    assert iqr["Customer_Age"]["confirmed_error_count"] == 2 and iqr["Customer_Age"]["status"] == "Data Errors Detected"
    assert iqr["Discount_Pct"]["confirmed_error_count"] == 1
    assert iqr["Constant_Col"]["outlier_count"] == 0 and "zero_variance" in iqr["Constant_Col"]["warnings"]
    z = {r["column_name"]: r for r in outliers.outlier_summary(df, names, "zscore").collect()}
    assert z["Constant_Col"]["status"] == "Constant Feature"
    mad = {r["column_name"]: r for r in outliers.outlier_summary(df, names, "modified_zscore").collect()}
    assert mad["Zero_IQR_Col"]["status"] == "Zero MAD" and mad["Exam_Score"]["outlier_count"] == 2


def test_zero_iqr_warning(numbers):
    s = outliers.outlier_summary(numbers([0] * 16 + [10, 20, 30, 40]), ["v"]).first()
    assert "zero_iqr" in s["warnings"]


@pytest.mark.parametrize("value, name, wrong", [(-15, "Customer_Age", True), (-999, "Monthly_Income", True),
                                                (350, "Discount_Pct", True), (45000, "Sales_Amount", False),
                                                (-0.6, "delta", True), (13, "month", True)])
def test_error_labels(spark, value, name, wrong):
    df = spark.range(1).select(F.lit(float(value)).alias("v"))
    assert df.select(outliers.is_error(F.col("v"), name, 1000.0)).first()[0] is wrong


def test_remediation(spark):
    df = bench_frame(spark)
    kept = outliers.remediate(df, "remove", ["Exam_Score"])
    assert kept.count() == 20
    assert outliers.remediate(df, "remove_errors_only", ["Exam_Score", "Customer_Age"]).count() == 20
    capped = outliers.remediate(df, "cap", ["Exam_Score"])
    b = outliers.bounds(df, ["Exam_Score"])["Exam_Score"]
    low, high = capped.agg(F.min("Exam_Score"), F.max("Exam_Score")).first()
    assert low >= round(b["lower"], 4) and high <= round(b["upper"], 4) and capped.count() == 22
    s = outliers.remediation_summary(df, "cap", ["Exam_Score"]).first()
    assert (s["values_capped"], s["rows_dropped"]) == (2, 0)


def test_class_vectors(spark):
    rows = [(f"${i}.50", ["red", "green", "blue"][i % 3], f"2024-03-{i % 28 + 1:02d}", "yes" if i % 2 else "no", i % 2,
             f"id-{i}", i % 5 + 1, None) for i in range(50)]
    df = spark.createDataFrame(rows, "price string, color string, day string, answer string, flag int, user_id string,"
                                     " rating int, nothing string")
    assert types.class_map(df) == {"price": "Numerical", "color": "Categorical", "day": "Datetime", "answer": "Boolean",
                                   "flag": "Boolean", "user_id": "Other", "rating": "Categorical", "nothing": "Other"}


def test_roles(spark):
    rows = [(f"ORD-{i}", i, 5.0, None, i % 2, i % 2, dt.datetime(2024, 1, 1), True, "x" if i % 3 else "y", float(i))
            for i in range(60)]
    df = spark.createDataFrame(rows, "Order_ID string, row_id long, constant double, nothing string, is_new int,"
                                     " parity int, at timestamp, ok boolean, kind string, amount double")
    roles = types.role_map(df)
    assert roles["identifier"] == ["Order_ID", "row_id"] and roles["boolean"] == ["is_new", "ok"]
    assert roles["numerical"] == ["parity", "amount"] and roles["categorical"] == ["kind"] and roles["datetime"] == ["at"]


def test_profile_mix(spark):
    rows = [(f"O{i}", dt.datetime(2024, 1, 1) + dt.timedelta(days=i), None if 5 <= i <= 9 else 20.0 + i,
             None if 20 <= i <= 22 else "AB"[i % 2], 10.0 * i, i % 2 == 0, f"note {i}") for i in range(100)]
    rows[50], rows[60] = rows[49], rows[59]
    df = spark.createDataFrame(rows, "order_id string, order_date timestamp, customer_age double,"
                                     " product_category string, sales_amount double, is_returned boolean, notes string")
    m = profile.dataset_metrics(df).first()
    assert (m["missing_cells"], m["total_cells"], m["duplicate_rows"]) == (8, 700, 2)
    table = profile.profile_table(df)
    assert table.count() == 7


def test_unicode_and_odd_names(spark):
    df = spark.createDataFrame([("a,\"b\"\n😀", 1.5), ("ö", 2.5)], "`na``me, \"x\"` string, `val ue.😀'` double")
    assert profile.column_profile(df).count() == 2
    assert quality.audit(df).count() >= 0
    assert profile.numeric_profile(df, ["val ue.😀'"]).first()["mean"] == 2.0
