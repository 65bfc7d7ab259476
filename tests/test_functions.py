import pytest
from pyspark.sql import functions as F

from tributary.functions import clean, dates, text


def run(spark, column, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r[1] for r in sorted(df.select("i", column(F.col("x")).alias("y")).collect(), key=lambda r: r[0])]


CASES = [
    (text.normalize_header, {"  Emp_Code  ": "emp code", "Cost/Center": "cost center", "R&D Dept.": "r and d dept", "﻿ a b　": "a b"}),
    (text.title_case, {"RAJESH KUMAR": "Rajesh Kumar", "ludwig van beethoven": "Ludwig van Beethoven", "j.r. tolkien": "J.R. Tolkien", "IT": "It"}),
    (text.is_blank, {"": True, "  ": True, "-": True, "N/A": True, "n/a": True, "na": True, "null": True, "NULL": True, "Null": False, "Pune Plant": False}),
    (text.parse_number, {"₹9,80,000": 980000.0, "$1,200.50": 1200.5, "n/a": None, "12d": None, "NaN": None, "0x10": 16.0, "INR 5": 5.0, "": None, "1e3": 1000.0}),
    (text.looks_email, {"ana.maria@harbour.example": True, "not an email": False}),
    (text.looks_phone, {"+91 98765 43210": True, "12": False}),
    (text.email_domain, {"A@B.c@d": "b.c", "none": ""}),
    (text.money, {"980000": "9,80,000", "100": "100", "12345678.5": "1,23,45,678.5", "": "—", "abc": "abc", "-1234": "-1,234"}),
    (clean.canonical_id, {"apx-1001": "1001", "APX_1001": "1001", "1001.0": "1001", "APX-1010b": "1010B"}),
    (clean.clean_phone, {"9876543210": "+919876543210", "919876543210": "+919876543210", "+91 98765 43210": "+919876543210", "09876543210": "+919876543210", "12345": None}),
    (lambda c: text.split_person_name(c)["first"], {"Nair, Arun": "Arun", "Rajesh Kumar": "Rajesh", "Dr. Arun Nair": "Arun", "Pooja": "Pooja", "   ": None}),
    (lambda c: text.split_person_name(c)["last"], {"Nair, Arun": "Nair", "Rajesh Kumar": "Kumar", "Pooja": ""}),
    (lambda c: dates.parse_date(c)["status"], {"05/06/1991": "ambiguous", "31/02/2020": "invalid", "2021-02-30": "invalid", "": "empty", "   ": "empty", "not-a-date": "invalid", "05/05/1991": "ok", "01/02/1930": "invalid"}),
    (lambda c: dates.parse_date(c)["iso"], {"21/03/1988": "1988-03-21", "03/21/1988": "1988-03-21", "15/06/70": "1970-06-15", "15/06/10": "2010-06-15", "2019-08-01T10:00": "2019-08-01", "15-Jun-2014": "2014-06-15", "Jun 15, 2014": "2014-06-15"}),
    (lambda c: dates.parse_date(c)["dmy"], {"05/06/1991": "1991-06-05"}),
]


@pytest.mark.parametrize("column, cases", CASES, ids=range(len(CASES)))
def test_scalars(spark, column, cases):
    assert run(spark, column, list(cases)) == list(cases.values())


def test_similarity(spark):
    df = spark.createDataFrame([("Employee Number", "employee number"), ("", "x"), ("employee no", "employee number"), ("employee no", "pay date")], "a string, b string")
    got = [r[0] for r in df.select(text.similarity(F.col("a"), F.col("b"))).collect()]
    assert got[0] == 1 and got[1] == 0 and got[2] > got[3]


@pytest.mark.parametrize(
    "key, raw, value, issue",
    [
        ("email", "A@CORP.in", "a@corp.in", None),
        ("email", "v@gmail.com", "v@gmail.com", "personal_email"),
        ("email", "not an email", "not an email", "invalid"),
        ("employmentType", "Permanent", "full_time", None),
        ("status", "ACTIVE", "active", None),
        ("status", "Absconding", "Absconding", "unknown_enum"),
        ("panNumber", "abcde1234f", "ABCDE1234F", None),
        ("panNumber", "12345", "12345", "invalid"),
        ("ctcAnnual", "₹9,80,000", "980000", None),
        ("dateOfBirth", "05/06/1991", None, "ambiguous_date"),
        ("department", "n/a", None, None),
    ],
)
def test_clean_value(spark, key, raw, value, issue):
    row = spark.createDataFrame([(raw,)], "x string").select(clean.clean_value(key, F.col("x")).alias("c")).first()["c"]
    assert (row["value"], row["issue"]) == (value, issue)
