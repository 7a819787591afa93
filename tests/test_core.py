import hashlib
import hmac
import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from maskwright.functions.replace import DEMO_KEY, hmac_hex, replace
from maskwright.operators import scan, textutil
from maskwright.plans import queries as core
from maskwright.rules import BUILT_IN, Rule

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in os.listdir(SF):
        con.execute(f"create view {t[:-8]} as select * from read_parquet('{SF}/{t}')")
    return con


@pytest.mark.parametrize("name", sorted(core.QUERIES))
def test_query_equals_its_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(map(str, (tuple(r) for r in df.select(*cols).collect())))
    want = sorted(map(str, duck.execute(f"select {', '.join(cols)} from ({entry.oracle_sql()[name]})").fetchall()))
    assert got == want


def test_hmac_equals_python(spark):
    row = spark.createDataFrame([("jürgen@example.org",)], "v string").select(hmac_hex(F.col("v"), "email", DEMO_KEY)).first()
    assert row[0] == hmac.new(DEMO_KEY, b"email\0" + "jürgen@example.org".encode(), hashlib.sha256).hexdigest()


def test_first_group_alone_is_replaced(spark):
    rules = [r for r in BUILT_IN if r.label == "password_kv"]
    df = spark.createDataFrame([("a password=hunter2secret,ssl=True",), (None,), ("",)], "t string")
    got = [r[0] for r in scan.redact(df, "t", rules).select("sanitized").collect()]
    assert got[0].startswith("a password=") and got[0].endswith(",ssl=True") and "hunter2" not in got[0] and got[1:] == ["", ""]


def test_longest_of_equal_starts_wins(spark):
    rules = [Rule("ab", "auth_token", "short"), Rule("abc", "auth_token", "long"), Rule("bcd", "auth_token", "later")]
    df = spark.createDataFrame([("xabcd",)], "t string")
    got = scan.with_matches(df, "t", rules).select(F.transform("matches", lambda m: m["hit"])).first()[0]
    assert got == ["abc"]


def test_masks_stay_and_length_is_kept(spark):
    df = spark.createDataFrame([("***",), ("sk-abcdefghijklmnopqrst",)], "v string")
    got = [r[0] for r in df.select(replace(F.col("v"), "auth_token")).collect()]
    assert got[0] == "***" and len(got[1]) == 23 and got[1].startswith("__SANITIZED_")


def test_allow_regex_and_order(spark):
    df = spark.createDataFrame([("Build-7",), ("x",)], "v string")
    got = [r[0] for r in df.select(textutil.allowed(F.col("v"), ["regex:^Build", "build-*"])).collect()]
    assert got == ["build-*", None]
