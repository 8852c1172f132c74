from pyspark.sql import functions as F

from pagelake.functions import validate as V


def _check(spark, fn, values):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    return [r.ok for r in df.select(fn("v").alias("ok")).collect()]


def test_account_name(spark):
    vals = ["ab8", "0oic", "a_b.c-d", "石の猫", "has space", "x" * 20, "x" * 21, "", "end\n"]
    assert _check(spark, V.account_name_ok, vals) == [True, True, True, False, False, True, False, True, True]


def test_mail(spark):
    vals = ["ha@gmia.com", "ha@gm@a.com", "a.b+c@ex-1.org", "x@y.c", "x@y.abcdefgh", "x@y.a|b", "@y.com"]
    assert _check(spark, V.mail_ok, vals) == [True, False, True, False, False, True, False]


def test_phone(spark):
    vals = ["+123", "+", "123", "+12a", "+" + "1" * 15, "+" + "1" * 16]
    assert _check(spark, V.phone_ok, vals) == [True, True, False, False, True, False]


def test_url_norm(spark):
    rows = [("//cdn.example.com/x.js", "https://a.example.org"), ("/wiki/Page", "https://a.example.org"),
            ("http://localhost:8080/p", None), ("ftp://10.0.0.1/f", None), ("javascript:void(0)", None),
            ("https://bad_host/x", None), ("relative/path", "https://a.example.org")]
    df = spark.createDataFrame(rows, "u string, o string")
    got = [r.n for r in df.select(V.normalize_url("u", "o").alias("n")).collect()]
    assert got == ["https://cdn.example.com/x.js", "https://a.example.org/wiki/Page", "http://localhost:8080/p",
                   "ftp://10.0.0.1/f", None, None, None]
    o = spark.createDataFrame([("http://m.x.example.net/en/25#top",)], "u string").select(V.url_origin("u")).first()[0]
    assert o == "http://m.x.example.net"
