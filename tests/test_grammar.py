"""Option grammars with values worked out by hand."""

import pytest
from pyspark.sql import functions as F

from reelframe.functions import grammar
from reelframe.operators.select import StreamFilter


def each(spark, f, texts):
    return [r["x"] for r in spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k long, t string").select("k", f(F.col("t")).alias("x")).orderBy("k").collect()]


def test_options(spark):
    texts = ["name=a:b=c", r"name=a\:b:c=d", r"name=a\b\:c\d", 'x=1:name= "q" ', "name='it\"s'", "k=v:name", "other=1", "name=", r"name=\:", "surname=x", "name=a:name=b", "'name=''x''"]
    got = [x and (x["value"], x["error"]) for x in each(spark, lambda t: grammar.option(t, "name"), texts)]
    assert got == [("a", None), ("a:b", None), ("ab:c\\d", None), ("q", None), (None, "quotes"), ("true", None), None, ("", None), (":", None), ("x", None), ("a", None), ("x", None)]
    for t, x in zip(texts, got):
        if x and x[1]:
            with pytest.raises(ValueError):
                grammar._value(t, "name")
        else:
            assert grammar._value(t, "name") == (x and x[0])


def test_units(spark):
    assert each(spark, grammar.unit_seconds, ["1h2m3s", "90s", "2h", "1m1h", "", "5", "1x", "1h1h", "99999999999s", "2h5s"]) == [3723.0, 90.0, 7200.0, None, None, None, None, None, None, 7205.0]


def test_ranges(spark):
    got = [x and tuple(x) for x in each(spark, grammar.custom_range, ["1-5", "-5", "3-", "x12-7y", "1:00-2:30", "-0:10", "0:10-", "1-2-3", "5", "a:b-1:0", "", "99999999999999999999-1"])]
    assert got == [("segment", 1, 5, None, None, None), ("segment", 0, 5, None, None, None), ("segment", 3, grammar.LAST_INDEX, None, None, None), ("segment", 12, 7, None, None, None), ("time", None, None, 60.0, 150.0, None), ("time", None, None, 0.0, 10.0, None),
                   ("time", None, None, 10.0, grammar.LAST_SECOND, None), (None,) * 5 + ("start-end",), (None,) * 5 + ("start-end",), (None,) * 5 + ("time",), None, (None,) * 5 + ("index",)]


def test_headers_and_times(spark):
    assert [x and tuple(x) for x in each(spark, grammar.header, [" User-Agent : a:b ", "none", ":v"])] == [("user-agent", "a:b"), None, ("", "v")]
    assert [x and str(x) for x in each(spark, grammar.start_time, ["20240102030405", "20241302030405", "2024", "2024010203040x"])] == ["2024-01-02 03:04:05", None, None, None]
    assert each(spark, lambda t: grammar.version_behind(F.lit("0.3.0"), t), ["v0.3.0", "0.3.1", " 0.3.0 "]) == [False, True, False]


def test_filters():
    assert grammar.stream_filter("all") == StreamFilter(choice="all") and grammar.stream_filter("best2").choice == "best2"
    got = grammar.stream_filter(r'lang=en|fr:res="1920*":url=http\://x:segsMin=3:plistDurMax=1h5s:bwMin=500:role=main:for=worst')
    assert got == StreamFilter(language="en|fr", resolution="1920*", url="http://x", segments_min=3, duration_max=3605.0, bandwidth_min=500_000, role="main", choice="worst")
    for bad in ("for=some", "segsMin=x", "plistDurMin=5", "lang=("):
        with pytest.raises((ValueError, grammar.re.error)):
            grammar.stream_filter(bad)


def test_a_large_table_of_ranges_is_compiled_small(spark):
    """The expression was too large to be compiled at all; keys beyond 32 bits in minutes."""
    assert each(spark, grammar.custom_range, [f"{2**31}:05-"])[0]["start"] == 2.0**31 * 60 + 5
    df = spark.range(1).select(grammar.custom_range(F.col("id").cast("string")).alias("x"))
    assert len(df._jdf.queryExecution().optimizedPlan().toString()) < 20_000
