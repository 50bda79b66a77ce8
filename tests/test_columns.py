import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidegauge.functions import epoch_ms, norm_label, norm_name, usable_number

PATTERN = re.compile(r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?")


@settings(max_examples=12, deadline=None)
@given(st.lists(st.one_of(st.text(alphabet="0123456789+-.eE \t", max_size=7), st.text(max_size=6)), min_size=80, max_size=120))
def test_numbers_are_those_of_the_pattern(spark, texts):
    texts = [t for t in texts if "\x00" not in t]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", usable_number("t").alias("v")).collect() if texts else []
    for r in got:
        t = texts[r.i].strip(" \t\n\r\x0b\f")
        want = float(t) if PATTERN.fullmatch(t) else None
        assert r.v == (want if want is not None and abs(want) < float("inf") else None), repr(t)


@pytest.mark.parametrize("text", ["1d", "1f", "0x1p3", "NaN", "Infinity", "1e999", "1,5", "", ".", "e5", "+", "1 2", "٣", "1_0", None])
def test_no_numbers(spark, text):
    assert spark.createDataFrame([(text,)], "t string").select(usable_number("t").alias("v")).first().v is None


def test_names(spark):
    r = spark.createDataFrame([(" Web_A.b c-D\t", None)], "a string, b string").select(norm_name("a").alias("n"), norm_label("a").alias("l"), norm_name("b").alias("x")).first()
    assert (r.n, r.l, r.x) == ("web-a-b-c-d", "WEB_A_B_C_D", None)


def test_times(spark):
    df = spark.createDataFrame([(1400007602.7501,), (float("nan"),), (float("inf"),), (None,)], "t double")
    assert [r.ms for r in df.select(epoch_ms(F.col("t")).alias("ms")).collect()] == [1400007602750, None, None, None]
