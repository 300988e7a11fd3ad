import random

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from linkspan.functions.similarity import jaro_winkler, jaro_winkler_arrow, jaro_winkler_text

KNOWN = [
    ("martha", "marhta", 0.961111), ("dixon", "dicksonx", 0.813333), ("dwayne", "duane", 0.84),
    ("abc", "xyz", 0.0), ("a", "a", 1.0), ("ab", "ba", 0.0), ("", "abc", 0.0), (None, "abc", 0.0),
]


def test_known_values_on_columns(spark):
    df = spark.createDataFrame([(a, b, s) for a, b, s in KNOWN], "a string, b string, s double")
    for row in df.withColumn("jw", jaro_winkler("a", "b")).collect():
        assert row["jw"] == pytest.approx(row["s"], abs=1e-6)


def test_dates_and_numbers_compare_as_text(spark):
    row = spark.range(1).select(
        jaro_winkler(F.lit("1990-01-02").cast("date"), F.lit("1990-01-02")).alias("d"),
        jaro_winkler(F.lit(12345), F.lit("12345")).alias("n"),
    ).first()
    assert (row["d"], row["n"]) == (1.0, 1.0)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.text("abc é😀", max_size=12), st.text("abc é😀", max_size=12)), min_size=1, max_size=20))
def test_batch_equals_single(pairs):
    left, right = pa.array([a for a, _ in pairs]), pa.array([b for _, b in pairs])
    got = jaro_winkler_arrow(left, right)
    for value, (a, b) in zip(got, pairs):
        assert value == pytest.approx(jaro_winkler_text(a, b), abs=1e-12)


def test_long_strings_are_compared_whole():
    random.seed(3)
    pairs = []
    for n in (60, 63, 64, 65, 200):
        a = "".join(random.choice("abcdef") for _ in range(n))
        pairs.append((a, a[:-1] + "z"))
        pairs.append((a, "q" + a))
    got = jaro_winkler_arrow(pa.array([a for a, _ in pairs]), pa.array([b for _, b in pairs]))
    for value, (a, b) in zip(got, pairs):
        assert value == pytest.approx(jaro_winkler_text(a, b), abs=1e-12)
        assert 0.9 < value < 1.0 or b.startswith("q")
