"""Pages by day, and children of the latest version, against plain programs."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from linkspan.operators import reports, spread

RNG = random.Random(1)
ROWS = [
    (f"f{i}", None if i % 11 == 0 else dt.datetime(2024, 1, RNG.randint(1, 6), RNG.randint(0, 23)), i) for i in range(60)
]


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame(ROWS, "file_id string, upload_timestamp timestamp, n int").repartition(4)


@pytest.mark.parametrize("number, size", [(1, 7), (3, 7), (8, 7), (9, 7), (10, 7), (1, 100), (2, 100), (60, 1)])
def test_page_by_day(files, number, size):
    order = sorted(ROWS, key=lambda r: (r[1] is None, -(r[1] or dt.datetime(1970, 1, 2)).timestamp(), r[0]))
    got = [r["file_id"] for r in reports.page_by_day(files, number, size).collect()]
    assert got == [r[0] for r in order[(number - 1) * size:number * size]]


def test_only_the_days_of_the_page_are_sorted(files):
    plan = reports.page_by_day(files.where("upload_timestamp is not null"), 2, 7)
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert "2024-01-01" not in text and "upload_timestamp" in text
    assert reports.page_by_day(files.where("false"), 1, 5).count() == 0


def test_children_in_order(spark):
    rows = [(k, v, t, f"{k}{v}{t}") for k in ("a", "b", None) for v in range(3) for t in range(4) if k != "b" or v < 2]
    RNG.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, v int, t int, said string")
    got = spread.ordered_children_of_latest(df.where("k is not null"), ["k"], "v", ["t"], ["said"]).collect()
    assert {(r["k"], r["v"]): [x["said"] for x in r["items"]] for r in got} == {
        ("a", 2): [f"a2{t}" for t in range(4)], ("b", 1): [f"b1{t}" for t in range(4)],
    }
    assert spread.ordered_children_of_latest(df.where("false"), ["k"], "v", ["t"], ["said"]).count() == 0
    assert df.where(F.col("k").isNull()).count() == 12
