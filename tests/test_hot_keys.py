"""Joins with one row per key, where one key has half of all rows."""

import random

import pytest
from pyspark.sql import functions as F

from linkspan.operators import reasons, reports, spread
from linkspan.plans.fixtures import derive

SF = "/root/testdata/sf0.001"


@pytest.fixture
def forced(monkeypatch):
    monkeypatch.setattr(spread, "KEYS_SENT", 0)
    monkeypatch.setattr(spread, "PART_ROWS", 10)


def rows_of(spark, seed=4):
    rng = random.Random(seed)
    keys = ["hot"] * 400 + [f"k{rng.randrange(60)}" for _ in range(300)] + [None] * 100
    return [(i, key) for i, key in enumerate(keys)]


@pytest.mark.parametrize("how", ["inner", "left"])
def test_hot_key_keeps_every_row(spark, forced, how):
    rows = rows_of(spark)
    unique = [("hot", 1)] + [(f"k{i}", i + 2) for i in range(50)] + [("unused", 0)]
    left = spark.createDataFrame(rows, "id long, key string")
    joined = spread.join_unique(left, spark.createDataFrame(unique, "key string, v int"), "key", ["id"], how)
    value = dict(unique)
    want = [(i, k, value.get(k)) for i, k in rows if how == "left" or k in value]
    assert sorted((r["id"], r["key"], r["v"]) for r in joined.collect()) == want
    assert joined.columns == ["key", "id", "v"]


def test_hot_key_is_cut(spark, forced):
    left = spark.createDataFrame(rows_of(spark), "id long, key string")
    unique = spark.createDataFrame([("hot", 1), ("k1", 2)], "key string, v int")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = spread.join_unique(left, unique, "key", ["id"], "inner").where("key = 'hot'")
        sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sum(sizes) == 400 and max(sizes) < 150  # whole it would be one of 400


@pytest.mark.parametrize("how", ["left", "left_semi"])
def test_file_table_is_not_sent_in_copies(spark, monkeypatch, how):
    """Few files are sent once each; the copies of many are shuffled, though the planner counts them once."""
    given = [(i, key) for i, key in rows_of(spark)]
    named = [("hot", 1), ("hot", 1), ("k1", 2), (None, 3), ("unused", 4)]
    rows = spark.createDataFrame(given, "id long, file_id string")
    files = spark.createDataFrame(named, "file_id string, v int")
    of = {key: [v for k, v in named if k == key] for key in {"hot", "k1"}}
    if how == "left":
        want = sorted(str((key, i, v)) for i, key in given for v in of.get(key, [None]))
    else:
        want = sorted(str((key, i)) for i, key in given if key in of)
    for sent, kind, copies in ((200_000, "BroadcastHashJoin", False), (0, "SortMergeJoin", True)):
        monkeypatch.setattr(spread, "KEYS_SENT", sent)
        joined = spread.join_by_file(rows, files, "id", how)
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert kind in plan and ("explode" in plan) == copies
        assert ("Broadcast" in plan) == (not copies)
        assert sorted(str(tuple(r)) for r in joined.collect()) == want


def test_smallest_row_of_each_wanted_key(spark, monkeypatch):
    table = spark.createDataFrame([("a", 2, "x"), ("a", 1, "z"), ("a", 1, None), ("b", 5, "y"), (None, 0, "n")],
                                  "nik string, n int, s string")
    wanted = spark.createDataFrame([("a",), ("a",), (None,), ("c",)], "nik string")
    for sent in (10, 0):
        monkeypatch.setattr(spread, "KEYS_SENT", sent)
        got = [tuple(r) for r in spread.first_of_wanted(table, "nik", wanted).collect()]
        assert got == [("a", 1, None)]
    assert spread.first_of_wanted(table.limit(0), "nik", wanted).count() == 0


def test_reasons_and_export_with_a_hot_nik(spark, monkeypatch):
    """Half of the review rows and of the results name one nik: the forced way gives the same rows."""
    master = derive(spark, SF, "master_v").limit(40)
    nik = master.orderBy("nik").first()["nik"]
    master = master.unionByName(master.where(F.col("nik") == nik).withColumn("nama_lengkap", F.lit("AAA")))
    half = F.pmod(F.xxhash64("id_incoming"), F.lit(2)) == 0
    results = derive(spark, SF, "partners_v").withColumn("nik_master", F.when(half, nik).otherwise(F.col("nik_master")))
    manual = derive(spark, SF, "manual_v").withColumn("nik_incoming", F.when(half, nik).otherwise(F.col("nik_incoming")))
    incoming = derive(spark, SF, "incoming_v")

    def both():
        pairs = reasons.comparison_pairs(manual, results, master, statuses=None)
        out = reports.export_matched(results, incoming, master)
        return sorted(map(str, pairs.collect())), sorted(map(str, out.collect()))

    plain = both()
    monkeypatch.setattr(spread, "KEYS_SENT", 0)
    monkeypatch.setattr(spread, "PART_ROWS", 10)
    assert both() == plain
    assert len(plain[0]) > 20 and any("AAA" in row for row in plain[0])
