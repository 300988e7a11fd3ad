"""Logs by day with retention, and the number of files that a write by file makes."""

from pathlib import Path

from pyspark.sql import functions as F

from linkspan.operators import audit
from linkspan.plans import pipeline
from linkspan.sources import tables

NOW = "2024-01-20 12:00:00"


def now():
    return F.lit(NOW).cast("timestamp")


def requests(spark, times):
    rows = [(t, "READ", "REPORT", f"r{i}", "10.0.0.1", "SUCCESS", i) for i, t in enumerate(times)]
    return spark.createDataFrame(
        rows, "t string, action string, resource_type string, resource_id string, ip_address string, result string, latency_ms int"
    ).withColumn("event_time", F.col("t").cast("timestamp")).drop("t")


def folders(path):
    return {str(p.relative_to(path)): p.stat().st_mtime_ns for p in sorted(Path(path).rglob("*.parquet"))}


def test_whole_days_go_and_the_edge_day_is_cut(spark, tmp_path):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    store = pipeline.Store(str(tmp_path))
    times = ["2024-01-01 00:00:00", "2024-01-10 11:59:59", "2024-01-10 12:00:00", "2024-01-15 00:00:00", None]
    pipeline.log_access(store, requests(spark, times))
    policies = spark.createDataFrame([(7, "ACCESS_LOG", 10, "ACTIVE")], "id int, resource_type string, retention_days int, status string")
    before = folders(store.access)
    actions = pipeline.retain(spark, store, policies, now())
    assert {(r["resource_type"], r["policy_id"]) for r in actions.collect()} == {("ACCESS_LOG", 7), ("AUDIT_LOG", 0)}
    log = pipeline.read_log(spark, store, "ACCESS_LOG")
    assert sorted(r["resource_id"] for r in log.collect()) == ["r2", "r3", "r4"]
    assert pipeline.read_log(spark, store, "AUDIT_LOG").count() == 0
    first = folders(store.access)
    untouched = {k for k in before if "2024-01-15" in k or "HIVE" in k}
    assert untouched and all(first[k] == before[k] for k in untouched)
    assert pipeline.retain(spark, store, policies, now()).count() == 2
    assert folders(store.access) == first


def test_an_edge_day_without_rest_goes(spark, tmp_path):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    path = str(tmp_path / "log")
    tables.append_events(audit.access_events(requests(spark, ["2024-01-10 01:00:00", "2024-01-12 01:00:00"])), path)
    tables.age_events(spark, path, audit.ACCESS_SCHEMA, "2024-01-10 12:00:00")
    assert [r["resource_id"] for r in tables.read_events(spark, path, audit.ACCESS_SCHEMA).collect()] == ["r1"]
    assert not (tmp_path / "log" / "day=2024-01-10").exists()


def test_dashboards_read_the_stored_log(spark, tmp_path):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    store = pipeline.Store(str(tmp_path))
    pipeline.log_access(store, requests(spark, ["2024-01-19 01:00:00", "2024-01-19 01:30:00"]).withColumn("actor_user_id", F.lit("me")))
    log = pipeline.read_log(spark, store, "ACCESS_LOG")
    counts = audit.outcome_counts(pipeline.read_log(spark, store, "AUDIT_LOG"), log, audit.in_period("weekly", now())).first()
    assert (counts["success"], counts["failed"]) == (2, 0)
    assert {r["actor_user_id"] for r in log.collect()} == {"me"}


def test_files_written_don_t_grow_with_tasks(spark, tmp_path):
    path = str(tmp_path / "curated")
    rows = spark.range(0, 40_000, 1, 32).select(
        F.when(F.col("id") % 2 == 0, "large").otherwise(F.concat(F.lit("small"), F.col("id") % 50)).alias("file_id"),
        F.sha2(F.col("id").cast("string"), 512).alias("text"),
    )
    tables.overwrite_files(rows, path)
    assert len(folders(path)) <= 30  # 26 uploads, each in all 32 tasks
    assert spark.read.parquet(path).exceptAll(rows.select("text", "file_id")).count() == 0
    advisory = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(advisory)
    spark.conf.set(advisory, "400KB")
    try:
        tables.overwrite_files(rows, path)
    finally:
        spark.conf.set(advisory, before)
    made = [Path(name).parts[0] for name in folders(path)]
    assert made.count("file_id=large") > 2  # cut by size
    assert len(made) < 80 and spark.read.parquet(path).count() == 40_000


def test_a_large_upload_from_one_task_is_cut(spark, tmp_path, monkeypatch):
    rows = spark.range(0, 600_000, 1, 1).select(
        F.lit("large").alias("file_id"), (F.col("id") + 1).cast("string").alias("id"),
        F.sha2(F.col("id").cast("string"), 256).alias("text"),
    )
    small = spark.createDataFrame([("small", "1", "x"), ("small", "two", "y"), ("small", None, "z")], "file_id string, id string, text string")
    advisory = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(advisory)
    monkeypatch.setattr(tables, "SHARE_BYTES", 1 << 20)
    tables.write_curated(rows.union(small), str(tmp_path / "curated"))
    assert spark.conf.get(advisory) == before
    made = [Path(name).parts[0] for name in folders(str(tmp_path / "curated"))]
    assert made.count("file_id=large") == 3 and made.count("file_id=small") <= 2  # pieces of 250,000 rows
    back = spark.read.parquet(str(tmp_path / "curated")).select(*rows.columns)
    assert back.count() == 600_003 and back.exceptAll(rows.union(small)).count() == 0


def test_sizes_are_read_as_spark_writes_them():
    sizes = {"64MB": 64 << 20, "16m": 16 << 20, "67108864b": 64 << 20, "400KB": 400 << 10, "1g": 1 << 30, "123": 123}
    assert {size: tables._byte_count(size) for size in sizes} == sizes


def test_totals_tell_ids_and_id_numbers_apart(spark, monkeypatch):
    from linkspan.plans import catalogue

    monkeypatch.setattr(catalogue, "_SHARE_ROWS", 50)
    schema = "file_id string, id string, nik string, nama_ibu string, tanggal_lahir string"

    def totals(ids):
        rows = [("f", i and str(i), None if n % 3 == 0 else f"n{n % 7}", None, "x") for n, i in enumerate(ids)]
        return catalogue._totals(spark.createDataFrame(rows, schema)).first()

    good = totals(range(1, 201))
    assert tuple(good) == (200, 133, 7, 0, 200, True)
    for ids in ([*range(1, 200), 199], [*range(1, 200), 201], range(2, 202), [*range(1, 200), None], [1, 1, 3], [-1, 1, 2]):
        assert totals(ids)["dense_ids"] is False
