import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from linkspan.functions import scoring as sc
from linkspan.operators import audit, reports, review
from linkspan.operators.clean import clean_master
from linkspan.plans import pipeline
from linkspan.plans.fixtures import derive
from linkspan.sources import intake, tables

SF = "/root/testdata/sf0.001"


def now():
    return F.lit("2024-01-20 12:00:00").cast("timestamp")


def test_row_ids_are_dense_over_many_pieces(spark, tmp_path):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    try:
        for name, n in (("big.csv", 3000), ("small.csv", 10)):
            lines = ["nik,nama"] + [f"00{i},name {i}" for i in range(1, n + 1)]
            (tmp_path / name).write_text("\n".join(lines) + "\n")
        (tmp_path / "other.csv").write_text("Nama , extra\nA,\n")
        (tmp_path / "notes.txt").write_text("nik,nama\n1,x\n")
        df = intake.read_uploads(spark, str(tmp_path))
        assert df.rdd.getNumPartitions() > 3
        rows = df.collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(rows) == 3011
    for r in rows:
        if r["nik"] is not None:
            assert r["nik"] == f"00{r['id']}"  # order of the file, zeros kept
    odd = [r for r in rows if "other.csv" in r["path"]]
    assert (odd[0]["nama"], odd[0]["extra"], odd[0]["header"], odd[0]["id"]) == ("A", None, "nama,extra", "1")
    assert len({r["file_id"] for r in rows}) == 3


def test_quoted_line_breaks(spark, tmp_path):
    (tmp_path / "a.csv").write_text('nama,nik\n"two\nlines",1\nplain,2\n')
    rows = intake.read_uploads(spark, str(tmp_path), multi_line=True).orderBy("id").collect()
    assert [r["nama"] for r in rows] == ["two\nlines", "plain"]


def test_rewriting_a_file_keeps_the_others(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.write_results(spark.createDataFrame([("a", 1), ("b", 2)], "file_id string, x int"), path)
    tables.write_results(spark.createDataFrame([("a", 9)], "file_id string, x int"), path)
    assert {(r["file_id"], r["x"]) for r in spark.read.parquet(path).collect()} == {("a", 9), ("b", 2)}


def test_upsert_touches_only_what_it_brings(spark):
    table = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "id int, s string, t string")
    new = spark.createDataFrame([(2, "z"), (3, "n")], "id int, t string")
    got = sorted(tuple(r) for r in review.upsert_partial(table, new, "id").collect())
    assert got == [(1, "a", "x"), (2, "b", "z"), (3, None, "n")]


def test_decisions_only_touch_open_rows(spark):
    results = spark.createDataFrame([("f", "1", 2), ("f", "2", 1), ("g", "1", 2)], "file_id string, id_incoming string, match_result int")
    said = spark.createDataFrame([("f", "1", 4), ("f", "2", 5), ("g", "1", 7)], "file_id string, id_incoming string, decision int")
    got = {(r[0], r[1]): (r["match_result"], r["changed"]) for r in review.decide(results, said).collect()}
    assert got == {("f", "1"): (4, True), ("f", "2"): (1, False), ("g", "1"): (2, False)}


@pytest.mark.parametrize("total, number, want", [(0, 1, (0, False, False)), (10, 1, (1, False, False)), (25, 2, (3, True, True))])
def test_page_info(spark, total, number, want):
    r = reports.page_info(spark.range(total), number, 10).first()
    assert (r["total_pages"], r["has_next"], r["has_prev"]) == want


def test_periods(spark):
    times = [("2024-01-20 00:00:00",), ("2024-01-15 00:00:00",), ("2023-12-25 00:00:00",), ("2023-01-01 00:00:00",)]
    df = spark.createDataFrame(times, "event_time string").withColumn("event_time", F.col("event_time").cast("timestamp"))
    count = lambda *a: df.filter(audit.in_period(a[0], now(), *a[1:])).count()
    assert [count("daily"), count("weekly"), count("monthly"), count("???")] == [1, 2, 3, 1]
    assert count("custom", "2023-12-25", "2024-01-15") == 2
    assert count("custom") == 1


def test_retention_defaults_and_actions(spark):
    events = spark.createDataFrame(
        [(1, dt.datetime(2024, 1, 19)), (2, dt.datetime(2023, 12, 1)), (3, None)], "id int, event_time timestamp")
    none = spark.createDataFrame([], "id int, resource_type string, retention_days int, status string")
    assert {r["id"] for r in audit.keep_recent(events, none, "AUDIT_LOG", now()).collect()} == {1, 3}
    actions = audit.retention_actions(none, now()).collect()
    assert {(r["resource_type"], r["policy_id"], r["action_status"]) for r in actions} == {
        ("AUDIT_LOG", 0, "SUCCESS"), ("ACCESS_LOG", 0, "SUCCESS")}
    assert audit.retention_summary(audit.retention_actions(none, now()).limit(0)).first()["last_execution"] == "Never"


def test_upload_to_export(spark, tmp_path):
    """The whole way over derived uploads of different completeness."""
    uploads = tmp_path / "up"
    uploads.mkdir()
    rows = derive(spark, SF, "upload_rows_v").collect()
    for file_id in ("f0", "f1", "f2", "f3", "f4"):
        names = ["nik", "nama", "tempat_lahir", "tanggal_lahir", "jenis_kelamin", "nama_ibu"]
        if file_id in ("f2", "f3"):
            names = names[1:]
        lines = [",".join(names)]
        lines += [",".join((r[n] or "").strip() for n in names) for r in rows if r["file_id"] == file_id]
        (uploads / f"{file_id}.csv").write_text("\n".join(lines) + "\n")
    store = pipeline.Store(str(tmp_path / "store"))
    files = pipeline.take_in(spark, str(uploads), store, "office", now())
    grades = {r["original_filename"]: r["grade"] for r in files.collect()}
    assert grades == {"f0.csv": 1, "f1.csv": 2, "f2.csv": 3, "f3.csv": 4, "f4.csv": 5}

    master = derive(spark, SF, "master_v").drop("k")
    tables.write_zstd(master, str(tmp_path / "master"))
    master = intake.read_registry(spark, str(tmp_path / "master"))
    results = pipeline.match(spark, store, clean_master(master), sc.default_rules(spark), now())
    assert results.count() == 250
    assert results.groupBy("match_result").count().count() >= 2

    manual = pipeline.give_reasons(spark, store, master, now())
    assert manual.filter("reasoning_status = 'PENDING'").count() == 0
    assert manual.filter("reasoning_status = 'COMPLETED' and reason is null").count() == 0
    waiting = tables.read_table(spark, store.files).filter("sync_status = 2").select("file_id").first()
    file_id = (waiting or tables.read_table(spark, store.files).select("file_id").first())[0]
    entry = pipeline.export(spark, store, master, file_id).first()
    assert (entry["sync_status"], entry["export_status"]) == (3, "READY")
    own = spark.read.parquet(store.results).filter(F.col("file_id") == file_id)
    assert own.filter("match_result = 2").count() == 0 and own.count() == 50
    written = spark.read.csv(entry["export_match_path"], sep=";", header=True).count()
    written += spark.read.csv(entry["export_unmatch_path"], sep=";", header=True).count()
    assert written == 50


def test_late_rows_are_dropped_and_hours_updated(spark, tmp_path):
    from linkspan.streaming import jobs

    schema = "event_time timestamp, latency_ms long"
    at = lambda h, m=0: dt.datetime(2024, 1, 1, h, m)
    source, table, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    for batch in ([(at(1), 10), (at(2), 20)], [(at(2, 30), 40), (at(8), 5)], [(at(1, 5), 999), (at(8, 1), 7)]):
        tables.append_rows(spark.createDataFrame(batch, schema).coalesce(1), source)
        jobs.keep_latency(spark.readStream.schema(schema).parquet(source), table, state).awaitTermination()
    got = {r["hour_start"].hour: (r["latency"], r["events"]) for r in jobs.read_latency(spark, table).collect()}
    assert got == {1: (10.0, 1), 2: (30.0, 2), 8: (6.0, 2)}


def test_ids_of_digits_stay_text(spark, tmp_path):
    path = str(tmp_path / "t")
    ids = ["00123456", "1234567d", "1234567f", "12345678"]
    tables.overwrite_files(spark.createDataFrame([(i, 1) for i in ids], "file_id string, n int"), path)
    back = tables.read_by_file(spark, path)
    assert dict(back.dtypes)["file_id"] == "string"
    assert sorted(r["file_id"] for r in back.collect()) == sorted(ids)


def test_closed_files_stay_closed(spark):
    from linkspan.operators import reasons

    files = spark.createDataFrame([("a", 1), ("b", 3), ("c", None)], "file_id string, sync_status int")
    manual = spark.createDataFrame(
        [(f, "COMPLETED") for f in "abc"], "file_id string, reasoning_status string"
    )
    after = {r["file_id"]: r["sync_status"] for r in reasons.files_after_reasons(files, manual).collect()}
    assert after == {"a": 2, "b": 3, "c": None}


def test_registry_rows_once(spark):
    from linkspan import codes
    from linkspan.operators.reports import registry_rows

    rows = [tuple("1" if c == "nik" else x for c in codes.MASTER_COLUMNS) for x in "ba"]
    master = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in codes.MASTER_COLUMNS))
    found = registry_rows(master, spark.createDataFrame([("1",), ("1",)], "nik string")).collect()
    assert [set(r) for r in found] == [{"1", "a"}]


def test_uploads_have_keys_of_their_own(spark, tmp_path, monkeypatch):
    uploads, store = tmp_path / "up", pipeline.Store(str(tmp_path / "store"))
    uploads.mkdir()
    (uploads / "a.csv").write_text("nik,nama\n1,x\n")
    (uploads / "b.csv").write_text("nik,nama\n1,x\n")
    take = lambda: pipeline.take_in(spark, str(uploads), store, "office", now()).collect()
    first = {r["file_id"] for r in take()}
    assert len(first) == 2 and all(len(i) == 64 for i in first)
    assert {r["file_id"] for r in take()} == first  # the same files again
    (uploads / "a.csv").write_text("nik,nama\n1,x\n2,y\n")
    assert sorted((r["original_filename"], r["row_count"]) for r in take()) == [("a.csv", 1), ("a.csv", 2), ("b.csv", 1)]
    assert intake.read_curated(spark, store.curated).count() == 4
    monkeypatch.setattr(intake, "file_key", lambda: F.lit("k"))
    with pytest.raises(ValueError, match="same key k"):
        intake.read_uploads(spark, str(uploads))
