"""State tables that are replaced as a whole, and reasons written back for good."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from linkspan import codes
from linkspan.operators import reasons
from linkspan.plans import pipeline
from linkspan.plans.fixtures import derive
from linkspan.sources import tables, versions

SF = "/root/testdata/sf0.001"


def now():
    return F.lit(dt.datetime(2024, 3, 1)).cast("timestamp")


def lost(*_):
    raise RuntimeError("lost")


def test_versions(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    assert versions.current(spark, path) is None
    with pytest.raises(ValueError):
        versions.read(spark, path)
    versions.write(spark.range(3), path)
    monkeypatch.setattr(versions, "switch", lost)
    with pytest.raises(RuntimeError):
        versions.write(versions.read(spark, path).where("id > 0"), path)
    assert versions.read(spark, path).count() == 3  # cut short before the switch
    monkeypatch.undo()
    versions.write(versions.read(spark, path).where("id > 0"), path)
    versions.write(versions.read(spark, path).where("id > 1"), path)
    assert [r[0] for r in versions.read(spark, path).collect()] == [2]
    assert versions.clear(spark, path, 3600) == 0 and versions.clear(spark, path, -1) == 3
    assert versions.read(spark, path).count() == 1 and versions.clear(spark, path, -1) == 0


@pytest.fixture
def store(spark, tmp_path):
    """Review rows, results and files as a match leaves them."""
    made = pipeline.Store(str(tmp_path / "store"))
    manual = derive(spark, SF, "manual_v").withColumns({
        "reason": F.lit(None).cast("string"), "pattern_name": F.lit(None).cast("string"),
        "reasoning_source": F.lit(None).cast("string"), "reasoning_status": F.lit(codes.PENDING),
        "id_incoming": F.col("id_incoming").cast("string"),
    }).select(*(f.split()[0] for f in pipeline.MANUAL_SCHEMA.split(", ")))
    tables.overwrite_files(manual.withColumn("id", F.col("id").cast("long")), made.manual)
    tables.overwrite_files(derive(spark, SF, "results_v").select(
        "file_id", F.col("id_incoming").cast("string").alias("id_incoming"), "nik_master", "match_result", "match_score"
    ).withColumn("match_result", F.lit(codes.REVIEW)), made.results)
    files = manual.select("file_id").distinct().withColumn("sync_status", F.lit(codes.SYNC_IN_PROGRESS))
    tables.replace_table(files, made.files)
    return made


@pytest.fixture(scope="module")
def master(spark):
    return derive(spark, SF, "master_v").drop("k")


def hits(spark, store):
    return {r["pattern_hash"]: (r["hit_count"], r["pattern_name"]) for r in pipeline.read_patterns(spark, store).collect()}


def told(df):
    return sorted((r["id"], r["reasoning_status"], str(r["reason"]), str(r["pattern_name"]), str(r["reasoning_source"])) for r in df.collect())


def test_second_run_explains_nothing(spark, store, master):
    first = pipeline.give_reasons(spark, store, master, now())
    said, counted = told(first), hits(spark, store)
    assert {s for _, s, *_ in said} <= {codes.COMPLETED, codes.FAILED} and any(s == codes.COMPLETED for _, s, *_ in said)
    done = sum(s == codes.COMPLETED for _, s, *_ in said)
    assert sum(n for n, _ in counted.values()) == done  # one for the first row of each pattern, one for each other
    assert {r["sync_status"] for r in tables.read_table(spark, store.files).collect()} == {codes.SYNC_AWAITING}
    failed = pipeline.read_state(spark, store).where(F.col("reasoning_status") == codes.FAILED).count()
    again = pipeline.give_reasons(spark, store, master, now())
    assert told(again) == said and hits(spark, store) == counted
    assert pipeline.read_state(spark, store).where(F.col("reasoning_status") == codes.FAILED).count() == failed


@pytest.mark.parametrize("calls", [2, 3])
def test_cut_short_and_run_again(spark, store, master, tmp_path, monkeypatch, calls):
    """Lost before the reasons, or before the files, are given back: the next run counts nothing twice."""
    number, replace = [0], tables.replace_table

    def some(df, path):
        number[0] += 1
        return lost() if number[0] == calls else replace(df, path)

    monkeypatch.setattr(tables, "replace_table", some)
    with pytest.raises(RuntimeError):
        pipeline.give_reasons(spark, store, master, now())
    monkeypatch.undo()
    if calls == 2:
        assert {r[0] for r in pipeline.read_manual(spark, store).select("reasoning_status").distinct().collect()} == {codes.PROCESSING}
        # Another run leaves the rows to the first while its lease lasts.
        before = told(pipeline.give_reasons(spark, store, master, now()))
        assert {s for _, s, *_ in before} == {codes.PROCESSING}
    said = told(pipeline.give_reasons(spark, store, master, now(), lease_s=0))
    done = sum(s == codes.COMPLETED for _, s, *_ in said)
    assert done and sum(n for n, _ in hits(spark, store).values()) == done
    assert {s for _, s, *_ in said} <= {codes.COMPLETED, codes.FAILED}
    assert {r["sync_status"] for r in tables.read_table(spark, store.files).collect()} == {codes.SYNC_AWAITING}


def test_known_patterns_fill_later_rows(spark, store, master):
    manual = tables.read_by_file(spark, store.manual, schema=pipeline.MANUAL_SCHEMA)
    later = manual.where("id % 2 = 1")
    tables.overwrite_files(manual.where("id % 2 = 0"), store.manual + "_even")
    half = pipeline.Store(store.root + "2")
    for name in ("results", "files"):
        source = tables.read_table(spark, store.files) if name == "files" else tables.read_by_file(spark, store.results)
        (tables.replace_table if name == "files" else tables.overwrite_files)(source, getattr(half, name))
    tables.overwrite_files(tables.read_by_file(spark, store.manual + "_even"), half.manual)
    pipeline.give_reasons(spark, half, master, now())
    before = hits(spark, half)
    both = tables.read_by_file(spark, store.manual, schema=pipeline.MANUAL_SCHEMA)
    tables.overwrite_files(both, half.manual)
    said = told(pipeline.give_reasons(spark, half, master, now()))
    after = hits(spark, half)
    assert later.count() and all(after[k][1] == before[k][1] for k in before)
    assert sum(n for n, _ in after.values()) == sum(s == codes.COMPLETED for _, s, *_ in said)


def test_no_review_rows(spark, store, master):
    empty = pipeline.Store(store.root + "3")
    tables.overwrite_files(tables.read_by_file(spark, store.manual, schema=pipeline.MANUAL_SCHEMA).where("false"), empty.manual)
    tables.overwrite_files(tables.read_by_file(spark, store.results), empty.results)
    tables.replace_table(tables.read_table(spark, store.files), empty.files)
    assert pipeline.give_reasons(spark, empty, master, now()).count() == 0
    assert pipeline.read_patterns(spark, empty).count() == 0
    assert tables.read_table(spark, empty.files).count() == tables.read_table(spark, store.files).count()
