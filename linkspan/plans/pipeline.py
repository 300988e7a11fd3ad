"""The whole way of an upload: intake, grade, match, review, reasons, export.

Every step writes its table before the next one starts, by file where it can,
so a run that was cut short is simply started again.
"""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkspan import codes
from linkspan.operators import audit, grading, matching, reasons, review
from linkspan.operators.clean import clean_incoming
from linkspan.operators.spread import join_by_file
from linkspan.sources import intake, tables, versions
from linkspan.sources.scratch import settle


@dataclass(frozen=True)
class Store:
    """Folders of the tables."""

    root: str

    def __getattr__(self, table: str) -> str:
        return f"{self.root}/{table}"


def take_in(spark: SparkSession, folder: str, store: Store, institution: str, now: Column,
            multi_line: bool = False) -> DataFrame:
    """CSV uploads -> curated rows and graded file entries."""
    started = time.perf_counter()
    tables.write_curated(intake.read_uploads(spark, folder, multi_line), store.curated)
    rows = intake.read_curated(spark, store.curated)
    files = intake.register_files(rows, F.lit(institution), now).withColumns({
        "grade": F.lit(None).cast("int"), "is_sync": F.lit(0), "sync_status": F.lit(None).cast("int"),
        "grading_time_ms": F.lit(None).cast("double"), "matching_time_ms": F.lit(None).cast("double"),
        "export_status": F.lit(None).cast("string"), "export_match_path": F.lit(None).cast("string"),
        "export_unmatch_path": F.lit(None).cast("string"),
    })
    profiles = grading.profile_files(rows).join(files.select("file_id", "header"), "file_id")
    took = (time.perf_counter() - started) * 1000
    graded = grading.apply_grades(files, grading.grade_files(profiles), now, took)
    if versions.current(spark, store.files):  # files taken in earlier keep their state
        earlier = tables.read_table(spark, store.files)
        graded = earlier.unionByName(graded.join(earlier, "file_id", "left_anti"), allowMissingColumns=True)
    tables.replace_table(graded, store.files)
    return tables.read_table(spark, store.files)


def match(spark: SparkSession, store: Store, master: DataFrame, rules: DataFrame, now: Column) -> DataFrame:
    """Match all files that are not synchronised yet; returns the results."""
    started = time.perf_counter()
    files = tables.read_table(spark, store.files)
    waiting = files.filter(F.col("is_sync") == 0)
    rows = intake.read_curated(spark, store.curated)
    results = matching.link_files(waiting, clean_incoming(rows), master, rules)
    tables.write_results(results, store.results)
    # Earlier files keep their state: only what was matched now goes on.
    results = join_by_file(
        tables.read_by_file(spark, store.results), waiting.select("file_id"), "id_incoming", "left_semi"
    )
    manual = review.review_rows(results, rows).withColumns({
        "id": F.xxhash64("file_id", "id_incoming"),
        "reason": F.lit(None).cast("string"), "pattern_name": F.lit(None).cast("string"),
        "reasoning_source": F.lit(None).cast("string"),
    })
    tables.overwrite_files(manual, store.manual, number="id_incoming")
    took = (time.perf_counter() - started) * 1000
    done = review.finish_sync(files, matching.file_sync_status(results), took)
    event = audit.job_event(matching.match_summary(results), "MATCHING", "SUCCESS", int(took), now)
    tables.replace_table(done, store.files)
    tables.append_events(event, store.audit)  # last: a run cut short before leaves no event
    return tables.read_by_file(spark, store.results)


MANUAL_SCHEMA = (
    "id_incoming string, nik_incoming string, nama_incoming string, tempat_lahir_incoming string, area_incoming string, "
    "tanggal_lahir_incoming string, jenis_kelamin_incoming string, nama_ibu_incoming string, reasoning_status string, "
    "id long, reason string, pattern_name string, reasoning_source string, file_id string"
)
STATE_SCHEMA = (
    "id long, file_id string, reasoning_status string, reason string, pattern_name string, reasoning_source string, "
    "run_id string, claimed_s double"
)


def read_state(spark: SparkSession, store: Store) -> DataFrame:
    """What has become of the review rows: one row for each that a run has taken up."""
    if versions.current(spark, store.reasoned) is None:
        return spark.createDataFrame([], STATE_SCHEMA)
    return tables.read_table(spark, store.reasoned)


def read_manual(spark: SparkSession, store: Store) -> DataFrame:
    """The review rows with their present state."""
    manual = tables.read_by_file(spark, store.manual, schema=MANUAL_SCHEMA)
    changed = ["reasoning_status", "reason", "pattern_name", "reasoning_source"]
    state = read_state(spark, store).select("id", *(F.col(c).alias(f"new_{c}") for c in changed))
    return manual.join(state, "id", "left").withColumns(
        {c: F.coalesce(f"new_{c}", c) for c in changed}
    ).select(*manual.columns)


def read_patterns(spark: SparkSession, store: Store, without_run: str = "") -> DataFrame:
    """The known patterns with their hits, but for what one run has added."""
    if not tables.exists(spark, store.patterns):
        return spark.createDataFrame([], reasons.PATTERN_SCHEMA)
    found = spark.read.schema(reasons.PATTERN_SCHEMA + ", run_id string").parquet(store.patterns)
    hits = spark.read.schema("pattern_hash string, hits long, at timestamp, run_id string").parquet(store.hits)
    others = F.col("run_id") != without_run
    counted = hits.where(others).groupBy("pattern_hash").agg(F.sum("hits").alias("hits"), F.max("at").alias("at"))
    return found.where(others).join(F.broadcast(counted), "pattern_hash", "left").withColumns({  # at most 4^5 patterns
        "hit_count": F.col("hit_count") + F.coalesce("hits", F.lit(0)), "updated_at": F.greatest("updated_at", "at"),
    }).drop("hits", "at", "run_id")


def claim(spark: SparkSession, store: Store, lease_s: float = 6 * 3600.0) -> str:
    """Mark the open review rows as being worked on; the id of the run that has them.

    Open are rows that wait or have failed. Rows that another run has taken up are its
    own for `lease_s` seconds; after that it counts as lost, and its rows, with all open
    ones, go on under its id, so that what it has already written is replaced, not added to.
    """
    state = read_state(spark, store)
    clock = time.time()
    lost = state.where((F.col("reasoning_status") == codes.PROCESSING) & (F.col("claimed_s") <= clock - lease_s))
    run = lost.agg(F.min("run_id")).first()[0] or uuid.uuid4().hex
    taken = F.col("reasoning_status") == codes.PROCESSING
    own = state.where(taken & (F.col("claimed_s") > clock - lease_s)).select("id")
    manual = read_manual(spark, store).join(own, "id", "left_anti")
    mine = reasons.mark_processing(manual).where(taken).select(
        "id", "file_id", "reasoning_status", "reason", "pattern_name", "reasoning_source",
        F.lit(run).alias("run_id"), F.lit(clock).alias("claimed_s"),
    ).dropDuplicates(["id"])
    tables.replace_table(state.join(mine.select("id"), "id", "left_anti").unionByName(mine), store.reasoned)
    return run


def give_reasons(spark: SparkSession, store: Store, master: DataFrame, now: Column,
                 known: DataFrame | None = None, lease_s: float = 6 * 3600.0) -> DataFrame:
    """Explain the open review rows; files whose rows are all done await action.

    The rows are claimed first and given back with their reasons last. New patterns and
    hits are kept by run, so that a run that is started again counts nothing twice; a run
    that finds no open row explains nothing.
    """
    run = claim(spark, store, lease_s)
    mine = F.col("run_id") == run
    claimed = settle(read_state(spark, store).where(mine & (F.col("reasoning_status") == codes.PROCESSING)), "claimed")
    manual = read_manual(spark, store).join(claimed.select("id"), "id", "left_semi")
    results = tables.read_by_file(spark, store.results)
    before = settle(known if known is not None else read_patterns(spark, store, run), "known")
    pairs = settle(reasons.comparison_pairs(manual, results, master, statuses=None), "pairs")
    explained = settle(reasons.explain(pairs, before, now), "explained")
    fresh = reasons.new_patterns(reasons.detect_patterns(pairs), before, now)
    hits = explained.filter(F.col("source") == "CACHE").groupBy("pattern_hash").agg(
        F.count(F.lit(1)).alias("hits"), F.first(now).alias("at")
    )
    if claimed.limit(1).count():
        tables.overwrite_files(hits.withColumn("run_id", F.lit(run)), store.hits, by="run_id")
        tables.overwrite_files(fresh.withColumn("run_id", F.lit(run)), store.patterns, by="run_id")
    done = reasons.write_back(claimed.drop("claimed_s", "run_id"), claimed.select("id").join(explained.drop("file_id"), "id", "left"))
    finished = done.join(claimed.select("id", "run_id", "claimed_s"), "id")
    state = read_state(spark, store).join(claimed.select("id"), "id", "left_anti")
    tables.replace_table(state.unionByName(finished), store.reasoned)
    files = reasons.files_after_reasons(tables.read_table(spark, store.files), read_manual(spark, store))
    tables.replace_table(files, store.files)
    return read_manual(spark, store)


def export(spark: SparkSession, store: Store, master: DataFrame, file_id: str) -> DataFrame:
    """Close a file, write its two CSV exports and note where they are."""
    chosen = tables.find_file(tables.read_table(spark, store.files), file_id, "file_id")
    results = tables.read_by_file(spark, store.results)
    mine = results.filter(F.col("file_id") == file_id)
    tables.write_results(settle(review.close_results(mine, chosen), "results"), store.results)
    matched, unmatched = tables.export_file(
        tables.read_by_file(spark, store.results), intake.read_curated(spark, store.curated).drop("header", "path"),
        master, file_id, store.exports,
    )
    files = review.close_files(tables.read_table(spark, store.files), chosen)
    update = tables.export_update(file_id, "READY", matched, unmatched, files)
    tables.replace_table(review.set_export_status(files, update), store.files)
    return tables.find_file(tables.read_table(spark, store.files), file_id)


LOGS = dict(zip(audit.LOG_TYPES, (("audit", audit.EVENT_SCHEMA), ("access", audit.ACCESS_SCHEMA))))


def log_access(store: Store, requests: DataFrame) -> None:
    """Keep a batch of requests as access events."""
    tables.append_events(audit.access_events(requests), store.access)


def read_log(spark: SparkSession, store: Store, log_type: str) -> DataFrame:
    table, schema = LOGS[log_type]
    return tables.read_events(spark, getattr(store, table), schema)


def retain(spark: SparkSession, store: Store, policies: DataFrame, now: Column) -> DataFrame:
    """Age both logs by their policies; returns the actions kept so far.

    The rows on what was done come last, one for each log and time: a run that is started
    again with the same `now` changes nothing.
    """
    for log_type, (table, schema) in LOGS.items():
        cutoff = audit.days_before(now, audit.retention_days(policies, log_type)).cast("timestamp")
        text = spark.range(1).select(cutoff.cast("string").alias("cutoff")).first()["cutoff"]
        tables.age_events(spark, getattr(store, table), schema, text)
    done = audit.retention_actions(policies, now)
    if tables.exists(spark, store.retention):
        done = done.join(
            spark.read.schema(done.schema).parquet(store.retention), ["resource_type", "executed_at"], "left_anti"
        ).select(*done.columns)
    tables.append_rows(settle(done.coalesce(1), "actions"), store.retention)
    return spark.read.schema(done.schema).parquet(store.retention)
