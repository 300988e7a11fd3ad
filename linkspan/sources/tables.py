"""Writing curated uploads, results, states, events and exports."""

from __future__ import annotations

import re
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkspan import codes
from linkspan.operators.reports import export_matched, export_unmatched
from linkspan.sources import versions
from linkspan.sources.scratch import settle


_DAY = re.compile(r"day=\d{4}-\d\d-\d\d")
SHARE_BYTES = 32 << 20  # shuffled bytes that a writing task takes; it sorts their rows, which are several times as large
PIECE_ROWS = 250_000  # consecutive row numbers of a file that stay together


def _byte_count(size: str) -> int:
    """A size as Spark's settings have it: 64MB, 16m, 67108864b."""
    number, unit = re.fullmatch(r"(\d+)([kmgtp]?)b?", size.strip().lower()).groups()
    return int(number) << 10 * " kmgtp".index(unit or " ")


@contextmanager
def _bounded_shares(spark: SparkSession) -> Iterator[None]:
    """What runs inside brings rows together in shares of SHARE_BYTES at most."""
    advisory = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(advisory)
    spark.conf.set(advisory, str(min(SHARE_BYTES, _byte_count(before))))
    try:
        yield
    finally:
        spark.conf.set(advisory, before)


def overwrite_files(df: DataFrame, path: str, by: str = "file_id", number: str | None = None) -> None:
    """Replace the partitions of the files in `df` and leave all others.

    Running the same job again gives the same table. The rows are brought together by file
    first, small ones several to a task and large ones cut by their size, so that the
    number of files written doesn't grow with the number of tasks. With a column `number`,
    where `df` has it, that holds a row's number in its file, rows of a file that come from
    one task are cut too; text that is no number does no harm.
    """
    keys = [by]
    if number in df.columns:
        piece = F.floor(F.col(number).try_cast("long") / PIECE_ROWS)
        df, keys = df.withColumn("_piece", piece), [by, "_piece"]
    with _bounded_shares(df.sparkSession):
        df.hint("rebalance", *keys).drop("_piece").write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def read_by_file(spark: SparkSession, path: str, merge: bool = False, schema: str | None = None) -> DataFrame:
    """A table that is partitioned by file_id, with its ids as the text they are.

    Left to itself Spark takes ids of digits for numbers when it lists the partitions.
    With a schema a table without any row can be read too.
    """
    guess = "spark.sql.sources.partitionColumnTypeInference.enabled"
    before = spark.conf.get(guess)
    spark.conf.set(guess, "false")
    try:
        reader = spark.read.option("mergeSchema", merge)
        return (reader.schema(schema) if schema else reader).parquet(path)
    finally:
        spark.conf.set(guess, before)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is anything under a path, in whatever store it is."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def write_curated(uploads: DataFrame, path: str) -> None:
    """Uploads as Parquet, one partition per file."""
    overwrite_files(uploads, path, number="id")


def write_results(results: DataFrame, path: str) -> None:
    """Match results by file."""
    overwrite_files(results, path, number="id_incoming")


def append_rows(df: DataFrame, path: str) -> None:
    """Append events, review rows or retention actions."""
    df.write.mode("append").parquet(path)


def append_events(events: DataFrame, path: str) -> None:
    """Append audit or access events, by the day of event_time.

    Days are those of the session's time zone, which all jobs on a log must share.
    """
    days = events.withColumn("day", F.date_format("event_time", "yyyy-MM-dd"))
    with _bounded_shares(events.sparkSession):
        days.hint("rebalance", "day").write.mode("append").partitionBy("day").parquet(path)


def read_events(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The events of a log that `append_events` writes; none where it doesn't exist yet."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema + ", day string").parquet(path).drop("day")


def age_events(spark: SparkSession, path: str, schema: str, cutoff: str) -> None:
    """Drop the events before `cutoff` (a time as text, of the session's time zone).

    The day of the cutoff is the only one that is read and written again; days before it go
    as folders, days after it aren't touched, nor are events without a time. A run that was
    cut short is started again; a second one finds nothing to do.
    """
    edge = cutoff[:10]
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(place):
        return
    days = [status.getPath() for status in fs.listStatus(place)]
    gone = [day for day in days if _DAY.fullmatch(day.getName()) and day.getName() < f"day={edge}"]
    at_edge = [day for day in days if day.getName() == f"day={edge}"]
    if at_edge:
        rows = spark.read.schema(schema).parquet(at_edge[0].toString())
        old = F.col("event_time") < F.lit(cutoff).cast("timestamp")
        if rows.where(old).limit(1).count():
            kept = settle(rows.where(~old).withColumn("day", F.lit(edge)), "edge")
            if kept.limit(1).count():
                overwrite_files(kept, path, by="day")
            else:
                gone += at_edge
    for day in gone:
        fs.delete(day, True)


def write_zstd(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)


def replace_table(df: DataFrame, path: str) -> None:
    """Replace a table by a value computed from it. Readers see the old or the new one."""
    versions.write(df, path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A table that `replace_table` writes."""
    return versions.read(spark, path)


def write_export(df: DataFrame, path: str) -> None:
    """CSV with ";" and a header."""
    df.write.mode("overwrite").csv(
        path, sep=";", header=True, emptyValue="",
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
    )


def export_file(results: DataFrame, incoming: DataFrame, master: DataFrame, file_id: str,
                folder: str) -> tuple[str, str]:
    """Both CSV exports of one file; returns their paths."""
    mine = F.col("file_id") == file_id
    matched, unmatched = f"{folder}/{file_id}/match", f"{folder}/{file_id}/unmatch"
    own = incoming.filter(mine)
    done = results.filter(mine)
    write_export(export_matched(done, own, master).drop("file_id"), matched)
    write_export(export_unmatched(done, own).drop("file_id"), unmatched)
    return matched, unmatched


def find_file(files: DataFrame, file_id: str, *columns: str) -> DataFrame:
    """One file's metadata or export state."""
    return files.filter(F.col("file_id") == file_id).select(*(columns or files.columns))


def rules_by_grade(rules: DataFrame) -> DataFrame:
    """Thresholds of the known grades, one row per grade."""
    return rules.filter(F.col("grade_code").between(codes.GRADE_A, codes.GRADE_E)).dropDuplicates(["grade_code"])


def export_update(file_id: str, status: str, matched: str | None, unmatched: str | None,
                  like: DataFrame) -> DataFrame:
    """One export-state change as a row for `set_export_status`."""
    return like.sparkSession.createDataFrame(
        [(file_id, status, matched, unmatched)],
        "file_id string, status string, match_path string, unmatch_path string",
    )

