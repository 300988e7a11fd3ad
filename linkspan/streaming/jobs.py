"""Streams over the batch operators.

Each job runs the batch code on the new data of a trigger.  Results are written
by file, so a trigger that is run again after a failure replaces its own output.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from linkspan.operators import reasons
from linkspan.operators.clean import clean_incoming
from linkspan.operators.grading import grade_files, profile_files
from linkspan.operators.matching import link_files
from linkspan.operators.spread import join_by_file
from linkspan.sources.intake import file_key, one_key_each, read_curated, with_row_ids
from linkspan.sources.scratch import settle
from linkspan.sources.tables import overwrite_files


def watch_uploads(spark: SparkSession, folder: str, header: list[str], curated: str, grades: str,
                  checkpoint: str) -> StreamingQuery:
    """New CSV files of one layout -> curated Parquet and a grade per file.

    Row ids come from the order of the rows in each file's pieces.
    """
    schema = ", ".join(f"`{name}` string" for name in header)
    stream = (
        spark.readStream.schema(schema).option("header", True).option("pathGlobFilter", "*.csv")
        .csv(folder)
        .select("*", F.col("_metadata.file_path").alias("path"), file_key().alias("upload_key"),
                F.col("_metadata.file_block_start").alias("block_start"))
    )

    def handle(batch: DataFrame, _: int) -> None:
        named = [c.strip().lower() for c in header]
        rows = with_row_ids(batch).select(
            F.col("upload_key").alias("file_id"), "path", "id",
            *[F.col(f"`{raw}`").alias(name) for raw, name in zip(header, named)],
        )
        placed = settle(rows, "uploads")
        one_key_each(placed.select("file_id", "path"))
        kept = placed.drop("path")
        overwrite_files(kept, curated, number="id")
        overwrite_files(grade_files(profile_files(kept), named).select("file_id", "grade", "total_rows"), grades)

    return (
        stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def watch_matches(spark: SparkSession, curated: str, graded: str, graded_schema: str,
                  master: DataFrame, rules: DataFrame, results: str, checkpoint: str,
                  now: Column) -> StreamingQuery:
    """Newly graded files -> match results against the registry.

    `curated` is a path, read in each trigger: files taken in later are seen too.
    """
    stream = spark.readStream.schema(graded_schema).parquet(graded)

    def handle(batch: DataFrame, _: int) -> None:
        files = settle(batch.select("file_id", "grade", now.alias("upload_timestamp")), "files")
        rows = join_by_file(read_curated(spark, curated), files.select("file_id"), "id", "left_semi")
        overwrite_files(link_files(files, clean_incoming(rows), master, rules), results, number="id_incoming")

    return (
        stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def hourly_latency(events: DataFrame, late_by: str = "2 hours") -> DataFrame:
    """Mean latency per hour over a stream of events; rows later than the
    watermark are dropped."""
    return (
        events.filter(F.col("latency_ms") > 0)
        .withWatermark("event_time", late_by)
        .groupBy(F.window("event_time", "1 hour").alias("hour"))
        .agg(F.avg("latency_ms").alias("mean"), F.count(F.lit(1)).alias("events"))
        .select(F.col("hour.start").alias("hour_start"), F.round("mean", 2).alias("latency"), "events")
    )


def keep_latency(events: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Keep the latency table up to date: changed hours go out with each trigger."""

    def handle(batch: DataFrame, number: int) -> None:
        overwrite_files(batch.withColumn("trigger", F.lit(number)), table, by="trigger")

    return (
        hourly_latency(events).writeStream.outputMode("update").foreachBatch(handle)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def read_latency(spark: SparkSession, table: str) -> DataFrame:
    """Latest state of every hour."""
    return spark.read.parquet(table).groupBy("hour_start").agg(
        F.max_by("latency", "trigger").alias("latency"), F.max_by("events", "trigger").alias("events")
    )


def watch_reasons(spark: SparkSession, pairs: DataFrame, patterns: str, explained: str,
                  checkpoint: str, now: Column) -> StreamingQuery:
    """Pairs of review rows -> reasons, with a pattern table that grows.

    `pairs` is a stream with the columns of `comparison_pairs`.  Patterns are
    kept by the trigger that found them, hits are counted from the reasons.
    """

    def handle(batch: DataFrame, number: int) -> None:
        known = _patterns_before(spark, patterns, number)
        rows = settle(batch, "pairs")
        found = settle(
            reasons.new_patterns(reasons.detect_patterns(rows), known, now), "patterns"
        )
        said = reasons.explain(rows, known, now)
        overwrite_files(said.withColumn("trigger", F.lit(number)), explained, by="trigger")
        overwrite_files(found.withColumn("trigger", F.lit(number)), patterns, by="trigger")

    return (
        pairs.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def _patterns_before(spark: SparkSession, path: str, trigger: int) -> DataFrame:
    """Patterns found by earlier triggers (none before the first)."""
    if trigger == 0:
        return spark.createDataFrame([], reasons.PATTERN_SCHEMA)
    stored = spark.read.schema(reasons.PATTERN_SCHEMA + ", trigger int").parquet(path)
    return stored.filter(F.col("trigger") < trigger).drop("trigger")
