"""Review rows, decisions and the states of results and files.

Tables are values here: each function returns the table as it is after the
change.  `sources.tables.overwrite_files` writes such a table back by file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkspan import codes
from linkspan.functions import text as tx
from linkspan.operators.spread import join_by_file


def area_text(*parts: str) -> Column:
    """Non-blank region names joined by a comma."""
    named = [F.nullif(tx.strip(F.col(p)), F.lit("")) for p in parts]
    return F.concat_ws(", ", *named)


def review_rows(results: DataFrame, incoming: DataFrame) -> DataFrame:
    """Rows to be reviewed by hand, with the values as they were uploaded."""
    have = set(incoming.columns)
    raw = lambda name: (F.col(name) if name in have else F.lit(None)).cast("string")
    areas = [a for a in codes.AREA_COLUMNS if a in have]
    uploaded = incoming.select(
        "file_id",
        F.col("id").alias("id_incoming"),
        raw("nik").alias("nik_incoming"),
        raw("nama").alias("nama_incoming"),
        raw("tempat_lahir").alias("tempat_lahir_incoming"),
        area_text(*areas).alias("area_incoming") if areas else F.lit(None).cast("string").alias("area_incoming"),
        raw("tanggal_lahir").alias("tanggal_lahir_incoming"),
        raw("jenis_kelamin").alias("jenis_kelamin_incoming"),
        raw("nama_ibu").alias("nama_ibu_incoming"),
    )
    open_rows = results.filter(F.col("match_result") == codes.REVIEW).select("file_id", "id_incoming")
    return uploaded.join(open_rows, ["file_id", "id_incoming"], "left_semi").withColumn(
        "reasoning_status", F.lit(codes.PENDING)
    )


def decide(results: DataFrame, decisions: DataFrame) -> DataFrame:
    """Apply reviewers' decisions (file_id, id_incoming, decision 4 or 5).

    Only rows still in review change; `changed` tells which did.
    """
    asked = decisions.filter(
        F.col("decision").isin(codes.MANUAL_MATCH, codes.MANUAL_UNMATCH)
    ).groupBy("file_id", "id_incoming").agg(F.min("decision").alias("decision"))
    changed = (F.col("match_result") == codes.REVIEW) & F.col("decision").isNotNull()
    return (
        results.join(asked, ["file_id", "id_incoming"], "left")
        .withColumn("changed", changed)
        .withColumn("match_result", F.when(F.col("changed"), F.col("decision")).otherwise(F.col("match_result")))
        .drop("decision")
    )


def close_results(results: DataFrame, file_ids: DataFrame) -> DataFrame:
    """Remaining review rows of the closed files become manual unmatches."""
    closing = file_ids.select("file_id").distinct().withColumn("closing", F.lit(True))
    shut = F.coalesce("closing", F.lit(False)) & (F.col("match_result") == codes.REVIEW)
    return (
        join_by_file(results, closing, "id_incoming")
        .withColumn("match_result", F.when(shut, codes.MANUAL_UNMATCH).otherwise(F.col("match_result")))
        .drop("closing")
    )


def close_files(files: DataFrame, file_ids: DataFrame) -> DataFrame:
    """Closed files that awaited action become completed."""
    closing = file_ids.select("file_id").distinct().withColumn("closing", F.lit(True))
    shut = F.coalesce("closing", F.lit(False)) & (F.col("sync_status") == codes.SYNC_AWAITING)
    return (
        files.join(closing, "file_id", "left")
        .withColumn("sync_status", F.when(shut, codes.SYNC_COMPLETED).otherwise(F.col("sync_status")))
        .drop("closing")
    )


def start_sync(files: DataFrame, file_ids: DataFrame) -> DataFrame:
    """Files whose match starts are in progress."""
    starting = file_ids.select("file_id").distinct().withColumn("starting", F.lit(True))
    return (
        files.join(starting, "file_id", "left")
        .withColumn(
            "sync_status",
            F.when(F.col("starting"), codes.SYNC_IN_PROGRESS).otherwise(F.col("sync_status")),
        )
        .drop("starting")
    )


def finish_sync(files: DataFrame, statuses: DataFrame, took_ms: float | None = None) -> DataFrame:
    """Matched files are synchronised, with the status their results call for."""
    new = statuses.select("file_id", F.col("sync_status").alias("new_status"))
    done = F.col("new_status").isNotNull()
    fresh = {
        "is_sync": F.when(done, 1).otherwise(F.col("is_sync")),
        "sync_status": F.coalesce("new_status", "sync_status"),
    }
    if took_ms is not None:
        old = F.col("matching_time_ms") if "matching_time_ms" in files.columns else F.lit(None)
        fresh["matching_time_ms"] = F.when(done, F.lit(float(took_ms))).otherwise(old)
    return files.join(new, "file_id", "left").withColumns(fresh).drop("new_status")


def set_export_status(files: DataFrame, updates: DataFrame) -> DataFrame:
    """Export state from (file_id, status, match_path, unmatch_path); a null
    path keeps the old one."""
    new = updates.select(
        "file_id", F.col("status").alias("new_status"),
        F.col("match_path").alias("new_match"), F.col("unmatch_path").alias("new_unmatch"),
        F.lit(True).alias("updated"),
    )
    return (
        files.join(new, "file_id", "left")
        .withColumns({
            "export_status": F.when(F.col("updated"), F.col("new_status")).otherwise(F.col("export_status")),
            "export_match_path": F.coalesce("new_match", "export_match_path"),
            "export_unmatch_path": F.coalesce("new_unmatch", "export_unmatch_path"),
        })
        .drop("new_status", "new_match", "new_unmatch", "updated")
    )


def upsert_partial(table: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """Update by key only the columns the updates bring; new keys are added.

    A null in an update leaves the old value.  Updates hold a key once.
    """
    brought = [c for c in updates.columns if c != key]
    fresh = updates.select(key, *[F.col(c).alias(f"new_{c}") for c in brought])
    return table.join(fresh, key, "full").select(
        *[
            F.coalesce(f"new_{c}", c).alias(c) if c in brought else F.col(c)
            for c in table.columns
        ]
    )
