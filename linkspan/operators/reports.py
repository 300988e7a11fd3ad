"""Reports over files and results: pages, history, dashboard, previews, exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linkspan import codes
from linkspan.operators.spread import first_of_wanted, join_unique


def label_table(spark: SparkSession, labels: dict[int, str], code: str, label: str) -> DataFrame:
    """A code table (at most five rows) as a DataFrame."""
    return spark.createDataFrame(list(labels.items()), f"{code} int, {label} string")


def with_label(df: DataFrame, labels: dict[int, str], code: str, label: str) -> DataFrame:
    """Inner join with a code table: rows with an unknown code drop out."""
    table = label_table(df.sparkSession, labels, "_code", label)
    renamed = df.withColumnRenamed(code, "_code")
    return renamed.join(F.broadcast(table), "_code").drop("_code")


def page(df: DataFrame, number: int, size: int, *order: Column) -> DataFrame:
    """One page; the last order column must be unique to make pages stable."""
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def page_info(df: DataFrame, number: int, size: int, at_least_one: bool = False) -> DataFrame:
    """total_rows, total_pages, has_next, has_prev of a paged result."""
    pages = F.ceil(F.col("total_rows") / size)
    if at_least_one:
        pages = F.greatest(pages, F.lit(1))
    return df.agg(F.count(F.lit(1)).alias("total_rows")).select(
        F.lit(number).alias("page"), F.lit(size).alias("page_size"), "total_rows",
        pages.cast("long").alias("total_pages"), (F.lit(number) < pages).alias("has_next"),
        F.lit(number > 1).alias("has_prev"),
    )


def _wanted(text: str | None) -> str:
    return (text or "").strip("'").strip()


def _codes_in(text) -> list[int]:
    return [int(part) for part in str(text or "").split(",") if part.strip()]


def by_institution(df: DataFrame, institution: str | None) -> DataFrame:
    """Case-insensitive part of the name; a blank asks for everything."""
    name = _wanted(institution)
    return df.filter(F.lower("institution_name").contains(name.lower())) if name else df


def graded_files(files: DataFrame) -> DataFrame:
    """All graded files with labels (unpaged)."""
    labelled = with_label(
        with_label(files, codes.GRADE_LABELS, "grade", "grade_label"),
        codes.PROCESS_LABELS, "processing_status", "process_label",
    )
    return labelled.select(
        "file_id", "original_filename", "institution_name", "upload_timestamp",
        F.col("grade_label").alias("grade"), "row_count",
        F.col("process_label").alias("processing_status"), "is_sync", "matching_task_status",
    )


def synced_files(files: DataFrame, institution: str | None = None, grades=None, statuses=None) -> DataFrame:
    """Files with grade and synchronisation labels, filtered (unpaged)."""
    picked = by_institution(files, institution)
    if _codes_in(grades):
        picked = picked.filter(F.col("grade").isin(_codes_in(grades)))
    if _codes_in(statuses):
        picked = picked.filter(F.col("sync_status").isin(_codes_in(statuses)))
    labelled = with_label(
        with_label(picked, codes.GRADE_LABELS, "grade", "grade_label"),
        codes.SYNC_LABELS, "sync_status", "sync_label",
    )
    return labelled.select(
        "file_id", "original_filename", "institution_name", "upload_timestamp",
        F.col("grade_label").alias("grade"), "row_count", "is_sync",
        F.col("sync_label").alias("sync_status"),
    )


def newest_first(df: DataFrame, number: int, size: int) -> DataFrame:
    return page(df, number, size, F.col("upload_timestamp").desc(), F.col("file_id"))


def page_by_day(df: DataFrame, number: int, size: int, time: str = "upload_timestamp", key: str = "file_id") -> DataFrame:
    """One page, newest first, rows without a time last; `key` is unique.

    Rows are counted by day first. The counts, one row a day, say on which days the page
    lies and how many rows of them come before it, so only the rows of these days are
    sorted, whatever the page's number.
    """
    skipped = (number - 1) * size
    day = F.to_date(time)
    days = df.groupBy(day.alias("day")).agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.orderBy(F.col("day").desc_nulls_last()))
    met = days.withColumn("upto", upto).filter(
        (F.col("upto") > skipped) & (F.col("upto") - F.col("n") < skipped + size)
    ).agg(
        F.min("day").alias("low"), F.max("day").alias("high"), F.count_if(F.col("day").isNull()).alias("no_time"),
        F.min(F.col("upto") - F.col("n")).alias("before"),
    ).first()
    if met["before"] is None:
        return df.filter(F.lit(False))
    inside = F.lit(False)
    if met["low"] is not None:
        inside = day.between(F.lit(met["low"]), F.lit(met["high"]))
    if met["no_time"]:
        inside = F.coalesce(inside, F.lit(False)) | day.isNull()
    newest = [F.col(time).desc_nulls_last(), F.col(key)]
    return df.filter(inside).orderBy(*newest).offset(skipped - met["before"]).limit(size)


def percentage(part: Column, total: Column) -> Column:
    return F.when(total > 0, F.round(part / total * 100, 2)).otherwise(0.0)


def history(files: DataFrame, results: DataFrame, institution: str | None = None,
            start: str | None = None, end: str | None = None) -> DataFrame:
    """Completed files with their counts of matches (unpaged).

    Results are counted per file before they meet the file table.
    """
    done = by_institution(files.filter(F.col("sync_status") == codes.SYNC_COMPLETED), institution)
    day = F.to_date("upload_timestamp")
    if start:
        done = done.filter(day >= F.lit(start).cast("date"))
    if end:
        done = done.filter(day <= F.lit(end).cast("date"))
    result = F.col("match_result")
    counts = results.groupBy("file_id").agg(
        F.count_if(result == codes.AUTO_MATCH).alias("total_auto_match"),
        F.count_if(result == codes.MANUAL_MATCH).alias("total_manual_match"),
        F.count_if(result.isin(*codes.UNMATCHED_RESULTS)).alias("total_unmatch"),
    )
    total = F.col("total_auto_match") + F.col("total_manual_match") + F.col("total_unmatch")
    return done.join(counts, "file_id").select(
        "file_id", "institution_name", "original_filename", "upload_timestamp", "export_status",
        "total_auto_match", "total_manual_match", "total_unmatch",
        percentage(F.col("total_unmatch"), total).alias("percentage_unmatch"),
    )


def history_page(files: DataFrame, results: DataFrame, number: int, size: int, institution: str | None = None,
                 start: str | None = None, end: str | None = None) -> DataFrame:
    """A page of `history`, newest first."""
    return page_by_day(history(files, results, institution, start, end), number, size)


def dashboard_summary(files: DataFrame) -> DataFrame:
    """Counts of files by state and grade, as one row.

    A file under way has is_sync 0 and counts as pending.
    """
    synced = F.col("is_sync") == 1
    state = lambda s: F.count_if(synced & (F.col("sync_status") == s))
    grade = lambda g: F.count_if(F.col("grade") == g)
    return files.agg(
        F.count(F.lit(1)).alias("total_files"),
        F.count_if(F.col("is_sync") == 0).alias("total_pending"),
        state(codes.SYNC_COMPLETED).alias("total_completed"),
        state(codes.SYNC_IN_PROGRESS).alias("total_in_progress"),
        state(codes.SYNC_AWAITING).alias("total_awaiting_action"),
        *[grade(g).alias(f"total_grade_{name.lower()}") for g, name in codes.GRADE_LABELS.items()],
    )


def synced_on(files: DataFrame, today: Column) -> DataFrame:
    """Files synchronised on one day, newest first."""
    picked = files.filter((F.col("is_sync") == 1) & (F.to_date("upload_timestamp") == today))
    labelled = with_label(
        with_label(picked, codes.SYNC_LABELS, "sync_status", "sync_label"),
        codes.GRADE_LABELS, "grade", "grade_label",
    )
    return labelled.select(
        "file_id", "institution_name", "original_filename", "upload_timestamp",
        F.col("sync_label").alias("sync_status"), F.col("grade_label").alias("grade"),
    ).orderBy(F.col("upload_timestamp").desc(), "file_id")


def servable(files: DataFrame, status: int) -> DataFrame:
    """Files whose preview (status 3) or review page (status 2) may be served."""
    return files.filter((F.col("is_sync") == 1) | (F.col("sync_status") == status))


def top_matches(results: DataFrame, file_id: str, n: int = codes.PREVIEW_ROWS) -> DataFrame:
    """The n best matched and the n worst unmatched rows of a file, labelled."""
    mine = results.filter(F.col("file_id") == file_id)
    labelled = with_label(mine, codes.RESULT_LABELS, "match_result", "match_result_name")
    names = lambda ids: [codes.RESULT_LABELS[i] for i in ids]
    kind = F.col("match_result_name")
    best = page(
        labelled.filter(kind.isin(names(codes.MATCHED_RESULTS))), 1, n,
        F.col("match_score").desc(), F.col("id_incoming"),
    ).withColumn("side", F.lit("match"))
    worst = page(
        labelled.filter(kind.isin(names(codes.UNMATCHED_RESULTS))), 1, n,
        F.col("match_score").asc(), F.col("id_incoming"),
    ).withColumn("side", F.lit("unmatch"))
    return best.unionByName(worst).select(
        "side", "file_id", "id_incoming", "nik_master", "match_score", "match_result_name"
    )


def review_queue(results: DataFrame, manual: DataFrame, file_id: str | None = None) -> DataFrame:
    """Rows in review with their reasons (unpaged)."""
    mine = results.filter(F.col("match_result") == codes.REVIEW)
    if file_id is not None:
        mine = mine.filter(F.col("file_id") == file_id)
        manual = manual.filter(F.col("file_id") == file_id)
    labelled = with_label(mine, codes.RESULT_LABELS, "match_result", "match_result_name")
    reasons = manual.select("file_id", "id_incoming", "reason")
    return labelled.join(reasons, ["file_id", "id_incoming"]).select(
        "file_id", "id_incoming", "nik_master", "match_score", "match_result_name", "reason"
    )


def review_page(results: DataFrame, manual: DataFrame, file_id: str, number: int,
                size: int = codes.PAGE_REVIEW) -> DataFrame:
    return page(
        review_queue(results, manual, file_id), number, size,
        F.col("match_score").asc(), F.col("id_incoming").asc(),
    )


def registry_rows(master: DataFrame, niks: DataFrame) -> DataFrame:
    """Registry rows of the given niks, each once: of several rows of a nik the smallest."""
    return first_of_wanted(master.select(*codes.MASTER_COLUMNS), "nik", niks)


def uploaded_rows(curated: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of the given ids; the ids take the type of the file's id column."""
    wanted = ids.select("file_id", F.col("id").cast(curated.schema["id"].dataType).alias("id"))
    return curated.join(wanted.distinct(), ["file_id", "id"], "left_semi")


def side_by_side(rows: DataFrame, incoming: DataFrame, master: DataFrame) -> DataFrame:
    """Result rows as nested (institution, master): the uploaded row with score,
    label and reason, beside the registry row; missing parts are null."""
    extra = ["match_score", F.col("match_result_name").alias("match_result_desc")]
    if "reason" in rows.columns:
        extra.append("reason")
    uploaded = incoming.withColumnRenamed("id", "id_incoming")
    raw = [c for c in uploaded.columns if c not in ("id_incoming", "file_id")]
    registry = registry_rows(master, rows.select(F.col("nik_master").alias("nik"))).select(
        F.col("nik").alias("nik_master"), F.struct(*codes.MASTER_COLUMNS).alias("master")
    )
    joined = join_unique(rows.join(
        uploaded.withColumn("id_incoming", F.col("id_incoming").cast("string")),
        ["file_id", "id_incoming"], "left",
    ), registry, "nik_master", ["file_id", "id_incoming"])
    keep = [c for c in ("side",) if c in rows.columns]
    return joined.select(
        *keep, "file_id", "id_incoming",
        F.struct(F.col("id_incoming").alias("id"), *raw, *extra, "file_id").alias("institution"),
        "master",
    )


def export_matched(results: DataFrame, incoming: DataFrame, master: DataFrame) -> DataFrame:
    """Matched rows as uploaded, without the internal id, beside the registry row."""
    raw = [c for c in incoming.columns if c not in ("id", "file_id")]
    keys = results.filter(F.col("match_result").isin(*codes.MATCHED_RESULTS)).select(
        "file_id", F.col("id_incoming").alias("id"), "nik_master"
    )
    registry = registry_rows(master, keys.select(F.col("nik_master").alias("nik"))).select(
        F.col("nik").alias("nik_master"),
        *[F.col(c).alias(f"master_{c}") for c in codes.MASTER_COLUMNS],
    )
    uploaded = keys.join(incoming, ["file_id", "id"], "left")
    return join_unique(uploaded, registry, "nik_master", ["file_id", "id"]).select(
        "file_id", *raw, *[f"master_{c}" for c in codes.MASTER_COLUMNS]
    )


def export_unmatched(results: DataFrame, incoming: DataFrame) -> DataFrame:
    """Unmatched rows as uploaded, without the internal id."""
    raw = [c for c in incoming.columns if c not in ("id", "file_id")]
    keys = results.filter(F.col("match_result").isin(*codes.UNMATCHED_RESULTS)).select(
        "file_id", F.col("id_incoming").alias("id")
    )
    return keys.join(incoming, ["file_id", "id"], "left").select("file_id", *raw)
