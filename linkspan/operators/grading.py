"""Completeness profile and grade of uploaded files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkspan import codes


def profile_files(rows: DataFrame) -> DataFrame:
    """One row per file: row count, nulls and shares of the graded columns.

    One aggregation over the columns that exist; columns the data does not
    have profile as ratio 0 with no nulls.
    """
    have = set(rows.columns)
    total = F.count(F.lit(1))
    share = lambda part: F.when(total > 0, part / total).otherwise(0.0)
    measures = [total.alias("total_rows")]
    for name in codes.GRADED_COLUMNS:
        if name in have:
            measures.append(share(F.count(name)).alias(f"{name}_nonnull"))
            measures.append((total - F.count(name)).alias(f"{name}_null_count"))
        else:
            measures.append(F.lit(0.0).alias(f"{name}_nonnull"))
            measures.append(F.lit(0).cast("long").alias(f"{name}_null_count"))
    if "nik" in have:
        length = F.length(F.col("nik").cast("string"))
        measures.append(share(F.count_if(length == codes.NIK_LENGTH)).alias("nik_len16"))
        measures.append(F.count_if(length != codes.NIK_LENGTH).alias("nik_not_len16_count"))
    else:
        measures.append(F.lit(0.0).alias("nik_len16"))
        measures.append(F.lit(0).cast("long").alias("nik_not_len16_count"))
    return rows.groupBy("file_id").agg(*measures)


def _grade(exists) -> Column:
    personal = codes.GRADED_COLUMNS[1:]
    no_nulls = lambda names: _all(F.col(f"{n}_null_count") == 0 for n in names)
    mostly = (
        (F.col("nama_null_count") == 0)
        & (F.col("tempat_lahir_nonnull") >= 0.7)
        & (F.col("tanggal_lahir_nonnull") >= 0.7)
        & (F.col("jenis_kelamin_nonnull") >= 0.7)
        & (F.col("nama_ibu_nonnull") >= 0.6)
    )
    has_person = _all(exists(n) for n in personal)
    with_nik = exists("nik") & has_person
    without_nik = ~exists("nik") & has_person
    return (
        F.when(with_nik & no_nulls(codes.GRADED_COLUMNS) & (F.col("nik_not_len16_count") == 0), codes.GRADE_A)
        .when(with_nik & (F.col("nik_len16") >= 0.7) & mostly, codes.GRADE_B)
        .when(without_nik & no_nulls(personal), codes.GRADE_C)
        .when(without_nik & mostly, codes.GRADE_D)
        .otherwise(codes.GRADE_E)
    )


def _all(tests) -> Column:
    out = F.lit(True)
    for test in tests:
        out = out & test
    return out


def grade_files(profiles: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Grade 1-5 per file from its profile.

    Which columns a file has comes from `columns` when all files share one
    header, else from the comma list in each row's `header` column.
    """
    if columns is None:
        header = F.split("header", ",")
        exists = lambda name: F.array_contains(header, name)
    else:
        exists = lambda name: F.lit(name in columns)
    return profiles.withColumn("grade", _grade(exists))


def apply_grades(files: DataFrame, grades: DataFrame, now: Column, took_ms: float | None = None) -> DataFrame:
    """Files with their new grade, status "graded" and grading time.

    Files that were not graded now stay as they are.
    """
    new = grades.select("file_id", F.col("grade").alias("new_grade"))
    done = F.col("new_grade").isNotNull()
    fresh = {
        "grade": F.coalesce("new_grade", "grade"),
        "processing_status": F.when(done, codes.GRADED).otherwise(F.col("processing_status")),
        "upload_timestamp": F.when(done, now).otherwise(F.col("upload_timestamp")),
    }
    if took_ms is not None:
        old = F.col("grading_time_ms") if "grading_time_ms" in files.columns else F.lit(None)
        fresh["grading_time_ms"] = F.when(done, F.lit(float(took_ms))).otherwise(old)
    return files.join(new, "file_id", "left").withColumns(fresh).drop("new_grade")
