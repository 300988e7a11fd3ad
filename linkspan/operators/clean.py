"""Header normalisation and value cleaning of uploads and of the registry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkspan import codes
from linkspan.functions import text as tx


def normalise_headers(df: DataFrame) -> DataFrame:
    """Column names stripped and lower-cased."""
    return df.toDF(*[name.strip().lower() for name in df.columns])


def clean_incoming(df: DataFrame) -> DataFrame:
    """Add the cleaned columns of an uploaded file.

    Works on whatever columns the file has; a file without birth dates simply
    has no cleaned birth date.
    """
    df = normalise_headers(df)
    have = set(df.columns)
    fresh = {name: tx.strip(F.col(name)) for name in ("id", "nik") if name in have}
    for name in codes.TEXT_COLUMNS:
        if name in have:
            fresh[f"{name}_clean"] = tx.clean_text(F.col(name))
    if "tanggal_lahir" in have:
        fresh["tanggal_lahir_clean"] = tx.birth_date(F.col("tanggal_lahir"))
    if "jenis_kelamin" in have:
        fresh["jenis_kelamin_clean"] = tx.canonical(F.col("jenis_kelamin"), codes.GENDER_WORDS)
    if "status_hidup" in have:
        fresh["status_hidup_clean"] = tx.canonical(F.col("status_hidup"), codes.LIFE_WORDS)
    df = df.withColumns(fresh)
    if "tanggal_lahir" in have:
        df = df.withColumn("tanggal_lahir_clean", tx.plausible_birth(F.col("tanggal_lahir_clean")))
    return df


CLEAN_COLUMNS = tuple(f"{name}_clean" for name in codes.TEXT_COLUMNS) + (
    "tanggal_lahir_clean", "jenis_kelamin_clean", "status_hidup_clean",
)


def complete_clean_columns(df: DataFrame) -> DataFrame:
    """Cleaned columns the file does not have are added as nulls."""
    absent = {
        name: F.lit(None).cast("date" if name == "tanggal_lahir_clean" else "string")
        for name in CLEAN_COLUMNS
        if name not in df.columns
    }
    for name in ("nik", "file_id"):
        if name not in df.columns:
            absent[name] = F.lit(None).cast("string")
    return df.withColumns(absent) if absent else df


def clean_master(df: DataFrame) -> DataFrame:
    """The registry's eleven columns and their cleaned forms.

    Gender is brought to the same two codes as on the incoming side, so that a
    registry that spells gender out still meets the incoming "l" and "p".
    """
    df = normalise_headers(df).select(*codes.MASTER_COLUMNS)
    fresh = {"nik": F.col("nik").cast("string")}
    for name in codes.TEXT_COLUMNS:
        source = "nama_lengkap" if name == "nama" else name
        fresh[f"{name}_master_clean"] = tx.clean_text(F.col(source))
    fresh["tanggal_lahir_master_clean"] = tx.year_first_date(F.col("tanggal_lahir"))
    fresh["jenis_kelamin_master_clean"] = F.coalesce(
        tx.canonical(F.col("jenis_kelamin"), codes.GENDER_WORDS),
        tx.clean_text(F.col("jenis_kelamin")),
    )
    fresh["status_hidup_master_clean"] = tx.canonical(F.col("status_kematian"), codes.LIFE_WORDS)
    return df.withColumns(fresh)
