import datetime as dt

import pytest
from pyspark.sql import functions as F

from linkspan.functions import text as tx
from linkspan.operators import grading
from linkspan.operators.clean import clean_incoming, clean_master
from linkspan import codes

DATES = {
    "1/2/1990": dt.date(1990, 2, 1), "01/02/1990": dt.date(1990, 2, 1), "01-02-1990": dt.date(1990, 2, 1),
    "01 02 1990": dt.date(1990, 2, 1), " 01-FEB-1990 ": dt.date(1990, 2, 1), "01 February 1990": dt.date(1990, 2, 1),
    "1 feb 1990": dt.date(1990, 2, 1), "1990-02-01": dt.date(1990, 2, 1), "1990-2-1": dt.date(1990, 2, 1),
    "31/02/1990": None, "1899-12-31": None, "1900-01-01": dt.date(1900, 1, 1), "01/02-1990": None,
    "01/02/90": None, "junk": None, "": None, None: None, "1990": None, "1990-02": None,
}


def test_birth_dates(spark):
    df = spark.createDataFrame([(d,) for d in DATES], "tanggal_lahir string")
    for row in clean_incoming(df).collect():
        assert row["tanggal_lahir_clean"] == DATES[row["tanggal_lahir"]], row


def test_text_gender_and_life(spark):
    df = spark.createDataFrame(
        [("\t Budi S  \n", " LAKI LAKI", "Wafat"), ("", "female", "x"), (None, "?", "H")],
        "` NAMA ` string, Jenis_Kelamin string, status_hidup string",
    )
    rows = clean_incoming(df).select("nama_clean", "jenis_kelamin_clean", "status_hidup_clean").collect()
    assert [tuple(r) for r in rows] == [("budi s", "l", "m"), ("", "p", None), (None, None, "h")]


def test_file_without_birth_date(spark):
    df = clean_incoming(spark.createDataFrame([(" 1 ", "A")], "id string, nama string"))
    assert "tanggal_lahir_clean" not in df.columns
    assert df.first()["id"] == "1"


def test_master(spark):
    row = ("1", " A ", "B", "C", "D", "E", "F", "01/02/1990", "laki-laki", "G", "mati")
    df = clean_master(spark.createDataFrame([row], ", ".join(f"{c} string" for c in codes.MASTER_COLUMNS)))
    got = df.first()
    assert got["nama_master_clean"] == "a" and got["tanggal_lahir_master_clean"] is None
    assert got["jenis_kelamin_master_clean"] == "l" and got["status_hidup_master_clean"] == "m"


def test_nan_and_infinity(spark):
    df = spark.createDataFrame([(float("nan"), "a"), (float("inf"), "b"), (1.5, "c"), (None, "d")], "v double, s string")
    assert [r[0] for r in tx.finite_or_null(df).collect()] == [None, None, 1.5, None]


def test_masking(spark):
    text = "nik 3200000000000123, 32000000000001234 x3200000000000123 3200000000000999."
    row = spark.createDataFrame([(text,)], "t string").select(
        tx.mask_ids(F.col("t")).alias("m"), tx.mask_ids(F.col("t"), "redact").alias("r")).first()
    assert row["m"] == "nik *************123, 32000000000001234 x3200000000000123 *************999."
    assert row["r"] == "nik [REDACTED], 32000000000001234 x3200000000000123 [REDACTED]."


FULL = ("3200000000000001", "a", "b", "c", "l", "d")


def graded(spark, rows, columns):
    schema = ", ".join(f"{c} string" for c in ("file_id", *columns))
    df = spark.createDataFrame([("f", *r) for r in rows], schema)
    return grading.grade_files(grading.profile_files(df), list(columns)).first()


@pytest.mark.parametrize("rows, columns, want", [
    ([FULL] * 10, codes.GRADED_COLUMNS, 1),
    ([FULL] * 8 + [("12", *FULL[1:]), (None, *FULL[1:])], codes.GRADED_COLUMNS, 2),
    ([FULL] * 6 + [("12", *FULL[1:])] * 4, codes.GRADED_COLUMNS, 5),
    ([FULL] * 9 + [(FULL[0], None, *FULL[2:])], codes.GRADED_COLUMNS, 5),
    ([FULL[1:]] * 10, codes.GRADED_COLUMNS[1:], 3),
    ([FULL[1:]] * 7 + [("a", None, None, None, None)] * 3, codes.GRADED_COLUMNS[1:], 4),
    ([FULL[1:]] * 6 + [("a", None, None, None, None)] * 4, codes.GRADED_COLUMNS[1:], 5),
    ([FULL[:5]] * 3, codes.GRADED_COLUMNS[:5], 5),
    ([("3200000000000001", "", "", "", "", "")] * 3, codes.GRADED_COLUMNS, 1),
])
def test_grades(spark, rows, columns, want):
    assert graded(spark, rows, columns)["grade"] == want


def test_profile_ignores_null_niks_in_the_length_count(spark):
    rows = [FULL] * 2 + [(None, *FULL[1:]), ("12", *FULL[1:])]
    p = graded(spark, rows, codes.GRADED_COLUMNS)
    assert (p["nik_len16"], p["nik_not_len16_count"], p["nik_null_count"], p["total_rows"]) == (0.5, 1, 1, 4)
