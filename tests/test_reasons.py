import datetime as dt

from pyspark.sql import functions as F

from linkspan.operators import reasons

FIELDS = ("nama_lengkap", "tempat_lahir", "tanggal_lahir", "jenis_kelamin", "nama_ibu")
SCHEMA = "id long, file_id string, " + ", ".join(f"{f} string" for f in FIELDS) + ", " + ", ".join(
    f"master_{f} string" for f in FIELDS)
MASTER = ("budi", "jakarta", "1990-01-01", "Laki-laki", "siti")


def pairs(spark, *rows):
    return spark.createDataFrame([(n, "f", *r, *MASTER) for n, r in enumerate(rows, 1)], SCHEMA)


def now():
    return F.lit("2024-01-01").cast("timestamp")


def test_all_equal_then_changed_and_empty(spark):
    df = pairs(spark, ("Budi", "Jakarta", "1990-01-01", "L", "Siti"),
               ("Budi Santoso", "Jakarta", None, "L", "Siti"), ("Budi", "NULL", "1990-01-01", "female", "none"))
    a, b, c = reasons.detect_patterns(df).orderBy("id").collect()
    assert a["pattern_name_suffix"] == "SEMUA_SAMA"
    assert all(a[f"status_{f}"] == "SAMA" for f in FIELDS)
    assert b["pattern_name_suffix"] == "NAMA_BEDA__TGLLAHIR_KOSONG"
    assert (b["status_nama_lengkap"], b["status_tanggal_lahir"]) == ("BEDA", "KOSONG_INCOMING")
    assert c["pattern_name_suffix"] == "TMPTLAHIR_KOSONG__GENDER_BEDA__IBU_KOSONG"
    assert a["pattern_signature"] == (
        "jenis_kelamin:SAMA|nama_ibu:SAMA|nama_lengkap:SAMA|tanggal_lahir:SAMA|tempat_lahir:SAMA")


def test_template_round_trip(spark):
    df = pairs(spark, ("Budi (x", "Bogor", "1990-01-02", "L", "Siti"))
    reason = F.lit("name BUDI (X is not budi; born Bogor, not Jakarta; {y}")
    made = df.select("*", reasons.to_template(df, reason).alias("t"))
    assert made.first()["t"] == (
        "name {incoming.nama_lengkap} is not {master.nama_lengkap}; born {incoming.tempat_lahir},"
        " not {master.tempat_lahir}; {y}")
    other = pairs(spark, ("Agus", "", None, "L", "Siti"))
    filled = other.select(reasons.fill_template(other, F.lit(made.first()["t"]))).first()[0]
    assert filled == "name Agus is not budi; born EMPTY, not jakarta; {y}"


def test_dates_show_day_first(spark):
    df = pairs(spark, ("Budi", "Jakarta", "1990-01-02", "L", "Siti")).withColumn(
        "tanggal_lahir", F.col("tanggal_lahir").cast("date")).withColumn(
        "master_tanggal_lahir", F.col("master_tanggal_lahir").cast("date"))
    stated = reasons.detect_patterns(df)
    assert stated.select(reasons.describe(stated)).first()[0] == "Date of Birth: 02-01-1990 vs 01-01-1990"
    tpl = df.select(reasons.to_template(df, F.lit("02-01-1990 / 01-01-1990"))).first()[0]
    assert tpl == "{incoming.tanggal_lahir} / {master.tanggal_lahir}"


def test_second_run_is_all_cache(spark):
    df = pairs(spark, ("Ani", "Jakarta", "1990-01-01", "L", "Siti"), ("Ina", "Jakarta", "1990-01-01", "L", "Siti"),
               ("Budi", "Jakarta", None, "L", "Siti"))
    none = spark.createDataFrame([], reasons.PATTERN_SCHEMA)
    first = {r["id"]: r for r in reasons.explain(df, none, now()).collect()}
    assert [first[i]["source"] for i in (1, 2, 3)] == ["LLM", "CACHE", "LLM"]
    assert first[1]["pattern_name"] == first[2]["pattern_name"] == "P001_NAMA_BEDA"
    assert first[3]["pattern_name"] == "P002_TGLLAHIR_KOSONG"
    assert first[2]["reason"] == "Full Name: Ina vs budi"
    known = reasons.new_patterns(reasons.detect_patterns(df), none, now())
    second = reasons.explain(df, known, now())
    assert {r["source"] for r in second.collect()} == {"CACHE"}
    hits = reasons.count_hits(known, second, now()).collect()
    assert sorted(r["hit_count"] for r in hits) == [2, 3]
    more = pairs(spark, ("Budi", "Bogor", "1990-01-01", "L", "Siti"))
    assert reasons.new_patterns(reasons.detect_patterns(more), known, now()).first()["pattern_name"] == "P003_TMPTLAHIR_BEDA"


def test_file_awaits_action_when_all_rows_are_done(spark):
    files = spark.createDataFrame([("a", 1), ("b", 1), ("c", 3)], "file_id string, sync_status int")
    manual = spark.createDataFrame(
        [("a", "COMPLETED"), ("a", "FAILED"), ("b", "COMPLETED"), ("b", "PROCESSING")], "file_id string, reasoning_status string")
    got = {r[0]: r[1] for r in reasons.files_after_reasons(files, manual).select("file_id", "sync_status").collect()}
    assert got == {"a": 2, "b": 1, "c": 3}


def test_pairs_take_each_review_row_once(spark):
    manual = spark.createDataFrame(
        [(1, "f", "1", "n1", "PENDING"), (2, "f", "2", "", "FAILED"), (3, "f", "3", None, "COMPLETED"), (4, "f", "4", "zz", "PENDING")],
        "id long, file_id string, id_incoming string, nik_incoming string, reasoning_status string")
    for name in ("nama_incoming", "tempat_lahir_incoming", "tanggal_lahir_incoming", "jenis_kelamin_incoming", "nama_ibu_incoming"):
        manual = manual.withColumn(name, F.lit("x"))
    results = spark.createDataFrame([("f", "1", "n2"), ("f", "2", "n2"), ("f", "3", "n2")], "file_id string, id_incoming string, nik_master string")
    master = spark.createDataFrame([("n1", "one"), ("n2", "two"), ("n2", "two b")], "nik string, nama_lengkap string")
    for name in FIELDS[1:]:
        master = master.withColumn(name, F.lit("y"))
    got = {r["id"]: r["master_nama_lengkap"] for r in reasons.comparison_pairs(manual, results, master).collect()}
    assert got == {1: "one", 2: "two"}
    one = reasons.comparison_pairs(manual.filter("id = 3"), results, master, statuses=None).collect()
    assert [r["id"] for r in one] == [3]
