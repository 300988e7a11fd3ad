"""Matching against brute force, whatever way the join runs."""

import random

import pytest
from pyspark.sql import functions as F

from linkspan.functions import scoring as sc
from linkspan.functions.similarity import jaro_winkler_text
from linkspan.operators.blocking import RULES, candidate_counts, candidate_pairs
from linkspan.operators.clean import clean_incoming, clean_master
from linkspan.operators import blocking, matching
from linkspan.operators.matching import (
    Limits, file_sync_status, link, link_files, link_with_sql, match_summary, _best_partner,
)

FIRST = "budi siti agus dewi budiman sinta".split()
LAST = "santoso wijaya santosa hidayat".split()
PLACES = ["jakarta", "bandung", "jambi", None, ""]
MOTHERS = ["sri rahayu", "ani", None, ""]

WAYS = {
    "broadcast": Limits(),
    "spread": Limits(pairs_worth_a_task=10),
    "shuffle": Limits(broadcast_tuples=0),
    "tiles": Limits(broadcast_tuples=0, tile_incoming=3, tile_master=5, hot_share=10**9),
    "narrow": Limits(narrow_from_pairs=1),
    "narrow tiles": Limits(broadcast_tuples=0, tile_incoming=3, tile_master=5, hot_share=10**9, narrow_from_pairs=1),
}


def person(rnd, n):
    date = rnd.choice(["1990-01-01", "1990-01-01", "1985-01-01", f"19{rnd.randint(50, 99)}-0{rnd.randint(1, 3)}-01"])
    return {
        "nik": str(3200000000000000 + n), "nama": f"{rnd.choice(FIRST)} {rnd.choice(LAST)}",
        "tempat_lahir": rnd.choice(PLACES), "tanggal_lahir": date, "jenis_kelamin": rnd.choice("LP"),
        "nama_ibu": rnd.choice(MOTHERS), "provinsi": rnd.choice(["bali", "banten", None]),
        "kabupaten": rnd.choice(["kab 1", None]), "kecamatan": rnd.choice(["kec 1", "kec 2"]),
        "kelurahan": rnd.choice(["kel 1", ""]), "status": rnd.choice(["hidup", "wafat"]),
    }


@pytest.fixture(scope="module")
def data(spark):
    rnd = random.Random(7)
    master = [person(rnd, n) for n in range(150)]
    third = dict(master[0], nama="budi santoso", jenis_kelamin="L", tanggal_lahir="1990-01-01", tempat_lahir="jakarta")
    master += [dict(third, nik=str(3300000000000000 + n)) for n in range(70)]
    rows = []
    for n in range(120):
        p = dict(rnd.choice(master))
        if n % 3 == 0:  # copies of one person
            p = dict(third)
        elif rnd.random() < 0.5:
            p["nama"] = p["nama"].replace("a", "o")
        if rnd.random() < 0.2:
            p["tanggal_lahir"] = None
        if rnd.random() < 0.2:
            p["jenis_kelamin"] = None
        if rnd.random() < 0.2:
            p["nik"] = None
        rows.append(dict(p, id=str(n + 1), file_id=f"f{n % 2}"))
    names = ["nik", "nama", "tempat_lahir", "tanggal_lahir", "jenis_kelamin", "nama_ibu",
             "provinsi", "kabupaten", "kecamatan", "kelurahan", "status"]
    schema = ", ".join(f"{n} string" for n in names)
    ma = spark.createDataFrame([[p[n] for n in names] for p in master], schema)
    inc = spark.createDataFrame(
        [[p[n] for n in (*names, "id", "file_id")] for p in rows], schema + ", id string, file_id string"
    )
    cleaned = (
        clean_incoming(inc.withColumnRenamed("status", "status_hidup")).cache(),
        clean_master(ma.withColumnRenamed("nama", "nama_lengkap").withColumnRenamed("status", "status_kematian")).cache(),
    )
    return cleaned


def sim(a, b):
    return jaro_winkler_text(str(a), str(b)) if a and b else 0.0


def brute_score(profile, i, m):
    gained = possible = 0.0
    for t in profile.terms:
        if t.how == "area":
            sims = [sim(i[f"{f}_clean"], m[f"{f}_master_clean"]) for f in ("provinsi", "kabupaten", "kecamatan", "kelurahan")
                    if i[f"{f}_clean"] and m[f"{f}_master_clean"]]
            value, counted = (sum(sims) / len(sims), True) if sims else (0.0, False)
        else:
            a, b = i[f"{t.field}_clean"], m[f"{t.field}_master_clean"]
            value = float(a is not None and a == b) if t.how == "exact" else sim(a, b)
            counted = bool(a)
        if profile.renormalise and not t.always and not counted:
            continue
        gained += value * t.weight
        possible += t.weight
    return gained * 100 if not profile.renormalise else (gained / possible * 100 if possible else 0.0)


def same_block(grade, i, m):
    day = lambda d: d and (d.day, d.month)
    eq = lambda a, b: a is not None and b is not None and a == b
    pre = lambda s: None if s is None else s[:3]
    date = eq(day(i["tanggal_lahir_clean"]), day(m["tanggal_lahir_master_clean"]))
    name = eq(pre(i["nama_clean"]), pre(m["nama_master_clean"]))
    place = bool(i["tempat_lahir_clean"] and m["tempat_lahir_master_clean"]) and eq(
        pre(i["tempat_lahir_clean"]), pre(m["tempat_lahir_master_clean"]))
    gender = eq(i["jenis_kelamin_clean"], m["jenis_kelamin_master_clean"])
    if grade in (1, 2):
        return eq(i["nik"], m["nik"])
    if grade == 3:
        return gender and date and name
    if grade == 4:
        return (
            (i["jenis_kelamin_clean"] is None and place and date)
            or (i["tempat_lahir_clean"] is None and gender and name and date)
            or (i["tanggal_lahir_clean"] is None and gender and place and name)
            or (gender and name and date)
        )
    return eq(i["status_hidup_clean"], m["status_hidup_master_clean"]) and name and date


@pytest.fixture(scope="module")
def brute(data):
    incoming, master = ([r.asDict() for r in df.collect()] for df in data)
    out = {}
    for grade, profile in sc.PROFILES.items():
        best = {}
        for i in incoming:
            options = [(-round(brute_score(profile, i, m), 9), m["nik"]) for m in master if same_block(grade, i, m)]
            lost, nik = min(options) if options else (0.0, None)
            best[(i["file_id"], i["id"])] = (nik, round(-lost, 2))
        out[grade] = best
    return out


@pytest.mark.parametrize("grade", [1, 2, 3, 4, 5])
@pytest.mark.parametrize("way", WAYS)
def test_equals_brute_force(spark, data, brute, grade, way):
    rows = link(*data, grade, sc.default_rules(spark), limits=WAYS[way]).collect()
    assert len(rows) == 120
    for r in rows:
        nik, score = brute[grade][(r["file_id"], r["id_incoming"])]
        assert r["nik_master"] == nik
        assert r["match_score"] == pytest.approx(score, abs=0.011)
        assert 0 <= r["match_score"] <= 100
        if nik is None:
            assert r["match_result"] == 3


@pytest.mark.parametrize("limits", [Limits(broadcast_tuples=0), Limits(merge_from_pairs=1)])
@pytest.mark.parametrize("grade", [3, 4, 5])
def test_copies_in_the_registry_are_scored_once(spark, data, monkeypatch, grade, limits):
    incoming, master = data
    copies = master.withColumn("nik", F.explode(F.array(*[F.concat(F.lit(str(n)), "nik") for n in range(1, 10)])))
    scored = []
    best = matching._best_partner
    monkeypatch.setattr(matching, "_best_partner", lambda pairs, profile: scored.append(pairs.count()) or best(pairs, profile))
    rules = sc.default_rules(spark)
    few = link(incoming, master, grade, rules, limits=limits)
    many = link(incoming, copies, grade, rules, limits=limits)
    assert scored[0] == scored[1] > 0
    plain = lambda df: sorted((r["file_id"], r["id_incoming"], r["match_score"], (r["nik_master"] or "")[-16:]) for r in df.collect())
    assert plain(many) == plain(few)


@pytest.mark.parametrize("grade", [3, 4, 5])
def test_candidate_counts(data, grade):
    incoming, master = data
    counted = {(r[0], r[1]): r[2] for r in candidate_counts(incoming, master, RULES[grade]).collect()}
    listed = candidate_pairs(incoming, master, RULES[grade]).groupBy("file_id", "id").agg(
        F.countDistinct("nik_master").alias("n"))
    listed = {(r[0], r[1]): r[2] for r in listed.collect()}
    assert counted == {k: listed.get(k, 0) for k in counted}


def test_candidate_counts_spread_by_rows(data, monkeypatch):
    incoming, master = data
    want = sorted(map(str, candidate_counts(incoming, master, RULES[4]).collect()))
    monkeypatch.setattr(blocking, "TASK_ROWS", 10)
    counted = candidate_counts(incoming, master, RULES[4])
    plan = counted._jdf.queryExecution().executedPlan().toString()
    tasks = -(-master.count() * 3 // 10)  # three branches make blocks
    assert tasks > 8 and f", {tasks}), REPARTITION_BY_NUM" in plan
    assert sorted(map(str, counted.collect())) == want


def test_score_on_columns_equals_batches(spark, data):
    incoming, master = data
    for grade in (3, 4, 5):
        profile = sc.PROFILES[grade]
        pairs = candidate_pairs(incoming, master, RULES[grade])
        direct = pairs.groupBy("file_id", "id").agg(F.round(F.max(sc.score_column(profile)), 6).alias("s"))
        direct = {(r[0], r[1]): r[2] for r in direct.collect()}
        packed = pairs.select(
            F.concat_ws("/", "file_id", "id").alias("tuple_key"), "nik_master",
            *[F.col(f"{f}_clean").cast("string").alias(f"a_{f}") for f in profile.fields],
            *[F.col(f"{f}_master_clean").cast("string").alias(f"b_{f}") for f in profile.fields],
        )
        for r in _best_partner(packed, profile).collect():
            assert r["score"] == pytest.approx(direct[tuple(r["tuple_key"].split("/"))], abs=1e-5)


def test_user_rule_equals_built_in(spark, data, brute):
    text = """SELECT i.file_id, i.id AS incoming_row_id, m.nik AS nik_master, i.nama_clean, m.nama_master_clean
              FROM incoming_df i JOIN master_df m ON i.nik = m.nik"""
    rows = link_with_sql(*data, text, 1, sc.default_rules(spark)).collect()
    assert {(r["file_id"], r["id_incoming"]): r["nik_master"] for r in rows} == {
        k: v[0] for k, v in brute[1].items()
    }


def test_files_by_grade_and_summary(spark, data):
    files = spark.createDataFrame([("f0", 1), ("f1", 3)], "file_id string, grade int").withColumn(
        "upload_timestamp", F.lit("2024-01-01").cast("timestamp"))
    results = link_files(files, *data, sc.default_rules(spark))
    summary = {r["file_id"]: r for r in match_summary(results).collect()}
    for r in summary.values():
        assert r["processed_rows"] == 60
        assert r["matched_rows"] + r["manual_review_rows"] + r["unmatched_rows"] == 60
    status = {r["file_id"]: r["sync_status"] for r in file_sync_status(results).collect()}
    for name, value in status.items():
        assert value == (1 if summary[name]["manual_review_rows"] else 3)


def test_wrong_grade_is_refused(spark, data):
    files = spark.createDataFrame([("f0", 9)], "file_id string, grade int").withColumn(
        "upload_timestamp", F.lit("2024-01-01").cast("timestamp"))
    with pytest.raises(ValueError):
        link_files(files, *data, sc.default_rules(spark))
    with pytest.raises(ValueError):
        link(*data, 6, sc.default_rules(spark))


def test_classification(spark):
    rules = sc.default_rules(spark)
    cases = [(2, 90.0, 1, 1), (2, 90.0, 2, 2), (2, 75.0, 0, 2), (2, 60.0, 0, 3), (1, 80.0, 0, 1),
             (1, 79.99, 0, 3), (3, 85.0, 0, 1), (3, 84.9, 0, 2), (3, 69.9, 0, 3)]
    df = spark.createDataFrame(cases, "grade int, score double, missing int, want int")
    for r in sc.with_rules(df, rules).withColumn("got", sc.classify(F.col("score"), F.col("missing"))).collect():
        assert r["got"] == r["want"]


def test_review_needs_exact_missing_count(spark):
    rules = spark.createDataFrame([(2, 0, 90.0, 1, 50.0, 90.0)], sc.RULE_SCHEMA)
    df = spark.createDataFrame([(2, 70.0, 0), (2, 70.0, 1), (2, 70.0, 2)], "grade int, score double, missing int")
    got = sc.with_rules(df, rules).select("missing", sc.classify(F.col("score"), F.col("missing"))).collect()
    assert dict((r[0], r[1]) for r in got) == {0: 3, 1: 2, 2: 3}
