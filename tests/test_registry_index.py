"""The registry index, rule tables and candidates by SQL."""

import pytest
from pyspark.sql import functions as F

from linkspan.functions import scoring as sc
from linkspan.operators import matching, registry_index
from linkspan.operators.blocking import RULES
from linkspan.operators.clean import clean_incoming, clean_master
from linkspan.operators.matching import Limits, link, link_files, link_files_by_table, link_with_sql
from linkspan.plans.fixtures import derive
from linkspan.sources import versions

SF = "/root/testdata/sf0.001"
TEXT = """SELECT i.file_id, i.id AS incoming_row_id, m.nik AS nik_master, i.nama_clean, m.nama_master_clean
          FROM incoming_df i JOIN master_df m ON i.nik = m.nik;"""


@pytest.fixture(scope="module")
def data(spark):
    return clean_incoming(derive(spark, SF, "incoming_v")), clean_master(derive(spark, SF, "master_v"))


def rows(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("grade", [1, 3, 4, 5])
@pytest.mark.parametrize("limits", [Limits(), Limits(broadcast_tuples=0, tile_incoming=20, tile_master=20)])
def test_index_gives_the_same(spark, data, grade, limits):
    incoming, master = data
    index = registry_index.build(master, buckets=4)
    rules = sc.default_rules(spark)
    assert rows(link(incoming, index, grade, rules, limits=limits)) == rows(link(incoming, master, grade, rules, limits=limits))
    index.close()


def test_registry_side_is_not_shuffled(spark, data):
    _, master = data
    index = registry_index.build(master, buckets=8)
    blocks = index.rows(RULES[3], sc.PROFILES[3])
    own = spark.createDataFrame([("a",)], "block string").repartition(8, "block")
    plan = own.hint("merge").join(blocks, "block")._jdf.queryExecution().executedPlan().toString()
    scan = plan[plan.index("FileScan"):]
    assert "Bucketed: true" in scan and plan.count("Exchange hashpartitioning") <= 1
    index.close()


def test_all_grades_read_the_registry_once(spark, data, monkeypatch):
    incoming, master = data
    read = []
    entries = registry_index.entries
    monkeypatch.setattr(registry_index, "entries", lambda df, *a: read.append(df) or entries(df, *a))
    monkeypatch.setattr(matching, "_master_rows", lambda index, rule, profile: index.rows(rule, profile))
    files = incoming.select("file_id").distinct().withColumns({
        "grade": (F.abs(F.xxhash64("file_id")) % 5 + 1).cast("int"), "upload_timestamp": F.lit("2024-01-01").cast("timestamp"),
    })
    assert link_files(files, incoming, master, sc.default_rules(spark)).count() == incoming.count()
    assert len(read) == 1


def test_grades_are_not_searched_side_by_side(spark, data):
    incoming, master = data
    files = incoming.select("file_id").distinct().withColumns({
        "grade": (F.abs(F.xxhash64("file_id")) % 5 + 1).cast("int"), "upload_timestamp": F.lit("2024-01-01").cast("timestamp"),
    })
    found = link_files(files, incoming, master, sc.default_rules(spark))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and plan.count("BroadcastExchange") <= 1  # the files
    assert found.count() == incoming.count()


def test_kept_and_refreshed(spark, data, tmp_path):
    _, master = data
    path = str(tmp_path / "index")
    registry_index.build(master, path, buckets=2, parts=4).close()
    kept = registry_index.load(spark, path)
    assert rows(kept.every()) == rows(registry_index.entries(master, 4).select(*kept.every().columns))
    first = versions.current(spark, path)
    # Parts 1 and 2 lose a third of their rows, and one row changes.
    here = registry_index.part_of("nik", 4)
    less = master.where(~(here.isin(1, 2)) | (F.crc32("nik") % 3 > 0)).withColumn(
        "nama_master_clean", F.when(here == 1, F.concat("nama_master_clean", F.lit("x"))).otherwise(F.col("nama_master_clean"))
    )
    changed = less.where(here.isin(1, 2))
    new = registry_index.refresh(spark, path, changed, [1, 2])
    assert rows(new.every()) == rows(registry_index.entries(less, 4).select(*new.every().columns))
    assert rows(registry_index.load(spark, path).every()) == rows(new.every())
    assert versions.current(spark, path) != first and versions.clear(spark, path, -1) == 1
    with pytest.raises(ValueError):
        registry_index.load(spark, str(tmp_path / "none"))


def test_a_write_cut_short_changes_nothing(spark, data, tmp_path, monkeypatch):
    _, master = data
    path = str(tmp_path / "index")
    registry_index.build(master, path, buckets=2, parts=4).close()
    before = rows(registry_index.load(spark, path).every())
    monkeypatch.setattr(versions, "switch", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        registry_index.refresh(spark, path, master.where("false"), [0, 1, 2, 3])
    assert rows(registry_index.load(spark, path).every()) == before


def table(spark, *given):
    defaults = {r[0]: r[1:] for r in sc.DEFAULT_RULES}
    return spark.createDataFrame([(g, q, p, *defaults[g]) for g, q, p in given], matching.RULE_TABLE_SCHEMA)


def test_rule_table(spark, data):
    incoming, master = data
    files = incoming.select("file_id").distinct().withColumns({
        "grade": F.when(F.xxhash64("file_id") % 2 == 0, 1).otherwise(3), "upload_timestamp": F.lit("2024-01-01").cast("timestamp"),
    })
    rules = sc.default_rules(spark)
    plain = link_files(files, incoming, master, rules)
    assert rows(link_files_by_table(files, incoming, master, table(spark, (1, None, None), (3, None, None)))) == rows(plain)
    assert rows(link_files_by_table(files, incoming, master, table(spark, (1, TEXT, None), (3, None, None)))) == rows(plain)
    other = link_files_by_table(files, incoming, master, table(spark, (1, TEXT, "a"), (3, None, "c_text"), (5, "no sql", "no")))
    grade3 = files.where("grade = 3").select("file_id")
    want = link(incoming.join(grade3, "file_id"), master, 3, rules, profile=sc.PROFILE_C_TEXT)
    got = other.join(grade3, "file_id", "left_semi").drop("upload_date")
    assert rows(got.select(*want.columns)) == rows(want)
    for bad in ([(1, None, None)], [(1, None, None), (3, None, None), (3, TEXT, None)], [(1, None, "nobody"), (3, None, None)]):
        with pytest.raises(ValueError):
            link_files_by_table(files, incoming, master, table(spark, *bad))
    with pytest.raises(ValueError):
        link_files_by_table(files.withColumn("grade", F.lit(7)), incoming, master, table(spark, (1, None, None)))


def test_grades_of_a_rule_table_are_not_searched_side_by_side(spark, data):
    incoming, master = data
    files = incoming.select("file_id").distinct().withColumns({
        "grade": F.when(F.xxhash64("file_id") % 2 == 0, 1).otherwise(3), "upload_timestamp": F.lit("2024-01-01").cast("timestamp"),
    })
    found = link_files_by_table(files, incoming, master, table(spark, (1, TEXT, None), (3, None, "c_text")))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and plan.count("BroadcastExchange") <= 1  # the files
    assert found.count() == incoming.count()


def test_names_stay_out_of_the_session(spark, data):
    spark.createDataFrame([("kept",)], "word string").createOrReplaceTempView("incoming_df")
    text = "WITH p AS (" + TEXT.rstrip(";") + ") SELECT *, '{braces} incoming_df' AS noted FROM p"
    got = link_with_sql(*data, text, 1, sc.default_rules(spark))
    assert rows(got) == rows(link_with_sql(*data, TEXT, 1, sc.default_rules(spark)))
    assert spark.table("incoming_df").first()[0] == "kept"
    spark.catalog.dropTempView("incoming_df")


def test_one_row_with_most_of_the_pairs(spark):
    incoming = spark.createDataFrame(
        [(None if i % 7 == 0 else "f", i, f"name {i}") for i in range(50)], "file_id string, id long, nama_clean string"
    )
    master = spark.createDataFrame([(f"{i:05d}", f"name {i % 40}") for i in range(4000)], "nik string, nama_master_clean string")
    text = """SELECT i.file_id, i.id AS incoming_row_id, m.nik AS nik_master, i.nama_clean, m.nama_master_clean
              FROM incoming_df i JOIN master_df m ON i.id = 3 OR (i.id % 10 = 1 AND m.nik < '00090')"""
    got = link_with_sql(incoming, master, text, 1, sc.default_rules(spark)).collect()
    assert len(got) == 50
    for r in got:
        n = r["id_incoming"]
        if n == 3:
            assert (r["nik_master"], r["match_score"]) == ("00003", 100.0)
        elif n % 10 == 1 and n < 40:
            assert (r["nik_master"], r["match_score"]) == (f"{n:05d}", 100.0)
        elif n % 10 != 1:
            assert r["nik_master"] is None


BY_VALUES = """SELECT i.file_id, i.id AS incoming_row_id, m.nik AS nik_master, i.nama_clean, m.nama_master_clean
               FROM incoming_df i JOIN master_df m ON i.tanggal_lahir_clean = m.tanggal_lahir_master_clean"""


def test_text_by_values_scores_equal_rows_once(spark, data, monkeypatch):
    incoming, master = data
    copies = master.withColumn("nik", F.explode(F.array(*[F.concat("nik", F.lit(str(n))) for n in range(9)])))
    twice = incoming.withColumn("file_id", F.explode(F.array("file_id", F.lit(None), F.concat("file_id", F.lit("b")))))
    rules = sc.default_rules(spark)
    scored = []
    best = matching.best_of_pairs
    monkeypatch.setattr(matching, "best_of_pairs", lambda pairs, profile: scored.append(pairs.count()) or best(pairs, profile))
    want = link_with_sql(twice, copies, BY_VALUES, 2, rules)
    got = link_with_sql(twice, copies, BY_VALUES, 2, rules, by_values=True)
    assert rows(got) == rows(want)
    assert scored[1] * 20 < scored[0]
    with pytest.raises(Exception):  # a text that looks at a number is refused, not answered otherwise
        link_with_sql(incoming, master, TEXT, 1, rules, by_values=True)


def test_index_of_one_run_has_only_its_rules(spark, data):
    _, master = data
    index = registry_index.build(master, buckets=2, rules=["nik"], fields=["nama"])
    assert set(index.tables) == {"nik"}
    full = registry_index.build(master, buckets=2)
    assert rows(index.rows(RULES[1], sc.PROFILES[1])) == rows(full.rows(RULES[1], sc.PROFILES[1]))
    index.close(), full.close()
    with pytest.raises(ValueError):
        registry_index.build(master, "/tmp/none", rules=["nik"])
