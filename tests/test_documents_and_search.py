import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from linkspan.operators import conversations, documents, search, spread

DOC = """Q: What is it?\n\n\n\nA thing.\nMore.\n<!-- page break -->
   \n<!-- page break -->Q: two lines
still\n<query>SELECT 1<query>x\n<!-- page break -->plain\n\n\n\ntext <query>
<!-- page break -->Q: only"""
PAGES = [
    "<question>What is it?</question>\n<answer>A thing.\nMore.</answer>",
    "<question>two lines\nstill</question>\n<query>SELECT 1<query>x",
    "plain\n\ntext <query>",
    "<question>only</question>",
]


def test_pages_and_numbers(spark):
    df = spark.createDataFrame([("kb/md/faq.md", DOC), ("kb/tables/t1/x.txt", "Q: a")], "path string, text string")
    rows = documents.chunk_documents(df).orderBy("faq").collect()
    assert [r["page_content"] for r in rows] == PAGES
    assert [r["faq"] for r in rows] == [1, 2, 3, 4]
    assert {r["doc_name"] for r in rows} == {"faq.md"}


def test_kind_and_name(spark):
    paths = ["a/markdown/x", "a/b.md", "a/tables/t1", "a/images_desc/i1", "a/other.txt", "plain"]
    df = spark.createDataFrame([(p,) for p in paths], "p string").select(
        documents.content_type(F.col("p")), documents.document_name(F.col("p")))
    assert [tuple(r) for r in df.collect()] == [
        ("text", "x"), ("text", "b.md"), ("tables", "tables"), ("image", "images_desc"), ("unknown", "other.txt"), ("unknown", "plain")]


def test_incremental_load(spark):
    old = spark.createDataFrame([("a.md", "one<!-- page break -->two")], "path string, text string")
    store = documents.chunk_documents(old)
    new = spark.createDataFrame(
        [("a.md", "one<!-- page break -->two"), ("b.md", "two<!-- page break -->new<!-- page break -->new")], "path string, text string")
    rows = documents.new_chunks(new, store).orderBy("faq").collect()
    assert [(r["path"], r["faq"], r["page_content"]) for r in rows] == [("b.md", 2, "new"), ("b.md", 3, "new")]


def test_bm25_equals_brute_force(spark):
    random.seed(5)
    words = "alpha beta gamma delta epsilon zeta été".split()
    docs = [(n, " ".join(random.choices(words, weights=[9, 5, 3, 2, 1, 1, 1], k=random.randint(1, 30)))) for n in range(40)]
    asked = [(0, "Gamma, delta!"), (1, "alpha alpha été"), (2, "nothing here")]
    got = search.bm25_topk(
        spark.createDataFrame(docs, "item_id long, text string"), spark.createDataFrame(asked, "query_id long, text string"), k=4)
    got = {(r["query_id"], r["rank"]): (r["item_id"], r["score"]) for r in got.collect()}
    split = {n: re.findall(r"\w+", t) for n, t in docs}
    mean = sum(map(len, split.values())) / len(docs)
    for q, text in asked:
        scores = Counter()
        for term, times in Counter(re.findall(r"\w+", text.lower())).items():
            df = sum(term in w for w in split.values())
            for n, w in split.items():
                tf = w.count(term)
                if tf:
                    idf = math.log(1 + (len(docs) - df + 0.5) / (df + 0.5))
                    scores[n] += times * idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / mean))
        want = sorted(scores.items(), key=lambda x: (-round(x[1], 6), x[0]))[:4]
        for rank, (n, score) in enumerate(want, 1):
            assert got[(q, rank)][0] == n and got[(q, rank)][1] == pytest.approx(score, abs=1e-5)


@pytest.mark.parametrize("block", [2_000, 3])
def test_dense_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(search, "REQUEST_BLOCK", block)
    rng = np.random.default_rng(1)
    items, asked = rng.normal(size=(60, 8)), rng.normal(size=(7, 8))
    got = search.dense_topk(
        spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(items)], "item_id long, vector array<float>"),
        spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(asked)], "query_id long, vector array<float>"), k=3)
    got = {(r["query_id"], r["rank"]): r["item_id"] for r in got.collect()}
    cos = (asked / np.linalg.norm(asked, axis=1)[:, None]) @ (items / np.linalg.norm(items, axis=1)[:, None]).T
    for q in range(7):
        assert [got[(q, r)] for r in (1, 2, 3)] == list(np.argsort(-cos[q])[:3])


@pytest.mark.parametrize("block, piece", [(100, 100), (4, 7), (20, 1)])
def test_dense_ties_and_odd_vectors(spark, block, piece):
    rng = np.random.default_rng(2)
    base = [v.tolist() for v in rng.integers(-2, 3, size=(6, 3)).astype(float)]
    rows = [(i, base[i % 6]) for i in range(30)]  # five of each, so ranks rest on ids
    odd = [(90, None), (91, [1.0, None, 2.0]), (92, [float("nan"), 0.0, 1.0]), (None, base[0]), (93, [0.0, 0.0, 0.0])]
    items = spark.createDataFrame(rows + odd, "item_id long, vector array<double>")
    got = search.dense_topk(items, items.withColumnRenamed("item_id", "query_id"), 4, block, piece)
    assert got.dtypes == search.dense_topk(items, items.limit(0).withColumnRenamed("item_id", "query_id")).dtypes
    got = {(r["query_id"], r["rank"]): r["item_id"] for r in got.collect()}
    whole = rows + [odd[-1]]

    def cosine(a, b):
        size = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
        return round(sum(x * y for x, y in zip(a, b)) / size, 6) + 0.0 if size else 0.0

    want = {}
    for q, v in whole:
        best = sorted(whole, key=lambda r: (-cosine(v, r[1]), r[0]))[:4]
        want.update({(q, n): i for n, (i, _) in enumerate(best, 1)})
    assert got == want


def test_dense_grid_does_not_grow_with_the_rows(spark, monkeypatch):
    assert search._pieces(0, 400) == 1 and search._pieces(700, 400) == 2
    assert search._pieces(60_000, 400) == search._pieces(600_000, 400) == search.GRID
    assert search._pieces(10_000_000, 400) == 100  # a piece stays in memory
    cells = []
    search_cell = search._cell
    monkeypatch.setattr(search, "_cell", lambda k: cells.append(k) or search_cell(k))
    monkeypatch.setattr(search, "STRIP", 7)
    rng = np.random.default_rng(3)
    base = rng.integers(-3, 4, size=(300, 4)).astype(float)
    items = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(base)], "item_id long, vector array<double>")
    asked = items.withColumnRenamed("item_id", "query_id")
    grid = search.dense_topk(items, asked, 4, 5, 3)
    assert len(cells) == 1
    assert sorted(map(str, grid.collect())) == sorted(map(str, search.dense_topk(items, asked, 4).collect()))
    assert grid.groupBy("query_id").count().where("count <> 4").count() == 0


def test_dense_without_vectors(spark):
    items = spark.createDataFrame([], "item_id long, vector array<double>")
    asked = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(3)], "query_id long, vector array<double>")
    assert search.dense_topk(items, asked).count() == 0
    assert search.dense_topk(items, asked, request_block=2).count() == 0


def test_fusion(spark):
    a = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "query_id long, item_id long, rank int")
    b = spark.createDataFrame([(1, 11, 1), (1, 12, 2)], "query_id long, item_id long, rank int")
    rows = search.fuse(a, b, k=2).orderBy("rank").collect()
    assert [r["item_id"] for r in rows] == [11, 10]
    assert rows[0]["score"] == pytest.approx(1 / 61 + 1 / 62, abs=1e-9)


def test_numbering_over_spans(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), (F.col("id") * 7).alias("o"))
    rows = spread.number_rows(df, "g", "o", width=50).collect()
    for g in range(3):
        mine = sorted((r["o"], r["number"]) for r in rows if r["g"] == g)
        assert [n for _, n in mine] == list(range(1, len(mine) + 1))


def test_join_by_file_keeps_rows(spark):
    rows = spark.range(500).select(F.lit("hot").alias("file_id"), F.col("id").cast("string").alias("id"))
    files = spark.createDataFrame([("hot", 1), ("cold", 2)], "file_id string, grade int")
    assert spread.join_by_file(rows, files, "id").filter("grade = 1").count() == 500
    assert spread.join_by_file(rows, files.filter("grade = 2"), "id").filter("grade is null").count() == 500


def test_answers_are_masked_only_when_asked(spark):
    df = spark.createDataFrame([("assistant", "3200000000000123"), ("user", "3200000000000123")], "role string, text string")
    assert [r["text"] for r in conversations.mask_answers(df).collect()] == ["*************123", "3200000000000123"]
    assert [r["text"] for r in conversations.mask_answers(df, enabled=False).collect()] == ["3200000000000123"] * 2


def test_a_page_is_tidied_once(spark, monkeypatch):
    steps = []
    tidy = documents._tidy
    monkeypatch.setattr(documents, "_tidy", lambda p: steps.append(p) or tidy(p))
    docs = spark.createDataFrame([("a.md", "Q: one\n\ntwo <query>x")], "path string, text string")
    plan = documents.chunk_documents(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("{3,}") == 1
    assert documents.chunk_documents(docs).first()["page_content"] == "<question>one</question>\n<answer>two</answer>\n<query>x"


def test_bm25_tasks_follow_the_rows_that_meet(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"a b word{i % 3}") for i in range(200)], "item_id long, text string")
    asked = spark.createDataFrame([(i, "a b") for i in range(5)], "query_id long, text string")
    want = sorted(map(str, search.bm25_topk(docs, asked, 3).collect()))
    monkeypatch.setattr(search, "TASK_PAIRS", 50)
    tasks = []
    score_tasks = search._score_tasks
    monkeypatch.setattr(search, "_score_tasks", lambda *a: tasks.append(score_tasks(*a)) or tasks[-1])
    assert sorted(map(str, search.bm25_topk(docs, asked, 3).collect())) == want
    assert tasks == [40]  # 200 documents with each of two terms, for 5 requests
