"""The Jaccard join against all pairs, on skewed near copies."""

import random

import pytest

from linkspan.llm import ngram_join


def brute(rows, share, words):
    sets = []
    for doc, text in rows:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[i:i + words]) for i in range(max(len(w) - words, 0) + 1)} if w else set())
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= share * (len(sets[i]) + len(sets[j]) - both):
                parent[root(i)] = root(j)
    smallest = {}
    for i, (doc, _) in enumerate(rows):
        smallest.setdefault(root(i), []).append(doc)
    return {doc: (len(sets[i]), min(smallest[root(i)])) for i, (doc, _) in enumerate(rows)}


def corpus():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    common = [word() for _ in range(15)]
    base = [word() for _ in range(150)]
    texts = []
    for _ in range(150):  # near copies with 0 to 14 edits of one text
        own = list(base)
        for _ in range(rng.randrange(15)):
            own[rng.randrange(len(own))] = word()
        texts.append(" ".join(own))
    for _ in range(60):  # a passage that others share
        own = [word() for _ in range(rng.randrange(1, 80))]
        texts.append(" ".join(own[:10] + common + own[10:]))
    for _ in range(40):  # chains: each a little off the one before
        own = texts[-1].split()
        own[rng.randrange(len(own))] = word()
        texts.append(" ".join(own + [word()]))
    texts += [texts[0]] * 30 + [" ".join(common)] * 5 + ["a b", "A  b", "a", "", None, None, "x\ny z", "x y z"]
    rng.shuffle(texts)
    return list(enumerate(texts))


def test_against_all_pairs(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for share, words in ((85, 4), (80, 5)):
        found = ngram_join.near_duplicates(docs, share=share, words=words).collect()
        expected = brute(rows, share, words)
        assert len(found) == len(rows)
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == expected


def test_nulls_repeats_and_names(spark):
    rows = [(None, "a b c d e", 1), (7, "a b c d e", 2), (7, "a b c d e", 2), (9, None, 3), (None, None, 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int").withColumnRenamed("n", "token")
    found = ngram_join.near_duplicates(docs)
    assert sorted(map(str, ((r["doc_id"], r["component_id"], r["is_first"]) for r in found.collect()))) == sorted(map(
        str, [(None, 7, False), (7, 7, True), (7, 7, True), (9, 9, True), (None, None, True)]
    ))
    kept = ngram_join.kept(docs, found)
    assert kept.columns == docs.columns and kept.count() == 4
    empty = docs.where("false")
    assert ngram_join.near_duplicates(empty).count() == 0


def test_components_in_one_task_or_many(spark):
    rng = random.Random(8)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(0, i) for i in range(300, 340)]
    edges += [(i, i + 1) for i in range(400, 460)] + [(5, 5)]
    root = {}
    for a, b in edges:
        if a != b:
            one, two = root.setdefault(a, {a}), root.setdefault(b, {b})
            one |= two
            root.update(dict.fromkeys(two, one))
    df = spark.createDataFrame(edges, "a long, b long").repartition(3)
    for few in (0, 30, 100_000):
        labels = {}
        for row in ngram_join.components(df, few).collect():
            labels.setdefault(row.label, set()).add(row.id)
        found = {tuple(sorted(ids)) for ids in labels.values()}
        assert found == {tuple(sorted(ids)) for ids in root.values()}
    empty = spark.createDataFrame([(3, 3)], "a long, b long")
    assert ngram_join.components(empty).count() == 0


def test_repeated_rows_stay_once(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rows = [(None, "a b c d e f g", 1), (7, "a b c d e f g", 2), (7, "a b c d e f g", 2), (9, None, 3), (None, None, 4)]
    rows += [(None, "p q r s t u v", 5)] * 20 + [(3, "x y", 6), (8, "", 8), (8, "", 9), (11, "k l m n o p", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int").withColumnRenamed("n", "hash").repartition(4)
    expected = [(None, None), (None, "p q r s t u v"), (3, "x y"), (7, "a b c d e f g"), (8, ""), (9, None), (11, "k l m n o p")]
    left = corpus_pipeline.one_of_each(spark, docs, "")
    assert left.columns == docs.columns
    assert sorted(map(str, left.select("doc_id", "text").collect())) == sorted(
        f"Row(doc_id={i}, text={t!r})" for i, t in expected)
    # the way beyond the broadcast bound gives the same
    near = ngram_join.near_duplicates(docs).cache()
    assert ngram_join.once(ngram_join.kept(docs, near), near, broadcast_rows=0).count() == len(expected)
    assert corpus_pipeline.one_of_each(spark, docs.where("false"), "").count() == 0
