"""Benchmark decontamination with DataFrame functions only.

A window is `width` consecutive words of a benchmark item; a shorter item is one window.
Any occurrence of a window of m words covers a whole run of g = (m + 1) // 2 words that
begins at a multiple of g. So the documents are scanned at every g-th word only: the
digests of these runs are looked up in the set of digests of all runs of g words of the
windows. Documents with a hit are candidates; their windows are then compared word by
word. Sets are broadcast up to `broadcast_rows` digests or windows, whose sizes are
counted first, and joined by shuffle beyond that; the rows are the same.

Rows are told apart by doc_id and a hash of the text, so copies of a text don't meet in
one task, and a passage shared by many documents is only ever on the side of the set.

Defined results: null and empty texts have no words, no hits and are not contaminated.
Items without words or without an id are not used; texts under one item_id are one item.
Repeated rows get the same result each. Null doc_ids are told apart by their texts. An
empty benchmark or an empty table needs no rule.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkspan.llm.common import small
from linkspan.sources.scratch import settle

#: What separates words: ASCII other than digits and letters, once lower-cased.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: str | Column) -> Column:
    lower = F.translate(F.coalesce(text, F.lit("")), ascii_uppercase, ascii_lowercase)
    return F.array_remove(F.split(lower, BETWEEN), "")


def runs(word_list: Column, size: int, step: int) -> Column:
    """Digests of the runs of `size` words that begin at every `step`-th word."""
    starts = F.sequence(F.lit(1), F.size(word_list) - (size - 1), F.lit(step))
    return F.when(
        F.size(word_list) >= size, F.transform(starts, lambda i: F.xxhash64(F.slice(word_list, i, size)))
    ).otherwise(F.array().cast("array<long>"))


def windows(benchmark: DataFrame, width: int = 13, item: str = "item_id", text: str = "text") -> DataFrame:
    """(item, words array, size) of each distinct window of each item."""
    items = benchmark.where(F.col(item).isNotNull()).select(
        F.col(item).cast("string").alias("item"), words(text).alias("all")
    ).where("size(all) > 0").withColumn("size", F.least(F.size("all"), F.lit(width)))
    starts = F.sequence(F.lit(1), F.size("all") - F.col("size") + 1)
    return items.select(
        "item", "size", F.explode(F.transform(starts, lambda i: F.slice(F.col("all"), i, F.col("size")))).alias("words")
    ).distinct()


def _said(word_list: Column, size: int) -> Column:
    """All runs of `size` words, as text."""
    starts = F.sequence(F.lit(1), F.size(word_list) - (size - 1))
    return F.when(F.size(word_list) >= size, F.transform(starts, lambda i: F.struct(
        i.alias("position"), F.lit(size).alias("size"), F.concat_ws(" ", F.slice(word_list, i, size)).alias("said")
    ))).otherwise(F.array().cast("array<struct<position:int,size:int,said:string>>"))


def hits(docs: DataFrame, wins: DataFrame, text: str = "text", broadcast_rows: int = 500_000) -> DataFrame:
    """doc_id, hash, position (from 1), item, size: each occurrence of a window.

    `docs` needs doc_id; `wins` as from `windows`, stored.
    """
    rows = docs.select("doc_id", F.xxhash64(text).alias("hash"), F.col(text).alias("text"))
    sizes = sorted(r["size"] for r in wins.select("size").distinct().collect())  # at most `width` numbers
    grams = sorted({(size + 1) // 2 for size in sizes})
    if not grams:
        return rows.select("doc_id", "hash", F.lit(1).alias("position"), F.lit("").alias("item"), F.lit(1).alias("size")).where("false")
    tagged = lambda w, size, step, tag: F.transform(
        runs(w, size, step), lambda h: F.struct(F.lit(tag).alias("gram"), h.alias("digest"))
    )
    looked_up = small(
        wins.select(F.explode(F.concat(*(
            F.when(F.floor((F.col("size") + 1) / 2) == g, tagged(F.col("words"), g, 1, g)).otherwise(
                F.array().cast("array<struct<gram:int,digest:bigint>>")
            ) for g in grams
        ))).alias("run")).select("run.gram", "run.digest").distinct(), broadcast_rows * len(grams),
    )
    split = rows.select("doc_id", "hash", words("text").alias("words"))
    scanned = split.select("doc_id", "hash", F.explode(F.concat(*(
        tagged(F.col("words"), g, g, g) for g in grams
    ))).alias("run")).select("doc_id", "hash", "run.gram", "run.digest")
    found = settle(scanned.join(looked_up, ["gram", "digest"], "left_semi").select("doc_id", "hash").distinct(), "found")
    near = small(found.select(F.col("doc_id").alias("id"), F.col("hash").alias("h")), broadcast_rows)
    suspects = rows.join(
        near, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("hash") == F.col("h")), "left_semi"
    ).select("doc_id", "hash", words("text").alias("words"))
    every = suspects.select("doc_id", "hash", F.explode(F.concat(*(
        _said(F.col("words"), size) for size in sizes
    ))).alias("at")).select("doc_id", "hash", "at.*")
    known = wins.select("item", "size", F.concat_ws(" ", "words").alias("said"))
    whole = small(known.select("size", "said").distinct(), broadcast_rows)
    # One row for each place first; items only come in after that.
    places = settle(every.join(whole, ["size", "said"], "left_semi").distinct(), "places")
    return places.join(small(known, broadcast_rows), ["size", "said"]).select("doc_id", "hash", "position", "item", "size")


def contamination(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", width: int = 13, broadcast_rows: int = 500_000,
) -> DataFrame:
    """doc_id, hash, n_hit and items (sorted) of the documents with a hit."""
    wins = settle(windows(benchmark, width), "windows")
    each = settle(hits(docs, wins, text, broadcast_rows), "hits")
    covered = each.select("doc_id", "hash", "position", "size").distinct().select(
        "doc_id", "hash", F.explode(F.sequence(F.col("position"), F.col("position") + F.col("size") - 1)).alias("word")
    ).distinct().groupBy("doc_id", "hash").agg(F.count(F.lit(1)).alias("n_hit"))
    items = each.select("doc_id", "hash", "item").distinct().groupBy("doc_id", "hash").agg(
        F.array_sort(F.collect_list("item")).alias("items")
    )
    same = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("hash") == F.col("h"))
    return covered.join(
        items.select(F.col("doc_id").alias("id"), F.col("hash").alias("h"), "items"), same
    ).select("doc_id", "hash", "n_hit", "items")


def marked(docs: DataFrame, found: DataFrame, text: str = "text", share: int = 20) -> DataFrame:
    """row (struct of the document's columns), n_words, n_hit, items, contaminated.

    `found` as from `contamination`. Contaminated: at least one word in `share` is hit.
    """
    other = found.select(F.col("doc_id").alias("id"), F.col("hash").alias("h"), "n_hit", "items")
    own = docs.select(
        F.struct("*").alias("row"), F.col("doc_id").alias("own_id"), F.xxhash64(text).alias("own_hash"),
        F.size(words(text)).cast("long").alias("n_words"),
    )
    joined = own.join(other, F.col("own_id").eqNullSafe(F.col("id")) & (F.col("own_hash") == F.col("h")), "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return joined.select(
        "row", "n_words", n_hit.alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        ((n_hit > 0) & (share * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The documents that are not contaminated, unchanged."""
    return marked(docs, contamination(docs, benchmark, text), text).where(~F.col("contaminated")).select("row.*")
