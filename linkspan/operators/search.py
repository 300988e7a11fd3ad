"""Search over chunks: dense vectors, BM25 terms, and both fused by rank.

A search is a batch of requests against a whole collection.  Each task passes on
only its k best hits per request.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkspan.sources.scratch import settle

BM25_K1, BM25_B = 1.2, 0.75
RANK_CONSTANT = 60
REQUEST_BLOCK = 2_000  # request vectors of one block; a piece of the grid has as many, or more
VECTOR_BLOCK = 20_000  # vectors of one piece, or more
GRID = 8  # pieces of either side, until a piece would hold more than PIECE_ROWS
PIECE_ROWS = 100_000
STRIP = 2_000  # vectors and requests compared at once
TASK_PAIRS = 1_000_000  # (request, document, term) rows that a task adds up, on average
TERM_ROWS = 1_000_000  # request terms sent to the tasks up to here
SCORE_DIGITS = 6
_HIT_NAMES = ["query_id", "item_id", "score"]
_HIT_SCHEMA = "query_id long, item_id long, score double"
_HITS = pa.schema([("query_id", pa.int64()), ("item_id", pa.int64()), ("score", pa.float64())])


def _top(scores: DataFrame, query: str, item: str, k: int) -> DataFrame:
    """The k best per request; Spark applies the limit before the shuffle too."""
    rank = F.row_number().over(
        Window.partitionBy(query).orderBy(F.col("score").desc(), F.col(item))
    )
    return scores.withColumn("rank", rank).filter(F.col("rank") <= k)


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Vectors of length one, a row each; those of length zero stay as they are."""
    rows = np.stack(column.to_numpy(zero_copy_only=False)).astype(np.float64)
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(norms > 0, norms, 1.0)


def _best(asked: np.ndarray, requests: np.ndarray, items: np.ndarray, vectors: np.ndarray, k: int):
    """Record batches with the k best items per request, a batch for each `STRIP` requests.

    Vectors are looked at strip by strip. Only scores that reach a request's k-th best so far
    are rounded and sorted, ties included, so the smallest id wins as it does over all items.
    """
    for top in range(0, len(asked), STRIP):
        mine = requests[top:top + STRIP]
        row, ids, score = np.empty(0, np.int64), np.empty(0, items.dtype), np.empty(0)
        least = np.full(len(mine), -np.inf)
        for start in range(0, len(items), STRIP):
            raw = mine @ vectors[start:start + STRIP].T
            if start == 0 and raw.shape[1] > k:
                least = np.round(np.partition(raw, raw.shape[1] - k, axis=1)[:, raw.shape[1] - k], SCORE_DIGITS)
            near, column = np.nonzero(raw >= (least - 10.0 ** -SCORE_DIGITS)[:, None])
            if not len(near):
                continue
            row = np.concatenate((row, near))
            ids = np.concatenate((ids, items[start + column]))
            score = np.concatenate((score, np.round(raw[near, column], SCORE_DIGITS)))
            order = np.lexsort((ids, -score, row))
            row, ids, score = row[order], ids[order], score[order]
            place = np.arange(len(row)) - np.searchsorted(row, row)
            row, ids, score = row[place < k], ids[place < k], score[place < k]
            full = np.flatnonzero(place[place < k] == k - 1)
            least[row[full]] = score[full]
        yield pa.RecordBatch.from_arrays(
            [pa.array(asked[top:top + STRIP][row]), pa.array(ids), pa.array(score)], names=_HIT_NAMES
        )


def _in_place(asked: np.ndarray, requests: np.ndarray, k: int):
    """Function over Arrow batches of vectors: the k best of each batch."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                items = batch.column(0).to_numpy(zero_copy_only=False)
                yield from _best(asked, requests, items, _matrix(batch.column(1)), k)

    return search


def _cell(k: int):
    """Function over a cell of the grid: the k best of its vectors for each of its requests."""

    def search(vectors: pa.Table, requests: pa.Table) -> pa.Table:
        if not vectors.num_rows or not requests.num_rows:
            return _HITS.empty_table()
        found = _best(
            requests["query_id"].to_numpy(), _matrix(requests["vector"]),
            vectors["item_id"].to_numpy(), _matrix(vectors["vector"]), k,
        )
        return pa.Table.from_batches(found, _HITS)

    return search


def _usable(df: DataFrame, ident: str) -> DataFrame:
    """Ids as longs with the vectors that can be compared."""
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x.cast("double")))
    return df.select(F.col(ident).cast("long"), "vector").where(
        F.col(ident).isNotNull() & F.col("vector").isNotNull() & ~bad
    )


def _pieces(rows: int, least: int) -> int:
    """Pieces of a side of the grid: of `least` rows, but no more than GRID while PIECE_ROWS fit one."""
    return max(1, min(-(-rows // least), max(GRID, -(-rows // PIECE_ROWS))))


def dense_topk(vectors: DataFrame, requests: DataFrame, k: int = 5,
               request_block: int | None = None, vector_block: int | None = None) -> DataFrame:
    """k nearest vectors (cosine) per request: query_id, item_id, score, rank.

    `vectors`: item_id, vector; `requests`: query_id, vector.  Ids are numbers, one row
    each; rows without id or whose vector is null or holds null or NaN take no part.

    Requests of one block (`request_block`) go to the tasks, which read the vectors where
    they are.  More requests form a grid with the vectors: pieces of both sides, a cell for
    each pair of pieces.  A cell is one group that holds a piece of either side and passes
    on k items a request, so no task, and not the driver, holds all of one side.

    Every row moves once per piece of the other side. So pieces grow with the data: there are
    at most `GRID` of a side as long as `PIECE_ROWS` rows fit one, and what moves grows as the
    rows do up to GRID * PIECE_ROWS of them; the products are one for each pair all the same.
    """
    request_block, vector_block = request_block or REQUEST_BLOCK, vector_block or VECTOR_BLOCK
    vectors, requests = _usable(vectors, "item_id"), _usable(requests, "query_id")
    asked = requests.limit(request_block + 1).toArrow()  # never more than one block
    if not asked.num_rows:
        found = vectors.sparkSession.createDataFrame([], _HIT_SCHEMA)
    elif asked.num_rows <= request_block:
        search = _in_place(asked["query_id"].to_numpy(), _matrix(asked["vector"]), k)
        found = vectors.mapInArrow(search, _HIT_SCHEMA)
    else:
        down, across = _pieces(requests.count(), request_block), _pieces(vectors.count(), vector_block)
        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        own = lambda ident, n: F.pmod(F.xxhash64(ident), F.lit(n)).cast("int")
        left = vectors.select("item_id", "vector", own("item_id", across).alias("x"), every(down).alias("y"))
        right = requests.select("query_id", "vector", own("query_id", down).alias("y"), every(across).alias("x"))
        found = left.groupBy("x", "y").cogroup(right.groupBy("x", "y")).applyInArrow(_cell(k), _HIT_SCHEMA)
    return _top(found, "query_id", "item_id", k)


def tokens(df: DataFrame, ident: str, text: str) -> DataFrame:
    """(ident, term) for every word of the lower-cased text."""
    words = F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    # The outer form: the plain one adds a filter that splits every text once more.
    return df.select(ident, F.explode_outer(words).alias("term")).filter(F.col("term").isNotNull())


_ALL = "\u0000"  # stands for the whole collection among the terms


def _score_tasks(asked: DataFrame, spread: DataFrame) -> int:
    """Tasks that add up the scores, from the exact number of rows that meet: df of each term asked."""
    met = asked.join(spread, "term").agg(F.sum("df")).first()[0] or 0
    return max(asked.sparkSession.sparkContext.defaultParallelism, -(-int(met) // TASK_PAIRS))


def bm25_topk(documents: DataFrame, requests: DataFrame, k: int = 5) -> DataFrame:
    """k best documents per request by BM25 over whole texts.

    `documents`: item_id, text; `requests`: query_id, text.  The collection is
    read twice: once for its size and the document counts of the terms asked
    for, once for the scores.  Of a document only its counts of those terms are
    shuffled, by document, so scores are added up and cut to the k best per
    request where the document is.  The tasks of that are as many as the rows that
    meet ask for (`TASK_PAIRS` each), whatever the collection's size.
    """
    asked = (
        tokens(requests, "query_id", "text").groupBy("query_id", "term")
        .agg(F.count(F.lit(1)).alias("asked"))
    )
    terms = asked.select("term").distinct()
    send = F.broadcast if asked.count() <= TERM_ROWS else (lambda df: df)

    words = F.regexp_extract_all(F.lower(F.col("text")), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    sized = documents.select("item_id", words.alias("words")).withColumn("size", F.size("words"))
    every = F.concat(F.array(F.lit(_ALL)), F.array_distinct("words"))
    wanted = terms.unionByName(terms.sparkSession.createDataFrame([(_ALL,)], "term string"))
    spread = settle(
        sized.select("size", F.explode_outer(every).alias("term"))
        .join(send(wanted), "term", "left_semi")
        .groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("size").alias("words")),
        "terms",
    )
    whole = spread.filter(F.col("term") == _ALL).first()
    n = int(whole["df"]) if whole else 0
    mean = (float(whole["words"]) / n if n else 0.0) or 1.0

    counted = (
        sized.select("item_id", "size", F.explode_outer("words").alias("term"))
        .join(send(terms), "term", "left_semi")
        .groupBy("item_id", "size", "term").agg(F.count(F.lit(1)).alias("tf"))
        .repartition(_score_tasks(asked, spread), "item_id")
    )
    weight = F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighted = asked.join(spread, "term").select(
        "query_id", "term", (weight * F.col("asked")).alias("weight")
    )
    length = F.lit(1 - BM25_B) + F.lit(BM25_B) * F.col("size") / F.lit(mean)
    part = F.col("weight") * F.col("tf") * (BM25_K1 + 1) / (F.col("tf") + BM25_K1 * length)
    scores = (
        counted.join(send(weighted), "term")
        .groupBy("query_id", "item_id").agg(F.round(F.sum(part), SCORE_DIGITS).alias("score"))
    )
    return _top(scores, "query_id", "item_id", k)


def fuse(*rankings: DataFrame, k: int = 5, constant: int = RANK_CONSTANT) -> DataFrame:
    """Reciprocal-rank fusion of rankings (query_id, item_id, rank)."""
    votes = None
    for ranking in rankings:
        vote = ranking.select("query_id", "item_id", (1.0 / (constant + F.col("rank"))).alias("vote"))
        votes = vote if votes is None else votes.unionByName(vote)
    fused = votes.groupBy("query_id", "item_id").agg(F.round(F.sum("vote"), 9).alias("score"))
    return _top(fused, "query_id", "item_id", k)


def hybrid_topk(documents: DataFrame, vectors: DataFrame, requests: DataFrame,
                request_vectors: DataFrame, k: int = 5) -> DataFrame:
    """k best documents per request by words and vectors together."""
    return fuse(
        bm25_topk(documents, requests, k), dense_topk(vectors, request_vectors, k), k=k
    )
