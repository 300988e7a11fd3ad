"""Jaccard join of word shingles with adaptive multi-match prefixes, and its components.

Documents with equal shingle sets are one node. Shingles have one global order: by an
estimate of how many documents hold them, from a sketch of fixed size over the whole
corpus, rarest first, then by hash. If two sets are similar enough, the first
n - ceil(share * n) + l shingles of both have at least l in common, for every l. Each node
chooses the l for which the estimated candidates of its prefix and their verification
cost least: nodes with rare shingles use short prefixes, nodes full of frequent ones
longer prefixes, and a pair must share min(l, l') of them before it is verified.

Components are wanted, so pairs known to be connected are not looked at again:
1. In each shingle's bucket every node is verified against one pivot only, the node with
   the smallest share of rare shingles (the original of edited copies). The links give
   first components.
2. In buckets with several components, all pairs of nodes of different components that
   share enough prefix shingles are verified, whatever their number: no link that could
   join two components is missed. Within the largest component of a bucket no pair is formed.

The order, the choice of l and the pivots only bear on speed. Hot buckets, copies and
components are joined by broadcast of the few hot keys. A pair is formed only by a
shingle whose places in the two orders leave room for enough common ones after it, and
only if the parities of the two sets (512 bits, each shingle flips one) differ in no more
bits than similar sets differ in shingles; this bound holds always, so it loses no pair.
Sets are 64-bit hashes of the shingles, and equal sets are found by 128 bits.

Defined results: A-Z is lower-cased; words are runs of other than space and \\x09-\\x0D.
Fewer than `words` words are one shingle; no word (or null) is the empty set, linked
with nothing. component_id is the smallest doc_id of the component; rows with a null
doc_id take part, and their component_id is null if no member has an id. Rows without a
shingle are their own component. Repeated rows are alike. Other columns are not used.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkspan.llm.common import (
    join_counted, map_steps, mixed, pieces_of, rank, release, row_keys, small, steps, table_of,
)
from linkspan.sources.scratch import settle

CELLS = 1 << 20
MOST_MATCHES = 8
#: What verifying a candidate costs, against handling a row of a bucket.
VERIFY = 20
#: Edges, of 16 bytes each, that one task merges.
FEW_EDGES = 100_000
#: Names of the words of a set's parity.
PARITY = [f"parity{i}" for i in range(8)]
_FACTORS = mixed(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


class _Hashes(dict):
    """Hashes of words, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 50_000:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


_hashes = _Hashes()


def shingles(text: str | None, words: int = 4) -> np.ndarray:
    """The sorted distinct hashes of the text's shingles."""
    found = (text or "").encode().lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    own = np.fromiter(map(_hashes.__getitem__, found), np.uint64, len(found))
    size = min(words, len(own))
    total = np.full(len(own) - size + 1, size, np.uint64)
    for i in range(size):
        total += own[i:len(own) - size + 1 + i] * _FACTORS[i]
    return np.unique(mixed(total))


def node_of(own: np.ndarray) -> bytes:
    """128 bits that stand for a set."""
    a, b = mixed(own), mixed(own ^ np.uint64(0x5851F42D4C957F2D))
    return b"".join(int(x.sum(dtype=np.uint64)).to_bytes(8, "big") for x in (a, b))


def parity(own: np.ndarray) -> np.ndarray:
    """Of each of 512 cells, whether it holds an odd number of the set's hashes; as eight numbers.

    Two sets differ in at least as many shingles as their parities do in bits.
    """
    cells = (own >> np.uint64(32)) & np.uint64(64 * len(PARITY) - 1)
    odd = np.bincount(cells.astype(np.int64), minlength=64 * len(PARITY)) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def few_differ(share: int) -> str:
    """Whether the parities of two sets of n and n_b shingles allow them to be similar."""
    bits = " + ".join(f"bit_count({p} ^ {p}_b)" for p in PARITY)
    return f"{bits} <= n + n_b - 2 * cast(ceil({share} * (n + n_b) / {100 + share}) as int)"


def survey(docs: DataFrame, text: str, words: int) -> DataFrame:
    """One pass: a row for each document (doc_id, hash, n, node, parity), and the pieces of the sketch."""
    numbers = ", ".join(f"{p} long" for p in PARITY)
    schema = f"doc_id long, hash long, n int, node binary, {numbers}, piece int, cells binary"
    names = ["doc_id", "hash", "n", "node", *PARITY, "piece", "cells"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), *[pa.int64()] * len(PARITY), pa.int32(), pa.binary()]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(CELLS, np.int64)
        for batch in batches:
            at = 0
            for run in steps(batch.column(2)):
                sets = [shingles(t, words) for t in run]
                part = batch.slice(at, len(run))
                at += len(run)
                sketch += np.bincount((np.concatenate(sets) >> np.uint64(44)).astype(np.int64), minlength=CELLS)
                none = pa.nulls(len(run), pa.int32()), pa.nulls(len(run), pa.binary())
                odd = np.array(list(map(parity, sets)), np.int64).reshape(-1, len(PARITY))
                yield pa.RecordBatch.from_arrays([
                    part.column(0), part.column(1), pa.array(list(map(len, sets)), pa.int32()),
                    pa.array(list(map(node_of, sets)), pa.binary()), *(pa.array(odd[:, i]) for i in range(len(PARITY))), *none,
                ], names)
        pieces = pieces_of(sketch)
        empty = [pa.nulls(len(pieces), k) for k in kinds[:-2]]
        yield pa.RecordBatch.from_arrays([*empty, *pieces.columns], names)
        _hashes.clear()
        release()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("hash"), text)
    return rows.mapInArrow(scan, schema)


def frequencies(sketch: np.ndarray) -> np.ndarray:
    """How many documents hold a shingle, about, for each cell; 1 if it can't be told from chance."""
    usual = sketch.mean()
    over = sketch - usual - 4 * np.sqrt(usual)
    return np.maximum(over, 1.0)


def least_shared(n: np.ndarray | int, share: int):
    """The least overlap that a set of n shingles has with a similar one."""
    return -(-share * n // 100)


def prefix(own: np.ndarray, often: np.ndarray, share: int) -> tuple[np.ndarray, int, int]:
    """The prefix of a set, its l, and its share of rare shingles in thousandths."""
    count = often[(own >> np.uint64(44)).astype(np.int64)]
    level = np.floor(np.log2(count)).astype(np.int64)
    order = np.lexsort((own, level))
    n, needed = len(own), int(least_shared(len(own), share))
    others = np.cumsum(count[order] - 1)
    most = min(MOST_MATCHES, needed)
    sizes = n - needed + np.arange(1, most + 1)
    candidates = others[sizes - 1]
    cost = sizes + candidates * (1 + VERIFY / np.arange(1, most + 1))
    matches = int(np.argmin(cost)) + 1
    return own[order[:sizes[matches - 1]]], matches, int(1000 * np.mean(level == 0))


def prefixes(reps: DataFrame, often: np.ndarray, share: int, words: int) -> DataFrame:
    """token, id, n, l, rare, pos for each shingle of the prefixes. `reps` has id and text."""
    sent = reps.sparkSession.sparkContext.broadcast(often)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            at = 0
            for run in steps(batch.column(1)):
                tokens, facts = [], []
                for text in run:
                    own = shingles(text, words)
                    head, matches, rare = prefix(own, sent.value, share)
                    tokens.append(head.view(np.int64))
                    facts.append((ids[at], len(own), matches, rare, len(head)))
                    at += 1
                made = np.array(facts, dtype=np.int64)
                each = np.repeat(made[:, :4], made[:, 4], axis=0)
                places = np.concatenate([np.arange(1, f[4] + 1, dtype=np.int32) for f in facts])
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.concatenate(tokens)), pa.array(each[:, 0]),
                    *(pa.array(each[:, i].astype(np.int32)) for i in (1, 2, 3)), pa.array(places),
                ], ["token", "id", "n", "l", "rare", "pos"])
        _hashes.clear()
        release()

    return reps.select("id", "text").mapInArrow(cut, "token long, id long, n int, l int, rare int, pos int")


def in_reach(share: int) -> str:
    """Whether a shared shingle may be the first one of a similar pair.

    Sets of n and n_b that are similar share at least o = ceil(share * (n + n_b) / (100 + share))
    shingles, so the first is among the first n - o + 1 of one and n_b - o + 1 of the other.
    """
    least = f"cast(ceil({share} * (n + n_b) / {100 + share}) as int)"
    return (
        f"pos <= n - {least} + 1 and pos_b <= n_b - {least} + 1 "
        f"and 100 * least(n, n_b) >= {share} * greatest(n, n_b)"
    )


def histogram(own: np.ndarray) -> np.ndarray:
    """How many of a set's hashes fall in each of about half as many cells, by their last bits."""
    cells = 1 << max(3, (len(own) // 2).bit_length())
    return np.minimum(np.bincount((own & np.uint64(cells - 1)).astype(np.int64), minlength=cells), 255).astype(np.uint8)


def most_shared(left: np.ndarray, right: np.ndarray) -> int:
    """An upper bound of the overlap of two sets, from their histograms."""
    if len(left) < len(right):
        left, right = right, left
    full = bool((left == 255).any() or (right == 255).any())
    folded = left.reshape(-1, len(right)).sum(axis=0, dtype=np.int64)
    return 1 << 62 if full else int(np.minimum(folded, right).sum())


def similar(pairs: DataFrame, reps: DataFrame, share: int, words: int, broadcast_rows: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar; `pairs` has their sizes too.

    Histograms, a sixteenth of a set's size, go to all pairs first and leave out those
    that can't share enough; whole sets go to the others.
    """

    def drawn(texts: list[str | None]) -> list[pa.Array]:
        return [pa.array([histogram(shingles(t, words)).tobytes() for t in texts], pa.binary())]

    def packed(texts: list[str | None]) -> list[pa.Array]:
        return [pa.array([shingles(t, words).tobytes() for t in texts], pa.binary())]

    @F.arrow_udf("boolean")
    def possible(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for left, right, size_a, size_b in batches:
            out = []
            for x, y, n, m in zip(left, right, size_a.to_pylist(), size_b.to_pylist(), strict=True):
                both = most_shared(*(np.frombuffer(v.as_py(), np.uint8) for v in (x, y)))
                out.append((100 + share) * both >= share * (n + m))
            yield pa.array(out, pa.bool_())

    @F.arrow_udf("boolean")
    def close(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for left, right in batches:
            out = []
            for x, y in zip(left, right, strict=True):
                x, y = (np.frombuffer(v.as_py(), np.uint64) for v in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                out.append(100 * both >= share * (len(x) + len(y) - both))
            yield pa.array(out, pa.bool_())

    def checked(rows: DataFrame, made, test, more: list[str], name: str) -> DataFrame:
        ids = settle(rows.select(F.explode(F.array("a", "b")).alias("id")).distinct(), f"{name}_ids")
        found = reps.join(small(ids, broadcast_rows), "id", "left_semi")
        sets = settle(map_steps(found, ["id"], F.col("text"), made, "own binary"), name)
        one, two = (sets.select(F.col("id").alias(c), F.col("own").alias(f"set_{c}")) for c in ("a", "b"))
        return rows.join(one, "a").join(two, "b").where(test("set_a", "set_b", *more)).select(*rows.columns)

    left = settle(checked(pairs, drawn, possible, ["size_a", "size_b"], "histograms"), "possible")
    return checked(left.select("a", "b"), packed, close, [], "sets")


def components(edges: DataFrame, few: int = FEW_EDGES) -> DataFrame:
    """id, label of every node with an edge; nodes that are connected share a label.

    Each round merges every node with its smallest neighbour in a random order, so that
    about half of the nodes go, and ends when no edge is left. Rounds with at most `few`
    edges left work on them in one task, without a shuffle.
    """
    edges = settle(edges.where("a <> b").distinct(), "edges")
    labels, step = None, 0
    while left := edges.count():
        step += 1
        if left <= few:
            edges = edges.coalesce(1)
        order = F.xxhash64(F.col("v"), F.lit(step))
        both = edges.select(F.explode(F.array(
            F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")),
            F.struct(F.col("a").alias("u"), F.col("a").alias("v")), F.struct(F.col("b").alias("u"), F.col("b").alias("v")),
        )).alias("e")).select("e.*")
        goes = both.groupBy("u").agg(F.min(F.struct(order.alias("o"), "v")).alias("to")).select("u", F.col("to.v").alias("goal"))
        goes = settle(goes, "goes")
        if left <= few:
            goes = goes.coalesce(1)
        if labels is None:
            labels = goes.select(F.col("u").alias("id"), F.col("goal").alias("label"))
        else:
            moved = labels.join(goes, F.col("label") == F.col("u"), "left")
            labels = settle(moved.select("id", F.coalesce("goal", "label").alias("label")), "labels")
        first = edges.join(goes, F.col("a") == F.col("u")).select(F.col("goal").alias("x"), "b")
        new = first.join(goes, F.col("b") == F.col("u")).select("x", F.col("goal").alias("y")).where("x <> y")
        edges = settle(new.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
    if labels is None:
        labels = edges.select(F.col("a").alias("id"), F.col("b").alias("label"))
    return labels


def near_duplicates(
    docs: DataFrame, text: str = "text", share: int = 85, words: int = 4, broadcast_rows: int = 1_000_000,
) -> DataFrame:
    """doc_id, hash, n_shingles, component_id and is_first of every document.

    `share`: the least similarity in percent. is_first: it is the first of its component
    by doc_id, null ones last, then by a hash of the text; documents without a shingle are.
    """
    seen = settle(survey(docs, text, words), "survey")
    found = seen.where("node is not null")
    sets = found.select("doc_id", "hash", "n", "node")
    often = frequencies(table_of(seen.where("piece is not null").select("piece", "cells"), CELLS))
    total = sets.count()
    nodes = settle(
        found.where("n > 0").groupBy("node").agg(
            F.count(F.lit(1)).alias("n"), F.min(rank()).alias("first"), *(F.min(p).alias(p) for p in PARITY)
        ).withColumn("id", F.monotonically_increasing_id()), "nodes",
    )
    firsts = nodes.select("id", F.col("first.doc_id").alias("own_id"), F.col("first.hash").alias("own_hash"))
    rows = docs.select(*row_keys(text), F.col(text).alias("text"))
    # A repeated row would stand for its node twice, so ids are made distinct where rows are counted.
    reps = rows.join(
        small(firsts, broadcast_rows), F.col("doc_id").eqNullSafe(F.col("own_id")) & (F.col("hash") == F.col("own_hash"))
    ).select("id", "text")
    links = _links(reps, nodes.select("id", *PARITY), often, share, words, broadcast_rows)
    labels = components(links)
    known = nodes.join(labels, "id", "left").select(
        "node", "n", "first", F.coalesce("label", "id").alias("label")
    )
    known = settle(known, "known")
    merged = settle(known.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.min("first").alias("smallest")), "merged")
    named = settle(
        join_counted(known.withColumnRenamed("n", "copies"), merged, "label", nodes.count())
        .select("node", F.col("copies").alias("n"), "smallest"), "named",
    )
    full = join_counted(sets.where("n > 0").withColumnRenamed("n", "n_shingles"), named, "node", total)
    result = full.select(
        "doc_id", "hash", F.col("n_shingles").cast("long").alias("n_shingles"),
        F.col("smallest.doc_id").alias("component_id"), rank().eqNullSafe(F.col("smallest")).alias("is_first"),
    )
    return result.unionByName(sets.where("n = 0").select(
        "doc_id", "hash", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"),
        F.lit(True).alias("is_first"),
    ))


def _links(
    reps: DataFrame, parities: DataFrame, often: np.ndarray, share: int, words: int, broadcast_rows: int,
) -> DataFrame:
    """Links enough to connect all that is connected."""
    every = settle(prefixes(reps, often, share, words), "prefixes")
    counts = settle(every.groupBy("token").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "counts")
    shared = settle(
        join_counted(every, counts.withColumnRenamed("n", "held"), "token", every.count(), "held"), "shared"
    )
    pivots = settle(shared.groupBy("token").agg(
        F.count(F.lit(1)).alias("held"), F.min(F.struct("rare", "id", "n", "l", "pos")).alias("pivot")
    ), "pivots")
    other = ["id", "n", "l", "pos"]
    to_pivot = join_counted(shared.drop("held"), pivots, "token", shared.count(), "held").select(
        *other, *(F.col(f"pivot.{c}").alias(f"{c}_b") for c in other)
    ).where("id <> id_b").where(in_reach(share))
    first = to_pivot.select(*_ordered(
        F.struct("id", "n"), F.struct(F.col("id_b").alias("id"), F.col("n_b").alias("n"))
    )).distinct()
    links = settle(similar(settle(first, "first"), reps, share, words, broadcast_rows), "links")

    labels = components(links)
    placed = settle(shared.join(labels, "id", "left").select(
        "token", *other, F.coalesce("label", "id").alias("label")
    ).distinct(), "placed")
    members = placed.groupBy("token", "label").agg(F.count(F.lit(1)).alias("members"))
    several = members.groupBy("token").agg(
        F.count(F.lit(1)).alias("labels"), F.max(F.struct("members", "label")).alias("largest")
    ).where("labels > 1").select("token", F.col("largest.label").alias("largest"))
    apart = settle(placed.join(several, "token").join(parities, "id"), "apart")
    # Of buckets with the same nodes one forms all pairs of the others: that of the first
    # shingle, whose places are the smallest in every node.
    held_by = apart.groupBy("token").agg(
        F.count(F.lit(1)).alias("held"), F.bit_xor(F.xxhash64("id")).alias("x"),
        F.bit_xor(F.xxhash64("id", F.lit(1))).alias("y"), F.min(F.struct("id", "pos")).alias("place"),
    )
    chosen = held_by.groupBy("held", "x", "y").agg(F.min_by("token", "place").alias("token")).select("token")
    chosen = settle(apart.join(chosen, "token", "left_semi"), "chosen")
    others = chosen.select("token", *(F.col(c).alias(f"{c}_b") for c in [*other, "label", *PARITY]))
    crossing = chosen.where("label <> largest").join(others, "token").where(
        f"label <> label_b and (label_b = largest or label < label_b) and {in_reach(share)} and {few_differ(share)}"
    )
    found = settle(crossing.select(
        *_ordered(F.struct("id", "n"), F.struct(F.col("id_b").alias("id"), F.col("n_b").alias("n"))),
        F.least("l", "l_b").alias("needed"),
    ).distinct(), "crossing")
    # Pairs must share `needed` shingles of their whole prefixes; a prefix is a part of one set.
    heads = apart.join(
        found.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "id", "left_semi"
    ).groupBy("id").agg(F.collect_set("token").alias("head"))
    heads = settle(heads, "heads")
    one, two = (heads.select(F.col("id").alias(c), F.col("head").alias(f"head_{c}")) for c in ("a", "b"))
    pairs = found.join(one, "a").join(two, "b").where("size(array_intersect(head_a, head_b)) >= needed")
    pairs = settle(pairs.select("a", "b", "size_a", "size_b"), "pairs")
    return links.unionByName(similar(pairs, reps, share, words, broadcast_rows))


def _ordered(one, two) -> list:
    """a, b, size_a and size_b of two (id, n): a is the smaller id."""
    low, high = F.least(one, two), F.greatest(one, two)
    return [low["id"].alias("a"), high["id"].alias("b"), low["n"].alias("size_a"), high["n"].alias("size_b")]


def kept(docs: DataFrame, found: DataFrame, text: str = "text", broadcast_rows: int = 1_000_000) -> DataFrame:
    """The first document of each component, unchanged. `found`: stored, as from `near_duplicates`.

    Rows that agree in doc_id and text are first together and all stay; `once` leaves one.
    """
    gone = found.where(~F.col("is_first")).select(F.col("doc_id").alias("own_id"), F.col("hash").alias("own_hash")).distinct()
    own = docs.select(F.struct("*").alias("row"), *row_keys(text))
    same = F.col("doc_id").eqNullSafe(F.col("own_id")) & (F.col("hash") == F.col("own_hash"))
    return own.join(small(gone, broadcast_rows), same, "left_anti").select("row.*")


def once(docs: DataFrame, found: DataFrame, text: str = "text", broadcast_rows: int = 1_000_000) -> DataFrame:
    """What `kept` leaves, with one of the rows that agree in doc_id (or have none) and text.

    `found`: as for `kept`. Only texts that occur more than once are shuffled, and of those
    one for each task.
    """
    twice = found.where("is_first").groupBy(F.col("doc_id").alias("own_id"), F.col("hash").alias("own_hash")).agg(
        F.count(F.lit(1)).alias("n")
    ).where("n > 1").select("own_id", "own_hash")
    twice = small(settle(twice, "twice"), broadcast_rows)
    own = docs.select(F.struct("*").alias("row"), *row_keys(text), F.col(text).alias("text"))
    same = F.col("doc_id").eqNullSafe(F.col("own_id")) & (F.col("hash") == F.col("own_hash"))
    single = own.join(twice, same, "left_anti")
    several = own.join(twice, same, "left_semi").dropDuplicates(["doc_id", "text"])
    return single.unionByName(several).select("row.*")
