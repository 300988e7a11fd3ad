"""The prefix trie of conversations, from padded matrices of turn ids.

A turn is known by the MD5 of its role and text. Conversations are sorted by their turns
and dealt to tasks by ranges of that order, copies by conv_id, so that a node's members
lie side by side. Each task numbers its turns, puts them in matrices padded with -1, sorts
the rows with numpy's lexsort, and marks where a column or one before it changes: there
the nodes of each depth begin, and reduceat over these places aggregates them. Wide rows
are worked on in blocks of `WIDTH` columns, so that short ones aren't padded to the longest.

A node that holds a task's first or last row may go on in another task. These boundary
nodes, two paths a task, come out as parts and are put together afterwards: sums by a key
of the node's turns, and what lies below them by sums along the paths, where each node
counts on one of its paths only. Members that end in a boundary node come out as runs of
ids in order, and one pass over the runs makes their digest.

Texts never leave their first task; the digests and word counts of a conversation are one
row. The node of all is the root, which has no text.

Defined results: turns are ordered by `turn` (null first), rows with the same turn by their
digest; null roles and texts are empty; repeated rows are turns of their own. Rows with a
null conv_id belong to no conversation and are left out. No conversations give no nodes,
not even a root. Other columns are not used.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkspan.llm.common import small
from linkspan.sources.scratch import settle

WIDTH = 64
DIGEST = 16
#: Turns of a task, about.
TURNS = 100_000
#: Bytes of a run of ids.
RUN = 1 << 16
ROOT = bytes(DIGEST)


def gathered(rows: DataFrame, group: Column) -> DataFrame:
    """group, conv_id and its turns in order: array of (turn, digest, words).

    Conversations of one group come to one task, for `rebuilt`.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = rows.where("conv_id is not null").select(
        group.alias("group"), "conv_id", "turn",
        F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")).alias("digest"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).alias("words"),
    )
    return turns.repartition("group").groupBy("group", "conv_id").agg(
        F.sort_array(F.collect_list(F.struct("turn", "digest", "words"))).alias("turns")
    )


def sequences(conversations: DataFrame) -> DataFrame:
    """conv_id, key (the digests of its turns in a row) and words (of each turn)."""
    return conversations.select(
        "conv_id", F.unhex(F.array_join(F.transform("turns", lambda t: t["digest"]), "")).alias("key"),
        F.transform("turns", lambda t: t["words"].cast("int")).alias("words"),
    )


def of_rows(rows: DataFrame) -> DataFrame:
    """`sequences` of the conversations as they are."""
    return sequences(gathered(rows, F.col("conv_id")))


def rebuilt(rows: DataFrame, every: int = 20, most: int = 4) -> DataFrame:
    """`sequences` in which conversation c begins with h turns of c - c % every.

    h is crc32(c) % most; these turns stand in the place of its own first h.
    """
    id_ = F.col("conv_id")
    own = gathered(rows, id_ - id_ % every)
    head = F.first(F.when(F.col("group") == id_, F.slice("turns", 1, most)), True).over(Window.partitionBy("group"))
    h = (F.crc32(id_.cast("string").cast("binary")) % most).cast("int")
    made = own.withColumn("head", head).withColumn("h", h)
    begins = F.coalesce(F.slice("head", F.lit(1), F.col("h")), F.slice("turns", 1, 0))
    return sequences(made.withColumn("turns", F.concat(begins, F.slice("turns", F.col("h") + 1, F.size("turns")))))


class _Shard:
    """The rows of one task, sorted, and their nodes by depth."""

    def __init__(self, ids: np.ndarray, keys: list[bytes], words: np.ndarray):
        self.sizes = np.fromiter(map(len, keys), np.int64, len(keys)) // DIGEST
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.ids, self.keys, self.words = ids, keys, words
        halves = np.frombuffer(b"".join(keys), ">u8").reshape(-1, 2).astype(np.uint64)
        order = np.lexsort((halves[:, 1], halves[:, 0]))
        new = np.ones(len(order), bool)
        new[1:] = (halves[order[1:]] != halves[order[:-1]]).any(axis=1)
        self.turns = np.zeros(len(order), np.int32)
        self.turns[order] = np.cumsum(new, dtype=np.int32)
        self.order = self._sorted()

    def _block(self, rows: np.ndarray, first: int) -> np.ndarray:
        """The turns from column `first` on, padded."""
        wide = int(min(WIDTH, self.sizes[rows].max() - first))
        columns = first + np.arange(wide)
        inside = columns < self.sizes[rows][:, None]
        at = np.where(inside, self.starts[rows][:, None] + columns, 0)
        return np.where(inside, self.turns[at], -1)

    def _sorted(self) -> np.ndarray:
        """Rows by their turns, then by id; from the last block of columns to the first."""
        rank = np.zeros(len(self.ids), np.int64)
        longest = int(self.sizes.max(initial=0))
        for first in range((longest - 1) // WIDTH * WIDTH, -1, -WIDTH):
            rows = np.flatnonzero(self.sizes > first)
            if len(rows):
                block = self._block(rows, first)
                order = np.lexsort((self.ids[rows], rank[rows], *block.T[::-1]))
                rank[rows[order]] = np.arange(1, len(rows) + 1)
        return np.lexsort((self.ids, rank))

    def depths(self) -> Iterator[dict]:
        """For each depth: first row, members, least id, ends, words and parent of its nodes.

        `edge` has the nodes of the first and of the last row, -1 where they have ended.
        """
        order, ids = self.order, self.ids
        none = int((self.sizes == 0).sum())
        yield {
            "first": np.zeros(1, np.int64), "members": np.array([len(ids)]), "least": np.array([ids.min()]),
            "ends": np.array([none]), "words": np.zeros(1, np.int64), "parent": np.zeros(1, np.int64),
            "rows": order, "edge": (0, 0),
        }
        node = np.zeros(len(ids), np.int64)  # of each row, in order
        for start in range(0, int(self.sizes.max(initial=0)), WIDTH):
            at = np.flatnonzero(self.sizes[order] > start)
            rows = order[at]
            block = self._block(rows, start)
            changed = np.ones(block.shape, bool)
            changed[1:] = block[1:] != block[:-1]
            changed[1:, 0] |= node[at][1:] != node[at][:-1]
            np.logical_or.accumulate(changed, axis=1, out=changed)
            before = node[at]
            for column in range(block.shape[1]):
                depth = start + column + 1
                runs = np.flatnonzero(changed[:, column])
                real = block[runs, column] >= 0
                begin = runs[real]
                own = np.cumsum(np.bincount(begin, minlength=len(at))) - 1
                own[block[:, column] < 0] = -1
                yield {
                    "first": begin, "members": np.diff(np.append(runs, len(at)))[real],
                    "least": np.minimum.reduceat(ids[rows], runs)[real],
                    "ends": np.add.reduceat((self.sizes[rows] == depth).astype(np.int64), runs)[real],
                    "words": self.words[self.starts[rows[begin]] + depth - 1].astype(np.int64),
                    "parent": before[begin], "rows": rows,
                    "edge": tuple(int(own[i]) if at[i] == end else -1 for i, end in ((0, 0), (-1, len(ids) - 1))),
                }
                before = own
            node = np.full(len(ids), -1, np.int64)
            node[at] = before


def _summed(levels: list[dict]) -> None:
    """children, leaves and saved of every node; what boundary nodes are themselves isn't counted."""
    for depth in range(len(levels) - 1, -1, -1):
        level = levels[depth]
        size = len(level["first"])
        edge = np.zeros(size, bool)
        edge[[i for i in level["edge"] if i >= 0]] = True
        level["boundary"] = edge
        level["children"], level["leaves"], level["saved"] = (np.zeros(size, np.int64) for _ in range(3))
        if depth + 1 < len(levels):
            below = levels[depth + 1]
            places = np.flatnonzero(np.diff(below["parent"], prepend=-1))
            parents = below["parent"][places]
            level["children"][parents] = np.add.reduceat((~below["boundary"]).astype(np.int64), places)
            for name in ("leaves", "saved"):
                level[name][parents] = np.add.reduceat(below[name], places)
        own = ~edge
        level["leaves"] += own & (level["children"] == 0)
        level["saved"] += np.where(own, (level["members"] - 1) * level["words"], 0)


FIELDS = [
    ("kind", pa.int32()), ("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64()),
    ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()),
    ("ends_sha256", pa.string()), ("node", pa.binary()), ("parent", pa.binary()), ("words", pa.int64()),
    ("path", pa.int64()), ("run", pa.string()),
]
WHOLE, PART, ENDS = 0, 1, 2
_NOBODY = hashlib.sha256(b"").hexdigest()


def _chain(key: bytes) -> list[bytes]:
    """The keys of the nodes of a row, the root first."""
    keys = [ROOT]
    for at in range(0, len(key), DIGEST):
        keys.append(hashlib.blake2b(keys[-1] + key[at:at + DIGEST], digest_size=DIGEST).digest())
    return keys


def _batch(columns: dict, n: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[f], k) if f in columns else pa.nulls(n, k) for f, k in FIELDS], [f for f, _ in FIELDS]
    )


def _runs(ids: list[int]) -> Iterator[tuple[int, str]]:
    for at in range(0, len(ids), RUN // 16):
        yield ids[at], ",".join(map(str, ids[at:at + RUN // 16]))


def _nodes_of(shard: _Shard, number: int) -> Iterator[pa.RecordBatch]:
    """Whole nodes, parts of boundary nodes, and runs of ids that end in these."""
    levels = list(shard.depths())
    _summed(levels)
    ends = [_chain(shard.keys[shard.order[i]]) for i in (0, -1)]
    for depth, level in enumerate(levels):
        sorted_ids = shard.ids[level["rows"]]
        whole = np.flatnonzero(~level["boundary"])
        if len(whole):
            above = levels[depth - 1]
            parents = level["parent"][whole]
            inside = ~above["boundary"][parents]
            key = {i: ends[side][depth - 1] for side, i in enumerate(above["edge"]) if i >= 0}
            digests = [
                hashlib.sha256(",".join(map(str, sorted_ids[a:a + n].tolist())).encode()).hexdigest() if n else _NOBODY
                for a, n in zip(level["first"][whole].tolist(), level["ends"][whole].tolist(), strict=True)
            ]
            yield _batch({
                "kind": np.full(len(whole), WHOLE), "conv_id": level["least"][whole], "depth": np.full(len(whole), depth),
                "parent_conv_id": pa.array(above["least"][parents], pa.int64(), mask=~inside),
                "parent": [None if i else key[p] for i, p in zip(inside.tolist(), parents.tolist())],
                "n_convs": level["members"][whole], "n_children": level["children"][whole],
                "n_leaves": level["leaves"][whole], "saved_tokens": level["saved"][whole], "ends_sha256": digests,
            }, len(whole))
        for side, node in enumerate(level["edge"]):
            if node < 0:
                continue
            again = side == 1 and node == level["edge"][0]
            made = {
                "kind": [PART], "depth": [depth], "node": [ends[side][depth]], "path": [2 * number + side],
                "parent": [ends[side][depth - 1] if depth else None], "words": [int(level["words"][node])],
                "conv_id": [int(level["least"][node])],
            }
            for name, source in (
                ("n_convs", "members"), ("n_children", "children"), ("n_leaves", "leaves"), ("saved_tokens", "saved"),
            ):
                made[name] = [0 if again else int(level[source][node])]
            yield _batch(made, 1)
            if not again and (n := int(level["ends"][node])):
                first = int(level["first"][node])
                for least, run in _runs(sorted_ids[first:first + n].tolist()):
                    yield _batch({"kind": [ENDS], "node": made["node"], "conv_id": [least], "run": [run]}, 1)


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ids, keys, words = [], [], []
    for batch in batches:
        ids.append(batch.column(0).to_numpy(zero_copy_only=False))
        keys += batch.column(1).to_pylist()
        words.append(batch.column(2).flatten().to_numpy(zero_copy_only=False))
    if keys:
        shard = _Shard(np.concatenate(ids), keys, np.concatenate(words))
        yield from _together(_nodes_of(shard, TaskContext.get().partitionId()))


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Small batches put together."""
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows > 5000 or len(held) > 500:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, rows = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _digests(runs: DataFrame) -> DataFrame:
    """node, ends_sha256: runs pass in order, only the running digest is held."""

    def pass_over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, digest = None, None
        for batch in batches:
            nodes, made = [], []
            for own, run in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if own != node:
                    if node is not None:
                        nodes.append(node)
                        made.append(digest.hexdigest())
                    node, digest = own, hashlib.sha256(run.encode())
                else:
                    digest.update(b"," + run.encode())
            yield pa.RecordBatch.from_pydict({"node": pa.array(nodes, pa.binary()), "ends_sha256": pa.array(made, pa.string())})
        if node is not None:
            yield pa.RecordBatch.from_pydict({"node": [node], "ends_sha256": [digest.hexdigest()]})

    ordered = runs.repartition("node").sortWithinPartitions("node", "conv_id").select("node", "run")
    return ordered.mapInArrow(pass_over, "node binary, ends_sha256 string")


RESULT = [
    "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256",
]


def nodes(conversations: DataFrame, turns: int = TURNS, broadcast_rows: int = 200_000) -> DataFrame:
    """A row for each node: conv_id (its smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    `conversations` as from `of_rows` or `rebuilt`. A task has about `turns` turns; there
    are two boundary paths a task, joined by broadcast where they have so few rows.
    """
    stored = settle(conversations, "sequences")
    spark = stored.sparkSession
    total = stored.agg(F.sum(F.size("words"))).first()[0] or 0
    tasks = max(spark.sparkContext.defaultParallelism, -(-total // turns))
    kinds = {pa.int32(): "int", pa.int64(): "long", pa.string(): "string", pa.binary(): "binary"}
    dealt = stored.repartitionByRange(tasks, "key", "conv_id").select("conv_id", "key", "words")
    made = settle(dealt.mapInArrow(_shards, ", ".join(f"{f} {kinds[k]}" for f, k in FIELDS)), "nodes")

    parts = made.where(F.col("kind") == PART)
    edge = settle(parts.groupBy("node").agg(
        F.max("depth").alias("depth"), F.max("parent").alias("parent"), F.max("words").alias("words"),
        F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.sum("n_children").alias("n_children"),
        F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"), F.min("path").alias("own_path"),
    ), "boundary")
    below = edge.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("more"))
    known = settle(edge.join(below, "node", "left").withColumn(
        "n_children", F.col("n_children") + F.coalesce("more", F.lit(0))
    ), "boundary")
    near = small(known, broadcast_rows)
    values = near.select(
        "node", "own_path", (F.col("n_children") == 0).cast("long").alias("leaf"),
        ((F.col("n_convs") - 1) * F.col("words")).alias("spared"),
    )
    own = F.col("path") == F.col("own_path")
    upwards = Window.partitionBy("path").orderBy(F.desc("depth"))
    along = parts.select("node", "path", "depth").join(values, "node").select(
        "node", F.sum(F.when(own, F.col("leaf")).otherwise(0)).over(upwards).alias("leaves"),
        F.sum(F.when(own, F.col("spared")).otherwise(0)).over(upwards).alias("saved"),
    ).groupBy("node").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    names = near.select(F.col("node").alias("parent"), F.col("conv_id").alias("least"))
    boundary = known.join(along, "node").join(_digests(made.where(F.col("kind") == ENDS)), "node", "left").join(
        names, "parent", "left"
    ).select(
        "conv_id", "depth", F.col("least").alias("parent_conv_id"), "n_convs", "n_children",
        (F.col("n_leaves") + F.col("leaves")).alias("n_leaves"),
        (F.col("saved_tokens") + F.col("saved")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(_NOBODY)).alias("ends_sha256"),
    )
    whole = made.where(F.col("kind") == WHOLE).join(names, "parent", "left").withColumn(
        "parent_conv_id", F.coalesce("parent_conv_id", "least")
    )
    return whole.select(*RESULT).unionByName(boundary.select(*RESULT))
