"""Line dedup by content-defined chunks of lines.

Only lines with a word count. Each has a hash, the first 32 bits of its MD5; a rolling
hash over two lines, 31 * previous + own modulo 2**32, times an odd number, is smallest
among its neighbours at the end of a chunk. So chunks depend on their own lines and the
next ones only, and lines put in or left out elsewhere don't shift them; no two ends are
side by side, so a chunk has two lines or more, and the last one of a text is never a
single line. Several factors (`FACTORS`) give several ways to cut a text, which
reach runs of lines that one way misses. A chunk goes from its first to its last line with a word, with what is
between; texts with one such line have no chunk.

Chunks are compared globally by digest; of those found more than once, the texts are then
compared byte by byte with the first occurrence (by doc_id, then line), which stays. The
others are removed with their lines; a line goes if one of its chunks does. What is
removed is kept at an earlier place, each line by itself where chunks overlap. Single
lines, and passages that begin or end inside a line, are beyond the method.

Only digests are shuffled for the counts. The texts of repeated chunks are found through
a bitmap of fixed size (`CELLS`), which may let other chunks pass that the join then
drops. Digests that hold a large share of all chunks are joined by broadcast.

Defined results: null texts stay null, empty texts empty, a text without line breaks
whole. Null doc_ids rank last and are told apart by text. Repeated rows (same doc_id and
text) count as one and are treated alike. All other columns stay. A text all of whose
lines go keeps its empty lines only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from linkspan.llm.common import (
    flat_steps, join_counted, pieces_of, rank, release, row_keys, small, steps, table_of, unused, with_lists, without,
)
from linkspan.sources.scratch import settle

#: Odd numbers below 2**31, each a way to cut; fixed values.
FACTORS = (1, 40503, 1103515245, 69069, 1664525)
CELLS = 1 << 22


def ends(own: np.ndarray, place: np.ndarray, size: np.ndarray, factor: int) -> np.ndarray:
    """Where chunks end, for the hashes of many texts' lines in a row.

    `place` counts the lines of a text from 0, `size` is their number.
    """
    mask = np.uint64(0xFFFFFFFF)
    before = np.concatenate([np.zeros(1, np.uint64), own[:-1]]) if len(own) else own
    rolled = (np.where(place > 0, before, 0).astype(np.uint64) * np.uint64(31) + own) * np.uint64(factor) & mask
    found = place == size - 1
    if len(own) > 2:
        inner = (rolled[1:-1] < rolled[:-2]) & (rolled[1:-1] <= rolled[2:])
        found[1:-1] |= inner & (place[1:-1] >= 1) & (place[1:-1] <= size[1:-1] - 3)
    return found


def chunks(texts: list[bytes], factors: tuple[int, ...] = FACTORS) -> tuple[np.ndarray, list[tuple[int, int, bytes]]]:
    """The number of each text's chunks, and (first line, last line exclusive, bytes) of all in a row."""
    lines = [t.split(b"\n") for t in texts]
    worded = [[i for i, line in enumerate(own) if line.strip()] for own in lines]
    counts = np.fromiter(map(len, worded), np.int64, len(worded))
    hashes = [int.from_bytes(hashlib.md5(own[i]).digest()[:4], "big") for own, at in zip(lines, worded) for i in at]
    own, size = np.array(hashes, np.uint64), np.repeat(counts, counts)
    text = np.repeat(np.arange(len(texts)), counts)
    place = np.arange(len(own)) - np.repeat(np.cumsum(counts) - counts, counts)
    found = []
    for factor in factors:
        last = np.flatnonzero(ends(own, place, size, factor))
        first = np.concatenate([[0], last[:-1] + 1]) if len(last) else last
        several = last > first
        found.append(first[several] << 32 | last[several])
    both = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
    first, last = both >> 32, both & 0xFFFFFFFF
    number = np.array([i for at in worded for i in at], np.int64)
    made = []
    for t, a, b in zip(text[first].tolist(), number[first].tolist(), (number[last] + 1).tolist(), strict=True):
        made.append((a, b, b"\n".join(lines[t][a:b])))
    return np.bincount(text[first], minlength=len(texts)), made


def _cell(digests: pa.Array) -> np.ndarray:
    heads = np.frombuffer(b"".join(d[:8] for d in digests.to_pylist()), np.uint64)
    return (heads % np.uint64(CELLS)).astype(np.int64)


def occurrences(
    docs: DataFrame, text: str = "text", factors: tuple[int, ...] = FACTORS, passing: np.ndarray | None = None,
) -> DataFrame:
    """doc_id, hash, first, last, digest of every chunk.

    With `passing`, only of those whose cell is set there, and with their bytes (body).
    """
    bodies = passing is not None
    sent = docs.sparkSession.sparkContext.broadcast(passing) if bodies else None

    def work(texts: list[str | None]) -> tuple[np.ndarray, list[pa.Array]]:
        counts, found = chunks([(t or "").encode() for t in texts], factors)
        digests = pa.array([hashlib.md5(body).digest() for _, _, body in found], pa.binary())
        if bodies and found:
            ok = sent.value[_cell(digests)]
            counts = np.bincount(np.repeat(np.arange(len(counts)), counts)[ok], minlength=len(counts))
            found, digests = [c for c, let in zip(found, ok, strict=True) if let], digests.filter(pa.array(ok))
        made = [pa.array([c[i] for c in found], pa.int32()) for i in (0, 1)] + [digests]
        return counts, made + ([pa.array([c[2] for c in found], pa.binary())] if bodies else [])

    own = docs.select(*row_keys(text), F.col(text).alias("text"))
    made = "first int, last int, digest binary" + (", body binary" if bodies else "")
    return flat_steps(own, ["doc_id", "hash"], F.col("text"), work, made)


def _bitmap(digests: DataFrame) -> np.ndarray:
    def mark(batches):
        table = np.zeros(CELLS, np.uint8)
        for batch in batches:
            table[_cell(batch.column(0))] = 1
        yield pieces_of(table.astype(np.int64))

    return table_of(digests.mapInArrow(mark, "piece int, cells binary"), CELLS) > 0


def repeated(docs: DataFrame, text: str = "text", factors: tuple[int, ...] = FACTORS) -> DataFrame:
    """doc_id, hash, first, last of the chunks to remove."""
    place = ["doc_id", "hash", "first", "last"]
    every = settle(occurrences(docs, text, factors), "chunks")
    groups = settle(
        every.dropDuplicates(place).groupBy("digest").agg(
            F.count(F.lit(1)).alias("n"), F.min(rank("first")).alias("earliest")
        ).where("n > 1"), "groups",
    )
    total = every.count()
    bodies = occurrences(docs, text, factors, _bitmap(groups.select("digest")))
    bodies = settle(bodies.dropDuplicates(place), "bodies")
    known = settle(join_counted(bodies, groups, "digest", total), "known")
    is_first = rank("first").eqNullSafe(F.col("earliest"))
    firsts = known.where(is_first).select("digest", "n", F.col("body").alias("first_body"))
    others = known.where(~is_first).drop("n", "earliest")
    compared = join_counted(others, settle(firsts, "firsts"), "digest", total)
    return compared.where("body = first_body").select(*place)


def dedup(
    docs: DataFrame, text: str = "text", factors: tuple[int, ...] = FACTORS, broadcast_rows: int = 1_000_000,
) -> DataFrame:
    """The documents without their repeated chunks, with lines, kept_lines and removed_chunks."""
    gone = settle(repeated(docs, text, factors), "repeated")
    lists = gone.groupBy("doc_id", "hash").agg(F.collect_list(F.struct("first", "last")).alias("cuts"))
    if small(gone, broadcast_rows) is not gone:
        lists = F.broadcast(lists)  # its size is that of `gone` at most
    others = without(docs, text, "lines", "kept_lines", "removed_chunks")
    text_at, cuts_at = unused("text", docs), unused("cuts", docs)
    found = with_lists(docs, lists, "cuts", text).select(
        *(F.col("row")[c].alias(c) for c in others), F.col("text").alias(text_at), F.col("cuts").alias(cuts_at)
    )
    new = StructType.fromDDL("text string, lines int, kept_lines int, removed_chunks int").fields
    schema = StructType([*found.schema.fields[:-2], *new])
    schema.fields[-4].name = schema.names[-4] = text_at
    names = [f.name for f in schema.fields]

    def removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for texts in steps(batch.column(batch.num_columns - 2)):
                part = batch.slice(at, len(texts))
                at += len(texts)
                out = []
                for value, cuts in zip(texts, part.column(part.num_columns - 1), strict=True):
                    lines = (value or "").encode().split(b"\n")
                    drop = {(c["first"], c["last"]) for c in cuts.as_py() or ()}
                    cut = {i for a, b in drop for i in range(a, b)}
                    kept = [x for i, x in enumerate(lines) if i not in cut]
                    out.append((None if value is None else b"\n".join(kept).decode(), len(lines), len(kept), len(drop)))
                made = [pa.array(x, f) for x, f in zip(zip(*out), (pa.string(), pa.int32(), pa.int32(), pa.int32()))]
                yield pa.RecordBatch.from_arrays([*part.columns[:-2], *made], names)
        release()

    made = found.mapInArrow(removed, schema)
    return made.select(
        *(F.col(text_at).alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns if c in [*others, text]),
        "lines", "kept_lines", "removed_chunks",
    )
