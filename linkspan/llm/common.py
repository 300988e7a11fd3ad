"""Small helpers shared by the operators of this folder."""

from __future__ import annotations

import base64
import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Code points that one step of a vectorised Python function works on at a time.
STEP_CHARS = 500_000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def unused(stem: str, *frames: DataFrame) -> str:
    """A column name that none of the frames has, whatever the case."""
    taken = {c.lower() for f in frames for c in f.columns}
    while stem.lower() in taken:
        stem = "_" + stem
    return stem


def add_struct(df: DataFrame, made: Column, names: list[str], keep: bool = True) -> DataFrame:
    """The fields of a struct as columns; a column of the same name is replaced."""
    own = unused("made", df)
    wide = df.withColumn(own, made)
    gone = {n.lower() for n in names}
    rest = [F.col(f"`{c}`") for c in df.columns if c.lower() not in gone] if keep else []
    return wide.select(*rest, *(F.col(own)[n].alias(n) for n in names))


def steps(texts: pa.Array, most: int = STEP_CHARS) -> Iterator[list[str | None]]:
    """The texts of a batch in runs of bounded size; one text is never cut."""
    run: list[str | None] = []
    chars = 0
    for value in texts:
        text = value.as_py()
        run.append(text)
        chars += len(text or "") + 16
        if chars >= most:
            yield run
            run, chars = [], 0
    if run:
        yield run


def release() -> None:
    """Give freed memory back to the machine: Python workers live on after a task."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def _runs(batch: pa.RecordBatch, most: int) -> Iterator[tuple[pa.RecordBatch, list | pa.ListArray]]:
    """A batch in steps: the other columns, and the values of the last one (texts, or lists as an array)."""
    column, at = batch.column(batch.num_columns - 1), 0
    if pa.types.is_list(column.type):
        sizes = np.cumsum(np.asarray(pc.fill_null(pc.list_value_length(column), 0)).astype(np.int64) + 16)
        while at < len(column):
            upto = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + most, "right")))
            yield batch.slice(at, upto - at), column.slice(at, upto - at)
            at = upto
        return
    for values in steps(column, most):
        yield batch.slice(at, len(values)), values
        at += len(values)


def map_steps(
    df: DataFrame, keep: list[str], column: Column, work: Callable[[list | pa.ListArray], list[pa.Array]], made: str,
    most: int = STEP_CHARS, after: Callable[[], None] = release,
) -> DataFrame:
    """The kept columns, and those that `work` makes of the values of `column` (texts, or an array of lists).

    Each step of bounded size leaves the task as a batch of its own, so that what a task
    holds of its results doesn't grow with the batches that come in. `after` runs at a task's end.
    """
    schema = StructType([*(df.schema[c] for c in keep), *StructType.fromDDL(made).fields])
    names = [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, values in _runs(batch, most):
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *work(values)], names)
        after()

    return df.select(*(F.col(f"`{c}`") for c in keep), column.alias(unused("value", df))).mapInArrow(run, schema)


def flat_steps(
    df: DataFrame, keep: list[str], column: Column, work: Callable[[list], tuple[np.ndarray, list[pa.Array]]], made: str,
    most: int = STEP_CHARS,
) -> DataFrame:
    """Any number of rows for each value of `column`: `work` gives these numbers and all rows' new columns."""
    schema = StructType([*(df.schema[c] for c in keep), *StructType.fromDDL(made).fields])
    names = [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, values in _runs(batch, most):
                counts, new = work(values)
                rows = pa.array(np.repeat(np.arange(len(counts)), counts))
                yield pa.RecordBatch.from_arrays([*(c.take(rows) for c in part.columns[:-1]), *new], names)
        release()

    return df.select(*(F.col(f"`{c}`") for c in keep), column.alias(unused("value", df))).mapInArrow(run, schema)


def without(df: DataFrame, *gone: str) -> list[str]:
    """The columns other than those, whatever the case."""
    return [c for c in df.columns if c.lower() not in {g.lower() for g in gone}]


class Known:
    """Lists of ids of strings, each made once while it is remembered.

    `make` gives all ids of some strings in a row, and the number of each one's. Above
    `most` strings, or sixteen times as many characters, all but the most used go.
    """

    def __init__(self, make: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], most: int):
        self.make, self.most = make, most
        self.index: dict[str, int] = {}
        self.chars = 0
        self.ids = np.zeros(0, np.int32)
        self.counts = self.starts = self.uses = np.zeros(0, np.int64)

    def _forget(self) -> None:
        words = list(self.index)
        best = np.sort(np.argsort(-self.uses, kind="stable")[:self.most // 2])
        best = best[self.uses[best] > 1]
        while self.most < sum(len(words[i]) for i in best) / 8:
            best = best[:len(best) // 2]
        counts = self.counts[best]
        self.ids = self.ids[np.repeat(self.starts[best] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())]
        self.index = {words[i]: n for n, i in enumerate(best)}
        self.chars = sum(map(len, self.index))
        self.counts, self.starts, self.uses = counts, np.cumsum(counts) - counts, self.uses[best] // 2

    def lookup(self, strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and the number of each string's."""
        if len(self.index) > self.most or self.chars > 16 * self.most:
            self._forget()
        at = np.fromiter(map(self.index.get, strings, repeat(-1)), np.int64, len(strings))
        if len(missing := np.flatnonzero(at < 0)):
            new = list({strings[i] for i in missing})
            ids, counts = self.make(new)
            self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(counts) - counts])
            self.counts = np.concatenate([self.counts, counts])
            self.uses = np.concatenate([self.uses, np.zeros(len(new), np.int64)])
            self.ids = np.concatenate([self.ids, ids.astype(np.int32)])
            self.index.update(zip(new, range(len(self.index), len(self.index) + len(new)), strict=True))
            self.chars += sum(map(len, new))
            at[missing] = [self.index[strings[i]] for i in missing]
        self.uses += np.bincount(at, minlength=len(self.uses))
        counts = self.counts[at]
        ends = np.cumsum(counts)
        ids = self.ids[np.repeat(self.starts[at] - ends + counts, counts) + np.arange(counts.sum())]
        return ids, counts


def lists(flat: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """Lists of so many of the values each."""
    ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, kind))


def rows_of(rows: pa.ListArray) -> list[list]:
    """The lists of an array; null ones are empty."""
    flat = rows.flatten().to_pylist() if rows.type.value_type != pa.int32() else np.asarray(rows.flatten()).tolist()
    ends = np.cumsum(np.asarray(pc.fill_null(pc.list_value_length(rows), 0))).tolist()
    return [flat[a:b] for a, b in zip([0, *ends], ends)]


def table_of(df: DataFrame, cells: int, dtype: str = "int64", piece: int = 1 << 14) -> np.ndarray:
    """Sum partial tables of a fixed number of cells.

    `df` has rows (piece int, cells binary), as `pieces_of` makes them; each piece is
    summed by its own task, and the driver receives `cells` numbers whatever the input.
    """

    def add(key, rows):
        total = np.zeros(piece, dtype=dtype)
        for row in rows["cells"]:
            total += np.frombuffer(row, dtype=dtype)
        import pandas as pd

        return pd.DataFrame({"piece": [key[0]], "cells": [total.tobytes()]})

    out = np.zeros(cells, dtype=dtype)
    for row in df.groupBy("piece").applyInPandas(add, "piece int, cells binary").collect():
        out[row["piece"] * piece:(row["piece"] + 1) * piece] = np.frombuffer(row["cells"], dtype=dtype)
    return out


def pieces_of(table: np.ndarray, piece: int = 1 << 14) -> pa.RecordBatch:
    """The pieces of a partial table that hold anything."""
    at = [i for i in range(len(table) // piece) if table[i * piece:(i + 1) * piece].any()]
    return pa.RecordBatch.from_pydict({
        "piece": pa.array(at, pa.int32()),
        "cells": pa.array([table[i * piece:(i + 1) * piece].tobytes() for i in at], pa.binary()),
    })


def mixed(values: np.ndarray) -> np.ndarray:
    """Spread 64-bit numbers (the finalizer of splitmix64)."""
    v = values.astype(np.uint64, copy=True)
    v ^= v >> np.uint64(30)
    v *= np.uint64(0xBF58476D1CE4E5B9)
    v ^= v >> np.uint64(27)
    v *= np.uint64(0x94D049BB133111EB)
    v ^= v >> np.uint64(31)
    return v


def fresh_id() -> str:
    return base64.b32encode(uuid.uuid4().bytes).decode().rstrip("=").lower()


def small(df: DataFrame, rows: int) -> DataFrame:
    """Marked for broadcast if it is counted to have at most so many rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


#: A key with more than 1 / HOT of all rows is hot, so there are fewer than HOT of them.
HOT = 1000


def join_counted(rows: DataFrame, groups: DataFrame, on: str, total: int, n: str = "n") -> DataFrame:
    """Inner join of rows with one row per key, where column `n` counts the key's rows.

    The hot keys, fewer than HOT, are broadcast, so that no task gets all rows of one;
    the rest is joined by shuffle. `rows` and `groups` are read twice: pass stored tables.
    """
    hot = groups.where(F.col(n) * HOT > total)
    rest = groups.where(F.col(n) * HOT <= total)
    few = rows.join(F.broadcast(hot), on)
    many = rows.join(F.broadcast(hot.select(on)), on, "left_anti").join(rest, on)
    return few.unionByName(many)


def row_keys(text: str = "text") -> list[Column]:
    """What tells rows apart: doc_id and a hash of the text. Rows that agree in both are alike."""
    return [F.col("doc_id"), F.xxhash64(text).alias("hash")]


def rank(*after: str) -> Column:
    """The order of occurrences: by doc_id, null ones last, then by the hash of the text."""
    return F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "hash", *after)


def with_lists(docs: DataFrame, lists: DataFrame, name: str, text: str = "text") -> DataFrame:
    """row (struct of the document's columns), text and its list, null if it has none.

    `lists` has doc_id, hash and `name`; documents find theirs by doc_id and hash.
    """
    other = lists.select(F.col("doc_id").alias("id"), F.col("hash").alias("h"), name)
    own = docs.select(
        F.struct("*").alias("row"), F.col("doc_id").alias("own_id"), F.xxhash64(text).alias("own_hash"),
        F.col(text).alias("text"),
    )
    same = F.col("own_id").eqNullSafe(F.col("id")) & (F.col("own_hash") == F.col("h"))
    return own.join(other, same, "left").select("row", "text", name)


def with_text(rows: DataFrame, docs: DataFrame, text: str, new: Column, *more: Column) -> DataFrame:
    """The documents' columns from `row`, with their text replaced."""
    return rows.select(*(
        new.alias(c) if c == text else F.col("row")[c].alias(c) for c in docs.columns
    ), *more)
