"""Quality rules: rule statistics of whole texts and an isolation forest over them.

`measure` counts the statistics. `fit` grows random trees on a bounded sample of the
rows (`sample_rows`, taken by a hash of the statistics, so no order matters): each tree
splits `tree_rows` of them at random until a row is alone. Rows that are alone after few
splits are anomalies. The score from which a document is rejected is calibrated on all
labelled rows: the one that gives the fewest wrong verdicts among those that reject at
most `good_lost` of the rows labelled as good. The histogram it is read from has a fixed number
of cells, whatever the number of labels.

Defined results: a null or empty text has no words, fails the base rules and is not
kept. Labels of null documents and null labels are not used; a document labelled twice
counts twice. Without labelled rows the threshold is `default_threshold`. An empty table
gives no rows; then, and if all rows are alike, nothing is an anomaly. Equal texts get
equal verdicts. Columns called like an output column are replaced, others stay.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkspan.llm.common import add_struct, steps, unused

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: What the forest looks at, in tenths up to 1, so that small differences between
#: ordinary texts don't count as rare: symbols and marks a word, capitals a letter.
SHARES = ["symbol_share", "mark_share", "upper_share"]
SYMBOLS = b"#*$%&|<>"
MARKS = b"!?;:=~^_\\/{}[]@+"
_NOT_SYMBOLS = bytes(set(range(256)) - set(SYMBOLS))
_NOT_MARKS = bytes(set(range(256)) - set(MARKS))
_NOT_UPPER = bytes(set(range(256)) - set(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
_NOT_LETTERS = bytes(set(range(128)) - set(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"))


def repeated_words(words: list[bytes]) -> int:
    """Words inside any 3-word window that occurs twice or more."""
    if len(words) < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], dtype=np.int64)
    pairs = ids[:-1] * len(number) + ids[1:]
    if len(number) > 1_000_000:  # keeps the product of the next line within 64 bits
        pairs = np.unique(pairs, return_inverse=True)[1]
    windows = pairs[:-1] * len(number) + ids[2:]
    order = np.argsort(windows, kind="stable")
    same = windows[order[1:]] == windows[order[:-1]]
    often = np.zeros(len(windows), dtype=bool)
    often[order[1:][same]] = True
    often[order[:-1][same]] = True
    hit = np.zeros(len(words), dtype=bool)
    for shift in range(3):
        hit[shift:shift + len(windows)] |= often
    return int(hit.sum())


def statistics(text: str | None) -> tuple:
    text = text or ""
    data = text.encode()
    words = data.split()
    lines = [line for line in data.split(b"\n") if line.strip()]
    symbols = len(data.translate(None, _NOT_SYMBOLS))
    repeats = repeated_words(words)
    again = len(lines) - len(set(lines))
    solid = len(text) - sum(map(text.count, " \t\n\x0b\x0c\r"))
    letters = len(data.translate(None, _NOT_LETTERS))
    marks = len(data.translate(None, _NOT_MARKS))
    capitals = len(data.translate(None, _NOT_UPPER))
    return (
        len(words), solid, symbols, again, repeats,
        tenths(symbols, len(words)), tenths(marks, len(words)), tenths(capitals, letters),
    )


def tenths(part: int, whole: int) -> float:
    return min(10 * part // max(whole, 1), 10) / 10


def measure(docs: DataFrame, text: str = "text", keep: bool = True) -> DataFrame:
    """The documents with the counts and the shares."""
    kinds = [*(pa.int64() for _ in COUNTS), *(pa.float64() for _ in SHARES)]
    names = [*COUNTS, *SHARES]
    schema = ", ".join([*(f"{c} long" for c in COUNTS), *(f"{c} double" for c in SHARES)])

    @F.arrow_udf(schema)
    def counted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            rows = [statistics(t) for run in steps(batch) for t in run]
            columns = zip(*rows, strict=True) if rows else [()] * len(names)
            yield pa.StructArray.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names
            )

    return add_struct(docs, counted(F.col(text)), names, keep)


def _usual_depth(rows: np.ndarray) -> np.ndarray:
    """Mean depth of an unsuccessful search in a binary tree of so many rows."""
    n = np.maximum(rows, 2).astype(float)
    depth = 2 * (np.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n
    return np.where(rows > 2, depth, np.where(rows == 2, 1.0, 0.0))


@dataclass
class Forest:
    """Trees as arrays; row i of `left`, `right`, `share`, `cut`, `depth` is tree i."""

    left: np.ndarray
    right: np.ndarray
    share: np.ndarray
    cut: np.ndarray
    depth: np.ndarray
    usual: float
    threshold: float = 1.0

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """From 0 to 1; high for rows that few splits set apart."""
        total = np.zeros(len(rows))
        every = np.arange(len(rows))
        for left, right, share, cut, depth in zip(
            self.left, self.right, self.share, self.cut, self.depth, strict=True
        ):
            at = np.zeros(len(rows), dtype=np.int64)
            while (inner := share[at] >= 0).any():
                under = rows[every, np.maximum(share[at], 0)] < cut[at]
                at = np.where(inner, np.where(under, left[at], right[at]), at)
            total += depth[at]
        return 2.0 ** (-total / len(self.left) / max(self.usual, 1e-9)) if len(self.left) else total


def grow(rows: np.ndarray, trees: int, tree_rows: int, seed: int) -> Forest:
    rng = np.random.default_rng(seed)
    tree_rows = min(tree_rows, len(rows))
    limit = int(np.ceil(np.log2(max(tree_rows, 2))))
    size = 2 ** (limit + 1)
    shape = (trees if len(rows) > 1 else 0, size)
    left, right = np.zeros(shape, np.int32), np.zeros(shape, np.int32)
    share, cut, depth = np.full(shape, -1, np.int32), np.zeros(shape), np.zeros(shape)
    for tree in range(shape[0]):
        todo = [(0, rows[rng.choice(len(rows), tree_rows, replace=False)], 0)]
        made = 1
        while todo:
            node, own, level = todo.pop()
            low, high = own.min(axis=0), own.max(axis=0)
            wide = np.flatnonzero(high > low)
            if level == limit or len(own) < 2 or not len(wide):
                depth[tree, node] = level + _usual_depth(np.array(len(own)))
                continue
            by = rng.choice(wide)
            at = rng.uniform(low[by], high[by])
            under = own[:, by] < at
            share[tree, node], cut[tree, node] = by, at
            left[tree, node], right[tree, node] = made, made + 1
            todo += [(made, own[under], level + 1), (made + 1, own[~under], level + 1)]
            made += 2
    return Forest(left, right, share, cut, depth, float(_usual_depth(np.array(tree_rows))))


def _scored(stats: DataFrame, forest: Forest, name: str) -> DataFrame:
    sent = stats.sparkSession.sparkContext.broadcast(forest)

    @F.arrow_udf("double")
    def score(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for columns in batches:
            rows = np.stack([c.to_numpy(zero_copy_only=False) for c in columns], axis=1)
            yield pa.array(sent.value.scores(rows), pa.float64())

    return stats.withColumn(name, score(*(F.col(c) for c in SHARES)))


CELLS = 2000


def fit(
    stats: DataFrame, labels: DataFrame, doc_id: str = "doc_id", sample_rows: int = 25_600,
    trees: int = 100, tree_rows: int = 256, good_lost: float = 0.005,
    default_threshold: float = 0.65, seed: int = 7,
) -> Forest:
    """A forest with its threshold. `stats` is read several times: pass a stored table.

    About `sample_rows` rows reach the driver; it is the bound of what the trees learn
    from. `labels` has doc_id and quality (1 good, 0 bad).
    """
    total = stats.count()
    parts = 1 << 30
    share = min(parts, sample_rows * parts // max(total, 1))
    chosen = F.pmod(F.xxhash64(doc_id, *COUNTS, *SHARES), F.lit(parts)) < share
    sample = stats.where(chosen).select(*SHARES).toPandas().to_numpy(dtype=float)
    sample = sample[np.lexsort(sample.T)] if len(sample) else sample.reshape(0, len(SHARES))
    forest = grow(sample, trees, tree_rows, seed)

    judged = labels.where("quality in (0, 1)").select(
        F.col("doc_id").alias("label_id"), F.col("quality").alias("label")
    )
    passing = stats.where(~base_failed()).select(F.col(doc_id).alias("own_id"), *SHARES)
    known = _scored(passing.join(judged, F.expr("own_id = label_id")), forest, "score")
    cells = known.groupBy(F.floor(F.col("score") * CELLS).cast("int").alias("cell"), "label").count()
    good, bad = np.zeros(CELLS + 1), np.zeros(CELLS + 1)
    for cell, label, n in cells.collect():
        (good if label == 1 else bad)[cell] += n
    if good.sum() + bad.sum() == 0:
        forest.threshold = default_threshold
        return forest
    lost = np.append(np.cumsum(good[::-1])[::-1], 0)    # good ones rejected from cell i on
    missed = np.concatenate([[0], np.cumsum(bad)])      # bad ones kept below cell i
    wrong = np.where(lost <= good_lost * good.sum(), lost + missed, np.inf)
    forest.threshold = float(np.flatnonzero(wrong == wrong.min())[-1]) / CELLS
    return forest


def base_failed():
    """Fewer than 50 words, or more than half of the words in repeated windows."""
    return F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words")


def judge(stats: DataFrame, forest: Forest) -> DataFrame:
    """The rows with base_failed, score and kept."""
    own = unused("own_score", stats)
    scored = _scored(stats.drop("base_failed", "score", "kept"), forest, own)
    return scored.withColumnRenamed(own, "score").withColumn("base_failed", base_failed()).withColumn(
        "kept", ~F.col("base_failed") & (F.col("score") < forest.threshold)
    )


def passing(docs: DataFrame, stats: DataFrame, labels: DataFrame, text: str = "text") -> DataFrame:
    """The documents that are kept, with their own columns. `stats`: stored, as from `measure`."""
    forest = fit(stats, labels)
    own = docs.select(F.struct("*").alias("row"), F.col(text).alias("text"))
    return judge(measure(own), forest).where("kept").select("row.*")
