"""Language by cross-parsing: the language whose text explains a document in fewest phrases.

For each language a bounded sample of labelled text (`docs_per_language` texts chosen by
a hash of the text, `chars_per_doc` of each, `sample_chars` in all) becomes a suffix
automaton. A document is cut greedily into phrases, each the longest match in the sample;
a phrase costs the logarithm of the sample's length. The lowest cost a letter wins. Phrases
do not run over the ends of blocks of `BLOCK` letters, so that many blocks, also those of
one long text, are followed side by side in numpy: one table look-up a letter and language.
Text is reduced to lower-case letters, with one separator for each run of all else.

The automata are tables of a fixed size: `table_cells` in all, whatever the number of
languages and the input; with many languages the samples get shorter.

Defined results: null text and text without a letter are `und` with score 0, as is
everything when there is no labelled text. Ties go to the first language by name. Equal
texts get equal results. Columns called like an output column are replaced, others stay.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkspan.llm.common import add_struct, steps

LETTERS = 61
#: Classes of code points: separator, the LETTERS commonest letters, other letters, end.
SEPARATOR, OTHER, END, CLASSES = 0, LETTERS + 1, LETTERS + 2, 64
BLOCK = 256


def letter_classes(texts: list[str]) -> np.ndarray:
    """The class of every code point, by the letters of the sample."""
    counts: Counter[str] = Counter()
    for text in texts:
        counts.update(text.lower())
    common = sorted((c for c in counts if c.isalpha() and len(c) == 1), key=lambda c: (-counts[c], c))[:LETTERS]
    number = {c: i + 1 for i, c in enumerate(common)}
    table = np.zeros(0x110000, np.uint8)
    for point in range(0x110000):
        if (c := chr(point)).isalpha():
            table[point] = number.get(c.lower(), OTHER)
    return table


def classes_of(texts: list[str], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Classes of all texts in a row, without repeated separators, and each text's number."""
    points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    cls = table[points]
    starts = np.cumsum([0, *map(len, texts)])
    keep = cls != SEPARATOR
    keep[1:] |= cls[:-1] != SEPARATOR
    upto = np.concatenate([[0], np.cumsum(keep)])
    return cls[keep], np.diff(upto[starts])


def automaton(text: np.ndarray) -> np.ndarray:
    """Moves of the suffix automaton of `text`, as cells of one table.

    Cell state * CLASSES + class holds 2 * CLASSES * next state, plus 1 if the phrase
    ended: then the next one begins with this letter.
    """
    moves = np.full((2 * len(text) + 2, CLASSES), -1, np.int32)
    link, length = [-1], [0]
    last, made = 0, 1
    for letter in text.tolist():
        new, made = made, made + 1
        link.append(0)
        length.append(length[last] + 1)
        at = last
        while at >= 0 and moves[at, letter] < 0:
            moves[at, letter] = new
            at = link[at]
        if at >= 0:
            goal = int(moves[at, letter])
            if length[at] + 1 == length[goal]:
                link[new] = goal
            else:
                twin, made = made, made + 1
                moves[twin] = moves[goal]
                link.append(link[goal])
                length.append(length[at] + 1)
                while at >= 0 and moves[at, letter] == goal:
                    moves[at, letter] = twin
                    at = link[at]
                link[goal] = link[new] = twin
        last = new
    moves = moves[:made]
    again = np.maximum(moves[0], 0) * (2 * CLASSES) + 1
    cells = np.where(moves >= 0, moves * (2 * CLASSES), again)
    cells[:, END] = np.arange(made) * (2 * CLASSES)
    return cells.astype(np.int32).ravel()


@dataclass
class Model:
    languages: list[str]
    classes: np.ndarray
    tables: list[np.ndarray]
    costs: list[float]


def model_of(samples: dict[str, list[str]], sample_chars: int = 32_768, table_cells: int = 1 << 25) -> Model:
    languages = sorted(samples)
    table = letter_classes([t for ts in samples.values() for t in ts])
    most = min(sample_chars, table_cells // (2 * CLASSES * max(len(languages), 1)))
    tables, costs = [], []
    for language in languages:
        text, _ = classes_of([" ".join(samples[language]) + " "], table)
        text = text[:most]
        tables.append(automaton(text))
        costs.append(float(np.log2(len(text) + 2)))
    return Model(languages, table, tables, costs)


def phrases(cells: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """Phrases of each block; `blocks` has a row a letter and a column a block."""
    at = np.zeros(blocks.shape[1], np.int32)
    ended = np.ones(blocks.shape[1], np.int32)
    for letters in blocks:
        got = cells[at + letters]
        ended += got & 1
        at = got >> 1
    return ended


def predict(model: Model, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    flat, sizes = classes_of([t or "" for t in texts], model.classes)
    count = -(-sizes // BLOCK)
    shift = np.cumsum(count * BLOCK) - count * BLOCK - (np.cumsum(sizes) - sizes)
    laid = np.full(int(count.sum()) * BLOCK, END, np.int32)
    laid[np.arange(len(flat)) + np.repeat(shift, sizes)] = flat
    blocks = np.ascontiguousarray(laid.reshape(-1, BLOCK).T)
    has_letter = np.zeros(len(texts), bool)
    owner = np.repeat(np.arange(len(texts)), sizes)
    has_letter[owner[flat != SEPARATOR]] = True
    if not model.languages:
        return ["und"] * len(texts), np.zeros(len(texts))
    of = np.repeat(np.arange(len(texts)), count)
    cost = np.stack([
        np.bincount(of, phrases(cells, blocks), len(texts)) * each
        for cells, each in zip(model.tables, model.costs, strict=True)
    ])
    best = cost.argmin(axis=0)
    ranked = np.sort(cost, axis=0)
    second = ranked[1] if len(ranked) > 1 else np.full(len(texts), np.inf)
    score = np.where(has_letter, 1 - ranked[0] / np.maximum(second, 1e-9), 0.0)
    names = [model.languages[b] if ok else "und" for b, ok in zip(best, has_letter, strict=True)]
    return names, score.clip(0, 1)


def learn(
    labelled: DataFrame, text: str = "text", lang: str = "lang", docs_per_language: int = 128,
    chars_per_doc: int = 512, sample_chars: int = 32_768, most_languages: int = 1_000,
) -> Model:
    """A model of labelled texts; null labels and texts are left out."""
    known = labelled.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(
        F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(text).alias("hash")
    )
    each = known.groupBy("lang", "hash").count().withColumn(
        "rank", F.row_number().over(Window.partitionBy("lang").orderBy("hash"))
    ).where(F.col("rank") <= docs_per_language).select("lang", "hash")
    chosen = [(r["lang"], r["hash"]) for r in each.take(docs_per_language * most_languages + 1)]
    if len({c[0] for c in chosen}) > most_languages:
        raise ValueError(f"more than {most_languages} languages")
    picked = labelled.sparkSession.createDataFrame(chosen, "lang string, hash long")
    start = F.substring("text", 1, chars_per_doc)
    rows = known.join(F.broadcast(picked), ["lang", "hash"]).groupBy("lang", "hash").agg(
        F.min(start).alias("text")
    ).collect()
    samples: dict[str, list[str]] = {}
    for row in sorted(rows, key=lambda r: (r["lang"], r["hash"])):
        samples.setdefault(row["lang"], []).append(row["text"])
    return model_of(samples, sample_chars)


def identify(docs: DataFrame, model: Model, text: str = "text", keep: bool = True) -> DataFrame:
    """The documents with lang_pred and score."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("lang_pred string, score double")
    def identified(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            names, scores = [], []
            for run in steps(batch):
                found, score = predict(sent.value, run)
                names += found
                scores.append(score)
            yield pa.StructArray.from_arrays(
                [pa.array(names, pa.string()), pa.array(np.concatenate(scores or [[]]), pa.float64())],
                ["lang_pred", "score"],
            )

    return add_struct(docs, identified(F.col(text)), ["lang_pred", "score"], keep)
