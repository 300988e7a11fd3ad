"""Substring dedup by hashing units of text: sentences, lines or paragraphs.

A unit is a run of characters up to and with the marks that end it; all units in a row
are the text. It is normalised (A-Z lower-cased, runs of white space made one space) and
known by the MD5 of that. Digests are grouped globally; the earliest occurrence by doc_id
and place stays, the others go. A short unit says too little to be a copy by itself, so
neighbouring repeated units are joined to spans, and only those of spans with at least
`least_words` words count. What a passage shares of the sentences it begins and ends in
is beyond the method.

Places are kept as code points of the original text. Only digests and places are
shuffled, never texts; digests that hold a large share of all units are joined by
broadcast. The units of one document are put in order by one task.

Defined results: null and empty texts have no units, nor have units without a word
(they don't end a span either). Null doc_ids rank last and are told apart by text.
Repeated rows (same doc_id and text) count as one and are treated alike. Within a
document a later copy of a unit goes too. All other columns stay.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkspan.llm.common import flat_steps, join_counted, rank, row_keys, small, with_lists, with_text
from linkspan.sources.scratch import settle

#: Words of a span, half of what is called a passage here.
LEAST_WORDS = 25
UNITS = {
    "sentence": re.compile(r"[^.!?\n]+[.!?\n]*|[.!?\n]+"),
    "line": re.compile(r"[^\n]+\n*|\n+"),
    "paragraph": re.compile(r"(?s:.+?)(?:\n[ \t\r\x0b\x0c]*\n\s*|\Z)"),
}


def units(text: str, kind: str = "sentence") -> list[tuple[int, int, int, bytes]]:
    """(start, end, words, digest) of the units that have a word."""
    found = []
    for match in UNITS[kind].finditer(text):
        words = match[0].encode().lower().split()
        if words:
            found.append((*match.span(), len(words), hashlib.md5(b" ".join(words)).digest()))
    return found


def places(docs: DataFrame, text: str = "text", kind: str = "sentence") -> DataFrame:
    """doc_id, hash, unit (number from 0), start, end, words, digest."""

    def work(texts: list[str | None]) -> tuple[np.ndarray, list[pa.Array]]:
        found = [units(t or "", kind) for t in texts]
        counts = np.fromiter(map(len, found), np.int64, len(found))
        flat = [u for own in found for u in own]
        start, end, words, digest = zip(*flat, strict=True) if flat else ((), (), (), ())
        numbers = np.arange(len(flat)) - np.repeat(np.cumsum(counts) - counts, counts)
        return counts, [
            pa.array(numbers.astype(np.int32)), *(pa.array(x, pa.int32()) for x in (start, end, words)),
            pa.array(digest, pa.binary()),
        ]

    own = docs.select(*row_keys(text), F.col(text).alias("text"))
    return flat_steps(own, ["doc_id", "hash"], F.col("text"), work, "unit int, start int, end int, words int, digest binary")


def repeated(docs: DataFrame, text: str = "text", kind: str = "sentence", least_words: int = LEAST_WORDS) -> DataFrame:
    """The repeated units of spans with enough words.

    doc_id, hash, span (where it starts), unit, start, end, words, stays (it is the earliest),
    first_doc_id and first_start (of the earliest).
    """
    every = settle(places(docs, text, kind).dropDuplicates(["doc_id", "hash", "start"]), "units")
    groups = settle(
        every.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min(rank("start")).alias("first")).where("n > 1"),
        "groups",
    )
    joined = join_counted(every, groups, "digest", every.count())
    row = Window.partitionBy("doc_id", "hash")
    numbered = joined.withColumn("run", F.col("unit") - F.row_number().over(row.orderBy("unit")))
    whole = Window.partitionBy("doc_id", "hash", "run")
    spans = numbered.withColumn("span_words", F.sum("words").over(whole)).withColumn("span", F.min("start").over(whole))
    return spans.where(F.col("span_words") >= least_words).select(
        "doc_id", "hash", "span", "unit", "start", "end", "words", rank("start").eqNullSafe(F.col("first")).alias("stays"),
        F.col("first.doc_id").alias("first_doc_id"), F.col("first.start").alias("first_start"),
    )


def spans(found: DataFrame) -> DataFrame:
    """A row for each span: doc_id, hash, start, end, n_units, n_words, gone_units, gone_words, first_doc_id, first_start."""
    gone = ~F.col("stays")
    return found.groupBy("doc_id", "hash", "span").agg(
        F.max("end").alias("end"), F.count(F.lit(1)).alias("n_units"), F.sum("words").alias("n_words"),
        F.count_if(gone).alias("gone_units"), F.coalesce(F.sum(F.when(gone, F.col("words"))), F.lit(0)).alias("gone_words"),
        F.min_by(F.struct("first_doc_id", "first_start"), "unit").alias("first"),
    ).select(
        "doc_id", "hash", F.col("span").alias("start"), "end", "n_units", "n_words", "gone_units", "gone_words", "first.*",
    )


def dedup(docs: DataFrame, found: DataFrame, text: str = "text", broadcast_rows: int = 1_000_000) -> DataFrame:
    """The documents without the units that go; `removed` has their places: array of (start, end).

    `found`: stored, as from `repeated`.
    """
    gone = found.where(~F.col("stays"))
    lists = gone.groupBy("doc_id", "hash").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("cuts"))
    if small(gone, broadcast_rows) is not gone:
        lists = F.broadcast(lists)

    @F.arrow_udf("string")
    def without(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, cuts in batches:
            out = []
            for value, own in zip(texts, cuts, strict=True):
                whole, parts, at = value.as_py(), [], 0
                for span in own.as_py() or ():
                    parts.append(whole[at:span["start"]])
                    at = span["end"]
                out.append(whole if whole is None else "".join(parts) + whole[at:])
            yield pa.array(out, pa.string())

    found = with_lists(docs, lists, "cuts", text)
    return with_text(found, docs.drop("removed"), text, without("text", "cuts"), F.col("cuts").alias("removed"))
