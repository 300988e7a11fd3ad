"""Byte-level BPE: texts to token ids with offsets, and back.

The ranks are those of a public vocabulary file in the tiktoken format. From them a
tokenizer of the `tokenizers` library is made once on the driver: each rank's token is a
merge of every pair of tokens that it can be put together from, in the order of the
ranks, and a piece that is a token as a whole becomes that token, as tiktoken does it.
The vocabulary's size is fixed, so the broadcast is too.

Texts leave in steps of bounded size, with their offsets or decoded bytes if asked for, so
that one Python worker a task holds one copy of the vocabulary. Decoding writes each id
as the vocabulary does, in the characters that stand for bytes, and reverses that table.

Defined results: a null text counts as empty; empty text has no tokens. Ids that are no
rank make decoding fail. Input columns called like an output column are replaced, all
other columns stay. Rows are handled one by one: ties, repeated rows and empty tables
need no rule.
"""

from __future__ import annotations

import base64
import codecs
from collections.abc import Iterator
from functools import partial
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models

from linkspan.llm.common import Known, fresh_id, lists, map_steps, release, steps, without


def byte_characters() -> list[str]:
    """The character that stands for each byte: itself where it is printable."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def tokenizer_json(ranks: dict[bytes, int]) -> str:
    """The merges as a tokenizer of words that are written with the bytes' characters."""
    shown = byte_characters()
    written = {token: "".join(shown[b] for b in token) for token in ranks}
    merges = [
        (written[token[:i]], written[token[i:]])
        for token, _ in sorted(ranks.items(), key=lambda x: x[1])
        for i in range(1, len(token))
        if token[:i] in ranks and token[i:] in ranks
    ]
    vocabulary = {written[token]: rank for token, rank in ranks.items()}
    return Tokenizer(models.BPE(vocabulary, merges, ignore_merges=True)).to_str()


class Encoder:
    """Ids of texts, and back. Each distinct piece goes through the tokenizer once while it is remembered."""

    REMEMBERED = 120_000

    def __init__(self, tokenizer: str, pattern: str):
        self.tokenizer = Tokenizer.from_str(tokenizer)
        self.tokenizer.encode_special_tokens = True
        self.split = regex.compile(pattern).findall
        self.shown = dict(enumerate(byte_characters()))
        back = {ord(c): b for b, c in self.shown.items()}
        written = map(self.tokenizer.id_to_token, range(self.tokenizer.get_vocab_size()))
        self.tokens = np.array([*(t.translate(back).encode("latin-1") for t in written), b""], dtype=object)[:-1]
        self.sizes = np.fromiter(map(len, self.tokens), np.int64, len(self.tokens))
        self.known = Known(self._learn, self.REMEMBERED)

    def _learn(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        words = [p.encode().decode("latin-1").translate(self.shown) for p in pieces]
        made = self.tokenizer.encode(words, is_pretokenized=True, add_special_tokens=False)
        counts = np.bincount(np.asarray(made.word_ids, dtype=np.int64), minlength=len(pieces))
        return np.asarray(made.ids, dtype=np.int32), counts

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and the number of each text's."""
        pieces = list(map(self.split, texts))
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ids, counts = self.known.lookup(list(chain.from_iterable(pieces)))
        upto = np.concatenate([[0], np.cumsum(counts)])[np.cumsum(sizes)]
        return ids, np.diff(upto, prepend=0)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """The bytes of each text."""
        if len(ids) and ids.min() < 0:
            raise ValueError("a negative id")
        tokens, ends = self.tokens[ids].tolist(), np.cumsum(counts).tolist()
        return [b"".join(tokens[a:b]) for a, b in zip([0, *ends], ends)]

    def offsets(self, text: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Code points from and to (exclusive) of each token.

        Tokens that hold parts of one character all point to that character.
        """
        data = np.frombuffer(text.encode(), np.uint8)
        character = np.cumsum((data & 0xC0) != 0x80) - 1
        ends = np.cumsum(self.sizes[ids])
        starts = ends - self.sizes[ids]
        return character[starts].astype(np.int32), (character[ends - 1] + 1).astype(np.int32)


#: Encoders of this Python worker, by vocabulary.
_made: dict[str, Encoder] = {}


def _forget() -> None:
    """At a task's end: the next one makes its encoder anew, and other work has the memory meanwhile."""
    _made.clear()
    release()


def _encoder(sent, pattern: str, key: str) -> Encoder:
    if key not in _made:
        _made.clear()
        _made[key] = Encoder(sent.value, pattern)
    return _made[key]


class Vocabulary:
    """The parsed ranks, sent once to the executors. `spark` serves to make the broadcast."""

    def __init__(self, spark: SparkSession, path: str, pattern: str):
        ranks = read_ranks(path)
        if sorted(ranks.values()) != list(range(len(ranks))):
            raise ValueError("ranks must be 0, 1, 2, ...")
        self.key, self.pattern = fresh_id(), pattern
        self.sent = spark.sparkContext.broadcast(tokenizer_json(ranks))

    def encoder(self):
        """For use in tasks: gives this worker's encoder."""
        return partial(_encoder, self.sent, self.pattern, self.key)

    def counting(self, text: Column) -> Column:
        """The number of the text's tokens."""
        encoder = self.encoder()

        @F.arrow_udf("long")
        def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for batch in batches:
                counts = [encoder().encode([t or "" for t in run])[1] for run in steps(batch)]
                yield pa.array(np.concatenate(counts) if counts else [], pa.int64())

        return count(text)


def encode(
    docs: DataFrame, vocabulary: Vocabulary, text: str = "text", offsets: bool = False, decoded: bool = False,
    keep: list[str] | None = None, forget: bool = False,
) -> DataFrame:
    """The documents with `ids`, with `starts` and `ends` if offsets are asked for, and `decoded`.

    `decoded` has the bytes that the ids stand for. `keep` names the columns that stay, all by default.
    With `forget` a worker drops the vocabulary at a task's end, for jobs that go on with other work.
    """
    encoder = vocabulary.encoder()
    names = ["ids", *(["starts", "ends"] if offsets else []), *(["decoded"] if decoded else [])]

    def work(values: list[str | None]) -> list[pa.Array]:
        own, texts = encoder(), [t or "" for t in values]
        ids, counts = own.encode(texts)
        made = [lists(ids, counts, pa.int32())]
        if offsets:
            spans = [own.offsets(t, i) for t, i in zip(texts, np.split(ids, np.cumsum(counts)[:-1]), strict=True)]
            made += [lists(np.concatenate(x), counts, pa.int32()) for x in zip(*spans, strict=True)]
        if decoded:
            made.append(pa.array(own.decode(ids, counts), pa.binary()))
        return made

    stay = without(docs, *names) if keep is None else keep
    kinds = {"decoded": "binary"}
    return map_steps(
        docs, stay, F.col(text), work, ", ".join(f"{n} {kinds.get(n, 'array<int>')}" for n in names),
        after=_forget if forget else release,
    )


def decode(tokens: DataFrame, vocabulary: Vocabulary, ids: str = "ids") -> DataFrame:
    """The rows with `decoded`, the bytes that their ids stand for. Null has none."""
    encoder = vocabulary.encoder()

    def work(rows: pa.ListArray) -> list[pa.Array]:
        counts = np.asarray(pc.fill_null(pc.list_value_length(rows), 0))
        return [pa.array(encoder().decode(np.asarray(rows.flatten()), counts), pa.binary())]

    return map_steps(tokens, without(tokens, "decoded"), F.col(ids), work, "decoded binary")


def decoded_parts(tokens: list[bytes]) -> Iterator[str]:
    """Text piece by piece as tokens come in; a character split over tokens comes with its last part."""
    whole = codecs.getincrementaldecoder("utf-8")("replace")
    for token in tokens:
        yield whole.decode(token)
    if rest := whole.decode(b"", True):
        yield rest
