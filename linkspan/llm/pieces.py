"""SentencePiece BPE: texts to piece ids, and back.

The pieces and their scores come from a public model file, and the library's normaliser
writes the text in the model's way (spaces as U+2581). Pieces are then found without the
merges: an Aho-Corasick automaton gives the longest piece at every place, and tokens are
laid one after the other, longest first. A token may follow another only if the two,
merged anew from their characters, come out as just these two; if all neighbours do, the
whole is what merging the text would give. Where nothing fits, the last token is taken
back and a bit marks the place as failed, so that no place is tried twice and the work
grows with the text's length only. Pieces that merging never makes are left out.

No piece of the usual models goes on over a word's end with a further space, so no merge
does: texts are then cut before each run of spaces, and around each character that only
stands alone, and each distinct word is encoded once while it is remembered. Models with such pieces are encoded in whole texts. Characters without a
piece stand alone and become the ids of their UTF-8 bytes, or the unknown id if the
model has no bytes. Models with symbols defined by the user are not supported.

Defined results: a null text counts as empty; empty text has the end id only. Null ids
decode to empty text. Input columns called like an output column are replaced, all other
columns stay. Rows are handled one by one: ties, repeated rows and empty tables need no
rule. The model's size is fixed, so the broadcast is too.
"""

from __future__ import annotations

import re
from collections import Counter
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkspan.llm.common import Known, fresh_id, lists, map_steps, rows_of, without

SPACE = "▁"
REMEMBERED = 500_000
PAIRS = 50_000
#: Bits of the number of pairs that words side by side remember.
SLOTS = 19
#: Words that are worked on side by side, and the characters from which one is alone.
AT_ONCE, ALONE = 4_000, 200


def merge(symbols: list[str], scores: dict[str, float]) -> list[str]:
    """Neighbours merged while they make a piece: the best score first, then the leftmost."""
    symbols = list(symbols)
    while True:
        made = [(-scores[a + b], i) for i, (a, b) in enumerate(zip(symbols, symbols[1:])) if a + b in scores]
        if not made:
            return symbols
        at = min(made)[1]
        symbols[at:at + 2] = [symbols[at] + symbols[at + 1]]


def last_merge(piece: str, scores: dict[str, float]) -> tuple[str, str]:
    """The two parts that a piece's characters merge to before the last merge."""
    symbols = list(piece)
    while len(symbols) > 2:
        made = [(-scores[a + b], i) for i, (a, b) in enumerate(zip(symbols, symbols[1:])) if a + b in scores]
        at = min(made)[1]
        symbols[at:at + 2] = [symbols[at] + symbols[at + 1]]
    return symbols[0], symbols[1]


def scores_of(model: bytes) -> tuple[dict[str, float], dict[str, int]]:
    """Scores and ids of the pieces that text can have."""
    own = sentencepiece.SentencePieceProcessor(model_proto=model)
    plain = [
        i for i in range(own.get_piece_size())
        if not (own.is_control(i) or own.is_byte(i) or own.is_unknown(i) or own.is_unused(i))
    ]
    if len(plain) < own.get_piece_size() and any(own.is_unused(i) for i in range(own.get_piece_size())):
        raise ValueError("models with unused pieces are not supported")
    return {own.id_to_piece(i): own.get_score(i) for i in plain}, {own.id_to_piece(i): i for i in plain}


def reachable(scores: dict[str, float]) -> list[str]:
    """The pieces that their own characters merge to."""
    return [p for p in scores if len(p) == 1 or merge(list(p), scores) == [p]]


class Encoder:
    """Pieces and ids of texts."""

    def __init__(self, model: bytes, usable: list[str]):
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.scores, self.numbers = scores_of(model)
        self.names, self.usable = usable, set(usable)
        self.found = ahocorasick.Automaton()
        for n, piece in enumerate(usable):
            self.found.add_word(piece, n)
        self.found.make_automaton()
        #: The two that a piece is last merged from; `tied`: pieces with a merge whose score another has too.
        self.parts = {p: last_merge(p, self.scores) for p in usable if len(p) > 1}
        often = Counter(self.scores.values())
        self.tied: set[str] = set()
        for p in sorted(self.parts, key=len):
            if often[self.scores[p]] > 1 or not self.tied.isdisjoint(self.parts[p]):
                self.tied.add(p)
        #: The next shorter piece that a piece begins with; at the end a single character.
        self.shorter = {
            p: next(p[:n] for n in range(len(p) - 1, 0, -1) if n == 1 or p[:n] in self.usable) for p in usable if len(p) > 1
        }
        self.bytes = [self.library.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        if any(not self.library.is_byte(i) for i in self.bytes):
            self.bytes = []
        characters = {c for p in usable for c in p}
        #: Whether no piece has a space after another character, and every character of pieces is a piece.
        self.by_words = characters <= self.usable and not any(SPACE in p.lstrip(SPACE) for p in self.scores)
        joined = "".join(re.escape(c) for c in sorted({c for p in usable if len(p) > 1 for c in p} - {SPACE})) or SPACE
        self.words = re.compile(f"{SPACE}*[{joined}]+|{SPACE}+|.", re.DOTALL).findall
        #: The same as arrays, by number: for words worked on side by side.
        number = {p: n for n, p in enumerate(usable)}
        self.length = np.array([len(p) for p in usable])
        self.next = np.array([number.get(self.shorter.get(p, ""), -1) for p in usable], np.int32)
        self.ids = np.array([self.numbers[p] for p in usable], np.int32)
        self.apart = next(c for c in map(chr, range(0x110000)) if c not in characters)
        self.slots, self.verdicts = np.full(1 << SLOTS, -1, np.int64), np.zeros(1 << SLOTS, bool)
        self.fits: dict[tuple[str, str], bool] = {}
        self.known = Known(self._learn, REMEMBERED)

    def _fits(self, left: str, right: str) -> bool:
        """Whether the two, merged anew, come out as just these two.

        The merges that made the two are taken apart again, the last one first: another
        merge over the border must not come before it.
        """
        if left in self.tied or right in self.tied:
            return merge(list(left + right), self.scores) == [left, right]
        return self._apart(left, right)

    def compatible(self, left: str, right: str) -> bool:
        """`_fits`, remembered."""
        if (fits := self.fits.get((left, right))) is None:
            if len(self.fits) >= PAIRS:
                self.fits.clear()
            fits = self.fits[left, right] = self._fits(left, right)
        return fits

    def _apart(self, left: str, right: str) -> bool:
        scores, parts = self.scores, self.parts
        bound = -np.inf  # the score of the merge that was undone last: only a better one over the border comes before it
        strict = True
        while True:
            score = scores.get(left + right)
            if score is not None and (score > bound or score == bound and not strict):
                return False
            one, two = parts.get(left), parts.get(right)
            if one is None and two is None:
                return True
            if two is None or one is not None and scores[left] < scores[right]:
                bound, left, strict = scores[left], one[1], True
            else:
                bound, right, strict = scores[right], two[0], False

    def pieces(self, text: str) -> list[str]:
        """The pieces of a normalised text, by backtracking."""
        if text in self.usable:
            return [text]
        matches, known, names, size = self.found.iter_long, self.fits.get, self.names, len(text)
        failed = bytearray(size // 8 + 1)  # a bit for each place
        some = False
        tokens: list[str] = []
        before, at = "", 0
        while at < size:
            # The longest pieces one after the other, while they fit.
            token = ""
            for last, number in matches(text, at):
                token = names[number]
                end = at + len(token)
                if last + 1 != end:
                    token, end = text[at], at + 1
                if before and not (fits := known((before, token))) and (
                    fits is not None or not self.compatible(before, token)
                ) or some and failed[end >> 3] >> (end & 7) & 1:
                    break
                tokens.append(token)
                before, at, token = token, end, ""
                if last >= end:  # a character without a piece was in between: look again from here
                    break
            else:
                if at < size:  # no further piece: single characters to the end
                    token = text[at]
            # A token that doesn't fit: shorter ones, then the one before it is taken back.
            while token:
                end = at + len(token)
                if not (some and failed[end >> 3] >> (end & 7) & 1):
                    fits = known((before, token)) if before else True
                    if fits or fits is None and self.compatible(before, token):
                        tokens.append(token)
                        before, at = token, end
                        break
                while len(token) == 1:
                    failed[at >> 3] |= 1 << (at & 7)
                    some = True
                    token = tokens.pop()
                    before = tokens[-1] if tokens else ""
                    at -= len(token)
                token = self.shorter[token]
        return tokens

    def _other(self, character: str) -> list[int]:
        """The ids of a character without a piece."""
        return [self.bytes[b] for b in character.encode()] if self.bytes else [self.library.unk_id()]

    def _learn(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        counts = np.zeros(len(words), np.int64)
        made: list[tuple[np.ndarray, np.ndarray]] = []  # of some words their ids, in a row
        single, together = [], []
        for n, word in enumerate(words):
            if word in self.usable:
                single.append(n)
            elif self.by_words and 1 < len(word) <= ALONE:
                together.append(n)
            else:
                ids = [self.numbers.get(p, p) for p in self.pieces(word)]
                ids = [i for p in ids for i in (self._other(p) if isinstance(p, str) else [p])]
                counts[n] = len(ids)
                made.append((np.array([n]), np.array(ids, np.int32)))
        counts[single] = 1
        made.append((np.array(single, np.int64), np.array([self.numbers[words[n]] for n in single], np.int32)))
        for first in range(0, len(together), AT_ONCE):
            some = np.array(together[first:first + AT_ONCE])
            ids, counts[some] = self._abreast([words[n] for n in some])
            made.append((some, ids))
        starts = np.cumsum(counts) - counts
        flat = np.zeros(counts.sum(), np.int32)
        for some, ids in made:
            each = counts[some]
            flat[np.repeat(starts[some] - np.cumsum(each) + each, each) + np.arange(len(ids))] = ids
        return flat, counts

    def _pairs_fit(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """`compatible` of pairs of token numbers, remembered in a table of fixed size."""
        pairs = left.astype(np.int64) * len(self.names) + right
        slots = ((pairs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOTS)).astype(np.int64)
        good = self.verdicts[slots]
        if len(new := np.flatnonzero(self.slots[slots] != pairs)):
            asked, back = np.unique(pairs[new], return_inverse=True)
            names = self.names
            found = np.array([self._fits(names[p // len(names)], names[p % len(names)]) for p in asked.tolist()])
            good[new] = found[back]
            self.slots[slots[new]], self.verdicts[slots[new]] = pairs[new], good[new]
        return good

    def _abreast(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """What `pieces` does, for many words at once: a step of each in turn. Ids and counts."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        begin = np.cumsum(sizes + 1) - sizes - 1
        end = begin + sizes
        text = self.apart.join(words)
        reach = int(self.length.max(initial=1))
        # The longest piece at a place: of those one after the other at once, elsewhere when it is asked for.
        longest = np.full(len(text) + 1, -1, np.int32)
        matches = np.fromiter(chain.from_iterable(self.found.iter_long(text)), np.int64).reshape(-1, 2)
        longest[matches[:, 0] + 1 - self.length[matches[:, 1]]] = matches[:, 1]
        laid, before = np.zeros(len(text) + 1, np.int32), np.full(len(text) + 1, -1)
        failed = np.zeros(len(text) + 2, bool)
        at, last, stop, token = begin.copy(), np.full(len(words), -1), end, longest[begin]
        while len(at):
            goal = at + self.length[token]
            good = ~failed[goal]
            ask = np.flatnonzero(good & (last >= 0))
            good[ask] = self._pairs_fit(laid[last[ask]], token[ask])
            on = np.flatnonzero(good)
            laid[at[on]], before[at[on]] = token[on], last[on]
            last[on] = at[on]
            at[on] = goal[on]
            inside = goal[on[goal[on] < stop[on]]]
            for place in inside[longest[inside] < 0].tolist():
                longest[place] = next(self.found.iter_long(text[place:place + reach]))[1]
            token[on] = longest[goal[on]]
            off = np.flatnonzero(~good)
            shorter = self.next[token[off]]
            back = off[shorter < 0]
            token[off] = shorter
            failed[at[back]] = True
            at[back] = last[back]
            token[back] = laid[at[back]]
            last[back] = before[at[back]]
            if (at[on] == stop[on]).any():
                going = at < stop
                at, last, stop, token = at[going], last[going], stop[going], token[going]
        chosen, at = np.zeros(len(text) + 1, bool), begin
        while len(at):
            chosen[at] = True
            after = at + self.length[laid[at]]
            going = after < end
            at, end = after[going], end[going]
        places = np.flatnonzero(chosen)
        counts = np.diff(np.searchsorted(places, np.append(begin, len(text) + 1)))
        return self.ids[laid[places]], counts

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, each text's with the end id, and the number of each text's."""
        words = [
            (self.words(t) if self.by_words else [t] if t else []) for t in self.library.normalize([t or "" for t in texts])
        ]
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ids, counts = self.known.lookup(list(chain.from_iterable(words)))
        upto = np.concatenate([[0], np.cumsum(counts)])[np.cumsum(sizes)]
        return np.insert(ids, upto, self.library.eos_id()), np.diff(upto, prepend=0) + 1


#: The encoder of this Python worker, by model.
_made: dict[str, Encoder] = {}


class Model:
    """A model file, read once and sent to the executors."""

    def __init__(self, spark: SparkSession, path: str):
        with open(path, "rb") as file:
            content = file.read()
        self.key = fresh_id()
        self.sent = spark.sparkContext.broadcast((content, reachable(scores_of(content)[0])))


def _encoder(sent, key: str) -> Encoder:
    if key not in _made:
        _made.clear()
        _made[key] = Encoder(*sent.value)
    return _made[key]


def encode(docs: DataFrame, model: Model, text: str = "text", decoded: bool = False, keep: list[str] | None = None) -> DataFrame:
    """The documents with `ids`; with `decoded` also the text that these decode to.

    `keep` names the columns that stay, all by default.
    """
    sent, key = model.sent, model.key
    names = ["ids", "decoded"] if decoded else ["ids"]

    def work(texts: list[str | None]) -> list[pa.Array]:
        encoder = _encoder(sent, key)
        ids, counts = encoder.encode(texts)
        made = [lists(ids, counts, pa.int32())]
        if decoded:
            made.append(pa.array(encoder.library.decode(rows_of(made[0])), pa.string()))
        return made

    stay = without(docs, *names) if keep is None else keep
    return map_steps(docs, stay, F.col(text), work, "ids array<int>" + (", decoded string" if decoded else ""))


def decode(tokens: DataFrame, model: Model, ids: str = "ids") -> DataFrame:
    """The rows with `decoded`, the text of their ids."""
    sent, key = model.sent, model.key

    def work(rows: pa.ListArray) -> list[pa.Array]:
        return [pa.array(_encoder(sent, key).library.decode(rows_of(rows)), pa.string())]

    return map_steps(tokens, without(tokens, "decoded"), F.col(ids), work, "decoded string")
