"""SentencePiece encoding against the library, and its round trip."""

import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece

from linkspan.llm import pieces
from linkspan.llm.queries import PIECE_MODEL, QUERIES

SF = "/root/testdata/sf0.001"
PARTS = [
    "a", "e", " ", "  ", "\n", "\t", "th", "é", "中", "😀", "the", "ing", "▁", "<s>", "<0x0A>", "1", "12", "x", "'",
    "ö", "ﬁ", "A", "\x00", "http://", " " * 17, "....", "</", "ation",
]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(PIECE_MODEL))


@pytest.fixture(scope="module")
def encoder(library):
    content = library.serialized_model_proto()
    return pieces.Encoder(content, pieces.reachable(pieces.scores_of(content)[0]))


def test_random_strings(encoder, library):
    rng = random.Random(7)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 40))) for _ in range(5000)]
    ids, counts = encoder.encode(texts)
    at = 0
    for text, n in zip(texts, counts.tolist(), strict=True):
        assert ids[at:at + n].tolist() == library.encode(text, add_eos=True), text
        at += n


@pytest.mark.parametrize("text", ["x" * 30_000, "ab" * 9_000, " " * 5_000, "thing" * 3_000, "中é" * 500])
def test_long_words(encoder, library, text):
    assert encoder.encode([text])[0].tolist() == library.encode(text, add_eos=True)


def test_words_side_by_side_and_alone(encoder):
    rng = random.Random(8)
    letters = "aeithns▁.'"
    words = sorted({"".join(rng.choice(letters) for _ in range(rng.randint(2, 25))) for _ in range(2000)})
    ids, counts = encoder._abreast(words)
    alone = [[encoder.numbers[p] for p in encoder.pieces(w)] for w in words]
    assert [i for own in alone for i in own] == ids.tolist() and list(map(len, alone)) == counts.tolist()
    for word in words[:300]:
        assert encoder.pieces(word) == pieces.merge(list(word), encoder.scores)


def test_compatible_is_merging_anew(encoder):
    rng = random.Random(9)
    usable = sorted(encoder.usable)
    for _ in range(20_000):
        left, right = rng.choice(usable), rng.choice(usable)
        assert encoder.compatible(left, right) == (pieces.merge(list(left + right), encoder.scores) == [left, right])


def test_forgetting_changes_nothing(encoder, library):
    rng = random.Random(10)
    encoder.known.most, most = 50, encoder.known.most
    for _ in range(60):
        texts = [" ".join("".join(rng.choice("aethn") for _ in range(rng.randint(1, 5))) for _ in range(30))]
        assert encoder.encode(texts)[0].tolist() == library.encode(texts[0], add_eos=True)
    encoder.known.most = most


def test_query_and_odd_rows(spark, library):
    rows = QUERIES["op13_sentencepiece"](spark, SF).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(rows) == len(texts)
    for row in rows:
        ids = library.encode(texts[row["doc_id"]] or "", add_eos=True)
        assert row["n_tokens"] == len(ids)
        assert row["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()
    odd = [(None, None), (1, ""), (2, None), (3, "word"), (3, "word"), (4, "x" * 50_000), (5, "é😀   ñ" * 2000)]
    docs = spark.createDataFrame([(i, t, "q", 1) for i, t in odd], "doc_id long, text string, decoded string, IDS int")
    model = pieces.Model(spark, public_tokenizers.path(PIECE_MODEL))
    made = pieces.decode(pieces.encode(docs, model), model)
    assert made.columns == ["doc_id", "text", "ids", "decoded"]
    for row in made.collect():
        assert row["ids"] == library.encode(row["text"] or "", add_eos=True)
        assert row["decoded"] == (row["text"] or "")
    assert pieces.encode(docs.where("false"), model).count() == 0
    gone = spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")
    assert pieces.decode(gone, model).first()["decoded"] == ""
