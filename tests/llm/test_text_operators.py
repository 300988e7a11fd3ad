"""The other text operators: brute force, round trips, odd rows, and the queries' SQL."""

import hashlib
import io
import os
import random
import re
import zlib
from collections import Counter

import public_tokenizers
import pytest
import tiktoken

from compare import check, duck
from linkspan.llm import bpe, chat, decontam, langid, line_dedup, pii, quality, substring_dedup, warc
from linkspan.llm.queries import CHECKS, QUERIES, VOCABULARY
from linkspan.sources.scratch import settle

SF = "/root/testdata/sf0.001"
ODD = [
    (None, None), (1, ""), (2, None), (3, "word"), (3, "word"), (None, "a b c d e f\na b c d e f"),
    (4, "a b c d e f\na b c d e f"), (5, "\n\n \t"), (6, "x" * 50_000), (7, "é😀   ñ" * 2000),
]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, and columns called like the operators' own."""
    rows = [(i, t, 0.5, "q", 1, [1]) for i, t in ODD]
    return spark.createDataFrame(
        rows, "doc_id long, text string, score double, row string, hash int, ids array<int>"
    )


def texts(spark, sf_dir=SF):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_sql(spark, name):
    error, rows = check(spark, duck(SF), QUERIES[name], CHECKS[name], SF)
    assert error is None and rows


def test_language(spark, odd):
    rows = QUERIES["op1_language_id"](spark, SF).collect()
    known = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1
    held = [r["lang_pred"] == known[r["doc_id"]] for r in rows if r["held_out"]]
    assert sum(held) >= 0.95 * len(held)
    model = langid.learn(spark.read.parquet(f"{SF}/documents.parquet"))
    got = langid.identify(odd, model).collect()
    assert len(got) == len(ODD)
    assert all(r["lang_pred"] == "und" and r["score"] == 0 for r in got if not any(c.isalpha() for c in r["text"] or ""))
    assert langid.identify(odd.where("false"), model).count() == 0
    nobody = langid.learn(odd.selectExpr("text", "cast(null as string) as lang"))
    assert {r["lang_pred"] for r in langid.identify(odd, nobody).collect()} == {"und"}


def test_phrases_against_search():
    rng = random.Random(3)
    sample, text = ("".join(rng.choice("abc ") for _ in range(n)) for n in (300, 200))
    table = langid.letter_classes([sample])
    learnt, _ = langid.classes_of([sample], table)
    flat, _ = langid.classes_of([text], table)
    got = langid.phrases(langid.automaton(learnt), flat[:, None].astype("int32"))[0]
    whole, count, at = bytes(learnt), 0, 0
    while at < len(flat):
        end = at + 1
        while end < len(flat) and bytes(flat[at:end + 1]) in whole:
            end += 1
        count, at = count + 1, end
    assert got == count


def test_quality_counts(spark, odd):
    def brute(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
        hit = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in (i, i + 1, i + 2)}
        lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit)

    source = dict(list(texts(spark).items())[:60])
    for text in [*source.values(), *(t for _, t in ODD), "a b c a b c a b c d", "# a\n# a\n|"]:
        assert quality.statistics(text)[:5] == brute(text), text[:50]
    rows = QUERIES["op4_quality_rules"](spark, SF).collect()
    assert all(r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]) for r in rows)
    assert not any(r["kept"] and r["base_failed"] for r in rows)
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    good = [r["kept"] for r in rows if labels.get(r["doc_id"]) == 1 and not r["base_failed"]]
    assert sum(good) >= 0.97 * len(good)
    stats = quality.measure(odd.select("doc_id", "text")).drop("text")
    empty = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.judge(stats, quality.fit(stats, empty)).count() == len(ODD)
    none = stats.where("false")
    assert quality.judge(none, quality.fit(none, empty)).count() == 0
    assert quality.passing(odd, stats, empty).columns == odd.columns


def test_bpe(spark, odd):
    ranks = bpe.read_ranks(public_tokenizers.path(VOCABULARY))
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    vocabulary = bpe.Vocabulary(spark, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)
    rng = random.Random(1)
    rows = [(i, t) for i, t in enumerate(
        [*texts(spark).values(), *("".join(rng.choice("aàe '\n\t  1é中'sll-_.😀A") for _ in range(40)) for _ in range(500))]
    )]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = bpe.decode(bpe.encode(docs, vocabulary, offsets=True), vocabulary).collect()
    tokens = {r: t for t, r in ranks.items()}
    for row, (_, text) in zip(sorted(got, key=lambda r: r["doc_id"]), rows, strict=True):
        assert row["ids"] == known.encode_ordinary(text) and bytes(row["decoded"]).decode() == text
        for i, start, end in list(zip(row["ids"], row["starts"], row["ends"]))[:200]:
            assert tokens[i] in text[start:end].encode()
        assert "".join(bpe.decoded_parts([tokens[i] for i in row["ids"]])) == text
    made = bpe.decode(bpe.encode(odd, vocabulary), vocabulary)
    assert sorted(bytes(r["decoded"]) for r in made.collect()) == sorted((t or "").encode() for _, t in ODD)
    assert bpe.encode(odd.where("false"), vocabulary).count() == 0


def base_brute(text):
    found = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        found.append((m.start(), 0, m.end(), "email"))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            found.append((m.start(), 1, m.end(), "ip"))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in reversed(m[0]) if c.isdigit()]
        if 14 <= len(d) <= 19 and sum(sum(divmod(x * (1 + i % 2), 10)) for i, x in enumerate(d)) % 10 == 0:
            found.append((m.start(), 2, m.end(), "card"))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
            found.append((m.start(), 3, m.end(), "phone"))
    return ",".join(f"{k}:{a}:{e}" for a, _, e, k in sorted(found))


def test_sanitisation(spark, odd):
    rng = random.Random(2)
    parts = ["a@b.c", "x.y@d-e.co.uk", "@", "1.2.3.4", "256.1.1.1", ".", "4111 1111 1111 1111", "0" * 15, "7", "-", " ",
             "+1 (555) 123-4567", "+", "é", "_", "001.002.003.004", "😀"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(12))) for i in range(400)]
    secret = [(1000 + i, f"call {a} Zorblax {b} bob@x.org {c} now") for i, (a, b, c) in enumerate(zip("abcdef", "ghijkl", "mnopqr"))]
    plain = [(2000 + i, f"now call {c} and call again") for i, c in enumerate("abcdefghijklmnopqrstuvwxyz" * 8)]
    docs = spark.createDataFrame(rows + secret + plain, "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.findings(docs).select(
        "row.doc_id", pii.listed("base").alias("base"), pii.listed("all").alias("all")).collect()}
    for doc, text in rows + secret:
        assert got[doc]["base"] == base_brute(text), text
    for doc, text in secret:
        assert f"term:{text.index('Zorblax')}:{text.index('Zorblax') + 7}" in got[doc]["all"]
    assert all(got[doc]["all"] == "" for doc, _ in plain)
    clean = pii.sanitise(docs).where("doc_id = 1000").first()
    assert clean["text"] == "call a [term] g [email] m now"
    made = pii.sanitise(odd)
    assert made.count() == len(ODD) and made.columns[:len(odd.columns)] == odd.columns
    assert pii.sanitise(odd.where("false")).count() == 0


def test_decontamination_odd_rows(spark, odd):
    items = spark.createDataFrame([(1, "word"), (2, None), (None, "a b"), (3, "a b c d e f"), (4, "")], "item_id long, text string")
    found = decontam.contamination(odd, items)
    rows = decontam.marked(odd, found).select("row.doc_id", "row.text", "n_words", "n_hit", "items", "contaminated").collect()
    assert len(rows) == len(ODD)
    by = {(r["doc_id"], r["text"]): r for r in rows}
    assert by[3, "word"]["items"] == ["1"] and by[4, ODD[6][1]]["n_hit"] == 12 == by[None, ODD[6][1]]["n_hit"]
    assert not by[None, None]["contaminated"]
    assert decontam.clean(odd, items).columns == odd.columns
    assert decontam.clean(odd, items.where("false")).count() == len(ODD)
    assert decontam.clean(odd.where("false"), items).count() == 0
    # the way beyond the broadcast bound gives the same
    more = decontam.marked(odd, decontam.contamination(odd, items, broadcast_rows=0)).select("n_hit").collect()
    assert sorted(r["n_hit"] for r in more) == sorted(r["n_hit"] for r in rows)


def test_line_operators_odd_rows(spark, odd):
    made = line_dedup.dedup(odd)
    assert made.count() == len(ODD) and made.columns[:len(odd.columns)] == odd.columns
    assert line_dedup.dedup(odd.where("false")).count() == 0
    gone = substring_dedup.repeated(odd, kind="line", least_words=5)
    rows = substring_dedup.dedup(odd, gone).collect()
    by = {(r["doc_id"], i): r for i, r in enumerate(rows)}
    assert len(by) == len(ODD)
    kept = {r["doc_id"]: r["text"] for r in rows if r["text"] and r["text"].startswith("a b")}
    assert kept == {4: "a b c d e f\n"}
    assert [r["text"] for r in rows if r["doc_id"] is None and r["text"] is not None] == [""]
    assert substring_dedup.repeated(odd.where("false")).count() == 0


@pytest.mark.parametrize("kind", sorted(substring_dedup.UNITS))
def test_units_are_the_text(kind):
    rng = random.Random(3)
    for _ in range(300):
        text = "".join(rng.choice(["a", "b c", ".", "?!", "\n", "\n\n", " \n \n", " "]) for _ in range(rng.randint(0, 30)))
        assert "".join(m[0] for m in substring_dedup.UNITS[kind].finditer(text)) == text
        assert all(text[a:b].split() for a, b, _, _ in substring_dedup.units(text, kind))


@pytest.mark.parametrize("broadcast_rows", [1_000_000, 0])
def test_spans_against_brute_force(spark, broadcast_rows):
    rng = random.Random(4)
    passage = " ".join(f"p{i}{'.' if i % 9 == 0 else ''}" for i in range(60))
    own = lambda: " ".join(rng.choice("abcdefgh") + str(rng.randint(0, 99)) for _ in range(30)) + ". "
    docs = [(i, own() + (f"Head {i} " + passage + f" tail {i}. " if i % 3 else "Yes. ") + own()) for i in range(40)]
    docs += [(2**53 + 1, docs[1][1]), (2**53 + 3, docs[1][1]), (None, docs[2][1]), (50, docs[4][1]), (50, docs[4][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    found = settle(substring_dedup.repeated(df))
    seen, gone = {}, {}
    distinct = sorted(set(docs), key=lambda d: (d[0] is None, d[0] or 0))
    count = Counter(u[3] for d in distinct for u in substring_dedup.units(d[1]))
    for doc_id, text in distinct:
        run = []
        for unit in [*substring_dedup.units(text), None]:
            if unit is not None and count[unit[3]] > 1:
                run.append(unit)
                continue
            if sum(u[2] for u in run) >= substring_dedup.LEAST_WORDS:
                gone.setdefault((doc_id, text), []).extend(u for u in run if u[3] in seen)
            run = []
            # a unit of the same document counts as earlier too
        for u in substring_dedup.units(text):
            seen.setdefault(u[3], doc_id)
    want = sorted((str(d), a, b) for (d, _), us in gone.items() for a, b, _, _ in us)
    got = sorted((str(r["doc_id"]), r["start"], r["end"]) for r in found.collect() if not r["stays"])
    assert got == want and len(want) > 50
    for r in substring_dedup.dedup(df, found, broadcast_rows=broadcast_rows).collect():
        cuts = sorted((a, b) for a, b, _, _ in gone.get((r["doc_id"], dict(docs)[r["doc_id"]]), []))
        text, at, parts = dict(docs)[r["doc_id"]], 0, []
        for a, b in cuts:
            parts.append(text[at:a])
            at = b
        assert r["text"] == "".join(parts) + text[at:]
    whole = substring_dedup.spans(found).collect()
    assert {r["n_words"] for r in whole} and all(r["gone_words"] <= r["n_words"] for r in whole)
    assert all(r["end"] - r["start"] >= 25 for r in whole)


def test_members_in_any_ranges():
    inner = warc.record("response", 1, "u", b"inner", hashlib.sha1(b"inner").hexdigest(), None, "other@0")
    bodies = [os.urandom(3000), inner * 3, b"", warc.MAGIC * 50, b"plain " * 400]
    data, starts = b"", []
    for i, body in enumerate(bodies):
        starts.append(len(data))
        data += warc.record("response", i, f"http://x/{i}", body, hashlib.sha1(body).hexdigest(), None, f"f@{len(data)}")
    for step in (7, 100, 1000, len(data)):
        found = []
        for start in range(0, len(data), step):
            found += warc.members(io.BytesIO(data), len(data), start, start + step, "f")
        assert [at for at, _ in found] == starts
        assert [warc.parsed(x)["payload"] for _, x in found] == bodies


def test_warc_odd_pages(spark, tmp_path):
    big = "p" * 2000
    rows = [(1, "u", None), (2, None, big), (3, "u", big), (3, "u", big), (None, "u", big), (None, "v", "x"), (5, "w", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    files = warc.write(warc.plan(pages), str(tmp_path / "a"))
    got = warc.read_archives(spark, str(tmp_path / "a"), files, range_bytes=100).collect()
    assert sorted(str((r["page_id"], r["record_type"], r["refers_to"])) for r in got) == sorted(map(str, [
        (1, "response", None), (2, "revisit", 3), (3, "response", None), (3, "response", None), (None, "revisit", 3),
        (None, "response", None), (5, "response", None),
    ]))
    none = warc.write(warc.plan(pages.where("false")), str(tmp_path / "b"))
    assert warc.read_archives(spark, str(tmp_path / "b"), none).count() == 0


def test_chats(spark):
    rng = random.Random(4)
    bits = ["</s>", "[INST]", "<|end|>\n", "<|turn|>", "\\", "\n", "word ", "é", "<", "|", "<<SYS>>", "n"]
    rows = []
    for conv in range(30):
        for turn in range(rng.randrange(1, 40)):
            role = "system" if turn == 0 and conv % 2 else rng.choice(["user", "assistant", "to\nol", None])
            rows.append((conv, turn, role, None if rng.random() < 0.05 else "".join(rng.choice(bits) for _ in range(rng.randrange(400)))))
    rows += [(None, None, "user", "q"), (None, 1, "assistant", "a"), (None, 1, "assistant", "a")]
    turns = chat.numbered(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    shown = chat.windows(turns, budget=512, history_tokens=128).cache()
    got = {r["conv_id"]: r for r in chat.read_back(shown).collect()}
    expected = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: (str(r[0]), -1 if r[1] is None else r[1])):
        expected.setdefault(conv, []).append((role or "", text or ""))
    assert got.keys() == expected.keys()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for conv, own in expected.items():
        loss = "".join(t for r, t in own if r == "assistant")
        row = got[conv]
        assert row["n_turns"] == len(own) and row["turns_sha256"] == sha("".join(f"{r}\n{t}\n" for r, t in own))
        assert row["loss_chars"] == len(loss) and row["loss_sha256"] == sha(loss)
    many = [r for r in shown.collect() if len(chat.parse(r["formatted"])) - r["repeated"] > 1]
    assert many and all(len(r["formatted"].encode()) / 4 <= 512 * 1.6 for r in many)
    assert chat.read_back(chat.windows(turns.where("false"))).count() == 0


def test_pipeline(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    left, seen = docs, []
    for name, stage in corpus_pipeline.STAGES:
        left = corpus_pipeline.settle(stage(spark, left, SF), name)
        seen.append((name, left.count()))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert left.columns == docs.columns
    counts = [n for _, n in seen]
    assert counts[0] < docs.count() and sorted(counts, reverse=True) == counts and counts[-1] > 0.5 * docs.count()
    assert counts[-1] == counts[-2]
    known = tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, special_tokens={},
        mergeable_ranks=bpe.read_ranks(public_tokenizers.path(VOCABULARY)),
    )
    for row in left.limit(20).collect():
        assert hashlib.sha256(known.decode_bytes(row["ids"])).hexdigest() == row["decoded_sha256"]


def test_copies_leave_no_fragment(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(9)
    line = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(8))
    own = ["\n".join(line() for _ in range(rng.randrange(2, 14))) for _ in range(60)]
    own += ["\n" + own[0] + "x\n\n", line() + "\n" + line() + "\n", line()]
    rows = [(i, t, len(t)) for i, t in enumerate([*own, *own])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    left = {r["doc_id"]: r["text"] for r in corpus_pipeline.line_chunks(spark, docs, SF).collect()}
    # a text of one line is no run of lines: its copy stays whole, for the Jaccard join
    assert {i for i in left if i >= len(own)} == {len(rows) - 1} and left[len(rows) - 1] == own[-1]
    assert {i: left[i] for i in range(60)} == dict(enumerate(own[:60]))


def test_repeated_runs_of_lines_go(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(10)
    pool = ["".join(rng.choice("abc ") for _ in range(20)) + str(i) for i in range(30)] + ["", "  "]
    texts = ["\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 16))) for _ in range(120)]
    for i in range(60, 120):  # a run of an earlier text, in the middle of another
        own, other = texts[i].split("\n"), texts[i - 60].split("\n")
        at = rng.randrange(len(other))
        texts[i] = "\n".join(own[:3] + other[at:at + rng.randrange(2, 6)] + own[3:])
    kept = line_brute(list(enumerate(texts)))
    expected = {i: (left, len(left)) for (i, text), left in kept.items() if left.split() or left == text}
    docs = spark.createDataFrame(
        [(i, t, len(t)) for i, t in enumerate(texts)], "doc_id long, text string, n_chars long"
    ).repartition(5)
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in corpus_pipeline.line_chunks(spark, docs, SF).collect()}
    assert got == expected
    assert {x for t in texts for x in t.split("\n") if x.strip()} <= {x for t, _ in got.values() for x in t.split("\n")}


def test_windows_keep_a_budget_of_tokens(spark, monkeypatch):
    known = tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, special_tokens={},
        mergeable_ranks=bpe.read_ranks(public_tokenizers.path(VOCABULARY)),
    )
    size = lambda text: len(known.encode_ordinary(text))
    made, windows = [], chat.windows
    monkeypatch.setattr(chat, "windows", lambda turns: made.append((turns, windows(turns))) or made[0][1])
    rng = random.Random(6)
    bits = ["word ", "918273645", "中文字", "é😀", "</s>", "[INST]", "<|end|>\n", "\\", "\n", "x = {y[0]};\n", " ", "  \n"]
    rows = [
        (conv, turn, "system" if turn == 0 else rng.choice(["user", "assistant", "to\nol<|"]),
         "".join(rng.choice(bits) for _ in range(rng.randrange(150))) or None)
        for conv in range(12) for turn in range(60)
    ]
    docs = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    monkeypatch.setattr("linkspan.llm.queries.read", lambda *_: docs)
    assert QUERIES["op10_chat_windows"](spark, SF).count() == 13
    turns, shown = made[0]
    for r in turns.collect():
        assert r["tokens"] == size(chat.render([(True, r["role"], r["text"])])[0])
    several = 0
    for r in shown.collect():
        own = chat.parse(r["formatted"])
        assert size(r["formatted"]) == sum(size(chat.render([(True, *t)])[0]) for t in own)
        several += len(own) - r["repeated"] > 1
        assert size(r["formatted"]) <= 2048
        past = own[:r["repeated"]]
        past = past[1:] if past and past[0][0] == "system" else past
        assert sum(size(chat.render([(True, *t)])[0]) for t in past) <= 512
    assert several
    none = chat.numbered(docs.where("false"), chat.counted_tokens(
        bpe.Vocabulary(spark, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)))
    assert chat.read_back(windows(none)).count() == 0


def line_brute(docs):
    """Plain chunks of the distinct rows: what each keeps."""
    def cut(lines):
        worded = [i for i, x in enumerate(lines) if x.split()]
        own = [int(hashlib.md5(lines[i].encode()).hexdigest()[:8], 16) for i in worded]
        rolled = [(31 * (own[k - 1] if k else 0) + own[k]) % 2**32 for k in range(len(own))]
        found = set()
        for factor in line_dedup.FACTORS:
            v = [r * factor % 2**32 for r in rolled]
            begin = 0
            for k in range(len(own)):
                inner = 1 <= k <= len(own) - 3 and v[k] < v[k - 1] and v[k] <= v[k + 1]
                if inner or k == len(own) - 1:
                    if k > begin:
                        found.add((worded[begin], worded[k] + 1))
                    begin = k + 1
        return sorted(found)

    first, out = {}, {}
    order = sorted(set(docs), key=lambda d: (d[0] is None, d[0] or 0, d[1] or ""))
    all_chunks = []
    for n, (doc_id, text) in enumerate(order):
        lines = (text or "").split("\n")
        for a, b in cut(lines):
            body = "\n".join(lines[a:b])
            first.setdefault(body, (n, a))
            all_chunks.append((n, a, b, body))
    for n, (doc_id, text) in enumerate(order):
        lines = (text or "").split("\n")
        gone = {i for m, a, b, body in all_chunks if m == n and first[body] != (n, a) for i in range(a, b)}
        out[doc_id, text] = None if text is None else "\n".join(x for i, x in enumerate(lines) if i not in gone)
    return out


@pytest.mark.parametrize("broadcast_rows", [1_000_000, 0])
def test_line_chunks_against_brute_force(spark, broadcast_rows):
    rng = random.Random(11)
    pool = [f"line {i} of words" for i in range(40)] + ["", " ", "x"]
    docs = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 30)))) for i in range(80)]
    run = "\n".join(f"shared {i}" for i in range(12))
    docs += [(100 + i, f"own {i}\n{run}\nend {i}") for i in range(20)]
    docs += [(2**53 + 1, docs[3][1]), (2**53 + 3, docs[3][1]), (7, docs[7][1]), (200, None), (None, "one\ntwo"), (201, "a\r\nb")]
    df = spark.createDataFrame([(i, t, 5, b"z") for i, t in docs], "doc_id long, text string, lines int, body binary")
    got = line_dedup.dedup(df, broadcast_rows=broadcast_rows)
    assert got.columns == ["doc_id", "text", "body", "lines", "kept_lines", "removed_chunks"]
    want = line_brute(docs)
    rows = got.collect()
    assert len(rows) == len(docs)
    by = Counter((r["doc_id"], r["text"]) for r in rows)
    assert by == Counter((i, want[i, t]) for i, t in docs)
    # Of an exact copy nothing with a word is left.
    assert all(not (r["text"] or "").split() for r in rows if r["doc_id"] in (2**53 + 1, 2**53 + 3))
