"""The prefix trie against a plain program, on hot, long and odd conversations."""

import hashlib
import random
import re
import zlib

import pytest

from compare import check, duck
from linkspan.llm import trie
from linkspan.llm.queries import CHECKS, QUERIES

COLUMNS = "conv_id long, turn int, role string, text string, node binary, path string"


def brute(rows, rebuild=True):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts, key=lambda t: (*t[:2], hashlib.md5(f"{len(t[2])}:{t[2]}{t[3]}".encode()).digest()))]
           for c, ts in own.items()}
    made = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4 if rebuild else 0
        base = c - (abs(c) % 20) * (1 if c > 0 else -1)
        made[c] = tuple(own.get(base, [])[:h] + turns[h:])
    members = {}
    for c, turns in made.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
    out = []
    children, leaves, saved = {}, {}, {}
    for path in sorted(members, key=len, reverse=True):
        kids = children.get(path, 0)
        leaves[path] = leaves.get(path, 0) + (kids == 0)
        words = len(re.findall(r"[^\x20\x09-\x0D]+", path[-1][1])) if path else 0
        saved[path] = saved.get(path, 0) + (len(members[path]) - 1) * words
        if path:
            children[path[:-1]] = children.get(path[:-1], 0) + 1
            leaves[path[:-1]] = leaves.get(path[:-1], 0) + leaves[path]
            saved[path[:-1]] = saved.get(path[:-1], 0) + saved[path]
        ends = ",".join(map(str, sorted(c for c in members[path] if len(made[c]) == len(path))))
        out.append((
            min(members[path]), len(path), min(members[path[:-1]]) if path else None, len(members[path]), kids,
            leaves[path], saved[path], hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return sorted(out, key=str)


def hot(seed=5):
    """A third are copies, many share beginnings, some are long, and there are odd ones."""
    rng = random.Random(seed)
    rows = []
    for c in [*range(-30, 170), 2**53 + 1, 2**53 + 3]:
        if c % 3 == 0:
            turns = [("user", "same words"), ("assistant", "again the same"), ("user", "end")]
        else:
            turns = [(rng.choice(["user", None]), rng.choice(["a b", "a  b", "c", None, ""])) for _ in range(rng.randint(1, 6))]
        if c in (20, 21, 22, 41):
            turns = [("user", "same words")] + [("user", f"long {i // (1 + c % 2)}") for i in range(150 + c % 3)]
        rows += [(c, i if i else None, *t) for i, t in enumerate(turns)]
    rows += [(None, 1, "user", "nobody"), (5, 0, "user", "twice"), (5, 0, "user", "twice")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("turns,broadcast", [(100_000, 200_000), (40, 200_000), (40, 0)])
def test_against_brute_force(spark, turns, broadcast):
    rows = hot()
    df = spark.createDataFrame([(*r, b"x", "y") for r in rows], COLUMNS)
    got = trie.nodes(trie.rebuilt(df), turns=turns, broadcast_rows=broadcast).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_as_they_are_and_no_rows(spark):
    rows = hot(6)
    df = spark.createDataFrame([(*r, b"x", "y") for r in rows], COLUMNS)
    assert sorted(map(tuple, trie.nodes(trie.of_rows(df)).collect()), key=str) == brute(rows, rebuild=False)
    assert trie.nodes(trie.rebuilt(df.where("false"))).count() == 0
    assert trie.nodes(trie.rebuilt(df.where("conv_id is null"))).count() == 0


def test_sql(spark):
    sf_dir = "/root/testdata/sf0.001"
    error, rows = check(spark, duck(sf_dir), QUERIES["op12_prefix_trie"], CHECKS["op12_prefix_trie"], sf_dir)
    assert error is None and rows
