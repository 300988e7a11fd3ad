"""Whitening against numpy's eigenvectors and exact sums."""

import math

import numpy as np
import pytest

from linkspan.llm import whitening
from linkspan.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
RNG = np.random.default_rng(4)


def _rotated(values):
    q, _ = np.linalg.qr(RNG.normal(size=(len(values), len(values))))
    return np.linalg.qr(np.diag(values) @ q, mode="r")


CASES = {
    "one": RNG.normal(size=(1, 1)), "two": np.triu(RNG.normal(size=(2, 2))), "many": np.triu(RNG.normal(size=(64, 64))),
    "equal": np.eye(20), "zero": np.zeros((5, 5)), "rank one": np.ones((6, 6)), "graded": np.diag(10.0 ** -np.arange(30)),
    "clusters": _rotated(np.r_[np.full(20, 3.0), np.full(10, 1.0), np.linspace(1, 2, 10)]),
    "close": _rotated(np.r_[3 + 1e-12 * RNG.normal(size=20), 1 + 1e-9 * RNG.normal(size=20)]),
    "gone": np.triu(RNG.normal(size=(12, 12))) * (np.arange(12) % 3 > 0),
}


@pytest.mark.parametrize("name", list(CASES))
def test_directions(name):
    a = CASES[name]
    values, vectors = whitening.directions(a)
    known = np.linalg.svd(a, compute_uv=False) ** 2
    top = max(known[0], 1e-300)
    assert np.abs(values - known).max() <= 1e-13 * top
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-11
    assert np.abs(a.T @ (a @ vectors) - vectors * values).max() <= 1e-12 * top


def test_dqds_is_accurate_for_small_values():
    diagonal, above = 10.0 ** -np.arange(12.0), 0.5 * 10.0 ** -np.arange(11.0) * 10.0 ** -np.arange(1, 12)
    values = whitening.dqds(diagonal, above)
    assert abs(np.prod(values / diagonal ** 2) - 1) < 1e-12
    assert np.allclose(np.sqrt(values), np.linalg.svd(np.diag(diagonal) + np.diag(above, 1), compute_uv=False), rtol=1e-5)


def checked(rows, vectors):
    """`rows` of the result against numpy, for (id, vector) that count."""
    x = np.array([[math.floor(64 * float(c)) + 1_000_000 for c in v] for _, v in vectors])
    n, sums = len(x), x.sum(axis=0)
    y = (n * x - sums) / n
    values, columns = np.linalg.eigh(y.T @ y / n)
    values, columns = values[::-1], columns[:, ::-1]
    got = {}
    for r in rows:
        got.setdefault((r["vec_id"], r["component"]), []).append(r)
    wide = max(r["component"] for r in rows)
    assert len(rows) == n * wide
    for k in range(wide):
        z = y @ columns[:, k] / np.sqrt(values[k])
        sign = 0
        for i, (id_, _) in enumerate(vectors):
            for r in got[id_, k + 1]:
                assert r["n"] == n and r["deviation"] == sum(int(v) ** 2 for v in n * x[i] - sums)
                assert abs(r["explained"] / (values[k] / values.sum()) - 1) < 1e-9 and r["identity_error"] < 1e-8
                if len(got[id_, k + 1]) == 1:
                    sign = sign or (1 if r["whitened"] * z[i] > 0 else -1)
                    assert abs(r["whitened"] - sign * z[i]) < 1e-7


def test_query(spark):
    rows = QUERIES["op11_whitening"](spark, SF).collect()
    vectors = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    checked(rows, vectors)


def test_odd_rows(spark):
    rng = np.random.default_rng(5)
    base = [(i, rng.normal(size=5).tolist(), "x") for i in range(40)]
    odd = [
        (100, None, "x"), (101, [], "x"), (102, [1.0, None, 1.0, 1.0, 1.0], "x"), (103, [float("nan")] * 5, "x"),
        (104, [float("inf")] * 5, "x"), (105, [1.0, 2.0], "x"), (106, [1e30] * 5, "x"),
    ]
    schema = "vec_id long, embedding array<double>, x string"
    df = spark.createDataFrame(base + [base[3], (None, [0.5] * 5, "x")] + odd, schema).repartition(5)
    rows = whitening.whiten(df).collect()
    checked(rows, [(i, v) for i, v, _ in base] + [(3, base[3][1]), (None, [0.5] * 5)])
    empty = whitening.whiten(df.where("false"))
    assert empty.count() == 0 and empty.columns[:3] == ["vec_id", "component", "n"]
    assert whitening.whiten(df.where("vec_id = 3")).count() == 0
    assert whitening.whiten(df.where("vec_id in (1, 2)")).count() == 2
    flat = spark.createDataFrame([(i, [float(i), 2.0, float(i)]) for i in range(9)], "vec_id long, embedding array<float>")
    assert {r["component"] for r in whitening.whiten(flat).collect()} == {1}


def test_triangles_are_joined_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(whitening, "FAN", 2)
    rng = np.random.default_rng(6)
    base = [(i, rng.normal(size=4).tolist()) for i in range(60)]
    df = spark.createDataFrame(base, "vec_id long, embedding array<double>").repartition(7)
    checked(whitening.whiten(df).collect(), base)
