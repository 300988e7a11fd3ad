"""Whitening directions of embeddings, by the bidiagonal qd algorithm.

Numbers are made whole first: x = floor(64 * c) + 1000000, so that sums and deviations are
exact. Each task reduces its rows, centred on the exact means, to a triangle by QR, block
by block; triangles are joined in rounds, `FAN` at a time, until one is left, which has as many
cells as dimensions squared, whatever the input. On the driver Householder reflections
make it bidiagonal. The qd transformation with Newton's shifts (dqds), which only adds,
multiplies and divides what is positive, finds the squares of its singular values; these
are the eigenvalues of the scatter matrix. Twisted factorisations of the bidiagonal's own
representation give each direction, from both ends towards the place where the remainder
is smallest; close ones are then made orthogonal. No covariance is formed on that way.

Defined results: rows whose vector is null, empty, or has null or non-finite entries are left
out, as are those with an entry of 2**46 or more, and those whose length differs from the
most frequent one (of several such, the longest). Components without variance (below
n * eps of the largest) are left out, so equal vectors, or a single one, give no row.
`deviation` is null where it passes the range of longs. Repeated rows and null ids are
rows of their own. No vectors give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkspan.sources.scratch import settle

SCALE, SHIFT = 64.0, 1_000_000
#: Numbers of a block, and triangles that are joined at a time.
BLOCK, FAN = 1 << 18, 16
EPS = np.finfo(float).eps
_TINY = 1e-290


# ---- the small dense problem ----------------------------------------------------------

def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """diagonal, superdiagonal and right factor W with r = U B W^T, by Householder reflections."""
    a = r.astype(float, copy=True)
    n = a.shape[1]
    right = np.eye(n)

    def reflector(x: np.ndarray) -> tuple[np.ndarray, float]:
        """Unit v, and what (I - 2 v v^T) x has in its first place."""
        size = np.linalg.norm(x)
        v = x.copy()
        if size == 0.0:
            return np.zeros_like(x), 0.0
        head = -size if x[0] >= 0 else size
        v[0] -= head
        return v / np.linalg.norm(v), head

    for k in range(n):
        v, a_kk = reflector(a[k:, k])
        a[k:, k + 1:] -= 2.0 * np.outer(v, v @ a[k:, k + 1:])
        a[k, k], a[k + 1:, k] = a_kk, 0.0
        if k < n - 2:
            v, head = reflector(a[k, k + 1:])
            a[k + 1:, k + 1:] -= 2.0 * np.outer(a[k + 1:, k + 1:] @ v, v)
            a[k, k + 1], a[k, k + 2:] = head, 0.0
            right[:, k + 1:] -= 2.0 * np.outer(right[:, k + 1:] @ v, v)
    return np.diag(a).copy(), np.diag(a, 1).copy(), right


def _dqds_step(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float], list[float]] | None:
    """One transformation of the qd array; None if the shift was above the smallest eigenvalue."""
    d = q[0] - shift
    new_q, new_e, left = [], [], [d]
    for i, e_i in enumerate(e):
        if d < 0:
            return None
        top = d + e_i
        ratio = q[i + 1] / top if top > 0 else 0.0
        new_q.append(top)
        new_e.append(e_i * ratio)
        d = d * ratio - shift if top > 0 else q[i + 1] - shift
        left.append(d)
    if d < 0:
        return None
    new_q.append(d)
    return new_q, new_e, left


def dqds(diagonal: np.ndarray, above: np.ndarray) -> np.ndarray:
    """The squares of the singular values of an unreduced bidiagonal matrix, falling.

    Each round first goes without a shift; the sum of the reciprocals of what is left over
    is the trace of the inverse, so its reciprocal is a shift that is never too large.
    """
    q, e = (diagonal * diagonal).tolist(), (above * above).tolist()
    if len(q) > 1 and q[0] < q[-1]:
        q.reverse()
        e.reverse()
    found, moved = [], 0.0
    small = (10 * EPS) ** 2
    while q:
        last = len(q) - 1
        if last == 0 or e[-1] <= small * (moved + q[-1]):
            found.append(moved + q.pop())
            if e:
                e.pop()
            continue
        q, e, left = _dqds_step(q, e, 0.0)
        if e[-1] <= small * (moved + q[-1]):
            continue
        if min(left) <= 0.0:
            continue
        shift = 1.0 / sum(1.0 / d for d in left) * (1 - 4 * EPS)
        while shift > EPS * (moved + min(left)) * 1e-3:
            made = _dqds_step(q, e, shift)
            if made is not None:
                q, e, _ = made
                moved += shift
                break
            shift *= 0.5
    return np.sort(np.array(found))[::-1]


def twisted(diagonal: np.ndarray, above: np.ndarray, value: float, avoid: list[int] = []) -> tuple[np.ndarray, float, int]:
    """Unit eigenvector of B^T B for about `value`, the correction of the value, and the twist's place."""
    n = len(diagonal)
    d = np.maximum(diagonal * diagonal, _TINY).tolist()
    low = [above[i] * diagonal[i] / d[i] if d[i] > _TINY else 0.0 for i in range(n - 1)]
    s, p = [0.0] * n, [0.0] * n
    down, up = [0.0] * max(n - 1, 0), [0.0] * max(n - 1, 0)
    s[0] = -value
    for i in range(n - 1):
        pivot = s[i] + d[i] or EPS * value or _TINY
        down[i] = d[i] * low[i] / pivot
        s[i + 1] = down[i] * low[i] * s[i] - value
    p[-1] = d[-1] - value
    for i in range(n - 2, -1, -1):
        pivot = d[i] * low[i] * low[i] + p[i + 1] or EPS * value or _TINY
        ratio = d[i] / pivot
        up[i] = low[i] * ratio
        p[i] = p[i + 1] * ratio - value
    gamma = np.array(s) + np.array(p) + value
    order = [int(i) for i in np.argsort(np.abs(gamma), kind="stable") if int(i) not in avoid]
    at = order[0] if order else int(np.argmin(np.abs(gamma)))
    z = np.zeros(n)
    z[at] = 1.0
    for i in range(at - 1, -1, -1):
        z[i] = -down[i] * z[i + 1]
    for i in range(at, n - 1):
        z[i + 1] = -up[i] * z[i]
    size = float(z @ z)
    return z / np.sqrt(size), float(gamma[at]) / size, at


def _iterated(diagonal: np.ndarray, above: np.ndarray, value: float, others: np.ndarray, z: np.ndarray) -> np.ndarray:
    """A direction for about `value` beside the others found for it, by inverse iteration."""
    b = np.diag(diagonal) + np.diag(above, 1)
    shifted = b.T @ b - value * (1 + 8 * EPS) * np.eye(len(z))
    for _ in range(4):
        z = z - others @ (others.T @ z)
        z = np.linalg.lstsq(shifted, z / np.linalg.norm(z), rcond=0.0)[0] if value else z
        z = z / np.linalg.norm(z)
    return z


def singular(diagonal: np.ndarray, above: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squares of the singular values, falling, and the right singular vectors as columns."""
    n = len(diagonal)
    norm = max(np.abs(diagonal).max(initial=0.0), np.abs(above).max(initial=0.0))
    values, vectors = np.zeros(n), np.zeros((n, n))
    cuts = [i + 1 for i in range(n - 1) if abs(above[i]) <= EPS * norm]
    at = 0
    for begin, end in zip([0, *cuts], [*cuts, n]):
        own = np.where(np.abs(diagonal[begin:end]) < EPS * EPS * norm, EPS * EPS * norm, diagonal[begin:end])
        over = above[begin:end - 1]
        found = dqds(own, over) if norm > 0 else np.zeros(end - begin)
        made = np.zeros((end - begin, end - begin))
        group, places = 0, []
        for k, value in enumerate(found):
            if k and found[k - 1] - value > 1e-3 * found[k - 1]:
                group, places = k, []
            z = None
            for _ in range(3 if norm > 0 else 0):
                z, change, place = twisted(own, over, value, places)
                if abs(change) > 0.25 * max(value, _TINY):
                    break
                value += change
                if abs(change) <= 4 * EPS * value:
                    break
            if z is None:
                z, place = np.eye(end - begin)[:, k], k
            for again in range(8):  # close directions are made orthogonal; where nothing is left, from another start
                for _ in range(2):
                    z = z - made[:, group:k] @ (made[:, group:k].T @ z)
                if np.linalg.norm(z) > 0.1:
                    break
                z = _iterated(own, over, value, made[:, group:k], np.cos((again + 1.0) * np.arange(end - begin) + k))
            made[:, k] = z / np.linalg.norm(z)
            places.append(place)
        values[at:at + len(found)] = found
        vectors[begin:end, at:at + len(found)] = made
        at += len(found)
    order = np.argsort(-values, kind="stable")
    return values[order], vectors[:, order]


def directions(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of r^T r, falling, and its unit eigenvectors as columns."""
    diagonal, above, right = bidiagonal(r)
    values, vectors = singular(diagonal, above)
    return values, right @ vectors


# ---- passes over the rows ---------------------------------------------------------------

@dataclass(frozen=True)
class Fit:
    """n vectors, the sums of their dimensions, and components: variances and unit columns."""

    n: int
    sums: np.ndarray
    variances: np.ndarray
    vectors: np.ndarray
    trace: float


def usable(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """vec_id and x of the rows that count, all of one length."""
    c = F.col(vector).cast("array<double>")
    good = F.forall(c, lambda v: F.coalesce(F.abs(v) < F.lit(float(1 << 46)), F.lit(False)) & ~F.isnan(v))
    made = rows.where(F.col(vector).isNotNull() & (F.size(vector) > 0)).where(good).select(
        "vec_id", F.transform(c, lambda v: F.floor(v * SCALE).cast("long") + SHIFT).alias("x")
    )
    made = settle(made, "vectors")
    sizes = made.groupBy(F.size("x").alias("size")).agg(F.count(F.lit(1)).alias("n"))
    best = sizes.orderBy(F.desc("n"), F.desc("size")).first()  # a number of lengths
    return made.where(F.size("x") == (best["size"] if best else 0))


def _blocks(batch: pa.RecordBatch, column: int) -> Iterator[np.ndarray]:
    """The rows' numbers, some at a time."""
    if batch.num_rows == 0:
        return
    flat = batch.column(column).flatten().to_numpy(zero_copy_only=False)
    wide = len(flat) // batch.num_rows
    step = max(BLOCK // wide, 1) * wide
    for at in range(0, len(flat), step):
        yield flat[at:at + step].reshape(-1, wide)


def _exact(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n * x - sums, as whole numbers."""
    if n * max(int(np.abs(x).max(initial=0)), 1) < 1 << 62:
        return n * x - sums.astype(np.int64)
    return n * x.astype(object) - sums


def _sums(vectors: DataFrame) -> tuple[int, np.ndarray]:
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, None
        for batch in batches:
            for x in _blocks(batch, 0):
                own = x.sum(axis=0).astype(object)
                n, total = n + len(x), own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_pydict({"at": pa.array([-1, *range(len(total))], pa.int32()), "total": [str(n), *map(str, total)]})

    made = vectors.select("x").mapInArrow(add, "at int, total string")
    rows = made.groupBy("at").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()
    found = {r["at"]: int(r["total"]) for r in rows}  # as many as dimensions
    return found.get(-1, 0), np.array([found[i] for i in range(len(found) - 1)], dtype=object)


def _triangle(vectors: DataFrame, n: int, sums: np.ndarray) -> np.ndarray:
    """R of the centred rows."""
    wide = len(sums)

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = None
        for batch in batches:
            for x in _blocks(batch, 0):
                centred = _exact(x, n, sums).astype(float) / n
                r = np.linalg.qr(centred if r is None else np.vstack([r, centred]), mode="r")
        if r is not None:
            yield pa.RecordBatch.from_pydict({"r": pa.array([r.tobytes()], pa.binary())})

    def join(key, group):
        import pandas as pd

        r = None
        for own in group["r"]:
            own = np.frombuffer(own).reshape(-1, wide)
            r = own if r is None else np.linalg.qr(np.vstack([r, own]), mode="r")
        return pd.DataFrame({"r": [r.tobytes()]})

    made = settle(vectors.select("x").mapInArrow(reduce, "r binary"), "triangles")
    left = made.count()
    while left > 1:
        parts = -(-left // FAN)
        made = made.withColumn("part", F.pmod(F.xxhash64("r"), F.lit(parts))).groupBy("part").applyInPandas(join, "r binary")
        made = settle(made, "triangles")
        left = made.count()
    r = np.frombuffer(made.first()["r"]).reshape(-1, wide)
    return np.vstack([r, np.zeros((max(wide - len(r), 0), wide))])


def fit(vectors: DataFrame, most: int = 32) -> Fit | None:
    """The first components of `usable` vectors, None if there are no rows."""
    n, sums = _sums(vectors)
    if n == 0:
        return None
    values, columns = directions(_triangle(vectors, n, sums))
    variances = values / n
    kept = int((variances[:most] > n * EPS * EPS * max(variances[0], _TINY)).sum()) if variances[0] > 0 else 0
    kept = int((variances[:kept] > EPS * 16 * variances[0]).sum())
    return Fit(n, sums, variances[:kept], columns[:, :kept], float(variances.sum()))


def _whitened(x: np.ndarray, model: Fit) -> tuple[np.ndarray, np.ndarray]:
    exact = _exact(x, model.n, model.sums)
    return exact, exact.astype(float) / model.n @ model.vectors / np.sqrt(model.variances)


def identity_error(vectors: DataFrame, model: Fit) -> float:
    """The largest entry of the whitened rows' covariance less the identity, in one pass over all rows."""
    wide = len(model.variances)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, products = np.zeros(wide), np.zeros((wide, wide))
        for batch in batches:
            for x in _blocks(batch, 0):
                _, z = _whitened(x, model)
                total += z.sum(axis=0)
                products += z.T @ z
        cells = np.concatenate([total, products.ravel()])
        yield pa.RecordBatch.from_pydict({"at": pa.array(range(len(cells)), pa.int32()), "value": cells})

    made = vectors.select("x").mapInArrow(add, "at int, value double")
    rows = made.groupBy("at").agg(F.sum("value").alias("value")).collect()  # components squared
    cells = np.zeros(wide + wide * wide)
    for row in rows:
        cells[row["at"]] = row["value"]
    mean = cells[:wide] / model.n
    covariance = cells[wide:].reshape(wide, wide) / model.n - np.outer(mean, mean)
    return float(np.abs(covariance - np.eye(wide)).max(initial=0.0))


def whitened(vectors: DataFrame, model: Fit | None, error: float = 0.0) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error for each row and component."""
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    names = [f.split()[0] for f in schema.split(", ")]
    if model is None or not len(model.variances):
        empty = [F.lit(None).cast(f.split()[1]).alias(f.split()[0]) for f in schema.split(", ")]
        return vectors.where("false").select(*empty)
    wide = len(model.variances)
    explained = model.variances / model.trace

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for x in _blocks(batch, 1):
                exact, z = _whitened(x, model)
                if exact.dtype != object and len(model.sums) * int(np.abs(exact).max()) ** 2 < 1 << 63:
                    deviation = pa.array((exact * exact).sum(axis=1))
                else:
                    whole = [sum(v * v for v in row) for row in exact.astype(object)]
                    deviation = pa.array([v if v < 1 << 63 else None for v in whole], pa.int64())
                each = pa.array(np.repeat(np.arange(len(x)), wide))
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(at, len(x)).take(each), pa.array(np.tile(np.arange(1, wide + 1, dtype=np.int32), len(x))),
                    pa.array(np.full(len(x) * wide, model.n)), deviation.take(each), pa.array(z.ravel()),
                    pa.array(np.tile(explained, len(x))), pa.array(np.full(len(x) * wide, error)),
                ], names)
                at += len(x)

    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "x").mapInArrow(project, schema)


def whiten(rows: DataFrame, vector: str = "embedding", most: int = 32) -> DataFrame:
    """All of it: the usable rows, their components, and each row along them."""
    vectors = usable(rows, vector)
    model = fit(vectors, most)
    return whitened(vectors, model, identity_error(vectors, model) if model and len(model.variances) else 0.0)
