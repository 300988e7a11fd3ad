"""Jaro-Winkler similarity as an Arrow-batched column function.

Spark has no Jaro-Winkler.  The kernel below works on a whole Arrow batch at
once: strings become rows of a code-point matrix, and one pass over the
character positions of the left side marks matches for all pairs of the batch
together.  Strings longer than a machine word of match bits take the exact
row-wise path, so nothing is cut off.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from linkspan.codes import JW_PREFIX_FROM, JW_PREFIX_LENGTH, JW_PREFIX_WEIGHT

_WORD = 63  # positions that fit the match bits of one row
_SLICE = 16_384  # pairs handled per matrix, bounds memory for long strings


def _as_text(values) -> pa.Array:
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    return pc.cast(values, pa.large_string())


def _code_points(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all strings in one row, their lengths); no nulls in `values`."""
    lengths = pc.utf8_length(values).to_numpy(zero_copy_only=False).astype(np.int64)
    _, offsets, data = values.buffers()
    ends = np.frombuffer(offsets, dtype=np.int64)[values.offset : values.offset + len(values) + 1]
    raw = memoryview(data)[ends[0] : ends[-1]]
    if lengths.sum() == len(raw):
        return np.frombuffer(raw, dtype=np.uint8), lengths
    wide = bytes(raw).decode("utf-8").encode("utf-32-le")
    return np.frombuffer(wide, dtype=np.uint32), lengths


def _matrix(codes: np.ndarray, lengths: np.ndarray, width: int) -> np.ndarray:
    matrix = np.zeros((len(lengths), width), dtype=codes.dtype)
    matrix[np.arange(width) < lengths[:, None]] = codes
    return matrix


def _matrices(left: pa.Array, right: pa.Array):
    """Both sides as equally wide matrices; 0 fills up short rows."""
    flat_a, la = _code_points(left)
    flat_b, lb = _code_points(right)
    if flat_a.dtype == flat_b.dtype == np.uint8:
        flat_a, flat_b = flat_a + np.uint8(1), flat_b + np.uint8(1)
    else:
        flat_a, flat_b = flat_a.astype(np.uint32) + 1, flat_b.astype(np.uint32) + 1
    width = -(-int(max(la.max(), lb.max())) // 8) * 8
    return _matrix(flat_a, la, width), la, _matrix(flat_b, lb, width), lb


def _bits(flags: np.ndarray) -> np.ndarray:
    """Pack a boolean matrix into one 64-bit word per row, bit j = column j."""
    rows, width = flags.shape
    packed = np.zeros((rows, 8), dtype=np.uint8)
    packed[:, : width // 8] = np.packbits(flags.ravel(), bitorder="little").reshape(rows, -1)
    return packed.view(np.uint64).ravel()


def _low_mask(count: np.ndarray) -> np.ndarray:
    """Word with the lowest `count` bits set (0 <= count <= 63)."""
    return (np.uint64(1) << count.astype(np.uint64)) - np.uint64(1)


def _unpack(words: np.ndarray, width: int) -> np.ndarray:
    as_bytes = np.ascontiguousarray(words).view(np.uint8).reshape(len(words), 8)
    return np.unpackbits(as_bytes, axis=1, bitorder="little")[:, :width].astype(bool)


def _batch(left: pa.Array, right: pa.Array) -> np.ndarray:
    a, la, b, lb = _matrices(left, right)
    reach = np.maximum(np.maximum(la, lb) // 2 - 1, 0)
    used_a = np.zeros(len(la), dtype=np.uint64)
    used_b = np.zeros(len(la), dtype=np.uint64)
    for i in range(int(la.max())):
        window = _low_mask(np.minimum(i + reach + 1, lb)) & ~_low_mask(
            np.minimum(np.maximum(i - reach, 0), _WORD)
        )
        free = _bits(b == a[:, i : i + 1]) & window & ~used_b
        free[i >= la] = 0
        first = free & (~free + np.uint64(1))
        used_b |= first
        used_a |= (first != 0).astype(np.uint64) << np.uint64(i)
    flags_a = _unpack(used_a, a.shape[1])
    flags_b = _unpack(used_b, b.shape[1])
    common = flags_a.sum(axis=1)
    owner = np.repeat(np.arange(len(la)), common)
    swapped = np.bincount(owner, weights=a[flags_a] != b[flags_b], minlength=len(la))
    halves = swapped.astype(np.int64) // 2
    with np.errstate(divide="ignore", invalid="ignore"):
        jaro = common / la + common / lb + (common - halves) / common
    jaro = np.where(common > 0, jaro / 3.0, 0.0)
    same = (a[:, :JW_PREFIX_LENGTH] == b[:, :JW_PREFIX_LENGTH]) & (a[:, :JW_PREFIX_LENGTH] > 0)
    prefix = np.cumprod(same, axis=1).sum(axis=1)
    boosted = jaro + prefix * JW_PREFIX_WEIGHT * (1.0 - jaro)
    return np.where(jaro > JW_PREFIX_FROM, boosted, jaro)


def jaro_winkler_text(a: str, b: str) -> float:
    """The same measure for one pair of any length."""
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    used = [False] * len(b)
    from_a = []
    for i, ch in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == ch:
                used[j] = True
                from_a.append(ch)
                break
    if not from_a:
        return 0.0
    from_b = [b[j] for j in range(len(b)) if used[j]]
    m = len(from_a)
    halves = sum(x != y for x, y in zip(from_a, from_b)) // 2
    jaro = (m / len(a) + m / len(b) + (m - halves) / m) / 3.0
    if jaro <= JW_PREFIX_FROM:
        return jaro
    prefix = 0
    for x, y in zip(a[:JW_PREFIX_LENGTH], b[:JW_PREFIX_LENGTH]):
        if x != y:
            break
        prefix += 1
    return jaro + prefix * JW_PREFIX_WEIGHT * (1.0 - jaro)


def jaro_winkler_arrow(left, right) -> np.ndarray:
    """Null-safe similarity of two equally long Arrow string arrays.

    Null or empty on either side gives 0.
    """
    left, right = _as_text(left), _as_text(right)
    out = np.zeros(len(left), dtype=np.float64)
    some = pc.fill_null(pc.and_(pc.not_equal(left, ""), pc.not_equal(right, "")), False)
    rows = np.flatnonzero(some.to_numpy(zero_copy_only=False))
    if not len(rows):
        return out
    # A batch repeats its values a lot: every distinct pair is compared once.
    a, b = (side.take(pa.array(rows)).dictionary_encode() for side in (left, right))
    wide = len(b.dictionary)
    joint = np.asarray(a.indices, dtype=np.int64) * wide + np.asarray(b.indices, dtype=np.int64)
    pairs, place = np.unique(joint, return_inverse=True)
    out[rows] = _distinct_pairs(
        a.dictionary.take(pa.array(pairs // wide)), b.dictionary.take(pa.array(pairs % wide))
    )[place]
    return out


def _distinct_pairs(left: pa.Array, right: pa.Array) -> np.ndarray:
    """Similarity of non-empty strings."""
    out = np.ones(len(left), dtype=np.float64)
    differ = pc.not_equal(left, right).to_numpy(zero_copy_only=False)
    longest = np.maximum(
        pc.utf8_length(left).to_numpy(zero_copy_only=False),
        pc.utf8_length(right).to_numpy(zero_copy_only=False),
    )
    short = np.flatnonzero(differ & (longest <= _WORD))
    for start in range(0, len(short), _SLICE):
        rows = short[start : start + _SLICE]
        pick = pa.array(rows)
        out[rows] = _batch(left.take(pick), right.take(pick))
    for row in np.flatnonzero(differ & (longest > _WORD)):
        out[row] = jaro_winkler_text(left[int(row)].as_py(), right[int(row)].as_py())
    return out


@F.arrow_udf(DoubleType())
def _jaro_winkler(left: pa.Array, right: pa.Array) -> pa.Array:
    return pa.array(jaro_winkler_arrow(left, right))


def jaro_winkler(left: Column | str, right: Column | str) -> Column:
    """Jaro-Winkler similarity of two columns; null or empty gives 0.

    Values are compared as text, so dates and numbers may be passed as they are.
    """
    as_col = lambda c: F.col(c) if isinstance(c, str) else c
    return _jaro_winkler(as_col(left).cast("string"), as_col(right).cast("string"))
