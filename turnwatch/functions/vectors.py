"""Vector columns: exact double-precision arithmetic on array columns, JVM-side."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-10


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column, eps: float = 0.0) -> Column:
    """Cosine of two arrays; zero vectors give 0. ``eps`` is added to the denominator
    where the calibration path asks for it."""
    size = norm(a) * norm(b) + F.lit(eps)
    return F.when(size > 0, dot(a, b) / size).otherwise(0.0)


def bind(value: Column, use) -> Column:
    """Evaluate ``value`` once and hand it to ``use``."""
    return F.transform(F.array(value), use)[0]


def unit(a: Column) -> Column:
    return bind(norm(a) + F.lit(EPS), lambda n: F.transform(a, lambda x: x.cast("double") / n))


def exact_unit(a: Column) -> Column:
    """Unit vector without a guard in the norm, as the in-task way computes it; zero vectors stay zero."""
    return bind(norm(a), lambda n: F.transform(a, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(0.0)))


def letter_histogram(text: Column) -> Column:
    """A small deterministic text embedding for tests and demos: counts of a..z."""
    letters = F.array(*[F.lit(chr(c)) for c in range(ord("a"), ord("z") + 1)])
    return bind(F.lower(text), lambda low: F.transform(letters, lambda c: (
        F.length(low) - F.length(F.replace(low, c, F.lit("")))).cast("float")))


_COUNTED = 1_000_000  # bytes of text whose letters are counted together


def _letter_counts(texts: pa.Array) -> pa.Array:
    """Counts of a..z of lower-case texts; a null text has 26 nulls."""
    texts = texts.cast(pa.large_string())
    ends = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8) if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    counts = np.zeros((len(texts), 26), np.float32)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + _COUNTED, "right")) - 1)
        letter = data[ends[lo]:ends[hi]] - np.uint8(97)
        cell = np.repeat(np.arange(hi - lo) * 26, np.diff(ends[lo:hi + 1]))
        known = letter < 26
        counts[lo:hi] = np.bincount(cell[known] + letter[known], minlength=(hi - lo) * 26).reshape(-1, 26)
        lo = hi
    gone = np.repeat(texts.is_null().to_numpy(zero_copy_only=False), 26)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * 26), pa.array(counts.ravel(), pa.float32(), mask=gone))


def letter_histograms(texts: Column) -> Column:
    """``letter_histogram`` of every text of an array, counted in one pass over the bytes."""
    @F.arrow_udf("array<array<float>>")
    def count(column: pa.Array) -> pa.Array:
        sizes = np.where(column.is_null(), 0, column.value_lengths().fill_null(0))
        ends = pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32))
        return pa.ListArray.from_arrays(ends, _letter_counts(column.flatten()), mask=column.is_null())
    return count(F.transform(texts, F.lower))
