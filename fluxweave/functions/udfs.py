"""Vectorised functions for what columns cannot say: byte statistics of payloads, phrase counts, rescaled range, spectra."""

from __future__ import annotations

import zlib

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _entropy(counts: np.ndarray) -> float:
    p = counts[counts > 0] / counts.sum()
    return float(-(p * np.log2(p)).sum()) + 0.0


def _bits(counts: np.ndarray) -> float:
    """Sum of c * log2(c)."""
    c = counts[counts > 0]
    return float((c * np.log2(c)).sum())


def _numbers(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.DoubleType()) for n in names])


@F.pandas_udf(T.ArrayType(T.LongType()))
def byte_counts(payloads: pd.Series) -> pd.Series:
    """How often each byte comes; null for no bytes."""
    return payloads.map(lambda p: np.bincount(np.frombuffer(p, np.uint8), minlength=256) if p else None)


@F.pandas_udf(_numbers("entropy", "markov", "autocorr"))
def byte_order(payloads: pd.Series) -> pd.DataFrame:
    """Entropy of the bytes and of each byte given the one before, and their autocorrelation at lag 1; null for no bytes."""
    rows = []
    for p in payloads:
        if not p:
            rows.append((None,) * 3)
            continue
        x, markov, auto = np.frombuffer(p, np.uint8), 0.0, None
        if len(x) > 1:
            pairs = np.unique(x[:-1].astype(np.int32) * 256 + x[1:], return_counts=True)[1]
            markov = (_bits(np.bincount(x[:-1])) - _bits(pairs)) / (len(x) - 1)
            d = x - x.mean()
            below = (d[:-1] ** 2).sum()
            auto = float((d[:-1] * d[1:]).sum() / below) if below > 0 else 0.0
        rows.append((_entropy(np.bincount(x)), max(markov, 0.0), auto))
    return pd.DataFrame(rows, columns=["entropy", "markov", "autocorr"])


@F.pandas_udf(T.DoubleType())
def compressed_share(payloads: pd.Series) -> pd.Series:
    """Size by zlib over size; null for no bytes."""
    return payloads.map(lambda p: len(zlib.compress(p)) / len(p) if p else None)


@F.pandas_udf(T.DoubleType())
def byte_entropy(payloads: pd.Series) -> pd.Series:
    return payloads.map(lambda p: None if p is None else _entropy(np.bincount(np.frombuffer(p, np.uint8))) if p else 0.0)


@F.pandas_udf(_numbers("t3", "t4"))
def byte_terms(payloads: pd.Series, before: pd.Series, sums: pd.Series) -> pd.DataFrame:
    """What a payload's bytes add to third and fourth moments by the recurrence, after so many bytes with such a sum."""
    rows = []
    for p, n, s in zip(payloads, before, sums):
        if not p:
            rows.append((None, None))
            continue
        x = np.frombuffer(p, np.uint8).astype(float)
        k = n + np.arange(1, len(x) + 1)
        total = s + np.cumsum(x)
        d, d2 = x - np.divide(total - x, k - 1, out=np.zeros(len(x)), where=k > 1), x - total / k
        rows.append(((d * d2 * d2 * (1 - 3 / k)).sum(), (d * d2**3 - 4 * d * d * d2 * d2 / k + 6 * d2**3 / (k * k)).sum()))
    return pd.DataFrame(rows, columns=["t3", "t4"])


@F.pandas_udf(T.LongType())
def lz78_phrases(values: pd.Series) -> pd.Series:
    """Phrases of an incremental parse; a last one that is not new does not count."""

    def phrases(xs) -> int:
        if xs is None or len(xs) < 2:
            return 0
        tree: dict = {}
        node, n = tree, 0
        for x in xs:
            if x in node:
                node = node[x]
            else:
                node[x] = {}
                node, n = tree, n + 1
        return n

    return values.map(phrases)


@F.pandas_udf(T.DoubleType())
def hurst_rs(values: pd.Series) -> pd.Series:
    """Slope of log rescaled range over log block size, blocks of 8, 16, ... up to half the sequence; 0.5 without two sizes.

    A size's rescaled range is the mean over all its blocks, of range over sample deviation; a constant block counts as 0.
    """

    def slope(xs) -> float:
        x, points, size = np.asarray([] if xs is None else xs, float), [], 8
        while size <= len(x) // 2:
            blocks = x[: len(x) // size * size].reshape(-1, size)
            deviation = blocks - blocks.mean(1, keepdims=True)
            walk, sd = np.cumsum(deviation, 1), np.sqrt((deviation**2).sum(1) / (size - 1))
            ratio = np.divide(np.maximum(walk.max(1), 0) - np.minimum(walk.min(1), 0), sd, out=np.zeros(len(sd)), where=sd > 0).mean()
            if ratio > 0:
                points.append((np.log(size), np.log(ratio)))
            size *= 2
        if len(points) < 2:
            return 0.5
        return float(np.clip(np.polyfit(*np.array(points).T, 1)[0], 0, 1.5))

    return values.map(slope)


@F.pandas_udf(T.StringType())
def short_numbers(values: pd.Series) -> pd.Series:
    """Numbers with six significant digits, comma-joined."""
    return values.map(lambda xs: ",".join("%g" % x for x in xs) if xs is not None else None)


#: Values that are transformed together.
SPECTRA = 1 << 18
SPECTRUM = T.StructType([T.StructField("idx", T.ArrayType(T.IntegerType())), T.StructField("mag", T.ArrayType(T.DoubleType())), *[T.StructField(s, T.DoubleType()) for s in ("mean", "std", "min", "max", "median", "q1", "q3", "skew", "kurt", "psd")]])


@F.pandas_udf(SPECTRUM)
def spectrum(values: pd.Series) -> pd.DataFrame:
    """Magnitudes of the lower half of the transform, padded to a power of two; null for fewer than two values. Sequences of one padded length are transformed together."""
    length = np.array([0 if xs is None else len(xs) for xs in values])
    sizes = np.array([1 << (n - 1).bit_length() if n > 1 else 0 for n in length.tolist()])
    rows: list[tuple] = [(None,) * 12] * len(values)
    for size in np.unique(sizes[sizes > 0]).tolist():
        which = np.flatnonzero(sizes == size)
        for lo in range(0, len(which), max(1, SPECTRA // size)):
            mine = which[lo : lo + max(1, SPECTRA // size)]
            x = np.zeros((len(mine), size))
            for k, at in enumerate(mine.tolist()):
                x[k, : length[at]] = values.iat[at]
            for at, row in zip(mine.tolist(), _spectra(x)):
                rows[at] = row
    return pd.DataFrame(rows, columns=[f.name for f in SPECTRUM])


def _spectra(x: np.ndarray) -> Iterator[tuple]:
    mag = np.abs(np.fft.fft(x))[:, : x.shape[1] // 2]
    n, mean = mag.shape[1], mag.mean(1)
    sd = mag.std(1, ddof=1) if n > 1 else np.zeros(len(mag))
    s = np.sort(mag, 1)
    central = mag - mean[:, None]
    varies = sd > 1e-9 * np.maximum(1.0, mean)
    with np.errstate(divide="ignore", invalid="ignore"):
        skew, kurt = np.where(varies, (central**3).mean(1) / sd**3, 0.0), np.where(varies, (central**4).mean(1) / sd**4 - 3, 0.0)
    if n > 1:
        order = np.argsort(-mag[:, 1:], 1, kind="stable")[:, :5] + 1
        missing = ((0, 0), (0, 5 - order.shape[1]))
        idx, top, psd = np.pad(order, missing, constant_values=-1), np.pad(np.take_along_axis(mag, order, 1), missing, constant_values=-1.0), (mag[:, 1:] ** 2).max(1)
    else:
        idx, top, psd = np.zeros((len(mag), 5), int), np.zeros((len(mag), 5)), np.zeros(len(mag))
    return zip(idx.tolist(), top.tolist(), *(v.tolist() for v in (mean, sd, s[:, 0], s[:, -1], s[:, n // 2], s[:, n // 4], s[:, 3 * n // 4], skew, kurt, psd)))


#: What statistics() tells of a value, and of a value and that of k packets before: how many products there are, and sums of the values that have the other one, products and squares.
MOMENTS, PRODUCTS = ("n", "avg", "lo", "hi", "sd", "sk", "ku"), ("c", "x", "y", "xy", "yy")


def _moments(x: np.ndarray, row: np.ndarray, rows: int, shares: list[float]) -> list[np.ndarray]:
    """Of the values x, whose rows ascend: each row's MOMENTS (sample deviation), and quantiles between neighbouring ranks by proportion; NaN for none.

    Central moments grow value by value, of all rows at once, as those of the aggregates do.
    """
    every, found = np.bincount(row, minlength=rows), np.full((6 + len(shares), rows), np.nan)
    some = np.flatnonzero(every)
    if len(some):
        n = every[some]
        first = np.cumsum(n) - n
        longest = np.argsort(-n, kind="stable")
        begin, mean, m2, m3, m4 = first[longest], *np.zeros((4, len(some)))
        for j, alive in enumerate(np.searchsorted(-n[longest], -np.arange(n.max()))):
            d = x[begin[:alive] + j] - mean[:alive]
            dn = d / (j + 1)
            d2, dn2 = d * d, dn * dn
            mean[:alive] += dn
            m2[:alive] += d * (d - dn)
            m3[:alive] = m3[:alive] - 3 * dn * m2[:alive] + d * (d2 - dn2)
            m4[:alive] = m4[:alive] - 4 * dn * m3[:alive] - 6 * dn2 * m2[:alive] + d * (d * d2 - dn * dn2)
        at, k = some[longest], n[longest]
        found[0, some] = np.bincount(row, x, rows)[some] / n
        found[1, some], found[2, some] = np.minimum.reduceat(x, first), np.maximum.reduceat(x, first)
        with np.errstate(divide="ignore", invalid="ignore"):
            found[3:6, at] = np.sqrt(m2 / (k - 1)), np.sqrt(k) * m3 / np.sqrt(m2 * m2 * m2), k * m4 / (m2 * m2) - 3
        ranked = x[np.lexsort((x, row))] if shares else x
        for k, share in enumerate(shares):
            place = share * (n - 1)
            low = np.floor(place).astype(np.int64)
            over = place - low
            a, b = ranked[first + low], ranked[first + np.minimum(low + 1, n - 1)]
            found[6 + k, some] = np.where(a == b, a * (1 - over + over), a * (1 - over) + b * over)
    return [every.astype(float), *found]


def _products(x: np.ndarray, before: list[np.ndarray], row: np.ndarray, rows: int) -> list[np.ndarray]:
    """Each row's count, sum and sum of squares of x, then PRODUCTS with each of the values before; NaN is none."""
    added = lambda v: np.bincount(row, v, rows)
    there = ~np.isnan(x)
    found = [added(there), added(np.where(there, x, 0.0)), added(np.where(there, x * x, 0.0))]
    for y in before:
        both = there & ~np.isnan(y)
        a, b = np.where(both, x, 0.0), np.where(both, y, 0.0)
        found += map(added, (both, a, b, a * b, b * b))
    return found


def statistics(shares: list[list[float]], lags: list[int]) -> Callable:
    """A function of arrays of structs of doubles: of a field for each shares MOMENTS and q0, q1, .. (quantiles by these shares), then, of a field and those of so many lags, n, s, s2 and PRODUCTS; each with a number of its own."""
    names = [f"{s}_{k}" for k, of in enumerate(shares) for s in (*MOMENTS, *(f"q{j}" for j in range(len(of))))]
    names += [f"{s}_{len(shares) + k}" for k, n in enumerate(lags) for s in ("n", "s", "s2", *(f"{part}{j}" for j in range(1, n + 1) for part in PRODUCTS))]

    @F.arrow_udf(_numbers(*names))
    def of_arrays(arrays: pa.Array) -> pa.Array:
        values, size = arrays.flatten(), arrays.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        row, out = np.repeat(np.arange(len(size)), size), []
        for k, of in enumerate(shares):
            there = values.field(k).is_valid().to_numpy(zero_copy_only=False)
            out += _moments(values.field(k).to_numpy(zero_copy_only=False)[there], row[there], len(size), of)
        k = len(shares)
        for n in lags:
            x, *before = (values.field(j).to_numpy(zero_copy_only=False) for j in range(k, k + n + 1))
            out += _products(x, before, row, len(size))
            k += n + 1
        return pa.StructArray.from_arrays([pa.array(x, from_pandas=True) for x in out], names)

    return of_arrays


def register(spark: SparkSession) -> None:
    """Makes the functions callable from SQL."""
    for f in (byte_counts, byte_order, compressed_share, byte_entropy, byte_terms, lz78_phrases, hurst_rs, short_numbers, spectrum):
        spark.udf.register(f.__name__, f)
