"""Periodic runs of words: a harmonic grid of queries on suffix arrays finds every maximal repetition; texts without the repeats."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import SPACE_BYTES, buffers, chunks, codes, ramp, spans

#: Fewest words of a run; it also holds its period twice.
LEAST = 12
#: Pairs of grid positions looked at together.
GRID = 1 << 20
#: Neighbouring values of a block of Minima.
BLOCK = 32


def suffix_array(text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of the suffixes in order, each start's place in that order, and how many values neighbours in it share.

    text ends with a value that it has nowhere else. Prefixes double; only places that are still tied are sorted again.
    """
    n = len(text)
    order = np.argsort(text, kind="stable")
    new = np.append(True, text[order[1:]] != text[order[:-1]])
    rank = np.empty(n, np.int32)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    ranks, step = [rank], 1
    tied = np.flatnonzero(~(new & np.append(new[1:], True)))
    while len(tied):
        who = order[tied]
        key = rank[who].astype(np.int64) * n + rank[who + step]
        by = np.argsort(key, kind="stable")
        who, key = who[by], key[by]
        order[tied] = who
        new = np.append(True, key[1:] != key[:-1])
        rank = rank.copy()
        rank[who] = tied[np.maximum.accumulate(np.where(new, np.arange(len(tied)), 0))]
        ranks.append(rank)
        tied = tied[~(new & np.append(new[1:], True))]
        step *= 2
    shared = np.zeros(n - 1, np.int64)
    for k in range(len(ranks) - 1, -1, -1):  # equal ranks of round k: 2^k equal values
        shared += (ranks[k][order[:-1] + shared] == ranks[k][order[1:] + shared]).astype(np.int64) << k
    return order, rank, shared


class Minima:
    """Range minima: within blocks from either end, and over powers of two of whole blocks."""

    def __init__(self, values: np.ndarray):
        n = -(-max(len(values), 1) // BLOCK)
        self.values = np.full(n * BLOCK, np.iinfo(np.int32).max, np.int32)
        self.values[: len(values)] = values
        rows = self.values.reshape(n, BLOCK)
        self.up = np.minimum.accumulate(rows, 1).ravel()
        self.down = np.minimum.accumulate(rows[:, ::-1], 1)[:, ::-1].ravel()
        self.table = np.empty((n.bit_length(), n), np.int32)
        self.table[0] = rows.min(1)
        for k in range(1, len(self.table)):
            self.table[k] = self.table[k - 1]
            half = 1 << (k - 1)
            np.minimum(self.table[k - 1, :-half], self.table[k - 1, half:], out=self.table[k, :-half])

    def of(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """The least of values[first..last], for each pair."""
        p, q = first // BLOCK, last // BLOCK
        out = np.minimum(self.down[first], self.up[last])
        far = np.flatnonzero(q - p > 1)
        a, b = p[far] + 1, q[far]
        k = np.log2(b - a).astype(np.int64)
        out[far] = np.minimum(out[far], np.minimum(self.table[k, a], self.table[k, b - (1 << k)]))
        near = np.flatnonzero(p == q)
        a, b = first[near], last[near]
        least = self.values[a]
        for d in range(1, int((b - a).max(initial=0)) + 1):
            least = np.minimum(least, self.values[np.minimum(a + d, b)])
        out[near] = least
        return out


class Extensions:
    """How far equal values reach on from two places, by a suffix array and range minima over it."""

    def __init__(self, text: np.ndarray):
        _, self.rank, shared = suffix_array(text)
        self.minima = Minima(shared)

    def of(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        a, b = self.rank[i].astype(np.int64), self.rank[j].astype(np.int64)
        return self.minima.of(np.minimum(a, b), np.maximum(a, b) - 1).astype(np.int64)


def _distinct(found: np.ndarray) -> np.ndarray:
    """start, end, period with the least period of each start and end: a multiple of a run's period has the same extent."""
    found = found[np.lexsort(found.T[::-1])]
    new = np.append(True, (found[1:, :2] != found[:-1, :2]).any(1)) if len(found) else np.zeros(0, bool)
    return found[new]


def runs_of(words: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    """start, end and least period, by start, of all runs of rows of words that begin at ptr; places count through all rows.

    For each period p, neighbouring multiples jp and (j+1)p are extended in both directions. A run of two periods or more
    holds such a pair, so none is missed.
    """
    size = np.diff(ptr)
    text = np.empty(len(words) + len(ptr), np.int64)  # a value of its own before each row and at the end
    row_at = ptr + np.arange(len(ptr))
    held = np.ones(len(text), bool)
    held[row_at] = False
    text[held] = words
    text[row_at] = (int(words.max()) if len(words) else 0) + 1 + np.arange(len(ptr))
    long = np.flatnonzero(size >= LEAST)
    if not len(long):
        return np.zeros((0, 3), np.int64)
    forward, backward, n = Extensions(text), Extensions(text[::-1]), len(text)
    half = size[long] // 2
    rows, periods = np.repeat(long, half), ramp(half) + 1
    pairs = (size[rows] - 1) // periods
    ends, found, a = np.cumsum(pairs), [np.zeros((0, 3), np.int64)], 0
    while a < len(rows):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + GRID, "right")))
        count = pairs[a:b]
        p = np.repeat(periods[a:b], count)
        i = np.repeat(row_at[rows[a:b]] + 1, count) + ramp(count) * p
        same = np.flatnonzero(text[i] == text[i + p])
        i, p = i[same], p[same]
        on, back = forward.of(i, i + p), backward.of(n - i, n - i - p)
        run = np.flatnonzero((on + back >= p) & (on + back + p >= LEAST))
        i, p, on, back = i[run], p[run], on[run], back[run]
        found.append(_distinct(np.stack([i - back, i + p + on, p], 1)))
        a = b
    found = _distinct(np.concatenate(found))
    found[:, :2] -= np.searchsorted(row_at, found[:, :1], "right")  # without the values between rows
    return found


RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = buffers(batch.column("text"))
        for a, b in chunks(offsets):
            raw = data[offsets[a] : offsets[b]].copy()
            starts, ends, ptr = spans(data, offsets[a : b + 1], SPACE_BYTES)
            runs = runs_of(codes(raw, starts, ends), ptr)
            row = np.searchsorted(ptr, runs[:, 0], "right") - 1
            change = np.zeros(len(starts) + 1, np.int64)
            np.add.at(change, runs[:, 0] + runs[:, 2], 1)
            np.add.at(change, runs[:, 1], -1)
            kept = np.flatnonzero(np.cumsum(change[:-1]) == 0)
            of = np.searchsorted(ptr, kept, "right") - 1  # the row of each kept word
            followed = np.append(of[1:] == of[:-1], False)[: len(kept)]
            raw[ends[kept[followed]]] = 32  # what follows a word that is not its text's last is a blank
            size = ends[kept] - starts[kept] + followed
            text = raw[np.repeat(starts[kept], size) + ramp(size)]
            lengths = np.bincount(of, size, b - a).astype(np.int64) if len(kept) else np.zeros(b - a, np.int64)
            at = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
            collapsed = pa.Array.from_buffers(pa.large_string(), b - a, [None, pa.py_buffer(at), pa.py_buffer(text)])
            structs = pa.StructArray.from_arrays([pa.array(x) for x in (runs[:, 0] - ptr[row], runs[:, 1] - runs[:, 0], runs[:, 2])], fields=list(RUN))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=b - a))]), pa.int32()), structs)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(np.diff(ptr)), lists, collapsed.cast(pa.string())], ["doc_id", "n_words", "runs", "collapsed"])


def find(documents: DataFrame) -> DataFrame:
    """doc_id, n_words, runs (start, length, period, by start, then period) and collapsed of each text.

    Words stand between ASCII white space. A run is a stretch of words with a least period q (words q apart are equal), of
    LEAST words and of 2 * q at least, that no neighbouring word extends. collapsed is the text's words, joined by one
    blank, without those that stand in a run after its first q words. A null text counts as empty and has no run; repeated
    rows repeat their results; other columns are left out. A text is handled as a whole, in about 150 bytes a word.
    """
    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(_found, f"doc_id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")
