"""Benchmark decontamination: an FM-index over the words of each shard of documents, searched backward for benchmark windows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM_BYTES, buffers, chunks, with_fields, words

#: Words in a window; an item of fewer is one window.
WINDOW = 10
#: Every so manyth text position keeps its place in the suffix array.
SAMPLE = 16
#: Indexed words after which a shard is searched, and text bytes likewise.
SHARD_WORDS, SHARD_BYTES = 1 << 19, 32 << 20
#: Bytes of benchmark texts that one pass carries to the tasks; a larger benchmark takes more passes.
BLOCK_BYTES = 8 << 20


class Phrases:
    """Distinct windows of some items as rows of word numbers (from 1, left-aligned, 0 beyond the end), and the items of each."""

    def __init__(self, items: list[str], texts: list[str]):
        raw = [t.encode("utf-8", "replace") for t in texts]
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in raw])]).astype(np.int64)
        hashes, _, _, ptr = words(np.frombuffer(b"".join(raw), np.uint8), offsets, ALNUM_BYTES)
        self.items = sorted(set(items))
        place = {x: k for k, x in enumerate(self.items)}
        self.vocabulary, ids = np.unique(hashes, return_inverse=True)
        rows, owner = [], []
        for item, a, b in zip(items, ptr[:-1], ptr[1:]):
            for s in range(a, max(b - WINDOW, a) + 1) if b > a else ():
                rows.append(np.pad(ids[s : min(s + WINDOW, b)] + 1, (0, max(0, WINDOW - (b - s)))))
                owner.append(place[item])
        windows, which = np.unique(np.array(rows, np.int64).reshape(-1, WINDOW), axis=0, return_inverse=True)
        pairs = np.unique(np.stack([which.ravel(), np.array(owner, np.int64)], 1), axis=0) if rows else np.zeros((0, 2), np.int64)
        self.windows, self.owner, self.first = windows, pairs[:, 1], np.searchsorted(pairs[:, 0], np.arange(len(windows) + 1))
        self.length = (windows > 0).sum(1)
        self.shortest = int(self.length.min()) if len(windows) else 0
        self.filter = np.zeros(1 << 16, bool)
        self.filter[self.vocabulary & np.uint64(0xFFFF)] = True

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each word, 0 for a word that no item has."""
        out = np.zeros(len(hashes), np.int32)
        if len(self.vocabulary):
            at = np.flatnonzero(self.filter[hashes & np.uint64(0xFFFF)])
            found = np.minimum(np.searchsorted(self.vocabulary, hashes[at]), len(self.vocabulary) - 1)
            out[at] = np.where(self.vocabulary[found] == hashes[at], found + 1, 0)
        return out


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Suffixes of s in order, by prefix doubling from packed symbols on."""
    n, bits = len(s), max(1, int(s.max(initial=0)).bit_length())
    h, key = max(1, 62 // bits), np.zeros(n, np.int64)
    for j in range(h):
        key <<= bits
        key[: max(n - j, 0)] |= s[j:]
    order = np.argsort(key, kind="stable")
    while True:
        sorted_key = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(sorted_key[1:] != sorted_key[:-1])])
        if n == 0 or rank[order[-1]] == n - 1:
            return order
        key = rank * (n + 1)
        key[: max(n - h, 0)] += rank[h:] + 1
        order = np.argsort(key, kind="stable")
        h *= 2


class Wavelet:
    """Ranks of symbols in a sequence: one bit vector with counts for each bit of the symbols, high bits first."""

    def __init__(self, s: np.ndarray):
        self.bits = max(1, int(s.max(initial=0)).bit_length())
        self.ones, self.zeros = [], []
        for b in range(self.bits - 1, -1, -1):
            bit = (s >> b) & 1 == 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit, dtype=np.int32)]).astype(np.int32))
            self.zeros.append(int(len(s) - self.ones[-1][-1]))
            s = np.concatenate([s[~bit], s[bit]])

    def rank(self, symbol: np.ndarray, end: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each end."""
        start = np.zeros_like(end)
        for level, b in enumerate(range(self.bits - 1, -1, -1)):
            ones, zeros = self.ones[level], self.zeros[level]
            one = (symbol >> b) & 1 == 1
            a, e = ones[start], ones[end]
            start, end = np.where(one, zeros + a, start - a), np.where(one, zeros + e, end - e)
        return end - start


class Index:
    """FM-index of a sequence whose last symbol, and no other, is 0."""

    def __init__(self, s: np.ndarray):
        order = suffix_array(s)
        self.bwt = s[order - 1]
        self.tree = Wavelet(self.bwt)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(s, minlength=1))])
        kept = order % SAMPLE == 0
        self.kept_before, self.kept, self.places = np.concatenate([[0], np.cumsum(kept)]), kept, order[kept]
        self.n = len(s)

    def step(self, symbol: np.ndarray, row: np.ndarray) -> np.ndarray:
        return self.before[symbol] + self.tree.rank(symbol, row)

    def search(self, rows: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each phrase the range of suffixes that begin with it."""
        low, high = np.zeros(len(rows), np.int64), np.full(len(rows), self.n, np.int64)
        known = rows < len(self.before) - 1
        for j in range(rows.shape[1] - 1, -1, -1):
            live = np.flatnonzero((length > j) & (low < high))
            c = rows[live, j]
            seen = known[live, j]
            high[live[~seen]] = low[live[~seen]]
            live, c = live[seen], c[seen]
            low[live], high[live] = self.step(c, low[live]), self.step(c, high[live])
        return low, high

    def locate(self, row: np.ndarray) -> np.ndarray:
        """Text positions of suffixes: back to the next sampled one."""
        out, steps, open_ = np.zeros(len(row), np.int64), 0, np.arange(len(row))
        row = row.copy()
        while len(open_):
            done = self.kept[row[open_]]
            at = open_[done]
            out[at] = self.places[self.kept_before[row[at]]] + steps
            open_ = open_[~done]
            row[open_] = self.step(self.bwt[row[open_]], row[open_])
            steps += 1
        return out


def shard_hits(numbers: np.ndarray, row_of: np.ndarray, phrases: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which of a shard's words are hit, and the pairs of row and item with an occurrence.

    Only runs of known words, as long as the shortest window at least, can hold a window: those are indexed, each
    after a mark, and the rest of the words is left out without loss.
    """
    hit, none = np.zeros(len(numbers), bool), np.zeros(0, np.int64)
    if not len(phrases.windows) or not len(numbers):
        return hit, none, none
    known = numbers > 0
    begins = known.copy()
    begins[1:] &= ~known[:-1] | (row_of[1:] != row_of[:-1])
    ends = known.copy()
    ends[:-1] &= ~known[1:] | (row_of[1:] != row_of[:-1])
    a, b = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    long = b - a >= phrases.shortest
    a, b = a[long], b[long]
    if not len(a):
        return hit, none, none
    size = b - a
    starts = np.concatenate([[0], np.cumsum(size + 1)])
    place = np.full(int(starts[-1]), -1, np.int64)
    within = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    at = np.repeat(starts[:-1], size) + within
    place[at] = np.repeat(a, size) + within
    s = np.ones(len(place), np.int64)  # 1 ends a run, 0 the shard: only one suffix begins with it
    s[at] = numbers[place[at]] + 1
    s[-1] = 0
    index = Index(s)
    low, high = index.search(phrases.windows + 1, phrases.length)
    count = high - low
    which = np.repeat(np.arange(len(count)), count)
    rows = np.repeat(low, count) + np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    start = place[index.locate(rows)]
    edge = np.zeros(len(numbers) + 1, np.int64)
    np.add.at(edge, start, 1)
    np.add.at(edge, start + phrases.length[which], -1)
    hit = np.cumsum(edge[:-1]) > 0
    found = np.unique(row_of[start].astype(np.int64) * len(phrases.windows) + which)
    row, window = found // len(phrases.windows), found % len(phrases.windows)
    n = phrases.first[window + 1] - phrases.first[window]
    item = phrases.owner[np.repeat(phrases.first[window], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)]
    pairs = np.unique(np.repeat(row, n) * max(1, len(phrases.items)) + item)
    return hit, pairs // max(1, len(phrases.items)), pairs % max(1, len(phrases.items))


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("first_byte", pa.int32()), ("last_byte", pa.int32())]))


def _joined(old: list, new: list) -> list:
    """Spans of two passes, merged where they touch or overlap."""
    out: list[dict] = []
    for x in sorted([*old, *new], key=lambda s: s["start"]):
        if out and x["start"] <= out[-1]["end"]:
            if x["end"] > out[-1]["end"]:
                out[-1] |= {"end": x["end"], "last_byte": x["last_byte"]}
        else:
            out.append(dict(x))
    return out


def _searched(shard: list[pa.RecordBatch], phrases: Phrases) -> Iterator[pa.RecordBatch]:
    numbers, row_of, first, last, ptrs, base = [], [], [], [], [], 0
    for batch in shard:
        data, offsets = buffers(batch.column("text"))
        for a, b in chunks(offsets):
            hashes, starts, ends, ptr = words(data, offsets[a : b + 1], ALNUM_BYTES)
            row = np.repeat(np.arange(b - a), np.diff(ptr))
            numbers.append(phrases.numbers(hashes))
            row_of.append(row + base)
            begin = (offsets[a : b + 1] - offsets[a])[row] if len(row) else row
            first.append((starts - begin).astype(np.int32))
            last.append((ends - begin).astype(np.int32))
            ptrs.append(np.diff(ptr))
            base += b - a
    n_words = np.concatenate(ptrs) if ptrs else np.zeros(0, np.int64)
    numbers, row_of, first, last = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (numbers, row_of, first, last))
    hit, rows, items = shard_hits(numbers, row_of, phrases)
    begins, ends = hit.copy(), hit.copy()
    begins[1:] &= ~hit[:-1] | (row_of[1:] != row_of[:-1])
    ends[:-1] &= ~hit[1:] | (row_of[1:] != row_of[:-1])
    a, b = np.flatnonzero(begins), np.flatnonzero(ends)
    ptr = np.concatenate([[0], np.cumsum(n_words)])
    spans: dict[int, list] = {}
    for s, e in zip(a, b):
        r = int(row_of[s])
        spans.setdefault(r, []).append({"start": int(s - ptr[r]), "end": int(e - ptr[r]) + 1, "first_byte": int(first[s]), "last_byte": int(last[e])})
    named: dict[int, list] = {}
    for r, i in zip(rows, items):
        named.setdefault(int(r), []).append(phrases.items[i])
    done = 0
    for batch in shard:
        n, at = len(batch), {k: x for k, x in enumerate(batch.schema.names)}
        old_spans, old_items = batch.column("spans").to_pylist(), batch.column("items").to_pylist()
        new = {
            "n_words": pa.array(n_words[done : done + n], pa.int64()),
            "spans": pa.array([_joined(x or [], spans.get(done + k, [])) if x or done + k in spans else [] for k, x in enumerate(old_spans)], _SPANS),
            "items": pa.array([sorted({*(x or []), *named.get(done + k, [])}) for k, x in enumerate(old_items)], pa.list_(pa.string())),
        }
        yield pa.RecordBatch.from_arrays([new.get(x, batch.column(k)) for k, x in at.items()], list(at.values()))
        done += n


def find(documents: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """documents with n_words long, spans and items array<string>.

    spans: hit words as array<struct<start, end (words, end exclusive), first_byte, last_byte (UTF-8)>>, merged; items:
    the item_ids, as sorted strings, with a window in the text. A null text counts as empty. Items with a null id
    or text, or without words, take no part; repeated ids are one item. Rows are searched whole, never moved, so
    repeated rows get equal results. The benchmark reaches the tasks in blocks of bounded size, one pass each.
    Columns of documents named n_words, spans or items are replaced, all others kept.
    """
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), "text").where("item IS NOT NULL AND text IS NOT NULL")
    total = items.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    blocks = -(-total // block_bytes) or 1
    span = "array<struct<start:int,end:int,first_byte:int,last_byte:int>>"
    documents = documents.drop("n_words", "spans", "items")
    out = documents.withColumns({"n_words": F.lit(0).cast("long"), "spans": F.lit(None).cast(span), "items": F.lit(None).cast("array<string>")})
    schema = with_fields(documents.schema, n_words="long", spans=span, items="array<string>")
    for block in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block).toPandas()
        phrases = documents.sparkSession.sparkContext.broadcast(Phrases(list(rows["item"]), list(rows["text"])))

        def passed(batches: Iterator[pa.RecordBatch], phrases=phrases) -> Iterator[pa.RecordBatch]:
            shard, n_bytes = [], 0
            for batch in batches:
                data, offsets = buffers(batch.column("text"))
                k = 0
                while k < len(batch):  # whole rows until the shard is full
                    end = max(k + 1, int(np.searchsorted(offsets, offsets[k] + SHARD_BYTES - n_bytes, "right")) - 1)
                    end = min(end, len(batch))
                    shard.append(batch.slice(k, end - k))
                    n_bytes += int(offsets[end] - offsets[k])
                    k = end
                    if n_bytes >= SHARD_BYTES or k < len(batch):
                        yield from _searched(shard, phrases.value)
                        shard, n_bytes = [], 0
            if shard:
                yield from _searched(shard, phrases.value)

        out = out.mapInArrow(passed, schema)
    return out


def cut(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """documents without the words of benchmark windows: each removal span goes, from its first word to its last, and n_chars, if there, is counted anew.

    Texts without a hit stay as they are, null ones too; a text that is nothing but hits becomes empty.
    """
    names = documents.columns

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for k, spans in enumerate(batch.column("spans").to_pylist()):
                if spans:
                    raw, parts, at = texts[k].encode("utf-8"), [], 0
                    for s in spans:
                        parts.append(raw[at : s["first_byte"]])
                        at = s["last_byte"]
                    texts[k] = b"".join([*parts, raw[at:]]).decode("utf-8", "replace")
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if x == "text" else batch.column(x) for x in names], names)

    found = find(documents.withColumnsRenamed({x: f"_{x}" for x in names if x in ("n_words", "spans", "items")}), benchmark)
    back = [F.col(f"_{x}").alias(x) if x in ("n_words", "spans", "items") else F.col(x) for x in names]
    clash = [x for x in names if x in ("n_words", "spans", "items")]
    if clash:  # columns of these names are only carried, so they travel under others
        names = [f"_{x}" if x in clash else x for x in names]
    out = found.mapInArrow(kept, found.select(*names).schema).select(*back)
    return out.withColumn("n_chars", F.length("text").cast(dict(documents.dtypes)["n_chars"])) if "n_chars" in documents.columns else out
