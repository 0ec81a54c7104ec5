"""Helpers shared by the corpus operators: shared-folder tables, Arrow text buffers, word and n-gram hashes."""

from __future__ import annotations

import ctypes
import re
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Words of letters and digits after A-Z is lower-cased; every code point from U+0080 on counts as a letter.
ALNUM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words between ASCII white space.
SPACE_WORD = r"[^\x20\x09-\x0D]+"

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
ALNUM_BYTES = np.zeros(256, bool)
ALNUM_BYTES[48:58] = ALNUM_BYTES[65:91] = ALNUM_BYTES[97:123] = ALNUM_BYTES[128:] = True
SPACE_BYTES = np.ones(256, bool)
SPACE_BYTES[9:14] = SPACE_BYTES[32] = False

#: Text bytes that a vectorised step handles at once.
CHUNK_BYTES = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)
_POWERS = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only in a local session that names none."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not found:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="fluxweave-"))
        found = spark.sparkContext.getCheckpointDir()
    return found


#: The tables written for each settled() table that is in the making in this thread, innermost last.
_making = threading.local()


def saved(df: DataFrame, name: str = "table") -> DataFrame:
    """df written as Parquet to the shared folder and read back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    for paths in getattr(_making, "stack", [])[-1:]:
        paths.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def settled(make: Callable[[], DataFrame], name: str, spark: SparkSession) -> DataFrame:
    """What make returns, saved; the tables that were saved to make it are deleted then, so that they do not fill the shared folder for long."""
    stack = _making.__dict__.setdefault("stack", [])
    stack.append(paths := [])
    try:
        df = make()
    finally:
        stack.pop()
    out = saved(df, name)
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)
    return out


#: Bytes of a table up to which sized() has it broadcast: the driver holds it several times over while it is collected, hashed and sent.
BROADCAST_BYTES = 8 << 20


def sized(table: DataFrame, row_bytes: int) -> DataFrame:
    """A written table, marked for broadcast if its rows, counted, fit into BROADCAST_BYTES; else left for a shuffled join."""
    return F.broadcast(table) if table.count() * row_bytes <= BROADCAST_BYTES else table


def with_fields(schema: StructType, **more: str) -> StructType:
    """A new schema of these fields and further nullable ones, by name and type."""
    return StructType([*schema.fields, *StructType.fromDDL(", ".join(f"{name} {kind}" for name, kind in more.items())).fields])


def remainder(doc_id: Column | str, n: int) -> Column:
    """crc32 of the id as text, modulo n; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % n


def held(doc_id: str, n: int, value: int) -> Column:
    """Rows that no model learns from; a row without an id is one of them."""
    return F.coalesce(remainder(doc_id, n) == value, F.lit(True))


def text_hash(text: str = "text") -> Column:
    """With the id it tells rows apart, so that repeated ids keep results of their own."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a string column, nulls as empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES):
    """Row ranges of at most so many bytes, or one row where that is longer."""
    start, n = 0, len(offsets) - 1
    while start < n:
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1)
        yield start, min(end, n)
        start = min(end, n)


def stretches(text: str, at: re.Pattern, limit: int = CHUNK_BYTES) -> Iterator[str]:
    """text in parts, cut before the first match of at after so many characters of each; one part where none follows."""
    a = 0
    while len(text) - a > limit and (found := at.search(text, a + limit)):
        yield text[a : found.start()]
        a = found.start()
    yield text[a:]


def in_stretches(texts: list[str], at: re.Pattern, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """All ids of the texts, and how many each has, by an encoder that may be given any text cut at at: no more than a stretch of a long text is in work."""
    parts = [list(stretches(t, at)) for t in texts]
    if all(len(p) == 1 for p in parts):
        return encode(texts)
    ids = [encode([p])[0] for row in parts for p in row]
    ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])])[np.cumsum([0, *map(len, parts)])]
    return np.concatenate(ids), np.diff(ends)


def trimmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches; after the last one the worker gives free memory back to the system, so that it holds less while it waits for other work."""
    yield from batches
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc's
        trim(0)


class Memo:
    """The ids of pieces of text that came before: numbers has each piece's number; first, length and used, by number, where its ids begin, how many they are and how often it came."""

    def clear(self) -> None:
        self.numbers: dict[str, int] = {}
        self.first, self.length, self.used = (np.zeros(1 << 16, np.int64) for _ in range(3))
        self.ids, self.n = np.zeros(1 << 18, np.int32), 0

    def thin(self, most: int) -> None:
        """Keeps the pieces that came three times or more, at most so many."""
        keep = np.flatnonzero(self.used[: len(self.numbers)] > 2)[:most]
        names, length = list(self.numbers), self.length[keep]
        ends = np.cumsum(length)
        ids = self.ids[np.repeat(self.first[keep] - (ends - length), length) + np.arange(length.sum())]
        self.clear()
        self.add([names[k] for k in keep], length, ids)
        self.used[: len(keep)] = 1

    def add(self, pieces: list[str], length: np.ndarray, ids: np.ndarray) -> None:
        """New pieces, with how many ids each has and all those ids."""
        start, n = len(self.numbers), len(self.numbers) + len(pieces)
        while n > len(self.first):
            self.first, self.length, self.used = (np.concatenate([x, np.zeros_like(x)]) for x in (self.first, self.length, self.used))
        while self.n + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, self.ids])
        self.first[start:n], self.length[start:n] = self.n + np.cumsum(length) - length, length
        self.ids[self.n : self.n + len(ids)] = ids
        self.n += len(ids)
        self.numbers.update(zip(pieces, range(start, n)))

    def of(self, pieces: list[str], learn: Callable[[list[str]], None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of pieces, and where each one's begin, the end of all after them. learn adds those that are new; it is given each once."""
        number = np.fromiter(map(self.numbers.get, pieces, repeat(-1)), np.int64, len(pieces))
        if len(new := np.flatnonzero(number < 0)):
            late = [pieces[k] for k in new.tolist()]
            learn(list(dict.fromkeys(late)))
            number[new] = np.fromiter(map(self.numbers.__getitem__, late), np.int64, len(late))
        self.used += np.bincount(number, minlength=len(self.used))
        length = self.length[number]
        total = np.concatenate([[0], np.cumsum(length)])
        return self.ids[np.repeat(self.first[number] - total[:-1], length) + np.arange(total[-1])], total


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(kind: str, n: int) -> np.ndarray:
    if len(_POWERS[kind]) < n:
        row = np.full(max(n, CHUNK_BYTES + 1), _BASE if kind == "up" else _INVERSE, np.uint64)
        row[0] = 1
        _POWERS[kind] = np.cumprod(row, dtype=np.uint64)
    return _POWERS[kind][:n]


def spans(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the rows' words in order: first and past-last byte (from the first row's start), and each row's first word."""
    base = int(offsets[0])
    rows = offsets - base
    mask = is_word[data[base : int(offsets[-1])]]
    first = np.zeros(len(mask) + 1, bool)
    first[rows] = True
    before = np.empty(len(mask), bool)
    before[:1] = False
    before[1:] = mask[:-1]
    starts = np.flatnonzero(mask & (~before | first[:-1]))
    after = np.empty(len(mask), bool)
    after[-1:] = False
    after[:-1] = mask[1:]
    ends = np.flatnonzero(mask & (~after | first[1:])) + 1
    return starts, ends, np.searchsorted(starts, rows)


def words(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the rows' words in order, A-Z lower-cased: hashes, first and past-last byte (from the first row's start), and each row's first word."""
    starts, ends, ptr = spans(data, offsets, is_word)
    raw = LOWER[data[int(offsets[0]) : int(offsets[-1])]]
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _powers("up", len(raw)), out=total[1:])
    hashes = (total[ends] - total[starts]) * _powers("down", len(raw) + 1)[starts]
    return mixed(hashes ^ (ends - starts).astype(np.uint64)), starts, ends, ptr


def ramp(counts: np.ndarray) -> np.ndarray:
    """0, 1, .. for each count, one after the other."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)


def codes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A number for each word, equal for equal bytes and for those alone."""
    size = ends - starts
    data = raw[np.repeat(starts, size) + ramp(size)]
    at = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    every = pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(at), pa.py_buffer(data)])
    return every.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)


def grams(hashes: np.ndarray, ptr: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's runs of k words, and each row's first of them; rows of fewer words have none."""
    n = len(hashes)
    counts = np.maximum(np.diff(ptr) - (k - 1), 0)
    at = np.concatenate([[0], np.cumsum(counts)])
    if n < k:
        return np.zeros(0, np.uint64), at
    out = hashes[: n - k + 1] + np.uint64(k)
    for j in range(1, k):
        out = mixed(out) * np.uint64(0xD6E8FEB86659FD93) + hashes[j : n - k + 1 + j]
    out = mixed(out)
    keep = np.ones(len(out), bool)
    for j in range(1, k):  # runs that would reach past their row
        cut = ptr[1:] - j
        keep[cut[(cut >= ptr[:-1]) & (cut < len(out))]] = False
    return out[keep], at


def words_of(text: str, is_word: np.ndarray = ALNUM_BYTES) -> np.ndarray:
    """Word hashes of one text."""
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    return words(raw, np.array([0, len(raw)]), is_word)[0]
