"""Packing by concatenate and cut: prefix sums over the parts' totals give every id its global place, windows of fixed length are cut there."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import buffers, chunks, ramp, saved, sized
from .tokens import END, encoder

#: Ids in a sequence.
LENGTH = 1024


def _encoded(tokenizer: str) -> Callable:
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, done = TaskContext.get().partitionId(), 0
        for batch in batches:
            for a, b in chunks(buffers(batch.column("text"))[1]):
                texts = [t or "" for t in batch.column("text").slice(a, b - a).to_pylist()]
                ids, size = encoder(tokenizer).encode(texts)
                ids = np.insert(ids, np.cumsum(size), END).astype(np.int32)
                at = np.concatenate([[0], np.cumsum(size + 1)])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(b - a, part, np.int32)), pa.array(done + at[:-1]), batch.column("doc_id").slice(a, b - a), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids))], ["part", "start", "doc_id", "ids"])
                done += int(at[-1])

    return of


def _cut(length: int) -> Callable:
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, first = batch.column("ids"), batch.column("first").to_numpy()
            ids = lists.flatten().to_numpy()
            size = lists.value_lengths().to_numpy().astype(np.int64)
            n = (first + size - 1) // length - first // length + 1
            row = np.repeat(np.arange(len(size)), n)
            window = first[row] // length + ramp(n)
            a, b = np.maximum(first[row], window * length), np.minimum((first + size)[row], (window + 1) * length)
            new = np.append(True, (window[1:] != window[:-1]) | (a[1:] != b[:-1]))[: len(row)]  # where the pieces so far are no whole sequence's beginning
            heads = np.flatnonzero(new)
            ends = np.cumsum(b - a)
            raw = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
            crc = np.array([zlib.crc32(raw[4 * (e - s) : 4 * e]) for e, s in zip(ends.tolist(), (b - a).tolist())], np.int64)
            pieces = pa.StructArray.from_arrays([batch.column("doc_id").take(pa.array(row)), *(pa.array(x) for x in (a - first[row], b - a, a - window * length, size[row], crc))], ["doc_id", "start", "length", "offset", "doc_tokens", "ids_crc32"])
            places = np.append(heads, len(row))
            at = np.append(0, ends)[places]
            columns = [pa.array(window[heads]), pa.array((a - window * length)[heads]), pa.array(np.diff(at)), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids)), pa.ListArray.from_arrays(pa.array(places, pa.int32()), pieces)]
            yield pa.RecordBatch.from_arrays(columns, ["sequence_id", "offset", "length", "ids", "pieces"])

    return of


def pack(documents: DataFrame, tokenizer: str, length: int = LENGTH) -> DataFrame:
    """sequence_id, length, ids and pieces of sequences of length ids, of which only the last may have fewer (a reader pads it).

    Every document's ids, with END after them, stand one after the other in one row of ids, in no order that is promised, and that is cut every length ids.
    pieces are the boundary records: doc_id, start (its document's ids before it), length, offset in the sequence, doc_tokens
    (ids of the whole document) and ids_crc32 (of little-endian unsigned 32-bit ids). A null text counts as empty: END alone. Repeated rows
    and null ids are packed as they come; other columns are left out.

    The first pass writes the ids with their places in their part; the parts' totals, a row each, are summed up; the second cuts. A sequence
    within one batch of a part is whole there; only those across edges are shuffled, in pieces of at least one id.
    """
    kind = documents.schema["doc_id"].dataType.simpleString()
    rows = saved(documents.select("doc_id", "text").mapInArrow(_encoded(tokenizer), f"part int, start long, doc_id {kind}, ids array<int>"), "ids")
    totals = rows.groupBy("part").agg(F.max(F.col("start") + F.size("ids")).alias("n"))
    before = totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    placed = rows.join(sized(saved(before, "before"), 12), "part").select((F.col("before") + F.col("start")).alias("first"), "doc_id", "ids")
    piece = f"struct<doc_id:{kind},start:long,length:long,offset:long,doc_tokens:long,ids_crc32:long>"
    cut = saved(placed.mapInArrow(_cut(length), f"sequence_id long, offset long, length long, ids array<int>, pieces array<{piece}>"), "sequences")
    edges = cut.where(F.col("length") < length).groupBy("sequence_id").agg(F.sum("length").alias("length"), F.sort_array(F.collect_list(F.struct("offset", "ids", "pieces"))).alias("p"))
    edges = edges.select("sequence_id", "length", F.flatten(F.transform("p", lambda x: x.ids)).alias("ids"), F.flatten(F.transform("p", lambda x: x.pieces)).alias("pieces"))
    return cut.where(F.col("length") == length).select(*edges.columns).unionByName(edges)
