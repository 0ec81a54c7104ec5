"""Token-id files: texts encoded by a public tokenizer, ids range-coded into blocks, written in the order of the documents, read back."""

from __future__ import annotations

import json
import os
import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import codec
from .common import Memo, buffers, chunks, in_stretches, sized

#: The id after each document.
END = 0
#: Ids coded together: as many blocks run in step as this holds. A document is never cut.
PART_IDS = 1 << 22
#: Distinct pieces of text whose ids a worker keeps before it drops the rare ones.
KEPT = 400_000
#: What the usual pattern takes a character for, by code point: letter, number, other sign, and 3 for a character of which it needs more (white space, an apostrophe).
_KIND = np.array([3 if chr(c).isspace() or c == 39 else {"L": 0, "N": 1}.get(unicodedata.category(chr(c))[0], 2) for c in range(0x250)], np.uint8)
#: The character that a byte-level vocabulary has for a byte: those that print stand for themselves.
_PRINT = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
_BYTE = np.array([b if b in _PRINT else 256 + k for b, k in zip(range(256), np.cumsum([b not in _PRINT for b in range(256)]) - 1)], np.uint32)
_loaded: dict[str, Encoder] = {}


class Encoder(Memo):
    """The ids of texts by the tokenizers library, which sees each distinct piece once.

    A byte-level tokenizer with the usual pattern always cuts before a blank that stands between two other characters. So a text without
    neighbouring white space is the sequence of its pieces cut there, each encoded by itself. Other texts, those that hold
    the string of an added token (the library's default makes it that one id), and all texts of another kind of tokenizer are encoded whole.
    Pieces of letters, numbers and signs below U+0250 are cut as the pattern cuts and spelled in the vocabulary's characters for all of
    them at once; the library merges them. Other pieces go through its own pattern.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            made = json.load(file)
        before = made.get("pre_tokenizer") or {}
        usual = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and not made.get("normalizer")
        added = [re.escape(t["content"]) for t in made.get("added_tokens") or []]
        self.whole = re.compile("|".join([r"\s\s|\0", *added] if usual else [""]))
        self.cuts = re.compile(r"(?<=\S) (?=\S)" if usual and not any(" " in t for t in added) else r"(?!)")
        ids = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.line_break = ids[0] if len(ids) == 1 else -1
        self.merger = None
        vocab = self.tokenizer.get_vocab()
        if usual and made["model"].get("type") == "BPE" and all(chr(c) in vocab for c in _BYTE):
            self.spelled = np.zeros(max(vocab.values()) + 1, np.int64)
            self.spelled[list(vocab.values())] = list(map(len, vocab))
            self.merger = Tokenizer.from_str(json.dumps({**made, "pre_tokenizer": {"type": "CharDelimiterSplit", "delimiter": "\n"}, "post_processor": None}))
        self.clear()

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.int32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _each(self, pieces: list[str]) -> list[np.ndarray]:
        """The ids of each piece. Pieces without a line break are encoded together, one a line: the pattern cuts before and after a break that stands alone."""
        alone = [k for k, p in enumerate(pieces) if "\n" in p]
        found = dict(zip(alone, self._whole([pieces[k] for k in alone])))
        rest = [k for k in range(len(pieces)) if k not in found]
        every = self._whole(["\n".join(pieces[k] for k in rest)])[0] if rest else np.zeros(0, np.int32)
        cut = np.flatnonzero(every == self.line_break)
        if len(cut) == len(rest) - 1:
            found |= dict(zip(rest, (every[a:b] for a, b in zip(np.append(0, cut + 1), np.append(cut, len(every))))))
        else:
            found |= dict(zip(rest, self._whole([pieces[k] for k in rest])))
        return [found[k] for k in range(len(pieces))]

    def _plain(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which pieces are of letters, numbers and signs after one blank at most; of those, how many ids each has, and all these ids."""
        code = np.frombuffer("\n".join(pieces).encode("utf-32-le", "surrogatepass"), np.uint32)
        size = np.fromiter(map(len, pieces), np.int64, len(pieces)) + 1
        first = np.cumsum(size) - size
        head = np.zeros(len(code) + 1, bool)
        head[first] = True
        kind = _KIND[np.minimum(code, 0x24F)]
        kind[code >= 0x250] = 3
        blank = head[:-1] & (code == 32)
        odd = (kind == 3) & ~blank
        last = (first + size - 1)[:-1]  # the breaks between pieces
        odd[last] = False
        plain = np.add.reduceat(np.append(odd, False), first) == 0
        keep = np.repeat(plain, size)[: len(code)]
        cut = np.zeros(len(code), bool)
        cut[1:] = (kind[1:] != kind[:-1]) & ~head[1:-1] & ~blank[:-1]
        cut[last] = False
        code, cut, head = code[keep], cut[keep], np.flatnonzero(head[:-1][keep])
        two = code >= 128
        n = 1 + two + cut
        out = np.full(int(n.sum()), 10, np.uint32)
        at = np.cumsum(n) - n + cut
        out[at[~two]] = np.where(code == 10, 10, _BYTE[code & 127])[~two]
        out[at[two]], out[at[two] + 1] = _BYTE[0xC0 | code[two] >> 6], _BYTE[0x80 | code[two] & 63]
        ids = np.array(self.merger.encode_batch_fast([out.tobytes().decode("utf-32-le")], add_special_tokens=False)[0].ids, np.int32)
        spelled = np.concatenate([[0], np.cumsum(1 + two - (code == 10))])  # characters of the vocabulary before each of ours: pieces end where as many of theirs end
        ends = np.searchsorted(np.cumsum(self.spelled[ids]), spelled[np.append(head, len(code))], "right") if len(ids) else np.zeros(len(head) + 1, np.int64)
        return plain, np.diff(ends), ids

    def _learn(self, pieces: list[str]) -> None:
        for k in range(0, len(pieces), 4096):
            part = pieces[k : k + 4096]
            if self.merger:
                plain, length, ids = self._plain(part)
                self.add([p for p, x in zip(part, plain) if x], length, ids)
                part = [p for p, x in zip(part, plain) if not x]
            if part:
                found = self._each(part)
                self.add(part, np.array([len(x) for x in found], np.int64), np.concatenate(found))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and how many each text has. A long text is cut where the tokenizer always cuts, if there is such a place."""
        return in_stretches(texts, self.cuts, self._encoded)

    def _encoded(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.numbers) > KEPT:
            self.thin(KEPT // 2)
        rows, odd = [], {}
        for k, text in enumerate(texts):
            if not text or self.whole.search(text):
                odd[k] = text
                rows.append([])
            else:
                rows.append(text.replace(" ", "\0 ").split("\0"))
        pieces = [p for row in rows for p in row]
        ids, total = self.of(pieces, self._learn)
        cut = np.concatenate([[0], np.cumsum([len(row) for row in rows])]).astype(np.int64)
        sizes = total[cut[1:]] - total[cut[:-1]]
        if any(odd.values()):
            parts = np.split(ids, total[cut[1:-1]])
            for k, x in zip(odd, self._whole(list(odd.values()))):
                parts[k] = x
                sizes[k] = len(x)
            ids = np.concatenate(parts)
        return ids, sizes


def encoder(path: str) -> Encoder:
    """This worker's encoder of a tokenizer file."""
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    return _loaded[path]


def _written(path: str, kind: pa.DataType) -> Callable:
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, done, n, ids, sizes, names = TaskContext.get().partitionId(), 0, 0, [], [], []

        def flush() -> pa.RecordBatch:
            nonlocal done, n
            every, size = np.concatenate(ids), np.concatenate(sizes)
            row = [[part], [done], [n], [codec.encode(every)], [size], [pa.concat_arrays(names)]]
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(kind)]
            out = pa.RecordBatch.from_arrays([pa.array(v[:1] if k < 4 else [v[0].tolist()], t) if k < 5 else pa.ListArray.from_arrays(pa.array([0, len(v[0])], pa.int32()), v[0]) for k, (v, t) in enumerate(zip(row, kinds))], ["part", "start", "n_ids", "blocks", "sizes", "doc_ids"])
            done += n
            n = 0
            ids.clear(), sizes.clear(), names.clear()
            return out

        for batch in batches:
            for first, last in chunks(buffers(batch.column("text"))[1]):
                part_batch = batch.slice(first, last - first)
                texts = [t or "" for t in part_batch.column("text").to_pylist()]
                found, size = encoder(path).encode(texts)
                ends = np.cumsum(size)
                with_end = np.insert(found, ends, END)
                a, size = 0, size + 1
                ends = np.cumsum(size)
                while a < len(size):  # whole documents up to PART_IDS
                    before = int(ends[a - 1]) if a else 0
                    b = max(a + 1, int(np.searchsorted(ends, before + PART_IDS - n, "right"))) if not n else int(np.searchsorted(ends, before + PART_IDS - n, "right"))
                    b = min(max(b, a), len(size))
                    if b > a:
                        ids.append(with_end[before : int(ends[b - 1])])
                        sizes.append(size[a:b])
                        names.append(part_batch.column("doc_id").slice(a, b - a))
                        n += int(ends[b - 1]) - before
                        a = b
                    if a < len(size) or n >= PART_IDS:
                        yield flush()
        if names:
            yield flush()

    return of


def write(documents: DataFrame, path: str, tokenizer: str) -> None:
    """Token-id files at path: documents in ascending doc_id (nulls first, ties by text), dealt out by ranges of it.

    A row of a file has coded blocks of whole documents, with their doc_ids and numbers of ids (END counted), the range's number and
    the row's first id within the range. A null text counts as empty: END alone. Repeated rows are written as often as
    they come. Other columns are left out.
    """
    kind = documents.schema["doc_id"].dataType
    arrow = documents.select("doc_id").limit(0).toArrow().schema.field("doc_id").type
    ordered = documents.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(_written(tokenizer, arrow), f"part int, start long, n_ids long, blocks binary, sizes array<long>, doc_ids array<{kind.simpleString()}>").write.parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids (binary: little-endian unsigned 32-bit integers) from the files."""
    rows = spark.read.parquet(path)
    kind = rows.schema["doc_ids"].dataType.elementType.simpleString()
    totals = rows.groupBy("part").agg(F.sum("n_ids").alias("n"))  # one row for each range of ids
    before = totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                ids = codec.decode(batch.column("blocks")[k].as_py()).astype("<u4")
                size = batch.column("sizes").slice(k, 1).flatten().to_numpy()
                ends = np.cumsum(size)
                names = batch.column("doc_ids").slice(k, 1).flatten()
                first = int(batch.column("start")[k].as_py())
                for a in range(0, len(size), 2048):
                    e = ends[a : a + 2048]
                    from_ = int(e[0] - size[a])
                    data = pa.py_buffer(ids[from_ : int(e[-1])].tobytes())
                    at = (np.concatenate([[from_], e]) - from_) * 4
                    yield pa.RecordBatch.from_arrays([names.slice(a, 2048), pa.array(np.full(len(e), batch.column("part")[k].as_py(), np.int32)), pa.array(first + e - size[a : a + 2048]), pa.array(size[a : a + 2048]), pa.Array.from_buffers(pa.binary(), len(e), [None, pa.py_buffer(at.astype(np.int32).tobytes()), data])], ["doc_id", "part", "start", "n_tokens", "ids"])

    out = rows.select("part", "start", "blocks", "sizes", "doc_ids").mapInArrow(decoded, f"doc_id {kind}, part int, start long, n_tokens long, ids binary")
    return out.join(sized(before, 12), "part").select("doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids")
