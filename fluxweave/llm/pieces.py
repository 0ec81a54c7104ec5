"""SentencePiece encoding and decoding by suffix-array matching: all occurrences of all pieces as edges, sorted by position and relaxed.

For models of the BPE kind with identity normalization, a dummy blank in front, and byte fallback. An edge may extend the
encoding of the text before it if no merge would cross their border (see Model.fits); of the edges that end at one place,
one does. So a forward pass over the edges finds the encoding that merging by score finds.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import Memo, buffers, chunks, in_stretches, trimmed, with_fields

#: What the model's pieces have for a blank.
BLANK = "▁"
#: Distinct chunks of text (blanks and what follows them) whose ids a worker keeps before it drops the rare ones; chunks indexed at once.
KEPT, INDEXED = 250_000, 15_000
_CHUNK = re.compile(r" *[^ ]+| +")
_BREAK = re.compile(r"(?<=[^ ]) ")
_loaded: dict[str, Model] = {}


class Model(Memo):
    """The pieces of a model file, ranked: single characters first, then the others by falling score, as merges make them."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.byte_id, self.text = [sp.unk_id()] * 256, [b""] * n
        plain = []
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_id[int(piece[3:-1], 16)] = i
                self.text[i] = bytes([int(piece[3:-1], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                plain.append((len(piece) > 1, -sp.get_score(i), i, piece.replace(BLANK, " ")))
                self.text[i] = plain[-1][3].encode()
            elif sp.is_unknown(i):
                self.text[i] = " ⁇ ".encode()
        plain.sort()
        self.pieces = [p for *_, p in plain]
        self.id_of = np.array([i for _, _, i, _ in plain] + [-1], np.int64)
        self.unknown = len(plain)  # the rank of a character that is no piece
        rank = {p: k for k, p in enumerate(self.pieces)}
        self.sizes = np.array([len(p) for p in self.pieces] + [1], np.int64)
        self.longest = int(self.sizes.max())
        self.letters = np.zeros((len(plain), self.longest), np.int64)
        for k, p in enumerate(self.pieces):
            self.letters[k, : len(p)] = [ord(x) for x in p]
        self.single = {p for p in self.pieces if len(p) == 1}
        self._merges(rank)
        self.alphabet: dict[str, int] = {}  # of the characters that came so far
        self.bounds = None
        self.clear()

    def _merges(self, rank: dict[str, int]) -> None:
        """The pairs that merge, and how each piece is made last."""
        n = len(self.pieces)
        a, b, c = [], [], []
        for k, p in enumerate(self.pieces):
            for j in range(1, len(p)):
                if (x := rank.get(p[:j])) is not None and (y := rank.get(p[j:])) is not None:
                    a.append(x), b.append(y), c.append(k)
        self.mask = (1 << max(4, (4 * len(a)).bit_length())) - 1
        self.slot_key, self.slot_to = np.full(self.mask + 1, -1, np.int64), np.full(self.mask + 1, 1 << 40, np.int64)
        key = np.array(a, np.int64) << 32 | np.array(b, np.int64)
        left = np.arange(len(key))
        at = self._slot(key)
        while len(left):  # open addressing: the first of those that want a free slot gets it
            free = self.slot_key[at[left]] < 0
            want, first = np.unique(at[left[free]], return_index=True)
            put = left[free][first]
            self.slot_key[want], self.slot_to[want] = key[put], np.array(c, np.int64)[put]
            left = np.setdiff1d(left, put)
            at[left] = np.where(self.slot_key[at[left]] == key[left], at[left], (at[left] + 1) & self.mask)
        self.left, self.right = np.arange(n + 1), np.arange(n + 1)
        self.made = np.ones(n + 1, bool)
        pairs: dict[int, list] = {}
        for x, y, k in zip(a, b, c):
            pairs.setdefault(k, []).append((x, y))
        for size in range(2, self.longest + 1):  # shorter pieces first: their own making is known by then
            ks = [k for k, p in enumerate(self.pieces) if len(p) == size]
            rows = [(k, x, y) for k in ks for x, y in pairs.get(k, ()) if self.made[x] and self.made[y]]
            self.made[ks] = False
            if rows:
                k, x, y = np.array(rows, np.int64).T
                fit = self.fits(x, y, k)
                self.left[k[fit]], self.right[k[fit]], self.made[k[fit]] = x[fit], y[fit], True

    def _slot(self, key: np.ndarray) -> np.ndarray:
        h = key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (h >> np.uint64(40)).astype(np.int64) & self.mask

    def merge(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of the piece that two make, or one beyond all."""
        key, out = a << 32 | b, np.full(len(a), 1 << 40, np.int64)
        at, open_ = self._slot(key), np.arange(len(a))
        while len(open_):
            found = self.slot_key[at[open_]]
            hit = found == key[open_]
            out[open_[hit]] = self.slot_to[at[open_[hit]]]
            open_ = open_[~hit & (found >= 0)]
            at[open_] = (at[open_] + 1) & self.mask
        return out

    def fits(self, a: np.ndarray, b: np.ndarray, but: np.ndarray | None = None) -> np.ndarray:
        """Whether pieces a and b stay side by side when their text is merged from characters on (but: apart from this last merge).

        Taken apart from the last merge back, whichever side was made later: a pair at the border that would have merged
        before the next known merge, and left of it in a tie, speaks against.
        """
        a, b, ok, limit = a.copy(), b.copy(), np.ones(len(a), bool), np.full(len(a), 1 << 39, np.int64)
        if but is not None:
            limit = but.copy()
        open_ = np.arange(len(a))
        while len(open_):
            x, y = a[open_], b[open_]
            bad = self.merge(x, y) < limit[open_]
            ok[open_[bad]] = False
            open_, x, y = open_[~bad], x[~bad], y[~bad]
            first = x > y
            x_end, y_end = self.right[x] == x, self.left[y] == y
            take_x = np.where(first, ~x_end, y_end & ~x_end)
            take_y = np.where(first, x_end & ~y_end, ~y_end)
            limit[open_] = np.where(take_x, x, y + 1)
            a[open_], b[open_] = np.where(take_x, self.right[x], x), np.where(take_y, self.left[y], y)
            open_ = open_[take_x | take_y]
        return ok

    def _bounds(self, alphabet: dict[str, int], bits: int, per: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ranks of the pieces that are made of the alphabet and by merges, and the least and the largest key of a place where each begins, by level; kept while the alphabet is the same."""
        if self.bounds is None or self.bounds[0] != alphabet:
            of = np.zeros(0x110000, np.int32)
            of[[ord(x) for x in alphabet]] = list(alphabet.values())
            c, inside = of[self.letters], np.arange(self.longest) < self.sizes[:-1, None]
            ranks = np.flatnonzero(((c > 0) | ~inside).all(1) & self.made[:-1])
            levels = -(-self.longest // per)
            low = np.zeros((len(ranks), levels * per), np.int64)
            low[:, : self.longest] = np.where(inside, c, 0)[ranks]
            high = np.full_like(low, (1 << bits) - 1)
            high[:, : self.longest] = np.where(inside, c, (1 << bits) - 1)[ranks]
            weight = np.int64(1) << bits * np.arange(per - 1, -1, -1)
            self.bounds = dict(alphabet), ranks, low.reshape(-1, levels, per) @ weight, high.reshape(-1, levels, per) @ weight
        return self.bounds[1:]

    def matches(self, codes: np.ndarray, alphabet: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Edges start, end, rank: every occurrence of every piece that merges make in the codes (0 ends a chunk, 1 is no piece's character)."""
        bits = max(2, (len(alphabet) + 2).bit_length())
        per = 62 // bits
        n, levels = len(codes), -(-self.longest // per)
        padded = np.concatenate([codes, np.zeros(levels * per, np.int64)])
        keys = []
        for v in range(levels):
            key = np.zeros(n, np.int64)
            for j in range(per):
                key = key << bits | padded[v * per + j : v * per + j + n]
            keys.append(key)
        order = np.lexsort(keys[::-1]) if levels > 1 else np.argsort(keys[0])
        keys = [k[order] for k in keys]
        ranks, least, most = self._bounds(alphabet, bits, per)
        a, b = np.zeros(len(ranks), np.int64), np.full(len(ranks), n, np.int64)
        for v in range(levels):
            a, b = _bisect(keys[v], least[:, v], a, b, False), _bisect(keys[v], most[:, v], a, b, True)
        count = b - a
        which = np.repeat(np.arange(len(ranks)), count)
        start = order[np.repeat(a, count) + np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)]
        rank = ranks[which]
        return start, start + self.sizes[rank], rank

    def _learn(self, chunks: list[str]) -> None:
        for k in range(0, len(chunks), INDEXED):
            self._indexed(chunks[k : k + INDEXED])

    def _indexed(self, chunks: list[str]) -> None:
        """Encodes distinct chunks: index, match, sort, relax."""
        joined = np.frombuffer("\0".join([*chunks, ""]).encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
        size = np.array([len(c) for c in chunks], np.int64)
        begin = np.concatenate([[0], np.cumsum(size + 1)])
        known, at = np.unique(joined, return_inverse=True)
        letters = [chr(x) for x in known]
        alphabet = self.alphabet
        alphabet.update((x, k) for k, x in enumerate([x for x in letters if x in self.single and x not in alphabet], len(alphabet) + 2))
        codes = np.array([alphabet.get(x, 1) for x in letters], np.int64)[at]
        codes[begin[1:] - 1] = 0
        offset = np.arange(len(codes)) - np.repeat(begin[:-1], size + 1)
        start, end, rank = self.matches(codes, alphabet)
        other = np.flatnonzero(codes == 1)
        start, end, rank = np.concatenate([start, other]), np.concatenate([end, other + 1]), np.concatenate([rank, np.full(len(other), self.unknown)])
        until = offset[end - 1] + 1
        order = np.argsort(until, kind="stable")
        start, end, rank, until = start[order], end[order], rank[order], until[order]
        step = np.searchsorted(until, np.arange(1, int(size.max(initial=0)) + 2))
        last, from_ = np.full(len(codes) + 1, -1, np.int64), np.full(len(codes) + 1, -1, np.int64)
        chunk_start = offset[start] == 0
        for lo, hi in zip(step[:-1], step[1:]):
            s, r = start[lo:hi], rank[lo:hi]
            before = np.where(chunk_start[lo:hi], self.unknown, last[s])
            may = np.flatnonzero((before >= 0) & self.made[r])
            may = may[self.fits(before[may], r[may]) | chunk_start[lo:hi][may]]
            last[end[lo:hi][may]], from_[end[lo:hi][may]] = r[may], s[may]
        now, chunk = begin[1:] - 1, np.arange(len(chunks))
        places, tokens, owner = [], [], []
        while len(chunk):
            places.append(from_[now]), tokens.append(last[now]), owner.append(chunk)
            now = from_[now]
            more = now > begin[chunk]
            now, chunk = now[more], chunk[more]
        places, tokens = np.concatenate(places), np.concatenate(tokens)
        order = np.argsort(places)
        places, tokens, owner = places[order], tokens[order], np.concatenate(owner)[order]
        ids = self.id_of[tokens]
        if (lost := np.flatnonzero(tokens == self.unknown)).size:
            spelled = [[self.byte_id[x] for x in chr(joined[places[k]]).encode("utf-8", "replace")] for k in lost]
            times = np.ones(len(ids), np.int64)
            times[lost] = [len(x) for x in spelled]
            ids, owner = np.repeat(ids, times), np.repeat(owner, times)
            ids[ids == -1] = [y for x in spelled for y in x]
        count = np.bincount(owner, minlength=len(chunks))
        self.add(chunks, count, ids)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and how many each text has. A text is a row of chunks, so a long one is cut before one of them."""
        return in_stretches([" " + t.replace(BLANK, " ") if t else "" for t in texts], _BREAK, self._chunked)

    def _chunked(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for texts that begin with a blank, or are empty."""
        if len(self.numbers) > KEPT:
            self.thin(KEPT // 2)
        rows = []
        for t in texts:
            rows.append(_CHUNK.findall(t) if "  " in t or "\0" in t else t.replace(" ", "\0 ").split("\0")[1:])
        pieces = [p for row in rows for p in row]
        ids, total = self.of(pieces, self._learn)
        cut = np.concatenate([[0], np.cumsum([len(row) for row in rows])]).astype(np.int64)
        return ids, total[cut[1:]] - total[cut[:-1]]

    def decode(self, ids: np.ndarray, ptr: np.ndarray) -> list[str]:
        """Texts of ids, each from its place in ptr to the next one's; bytes that are no UTF-8 become U+FFFD."""
        parts = list(map(self.text.__getitem__, ids.tolist()))
        out = [b"".join(parts[a:b]).decode("utf-8", "replace") for a, b in zip(ptr[:-1], ptr[1:])]
        return [t[1:] if t[:1] == " " else t for t in out]


def _bisect(keys: np.ndarray, value: np.ndarray, low: np.ndarray, high: np.ndarray, right: bool) -> np.ndarray:
    """For each value its place in keys[low:high], which is in order: before equal keys, or right of them."""
    low, high = low.copy(), high.copy()
    while (open_ := np.flatnonzero(low < high)).size:
        mid = (low[open_] + high[open_]) >> 1
        after = keys[mid] <= value[open_] if right else keys[mid] < value[open_]
        low[open_[after]], high[open_[~after]] = mid[after] + 1, mid[~after]
    return low


def model(path: str) -> Model:
    """This worker's model of a file."""
    if path not in _loaded:
        _loaded[path] = Model(path)
    return _loaded[path]


def _with_ids(part: pa.RecordBatch, path: str) -> pa.RecordBatch:
    texts = part.column("text").to_pylist()
    ids, size = model(path).encode([t or "" for t in texts])
    ptr = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    missing = pa.array([t is None for t in texts])
    return pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(pa.array(ptr), pa.array(ids, pa.int32()), mask=missing)], [*part.schema.names, "ids"])


def _with_texts(part: pa.RecordBatch, path: str) -> pa.RecordBatch:
    column = part.column("ids")
    flat, sizes = column.flatten().to_numpy(zero_copy_only=False), [0 if x is None else x for x in column.value_lengths().to_pylist()]
    texts = model(path).decode(flat, np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64))
    return pa.RecordBatch.from_arrays([*part.columns, pa.array([t if ok else None for t, ok in zip(texts, column.is_valid().to_pylist())], pa.string())], [*part.schema.names, "decoded"])


def encode(documents: DataFrame, path: str) -> DataFrame:
    """documents with ids array<int>, the pieces of the text.

    Whole texts are read, no row moves. A null text has null ids, an empty text none. Repeated rows get equal ids. A column
    of documents named ids is replaced, all others kept.
    """
    documents = documents.drop("ids")

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in chunks(buffers(batch.column("text"))[1]):
                yield _with_ids(batch.slice(a, b - a), path)

    return documents.mapInArrow(encoded, with_fields(documents.schema, ids="array<int>"))


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """encoded with decoded string, the text of the ids; null for null ids. A column named decoded is replaced."""
    encoded = encoded.drop("decoded")

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, len(batch), 512):
                yield _with_texts(batch.slice(a, 512), path)

    return encoded.mapInArrow(back, with_fields(encoded.schema, decoded="string"))


def round_trip(documents: DataFrame, path: str) -> DataFrame:
    """What decode makes of what encode makes, in one pass: one worker a task holds the model, not two."""
    documents = documents.drop("ids", "decoded")

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in chunks(buffers(batch.column("text"))[1]):
                yield _with_texts(_with_ids(batch.slice(a, b - a), path), path)

    return documents.mapInArrow(lambda batches: trimmed(both(batches)), with_fields(documents.schema, ids="array<int>", decoded="string"))
