"""Range coder for token ids: predictions of order 2, 1 and 0 mixed by adaptive counts, in blocks that are reset and checked by themselves.

The blocks of one call are coded in step, one numpy lane each, in numbers that stand for the ids that occur. For every id a decision is coded first: it is
what followed its last two ids before in the block, or its last one, or what follows its last one most often in all blocks of the call, or none of
these. The decision's frequencies mix two adaptive counts: by the predictions' confidences, and by the last decisions.
Any other id is coded by its frequency in all blocks of the call. These frequencies and followers stand once before
the blocks, and every block starts from them alone.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Sequence

import numpy as np

#: Ids in a block; slots of the context tables.
BLOCK, SLOTS = 2048, 2048
#: What a seen decision's count grows by, and the sum from which counts are halved.
GROW, LIMIT = 24, 1 << 12
_MAGIC = b"FWR3"
_HEAD = struct.Struct("<4sIQIII")  # magic, blocks, ids, ids that occur, bytes of the prior; crc32 of all that and the prior


_U = np.uint64
_SHIFT, _LOW, _LEAST = _U(16), _U(0xFFFFFFFF), _U(1 << 32)


#: Four counts of 16 bits in a word: one in each; what sums them up from the lowest on; all but their top bits.
_ONES, _PREFIX, _HALVES = _U(0x0001000100010001), _U(0x0001000100010001), _U(0x7FFF7FFF7FFF7FFF)
_FIELD, _TOP = _U(0xFFFF), _U(48)
_STEP = np.array([GROW << (16 * d) for d in range(4)], np.uint64)


#: Counts of the decisions at a block's start, by row: more for a prediction that was right before, most for none of them.
_START = np.array([sum((1 + n) << (16 * d) for d, n in enumerate((5 * k2 * k2, 0 if same else 3 * k1, 4 * sure * sure, 20))) for k2 in range(4) for k1 in range(4) for sure in range(4) for same in range(2)], np.uint64)


class _Prior:
    """What stands before the blocks: the ids that occur, ascending, the frequency of each in a sum of 2^bits, its most frequent
    follower (as a number) and, in two bits, how often it is that one."""

    def __init__(self, ids: np.ndarray, freq: np.ndarray, follower: np.ndarray, sure: np.ndarray):
        self.ids, self.freq, self.follower, self.sure = ids, freq.astype(np.uint64), follower, sure.astype(np.int64) * 2
        self.start = np.cumsum(self.freq) - self.freq
        self.bits = max(16, int(len(ids) - 1).bit_length() + 4) if len(ids) else 16

    @classmethod
    def of(cls, ids: np.ndarray) -> tuple[_Prior, np.ndarray]:
        """The prior of these ids, and the number of each."""
        if len(ids) and ids.max() < 1 << 22:
            counts = np.bincount(ids)
            found = np.flatnonzero(counts)
            x, counts = (np.cumsum(counts > 0) - 1).take(ids), counts[found]
        else:
            found, x, counts = np.unique(ids, return_inverse=True, return_counts=True)
        d, bits = len(found), max(16, int(len(found) - 1).bit_length() + 4)
        freq = 1 + counts * ((1 << bits) - d) // max(len(ids), 1)
        if d:
            freq[counts.argmax()] += (1 << bits) - freq.sum()
        pair = np.sort(x[:-1].astype(np.int32 if d < 1 << 15 else np.int64) * d + x[1:]) if d else np.zeros(0, np.int64)
        at = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]])) if len(pair) else np.zeros(0, np.int64)
        times, pair = np.diff(np.append(at, len(pair))), pair[at]
        order = np.argsort(times, kind="stable")
        follower, most = np.zeros(d, np.int32), np.zeros(d, np.int64)
        follower[pair[order] // d if d else order], most[pair[order] // d if d else order] = pair[order] % max(d, 1), times[order]  # the last one stays
        return cls(found, freq, follower, np.searchsorted([0.1, 0.25, 0.5], most / counts, "right")), x.astype(np.int32)

    def packed(self) -> bytes:
        gaps = np.diff(self.ids, prepend=0)
        return zlib.compress(b"".join(v.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes() for v in (gaps, self.freq, self.follower)) + (self.sure // 2).astype(np.uint8).tobytes())

    @classmethod
    def unpacked(cls, data: bytes, d: int) -> _Prior:
        raw = np.frombuffer(zlib.decompress(data), np.uint8)
        if len(raw) != 13 * d:
            raise ValueError("cut short")
        gaps, freq, follower = (np.ascontiguousarray(raw[4 * d * k : 4 * d * (k + 1)].reshape(4, d).T).view("<u4").reshape(-1).astype(np.int64) for k in range(3))
        return cls(np.cumsum(gaps), freq, follower.astype(np.int32), raw[12 * d :])


class _Lanes:
    """The models of all blocks, which coder and decoder keep alike. A prediction is an id and, in two bits, a confidence."""

    def __init__(self, n: int, prior: _Prior):
        self.n, self.lane = n, np.arange(n)
        self.at_slot, self.at_row, self.at_past = self.lane * SLOTS, self.lane * 128, self.lane * 16
        self.p1, self.p2 = np.zeros(n * SLOTS, np.int32), np.zeros(n * SLOTS, np.int32)
        self.follower, self.sure = prior.follower, prior.sure
        self.by_confidence, self.by_past = np.tile(_START, n), np.full(n * 16, _ONES)
        self.last1, self.last2, self.past = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)

    def predict(self) -> None:
        one = self.last1 * 0x9E3B
        self.i1 = self.at_slot + ((one >> 3) & (SLOTS - 1))
        self.i2 = self.at_slot + (((one ^ (self.last2 * 0x1F35B)) >> 3) & (SLOTS - 1))
        g1, g2 = self.p1.take(self.i1), self.p2.take(self.i2)
        self.e1, self.e2, self.k1, self.k2 = g1 >> 2, g2 >> 2, g1 & 3, g2 & 3
        self.e0 = self.follower.take(self.last1)
        self.row = self.at_row + (self.k2 * 32 + self.k1 * 8 + self.sure.take(self.last1) + (self.e1 == self.e2))
        self.past_row = self.at_past + self.past
        self.a, self.b = self.by_confidence.take(self.row), self.by_past.take(self.past_row)
        self.freq = self.a + self.b
        self.cum = self.freq * _PREFIX
        self.total = self.cum >> _TOP

    def of(self, decision: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and frequency of each block's decision."""
        by = (decision << 4).astype(np.uint64)
        freq = (self.freq >> by) & _FIELD
        return ((self.cum >> by) & _FIELD) - freq, freq

    def update(self, ids: np.ndarray, decision: np.ndarray) -> None:
        step = _STEP.take(decision)
        a, b = self.a + step, self.b + step
        if (full := np.flatnonzero(self.total > LIMIT)).size:
            a[full], b[full] = ((a[full] >> _U(1)) & _HALVES) + (a[full] & _ONES), ((b[full] >> _U(1)) & _HALVES) + (b[full] & _ONES)
        self.by_confidence[self.row], self.by_past[self.past_row] = a, b
        for p, i, e, k in ((self.p1, self.i1, self.e1, self.k1), (self.p2, self.i2, self.e2, self.k2)):
            hit = e == ids
            p[i] = np.where(hit | (k > 1), e, ids) * 4 + np.where(hit, np.minimum(k + 1, 3), np.maximum(k - 1, 0))
        self.last2, self.last1 = self.last1, ids.astype(np.int64)
        self.past = (self.past * 4 + decision) & 15


def encode(ids: np.ndarray) -> bytes:
    """A file part: head and prior, then for each block its number of 16-bit words and the crc32 of its ids, then the words."""
    n = len(ids)
    blocks = -(-n // BLOCK)
    if n and (ids.min() < 0 or ids.max() >= 1 << 32):
        raise ValueError("ids must be of 32 bits and not negative")
    crc = np.array([zlib.crc32(ids[k : k + BLOCK].astype("<u4").tobytes()) for k in range(0, n, BLOCK)], np.uint32)
    prior, numbers = _Prior.of(ids)
    x = np.zeros(blocks * BLOCK, np.int32)
    x[:n] = numbers
    x = np.ascontiguousarray(x.reshape(blocks, BLOCK).T)
    model = _Lanes(blocks, prior)
    bits = _U(prior.bits)
    low, size = np.zeros(blocks, np.uint64), np.full(blocks, 1 << 48, np.uint64)
    out, count = np.zeros((blocks, 2 * BLOCK + 4), np.uint32), np.zeros(blocks, np.int64)

    def renew() -> None:
        if (full := np.flatnonzero(size < _LEAST)).size:
            v = low[full]
            out[full, count[full]] = (v >> _U(32)).astype(np.uint32)
            count[full] += 1
            low[full] = (v & _LOW) << _SHIFT
            size[full] <<= _SHIFT

    for t in range(BLOCK if blocks else 0):
        now = x[t]
        model.predict()
        decision = np.where(now == model.e2, 0, np.where(now == model.e1, 1, 3 - (now == model.e0)))
        start, freq = model.of(decision)
        unit = size // model.total
        low += start * unit
        size = freq * unit
        renew()
        if (more := np.flatnonzero(decision > 2)).size:
            number = now[more]
            unit = size[more] >> bits
            low[more] += prior.start.take(number) * unit
            size[more] = prior.freq.take(number) * unit
            renew()
        model.update(now, decision)
    for _ in range(3 if blocks else 0):
        out[model.lane, count] = (low >> _U(32)).astype(np.uint32)
        count += 1
        low = (low & _LOW) << _SHIFT
    for j in range(out.shape[1] - 1, 0, -1):  # carries
        out[:, j - 1] += out[:, j] >> 16
    words = (out & 0xFFFF).astype("<u2")
    body = words[np.arange(words.shape[1]) < count[:, None]]
    table = prior.packed()
    head = (_MAGIC, blocks, n, len(prior.ids), len(table))
    return _HEAD.pack(*head, zlib.crc32(table, zlib.crc32(_HEAD.pack(*head, 0)))) + table + count.astype("<u4").tobytes() + crc.astype("<u4").tobytes() + body.tobytes()


def decode(data: bytes, blocks: Sequence[int] | None = None) -> np.ndarray:
    """The ids, or those of the blocks named by their numbers, each decoded by itself; ValueError where head, prior or one of these blocks does not match its checksum."""
    if len(data) < _HEAD.size:
        raise ValueError("cut short")
    *head, sum_ = _HEAD.unpack_from(data)
    magic, every, n, d, table = head
    if magic != _MAGIC:
        raise ValueError("not a part of this format")
    first = _HEAD.size + table
    if zlib.crc32(data[_HEAD.size : first], zlib.crc32(_HEAD.pack(*head, 0))) != sum_:
        raise ValueError("the head is damaged")
    prior = _Prior.unpacked(data[_HEAD.size : first], d)
    bits, top = _U(prior.bits), (1 << prior.bits) - 1
    number_at = np.repeat(np.arange(d, dtype=np.int32), prior.freq.astype(np.int64)) if prior.bits <= 20 else None
    count = np.frombuffer(data, "<u4", every, first).astype(np.int64)
    crc = np.frombuffer(data, "<u4", every, first + 4 * every)
    words = np.concatenate([np.frombuffer(data, "<u2", -1, first + 8 * every), np.zeros(4, "<u2")]).astype(np.uint64)
    if len(words) != count.sum() + 4:
        raise ValueError("cut short")
    wanted = np.arange(every) if blocks is None else np.asarray(blocks, np.int64)
    at = (np.cumsum(count) - count)[wanted]
    blocks = len(wanted)
    model = _Lanes(blocks, prior)
    code, size = np.zeros(blocks, np.uint64), np.full(blocks, 1 << 48, np.uint64)
    for _ in range(3 if blocks else 0):
        code = (code << _SHIFT) | words[at]
        at += 1
    x = np.zeros((BLOCK, blocks), np.int32)

    def renew() -> None:
        if (full := np.flatnonzero(size < _LEAST)).size:
            code[full] = (code[full] << _SHIFT) | words[np.minimum(at[full], len(words) - 1)]
            at[full] += 1
            size[full] <<= _SHIFT

    for t in range(BLOCK if blocks else 0):
        model.predict()
        unit = size // model.total
        value = np.minimum(code // unit, model.total - _U(1))
        decision = (value >= (model.cum & _FIELD)).astype(np.int64) + (value >= ((model.cum >> _SHIFT) & _FIELD)) + (value >= ((model.cum >> _U(32)) & _FIELD))
        start, freq = model.of(decision)
        code -= start * unit
        size = freq * unit
        renew()
        now = np.where(decision == 0, model.e2, np.where(decision == 1, model.e1, model.e0))
        if (more := np.flatnonzero(decision > 2)).size:
            unit = size[more] >> bits
            value = np.minimum((code[more] // unit).astype(np.int64), top)  # a damaged block must not lead out of the tables
            number = number_at.take(value) if number_at is not None else (np.searchsorted(prior.start, value, "right") - 1).astype(np.int32)
            code[more] -= prior.start.take(number) * unit
            size[more] = prior.freq.take(number) * unit
            renew()
            now[more] = number
        x[t] = now
        model.update(now, decision)
    size = np.minimum(n - wanted * BLOCK, BLOCK)
    ids = prior.ids.take(np.ascontiguousarray(x.T)[np.arange(BLOCK) < size[:, None]]) if blocks else np.zeros(0, np.int64)
    ends = np.cumsum(size)
    for k, a, b in zip(wanted.tolist(), (ends - size).tolist(), ends.tolist()):
        if zlib.crc32(ids[a:b].astype("<u4").tobytes()) != crc[k]:
            raise ValueError(f"block {k} is damaged")
    return ids
