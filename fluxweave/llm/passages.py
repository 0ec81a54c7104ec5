"""Passage encoder: byte-trigram bags and surface measures of every passage of every text."""

from __future__ import annotations

import numpy as np

#: Bytes in a passage, buckets of hashed trigrams, and surface measures after them.
PASSAGE_BYTES, BUCKETS = 1024, 96
_KINDS = {"upper": (65, 90), "lower": (97, 122), "digit": (48, 57), "high": (128, 255)}
N_SURFACE = 12
DIM = BUCKETS + N_SURFACE


def encode(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One row of DIM measures for each passage, and each text's first passage; an empty text has one passage of zeros."""
    base = int(offsets[0])
    raw = data[base : int(offsets[-1])]
    rows = (offsets - base).astype(np.int64)
    sizes = np.diff(rows)
    per_text = np.maximum(1, -(-sizes // PASSAGE_BYTES))
    ptr = np.concatenate([[0], np.cumsum(per_text)])
    n = int(ptr[-1])
    out = np.zeros((n, DIM), np.float32)
    if not len(raw):
        return out, ptr
    within = np.arange(len(raw), dtype=np.int64) - np.repeat(rows[:-1], sizes)
    passage = np.repeat(ptr[:-1], sizes) + within // PASSAGE_BYTES
    length = np.bincount(passage, minlength=n).astype(np.float32)
    scale = 1.0 / np.maximum(length, 1)
    code = raw.astype(np.uint32)
    if len(raw) > 2:
        tri = (code[:-2] * np.uint32(0x9E3779B1)) ^ (code[1:-1] * np.uint32(0x85EBCA77)) ^ (code[2:] * np.uint32(0xC2B2AE3D))
        tri = (tri ^ (tri >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        bucket = (tri >> np.uint32(8)) % np.uint32(BUCKETS)
        same = passage[:-2] == passage[2:]
        bag = np.bincount((passage[:-2] * BUCKETS + bucket)[same], minlength=n * BUCKETS).reshape(n, BUCKETS)
        out[:, :BUCKETS] = np.sqrt(bag * scale[:, None])
    s = BUCKETS
    for low, high in _KINDS.values():
        out[:, s] = np.bincount(passage, (raw >= low) & (raw <= high), n) * scale
        s += 1
    space = (raw == 32) | ((raw >= 9) & (raw <= 13))
    starts = ~space
    starts[1:] &= space[:-1]
    at = np.flatnonzero(starts)
    n_words = np.bincount(passage[at], minlength=n).astype(np.float32)
    out[:, s] = np.bincount(passage, space, n) * scale
    out[:, s + 1] = np.bincount(passage, raw == 10, n) * scale * 10
    out[:, s + 2] = 1 - out[:, BUCKETS : BUCKETS + 4].sum(1) - out[:, s]  # other signs
    out[:, s + 3] = n_words * scale
    if len(at) > 1:  # a word much like the one before it
        total = np.zeros(len(raw) + 1, np.int64)
        np.cumsum(code.astype(np.int64) ** 2, out=total[1:])
        sums = np.diff(np.append(total[at], total[-1]))
        again = np.zeros(len(at), bool)
        again[1:] = sums[1:] == sums[:-1]
        out[:, s + 4] = np.bincount(passage[at], again, n) / np.maximum(n_words, 1)
        pairs = np.unique(passage[at] * (1 << 24) + (sums * 2654435761 >> 7) % (1 << 24)) >> 24
        out[:, s + 5] = np.bincount(pairs, minlength=n) / np.maximum(n_words, 1)
    run = np.zeros(len(raw), bool)
    run[1:] = (raw[1:] == raw[:-1]) & ~space[1:]
    out[:, s + 6] = np.bincount(passage, run, n) * scale * 4
    out[:, s + 7] = np.log1p(length) / 8
    return out, ptr
