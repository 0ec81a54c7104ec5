"""Collocations, periodic runs and packing against brute force, with odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from fluxweave.llm import collocations, packing, queries, runs

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ODD = [(None, "a text without an id"), (1, None), (2, ""), (3, "  \n\t "), (4, "Straße ÉTÉ 日本 x1"), (5, "w " * 3000), (6, "same text here"), (6, "same text here"), (8, "x" * 5000)]


def plain_runs(w):
    found = {}
    for p in range(1, len(w) // 2 + 1):
        i = 0
        while i < len(w) - p:
            j = i
            while j < len(w) - p and w[j] == w[j + p]:
                j += 1
            if j + p - i >= max(12, 2 * p):
                found.setdefault((i, j + p), p)
            i = j + 1
    return [(s, e - s, p) for (s, e), p in sorted(found.items())]


def test_runs_of_small_alphabets():
    r = random.Random(2)
    for _ in range(150):
        rows = [[r.randrange(v) for _ in range(r.randrange(0, 90))] for v in (1, 2, 3, 40, 2)]
        ptr = np.concatenate([[0], np.cumsum([len(x) for x in rows])])
        want = [(s + ptr[k], s + ptr[k] + n, p) for k, x in enumerate(rows) for s, n, p in plain_runs(x)]
        assert [tuple(x) for x in runs.runs_of(np.array(sum(rows, []), np.int64), ptr).tolist()] == want


def test_minima():
    r = np.random.default_rng(3)
    x = r.integers(0, 1000, 500)
    found = runs.Minima(x)
    a = r.integers(0, 500, 4000)
    b = r.integers(0, 500, 4000)
    lo, hi = np.minimum(a, b), np.maximum(a, b)
    assert found.of(lo, hi).tolist() == [x[i : j + 1].min() for i, j in zip(lo, hi)]


def test_op12_rows(spark, tmp_path):
    r = random.Random(5)
    rows = [(i, " ".join(r.choice(["a", "Bb", "é", "d,"][: 1 + i % 4]) + r.choice(["", "\n", "\t "]) for _ in range(r.randrange(0, 150)))) for i in range(10, 130)] + ODD
    spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS runs", "1 AS collapsed").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(map(tuple, queries.op12_runs(spark, str(tmp_path)).collect()), key=repr)
    want = []
    for i, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        h, n = zlib.crc32(str(i).encode()) if i is not None else 1, len(w)
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
        found = plain_runs(w)
        gone = {k for s, n, p in found for k in range(s + p, s + n)}
        best = min(found, key=lambda x: (-x[1], x[0], x[2])) if found else None
        hashes = [hashlib.sha256(x.encode()).hexdigest() for x in ("".join("%d,%d,%d\n" % x for x in found), " ".join(x for k, x in enumerate(w) if k not in gone))]
        want.append((i, len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, *hashes))
    assert got == sorted(want, key=repr) and sum(x[1] for x in want) > 20
    assert runs.find(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_automaton_counts_every_phrase():
    r = random.Random(4)
    for _ in range(40):
        rows = [[r.randrange(3) for _ in range(r.randrange(1, 25))] for _ in range(4)]
        flat, fresh = sum(rows, []), [k == 0 for x in rows for k in range(len(x))]
        link, length, end, count = collocations.automaton(flat, fresh)
        want = Counter(tuple(x[i : i + k]) for x in rows for k in range(1, 26) for i in range(len(x) - k + 1))
        got = {tuple(flat[end[v] - k + 1 : end[v] + 1]): count[v] for v in range(1, len(link)) for k in range(length[link[v]] + 1, length[v] + 1)}
        assert got == want


def plain_phrases(rows, least, top):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(UPPER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, 5) for i in range(len(w) - k + 1))
    some = {x: a for x, a in f.items() if len(x[1]) > 1 and a >= least}
    out = []
    for (lang, w), a in some.items():
        if any(g == lang and len(v) > len(w) and 100 * b >= 80 * a and any(v[i : i + len(w)] == w for i in range(len(v))) for (g, v), b in some.items()):
            continue
        score, _, l, r = min((2000000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
        out.append((lang, -score, -a, " ".join(w).encode(), l, r))
    ranked = [(lang, sum(x[0] == lang and x < y for x in out) + 1, p.decode(), -a, l, r, n[lang], -s) for y in out for lang, s, a, p, l, r in [y]]
    return sorted(x for x in ranked if x[1] <= top)


@pytest.mark.parametrize("top", [5, 2000])
def test_collocations(spark, top):
    r = random.Random(6)
    rows = []
    for _ in range(120):
        words = [r.choice(["Of", "the", "a", "été", "big cat", "New  York\tCity", "b."]) if r.random() < 0.8 else f"w{r.randrange(300)}" for _ in range(r.randrange(0, 60))]
        rows.append((r.choice(["en", "fr", None, "und"]), " ".join(words)))
    rows += [("en", None), ("de", ""), ("fr", " . ; \n"), ("en", "la la la la " * 50)]
    made = spark.createDataFrame(rows, "lang string, text string").selectExpr("*", "1 AS phrase", "2 AS n")
    got = sorted(map(tuple, collocations.mine(made, least=8, top=top).collect()))
    assert got == plain_phrases(rows, 8, top) and len(got) >= 15
    assert collocations.mine(made.limit(0)).count() == 0


@pytest.mark.parametrize("length", [7, 1024])
def test_packing(spark, length):
    r = random.Random(7)
    rows = [(i, " ".join(f"w{r.randrange(5000)}" for _ in range(r.randrange(0, 120)))) for i in range(20, 140)] + ODD
    made = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS ids", "2 AS length").repartition(6)
    path = public_tokenizers.path("byte_bpe_50k.json")
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path)
    want = sorted(((i, tuple([*whole.encode(t or "", add_special_tokens=False).ids, 0])) for i, t in rows), key=repr)
    got = {x.sequence_id: x for x in packing.pack(made, path, length).collect()}
    n = sum(len(ids) for _, ids in want)
    assert sorted(got) == list(range(-(-n // length))) and all(len(x.ids) == x.length == length for k, x in got.items() if k < len(got) - 1)
    assert sum(x.length for x in got.values()) == n
    back, open_ = [], None
    for k in sorted(got):
        at = 0
        for p in got[k].pieces:
            part = got[k].ids[at : at + p.length]
            assert p.offset == at and zlib.crc32(np.array(part, "<u4").tobytes()) == p.ids_crc32
            at += p.length
            open_ = (open_ or []) + part if p.start else part
            assert len(open_) == p.start + p.length
            if len(open_) == p.doc_tokens:
                back.append((p.doc_id, tuple(open_)))
        assert at == got[k].length
    assert sorted(back, key=repr) == want
    assert packing.pack(made.limit(0), path).count() == 0
