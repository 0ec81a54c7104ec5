import random

import numpy as np
from pyspark.sql import functions as F

from fluxweave.llm import graph, neighbours


def test_search(spark):
    r = np.random.default_rng(3)
    x = r.standard_normal((1500, 16)).astype(np.float32)
    x[100:140] = x[100]  # equal vectors
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1500, None), (1520, [0.0] * 16), (1540, [float("nan")] * 16), (None, [1.0] * 16), (1560, []), (1580, [None] + [1.0] * 15)]
    got = {}
    for a in neighbours.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS id")).collect():
        got.setdefault(a.query_id, {})[a["rank"]] = (a.vec_id, a.score)
    assert set(got) == set(range(0, 1500, 20))
    d, right = x.astype(np.float64), 0
    for q, found in got.items():
        score = d @ d[q]
        best = sorted((-s, i) for i, s in enumerate(score) if i != q)[:20]
        assert sorted(found) == list(range(1, 21)) and all(abs(score[i] - s) < 1e-9 for i, s in found.values())
        assert [(-s, i) for i, s in found.values()] == sorted((-s, i) for i, s in found.values()) and q not in {i for i, _ in found.values()}
        right += len({i for _, i in best} & {i for i, _ in found.values()})
    assert right >= 0.95 * 20 * len(got)


def test_few_vectors(spark):
    some = spark.createDataFrame([(0, [1.0, 0.0]), (20, [0.0, 2.0]), (3, [1.0, 1.0])], "vec_id long, embedding array<float>")
    got = [(x.query_id, x["rank"], x.vec_id, x.score) for x in neighbours.search(some).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 3, 1.0), (0, 2, 20, 0.0), (20, 1, 3, 2.0), (20, 2, 0, 0.0)]
    assert neighbours.search(some.limit(0)).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(40, 90)] + [(7, 3), (3, 1), (5, 5), (200, 90)]
    got = {x.id: x.component for x in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys([*range(40, 91), 200], 40), 1: 1, 3: 1, 7: 1}


def test_loose_copies_meet_few_times(spark, monkeypatch):
    """Copies of a text that are loosely like each other (0.75 or so) and linked here and there: few pairs of them are looked at, and no link between components is lost."""
    r, n, met, saved = random.Random(4), 160, [], graph.saved

    def counted(df, name="table"):
        out = saved(df, name)
        met.extend([out.count()] if name in ("neighbours", "pairs") else [])
        return out

    monkeypatch.setattr(graph, "saved", counted)
    text, draw = [r.getrandbits(62) for _ in range(200)], lambda k: [r.getrandbits(62) for _ in range(k)]
    sets = [text] + [[e for e in text if r.random() > 0.13] + draw(8) for _ in range(n)]
    sets += [x[:-3] + draw(3) for x in sets[1 : n // 2]]  # each linked to one of them alone
    content = saved(spark.createDataFrame([(k, x, [0]) for k, x in enumerate(sets)], "rep long, content array<long>, sketch array<long>"))
    buckets = saved(spark.createDataFrame([(1, k, True) for k in range(len(sets))], "key long, rep long, large boolean"))
    links = graph.linked(buckets, content, lambda c: c, 80, lambda x, y, p: F.lit(True)).collect()
    own = [set(x) for x in sets]
    alike = [(a, b) for b in range(len(sets)) for a in range(b) if 100 * len(own[a] & own[b]) >= 80 * len(own[a] | own[b])]
    assert {(min(x), max(x)) for x in links} <= set(alike) and len(alike) < len(sets) ** 2 // 8
    root = list(range(len(sets)))
    for edges, check in ((links, False), (alike, True)):
        for a, b in edges:
            while root[a] != a:
                a = root[a]
            while root[b] != b:
                b = root[b]
            assert a == b or not check
            root[a] = b
    assert sum(met[1:]) < 6 * len(sets)  # the first are members and leaders


def test_small_buckets_meet_pair_by_pair(spark, monkeypatch):
    """Of buckets with few members no table of differences is made, whose rows are many times the members; the components are those of larger buckets' way."""
    r, made, saved = random.Random(5), [], graph.saved

    def counted(df, name="table"):
        out = saved(df, name)
        made.extend([out.count()] if name == "differences" else [])
        return out

    monkeypatch.setattr(graph, "saved", counted)
    draw = lambda k: [r.getrandbits(62) for _ in range(k)]
    text = draw(100)
    sets = [text] + [[e for e in text if r.random() > 0.13] + draw(4) for _ in range(30)]
    sets += [x[:-2] + draw(2) for x in sets[1:16]]
    content = saved(spark.createDataFrame([(k, x, [0]) for k, x in enumerate(sets)], "rep long, content array<long>, sketch array<long>"))
    buckets = saved(spark.createDataFrame([(key, k, True) for key in (1, 2) for k in range(len(sets)) if key == 1 or k % 2], "key long, rep long, large boolean"))

    def found() -> dict:
        return {x.id: x.component for x in graph.components(graph.linked(buckets, content, lambda c: c, 80, lambda x, y, p: F.lit(True))).collect()}

    small = found()
    assert len(set(small.values())) > 1 and not sum(made)
    monkeypatch.setattr(graph, "SMALL", 2)
    assert found() == small and sum(made) > 4 * len(sets)
