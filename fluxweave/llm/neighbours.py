"""Approximate nearest neighbours: NN-descent builds a neighbour graph by iterated joins, queries search it greedily."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import saved, sized

#: Neighbours of a node in the graph, and members of a node's local join.
DEGREE, MEMBERS = 32, 56
#: Best candidates that a local join reports to each of its members.
REPORTED = 10
#: First graph: random hyperplane tables and aimed-at rows of a bucket; a larger bucket is dealt out into several.
TABLES, BUCKET = 8, 320
#: NN-descent goes on until a round renews less than this share of the graph's links, however many rounds that takes.
SETTLED = 0.02
#: Nodes that a round of a search expands for each query, and candidates that a query keeps. A query's search ends when its CERTAIN best are expanded.
EXPANDED, BEAM, CERTAIN = 24, 160, 96


def _matrix(column: pa.Array, dtype: str) -> np.ndarray:
    """Rows of equally long binaries as a matrix of doubles or floats."""
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), dtype).reshape(len(rows), -1) if rows else np.zeros((0, 1), dtype)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """vec_id, and the vector as 64-bit floats in a binary; without those that take no part."""
    for batch in batches:
        ids, out = [], []
        for i, x in zip(batch.column("vec_id").to_pylist(), batch.column("embedding").to_pylist()):
            if i is None or not x or any(v is None for v in x):
                continue
            v = np.array(x, np.float64)
            if np.isfinite(v).all() and v.any():
                ids.append(i)
                out.append((v + 0.0).tobytes())
        yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(out, pa.binary())], ["vec_id", "vec"])


def _hashed(bits: int, seed: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            by_size: dict[int, list[int]] = {}
            vecs = batch.column("vec").to_pylist()
            for k, v in enumerate(vecs):
                by_size.setdefault(len(v) // 8, []).append(k)
            for dim, rows in by_size.items():
                x = np.frombuffer(b"".join(vecs[k] for k in rows), np.float64).reshape(-1, dim)
                planes = np.random.default_rng(seed + dim).standard_normal((dim, TABLES * max(bits, 1)))
                sign = ((x @ planes) > 0).reshape(len(rows), TABLES, -1)[:, :, :bits]
                code = (sign * (1 << np.arange(bits))).sum(2) if bits else np.zeros((len(rows), TABLES), np.int64)
                keys = code * TABLES + np.arange(TABLES) + (dim << 40)
                small = x.astype(np.float32)
                yield pa.record_batch([batch.column("vec_id").take(pa.array(rows)), pa.array([s.tobytes() for s in small], pa.binary()), pa.array(list(keys.astype(np.int64)), pa.list_(pa.int64()))], ["id", "vec", "keys"])

    return of


def _best(x: np.ndarray, ids: np.ndarray, least: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row of x its n best others of a score over least: row, other's id and score."""
    score = x @ x.T
    np.fill_diagonal(score, -np.inf)
    n = min(n, len(ids) - 1)
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)
    top = np.argpartition(-score, n - 1, axis=1)[:, :n]
    found = np.take_along_axis(score, top, 1)
    row, col = np.nonzero(found > least[:, None])
    return row, ids[top[row, col]], found[row, col]


def _joined(members: str, reported: int):
    """Local joins: each row has the members of one group, which are scored among themselves."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(members)
            ptr, flat = column.offsets.to_numpy(), column.values
            ids, least = flat.field("id").to_numpy(), flat.field("least").to_numpy().astype(np.float32)
            vec = flat.field("vec")
            for lo in range(0, len(batch), 64):
                out: list[list[np.ndarray]] = [[], [], []]
                for k in range(lo, min(lo + 64, len(batch))):
                    a, b = ptr[k], ptr[k + 1]
                    if b - a < 2:
                        continue
                    rows = vec.slice(a, b - a).to_pylist()
                    if len({len(v) for v in rows}) > 1:
                        continue
                    x = np.frombuffer(b"".join(rows), np.float32).reshape(b - a, -1)
                    row, other, score = _best(x, ids[a:b], least[a:b], reported)
                    for o, v in zip(out, (ids[a:b][row], other, score)):
                        o.append(v)
                if out[0]:
                    yield pa.record_batch([pa.array(np.concatenate(out[0])), pa.array(np.concatenate(out[1])), pa.array(np.concatenate(out[2]).astype(np.float32))], ["id", "other", "score"])

    return of


def _kept(rows: DataFrame, n: int) -> DataFrame:
    """id and near: its n best (score, other), best first. Ties go to the smaller id."""
    order = F.struct((-F.col("score")).alias("away"), "other")
    return rows.groupBy("id").agg(F.slice(F.sort_array(F.collect_set(order)), 1, n).alias("near"))


def _edges(graph: DataFrame) -> DataFrame:
    return graph.select("id", F.explode("near").alias("e")).select("id", F.col("e.other").alias("other"), (-F.col("e.away")).alias("score"))


def _limited(edges: DataFrame, n: int, salt: int) -> DataFrame:
    """n links of each id at most, drawn by a hash; what is over is cut before the shuffle already."""
    return edges.withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy(F.xxhash64("id", "other", F.lit(salt)), "other"))).where(F.col("r") <= n).drop("r")


def graph(vectors: DataFrame) -> DataFrame:
    """id and near (array of struct<away float, other long>): the neighbour graph of id, vec (32-bit floats), keys."""
    points = vectors.select("id", "vec")
    lowest = F.lit(float("-inf")).cast("float")
    member = F.struct("id", "vec", F.lit(float("-inf")).cast("float").alias("least"))
    keyed = vectors.select("id", "vec", F.explode("keys").alias("key"))
    sizes = sized(saved(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")), "sizes"), 16)
    dealt = keyed.join(sizes, "key").withColumn("block", F.pmod(F.xxhash64("id", "key"), F.ceil(F.col("n") / (2 * BUCKET))))
    first = dealt.groupBy("key", "block").agg(F.collect_list(member).alias("members"))
    rows = first.select("members").mapInArrow(_joined("members", REPORTED), "id long, other long, score float")
    now = saved(_kept(rows, DEGREE), "graph")
    renewed, round_ = 1.0, 0
    while renewed >= SETTLED:
        edges = _edges(now)
        both = edges.select("id", "other").union(edges.select(F.col("other").alias("id"), F.col("id").alias("other"))).distinct()
        members = _limited(both, MEMBERS, round_)
        worst = now.select(F.col("id").alias("other"), F.when(F.size("near") < DEGREE, lowest).otherwise(-F.element_at("near", -1)["away"]).alias("least"))
        info = points.withColumnRenamed("id", "other").join(worst, "other", "left").select("other", "vec", F.coalesce("least", lowest).alias("least"))
        met = members.join(info, "other").groupBy("id").agg(F.collect_list(F.struct(F.col("other").alias("id"), "vec", "least")).alias("members"))
        found = met.select("members").mapInArrow(_joined("members", REPORTED), "id long, other long, score float")
        before, now = now, saved(_kept(found.union(edges.select("id", "other", "score")), DEGREE), "graph")
        renewed, round_ = _renewed(before, now), round_ + 1
    return now


def _renewed(before: DataFrame, now: DataFrame) -> float:
    """The share of the links of a graph that an earlier one of the same nodes does not have. Links only get better, so it falls to 0."""
    both = now.join(before.select("id", F.col("near").alias("was")), "id", "left").select(F.transform("near", lambda e: e.other).alias("near"), F.transform("was", lambda e: e.other).alias("was"))
    new, all_ = both.agg(F.sum(F.size(F.array_except("near", F.coalesce("was", F.array().cast("array<long>"))))), F.sum(F.size("near"))).head()
    return (new or 0) / max(all_ or 0, 1)


def _scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, len(batch), 4096):
            part = batch.slice(lo, 4096)
            a, b = part.column("a").to_pylist(), part.column("b").to_pylist()
            score = np.full(len(part), -np.inf)
            same = [k for k in range(len(part)) if len(a[k]) == len(b[k])]
            if same:
                dim = {len(a[k]) for k in same}
                for d in dim:
                    rows = [k for k in same if len(a[k]) == d]
                    x, y = (np.frombuffer(b"".join(v[k] for k in rows), np.float64).reshape(len(rows), -1) for v in (a, b))
                    score[rows] = np.einsum("ij,ij->i", x, y)
            yield pa.record_batch([part.column("query"), part.column("other"), pa.array(score)], ["query", "other", "score"])


def _dots(pairs: DataFrame, queries: DataFrame, points: DataFrame) -> DataFrame:
    """Scores of query, other in double precision."""
    rows = pairs.join(points.select(F.col("id").alias("other"), F.col("vec").alias("b")), "other").join(queries.select(F.col("id").alias("query"), F.col("vec").alias("a")), "query")
    return rows.select("query", "other", "a", "b").mapInArrow(_scored, "query long, other long, score double").where("score > double('-inf')")


def _beam(rows: DataFrame) -> DataFrame:
    """query and beam: its best (away, other, done), best first."""
    best = rows.groupBy("query", "other").agg(F.max("score").alias("score"), F.max("done").alias("done"))
    return best.groupBy("query").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("away"), "other", "done"))), 1, BEAM).alias("beam"))


def search(embeddings: DataFrame, every: int = 20, k: int = 20) -> DataFrame:
    """query_id, rank int (from 1), vec_id, score double of the k nearest found of each vec_id divisible by every.

    Nearness is the inner product in double precision, ties go to the smaller vec_id; a query is not its own
    candidate. Vectors that are null, empty, zero or hold a null or non-finite component take no part, as queries or
    otherwise, nor do rows without an id; vectors of another dimension than the query's are no candidates. Equal
    vectors are one node of the graph, and each answer lists their ids. A repeated id counts once, with the
    least of its vectors. Other columns are not read. A query with fewer candidates than k gets all that are found.
    """
    packed = embeddings.select("vec_id", "embedding").mapInArrow(_packed, "vec_id long, vec binary").groupBy("vec_id").agg(F.min("vec").alias("vec"))
    packed = saved(packed, "vectors")
    nodes = packed.groupBy("vec").agg(F.min("vec_id").alias("vec_id"))
    count = packed.count()
    bits = max(0, int(np.ceil(np.log2(max(count, 1) / BUCKET))))
    hashed = saved(nodes.select("vec_id", "vec").mapInArrow(_hashed(bits, 5), "id long, vec binary, keys array<long>"), "hashed")
    near = graph(hashed)
    edges = _edges(near)
    links = saved(_limited(edges.select("id", "other").union(edges.select(F.col("other").alias("id"), F.col("id").alias("other"))).distinct(), 2 * DEGREE, 99), "links")
    links = links.groupBy("id").agg(F.collect_list("other").alias("others"))
    points = saved(nodes.select(F.col("vec_id").alias("id"), "vec"), "points")
    points = sized(points, 16 + _width(points))
    members = packed.join(points.withColumnRenamed("id", "node"), "vec")
    asked = saved(members.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), F.col("node").alias("query")), "asked")
    asking = saved(asked.select(F.col("query").alias("id")).distinct().join(points, "id"), "asking")
    asking = sized(asking, 16 + _width(asking))
    entry = hashed.agg(F.slice(F.sort_array(F.collect_list(F.when(F.pmod(F.xxhash64("id"), F.lit(max(1, count // 32))) == 0, F.col("id")))), 1, 64)).head()[0] or []

    start = asking.select(F.col("id").alias("query"), F.explode(F.concat(F.array("id"), F.array(*[F.lit(e).cast("long") for e in entry]) if entry else F.array().cast("array<long>"))).alias("other")).distinct()
    beam = saved(_beam(_dots(start, asking, points).withColumn("done", F.lit(False))), "beam")
    open_ = F.exists(F.slice("beam", 1, CERTAIN), lambda e: ~e.done)
    while not beam.where(open_).isEmpty():
        held = beam.select("query", F.explode("beam").alias("e")).select("query", F.col("e.other").alias("other"), (-F.col("e.away")).alias("score"), F.col("e.done").alias("done"))
        front = beam.where(open_).select("query", F.explode(F.slice(F.filter("beam", lambda e: ~e.done), 1, EXPANDED)).alias("e")).select("query", F.col("e.other").alias("id"))
        new = front.join(links, "id").select("query", F.explode("others").alias("other")).distinct().join(held.select("query", "other"), ["query", "other"], "left_anti")
        marked = held.join(front.select("query", F.col("id").alias("other"), F.lit(True).alias("now")), ["query", "other"], "left").select("query", "other", "score", (F.col("done") | F.coalesce("now", F.lit(False))).alias("done"))
        beam = saved(_beam(marked.unionByName(_dots(new, asking, points).withColumn("done", F.lit(False)))), "beam")

    ids = members.withColumn("r", F.row_number().over(Window.partitionBy("node").orderBy("vec_id"))).where(F.col("r") <= k + 1).groupBy("node").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    found = beam.select("query", F.posexplode(F.slice("beam", 1, k + 1)).alias("at", "e")).select("query", F.col("e.other").alias("node"), (-F.col("e.away")).alias("score"))
    listed = found.join(ids, "node").groupBy("query").agg(F.sort_array(F.flatten(F.collect_list(F.transform("ids", lambda i: F.struct((-F.col("score")).alias("away"), i.alias("vec_id")))))).alias("all"))
    answers = asked.join(listed, "query").select("query_id", F.posexplode(F.slice(F.filter("all", lambda e: e.vec_id != F.col("query_id")), 1, k)).alias("rank", "e"))
    return answers.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("e.vec_id").alias("vec_id"), (-F.col("e.away")).alias("score"))


def _width(table: DataFrame) -> int:
    """Bytes of a vector in the table; they are of one size as a rule."""
    row = table.agg(F.max(F.octet_length("vec"))).head()
    return int(row[0] or 0)
