"""Quality classifier: gated attention over the passages of a text (multiple-instance learning)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import passages
from .common import buffers, chunks, held, with_fields

#: Labelled documents that the model is fitted on at most, taken in the order of a hash of their ids.
MAX_TRAIN = 2500
#: No learning from rows whose crc32(id) % FOLDS is HELD.
FOLDS, HELD = 3, 1
HIDDEN, ATTENTION, EPOCHS, BATCH, RATE, DECAY = 48, 24, 24, 64, 0.004, 1e-4


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Model:
    """h = tanh(xW); weights of the passages by w'(tanh(hV) * sigmoid(hU)); score of the weighted sum of h."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        put = lambda *s: (r.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.p = {"W": put(passages.DIM, HIDDEN), "b": np.zeros(HIDDEN, np.float32), "V": put(HIDDEN, ATTENTION), "U": put(HIDDEN, ATTENTION), "w": put(ATTENTION, 1), "o": put(HIDDEN, 1), "c": np.zeros(1, np.float32)}
        self.mean, self.scale = np.zeros(passages.DIM, np.float32), np.ones(passages.DIM, np.float32)

    def forward(self, x: np.ndarray, ptr: np.ndarray) -> dict:
        """x: passages of bags one after the other; ptr: each bag's first."""
        p, at = self.p, ptr[:-1]
        x = (x - self.mean) * self.scale
        h = np.tanh(x @ p["W"] + p["b"])
        v, u = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        a = ((v * u) @ p["w"])[:, 0]
        bag = np.repeat(np.arange(len(at)), np.diff(ptr))
        e = np.exp(a - np.maximum.reduceat(a, at)[bag])
        alpha = e / np.add.reduceat(e, at)[bag]
        z = np.add.reduceat(alpha[:, None] * h, at, 0)
        return {"x": x, "h": h, "v": v, "u": u, "alpha": alpha, "z": z, "bag": bag, "score": _sigmoid((z @ p["o"])[:, 0] + p["c"][0])}

    def gradients(self, f: dict, ptr: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict:
        p, at, bag = self.p, ptr[:-1], f["bag"]
        d = ((f["score"] - y) * weight / weight.sum()).astype(np.float32)
        g = {"o": f["z"].T @ d[:, None], "c": d.sum(keepdims=True)}
        dz = d[:, None] * p["o"][:, 0]
        da = (f["h"] * dz[bag]).sum(1)
        da = f["alpha"] * (da - np.add.reduceat(f["alpha"] * da, at)[bag])
        g["w"] = (f["v"] * f["u"]).T @ da[:, None]
        gate = da[:, None] * p["w"][:, 0]
        dv, du = gate * f["u"] * (1 - f["v"] ** 2), gate * f["v"] * f["u"] * (1 - f["u"])
        g["V"], g["U"] = f["h"].T @ dv, f["h"].T @ du
        dh = (f["alpha"][:, None] * dz[bag] + dv @ p["V"].T + du @ p["U"].T) * (1 - f["h"] ** 2)
        g["W"], g["b"] = f["x"].T @ dh, dh.sum(0)
        return g

    def fit(self, bags: list[np.ndarray], y: np.ndarray, seed: int = 7) -> Model:
        every = np.concatenate(bags)
        self.mean, self.scale = every.mean(0), 1 / (every.std(0) + 1e-3)
        r, m1, m2, t = np.random.default_rng(seed), {k: 0.0 for k in self.p}, {k: 0.0 for k in self.p}, 0
        weight = np.where(y == 1, 0.5 / max(y.mean(), 1e-6), 0.5 / max(1 - y.mean(), 1e-6)).astype(np.float32)
        for epoch in range(EPOCHS):
            order, rate = r.permutation(len(bags)), RATE * (1 - epoch / EPOCHS) + 1e-4
            for k in range(0, len(order), BATCH):
                pick = order[k : k + BATCH]
                ptr = np.concatenate([[0], np.cumsum([len(bags[i]) for i in pick])])
                g = self.gradients(self.forward(np.concatenate([bags[i] for i in pick]), ptr), ptr, y[pick], weight[pick])
                t += 1
                for n, v in g.items():
                    v = v + DECAY * self.p[n]
                    m1[n], m2[n] = 0.9 * m1[n] + 0.1 * v, 0.999 * m2[n] + 0.001 * v * v
                    self.p[n] = self.p[n] - rate * (m1[n] / (1 - 0.9**t)) / (np.sqrt(m2[n] / (1 - 0.999**t)) + 1e-8)
        return self


def _encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = buffers(batch.column("text"))
        for a, b in chunks(offsets):
            x, ptr = passages.encode(data, offsets[a : b + 1])
            yield pa.record_batch([batch.column("label")[a:b], pa.array([x[i:j].astype(np.float16).tobytes() for i, j in zip(ptr[:-1], ptr[1:])], pa.binary())], ["label", "x"])


def fit(documents: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> Model | float:
    """A model of labels.quality; where the rows to learn from show fewer than two classes, the one probability that they allow (0.5 without any)."""
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held("doc_id", FOLDS, HELD)).groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("label"))
    picked = known.orderBy(F.xxhash64("doc_id", F.lit("quality")), "doc_id").limit(max_train)
    got = documents.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("text", "label").mapInArrow(_encoded, "label int, x binary").toPandas()
    if not len(got):
        return 0.5
    got = got.assign(size=got.x.map(len)).sort_values(["size", "label", "x"])  # the same order, however the rows were dealt out
    y = got.label.to_numpy(np.float32)
    if y.min() == y.max():
        return float(y[0])
    return Model().fit([np.frombuffer(x, np.float16).reshape(-1, passages.DIM).astype(np.float32) for x in got.x], y)


def classify(documents: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> DataFrame:
    """documents with score double (0 to 1, higher: good text likelier) and predicted int (score >= 0.5).

    Learns from at most max_train labelled rows outside the held-out fold; scores every passage of every text
    without a shuffle. A null text counts as empty; both get a score. Repeated rows get equal scores. A label
    that is null or whose id is null is not learned from; repeated labels of an id are averaged. Columns of
    documents named score or predicted are replaced, all others kept.
    """
    model = fit(documents, labels, max_train)
    documents = documents.drop("score", "predicted")

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            found = [np.zeros(0)]
            for a, b in chunks(offsets):
                if isinstance(model, float):
                    found.append(np.full(b - a, model))
                else:
                    found.append(model.forward(*passages.encode(data, offsets[a : b + 1]))["score"].astype(np.float64))
            score = np.concatenate(found)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score, pa.float64()), pa.array((score >= 0.5).astype(np.int32))], [*batch.schema.names, "score", "predicted"])

    return documents.mapInArrow(scored, with_fields(documents.schema, score="double", predicted="int"))
