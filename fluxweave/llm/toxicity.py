"""Toxicity: a linear classifier of character n-grams scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, buffers, chunks, held, mixed, saved, with_fields

#: Labelled documents that the model is fitted on at most, taken in the order of a hash of their ids.
MAX_TRAIN = 12_000
FOLDS, HELD = 5, 0
#: Lengths of the n-grams, in code points of the text with A-Z lower-cased.
SIZES = (4, 5, 6)
#: An n-gram has a feature if so many texts that are learned from have it.
LEAST, SMOOTHING = 2, 1.0
STEPS, L1, L2 = 400, 5e-4, 1e-5
#: n-grams that come into the model at a time; they keep coming while one of all n-grams has a gradient above L1 by the share SLACK.
AT_ONCE, SLACK = 4096, 0.1
#: Distinct n-grams that a task sums up before it hands them on.
HELD_GRAMS = 1 << 20
#: Residuals are summed as whole numbers of this unit, so that their order does not matter.
UNIT = 1e-9


def _hashed(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each size: row and 64-bit hash of every n-gram in the rows. White space of any kind is one sign."""
    raw = LOWER[data[int(offsets[0]) : int(offsets[-1])]]
    first = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])[offsets - offsets[0]]  # code points before each row
    signs = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    signs = np.where((signs >= 9) & (signs <= 13), np.uint32(32), signs).astype(np.uint64)
    row = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(first))
    total = np.zeros(len(signs), np.uint64)
    for n in range(1, max(SIZES) + 1):
        if len(signs) < n:
            return
        total = total[: len(signs) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + signs[n - 1 :] + np.uint64(1)
        if n in SIZES:
            same = row[: len(total)] == row[n - 1 :]
            yield row[: len(total)][same], mixed(total[same] ^ np.uint64(n << 56)).view(np.int64)


def _present(data: np.ndarray, offsets: np.ndarray, kept: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Row and n-gram (its hash, or its place among the kept ones, which ascend), once for each n-gram that a row has."""
    rows, grams = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
    for row, gram in _hashed(data, offsets):
        if kept is not None:
            table = np.zeros(1 << 20, bool)
            table[kept & 0xFFFFF] = True
            maybe = np.flatnonzero(table[gram & 0xFFFFF])  # most n-grams are ruled out by 20 bits
            row, gram = row[maybe], gram[maybe]
            at = np.searchsorted(kept, gram)
            hit = kept.take(np.minimum(at, len(kept) - 1)) == gram if len(kept) else np.zeros(len(gram), bool)
            row, gram = row[hit], at[hit]
        rows.append(row)
        grams.append(gram)
    row, gram = np.concatenate(rows), np.concatenate(grams)
    order = np.lexsort((gram, row))
    row, gram = row[order], gram[order]
    first = np.ones(len(row), bool)
    first[1:] = (row[1:] != row[:-1]) | (gram[1:] != gram[:-1])
    return row[first], gram[first]


def _summed(grams: np.ndarray, values: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    found, at = np.unique(grams, return_inverse=True)
    sums = [np.zeros(len(found), np.int64) for _ in values]
    for total, value in zip(sums, values):
        np.add.at(total, at, value)
    return found, sums


def _totals(values_of: Callable[[np.ndarray, np.ndarray, np.ndarray], list[np.ndarray]], names: list[str]) -> Callable:
    """A step over (label, text) that gives each n-gram with the sums of its texts' whole numbers."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, sums = np.zeros(0, np.int64), [np.zeros(0, np.int64) for _ in names]
        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            label = batch.column("label").to_numpy(zero_copy_only=False)
            for a, b in chunks(offsets):
                row, gram = _present(data, offsets[a : b + 1])
                more = values_of(data, offsets[a : b + 1], label[a:b])
                grams, sums = _summed(np.concatenate([grams, gram]), [np.concatenate([s, m[row]]) for s, m in zip(sums, more)])
                if len(grams) > HELD_GRAMS:
                    yield pa.record_batch([pa.array(grams), *map(pa.array, sums)], ["gram", *names])
                    grams, sums = grams[:0], [s[:0] for s in sums]
        yield pa.record_batch([pa.array(grams), *map(pa.array, sums)], ["gram", *names])

    return of


class Model:
    """score = sigmoid(bias + sum of weight * log-count ratio over the model's n-grams that a text has)."""

    def __init__(self, n_clean: int, n_toxic: int):
        self.n_clean, self.n_toxic = n_clean, n_toxic
        self.grams, self.ratio, self.weight, self.bias = np.zeros(0, np.int64), np.zeros(0), np.zeros(0), 0.0

    def add(self, grams: np.ndarray, clean: np.ndarray, toxic: np.ndarray) -> None:
        """Further n-grams, of weight 0."""
        ratio = np.log((toxic + SMOOTHING) / (self.n_toxic + 2 * SMOOTHING) / ((clean + SMOOTHING) / (self.n_clean + 2 * SMOOTHING)))
        every = np.concatenate([self.grams, grams])
        order = np.argsort(every)
        self.grams = every[order]
        self.ratio, self.weight = np.concatenate([self.ratio, ratio])[order], np.concatenate([self.weight, np.zeros(len(grams))])[order]

    def share(self, y: np.ndarray) -> np.ndarray:
        """What a text counts in the loss: both classes alike."""
        return np.where(y == 1, 0.5 / self.n_toxic, 0.5 / self.n_clean)

    def fit(self, row: np.ndarray, feature: np.ndarray, y: np.ndarray) -> Model:
        """Logistic loss with L1 and L2 by accelerated proximal steps from the weights so far; row and feature list what each text has."""
        x, n, k, share = self.ratio[feature], len(y), len(self.ratio), self.share(y)
        one = np.full(n, 1.0)
        for _ in range(20):  # the loss curves no more than a quarter of the largest eigenvalue of the weighted squares
            one = np.bincount(row, x * np.bincount(feature, x * (share * one)[row], k)[feature], n) + (share * one).sum()
            lips = 0.3 * np.abs(one).max()
            one /= np.abs(one).max()
        w, v, b, c, t = self.weight, self.weight, self.bias, self.bias, 1.0
        for _ in range(STEPS):
            g, h = self.gradient(row, feature, y, v, c)
            u = v - (g + L2 * v) / lips
            u = np.sign(u) * np.maximum(np.abs(u) - L1 / lips, 0)
            a, s = c - h / lips, (1 + np.sqrt(1 + 4 * t * t)) / 2
            if (v - u) @ (u - w) + (c - a) * (a - b) > 0:  # the steps have gone too far: begin anew from here
                s, t = 1.0, 1.0
            v, c = u + (t - 1) / s * (u - w), a + (t - 1) / s * (a - b)
            w, b, t = u, a, s
        self.weight, self.bias = w, float(b)
        return self

    def gradient(self, row: np.ndarray, feature: np.ndarray, y: np.ndarray, weight: np.ndarray, bias: float) -> tuple[np.ndarray, float]:
        """Of the logistic loss, by weight and by bias."""
        z = np.bincount(row, self.ratio[feature] * weight[feature], len(y)) + bias
        d = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * self.share(y)
        return np.bincount(feature, self.ratio[feature] * d[row], len(weight)), float(d.sum())

    def pruned(self) -> Model:
        """Without the n-grams of weight 0."""
        used = self.weight != 0
        self.grams, self.ratio, self.weight = self.grams[used], self.ratio[used], self.weight[used]
        return self

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        row, at = _present(data, offsets, self.grams)
        z = np.bincount(row, self.ratio[at] * self.weight[at], len(offsets) - 1) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(documents: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> Model | float:
    """A model of labels.toxic; where the rows to learn from show fewer than two classes, the one probability that they allow (0 without any).

    All n-grams of the texts are features, and only the L1 penalty leaves any out: the model is fitted on those that came in so far; then a Spark job
    sums, for every n-gram of every text, the gradient of the loss. Those whose gradient exceeds the penalty come in, the largest first,
    until none does: the minimum over those that came in is then one over all of them. A repeated id counts once, with its least text.
    """
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held("doc_id", FOLDS, HELD)).groupBy("doc_id").agg((F.avg("toxic") >= 0.5).cast("int").alias("label"))
    picked = known.orderBy(F.xxhash64("doc_id", F.lit("toxic")), "doc_id").limit(max_train)
    texts = documents.select("doc_id", "text").join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("label").alias("label"))
    learned = saved(texts.select("label", "text"), "learned")
    share = {r.label: r.n for r in learned.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(share) < 2:
        return float(next(iter(share), 0))
    model = Model(share[0], share[1])
    counted = learned.mapInArrow(_totals(lambda _, __, y: [(y == 0).astype(np.int64), (y == 1).astype(np.int64)], ["clean", "toxic"]), "gram long, clean long, toxic long")
    counts = saved(counted.groupBy("gram").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).where(F.col("clean") + F.col("toxic") >= LEAST), "counts")
    ratio = F.log((F.col("toxic") + SMOOTHING) / (model.n_toxic + 2 * SMOOTHING) / ((F.col("clean") + SMOOTHING) / (model.n_clean + 2 * SMOOTHING)))
    while True:

        def left(data: np.ndarray, offsets: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
            return [np.rint((model.score(data, offsets) - y) * model.share(y) / UNIT).astype(np.int64)]

        if len(model.grams):
            slopes = learned.mapInArrow(_totals(left, ["slope"]), "gram long, slope long").groupBy("gram").agg(F.sum("slope").alias("slope")).join(counts, "gram")
        else:  # every text's score is a half, so the counts tell the gradients
            slopes = counts.withColumn("slope", (F.col("clean") / model.n_clean - F.col("toxic") / model.n_toxic) / (4 * UNIT))
        slope = F.abs(F.col("slope") * UNIT * ratio)
        worst = slopes.where(slope > L1 * (1 + SLACK)).orderBy(slope.desc(), "gram").select("gram", "clean", "toxic").limit(AT_ONCE + len(model.grams)).toPandas()
        worst = worst[~worst.gram.isin(model.grams)][:AT_ONCE]
        if not len(worst):
            return model.pruned()
        model.add(worst.gram.to_numpy(), worst.clean.to_numpy(), worst.toxic.to_numpy())
        kept = model.grams

        def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                data, offsets = buffers(batch.column("text"))
                for a, b in chunks(offsets):
                    row, at = _present(data, offsets[a : b + 1], kept)
                    cut = np.searchsorted(row, np.arange(b - a + 1))
                    yield pa.record_batch([batch.column("label")[a:b], pa.array([at[i:j].astype(np.int32).tobytes() for i, j in zip(cut[:-1], cut[1:])], pa.binary())], ["label", "x"])

        got = learned.mapInArrow(found, "label int, x binary").toPandas().sort_values(["label", "x"])
        lists = [np.frombuffer(x, np.int32) for x in got.x]
        model.fit(np.repeat(np.arange(len(lists)), [len(x) for x in lists]), np.concatenate(lists), got.label.to_numpy(np.float64))


def classify(documents: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> DataFrame:
    """documents with score double (0 to 1, higher: toxic likelier) and predicted int (score >= 0.5).

    Learns from at most max_train labelled rows outside the held-out fold; scores whole texts without a shuffle.
    A null text counts as empty and gets the score of a text without any n-gram. Repeated rows get equal scores.
    A label that is null or whose id is null is not learned from; repeated labels of an id are averaged. Columns
    of documents named score or predicted are replaced, all others kept.
    """
    model = fit(documents, labels, max_train)
    documents = documents.drop("score", "predicted")

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            found = [np.full(b - a, model) if isinstance(model, float) else model.score(data, offsets[a : b + 1]) for a, b in chunks(offsets)]
            score = np.concatenate([np.zeros(0), *found])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score, pa.float64()), pa.array((score >= 0.5).astype(np.int32))], [*batch.schema.names, "score", "predicted"])

    return documents.mapInArrow(scored, with_fields(documents.schema, score="double", predicted="int"))
