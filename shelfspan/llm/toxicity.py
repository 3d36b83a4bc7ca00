"""Toxicity from confirmed examples and unlabelled text: non-negative positive-unlabelled learning."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspan.llm.words import _LOWER, _POW, Words, chunks, mixed
from shelfspan.session import cut_lineage

BITS = 20
#: Beginnings of words, in bytes, that are features beside whole words.
STEMS = (4, 5, 6)
#: Bounds on the rows that reach the driver for fitting.
MOST_TOXIC, MOST_UNLABELLED = 4_000, 12_000


def _features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, feature) pairs in order: lower-cased words and their first letters."""
    w = Words(data, offsets, lower=True, plain=True)
    text, value = [w.text], [w.hash]
    for n in STEMS:
        long = np.flatnonzero(w.length >= n)
        stem = np.zeros(len(long), np.uint64)
        for j in range(n):
            stem += _LOWER[data[w.start[long] + j]] * _POW[j]
        text.append(w.text[long])
        value.append(mixed(stem + np.uint64(n)))
    code = (np.concatenate(text).astype(np.uint64) << np.uint64(BITS)) | (np.concatenate(value) >> np.uint64(64 - BITS))
    code = np.unique(code)
    return (code >> np.uint64(BITS)).astype(np.int64), (code & np.uint64((1 << BITS) - 1)).astype(np.int64)


def _seen(only: np.ndarray | None = None):
    """How many of a task's texts have each feature (of ``only``); feature -1 stands for every text."""

    def run(batches):
        total, texts = np.zeros(1 << BITS, np.int64), 0
        for batch in batches:
            for low, high, data, offsets in chunks(batch.column("text")):
                total += np.bincount(_features(data, offsets)[1], minlength=1 << BITS)
                texts += high - low
        number = np.flatnonzero(total) if only is None else only[total[only] > 0]
        yield pa.RecordBatch.from_arrays([pa.array(np.append(number, -1).astype(np.int32)), pa.array(np.append(total[number], texts))], ["feature", "texts"])

    return run


def _counts(texts: DataFrame, only: np.ndarray | None = None) -> DataFrame:
    return texts.select("text").mapInArrow(_seen(only), "feature int, texts long").groupBy("feature").agg(F.sum("texts").alias("texts"))


def _listed(used: np.ndarray):
    """The used features of each text, as their places in ``used``."""

    def run(batches):
        for batch in batches:
            for low, high, data, offsets in chunks(batch.column("text")):
                text, feature = _features(data, offsets)
                place = np.minimum(np.searchsorted(used, feature), max(len(used) - 1, 0))
                held = used[place] == feature if len(used) else np.zeros(len(text), bool)
                cut = np.searchsorted(text[held], np.arange(high - low + 1))
                packed = [place[held][a:b].astype(np.int32).tobytes() for a, b in zip(cut[:-1], cut[1:])]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(low, high - low), batch.column("toxic").slice(low, high - low), pa.array(packed, pa.binary())],
                                                 ["doc_id", "toxic", "features"])

    return run


class Classifier:
    """A linear score over present features, fitted with the non-negative risk.

    The risk of calling unlabelled text clean, less the share ``prior`` of it that is toxic,
    cannot be below zero for the truth; where the estimate is, the step goes uphill on it.
    Features are ones that toxic texts hold more often than others, so weights stay positive.
    """

    def __init__(self, prior: float, steps: int = 200, rate: float = 0.05, ridge: float = 1e-4, least: int = 5):
        self.prior, self.steps, self.rate, self.ridge, self.least = min(max(prior, 1e-3), 0.5), steps, rate, ridge, least
        self.weight = np.zeros(1 << BITS, np.float32)
        self.bias = float(np.log(self.prior / (1 - self.prior)))

    def choose(self, feature: np.ndarray, seen: np.ndarray, around: np.ndarray, toxic: int, others: int) -> Classifier:
        """Keep the features that toxic texts have more often, scaled by the log of how much."""
        lift = np.log((seen + 0.5) / (toxic + 1)) - np.log((around + 0.5) / (others + 1))
        order = np.argsort(feature)
        keep = order[(seen >= self.least)[order] & (lift > 0.3)[order]]
        self.used, self.scale = feature[keep].astype(np.int64), np.clip(lift[keep], 0, 4)
        return self

    def fit(self, toxic: list[np.ndarray], unlabelled: list[np.ndarray]) -> Classifier:
        """``toxic`` and ``unlabelled``: places of the used features in each text."""
        if not toxic or not unlabelled:
            return self
        used, scale, rows = self.used, self.scale, [*toxic, *unlabelled]
        sizes = np.array([len(r) for r in rows])
        flat, owner = np.concatenate(rows), np.repeat(np.arange(len(rows)), sizes)
        x = scale[flat]
        n_p, n = len(toxic), len(rows)
        w, b = np.zeros(len(used)), self.bias
        m, v = np.zeros(len(used) + 1), np.zeros(len(used) + 1)
        for step in range(1, self.steps + 1):
            score = np.bincount(owner, x * w[flat], n) + b
            p = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
            slope = p * (1 - p)
            clean_risk = p[n_p:].mean() - self.prior * p[:n_p].mean()
            g = np.empty(n)
            g[n_p:] = slope[n_p:] / (n - n_p)
            g[:n_p] = -self.prior * slope[:n_p] / n_p
            if clean_risk < 0:
                g = -g
            else:
                g[:n_p] -= self.prior * slope[:n_p] / n_p
            whole = np.append(np.bincount(flat, x * g[owner], len(used)) + self.ridge * w, g.sum())
            m, v = 0.9 * m + 0.1 * whole, 0.999 * v + 0.001 * whole**2
            move = self.rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
            w, b = np.maximum(w - move[:-1], 0), b - move[-1]
        self.weight[used], self.bias = scale * w, float(b)
        return self

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        text, feature = _features(data, offsets)
        total = np.bincount(text, self.weight[feature], len(offsets) - 1) + self.bias
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def toxicity(documents: DataFrame, labels: DataFrame, held_out: Column, threshold: float = 0.7) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every document's whole text.

    Only confirmed toxic rows are used as labels, at most ``MOST_TOXIC``; how common features
    are elsewhere is counted over all rows outside ``held_out``, and the fit takes at most
    ``MOST_UNLABELLED`` of them.  Both are picked by a hash of ``doc_id``, the smallest text
    of an id each.  The prior is the share of toxic among those labels.  Null ids, labels and
    texts: null ids are never learned from, null labels are no labels, a null text is an
    empty one and scores the bias.  Without examples every score is the prior.
    """
    free = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic")).filter(~held_out)
    prior = free.agg(F.avg("toxic")).first()[0] or 0.0
    pick = lambda df, n: df.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    chosen = pick(free.filter("toxic = 1"), MOST_TOXIC).withColumn("toxic", F.lit(1)).unionByName(
        pick(documents.filter(F.col("doc_id").isNotNull() & ~held_out), MOST_UNLABELLED).withColumn("toxic", F.lit(0)))
    sample = cut_lineage(documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")))
    model = Classifier(float(prior))
    seen = _counts(sample.filter("toxic = 1")).filter((F.col("texts") >= model.least) | (F.col("feature") < 0)).toPandas().set_index("feature")["texts"]
    toxic, seen = int(seen.get(-1, 0)), seen.drop(-1, errors="ignore").sort_index()
    around = _counts(documents.filter(F.col("doc_id").isNotNull() & ~held_out), seen.index.to_numpy(np.int64)).toPandas().set_index("feature")["texts"]
    others, around = int(around.get(-1, 0)), around.reindex(seen.index, fill_value=0)
    model.choose(seen.index.to_numpy(), seen.to_numpy(), around.to_numpy(), toxic, others)
    rows = sample.mapInArrow(_listed(model.used), "doc_id long, toxic int, features binary").orderBy("doc_id", "toxic", "features").toPandas()
    of = lambda kind: [np.frombuffer(x, np.int32) for x in rows.loc[rows["toxic"] == kind, "features"]]
    model.fit(of(1), of(0))

    def run(batches):
        for batch in batches:
            for low, high, data, offsets in chunks(batch.column("text")):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(low, high - low), batch.column("held_out").slice(low, high - low),
                                                  pa.array(model.scores(data, offsets))], ["doc_id", "held_out", "score"])

    scored = documents.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
