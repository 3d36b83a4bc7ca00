"""Quality rules: boosted trees over document statistics, flattened for vectorised scoring."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspan.llm.words import Words, chunks, per_text, windows
from shelfspan.session import cut_lineage

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
EXTRA = ["n_lines", "n_upper", "n_digits", "n_stops", "n_distinct"]
#: Model inputs, and the direction in which each may move the quality (0: either).
FEATURES = {"log_words": 0, "mean_chars": 0, "symbol_share": -1, "dup_line_share": -1, "repeat_share": -1,
            "upper_share": -1, "digit_share": 0, "stop_share": 0, "distinct_share": 0}
#: Bound on the labelled rows that reach the driver for fitting.
MOST_LABELLED = 20_000
_SYMBOL = np.isin(np.arange(256), list(b"#*$%&|<>"))
_UPPER = np.isin(np.arange(256), list(range(65, 91)))
_DIGIT = np.isin(np.arange(256), list(range(48, 58)))
_STOP = np.isin(np.arange(256), list(b".!?,;:"))
_LINE_BLANKS = " \t\n\x0b\x0c\r"


def _covered(first: np.ndarray, n: int, total: int) -> np.ndarray:
    """Places inside a window of ``n`` that starts at a flagged place."""
    edge = np.zeros(total + 1, np.int64)
    begins = np.flatnonzero(first)
    np.add.at(edge, begins, 1)
    np.add.at(edge, begins + n, -1)
    return np.cumsum(edge[:-1]) > 0


def _statistics(batch: pa.RecordBatch):
    texts = batch.column("text")
    for low, high, data, offsets in chunks(texts):
        n = high - low
        w = Words(data, offsets)
        per = lambda flags: np.bincount(np.searchsorted(offsets, np.flatnonzero(flags), "right") - 1, minlength=n)
        chars = np.zeros(n, np.int64)
        leads = (data & 0xC0) != 0x80
        running = np.concatenate(([0], np.cumsum(leads)))
        if len(w):
            chars = np.bincount(w.text, weights=running[w.start + w.length] - running[w.start], minlength=n).astype(np.int64)
        grams = windows(w.hash, 5)
        whole = w.text[: len(grams)] == w.text[4:] if len(grams) else np.zeros(0, bool)
        at = np.flatnonzero(whole)
        order = at[np.lexsort((grams[at], w.text[at]))]
        same = (grams[order][1:] == grams[order][:-1]) & (w.text[order][1:] == w.text[order][:-1]) if len(order) else np.zeros(0, bool)
        again = np.zeros(len(w), bool)
        again[order[1:][same]] = True
        again[order[:-1][same]] = True
        repeat = np.bincount(w.text[_covered(again, 5, len(w))], minlength=n)
        pair = np.lexsort((w.hash, w.text))
        new = np.ones(len(w), bool)
        new[1:] = (w.hash[pair][1:] != w.hash[pair][:-1]) | (w.text[pair][1:] != w.text[pair][:-1])
        lines, doubled = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for i, text in enumerate(texts.slice(low, n).to_pylist()):
            if text and "\n" in text:
                full = [x for x in text.split("\n") if x.strip(_LINE_BLANKS)]
                lines[i], doubled[i] = len(full), len(full) - len(set(full))
            else:
                lines[i] = bool(text and text.strip(_LINE_BLANKS))
        out = [w.counts(n), chars, per(_SYMBOL[data]), doubled, repeat, lines, per(_UPPER[data]), per(_DIGIT[data]), per(_STOP[data]),
               np.bincount(w.text[pair][new], minlength=n)]
        carried = batch.schema.names[:-1]
        yield pa.RecordBatch.from_arrays(
            [*[batch.column(c).slice(low, n) for c in carried], *[pa.array(np.asarray(x, np.int64)) for x in out]], [*carried, *BASE, *EXTRA])


def statistics(documents: DataFrame, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per document: the ``carry`` columns and counts of its whole text (null: empty)."""
    kinds = dict(documents.dtypes)
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in carry] + [f"{c} long" for c in BASE + EXTRA])
    return per_text(documents.select(*carry, "text"), _statistics, schema)


def matrix(columns: dict[str, np.ndarray]) -> np.ndarray:
    c = {k: np.asarray(v, float) for k, v in columns.items()}
    words, chars = np.maximum(c["n_words"], 1), np.maximum(c["word_chars"], 1)
    return np.column_stack([
        np.log1p(c["n_words"]), c["word_chars"] / words, c["n_symbols"] / chars, c["n_dup_lines"] / np.maximum(c["n_lines"], 1),
        c["n_repeat_words"] / words, c["n_upper"] / chars, c["n_digits"] / chars, c["n_stops"] / words, c["n_distinct"] / words])


class Trees:
    """Depth-limited boosted trees as flat node arrays: feature, cut, left child, value."""

    def __init__(self, depth: int = 3, rounds: int = 60, rate: float = 0.2, bins: int = 48, ridge: float = 2.0, least: int = 8):
        self.depth, self.rounds, self.rate, self.bins, self.ridge, self.least = depth, rounds, rate, bins, ridge, least
        self.start = 0.0
        self.feature = self.cut = self.value = np.zeros((0, 2 ** (depth + 1) - 1))

    def fit(self, x: np.ndarray, y: np.ndarray, direction: list[int]) -> Trees:
        """Logistic loss.  A split of a constrained feature is refused when its sides would be
        in the wrong order, and both subtrees stay on their side of the middle between them."""
        if not len(y) or y.min() == y.max():
            self.start = 4.0 if not len(y) or y.max() else -4.0
            return self
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])]
        coded = np.column_stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)])
        mean = y.mean()
        self.start = float(np.log(mean / (1 - mean)))
        score, trees = np.full(len(y), self.start), []
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            nodes = self._tree(coded, cuts, p - y, p * (1 - p), direction)
            score += self._walk(nodes, x)
            trees.append(nodes)
        self.feature, self.cut, self.value = (np.stack([t[k] for t in trees]) for k in range(3))
        return self

    def _tree(self, coded, cuts, grad, hess, direction):
        size = 2 ** (self.depth + 1) - 1
        feature, cut, value = np.full(size, -1), np.zeros(size), np.zeros(size)
        todo = [(0, np.arange(len(grad)), -np.inf, np.inf)]
        while todo:
            node, rows, low, high = todo.pop()
            g, h = grad[rows].sum(), hess[rows].sum()
            value[node] = self.rate * np.clip(-g / (h + self.ridge), low, high)
            if 2 * node + 2 >= size or len(rows) < 2 * self.least:
                continue
            best = (1e-6, None)
            for j, c in enumerate(cuts):
                if not len(c):
                    continue
                gl = np.cumsum(np.bincount(coded[rows, j], grad[rows], len(c) + 1))[:-1]
                hl = np.cumsum(np.bincount(coded[rows, j], hess[rows], len(c) + 1))[:-1]
                nl = np.cumsum(np.bincount(coded[rows, j], minlength=len(c) + 1))[:-1]
                left, right = -gl / (hl + self.ridge), -(g - gl) / (h - hl + self.ridge)
                gain = gl**2 / (hl + self.ridge) + (g - gl) ** 2 / (h - hl + self.ridge) - g**2 / (h + self.ridge)
                bad = (nl < self.least) | (len(rows) - nl < self.least)
                if direction[j]:
                    bad |= (np.clip(right, low, high) - np.clip(left, low, high)) * direction[j] < 0
                k = int(np.argmax(np.where(bad, -1.0, gain)))
                if not bad[k] and gain[k] > best[0]:
                    best = (gain[k], (j, k, left[k], right[k]))
            if best[1] is None:
                continue
            j, k, left, right = best[1]
            feature[node], cut[node] = j, cuts[j][k]
            goes = coded[rows, j] <= k
            middle = (np.clip(left, low, high) + np.clip(right, low, high)) / 2
            a, b = (low, high), (low, high)
            if direction[j] > 0:
                a, b = (low, middle), (middle, high)
            elif direction[j] < 0:
                a, b = (middle, high), (low, middle)
            todo += [(2 * node + 1, rows[goes], *a), (2 * node + 2, rows[~goes], *b)]
        return feature, cut, value

    def _walk(self, nodes, x):
        feature, cut, value = nodes
        at, rows = np.zeros(len(x), np.int64), np.arange(len(x))
        for _ in range(self.depth):
            f = feature[at].astype(np.int64)
            inner = f >= 0
            right = x[rows, np.maximum(f, 0)] > cut[at]
            at = np.where(inner, 2 * at + 1 + right, at)
        return value[at]

    def probability(self, x: np.ndarray) -> np.ndarray:
        score = np.full(len(x), self.start)
        for t in zip(self.feature, self.cut, self.value):
            score += self._walk(t, x)
        return 1 / (1 + np.exp(-score))


def quality_rules(documents: DataFrame, labels: DataFrame, threshold: float = 0.5, most_labelled: int = MOST_LABELLED,
                  carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Statistics of each document with ``quality`` (0 to 1), ``base_failed`` and ``kept``.

    The trees learn ``labels.quality`` from at most ``most_labelled`` rows, picked by a hash
    of ``doc_id``.  Null labels and labels of unknown documents are left out; without both
    kinds of label the model keeps everything, or nothing where all are bad.  ``carry``
    names the columns kept beside the statistics, ``doc_id`` among them.  One result row per
    input row, repeated and null ids included; an empty table gives an empty result.
    """
    counted = cut_lineage(statistics(documents, carry))
    known = labels.filter("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("_good"))
    sample = counted.join(known, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", *BASE, *EXTRA).limit(most_labelled).select(*BASE, *EXTRA, "_good").toPandas()
    model = Trees().fit(matrix({c: sample[c] for c in BASE + EXTRA}), sample["_good"].to_numpy(float), list(FEATURES.values()))

    def scored(batch: pa.RecordBatch):
        p = model.probability(matrix({c: batch.column(c).to_numpy() for c in BASE + EXTRA}))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p)], [*batch.schema.names, "quality"])

    schema = ", ".join([f"`{n}` {t}" for n, t in counted.dtypes] + ["quality double"])
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return per_text(counted, scored, schema).withColumn("base_failed", failed).withColumn(
        "kept", ~failed & (F.col("quality") >= threshold))
