"""Language of texts: a bidirectional gated recurrent network over bytes, in numpy.

A text's bytes are read in windows; both directions run through a window, every position
gets a probability per language, and a document pools those of all its letter positions.
All windows of a batch advance together, one position per step, features first, so a step
is one small matrix product and a few passes over contiguous rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspan.llm.words import chunks, row_key

WINDOW, HIDDEN = 64, 8
#: Bounds of the fit: documents of a language, windows of a document.
MOST_ROWS, MOST_WINDOWS = 1_000, 4
#: Windows that advance together when texts are scored.
AT_ONCE = 1024
PAD = 256
_LETTER = np.array([chr(i).isalpha() or i >= 0x80 for i in range(256)] + [False])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """In place, by the hyperbolic tangent of the half."""
    x *= np.float32(0.5)
    np.tanh(x, out=x)
    x += np.float32(1)
    x *= np.float32(0.5)
    return x


class Network:
    """Two gated recurrent cells (update, reset, candidate) and a linear label per position.

    ``table`` holds what a byte adds to the gates, ``turn`` the recurrent weights, ``shift``
    the bias inside the reset gate's reach, ``out`` the labels' weights, each per direction.
    """

    NAMES = ("table", "turn", "shift", "out", "bias")

    def __init__(self, labels: int, hidden: int = HIDDEN, seed: int = 5):
        draw = np.random.default_rng(seed)
        self.hidden, self.labels = hidden, labels
        self.table = draw.normal(0, 0.3, (2, 3 * hidden, PAD + 1)).astype(np.float32)
        self.turn = draw.normal(0, hidden**-0.5, (2, 3 * hidden, hidden)).astype(np.float32)
        self.shift = np.zeros((2, hidden, 1), np.float32)
        self.out = draw.normal(0, hidden**-0.5, (2, labels, hidden)).astype(np.float32)
        self.bias = np.zeros((labels, 1), np.float32)

    def _step(self, state: np.ndarray, seen: tuple[np.ndarray, np.ndarray], keep: tuple[np.ndarray, np.ndarray] | None):
        """The next state of both directions, and what its derivative needs."""
        h = self.hidden
        fed = np.empty((2, 3 * h, state.shape[2]), np.float32)
        for side in (0, 1):
            np.take(self.table[side], seen[side], axis=1, out=fed[side], mode="clip")
        turned = np.matmul(self.turn, state)
        gates = _sigmoid(np.add(fed[:, : 2 * h], turned[:, : 2 * h]))
        update, reset = gates[:, :h], gates[:, h:]
        inner = turned[:, 2 * h :]
        inner += self.shift
        new = reset * inner
        new += fed[:, 2 * h :]
        np.tanh(new, out=new)
        after = state - new
        after *= update
        after += new
        if keep is not None:
            after *= np.stack(keep)[:, None, :]
        return after, (state, update, reset, inner, new)

    def _folded(self) -> tuple[np.ndarray, np.ndarray]:
        """Table and recurrent weights with the halves of the gates' hyperbolic tangents folded in.

        The bias inside the reset gate's reach becomes the weight of a state that is always 1.
        """
        h = self.hidden
        half = np.ones((1, 3 * h, 1), np.float32)
        half[:, : 2 * h] = 0.5
        inner = half.copy()
        inner[:, 2 * h :] = 0.5
        turn = np.concatenate((self.turn, np.zeros((2, 3 * h, 1), np.float32)), axis=2)
        turn[:, 2 * h :, h:] = self.shift
        return np.ascontiguousarray(self.table * half), np.ascontiguousarray(turn * inner)

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        """``(position, label, window)`` of windows given as ``(position, window)`` bytes, ``PAD`` behind the end.

        The same steps as ``_step``, in buffers that are made once.
        """
        steps, n = windows.shape
        h, (table, turn) = self.hidden, self._folded()
        state, fed = np.zeros((2, h + 1, n), np.float32), np.empty((2, 3 * h, n), np.float32)
        state[:, h] = 1
        turned, labelled = np.empty((2, 3 * h, n), np.float32), np.empty((2, self.labels, n), np.float32)
        old, gates, inner, moved = state[:, :h], fed[:, : 2 * h], turned[:, 2 * h :], np.empty((2, h, n), np.float32)
        logits = np.empty((steps, self.labels, n), np.float32)
        logits[:] = self.bias
        keep = None if windows.max(initial=0) < PAD else (windows < PAD).astype(np.float32)
        for t in range(steps):
            back = steps - 1 - t
            np.take(table[0], windows[t], axis=1, out=fed[0], mode="clip")
            np.take(table[1], windows[back], axis=1, out=fed[1], mode="clip")
            np.matmul(turn, state, out=turned)
            gates += turned[:, : 2 * h]
            np.tanh(gates, out=gates)
            gates += np.float32(1)
            inner *= gates[:, h:]
            inner += fed[:, 2 * h :]
            np.tanh(inner, out=inner)
            np.subtract(old, inner, out=moved)
            moved *= gates[:, :h]
            moved *= np.float32(0.5)
            np.add(moved, inner, out=old)
            if keep is not None:
                old *= np.stack((keep[t], keep[back]))[:, None, :]
            np.matmul(self.out, old, out=labelled)
            logits[t] += labelled[0]
            logits[back] += labelled[1]
        logits -= logits.max(axis=1, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(axis=1, keepdims=True)
        return logits

    def slopes(self, windows: np.ndarray, label: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean loss over letter positions and its derivatives, by backpropagation through time."""
        steps, n = windows.shape
        h, weight = self.hidden, _LETTER[windows].astype(np.float32)
        weight /= max(weight.sum(), 1)
        keep = (windows < PAD).astype(np.float32)
        states, kept, state = [], [], np.zeros((2, h, n), np.float32)
        logits = np.zeros((steps, self.labels, n), np.float32) + self.bias
        for t in range(steps):
            back = steps - 1 - t
            state, parts = self._step(state, (windows[t], windows[back]), (keep[t], keep[back]))
            states.append(state)
            kept.append(parts)
            labelled = np.matmul(self.out, state)
            logits[t] += labelled[0]
            logits[back] += labelled[1]
        logits -= logits.max(axis=1, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(axis=1, keepdims=True)
        loss = float(-(weight * np.log(np.maximum(p[:, label, np.arange(n)], 1e-9))).sum())
        p[:, label, np.arange(n)] -= 1
        p *= weight[:, None, :]
        d_turn, d_shift, d_out = np.zeros_like(self.turn), np.zeros_like(self.shift), np.zeros_like(self.out)
        fed = np.empty((steps, 2, 3 * h, n), np.float32)
        ahead = np.zeros((2, h, n), np.float32)
        for t in range(steps - 1, -1, -1):
            back = steps - 1 - t
            wrong = np.stack((p[t], p[back]))
            d_out += np.matmul(wrong, states[t].transpose(0, 2, 1))
            ahead += np.matmul(self.out.transpose(0, 2, 1), wrong)
            ahead *= np.stack((keep[t], keep[back]))[:, None, :]
            before, update, reset, inner, new = kept[t]
            candidate = ahead * (1 - update) * (1 - new * new)
            recurrent = np.empty((2, 3 * h, n), np.float32)
            recurrent[:, :h] = ahead * (before - new) * update * (1 - update)
            recurrent[:, h : 2 * h] = candidate * inner * reset * (1 - reset)
            recurrent[:, 2 * h :] = candidate * reset
            fed[t, :, : 2 * h], fed[t, :, 2 * h :] = recurrent[:, : 2 * h], candidate
            d_turn += np.matmul(recurrent, before.transpose(0, 2, 1))
            d_shift += recurrent[:, 2 * h :].sum(axis=2, keepdims=True)
            ahead = ahead * update + np.matmul(self.turn.transpose(0, 2, 1), recurrent)
        d_table = np.empty_like(self.table)
        for side, seen in enumerate((windows, windows[::-1])):
            for row in range(3 * h):
                d_table[side, row] = np.bincount(seen.ravel(), fed[:, side, row].ravel(), PAD + 1)
        return loss, [d_table, d_turn, d_shift, d_out, p.sum(axis=(0, 2))[:, None]]

    def fit(self, windows: np.ndarray, label: np.ndarray, steps: int = 150, batch: int = 128, rate: float = 0.01, seed: int = 6) -> Network:
        """Adam over shuffled batches; the rate falls to zero over the steps."""
        draw, order = np.random.default_rng(seed), np.zeros(0, np.int64)
        first = [np.zeros_like(getattr(self, name)) for name in self.NAMES]
        second = [np.zeros_like(m) for m in first]
        for step in range(1, steps + 1):
            if len(order) < batch:
                order = np.concatenate((order, draw.permutation(len(label))))
            some, order = order[:batch], order[batch:]
            _, slopes = self.slopes(np.ascontiguousarray(windows[some].T), label[some])
            size = max(1.0, float(np.sqrt(sum(float((g * g).sum()) for g in slopes))))
            speed = np.float32(rate * (1 - (step - 1) / steps))
            for name, g, m, v in zip(self.NAMES, slopes, first, second):
                g = (g / size).astype(np.float32)
                m += np.float32(0.1) * (g - m)
                v += np.float32(0.001) * (g * g - v)
                setattr(self, name, getattr(self, name) - speed * (m / np.float32(1 - 0.9**step)) / (np.sqrt(v / np.float32(1 - 0.999**step)) + np.float32(1e-8)))
        return self


def windows_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte and owning text of every window; a text's last window may be short."""
    size = np.diff(offsets)
    count = -(-size // WINDOW)
    owner = np.repeat(np.arange(len(size)), count)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    return offsets[:-1][owner] + place * WINDOW, owner


def _cut(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """``(window, position)`` bytes, ``PAD`` behind a text's end."""
    at = start[:, None] + np.arange(WINDOW)
    inside = at < end[:, None]
    return np.where(inside, data[np.where(inside, at, 0)].astype(np.int16), PAD).astype(np.int16)


def pooled(network: Network, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Mean probability per label over the letter positions of each text."""
    texts = len(offsets) - 1
    total, positions = np.zeros((texts, network.labels)), np.zeros(texts)
    start, owner = windows_of(data, offsets)
    full = start + WINDOW <= offsets[1:][owner]
    for some in (np.flatnonzero(full), np.flatnonzero(~full)):
        for low in range(0, len(some), AT_ONCE):
            which = some[low : low + AT_ONCE]
            cut = np.ascontiguousarray(_cut(data, start[which], offsets[1:][owner[which]]).T)
            weight = _LETTER[cut].astype(np.float32)
            labelled = np.einsum("tln,tn->nl", network.probabilities(cut), weight)
            for k in range(network.labels):
                total[:, k] += np.bincount(owner[which], labelled[:, k], texts)
            positions += np.bincount(owner[which], weight.sum(axis=0), texts)
    return total / np.maximum(positions, 1)[:, None]


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """At most ``MOST_WINDOWS`` windows of each text, evenly spread over all of it."""
    for batch in batches:
        for low, high, data, offsets in chunks(batch.column("text")):
            start, owner = windows_of(data, offsets)
            count = np.bincount(owner, minlength=high - low)
            place = np.arange(len(start)) - np.repeat(np.cumsum(count) - count, count)
            step = -(-count // MOST_WINDOWS)
            held = place % step[owner] == step[owner] // 2
            cut = _cut(data, start[held], offsets[1:][owner[held]])
            yield pa.RecordBatch.from_arrays([batch.column("lang").take(pa.array(low + owner[held])), pa.array([row.tobytes() for row in cut], pa.binary())], ["lang", "bytes"])


def training_windows(documents: DataFrame, held_out: Column) -> DataFrame:
    """``lang, bytes`` of a bounded sample: ``MOST_ROWS`` documents of a language by a hash.

    A filter at twice the rate that a language needs goes first, so no language's rows meet
    in one task; the exact cut is made among what is left.
    """
    known = documents.filter(~held_out & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text", row_key("doc_id", "text").alias("name"))
    sizes = known.groupBy("lang").agg(F.count("*").alias("n"))
    chance = F.pmod("name", F.lit(1 << 30)) / F.lit(float(1 << 30))
    near = known.join(F.broadcast(sizes), "lang").filter(chance * F.col("n") < 2.0 * MOST_ROWS)
    return near.withColumn("rank", F.expr("row_number() OVER (PARTITION BY lang ORDER BY pmod(name, 1L << 30), name, text)")).filter(F.col("rank") <= MOST_ROWS).select(
        "lang", "text").mapInArrow(_sampled, "lang string, bytes binary")


def language_ids(documents: DataFrame, held_out: Column) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for every document's whole text.

    The network learns from at most ``MOST_WINDOWS`` windows of each of at most ``MOST_ROWS``
    documents of a language, picked by a hash of id and text among rows outside ``held_out``
    whose ``lang`` is not null; the number of languages is the size of the model and fits the
    driver.  Null ids are never learned from and count as not held out.  A text that is null,
    empty or without letters is ``und`` with score 0; so is every text where nothing can be
    learned.  Ties go to the smaller language value.  Repeated rows each give their row.
    Columns beside ``doc_id``, ``text`` and ``lang`` are not read.
    """
    rows = documents.select("doc_id", "text", "lang")
    taught = training_windows(rows, held_out).orderBy("lang", "bytes").toPandas()
    names = sorted(taught["lang"].unique())
    network = Network(max(len(names), 1))
    if len(names) > 1:
        cut = np.frombuffer(b"".join(taught["bytes"]), np.int16).reshape(-1, WINDOW)
        network.fit(cut, np.searchsorted(np.array(names, object), taught["lang"].to_numpy(object)))

    def run(batches):
        for batch in batches:
            for low, high, data, offsets in chunks(batch.column("text")):
                share = pooled(network, data, offsets)
                best = share.argmax(axis=1)
                known = batch.column("letters").slice(low, high - low).to_numpy(zero_copy_only=False) & bool(names)
                score = np.where(known, np.clip(share[np.arange(len(best)), best], 0, 1), 0.0)
                label = [names[k] if ok else "und" for k, ok in zip(best, known)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(low, high - low), batch.column("held_out").slice(low, high - low),
                                                  pa.array(label, pa.string()), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    asked = rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), letters.alias("letters"), "text")
    return asked.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
