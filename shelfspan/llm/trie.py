"""A compact n-gram trie: Elias-Fano levels, quantised log probabilities, one byte buffer.

Levels of a shard (contexts read from the last word back):

    last word  ->  successors (bigrams)
               ->  word before it  ->  successors (trigrams)

Every level is one monotone sequence: an entry is ``rank of its parent * width + word``, so
a range of children starts at an Elias-Fano pointer and is searched relative to its parent.
"""

from __future__ import annotations

import json
import tempfile

import numpy as np


def quantised(logs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One byte per value and the 256 means that the bytes stand for."""
    if not len(logs):
        return np.zeros(0, np.uint8), np.zeros(256, np.float32)
    edges = np.unique(np.quantile(logs, np.linspace(0, 1, 257)[1:-1]))
    code = np.searchsorted(edges, logs, "left").astype(np.uint8)
    size = np.bincount(code, minlength=256)
    return code, (np.bincount(code, logs, 256) / np.maximum(size, 1)).astype(np.float32)


class EliasFano:
    """A non-decreasing sequence: low bits packed, high bits in unary; spread out once when mapped."""

    def __init__(self, bits: int, size: int, low: np.ndarray, high: np.ndarray):
        self.size = size
        self.value = (np.flatnonzero(np.unpackbits(high)) - np.arange(size)) << bits
        row = (size + 7) // 8
        for b in range(bits):
            self.value |= np.unpackbits(low[b * row : (b + 1) * row], count=size).astype(np.int64) << b

    @staticmethod
    def packed(values: np.ndarray) -> tuple[dict, list[np.ndarray]]:
        n = len(values)
        top = int(values[-1]) + 1 if n else 1
        bits = max(int(np.log2(top / n)), 0) if n else 0
        low = values & ((1 << bits) - 1)
        planes = np.concatenate([np.zeros(0, np.uint8), *[np.packbits(((low >> b) & 1).astype(np.uint8)) for b in range(bits)]])
        unary = np.zeros(n + (top >> bits) + 1, np.uint8)
        unary[(values >> bits) + np.arange(n)] = 1
        return {"bits": bits, "size": n}, [planes, np.packbits(unary)]

    def at(self, i: np.ndarray) -> np.ndarray:
        return self.value[i]

    def find(self, low: np.ndarray, high: np.ndarray, value: np.ndarray) -> np.ndarray:
        """Place of ``value`` in ``[low, high)`` for each query, -1 where it is missing.

        Entries of earlier parents are smaller and of later ones larger, so the successor in
        the whole level is the successor within the parent's range, if that has one.
        """
        spot = np.searchsorted(self.value, value)
        hit = (spot >= low) & (spot < high)
        hit[hit] = self.value[spot[hit]] == value[hit]
        return np.where(hit, spot, -1)


def _ranges(parent: np.ndarray) -> np.ndarray:
    """Start of each run of equal parents, and the end."""
    return np.append(np.flatnonzero(np.diff(parent, prepend=-1) != 0), len(parent))


def built(last: np.ndarray, follow: np.ndarray, pair_counts: np.ndarray, context: np.ndarray, follow3: np.ndarray, triple_counts: np.ndarray, single: np.ndarray, width: int) -> bytes:
    """A shard from ascending pairs (last, next) and trigrams (context ``last * width + before``, next).

    Interpolated Witten-Bell smoothing; ``single`` has the probability of each pair's next
    word alone.  Words are numbers below ``width``.
    """
    edge = _ranges(last)
    total, kinds = np.add.reduceat(pair_counts, edge[:-1]), np.diff(edge)
    rank = np.repeat(np.arange(len(kinds)), kinds)
    p2 = (pair_counts + kinds[rank] * single) / (total + kinds)[rank]
    edge3 = _ranges(context)
    total3, kinds3 = np.add.reduceat(triple_counts, edge3[:-1]), np.diff(edge3)
    rank3 = np.repeat(np.arange(len(kinds3)), kinds3)
    lower = p2[np.searchsorted(last * width + follow, (context // width) * width + follow3)]
    p3 = (triple_counts + kinds3[rank3] * lower) / (total3 + kinds3)[rank3]
    names = context[edge3[:-1]]
    rank_of = np.searchsorted(last[edge[:-1]], names // width)
    levels = {
        "last": last[edge[:-1]], "pairs_at": edge, "pairs": rank * width + follow,
        "before_at": np.searchsorted(rank_of, np.arange(len(kinds) + 1)), "before": rank_of * width + names % width,
        "triples_at": edge3, "triples": rank3 * width + follow3,
    }
    logs = {"pairs": np.log10(p2), "last": np.log10(kinds / (total + kinds)), "triples": np.log10(p3), "before": np.log10(kinds3 / (total3 + kinds3))}
    head, body, at = {"width": width}, [], 0

    def put(array: np.ndarray) -> list[int]:
        nonlocal at
        body.append(array.tobytes())
        at += len(body[-1])
        return [at - len(body[-1]), at]

    for name, values in levels.items():
        shape, arrays = EliasFano.packed(values.astype(np.int64))
        head[name] = shape | {"spans": [put(a) for a in arrays]}
    for name, values in logs.items():
        code, means = quantised(values)
        head[f"log_{name}"] = {"spans": [put(code), put(means)]}
    start = json.dumps(head).encode()
    return len(start).to_bytes(8, "little") + start + b"".join(body)


class Shard:
    """A built shard, mapped from an unnamed scratch file of the task's own node."""

    def __init__(self, data: bytes):
        self.file = tempfile.TemporaryFile()
        self.file.write(data)
        self.file.flush()
        raw = np.memmap(self.file, np.uint8, "r")
        start = int.from_bytes(raw[:8].tobytes(), "little")
        head = json.loads(raw[8 : 8 + start].tobytes())
        self.width = head.pop("width")
        span = lambda s: raw[8 + start + s[0] : 8 + start + s[1]]
        self.level = {k: EliasFano(v["bits"], v["size"], *map(span, v["spans"])) for k, v in head.items() if "bits" in v}
        self.code = {k[4:]: (span(v["spans"][0]), np.frombuffer(span(v["spans"][1]).tobytes(), np.float32)) for k, v in head.items() if "bits" not in v}

    def _log(self, name: str, i: np.ndarray) -> np.ndarray:
        code, means = self.code[name]
        return means[code[i]].astype(float)

    def log10(self, before: np.ndarray, last: np.ndarray, follow: np.ndarray, single: np.ndarray) -> np.ndarray:
        """log10 probability of ``follow`` after ``before, last``; ``single``: of it alone."""
        v, n = self.level, len(last)
        out = single.copy()
        rank = v["last"].find(np.zeros(n, np.int64), np.full(n, v["last"].size), last)
        at = np.flatnonzero(rank >= 0)
        rank = rank[at]
        spot = v["pairs"].find(v["pairs_at"].at(rank), v["pairs_at"].at(rank + 1), rank * self.width + follow[at])
        seen = spot >= 0
        out[at[seen]] = self._log("pairs", spot[seen])
        out[at[~seen]] += self._log("last", rank[~seen])
        context = v["before"].find(v["before_at"].at(rank), v["before_at"].at(rank + 1), rank * self.width + before[at])
        at, context = at[context >= 0], context[context >= 0]
        spot = v["triples"].find(v["triples_at"].at(context), v["triples_at"].at(context + 1), context * self.width + follow[at])
        seen = spot >= 0
        out[at[seen]] = self._log("triples", spot[seen])
        out[at[~seen]] += self._log("before", context[~seen])
        return out
