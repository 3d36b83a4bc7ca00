"""Words of Arrow text columns as numpy arrays, and small helpers shared by the operators.

Inside a task a column of texts is one byte buffer with offsets, so words are found and
hashed for many texts at once without a Python object per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_BYTES = 1 << 20
_U = np.uint64
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Letters, digits and every byte of a non-ASCII character.
_PLAIN = np.array([chr(i).isalnum() or i >= 0x80 for i in range(256)])
_BYTE = np.random.default_rng(20260701).integers(1, 2**63, 256, dtype=np.uint64) | _U(1)
_LOWER = _BYTE.copy()
_LOWER[65:91] = _BYTE[97:123]
_STEP = _U(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values; equal in, equal out."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(step: int, n: int) -> np.ndarray:
    """``step`` to the powers 0, 1, ... modulo 2 ** 64."""
    out = np.full(n, step, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


#: Bytes that are hashed at a time: their numbers stay in a core's cache.
_SPAN = 1 << 14
_POW, _BACK = _powers(int(_STEP), 2 * _SPAN), _powers(pow(int(_STEP), -1, 1 << 64), 2 * _SPAN)


def _word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Sum of each word's bytes as ``table`` has them, times powers of the step from its first byte on.

    ``table`` has 0 for bytes between words.  Powers run on over a span, and a word's sum is taken
    back by the power at its first byte.
    """
    global _POW, _BACK
    out = np.zeros(len(start), np.uint64)
    low = 0
    while low < len(start):
        begin = int(start[low])
        high = int(np.searchsorted(start, begin + _SPAN))
        wide = int(end[high - 1]) - begin
        if wide > len(_POW):
            _POW, _BACK = (_powers(int(x[1]), 2 * wide) for x in (_POW, _BACK))
        each = table[data[begin : begin + wide]]
        each *= _POW[:wide]
        at = start[low:high] - begin
        out[low:high] = np.add.reduceat(each, at) * _BACK[at]
        low = high
    return mixed(out * _STEP)


class Words:
    """Words of some texts in order: owning text, hash, first byte and length in bytes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False, plain: bool = False):
        inside = _PLAIN[data] if plain else ~_BLANK[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        start, end = edge[:-1].copy(), edge[1:].copy()
        start[1:] |= ~inside[:-1]
        end[:-1] |= ~inside[1:]
        self.data = data
        self.start = np.flatnonzero(inside & start)
        end = np.flatnonzero(inside & end) + 1
        self.length = end - self.start
        self.text = np.repeat(np.arange(len(offsets) - 1), np.diff(np.searchsorted(self.start, offsets)))
        self.hash = _word_hashes(data, self.start, end, np.where(_PLAIN if plain else ~_BLANK, _LOWER if lower else _BYTE, _U(0)))

    def __len__(self) -> int:
        return len(self.hash)

    def word(self, i: int) -> bytes:
        return self.data[self.start[i] : self.start[i] + self.length[i]].tobytes()

    def counts(self, texts: int) -> np.ndarray:
        return np.bincount(self.text, minlength=texts)


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row ranges of a text column with their bytes and offsets, about ``limit`` bytes each.

    A text longer than the limit is a chunk of its own; null counts as empty.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_string())
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    low, n = 0, len(column)
    while low < n:
        high = max(int(np.searchsorted(offsets, offsets[low] + limit, "right")) - 1, low + 1)
        high = min(high, n)
        yield low, high, data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
        low = high


def windows(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of every ``n`` consecutive words of a flat array (the last n-1 places are missing)."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    out, done, span, level = None, 0, 1, words
    left = n
    while left:
        if left & 1:
            piece = level[done : done + len(words) - n + 1]
            out = mixed(piece + _STEP) if out is None else mixed(out * _U(0xD6E8FEB86659FD93) + piece)
            done += span
        left >>= 1
        if left:
            level = mixed(level[:-span] * _U(0xD6E8FEB86659FD93) + level[span:])
            span *= 2
    return out


def shingle_sets(w: Words, texts: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ``n``-word shingles of each text as (text, hash), sorted by text and hash.

    A text with fewer words has its whole sequence as one shingle, without words none.
    """
    count = w.counts(texts)
    grams = windows(w.hash, n)
    begin = np.concatenate(([0], np.cumsum(count)))[:-1]
    whole = w.text[: len(grams)] == w.text[n - 1 :] if len(grams) else np.zeros(0, bool)
    owner, value = w.text[: len(grams)][whole], grams[whole]
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        extra = np.array([windows(w.hash[begin[t] : begin[t] + count[t]], int(count[t]))[0] for t in short], np.uint64)
        owner, value = np.concatenate((owner, short)), np.concatenate((value, extra ^ _U(0x5BD1E995)))
        order = np.argsort(owner, kind="stable")
        owner, value = owner[order], value[order]
    edges = np.flatnonzero(np.diff(owner, prepend=-1, append=-1)).tolist()
    for low, high in zip(edges[:-1], edges[1:]):
        value[low:high].sort()
    keep = np.ones(len(owner), bool)
    keep[1:] = (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])
    return owner[keep], value[keep]


def row_key(*names: str) -> Column:
    """A 64-bit key of a row's content; rows equal in ``names`` share it and get equal results."""
    return F.xxhash64(*[F.struct(F.col(n).isNull(), F.col(n)) for n in names])


def per_text(df: DataFrame, function, schema: str) -> DataFrame:
    """``mapInArrow`` over batches, for functions from one record batch to record batches."""

    def run(batches):
        for batch in batches:
            yield from function(batch)

    return df.mapInArrow(run, schema)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
