"""Word postings packed by hash bucket, so that a shuffle moves a few dense blocks.

A task gathers (text, word, times) for some megabytes of texts, sorts them by word and
writes one row per bucket: sorted hashes as byte-sliced differences, places in the block's
list of texts, and optionally the distinct words themselves.  Answers go back per block, as
one array over its texts.  A block is named by its texts' content keys; partitions are read
in order of those keys, so a task that runs again after a lost executor makes equal blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

POSTINGS_AT_ONCE = 1_000_000


def pack(values: np.ndarray) -> bytes:
    """Bytes of an integer array, sliced by significance and compressed."""
    values = np.ascontiguousarray(values)
    sliced = values.view(np.uint8).reshape(len(values), values.dtype.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(sliced).tobytes())


def unpack(data: bytes, kind) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data, max_output_size=1 << 31), np.uint8)
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(width, -1).T).view(kind).reshape(-1)


def pack_sorted(values: np.ndarray) -> bytes:
    """Ascending unsigned values as differences."""
    values = values.astype(np.uint64)
    return pack(np.diff(values, prepend=np.uint64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data, np.uint64), dtype=np.uint64)


def grouped(*columns: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """Distinct rows in ascending order of ``columns`` (first one first) and summed weights."""
    n = len(columns[0])
    if len(columns) == 1 and weight is None:
        value = np.sort(columns[0])
        at = np.flatnonzero(np.concatenate((np.ones(min(n, 1), bool), value[1:] != value[:-1])))
        return value[at], np.diff(np.append(at, n))
    order = np.lexsort(columns[::-1]) if len(columns) > 1 else np.argsort(columns[0], kind="stable")
    columns = tuple(c[order] for c in columns)
    new = np.ones(n, bool)
    if n:
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    at = np.flatnonzero(new)
    weight = np.ones(n, np.int64) if weight is None else weight[order]
    total = np.add.reduceat(weight, at) if n else weight
    return *[c[at] for c in columns], total


def bucket_of(values: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket by the high bits: ascending values stay in one ascending run per bucket."""
    return ((values >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def bucket_rows(value: np.ndarray, text: np.ndarray, times: np.ndarray, keys: np.ndarray, bucket: np.ndarray) -> Iterator[tuple[int, dict]]:
    """Postings ordered by (bucket, value, text) as one packed block per bucket."""
    edges = np.flatnonzero(np.diff(bucket, prepend=-1, append=-1)) if len(bucket) else []
    for low, high in zip(edges[:-1], edges[1:]):
        used, place = np.unique(text[low:high], return_inverse=True)
        yield int(bucket[low]), {
            "hashes": pack_sorted(value[low:high]), "places": pack(place.astype(np.uint32)),
            "times": pack(times[low:high].astype(np.uint32)), "keys": keys[used].astype(np.int64).tobytes(),
        }


def read_row(hashes: bytes, places: bytes, times: bytes, keys: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    return unpack_sorted(hashes), unpack(places, np.uint32).astype(np.int64), unpack(times, np.uint32).astype(np.int64), np.frombuffer(keys, np.int64)


BLOCK_FIELDS = ["hashes", "places", "times", "more", "keys"]
BLOCK = "bucket int, block long, hashes binary, places binary, times binary, more binary, keys binary"


def posted(make, place, buckets: int, encode=pack_sorted, extra=None, at_once: int = POSTINGS_AT_ONCE):
    """``make`` gives (value, row, times, keys, with_it) for parts of a batch; they leave in blocks.

    A value is a number, or a row of numbers where ``encode`` takes such.
    A block has a row per bucket of ``place`` and one with its keys.  ``with_it`` is None, the
    function that tells the bytes of a posting's word (the row then has the distinct words,
    and where a new one begins in place of values), or an array with an id per text (the row
    then has the ids of its texts).  ``extra`` makes more rows from (value, times): (bucket, bytes).
    """

    def block(parts, keys):
        value, text, times = (np.concatenate(x) for x in zip(*[p[:3] for p in parts]))
        bucket = place(value)
        order = np.lexsort((text, *(value.T[::-1] if value.ndim == 2 else [value]), bucket))
        keys, own = np.concatenate(keys).tobytes(), [p[3] for p in parts]
        name = int.from_bytes(hashlib.blake2b(keys, digest_size=8).digest(), "little", signed=True)
        rows = [(name % buckets, None, None, None, None, keys)]
        if extra is not None:
            rows += [(b, None, None, None, data, None) for b, data in extra(value, times)]
        worded = callable(own[0])
        if worded:
            owner = np.repeat(np.arange(len(parts)), [len(p[0]) for p in parts])
            inner = np.concatenate([np.arange(len(p[0])) for p in parts])
        elif own[0] is not None:
            ids = np.concatenate(own)
        value, text, times, bucket = value[order], text[order], times[order], bucket[order]
        edges = np.flatnonzero(np.diff(bucket, prepend=-1, append=-1))
        for low, high in zip(edges[:-1], edges[1:]):
            held, more = value[low:high], None
            if worded:
                new = np.diff(held, prepend=~held[:1]) != 0
                first = order[low + np.flatnonzero(new)]
                more = zstandard.ZstdCompressor(level=3).compress(b"\n".join([own[owner[i]](inner[i]) for i in first]))
                packed = pack(new.astype(np.uint8))
            else:
                packed = encode(held)
                if own[0] is not None:
                    more = pack(ids[np.unique(text[low:high])])
            rows.append((int(bucket[low]), packed, pack(text[low:high].astype(np.uint32)), pack(times[low:high].astype(np.uint32)), more, None))
        buckets_of, *fields = zip(*rows)
        return pa.RecordBatch.from_arrays([pa.array(buckets_of, pa.int32()), pa.array([name] * len(rows), pa.int64()), *[pa.array(f, pa.binary()) for f in fields]],
                                          ["bucket", "block", *BLOCK_FIELDS])

    def run(batches):
        parts, keys, texts, held = [], [], 0, 0
        for batch in batches:
            for value, row, times, key, with_it in make(batch):
                parts.append((value, row + texts, times, with_it))
                keys.append(key)
                texts, held = texts + len(key), held + len(value)
                if held >= at_once:
                    yield block(parts, keys)
                    parts, keys, texts, held = [], [], 0, 0
        if texts:
            yield block(parts, keys)

    return run


def answer(block: int, keys: bytes | None, sums: list[np.ndarray]) -> pa.RecordBatch:
    """One row: a block's keys, or arrays with a value for each of its first texts."""
    kinds = [x.dtype.str for x in sums]
    assert all(k in ("<f4", "<u4") for k in kinds)
    return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([keys], pa.binary()), pa.array([[pack(x) for x in sums]], pa.list_(pa.binary()))], ["block", "keys", "sums"])


ANSWER = "block long, keys binary, sums array<binary>"


def summed(answers: DataFrame, width: int, columns: dict[str, str]) -> DataFrame:
    """``key`` and the sums over a block's answers, a row per text; ``columns``: name to f4 or u4."""
    schema = "key long, " + ", ".join(f"{n} {'double' if k == 'f4' else 'long'}" for n, k in columns.items())

    def run(batches):
        keys: dict[int, np.ndarray] = {}
        totals: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for row in batch.to_pylist():
                if row["keys"] is not None:
                    # Equal blocks (repeated rows) have equal keys: the sums of both are there.
                    keys[row["block"]] = np.frombuffer(row["keys"], np.int64)
                    continue
                each = totals.setdefault(row["block"], [np.zeros(0, float if k == "f4" else np.int64) for k in columns.values()])
                for i, kind in enumerate(columns.values()):
                    more = unpack(row["sums"][i], np.dtype(kind)).astype(each[i].dtype)
                    if len(more) > len(each[i]):
                        each[i], more = more, each[i]
                    each[i] = each[i] + np.pad(more, (0, len(each[i]) - len(more)))
        for name, key in keys.items():
            each = totals.get(name, [np.zeros(0, float if k == "f4" else np.int64) for k in columns.values()])
            yield pa.RecordBatch.from_arrays([pa.array(key), *[pa.array(np.pad(x, (0, len(key) - len(x)))) for x in each]], ["key", *columns])

    return answers.repartition(width, "block").mapInArrow(run, schema)
