"""Substring dedup: anchors at difference-cover places find shared windows, hashes settle them."""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspan.llm.packing import BLOCK, bucket_of, pack, posted, unpack, unpack_sorted
from shelfspan.llm.words import Words, chunks, row_key, shuffle_width, windows

PERIOD = 31
#: A set whose differences give every remainder modulo PERIOD once.
COVER = (1, 5, 11, 24, 25, 27)
_IN_COVER = np.isin(np.arange(PERIOD), COVER)
_LAST = np.iinfo(np.int64).max


def _ids(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return batch.column("key").to_numpy(), batch.column("doc_id").fill_null(_LAST).to_numpy()


def _inner(w: Words, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """Place of each word in its text, and the words after it there (itself included)."""
    count = w.counts(texts)
    place = np.arange(len(w)) - np.repeat(np.cumsum(count) - count, count)
    return place, np.repeat(count, count) - place


def _anchors(n: int):
    size = n - PERIOD + 1

    def emit(batch):
        keys, docs = _ids(batch)
        for low, high, data, offsets in chunks(batch.column("text")):
            w = Words(data, offsets)
            place, left = _inner(w, high - low)
            gram = windows(w.hash, size)
            at = np.flatnonzero((left[: len(gram)] >= size) & _IN_COVER[place[: len(gram)] % PERIOD])
            yield gram[at], w.text[at], place[at], keys[low:high], docs[low:high]

    return emit


def _windows(n: int):
    """Whole windows that hold a shared anchor at an offset below the period."""

    def emit(batch):
        keys, docs = _ids(batch)
        found = batch.column("found").to_pylist()
        for low, high, data, offsets in chunks(batch.column("text")):
            w = Words(data, offsets)
            place, left = _inner(w, high - low)
            gram = windows(w.hash, n)
            begin = np.searchsorted(w.text, np.arange(high - low))
            edge = np.zeros(len(w) + 1, np.int64)
            for i in range(high - low):
                spots = np.concatenate([unpack(x, np.uint32) for x in found[low + i]]).astype(np.int64)
                np.add.at(edge, begin[i] + np.maximum(spots - PERIOD + 1, 0), 1)
                np.add.at(edge, begin[i] + spots + 1, -1)
            near = np.cumsum(edge[: len(gram)]) > 0
            at = np.flatnonzero(near & (left[: len(gram)] >= n))
            yield gram[at], w.text[at], place[at], keys[low:high], docs[low:high]

    return emit


def _settle(kept):
    """Postings of values that pass ``kept(doc, least, most)``, as packed places and spots per block."""

    def run(batches):
        held, value, doc = [], [], []
        for batch in batches:
            for row in batch.to_pylist():
                if row["keys"] is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([row["block"]]), pa.array([row["keys"]]), pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary())],
                                                     ["block", "keys", "places", "spots"])
                    continue
                place = unpack(row["places"], np.uint32)
                value.append(unpack_sorted(row["hashes"]))
                doc.append(unpack(row["more"], np.int64)[np.unique(place, return_inverse=True)[1]])
                held.append((row["block"], row["places"], row["times"]))
        if not held:
            return
        size = np.cumsum([len(v) for v in value])
        value, doc = np.concatenate(value), np.concatenate(doc)
        order = np.argsort(value, kind="stable")
        first = np.flatnonzero(np.diff(value[order], prepend=~value[order][:1]) != 0)
        times = np.diff(np.append(first, len(value)))
        least, most = np.empty_like(doc), np.empty_like(doc)
        least[order], most[order] = np.repeat(np.minimum.reduceat(doc[order], first), times), np.repeat(np.maximum.reduceat(doc[order], first), times)
        good = kept(doc, least, most)
        for (block, places, spots), mine in zip(held, np.split(good, size[:-1])):
            if mine.any():
                packed = [pack(unpack(x, np.uint32)[mine]) for x in (places, spots)]
                yield pa.RecordBatch.from_arrays([pa.array([block]), pa.nulls(1, pa.binary()), *[pa.array([x]) for x in packed]], ["block", "keys", "places", "spots"])

    return run


def _per_text(batches):
    """The spots of each text, from the answers to its block."""
    keys: dict[int, bytes] = {}
    found: dict[int, list] = {}
    for batch in batches:
        for row in batch.to_pylist():
            if row["keys"] is not None:
                keys[row["block"]] = row["keys"]
            else:
                found.setdefault(row["block"], []).append((row["places"], row["spots"]))
    for block, parts in found.items():
        place, spot = (np.concatenate([unpack(p[i], np.uint32) for p in parts]) for i in range(2))
        order = np.lexsort((spot, place))
        place, spot = place[order], spot[order]
        edges = np.flatnonzero(np.diff(place.astype(np.int64), prepend=-1, append=-1))
        key = np.frombuffer(keys[block], np.int64)[place[edges[:-1]]]
        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array([pack(spot[a:b]) for a, b in zip(edges[:-1], edges[1:])], pa.binary())], ["key", "spots"])


def _answers(texts: DataFrame, make, kept, width: int) -> DataFrame:
    blocks = texts.sortWithinPartitions("key").mapInArrow(posted(make, lambda v: bucket_of(v, width), width), BLOCK)
    settled = blocks.repartition(width, "bucket").mapInArrow(_settle(kept), "block long, keys binary, places binary, spots binary")
    each = settled.repartition(width, "block").mapInArrow(_per_text, "key long, spots binary")
    return each.groupBy("key").agg(F.collect_set("spots").alias("found"))


def _kept_text(n: int):
    def run(batch):
        removed = batch.column("found").to_pylist()
        total, gone, digest = [], [], []
        for text, found in zip(batch.column("text").to_pylist(), removed):
            words = (text or "").encode().split()
            total.append(len(words))
            if found:
                edge = np.zeros(len(words) + 1, np.int64)
                begins = np.unique(np.concatenate([unpack(x, np.uint32) for x in found])).astype(np.int64)
                np.add.at(edge, begins, 1)
                np.add.at(edge, begins + n, -1)
                keep = np.cumsum(edge[:-1]) == 0
                words = list(compress(words, keep))
            gone.append(total[-1] - len(words))
            digest.append(hashlib.sha256(b" ".join(words)).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(digest, pa.string())],
                                         ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return run


def duplicate_windows(documents: DataFrame, n: int = 50) -> DataFrame:
    """``key, found``: per text the packed starts of windows that also start in a document
    with a smaller id.  ``documents`` has ``key``, ``doc_id`` (whole numbers) and ``text``."""
    width = shuffle_width(documents.sparkSession)
    shared = _answers(documents.select("key", "doc_id", "text"), _anchors(n), lambda doc, least, most: least < most, width)
    near = documents.join(shared, "key").select("key", "doc_id", "text", "found")
    return _answers(near, _windows(n), lambda doc, least, most: doc > least, width)


def substring_dedup(documents: DataFrame, n: int = 50) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256``, one row per document.

    A word goes when a window of ``n`` words that covers it also starts in a document with a
    smaller id.  Windows of a document repeated only inside it, or in rows of the same id,
    stay.  Null ids count as the largest and null texts as empty; a text shorter than ``n``
    words keeps all.  Any two equal windows hold the same ``n - 30`` words at one offset
    whose place is in the cover in both texts, so only texts with such a shared anchor have
    windows hashed.  Repeated rows give equal results each.
    """
    if n < PERIOD:
        raise ValueError(f"windows of at least {PERIOD} words are needed")
    keyed = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", row_key("doc_id", "text").alias("key"))
    joined = keyed.join(duplicate_windows(keyed, n), "key", "left").select("doc_id", "text", "found")

    def run(batches):
        for batch in batches:
            yield from _kept_text(n)(batch)

    return joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")
