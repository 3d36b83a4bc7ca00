"""Benchmark decontamination: a BM25 index of test items, block-max bounds, overlap check.

Passages of the documents are the queries and test items the indexed texts.  The index is
the benchmark's postings, cut into slices of bounded size; every task gets a slice and reads
all passages of its documents against it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspan.llm.words import Words, chunks, windows
from shelfspan.session import cut_lineage

K1, B = 1.2, 0.75
BLOCK = 16
#: Words of one index slice: the size bound of what a task is sent.
SLICE_WORDS = 2_000_000


def _item_words(batches):
    for batch in batches:
        for low, high, data, offsets in chunks(batch.column("text")):
            w = Words(data, offsets, lower=True, plain=True)
            cut = np.searchsorted(w.text, np.arange(high - low + 1))
            yield pa.RecordBatch.from_arrays(
                [batch.column("item").slice(low, high - low), pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(w.hash.view(np.int64)))], ["item", "words"])


def indexed(benchmark: DataFrame) -> DataFrame:
    """``item, words, terms, shares``: BM25 weights of an item's terms as shares of its own score."""
    named = benchmark.select(F.col("item_id").cast("long").alias("item"), "text").filter("item IS NOT NULL").distinct()
    items = named.mapInArrow(_item_words, "item long, words array<long>").filter("size(words) > 0").withColumn("id", F.xxhash64("item", "words"))
    count = items.agg(F.count("*").alias("n"), F.avg(F.size("words")).alias("mean"))
    terms = items.select("id", F.size("words").alias("length"), F.explode("words").alias("term")).groupBy("id", "length", "term").agg(F.count("*").alias("times"))
    held = terms.groupBy("term").agg(F.count("*").alias("df"))
    n, mean = count.select("n").scalar(), count.select("mean").scalar()
    weight = F.log1p((n - F.col("df") + 0.5) / (F.col("df") + 0.5)) * F.col("times") * (K1 + 1) / (F.col("times") + K1 * (1 - B + B * F.col("length") / mean))
    weighed = terms.join(held, "term").select("id", "term", weight.alias("weight"))
    own = weighed.groupBy("id").agg(F.sum("weight").alias("own"), F.array_sort(F.collect_list(F.struct("term", "weight"))).alias("each"))
    return items.join(own, "id").select("id", "item", "words", F.col("each.term").alias("terms"), F.transform("each", lambda x: x["weight"] / F.col("own")).alias("shares"))


def _spread(first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places ``first .. first + size`` one after another, and whose they are."""
    owner = np.repeat(np.arange(len(size)), size)
    return np.repeat(first - np.cumsum(size) + size, size) + np.arange(len(owner)), owner


class Index:
    """Postings by term, with the largest share per term and per term and block of items."""

    def __init__(self, rows, share: float, overlap: float, gram: int):
        self.share, self.overlap, self.gram = share, overlap, gram
        self.items = np.array([r["item"] for r in rows], np.int64)
        item = np.repeat(np.arange(len(rows)), [len(r["terms"]) for r in rows])
        term = np.concatenate([np.asarray(r["terms"], np.int64) for r in rows]).view(np.uint64)
        part = np.concatenate([np.asarray(r["shares"], float) for r in rows])
        order = np.lexsort((item, term))
        self.item, self.part, term = item[order], part[order], term[order]
        self.terms, self.first = np.unique(term, return_index=True)
        self.size = np.diff(np.append(self.first, len(term)))
        self.most = np.maximum.reduceat(self.part, self.first)
        block = self.item // BLOCK
        new = np.flatnonzero((np.diff(term, prepend=~term[:1]) != 0) | (np.diff(block, prepend=-1) != 0))
        self.block, self.block_most = block[new], np.maximum.reduceat(self.part, new)
        self.block_first = np.searchsorted(new, self.first)
        self.block_size = np.diff(np.append(self.block_first, len(new)))
        self.blocks = len(rows) // BLOCK + 1
        longest = 1
        self.parts = []
        for r in rows:
            words = np.asarray(r["words"], np.int64).view(np.uint64)
            longest = max(longest, len(words))
            n = min(gram, len(words))
            grams = windows(words, n)
            cut = max(len(grams) * 2 // 3, 1)
            self.parts.append((n, np.unique(grams[:cut]), np.unique(grams[cut:])))
        self.stride = longest

    def found(self, w: Words, texts: int):
        """(text, item, score share, question overlap, answer overlap) of verified passages."""
        count = w.counts(texts)
        begin = np.cumsum(count) - count
        place = np.arange(len(w)) - np.repeat(begin, count)
        code = np.searchsorted(self.terms, w.hash)
        code[code == len(self.terms)] = 0
        at = np.flatnonzero(self.terms[code] == w.hash) if len(w) else np.zeros(0, np.int64)
        code, text, place = code[at], w.text[at], place[at]
        cells = -(-np.maximum(count, 1) // self.stride)
        base = np.cumsum(cells) - cells
        cell = base[text] + place // self.stride
        # Passage p of a text is cells p and p + 1: any stretch as long as an item lies in one.
        inside = np.concatenate((cell, cell[place >= self.stride] - 1))
        code = np.concatenate((code, code[place >= self.stride]))
        pair = np.unique(inside.astype(np.uint64) << np.uint64(32) | code.astype(np.uint64))
        passage, code = (pair >> np.uint64(32)).astype(np.int64), (pair & np.uint64(0xFFFFFFFF)).astype(np.int64)
        least = self.share - 1e-9
        hopeful = np.bincount(passage, self.most[code], int(cells.sum())) >= least
        keep = hopeful[passage]
        passage, code = passage[keep], code[keep]
        ids, passage = np.unique(passage, return_inverse=True)
        if not len(ids):
            return
        spot, owner = _spread(self.block_first[code], self.block_size[code])
        bound = np.bincount(passage[owner] * self.blocks + self.block[spot], self.block_most[spot], len(ids) * self.blocks) >= least
        keep = np.unique(owner[bound[passage[owner] * self.blocks + self.block[spot]]])
        passage, code = passage[keep], code[keep]
        spot, owner = _spread(self.first[code], self.size[code])
        keep = bound[passage[owner] * self.blocks + self.item[spot] // BLOCK]
        spot, owner = spot[keep], owner[keep]
        cells_of = passage[owner].astype(np.uint64) * np.uint64(len(self.items)) + self.item[spot].astype(np.uint64)
        hit, where = np.unique(cells_of, return_inverse=True)
        score = np.bincount(where, self.part[spot], len(hit))
        good = np.flatnonzero(score >= least)
        text_of = np.searchsorted(base, ids, "right") - 1
        for k in good:
            p, item = divmod(int(hit[k]), len(self.items))
            t = int(text_of[p])
            low = begin[t] + (ids[p] - base[t]) * self.stride
            high = min(low + 2 * self.stride, begin[t] + count[t])
            n, question, answer = self.parts[item]
            have = windows(w.hash[low:high], n)
            q = np.isin(question, have).mean()
            a = np.isin(answer, have).mean() if len(answer) else q
            if q >= self.overlap and a >= self.overlap:
                yield t, int(self.items[item]), float(score[k]), float(q), float(a)


def _search(index: Index):
    def run(batches):
        for batch in batches:
            for low, high, data, offsets in chunks(batch.column("text")):
                rows = list(index.found(Words(data, offsets, lower=True, plain=True), high - low))
                if rows:
                    text, item, score, q, a = zip(*rows)
                    row = pa.array([low + t for t in text])
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(row), batch.column("key").take(row), pa.array(item), pa.array(score), pa.array(q), pa.array(a)],
                                                     ["doc_id", "key", "item_id", "score", "question_overlap", "answer_overlap"])

    return run


def decontaminate(documents: DataFrame, benchmark: DataFrame, share: float = 0.5, overlap: float = 0.5, gram: int = 3, slice_words: int = SLICE_WORDS,
                  key: str | None = None) -> DataFrame:
    """``doc_id, key, item_id, score, question_overlap, answer_overlap``: one row per document and
    leaked item; the whole number in the documents' column ``key`` goes along, null without one.

    Words are lower-cased runs of letters and digits.  A passage is two cells of as many
    words as the longest item of the slice, every cell starting one.  ``score`` is the BM25
    score of the passage as a share of the item's own; terms, then blocks of items, whose
    bounds cannot reach ``share`` are passed over.  All items above it are checked: the first
    two thirds of the item (question) and the rest (answer) must each have ``overlap`` of
    their ``gram``-word runs in the passage.  Items and texts that are null or without words
    leak nothing; repeated rows give one; an empty benchmark gives none.  Other columns are
    not read.
    """
    spark = documents.sparkSession
    index = cut_lineage(indexed(benchmark))
    words = index.agg(F.sum(F.size("words"))).first()[0] or 0
    slices = -(-words // slice_words)
    carried = F.lit(None) if key is None else F.col(key)
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), carried.cast("long").alias("key"), "text")
    schema = "doc_id long, key long, item_id long, score double, question_overlap double, answer_overlap double"
    found = spark.createDataFrame([], schema)
    for k in range(slices):
        rows = index.filter(F.pmod("id", F.lit(slices)) == k).orderBy("id").collect()
        if rows:
            found = found.unionByName(texts.mapInArrow(_search(Index(rows, share, overlap, gram)), schema))
    return found.groupBy("doc_id", "key", "item_id").agg(*[F.max(c).alias(c) for c in ("score", "question_overlap", "answer_overlap")])
