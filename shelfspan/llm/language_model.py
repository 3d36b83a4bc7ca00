"""Language-model scores from a trigram trie that is built and queried in shards.

Every word keeps its identity and its contexts, however rare.  Frequent words have short
numbers that all tasks know; the others are their 64-bit hash, numbered inside a shard.  A
shard is built where its trigrams meet, from the training texts' postings among them and the
corpus counts of its words, and answers all of them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspan.llm.packing import ANSWER, BLOCK, BLOCK_FIELDS, answer, bucket_of, grouped, pack, pack_sorted, posted, summed, unpack, unpack_sorted
from shelfspan.llm.trie import Shard, built
from shelfspan.llm.words import Words, chunks, mixed, row_key, shuffle_width
from shelfspan.session import cut_lineage

WORD = r"[^\x20\x09-\x0D]+"
#: At most so many words have a number in place of their hash: 12 bytes each go to every task.
MOST_WORDS = 1 << 20
#: Numbers are below, hashes and places among a shard's hashes from here on.
HASHES = 1 << 21
#: Requests for counts that a task gathers before it sends them.
REQUESTS_AT_ONCE = 1_000_000
#: A context word that follows many tokens is spread over at most so many shards.
MOST_SALTS = 64
#: Shards that a task builds and answers one after another.
SHARDS_A_TASK = 4
#: Texts of unsent answers that a task holds.
HELD_ANSWERS = 4_000_000


def _words(batch):
    """Distinct words of each text; ``times`` is twice the count, plus one in training texts."""
    keys, train = batch.column("key").to_numpy(), ~batch.column("held_out").to_numpy(zero_copy_only=False)
    for low, high, data, offsets in chunks(batch.column("text")):
        w = Words(data, offsets, lower=True)
        text, value, times = grouped(w.text, w.hash)
        yield value, text, times * 2 + train[low + text], keys[low:high], None


def _unigrams(cut: int, width: int):
    """Exact counts of a bucket's words, and what they add to the texts of each block.

    Rows of kind 1 are frequent words, of kind 2 the number of distinct ones, of kind 3 the
    other words of a bucket; rows with a block answer it: log counts and known words.
    """
    names = ["kind", "id", "count", "block", "keys", "sums"]
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.binary())]

    def rows(kind, name, count):
        n = len(name)
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind), pa.int32()), pa.array(name, pa.int64()), pa.array(count, pa.int64()),
                                           *[pa.nulls(n, k) for k in kinds[3:]]], names)

    def replied(batch, kind=0):
        return pa.RecordBatch.from_arrays([pa.array([kind], pa.int32()), *[pa.nulls(1, k) for k in kinds[1:3]], *batch.columns], names)

    def run(batches):
        held = []
        for batch in batches:
            for row in batch.to_pylist():
                if row["keys"] is not None:
                    yield replied(answer(row["block"], row["keys"], []))
                else:
                    held.append(row)
        if not held:
            return
        value, count = [], []
        for row in held:
            times = unpack(row["times"], np.uint32).astype(np.int64)
            v, c = grouped(unpack_sorted(row["hashes"]), weight=(times >> 1) * (times & 1))
            value.append(v)
            count.append(c)
        known, count = grouped(np.concatenate(value), weight=np.concatenate(count))
        rare, often = (count > 0) & (count < cut), count >= cut
        yield rows(2, [0], [int((count > 0).sum())])
        yield rows(1, known[often].view(np.int64), count[often])
        names_of, count_of = known[rare], count[rare].astype(np.uint32)
        for bucket, low, high in _runs(bucket_of(names_of, width)):
            yield replied(answer(bucket, pack_sorted(names_of[low:high]), [count_of[low:high]]), 3)
        for row in held:
            place, times = unpack(row["places"], np.uint32), unpack(row["times"], np.uint32).astype(np.int64) >> 1
            c = count[np.searchsorted(known, unpack_sorted(row["hashes"]))]
            sums = [np.bincount(place, x) for x in (times * np.log10(c + 0.5), times * (c > 0))]
            yield replied(answer(row["block"], None, [x.astype(k) for x, k in zip(sums, ("<f4", "<u4"))]))

    return run


def _runs(bucket: np.ndarray):
    """(bucket, begin, end) of each run of equal buckets."""
    edges = np.flatnonzero(np.diff(bucket, prepend=-1, append=-1)) if len(bucket) else []
    return [(int(bucket[a]), a, b) for a, b in zip(edges[:-1], edges[1:])]


def _joined(parts: list[bytes]) -> bytes:
    return b"".join(len(p).to_bytes(4, "little") + p for p in parts)


def _parted(data: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(data):
        size = int.from_bytes(data[at : at + 4], "little")
        out.append(data[at + 4 : at + 4 + size])
        at += 4 + size
    return out


def pack_ids(value: np.ndarray) -> bytes:
    """Rows of word ids in ascending order, word by word; each hash is written once."""
    rare = value >= HASHES
    hashes = np.unique(value[rare])
    code = value.astype(np.int64)
    code[rare] = HASHES + np.searchsorted(hashes, value[rare])
    first = np.diff(code[:, 0], prepend=0)
    return _joined([pack_sorted(hashes), *[pack(c.astype(np.uint32)) for c in (first, *code.T[1:])]])


def unpack_ids(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The hashes, and the rows with places among them from ``HASHES`` on."""
    hashes, *columns = _parted(data)
    code = np.stack([unpack(c, np.uint32).astype(np.int64) for c in columns], 1)
    code[:, 0] = np.cumsum(code[:, 0])
    return unpack_sorted(hashes), code


class Classes:
    """Ids of words: frequent ones have numbers by count, then end and begin, others a hash; and where contexts live."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, words: int, texts: int, distinct: int, shards: int):
        often = np.lexsort((hashes, -counts))
        counts, hashes = counts[often], hashes[often]
        order = np.argsort(hashes)
        self.hashes, self.number = hashes[order], order + 1
        self.end, self.begin, self.shards = len(hashes) + 1, len(hashes) + 2, shards
        each = np.concatenate(([0], counts, [texts, 0])).astype(float)
        self.whole = words + texts + 0.5 * (distinct + 1)
        self.single = (each + 0.5) / self.whole
        each[-1] = texts
        self.salts = np.clip(np.ceil(each * shards / max(words + texts, 1)), 1, MOST_SALTS).astype(np.uint64)

    @staticmethod
    def named(hashes: np.ndarray) -> np.ndarray:
        """Ids of words without a number."""
        return np.where(hashes < HASHES, hashes + np.uint64(HASHES), hashes)

    def triples(self, w: Words, texts: int) -> tuple[np.ndarray, np.ndarray]:
        """(text, ids of last, before and next) for every word and end."""
        code = np.searchsorted(self.hashes, w.hash)
        held = code < len(self.hashes)
        held[held] = self.hashes[code[held]] == w.hash[held]
        name = self.named(w.hash)
        name[held] = self.number[code[held]]
        count = w.counts(texts)
        begin = np.cumsum(count) - count + 3 * np.arange(texts)
        line = np.full(len(w) + 3 * texts, self.begin, np.uint64)
        owner = np.repeat(np.arange(texts), count + 3)
        line[np.arange(len(w)) + 3 * w.text + 2] = name
        line[begin + count + 2] = self.end
        inner = np.ones(len(line), bool)
        inner[begin] = inner[begin + 1] = False
        at = np.flatnonzero(inner)
        return owner[at], np.stack((line[at - 1], line[at - 2], line[at]), 1)

    def salts_of(self, last: np.ndarray) -> np.ndarray:
        return np.where(last < HASHES, self.salts[np.where(last < HASHES, last, 0).astype(np.int64)], np.uint64(1))

    def shard(self, value: np.ndarray) -> np.ndarray:
        return self.salted(value[:, 0], mixed(value[:, 1]) % self.salts_of(value[:, 0]))

    def salted(self, last: np.ndarray, salt: np.ndarray) -> np.ndarray:
        return bucket_of(mixed(last * np.uint64(MOST_SALTS) + salt), self.shards)


def _asked(classes):
    """Trigrams of each text; ``times`` is twice the count, plus one in training texts."""

    def make(batch):
        keys, train = batch.column("key").to_numpy(), ~batch.column("held_out").to_numpy(zero_copy_only=False)
        for low, high, data, offsets in chunks(batch.column("text")):
            text, value = classes.value.triples(Words(data, offsets, lower=True), high - low)
            text, *value, times = grouped(text, *value.T)
            yield np.stack(value, 1), text, times * 2 + train[low + text], keys[low:high], None

    return make


def _pairs(classes):
    """Bigram counts of a block's training texts, for every shard of a first word that has several."""

    def extra(value, times):
        c = classes.value
        learned = np.flatnonzero(((times & 1) == 1) & (c.salts_of(value[:, 0]) > 1))
        last, follow, count = grouped(value[learned, 0], value[learned, 2], weight=times[learned] >> 1)
        salts = c.salts_of(last).astype(np.int64)
        copy = np.repeat(np.arange(len(last)), salts)
        salt = np.arange(len(copy)) - np.repeat(np.cumsum(salts) - salts, salts)
        bucket = c.salted(last[copy], salt.astype(np.uint64))
        order = np.lexsort((follow[copy], last[copy], bucket))
        pair, count, bucket = np.stack((last, follow), 1)[copy][order], count[copy][order], bucket[order]
        for b, low, high in _runs(bucket):
            # Two salts of a word may share a shard: its pairs count once there.
            new = np.append(True, (np.diff(pair[low:high].astype(np.int64), axis=0) != 0).any(1))
            yield b, _joined([pack_ids(pair[low:high][new]), pack(count[low:high][new].astype(np.uint32))])

    return extra


def _requests(classes, width: int):
    """The words without a number that each shard predicts, sent to where their counts are."""

    def packed(found):
        value, shard, _ = grouped(*(np.concatenate(x) for x in zip(*found)))
        parts = [(b, pack_sorted(value[low:high]), pack(shard[low:high].astype(np.uint32))) for b, low, high in _runs(bucket_of(value, width))]
        bucket, hashes, shards = zip(*parts)
        return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array(hashes, pa.binary()), pa.array(shards, pa.binary())], ["bucket", "hashes", "shards"])

    def run(batches):
        found = []
        for batch in batches:
            for low, high, data, offsets in chunks(batch.column("text")):
                value = classes.value.triples(Words(data, offsets, lower=True), high - low)[1]
                value = value[value[:, 2] >= HASHES]
                follow, shard, _ = grouped(value[:, 2], classes.value.shard(value))
                found.append((follow, shard))
                if sum(len(f) for f, _ in found) >= REQUESTS_AT_ONCE:
                    yield packed(found)
                    found = []
        if sum(len(f) for f, _ in found):
            yield packed(found)

    return run


def _counted(batches):
    """Corpus counts of the requested words, as a row per shard; what no text has is left out."""
    known, counts, value, shard = [], [], [], []
    for batch in batches:
        for row in batch.to_pylist():
            if row["counts"] is not None:
                known.append(Classes.named(unpack_sorted(row["hashes"])))
                counts.append(unpack(row["counts"], np.uint32))
            else:
                value.append(unpack_sorted(row["hashes"]))
                shard.append(unpack(row["shards"], np.uint32))
    if not known or not value:
        return
    order = np.argsort(known := np.concatenate(known))
    known, counts = known[order], np.concatenate(counts)[order]
    shard, value, _ = grouped(np.concatenate(shard).astype(np.int64), np.concatenate(value))
    at = np.minimum(np.searchsorted(known, value), len(known) - 1)
    held = known[at] == value
    shard, value, count = shard[held], value[held], counts[at[held]]
    for b, low, high in _runs(shard):
        yield pa.RecordBatch.from_arrays(
            [pa.array([b], pa.int32()), pa.array([0], pa.int64()), *[pa.nulls(1, pa.binary())] * 2, pa.array([_joined([pack_sorted(value[low:high]), pack(count[low:high])])], pa.binary()),
             *[pa.nulls(1, pa.binary())] * 2], ["bucket", "block", *BLOCK_FIELDS])


def _settled(rows, c: Classes):
    """A bucket's postings under local numbers, its trie and the probabilities of its words alone."""
    postings, pairs, counted = [], [], []
    for row in rows:
        if row["hashes"] is not None:
            postings.append((row, *unpack_ids(row["hashes"])))
        elif row["more"] is not None:
            ids, count = _parted(row["more"])
            pairs.append((*unpack_ids(ids), unpack(count, np.uint32).astype(np.int64)))
        else:
            value, count = _parted(row["times"])
            counted.append((unpack_sorted(value), unpack(count, np.uint32).astype(np.int64)))
    names = np.unique(np.concatenate([np.zeros(0, np.uint64), *[p[1] for p in postings], *[p[0] for p in pairs]]))
    width = HASHES + len(names)
    rare = np.full(len(names), 0.5 / c.whole)
    for value, count in counted:
        at = np.minimum(np.searchsorted(names, value), max(len(names) - 1, 0))
        held = names[at] == value if len(names) else np.zeros(len(value), bool)
        rare[at[held]] = (count[held] + 0.5) / c.whole

    def local(hashes, code):
        own = code >= HASHES
        code[own] = HASHES + np.searchsorted(names, hashes)[code[own] - HASHES]
        return code

    def single(word):
        out, own = np.zeros(len(word)), word >= HASHES
        out[~own], out[own] = c.single[word[~own]], rare[word[own] - HASHES]
        return out

    postings = [(row, local(hashes, code)) for row, hashes, code in postings]
    triples, counts, pair, pair_counts = [], [], [], []
    for row, code in postings:
        times = unpack(row["times"], np.uint32).astype(np.int64)
        learned = (times & 1) == 1
        triples.append(code[learned])
        counts.append(times[learned] >> 1)
    for hashes, code, count in pairs:
        pair.append(local(hashes, code))
        pair_counts.append(count)
    if not sum(map(len, triples)) and not pairs:
        return postings, None, single
    triples = np.concatenate([np.zeros((0, 3), np.int64), *triples])
    context, follow, counts = grouped(triples[:, 0] * width + triples[:, 1], triples[:, 2], weight=np.concatenate([np.zeros(0, np.int64), *counts]))
    # Where a word has one shard its bigrams are sums of the trigrams there.
    whole = c.salts_of(np.minimum(context // width, HASHES)) == 1
    pair.append(np.stack((context[whole] // width, follow[whole]), 1))
    pair_counts.append(counts[whole])
    pair = np.concatenate(pair)
    last, after, pair_counts = grouped(pair[:, 0], pair[:, 1], weight=np.concatenate(pair_counts))
    return postings, Shard(built(last, after, pair_counts, context, follow, counts, single(after), width)), single


def _answered(classes):
    """A partition in order of bucket: each builds its trie, then answers its postings."""

    def settle(rows, totals):
        postings, shard, single = _settled(rows, classes.value)
        for row, code in postings:
            place, times = unpack(row["places"], np.uint32), unpack(row["times"], np.uint32) >> 1
            new = np.append(True, (np.diff(code, axis=0) != 0).any(1))
            last, before, follow = code[new].T
            log = np.log10(single(follow))
            if shard is not None:
                log = shard.log10(before, last, follow, log)
            more, old = np.bincount(place, log[np.cumsum(new) - 1] * times), totals.get(row["block"], np.zeros(0))
            long, short = (more, old) if len(more) > len(old) else (old, more)
            long[: len(short)] += short
            totals[row["block"]] = long

    def run(batches):
        at, rows, totals = -1, [], {}
        for batch in batches:
            for row in batch.to_pylist():
                if row["keys"] is not None:
                    yield answer(row["block"], row["keys"], [])
                    continue
                if row["bucket"] != at:
                    settle(rows, totals)
                    at, rows = row["bucket"], []
                    if sum(map(len, totals.values())) > HELD_ANSWERS:
                        yield from (answer(k, None, [v.astype(np.float32)]) for k, v in totals.items())
                        totals = {}
                rows.append(row)
        settle(rows, totals)
        yield from (answer(k, None, [v.astype(np.float32)]) for k, v in totals.items())

    return run


def language_scores(documents: DataFrame, held_out: Column) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of whole texts.

    Learns from the rows where ``held_out`` isn't true (a null id counts as training).  Words
    are lower-cased (A-Z), each text has an end token more.  ``base_score`` is the unigram
    score with half a count added; ``score`` the log10 probability under the trie: trigrams,
    interpolated Witten-Bell, probabilities in one byte each.  Null counts as empty, which
    still has its end token.  Repeated rows each count in training and get equal results;
    with nothing to learn from all probabilities are those of unseen words.
    """
    spark = documents.sparkSession
    width = shuffle_width(spark)
    texts = documents.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "text", row_key("doc_id", "text").alias("key"))
    facts = cut_lineage(texts.groupBy("key").agg(F.first("doc_id").alias("doc_id"), F.first("held_out").alias("held_out"),
                                                 F.max(F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0))).cast("long").alias("n_words"), F.count("*").alias("copies")))
    learned = facts.filter("NOT held_out").agg(F.sum(F.col("n_words") * F.col("copies")).alias("words"), F.sum("copies").alias("texts")).first()
    words, ends = int(learned["words"] or 0), int(learned["texts"] or 0)
    cut = max(2, -(-words // MOST_WORDS))

    spread = texts.select("key", "held_out", "text").sortWithinPartitions("key").mapInArrow(posted(_words, lambda v: bucket_of(v, width), width), BLOCK)
    found = cut_lineage(spread.repartition(width, "bucket").mapInArrow(_unigrams(cut, width), "kind int, id long, count long, " + ANSWER))
    often = found.filter("kind = 1").select("id", "count").toPandas()
    distinct = int(found.filter("kind = 2").agg(F.sum("count")).first()[0] or 0) + (ends > 0)
    shards = width * SHARDS_A_TASK
    classes = spark.sparkContext.broadcast(
        Classes(often["id"].to_numpy(np.int64).view(np.uint64), often["count"].to_numpy(np.int64), words, ends, distinct, shards))

    wanted = texts.filter("text IS NOT NULL").select("text").mapInArrow(_requests(classes, width), "bucket int, hashes binary, shards binary")
    counts = found.filter("kind = 3").select(F.col("block").cast("int").alias("bucket"), F.col("keys").alias("hashes"), F.lit(None).cast("binary").alias("shards"), F.col("sums")[0].alias("counts"))
    counted = counts.unionByName(wanted.withColumn("counts", F.lit(None).cast("binary"))).repartition(width, "bucket").mapInArrow(_counted, BLOCK)

    asked = texts.select("key", "held_out", "text").sortWithinPartitions("key").mapInArrow(
        posted(_asked(classes), lambda v: classes.value.shard(v), shards, pack_ids, _pairs(classes)), BLOCK)
    placed = asked.unionByName(counted).repartition(width, "bucket").sortWithinPartitions("bucket")
    model = summed(placed.mapInArrow(_answered(classes), ANSWER), width, {"model": "f4"}).groupBy("key").agg(F.sum("model").alias("model"))

    own = summed(found.filter("kind = 0").select("block", "keys", "sums"), width, {"log": "f4", "known": "u4"})
    own = own.groupBy("key").agg(*[F.sum(c).alias(c) for c in ("log", "known")])
    n = F.col("n_words") + 1
    each = lambda c: F.coalesce(F.col(c) / F.col("copies"), F.lit(0.0))
    base = each("log") + float(np.log10(ends + 0.5)) - n * float(np.log10(words + ends + 0.5 * (distinct + 1)))
    return facts.join(own, "key", "left").join(model, "key", "left").select(
        "doc_id", "held_out", n.alias("n_tokens"), (F.coalesce(F.expr("known div copies"), F.lit(0)) + int(ends > 0)).cast("long").alias("n_known"),
        F.lit(words + ends).cast("long").alias("train_tokens"), base.alias("base_score"), each("model").alias("score"),
        F.explode(F.expr("array_repeat(0, cast(copies AS int))")).alias("_")).drop("_")
