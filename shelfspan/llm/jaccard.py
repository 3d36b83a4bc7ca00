"""N-gram Jaccard join: prefixes of rare tokens and of neighbouring frequent ones, then exact checks.

A document's tokens are hashes of its distinct word shingles.  All documents order tokens
alike: rare ones by hash, then frequent ones by hash.  A set of ``n`` tokens may miss
``t = n - ceil(0.8 n)`` of them in a partner, so its prefix holds enough rare tokens, each a
signature, that a partner with none of them would miss more than ``t``.  Where rare tokens run
out, each two *neighbours* among the first frequent ones are a signature.  A token that a partner
lacks parts two such, one that it has besides parts one; so two sets that link part at most
``0.4 n``, and one more finds them.  Signatures grow with the size of a set, not with its square.

Copies are taken together first.  Equal sets have one representative; near copies that share
low hashes with a leader and pass the exact check belong to its *centre*.  Only centres are
joined with each other.  For the rest the distance of centres decides: Jaccard distance is a
metric, so members of two centres can link only within the threshold plus both radii.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspan.llm.packing import ANSWER, BLOCK, answer, bucket_of, bucket_rows, grouped, pack, pack_sorted, posted, read_row, summed, unpack, unpack_sorted
from shelfspan.llm.words import Words, chunks, mixed, row_key, shingle_sets, shuffle_width
from shelfspan.operators.graph import components
from shelfspan.session import cut_lineage

#: Two sets link when 100 * common >= 80 * all.
PERCENT = 80
LOWEST = 6
#: At most so many tokens are frequent, whatever the corpus: 8 bytes each go to every task.
MOST_FREQUENT = 1 << 21
LEAST_FREQUENT = 256
#: Pairs that a task counts at a time.
PAIRS_AT_ONCE = 1_000_000
#: Postings and bytes of text that a task holds at a time.
POSTINGS_AT_ONCE, TEXT_AT_ONCE = 400_000, 1 << 19
#: Bits of the parity that goes with each signature of a centre.
SKETCH_BITS = 512
#: Members of a ball that a task holds at a time.
BALL_BLOCK = 2_000
#: Bits of the key filter that is broadcast; more than an eighth as many keys are joined instead.
FILTER_BITS = 1 << 25
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def _sets(texts: pa.Array, n: int):
    """(rows low..high, begin of each row's set, sorted hashes) for some texts at a time."""
    for low, high, data, offsets in chunks(texts, TEXT_AT_ONCE):
        owner, value = shingle_sets(Words(data, offsets, lower=True), high - low, n)
        yield low, high, np.searchsorted(owner, np.arange(high - low + 1)), value


def parity(value: np.ndarray, bits: int | None = None) -> bytes:
    """For each residue of a set's hashes whether an odd number of them has it, as bits; unless
    ``bits`` are given, at least two per hash.  Sets whose parities differ in ``d`` bits differ in ``d`` hashes or more."""
    bits = bits or 1 << max(6, int(2 * len(value) - 1).bit_length())
    odd = np.bincount((value & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _facts(n: int):
    def run(batches):
        for batch in batches:
            for low, high, begin, value in _sets(batch.column("text"), n):
                size = np.diff(begin)
                total = lambda x: np.diff(np.concatenate(([np.uint64(0)], np.cumsum(x, dtype=np.uint64)))[begin])  # noqa: E731, B023
                first = np.minimum(size, LOWEST)
                spot = np.repeat(begin[:-1] - np.cumsum(first) + first, first) + np.arange(first.sum())
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(first)), pa.int32()), pa.array(value[spot].view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(c).slice(low, high - low) for c in ("key", "doc_id")], pa.array(size.astype(np.int64)),
                     pa.array(total(value).view(np.int64)), pa.array(total(mixed(value ^ _ALL)).view(np.int64)), lists,
                     pa.array([parity(value[begin[i] : begin[i + 1]]) for i in range(high - low)], pa.binary()),
                     pa.array([parity(value[begin[i] : begin[i + 1]], SKETCH_BITS) for i in range(high - low)], pa.binary())],
                    ["key", "doc_id", "n", "sum_a", "sum_b", "lowest", "parity", "sketch"])

    return run


def _frequent_blocks(n: int, buckets: int):
    """How many texts hold each token (40 bits of it), in blocks per bucket."""

    def block(parts):
        value, count = grouped(np.concatenate(parts))
        bucket = bucket_of(value << np.uint64(24), buckets)
        edges = np.flatnonzero(np.diff(bucket, prepend=-1, append=-1))
        rows = [(int(bucket[a]), pack_sorted(value[a:b]), pack(count[a:b].astype(np.uint32))) for a, b in zip(edges[:-1], edges[1:])]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary()))], ["bucket", "tokens", "counts"])

    def run(batches):
        parts, held = [], 0
        for batch in batches:
            for _, _, _, value in _sets(batch.column("text"), n):
                parts.append(value >> np.uint64(24))
                held += len(value)
                if held >= POSTINGS_AT_ONCE:
                    yield block(parts)
                    parts, held = [], 0
        if held:
            yield block(parts)

    return run


def _frequent(least: int):
    def run(batches):
        value, count = [], []
        for batch in batches:
            for row in batch.to_pylist():
                value.append(unpack_sorted(row["tokens"]))
                count.append(unpack(row["counts"], np.uint32).astype(np.int64))
        if value:
            value, count = grouped(np.concatenate(value), weight=np.concatenate(count))
            yield pa.RecordBatch.from_arrays([pa.array(value[count >= least].view(np.int64))], ["token"])

    return run


def signatures(value: np.ndarray, frequent: np.ndarray) -> tuple[np.ndarray, int]:
    """Signatures of one set (ascending hashes), and how many tokens its prefix has."""
    n = len(value)
    misses = n - -(-n * PERCENT // 100)
    code = value >> np.uint64(24)
    at = np.searchsorted(frequent, code)
    often = frequent[np.minimum(at, len(frequent) - 1)] == code if len(frequent) else np.zeros(n, bool)
    rare = value[~often][: misses + 1]
    if len(rare) > misses:
        return rare, len(rare)
    # With no rare token in common, each of them is one that the partner lacks.
    hot = value[often][: 2 * n * (100 - PERCENT) // 100 - 2 * len(rare) + 2]
    return np.concatenate((rare, mixed(hot[:-1] * np.uint64(0xD6E8FEB86659FD93) + hot[1:]))), len(rare) + len(hot)


def _signature_blocks(n: int, frequent, buckets: int):
    """Signatures of texts with their keys; ``times`` carries the length of the prefix."""

    def block(value, key, prefix):
        value, key, prefix = np.concatenate(value), np.concatenate(key), np.concatenate(prefix)
        names, text = np.unique(key, return_inverse=True)
        order = np.lexsort((text, value))
        value, text, prefix = value[order], text[order], prefix[order]
        rows = list(bucket_rows(value, text, prefix, names, bucket_of(value, buckets)))
        fields = ["hashes", "places", "times", "keys"]
        return pa.RecordBatch.from_arrays([pa.array([b for b, _ in rows], pa.int32()), *[pa.array([r[c] for _, r in rows], pa.binary()) for c in fields]], ["bucket", *fields])

    def run(batches):
        hot = frequent.value
        value, key, prefix, held = [], [], [], 0
        for batch in batches:
            keys = batch.column("key").to_numpy()
            for low, high, begin, tokens in _sets(batch.column("text"), n):
                for i in range(high - low):
                    if begin[i] == begin[i + 1]:
                        continue
                    found, length = signatures(tokens[begin[i] : begin[i + 1]], hot)
                    value.append(found)
                    key.append(np.full(len(found), keys[low + i]))
                    prefix.append(np.full(len(found), length))
                    held += len(found)
                    if held >= POSTINGS_AT_ONCE:
                        yield block(value, key, prefix)
                        value, key, prefix, held = [], [], [], 0
        if held:
            yield block(value, key, prefix)

    return run


def _shared(batches):
    """Signatures that at least two texts have."""
    value, key, prefix = [], [], []
    for batch in batches:
        for row in batch.to_pylist():
            v, place, times, keys = read_row(row["hashes"], row["places"], row["times"], row["keys"])
            value.append(v)
            key.append(keys[place])
            prefix.append(times)
    if not value:
        return
    value, key, prefix = np.concatenate(value), np.concatenate(key), np.concatenate(prefix)
    order = np.lexsort((key, value))
    value, key, prefix = value[order], key[order], prefix[order]
    new = np.flatnonzero((np.diff(value, prepend=~value[:1]) != 0) | (np.diff(key, prepend=~key[:1]) != 0))
    value, key, prefix = value[new], key[new], prefix[new]
    first = np.flatnonzero(np.diff(value, prepend=~value[:1]) != 0)
    size = np.diff(np.append(first, len(value)))
    keep = np.repeat(size > 1, size)
    value, key, prefix = value[keep].view(np.int64), key[keep], prefix[keep]
    for i in range(0, len(value), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(x[i : i + 100_000]) for x in (value, key, prefix)], ["signature", "key", "prefix"])


def _tokens(n: int):
    """All tokens of each text, by their first 40 bits."""

    def make(batch):
        keys = batch.column("key").to_numpy()
        for low, high, begin, value in _sets(batch.column("text"), n):
            text, token = np.repeat(np.arange(high - low), np.diff(begin)), value & np.uint64(0xFFFFFFFFFF000000)
            new = np.ones(len(token), bool)
            new[1:] = (token[1:] != token[:-1]) | (text[1:] != text[:-1])
            text, token = text[new], token[new]
            yield token, text, np.ones(len(text), np.int64), keys[low:high], None

    return make


def _met(batches):
    """Of this task's tokens: how many of each text another text has too, and how often others have them."""
    held, values = [], []
    for batch in batches:
        for row in batch.to_pylist():
            if row["keys"] is not None:
                yield answer(row["block"], row["keys"], [])
            else:
                held.append((row["block"], row["places"]))
                values.append(unpack_sorted(row["hashes"]))
    if not held:
        return
    ends = np.cumsum([len(v) for v in values])
    value, index, count = np.unique(np.concatenate(values), return_inverse=True, return_counts=True)
    for (block, places), more in zip(held, np.split(count[index], ends[:-1])):
        place, many = unpack(places, np.uint32)[more > 1], more[more > 1]
        yield answer(block, None, [np.bincount(place).astype(np.uint32), np.bincount(place, many).astype(np.float32)])


def linkable(texts: DataFrame, sizes: DataFrame, n: int, width: int) -> DataFrame:
    """``key, usual, strong``: of ``sizes``, the texts with enough tokens in common with any
    others of them, and how common their tokens are; the middle of a group of copies has the most.

    A link needs 180 * common >= 80 * (both sizes), so of its two texts the one that is not
    the larger is ``strong``: 180 * met >= 160 * n.
    """
    blocks = among(texts.select("key", "text"), sizes).sortWithinPartitions("key").mapInArrow(posted(_tokens(n), lambda v: bucket_of(v, width), width, at_once=POSTINGS_AT_ONCE), BLOCK)
    met = summed(blocks.repartition(width, "bucket").mapInArrow(_met, ANSWER), width, {"met": "u4", "usual": "f4"}).groupBy("key").agg(F.max("met").alias("met"), F.max("usual").alias("usual"))
    return sizes.join(met, "key").filter(100 * F.col("met") >= PERCENT * F.col("n")).select(
        "key", (F.col("usual") / F.col("n")).alias("usual"), (F.col("met") * (100 + PERCENT) >= F.col("n") * 2 * PERCENT).alias("strong"))


def _led(low: DataFrame, parities: DataFrame, texts: DataFrame, n: int) -> DataFrame:
    """Checked pairs of a text and its leader: the most usual of the texts that share a low hash
    with it and have a possible size, itself included.

    ``low`` has ``key, n, token`` and maybe ``usual``, else how often its low hashes are held
    stands for it.
    """
    counted = low.groupBy("token").agg(F.count("*").alias("held")).filter("held > 1")
    known = low.join(counted, "token")
    if "usual" not in low.columns:
        known = known.join(known.groupBy("key").agg(F.sum("held").cast("double").alias("usual")), "key")
    known = cut_lineage(known.select("key", "n", "token", "usual"))
    # Sizes that can link are within a quarter: the most usual text per token and span of sizes.
    span = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1.25)))
    spans = known.withColumn("span", F.explode(F.array(span - 1, span, span + 1)))
    leaders = spans.groupBy("token", "span").agg(F.max(F.struct("usual", "key", "n")).alias("lead"))
    choice = known.withColumn("span", span).join(leaders, ["token", "span"]).select("key", "n", "usual", "lead").filter(_sized("n", "lead.n"))
    chosen = choice.groupBy("key", "usual").agg(F.max("lead").alias("lead")).filter(F.struct("usual", "key") < F.struct("lead.usual", "lead.key"))
    return compared(linkable_pairs(chosen.select(F.col("lead.key").alias("a"), F.col("key").alias("b")), parities), texts, n).filter("linked")


def _roots(copies: DataFrame) -> DataFrame:
    """``key, root, step``: copies whose leader has no leader itself."""
    return copies.join(copies.select(F.col("b").alias("a")), "a", "left_anti").select(F.col("b").alias("key"), F.col("a").alias("root"), F.col("distance").alias("step"))


def _common(n: int):
    def run(batches):
        for batch in batches:
            for i in range(0, len(batch), 64):
                part = batch.slice(i, 64)
                sides = []
                for name in ("text_a", "text_b"):
                    column = part.column(name)
                    sides.append([v[b[k] : b[k + 1]] for low, high, b, v in _sets(column, n) for k in range(high - low)])
                common = [len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(*sides)]
                sizes = [[len(x) for x in side] for side in sides]
                yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b"), *[pa.array(x, pa.int64()) for x in (common, *sizes)]], ["a", "b", "common", "n_a", "n_b"])

    return run


def among(documents: DataFrame, keys: DataFrame) -> DataFrame:
    """Documents whose ``key`` is among ``keys``, and maybe some others: up to a bound on the
    number of keys by a bit filter of fixed size, beyond it by a join.  Keys may repeat; they are
    counted apart only where their rows pass the bound."""
    keys = keys.select("key")
    if keys.count() * 8 > FILTER_BITS and keys.distinct().count() * 8 > FILTER_BITS:
        return documents.join(keys.distinct(), "key", "left_semi")
    spot = F.pmod(F.xxhash64("key"), F.lit(FILTER_BITS))
    bit = F.expr("shiftleft(1L, cast(_spot & 63 AS int))")
    bits = keys.select(spot.alias("_spot")).groupBy(F.expr("shiftright(_spot, 6)").alias("_word")).agg(F.bit_or(bit).alias("_bits"))
    placed = documents.withColumn("_spot", spot).withColumn("_word", F.expr("shiftright(_spot, 6)"))
    return placed.join(F.broadcast(bits), "_word").filter("(shiftright(_bits, cast(_spot & 63 AS int)) & 1) = 1").drop("_spot", "_word", "_bits")


def _ends(pairs: DataFrame) -> DataFrame:
    """``key``: both sides of pairs, as often as pairs have them."""
    return pairs.select(F.explode(F.array("a", "b")).alias("key"))


def compared(pairs: DataFrame, texts: DataFrame, n: int) -> DataFrame:
    """``a, b, common, n_a, n_b, linked, distance`` of distinct pairs of keys, from whole texts; written once."""
    pairs = cut_lineage(pairs.select("a", "b"))
    held = among(texts.select("key", "text"), _ends(pairs))
    both = pairs.join(held.select(F.col("key").alias("b"), F.col("text").alias("text_b")), "b").join(held.select(F.col("key").alias("a"), F.col("text").alias("text_a")), "a")
    out = both.select("a", "b", "text_a", "text_b").mapInArrow(_common(n), "a long, b long, common long, n_a long, n_b long").dropDuplicates(["a", "b"])
    union = F.col("n_a") + F.col("n_b") - F.col("common")
    return cut_lineage(out.withColumn("linked", 100 * F.col("common") >= PERCENT * union).withColumn("distance", 1 - F.col("common") / union))


def _sized(a: str, b: str):
    return (100 * F.col(a) >= PERCENT * F.col(b)) & (100 * F.col(b) >= PERCENT * F.col(a))


def _counted_pairs(batches):
    """Pairs ``a < b`` with a common signature, one of them marked, one of them strong, and with how many,
    summed over this task's signatures.  Where names have sketches, pairs that those rule out go."""
    held = [batch for batch in batches if len(batch)]
    if not held:
        return
    table = pa.Table.from_batches(held)
    signature, name, strong, marked = (table.column(c).to_numpy() for c in ("signature", "name", "strong", "marked"))
    order = np.lexsort((name, ~marked, signature))
    names, at, code = np.unique(name, return_index=True, return_inverse=True)
    sketch = None
    if table.column("sketch").null_count == 0:
        size = table.column("n").to_numpy()[at]
        sketch = np.frombuffer(b"".join(table.column("sketch").take(pa.array(at)).to_pylist()), np.uint64).reshape(len(at), -1)
    signature, code, strong, marked = signature[order], code[order], strong[order], marked[order]
    first = np.flatnonzero(np.diff(signature, prepend=~signature[:1]) != 0)
    many = np.diff(np.append(first, len(signature)))
    later = np.where(marked, np.repeat(first + many, many) - np.arange(len(signature)) - 1, 0)
    end, low = np.cumsum(later), 0
    held, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    while low < len(signature):
        high = max(int(np.searchsorted(end, (end[low - 1] if low else 0) + PAIRS_AT_ONCE, "right")), low + 1)
        some = later[low:high]
        one = np.repeat(np.arange(low, high), some)
        other = one + 1 + np.arange(len(one)) - np.repeat(np.cumsum(some) - some, some)
        one, other = (x[strong[one] | strong[other]] for x in (one, other))
        pair, count = grouped(np.minimum(code[one], code[other]) * len(names) + np.maximum(code[one], code[other]))
        if sketch is not None:
            x, y = pair // len(names), pair % len(names)
            # A slice at a time: 128 bytes of sketches per pair.
            apart = np.concatenate([np.zeros(0, np.int64), *[np.bitwise_count(sketch[x[i : i + 100_000]] ^ sketch[y[i : i + 100_000]]).sum(axis=1, dtype=np.int64) for i in range(0, len(x), 100_000)]])
            may = (100 + PERCENT) * apart <= (100 - PERCENT) * (size[x] + size[y])
            pair, count = pair[may], count[may]
        held, counts = grouped(np.concatenate((held, pair)), weight=np.concatenate((counts, count)))
        low = high
    for i in range(0, len(held), 100_000):
        pair = held[i : i + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(names[pair // len(names)]), pa.array(names[pair % len(names)]), pa.array(counts[i : i + 100_000])], ["a", "b", "shared"])


def _pairs(named: DataFrame, width: int) -> DataFrame:
    """``a, b, shared``: pairs of names that share signatures.  Only names of the same few
    signatures meet in a task, and its pairs leave summed.

    ``named`` has ``signature, name, strong, marked, n, sketch`` once per signature and name;
    a pair needs a marked and a strong side.
    """
    counted = named.repartition(width, "signature").mapInArrow(_counted_pairs, "a long, b long, shared long")
    return counted.groupBy("a", "b").agg(F.sum("shared").alias("shared"))


def _lacking(one: str, other: str):
    """Three times the signatures that two linked sets of these sizes have in common at least, the
    prefix of ``one`` ending first.

    With ``x`` tokens of ``one`` alone, ``y`` of ``other`` alone and ``c`` common rare tokens, more
    than ``0.4 one - 2 x - y - 3 c`` signatures of neighbours are left beside these ``c``.
    """
    share = PERCENT / (100 + PERCENT)
    return (3 * share - PERCENT / 50) * F.col(one) + (3 * share - 1) * F.col(other)


def _hopeful(pairs: DataFrame, sizes: DataFrame) -> DataFrame:
    """Pairs with enough common signatures for the threshold.  Where both prefixes are of rare
    tokens, these and the tokens behind the prefixes have to reach it."""
    side = lambda s: sizes.select(F.col("key").alias(s), F.col("n").alias(f"n_{s}"), F.col("prefix").alias(f"prefix_{s}"))
    shared = pairs.join(side("a"), "a").join(side("b"), "b")
    rare = lambda s: 100 * (F.col(f"prefix_{s}") - 1) <= (100 - PERCENT) * F.col(f"n_{s}")
    behind = F.greatest(F.col("n_a") - F.col("prefix_a"), F.col("n_b") - F.col("prefix_b"))
    reach = F.least(F.col("shared") + behind, "n_a", "n_b")
    needed = F.lit(PERCENT) * (F.col("n_a") + F.col("n_b"))
    enough = F.when(rare("a") & rare("b"), (100 + PERCENT) * reach >= needed).otherwise(
        F.least(_lacking("n_a", "n_b"), _lacking("n_b", "n_a")) <= 3 * F.col("shared"))
    return shared.filter(_sized("n_a", "n_b") & enough).select("a", "b")


def _folded(bits: np.ndarray, words: int) -> np.ndarray:
    while bits.shape[-1] > words:
        half = bits.shape[-1] // 2
        bits = bits[..., :half] ^ bits[..., half:]
    return bits


def _in_reach(batches):
    """Pairs of a ball's member and a probe that sizes, distances to the ball's centre and
    parities allow to link.  Per block of a ball come its members, then the probes."""
    place, members, sized = None, [], None
    out_a, out_b = [], []
    for batch in batches:
        for row in batch.to_pylist():
            if (row["ball"], row["block"]) != place:
                place, members, sized = (row["ball"], row["block"]), [], None
            if not row["probe"]:
                members.append(row)
                continue
            if sized is None:
                sized = {}
                for m in members:
                    sized.setdefault(len(m["parity"]) // 8, []).append(m)
                sized = {w: (np.array([m["key"] for m in ms], np.int64), np.array([m["n"] for m in ms]), np.array([m["distance"] for m in ms]), np.array([m["strong"] for m in ms], bool),
                             np.frombuffer(b"".join(m["parity"] for m in ms), np.uint64).reshape(len(ms), w)) for w, ms in sized.items()}
            mine = np.frombuffer(row["parity"], np.uint64)
            for words, (key, n, distance, strong, bits) in sized.items():
                may = np.flatnonzero((100 * n >= PERCENT * row["n"]) & (100 * row["n"] >= PERCENT * n) & (distance + (1 - PERCENT / 100 + 1e-9) >= row["distance"]) & (strong | row["strong"]))
                if len(may):
                    least = min(words, len(mine))
                    apart = np.bitwise_count(_folded(bits[may], least) ^ _folded(mine, least)).sum(axis=1, dtype=np.int64)
                    found = key[may[(100 + PERCENT) * apart <= (100 - PERCENT) * (n[may] + row["n"])]]
                    out_a.append(np.minimum(found, row["key"]))
                    out_b.append(np.maximum(found, row["key"]))
        if out_a:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_a)), pa.array(np.concatenate(out_b))], ["a", "b"])
            out_a, out_b = [], []


def across(close: DataFrame, members: DataFrame, parities: DataFrame, width: int) -> DataFrame:
    """``a, b``: pairs of members of two balls that may link.

    ``close`` has centres ``a, b`` and their ``distance``; ``members`` has ``key, centre, n,
    distance, strong``.  The larger ball of a pair lies in blocks of its members, the smaller
    one's members visit all of them; only pairs that pass leave a task.
    """
    ends = close.select(F.col("a").alias("centre")).unionByName(close.select(F.col("b").alias("centre"))).distinct()
    held = members.join(ends, "centre")
    held = cut_lineage(held.join(among(parities.select("key", "parity"), held.select("key")).dropDuplicates(["key"]), "key"))
    count = held.groupBy("centre").agg(F.count("*").alias("held"))
    side = lambda s: count.select(F.col("centre").alias(s), F.col("held").alias(f"held_{s}"))
    larger = F.col("held_a") >= F.col("held_b")
    visits = close.select("a", "b", F.col("distance").alias("gap")).join(side("a"), "a").join(side("b"), "b").select(
        F.when(larger, F.col("a")).otherwise(F.col("b")).alias("ball"), F.when(larger, F.col("b")).otherwise(F.col("a")).alias("centre"), "gap", F.greatest("held_a", "held_b").alias("held"))
    blocks = F.ceil(F.col("held") / BALL_BLOCK)
    balls = held.join(count, "centre").join(visits.select(F.col("ball").alias("centre")).distinct(), "centre").select(
        F.col("centre").alias("ball"), F.pmod(F.xxhash64("key"), blocks).alias("block"), F.lit(False).alias("probe"), "key", "n", "distance", "strong", "parity")
    probes = visits.join(held, "centre").select(
        "ball", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("block"), F.lit(True).alias("probe"), "key", "n", (F.col("gap") - F.col("distance")).alias("distance"), "strong", "parity")
    met = balls.unionByName(probes).repartition(width, "ball", "block").sortWithinPartitions("ball", "block", "probe")
    return met.mapInArrow(_in_reach, "a long, b long")


def _alike(batches):
    """Pairs whose parities allow a link."""
    for batch in batches:
        sides = [[np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column(c)] for c in ("parity_a", "parity_b")]
        apart = [int(np.bitwise_count(_folded(x, min(len(x), len(y))) ^ _folded(y, min(len(x), len(y)))).sum()) for x, y in zip(*sides)]
        both = batch.column("n_a").to_numpy() + batch.column("n_b").to_numpy()
        may = pa.array((100 + PERCENT) * np.array(apart, np.int64) <= (100 - PERCENT) * both)
        yield batch.select(["a", "b"]).filter(may)


def linkable_pairs(pairs: DataFrame, parities: DataFrame) -> DataFrame:
    """``a, b``: the pairs that parities do not rule out, each once."""
    pairs = cut_lineage(pairs.select("a", "b").distinct())
    held = among(parities, _ends(pairs)).dropDuplicates(["key"])
    side = lambda s: held.select(*[F.col(c).alias(f"{c}_{s}" if c != "key" else s) for c in ("key", "n", "parity")])
    return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(_alike, "a long, b long")


def _reachable(low: str, high: str):
    return 100 * F.col(high) >= PERCENT * F.col(low)


def linked_texts(documents: DataFrame, n: int = 5) -> tuple[DataFrame, DataFrame]:
    """Facts of every text, and ``key, label``: which texts hang together by links.

    ``documents`` has ``key``, ``doc_id`` and ``text``.  Texts that no link touches have no label.
    """
    spark = documents.sparkSession
    width = shuffle_width(spark)
    texts = documents.select("key", "doc_id", "text")
    whole = cut_lineage(texts.mapInArrow(_facts(n), "key long, doc_id long, n long, sum_a long, sum_b long, lowest array<long>, parity binary, sketch binary"))
    facts, parities = whole.drop("parity", "sketch"), whole.filter("n > 0").select("key", "n", "parity")
    same = ["n", "sum_a", "sum_b"]
    sets = cut_lineage(facts.filter("n > 0").groupBy(*same).agg(F.min(F.struct("key", "lowest")).alias("one")).select(F.col("one.key").alias("key"), *same, F.col("one.lowest").alias("lowest")))

    # Near copies belong to a leader that the exact check confirms.
    low = cut_lineage(sets.select("key", "n", F.explode("lowest").alias("token")))
    copies = _led(low, parities, texts, n)
    placed = cut_lineage(sets.select("key", "n").join(_roots(copies), "key", "left").select("key", "n", F.coalesce("root", "key").alias("centre"), F.coalesce("step", F.lit(0.0)).alias("distance")))

    # Frequent tokens among centres; the threshold bounds their number.
    centres = placed.filter("key = centre")
    total = centres.agg(F.sum("n")).first()[0] or 0
    least = max(LEAST_FREQUENT, -(-total // MOST_FREQUENT))
    counted = among(texts, centres).mapInArrow(_frequent_blocks(n, width), "bucket int, tokens binary, counts binary").repartition(width, "bucket")
    tokens = counted.mapInArrow(_frequent(least), "token long").toPandas()["token"].to_numpy(np.int64).view(np.uint64)
    frequent = spark.sparkContext.broadcast(np.sort(tokens))

    blocks = among(texts, placed).mapInArrow(_signature_blocks(n, frequent, width), "bucket int, hashes binary, places binary, times binary, keys binary")
    shared = blocks.repartition(width, "bucket").mapInArrow(_shared, "signature long, key long, prefix long")
    shared = cut_lineage(shared)
    sizes = cut_lineage(shared.groupBy("key").agg(F.first("prefix").alias("prefix")).join(placed.select("key", "n"), "key"))

    # Texts with too many tokens of their own link with nothing; the others get leaders again.
    able = cut_lineage(linkable(texts, sizes, n, width))
    again = _led(low.join(able.select("key", "usual").join(placed.filter("key = centre").select("key"), "key"), "key"), parities, texts, n)
    roots = _roots(again).withColumnRenamed("key", "centre")
    placed = cut_lineage(placed.join(roots, "centre", "left").select(
        "key", "n", F.coalesce("root", "centre").alias("centre"), (F.col("distance") + F.coalesce("step", F.lit(0.0))).alias("distance")))
    strong = shared.join(able.filter("strong").select("key"), "key", "left_semi").select("signature").distinct()
    held = shared.join(strong, "signature", "left_semi").join(placed.join(able.select("key", "strong"), "key"), "key")
    rows = cut_lineage(held.select("signature", "key", "prefix", "n", "centre", "distance", "strong"))

    # Centres against centres, at the threshold itself.
    own = rows.filter("key = centre").select("signature", F.col("key").alias("name"), "strong", F.col("strong").alias("marked"), "n")
    sketches = among(whole.select("key", "sketch"), own.select(F.col("name").alias("key"))).dropDuplicates(["key"])
    own = own.join(sketches.withColumnRenamed("key", "name"), "name")
    first = compared(linkable_pairs(_hopeful(_pairs(own, width), sizes), parities), texts, n)

    # Members of different centres: only where the centres are near enough for it.
    spans = placed.groupBy("centre").agg(F.max("distance").alias("radius"), F.min("n").alias("low"), F.max("n").alias("high"))
    reached = rows.groupBy("signature").agg(F.min("centre").alias("low"), F.max("centre").alias("high"), F.max("distance").alias("wide")).filter("low != high AND wide > 0")
    apart = cut_lineage(rows.join(reached.select("signature"), "signature", "left_semi"))
    side = lambda s: spans.select(F.col("centre").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in ("radius", "low", "high")])
    wide = spans.filter("radius > 0").select("centre", F.lit(True).alias("wide"))
    balls = apart.groupBy("signature", "centre").agg(F.max("strong").alias("strong")).join(wide, "centre", "left").select(
        "signature", F.col("centre").alias("name"), "strong", F.coalesce("wide", F.lit(False)).alias("marked"), F.lit(0).cast("long").alias("n"), F.lit(None).cast("binary").alias("sketch"))
    near = cut_lineage(_pairs(balls, width).join(side("a"), "a").join(side("b"), "b").filter("radius_a + radius_b > 0").filter(
        _reachable("low_a", "high_b") & _reachable("low_b", "high_a")).filter(
        F.least(_lacking("high_a", "low_b"), _lacking("high_b", "low_a")) <= 3 * F.col("shared")).select("a", "b", (F.col("radius_a") + F.col("radius_b")).alias("slack")))
    known = first.select("a", "b", "linked", "distance")
    measured = compared(near.join(known, ["a", "b"], "left_anti"), texts, n).select("a", "b", "linked", "distance").unionByName(known)
    close = cut_lineage(near.join(measured, ["a", "b"]).filter(~F.col("linked") & (F.col("distance") <= F.lit(1 - PERCENT / 100 + 1e-9) + F.col("slack"))).select("a", "b", "distance"))
    members = rows.select("key", "centre", "n", "distance", "strong").distinct()
    late = compared(across(close, members, parities, width).distinct(), texts, n)

    # What hangs together, among centres: members hang on theirs.
    edges = copies.select("a", "b").unionByName(again.select("a", "b")).unionByName(first.filter("linked").select("a", "b")).unionByName(late.filter("linked").select("a", "b"))
    of = lambda s: placed.select(F.col("key").alias(s), F.col("centre").alias(f"centre_{s}"))
    edges = cut_lineage(edges.join(of("a"), "a").join(of("b"), "b").filter("centre_a != centre_b").select(
        F.least("centre_a", "centre_b").alias("a"), F.greatest("centre_a", "centre_b").alias("b")).distinct())
    labels = components(_ends(edges).withColumnRenamed("key", "node"), edges)
    labels = placed.join(labels, placed["centre"] == labels["node"], "left").select(F.col("key").alias("node"), F.coalesce("label", "centre").alias("label"))
    member = facts.filter("n > 0").join(sets.select(F.col("key").alias("one"), *same), same)
    return facts, member.join(labels, member["one"] == labels["node"], "left").select("key", F.coalesce("label", "one").alias("label"))


def jaccard_components(documents: DataFrame, n: int = 5) -> DataFrame:
    """``doc_id, n_shingles, component_id``, one row per document.

    Words are lower-cased (A-Z) and a text of fewer than ``n`` words is one shingle.  Texts
    without words, null texts among them, have 0 shingles and are linked with nothing.
    ``component_id`` is the smallest ``doc_id`` reachable by links, null if all are null.
    Repeated rows are equal sets and link (unless empty); an empty table gives an empty result.
    """
    keyed = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", row_key("doc_id", "text").alias("key"))
    facts, labels = linked_texts(keyed, n)
    labels = labels.distinct()
    least = facts.join(labels, "key").groupBy("label").agg(F.min("doc_id").alias("component_id"))
    return facts.join(labels, "key", "left").join(least, "label", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
