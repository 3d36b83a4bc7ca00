"""Token alignment, language identification and centroid clustering against plain versions."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from parity.check import connect, difference
from shelfspan.llm import alignment, centroids, queries
from shelfspan.llm.alignment import Aligner, Chunk, PerfectHash, token_alignment
from shelfspan.llm.language_id import PAD, Network, language_ids, pooled

ROOT = "/root/testdata/sf0.001"
A_JSON = Path(public_tokenizers.path(queries.BYTE_TOKENIZER)).read_text()
B_MODEL = Path(public_tokenizers.path(queries.PIECE_TOKENIZER)).read_bytes()
ODD = [None, "", " ", "a", "naïve café 中文 \U0001f600", "<|endoftext|> <s> </s> <unk> <0x41>", "two  spaces\tand\nlines ", "é" * 700, "word " * 9000,
       "one text twice", "one text twice", "ﬁ ligature", "▁ piece mark", "x" * 3000, "\x00 nul"]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "en", "k", 1, "v") for i, t in enumerate(ODD)] + [(9, ODD[9], "en", "k", 1, "v"), (None, "a null id", None, "k", 1, "v")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, key string, n_a long, groups string")


def plain_alignment(rows):
    """By strings and sets, one text at a time."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    first, second = Tokenizer.from_str(A_JSON), SentencePieceProcessor(model_proto=B_MODEL)
    first.encode_special_tokens = True
    decoder = {}
    free = 256
    for byte in range(256):
        if 33 <= byte <= 126 or 161 <= byte <= 172 or 174 <= byte <= 255:
            decoder[chr(byte)] = byte
        else:
            decoder[chr(free)] = byte
            free += 1
    told, total = [], Counter()
    for doc_id, text in rows:
        a, b, ends_a, ends_b, at = [], [], {}, {}, 0
        if text:
            a = first.encode(" " + text, add_special_tokens=False).ids
            b = second.encode(text)
            spelled = [bytes(decoder[c] for c in first.id_to_token(i)) for i in a]
            pieces = [bytes([int(second.id_to_piece(i)[3:5], 16)]) if second.is_byte(i) else second.id_to_piece(i).replace("▁", " ").encode() for i in b]
            if not b"".join(spelled) == b"".join(pieces) == (" " + text).encode():
                a, b = [], []
        if a:
            for i, s in enumerate(spelled):
                ends_a[at := at + len(s)] = i
            at = 0
            for i, s in enumerate(pieces):
                ends_b[at := at + len(s)] = i
        common = sorted(ends_a.keys() & ends_b.keys())
        links = [(a[ends_a[e]], b[ends_b[e]]) for e in common]
        groups, i, j = [], 0, 0
        for e in common:
            groups.append(",".join(map(str, a[i : ends_a[e] + 1])) + "|" + ",".join(map(str, b[j : ends_b[e] + 1])))
            i, j = ends_a[e] + 1, ends_b[e] + 1
        total.update(links)
        told.append((doc_id, len(a), len(b), links, ";".join(groups)))
    highest = defaultdict(int)
    for (_, y), n in total.items():
        highest[y] = max(highest[y], n)
    return [(d, n, m, len(links), len(links), sum(total[p] == highest[p[1]] for p in links), sum(total[p] for p in links),
             hashlib.sha256(g.encode()).hexdigest() if n else "") for d, n, m, links, g in told]


NAMES = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
order = lambda rows: sorted(rows, key=str)


def aligned(df):
    out = token_alignment(df, A_JSON, B_MODEL)
    return out.withColumn("groups_sha256", F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))).select(*NAMES)


def test_alignment_of_odd_texts(spark, odd):
    got = [tuple(r) for r in aligned(odd).collect()]
    assert order(got) == order(plain_alignment([(r["doc_id"], r["text"]) for r in odd.collect()]))
    assert aligned(odd.limit(0)).count() == 0


def test_alignment_of_the_table(spark):
    docs = queries.table(spark, ROOT, "documents")
    got = [tuple(r) for r in queries.op11_token_alignment(spark, ROOT).select(*NAMES).collect()]
    want = plain_alignment([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])
    assert order(got) == order(want)
    assert sum(r[1] > 0 for r in want) > 100


def test_alignment_does_not_depend_on_the_layout(spark, odd):
    assert order(aligned(odd.repartition(7)).collect()) == order(aligned(odd.coalesce(1)).collect())


def test_perfect_hash_is_minimal_and_knows_its_keys():
    keys = np.unique(np.random.default_rng(1).integers(0, 2**63, 20_000, dtype=np.uint64))
    known, foreign = keys[::2], keys[1::2]
    made = PerfectHash(known)
    assert sorted(made.places(known)) == list(range(len(known)))
    assert (made.places(foreign) == -1).all()
    assert len(PerfectHash(known[:0]).places(foreign)) == len(foreign)


def test_every_link_is_a_possible_pair():
    work = Aligner(A_JSON, B_MODEL).open()
    chunk = Chunk(work, *work.tokenised([t for t in ODD if t]))
    assert len(chunk.code) and (work.hash.places(chunk.code) >= 0).all()


def test_units_are_joined_for_the_byte_level_side():
    work = Aligner(A_JSON, B_MODEL).open()
    texts = [f"word{i} x{i % 7}é" for i in range(300)] + [" led", "trailing ", "\n", "ﬁ"] + [f"more{i}" for i in range(300)]
    asked, encode = [], work.first.encode_batch_fast

    class Counting:
        def encode_batch_fast(self, texts, **kw):
            asked.extend(texts)
            return encode(texts, **kw)

    work.first = Counting()
    a, sizes_a, b, sizes_b = work.tokenised(texts)
    assert len(asked) < 10
    ends = [np.cumsum(s) for s in (sizes_a, sizes_b)]
    for i, text in enumerate(texts):
        x, y = (ids[end[i] - s[i] : end[i]].tolist() for ids, s, end in ((a, sizes_a, ends[0]), (b, sizes_b, ends[1])))
        want_a, want_b = encode([" " + text], add_special_tokens=False)[0].ids, work.second.encode(text)
        told = b"".join(work.entries[0][k] for k in want_a) == b"".join(work.entries[1][k] for k in want_b) == (" " + text).encode()
        assert (x, y) == ((want_a, want_b) if told else ([], []))


@pytest.mark.parametrize("most", [0, 5, 1_000])
def test_a_full_memory_begins_anew(monkeypatch, most):
    texts = [t for t in ODD if t] * 2 + ["some more words", "words more some"]
    plain = alignment.Known(Aligner(A_JSON, B_MODEL).open())
    want = [";".join(plain.groups[k] for k in n) for n in plain.texts(texts)]
    monkeypatch.setattr(alignment, "MOST_UNITS", most)
    monkeypatch.setattr(alignment, "MOST_CHARACTERS", 10 * most)
    known = alignment.Known(plain.aligner)
    told = [";".join(known.groups[k] for k in n) for t in texts for n in known.texts([t])]
    assert told == want and len(known.number) <= most + max(len(t) for t in texts)


# Languages


def test_gradient_matches_differences():
    draw = np.random.default_rng(3)
    network = Network(3, hidden=4)
    for name in network.NAMES:
        setattr(network, name, getattr(network, name).astype(np.float64))
    windows = draw.integers(97, 123, (9, 5)).astype(np.int16)
    windows[6:, 2] = PAD
    label = np.array([0, 1, 2, 1, 0])
    _, slopes = network.slopes(windows, label)
    for name, slope in zip(network.NAMES, slopes):
        values = getattr(network, name)
        for at in [tuple(draw.integers(0, s) for s in values.shape) for _ in range(4)] + [np.unravel_index(np.abs(slope).argmax(), slope.shape)]:
            held = values[at]
            values[at] = held + 0.02
            more, _ = network.slopes(windows, label)
            values[at] = held - 0.02
            less, _ = network.slopes(windows, label)
            values[at] = held
            assert (more - less) / 0.04 == pytest.approx(slope[at], rel=0.05, abs=2e-4), name


def test_pooling_covers_the_whole_text():
    network = Network(2)
    text = ("abc " * 500).encode() + "zé".encode()
    data, offsets = np.frombuffer(text + b"ok" + b"", np.uint8), np.array([0, len(text), len(text) + 2, len(text) + 2])
    share = pooled(network, data, offsets)
    letters = total = 0
    for low in range(0, len(text), 64):
        part = np.frombuffer(text[low : low + 64], np.uint8).astype(np.int16)
        window = np.full((64, 1), PAD, np.int16)
        window[: len(part), 0] = part
        each = network.probabilities(window)[:, :, 0]
        held = [i for i, c in enumerate(part) if chr(c).isalpha() or c >= 0x80]
        letters, total = letters + len(held), total + each[held].sum(axis=0)
    assert share[0] == pytest.approx(total / letters, rel=1e-4)
    assert share[2].tolist() == [0, 0]


def test_languages_of_held_out_texts(spark):
    root = "/root/testdata/sf0.01"
    docs = {r["doc_id"]: r for r in queries.table(spark, root, "documents").collect()}
    got = queries.op12_language_ids(spark, root).collect()
    assert len(got) == len(docs)
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1
        text = docs[r["doc_id"]]["text"]
        assert (r["lang_pred"] == "und") == (not any(c.isalpha() for c in text or ""))
    told = [r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in got if r["held_out"] and docs[r["doc_id"]]["lang"] and r["lang_pred"] != "und"]
    assert len(told) > 150 and np.mean(told) > 0.97


def test_languages_of_odd_texts(spark, odd):
    out = Counter(language_ids(odd, F.lit(False)).select("lang_pred", "score").rdd.map(tuple).collect())
    assert sum(out.values()) == len(ODD) + 2 and {k[0] for k in out} == {"en", "und"}
    nothing = language_ids(odd.withColumn("lang", F.lit(None).cast("string")), F.lit(False)).collect()
    assert {(r["lang_pred"], r["score"]) for r in nothing} == {("und", 0.0)} and len(nothing) == len(ODD) + 2
    assert language_ids(odd.limit(0), F.lit(False)).count() == 0


# Centroids


def plain_clusters(rows, k, rounds, seed, dimension, scale=256):
    kept = [(i, [math.floor(scale * float(x)) for x in v]) for i, v in rows
            if v is not None and len(v) == dimension and all(x is not None and math.isfinite(x) for x in v)]
    name = lambda i: hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()
    middle = [v for _, _, v in sorted((i is None, "" if i is None else name(i), v) for i, v in kept)[:k]]

    def place(v):
        return min((sum((x - c) ** 2 for x, c in zip(v, m)), n) for n, m in enumerate(middle))

    for _ in range(rounds):
        held = defaultdict(list)
        for _, v in kept:
            held[place(v)[1]].append(v)
        middle = [[sum(x) // len(held[n]) for x in zip(*held[n])] if held[n] else m for n, m in enumerate(middle)]
    near = [(i, *place(v)) for i, v in kept]
    of = Counter()
    for _, d, n in near:
        of[n] += d
    return [(i, n, d, of[n], sum(of.values()), hashlib.sha256(",".join(map(str, middle[n])).encode()).hexdigest()) for i, d, n in near]


COLUMNS = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


@pytest.mark.parametrize("size", [0.01, 1.0, 5e4])
def test_clusters_of_odd_vectors(spark, size):
    draw = np.random.default_rng(11)
    rows = [(i, [float(x) for x in draw.normal(0, size, 4)]) for i in range(60)]
    rows += [(100, None), (101, []), (102, [1.0, 2.0]), (103, [1.0, None, 2.0, 3.0]), (104, [float("nan"), 0.0, 0.0, 0.0]), (105, [float("inf"), 0.0, 0.0, 0.0]),
             (106, [0.0] * 4), (107, [-0.0] * 4), (7, rows[7][1]), (7, rows[8][1]), (None, rows[9][1]), (None, [size] * 4)]
    df = spark.createDataFrame([(*r, 1, "c") for r in rows], "vec_id long, embedding array<double>, cluster int, x string")
    got = centroids.centroid_clusters(df, k=9, rounds=3, seed=2, dimension=4)
    assert order(map(tuple, got.select(*COLUMNS).collect())) == order(plain_clusters(rows, 9, 3, 2, 4))
    few = df.filter("vec_id IN (1, 2, 102)")
    assert order(map(tuple, centroids.centroid_clusters(few, k=9, rounds=2, dimension=4).select(*COLUMNS).collect())) == order(
        plain_clusters([r for r in rows if r[0] in (1, 2, 102)], 9, 2, 2, 4))
    assert centroids.centroid_clusters(df.filter("vec_id = 102"), dimension=4).count() == 0


def test_too_large_components_are_an_error(spark):
    df = spark.createDataFrame([(1, [1e30] * 4)], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="do not fit a long"):
        centroids.centroid_clusters(df, dimension=4)


def test_lanes_hold_the_largest_products():
    many = [[int(x) for x in row] for row in np.random.default_rng(2).integers(-300, 300, (40, 64))]
    for group in centroids.lanes(70_000, many):
        assert sum(bits for _, _, bits in group) <= 64
        for number, _, bits in group:
            assert math.isqrt(70_000 * sum(c * c for c in many[number])) < 2 ** (bits - 1)


def test_clusters_match_sql(spark):
    want = connect(ROOT).execute(centroids.ORACLE).df()
    assert difference(queries.op13_centroid_clusters(spark, ROOT).toPandas(), want) is None
