"""Every operator against brute force on small texts with nulls, empties, copies and clashing names."""

import hashlib
import math
import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from parity.check import connect, difference
from shelfspan.llm import jaccard, language_model, queries
from shelfspan.llm.contamination import decontaminate
from shelfspan.llm.language_model import language_scores
from shelfspan.llm.lines import line_dedup
from shelfspan.llm.mixing import mix_sources
from shelfspan.llm.pages import CHROME, MAIN, blocks, main_texts
from shelfspan.llm.quality import FEATURES, Trees, matrix, quality_rules
from shelfspan.llm.substrings import COVER, PERIOD, substring_dedup
from shelfspan.llm.tokens import token_counts
from shelfspan.llm.toxicity import Classifier, toxicity
from shelfspan.llm.trie import EliasFano
from shelfspan.llm.words import Words, chunks, mixed, shingle_sets

ROOT = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, source string, key string, n long, value string, lang string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"


def words(text):
    return WORD.findall(text or "")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def corpus():
    random.seed(7)
    bank = [f"w{i}" for i in range(60)]
    say = lambda n: " ".join(random.choice(bank) for _ in range(n))
    base, passage = say(160).split(), say(60)
    texts = [None, "", " \n\t", "one", "One", "a b c d", "x " * 30, say(4000), "naïve café 1990 #tag %x|y\nline 7\nline 8\n\nline 7", "<|endoftext|> it's don't", "é" * 300]
    for k in range(14):
        near = list(base)
        for j in range(k):
            near[(37 * j) % len(near)] = f"new{k}_{j}"
        texts.append(" ".join(near))
    texts += [" ".join(base)] * 3 + [say(20) + " " + passage + " " + say(30) for _ in range(6)] + [say(random.randint(5, 90)) for _ in range(20)]
    texts += [f"head {i}\ncommon footer line number {i % 4} here today\n{say(12)}" for i in range(12)]
    rows = [(i, t, [None, "a", "b", "c"][i % 4], "k", 1, "v", "en", len(t or "")) for i, t in enumerate(texts)]
    return rows + [rows[15], (None, "a null id of some words here", "a", "k", 1, "v", "en", 5)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def shingles(text):
    w = words(lower(text))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def components_of(rows):
    sets, up = [shingles(r[1]) for r in rows], list(range(len(rows)))

    def find(a):
        while up[a] != a:
            a = up[a]
        return a

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 100 * common >= 80 * (len(sets[i]) + len(sets[j]) - common):
                up[find(i)] = find(j)
    out = []
    for i, r in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((r[0], len(sets[i]), min(ids) if ids else None))
    return Counter(out)


@pytest.mark.parametrize("frequent", [256, 2])
def test_jaccard(docs, rows, monkeypatch, frequent):
    monkeypatch.setattr(jaccard, "LEAST_FREQUENT", frequent)
    assert Counter(map(tuple, jaccard.jaccard_components(docs).collect())) == components_of(rows)


def test_jaccard_join_beyond_the_filter(docs, rows, monkeypatch):
    monkeypatch.setattr(jaccard, "FILTER_BITS", 64)
    assert Counter(map(tuple, jaccard.jaccard_components(docs).collect())) == components_of(rows)


def test_jaccard_balls_in_many_blocks(docs, rows, monkeypatch):
    monkeypatch.setattr(jaccard, "BALL_BLOCK", 2)
    assert Counter(map(tuple, jaccard.jaccard_components(docs).collect())) == components_of(rows)


@pytest.mark.parametrize("share", [1.0, 0.95, 0.85])
def test_signatures_grow_with_the_set_and_find_every_link(share):
    rng = np.random.default_rng(3)
    often = 0
    for n in [4, 5, 6, 9, 10, 11, 50, 2000] * 25:
        pool = np.unique(rng.integers(0, 2**63, 2 * n + 10, dtype=np.uint64))
        frequent = pool[rng.random(len(pool)) < share] >> np.uint64(24)
        order = rng.permutation(pool)
        one = np.sort(order[:n])
        gone = int(rng.integers(0, n // 5 + 1))
        new = (20 * n - 100 * gone) // 80
        other = np.sort(np.concatenate((rng.permutation(one)[gone:], order[n : n + new])))
        common = len(np.intersect1d(one, other))
        assert 100 * common >= 80 * (len(one) + len(other) - common)
        found = [jaccard.signatures(x, frequent) for x in (one, other)]
        assert len(np.intersect1d(found[0][0], found[1][0]))
        for x, (signature, prefix) in zip((one, other), found):
            assert len(signature) <= prefix <= len(x)
            often += prefix > len(x) // 5 + 1
    assert often > 20


@pytest.mark.parametrize("bits", [None, jaccard.SKETCH_BITS])
def test_parity_never_exceeds_the_difference(bits):
    draw = np.random.default_rng(7)
    for size in (1, 40, 128, 129, 700):
        one = draw.integers(0, 2**63, size, dtype=np.uint64)
        for changed in (0, 1, size // 5, size):
            other = np.concatenate((one[changed:], draw.integers(0, 2**63, changed + size // 9, dtype=np.uint64)))
            x, y = (np.frombuffer(jaccard.parity(v, bits), np.uint64) for v in (one, other))
            words = min(len(x), len(y))
            apart = int(np.bitwise_count(jaccard._folded(x, words) ^ jaccard._folded(y, words)).sum())
            assert apart <= len(np.setxor1d(one, other))
            assert apart > 0 or not changed + size // 9


def test_quality(spark, docs, rows):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)] + [(None, 1, 1), (3, None, None)], LABELS)
    got = quality_rules(docs, labels).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    for doc_id, text, *_ in rows:
        w = words(text)
        grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        repeat = {j for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
        lines = [x for x in (text or "").split("\n") if WORD.search(x)]
        r = by_id[doc_id]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (
            len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(repeat))
        assert r.base_failed == (len(w) < 10 or 100 * len(repeat) > 20 * len(w)) and not (r.base_failed and r.kept)
    assert quality_rules(docs, labels.limit(0)).filter("kept = base_failed").isEmpty()


def test_trees_keep_their_direction():
    rng = np.random.default_rng(1)
    x = rng.random((400, len(FEATURES)))
    y = ((x[:, 2] + 0.4 * rng.random(400)) < 0.7).astype(float)
    model = Trees(rounds=20).fit(x, y, list(FEATURES.values()))
    line = np.repeat(x[:1], 50, 0)
    line[:, 2] = np.linspace(0, 1, 50)
    assert (np.diff(model.probability(line)) <= 1e-12).all()
    assert ((model.probability(x) > 0.5) == y).mean() > 0.85
    assert matrix({c: np.zeros(2) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words", "n_upper", "n_digits", "n_stops", "n_distinct")}).shape == (2, len(FEATURES))


def test_tokens(docs, rows):
    from tokenizers import Tokenizer

    content = queries.Path(queries.public_tokenizers.path(queries.TOKENIZER)).read_text()
    tokenizer = Tokenizer.from_str(content)
    want = Counter((i, len((t or "").encode()), n := len(tokenizer.encode(t or "", add_special_tokens=False)), n > 50) for i, t, *_ in rows)
    assert Counter(map(tuple, token_counts(docs, content, limit=50).collect())) == want


def test_pages(spark):
    page = '<html><nav><li>Menu</nav><article><h1>T</h1><p>a&amp;b  c<br>d<p class="notice">n<p>e <b>f</b>g<form>q</form></article><footer>x</footer><!-- y --><script>"</p>"</script>'
    plain = "<div><p>Shared words in a long and boring banner of a host today</p><p>only {} here</p></div>"
    data = [(1, "http://h.x/1", page), (2, None, None), (3, "u", ""), (4, "http://h.x/2", "<p"), *[(10 + i, f"http://g.x/{i}", plain.format(f"word{i}")) for i in range(5)]]
    got = {r.page_id: (r.text, r.n_chars) for r in main_texts(spark.createDataFrame(data * 1, "page_id long, url string, html string")).collect()}
    assert got[1] == ("T a&b c d e fg", 14) and got[2] == ("", 0) and got[3] == ("", 0) and got[4] == ("<p", 2)
    assert got[12] == ("word2 here", 10)
    assert blocks("a < b > c") and main_texts(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


@pytest.mark.parametrize("page", [
    "<body class='single has-sidebar'><p>a b</p></body>", "<body class='menu'><p>a b</p></body>", "<main class='content-with-sidebar'><p>a b</p></main>",
    "<article class='post has-comments'><p>a b</p><div class='comments'>c</div></article>", "<div class='page header-fixed'><p>a b</p></div>",
    "<div class='header'>x<article>a b</article></div>", "<article class='comment'>a b</article>", "<div class='sidebar'><article>x</article></div><main>a b</main>",
    "<div class='cookie-banner'>x</div><p>a b</p>"])
def test_pages_keep_what_names_only_resemble_chrome(page):
    found = blocks(page)
    best = max((k for _, k in found if k != CHROME), key=lambda k: k == MAIN)
    assert [t for t, k in found if k == best] == ["a b"]


@pytest.mark.parametrize("group_bytes", [4 << 20, 300])
def test_pages_count_texts_of_the_whole_host(spark, group_bytes):
    copy, shared = "the same plain article under two urls of one host", "a notice of ten words on two pages of host"
    html = [(f"http://a.x/{i}", f"<p>{copy}</p>") for i in (1, 1, 2)]
    html += [(f"http://b.x/{i}", f"<p>{shared if i in (3, 17) else f'x{i} ' * 9}</p><p>only{i} here</p>") for i in range(20)]
    html += [(f"http://c.x/{i}", f"<p>{shared if i in (3, 17) else f'x{i} ' * 9}</p><p>only{i} here</p>") for i in range(40)]
    data = [(i, u, h) for i, (u, h) in enumerate(html)]
    got = main_texts(spark.createDataFrame(data, "page_id long, url string, html string"), group_bytes=group_bytes).collect()
    texts = {r.url: r.text for r in got}
    assert len(got) == len(data) and texts["http://a.x/1"] == texts["http://a.x/2"] == copy
    assert all(shared not in texts[f"http://b.x/{i}"] and texts[f"http://c.x/{i}"].startswith(shared) for i in (3, 17))


@pytest.mark.parametrize("group_bytes", [4 << 20, 600])
def test_pages_cut_what_recurs_in_articles(spark, group_bytes):
    notice, copy = "please join our weekly list of many readers for free", " ".join(f"y{i}" for i in range(30))
    own = [" ".join(f"z{i}_{j}" for j in range(12)) for i in range(12)]
    html = [f"<article><p>{t}</p><p>{notice}</p></article>" for t in own] + [f"<article><p>{copy}</p><p>v{i}</p></article>" for i in range(3)]
    data = [(i, f"http://a.x/{i}", h) for i, h in enumerate(html)]
    got = {r.page_id: r.text for r in main_texts(spark.createDataFrame(data, "page_id long, url string, html string"), group_bytes=group_bytes).collect()}
    assert [got[i] for i in range(12)] == own and [got[12 + i] for i in range(3)] == [f"{copy} v{i}" for i in range(3)]


def test_substrings(docs, rows):
    assert {(a - b) % PERIOD for a in COVER for b in COVER} == set(range(PERIOD))
    least, order = {}, lambda i: math.inf if i is None else i
    for i, t, *_ in rows:
        w = words(t)
        for k in range(len(w) - 49):
            g = tuple(w[k : k + 50])
            least[g] = min(least.get(g, math.inf), order(i))
    want = Counter()
    for i, t, *_ in rows:
        w = words(t)
        gone = {j for k in range(len(w) - 49) if least[tuple(w[k : k + 50])] < order(i) for j in range(k, k + 50)}
        kept = [x for j, x in enumerate(w) if j not in gone]
        want[i, len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()] += 1
    assert Counter(map(tuple, substring_dedup(docs).collect())) == want


def test_language_model(docs, rows):
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    counts = Counter()
    for i, t, *_ in rows:
        if not held(i):
            counts.update([*words(lower(t)), ""])
    total, kinds = sum(counts.values()), len(counts)
    got = language_scores(docs, queries.fold(5, 1)).collect()
    assert len(got) == len(rows)
    texts = {i: t for i, t, *_ in rows}
    for r in got:
        tokens = [*words(lower(texts[r.doc_id])), ""]
        base = sum(math.log10((counts[x] + 0.5) / (total + 0.5 * (kinds + 1))) for x in tokens)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(r.doc_id), len(tokens), sum(counts[x] > 0 for x in tokens), total)
        assert r.base_score == pytest.approx(base, rel=1e-6) and r.score < 0
    learned = [r for r in got if not r.held_out]
    assert sum(r.score for r in learned) > sum(r.base_score for r in learned)


@pytest.mark.parametrize("numbered", [1 << 20, 4])
def test_language_model_keeps_rare_words(docs, rows, monkeypatch, numbered):
    monkeypatch.setattr(language_model, "MOST_WORDS", numbered)
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    one, two, three = Counter(), Counter(), Counter()
    for i, t, *_ in rows:
        if not held(i):
            line = ["^", "^", *words(lower(t)), ""]
            one.update(line[2:])
            two.update(zip(line[1:], line[2:]))
            three.update(zip(line, line[1:], line[2:]))
    total, total2, kinds2, total3, kinds3 = sum(one.values()), Counter(), Counter(), Counter(), Counter()
    for (a, _), n in two.items():
        total2[a] += n
        kinds2[a] += 1
    for (a, b, _), n in three.items():
        total3[a, b] += n
        kinds3[a, b] += 1
    texts = {i: t for i, t, *_ in rows}
    for r in language_scores(docs, queries.fold(5, 1)).collect():
        line, want = ["^", "^", *words(lower(texts[r.doc_id])), ""], 0
        for a, b, c in zip(line, line[1:], line[2:]):
            p = (one[c] + 0.5) / (total + 0.5 * (len(one) + 1))
            p = (two[b, c] + kinds2[b] * p) / (total2[b] + kinds2[b]) if b in total2 else p
            p = (three[a, b, c] + kinds3[a, b] * p) / (total3[a, b] + kinds3[a, b]) if (a, b) in total3 else p
            want += math.log10(p)
        assert r.score == pytest.approx(want, rel=0.01)


def test_elias_fano():
    values = np.sort(np.random.default_rng(3).integers(0, 10**9, 500))
    shape, arrays = EliasFano.packed(values)
    level = EliasFano(shape["bits"], shape["size"], *arrays)
    assert (level.at(np.arange(500)) == values).all()
    low, high = np.zeros(3, np.int64), np.array([500, 500, 3])
    assert list(level.find(low, high, np.array([values[9], -5, values[9]]))) == [9, -1, -1]


def test_decontamination(spark, docs, rows):
    random.seed(5)
    item = [" ".join(f"q{random.randint(0, 400)}" for _ in range(n)) for n in (18, 40, 25)]
    bench = spark.createDataFrame([*enumerate(item), (7, None), (8, " "), (None, "z y x w v u t s r q")], "item_id long, text string")
    cut = item[1].split()
    planted = [(100, "w1 w2 " + item[0].upper() + ", w3", "a"), (101, " ".join(cut[:20]), "a"), (102, "w5 " * 300 + item[1] + " w6" * 200, "a"), (103, " ".join(reversed(item[2].split())), "a"), (100, "w1 w2 " + item[0].upper() + ", w3", "a")]
    both = docs.select("doc_id", "text", "source").unionByName(spark.createDataFrame(planted, "doc_id long, text string, source string"))
    for at_once in (10**6, 40):
        assert {(r.doc_id, r.item_id) for r in decontaminate(both, bench, slice_words=at_once).collect()} == {(100, 0), (102, 1)}
    assert decontaminate(both, bench.limit(0)).count() == 0
    clashing = both.withColumns({"key": F.lit("no number"), "item_id": F.lit("x"), "score": F.lit(1)})
    assert {(r.doc_id, r.key, r.item_id) for r in decontaminate(clashing, bench).collect()} == {(100, None, 0), (102, None, 1)}


def test_lines(spark, docs, rows):
    got = line_dedup(docs, least_docs=5)
    assert got.columns[:1] == ["doc_id"] and set(SCHEMA.replace(",", "").split()[::2]) <= set(got.columns)
    texts = {r.doc_id: r for r in got.collect()}
    first = min(i for i, t, *_ in rows if t and "common footer" in t)
    for i, t, *_ in rows:
        if t and "common footer" in t:
            assert ("common footer" in texts[i].text) == (i == first)
    assert texts[0].text is None and texts[1].text == "" and got.count() == len(rows)
    named = docs.withColumns({"n_lines": F.lit("own"), "n_dropped": F.lit(-7), "leaf": F.lit(1)})
    again = {r.doc_id: r for r in line_dedup(named, least_docs=5).collect()}
    assert all(again[i].text == texts[i].text and again[i].n_dropped == texts[i].n_dropped and again[i].leaf == 1 for i in texts)
    stage = corpus_pipeline.lines(None, named, ROOT)
    assert stage.columns == named.columns and {(r.n_lines, r.n_dropped) for r in stage.collect()} == {("own", -7)}


def test_mixing(docs, rows):
    got = mix_sources(docs).collect()
    assert len(got) == len(rows) and all(0 <= r.taken <= 2 * r["size"] for r in got)
    for source in (None, "a", "b", "c"):
        mine = [r for r in got if r.source == source]
        assert sum(r.taken for r in mine) == math.floor(mine[0].target) and mine[0].source_size == sum(r["size"] for r in mine)
    assert sorted(got, key=str) == sorted(mix_sources(docs.repartition(5)).collect(), key=str)


def test_toxicity(spark):
    rng = random.Random(2)
    bad, fine = ["vile", "awfulness", "nastier"], [f"word{i}" for i in range(200)]
    rows = [(i, " ".join(rng.choices(fine, k=40) + (rng.choices(bad, k=4) if i % 5 == 0 else [])), int(i % 5 == 0)) for i in range(600)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(None, None), (9000, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows[:400]] + [(None, 1, 1), (1, 1, None)], LABELS)
    got = {r.doc_id: r for r in toxicity(docs, labels, queries.fold(3, 1)).collect()}
    assert len(got) == 602 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got.values())
    unseen = [(got[i].predicted, y) for i, _, y in rows if got[i].held_out]
    assert sum(a == b for a, b in unseen) > 0.95 * len(unseen)
    assert toxicity(docs, labels.limit(0), queries.fold(3, 1)).filter("predicted = 1").isEmpty()


def test_toxicity_counts_all_unlabelled(spark, monkeypatch):
    given = {}
    choose, fit = Classifier.choose, Classifier.fit
    monkeypatch.setattr(Classifier, "choose", lambda self, *a: (given.update(around=a[2], others=a[4]), choose(self, *a))[1])
    monkeypatch.setattr(Classifier, "fit", lambda self, *a: (given.update(rows=[len(x) for x in a]), fit(self, *a))[1])
    monkeypatch.setattr("shelfspan.llm.toxicity.MOST_UNLABELLED", 20)
    docs = spark.createDataFrame([(i, "vile" if i < 100 else "fine words") for i in range(300)] + [(0, f"vile {k}") for k in range(50)], "doc_id long, text string")
    toxicity(docs, spark.createDataFrame([(i, 1, 1) for i in range(10)], LABELS), F.lit(False)).count()
    assert given["others"] == 350 and max(given["around"]) == 150 and given["rows"] == [10, 20]


def test_empty_tables(spark, nothing):
    labels = spark.createDataFrame([], LABELS)
    content = queries.Path(queries.public_tokenizers.path(queries.TOKENIZER)).read_text()
    for frame in (jaccard.jaccard_components(nothing), quality_rules(nothing, labels), token_counts(nothing, content), substring_dedup(nothing),
                  language_scores(nothing, queries.fold(5, 1)), line_dedup(nothing), mix_sources(nothing), toxicity(nothing, labels, queries.fold(3, 1))):
        assert frame.count() == 0


@pytest.mark.parametrize("name", list(queries.ORACLE))
def test_sql(spark, name):
    assert difference(queries.QUERIES[name](spark, ROOT).toPandas(), connect(ROOT).execute(queries.ORACLE[name]).df()) is None


def test_pipeline_stages(spark, docs):
    for name, stage in corpus_pipeline.STAGES[1:3]:
        out = stage(spark, docs, ROOT)
        assert out.columns == docs.columns
        assert out.count() <= docs.count()
    kept = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, ROOT).collect()}
    assert {0, 1, 2} <= kept and 26 not in kept and corpus_pipeline.run(spark, ROOT).filter(F.col("taken") > 2 * F.col("size")).isEmpty()


def test_words_take_little_memory_beside_their_text():
    """Bytes are hashed a span at a time, so a text of many spans needs few bytes beside its own; hashes are those of each word alone."""
    rng = np.random.default_rng(5)
    some = [bytes(rng.integers(97, 123, n, dtype=np.uint8)) for n in (*rng.integers(10, 40, 500), 40_000, 1)]
    data = np.frombuffer(b" ".join(some * 100), np.uint8)
    offsets = np.array([0, len(data) // 2, len(data) // 2, len(data)])
    Words(data, offsets)
    tracemalloc.start()
    w = Words(data, offsets)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 12 * len(data)
    step, byte = 0x9E3779B97F4A7C15, np.random.default_rng(20260701).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
    for i in (0, 1, 499, 500, 501, 502, len(w) - 1):
        plain = sum(int(byte[c]) * pow(step, k + 1, 1 << 64) for k, c in enumerate(w.word(i))) % (1 << 64)
        assert w.hash[i] == mixed(np.array([plain], np.uint64))[0]


def test_sets_of_short_and_long_texts_are_sorted_and_distinct():
    texts = ["a b c d e f a b c d e f", "", "x", None, "a b", "A B C D E F", "é  ü\ta\nb c d"]
    for low, high, data, offsets in chunks(pa.array(texts), 20):
        w = Words(data, offsets, lower=True)
        owner, value = shingle_sets(w, high - low, 5)
        pairs = list(zip(owner.tolist(), value.tolist()))
        assert pairs == sorted(set(pairs))
        for i in range(high - low):
            words = (texts[low + i] or "").lower().split()
            assert (owner == i).sum() == len({tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else ())


def test_pairs_are_compared_in_few_stages(spark):
    """Keys of pairs are counted and filtered as they are: nothing is shuffled to make them distinct."""
    texts = spark.createDataFrame([(k, f"a b c d e f g h {'x' if k < 3 else k}") for k in (1, 2, 3, 4)], "key long, text string")
    pairs = spark.createDataFrame([(1, 2), (1, 3), (2, 4)], "a long, b long")
    spark.sparkContext.setJobGroup("pairs", "pairs")
    try:
        found = {(r.a, r.b): (r.common, r.n_a, r.n_b, r.linked) for r in jaccard.compared(pairs, texts, 5).collect()}
    finally:
        spark.sparkContext._jsc.clearJobGroup()
    tracker = spark.sparkContext.statusTracker()
    stages = {s for j in tracker.getJobIdsForGroup("pairs") for s in tracker.getJobInfo(j).stageIds}
    assert found == {(1, 2): (5, 5, 5, True), (1, 3): (4, 5, 5, False), (2, 4): (4, 5, 5, False)}
    assert len(stages) <= 22


def test_keys_may_repeat_where_documents_are_picked(spark, monkeypatch):
    docs = spark.range(100).select(F.col("id").alias("key"), F.lit("t").alias("text"))
    keys = spark.createDataFrame([(k,) for k in (3, 3, 3, 5, 5)], "key long")
    for bits in (1 << 25, 1 << 5, 8):  # the filter; the filter after all, as the distinct keys are few; the join
        monkeypatch.setattr(jaccard, "FILTER_BITS", bits)
        got = [r.key for r in jaccard.among(docs, keys).collect()]
        assert {3, 5} <= set(got) and len(got) == len(set(got))
    assert set(got) == {3, 5}
