"""Line dedup by a log-template tree: token count and leading tokens, then constant fields."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfspan.llm.words import Words, chunks, mixed, row_key
from shelfspan.session import cut_lineage

DEPTH = 3
_VARIABLE = np.uint64(0x51ED270B7F4A7C15)
_DIGIT = np.isin(np.arange(256), list(range(48, 58)))
_BLANKS = " \t\n\x0b\x0c\r"


class _Lines:
    """Lines with a word of some texts: text, number in the text, first word, word count."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        w = Words(data, offsets)
        breaks = np.concatenate(([0], np.cumsum(data == 10)))
        number = breaks[w.start] - breaks[offsets[w.text]] if len(w) else np.zeros(0, np.int64)
        digits = np.concatenate(([0], np.cumsum(_DIGIT[data])))
        self.token = np.where(digits[w.start + w.length] > digits[w.start], _VARIABLE, w.hash) if len(w) else w.hash
        new = (np.diff(w.text, prepend=-1) != 0) | (np.diff(number, prepend=-1) != 0)
        self.first = np.flatnonzero(new)
        self.size = np.diff(np.append(self.first, len(w)))
        self.text, self.number = w.text[self.first], number[self.first]
        place = np.arange(len(w)) - np.repeat(self.first, self.size)
        self.place = place
        placed = mixed(self.token * np.uint64(2) + mixed(place.astype(np.uint64) + np.uint64(1)))
        total = lambda x: np.add.reduceat(x, self.first) if len(x) else x
        self.line = mixed(total(placed) + self.size.astype(np.uint64))
        self.leaf = mixed(total(np.where(place < DEPTH, placed, np.uint64(0))) + self.size.astype(np.uint64) * np.uint64(3))


def _scan(least_words: int):
    def run(batches):
        for batch in batches:
            for low, high, data, offsets in chunks(batch.column("text")):
                x = _Lines(data, offsets)
                at = pa.array(np.flatnonzero(x.size >= least_words))
                row = pa.array(low + x.text).take(at)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("key").take(row), batch.column("doc_id").take(row), pa.array(x.number.astype(np.int32)).take(at),
                     pa.array(x.leaf.view(np.int64)).take(at), pa.array(x.line.view(np.int64)).take(at),
                     pa.array(x.size.astype(np.int32)).take(at)], ["key", "doc_id", "number", "leaf", "line", "size"])

    return run


def _tokens(batches):
    """Tokens behind the leading ones of the wanted lines of each text; ``docs`` goes along."""
    for batch in batches:
        wanted = batch.column("wanted").to_pylist()
        for low, high, data, offsets in chunks(batch.column("text")):
            x = _Lines(data, offsets)
            begin = np.searchsorted(x.text, np.arange(high - low + 1))
            for i in range(high - low):
                numbers = np.array([r["number"] for r in wanted[low + i]])
                docs = np.array([r["docs"] for r in wanted[low + i]], np.int64)
                lines = begin[i] + np.searchsorted(x.number[begin[i] : begin[i + 1]], numbers)
                size = np.maximum(x.size[lines] - DEPTH, 0)
                token = np.repeat(x.first[lines] + DEPTH - np.cumsum(size) + size, size) + np.arange(size.sum())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(x.leaf[lines], size).view(np.int64)), pa.array(np.repeat(x.line[lines], size).view(np.int64)),
                     pa.array(x.place[token].astype(np.int32)), pa.array(x.token[token].view(np.int64)), pa.array(np.repeat(docs, size))],
                    ["leaf", "line", "place", "token", "docs"])


def _without(batches):
    for batch in batches:
        texts, kept, lines, gone = batch.column("text").to_pylist(), [], [], []
        for text, dropped in zip(texts, batch.column("dropped").to_pylist()):
            rows = (text or "").split("\n")
            lines.append(sum(1 for r in rows if r.strip(_BLANKS)))
            gone.append(len(dropped or ()))
            if dropped:
                without = set(dropped)
                text = "\n".join(r for i, r in enumerate(rows) if i not in without)
            kept.append(text)
        names = [n for n in batch.schema.names if n not in ("text", "dropped")]
        yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(kept, pa.string()), pa.array(lines, pa.int64()), pa.array(gone, pa.int64())],
                                         [*names, "text", "n_lines", "n_dropped"])


def recurring_lines(documents: DataFrame, least_docs: int, least_words: int, constant: float, keep_first: bool) -> DataFrame:
    """``key, dropped``: per text the numbers of the lines that go."""
    lines = cut_lineage(documents.select("key", "doc_id", "text").mapInArrow(
        _scan(least_words), "key long, doc_id long, number int, leaf long, line long, size int"))
    leaves = lines.select("leaf", "key").distinct().groupBy("leaf").count().filter(F.col("count") >= least_docs).select("leaf")
    seen = lines.groupBy("leaf", "line", "key").agg(F.min("number").alias("number"), F.min("size").alias("size"))
    held = cut_lineage(seen.join(leaves, "leaf", "left_semi").groupBy("leaf", "line").agg(
        F.count("*").alias("docs"), F.min("size").alias("size"), F.min(F.struct("key", "number")).alias("at")))
    wanted = held.filter(F.col("size") > DEPTH).groupBy(F.col("at.key").alias("key")).agg(
        F.collect_list(F.struct(F.col("at.number").alias("number"), "docs")).alias("wanted"))
    once = documents.select("key", "text").join(wanted, "key").dropDuplicates(["key"])
    tokens = once.select("text", "wanted").mapInArrow(_tokens, "leaf long, line long, place int, token long, docs long")
    support = F.sum("docs").over(Window.partitionBy("leaf", "place", "token"))
    fixed = tokens.withColumn("support", support).filter(F.col("support") >= least_docs).groupBy("leaf", "line").agg(
        F.bit_xor(F.xxhash64("place", "token")).alias("fields"), F.count("*").alias("fixed"))
    template = held.join(fixed, ["leaf", "line"], "left").filter(
        F.coalesce("fixed", F.lit(0)) + F.least("size", F.lit(DEPTH)) >= F.lit(constant) * F.col("size")
    ).select("leaf", "line", F.coalesce("fields", F.lit(0)).alias("template"))
    placed = cut_lineage(lines.join(template, ["leaf", "line"]).select("leaf", "template", "key", "doc_id", "number"))
    often = placed.groupBy("leaf", "template", "key").agg(F.min("doc_id").alias("doc_id")).groupBy("leaf", "template").agg(
        F.count("*").alias("docs"), F.min("doc_id").alias("first_doc")).filter(F.col("docs") >= least_docs)
    gone = placed.join(often, ["leaf", "template"])
    if keep_first:
        gone = gone.filter(~F.col("doc_id").eqNullSafe(F.col("first_doc")))
    return gone.groupBy("key").agg(F.collect_set("number").alias("dropped"))


def line_dedup(documents: DataFrame, least_docs: int = 10, least_words: int = 2, constant: float = 0.6, keep_first: bool = True) -> DataFrame:
    """The documents with ``text`` cleared of recurring lines, plus ``n_lines`` and ``n_dropped``.

    A line goes to the leaf of its word count and first ``DEPTH`` words, a word with a digit
    standing for any such word.  A later word is constant if lines of at least ``least_docs``
    documents of its leaf have it at that place; other words are variable fields.  A line
    whose constant share is at least ``constant`` has a template, and a template found in
    ``least_docs`` documents recurs: its lines go, but in the document of the smallest id
    that has it (with ``keep_first``).  Lines below ``least_words`` words always stay.

    Null texts stay null (0 lines), empty texts empty; a text that loses all its lines
    becomes empty.  Null ids are larger than any.  Repeated rows count once and get equal
    results.  Columns beside ``doc_id`` (whole numbers) and ``text`` pass through, but for
    columns ``n_lines`` and ``n_dropped``, which the new ones replace.
    """
    others = [c for c in documents.columns if c not in ("doc_id", "text", "n_lines", "n_dropped")]
    named = [F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(others)]
    kinds = dict(documents.dtypes)
    keyed = documents.select(F.col("doc_id").cast("long").alias("doc_id"), *named, "text", row_key("doc_id", "text").alias("key"))
    joined = keyed.join(recurring_lines(keyed, least_docs, least_words, constant, keep_first), "key", "left").drop("key")
    schema = ", ".join(["doc_id long", *[f"_{i} {kinds[c]}" for i, c in enumerate(others)], "text string, n_lines long, n_dropped long"])
    out = joined.mapInArrow(_without, schema)
    return out.select("doc_id", *[F.col(f"_{i}").alias(c) for i, c in enumerate(others)], "text", "n_lines", "n_dropped")


ORACLE = r"""
WITH rows AS (SELECT doc_id, text, string_split(text, chr(10)) AS parts FROM documents),
raw AS (SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS number FROM rows),
lines AS (SELECT doc_id, number, list_transform(regexp_extract_all(line, '[^ 	-
]+'), lambda w: CASE WHEN regexp_matches(w, '[0-9]') THEN '<*>' ELSE w END) AS w FROM raw),
sized AS (SELECT *, len(w) AS n, w[1:3] AS lead, md5(array_to_string(w, ' ')) AS h FROM lines WHERE len(w) >= 2),
leaves AS (SELECT n, lead FROM sized GROUP BY n, lead HAVING count(DISTINCT doc_id) >= 10),
held AS (SELECT n, lead, h, any_value(w) AS w, count(DISTINCT doc_id) AS docs FROM sized SEMI JOIN leaves USING (n, lead) GROUP BY n, lead, h),
tokens AS (SELECT n, lead, h, docs, unnest(w[4:]) AS token, generate_subscripts(w[4:], 1) AS place FROM held WHERE n > 3),
fixed AS (SELECT *, sum(docs) OVER (PARTITION BY n, lead, place, token) AS support FROM tokens),
fields AS (SELECT n, lead, h, string_agg(place || ':' || token, ' ' ORDER BY place) AS f, count(*) AS c FROM fixed WHERE support >= 10 GROUP BY n, lead, h),
template AS (SELECT n, lead, h, coalesce(f, '') AS f FROM held LEFT JOIN fields USING (n, lead, h) WHERE coalesce(c, 0) + least(n, 3) >= 0.6::DOUBLE * n),
placed AS (SELECT doc_id, number, n, lead, f FROM sized JOIN template USING (n, lead, h)),
often AS (SELECT n, lead, f, min(doc_id) AS first_doc FROM placed GROUP BY n, lead, f HAVING count(DISTINCT doc_id) >= 10),
gone AS (SELECT doc_id, number FROM placed JOIN often USING (n, lead, f) WHERE doc_id <> first_doc),
judged AS (SELECT r.doc_id, r.number, r.line, g.number IS NOT NULL AS goes, regexp_matches(r.line, '[^ 	-
]') AS has
           FROM raw r LEFT JOIN gone g ON r.doc_id = g.doc_id AND r.number = g.number)
SELECT d.doc_id, CAST(coalesce(sum(has::INT), 0) AS BIGINT) AS n_lines, CAST(coalesce(sum(goes::INT), 0) AS BIGINT) AS n_dropped,
       CASE WHEN any_value(d.text) IS NOT NULL THEN sha256(coalesce(string_agg(line, chr(10) ORDER BY number) FILTER (WHERE NOT goes), '')) END AS kept_sha256
FROM documents d LEFT JOIN judged j ON d.doc_id = j.doc_id GROUP BY d.doc_id
"""
