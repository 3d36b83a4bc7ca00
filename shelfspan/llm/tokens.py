"""Token counts: each distinct pre-token is encoded once, then summed over documents."""

from __future__ import annotations

import numpy as np
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspan.llm.packing import ANSWER, BLOCK, answer, bucket_of, posted, summed, unpack
from shelfspan.llm.words import Words, chunks, row_key, shuffle_width

#: Words of one call of the tokenizer.
AT_ONCE = 20_000


def _words(batch):
    """Distinct words of each text and how often it holds them."""
    key = batch.column("key").to_numpy()
    for low, high, data, offsets in chunks(batch.column("text")):
        w = Words(data, offsets)
        order = np.lexsort((w.hash, w.text))
        value, text = w.hash[order], w.text[order]
        first = np.flatnonzero((np.diff(value, prepend=~value[:1]) != 0) | (np.diff(text, prepend=-1) != 0)) if len(w) else np.zeros(0, np.int64)
        start, length, raw = w.start[order[first]], w.length[order[first]], data.tobytes()
        times = np.diff(np.append(first, len(value)))
        yield value[first], text[first], times, key[low:high], lambda i, s=start, n=length, raw=raw: raw[s[i] : s[i] + n[i]]


def _counted(tokenizer_json: str):
    """Tokens that the texts of a block get from the words of a bucket."""

    def run(batches):
        import os

        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        tokenizer = Tokenizer.from_str(tokenizer_json)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        known: dict[bytes, int] = {}
        for batch in batches:
            for row in batch.to_pylist():
                if row["keys"] is not None:
                    yield answer(row["block"], row["keys"], [])
                    continue
                words = zstandard.ZstdDecompressor().decompress(row["more"]).split(b"\n")
                fresh = [w for w in words if w not in known]
                for i in range(0, len(fresh), AT_ONCE):
                    some = fresh[i : i + AT_ONCE]
                    encoded = tokenizer.encode_batch_fast([w.decode() for w in some], add_special_tokens=False)
                    known.update(zip(some, map(len, encoded)))
                pieces = np.array([known[w] for w in words], np.int64)
                which = np.cumsum(unpack(row["hashes"], np.uint8), dtype=np.int64) - 1
                total = np.bincount(unpack(row["places"], np.uint32), pieces[which] * unpack(row["times"], np.uint32))
                yield answer(row["block"], None, [total.astype(np.uint32)])

    return run


def token_counts(documents: DataFrame, tokenizer_json: str, limit: int = 2048) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of each document's whole text.

    ``tokenizer_json`` is the content of a tokenizer file whose pre-tokens never span ASCII
    white space.  Pre-tokens are the runs between white space; each distinct one is encoded
    once, as the library does by default (special strings inside it count as one token), and
    its count is joined to the texts' word frequencies.  Null counts as empty: 0 tokens.
    Repeated rows and null ids each give their row; an empty table an empty result.
    """
    width = shuffle_width(documents.sparkSession)
    keyed = documents.select("doc_id", "text", row_key("doc_id", "text").alias("key"))
    rows = keyed.groupBy("key").agg(F.first("doc_id").alias("doc_id"), F.max(F.coalesce(F.octet_length("text"), F.lit(0))).cast("long").alias("n_bytes"), F.count("*").alias("copies"))
    packed = keyed.select("key", "text").sortWithinPartitions("key").mapInArrow(posted(_words, lambda v: bucket_of(v, width), width), BLOCK)
    answers = packed.repartition(width, "bucket").mapInArrow(_counted(tokenizer_json), ANSWER)
    found = summed(answers, width, {"n": "u4"}).groupBy("key").agg(F.sum("n").alias("n"))
    tokens = F.coalesce(F.expr("n div copies"), F.lit(0))
    return rows.join(found, "key", "left").select("doc_id", "n_bytes", tokens.alias("n_tokens"), (tokens > limit).alias("over_limit"),
                                                  F.explode(F.expr("array_repeat(0, cast(copies AS int))")).alias("_")).drop("_")
