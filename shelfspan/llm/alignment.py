"""Alignment of two tokenizers: which tokens end together, and how often each pair does.

Two tokens that end at one byte of a text: the bytes of one end the bytes of the other.  So
the pairs that any corpus can hold follow from the two vocabularies, at most one for each
suffix of a token.  They get a minimal perfect hash; tasks count into a dense vector indexed
by it, vectors are summed in a tree, and a second pass aligns again and looks counts up.
No text is shuffled, and what reaches the driver is as long as the vocabularies allow.

Both tokenizers begin a token at a blank between two other characters.  So a text is cut
there into units, which align by themselves, and a worker tokenises each different unit once,
for both passes and for as many tasks as it runs, within bounds.
For the byte-level side many units are one text of its tokenizer, cut again where units end.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from shelfspan.llm.packing import pack, unpack
from shelfspan.llm.words import chunks, mixed, shuffle_width

#: Numbers of a dense vector in one row, and first-level sums of the tree per slice.
SLICE, NODES = 1 << 16, 64
#: Units and their characters that a worker remembers; beyond that it begins anew, which changes no result.
MOST_UNITS, MOST_CHARACTERS = 1_000_000, 1 << 25
#: Units that the byte-level tokenizer gets as one text.
JOINED = 500
_CUT = re.compile(r"(?<=\S) (?=\S)")
_U = np.uint64


def byte_level_entries(tokenizer_json: str) -> list[bytes]:
    """Bytes of each id of a byte-level vocabulary; printable bytes stand for themselves, the
    others, in order, for the characters from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}
    whole = json.loads(tokenizer_json)
    special = {t["id"]: t["content"] for t in whole["added_tokens"]}
    named = {i: bytes(byte_of[c] for c in piece) for piece, i in whole["model"]["vocab"].items() if i not in special}
    named |= {i: text.encode() for i, text in special.items()}
    return [named[i] for i in range(len(named))]


def piece_entries(model: bytes) -> list[bytes]:
    """Bytes of each id of a piece vocabulary; U+2581 is a space, ``<0xHH>`` a byte."""
    from sentencepiece import SentencePieceProcessor

    pieces = SentencePieceProcessor(model_proto=model)
    return [bytes([int(pieces.id_to_piece(i)[3:5], 16)]) if pieces.is_byte(i) else pieces.id_to_piece(i).replace("▁", " ").encode()
            for i in range(pieces.get_piece_size())]


def possible_pairs(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """Codes of all id pairs of which one token's bytes end the other's, ascending."""
    found = set()
    for many, others, swapped in ((a, b, False), (b, a, True)):
        ids: dict[bytes, list[int]] = {}
        for i, entry in enumerate(others):
            ids.setdefault(entry, []).append(i)
        for i, entry in enumerate(many):
            for cut in range(len(entry)):
                for j in ids.get(entry[cut:], ()):
                    found.add((j << 32 | i) if swapped else (i << 32 | j))
    return np.array(sorted(found), np.uint64)


class PerfectHash:
    """Minimal perfect hash of distinct numbers: a number's place is the rank of its bit.

    Each level has two bits per number still without a place; numbers alone on a bit keep
    it, the others go on to the next level.  Some four bits per number in all.  Keys are
    kept beside it, so a foreign number is told apart from a known one.
    """

    def __init__(self, keys: np.ndarray):
        self.levels, left, placed = [], keys, 0
        while len(left):
            size = -(-max(2 * len(left), 64) // 64) * 64
            at = self._at(left, len(self.levels), size)
            alone = np.bincount(at, minlength=size)[at] == 1
            bits = np.zeros(size, bool)
            bits[at[alone]] = True
            words = np.packbits(bits, bitorder="little").view(np.uint64)
            counted = np.bitwise_count(words).astype(np.int64)
            self.levels.append((size, words, placed + np.cumsum(counted) - counted))
            left, placed = left[~alone], placed + int(alone.sum())
        self.keys = np.zeros(placed, np.uint64)
        self.keys[self._places(keys)] = keys

    def __len__(self) -> int:
        return len(self.keys)

    @staticmethod
    def _at(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mixed(keys + _U(0x9E3779B97F4A7C15 * (level + 1) & (1 << 64) - 1)) % _U(size)).astype(np.int64)

    def _places(self, keys: np.ndarray) -> np.ndarray:
        out, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, (size, words, rank) in enumerate(self.levels):
            at = self._at(keys[left], level, size)
            word, bit = words[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit) & _U(1) == 1
            below = np.bitwise_count(word[hit] & ((_U(1) << bit[hit]) - _U(1)))
            out[left[hit]] = rank[at[hit] >> 6] + below
            left = left[~hit]
        return out

    def places(self, keys: np.ndarray) -> np.ndarray:
        """A place from 0 on for every known number, -1 for any other."""
        out = self._places(keys)
        if len(self.keys):
            out[self.keys[out] != keys] = -1
        return out


class Aligner:
    """Both tokenizers with their vocabularies; made on the driver, opened in each task."""

    def __init__(self, a_json: str, b_model: bytes):
        self.a_json, self.b_model = a_json, b_model
        self.name = hashlib.sha256(a_json.encode() + b"\0" + b_model).hexdigest()
        self.entries = a, b = byte_level_entries(a_json), piece_entries(b_model)
        self.lengths = [np.array([len(e) for e in side], np.int64) for side in self.entries]
        self.starts = [np.cumsum(n) - n for n in self.lengths]
        self.pools = [np.frombuffer(b"".join(side), np.uint8) for side in self.entries]
        assert all(n.min(initial=1) > 0 for n in self.lengths)
        self.hash = PerfectHash(possible_pairs(a, b))
        #: A piece that goes on behind a blank would join two units: then a text is one unit.
        self.cuts = not any(b" " in e.lstrip(b" ") for e in b)

    def open(self) -> Aligner:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.first = Tokenizer.from_str(self.a_json)
        self.first.no_truncation()
        self.first.no_padding()
        self.first.encode_special_tokens = True
        self.second = SentencePieceProcessor(model_proto=self.b_model)
        return self

    def units(self, text: str | None) -> list[str]:
        if not text:
            return []
        return _CUT.split(text) if self.cuts else [text]

    def spelled(self, side: int, ids: np.ndarray) -> np.ndarray:
        """Bytes of some tokens, one after the other."""
        length = self.lengths[side][ids]
        at = np.repeat(self.starts[side][ids] - np.cumsum(length) + length, length) + np.arange(length.sum())
        return self.pools[side][at]

    def _first_ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.first.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]

    def _joined(self, texts: list[str]) -> list[str]:
        """``texts`` in order, runs of them joined by a blank where both sides begin a token there."""
        if not self.cuts:
            return texts
        out, run = [], []
        for text in texts:
            bare = text and not text[0].isspace() and not text[-1].isspace()
            if run and (not bare or len(run) == JOINED):
                out.append(" ".join(run))
                run = []
            if bare:
                run.append(text)
            else:
                out.append(text)
        return [*out, " ".join(run)] if run else out

    def _same(self, side: int, ids: np.ndarray, sizes: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Which texts the tokens of ``side`` spell byte by byte."""
        so_far, last = np.concatenate(([0], np.cumsum(self.lengths[side][ids]))), np.cumsum(sizes)
        want = np.diff(offsets)
        same = so_far[last] - so_far[last - sizes] == want
        told, bytes_ = self.spelled(side, ids[np.repeat(same, sizes)]), data[np.repeat(same, want)]
        ends = np.cumsum(want[same])
        same[np.flatnonzero(same)[np.searchsorted(ends, np.flatnonzero(told != bytes_), "right")]] = False
        return same

    def tokenised(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts or units and how many each has, for both sides; none where a side does not spell it."""
        spaced = pa.array([" " + t for t in texts], pa.large_string())
        offsets = np.frombuffer(spaced.buffers()[1], np.int64)[: len(texts) + 1]
        data = np.frombuffer(spaced.buffers()[2], np.uint8)[: offsets[-1]] if texts else np.zeros(0, np.uint8)
        flat = lambda ids: np.fromiter(chain.from_iterable(ids), np.int64, sum(map(len, ids)))
        a = flat(self._first_ids(self._joined(texts)))
        ends = np.cumsum(self.lengths[0][a])
        cut = np.searchsorted(ends, offsets[1:])
        if len(texts) and (not len(ends) or ends[-1] != offsets[-1] or (ends[cut] != offsets[1:]).any()):
            each = self._first_ids(texts)
            a, sizes_a = flat(each), np.array([len(x) for x in each], np.int64)
        else:
            sizes_a = np.diff(cut + 1, prepend=0)
        each = self.second.encode(texts, num_threads=1) if texts else []
        b, sizes_b = flat(each), np.array([len(x) for x in each], np.int64)
        same = self._same(0, a, sizes_a, data, offsets) & self._same(1, b, sizes_b, data, offsets)
        return a[np.repeat(same, sizes_a)], np.where(same, sizes_a, 0), b[np.repeat(same, sizes_b)], np.where(same, sizes_b, 0)


class Numbers(dict):
    """A number per unit, in order of asking; ``fresh`` has the units that got one since it was emptied."""

    def __init__(self):
        self.fresh: list[str] = []

    def __missing__(self, unit: str) -> int:
        self[unit] = number = len(self)
        self.fresh.append(unit)
        return number


class Known:
    """What a worker has aligned so far: a number per unit, and by that number what its alignment holds."""

    def __init__(self, aligner: Aligner):
        self.aligner = aligner
        self.clear()

    @property
    def full(self) -> bool:
        return len(self.number) > MOST_UNITS or self.characters > MOST_CHARACTERS

    def clear(self) -> None:
        self.number, self.characters = Numbers(), 0
        self.n_a = self.n_b = self.first_link = np.zeros(0, np.int64)
        self.places, self.groups = np.zeros(0, np.int64), []

    def add(self, units: list[str]) -> None:
        chunk = Chunk(self.aligner, *self.aligner.tokenised(units))
        place = self.aligner.hash.places(chunk.code)
        assert (place >= 0).all()
        before = np.concatenate(([0], np.cumsum(chunk.per_text(np.diff(chunk.bounds)))[:-1])) + len(self.places)
        self.first_link = np.concatenate((self.first_link, before[: len(units)]))
        self.n_a = np.concatenate((self.n_a, chunk.per_text(chunk.sizes[0])))
        self.n_b = np.concatenate((self.n_b, chunk.per_text(chunk.sizes[1])))
        self.places = np.concatenate((self.places, place))
        self.groups += chunk.groups()
        self.characters += sum(map(len, units))

    def numbered(self, units: list[list[str]]) -> list[np.ndarray]:
        """The numbers of each list's units; new ones are aligned first."""
        size = [len(some) for some in units]
        flat = np.fromiter(map(self.number.__getitem__, chain.from_iterable(units)), np.int64, sum(size))
        if self.number.fresh:
            self.add(self.number.fresh)
            self.number.fresh = []
        return np.split(flat, np.cumsum(size)[:-1]) if units else []

    def texts(self, texts: list[str | None]) -> list[np.ndarray]:
        """The numbers of each text's units, none for a text that one of the tokenizers changes.

        Where a unit is changed, the text as a whole decides.
        """
        if self.full:
            self.clear()
        numbers = self.numbered([self.aligner.units(t) for t in texts])
        changed = [i for i, n in enumerate(numbers) if len(n) and not self.n_a[n].all()]
        for i, whole in zip(changed, self.numbered([[texts[i]] for i in changed])):
            numbers[i] = whole if self.n_a[whole].all() else whole[:0]
        return numbers

    def links(self, numbers: np.ndarray) -> np.ndarray:
        """How many links each of these units has."""
        return np.diff(np.append(self.first_link, len(self.places)))[numbers]


class Chunk:
    """Some texts' tokens, one after the other; texts without tokens take no room.

    Every text ends a token on both sides, so groups never reach into the next text.
    """

    def __init__(self, aligner: Aligner, a: np.ndarray, sizes_a: np.ndarray, b: np.ndarray, sizes_b: np.ndarray):
        self.texts = len(sizes_a)
        self.place = np.flatnonzero(sizes_a)
        self.sizes = [sizes_a[self.place], sizes_b[self.place]]
        self.ids = [a, b]
        ends = [np.cumsum(length[ids]) for length, ids in zip(aligner.lengths, self.ids)]
        meets = np.searchsorted(ends[1], ends[0])
        hit = ends[1][meets] == ends[0] if len(meets) else np.zeros(0, bool)
        #: Per link, in order: the token that ends there on either side.
        self.links = np.flatnonzero(hit), meets[hit]
        self.code = (self.ids[0][self.links[0]].astype(np.uint64) << _U(32)) | self.ids[1][self.links[1]].astype(np.uint64)
        #: Links before each text, and behind the last.
        self.bounds = np.searchsorted(self.links[0], np.concatenate(([0], np.cumsum(self.sizes[0]))))

    def per_text(self, values: np.ndarray) -> np.ndarray:
        """``values`` of the texts with tokens, 0 for all others."""
        out = np.zeros(self.texts, np.int64)
        out[self.place] = values
        return out

    def groups(self) -> list[str]:
        """``a1,a2|b1;a3|b2,b3`` of each text: the ids of both sides between common ends."""
        out = [""] * self.texts
        if not len(self.place):
            return out
        (a, b), (at_a, at_b) = self.ids, self.links
        group_a = np.searchsorted(at_a, np.arange(len(a)))
        group_b = np.searchsorted(at_b, np.arange(len(b)))
        place_a = np.arange(len(a)) + np.concatenate(([0], at_b + 1))[group_a]
        place_b = np.arange(len(b)) + (at_a + 1)[group_b]
        ids, mark = np.empty(len(a) + len(b), np.int64), np.full(len(a) + len(b), ord(","), np.uint8)
        ids[place_a], ids[place_b] = a, b
        mark[place_a[at_a]], mark[place_b[at_b]] = ord("|"), ord(";")
        width = len(str(int(ids.max())))
        digits = np.stack([ids // 10**k % 10 for k in range(width - 1, -1, -1)], axis=1).astype(np.uint8) + ord("0")
        used = np.stack([ids >= 10**k if k else np.ones(len(ids), bool) for k in range(width - 1, -1, -1)], axis=1)
        written = np.concatenate((digits, mark[:, None]), axis=1)[np.concatenate((used, np.ones((len(ids), 1), bool)), axis=1)].tobytes().decode()
        length = np.concatenate(([0], np.cumsum(used.sum(axis=1) + 1)))
        cut = length[np.concatenate(([0], np.cumsum(self.sizes[0] + self.sizes[1])))]
        for place, low, high in zip(self.place, cut[:-1], cut[1:]):
            out[place] = written[low : high - 1]
        return out


#: A worker process runs task after task; what it has aligned stays, for one pair of tokenizers.
_KNOWN: dict[str, Known] = {}


def _known(aligner: Aligner) -> Known:
    if aligner.name not in _KNOWN:
        _KNOWN.clear()
        _KNOWN[aligner.name] = Known(aligner.open())
    return _KNOWN[aligner.name]


def _counted(aligner: Aligner):
    """How often a task's texts hold each pair, as slices of one dense vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, total, times = _known(aligner), np.zeros(len(aligner.hash), np.int64), np.zeros(0, np.int64)

        def settled() -> np.ndarray:
            """What the units seen so far add, each as often as texts hold it."""
            links = known.links(np.arange(len(times)))
            return np.bincount(known.places[: links.sum()], np.repeat(times, links), len(total)).astype(np.int64)

        for batch in batches:
            for low, high, _, _ in chunks(batch.column("text")):
                if known.full:
                    total, times = total + settled(), np.zeros(0, np.int64)
                numbers = known.texts(batch.column("text").slice(low, high - low).to_pylist())
                seen = np.bincount(np.concatenate([np.zeros(0, np.int64), *numbers]), minlength=len(known.number))
                seen[: len(times)] += times
                times = seen
        total += settled()
        node, parts = TaskContext.get().partitionId() % NODES, range(0, len(total), SLICE)
        yield pa.RecordBatch.from_arrays([pa.array([p // SLICE for p in parts], pa.int32()), pa.array([node] * len(parts), pa.int32()),
                                          pa.array([pack(total[p : p + SLICE]) for p in parts], pa.binary())], ["slice", "node", "counts"])

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One sum per slice and node of a task's rows, added as they come."""
    total: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        for row in batch.to_pylist():
            key, more = (row["slice"], row["node"]), unpack(row["counts"], np.int64)
            total[key] = total[key] + more if key in total else more
    if total:
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in total], pa.int32()), pa.array([k[1] for k in total], pa.int32()),
                                          pa.array([pack(v) for v in total.values()], pa.binary())], ["slice", "node", "counts"])


def pair_counts(documents: DataFrame, aligner: Aligner) -> np.ndarray:
    """How often each pair is linked in all of ``documents``, by its place in ``aligner.hash``."""
    schema, width = "slice int, node int, counts binary", shuffle_width(documents.sparkSession)
    vectors = documents.select("text").mapInArrow(_counted(aligner), schema)
    nodes = vectors.repartition(width, "slice", "node").mapInArrow(_added, schema).selectExpr("slice", "0 AS node", "counts")
    whole = nodes.repartition(width, "slice").mapInArrow(_added, schema).orderBy("slice").collect()
    return np.concatenate([unpack(r["counts"], np.int64) for r in whole]) if whole else np.zeros(len(aligner.hash), np.int64)


def token_alignment(documents: DataFrame, a_json: str, b_model: bytes) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups`` of each document.

    A is a byte-level tokenizer over a space and the text whose pre-tokens take a blank
    before them, B a piece tokenizer that puts the space there itself; special strings in a
    text are plain text.  ``groups`` lists the ids
    between byte offsets where both end a token.  A link joins the two tokens that end at
    one offset; ``count_sum`` adds the links' counts over all of ``documents``, ``n_best``
    counts the links whose pair has its B id's highest count, ties included.  A text that is
    null or empty, or that one of the tokenizers changes, has no tokens: zeros and ''.
    Repeated rows and null ids each count and give their row; an empty table gives none.
    Columns beside ``doc_id`` and ``text`` are not read.
    """
    aligner = Aligner(a_json, b_model)
    counts = pair_counts(documents, aligner)
    b_of = (aligner.hash.keys & _U(0xFFFFFFFF)).astype(np.int64)
    highest = np.zeros(len(aligner.lengths[1]), np.int64)
    np.maximum.at(highest, b_of, counts)
    best = counts == highest[b_of]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, number = _known(aligner), None
        for batch in batches:
            for low, high, _, _ in chunks(batch.column("text")):
                numbers = known.texts(batch.column("text").slice(low, high - low).to_pylist())
                at, size = np.concatenate([np.zeros(0, np.int64), *numbers]), np.array([len(n) for n in numbers])
                if number is not known.number:
                    number, facts = known.number, [np.zeros(0, np.int64)] * 3
                fresh = known.links(np.arange(len(facts[0]), len(number)))
                places = known.places[len(known.places) - fresh.sum() :]
                more = [fresh, *[np.diff(np.concatenate(([0], np.cumsum(values[places], dtype=np.int64)))[np.concatenate(([0], np.cumsum(fresh)))]) for values in (best, counts)]]
                facts = [np.concatenate(pair) for pair in zip(facts, more)]

                def total(of_unit: np.ndarray, at=at, size=size) -> pa.Array:
                    so_far, end = np.concatenate(([0], np.cumsum(of_unit[at]))), np.cumsum(size)
                    return pa.array(so_far[end] - so_far[end - size])

                linked, *of_links = map(total, facts)
                told = [total(known.n_a), total(known.n_b), linked, linked, *of_links]
                groups = pa.array([";".join([known.groups[k] for k in n.tolist()]) for n in numbers], pa.large_string()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(low, high - low), *told, groups],
                                                 ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"])

    return documents.selectExpr("CAST(doc_id AS long) AS doc_id", "text").mapInArrow(
        run, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string")
