"""Main text of web pages: blocks by markup, boilerplate by a suffix array over pages of a host."""

from __future__ import annotations

import hashlib
import html as entities
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspan.llm.packing import grouped, pack, pack_sorted, unpack, unpack_sorted
from shelfspan.llm.words import Words, per_text, shuffle_width, windows
from shelfspan.session import cut_lineage

#: Pages of one host are taken together up to so many bytes of markup; a larger host is split.
GROUP_BYTES = 4 << 20
#: Up to so many split hosts are sent to every task; more are joined by a shuffle.
MOST_SPLIT_HOSTS = 100_000
#: Runs of a split host are first counted by so many values of their hash.
SLOTS = 1 << 16
PLAIN, CHROME, MAIN = 0, 1, 2
#: While a page is read: inside an element named like chrome, and an article that is in one.
_NAMED, _HELD = 3, 4
_PIECE = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|select|svg|iframe|title)\b[^>]*>.*?(?:</\1\s*>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][\w:-]*)([^>]*)>",
    re.S | re.I)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_CHROME_TAGS = set("nav header footer aside form button dialog menu".split())
_CHROME_NAMES = set(
    "ad ads advert adverts advertisement sponsored promo banner sidebar menu nav navbar navigation breadcrumb breadcrumbs footer header masthead "
    "cookie cookies consent notice alert popup modal overlay newsletter subscribe signup login share social related recommended comment comments "
    "reply replies respond disqus form search pagination pager complementary contentinfo skip toolbar".split())
_MAIN_TAGS = {"article", "main"}
_BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header "
    "hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
_ENDS_P = _BLOCKS - {"html", "head", "body"}
_VOID = {"hr"}


def _named_chrome(attributes: str) -> bool:
    """Whether a whole name, or each piece of it, is one of chrome."""
    return any(_CHROME_NAMES.issuperset(re.split("[_-]+", name)) for found in _NAMES.finditer(attributes) for name in next(x for x in found.groups() if x is not None).lower().split())


def _inside(name: str, attributes: str, outer: int) -> int:
    """State of an element's text from its name and the state around it."""
    if name in _CHROME_TAGS or outer == CHROME:
        return CHROME
    named = name not in ("html", "body") and _named_chrome(attributes)
    if name in _MAIN_TAGS and outer not in (MAIN, _HELD):
        return _HELD if named or outer == _NAMED else MAIN
    if named:
        return CHROME if outer in (MAIN, _HELD) else _NAMED
    return outer


def blocks(page: str) -> list[tuple[str, int]]:
    """Texts of a page's blocks in order, each plain, chrome or main.

    Inline markup leaves no gap and ``br`` a space.  ``article`` and ``main`` make blocks main;
    menus, headers, footers, forms and elements named like chrome or reader comments make
    them chrome, inside an article too.  ``html`` and ``body`` are never chrome, and an
    article named like chrome or in an element so named is main if the page has no other.
    Unclosed elements end with what holds them.
    """
    out: list[tuple[str, int]] = []
    stack: list[tuple[str, int]] = []
    parts: list[str] = []

    def state() -> int:
        return stack[-1][1] if stack else PLAIN

    def flush() -> None:
        text = " ".join(entities.unescape("".join(parts)).split())
        parts.clear()
        if text:
            out.append((text, state()))

    def close(name: str, upto: set[str]) -> None:
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] == name:
                del stack[i:]
                return
            if stack[i][0] in upto:
                return

    at, end = 0, page.rfind(">") + 1
    while at < end:
        piece = _PIECE.search(page, at, end)
        if piece is None:
            break
        parts.append(page[at : piece.start()])
        at = piece.end()
        name = (piece.group(3) or "").lower()
        if not name:
            if piece.group(1):
                parts.append(" ")
            continue
        if name == "br":
            parts.append(" ")
            continue
        block = name in _BLOCKS
        if piece.group(2):
            if block:
                flush()
                close(name, set())
            elif stack and stack[-1][0] == name:
                flush()
                stack.pop()
            continue
        if not block and not (name in ("span", "a", "label", "button") and (name in _CHROME_TAGS or _named_chrome(piece.group(4)))):
            continue
        flush()
        if name in _ENDS_P:
            close("p", _BLOCKS - {"p"})
        if name == "li":
            close("li", {"ul", "ol", "menu"})
        if name not in _VOID:
            stack.append((name, _inside(name, piece.group(4), state())))
    parts.append(page[at:])
    flush()
    held = CHROME if any(kind == MAIN for _, kind in out) else MAIN
    return [(text, {_NAMED: CHROME, _HELD: held}.get(kind, kind)) for text, kind in out]


def _parsed(batch: pa.RecordBatch):
    pages = batch.column("html").to_pylist()
    for low in range(0, len(pages), 256):
        found = [blocks(p or "") for p in pages[low : low + 256]]
        yield pa.RecordBatch.from_arrays(
            [*[batch.column(c).slice(low, len(found)) for c in ("page_id", "url", "host", "parts")], pa.array([[t for t, _ in p] for p in found], pa.list_(pa.string())),
             pa.array([[k for _, k in p] for p in found], pa.list_(pa.int32())), pa.array(_contents(found))], ["page_id", "url", "host", "parts", "texts", "kinds", "content"])


def _open(page: list[tuple[str, int]]) -> list[str]:
    """Texts of a page's blocks that the host's runs are taken from; others are empty."""
    best = MAIN if any(kind == MAIN for _, kind in page) else PLAIN
    return [text if kind == best else "" for text, kind in page]


def _contents(pages: list[list[tuple[str, int]]]) -> list[int]:
    """Equal for pages with the same open text, whatever their url and markup."""
    return [int.from_bytes(hashlib.blake2b(" ".join(filter(None, _open(p))).encode(), digest_size=8).digest(), "little", signed=True) for p in pages]


def _worded(pages: list[list[str]]) -> tuple[Words, np.ndarray]:
    """Words of the blocks of some pages, and the page of each word."""
    lines = [t.encode() for page in pages for t in page]
    w = Words(np.frombuffer(b"".join(lines), np.uint8), np.cumsum([0, *map(len, lines)]), lower=True)
    return w, np.repeat(np.arange(len(pages)), [len(p) for p in pages])[w.text]


def _starts(w: Words, page: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash) of every run of ``span`` words within a page."""
    run = windows(w.hash, span)
    at = np.flatnonzero(page[: len(run)] == page[span - 1 :]) if len(run) else np.zeros(0, np.int64)
    return at, run[at]


def _least(share: float, contents: int) -> int:
    return max(2, int(np.ceil(share * contents)))


def _host_runs(span: int, wanted: bool):
    """Of a batch's pages by host: pages by slot of their runs, or (run, content) in a wanted slot."""

    def run(batch):
        hosts, html = np.array(batch.column("host").to_pylist(), object), batch.column("html").to_pylist()
        for host in dict.fromkeys(hosts):
            rows = np.flatnonzero(hosts == host)
            pages = [blocks(html[i] or "") for i in rows]
            content = np.array(_contents(pages), np.int64)
            kept, first = np.unique(content, return_index=True)
            w, page = _worded([_open(pages[i]) for i in first])
            at, value = _starts(w, page, span)
            slot = (value % np.uint64(SLOTS)).astype(np.int64)
            if wanted:
                mask = np.zeros(SLOTS, bool)
                mask[unpack_sorted(batch.column("slots")[int(rows[0])].as_py()).astype(np.int64)] = True
                value, owner, _ = grouped(value[mask[slot]], kept[page[at][mask[slot]]])
                yield pa.RecordBatch.from_arrays([pa.array([host] * len(value), pa.string()), pa.array(value.view(np.int64)), pa.array(owner, pa.int64())], ["host", "run", "content"])
            else:
                slot, _, _ = grouped(slot, page[at])
                times = np.bincount(slot, minlength=SLOTS).astype(np.uint32)
                yield pa.RecordBatch.from_arrays([pa.array([host], pa.string()), pa.array([pack(times)], pa.binary()), pa.array([pack(kept)], pa.binary())], ["host", "times", "contents"])

    return run


def _slots(share: float):
    """Slots of each host that may hold a run in enough of its pages, and how many are enough."""

    def run(batches):
        times, contents = {}, {}
        for batch in batches:
            for row in batch.to_pylist():
                times[row["host"]] = times.get(row["host"], 0) + unpack(row["times"], np.uint32).astype(np.int64)
                contents[row["host"]] = np.union1d(contents.get(row["host"], np.zeros(0, np.int64)), unpack(row["contents"], np.int64))
        for host, total in times.items():
            least = _least(share, len(contents[host]))
            slots = np.flatnonzero(total >= least).astype(np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array([host], pa.string()), pa.array([pack_sorted(slots)], pa.binary()), pa.array([least], pa.int64())], ["host", "slots", "least"])

    return run


def covered(tokens: np.ndarray, page: np.ndarray, span: int, least_pages: int, content: np.ndarray | None = None) -> np.ndarray:
    """Tokens inside a run of ``span`` (a power of two) that starts in ``least_pages`` pages.

    Pages of equal ``content`` count once.

    Suffixes are ranked by prefix doubling until ``span`` tokens decide; suffixes of equal
    rank are neighbours in the suffix array and share that many tokens.
    """
    n = len(tokens)
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64) + 1
    whole = np.zeros(n, bool)
    whole[: max(n - span + 1, 0)] = page[: max(n - span + 1, 0)] == page[span - 1 :]
    step = 1
    while step < span and n:
        inside = np.zeros(n, bool)
        inside[: n - step] = page[: max(n - step, 0)] == page[step:] if step < n else False
        following = np.zeros(n, np.int64)
        following[: max(n - step, 0)] = rank[step:]
        rank = np.unique(rank * (n + 2) + np.where(inside, following, 0), return_inverse=True)[1].astype(np.int64) + 1
        step *= 2
    page = page if content is None else content[page]
    array = np.lexsort((page, rank))
    array = array[whole[array]]
    edge = np.zeros(n + 1, np.int64)
    if len(array):
        group = rank[array]
        first = np.flatnonzero(np.diff(group, prepend=-1) != 0)
        new_page = (np.diff(group, prepend=-1) != 0) | (np.diff(page[array], prepend=-1) != 0)
        pages = np.add.reduceat(new_page.astype(np.int64), first)
        often = array[np.repeat(pages >= least_pages, np.diff(np.append(first, len(array))))]
        np.add.at(edge, often, 1)
        np.add.at(edge, often + span, -1)
    return np.cumsum(edge[:-1]) > 0


def _main_text(span: int, share: float):
    def run(table: pa.Table, often: pa.Table) -> pa.Table:
        kinds, texts = table.column("kinds").to_pylist(), table.column("texts").to_pylist()
        flat = [t for page in texts for t in page]
        w, page = _worded([_open(list(zip(t, k))) for t, k in zip(texts, kinds)])
        if not len(w):
            gone = np.zeros(0, bool)
        elif table.column("parts")[0].as_py() is None:
            content = np.unique(table.column("content").to_numpy(), return_inverse=True)[1]
            gone = covered(w.hash, page, span, _least(share, int(content.max()) + 1), content)
        else:
            at, value = _starts(w, page, span)
            at = at[np.isin(value, often.column("run").to_numpy().view(np.uint64))]
            edge = np.bincount(at, minlength=len(w) + span) - np.bincount(at + span, minlength=len(w) + span)
            gone = np.cumsum(edge)[: len(w)] > 0
        begin = np.searchsorted(w.text, np.arange(len(flat) + 1))
        out, k = [], 0
        for page, kind in zip(texts, kinds):
            kept, whole, words, lost = [], [], 0, 0
            for text, what in zip(page, kind):
                if what == MAIN:
                    hidden = gone[begin[k] : begin[k + 1]]
                    often = len(hidden) > 0 and hidden.all()
                    words, lost = words + len(hidden), lost + len(hidden) * often
                    whole.append(text)
                    if not often:
                        kept.append(text)
                elif what == PLAIN and MAIN not in kind:
                    hidden = gone[begin[k] : begin[k + 1]]
                    if hidden.any():
                        text = " ".join(x for x, h in zip(text.split(" "), hidden) if not h)
                    if text:
                        kept.append(text)
                k += 1
            # An article that is mostly found again is a copy, not boilerplate.
            out.append(" ".join(whole if 2 * lost > words else kept))
        return pa.table([table.column("page_id").combine_chunks(), table.column("url").combine_chunks(), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())],
                        ["page_id", "url", "text", "n_chars"])

    return run


def main_texts(pages: DataFrame, span: int = 8, share: float = 0.1, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """``page_id, url, text, n_chars``: the article of each page, one row per page.

    Markup gives blocks.  Runs of ``span`` tokens found in at least two and ``share`` of the
    different texts of a host recur.  The blocks of an article are its text, less those that
    recurring runs cover wholly, unless these are most of it; pages without an article keep
    their plain blocks less all recurring runs.  A host up to ``group_bytes`` of markup has a suffix array;
    in a larger one, split by a hash of the page, the runs are counted over all of it by
    hash: first in slots, then exactly where a slot has enough.  Null or empty markup gives
    an empty text; null urls are one host; repeated rows each give a row; an empty table an
    empty result.
    """
    width = shuffle_width(pages.sparkSession)
    host = F.coalesce(F.regexp_extract("url", r"^[A-Za-z][\w+.-]*://([^/?#]*)", 1), F.lit(""))
    named = pages.select("page_id", "url", "html", host.alias("host"))
    parts = named.groupBy("host").agg(F.ceil(F.sum(F.coalesce(F.octet_length("html"), F.lit(0))) / group_bytes).alias("parts"))
    split = cut_lineage(parts.filter("parts > 1"))
    sent = F.broadcast if split.count() <= MOST_SPLIT_HOSTS else lambda df: df
    large = named.select("host", "html").join(sent(split.select("host")), "host", "left_semi")
    slots = cut_lineage(per_text(large, _host_runs(span, False), "host string, times binary, contents binary").repartition(width, "host").mapInArrow(
        _slots(share), "host string, slots binary, least long"))
    runs = per_text(large.join(sent(slots.select("host", "slots")), "host"), _host_runs(span, True), "host string, run long, content long")
    counted = runs.distinct().groupBy("host", "run").agg(F.count("*").alias("pages"))
    often = counted.join(slots.select("host", "least"), "host").filter("pages >= least").select("host", "run")
    often = often.join(sent(split), "host").select("host", F.explode(F.expr("sequence(0L, parts - 1)")).alias("part"), "run")
    parsed = per_text(named.join(sent(split), "host", "left"), _parsed, "page_id long, url string, host string, parts long, texts array<string>, kinds array<int>, content long")
    placed = parsed.withColumn("part", F.pmod(F.xxhash64("page_id", "url"), F.coalesce("parts", F.lit(1))))
    return placed.groupBy("host", "part").cogroup(often.groupBy("host", "part")).applyInArrow(_main_text(span, share), "page_id long, url string, text string, n_chars long")
