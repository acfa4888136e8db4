"""The main body of web pages by line-block distribution.

Markup is stripped to lines, one for each block element, stretch of other text and container border. The
length of a line is that of its text outside links; lines known as frame count as empty. Sums over a
sliding window of lines rise above zero at a surge point and fall to zero at a dive point. The stretch
with the most text between surge and dive is the main body, with all further ones that are large or dense;
container borders in a row count as one line, so nested sections do not end a stretch.

What a site repeats on most of its pages (digits aside) is frame; pages of one title count as one, so that
copies of one page on a small site don't turn its body into frame. A second pass learns, over all sites,
the wording of lines that mostly stand outside main bodies (promotions, share lines), runs the
distribution again without them and drops them where a body encloses them. Names are masked only in lines
that keep several other words; a shorter line is known by its exact tag and text (digits aside), and only
on sites that show it outside, or on all if most do.

Pages are parsed once. Their lines are stored as flat arrays, and both passes work on whole batches of them.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Callable, Iterator
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.llm.html import HIDDEN, latest_pages, page_html
from auditloom.runtime import broadcast_if_small, cut_lineage, held_keys, spread, stored

#: Lines in a window; share of a site's pages (of at least SITE_PAGES) from which a line is frame.
WINDOW, SITE_SHARE, SITE_PAGES = 5, 0.5, 3
#: Sites, and share of its sites, on which a wording stands outside main bodies, from which it is frame.
FRAME_SITES, FRAME_SHARE = 2, 0.15
#: Share of the largest stretch's text from which a further one is kept; characters, and characters a line
#: with text, from which a smaller one is dense and kept too.
LARGE_SHARE, DENSE_CHARS, DENSE_LINE = 0.25, 200, 60
#: Words besides capitalised ones that a line must keep for its wording to hold without its names.
KEPT_WORDS = 3
#: Frame lines and wordings (8 bytes each) that are broadcast at most; beyond, they meet the pages by a join.
KEYS_HELD = 500_000

_BLOCK = frozenset(["h1", "h2", "h3", "h4", "h5", "h6", "p", "li"])
_BORDER = frozenset("div section main article aside nav header footer form body table dialog".split())
_CELL = frozenset("td th tr dt dd blockquote caption figcaption".split())
_QUOTED = frozenset(["code", "pre", "samp", "kbd"])
_USED = sorted(_BLOCK | _BORDER | _CELL | _QUOTED | {"a", "button", "title", "br"})
_TOKEN = re.compile(r"<(/?)(?:(" + "|".join(_USED) + r")\b|[a-zA-Z!?])[^<>]*>", re.I)
_MARKS = "»›>/|→·"
_CRUMB = re.compile(rf"\s[{_MARKS}](?:\s|$)")
_DIGITS = re.compile(r"\d+")


class Line:
    """A line of a page: block number (0: none), tag, text, the length of its text in links, and its text outside quoted code."""

    __slots__ = ("no", "tag", "text", "linked", "bare")

    def __init__(self, no: int, tag: str, text: str, linked: int, bare: str):
        self.no, self.tag, self.text, self.linked, self.bare = no, tag, text, linked, bare

    @property
    def weight(self) -> int:
        text = self.text
        if len(text) < 200 and self.tag in ("p", "div", "li") and any(c in text for c in _MARKS) and len(_CRUMB.findall(text)) >= 2:
            return 0  # a trail of sections
        return max(0, len(text) - self.linked)


def _plain(parts: list[str]) -> str:
    text = "".join(parts)
    return " ".join((entities.unescape(text) if "&" in text else text).split())


def page_lines(text: str) -> tuple[str, list[Line]]:
    """Title and lines of a page. ``h1``-``h6``, ``p`` and ``li`` are numbered from 1 in order of opening.

    Cells, terms and quotations are lines of their own. Text in ``code``, ``pre``, ``samp`` and ``kbd``
    belongs to a line's text but not to its ``bare`` text.
    """
    if "<!--" in text or "<s" in text or "<S" in text or "<n" in text or "<N" in text:
        text = HIDDEN.sub(" ", text)
    title: list[str] = []
    lines: list[Line] = []
    no = at = linked = 0
    tag, buf, bare, in_title, in_link, quoted = "", [], None, False, False, False

    def flush() -> None:
        nonlocal buf, bare, linked
        if buf or tag in _BLOCK:
            words = _plain(buf)
            if words or tag in _BLOCK:
                lines.append(Line(no if tag in _BLOCK else 0, tag or "div", words, linked, words if bare is None else _plain(bare)))
            buf, linked = [], 0
        bare = None

    for m in _TOKEN.finditer(text):
        start = m.start()
        if start > at:
            part = text[at:start]
            if in_title:
                title.append(part)
            else:
                buf.append(part)
                if in_link:
                    linked += len(_plain([part]))
                if bare is not None and not quoted:
                    bare.append(part)
        at = m.end()
        name = m[2]
        if name is None:
            continue
        name = name.lower()
        closing = m[1] == "/"
        if name in _BLOCK:
            flush()
            tag = "" if closing else name
            no += not closing
        elif name == "a" or name == "button":
            in_link = not closing
        elif name in _BORDER:
            flush()
            lines.append(Line(0, "", "", 0, ""))
        elif name in _QUOTED:
            if bare is None:
                bare = list(buf)
            quoted = not closing
            buf.append(" ")
            bare.append(" ")
        elif name in _CELL:
            flush()
        elif name == "title":
            in_title = not closing
        else:
            buf.append(" ")
    if at < len(text) and not in_title:
        buf.append(text[at:])
        if bare is not None and not quoted:
            bare.append(text[at:])
    flush()
    return _plain(title), lines


def body_spans(weights: np.ndarray, gaps: np.ndarray, pages: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Which lines lie in a stretch of their page's main body.

    All lines of many pages at once: ``weights``, whether container borders stand before a line (``gaps``), and the
    number of its page, in order. A stretch runs from a surge (a line with text) to the dive, where the
    window holds none. Kept are each page's stretch with the most text and those that hold a quarter of
    its text, or that are dense.
    """
    inside = np.zeros(len(weights), bool)
    full = np.flatnonzero(weights > 0)
    if not len(full):
        return inside
    place = np.cumsum(1 + gaps.astype(np.int64))[full] + pages[full].astype(np.int64) * (window + 2)
    first = np.flatnonzero(np.concatenate([[True], (np.diff(place) > window) | (np.diff(pages[full]) != 0)]))
    last = np.concatenate([first[1:], [len(full)]]) - 1
    mass, count, page = np.add.reduceat(weights[full], first), last - first + 1, pages[full][first]
    starts = np.flatnonzero(np.concatenate([[True], np.diff(page) != 0]))
    most = np.repeat(np.maximum.reduceat(mass, starts), np.diff(np.concatenate([starts, [len(page)]])))
    keep = (mass >= LARGE_SHARE * most) | ((mass >= DENSE_CHARS) & (mass >= DENSE_LINE * count))
    edge = np.zeros(len(weights) + 1, np.int64)
    np.add.at(edge, full[first[keep]], 1)
    np.add.at(edge, full[last[keep]] + 1, -1)
    return np.cumsum(edge[:-1]) > 0


def _key(*parts: str) -> int:
    return xxhash.xxh64_intdigest("\x1f".join(parts).encode("utf-8", "surrogatepass")) - (1 << 63)


def _masked(text: str) -> tuple[str, int]:
    """``text`` with words that hold a capital letter as X, and the number of other words with letters."""
    words = text.split()
    kept = 0
    for i, word in enumerate(words):
        if word.islower():
            kept += 1
        elif word.lower() != word:
            words[i] = "X"
        else:
            kept += word.isalpha()  # scripts without capitals
    return " ".join(words), kept


def wording(line: Line, text: str | None = None) -> tuple[int, bool]:
    """A hash of a line's wording, and whether it is exact; ``text`` is that of the line with numbers as 0, if known.

    Without numbers and capitalised words (names) and by the kind of line, where ``KEPT_WORDS`` other words
    are left; else the exact tag and text, digits aside.
    """
    linked = "a" if line.linked * 2 > len(line.text) else ""
    text = _DIGITS.sub("0", line.text) if text is None else text
    masked, kept = _masked(text)
    if kept < KEPT_WORDS:
        return _key("exact", line.tag, linked, text), True
    return _key("h" if line.tag[:1] == "h" and line.tag != "header" else line.tag, linked, masked), False


def _host(url: str) -> str:
    try:
        return (urlsplit(url.strip()).hostname or "").rstrip(".")
    except ValueError:
        return ""


def lists(rows: list, kind: pa.DataType) -> pa.ListArray:
    """A list column from flat rows of Python lists."""
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in rows])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array([y for x in rows for y in x], kind))


_COLUMNS = [("no", "int", pa.int32()), ("weight", "int", pa.int32()), ("gap", "boolean", pa.bool_()), ("site", "long", pa.int64()), ("wording", "long", pa.int64()), ("exact", "boolean", pa.bool_())]
#: A function of a page's title and lines that gives one value a line for each of its own columns.
Extra = Callable[[str, list[Line]], list[list]]


def _lines_of_pages(cache: DataFrame, more: list[tuple[str, str, pa.DataType]], extra: Extra | None) -> DataFrame:
    """``(url, hk, title, ...)`` with the lines of each page as arrays: those of ``_COLUMNS`` and the extra ones.

    Bare borders are kept as ``gap`` of the next line. ``site`` and ``wording`` are hashes, 0 for a line
    without text; ``site`` belongs to one host, whose hash is ``hk``.
    """
    kept = [*_COLUMNS, *more]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple, tuple] = {}
        for batch in batches:
            urls, hosts, titles = [], [], []
            rows: list[list] = [[] for _ in kept]
            for url, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = page_html(blob.as_py())
                if text is None:
                    continue
                title, lines = page_lines(text)
                hk = _key(_host(url))
                out: list[list] = [[] for _ in _COLUMNS]
                no, weight, gap, site, words, exact = out
                full: list[Line] = []
                border = False
                for x in lines:
                    if not x.text and not x.no:
                        border = True
                        continue
                    full.append(x)
                    no.append(x.no)
                    gap.append(border)
                    border = False
                    if not x.text:
                        weight.append(0), site.append(0), words.append(0), exact.append(False)
                        continue
                    of = (x.tag, x.linked, x.text)
                    got = known.get(of)
                    if got is None:
                        if len(known) > 50_000:
                            known.clear()
                        bare = _DIGITS.sub("0", x.text)
                        got = known[of] = (x.weight, _key(x.tag, bare), *wording(x, bare))
                    weight.append(got[0]), site.append(got[1] ^ hk), words.append(got[2]), exact.append(got[3])
                urls.append(url)
                hosts.append(hk)
                titles.append(_key(_DIGITS.sub("0", title)))
                for column, values in zip(rows, out + (extra(title, full) if extra else []), strict=True):
                    column.append(values)
            yield pa.RecordBatch.from_arrays(
                [pa.array(urls, pa.string()), pa.array(hosts, pa.int64()), pa.array(titles, pa.int64()), *[lists(r, t) for r, (_, _, t) in zip(rows, kept, strict=True)]],
                ["url", "hk", "title", *[n for n, _, _ in kept]],
            )

    schema = "url string, hk long, title long, " + ", ".join(f"{n} array<{t}>" for n, t, _ in kept)
    return spread(latest_pages(cache)).mapInArrow(parse, schema)


class Lines:
    """The lines of a batch of pages, flat: ``page`` is the row of each line."""

    def __init__(self, batch: pa.RecordBatch):
        self.batch, self.urls = batch, batch.column("url")
        self._lists = {n: batch.column(n) for n in batch.schema.names if pa.types.is_list(batch.column(n).type)}
        self.sizes = np.diff(self._lists["weight"].offsets.to_numpy())
        self.page = np.repeat(np.arange(batch.num_rows), self.sizes)
        self.weight, self.wording, self.site = (self.flat(n) for n in ("weight", "wording", "site"))
        self.hk = np.repeat(batch.column("hk").to_numpy(), self.sizes)

    def column(self, name: str) -> pa.Array:
        return self._lists[name].flatten()

    def flat(self, name: str) -> np.ndarray:
        return self.column(name).to_numpy(zero_copy_only=False)

    def inside(self, frame: np.ndarray, known: np.ndarray) -> np.ndarray:
        """Lines with text in the main body, given sorted keys of frame lines and wordings known as such."""
        told = _among(self.wording, known) | _among(self.wording ^ self.hk, known)
        weight = np.where(_among(self.site, frame) | told, 0, self.weight)
        return body_spans(weight, self.flat("gap"), self.page) & (self.wording != 0) & ~told


def _among(values: np.ndarray, keys: np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.zeros(len(values), bool)
    return keys[np.minimum(np.searchsorted(keys, values), len(keys) - 1)] == values


def _over_lines(pages: DataFrame, columns: list[str], frames: DataFrame, known: DataFrame | None, give: Callable[[Lines, np.ndarray], pa.RecordBatch], schema: str) -> DataFrame:
    """``give`` of the lines of each batch of pages and which of them lie inside the main body.

    ``frames`` and ``known`` hold keys of lines; a few are broadcast, many are joined to the pages that have them.
    """
    none = np.empty(0, np.int64)
    held = [held_keys(frames, KEYS_HELD), none if known is None else held_keys(known, KEYS_HELD)]
    rows = pages.select("url", "hk", "weight", "gap", "site", "wording", *columns)
    for name, keys, got, of in (("_f", frames, held[0], "site"), ("_k", known, held[1], "wording")):
        if got is None:
            either = F.col(of) if of == "site" else F.concat(of, F.transform(of, lambda w: w.bitwiseXOR(F.col("hk"))))
            hit = rows.select("url", F.explode(F.array_distinct(either)).alias("k")).join(keys.toDF("k"), "k").groupBy("url").agg(F.collect_set("k").alias(name))
            rows = rows.join(hit, "url", "left")
    shared = pages.sparkSession.sparkContext.broadcast(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [np.unique(batch.column(n).flatten().to_numpy()) if got is None else got for n, got in zip(("_f", "_k"), shared.value, strict=True)]
            lines = Lines(batch)
            yield give(lines, lines.inside(*keys))

    return rows.mapInArrow(run, schema)


def _outside_counts(lines: Lines, inside: np.ndarray) -> pa.RecordBatch:
    """``(wording, hk, exact, within, shown)`` of a batch: how often a site shows a wording, and how often inside bodies."""
    text = lines.wording != 0
    pair = np.stack([lines.wording[text], lines.hk[text]], axis=1)
    each, first, back = np.unique(pair, axis=0, return_index=True, return_inverse=True)
    back = back.ravel()
    exact, count = lines.flat("exact")[text], len(each)
    return pa.RecordBatch.from_pydict({
        "wording": pa.array(each[:, 0], pa.int64()), "hk": pa.array(each[:, 1], pa.int64()), "exact": pa.array(exact[first].astype(bool), pa.bool_()),
        "within": pa.array(np.bincount(back, inside[text], count).astype(np.int64)), "shown": pa.array(np.bincount(back, minlength=count).astype(np.int64)),
    })


def body_stage(
    cache: DataFrame, give: Callable[[Lines, np.ndarray], pa.RecordBatch], schema: str, columns: list[str], more: list[tuple[str, str, pa.DataType]] | None = None, extra: Extra | None = None
) -> DataFrame:
    """``give(lines, inside)`` over all pages, where ``inside`` tells the lines of each page's main body.

    ``columns`` are the line columns that ``give`` reads; ``more`` and ``extra`` add own ones while pages are parsed.
    """
    pages = stored(_lines_of_pages(cache, more or [], extra))
    alike = pages.groupBy("hk", "title").agg(F.count("*").alias("n"))  # copies of a page share its title
    size = alike.groupBy("hk").agg(F.sum("n").alias("pages"), F.count("*").cast("double").alias("titles")).where(F.col("pages") >= SITE_PAGES)
    frames = (
        pages.select("hk", "title", "site").join(broadcast_if_small(alike), ["hk", "title"])
        .select("hk", (F.lit(1.0) / F.col("n")).alias("w"), F.explode(F.array_distinct("site")).alias("k")).where("k <> 0")
        .groupBy("hk", "k").agg(F.count("*").alias("on"), F.sum("w").alias("w")).where(F.col("on") >= SITE_PAGES)
        .join(broadcast_if_small(size), "hk").where(F.col("w") >= F.col("titles") * SITE_SHARE - 1e-9).select("k")
    )
    frames = cut_lineage(frames)
    shown = (
        _over_lines(pages, ["exact"], frames, None, _outside_counts, "wording long, hk long, exact boolean, within long, shown long")
        .groupBy("wording", "hk").agg(F.max("exact").alias("exact"), (F.sum("within") * 2 < F.sum("shown")).alias("out"))
    )
    shown = cut_lineage(shown)
    common = (
        shown.groupBy("wording").agg(F.max("exact").alias("exact"), F.sum(F.col("out").cast("int")).alias("outs"), F.count("*").alias("sites"))
        .where((F.col("outs") >= FRAME_SITES) & (F.col("outs") > F.col("sites") * F.lit(FRAME_SHARE)))
        .select("wording", (~F.col("exact") | (F.col("outs") * 2 > F.col("sites"))).alias("anywhere"))
    )
    common = cut_lineage(common)
    own = shown.where("exact and out").join(broadcast_if_small(common.where("not anywhere")), "wording").select(F.col("wording").bitwiseXOR(F.col("hk")).alias("k"))
    known = cut_lineage(common.where("anywhere").select(F.col("wording").alias("k")).unionByName(own))
    return _over_lines(pages, columns, frames, known, give, schema)


def _numbered(lines: Lines, inside: np.ndarray) -> pa.RecordBatch:
    no = lines.flat("no")
    keep = np.flatnonzero(inside & (no > 0))
    return pa.RecordBatch.from_arrays([lines.urls.take(pa.array(lines.page[keep])), pa.array(no[keep].astype(np.int64))], ["url", "block_no"])


def main_blocks(cache: DataFrame) -> DataFrame:
    """``(url, block_no)`` of the blocks in each page's main body.

    A page is the latest row of its url; null and broken blobs hold none and give no rows, nor do pages
    without text. Blocks are numbered over ``h1``-``h6``, ``p`` and ``li`` in order of opening; blocks
    without text count but are never part of a body. Texts of any length are read whole. Further columns
    are ignored; an empty table gives no rows.
    """
    return body_stage(cache, _numbered, "url string, block_no long", ["no"])
