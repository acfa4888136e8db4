"""Template residue and error-page text in place of content.

The title and all lines of the main body of each page, numbered blocks or not, are text units; distinct
wordings (numbers aside) are compared. Unfilled placeholders are found by their form. For filler and
for messages (errors, access, maintenance, demands for scripts) a few wordings are trusted: those of a
short general list, and the text of pages that the crawl saw fail and that hold nothing else, where
another page says the same. Near-duplicates
of trusted wordings are found in four tables of 16 bits of a 64-bit SimHash over character runs, probed
with up to three flipped bits, so that no pair within fifteen bits is missed; distance and similarity
are verified, and each connected component gets the label of its trusted members. Components are
explored from those, level by level.

A placeholder or filler makes a page a case; a message does so only where no content stands beside it.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.llm.components import connected_components
from auditloom.llm.mainbody import Line, Lines, body_stage
from auditloom.llm.neardup import mix
from auditloom.runtime import broadcast_if_small, cut_lineage, stored

#: Similarity of the character runs (of GRAM) and SimHash distance up to which two wordings are near-duplicates.
SIMILARITY, GRAM, DISTANCE = 0.8, 5, 15
#: Tables of the SimHash and bits of each; flips that a distance leaves to the best of them.
TABLES, BITS = 4, 16
FLIPS = DISTANCE // TABLES
#: Characters of other running text in a main body from which a message no longer stands in for content.
CONTENT_CHARS = 200
#: Characters from which a unit is tested by sentence, and the share of it that must be message sentences.
LONG_CHARS, MESSAGE_SHARE = 400, 0.3

# Forms of placeholders that templates, mailings and scripts leave behind.
_NAME = r"[A-Za-z_][\w.\- ]{0,60}"
_FORMS = [
    r"\{\{\s*" + _NAME + r"\s*\}\}",
    r"\{%\s*" + _NAME + r"\s*%\}",
    r"<%=?\s*" + _NAME + r"\s*%>",
    r"%%" + _NAME + r"%%",
    r"@@" + _NAME + r"@@",
    r"[#$]\{\s*" + _NAME + r"\s*\}",
    r"(?<![\w{#$])\{[A-Za-z_][\w.]{0,60}\}(?!\})",
    r"\[\[\s*" + _NAME + r"\s*\]\]",
    r"\*\|" + _NAME + r"\|\*",
    r"%\([A-Za-z_][\w.]*\)[sd]",
    r"(?<![\w%])%[sd](?!\w)",
    r"(?<!\w)__[A-Za-z][\w.]*__(?!\w)",
    r"\[INSERT [^\]\[]{1,60}\]",
    r"\[[^\]\[]{1,60} goes here\]",
    r"\[object Object\]",
    r"(?<![\w$.])undefined(?![\w.(])",
    r"(?<!\w)NaN(?!\w)",
    r"(?<!\w)null\W{1,3}null(?!\w)",
    r"(?<!\w)TBD(?:\s+TBD)+(?!\w)",
    r"(?i:\buntitled (?:template|document|page)\b)",
]
PLACEHOLDER = re.compile("|".join(_FORMS))

_HINT = re.compile(r"[{%\[$#*<@]|__|undefined|NaN|null|TBD|ntitled")  # without one of these no form can match

# Trusted wordings of filler. All others come by propagation.
_FILLER = [
    r"^lorem ipsum\b",
    r"^(?:this|here) is (?:some )?(?:sample|placeholder|dummy|filler) text\b",
    r"\b(?:blindtext|platzhaltertext)\b",
    r"\btexte (?:factice|provisoire)\b",
    r"\btexto de (?:relleno|ejemplo|exemplo)\b",
    r"\bclick (?:here )?to edit\b",
    r"\byour (?:headline|title|text) (?:goes )?here\b",
]
FILLER = re.compile("|".join(_FILLER))

# Trusted wordings of messages. All others come from failed pages and by propagation.
_MESSAGES = [
    r"\b(?:javascript|scripts)\b",
    r"\bnot found\b",
    r"\baccess denied\b",
    r"\bserver error\b",
    r"\b(?:under(?:going)?|down for) maintenance\b",
    r"\bstack trace\b|\bfatal error\b",
]
MESSAGE = re.compile("|".join(_MESSAGES))

_QUOTED = re.compile(r"“[^”]{0,200}”|„[^“”]{0,200}[“”]|«[^»]{0,200}»|\"[^\"]{0,200}\"|‘[^’]{0,80}’|`[^`]{0,200}`")
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\s+(?=#\d+\s)")
_TRACE = re.compile(r"^#?\d+\s+\S|^at [\w.$<>]+\(|\bon line \d+|^file \"[^\"]+\", line \d+")
_PART = re.compile(r"\s+[|–—»·-]\s+")
_NUMBER = re.compile(r"\d\w*")
# Without one of these parts no listed wording can match.
_HINTS = ("lorem ipsum", "text", "edit", "here", "script", "not found", "denied", "server error", "maintenance", "trace", "fatal error")


def unit_wording(text: str) -> str:
    """A unit in lower case, single spaces and with numbers, and identifiers from their first digit on, as 0, by which near-duplicates are compared."""
    return " ".join(_NUMBER.sub("0", text).lower().split())


@lru_cache(50_000)
def _unit(text: str) -> tuple[bool, str]:
    return has_placeholder(text), unit_wording(text)


def grams(text: str) -> set[str]:
    """Character runs of a wording (the whole of a shorter one)."""
    return {text[i : i + GRAM] for i in range(max(1, len(text) - GRAM + 1))}


def simhashes(texts: list[str]) -> np.ndarray:
    """64-bit SimHash over the character runs of each text (a shorter one is filled up to one run)."""
    out = np.zeros((len(texts), 64), bool)
    at = 0
    while at < len(texts):  # some hundred thousand characters at a time
        part, held = [], 0
        while at + len(part) < len(texts) and (not part or held < 300_000):
            part.append(np.frombuffer(texts[at + len(part)].ljust(GRAM, "\0").encode("utf-32-le", "surrogatepass"), np.uint32))
            held += len(part[-1])
        flat = np.concatenate([*part, np.zeros(GRAM, np.uint32)]).astype(np.uint64)
        h = np.zeros(held, np.uint64)
        with np.errstate(over="ignore"):
            for k in range(GRAM):
                h = h * np.uint64(0x100000001B3) + flat[k : k + held]
        octets = mix(h).view(np.uint8).reshape(-1, 8)
        start = 0
        for i, c in enumerate(part, at):
            runs = len(c) - GRAM + 1
            ones = np.unpackbits(octets[start : start + min(runs, 65_536)], axis=1).sum(axis=0, dtype=np.int64)
            for j in range(start + 65_536, start + runs, 65_536):  # of a very long text
                ones += np.unpackbits(octets[j : min(j + 65_536, start + runs)], axis=1).sum(axis=0, dtype=np.int64)
            out[i] = ones * 2 > runs
            start += len(c)
        at += len(part)
    return np.packbits(out, axis=1).view(np.int64).ravel()


def trusted_label(wording: str) -> str | None:
    """``filler``, ``message`` or None for a wording by the short list alone; quoted words are neither.

    One word that makes up most of five or more is filler. A long unit is a message if its first sentence
    is and message sentences (or calls of a stack trace) hold at least ``MESSAGE_SHARE`` of it.
    """
    words = wording.split()
    same = len(words) >= 5 and len(set(words)) <= 0.2 * len(words) + 1
    if not same and not any(x in wording for x in _HINTS):
        return None
    bare = _QUOTED.sub(" ", wording)
    words = bare.split()
    if FILLER.search(bare) or (len(words) >= 5 and len(set(words)) <= 0.2 * len(words) + 1 and Counter(w.strip(".,;:!?") for w in words).most_common(1)[0][1] >= 0.8 * len(words)):
        return "filler"
    if not MESSAGE.search(bare):
        return None
    if len(bare) <= LONG_CHARS:
        return "message"
    parts = _SENTENCE.split(bare)
    told = [len(x) for x in parts if MESSAGE.search(x) or _TRACE.search(x)]
    return "message" if MESSAGE.search(parts[0]) and sum(told) >= MESSAGE_SHARE * len(bare) else None


def has_placeholder(text: str) -> bool:
    """Whether a placeholder stands in the text outside quotation marks."""
    return bool(_HINT.search(text)) and bool(PLACEHOLDER.search(_QUOTED.sub(" ", text)))


_HEADING, _PLACEHOLDER, _TITLE = 1, 2, 4
_MORE = [("mark", "int", pa.int32()), ("chars", "int", pa.int32()), ("words", "string", pa.string()), ("top_mark", "int", pa.int32()), ("top", "string", pa.string())]
_UNITS = "url string, mark int, chars int, thin boolean, wording string, id long, sim long, seed int"
_LABELS = [None, "filler", "message"]


def _marked(title: str, lines: list[Line]) -> list[list]:
    """The columns of ``_MORE`` of one page: its lines as units, then its title and the parts of it."""
    tops = [x for x in dict.fromkeys([title, *_PART.split(title)]) if x]
    units, heads = [_unit(x.bare) for x in lines], [_unit(x) for x in tops]
    return [
        [_HEADING * (x.tag[0] == "h" and x.no > 0) + _PLACEHOLDER * u[0] for x, u in zip(lines, units, strict=True)], [len(x.bare) for x in lines], [u[1] for u in units],
        [_TITLE + _PLACEHOLDER * u[0] for u in heads], [u[1] for u in heads],
    ]


def _units_of(lines: Lines, inside: np.ndarray) -> pa.RecordBatch:
    mark, chars = lines.flat("mark"), lines.flat("chars")
    text = inside & (mark & _HEADING == 0)
    thin = np.bincount(lines.page, np.where(text, chars, 0), lines.batch.num_rows) < CONTENT_CHARS
    keep = np.flatnonzero(inside & (chars > 0))
    tops = np.diff(lines.batch.column("top").offsets.to_numpy())
    page = np.concatenate([lines.page[keep], np.repeat(np.arange(lines.batch.num_rows), tops)])
    words = lines.column("words").take(pa.array(keep)).to_pylist() + lines.column("top").to_pylist()
    each = {w: i for i, w in enumerate(dict.fromkeys(words))}
    at = np.array([each[w] for w in words], np.int64)
    ids = np.array([xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")) - (1 << 63) for w in each], np.int64)
    seed = np.array([_LABELS.index(trusted_label(w)) for w in each], np.int32)
    return pa.RecordBatch.from_arrays(
        [lines.urls.take(pa.array(page)), pa.array(np.concatenate([mark[keep], lines.flat("top_mark")]).astype(np.int32)),
         pa.array(np.concatenate([chars[keep], np.zeros(tops.sum(), np.int64)]).astype(np.int32)), pa.array(thin[page]), pa.array(words, pa.string()),
         pa.array(ids[at]), pa.array(simhashes(list(each))[at]), pa.array(seed[at])],
        ["url", "mark", "chars", "thin", "wording", "id", "sim", "seed"],
    )


def page_units(cache: DataFrame) -> DataFrame:
    """One row for each text unit: title, its parts between separators, and lines of the main body.

    Text in ``code``, ``pre``, ``samp`` and ``kbd`` is quoted and left out. ``thin`` tells pages whose
    bodies hold less running text than ``CONTENT_CHARS``.
    """
    return body_stage(cache, _units_of, _UNITS, [n for n, _, _ in _MORE], _MORE, _marked)


def filler_words(units: DataFrame) -> list[str]:
    """Words that stand in at least a tenth of the wordings that open as filler Latin: at most ten times their mean length."""
    latin = units.where("seed = 1 and wording like 'lorem ipsum%'").select("wording").distinct()
    n = latin.count()
    words = latin.select(F.explode(F.array_distinct(F.split("wording", r"[^\p{L}]+"))).alias("word")).where("length(word) > 2")
    return [r.word for r in words.groupBy("word").count().where(F.col("count") >= max(3.0, n / 10)).collect()]


def learnt_filler(units: DataFrame) -> DataFrame:
    """``(id, label)`` of wordings of eight words or more of which four fifths are filler words.

    The words are learnt from all wordings that open as filler Latin; without enough of them none is found.
    """
    known = filler_words(units)
    if not known:
        return units.where("false").select("id", F.lit("filler").alias("label"))
    words = F.split("wording", " ")
    # So many words from the start can't all be others.
    head = F.array_join(F.slice(words, 1, F.floor(F.size(words) * 0.2).cast("int") + 1), " ")
    told = units.where((F.col("seed") == 0) & (F.size(words) >= 8) & head.rlike("|".join(known))).select("id", words.alias("w"))
    bare = F.filter(F.transform("w", lambda x: F.regexp_replace(x, r"[^\p{L}]", "")), lambda x: x.isin(known))
    return told.where(F.size(bare) >= F.size("w") * 0.8).select("id").distinct().withColumn("label", F.lit("filler"))


def _flips() -> list[int]:
    return [sum(1 << b for b in c) for k in range(FLIPS + 1) for c in combinations(range(BITS), k)]


def near_links(units: DataFrame, wordings: DataFrame, frontier: DataFrame, but: DataFrame) -> DataFrame:
    """``(id, of)``: wordings near to one of ``frontier`` (id, sim), those of ``but`` (id) left out.

    Every pair within ``DISTANCE`` bits agrees in one of the tables but for at most ``FLIPS`` bits, so
    the flipped keys of the frontier meet the plain keys of all others. Then the distance and the
    similarity of the texts themselves are verified.
    """
    table = lambda t: F.shiftrightunsigned(F.col("sim"), t * BITS).bitwiseAND(F.lit((1 << BITS) - 1)).bitwiseOR(F.lit(t << BITS)).cast("int")
    own = F.array(*[table(t) for t in range(TABLES)])
    probes = frontier.select(F.col("id").alias("of"), F.col("sim").alias("osim"), F.explode(own).alias("k0"))
    probes = probes.select("of", "osim", F.explode(F.transform(F.lit(_flips()), lambda m: F.col("k0").bitwiseXOR(m))).alias("k"))
    plain = wordings.join(broadcast_if_small(but.select("id")), "id", "left_anti").select("id", "sim", F.explode(own).alias("k"))
    near = F.bit_count(F.col("sim").bitwiseXOR(F.col("osim"))) <= DISTANCE
    pairs = cut_lineage(plain.join(probes, "k").where(near).select("id", "of").distinct())
    used = pairs.select(F.explode(F.array("id", "of")).alias("id")).distinct()
    texts = cut_lineage(units.select("id", "wording").join(broadcast_if_small(used), "id", "left_semi").dropDuplicates(["id"]))
    both = broadcast_if_small(pairs).join(texts, "id").join(broadcast_if_small(texts.select(F.col("id").alias("of"), F.col("wording").alias("like")), 20_000), "of")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = grams(a), grams(b)
                same = len(x & y)
                keep.append(same >= SIMILARITY * (len(x) + len(y) - same))
            got = batch.filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays([got.column(i) for i in range(2)], ["id", "of"])

    return both.select("id", "of", "wording", "like").mapInArrow(verify, "id long, of long")


def propagate(units: DataFrame, wordings: DataFrame, trusted: DataFrame) -> DataFrame:
    """``(id, label)`` of every wording in a connected component of near-duplicates with a trusted one.

    ``units``: id, wording; ``wordings``: id, sim, one row an id; ``trusted``: id, label, one row an id. If
    a component holds several labels, the greatest (``message``) is given.
    """
    frontier = cut_lineage(wordings.select("id", "sim").join(broadcast_if_small(trusted.select("id")), "id", "left_semi"))
    reached, links = frontier.select("id"), None
    while frontier.limit(1).count():
        found = cut_lineage(near_links(units, wordings, frontier, reached))
        links = found if links is None else links.unionByName(found)
        frontier = cut_lineage(wordings.select("id", "sim").join(broadcast_if_small(found.select("id").distinct()), "id", "left_semi"))
        reached = reached.unionByName(frontier.select("id"))
    if links is None:
        return trusted
    parts = connected_components(links.select(F.col("id").alias("a"), F.col("of").alias("b"))).withColumnRenamed("node", "id")
    parts = cut_lineage(parts)
    told = parts.join(trusted, "id").groupBy("component").agg(F.max("label").alias("label"))
    return trusted.unionByName(parts.join(told, "component").select("id", "label")).groupBy("id").agg(F.max("label").alias("label"))


def residue_pages(cache: DataFrame, statuses: DataFrame | None = None) -> DataFrame:
    """``(url, reason, trusted)`` of every page whose title or main body holds residue.

    ``reason`` is ``placeholder``, ``filler`` or ``message`` (the first that holds); ``trusted`` tells
    pages found by their own form, listed wording or failure, the others came by propagation. A page is
    the latest row of its url; null and broken blobs hold none. ``statuses`` (url, status; of several the highest counts, null is none) only
    adds trusted wordings: those of pages of status 400 or more without content, where another page says
    the same. Pages without text and empty tables give no rows; texts are read whole.
    """
    units = stored(page_units(cache))
    where = F.xxhash64("url")
    wordings = stored(units.where("wording <> ''").groupBy("id").agg(F.max("sim").alias("sim"), F.max("seed").alias("seed"), (F.min(where) != F.max(where)).alias("repeated")))
    listed = wordings.where("seed > 0").select("id", F.when(F.col("seed") == 2, "message").otherwise("filler").alias("label"))
    own = cut_lineage(listed.unionByName(learnt_filler(units)))
    failed, trusted = None, own
    if statuses is not None:
        failed = cut_lineage(statuses.where("url is not null and status >= 400").select("url").distinct())
        alone = units.where(f"thin and mark & {_HEADING + _TITLE} = 0 and wording <> ''").join(broadcast_if_small(failed), "url", "left_semi").select("id").distinct()
        alone = wordings.where("repeated").select("id").join(broadcast_if_small(alone), "id", "left_semi").withColumn("label", F.lit("message"))
        trusted = cut_lineage(own.unionByName(alone).groupBy("id").agg(F.max("label").alias("label")))
    labels = propagate(units, wordings, trusted).join(own.select("id", F.lit(True).alias("own")), "id", "left")
    labelled = units.select("url", "mark", "chars", "thin", "id").join(broadcast_if_small(cut_lineage(labels)), "id", "left")
    bit = lambda b: F.col("mark").bitwiseAND(b) != 0
    page = labelled.groupBy("url").agg(
        F.max(bit(_PLACEHOLDER)).alias("placeholder"), F.max(F.col("label").eqNullSafe("filler")).alias("filler"), F.max(F.col("label").eqNullSafe("message")).alias("message"),
        F.sum(F.when(F.col("label").isNull() & ~bit(_HEADING + _TITLE), F.col("chars")).otherwise(0)).alias("content"), F.max("thin").alias("thin"), F.max(F.coalesce("own", F.lit(False))).alias("own"),
    )
    reason = (
        F.when(F.col("placeholder"), "placeholder").when(F.col("filler"), "filler")
        .when(F.col("message") & (F.col("content") < CONTENT_CHARS), "message")
    )
    page = page.withColumn("reason", reason).where("reason is not null")
    if failed is not None:
        page = page.join(broadcast_if_small(failed.select("url", F.lit(True).alias("failed"))), "url", "left")
    else:
        page = page.withColumn("failed", F.lit(False))
    return page.select("url", "reason", (F.col("placeholder") | F.col("own") | (F.col("thin") & F.coalesce("failed", F.lit(False)))).alias("trusted"))
