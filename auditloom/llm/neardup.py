"""Near-duplicate pages by the generalised pigeonhole principle over their word-run sets.

A page is a bit vector with one bit for each possible run of words. A Jaccard similarity of at least t
between sets of sizes a and b means a Hamming distance of at most (1 - t) / (1 + t) * (a + b). Within a class
of sizes the bits fall into partitions, some for each class, by their hash; a partition's value is that of all bits of a
page in it. Two near pages differ in no more partitions than their distance.

How many pages share each value is counted exactly. A page with more values of its own than its largest
distance is near to none and leaves. Each of the rest gets a threshold for each of its partitions, 0 (probed for an equal
value) or -1 (not probed): of all allotments that keep the pigeonhole bound, the one with the fewest
candidates by those counts. As a partition costs what its count says, whatever the others get, the dynamic programme
over them comes down to taking them in the order of their counts. Values that no other page has cost nothing and come first;
values of a site's frame or of a template, shared by many, come last and are rarely probed. A few
partitions more than the bound asks for are probed, and a pair must agree on so many more of them.
Candidates are verified on the exact sets. Equal sets are collapsed before and expanded at the end.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditloom.llm.components import SALTS, connected_components
from auditloom.llm.html import latest_pages, page_html, visible_words
from auditloom.runtime import broadcast_if_small, cut_lineage, join_per_key, small_enough, spread, stored

RUN = 5
#: Sizes up to which each bit is a partition of its own; above, sizes double from class to class, and the
#: largest of a class has so many bits a partition, of which there are at least so many: enough that the
#: partitions with bits outnumber the distance but for accidents of the hash rarer than 1 in 10 ** 15.
SMALL, BITS, LEAST = 32, 4, 32
#: Partitions that are probed beyond the bound.
EXTRA = 8
#: Repeated values, and bytes of sets, that are broadcast at most.
VALUES_HELD, SETS_HELD = 1_000_000, 24 << 20

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser over uint64 values."""
    with np.errstate(over="ignore"):
        z = x + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
        z = (z ^ (z >> np.uint64(30))) * _M1
        z = (z ^ (z >> np.uint64(27))) * _M2
        return z ^ (z >> np.uint64(31))


def word_runs(words: list[str], run: int = RUN) -> np.ndarray:
    """The set of word runs as sorted 64-bit hashes; fewer words than a run make the empty set."""
    if len(words) < run:
        return np.empty(0, np.int64)
    text = np.frombuffer(("\n".join(words) + "\n").encode("utf-8", "surrogatepass"), np.uint8)
    ends = np.flatnonzero(text == 10)  # words hold no white space
    starts = np.concatenate([[0], ends[:-1] + 1])
    with np.errstate(over="ignore"):
        power = np.cumprod(np.full(int((ends - starts).max()) + 1, 0x9E3779B97F4A7C15, np.uint64))
        at = np.arange(len(text)) - np.repeat(starts, ends - starts + 1)
        ids = mix(np.add.reduceat(mix(text.astype(np.uint64), 3) * power[at], starts))
        out = np.zeros(len(ids) - run + 1, np.uint64)
        for k in range(run):
            out = mix(out * np.uint64(3) + ids[k : len(ids) - run + 1 + k], k)
    return np.unique(out.view(np.int64))


def top(n: int) -> int:
    """The largest size of the class of ``n``."""
    return SMALL if n <= SMALL else SMALL << math.ceil(math.log2(n / SMALL) - 1e-12)


def cells(runs: np.ndarray, largest: int) -> np.ndarray:
    """The values of all partitions that hold a bit of the set, in the class of sizes up to ``largest``."""
    bits = runs.view(np.uint64)
    if largest <= SMALL:
        return mix(bits, 50).view(np.int64)
    total = np.zeros(max(LEAST, largest // BITS), np.uint64)
    part = (mix(bits, 31) % np.uint64(len(total))).astype(np.int64)
    with np.errstate(over="ignore"):
        np.add.at(total, part, mix(bits, 41))
        held = np.bincount(part, minlength=len(total)) > 0
        number = np.arange(len(total), dtype=np.uint64) + np.uint64(largest << 32)
        return mix(total + mix(number, 43), 44)[held].view(np.int64)


def distance(larger: Column, smaller: Column, threshold: float) -> Column:
    """The largest Hamming distance of a near pair of these sizes."""
    return F.floor((larger + smaller) * F.lit((1 - threshold) / (1 + threshold)) + F.lit(1e-9))


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[str], list[np.ndarray]]]:
    for batch in batches:
        urls, sets = [], []
        for url, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            text = page_html(blob.as_py())
            runs = word_runs(visible_words(text)) if text else ()
            if len(runs):
                urls.append(url)
                sets.append(runs)
        yield urls, sets


def _lists(rows: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in rows])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(rows) if rows else np.empty(0, np.int64), pa.int64()))


def page_cells(cache: DataFrame, threshold: float) -> DataFrame:
    """``(url, a, b, n, own, next)`` of every page with a run of words.

    ``a`` and ``b`` are hashes of its set, ``n`` its size, ``own`` the partition values in its class, ``next`` those in the
    following one if a near page may be of that.
    """
    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for urls, sets in _sets(batches):
            with np.errstate(over="ignore"):
                both = [[int(mix(mix(x.view(np.uint64), s).sum(keepdims=True) ^ np.uint64(len(x)), s + 1).view(np.int64)[0]) for x in sets] for s in (7, 17)]
            own = [cells(x, top(len(x))) for x in sets]
            following = [cells(x, 2 * top(len(x))) if len(x) / threshold > top(len(x)) else x[:0] for x in sets]
            yield pa.RecordBatch.from_arrays(
                [pa.array(urls, pa.string()), *[pa.array(h, pa.int64()) for h in both], pa.array([len(x) for x in sets], pa.int32()), _lists(own), _lists(following)],
                ["url", "a", "b", "n", "own", "next"],
            )

    return spread(latest_pages(cache)).mapInArrow(parse, "url string, a long, b long, n int, own array<long>, next array<long>")


def sets_of(cache: DataFrame, urls: DataFrame) -> DataFrame:
    """``(url, runs)``: the sets of the pages of some urls."""
    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found, sets in _sets(batches):
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), _lists(sets)], ["url", "runs"])

    some = cache.join(broadcast_if_small(urls.select("url")), "url", "left_semi")
    return spread(latest_pages(some)).mapInArrow(parse, "url string, runs array<long>")


def candidates(reps: DataFrame, threshold: float) -> DataFrame:
    """``(a, b)``: pairs of sets that agree on enough of the probed partitions; every near pair is among them, ``a`` the larger set.

    ``reps``: sid BIGINT (unique), n, own, next.
    """
    side = lambda c: reps.where(F.size(c) > 0).select("sid", "n", F.lit(c == "own").alias("own"), F.size(c).alias("held"), F.explode(c).alias("sig"))
    values = side("own").unionByName(side("next"))
    shared_by = cut_lineage(values.groupBy("sig").agg(F.count("*").alias("df")).where("df > 1"))
    met = values.join(F.broadcast(shared_by) if small_enough(shared_by, VALUES_HELD) else shared_by, "sig")
    each = Window.partitionBy("sid", "own")  # no more rows than a set has partitions
    n = F.col("n").cast("double")
    met = met.select(
        "sid", "n", "own", "sig", "df", (F.col("held") - F.count("*").over(each)).alias("alone"), F.row_number().over(each.orderBy("df", "sig")).alias("order"), F.count("*").over(each).alias("shared"),
    ).where(F.col("alone") <= distance(n / threshold, n, threshold))
    met = cut_lineage(met)
    most = distance(n, n, threshold)
    probes = F.least(F.col("shared"), most + 1 + EXTRA - F.col("alone"))  # thresholds 0, in the order of their counts; the rest -1
    left = met.where(F.col("own") & (F.col("alone") <= most) & (F.col("order") <= probes)).select(
        "sig", F.col("sid").alias("a"), F.col("n").alias("na"), (F.col("alone") + probes - most).alias("needed")
    )
    right = met.select("sig", F.col("sid").alias("b"), F.col("n").alias("nb"))
    smaller = (F.col("nb") < F.col("na")) | ((F.col("nb") == F.col("na")) & (F.col("b") < F.col("a")))
    both = left.join(right, "sig").where(smaller & (F.col("nb") >= F.col("na") * F.lit(threshold - 1e-9)))
    return both.groupBy("a", "b").agg(F.count("*").alias("agreed"), F.max("needed").alias("needed")).where("agreed >= needed").select("a", "b")


def near_pages(cache: DataFrame, threshold: float = 0.85) -> tuple[DataFrame, DataFrame]:
    """Members ``(url, sid)`` of each distinct set and near pairs ``(a, b, similarity)`` of distinct sets.

    A page is the latest row of its url; null and broken blobs hold none. Pages of fewer than five words
    have no runs and match nothing. Any number of equal pages is one set; sets are told apart by 128 bits.
    Empty tables give no rows.
    """
    pages = stored(page_cells(cache, threshold))
    first = cut_lineage(pages.groupBy("a", "b").agg(F.min("url").alias("url")))
    for salt in range(SALTS):  # until no two sets share a number
        number = F.xxhash64(F.lit(salt), "a", "b")
        if not first.groupBy(number.alias("sid")).count().where("count > 1").limit(1).count():
            break
    reps = pages.join(broadcast_if_small(first.select("url")), "url", "left_semi").select(number.alias("sid"), "url", "n", "own", "next")
    pairs = cut_lineage(candidates(reps, threshold))
    used = pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct()
    wanted = cut_lineage(reps.select("sid", "url", "n").join(broadcast_if_small(used), "sid", "left_semi"))
    sets = stored(sets_of(cache, wanted).join(broadcast_if_small(wanted), "url").select("sid", "n", "runs"))
    held = (wanted.agg(F.sum("n")).first()[0] or 0) * 8 <= SETS_HELD
    side = lambda x: sets.select(F.col("sid").alias(x), F.col("n").alias(f"n{x}"), F.col("runs").alias(f"r{x}"))
    both = F.size(F.array_intersect("ra", "rb"))
    # Held sets meet the pairs where those met the sets of the other side, so no set is moved for each of its pairs.
    near = pairs.join(side("a").hint("merge"), "a").join(F.broadcast(side("b")) if held else side("b"), "b").select("a", "b", (both / (F.col("na") + F.col("nb") - both)).alias("similarity"))
    return pages.select("url", number.alias("sid")), near.where(F.col("similarity") >= threshold)


def page_pairs(cache: DataFrame, threshold: float = 0.85) -> DataFrame:
    """``(url_a, url_b)``, ``url_a`` < ``url_b``, for all near pages, equal ones included.

    The form with one row for each two pages; its size is that of the answer. ``page_classes`` is the
    compact form.
    """
    members, pairs = near_pages(cache, threshold)
    a, b = (members.select(F.col("url").alias(f"u{x}"), F.col("sid").alias(x)) for x in "ab")
    across = pairs.join(a, "a").join(b, "b").select(F.least("ua", "ub").alias("url_a"), F.greatest("ua", "ub").alias("url_b"))
    # Each page of a crowd meets a slice of the others at a time, so that a large crowd is spread over many tasks.
    size = cut_lineage(members.groupBy("sid").agg(F.count("*").alias("k")).where("k > 1"))
    slices = F.greatest(F.lit(1), F.ceil(F.col("k") / 1000)).cast("int")
    shared = join_per_key(members, size.select("sid", slices.alias("slices")), "sid")
    left = shared.select(F.col("url").alias("url_a"), "sid", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"))
    right = shared.select(F.col("url").alias("url_b"), "sid", F.pmod(F.xxhash64("url"), F.col("slices").cast("long")).cast("int").alias("slice"))
    equal = left.join(right, ["sid", "slice"]).where("url_a < url_b").select("url_a", "url_b")
    return across.unionByName(equal)


def page_classes(cache: DataFrame, threshold: float = 0.85) -> DataFrame:
    """``(url, class_id, copies, links)``: one row a page with its group, equal pages and links to other sets.

    ``class_id`` identifies the connected group of near-duplicate sets (a hash, of the page's own set if
    it has no near one); ``copies`` counts pages with an equal set, itself included; ``links`` counts
    other sets at the threshold or above. No link between different texts is left out.
    """
    members, pairs = near_pages(cache, threshold)
    pairs = cut_lineage(pairs)
    parts = connected_components(pairs.select("a", "b"))
    degree = (
        pairs.select(F.col("a").alias("sid")).unionByName(pairs.select(F.col("b").alias("sid")))
        .groupBy("sid").agg(F.count("*").alias("links"))
    )
    copies = members.groupBy("sid").agg(F.count("*").alias("copies"))
    facts = copies.join(degree, "sid", "left").join(parts.withColumnRenamed("node", "sid"), "sid", "left")
    return join_per_key(members, facts, "sid").select(
        "url", F.coalesce("component", "sid").alias("class_id"), "copies", F.coalesce("links", F.lit(0).cast("long")).alias("links")
    )
