"""Near-duplicate texts: exact set-similarity join by size and prefix filters, and MinHash with banding."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.functions.texts import shingles
from auditloom.runtime import cut_lineage, spread

# Length of a signature, bands, words of a run.
LENGTH, BANDS, RUN = 128, 16, 5
#: How far below the threshold an estimate may lie for a pair to be verified on its sets.
MARGIN = 0.15


def _run_hashes(text: Column, size: int = RUN) -> Column:
    return F.array_sort(F.transform(shingles(text, size), lambda s: F.xxhash64(s)))


def least_hashes(runs: np.ndarray, seed: int) -> np.ndarray:
    """For each of ``LENGTH`` orders of the hashed runs, the upper half of the least value."""
    with np.errstate(over="ignore"):
        keys = (np.arange(1, LENGTH + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ np.uint64(seed)
        least = np.full(LENGTH, 0xFFFFFFFF, np.uint64)
        for i in range(0, len(runs), 2048):
            x = runs[i : i + 2048, None] ^ keys
            x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            least = np.minimum(least, (x >> np.uint64(32)).min(axis=0))
    return least.astype("<u4")


def signatures(df: DataFrame, key: str, text: str, seed: int = 1) -> DataFrame:
    """``(key, minhash)``: 32-bit little-endian values; null for texts without words. Signatures of one seed can be compared."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = (np.asarray(x.values.to_numpy()).view(np.uint64) if x.is_valid and len(x) else None for x in batch.column(1))
            out = [None if s is None else least_hashes(s, seed).tobytes() for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["key", "minhash"])

    rows = spread(df.select(F.col(key).alias("key"), text)).select("key", _run_hashes(F.col(text)).alias("runs"))
    return rows.mapInArrow(run, f"key {kind}, minhash binary").withColumnRenamed("key", key)


def _words(sig: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(LENGTH - 1)), lambda i: F.substr(F.hex(sig), i * 8 + 1, F.lit(8)))


def estimated_jaccard(a: Column, b: Column) -> Column:
    """Share of equal positions of two signatures."""
    same = F.zip_with(_words(a), _words(b), lambda x, y: (x == y).cast("int"))
    return F.aggregate(same, F.lit(0), lambda s, x: s + x) / LENGTH


def lsh_pairs(sigs: DataFrame, key: str, threshold: float = 0.85) -> DataFrame:
    """``(a, b, similarity)`` of texts that share a band and agree in at least ``threshold`` of the positions.

    Equal signatures are collapsed before the bands are joined and expanded after; signatures of another
    length are ignored.
    """
    width = LENGTH // BANDS * 4
    good = sigs.where(F.octet_length("minhash") == LENGTH * 4).select(F.col(key).alias("k"), "minhash").distinct()
    groups = cut_lineage(good.groupBy("minhash").agg(F.min("k").alias("rep")))
    bands = groups.select("rep", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(F.substr("minhash", i * width + 1, F.lit(width))))).alias("band", "h"))
    cand = bands.select(F.col("rep").alias("a"), "band", "h").join(bands.select(F.col("rep").alias("b"), "band", "h"), ["band", "h"]).where("a < b").select("a", "b").distinct()
    near = (
        cand.join(groups.select(F.col("rep").alias("a"), F.col("minhash").alias("ma")), "a").join(groups.select(F.col("rep").alias("b"), F.col("minhash").alias("mb")), "b")
        .select("a", "b", estimated_jaccard(F.col("ma"), F.col("mb")).alias("similarity")).where(F.col("similarity") >= threshold)
    )
    return _expand(good.join(groups, "minhash").select("k", "rep"), near)


def exact_pairs(df: DataFrame, key: str, text: str, threshold: float = 0.85, size: int = RUN) -> DataFrame:
    """``(a, b, similarity)`` of texts whose word-run sets have a Jaccard similarity of at least ``threshold``.

    Equal sets are collapsed. Of the runs of a set, rarest first, only the first n - ceil(t n) + 1 are joined:
    similar sets share one of them; sizes must fit. Candidates are verified on the whole sets.
    """
    runs = _run_hashes(F.col(text), size)
    sets = df.where(F.col(text).isNotNull()).select(F.col(key).alias("k"), runs.alias("runs")).where(F.size("runs") > 0)
    sets = cut_lineage(sets.withColumn("sid", F.xxhash64("runs")))
    reps = cut_lineage(sets.groupBy("sid").agg(F.min("k").alias("rep")).join(sets.select(F.col("k").alias("rep"), "runs"), "rep").select("rep", "runs", F.size("runs").alias("n")))
    each = reps.select("rep", "n", F.explode("runs").alias("h"))
    common = each.groupBy("h").agg(F.count("*").alias("df")).where("df > 1")  # a run of one set finds nothing, but takes its place
    ordered = each.join(common, "h", "left").groupBy("rep", "n").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(1).cast("long")).alias("df"), "h"))).alias("x"))
    first = F.slice("x", F.lit(1), (F.col("n") - F.ceil(F.col("n") * F.lit(threshold) - 1e-9) + 1).cast("int"))
    prefix = cut_lineage(ordered.select("rep", "n", F.explode(F.filter(first, lambda e: e["df"] > 1)).alias("e")).select("rep", "n", F.col("e.h").alias("h")))
    fits = F.least("na", "nb") >= F.greatest("na", "nb") * F.lit(threshold - 1e-9)
    cand = (
        prefix.select(F.col("rep").alias("a"), F.col("n").alias("na"), "h").join(prefix.select(F.col("rep").alias("b"), F.col("n").alias("nb"), "h"), "h")
        .where((F.col("a") < F.col("b")) & fits).select("a", "b").distinct()
    )
    both = F.size(F.array_intersect("ra", "rb"))
    near = (
        cand.join(reps.select(F.col("rep").alias("a"), F.col("runs").alias("ra")), "a").join(reps.select(F.col("rep").alias("b"), F.col("runs").alias("rb")), "b")
        .select("a", "b", (both / (F.size("ra") + F.size("rb") - both)).alias("similarity")).where(F.col("similarity") >= threshold - 1e-12)
    )
    return _expand(sets.join(reps.select("rep"), sets["k"] == reps["rep"]).select("sid", "rep").join(sets.select("k", "sid"), "sid").select("k", "rep"), near)


def _expand(members: DataFrame, near: DataFrame) -> DataFrame:
    a, b = members.select(F.col("k").alias("ka"), F.col("rep").alias("a")), members.select(F.col("k").alias("kb"), F.col("rep").alias("b"))
    across = near.join(a, "a").join(b, "b").select(F.least("ka", "kb").alias("a"), F.greatest("ka", "kb").alias("b"), "similarity")
    crowd = members.groupBy("rep").count().where("count > 1").select("rep")
    shared = members.join(crowd, "rep", "left_semi")
    equal = shared.select(F.col("k").alias("a"), "rep").join(shared.select(F.col("k").alias("b"), "rep"), "rep").where("a < b").select("a", "b", F.lit(1.0).alias("similarity"))
    return across.unionByName(equal).withColumn("similarity", F.round("similarity", 3))


def minhash_pairs(df: DataFrame, key: str, text: str, threshold: float = 0.85) -> DataFrame:
    """The pairs of ``exact_pairs`` as far as bands find them: estimates within ``MARGIN`` are verified on the sets."""
    some = cut_lineage(lsh_pairs(signatures(df, key, text), key, threshold - MARGIN).select("a", "b"))
    used = some.select(F.explode(F.array("a", "b")).alias("k")).distinct()
    sets = cut_lineage(df.select(F.col(key).alias("k"), _run_hashes(F.col(text)).alias("runs")).join(used, "k", "left_semi"))
    both = F.size(F.array_intersect("ra", "rb"))
    return (
        some.join(sets.select(F.col("k").alias("a"), F.col("runs").alias("ra")), "a").join(sets.select(F.col("k").alias("b"), F.col("runs").alias("rb")), "b")
        .select("a", "b", (both / (F.size("ra") + F.size("rb") - both)).alias("similarity")).where(F.col("similarity") >= threshold - 1e-12).withColumn("similarity", F.round("similarity", 3))
    )


def near_duplicates(df: DataFrame, key: str, text: str, threshold: float = 0.85, way: str = "exact") -> DataFrame:
    """Pairs by the way asked for, whatever the size: ``exact``, or ``minhash``, which may miss some."""
    return {"exact": exact_pairs, "minhash": minhash_pairs}[way](df, key, text, threshold)
