"""Records that are identical but for formatting, collapsed with Bloom filters before any exact grouping.

Every partition builds two Bloom filters over canonical hashes: seen once and seen repeatedly. Filters
merge pairwise as

    repeated = repeated_1 | repeated_2 | (once_1 & once_2)        once = once_1 | once_2

which keeps every hash that occurs in two partitions (its bits are set in both), so no repeat is ever
missed. Only records that the merged filter calls possible repeats are shuffled and grouped exactly;
all others are singletons. The filter is cut into slices of fixed size, merged slice by slice in a tree
of bounded fan-in.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditloom.runtime import cut_lineage

#: Bits a record in the filter, hash functions, and the largest filter that is broadcast. More records take
#: several filters, one for each range of hashes, and a pass over the 16-byte hashes for each.
BITS_PER_RECORD, HASHES, MAX_FILTER_BYTES = 16, 3, 64 << 20
SLICE_BYTES, FAN_IN = 1 << 20, 16
#: A group of copies above this share of all records is joined by broadcast; at most 1 / share exist.
HEAVY_SHARE = 0.001

_DROP = r"[\p{Z}\p{C}\p{P}\p{S}\s]+"


def canonical_address(c: Column) -> Column:
    """An address without white space, invisible characters, punctuation, letter case and parameter order.

    Null stays null. Parameters are what stands after the first ``?``, split at ``&``.
    """
    bare = lambda x: F.regexp_replace(F.lower(x), _DROP, "")
    base = F.substring_index(c, "?", 1)
    mark = F.instr(c, "?")
    rest = F.when(mark > 0, F.substr(c, mark + F.lit(1)))
    params = F.array_sort(F.transform(F.split(F.coalesce(rest, F.lit("")), "&"), bare))
    return F.concat(bare(base), F.array_join(params, ""))


def _positions(h1: np.ndarray, h2: np.ndarray, bits: int) -> np.ndarray:
    k = np.arange(HASHES, dtype=np.uint64)[:, None]
    with np.errstate(over="ignore"):
        return (h1.view(np.uint64)[None, :] + k * (h2.view(np.uint64) | np.uint64(1))[None, :]) & np.uint64(bits - 1)


def _test(filt: np.ndarray, pos: np.ndarray) -> np.ndarray:
    return ((filt[pos >> np.uint64(3)] >> (pos & np.uint64(7)).astype(np.uint8)) & 1).astype(bool).all(axis=0)


def _set(filt: np.ndarray, pos: np.ndarray) -> None:
    p = pos.ravel()
    np.bitwise_or.at(filt, p >> np.uint64(3), np.left_shift(np.uint8(1), (p & np.uint64(7)).astype(np.uint8)))


def _merge(pairs: list[tuple[bytes, bytes]]) -> tuple[np.ndarray, np.ndarray]:
    once = rep = None
    for a, b in pairs:
        o, r = (np.frombuffer(zlib.decompress(x), np.uint8) for x in (a, b))
        if once is None:
            once, rep = o.copy(), r.copy()
        else:
            rep |= r | (once & o)
            once |= o
    return once, rep


_SLICES = "slice int, node int, once binary, rep binary"


def repeat_filter(hashes: DataFrame, records: int, max_bytes: int = MAX_FILTER_BYTES) -> tuple[np.ndarray, int]:
    """The merged filter of hashes seen repeatedly, of at most ``max_bytes``, and its number of bits.

    ``hashes`` has two BIGINT columns ``h1`` and ``h2`` without nulls.
    """
    bits = 1 << max(13, int(np.ceil(np.log2(max(1, records) * BITS_PER_RECORD))))
    bits = min(bits, 1 << (int(max_bytes) * 8).bit_length() - 1)
    size = min(bits // 8, SLICE_BYTES)
    slices = bits // 8 // size

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        once, rep = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)
        seen = False
        for batch in batches:
            if not batch.num_rows:
                continue
            seen = True
            both = np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()], axis=1)
            unique, counts = np.unique(both, axis=0, return_counts=True)
            pos = _positions(np.ascontiguousarray(unique[:, 0]), np.ascontiguousarray(unique[:, 1]), bits)
            again = _test(once, pos) | (counts > 1)
            _set(rep, pos[:, again])
            _set(once, pos)
        if not seen:
            return
        node = TaskContext.get().partitionId()
        for s in range(slices):
            o, r = once[s * size : (s + 1) * size], rep[s * size : (s + 1) * size]
            if o.any():
                yield pa.RecordBatch.from_pydict(
                    {"slice": pa.array([s], pa.int32()), "node": pa.array([node], pa.int32()),
                     "once": [zlib.compress(o, 1)], "rep": [zlib.compress(r, 1)]}
                )

    def join_slices(t: pa.Table) -> pa.Table:
        once, rep = _merge(list(zip(t["once"].to_pylist(), t["rep"].to_pylist(), strict=True)))
        return pa.table(
            {"slice": pa.array([t["slice"][0].as_py()], pa.int32()),
             "node": pa.array([t["node"][0].as_py() // FAN_IN], pa.int32()),
             "once": [zlib.compress(once, 1)], "rep": [zlib.compress(rep, 1)]}
        )

    nodes = hashes.rdd.getNumPartitions()
    level = hashes.mapInArrow(build, _SLICES)
    while nodes > 1:
        level = level.groupBy("slice", F.expr(f"node div {FAN_IN}").alias("g")).applyInArrow(
            lambda key, t: join_slices(t), _SLICES
        )
        nodes = -(-nodes // FAN_IN)
    out = np.zeros(bits // 8, np.uint8)
    for row in level.select("slice", "rep").toLocalIterator():
        out[row.slice * size : (row.slice + 1) * size] = np.frombuffer(zlib.decompress(row.rep), np.uint8)
    return out, bits


def possible_repeats(df: DataFrame, records: int, max_bytes: int = MAX_FILTER_BYTES) -> DataFrame:
    """``df`` (with BIGINT columns ``h1``, ``h2``) and a BOOLEAN ``possible``: false only for sure singletons."""
    filt, bits = repeat_filter(df.select("h1", "h2"), records, max_bytes)
    shared = df.sparkSession.sparkContext.broadcast(filt.tobytes())
    schema = T.StructType([*df.schema.fields, T.StructField("possible", T.BooleanType())])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = np.frombuffer(shared.value, np.uint8)
        for batch in batches:
            h1, h2 = (batch.column(batch.schema.get_field_index(x)).to_numpy() for x in ("h1", "h2"))
            yield batch.append_column("possible", pa.array(_test(f, _positions(h1, h2, bits)), pa.bool_()))

    return df.mapInArrow(probe, schema)


def collapse_copies(
    df: DataFrame, id_column: str, scope: str, columns: list[str], max_bytes: int = MAX_FILTER_BYTES
) -> DataFrame:
    """``(id, first_id, copies)``: each record, the smallest id among its copies and their number.

    Two records of one ``scope`` are copies if each of ``columns`` is equal in both under
    ``canonical_address``; null equals only null. Rows sharing an id are one record; rows without id
    or scope are dropped. If such rows differ, the id belongs to the group of each spelling. An empty
    table gives no rows; other columns, whatever their names, are ignored. Singletons come out with
    one copy and are never shuffled.
    """
    keyed = df.select(
        F.col(id_column).alias("id"), F.col(scope).alias("scope"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(columns)]
    ).where("id is not null and scope is not null")
    canon = [canonical_address(F.col(f"c{i}")) for i in range(len(columns))]
    parts = [x for c in canon for x in (c.isNull(), c)]
    hashed = keyed.select(
        "id", "scope", F.xxhash64(F.lit(11), "scope", *parts).alias("h1"), F.xxhash64(F.lit(12), *parts, F.lit(13)).alias("h2")
    )
    hashed = cut_lineage(hashed)
    records = hashed.count()
    # One filter for each range of hashes, so that none outgrows its bound whatever the number of records.
    ranges = max(1, -(-records * BITS_PER_RECORD // (8 * max_bytes)))
    each = [possible_repeats(hashed.where(F.pmod(F.shiftrightunsigned("h1", 32), F.lit(ranges)) == r), -(-records // ranges), max_bytes) for r in range(ranges)]
    probed = cut_lineage(reduce(DataFrame.unionByName, each))
    single = probed.where("not possible").select("id", F.col("id").alias("first_id"), F.lit(1).cast("long").alias("copies"))
    # Exact grouping of the possible repeats; first by id too, so that a hot group is spread over all tasks.
    distinct = probed.where("possible").select("scope", "h1", "h2", "id").distinct()
    groups = distinct.groupBy("scope", "h1", "h2").agg(F.min("id").alias("first_id"), F.count("*").alias("copies"))
    groups = cut_lineage(groups)
    heavy = F.col("copies") > max(10_000, int(records * HEAVY_SHARE))
    keys = ["scope", "h1", "h2"]
    hot = F.broadcast(groups.where(heavy))  # at most 1 / HEAVY_SHARE rows
    rest = groups.where(~heavy)
    cold_records = distinct.join(hot.select(*keys), keys, "left_anti")
    out = distinct.join(hot, keys).select("id", "first_id", "copies").unionByName(
        cold_records.join(rest, keys).select("id", "first_id", "copies")
    )
    return single.unionByName(out)
