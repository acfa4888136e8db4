"""Groups of records linked directly or indirectly, from any number of pairs.

Union-find runs inside each partition of the pairs and keeps only a spanning forest (a star a component).
Forests are merged level by level into fewer partitions, each holding no more than a fixed number of
pairs. Should even one forest of everything exceed that bound, alternating star contractions finish the
job without ever holding more than a partition of it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.runtime import cut_lineage, join_per_key

#: Pairs that one merging task may hold (about 100 bytes each while it works).
MAX_TASK_EDGES = 4_000_000
FAN_IN = 8
#: Salts that are tried until no two addresses share a hash.
SALTS = 8

_EDGES = "a long, b long"


def union_find(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning star for each component: every node but the smallest, and the smallest of its component."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    parent = list(range(len(nodes)))
    left, right = flat[: len(a)].tolist(), flat[len(a) :].tolist()
    for x, y in zip(left, right, strict=True):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        while parent[y] != y:
            parent[y] = parent[parent[y]]
            y = parent[y]
        if x < y:
            parent[y] = x
        elif y < x:
            parent[x] = y
    root = np.asarray(parent, np.int64)
    while True:  # positions follow the node values, so the root of each tree is its smallest node
        up = root[root]
        if np.array_equal(up, root):
            break
        root = up
    child = root != np.arange(len(root))
    return nodes[child], nodes[root[child]]


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    a, b, held, limit = [], [], 0, MAX_TASK_EDGES
    for batch in batches:
        a.append(batch.column(0).to_numpy())
        b.append(batch.column(1).to_numpy())
        held += batch.num_rows
        if held > limit:  # shrink to the forest so far; the next time at twice its size, so the work stays linear
            x, y = union_find(np.concatenate(a), np.concatenate(b))
            a, b, held = [x], [y], len(x)
            limit = max(MAX_TASK_EDGES, 2 * held)
    if held:
        x, y = union_find(np.concatenate(a), np.concatenate(b))
        step = 500_000
        for i in range(0, len(x), step):
            yield pa.RecordBatch.from_arrays([pa.array(x[i : i + step]), pa.array(y[i : i + step])], ["a", "b"])


def _contract(edges: DataFrame) -> DataFrame:
    """Alternating large-star and small-star steps until every node points to the smallest of its component."""
    def star(pairs: DataFrame, large: bool) -> DataFrame:
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else pairs
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        joined = join_per_key(both, least, "a")  # a hub may hold a third of all pairs
        if large:
            moved = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:  # a > b holds for all pairs
            moved = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
                least.select("a", F.col("m").alias("b"))
            )
        return moved.where("a <> b").distinct()

    now = cut_lineage(edges.distinct())
    while True:
        after = cut_lineage(star(cut_lineage(star(now, True)), False))
        if not after.exceptAll(now).limit(1).count() and not now.exceptAll(after).limit(1).count():
            return after
        now = after


def connected_components(edges: DataFrame, max_task_edges: int = MAX_TASK_EDGES) -> DataFrame:
    """``(node, component)`` for every node of ``edges`` (two BIGINT columns): the smallest node it connects to.

    Self loops make their node a component; repeated pairs and both directions are welcome; rows with a
    null end are ignored. No pairs give no rows.
    """
    pairs = edges.toDF("a", "b").where("a is not null and b is not null")
    loops = pairs.where("a = b").select(F.col("a").alias("node")).distinct()
    forest = cut_lineage(pairs.where("a <> b").mapInArrow(_forest, _EDGES))
    parts = max(1, forest.rdd.getNumPartitions())
    held = forest.count()
    while parts > 1:
        fewer = max(-(-parts // FAN_IN), -(-held // max_task_edges), 1)
        if fewer >= parts:
            break
        forest = cut_lineage(forest.repartition(fewer).mapInArrow(_forest, _EDGES))  # evenly, whatever the forests' sizes
        parts, held = fewer, forest.count()
    if parts > 1:
        forest = _contract(forest)
    ends = forest.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = forest.select(F.col("b").alias("node")).unionByName(loops.join(ends, "node", "left_anti")).distinct()
    return ends.unionByName(roots.select("node", F.col("node").alias("component")))


def address_groups(
    df: DataFrame, id_column: str, scope: str, address: str, links: list[str], max_task_edges: int = MAX_TASK_EDGES
) -> DataFrame:
    """``(group_id, id, members)`` for each record in a group of two or more.

    Within one ``scope`` a record's ``address`` is linked to the non-null addresses in ``links`` (exact
    strings); an address that is no record still connects those that name it. ``group_id`` is the
    smallest id of the group. Rows sharing an id are one record and all their links count; rows without
    id, scope or address are ignored, as are further columns. A record without links that shares its
    address with a linked one belongs to that one's group. No rows or links give no rows. Addresses are
    numbered by a 64-bit hash of scope and address; a second one proves that no two of them share a number,
    and another salt is drawn should they.
    """
    rows = df.select(
        F.col(id_column).alias("id"), F.col(scope).alias("scope"), F.col(address).alias("address"),
        *[F.col(c).alias(f"l{i}") for i, c in enumerate(links)],
    ).where("id is not null and scope is not null and address is not null")
    ends = lambda h: [h("address"), *[F.when(F.col(f"l{i}").isNotNull(), h(f"l{i}")) for i in range(len(links))]]
    for salt in range(SALTS):
        node = lambda c: F.xxhash64(F.lit(salt), "scope", c)  # noqa: E731, B023
        both = rows.select(F.explode(F.arrays_zip(F.array(*ends(node)).alias("a"), F.array(*ends(lambda c: F.xxhash64(F.lit(-1), c, "scope"))).alias("b"))).alias("x"))
        clash = both.where("x.a is not null").groupBy("x.a").agg(F.min("x.b").alias("p"), F.max("x.b").alias("q")).where("p <> q")
        if not clash.limit(1).count():
            break
    edges = rows.select(node("address").alias("a"), F.explode(F.array(*ends(node)[1:])).alias("b")).where("b is not null")
    parts = cut_lineage(connected_components(edges, max_task_edges))
    records = rows.select("id", node("address").alias("node")).distinct()
    members = cut_lineage(records.join(parts, "node").select("component", "id").distinct())
    groups = (
        members.groupBy("component").agg(F.min("id").alias("group_id"), F.count("*").alias("members")).where("members > 1")
    )
    groups = cut_lineage(groups)
    return join_per_key(members, groups, "component").select("group_id", "id", "members")
