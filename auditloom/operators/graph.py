"""The link graph: degrees, orphans, dead ends, hubs, levels, importance, clusters.

Edges are rows (src, dst); nodes are rows (node). Loops on the driver only watch counters; each step's
rows are written to the checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditloom.runtime import broadcast_if_small, cut_lineage, discard, join_per_key, stored

HUB_LINKS = 150
#: Steps after which convergence is looked at.
CHECKED = 4


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(node, links_out, links_in)`` over distinct edges."""
    e = edges.select("src", "dst").distinct()
    out = e.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("o"))
    into = e.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("i"))
    zero = lambda c, n: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(n)
    return nodes.join(out, "node", "left").join(into, "node", "left").select("node", zero("o", "links_out"), zero("i", "links_in"))


def orphans(nodes: DataFrame, edges: DataFrame, start=None) -> DataFrame:
    """Nodes without a link from another recorded page, the start page excepted."""
    lonely = nodes.join(edges.select(F.col("dst").alias("node")), "node", "left_anti")
    return lonely.where(F.col("node") != F.lit(start)) if start is not None else lonely


def dead_ends(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes without any link out."""
    return nodes.join(edges.select(F.col("src").alias("node")), "node", "left_anti")


def hubs(edges: DataFrame, more_than: int = HUB_LINKS, top: int = 20) -> DataFrame:
    """The ``top`` nodes with more than so many distinct links out; ties by node."""
    n = edges.select("src", "dst").distinct().groupBy(F.col("src").alias("node")).agg(F.count("*").alias("links"))
    return n.where(F.col("links") > more_than).orderBy(F.desc("links"), "node").limit(top)


def bfs_depths(edges: DataFrame, start, max_depth: int = 50) -> DataFrame:
    """``(node, depth)`` of all nodes within ``max_depth`` links of the start node, level by level."""
    e = edges.select("src", "dst").distinct().repartition("src")
    e = cut_lineage(e)
    spark = edges.sparkSession
    kind = edges.schema["src"].dataType.simpleString()
    frontier = spark.range(1).select(F.lit(start).cast(kind).alias("node"))
    seen = cut_lineage(frontier.withColumn("depth", F.lit(0)))
    for depth in range(1, max_depth + 1):
        last = seen.where(F.col("depth") == depth - 1).select(F.col("node").alias("src"))
        found = e.join(broadcast_if_small(last), "src").select(F.col("dst").alias("node")).distinct().join(seen.select("node"), "node", "left_anti")
        found = cut_lineage(found.withColumn("depth", F.lit(depth)))
        if not found.limit(1).count():
            break
        seen = cut_lineage(seen.unionByName(found)) if depth % 8 == 0 else seen.unionByName(found)
    return seen


def page_rank(nodes: DataFrame, edges: DataFrame, alpha: float = 0.85, iterations: int = 100, tolerance: float | None = 1e-6) -> DataFrame:
    """``(node, score)``: importance over distinct edges between known nodes; scores sum to 1.

    The mass of nodes without links out is spread evenly. It ends after ``iterations`` or when all scores
    together move less than ``tolerance`` a node, looked at every ``CHECKED`` steps (None: never). Self links count.
    """
    nodes = cut_lineage(nodes.select("node").distinct())
    n = nodes.count()
    if not n:
        return nodes.withColumn("score", F.lit(0.0))
    known = edges.select("src", "dst").distinct().join(nodes.select(F.col("node").alias("src")), "src", "left_semi").join(nodes.select(F.col("node").alias("dst")), "dst", "left_semi")
    fan = known.groupBy("src").agg(F.count("*").alias("fan"))
    weighted = cut_lineage(known.join(fan, "src").select("src", "dst", (F.lit(1.0) / F.col("fan")).alias("w")).repartition("src"))
    rank, step = nodes.withColumn("score", F.lit(1.0 / n)), None
    for i in range(1, iterations + 1):
        before = step
        given = weighted.join(rank.select(F.col("node").alias("src"), "score"), "src").groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("score") * F.col("w")).alias("got"))
        step = stored(rank.withColumnRenamed("score", "old").join(given, "node", "left").select("node", "old", F.coalesce("got", F.lit(0.0)).alias("got")))
        if before is not None:
            discard(before)  # nothing reads the step before last
        # All scores sum to 1, so what no link gave on is what nodes without links out hold: one sum tells it.
        even = (1 - alpha * step.agg(F.sum("got")).first()[0]) / n
        after = step.select("node", "old", (F.lit(even) + F.lit(alpha) * F.col("got")).alias("score"))
        rank = after.select("node", "score")
        if tolerance is not None and i % CHECKED == 0 and after.agg(F.sum(F.abs(F.col("score") - F.col("old")))).first()[0] < n * tolerance:
            break
    return rank


def linked_groups(pairs: DataFrame) -> DataFrame:
    """``(node, group)``: the smallest node each is connected to, by alternating minimum labels over pairs (a, b)."""
    e = pairs.toDF("a", "b").where("a is not null and b is not null")
    e = cut_lineage(e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    label = cut_lineage(e.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("group")))
    while True:
        near = join_per_key(e, label.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("group").alias("near"))
        step = label.join(near, "node").select("node", F.least("group", "near").alias("group"), F.col("group").alias("was"))
        # Shortcut: the group of one's group.
        step = step.join(step.select(F.col("node").alias("g"), F.col("group").alias("gg")), F.col("group") == F.col("g"), "left").select(
            "node", F.least("group", "gg").alias("group"), "was"
        )
        step = cut_lineage(step)
        label = step.select("node", "group")
        if not step.where("group <> was").limit(1).count():
            return label


def similar_sets(items: DataFrame, least: int = 3) -> DataFrame:
    """Pairs ``(a, b)``, a < b, of groups that share at least ``least`` members; ``items`` has (group, member).

    Joins on the member; meant for lists of bounded length, as the top results of keywords are.
    """
    x = items.toDF("g", "m").distinct()
    return (
        x.select(F.col("g").alias("a"), "m").join(x.select(F.col("g").alias("b"), "m"), "m").where("a < b")
        .groupBy("a", "b").agg(F.count("*").alias("shared")).where(F.col("shared") >= least).select("a", "b")
    )


def clusters(pages: DataFrame, segment: Column, scope: str, most: int = 60) -> DataFrame:
    """``(scope, cluster, pages)``: pages by segment, those beyond the ``most`` largest together as ``other``."""
    counts = pages.groupBy(scope, segment.alias("segment")).agg(F.count("*").alias("pages"))
    rank = F.row_number().over(Window.partitionBy(scope).orderBy(F.desc("pages"), "segment"))
    named = counts.withColumn("cluster", F.when(rank <= most, F.col("segment")).otherwise("other"))
    return named.groupBy(scope, "cluster").agg(F.sum("pages").alias("pages"))


def cluster_edges(edges: DataFrame, segment) -> DataFrame:
    """``(src, dst, links)`` between different segments; ``segment`` maps a column to its segment."""
    return (
        edges.select(segment(F.col("src")).alias("src"), segment(F.col("dst")).alias("dst")).where("src <> dst")
        .groupBy("src", "dst").agg(F.count("*").alias("links"))
    )


def expand_cluster(pages: DataFrame, edges: DataFrame, segment: Column, name: str) -> tuple[DataFrame, DataFrame]:
    """Members (url) of a cluster and the edges within it."""
    members = pages.where(segment == name).select("url").distinct()
    inner = edges.join(members.select(F.col("url").alias("src")), "src", "left_semi").join(members.select(F.col("url").alias("dst")), "dst", "left_semi")
    return members, inner


def architecture_flags(pages: DataFrame, edges: DataFrame, hub_links: int = HUB_LINKS, deep: int = 3) -> DataFrame:
    """Per page (url, status, depth): links in and out and whether it is broken, an orphan, a dead end, deep or a hub."""
    d = degrees(pages.select(F.col("url").alias("node")).distinct(), edges).withColumnRenamed("node", "url")
    return pages.join(d, "url").select(
        "url", "depth", "links_in", "links_out", F.coalesce(F.col("status") >= 400, F.lit(True)).alias("broken"), ((F.col("links_in") == 0) & (F.col("depth") > 0)).alias("orphan"),
        (F.col("links_out") == 0).alias("dead_end"), (F.col("depth") >= deep).alias("deep"), (F.col("links_out") > hub_links).alias("hub"),
    )
