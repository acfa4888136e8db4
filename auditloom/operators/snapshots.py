"""What changed between full snapshots of a table.

Both snapshots are reduced to one row a key with a hash of the canonical values, and one full outer
join on the key compares the hashes: a missing side is an addition or a removal, unequal hashes are
a change.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.runtime import broadcast_if_small, cut_lineage


def row_hash(values: Sequence[str]) -> Column:
    """128 bits over the values in the given order; null, empty text and position are told apart."""
    parts: list[Column] = []
    for name in values:
        parts += [F.col(name).isNull(), F.col(name)]
    return F.struct(
        F.xxhash64(F.lit(1), *parts).alias("a"), F.xxhash64(F.lit(2), *parts, F.lit(3)).alias("b")
    )


def latest_versions(df: DataFrame, keys: Sequence[str], order: str, values: Sequence[str]) -> DataFrame:
    """One row a key: the values of the row with the highest ``order`` (null lowest; ties by the values).

    A partial maximum runs before the shuffle, so a key repeated in any number of rows stays cheap.
    """
    best = F.max(F.struct(F.col(order).isNotNull().alias("_k"), F.col(order).alias("_o"), *values)).alias("_best")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col(f"_best.{v}").alias(v) for v in values])


def snapshot_changes(new: DataFrame, old: DataFrame, keys: Sequence[str], values: Sequence[str] = ()) -> DataFrame:
    """Rows ``keys + change_kind`` for every key added, removed or changed from ``old`` to ``new``.

    Both inputs hold one row a key. Keys match exactly and null-safely (a null key part equals only
    null); values differ unless equal or both null. No row comes out for an unchanged key. Empty
    inputs give all additions or all removals; further columns of either side are ignored.
    """
    def side(df: DataFrame, tag: str) -> DataFrame:
        return df.select(
            *[F.col(k).alias(f"{tag}{i}") for i, k in enumerate(keys)],
            (row_hash(values) if values else F.struct(F.lit(0).alias("a"), F.lit(0).alias("b"))).alias(f"{tag}h"),
        )

    n, o = side(new, "_n"), side(old, "_o")
    on = F.lit(True)
    for i in range(len(keys)):
        on = on & F.col(f"_n{i}").eqNullSafe(F.col(f"_o{i}"))
    kind = (
        F.when(F.col("_oh").isNull(), "added")
        .when(F.col("_nh").isNull(), "removed")
        .when(F.col("_nh") != F.col("_oh"), "changed")
    )
    return (
        n.join(o, on, "full_outer")
        .withColumn("change_kind", kind)
        .where("change_kind is not null")
        .select(*[F.coalesce(F.col(f"_n{i}"), F.col(f"_o{i}")).alias(k) for i, k in enumerate(keys)], "change_kind")
    )


def consecutive_audits(audits: DataFrame) -> DataFrame:
    """``(audit_id, previous_id)`` for each completed audit that has one before it in its project.

    Order is (``finished_at``, ``id``), null times first; rows delivered twice count once.
    """
    from pyspark.sql import Window

    once = (
        audits.where((F.col("status") == "completed") & F.col("id").isNotNull())
        .groupBy("id").agg(F.max(F.struct("finished_at", "project_id")).alias("x"))
        .select("id", "x.finished_at", "x.project_id")
    )
    order = Window.partitionBy("project_id").orderBy(F.col("finished_at").asc_nulls_first(), "id")
    return (
        once.select(F.col("id").alias("audit_id"), F.lag("id").over(order).alias("previous_id"))
        .where("previous_id is not null")
    )


def audit_changes(audits: DataFrame, pages: DataFrame, issues: DataFrame) -> DataFrame:
    """``(audit_id, record_kind, url, code, change_kind)`` between consecutive completed audits.

    Of several page rows with one (``audit_id``, ``url``) the highest ``id`` counts; issues are
    compared as distinct (``url``, ``code``). A snapshot without rows is an empty one. Null urls and
    codes are values like others; rows without an audit belong to no snapshot.
    """
    pairs = cut_lineage(consecutive_audits(audits))
    # One audit may hold a third of the rows: where the list of audits is proven small, no row is moved to meet it.
    later = broadcast_if_small(pairs.select("audit_id", F.col("audit_id").alias("at")))
    earlier = broadcast_if_small(pairs.select(F.col("previous_id").alias("audit_id"), F.col("audit_id").alias("at")))
    used = broadcast_if_small(pairs.select(F.explode(F.array("audit_id", "previous_id")).alias("audit_id")).distinct())
    # Each table is made distinct once; both roles of an audit are attached to the result of that one exchange.
    once = latest_versions(pages.select("audit_id", "url", "id", "title", "status").join(used, "audit_id", "left_semi"), ["audit_id", "url"], "id", ["title", "status"])
    bag = issues.select("audit_id", "url", "code").join(used, "audit_id", "left_semi").distinct()
    page_side = lambda which: once.join(which, "audit_id").drop("audit_id")
    issue_side = lambda which: bag.join(which, "audit_id").drop("audit_id")

    page_rows = snapshot_changes(page_side(later), page_side(earlier), ["at", "url"], ["title", "status"])
    issue_rows = snapshot_changes(issue_side(later), issue_side(earlier), ["at", "url", "code"])
    columns = lambda kind, code: [
        F.col("at").alias("audit_id"), F.lit(kind).alias("record_kind"), "url", code.alias("code"), "change_kind"
    ]
    return page_rows.select(*columns("page", F.lit(""))).unionByName(
        issue_rows.select(*columns("issue", F.col("code")))
    )
