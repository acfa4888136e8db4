"""Groups of pages with equal fields, aliases folded in, and redirect reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def duplicate_groups(pages: DataFrame, scope: str, fields: list[str], url: str = "url") -> DataFrame:
    """``(scope, field, value, url, pages)``: every page whose non-empty field equals another page's.

    One row a member, so that a value shared by any number of pages is never gathered into one row.
    """
    long = pages.select(scope, F.col(url).alias("url"), F.explode(F.array(*[
        F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields
    ])).alias("x")).select(scope, "x.field", "x.value", "url").where("value is not null and value <> ''").distinct()
    shared = long.groupBy(scope, "field", "value").agg(F.count("*").alias("pages")).where("pages > 1")
    return long.join(shared, [scope, "field", "value"]).select(scope, "field", "value", "url", "pages")


def fold_duplicates(hashes: DataFrame, duplicate_of: DataFrame) -> DataFrame:
    """``(url, content_hash)`` with skipped pages joined to their owner's hash; owners without a hash add nothing.

    ``hashes``: url, content_hash of analysed pages; ``duplicate_of``: url, owner.
    """
    extra = duplicate_of.join(hashes.withColumnRenamed("url", "owner"), "owner").select("url", "content_hash")
    return hashes.select("url", "content_hash").unionByName(extra).distinct()


def redirect_report(pages: DataFrame) -> DataFrame:
    """``(url, hops, is_chain, is_loop, temporary, permanent)`` of pages with redirects; aliases included.

    ``redirect_chain`` is an array of structs with from, to and status. A chain has more than one hop; a
    loop comes back to an address it left.
    """
    hops: Column = F.col("redirect_chain")
    froms = F.transform(hops, lambda h: h["from"])
    n = F.size(hops)
    kind = lambda *s: F.size(F.filter(hops, lambda h: h["status"].isin(*s)))
    return pages.where(n > 0).select(
        "url", n.alias("hops"), (n > 1).alias("is_chain"), (F.size(F.array_distinct(froms)) < n).alias("is_loop"),
        kind(302, 307).alias("temporary"), kind(301, 308).alias("permanent"),
    )


def broken_links(pages: DataFrame, links: DataFrame, most: int = 10) -> DataFrame:
    """``(url, status, linked_from, links)`` of pages that failed (status from 400, or none), with referrers.

    ``links`` has src and dst; the ``most`` smallest referrers are listed, all are counted.
    """
    from pyspark.sql import Window

    bad = pages.where("status >= 400 or status is null").select("url", "status").distinct()
    refs = links.join(bad.select(F.col("url").alias("dst")), "dst", "left_semi").select("src", "dst").distinct()
    ranked = refs.withColumn("n", F.row_number().over(Window.partitionBy("dst").orderBy("src")))
    some = ranked.where(F.col("n") <= most).groupBy("dst").agg(F.array_sort(F.collect_list("src")).alias("linked_from"))
    total = refs.groupBy("dst").agg(F.count("*").alias("links"))
    out = bad.join(some.withColumnRenamed("dst", "url"), "url", "left").join(total.withColumnRenamed("dst", "url"), "url", "left")
    return out.select("url", "status", F.coalesce("linked_from", F.expr("cast(array() as array<string>)")).alias("linked_from"), F.coalesce("links", F.lit(0).cast("long")).alias("links"))
