"""Exact percentiles per group by bisection: passes over the data count rows between midpoints.

For every group, column and percentile an interval of values is held that contains the answer. A pass
splits each open interval at equally spaced midpoints (on a linear and a logarithmic scale in turn),
counts the rows in each part with their least and greatest value, and keeps the part in which the target
rank falls, shrunk to those values. Every pass strictly narrows each interval, whatever the distribution.
Only counts are moved, never rows; counts of separate days or partitions add up.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditloom.runtime import broadcast_if_small, cut_lineage

PARTS = 16
_MAX = 1.7976931348623157e308


def value_parts(df: DataFrame, groups: dict[str, Column], columns: Sequence[str]) -> DataFrame:
    """Combinable parts ``(groups, metric, value, n)``: how often each value occurs in each group set.

    ``groups`` names grouping kinds and gives their key (a string). Null, NaN and negative values are
    left out; infinity counts as the largest finite number. Parts of several days or partitions are
    combined by ``unionByName``.
    """
    keys = F.array(*[F.struct(F.lit(k).alias("kind"), c.cast("string").alias("key")) for k, c in groups.items()])
    long = df.select(
        F.filter(keys, lambda s: s["key"].isNotNull()).alias("groups"),
        F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in columns])).alias("m"),
    )
    value = F.col("m.value")
    return (
        long.where(value.isNotNull() & ~F.isnan(value) & (value >= 0))
        .groupBy("groups", F.col("m.metric").alias("metric"), F.least(value, F.lit(_MAX)).alias("value"))
        .agg(F.count("*").alias("n"))
    )


def exact_percentiles(parts: DataFrame, percents: Sequence[int] = (50, 90, 95, 99)) -> DataFrame:
    """``(kind, key, metric, percentile, value, n, rank_error)`` from the union of any ``value_parts``.

    The percentile P of n values is the one at rank ceil(n * P / 100) in ascending order, an existing
    value; ``rank_error`` is the bound on the rank's error, 0. Ties need no care; groups without values
    give no row; no parts give no rows.
    """
    rows = cut_lineage(parts.select("groups", "metric", "value", "n"))
    exploded = rows.select(F.explode("groups").alias("g"), "metric", "value", "n").select(
        "g.kind", "g.key", "metric", "value", "n"
    )
    start = exploded.groupBy("kind", "key", "metric").agg(
        F.sum("n").alias("total"), F.min("value").alias("lo"), F.max("value").alias("hi")
    )
    state = start.select(
        "kind", "key", "metric", "total", F.explode(F.array(*[F.lit(int(p)) for p in percents])).alias("percentile"), "lo", "hi"
    ).withColumn("left", F.expr("(total * percentile + 99) div 100"))  # rank still to find among the rows from lo on
    state = cut_lineage(state.withColumn("left", F.greatest(F.col("left"), F.lit(1).cast("long"))))
    done: list[DataFrame] = []
    ids = ["kind", "key", "metric", "percentile"]
    linear = True
    while True:
        done.append(state.where("lo = hi"))
        open_ = state.where("lo < hi")
        if not open_.limit(1).count():
            break
        a, b = (F.col("value") / 2 - F.col("lo") / 2), (F.col("hi") / 2 - F.col("lo") / 2)
        share = a / b if linear else F.log1p(a) / F.log1p(b)
        part = F.least(F.floor(share * PARTS), F.lit(PARTS - 1)).cast("int")
        # Several percentiles of one group sit in one row of the small side, so a data row meets it once.
        small = broadcast_if_small(
            open_.groupBy("kind", "key", "metric").agg(F.collect_list(F.struct("percentile", "lo", "hi")).alias("open"))
        )
        counts = (
            exploded.join(small, ["kind", "key", "metric"])
            .select("kind", "key", "metric", "value", "n", F.explode("open").alias("o"))
            .select("kind", "key", "metric", "value", "n", "o.percentile", "o.lo", "o.hi")
            .where("value between lo and hi")
            .groupBy(*ids, part.alias("part"))
            .agg(F.sum("n").alias("rows"), F.min("value").alias("least"), F.max("value").alias("most"))
        )
        upto = F.sum("rows").over(Window.partitionBy(*ids).orderBy("part"))
        narrowed = (
            open_.select(*ids, "total", "left")
            .join(counts.withColumn("upto", upto), ids)
            .where("left > upto - rows and left <= upto")
            .select("kind", "key", "metric", "total", "percentile", F.col("least").alias("lo"), F.col("most").alias("hi"),
                    (F.col("left") - F.col("upto") + F.col("rows")).alias("left"))
        )
        state = cut_lineage(narrowed)
        linear = not linear
    out = done[0]
    for df in done[1:]:
        out = out.unionByName(df)
    return out.select(*ids, F.col("lo").alias("value"), F.col("total").alias("n"), F.lit(0).cast("long").alias("rank_error"))


def page_parts(pages: DataFrame, audits: DataFrame) -> DataFrame:
    """Parts of response time and depth of the distinct page records, per audit, project, day and overall.

    The day is that of ``fetched_at`` in UTC. A record without audit, known project or time is left out
    of that grouping only. Rows delivered twice count once.
    """
    once = pages.select("page_id", "audit_id", "fetched_at", "response_time_ms", "depth").distinct()
    projects = broadcast_if_small(audits.where("id is not null").groupBy(F.col("id").alias("audit_id")).agg(F.max("project_id").alias("project_id")))
    day = F.expr("date_from_unix_date(cast(floor(unix_seconds(cast(fetched_at as timestamp)) / 86400) as int))")
    return value_parts(
        once.join(projects, "audit_id", "left").withColumn("day", day),
        {"audit": F.col("audit_id"), "project": F.col("project_id"), "day": F.col("day"), "overall": F.lit("all")},
        ["response_time_ms", "depth"],
    )
