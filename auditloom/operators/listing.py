"""Listings of pages and issues with whitelisted filters and orders, and samples of pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Columns by which pages may be ordered.
SORTABLE = ("url", "depth", "status", "response_time_ms", "title", "word_count", "issue_count", "internal_links_count")


def list_pages(pages: DataFrame, text: str | None = None, status: int | None = None, with_issues: bool | None = None, sort: str = "url", descending: bool = False, limit: int = 50, offset: int = 0) -> tuple[DataFrame, DataFrame]:
    """One window of the matching pages in order, ties by url, and their exact number as ``total``.

    ``text`` is looked for in the url whatever the case, with live ``%`` and ``_``.
    """
    if sort not in SORTABLE:
        raise ValueError(f"can't sort by {sort!r}")
    found = pages
    if text:
        found = found.where(F.col("url").ilike(f"%{text}%"))
    if status is not None:
        found = found.where(F.col("status") == status)
    if with_issues is not None:
        found = found.where((F.col("issue_count") > 0) if with_issues else (F.col("issue_count") == 0))
    order = F.desc_nulls_last(sort) if descending else F.asc_nulls_first(sort)
    return found.orderBy(order, "url").offset(offset).limit(limit), found.agg(F.count("*").alias("total"))


def list_issues(issues: DataFrame, severity: str | None = None, code: str | None = None, limit: int = 50, offset: int = 0) -> tuple[DataFrame, DataFrame]:
    """One window of the matching issues by url, code and message, and their number."""
    found = issues
    if severity:
        found = found.where(F.col("severity") == severity)
    if code:
        found = found.where(F.col("code") == code)
    return found.orderBy("url", "code", "message").offset(offset).limit(limit), found.agg(F.count("*").alias("total"))


def page_at(pages: DataFrame, url: str) -> DataFrame:
    """The page with this exact url; the filter reaches the scan."""
    return pages.where(F.col("url") == url)


def eligible(status: Column, content_type: Column) -> Column:
    """Pages worth measuring: status 200 and html (an unknown type counts as html)."""
    return (status == 200) & F.lower(F.coalesce(F.when(content_type != "", content_type), F.lit("text/html"))).contains("html")


def sample_pages(pages: DataFrame, scores: DataFrame, start_url: str, priority: list[str], limit: int) -> DataFrame:
    """At most ``limit`` eligible pages: the start page, then ``priority``, then by importance, then by depth; url last.

    ``scores``: node, score. A report of fixed size.
    """
    first = F.coalesce(F.array_position(F.array(*[F.lit(p) for p in priority]).cast("array<string>"), F.col("url")), F.lit(0).cast("long"))
    p = pages.where(eligible(F.col("status"), F.col("content_type"))).dropDuplicates(["url"]).join(scores.withColumnRenamed("node", "url"), "url", "left")
    level = F.when(F.col("url") == start_url, 0).when(first > 0, 1).when(F.col("score").isNotNull(), 2).otherwise(3)
    return p.orderBy(level, first, F.desc_nulls_last("score"), "depth", "url").select("url", level.alias("level")).limit(limit)


def top_by(df: DataFrame, column: str, n: int, descending: bool = True) -> DataFrame:
    """The ``n`` rows with the largest (or smallest) known value, ties by url."""
    return df.where(F.col(column).isNotNull()).orderBy(F.desc(column) if descending else F.asc(column), "url").limit(n)


def latest_in_group(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each group in the given order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def summary_fields(report: DataFrame, fields: list[str]) -> DataFrame:
    """Only the allowed fields that the report has."""
    return report.select(*[f for f in fields if f in report.columns])


def due(rows: DataFrame, schedule: str, last: str, now: Column) -> DataFrame:
    """Rows whose daily or weekly schedule is due: never run, or the interval has passed; other schedules never are."""
    # Hours of the schedules.
    hours = F.when(F.col(schedule) == "daily", 24).when(F.col(schedule) == "weekly", 168)
    waited = F.unix_micros(now) - F.unix_micros(F.col(last).cast("timestamp"))
    return rows.where(hours.isNotNull() & (F.col(last).isNull() | (waited >= hours * F.lit(3_600_000_000))))


def search_listing(rows: DataFrame, sort: str, limit: int = 50, offset: int = 0) -> DataFrame:
    """One window of search rows: by position from the best on, by other metrics from the largest on, ties by id."""
    return rows.orderBy(F.asc(sort) if sort == "position" else F.desc(sort), "id").offset(offset).limit(limit)


def ranked_listing(rows: DataFrame, rank: str, limit: int = 50, offset: int = 0) -> DataFrame:
    """One window of referring domains or links from the highest rank on, unknown ranks last, ties by id."""
    return rows.orderBy(F.desc_nulls_last(rank), "id").offset(offset).limit(limit)


def resolve_aliases(links: DataFrame, aliases: DataFrame) -> DataFrame:
    """Links (src, dst) whose target is the page that its address stands for; ``aliases``: url, alias_of (final)."""
    known = aliases.where("alias_of is not null").groupBy("url").agg(F.min("alias_of").alias("_to"))
    return links.join(known.withColumnRenamed("url", "dst"), "dst", "left").select("src", F.coalesce("_to", "dst").alias("dst"))


def hub_table(hubs: DataFrame, pages: DataFrame, scores: DataFrame) -> DataFrame:
    """Hubs (node, links) with title and status of their pages and their importance, null where unknown."""
    p = pages.select(F.col("url").alias("node"), "title", "status").dropDuplicates(["node"])
    return hubs.join(p, "node", "left").join(scores, "node", "left").select("node", "links", "title", "status", "score")


def broken_link_statuses(links: DataFrame, pages: DataFrame) -> DataFrame:
    """Backlink rows with ``crawled_status``, the status of their target in the latest audit, met by normalised address."""
    from auditloom.functions.urls import normalize_url

    crawled = pages.where("status is not null").groupBy(normalize_url(F.col("url")).alias("_k")).agg(F.max("status").alias("crawled_status"))
    return links.withColumn("_k", normalize_url(F.col("url_to"))).join(crawled, "_k", "left").drop("_k")


def history_since(checks: DataFrame, key: str, now: Column, days: int = 90) -> DataFrame:
    """Checks of the last ``days``, by key, time and id."""
    return checks.where(F.col("checked_at") >= now - F.make_dt_interval(F.lit(days))).orderBy(key, "checked_at", "id")


def biggest_moves(overview: DataFrame, n: int, key: str = "keyword_id") -> DataFrame:
    """The ``n`` rows whose position changed most, either way, ties by key."""
    return overview.where("change is not null and change <> 0").orderBy(F.desc(F.abs("change")), key).limit(n)


def gap_series(checks: DataFrame, key: str = "keyword_id") -> DataFrame:
    """Each check's position, null where it was skipped or not ranked, and the scale of its key: its worst position, at least 10."""
    shown = F.when(F.col("status") != "skipped", F.col("position"))
    scale = checks.groupBy(key).agg(F.greatest(F.lit(10), F.max(shown)).alias("max_position"))
    return checks.select(key, "id", shown.alias("position")).join(scale, key)


def not_yet_seen(found: DataFrame, seen: DataFrame) -> DataFrame:
    """Addresses of the frontier and the sitemaps that were neither queued nor visited, once each."""
    return found.select("url").distinct().join(seen.select("url"), "url", "left_anti")


def severity_tally(rows: DataFrame, *keys: str) -> DataFrame:
    """How many rows are critical, warnings and infos."""
    n = lambda s: F.sum((F.col("severity") == s).cast("long")).alias(s)
    return rows.groupBy(*keys).agg(n("critical"), n("warning"), n("info"))
