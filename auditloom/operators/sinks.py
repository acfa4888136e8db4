"""Writing: audits as partitions, upserts by key, latest values, exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_audit(df: DataFrame, path: str, partition: str = "audit_id") -> None:
    """Replace exactly the partitions that ``df`` holds; other audits stay, and a rerun changes nothing."""
    (df.repartition(partition).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path))


def with_issue_counts(pages: DataFrame, issues: DataFrame, keys: list[str]) -> DataFrame:
    """Pages with ``issue_count`` counted from the issues (0 without any)."""
    n = issues.groupBy(*keys).agg(F.count("*").cast("int").alias("issue_count"))
    return pages.drop("issue_count").join(n, keys, "left").withColumn("issue_count", F.coalesce("issue_count", F.lit(0)))


def upsert(stored: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """``stored`` with rows of the same keys replaced by those of ``fresh``."""
    return stored.join(fresh.select(*keys), keys, "left_anti").unionByName(fresh, allowMissingColumns=True)


def cached_answers(cache: DataFrame, now: Column, ttl_hours: Column | int) -> DataFrame:
    """The latest answer of each (provider, endpoint, request_hash) that isn't too old."""
    keys = ["provider", "endpoint", "request_hash"]
    last = cache.groupBy(*keys).agg(F.max(F.struct("fetched_at", "answer")).alias("x")).select(*keys, "x.*")
    hours = F.lit(ttl_hours) if isinstance(ttl_hours, int) else ttl_hours
    return last.where(F.unix_micros(now) - F.unix_micros("fetched_at") <= hours * F.lit(3_600_000_000))


def audit_row(pages: DataFrame, key: str = "audit_id") -> DataFrame:
    """Page count of each audit, alias and duplicate rows left out."""
    return pages.groupBy(key).agg(F.sum(F.when(F.col("alias_of").isNull() & F.col("duplicate_of").isNull(), 1).otherwise(0)).alias("page_count"))


def export_csv(df: DataFrame, path: str, note: str | None = None) -> None:
    """CSV with a header row; complex columns as JSON, and with ``note`` a first column that carries it."""
    flat = df.select(*[
        (F.to_json(F.col(c)) if t.startswith(("array", "map", "struct")) else F.col(c).cast("string")).alias(c) for c, t in df.dtypes
    ])
    if note:
        flat = flat.select(F.lit(note).alias("note"), *flat.columns)
    flat.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def export_json(df: DataFrame, path: str) -> None:
    """JSON lines; nulls stay in the rows."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def export_html(df: DataFrame, path: str, title: str) -> None:
    """A small report as one HTML table, written by the driver from at most 10,000 rows; ValueError beyond."""
    import html
    from pathlib import Path

    rows = df.limit(10_001).collect()
    if len(rows) > 10_000:
        raise ValueError("too many rows for a single page; export CSV or JSON")
    cell = lambda x: html.escape("" if x is None else str(x))
    head = "".join(f"<th>{cell(c)}</th>" for c in df.columns)
    body = "".join("<tr>" + "".join(f"<td>{cell(x)}</td>" for x in r) + "</tr>" for r in rows)
    Path(path).write_text(f"<!doctype html><meta charset=utf-8><title>{cell(title)}</title><table><tr>{head}</tr>{body}</table>", encoding="utf-8")
