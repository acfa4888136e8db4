"""Audits against each other: issue and page differences, previous audits, comparisons over time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auditloom.operators.snapshots import consecutive_audits

PAIR = ["url", "code"]


def issue_changes(new: DataFrame, old: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """``keys, severity, message, change``: distinct issues that are ``new`` or ``fixed``.

    Issues are compared by (``keys``), by default url and code; of several rows the least severity and message are given.
    """
    keys = keys or PAIR
    once = lambda a, b, kind: (
        a.join(b.select(*keys), keys, "left_anti").groupBy(*keys).agg(F.min("severity").alias("severity"), F.min("message").alias("message")).withColumn("change", F.lit(kind))
    )
    return once(new, old, "new").unionByName(once(old, new, "fixed"))


def persisting_issues(new: DataFrame, old: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Distinct keys of issues in both audits."""
    keys = keys or PAIR
    return new.join(old.select(*keys), keys, "left_semi").select(*keys).distinct()


def page_changes(new: DataFrame, old: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of pages added or removed."""
    n, o = new.select(*keys).distinct(), old.select(*keys).distinct()
    return n.join(o, keys, "left_anti").withColumn("change", F.lit("added")).unionByName(o.join(n, keys, "left_anti").withColumn("change", F.lit("removed")))


def status_changes(new: DataFrame, old: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, old_status, new_status`` of pages in both audits whose status differs (null is a status)."""
    n, o = new.select(*keys, F.col("status").alias("new_status")), old.select(*keys, F.col("status").alias("old_status"))
    return n.join(o, keys).where(~F.col("new_status").eqNullSafe(F.col("old_status"))).select(*keys, "old_status", "new_status")


def audit_diffs(audits: DataFrame, pages: DataFrame, issues: DataFrame) -> dict[str, DataFrame]:
    """All differences of every completed audit from the one before it in its project, keyed by ``audit_id``.

    Keys new_issues, persisting, pages, statuses and scores. Exact counts come from grouping these.
    """
    pairs = consecutive_audits(audits)
    later = pairs.select("audit_id")
    back = pairs.select(F.col("previous_id").alias("audit_id"), F.col("audit_id").alias("at"))
    now = lambda df: df.join(later, "audit_id")
    before = lambda df: df.join(back, "audit_id").drop("audit_id").withColumnRenamed("at", "audit_id")
    score = audits.groupBy(F.col("id").alias("audit_id")).agg(F.max("health_score").alias("score"))
    scores = pairs.join(score, "audit_id").join(score.select(F.col("audit_id").alias("previous_id"), F.col("score").alias("old_score")), "previous_id")
    keys = ["audit_id", "url"]
    return {
        "issues": issue_changes(now(issues), before(issues), [*keys, "code"]),
        "persisting": persisting_issues(now(issues), before(issues), [*keys, "code"]),
        "pages": page_changes(now(pages), before(pages), keys),
        "statuses": status_changes(now(pages), before(pages), keys),
        "scores": scores.select("audit_id", "previous_id", "old_score", "score", F.round(F.col("score") - F.col("old_score"), 1).alias("change")),
    }


def project_cards(projects: DataFrame, audits: DataFrame) -> DataFrame:
    """Per project: number of audits and the latest one by end and id."""
    a = audits.groupBy("id").agg(F.max(F.struct("project_id", "finished_at", "health_score", "status")).alias("x")).select("id", "x.*")
    best = a.groupBy("project_id").agg(F.count("*").alias("audits"), F.max(F.struct("finished_at", "id", "health_score")).alias("m"))
    once = projects.groupBy("id").agg(F.max("name").alias("name"), F.max("domain").alias("domain"))
    return once.join(best.withColumnRenamed("project_id", "id"), "id", "left").select(
        F.col("id").alias("project_id"), "name", "domain", F.coalesce("audits", F.lit(0).cast("long")).alias("audits"),
        F.col("m.id").alias("latest_audit_id"), F.col("m.finished_at").alias("latest_finished_at"), F.col("m.health_score").alias("latest_score"),
    )


def code_changes(new: DataFrame, old: DataFrame, key: str) -> DataFrame:
    """``(key, code, change)``: codes that came up or were resolved, whatever the pages."""
    n, o = new.select(key, "code").distinct(), old.select(key, "code").distinct()
    return n.join(o, [key, "code"], "left_anti").withColumn("change", F.lit("new")).unionByName(o.join(n, [key, "code"], "left_anti").withColumn("change", F.lit("resolved")))


def newest(df: DataFrame, keys: list[str], order: list, n: int) -> DataFrame:
    """The first ``n`` rows of each group in the given order; no keys: of all rows."""
    if not keys:
        return df.orderBy(*order).limit(n)
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def beyond_retention(sessions: DataFrame, keep: int = 20) -> DataFrame:
    """Sessions older than the ``keep`` newest by (saved_at, id)."""
    kept = sessions.orderBy(F.desc("saved_at"), F.desc("id")).limit(keep)
    return sessions.join(kept.select("id"), "id", "left_anti")
