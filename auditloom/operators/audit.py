"""One audit end to end: checks of response and page, custom rules, issues from other sources, scores, advice, link graph."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.functions import urls as U
from auditloom.operators import checks, graph, rules, scoring
from auditloom.operators.html_facts import page_facts
from auditloom.runtime import cut_lineage

COLUMNS = ["url", "severity", "code", "message", "source"]


def response_issues(pages: DataFrame) -> DataFrame:
    """``(url, severity, code, message)`` of all checks on addresses and responses.

    ``pages`` has url, status, error, headers, response_time_ms, redirect_chain and the counts of page facts
    (dom_nodes, blocking_css, blocking_js, html_bytes, robots_directives), null where there is no page.
    """
    c = F.col
    header = F.try_element_at(checks.lower_keys(F.coalesce("headers", F.expr("cast(map() as map<string,string>)"))), F.lit("x-robots-tag"))
    return checks.explode_issues(
        pages, ["url"], checks.status_issues(c("url"), c("status"), c("error"), c("redirect_chain")), checks.robots_issues(header, c("robots_directives")), checks.url_issues(c("url")),
        checks.security_issues(c("headers")), checks.performance_issues(c("response_time_ms"), c("headers"), c("dom_nodes"), c("blocking_css"), c("blocking_js"), c("html_bytes")),
    )


def all_issues(parts: Mapping[str, DataFrame]) -> DataFrame:
    """The issues of all sources as one table (url, severity, code, message, source); a part's own ``source`` stays."""
    out = None
    for name, df in parts.items():
        own = df.select("url", "severity", "code", F.col("message") if "message" in df.columns else F.lit(None).cast("string").alias("message"),
                        F.coalesce(F.col("source") if "source" in df.columns else F.lit(None).cast("string"), F.lit(name)).alias("source"))
        out = own if out is None else out.unionByName(own)
    return out


def full_audit(
    responses: DataFrame, custom_rules: Sequence[Mapping[str, Any]] = (), others: Mapping[str, DataFrame] | None = None, start: str | None = None, audit_id: int = 0
) -> dict[str, DataFrame]:
    """Everything an audit reports, each part a lazy table: issues, pages, health, categories, page_scores, recommendations, frequency, orphans.

    ``responses`` has one row a page: url, final_url, status, html, headers, response_time_ms, error,
    redirect_chain, depth, alias_of, duplicate_of. Alias and duplicate rows are listed, not analysed. ``others`` are
    issue tables (url, severity, code, message) of further sources (rendering, accessibility, vitals, index,
    backlinks, ...) by name. The page is parsed once.
    """
    own = responses.where("alias_of is null and duplicate_of is null")
    facts = page_facts(own, "html", rules.selectors_of(custom_rules))
    pages = cut_lineage(own.drop("title", "meta_robots").join(facts.drop("final_url"), "url", "left"))
    parts = {"html": checks.explode_issues(pages, ["url"], F.col("html_issues")), "response": response_issues(pages)}
    if custom_rules:
        parts["rules"] = rules.evaluate(pages, custom_rules).where("not passed").select("url", "severity", "code", "message")
    issues = cut_lineage(all_issues({**parts, **(others or {})}).withColumn("audit_id", F.lit(audit_id)))
    edges = pages.select(F.col("url").alias("src"), F.explode("links").alias("l")).where("l.internal").select("src", U.normalize_url(F.col("l.dst")).alias("dst"))
    known = pages.select("url", U.normalize_url(F.col("url")).alias("node"))
    orphans = graph.orphans(known, edges.where("src is not null").join(known.withColumnRenamed("node", "own"), edges["src"] == known["url"]).where("own <> dst").select("src", "dst"))
    if start is not None:
        orphans = orphans.where(F.col("url") != start)
    counted = pages.agg(F.count("*").alias("pages")).withColumn("audit_id", F.lit(audit_id))
    orphans = orphans.select(F.lit(audit_id).alias("audit_id"), "url")
    return {
        "issues": issues, "pages": pages, "health": scoring.health_scores(counted, issues, "audit_id"), "categories": scoring.category_scores(counted, issues, "audit_id"),
        "page_scores": scoring.page_scores(issues, ["audit_id", "url"]), "recommendations": scoring.recommendations(issues, "audit_id", orphans),
        "frequency": scoring.issue_frequency(issues, "audit_id"), "orphans": orphans,
    }
