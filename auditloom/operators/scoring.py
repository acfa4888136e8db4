"""Health, categories, page scores, priorities and frequencies from issue rows.

Issues are rows of an audit key, ``url``, ``severity``, ``code`` and optionally ``source``; a bag, so equal
rows count each. Page counts come as rows of the audit key and ``pages``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditloom.operators.advice import ORPHAN_ADVICE, advice

# Weights of severities for health (others 1), categories and pages.
HEALTH_WEIGHTS = {"critical": 5.0, "warning": 2.0, "info": 0.5}
CATEGORY_WEIGHTS = {"critical": 5.0, "warning": 2.5}
PAGE_WEIGHTS = {"critical": 15, "warning": 5, "info": 1}
# Parts of issue codes that put an issue into a category; several may hold, none is technical.
CATEGORIES = {
    "technical_seo": ["STATUS_", "REDIRECT_", "NO_HTTPS", "FETCH_ERROR", "NOINDEX", "CANONICAL", "URL_"],
    "content": ["THIN_CONTENT", "MISSING_TITLE", "TITLE_", "MISSING_META_DESC", "META_DESC_", "MISSING_H1", "MULTIPLE_H1"],
    "internal_linking": ["ORPHAN", "DEAD_END", "EMPTY_ANCHOR", "BROKEN_LINK"],
    "accessibility": ["A11Y_", "MISSING_ALT", "SMALL_FONT", "MISSING_VIEWPORT"],
    "performance": ["PERF_", "LARGE_HTML", "SLOW_RESPONSE", "NO_LAZY_LOADING", "MISSING_IMG_DIMENSIONS"],
    "security": ["MISSING_HEADER_", "MIXED_CONTENT", "NO_HTTPS"],
}
# Weights of issue codes for priorities, by code; all others have 2.
IMPACT = {
    "A11Y_IMG_NO_ALT_ATTR": 4, "A11Y_UNLABELED_FORM_FIELD": 4, "BACKLINK_TO_BROKEN_PAGE": 8, "CWV_CLS_NEEDS_IMPROVEMENT": 3, "CWV_CLS_POOR": 7,
    "CWV_INP_NEEDS_IMPROVEMENT": 3, "CWV_INP_POOR": 7, "CWV_LCP_NEEDS_IMPROVEMENT": 3, "CWV_LCP_POOR": 7, "CWV_TBT_POOR": 5,
    "DUPLICATE_CONTENT": 7, "DUPLICATE_TITLE": 6, "EMPTY_TITLE": 8, "FETCH_ERROR": 10, "GSC_CANONICAL_MISMATCH": 4,
    "GSC_NOT_INDEXED": 8, "JS_CANONICAL_CHANGED": 7, "JS_CONTENT_DEPENDENT": 6, "JS_ONLY_LINKS": 3, "JS_ROBOTS_CHANGED": 8,
    "JS_TITLE_CHANGED": 5, "LARGE_DOM": 4, "MISSING_ALT": 4, "MISSING_CANONICAL": 6, "MISSING_H1": 6,
    "MISSING_HEADER_STRICT_TRANSPORT_SECURITY": 4, "MISSING_META_DESCRIPTION": 5, "MISSING_TITLE": 8, "MISSING_VIEWPORT": 8, "MIXED_CONTENT": 6,
    "MULTIPLE_CANONICALS": 6, "MULTIPLE_H1": 4, "NOINDEX": 7, "NO_COMPRESSION": 4, "NO_HTTPS": 9,
    "NO_RESPONSE": 10, "NO_STRUCTURED_DATA": 3, "POSSIBLE_CSR_ONLY": 5, "REDIRECT_CHAIN": 5, "REDIRECT_LOOP": 10,
    "RENDER_BLOCKING_CSS": 3, "RENDER_BLOCKING_JS": 3, "SLOW_TTFB": 6, "STATUS_404": 9, "STATUS_500": 10, "THIN_CONTENT": 6,
}
QUICK_WINS = ["MISSING_TITLE", "MISSING_ALT", "MISSING_CANONICAL", "A11Y_MISSING_LANG"]
SEVERITY_RANK = {"critical": 3, "warning": 2, "info": 1}


def _pick(c: Column, table: dict, default: float) -> Column:
    out = F.lit(default)
    for k, v in table.items():
        out = F.when(c == k, F.lit(v)).otherwise(out)
    return out


def grade(score: Column) -> Column:
    """A from 90, B from 75, C from 60, D from 40, else F."""
    return F.when(score >= 90, "A").when(score >= 75, "B").when(score >= 60, "C").when(score >= 40, "D").otherwise("F")


def _count(severity: str, name: str) -> Column:
    return F.coalesce(F.sum((F.col("severity") == severity).cast("long")), F.lit(0).cast("long")).alias(name)


def health_scores(pages: DataFrame, issues: DataFrame, key: str) -> DataFrame:
    """``(key, pages, score, grade, critical_issues, warning_issues, info_issues)`` for each row of ``pages``.

    100 less four times the mean weight of a page's issues, from 0 to 100 to one decimal; issues of source
    ``axe`` weigh like info. Without pages the score is 0 and the grade N/A.
    """
    source = F.col("source") if "source" in issues.columns else F.lit(None).cast("string")
    weight = F.when(source == "axe", HEALTH_WEIGHTS["info"]).otherwise(_pick(F.col("severity"), HEALTH_WEIGHTS, 1.0))
    sums = issues.groupBy(key).agg(
        F.sum(weight).alias("weight"), _count("critical", "c"), _count("warning", "w"), _count("info", "i")
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long"))
    score = F.when(F.col("pages") > 0, F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100 - F.coalesce("weight", F.lit(0.0)) / F.col("pages") * 4)), 1)).otherwise(0.0)
    return pages.join(sums, key, "left").select(
        key, "pages", score.alias("score"), F.when(F.col("pages") > 0, grade(score)).otherwise("N/A").alias("grade"),
        zero("c").alias("critical_issues"), zero("w").alias("warning_issues"), zero("i").alias("info_issues"),
    )


def category_scores(pages: DataFrame, issues: DataFrame, key: str) -> DataFrame:
    """``(key, category, score)``: 100 less six times the mean weight of the category's issues; 100 without pages."""
    code = F.col("code")
    hits = {c: F.lit(False) for c in CATEGORIES}
    for c, parts in CATEGORIES.items():
        for p in parts:
            hits[c] = hits[c] | code.contains(p)
    none = ~F.greatest(*[h.cast("int") for h in hits.values()]).cast("boolean")
    hits["technical_seo"] = hits["technical_seo"] | none
    weight = _pick(F.col("severity"), CATEGORY_WEIGHTS, 1.0)
    sums = issues.groupBy(key).agg(*[F.sum(F.when(h, weight).otherwise(0.0)).alias(c) for c, h in hits.items()])
    scores = pages.join(sums, key, "left").select(
        key, "pages", F.explode(F.array(*[F.struct(F.lit(c).alias("category"), F.coalesce(F.col(c), F.lit(0.0)).alias("w")) for c in CATEGORIES])).alias("x")
    )
    value = F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.round(100 - F.col("x.w") / F.col("pages") * 6, 1)))
    return scores.select(key, "x.category", F.when(F.col("pages") > 0, value).otherwise(100.0).alias("score"))


def page_scores(issues: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, critical_issues, warning_issues, info_issues, seo_score, issue_codes`` of pages with issues."""
    lost = sum((F.col(f"{s}_issues") * w for s, w in PAGE_WEIGHTS.items()), F.lit(0))
    return issues.groupBy(*keys).agg(
        *[_count(s, f"{s}_issues") for s in PAGE_WEIGHTS], F.concat_ws(", ", F.array_sort(F.collect_set("code"))).alias("issue_codes")
    ).withColumn("seo_score", F.greatest(F.lit(0), F.least(F.lit(100), 100 - lost)).cast("long"))


def issue_frequency(issues: DataFrame, *keys: str) -> DataFrame:
    """How often each code occurs."""
    return issues.groupBy(*keys, "code").agg(F.count("*").alias("count"))


def code_weight(code: Column) -> Column:
    """Weight of a code among priorities."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in IMPACT.items() for x in pair]), code), F.lit(2))


def recommendations(issues: DataFrame, key: str, orphans: DataFrame | None = None) -> DataFrame:
    """One row for each (key, code), by key and falling priority: pages, worst severity, priority, impact, effort, five example urls, advice.

    Priority is the code's weight times the pages, at most 50. A code without advice keeps its least message.
    The five examples are the smallest urls. ``orphans`` (key, url) adds the row ORPHAN_PAGES where there are any.
    """
    # Distinct urls first, so a code that holds much of all rows is spread; then at most five urls a group are kept.
    by_url = issues.groupBy(key, "code", "url").agg(
        F.max(_pick(F.col("severity"), SEVERITY_RANK, 0)).alias("s"), F.min("message").alias("message")
    )
    lone = None
    if orphans is not None:
        lone = orphans.select(key, F.lit("ORPHAN_PAGES").alias("code"), "url", F.lit(2).alias("s"), F.lit(ORPHAN_ADVICE).alias("message")).distinct()
        by_url = by_url.unionByName(lone)
    five = Window.partitionBy(key, "code").orderBy("url")
    totals = by_url.groupBy(key, "code").agg(F.count("*").alias("affected_pages"), F.max("s").alias("s"), F.min("message").alias("message"))
    # Row numbers up to five need no more than five rows of a group from each partition.
    first = by_url.select(key, "code", "url").withColumn("n", F.row_number().over(five)).where("n <= 5").groupBy(key, "code").agg(
        F.array_sort(F.collect_list("url")).alias("example_urls")
    )
    code = F.col("code")
    w = F.when(code == "ORPHAN_PAGES", F.lit(IMPACT["MISSING_CANONICAL"])).otherwise(code_weight(code))
    return totals.join(first, [key, "code"]).select(
        key, "code", F.when(F.col("s") == 3, "critical").when(F.col("s") == 2, "warning").otherwise("info").alias("severity"), "affected_pages",
        (w * F.least(F.col("affected_pages"), F.lit(50))).cast("long").alias("priority_score"),
        F.when((w >= 7) | (code == "ORPHAN_PAGES"), "High").when(w >= 4, "Medium").otherwise("Low").alias("impact"),
        F.when(code.isin([*QUICK_WINS, "ORPHAN_PAGES"]), "Quick Win").when(w >= 8, "Major").otherwise("Moderate").alias("estimated_effort"),
        "example_urls", F.coalesce(advice(code), "message", "code").alias("recommendation"),
    ).orderBy(key, F.desc("priority_score"), "code")


def executive_summary(pages: DataFrame, issues: DataFrame, key: str) -> DataFrame:
    """One row an audit: pages, statuses as a map, health score, grade and issue counts.

    ``pages`` has one row a page: key, url, status, alias_of, duplicate_of; alias and duplicate rows don't count.
    """
    own = pages.where("alias_of is null and duplicate_of is null")
    counts = own.groupBy(key).agg(F.count("*").alias("pages"))
    statuses = own.groupBy(key, "status").agg(F.count("*").alias("n")).groupBy(key).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.coalesce(F.col("status").cast("string"), F.lit("none")), "n")))).alias("statuses")
    )
    return health_scores(counts, issues, key).join(statuses, key, "left")
