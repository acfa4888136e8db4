"""Checks on response and address columns that need no parsing of the page: issues as arrays of structs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.functions import urls as U

# Severities, codes, limits and messages of the issues stand in the checks below.
ISSUE = "struct<severity:string,code:string,message:string>"


def issue(when: Column, severity: str, code: Column | str, message: Column | str) -> Column:
    """An issue struct where ``when`` holds, else null."""
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.when(when, F.struct(F.lit(severity).alias("severity"), lit(code).alias("code"), lit(message).alias("message")))


def gather(*issues: Column) -> Column:
    """The issues that hold, in the given order."""
    return F.array_compact(F.array(*issues))


def _text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def status_issues(url: Column, status: Column, error: Column, hops: Column) -> Column:
    """Status, redirects and https; a fetch error stands alone. ``hops``: array of structs with from, to, status."""
    broken = F.coalesce(error, F.lit("")) != ""
    froms = F.transform(hops, lambda h: h["from"])
    n = F.coalesce(F.size(hops), F.lit(0))
    has = n > 0
    fine = gather(
        issue(status.isNull(), "critical", "NO_RESPONSE", "No response received"),
        issue(status == 404, "critical", "STATUS_404", "Page returns 404 Not Found"),
        issue(status == 410, "warning", "STATUS_410", "Page returns 410 Gone"),
        issue(status >= 500, "critical", _text("STATUS_", status), _text("Server error ", status)),
        issue(status.isin(301, 302, 307, 308), "info", _text("STATUS_", status), _text("Page redirects (", status, ")")),
        issue(has & (n > 1), "warning", "REDIRECT_CHAIN", _text("Redirect chain of ", n, " hops")),
        issue(has & F.exists(hops, lambda h: h["status"].isin(302, 307)), "info", "TEMP_REDIRECT", "Uses a temporary redirect (302/307) instead of permanent"),
        issue(has & (F.size(F.array_distinct(froms)) < n), "critical", "REDIRECT_LOOP", "Redirect loop detected"),
        issue(U.scheme(url) != "https", "critical", "NO_HTTPS", "Page is served over HTTP, not HTTPS"),
    )
    return F.when(broken, gather(issue(F.lit(True), "critical", "FETCH_ERROR", _text("Failed to fetch: ", error)))).otherwise(fine)


def robots_issues(header: Column, meta: Column) -> Column:
    """Noindex and nofollow from header and meta together, each once."""
    both = F.concat_ws(" ", F.lower(F.coalesce(header, F.lit(""))), F.lower(F.coalesce(meta, F.lit(""))))
    return gather(
        issue(both.contains("noindex"), "warning", "NOINDEX", "Page is set to noindex"),
        issue(both.contains("nofollow"), "info", "NOFOLLOW", "Page is set to nofollow"),
    )


def url_issues(url: Column) -> Column:
    """Capitals, underscores, length and number of parameters of an address."""
    where, n = U.path(url), U.parameter_count(url)
    return gather(
        issue(where.rlike(r"\p{Lu}"), "info", "URL_UPPERCASE", "URL path contains uppercase characters"),
        issue(where.contains("_"), "info", "URL_UNDERSCORE", "URL uses underscores instead of hyphens"),
        issue(F.length(url) > 115, "info", "URL_TOO_LONG", _text("URL is long (", F.length(url), " chars)")),
        issue(n > 3, "info", "TOO_MANY_PARAMS", _text("URL has ", n, " query parameters")),
    )


# Security headers and the severity of their absence.
SECURITY_HEADERS = {
    "strict-transport-security": "warning", "content-security-policy": "info", "x-content-type-options": "info",
    "x-frame-options": "info", "referrer-policy": "info",
}


def lower_keys(headers: Column) -> Column:
    """A header map with lower-case names (the last of equal ones wins)."""
    return F.aggregate(
        F.map_entries(headers), F.expr("cast(map() as map<string,string>)"),
        lambda m, e: F.map_concat(F.map_filter(m, lambda k, v: k != F.lower(e["key"])), F.map_from_arrays(F.array(F.lower(e["key"])), F.array(e["value"]))),
    )


def header_names(headers: Column) -> Column:
    """Lower-case names of a header map, empty for null."""
    return F.coalesce(F.transform(F.map_keys(headers), lambda k: F.lower(k)), F.expr("cast(array() as array<string>)"))


def security_issues(headers: Column) -> Column:
    """Missing security headers; a page without any header raises none."""
    names = header_names(headers)
    return gather(*[
        issue((F.size(names) > 0) & ~F.array_contains(names, h), severity, "MISSING_HEADER_" + h.upper().replace("-", "_"), f"Missing security header: {h}")
        for h, severity in SECURITY_HEADERS.items()
    ])


def performance_issues(response_ms: Column, headers: Column, nodes: Column, css: Column, js: Column, html_bytes: Column) -> Column:
    """Slow answers, heavy pages, blocking resources, missing compression and caching."""
    names = header_names(headers)
    return gather(
        issue(response_ms > 800, "warning", "SLOW_TTFB", _text("Slow response time: ", response_ms, "ms")),
        issue(nodes > 1500, "warning", "LARGE_DOM", _text("Large DOM: ", nodes, " nodes")),
        issue(css > 4, "info", "RENDER_BLOCKING_CSS", _text(css, " render-blocking stylesheets")),
        issue(js > 4, "info", "RENDER_BLOCKING_JS", _text(js, " render-blocking scripts")),
        issue(html_bytes > 300_000, "info", "LARGE_HTML", _text("HTML document is ", F.floor(html_bytes / 1024), "KB")),
        issue(~F.array_contains(names, "content-encoding"), "info", "NO_COMPRESSION", "Response is not compressed (no Content-Encoding header)"),
        issue(~F.array_contains(names, "cache-control"), "info", "NO_CACHE_HEADER", "No Cache-Control header set"),
    )


def title_issues(title: Column) -> Column:
    """Missing (null), empty, short and long titles."""
    n = F.length(title)
    return gather(
        issue(title.isNull(), "critical", "MISSING_TITLE", "Missing <title> tag"),
        issue(n == 0, "critical", "EMPTY_TITLE", "Title tag is empty"),
        issue((n > 0) & (n < 15), "info", "TITLE_TOO_SHORT", _text("Title is short (", n, " chars)")),
        issue(n > 60, "info", "TITLE_TOO_LONG", _text("Title may be truncated in SERPs (", n, " chars)")),
    )


def description_issues(description: Column) -> Column:
    """Missing, short and long meta descriptions."""
    d = F.trim(F.coalesce(description, F.lit("")))
    n = F.length(d)
    return gather(
        issue(n == 0, "warning", "MISSING_META_DESCRIPTION", "Missing meta description"),
        issue((n > 0) & (n < 50), "info", "META_DESC_TOO_SHORT", _text("Meta description is short (", n, " chars)")),
        issue(n > 160, "info", "META_DESC_TOO_LONG", _text("Meta description may be truncated (", n, " chars)")),
    )


def thin_content(words: Column) -> Column:
    """Fewer than 150 words."""
    return gather(issue(words < 150, "warning", "THIN_CONTENT", _text("Thin content: only ", words, " words")))


def explode_issues(df: DataFrame, key: list[str], *arrays: Column) -> DataFrame:
    """One row an issue: the key columns, severity, code, message."""
    every = reduce(lambda a, b: F.concat(a, b), arrays)
    return df.select(*key, F.explode(every).alias("i")).select(*key, "i.severity", "i.code", "i.message")
