"""Landed JSON of data providers as tables: backlinks, search performance, inspections, keyword data, citations, suggestions.

Each parser takes rows of landed answers and explodes them with a declared schema: broken JSON and missing parts
give nulls or no rows, never an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.functions.urls import hostname, metrics_key, project_domain


def _results(kind: str) -> Column:
    """The first result of an answer: JSON of an array of objects of which the first counts."""
    return F.try_element_at(F.from_json("json", f"array<struct<{kind}>>"), F.lit(1))


def _known(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(0).cast("long"))


def backlink_summaries(answers: DataFrame) -> DataFrame:
    """``(target, rank, backlinks, referring_domains, broken_backlinks)``; counts default to 0, the rank may be null."""
    r = _results("rank:long,backlinks:long,referring_domains:long,broken_backlinks:long")
    return answers.select("target", r.alias("r")).select("target", "r.rank", *[_known(f"r.{c}").alias(c) for c in ("backlinks", "referring_domains", "broken_backlinks")])


def referring_domains(answers: DataFrame) -> DataFrame:
    """``(target, ord, domain, rank, backlinks, first_seen)`` in the given order; items without a domain are left out."""
    r = _results("items:array<struct<domain:string,rank:long,backlinks:long,first_seen:string>>")
    each = answers.select("target", F.posexplode(r["items"]).alias("ord", "i")).where("coalesce(i.domain, '') <> ''")
    return each.select("target", "ord", "i.domain", "i.rank", _known("i.backlinks").alias("backlinks"), "i.first_seen")


def backlinks(answers: DataFrame) -> DataFrame:
    """``(target, kind, url_from, url_to, anchor, domain_from_rank, dofollow, first_seen, last_seen, target_status)`` of links with both ends."""
    r = _results("items:array<struct<url_from:string,url_to:string,anchor:string,domain_from_rank:long,dofollow:boolean,first_seen:string,last_seen:string,url_to_status_code:int>>")
    each = answers.select("target", "kind", F.explode(r["items"]).alias("i")).where("coalesce(i.url_from, '') <> '' and coalesce(i.url_to, '') <> ''")
    return each.select(
        "target", "kind", "i.url_from", "i.url_to", F.coalesce("i.anchor", F.lit("")).alias("anchor"), "i.domain_from_rank",
        F.coalesce("i.dofollow", F.lit(False)).alias("dofollow"), "i.first_seen", "i.last_seen", F.col("i.url_to_status_code").alias("target_status"),
    )


def backlink_history(answers: DataFrame) -> DataFrame:
    """``(target, month, rank, backlinks, referring_domains)``: the first of the month of each point with a date."""
    r = _results("items:array<struct<date:string,rank:long,backlinks:long,referring_domains:long>>")
    each = answers.select("target", F.explode(r["items"]).alias("i")).select("*", F.try_to_timestamp(F.substring("i.date", 1, 10), F.lit("yyyy-MM-dd")).alias("at"))
    return each.where("at is not null").select("target", F.trunc("at", "MM").alias("month"), "i.rank", _known("i.backlinks").alias("backlinks"), _known("i.referring_domains").alias("referring_domains"))


def months_back(day: Column, months: int) -> Column:
    """The first day of the month ``months`` before."""
    return F.trunc(F.add_months(day, -months), "MM")


def bulk_metrics(urls: DataFrame, links: DataFrame, domains: DataFrame) -> DataFrame:
    """``(url, backlinks, referring_domains)``: both metrics met by the key of bulk answers; null where there is none.

    ``links``: target, backlinks; ``domains``: target, referring_domains.
    """
    side = lambda df, c: df.groupBy(metrics_key(F.col("target")).alias("k")).agg(F.max(c).alias(c))
    keyed = urls.select("url", metrics_key(F.col("url")).alias("k"))
    return keyed.join(side(links, "backlinks"), "k", "left").join(side(domains, "referring_domains"), "k", "left").select("url", "backlinks", "referring_domains")


def search_rows(answers: DataFrame) -> DataFrame:
    """``(site, keys, clicks, impressions, ctr, position)`` of search-performance answers (json: an object with rows); missing numbers are 0."""
    rows = F.from_json("json", "struct<rows:array<struct<keys:array<string>,clicks:double,impressions:double,ctr:double,position:double>>>")["rows"]
    zero = lambda c: F.coalesce(F.col(f"r.{c}"), F.lit(0.0)).alias(c)
    return answers.select("site", F.explode(rows).alias("r")).select("site", F.coalesce("r.keys", F.array().cast("array<string>")).alias("keys"), *[zero(c) for c in ("clicks", "impressions", "ctr", "position")])


def inspections(answers: DataFrame) -> DataFrame:
    """``(url, verdict, coverage, indexing_state, robots_state, fetch_state, google_canonical, user_canonical, last_crawl)`` of inspection answers."""
    names = {"verdict": "verdict", "coverageState": "coverage", "indexingState": "indexing_state", "robotsTxtState": "robots_state", "pageFetchState": "fetch_state", "googleCanonical": "google_canonical", "userCanonical": "user_canonical", "lastCrawlTime": "last_crawl"}
    r = F.from_json("json", f"struct<inspectionResult:struct<indexStatusResult:struct<{','.join(f'{n}:string' for n in names)}>>>")["inspectionResult"]["indexStatusResult"]
    return answers.select("url", r.alias("r")).select("url", *[F.col(f"r.{n}").alias(c) for n, c in names.items()])


def site_domain(site: Column) -> Column:
    """The domain a search property covers: of ``sc-domain:x`` it is x, of an address its host without ``www.``."""
    return F.when(site.startswith("sc-domain:"), F.lower(F.substr(site, F.lit(11)))).otherwise(F.regexp_replace(hostname(site), r"^www\.", ""))


def match_property(projects: DataFrame, sites: DataFrame) -> DataFrame:
    """``(project_id, property)``: the saved property, else the best one that covers the domain, else null.

    ``projects``: id, domain, saved; ``sites``: site_url, permission. Unverified ones don't count; a domain property
    is best, then https before http, then ``www.`` before bare hosts, then the address.
    """
    site = F.col("site_url")
    whole = site.startswith("sc-domain:")
    usable = sites.where("permission is null or permission <> 'siteUnverifiedUser'").select(
        F.when(whole, F.substr(site, F.lit(11))).otherwise(project_domain(site)).alias("domain"),
        F.struct((~whole).alias("a"), (~site.startswith("https://")).alias("b"), (~site.contains("://www.")).alias("c"), site.alias("site")).alias("x"),
    ).groupBy("domain").agg(F.min("x")["site"].alias("found"))
    return projects.join(usable, "domain", "left").select(F.col("id").alias("project_id"), F.coalesce(F.nullif("saved", F.lit("")), "found").alias("property"))


def keyword_difficulty(answers: DataFrame) -> DataFrame:
    """``(keyword, difficulty)`` of items that have both; the keyword in lower case."""
    r = _results("items:array<struct<keyword:string,keyword_difficulty:int>>")
    each = answers.select(F.explode(r["items"]).alias("i")).where("coalesce(i.keyword, '') <> '' and i.keyword_difficulty is not null")
    return each.groupBy(F.lower("i.keyword").alias("keyword")).agg(F.max("i.keyword_difficulty").alias("difficulty"))


def ranked_keywords(answers: DataFrame) -> DataFrame:
    """``(domain, keyword, position, url, search_volume, difficulty)`` of items with a keyword and a position."""
    r = _results(
        "items:array<struct<keyword_data:struct<keyword:string,keyword_info:struct<search_volume:int>,keyword_properties:struct<keyword_difficulty:int>>,"
        "ranked_serp_element:struct<serp_item:struct<rank_group:int,url:string>>>>"
    )
    each = answers.select("domain", F.explode(r["items"]).alias("i")).select("domain", F.col("i.keyword_data").alias("k"), F.col("i.ranked_serp_element.serp_item").alias("s"))
    return each.where("coalesce(k.keyword, '') <> '' and s.rank_group > 0").select(
        "domain", F.lower("k.keyword").alias("keyword"), F.col("s.rank_group").alias("position"), F.coalesce("s.url", F.lit("")).alias("url"),
        F.col("k.keyword_info.search_volume").alias("search_volume"), F.col("k.keyword_properties.keyword_difficulty").alias("difficulty"),
    )


def questions(answers: DataFrame) -> DataFrame:
    """``(keyword, question)``: distinct questions that a result page lists beside its results."""
    r = F.from_json("json", "struct<items:array<struct<type:string,items:array<struct<title:string>>>>>")["items"]
    asked = F.flatten(F.transform(F.filter(r, lambda i: (i["type"] == "people_also_ask") & i["items"].isNotNull()), lambda i: F.transform(i["items"], lambda q: q["title"])))
    return answers.select("keyword", F.explode(F.array_distinct(F.filter(asked, lambda t: F.coalesce(t, F.lit("")) != ""))).alias("question"))


def suggestions(answers: DataFrame) -> DataFrame:
    """``(seed, ord, phrase)`` of autocomplete answers: JSON of [seed, [phrases], ...]."""
    phrases = F.from_json(F.get_json_object("json", "$[1]"), "array<string>")
    return answers.select("seed", F.posexplode(phrases).alias("ord", "phrase")).where("trim(phrase) <> ''")


def clean_keywords(keywords: DataFrame, longest: int = 80) -> tuple[DataFrame, DataFrame]:
    """Distinct keywords in lower case with single spaces: those of at most ``longest`` characters, and the longer ones."""
    from auditloom.functions.texts import normalize_keyword

    each = keywords.select(normalize_keyword(F.col("keyword")).alias("keyword")).where("keyword <> ''").distinct()
    return each.where(F.length("keyword") <= longest), each.where(F.length("keyword") > longest)
