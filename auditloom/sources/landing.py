"""Landed responses and provider answers as tables: caches, headers, charsets, robots, sitemaps, JSON."""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.robotparser import RobotFileParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HOP = "struct<from:string,to:string,status:int>"
RESPONSES = (
    "url string, final_url string, status_code int, content_type string, html string, headers map<string,string>, depth int, response_time_ms double, "
    f"error string, redirect_chain array<{HOP}>, found_via string, alias_of string, duplicate_of string, cache_status string, body_hash string"
)
_CHARSET = re.compile(rb"<meta[^>]{0,200}?charset\s*=\s*[\"']?\s*([A-Za-z0-9_.:\-]+)", re.I)


def read_responses(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Fetched pages in the fixed schema, from Parquet or JSON lines."""
    reader = spark.read.schema(RESPONSES)
    return reader.json(path) if fmt == "json" else reader.parquet(path)


def usable_cache(cache: DataFrame, fingerprint: str, now: Column, days: int = 30) -> DataFrame:
    """Cached analyses made with this fingerprint within the last ``days``; the latest of each url."""
    fresh = cache.where((F.col("fingerprint") == fingerprint) & (F.col("analysed_at") >= now - F.expr(f"INTERVAL {days} DAYS")))
    return fresh.groupBy("url").agg(F.max(F.struct("analysed_at", "etag", "last_modified", "body_hash")).alias("x")).select("url", "x.*")


def conditional_headers(frontier: DataFrame, cache: DataFrame) -> DataFrame:
    """``(url, request_headers)``: validators of cached pages for conditional requests; an empty map otherwise."""
    pairs = F.filter(
        F.array(F.struct(F.lit("If-None-Match").alias("k"), F.col("etag").alias("v")), F.struct(F.lit("If-Modified-Since").alias("k"), F.col("last_modified").alias("v"))),
        lambda p: F.coalesce(p["v"], F.lit("")) != "",
    )
    return frontier.join(cache.select("url", "etag", "last_modified"), "url", "left").select("url", F.map_from_entries(pairs).alias("request_headers"))


def merge_headers(stored: Column, fresh: Column) -> Column:
    """Stored headers with those of a 304 answer over them, names in lower case."""
    low = lambda m: F.transform_keys(F.coalesce(m, F.expr("cast(map() as map<string,string>)")), lambda k, v: F.lower(k))
    return F.map_concat(F.map_filter(low(stored), lambda k, v: ~F.map_contains_key(low(fresh), k)), low(fresh))


def reuse_or_compute(responses: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Responses whose page is unchanged (a 304, or an equal body hash) and those to analyse anew."""
    j = responses.join(cache.select("url", F.col("body_hash").alias("_h")), "url", "left")
    same = F.col("_h").isNotNull() & (((F.col("status_code") == 200) & (F.col("body_hash") == F.col("_h"))) | (F.col("status_code") == 304))
    return j.where(same).drop("_h"), j.where(~F.coalesce(same, F.lit(False))).drop("_h")


def decode_bodies(df: DataFrame, body: str = "body", content_type: str = "content_type") -> DataFrame:
    """Adds ``html``: the body by the header's charset, else a meta tag's in the first 2048 bytes, else UTF-8."""
    from pyspark.sql import types as T

    schema = T.StructType([*df.schema.fields, T.StructField("html", T.StringType())])

    def text(raw: bytes | None, kind: str | None) -> str | None:
        if raw is None:
            return None
        m = re.search(r"charset=[\"']?\s*([\w.:\-]+)", kind or "", re.I)
        found = m[1] if m else (d[1].decode("ascii") if (d := _CHARSET.search(raw[:2048])) else "utf-8")
        try:
            return raw.decode(found, "replace")
        except LookupError:
            return raw.decode("utf-8", "replace")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = b.schema.names
            out = [text(x.as_py(), k) for x, k in zip(b.column(names.index(body)), b.column(names.index(content_type)).to_pylist(), strict=True)]
            yield b.append_column("html", pa.array(out, pa.string()))

    return df.mapInArrow(run, schema)


def robots_allowed(urls: DataFrame, robots: DataFrame, agent: str = "*") -> DataFrame:
    """``(url, allowed)`` by each host's robots text (host, text); hosts without one allow all."""
    from auditloom.functions.urls import netloc

    rows = urls.select("url", netloc(F.col("url")).alias("host")).join(robots.select("host", "text").dropDuplicates(["host"]), "host", "left").select("url", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parsed: dict[str, RobotFileParser] = {}
        for b in batches:
            out = []
            for url, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if text is None:
                    out.append(True)
                    continue
                if text not in parsed:
                    if len(parsed) > 1000:
                        parsed.clear()
                    p = parsed[text] = RobotFileParser()
                    p.parse(text.splitlines())
                out.append(parsed[text].can_fetch(agent, url))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.bool_())], ["url", "allowed"])

    return rows.mapInArrow(run, "url string, allowed boolean")


def robots_facts(robots: DataFrame) -> DataFrame:
    """``(host, sitemaps, crawl_delay)`` of robots texts."""
    lines = F.regexp_extract_all("text", F.lit(r"(?im)^\s*sitemap\s*:\s*(\S+)"), F.lit(1))
    return robots.select("host", lines.alias("sitemaps"), F.try_to_number(F.regexp_extract("text", r"(?im)^\s*crawl-delay\s*:\s*([\d.]+)", 1), F.lit("999999.999")).cast("double").alias("crawl_delay"))


def sitemap_entries(sitemaps: DataFrame) -> DataFrame:
    """``(sitemap, loc, is_index)`` of sitemap documents (sitemap, xml), with or without a name space."""
    xml = F.regexp_replace("xml", r"(?s)<!--.*?-->", "")
    locs = F.regexp_extract_all(xml, F.lit(r"(?s)<(?:\w+:)?loc\s*>\s*(.*?)\s*</(?:\w+:)?loc\s*>"), F.lit(1))
    plain = lambda c: F.replace(F.replace(F.replace(F.replace(c, F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")), F.lit("&quot;"), F.lit('"')), F.lit("&amp;"), F.lit("&"))
    return sitemaps.select("sitemap", F.explode(locs).alias("loc"), xml.rlike(r"<(?:\w+:)?sitemapindex[\s>]").alias("is_index")).withColumn("loc", plain(F.col("loc")))


def serp_items(answers: DataFrame, most: int = 100) -> DataFrame:
    """``(keyword, position, url, domain, title)``: organic results of landed SERP JSON (keyword, json)."""
    from auditloom.functions.urls import domain_of

    kind = "struct<items:array<struct<type:string,rank_group:int,url:string,title:string>>>"
    item = F.explode(F.filter(F.from_json("json", kind)["items"], lambda i: (i["type"] == "organic") & (i["rank_group"] <= most)))
    return answers.select("keyword", item.alias("i")).select("keyword", F.col("i.rank_group").alias("position"), "i.url", domain_of(F.col("i.url")).alias("domain"), "i.title")


def keyword_metrics(answers: DataFrame) -> DataFrame:
    """``(keyword, search_volume, cpc, competition)`` of landed metric JSON (json: an array of objects)."""
    kind = "array<struct<keyword:string,search_volume:int,cpc:double,competition:string>>"
    return answers.select(F.inline(F.from_json("json", kind)))


def page_speed(answers: DataFrame) -> DataFrame:
    """``(url, data_kind, lcp, inp, cls, tbt)`` of landed page-speed JSON: field percentiles over lab values."""
    n = "struct<numericValue:double>"
    kind = (
        f"struct<lighthouseResult:struct<audits:struct<`largest-contentful-paint`:{n},`cumulative-layout-shift`:{n},`total-blocking-time`:{n}>>,"
        "loadingExperience:struct<origin_fallback:boolean,metrics:struct<LARGEST_CONTENTFUL_PAINT_MS:struct<percentile:double>,INTERACTION_TO_NEXT_PAINT:struct<percentile:double>,CUMULATIVE_LAYOUT_SHIFT_SCORE:struct<percentile:double>>>>"
    )
    j = F.from_json("json", kind)
    lab, field = j["lighthouseResult"]["audits"], j["loadingExperience"]["metrics"]
    own = ~F.coalesce(j["loadingExperience"]["origin_fallback"], F.lit(False))
    real = lambda c: F.when(own, field[c]["percentile"])
    has = own & field.isNotNull() & F.coalesce(real("LARGEST_CONTENTFUL_PAINT_MS"), real("INTERACTION_TO_NEXT_PAINT"), real("CUMULATIVE_LAYOUT_SHIFT_SCORE")).isNotNull()
    return answers.select(
        "url", F.when(has, "field").otherwise("lab").alias("data_kind"), F.coalesce(real("LARGEST_CONTENTFUL_PAINT_MS"), lab["largest-contentful-paint"]["numericValue"]).alias("lcp"),
        real("INTERACTION_TO_NEXT_PAINT").alias("inp"), F.coalesce(real("CUMULATIVE_LAYOUT_SHIFT_SCORE") / 100, lab["cumulative-layout-shift"]["numericValue"]).alias("cls"), lab["total-blocking-time"]["numericValue"].alias("tbt"),
    )


def first_answer(sources: list[DataFrame], key: str) -> DataFrame:
    """One row a key from the first of the sources without an error; the errors before it joined as ``reasons``."""
    every = None
    for i, s in enumerate(sources):
        one = s.withColumn("_o", F.lit(i))
        every = one if every is None else every.unionByName(one, allowMissingColumns=True)
    rest = [c for c in every.columns if c not in (key, "_o")]
    good = F.min(F.when(F.col("error").isNull(), F.struct("_o", *rest)))
    bad = F.concat_ws("; ", F.transform(F.array_sort(F.collect_list(F.when(F.col("error").isNotNull(), F.struct("_o", "error")))), lambda x: x["error"]))
    return every.groupBy(key).agg(good.alias("g"), bad.alias("reasons")).select(key, *[F.col(f"g.{c}").alias(c) for c in rest], "reasons")


def dry_run_serp(spark: SparkSession, keywords: list[str], results: int = 10) -> DataFrame:
    """Made-up results that depend on nothing but the keyword, for tests and previews."""
    k = spark.createDataFrame([(x,) for x in keywords], "keyword string")
    row = k.select("keyword", F.explode(F.sequence(F.lit(1), F.lit(results))).alias("position"))
    seed = F.conv(F.substring(F.sha2(F.concat_ws("|", "keyword", F.col("position").cast("string")), 256), 1, 8), 16, 10).cast("long")
    domain = F.concat(F.lit("site"), (seed % 500).cast("string"), F.lit(".example"))
    return row.select("keyword", "position", F.concat(F.lit("https://"), domain, F.lit("/p"), (seed % 97).cast("string")).alias("url"), domain.alias("domain"))


def missing_sessions(found: DataFrame, stored: DataFrame) -> DataFrame:
    """Sessions that aren't stored yet, by session_id: importing twice adds nothing."""
    return found.join(stored.select("session_id"), "session_id", "left_anti").dropDuplicates(["session_id"])
