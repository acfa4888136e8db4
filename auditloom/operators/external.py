"""Joins with data from outside the crawl: ranks, gaps, search performance, backlinks, brand mentions.

Inputs are landed tables; fetching them is not part of the library.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from auditloom.functions import urls as U
from auditloom.functions.texts import stem
from auditloom.operators.checks import explode_issues, gather, issue
from auditloom.runtime import broadcast_if_small

# ------------------------------------------------------------------ rank tracking


def result_positions(serp: DataFrame, domains: DataFrame) -> DataFrame:
    """``(keyword, owner, position, url)``: the best result of each owner's domain or its subdomains.

    ``serp``: keyword, position, url, domain; ``domains``: owner, domain. A result's domain is expanded
    into its suffixes, so the match is a join on equality.
    """
    labels = F.split("domain", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels) - i + 1), "."))
    rows = serp.where("domain is not null").select("keyword", "position", "url", F.explode(suffixes).alias("domain"))
    hits = rows.join(broadcast_if_small(domains.select("owner", F.lower("domain").alias("domain")).distinct()), "domain")
    return hits.groupBy("keyword", "owner").agg(F.min(F.struct("position", "url")).alias("x")).select("keyword", "owner", "x.position", "x.url")


def rank_overview(checks: DataFrame, key: str = "keyword_id") -> DataFrame:
    """``(key, position, previous, change)``: the latest real check, the one before, and places won.

    ``checks``: id (in time order), key, status, position; skipped ones don't count. A null position is
    not ranked; the change is null if either is.
    """
    last = Window.partitionBy(key).orderBy(F.desc("id"))
    real = checks.where("status <> 'skipped'").withColumn("n", F.row_number().over(last)).where("n <= 2")
    out = real.groupBy(key).agg(F.max(F.when(F.col("n") == 1, F.col("position"))).alias("position"), F.max(F.when(F.col("n") == 2, F.col("position"))).alias("previous"))
    return out.withColumn("change", F.col("previous") - F.col("position"))


def with_previous(checks: DataFrame, key: str = "keyword_id") -> DataFrame:
    """Each check with ``previous_id`` and ``previous_position`` of the last real check before it."""
    before = Window.partitionBy(key).orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    prev = F.last(F.when(F.col("status") != "skipped", F.struct("id", "position")), ignorenulls=True).over(before)
    return checks.withColumn("_p", prev).withColumn("previous_id", F.col("_p.id")).withColumn("previous_position", F.col("_p.position")).drop("_p")


def rank_alerts(checks: DataFrame, drop_threshold: int = 3, top10: bool = True, gain_threshold: int | None = None, key: str = "keyword_id") -> DataFrame:
    """``(id, key, kind, old_position, new_position)``: lost, drop, left_top10 and gain; several may fire at once."""
    c = with_previous(checks, key).where("status <> 'skipped' and previous_id is not null")
    old, new = F.col("previous_position"), F.col("position")
    kinds = [
        F.when(old.isNotNull() & new.isNull(), "lost"),
        F.when(new - old >= drop_threshold, "drop"),
        F.when(F.lit(top10) & (old <= 10) & (new.isNull() | (new > 10)), "left_top10"),
    ]
    if gain_threshold is not None:
        kinds.append(F.when(old - new >= gain_threshold, "gain"))
    return c.select("id", key, F.explode(F.array_compact(F.array(*kinds))).alias("kind"), old.alias("old_position"), new.alias("new_position"))


def alert_digest(alerts: DataFrame, key: str = "keyword_id") -> DataFrame:
    """One row a day's batch: distinct keywords and ordered lines; ``alerts`` has phrase, kind and positions."""
    place = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("not ranked"))
    line = F.concat_ws(" ", "phrase", "kind", place("old_position"), F.lit("to"), place("new_position"))
    return alerts.agg(F.count_distinct(key).alias("keywords"), F.concat_ws("\n", F.array_sort(F.collect_set(line))).alias("lines"))


def rank_target_hits(targets: DataFrame, serp: DataFrame, most: int = 10) -> DataFrame:
    """``(keyword, url, position)``: the page itself among the first ``most`` results, null if not there."""
    t = targets.select("keyword", "url", U.rank_key(F.col("url")).alias("k"))
    s = serp.where(F.col("position") <= most).groupBy("keyword", U.rank_key(F.col("url")).alias("k")).agg(F.min("position").alias("position"))
    return t.join(s, ["keyword", "k"], "left").select("keyword", "url", "position")


# ------------------------------------------------------------------ gaps


def opportunity(volume: Column, difficulty: Column) -> Column:
    """Volume weighed by ease, to one decimal; an unknown difficulty is 50."""
    return F.round(volume * (100 - F.coalesce(difficulty, F.lit(50))) / 100, 1)


def content_gap(ranked: DataFrame, me: str, rivals: list[str], mine_within: int = 100, rivals_within: int = 20) -> DataFrame:
    """Keywords that rivals rank for within ``rivals_within`` places and ``me`` not within ``mine_within``.

    ``ranked``: domain, keyword, position, search_volume, difficulty. One row a keyword: rivals' best
    positions as a map, volume and difficulty of the first rival (in the given order) that has them, best
    position and opportunity. A keyword listed twice for a domain counts with its best position.
    """
    order = F.array_position(F.array(*[F.lit(r) for r in rivals]), F.col("domain")) if rivals else F.lit(0)
    mine = ranked.where((F.col("domain") == me) & (F.col("position") <= mine_within)).select("keyword")
    theirs = ranked.where(F.col("domain").isin(rivals) & (F.col("position") <= rivals_within)).join(mine, "keyword", "left_anti")
    best = theirs.groupBy("keyword", "domain").agg(
        F.min("position").alias("position"), F.min("search_volume").alias("search_volume"), F.min("difficulty").alias("difficulty")
    )
    first = lambda c: F.min(F.when(F.col(c).isNotNull(), F.struct(order.alias("o"), F.col(c).alias("v"))))["v"]
    out = best.groupBy("keyword").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("domain", "position")))).alias("positions"), F.min("position").alias("best_position"),
        first("search_volume").alias("search_volume"), first("difficulty").alias("difficulty"),
    )
    return out.withColumn("opportunity", opportunity(F.coalesce("search_volume", F.lit(0)), F.col("difficulty")))


def gap_table(gap: DataFrame, rivals: list[str]) -> DataFrame:
    """The gap with one column for each rival, for export."""
    return gap.select("keyword", "search_volume", "difficulty", "opportunity", *[F.try_element_at("positions", F.lit(r)).alias(r) for r in rivals])


def link_gap(links: DataFrame, me: str, rivals: list[str]) -> DataFrame:
    """``(source, rivals, linked)``: domains that link to rivals (with counts) and not to ``me``.

    ``links``: source, target.
    """
    mine = links.where(F.col("target") == me).select("source")
    n = links.where(F.col("target").isin(rivals)).join(mine, "source", "left_anti").groupBy("source", "target").agg(F.count("*").cast("int").alias("n"))
    return n.groupBy("source").agg(F.count("*").alias("rivals"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("target", "n")))).alias("linked"))


def keyword_table(ideas: DataFrame, metrics: DataFrame, difficulty: DataFrame) -> DataFrame:
    """Ideas (keyword, source, ord) once each, first source first, with volume and difficulty; largest volume first."""
    once = ideas.groupBy("keyword").agg(F.min(F.struct("ord", "source")).alias("x")).select("keyword", "x.source")
    return (
        once.join(metrics.dropDuplicates(["keyword"]), "keyword", "left").join(difficulty.dropDuplicates(["keyword"]), "keyword", "left")
        .withColumn("traffic_estimate", F.bround(F.col("search_volume") * 0.28).cast("long")).orderBy(F.desc_nulls_last("search_volume"), "keyword")
    )


def phrase_gap(own: DataFrame, others: DataFrame, least: int = 2) -> DataFrame:
    """Phrases on at least ``least`` competitor pages and not on one's own; ``own``: phrase, ``others``: page, phrase."""
    return (
        others.distinct().join(own.select("phrase").distinct(), "phrase", "left_anti").groupBy("phrase").agg(F.count("*").alias("pages"))
        .where(F.col("pages") >= least)
    )


# ------------------------------------------------------------------ search performance


def search_kpis(daily: DataFrame, *keys: str) -> DataFrame:
    """Clicks, impressions, click rate (4 decimals) and position weighted by impressions (2); null without impressions."""
    return daily.groupBy(*keys).agg(
        F.sum("clicks").alias("clicks"), F.sum("impressions").alias("impressions"),
        F.round(F.try_divide(F.sum("clicks"), F.sum("impressions")), 4).alias("ctr"),
        F.round(F.try_divide(F.sum(F.col("position") * F.col("impressions")), F.sum("impressions")), 2).alias("position"),
    )


def period_kpis(daily: DataFrame, key: str, rows: int = 28) -> DataFrame:
    """KPIs of the latest ``rows`` rows of each key and of the same number before, by row and not by date."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("date")))
    parts = daily.withColumn("n", n).where(F.col("n") <= 2 * rows).withColumn("period", F.when(F.col("n") <= rows, "current").otherwise("previous"))
    return search_kpis(parts, key, "period")


def search_join(search: DataFrame, crawled: DataFrame, inspected: DataFrame | None = None) -> dict[str, DataFrame]:
    """Pages of the search data met with crawled ones by normalised url: ``pages`` and ``not_crawled``.

    ``pages`` are crawled pages with clicks and impressions (and verdict, if inspections are given);
    ``not_crawled`` are urls with impressions that the crawl doesn't have.
    """
    key = U.normalize_url(F.col("url"))
    s = search.withColumn("k", key).groupBy("k").agg(F.sum("clicks").alias("clicks"), F.sum("impressions").alias("impressions"))
    c = crawled.withColumn("k", key)
    pages = c.join(s, "k")
    if inspected is not None:
        pages = pages.join(inspected.select(key.alias("k"), "verdict").dropDuplicates(["k"]), "k", "left")
    return {"pages": pages.drop("k"), "not_crawled": s.where("impressions > 0").join(c.select("k"), "k", "left_anti").withColumnRenamed("k", "url")}


def merge_daily(stored: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """Stored rows replaced by fresh ones of the same keys, the rest kept: an upsert as one table."""
    return stored.join(fresh.select(*keys), keys, "left_anti").unionByName(fresh)


def index_issues(inspections: DataFrame) -> DataFrame:
    """``(url, severity, code, message)``: pages that aren't indexed (not by their own noindex) and canonical mismatches.

    ``inspections``: url, verdict, coverage (may be null), google_canonical, user_canonical, robots (header and meta text).
    """
    c = F.col
    meant = F.lower(F.coalesce("robots", F.lit(""))).contains("noindex")
    other = (c("google_canonical") != "") & (c("user_canonical") != "") & (U.normalize_url(c("google_canonical")) != U.normalize_url(c("user_canonical")))
    return explode_issues(inspections, ["url"], gather(
        issue(c("verdict").isin("FAIL", "NEUTRAL") & ~meant, "warning", "GSC_NOT_INDEXED", F.concat(F.lit("Not indexed by Google: "), F.coalesce(F.nullif("coverage", F.lit("")), "verdict"))),
        issue(other, "info", "GSC_CANONICAL_MISMATCH", F.concat(F.lit("Google chose "), c("google_canonical"), F.lit(" over your canonical "), c("user_canonical"))),
    ))


# ------------------------------------------------------------------ backlinks


def broken_backlinks(links: DataFrame, pages: DataFrame) -> DataFrame:
    """``(url, status, links, hosts)`` of crawled pages with status from 400 that others link to.

    ``links``: url_from, url_to; ``pages``: url, status. Both meet by normalised url.
    """
    t = links.select(U.normalize_url(F.col("url_to")).alias("k"), U.hostname(F.col("url_from")).alias("host"))
    hosts = t.groupBy("k").agg(F.count("*").alias("links"), F.count_distinct("host").alias("hosts"))
    bad = pages.where("status >= 400").select("url", "status", U.normalize_url(F.col("url")).alias("k")).dropDuplicates(["url"])
    return bad.join(hosts, "k").select("url", "status", "links", "hosts")


def backlink_issues(links: DataFrame, pages: DataFrame) -> DataFrame:
    """``(url, severity, code, message)`` for each row of ``broken_backlinks``."""
    count = lambda n, word: F.concat(n.cast("string"), F.lit(" " + word), F.when(n == 1, "").otherwise("s"))
    text = F.concat(count(F.col("links"), "backlink"), F.lit(" from "), count(F.col("hosts"), "domain"), F.lit(" point to this broken page. Redirect it to keep their value."))
    return explode_issues(broken_backlinks(links, pages), ["url"], gather(issue(F.lit(True), "warning", "BACKLINK_TO_BROKEN_PAGE", text)))


def new_history(stored: DataFrame, fetched: DataFrame) -> DataFrame:
    """Fetched months that aren't stored yet."""
    return fetched.join(stored.select("project_id", "period"), ["project_id", "period"], "left_anti")


# ------------------------------------------------------------------ brand mentions


#: Brands and terms that one call searches for; more raise an error.
MOST_BRANDS = 10_000


def brand_terms(brands: DataFrame) -> DataFrame:
    """``(owner, ord, term)`` of brands (owner, ord, terms, and optionally domain): trimmed terms, the domain with and without ``www.``."""
    own = F.filter("terms", lambda t: F.trim(t) != "")
    if "domain" in brands.columns:
        has = F.coalesce("domain", F.lit("")) != ""
        own = F.concat(F.coalesce(own, F.expr("cast(array() as array<string>)")), F.when(has, F.array(F.col("domain"), F.concat(F.lit("www."), "domain"))).otherwise(F.expr("cast(array() as array<string>)")))
    return brands.select("owner", "ord", F.explode(F.array_distinct(F.transform(own, lambda t: F.trim(t)))).alias("term"))


def brand_mentions(answers: DataFrame, brands: DataFrame) -> DataFrame:
    """``(answer_id, owner, first_index, mentions, rank)``: owners named in each answer, ranked by first mention.

    ``answers``: answer_id, text; ``brands``: owner, ord, terms (array), optionally domain. Terms match whole words whatever
    the case (hyphens belong to words); of overlapping terms the longest counts. Ties keep brand order.
    """
    escaped = F.regexp_replace("term", r"([\\\[\](){}.*+?^$|\-])", r"\\$1")
    each = brand_terms(brands).groupBy("owner", "ord").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.length("term")).alias("n"), escaped.alias("t")))), lambda x: x["t"]), "|").alias("alternatives"))
    listed = [(r.owner, r.ord, rf"(?iU)(?<![\w-])(?:{r.alternatives})(?![\w-])") for r in each.orderBy("ord").limit(MOST_BRANDS + 1).collect()]
    if len(listed) > MOST_BRANDS:
        raise ValueError(f"more than {MOST_BRANDS} brands")
    # Every answer is searched for every brand of the stated list, which goes along as a constant.
    brand = F.array(*[F.struct(F.lit(o).alias("owner"), F.lit(n).alias("ord"), F.lit(p).alias("pattern")) for o, n, p in listed])
    met = answers.where("text is not null").select("answer_id", "text", F.explode(brand if listed else F.expr("cast(array() as array<struct<owner:string,ord:int,pattern:string>>)")).alias("b"))
    found = met.select("answer_id", "b.owner", "b.ord", F.expr("regexp_instr(text, b.pattern)").alias("first_index"), F.expr("regexp_count(text, b.pattern)").alias("mentions")).where("first_index > 0")
    order = Window.partitionBy("answer_id").orderBy("first_index", "ord")
    return found.withColumn("rank", F.row_number().over(order)).select("answer_id", "owner", "first_index", "mentions", "rank")


def highlights(answers: DataFrame, brands: DataFrame) -> DataFrame:
    """``(answer_id, n, start, stop, owner)``: marks of all brands in each answer that don't overlap, from the left; offsets from 0, the end left out."""
    spec = StructType([*[answers.schema[c] for c in ("answer_id",)], *StructType.fromDDL("n int, start int, stop int, owner string").fields])
    listed = [(r.owner, r.ord, r.term) for r in brand_terms(brands).orderBy("ord", F.desc(F.length("term")), "term").limit(MOST_BRANDS + 1).collect()]
    if len(listed) > MOST_BRANDS:
        raise ValueError(f"more than {MOST_BRANDS} terms")
    order = {o: k for k, (o, _) in enumerate(sorted({(o, n) for o, n, _ in listed}, key=lambda x: x[1]))}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forms = [(o, re.compile(r"(?<![\w-])" + re.escape(t) + r"(?![\w-])", re.I)) for o, _, t in listed]
        for batch in batches:
            out = []
            for i, text in enumerate(batch.column(1).to_pylist()):
                marks = sorted({(m.start(), -m.end(), order[o], o) for o, form in forms for m in form.finditer(text or "")})
                upto = n = 0
                for start, stop, _, owner in marks:
                    if start >= upto:
                        n, upto = n + 1, -stop
                        out.append((i, n, start, upto, owner))
            cols = list(zip(*out, strict=True)) if out else [()] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(cols[0], pa.int64())), *[pa.array(c, pa.int32()) for c in cols[1:4]], pa.array(cols[4], pa.string())], ["answer_id", "n", "start", "stop", "owner"])

    return answers.select("answer_id", "text").mapInArrow(run, spec)


def mention_rates(answers: DataFrame, mentions: DataFrame, me: str) -> DataFrame:
    """Per run, and per run and provider (null: all): answers, mention rate, cited rate (3 decimals), mean rank (2).

    ``answers``: answer_id, run_id, provider, error, cited (own domain cited). Errors are left out.
    """
    own = mentions.where(F.col("owner") == me).select("answer_id", "rank")
    a = answers.where("error is null").join(own, "answer_id", "left")
    cube = a.select("run_id", F.explode(F.array(F.lit(None).cast("string"), F.col("provider"))).alias("provider"), "rank", "cited")
    return cube.groupBy("run_id", "provider").agg(
        F.count("*").alias("answers"), F.round(F.avg(F.col("rank").isNotNull().cast("int")), 3).alias("mention_rate"),
        F.round(F.avg(F.coalesce("cited", F.lit(False)).cast("int")), 3).alias("cited_rate"), F.round(F.avg("rank"), 2).alias("avg_position"),
    )


def share_of_voice(mentions: DataFrame) -> DataFrame:
    """``(owner, answers, share)``: each brand's part of all brand mentions, counted once an answer."""
    n = mentions.select("answer_id", "owner").distinct().groupBy("owner").agg(F.count("*").alias("answers"))
    total = n.agg(F.sum("answers").alias("total"))
    return n.join(F.broadcast(total)).select("owner", "answers", F.round(F.col("answers") / F.col("total"), 3).alias("share"))


# Hosts (with all below them) and a part of addresses that only lead on to a source.
REDIRECT_HOSTS = ("vertexaisearch.cloud.google.com", "googleusercontent.com")
REDIRECT_PART = "grounding-api-redirect"


def citation_domain(url: Column, title: Column) -> Column:
    """The domain a citation counts for: its host, or behind a redirect the domain that is its title; else null."""
    host = U.hostname(url)
    leads_on = url.contains(REDIRECT_PART)
    for h in REDIRECT_HOSTS:
        leads_on = leads_on | (host == h) | host.endswith("." + h)
    named = F.lower(F.trim(title))
    own = F.when(leads_on, F.when(named.rlike(r"^[a-z0-9-]+(\.[a-z0-9-]+)+$"), named)).otherwise(host)
    return F.nullif(F.regexp_replace(own, r"^www\.", ""), F.lit(""))


def answer_citations(citations: DataFrame, most: int = 20) -> DataFrame:
    """``(answer_id, ord, domain)``: the domains of each answer once each, by first appearance, the first ``most``.

    ``citations``: answer_id, ord, url, title.
    """
    each = citations.select("answer_id", "ord", citation_domain(F.col("url"), F.col("title")).alias("domain")).where("domain is not null")
    first = each.groupBy("answer_id", "domain").agg(F.min("ord").alias("o"))
    rank = F.row_number().over(Window.partitionBy("answer_id").orderBy("o", "domain"))
    return first.withColumn("ord", rank).where(F.col("ord") <= most).select("answer_id", "ord", "domain")


def own_citation(citations: DataFrame, domain: str) -> DataFrame:
    """``(answer_id, cited)`` of all answers with citations: whether one is of ``domain`` or below it."""
    d = citation_domain(F.col("url"), F.col("title"))
    return citations.groupBy("answer_id").agg(F.max(F.coalesce((d == domain) | d.endswith("." + domain), F.lit(False))).alias("cited"))


def cited_domains(citations: DataFrame, top: int = 10) -> DataFrame:
    """The domains cited in most answers, a report of ``top`` rows; ``citations``: answer_id, url, title."""
    each = citations.select("answer_id", citation_domain(F.col("url"), F.col("title")).alias("domain")).where("domain is not null").distinct()
    return each.groupBy("domain").agg(F.count("*").alias("answers")).orderBy(F.desc("answers"), "domain").limit(top)


# ------------------------------------------------------------------ vitals, rendering, accessibility

# Limits of good and poor.
VITALS = {"lcp": (2500.0, 4000.0), "inp": (200.0, 500.0), "cls": (0.1, 0.25), "tbt": (200.0, 600.0)}
RATED = {"field": ("lcp", "inp", "cls"), "lab": ("lcp", "tbt", "cls")}


def rate_metric(value: Column, good: float, poor: float) -> Column:
    """0 good, 1 needs improvement, 2 poor, null unmeasured."""
    return F.when(value <= good, 0).when(value <= poor, 1).when(value > poor, 2)


def _shown(metric: str, value: Column) -> Column:
    if metric == "cls":
        return F.format_string("%.2f", value)
    return F.format_string("%.1f s", value / 1000) if metric == "lcp" else F.concat(F.bround(value).cast("long").cast("string"), F.lit(" ms"))


def vitals_ratings(vitals: DataFrame) -> DataFrame:
    """``(url, rating, issues)``: the worst of the rated metrics and one issue for each that isn't good.

    ``vitals``: url, data_kind (field or lab), lcp, inp, cls, tbt. Field data rate lcp, inp, cls; lab data lcp, tbt, cls.
    """
    rated = {
        m: F.when(F.when(F.col("data_kind") == "field", m in RATED["field"]).otherwise(m in RATED["lab"]), rate_metric(F.col(m), *VITALS[m])) for m in VITALS
    }
    worst = F.array_max(F.array(*rated.values()))
    said = lambda m, word, limit: F.concat(F.lit(m.upper() + " "), _shown(m, F.col(m)), F.lit(" ("), "data_kind", F.lit(f") — {word}, over "), _shown(m, F.lit(limit)))
    issues = gather(*[
        F.coalesce(issue(rated[m] == 2, "warning", f"CWV_{m.upper()}_POOR", said(m, "poor", VITALS[m][1])), issue(rated[m] == 1, "info", f"CWV_{m.upper()}_NEEDS_IMPROVEMENT", said(m, "needs improvement", VITALS[m][0])))
        for m in ("lcp", "inp", "tbt", "cls")
    ])
    return vitals.select("url", F.when(worst == 0, "good").when(worst == 1, "needs_improvement").when(worst == 2, "poor").alias("rating"), issues.alias("issues"))


# Fields compared before and after scripts, in the order of their issues, with severity, code and name.
COMPARED = {
    "title": ("warning", "JS_TITLE_CHANGED", "Title"),
    "meta_description": ("info", "JS_META_DESCRIPTION_CHANGED", "Meta description"),
    "canonical": ("warning", "JS_CANONICAL_CHANGED", "Canonical"),
    "meta_robots": ("warning", "JS_ROBOTS_CHANGED", "Meta robots"),
    "h1": ("info", "JS_H1_CHANGED", "H1"),
}


def render_comparison(raw: DataFrame, rendered: DataFrame, most: int = 50) -> DataFrame:
    """``(url, changes, js_only_links, js_only_links_count, raw_words, rendered_words, issues)`` of pages before and after scripts ran.

    Both inputs have url, the fields of ``COMPARED``, word_count (null is 0) and links (array of addresses).
    Values differ if they do so trimmed. The ``most`` first links are listed, all are counted.
    """
    a, b = (df.select("url", F.struct(*COMPARED).alias(n), F.coalesce("word_count", F.lit(0)).alias(f"{n}_words"), F.array_distinct("links").alias(f"{n}_links")) for df, n in ((raw, "raw"), (rendered, "rendered")))
    bare = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)^\s+|\s+$", "")
    quote = lambda c: F.when(bare(c) == "", "(none)").otherwise(F.concat(F.lit("'"), F.substring(bare(c), 1, 80), F.lit("'")))
    was, now = (lambda f: F.col(f"raw.{f}")), (lambda f: F.col(f"rendered.{f}"))
    differs = {f: bare(was(f)) != bare(now(f)) for f in COMPARED}
    changes = F.map_from_entries(gather(*[F.when(differs[f], F.struct(F.lit(f), F.struct(was(f).alias("raw"), now(f).alias("rendered")))) for f in COMPARED]))
    extra = F.array_sort(F.array_except("rendered_links", "raw_links"))
    before, after, n = F.col("raw_words"), F.col("rendered_words"), F.coalesce(F.size(extra), F.lit(0))
    text = lambda *x: F.concat(*[F.lit(y) if isinstance(y, str) else y.cast("string") for y in x])
    issues = gather(
        issue((after >= 2 * before) & (after - before >= 200), "warning", "JS_CONTENT_DEPENDENT", text(before, " words in raw HTML, ", after, " after JavaScript")),
        *[issue(differs[f], severity, code, text(f"{name} changed by JavaScript: ", quote(was(f)), " → ", quote(now(f)))) for f, (severity, code, name) in COMPARED.items()],
        issue(n > 0, "info", "JS_ONLY_LINKS", text(n, " internal ", F.when(n == 1, "link appears").otherwise("links appear"), " only after JavaScript")),
    )
    return a.join(b, "url").select("url", changes.alias("changes"), F.slice(extra, 1, most).alias("js_only_links"), n.alias("js_only_links_count"), "raw_words", "rendered_words", issues.alias("issues"))


# Points lost for violations (an unknown impact is minor), and rules that page checks report already.
PENALTY = {"critical": 10, "serious": 7, "moderate": 3, "minor": 1}
REPORTED = ["image-alt", "label", "html-has-lang"]


def accessibility_summary(results: DataFrame) -> DataFrame:
    """``(url, score, counts, issues)`` from violations, an array of structs with id, impact, nodes_count and optionally help.

    Violations come by impact and id. Texts are cut as a page may have made them: ids to 100 characters, help to 300.
    """
    has_help = "help" in results.schema["violations"].dataType.elementType.fieldNames()
    weight = F.create_map(*[F.lit(x) for k, n in PENALTY.items() for x in (k, n)])
    v = F.array_sort(F.transform(F.coalesce("violations", F.array().cast(results.schema["violations"].dataType)), lambda x: F.struct(
        F.coalesce(F.array_position(F.array(*[F.lit(k) for k in PENALTY]), x["impact"]), F.lit(0)).alias("p"), F.substring(x["id"], 1, 100).alias("id"),
        F.substring(F.coalesce(F.nullif(x["help"], F.lit("")), x["id"]) if has_help else x["id"], 1, 300).alias("help"), F.coalesce(x["nodes_count"], F.lit(0)).cast("long").alias("n"),
    )))
    v = F.array_sort(F.transform(v, lambda x: x.withField("p", F.when(x["p"] == 0, F.lit(len(PENALTY)).cast("long")).otherwise(x["p"].cast("long")))))
    name = lambda x: F.element_at(F.array(*[F.lit(k) for k in PENALTY]), x["p"].cast("int"))
    of = lambda k: F.size(F.filter("v", lambda x: name(x) == k))
    counts = F.map_from_entries(F.array(*[F.struct(F.lit(k), of(k)) for k in PENALTY]))
    issues = F.transform(F.filter("v", lambda x: ~x["id"].isin(REPORTED)), lambda x: F.struct(
        F.when(x["p"] <= 2, "warning").otherwise("info").alias("severity"), F.concat(F.lit("A11Y_"), F.upper(F.replace(x["id"], F.lit("-"), F.lit("_")))).alias("code"),
        F.concat(x["help"], F.lit(" ("), x["n"].cast("string"), F.lit(" element"), F.when(x["n"] == 1, "").otherwise("s"), F.lit(", "), name(x), F.lit(")")).alias("message"), F.lit("axe").alias("source"),
    ))
    lost = F.aggregate("v", F.lit(0), lambda s, x: s + F.element_at(weight, name(x)))
    return results.select("url", v.alias("v")).select("url", F.greatest(F.lit(0), 100 - lost).alias("score"), counts.alias("counts"), issues.alias("issues"))


# ------------------------------------------------------------------ content explorer

# Words that say nothing in subheadings.
HEADING_STOP_WORDS = (
    "the and for with you your are how what why when where who which can does from that this these those into about our all "
    "best top not but has have will more most its their them they"
).split()


def content_summary(pages: DataFrame, topic: str, top: int = 15) -> dict[str, DataFrame]:
    """Medians of words and referring domains, and in how many fetched pages each schema type and subheading word stands.

    ``pages``: url, word_count (null: not fetched), ref_domains, schema_types (array), h2 (array). Words of three
    letters or more count; those of the topic (also with or without a final s) and stop words are left out.
    """
    fetched = pages.where("word_count is not null")
    medians = pages.agg(F.bround(F.median("word_count")).cast("long").alias("median_words"), F.bround(F.median("ref_domains")).cast("long").alias("median_ref_domains"), F.count("*").alias("pages"))
    types = fetched.select("url", F.explode(F.array_distinct("schema_types")).alias("type")).groupBy("type").agg(F.count("*").alias("pages")).orderBy(F.desc("pages"), "type")
    own = [w[:-1] if len(w) > 3 and w.endswith("s") else w for w in re.findall(r"[a-z]+", topic.lower())]
    words = fetched.select("url", F.explode(F.array_distinct(F.regexp_extract_all(F.lower(F.array_join("h2", "\n")), F.lit(r"[a-z]{3,}"), F.lit(0)))).alias("term"))
    kept = words.where(~F.col("term").isin(HEADING_STOP_WORDS) & ~stem(F.col("term")).isin(own))
    return {"medians": medians, "types": types, "terms": kept.groupBy("term").agg(F.count("*").alias("pages")).orderBy(F.desc("pages"), "term").limit(top)}
