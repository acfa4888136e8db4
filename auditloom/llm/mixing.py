"""Mixing sources to target weights by iterative proportional fitting.

Token weights of the cells (source, language, topic) are raked in turn to the source targets and to the
languages' and topics' shares of all text, never above what the allowed repeats of a cell give; the last
step of each round meets the sources. Each document is then used as often as its cell's weight asks,
the fraction by chance from a hash; a cut on the chance, found from sums per source, brings each source's
tokens to its target within about one document.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.llm.tokens import with_tokens
from auditloom.runtime import cut_lineage

#: Cells that raking takes, its rounds, and the parts of a cut's search.
MAX_CELLS, ROUNDS, PARTS = 1_000_000, 60, 1024


def _raise_to(weights: np.ndarray, caps: np.ndarray, group: np.ndarray, target: np.ndarray) -> np.ndarray:
    """``weights`` scaled so that each group sums to its target, or to its caps where those are lower."""
    out = weights.copy()
    for _ in range(20):
        free = out < caps * (1 - 1e-12)
        held = np.bincount(group, np.where(free, 0, out), len(target))
        loose = np.bincount(group, np.where(free, out, 0), len(target))
        factor = np.divide(np.maximum(target - held, 0), loose, out=np.ones_like(target), where=loose > 0)
        out = np.where(free, np.minimum(out * factor[group], caps), out)
        total = np.bincount(group, out, len(target))
        over = total > target * (1 + 1e-12)
        if over.any():  # capped cells alone exceed the target: all of the group shrink
            out = np.where(over[group], out * (target / np.maximum(total, 1e-300))[group], out)
        if not ((total < target * (1 - 1e-9)) & (np.bincount(group, np.where(out < caps * (1 - 1e-12), out, 0), len(target)) > 0)).any():
            break
    return out


def rake(tokens: np.ndarray, caps: np.ndarray, margins: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Weights of cells fitted to ``margins`` (group of each cell, target of each group), the first one exactly.

    ``caps`` bound each cell. Targets that can't hold together are met as nearly as the last step allows.
    """
    w = np.minimum(tokens.astype(float) * (margins[0][1].sum() / max(tokens.sum(), 1)), caps)
    w = np.maximum(w, 1e-9 * caps)
    for _ in range(ROUNDS):
        before = w
        for group, target in [*margins[1:], margins[0]]:
            w = _raise_to(w, caps, group, target)
        if np.abs(w - before).max() <= 1e-6 * max(w.max(), 1e-300):
            break
    return w


def mix_documents(documents: DataFrame, targets: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """``(mix_name, doc_id, source, tokens, uses)``: the documents of each mix and how often each is used.

    Equal texts are one text, represented by its smallest ``doc_id`` among the sources of the mix, so none
    is used more than ``max_repeats`` times. A mix is as large as its scarcest source at full repeats
    allows; sources without any text can't contribute, and the others keep their proportions. A null
    language or topic is a value of its own. Null and empty texts and documents without id or source are
    left out; target rows given twice count once. No documents or targets give no rows.
    """
    goal = targets.select("mix_name", "source", "target_share", "max_repeats").distinct().where("target_share > 0 and max_repeats > 0")
    goals = goal.groupBy("mix_name", "source").agg(F.max("target_share").alias("share"), F.max("max_repeats").alias("repeats")).limit(10_001).collect()
    if len(goals) > 10_000:
        raise ValueError("more than 10,000 targets")
    spark = documents.sparkSession
    docs = documents.where("doc_id is not null and source is not null").select(
        "doc_id", "source", F.coalesce("lang", F.lit("?")).alias("lang"), F.coalesce("doc_kind", F.lit("?")).alias("kind"),
        F.xxhash64(F.lit(1), "text").alias("t1"), F.xxhash64("text", F.lit(2)).alias("t2"), "text",
    )
    sized = cut_lineage(with_tokens(docs, "text", ["doc_id", "source", "lang", "kind", "t1", "t2"], vocabulary))
    wanted = F.broadcast(spark.createDataFrame([(g.mix_name, g.source) for g in goals], "mix_name string, source string"))  # at most 10,000 rows
    pool = (
        sized.join(wanted, "source").groupBy("mix_name", "t1", "t2")
        .agg(F.min(F.struct("doc_id", "source", "lang", "kind", "tokens")).alias("d")).select("mix_name", "d.*").where("tokens > 0")
    )
    pool = cut_lineage(pool)
    cells = pool.groupBy("mix_name", "source", "lang", "kind").agg(F.sum("tokens").alias("tokens")).limit(MAX_CELLS + 1).collect()
    if len(cells) > MAX_CELLS:
        raise ValueError(f"more than {MAX_CELLS} cells of source, language and topic")
    # Languages and topics of the mixes only, which the check above bounds; their tokens over all documents.
    def over_all(name: str) -> dict[str, float]:
        used = F.broadcast(spark.createDataFrame([(x,) for x in {c[name] for c in cells}], f"{name} string"))
        return {r[name]: float(r.n) for r in sized.join(used, name).groupBy(name).agg(F.sum("tokens").alias("n")).collect()}

    lang_all, kind_all = over_all("lang"), over_all("kind")
    rates: list[tuple] = []
    size: dict[tuple[str, str], float] = {}
    for mix in sorted({g.mix_name for g in goals}):
        own = [c for c in cells if c.mix_name == mix]
        if not own:
            continue
        by = {g.source: g for g in goals if g.mix_name == mix}
        tokens = np.array([c.tokens for c in own], float)
        sources = sorted({c.source for c in own})
        src = np.array([sources.index(c.source) for c in own])
        caps = tokens * np.array([by[c.source].repeats for c in own], float)
        share = np.array([by[s].share for s in sources], float)
        share /= share.sum()
        total = (np.bincount(src, caps, len(sources)) / share).min()
        margins = [(src, share * total)]
        for name, whole in (("lang", lang_all), ("kind", kind_all)):
            values = sorted({c[name] for c in own})
            part = np.array([whole[v] for v in values])
            margins.append((np.array([values.index(c[name]) for c in own]), part / part.sum() * total))
        w = rake(tokens, caps, margins)
        for c, x, n in zip(own, w, tokens, strict=True):
            rates.append((mix, c.source, c.lang, c.kind, float(min(x / n, by[c.source].repeats))))
        for i, s in enumerate(sources):
            size[(mix, s)] = float(share[i] * total)
    if not rates:
        return spark.createDataFrame([], "mix_name string, doc_id long, source string, tokens int, uses int")
    rate = F.broadcast(spark.createDataFrame(rates, "mix_name string, source string, lang string, kind string, rate double"))  # at most MAX_CELLS rows
    chance = (F.pmod(F.xxhash64("mix_name", "doc_id", F.lit(9)), F.lit(1 << 40)) + F.lit(0.5)) / F.lit(float(1 << 40))
    base = F.floor(F.col("rate") + F.lit(1e-9))
    rest = F.col("rate") - base
    drawn = pool.join(rate, ["mix_name", "source", "lang", "kind"]).select(
        "mix_name", "doc_id", "source", "tokens", base.cast("int").alias("base"),
        F.when(rest > 1e-9, F.least(chance / rest, F.lit(1e9))).alias("z"),  # null: no further use
    )
    drawn = cut_lineage(drawn)
    sure = {(r.mix_name, r.source): float(r.n) for r in drawn.groupBy("mix_name", "source").agg(F.sum(F.col("tokens") * F.col("base")).alias("n")).collect()}
    # Where the sum of tokens in order of z reaches what is left to the target: halved into PARTS twice.
    low, width = {k: 0.0 for k in size}, {k: 4.0 for k in size}
    left = {k: size[k] - sure.get(k, 0.0) for k in size}
    for _ in range(3):
        at = F.broadcast(spark.createDataFrame([(*k, low[k], width[k]) for k in size], "mix_name string, source string, low double, width double"))
        part = F.least(F.floor((F.col("z") - F.col("low")) / F.col("width") * PARTS), F.lit(PARTS - 1))
        sums: dict[tuple[str, str], dict[int, float]] = {}
        for r in (
            drawn.join(at, ["mix_name", "source"]).where("z >= low and z < low + width")
            .groupBy("mix_name", "source", part.alias("part")).agg(F.sum("tokens").alias("n")).collect()
        ):
            sums.setdefault((r.mix_name, r.source), {})[r.part] = float(r.n)
        for k in size:
            step, chosen = width[k] / PARTS, None
            for p in sorted(sums.get(k, {})):
                if sums[k][p] > left[k]:
                    chosen = p
                    break
                left[k] -= sums[k][p]
            low[k], width[k] = (low[k] + chosen * step, step) if chosen is not None else (low[k] + width[k], 0.0)
            if chosen is None:
                width[k] = 1e-12
    cuts = F.broadcast(spark.createDataFrame([(*k, low[k]) for k in size], "mix_name string, source string, cut double"))
    uses = F.col("base") + F.when(F.col("z").isNotNull() & (F.col("z") < F.col("cut")), 1).otherwise(0)
    return drawn.join(cuts, ["mix_name", "source"]).select("mix_name", "doc_id", "source", "tokens", uses.cast("int").alias("uses")).where("uses > 0")


def mix_shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """``(mix_name, source, target_share, actual_share, tokens, documents, most_uses)`` for every target.

    A source that couldn't contribute has a share of 0.
    """
    goal = targets.groupBy("mix_name", "source").agg(F.max("target_share").alias("target_share"))
    got = mixed.groupBy("mix_name", "source").agg(
        F.sum(F.col("tokens").cast("long") * F.col("uses")).alias("tokens"), F.count("*").alias("documents"), F.max("uses").alias("most_uses")
    )
    whole = got.groupBy("mix_name").agg(F.sum("tokens").alias("all"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return (
        goal.join(got, ["mix_name", "source"], "left").join(whole, "mix_name", "left")
        .select("mix_name", "source", "target_share", (zero("tokens") / F.coalesce("all", F.lit(1))).alias("actual_share"),
                zero("tokens").alias("tokens"), zero("documents").alias("documents"), zero("most_uses").alias("most_uses"))
    )


def mix_marginals(mixed: DataFrame, documents: DataFrame) -> DataFrame:
    """``(mix_name, dimension, value, tokens, share)``: tokens of each language (``lang``) and topic (``doc_kind``) in each mix.

    A null language or topic is ``?``. Empty mixes give no rows.
    """
    facts = documents.select("doc_id", F.explode(F.array(*[F.struct(F.lit(c).alias("dimension"), F.coalesce(c, F.lit("?")).alias("value")) for c in ("lang", "doc_kind")])).alias("x")).select("doc_id", "x.*").distinct()
    sums = mixed.join(facts, "doc_id").groupBy("mix_name", "dimension", "value").agg(F.sum(F.col("tokens").cast("long") * F.col("uses")).alias("tokens"))
    whole = sums.groupBy("mix_name", "dimension").agg(F.sum("tokens").alias("all"))
    return sums.join(whole, ["mix_name", "dimension"]).select("mix_name", "dimension", "value", "tokens", F.round(F.col("tokens") / F.col("all"), 4).alias("share"))
