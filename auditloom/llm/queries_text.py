"""Queries over page and document text."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditloom.llm.encoding import misread_documents
from auditloom.llm.mainbody import main_blocks
from auditloom.llm.mixing import mix_documents, mix_marginals, mix_shares
from auditloom.llm.packing import pack, packing_report
from auditloom.llm.residue import residue_pages
from auditloom.llm.tokens import with_tokens
from auditloom.runtime import cut_lineage
from auditloom.sources.tables import table


def p6_found(spark, d):
    return main_blocks(table(spark, d, "page_cache"))


def p7_found(spark, d):
    return residue_pages(table(spark, d, "page_cache"), table(spark, d, "pages")).select("url")


def p7_reasons(spark, d):
    """The pages of ``p7_found`` with the kind of residue, and whether they were trusted or came by propagation."""
    return residue_pages(table(spark, d, "page_cache"), table(spark, d, "pages"))


def p8_containers(spark, d):
    """Every piece of every text, for each spec, and the container it is packed into."""
    sizes = with_tokens(table(spark, d, "documents"), "text", ["doc_id"]).withColumnRenamed("doc_id", "id")
    return pack(cut_lineage(sizes), table(spark, d, "pack_specs")).withColumnRenamed("id", "doc_id")


def p8_report(spark, d):
    """How full the containers of each spec are."""
    return packing_report(p8_containers(spark, d), table(spark, d, "pack_specs"))


def p8_placed(spark, d):
    """For each spec: texts placed, containers over capacity, texts split though they fit, and pieces that don't follow one another."""
    specs = table(spark, d, "pack_specs").select("spec_id", "capacity_tokens").distinct()
    packed = cut_lineage(p8_containers(spark, d))
    full = packed.groupBy("spec_id", "container_id").agg(F.sum("tokens").alias("held")).join(specs, "spec_id")
    over = full.groupBy("spec_id").agg(F.sum((F.col("held") > F.col("capacity_tokens")).cast("long")).alias("overfull"))
    text = packed.groupBy("spec_id", "doc_id").agg(F.count("*").alias("pieces"), F.sum("tokens").alias("tokens"), F.max(F.col("first_token") + F.col("tokens")).alias("last")).join(specs, "spec_id")
    split = (F.col("pieces") > 1) & (F.col("tokens") <= F.col("capacity_tokens"))
    kept = text.groupBy("spec_id").agg(F.count("*").alias("documents"), F.sum(split.cast("long")).alias("split"), F.sum((F.col("last") != F.col("tokens")).cast("long")).alias("broken"))
    return kept.join(over, "spec_id").select("spec_id", "documents", "overfull", "split", "broken")


P8_PLACED_SQL = "SELECT spec_id, (SELECT count(*) FROM documents WHERE text <> '') AS documents, 0::BIGINT AS overfull, 0::BIGINT AS split, 0::BIGINT AS broken FROM (SELECT DISTINCT spec_id FROM pack_specs)"


def p9_marginals(spark, d):
    """Shares of languages and topics in each mix beside those in all documents, in tokens."""
    return mix_marginals(p9_mixes(spark, d), table(spark, d, "documents"))


def p9_uses(spark, d):
    """For each mix and source that has texts: texts used more often than allowed, and used through two documents."""
    documents, targets = table(spark, d, "documents"), table(spark, d, "mix_targets").groupBy("mix_name", "source").agg(F.max("target_share").alias("share"), F.max("max_repeats").alias("repeats"))
    mixed = cut_lineage(p9_mixes(spark, d))
    texts = documents.where("text is not null").select("doc_id", F.xxhash64("text").alias("t"))
    used = mixed.join(texts, "doc_id").join(targets, ["mix_name", "source"])
    over = used.groupBy("mix_name", "source").agg(F.sum((F.col("uses") > F.col("repeats")).cast("long")).alias("overused"))
    twice = used.groupBy("mix_name", "t").agg(F.count("*").alias("n"), F.min("source").alias("source")).groupBy("mix_name", "source").agg(F.sum((F.col("n") > 1).cast("long")).alias("twice"))
    every = targets.where("share > 0 and repeats > 0").join(documents.where("text <> ''").select("source").distinct(), "source").select("mix_name", "source")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return every.join(over, ["mix_name", "source"], "left").join(twice, ["mix_name", "source"], "left").select("mix_name", "source", zero("overused"), zero("twice"))


P9_USES_SQL = "SELECT DISTINCT mix_name, source, 0::BIGINT AS overused, 0::BIGINT AS twice FROM mix_targets JOIN documents USING (source) WHERE text <> '' AND target_share > 0 AND max_repeats > 0"


def p9_mixes(spark, d):
    """The documents of each mix and how often each is used."""
    return mix_documents(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p9_shares(spark, d):
    """Target and actual share of each source in each mix."""
    return mix_shares(p9_mixes(spark, d), table(spark, d, "mix_targets"))


def p10_found(spark, d):
    return misread_documents(table(spark, d, "documents")).selectExpr("id as doc_id").distinct()


def p10_restored(spark, d):
    """The documents of ``p10_found`` with the encodings found and the text restored where it can be."""
    return misread_documents(table(spark, d, "documents")).withColumnRenamed("id", "doc_id")


QUERIES = {
    "p6_found": (p6_found, None),
    "p7_found": (p7_found, None),
    "p7_reasons": (p7_reasons, None),
    "p8_containers": (p8_containers, None),
    "p8_report": (p8_report, None),
    "p8_placed": (p8_placed, P8_PLACED_SQL),
    "p9_mixes": (p9_mixes, None),
    "p9_uses": (p9_uses, P9_USES_SQL),
    "p9_marginals": (p9_marginals, None),
    "p9_shares": (p9_shares, None),
    "p10_found": (p10_found, None),
    "p10_restored": (p10_restored, None),
}
