"""Words, phrases, shingles, readability and hashes of text, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Words that carry no topic on a page.
STOP_WORDS = (
    "a an the and or but if then else for of on in to with is are was were be been being "
    "this that these those it its as at by from not no so such than too very can will just"
).split()
# Weights of the fields in which a phrase stands.
FIELD_WEIGHTS = {"title": 3.0, "h1": 2.5, "meta_description": 2.0, "headings": 1.5, "body": 1.0}


def let(value: Column, body) -> Column:
    """``body`` of ``value``, computed once: a column used inside a lambda would be computed for each element."""
    return F.transform(F.array(value), body)[0]


def tokens(text: Column) -> Column:
    """Runs of ASCII letters and apostrophes in lower case."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[a-z']+"), F.lit(0))


def word_count(text: Column) -> Column:
    """Number of ``tokens``."""
    return F.size(tokens(text))


def is_content_word(token: Column) -> Column:
    """Longer than two letters and no stop word."""
    return (F.length(token) > 2) & ~token.isin(STOP_WORDS)


def phrases(text: Column) -> Column:
    """All one- to three-word phrases of adjoining content words, repeats kept."""
    def grams(words: Column, n: int) -> Column:
        starts = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - (n - 1))).otherwise(F.expr("cast(array() as array<int>)"))
        cut = F.transform(starts, lambda i: F.slice(words, i, F.lit(n)))
        return F.transform(F.filter(cut, lambda g: F.forall(g, is_content_word)), lambda g: F.array_join(g, " "))

    return let(tokens(text), lambda w: F.concat(grams(w, 1), grams(w, 2), grams(w, 3)))


def page_keywords(fields: DataFrame, key: str = "url", top: int = 8) -> DataFrame:
    """``(key, phrase, score, found_in, rank)``: the best phrases of each page by weighted counts.

    ``fields`` has the key and any of the columns title, h1, meta_description, headings, body. Ties go by
    phrase; ``found_in`` lists the fields in their fixed order.
    """
    named = [f for f in FIELD_WEIGHTS if f in fields.columns]
    long = fields.select(key, F.explode(F.array(*[
        F.struct(F.lit(i).alias("at"), F.lit(f).alias("field"), F.lit(FIELD_WEIGHTS[f]).alias("weight"), F.col(f).alias("text"))
        for i, f in enumerate(named)
    ])).alias("f")).select(key, "f.*")
    scored = long.select(key, "at", "field", "weight", F.explode(phrases(F.col("text"))).alias("phrase")).groupBy(key, "phrase").agg(
        F.round(F.sum("weight"), 2).alias("score"), F.array_sort(F.collect_set(F.struct("at", "field"))).alias("f")
    )
    order = Window.partitionBy(key).orderBy(F.desc("score"), "phrase")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select(
        key, "phrase", "score", F.transform("f", lambda x: x["field"]).alias("found_in"), "rank"
    )


def keyword_density(df: DataFrame, key: str, text: str, top: int = 10) -> DataFrame:
    """``(key, keyword, count, density_pct, rank)``: the most frequent content words of each text."""
    words = df.select(key, F.filter(tokens(F.col(text)), is_content_word).alias("words")).withColumn("total", F.greatest(F.size("words"), F.lit(1)))
    counts = words.select(key, "total", F.explode("words").alias("keyword")).groupBy(key, "total", "keyword").agg(F.count("*").alias("count"))
    order = Window.partitionBy(key).orderBy(F.desc("count"), "keyword")
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select(
        key, "keyword", "count", F.round(F.col("count") / F.col("total") * 100, 2).alias("density_pct"), "rank"
    )


def collapse_space(text: Column) -> Column:
    """White space of any script as single spaces, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def content_hash(text: Column) -> Column:
    """The first 16 hex digits of SHA-256 over collapsed lower-case text."""
    return F.substring(F.sha2(F.lower(collapse_space(text)), 256), 1, 16)


def shingles(text: Column, size: int = 5) -> Column:
    """Distinct runs of ``size`` lower-case words; a shorter text is one run, an empty one none."""
    def runs(words: Column) -> Column:
        cut = F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - (size - 1), F.lit(1))), lambda i: F.array_join(F.slice(words, i, F.lit(size)), " "))
        return F.when(words[0] == "", F.expr("cast(array() as array<string>)")).otherwise(F.array_distinct(cut))

    return let(F.split(F.lower(collapse_space(F.coalesce(text, F.lit("")))), " "), runs)


def syllables(word: Column) -> Column:
    """Vowel groups of a word, one less for a final e, at least one."""
    low = F.lower(word)
    n = F.size(F.regexp_extract_all(low, F.lit("[aeiouy]+"), F.lit(0)))
    return F.greatest(F.when(low.endswith("e") & (n > 1), n - 1).otherwise(n), F.lit(1))


def reading_ease(text: Column) -> Column:
    """Flesch reading ease to one decimal; null without a sentence or word."""
    sentences = F.size(F.filter(F.split(text, r"[.!?]+"), lambda s: s.rlike(r"(?U)\S")))
    words = F.regexp_extract_all(text, F.lit(r"[A-Za-z']+"), F.lit(0))
    n = F.size(words)
    spoken = F.aggregate(words, F.lit(0), lambda a, w: a + syllables(w))
    score = F.lit(206.835) - F.lit(1.015) * (n / sentences) - F.lit(84.6) * (spoken / n)
    return F.when((sentences > 0) & (n > 0), F.round(score, 1))


def reading_minutes(words: Column) -> Column:
    """Minutes to read at 200 words each, rounded half to even, at least one; 0 without words."""
    return F.when(words > 0, F.greatest(F.lit(1), F.bround(words / 200).cast("int"))).otherwise(0)


def normalize_keyword(text: Column) -> Column:
    """Lower case with single spaces."""
    return F.lower(collapse_space(text))


def stem(word: Column) -> Column:
    """A word without its final s, if longer than three letters."""
    return F.when((F.length(word) > 3) & word.endswith("s"), F.substr(word, F.lit(1), F.length(word) - 1)).otherwise(word)
