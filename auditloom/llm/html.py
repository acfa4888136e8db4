"""Pages of the cache: latest row of each address, its html, visible words and blocks."""

from __future__ import annotations

import html as entities
import json
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HIDDEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript)\b[^>]*>.*?(?:</\1\s*>|\Z)", re.S | re.I)
TAG = re.compile(r"<[a-zA-Z/!?][^<>]*>")


def latest_pages(cache: DataFrame) -> DataFrame:
    """``(url, html_blob)`` of the row with the latest ``analysed_at`` of each url.

    Null times come first; of rows with one time a filled blob wins, then the greatest. Rows without
    url are no page. A null or broken blob in the latest row stays, and holds no page.
    """
    best = F.max(F.struct(F.coalesce(F.col("analysed_at").cast("timestamp"), F.lit("0001-01-01").cast("timestamp")).alias("t"), "html_blob"))
    return cache.where("url is not null").groupBy("url").agg(best.alias("x")).select("url", "x.html_blob")


def page_html(blob: bytes | None) -> str | None:
    """The html in a blob, or None where it holds no page (null, cut off, not the expected JSON)."""
    if not blob:
        return None
    try:
        found = json.loads(blob)
    except ValueError:
        return None
    text = found.get("html") if isinstance(found, dict) else None
    return text if isinstance(text, str) else None


def visible_words(text: str) -> list[str]:
    """Lower-cased words outside tags, comments, scripts, styles and noscript; a tag separates words."""
    return entities.unescape(TAG.sub(" ", HIDDEN.sub(" ", text))).lower().split()
