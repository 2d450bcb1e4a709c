"""Web pages as tables of tags and texts: links with what stands around them. JVM expressions and windows inside a page.

Defined cases: null pages have no rows; scripts, styles and comments are left out; links without a target or on pages without
an address keep what can be said; of equal addresses on a page the first counts; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldsense.functions.text import clean

HIDDEN = r"(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->"
TOKEN = r"<[^>]*>|[^<]+"
# The five entities that pages escape text by, and the space.
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))


def unescaped(text: Column) -> Column:
    for name, sign in ENTITIES:
        text = F.replace(text, F.lit(name), F.lit(sign))
    return text


def resolved(link: Column, base: Column) -> Column:
    """The link's address on a page of this address: links with a scheme as they are, /x on the page's host, x beside it."""
    host = F.regexp_extract(base, r"^([a-zA-Z]+://[^/?#]*)", 1)
    beside = F.regexp_extract(base, r"^[a-zA-Z]+://[^/?#]*(/(?:[^?#]*/)?)", 1)
    beside = F.when(beside == "", "/").otherwise(beside)
    whole = link.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:")
    return F.when(whole, link).when(link.startswith("//"), F.concat(F.regexp_extract(base, r"^([a-zA-Z]+:)", 1), link)).when(link.startswith("/"), F.concat(host, link)).otherwise(F.concat(host, beside, link))


def attribute(tag: Column, name: str) -> Column:
    """A quoted attribute of a tag; null if it has none."""
    found = F.regexp_extract(tag, rf"(?i)\s{name}\s*=\s*(\"[^\"]*\"|'[^']*')", 1)
    return F.when(found != "", F.trim(F.substring(found, F.lit(2), F.length(found) - 2)))


def tokens(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """(key, pos, tag, name, text): one row a tag (name in small letters, / first if it closes) or text, in order."""
    shown = F.regexp_replace(F.col(html), HIDDEN, " ")
    each = pages.select(key, F.posexplode(F.regexp_extract_all(shown, F.lit(TOKEN), F.lit(0))).alias("pos", "token"))
    is_tag = F.col("token").startswith("<")
    return each.select(key, "pos", F.when(is_tag, F.col("token")).alias("tag"), F.when(is_tag, F.lower(F.regexp_extract("token", r"^<(/?[a-zA-Z0-9]+)", 1))).alias("name"), F.when(~is_tag, clean(unescaped(F.col("token")))).alias("text"))


def _joined(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """keys, name: texts in order, joined by spaces; a page's length at most."""
    texts = F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda e: e["text"])
    return rows.groupBy(*keys).agg(clean(F.array_join(texts, " ")).alias(name))


def page_text(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """(key, text) of pages with any text."""
    return _joined(tokens(pages, key, html).filter("text <> ''"), [key], "text")


def page_links(pages: DataFrame, key: str, ends: str = "", marks: dict[str, str] | None = None, html: str = "html", url: str = "url") -> DataFrame:
    """(key, pos, link, caption, and a column for each mark): anchors whose target ends in `ends`, with addresses resolved.

    caption: the next cell of the anchor's table row, else the anchor's own text; a mark is the last text before the anchor
    that matches its pattern.
    """
    here = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    seen = lambda *names: F.sum(F.when(F.col("name").isin(*names), 1).otherwise(0)).over(here)
    columns = {"anchor": seen("a"), "inside": seen("a") - seen("/a"), "cell": seen("td", "th"), "row": seen("tr"), "open_cells": seen("td", "th") - seen("/td", "/th")}
    columns |= {m: F.last(F.when(F.col("text").rlike(p), F.col("text")), ignorenulls=True).over(here) for m, p in (marks or {}).items()}
    placed = tokens(pages, key, html).withColumns(columns)
    texts = placed.filter("text <> ''")
    own = _joined(texts.filter("inside > 0"), [key, "anchor"], "own_text")
    beside = _joined(texts.filter("open_cells > 0"), [key, "row", "cell"], "next_text")
    links = placed.filter("name = 'a'").withColumn("target", attribute(F.col("tag"), "href")).filter(F.col("target").isNotNull() & F.lower("target").endswith(ends.lower()))
    links = links.join(pages.select(key, url), key).withColumn("link", resolved(F.col("target"), F.col(url)))
    first = F.row_number().over(Window.partitionBy(key, "link").orderBy("pos")) == 1
    links = links.withColumn("first", first).filter("first")
    links = links.join(own, [key, "anchor"], "left")
    next_cell = beside.select(key, "row", (F.col("cell") - 1).alias("cell"), "next_text")
    links = links.join(next_cell, [key, "row", "cell"], "left")
    caption = F.when((F.col("open_cells") > 0) & F.col("next_text").isNotNull(), F.col("next_text")).otherwise(F.coalesce("own_text", F.lit("")))
    return links.select(key, "pos", "link", caption.alias("caption"), *(marks or {}))


def page_images(pages: DataFrame, key: str, holds: str, html: str = "html", url: str = "url") -> DataFrame:
    """(key, images): addresses of images whose source holds a word in any case, sorted, each once."""
    found = tokens(pages, key, html).filter("name = 'img'").withColumn("source", attribute(F.col("tag"), "src")).filter(F.contains(F.lower("source"), F.lit(holds.lower())))
    found = found.join(pages.select(key, url), key)
    return found.groupBy(key).agg(F.array_sort(F.collect_set(resolved(F.col("source"), F.col(url)))).alias("images"))
