"""Pages with markup: scan, title lookup with fallback, text, sections.

A page row holds its whole markup, so everything here is row-local: sections
are cut from the row's own article with ``split`` + ``posexplode``; no page is
ever gathered from several rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import (collapse_whitespace, html_title, html_to_text, page_url,
                              py_strip, section_url, strip_tags, unescape_entities)


def page_lang(html_col="html", default: str = "en"):
    """``<html lang="..">`` (primary subtag), or the default."""
    lang = F.lower(F.regexp_extract(F.col(html_col), r"""(?is)<html[^>]*\blang\s*=\s*["']?\s*([A-Za-z]+)""", 1))
    return F.when(lang != "", lang).otherwise(F.lit(default))


def scan_pages(pages: DataFrame) -> DataFrame:
    """``pages(page_id, url, html)`` -> ``(page_id, topic, lang, title, url,
    text)``: the title from ``<title>``, the canonical url rebuilt from title
    and language, the visible text."""
    staged = pages.select(
        "page_id", html_title(F.col("html")).alias("title"), page_lang().alias("lang"),
        html_to_text(F.col("html")).alias("text"))
    return staged.select(
        "page_id", F.col("title").alias("topic"), "lang", "title",
        page_url(F.col("title"), F.col("lang")).alias("url"), "text")


def page_titles(pages: DataFrame) -> DataFrame:
    """``(page_id, title, lang)`` - the lookup table for topic resolution.
    Build it once and store it: resolving topics then reads two short
    columns instead of every page's markup."""
    return pages.select("page_id", html_title(F.col("html")).alias("title"),
                        page_lang().alias("lang"))


def capitalize_first(col):
    """``t[:1].upper() + t[1:]`` (only the first character; not ``initcap``,
    which would also lower-case the rest)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.concat(F.upper(F.substring(c, 1, 1)), F.substring(c, 2, 1 << 30))


def lookup_pages(requests: DataFrame, pages: DataFrame, topic_col: str = "topic",
                 lang: str | None = None) -> DataFrame:
    """Resolve request topics to pages: exact title, else the title with its
    first character upper-cased, else not found.

    ``pages`` needs ``page_id, title`` (and ``lang`` when ``lang`` is given);
    duplicate titles resolve to the lowest page id.  Output: request columns + ``page_id, title, status``.  Both
    lookups are equi joins; the page side is aggregated to one row per title
    first, so the joins never multiply rows.
    """
    if lang is not None:  # the language variant: only that language's pages
        pages = pages.filter(F.col("lang") == lang)
    titles = pages.groupBy("title").agg(F.min("page_id").alias("page_id"))
    req = requests.withColumn("_t", py_strip(F.coalesce(F.col(topic_col), F.lit(""))))
    req = req.withColumn("_alt", capitalize_first("_t"))
    exact = titles.select(F.col("title").alias("_t"), F.col("page_id").alias("_p1"))
    alt = titles.select(F.col("title").alias("_alt"), F.col("page_id").alias("_p2"))
    joined = req.join(exact, "_t", "left").join(alt, "_alt", "left")
    status = (F.when(F.col("_t") == "", F.lit("empty topic"))
               .when(F.col("_p1").isNotNull(), F.lit("exact"))
               .when(F.col("_p2").isNotNull(), F.lit("capitalized"))
               .otherwise(F.lit("not found")))
    page_id = F.when(F.col("_t") != "", F.coalesce("_p1", "_p2"))
    title = F.when(F.col("_p1").isNotNull(), F.col("_t")) \
             .when(F.col("_p2").isNotNull(), F.col("_alt"))
    return (joined.withColumn("page_id", page_id).withColumn("title", title)
                  .withColumn("status", status).drop("_t", "_alt", "_p1", "_p2"))


# ---------------------------------------------------------------------------
# Sections from markup
# ---------------------------------------------------------------------------
_ARTICLE = r"(?is)<article[^>]*>(.*)</article\s*>"
# both end tags may be left out: then the text runs to the end
_BODY = r"(?is)<body[^>]*>(.*?)(?:</body\s*>(?!.*</body)|\z)"
_HEAD = r"(?is)<head\b.*?</head\s*>"
_HEADING_SPLIT = r"(?i)(?=<h[2-6][\s>])"
_HEADING = r"(?is)^<h([2-6])[^>]*>(.*?)</h[2-6]\s*>"


def markup_sections(html_col: str = "html"):
    """Page markup -> ``array<struct<ord, level, title, text>>`` per page.

    The article (else the body, else all but the head) without its ``<h1>`` is
    cut before every
    ``<h2>``..``<h6>``; the piece before the first heading is the lead
    (level 0, no title).  Document order is pre-order, so the flat array is
    already the parent-then-children walk.
    """
    art = F.regexp_extract(F.col(html_col), _ARTICLE, 1)
    body = F.regexp_extract(F.col(html_col), _BODY, 1)
    whole = F.regexp_replace(F.col(html_col), F.lit(_HEAD), F.lit(" "))
    main = F.when(art != "", art).when(body != "", body).otherwise(whole)
    main = F.regexp_replace(main, F.lit(r"(?is)<h1[^>]*>.*?</h1\s*>"), F.lit(" "))
    parts = F.split(main, _HEADING_SPLIT)

    def piece(p, i):
        head = F.regexp_extract(p, _HEADING, 2)
        lvl = F.regexp_extract(p, _HEADING, 1)
        rest = F.regexp_replace(p, F.lit(_HEADING), F.lit(" "))
        is_head = lvl != ""
        return F.struct(
            i.cast("int").alias("ord"),
            F.when(is_head, lvl.cast("int") - 1).otherwise(F.lit(0)).alias("level"),
            F.when(is_head, collapse_whitespace(unescape_entities(strip_tags(head)))).alias("title"),
            html_to_text(rest).alias("text"))

    return F.transform(parts, piece)


def page_sections(pages: DataFrame, prune: bool = True) -> DataFrame:
    """Pages -> flat ``sections(page_id, topic, lang, page_title, ord, level,
    title, text, url)``: lead first (kept only when non-empty), then every
    section in pre-order; boilerplate subtrees pruned."""
    from ..operators.sections import prune_boilerplate
    staged = pages.select(
        "page_id", html_title(F.col("html")).alias("page_title"), page_lang().alias("lang"),
        markup_sections().alias("_secs"))
    secs = prune_boilerplate(F.col("_secs")) if prune else F.col("_secs")
    # outer generator + null filter: no inferred filter re-parses the markup
    flat = staged.select("page_id", "page_title", "lang", F.inline_outer(secs))
    flat = flat.filter(F.col("ord").isNotNull()
                       & ((F.col("level") > 0) | (py_strip(F.col("text")) != "")))
    purl = page_url(F.col("page_title"), F.col("lang"))
    return flat.select(
        "page_id", F.col("page_title").alias("topic"), "lang", "page_title", "ord", "level",
        "title", F.when(F.col("level") == 0, py_strip(F.col("text"))).otherwise(F.col("text"))
        .alias("text"),
        section_url(purl, F.col("title")).alias("url"))
