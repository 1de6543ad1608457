"""String expressions: cleaning, stripping, previews, url quoting, markup.

Every function maps Column -> Column and stays inside the JVM, so Catalyst can
push filters around it and whole-stage codegen keeps it in the scan stage.
"""

from __future__ import annotations

import html
import html.entities

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config

# Whitespace as Python's ``str.isspace`` sees it: Unicode White_Space plus the
# four information separators U+001C..U+001F.
_PY_SPACE = r"[\s\x1c-\x1f]"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def py_strip(col) -> Column:
    """Python ``str.strip()``: remove leading/trailing Unicode whitespace.

    ``trim`` only removes U+0020, so it is not used.
    """
    return F.regexp_replace(_c(col), F.lit(f"(?U)^{_PY_SPACE}+|{_PY_SPACE}+\\z"), F.lit(""))


def remove_citations(col) -> Column:
    """Drop inline markers ``[12]`` and ``[citation needed]`` (any case)."""
    return F.regexp_replace(_c(col), F.lit(r"(?iU)\[(?:\d+|citation needed)\]"), F.lit(""))


def normalize_spaces(col) -> Column:
    """Runs of space, tab and no-break space become one space; newlines stay."""
    return F.regexp_replace(_c(col), F.lit("[ \\t\\u00A0]+"), F.lit(" "))


def collapse_newlines(col) -> Column:
    """Three or more newlines become a blank line."""
    return F.regexp_replace(_c(col), F.lit("\\n{3,}"), F.lit("\n\n"))


def clean_text(col) -> Column:
    """Citation markers -> spaces -> newlines -> strip, in that order.

    Null or empty input gives ``''``.
    """
    t = F.coalesce(_c(col), F.lit(""))
    return py_strip(collapse_newlines(normalize_spaces(remove_citations(t))))


def collapse_whitespace(col) -> Column:
    """``' '.join(text.split())``: every whitespace run becomes one space."""
    return py_strip(F.regexp_replace(_c(col), F.lit(f"(?U){_PY_SPACE}+"), F.lit(" ")))


# Where a word may be broken: after a hyphen between letters, around a long dash.
_BREAK = (r"(?:(?<=[^\d\W]{2}-)|(?<=[^\d\W]-[^\d\W]-))(?=[^\d\W]-?[^\d\W])"
          r"""|(?<=[\w!"'&.,?])(?=-{2,}\w)|(?<=[\w!"'&.,?]-{2,9})(?=\w)""")


def preview(col, width: int, placeholder: str = "…") -> Column:
    """One-line preview: newlines to spaces, whitespace collapsed, and when the
    text is longer than ``width`` it is cut at the last break that lets the
    result including the placeholder fit in ``width`` characters.  Breaks are
    spaces, hyphens inside words, and both sides of a dash of two or more."""
    if width <= len(placeholder):
        raise ValueError("width must exceed the placeholder length")
    t = collapse_whitespace(F.regexp_replace(_c(col), F.lit("\n"), F.lit(" ")))
    keep = width - len(placeholder)
    head = F.regexp_extract(t, f"(?U)^(.{{0,{keep}}})(?: |{_BREAK})", 1)
    return F.when(F.length(t) <= width, t).otherwise(F.concat(head, F.lit(placeholder)))


def quote_path(col) -> Column:
    """Percent-encode like ``urllib.parse.quote(s)`` (safe ``/``, unreserved
    ``A-Za-z0-9_.-~``), on the UTF-8 bytes.

    ``url_encode`` follows form encoding: it keeps ``*``, encodes ``~`` and
    ``/``; the three replacements turn it into path quoting.  Spaces never
    reach it because titles have them replaced by ``_`` first.
    """
    enc = F.url_encode(_c(col))
    enc = F.replace(enc, F.lit("*"), F.lit("%2A"))
    enc = F.replace(enc, F.lit("%7E"), F.lit("~"))
    enc = F.replace(enc, F.lit("+"), F.lit("%20"))
    return F.replace(enc, F.lit("%2F"), F.lit("/"))


def title_slug(col) -> Column:
    """Title as it appears in a page url: spaces to underscores, quoted."""
    return quote_path(F.replace(_c(col), F.lit(" "), F.lit("_")))


def page_url(title, lang) -> Column:
    """``https://{lang}.wikipedia.org/wiki/{quoted title}``; ``lang`` is a
    column (name) so every row may carry its own language."""
    return F.concat(F.lit(config.PAGE_URL_PREFIX), _c(lang), F.lit(config.PAGE_URL_HOST),
                    title_slug(title))


def section_url(page_url_col, section_title) -> Column:
    """Page url plus ``#anchor``; no anchor when the section has no title."""
    t = _c(section_title)
    anchor = F.when(F.coalesce(t, F.lit("")) != "", F.concat(F.lit("#"), title_slug(t))) \
        .otherwise(F.lit(""))
    return F.concat(_c(page_url_col), anchor)


# ---------------------------------------------------------------------------
# Markup
# ---------------------------------------------------------------------------
# A tag: quoted attribute values may hold ``>``; ``<`` before anything but a
# letter, ``/``, ``!`` or ``?`` is text.  The second form takes tags with a
# stray quote.
_TAG = r"""</?[A-Za-z!?](?:"[^"]*"|'[^']*'|[^>"'])*+>|</?[A-Za-z!?][^<>]*>"""
_REFERENCE = r"^&(#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);?"


def _pairs(table: dict) -> Column:
    """A constant map, as one folded literal."""
    text = "\u0001".join(f"{k}\u0002{v}" for k, v in sorted(table.items()))
    return F.str_to_map(F.lit(text), F.lit("\u0001"), F.lit("\u0002"))


def _named() -> dict:
    """Entity names of the HTML standard, as Python's library lists them: all
    with a semicolon, a few old ones without."""
    return dict(html.entities.html5)


def _old_names() -> str:
    """A pattern of the names that need no semicolon, the longest first."""
    old = sorted((n for n in html.entities.html5 if not n.endswith(";")), key=lambda n: (-len(n), n))
    return "^(" + "|".join(old) + ")"


def _numbered() -> dict:
    """Numbers that do not stand for their own character (controls, the old
    Windows range), as Python's library reads them."""
    return {i: html.unescape(f"&#{i};") for i in (*range(1, 32), *range(127, 160), 0)
            if html.unescape(f"&#{i};") not in (chr(i), "")}


def unescape_entities(col) -> Column:
    """Character references decoded, named and numeric, each once.

    The text is cut before every ``&``; a piece starts with at most one
    reference.  A name that is not known may begin with an old one that needs no
    semicolon (the longest counts); others stay as they are.
    """
    def piece(p):
        name = F.regexp_extract(p, _REFERENCE, 1)
        whole = F.regexp_extract(p, _REFERENCE, 0)
        rest = F.substring(p, F.length(whole) + 1, F.length(p))
        digits = F.regexp_extract(name, "^#[xX]?0*([0-9a-fA-F]*)$", 1)
        base = F.when(F.lower(F.substring(name, 2, 1)) == "x", 16).otherwise(10)
        code = F.when(F.length(digits) > 9, F.lit(1 << 40)).otherwise(_number(digits, base))
        usable = (code < 0x110000) & ~code.between(0xD800, 0xDFFF)
        number = F.coalesce(
            F.try_element_at(_pairs(_numbered()), code.cast("string")),
            F.when(usable, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))
            .otherwise(F.lit("\ufffd")))
        word = F.try_element_at(_pairs(_named()), F.substring(whole, 2, F.length(whole)))
        old = F.regexp_extract(name, _old_names(), 1)
        begun = F.concat(F.try_element_at(_pairs(_named()), F.when(old != "", old)),
                         F.substring(p, F.length(old) + 2, F.length(p)))
        return (F.when(name == "", p)
                 .when(name.startswith("#"), F.concat(number, rest))
                 .otherwise(F.coalesce(F.concat(word, rest), begun, p)))

    t = _c(col)
    return F.when(~F.contains(t, F.lit("&")), t) \
            .otherwise(F.array_join(F.transform(F.split(t, "(?=&)"), piece), ""))


def _number(digits: Column, base: Column) -> Column:
    value = F.when(base == 16, F.conv(digits, 16, 10)).otherwise(digits)
    return F.coalesce(F.when(value != "", value).cast("long"), F.lit(0).cast("long"))


def drop_non_text_blocks(col) -> Column:
    """Remove script and style blocks (with their contents) and comments."""
    t = F.regexp_replace(_c(col), F.lit(r"(?is)<script\b.*?</script\s*>"), F.lit(" "))
    t = F.regexp_replace(t, F.lit(r"(?is)<style\b.*?</style\s*>"), F.lit(" "))
    return F.regexp_replace(t, F.lit(r"(?s)<!--.*?-->"), F.lit(" "))


def strip_tags(col) -> Column:
    return F.regexp_replace(_c(col), F.lit(_TAG), F.lit(" "))


def html_to_text(col, collapse: bool = True) -> Column:
    """Visible text of a page: text nodes, each stripped, joined by one space.

    Script and style contents, comments and the doctype are not text.  With
    ``collapse`` (default) every whitespace run becomes one space; without
    it whitespace inside a text node is kept as it is, exactly one node per
    piece: tags become a separator, each piece is decoded and stripped, empty
    pieces are dropped.
    """
    if collapse:
        t = strip_tags(drop_non_text_blocks(col))
        return collapse_whitespace(unescape_entities(t))
    # NUL (never valid in HTML text) marks the node boundaries
    marked = F.regexp_replace(drop_non_text_blocks(col), F.lit(_TAG), F.lit("\u0000"))
    nodes = F.transform(F.split(marked, "\u0000"), lambda n: py_strip(unescape_entities(n)))
    return F.array_join(F.filter(nodes, lambda n: n != ""), " ")


def html_title(col) -> Column:
    """Text of the ``<title>`` element (entities decoded, whitespace collapsed)."""
    raw = F.regexp_extract(_c(col), r"(?is)<title[^>]*>(.*?)</title\s*>", 1)
    return collapse_whitespace(unescape_entities(strip_tags(raw)))
