import html
import re
import textwrap
from html.parser import HTMLParser
from urllib.parse import quote

from pyspark.sql import functions as F

from folio.functions import text as T

STRINGS = [
    "  plain  ",
    "\u00a0\t lead and trail  \n",
    "\x1c\x1dsep\x1e\x1f",
    "",
    "Nothing to strip",
    "\n\n\nlines\n\n\n",
    "\u3000ideographic\u3000",
]


def _col(spark, values, name="t"):
    return spark.createDataFrame([(v,) for v in values], f"{name} string")


def test_py_strip_matches_python(spark):
    got = [r[0] for r in _col(spark, STRINGS).select(T.py_strip("t")).collect()]
    assert got == [s.strip() for s in STRINGS]


def _clean_reference(t):
    # expected behaviour stated as plain regex steps (stdlib re)
    if not t:
        return ""
    t = re.sub(r"\[(?:\d+|citation needed)\]", "", t, flags=re.IGNORECASE)
    t = re.sub("[ \t\u00a0]+", " ", t)
    t = re.sub(r"\n{3,}", "\n\n", t)
    return t.strip()


def test_clean_text_markers_spaces_newlines(spark):
    samples = [
        "Alpha [12] beta [Citation Needed] gamma.",
        "tabs\t\tand  nbsp\u00a0\u00a0 runs",
        "para\n\n\n\n\nnext\n\nkept",
        "  [1][2][3]  ",
        None,
        "[x] not a marker, [ 1 ] neither",
        "digits ٣٤ in brackets [٣٤]",
    ]
    got = [r[0] for r in _col(spark, samples).select(T.clean_text("t")).collect()]
    assert got == [_clean_reference(s) for s in samples]


def test_preview_matches_textwrap(spark):
    words = "one two three four five six seven eight nine ten eleven twelve".split()
    samples = [" ".join(words[:i]) for i in range(1, 13)] + [
        "short", "line one\nline two\n\nline  three", "x" * 30 + " tail", "a " * 40]
    for width in (10, 16, 25):
        got = [r[0] for r in _col(spark, samples).select(T.preview("t", width)).collect()]
        want = [textwrap.shorten(s.replace("\n", " "), width=width, placeholder="…") for s in samples]
        assert got == want, width


def test_quote_path_matches_urllib(spark):
    titles = ["Linear algebra", "C++ (language)", "Ünïcödé/slash", "a*b~c", "100% & more",
              "tab\there", "emoji 😀", "Q&A: why?"]
    got = [r[0] for r in _col(spark, titles).select(T.title_slug("t")).collect()]
    assert got == [quote(t.replace(" ", "_")) for t in titles]


def test_page_and_section_url(spark):
    df = spark.createDataFrame([("Linear algebra", "en", "Vector spaces"), ("Topic", "fr", None),
                                ("Topic", "de", "")], "t string, lang string, s string")
    rows = df.select(T.section_url(T.page_url("t", "lang"), F.col("s"))).collect()
    assert [r[0] for r in rows] == [
        "https://en.wikipedia.org/wiki/Linear_algebra#Vector_spaces",
        "https://fr.wikipedia.org/wiki/Topic",
        "https://de.wikipedia.org/wiki/Topic",
    ]


class _Text(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts, self.skip = [], 0

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.skip += 1

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.skip -= 1

    def handle_data(self, data):
        if not self.skip and data.strip():
            self.parts.append(data.strip())


def _visible(markup):
    p = _Text()
    p.feed(markup)
    return " ".join(" ".join(p.parts).split())


PAGE = ("<!DOCTYPE html><html lang=\"fr\"><head><title>Cafe &amp; Co</title>"
        "<style>p{margin:0}</style><script>var t=\"</p>\";</script></head><body>"
        "<nav><a href=\"/x\">Home</a></nav><!-- ad --><article><h1>Title &quot;q&quot;</h1>"
        "<p>First <b>bold</b> para &copy; 2020 &middot; end.</p><p>Second\n  para</p></article>"
        "<footer>&copy; foot</footer></body></html>")


def test_html_to_text_matches_parser(spark):
    got = _col(spark, [PAGE], "html").select(T.html_to_text("html")).first()[0]
    assert got == _visible(PAGE)
    assert "var t" not in got and "margin" not in got and "ad" not in got.split()


def test_html_title_and_entities(spark):
    got = _col(spark, [PAGE], "html").select(T.html_title("html")).first()[0]
    assert got == "Cafe & Co"
    assert html.unescape("&amp;quot;") == "&quot;"
    once = _col(spark, ["&amp;quot;"]).select(T.unescape_entities("t")).first()[0]
    assert once == "&quot;"


class _Nodes(_Text):
    def handle_data(self, data):
        if not self.skip and data.strip():
            self.parts.append(data.strip())


def test_html_text_nodes_keep_inner_whitespace(spark):
    page = PAGE.replace("<p>Second\n  para</p>", "<p>Second\n  para &amp;  more</p>")
    got = _col(spark, [page], "html").select(T.html_to_text("html", collapse=False)).first()[0]
    p = _Nodes()
    p.feed(page)
    assert got == " ".join(p.parts)
    assert "Second\n  para &  more" in got
