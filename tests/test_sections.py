from pyspark.sql import functions as F

from folio.operators.sections import is_boilerplate, prune_boilerplate, prune_flat
from folio.sources.pages import capitalize_first, lookup_pages, page_sections

# (ord, level, title): a nested outline with boilerplate at several depths
OUTLINE = [
    (0, 1, "History"), (1, 2, "Early"), (2, 1, "See also"), (3, 2, "Child of see also"),
    (4, 3, "Grandchild"), (5, 1, "Usage"), (6, 2, " Notes "), (7, 3, "Deep note"),
    (8, 2, "Examples"), (9, 1, "REFERENCES"), (10, 1, "Further reading"), (11, 1, "Legacy"),
]


def _tree_walk(outline):
    """Expected result from an explicit tree: build the nesting, then walk
    parents before children, skipping boilerplate subtrees."""
    root = {"children": [], "level": 0}
    stack = [root]
    for o, lvl, t in outline:
        node = {"ord": o, "level": lvl, "title": t, "children": []}
        while stack[-1]["level"] >= lvl:
            stack.pop()
        stack[-1]["children"].append(node)
        stack.append(node)
    drop = {"references", "external links", "see also", "further reading", "notes", "sources",
            "bibliography"}
    out = []

    def walk(n):
        for c in n["children"]:
            if c["title"] and c["title"].strip().lower() in drop:
                continue
            out.append(c["ord"])
            walk(c)
    walk(root)
    return out


def test_prune_fold_and_window_equal_tree_walk(spark):
    arr = F.array(*[F.struct(F.lit(o).alias("ord"), F.lit(lv).alias("level"),
                             F.lit(t).alias("title"), F.lit("x").alias("text"))
                    for o, lv, t in OUTLINE])
    df = spark.range(1).select(F.lit(7).alias("page_id"), prune_boilerplate(arr).alias("s"))
    fold = [r.ord for r in df.select(F.inline("s")).collect()]
    flat = spark.createDataFrame([(7, o, lv, t) for o, lv, t in OUTLINE],
                                 "page_id long, ord int, level int, title string")
    window = [r.ord for r in prune_flat(flat).orderBy("ord").collect()]
    assert fold == _tree_walk(OUTLINE) == window == [0, 1, 5, 8, 11]


def test_is_boilerplate_null_title(spark):
    df = spark.createDataFrame([(None,), ("  Bibliography ",), ("Biblio",)], "t string")
    assert [r[0] for r in df.select(is_boilerplate("t")).collect()] == [False, True, False]


def test_page_lookup_exact_then_first_letter(spark):
    pages = spark.createDataFrame([(1, "DNA repair"), (2, "Linear algebra"), (3, "linear algebra")],
                                  "page_id long, title string")
    req = spark.createDataFrame([(1, "dNA repair"), (2, " linear algebra "), (3, "dna repair"),
                                 (4, "Linear algebra"), (5, "")], "rid long, topic string")
    got = {r.rid: (r.page_id, r.status) for r in lookup_pages(req, pages).collect()}
    assert got == {1: (1, "capitalized"), 2: (3, "exact"), 3: (None, "not found"),
                   4: (2, "exact"), 5: (None, "empty topic")}
    langs = spark.createDataFrame([(1, "Topic", "en"), (2, "Topic", "fr")],
                                  "page_id long, title string, lang string")
    req1 = spark.createDataFrame([(1, "topic")], "rid long, topic string")
    assert lookup_pages(req1, langs, lang="fr").first().page_id == 2
    assert lookup_pages(req1, langs).first().page_id == 1
    one = spark.createDataFrame([("éclair au chocolat",)], "t string")
    assert one.select(capitalize_first("t")).first()[0] == "Éclair au chocolat"


def test_page_sections_headings(spark):
    html = ("<html lang='en'><head><title>Page</title></head><body><article><h1>Page</h1>"
            "<p>Lead text.</p><h2>History</h2><p>Old</p><h3 id='x'>See also</h3><p>drop</p>"
            "<h2>See also</h2><p>gone</p><h4>Deeper</h4><p>gone too</p><h2>Use</h2><p>kept</p>"
            "</article></body></html>")
    pages = spark.createDataFrame([(1, "u", html.replace("'", '"'))], "page_id long, url string, html string")
    rows = page_sections(pages).orderBy("ord").collect()
    assert [(r.level, r.title, r.text) for r in rows] == [
        (0, None, "Lead text."), (1, "History", "Old"), (1, "Use", "kept")]
    assert rows[1].url == "https://en.wikipedia.org/wiki/Page#History"
    assert rows[0].url == "https://en.wikipedia.org/wiki/Page"


def test_flatten_tree_parent_pointers_equals_tree_walk(spark):
    from folio.operators.sections import flatten_tree
    # parent pointers from the outline's levels: nearest earlier section one level up
    parents, stack = [], []
    for o, lv, t in OUTLINE:
        while stack and stack[-1][1] >= lv:
            stack.pop()
        parents.append(stack[-1][0] if stack else None)
        stack.append((o, lv))
    # shuffle the input rows: order must come from ord, not row order
    rows = [(7, o, p, o, t) for (o, lv, t), p in zip(OUTLINE, parents)][::-1]
    df = spark.createDataFrame(rows, "page_id long, node int, parent int, ord int, title string")
    flat = flatten_tree(df).orderBy("pre").collect()
    assert [r.node for r in flat] == _tree_walk(OUTLINE)
    assert [r.level for r in flat] == [1, 2, 1, 2, 1]
