from pyspark.sql import functions as F

from quire.operators import render

SCHEMA = "topic_id string, ord int, kind string, level int, text string, marker string, depth int, target string"
BLOCKS = [
    ("t", 2, "paragraph", None, "a <b>", None, None, None), ("t", 1, "heading", 2, "Head", None, None, None), ("t", 3, "list_item", None, "x", "1.", 1, None),
    ("t", 4, "preformatted", None, "a```b", None, None, None), ("t", 5, "thematic_break", None, None, None, None, None), ("t", 6, "menu_item", None, "go", None, None, "javascript:x"),
    ("t", 7, "note", None, "n", "Note", None, None), ("u", 1, "paragraph", None, None, None, None, None),
]


def test_render(spark):
    df = spark.createDataFrame(BLOCKS, SCHEMA)
    got = {r.topic_id: r.body for r in render.topics(df, render.markdown_block()).collect()}
    assert got == {"t": "## Head\n\na <b>\n\n  1. x\n\n````\na```b\n````\n\n---\n\n[go]".replace("[go]", "- [go](javascript:x)") + "\n\n> **Note:** n"}
    html = {r.topic_id: r.body for r in render.topics(df, render.html_block(), "").collect()}["t"]
    assert '<h2 class="doc-heading">Head</h2>' in html and "a &lt;b&gt;" in html and 'href="#"' in html and "javascript" not in html
    one = render.book(spark.createDataFrame([("b", 2, "y"), ("b", 1, "x"), ("b", 3, "")], "b string, ord int, body string"), ["b"], "ord").first().body
    assert one == "x\n\ny"
    assert spark.range(1).select(render.with_diagnostic(F.lit("b"), F.lit("failed"), F.lit("a--b")).alias("d")).first().d == "<!-- failed: a- -b -->\nb"
