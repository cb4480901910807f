import random

import pytest
from pyspark.sql import functions as F

from quire.functions import grammar as G
from quire.functions import text as T
from quire.operators import structure


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def one(spark, value, f):
    return [r.v for r in spark.createDataFrame([(x,) for x in value], "x string").select(f("x").alias("v")).collect()]


def test_control_kinds(spark):
    words = {"SH9.2": "topic_start", "shore": "text", "CTOPIC#": "topic_number", "cparent.": "parent", "c.": "text", "C.SP": "spacing", "srTBL7": "table_start", "SRETBL,": "table_end", "srfig4": "structural", "SR": "text", "sr;x": "text", "cement": "text", "st": "title", "CEARTDESC": "art_description_end"}
    assert dict(zip(words, one(spark, words, G.control_kind), strict=True)) == words
    assert one(spark, ["select", "summary", "text", "menu_item"], G.operand_count) == [3, 3, 0, 1]


def test_segments_of_a_record(spark):
    got = one(spark, ["look CSELECT 3 9 st here ST A  title csummary a b", "", "plain words", "cparent"], G.control_segments)
    told = [[(s.kind, s.opcode, list(s.operands), s.payload) for s in x] for x in got]
    assert told == [
        [("text", None, [], "look"), ("select", "CSELECT", ["3", "9", "st"], "here"), ("title", "ST", [], "A title"), ("summary", "csummary", ["a", "b"], "")],
        [], [("text", None, [], "plain words")], [("parent", "cparent", [], "")],
    ]


def test_font_styles(spark):
    assert one(spark, ["7", "4", "T", "t", "K", "k", "_", "A", "??", ""], G.font_style) == ["hp7", "xph", "bold", "unknown", "italic", "italic", "underscore", "apl", "unknown", "unknown"]


def test_selector_links(spark):
    a = [["<Hdr>", "<X1>", "<>", "<AB-1>", "<02>", "<b>"], ["<TBL>", "<t>", "<>", "<D>", "<>", "<>", "<u>"], ["<image>", "<>", "</a.gif>", "</b>", "<>", "<>"], ["<image>", "<>", "<>", "<b>", "<>", "<>"], ["<Book>", "<>", "<>", "<>", "<>", "<>"], ["<other>", "<>"], ["other", "<>", "<>", "<x>", "<>", "<>"]]
    got = [r.v for r in spark.createDataFrame([(x,) for x in a], "x array<string>").select(G.selector_link("x").alias("v")).collect()]
    assert [(g.kind, g.destination, g.image) for g in got[:3]] == [("book_heading", "DOCNUM/AB-1/HDRX1", None), ("book_anchor", "DOCNUM/D/TBLt", None), ("external_image", "/b", "/a.gif")]
    assert all(g.error and g.kind is None and g.destination is None for g in got[3:])


def test_list_rows(spark):
    said = {" o next": True, "12) x": True, "1234) x": False, "B. x": True, "BC. x": False, "• y": True, "°": False, "- ": False, "(a) x": False, "*\tz": True}
    assert dict(zip(said, one(spark, said, G.list_item_row), strict=True)) == said


def grown(rng):
    """(text, what is left of it): words and blanks, with marks where one may stand; a mark leaves a blank unless one is there."""
    text, left = "", ""
    for _ in range(rng.randint(0, 8)):
        at_edge = not text or text[-1] == " "
        kind = rng.choice(["word", "blank", "selector", "heading", "filler", *(["line"] if at_edge else [])])
        if kind in ("word", "blank"):
            piece = rng.choice(["ab", "Z", "7", "x-y", "a/b", "it's"]) if kind == "word" else " "
            text, left = text + piece, left + piece
            continue
        tail = rng.choice(["w", "Q"])  # so that the blanks behind a mark end
        mark, after = {
            "selector": (rng.choice(["<>", "<Image>", "<INTERNET>", "<other>"]), tail), "heading": (rng.choice([":h1", ":H6"]), " " + tail),
            "filler": (rng.choice(["/  ", "///   "]), tail), "line": (rng.choice("$;()*!-':=") + rng.choice(["  ", " \t ", "\n\n"]), tail),
        }[kind]
        text += mark + after
        left += ("" if not left or left[-1] == " " else " ") + after
    return text, left


def test_line_marks(spark):
    rng = random.Random(21)
    known = [grown(rng) for _ in range(1500)]
    assert one(spark, [t for t, _ in known], G.without_line_marks) == [x for _, x in known]
    assert one(spark, ["a $", "a$", "- b", "end //", ":h9 x", "<imag>"], G.without_line_marks) == ["a ", "a$", "- b", "end //", ":h9 x", "<imag>"]
    assert one(spark, ["a?b ?", "who??", "(x)?? ", "?", " ? a", "x???"], G.dot_text) == ["a b ?", "who?", "(x)?", "?", "a", "x ?"]


def test_own_question_marks(spark):
    said = {"Why?": 1, "Why? Now": 1, "why? now": 0, "a?b": 0, " ?": 0, "so)? X": 1, "really??": 1, 'say "x"? :p': 0, "x? 9": 1}
    assert dict(zip(said, one(spark, said, G.literal_question_marks), strict=True)) == said


def test_places_of_a_needle(spark):
    assert one(spark, ["abABa", "", "xx", "aab"], lambda c: G.occurrences(c, "Ab")) == [[1, 3], [], [], [2]]
    assert one(spark, ["aaaa"], lambda c: G.occurrences(c, "aa")) == [[1, 3]] and one(spark, ["a"], lambda c: G.occurrences(c, "")) == [[]]


def test_codecs(spark):
    odd = ["a b/é~*+%", "", "-._~"]
    from urllib.parse import quote

    assert one(spark, odd, G.uri_encoded) == [quote(x, safe="-._~") for x in odd]
    assert one(spark, ["YWI=", "YWI", "Y*==", ""], lambda c: F.decode(G.base64_decoded(c), "UTF-8")) == ["ab", None, None, ""]
    uris = ["q://shelf/a%20b/c", "q://shelf/", "r://shelf/a", "q://shelf/a//b", "q://shelf/%2e%2e"]
    assert one(spark, uris, lambda c: G.resource_parts(c, "q")) == [["a b", "c"], None, None, None, None]
    df = spark.createDataFrame([("ab", "c"), ("a", "bc")], "x string, y string").select(G.cache_key(F.col("x"), F.col("y")).alias("k"))
    assert len({r.k for r in df.collect()}) == 2
    assert one(spark, ['W/"k", "z"', '"k"', "*", '"x"', None], lambda c: G.not_modified(c, F.lit("k"))) == [True, True, True, False, False]


def test_structure_of_topics(spark):
    segments = spark.createDataFrame(
        [("a", 2, "heading_level", "x", [" :TOC "], False), ("a", 5, "heading_level", "x", [":h1"], False), ("b", 1, "select", "x", [], True), ("b", 2, "structural", "SRFIG1", [], False), ("b", 3, "structural", "sr1", [], None), ("c", 1, "select", "x", [], None), ("c", 2, "table_start", "x", [], None), ("d", 1, "font", "x", [], None)],
        "t string, ord int, kind string, opcode string, operands array<string>, image boolean",
    )
    lines = spark.createDataFrame([("b", "1. one"), ("b", "two"), ("c", "x"), ("index", "y"), ("e", "plain")], "t string, text string")
    pure = segments.where("t <> 'b' or kind <> 'x'")
    out = {r.t: r for r in structure.classified(structure.structure_counts(pure, lines, ["t"]), "t").collect()}
    assert out["a"]["class"].startswith("generated") and out["a"].heading == ":toc" and out["index"]["class"].startswith("generated")
    assert (out["b"].signature, out["b"].figures, out["b"].image_selectors, out["b"].others, out["b"].lists) == ("lists+figures", 1, 1, 1, 1) and out["b"]["class"] == "mixed"
    assert out["c"].signature == "tables+selectors" and out["d"]["class"] == "title only (no body rows)" and out["e"]["class"] == "heading + prose paragraphs only"


def test_pictures_rows_steps_and_declarations(spark):
    s = spark.createDataFrame([("b", 1, ["1", "2", "Pic1"], ""), ("b", 2, ["1"], " <IMAGE> x"), ("c", 3, ["1", "2", "pic1"], None)], "book string, n int, operands array<string>, payload string")
    r = spark.createDataFrame([("b", "PIC1")], "book string, resource_id string")
    assert {x.n for x in structure.picture_selectors(s, r, ["book"]).where("image").collect()} == {1, 2}
    f = spark.createDataFrame([("p", k, *x) for k, x in enumerate([("border", "q", ""), ("continuation", "a", ""), ("spacer", "z", "z"), ("continuation", "", "b"), ("row_start", "c", None), ("continuation", "d", "e"), ("row_start", "", "")])], "p string, o int, kind string, l string, r string")
    assert rows(structure.form_rows(f, ["p"], "o", ["l", "r"])) == [("p", 1, "a", "b"), ("p", 2, "c<br>d", "e"), ("p", 3, "", "")]
    n = spark.createDataFrame([(1, 1, 1, "a", True), (1, 2, 2, "a", True), (1, 3, 4, "a", True), (1, 4, 5, "b", True), (1, 5, 6, "b", False), (2, 1, 1, "a", True)], "t int, o int, n int, g string, ok boolean")
    assert [r.o for r in structure.numbered_steps(n, ["t"], "o", "n", "g", F.lit(False), F.col("ok")).orderBy("o").collect()] == [1, 2]
    d = spark.createDataFrame([("b", [" ", "CREVDESC", "|"]), ("b", ["crevdesc", "+", "x"]), ("b", ["crevdesc", "ab"]), ("b", ["other", "!"]), ("b", ["crevdesc", "|"])], "b string, words array<string>")
    assert rows(structure.declared_characters(d, ["b"])) == [("b", ["+", "|"])]
    t = spark.createDataFrame([("t", "anchor", "a")], "t string, kind string, id string")
    assert rows(structure.with_named_destinations(t, spark.createDataFrame([("t", "z"), ("t", "")], "t string, id string"), ["t"])) == [("t", "anchor", "a"), ("t", "anchor", "z")]
    big = spark.range(500).selectExpr("cast(id as string) as name")
    assert rows(structure.sampled(big, "name", 20, 7)) == rows(structure.sampled(big.repartition(5), "name", 20, 7)) != rows(structure.sampled(big, "name", 20, 8))


@pytest.mark.parametrize("n", [0, 3])
def test_empty_tables(spark, n):
    e = spark.createDataFrame([(None, None, None, None)] * n, "p string, o int, kind string, l string")
    assert structure.form_rows(e, ["p"], "o", ["l"]).count() == 0


def test_carried_selection(spark):
    rows = [
        ("b", 1, 0, "text", "x"), ("b", 1, 1, "select", ""), ("b", 1, 2, "font", ""),  # a trailing empty font is passed over
        ("b", 2, 0, "select", "line"), ("b", 3, 0, "select", ""), ("b", 5, 0, "text", "x"),  # record 4 is not there
        ("c", 1, 0, "font", ""), ("c", 2, 0, "text", None),
    ]
    df = spark.createDataFrame(rows, "book string, record long, ord int, kind string, payload string")
    got = {(r["book"], r["record"]): r["carried"] for r in structure.carried_selection(df, ["book"], "record", "ord").collect()}
    assert got == {("b", 1): False, ("b", 2): True, ("b", 3): False, ("b", 5): False, ("c", 1): False, ("c", 2): False}
    assert structure.carried_selection(df.limit(0), ["book"], "record", "ord").count() == 0


def test_drawn_cells(spark):
    cells = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (1, 2, "b"), (2, 1, None)], "record int, token int, word string")
    controls = spark.createDataFrame([(1, 1, True), (1, 2, False), (2, 1, None)], "record int, token int, proven boolean")
    left = sorted((r["record"], r["token"]) for r in structure.drawn_cells(cells, controls, ["record", "token"]).collect())
    assert left == [(1, 2), (1, 2), (2, 1)]


def test_identified_heading(spark):
    rows = [("N1", "Notices", "N1 Notices"), ("NOTICES", " Notices?", " Notices?"), ("", "Title", "Title"), (None, None, ""), ("3.1", "", "3.1"), ("3.1", None, "3.1")]
    df = spark.createDataFrame(rows, "i string, t string, want string").withColumn("got", G.identified_heading("i", "t"))
    assert [r["got"] for r in df.collect()] == [r["want"] for r in df.collect()]
    styled = spark.createDataFrame([("A", "a")], "i string, t string").select(G.identified_heading("i", "t", F.lit(False)).alias("h"))
    assert styled.first()["h"] == "A a"


def test_escaped_fields(spark):
    texts = ["a\\b", "tab\there", "line\nend\r", "\\t", "", "plain"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.tsv_escape("t").alias("e"), T.tsv_unescape(T.tsv_escape("t")).alias("back"))
    for r in df.collect():
        assert r["back"] == r["t"]
        assert not any(c in r["e"] for c in "\t\r\n")


def test_segments_of_a_long_record_are_split_once(spark):
    """Each use of the words in a lambda split and classified the whole record again."""
    record = "lead " + " ".join(f"CPARENT {k} text{k}" for k in range(40))
    df = spark.createDataFrame([(record,), (None,), ("CPARENT 1",)], "x string").select(G.control_segments("x").alias("v"))
    assert df._jdf.queryExecution().optimizedPlan().expressions().toString().count("split(x#") == 1
    got = [r.v for r in df.collect()]
    assert [r["payload"] for r in got[0]] == ["lead", *(f"text{k}" for k in range(40))] and got[1] is None
    assert [tuple(r) for r in got[2]] == [("parent", "CPARENT", ["1"], "")]
