import struct

from pyspark.sql import functions as F

from quire.functions import controls as C
from quire.operators import sequences


def one(spark, expr, v):
    return spark.createDataFrame([(v,)], "v binary" if isinstance(v, (bytes, bytearray)) else "v string").select(expr.alias("x")).first()["x"]


def test_contents(spark):
    got = one(spark, C.contents_entries("v", False), "CTOCE 3 3.3.1 VSAM Data Sets ? CTOCE 1 INDEX Index")
    assert [(e.id, e.style, e.title) for e in got] == [("3.3.1", 3, "VSAM Data Sets"), ("INDEX", 1, "Index")]
    got = one(spark, C.contents_entries("v", True), "CTOCE 2 1 a.b Some title CTOCE x")
    assert [(e.nesting, e.style, e.id, e.title) for e in got] == [(2, 1, "A.B", "Some title")]
    assert one(spark, C.contents_entries("v", True), "nothing") == []


def test_headers(spark):
    a, b = ", SHABSTRACT, CTOPIC# 1. CPARENT ?library CFORWARDLEVEL TITLE", ", shcover, ctopicn 1. cparent ? cforwardlevel TITLE"
    assert [one(spark, C.topic_id("v"), x) for x in (a, b, "text")] == ["ABSTRACT", "COVER", None]
    assert [one(spark, C.topic_parent("v"), x) for x in (a, b, "text")] == ["LIBRARY", "", None]
    assert [one(spark, C.topic_number("v"), x) for x in (a, "text")] == [1, None]


def test_fonts(spark):
    assert [tuple(t) for t in one(spark, C.font_triples("v"), "3 4 C 9 1 D,")] == [(3, 4, "C"), (9, 1, "D")]
    assert [one(spark, C.font_triples("v"), x) for x in ("3 4", "3 0 C", "", "a 1 C")] == [None] * 4
    assert tuple(one(spark, C.font_definitions("v"), "cfontdef c bold italic")) == ("C", "bold italic")
    assert one(spark, C.font_definitions("v"), "cfont 1 2 C") is None


def test_media(spark):
    assert tuple(one(spark, C.display_size("v"), bytearray(b"GIF89a" + struct.pack("<HH", 300, 2)))) == (300, 2)
    assert tuple(one(spark, C.display_size("v"), bytearray(b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR" + struct.pack(">II", 7, 70_000)))) == (7, 70_000)
    assert one(spark, C.display_size("v"), bytearray(b"GIF89a\0\0\0\0")) is None and one(spark, C.display_size("v"), bytearray(b"x")) is None


def test_index_terms(spark):
    got = one(spark, C.index_terms("v"), "citerm /apples/1/2.1/3.4 citerm |pears|2|")
    assert [(t.term, t.level, t.targets) for t in got] == [("apples", 1, ["2.1", "3.4"]), ("pears", 2, [])]


def test_sequences(spark):
    df = spark.createDataFrame([(["a", "b", "c"], ["a", "x", "c", "d"]), (None, ["q"])], "a array<string>, b array<string>")
    got = [[(d.op, d.before, d.after) for d in r.d] for r in df.select(sequences.difference("a", "b").alias("d")).collect()]
    assert got == [[("replace", ["b"], ["x"]), ("insert", [], ["d"])], [("insert", [], ["q"])]]
    f = spark.createDataFrame([("t", 1, 0, "ab", False), ("t", 1, 4, "c", False), ("t", 1, 1, "  ", True), ("t", 2, 0, "ab", False), ("t", 2, 1, "z", False)], "topic string, row int, column int, text string, padding boolean")
    assert {(r.row, r.text, r.conflict) for r in sequences.fixed_rows(f, ["topic"]).collect()} == {(1, "ab  c", False), (2, None, True)}
    c = spark.createDataFrame([(1, "text"), (1, "text"), (2, "text"), (2, "control")], "cell int, d string")
    assert {(r.cell, r.d, r.conflict) for r in sequences.ownership(c, ["cell"], "d").collect()} == {(1, "text", False), (2, None, True)}
    t = spark.createDataFrame([("t", 1), ("t", 2), ("u", 1)], "topic string, tok int")
    r = t.where(F.col("tok") == 1)
    assert [tuple(x) for x in sequences.unaccounted(t, r, ["topic", "tok"], ["topic"]).collect()] == [("t", 1)]


def test_font_operands_are_split_once(spark):
    """Each use of a part in a lambda trimmed and split the operands again."""
    operands = " ".join(f"{k} {k + 1} B" for k in range(60))
    df = spark.createDataFrame([(operands,), (None,)], "x string").select(C.font_triples("x").alias("v"))
    assert df._jdf.queryExecution().optimizedPlan().expressions().toString().count("trim(x#") == 1
    assert [r.v and [tuple(t) for t in r.v] for r in df.collect()] == [[(k, k + 1, "B") for k in range(60)], None]
