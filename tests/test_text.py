import pytest
from pyspark.sql import functions as F

from quire.functions import text as T


def one(spark, expr, **columns):
    df = spark.createDataFrame([tuple(columns.values())], ", ".join(f"{k} {'string' if isinstance(v, (str, type(None))) else 'binary' if isinstance(v, (bytes, bytearray)) else 'array<int>'}" for k, v in columns.items()))
    return df.select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "function, given, wanted",
    [
        (T.ascii_lower, "ABC É İ", "abc É İ"),
        (T.trim_right_spaces, "a \t  ", "a \t"),
        (T.trim_ascii_whitespace, "\x01 a b\t\n", "a b"),
        (T.trim_ascii, "?? a? b ?", "a? b"),
        (T.collapse_whitespace, " a \t\n b? ", "a b"),
        (T.capitalized, "user guide-for as/400 (new) 3d", "User Guide-For As/400 (New) 3d"),
        (T.toc_title, "the guide TO as/400-and-more <IMAGE> :", "The Guide to AS/400-and-More"),
        (T.toc_title, "a user id and ocl", "A User ID and OCL"),
        (T.file_stem, "The Guide / To: X!", "the-guide-to-x"),
        (T.clean_snippet, "see [the `x`](u) \\* and  **b**", "see the x and b"),
        (T.code_span, "a``b", "```a``b```"),
        (T.markdown_escape, "a*b_[c]", "a\\*b\\_\\[c\\]"),
        (T.path_segment, "a%20b+c", "a b+c"),
        (T.path_segment, "%2e%2e", None),
        (T.path_segment, "a%2Fb", None),
        (T.path_segment, "%ff", None),
        (T.tsv_unescape, "a\\tb\\\\n", "a\tb\\n"),
        (T.tsv_unescape, "a\\x", None),
        (T.html_escape, "<a & b>", "&lt;a &amp; b&gt;"),
    ],
)
def test_strings(spark, function, given, wanted):
    assert one(spark, function("v"), v=given) == wanted


@pytest.mark.parametrize(
    "given, wanted",
    [("AX.25 Protocol", ["ax", "25", "protocol"]), ("`CLIST`s CLISTs", ["clists", "clists"]), ("**bold**word", ["boldword"]), ("FRONT\\_2 FRONT_2", ["front", "2", "front", "2"]), ("  ", []), ("é", [])],
)
def test_words(spark, given, wanted):
    assert one(spark, T.words("v"), v=given) == wanted


@pytest.mark.parametrize("given, wanted", [("Function=cc, Current time.", ["cc,", "time."]), ("PICAREAS . Each", []), ("is it? (yes) a: `b`; **c**!", ["yes)", "a:", "b;", "c!"])])
def test_units(spark, given, wanted):
    assert one(spark, T.punctuation_units("v"), v=given) == wanted


def test_numbers_and_lookups(spark):
    rows = spark.createDataFrame([("1.2.3",), ("1.0",), ("2",), ("A.1",)], "v string").select(T.numbered_depth("v").alias("d")).collect()
    assert [r.d for r in rows] == [2, 0, 0, 0]
    assert [one(spark, T.heading_depth("v"), v=x) for x in (":H1", ":H9", ":P", "")] == [0, 8, 0, 0]
    assert one(spark, T.token_words_text("v"), v=[0x41, 0xA0, 0xE9, 0x2500]) == "A é?"
    assert one(spark, T.fold_words("v", True), v=[0x61, 0xDF, 0xFF, 0xF7, 0xE9]) == [0x41, 0x53, 0xFF, 0xF7, 0xC9]
    assert one(spark, T.query_parameters("v"), v="a=1&b=x=y") == {"a": "1", "b": "x=y"}
    assert one(spark, T.query_parameters("v"), v="a=1&a=2") is None and one(spark, T.query_parameters("v"), v="a") is None
    assert one(spark, T.be_int("v", 1, 2), v=bytearray(b"\x01\x02\x03")) == 0x0203
    assert one(spark, T.be_int("v", 2, 2), v=bytearray(b"\x01\x02\x03")) is None
    assert [one(spark, T.safe_href("v"), v=x) for x in ("a/b", "HTTP://x", "javascript:x")] == [True, True, False]
    assert one(spark, T.control_value(F.lit("CDOCNUM"), "v"), v="sc41-x") == "SC41-X"
