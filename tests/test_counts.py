"""Counts in texts: against the shuffled operators, with topics of one text and of several."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import diff, multiset

TEXTS = [
    (1, "The `cat` sat, the cat ran.\nThe dog; the dog\n\n- a cat", "The cat sat\n- a cat", "the dog"),
    (2, "x y y y\nx y\nx y\n  \nx y\ny x", "x", "y"),
    (2, "y x x x!\nx y y", "y", None),
    (3, "same words", "same words", "same words"),
    (4, None, "a", "b"),
    (None, "Été 5 5\nb b b", "5", "b"),
    (None, "b b", "", ""),
    (5, "q q q\nq q\nq q q\nq w q\nw w", "", ""),
]


def given(spark, texts=TEXTS):
    return spark.createDataFrame(texts, "t int, text string, md string, html string").repartition(3)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def exchanges(df) -> int:
    return len(re.findall(r"\bExchange\b", df._jdf.queryExecution().executedPlan().toString()))


def shuffled(df, html="html"):
    md, out = (multiset.occurrences(df, "t", T.words(c), "word") for c in ("md", html))
    return multiset.word_deficits(multiset.drawn_words(df, "t"), md, out, "t")


def counted(df):
    return multiset.text_counts(df, "t", "text", ["md", "html"])


def deficits(df):
    return multiset.shortfalls(counted(df).withColumnsRenamed({"md": "emitted_markdown", "html": "emitted_html"}), "t")


def test_regressions_of_counts_in_texts(spark):
    df = given(spark).withColumn("before", F.lit("cat dog y x b q w"))
    now = multiset.text_counts(df, "t", "text", ["md", "before", "html"])
    two = now.select("t", "word", *(multiset.unaccounted("md", c).alias(n) for c, n in (("before", "before"), ("html", "now"))))
    want = diff.regressions(shuffled(df, "before"), shuffled(df), ["t", "word"], "unaccounted")
    keyed = lambda x: found(x.where("t is not null"))  # a join of the old way loses null keys
    assert keyed(diff.grown(two, ["t", "word"])) == keyed(want) != []


def test_single_texts_are_counted_without_a_shuffle(spark):
    df = given(spark, [r for r in TEXTS if r[0] in (1, 3, 5)])
    assert exchanges(deficits(df)) <= 1  # the test's own repartition
    assert found(deficits(df)) == found(shuffled(df)) != []


def test_deficits_and_totals_of_texts_that_share_a_topic(spark):
    df = given(spark)
    assert found(deficits(df)) == found(shuffled(df)) != []
    assert found(multiset.deficit_totals(deficits(df), "t")) == found(multiset.deficit_totals(shuffled(df), "t"))
    some = given(spark, [r for r in TEXTS if r[0] in (1, 3, 5)])
    assert exchanges(multiset.deficit_totals(deficits(some), "t")) <= 2  # of totals, and the test's own


def test_evidence_in_texts(spark):
    df = given(spark, [(*r[:2], "", "") for r in TEXTS if r[0] is not None])
    got = found(multiset.text_evidence(df, "t", "text", ["md", "html"], 0, 2))
    wanted = shuffled(df).where("unaccounted > 0")
    assert len(got) == wanted.count() and len({r[:2] for r in got}) == len(got)  # texts of one topic double no line
    single = df.where("t <> 2")
    assert [r for r in got if r[0] != 2] == found(multiset.evidence(single, wanted.where("t <> 2"), "t", most=2))
    assert (5, "q", "q q q | q q | +1 more lines") in got
    assert exchanges(multiset.text_evidence(single, "t", "text", ["md", "html"], 0)) <= 1  # the test's own repartition


def test_characters_and_units_in_texts(spark):
    df = given(spark)
    before, after = (multiset.characters(df, "t", c) for c in ("text", "md"))
    assert found(multiset.character_delta(df, "t", "text", "md")) == found(multiset.delta(before, after, ["t", "ch"])) != []
    drawn, left = (multiset.punctuation(df, "t", c) for c in ("text", "md"))
    lost = multiset.delta(drawn, left, ["t", "unit"]).where("lost > 0").select("t", "unit", "lost")
    units = multiset.punctuation_deficits(df, "t", "text", "md")
    assert found(units.select("t", "unit", "unaccounted")) == found(lost) != []
    one = df.where("t in (1, 5)")
    assert exchanges(multiset.character_delta(one, "t", "text", "md")) <= 1 and exchanges(multiset.punctuation_deficits(one, "t", "text", "md")) <= 1
