import duckdb
import pytest
from pyspark.sql import functions as F

from quire.operators import catalog, diff, intervals, links, multiset, search, shelf
from quire.plans import registry

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def same(x):
    return None if x is None else round(float(x), 9) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x) if not isinstance(x, bool) else x


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_against_sql(spark, name):
    db = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        db.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    df = registry.QUERIES[name](spark, SF)
    got = db.execute(registry.ORACLES[name])
    columns = [d[0] for d in got.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted((tuple(map(same, r)) for r in got.fetchall()), key=repr)
    assert sorted((tuple(map(same, r)) for r in df.select(*columns).collect()), key=repr) == want


@pytest.mark.parametrize("name", sorted(registry.QUERIES.keys() - registry.ORACLES.keys()))
def test_query_runs(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


def test_nesting_declines(spark):
    nodes = [("b", "3", ""), ("b", "3.3", "3"), ("b", "3.3.1", "3.3"), ("b", "x", "9.9"), ("b", "n", None), ("b", "p", "q"), ("b", "q", "p"), ("b", "s", "s")]
    df = spark.createDataFrame(nodes, "book string, id string, parent string")
    out = {r.id: r.depth for r in catalog.nesting(df, "id", "parent", ["book"]).collect()}
    assert out == {"3": 0, "3.3": 1, "3.3.1": 2, "x": None, "n": None, "p": None, "q": None, "s": None}
    toc = df.join(catalog.nesting(df, "id", "parent", ["book"]), ["book", "id"])
    assert catalog.all_or_nothing(toc, ["book"], "depth").count() == 0


def test_catalog_faults(spark):
    t = spark.createDataFrame([("a",), ("A",), ("",), ("b",)], "topic_id string")
    assert rows(catalog.catalog_faults(t)) == [("", "empty id"), ("A", "duplicate id")]


def test_deficits(spark):
    drawn = spark.createDataFrame([(1, "alpha", 1, 3), (1, "si", 1, 0)], "t int, word string, drawn_opening long, drawn_inline long")
    out = spark.createDataFrame([(1, "alpha", 1)], "t int, word string, n long")
    got = {r.word: (r.emitted, r.unaccounted) for r in multiset.word_deficits(drawn, out, out, "t").collect()}
    assert got == {"alpha": (1, 2), "si": (0, 0)}


def test_ratchet_has_no_allowance(spark):
    b = spark.createDataFrame([("t", "a", 1), ("t", "b", 5)], "topic string, word string, n long")
    c = spark.createDataFrame([("t", "a", 2), ("t", "b", 0), ("t", "c", 1)], "topic string, word string, n long")
    assert rows(diff.regressions(b, c, ["topic", "word"], "n")) == [("t", "a", 1, 2, 1), ("t", "c", 0, 1, 1)]
    assert rows(diff.snapshot_diff(b, c, ["topic", "word"], ["n"])) == [("t", "a", "changed", 1, 2), ("t", "b", "changed", 5, 0), ("t", "c", "unexpected", None, 1)]
    assert diff.same_set(b, b, ["word"]).count() == 0


def test_intervals(spark):
    df = spark.createDataFrame([(1, 0, 2), (1, 2, 4), (1, 6, 6), (1, 7, 9), (2, 0, 1)], "k int, begin long, end long")
    assert rows(intervals.merged(df, ["k"])) == [(1, 0, 4), (1, 7, 9), (2, 0, 1)]
    assert intervals.overlaps(df, df, ["k"], 3).count() == 4
    assert intervals.merged(df.limit(0), ["k"]).count() == 0 and intervals.overlaps(df.limit(0), df, ["k"], 3).count() == 0
    pages = spark.createDataFrame([("b", k, c) for k, c in enumerate([1, 1, None, None, 2, 1])], "book_id string, page_no int, page_class int")
    assert [tuple(r) for r in intervals.page_runs(pages).orderBy("run").collect()] == [("b", 1, 1, 0, 1, 2), ("b", 2, None, 2, 3, 2), ("b", 3, 2, 4, 4, 1), ("b", 4, 1, 5, 5, 1)]


def test_overlaps_of_any_length_by_brute_force(spark):
    import random

    random.seed(3)
    some = lambda n: [(random.randrange(2), b, b + random.choice([0, 1, 2, 5, 40, 700, 20_000])) for b in (random.randrange(-900, 3000) for _ in range(n))]
    x, y = some(60), some(50)
    a, b = (spark.createDataFrame(v, "k int, begin long, end long") for v in (x, y))
    want = sorted((k, b1, e1, b2, e2) for k, b1, e1 in x for q, b2, e2 in y if k == q and b1 < e2 and b2 < e1 and b1 < e1 and b2 < e2)
    assert sorted(tuple(r) for r in intervals.overlaps(a, b, ["k"], 3).select("k", "a_begin", "a_end", "b_begin", "b_end").collect()) == want


def test_places_and_neighbours_of_a_part_over_many_ranges(spark):
    values = [(None if i % 5 == 0 else "hot" if i % 5 < 4 else f"s{i}", (i * 37) % 101) for i in range(101)]
    df = spark.createDataFrame(values, "part string, v int")
    groups = {p: sorted(v for q, v in values if q == p) for p in {q for q, _ in values}}
    placed = {(r.part, r.v): r.place for r in intervals.placed(df, ["part"], [F.col("v")], "place").collect()}
    beside = {(r.part, r.v): (r.previous, r.next) for r in intervals.neighbours(df, ["part"], "v", "v").collect()}
    for p, own in groups.items():
        for k, v in enumerate(own):
            assert placed[p, v] == k + 1 and beside[p, v] == (own[k - 1] if k else None, own[k + 1] if k + 1 < len(own) else None)


def test_medians_by_sorting(spark):
    import random

    random.seed(7)
    parts = {p: [random.choice([random.random(), float(random.randrange(4))]) for _ in range(n)] for p, n in (("a", 1), ("b", 2), ("c", 31), ("d", 30_000))}
    df = spark.createDataFrame([(p, v) for p, x in parts.items() for v in [*x, None]], "p string, v double")
    assert {r.p: (r.median, r.n) for r in shelf.upper_median(df, ["p"], "v").collect()} == {p: (sorted(x)[len(x) // 2], len(x)) for p, x in parts.items()}


def test_links(spark):
    t = spark.createDataFrame([("b", 1, "X", "figure", "d1"), ("b", 2, "X", "table", "d2")], "book string, ord int, anchor string, kind string, dest string")
    assert rows(links.link_map(t, ["book"])) == [("b", "FIGX", "d1"), ("b", "TBLX", "d2"), ("b", "X", "d1")]
    assert ("b", "X", "d2") in rows(links.link_map(t, ["book"], last_wins=True))
    r = spark.createDataFrame([("topic", "a", None), ("anchor", "a", None), ("topic", "a", ""), ("external", "javascript:x", None), ("other", "x", None), ("topic", "a", "u")], "kind string, value string, resolved string")
    assert [x.href for x in links.rendered_targets(r).collect()] == ["a", "#a", "#", "#", "#", "u"]
    blocks = spark.createDataFrame([("t", 1, "anchor", "a", None), ("t", 2, "thematic_break", None, None), ("t", 3, "figure", None, "r"), ("t", 4, "anchor", "b", None), ("t", 5, "paragraph", None, None), ("t", 6, "figure", None, "s")], "t string, ord int, kind string, anchor string, resource string")
    assert rows(links.figure_anchors(blocks, ["t"], "ord")) == [("t", "a", "r")]


def test_menus_are_checked_against_their_own_book(spark):
    items = spark.createDataFrame(
        [("b1", "m1", "A", "one"), ("b1", "m1", "zz", "two"), ("b1", "m2", "a", " ONE  topic"), ("b1", "m3", "only2", "x"), ("b2", "m3", "only2", "x"), ("b2", "m4", "ONLY2", "Second title")],
        "book string, menu string, target string, label string",
    )
    cat = spark.createDataFrame([("b1", "A", "One topic", None), ("b2", "ONLY2", "First title", "second title")], "book string, folded_id string, topic_title string, toc_title string")
    fine = lambda *label: sorted((r.book, r.menu) for r in links.menus_valid(items, cat, ["menu"], ["book"], *label).collect())
    assert fine() == [("b1", "m2"), ("b2", "m3"), ("b2", "m4")]
    assert fine("label") == [("b1", "m2"), ("b2", "m4")]


def test_search(spark):
    body = "x" * 60 + "Needle " + "y" * 100
    df = spark.createDataFrame([(1, "t", body), (2, "a NEEDLE", "no"), (3, None, None), (4, "t", "needle")], "id int, title string, body string")
    out = {r.id: r.snippet for r in search.search(df, "needle", ["id"], "title", "body").collect()}
    assert out == {1: body[15:125], 2: "a NEEDLE", 4: "needle"}
    assert search.search(df, "", ["id"], "title", "body").count() == 0
    accents = spark.createDataFrame([(1, "t", "un Élève")], "id int, title string, body string")
    assert search.search(accents, "eleve", ["id"], "title", "body", "UNICODE_CI_AI").count() == 1


def test_shelf(spark, tmp_path):
    for n in ("b.BOO", "a.boo", ".x.boo", "c.txt"):
        (tmp_path / n).write_bytes(b"1234")
    assert sorted(r.name for r in shelf.listing(spark, str(tmp_path)).collect()) == ["a.boo", "b.BOO"]
    df = spark.createDataFrame([("s", "a"), ("s", "b")], "k string, v string")
    turned = spark.createDataFrame([("s", "b"), ("s", "a")], "k string, v string")
    assert rows(shelf.signature(df, ["k"], ["v"])) == rows(shelf.signature(turned, ["k"], ["v"])) != rows(shelf.signature(df.limit(1), ["k"], ["v"]))
    m = spark.createDataFrame([(1, 4.0), (1, 1.0), (1, 3.0), (1, 2.0)], "k int, v double")
    assert rows(shelf.upper_median(m, ["k"], "v")) == [(1, 3.0, 4)]


def test_stream(spark, tmp_path):
    from quire.streaming import refresh

    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    for n, value in enumerate(("old", "new")):
        spark.createDataFrame([("a", n, value), (f"b{n}", n, value)], "id string, stamp int, v string").coalesce(1).write.mode("append").parquet(source)
        q = refresh.shelf_stream(spark, source, "id string, stamp int, v string").writeStream.foreachBatch(refresh.store_batches(target)).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
    assert rows(refresh.latest(spark, target, "id", "stamp").select("id", "v")) == [("a", "new"), ("b0", "old"), ("b1", "new")]
