from pyspark.sql import functions as F

from quire.operators import reports


def test_round_trip_and_faults(spark, tmp_path):
    path = str(tmp_path / "r")
    rows = [tuple(["t\t1", "route", "alpha", "1", "3", "1", "2", "a\\b", "1", "2", "1", "2"]), tuple(["t", "r", "si", "1", "0", "0", "0", "", "0", "0", "0", "0"])]
    df = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in reports.CONSERVATION))
    reports.write(df, path, reports.CONSERVATION)
    back = reports.read(spark, path, reports.CONSERVATION)
    assert sorted(tuple(r)[:-1] for r in back.collect()) == sorted(rows) and back.where("fault is not null").count() == 0
    assert reports.conservation_faults(back).count() == 0
    assert reports.conservation_faults(back.withColumn("unaccounted", F.lit("9"))).count() == 2


def test_strict_reader(spark, tmp_path):
    (tmp_path / "c.tsv").write_text("\t".join(reports.COVERAGE) + "\n" + "\t".join(["x"] * 14) + "\n" + "\t".join(["x"] * 13) + "\n" + "\t".join(["\\q"] + ["x"] * 13) + "\n# severity typed=2 failed=1\n")
    out = reports.read(spark, str(tmp_path / "c.tsv"), reports.COVERAGE)
    assert sorted(str(r.fault) for r in out.collect()) == ["None", "escape", "fields"]
    assert {r.key: r.n for r in reports.totals(spark, str(tmp_path / "c.tsv"), "severity").collect()} == {"typed": 2, "failed": 1}
    ranks = spark.createDataFrame([("typed",), ("failed",), ("x",)], "s string").select(reports.severity_rank("s").alias("r"))
    assert [r.r for r in ranks.collect()] == [3, 0, -1]


def test_faults_of_whole_reports(spark, tmp_path):
    def told(name, f, *lines):
        (tmp_path / name).write_text("\n".join(lines) + "\n")
        return sorted(r.fault for r in f(spark, str(tmp_path / name)).collect())

    def row(columns, **has):
        return "\t".join(has.get(c, "1") for c in columns)

    head, one = "\t".join(reports.COVERAGE), lambda **has: row(reports.COVERAGE, **({"severity": "typed"} | has))
    good = one(id="a"), one(id="b", severity="failed"), "# summary topics=2", "# severity typed=1 failed=1"
    assert told("a.tsv", reports.coverage_faults, head, *good) == []
    assert told("b.tsv", reports.coverage_faults, *good) == ["header"]
    assert told("c.tsv", reports.coverage_faults, head, head, good[0], *good) == ["header", "repeated", "total"]
    assert told("d.tsv", reports.coverage_faults, head, one(id="x", level="-1", source_start="9", severity="odd"), "# severity odd=1") == ["number", "range", "severity"]
    head, one = "\t".join(reports.CONSERVATION), lambda **has: row(reports.CONSERVATION, **({"drawn_inline": "3", "emitted": "1", "unaccounted": "2", "unaccounted_markdown": "2", "unaccounted_html": "2"} | has))
    good = one(word="u"), one(word="v"), "# summary rows=2 unaccounted=4"
    assert told("e.tsv", reports.conservation_report_faults, head, *good) == []
    assert told("f.tsv", reports.conservation_report_faults, head, good[0], good[0], "# summary rows=3") == ["repeated", "total"]
    assert told("g.tsv", reports.conservation_report_faults, head, one(word="w", unaccounted="7"), one(word="z", emitted="x")) == ["counts", "counts", "number"]


def test_json(spark):
    df = spark.createDataFrame([('{"a": 1}',), ("{",), (None,)], "x string").select(reports.json_valid("x").alias("v"))
    assert [r.v for r in df.collect()] == [True, False, False]
