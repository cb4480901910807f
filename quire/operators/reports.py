"""Tab-separated reports: strict readers, writers, and consistency checks; JSON text with numbers kept as written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text as T

# The columns of the two reports, and the order of severities.
COVERAGE = ("id", "level", "route", "family", "reason", "class", "signature", "severity", "degraded", "declined", "source_kind", "source_index", "source_start", "source_end")
CONSERVATION = ("topic", "route", "word", "drawn_opening", "drawn_inline", "emitted", "unaccounted", "evidence", "emitted_markdown", "unaccounted_markdown", "emitted_html", "unaccounted_html")
SEVERITIES = ("failed", "best-effort", "typed-degraded", "typed")


def read(spark: SparkSession, path: str, columns: tuple[str, ...]) -> DataFrame:
    """(columns..., fault): the rows of a report, unescaped; a row with another number of fields or a bad escape has a fault."""
    lines = spark.read.text(path).where("not startswith(value, '#') and value <> ''").withColumn("f", F.split("value", "\t"))
    lines = lines.where(F.col("value") != "\t".join(columns))
    fields = [T.tsv_unescape(F.try_element_at("f", F.lit(k + 1))).alias(c) for k, c in enumerate(columns)]
    wrong = F.when(F.size("f") != len(columns), "fields").when(F.exists("f", lambda x: T.tsv_unescape(x).isNull()), "escape")
    return lines.select(*fields, wrong.alias("fault"))


def totals(spark: SparkSession, path: str, section: str) -> DataFrame:
    """(key, n) of a report's comment rows such as `# severity a=1 b=2`."""
    row = spark.read.text(path).where(F.startswith("value", F.lit(f"# {section}")))
    pairs = F.regexp_extract_all("value", F.lit("([^ \t=]+)=([0-9]+)"), 0)
    return row.select(F.explode(pairs).alias("p")).select(F.substring_index("p", "=", 1).alias("key"), F.substring_index("p", "=", -1).cast("long").alias("n"))


def _repeated(df: DataFrame, key: tuple[str, ...]) -> DataFrame:
    many = df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return many.select(F.lit("repeated").alias("fault"), F.concat_ws(" ", *key).alias("where"))


def _headed(spark: SparkSession, path: str, columns: tuple[str, ...]) -> DataFrame:
    """A fault for each file of a report whose header is not there once."""
    lines = spark.read.text(path).select(F.input_file_name().alias("file"), (F.col("value") == "\t".join(columns)).alias("header"))
    return lines.groupBy("file").agg(F.count_if("header").alias("n")).where("n <> 1").select(F.lit("header").alias("fault"), F.col("file").alias("where"))


def _numbers(df: DataFrame, columns: tuple[str, ...], name: str) -> DataFrame:
    bad = F.exists(F.array(*columns), lambda x: ~F.coalesce(x.rlike("^[0-9]+$"), F.lit(False)))
    return df.where(bad).select(F.lit("number").alias("fault"), F.col(name).alias("where"))


def _unequal(counted: DataFrame, told: DataFrame, what: str) -> DataFrame:
    """Totals (key, n) that a report tells and its rows do not have, or the other way round."""
    both = counted.withColumnRenamed("n", "a").join(told.withColumnRenamed("n", "b"), "key", "full_outer").na.fill(0, ["a", "b"])
    return both.where("a <> b").select(F.lit(what).alias("fault"), F.concat_ws(" ", "key", "a", "b").alias("where"))


def coverage_faults(spark: SparkSession, path: str) -> DataFrame:
    """(fault, where) of a coverage report: its header, fields, escapes, numbers, ranges, severities, ids, and the totals of its severities."""
    rows = read(spark, path, COVERAGE)
    whole = rows.where("fault is null").drop("fault")
    ranges = whole.where(F.col("source_start").try_cast("long") > F.col("source_end").try_cast("long")).select(F.lit("range").alias("fault"), F.col("id").alias("where"))
    severities = whole.where(~F.col("severity").isin(*SEVERITIES)).select(F.lit("severity").alias("fault"), F.col("id").alias("where"))
    counted = whole.groupBy(F.col("severity").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    found = [
        _headed(spark, path, COVERAGE), rows.where("fault is not null").select("fault", F.col("id").alias("where")), _repeated(whole, ("id",)),
        _numbers(whole, ("level", "source_index", "source_start", "source_end"), "id"), ranges, severities, _unequal(counted, totals(spark, path, "severity"), "total"),
    ]
    return _all(found)


def conservation_report_faults(spark: SparkSession, path: str) -> DataFrame:
    """(fault, where) of a conservation report: its header, fields, escapes, numbers, repeated words, counts that disagree, and its summary."""
    rows = read(spark, path, CONSERVATION)
    whole = rows.where("fault is null").drop("fault")
    counts = tuple(c for c in CONSERVATION if c.startswith(("drawn", "emitted", "unaccounted")))
    sums = whole.agg(F.count(F.lit(1)).alias("rows"), *(F.coalesce(F.sum(F.col(c).try_cast("long")), F.lit(0)).alias(c) for c in ("emitted", "unaccounted")))
    counted = sums.select(F.explode(F.map_from_arrays(F.array(*(F.lit(c) for c in sums.columns)), F.array(*sums.columns))).alias("key", "n"))
    told = totals(spark, path, "summary")
    counted = counted.join(told.select("key"), "key", "left_semi")  # a summary may tell only some of them
    found = [
        _headed(spark, path, CONSERVATION), rows.where("fault is not null").select("fault", F.col("topic").alias("where")), _repeated(whole, ("topic", "word")),
        _numbers(whole, counts, "topic"), conservation_faults(whole).select(F.lit("counts").alias("fault"), F.concat_ws(" ", "topic", "word").alias("where")),
        _unequal(counted, told.where(F.col("key").isin(*sums.columns)), "total"),
    ]
    return _all(found)


def _all(found: list[DataFrame]) -> DataFrame:
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def write(df: DataFrame, path: str, columns: tuple[str, ...]) -> None:
    """One escaped row a line, tab-separated."""
    row = F.concat_ws("\t", *(T.tsv_escape(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in columns))
    df.select(row.alias("value")).write.mode("overwrite").text(path)


def severity_rank(severity: Column | str) -> Column:
    return F.array_position(F.array(*(F.lit(s) for s in SEVERITIES)), F.col(severity) if isinstance(severity, str) else severity) - 1


def conservation_faults(df: DataFrame) -> DataFrame:
    """Rows of a conservation report whose counts do not agree with one another."""
    n = {c: F.col(c).try_cast("long") for c in CONSERVATION if c.startswith(("drawn", "emitted", "unaccounted"))}
    short = n["drawn_opening"] + n["drawn_inline"] - n["emitted"]
    lacks = lambda e: F.greatest(F.lit(0), n["drawn_inline"] - n[e])
    fine = (short > 0) & (n["unaccounted"] == lacks("emitted")) & (n["unaccounted_markdown"] == lacks("emitted_markdown")) & (n["unaccounted_html"] == lacks("emitted_html"))
    return df.where(~F.coalesce(fine, F.lit(False)))


def json_valid(x: Column | str) -> Column:
    """Whether a text is JSON."""
    return F.try_parse_json(F.col(x) if isinstance(x, str) else x).isNotNull()
