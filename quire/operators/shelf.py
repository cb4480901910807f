"""Shelves of books: listings, stamps, and incremental refresh."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import intervals


def listing(spark: SparkSession, path: str, recursive: bool = False, suffix: str = ".boo") -> DataFrame:
    """(path, name, size, modified) of a folder's files with the suffix, whatever its case; names with a leading dot are left out.

    File contents are never read: only metadata columns are selected.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    name = F.element_at(F.split("path", "/"), -1)
    rows = files.select("path", name.alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    return rows.where(F.endswith(T.ascii_lower("name"), F.lit(suffix)) & ~F.startswith(F.col("name"), F.lit(".")))


def ordered(df: DataFrame, shelf: list[str], title: str, name: str) -> DataFrame:
    """Rows with their place on their shelf (from 1): by title without ASCII case, then by name; a shelf is never sorted in one task."""
    folded = df.withColumn("__folded", T.ascii_lower(title))  # a column: an expression would be worked out at each comparison
    return intervals.placed(folded, shelf, [F.col("__folded"), F.col(name)], "place").drop("__folded")


def refresh(current: DataFrame, memory: DataFrame, disk: DataFrame, key: str, stamp: str, value: str) -> DataFrame:
    """Current rows with a value from the first cache whose stamp is theirs; source is memory, disk or probe (value null)."""
    m = memory.select(key, F.col(stamp).alias("__sm"), F.col(value).alias("__m"))
    d = disk.select(key, F.col(stamp).alias("__sd"), F.col(value).alias("__d"))
    out = current.select(key, stamp).join(m, key, "left").join(d, key, "left")
    in_m, in_d = F.coalesce(F.col("__sm") == F.col(stamp), F.lit(False)), F.coalesce(F.col("__sd") == F.col(stamp), F.lit(False))
    return out.select(
        key, stamp, F.when(in_m, F.col("__m")).when(in_d, F.col("__d")).alias(value),
        F.when(in_m, "memory").when(in_d, "disk").otherwise("probe").alias("source"),
    )


def stats(refreshed: DataFrame) -> DataFrame:
    """One row: rows served from memory, from disk, and to be probed."""
    count = lambda s: F.count_if(F.col("source") == s)
    return refreshed.agg(count("memory").alias("memory_hits"), count("disk").alias("disk_hits"), count("probe").alias("probes"))


def evicted(cached: DataFrame, current: DataFrame, key: str) -> DataFrame:
    """Cached rows whose file is gone."""
    return cached.join(current.select(key), key, "left_anti")


def signature(df: DataFrame, shelf: list[str], columns: list[str]) -> DataFrame:
    """(shelf..., signature): changes with any row's columns, whatever the order of the rows; sums are partial before the shuffle."""
    h = F.xxhash64(*columns).cast("decimal(38,0)")
    return df.groupBy(*shelf).agg(F.xxhash64(F.sum(h), F.count(F.lit(1)), F.bit_xor(F.xxhash64(*columns))).alias("signature"))


def file_identity(df: DataFrame, key: str, content: str) -> DataFrame:
    """(key, size in bytes, sha256)."""
    raw = F.col(content).cast("binary")
    return df.select(key, F.length(raw).cast("long").alias("size"), F.sha2(raw, 256).alias("sha256"))


def deduplicated_names(df: DataFrame, stem: str, order: str) -> DataFrame:
    """Rows with a file name: the stem, and from its second use on the stem with -2, -3..."""
    n = F.row_number().over(Window.partitionBy(stem).orderBy(order))
    return df.withColumn("file_name", F.when(n == 1, F.col(stem)).otherwise(F.concat_ws("-", stem, n)))


def upper_median(df: DataFrame, part: list[str], value: str) -> DataFrame:
    """(part..., median, n): the value at index n / 2 of the sorted ones, the upper of two middle ones.

    A sketch bounds the median from both sides: values below are counted, and only
    those between the bounds, a few ten-thousandths of a part, are ranked.
    """
    known = df.where(F.col(value).isNotNull()).select(*part, F.col(value).alias("__v"))
    sides = F.percentile_approx("__v", [0.5 - 2e-4, 0.5 + 2e-4], 10_000)  # each within 1e-4 of the rows
    bounds = known.groupBy(*part).agg(sides.alias("__s")).select(*(F.col(p).alias(f"__{p}") for p in part), F.col("__s")[0].alias("__lo"), F.col("__s")[1].alias("__hi"))
    same = F.lit(True)
    for p in part:
        same = same & F.col(p).eqNullSafe(F.col(f"__{p}"))
    near = F.when(F.col("__v").between(F.col("__lo"), F.col("__hi")), F.col("__v"))
    counts = known.join(bounds, same).withColumn("__near", near).groupBy(*part, "__near").agg(
        F.count(F.lit(1)).alias("__c"), F.count_if(F.col("__v") < F.col("__lo")).alias("__below")
    )
    w = Window.partitionBy(*part)
    ranked = counts.select(
        *part, "__near", "__c", F.sum("__c").over(w).alias("n"), F.sum("__below").over(w).alias("__b"),
        F.sum(F.when(F.col("__near").isNotNull(), F.col("__c")).otherwise(0)).over(w.orderBy(F.asc_nulls_first("__near")).rowsBetween(Window.unboundedPreceding, 0)).alias("__u"),
    )
    upto, middle = F.col("__b") + F.col("__u"), F.floor(F.col("n") / 2)
    hit = F.col("__near").isNotNull() & (upto - F.col("__c") <= middle) & (middle < upto)
    return ranked.where(hit).select(*part, F.col("__near").alias("median"), "n")


def book_titles(df: DataFrame) -> DataFrame:
    """Title and build version as listings show them: the short title if there is one; build, else version, else the directory's."""
    full = lambda c: F.nullif(F.col(c), F.lit(""))
    return df.withColumn("shown_title", F.coalesce(full("short_title"), full("title"))).withColumn(
        "shown_build", F.coalesce(full("build"), full("version"), full("directory_version"))
    )
