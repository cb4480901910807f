"""Runs, interval unions, overlaps and lookups by position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: How much wider the bins of each level of `overlaps` are than those below.
STEEP = 16


def runs(df: DataFrame, part: list[str], order: list[str], value: str) -> DataFrame:
    """(part..., run, value, first, last, n): maximal runs of rows with equal values; first and last are of order[0]."""
    w = Window.partitionBy(*part).orderBy(*order)
    new = F.coalesce((~F.col(value).eqNullSafe(F.lag(value).over(w))).cast("int"), F.lit(1))
    first = F.row_number().over(w) == 1
    island = F.sum(F.when(first, 1).otherwise(new)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("run", island.cast("long")).groupBy(*part, "run", value).agg(
        F.min(order[0]).alias("first"), F.max(order[0]).alias("last"), F.count(F.lit(1)).alias("n")
    )


def page_runs(pages: DataFrame) -> DataFrame:
    """Runs of pages of one class: (book_id, run, page_class, first, last, n)."""
    return runs(pages, ["book_id"], ["page_no"], "page_class")


def merged(df: DataFrame, part: list[str], begin: str = "begin", end: str = "end") -> DataFrame:
    """The union of half-open intervals: those that overlap or touch are one; empty ones go."""
    w = Window.partitionBy(*part).orderBy(begin, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(reach.isNull() | (F.col(begin) > reach), 1).otherwise(0)
    island = F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))
    own = df.where(F.col(begin) < F.col(end)).withColumn("__new", new).withColumn("__island", island)
    return own.groupBy(*part, "__island").agg(F.min(begin).alias(begin), F.max(end).alias(end)).drop("__island")


def overlaps(a: DataFrame, b: DataFrame, part: list[str], width: int) -> DataFrame:
    """Pairs of rows whose half-open intervals overlap, with columns a_* and b_*.

    Intervals are dealt to bins; the bins of level k are `width` times STEEP to the k
    wide, and an interval's own level is the first whose bins are as wide as it, so
    it has two bins at most on any level.  A pair meets on the level of its longer
    one, in the bin of its later begin only, so it comes once: the joins stay
    equi-joins, and no interval, however long, becomes more rows than there are levels.
    """
    level = lambda p: F.greatest(F.ceil(F.log(float(STEEP), (F.col(f"{p}_end") - F.col(f"{p}_begin")) / width)), F.lit(0)).cast("int")

    def own(df: DataFrame, p: str) -> DataFrame:
        named = df.select(*part, *(F.col(c).alias(f"{p}_{c}") for c in df.columns if c not in part)).where(F.col(f"{p}_begin") < F.col(f"{p}_end"))
        return named.withColumn("__own", level(p))

    x, y = own(a, "a"), own(b, "b")
    most = x.select("__own").unionByName(y.select("__own")).agg(F.max("__own")).first()[0]
    if most is None:
        most = 0

    def binned(df: DataFrame, p: str, levels: Column) -> DataFrame:
        size = F.lit(float(STEEP)) ** F.col("__level") * width
        low, high = F.floor(F.col(f"{p}_begin") / size), F.floor((F.col(f"{p}_end") - 1) / size)
        return df.withColumn("__level", F.explode(levels)).withColumn("__bin", F.explode(F.sequence(low, high))).drop("__own")

    alone, upward = F.array("__own"), F.sequence(F.col("__own"), F.lit(most))
    above = F.filter(upward, lambda k: k > F.col("__own"))
    hit = (F.col("a_begin") < F.col("b_end")) & (F.col("b_begin") < F.col("a_end"))
    once = F.floor(F.greatest("a_begin", "b_begin") / (F.lit(float(STEEP)) ** F.col("__level") * width)) == F.col("__bin")
    longer_a = binned(x, "a", alone).join(binned(y, "b", upward), [*part, "__level", "__bin"])
    longer_b = binned(x, "a", above).join(binned(y, "b", alone), [*part, "__level", "__bin"])
    # On its level the longer one meets those of its own level and of lower ones; both joins see each pair on one level only.
    return longer_a.unionByName(longer_b).where(hit & once).drop("__level", "__bin")


def containing(points: DataFrame, spans: DataFrame, part: list[str], point: str, columns: list[str]) -> DataFrame:
    """Each point with the columns of the interval that it stands in, of disjoint intervals: a fill-forward, not a range join."""
    p = points.select(*part, F.col(point).alias("__at"), F.lit(1).alias("__kind"), F.struct(*points.columns).alias("__row"), F.lit(None).alias("__span"))
    s = spans.select(*part, F.col("begin").alias("__at"), F.lit(0).alias("__kind"), F.lit(None).alias("__row"), F.struct("end", *columns).alias("__span"))
    w = Window.partitionBy(*part).orderBy("__at", "__kind").rowsBetween(Window.unboundedPreceding, 0)
    filled = p.unionByName(s).withColumn("__span", F.last("__span", ignorenulls=True).over(w)).where("__kind = 1")
    inside = F.col("__at") < F.col("__span.end")
    return filled.select("__row.*", *(F.when(inside, F.col(f"__span.{c}")).alias(c) for c in columns))


def prefix_ranges(df: DataFrame, part: list[str], order: str, width: str) -> DataFrame:
    """Half-open ranges [begin, end) of consecutive pieces of given widths."""
    w = Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(width).over(w)
    return df.withColumn("begin", end - F.col(width)).withColumn("end", end)


def next_of(df: DataFrame, part: list[str], order: str, keep: Column, columns: list[str]) -> DataFrame:
    """Each row with the columns of the next row that `keep` holds for: the last one seen when rows are read backwards."""
    w = Window.partitionBy(*part).orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, -1)
    found = df.withColumn("__next", F.last(F.when(keep, F.struct(*columns)), ignorenulls=True).over(w))
    return found.select(*df.columns, *(F.col(f"__next.{c}").alias(f"next_{c}") for c in columns))


def dealt(df: DataFrame, part: list[str], order: list[Column]) -> tuple[DataFrame, DataFrame]:
    """Rows dealt by ranges of (part, order) and sorted, and the spans of the ranges.

    The rows have __range and __at (numbers that grow with the order); the spans
    (part..., __range, __low, __before) tell where each part begins in each range and
    how many of its rows stand in ranges before.  No part is sorted in one task,
    and what a window gathers is a row for each part and range.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a number given is not changed at run time, so ranges keep their numbers
    sorted_ = df.repartitionByRange(n, *part, *order).sortWithinPartitions(*part, *order)
    rows = sorted_.withColumn("__at", F.monotonically_increasing_id()).withColumn("__range", F.shiftright("__at", 33))
    spans = rows.groupBy(*part, "__range").agg(F.min("__at").alias("__low"), F.count(F.lit(1)).alias("__n"))
    w = Window.partitionBy(*part).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    return rows, spans.withColumn("__before", F.coalesce(F.sum("__n").over(w), F.lit(0))).drop("__n")


def placed(df: DataFrame, part: list[str], order: list[Column], name: str) -> DataFrame:
    """Each row with its place in its part (from 1), whatever the part's size.  Null parts are parts."""
    rows, spans = dealt(df, part, order)
    spans = spans.select(*(F.col(p).alias(f"__{p}") for p in part), F.col("__range").alias("__r"), "__low", "__before")
    same = F.col("__range") == F.col("__r")
    for p in part:
        same = same & F.col(p).eqNullSafe(F.col(f"__{p}"))
    return rows.join(spans, same).select(*df.columns, (F.col("__before") + F.col("__at") - F.col("__low") + 1).alias(name))


def neighbours(df: DataFrame, part: list[str], order: str, column: str) -> DataFrame:
    """Each row with the column of the one before and the one after it, whatever the part's size.

    Rows of one range are compared in it; at a range's ends, with the edge rows of
    the ranges beside it that the part has.
    """
    rows, _ = dealt(df, part, [F.col(order)])
    w = Window.partitionBy(*part, "__range").orderBy("__at")
    own = rows.withColumn("previous", F.lag(column).over(w)).withColumn("next", F.lead(column).over(w))
    own = own.withColumn("__first", F.lag("__at").over(w).isNull()).withColumn("__last", F.lead("__at").over(w).isNull())
    edges = rows.groupBy(*part, "__range").agg(F.min_by(column, "__at").alias("head"), F.max_by(column, "__at").alias("tail"))
    e = Window.partitionBy(*part).orderBy("__range")
    edges = edges.withColumn("__p", F.lag("tail").over(e)).withColumn("__n", F.lead("head").over(e))
    edges = edges.select(*(F.col(p).alias(f"__{p}") for p in part), F.col("__range").alias("__r"), "__p", "__n")
    same = F.col("__range") == F.col("__r")
    for p in part:
        same = same & F.col(p).eqNullSafe(F.col(f"__{p}"))
    out = own.join(edges, same)
    return out.select(
        *df.columns,
        F.when(F.col("__first"), F.col("__p")).otherwise(F.col("previous")).alias("previous"),
        F.when(F.col("__last"), F.col("__n")).otherwise(F.col("next")).alias("next"),
    )
