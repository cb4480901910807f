"""Snapshots against a baseline: what is missing, unexpected, changed, or worse than it was."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def snapshot_diff(baseline: DataFrame, current: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """(keys..., state, value pairs): rows that are missing, unexpected or changed; equal rows are left out."""
    b = baseline.select(*keys, F.lit(True).alias("in_b"), *(F.col(v).alias(f"{v}_baseline") for v in values))
    c = current.select(*keys, F.lit(True).alias("in_c"), *(F.col(v).alias(f"{v}_current") for v in values))
    changed = F.lit(False)
    for v in values:
        changed = changed | ~F.col(f"{v}_baseline").eqNullSafe(F.col(f"{v}_current"))
    state = F.when(F.col("in_c").isNull(), "missing").when(F.col("in_b").isNull(), "unexpected").when(changed, "changed")
    out = b.join(c, keys, "full_outer").withColumn("state", state).where("state is not null")
    return out.select(*keys, "state", *(x for v in values for x in (f"{v}_baseline", f"{v}_current")))


def regressions(baseline: DataFrame, current: DataFrame, keys: list[str], count: str, least: int = 0) -> DataFrame:
    """(keys..., before, now, increase): counts that grew, each key for itself; no key's gain pays for another's loss."""
    b = baseline.select(*keys, F.col(count).cast("long").alias("before"))
    c = current.select(*keys, F.col(count).cast("long").alias("now"))
    return grown(c.join(b, keys, "left").na.fill(0, ["before"]), keys, least)


def grown(both: DataFrame, keys: list[str], least: int = 0) -> DataFrame:
    """regressions of (keys..., before, now), where both counts are in one row."""
    out = both.select(*keys, "before", "now", (F.col("now") - F.col("before")).alias("increase"))
    return out.where(F.col("increase") > least)


def same_set(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that only one of two tables has, with the side; empty if the sets are equal."""
    left = a.select(*keys).distinct().join(b, keys, "left_anti").withColumn("only_in", F.lit("left"))
    right = b.select(*keys).distinct().join(a, keys, "left_anti").withColumn("only_in", F.lit("right"))
    return left.unionByName(right)


def symmetric_difference(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return same_set(a, b, keys).select(*keys)


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., n) of the keys that more than one row has: a uniqueness constraint holds if there is none."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
