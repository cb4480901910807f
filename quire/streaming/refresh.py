"""New books of a shelf as a stream: an extension, the polling of a shelf done by the file source.

Each micro-batch holds the files that are new since the last; the merge keeps, for
each key, the row with the newest stamp, and is idempotent, so a batch that is run
again after a failure changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shelf_stream(spark: SparkSession, path: str, schema: str, source: str = "parquet") -> DataFrame:
    return spark.readStream.format(source).schema(schema).load(path)


def store_batches(target: str):
    """A foreachBatch function that writes a batch under its number; `latest` reads them all."""

    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

    return store


def latest(spark: SparkSession, target: str, key: str, stamp: str) -> DataFrame:
    """The newest row of each key over all batches; of equal stamps, the later batch's."""
    rows = spark.read.parquet(target)
    columns = [c for c in rows.columns if c not in (key, "batch")]
    best = rows.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(stamp, "batch")).alias("r"))
    return best.select(key, "r.*")


def late_counts(events: DataFrame, ts: str, kind: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts of events a window and kind, with rows later than the watermark left out of closed windows."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, window), kind).agg(F.count(F.lit(1)).alias("n"))
