"""Shared plumbing for the operators that run Python on Arrow batches."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Text bytes that one pass over a batch holds as Python words; bounds a worker's memory whatever the batch is.
CHUNK_BYTES = 4 << 20
#: Arrow batches larger than this are not asked for: a batch is held by the JVM and by its Python worker at once.
BATCH_BYTES = 16 << 20


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)

#: Caches that a worker keeps from task to task: owner to what empties its cache.
RESIDENT: dict[str, Callable[[], None]] = {}


def settle(owner: str | None = None) -> None:
    """Called as a task begins: a worker that turns to other work lets go of the caches of what it did before."""
    for name, clear in RESIDENT.items():
        if name != owner:
            clear()
    pa.default_memory_pool().release_unused()
    if _trim is not None:  # what tasks before freed goes back to the system
        _trim(0)


def bound_batches(spark: SparkSession) -> None:
    """Lower the session's limit on an Arrow batch's bytes to BATCH_BYTES, if it is above."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    size = spark.conf.get(key).rstrip("b")  # as Spark shows it: a number of bytes, unless it was set in other units
    if not size.isdigit() or int(size) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id long, text binary): the two columns an operator reads; a null text is empty.

    Only these columns are read, so extra columns, whatever their names, are
    pruned from the scan.
    """
    bound_batches(df.sparkSession)
    return df.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col).cast("binary"), F.lit("").cast("binary")).alias("text"),
    )


def kept_rows(docs: DataFrame, make: Callable[[], Callable[[list[bytes]], list[bool]]], text_col: str = "text", limit: int = CHUNK_BYTES, owner: str | None = None) -> DataFrame:
    """The rows of `docs`, all their columns, that make()(texts) says stay: in one pass, without a shuffle.

    What is decided of a row's own text keeps or removes that row, not others of its
    id or without one.  A null text is empty.  Columns are passed on by their place,
    so their names, whatever they are, cannot clash.
    """
    bound_batches(docs.sparkSession)
    names = docs.columns
    at = names.index(text_col)
    plain = docs.toDF(*(f"c{k}" for k in range(len(names))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle(owner)
        keep = make()
        for batch in batches:
            column, start, held = batch.column(at), 0, 0
            sizes = [len(x.as_buffer()) if x.is_valid else 0 for x in column]
            for k in range(batch.num_rows + 1):
                if k == batch.num_rows or held and held + sizes[k] > limit:
                    if k > start:
                        part = batch.slice(start, k - start)
                        stay = keep([(x or "").encode() for x in column.slice(start, k - start).to_pylist()])
                        yield part if all(stay) else part.filter(pa.array(stay, pa.bool_()))
                    start, held = k, 0
                held += sizes[k] if k < batch.num_rows else 0

    return plain.mapInArrow(run, plain.schema).toDF(*names)


def chunks(batches: Iterator[pa.RecordBatch], limit: int = CHUNK_BYTES) -> Iterator[tuple[list, list[bytes]]]:
    """(ids, texts as bytes) of at most `limit` bytes, or of one longer text."""
    for batch in batches:
        ids, column = batch.column(0).to_pylist(), batch.column(1)
        at, held, start = 0, 0, 0
        for at in range(len(ids)):
            n = len(column[at].as_buffer()) if column[at].is_valid else 0
            if held and held + n > limit:
                yield ids[start:at], column.slice(start, at - start).to_pylist()
                start, held = at, 0
            held += n
        if len(ids) > start:
            yield ids[start:], column.slice(start).to_pylist()


def map_chunks(
    df: DataFrame,
    schema: str | StructType,
    make: Callable[[], Callable[[list, list[bytes]], dict[str, Any] | None]],
    limit: int = CHUNK_BYTES,
    owner: str | None = None,
) -> DataFrame:
    """Apply make()(ids, texts) -> columns to each chunk of a `texts` frame.

    `make` runs once a task, so models and caches live as long as the task.
    """
    struct = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    arrow = to_arrow_schema(struct)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle(owner)
        step = make()
        for ids, blobs in chunks(batches, limit):
            out = step(ids, blobs)
            if out is not None:
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, struct)
