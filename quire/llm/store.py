"""Files in the shared store, by pyarrow: local, or any store whose URI pyarrow knows."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyarrow import fs
from pyspark.sql import SparkSession

#: Rows of a file, where there are more than the tasks that run at once would each write as one.
FILE_ROWS = 100_000


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI or of an absolute path, and the path in it."""
    return fs.FileSystem.from_uri(uri)


def shared(spark: SparkSession, name: str) -> str:
    """A new folder name in the folder that all executors and the driver share.

    That folder is spark.checkpoint.dir; where it is unset, as in tests on one
    machine, a temporary one is set if the master is local, and else this fails:
    other machines would not see it.
    """
    top = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not top:
        held = context._jsc.sc().getCheckpointDir()
        if held.isDefined():
            top = held.get()
        elif context.master.startswith("local") and not context.master.startswith("local-cluster"):
            top = tempfile.mkdtemp(prefix="quire-")
            context.setCheckpointDir(top)
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


@contextmanager
def having(spark: SparkSession, **settings: str):
    """The session with some settings, which are as they were afterwards; "__" stands for a dot."""
    before = {k: spark.conf.get(k, None) for k in (x.replace("__", ".") for x in settings)}
    try:
        for k, v in settings.items():
            spark.conf.set(k.replace("__", "."), v)
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def written(df, name: str, rows: int | None = None):
    """`df`, computed once and written as a table in the shared folder: it cuts lineage and survives lost executors.

    The shuffle files of the step go as it ends: nothing reads them any more.
    `rows` is about how many rows there are, if known: few are then written by as
    many tasks as run at once, however many parts a shuffle has.  Hadoop without its
    native library starts three child processes for each file, to set permissions,
    and each counts, as it starts, as another copy of its executor's memory.
    """
    spark = df.sparkSession
    if rows is not None:
        df = df.coalesce(max(spark.sparkContext.defaultParallelism, -(-rows // FILE_ROWS)))
    to = shared(spark, name)
    with having(spark, spark__sql__classic__shuffleDependency__fileCleanup__enabled="true"):
        df.write.parquet(to)
    return spark.read.schema(df.schema).parquet(to)


def released(*tables) -> None:
    """Delete tables that `written` made and nothing reads any more."""
    for df in tables:
        context = df.sparkSession.sparkContext
        paths = context._jvm.org.apache.hadoop.fs
        for f in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
            path = paths.Path(f)
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
