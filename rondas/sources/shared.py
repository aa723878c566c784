"""The folder every executor can reach, and lineage cuts that use it."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

#: Lists of the tables written inside the open ``scratch`` blocks, innermost last.
_open: list[list[str]] = []
#: Spark's setting (4.1 on) that removes a query's shuffle files when the query ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """Folder named by ``spark.checkpoint.dir``.

    Where it is unset, a local master (tests) gets a temporary folder; a cluster
    gets an error, because a driver's own disk is not visible to its executors.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        folder = tempfile.mkdtemp(prefix="rondas-")
    context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it from there from now on."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def write_out(df: DataFrame, *, keep: bool = False) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read that.

    For large intermediate results: compressed, and a later pass over a few
    columns reads only those. Small ones are cheaper through ``cut_lineage``.
    The size Spark reads from the files decides how it is joined. With ``keep`` the table
    outlives the innermost ``scratch`` block. Nothing reads the shuffles of a table that is
    written: they go at once, instead of when the driver happens to collect its garbage.
    """
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    with _shuffles_removed(df.sparkSession):
        df.write.parquet(path)
    blocks = _open[:-1] if keep else _open
    if blocks:
        blocks[-1].append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def _shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the queries that begin inside the block go when these end; the session's setting comes back."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def remove(spark: SparkSession, name: str) -> None:
    """Delete a folder, through the file system it is on."""
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Remove the tables that ``write_out`` makes inside the block when it ends: results must be stored by then."""
    _open.append([])
    try:
        yield
    finally:
        for name in _open.pop():
            remove(spark, name)
