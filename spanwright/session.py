"""Session settings and the shared folder in which lineage is cut."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_written: ContextVar[list[str] | None] = ContextVar("written", default=None)

#: Largest estimated size, in bytes, of a side that an operator may broadcast by hint.
BROADCAST_BYTES = 32 << 20


def local_session(cores: int = 8, shuffle_partitions: int | None = None, memory: str = "8g") -> SparkSession:
    """A local session for tests and benches: UTC, ANSI, AQE, Arrow."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("spanwright")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.ansi.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Only where the cluster names none (a local session) is a temporary one set.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("spark.checkpoint.dir is unset: name a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="spanwright-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = "file://" + folder
    spark.sparkContext.setCheckpointDir(path)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    Cuts the lineage at a place that survives the loss of executors, and keeps a table that several
    later steps read from being computed more than once. The table stays until ``scratch`` ends, if written
    within one, or ``clear_materialized`` is called.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/spanwright/{name}-{uuid.uuid4().hex}"
    if (written := _written.get()) is not None:
        written.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def read_table(spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None = None) -> DataFrame:
    """A test table by name; ``columns`` prunes the scan."""
    df = spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
    return df.select(*columns) if columns else df


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes the tables that ``materialize`` wrote within, at the end; results have to be used or written before."""
    token = _written.set([])
    try:
        yield
    finally:
        for path in _written.get() or ():
            _delete(spark, path)
        _written.reset(token)


def clear_materialized(spark: SparkSession) -> None:
    """Delete all tables that ``materialize`` wrote into the shared folder; DataFrames that read them end with this."""
    _delete(spark, f"{shared_dir(spark)}/spanwright")
