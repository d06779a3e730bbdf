"""Helpers that several corpus operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Bytes of a batch that goes to a Python worker.
ARROW_BYTES = ("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a session in one JVM may do without."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not found:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="panelloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(found)
    return found


def new_path(spark: SparkSession, name: str) -> str:
    """A place in the shared folder that nothing else uses, under this application's own folder."""
    return f"{shared_dir(spark)}/panelloom/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


@contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    """Arrow batches of a few megabytes for what runs meanwhile: whole texts go to Python, and ten thousand may be very long."""
    before = spark.conf.get(ARROW_BYTES[0], None)
    spark.conf.set(*ARROW_BYTES)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(ARROW_BYTES[0])
        else:
            spark.conf.set(ARROW_BYTES[0], before)


def materialize(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write `df` as Parquet in the shared folder and read it back.

    Cuts the lineage: lost executors cost only the tasks that read the table, and statistics of the files let
    Spark choose the join strategy by measured size. `discard` deletes tables that no later plan reads; what results still
    read stays in the folder named after the application, to be deleted with it.
    """
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    with _small_batches(spark):
        df.write.option("compression", compression).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that `materialize` returned and that no plan still to be run reads."""
    for table in tables:
        where = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table._written_at)
        where.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))
