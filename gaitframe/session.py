"""Session helpers: the shared working folder and intermediate tables."""

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as the cluster names it in ``spark.checkpoint.dir``.

    A temporary folder is made only in local mode, where driver and executors share a disk.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    made = tempfile.mkdtemp(prefix="gaitframe-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder; never reused, so retries cannot collide."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


_FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """What runs inside leaves no shuffle files: Spark else keeps them until the driver's garbage is collected, so that the disk
    holds those of all jobs of a query. For frames that are made and run inside once, as a write is."""
    try:
        before = spark.conf.get(_FREE_SHUFFLES)
    except PySparkException:    # not known to this Spark
        before = "true"
    if before == "true":        # or wanted by the caller anyway
        yield
        return
    spark.conf.set(_FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.set(_FREE_SHUFFLES, before)


def materialize(df: DataFrame, name: str, partition_by: list[str] | None = None, compression: str | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back (runs a job).

    Used where several plans read one expensive intermediate. The lineage ends at files, so a
    lost executor costs a file read and not a recomputation.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with shuffles_freed(spark):
        writer = df.select("*").write.mode("errorifexists")     # a frame made here
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        if compression:
            writer = writer.option("compression", compression)
        writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
