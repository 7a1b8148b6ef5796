"""Run a stream over stored rows to its end."""

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from gaitframe.session import scratch_path

#: A clock later than any row (milliseconds): a last row with it lets the watermark pass all others.
CLOSING_MS = 4_102_444_800_000


def stream_session(spark: SparkSession) -> SparkSession:
    """A session for streams: state is spread over as many tasks as the cluster has cores (the number is fixed
    in the checkpoint at the first start) and kept in RocksDB, of which only changes are written to the
    checkpoint; the caller's settings are left alone."""
    session = spark.newSession()
    session.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    session.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")
    session.conf.set("spark.sql.shuffle.partitions", str(spark.sparkContext.defaultParallelism))
    return session


def start_available(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Process what is there and stop."""
    stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(
        availableNow=True).start(out).awaitTermination()


def replay(parts: Sequence[DataFrame], build: Callable[[DataFrame], DataFrame], name: str, close: str | None = None,
           files_per_batch: int = 64) -> DataFrame:
    """Append each part to a folder and run ``build`` of its stream after each, restarting from the
    checkpoint. ``close`` names the clock column of a last row that releases all that still waits.
    Returns all rows written (runs jobs)."""
    spark = parts[0].sparkSession
    base, session = scratch_path(spark, name), stream_session(spark)
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in parts[0].schema])
    if close:
        parts = [*parts, spark.createDataFrame([tuple(CLOSING_MS if f == close else None for f in schema.names)], schema)]
    for part in parts:
        part.write.mode("append").parquet(f"{base}/in")
        stream = session.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{base}/in")
        start_available(build(stream), f"{base}/out", f"{base}/checkpoint")
    return spark.read.parquet(f"{base}/out")
