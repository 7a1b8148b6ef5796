"""Caches, session and archive CSV, named text files, reports, split manifests."""

import posixpath
import re
import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaitframe.operators.splits import assert_no_leakage, subject_split
from gaitframe.schema import SAMPLE_MS, SENSORS, SESSION_SCHEMA
from gaitframe.session import materialize


def exists(spark: SparkSession, path: str) -> bool:
    """Whether Spark finds something at ``path`` (on any file system it can read)."""
    try:
        return not spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path").isEmpty()
    except AnalysisException:
        return False


_POINTER = "version string, published_at long"


def publish(df: DataFrame, path: str, fmt: str = "parquet", by: Sequence[str] = ()) -> None:
    """Writes ``df`` as a new version below ``path`` and names it in a pointer table when it is whole.

    Readers see the version published last. A writer that is lost leaves a version that nobody reads, and two
    writers at a time leave two whole versions of which one is read, never a mixture. Older versions stay for those
    who still read them.
    """
    version = f"v-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").partitionBy(*by).format(fmt).save(f"{path}/{version}")
    now = df.sparkSession.range(1, numPartitions=1).select(F.lit(version).alias("version"), F.unix_micros(F.current_timestamp()).alias("published_at"))
    now.write.mode("append").parquet(f"{path}/published")


def published(spark: SparkSession, path: str) -> str | None:
    """Folder of the version published last, if there is one."""
    try:
        last = spark.read.schema(_POINTER).parquet(f"{path}/published").orderBy(F.desc("published_at"), "version").first()
    except AnalysisException:
        return None
    return f"{path}/{last.version}" if last else None


def cache_write(df: DataFrame, path: str) -> None:
    """Harmonized rows partitioned by dataset. Rows of one dataset keep their tasks, so a large
    dataset is written by many."""
    publish(df, path, by=["dataset_id"])


def cache_read(spark: SparkSession, path: str) -> DataFrame | None:
    found = published(spark, path)
    return spark.read.parquet(found) if found else None


def invalidate(df: DataFrame, path: str) -> None:
    """Empty the cache: a version without rows is published."""
    publish(df.limit(0), path)


def cached(spark: SparkSession, path: str, build) -> DataFrame:
    """The cache if it is there, else the result of ``build()`` after writing it."""
    found = cache_read(spark, path)
    if found is None or found.isEmpty():
        cache_write(build(), path)
        found = cache_read(spark, path)
    return found


def write_text_files(lines: DataFrame, root: str) -> DataFrame:
    """Lines (``file_path`` below ``root``, ``block_start``, ``line_id``, ``value``) as one text file per ``file_path``.

    Where the lines have a ``header`` that is not null, a file begins with that of its first line.
    Spark's own writers choose the names of their files; recordings are known by theirs. A file is streamed by one task, in
    the order of its lines, and moved to its name when it is whole, so a task that is run again leaves no half file. Returns
    ``file_path, n_lines`` (runs a job). ``root`` is a folder that all executors can reach and pyarrow can open.
    """

    headed = "header" in lines.columns

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(re.sub("^file:/+", "/", root))
        task, done, at, sink, made = TaskContext.get().taskAttemptId(), [], None, None, None

        def hidden(name: str) -> str:
            folder, last = posixpath.split(name)
            return posixpath.join(folder, f".{last}.{task}")

        def close() -> None:
            if sink is not None:
                sink.close()
                store.move(f"{base}/{hidden(at)}", f"{base}/{at}")

        for batch in batches:
            # runs of lines of one file are written at once
            runs = pc.run_end_encode(batch.column("file_path"))
            values, start = batch.column("value").to_pylist(), 0
            for name, end in zip(runs.values.to_pylist(), runs.run_ends.to_pylist(), strict=True):
                texts = values[start:end]
                if name != at:
                    close()
                    at, folder = name, posixpath.dirname(f"{base}/{name}")
                    if folder != made:
                        store.create_dir(folder, recursive=True)
                        made = folder
                    sink = store.open_output_stream(f"{base}/{hidden(name)}", buffer_size=1 << 16)
                    done.append([name, 0])
                    if headed and (first := batch.column("header")[start].as_py()) is not None:
                        texts.insert(0, first)
                sink.write("".join([f"{t or ''}\n" for t in texts]).encode())
                done[-1][1] += len(texts)
                start = end
        close()
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64())], ["file_path", "n_lines"])

    order = ["file_path", "block_start", "line_id"]
    rows = lines.repartition("file_path").sortWithinPartitions(*order).select("file_path", "value", *["header"] * headed)
    return materialize(rows.mapInArrow(write, "file_path string, n_lines long"), "written-files")


def session_name(ts: Column) -> Column:
    return F.concat(F.lit("activity_"), F.date_format(ts, "yyyyMMdd_HHmmss"))


def write_session_csv(df: DataFrame, path: str) -> bool:
    """Session rows with the fixed header; without rows nothing is written."""
    if df.isEmpty():
        return False
    df.select(*SESSION_SCHEMA.fieldNames()).write.mode("errorifexists").option("header", True).csv(path)
    return True


def archive_rows(windows: DataFrame, confirmed_at: str = "confirmed_at", peak: str = "impact_peak") -> DataFrame:
    """Rows of confirmed windows: sample ``i`` of ``n`` is stamped ``(n - i) * 20`` ms before the
    confirmation; the file's tags become columns."""
    n = F.size("samples")
    status = F.when(F.col("confirmed"), "FALL_CONFIRMED").otherwise("EVENT")
    rows = windows.select("recording_id", status.alias("status"), F.col("label").alias("archive_label"), confirmed_at,
                          peak, n.alias("_n"), F.posexplode("samples").alias("_i", "s"))
    return rows.select(
        "recording_id", "status", "archive_label", (F.col(confirmed_at) - (F.col("_n") - F.col("_i")) * SAMPLE_MS).alias("timestamp_ms"),
        *[F.col(f"s.{c}").alias(c) for c in SENSORS], F.col("archive_label").alias("label"), F.col(peak).alias("impact_peak"))


def write_archives(rows: DataFrame, path: str) -> None:
    """Archive CSV with one folder per status and label."""
    rows.drop("recording_id").write.mode("append").partitionBy("status", "archive_label").option("header", True).csv(path)


def write_report(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """A report as CSV with header or as JSON lines; Spark picks the number of files."""
    writer = df.write.mode("overwrite")
    writer.option("header", True).csv(path) if fmt == "csv" else writer.json(path)


def save_split(split: DataFrame, path: str, force: bool = False) -> None:
    """Write the manifest; an existing one is only replaced with ``force``."""
    assert_no_leakage(split).agg(F.count_if(F.col("n_splits") > 1)).collect()
    split.write.mode("overwrite" if force else "errorifexists").json(path)


def load_split(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("subject_id string, dataset_id string, split string").json(path)


def read_split_object(spark: SparkSession, path: str) -> DataFrame:
    """A manifest kept as one object of three lists, as (subject_id, split) rows."""
    lists = "train array<string>, validation array<string>, test array<string>"
    doc = spark.read.schema(lists).option("multiLine", True).json(path)
    pairs = F.explode(F.create_map(*[x for p in ("train", "validation", "test") for x in (F.lit(p), F.col(p))]))
    return doc.select(pairs.alias("split", "_s")).select(F.explode("_s").alias("subject_id"), "split")


def frozen_split(df: DataFrame, path: str, force: bool = False, **options) -> DataFrame:
    """The stored manifest if there is one and ``force`` is off, else a new one, stored."""
    spark = df.sparkSession
    if force or not exists(spark, path):
        save_split(subject_split(df, **options), path, force)
    return load_split(spark, path)
