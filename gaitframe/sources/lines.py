"""Delimited text as rows with a stable order, whatever the header of each file.

``spark.read.csv`` takes one header for all files. Recordings come with differing column names
and orders, so lines are read as text, each file's header is one row of a small table, and fields
are looked up by name. A file of any size is read in splits: the order of its lines is
(offset of the split, running id inside it).
"""

import re
import warnings
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaitframe.sources.files import can_open, listed, read_plain, sizes

LINE_ORDER = ["block_start", "line_id"]


_PACKED = "gz,gzip,bz2,zst,lz4,snappy,deflate"
_COMPRESSED = f"*.{{{_PACKED}}}"
_LISTERS = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
#: Where a decoder fails on its bytes; a failure of the disk or the network has its first frame elsewhere and is raised.
_DECODERS = ("at org.apache.hadoop.io.compress.", "at java.util.zip.", "at java.base/java.util.zip.")


class UnreadableFile(UserWarning):
    """A file that can't be decoded and is skipped whole: ``path`` and ``reason``."""

    def __init__(self, path: str, reason: str):
        super().__init__(f"skipping {path}: {reason}")
        self.path, self.reason = path, reason


def _escaped(path: str) -> str:
    return re.sub(r"([\\{}\[\]*?])", r"\\\1", path)


def _undecodable(spark: SparkSession, files: list[str]) -> dict[str, str]:
    """Those of ``files`` that can't be decoded to the end, and why; halved until each stands alone (runs jobs)."""
    if not files:
        return {}
    try:
        spark.read.option("ignoreCorruptFiles", "false").text([_escaped(f) for f in files]).agg(F.count("value")).collect()
    except (Py4JJavaError, PySparkException) as problem:
        reason, _, frames = str(problem).rpartition("Caused by: ")[2].partition("\n")
        if not frames.lstrip().startswith(_DECODERS):
            raise
        if len(files) == 1:
            return {files[0]: reason}
        half = len(files) // 2
        return _undecodable(spark, files[:half]) | _undecodable(spark, files[half:])
    return {}


@contextmanager
def _few_listers(spark: SparkSession) -> Iterator[None]:
    """Lists files in some tasks a core: with thousands of small files Spark's own number starts 10,000 tasks of some files each."""
    before = spark.conf.get(_LISTERS, None)
    spark.conf.set(_LISTERS, str(min(int(before or 10_000), 4 * spark.sparkContext.defaultParallelism)))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_LISTERS)
        else:
            spark.conf.set(_LISTERS, before)


def read_lines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """(file_path, block_start, line_id, value) of every non-empty line.

    Compressed files are decoded once before (a job; other bytes are always text). One that can't be decoded to its
    end is skipped whole with an :class:`UnreadableFile` warning, and :func:`unread_files` lists it. Every other
    failure of reading, then or later, fails the job: no line is lost in silence. Files are listed and plain ones read by tasks
    (:mod:`gaitframe.sources.files`); Spark reads the compressed ones, and all where tasks can't open the path.
    """
    paths = [path] if isinstance(path, str) else list(path)
    if not can_open(spark, paths):
        with _few_listers(spark):
            packed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", _COMPRESSED).load(path).select("path")
            bad = _unreadable(spark, [r.path for r in packed.collect()])
            found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path") if bad else None
            return _with_text(_spark_text(spark, [_escaped(r.path) for r in found.collect() if r.path not in bad] if bad else path))
    files = listed(spark, paths)
    compressed = F.substring_index("path", ".", -1).isin(_PACKED.split(",")) & F.col("path").contains(".")
    blocks, size, packed = sizes(spark, files, compressed)
    bad = _unreadable(spark, packed)
    rows = read_plain(spark, files.filter(~compressed), blocks, size)
    if len(bad) < len(packed):
        rows = rows.unionByName(_spark_text(spark, [_escaped(p) for p in packed if p not in bad]))
    return _with_text(rows)


def _unreadable(spark: SparkSession, packed: list[str]) -> dict[str, str]:
    bad = _undecodable(spark, sorted(packed))
    for file, reason in bad.items():
        warnings.warn(UnreadableFile(file, reason), stacklevel=3)
    return bad


def _spark_text(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """The lines of ``path`` by Spark's reader; no line for an empty list."""
    with _few_listers(spark):
        found = spark.read.option("recursiveFileLookup", "true").option("ignoreCorruptFiles", "false").text(path) if path else None
    if found is None:
        return spark.createDataFrame([], "file_path string, block_start long, line_id long, value string, modified timestamp")
    return found.select(
        F.url_decode("_metadata.file_path").alias("file_path"), F.col("_metadata.file_block_start").alias("block_start"),
        F.monotonically_increasing_id().alias("line_id"), "value", F.col("_metadata.file_modification_time").alias("modified"))


def _with_text(lines: DataFrame) -> DataFrame:
    return lines.filter(F.length(F.trim("value")) > 0)


def unread_files(spark: SparkSession, path: str | Sequence[str], lines: DataFrame) -> DataFrame:
    """``file_path, reason, n_lines`` of the files with bytes but no line in ``lines`` (of the same path), as
    :func:`quarantine` has them. Only the listing of the files is read."""
    paths = [path] if isinstance(path, str) else list(path)
    if can_open(spark, paths):
        found = listed(spark, paths)
    else:
        with _few_listers(spark):
            found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    sized = found.filter("length > 0").select(F.url_decode(F.col("path")).alias("file_path"))
    seen = lines.select(F.regexp_replace("file_path", "^file:/+", "/").alias("_seen")).distinct()
    return sized.join(seen, F.regexp_replace("file_path", "^file:/+", "/") == F.col("_seen"), "left_anti").select(
        "file_path", F.lit("no readable line").alias("reason"), F.lit(0).cast("long").alias("n_lines"))


def file_name(path: Column | str = "file_path") -> Column:
    return F.substring_index(path, "/", -1)


def stem(path: Column | str = "file_path") -> Column:
    """File name without folder and extension."""
    return F.regexp_extract(file_name(path), r"^(.+?)(\.[^.]*)?$", 1)


def parent(path: Column | str = "file_path") -> Column:
    return F.substring_index(F.substring_index(path, "/", -2), "/", 1)


def stem_part(i: int, default: str) -> Column:
    """``i``-th part of the file stem between underscores."""
    return F.coalesce(F.get(F.split(stem(), "_"), F.lit(i)), F.lit(default))


def computed_once(*columns: Column) -> Column:
    """Columns for ``select`` that are worked out once per row.

    Filters on a parsed field would else be moved below the parsing, and every use would parse the
    line again; they are not moved below a generator.
    """
    return F.inline(F.array(F.struct(*columns)))


def with_file_columns(lines: DataFrame, describe: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Lines with columns that depend on the file alone. ``describe`` gets one row per file and may
    drop files; names are parsed once per file and not once per line."""
    return lines.join(describe(lines.select("file_path").distinct()), "file_path")


def with_header(lines: DataFrame, columns: dict[str, Sequence[str]], comment: str | None = None,
                describe: Callable[[DataFrame], DataFrame] = lambda files: files) -> DataFrame:
    """Data lines with their ``fields`` and, per wanted column, its place in the file's header.

    ``columns`` lists the accepted names per column. The header table has one row per file, made
    by a map-side combined aggregate over the first split of each file; places, missing columns
    and everything ``describe`` adds are worked out on it.
    """
    if comment:
        lines = lines.withColumn("value", F.split("value", comment)[0]).filter(F.length(F.trim("value")) > 0)
    at = F.struct(*LINE_ORDER)
    files = lines.filter(F.col("block_start") == 0).groupBy("file_path").agg(F.min_by("value", at).alias("_h"), F.min(at).alias("_at"))
    files = files.withColumn("_h", F.transform(F.split("_h", ","), lambda v: F.lower(F.trim(F.translate(v, '"', "")))))
    places = {f"_at_{c}": F.coalesce(*[F.nullif(F.array_position("_h", F.lit(n)), F.lit(0)) for n in names]) - 1
              for c, names in columns.items()}
    files = files.withColumns({n: p.cast("int") for n, p in places.items()}).withColumn("_width", F.size("_h"))
    lacking = F.array(*[F.when(F.col(f"_at_{c}").isNull(), F.lit(c)) for c in columns])
    files = describe(files.withColumn("_missing", F.array_join(lacking, ",")).drop("_h"))
    return (lines.join(files, "file_path").filter(at != F.col("_at")).drop("_at")
            .select("*", computed_once(F.split("value", ",").alias("fields"))))


def field(column: str) -> Column:
    """Text of a column of :func:`with_header`; NULL where the file or the line lacks it."""
    return F.trim(F.translate(F.get("fields", F.col(f"_at_{column}")), '"', ""))


def number(column: str) -> Column:
    return field(column).try_cast("double")


def too_long() -> Column:
    """A line with more fields than its header: malformed, skipped by every reader."""
    return F.size("fields") > F.col("_width")


def quarantine(rows: DataFrame) -> DataFrame:
    """What the readers leave out: malformed lines, and files lacking a column."""
    reason = F.when(F.col("_missing") != "", F.concat(F.lit("missing columns: "), "_missing")).when(too_long(), "malformed lines")
    return rows.select("file_path", reason.alias("reason")).filter(F.col("reason").isNotNull()).groupBy("file_path", "reason").agg(
        F.count(F.lit(1)).alias("n_lines"))


def usable(rows: DataFrame, optional: Sequence[str] = ()) -> DataFrame:
    """Well-formed lines of files that have every column but the ``optional`` ones."""
    missing = F.filter(F.split("_missing", ","), lambda c: ~c.isin("", *optional))
    return rows.filter((F.size(missing) == 0) & ~too_long())
