"""Lists and reads many plain text files in tasks.

Spark's file sources keep the status of every file on the driver and open every file anew in the JVM for each scan. Recordings
are many small files: here tasks list the folders, a level a job, into a written table, and other tasks read the files by blocks
of ``spark.sql.files.maxPartitionBytes``. The driver sees counts only. File systems that pyarrow can't open stay with Spark's readers.
"""

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaitframe.session import materialize

_ENTRIES = "source int, path string, folder boolean, length long, modified long, rest array<string>"
_LINES = "file_path string, block_start long, line_id long, value string, modified long"
_READ, _BATCH = 1 << 22, 16_384
#: Entries that a listing task names at a time; folders and files that are worth a task.
_LISTED, _FOLDERS, _FILES = 10_000, 16, 64


def open_store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub("^file:/+", "/", path))


def _full(path: str, inside: str) -> str:
    """What ``path`` begins with before the names of its file system."""
    return "file:" if inside == re.sub("^file:/+", "/", path) else path.removesuffix(inside)


def can_open(spark: SparkSession, paths: Sequence[str]) -> bool:
    """Whether tasks can open ``paths`` themselves; patterns of alternatives or with escapes are left to Spark."""
    default = spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS", "file:///")
    for path in paths:
        plain = re.match("^[A-Za-z][A-Za-z0-9+.-]*:", path) or (path.startswith("/") and default.startswith("file:"))
        if not plain or re.search(r"[{}\\]", path):
            return False
        try:
            open_store(_base(path)[0])
        except (pa.ArrowException, OSError, ValueError):
            return False
    return True


def _base(path: str) -> tuple[str, list[str]]:
    """The folder above the first pattern of ``path``, and the parts from there on."""
    parts = path.rstrip("/").split("/")
    first = next((i for i, p in enumerate(parts) if re.search(r"[*?\[]", p)), len(parts))
    return "/".join(parts[:first]) or "/", parts[first:]


def _matches(pattern: str, name: str) -> bool:
    parts = re.findall(r"\[[^\]]+\]|.", pattern, re.S)
    made = [".*" if p == "*" else "." if p == "?" else re.sub(r"^\[!", "[^", p) if len(p) > 1 else re.escape(p) for p in parts]
    return re.fullmatch("".join(made), name, re.S) is not None


def _hidden(name: str) -> bool:
    """The names that Spark's readers pass over."""
    return name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_")


def _list(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What the given folders hold, as far as the rest of the pattern matches."""
    schema = pa.schema([("source", pa.int32()), ("path", pa.string()), ("folder", pa.bool_()), ("length", pa.int64()), ("modified", pa.int64()), ("rest", pa.list_(pa.string()))])
    for row in (r for batch in batches for r in batch.to_pylist()):
        store, inside = open_store(row["path"])
        prefix, rest, found = _full(row["path"], inside), list(row["rest"]), []
        for info in store.get_file_info(fs.FileSelector(inside)):
            folder, name = info.type == fs.FileType.Directory, info.base_name
            if not (_matches(rest[0], name) if rest else not _hidden(name)) or (not folder and (len(rest) > 1 or _hidden(name))):
                continue
            found.append((row["source"], prefix + info.path, folder, info.size or 0, (info.mtime_ns or 0) // 1_000_000 * 1000, rest[1:]))
            if len(found) == _LISTED:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), schema)], schema=schema)
                found = []
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), schema)], schema=schema)


def listed(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """``path, length, modified`` (microseconds) of the files at or below ``paths``, which may be patterns (runs jobs). A path
    that matches nothing is an error, as in Spark's readers."""
    folders, files, unmatched = [], [], set()
    for i, path in enumerate(paths):
        base, rest = _base(path)
        store, inside = open_store(base)
        info = store.get_file_info(inside)
        if info.type == fs.FileType.NotFound or (rest and info.type == fs.FileType.File):
            raise AnalysisException(f"[PATH_NOT_FOUND] Path does not exist: {path}.")
        if rest:
            unmatched.add(i)
        full = _full(base, inside) + info.path
        if info.type == fs.FileType.File:
            files.append((i, full, False, info.size or 0, (info.mtime_ns or 0) // 1_000_000 * 1000, []))
        else:
            folders.append((i, full, True, 0, 0, rest))
    todo, n = spark.createDataFrame(folders, _ENTRIES).coalesce(1), len(folders)
    found = spark.createDataFrame(files, _ENTRIES).coalesce(1) if files or not n else None
    while n:
        tasks = min(-(-n // _FOLDERS), 2 * spark.sparkContext.defaultParallelism)
        level = materialize((todo.repartition(tasks) if tasks > 1 else todo).mapInArrow(_list, _ENTRIES), "listed")
        whole = F.size("rest") == 0
        seen = level.groupBy("source").agg(F.count_if("folder").alias("folders"), F.count_if(whole).alias("whole")).collect()
        unmatched -= {r.source for r in seen if r.whole}
        named = level.filter(~F.col("folder"))
        found = named if found is None else found.unionByName(named)
        todo, n = level.filter("folder"), sum(r.folders for r in seen)
    if unmatched:
        raise AnalysisException(f"[PATH_NOT_FOUND] Path does not exist: {paths[min(unmatched)]}.")
    return found.select("path", "length", "modified")


def block_lines(file, start: int, end: int) -> Iterator[list[bytes]]:
    """The lines that begin at ``start`` or later and before ``end``; they end with ``\\n``, ``\\r`` or both."""
    at = max(start - 1, 0)
    file.seek(at)
    skip, rest = start > 0, b""
    while at < end:
        piece = file.read(min(_READ, end - at))
        while piece.endswith(b"\r") and at + len(piece) < end:   # both bytes of an ending are seen together
            more = file.read(1)
            if not more:
                break
            piece += more
        if not piece:
            break
        first, at = at == start == 0, at + len(piece)
        if first:
            piece = piece.removeprefix(b"\xef\xbb\xbf")
        if b"\r" in piece:
            piece = piece.replace(b"\r\n", b"\n").replace(b"\r", b"\n")
        lines = piece.split(b"\n")
        lines[0] = rest + lines[0]
        rest = lines.pop()
        if skip and lines:
            skip = False
            del lines[0]
        if skip:
            rest = b""
        if lines:
            yield lines
    if rest and not skip:
        while piece := file.read(1 << 16):
            tail = re.split(rb"[\r\n]", piece, maxsplit=1)
            rest += tail[0]
            if len(tail) > 1:
                break
        yield [rest]


def _text(values: list[bytes]) -> pa.Array:
    try:
        return pa.array(values, pa.binary()).cast(pa.string())
    except pa.ArrowInvalid:
        return pa.array([v.decode("utf-8", "replace") for v in values], pa.string())


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    paths, starts, firsts, counts, times, values = [], [], [], [], [], []

    def made() -> pa.RecordBatch:
        n = np.array(counts)
        of = np.repeat(np.arange(len(n)), n)
        within = np.arange(len(of)) - np.repeat(n.cumsum() - n, n)
        return pa.RecordBatch.from_arrays([
            pa.array(paths, pa.string()).take(pa.array(of)), pa.array(np.array(starts, np.int64)[of]),
            pa.array(np.array(firsts, np.int64)[of] + within), _text(values), pa.array(np.array(times, np.int64)[of])],
            ["file_path", "block_start", "line_id", "value", "modified"])

    for row in (r for batch in batches for r in batch.to_pylist()):
        store, inside = open_store(row["path"])
        with store.open_input_file(inside) as file:
            before = 0
            for lines in block_lines(file, row["start"], row["end"]):
                for column, value in zip((paths, starts, firsts, counts, times), (row["path"], row["start"], before, len(lines), row["modified"])):
                    column.append(value)
                values.extend(lines)
                before += len(lines)
                if len(values) >= _BATCH:
                    yield made()
                    for column in (paths, starts, firsts, counts, times, values):
                        column.clear()
    if values:
        yield made()


def _bytes(size: str) -> int:
    number, unit = re.fullmatch(r"\s*(\d+)\s*([kmgt]?)i?b?\s*", size.lower()).groups()
    return int(number) << {"": 0, "k": 10, "m": 20, "g": 30, "t": 40}[unit]


def sizes(spark: SparkSession, files: DataFrame, apart: Column) -> tuple[int, int, list[str]]:
    """Blocks and bytes of ``files`` and the paths of those ``apart``, which are not counted (runs a job)."""
    block = _bytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    size = F.when(~apart, F.col("length"))
    row = files.agg(F.sum(F.ceil(size / block)), F.sum(size), F.collect_list(F.when(apart, F.col("path")))).first()
    return row[0] or 0, row[1] or 0, list(row[2])


def read_plain(spark: SparkSession, files: DataFrame, blocks: int, size: int) -> DataFrame:
    """(file_path, block_start, line_id, value, modified) of the lines of ``files`` from :func:`listed`, of as many ``blocks`` and
    bytes (runs a job)."""
    block = _bytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    zero, step = F.lit(0).cast("long"), F.lit(block).cast("long")
    parts = files.filter("length > 0").select("path", "modified", "length", F.explode(F.sequence(zero, F.col("length") - 1, step)).alias("start")).select(
        "path", "modified", "start", F.least(F.col("start") + step, F.col("length")).alias("end"))
    cores = 2 * spark.sparkContext.defaultParallelism
    tasks = max(1, min(-(-blocks // _FILES), cores), -(-blocks // (32 * _FILES)), -(-size // block))
    # written, as the lines are read several times and the table of files says nothing about their size
    rows = materialize(parts.repartition(tasks).mapInArrow(_read, _LINES), "lines", compression="zstd")
    return rows.withColumn("modified", F.timestamp_micros("modified"))
