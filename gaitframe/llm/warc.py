"""WARC archives: written by Spark's text writer, read by a Python data source.

Writing. A record is one string: its header lines, an empty line and its block; the text writer ends every
record with the two line breaks the format asks for, so Spark's own committer makes the files and a retried
task leaves none behind. Of records with equal payloads of ``revisit_bytes`` or more, those of the largest id
are responses, the others revisits without the payload. The table of repeated payloads is written first, so
that the planner knows its size before it chooses how to join.

Reading. ``format("warc")`` plans partitions of whole files up to ``bytes_per_partition`` (a compressed archive
has no safe place to cut) and parses headers first; the block of a record that the predicates reject, or
whose payload the schema does not ask for, is skipped unread. Predicates on ``record_type``, ``record_id``,
``target_uri`` and ``payload_digest`` are pushed down where ``spark.sql.python.filterPushdown.enabled`` is on;
the ``record_types`` option does the same for types everywhere.

Cases. Null payloads are empty; null ids make records without an id, which are responses unless an equal
payload has an id; line breaks in ids and addresses are dropped, null addresses give no header. Rows that
repeat the largest id are all responses. An archive of no rows reads as no rows. Bytes that are no record
raise an error that names file and place.
"""

import gzip
import io
import re
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull
from pyspark.sql.types import StructType

from gaitframe.session import materialize

SCHEMA = ("record_id string, record_type string, target_uri string, warc_date string, content_type string, payload_digest string, "
          "refers_to string, payload_length long, headers map<string,string>, payload binary")
_NAMES = {"record_id": "warc-record-id", "record_type": "warc-type", "target_uri": "warc-target-uri", "warc_date": "warc-date",
          "content_type": "content-type", "payload_digest": "warc-payload-digest", "refers_to": "warc-refers-to"}
_PUSHED = {"record_type", "record_id", "target_uri", "payload_digest"}
_BATCH_BYTES = 4 << 20
CRLF = "\r\n"


def write_archive(df: DataFrame, path: str, record_id: str, uri: str, payload: str, revisit_bytes: int = 1000,
                  date: str = "2024-01-01T00:00:00Z", compression: str | None = None) -> None:
    """Writes one archive file per partition. ``record_id`` is a string column, ordered by ``revisit_order`` if
    the frame has such a column and else by itself; ``payload`` is a string (UTF-8) or binary column."""
    order = F.col("revisit_order") if "revisit_order" in df.columns else F.col(record_id)
    body = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    rows = df.select(F.regexp_replace(record_id, r"[\r\n]", "").alias("id"), order.alias("rank"),
                     F.regexp_replace(uri, r"[\r\n]", "").alias("uri"), body.alias("body"), F.sha1(body).alias("digest"))
    keys = df.select(F.regexp_replace(record_id, r"[\r\n]", "").alias("id"), order.alias("rank"), F.sha1(body).alias("digest"),
                     F.octet_length(body).alias("n")).filter(F.col("n") >= revisit_bytes)
    groups = keys.groupBy("digest").agg(F.max(F.when(F.col("rank").isNotNull(), F.struct("rank", "id"))).alias("last"), F.count(F.lit(1)).alias("n"))
    repeated = materialize(groups.filter("n > 1 AND last IS NOT NULL").select("digest", F.col("last.rank").alias("last_rank"), F.col("last.id").alias("last_id")), "payloads")
    joined = rows.join(repeated, "digest", "left")
    revisit = F.col("last_id").isNotNull() & ~F.col("rank").eqNullSafe(F.col("last_rank"))
    http = F.concat(F.lit(CRLF.join(["HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8", "Content-Length: "])),
                    F.octet_length("body").cast("string"), F.lit(CRLF * 2))
    block = F.when(revisit, http.cast("binary")).otherwise(F.concat(http.cast("binary"), F.col("body")))

    def header(name: str, value) -> "F.Column":
        return F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))).otherwise(F.lit(""))

    head = F.concat(
        F.lit(f"WARC/1.0{CRLF}"), header("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        header("WARC-Record-ID", F.concat(F.lit("<"), F.col("id"), F.lit(">"))), header("WARC-Date", F.lit(date)),
        header("WARC-Target-URI", F.col("uri")), header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        header("WARC-Profile", F.when(revisit, F.lit("http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"))),
        header("WARC-Refers-To", F.when(revisit, F.concat(F.lit("<"), F.col("last_id"), F.lit(">")))),
        header("Content-Type", F.lit("application/http; msgtype=response")),
        header("Content-Length", F.octet_length(block).cast("string")), F.lit(CRLF))
    writer = joined.select(F.concat(head.cast("binary"), block).cast("string").alias("value")).write.option("lineSep", CRLF * 2)
    (writer.option("compression", compression) if compression else writer).text(path)


def _filesystem(path: str) -> tuple[fs.FileSystem, str]:
    path = re.sub("^file:/(?!/)", "file:///", path)
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


class _Files(InputPartition):
    def __init__(self, files: list[str]):
        self.files = files


class ScanReader(DataSourceReader):
    """Reads whole archives; only the options restrict the records."""

    def __init__(self, schema: StructType, options: dict):
        self.path, self.names = options["path"], [f.name for f in schema.fields]
        unknown = set(self.names) - {c.split()[0] for c in SCHEMA.split(", ")}
        if unknown:
            raise ValueError(f"no columns of an archive: {sorted(unknown)}")
        self.size = int(options.get("bytes_per_partition", 64 << 20))
        types = options.get("record_types")
        self.allowed = {"record_type": set(types.split(","))} if types else {}

    def partitions(self) -> list[InputPartition]:
        system, root = _filesystem(self.path)
        found = system.get_file_info(fs.FileSelector(root, recursive=True)) if system.get_file_info(root).type == fs.FileType.Directory else [system.get_file_info(root)]
        parts, held = [], 0
        for f in sorted((f for f in found if f.type == fs.FileType.File and f.base_name[0] not in "._"), key=lambda f: f.path):
            if not parts or held + f.size > self.size:
                parts.append(_Files([]))
                held = 0
            parts[-1].files.append(f.path)
            held += f.size
        return parts or [_Files([])]

    def read(self, partition: _Files) -> Iterator[pa.RecordBatch]:
        system = _filesystem(self.path)[0]
        schema = pa.schema([(c.split()[0], {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}.get(
            c.split()[1], pa.map_(pa.string(), pa.string()))) for c in SCHEMA.split(", ")])
        schema = pa.schema([schema.field(n) for n in self.names])
        rows, held = [], 0
        for path in partition.files:
            with system.open_input_file(path) as file:
                for record in self._records(path, file):
                    rows.append(record)
                    held += 200 + len(record.get("payload") or b"")
                    if held >= _BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)

    def _records(self, path: str, file) -> Iterator[dict]:
        raw = io.BufferedReader(file, 1 << 20)
        stream = io.BufferedReader(gzip.GzipFile(fileobj=raw), 1 << 20) if path.endswith(".gz") else raw
        block = {"payload", "payload_length"} & set(self.names)
        while line := stream.readline():
            if not line.strip():
                continue
            if not line.startswith(b"WARC/"):
                raise ValueError(f"{path}: no record at {stream.tell() - len(line)}: {line[:40]!r}")
            headers = _headers(stream)
            length = int(headers.get("content-length", 0))
            row = {c: _plain(c, headers.get(h)) for c, h in _NAMES.items()}
            wanted = all(row[c] in v for c, v in self.allowed.items())
            if not wanted or not block:
                _skip(stream, length)
            else:
                row |= self._block(stream, headers, length)
            if wanted:
                row["headers"] = headers
                yield {c: row.get(c) for c in self.names}

    def _block(self, stream, headers: dict, length: int) -> dict:
        """Payload and its full length; of a revisit the length only."""
        if not headers.get("content-type", "").startswith("application/http"):
            if "payload" not in self.names:
                _skip(stream, length)
                return {"payload_length": length}
            return {"payload": stream.read(length), "payload_length": length}
        before, http = stream.tell(), {}
        if length:
            stream.readline()
            http = _headers(stream)
        rest = length - (stream.tell() - before)
        if headers.get("warc-type") == "revisit":
            _skip(stream, rest)
            return {"payload_length": int(http["content-length"]) if "content-length" in http else None}
        if "payload" not in self.names:
            _skip(stream, rest)
            return {"payload_length": rest}
        return {"payload": stream.read(rest), "payload_length": rest}


class WarcReader(ScanReader):
    """Takes equality and membership predicates on the columns of record headers."""

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            name = f.attribute[0] if isinstance(f, EqualTo | In | IsNotNull) else None
            if name not in _PUSHED or isinstance(f, IsNotNull):
                yield f
            else:
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.allowed[name] = self.allowed[name] & values if name in self.allowed else values


def _headers(stream) -> dict[str, str]:
    """Header fields by lower-case name up to the empty line; folded lines are joined."""
    fields, last = {}, None
    while (line := stream.readline()).strip():
        text = line.decode("utf-8", "replace").rstrip("\r\n")
        if text[:1] in " \t" and last:
            fields[last] += " " + text.strip()
            continue
        last, _, value = text.partition(":")
        last = last.strip().lower()
        fields[last] = value.strip()
    return fields


def _plain(column: str, value: str | None) -> str | None:
    """Ids without their angle brackets, SHA-1 digests without their label."""
    if value is None:
        return None
    if column in ("record_id", "refers_to"):
        return value.removeprefix("<").removesuffix(">")
    return value.removeprefix("sha1:") if column == "payload_digest" else value


def _skip(stream, n: int) -> None:
    stream.seek(n, io.SEEK_CUR)


class WarcDataSource(DataSource):
    """Records of WARC files, plain or compressed, below ``path``; a schema of fewer columns reads fewer."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return WarcReader(schema, self.options)


class WarcScanDataSource(WarcDataSource):
    """The same without predicates, for sessions in which Python sources may not take any."""

    @classmethod
    def name(cls) -> str:
        return "warc_scan"

    def reader(self, schema: StructType) -> DataSourceReader:
        return ScanReader(schema, self.options)


def read_archive(spark: SparkSession, path: str, columns: list[str] | None = None, **options) -> DataFrame:
    """The records below ``path``; ``columns`` names those to read (without ``payload`` no block is decoded)."""
    pushes = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false") == "true"
    source = WarcDataSource if pushes else WarcScanDataSource
    spark.dataSource.register(source)
    known = {c.split()[0]: c for c in SCHEMA.split(", ")}
    schema = ", ".join(known[c] for c in columns) if columns else SCHEMA
    return spark.read.format(source.name()).schema(schema).options(**options).load(path)
