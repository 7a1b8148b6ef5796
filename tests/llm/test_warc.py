import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from gaitframe.llm import warc

ROWS = [(1, "http://a/1", "x" * 1000), (2, "http://a/2", "x" * 1000), (3, "http://a/3", "x" * 999), (4, "http://a/4", "x" * 999),
        (5, None, None), (6, "http://a/6", ""), (7, "http://a/7\r\nX: y", "\r\n\r\nWARC/1.0\r\n\r\n" * 90), (9, "é", "ß\n" * 700), (8, "é", "ß\n" * 700),
        (10, "http://a/2", "x" * 1000), (10, "http://a/2", "x" * 1000), (11, "u", "z" * 2_000_000), (None, "v", "ß\n" * 700)]


def written(spark, rows, path, **options):
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash")).repartition(3)
    frame = frame.withColumn("rid", F.concat(F.lit("urn:page:"), F.col("page_id"))).withColumn("revisit_order", F.col("page_id"))
    warc.write_archive(frame, path, "rid", "url", "html", **options)
    return path


@pytest.mark.parametrize("compression", [None, "gzip"])
def test_round_trip(spark, tmp_path, compression):
    path = written(spark, ROWS, str(tmp_path / "a"), compression=compression)
    got = warc.read_archive(spark, path).collect()
    assert len(got) == len(ROWS)
    last = {}
    for i, _, h in ROWS:
        if len((h or "").encode()) >= 1000 and i is not None:
            last[h] = max(i, last.get(h, 0))
    for r in got:
        i = int(r.record_id.removeprefix("urn:page:")) if r.record_id else None
        html = next(h or "" for j, _, h in ROWS if j == i)
        assert r.payload_length == len(html.encode()) and r.payload_digest == hashlib.sha1(html.encode()).hexdigest()
        if html in last and last[html] != i:
            assert (r.record_type, r.payload, r.refers_to) == ("revisit", None, f"urn:page:{last[html]}")
        else:
            assert (r.record_type, bytes(r.payload), r.refers_to) == ("response", html.encode(), None)
    assert {r.target_uri for r in got if r.record_id == "urn:page:7"} == {"http://a/7X: y"}
    assert {r.target_uri for r in got if r.record_id == "urn:page:5"} == {None}


def test_headers_only_and_types(spark, tmp_path):
    path = written(spark, ROWS, str(tmp_path / "a"))
    got = warc.read_archive(spark, path, ["record_id", "record_type"], record_types="revisit", bytes_per_partition=1).collect()
    assert sorted(r.record_id or "" for r in got) == ["", "urn:page:1", "urn:page:2", "urn:page:8"]
    assert {r.record_type for r in got} == {"revisit"}
    with pytest.raises(Exception, match="no columns of an archive"):
        spark.read.format("warc_scan").schema("other string").load(path).collect()


def test_predicates_are_pushed(spark, tmp_path, monkeypatch):
    path = written(spark, ROWS, str(tmp_path / "a"))
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        frame = warc.read_archive(spark, path).filter("record_type = 'response' AND target_uri IN ('http://a/2', 'é')")
        assert sorted(r.record_id for r in frame.collect()) == ["urn:page:10", "urn:page:10", "urn:page:9"]
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    reader = warc.WarcReader(warc.StructType.fromDDL("record_id string"), {"path": path})
    left = list(reader.pushFilters([warc.EqualTo(("record_type",), "revisit"), warc.EqualTo(("warc_date",), "x"), warc.In(("record_id",), ("a", "b"))]))
    assert left == [warc.EqualTo(("warc_date",), "x")] and reader.allowed == {"record_type": {"revisit"}, "record_id": {"a", "b"}}


def test_members_other_types_and_bad_bytes(spark, tmp_path):
    info = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:i>\r\nContent-Type: application/warc-fields\r\nX-Long: a\r\n b\r\nContent-Length: 5\r\n\r\na: b\n\r\n\r\n"
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "x.warc.gz").write_bytes(gzip.compress(info) + gzip.compress(info.replace(b"urn:i", b"urn:j")))
    got = warc.read_archive(spark, str(tmp_path / "m")).orderBy("record_id").collect()
    assert [(r.record_id, r.record_type, bytes(r.payload), r.headers["x-long"]) for r in got] == [(i, "warcinfo", b"a: b\n", "a b") for i in ("urn:i", "urn:j")]
    (tmp_path / "m" / "y.warc").write_bytes(info + b"rubbish\r\n")
    with pytest.raises(Exception, match="no record at"):
        warc.read_archive(spark, str(tmp_path / "m")).collect()


def test_empty(spark, tmp_path):
    assert warc.read_archive(spark, written(spark, [], str(tmp_path / "a"))).count() == 0
