import collections
import random
import zlib

import pytest
from pyspark.sql import functions as F

from gaitframe.llm import sharding


def check(rows, got, shards):
    assert len(got) == len(rows)
    assert collections.Counter(r.doc_id for r in got) == collections.Counter(i for i, _ in rows)
    counts = collections.Counter(r.shard for r in got)
    sizes = [counts.get(s, 0) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1 and set(counts) <= set(range(shards))
    for s in counts:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(counts[s]))
    texts = dict(rows)
    for r in got:
        if list(i for i, _ in rows).count(r.doc_id) == 1:
            raw = (texts[r.doc_id] or "").encode()
            assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "rows", None)


def spread(rows, got):
    """Shards used by each group of equal texts beyond those it needs."""
    text = dict(rows)
    used = collections.defaultdict(collections.Counter)
    for r in got:
        if text[r.doc_id] is not None:
            used[text[r.doc_id]][r.shard] += 1
    return {t: len(c) for t, c in used.items() if sum(c.values()) > 1}


@pytest.mark.parametrize("bucket_rows", [4_000, 50])
def test_groups_come_together(spark, monkeypatch, bucket_rows):
    monkeypatch.setattr(sharding, "BUCKET_ROWS", bucket_rows)
    rng = random.Random(1)
    rows = [(i, f"text {i}") for i in range(700)]
    rows += [(1000 + i, f"copy {rng.randrange(60)}") for i in range(200)] + [(2000 + i, "large group") for i in range(100)]
    got = sharding.assign_shards(spark.createDataFrame(rows, "doc_id long, text string").withColumn("shard", F.lit("clash")), 8).collect()
    check(rows, got, 8)
    assert set(spread(rows, got).values()) == {1}


def test_group_of_a_third_fills_whole_shards(spark):
    rows = [(i, f"text {i}") for i in range(600)] + [(1000 + i, "hot") for i in range(300)]
    got = sharding.assign_shards(spark.createDataFrame(rows, "doc_id long, text string"), 9).collect()
    check(rows, got, 9)
    assert spread(rows, got)["hot"] <= 4


def test_only_pairs(spark):
    rows = [(i, f"text {i // 2}") for i in range(800)]
    got = sharding.assign_shards(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()
    check(rows, got, 4)
    assert sum(n == 1 for n in spread(rows, got).values()) > 360


def test_cases(spark):
    rows = [(1, None), (2, None), (3, ""), (4, ""), (None, "a"), (5, "é" * 100_000), (6, "a"), (7, "b"), (7, "b")]
    got = sharding.assign_shards(spark.createDataFrame(rows, "doc_id long, text string"), 16).collect()
    check(rows, got, 16)
    assert sharding.assign_shards(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_goes_on_until_nothing_moves(spark, monkeypatch):
    moved, plain = [], sharding._round

    def counted(rows, buckets):
        out = plain(rows, buckets)
        moved.append(out[1])
        return out

    monkeypatch.setattr(sharding, "_round", counted)
    rng = random.Random(5)
    rows = [(i, f"copy {int(rng.paretovariate(0.6)) % 40}") for i in range(500)] + [(1000 + i, f"text {i}") for i in range(40)]
    got = sharding.assign_shards(spark.createDataFrame(rows, "doc_id long, text string"), 6).collect()
    check(rows, got, 6)
    assert moved[-1] == 0 and all(moved[:-1])
