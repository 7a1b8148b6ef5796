import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from gaitframe.llm import bpe

TEXTS = [None, "", "a" * 5000, "x! x! é\U0001f600'll  \n\n z", "ab" * 3000 + "\u0000", "Straße ÉTÉ ñ\t\t1234", " ", "don't we'RE"]


@pytest.fixture(scope="module")
def ranks():
    return bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


@pytest.fixture(scope="module")
def known(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_ids_and_round_trip(spark, ranks, known):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    docs = docs.union(spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")).withColumn("pieces", F.lit(1))
    for r in bpe.decode(bpe.encode(docs, ranks, public_tokenizers.PATTERN), ranks).collect():
        assert list(r.ids) == known.encode_ordinary(r.text or "")
        assert bytes(r.decoded) == (r.text or "").encode()
        assert r.pieces == 1


def test_small_cache_gives_the_same(ranks, known, monkeypatch):
    monkeypatch.setattr(bpe, "CACHED_PIECES", 3)
    pieces = bpe._Pieces(ranks)
    for word in [" the", " extraordinary", "ß", " zzzzz", "aa", " the"]:
        assert list(pieces[word]) == known.encode_ordinary(word)
    assert len(pieces) <= 3


def test_fold_of_long_runs(ranks, known):
    for word in ["a" * 49, "ab" * 200, "".join(chr(97 + i * i % 26) for i in range(700))]:
        assert bpe.fold(word.encode(), ranks) == known.encode_ordinary(word)


def test_pieces_fold_together(ranks, known):
    """Pieces of all lengths, many in a block, as the fold one by one gives them; few rounds look at all pieces of a block."""
    rng = np.random.default_rng(7)
    letters = [*"etaoinshrdlu", "th", "ing", "é", "ß", "\U0001f600", " "]
    words = ["", "a", "zq", *("".join(rng.choice(letters, n)) for n in rng.integers(1, 60, 9_000))]
    folds, rounds = bpe.Folds(ranks), []
    rank = folds.rank
    folds.rank = lambda x, y: rounds.append(1) or rank(x, y)
    ids, counts = folds([w.encode() for w in words])
    assert [list(i) for i in np.split(ids, np.cumsum(counts)[:-1])] == [bpe.fold(w.encode(), ranks) for w in words]
    assert len(rounds) < 3 * 3 * bpe.HEAP_FROM
    pieces = bpe._Pieces(ranks)
    flat, sizes = pieces.encode([" the", "thing", " the", "zzqx"])
    assert list(flat) == known.encode_ordinary(" the") + known.encode_ordinary("thing") + known.encode_ordinary(" the") + known.encode_ordinary("zzqx")
    assert sizes.sum() == len(flat) and len(pieces) == 3


def test_expression_folds_alike(spark, ranks, known):
    words = [" the", " extraordinary", "ß", "zzzzz", "a", "12", "éternité", "\U0001f600"]
    rows = spark.createDataFrame([(w,) for w in words], "p string").withColumn(
        "ids", bpe.fold_expression(F.col("p").cast("binary"), ranks)).collect()
    assert all(list(r.ids) == known.encode_ordinary(r.p) for r in rows)


def test_decode_cases(spark, ranks):
    rows = bpe.decode(spark.createDataFrame([(1, []), (2, None)], "k int, ids array<int>"), ranks).orderBy("k").collect()
    assert bytes(rows[0].decoded) == b"" and rows[1].decoded is None
    with pytest.raises(Exception, match="INVALID_ARRAY_INDEX"):
        bpe.decode(spark.createDataFrame([([10 ** 6],)], "ids array<int>"), ranks).collect()


def test_empty(spark, ranks):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.decode(bpe.encode(none, ranks, public_tokenizers.PATTERN), ranks).count() == 0
