"""The pipeline and the registered queries on documents with planted cases, against plain Python."""

import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

import __spark_entry__ as entry
import corpus_pipeline
from gaitframe.llm import bpe

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def line(rng, n):
    return " ".join(f"w{rng.randrange(50_000)}" for _ in range(n))


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    rng = random.Random(12)
    path = tmp_path_factory.mktemp("tables")
    docs, labels = {}, {}
    for d in range(500):
        docs[d] = "\n".join(line(rng, rng.randint(8, 40)) for _ in range(rng.randint(3, 8)))
        toxic = d % 6 == 0
        if toxic:
            words = docs[d].split(" ")
            for _ in range(6):
                words.insert(rng.randrange(len(words)), rng.choice(["vile", "rotten", "foul"]))
            docs[d] = " ".join(words)
        if d < 400:
            labels[d] = int(toxic)
    clean = [d for d in range(500) if d % 6]
    items = [(i, line(rng, rng.randint(15, 50))) for i in range(20)]
    passage, planted = line(rng, 60), {"copies": [], "leaks": [], "passages": [], "near": []}
    for k in range(10):
        docs[1000 + k] = docs[clean[k]]
        planted["copies"].append(1000 + k)
        docs[1100 + k] = f"{line(rng, 30)}\n{items[k][1]} {line(rng, 5)}"
        planted["leaks"].append(1100 + k)
        docs[1200 + k] = f"{line(rng, 70)}\n{passage}\n{line(rng, 20)}"
        planted["passages"].append(1200 + k)
        words = docs[clean[20 + k]].replace("\n", " ").split(" ")
        words[rng.randrange(len(words))] = "other"
        docs[1300 + k] = " ".join(words)
        planted["near"].append((clean[20 + k], 1300 + k))
    docs |= {1400: None, 1401: ""}
    rows = [(d, t, "en", "s", len(t or "")) for d, t in docs.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(d, 1, t) for d, t in labels.items()], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), docs, planted, passage, clean


def test_stages_in_turn(spark, planted, tmp_path):
    path, docs, cases, passage, clean = planted
    left, seen = spark.read.parquet(f"{path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, left, path)
        out.write.parquet(f"{tmp_path}/{name}")
        left = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = left.collect()
        if name != corpus_pipeline.STAGES[-1][0]:
            assert left.columns == COLUMNS
    ids = {name: {r.doc_id for r in rows} for name, rows in seen.items()}
    toxic = {d for d in range(500) if d % 6 == 0}
    assert not ids["toxicity"] & toxic and ids["toxicity"] == set(docs) - toxic
    assert ids["line_dedup"] == ids["toxicity"] - set(cases["copies"])
    held = [r.doc_id for r in seen["line_dedup"] if passage in (r.text or "")]
    assert held == [min(cases["passages"])]
    assert {r.doc_id for r in seen["line_dedup"] if r.text != docs[r.doc_id]} >= set(cases["passages"][1:])
    assert all(r.text == docs[r.doc_id] for r in seen["line_dedup"] if r.doc_id in clean)
    assert not any(b in ids["simhash_dedup"] for _, b in cases["near"]) and set(clean) <= ids["simhash_dedup"]
    assert ids["decontamination"] == ids["simhash_dedup"] - set(cases["leaks"])
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, special_tokens={},
                              mergeable_ranks=bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")))
    text = {r.doc_id: r.text or "" for r in seen["decontamination"]}
    assert all(list(r.ids) == known.encode_ordinary(text[r.doc_id]) and r.decoded == text[r.doc_id] for r in seen["bpe"])
    assert ids["bpe"] == ids["decontamination"]


def test_run_is_the_stages(spark, planted):
    path, _, cases, _, clean = planted
    ids = {r.doc_id for r in corpus_pipeline.run(spark, path).collect()}
    assert set(clean) <= ids and not ids & set(cases["copies"] + cases["leaks"])


def test_registered_queries(spark, planted):
    path, docs, cases, passage, _ = planted
    queries = entry.queries()
    assert {f"op{n}" for n in range(1, 11)} <= {q.split("_")[0] for q in queries} and "pipeline" in queries
    one = {r.doc_id: r for r in queries["op1_simhash"](spark, path).collect()}
    assert all(one[1000 + k].component_id < 500 and len(one[1000 + k].fingerprint) == 16 for k in range(10)) and one[1401].fingerprint == "0" * 16
    assert {r.doc_id for r in queries["op6_decontaminate"](spark, path).collect()} == set(cases["leaks"])
    gone = {r.doc_id for r in queries["op9_line_dedup"](spark, path).collect() if r.n_runs}
    assert gone >= set(cases["passages"][1:] + cases["copies"])
    five = queries["op5_toxicity"](spark, path).collect()
    assert sum(r.predicted == (r.doc_id < 500 and r.doc_id % 6 == 0) for r in five) >= 0.99 * len(five)
    ten = {r.doc_id: r for r in queries["op10_bpe"](spark, path).collect()}
    assert all(ten[d].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest() for d, t in docs.items())
    assert ten[1400].n_tokens == 0 and ten[1400].ids_sha256 == hashlib.sha256(b"").hexdigest()


def test_pages_query(spark, tmp_path):
    rows = [(1, "u", "p" * 1500), (2, "u", "p" * 1500), (3, "v", None), (4, "w", "q" * 900), (5, "w", "q" * 900)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: tuple(r)[1:] for r in entry.queries()["op3_warc"](spark, str(tmp_path)).collect()}
    sha = lambda t: hashlib.sha1(t.encode()).hexdigest()
    assert got == {1: (1500, sha("p" * 1500), "revisit", 2), 2: (1500, sha("p" * 1500), "response", None), 3: (0, sha(""), "response", None),
                   4: (900, sha("q" * 900), "response", None), 5: (900, sha("q" * 900), "response", None)}
