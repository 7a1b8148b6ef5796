import collections
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest

from gaitframe.llm import hmm


def small_chain(k=3, seed=1):
    chain = hmm.random_chain(k, seed)
    rng = np.random.default_rng(seed)
    start = rng.random(k)
    return chain._replace(start=start / start.sum(), emit=(e := rng.random((k, hmm.CLASSES + 1))) / e.sum(axis=1, keepdims=True))


def plain_forward(c, chain):
    a = chain.start * chain.emit[:, c[0]]
    total = math.log(a.sum())
    a = a / a.sum()
    for x in c[1:]:
        a = (a @ chain.move) * chain.emit[:, x]
        total += math.log(a.sum())
        a = a / a.sum()
    return total


@pytest.mark.parametrize("segment", [1, 3, 48])
def test_likelihood_matches_forward_recursion(segment):
    rng = np.random.default_rng(2)
    sizes = [1, 2, 3, 4, 7, 50, 1, 200]
    first = np.concatenate([[0], np.cumsum(sizes)])
    c, chain = rng.integers(0, hmm.CLASSES + 1, first[-1]), small_chain()
    got = hmm.log_likelihood(c, first, chain, segment)
    assert np.allclose(got, [plain_forward(c[a:b], chain) for a, b in zip(first[:-1], first[1:], strict=True)])


@pytest.mark.parametrize("segment", [2, 48])
def test_expected_counts_match_enumeration(segment):
    rng = np.random.default_rng(3)
    sizes = [1, 2, 6, 5]
    first = np.concatenate([[0], np.cumsum(sizes)])
    c, chain = rng.integers(0, 5, first[-1]), small_chain(2)
    counts, log = hmm.expected_counts(c, first, chain, segment)
    want, total = hmm.Chain(*(np.zeros_like(p) for p in chain)), 0.0
    for a, b in zip(first[:-1], first[1:], strict=True):
        paths = {}
        for z in itertools.product((0, 1), repeat=int(b - a)):
            p = chain.start[z[0]] * chain.emit[z[0], c[a]]
            for i in range(1, b - a):
                p *= chain.move[z[i - 1], z[i]] * chain.emit[z[i], c[a + i]]
            paths[z] = p
        norm = sum(paths.values())
        total += math.log(norm)
        for z, p in paths.items():
            want.start[z[0]] += p / norm
            for i, s in enumerate(z):
                want.emit[s, c[a + i]] += p / norm
                if i:
                    want.move[z[i - 1], s] += p / norm
    assert log == pytest.approx(total)
    assert all(np.allclose(g, w) for g, w in zip(counts, want, strict=True))


def test_iterations_raise_the_likelihood():
    rng = np.random.default_rng(4)
    sizes = rng.integers(1, 60, 80)
    first = np.concatenate([[0], np.cumsum(sizes)])
    c = np.concatenate([rng.integers(0, 40, n) + 100 * (i % 2) for i, n in enumerate(sizes)])
    chain, logs = hmm.random_chain(3), []
    for _ in range(8):
        counts, log = hmm.expected_counts(c, first, chain)
        logs.append(log)
        chain = hmm.maximise(counts, 1e-9)
    assert all(b >= a - 1e-6 for a, b in zip(logs, logs[1:], strict=False)) and logs[-1] > logs[0] + 50


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + ["<end>"]


def corpus():
    rng = random.Random(6)
    rows = []
    for d in range(500):
        kind = rng.choice("ab")
        rows.append((d, " ".join(f"{kind}{int(rng.paretovariate(1.0)) % 400}" for _ in range(rng.randint(0, 60)))))
    rows += [(900, None), (901, ""), (902, "Never seen Words A1"), (None, "a1 b1"), (903, "a1 a2 " * 20_000), (7, rows[7][1])]
    return rows


@pytest.mark.parametrize("head", [1 << 17, 3])
def test_scores_against_plain_counts(spark, monkeypatch, head):
    monkeypatch.setattr(hmm, "HEAD", head)
    rows = corpus()
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", hmm.F.lit("clash"))
    got = hmm.score_documents(frame, states=3, rounds=6).collect()
    out = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    counts = collections.Counter(w for i, t in rows if not out(i) for w in words(t))
    n, v = sum(counts.values()), len(counts)
    want = {}
    for i, t in rows:
        w = words(t)
        base = sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w)
        want[i] = (out(i), len(w), sum(counts[x] > 0 for x in w), base)
    assert sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, _ in rows)
    for r in got:
        h, k, known, base = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (h, k, known, n)
        assert r.base_score == pytest.approx(base, rel=1e-9)
    held = [r for r in got if r.held_out and r.n_tokens > 5]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_score_is_the_models_probability(spark):
    rows = [(i, t) for i, t in corpus() if i != 903]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    model = hmm.train(frame, states=2, rounds=3)
    counts = {r.h: r.c for r in model.counts.collect()}
    for r, (i, t) in zip(sorted(hmm.score(frame, model).collect(), key=lambda r: str(r.doc_id)), sorted(rows, key=lambda r: str(r[0])), strict=True):
        raw = (t or "").encode()
        h, _ = hmm.tokens(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        c = hmm.classes(h)
        word = sum(math.log10((counts.get(int(x), 0) + 1) / (model.class_tokens[k] + model.class_words[k] + 1)) for x, k in zip(h.view(np.int64), c, strict=True))
        assert r.score == pytest.approx(plain_forward(c, model.chain) / math.log(10) + word)


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert hmm.score_documents(none).count() == 0
    some = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    rows = hmm.score(some, hmm.train(none)).collect()
    assert all(r.n_known == 0 and r.base_score == 0 and r.score <= 0 and r.train_tokens == 0 for r in rows)


def test_every_round_sees_all_words_of_all_texts(spark):
    """The chain is that of Baum-Welch over everything; heads, tails and other texts count alike."""
    rows = [(i, f"head{i % 3} " * 2100 + f"tail{i % 5} " * 300) for i in range(6)] + [(10 + i, f"x{i} y{i % 7} z") for i in range(60)]
    raw = [t.encode() for _, t in rows]
    h, first = hmm.tokens(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    for stride in (1.0, 1.7):
        model = hmm.train(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), states=2, rounds=5, gain=0.0, stride=stride)
        want, logs = hmm.random_chain(2), [-np.inf]
        for step in range(5):
            sums, log = hmm.expected_counts(hmm.classes(h), first, want)
            new = hmm.maximise(sums)
            want = hmm._lengthened(want, new, stride) if step and log > logs[-1] else new
            logs.append(log)
        assert all(np.allclose(g, w, rtol=1e-5) for g, w in zip(model.chain, want, strict=True))


def test_training_ends_when_a_round_gains_little(spark, monkeypatch):
    rows = corpus()
    seen, plain = [], hmm._baum_welch
    monkeypatch.setattr(hmm, "_baum_welch", lambda *a: seen.append(plain(*a)) or seen[-1])
    hmm.train(spark.createDataFrame(rows, "doc_id long, text string"), states=3, rounds=30, gain=0.01)
    logs = [log for _, log in seen]
    n = sum(len(words(t)) for _, t in rows) * math.log(10)
    assert 2 < len(logs) < 30 and (logs[-1] - logs[-2]) / n < 0.01 and logs[-1] > logs[0]
