import random

import pytest

from gaitframe.llm import linededup as L


def run(spark, rows, **options):
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("line", L.F.lit("clash"))
    out = L.drop_repeated_lines(frame, spans="spans", **options)
    assert out.columns == ["doc_id", "text", "line", "spans"]
    return out.collect()


def line(rng, n):
    return " ".join(f"w{rng.randrange(10 ** 6)}" for _ in range(n))


def corpus():
    rng = random.Random(3)
    docs = [[line(rng, rng.randint(1, 40)) for _ in range(rng.randint(0, 30))] for _ in range(120)]
    passages = []
    for _ in range(25):
        passages.append([line(rng, rng.randint(1, 30)) for _ in range(rng.randint(1, 8))])
    passages.append([line(rng, 50)])
    for d in docs:
        for _ in range(rng.randint(0, 3)):
            at = rng.randint(0, len(d))
            d[at:at] = rng.choice(passages)
    return [(i, "\n".join(d)) for i, d in enumerate(docs)]


def brute(rows, least=50):
    """Lines that belong to a run of ``least`` words standing at one earlier place (ids in order, no repeats)."""
    seen, out = set(), {}
    for i, text in rows:
        lines = [(k, x.strip(), len(x.split())) for k, x in enumerate((text or "").split("\n")) if x.strip()]
        own, runs = {}, []
        for a in range(len(lines)):
            words = 0
            for b in range(a, len(lines)):
                words += lines[b][2]
                if words >= least:
                    runs.append((a, b, tuple(x[1] for x in lines[a:b + 1])))
                    own.setdefault(runs[-1][2], a)
                if words > 4 * least:
                    break
        out[i] = {lines[k][0] for a, b, key in runs if key in seen or own[key] < a for k in range(a, b + 1)}
        seen |= set(own)
    return out


def test_deletes_exactly_the_lines_of_repeated_runs(spark):
    rows = corpus()
    got, want = {r.doc_id: r for r in run(spark, rows)}, brute(rows)
    for i, text in rows:
        lines = text.split("\n")
        gone = {k for s in got[i].spans for k in range(s.first_line, s.last_line + 1)}
        assert {k for k in gone if lines[k].strip()} == want[i], i
        assert got[i].text == "\n".join(x for k, x in enumerate(lines) if k not in gone)
        assert all(sum(len(lines[k].split()) for k in range(s.first_line, s.last_line + 1)) == s.n_words >= 50 for s in got[i].spans)
    assert sum(map(len, want.values())) > 100


def test_lines_repeated_at_several_places_stay(spark):
    """A B, then B C, then A B C: nothing of more than 40 words is repeated. Common lines in a new order stay too."""
    rng, rows = random.Random(21), []
    for k in range(0, 180, 3):
        a, b, c = (line(rng, 20) for _ in range(3))
        rows += [(k, f"{a}\n{b}"), (k + 1, f"{b}\n{c}"), (k + 2, f"{a}\n{b}\n{c}")]
    common = [line(rng, 24) for _ in range(12)]
    rows += [(1000 + k, "\n".join(rng.sample(common, 12))) for k in range(40)]
    got, want = {r.doc_id: r for r in run(spark, rows)}, brute(rows)
    assert all(r.text == dict(rows)[i] for i, r in got.items() if i < 1000)
    assert all({k for s in got[i].spans for k in range(s.first_line, s.last_line + 1)} == want[i] for i, _ in rows)


def test_short_lines_at_the_end_of_a_run_go_with_it(spark):
    rng = random.Random(22)
    p = [line(rng, n) for n in (3, 30, 30, 10, 2)]
    got = {r.doc_id: r.text for r in run(spark, [(1, "\n".join(p)), (2, "\n".join(["x", *p[:2], "", *p[2:], "y"]))])}
    assert got == {1: "\n".join(p), 2: "x\ny"}


def test_cases(spark):
    rng = random.Random(4)
    p, q, short = line(rng, 60), line(rng, 55), line(rng, 20)
    rows = [(5, f"{p}\n{short}"), (2, f"intro\n  {p} \n\n{q}\nend"), (9, f"{short}\n{q}"), (9, f"{short}\n{q}"), (7, None), (8, ""),
            (None, p), (11, "\n".join([p] * 3)), (12, short), (13, "x" * 3_000_000 + "\n" + p)]
    got = {}
    for r in run(spark, rows):
        got.setdefault(r.doc_id, []).append(r.text)
    assert got[2] == [rows[1][1]]
    assert got[5] == [short]
    assert got[9] == [short, short]
    assert got[7] == [None] and got[8] == [""]
    assert got[None] == [""] and got[11] == [""]
    assert got[12] == [short]
    assert got[13] == ["x" * 3_000_000]


def test_first_copy_is_by_id_not_by_place(spark):
    rng = random.Random(8)
    p = line(rng, 70)
    got = {r.doc_id: r.text for r in run(spark, [(3, p), (1, f"a\n{p}"), (2, p)])}
    assert got == {1: f"a\n{p}", 2: "", 3: ""}


def test_empty(spark):
    assert run(spark, []) == []


@pytest.mark.parametrize("text", ["", "\n\n", "one\ntwo"])
def test_short_texts_have_no_windows(text):
    import numpy as np
    raw = text.encode()
    assert len(L.windows(L.Lines(np.frombuffer(raw, np.uint8), np.array([0, len(raw)])), 25, 50)[0]) == 0
