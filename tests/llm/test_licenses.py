import re

from gaitframe.llm import licenses

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
MIT = licenses.NOTICES[1][1]


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def base(text):
    w, places = words(text), []
    for label, phrase in licenses.PHRASES:
        p = phrase.split()
        places += [(i, label) for i in range(len(w)) if w[i:i + len(p)] == p]
    starts = [i for i, _ in places]
    return len(w), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({label for _, label in places}))


def scanned(spark, rows, **options):
    df = spark.createDataFrame([(i, t, 1, "x", None) for i, t in rows], "doc_id long, text string, n int, key string, label string").repartition(2)
    return licenses.scan(df, **options).collect()


def test_base_places_equal_brute_force_on_any_text(spark):
    odd = "MIT License; mit\nlicense! The GNU general-public LICENSE, general public public license. apache_license APACHE LICENSES"
    rows = [(1, odd), (2, None), (3, ""), (4, " ., "), (5, "mit license " * 20000), (6, "mit"), (7, "license mit"), (None, "MIT License"), (None, "MIT License"),
            (8, "é mit license É Apache License"), (1, odd), (9, "mit mit license license"), (10, "general public")]
    got = scanned(spark, rows)
    assert len(got) == len(rows)
    want = sorted(((i, *base(t)) for i, t in rows), key=str)
    assert sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got), key=str) == want
    assert all(r.score == 1.0 for r in got if r.n_base) and all(r.score == 0.0 and r.labels == "" for r in got if r.doc_id in (2, 3, 4))


def test_notices_are_found_with_edits_and_clean_texts_left_alone(spark):
    w = MIT.split()
    edited = w[:10] + ["really"] + w[10:25] + w[26:40] + ["thing"] + w[41:]
    prose = "the software was sold to persons who obtained copies of it and they use it without limitation " * 30
    halves = " ".join(w[:20]) + " " + "filler words between " * 40 + " ".join(w[20:])
    rows = [(1, f"Copyright\n{prose}\n{MIT}\n{prose}"), (2, prose + " ".join(edited)), (3, prose), (4, halves), (5, " ".join(w[:len(w) // 2])),
            (6, f"{MIT} {licenses.NOTICES[8][1]} {MIT}"), (7, "Licensed under CC BY-NC 4.0!"), (8, "licensed under cc")]
    got = {r.doc_id: r for r in scanned(spark, rows)}
    assert got[1].labels == got[2].labels == "mit" and got[1].score == 1.0 and 0.8 <= got[2].score < 1.0 and got[1].base_labels == ""
    assert all(got[i].labels == "" and got[i].score < 0.8 for i in (3, 4, 5, 8))
    assert got[6].labels == "bsd,mit" and got[7].labels == "cc-by-nc"
    at = len(words("Copyright\n" + prose))
    assert ("mit", at, at + len(words(MIT)) - 1, 1.0) in [tuple(s) for s in got[1].spans]
    assert all(0.0 <= r.score <= 1.0 for r in got.values())


def test_merged_diagonals_reach_further_than_single_ones(spark):
    w = [f"t{i}" for i in range(40)]
    text = " ".join(w[:20] + ["new"] + w[20:])
    got = scanned(spark, [(1, text)], templates=[("own", " ".join(w))], phrases=[])
    assert got[0].labels == "own" and got[0].score == 40 / 41 and got[0].n_base == 0


def test_templates_and_tables_may_be_empty(spark):
    assert scanned(spark, []) == []
    got = scanned(spark, [(1, "mit license")], templates=[("x", ""), ("y", " . ")], phrases=[("mit", "mit license")])
    assert [(r.labels, r.n_base) for r in got] == [("mit", 1)]
