"""License scans by diagonal voting: texts that hold a license notice, word for word or with small edits.

Method. Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased. Every run of ``gram`` words of
a template (of all its words, if it has fewer) has a rolling hash and a position. The runs of the documents are joined
with them on hash and words, so a vote is a run of equal words and no accident of hashing. A vote at document word
``i`` and template word ``j`` lies on the diagonal ``i - j``; votes are aggregated by diagonal. A diagonal with all
votes of its template is the template word for word, a ``place``. Diagonals no farther apart than a fifth of the
template (two words at least) are merged, since an inserted or missing word moves the rest to the next diagonal. A span
is verified by its words: the words that the votes cover, on the side where they are fewer, over the longer one of
span and template; with ``similarity`` or more the document gets the template's label.

Scale. Templates are a parameter of the job (``TEMPLATE_BYTES`` at most, checked). The documents are read once; what
leaves a worker are the runs whose hash is marked in a table of ``2 ** MARK_BITS`` bits, which loses no run of a template
and holds back nearly all others before the join. A diagonal has no more votes than its template has words, and merging
joins each diagonal with fixed neighbours (two windows of twice the distance), so no group grows with a text or a key.

Cases. Null and empty texts have no words, no label and a score of zero. Rows with equal or null ids are scanned and
returned row by row. Equal words voted for at several positions of a template vote on each diagonal. Other columns are
ignored; an empty table gives an empty one. Templates without words vote for nothing.
"""

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaitframe.llm import textvec
from gaitframe.session import materialize

TEMPLATE_BYTES = 8 << 20
MARK_BITS = 22

#: The phrases that name a license.
PHRASES = [("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license")]

#: Notices as their licenses give them.
NOTICES = [
    ("mit", "Released under the MIT License."),
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
        rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
        persons to whom the Software is furnished to do so, subject to the following conditions:"""),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("apache", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
        with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"""),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
        License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later
        version."""),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("bsd", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
        following conditions are met:"""),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
        granted, provided that the above copyright notice and this permission notice appear in all copies."""),
    ("mpl", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
        distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."""),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
]


def _words(texts: pa.Array) -> textvec.Words:
    data, at = textvec.buffers(texts)
    return textvec.words(data, at, textvec.NO_TERM)


def _grams(w: textvec.Words, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, place among all words and hash of the runs of ``size`` words that stay within one text."""
    h, text = textvec.gram_hashes(textvec.word_hashes(w), size), w.text_of_word()
    inside = np.flatnonzero(text[:len(h)] == text[size - 1:]) if len(h) else np.zeros(0, np.int64)
    return text[inside], inside, textvec.mix(h[inside] + np.uint64(size))


def _spelled(w: textvec.Words, places: np.ndarray, size: int) -> list[str]:
    raw, start, end = w.data.tobytes(), w.start, w.end
    return [" ".join(raw[a:b].decode("utf-8", "replace") for a, b in zip(start[p:p + size].tolist(), end[p:p + size].tolist(), strict=True))
            for p in places.tolist()]


def template_grams(templates: Sequence[tuple[str, str]], phrases: Sequence[tuple[str, str]], gram: int) -> list[tuple]:
    """(template, label, is a phrase, words in it, run size, position, hash, run) for every run of every template."""
    rows, named = [], [(label, text, True) for label, text in phrases] + [(label, text, False) for label, text in templates]
    if sum(len(t.encode()) for _, t, _ in named) > TEMPLATE_BYTES:
        raise ValueError(f"more than {TEMPLATE_BYTES} bytes of templates: scan in several calls")
    for number, (label, text, phrase) in enumerate(named):
        w = _words(pa.array([text]))
        n = len(w.start)
        if n:
            size = min(gram, n)
            _, at, hashes = _grams(w, size)
            rows += [(number, label, phrase, n, size, j, h, run) for j, h, run in
                     zip(at.tolist(), hashes.view(np.int64).tolist(), _spelled(w, at, size), strict=True)]
    return rows


def _runs(sizes: list[int], marks: np.ndarray):
    """Per document: number of words, and the runs whose hash is marked."""
    kind = pa.list_(pa.struct([("at", pa.int32()), ("size", pa.int32()), ("hash", pa.int64()), ("run", pa.string())]))

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, at in textvec.slices(batch.column("text")):
                w = textvec.words(data, at, textvec.NO_TERM)
                found = []
                for size in sizes:
                    text, place, hashes = _grams(w, size)
                    hit = np.flatnonzero(marks[textvec.slots(hashes, MARK_BITS)])
                    found.append((text[hit], place[hit] - w.first[text[hit]], np.full(len(hit), size), hashes[hit].view(np.int64), _spelled(w, place[hit], size)))
                text, place, size, hashes = (np.concatenate([f[c] for f in found]) for c in range(4))
                order = np.lexsort((size, place, text))
                run = pa.array([r for f in found for r in f[4]], pa.string()).take(pa.array(order))
                columns = [pa.array(place[order].astype(np.int32)), pa.array(size[order].astype(np.int32)), pa.array(hashes[order]), run]
                ends = np.searchsorted(text[order], np.arange(j - i + 1))
                runs = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.StructArray.from_arrays(columns, ["at", "size", "hash", "run"]))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), pa.array(np.diff(w.first)), runs.cast(kind)], ["doc_id", "n_words", "runs"])

    return over


def _covered(places: str, size: str) -> Column:
    """Number of distinct words under runs that begin at ``places``."""
    return F.size(F.array_distinct(F.flatten(F.transform(places, lambda p: F.sequence(p, p + F.col(size) - 1)))))


def _similarity() -> Column:
    """Covered words over the longer one of span and template, from ``i``, ``j`` (starts of votes), ``size`` and ``n``."""
    span = F.array_max("i") - F.array_min("i") + F.col("size")
    return F.least(_covered("i", "size"), _covered("j", "size")) / F.greatest("n", span)


def scan(df: DataFrame, text: str = "text", doc_id: str = "doc_id", phrases: Sequence[tuple[str, str]] = PHRASES,
         templates: Sequence[tuple[str, str]] = NOTICES, gram: int = 3, similarity: float = 0.8) -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans`` per row of ``df``.

    ``n_base``, ``first_word`` and ``last_word`` are of the places of ``phrases``; ``labels`` adds those of verified
    spans; ``score`` is the largest similarity of any span; ``spans`` are the verified ones (label, first and last
    word, similarity). Runs a job (the documents' runs are a written table).
    """
    rows = template_grams(templates, phrases, gram)
    marks = np.zeros(1 << MARK_BITS, dtype=bool)
    marks[textvec.slots(np.array([r[6] for r in rows], np.int64).view(np.uint64), MARK_BITS)] = True
    name = df.schema[doc_id].dataType.simpleString()
    given = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    found = given.mapInArrow(_runs(sorted({r[4] for r in rows}), marks), f"doc_id {name}, n_words long, runs array<struct<at:int,size:int,hash:long,run:string>>")
    docs = materialize(found.withColumn("key", F.monotonically_increasing_id()), "license-runs")
    table = _template_table(df.sparkSession, rows)
    runs = docs.filter("size(runs) > 0").select("key", F.explode("runs").alias("r")).select("key", F.col("r.at").alias("i"), "r.hash", "r.run")
    votes = runs.join(table, ["hash", "run"]).select("key", "template", "label", "phrase", "n", "size", "i", "j")
    of = ["key", "template", "label", "phrase", "n", "size"]
    diagonals = votes.groupBy(*of, (F.col("i") - F.col("j")).alias("diagonal")).agg(F.collect_list("i").alias("i"), F.collect_list("j").alias("j"))
    base = F.col("phrase") & (F.size("i") == F.col("n") - F.col("size") + 1)
    diagonals = materialize(diagonals.withColumn("base", base), "license-diagonals")
    slack = F.greatest(F.lit(2), F.floor(F.col("n") / 5))
    window = F.floor(F.col("diagonal") / slack).cast("int")
    near = diagonals.withColumn("window", F.explode(F.array(window - 1, window))).groupBy(*of, "window").agg(
        F.flatten(F.collect_list("i")).alias("i"), F.flatten(F.collect_list("j")).alias("j"))
    parts = ["key", "label", "base", F.array_min("i").alias("first"), (F.array_max("i") + F.col("size") - 1).alias("last"), _similarity().alias("similarity")]
    spans = diagonals.select(*parts).union(near.withColumn("base", F.lit(False)).select(*parts))
    good = F.col("similarity") >= similarity
    begun = F.when(F.col("base"), F.col("first"))
    known = spans.groupBy("key").agg(
        F.count(begun).alias("n_base"), F.min(begun).cast("long").alias("first_word"), F.max(begun).cast("long").alias("last_word"),
        _joined(F.collect_set(F.when(F.col("base"), F.col("label")))).alias("base_labels"),
        _joined(F.collect_set(F.when(F.col("base") | good, F.col("label")))).alias("labels"), F.max("similarity").alias("score"),
        F.array_sort(F.collect_set(F.when(F.col("base") | good, F.struct("label", "first", "last", "similarity")))).alias("spans"))
    return docs.join(known, "key", "left").select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"), "spans")


def _joined(labels: Column) -> Column:
    return F.array_join(F.array_sort(labels), ",")


def _template_table(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    kept = [(r[6], r[7], r[0], r[1], r[2], r[3], r[4], r[5]) for r in rows]
    return spark.createDataFrame(kept, "hash long, run string, template int, label string, phrase boolean, n int, size int, j int")
