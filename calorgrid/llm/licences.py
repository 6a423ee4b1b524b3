"""Licence scans by a positional index of rare tokens.

Words are runs of letters and digits in lower case. The index holds, for each word of the templates, the templates
and places where it stands. How rare a licence word is follows from the number of documents of the whole table that
have it. Of each document and each template the ANCHORS rarest words that both have are looked up; places in the
document less places in the template give relative positions, and one at which NEEDED anchors agree is a candidate.
There the template's mandatory key phrases must stand in full within SLACK words of where they are expected; the
score is the share of the template's words, weighed by rarity, that stand within SLACK words of their places, and
with LEAST or more the template's label is found. Words that two sides have by accident thus cost a lookup, no label.

Every document is scanned alone; only the counts of the templates' own words leave it. The base are three phrases,
all places of which are counted whatever the templates say.

Defined cases: a null or empty text has no words, no labels and score 0; repeated rows are scanned alike; other
columns are kept, those named as the added ones are replaced; a template of fewer than NEEDED words needs all of them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from calorgrid.llm import kernel

ANCHORS = 5
NEEDED = 3
SLACK = 6
LEAST = 0.5

# Words of the licences and of their usual notices. A template is label, mandatory phrases, words.
BASE = (("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license"))
TEMPLATES = (
    ("mit", ("released under the mit license",), "released under the mit license"),
    ("mit", ("under the mit license",), "licensed under the mit license"),
    ("mit", ("permission is hereby granted free of charge", "without restriction"), "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("apache", ("licensed under the apache license",), "licensed under the apache license version 2 0"),
    ("apache", ("licensed under the apache license", "except in compliance with the license"), "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("gpl", ("gnu general public license",), "this work is licensed under the gnu general public license version 3"),
    ("gpl", ("gnu general public license", "free software foundation"), "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("lgpl", ("gnu lesser general public license",), "licensed under the gnu lesser general public license version 3"),
    ("agpl", ("gnu affero general public license",), "licensed under the gnu affero general public license version 3"),
    ("bsd", ("redistribution and use in source and binary forms", "are permitted provided that"), "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", ("under the bsd",), "licensed under the bsd 3 clause license"),
    ("isc", ("permission to use copy modify and or distribute this software",), "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl", ("mozilla public license",), "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("boost", ("boost software license",), "distributed under the boost software license version 1 0"),
    ("zlib", ("provided as is without any express or implied warranty",), "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software"),
    ("unlicense", ("released into the public domain",), "this is free and unencumbered software released into the public domain"),
    ("cc-by", ("licensed under cc by 4 0",), "licensed under cc by 4 0"),
    ("cc-by-sa", ("licensed under cc by sa",), "licensed under cc by sa 4 0"),
    ("cc-by-nc", ("licensed under cc by nc",), "licensed under cc by nc 4 0"),
    ("cc-by", ("creative commons attribution 4 0",), "licensed under the creative commons attribution 4 0 international license"),
    ("cc-by-sa", ("creative commons attribution sharealike",), "licensed under the creative commons attribution sharealike 4 0 international license"),
    ("cc-by-nc", ("creative commons attribution noncommercial",), "licensed under the creative commons attribution noncommercial 4 0 international license"),
)

MATCH = T.StructType([T.StructField("label", T.StringType()), T.StructField("template", T.IntegerType()), T.StructField("word", T.LongType()), T.StructField("score", T.DoubleType())])
ADDED = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_base", T.LongType()), T.StructField("first_word", T.LongType()), T.StructField("last_word", T.LongType()), T.StructField("base_labels", T.StringType()), T.StructField("labels", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("matches", T.ArrayType(MATCH))])


class Index:
    """The templates by word: numbers of their words, and of each word the places where a template has it."""

    def __init__(self, templates=TEMPLATES, base=BASE) -> None:
        self.labels = [label for label, _, _ in templates]
        self.base_labels = [label for label, _ in base]
        texts = [words.split() for _, _, words in templates]
        self.number = {w: k for k, w in enumerate(sorted({w for t in [*texts, *(p.split() for _, p in base)] for w in t}))}
        of = self.number.get
        self.words = [np.array([of(w) for w in t]) for t in texts]
        self.base = [np.array([of(w) for w in p.split()]) for _, p in base]
        self.phrases = []  # of each template the mandatory phrases and where it has them
        for (_, phrases, _), text in zip(templates, texts):
            own = [p.split() for p in phrases]
            at = [next((i for i in range(len(text)) if text[i : i + len(p)] == p), None) for p in own]
            if None in at:
                raise ValueError(f"a mandatory phrase is no part of its template: {phrases}")
            self.phrases.append([(np.array([of(w) for w in p]), i) for p, i in zip(own, at)])
        self.must = [np.unique(np.concatenate([p for p, _ in ps])) for ps in self.phrases]

    def places(self, template: int, word: int) -> np.ndarray:
        return np.flatnonzero(self.words[template] == word)


def _numbers(batch: pa.RecordBatch, text: str, index: Index) -> tuple[np.ndarray, np.ndarray]:
    """Of each word of a slice its number in the index or -1, and the first word of each text."""
    codes, words, first = kernel.letter_words(*kernel.flat(kernel.column(batch, text)))
    of = np.array([index.number.get(w, -1) for w in words.to_pylist()], np.int64)
    return (of[codes] if len(codes) else codes), first


def _presence(number: np.ndarray, first: np.ndarray, n: int) -> np.ndarray:
    """Which texts have which of the n words of the index."""
    has = np.zeros((len(first) - 1, n), bool)
    known = np.flatnonzero(number >= 0)
    has[np.searchsorted(first, known, side="right") - 1, number[known]] = True
    return has


def frequencies(docs: DataFrame, index: Index, text: str = "text") -> DataFrame:
    """word (its number in the index) and n: the documents that have it; a row with word -1 counts all documents."""

    def run(batches):
        for batch in kernel.slices(batches, text):
            got = _presence(*_numbers(batch, text, index), len(index.number)).sum(axis=0)
            some = np.flatnonzero(got)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(got[some], batch.num_rows))], names=["word", "n"])

    return docs.select(text).mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def rarity(docs: DataFrame, index: Index, text: str = "text") -> np.ndarray:
    """Inverse document frequency of each word of the index, over all documents; as many numbers as it has words."""
    n = {r["word"]: r["n"] for r in frequencies(docs, index, text).collect()}
    return np.log((n.get(-1, 0) + 1) / (np.array([n.get(w, 0) for w in range(len(index.number))]) + 1)) + 1


def _phrase_at(number: np.ndarray, phrase: np.ndarray) -> np.ndarray:
    """Where the words of a phrase stand one after the other."""
    n = len(number) - len(phrase) + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    at = np.flatnonzero(number[:n] == phrase[0])
    for k in range(1, len(phrase)):
        at = at[number[at + k] == phrase[k]]
    return at


def _near(places: np.ndarray, expected: np.ndarray) -> np.ndarray:
    """Which expected places have one of the sorted places within SLACK words."""
    return np.searchsorted(places, expected + SLACK, side="right") > np.searchsorted(places, expected - SLACK)


def match(number: np.ndarray, template: int, index: Index, idf: np.ndarray) -> tuple[int, float] | None:
    """The relative position and score of the best place of a template in a text, if it has one."""
    words = index.words[template]
    distinct = np.unique(words)
    common = np.intersect1d(distinct, number)
    anchors = common[np.lexsort((common, -idf[common]))][:ANCHORS]
    votes = [np.unique((np.flatnonzero(number == w)[:, None] - index.places(template, w)[None, :]).ravel()) for w in anchors]
    at, n = np.unique(np.concatenate(votes), return_counts=True)
    at = at[n >= min(NEEDED, len(distinct))]
    for phrase, place in index.phrases[template]:
        at = at[_near(_phrase_at(number, phrase), at + place)]
    if not len(at):
        return None
    got = np.zeros(len(at))
    for k, w in enumerate(words.tolist()):
        got += idf[w] * _near(np.flatnonzero(number == w), at + k)
    score = got / idf[words].sum()
    best = int(np.argmax(score))
    return (int(at[best]), min(1.0, float(score[best]))) if score[best] >= LEAST else None


def scan(docs: DataFrame, text: str = "text", templates=TEMPLATES, base=BASE) -> DataFrame:
    """Add n_words, n_base, first_word, last_word, base_labels, labels, score (the best of the templates found) and
    matches: label, number and score of each template found, and the word of the text where it starts."""
    index = Index(templates, base)
    idf = rarity(docs, index, text)
    kept = [c for c in docs.columns if c not in ADDED.fieldNames()]

    def run(batches):
        for batch in kernel.slices(batches, text):
            number, first = _numbers(batch, text, index)
            has = _presence(number, first, len(index.number))
            possible = np.stack([has[:, must].all(axis=1) for must in index.must])
            possible_base = np.stack([has[:, p].all(axis=1) for p in index.base])
            rows = [(int(n), 0, None, None, "", "", 0.0, []) for n in np.diff(first)]
            for k in np.flatnonzero(possible.any(axis=0) | possible_base.any(axis=0)).tolist():
                own = number[first[k] : first[k + 1]]
                places = [_phrase_at(own, p) for p in index.base]
                every = np.concatenate(places)
                labels = {label for label, p in zip(index.base_labels, places) if len(p)}
                found = [(t, *m) for t in np.flatnonzero(possible[:, k]).tolist() if (m := match(own, t, index, idf)) is not None]
                more = labels | {index.labels[t] for t, _, _ in found}
                matches = [{"label": index.labels[t], "template": t, "word": at, "score": s} for t, at, s in found]
                ends = (int(every.min()), int(every.max())) if len(every) else (None, None)
                rows[k] = (len(own), len(every), *ends, ",".join(sorted(labels)), ",".join(sorted(more)), max([0.0, *(s for _, _, s in found)]), matches)
            added = [pa.array(list(c), t) for c, t in zip(zip(*rows), ARROW)]
            yield pa.RecordBatch.from_arrays([*(kernel.column(batch, c) for c in kept), *added], names=[*kept, *ADDED.fieldNames()])

    given = docs.select(*[F.col(f"`{c}`") for c in kept])
    return given.mapInArrow(run, T.StructType([*given.schema.fields, *ADDED.fields]))


ARROW = (*[pa.int64()] * 4, pa.string(), pa.string(), pa.float64(), pa.list_(pa.struct([("label", pa.string()), ("template", pa.int32()), ("word", pa.int64()), ("score", pa.float64())])))


def digest(docs: DataFrame) -> DataFrame:
    """doc_id and what the scan adds but for the matches."""
    return scan(docs.select("doc_id", "text")).drop("text", "matches")
