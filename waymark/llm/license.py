"""Licence scan by a positional rare-token index.

Licence words are those of the templates. Their document frequencies are counted over all files. Each template
whose mandatory phrases stand in a file has its own words of the highest IDF looked up there (word -> position),
and every occurrence votes for the place where the template would begin. They are as many as it takes for any
place that holds ``LEAST_SHARE`` of the template to have ``AGREE`` different ones of them, so no place is missed
and no notice takes another's words. Places where so many agree are candidates; one counts if the mandatory
phrases all stand in the text from there on, and its score is the share of the template's words found at their
relative positions, give or take ``SLACK`` words.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import bounded

#: Phrases of plain mentions and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: Label, opening words of the usual notice, and phrases that must stand in it.
TEMPLATES = (
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", ("apache license version 2",)),
    ("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", ("distributed under the license is distributed on an as is basis",)),
    ("mit", "released under the mit license", ("mit license",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("permission is hereby granted free of charge", "associated documentation files")),
    ("gpl", "this work is licensed under the gnu general public license version 3", ("gnu general public license",)),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", ("free software", "gnu general public license")),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license", ("gnu lesser general public license",)),
    ("agpl", "redistribute it and or modify it under the terms of the gnu affero general public license", ("gnu affero general public license",)),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", ("creative commons attribution",)),
    ("cc-by", "text available under cc by 4 0", ("cc by",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms",)),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("permission to use copy modify", "with or without fee is hereby granted")),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("unencumbered software released into the public domain",)),
)

SLACK = 2
#: Different rare words that must agree on a place, and the least share of a template's words.
AGREE, LEAST_SHARE = 3, 0.5

#: Word characters are ASCII letters and digits and everything beyond ASCII; A-Z are folded.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if chr(c).isalnum() or c > 127 else 32 for c in range(256))


def words(text: str | None) -> bytes:
    """A text's words, each with one space before and after."""
    w = (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()
    return b" " + b" ".join(w) + b" " if w else b" "


class Index:
    def __init__(self, idf: dict[bytes, float], templates=TEMPLATES):
        self.labels = [t[0] for t in templates]
        self.template = [t[1].encode().split() for t in templates]
        self.mandatory = [[b" " + p.encode() + b" " for p in t[2]] for t in templates]
        self.vocabulary = frozenset(w for t in self.template for w in t)
        self.rare = [self._rarest(t, idf) for t in self.template]

    @staticmethod
    def _rarest(template: list[bytes], idf: dict[bytes, float]) -> dict[bytes, list[int]]:
        """Positions of a template's words of the highest IDF, of as many as a place that counts can't do without."""
        places: dict[bytes, list[int]] = {}
        for pos, w in enumerate(template):
            places.setdefault(w, []).append(pos)
        least = math.ceil(LEAST_SHARE * len(template))
        order = sorted(places, key=lambda w: (-idf.get(w, 0.0), w))
        for n in range(AGREE, len(order)):
            left_out = sum(len(places[w]) for w in order[n:])
            repeated = sorted((len(places[w]) for w in order[:n]), reverse=True)
            if least - left_out > sum(repeated[: AGREE - 1]):
                return {w: places[w] for w in order[:n]}
        return places

    def _agreed(self, k: int, places: dict[bytes, np.ndarray]) -> list[int]:
        """Where a template may begin: places that enough of its rare words agree on, give or take ``SLACK`` words."""
        rare = self.rare[k]
        starts = [(n, (places[w][:, None] - np.array(pos)).ravel()) for n, (w, pos) in enumerate(rare.items()) if w in places]
        if not starts:
            return []
        word = np.repeat([n for n, _ in starts], [len(x) for _, x in starts])
        begin = np.concatenate([x for _, x in starts])
        each = np.unique(np.concatenate([(begin + d) * len(rare) + word for d in range(-SLACK, SLACK + 1)]))  # a word votes once for a place
        at, n = np.unique(each // len(rare), return_counts=True)
        return at[n >= min(AGREE, len(set(self.template[k])))].tolist()

    def match(self, text: bytes) -> dict[str, float]:
        """Best score of each label in a text from :func:`words`."""
        mine = text.split()
        found = self.vocabulary.intersection(mine)
        if len(found) < AGREE:
            return {}
        live = [k for k, phrases in enumerate(self.mandatory) if all(p in text for p in phrases)]
        if not live:
            return {}
        wanted = set().union(*[self.rare[k] for k in live])
        at: dict[bytes, list[int]] = {}
        for p, w in enumerate(mine):
            if w in wanted:
                at.setdefault(w, []).append(p)
        places = {w: np.array(p) for w, p in at.items()}
        out: dict[str, float] = {}
        for k in live:
            label, template = self.labels[k], self.template[k]
            for start in self._agreed(k, places):
                lo, hi = max(0, start - SLACK), start + len(template) + SLACK
                near = mine[lo:hi]
                where = b" " + b" ".join(near) + b" "
                if not all(p in where for p in self.mandatory[k]):
                    continue
                hit = sum(w in near[max(0, start + i - SLACK - lo) : max(0, start + i + SLACK + 1 - lo)] for i, w in enumerate(template))
                score = hit / len(template)
                if score >= LEAST_SHARE and score > out.get(label, 0.0):
                    out[label] = score
        return out


def mentions(text: bytes) -> list[tuple[int, str]]:
    """(word, label) of every place where a phrase's words stand in a text from :func:`words`."""
    out = []
    for phrase, label in PHRASES.items():
        p = b" " + phrase.encode() + b" "
        k, last, word = text.find(p), 0, 0
        while k >= 0:
            word += text.count(b" ", last, k)
            last = k
            out.append((word, label))
            k = text.find(p, k + 1)
    return sorted(out)


def idf(docs: DataFrame, text_col: str = "text") -> dict[bytes, float]:
    """IDF of the licence words over all documents; a row for each licence word reaches the driver."""
    vocabulary = Index({}).vocabulary

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, df = 0, dict.fromkeys(vocabulary, 0)
        for b in batches:
            for i in range(0, b.num_rows, 500):
                for t in b.column(0).slice(i, 500).to_pylist():
                    total += 1
                    for w in vocabulary.intersection(words(t).split()):
                        df[w] += 1
        yield pa.RecordBatch.from_arrays([pa.array([b"", *df], pa.binary()), pa.array([total, *df.values()], pa.int64())], names=["word", "n"])

    rows = bounded(docs).select(F.col(text_col).alias("text")).mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    n = {bytes(r["word"]): r["n"] for r in rows}
    total = n.pop(b"", 0)
    return {w: math.log((1 + total) / (1 + k)) for w, k in n.items()}


SCHEMA = "doc_id long, n_words long, places array<struct<word:long,label:string>>, base_labels array<string>, labels array<string>, score double"
_PLACES = pa.list_(pa.struct([("word", pa.int64()), ("label", pa.string())]))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, places, base_labels, labels, score) of every row of ``docs``.

    ``places`` are the plain mentions by word, ``labels`` theirs and the templates', ``score`` 1 where a phrase
    is mentioned, else the best template's. Null and empty texts have no words and score 0; repeated rows and
    null ids count each by itself; an empty table gives no rows; other columns are not read.
    """
    index = docs.sparkSession.sparkContext.broadcast(Index(idf(docs, text_col)))  # as large as the templates

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 500):
                n, places, base, labels, scores = [], [], [], [], []
                for t in b.column(1).slice(i, 500).to_pylist():
                    w = words(t)
                    found = mentions(w)
                    own = {label for _, label in found}
                    matched = index.value.match(w)
                    n.append(w.count(b" ") - 1 if len(w) > 1 else 0)
                    places.append([{"word": p, "label": label} for p, label in found])
                    base.append(sorted(own))
                    labels.append(sorted(own | matched.keys()))
                    scores.append(1.0 if own else max(matched.values(), default=0.0))
                cols = [pa.array(n, pa.int64()), pa.array(places, _PLACES), pa.array(base, pa.list_(pa.string())), pa.array(labels, pa.list_(pa.string())), pa.array(scores, pa.float64())]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 500), *cols], names=["doc_id", "n_words", "places", "base_labels", "labels", "score"])

    return bounded(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, SCHEMA)
