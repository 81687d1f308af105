"""Operator 12: licence scans by a positional index of rare words.

Licence texts are templates of words. A word's weight is its rarity over all documents
(inverse document frequency). The index holds, for each template, the postings (place in
the template) of its rarest words: as many as are needed so that the others together
weigh less than the share a match must have. Whatever aligns with a template well enough
therefore meets it in one of these words at the right place. A document's words are
looked up there; a posting and a word's place give an alignment, and postings that agree
on it meet. An alignment is then compared with the whole template and its key phrases
are verified around it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentrylake.llm.text import LOWER, as_strings, buffers, places, sliced, small_batches

#: Share of a template's weight that an alignment must match, in percent.
LEAST_SHARE = 50
#: Words by which a key phrase may stand before or after its place in the template.
SLACK = 12
#: Alignments that are compared with their template at a time.
COMPARED = 1 << 14

#: Phrases of the base, and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}


@dataclass(frozen=True)
class Template:
    """A licence text or notice, and the phrases without which it isn't that licence."""

    label: str
    words: str
    keys: tuple[str, ...]


# Wording of public licences and of the notices that they ask for.
TEMPLATES = (
    Template("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2 0",)),
    Template(
        "apache-2.0",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license "
        "you may obtain a copy of the license at http www apache org licenses license 2 0",
        ("you may not use this file except in compliance with the license", "apache"),
    ),
    Template("gpl-3.0", "this work is licensed under the gnu general public license version 3", ("gnu general public license version 3",)),
    Template("gpl-2.0", "this work is licensed under the gnu general public license version 2", ("gnu general public license version 2",)),
    Template(
        "gpl",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
        ("free software", "redistribute it and or modify it under the terms of the gnu general public license"),
    ),
    Template(
        "lgpl",
        "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation",
        ("gnu lesser general public license",),
    ),
    Template("agpl", "licensed under the gnu affero general public license version 3", ("gnu affero general public license",)),
    Template("mit", "released under the mit license", ("mit license",)),
    Template(
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software "
        "without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software",
        ("permission is hereby granted free of charge", "deal in the software without restriction"),
    ),
    Template(
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        ("redistribution and use in source and binary forms", "following conditions are met"),
    ),
    Template(
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
        ("permission to use copy modify and or distribute this software for any purpose",),
    ),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    Template("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
    Template("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    Template("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    Template("cc-by-nd", "licensed under cc by nd 4 0", ("cc by nd",)),
    Template("cc0", "released under cc0 1 0 universal public domain dedication", ("cc0 1 0",)),
    Template("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", ("creative commons attribution",)),
)

_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True  # bytes of words, once A-Z are lower-cased


def licence_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of all words joined, word bounds in them, words per text), lower-cased."""
    data, off = buffers(texts)
    data = LOWER[data]
    keep = _WORD[data]
    first = keep.copy()
    first[1:] &= ~keep[:-1]
    inner = off[:-1][off[:-1] < len(keep)]
    first[inner] |= keep[inner]
    starts = np.flatnonzero(first)
    before = np.cumsum(keep, dtype=np.int64)
    return data[keep], np.append(before[starts] - 1, int(keep.sum())), np.diff(np.searchsorted(starts, off))


class Vocabulary:
    """The words of all templates and phrases, as codes."""

    def __init__(self, templates: tuple[Template, ...], phrases: dict[str, str]):
        texts = [*(t.words for t in templates), *(k for t in templates for k in t.keys), *phrases]
        self.words = sorted({w for t in texts for w in t.split()})
        self.code = {w: i for i, w in enumerate(self.words)}

    def codes(self, text: str) -> np.ndarray:
        return np.array([self.code[w] for w in text.split()], np.int64)

    def coded(self, texts: pa.Array, gap: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(code of each word, -1 for words of no template; words per text; where each text begins), with `gap` times -1 after each text."""
        body, bounds, counts = licence_words(texts)
        first = np.cumsum(counts + gap) - counts - gap
        codes = np.full(int((counts + gap).sum()), -1, np.int64)
        if len(bounds) > 1:
            text, place = places(counts)
            codes[first[text] + place] = np.asarray(pc.index_in(as_strings(body, bounds), pa.array(self.words)).fill_null(-1))
        return codes, counts, first


def document_counts(docs: DataFrame, vocabulary: Vocabulary) -> tuple[int, np.ndarray]:
    """How many documents there are, and for each word of the vocabulary how many hold it; over all documents."""
    v = len(vocabulary.words)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(v + 1, np.int64)
        for batch in sliced(batches, "text"):
            codes, counts, _ = vocabulary.coded(batch.column("text"))
            doc = np.repeat(np.arange(len(counts)), counts)
            have = np.unique(doc[codes >= 0] * v + codes[codes >= 0])
            total[:v] += np.bincount(have % v, minlength=v)
            total[v] += len(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(v + 1)), pa.array(total)], ["word", "n"])

    got = docs.select("text").mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()  # a row for each word of the vocabulary
    total = np.zeros(v + 1, np.int64)
    for r in got:
        total[r["word"]] = r["n"]
    return int(total[v]), total[:v]


class Index:
    """Weights of words, templates as codes, and the postings of each template's rarest words."""

    def __init__(self, templates: tuple[Template, ...], phrases: dict[str, str], vocabulary: Vocabulary, n: int, df: np.ndarray, least: int = LEAST_SHARE):
        self.vocabulary, self.least = vocabulary, least
        #: Whole numbers, so that sums don't depend on their order; no word weighs nothing.
        self.weight = 1 + np.round(1024 * np.log2((n + 1) / (df + 1))).astype(np.int64)
        self.codes = [vocabulary.codes(t.words) for t in templates]
        self.total = np.array([int(self.weight[c].sum()) for c in self.codes], np.int64)
        self.keys = [[vocabulary.codes(k) for k in t.keys] for t in templates]
        self.labels = [t.label for t in templates]
        #: Words between texts, so that no alignment and no phrase near it reaches from one into the next.
        self.gap = max((len(c) for c in self.codes), default=0) + SLACK + 1
        self.phrases = [(vocabulary.codes(p), label) for p, label in phrases.items()]
        words, owners, at = [], [], []
        for t, codes in enumerate(self.codes):
            order = sorted(range(len(codes)), key=lambda i, codes=codes: (-self.weight[codes[i]], i))
            rest = int(self.total[t])
            for i in order:  # until the rest can't make a match by itself
                if 100 * rest < least * int(self.total[t]):
                    break
                words.append(int(codes[i]))
                owners.append(t)
                at.append(i)
                rest -= int(self.weight[codes[i]])
        order = np.lexsort((at, owners, words))
        words, self.owner, self.at = np.array(words, np.int64)[order], np.array(owners, np.int64)[order], np.array(at, np.int64)[order]
        bounds = np.searchsorted(words, np.arange(len(vocabulary.words) + 1))
        self.begin, self.many = bounds[:-1], np.diff(bounds)

    def starts(self, codes: np.ndarray, phrase: np.ndarray) -> np.ndarray:
        """Where the phrase's words stand consecutively."""
        at = np.flatnonzero(codes[: max(0, len(codes) - len(phrase) + 1)] == phrase[0])
        for j in range(1, len(phrase)):
            at = at[codes[at + j] == phrase[j]]
        return at

    def alignments(self, codes: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(template, places where it would begin): from each word that has postings, each template's once."""
        hit = np.flatnonzero(codes >= 0)
        hit = hit[self.many[codes[hit]] > 0]
        of, j = places(self.many[codes[hit]])
        posting = self.begin[codes[hit]][of] + j
        begin, owner = hit[of] - self.at[posting], self.owner[posting]
        for t in np.unique(owner):
            yield int(t), np.unique(begin[owner == t])

    def matches(self, codes: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(template, a matching place, weight matched) of the alignments that match and whose key phrases stand; texts lie `gap` apart."""
        found: dict[bytes, np.ndarray] = {}
        for t, begin in self.alignments(codes):
            template = self.codes[t]
            weight, steps = self.weight[template], np.arange(len(template))
            for i in range(0, len(begin), COMPARED):
                own = begin[i : i + COMPARED]
                at = own[:, None] + steps
                inside = (at >= 0) & (at < len(codes))
                same = inside & (codes[np.clip(at, 0, len(codes) - 1)] == template)
                matched = same @ weight
                good = 100 * matched >= self.least * self.total[t]
                for phrase in self.keys[t]:
                    if good.any():
                        if phrase.tobytes() not in found:
                            found[phrase.tobytes()] = self.starts(codes, phrase)
                        where, high = found[phrase.tobytes()], own + len(template) + SLACK - len(phrase)
                        good &= np.searchsorted(where, high, "right") > np.searchsorted(where, own - SLACK, "left")
                if good.any():
                    yield t, (own + same.argmax(1))[good], matched[good]


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def scan_licences(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, phrases: dict[str, str] = PHRASES, least: int = LEAST_SHARE) -> DataFrame:
    """Licence labels of every whole text, by fixed phrases and by templates.

    n_base: places where a phrase's words stand consecutively, over all phrases;
    first_word, last_word: the least and the greatest such place, null without any.
    labels: those of the phrases and of each template with an alignment that matches
    `least` percent of its weight or more and that has each of its key phrases near
    (within SLACK words). score: the greatest share that such an alignment matches, 1
    where a phrase stands, else 0. Null and empty texts have no words and no labels
    (an empty string). Equal labels count once. Repeated rows each return a row; an
    empty table gives an empty result. Columns other than doc_id and text aren't looked
    at. Long texts are scanned whole.
    """
    small_batches(docs.sparkSession)
    vocabulary = Vocabulary(templates, phrases)
    n, df = document_counts(docs, vocabulary)
    index = Index(templates, phrases, vocabulary, n, df, least)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            codes, counts, first = vocabulary.coded(batch.column("text"), index.gap)
            m = len(counts)
            base: list[set] = [set() for _ in range(m)]
            n_base, low, high = np.zeros(m, np.int64), np.full(m, np.iinfo(np.int64).max), np.full(m, -1)
            score = np.zeros(m)
            for phrase, label in index.phrases:
                at = index.starts(codes, phrase)
                text = np.searchsorted(first, at, "right") - 1
                place = at - first[text]
                np.add.at(n_base, text, 1)
                np.minimum.at(low, text, place)
                np.maximum.at(high, text, place)
                for i in np.unique(text):
                    base[i].add(label)
            score[n_base > 0] = 1.0
            more = [set(b) for b in base]
            for t, at, matched in index.matches(codes):
                text = np.searchsorted(first, at, "right") - 1
                np.maximum.at(score, text, matched / index.total[t])
                for i in np.unique(text):
                    more[i].add(index.labels[t])
            none = n_base == 0
            arrays = [
                batch.column("doc_id"), pa.array(counts.astype(np.int64)), pa.array(n_base), pa.array(low, mask=none), pa.array(high, mask=none),
                pa.array([",".join(sorted(b)) for b in base], pa.string()), pa.array([",".join(sorted(b)) for b in more], pa.string()), pa.array(score),
            ]
            yield pa.RecordBatch.from_arrays(arrays, [f.split()[0] for f in SCHEMA.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(scan, SCHEMA)
