"""Licence scans with a positional rare-token index.

The index is made of the templates: headings, notices and grants of licences.  A template
is matched where enough of its words stand at their places, within a tolerance for words
that were put in or left out, and its mandatory phrases stand whole.  Ranked by inverse
template frequency, the rarest words of a template that are more than a match may lack
are its postings (word to template and position): any match has some of them.

Of a file, the licence words with postings, its words of highest inverse frequency, are
looked up.  A posting (template, position) and a place give a shift, also a negative one
where a file begins inside a template; postings of a template are intersected by shift
within the tolerance.  Candidates are verified word by word: the share of the template in
place, and the mandatory phrases.

Base phrases are templates of their own whose mandatory phrase is the whole, and whose
rarest word alone makes a candidate; so every place of every phrase is found.  Whole texts
are scanned; nothing is capped.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import BYTE_HASH, _powers, group_rows, mixed
from .common import prepare, slices, text_or_empty, utf8

#: The base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Headings, notices and grants of public licences (label, words, mandatory phrases).
TEMPLATES = [
    ("mit", "mit license", ["mit license"]),
    ("mit", "released under the mit license", ["mit license"]),
    ("mit", "licensed under the terms of the mit license", ["mit license"]),
    ("mit", "spdx license identifier mit", ["identifier mit"]),
    ("mit-grant", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software", ["hereby granted", "free of charge"]),
    ("mit-grant", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ["hereby granted", "free of charge"]),
    ("mit-conditions", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", ["permission notice", "substantial portions"]),
    ("as-is", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement", ["as is", "warranty of any kind"]),
    ("no-liability", "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software", ["copyright holders be liable"]),
    ("apache-2.0", "apache license version 2 0", ["apache license"]),
    ("apache-2.0", "licensed under the apache license version 2 0", ["apache license"]),
    ("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", ["apache license", "in compliance with the license"]),
    ("apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied", ["agreed to in writing", "as is basis"]),
    ("apache-2.0", "spdx license identifier apache 2 0", ["identifier apache"]),
    ("bsd", "bsd license", ["bsd license"]),
    ("bsd", "bsd 2 clause license", ["bsd 2 clause"]),
    ("bsd", "bsd 3 clause license", ["bsd 3 clause"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ["redistribution and use", "binary forms"]),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", ["redistributions of source code", "list of conditions"]),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", ["redistributions in binary form", "list of conditions"]),
    ("isc", "isc license", ["isc license"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", ["with or without fee"]),
    ("gpl-grant", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ["you can redistribute it", "gnu general public license"]),
    ("gpl-grant", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details", ["in the hope that it will be useful", "gnu general public license"]),
    ("gpl-2.0", "gnu general public license version 2", ["gnu general public license", "version 2"]),
    ("gpl-2.0", "spdx license identifier gpl 2 0", ["identifier gpl 2"]),
    ("gpl-3.0", "gnu general public license version 3", ["gnu general public license", "version 3"]),
    ("gpl-3.0", "spdx license identifier gpl 3 0", ["identifier gpl 3"]),
    ("agpl", "gnu affero general public license", ["affero general public license"]),
    ("lgpl", "gnu lesser general public license", ["lesser general public license"]),
    ("mpl-2.0", "mozilla public license", ["mozilla public license"]),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    ("epl", "eclipse public license", ["eclipse public license"]),
    ("cc-by-nc", "cc by nc", ["cc by nc"]),
    ("cc-by-sa", "cc by sa", ["cc by sa"]),
    ("cc-by-nd", "cc by nd", ["cc by nd"]),
    ("cc0", "cc0 1 0 universal", ["cc0"]),
    ("cc-attribution", "creative commons attribution license", ["creative commons attribution"]),
    ("cc-attribution", "licensed under a creative commons attribution 4 0 international license", ["creative commons attribution"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["unencumbered software"]),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", ["authors be held liable"]),
    ("boost", "boost software license version 1 0", ["boost software license"]),
]

#: Share of a template's words that must stand at their places; postings that must agree on a shift, at most.
COVERED, AGREEING = 0.6, 4
#: A template of this many words or more may have words put in or left out: one for each so many of its words.
SHORTEST, EACH = 8, 8

_WORD_BYTE = np.zeros(256, bool)
_WORD_BYTE[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@dataclass(frozen=True)
class Template:
    label: str
    words: np.ndarray
    #: Start and end of each mandatory phrase.
    phrases: tuple[tuple[int, int], ...]
    is_base: bool
    #: How far words may be from their places, how many must be there, how many postings must agree.
    drift: int
    need: int
    agree: int


def word_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every word in lower-cased bytes: hash and document; and the first word of each document, with the end."""
    n = len(raw)
    inside = _WORD_BYTE[raw]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.concatenate([[False], inside[:-1]]) if n else inside
    starts = np.flatnonzero(inside & (~before | edge[:n]))
    after = np.concatenate([inside[1:], [False]]) if n else inside
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    first = np.searchsorted(starts, offsets)
    sizes = ends - starts
    at = np.flatnonzero(inside)
    # Positions within words, from the words' sizes alone.
    place = np.arange(len(at)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    values = BYTE_HASH[raw[at]] * _powers(int(sizes.max(initial=1)))[place]
    sums = np.add.reduceat(values, np.cumsum(sizes) - sizes) if len(sizes) else np.zeros(0, np.uint64)
    return mixed(sums + sizes.astype(np.uint64)), np.repeat(np.arange(len(offsets) - 1), np.diff(first)), first


class Index:
    def __init__(self, base: dict[str, str] = BASE, templates: list[tuple[str, str, list[str]]] = TEMPLATES):
        texts = [(label, p.split(), [p], True) for p, label in base.items()] + [(label, t.split(), must, False) for label, t, must in templates]
        self.vocabulary = sorted({w for _, words, _, _ in texts for w in words})
        number = {w: i for i, w in enumerate(self.vocabulary)}
        raw = np.frombuffer("".join(self.vocabulary).encode(), np.uint8)
        sizes = [len(w.encode()) for w in self.vocabulary]
        hashes, _, _ = word_spans(raw, np.concatenate([[0], np.cumsum(sizes)]))
        self.by_hash = np.argsort(hashes)
        self.hashes = hashes[self.by_hash]
        seen = Counter(w for _, words, _, _ in texts for w in set(words))
        self.idf = {w: math.log(len(texts) / n) for w, n in seen.items()}
        self.templates: list[Template] = []
        postings: list[list[tuple[int, int]]] = [[] for _ in self.vocabulary]
        for label, words, must, is_base in texts:
            n = len(words)
            need = n if is_base else math.ceil(COVERED * n)
            agree = 1 if is_base else min(AGREEING, need)
            drift = 0 if is_base or n < SHORTEST else n // EACH
            phrases = tuple(self._span(words, p.split()) for p in must)
            self.templates.append(Template(label, np.array([number[w] for w in words]), phrases, is_base, drift, need, agree))
            # A match lacks n - need words at most, so it has ``agree`` of these.
            ranked = sorted(range(n), key=lambda i, words=words: (-self.idf[words[i]], i))
            for i in ranked[: n - need + agree]:
                postings[number[words[i]]].append((len(self.templates) - 1, i))
        counts = np.array([len(p) for p in postings])
        flat = [x for p in postings for x in p]
        self.counts, self.starts = counts, np.cumsum(counts) - counts
        self.of, self.position = (np.array([x[k] for x in flat], np.int64) for k in (0, 1))
        self.drift, self.agree = (np.array([getattr(t, k) for t in self.templates], np.int64) for k in ("drift", "agree"))

    @staticmethod
    def _span(words: list[str], phrase: list[str]) -> tuple[int, int]:
        for i in range(len(words) - len(phrase) + 1):
            if words[i : i + len(phrase)] == phrase:
                return i, i + len(phrase)
        raise ValueError(f"{' '.join(phrase)} is no part of its template")

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each word in the vocabulary, -1 for others."""
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.by_hash[at], -1)

    def candidates(self, word: np.ndarray, doc: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, template, shift), distinct and sorted, at which enough postings agree with a shift or some after it."""
        hits = np.flatnonzero(word >= 0)
        # Words without postings are too common among templates to be looked up.
        hits = hits[self.counts[word[hits]] > 0]
        n = self.counts[word[hits]]
        which = group_rows(n)
        posting = self.starts[word[hits]][which] + np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
        template = self.of[posting]
        shift = hits[which] - first[doc[hits[which]]] - self.position[posting]
        order = np.lexsort((shift, template, doc[hits[which]]))
        d, t, s = doc[hits[which]][order], template[order], shift[order]
        # One number for each, in the same order: groups lie further apart than shifts reach.
        span = int(s.max(initial=0) - s.min(initial=0)) + int(self.drift.max(initial=0)) + 2
        key = (d * len(self.templates) + t) * span + (s - s.min(initial=0))
        votes = np.searchsorted(key, key + self.drift[t], side="right") - np.searchsorted(key, key, side="left")
        keep = votes >= self.agree[t]
        keep[1:] &= key[1:] != key[:-1]
        return d[keep], t[keep], s[keep]

    def verified(self, t: Template, words: np.ndarray, shift: int) -> float:
        """The largest share of the template in place for a shift whose drift reaches ``shift``; 0 if that is no match.

        With a base shift s, word i is in place if it stands at i + s to i + s + drift.
        """
        n, k = len(t.words), t.drift
        at = np.arange(n)[:, None] + np.arange(shift - k, shift + k + 1)[None]
        there = (at >= 0) & (at < len(words))
        same = there & (words[np.clip(at, 0, max(0, len(words) - 1))] == t.words[:, None])
        window = np.lib.stride_tricks.sliding_window_view
        covered = window(same, k + 1, axis=1).any(axis=2).sum(axis=0)
        fine = covered >= t.need
        for a, b in t.phrases:
            fine &= window(same[a:b].all(axis=0), k + 1).any(axis=1)
        return float(covered[fine].max() / n) if fine.any() else 0.0

    def scan(self, raw: np.ndarray, offsets: np.ndarray) -> list[dict]:
        """Findings of each document of a chunk."""
        hashes, doc, first = word_spans(_LOWER[raw], offsets)
        word = self.numbers(hashes)
        out = [
            {"n_words": int(n), "n_base": 0, "first_word": None, "last_word": None, "base": set(), "labels": set(), "score": 0.0} for n in np.diff(first)
        ]
        for d, number, shift in zip(*map(np.ndarray.tolist, self.candidates(word, doc, first)), strict=True):
            t, row = self.templates[number], out[d]
            share = self.verified(t, word[first[d] : first[d + 1]], shift)
            if not share:
                continue
            if t.is_base:
                row["n_base"] += 1
                row["first_word"] = shift if row["first_word"] is None else min(row["first_word"], shift)
                row["last_word"] = shift if row["last_word"] is None else max(row["last_word"], shift)
                row["base"].add(t.label)
                row["score"] = max(row["score"], 0.5)
            else:
                row["labels"].add(t.label)
                row["score"] = max(row["score"], share)
        return out


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, index: Index | None = None) -> DataFrame:
    """One row per input row: ``id_col``, n_words, n_base, first_word, last_word, base_labels, labels, score.

    A-Z are lower-cased; words are runs of characters other than ASCII ones that are no
    letter or digit.  n_base counts all places of base phrases; first_word and last_word are
    their smallest and largest start, null if there is none.  base_labels and labels are
    distinct, sorted and joined by commas (empty strings if none); labels also has what the
    templates found.  score is 0 without a finding, 0.5 for a base phrase alone, and the
    share of a template's words in place otherwise.  A null text counts as empty; rows
    repeated with one id give a row each; an empty table gives no rows; other columns are
    ignored.  Words are compared by 64-bit hashes.
    """
    idx = index or Index()
    prepare(docs.sparkSession)
    result = "_id {}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_t", 1 << 20):
            rows = idx.scan(*utf8(batch.column("_t")))
            number = lambda k: pa.array([r[k] for r in rows], pa.int64())
            yield pa.RecordBatch.from_pydict({"_id": batch.column("_id")} | {k: number(k) for k in ("n_words", "n_base", "first_word", "last_word")} | {
                "base_labels": pa.array([",".join(sorted(r["base"])) for r in rows], pa.string()),
                "labels": pa.array([",".join(sorted(r["base"] | r["labels"])) for r in rows], pa.string()),
                "score": pa.array([r["score"] for r in rows], pa.float64()),
            })

    src = docs.select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("_t"))
    return src.mapInArrow(run, result.format(src.schema["_id"].dataType.simpleString())).withColumnRenamed("_id", id_col)


def query(spark, sf_dir: str) -> DataFrame:
    return license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
