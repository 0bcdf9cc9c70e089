"""License scan: winnowed fingerprints in an inverted index, then banded alignment.

Templates and texts are read as words (ASCII letters and digits, lower-cased,
and all non-ASCII characters). Every run of ``k`` words has a hash; of each
``window`` neighbouring hashes the least is a fingerprint, so any shared
passage of k + window - 1 words has a shared fingerprint, wherever it stands.
Templates are indexed by fingerprint; a text's fingerprints are looked up, and
each hit votes for a (template, diagonal). Templates shorter than
k + window - 1 words are indexed and looked up by all their runs. Neighbouring diagonals make one
candidate, which a banded alignment of words (match 2, mismatch -1, gap -1,
local in the text) turns into a matched share of the template and a span.

Reported is every (text, template, place) whose matched words are at least
``least`` of the template. The templates are a broadcast of checked size:
``MOST_WORDS`` words; larger sets are scanned in blocks of templates, one job
each. Texts are scanned whole. NULL and empty texts have no match; repeated
rows repeat their matches; input columns named like a result column are
replaced.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from barloom.llm.common import lower_ascii
from barloom.llm.kernels import ALNUM, each_text
from barloom.session import cut

K, WINDOW, BAND, LEAST = 5, 4, 8, 0.8
MOST_WORDS = 200_000
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# fixed values: notices that publishers put into texts, and the openings of common licences
NOTICES = {
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance '
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    "bsd-conditions": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met:"),
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "gpl-3": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version."),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies."),
    "mit": "Released under the MIT License.",
    "mit-grant": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated '
        'documentation files (the "Software"), to deal in the Software without restriction'),
    "mpl-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was "
        "not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
}


def notices(spark: SparkSession) -> DataFrame:
    """The built-in templates as a table (template, text)."""
    return spark.createDataFrame(list(NOTICES.items()), "template string, text string")


def hashes(ids: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` word numbers."""
    with np.errstate(over="ignore"):
        h = np.zeros(len(ids) - k + 1, np.uint64)
        for i in range(k):
            h = h * np.uint64(0x9E3779B97F4A7C15) + ids[i:len(ids) - k + 1 + i] + np.uint64(1)
        h ^= h >> np.uint64(31)
        return h * np.uint64(0xD6E8FEB86659FD93)


def winnow(h: np.ndarray, window: int) -> np.ndarray:
    """Positions of the fingerprints: the rightmost least hash of each window."""
    if len(h) <= window:
        return np.array([len(h) - 1 - int(np.argmin(h[::-1]))]) if len(h) else np.empty(0, np.int64)
    views = np.lib.stride_tricks.sliding_window_view(h, window)[:, ::-1]
    return np.unique(np.arange(len(views)) + window - 1 - views.argmin(axis=1))


class Index:
    """Inverted index fingerprint -> (template, position), and the template words."""

    def __init__(self, templates: list[tuple[str, str]], k: int, window: int):
        self.number: dict[bytes, int] = {}
        self.names = [name for name, _ in templates]
        self.words = [np.array([self.number.setdefault(w, len(self.number) + 1) for w in text.encode().translate(ALNUM).split()],
                               np.uint64) for _, text in templates]
        self.k, self.window = k, window
        # a template of fewer than k + window - 1 words may fall between a text's fingerprints: all its runs are looked up
        self.post: dict[tuple[int, bool], dict[int, list[tuple[int, int]]]] = {}
        for t, words in enumerate(self.words):
            n, long = min(k, len(words)), len(words) >= k + window - 1
            if n:
                h = hashes(words, n)
                places = self.post.setdefault((n, long), defaultdict(list))
                for p in (winnow(h, window) if long else np.arange(len(h))).tolist():
                    places[int(h[p])].append((t, p))
        self.known = {kind: np.fromiter(places, np.uint64) for kind, places in self.post.items()}

    def candidates(self, ids: np.ndarray) -> list[tuple[int, list[int]]]:
        """(template, diagonals) of neighbouring hits; a diagonal is text minus template position."""
        votes = defaultdict(set)
        for (n, long), known in self.known.items():
            if len(ids) < n:
                continue
            h = hashes(ids, n)
            hit = np.isin(h, known)
            if not hit.any():
                continue
            at = winnow(h, self.window) if long else np.arange(len(h))
            at = at[hit[at]]
            for p, key in zip(at.tolist(), h[at].tolist(), strict=True):
                for t, q in self.post[n, long][key]:
                    votes[t].add(p - q)
        out = []
        for t, diagonals in votes.items():
            order = sorted(diagonals)
            chain = order[:1]
            for d in order[1:]:
                if d - chain[-1] > BAND:
                    out.append((t, chain))
                    chain = []
                chain.append(d)
            out.append((t, chain))
        return out


def align(template: np.ndarray, text: np.ndarray, shift: int, band: int) -> tuple[int, int, int]:
    """Best banded alignment of a template inside a text: (matched words, start, end) in text words.

    Row i of the template meets text positions i + shift - band to i + shift + band.
    """
    width = 2 * band + 1
    score, matched = np.zeros(width, np.int64), np.zeros(width, np.int64)
    start = np.arange(width) - band + shift
    best = (0, 0, 0, 0)
    for i, w in enumerate(template):
        at = np.arange(width) - band + shift + i
        ok = (at >= 0) & (at < len(text))
        same = np.zeros(width, bool)
        same[ok] = text[at[ok]] == w
        diag = score + np.where(same, 2, -1)
        skip = np.r_[score[1:] - 1, np.int64(-10 ** 6)]  # a template word without partner
        up = skip > diag
        new = np.where(up, skip, diag)
        hits = np.where(up, np.r_[matched[1:], 0], matched + same)
        begin = np.where(up, np.r_[start[1:], 0], start)
        fresh = same & (hits == 1)
        begin = np.where(fresh, at, begin)
        for j in range(1, width):  # a text word without partner
            if new[j - 1] - 1 > new[j]:
                new[j], hits[j], begin[j] = new[j - 1] - 1, hits[j - 1], begin[j - 1]
        score, matched, start = new, hits, begin
        j = int(np.where(same, score, -10 ** 6).argmax())
        if same[j] and (matched[j], score[j]) > best[:2]:
            best = (int(matched[j]), int(score[j]), int(start[j]), int(at[j]) + 1)
    return best[0], best[2], best[3]


def scan_text(raw: bytes, index: Index, least: float = LEAST) -> list[tuple[str, float, int, int, int]]:
    """(template, coverage, matched words, start, end) in code points of the text; the best of overlapping places."""
    blanked = raw.translate(ALNUM)
    get = index.number.get
    ids = np.fromiter((get(w, 0) for w in blanked.split()), np.uint64)
    if not ids.any():
        return []
    found = []
    for t, chain in index.candidates(ids):
        words = index.words[t]
        n, places, met = len(words), [], None
        for d in chain:
            if d >= 0 and np.array_equal(ids[d:d + n], words):
                places.append((-n, d, d + n))
            elif met is None or d - met > BAND // 2:  # the band of a near diagonal covers this one
                met = d
                lo, hi = max(0, d - BAND), min(len(ids), d + n + 2 * BAND)
                m, s, e = align(words, ids[lo:hi], d - lo, BAND)
                if m >= least * n:
                    places.append((-m, s + lo, e + lo))
        used: list[tuple[int, int]] = []
        for m, s, e in sorted(places):
            if all(e <= a or b <= s for a, b in used):
                used.append((s, e))
                found.append((index.names[t], -m / n, -m, s, e))
    if not found:
        return []
    inside = np.frombuffer(blanked, np.uint8) != 32
    edge = np.flatnonzero(np.diff(np.r_[False, inside, False].astype(np.int8)))
    chars = np.r_[0, np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)]
    return sorted((name, c, m, int(chars[edge[2 * s]]), int(chars[edge[2 * e - 1]])) for name, c, m, s, e in found)


MATCH = (T.StructType().add("template", "string").add("coverage", "double").add("matched", "long")
         .add("start", "long").add("end", "long"))


def scan_licenses(docs: DataFrame, templates: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = K,
                  window: int = WINDOW, least: float = LEAST, most_words: int = MOST_WORDS) -> DataFrame:
    """One row per match: the input columns without the text, ``template``, ``coverage``, ``matched``, ``start``, ``end``."""
    docs = docs.drop(*MATCH.names)
    kept = [f for f in docs.schema if f.name != text]
    sized = cut(templates.filter("template IS NOT NULL AND text IS NOT NULL").select("template", "text").distinct()
                .withColumn("words", F.regexp_count(lower_ascii(F.col("text")), F.lit(_WORD))))
    blocks = max(1, -(-(sized.agg(F.sum("words")).first()[0] or 0) // most_words))
    spark = docs.sparkSession
    out = None
    for i in range(blocks):
        part = sized.filter(F.pmod(F.xxhash64("template", "text"), F.lit(blocks)) == i).orderBy("template", "text")
        shared = spark.sparkContext.broadcast([(r.template, r.text) for r in part.collect()])

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = Index(shared.value, k, window)
            for b in batches:
                row, found = [], []
                for j, raw in enumerate(each_text(b.column(text))):
                    for m in scan_text(raw, index, least):
                        row.append(j)
                        found.append(m)
                columns = list(zip(*found, strict=True)) or [[]] * 5
                kinds = (pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64())
                at = pa.array(row, pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(f.name).take(at) for f in kept]
                                                 + [pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)],
                                                 names=[f.name for f in kept] + MATCH.names)

        own = docs.mapInArrow(run, T.StructType(kept + MATCH.fields))
        out = own if out is None else out.unionByName(own)
    return out


def op3_license_scan(docs: DataFrame) -> DataFrame:
    """Every match of a built-in notice in every document."""
    return scan_licenses(docs.select("doc_id", "text"), notices(docs.sparkSession)).select(
        "doc_id", "template", F.round("coverage", 6).alias("coverage"), "matched", "start", "end")
