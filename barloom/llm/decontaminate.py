"""Benchmark decontamination with one Aho-Corasick automaton over all benchmark windows.

Texts and items are normalised to words (A-Z lower-cased; ASCII letters, digits
and all non-ASCII characters are word characters). A window is ``width``
consecutive item words, or a whole shorter item. The automaton's alphabet is
the benchmark's vocabulary, so a document is translated to word numbers and
scanned once, whatever the number of windows; matches are mapped back to code
point offsets of the original text.

The automaton is broadcast, and its size is checked first: beyond
``most_windows`` (window, item) rows the rows are dealt by hash into blocks of
at most about that many, each block scans the documents in a job of its own,
and the hits are merged per document. Results are the same either way.

NULL and empty texts have no words and are clean. Items without words have no
window; items sharing an id count as one; a NULL item id is listed as empty
text. Very long texts are scanned in runs of words that overlap by a window.
Repeated rows are all returned; input columns named like a result column are
replaced.
"""

from __future__ import annotations

import uuid
from itertools import repeat

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, functions as F, types as T

from barloom.llm.common import KEY, annotate, lower_ascii, own_columns, row_key
from barloom.llm.kernels import ALNUM, each_text, word_runs
from barloom.session import cut

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WIDTH = 13
MOST_WINDOWS = 100_000

_RANGES = T.ArrayType(T.ArrayType(T.LongType()))
FIELDS = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()),
    T.StructField("items", T.ArrayType(T.StringType())), T.StructField("runs", _RANGES), T.StructField("spans", _RANGES)])


def item_windows(benchmark: DataFrame, item_id: str = "item_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """Distinct (item, window), a window being its words joined by blanks."""
    words = F.regexp_extract_all(lower_ascii(F.col(text)), F.lit(f"({WORD})"), F.lit(1))
    n = F.size("w")
    starts = F.sequence(F.lit(1), F.greatest(n - width + 1, F.lit(1)))
    cuts = F.when(n > 0, F.transform(starts, lambda i: F.array_join(F.slice("w", i, width), " ")))
    return (benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), words.alias("w"))
            .select("item", F.explode(cuts).alias("window")).distinct())


class Matcher:
    """Aho-Corasick automaton over word numbers; 0 stands for words that no window has."""

    def __init__(self, rows: list[tuple[str, str]]):
        self.number: dict[bytes, int] = {}
        self.items: list[list[str]] = []
        places: dict[tuple[int, ...], int] = {}
        for item, window in rows:
            ids = tuple(self.number.setdefault(w, len(self.number) + 1) for w in window.encode().split(b" "))
            if ids not in places:
                places[ids] = len(self.items)
                self.items.append([])
            self.items[places[ids]].append(item)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for ids, place in places.items():
            self.automaton.add_word(ids, (len(ids), place))
        self.longest = max(map(len, places), default=1)
        if places:
            self.automaton.make_automaton()

    def scan(self, text: bytes) -> tuple[int, list[list[int]], set[str]]:
        """Number of words, word ranges hit (end exclusive, merged), items found."""
        n, hits, items = 0, [], set()
        overlap = self.longest - 1
        get = self.number.get
        for words in word_runs(text.translate(ALNUM), overlap):
            base = n - min(n, overlap)
            n = base + len(words)
            if not self.items:
                continue
            for end, (size, place) in self.automaton.iter(tuple(map(get, words, repeat(0)))):
                stop = base + end + 1
                if hits and stop - size <= hits[-1][1]:  # ends come in order
                    hits[-1][1] = max(hits[-1][1], stop)
                    hits[-1][0] = min(hits[-1][0], stop - size)
                else:
                    hits.append([stop - size, stop])
                items.update(self.items[place])
        return n, merge(hits), items


def merge(ranges: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def to_offsets(text: bytes, ranges: list[list[int]]) -> list[list[int]]:
    """Word ranges as code point ranges of the original text, end exclusive."""
    if not ranges:
        return []
    raw = np.frombuffer(text, np.uint8)
    inside = np.frombuffer(text.translate(ALNUM), np.uint8) != 32
    edge = np.flatnonzero(np.diff(np.r_[False, inside, False].astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    chars = np.r_[0, np.cumsum((raw & 0xC0) != 0x80)]
    return [[int(chars[starts[a]]), int(chars[ends[b - 1]])] for a, b in ranges]


_matchers: dict[str, Matcher] = {}


def _matcher(name: str, rows: Broadcast) -> Matcher:
    """One automaton a worker process, built at first use."""
    if name not in _matchers:
        _matchers.clear()
        _matchers[name] = Matcher(rows.value)
    return _matchers[name]


def _scan(docs: DataFrame, windows: DataFrame, text: str, drop: tuple[str, ...] = ()) -> DataFrame:
    """``windows`` has a checked size."""
    rows = docs.sparkSession.sparkContext.broadcast([tuple(r) for r in windows.select("item", "window").collect()])
    name = uuid.uuid4().hex

    def kernel(b: pa.RecordBatch):
        found = []
        m = _matcher(name, rows)
        for t in each_text(b.column(text)):
            n, ranges, items = m.scan(t)
            found.append((n, sum(y - x for x, y in ranges), sorted(items), ranges, to_offsets(t, ranges)))
        columns = zip(*found, strict=True) if found else [[]] * 5
        pairs = pa.list_(pa.list_(pa.int64()))
        kinds = [pa.int64(), pa.int64(), pa.list_(pa.string()), pairs, pairs]
        return [pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], None
    return annotate(docs, kernel, FIELDS, drop, text)


def find_overlap(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH,
                 most_windows: int = MOST_WINDOWS, keep_text: bool = True) -> DataFrame:
    """Every row with ``n_words``, ``n_hit``, ``items``, word ``runs`` and code point ``spans`` that windows hit."""
    windows = cut(item_windows(benchmark, text=text, width=width))
    blocks = -(-windows.count() // most_windows)
    drop = () if keep_text else (text,)
    if blocks <= 1:
        return _scan(docs, windows, text, drop)
    docs = docs.drop(*FIELDS.names)
    hits = None
    keyed = docs.select(doc_id, text, *row_key(F.col(doc_id), F.col(text)))
    for i in range(blocks):
        part = windows.filter(F.pmod(F.xxhash64("item", "window"), F.lit(blocks)) == i)
        own = cut(_scan(keyed.select(text, *KEY), part, text, (text,)).filter("n_hit > 0"))
        hits = own if hits is None else hits.unionByName(own)
    def flat(c: str) -> Column:
        return F.array_distinct(F.flatten(F.collect_set(c)))  # of one document: bounded by its words
    merged = hits.groupBy(*KEY).agg(flat("items").alias("_items"), flat("runs").alias("_runs"))

    def kernel(b: pa.RecordBatch):
        out = []
        for t, items, runs in zip(each_text(b.column(text)), b.column("_items").to_pylist(), b.column("_runs").to_pylist(), strict=True):
            n = sum(len(w) for w in word_runs(t.translate(ALNUM)))
            ranges = merge(runs or [])
            out.append((n, sum(y - x for x, y in ranges), sorted(items or []), ranges, to_offsets(t, ranges)))
        columns = zip(*out, strict=True) if out else [[]] * 5
        pairs = pa.list_(pa.list_(pa.int64()))
        return [pa.array(list(c), k) for c, k in zip(columns, [pa.int64(), pa.int64(), pa.list_(pa.string()), pairs, pairs], strict=True)], None
    rows = docs.select("*", *row_key(F.col(doc_id), F.col(text))).join(merged, KEY, "left").drop(*KEY)
    return annotate(rows, kernel, FIELDS, drop, text).drop("_items", "_runs")


def contaminated() -> Column:
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def clean_documents(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents that are not contaminated, with their own columns, whatever their names.

    NULL and empty texts stay; rows that repeat are judged alike.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), own_columns(docs))
    return find_overlap(rows, benchmark.withColumnRenamed(text, "text")).filter(~contaminated()).select("_own.*")


def op5_decontamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Contract columns of every document."""
    out = find_overlap(docs.select("doc_id", "text"), benchmark, keep_text=False)
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
                      F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), contaminated().alias("contaminated"))


ORACLE = r"""
WITH item_words AS (
  SELECT COALESCE(CAST(item_id AS VARCHAR), '') AS item,
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
windows AS (
  SELECT DISTINCT item, array_to_string(w[i:i + 12], ' ') AS win, least(len(w), 13) AS n
  FROM item_words, unnest(range(1, greatest(len(w) - 12, 1) + 1)) t(i) WHERE len(w) > 0),
doc_words AS (
  SELECT doc_id, row_number() OVER () AS r,
    COALESCE(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM documents),
grams AS (
  SELECT r, p, n, array_to_string(w[p:p + n - 1], ' ') AS win
  FROM doc_words, (SELECT DISTINCT n FROM windows) s, unnest(range(1, len(w) - n + 2)) t(p) WHERE len(w) >= n),
hits AS (SELECT g.r, g.p, g.n, x.item FROM grams g JOIN windows x ON g.n = x.n AND g.win = x.win),
words_hit AS (SELECT r, count(DISTINCT p + k) AS n_hit FROM hits, unnest(range(0, n)) t(k) GROUP BY r),
items AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS list FROM hits GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, COALESCE(n_hit, 0) AS n_hit, COALESCE(n_items, 0) AS n_items,
  sha256(COALESCE(list, '')) AS items_sha256, COALESCE(n_hit, 0) > 0 AND 20 * COALESCE(n_hit, 0) >= len(w) AS contaminated
FROM doc_words LEFT JOIN words_hit USING (r) LEFT JOIN items USING (r)
"""
