"""Secret scan: fixed patterns, and probabilistic automata learned from what they find.

Credentials found by the patterns are the labelled strings of three formats. For
each format a prefix tree of their characters (taken as classes: digits, hex
letters, other letters by case, each symbol) is generalised by merging states
whose outgoing and ending frequencies agree within a Hoeffding bound and whose
successors agree as well. The result is a deterministic automaton with
transition and ending probabilities; ordinary words train one more automaton
as the background. Every other token of a text is scored: its log likelihood
under the best format and the gap to the background, both per character. Tokens
at least as likely as nearly all labelled strings of the format, and clearly
likelier than ordinary words, are reported with kind ``learned``.

The automata are fitted on a bounded sample (``samples`` distinct strings a
format, by hash); the scan covers every whole text. Without labelled strings of
a format it has no automaton. NULL counts as empty text. Repeated rows are all
returned; input columns named like a result column are replaced.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from math import log, sqrt
from zlib import crc32

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from barloom.llm.common import annotate
from barloom.llm.kernels import each_text
from barloom.session import cut

# fixed values: the patterns of the contract
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # a longest run of 24 or more
KINDS = ("assign", "access", "hex")
LEARNED, WORD = "learned", "word"

_CUES = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_HEX_MAP = bytes(48 if c in b"0123456789abcdef" else 32 for c in range(256))
_NOT_DIGITS = bytes(c for c in range(256) if c not in b"0123456789")
_TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{12,}")


def base_spans(raw: bytes) -> list[tuple[int, int, int]]:
    """(start, end, kind number) of the patterns in a UTF-8 text, by start, then kind; offsets in code points."""
    low = raw.translate(_LOWER)
    cue = any(c in low for c in _CUES)
    access = b"AKIA" in raw
    run = b"0" * 24 in raw.translate(_HEX_MAP)
    if not (cue or access or run):
        return []
    text, found = raw.decode(), []
    if cue:
        found += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    if access:
        found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    if run:
        found += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[0], x[2]))


def classes(token: str) -> str:
    """d digit, h hex letter, l other lower, H hex capital, U other capital; symbols stand for themselves."""
    return token.translate(_CLASS)


_CLASS = {c: ("d" if chr(c).isdigit() else ("h" if chr(c) in "abcdef" else "l") if chr(c).islower()
              else ("H" if chr(c) in "ABCDEF" else "U")) for c in range(128) if chr(c).isalnum()}
_PER_CLASS = {"d": 10, "h": 6, "l": 20, "H": 6, "U": 20}


class Tree:
    """Prefix tree whose states are merged by the ALERGIA compatibility test."""

    def __init__(self, strings: list[str], alpha: float = 0.05):
        self.through, self.ending, self.next, self.alpha = [0], [0], [{}], alpha
        for s in strings:
            at = 0
            self.through[0] += 1
            for c in s:
                if c not in self.next[at]:
                    self.next[at][c] = len(self.through)
                    self.through.append(0)
                    self.ending.append(0)
                    self.next.append({})
                at = self.next[at][c]
                self.through[at] += 1
            self.ending[at] += 1
        self.arc = [{c: self.through[t] for c, t in n.items()} for n in self.next]

    def differ(self, a: int, n: int, b: int, m: int) -> bool:
        return bool(n and m) and abs(a / n - b / m) > sqrt(0.5 * log(2 / self.alpha)) * (1 / sqrt(n) + 1 / sqrt(m))

    def compatible(self, p: int, q: int) -> bool:
        todo = [(p, q)]
        while todo:
            p, q = todo.pop()
            n, m = self.through[p], self.through[q]
            if self.differ(self.ending[p], n, self.ending[q], m):
                return False
            for c in self.arc[p].keys() | self.arc[q].keys():
                if self.differ(self.arc[p].get(c, 0), n, self.arc[q].get(c, 0), m):
                    return False
                if c in self.next[p] and c in self.next[q] and self.next[p][c] != self.next[q][c]:
                    todo.append((self.next[p][c], self.next[q][c]))
        return True

    def fold(self, p: int, q: int) -> None:
        """Add the tree below ``q`` to state ``p``."""
        todo = [(p, q)]
        while todo:
            p, q = todo.pop()
            self.through[p] += self.through[q]
            self.ending[p] += self.ending[q]
            for c, n in self.arc[q].items():
                self.arc[p][c] = self.arc[p].get(c, 0) + n
                if c in self.next[p]:
                    todo.append((self.next[p][c], self.next[q][c]))
                else:
                    self.next[p][c] = self.next[q][c]

    def merged(self) -> Automaton:
        red, blue = [0], {t: (0, c) for c, t in self.next[0].items()}
        while blue:
            q = min(blue)
            parent, c = blue.pop(q)
            for r in red:
                if self.compatible(r, q):
                    self.next[parent][c] = r
                    self.fold(r, q)
                    break
            else:
                red.append(q)
            final = set(red)
            blue = {t: (r, c) for r in red for c, t in self.next[r].items() if t not in final}
        number = {r: i for i, r in enumerate(red)}
        moves: dict[tuple[int, str], tuple[int, float]] = {}
        stop = []
        for r in red:
            n = self.through[r] + 1.0  # half a count each for an unseen end and an unseen arc
            stop.append(log((self.ending[r] + 0.5) / n))
            for c, t in self.next[r].items():
                moves[number[r], c] = (number[t], log(self.arc[r][c] / n) - log(_PER_CLASS.get(c, 1)))
        return Automaton(moves, stop)


@dataclass
class Automaton:
    moves: dict[tuple[int, str], tuple[int, float]]
    stop: list[float]

    def score(self, symbols: str, unseen: float = -12.0) -> float:
        """Log likelihood per character, the end included."""
        at, total = 0, 0.0
        for c in symbols:
            step = self.moves.get((at, c))
            if step is None:
                total += unseen
                at = 0
            else:
                at, p = step
                total += p
        return (total + self.stop[at]) / (len(symbols) + 1)


@dataclass
class Formats:
    automata: list[tuple[Automaton, float]]  # with the least score of a credential
    background: Automaton | None
    gap: float

    def is_secret(self, token: str) -> bool:
        symbols = classes(token)
        if "d" not in symbols or not self.automata or self.background is None:
            return False
        best = max(a.score(symbols) - least for a, least in self.automata)
        return best >= 0 and max(a.score(symbols) for a, _ in self.automata) - self.background.score(symbols) >= self.gap


def learn(credentials: dict[str, list[str]], words: list[str], gap: float = 0.5, quantile: float = 0.02,
          slack: float = 0.05) -> Formats:
    """Automata of all formats with at least 20 labelled strings, and of ordinary words.

    A format's least score is the ``quantile`` of its own strings' scores, less ``slack``.
    """
    automata = []
    for kind in sorted(credentials):
        strings = sorted({classes(s) for s in credentials[kind]})
        if len(credentials[kind]) < 20:
            continue
        a = Tree([classes(s) for s in credentials[kind]]).merged()
        scores = sorted(a.score(s) for s in strings)
        automata.append((a, scores[int(len(scores) * quantile)] - slack))
    background = Tree([classes(w) for w in words]).merged() if words else None
    return Formats(automata, background, gap)


def credential(kind: str, hit: str) -> str:
    return ASSIGN.match(hit).group(2) if kind == "assign" else hit


class Lowest:
    """The ``size`` values of lowest hash of each kind: an even sample of all distinct values seen, in bounded memory."""

    def __init__(self, size: int):
        self.size, self.held = size, defaultdict(set)

    def add(self, kind: str, value: str) -> None:
        held = self.held[kind]
        held.add((crc32(value.encode()), value))
        if len(held) > 8 * self.size:
            self.held[kind] = set(sorted(held)[:self.size])

    def rows(self) -> list[tuple[str, int, str]]:
        return [(kind, h, v) for kind, held in self.held.items() for h, v in sorted(held)[:self.size]]


def fit(docs: DataFrame, text: str = "text", samples: int = 1500, longest: int = 128) -> Formats:
    """Learn formats from the patterns' own findings and the background from all other long tokens.

    Every task keeps its ``samples`` lowest hashes of a kind, so the lowest
    of all of them are a sample of the whole corpus. Strings are cut to
    ``longest`` characters for training.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = Lowest(samples)
        for b in batches:
            for raw in each_text(b.column(0)):
                spans, t = base_spans(raw), raw.decode()
                for s, e, k in spans:
                    kept.add(KINDS[k], credential(KINDS[k], t[s:e])[:longest])
                for m in _TOKEN.finditer(t):
                    if not spans or not any(s < m.end() and m.start() < e for s, e, _ in spans):
                        kept.add(WORD, m.group()[:longest])
        columns = list(zip(*kept.rows(), strict=True)) or [[], [], []]
        kinds = (pa.string(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=["kind", "h", "value"])

    found = cut(docs.select(text).mapInArrow(run, "kind string, h bigint, value string").distinct())
    drawn = {k: [r.value for r in found.filter(F.col("kind") == k).orderBy("h", "value").limit(samples).collect()]
             for k in (*KINDS, WORD)}
    words = drawn.pop(WORD)
    return learn(drawn, words)


_SPANS = T.ArrayType(T.StructType().add("start", "long").add("end", "long").add("kind", "string"))
_ARROW = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))


def all_spans(raw: bytes, formats: Formats) -> list[tuple[int, int, str]]:
    """Pattern spans and learned spans that touch none of them, by start, then kind as listed."""
    base = base_spans(raw)
    found = [(s, e, k) for s, e, k in base]
    if raw.translate(None, _NOT_DIGITS):
        for m in _TOKEN.finditer(raw.decode()):
            if not any(s < m.end() and m.start() < e for s, e, _ in base) and formats.is_secret(m.group()):
                found.append((m.start(), m.end(), len(KINDS)))
    names = (*KINDS, LEARNED)
    return [(s, e, names[k]) for s, e, k in sorted(found, key=lambda x: (x[0], x[2]))]


def scan(docs: DataFrame, formats: Formats, text: str = "text", keep_text: bool = True) -> DataFrame:
    """Every row with ``secrets``: array of (start, end, kind), offsets in code points, end exclusive."""
    shared = docs.sparkSession.sparkContext.broadcast(formats)  # bounded by the sample

    def kernel(b: pa.RecordBatch):
        out = [[{"start": s, "end": e, "kind": k} for s, e, k in all_spans(raw, shared.value)] for raw in each_text(b.column(text))]
        return [pa.array(out, _ARROW)], None
    return annotate(docs, kernel, T.StructType().add("secrets", _SPANS), () if keep_text else (text,), text)


def op6_secret_scan(docs: DataFrame) -> DataFrame:
    """Contract columns of every document."""
    out = scan(docs.select("doc_id", "text"), fit(docs), keep_text=False)

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    base = F.filter("secrets", lambda x: x["kind"] != LEARNED)

    def count(kind: str) -> Column:
        return F.size(F.filter("secrets", lambda x: x["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return out.select("doc_id", *map(count, KINDS), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("secrets")).alias("spans"))
