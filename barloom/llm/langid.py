"""Language ID: a linear-chain conditional random field labels every word.

Features of a word: byte trigrams with word borders, three-letter affixes, and
its entry in a lexicon of words seen more than once in training. Weights of
features and label transitions are learned together; training rows splice
pieces of differently labelled documents, so transitions are learned from real
switches. A text's words are labelled by forward-backward over the whole text,
and the language with the largest share of posterior probability is its own,
with that share as score.

Fitted on a bounded sample (``docs_per_label`` documents of at most
``longest`` characters, ``chars_per_label`` characters and ``most_labels``
labels, the most frequent); the sampling hash sees all labelled documents.
Prediction reads whole texts. Memory per task is a few times the longest text.

NULL texts and texts without a letter get ``und`` and score 0; so does every
text if no labelled document exists. Repeated rows are all returned; input
columns named like a result column are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from barloom.llm.common import annotate, fold, own_columns
from barloom.llm.kernels import each_text

UNKNOWN = "und"
TRIGRAMS, AFFIXES = 1 << 16, 1 << 15
PAD = TRIGRAMS + 2 * AFFIXES  # a feature of weight zero
LEXICON = 20_000
CHUNK = 32

#: lower-case ASCII letters and non-ASCII bytes stay, everything else is a border
_TABLE = np.array([c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256)], np.uint8)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _hash(code: np.ndarray, slots: int) -> np.ndarray:
    return ((code.astype(np.uint64) * _ODD) >> np.uint64(64 - slots.bit_length() + 1)).astype(np.int64)


class Features:
    """Feature numbers of all words of some texts: per byte (trigrams), per word (affixes) and a hash of each word."""

    def __init__(self, texts: list[bytes]):
        buf = _TABLE[np.frombuffer(b"  " + b"  ".join(texts) + b"   ", np.uint8)]
        after = np.flatnonzero(buf[:-1] == 0xC3) + 1  # capital letters of Latin-1
        buf[after] += (32 * ((buf[after] >= 0x80) & (buf[after] <= 0x9E) & (buf[after] != 0x97))).astype(np.uint8)
        inside = buf != 32
        edge = np.flatnonzero(np.diff(inside.astype(np.int8))) + 1
        self.start, self.end = edge[::2], edge[1::2]
        x = buf.astype(np.uint32)
        tri = np.full(len(buf), PAD, np.int64)
        tri[1:-1] = np.where(inside[1:-1], _hash((x[:-2] << 16) | (x[1:-1] << 8) | x[2:], TRIGRAMS), PAD)
        self.trigrams = tri
        s, e = self.start, self.end
        long = e - s >= 3
        front = (x[s] << 16) | (x[s + 1] << 8) | x[s + 2]
        back = (x[e - 3] << 16) | (x[e - 2] << 8) | x[e - 1]
        self.prefix = np.where(long, TRIGRAMS + _hash(front, AFFIXES), PAD)
        self.suffix = np.where(long, TRIGRAMS + AFFIXES + _hash(back, AFFIXES), PAD)
        self.words = _word_hash(buf, s, e)
        at = np.cumsum([2] + [len(t) + 2 for t in texts])
        self.bounds = np.searchsorted(s, at)  # words of text i: bounds[i] to bounds[i + 1]


def _word_hash(buf: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """64-bit polynomial hash of each word, from prefix sums that wrap around."""
    base, inverse = 0x2545F4914F6CDD1D, pow(0x2545F4914F6CDD1D, -1, 1 << 64)
    n = len(buf)
    up, down = np.full(n, base, np.uint64), np.full(n, inverse, np.uint64)
    up[0] = down[0] = 1
    up, down = np.cumprod(up), np.cumprod(down)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up, dtype=np.uint64)])
    h = (sums[e] - sums[s]) * down[s]
    return (h ^ (h >> np.uint64(29))) * _ODD


@dataclass
class Model:
    labels: list[str]
    weights: np.ndarray  # (PAD + 1 + lexicon, labels)
    moves: np.ndarray  # log potentials, from row to column
    lexicon: np.ndarray  # sorted hashes

    def entries(self, words: np.ndarray) -> np.ndarray:
        """Feature number of each word's lexicon entry, PAD if it has none."""
        if not len(self.lexicon):
            return np.full(len(words), PAD)
        at = np.minimum(np.searchsorted(self.lexicon, words), len(self.lexicon) - 1)
        return np.where(self.lexicon[at] == words, PAD + 1 + at, PAD)

    def emissions(self, f: Features) -> np.ndarray:
        if not len(f.start):
            return np.empty((0, len(self.labels)), np.float32)
        w = self.weights
        out = np.add.reduceat(w[f.trigrams], f.start, axis=0)
        for idx in (f.prefix, f.suffix, self.entries(f.words)):
            out += w[idx]
        return out


def posteriors(emissions: np.ndarray, moves: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Label probabilities of all words by forward-backward over each text.

    Texts are cut into chunks of CHUNK words. All chunks of all texts advance
    together: first each one's transfer matrix, then the messages at its
    borders along each text, then the words inside.
    """
    n, k = emissions.shape
    if not n:
        return emissions
    x = np.exp(emissions - emissions.max(axis=1, keepdims=True)).astype(np.float32)
    a = np.exp(moves).astype(np.float32)
    sizes = np.diff(bounds)
    per_text = -(-sizes // CHUNK)
    text = np.repeat(np.arange(len(sizes)), per_text)
    number = np.arange(len(text)) - np.repeat(np.cumsum(per_text) - per_text, per_text)
    first = bounds[text] + number * CHUNK
    length = np.minimum(CHUNK, bounds[text + 1] - first)
    order = np.argsort(-length, kind="stable")  # chunks still running are a prefix
    running = np.searchsorted(-length[order], -np.arange(1, CHUNK + 1), "right")
    start = first[order]
    m = np.broadcast_to(np.eye(k, dtype=np.float32), (len(order), k, k)).copy()
    for t in range(CHUNK):
        r = running[t]
        if not r:
            break
        m[:r] = (m[:r].reshape(-1, k) @ a).reshape(r, k, k) * x[start[:r] + t][:, None, :]
        m[:r] /= m[:r].max(axis=(1, 2), keepdims=True)
    back = np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))
    alpha = np.full((len(order), k), 1.0 / k, np.float32)
    beta = np.full((len(order), k), 1.0 / k, np.float32)
    base = np.cumsum(per_text) - per_text
    for c in range(1, int(per_text.max(initial=0))):
        own = base[per_text > c] + c
        v = np.einsum("ni,nij->nj", alpha[own - 1], m[back[own - 1]])
        alpha[own] = v / v.sum(axis=1, keepdims=True)
    for c in range(int(per_text.max(initial=0)) - 1, 0, -1):
        own = base[per_text > c] + c
        v = np.einsum("nij,nj->ni", m[back[own]], beta[own])
        beta[own - 1] = v / v.sum(axis=1, keepdims=True)
    out = np.empty((n, k), np.float32)
    v = alpha[order]
    for t in range(CHUNK):
        r = running[t]
        if not r:
            break
        v = (v[:r] @ a) * x[start[:r] + t]
        v /= v.sum(axis=1, keepdims=True)
        out[start[:r] + t] = v
    v = beta[order]
    for t in range(CHUNK - 1, -1, -1):
        r = running[t]
        at = start[:r] + t
        out[at] *= v[:r]
        u = (v[:r] * x[at]) @ a.T
        v[:r] = u / u.sum(axis=1, keepdims=True)
    return out / out.sum(axis=1, keepdims=True)


def predict(model: Model, texts: list[bytes]) -> tuple[list[str | None], list[float]]:
    """Language and score of each text; None for a text without words."""
    f = Features(texts)
    p = posteriors(model.emissions(f), model.moves, f.bounds)
    sums = np.zeros((len(texts), p.shape[1]))
    sizes = np.diff(f.bounds)
    some = sizes > 0
    if some.any():
        sums[some] = np.add.reduceat(p, f.bounds[:-1][some], axis=0, dtype=np.float64)
    best = sums.argmax(axis=1)
    return ([model.labels[i] if ok else None for i, ok in zip(best, some, strict=True)],
            [float(sums[j, i] / n) if n else 0.0 for j, (i, n) in enumerate(zip(best, sizes, strict=True))])


def train(texts: list[bytes], labels: list[str], steps: int = 25, rate: float = 0.1, decay: float = 1e-4,
          row: int = 64, seed: int = 5) -> Model:
    """Fit by full gradient steps (Adam) on the log likelihood of the label sequences."""
    names = sorted(set(labels))
    k, f = len(names), Features(texts)
    lex, count = np.unique(f.words, return_counts=True)
    lex = np.sort(lex[np.argsort(-count, kind="stable")][:min(LEXICON, int((count > 1).sum()))])
    model = Model(names, np.zeros((PAD + 1 + len(lex), k), np.float32), np.zeros((k, k)), lex)
    gold = np.repeat(np.searchsorted(names, labels), np.diff(f.bounds))
    # rows of `row` words, spliced from pieces of 8 to 40 words in random order
    rng, pieces, at = np.random.default_rng(seed), [], 0
    while at < len(gold):
        n = int(rng.integers(8, 41))
        pieces.append(np.arange(at, min(at + n, len(gold))))
        at += n
    rng.shuffle(pieces)
    order = np.concatenate(pieces) if pieces else np.empty(0, np.int64)
    order = order[:len(order) // row * row].reshape(-1, row)
    if not order.size or k < 2:
        return model
    y = gold[order]
    seen = np.zeros((k, k))
    np.add.at(seen, (y[:, :-1].ravel(), y[:, 1:].ravel()), 1)
    lexical = model.entries(f.words)
    lengths = np.diff(np.r_[f.start, len(f.trigrams)])
    body = f.trigrams[f.start[0]:]
    g1, g2 = [np.zeros_like(model.weights, np.float64), np.zeros((k, k))], [np.zeros_like(model.weights, np.float64), np.zeros((k, k))]
    for step in range(1, steps + 1):
        e = model.emissions(f)[order]
        x = np.exp(e - e.max(axis=2, keepdims=True)).astype(np.float64)
        a = np.exp(model.moves)
        fwd, bwd = np.empty_like(x), np.ones_like(x)
        v = np.full((len(x), k), 1.0 / k)
        for t in range(row):
            v = (v @ a) * x[:, t]
            v /= v.sum(axis=1, keepdims=True)
            fwd[:, t] = v
        for t in range(row - 1, 0, -1):
            u = (bwd[:, t] * x[:, t]) @ a.T
            bwd[:, t - 1] = u / u.sum(axis=1, keepdims=True)
        p = fwd * bwd
        p /= p.sum(axis=2, keepdims=True)
        expected = np.zeros((k, k))
        for t in range(1, row):
            pair = fwd[:, t - 1, :, None] * a * (x[:, t] * bwd[:, t])[:, None, :]
            expected += (pair / pair.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        miss = -p.reshape(-1, k)
        miss[np.arange(len(miss)), y.ravel()] += 1
        word = np.zeros((len(gold), k))
        word[order.ravel()] = miss
        grad = np.empty_like(model.weights, np.float64)
        for j in range(k):
            grad[:, j] = (np.bincount(body, np.repeat(word[:, j], lengths), len(grad))
                          + np.bincount(f.prefix, word[:, j], len(grad)) + np.bincount(f.suffix, word[:, j], len(grad))
                          + np.bincount(lexical, word[:, j], len(grad)))
        grad[PAD] = 0
        for i, (g, value) in enumerate(((grad - decay * model.weights, model.weights), (seen - expected, model.moves))):
            g1[i] = 0.9 * g1[i] + 0.1 * g
            g2[i] = 0.99 * g2[i] + 0.01 * g * g
            value += rate * (g1[i] / (1 - 0.9 ** step)) / (np.sqrt(g2[i] / (1 - 0.99 ** step)) + 1e-6)
    return model


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", docs_per_label: int = 200,
        chars_per_label: int = 300_000, longest: int = 100_000, most_labels: int = 64) -> Model | None:
    """Train on a sample of labelled documents, drawn by a hash of the id; None without any."""
    usable = docs.filter(F.col(lang).isNotNull() & (F.length(text).between(1, longest)))
    counts = docs.filter(F.col(lang).isNotNull()).groupBy(lang).count().orderBy(F.desc("count"), lang).limit(most_labels).collect()
    if not counts:
        return None
    draw = F.pmod(F.xxhash64(F.col(doc_id).cast("string"), F.lit("sample")), F.lit(1 << 40)) / float(1 << 40)
    wanted = F.lit(False)
    for value, n in counts:
        wanted = wanted | ((F.col(lang) == value) & (draw < 1.5 * docs_per_label / n))
    rows = (usable.filter(wanted).select(F.col(lang).alias("lang"), F.col(text).alias("text"), draw.alias("draw"))
            .orderBy("draw", "text").limit(2 * docs_per_label * len(counts)).collect())
    texts, labels, used = [], [], dict.fromkeys((c[0] for c in counts), (0, 0))
    for r in rows:
        n, chars = used[r.lang]
        if n < docs_per_label and chars < chars_per_label:
            texts.append(r.text.encode())
            labels.append(r.lang)
            used[r.lang] = (n + 1, chars + len(r.text))
    return train(texts, labels) if texts else None


RESULT = T.StructType().add("lang_pred", "string").add("score", "double")


def identify(docs: DataFrame, model: Model | None, text: str = "text", keep_text: bool = True,
             block: int = 1 << 19) -> DataFrame:
    """Every row with ``lang_pred`` and ``score``."""
    letters = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    unknown = ~F.col("_letters") | F.col("lang_pred").isNull()
    if model is None:
        return docs.drop(*RESULT.names).withColumns({"lang_pred": F.lit(UNKNOWN), "score": F.lit(0.0)})
    shared = docs.sparkSession.sparkContext.broadcast(model)
    most = max(1 << 16, block * 4 // max(4, len(model.labels)))

    def kernel(b: pa.RecordBatch):
        names, scores, part, size = [], [], [], 0

        def flush() -> None:
            found = predict(shared.value, part)
            names.extend(found[0])
            scores.extend(found[1])
            part.clear()
        for t in each_text(b.column(text)):
            if part and size + len(t) > most:
                flush()
                size = 0
            part.append(t)
            size += len(t)
        if part:
            flush()
        return [pa.array(names, pa.string()), pa.array(scores, pa.float64())], None

    out = annotate(docs.withColumn("_letters", letters), kernel, RESULT, () if keep_text else (text,), text)
    return (out.withColumn("score", F.when(unknown, 0.0).otherwise(F.least(F.col("score"), F.lit(1.0))))
            .withColumn("lang_pred", F.when(unknown, UNKNOWN).otherwise(F.col("lang_pred"))).drop("_letters"))


def held_out(doc_id: str = "doc_id") -> Column:
    return fold(doc_id, 4, 2)


def accepted_documents(docs: DataFrame, least_score: float = 0.3) -> DataFrame:
    """Documents mostly in one learned language, with their own columns, whatever their names.

    NULL, empty and letterless texts go; rows that repeat are judged alike; a long text is judged whole.
    """
    model = fit(docs.filter(~held_out()))
    rows = docs.select("text", own_columns(docs))
    return identify(rows, model).filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least_score)).select("_own.*")


def op2_language_id(docs: DataFrame) -> DataFrame:
    """Contract columns of every document."""
    model = fit(docs.filter(~held_out()))
    return identify(docs.select("doc_id", "text", held_out().alias("held_out")), model, keep_text=False)
