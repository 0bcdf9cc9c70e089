"""Language-model scores: prediction by partial matching over bytes, beside a word unigram base.

The model is a trie of byte contexts up to ``order`` bytes. A byte that follows
the longest known context is coded there; otherwise the model escapes to the
next shorter one. Escapes are estimated by method C (as many escape counts as
distinct symbols), and symbols already refused in a longer context are excluded
from the shorter one. Below order 0 the remaining byte values are equal.

Counts cover every training document and all of them are used. The probability
of a byte depends on it and the ``order`` bytes before it alone, so the model is
a distributed table with the log10 of every such run that occurs in any
document. Runs with at least 1/NODES of all bytes (so at most NODES of them) are
broadcast, all others are joined by a shuffle in which no key is frequent. Word
counts are treated likewise: words with at least 1/FREQUENT of all words (so at
most FREQUENT of them) are broadcast.

A text starts after ``order`` line ends; the score is the sum of log10
probabilities of its bytes. NULL counts as empty text with score 0 and one
token, its end. A NULL doc_id counts as empty text in the fold. Without
training documents every byte has probability 1/256. Repeated rows are all
returned; input columns named like a result column are replaced.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from math import log10

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from barloom.llm.common import annotate, fold
from barloom.llm.kernels import LOWER, each_text, slices, utf8, word_runs
from barloom.session import cut

ORDER = 4
NODES = 1 << 22
FREQUENT = 1 << 20
END = ""  # the end of a text as a token; words are never empty
PAD = 10
BLOCK = 1 << 20


def training(doc_id: str = "doc_id") -> Column:
    return ~fold(doc_id, 5, 1)


# --- word base ---------------------------------------------------------------

def token_counts(docs: DataFrame, text: str, train: Column, most: int = 200_000) -> DataFrame:
    """(token, n, c): occurrences in all and in training documents, over the whole corpus."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = {True: Counter(), False: Counter()}

        def rows() -> Iterator[pa.RecordBatch]:
            for own, c in seen.items():
                if c:
                    n = pa.array(c.values(), pa.int64())
                    keys = pa.array(list(c), pa.binary()).cast(pa.string())
                    yield pa.RecordBatch.from_arrays([keys, n, n if own else pa.array(np.zeros(len(c), np.int64))], names=["token", "n", "c"])
                    c.clear()
        for b in batches:
            for own, t in zip(b.column("own").to_pylist(), each_text(b.column("text")), strict=True):
                c = seen[own]
                for words in word_runs(t.translate(LOWER)):
                    c.update(words)
                c[b""] += 1
                if len(c) > most:
                    yield from rows()
        yield from rows()

    parts = docs.select(F.col(text).alias("text"), train.alias("own")).mapInArrow(run, "token string, n bigint, c bigint")
    return cut(parts.groupBy("token").agg(F.sum("n").alias("n"), F.sum("c").alias("c")))


# --- byte contexts -----------------------------------------------------------

def _grams(col: pa.Array, order: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(keys, starts, ends) by blocks of rows: key i is the byte at i with ``order`` bytes before it; rows are starts:ends."""
    data, off = utf8(col)
    for i, j in slices(off, BLOCK):
        lens = np.diff(off[i:j + 1])
        starts = np.cumsum(lens + order) - lens
        buf = np.full(int(lens.sum()) + order * len(lens), PAD, np.uint8)
        inside = np.ones(len(buf), bool)
        for k in range(1, order + 1):
            inside[starts - k] = False
        buf[inside] = data[off[i]:off[j]]
        x = buf.astype(np.uint64)
        key = x.copy()
        for k in range(1, order + 1):
            key[k:] |= x[:-k] << np.uint64(8 * k)
        yield key, starts, starts + lens


def gram_counts(docs: DataFrame, text: str, train: Column, order: int, most: int = 600_000) -> DataFrame:
    """(gram, n, c): occurrences of every run of order + 1 bytes in all and in training texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def merged() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            keys, n, c = (np.concatenate(x) for x in zip(*held, strict=True))
            at = np.argsort(keys)
            keys = keys[at]
            first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            return keys[first], np.add.reduceat(n[at], first), np.add.reduceat(c[at], first)

        def rows() -> pa.RecordBatch:
            keys, n, c = merged()
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n), pa.array(c)], names=["gram", "n", "c"])
        for b in batches:
            at, learned = 0, np.array(b.column("own").to_pylist(), bool)
            for key, starts, ends in _grams(b.column("text"), order):
                owner = np.repeat(np.arange(at, at + len(starts)), ends - starts + order)
                at += len(starts)
                real = np.ones(len(key), bool)
                for k in range(1, order + 1):
                    real[starts - k] = False
                for own in (True, False):
                    keys, n = np.unique(key[real & (learned[owner] == own)], return_counts=True)
                    if not len(keys):
                        continue
                    n = n.astype(np.int64)
                    held.append((keys, n, n if own else n * 0))
                    size += len(keys)
                if size > most:
                    held[:] = [merged()]
                    size = len(held[0][0])
                    if size > most // 2:
                        yield rows()
                        held.clear()
                        size = 0
        if held:
            yield rows()

    parts = docs.select(F.col(text).alias("text"), train.alias("own")).mapInArrow(run, "gram bigint, n bigint, c bigint")
    return cut(parts.groupBy("gram").agg(F.sum("n").alias("n"), F.sum("c").alias("c")))


class Table:
    """Open-addressing map from uint64 keys to positions, probed for whole arrays."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, int(4 * len(keys)).bit_length())
        self.mask = (1 << self.bits) - 1
        self.keys = np.zeros(1 << self.bits, np.uint64)
        self.at = np.full(1 << self.bits, -1, np.int32)
        todo = np.arange(len(keys), dtype=np.int32)
        slot = self._slot(keys)
        while len(todo):
            free = np.flatnonzero(self.at[slot] < 0)
            won = free[np.unique(slot[free], return_index=True)[1]]
            self.at[slot[won]] = todo[won]
            self.keys[slot[won]] = keys[todo[won]]
            rest = np.ones(len(todo), bool)
            rest[won] = False
            todo, slot = todo[rest], (slot[rest] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Position of each key, -1 without."""
        slot = self._slot(keys)
        out = self.at[slot]
        open_ = np.flatnonzero((out >= 0) & (self.keys[slot] != keys))
        slot = slot[open_]
        while len(open_):
            slot = (slot + 1) & self.mask
            found = self.at[slot]
            out[open_] = found
            more = (found >= 0) & (self.keys[slot] != keys[open_])
            open_, slot = open_[more], slot[more]
        return out


def _per_text(keys: np.ndarray, owner: np.ndarray, texts: int) -> tuple[pa.Array, pa.Array, pa.Array]:
    """Distinct keys of each text, their numbers of occurrences and the offsets of the texts."""
    at = np.lexsort((keys, owner))
    keys, owner = keys[at], owner[at]
    first = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])]) if len(keys) else np.empty(0, np.int64)
    off = np.searchsorted(owner[first], np.arange(texts + 1))
    return (pa.array(keys[first].view(np.int64)), pa.array(np.diff(np.r_[first, len(keys)]).astype(np.int32)), pa.array(off, pa.int32()))


def adaptive_score(text: bytes, order: int = ORDER) -> float:
    """log10 probability of a text under a model that starts empty and learns byte by byte."""
    seen: dict[bytes, Counter] = {}
    score, padded = 0.0, bytes([PAD]) * order + text
    for i in range(order, len(padded)):
        symbol, excluded = padded[i], set()
        contexts = [padded[i - k:i] for k in range(order, -1, -1)]
        for context in contexts:
            found = {s: n for s, n in seen.get(context, {}).items() if s not in excluded}
            if not found:
                continue
            total = sum(found.values()) + len(found)
            if symbol in found:
                score += log10(found[symbol] / total)
                break
            score += log10(len(found) / total)
            excluded |= found.keys()
        else:
            score -= log10(256 - len(excluded))
        for context in contexts:
            seen.setdefault(context, Counter())[symbol] += 1
    return score


def _low(gram: Column, size: int) -> Column:
    """The last ``size`` bytes of a run."""
    return gram.bitwiseAND((1 << 8 * size) - 1)


def fit(counts: DataFrame, order: int = ORDER) -> DataFrame:
    """(gram, n, score) of every run of ``gram_counts``: log10 probability of its last byte after the others.

    Runs that are not in the training texts escape from order to order, each a join with
    the nodes and contexts of that order. Tables with keys of at most two bytes (65,536
    rows) are broadcast; of longer keys no more than 65,536 runs of order 4 share one.
    """
    nodes = {order: counts.filter("c > 0").select("gram", "c")}
    for i in range(order - 1, -1, -1):
        nodes[i] = cut(nodes[i + 1].groupBy(_low(F.col("gram"), i + 1).alias("gram")).agg(F.sum("c").alias("c")))
    contexts: dict[int, DataFrame] = {}
    for i in range(order + 1):
        rows = nodes[i].withColumn("context", F.shiftrightunsigned("gram", 8))
        size, distinct = F.sum("c").alias("size"), F.count("*").alias("distinct")
        if not i:
            own = rows.groupBy("context").agg(size, distinct).withColumn("left", F.lit(0)).withColumn("new", F.lit(0))
        else:  # what a context excludes from the next shorter one
            short = _small(nodes[i - 1].select(F.col("gram").alias("_short"), F.col("c").alias("_c")), i)
            rows = rows.join(short, _low(F.col("gram"), i) == F.col("_short"))
            each = rows.groupBy("context").agg(size, distinct, F.sum("_c").alias("_gone"))
            parent = _small(contexts[i - 1].select(F.col("context").alias("_short"), F.col("size").alias("_size"), F.col("distinct").alias("_distinct")), i - 1)
            own = (each.join(parent, _low(F.col("context"), i - 1) == F.col("_short"))
                   .select("context", "size", "distinct", (F.col("_size") - F.col("_gone")).alias("left"), (F.col("_distinct") - F.col("distinct")).alias("new")))
        contexts[i] = cut(own)
    total = F.col("size") + F.col("distinct")
    known = counts.filter("c > 0").withColumn("context", F.shiftrightunsigned("gram", 8)).join(contexts[order], "context")
    known = known.select("gram", "n", F.log10(F.col("c") / total).alias("score"))
    rest = counts.filter("c = 0").select("gram", "n", F.lit(0.0).alias("score"), F.lit(False).alias("done"),
                                         F.lit(None).cast("bigint").alias("_left"), F.lit(None).cast("bigint").alias("_new"))
    for i in range(order, -1, -1):
        own = _small(contexts[i].withColumnRenamed("context", "_context"), i)
        rest = rest.join(own, F.shiftrightunsigned(_low(F.col("gram"), i + 1), 8) == F.col("_context"), "left")
        if i < order:
            one = _small(nodes[i].select(F.col("gram").alias("_gram"), "c"), i + 1)
            rest = rest.join(one, _low(F.col("gram"), i + 1) == F.col("_gram"), "left")
        else:
            rest = rest.withColumn("c", F.lit(None).cast("bigint"))
        fresh = F.coalesce("_new", "distinct")  # distinct bytes and counts, without those a longer context excludes
        whole = fresh + F.coalesce("_left", "size")
        step = F.when(F.col("done"), 0.0).when(F.col("c").isNotNull(), F.log10(F.col("c") / whole)).when(fresh > 0, F.log10(fresh / whole)).otherwise(0.0)
        rest = rest.select("gram", "n", (F.col("score") + step).alias("score"), (F.col("done") | F.col("c").isNotNull()).alias("done"),
                           F.col("left").alias("_left"), F.col("new").alias("_new"))
    seen = nodes[0].count()
    last = F.when(F.col("done"), 0.0).otherwise(log10(max(256 - seen, 1)))
    return cut(known.unionByName(rest.select("gram", "n", (F.col("score") - last).alias("score"))))


def _small(df: DataFrame, size: int) -> DataFrame:
    """``df`` with one row per run of ``size`` bytes, broadcast if these are at most 65,536."""
    return F.broadcast(df) if size <= 2 else df


FIELDS = (T.StructType().add("n_tokens", "long").add("n_known", "long").add("train_tokens", "long")
          .add("base_score", "double").add("score", "double"))


def lm_scores(docs: DataFrame, train: Column, text: str = "text", order: int = ORDER, nodes: int = NODES,
              frequent: int = FREQUENT) -> DataFrame:
    """Every row without its text, with token counts, ``base_score`` and ``score``."""
    docs = docs.drop(*FIELDS.names)
    counts = token_counts(docs, text, train)
    n_all, n_train, v = counts.agg(F.sum("n"), F.sum("c"), F.sum((F.col("c") > 0).cast("bigint"))).first()
    n_all, n_train, v = n_all or 0, n_train or 0, v or 0
    rest = n_train + 0.5 * (v + 1)
    often = counts.filter(F.col("n") * frequent >= n_all).select("token", "c").toArrow()  # at most `frequent` rows
    spark = docs.sparkSession
    known = spark.sparkContext.broadcast({
        t.encode(): (log10((c + 0.5) / rest), c > 0) for t, c in zip(often["token"].to_pylist(), often["c"].to_pylist(), strict=True)})
    grams = fit(gram_counts(docs, text, train, order), order)
    bytes_all = grams.agg(F.sum("n")).first()[0] or 0
    common = grams.filter(F.col("n") * nodes >= bytes_all).select("gram", "score").toArrow()  # at most `nodes` rows
    model = spark.sparkContext.broadcast((common["gram"].to_numpy().view(np.uint64), common["score"].to_numpy()))
    fields = (T.StructType().add("n_tokens", "long").add("_known", "long").add("_base", "double").add("score", "double")
              .add("_rare", T.ArrayType(T.StringType())).add("_times", T.ArrayType(T.IntegerType()))
              .add("_grams", T.ArrayType(T.LongType())).add("_often", T.ArrayType(T.IntegerType())))
    tables: list[Table] = []  # of one task

    def kernel(b: pa.RecordBatch):
        table, (runs, values), col = known.value, model.value, b.column(text)
        if not tables:
            tables.append(Table(runs))
        rows, rare, times = [], [], []
        for t in each_text(col):
            c = Counter()
            for words in word_runs(t.translate(LOWER)):
                c.update(words)
            c[b""] += 1
            n, ok, base, few, often_ = 0, 0, 0.0, [], []
            for w, k in c.items():
                n += k
                value = table.get(w)
                if value is None:
                    few.append(w)
                    often_.append(k)
                else:
                    base += k * value[0]
                    ok += k * value[1]
            rows.append((n, ok, base))
            rare.append(few)
            times.append(often_)
        scores, missed, doc = [], [(np.empty(0, np.uint64), np.empty(0, np.int64))], 0
        for keys, starts, ends in _grams(col, order):
            at = tables[0].find(keys)
            sums = np.concatenate([[0.0], np.cumsum(np.where(at >= 0, values[at], 0.0) if len(values) else np.zeros(len(keys)))])
            scores.append(sums[ends] - sums[starts])
            miss = np.flatnonzero(at < 0)
            owner = np.searchsorted(starts, miss, "right") - 1
            real = (owner >= 0) & (miss < ends[owner])  # no padding
            missed.append((keys[miss[real]], owner[real] + doc))
            doc += len(starts)
        score = np.concatenate(scores) if scores else np.empty(0)
        unknown, each_, off = _per_text(*(np.concatenate(x) for x in zip(*missed, strict=True)), b.num_rows)
        n, ok, base = zip(*rows, strict=True) if rows else ([], [], [])
        return [pa.array(n, pa.int64()), pa.array(ok, pa.int64()), pa.array(base, pa.float64()), pa.array(score, pa.float64()),
                pa.array(rare, pa.list_(pa.binary())).cast(pa.list_(pa.string())), pa.array(times, pa.list_(pa.int32())),
                pa.ListArray.from_arrays(off, unknown), pa.ListArray.from_arrays(off, each_)], None

    scored = cut(annotate(docs, kernel, fields, (text,), text).withColumn("_at", F.monotonically_increasing_id()))
    each = scored.select("_at", F.explode(F.arrays_zip("_rare", "_times")).alias("r")).select(
        "_at", F.col("r._rare").alias("token"), F.col("r._times").alias("k"))
    value = F.log10((F.col("c") + 0.5) / F.lit(rest)) if rest else F.lit(0.0)
    words = (each.join(counts.filter(F.col("n") * frequent < n_all).select("token", "c"), "token")
             .groupBy("_at").agg(F.sum(F.col("k") * value).alias("_more"), F.sum(F.when(F.col("c") > 0, F.col("k")).otherwise(0)).alias("_ok")))
    runs = scored.select("_at", F.explode(F.arrays_zip("_grams", "_often")).alias("r")).select(
        "_at", F.col("r._grams").alias("gram"), F.col("r._often").alias("k"))
    bytes_ = (runs.join(grams.filter(F.col("n") * nodes < bytes_all).select("gram", F.col("score").alias("v")), "gram")
             .groupBy("_at").agg(F.sum(F.col("k") * F.col("v")).alias("_score")))
    sums = (words.unionByName(bytes_, allowMissingColumns=True).groupBy("_at")
            .agg(F.sum("_more").alias("_more"), F.sum("_ok").alias("_ok"), F.sum("_score").alias("_score")))
    zero = F.lit(0)
    return (scored.drop("_rare", "_times", "_grams", "_often").join(sums, "_at", "left")
            .withColumn("n_known", F.col("_known") + F.coalesce("_ok", zero)).withColumn("train_tokens", F.lit(n_train).cast("bigint"))
            .withColumn("base_score", F.col("_base") + F.coalesce("_more", F.lit(0.0)))
            .withColumn("score", F.col("score") + F.coalesce("_score", F.lit(0.0)))
            .drop("_at", "_known", "_base", "_more", "_ok", "_score"))


def op9_lm_score(docs: DataFrame) -> DataFrame:
    """Contract columns of every document."""
    out = lm_scores(docs.select("doc_id", "text", (~training()).alias("held_out")), ~F.col("held_out"))
    return out.select("doc_id", "held_out", *FIELDS.names)
