"""SimHash near-duplicates through deletion-variant signatures.

A 64-bit fingerprint is cut into k // 2 + 1 segments. Two fingerprints that
differ in at most k bits then have a segment in which they differ in at most
one, so both carry the same variant of that segment with one bit deleted.
Indexing one variant per bit position (64 rows a fingerprint) and joining on
equality finds every link; each meeting pair is verified on all 64 bits.

* Fingerprints are made distinct first, so copies cost nothing.
* A bucket is streamed in sorted order. Only spanning links leave it, never all
  its pairs. A bucket beyond ``block`` members is dealt to other tasks as pairs
  of blocks, so none is held whole and none is cut off.
* NULL or empty texts have no words and fingerprint zero, linked like any
  other. A NULL doc_id never becomes a component id unless all its members are
  NULL. Repeated rows are all returned. Input columns named like a result
  column are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from xxhash import xxh64_intdigest

from barloom.llm.common import KEY, annotate, attach, components, row_key
from barloom.llm.kernels import LOWER, each_text, word_runs
from barloom.session import cut

SEED = 42
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
_PLACE = np.arange(8) * 256


def fingerprint(text: bytes, shingle: int = 4) -> int:
    """SimHash of the word shingles of a text as a signed 64-bit integer."""
    counts, total, first = np.zeros((8, 8), np.int64), 0, []
    for words in word_runs(text.translate(LOWER), shingle - 1):
        if len(words) < shingle:
            first = words  # so far fewer words than a shingle has
            continue
        norm = b" ".join(words)
        gaps = np.flatnonzero(np.frombuffer(norm, np.uint8) == 32)
        n = len(words) - shingle + 1
        starts = [0, *(gaps[:n - 1] + 1).tolist()]
        ends = [*gaps[shingle - 1:].tolist(), len(norm)]
        hashes = np.fromiter((xxh64_intdigest(norm[i:j], SEED) for i, j in zip(starts, ends, strict=True)), np.uint64, n)
        seen = np.bincount((hashes.view(np.uint8).reshape(-1, 8) + _PLACE).ravel(), minlength=2048)
        counts += seen.reshape(8, 256) @ _BITS
        total += n
    if not total:
        return int(np.uint64(xxh64_intdigest(b" ".join(first), SEED)).view(np.int64)) if first else 0
    majority = (counts.ravel() * 2 > total).astype(np.uint8)
    return int(np.packbits(majority, bitorder="little").view(np.int64)[0])


def with_fingerprint(docs: DataFrame, text: str = "text", shingle: int = 4, keep_text: bool = False) -> DataFrame:
    """Documents with their ``fp``."""
    def kernel(b: pa.RecordBatch):
        fps = [fingerprint(t, shingle) for t in each_text(b.column(text))]
        return [pa.array(fps, pa.int64())], None
    return annotate(docs, kernel, T.StructType([T.StructField("fp", T.LongType())]), () if keep_text else (text,), text)


def segments(k: int) -> list[tuple[int, int]]:
    """(low bit, width) of each of the k // 2 + 1 segments."""
    cuts = np.linspace(0, 64, k // 2 + 2).round().astype(int)
    return [(int(a), int(b - a)) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def variants(fps: DataFrame, k: int) -> DataFrame:
    """(key, fp): one row for each deleted bit; the bit's number is in the key's low six bits."""
    table = [(lo, ((1 << w) - 1) & ~(1 << (j - lo)), j) for lo, w in segments(k) for j in range(lo, lo + w)]
    literal = F.array(*[F.struct(F.lit(lo).alias("lo"), F.lit(mask).cast("bigint").alias("mask"), F.lit(j).alias("j"))
                        for lo, mask, j in table])
    return (fps.select("fp", F.explode(literal).alias("v"))
            .selectExpr("(shiftrightunsigned(fp, v.lo) & v.mask) * 64 + v.j AS key", "fp"))


def forest(f: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links of the graph that joins fingerprints at most ``k`` bits apart."""
    a, b, todo = [], [], f
    while len(todo) > 1:
        stack, todo = [todo[0]], todo[1:]
        while stack and len(todo):
            p = stack.pop()
            near = np.bitwise_count(todo ^ p) <= k
            if near.any():
                hit, todo = todo[near], todo[~near]
                a.append(np.full(len(hit), p))
                b.append(hit)
                stack.extend(hit)
    return (np.concatenate(a), np.concatenate(b)) if a else (f[:0], f[:0])


def _runs_links(key: np.ndarray, fp: np.ndarray, k: int, short: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """Links inside every run of equal keys; short runs all at once, long ones by ``forest``."""
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    sizes = np.diff(np.r_[starts, len(key)])
    a, b = [], []
    for s, n in zip(starts[sizes > short], sizes[sizes > short], strict=True):
        x, y = forest(fp[s:s + n], k)
        a.append(x)
        b.append(y)
    few = np.repeat(sizes, sizes)
    few = (few > 1) & (few <= short)
    key, fp = key[few], fp[few]
    for lag in range(1, short):
        same = key[lag:] == key[:-lag]
        if not same.any():
            break
        x, y, tag = fp[lag:][same], fp[:-lag][same], key[lag:][same] & 63
        diff = x ^ y
        ok = np.bitwise_count(diff) <= k
        x, y, diff, tag = x[ok], y[ok], diff[ok], tag[ok]
        own, open_ = np.zeros(len(x), np.int64), np.ones(len(x), bool)  # the first variant that a pair shares reports it
        for lo, w in segments(k):
            part = (diff >> np.uint64(lo)) & np.uint64((1 << w) - 1)
            c = np.bitwise_count(part)
            here = open_ & (c <= 1)
            own[here] = lo + np.where(c[here] == 0, 0, np.bitwise_count(part[here] - np.uint64(1)) * (c[here] > 0))
            open_ &= ~here
        a.append(x[own == tag])
        b.append(y[own == tag])
    return (np.concatenate(a), np.concatenate(b)) if a else (fp[:0], fp[:0])


_FOUND = "kind int, a bigint, b bigint, part int"
LINK, MEMBER, SIZE = 0, 1, 2


def _found(kind: int, a, b, part=0) -> pa.RecordBatch:
    a = np.asarray(a).view(np.int64)
    b = np.asarray(b).view(np.int64)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(a), kind, np.int32)), pa.array(a), pa.array(b), pa.array(np.full(len(a), part, np.int32))],
        names=["kind", "a", "b", "part"])


def stream_buckets(batches: Iterator[pa.RecordBatch], k: int, block: int) -> Iterator[pa.RecordBatch]:
    """Buckets in key order: links of the small ones, members and block counts of the large ones."""
    key, fp = np.empty(0, np.int64), np.empty(0, np.uint64)
    large, part = None, 0

    def done(n: int) -> Iterator[pa.RecordBatch]:
        """The first ``n`` rows are whole runs, or the end of the large one."""
        nonlocal key, fp, large, part
        if large is not None and n:
            m = int(np.searchsorted(key[:n], large, "right"))
            if m:
                yield _found(MEMBER, key[:m], fp[:m], part)
                part += 1
            yield _found(SIZE, np.array([large]), np.array([0]), part)
            key, fp, n, large = key[m:], fp[m:], n - m, None
        if n:
            yield _found(LINK, *_runs_links(key[:n], fp[:n], k))
            key, fp = key[n:], fp[n:]

    for batch in batches:
        key = np.concatenate([key, batch.column(0).to_numpy()])
        fp = np.concatenate([fp, batch.column(1).to_numpy().view(np.uint64)])
        if not len(key):
            continue
        yield from done(int(np.searchsorted(key, key[-1], "left")))
        while len(key) >= 2 * block:
            if large is None:
                large, part = int(key[0]), 0
            yield _found(MEMBER, key[:block], fp[:block], part)
            key, fp, part = key[block:], fp[block:], part + 1
    if large is not None and not len(key):
        yield _found(SIZE, np.array([large]), np.array([0]), part)
    yield from done(len(key))


def links(fps: DataFrame, k: int = 4, block: int = 4096) -> DataFrame:
    """(a, b) spanning links of all distinct fingerprints ``fp`` at most ``k`` bits apart."""
    found = cut(variants(fps, k).repartition("key").sortWithinPartitions("key")
                .mapInArrow(lambda it: stream_buckets(it, k, block), _FOUND))
    near = found.filter(F.col("kind") == LINK).select("a", "b")
    sizes = found.filter(F.col("kind") == SIZE).select("a", F.col("part").alias("parts"))
    if sizes.isEmpty():
        return near

    def across(t: pa.Table) -> pa.Table:
        a, b = forest(np.unique(t.column("b").to_numpy().view(np.uint64)), k)
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    members = found.filter(F.col("kind") == MEMBER).select("a", "b", "part").join(sizes, "a").withColumn("q", other)
    pairs = members.filter("part <> q").select("a", "b", F.least("part", "q").alias("p"), F.greatest("part", "q").alias("q"))
    return near.unionByName(pairs.groupBy("a", "p", "q").applyInArrow(across, "a bigint, b bigint"))


def near_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 4, shingle: int = 4,
                    block: int = 4096) -> DataFrame:
    """Every row (without its text) with ``fp`` and ``component_id``, the smallest doc_id that it reaches.

    ``_nil, _id, _hash`` tell rows apart for a later join with the texts, and
    ``keeper`` marks the rows of the component's smallest (doc_id, text hash).
    """
    docs = docs.drop("fp", "component_id", "keeper", *KEY)
    rows = cut(with_fingerprint(docs.select("*", *row_key(F.col(doc_id), F.col(text))), text, shingle))
    row = F.struct(*KEY)
    each = cut(rows.groupBy("fp").agg(F.count("*").alias("n"), F.min(doc_id).alias("component_id"), F.min(row).alias("least")))
    roots = cut(components(links(each.select("fp"), k)).withColumnRenamed("node", "fp"))
    linked = cut(each.join(roots, "fp"))
    whole = linked.groupBy("root").agg(F.min("component_id").alias("component_id"), F.min("least").alias("least"),
                                       F.count("*").alias("m"))
    linked = attach(linked.drop("component_id", "least"), whole, "root", "m").select("fp", "n", "component_id", "least")
    classes = cut(each.join(roots, "fp", "left_anti").select("fp", "n", "component_id", "least").unionByName(linked))
    return (attach(rows, classes, "fp").withColumn("keeper", row.eqNullSafe(F.col("least")))
            .drop("n", "least"))


def near_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 4, shingle: int = 4) -> DataFrame:
    """One document of each component, with all its columns: the smallest doc_id, of equal ids the smaller text hash."""
    names = docs.columns
    marked = near_components(docs.select(doc_id, text), doc_id, text, k, shingle)
    keep = marked.filter("keeper").select(*KEY).distinct()
    keyed = docs.select("*", *row_key(F.col(doc_id), F.col(text)))
    return keyed.join(keep, KEY, "left_semi").dropDuplicates(KEY).select(*names)


def op8_simhash(docs: DataFrame) -> DataFrame:
    """Contract columns of every document."""
    out = near_components(docs.select("doc_id", "text"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
