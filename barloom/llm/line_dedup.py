"""Fuzzy line dedup by MinHash over character shingles.

Lines are compared lower-cased with white space collapsed. A line's signature
is the least value of BANDS * ROWS hash functions over its shingles of SHINGLE
characters (a shorter line is one shingle); lines that agree on a band of ROWS
values are candidates. At similarity 0.8 a pair meets in one of 12 bands of 6
with probability 0.97, at 0.9 with 0.9999. Exact copies of a line are one node,
so their number does not matter.

Buckets of the same members are one bucket. Its members' texts meet in one place, where
all pairs that are not yet linked through others are compared by exact Jaccard similarity
of the shingle sets (64-bit hashes); bitmaps leave out pairs that differ in more members
than a similarity of 0.8 allows, without a loss. Only the links of a spanning forest leave
a bucket, so what is shuffled and stored grows with the members and not with their pairs.
A bucket of many members or long texts is dealt as pairs of blocks. Components of the
links are found by distributed union-find; the first occurrence (doc_id, NULL last, then
text hash, then line number) of a component stays.

Lines without visible characters are never duplicates and always stay; NULL
and empty texts have no lines to drop. Rows alike in id and text are repeats of
one row and get the same marks. Input columns named like a result column are
replaced.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from xxhash import xxh64_intdigest

from barloom.llm.common import KEY, attach, components, row_key, sketch
from barloom.llm.kernels import each_text
from barloom.session import cut, discard

SHINGLE, BANDS, ROWS, LEAST = 5, 12, 6, 0.8
MOST_BROADCAST = 300_000
BLOCK, CHARS = 4096, 1 << 21  # members and characters of a block; a larger bucket is dealt as pairs of blocks
_RNG = np.random.default_rng(7)
_MULTIPLY = _RNG.integers(1, 1 << 31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_ADD = _RNG.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)
_PIECE = 1 << 16  # shingles hashed at a time, so that they stay in the cache


def normalised(line: str) -> str:
    return " ".join(line.lower().split())


def shingles(line: str, size: int = SHINGLE) -> set[str]:
    return {line[i:i + size] for i in range(max(1, len(line) - size + 1))}


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _pieces(lines: list[str]) -> Iterator[list[str]]:
    """Runs of lines of about as many characters as stay in the cache."""
    at, size = 0, 0
    for i, x in enumerate(lines, 1):
        size += len(x)
        if size >= _PIECE or i == len(lines):
            yield lines[at:i]
            at, size = i, 0


def _hashed(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The 32-bit hashes of all shingles and their number in each line; normalised lines, none empty."""
    lens = np.array([len(x) for x in lines])
    x = np.frombuffer(("".join(lines) + "\0" * SHINGLE).encode("utf-32-le"), np.uint32)
    h = np.zeros(len(x) - SHINGLE + 1, np.uint32)
    for i in range(SHINGLE):
        h = h * np.uint32(0x01000193) ^ x[i:len(h) + i] * np.uint32(0x9E3779B1)
    start = np.cumsum(lens) - lens
    for i in np.flatnonzero(lens < SHINGLE).tolist():
        h[start[i]] = xxh64_intdigest(lines[i].encode()) & 0xFFFFFFFF
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    h ^= h >> np.uint32(12)
    h *= np.uint32(0x297A2D39)
    h ^= h >> np.uint32(15)
    count = np.maximum(1, lens - SHINGLE + 1)
    inside = np.zeros(len(h) + 1, np.int64)
    np.add.at(inside, start, 1)
    np.add.at(inside, start + count, -1)
    return h[np.cumsum(inside)[:-1] > 0], count


def _minima(h: np.ndarray, count: np.ndarray) -> np.ndarray:
    """(lines, BANDS * ROWS) MinHash values."""
    first = np.cumsum(count) - count
    out = np.empty((len(count), BANDS * ROWS), np.uint32)
    i = 0
    while i < len(count):
        j = max(i + 1, int(np.searchsorted(first, first[i] + _PIECE)))
        part = h[first[i]:first[j] if j < len(first) else None]
        at, room = first[i:j] - first[i], np.empty(len(part), np.uint32)
        for k in range(BANDS * ROWS):
            np.multiply(part, _MULTIPLY[k], out=room)
            np.add(room, _ADD[k], out=room)
            out[i:j, k] = np.minimum.reduceat(room, at)
        i = j
    return out


def _keys(out: np.ndarray) -> np.ndarray:
    keys = np.zeros((len(out), BANDS), np.uint64) + np.arange(BANDS, dtype=np.uint64)
    for r in range(ROWS):
        keys = (keys ^ out[:, r::ROWS]) * np.uint64(0x9E3779B97F4A7C15)
        keys ^= keys >> np.uint64(29)
    return keys.view(np.int64)


def signatures(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(lines, BANDS) keys and the sketches, which estimate a similarity and are used by no operator."""
    out = _minima(*_hashed(lines))
    return _keys(out), sketch(out)


_LINES = "line_no int, node bigint, other bigint, line string, size int, bands array<bigint>"


def lists(values: np.ndarray) -> pa.ListArray:
    """One list per matrix row."""
    n, k = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * k, pa.int32()), pa.array(values.ravel(), pa.int64()))


def read_lines(docs: DataFrame, text: str = "text", remember: int = 300_000) -> DataFrame:
    """KEY and one row per visible line; text and bands only where a task meets a line for the first time."""
    schema = T.StructType([docs.schema[k] for k in KEY] + T._parse_datatype_string(_LINES).fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()

        def flush(b: pa.RecordBatch, rows: list[tuple], fresh: list[str]) -> pa.RecordBatch:
            row, no, node, other, place = zip(*rows, strict=True)
            parts = [_keys(_minima(*_hashed(part))) for part in _pieces(fresh)]
            keys = np.concatenate(parts) if parts else np.empty((0, BANDS), np.int64)
            sizes = pa.array(map(len, fresh), pa.int32())
            where = pa.array(place, pa.int64())
            return pa.RecordBatch.from_arrays(
                [b.column(k).take(pa.array(row)) for k in KEY]
                + [pa.array(no, pa.int32()), pa.array(node, pa.int64()), pa.array(other, pa.int64()),
                   pa.array(fresh, pa.string()).take(where), sizes.take(where), lists(keys).take(where)],
                names=schema.names)

        for b in batches:
            rows, fresh, chars = [], [], 0
            for i, raw in enumerate(each_text(b.column(text))):
                for no, line in enumerate(raw.decode().split("\n")):
                    line = normalised(line)
                    if not line:
                        continue
                    code = line.encode()
                    ids = _signed(xxh64_intdigest(code, 1)), _signed(xxh64_intdigest(code, 2))
                    place = None
                    if ids not in seen:
                        seen.add(ids)
                        place = len(fresh)
                        fresh.append(line)
                        chars += len(line)
                    rows.append((i, no, *ids, place))
                    if chars > 1 << 21:
                        yield flush(b, rows, fresh)
                        rows, fresh, chars = [], [], 0
                if len(seen) > remember:
                    seen.clear()
            if rows:
                yield flush(b, rows, fresh)

    return docs.select(*KEY, text).mapInArrow(run, schema)


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, node) of every member of a bucket of two or more; then a row of the bucket with its number of members ``n``
    and the sum ``mark`` and the least of their nodes. Buckets come one after the other; a task holds the numbers of one."""
    held = np.empty(0, np.int64), np.empty(0, np.int64)
    for b in chain(batches, [None]):
        k, node = held if b is None else (np.r_[x, b.column(i).to_numpy()] for i, x in enumerate(held))
        if not len(k):
            continue
        new = np.r_[True, k[1:] != k[:-1]]
        end = int(np.flatnonzero(new)[-1]) if b is not None else len(k)
        tail = np.unique(node[end:])  # the same line of several tasks is one member
        held = np.full(len(tail), k[-1]), tail
        k, node, new = k[:end], node[:end], new[:end]
        several = ~(new & np.r_[new[1:], True])
        k, node = k[several], node[several]
        if not len(k):
            continue
        by = np.lexsort((node, k))
        k, node = k[by], node[by]
        fresh = np.r_[True, (k[1:] != k[:-1]) | (node[1:] != node[:-1])]
        k, node = k[fresh], node[fresh]
        start = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
        n = np.diff(np.r_[start, len(k)])
        mark, whole = np.add.reduceat(node, start), n > 1
        inside, first, none = np.repeat(whole, n), start[whole], pa.nulls(int(n[whole].sum()), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(k[inside]), pa.array(node[inside]), none, none], names=["key", "node", "n", "mark"])
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (k[first], node[first], n[whole], mark[whole])], names=["key", "node", "n", "mark"])


def _distinct(h: np.ndarray) -> np.ndarray:
    h = np.sort(h)
    keep = np.ones(len(h), bool)
    np.not_equal(h[1:], h[:-1], out=keep[1:])
    return h[keep]


def _common(a: np.ndarray, b: np.ndarray) -> int:
    h = np.concatenate((a, b))
    h.sort()
    return int(np.count_nonzero(h[1:] == h[:-1]))


def shingle_sets(lines: list[str]) -> list[np.ndarray]:
    """The sorted 64-bit hashes of each line's shingles; normalised lines, none empty."""
    out = []
    for part in _pieces(lines):
        lens = np.array([len(x) for x in part])
        x = np.frombuffer(("".join(part) + "\0" * SHINGLE).encode("utf-32-le"), np.uint32).astype(np.uint64)
        h = np.zeros(len(x) - SHINGLE + 1, np.uint64)
        for i in range(SHINGLE):
            h = (h ^ x[i:len(h) + i]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        start = np.cumsum(lens) - lens
        for i in np.flatnonzero(lens < SHINGLE).tolist():
            h[start[i]] = xxh64_intdigest(part[i].encode())
        out += [_distinct(h[i:i + n]) for i, n in zip(start.tolist(), np.maximum(1, lens - SHINGLE + 1).tolist(), strict=True)]
    return out


def _bits(sets: list[np.ndarray], lens: np.ndarray) -> np.ndarray:
    """A bitmap of each set in a row of longs, of 512 to 16,384 bits, about four for each member of the largest."""
    power = min(14, max(9, int(4 * lens.max()).bit_length()))
    out = np.empty((len(sets), 1 << power - 6), np.uint64)
    for i, x in enumerate(sets):
        flags = np.zeros(1 << power, np.uint8)
        flags[(x >> np.uint64(64 - power)).astype(np.int64)] = 1
        out[i] = np.packbits(flags).view(np.uint64)
    return out


def forest(sets: list[np.ndarray], block: np.ndarray | None, least: float) -> list[tuple[int, int]]:
    """Links of a spanning forest of all pairs at ``least`` or more; with ``block``, of pairs from different blocks."""
    n = len(sets)
    if n == 2:
        size, both = len(sets[0]) + len(sets[1]), _common(*sets) if min(map(len, sets)) >= least * max(map(len, sets)) else 0
        return [(0, 1)] if both >= least * (size - both) else []
    lens = np.array([len(x) for x in sets])
    comp, links = np.arange(n), []
    large = n > 16
    if large:
        bits = _bits(sets, lens)
        names, ids = np.unique(np.concatenate(sets), return_inverse=True)
        ids = np.split(ids, np.cumsum(lens)[:-1])
        flags = np.zeros(len(names), bool)
    for i in range(n - 1):
        if large:
            flags[ids[i]] = True
        rest, step = np.arange(i + 1, n), 64
        while True:
            rest = rest[comp[rest] != comp[i]]
            if not len(rest):
                break
            j, rest = rest[:step], rest[step:]
            step = min(4 * step, 4096)
            if block is not None:
                j = j[block[j] != block[i]]
            j = j[np.minimum(lens[j], lens[i]) >= least * np.maximum(lens[j], lens[i])]
            if not len(j):
                continue
            if large:
                differ = np.bitwise_count(bits[j] ^ bits[i]).sum(axis=1, dtype=np.int64)
                j = j[differ * (1 + least) <= (lens[j] + lens[i]) * (1 - least) + 1e-6]
            at = 0
            while at < len(j):  # few at a time: a link may settle the others
                some = j[at:at + 16]
                at += 16
                some = some[comp[some] != comp[i]]
                if not len(some):
                    continue
                if large:
                    both = np.add.reduceat(flags[np.concatenate([ids[x] for x in some])], np.cumsum(lens[some]) - lens[some], dtype=np.int64)
                else:
                    both = np.array([_common(sets[i], sets[x]) for x in some])
                for x in some[both >= least * (lens[i] + lens[some] - both)].tolist():
                    if comp[x] != comp[i]:
                        comp[comp == comp[x]] = comp[i]
                        links.append((i, x))
        if large:
            flags[ids[i]] = False
    return links


def _links(batches: Iterator[pa.RecordBatch], least: float, sets: Callable) -> Iterator[pa.RecordBatch]:
    """Links (a, b) of the units (key, lo, hi); their rows come one after the other."""

    def compare(t: pa.Table, start: np.ndarray) -> pa.RecordBatch:
        node, block = t.column("node").to_numpy(), t.column("block").to_numpy()
        _, at, which = np.unique(node, return_index=True, return_inverse=True)
        own = sets(t.column("line").take(pa.array(at)).to_pylist())
        found = []
        for i, j, apart in zip(start.tolist(), [*start[1:].tolist(), len(node)], (t.column("lo").to_numpy() != t.column("hi").to_numpy())[start].tolist(), strict=True):
            found += [(i + x, i + y) for x, y in forest([own[w] for w in which[i:j].tolist()], block[i:j] if apart else None, least)]
        ends = np.array(found, np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(node[ends[:, 0]]), pa.array(node[ends[:, 1]])], names=["a", "b"])

    held: list[pa.RecordBatch] = []
    for b in chain(batches, [None]):
        if b is not None:
            held += [b] if b.num_rows else []
            if sum(x.nbytes for x in held) < CHARS:
                continue
        if not held:
            continue
        t = pa.Table.from_batches(held)
        unit = [t.column(c).to_numpy() for c in ("key", "lo", "hi")]
        start = np.flatnonzero(np.r_[True, np.any([x[1:] != x[:-1] for x in unit], axis=0)])
        end = int(start[-1]) if b is not None else t.num_rows
        if end:
            yield compare(t.slice(0, end), start[start < end])
            held = t.slice(end).combine_chunks().to_batches()


def similar_lines(lines: DataFrame, least: float = LEAST, sets: Callable = shingle_sets) -> DataFrame:
    """(node, root) of all lines that have a similar other line.

    ``lines`` has node, line, size (characters) and bands, the last three only where a
    node is first met. ``sets`` turns texts into the sorted hashes of what is compared.
    """
    known = lines.filter("bands IS NOT NULL")
    found = cut(known.select(F.explode("bands").alias("key"), "node").repartition("key").sortWithinPartitions("key")
                .mapInArrow(_buckets, "key bigint, node bigint, n bigint, mark bigint"))
    buckets = cut(found.filter("n IS NOT NULL").groupBy("node", "n", "mark").agg(F.min("key").alias("key")).select("key", "n"))
    members = cut(attach(found.filter("n IS NULL").select("key", "node"), buckets, "key"))
    wanted = cut(members.select("node").distinct())
    few = F.broadcast(wanted) if wanted.count() <= MOST_BROADCAST else wanted  # one number a row
    sizes = known.select("node", "size").join(few, "node").groupBy("node").agg(F.max("size").alias("size"))
    parts = cut(members.join(sizes, "node").groupBy("key").agg(F.max("n").alias("n"), F.sum("size").alias("size"))
                .select("key", "n", F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("size") / CHARS)).alias("parts")))
    block = F.pmod(F.xxhash64("node"), F.col("parts"))
    dealt = (attach(members.select("key", "node"), parts, "key")
             .select("key", "node", block.alias("block"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("with"))
             .select("key", F.least("block", "with").alias("lo"), F.greatest("block", "with").alias("hi"), "block", "node"))
    texts = known.select("node", "line").join(few, "node").dropDuplicates(["node"])
    met = dealt.join(texts.hint("shuffle_merge"), "node").repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "node")
    links = cut(met.mapInArrow(lambda it: _links(it, least, sets), "a bigint, b bigint"))
    discard(found, buckets, members, wanted, parts)
    roots = cut(components(links))
    discard(links)
    return roots


def mark_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: float = LEAST) -> DataFrame:
    """One row per visible line: KEY, ``line_no``, ``line_class`` (a node of its component) and ``kept``."""
    keyed = docs.select(*row_key(F.col(doc_id), F.col(text)), F.col(text))
    place = F.struct(*KEY, "line_no")

    def grouped(lines: DataFrame) -> DataFrame:
        return cut(lines.groupBy("node").agg(F.count("*").alias("n"), F.min(place).alias("first"),
                                             F.min("other").alias("lo"), F.max("other").alias("hi")))
    lines = cut(read_lines(keyed, text))
    each = grouped(lines)
    clash = each.filter("lo <> hi").select("node")
    if not clash.isEmpty():  # two lines of one 64-bit hash: the second hash tells them apart
        lines = cut(lines.join(clash.withColumn("_x", F.lit(True)), "node", "left")
                    .withColumn("node", F.when(F.col("_x"), F.xxhash64("node", "other")).otherwise(F.col("node"))).drop("_x"))
        each = grouped(lines)
    rows = lines.select(*KEY, "line_no", "node")
    roots = similar_lines(lines, least)
    linked = cut(each.join(roots, "node").select("node", "n", "root", "first"))
    whole = linked.groupBy("root").agg(F.min("first").alias("first"), F.count("*").alias("m"))
    repeated = each.filter("n > 1").join(roots, "node", "left_anti").select("node", "n", F.col("node").alias("root"), "first")
    classes = cut(repeated.unionByName(attach(linked.drop("first"), whole, "root", "m").select("node", "n", "root", "first")))
    discard(each, roots, linked)
    return (attach(rows, classes, "node", how="left")  # a line without a class is the only one of its node
            .select(*KEY, "line_no", F.coalesce("root", "node").alias("line_class"), F.coalesce(place == F.col("first"), F.lit(True)).alias("kept")))


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: float = LEAST) -> DataFrame:
    """Documents with all their columns; in ``text`` only the kept lines (and lines without visible characters)."""
    drops = (mark_lines(docs, doc_id, text, least).filter("NOT kept").groupBy(*KEY)
             .agg(F.collect_set("line_no").alias("_drop")))  # of one text
    rows = docs.select("*", *row_key(F.col(doc_id), F.col(text))).join(drops, KEY, "left")
    parts = F.filter(F.split(text, "\n", -1), lambda line, i: ~F.array_contains(F.coalesce("_drop", F.array().cast("array<int>")), i))
    return rows.withColumn(text, F.when(F.col("_drop").isNull(), F.col(text)).otherwise(F.array_join(parts, "\n"))).select(*docs.columns)


def op7_line_dedup(docs: DataFrame) -> DataFrame:
    """Every visible line of every document with its class and whether it stays."""
    marked = mark_lines(docs.select("doc_id", "text"))
    return marked.select(F.when(~F.col("_nil"), F.col("_id")).alias("doc_id"), "line_no", "line_class", "kept")
