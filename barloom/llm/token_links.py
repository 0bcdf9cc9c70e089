"""Cross-tokenizer alignment: which tokens of two vocabularies cover the same bytes, weighed by the corpus.

Each text is encoded by a byte-level BPE (A, with a space in front) and by a
SentencePiece BPE (B, which adds that space itself). Both tile the same bytes;
offsets where tokens of both end cut them into groups, and every stretch
between neighbouring ends of either links one A token with one B token.

Counts come from inverted pair bitmaps. Documents are dealt into blocks of up
to 65,536; a block holds for every linked id pair the compressed bitmap of its
documents (sorted slots, or plain bits where these are shorter), and for pairs
linked several times in a document further bitmaps: plane j holds the
documents whose multiplicity less one has bit j set. Bitmaps of one pair from
different blocks have no document in common, so the cardinality of their OR is
the sum of their popcounts: the number of documents that hold the pair. These
counts, and for every A id the largest of them, go back along the postings: the
first bitmap adds a pair's count once, plane j adds it 2^j times, and each
document receives the sum over its links.

The postings of a block are packed by hash of the pair into ``buckets``, which
is how they meet the counts: all shuffles move packed arrays, and a task streams
the blocks of a bucket. A pair in every document takes one bit a document there.
Best counts of the A ids are collected, at most one a vocabulary entry.

Encoding is done for distinct stretches of text: no token of either vocabulary
spans a blank that has a letter or mark (no white space, no U+2581) on either
side, so the text is cut there and repeated stretches are looked up. That the
pieces of B allow this is checked when its model is loaded. Otherwise, and for a
stretch whose bytes one tokenizer does not give back, whole texts are encoded.

NULL and empty texts, and texts that either tokenizer does not give back, have
no tokens and zeros. Names of special tokens in a text are plain text. Repeated
rows are documents of their own. A NULL id stays NULL. Other columns are
ignored. Memory of a task grows with one block (``block`` bytes of text), with
its longest single text (about ten bytes a byte) and with the longest stretch
without a cut, which the tokenizers see whole.
"""

from __future__ import annotations

import functools
import hashlib
import os
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from barloom.llm.kernels import each_text
from barloom.session import cut

BYTE_BPE, PIECE_BPE = "byte_bpe_50k.json", "piece_bpe_32k.model"
CUT = re.compile(r"(?<=[^\s▁]) (?=\S)")
BLOCK = 8 << 20
SLOTS = 1 << 16
BUCKETS = 128
MEMO = 300_000  # stretches a worker remembers
PAIRS = 4_000_000  # counts a task holds before it hands them on


def tokenizer_folder() -> str:
    """Where the vocabulary files of public tokenizers are installed."""
    import public_tokenizers
    return os.path.dirname(public_tokenizers.path(BYTE_BPE))


def byte_level() -> dict[str, int]:
    """The byte of every character of a byte-level vocabulary: printable Latin-1 stands for itself, the rest for 256, 257, ..."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Strings:
    """A table of byte strings that are taken and joined in bulk."""

    def __init__(self, values: list[bytes]):
        self.table = pa.array(values, pa.large_binary())
        self.size = np.array([len(v) for v in values], np.int64)

    def joined(self, at: np.ndarray) -> bytes:
        if not len(at):
            return b""
        _, off, data = self.table.take(pa.array(at)).buffers()
        return data.to_pybytes()[:int(np.frombuffer(off, np.int64)[len(at)])]


class Tokenizers:
    """Both tokenizers with the bytes of their entries, and the memory of encoded stretches."""

    def __init__(self, folder: str):
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a = Tokenizer.from_file(os.path.join(folder, BYTE_BPE))
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=os.path.join(folder, PIECE_BPE))
        level = byte_level()
        a = [b""] * self.a.get_vocab_size()
        for entry, i in self.a.get_vocab().items():
            a[i] = bytes(level[c] for c in entry)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.text_a, self.text_b = Strings(a), Strings(b)
        #: decimal ids with what follows them: , | of A and , ; and nothing of B
        self.marks = Strings([b"%d%s" % (i, s) for s in (b",", b"|") for i in range(len(a))]
                             + [b"%d%s" % (i, s) for s in (b",", b";") for i in range(len(b))])
        self.separable = not any("▁" in p.lstrip("▁") for p in pieces)
        self.forget()

    def forget(self) -> None:
        self.at: dict[str, int] = {}
        self.marked: list[bytes] = []
        self.counts = np.empty((0, 4), np.int64)  # n_a, n_b, n_groups, n_links; n_a is -1 where bytes are not given back
        self.pairs, self.off = np.empty(0, np.int64), np.zeros(1, np.int64)

    def learn(self, stretches: list[str]) -> None:
        """Encode stretches that are not known yet; each counts as having a space in front."""
        for i in range(0, len(stretches), 50_000):
            self._learn(stretches[i:i + 50_000])

    def _learn(self, new: list[str]) -> None:
        raw = [(" " + w).encode() for w in new]
        size = np.array([len(r) for r in raw], np.int64)
        ids_a = [e.ids for e in self.a.encode_batch([" " + w for w in new], add_special_tokens=False)]
        ids_b = self.b.encode(new, num_threads=1)
        n_a, n_b = (np.array([len(x) for x in ids], np.int64) for ids in (ids_a, ids_b))
        a, b = (np.fromiter((i for x in ids for i in x), np.int64, int(n.sum())) for ids, n in ((ids_a, n_a), (ids_b, n_b)))
        good = np.ones(len(new), bool)
        whole = b"".join(raw)
        for side, ids, n in ((self.text_a, a, n_a), (self.text_b, b, n_b)):
            if side.joined(ids) != whole:
                got = np.split(ids, np.cumsum(n)[:-1])
                good &= [side.joined(g) == r for g, r in zip(got, raw, strict=True)]
        first = len(self.counts)
        bad = np.flatnonzero(~good)
        if len(bad):
            a, b, size = a[np.repeat(good, n_a)], b[np.repeat(good, n_b)], np.where(good, size, 0)
            n_a, n_b = n_a * good, n_b * good
        ends_a, ends_b, own = np.cumsum(self.text_a.size[a]), np.cumsum(self.text_b.size[b]), np.cumsum(size)
        both = np.intersect1d(ends_a, ends_b, assume_unique=True)
        either = np.union1d(ends_a, ends_b)
        pairs = a[np.searchsorted(ends_a, either)] << 32 | b[np.searchsorted(ends_b, either)]
        groups = np.diff(np.searchsorted(both, own, "right"), prepend=0)
        links = np.diff(np.searchsorted(either, own, "right"), prepend=0)
        # the text of the groups: A ids, a bar, B ids, a semicolon but at the end of a stretch
        group_a, group_b = np.searchsorted(both, ends_a), np.searchsorted(both, ends_b)
        mark_a = a + len(self.text_a.size) * np.isin(ends_a, both)
        mark_b = b + 2 * len(self.text_a.size) + len(self.text_b.size) * np.isin(ends_b, both)
        order = np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable")
        marks = np.concatenate([mark_a, mark_b])[order]
        text = self.marks.joined(marks)
        stop = np.concatenate([[0], np.cumsum(self.marks.size[marks])])[np.cumsum(n_a + n_b)].tolist()
        start = [0, *stop[:-1]]
        self.marked += [text[i:max(i, j - 1)] for i, j in zip(start, stop, strict=True)]
        counts = np.stack([n_a, n_b, groups, links], axis=1)
        counts[bad, 0] = -1
        self.counts = np.concatenate([self.counts, counts])
        self.pairs = np.concatenate([self.pairs, pairs])
        self.off = np.concatenate([self.off, self.off[-1] + np.cumsum(links)])
        for k, w in enumerate(new):
            self.at[w] = first + k

    def stretches(self, texts: list[str | None]) -> list[np.ndarray | None]:
        """Every text as numbers of known stretches; None for a text without tokens."""
        split = [(CUT.split(t) if self.separable else [t]) if t else None for t in texts]
        known = self.at
        new = dict.fromkeys(w for s in split if s for w in s if w not in known)
        if new:
            self.learn(list(new))
        out = []
        for t, s in zip(texts, split, strict=True):
            if s is None:
                out.append(None)
                continue
            at = np.fromiter(map(known.__getitem__, s), np.int64, len(s))
            if (self.counts[at, 0] < 0).any():  # not given back piece by piece: the whole text decides
                if t not in known:
                    self.learn([t])
                at = np.array([known.pop(t)])
                at = None if self.counts[at[0], 0] < 0 else at
            out.append(at)
        return out


@functools.cache
def loaded(folder: str) -> Tokenizers:
    return Tokenizers(folder)


def ragged(off: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all entries of the wanted rows of a packed table, and the length of each row."""
    n = off[rows + 1] - off[rows]
    total = int(n.sum())
    return np.arange(total) + np.repeat(off[rows] - np.cumsum(n) + n, n), n


def bucket_of(pairs: np.ndarray, buckets: int) -> np.ndarray:
    """A bucket by multiplicative hash of the pair."""
    return ((pairs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % buckets


def packed(key: np.ndarray, plane: np.ndarray, slot: np.ndarray, docs: int) -> bytes:
    """Bitmaps of a block: rows are (pair, plane, slot), sorted.

    Layout: number of bitmaps; pairs; planes; cardinalities; then one container
    after the other: 16-bit slots, or ``docs`` bits if these take less room.
    """
    first = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (plane[1:] != plane[:-1])])) if len(key) else np.empty(0, np.int64)
    n = np.diff(np.append(first, len(key)))
    slot = slot.astype("<u2")
    wide = (docs + 7) // 8
    dense = np.flatnonzero(2 * n > wide)
    body, at = [], 0
    for d in dense.tolist():
        i, j = int(first[d]), int(first[d] + n[d])
        bits = np.zeros(docs, np.uint8)
        bits[slot[i:j]] = 1
        body += [slot[at:i].tobytes(), np.packbits(bits).tobytes()]
        at = j
    body.append(slot[at:].tobytes())
    head = [np.array([len(first), docs], "<i8"), key[first].astype("<i8"), n.astype("<i4"), plane[first].astype("u1")]
    return b"".join([h.tobytes() for h in head] + body)


def unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """(pairs, planes, cardinalities, slots of all bitmaps one after the other, number of documents)."""
    m, docs = np.frombuffer(data, "<i8", 2).tolist()
    key = np.frombuffer(data, "<i8", m, 16)
    n = np.frombuffer(data, "<i4", m, 16 + 8 * m).astype(np.int64)
    plane = np.frombuffer(data, "u1", m, 16 + 12 * m)
    at, wide = 16 + 13 * m, (docs + 7) // 8
    out, run = [], 0
    for d in np.flatnonzero(2 * n > wide).tolist():
        k = int(n[run:d].sum())
        out.append(np.frombuffer(data, "<u2", k, at))
        out.append(np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8, wide, at + 2 * k), count=docs)))
        at, run = at + 2 * k + wide, d + 1
    out.append(np.frombuffer(data, "<u2", int(n[run:].sum()), at))
    return key, plane, n, np.concatenate(out).astype(np.int64), docs


def merged(parts: Iterable[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted pairs with summed counts."""
    keys, counts = (np.concatenate(x) if x else np.empty(0, np.int64) for x in zip(*parts)) if parts else (np.empty(0, np.int64),) * 2
    keys, at = np.unique(keys, return_inverse=True)
    total = np.zeros(len(keys), np.int64)
    np.add.at(total, at, counts)
    return keys, total


ROWS = ("block bigint, bucket int, slot int, data binary, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, "
        "groups_sha256 string")
ARROW = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("slot", pa.int32()), ("data", pa.binary()), ("doc_id", pa.int64()),
                   ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()),
                   ("groups_sha256", pa.string())])


def batch(n: int, schema: pa.Schema = ARROW, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema],
                                      schema=schema)


def indexed(docs: DataFrame, doc_id: str, text: str, folder: str, block: int, buckets: int) -> DataFrame:
    """Three kinds of rows: documents (with slot), postings (block and bucket) and partial document counts (bucket alone)."""
    def flush(tok: Tokenizers, no: int, ids: list, texts: list, counts: list) -> Iterator[pa.RecordBatch]:
        if len(tok.at) > MEMO:
            tok.forget()
        found = tok.stretches(texts)
        sums = np.array([tok.counts[s].sum(axis=0) if s is not None else np.zeros(4, np.int64) for s in found]).reshape(-1, 4)
        shas = [hashlib.sha256(b";".join([tok.marked[k] for k in s.tolist()])).hexdigest() if s is not None else "" for s in found]
        yield batch(len(ids), block=[no] * len(ids), slot=list(range(len(ids))), doc_id=ids, n_a=sums[:, 0], n_b=sums[:, 1],
                    n_groups=sums[:, 2], n_links=sums[:, 3], groups_sha256=shas)
        slot = np.repeat(np.arange(len(found)), [0 if s is None else len(s) for s in found])
        if not len(slot):
            return
        width = len(tok.counts)
        own, times = np.unique(slot * width + np.concatenate([s for s in found if s is not None]), return_counts=True)
        where, n = ragged(tok.off, own % width)
        pair, slot, times = tok.pairs[where], np.repeat(own // width, n), np.repeat(times, n)
        order = np.lexsort((slot, pair))
        pair, slot, times = pair[order], slot[order], times[order]
        first = np.flatnonzero(np.concatenate([[True], (pair[1:] != pair[:-1]) | (slot[1:] != slot[:-1])]))
        pair, slot, more = pair[first], slot[first], np.add.reduceat(times, first) - 1
        keys, slots, planes = [pair], [slot], [np.zeros(len(pair), np.int64)]
        for j in range(int(more.max()).bit_length()):
            has = more >> j & 1 > 0
            keys.append(pair[has])
            slots.append(slot[has])
            planes.append(np.full(int(has.sum()), j + 1))
        counts.append(np.unique(pair, return_counts=True))
        key, slot, plane = np.concatenate(keys), np.concatenate(slots), np.concatenate(planes)
        bucket = bucket_of(key, buckets)
        order = np.lexsort((slot, plane, key, bucket))
        key, slot, plane = key[order], slot[order], plane[order]
        stop = np.searchsorted(bucket[order], np.arange(buckets + 1))
        live = np.flatnonzero(np.diff(stop))
        yield batch(len(live), block=[no] * len(live), bucket=live, data=[
            packed(*(x[stop[k]:stop[k + 1]] for x in (key, plane, slot)), len(ids)) for k in live.tolist()])

    def partial(counts: list) -> Iterator[pa.RecordBatch]:
        keys, n = merged(counts)
        bucket = bucket_of(keys, buckets)
        order = np.argsort(bucket, kind="stable")
        stop = np.searchsorted(bucket[order], np.arange(buckets + 1))
        live = np.flatnonzero(np.diff(stop))
        rows = [order[stop[k]:stop[k + 1]] for k in live.tolist()]
        yield batch(len(live), bucket=live, data=[np.concatenate([keys[r], n[r]]).astype("<i8").tobytes() for r in rows])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = loaded(folder)
        no, size, held = TaskContext.get().partitionId() << 32, 0, 0
        ids, texts, counts = [], [], []
        for b in batches:
            for i, raw in zip(b.column("id").to_pylist(), each_text(b.column("t")), strict=True):
                if ids and (size + len(raw) > block or len(ids) == SLOTS):
                    yield from flush(tok, no, ids, texts, counts)
                    held += len(counts[-1][0]) if counts else 0
                    no, size, ids, texts = no + 1, 0, [], []
                    if held > PAIRS:
                        yield from partial(counts)
                        counts, held = [], 0
                try:
                    t = raw.decode()
                except UnicodeDecodeError:  # no tokenizer gives such bytes back
                    t = None
                ids.append(i)
                texts.append(t)
                size += len(raw)
        if ids:
            yield from flush(tok, no, ids, texts, counts)
        if counts:
            yield from partial(counts)

    return docs.select(F.col(doc_id).cast("bigint").alias("id"), F.col(text).alias("t")).mapInArrow(run, ROWS)


def counted(partials: DataFrame) -> DataFrame:
    """One row a bucket: its pairs and the number of documents of each, in ``data``."""
    schema = pa.schema([("bucket", pa.int32()), ("data", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, sums = None, []

        def done() -> pa.RecordBatch:
            keys, n = merged(sums)
            return batch(1, schema, bucket=[bucket], data=[np.concatenate([keys, n]).astype("<i8").tobytes()])

        for b in batches:
            for k, data in zip(b.column("bucket").to_pylist(), b.column("data").to_pylist(), strict=True):
                if k != bucket and bucket is not None:
                    yield done()
                if k != bucket:
                    bucket, sums = k, []
                keys, n = np.frombuffer(data, "<i8").reshape(2, -1)
                sums.append((keys, n))
                if sum(len(s[0]) for s in sums) > 2 * len(sums[0][0]) + (1 << 20):
                    sums = [merged(sums)]
        if bucket is not None:
            yield done()

    return partials.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "bucket int, data binary")


def best_counts(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Every linked A id, sorted, and the highest count among its pairs; at most one row a vocabulary entry."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column("data").to_pylist():
                keys, n = np.frombuffer(data, "<i8").reshape(2, -1)
                a, first = np.unique(keys >> 32, return_index=True)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(np.maximum.reduceat(n, first))], names=["a", "n"])

    found = counts.select("data").mapInArrow(run, "a bigint, n bigint").groupBy("a").agg(F.max("n").alias("n")).orderBy("a").toPandas()
    return found["a"].to_numpy(np.int64), found["n"].to_numpy(np.int64)


def scored(postings: DataFrame, counts: DataFrame, best: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(block, data): for one bucket, the sum of counts and the number of best links of the documents of the block."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, tops = best
        bucket = keys = n = top = None
        for b in batches:
            blocks, data = [], []
            for k, no, raw in zip(*(b.column(c).to_pylist() for c in ("bucket", "block", "data")), strict=True):
                if no is None:
                    bucket = k
                    keys, n = np.frombuffer(raw, "<i8").reshape(2, -1)
                    top = n == tops[np.searchsorted(ids, keys >> 32)]
                    continue
                assert k == bucket
                pair, plane, card, slot, docs = unpacked(raw)
                at = np.searchsorted(keys, pair)
                times = np.int64(1) << np.maximum(plane.astype(np.int64) - 1, 0)
                sums = np.zeros((2, docs), np.int64)
                np.add.at(sums[0], slot, np.repeat(n[at] * times, card))
                np.add.at(sums[1], slot, np.repeat(top[at] * times, card))
                hit = np.flatnonzero(sums[0])
                blocks.append(no)
                data.append(np.concatenate([hit, *sums[:, hit]]).astype("<i8").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.array(data, pa.binary())], names=["block", "data"])

    both = (counts.select("bucket", F.lit(None).cast("bigint").alias("block"), "data")
            .unionByName(postings.select("bucket", "block", "data")))
    return both.repartition("bucket").sortWithinPartitions(F.col("bucket"), F.col("block").asc_nulls_first()).mapInArrow(run, "block bigint, data binary")


def gathered(docs: DataFrame, sums: DataFrame) -> DataFrame:
    """The document rows with ``n_best`` and ``count_sum``, added up over all buckets of their block."""
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    columns = [f for f in ARROW if f.name in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, total = None, np.zeros((2, SLOTS), np.int64)
        for b in batches:
            blocks, slots = b.column("block").to_numpy(), b.column("slot").fill_null(-1).to_numpy()
            data = b.column("data")
            sums = np.zeros((2, b.num_rows), np.int64)
            for i, no in enumerate(blocks.tolist()):
                if no != block:
                    block = no
                    total[:] = 0
                if slots[i] < 0:
                    slot, *more = np.frombuffer(data[i].as_py(), "<i8").reshape(3, -1)
                    total[:, slot] += np.stack(more)
                else:
                    sums[:, i] = total[:, slots[i]]
            own = slots >= 0
            out = pa.RecordBatch.from_arrays([*(b.column(f.name) for f in columns), pa.array(sums[1]), pa.array(sums[0])],
                                             names=[*(f.name for f in columns), "n_best", "count_sum"])
            yield out.filter(pa.array(own))

    kinds = ", ".join(f"{n} {'string' if n == 'groups_sha256' else 'bigint'}" for n in [f.name for f in columns])
    both = docs.select("block", "slot", F.lit(None).cast("binary").alias("data"), *[f.name for f in columns]).unionByName(
        sums, allowMissingColumns=True)
    return (both.repartition("block").sortWithinPartitions(F.col("block"), F.col("slot").asc_nulls_first())
            .mapInArrow(run, kinds + ", n_best bigint, count_sum bigint"))


def token_links(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", folder: str | None = None, block: int = BLOCK,
                buckets: int = BUCKETS) -> DataFrame:
    """Per document: numbers of tokens, groups and links, how many links are the best of their A id, and the sum of their counts."""
    rows = cut(indexed(docs, doc_id, text, folder or tokenizer_folder(), block, buckets))
    counts = cut(counted(rows.filter("block IS NULL").select("bucket", "data")))
    best = best_counts(counts)
    postings = rows.filter("block IS NOT NULL AND bucket IS NOT NULL")
    return gathered(rows.filter("slot IS NOT NULL"), scored(postings, counts, best))


def op11_token_alignment(docs: DataFrame) -> DataFrame:
    """Contract columns of every document."""
    return token_links(docs).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
