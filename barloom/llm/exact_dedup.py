"""Exact dedup by composable polynomial fingerprints and a chunkwise comparison.

Texts are equal when they are identical after deleting ASCII white space. The
fingerprint of a byte string is the pair of its polynomial values modulo two
31-bit primes; that of a text follows from those of its chunks, since

    f(a + b) = f(a) * base ** len(b) + f(b).

Each chunk is hashed on its own and shifted by the bytes behind it, so the sum
of the shifted chunks, in any order, is the fingerprint. Texts longer than
``split`` bytes are cut into row-sized pieces that different tasks hash; Spark
sums them.

Rows of equal fingerprint and length are compared exactly: their chunks pass
through a least/greatest aggregate per (fingerprint, chunk number), which keeps
two chunks however many copies there are and combines before the shuffle. Where
both agree for all chunks the texts are equal; a group that fails (a collision)
is regrouped by the texts themselves.

NULL counts as empty text. Of equal texts the row with the most code points
stays, then the smallest doc_id (NULL last); rows alike in id and text are
repeats of one row, of which each is returned and none is preferred, so all
carry the mark of that row. Input columns named like a result column are
replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from barloom.llm.common import KEY, annotate, attach, row_key
from barloom.llm.kernels import SPACES, each_text
from barloom.session import cut

# fixed values: two primes below 2^31 and a base for each
PRIMES = (2147483647, 2147483629)
BASES = (1103515245, 69069069)
CHUNK = 4096
SPLIT = 1 << 20


def _powers(base: int, prime: int, n: int) -> np.ndarray:
    out = np.empty(n, np.int64)
    x = 1
    for i in range(n - 1, -1, -1):
        out[i] = x
        x = x * base % prime
    return out


_POWERS = [_powers(b, p, CHUNK) for b, p in zip(BASES, PRIMES, strict=True)]
_STEP = [pow(b, CHUNK, p) for b, p in zip(BASES, PRIMES, strict=True)]


def polynomial(data: bytes) -> tuple[int, int]:
    """Both fingerprints of the bytes, combined from those of chunks of CHUNK bytes."""
    n = len(data)
    lead = n % CHUNK  # a short first chunk; all later ones are whole
    out = []
    raw = np.frombuffer(data, np.uint8)
    for powers, step, p in zip(_POWERS, _STEP, PRIMES, strict=True):
        value = int(np.dot(raw[:lead].astype(np.int64), powers[CHUNK - lead:])) % p if lead else 0
        if n >= CHUNK:
            for h in (raw[lead:].reshape(-1, CHUNK).astype(np.int64) @ powers % p).tolist():
                value = (value * step + h) % p
        out.append(value)
    return out[0], out[1]


def shifted(part: tuple[int, int], behind: int) -> tuple[int, int]:
    """A piece's fingerprints moved in front of ``behind`` further bytes."""
    return tuple(h * pow(b, behind, p) % p for h, b, p in zip(part, BASES, PRIMES, strict=True))


def normalised(text: bytes) -> bytes:
    return text.translate(None, SPACES)


_KEY_TYPE = T.StructType().add("_nil", "boolean").add("_id", "long").add("_hash", "long")


def _kernel(text: str, values: Callable[[bytes], tuple], kinds: list[pa.DataType]):
    def kernel(b: pa.RecordBatch):
        columns = zip(*map(values, each_text(b.column(text))), strict=True) if b.num_rows else [[]] * len(kinds)
        return [pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], None
    return kernel


def _print(text: bytes) -> tuple[int, int, int]:
    data = normalised(text)
    return *polynomial(data), len(data)


def _digest(text: bytes) -> tuple[str]:
    return (hashlib.sha256(normalised(text)).hexdigest(),)


PRINT = T.StructType().add("f1", "long").add("f2", "long").add("len", "long")
DIGEST = T.StructType().add("text_sha256", "string")


def pieces(docs: DataFrame, text: str, size: int, keys: list[str], clean: bool) -> DataFrame:
    """(keys, no, piece): the bytes of every text, normalised first if ``clean``, in pieces of ``size``."""
    schema = T.StructType([docs.schema[k] for k in keys]).add("no", "integer").add("piece", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, t in enumerate(each_text(b.column(text))):
                t = normalised(t) if clean else t
                for first in range(0, max(len(t), 1), size * 64):  # a batch holds at most 64 pieces
                    part = [t[j:j + size] for j in range(first, min(max(len(t), 1), first + size * 64), size)]
                    row = pa.array([i] * len(part))
                    yield pa.RecordBatch.from_arrays(
                        [b.column(k).take(row) for k in keys]
                        + [pa.array(range(first // size, first // size + len(part)), pa.int32()), pa.array(part, pa.binary())],
                        names=[*keys, "no", "piece"])

    return docs.select(*keys, text).mapInArrow(run, schema)


def fingerprints(docs: DataFrame, text: str = "text", split: int = SPLIT, digest: bool = False) -> DataFrame:
    """``f1, f2, len`` of every row instead of its text; rows need the KEY columns.

    With ``digest`` also ``text_sha256``, which cannot be put together from
    pieces and is computed whole by each row's task.
    """
    size = F.coalesce(F.octet_length(text), F.lit(0))
    one = [pa.int64()] * 3
    fields = T.StructType(PRINT.fields + (DIGEST.fields if digest else []))
    values = (lambda t: _print(t) + _digest(t)) if digest else _print
    whole = annotate(docs.filter(size <= split), _kernel(text, values, one + [pa.string()] * digest), fields, (text,), text)
    huge = docs.filter(size > split)
    if huge.isEmpty():
        return whole
    parts = pieces(huge, text, split, KEY, clean=False).repartition(*KEY, "no")
    parts = annotate(parts, _kernel("piece", _print, one), PRINT, ("piece",), "piece")
    each = parts.groupBy(*KEY).agg(F.collect_set(F.struct("no", "len", "f1", "f2")).alias("ps"))  # at most 2 GB / split

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for ps in b.column("ps").to_pylist():
                f, behind = (0, 0), 0
                for p in sorted(ps, key=lambda p: -p["no"]):
                    f = tuple((x + y) % q for x, y, q in zip(f, shifted((p["f1"], p["f2"]), behind), PRIMES, strict=True))
                    behind += p["len"]
                rows.append((*f, behind))
            columns = zip(*rows, strict=True) if rows else [[]] * 3
            yield pa.RecordBatch.from_arrays([b.column(k) for k in KEY] + [pa.array(list(c), pa.int64()) for c in columns],
                                             names=[*KEY, *PRINT.names])

    combined = each.mapInArrow(combine, T.StructType(_KEY_TYPE.fields + PRINT.fields))
    rest = annotate(huge, _kernel(text, _digest, [pa.string()]), DIGEST, (text,), text) if digest else huge.drop(text)
    return whole.unionByName(rest.join(combined, KEY))


def exact_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", split: int = SPLIT,
                 digest: bool = False, prints: Callable[..., DataFrame] = fingerprints) -> DataFrame:
    """Every row without its text, with ``keep_id``, ``group_size``, ``kept`` (and ``text_sha256``).

    ``prints`` computes the fingerprints; a weaker one only costs time.
    """
    docs = docs.drop("keep_id", "group_size", "kept", "text_sha256", *KEY, *PRINT.names, "_f", "_chars", "_n", "_best")
    keyed = docs.select("*", *row_key(F.col(doc_id), F.col(text)), F.coalesce(F.length(text), F.lit(0)).alias("_chars"))
    rows = cut(prints(keyed, text, split, digest).withColumn("_f", F.concat_ws("-", *PRINT.names)).drop(*PRINT.names))
    several = cut(rows.groupBy("_f").agg(F.count("*").alias("_n")).filter("_n > 1"))
    alike = attach(rows.select("_f", *KEY), several, "_f", "_n").select("_f", *KEY).distinct()
    texts = keyed.select(*KEY, text).join(alike, KEY).select("_f", *KEY, text)
    unequal = cut(pieces(texts, text, CHUNK, ["_f"], clean=True).groupBy("_f", "no")
                  .agg(F.min("piece").alias("lo"), F.max("piece").alias("hi")).filter("lo <> hi").select("_f").distinct())
    if not unequal.isEmpty():  # different texts under one fingerprint: the texts themselves tell them apart
        clean = F.translate(F.coalesce(F.col(text), F.lit("")), SPACES.decode(), "")
        again = texts.join(unequal, "_f").select(*KEY, F.concat("_f", F.lit("-"), clean).alias("_g")).distinct()
        rows = cut(rows.join(again, KEY, "left").withColumn("_f", F.coalesce("_g", "_f")).drop("_g"))
    rank = F.struct(F.col("_chars"), (~F.col("_nil")).alias("has"), (-F.col("_id")).alias("neg"), F.col("_hash"))
    classes = cut(rows.groupBy("_f").agg(F.count("*").alias("_n"), F.max(rank).alias("_best")))
    return (attach(rows, classes, "_f", "_n")
            .withColumn("keep_id", F.when(F.col("_best.has"), -F.col("_best.neg")))
            .withColumn("group_size", F.col("_n")).withColumn("kept", rank == F.col("_best"))
            .drop("_f", "_n", "_best", "_chars"))


def exact_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each group of equal texts, with all its columns."""
    keep = exact_groups(docs.select(doc_id, text), doc_id, text).filter("kept").select(*KEY).distinct()
    keyed = docs.select("*", *row_key(F.col(doc_id), F.col(text)))
    return keyed.join(keep, KEY, "left_semi").dropDuplicates(KEY).select(*docs.columns)


def op4_exact_dedup(docs: DataFrame) -> DataFrame:
    """Contract columns of every document."""
    out = exact_groups(docs.select("doc_id", "text"), digest=True)
    return out.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


ORACLE = r"""
WITH d AS (SELECT doc_id, COALESCE(length(text), 0) AS n,
  regexp_replace(COALESCE(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
  doc_id IS NOT DISTINCT FROM first_value(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t ORDER BY n DESC, doc_id NULLS LAST)
"""
