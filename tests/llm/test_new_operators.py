"""Token alignment, Merkle manifest and exact top-k on odd rows, on an empty table and against brute force."""

import hashlib
import os
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.llm import knn_join, merkle, token_links


def aligned(texts):
    """Both encodings of whole texts, all overlapping pairs by comparing ranges, counts over all texts."""
    import sentencepiece
    from tokenizers import Tokenizer
    folder = token_links.tokenizer_folder()
    a = Tokenizer.from_file(os.path.join(folder, token_links.BYTE_BPE))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=os.path.join(folder, token_links.PIECE_BPE))
    level = token_links.byte_level()
    found = []
    for t in texts:
        ids_a = a.encode(" " + t, add_special_tokens=False).ids if t else []
        ids_b = b.encode(t) if t else []
        bytes_a = [bytes(level[c] for c in a.id_to_token(i)) for i in ids_a]
        bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        whole = (" " + t).encode() if t else b""
        if b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
            ids_a, ids_b, bytes_a, bytes_b = [], [], [], []
        ends_a, ends_b = np.cumsum([len(x) for x in bytes_a]).tolist(), np.cumsum([len(x) for x in bytes_b]).tolist()
        links, j = [], 0
        for i, (x, end) in enumerate(zip(bytes_a, ends_a)):
            while j and ends_b[j - 1] > end - len(x):
                j -= 1
            while j < len(ends_b) and ends_b[j] - len(bytes_b[j]) < end:
                if ends_b[j] > end - len(x):
                    links.append((ids_a[i], ids_b[j]))
                j += 1
        both = sorted(set(ends_a) & set(ends_b))
        groups = [",".join(str(i) for i, e in zip(ids_a, ends_a) if s < e <= f) + "|" + ",".join(str(i) for i, e in zip(ids_b, ends_b) if s < e <= f)
                  for s, f in zip([0, *both[:-1]], both)] if len(ids_a) < 3000 else None
        found.append((ids_a, ids_b, len(both), links, groups))
    n = Counter(p for f in found for p in set(f[3]))
    top = {}
    for (x, _), c in n.items():
        top[x] = max(top.get(x, 0), c)
    return [(len(x), len(y), g, len(ls), sum(n[p] == top[p[0]] for p in ls), sum(n[p] for p in ls),
             ("" if not x else hashlib.sha256(";".join(gs).encode()).hexdigest()) if gs is not None else None) for x, y, g, ls, gs in found]


TEXTS = ["the cat the cat the cat", "<|endoftext|> and </s> <0x41> <unk>", "a ▁ b", "▁lead", "two  blanks   and\ttabs \n\n lines ", "  lead", "x",
         "Ünïcödé 😀 日本語 text", "trail ", "isn't it we'll 12345 67", "a\x00b \x85 c　d", " "]


@pytest.mark.parametrize("block, buckets", [(token_links.BLOCK, token_links.BUCKETS), (40, 3)])
def test_op11_against_whole_encodings(spark, odd_docs, block, buckets):
    rows = [(i, r.text) for i, r in enumerate(odd_docs.collect())] + [(100 + i, t) for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("n_a", F.lit("own")).withColumn("block", F.lit(1)).repartition(3)
    out = {r.doc_id: r for r in token_links.token_links(docs, block=block, buckets=buckets).collect()}
    assert len(out) == len(rows)
    for (i, t), want in zip(rows, aligned([t for _, t in rows])):
        r = out[i]
        got = (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256)
        assert got[:6] == want[:6] and want[6] in (None, got[6]), t
    assert out[102].n_a == out[103].n_a == 0 and out[101].n_a > 0 and out[102].groups_sha256 == ""


def test_op11_repeats_null_ids_and_empty_tables(odd_docs, no_docs):
    out = token_links.op11_token_alignment(odd_docs).collect()
    assert Counter(r.doc_id for r in out) == Counter(r.doc_id for r in odd_docs.collect())
    assert all(r.n_links == r.n_a + r.n_b - r.n_groups and r.n_best <= r.n_links <= max(r.count_sum, 0) for r in out)
    assert len({tuple(r) for r in out if r.doc_id == 2}) == 1
    assert token_links.op11_token_alignment(no_docs).count() == 0


def test_bitmaps_round_trip():
    rng = np.random.default_rng(0)
    rows = sorted({(int(k), int(p), int(s)) for k, p, s in zip(rng.integers(0, 5, 900) ** 9, rng.integers(0, 3, 900), rng.integers(0, 203, 900))}
                  | {(7, 0, s) for s in range(203)})
    key, plane, slot = np.array(rows).T
    k, p, n, s, docs = token_links.unpacked(token_links.packed(key, plane, slot, 203))
    assert docs == 203 and list(zip(np.repeat(k, n).tolist(), np.repeat(p, n).tolist(), s.tolist())) == rows
    assert len(token_links.packed(np.zeros(203, int), np.zeros(203, int), np.arange(203), 203)) == 16 + 13 + 26


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(leaves, arity):
    """Root and proofs, level by level."""
    way, level, at = [[] for _ in leaves], list(leaves), list(range(len(leaves)))
    while len(level) > 1:
        for i, p in enumerate(at):
            first = p - p % arity
            run = level[first:first + arity]
            way[i].append(("".join(run[:p - first]), "".join(run[p - first + 1:])))
        level = [h(*level[i:i + arity]) for i in range(0, len(level), arity)]
        at = [p // arity for p in at]
    return level[0], way


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


@pytest.mark.parametrize("arity", [8, 2, 3])
def test_op12_against_plain_trees(spark, odd_docs, arity):
    more = spark.createDataFrame([(100 + i, f"Text {i}", "en" if i % 20 else None, "a") for i in range(75)], "doc_id bigint, text string, lang string, source string")
    docs = odd_docs.unionByName(more, allowMissingColumns=True).withColumn("n_chars", F.length("text").cast("bigint")).withColumn("root", F.lit(1))
    leaves = docs.select("*", merkle.leaf(*map(F.col, merkle.COLUMNS)).alias("leaf"))
    out = merkle.manifest(leaves, "lang", "doc_id", "leaf", arity).select(
        "doc_id", "lang", "leaf", "subroot", "root", merkle.path_digest(F.col("path")).alias("proof"), merkle.fold(F.col("leaf"), F.col("path")).alias("folded")).collect()
    rows = [(r.lang, r.doc_id, h(*(field(r[c]) for c in merkle.COLUMNS))) for r in docs.collect()]
    rows.sort(key=lambda r: (r[0] is not None, (r[0] or "").encode(), r[1] is not None, r[1] or 0, r[2]))
    langs = list(dict.fromkeys(r[0] for r in rows))
    trees = {g: tree([r[2] for r in rows if r[0] == g], arity) for g in langs}
    root, above = tree([trees[g][0] for g in langs], arity)
    want = []
    for k, g in enumerate(langs):
        for r, way in zip([r for r in rows if r[0] == g], trees[g][1]):
            want.append((r[1], g, r[2], trees[g][0], root, h(*(x + y for x, y in way + above[k])), root))
    assert sorted(map(tuple, out), key=repr) == sorted(want, key=repr)


def test_op12_finds_tampering(odd_docs, no_docs):
    docs = odd_docs.withColumn("n_chars", F.length("text"))
    out = merkle.op12_merkle(docs).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in out:
        changed = (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 0
                   and any("A" <= c <= "Z" for c in texts[r.doc_id] or ""))
        assert r.verified == (not changed)
    assert len(out) == docs.count() and len({r.root for r in out}) == 1
    assert merkle.op12_merkle(no_docs.withColumn("n_chars", F.lit(1))).count() == 0


def nearest(rows, k):
    """All products with Python integers."""
    ok = [(n, i, [int(np.floor(1024 * float(x))) for x in v]) for n, (i, v) in enumerate(rows)
          if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for n, q, v in ok:
        if q is None or q % 100:
            continue
        s = sorted((-max(-2**63, min(2**63 - 1, sum(a * b for a, b in zip(v, w)))), i is None, i or 0, m) for m, i, w in ok if m != n)
        out += [(q, r + 1, i if not none else None, -x) for r, (x, none, i, _) in enumerate(s[:k])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("kind, unit, block, pivots", [("float", 1 << 14, 8192, 8), ("double", 50, 2, 5), ("float", 7, 1, 40)])
def test_op13_against_all_products(spark, kind, unit, block, pivots):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 5)) * 4
    rows = [(i * 10, (centres[i % 6] + rng.normal(size=5) * 0.1).tolist()) for i in range(150)]
    rows += [(100, rows[3][1]), (100, rows[3][1]), (None, rows[3][1]), (2000, None), (2100, [1.0, None]), (2200, [float("nan"), 1.0]),
             (2300, [float("inf"), 1.0]), (2400, []), (2500, [0.5]), (2600, [0.0] * 5), (3, rows[0][1]), (4, rows[0][1])]
    if kind == "double":
        rows += [(2700, [1e12, -3e11, 1e-3, 5.0, 7.0]), (2800, [1e16, 1e16, 1.0, 1.0, 1.0])]
    rows = [(i, None if v is None else [x if x is None else float(np.float32(x)) if kind == "float" else x for x in v]) for i, v in rows]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], f"vec_id bigint, embedding array<{kind}>, cell int")
    out = knn_join.top_k(df.repartition(4), F.col("id") % 100 == 0, 10, block=block, unit=unit, least_pivots=pivots)
    assert sorted(map(tuple, out.collect()), key=repr) == nearest(rows, 10)
    assert knn_join.op13_top_k(df.limit(0)).count() == 0 and knn_join.op13_top_k(df.filter("vec_id % 100 <> 0")).count() == 0
    assert [tuple(r) for r in knn_join.op13_top_k(df.filter("vec_id = 2500")).collect()] == []


def test_op13_leaves_out_far_cells(spark):
    """With separate clusters the bounds keep most data from being sent, and nothing is lost."""
    import pandas as pd
    pivots = np.array([[1000.0, 0], [0, 1000.0], [-1000.0, 0]])
    groups = pd.DataFrame({"cell": [0], "u": [10.0], "low": [990.0], "high": [1010.0]})
    rings = pd.DataFrame({"cell": [0, 1, 2], "ring": [1, 1, 1], "n": [50, 50, 50], "near": [0.0] * 3, "far": [20.0] * 3, "low": [980.0] * 3, "high": [1020.0] * 3})
    assert knn_join.bounds(groups, rings, pivots, 10).cell.tolist() == [0]
    assert sorted(knn_join.bounds(groups, rings, pivots, 60).cell) == [0, 1]
