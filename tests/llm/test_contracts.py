"""Every operator on odd rows, on an empty table and against brute force."""

import hashlib
import re
import zlib
from collections import Counter
from math import log10

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.llm import (decontaminate, exact_dedup, langid, licenses, line_dedup, lm_score, mixing, secrets, sharding,
                         simhash)
from barloom.llm.common import far_bits

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(x):
    return re.sub("[A-Z]", lambda m: m.group().lower(), x or "")


def key(r):
    return (r.doc_id is None, r.doc_id or 0)


def test_op1_totals_and_limits(odd_docs):
    out = mixing.op1_mixing(odd_docs).collect()
    size = {r.doc_id: len(WORD.findall(r.text or "")) for r in odd_docs.collect()}
    assert len(out) == odd_docs.count()
    assert all(r.size == size[r.doc_id] for r in out if r.doc_id is not None)
    assert all(0 <= r.taken <= 3 * r.size for r in out)
    by = {}
    for r in out:
        g = by.setdefault((r.source_size, r.target), [0])
        g[0] += r.taken
    assert all(abs(t - target) <= 0.5 for (_, target), (t,) in by.items())
    assert abs(sum(target for _, target in by) - sum(r.size for r in out)) < 1e-6 * sum(r.size for r in out)
    again = mixing.op1_mixing(odd_docs.repartition(5)).collect()
    assert sorted(map(tuple, out), key=repr) == sorted(map(tuple, again), key=repr)


def test_mixed_documents_repeat_whole_rows(spark):
    docs = spark.createDataFrame([(i, " ".join(["w"] * 10), "abc"[min(i // 10, 2)]) for i in range(120)], "doc_id bigint, text string, source string")
    out = mixing.mixed_documents(docs).groupBy("source").count().collect()
    assert {r["source"]: r["count"] for r in out} == {"a": 23, "b": 30, "c": 68}  # words: 225, 300 (its limit), 675


def test_op2_learns_and_predicts(spark, odd_docs):
    out = langid.op2_language_id(odd_docs).collect()
    assert len(out) == odd_docs.count() and all(0 <= r.score <= 1 for r in out)
    assert {r.lang_pred for r in out if r.doc_id in (4, 5, 6, 7)} == {"und"}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in out if r.doc_id is not None)
    unlabelled = odd_docs.withColumn("lang", F.lit(None).cast("string"))
    assert {(r.lang_pred, r.score) for r in langid.op2_language_id(unlabelled).collect()} == {("und", 0.0)}


def test_forward_backward_is_exact():
    rng = np.random.default_rng(0)
    e, m, bounds = rng.normal(size=(203, 3)), rng.normal(size=(3, 3)), np.array([0, 100, 100, 140, 203])
    got, a = langid.posteriors(e, m, bounds), np.exp(m)
    for s, t in zip(bounds[:-1], bounds[1:]):
        x = np.exp(e[s:t])
        alpha, beta, v, w = np.zeros_like(x), np.zeros_like(x), np.full(3, 1 / 3), np.full(3, 1 / 3)
        for i in range(t - s):
            v = (v @ a) * x[i]
            v /= v.sum()
            alpha[i] = v
        for i in range(t - s - 1, -1, -1):
            beta[i] = w
            w = a @ (x[i] * w)
            w /= w.sum()
        p = alpha * beta
        np.testing.assert_allclose(got[s:t], p / p.sum(axis=1, keepdims=True), atol=1e-5)


def test_language_switch_inside_a_text():
    de, en = "der hund und die katze ist nicht das haus von mir", "the dog and that cat was with them for this house"
    model = langid.train([(de + " ").encode() * 40, (en + " ").encode() * 40], ["de", "en"])
    f = langid.Features([(de + " " + en).encode()])
    p = langid.posteriors(model.emissions(f), model.moves, f.bounds)
    assert p[:11].argmax(axis=1).tolist() == [0] * 11 and p[11:].argmax(axis=1).tolist() == [1] * 11


def test_op3_verbatim_edited_and_repeated(spark, odd_docs):
    gpl = licenses.NOTICES["gpl-header"]
    text = "lorem " * 30 + gpl.replace("redistribute it and/or", "redistribute this thing and or").replace("Free Software", "") + " dolor"
    mit = "Released under the MIT License. Released under the MIT License."
    docs = odd_docs.select("doc_id", "text", F.lit(1).alias("template")).unionByName(
        spark.createDataFrame([(100, text, 1), (101, "é " + mit, 1)], "doc_id bigint, text string, template int"))
    out = sorted(licenses.op3_license_scan(docs).collect())
    assert [(r.doc_id, r.template) for r in out] == [(100, "gpl-header"), (101, "mit"), (101, "mit")]
    assert 0.9 < out[0].coverage < 1 and out[1].coverage == 1
    assert ("é " + mit)[out[1].start:out[1].end] == "Released under the MIT License"
    blocks = licenses.scan_licenses(docs, licenses.notices(spark), most_words=30)
    assert blocks.count() == 3


@pytest.mark.parametrize("split, weak", [(1 << 20, False), (50, False), (1 << 20, True)])
def test_op4_against_plain_groups(odd_docs, split, weak):
    def prints(*a):
        out = exact_dedup.fingerprints(*a)
        return out.withColumns({"f1": F.lit(0), "f2": F.lit(0), "len": F.lit(0)}) if weak else out
    out = exact_dedup.exact_groups(odd_docs, split=split, digest=True, prints=prints).collect()
    rows = odd_docs.collect()
    norm = {(r.doc_id, r["size"]): re.sub(r"[\x20\x09-\x0D]", "", r.text or "") for r in rows}
    n = Counter(norm.values())
    best = {}
    for r in rows:
        t = norm[r.doc_id, r["size"]]
        best[t] = max(best.get(t, (-1,)), (len(r.text or ""), r.doc_id is not None, -(r.doc_id or 0)))
    assert len(out) == len(rows)
    for r in out:
        t = norm[r.doc_id, r["size"]]
        assert r.group_size == n[t] and r.text_sha256 == hashlib.sha256(t.encode()).hexdigest()
        assert r.keep_id == (-best[t][2] if best[t][1] else None)


def test_polynomials_compose():
    a, b = bytes(range(256)) * 50, b"tail of a text"
    x, y = exact_dedup.shifted(exact_dedup.polynomial(a), len(b)), exact_dedup.polynomial(b)
    assert exact_dedup.polynomial(a + b) == tuple((i + j) % p for i, j, p in zip(x, y, exact_dedup.PRIMES))


@pytest.mark.parametrize("most", [100_000, 5])
def test_op5_against_brute_force(odd_docs, odd_benchmark, most):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = {}
    for r in odd_benchmark.collect():
        w = word.findall(lower(r.text))
        for i in range(max(1, len(w) - 12) if w else 0):
            windows.setdefault(tuple(w[i:i + 13]), set()).add("" if r.item_id is None else str(r.item_id))
    out = decontaminate.find_overlap(odd_docs, odd_benchmark, most_windows=most).collect()
    assert len(out) == odd_docs.count()
    seen = 0
    for r in out:
        w, hit, items = word.findall(lower(r.text)), set(), set()
        for win, names in windows.items():
            for i in range(len(w) - len(win) + 1):
                if tuple(w[i:i + len(win)]) == win:
                    hit.update(range(i, i + len(win)))
                    items |= names
        assert (r.n_words, r.n_hit, r["items"]) == (len(w), len(hit), sorted(items))
        found = [x for s, e in r.spans for x in word.findall(lower(r.text[s:e]))]
        assert found == [w[i] for i in sorted(hit)]
        seen += bool(hit)
    assert seen >= 3


def test_op6_patterns_and_learned_formats(spark, odd_docs):
    rng = np.random.default_rng(3)
    hexes = ["".join(rng.choice(list("0123456789abcdef"), 20)) for _ in range(80)]
    texts = [f"note {i} password={h} and ünder token:abc AKIA{'ABCDEFGH12345678'[i % 8:]}ABCDEFGHIJ secret : '{h}'" for i, h in enumerate(hexes[:60])]
    texts += [f"loose {hexes[70]} words", "plain internationalisation2 text", "f" * 24 + "0" * 24]
    parts = ["consider", "nation", "alis", "ation", "under", "stand", "ings", "over", "whelm", "ful", "ness", "with"]
    texts += [" ".join("".join(rng.choice(parts, 4)) + str(i % 9) for i in range(300))]  # ordinary long words
    docs = spark.createDataFrame(list(enumerate(texts, 100)), "doc_id bigint, text string").unionByName(odd_docs.select("doc_id", "text"))
    out = secrets.op6_secret_scan(docs).collect()
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    assert len(out) == docs.count()
    for r in out:
        if r.doc_id is None:
            continue
        want = []
        for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text[r.doc_id], re.I | re.A):
            if len(m[2]) >= 6:
                want.append((m.start(), 0, f"assign:{m.start()}:{m.end()}"))
        for k, (name, pattern, least) in enumerate((("access", "AKIA[A-Z0-9]+", 20), ("hex", "[0-9a-f]+", 24)), 1):
            want += [(m.start(), k, f"{name}:{m.start()}:{m.end()}") for m in re.finditer(pattern, text[r.doc_id]) if len(m[0]) >= least]
        assert r.base_sha256 == hashlib.sha256(",".join(x[2] for x in sorted(want)).encode()).hexdigest()
    learned = {r.doc_id for r in out if "learned" in r.spans}
    assert learned == {160}


def test_op7_finds_similar_lines(spark, odd_docs):
    from tests.llm.conftest import prose
    line = prose(50, 40)
    texts = ["\n".join([line.upper(), "", prose(60 + i)]) for i in range(3)] + [line.replace("x3", "y3", 2) + "\nshort", "short \n" + prose(99)]
    docs = spark.createDataFrame(list(enumerate(texts, 100)), "doc_id bigint, text string")
    marks = {(r.doc_id, r.line_no): (r.line_class, r.kept) for r in line_dedup.op7_line_dedup(docs).collect()}
    assert len({marks[100 + i, 0][0] for i in range(4)}) == 1
    assert [marks[100 + i, 0][1] for i in range(4)] == [True, False, False, False]
    assert marks[103, 1][0] == marks[104, 0][0] and marks[103, 1][1] and not marks[104, 0][1]
    clean = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs).collect()}
    assert clean[101] == "\n" + prose(61) and clean[100] == texts[0]
    assert line_dedup.dedup_lines(odd_docs).count() == odd_docs.count()


def test_minhash_and_sketch_recall():
    """Of pairs at 0.8 and above, nearly all meet in a band, and of these nearly all pass the sketch."""
    rng = np.random.default_rng(1)
    met, passed, n, bound = 0, 0, 0, far_bits(line_dedup.BANDS * line_dedup.ROWS, line_dedup.LEAST)
    for _ in range(900):
        a = "".join(rng.choice(list("abcdefghij klmn"), 200))
        b = list(a)
        for i in rng.choice(200, 4, replace=False):
            b[i] = "Z"
        a, b = line_dedup.normalised(a), line_dedup.normalised("".join(b))
        x, y = line_dedup.shingles(a), line_dedup.shingles(b)
        if len(x & y) < 0.8 * len(x | y):
            continue
        n += 1
        (p, q), (u, v) = line_dedup.signatures([a, b])
        if (p == q).any():
            met += 1
            passed += sum(int(i ^ j & (1 << 64) - 1).bit_count() for i, j in zip(u.view(np.uint64).tolist(), v.view(np.uint64).tolist())) <= bound
    assert n > 200 and met / n >= 0.95 and passed / met >= 0.99


def test_op7_against_brute_force(spark):
    """Families of edited lines: the classes are the components of all pairs at 0.8, also with a split leader and long lines."""
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(400)]
    lines = []
    for k in range(12):
        base = list(rng.choice(words, 40 if k else 2500))
        for share in (0, 0, 0.01, 0.03, 0.05, 0.08, 0.2):
            lines.append(" ".join(w if rng.random() > share else str(rng.choice(words)) for w in base))
    base = list(rng.choice(words, 60))
    for k in range(70):  # a large family of which the leader knows only a part
        line = list(base)
        for at in rng.choice(60, 2 + k % 3, replace=False):
            line[at] = f"edit{rng.integers(1000)}"
        lines.append(" ".join(line))
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "doc_id bigint, text string").repartition(3)
    sets = [line_dedup.shingles(line_dedup.normalised(x)) for x in lines]
    root = list(range(len(lines)))
    links = [(a, b) for a in root for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    for _ in lines:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    got = {r.doc_id: r for r in line_dedup.op7_line_dedup(docs).collect()}
    classes = {}
    for i, r in enumerate(root):
        classes.setdefault(r, set()).add(got[i].line_class)
    assert all(len(c) == 1 for c in classes.values()) and len({c for s in classes.values() for c in s}) == len(classes) < len(lines)
    assert {i for i in got if got[i].kept} == set(classes)


def test_op7_stores_members_not_pairs(spark, monkeypatch):
    """A family just below the bound, whose pairs nearly all meet in a band: stored rows follow its members. The same classes from small blocks."""
    rng, stored = np.random.default_rng(8), []
    words = [f"v{i:03}" for i in range(900)]
    base, lines = list(rng.choice(words, 60)), []
    for _ in range(250):
        line = list(base)
        for at in rng.choice(60, 3, replace=False):
            line[at] = str(rng.choice(words))
        lines.append(" ".join(line))
    sets = [line_dedup.shingles(x) for x in lines]
    root = list(range(len(lines)))
    for a in root:
        for b in range(a):
            if root[a] != root[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                lo, hi = sorted((root[a], root[b]))
                root = [lo if x == hi else x for x in root]
    cut = line_dedup.cut

    def counted(df):
        out = cut(df)
        stored.append(out.count())
        return out
    monkeypatch.setattr(line_dedup, "cut", counted)
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id bigint, text string").repartition(3)
    for blocks in ({}, {"BLOCK": 40, "MOST_BROADCAST": 0}):
        for name, value in blocks.items():
            monkeypatch.setattr(line_dedup, name, value)
        got = line_dedup.op7_line_dedup(docs).collect()
        assert {r.doc_id for r in got if r.kept} == set(root)
        classes = {(r.line_class, root[r.doc_id]) for r in got}
        assert len(classes) == len(set(root)) == len({c for c, _ in classes})
        assert blocks or max(stored) < 30 * len(lines)


def brute_simhash(text):
    from xxhash import xxh64_intdigest
    w = WORD.findall(lower(text))
    if not w:
        return 0
    h = [xxh64_intdigest(" ".join(w[i:i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << j for j in range(64) if 2 * sum(x >> j & 1 for x in h) > len(h))


def test_op8_against_brute_force(odd_docs):
    out = simhash.op8_simhash(odd_docs).collect()
    rows = odd_docs.collect()
    want = Counter((r.doc_id, f"{brute_simhash(r.text):016x}") for r in rows)
    assert Counter((r.doc_id, r.fingerprint) for r in out) == want
    fps = [int(r.fingerprint, 16) for r in out]
    root = list(range(len(out)))
    for _ in out:
        for i in range(len(out)):
            for j in range(i):
                if bin(fps[i] ^ fps[j]).count("1") <= 4:
                    root[i] = root[j] = min(root[i], root[j])
    for i, r in enumerate(out):
        ids = [x.doc_id for x, k in zip(out, root) if k == root[i] and x.doc_id is not None]
        assert r.component_id == min(ids, default=None)
    kept = simhash.near_dedup(odd_docs)
    assert kept.columns == odd_docs.columns and kept.count() == len(set(root))


def test_large_buckets_lose_no_link(spark):
    rng = np.random.default_rng(2)
    centre = rng.integers(0, 1 << 63, 3, dtype=np.uint64)
    fps = np.unique(np.concatenate([c ^ (np.uint64(1) << rng.integers(0, 60, 400).astype(np.uint64))
                                    ^ (np.uint64(1) << rng.integers(0, 60, 400).astype(np.uint64)) for c in centre]))
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp bigint").repartition(3)
    from barloom.llm.common import components
    sizes = {b: sorted(r["count"] for r in components(simhash.links(df, 4, block=b)).groupBy("root").count().collect()) for b in (4096, 50)}
    assert sizes[4096] == sizes[50] and sum(sizes[50]) == len(fps)


def test_op9_against_brute_force(odd_docs):
    docs = odd_docs.filter("doc_id IS NULL OR doc_id <> 8")
    out = {(r.doc_id, r.n_tokens): r for r in lm_score.lm_scores(
        docs.select("doc_id", "text", (~lm_score.training()).alias("h")), ~F.col("h"), frequent=10).collect()}
    plain = lm_score.op9_lm_score(docs).collect()
    rows = docs.collect()
    train = [zlib.crc32(b"" if r.doc_id is None else str(r.doc_id).encode()) % 5 != 1 for r in rows]
    tokens = [WORD.findall(lower(r.text)) + [None] for r in rows]
    c = Counter(w for t, ok in zip(tokens, train) if ok for w in t)
    n, v, seen, k = sum(c.values()), len(c), {}, lm_score.ORDER
    for r, ok in zip(rows, train):
        y = b"\n" * k + (r.text or "").encode()
        for i in range(k, len(y) if ok else 0):
            for j in range(k + 1):
                seen.setdefault(y[i - j:i], Counter())[y[i]] += 1
    for r, t in zip(rows, tokens):
        y, score = b"\n" * k + (r.text or "").encode(), 0.0
        for i in range(k, len(y)):
            gone = set()
            for j in range(k, -1, -1):
                f = {a: m for a, m in seen.get(y[i - j:i], {}).items() if a not in gone}
                if not f:
                    continue
                total = sum(f.values()) + len(f)
                if y[i] in f:
                    score += log10(f[y[i]] / total)
                    break
                score += log10(len(f) / total)
                gone |= f.keys()
            else:
                score -= log10(256 - len(gone))
        base = sum(log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t)
        for got in [out[r.doc_id, len(t)], *[p for p in plain if (p.doc_id, p.n_tokens) == (r.doc_id, len(t))]]:
            assert got.n_known == sum(c[w] > 0 for w in t) and got.train_tokens == n
            assert abs(got.base_score - base) < 1e-6 and abs(got.score - score) < 1e-6


def test_op9_uses_every_count(odd_docs):
    """Runs below the broadcast's share keep their counts: the scores do not depend on ``nodes``."""
    def scores(**kw):
        out = lm_score.lm_scores(odd_docs.select("doc_id", "text", (~lm_score.training()).alias("h")), ~F.col("h"), **kw)
        return sorted((r.doc_id or -1, r.n_tokens, r.score) for r in out.collect())
    whole = scores()
    for nodes in (1, 40, 3000):
        few = scores(nodes=nodes)
        assert [x[:2] for x in few] == [x[:2] for x in whole]
        assert [x[2] for x in few] == pytest.approx([x[2] for x in whole], abs=1e-6)


def test_adaptive_model_learns():
    assert lm_score.adaptive_score(b"abcd" * 50) > lm_score.adaptive_score(bytes(range(200)))


@pytest.mark.parametrize("law", ["rows", "bytes"])
def test_op10_laws(odd_docs, law):
    docs = odd_docs.filter("doc_id IS NULL OR doc_id <> 8")
    out = sharding.shard(docs, 4, law=law).collect()
    assert len(out) == docs.count()
    slots = {}
    for r in out:
        assert r["size"] == len((r.text or "").encode()) + 8 and r.text_crc32 == zlib.crc32((r.text or "").encode())
        slots.setdefault(r["shard"], []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    if law == "rows":
        assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    else:
        whole = sum(r["size"] for r in out)
        sums = Counter()
        for r in out:
            sums[r["shard"]] += r["size"]
        assert all(abs(x - whole / 4) <= max(r["size"] for r in out) for x in sums.values())


def test_hilbert_neighbours_touch(spark):
    pts = spark.range(512).selectExpr("id div 64 AS a", "id div 8 % 8 AS b", "id % 8 AS c")
    rows = pts.withColumn("h", sharding.hilbert([F.col(x) for x in "abc"], 3)).orderBy("h").collect()
    assert [r.h for r in rows] == list(range(512))
    assert all(abs(p.a - q.a) + abs(p.b - q.b) + abs(p.c - q.c) == 1 for p, q in zip(rows, rows[1:]))


def test_shards_on_disk(odd_docs, tmp_path, spark):
    sharding.write_shards(sharding.shard(odd_docs.drop("shard"), 3), str(tmp_path / "shards"))
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert back.count() == odd_docs.count() and {r["shard"] for r in back.select("shard").distinct().collect()} == {0, 1, 2}


EMPTY = {
    "op1": mixing.op1_mixing, "op2": langid.op2_language_id, "op3": licenses.op3_license_scan, "op4": exact_dedup.op4_exact_dedup,
    "op6": secrets.op6_secret_scan, "op7": line_dedup.op7_line_dedup, "op8": simhash.op8_simhash, "op9": lm_score.op9_lm_score,
    "op10": sharding.op10_sharding, "op1 rows": mixing.mixed_documents, "op4 rows": exact_dedup.exact_dedup,
    "op7 rows": line_dedup.dedup_lines, "op8 rows": simhash.near_dedup, "op10 rows": lambda d: sharding.shard(d, 3),
}


@pytest.mark.parametrize("name", EMPTY)
def test_empty_tables(no_docs, name):
    assert EMPTY[name](no_docs).collect() == []


def test_empty_benchmark(no_docs, odd_docs, odd_benchmark):
    assert decontaminate.op5_decontamination(no_docs, odd_benchmark).collect() == []
    assert not any(r.n_hit for r in decontaminate.op5_decontamination(odd_docs, odd_benchmark.limit(0)).collect())
