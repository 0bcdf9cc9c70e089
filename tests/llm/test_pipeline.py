import random
import re

import pytest

import corpus_pipeline as cp
from pyspark.sql import functions as F

from barloom.llm import decontaminate, langid, mixing
from barloom.session import cut


def shingles(text):
    """The five-word shingles of a text; a shorter text is one, all texts without words are alike."""
    words = re.sub("[A-Z]", lambda m: m.group().lower(), text or "").split()
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))}


def test_stage_order():
    assert [n for n, _ in cp.STAGES] == ["language_id", "near_dedup", "decontamination", "mixing", "sharding"]
    assert cp.ORACLE_SQL is None


def test_stages_agree_with_their_operators(spark, odd_docs, odd_benchmark, tmp_path):
    """Each stage keeps exactly what the operator's own result for its input says."""
    odd_benchmark.write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = odd_docs.withColumns({c: F.lit(c) for c in ("score", "lang_pred", "items", "n_words", "n_hit", "_nil", "_id", "_hash", "_letters", "node")})
    columns = docs.columns
    stages = dict(cp.STAGES)

    def own(df):
        assert df.columns == columns
        assert all(r[c] == c for r in df.collect() for c in ("score", "lang_pred", "items", "n_words", "n_hit", "_nil", "_id", "_hash", "_letters", "node"))

    def ids(df):
        return sorted((r.doc_id is None, r.doc_id or 0) for r in df.collect())

    kept = cut(stages["language_id"](spark, docs, str(tmp_path)))
    judged = {r.doc_id: r for r in langid.op2_language_id(docs).collect()}
    assert ids(kept) == sorted((r.doc_id is None, r.doc_id or 0) for r in docs.collect()
                               if r.text and judged[r.doc_id].lang_pred != "und" and judged[r.doc_id].score >= 0.3) or None in judged
    assert kept.columns == columns and not {4, 5, 6, 7} & {r.doc_id for r in kept.collect()}
    own(kept)
    near = cut(stages["near_dedup"](spark, kept, str(tmp_path)))
    own(near)
    rows = [(r.doc_id, shingles(r.text)) for r in kept.collect()]
    root = list(range(len(rows)))
    for _ in rows:
        for a in range(len(rows)):
            for b in range(a):
                x, y = rows[a][1], rows[b][1]
                if len(x & y) >= 0.8 * len(x | y):
                    root[a] = root[b] = min(root[a], root[b])
    members = {}
    for r, (i, _) in zip(root, rows):
        members.setdefault(r, []).append(i)
    stay = [min(m, key=lambda i: (i is None, i)) for m in members.values()]
    assert sorted(ids(near)) == sorted((i is None, i or 0) for i in stay)
    clean = cut(stages["decontamination"](spark, near, str(tmp_path)))
    own(clean)
    dirty = {r.doc_id for r in decontaminate.op5_decontamination(near, odd_benchmark).collect() if r.contaminated}
    assert ids(clean) == ids(near.filter(~near.doc_id.isin(list(dirty)) | near.doc_id.isNull())) and dirty
    clean = clean.select("doc_id", "text", "lang", "source", "score")
    mixed = cut(stages["mixing"](spark, clean, str(tmp_path)))
    plan = {(r.doc_id, r["size"]): r for r in mixing.mix(clean).collect()}
    copies = {}
    for r in mixed.collect():
        copies[r.doc_id] = copies.get(r.doc_id, 0) + 1
    for (doc_id, size), r in plan.items():
        whole = r.taken // size if size else 0
        assert copies.get(doc_id, 0) in (whole, whole + 1)
    last = stages["sharding"](spark, mixed, str(tmp_path)).collect()
    assert len(last) == mixed.count() and {"shard", "slot"} <= set(last[0].asDict())


@pytest.mark.parametrize("name", [n for n, _ in cp.STAGES])
def test_stages_on_empty_input(spark, no_docs, odd_benchmark, tmp_path, name):
    odd_benchmark.write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = no_docs.drop("size", "fp", "shard")
    out = dict(cp.STAGES)[name](spark, docs, str(tmp_path))
    assert out.collect() == [] and out.columns[:len(docs.columns)] == docs.columns


def test_near_dedup_loses_no_candidate_at_the_bound(spark):
    """Pairs at a similarity of 0.8 exactly that share a band are all linked."""
    from barloom.llm import near_dedup
    rng, rows = random.Random(6), []
    for k in range(2500):  # sets of 45 shingles, 40 of them common
        base = [f"w{rng.randrange(1 << 40)}" for _ in range(49)]
        other = base[:44] + [f"v{rng.randrange(1 << 40)}" for _ in range(5)]
        a, b = " ".join(base), " ".join(other)
        (x, y), _ = near_dedup.signatures([near_dedup.shingle_hashes(t.encode()) for t in (a, b)])
        if (x == y).any():
            rows += [(2 * k, a), (2 * k + 1, b)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    kept = {r.doc_id for r in cp.near_dedup(spark, docs, "").collect()}
    assert len(rows) > 4900 and kept == {i for i, _ in rows if i % 2 == 0}


def test_near_dedup_stage_drops_edited_copies(spark):
    """Against brute force: linked is what has a Jaccard similarity of 0.8 over five words, not what is nearly identical."""
    rng = random.Random(4)
    rows, words = [], [f"word{i}" for i in range(3000)]
    for k in range(30):
        base = [rng.choice(words) for _ in range(rng.randint(100, 400))]
        rows.append((10 * k, " ".join(base)))
        for j, share in enumerate((0.005, 0.01, 0.02, 0.03, 0.06), 1):
            rows.append((10 * k + j, " ".join(w if rng.random() > share else rng.choice(words) for w in base)))
    sets = {i: {tuple(t.split()[j:j + 5]) for j in range(len(t.split()) - 4)} for i, t in rows}
    root = {i: i for i, _ in rows}
    similar = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    for _ in rows:
        for a, b in similar:
            root[a] = root[b] = min(root[a], root[b])
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    kept = {r.doc_id for r in cp.near_dedup(spark, docs, "").collect()}
    assert kept == set(root.values()) and 30 < len(kept) < 120
