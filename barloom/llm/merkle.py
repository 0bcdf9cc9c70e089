"""Merkle manifest of a dataset: one root, and a proof per row that its content belongs to it.

Every row is a leaf. The leaves of a group ascend by id; while a group has
several nodes, every ``arity`` consecutive ones become the hash of their
digests, so each group ends in a subroot, and the subroots, in the order of
their groups, end in the root in the same way.

One level is one self-join: every node is sent to the computed indices of its
run (its own number XOR 1 for ``arity`` 2, the slot offsets of the run
otherwise), the equijoin on (group, index) brings each node its siblings, and
the rows of slot zero emit the parents. Nodes are numbered over the whole
table, so a group of any size, or one that holds a third of all rows, spreads
over all tasks. Levels are written tables; there are as many as the logarithm
of the largest group.

A proof is the path of (siblings before, siblings behind) from the leaf to the
root. ``verify`` folds any leaf along it.

NULL values count as such in the leaf and differ from empty ones; a NULL group
comes first; a NULL id precedes all others of its group; ids that repeat are
ordered by leaf, and rows alike in both are interchangeable. A table without
rows gives no rows. Columns named like a result or a work column (``_...``) are
replaced. A leaf hashes the whole text, so a task holds one text at a time.
"""

from __future__ import annotations

import functools
import string

from pyspark.sql import Column, DataFrame, functions as F

from barloom.llm.common import attach, numbered, ordered
from barloom.session import cut

ARITY = 8
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the concatenation."""
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """``-`` for NULL, else the UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    return digest(*map(field, values))


def no_path() -> Column:
    return F.array().cast("array<struct<before:binary,behind:binary>>")


def text_of(digests: Column) -> Column:
    """Binary digests as the hex text that hashes are made of."""
    return F.lower(F.hex(digests))


def fold(start: Column, path: Column) -> Column:
    """The hash at the end of the path."""
    return F.aggregate(path, start, lambda h, p: digest(text_of(p.before), h, text_of(p.behind)))


def path_digest(path: Column) -> Column:
    """SHA-256 of all siblings of the path in order."""
    return F.sha2(F.array_join(F.transform(path, lambda p: F.concat(text_of(p.before), text_of(p.behind))), ""), 256)


def _siblings(at: Column, n: Column, arity: int) -> Column:
    """Indices of the node's run, its own included."""
    if arity == 2:
        run = F.array(at, at.bitwiseXOR(F.lit(1)))
    else:
        slot = at % arity
        run = F.array(*[at - slot + (slot + j) % arity for j in range(arity)])
    return F.filter(run, lambda i: i < n)


def level_up(nodes: DataFrame, arity: int) -> DataFrame:
    """(g, i, before, behind): the siblings of every node of ``nodes`` (g, i, n, h)."""
    sent = nodes.select("g", F.col("i").alias("_from"), F.col("h").alias("_h"), F.explode(_siblings(F.col("i"), F.col("n"), arity)).alias("i"))
    run = nodes.select("g", "i").join(sent, ["g", "i"]).groupBy("g", "i").agg(
        F.sort_array(F.collect_list(F.struct("_from", "_h"))).alias("run"))  # at most ``arity`` entries

    def joined(keep) -> Column:
        return F.aggregate(F.filter("run", keep), F.lit(b""), lambda a, x: F.concat(a, x["_h"]))

    return run.select("g", "i", joined(lambda x: x["_from"] < F.col("i")).alias("before"), F.element_at(F.filter(
        "run", lambda x: x["_from"] == F.col("i")), 1)["_h"].alias("h"), joined(lambda x: x["_from"] > F.col("i")).alias("behind"))


def climb(nodes: DataFrame, arity: int = ARITY) -> tuple[DataFrame, DataFrame]:
    """Tops (g, h) of all groups of ``nodes`` (g, i, n, h), and (g, i, path) from every node to its top.

    A node that is a top itself has no path row.
    """
    levels, tops = [], []
    while True:
        tops.append(nodes.filter("n = 1").select("g", "h"))
        nodes = nodes.filter("n > 1")
        if nodes.isEmpty():
            break
        levels.append(cut(level_up(nodes, arity)))
        nodes = cut(nodes.select("g", "i", "n").filter(F.col("i") % arity == 0).join(levels[-1], ["g", "i"]).select(
            "g", (F.col("i") / arity).cast("bigint").alias("i"), F.ceil(F.col("n") / arity).alias("n"),
            F.unhex(digest(text_of(F.col("h")), text_of(F.col("behind")))).alias("h")))
    top = functools.reduce(DataFrame.unionByName, tops)
    paths = nodes.select("g", "i", no_path().alias("path"))
    for level in reversed(levels):
        rest = paths.select("g", F.col("i").alias("_up"), F.col("path").alias("_rest"))
        paths = (level.withColumn("_up", (F.col("i") / arity).cast("bigint")).join(rest, ["g", "_up"], "left")
                 .select("g", "i", F.concat(F.array(F.struct("before", "behind")), F.coalesce("_rest", no_path())).alias("path")))
    return top, paths


def manifest(rows: DataFrame, group: str, order: str, leaf_of: str, arity: int = ARITY) -> DataFrame:
    """``rows`` with ``subroot``, ``root`` and ``path``: the way from each row's leaf to the root.

    ``leaf_of`` names the column of leaf digests (hex). The path is the proof;
    ``fold`` checks a leaf against it.
    """
    work = ["_row", "_g", "_i", "_n", "_first", "_way"]
    rows = rows.drop("subroot", "root", "path", *work)
    rows = cut(rows.select("*", F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("")).alias("_g"),
                           F.monotonically_increasing_id().alias("_row")))
    sort = [F.col("_g"), F.col(order).asc_nulls_first(), F.col(leaf_of), F.col("_row")]
    at = cut(numbered(ordered(rows, sort), "_i").drop("_at", "_row"))
    groups = cut(at.groupBy("_g").agg(F.count("*").alias("_n"), F.min("_i").alias("_first")))
    at = cut(attach(at, groups, "_g", "_n").withColumn("_i", F.col("_i") - F.col("_first")).drop("_first"))
    tops, paths = climb(at.select(F.col("_g").alias("g"), F.col("_i").alias("i"), F.col("_n").alias("n"), F.unhex(leaf_of).alias("h")), arity)
    tops = ordered(tops, [F.col("g")])
    named = cut(numbered(tops, "i").select(F.lit("").alias("g"), F.col("g").alias("_g"), "i", "h"))
    root, ways = climb(named.select("g", "i", F.lit(named.count()).cast("bigint").alias("n"), "h"), arity)
    root = root.first()
    ways = (named.join(ways.select("i", F.col("path").alias("_way")), "i", "left").join(groups.select("_g", "_n"), "_g")
            .select("_g", "_n", text_of(F.col("h")).alias("subroot"), F.coalesce("_way", no_path()).alias("_way")))
    out = cut(at.drop("_n").join(paths.select(F.col("g").alias("_g"), F.col("i").alias("_i"), "path"), ["_g", "_i"], "left"))
    return (attach(out, cut(ways), "_g", "_n")
            .withColumns({"root": F.lit(bytes(root.h).hex() if root else None).cast("string"),
                          "path": F.concat(F.coalesce("path", no_path()), "_way")})
            .drop(*work))


def op12_merkle(docs: DataFrame) -> DataFrame:
    """Contract columns of every document; a NULL doc_id has no decimal and is never tampered with."""
    lower = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    tampered = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    leaves = docs.select("doc_id", "lang", leaf(*map(F.col, COLUMNS)).alias("leaf"),
                         F.when(tampered, leaf(*[lower if c == "text" else F.col(c) for c in COLUMNS])).alias("other"))
    out = manifest(leaves, "lang", "doc_id", "leaf").select("*", fold(F.coalesce("other", "leaf"), F.col("path")).alias("folded_root"))
    return out.select("doc_id", "leaf", "subroot", "root", path_digest(F.col("path")).alias("proof_sha256"), "folded_root",
                      (F.col("folded_root") == F.col("root")).alias("verified"))


def _sql_field(column: str) -> str:
    return f"COALESCE(CAST(strlen(CAST({column} AS VARCHAR)) AS VARCHAR) || ':' || CAST({column} AS VARCHAR), '-')"


def _sql_leaf(text: str) -> str:
    return "sha256(" + " || ".join(_sql_field(text if c == "text" else c) for c in COLUMNS) + ")"


ORACLE = f"""
WITH RECURSIVE
c AS (SELECT doc_id, COALESCE('=' || lang, '') AS g, {_sql_leaf('text')} AS leaf,
    {_sql_leaf("translate(text, '" + string.ascii_uppercase + "', '" + string.ascii_lowercase + "')")} AS other,
    list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda s: ascii(s)::BIGINT)),
      lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
        lambda x, y: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END))) AS crc
  FROM documents),
d AS (SELECT doc_id, g, leaf, CASE WHEN xor(crc, 4294967295) % 3 = 0 THEN other ELSE leaf END AS other,
    row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM c),
t AS (SELECT 0 AS level, g, i, leaf AS h, count(*) OVER (PARTITION BY g) AS n FROM d
  UNION ALL
  SELECT level + 1, g, i // 8, sha256(string_agg(h, '' ORDER BY i)), (max(n) + 7) // 8 FROM t WHERE n > 1 GROUP BY level, g, i // 8),
u AS (SELECT 0 AS level, row_number() OVER (ORDER BY g) - 1 AS i, g, h, count(*) OVER () AS n FROM t WHERE n = 1
  UNION ALL
  SELECT level + 1, i // 8, NULL, sha256(string_agg(h, '' ORDER BY i)), (max(n) + 7) // 8 FROM u WHERE n > 1 GROUP BY level, i // 8),
v AS (SELECT FALSE AS above, level, g, i, h, n FROM t UNION ALL SELECT TRUE, level, '', i, h, n FROM u),
sides AS (SELECT above, level, g, i, COALESCE(string_agg(h, '' ORDER BY i) OVER (PARTITION BY above, level, g, i // 8 ORDER BY i
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,
    COALESCE(string_agg(h, '' ORDER BY i) OVER (PARTITION BY above, level, g, i // 8 ORDER BY i
      ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS behind FROM v WHERE n > 1),
s AS (SELECT g, h, i FROM u WHERE level = 0),
w AS (SELECT d.g, d.i, above, level, before, behind FROM d JOIN sides x ON NOT above AND x.g = d.g AND x.i = d.i >> (3 * level)
  UNION ALL
  SELECT d.g, d.i, above, level, before, behind FROM d JOIN s ON s.g = d.g JOIN sides x ON above AND x.i = s.i >> (3 * level)),
p AS (SELECT g, i, string_agg(before || behind, '' ORDER BY above, level) AS proof,
    list({{'before': before, 'h': '', 'behind': behind}} ORDER BY above, level) AS way FROM w GROUP BY g, i),
f AS (SELECT d.doc_id, d.leaf, s.h AS subroot, r.h AS root, sha256(COALESCE(proof, '')) AS proof_sha256,
    list_reduce(list_prepend({{'before': '', 'h': d.other, 'behind': ''}}, COALESCE(way, [])),
      lambda a, x: {{'before': '', 'h': sha256(x.before || a.h || x.behind), 'behind': ''}}).h AS folded_root
  FROM d JOIN s ON s.g = d.g LEFT JOIN p ON p.g = d.g AND p.i = d.i CROSS JOIN (SELECT h FROM u WHERE n = 1) r)
SELECT *, folded_root = root AS verified FROM f
"""
