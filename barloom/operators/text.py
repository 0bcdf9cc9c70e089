"""Ranking and routing of text records by keywords."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from barloom.sources.ledger import unseen

# fixed values: keywords worth half a point, and the template keywords in order of preference
EDGE_KEYWORDS = ("alpha", "sharpe", "sortino", "convex", "prop firm", "overnight drift", "pead", "beta rotation",
                 "sector momentum", "positive drift")
TEMPLATES = ("post earnings announcement drift", "pead", "positive drift", "overnight drift", "beta rotation", "sector momentum",
             "prop firm convex alpha", "prop firm trading alpha", "convex alpha", "intraday and overnight")


def edge_score(text: Column, published: Column, source: Column, as_of: str, marker: str = "sharpe",
               keywords=EDGE_KEYWORDS, preferred_source: str = "SSRN") -> Column:
    """Points: twice the number after ``marker`` (1 without one), half per keyword, recency, source.

    The recency bonus falls from 1 to 0 over a year before ``as_of``; records
    without a date count as new.
    """
    t = F.lower(text)
    number = F.regexp_extract(t, marker + r"\s*([0-9.]+)", 1).try_cast("double")
    score = F.when(t.contains(marker), F.coalesce(number * 2, F.lit(1.0))).otherwise(0.0)
    for k in keywords:
        score = score + F.when(t.contains(k), 0.5).otherwise(0.0)
    age = F.datediff(F.lit(as_of).cast("date"), F.coalesce(published, F.lit(as_of).cast("date")))
    return score + F.greatest(F.lit(0.0), F.lit(1.0) - age / 365.0) + F.when(source == preferred_source, 0.2).otherwise(0.0)


def route(text: Column, templates=TEMPLATES) -> Column:
    """First template keyword the text contains, else a fallback by single words."""
    t = F.lower(text)
    out = None
    for k in templates:
        out = F.when(t.contains(k), k) if out is None else out.when(t.contains(k), k)
    return (out.when(t.contains("sector") & t.contains("momentum"), "sector momentum")
            .when(t.contains("convex"), "prop firm convex alpha").when(t.contains("prop firm"), "prop firm trading alpha")
            .when(t.contains("drift"), "positive drift").otherwise("alpha, trading"))


def union_first(parts: list[DataFrame], key: str = "id") -> DataFrame:
    """Union of result lists; for a repeated key the earliest list (then smallest row) wins."""
    out = None
    for i, p in enumerate(parts):
        one = p.withColumn("_part", F.lit(i))
        out = one if out is None else out.unionByName(one)
    cols = [c for c in parts[0].columns if c != key]
    top = out.groupBy(key).agg(F.min_by(F.struct(*cols), F.struct("_part", *cols)).alias("_s"))
    return top.select(key, *[F.col(f"_s.{c}").alias(c) for c in cols])


def daily_top(items: DataFrame, seen: DataFrame, score: Column, n: int = 5, key: str = "id", title: str = "title") -> DataFrame:
    """Best ``n`` unseen items by score, ties by title (both descending)."""
    fresh = unseen(items, seen, key).withColumn("score", score)
    return fresh.orderBy(F.round("score", 9).desc(), F.col(title).desc(), F.col(key)).limit(n)
