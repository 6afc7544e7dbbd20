"""Rank fusion and rank-based norms."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

PLACE = ("chunk_id", "doc_id", "start_page", "end_page")
HIT = (*PLACE, "text")


def ranked(hits: DataFrame, *tie: str) -> DataFrame:
    """``rank`` from 1 inside every ranking of a query, by score."""
    return hits.withColumn("rank", F.row_number().over(W.partitionBy("qid", "ranking_id").orderBy(F.desc("score"), *tie)))


def rrf(rankings: DataFrame, k: int, k0: int = 60, texts: DataFrame | None = None) -> DataFrame:
    """Reciprocal rank fusion of ``qid, ranking_id, rank`` + hit columns: ``qid``, hit, ``score, rank``.

    A chunk gets 1 / (k0 + rank) from every ranking it stands in.  The row that
    represents it is the first by document, page and chunk, its text any that
    is not null (from ``texts`` with ``chunk_id, text``, else from its rows);
    ties of the score go the same way.  One shuffle by (query,
    chunk) with partial sums, one by query with the rank filter before it; only
    ids travel, and texts join when the ``k`` best are left.
    """
    if k0 <= 0:
        raise ValueError("k0 must be positive")
    key = F.struct("doc_id", "start_page", "chunk_id")
    fused = rankings.groupBy("qid", "chunk_id").agg(
        F.round(F.sum(1.0 / (k0 + F.col("rank"))), 12).alias("score"),
        F.min(F.struct(key.alias("key"), *[F.col(c).alias(f"_{c}") for c in HIT[1:4]])).alias("_best"),
    )
    fused = fused.select("qid", "chunk_id", *[F.col(f"_best._{c}").alias(c) for c in HIT[1:4]], "score")
    order = W.partitionBy("qid").orderBy(F.desc("score"), "doc_id", "start_page", "chunk_id")
    best = fused.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    on = ["qid", "chunk_id"] if texts is None else ["chunk_id"]
    texts = (rankings if texts is None else texts).where(F.col("text").isNotNull()).select(*on, "text")
    # first which chunks are asked for, then one text of each: no text is shuffled that no list shows
    wanted = texts.join(best.select(*on).distinct(), on, "left_semi").groupBy(*on).agg(F.max("text").alias("text"))
    return best.join(wanted, on, "left").select("qid", *HIT, "score", "rank")


def minmax(c: Column, over) -> Column:
    """Scaled to 0..1 within the window's partition; all 0 if all are equal."""
    low, high = F.min(c).over(over), F.max(c).over(over)
    return F.when(high > low, (c - low) / (high - low)).otherwise(0.0)


def rank_prior(rank: Column, n: Column) -> Column:
    """1 for the first place down to 0 for the last."""
    return F.when(n > 1, 1 - (rank - 1) / (n - 1)).otherwise(1.0)


def first_of(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of every key in the given order."""
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")
