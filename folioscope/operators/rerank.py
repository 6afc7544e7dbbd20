"""Gated reranking of fused hits."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import text as T
from . import fuse, lexical, rewrite

# Weights of prior, lexical score and anchors for each kind of query; of the section prior; the most that is promoted.
WEIGHTS = {"definition": (0.35, 0.45, 0.20), "algorithm": (0.45, 0.20, 0.35), "compare": (0.60, 0.30, 0.10), "general": (0.70, 0.20, 0.10)}
SECTION_WEIGHT, SECTION_GATE = 0.18, 0.7
MOST = 8


def gate(mode: Column, overlap: Column, lexical_norm: Column) -> Column:
    """Whether a hit may be promoted."""
    return (
        F.when(mode == "definition", (overlap >= 1) | (lexical_norm >= 0.55))
        .when(mode == "algorithm", (overlap >= 2) | ((overlap >= 1) & (lexical_norm >= 0.60)))
        .when(mode == "compare", (overlap >= 1) & (lexical_norm >= 0.65))
        .otherwise((overlap >= 2) | (lexical_norm >= 0.70))
    )


def section_prior(hits: DataFrame, sections: DataFrame, metadata: DataFrame) -> DataFrame:
    """``qid, chunk_id, section`` (0 to 1): how well a hit's section fits the candidate ``sections(qid, section_id)`` of its query."""
    wanted = sections.select("qid", T.section_of_id(F.col("section_id")).alias("s")).select("qid", F.col("s.doc_id").alias("doc_id"), T.normalize_section_path(F.col("s.path")).alias("wanted"))
    wanted = wanted.where((F.col("doc_id") != "") & (F.col("wanted") != "")).distinct()
    own = hits.select("qid", "chunk_id", "doc_id").join(metadata.select("chunk_id", T.normalize_section_path(F.coalesce("section_path", F.lit(""))).alias("path")), "chunk_id")
    p, w = F.col("path"), F.col("wanted")
    fit = F.when(p == w, 1.0).when(p.startswith(w) | w.startswith(p), 0.7).when(p.contains(w) | w.contains(p), 0.45).otherwise(0.0)
    return own.where(p != "").join(wanted, ["qid", "doc_id"]).groupBy("qid", "chunk_id").agg(F.max(fit).alias("section"))


def rerank(hits: DataFrame, queries: DataFrame, index: lexical.Index, top_k: int, sections: DataFrame | None = None, metadata: DataFrame | None = None, *, normalize: bool = True) -> DataFrame:
    """Q14: ``hits`` (fused, with ``rank``) in a new order: at most ``min(8, top_k // 2)`` that pass the gate come first, the others keep their order.

    Scores stay those of the fusion.  All norms of a query are windows over the
    same partitioning (W04 to W06), so they share one shuffle; the hits are
    already bounded per query by the fusion's depth.
    """
    join = T.normalize_identifiers if normalize else (lambda c: c)
    asked = queries.select("qid", join(T.strip(F.col("query"))).alias("query"))
    asked = asked.withColumn("mode", rewrite.mode(F.col("query")))
    asked = asked.withColumn("anchors", rewrite.anchors(F.col("query"), F.col("mode")))
    rows = hits.join(asked, "qid")
    scored = lexical.score_texts(index, rows.select("qid", F.col("chunk_id").alias("item"), "query", F.coalesce("text", F.lit("")).alias("text")), normalize=normalize)
    rows = rows.join(scored.select("qid", F.col("item").alias("chunk_id"), F.col("score").alias("bm25")), ["qid", "chunk_id"])
    if sections is None:
        rows = rows.withColumn("section", F.lit(0.0))
    else:
        rows = rows.join(section_prior(hits, sections, metadata), ["qid", "chunk_id"], "left").fillna({"section": 0.0})
    # a column of its own: an Arrow UDF cannot stand inside an array function
    rows = rows.withColumn("_body", F.lower(join(F.coalesce("text", F.lit("")))))
    rows = rows.withColumn("overlap", rewrite.anchor_overlap(F.col("anchors"), F.col("_body")))
    all_of = W.partitionBy("qid")
    prior = fuse.minmax(F.col("score"), all_of)
    flat = F.max("score").over(all_of) <= F.min("score").over(all_of)
    prior = F.when(flat, fuse.rank_prior(F.col("rank"), F.count(F.lit(1)).over(all_of))).otherwise(prior)
    rows = rows.withColumns({
        "prior_norm": prior,
        "bm25_norm": fuse.minmax(F.col("bm25"), all_of),
        "anchor_norm": F.when(F.max("overlap").over(all_of) > 0, F.col("overlap") / F.max("overlap").over(all_of)).otherwise(0.0),
        "section_on": F.max("section").over(all_of) > 0,
    })
    weights = F.create_map(*[x for m, w in WEIGHTS.items() for x in (F.lit(m), F.array(*map(F.lit, w)))])[F.col("mode")]
    score = weights[0] * F.col("prior_norm") + weights[1] * F.col("bm25_norm") + weights[2] * F.col("anchor_norm")
    score = score + F.when(F.col("section_on"), SECTION_WEIGHT * F.col("section")).otherwise(0.0)
    passes = gate(F.col("mode"), F.col("overlap"), F.col("bm25_norm")) | (F.col("section") >= SECTION_GATE)
    rows = rows.withColumns({"promotion": F.round(score, 9), "passes": passes})
    place = F.row_number().over(all_of.orderBy(F.desc("passes"), F.desc("promotion"), "rank", "doc_id", "start_page", "chunk_id"))
    rows = rows.withColumn("place", F.when(F.col("passes"), place))
    first = F.when(F.col("place") <= min(MOST, top_k // 2), F.col("place"))
    final = F.row_number().over(all_of.orderBy(first.isNull(), first, "rank"))
    rows = rows.withColumn("new_rank", final).where(F.col("new_rank") <= top_k)
    keep = ["qid", "chunk_id", "doc_id", "start_page", "end_page", "text", "score"]
    return rows.select(*keep, F.col("rank").alias("fused_rank"), F.col("new_rank").alias("rank"), first.isNotNull().alias("promoted"), "promotion", F.col("section_on").alias("section_prior_applied"))
