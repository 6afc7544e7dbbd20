"""Candidate generation, fusion and reranking for whole sets of queries."""
from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window as W, functions as F

from ..conf import EngineConf
from ..functions import text as T
from . import dense, fuse, lexical, rerank, rewrite

#: Fixed value: how deep the fused list is kept for diagnostics.
DEPTH = 60


@dataclass(frozen=True)
class Corpus:
    """What retrieval reads: the chunk store, the lexical index, the vectors (``id, vector``) and the encoder of queries."""

    store: DataFrame
    index: lexical.Index
    vectors: DataFrame
    encode: Callable[[DataFrame], DataFrame]  # (qid, query) -> (qid, vector)
    metadata: DataFrame | None = None  # chunk_id, section_path
    normalize: bool = True


def retriever(name: str) -> Callable[[Corpus, DataFrame, int], DataFrame]:
    """A single search by the name of its back end: ``(corpus, queries(qid, query), k)`` to ``qid, id, score, rank``."""
    if name == "bm25":
        return lambda corpus, queries, k: lexical.search(corpus.index, queries, k, normalize=corpus.normalize)
    if name == "faiss":
        return lambda corpus, queries, k: dense.search(corpus.encode(queries), corpus.vectors, k)
    raise ValueError(f"no retriever {name!r}; there are: bm25, faiss")


@dataclass(frozen=True)
class Stages:
    """The hits of a set of queries after each stage, and how many the reranker saw."""

    fused: DataFrame
    reranked: DataFrame
    final: DataFrame
    pool: int


def hashed_encoder(normalize: bool = True, dim: int = 64) -> Callable[[DataFrame], DataFrame]:
    def encode(queries: DataFrame) -> DataFrame:
        body = T.normalize_identifiers(F.col("query")) if normalize else F.col("query")
        return queries.select("qid", dense.hashed_vector(T.tokens(body), dim).alias("vector"))
    return encode


def corpus_of(store: DataFrame, *, normalize: bool = True, dim: int = 64, metadata: DataFrame | None = None) -> Corpus:
    """A corpus over a chunk store with the built-in encoder."""
    encode = hashed_encoder(normalize, dim)
    vectors = encode(store.select(F.col("vector_id").alias("qid"), F.col("text").alias("query"))).withColumnRenamed("qid", "id")
    return Corpus(store, lexical.build_index(store, normalize=normalize, keep=True), vectors.checkpoint(), encode, metadata, normalize)


def in_scope(hits: DataFrame, doc_ids: list[str] | None) -> DataFrame:
    """Only hits of the given documents; no documents, no filter.  Always after a rank filter, never before it."""
    wanted = list(dict.fromkeys(d.strip() for d in doc_ids or [] if d and d.strip()))
    return hits.where(F.col("doc_id").isin(wanted)) if wanted else hits


def with_places(ids: DataFrame, store: DataFrame) -> DataFrame:
    """The chunk, document and pages of vector ids; texts join after fusion, when only the best are left."""
    return ids.join(store.select(F.col("vector_id").alias("id"), *fuse.PLACE), "id").drop("id")


def candidates(requests: DataFrame, corpus: Corpus, k: int, search_k: int, doc_ids: list[str] | None = None, scopes: DataFrame | None = None) -> DataFrame:
    """Rankings ``qid, ranking_id, rank`` + hits (without texts) of ``requests(qid, ranking_id, source, text)``; ``source`` is dense or lexical.

    With ``scopes`` (``qid, doc_ids``) a question that names documents gets
    four times the candidates, of which only those of its documents count.
    """
    deep = 4 * search_k if scopes is not None else search_k
    keyed = requests.select(F.to_json(F.struct("qid", "ranking_id")).alias("rid"), "qid", "ranking_id", "source", F.col("text").alias("query"))
    asked = keyed.select(F.col("rid").alias("qid"), "query", "source")
    words = lexical.search(corpus.index, asked.where("source = 'lexical'"), deep, normalize=corpus.normalize)
    near = dense.search(corpus.encode(asked.where("source = 'dense'")), corpus.vectors, max(deep, 25))
    if scopes is not None:
        named = keyed.join(scopes.where(F.size("doc_ids") > 0), "qid").select(F.col("rid").alias("qid"), "doc_ids")
        reach = lambda df, n: df.join(named, "qid", "left").where(F.col("doc_ids").isNotNull() | (F.col("rank") <= n))
        words, near = reach(words, search_k).drop("doc_ids"), reach(near, max(search_k, 25)).drop("doc_ids")
    near = dense.spread_pages(with_places(near, corpus.store), deep)
    found = with_places(words, corpus.store).unionByName(near)
    found = in_scope(found, doc_ids)
    if scopes is not None:
        found = found.join(named, "qid", "left").where(F.col("doc_ids").isNull() | F.array_contains("doc_ids", F.col("doc_id"))).drop("doc_ids")
    found = found.withColumn("rank", F.row_number().over(W.partitionBy("qid").orderBy("rank"))).where(F.col("rank") <= k)
    return found.withColumnRenamed("qid", "rid").join(keyed.select("rid", "qid", "ranking_id"), "rid").drop("rid")


def staged(rankings: DataFrame, queries: DataFrame, corpus: Corpus, conf: EngineConf, doc_ids: list[str] | None = None, sections: DataFrame | None = None) -> Stages:
    """Fusion, reranking and the final cut over given rankings."""
    pool = max(conf.top_k, conf.retrieval_rerank_pool)
    fused = fuse.rrf(rankings, max(pool, DEPTH), conf.retrieval_rrf_k0, corpus.store)
    shown = fused.where(F.col("rank") <= pool)
    if conf.retrieval_enable_rerank:
        shown = rerank.rerank(shown, queries, corpus.index, pool, sections, corpus.metadata, normalize=corpus.normalize)
    shown = in_scope(shown, doc_ids)
    order = W.partitionBy("qid").orderBy("rank")
    final = shown.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= conf.top_k)
    return Stages(in_scope(fused, doc_ids), shown, final, pool)


def retrieve(queries: DataFrame, corpus: Corpus, conf: EngineConf = EngineConf(), doc_ids: list[str] | None = None, templates: bool = True) -> Stages:
    """Q08, Q09, Q15: hybrid or base retrieval for all of ``queries(qid, query)`` in one plan."""
    per_source = conf.top_k * conf.retrieval_candidate_multiplier
    rows = rewrite.expand(queries, fusion=conf.retrieval_query_fusion, templates=templates)
    sources = ["dense", "lexical"] if conf.retrieval_mode == "hybrid" else ["lexical" if conf.vector_backend == "bm25" else "dense"]
    requests = rows.select("qid", F.explode(F.array(*map(F.lit, sources))).alias("source"), "variant_no", F.col("variant").alias("text"))
    requests = requests.withColumn("ranking_id", F.concat_ws("-", "source", F.col("variant_no").cast("string")))
    rankings = candidates(requests, corpus, per_source, per_source * (4 if doc_ids else 1), doc_ids)
    return staged(rankings, queries, corpus, conf, doc_ids)


def retrieve_plans(plans: DataFrame, corpus: Corpus, conf: EngineConf = EngineConf(), doc_ids: list[str] | None = None, sections: DataFrame | None = None) -> Stages:
    """Q10 to Q13: retrieval by plans (``qid, canonical_query, dense_query, sparse_query, subqueries, mode_hint``).

    The dense query goes to the vectors, the sparse one to the lexical index,
    and up to two sub-queries of a comparison to both.
    """
    per_source = conf.top_k * conf.retrieval_candidate_multiplier
    subs = F.when(F.col("mode_hint") == "compare", F.slice(T.first_seen(F.col("subqueries")), 1, 2)).otherwise(F.array().cast("array<string>"))
    both = lambda s: F.array(F.struct(F.lit("dense").alias("source"), s.alias("text")), F.struct(F.lit("lexical").alias("source"), s.alias("text")))
    pairs = F.concat(
        F.array(F.struct(F.lit("dense").alias("source"), F.col("dense_query").alias("text")), F.struct(F.lit("lexical").alias("source"), F.col("sparse_query").alias("text"))),
        F.flatten(F.transform(subs, both)),
    )
    if conf.retrieval_mode != "hybrid":
        kept = "lexical" if conf.vector_backend == "bm25" else "dense"
        pairs = F.filter(pairs, lambda p: p["source"] == kept)
    requests = plans.select("qid", F.posexplode(F.array_distinct(pairs)).alias("n", "p")).select("qid", F.concat_ws("-", "p.source", F.col("n").cast("string")).alias("ranking_id"), "p.source", "p.text")
    scopes = plans.select("qid", "doc_ids") if "doc_ids" in plans.columns else None
    rankings = candidates(requests, corpus, per_source, per_source * (4 if doc_ids else 1), doc_ids, scopes)
    queries = plans.select("qid", F.col("canonical_query").alias("query"))
    return staged(rankings, queries, corpus, conf, doc_ids, sections)
