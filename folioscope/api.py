"""Entry points: search, ask, ask by the agent, health."""
from __future__ import annotations

import time
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

from .conf import EngineConf
from .functions import text as T
from .operators import agent, evidence, graph, planner, retrieve
from .session import checkpointing


def payload(hits: DataFrame, metadata: DataFrame | None = None) -> DataFrame:
    """Hits with a preview and, where known, section and block type."""
    rows = hits.withColumn("preview", T.preview(F.coalesce("text", F.lit(""))))
    return rows if metadata is None else rows.join(metadata.select("chunk_id", "section_path", "block_type"), "chunk_id", "left").fillna("", ["section_path", "block_type"])


def one(spark: SparkSession, query: str, k: int | None) -> DataFrame:
    if not query or not query.strip():
        raise ValueError("the query must not be empty")
    if k is not None and k < 1:
        raise ValueError("k must be at least 1")
    return spark.createDataFrame([("q1", query)], "qid string, query string")


def search(spark: SparkSession, query: str, corpus: retrieve.Corpus, k: int | None = None, conf: EngineConf = EngineConf(), metadata: DataFrame | None = None, doc_ids: list[str] | None = None) -> dict:
    """Q21: the final hits of one query with previews and timing."""
    conf = EngineConf(**{**conf.__dict__, "top_k": k or conf.top_k}).checked()
    started = time.perf_counter()
    stages = retrieve.retrieve(one(spark, query, k), corpus, conf, doc_ids)
    hits = [r.asDict() for r in payload(stages.final, metadata).drop("text").orderBy("rank").collect()]
    return {"query": query, "k": conf.top_k, "hits": hits, "timing_ms": round((time.perf_counter() - started) * 1000, 3)}


def ask(spark: SparkSession, query: str, corpus: retrieve.Corpus, generate: Callable[[str, str], str] = evidence.stub_answer, k: int | None = None, conf: EngineConf = EngineConf()) -> dict:
    """Q22: a cited answer or a refusal with its reason."""
    conf = EngineConf(**{**conf.__dict__, "top_k": k or conf.top_k}).checked()
    asked = one(spark, query, k)
    hits = retrieve.retrieve(asked, corpus, conf).final
    row = evidence.answer(asked, hits, corpus.store, generate, conf).head()
    return row.asDict(recursive=True)


def lookups(plans: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Q28: the graph look-ups of all plans: terms for definitions, algorithms for algorithms."""
    cols = ("qid", "match_reason", "anchors", "doc_ids", "section_ids")
    asks = lambda mode, q: plans.where(F.col("mode_hint") == mode).select("qid", F.coalesce(F.nullif(F.col(q), F.lit("")), "original_query").alias("query"), "doc_ids")
    return graph.lookup_terms(asks("definition", "canonical_query"), nodes, edges).select(*cols).unionByName(graph.lookup_algorithms(asks("algorithm", "original_query"), nodes, edges).select(*cols))


def ask_agent(queries: DataFrame, corpus: retrieve.Corpus, conf: EngineConf = EngineConf(), generate: Callable[[str, str], str] = evidence.stub_answer, nodes: DataFrame | None = None, edges: DataFrame | None = None) -> DataFrame:
    """Q23, Q34: ``qid, final_answer, result, refusal_reason, stop_reason, round, citations`` of all queries."""
    plans = planner.analyse(queries)
    sections = None
    if nodes is not None:
        # looked up once, not in every round
        checkpointing(queries.sparkSession)
        plans = planner.apply_lookup(plans, lookups(plans, nodes, edges)).checkpoint()
        if corpus.metadata is not None:
            sections = plans.select("qid", F.explode("candidate_section_ids").alias("section_id"))

    def fetch(active: DataFrame) -> DataFrame:
        # every question's own documents narrow its rankings before they are cut and fused
        return retrieve.retrieve_plans(active, corpus, conf, None, sections).final

    state, items = agent.run(plans, fetch, conf, normalize=corpus.normalize)
    asked = state.where("sufficient").select("qid", F.col("answer_prompt_question").alias("query"))
    given = evidence.answer(asked, items, corpus.store, generate, conf)
    given = given.select("qid", F.when(F.col("answer") != evidence.REFUSAL, F.col("answer")).alias("draft"), "citations")
    done = agent.verify(state.join(given, "qid", "left"))
    return done.select("qid", "final_answer", "result", "refusal_reason", "stop_reason", "round", "citations", "hits")


def tool_resolve_definition(spark: SparkSession, term: str, corpus: retrieve.Corpus, k: int = 5) -> dict:
    """Q24."""
    return search(spark, f"definition of {term}", corpus, k)


def tool_compare(spark: SparkSession, topic_a: str, topic_b: str, corpus: retrieve.Corpus, k: int = 5) -> dict:
    """The hits of both topics, each chunk once, the first topic's first."""
    found, seen = [], set()
    for topic in (topic_a, topic_b):
        for hit in search(spark, f"{topic} intended use-cases", corpus, k)["hits"]:
            if hit["chunk_id"] not in seen:
                seen.add(hit["chunk_id"])
                found.append(hit)
    return {"topics": [topic_a, topic_b], "hits": found}


def tool_summarize(spark: SparkSession, doc_id: str, first: int, last: int, corpus: retrieve.Corpus, k: int = 30) -> list[dict]:
    """The chunks of a page range, in order."""
    from .operators.store import pages_between

    wanted = spark.createDataFrame([(doc_id, first, last)], "doc_id string, from_page int, to_page int")
    return [r.asDict() for r in pages_between(corpus.store, wanted, k).orderBy("pos").collect()]


def health(folder: str, conf: EngineConf = EngineConf()) -> dict:
    """Whether the artefacts that the retrieval mode needs are there."""
    needs = {"chunk_store"} | ({"postings", "vectors"} if conf.retrieval_mode == "hybrid" else {"postings" if conf.vector_backend == "bm25" else "vectors"})
    missing = sorted(n for n in needs if not (Path(folder) / n).exists())
    return {"status": "degraded" if missing else "ok", "missing": missing, "retrieval_mode": conf.retrieval_mode}
