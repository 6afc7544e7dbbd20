"""Queries over the supplied tables, one or more for every operator, and their SQL.

The tables stand for the engine's datasets: ``documents`` for pages (a
``doc_ref`` is a document), ``chunk_hits`` for rankings and for the chunk
store, ``structured_blocks`` for chunks with sections, ``questions`` and
``answers`` for themselves, ``embeddings`` for vectors, ``events`` for traces.
"""
from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from .. import api
from ..conf import EngineConf
from ..functions import text as T
from ..operators import agent, chunk, clean, dense, evalkit, evidence, fuse, graph, lexical, manifest, planner, reports, rerank, retrieve, rewrite, store, trace
from ..session import checkpointing
from ..sources.tables import table
from ..streaming import pages as streaming
from . import graph_oracles, oracles, pieces
from .datasets import chunk_store, chunks_of_hits, fused, hits, pages, pair_answers, questions, search_set, sectioned_chunks, vectors

Query = Callable[[SparkSession, str], DataFrame]
CONF = EngineConf()
KS = [1, 3, 5, 8]


# ---- text functions ---------------------------------------------------------------------------------------

def token_stats(s, d):
    rows = table(s, d, "documents").select("doc_id", F.explode(T.tokens(F.col("text"))).alias("term")).groupBy("term", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    return rows.groupBy("term").agg(F.sum("n").alias("tf"), F.count(F.lit(1)).alias("df"))


def technical_tokens(s, d):
    return questions(s, d).select("qid", F.explode(T.technical_tokens(F.col("question"))).alias("token")).groupBy("qid", "token").agg(F.count(F.lit(1)).alias("n"))


def acronym_counts(s, d):
    rows = table(s, d, "documents").select(F.explode(T.acronyms(F.regexp_replace("text", r"[^\x21-\x7e]+", " "))).alias("acronym"))
    return rows.groupBy("acronym").agg(F.count(F.lit(1)).alias("n"))


def token_windows(s, d):
    rows = table(s, d, "documents").select("doc_id", F.posexplode(T.token_windows(F.regexp_replace("text", r"[^\x21-\x7e]+", " "), 320, 64)).alias("i", "w"))
    return rows.select("doc_id", "i", F.md5("w").alias("digest"))


def char_windows(s, d):
    rows = table(s, d, "documents").select("doc_id", F.posexplode(T.char_windows(F.regexp_replace("text", r"[^\x21-\x7e]+", "_"), 2200, 440)).alias("i", "w"))
    return rows.select("doc_id", "i", F.length("w").alias("n"), F.md5("w").alias("digest"))


def sentence_counts(s, d):
    return table(s, d, "documents").select("doc_id", F.size(T.sentences(F.regexp_replace(F.coalesce("text", F.lit("")), r"[^\x21-\x7e]+", " "))).alias("n"))


def approx_token_counts(s, d):
    return table(s, d, "documents").select("doc_id", T.approx_tokens(F.regexp_replace(F.coalesce("text", F.lit("")), r"[^\x21-\x7e]+", " ")).alias("n"))


# The five above, enforced_answers and answer_metrics see a text of printable ASCII, as their SQL does; these see it as stored.

def acronym_counts_whole(s, d):
    rows = table(s, d, "documents").select(F.explode(T.acronyms(F.col("text"))).alias("acronym"))
    return rows.groupBy("acronym").agg(F.count(F.lit(1)).alias("n"))


def token_windows_whole(s, d):
    rows = table(s, d, "documents").select("doc_id", F.posexplode(T.token_windows(F.col("text"), 320, 64)).alias("i", "w"))
    return rows.select("doc_id", "i", F.md5("w").alias("digest"))


def char_windows_whole(s, d):
    rows = table(s, d, "documents").select("doc_id", F.posexplode(T.char_windows(F.col("text"), 2200, 440)).alias("i", "w"))
    return rows.select("doc_id", "i", F.length("w").alias("n"), F.md5("w").alias("digest"))


def sentence_counts_whole(s, d):
    return table(s, d, "documents").select("doc_id", F.size(T.sentences(F.coalesce("text", F.lit("")))).alias("n"))


def approx_token_counts_whole(s, d):
    return table(s, d, "documents").select("doc_id", T.approx_tokens(F.coalesce("text", F.lit(""))).alias("n"))


def dehyphenated(s, d):
    return table(s, d, "documents").select("doc_id", F.md5(T.dehyphenate(F.col("text"))).alias("digest"))


def canon_lines(s, d):
    rows = table(s, d, "documents").select(F.explode(F.split("text", "\n")).alias("x")).where(F.col("x").rlike(r"^[\x20-\x7e]*\z"))
    return rows.groupBy(T.canon_line(F.col("x")).alias("line")).agg(F.count(F.lit(1)).alias("n"))


def canon_lines_whole(s, d):
    """All lines; :func:`canon_lines` is the part in plain ASCII that SQL can follow."""
    rows = table(s, d, "documents").select(F.explode(F.split("text", "\n")).alias("x"))
    return rows.groupBy(T.canon_line(F.col("x")).alias("line")).agg(F.count(F.lit(1)).alias("n"))


def page_number_lines(s, d):
    lines = F.split("text", "\n")
    rows = table(s, d, "documents").where("text is not null").select("doc_id", (F.size(lines) - F.size(T.drop_page_numbers(lines))).alias("n"))
    return rows


def normalized_terms(s, d):
    return sectioned_chunks(s, d).where("section_path is not null").groupBy(T.normalize_term(F.col("section_path")).alias("term")).agg(F.count(F.lit(1)).alias("n"))


def section_titles(s, d):
    rows = sectioned_chunks(s, d).where("section_path is not null").select(T.path_parts(F.col("section_path")).alias("p"))
    leaf = T.leaf_title(F.col("p"))
    return rows.groupBy(F.size("p").alias("depth"), leaf.alias("leaf"), T.strip_section_number(leaf).alias("title")).agg(F.count(F.lit(1)).alias("n"))


def previews(s, d):
    return chunks_of_hits(s, d).where(F.col("text").rlike(r"^[\x0a\x20-\x7e]*\z")).select("chunk_id", T.preview(F.col("text"), 80).alias("preview"))


def previews_whole(s, d):
    """All chunks; :func:`previews` is the part in plain ASCII that SQL can follow."""
    return chunks_of_hits(s, d).select("chunk_id", T.preview(F.col("text"), 80).alias("preview"))


def topic_tokens(s, d):
    return questions(s, d).select("qid", T.topic_token(F.col("question")).alias("token"))


def slugs(s, d):
    return questions(s, d).select("qid", T.slug(F.col("question")).alias("slug"))


def json_objects(s, d):
    return table(s, d, "baseline_results").select("pair_id", T.json_object(F.col("stdout")).alias("object")).distinct()


def identifiers(s, d):
    return table(s, d, "documents").select("doc_id", F.md5(T.normalize_identifiers(F.col("text"))).alias("digest"))


def markdown_texts(s, d):
    return table(s, d, "documents").select("doc_id", F.md5(T.markdown_to_text(F.coalesce("text", F.lit("")))).alias("digest"))


def layout_sanitized(s, d):
    return table(s, d, "documents").select("doc_id", F.length(T.sanitize_layout(F.coalesce("text", F.lit("")))).alias("n"))


# ---- cleaning and chunking ----------------------------------------------------------------------------------

def boilerplate_lines(s, d):
    return clean.boilerplate(pages(s, d))


def clean_pages(s, d):
    return clean.clean_pages(pages(s, d)).select("page_id", F.length("text_clean").alias("n"), F.md5("text_clean").alias("digest"))


def chunk_v1(s, d):
    return chunk.chunk_pages(clean.clean_pages(pages(s, d)), "v1").select("chunk_id", "doc_id", "start_page", "char_len", "approx_tokens")


def chunk_v2(s, d):
    rows = clean.clean_pages(pages(s, d)).withColumn("markdown", F.col("text"))
    return chunk.chunk_pages(rows, "v2").select("chunk_id", "doc_id", "start_page", "char_len", "block_type", "section_path")


def page_coverage(s, d):
    rows = pages(s, d)
    expected = rows.groupBy("doc_id").agg(F.max("page_number").alias("n_pages"))
    out = evalkit.page_coverage(rows, expected)
    return out.select("doc_id", "n_pages", "n", F.size("missing").alias("n_missing"), F.size("duplicates").alias("n_duplicates"), "ok")


def numbered_store(s, d):
    return chunk_store(s, d).select("vector_id", "chunk_id", "doc_id", "start_page")


def embedding_texts(s, d):
    rows = sectioned_chunks(s, d).where(F.col("text").rlike(r"^[\x0a\x20-\x7e]*\z"))
    return rows.select("chunk_id", F.md5(T.embedding_text(F.col("doc_id"), F.col("section_path"), F.col("text"))).alias("digest"))


def embedding_texts_whole(s, d):
    """All blocks; :func:`embedding_texts` is the part in plain ASCII that SQL can follow."""
    return sectioned_chunks(s, d).select("chunk_id", F.md5(T.embedding_text(F.col("doc_id"), F.col("section_path"), F.col("text"))).alias("digest"))


def pages_between(s, d):
    rows = chunks_of_hits(s, d)
    wanted = rows.select("doc_id").distinct().select("doc_id", F.lit(2).alias("from_page"), F.lit(4).alias("to_page"))
    return store.pages_between(rows, wanted, 30).select("doc_id", "chunk_id", "pos")


# ---- indexes and search -----------------------------------------------------------------------------------

def index_terms(s, d, normalize: bool = False):
    t = lexical.build_index(chunk_store(s, d), normalize=normalize).terms
    return t.select("term", "df", F.round("idf", 9).alias("idf"))


def index_corpus(s, d, normalize: bool = False):
    c = lexical.build_index(chunk_store(s, d), normalize=normalize).corpus
    return c.select("n_docs", F.round("avgdl", 9).alias("avgdl"))


def bm25_topk(s, d, normalize: bool = False):
    """Flagship: BM25 over the whole chunk store."""
    chunks = chunk_store(s, d)
    found = lexical.search(lexical.build_index(chunks, normalize=normalize, keep=True), search_set(s, d), 8, normalize=normalize)
    return found.join(chunks.select(F.col("vector_id").alias("id"), "chunk_id"), "id").select("qid", "chunk_id", F.round("score", 6).alias("score"), "rank")


def bm25_score_texts(s, d, normalize: bool = False):
    index = lexical.build_index(chunk_store(s, d), normalize=normalize, keep=True)
    rows = fused(s, d, 20).join(search_set(s, d), "qid").select("qid", F.col("chunk_id").alias("item"), "query", F.coalesce("text", F.lit("")).alias("text"))
    return lexical.score_texts(index, rows, normalize=normalize).select("qid", F.col("item").alias("chunk_id"), F.round("score", 6).alias("score"))


# index_terms to bm25_score_texts, rerank_hits and miss_causes leave identifiers as they are spelled (T05), since SQL cannot join them; these do the whole job.

def index_terms_whole(s, d):
    return index_terms(s, d, normalize=True)


def index_corpus_whole(s, d):
    return index_corpus(s, d, normalize=True)


def bm25_topk_whole(s, d):
    return bm25_topk(s, d, normalize=True)


def bm25_score_texts_whole(s, d):
    return bm25_score_texts(s, d, normalize=True)


def rerank_hits_whole(s, d):
    return rerank_hits(s, d, normalize=True)


def miss_causes_whole(s, d):
    return miss_causes(s, d, normalize=True)


def dense_topk(s, d):
    v = vectors(s, d)
    found = dense.search(v.where("id % 100 = 0").select(F.col("id").alias("qid"), "vector"), v, 10)
    return found.select("qid", "id", F.round("score", 6).alias("score"), "rank")


def page_diverse_topk(s, d):
    v = vectors(s, d)
    found = dense.search(v.where("id % 100 = 0").select(F.col("id").alias("qid"), "vector"), v, 25)
    page = v.select("id", F.lit("d").alias("doc_id"), F.col("label").alias("start_page"), F.col("label").alias("end_page"))
    return dense.spread_pages(found.join(page, "id"), 8).select("qid", "id", "rank")


def normalized_vectors(s, d):
    return vectors(s, d).select("id", F.round(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x), 6).alias("norm"), F.round(F.get("vector", F.lit(0)), 6).alias("first"))


def rank_in_ranking(s, d):
    return fuse.ranked(hits(s, d), "chunk_id", "hit_id").select("hit_id", "qid", "ranking_id", F.col("rank").alias("place"))


def rrf_fuse(s, d):
    return fused(s, d).select("qid", "chunk_id", "doc_id", "start_page", F.round("score", 9).alias("score"), "rank")


def rank_norms(s, d):
    over = W.partitionBy("qid")
    rows = fused(s, d, 40)
    return rows.select("qid", "chunk_id", F.round(fuse.minmax(F.col("score"), over), 6).alias("minmax"), F.round(fuse.rank_prior(F.col("rank"), F.count(F.lit(1)).over(over)), 6).alias("prior"))


def doc_filter(s, d):
    """P09 after the rank filter: the hits of one document among the fused."""
    return retrieve.in_scope(fused(s, d, 40), ["CRB.HB.100"]).select("qid", "chunk_id", "rank")


def query_modes(s, d):
    q = F.col("question")
    return questions(s, d).select("qid", rewrite.mode(q).alias("mode"), rewrite.tool_mode(q).alias("tool_mode"))


def compare_topics(s, d):
    t = questions(s, d).select("qid", rewrite.compare_topics(F.col("question")).alias("t")).where("t is not null")
    return t.select("qid", F.col("t.a").alias("topic_a"), F.col("t.b").alias("topic_b"))


def definition_terms(s, d):
    return questions(s, d).select("qid", rewrite.definition_term(F.col("question")).alias("term")).where("term is not null")


def query_variants(s, d):
    rows = rewrite.expand(questions(s, d).select("qid", F.col("question").alias("query")))
    return rows.select("qid", "mode", "variant_no", "variant")


def query_anchors(s, d):
    q = F.col("question")
    return questions(s, d).select("qid", F.explode(rewrite.anchors(q, rewrite.mode(q))).alias("anchor"))


def anchor_spans(s, d):
    return questions(s, d).select("qid", F.explode(rewrite.protected_spans(F.col("question"))).alias("span"))


def corpus(s, d, normalize: bool = True) -> retrieve.Corpus:
    chunks = chunk_store(s, d)
    return retrieve.corpus_of(chunks, normalize=normalize, metadata=chunks.select("chunk_id", F.col("doc_id").alias("section_path")))


def rerank_hits(s, d, normalize: bool = False):
    """Gated reranking of the fused hits of all questions."""
    index = lexical.build_index(chunk_store(s, d), normalize=normalize, keep=True)
    asked = questions(s, d).select("qid", F.col("question").alias("query"))
    out = rerank.rerank(fused(s, d, 40), asked, index, 40, normalize=normalize)
    return out.select("qid", "chunk_id", "fused_rank", "rank", "promoted", F.round("promotion", 6).alias("promotion"))


def hybrid_topk(s, d):
    """Variants, both searches, fusion, reranking, final cut."""
    out = retrieve.retrieve(search_set(s, d), corpus(s, d), CONF)
    return out.final.select("qid", "chunk_id", "doc_id", "rank", F.round("score", 9).alias("score"))


def base_topk(s, d):
    out = retrieve.retrieve(search_set(s, d), corpus(s, d), EngineConf(retrieval_mode="base", vector_backend="bm25"))
    return out.final.select("qid", "chunk_id", "doc_id", "rank", F.round("score", 9).alias("score"))


def query_plans(s, d):
    return planner.analyse(questions(s, d).select("qid", F.col("question").alias("query"))).select("qid", "mode_hint", "canonical_query", "sparse_query", "dense_query", "confidence", "rewrite_needed")


def planned_topk(s, d):
    out = retrieve.retrieve_plans(planner.analyse(search_set(s, d)), corpus(s, d), CONF)
    return out.final.select("qid", "chunk_id", "doc_id", "rank")


# ---- evidence and answers ------------------------------------------------------------------------------------

def best_hits(s, d):
    return evidence.best_hits(hits(s, d)).select("qid", "chunk_id", "score")


def context_budget(s, d):
    rows = fused(s, d, 40).withColumn("pos", F.col("rank"))
    return evidence.within_budget(rows, 6, 1500).select("qid", "chunk_id", "pos")


def neighbor_expand(s, d):
    primary = fused(s, d, 3)
    near = store.neighbours(primary, chunk_store(s, d), 1)
    return near.select("qid", "of", "delta", "chunk_id", F.round("score", 9).alias("score"))


def evidence_select(s, d):
    rows = fused(s, d, 40)
    return evidence.select_evidence(rows, chunk_store(s, d), CONF).select("qid", "pos", "chunk_id")


def evidence_contexts(s, d):
    out = evidence.contexts(evidence.select_evidence(fused(s, d, 40), None, CONF))
    return out.select("qid", F.size("citations").alias("n"), F.md5("context").alias("digest"))


def citation_keys(s, d):
    return pair_answers(s, d).select("pair_id", F.explode(T.citation_keys(F.col("answer"))).alias("key"))


def answer_problems(s, d):
    return evidence.check_answers(pair_answers(s, d).where("answer is not null")).select("pair_id", "problem")


def enforced_answers(s, d):
    rows = pair_answers(s, d).where("answer is not null and citations is not null").withColumn("draft", F.regexp_replace("answer", r"[^\x21-\x7e]+", " "))
    return evidence.enforce(rows.drop("answer")).select("pair_id", (F.col("answer") == evidence.REFUSAL).alias("refused"), F.size("used").alias("n_used"))


def answer_metrics(s, d):
    rows = pair_answers(s, d).where("answerable is not null").withColumn("answer", F.regexp_replace(F.coalesce("answer", F.lit("")), r"[^\x21-\x7e]+", " "))
    return evalkit.answer_metrics(rows).select("pair_id", "is_refusal", "citation_count", "citation_presence_ok", F.round("inline_citation_sentence_rate", 6).alias("rate"), "refusal_accuracy")


def enforced_answers_whole(s, d):
    """All answers; one without text, or that cites without citations, is refused."""
    rows = pair_answers(s, d).withColumnRenamed("answer", "draft")
    return evidence.enforce(rows).select("pair_id", (F.col("answer") == evidence.REFUSAL).alias("refused"), F.size("used").alias("n_used"))


def answer_metrics_whole(s, d):
    """All answers; where it is unknown whether the question can be answered, so is the accuracy of refusing."""
    out = evalkit.answer_metrics(pair_answers(s, d))
    return out.select("pair_id", "is_refusal", "citation_count", "citation_presence_ok", F.round("inline_citation_sentence_rate", 6).alias("rate"), "refusal_accuracy")


def answers_end_to_end(s, d):
    asked = questions(s, d).select("qid", F.col("question").alias("query"))
    out = evidence.answer(asked, fused(s, d, 8), chunk_store(s, d))
    return out.select("qid", "source", "refusal_reason", F.size("citations").alias("n_citations"))


def algorithm_answers(s, d):
    items = evidence.select_evidence(fused(s, d, 8), None, CONF)
    return evidence.algorithm_fallback(items, questions(s, d).select("qid", F.col("question").alias("query")))


def comparison_answers(s, d):
    out = evidence.comparison_fallback(fused(s, d, 8), questions(s, d).select("qid", F.col("question").alias("query")))
    return out.select("qid", "draft")


# ---- graph -----------------------------------------------------------------------------------------------------

def algorithm_headers(s, d):
    rows = chunks_of_hits(s, d).select("chunk_id", F.explode(graph.algorithm_headers(F.col("text"))).alias("h"))
    return rows.groupBy("chunk_id", F.col("h.number").alias("number")).agg(F.count(F.lit(1)).alias("n"))


def mentioned_algorithms(s, d):
    return chunks_of_hits(s, d).select("chunk_id", F.explode(graph.mentioned_algorithms(F.col("text"))).alias("name"))


def phrase_terms(s, d):
    rows = sectioned_chunks(s, d).select(F.explode(graph.phrase_terms(F.coalesce("text", F.lit("")))).alias("phrase"))
    return rows.groupBy("phrase").agg(F.count(F.lit(1)).alias("n"))


def section_edges(s, d):
    return graph.section_edges(sectioned_chunks(s, d))


def document_spans(s, d):
    rows = sectioned_chunks(s, d)
    return rows.groupBy("doc_id").agg(F.min("start_page").alias("start_page"), F.max("end_page").alias("end_page"))


def algorithm_anchors(s, d):
    return graph.anchors(sectioned_chunks(s, d)).select("doc_id", "number", "section_id", "start_page")


def graph_nodes(s, d):
    return graph.build(sectioned_chunks(s, d))[0].groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("node_id").alias("n_ids"))


def graph_edges(s, d):
    return graph.build(sectioned_chunks(s, d))[1].groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("edge_id").alias("n_ids"))


def graph_terms(s, d):
    rows = sectioned_chunks(s, d)
    checkpointing(s)
    candidates = graph.term_rows(rows, graph.anchors(rows)).checkpoint()
    out = graph.term_stats(candidates, graph.term_sections(candidates))
    return out.select("term", "display_name", "term_type", "definition_strength", F.col("n_sections").cast("int").alias("n_sections"), F.col("n_docs").cast("int").alias("n_docs"))


def built_graph(s, d):
    checkpointing(s)
    return tuple(x.checkpoint() for x in graph.build(sectioned_chunks(s, d)))


def term_lookup(s, d):
    nodes, edges = built_graph(s, d)
    asked = s.createDataFrame([(p, p) for p in graph.PHRASES], "qid string, query string")
    return graph.lookup_terms(asked, nodes, edges).select("qid", "match_reason", F.size("doc_ids").alias("n_docs"), F.size("section_ids").alias("n_sections"))


def algorithm_lookup(s, d):
    nodes, edges = built_graph(s, d)
    asked = questions(s, d).where(F.col("question").rlike(rewrite.ALGORITHM_NUMBER)).select("qid", F.col("question").alias("query"))
    return graph.lookup_algorithms(asked, nodes, edges).select("qid", "match_reason", F.size("doc_ids").alias("n_docs"), "ambiguous")


def graph_export(s, d):
    n, e = graph.export_rows(*graph.build(sectioned_chunks(s, d)))
    return n.select(F.lit("node").alias("kind"), F.col("`node_id:ID`").alias("id")).unionByName(e.select(F.lit("edge").alias("kind"), F.col("edge_id").alias("id")))


# ---- agent, traces -----------------------------------------------------------------------------------------------

def evidence_assessment(s, d):
    plans = planner.analyse(questions(s, d).select("qid", F.col("question").alias("query")))
    out = agent.assess(plans, fused(s, d, 8), CONF)
    return out.select("qid", F.array_join("reasons", ",").alias("reasons"), "sufficient", "hits", "doc_diversity")


def agent_answers(s, d):
    out = api.ask_agent(search_set(s, d), corpus(s, d), CONF)
    return out.select("qid", "result", "refusal_reason", "stop_reason", "round")


def agent_answers_graph(s, d):
    """The agent over the parsed blocks, with look-ups in their graph and the sections it names."""
    blocks = store.build_store(sectioned_chunks(s, d))
    corpus = retrieve.corpus_of(blocks.select("vector_id", "chunk_id", "doc_id", "start_page", "end_page", "text"), metadata=blocks.select("chunk_id", "section_path"))
    nodes, edges = built_graph(s, d)
    out = api.ask_agent(search_set(s, d), corpus, CONF, nodes=nodes, edges=edges)
    return out.select("qid", "result", "refusal_reason", "stop_reason", "round")


def trace_events(s, d):
    kind = F.when(F.col("event_type") == "purchase", "step").otherwise(F.col("event_type"))
    node = F.when(F.col("event_type") == "purchase", F.concat(F.lit("n"), (F.col("event_id") % 7).cast("string")))
    payload = F.create_map(F.lit("value"), F.col("value").cast("string"))
    return table(s, d, "events").select(F.col("user_id").alias("run_id"), F.col("event_id").alias("seq"), kind.alias("type"), node.alias("node"), payload.alias("payload"))


def trace_carry_forward(s, d):
    return trace.carry_node(trace_events(s, d)).select("run_id", "seq", "node", "visit")


def trace_by_node(s, d):
    return trace.by_node(trace_events(s, d)).select("run_id", "visit", "node", "node_visit", F.size("event_types").alias("n_events"))


def trace_latest(s, d):
    out = trace.latest(trace_events(s, d), "error")
    return out.select("run_id", "seq", F.col("payload")["value"].cast("double").alias("value"))


def windowed_events(s, d):
    out = streaming.event_counts(table(s, d, "events"))
    return out.select("start", "event_type", "n", F.round("total", 4).alias("total"))


# ---- evaluation, manifest ------------------------------------------------------------------------------------------

def gold_overlap(s, d):
    q = questions(s, d)
    return evalkit.hits_on_gold(fused(s, d, 40), evalkit.gold_spans(q)).select("qid", "chunk_id", "rank", "span")


def gold_first_ranks(s, d):
    q = questions(s, d)
    return evalkit.gold_ranks(fused(s, d, 40), evalkit.gold_spans(q), "tolerant", 1).select("qid", "first_rank")


def retrieval_metrics(s, d):
    return evalkit.metrics(fused(s, d, 8), questions(s, d), KS)


def mean_retrieval_metrics(s, d):
    return evalkit.mean_metrics(retrieval_metrics(s, d))


def mrr(s, d):
    return retrieval_metrics(s, d).select("qid", "k", F.round("mrr", 6).alias("mrr"))


def hit_rates(s, d):
    out = evalkit.hit_rates(fused(s, d, 40), questions(s, d), KS)
    return out.select("k", *[F.round(c, 6).alias(c) for c in ("strict", "doc", "tolerant")])


def miss_causes(s, d, normalize: bool = False):
    index = lexical.build_index(chunk_store(s, d), normalize=normalize, keep=True)
    asked = questions(s, d).select("qid", F.col("question").alias("query"))
    before = fused(s, d)
    after = rerank.rerank(before.where("rank <= 40"), asked, index, 40, normalize=normalize)
    return evalkit.miss_causes(before, after, questions(s, d), 40, 8).groupBy("cause").agg(F.count(F.lit(1)).alias("n"))


def doc_diversity(s, d):
    return fused(s, d, 8).groupBy("qid").agg(F.countDistinct("doc_id").alias("n_docs"))


def question_counts(s, d):
    q = questions(s, d)
    return q.agg(F.count(F.lit(1)).alias("n"), F.count_if("answerable").alias("n_answerable"), F.count_if(F.size("gold") > 0).alias("n_labelled"), F.count_if(F.col("answerable").isNull()).alias("n_unknown"))


def question_problems(s, d):
    return evalkit.question_problems(table(s, d, "questions")).groupBy("problem").agg(F.count(F.lit(1)).alias("n"))


def config_summary(s, d):
    rows = evalkit.answer_metrics(pair_answers(s, d).where("answerable is not null"))
    scored = retrieval_metrics(s, d).where("k = 8").select("qid", "recall", "mrr", "ndcg")
    rows = rows.join(questions(s, d).select("qid", "gold"), "qid").join(scored, "qid", "left")
    return evalkit.summarize(rows.withColumn("config", F.coalesce(F.nullif("notes", F.lit("")), F.lit("plain"))))


def question_report(s, d):
    before = fused(s, d)
    return reports.question_report(before, before.where("rank <= 40"), questions(s, d), KS, 40, 8).select("qid", "recall", "mrr", "ndcg", "before", "after", "cause")


def spec_hits(s, d):
    rows = fused(s, d, 8)
    return rows.where("rank <= 5").groupBy("qid").agg(F.count_if(reports.spec_like("CRB.HB.100")).alias("n"))


def page_totals(s, d):
    return reports.page_totals(pages(s, d)).select("doc_id", "n_pages", "n_chars")


def table_hashes(s, d):
    """The hashes of the tables that grow and of what is built from them."""
    chunks = chunk_store(s, d)
    tables = {n: table(s, d, n) for n in ("sources", "documents", "chunk_hits")} | {"chunk_store": chunks, "postings": lexical.build_index(chunks).postings}
    hashed = [manifest.table_hash(x).select(F.lit(n).alias("name"), "n", "digest") for n, x in tables.items()]
    return reduce(DataFrame.unionByName, hashed)


QUERIES: list[Query] = [
    bm25_topk, token_stats, technical_tokens, acronym_counts, token_windows, char_windows, sentence_counts, approx_token_counts, dehyphenated, canon_lines,
    page_number_lines, normalized_terms, section_titles, previews, topic_tokens, slugs, json_objects, identifiers, markdown_texts, layout_sanitized, boilerplate_lines,
    clean_pages, chunk_v1, chunk_v2, page_coverage, numbered_store, embedding_texts, pages_between, index_terms, index_corpus, bm25_score_texts, dense_topk,
    page_diverse_topk, normalized_vectors, rank_in_ranking, rrf_fuse, rank_norms, doc_filter, query_modes, compare_topics, definition_terms, query_variants,
    query_anchors, anchor_spans, rerank_hits, hybrid_topk, base_topk, query_plans, planned_topk, best_hits, context_budget, neighbor_expand, evidence_select,
    evidence_contexts, citation_keys, answer_problems, enforced_answers, answer_metrics, answers_end_to_end, algorithm_answers, comparison_answers,
    algorithm_headers, mentioned_algorithms, phrase_terms, section_edges, document_spans, algorithm_anchors, graph_nodes, graph_edges, graph_terms, term_lookup,
    algorithm_lookup, graph_export, evidence_assessment, agent_answers, agent_answers_graph, trace_carry_forward, trace_by_node, trace_latest, windowed_events, gold_overlap,
    gold_first_ranks, retrieval_metrics, mean_retrieval_metrics, mrr, hit_rates, miss_causes, doc_diversity, question_counts, question_problems, config_summary,
    question_report, spec_hits, page_totals, table_hashes,
    canon_lines_whole, previews_whole, embedding_texts_whole, index_terms_whole, index_corpus_whole, bm25_topk_whole, bm25_score_texts_whole, rerank_hits_whole,
    miss_causes_whole, acronym_counts_whole, token_windows_whole, char_windows_whole, sentence_counts_whole, approx_token_counts_whole, enforced_answers_whole,
    answer_metrics_whole,
]


def queries() -> dict[str, Query]:
    return {q.__name__: q for q in (*QUERIES, *pieces.QUERIES)}


def oracle_sql() -> dict[str, str]:
    return {**oracles.oracle_sql(), **pieces.oracle_sql(), **graph_oracles.oracle_sql()}
