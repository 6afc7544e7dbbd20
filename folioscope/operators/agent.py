"""The bounded refine-and-retrieve loop, for all questions at once."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..conf import EngineConf
from ..functions import text as T
from ..session import checkpointing
from . import fuse, planner
from . import rewrite as R

#: What is said when an answer is withheld, by reason.
MESSAGES = {
    "missing_protected_span": "I could not find citable evidence for the specific algorithm/table/section anchor in the indexed NIST documents.",
    "wrong_doc_scope": "I could not find enough in-scope citable evidence in the requested NIST document set.",
    "one_sided_comparison": "I could not find enough citable evidence across both topics to produce a reliable comparison from the indexed NIST documents.",
    "missing_citations": "I could not produce reliable citations for the drafted answer, so I cannot return it.",
    "empty_draft_answer": "I could not produce a citable grounded answer from the indexed NIST documents.",
}
OTHER_MESSAGE = "I do not have enough citable evidence in the indexed NIST documents to answer that reliably."


def _texts(evidence: DataFrame, normalize: bool) -> DataFrame:
    body = F.coalesce("text", F.lit(""))
    return evidence.select("qid", "chunk_id", "doc_id", F.lower(T.normalize_identifiers(body) if normalize else body).alias("body"))


def assess(state: DataFrame, evidence: DataFrame, conf: EngineConf = EngineConf(), *, normalize: bool = True) -> DataFrame:
    """``qid, reasons, sufficient, missing_spans, missing_topics, hits, doc_diversity``.

    ``state`` has ``qid, doc_ids, protected_spans, compare_topics``;
    ``evidence`` one row per chunk.  Spans and topics are matched against the
    evidence rows of their own question and reduced to a flag before any
    collecting.
    """
    texts = _texts(evidence, normalize)
    counts = texts.groupBy("qid").agg(F.countDistinct("chunk_id").alias("hits"), F.countDistinct("doc_id").alias("doc_diversity"), F.collect_set("doc_id").alias("present"))
    topic = F.when(F.col("compare_topics").isNotNull(), F.array("compare_topics.a", "compare_topics.b")).otherwise(planner.empty())
    base = state.select("qid", "doc_ids", "protected_spans", "compare_topics").withColumns({"_spans": R.assessable(F.col("protected_spans")), "_topics": topic})
    asked = base.select("qid", F.explode(F.array_distinct(F.concat("_spans", "_topics"))).alias("span"))
    span = T.normalize_identifiers(F.col("span")) if normalize else F.col("span")
    met = asked.withColumn("want", span).join(texts.select("qid", "body"), "qid").where(R.text_holds_span(F.col("body"), F.col("want"))).select("qid", "span").distinct()
    found = met.groupBy("qid").agg(F.collect_set("span").alias("met"))
    d = base.join(counts, "qid", "left").join(found, "qid", "left").fillna({"hits": 0, "doc_diversity": 0})
    none = planner.empty()
    d = d.withColumns({"met": F.coalesce("met", none), "present": F.coalesce("present", none)})
    expected = lambda t: F.get(R.document_scope(t), F.lit(0))
    by_doc = F.filter("_topics", lambda t: ~F.array_contains(F.col("present"), expected(t)))
    use_docs = (F.size("doc_ids") >= 2) & (F.size("_topics") == 2) & F.forall("_topics", lambda t: expected(t).isNotNull()) & (F.size(by_doc) > 0)
    by_text = F.array_except("_topics", "met")
    d = d.withColumns({"missing_spans": F.array_except("_spans", "met"), "missing_topics": F.when(F.size("_topics") < 2, none).when(use_docs, by_doc).otherwise(by_text)})
    reasons = R.strings(
        F.when((F.size("doc_ids") > 0) & (F.col("hits") == 0), "wrong_doc_scope"), F.when(F.size("missing_spans") > 0, "missing_protected_span"),
        F.when((F.size("_topics") == 2) & (F.size("missing_topics") > 0), "one_sided_comparison"), F.when(F.col("hits") < conf.agent_min_evidence_hits, "insufficient_hits"))
    return d.select("qid", reasons.alias("reasons"), (F.size(reasons) == 0).alias("sufficient"), "missing_spans", "missing_topics", "hits", "doc_diversity")


def budget_reason(steps: Column, calls: Column, rounds: Column, conf: EngineConf) -> Column:
    """Q30: the first budget that is used up, or null."""
    return (
        F.when(steps >= conf.agent_max_steps, "step_budget_exhausted").when(calls >= conf.agent_max_tool_calls, "tool_budget_exhausted")
        .when(rounds >= conf.agent_max_retrieval_rounds, "retrieval_round_budget_exhausted")
    )


def refine(state: DataFrame) -> DataFrame:
    """Q32: new ``sparse_query, dense_query, strategy`` by the reason why the evidence did not do."""
    reason, few = F.col("stop_reason"), lambda c, n: F.slice(c, 1, n)
    spans = F.when(F.size("missing_spans") > 0, F.col("missing_spans")).otherwise(F.col("required_anchors"))
    topics = F.flatten(F.transform("missing_topics", lambda t: F.concat(F.array(t), planner.topic_bias(t))))
    words = lambda *w: F.array(*map(F.lit, w))
    thin, defines = reason == "insufficient_hits", F.col("mode_hint") == "definition"
    none = planner.empty()
    add_sparse = F.when(reason == "missing_protected_span", spans).when(reason == "one_sided_comparison", topics).when(thin & defines, words("definition", "notation", "term")).when(thin, words("section", "algorithm", "definition")).otherwise(none)
    add_dense = F.when(reason == "missing_protected_span", few(spans, 2)).when(reason == "one_sided_comparison", few(topics, 4)).when(thin & defines, words("definition", "notation")).when(thin, words("standard", "guidance")).otherwise(none)
    strategy = (
        F.when(reason == "missing_protected_span", "protected_span_bias").when(reason == "wrong_doc_scope", "doc_scope_retry").when(reason == "one_sided_comparison", "comparison_balance_bias")
        .when(thin & defines, "definition_bias").when(thin, "coverage_bias").otherwise("no_change"))
    return state.withColumns({"sparse_query": T.append_terms(F.col("sparse_query"), add_sparse), "dense_query": T.append_terms(F.col("dense_query"), add_dense), "strategy": strategy})


def refusal_message(reason: Column) -> Column:
    """Q33."""
    out = F.lit(OTHER_MESSAGE)
    for r, m in MESSAGES.items():
        out = F.when(F.lower(reason) == r, m).otherwise(out)
    return out


def verify(state: DataFrame) -> DataFrame:
    """Q29, Q33: ``final_answer, result, refusal_reason`` of ``sufficient, stop_reason, draft, hits, citations``."""
    draft, cited = T.strip(F.coalesce("draft", F.lit(""))), F.size(F.coalesce("citations", F.array().cast(state.schema["citations"].dataType)))
    reason = (
        F.when(~F.col("sufficient"), F.coalesce(F.nullif("stop_reason", F.lit("")), F.lit("insufficient_evidence"))).when(draft == "", "empty_draft_answer")
        .when(F.col("hits") == 0, "empty_evidence").when(cited == 0, "missing_citations").otherwise(""))
    return state.withColumn("refusal_reason", reason).withColumns({"result": F.when(F.col("refusal_reason") == "", "ok").otherwise("refuse"), "final_answer": F.when(F.col("refusal_reason") == "", draft).otherwise(refusal_message(F.col("refusal_reason")))})


def run(plans: DataFrame, retrieve: Callable[[DataFrame], DataFrame], conf: EngineConf = EngineConf(), *, normalize: bool = True, trace: list[DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """Q29, Q34: the state of every question after the last round, and its evidence.

    ``retrieve`` turns the plans of the active questions into hits.  A round
    retrieves for all active questions in one plan, adds what is new to their
    evidence (U03), assesses it, and refines the queries of those that still
    lack something; budgets are columns.  ``trace`` gets the state of every
    round's questions as the round left it (see ``reports.round_events``).  The lineage is cut between rounds by
    checkpoints in the shared folder.
    """
    checkpointing(plans.sparkSession)
    state = plans.withColumns({
        "round": F.lit(0), "steps": F.lit(2), "tool_calls": F.lit(0), "stop_reason": F.lit(""), "sufficient": F.lit(False), "active": F.lit(True),
        "strategy": F.lit(""), "hits": F.lit(0).cast("long"), "missing_spans": planner.empty(), "missing_topics": planner.empty(), "reasons": planner.empty(),
    })
    evidence = None
    for n in range(1, conf.agent_max_retrieval_rounds + 1):
        fresh = retrieve(state.where("active")).select("qid", *fuse.HIT, "score", F.lit(n).alias("round"), "rank")
        evidence = fresh if evidence is None else evidence.unionByName(fresh)
        evidence = fuse.first_of(evidence, ["qid", "chunk_id"], [F.col("round"), F.col("rank")]).checkpoint()
        seen = assess(state.where("active"), evidence, conf, normalize=normalize)
        new = seen.select("qid", *[F.col(c).alias(f"_{c}") for c in ("reasons", "sufficient", "missing_spans", "missing_topics", "hits")])
        state = state.join(new, "qid", "left")
        on = F.col("active")
        state = state.withColumns({c: F.when(on, F.col(f"_{c}")).otherwise(F.col(c)) for c in ("reasons", "sufficient", "missing_spans", "missing_topics", "hits")})
        # retrieve, assess and, before another round, refine are a step each
        state = state.withColumns({"round": F.when(on, n).otherwise(F.col("round")), "tool_calls": F.when(on, F.col("tool_calls") + 1).otherwise(F.col("tool_calls")), "steps": F.when(on, F.col("steps") + 2).otherwise(F.col("steps"))})
        spent = budget_reason(F.col("steps"), F.col("tool_calls"), F.col("round"), conf)
        reason = F.when(F.col("sufficient"), "sufficient_evidence").otherwise(F.coalesce(spent, F.get("reasons", F.lit(0))))
        state = state.withColumns({"stop_reason": F.when(on, reason).otherwise(F.col("stop_reason")), "active": on & ~F.col("sufficient") & spent.isNull()})
        state = state.drop("_reasons", "_sufficient", "_missing_spans", "_missing_topics", "_hits")
        refined = refine(state).select("qid", *[F.col(c).alias(f"_{c}") for c in ("sparse_query", "dense_query", "strategy")])
        state = state.join(refined, "qid")
        state = state.withColumns({c: F.when(F.col("active"), F.col(f"_{c}")).otherwise(F.col(c)) for c in ("sparse_query", "dense_query", "strategy")})
        state = state.withColumn("steps", F.when(F.col("active"), F.col("steps") + 1).otherwise(F.col("steps"))).drop("_sparse_query", "_dense_query", "_strategy").checkpoint()
        if trace is not None:
            trace.append(state.where(F.col("round") == n))
    return state, evidence
