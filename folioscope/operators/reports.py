"""Evaluation runs, comparisons of configurations, traces of the agent, and their reports."""
from __future__ import annotations

import json
from collections.abc import Callable
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as T
from . import evalkit
from .rewrite import has_any

# The main specification, the page where its body begins, and words of its algorithms.
SPEC_DOC, SPEC_PAGE, SPEC_WORDS = "NIST.FIPS.203", 20, ["algorithm", "keygen", "decaps", "parameter set"]


def run_id(dataset: str, at: datetime) -> str:
    """K12."""
    stem = "".join(c if c.isalnum() or c in "._-" else "-" for c in Path(dataset).stem).strip("._-") or "eval"
    return f"{stem}_{at.astimezone(timezone.utc).strftime('%Y%m%dT%H%M%SZ')}"


def cell(v: object) -> str:
    return "-" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)


def markdown_table(rows: list[dict], columns: list[str]) -> str:
    """Rows of a small, aggregated result as a Markdown table."""
    lines = ["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)]
    return "\n".join(lines + ["| " + " | ".join(cell(r.get(c)) for c in columns) + " |" for r in rows])


def question_report(fused: DataFrame, reranked: DataFrame, questions: DataFrame, ks: list[int], pool: int, k: int) -> DataFrame:
    """One wide row per labelled question: metrics at ``k``, first ranks before and after reranking, cause of a miss, top hits."""
    m = evalkit.metrics(reranked, questions, ks).where(F.col("k") == k).drop("k")
    causes = evalkit.miss_causes(fused, reranked, questions, pool, k)
    top = reranked.where("rank <= 10").groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "doc_id", F.format_string("p%d-p%d", "start_page", "end_page").alias("pages"), "chunk_id"))).alias("top_hits"))
    return m.join(causes, "qid").join(top, "qid", "left")


def evaluate(fused: DataFrame, reranked: DataFrame, questions: DataFrame, ks: list[int], outdir: str, dataset: str, pool: int = 40) -> dict:
    """Runs the metrics of all questions in one plan and writes the per-question rows, a summary and its Markdown.

    The primary cut-off is 8 if it is listed, else the largest.
    """
    k = 8 if 8 in ks else max(ks)
    name = run_id(dataset, datetime.now(timezone.utc))
    per_question = question_report(fused, reranked, questions, ks, pool, k)
    means = [r.asDict() for r in evalkit.mean_metrics(evalkit.metrics(reranked, questions, ks)).orderBy("k").collect()]
    rates = [r.asDict() for r in evalkit.hit_rates(reranked, questions, ks).orderBy("k").collect()]
    causes = [r.asDict() for r in per_question.groupBy("cause").agg(F.count(F.lit(1)).alias("n")).orderBy("cause").collect()]
    summary = {"run_id": name, "primary_k": k, "metrics": means, "hit_rates": rates, "miss_causes": causes}
    folder = Path(outdir)
    folder.mkdir(parents=True, exist_ok=True)
    per_question.select(F.to_json(F.struct(*sorted(per_question.columns))).alias("value")).write.mode("overwrite").text(str(folder / f"{name}_per_question"))
    (folder / f"{name}_summary.json").write_text(json.dumps(summary, indent=2, sort_keys=True))
    parts = [f"# Retrieval evaluation {name}", markdown_table(means, ["k", "n", "recall", "mrr", "ndcg"]), markdown_table(rates, ["k", "strict", "doc", "tolerant"]), markdown_table(causes, ["cause", "n"])]
    (folder / f"{name}_summary.md").write_text("\n\n".join(parts) + "\n")
    return summary


def compare(configs: dict[str, Callable[[DataFrame], tuple[DataFrame, DataFrame]]], questions: DataFrame, k: int = 8) -> DataFrame:
    """The summary of several configurations; each maps questions to (ranked hits, answers ``qid, answer, citations``)."""
    rows = None
    asked = questions.select("qid", F.col("question").alias("query"))
    for name, run in configs.items():
        ranked, answers = run(asked)
        scored = evalkit.metrics(ranked, questions, [k]).drop("k")
        part = questions.join(answers, "qid", "left").join(scored, "qid", "left").withColumn("config", F.lit(name))
        part = evalkit.answer_metrics(part).select("config", "qid", "answerable", "gold", "recall", "mrr", "ndcg", "is_refusal", "citation_count")
        rows = part if rows is None else rows.unionByName(part)
    return evalkit.summarize(rows)


def definition_sanity(before: DataFrame, after: DataFrame, expected: DataFrame) -> DataFrame:
    """Per question whether plans before and after graph look-ups (``qid, doc_ids, required_anchors``) name the expected documents and anchor, and whether the scope got narrower."""
    b = before.select("qid", F.col("doc_ids").alias("b_docs"), F.col("required_anchors").alias("b_anchors"))
    a = after.select("qid", F.col("doc_ids").alias("a_docs"), F.col("required_anchors").alias("a_anchors"))
    rows = expected.join(b, "qid").join(a, "qid")
    covers = lambda docs: F.size(F.array_except("expected_doc_ids", docs)) == 0
    anchored = lambda anchors: F.exists(anchors, lambda x: F.lower(x) == F.lower("expected_anchor"))
    narrower = (F.size("a_docs") > 0) & (F.array_sort("a_docs") != F.array_sort("b_docs"))
    return rows.select("qid", covers(F.col("b_docs")).alias("doc_ok_before"), covers(F.col("a_docs")).alias("doc_ok_after"), anchored(F.col("b_anchors")).alias("anchor_before"), anchored(F.col("a_anchors")).alias("anchor_after"), narrower.alias("narrower"))


def spec_like(doc_id: str = SPEC_DOC) -> Column:
    """A hit from the body of the main specification, by its page or words."""
    return (F.col("doc_id") == doc_id) & ((F.col("start_page") >= SPEC_PAGE) | has_any(F.lower(F.coalesce("text", F.lit(""))), SPEC_WORDS))


def spec_delta(base: DataFrame, hybrid: DataFrame, k: int = 5, doc_id: str = SPEC_DOC) -> DataFrame:
    """Per question how many of the first ``k`` hits are specification-like, in two result lists, and the difference."""
    count = lambda df, name: df.where(F.col("rank") <= k).groupBy("qid").agg(F.count_if(spec_like(doc_id)).alias(name))
    rows = count(base, "base").join(count(hybrid, "hybrid"), "qid", "full").fillna(0)
    return rows.withColumn("delta", F.col("hybrid") - F.col("base"))


def round_events(rounds: list[DataFrame]) -> DataFrame:
    """Q35: the events of all rounds of the agent, each read off the state in which its round left the questions (``trace`` of ``agent.run``)."""
    out = None
    for n, state in enumerate(rounds):
        own = trace_events(state).where(F.lit(n == 0) | ~F.col("node").isin("analyze_query")).withColumn("seq", F.col("seq") + 100 * n)
        out = own if out is None else out.unionByName(own)
    return out


def trace_events(state: DataFrame) -> DataFrame:
    """Q35: the events of one round of the agent, read off its state: ``run_id, seq, type, node, payload``."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    event = lambda kind, node, **fields: F.struct(F.lit(kind).alias("type"), F.lit(node).alias("node"), F.create_map(*[x for k, c in fields.items() for x in (F.lit(k), text(c))]).cast("map<string,string>").alias("payload"))
    items = F.array(
        event("step", "analyze_query", steps="steps"), event("analysis_applied", "analyze_query", mode_hint="mode_hint", sparse_query="sparse_query", dense_query="dense_query"),
        event("step", "retrieve", steps="steps"), event("retrieval_round_result", "retrieve", round="round", total_hits="hits", tool_calls="tool_calls"),
        event("step", "assess_evidence", steps="steps"), event("assessment_decision", "assess_evidence", sufficient="sufficient", stop_reason="stop_reason"),
        event("query_refined", "refine_query", strategy="strategy"),
    )
    return state.select(F.col("qid").alias("run_id"), F.posexplode(items).alias("seq", "e")).select("run_id", (F.col("seq") + 1).cast("long").alias("seq"), "e.type", "e.node", "e.payload")


def write_trace(events: DataFrame, path: str) -> None:
    """The events as JSON lines, one folder per run."""
    events.repartition("run_id").sortWithinPartitions("run_id", "seq").write.mode("overwrite").partitionBy("run_id").json(path)


def page_totals(pages: DataFrame) -> DataFrame:
    """Pages and characters per document."""
    return pages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_pages"), F.sum(F.length(F.coalesce("text", F.lit("")))).alias("n_chars"), F.count_if(T.strip(F.coalesce("text", F.lit(""))) == "").alias("n_empty"))
