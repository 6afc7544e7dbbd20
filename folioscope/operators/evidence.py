"""Evidence selection, cited answers and their validation."""
from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..conf import EngineConf
from ..functions import text as T
from . import fuse, rewrite, store

#: The answer that refuses, and other answers that count as it.
REFUSAL = "not found in provided docs"
REFUSALS = ["not found", "not found in documents", REFUSAL]


def stable_order() -> list[Column]:
    """L05."""
    return [F.desc("score"), F.col("doc_id"), F.col("start_page"), F.col("end_page"), F.col("chunk_id")]


def best_hits(hits: DataFrame) -> DataFrame:
    """A10: the highest-scoring row of every chunk of a query."""
    return fuse.first_of(hits, ["qid", "chunk_id"], stable_order())


def within_budget(rows: DataFrame, chunks: int, chars: int) -> DataFrame:
    """In the order of ``pos``, texts that are not blank, up to ``chunks`` of them and ``chars`` characters (the first always)."""
    rows = rows.where(T.strip(F.coalesce("text", F.lit(""))) != "")
    order = W.partitionBy("qid").orderBy("pos")
    rows = rows.withColumn("_n", F.row_number().over(order)).withColumn("_sum", F.sum(F.length("text")).over(order.rowsBetween(W.unboundedPreceding, 0)))
    kept = rows.where((F.col("_n") <= chunks) & ((F.col("_n") == 1) | (F.col("_sum") <= chars)))
    return kept.withColumn("pos", F.col("_n")).drop("_n", "_sum")


def select_evidence(hits: DataFrame, chunk_store: DataFrame | None, conf: EngineConf = EngineConf()) -> DataFrame:
    """Q16: ``qid, pos`` + hit: the best chunks of every query, each followed by its neighbours, within the context's budget."""
    order = W.partitionBy("qid").orderBy(*stable_order())
    primary = best_hits(hits).withColumn("_p", F.row_number().over(order)).where(F.col("_p") <= conf.ask_max_context_chunks)
    cols = ["qid", *fuse.HIT, "score"]
    rows = primary.select(*cols, "_p", F.lit(-1).alias("_s"))
    if chunk_store is not None and conf.ask_include_neighbor_chunks and conf.ask_neighbor_window > 0:
        near = store.neighbours(primary, chunk_store, conf.ask_neighbor_window)
        near = near.join(primary.select("qid", F.col("chunk_id").alias("of"), "_p"), ["qid", "of"])
        rows = rows.unionByName(near.select(*cols, "_p", F.col("side").alias("_s")))
    rows = fuse.first_of(rows, ["qid", "chunk_id"], [F.col("_p"), F.col("_s")])
    rows = rows.withColumn("pos", F.row_number().over(W.partitionBy("qid").orderBy("_p", "_s"))).drop("_p", "_s")
    return within_budget(rows, conf.ask_max_context_chunks, conf.ask_max_context_chars)


def contexts(evidence: DataFrame) -> DataFrame:
    """Q17: ``qid, context, citations``: the evidence of a query as one text with keys c1, c2 ..., and the keys' citations."""
    key = F.concat(F.lit("c"), F.col("pos").cast("string"))
    head = F.format_string("[%s] %s p%d-p%d chunk_id=%s\n", key, "doc_id", "start_page", "end_page", "chunk_id")
    block = F.concat(head, T.prettify_evidence(T.strip(F.coalesce("text", F.lit("")))))
    citation = F.struct(key.alias("key"), "doc_id", "start_page", "end_page", "chunk_id")
    # bounded: at most the context's number of chunks per query
    listed = evidence.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("pos", block.alias("block"), citation.alias("citation")))).alias("e"))
    return listed.select("qid", F.array_join(F.transform("e", lambda x: x["block"]), "\n\n---\n\n").alias("context"), F.transform("e", lambda x: x["citation"]).alias("citations"))


def check_answers(answers: DataFrame) -> DataFrame:
    """``answers(answer, citations)`` with ``problem``: the first broken rule of the answer contract, or null."""
    c = F.coalesce("citations", F.array().cast(answers.schema["citations"].dataType))
    refuses = F.lower(T.strip(F.coalesce("answer", F.lit("")))) == REFUSAL
    used = T.citation_keys(F.coalesce("answer", F.lit("")))
    known = F.transform(c, lambda x: x["key"])
    problem = (
        F.when(F.exists(c, lambda x: (x["start_page"] <= 0) | (x["end_page"] <= 0)), "page_not_positive")
        .when(F.exists(c, lambda x: x["start_page"] > x["end_page"]), "pages_reversed")
        .when(refuses & (F.size(c) > 0), "refusal_with_citations")
        .when(refuses, F.lit(None).cast("string"))
        .when(F.size(c) == 0, "no_citations")
        .when(F.size(used) == 0, "no_markers")
        .when(F.size(F.array_except(used, known)) > 0, "unknown_markers")
    )
    return answers.withColumn("problem", problem)


def enforce(drafts: DataFrame) -> DataFrame:
    """``drafts(draft, citations)`` with ``answer, used``: the draft and the citations it uses, or a refusal with none.

    A draft is refused if it says so, cites nothing, cites an unknown key, or
    has a sentence without a citation.  Null citations are none.
    """
    body = T.strip(F.coalesce("draft", F.lit("")))
    keys = T.citation_keys(body)
    none = F.array().cast(drafts.schema["citations"].dataType)
    given = F.coalesce("citations", none)
    known = F.transform(given, lambda x: x["key"])
    bad = F.lower(body).isin(*REFUSALS) | (F.size(keys) == 0) | (F.size(F.array_except(keys, known)) > 0) | F.exists(T.sentences(body), lambda s: F.size(T.citation_keys(s)) == 0)
    number = lambda x: F.substring(x["key"], 2, 9).cast("int")
    used = F.filter(given, lambda x: F.array_contains(keys, x["key"]))
    ordered = F.array_sort(used, lambda a, b: number(a) - number(b))
    return drafts.withColumns({"answer": F.when(bad, REFUSAL).otherwise(body), "used": F.when(bad, none).otherwise(ordered)})


def algorithm_fallback(evidence: DataFrame, queries: DataFrame) -> DataFrame:
    """``qid, draft`` from the numbered steps of the first evidence that holds the algorithm asked for."""
    asked = queries.select("qid", F.regexp_extract("query", rewrite.ALGORITHM_NUMBER, 1).alias("number")).where("number <> ''")
    fits = F.rlike("text", F.concat(F.lit(r"(?i)\bAlgorithm\s+"), F.col("number"), F.lit(r"\b"))) & F.col("text").rlike(r"\b1\s*:\s*")
    first = fuse.first_of(evidence.join(asked, "qid").where(fits), ["qid"], [F.col("pos")])
    steps = first.select("qid", "pos", T.algorithm_steps(F.col("text")).alias("steps")).where(F.size("steps") > 0)
    line = lambda s: F.concat(F.lit("- "), s["step"].cast("string"), F.lit(": "), s["body"], F.lit(" [c"), F.col("pos").cast("string"), F.lit("]."))
    return steps.select("qid", F.array_join(F.transform("steps", line), "\n").alias("draft"))


def comparison_fallback(hits: DataFrame, queries: DataFrame) -> DataFrame:
    """``qid, draft, citations`` from one hit for each topic of a comparison, by their roles or first sentences."""
    asked = queries.select("qid", rewrite.plan_topics(F.col("query")).alias("t")).where("t is not null")
    sides = asked.select("qid", F.posexplode(F.array("t.a", "t.b")).alias("side", "topic"))
    rows = best_hits(hits).join(sides, "qid").where(rewrite.topic_in(F.coalesce("text", F.lit("")), F.col("topic")))
    rows = rows.withColumn("role", rewrite.role(F.col("text")))
    picked = fuse.first_of(rows, ["qid", "side"], [F.col("role").isNull(), *stable_order()])
    picked = picked.withColumn("sentence", F.regexp_replace(T.first_good_sentence(F.col("text")), r"\.+$", ""))
    fields = ["topic", "role", "sentence", "chunk_id", "doc_id", "start_page", "end_page"]
    side = lambda n: picked.where(F.col("side") == n).select("qid", F.struct(*fields).alias("ab"[n]))
    both = side(0).join(side(1), "qid")
    a, b = F.col("a"), F.col("b")
    same = a["chunk_id"] == b["chunk_id"]
    key_b = F.when(same, "c1").otherwise("c2")
    citation = lambda key, x: F.struct(key.alias("key"), x["doc_id"].alias("doc_id"), x["start_page"].alias("start_page"), x["end_page"].alias("end_page"), x["chunk_id"].alias("chunk_id"))
    by_role = F.format_string(
        "- %s is specified as a %s [c1].\n- %s is specified as a %s [%s].\n- This indicates the standards assign different core purposes to these schemes [c1][%s].",
        a["topic"], a["role"], b["topic"], b["role"], key_b, key_b)
    by_sentence = F.format_string(
        "- %s: %s [c1].\n- %s: %s [%s].\n- These statements provide citable evidence for a side-by-side comparison [c1][%s].",
        a["topic"], a["sentence"], b["topic"], b["sentence"], key_b, key_b)
    draft = F.when(a["role"].isNotNull() & b["role"].isNotNull() & (a["role"] != b["role"]), by_role).when((a["sentence"] != "") & (b["sentence"] != ""), by_sentence)
    cited = F.when(same, F.array(citation(F.lit("c1"), a))).otherwise(F.array(citation(F.lit("c1"), a), citation(F.lit("c2"), b)))
    return both.select("qid", draft.alias("draft"), cited.alias("citations")).where("draft is not null")


def prompt(question: Column, context: Column) -> Column:
    """What a generator is asked: the rules of citing, the question and the evidence."""
    rules = (
        "Answer from the evidence below and from nothing else.\n"
        "Put at least one marker such as [c1] into every sentence, using only markers from the evidence headers.\n"
        f"If the evidence does not answer the question, reply exactly: {REFUSAL}\n"
        "Write 3 to 6 bullets of one sentence each.\n\n"
    )
    return F.concat(F.lit(rules + "Question:\n"), question, F.lit("\n\nEvidence:\n"), context)


def stub_payload(queries: DataFrame, hits: DataFrame, limit: int = 220) -> DataFrame:
    """``qid, answer, citations, refusal_reason`` without a generator: the beginning of the first hit, and the first two hits as citations."""
    rows = hits.where(F.col("rank") <= 2).select("qid", F.struct("rank", "doc_id", "start_page", "end_page", "chunk_id", "text").alias("h"))
    two = rows.groupBy("qid").agg(F.array_sort(F.collect_list("h"), lambda a, b: a["rank"] - b["rank"]).alias("h"))
    d = queries.join(two, "qid", "left")
    text = T.strip(F.left(F.regexp_replace(T.strip(F.coalesce(F.get("h", F.lit(0))["text"], F.lit(""))), "\n", " "), F.lit(limit)))
    said = F.concat(F.coalesce(F.nullif(text, F.lit("")), T.strip(F.col("query"))), F.lit(" [c1]"))
    cited = F.transform("h", lambda x, i: F.struct(F.concat(F.lit("c"), (i + 1).cast("string")).alias("key"), x["doc_id"].alias("doc_id"), x["start_page"].alias("start_page"), x["end_page"].alias("end_page"), x["chunk_id"].alias("chunk_id")))
    some = F.col("h").isNotNull()
    return d.select("qid", F.when(some, said).otherwise(REFUSAL).alias("answer"), F.when(some, cited).otherwise(F.array()).alias("citations"), F.when(~some, "insufficient_evidence").alias("refusal_reason"))


def stub_answer(question: str, context: str) -> str:
    """A generator for tests: the beginning of the first piece of evidence, cited."""
    first = context.split("\n\n---\n\n")[0].split("\n", 1)[-1].strip().replace("\n", " ")[:220].strip()
    return f"{(first or question.strip())} [c1]"


def answer(queries: DataFrame, hits: DataFrame, chunk_store: DataFrame | None, generate: Callable[[str, str], str] = stub_answer, conf: EngineConf = EngineConf()) -> DataFrame:
    """Q18, Q22: ``qid, answer, citations, refusal_reason, source`` for all ``queries(qid, query)``.

    ``generate`` gets the question and the prompt's context and runs in Arrow
    batches next to the data; whatever it raises counts as a backend error.
    Where its draft is refused, the steps of an algorithm or the two sides of
    a comparison stand in for it.
    """
    evidence = select_evidence(hits, chunk_store, conf)
    context = contexts(evidence)
    counts = evidence.groupBy("qid").agg(F.count(F.lit(1)).alias("n"))
    asked = queries.join(counts, "qid", "left").join(context, "qid", "left").fillna({"n": 0})

    def draft(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for qid, query, context in zip(pdf["qid"], pdf["query"], pdf["context"]):
                try:
                    out.append((qid, generate(query, context), None))
                except Exception as e:  # noqa: BLE001 - a generator may raise anything
                    out.append((qid, None, type(e).__name__))
            yield pd.DataFrame(out, columns=["qid", "draft", "error"])

    enough = asked.where(F.col("n") >= conf.ask_min_evidence_hits)
    drafts = enough.select("qid", "query", "context").mapInPandas(draft, "qid string, draft string, error string")
    rows = asked.join(drafts, "qid", "left")
    citation_type = context.schema["citations"].dataType
    first = enforce(rows.withColumn("citations", F.coalesce("citations", F.array().cast(citation_type))))
    second = enforce(algorithm_fallback(evidence, queries).join(context.select("qid", "citations"), "qid")).where(F.col("answer") != REFUSAL).select("qid", F.col("answer").alias("a2"), F.col("used").alias("u2"))
    third = enforce(comparison_fallback(hits, queries)).where(F.col("answer") != REFUSAL).select("qid", F.col("answer").alias("a3"), F.col("used").alias("u3"))
    all_of = first.join(second, "qid", "left").join(third, "qid", "left")
    refused = F.col("answer") == REFUSAL
    may = refused & (F.col("n") >= conf.ask_min_evidence_hits) & F.col("error").isNull()
    source = F.when(~refused, "generator").when(may & F.col("a2").isNotNull(), "algorithm").when(may & F.col("a3").isNotNull(), "comparison").otherwise("refusal")
    rows = all_of.withColumn("source", source)
    pick = lambda x, y, z: F.when(F.col("source") == "algorithm", F.col(y)).when(F.col("source") == "comparison", F.col(z)).otherwise(F.col(x))
    rows = rows.select("qid", pick("answer", "a2", "a3").alias("answer"), pick("used", "u2", "u3").alias("citations"), "n", "draft", "error", "source")
    return rows.select("qid", "answer", "citations", refusal_reason(F.col("answer"), F.col("n"), F.col("draft"), F.col("error"), conf).alias("refusal_reason"), "source")


def refusal_reason(text: Column, hits: Column, draft: Column, error: Column, conf: EngineConf) -> Column:
    """Q22: why an answer is a refusal, or null if it is none."""
    return (
        F.when(F.lower(T.strip(text)) != REFUSAL, F.lit(None).cast("string"))
        .when(error.isNotNull(), "backend_error")
        .when(hits < conf.ask_min_evidence_hits, "insufficient_evidence")
        .when(draft.isNull(), "missing_citations_after_generation")
        .when(T.strip(draft) == "", "empty_answer")
        .otherwise("missing_citations_after_generation")
    )
