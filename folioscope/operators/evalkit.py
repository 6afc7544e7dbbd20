"""Retrieval and answer evaluation."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import text as T
from .evidence import REFUSAL

GOLD = "array<struct<doc_id:string,start_page:int,end_page:int>>"


def overlaps(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Whether two inclusive page ranges meet."""
    return (a_end >= b_start) & (b_end >= a_start)


def matches(hit, gold, how: str = "strict", slack: int = 1) -> Column:
    """A hit (struct or row columns) against a gold span: strict, by document only, or with some pages of tolerance."""
    same = hit["doc_id"] == gold["doc_id"]
    if how == "doc":
        return same
    if how == "tolerant" and slack < 0:
        raise ValueError("the tolerance must not be negative")
    more = slack if how == "tolerant" else 0
    return same & overlaps(hit["start_page"], hit["end_page"], gold["start_page"] - more, gold["end_page"] + more)


def hits_on_gold(hits: DataFrame, gold: DataFrame, how: str = "strict", slack: int = 1) -> DataFrame:
    """Hits joined to the gold spans of their question that they meet (equi-join on question and document, ranges as residual)."""
    g = gold.select("qid", "doc_id", F.col("start_page").alias("g_start"), F.col("end_page").alias("g_end"), "span")
    more = slack if how == "tolerant" else 0
    on = hits.join(g, ["qid", "doc_id"])
    return on if how == "doc" else on.where(overlaps(F.col("start_page"), F.col("end_page"), F.col("g_start") - more, F.col("g_end") + more))


def gold_spans(questions: DataFrame) -> DataFrame:
    """``qid, span, doc_id, start_page, end_page``: the gold spans, one row each."""
    return questions.select("qid", F.posexplode("gold").alias("span", "g")).select("qid", "span", "g.doc_id", "g.start_page", "g.end_page")


def gains(hits: Column, gold: Column) -> Column:
    """1 or 0 for every hit in order; each gold span is matched by the first hit that takes it, once."""
    start = F.struct(F.array().cast("array<int>").alias("gains"), F.array().cast("array<int>").alias("used"))

    def step(acc: Column, hit: Column) -> Column:
        free = F.filter(F.sequence(F.lit(0), F.size(gold) - 1), lambda i: matches(hit, F.get(gold, i)) & ~F.array_contains(acc["used"], i))
        first = F.get(free, F.lit(0))
        return F.struct(F.concat(acc["gains"], F.array(first.isNotNull().cast("int"))).alias("gains"), F.when(first.isNotNull(), F.concat(acc["used"], F.array(first))).otherwise(acc["used"]).alias("used"))

    return F.when(F.size(gold) > 0, F.aggregate(hits, start, step, lambda acc: acc["gains"])).otherwise(F.transform(hits, lambda _: F.lit(0)))


def metrics(ranked: DataFrame, questions: DataFrame, ks: list[int]) -> DataFrame:
    """``qid, k, recall, mrr, ndcg`` of ``ranked(qid, rank, doc_id, start_page, end_page)`` for ``questions(qid, gold)``.

    The ranked list of a question is bounded by the largest k before it is
    collected.  Recall is the share of gold spans found; a span counts once.
    Questions without gold have no metrics; those without hits have zeros.
    """
    most = max(ks)
    listed = ranked.where(F.col("rank") <= most).groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "doc_id", "start_page", "end_page"))).alias("hits"))
    rows = questions.where(F.size("gold") > 0).select("qid", "gold").join(listed, "qid", "left")
    rows = rows.withColumn("hits", F.coalesce("hits", F.array().cast("array<struct<rank:int,doc_id:string,start_page:int,end_page:int>>")))
    rows = rows.withColumns({"g": gains(F.col("hits"), F.col("gold")), "any": F.transform("hits", lambda h: F.exists("gold", lambda s: matches(h, s)).cast("int"))})
    rows = rows.select("qid", "gold", "g", "any", F.explode(F.array(*map(F.lit, sorted(set(ks))))).alias("k"))
    top = F.slice("g", 1, F.col("k"))
    discount = lambda i: 1.0 / F.log2(i + 2.0)
    dcg = F.aggregate(F.transform(top, lambda x, i: x * discount(i)), F.lit(0.0), lambda a, x: a + x)
    ideal = F.aggregate(F.transform(F.sequence(F.lit(0), F.least(F.size("gold"), F.col("k")) - 1), discount), F.lit(0.0), lambda a, x: a + x)
    first = F.array_position(F.slice("any", 1, F.col("k")), F.lit(1))
    found = F.aggregate(top, F.lit(0), lambda a, x: a + x)
    return rows.select("qid", "k", F.round(found / F.size("gold"), 9).alias("recall"), F.round(F.when(first > 0, 1.0 / first).otherwise(0.0), 9).alias("mrr"), F.round(dcg / ideal, 9).alias("ndcg"))


def mean_metrics(per_question: DataFrame) -> DataFrame:
    """Macro means over questions."""
    return per_question.groupBy("k").agg(F.count(F.lit(1)).alias("n"), *[F.round(F.avg(c), 9).alias(c) for c in ("recall", "mrr", "ndcg")])


def gold_ranks(hits: DataFrame, gold: DataFrame, how: str = "strict", slack: int = 1) -> DataFrame:
    """``qid, ranks, first_rank``: the ranks at which a question's gold is met."""
    met = hits_on_gold(hits, gold, how, slack).select("qid", "rank").distinct()
    return met.groupBy("qid").agg(F.array_sort(F.collect_list("rank")).alias("ranks"), F.min("rank").alias("first_rank"))


def hit_rates(hits: DataFrame, questions: DataFrame, ks: list[int]) -> DataFrame:
    """``k, strict, doc, tolerant``: the share of labelled questions with a match among the first k."""
    labelled = questions.where(F.size("gold") > 0)
    gold = gold_spans(labelled)
    rows = labelled.select("qid")
    for how in ("strict", "doc", "tolerant"):
        rows = rows.join(gold_ranks(hits, gold, how).select("qid", F.col("first_rank").alias(how)), "qid", "left")
    rows = rows.select("*", F.explode(F.array(*map(F.lit, ks))).alias("k"))
    return rows.groupBy("k").agg(*[F.round(F.avg(F.coalesce((F.col(h) <= F.col("k")).cast("int"), F.lit(0))), 9).alias(h) for h in ("strict", "doc", "tolerant")])


def miss_cause(in_fused: Column, in_pool: Column, before: Column, after: Column, k: int) -> Column:
    """Why a question's gold is not among the first ``k``, by its first ranks in the pool and after reranking."""
    demoted = after.isNull() | (after > before)
    return (
        F.when(~in_fused, "upstream_missing").when(~in_pool, "outside_pool").when(after <= k, "retained_or_recovered")
        .when(demoted, "rerank_demotion").when(before > k, "rerank_insufficient_promotion").otherwise("rerank_demotion")
    )


def miss_causes(fused: DataFrame, reranked: DataFrame, questions: DataFrame, pool: int, k: int) -> DataFrame:
    """``qid, before, after, cause`` of all labelled questions."""
    labelled = questions.where(F.size("gold") > 0)
    gold = gold_spans(labelled)
    before = gold_ranks(fused, gold).select("qid", F.col("first_rank").alias("before"))
    after = gold_ranks(reranked, gold).select("qid", F.col("first_rank").alias("after"))
    rows = labelled.select("qid").join(before, "qid", "left").join(after, "qid", "left")
    return rows.withColumn("cause", miss_cause(F.col("before").isNotNull(), F.coalesce(F.col("before") <= pool, F.lit(False)), F.col("before"), F.col("after"), k))


def answer_metrics(answers: DataFrame) -> DataFrame:
    """What an answer's text and citations say: ``answers(answer, citations, answerable)`` with five measures added.

    The sentence rate accepts only single lower-case markers such as [c1].
    """
    body = T.strip(F.coalesce("answer", F.lit("")))
    refuses = F.lower(body) == REFUSAL
    n = F.when(F.col("citations").isNull(), 0).otherwise(F.size("citations"))
    parts = T.sentences(body)
    cited = F.size(F.filter(parts, lambda s: s.rlike(r"\[c\d+\]")))
    return answers.withColumns({
        "is_refusal": refuses, "citation_count": n, "citation_presence_ok": F.when(refuses, n == 0).otherwise(n > 0),
        "inline_citation_sentence_rate": F.when(~refuses & (F.size(parts) > 0), F.round(cited / F.size(parts), 9)),
        "refusal_accuracy": (refuses == ~F.col("answerable")).cast("double"),
    })


def summarize(rows: DataFrame) -> DataFrame:
    """Per ``config``: mean metrics over answerable labelled questions, citation compliance, refusal rate."""
    scored = F.col("answerable") & (F.size("gold") > 0)
    compliance = F.when(F.col("answerable"), F.when(F.col("is_refusal"), 0.0).otherwise((F.col("citation_count") > 0).cast("double")))
    return rows.groupBy("config").agg(*[F.round(F.avg(F.when(scored, F.col(m))), 9).alias(m) for m in ("recall", "mrr", "ndcg")], F.round(F.avg(compliance), 9).alias("citation_compliance"), F.round(F.avg(F.col("is_refusal").cast("double")), 9).alias("refusal_rate"))


def best_config(summary: DataFrame) -> DataFrame:
    """The configuration with the best recall, then MRR, then compliance, then the first name."""
    low = F.lit(-1.0)
    return fuse_first(summary, [F.desc(F.coalesce("recall", low)), F.desc(F.coalesce("mrr", low)), F.desc(F.coalesce("citation_compliance", low)), F.col("config")])


def fuse_first(df: DataFrame, order: list[Column]) -> DataFrame:
    return df.orderBy(*order).limit(1).select("config")


def question_problems(questions: DataFrame, require_labelled: bool = True) -> DataFrame:
    """``qid, problem`` of every broken rule of a question set."""
    qid, gold = T.strip(F.coalesce("qid", F.lit(""))), F.coalesce("gold", F.array().cast(GOLD))
    questions = questions.withColumn("_times", F.count(F.lit(1)).over(W.partitionBy(qid)))
    bad_span = F.exists(gold, lambda g: F.coalesce((T.strip(F.coalesce(g["doc_id"], F.lit(""))) == "") | (g["start_page"] <= 0) | (g["end_page"] <= 0) | (g["start_page"] > g["end_page"]), F.lit(True)))
    rules = [
        F.when(qid == "", "empty_qid"), F.when((qid != "") & (F.col("_times") > 1), "duplicate_qid"), F.when(T.strip(F.coalesce("question", F.lit(""))) == "", "empty_question"),
        F.when(F.col("answerable").isNull(), "answerable_missing"), F.when(bad_span, "bad_gold_span"),
        F.when(F.lit(require_labelled) & F.col("answerable") & (F.size(gold) == 0), "answerable_without_gold"), F.when(~F.col("answerable") & (F.size(gold) > 0), "unanswerable_with_gold"),
    ]
    return questions.select("qid", F.explode(F.array_compact(F.array(*rules))).alias("problem"))


def normalized_questions(questions: DataFrame) -> DataFrame:
    """Stripped fields, sorted gold spans, natural order of ids."""
    span = lambda g: F.struct(T.strip(g["doc_id"]).alias("doc_id"), g["start_page"].alias("start_page"), g["end_page"].alias("end_page"))
    rows = questions.select(T.strip(F.col("qid")).alias("qid"), T.strip(F.col("question")).alias("question"), "answerable", F.array_sort(F.transform(F.coalesce("gold", F.array().cast(GOLD)), span)).alias("gold"))
    return rows.orderBy(*T.qid_order(F.col("qid")))


def page_coverage(pages: DataFrame, expected: DataFrame) -> DataFrame:
    """Per document the pages read against ``expected(doc_id, n_pages)``: ``n, missing, duplicates, out_of_range, ok``.

    Counted per page first, so what is collected per document is bounded by
    its true number of pages.
    """
    per_page = pages.groupBy("doc_id", "page_number").agg(F.count(F.lit(1)).alias("times"))
    seen = expected.join(per_page, "doc_id", "left")
    inside = F.col("page_number").between(1, F.col("n_pages"))
    out = seen.groupBy("doc_id", "n_pages").agg(
        F.coalesce(F.sum("times"), F.lit(0)).alias("n"), F.collect_set(F.when(inside, F.col("page_number"))).alias("have"),
        F.array_sort(F.collect_list(F.when(F.col("times") > 1, F.col("page_number")))).alias("duplicates"), F.count_if(~inside).alias("out_of_range"))
    missing = F.when(F.col("n_pages") > 0, F.array_except(F.sequence(F.lit(1), F.col("n_pages").cast("int")), F.transform("have", lambda x: x.cast("int")))).otherwise(F.array().cast("array<int>"))
    out = out.withColumn("missing", F.array_sort(missing))
    return out.select("doc_id", "n_pages", "n", "missing", "duplicates", "out_of_range", ((F.size("missing") == 0) & (F.size("duplicates") == 0) & (F.col("out_of_range") == 0)).alias("ok"))
