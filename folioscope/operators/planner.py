"""Query plans: the deterministic analysis, its merge with a suggested one, and with graph look-ups."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as T
from . import rewrite as R

#: Words that bring a topic's document nearer.
TOPIC_BIAS = [("ml-kem", ["FIPS 203", "ML-KEM"]), ("ml-dsa", ["FIPS 204", "ML-DSA"]), ("slh-dsa", ["FIPS 205", "SLH-DSA"])]


def empty() -> Column:
    return F.array().cast("array<string>")


def topic_bias(topic: Column) -> Column:
    """Q26: the document and scheme names of a topic."""
    found = empty()
    for word, terms in reversed(TOPIC_BIAS):
        found = F.when(F.lower(topic).contains(word), F.array(*map(F.lit, terms))).otherwise(found)
    return F.when(topic.isNull(), empty()).otherwise(found)


def plan_mode(query: Column, topics: Column, required: Column) -> Column:
    """Q04."""
    q = F.lower(T.strip(query))
    defines = R.starts_with_any(q, ["what is", "what's", "define", "explain"]) | query.rlike(R.PLAN_MEANS)
    return F.when(topics.isNotNull(), "compare").when((F.size(required) > 0) | R.has_any(q, ["algorithm", "table", "shake"]), "algorithm").when(defines, "definition").otherwise("general")


def missing_from(terms: Column, text: Column) -> Column:
    return F.filter(terms, lambda t: ~F.contains(F.lower(text), F.lower(t)))


def analyse(queries: DataFrame) -> DataFrame:
    """Q26: the deterministic plan (D16) of every ``qid, query``."""
    q = F.col("original_query")
    d = queries.select("qid", T.strip(F.col("query")).alias("original_query"))
    d = d.withColumns({
        "normal": T.normalize_identifiers(q), "compare_topics": R.plan_topics(q), "protected_spans": R.protected_spans(q), "doc_ids": R.document_scope(q),
        "doc_family": R.document_family(q), "term": R.plan_definition_term(q),
    })
    d = d.withColumn("required_anchors", R.assessable(F.col("protected_spans")))
    d = d.withColumn("mode_hint", plan_mode(q, F.col("compare_topics"), F.col("required_anchors")))
    a, b, mode = F.col("compare_topics.a"), F.col("compare_topics.b"), F.col("mode_hint")
    is_compare, is_definition, is_algorithm = mode == "compare", mode == "definition", mode == "algorithm"
    canonical = F.when(is_compare, F.concat(a, F.lit(" vs "), b, F.lit(" intended use-cases definition key properties"))).when(is_definition & F.col("term").isNotNull(), F.col("term")).otherwise(F.col("normal"))
    d = d.withColumn("canonical_query", canonical)
    target = F.coalesce("term", F.nullif("canonical_query", F.lit("")), "normal")
    tokens = missing_from(F.col("protected_spans"), F.col("normal"))
    pair = F.concat(a, F.lit(" "), b, F.lit(" intended use-cases comparison"))
    base = F.coalesce(F.nullif("normal", F.lit("")), "canonical_query")
    sparse = (
        F.when(is_compare, T.append_terms(pair, F.concat("protected_spans", topic_bias(a), topic_bias(b))))
        .when(is_definition, T.append_terms(target, F.concat(F.array(F.lit("definition")), tokens))).otherwise(T.append_terms(base, tokens))
    )
    anchor_text = F.coalesce(F.nullif(F.array_join("required_anchors", " "), F.lit("")), F.nullif("canonical_query", F.lit("")), "normal")
    family = F.col("doc_family")
    dense = (
        F.when(is_compare, F.concat(F.lit("compare intended use-cases and deployment differences between "), a, F.lit(" and "), b))
        .when(is_definition, F.concat(F.lit("definition and notation for "), target, F.coalesce(F.concat(F.lit(" in "), family), F.lit(" in NIST PQC standards"))))
        .when(is_algorithm, F.concat(F.lit("steps and procedure for "), anchor_text, F.coalesce(F.concat(F.lit(" in "), family), F.lit("")))).otherwise(base)
    )
    subs = F.when(is_compare, F.array(*[F.concat(t, F.lit(" intended use-cases and deployment context")) for t in (a, b)])).otherwise(empty())
    rewritten = is_compare | (is_definition & (F.lower(T.normalize_identifiers(target)) != F.lower("normal")))
    score = (
        F.lit(0.52) + F.when(F.col("compare_topics").isNotNull(), 0.16).otherwise(0.0) + F.when(F.size("protected_spans") > 0, 0.12).otherwise(0.0)
        + F.when(F.size("doc_ids") > 0, 0.08).otherwise(0.0) + F.when(F.col("term").isNotNull(), 0.05).otherwise(0.0)
    )
    d = d.withColumns({
        "sparse_query": sparse, "dense_query": dense, "subqueries": subs, "rewrite_needed": rewritten, "confidence": F.least(F.lit(0.95), F.round(score, 3)),
        "answer_prompt_question": F.coalesce(F.nullif(q, F.lit("")), "canonical_query"), "analysis_notes": F.lit("deterministic-fallback"),
    })
    return d.drop("normal", "term")


def merge_suggestion(plans: DataFrame, suggestions: DataFrame) -> DataFrame:
    """Q27: plans with the accepted parts of ``suggestions(qid, reply)``, a generator's JSON; whatever is missing or invalid stays.

    Queries are clipped, the mode must be known, protected spans are only
    added to, the confidence is clamped.
    """
    shape = "canonical_query string, mode_hint string, sparse_query string, dense_query string, subqueries array<string>, protected_spans array<string>, confidence string, analysis_notes string"
    s = suggestions.select("qid", F.from_json(T.json_object(F.col("reply")), shape).alias("s"))
    d = plans.join(s, "qid", "left")
    given = F.col("s").isNotNull()
    text = lambda name, limit: F.when(given & (T.strip(F.coalesce(F.col(f"s.{name}"), F.lit(""))) != ""), T.clip(F.coalesce(F.col(f"s.{name}"), F.lit("")), F.col(name), limit)).otherwise(F.col(name))
    ok_mode = F.col("s.mode_hint").isin(*R.MODES) & ((F.col("s.mode_hint") != "compare") | F.col("compare_topics").isNotNull())
    spans = T.first_seen(F.concat("protected_spans", F.coalesce("s.protected_spans", empty())), fold=True)
    return d.withColumns({
        "canonical_query": text("canonical_query", 240), "sparse_query": text("sparse_query", 320), "dense_query": text("dense_query", 320),
        "mode_hint": F.when(given & ok_mode, F.col("s.mode_hint")).otherwise(F.col("mode_hint")),
        "subqueries": F.when((F.col("mode_hint") == "compare") & (F.size(F.coalesce("s.subqueries", empty())) > 0), F.slice(T.first_seen(F.col("s.subqueries")), 1, 2)).otherwise(F.col("subqueries")),
        "protected_spans": spans, "required_anchors": R.assessable(spans),
        "confidence": F.when(given, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.round(F.coalesce(F.col("s.confidence").try_cast("double"), F.col("confidence")), 3)))).otherwise(F.col("confidence")),
        "analysis_notes": F.when(given, F.coalesce(F.left("s.analysis_notes", F.lit(240)), F.lit("llm-assisted"))).otherwise(F.col("analysis_notes")),
    }).drop("s")


def merge_scope(existing: Column, found: Column) -> Column:
    """The documents of both, else the existing ones, else the found ones."""
    both = F.array_intersect(existing, found)
    return F.when(F.size(existing) == 0, found).when(F.size(both) > 0, both).otherwise(existing)


def apply_lookup(plans: DataFrame, lookups: DataFrame) -> DataFrame:
    """Q28: plans enriched by graph look-ups (``qid, match_reason, anchors, doc_ids, section_ids``); others stay."""
    found = lookups.select("qid", "match_reason", F.col("anchors").alias("_a"), F.col("doc_ids").alias("_d"), F.col("section_ids").alias("candidate_section_ids"))
    d = plans.join(found, "qid", "left")
    hit = F.col("_a").isNotNull()
    add = lambda c: F.when(hit, T.first_seen(F.concat(c, F.coalesce("_a", empty())), fold=True)).otherwise(F.col(c))
    return d.withColumns({
        "doc_ids": F.when(hit, merge_scope(F.col("doc_ids"), F.col("_d"))).otherwise(F.col("doc_ids")),
        "required_anchors": add("required_anchors"), "protected_spans": add("protected_spans"), "candidate_section_ids": F.coalesce("candidate_section_ids", empty()),
    }).drop("_a", "_d")
