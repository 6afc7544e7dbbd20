"""The graph of documents, sections, algorithms and terms: build, look-up, export."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import text as T
from ..session import checkpointing

# How headers, identifiers, definitions and terms look, and the words that name sections and terms.
HEADER = r"(?im)^\s*(Algorithm\s+\d+\b[^\n]*)"
IDENTIFIERS = [r"\b((?:ML-KEM|ML-DSA|SLH-DSA)(?:\.[A-Za-z0-9_]+)?)\b", r"\b(SHAKE(?:128|256)|KEM|PKE|XOF|PRF|PRG|NTT|CBD|LWE|MLWE|SIS|MSIS|PQC)\b"]
NAME_QUERY = r"\b((?:ML-KEM|ML-DSA|SLH-DSA)(?:\.[A-Za-z0-9_]+)+)\b"
LABEL_QUERY = r"(?i)\bAlgorithm\s+(\d+)\b"
DEFINITION_ROW = r"(?m)^\s*([A-Za-z0-9][A-Za-z0-9 ._()/,-]{1,80}?)\s*\|"
DEFINING = ["terms", "notation", "definitions", "acronyms", "symbols"]
FRONT_MATTER = ["contents", "table of contents", "list of algorithms", "list of figures", "list of tables"]
GENERIC = ["terms", "definitions", "notation", "symbols", "requirements", "external functions", "interoperability", "introduction", "overview"]
PHRASES = [
    "key generation", "encapsulation", "decapsulation", "public key", "secret key", "ciphertext", "shared secret", "parameter set",
    "signature generation", "signature verification",
]
TYPE_ORDER = ["identifier", "acronym", "operation", "concept", "symbol"]


def defines(parts: Column) -> Column:
    """A section that defines terms, by any part of its path."""
    return F.exists(parts, lambda p: F.lower(p).rlike("|".join(DEFINING)))


def front_matter(parts: Column) -> Column:
    """P12."""
    return T.normalize_term(T.leaf_title(parts)).isin(*FRONT_MATTER)


def algorithm_headers(text: Column) -> Column:
    """Distinct ``struct(number, label, name, header)`` of the lines that open an algorithm."""
    def info(line: Column) -> Column:
        line = T.one_line(line)
        number = F.regexp_extract(line, LABEL_QUERY, 1)
        rest = F.btrim(F.regexp_replace(line, r"(?i)^Algorithm\s+\d+", ""), F.lit(" :;-"))
        word = F.btrim(F.split(rest, " ")[0], F.lit("()[]{}:;,."))
        named = word.rlike(r"[._-]") | (word.rlike(r"\p{L}") & (F.upper(word) == word)) | F.substring(word, 2, 1000).rlike(r"\p{Lu}")
        return F.struct(number.alias("number"), F.concat(F.lit("Algorithm "), number).alias("label"), F.when((word != "") & named, word).alias("name"), line.alias("header"))

    return F.array_distinct(F.transform(T.extract_all(F.coalesce(text, F.lit("")), HEADER, 1), info))


def mentioned_algorithms(text: Column) -> Column:
    """Sorted distinct names and labels of algorithms in a text."""
    labels = F.transform(T.extract_all(text, LABEL_QUERY, 1), lambda n: F.concat(F.lit("Algorithm "), n))
    return F.array_sort(F.array_distinct(F.concat(labels, T.extract_all(text, NAME_QUERY, 1))))


def term_type(term: Column) -> Column:
    """X20."""
    norm = T.normalize_term(term)
    operation = norm.isin(*PHRASES) | norm.rlike("(?:generation|encapsulation|decapsulation|verification)$")
    return (
        F.when(norm == "", "concept").when(operation, "operation").when(term.rlike("^[A-Z][A-Z0-9-]{1,10}$"), "acronym")
        .when(term.rlike(r"^[A-Za-z][A-Za-z0-9]*(?:\.[A-Za-z0-9_]+)+$"), "identifier")
        .when(F.contains(term, F.lit("-")) & term.rlike(r"\p{Lu}"), "identifier").when(F.substring(term, 2, 1000).rlike(r"\p{Lu}"), "identifier")
        .when(term.rlike("^[A-Za-z][A-Za-z0-9_]{0,3}$"), "symbol").otherwise("concept")
    )


def clean_term(raw: Column) -> Column:
    """A candidate without section number and marks, or null if it is no term."""
    text = F.btrim(T.one_line(T.strip_section_number(F.regexp_replace(raw, "\n", " "))), F.lit(" .,:;()[]{}"))
    norm = T.normalize_term(text)
    words = F.size(F.split(norm, " "))
    bad = (
        (norm == "") | (F.length(text) > 80) | (words > 6) | ~text.rlike(r"\p{L}") | norm.rlike("^(?:algorithm|table|figure|section) ") | norm.isin(*GENERIC)
        | ((term_type(text) == "concept") & (words == 1) & norm.rlike(r"^\p{L}+$"))
    )
    return F.when(~bad, text)


def phrase_terms(text: Column) -> Column:
    """X16."""
    norm = T.normalize_term(text)
    return F.filter(F.array(*map(F.lit, PHRASES)), lambda p: F.contains(norm, p))


def identifier_terms(text: Column) -> Column:
    """X15."""
    return F.concat(*[T.extract_all(text, p, 1) for p in IDENTIFIERS])


def term_candidates(text: Column, parts: Column) -> Column:
    """Distinct ``struct(norm, form, source, type)``: the first form of every (term, source)."""
    heading = T.strip_section_number(T.leaf_title(parts))
    headers = algorithm_headers(text)
    named = F.flatten(F.transform(headers, lambda h: F.concat(F.array(h["name"]), phrase_terms(h["header"]))))
    definitions = F.when(defines(parts), T.extract_all(text, DEFINITION_ROW, 1)).otherwise(F.array().cast("array<string>"))
    sources = [("definition_section", definitions), ("identifier_regex", identifier_terms(text)), ("algorithm_header", named), ("section_heading", F.concat(identifier_terms(heading), phrase_terms(heading)))]
    def tagged(source: str, terms: Column) -> Column:
        forms = F.filter(F.transform(F.array_compact(terms), clean_term), lambda x: x.isNotNull())
        rows = F.transform(forms, lambda x: F.struct(T.normalize_term(x).alias("norm"), x.alias("form"), F.lit(source).alias("source"), term_type(x).alias("type")))
        return F.filter(rows, lambda r, i: ~F.exists(F.slice(rows, 1, i), lambda e: e["norm"] == r["norm"]))
    return F.concat(*[tagged(s, t) for s, t in sources])


def prefixes(parts: Column) -> Column:
    """All prefixes of a section path, as strings, from the first part on."""
    return F.transform(parts, lambda p, i: T.path_string(F.slice(parts, 1, i + 1)))


def section_edges(chunks: DataFrame) -> DataFrame:
    """Distinct ``doc_id, child, parent`` of the sections on the chunks' paths (parent null at the top)."""
    rows = chunks.select("doc_id", prefixes(T.path_parts(F.col("section_path"))).alias("p")).where(F.size("p") > 0)
    pairs = F.transform("p", lambda x, i: F.struct(x.alias("child"), F.when(i > 0, F.get(F.col("p"), i - 1)).alias("parent")))
    return rows.select("doc_id", F.explode(pairs).alias("e")).select("doc_id", "e.child", "e.parent").distinct()


def anchors(chunks: DataFrame) -> DataFrame:
    """The chunk section in which an algorithm of a document is anchored: ``doc_id, number, label, name, header, section_id, start_page, end_page``.

    Preferred: a section named after an algorithm, then the earliest page, the
    deepest section, the smallest id.  An argmin aggregate, so a document of any
    size is reduced before the shuffle.
    """
    parts = T.path_parts(F.col("section_path"))
    rows = chunks.withColumn("_parts", parts).where((F.size("_parts") > 0) & ~front_matter(F.col("_parts")))
    rows = rows.select("doc_id", "start_page", "end_page", T.make_id("section", F.col("doc_id"), T.path_string(F.col("_parts"))).alias("section_id"), "_parts", "chunk_id", F.posexplode(algorithm_headers(F.col("text"))).alias("n", "h"))
    key = F.struct(
        F.when(F.lower(T.leaf_title(F.col("_parts"))).startswith("algorithm "), 0).otherwise(1).alias("a"), F.coalesce("start_page", F.lit(10**9)).alias("b"),
        (-F.size("_parts")).alias("c"), F.col("section_id").alias("d"), F.col("chunk_id").alias("e"), F.col("n").alias("f"))
    best = rows.withColumn("number", F.col("h.number")).groupBy("doc_id", "number").agg(F.min_by(F.struct("h", "section_id", "start_page", "end_page"), key).alias("m"))
    return best.select("doc_id", "number", "m.h.label", "m.h.name", "m.h.header", "m.section_id", "m.start_page", "m.end_page")


def term_rows(chunks: DataFrame, anchored: DataFrame) -> DataFrame:
    """``term, form, type, source, doc_id, chunk_id, section_id, owns``: one row for every candidate of a chunk (J16: ``owns``: its section has an algorithm)."""
    parts = T.path_parts(F.col("section_path"))
    rows = chunks.withColumn("_parts", parts).where((F.size("_parts") > 0) & ~front_matter(F.col("_parts")))
    rows = rows.select("doc_id", "chunk_id", T.make_id("section", F.col("doc_id"), T.path_string(F.col("_parts"))).alias("section_id"), F.explode(term_candidates(F.coalesce("text", F.lit("")), F.col("_parts"))).alias("c"))
    owners = anchored.select("section_id").distinct().withColumn("owns", F.lit(True))
    return rows.join(owners, "section_id", "left").select(F.col("c.norm").alias("term"), F.col("c.form").alias("form"), F.col("c.type").alias("type"), F.col("c.source").alias("source"), "doc_id", "chunk_id", "section_id", F.coalesce("owns", F.lit(False)).alias("owns"))


def term_sections(rows: DataFrame) -> DataFrame:
    """``term, section_id, doc_id`` and what a section says of a term, one row each: a term of every document is as many rows, never one list."""
    return rows.groupBy("term", "section_id", "doc_id").agg(
        F.max(F.col("source") == "definition_section").alias("defines"), F.max(F.col("owns") | F.col("source").isin("algorithm_header", "section_heading")).alias("anchors"),
        F.max(F.col("source") == "identifier_regex").alias("identifies"), F.min("chunk_id").alias("c1"), F.max("chunk_id").alias("c2"))


def term_stats(rows: DataFrame, places: DataFrame) -> DataFrame:
    """One row per valid term: ``term, display_name, surface_forms, term_type, definition_strength, n_sections, n_docs``.

    Candidates are counted per (term, form) and (term, type) first, so what is
    collected per term are its distinct spellings; sections and documents are
    only counted.
    """
    forms = rows.groupBy("term", "form").agg(F.count(F.lit(1)).alias("n"))
    form_key = F.struct((-F.col("n")).alias("a"), F.when(F.col("form").rlike(r"\p{Lu}"), 0).otherwise(1).alias("b"), F.when(F.col("form").rlike("[._-]"), 0).otherwise(1).alias("c"), F.lower("form").alias("d"), F.col("form").alias("e"))
    best_form = forms.groupBy("term").agg(F.min_by("form", form_key).alias("display_name"), F.array_sort(F.collect_list("form")).alias("surface_forms"))
    types = rows.groupBy("term", "type").agg(F.count(F.lit(1)).alias("n"))
    type_rank = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, TYPE_ORDER)), F.col("type")), F.lit(0)), F.lit(99))
    best_type = types.groupBy("term").agg(F.min_by("type", F.struct((-F.col("n")).alias("a"), type_rank.alias("b"), F.col("type").alias("c"))).alias("term_type"))
    flags = [F.max(c).alias(c) for c in ("defines", "anchors", "identifies")]
    per_doc = places.groupBy("term", "doc_id").agg(F.count(F.lit(1)).alias("n_sections"), *flags, F.min("c1").alias("c1"), F.max("c2").alias("c2"))
    stats = per_doc.groupBy("term").agg(F.sum("n_sections").alias("n_sections"), F.count(F.lit(1)).alias("n_docs"), *flags, F.min("c1").alias("c1"), F.max("c2").alias("c2"))
    valid = F.col("defines") | F.col("identifies") | (F.col("c1") != F.col("c2")) | F.col("anchors")
    strength = F.when(F.col("defines"), "heuristic_definition_section").otherwise("seed").alias("definition_strength")
    return stats.where(valid).join(best_form, "term").join(best_type, "term").select("term", "display_name", "surface_forms", "term_type", strength, "n_sections", "n_docs")


def build(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (D7) and edges (D8) of the chunks (``chunk_id, doc_id, start_page, end_page, section_path, text``)."""
    chunks = chunks.where(T.strip(F.coalesce("doc_id", F.lit(""))) != "")
    doc_id = lambda c: T.make_id("doc", c)
    null_int, no_props = F.lit(None).cast("int"), F.lit("{}")
    spans = chunks.groupBy("doc_id").agg(F.min("start_page").alias("start_page"), F.max("end_page").alias("end_page"))  # A11
    documents = spans.select(doc_id(F.col("doc_id")).alias("node_id"), F.lit("Document").alias("label"), "doc_id", "start_page", "end_page", F.col("doc_id").alias("display_name"), F.to_json(F.struct("doc_id")).alias("properties"))
    paths = chunks.select("doc_id", "start_page", "end_page", F.explode(prefixes(T.path_parts(F.col("section_path")))).alias("path"))
    sections = paths.groupBy("doc_id", "path").agg(F.min("start_page").alias("start_page"), F.max("end_page").alias("end_page"))
    sid = T.make_id("section", F.col("doc_id"), F.col("path"))
    leaf = F.element_at(F.split("path", " > "), -1)
    props = F.to_json(F.struct(F.size(F.split("path", " > ")).alias("depth"), F.col("path").alias("full_section_path"), leaf.alias("leaf_title")))
    sections = sections.select(sid.alias("node_id"), F.lit("Section").alias("label"), "doc_id", "start_page", "end_page", leaf.alias("display_name"), props.alias("properties"))
    checkpointing(chunks.sparkSession)
    anchored = anchors(chunks).checkpoint()  # read by the nodes, the edges and the terms
    alg = T.make_id("alg", F.col("doc_id"), F.col("number"))
    props = F.to_json(F.struct(F.col("label").alias("algorithm_label"), F.col("name").alias("algorithm_name"), F.col("number").alias("algorithm_number"), F.col("header").alias("raw_header"), "section_id"))
    algorithms = anchored.select(alg.alias("node_id"), F.lit("Algorithm").alias("label"), "doc_id", "start_page", "end_page", F.col("label").alias("display_name"), props.alias("properties"))
    candidates = term_rows(chunks, anchored).checkpoint()
    places = term_sections(candidates)
    terms = term_stats(candidates, places).checkpoint()
    places = places.join(terms.select("term"), "term", "left_semi")
    tid = T.make_id("term", F.col("term"))
    props = F.to_json(F.struct("definition_strength", F.col("term").alias("normalized_term"), "surface_forms", "term_type"))
    term_nodes = terms.select(tid.alias("node_id"), F.lit("Term").alias("label"), F.lit(None).cast("string").alias("doc_id"), null_int.alias("start_page"), null_int.alias("end_page"), "display_name", props.alias("properties"))
    nodes = documents.unionByName(sections).unionByName(algorithms).unionByName(term_nodes)

    def edges(df: DataFrame, kind, source: Column, target: Column, doc: Column, start: Column, end: Column) -> DataFrame:
        kind = F.lit(kind) if isinstance(kind, str) else kind
        return df.select(T.make_id("edge", kind, source, target).alias("edge_id"), kind.alias("type"), source.alias("source_id"), target.alias("target_id"), doc.alias("doc_id"), start.alias("start_page"), end.alias("end_page"), no_props.alias("properties"))

    c = F.col
    child = section_edges(chunks).where("parent is not null").select(T.make_id("section", c("doc_id"), c("child")).alias("node_id"), T.make_id("section", c("doc_id"), c("parent")).alias("up"))
    child = child.join(sections.select("node_id", "doc_id", "start_page", "end_page"), "node_id")
    where = places.select("term", "section_id", F.when(c("defines"), "DEFINED_IN").otherwise("APPEARS_IN").alias("kind"))
    where = where.join(sections.select(c("node_id").alias("section_id"), "doc_id", "start_page", "end_page"), "section_id", "left")
    all_edges = [
        edges(sections, "IN_DOCUMENT", c("node_id"), doc_id(c("doc_id")), c("doc_id"), c("start_page"), c("end_page")),
        edges(child, "CHILD_OF", c("node_id"), c("up"), c("doc_id"), c("start_page"), c("end_page")),
        edges(anchored, "APPEARS_IN", alg, c("section_id"), c("doc_id"), c("start_page"), c("end_page")),
        edges(anchored, "IN_DOCUMENT", alg, doc_id(c("doc_id")), c("doc_id"), c("start_page"), c("end_page")),
        edges(where, c("kind"), tid, c("section_id"), c("doc_id"), c("start_page"), c("end_page")),
        edges(places.select("term", c("doc_id").alias("d")).distinct(), "IN_DOCUMENT", tid, doc_id(c("d")), c("d"), null_int, null_int),
    ]
    result = all_edges[0]
    for e in all_edges[1:]:
        result = result.unionByName(e)
    return nodes, result


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The rows of both, the new one where both have a key."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def sorted_graph(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """L07."""
    return nodes.orderBy("label", F.coalesce("doc_id", F.lit("")), "node_id"), edges.orderBy("type", "source_id", "target_id", F.coalesce("doc_id", F.lit("")))


# ---- look-up ---------------------------------------------------------------------------------------------

def tiers(queries: DataFrame, keys: DataFrame) -> DataFrame:
    """Of ``keys(tier, key, ...)`` those of the lowest tier that matches each of ``queries(qid, key)``."""
    hit = queries.join(keys, "key")
    return hit.withColumn("_first", F.min("tier").over(W.partitionBy("qid"))).where(F.col("tier") == F.col("_first")).drop("_first")


def term_keys(nodes: DataFrame) -> DataFrame:
    """``tier, key, node_id``: terms by normal form, by surface form, by display name."""
    rows = nodes.where("label = 'Term'").select("node_id", "display_name", F.from_json("properties", "normalized_term string, surface_forms array<string>").alias("p"))
    norm = rows.select(F.lit(1).alias("tier"), T.normalize_term(F.coalesce("p.normalized_term", "display_name")).alias("key"), "node_id")
    surface = rows.select("node_id", F.explode("p.surface_forms").alias("f")).select(F.lit(2).alias("tier"), T.normalize_term(F.col("f")).alias("key"), "node_id")
    display = rows.select(F.lit(3).alias("tier"), T.normalize_term(F.col("display_name")).alias("key"), "node_id")
    return norm.unionByName(surface).unionByName(display).where("key <> ''").distinct()


REASONS = {1: "exact_normalized_term", 2: "surface_form", 3: "display_name"}


def lookup_terms(queries: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``qid, match_reason, anchors, doc_ids, section_ids`` of ``queries(qid, query[, doc_ids])``; only matched queries.

    Sections that define a term come before those that mention it.  With
    ``doc_ids`` given, only their sections count, and their documents if any.
    """
    scope = F.coalesce("doc_ids", F.array().cast("array<string>")) if "doc_ids" in queries.columns else F.array().cast("array<string>")
    asked = queries.select("qid", T.normalize_term(F.col("query")).alias("key"), scope.alias("scope")).where("key <> ''")
    found = tiers(asked, term_keys(nodes)).join(nodes.select("node_id", "display_name"), "node_id")
    links = found.join(edges.select(F.col("source_id").alias("node_id"), "type", "target_id", F.col("doc_id").alias("edge_doc")), "node_id", "left")
    open_scope = F.size("scope") == 0
    section = F.col("type").isin("DEFINED_IN", "APPEARS_IN") & (open_scope | F.array_contains("scope", F.col("edge_doc")))
    order = F.struct(F.col("node_id"), F.when(F.col("type") == "DEFINED_IN", 0).otherwise(1).alias("k"), F.col("target_id"))
    out = links.groupBy("qid", "tier", "scope").agg(
        F.array_sort(F.collect_set("display_name")).alias("anchors"), F.array_sort(F.collect_set(F.when(F.col("type") == "IN_DOCUMENT", F.col("edge_doc")))).alias("docs"),
        F.array_sort(F.collect_set(F.when(section, order))).alias("s"))
    inside = F.array_intersect("docs", "scope")
    docs = F.when(open_scope | (F.size(inside) == 0), F.col("docs")).otherwise(F.array_sort(inside))
    reason = F.create_map(*[x for k, v in REASONS.items() for x in (F.lit(k), F.lit(v))])[F.col("tier")]
    return out.select("qid", reason.alias("match_reason"), "anchors", docs.alias("doc_ids"), F.array_distinct(F.transform("s", lambda x: x["target_id"])).alias("section_ids"))


def algorithm_queries(query: Column) -> tuple[Column, Column]:
    """The labels and names of algorithms in a (normalised) query."""
    labels = F.transform(T.extract_all(query, LABEL_QUERY, 1), lambda n: F.concat(F.lit("Algorithm "), n))
    return T.first_seen(labels, fold=True), T.first_seen(T.extract_all(query, NAME_QUERY, 1), fold=True)


def lookup_algorithms(queries: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``qid, match_reason, anchors, doc_ids, section_ids, ambiguous`` of ``queries(qid, query[, doc_ids])``.

    By name first (tier 1 and on, one per name), then by number, narrowed to
    the documents in which the first name is known as a term, then that term
    itself.
    """
    labels, names = algorithm_queries(T.normalize_identifiers(F.col("query")))
    scope = F.coalesce("doc_ids", F.array().cast("array<string>")) if "doc_ids" in queries.columns else F.array().cast("array<string>")
    asked = queries.select("qid", labels.alias("labels"), names.alias("names"), scope.alias("scope"))
    rows = nodes.where("label = 'Algorithm'").select("node_id", "doc_id", "start_page", F.from_json("properties", "algorithm_number string, algorithm_name string, section_id string").alias("p"))
    rows = rows.select("node_id", "doc_id", F.col("p.section_id").alias("section_id"), F.col("p.algorithm_number").alias("number"), T.normalize_term(T.normalize_identifiers(F.coalesce("p.algorithm_name", F.lit("")))).alias("name"))
    by_name = asked.select("*", F.posexplode("names").alias("n", "asked")).join(rows, T.normalize_term(F.col("asked")) == F.col("name"))
    by_name = by_name.select("qid", "scope", F.col("n").alias("tier"), F.concat(F.array("asked"), "labels").alias("anchors"), F.lit("exact_algorithm_name").alias("match_reason"), "node_id", "doc_id", "section_id")
    hints = lookup_terms(asked.where(F.size("names") > 0).select("qid", F.get("names", F.lit(0)).alias("query"), F.col("scope").alias("doc_ids")), nodes, edges)
    by_number = asked.select("*", F.posexplode("labels").alias("n", "asked")).join(rows, F.regexp_extract("asked", r"\d+", 0) == F.col("number"))
    by_number = by_number.join(hints.select("qid", F.col("doc_ids").alias("hinted")), "qid", "left")
    in_hint = F.coalesce(F.array_contains("hinted", F.col("doc_id")), F.lit(False))
    by_number = by_number.withColumn("_any", F.max(in_hint).over(W.partitionBy("qid", "n"))).where(in_hint | ~F.col("_any"))
    by_number = by_number.select("qid", "scope", (F.col("n") + 1000).alias("tier"), F.array("asked").alias("anchors"), F.when(F.col("_any"), "exact_algorithm_number_name_hint").otherwise("exact_algorithm_number").alias("match_reason"), "node_id", "doc_id", "section_id")
    found = by_name.unionByName(by_number).where((F.size("scope") == 0) | F.array_contains("scope", F.col("doc_id")))
    found = found.withColumn("_t", F.min("tier").over(W.partitionBy("qid"))).where(F.col("tier") == F.col("_t"))
    out = found.groupBy("qid").agg(F.first("match_reason").alias("match_reason"), F.first("anchors").alias("anchors"), F.array_sort(F.collect_set("doc_id")).alias("doc_ids"), F.array_sort(F.collect_set(F.struct("doc_id", "node_id", "section_id"))).alias("s"))
    out = out.select("qid", "match_reason", T.first_seen(F.col("anchors"), fold=True).alias("anchors"), "doc_ids", F.array_distinct(F.transform("s", lambda x: x["section_id"])).alias("section_ids"), (F.size("doc_ids") > 1).alias("ambiguous"))
    rest = hints.join(out.select("qid"), "qid", "left_anti").select("qid", F.concat(F.lit("term_fallback:"), "match_reason").alias("match_reason"), "anchors", "doc_ids", "section_ids", (F.size("doc_ids") > 1).alias("ambiguous"))
    return out.unionByName(rest)


# ---- export ------------------------------------------------------------------------------------------------

def export_rows(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The columns of a graph database's import files."""
    n = nodes.select(F.col("node_id").alias("node_id:ID"), "label", "doc_id", F.col("start_page").alias("start_page:int"), F.col("end_page").alias("end_page:int"), "display_name", F.col("properties").alias("json_properties"))
    e = edges.select("edge_id", F.col("source_id").alias(":START_ID"), F.col("target_id").alias(":END_ID"), F.col("type").alias(":TYPE"), "doc_id", F.col("start_page").alias("start_page:int"), F.col("end_page").alias("end_page:int"), F.col("properties").alias("json_properties"))
    return n, e


def load_script() -> tuple[str, str]:
    """Statements that constrain and load the exported files."""
    number = lambda c: f"CASE WHEN row.`{c}:int` = '' THEN null ELSE toInteger(row.`{c}:int`) END"
    sets = ["n.label = row.label", "n.doc_id = row.doc_id", f"n.start_page = {number('start_page')}", f"n.end_page = {number('end_page')}", "n.display_name = row.display_name", "n.json_properties = row.json_properties"]
    props = ["edge_id: row.edge_id", "doc_id: row.doc_id", f"start_page: {number('start_page')}", f"end_page: {number('end_page')}", "json_properties: row.json_properties"]
    constraint = "CREATE CONSTRAINT node_id_unique IF NOT EXISTS FOR (n:Entity) REQUIRE n.node_id IS UNIQUE;\n"
    load = "LOAD CSV WITH HEADERS FROM 'file:///nodes.csv' AS row MERGE (n:Entity {node_id: row.`node_id:ID`}) SET " + ", ".join(sets) + ";\n"
    load += "LOAD CSV WITH HEADERS FROM 'file:///edges.csv' AS row MATCH (s:Entity {node_id: row.`:START_ID`}) MATCH (t:Entity {node_id: row.`:END_ID`}) "
    load += "CALL apoc.create.relationship(s, row.`:TYPE`, {" + ", ".join(props) + "}, t) YIELD rel RETURN count(rel);\n"
    return constraint, load
