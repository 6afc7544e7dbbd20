"""Query understanding and rewriting as column expressions."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as T

# ---- fixed values: what the classifiers and extractors look for ------------------------------------------

MODES = ("definition", "algorithm", "compare", "general")
COMPARE_SIGNS = ["compare", "difference between", "differences between", " vs ", " versus "]
ALGORITHM_SIGNS = ["algorithm", "shake", "table"]
DEFINITION_STARTS = ["define", "what is", "what's", "what does"]
ACRONYMS = ["mlwe", "lwe", "sis", "msis", "kdf"]
COMPARE = r"(?i)(?:compare|comparison\s+of|differences?\s+between)\s+(.+?)\s+(?:and|vs|versus)\s+(.+?)(?:\?|$)"
COMPARE_FORMS = [
    r"(?i)differences?\s+between\s+(.+?)\s+and\s+(.+)$",
    r"(?i)(?:compare|comparison\s+of)\s+(.+?)\s+(?:and|vs|versus)\s+(.+)$",
    r"(?i)(.+?)\s+(?:vs|versus)\s+(.+)$",
]
TERM = r"([A-Za-z0-9][A-Za-z0-9._-]*)"
MEANS = rf"(?i)what\s+does\s+{TERM}\s+mean"
DEFINES = rf"(?i)(?:definition\s+of|define|what\s+is|what(?:'s|\s+is)|what\s+does)\s+{TERM}"
PLAN_MEANS = rf"(?i)what\s+does\s+{TERM}\s+(?:mean|stand\s+for)\b"
PLAN_DEFINES = rf"(?i)(?:what\s+is|what(?:'s|\s+is)|define|explain|definition\s+of)\s+{TERM}"
ALGORITHM_NUMBER = r"(?i)\balgorithm\s+(\d+)\b"
#: Rewrites for queries that hold all of the given words.
DOMAIN_REWRITES = [
    (("ml-kem", "key generation"), "ML-KEM.KeyGen key generation"),
    (("ml-dsa", "signing"), "ML-DSA.Sign"),
    (("ml-dsa", "verify"), "ML-DSA.Verify"),
    (("slh-dsa", "keygen"), "SLH-DSA.KeyGen"),
    (("ml-kem", "decapsulation"), "ML-KEM.Decaps"),
]
STANDARDS_REWRITE = (("pqc", "standards"), "FIPS 203 FIPS 204 FIPS 205 ML-KEM ML-DSA SLH-DSA")
ANCHORS = [r"(?i)\bAlgorithm\s+\d+\b", r"(?i)\bTable\s+\d+\b", r"(?i)\bSection\s+\d+(?:\.\d+)*\b", r"\b[A-Za-z][A-Za-z0-9-]*(?:\.[A-Za-z0-9-]+)+\b"]
ANCHOR_WORDS = ["keygen", "encaps", "decaps", "shake128", "shake256", "xof"]
#: Aliases of documents: pattern, document, family.
ALIASES = [
    (r"(?i)\b(?:fips\s*203|ml-kem)\b", "NIST.FIPS.203", "FIPS 203"),
    (r"(?i)\b(?:fips\s*204|ml-dsa)\b", "NIST.FIPS.204", "FIPS 204"),
    (r"(?i)\b(?:fips\s*205|slh-dsa)\b", "NIST.FIPS.205", "FIPS 205"),
    (r"(?i)\b(?:sp\s*800-227|sp800-227)\b", "NIST.SP.800-227", "SP 800-227"),
    (r"(?i)\b(?:ir\s*8545|nist\s*ir\s*8545)\b", "NIST.IR.8545", "IR 8545"),
    (r"(?i)\b(?:ir\s*8547|nist\s*ir\s*8547)\b", "NIST.IR.8547.ipd", "IR 8547"),
]
ROLES = ["key-encapsulation mechanism", "digital signature scheme", "key establishment scheme"]


def strings(*items: Column) -> Column:
    """The items that are not null, as an array."""
    return F.array_compact(F.array(*items))


def has_any(c: Column, words: list[str]) -> Column:
    found = F.lit(False)
    for w in words:
        found = found | c.contains(w)
    return found


def has_all(c: Column, words) -> Column:
    found = F.lit(True)
    for w in words:
        found = found & c.contains(w)
    return found


def starts_with_any(c: Column, words: list[str]) -> Column:
    found = F.lit(False)
    for w in words:
        found = found | c.startswith(w)
    return found


def extracted(c: Column, pattern: str, trim: str) -> Column:
    """The first group, stripped, or null."""
    return F.nullif(F.btrim(F.regexp_extract(c, pattern, 1), F.lit(trim)), F.lit(""))


def mode(query: Column, hint: Column | None = None) -> Column:
    """Q02: the kind of a (normalised) query, unless a valid hint is given."""
    q = F.lower(query)
    found = F.when(has_any(q, COMPARE_SIGNS), "compare").when(has_any(q, ALGORITHM_SIGNS), "algorithm")
    found = found.when(starts_with_any(q, DEFINITION_STARTS) | q.contains("stands for"), "definition").otherwise("general")
    return found if hint is None else F.when(hint.isin(*MODES), hint).otherwise(found)


def tool_mode(query: Column) -> Column:
    """Q03: the tools' own classifier; it also knows "symbolic"."""
    q = F.lower(query)
    signs = has_any(query, ["§", "(", ")", "η", "k", "d"]) | q.contains("fips")
    found = F.when(has_any(q, ["algorithm", "shake"]), "algorithm").when(signs, "symbolic")
    return found.when(starts_with_any(q, DEFINITION_STARTS[:3]), "definition").otherwise("general")


def definition_term(query: Column) -> Column:
    """The term whose definition a query asks for, or null."""
    trim = " .;,:"
    return F.coalesce(extracted(query, MEANS, trim), extracted(query, DEFINES, trim))


def plan_definition_term(query: Column) -> Column:
    """X23, the planner's form."""
    trim, q = " .,:;?()[]{}", T.strip(query)
    return F.when(q.rlike(PLAN_MEANS), extracted(q, PLAN_MEANS, trim)).otherwise(extracted(q, PLAN_DEFINES, trim))


def compare_topics(query: Column) -> Column:
    """``struct(a, b)`` of a comparison, or null."""
    side = lambda g: F.btrim(F.regexp_extract(query, COMPARE, g), F.lit(" .;,:"))
    return F.when((side(1) != "") & (side(2) != ""), F.struct(side(1).alias("a"), side(2).alias("b")))


def plan_topics(query: Column) -> Column:
    """``struct(a, b)`` of the first of three forms that gives two different topics, or null."""
    q = T.strip(F.regexp_replace(T.strip(query), r"\?+$", ""))
    tries = []
    for form in COMPARE_FORMS:
        a, b = (T.clean_topic(F.regexp_extract(q, form, g)) for g in (1, 2))
        tries.append(F.when((a != "") & (b != "") & (F.lower(a) != F.lower(b)), F.struct(a.alias("a"), b.alias("b"))))
    return F.coalesce(*tries)


def variants(query: Column, resolved: Column, limit: int = 4, templates: bool = True) -> Column:
    """Q01: up to ``limit`` rewrites of a (normalised, stripped) query, itself first."""
    q, term, topics = F.lower(query), definition_term(query), compare_topics(query)
    use = F.lit(templates)
    defines, compares = use & (resolved == "definition") & term.isNotNull(), use & (resolved == "compare") & topics.isNotNull()
    number = F.nullif(F.regexp_extract(query, ALGORITHM_NUMBER, 1), F.lit(""))
    technical = F.array_distinct(T.technical_tokens(query))
    items = [query]
    items += [F.when(defines, x) for x in (F.concat(F.lit("definition of "), term), F.concat(term, F.lit(" stands for")), F.concat(term, F.lit(" notation")))]
    items += [F.when(compares, x) for x in (F.concat(topics["a"], F.lit(" intended use-cases")), F.concat(topics["b"], F.lit(" intended use-cases")), F.concat(topics["a"], F.lit(" vs "), topics["b"]))]
    items.append(F.when(use & has_all(q, STANDARDS_REWRITE[0]), STANDARDS_REWRITE[1]))
    items.append(F.when(F.size(technical) > 0, F.array_join(technical, " ")))
    items += [F.when(has_all(q, words), text) for words, text in DOMAIN_REWRITES]
    items += [F.concat(F.lit("Algorithm "), number), F.concat(F.lit("Algorithm "), number, F.lit(" ML-KEM.KeyGen"))]
    return F.slice(T.first_seen(strings(*items)), 1, limit)


def anchors(query: Column, resolved: Column) -> Column:
    """Q05: the tokens that a good hit should hold, lower case."""
    lower = lambda a: F.transform(a, lambda x: F.lower(x))
    known = strings(*[F.when(F.lower(query).contains(a), a) for a in ACRONYMS])
    more = F.concat(lower(T.acronyms(query)), known, strings(F.lower(definition_term(query))))
    return T.first_seen(F.concat(lower(T.technical_tokens(query)), F.when(resolved == "definition", more).otherwise(F.array().cast("array<string>"))))


def holds_word(text: Column, word: Column) -> Column:
    """Whether ``text`` has ``word`` as a word of its own."""
    return F.rlike(text, F.concat(F.lit(r"(?U)\b\Q"), word, F.lit(r"\E\b")))


def anchor_overlap(words: Column, text: Column) -> Column:
    """How many of the anchors a (normalised, lower-case) text holds."""
    return F.size(F.filter(words, lambda w: F.when(w.rlike("[._-]"), F.contains(text, w)).otherwise(holds_word(text, w))))


def anchor_terms(query: Column) -> Column:
    """Names of algorithms, tables, sections and dotted identifiers, and some key words."""
    found = F.concat(*[T.extract_all(query, p) for p in ANCHORS], strings(*[F.when(F.lower(query).contains(w), w) for w in ANCHOR_WORDS]))
    return T.first_seen(found, fold=True)


def document_spans(query: Column) -> Column:
    """The places where a query names a document."""
    found = F.concat(*[T.extract_all(query, p) for p, _, _ in ALIASES])
    return T.first_seen(F.transform(found, T.one_line), fold=True)


def protected_spans(query: Column) -> Column:
    """X26."""
    return T.first_seen(F.concat(anchor_terms(query), document_spans(query)), fold=True)


def occurs_in(term: Column, text: Column) -> Column:
    """Whether a term stands in a text, white space and case aside, between signs that are no letters or digits."""
    body = F.concat(F.lit(" "), F.regexp_replace(T.normalize_term(text), r"[^\p{L}\p{N}._-]+", " "), F.lit(" "))
    key = T.normalize_term(term)
    return (key != "") & F.contains(body, F.concat(F.lit(" "), key, F.lit(" ")))


def names_document(span: Column) -> Column:
    found = F.lit(False)
    for p, _, _ in ALIASES:
        found = found | span.rlike(p)
    return found


def assessable(spans: Column) -> Column:
    """The protected spans that must be found in the evidence."""
    return F.filter(T.first_seen(spans, fold=True), lambda s: ~names_document(s))


def document_scope(query: Column) -> Column:
    """The documents that a query names, in their fixed order."""
    return strings(*[F.when(query.rlike(p), d) for p, d, _ in ALIASES])


def document_family(query: Column) -> Column:
    """The family of the documents named, if there is only one."""
    found = F.array_distinct(strings(*[F.when(query.rlike(p), f) for p, _, f in ALIASES]))
    return F.when(F.size(found) == 1, F.get(found, F.lit(0)))


def text_holds_span(text: Column, span: Column) -> Column:
    """A span with signs, digits or spaces anywhere in the (normalised, lower-case) text, another as a word."""
    span = F.lower(span)
    return (span != "") & F.when(span.rlike(r"(?U)[._-]|\d|\s"), F.contains(text, span)).otherwise(holds_word(text, span))


def topic_in(text: Column, topic: Column) -> Column:
    """P15."""
    token = T.topic_token(topic)
    return (token != "") & F.contains(T.topic_token(text), token)


def role(text: Column) -> Column:
    """The first of the known roles that a text states, or null."""
    return F.coalesce(*[F.when(text.rlike(rf"(?i)\b{r}\b"), r) for r in ROLES])


def expand(queries: DataFrame, *, fusion: bool = True, templates: bool = True, limit: int = 4) -> DataFrame:
    """``qid, query, mode, variant_no, variant`` of ``qid, query``: one row per rewrite."""
    base = queries.withColumn("query", T.normalize_identifiers(T.strip(F.col("query"))))
    base = base.withColumn("mode", mode(F.col("query"), F.col("mode_hint") if "mode_hint" in queries.columns else None))
    items = variants(F.col("query"), F.col("mode"), limit, templates) if fusion else F.array("query")
    return base.where(F.col("query") != "").select("*", F.posexplode(items).alias("variant_no", "variant"))
