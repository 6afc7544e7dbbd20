"""Queries for single operators that no larger query shows by itself, and SQL for those that join identifiers or classify lines."""
from __future__ import annotations

import sys
import unicodedata
import uuid

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from ..functions import lines as L, text as T
from ..operators import evalkit, evidence, graph, manifest, planner, rewrite
from ..session import checkpointing
from ..sources import files
from ..sources.tables import table
from . import oracles as O
from .datasets import fused, hits, questions, sectioned_chunks

# ---- queries -------------------------------------------------------------------------------------------------


@pandas_udf(StringType())
def _kinds(s: pd.Series) -> pd.Series:
    names = sorted(L.KINDS)
    return s.map(lambda x: " ".join(k for k in names if L.is_kind(x, k)))


def line_kinds(s, d):
    """The lines of all documents by their kinds."""
    rows = table(s, d, "documents").select(F.explode(F.split("text", "\n")).alias("x")).groupBy("x").agg(F.count(F.lit(1)).alias("n"))
    return rows.groupBy(_kinds("x").alias("kinds")).agg(F.sum("n").alias("n"))


def unicode_texts(s, d):
    """T01, T02."""
    return table(s, d, "documents").select("doc_id", F.md5(T.normalize_whitespace(T.normalize_unicode(F.col("text")))).alias("digest"))


def section_paths(s, d):
    """T14."""
    return sectioned_chunks(s, d).groupBy(T.normalize_section_path(F.coalesce("section_path", F.lit(""))).alias("path")).agg(F.count(F.lit(1)).alias("n"))


def clean_topics(s, d):
    """T16."""
    return questions(s, d).select("qid", T.clean_topic(F.col("question")).alias("topic"))


def section_ids(s, d):
    """Ids made and taken apart again."""
    made = sectioned_chunks(s, d).select("chunk_id", T.make_id("section", F.col("doc_id"), F.coalesce("section_path", F.lit(""))).alias("section_id"))
    return made.select("*", T.section_of_id(F.col("section_id"))["doc_id"].alias("doc_id"), T.section_of_id(F.col("section_id"))["path"].alias("path"))


def page_records(s, d):
    """Pages written as JSON lines under other keys, read back and brought to the page schema."""
    rows = table(s, d, "documents").select(F.col("doc_ref").alias("source"), F.col("page_number").cast("string").alias("page"), "text", F.col("doc_id").cast("string").alias("parser_backend"))
    place = f"{checkpointing(s)}/pages-{uuid.uuid4().hex}"
    files.write_jsonl(rows, place)
    read = files.read_jsonl(s, place, "source string, page string, text string, parser_backend string")
    return files.pages_from_records(read).select("doc_id", "page_number", F.md5("text").alias("digest"), "parser_backend")


def question_files(s, d):
    """Questions normalised, written in natural order, read back and numbered."""
    place = f"{checkpointing(s)}/questions-{uuid.uuid4().hex}"
    rows = evalkit.normalized_questions(questions(s, d))
    files.write_jsonl(rows, place)
    read = files.read_jsonl(s, place, files.QUESTIONS)
    prefix, number = F.regexp_extract("qid", r"^([A-Za-z_-]*?)(\d+)$", 1), F.regexp_extract("qid", r"^([A-Za-z_-]*?)(\d+)$", 2).cast("long")
    return read.select("qid", "question", "answerable", F.size("gold").alias("n_gold"), prefix.alias("prefix"), number.alias("number"))


def question_lines(s, d):
    """Questions as plain lines."""
    place = f"{checkpointing(s)}/lines-{uuid.uuid4().hex}"
    table(s, d, "questions").select(F.coalesce(F.regexp_replace("question", r"[\r\n]+", " "), F.lit(" ")).alias("value")).write.text(place)
    return files.read_lines(s, place).groupBy("question").agg(F.count(F.lit(1)).alias("n"))


def appended_terms(s, d):
    """The technical tokens and acronyms of a question's gold documents added to it."""
    docs = F.transform("gold", lambda g: g["doc_id"])
    return questions(s, d).select("qid", T.append_terms(F.col("question"), F.concat(docs, T.technical_tokens(F.col("question")))).alias("text"))


def clamped_scores(s, d):
    """T28."""
    return hits(s, d).select("hit_id", T.clamp01(F.col("score").cast("string"), 0.5).alias("score"))


def natural_order(s, d):
    """The place of every question in natural order."""
    from pyspark.sql import Window as W

    rows = questions(s, d).select("qid", *[k.alias(f"k{i}") for i, k in enumerate(T.qid_order(F.col("qid")))])
    # bounded: one row for every question of an evaluation set
    return rows.select("qid", F.row_number().over(W.partitionBy("k0", "k1").orderBy("k2", "k3")).alias("place"))


def algorithm_steps(s, d):
    """X10, T18."""
    rows = sectioned_chunks(s, d).select("chunk_id", F.posexplode(T.algorithm_steps(F.col("text"))).alias("i", "step"))
    return rows.select("chunk_id", "i", "step.step", F.md5("step.body").alias("digest"))


def algorithm_mentions(s, d):
    """X27."""
    labels, names = graph.algorithm_queries(F.col("question"))
    return questions(s, d).select("qid", F.explode(F.concat(labels, names)).alias("name"))


def planner_modes(s, d):
    """The planner's kind of every question, its topics and the term it defines."""
    q = F.col("question")
    topics = rewrite.plan_topics(q)
    return questions(s, d).select("qid", planner.plan_mode(q, topics, rewrite.assessable(rewrite.protected_spans(q))).alias("mode"), topics["a"].alias("topic_a"), topics["b"].alias("topic_b"), rewrite.plan_definition_term(q).alias("term"))


def document_scopes(s, d):
    """The documents named by a question or its answer, merged with those of its gold."""
    q = questions(s, d)
    named = rewrite.document_scope(F.col("question"))
    gold = F.array_sort(F.array_distinct(F.transform("gold", lambda g: g["doc_id"])))
    return q.select("qid", F.array_join(planner.merge_scope(named, gold), ",").alias("scope"), F.size(named).alias("n_named"))


def defining_sections(s, d):
    """P12, P13, T23."""
    parts = T.path_parts(F.col("section_path"))
    return sectioned_chunks(s, d).where("section_path is not null").groupBy(graph.defines(parts).alias("defines"), graph.front_matter(parts).alias("front")).agg(F.count(F.lit(1)).alias("n"))


def topics_in_texts(s, d):
    """The blocks that hold the leaf title of their section as a topic."""
    leaf = T.strip_section_number(T.leaf_title(T.path_parts(F.col("section_path"))))
    return sectioned_chunks(s, d).where("section_path is not null and text is not null").select("chunk_id", rewrite.topic_in(F.col("text"), leaf).alias("holds"))


def graph_files(s, d):
    """The section nodes as CSV files with the import header, read back."""
    place = f"{checkpointing(s)}/nodes-{uuid.uuid4().hex}"
    edges = graph.section_edges(sectioned_chunks(s, d))
    files.write_csv(edges.select(T.make_id("section", F.col("doc_id"), F.col("child")).alias("node_id:ID"), F.lit("Section").alias("label"), "doc_id"), place)
    read = s.read.option("header", True).csv(place)
    return read.groupBy("label", "doc_id").agg(F.countDistinct("`node_id:ID`").alias("n"))


def stated_roles(s, d):
    """X29 over the chunk texts."""
    return sectioned_chunks(s, d).where("text is not null").groupBy(F.coalesce(rewrite.role(F.col("text")), F.lit("none")).alias("role")).agg(F.count(F.lit(1)).alias("n"))


def stub_answers(s, d):
    """G19."""
    out = evidence.stub_payload(questions(s, d).select("qid", F.col("question").alias("query")), fused(s, d, 8))
    return out.select("qid", F.md5("answer").alias("digest"), F.array_join(F.transform("citations", lambda c: F.concat_ws(":", c["key"], c["chunk_id"])), " ").alias("cited"), "refusal_reason")


def document_hash(s, d):
    """The order-free hash of the documents' columns that are texts or ids."""
    return manifest.table_hash(table(s, d, "documents").select("doc_id", "doc_ref", "lang", "source", "text"))


QUERIES = [
    line_kinds, unicode_texts, section_paths, clean_topics, section_ids, page_records, question_files, question_lines, appended_terms, clamped_scores, natural_order, algorithm_steps, algorithm_mentions,
    planner_modes, document_scopes, defining_sections, topics_in_texts, graph_files, stated_roles, stub_answers, document_hash,
]

# ---- SQL: identifiers (T05, T06) -------------------------------------------------------------------------------

#: White space as the text functions mean it, for a class of RE2.
WS = "\\s\\v\\p{Z}\\x1c-\\x1f\\x{85}"
_PART = "[A-Za-z0-9]+(?:[_-][A-Za-z0-9]+)*"
_CAPS = "[0-9_-]*[A-Z][0-9_-]*[A-Z][A-Z0-9_-]*"
#: What stands before a whole part, and before a part that must not be the end of a longer one.
_BEFORE, _ALONE, _AFTER = "(^|[^A-Za-z0-9\\\\])", "(^|[^A-Za-z0-9\\\\_-]|[^A-Za-z0-9\\\\][_-]|^[_-])", "($|[^A-Za-z0-9\\\\])"


def tied(column: str) -> str:
    """One pass of putting identifiers together."""
    s = f"[{WS}]"
    rules = [f"{_BEFORE}({_PART}){s}*\\\\([._-]){s}*({_PART}){_AFTER}", f"{_BEFORE}({_PART}){s}+([_-]){s}*({_PART}){_AFTER}", f"{_BEFORE}({_PART}){s}*([_-]){s}+({_PART}){_AFTER}"]
    for gap in (f"{s}+(\\.){s}*", f"{s}*(\\.){s}+"):
        rules += [
            f"{_ALONE}([0-9]+){gap}([0-9]+){_AFTER}", f"{_ALONE}([A-Za-z0-9]+(?:[_-][A-Za-z0-9]+)+){gap}([A-Z0-9][A-Za-z0-9]*(?:[_-][A-Za-z0-9]+)*){_AFTER}",
            f"{_ALONE}({_CAPS}){gap}([0-9]+|{_CAPS}){_AFTER}",
        ]
    for rule in rules:
        column = f"regexp_replace({column}, '{rule}', '\\1\\2\\3\\4\\5', 'g')"
    return column


def joined(base: str, key: str, column: str, name: str = "joined") -> str:
    """A common table expression ``name(k, x)``: the texts of ``base`` with identifiers put together, until nothing changes (goes after ``with recursive``)."""
    return f"""{name}_steps as (
  select {key} as k, coalesce({column}, '') as x, 0 as n from {base}
  union all select k, y, n + 1 from (select k, x, n, {tied('x')} as y from {name}_steps) where y <> x),
{name} as (select k, arg_max(x, n) as x from {name}_steps group by k)"""


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{WS}]+|[{WS}]+$', '', 'g')"


def rstrip(x: str) -> str:
    return f"regexp_replace({x}, '[{WS}]+$', '')"


# ---- SQL: lines ---------------------------------------------------------------------------------------------------

_EDGE, _END = "(?:^|[^\\p{L}\\p{N}_])", "(?:$|[^\\p{L}\\p{N}_])"


def signs(x: str) -> dict[str, str]:
    """Boolean SQL expressions for the signs of a line."""
    w = f"[{WS}]"
    body = strip(x)
    bars = f"(length({body}) - length(replace({body}, '|', '')))"
    words = f"list_filter(regexp_extract_all({x}, '[\\p{{L}}\\p{{N}}_]+'), lambda w: regexp_full_match(w, '[A-Za-z]{{2,}}'))"
    symbols = f"len(list_distinct(regexp_extract_all({x}, '[{L.SYMBOLS}]')))"
    cells = f"list_filter(list_transform(string_split({body}, '|'), lambda c: {strip('c')}), lambda c: c <> '')"
    cell_row = f"({bars} >= 3 and regexp_full_match({body}, '[^|]{{0,80}}(?:\\|[^|]{{0,80}}){{2,}}'))"
    latex = f"regexp_matches({x}, '\\$|\\\\[()\\[\\]]')"
    short = f"(len({words}) < 12 and (len(list_filter(regexp_extract_all(lower({x}), '[\\p{{L}}\\p{{N}}_]+'), lambda w: w in ('mod', 'log', 'gcd', 'lcm'))) > 0 or regexp_matches({x}, '{_EDGE}[A-Za-z]{w}*[=<>]{w}*[A-Za-z0-9]{_END}')))"
    formula = f"({symbols} > 1 or ({symbols} = 1 and {short}))"
    no_table = f"(contains({body}, '$$') or contains({body}, '\\dots') or (contains({body}, '||') and not starts_with({body}, '|')))"
    rule = f"regexp_full_match({body}, '\\|?(?:{w}*:?-{{2,}}:?{w}*\\|)+{w}*:?-{{2,}}:?{w}*\\|?')"
    barred = f"({bars} >= 3 and starts_with({body}, '|'))"
    narrow = f"({cell_row} and len({cells}) >= 3 and list_max(list_transform({cells}, lambda c: length(c))) <= 80 and not regexp_matches({body}, '[.!?;:]{w}'))"
    columns = f"(len(regexp_extract_all({rstrip(x)}, ' {{2,}}|\\t+')) > 2 and len({words}) <= 24)"
    indent = f"(starts_with({x}, '    ') or starts_with({x}, chr(9)))"
    operator = f"regexp_matches({x}, '::=|:=|->|<-|[{{}}]|\\[|\\]')"
    opening = f"regexp_matches({x}, '(?i)^{w}*(?:\\p{{Nd}}+\\.|\\(\\p{{Nd}}+\\)|Step{w}+\\p{{Nd}}+[:.]|Algorithm{w}+\\p{{Nd}}+[:.]|(?:Input|Output|Require|Ensure|Given)(?::|{w}))')"
    starts = f"regexp_matches({x}, '(?i)^{w}*(?:(?:Algorithm|Input|Output|Require|Ensure){_END}|Step{w}+\\p{{Nd}}+|[0-9]+\\.)')"
    gaps = f"len(regexp_extract_all({x}, ' {{2,}}|\\t+')) > 1"
    code = f"({indent} or {operator} or {opening})"
    rows = f"(starts_with({body}, '|') or {bars} > 1 or {gaps})"
    mathematical = f"({latex} or {symbols} > 0)"
    text = f"{body} <> ''"
    return {
        "algorithm": f"({text} and ({starts} or {code} or {latex} or {formula}))", "aligned": f"({text} and ({rule} or {barred} or {cell_row} or {columns}) and not {no_table})", "code": f"({text} and {code})",
        "math": f"({text} and ({latex} or {formula}))", "rows": f"({text} and {rows})", "symbols": f"({text} and {mathematical})", "table": f"({text} and ({rule} or {barred} or {narrow}) and not {no_table})",
        "verbatim": f"({text} and ({rows} or {code} or {mathematical}))",
    }


def compatibility() -> str:
    """Rows (sign, what it stands for) of all compatibility signs of the basic plane, from the Unicode tables."""
    pairs = []
    for c in range(0xA0, min(sys.maxunicode, 0xFFFF)):
        if unicodedata.decomposition(chr(c)).startswith("<"):
            pairs.append("(%d, '%s')" % (c, unicodedata.normalize("NFKD", chr(c)).replace("'", "''")))
    return ", ".join(pairs)


def nfkc(base: str, key: str, column: str, name: str = "plain") -> str:
    """A common table expression ``name(k, x)``: compatibility signs replaced, the rest composed, soft hyphens and zero-width signs dropped."""
    return f"""compat as (select * from (values {compatibility()}) as t(c, y)),
{name}_odd as (select {key} as k, {column} as x from {base} where regexp_matches({column}, '[^\\x00-\\x7f]')),
{name}_signs as (select k, unnest(range(1, length(x) + 1)) as i, x from {name}_odd),
{name}_mapped as (select k, string_agg(coalesce(y, x[i]), '' order by i) as x from {name}_signs left join compat on unicode(x[i]) = c group by k),
{name} as (
  select k, regexp_replace(nfc_normalize(x), '[\\x{{ad}}\\x{{200b}}\\x{{200c}}\\x{{200d}}\\x{{feff}}]', '', 'g') as x from {name}_mapped
  union all select {key}, {column} from {base} where not regexp_matches({column}, '[^\\x00-\\x7f]'))"""


def spaced(x: str) -> str:
    """T02."""
    inner = WS.replace("\\s", "\\t\\f\\r ").replace("\\v", "\\x0b")
    x = f"regexp_replace({x}, '\\r\\n?', chr(10), 'g')"
    x = f"regexp_replace({x}, '[{inner}]+(\\n|$)', '\\1', 'g')"
    return strip(f"regexp_replace({x}, '[ \\t]+', ' ', 'g')")


PRETTY = "regexp_replace(regexp_replace(regexp_replace({0}, '\\s+(\\d+\\s*:)', chr(10) || '\\1', 'g'), '(?i)\\s+(for\\s*\\()', chr(10) || '\\1', 'g'), '\\bendctx\\b', 'end ctx', 'g')"


def pretty(x: str) -> str:
    """T18."""
    return f"case when contains({x}, 'Algorithm') or regexp_matches({x}, '\\b\\d+\\s*:\\s*') then {PRETTY.format(x)} else {x} end"


def first_seen(items: str) -> str:
    """W15 without case: the first of every string, in order."""
    return f"list_filter({items}, lambda x, i: list_position(list_transform({items}, lambda y: lower(y)), lower(x)) = i)"


def oracle_sql() -> dict[str, str]:
    w: dict[str, str] = {}
    docs = "documents"
    w["identifiers"] = f"with recursive {joined(docs, 'doc_id', 'text')} select k as doc_id, md5(x) as digest from joined"
    before = "regexp_replace(coalesce(text, ''), '\\r\\n?', chr(10), 'g')"
    for pattern, to in (("(?m)^[ \\t]*```[^\\n]*\\n?", ""), ("(?m)^[ \\t]{0,3}#{1,6}[ \\t]+", ""), ("\\[([^\\]]+)\\]\\([^)]+\\)", "\\1"), ("`", ""), ("\\*{1,2}", ""), ("<[^>\\n]+>", "")):
        before = f"regexp_replace({before}, '{pattern}', '{to}', 'g')"
    after = strip("regexp_replace(regexp_replace(x, '[ \\t]+(\\n|$)', '\\1', 'g'), '\\n{3,}', chr(10) || chr(10), 'g')")
    w["markdown_texts"] = f"with recursive m as (select doc_id, {before} as y from documents), {joined('m', 'doc_id', 'y')} select k as doc_id, md5({after}) as digest from joined"
    layout = "regexp_replace(coalesce(text, ''), '\\r\\n?', chr(10), 'g')"
    for pattern, to in T.ARTEFACTS:
        layout = f"regexp_replace({layout}, '{pattern}', '{to}', 'g')"
    count = lambda x, p: f"len(regexp_extract_all({x}, '{p}'))"
    token = "\\\\quad|&|\\\\\\\\"
    line = strip("y")
    rest = f"regexp_replace({line}, '\\\\quad|\\\\,|&|\\\\\\\\|[{WS}]|[{{}}()]', '', 'g')"
    nonspace = f"[^{WS}]+"
    letter = "[\\p{L}\\p{N}]"
    noise = f"({count(line, token)} >= 14 and {count(line, token)} / greatest(1, {count(line, nonspace)}) >= 0.45 and {count(rest, letter)} <= 40)"
    kept = f"list_filter(list_transform(string_split(x, chr(10)), lambda y: {rstrip('y')}), lambda y: not (regexp_full_match({line}, '(?:[\\x{{302}}\\x{{2c6}}]\\s*)+') or {noise}))"
    tidy = strip(f"regexp_replace(array_to_string({kept}, chr(10)), '\\n{{3,}}', chr(10) || chr(10), 'g')")
    w["layout_sanitized"] = f"with m as (select doc_id, {layout} as x from documents) select doc_id, cast(length({tidy}) as integer) as n from m"

    kinds = signs("x")
    listed = ", ".join(f"case when {kinds[k]} then '{k}' end" for k in sorted(kinds))
    w["line_kinds"] = f"with l as (select unnest(string_split(text, chr(10))) as x from documents), u as (select x, count(*) as n from l group by x) select concat_ws(' ', {listed}) as kinds, cast(sum(n) as bigint) as n from u group by 1"
    w["unicode_texts"] = f"with {nfkc('documents', 'doc_id', 'text')} select doc_id, case when text is null then null else md5({spaced('x')}) end as digest from documents left join plain on doc_id = k"
    section = f"(select distinct on (block_id) block_id, {strip('coalesce(section_path, {0})'.format(repr('')))} as p from structured_blocks where doc_id is not null)"
    w["section_paths"] = f"with recursive {joined(section, 'block_id', 'p')} select lower(x) as path, count(*) as n from joined group by 1"
    w["clean_topics"] = f"with {O.QUESTIONS} select qid, trim({strip('question')}, ' .,:;\"''`[](){{}}') as topic from q"
    w["section_ids"] = f"""with {O.SECTIONED} select chunk_id, 'section::' || doc_id || '::' || coalesce(section_path, '') as section_id, doc_id, coalesce(section_path, '') as path from blocks"""
    w["page_records"] = "select coalesce(nullif(doc_ref, ''), 'unknown_doc') as doc_id, page_number, md5(coalesce(nullif(text, ''), '')) as digest, cast(doc_id as varchar) as parser_backend from documents"
    w["question_files"] = f"with {O.QUESTIONS} select {strip('qid')} as qid, {strip('question')} as question, answerable, cast(len(gold) as integer) as n_gold, regexp_extract(qid, '^([A-Za-z_-]*?)(\\d+)$', 1) as prefix, cast(nullif(regexp_extract(qid, '^([A-Za-z_-]*?)(\\d+)$', 2), '') as bigint) as number from q"
    spaces = strip("regexp_replace(coalesce(question, ''), '[\\r\\n]+', ' ', 'g')")
    w["question_lines"] = f"select {spaces} as question, count(*) as n from questions where {spaces} <> '' group by 1"
    w["appended_terms"] = f"""
with {O.QUESTIONS}, t as (select qid, {strip('question')} as b, list_concat(list_transform(gold, lambda g: g.doc_id), regexp_extract_all(question, '{T.TECHNICAL}')) as terms from q),
e as (select qid, b, list_filter(terms, lambda t: t <> '' and not contains(lower(b), lower(t))) as extra from t)
select qid, case when len(extra) > 0 then trim(b || ' ' || array_to_string(extra, ' ')) else b end as text from e"""
    w["clamped_scores"] = f"with {O.HITS} select hit_id, greatest(0.0::double, least(1.0::double, round(score, 3))) as score from hits"
    w["natural_order"] = f"with {O.QUESTIONS} select qid, cast(row_number() over (partition by regexp_extract(qid, '^([A-Za-z_-]*?)(\\d+)$', 1) order by cast(nullif(regexp_extract(qid, '^([A-Za-z_-]*?)(\\d+)$', 2), '') as bigint), qid) as integer) as place from q"
    step = "^\\s*(\\d+)\\s*:\\s*(.+?)\\s*$"
    w["algorithm_steps"] = f"""
with {O.SECTIONED}, p as (select chunk_id, list_filter(string_split({pretty("coalesce(text, '')")}, chr(10)), lambda x: regexp_matches(x, '^\\s*\\d+\\s*:\\s*\\S'))[1:25] as steps from blocks),
u as (select chunk_id, steps, unnest(range(1, len(steps) + 1)) as j from p)
select chunk_id, cast(j - 1 as integer) as i, cast(regexp_extract(steps[j], '{step}', 1) as integer) as step, md5(regexp_extract(steps[j], '{step}', 2)) as digest from u"""
    label, name = "(?i)\\bAlgorithm\\s+(\\d+)\\b", "\\b((?:ML-KEM|ML-DSA|SLH-DSA)(?:\\.[A-Za-z0-9_]+)+)\\b"
    w["algorithm_mentions"] = f"""
with {O.QUESTIONS}, l as (select qid, list_transform(regexp_extract_all(question, '{label}', 1), lambda n: 'Algorithm ' || n) as a, regexp_extract_all(question, '{name}', 1) as b from q)
select qid, unnest(list_concat({first_seen('a')}, {first_seen('b')})) as name from l"""
    anchors = " , ".join(f"regexp_extract_all(x, '{p}')" for p in rewrite.ANCHORS)
    words = ", ".join(f"case when contains(lower(x), '{a}') then '{a}' end" for a in rewrite.ANCHOR_WORDS)
    names = " , ".join(f"list_transform(regexp_extract_all(x, '{p}'), lambda y: trim(regexp_replace(y, '\\s+', ' ', 'g')))" for p, _, _ in rewrite.ALIASES)
    found = f"list_filter(flatten([{anchors}, [{words}], {names}]), lambda y: y is not null and trim(y) <> '')"
    names_doc = " or ".join(f"regexp_matches(y, '{p}')" for p, _, _ in rewrite.ALIASES)
    spans = f"""with recursive {O.QUESTIONS}, sp as (select qid, question as x, {found} as found from q), spans as (select qid, x, {first_seen('found')} as spans from sp)"""
    w["anchor_spans"] = f"{spans} select qid, unnest(spans) as span from spans"
    forms = []
    for form in rewrite.COMPARE_FORMS:
        a, b = (f"trim(regexp_extract(c, '{form}', {g}), ' .,:;\"''`[](){{}}' || chr(9) || chr(10))" for g in (1, 2))
        forms.append(f"case when {a} <> '' and {b} <> '' and lower({a}) <> lower({b}) then {{'a': {a}, 'b': {b}}} end")
    means, defines = rewrite.PLAN_MEANS, rewrite.PLAN_DEFINES.replace("'", "''")
    trim = "' .,:;?()[]{}'"
    term = f"case when regexp_matches(x, '{means}') then nullif(trim(regexp_extract(x, '{means}', 1), {trim}), '') else nullif(trim(regexp_extract(x, '{defines}', 1), {trim}), '') end"
    w["planner_modes"] = f"""{spans},
t as (select qid, x, list_filter(spans, lambda y: not ({names_doc})) as required, {strip("regexp_replace(x, '[?]+$', '')")} as c from spans),
p as (select *, coalesce({', '.join(forms)}) as topics from t)
select qid, case when topics is not null then 'compare' when len(required) > 0 or contains(lower(x), 'algorithm') or contains(lower(x), 'table') or contains(lower(x), 'shake') then 'algorithm'
  when starts_with(lower(x), 'what is') or starts_with(lower(x), 'what''s') or starts_with(lower(x), 'define') or starts_with(lower(x), 'explain') or regexp_matches(x, '{means}') then 'definition' else 'general' end as mode,
  topics.a as topic_a, topics.b as topic_b, {term} as term from p"""
    scope = ", ".join(f"case when regexp_matches(question, '{p}') then '{doc}' end" for p, doc, _ in rewrite.ALIASES)
    w["document_scopes"] = f"""
with {O.QUESTIONS}, t as (select qid, list_filter([{scope}], lambda x: x is not null) as named, list_sort(list_distinct(list_transform(gold, lambda g: g.doc_id))) as found from q),
m as (select *, list_filter(named, lambda x: list_contains(found, x)) as shared from t)
select qid, array_to_string(case when len(named) = 0 then found when len(shared) > 0 then shared else named end, ',') as scope, cast(len(named) as integer) as n_named from m"""
    w["defining_sections"] = f"""
with {O.SECTIONED}, p as (select {O.PARTS} as p from blocks where section_path is not null)
select len(list_filter(p, lambda x: regexp_matches(lower(x), '{'|'.join(graph.DEFINING)}'))) > 0 as defines,
  trim(regexp_replace(lower(coalesce(p[-1], '')), '\\s+', ' ', 'g')) in ({', '.join(repr(x) for x in graph.FRONT_MATTER)}) as front, count(*) as n from p group by all"""
    title = "regexp_replace(coalesce(p[-1], ''), '^\\s*[A-Z]?\\d+(?:\\.\\d+)*\\b[.)]?\\s*', '')"
    w["topics_in_texts"] = f"""
with {O.SECTIONED}, t as (select chunk_id, regexp_replace(lower(text), '[^a-z0-9]+', '', 'g') as body, {O.PARTS} as p from blocks where section_path is not null and text is not null),
k as (select chunk_id, body, regexp_replace(lower({title}), '[^a-z0-9]+', '', 'g') as topic from t) select chunk_id, topic <> '' and contains(body, topic) as holds from k"""
    w["graph_files"] = f"""
with {O.SECTIONED}, p as (select distinct doc_id, {O.PARTS} as p from blocks where section_path is not null), i as (select doc_id, array_to_string(p[1:unnest(range(1, len(p) + 1))], ' > ') as child from p)
select 'Section' as label, doc_id, count(distinct child) as n from i group by doc_id"""
    roles = " ".join(f"when regexp_matches(text, '(?i)\\b{r}\\b') then '{r}'" for r in rewrite.ROLES)
    w["stated_roles"] = f"with {O.SECTIONED} select case {roles} else 'none' end as role, count(*) as n from blocks where text is not null group by 1"

    # texts as they are stored
    java = "[\\s\\v\\p{Z}\\x{85}]"  # white space as the JVM has it
    trimmed = lambda x: f"regexp_replace({x}, '^{java}+|{java}+$', '', 'g')"
    solid = "[^\\s\\v\\p{Z}\\x{85}]+"
    w["acronym_counts_whole"] = "with t as (select unnest(list_filter(regexp_extract_all(text, '[\\p{L}\\p{N}_]+'), lambda x: regexp_full_match(x, '[A-Z]{2,8}'))) as acronym from documents) select acronym, count(*) as n from t group by acronym"
    w["approx_token_counts_whole"] = f"select doc_id, cast(greatest(1, len(regexp_extract_all(coalesce(text, ''), '{solid}'))) as integer) as n from documents"
    w["token_windows_whole"] = f"""
with t as (select doc_id, regexp_extract_all(coalesce(text, ''), '{solid}') as words from documents),
s as (select doc_id, words, unnest(range(cast(greatest(0, ceil((len(words) - 320) / 256.0)) as bigint) + 1)) as i from t where len(words) > 0)
select doc_id, cast(i as integer) as i, md5(array_to_string(words[i * 256 + 1 : i * 256 + 320], ' ')) as digest from s"""
    w["char_windows_whole"] = f"""
with t as (select doc_id, {trimmed("coalesce(text, '')")} as x from documents),
s as (select doc_id, x, unnest(range(cast(greatest(0, ceil((length(x) - 2200) / 1760.0)) as bigint) + 1)) as i from t where length(x) > 0),
p as (select doc_id, i, {trimmed('substring(x, i * 1760 + 1, 2200)')} as y from s), k as (select doc_id, y, row_number() over (partition by doc_id order by i) - 1 as i from p where y <> '')
select doc_id, cast(i as integer) as i, cast(length(y) as integer) as n, md5(y) as digest from k"""
    parts = lambda x: f"list_filter(string_split(regexp_replace({trimmed(x)}, '([.?!]){java}+', '\\1' || chr(1), 'g'), chr(1)), lambda y: {trimmed('y')} <> '')"
    empty = "coalesce(text, '')"
    w["sentence_counts_whole"] = f"select doc_id, cast(len({parts(empty)}) as integer) as n from documents"
    canon_x = trimmed("regexp_replace(regexp_replace(lower(x), '\\p{Nd}+', '', 'g'), '[ \\t]+', ' ', 'g')")
    w["canon_lines_whole"] = f"with t as (select unnest(string_split(text, chr(10))) as x from documents) select {canon_x} as line, count(*) as n from t group by 1"
    w["previews_whole"] = f"with {O.CHUNKS}, t as (select chunk_id, replace({trimmed('text')}, chr(10), ' ') as x from chunks) select chunk_id, case when length(x) > 80 then left(x, 80) || '...' else x end as preview from t"
    none = "coalesce({}, '')".format
    w["embedding_texts_whole"] = f"""
with {O.SECTIONED}, t as (select chunk_id, {trimmed(none('doc_id'))} as doc, {trimmed(none('section_path'))} as path, {trimmed(none('text'))} as x from blocks)
select chunk_id, md5(case when x <> '' and doc <> '' and path <> '' then doc || ' > ' || path || chr(10) || chr(10) || x else x end) as digest from t"""
    said = trimmed("coalesce(answer, '')")
    w["answer_metrics_whole"] = f"""
with {O.PAIRS}, t as (select pair_id, answerable, {said} as x, coalesce(len(citations), 0) as n from a),
m as (select *, lower(x) = 'not found in provided docs' as refuses, {parts('x')} as s from t)
select pair_id, refuses as is_refusal, cast(n as integer) as citation_count, case when refuses then n = 0 else n > 0 end as citation_presence_ok,
  round(case when not refuses and len(s) > 0 then len(list_filter(s, lambda z: regexp_matches(z, '\\[c\\d+\\]'))) / len(s) end, 6) as rate, cast(refuses = (not answerable) as double) as refusal_accuracy from m"""

    w["enforced_answers_whole"] = f"""
with {O.PAIRS}, t as (select pair_id, {said} as x, coalesce(citations, []) as c from a),
k as (select *, {O.KEYS.format('x')} as used, {parts('x')} as s from t),
r as (select *, lower(x) in ({', '.join(map(repr, evidence.REFUSALS))}) or len(used) = 0 or len(list_filter(used, lambda u: not list_contains(list_transform(c, lambda y: y.key), u))) > 0
  or len(list_filter(s, lambda z: len({O.KEYS.format('z')}) = 0)) > 0 as bad from k)
select pair_id, bad as refused, cast(case when bad then 0 else len(list_filter(c, lambda y: list_contains(used, y.key))) end as integer) as n_used from r"""

    # the lexical index over joined identifiers
    whole = {name: O.oracle_sql()[name] for name in ("index_terms", "index_corpus", "bm25_topk", "bm25_score_texts")}
    index = O.CHUNKS + f",\n{joined('chunks', 'chunk_id', 'text', 'body')},\nlisted as (select vector_id, chunk_id, {O.tokens('x')} as toks from store join body on chunk_id = k)," + O.INDEX.split("as toks from store),", 1)[1]
    for name in ("index_terms", "index_corpus"):
        w[f"{name}_whole"] = whole[name].replace(O.INDEX, index).replace("with ", "with recursive ", 1)
    asked = O.SEARCHED + f",\n{joined('asked', 'qid', 'query', 'said')}"
    w["bm25_topk_whole"] = whole["bm25_topk"].replace(O.INDEX, index).replace(O.SEARCHED, asked).replace(f"{O.tokens('query')}) as term from asked", f"{O.tokens('said.x')}) as term from asked join said on qid = said.k").replace("with ", "with recursive ", 1)
    text = "(select distinct chunk_id, text from fused join asked using (qid) where rk <= 20 and text is not null)"
    w["bm25_score_texts_whole"] = whole["bm25_score_texts"].replace(O.INDEX, index).replace(O.SEARCHED, asked).replace(", pr as (", f", {joined(text, 'chunk_id', 'text', 'shown')}, pr as (").replace(O.tokens("query"), O.tokens("said.x")).replace(
        O.tokens("f.text"), O.tokens("case when f.text is null then '' else shown.x end")).replace("join asked using (qid) where rk <= 20)", "join asked using (qid) join said on f.qid = said.k left join shown on f.chunk_id = shown.k where rk <= 20)").replace("with ", "with recursive ", 1)

    plain = O.oracle_sql()
    said_too = O.QUESTIONS.replace("q as (", "q0 as (") + f",\n{joined('q0', 'qid', 'question', 'said')},\nq as (select q0.* replace (said.x as question) from q0 join said on q0.qid = said.k)"
    shown_too = O.FUSED.replace("fused as (", "fused0 as (") + f""",
{joined("(select chunk_id, max(text) as text from fused0 where text is not null group by chunk_id)", 'chunk_id', 'text', 'shown')},
fused as (select f.* replace (case when f.text is not null then shown.x end as text) from fused0 f left join shown on f.chunk_id = shown.k)"""
    w["rerank_hits_whole"] = plain["rerank_hits"].replace(O.INDEX, index).replace(O.FUSED, shown_too).replace(O.QUESTIONS, said_too).replace("with ", "with recursive ", 1)
    w["miss_causes_whole"] = plain["miss_causes"].replace(plain["rerank_hits"], w["rerank_hits_whole"])

    # cleaning
    v = signs
    done, following = rstrip("o[-1].t"), f"regexp_replace(n.t, '^[{WS}]+', '')"
    goes_on = f"""({done} <> '' and {following} <> '' and right({done}, 1) not in ('.', '!', '?', ';', ':') and not {v(done)['verbatim']} and not {v(following)['verbatim']}
  and not regexp_matches({following}, '^(?:[-*•]|\\p{{Nd}}+\\.|\\(\\p{{Nd}}+\\))[{WS}]+') and (regexp_matches({following}, '^[a-z(]') or (length({done}) >= 60 and regexp_matches({following}, '^[A-Z]'))))"""
    canon = strip("regexp_replace(regexp_replace(lower(y), '\\p{Nd}+', '', 'g'), '[ \\t]+', ' ', 'g')")
    number = f"(?i)^[{WS}]*(?:page[{WS}]*)?\\p{{Nd}}+(?:[{WS}]*of[{WS}]*\\p{{Nd}}+)?[{WS}]*$"
    flat = strip("regexp_replace(x.t, '[ \\t]+', ' ', 'g')")
    w["clean_pages"] = f"""
with recursive boiler as (select doc_id, list(line) as b from ({O.oracle_sql()['boilerplate_lines']}) group by doc_id),
{O.PAGES.replace('pages as', 'own as')}, {nfkc('own', 'page_id', "coalesce(text, '')")},
n as (select page_id, b, regexp_replace({spaced('x')}, '([A-Za-z])-\\n([a-z])', '\\1\\2', 'g') as x from own join plain on page_id = k left join boiler using (doc_id)),
ls as (select page_id, list_transform(list_filter(string_split(x, chr(10)), lambda y: not regexp_matches(y, '{number}') and not coalesce(list_contains(b, {canon}), false)), lambda y: {rstrip('y')}) as l from n),
el as (select page_id, list_transform(l, lambda y: {{'t': y, 'p': {strip('y')} <> '' and not {v('y')['verbatim']}}}) as l from ls),
walk as (
  select page_id, l, 0 as i, cast([] as struct(t varchar, p boolean)[]) as o from el
  union all
  select page_id, l, i + 1, case when {strip('n.t')} = '' then case when len(o) = 0 or o[-1].t <> '' then list_append(o, {{'t': '', 'p': false}}) else o end
    when len(o) > 0 and o[-1].p and {goes_on} then list_append(o[:-2], {{'t': o[-1].t || ' ' || {following}, 'p': true}}) else list_append(o, n) end
  from (select *, l[i + 1] as n from walk where i < len(l))),
fin as (select page_id, {strip("array_to_string(list_transform(o, lambda x: case when x.p then " + flat + " else x.t end), chr(10))")} as x from walk where i = len(l))
select page_id, cast(length(x) as integer) as n, md5(x) as digest from fin"""

    group_lines = f"list_filter(list_transform(string_split(g, chr(10)), lambda y: {rstrip('y')}), lambda y: {strip('y')} <> '')"
    kind = lambda y: f"({v(y)['aligned']} or {v(y)['code']} or {v(y)['math']})"
    blank = WS.replace("\\s", "\\t\\f\\r ").replace("\\v", "\\x0b")
    join2 = "array_to_string({}, chr(10) || chr(10))".format
    w["chunk_v1"] = w["clean_pages"].split("select page_id, cast(length(x)")[0].rstrip() + f""",
sections as (select page_id, string_split(regexp_replace(x, '\\n(?:[{blank}]*\\n)+', chr(1), 'g'), chr(1)) as gs from fin),
lined as (select page_id, list_filter(list_transform(gs, lambda g: {group_lines}), lambda g: len(g) > 0) as gs from sections),
blocks as (select page_id, list_filter(list_transform(gs, lambda g: case when len(list_filter(g, lambda y: {kind('y')})) >= greatest(1, len(g) // 2) then {strip('array_to_string(g, chr(10))')}
  else array_to_string(list_transform(g, lambda y: {strip('y')}), ' ') end), lambda y: y <> '') as bs from lined),
pack as (
  select page_id, bs, 0 as i, cast([] as varchar[]) as held, cast([] as varchar[]) as done from blocks
  union all
  select page_id, bs, i + 1, case when single then h2 else list_append(h2, b) end, case when single then list_append(o1, b) else o1 end
  from (select *, (length(b) > 2200 and len(held) = 0) or (c and length(b) > 2200 and len(h2) = 0) as single
    from (select *, case when c and len(h1) > 0 and length({join2('h1')}) + 2 + length(b) > 2200 then [] else h1 end as h2
      from (select *, case when c and len(held) > 0 and size >= 250 then list_append(done, {join2('held')}) else done end as o1, case when c then held[-1:] else held end as h1
        from (select *, not (length(b) > 2200 and len(held) = 0) and total > 1400 and (total > 2200 or size >= 250) as c
          from (select *, size + length(b) + case when len(held) > 0 then 2 else 0 end as total from (select *, bs[i + 1] as b, length({join2('held')}) as size from pack where i < len(bs)))))))),
packed as (select page_id, list_transform(case when length({join2('held')}) >= 250 then list_append(done, {join2('held')}) else done end, lambda y: {strip('y')}) as cs from pack where i = len(bs)),
kept as (select page_id, list_filter(cs, lambda y: y <> '') as cs from packed), cut as (select page_id, cs, unnest(range(1, len(cs) + 1)) as j from kept)
select coalesce(nullif(trim(doc_id), ''), 'unknown_doc') || '::p' || printf('%04d', page_number) || '::c' || printf('%03d', j - 1) as chunk_id, coalesce(nullif(trim(doc_id), ''), 'unknown_doc') as doc_id, page_number as start_page,
  cast(length(cs[j]) as integer) as char_len, cast(greatest(1, length(cs[j]) // 4) as integer) as approx_tokens from cut join own using (page_id)"""

    # evidence, evaluation
    block = f"'[c' || pos || '] ' || doc_id || ' p' || start_page || '-p' || end_page || ' chunk_id=' || chunk_id || chr(10) || {pretty('body')}"
    w["evidence_contexts"] = f"""
with {O.FUSED}, prim as (select * from (select *, row_number() over (partition by qid order by score desc, doc_id, start_page, end_page, chunk_id) as p from fused where rk <= 40) where p <= 6),
d as (select * from prim where regexp_matches(coalesce(text, ''), '[^{WS}]')),
t as (select *, row_number() over (partition by qid order by p) as pos, sum(length(text)) over (partition by qid order by p rows between unbounded preceding and current row) as total from d),
s as (select *, {strip('text')} as body from t where pos <= 6 and (pos = 1 or total <= 12000))
select qid, cast(count(*) as integer) as n, md5(string_agg({block}, chr(10) || chr(10) || '---' || chr(10) || chr(10) order by pos)) as digest from s group by qid"""
    opening = strip(f"left(replace({strip(none('text'))}, chr(10), ' '), 220)")
    w["stub_answers"] = f"""
with {O.FUSED}, {O.QUESTIONS}, t as (select qid, min(case when rk = 1 then {opening} end) as x, string_agg('c' || rk || ':' || chunk_id, ' ' order by rk) as cited from fused where rk <= 2 group by qid)
select q.qid, md5(case when t.qid is null then 'not found in provided docs' else coalesce(nullif(x, ''), {strip('question')}) || ' [c1]' end) as digest, coalesce(cited, '') as cited, case when t.qid is null then 'insufficient_evidence' end as refusal_reason
from q left join t on t.qid = q.qid"""
    filled = ", ".join(f"case when {c} is not null then '\"{c}\":' || to_json({c}) end" for c in ("doc_id", "doc_ref", "lang", "source", "text"))
    w["document_hash"] = f"""
with r as (select sha256('{{' || array_to_string(list_filter([{filled}], lambda x: x is not null), ',') || '}}') as h from documents)
select count(*) as n, cast(sum(cast('0x' || substring(h, 1, 12) as bigint)) as decimal(38, 0)) as digest from r"""
    measured = O.oracle_sql()["retrieval_metrics"]
    w["config_summary"] = f"""
with {O.PAIRS}, {O.QUESTIONS}, m as (select qid, recall, mrr, ndcg from ({measured}) where k = 8),
t as (select coalesce(nullif(notes, ''), 'plain') as config, a.answerable, len(q.gold) > 0 and a.answerable as scored, lower({strip("coalesce(answer, '')")}) = 'not found in provided docs' as refuses, coalesce(len(citations), 0) as n, recall, mrr, ndcg
  from a join q using (qid) left join m using (qid) where a.answerable is not null)
select config, round(avg(case when scored then recall end), 9) as recall, round(avg(case when scored then mrr end), 9) as mrr, round(avg(case when scored then ndcg end), 9) as ndcg,
  round(avg(case when answerable then case when refuses or n = 0 then 0.0 else 1.0 end end), 9) as citation_compliance, round(avg(case when refuses then 1.0 else 0.0 end), 9) as refusal_rate from t group by config"""
    w["question_report"] = f"""
with {O.FUSED}, {O.QUESTIONS}, m as (select qid, recall, mrr, ndcg from ({measured}) where k = 8),
g as (select qid, unnest(gold) as g from q), b as (select f.qid, cast(min(f.rk) as integer) as before from fused f join g on f.qid = g.qid and f.doc_id = g.g.doc_id and f.start_page <= g.g.end_page and f.end_page >= g.g.start_page group by f.qid)
select qid, recall, mrr, ndcg, before, case when before <= 40 then before end as after,
  case when before is null then 'upstream_missing' when before > 40 then 'outside_pool' when before <= 8 then 'retained_or_recovered' else 'rerank_insufficient_promotion' end as cause
from m left join b using (qid)"""
    return w
