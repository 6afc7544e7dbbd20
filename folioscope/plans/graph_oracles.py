"""SQL of the graph's terms, nodes and edges, and of rewritten queries and plans."""
from __future__ import annotations

from ..operators import graph, planner, rewrite
from . import oracles as O
from .pieces import WS, joined, strip

QUOTE = "'"


def one_line(x: str) -> str:
    return f"trim(regexp_replace({x}, '[{WS}]+', ' ', 'g'))"


def unnumbered(x: str) -> str:
    """T15."""
    return strip(f"regexp_replace({strip(x)}, '^\\s*[A-Z]?\\d+(?:\\.\\d+)*\\b[.)]?\\s*', '')")


def norm(x: str) -> str:
    """T12."""
    return one_line(f"lower({x})")


def term_type(x: str) -> str:
    """X20."""
    n = norm(x)
    return f"""case when {n} = '' then 'concept' when {n} in ({', '.join(map(repr, graph.PHRASES))}) or regexp_matches({n}, '(?:generation|encapsulation|decapsulation|verification)$') then 'operation'
  when regexp_full_match({x}, '[A-Z][A-Z0-9-]{{1,10}}') then 'acronym' when regexp_full_match({x}, '[A-Za-z][A-Za-z0-9]*(?:\\.[A-Za-z0-9_]+)+') then 'identifier'
  when contains({x}, '-') and regexp_matches({x}, '\\p{{Lu}}') then 'identifier' when regexp_matches(substring({x}, 2), '\\p{{Lu}}') then 'identifier' when regexp_full_match({x}, '[A-Za-z][A-Za-z0-9_]{{0,3}}') then 'symbol' else 'concept' end"""


def cleaned(x: str) -> str:
    return f"trim({one_line(unnumbered(f'replace({x}, chr(10), {QUOTE} {QUOTE})'))}, ' .,:;()[]{{}}')"


def is_term(x: str) -> str:
    """X19 of a cleaned candidate."""
    n = norm(x)
    words = f"len(string_split({n}, ' '))"
    return f"""({n} <> '' and length({x}) <= 80 and {words} <= 6 and regexp_matches({x}, '\\p{{L}}') and not regexp_matches({n}, '^(?:algorithm|table|figure|section) ') and {n} not in ({', '.join(map(repr, graph.GENERIC))})
  and not ({term_type(x)} = 'concept' and {words} = 1 and regexp_full_match({n}, '\\p{{L}}+')))"""


def phrases(x: str) -> str:
    """X16."""
    return f"list_filter([{', '.join(map(repr, graph.PHRASES))}], lambda p: contains({norm(x)}, p))"


def identifiers(x: str) -> str:
    """X15."""
    return "list_concat(" + ", ".join(f"regexp_extract_all({x}, '{p}', 1)" for p in graph.IDENTIFIERS) + ")"


_HEADER = graph.HEADER
_WORD = "trim(string_split(trim(regexp_replace(line, '(?i)^Algorithm\\s+\\d+', ''), ' :;-'), ' ')[1], '()[]{}:;,.')"
_NAMED = f"({_WORD} <> '' and (regexp_matches({_WORD}, '[._-]') or (regexp_matches({_WORD}, '\\p{{L}}') and upper({_WORD}) = {_WORD}) or regexp_matches(substring({_WORD}, 2), '\\p{{Lu}}')))"

#: ``cand(term, form, source, type, doc_id, chunk_id, section_id)``, and ``own``: the sections that hold an algorithm.
CANDIDATES = f"""{O.SECTIONED}, parted as (select *, {O.PARTS} as p from blocks where section_path is not null and trim(doc_id) <> ''),
body as (select chunk_id, doc_id, page_number, p, coalesce(text, '') as text, 'section::' || doc_id || '::' || array_to_string(p, ' > ') as section_id, {unnumbered('p[-1]')} as heading from parted
  where len(p) > 0 and {norm('p[-1]')} not in ({', '.join(map(repr, graph.FRONT_MATTER))})),
heads as (select distinct chunk_id, {one_line('line')} as line from (select chunk_id, unnest(regexp_extract_all(text, '{_HEADER}', 1)) as line from body)),
raw as (
  select chunk_id, 'definition_section' as source, unnest(regexp_extract_all(text, '{graph.DEFINITION_ROW}', 1)) as form from body where len(list_filter(p, lambda x: regexp_matches(lower(x), '{'|'.join(graph.DEFINING)}'))) > 0
  union all select chunk_id, 'identifier_regex', unnest({identifiers('text')}) from body
  union all select chunk_id, 'algorithm_header', unnest(list_concat([case when {_NAMED} then {_WORD} end], {phrases('line')})) from heads
  union all select chunk_id, 'section_heading', unnest(list_concat({identifiers('heading')}, {phrases('heading')})) from body),
numbered as (select *, row_number() over () as i from raw where form is not null),
forms as (select chunk_id, source, {cleaned('form')} as form, i from numbered),
firsts as (select chunk_id, source, {norm('form')} as term, arg_min(form, i) as form from forms where {is_term('form')} group by all),
cand as (select f.*, {term_type('form')} as type, doc_id, section_id from firsts f join body using (chunk_id)),
own as (select distinct section_id from ({{anchors}}))"""

_STATS = """shapes as (select term, form, count(*) as n from cand group by all),
shape as (select term, arg_min(form, (-n, case when regexp_matches(form, '\\p{Lu}') then 0 else 1 end, case when regexp_matches(form, '[._-]') then 0 else 1 end, lower(form), form)) as display_name from shapes group by term),
kinds as (select term, type, count(*) as n from cand group by all),
kind as (select term, arg_min(type, (-n, coalesce(list_position({order}, type), 99), type)) as term_type from kinds group by term),
stats as (select term, bool_or(source = 'definition_section') as defines, bool_or(source in ('algorithm_header', 'section_heading') or o.section_id is not null) as anchored, bool_or(source = 'identifier_regex') as known,
  count(distinct chunk_id) as chunks, count(distinct cand.section_id) as n_sections, count(distinct doc_id) as n_docs from cand left join own o on o.section_id = cand.section_id group by term),
terms as (select term, display_name, term_type, case when defines then 'heuristic_definition_section' else 'seed' end as definition_strength, cast(n_sections as integer) as n_sections, cast(n_docs as integer) as n_docs
  from stats join shape using (term) join kind using (term) where defines or known or chunks > 1 or anchored)"""
STATS = _STATS.replace("{order}", repr(graph.TYPE_ORDER))


def append(base: str, terms: str) -> str:
    """T27."""
    b = strip(base)
    extra = f"list_filter({terms}, lambda t: t <> '' and not contains(lower({b}), lower(t)))"
    return f"case when len({extra}) > 0 then trim({b} || ' ' || array_to_string({extra}, ' ')) else {b} end"


def oracle_sql() -> dict[str, str]:
    from .pieces import oracle_sql as single

    w: dict[str, str] = {}
    base, more = O.oracle_sql(), single()
    anchors = base["algorithm_anchors"]
    graphed = CANDIDATES.replace("{anchors}", anchors) + ",\n" + STATS
    w["graph_terms"] = f"with {graphed} select * from terms"
    built = graphed + f""",
alg as (select * from ({anchors}) where trim(doc_id) <> ''),
paths as (select distinct doc_id, p from parted where len(p) > 0), prefix as (select distinct doc_id, array_to_string(p[1:i], ' > ') as path, case when i > 1 then array_to_string(p[1:i-1], ' > ') end as up from (select doc_id, p, unnest(range(1, len(p) + 1)) as i from paths)),
place as (select term, section_id, doc_id, bool_or(source = 'definition_section') as defines from cand where term in (select term from terms) group by all),
nodes as (
  select 'Document' as label, 'doc::' || doc_id as id from (select distinct doc_id from blocks where trim(doc_id) <> '')
  union all select 'Section', 'section::' || doc_id || '::' || path from (select distinct doc_id, path from prefix)
  union all select 'Algorithm', 'alg::' || doc_id || '::' || number from alg union all select 'Term', 'term::' || term from terms),
links as (
  select 'IN_DOCUMENT' as type, 'section::' || doc_id || '::' || path as a, 'doc::' || doc_id as b from (select distinct doc_id, path from prefix)
  union all select 'CHILD_OF', 'section::' || doc_id || '::' || path, 'section::' || doc_id || '::' || up from prefix where up is not null
  union all select 'APPEARS_IN', 'alg::' || doc_id || '::' || number, section_id from alg union all select 'IN_DOCUMENT', 'alg::' || doc_id || '::' || number, 'doc::' || doc_id from alg
  union all select case when defines then 'DEFINED_IN' else 'APPEARS_IN' end, 'term::' || term, section_id from place union all select distinct 'IN_DOCUMENT', 'term::' || term, 'doc::' || doc_id from place),
edges as (select type, 'edge::' || type || '::' || a || '::' || b as id, a, b from links)"""
    w["graph_nodes"] = f"with {built} select label, count(*) as n, count(distinct id) as n_ids from nodes group by label"
    w["graph_edges"] = f"with {built} select type, count(*) as n, count(distinct id) as n_ids from edges group by type"
    w["graph_export"] = f"with {built} select 'node' as kind, id from nodes union all select 'edge', id from edges"
    w["term_lookup"] = f"""with {built} select term as qid, 'exact_normalized_term' as match_reason, cast(count(distinct b) filter (where type = 'IN_DOCUMENT') as integer) as n_docs,
  cast(count(distinct b) filter (where type <> 'IN_DOCUMENT') as integer) as n_sections from terms join edges on a = 'term::' || term where term in ({', '.join(map(repr, graph.PHRASES))}) group by term"""

    said = f"{O.QUESTIONS},\n{joined('q', 'qid', strip('question'))}, s as (select k as qid, x, lower(x) as l from joined where x <> '')"
    modes = base["query_modes"].split("select qid, case", 1)[1].split("end as mode", 1)[0].replace("(x,", "(l,")
    word = "([A-Za-z0-9][A-Za-z0-9._-]*)"
    term = f"coalesce(nullif(trim(regexp_extract(x, '(?i)what\\s+does\\s+{word}\\s+mean', 1), ' .;,:'), ''), nullif(trim(regexp_extract(x, '(?i)(?:definition\\s+of|define|what\\s+is|what(?:''s|\\s+is)|what\\s+does)\\s+{word}', 1), ' .;,:'), ''))"
    topics = [f"trim(regexp_extract(x, '{rewrite.COMPARE}', {g}), ' .;,:')" for g in (1, 2)]
    every = lambda words: " and ".join(f"contains(l, '{x}')" for x in words)
    domain = ", ".join(f"case when {every(words)} then '{text}' end" for words, text in rewrite.DOMAIN_REWRITES)
    defines, compares = "mode = 'definition' and term is not null", "mode = 'compare' and a <> '' and b <> ''"
    items = f"""[x, case when {defines} then 'definition of ' || term end, case when {defines} then term || ' stands for' end, case when {defines} then term || ' notation' end,
  case when {compares} then a || ' intended use-cases' end, case when {compares} then b || ' intended use-cases' end, case when {compares} then a || ' vs ' || b end, case when {every(rewrite.STANDARDS_REWRITE[0])} then '{rewrite.STANDARDS_REWRITE[1]}' end,
  case when len(tech) > 0 then array_to_string(tech, ' ') end, {domain}, 'Algorithm ' || number, 'Algorithm ' || number || ' ML-KEM.KeyGen']"""
    tech = "regexp_extract_all(x, '[A-Za-z0-9]+(?:[-._][A-Za-z0-9]+)+')"
    w["query_variants"] = f"""with recursive {said},
m as (select *, case {modes} end as mode, {term} as term, {topics[0]} as a, {topics[1]} as b, nullif(regexp_extract(x, '(?i)\\balgorithm\\s+(\\d+)\\b', 1), '') as number, list_filter({tech}, lambda y, i: list_position({tech}, y) = i) as tech from s),
v as (select qid, mode, list_filter(list_transform({items}, lambda y: {strip('y')}), lambda y: y is not null and y <> '') as v from m),
u as (select qid, mode, list_filter(v, lambda y, i: list_position(v, y) = i)[1:4] as v from v), n as (select qid, mode, v, unnest(range(1, len(v) + 1)) as i from u)
select qid, mode, cast(i - 1 as integer) as variant_no, v[i] as variant from n"""

    planned = more["planner_modes"]
    spans = more["anchor_spans"].split(" select qid, unnest(spans)")[0]
    families = ", ".join(f"case when regexp_matches(spans.x, '{p}') then '{f}' end" for p, _, f in rewrite.ALIASES)
    scope = " or ".join(f"regexp_matches(x, '{p}')" for p, _, _ in rewrite.ALIASES)
    names_doc = " or ".join(f"regexp_matches(y, '{p}')" for p, _, _ in rewrite.ALIASES)
    bias = lambda c: "case " + " ".join(f"when contains(lower({c}), '{x}') then {terms!r}" for x, terms in planner.TOPIC_BIAS) + " else [] end"
    w["query_plans"] = f"""{spans}, pm as (select * from ({planned})),
{joined('q', 'qid', strip('question'), 'plain')},
d as (select spans.qid, spans.x as x, spans, plain.x as normal, pm.mode as mode_hint, topic_a as a, topic_b as b, term, list_filter(spans, lambda y: not ({names_doc})) as required, list_distinct(list_filter([{families}], lambda y: y is not null)) as fam
  from (select qid, x, spans from spans) spans join plain on plain.k = spans.qid join pm on pm.qid = spans.qid),
c as (select *, case when mode_hint = 'compare' then a || ' vs ' || b || ' intended use-cases definition key properties' when mode_hint = 'definition' and term is not null then term else normal end as canonical_query, case when len(fam) = 1 then fam[1] end as family from d),
t as (select *, coalesce(term, nullif(canonical_query, ''), normal) as target, list_filter(spans, lambda y: not contains(lower(normal), lower(y))) as missing, coalesce(nullif(normal, ''), canonical_query) as base,
  coalesce(nullif(array_to_string(required, ' '), ''), nullif(canonical_query, ''), normal) as anchor from c),
{joined('t', 'qid', 'target', 'aim')}
select t.qid, mode_hint, canonical_query,
  case when mode_hint = 'compare' then {append("(a || ' ' || b || ' intended use-cases comparison')", f"list_concat(list_concat(spans, {bias('a')}), {bias('b')})")}
    when mode_hint = 'definition' then {append('target', "list_concat(['definition'], missing)")} else {append('base', 'missing')} end as sparse_query,
  case when mode_hint = 'compare' then 'compare intended use-cases and deployment differences between ' || a || ' and ' || b
    when mode_hint = 'definition' then 'definition and notation for ' || target || coalesce(' in ' || family, ' in NIST PQC standards')
    when mode_hint = 'algorithm' then 'steps and procedure for ' || anchor || coalesce(' in ' || family, '') else base end as dense_query,
  least(0.95::double, round(0.52::double + case when a is not null then 0.16 else 0 end + case when len(spans) > 0 then 0.12 else 0 end + case when {scope.replace('(x,', '(t.x,')} then 0.08 else 0 end + case when term is not null then 0.05 else 0 end, 3)) as confidence,
  mode_hint = 'compare' or (mode_hint = 'definition' and lower(aim.x) <> lower(normal)) as rewrite_needed
from t join aim on aim.k = t.qid"""
    aliases = lambda x: "coalesce(" + ", ".join(f"case when regexp_matches({x}, '{p}') then '{d}' end" for p, d, _ in rewrite.ALIASES) + ", null)"
    every_doc = ", ".join(f"case when regexp_matches(st.x, '{p}') then '{d}' end" for p, d, _ in rewrite.ALIASES)
    edge, end = "(?:^|[^\\p{L}\\p{M}\\p{Nd}\\p{Pc}])", "(?:$|[^\\p{L}\\p{M}\\p{Nd}\\p{Pc}])"
    w["evidence_assessment"] = f"""{spans}, {O.FUSED}, pm as (select * from ({planned})),
{joined("(select chunk_id, max(text) as text from fused where rk <= 8 and text is not null group by chunk_id)", 'chunk_id', 'text', 'shown')},
ev as (select qid, chunk_id, doc_id, lower(case when text is null then '' else shown.x end) as body from fused left join shown on chunk_id = shown.k where rk <= 8),
st as (select spans.qid, spans.x, list_filter(spans.spans, lambda y: not ({names_doc})) as sp, case when topic_a is null then [] else [topic_a, topic_b] end as tp from spans join pm using (qid)),
ask as (select distinct qid, unnest(list_concat(sp, tp)) as span from st),
{joined('ask', "qid || chr(1) || span", 'span', 'want')},
held as (select distinct ask.qid, span from ask join want on want.k = ask.qid || chr(1) || span join ev on ev.qid = ask.qid
  where want.x <> '' and case when regexp_matches(lower(want.x), '[._-]|\\p{{Nd}}|[{WS}]') then contains(body, lower(want.x)) else regexp_matches(body, '{edge}' || regexp_escape(lower(want.x)) || '{end}') end),
met as (select qid, list(span) as met from held group by qid),
seen as (select qid, count(distinct chunk_id) as hits, count(distinct doc_id) as docs, list_distinct(list(doc_id)) as present from ev group by qid),
d as (select st.*, list_filter([{every_doc}], lambda y: y is not null) as doc_ids, coalesce(hits, 0) as hits, coalesce(docs, 0) as docs, coalesce(present, []) as present, coalesce(met, []) as met from st left join seen using (qid) left join met using (qid)),
e as (select *, list_filter(sp, lambda y: not list_contains(met, y)) as ms, list_filter(tp, lambda y: not list_contains(present, {aliases('y')})) as by_doc, len(list_filter(tp, lambda y: {aliases('y')} is not null)) = 2 as known from d),
f as (select *, case when len(tp) < 2 then [] when len(doc_ids) >= 2 and known and len(by_doc) > 0 then by_doc else list_filter(tp, lambda y: not list_contains(met, y)) end as mt from e),
g as (select qid, hits, docs, list_filter([case when len(doc_ids) > 0 and hits = 0 then 'wrong_doc_scope' end, case when len(ms) > 0 then 'missing_protected_span' end, case when len(tp) = 2 and len(mt) > 0 then 'one_sided_comparison' end,
  case when hits < 2 then 'insufficient_hits' end], lambda y: y is not null) as reasons from f)
select qid, array_to_string(reasons, ',') as reasons, len(reasons) = 0 as sufficient, hits, docs as doc_diversity from g"""
    return w
