"""The SQL (DuckDB) of the catalogue's queries, written on its own.

A query without an entry cannot be put into SQL (state machines, fix-points,
order-dependent matching); it is held against brute force in the tests.
"""
from __future__ import annotations

# ---- the datasets, as common table expressions ---------------------------------------------------------

CHUNKS = """chunks as (
  select chunk_id, min(doc_id) as doc_id, min(start_page) as start_page, min(end_page) as end_page, max(text) as text
  from chunk_hits where doc_id is not null and chunk_id is not null and text is not null group by chunk_id),
store as (select *, row_number() over (order by doc_id, start_page, chunk_id) - 1 as vector_id from chunks)"""

HITS = """hits as (
  select distinct on (hit_id) hit_id, qid, ranking_id, "rank", score, chunk_id, doc_id, start_page, end_page, text from chunk_hits
  where qid is not null and doc_id is not null and chunk_id is not null and score is not null and not isnan(score))"""

FUSED = HITS + """,
summed as (
  select qid, chunk_id, round(sum(1.0::double / (60 + "rank")), 12) as score, min(doc_id) as doc_id,
         arg_min(start_page, (doc_id, start_page, chunk_id)) as start_page, arg_min(end_page, (doc_id, start_page, chunk_id)) as end_page,
         max(text) as text
  from hits group by qid, chunk_id),
fused as (select * from (select *, row_number() over (partition by qid order by score desc, doc_id, start_page, chunk_id) as rk from summed) where rk <= 60)"""

QUESTIONS = """q as (
  select distinct on (qid) qid, regexp_replace(question, '^\\s+|\\s+$', '', 'g') as question, answerable, category, coalesce(gold, []) as gold
  from questions where qid is not null)"""

SECTIONED = """blocks as (
  select distinct on (block_id) cast(block_id as varchar) as chunk_id, doc_id, page_number, section_path, text from structured_blocks where doc_id is not null)"""

PARTS = "list_filter(list_transform(string_split(section_path, '>'), lambda x: trim(x)), lambda x: x <> '')"

PAGES = "pages as (select doc_ref as doc_id, doc_id as page_id, page_number, text from documents where doc_ref is not null and page_number is not null)"

PAIRS = "a as (select distinct on (pair_id) * from answers)"

WORD = "[a-z0-9]+(?:[-._][a-z0-9]+)+|[a-z0-9]+"


def tokens(column: str) -> str:
    """The list of words of a text, compounds followed by their parts."""
    return f"flatten(list_transform(regexp_extract_all(lower(coalesce({column}, '')), '{WORD}'), lambda t: case when regexp_matches(t, '[-._]') then list_concat([t], regexp_split_to_array(t, '[-._]')) else [t] end))"


PRINTABLE = "[^\\x21-\\x7e]+"
PLAIN = f"regexp_replace(coalesce(text, ''), '{PRINTABLE}', ' ', 'g')"
#: Sentences: RE2 has no look-behind, so the break is marked first.
MARKED = "list_filter(string_split(regexp_replace(trim({0}), '([.?!])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: trim(s) <> '')"
KEYS = "list_distinct(list_transform(flatten(list_transform(regexp_extract_all({0}, '\\[([^\\]]+)\\]', 1), lambda b: regexp_extract_all(b, '(?i)\\bc\\d+\\b'))), lambda k: lower(k)))"

INDEX = CHUNKS + f""",
listed as (select vector_id, chunk_id, {tokens('text')} as toks from store),
lengths as (select vector_id, chunk_id, len(toks) as dl from listed),
postings as (select term, vector_id, count(*) as tf from (select vector_id, unnest(toks) as term from listed) group by all),
corpus as (select count(*) as n_docs, avg(dl) as avgdl from lengths),
terms as (select term, count(*) as df, ln(1 + (max(n_docs) - count(*) + 0.5) / (count(*) + 0.5)) as idf from postings, corpus group by term)"""

SEARCHED = QUESTIONS + """,
asked as (select qid, question as query from q where cast(regexp_extract(qid, '\\d+') as bigint) % 100 = 0)"""

BM25 = "idf * tf * 2.5 / greatest(tf + 1.5 * (0.25 + 0.75 * dl / greatest(avgdl, 1e-9)), 1e-9) * qtf"

VECTORS = """raw as (select vec_id as id, label, cast(embedding as double[]) as e from embeddings),
v as (select id, label, list_transform(e, lambda x: x / sqrt(list_inner_product(e, e))) as e from raw),
near as (
  select a.id as qid, b.id as id, b.label, round(list_inner_product(a.e, b.e), 9) as score,
         row_number() over (partition by a.id order by round(list_inner_product(a.e, b.e), 9) desc, b.id) as rk
  from v a join v b on a.id % 100 = 0)"""

TRACE = """ev as (
  select user_id as run_id, event_id as seq, case when event_type = 'purchase' then 'step' else event_type end as type,
         case when event_type = 'purchase' then 'n' || cast(event_id % 7 as varchar) end as node, value from events),
carried as (
  select run_id, seq, type, coalesce(node, last_value(case when type = 'step' then node end ignore nulls) over w) as node,
         sum(case when type = 'step' then 1 else 0 end) over w as visit
  from ev window w as (partition by run_id order by seq rows between unbounded preceding and current row))"""

GOLD = QUESTIONS + """,
gold as (select qid, unnest(range(len(gold))) as span, unnest(gold) as g from q),
met as (
  select f.qid, f.chunk_id, f.rk, span, g from fused f join gold on f.qid = gold.qid and f.doc_id = g.doc_id
  where rk <= 40 and f.start_page <= g.end_page and f.end_page >= g.start_page),
near as (
  select f.qid, f.rk from fused f join gold on f.qid = gold.qid and f.doc_id = g.doc_id
  where rk <= 40 and f.start_page <= g.end_page + 1 and f.end_page >= g.start_page - 1)"""


def oracle_sql() -> dict[str, str]:
    w = {}
    w["token_stats"] = f"with t as (select doc_id, unnest({tokens('text')}) as term from documents), n as (select term, doc_id, count(*) as n from t group by all) select term, cast(sum(n) as bigint) as tf, count(*) as df from n group by term"
    w["technical_tokens"] = f"with {QUESTIONS}, t as (select qid, unnest(regexp_extract_all(question, '[A-Za-z0-9]+(?:[-._][A-Za-z0-9]+)+')) as token from q) select qid, token, count(*) as n from t group by all"
    w["acronym_counts"] = f"with t as (select unnest(regexp_extract_all({PLAIN}, '\\b[A-Z]{{2,8}}\\b')) as acronym from documents) select acronym, count(*) as n from t group by acronym"
    w["token_windows"] = f"""
with t as (select doc_id, regexp_extract_all(regexp_replace(text, '{PRINTABLE}', ' ', 'g'), '\\S+') as words from documents where text is not null),
s as (select doc_id, words, unnest(range(cast(greatest(0, ceil((len(words) - 320) / 256.0)) as bigint) + 1)) as i from t where len(words) > 0)
select doc_id, cast(i as integer) as i, md5(array_to_string(words[i * 256 + 1 : i * 256 + 320], ' ')) as digest from s"""
    w["char_windows"] = f"""
with t as (select doc_id, regexp_replace(text, '{PRINTABLE}', '_', 'g') as x from documents where text is not null),
s as (select doc_id, x, unnest(range(cast(greatest(0, ceil((length(x) - 2200) / 1760.0)) as bigint) + 1)) as i from t where length(x) > 0)
select doc_id, cast(i as integer) as i, cast(length(substring(x, i * 1760 + 1, 2200)) as integer) as n, md5(substring(x, i * 1760 + 1, 2200)) as digest from s"""
    w["sentence_counts"] = f"select doc_id, cast(len({MARKED.format(PLAIN)}) as integer) as n from documents"
    w["approx_token_counts"] = f"select doc_id, cast(greatest(1, len(regexp_extract_all({PLAIN}, '\\S+'))) as integer) as n from documents"
    w["dehyphenated"] = "select doc_id, md5(regexp_replace(text, '([A-Za-z])-\\n([a-z])', '\\1\\2', 'g')) as digest from documents"
    w["canon_lines"] = """
with t as (select unnest(string_split(text, chr(10))) as x from documents)
select trim(regexp_replace(regexp_replace(lower(x), '\\d+', '', 'g'), '[ \\t]+', ' ', 'g')) as line, count(*) as n from t where regexp_matches(x, '^[\\x20-\\x7e]*$') group by 1"""
    w["page_number_lines"] = "with t as (select doc_id, unnest(string_split(text, chr(10))) as x from documents where text is not null) select doc_id, cast(count(*) filter (where regexp_matches(x, '(?i)^[\\s\\p{Z}]*(?:page[\\s\\p{Z}]*)?\\p{Nd}+(?:[\\s\\p{Z}]*of[\\s\\p{Z}]*\\p{Nd}+)?[\\s\\p{Z}]*$')) as integer) as n from t group by doc_id"
    w["normalized_terms"] = f"with {SECTIONED} select trim(regexp_replace(lower(section_path), '\\s+', ' ', 'g')) as term, count(*) as n from blocks where section_path is not null group by 1"
    w["section_titles"] = f"""
with {SECTIONED}, p as (select {PARTS} as p from blocks where section_path is not null), l as (select len(p) as depth, coalesce(p[-1], '') as leaf from p)
select cast(depth as integer) as depth, leaf, trim(regexp_replace(leaf, '^\\s*[A-Z]?\\d+(?:\\.\\d+)*\\b[.)]?\\s*', '')) as title, count(*) as n from l group by all"""
    w["previews"] = f"""
with {CHUNKS}, t as (select chunk_id, replace(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), chr(10), ' ') as x from chunks where regexp_matches(text, '^[\\x0a\\x20-\\x7e]*$'))
select chunk_id, case when length(x) > 80 then left(x, 80) || '...' else x end as preview from t"""
    w["topic_tokens"] = f"with {QUESTIONS} select qid, regexp_replace(lower(question), '[^a-z0-9]+', '', 'g') as token from q"
    w["slugs"] = f"with {QUESTIONS} select qid, coalesce(nullif(trim(regexp_replace(regexp_replace(question, '[^A-Za-z0-9._-]+', '-', 'g'), '-{{2,}}', '-', 'g'), '._-'), ''), 'eval') as slug from q"
    w["json_objects"] = "select distinct pair_id, nullif(regexp_extract(stdout, '(?s)\\{.*\\}', 0), '') as object from baseline_results"
    w["boilerplate_lines"] = f"""
with {PAGES},
l as (select doc_id, page_id, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\s\\p{{Z}}\\x1c-\\x1f]')) as ls from pages),
n as (select doc_id, count(*) as pages from l where len(ls) > 0 group by doc_id),
e as (select distinct doc_id, page_id, unnest(list_concat(ls[1:3], ls[greatest(1, len(ls) - 2):])) as x from l where len(ls) > 0),
c as (select distinct doc_id, page_id, regexp_replace(regexp_replace(regexp_replace(lower(x), '\\p{{Nd}}+', '', 'g'), '[ \\t]+', ' ', 'g'), '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g') as line from e where length(x) between 3 and 160)
select c.doc_id, line from c join n on c.doc_id = n.doc_id where line <> '' group by c.doc_id, line, pages having count(*) >= greatest(2, floor(0.6 * pages))"""
    w["page_coverage"] = f"""
with {PAGES}, e as (select doc_id, max(page_number) as n_pages from pages group by doc_id),
p as (select doc_id, page_number, count(*) as times from pages group by all)
select e.doc_id, n_pages, cast(sum(times) as bigint) as n, cast(n_pages - count(*) as integer) as n_missing, cast(count(*) filter (where times > 1) as integer) as n_duplicates,
       n_pages = count(*) and max(times) = 1 and min(page_number) >= 1 as ok
from e join p on e.doc_id = p.doc_id group by e.doc_id, n_pages"""
    w["numbered_store"] = f"with {CHUNKS} select vector_id, chunk_id, doc_id, start_page from store"
    w["embedding_texts"] = f"""
with {SECTIONED}, t as (select chunk_id, doc_id, trim(coalesce(section_path, '')) as path, regexp_replace(text, '^\\s+|\\s+$', '', 'g') as x from blocks where regexp_matches(text, '^[\\x0a\\x20-\\x7e]*$'))
select chunk_id, md5(case when x <> '' and path <> '' then doc_id || ' > ' || path || chr(10) || chr(10) || x else x end) as digest from t"""
    w["pages_between"] = f"""
with {CHUNKS}, r as (select doc_id, chunk_id, row_number() over (partition by doc_id order by start_page, chunk_id) as pos from chunks where start_page <= 4 and end_page >= 2)
select doc_id, chunk_id, cast(pos as integer) as pos from r where pos <= 30"""
    w["index_terms"] = f"with {INDEX} select term, df, round(idf, 9) as idf from terms"
    w["index_corpus"] = f"with {INDEX} select n_docs, round(avgdl, 9) as avgdl from corpus"
    w["bm25_topk"] = f"""
with {INDEX}, {SEARCHED}, qt as (select qid, term, count(*) as qtf from (select qid, unnest({tokens('query')}) as term from asked) group by all),
s as (select qid, p.vector_id, round(sum({BM25}), 9) as score from qt join terms using (term) join postings p using (term) join lengths l using (vector_id), corpus group by qid, p.vector_id),
r as (select *, row_number() over (partition by qid order by score desc, vector_id) as rk from s)
select qid, chunk_id, round(score, 6) as score, cast(rk as integer) as "rank" from r join store using (vector_id) where rk <= 8"""
    w["bm25_score_texts"] = f"""
with {INDEX}, {SEARCHED}, {FUSED}, pr as (select f.qid, f.chunk_id, {tokens('query')} as qt, {tokens('f.text')} as tt from fused f join asked using (qid) where rk <= 20),
c as (select qid, chunk_id, len(tt) as dl, unnest(list_distinct(qt)) as term, qt, tt from pr),
n as (select qid, chunk_id, dl, term, len(list_filter(qt, lambda x: x = term)) as qtf, len(list_filter(tt, lambda x: x = term)) as tf from c)
select qid, chunk_id, round(coalesce(sum(case when tf > 0 then {BM25} end), 0), 6) as score from n left join terms using (term), corpus group by qid, chunk_id"""
    w["dense_topk"] = f"with {VECTORS} select qid, id, round(score, 6) as score, cast(rk as integer) as \"rank\" from near where rk <= 10"
    w["page_diverse_topk"] = f"""
with {VECTORS}, top as (select *, row_number() over (partition by qid, label order by rk) as n from near where rk <= 25),
r as (select qid, id, row_number() over (partition by qid order by rk) as p from top where n = 1) select qid, id, cast(p as integer) as "rank" from r where p <= 8"""
    w["normalized_vectors"] = f"with {VECTORS} select id, round(list_inner_product(e, e), 6) as norm, round(e[1], 6) as first from v"
    w["rank_in_ranking"] = f"with {HITS} select hit_id, qid, ranking_id, cast(row_number() over (partition by qid, ranking_id order by score desc, chunk_id, hit_id) as integer) as place from hits"
    w["rrf_fuse"] = f"with {FUSED} select qid, chunk_id, doc_id, start_page, round(score, 9) as score, cast(rk as integer) as \"rank\" from fused"
    w["rank_norms"] = f"""
with {FUSED}, f as (select *, count(*) over (partition by qid) as n, min(score) over (partition by qid) as lo, max(score) over (partition by qid) as hi from fused where rk <= 40)
select qid, chunk_id, round(case when hi > lo then (score - lo) / (hi - lo) else 0 end, 6) as minmax, round(case when n > 1 then 1 - (rk - 1) / (n - 1) else 1 end, 6) as prior from f"""
    w["doc_filter"] = f"with {FUSED} select qid, chunk_id, cast(rk as integer) as \"rank\" from fused where rk <= 40 and doc_id = 'CRB.HB.100'"
    w["query_modes"] = f"""
with {QUESTIONS}, l as (select qid, question, lower(question) as x from q)
select qid, case when contains(x, 'compare') or contains(x, 'difference between') or contains(x, 'differences between') or contains(x, ' vs ') or contains(x, ' versus ') then 'compare'
  when contains(x, 'algorithm') or contains(x, 'shake') or contains(x, 'table') then 'algorithm'
  when starts_with(x, 'define') or starts_with(x, 'what is') or starts_with(x, 'what''s') or starts_with(x, 'what does') or contains(x, 'stands for') then 'definition' else 'general' end as mode,
  case when contains(x, 'algorithm') or contains(x, 'shake') then 'algorithm'
  when regexp_matches(question, '[§()ηkd]') or contains(x, 'fips') then 'symbolic'
  when starts_with(x, 'define') or starts_with(x, 'what is') or starts_with(x, 'what''s') then 'definition' else 'general' end as tool_mode from l"""
    w["compare_topics"] = f"""
with {QUESTIONS}, t as (select qid, regexp_extract(question, '(?i)(?:compare|comparison\\s+of|differences?\\s+between)\\s+(.+?)\\s+(?:and|vs|versus)\\s+(.+?)(?:\\?|$)', ['a', 'b']) as t from q)
select qid, trim(t.a, ' .;,:') as topic_a, trim(t.b, ' .;,:') as topic_b from t where trim(t.a, ' .;,:') <> '' and trim(t.b, ' .;,:') <> ''"""
    term = "([A-Za-z0-9][A-Za-z0-9._-]*)"
    w["definition_terms"] = f"""
with {QUESTIONS}, t as (select qid, coalesce(nullif(trim(regexp_extract(question, '(?i)what\\s+does\\s+{term}\\s+mean', 1), ' .;,:'), ''),
  nullif(trim(regexp_extract(question, '(?i)(?:definition\\s+of|define|what\\s+is|what(?:''s|\\s+is)|what\\s+does)\\s+{term}', 1), ' .;,:'), '')) as term from q)
select qid, term from t where term is not null"""
    w["best_hits"] = f"""
with {HITS}, r as (select *, row_number() over (partition by qid, chunk_id order by score desc, doc_id, start_page, end_page, hit_id) as n, count(*) over (partition by qid, chunk_id, score, doc_id, start_page, end_page) as same from hits)
select qid, chunk_id, score from r where n = 1"""
    w["context_budget"] = f"""
with {FUSED}, t as (select *, row_number() over w as n, sum(length(text)) over (partition by qid order by rk rows between unbounded preceding and current row) as total
  from fused where rk <= 40 and regexp_matches(coalesce(text, ''), '[^\\s\\p{{Z}}]') window w as (partition by qid order by rk))
select qid, chunk_id, cast(n as integer) as pos from t where n <= 6 and (n = 1 or total <= 1500)"""
    w["neighbor_expand"] = f"""
with {FUSED}, {CHUNKS}, p as (select f.qid, f.chunk_id as "of", f.doc_id, f.score, s.vector_id from fused f join store s on f.chunk_id = s.chunk_id and f.doc_id = s.doc_id where rk <= 3)
select qid, "of", cast(s.vector_id - p.vector_id as integer) as delta, s.chunk_id, round(p.score - 1e-6, 9) as score
from p join store s on s.doc_id = p.doc_id and abs(s.vector_id - p.vector_id) = 1"""
    w["citation_keys"] = f"with {PAIRS}, t as (select pair_id, unnest({KEYS.format('answer')}) as key from a) select pair_id, key from t"
    w["answer_problems"] = f"""
with {PAIRS}, t as (select pair_id, lower(trim(answer, ' ' || chr(9) || chr(10) || chr(13) || chr(160) || chr(8203))) = 'not found in provided docs' as refuses, coalesce(citations, []) as c, {KEYS.format('answer')} as used from a where answer is not null)
select pair_id, case when len(list_filter(c, lambda x: x.start_page <= 0 or x.end_page <= 0)) > 0 then 'page_not_positive' when len(list_filter(c, lambda x: x.start_page > x.end_page)) > 0 then 'pages_reversed'
  when refuses and len(c) > 0 then 'refusal_with_citations' when refuses then null when len(c) = 0 then 'no_citations' when len(used) = 0 then 'no_markers'
  when len(list_filter(used, lambda k: not list_contains(list_transform(c, lambda x: x.key), k))) > 0 then 'unknown_markers' end as problem from t"""
    cleaned = f"trim(regexp_replace(answer, '{PRINTABLE}', ' ', 'g'))"
    w["enforced_answers"] = f"""
with {PAIRS}, t as (select pair_id, {cleaned} as x, citations as c from a where answer is not null and citations is not null),
k as (select *, {KEYS.format('x')} as used, {MARKED.format('x')} as s from t),
r as (select *, lower(x) in ('not found', 'not found in documents', 'not found in provided docs') or len(used) = 0 or len(list_filter(used, lambda u: not list_contains(list_transform(c, lambda y: y.key), u))) > 0
  or len(list_filter(s, lambda z: len(regexp_extract_all(z, '(?i)\\[[^\\]]*\\bc\\d+\\b[^\\]]*\\]')) = 0)) > 0 as bad from k)
select pair_id, bad as refused, cast(case when bad then 0 else len(list_filter(c, lambda y: list_contains(used, y.key))) end as integer) as n_used from r"""
    w["answer_metrics"] = f"""
with {PAIRS}, t as (select pair_id, answerable, trim(regexp_replace(coalesce(answer, ''), '{PRINTABLE}', ' ', 'g')) as x, coalesce(len(citations), 0) as n from a where answerable is not null),
m as (select *, lower(x) = 'not found in provided docs' as refuses, {MARKED.format('x')} as s from t)
select pair_id, refuses as is_refusal, cast(n as integer) as citation_count, case when refuses then n = 0 else n > 0 end as citation_presence_ok,
  round(case when not refuses and len(s) > 0 then len(list_filter(s, lambda z: regexp_matches(z, '\\[c\\d+\\]'))) / len(s) end, 6) as rate, cast(refuses = (not answerable) as double) as refusal_accuracy from m"""
    header = "(?im)^\\s*(Algorithm\\s+\\d+\\b[^\\n]*)"
    w["algorithm_headers"] = f"""
with {CHUNKS}, h as (select distinct chunk_id, trim(regexp_replace(unnest(regexp_extract_all(text, '{header}', 1)), '\\s+', ' ', 'g')) as line from chunks)
select chunk_id, regexp_extract(line, '(?i)\\bAlgorithm\\s+(\\d+)\\b', 1) as number, count(*) as n from h group by all"""
    w["mentioned_algorithms"] = f"with {CHUNKS}, m as (select distinct chunk_id, 'Algorithm ' || unnest(regexp_extract_all(text, '(?i)\\bAlgorithm\\s+(\\d+)\\b', 1)) as name from chunks) select chunk_id, name from m"
    phrases = ["key generation", "encapsulation", "decapsulation", "public key", "secret key", "ciphertext", "shared secret", "parameter set", "signature generation", "signature verification"]
    w["phrase_terms"] = f"with {SECTIONED}, p as (select unnest({phrases!r}) as phrase) select phrase, count(*) as n from p join blocks on contains(regexp_replace(lower(text), '\\s+', ' ', 'g'), phrase) group by phrase"
    w["section_edges"] = f"""
with {SECTIONED}, p as (select distinct doc_id, {PARTS} as p from blocks where section_path is not null), i as (select doc_id, p, unnest(range(1, len(p) + 1)) as i from p)
select distinct doc_id, array_to_string(p[1:i], ' > ') as child, case when i > 1 then array_to_string(p[1:i-1], ' > ') end as parent from i"""
    w["document_spans"] = f"with {SECTIONED} select doc_id, min(page_number) as start_page, max(page_number) as end_page from blocks group by doc_id"
    w["trace_carry_forward"] = f"with {TRACE} select run_id, seq, node, cast(visit as bigint) as visit from carried"
    w["trace_by_node"] = f"""
with {TRACE}, v as (select run_id, visit, coalesce(arg_min(node, seq), 'unknown') as node, count(*) filter (where type <> 'step') as n from carried group by run_id, visit)
select run_id, cast(visit as bigint) as visit, node, cast(row_number() over (partition by run_id, node order by visit) as integer) as node_visit, cast(n as integer) as n_events from v"""
    w["trace_latest"] = f"with {TRACE} select run_id, max(seq) as seq, arg_max(value, seq) as value from ev where type = 'error' group by run_id"
    w["windowed_events"] = "select time_bucket(interval 1 hour, ts) as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by all"
    w["gold_overlap"] = f"with {FUSED}, {GOLD} select qid, chunk_id, cast(rk as integer) as \"rank\", cast(span as integer) as span from met"
    w["gold_first_ranks"] = f"with {FUSED}, {GOLD} select qid, cast(min(rk) as integer) as first_rank from near group by qid"
    w["mrr"] = f"""
with {FUSED}, {GOLD}, f as (select qid, min(rk) as r from met group by qid), k as (select unnest([1, 3, 5, 8]) as k)
select q.qid, k, round(case when r <= k then 1.0::double / r else 0 end, 6) as mrr from q cross join k left join f on f.qid = q.qid where len(gold) > 0"""
    w["hit_rates"] = f"""
with {FUSED}, {GOLD}, docs as (select f.qid, min(f.rk) as r from fused f join gold on f.qid = gold.qid and f.doc_id = g.doc_id where rk <= 40 group by f.qid),
s as (select qid, min(rk) as r from met group by qid), t as (select qid, min(rk) as r from near group by qid), k as (select unnest([1, 3, 5, 8]) as k)
select k, round(avg(case when s.r <= k then 1.0 else 0 end), 6) as strict, round(avg(case when docs.r <= k then 1.0 else 0 end), 6) as doc, round(avg(case when t.r <= k then 1.0 else 0 end), 6) as tolerant
from q cross join k left join s on s.qid = q.qid left join docs on docs.qid = q.qid left join t on t.qid = q.qid where len(gold) > 0 group by k"""
    w["doc_diversity"] = f"with {FUSED} select qid, count(distinct doc_id) as n_docs from fused where rk <= 8 group by qid"
    w["question_counts"] = f"with {QUESTIONS} select count(*) as n, count(*) filter (where answerable) as n_answerable, count(*) filter (where len(gold) > 0) as n_labelled, count(*) filter (where answerable is null) as n_unknown from q"
    w["spec_hits"] = f"""
with {FUSED} select qid, count(*) filter (where doc_id = 'CRB.HB.100' and (start_page >= 20 or regexp_matches(lower(coalesce(text, '')), 'algorithm|keygen|decaps|parameter set'))) as n
from fused where rk <= 5 group by qid"""
    w["page_totals"] = f"with {PAGES} select doc_id, count(*) as n_pages, cast(sum(length(coalesce(text, ''))) as bigint) as n_chars from pages group by doc_id"
    w["retrieval_metrics"] = f"""
with recursive {FUSED}, {QUESTIONS}, g as (select qid, gold from q where len(gold) > 0),
walk as (
  select qid, gold, cast(0 as bigint) as rk, cast([] as bigint[]) as used, 0 as gain, 0 as hit from g
  union all
  select n.qid, n.gold, n.rk, case when n.m is null then n.used else list_append(n.used, n.m) end, case when n.m is null then 0 else 1 end, n.hit
  from (select w.qid, w.gold, f.rk, w.used,
          list_filter(range(len(w.gold)), lambda i: w.gold[i + 1].doc_id = f.doc_id and f.end_page >= w.gold[i + 1].start_page and w.gold[i + 1].end_page >= f.start_page and not list_contains(w.used, i))[1] as m,
          case when len(list_filter(w.gold, lambda x: x.doc_id = f.doc_id and f.end_page >= x.start_page and x.end_page >= f.start_page)) > 0 then 1 else 0 end as hit
        from walk w join fused f on f.qid = w.qid and f.rk = w.rk + 1 where f.rk <= 8) n),
k as (select unnest([1, 3, 5, 8]) as k)
select qid, k, round(sum(case when rk <= k then gain else 0 end) / max(len(gold)), 9) as recall,
  round(coalesce(1.0::double / min(case when rk <= k and hit = 1 then rk end), 0), 9) as mrr,
  round(sum(case when rk between 1 and k then gain / log2(rk + 1) else 0 end) / max(list_sum(list_transform(range(least(len(gold), k)), lambda i: 1 / log2(i + 2)))), 9) as ndcg
from walk cross join k group by qid, k"""
    term = "([A-Za-z0-9][A-Za-z0-9._-]*)"
    w["rerank_hits"] = f"""
with {INDEX}, {FUSED}, {QUESTIONS},
asked as (select qid, question as query, case when regexp_matches(lower(question), 'compare|differences? between| vs | versus ') then 'compare' when regexp_matches(lower(question), 'algorithm|shake|table') then 'algorithm'
  when regexp_matches(lower(question), '^(define|what is|what''s|what does)|stands for') then 'definition' else 'general' end as mode from q),
named as (select *, coalesce(nullif(trim(regexp_extract(query, '(?i)what\\s+does\\s+{term}\\s+mean', 1), ' .;,:'), ''), nullif(trim(regexp_extract(query, '(?i)(?:definition\\s+of|define|what\\s+is|what(?:''s|\\s+is)|what\\s+does)\\s+{term}', 1), ' .;,:'), '')) as term from asked),
anchored as (select qid, query, mode, list_distinct(list_filter(list_concat(list_transform(regexp_extract_all(query, '[A-Za-z0-9]+(?:[-._][A-Za-z0-9]+)+'), lambda x: lower(x)),
  case when mode = 'definition' then list_concat(list_concat(list_transform(regexp_extract_all(query, '\\b[A-Z]{{2,8}}\\b'), lambda x: lower(x)), list_filter(['mlwe', 'lwe', 'sis', 'msis', 'kdf'], lambda x: contains(lower(query), x))), case when term is null then [] else [lower(term)] end) else [] end),
  lambda x: x is not null and x <> '')) as anchors from named),
base as (select f.qid, chunk_id, doc_id, start_page, score, rk, mode, coalesce(f.text, '') as text, query, anchors,
  len(list_filter(anchors, lambda x: case when regexp_matches(x, '[._-]') then contains(lower(coalesce(f.text, '')), x) else regexp_matches(lower(coalesce(f.text, '')), '\\b' || x || '\\b') end)) as overlap
  from fused f join anchored using (qid) where rk <= 40),
pr as (select qid, chunk_id, {tokens('query')} as qt, {tokens('text')} as tt from base),
c as (select qid, chunk_id, len(tt) as dl, unnest(list_distinct(qt)) as term, qt, tt from pr),
n as (select qid, chunk_id, dl, term, len(list_filter(qt, lambda x: x = term)) as qtf, len(list_filter(tt, lambda x: x = term)) as tf from c),
sc as (select qid, chunk_id, round(coalesce(sum(case when tf > 0 then {BM25} end), 0), 9) as bm25 from n left join terms using (term), corpus group by qid, chunk_id),
j as (select base.*, bm25, min(score) over w as lo, max(score) over w as hi, count(*) over w as cnt, min(bm25) over w as blo, max(bm25) over w as bhi, max(overlap) over w as most
  from base join sc using (qid, chunk_id) window w as (partition by qid)),
m as (select *, case when hi > lo then (score - lo) / (hi - lo) when cnt > 1 then 1 - (rk - 1) / (cnt - 1) else 1 end as pn, case when bhi > blo then (bm25 - blo) / (bhi - blo) else 0 end as bn, case when most > 0 then overlap / most else 0 end as an,
  case mode when 'definition' then [0.35, 0.45, 0.2] when 'algorithm' then [0.45, 0.2, 0.35] when 'compare' then [0.6, 0.3, 0.1] else [0.7, 0.2, 0.1] end as ws from j),
g as (select *, round(ws[1] * pn + ws[2] * bn + ws[3] * an, 9) as promotion,
  case mode when 'definition' then overlap >= 1 or bn >= 0.55 when 'algorithm' then overlap >= 2 or (overlap >= 1 and bn >= 0.6) when 'compare' then overlap >= 1 and bn >= 0.65 else overlap >= 2 or bn >= 0.7 end as passes from m),
p as (select *, case when passes then row_number() over (partition by qid order by passes desc, promotion desc, rk, doc_id, start_page, chunk_id) end as place from g),
r as (select *, row_number() over (partition by qid order by case when place <= 8 then place else 1000 + rk end) as final from p)
select qid, chunk_id, cast(rk as integer) as fused_rank, cast(final as integer) as "rank", coalesce(place <= 8, false) as promoted, round(promotion, 6) as promotion from r where final <= 40"""
    w["mean_retrieval_metrics"] = f"select k, count(*) as n, round(avg(recall), 9) as recall, round(avg(mrr), 9) as mrr, round(avg(ndcg), 9) as ndcg from ({w['retrieval_metrics']}) group by k"
    w["miss_causes"] = f"""
with {FUSED}, {QUESTIONS}, rr as (select qid, chunk_id, "rank" as rk from ({w['rerank_hits']})),
gold as (select qid, unnest(gold) as g from q),
before as (select f.qid, min(f.rk) as b from fused f join gold on f.qid = gold.qid and f.doc_id = g.doc_id and f.start_page <= g.end_page and f.end_page >= g.start_page group by f.qid),
after as (select f.qid, min(rr.rk) as a from rr join fused f on rr.qid = f.qid and rr.chunk_id = f.chunk_id join gold on f.qid = gold.qid and f.doc_id = g.doc_id and f.start_page <= g.end_page and f.end_page >= g.start_page group by f.qid),
c as (select case when b is null then 'upstream_missing' when b > 40 then 'outside_pool' when a <= 8 then 'retained_or_recovered' when a is null or a > b then 'rerank_demotion' when b > 8 then 'rerank_insufficient_promotion' else 'rerank_demotion' end as cause
  from q left join before on before.qid = q.qid left join after on after.qid = q.qid where len(gold) > 0)
select cause, count(*) as n from c group by cause"""
    w["question_problems"] = """
with t as (select *, trim(coalesce(qid, '')) as id, coalesce(gold, []) as g, count(*) over (partition by trim(coalesce(qid, ''))) as times from questions),
p as (select unnest([case when id = '' then 'empty_qid' end, case when id <> '' and times > 1 then 'duplicate_qid' end, case when trim(coalesce(question, '')) = '' then 'empty_question' end,
  case when answerable is null then 'answerable_missing' end,
  case when len(list_filter(g, lambda x: x is null or trim(coalesce(x.doc_id, '')) = '' or coalesce(x.start_page, 0) <= 0 or coalesce(x.end_page, 0) <= 0 or x.start_page > x.end_page)) > 0 then 'bad_gold_span' end,
  case when answerable and len(g) = 0 then 'answerable_without_gold' end, case when not answerable and len(g) > 0 then 'unanswerable_with_gold' end]) as problem from t)
select problem, count(*) as n from p where problem is not null group by problem"""
    w["evidence_select"] = f"""
with {FUSED}, {CHUNKS},
prim as (select * from (select *, row_number() over (partition by qid order by score desc, doc_id, start_page, end_page, chunk_id) as p from fused where rk <= 40) where p <= 6),
ex as (select qid, p, -1 as s, chunk_id, text from prim
  union all select p.qid, p.p, case when b.vector_id < a.vector_id then 0 else 1 end, b.chunk_id, b.text from prim p join store a on a.chunk_id = p.chunk_id and a.doc_id = p.doc_id join store b on b.doc_id = p.doc_id and abs(b.vector_id - a.vector_id) = 1),
d as (select * from (select *, row_number() over (partition by qid, chunk_id order by p, s) as n from ex) where n = 1 and regexp_matches(coalesce(text, ''), '[^\\s\\p{{Z}}]')),
t as (select *, row_number() over (partition by qid order by p, s) as pos, sum(length(text)) over (partition by qid order by p, s rows between unbounded preceding and current row) as total from d)
select qid, cast(pos as integer) as pos, chunk_id from t where pos <= 6 and (pos = 1 or total <= 12000)"""
    w["query_anchors"] = f"""
with {QUESTIONS},
asked as (select qid, question as query, case when regexp_matches(lower(question), 'compare|differences? between| vs | versus ') then 'compare' when regexp_matches(lower(question), 'algorithm|shake|table') then 'algorithm'
  when regexp_matches(lower(question), '^(define|what is|what''s|what does)|stands for') then 'definition' else 'general' end as mode from q),
named as (select *, coalesce(nullif(trim(regexp_extract(query, '(?i)what\\s+does\\s+{term}\\s+mean', 1), ' .;,:'), ''), nullif(trim(regexp_extract(query, '(?i)(?:definition\\s+of|define|what\\s+is|what(?:''s|\\s+is)|what\\s+does)\\s+{term}', 1), ' .;,:'), '')) as term from asked),
found as (select qid, unnest(list_concat(list_transform(regexp_extract_all(query, '[A-Za-z0-9]+(?:[-._][A-Za-z0-9]+)+'), lambda x: lower(x)),
  case when mode = 'definition' then list_concat(list_concat(list_transform(regexp_extract_all(query, '\\b[A-Z]{{2,8}}\\b'), lambda x: lower(x)), list_filter(['mlwe', 'lwe', 'sis', 'msis', 'kdf'], lambda x: contains(lower(query), x))), case when term is null then [] else [lower(term)] end) else [] end)) as anchor from named)
select distinct qid, anchor from found where anchor <> ''"""
    w["algorithm_anchors"] = f"""
with {SECTIONED}, p as (select *, {PARTS} as p from blocks where section_path is not null),
h as (select chunk_id, doc_id, page_number, p, 'section::' || doc_id || '::' || array_to_string(p, ' > ') as section_id, unnest(regexp_extract_all(coalesce(text, ''), '{header}', 1)) as line from p
  where len(p) > 0 and trim(regexp_replace(lower(p[-1]), '\\s+', ' ', 'g')) not in ('contents', 'table of contents', 'list of algorithms', 'list of figures', 'list of tables')),
k as (select doc_id, regexp_extract(line, '(?i)\\bAlgorithm\\s+(\\d+)\\b', 1) as number, section_id, page_number, (case when starts_with(lower(p[-1]), 'algorithm ') then 0 else 1 end, coalesce(page_number, 1000000000), -len(p), section_id, chunk_id) as key from h)
select doc_id, number, arg_min(section_id, key) as section_id, arg_min(page_number, key) as start_page from k group by doc_id, number"""
    return w
