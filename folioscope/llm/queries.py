"""Queries of the training-data operators, over the whole tables, and their SQL."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import table
from .abuse import found, rates, score_documents
from .encode import encode_texts
from .knn import near_pairs
from .pack import pack_documents
from .pairs import defects
from .repeats import repeated_lines, without_repeated_lines
from .split import split_blocks
from .topn import top_n_per_group


def p1_pieces(spark: SparkSession, d: str) -> DataFrame:
    return split_blocks(table(spark, d, "structured_blocks"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_pieces(spark, d).where("piece_no = 0").select("block_id")


def p2_top(spark: SparkSession, d: str) -> DataFrame:
    return top_n_per_group(table(spark, d, "chunk_hits"), "doc_id", "chunk_id", "score", 5)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_top(spark, d).select("doc_id", "chunk_id")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return repeated_lines(table(spark, d, "chunk_hits"))


def p3_clean(spark: SparkSession, d: str) -> DataFrame:
    return without_repeated_lines(table(spark, d, "chunk_hits"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return defects(table(spark, d, "answers"), table(spark, d, "questions"), table(spark, d, "baseline_results"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return near_pairs(table(spark, d, "chunk_vectors"), table(spark, d, "emb_meta"))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode_texts(table(spark, d, "documents"))


def p7_pack(spark: SparkSession, d: str) -> DataFrame:
    return pack_documents(table(spark, d, "documents"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return found(table(spark, d, "documents"), table(spark, d, "doc_labels"))


def p8_scores(spark: SparkSession, d: str) -> DataFrame:
    return score_documents(table(spark, d, "documents"), labels=table(spark, d, "doc_labels"))


def p8_rates(spark: SparkSession, d: str) -> DataFrame:
    return rates(table(spark, d, "documents"), table(spark, d, "doc_labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_pieces, p2_found, p2_top, p3_found, p3_clean, p4_found, p5_found, p6_ids, p7_pack, p8_found, p8_scores, p8_rates)}


TOP = """
select doc_id, chunk_id, score, cast("rank" as integer) as "rank"
from (select *, row_number() over (partition by doc_id order by score desc, chunk_id) as "rank"
      from (select doc_id, chunk_id, max(score) as score from chunk_hits
            where doc_id is not null and chunk_id is not null and score is not null and not isnan(score)
            group by doc_id, chunk_id))
where "rank" <= 5
"""

LINES = r"""
with chunks as (
  select doc_id, chunk_id, max(text) as text from chunk_hits
  where doc_id is not null and chunk_id is not null and text is not null group by doc_id, chunk_id),
numbered as (select doc_id, chunk_id, unnest(range(1, len(string_split(text, chr(10))) + 1)) as line_no, text from chunks),
lines as (
  select doc_id, chunk_id, line_no, string_split(text, chr(10))[line_no] as line,
         regexp_replace(lower(string_split(text, chr(10))[line_no]), '[^\p{L}]', '', 'g') as letters from numbered),
often as (select doc_id, letters from lines where letters <> '' group by doc_id, letters having count(distinct chunk_id) >= 5),
found as (select l.* from lines l join often o on l.doc_id = o.doc_id and l.letters = o.letters)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": "select distinct block_id from structured_blocks where length(trim(text, ' ' || chr(9) || chr(10) || chr(13))) > 2200",
        "p2_found": f"select doc_id, chunk_id from ({TOP})",
        "p2_top": TOP,
        "p3_found": LINES + "select doc_id, chunk_id, cast(line_no as integer) as line_no from found",
        "p3_clean": LINES + """
, kept as (
  select l.doc_id, l.chunk_id, count(*) filter (where f.line_no is not null) as n_removed,
         coalesce(string_agg(l.line, chr(10) order by l.line_no) filter (where f.line_no is null), '') as text
  from lines l left join found f on l.doc_id = f.doc_id and l.chunk_id = f.chunk_id and l.line_no = f.line_no
  group by l.doc_id, l.chunk_id)
select doc_id, chunk_id, cast(n_removed as integer) as n_removed, text from kept""",
        "p5_found": """
with known as (select embeddings_path as path, max(dim) as dim from emb_meta group by embeddings_path),
v as (select distinct on (vector_id) path, vector_id, cast(embedding as double[]) as e
      from chunk_vectors join known on embeddings_path = path
      where vector_id is not null and len(embedding) = dim
        and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0
        and len(list_filter(embedding, lambda x: x <> 0)) > 0),
near as (select a.vector_id as a, b.vector_id as b,
           row_number() over (partition by a.vector_id order by round(list_cosine_similarity(a.e, b.e), 9) desc, b.vector_id) as r
         from v a join v b on a.path = b.path and a.vector_id <> b.vector_id)
select distinct least(a, b) as vec_a, greatest(a, b) as vec_b from near where r <= 5""",
    }
