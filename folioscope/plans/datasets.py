"""The engine's datasets over the test tables."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text as T
from ..operators import dense, evalkit, fuse, store
from ..sources.tables import table


def pages(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "documents").where("doc_ref is not null and page_number is not null")
    return rows.select(F.col("doc_ref").alias("doc_id"), F.col("doc_id").alias("page_id"), "page_number", "text")


def chunks_of_hits(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "chunk_hits").where("doc_id is not null and chunk_id is not null and text is not null")
    return rows.groupBy("chunk_id").agg(F.min("doc_id").alias("doc_id"), F.min("start_page").alias("start_page"), F.min("end_page").alias("end_page"), F.max("text").alias("text"))


def chunk_store(s: SparkSession, d: str) -> DataFrame:
    """Chunks numbered by document, page and id: only the keys are sorted and written down; texts come in where they are asked for."""
    rows = table(s, d, "chunk_hits").where("doc_id is not null and chunk_id is not null and text is not null")
    keys = rows.groupBy("chunk_id").agg(F.min("doc_id").alias("doc_id"), F.min("start_page").alias("start_page"), F.min("end_page").alias("end_page"))
    numbered = store.number_rows(keys, ["doc_id", "start_page", "chunk_id"], "vector_id")
    texts = rows.groupBy("chunk_id").agg(F.max("text").alias("text"))
    # a text for every chunk, so a use without texts needs no join
    return numbered.join(texts, "chunk_id", "left").select("chunk_id", "doc_id", "start_page", "end_page", "text", "vector_id")


def hits(s: SparkSession, d: str) -> DataFrame:
    """All usable hits, once each."""
    rows = table(s, d, "chunk_hits").select("hit_id", "qid", "ranking_id", "rank", "score", *fuse.HIT)
    return rows.where(F.col("qid").isNotNull() & F.col("doc_id").isNotNull() & F.col("chunk_id").isNotNull() & F.col("score").isNotNull() & ~F.isnan("score")).dropDuplicates(["hit_id"])


def questions(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "questions").where("qid is not null").dropDuplicates(["qid"])
    return rows.select("qid", T.strip(F.col("question")).alias("question"), "answerable", "category", F.coalesce("gold", F.array().cast(evalkit.GOLD)).alias("gold"))


def search_set(s: SparkSession, d: str) -> DataFrame:
    """The stated queries of searches: every question whose number is divisible by 100."""
    rows = questions(s, d).where(F.pmod(F.regexp_extract("qid", r"\d+", 0).cast("long"), F.lit(100)) == 0)
    return rows.select("qid", F.col("question").alias("query"))


def fused(s: SparkSession, d: str, k: int = 60) -> DataFrame:
    return fuse.rrf(hits(s, d), k)


def sectioned_chunks(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "structured_blocks").where("doc_id is not null").dropDuplicates(["block_id"])
    return rows.select(F.col("block_id").cast("string").alias("chunk_id"), "doc_id", F.col("page_number").alias("start_page"), F.col("page_number").alias("end_page"), "section_path", "text")


def pair_answers(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "answers").dropDuplicates(["pair_id"])


def vectors(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "embeddings").select(F.col("vec_id").alias("id"), dense.normalized(F.col("embedding")).alias("vector"), "label")
