"""The chunk store: numbered chunks, their embedding texts, neighbours and lookups."""
from __future__ import annotations

import json

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions import text as T
from ..session import checkpointing


def number_rows(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """``name`` = 0, 1, 2 ... in the given order, without bringing all rows into one task.

    The rows are range-partitioned, sorted and written to the checkpoint
    folder, so that their places are fixed once; the sizes of the partitions
    (one row each) then give every partition its offset.
    """
    spark = df.sparkSession
    checkpointing(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id()).checkpoint()
    part = F.shiftright("_m", 33)  # the id holds the partition above 33 bits of the row's place in it
    sizes = placed.groupBy(part.alias("_p")).agg(F.count(F.lit(1)).alias("_n")).orderBy("_p").collect()
    before, total = [0] * (sizes[-1]["_p"] + 1 if sizes else 1), 0
    for r in sizes:
        before[r["_p"]] = total
        total += r["_n"]
    offsets = F.from_json(F.lit(json.dumps(before)), "array<bigint>")  # one literal, one look-up by place
    at = F.get(offsets, part.cast("int"))
    place = F.col("_m") - F.shiftleft(part, 33)
    return placed.withColumn(name, (at + place).cast("long")).drop("_m")


def build_store(chunks: DataFrame) -> DataFrame:
    """Chunks with text, numbered by document, page and chunk, and their embedding text."""
    rows = chunks.withColumn("text", T.strip(F.coalesce("text", F.lit("")))).where(F.col("text") != "")
    rows = rows.withColumn("embedding_text", T.embedding_text(F.col("doc_id"), F.col("section_path"), F.col("text")))
    return number_rows(rows, ["doc_id", "start_page", "chunk_id"], "vector_id")


def pages_between(chunks: DataFrame, wanted: DataFrame, k: int = 30) -> DataFrame:
    """For every ``wanted`` range (doc_id, from_page, to_page) its first ``k`` chunks."""
    hit = chunks.join(wanted, "doc_id").where((F.col("start_page") <= F.col("to_page")) & (F.col("end_page") >= F.col("from_page")))
    order = W.partitionBy("doc_id", "from_page", "to_page").orderBy("start_page", "chunk_id")
    return hit.withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= k)


def neighbours(hits: DataFrame, store: DataFrame, window: int = 1) -> DataFrame:
    """The chunks up to ``window`` places before and after each hit in its document, a little below it in score.

    ``side`` orders them: -1, +1, -2, +2 ...  An equi-join on document and
    place: each hit asks for its few places, so no document is compared with
    itself.
    """
    place = store.select("chunk_id", "doc_id", "vector_id")
    offsets = F.array(*[F.lit(s * d) for d in range(1, window + 1) for s in (-1, 1)])
    asked = hits.select("qid", "chunk_id", "doc_id", "score").join(place, ["chunk_id", "doc_id"])
    asked = asked.select("qid", F.col("chunk_id").alias("of"), "doc_id", "score", "vector_id", F.posexplode(offsets).alias("side", "delta"))
    asked = asked.withColumn("vector_id", F.col("vector_id") + F.col("delta"))
    found = asked.join(store, ["doc_id", "vector_id"])
    return found.select("qid", "of", "side", "delta", (F.col("score") - F.abs("delta") * 1e-6).alias("score"), "chunk_id", "doc_id", "start_page", "end_page", "text")
