"""Streaming forms of the stateless stages, and windowed counts of events."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import text as T
from ..operators import chunk, clean
from ..session import ship
from ..sources.files import PAGES


def read_pages(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """Page records from JSON files as they arrive in a folder."""
    ship(spark)
    return spark.readStream.schema(PAGES).option("maxFilesPerTrigger", files_per_trigger).json(folder)


def clean_stream(pages: DataFrame) -> DataFrame:
    """The cleaning that needs no other page: ``text_clean`` without boilerplate removal."""
    text = T.dehyphenate(T.normalize_whitespace(T.normalize_unicode(F.coalesce("text", F.lit("")))))
    lines = F.array_join(T.drop_page_numbers(F.split(text, "\n")), "\n")
    return pages.withColumn("text_clean", T.strip(clean.smart_join(lines)))


def append_chunks(pages: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Clean, chunk (v1, page by page) and append to a Parquet table, exactly once."""
    chunks = chunk.chunk_pages(clean_stream(pages), "v1")
    return chunks.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def event_counts(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events per window and type (``ts, event_type, value``); on a stream, rows later than ``late`` are dropped."""
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    out = events.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", "total")
