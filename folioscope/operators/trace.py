"""Analytics of event traces: carried-forward nodes, visits, rounds, latest events."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import text as T


def carry_node(events: DataFrame) -> DataFrame:
    """Events (``run_id, seq, type, node``) whose node is that of the last step where they have none, and their ``visit`` number."""
    order = W.partitionBy("run_id").orderBy("seq")
    step = (F.col("type") == "step") & (F.coalesce("node", F.lit("")) != "")
    own = F.nullif("node", F.lit(""))
    rows = events.withColumns({"node": F.coalesce(own, F.last(F.when(step, own), ignorenulls=True).over(order)), "_step": step.cast("int")})
    return rows.withColumn("visit", F.sum("_step").over(order)).drop("_step")


def by_node(events: DataFrame) -> DataFrame:
    """One row per visit of a node: ``run_id, visit, node, node_visit, event_types``."""
    rows = carry_node(events)
    inner = F.filter(F.array_sort(F.collect_list(F.struct("seq", "type"))), lambda e: e["type"] != "step")
    visits = rows.groupBy("run_id", "visit").agg(F.min_by("node", "seq").alias("node"), F.transform(inner, lambda e: e["type"]).alias("event_types"))
    nth = F.row_number().over(W.partitionBy("run_id", "node").orderBy("visit"))
    return visits.withColumns({"node": F.coalesce("node", F.lit("unknown")), "node_visit": nth})


def by_round(events: DataFrame, fields: dict[str, tuple[str, str]]) -> DataFrame:
    """One row per retrieval round: for each field the value of its latest event.

    ``fields``: name -> (event type, payload key).  The round is that of the
    event, else the current one, carried forward.
    """
    order = W.partitionBy("run_id").orderBy("seq")
    own = F.nullif(F.col("payload")["round"].try_cast("int"), F.lit(0))
    starts = F.col("type").isin("retrieval_round_started", "retrieval_round_result")
    rows = events.withColumn("round", F.coalesce(own, F.last(F.when(starts, own), ignorenulls=True).over(order), F.lit(0))).where("round > 0")
    latest = [F.max_by(F.when(F.col("type") == kind, F.col("payload")[key]), F.when(F.col("type") == kind, F.col("seq"))).alias(name) for name, (kind, key) in fields.items()]
    return rows.groupBy("run_id", "round").agg(*latest)


def latest(events: DataFrame, kind: str) -> DataFrame:
    """The payload of the last event of a type in every run."""
    return events.where(F.col("type") == kind).groupBy("run_id").agg(F.max("seq").alias("seq"), F.max_by("payload", "seq").alias("payload"))


def compact(events: DataFrame, limit: int = 240, items: int = 5) -> DataFrame:
    """Q36: payload texts cut to previews."""
    return events.withColumn("payload", F.transform_values("payload", lambda _, v: T.preview(v, limit)))


def evidence_preview(evidence: DataFrame, limit: int = 800, items: int = 5) -> DataFrame:
    """Q36: the first pieces of evidence of every question with shortened texts."""
    rows = evidence.withColumn("_n", F.row_number().over(W.partitionBy("qid").orderBy("pos"))).where(F.col("_n") <= items)
    return rows.select("qid", "pos", F.round("score", 6).alias("score"), "chunk_id", "doc_id", "start_page", "end_page", T.preview(F.coalesce("text", F.lit("")), limit).alias("preview_text"))


def run_name(started: Column, question: Column) -> Column:
    """``agent_<time>_<slug>``."""
    return F.concat_ws("_", F.lit("agent"), F.date_format(started, "yyyyMMdd_HHmmss"), F.left(T.slug(F.lower(question), "question"), F.lit(60)))
