"""Top N items within every group."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.internal import InternalFunction


def top_n_per_group(df: DataFrame, group: str, item: str, score: str, n: int = 5) -> DataFrame:
    """The ``n`` best items of every group: ``(group, item, score, rank)``.

    Two mergeable aggregations.  The first reduces repeated rows of an item to
    its highest score; it is keyed by (group, item), so a group that holds a
    third of all rows is spread over all tasks.  The second keeps a bounded
    heap of ``n`` entries per group: every map task builds its heaps before the
    shuffle, at most ``n`` entries per group and task travel, and the heaps are
    merged afterwards.  Entries compare by score (descending), then by item
    (ascending, byte order).

    Defined cases: rows with a null group, null item, null or NaN score do not
    count; infinite scores do.  Repeated rows count once.  Equal scores go by
    item.  A group with fewer than ``n`` items gives all of them, a group
    without a countable row gives none, an empty table an empty result.  Other
    columns are ignored, whatever their names.
    """
    if n < 1:
        raise ValueError("n must be at least 1")
    rows = df.select(F.col(group).alias("_g"), F.col(item).alias("_i"), F.col(score).cast("double").alias("_s"))
    rows = rows.where(F.col("_g").isNotNull() & F.col("_i").isNotNull() & F.col("_s").isNotNull() & ~F.isnan("_s"))
    best = rows.groupBy("_g", "_i").agg(F.max("_s").alias("_s"))
    # the heap keeps the n smallest of (-score, item)
    entry = F.struct((-F.col("_s")).alias("neg"), F.col("_i").alias("item"))
    heaps = best.groupBy("_g").agg(InternalFunction.collect_top_k(entry, n, True).alias("_h"))
    out = heaps.select("_g", F.posexplode(F.array_sort("_h")).alias("_p", "_e"))
    return out.select(
        F.col("_g").alias(group), F.col("_e.item").alias(item),
        (-F.col("_e.neg")).alias(score if score not in (group, item) else "score"),
        (F.col("_p") + 1).alias("rank"),
    )
