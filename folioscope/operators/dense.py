"""Exact dense search over stored vectors."""
from __future__ import annotations

import io
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, DoubleType

#: Query vectors that one pass over the index carries, at most (bytes); more are searched in several passes.
CARRIED = 64_000_000


def bound(c: Column, use) -> Column:
    """``use(c)`` with ``c`` computed once, however often ``use`` refers to it."""
    return F.get(F.transform(F.array(c), use), F.lit(0))


def normalized(v: Column) -> Column:
    """A vector of length 1 in double precision; a zero vector stays."""
    doubles = F.transform(v, lambda x: x.cast("double"))
    norm = lambda w: F.sqrt(F.aggregate(w, F.lit(0.0), lambda a, x: a + x * x))
    pair = bound(doubles, lambda w: F.struct(w.alias("v"), norm(w).alias("n")))
    return bound(pair, lambda p: F.when(p["n"] > 0, F.transform(p["v"], lambda x: x / p["n"])).otherwise(p["v"]))


def hashed_vector(tokens: Column, dim: int = 64) -> Column:
    """A stand-in for an encoder (G09): signed counts of hashed tokens; deterministic, of length 1."""
    @pandas_udf(ArrayType(DoubleType()))
    def encode(s: pd.Series) -> pd.Series:
        out = []
        for words in s:
            v = np.zeros(dim)
            for w in () if words is None else words:
                h = zlib.crc32(w.encode())
                v[h % dim] += 1.0 if h & 0x80000000 else -1.0
            n = np.linalg.norm(v)
            out.append(v / n if n else v)
        return pd.Series(out)

    return encode(tokens)


class Top:
    """The ``k`` best of every query over the blocks of a partition: one bounded list each, whatever the partition's size."""

    #: Numbers in a tile of the score matrix, at most.
    TILE = 4_000_000

    def __init__(self, n: int, k: int):
        self.k, self.n = k, n
        self.scores: np.ndarray = np.full((n, 0), -np.inf)
        self.ids: np.ndarray | None = None

    def add(self, matrix: np.ndarray, ids: np.ndarray, block: np.ndarray) -> None:
        """Merge a block of the index, a tile of queries and rows at a time."""
        wide = max(1, min(len(ids), 8192))
        tall = max(1, self.TILE // wide)
        for lo in range(0, len(ids), wide):
            self.put((matrix[at : at + tall] @ block[lo : lo + wide].T for at in range(0, self.n, tall)), ids[lo : lo + wide])

    def put(self, tiles: Iterator[np.ndarray], ids: np.ndarray) -> None:
        """Merge the scores of ``ids`` for all queries, given in tiles of successive queries; what does not match has -inf."""
        kept, at = [], 0
        for tile in tiles:
            kept.append(self.merge(at, tile, ids))
            at += len(tile)
        self.scores, self.ids = np.concatenate([s for s, _ in kept]), np.concatenate([i for _, i in kept])

    def merge(self, at: int, fresh: np.ndarray, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        fresh = np.round(fresh, 9)
        take = min(self.k, fresh.shape[1])
        # the k-th best score is the bar; all at least as good go on, since equal ones are told apart by id
        bar = np.partition(fresh, fresh.shape[1] - take, axis=1)[:, fresh.shape[1] - take]
        most = int((fresh >= bar[:, None]).sum(1).max())
        best = np.argpartition(-fresh, most - 1, axis=1)[:, :most] if most < fresh.shape[1] else np.broadcast_to(np.arange(fresh.shape[1]), fresh.shape)
        scores, ids = np.take_along_axis(fresh, best, 1), some[best]
        if self.ids is not None:
            scores, ids = np.concatenate((self.scores[at : at + len(fresh)], scores), 1), np.concatenate((self.ids[at : at + len(fresh)], ids), 1)
        order = np.lexsort((ids, -scores), axis=1)[:, : self.k]
        return np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1)

    def rows(self, names: list, at: int, end: int) -> pa.RecordBatch:
        width = self.scores.shape[1]
        real = np.isfinite(self.scores[at:end]).reshape(-1)
        asked = pa.array(names[at:end]).take(pa.array(np.repeat(np.arange(len(names[at:end])), width)[real]))
        ids = pa.array([], pa.int64()) if self.ids is None else pa.array(self.ids[at:end].reshape(-1)[real])
        return pa.RecordBatch.from_arrays([asked, ids, pa.array(self.scores[at:end].reshape(-1)[real])], names=["qid", "id", "score"])


def search(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """``qid, id, score, rank``, the ``k`` vectors of ``vectors(id, vector)`` with the largest inner product for each of ``queries(qid, vector)``.

    The stated queries are carried to every block of the index as one matrix
    (their size is counted first; beyond ``CARRIED`` bytes they are split over
    several passes) and multiplied with it in tiles of bounded size; a task
    keeps ``k`` rows per query over all its blocks, and these bounded lists are
    ranked.  Ties go to the smaller id.
    """
    n = queries.count()
    dim = (vectors.select(F.size("vector")).head() or [0])[0]
    passes = max(1, -(-n * max(dim, 1) * 8 // CARRIED))
    found = None
    for i in range(passes):
        part = queries.where(F.pmod(F.xxhash64("qid"), F.lit(passes)) == i).select("qid", "vector").orderBy("qid").collect()
        if not part:
            continue
        names = [r["qid"] for r in part]
        matrix = np.array([r["vector"] for r in part], dtype=np.float64)

        def scan(batches: Iterator[pa.RecordBatch], names=names, matrix=matrix) -> Iterator[pa.RecordBatch]:
            top = Top(len(names), k)
            for batch in batches:
                if batch.num_rows:
                    ids = batch.column("id").to_numpy(zero_copy_only=False)
                    top.add(matrix, ids, batch.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1))
            for at in range(0, len(names), 4096):
                yield top.rows(names, at, at + 4096)

        kinds = f"qid {queries.schema['qid'].dataType.simpleString()}, id {vectors.schema['id'].dataType.simpleString()}, score double"
        rows = vectors.select("id", "vector").where(F.col("id").isNotNull() & F.col("vector").isNotNull()).mapInArrow(scan, kinds)
        found = rows if found is None else found.unionByName(rows)
    if found is None:
        return queries.select("qid").limit(0).join(vectors.select("id").limit(0)).select("qid", "id", F.lit(0.0).alias("score"), F.lit(0).alias("rank"))
    order = W.partitionBy("qid").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def write_vectors(vectors: DataFrame, path: str, model: str, **facts) -> None:
    """``vectors(id, vector)`` with a description beside them; together they can be read back as an index."""
    vectors.select("id", "vector").write.mode("overwrite").parquet(f"{path}/vectors")
    size = F.max(F.size("vector"))
    meta = vectors.agg(F.count(F.lit(1)).alias("num_vectors"), size.alias("dim")).withColumns({"model_name": F.lit(model), **{k: F.lit(v) for k, v in facts.items()}})
    meta.coalesce(1).write.mode("overwrite").json(f"{path}/meta")


def read_vectors(spark: SparkSession, path: str, model: str | None = None) -> DataFrame:
    """The vectors of ``write_vectors``; another model's are an error."""
    found = spark.read.json(f"{path}/meta").head()
    if model is not None and found["model_name"] != model:
        raise ValueError(f"the vectors are of {found['model_name']!r}, not of {model!r}")
    return spark.read.parquet(f"{path}/vectors")


def read_npy(spark: SparkSession, path: str) -> DataFrame:
    """``file, row, vector`` of NumPy files of two dimensions, each read where it lies."""
    from ..session import ship

    ship(spark)

    def load(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"]):
                x = np.load(io.BytesIO(content), allow_pickle=False).astype(np.float64)
                for lo in range(0, len(x), 10_000):
                    part = x[lo : lo + 10_000]
                    yield pd.DataFrame({"file": name, "row": np.arange(lo, lo + len(part)), "vector": list(part)})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(load, "file string, row long, vector array<double>")


def spread_pages(hits: DataFrame, k: int, per_page: int = 1) -> DataFrame:
    """Of ranked ``hits`` (already cut to the candidates) the best ``per_page`` of every page span, ``k`` per query, ranked anew."""
    page = W.partitionBy("qid", "doc_id", "start_page", "end_page").orderBy("rank")
    kept = hits.withColumn("_n", F.row_number().over(page)).where(F.col("_n") <= per_page).drop("_n")
    return kept.withColumn("rank", F.row_number().over(W.partitionBy("qid").orderBy("rank"))).where(F.col("rank") <= k)


def retrieve(queries: DataFrame, vectors: DataFrame, store: DataFrame, k: int = 5, candidates: int = 25, per_page: int = 1) -> DataFrame:
    """Q06: search, look-up in the chunk store, one hit per page span."""
    found = search(queries, vectors, max(k, candidates))
    hits = found.join(store.select(F.col("vector_id").alias("id"), "chunk_id", "doc_id", "start_page", "end_page", "text"), "id").drop("id")
    return spread_pages(hits, k, per_page)
