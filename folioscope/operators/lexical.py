"""The lexical index (BM25) as tables, its search, and scoring of given texts."""
from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import text as T
from ..session import checkpointing
from .dense import Top

K1, B = 1.5, 0.75
#: Terms of a set of queries that are sent to every task of the postings, at most.
CARRIED = 200_000
#: Tasks over which the postings of one term are spread where the terms are shuffled.
SALTS = 16


@dataclass(frozen=True)
class Index:
    """``postings(term, id, tf, dl)``, ``docs(id, dl)``, ``terms(term, df, idf)``, ``corpus(n_docs, avgdl)`` (one row)."""

    postings: DataFrame
    docs: DataFrame
    terms: DataFrame
    corpus: DataFrame


_WORD = re.compile(T.WORD)
_PARTS = re.compile("[-._]")


def _count(normalize: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The terms of every document with their counts, and its length (compounds count with their parts)."""
    for whole in batches:
        for batch in (whole.slice(lo, 1024) for lo in range(0, len(whole), 1024)):
            terms: list[str] = []
            times: list[int] = []
            n, lengths = [], []
            for text in batch.column("text").to_pylist():
                words = _WORD.findall((T.join_identifiers(text) if normalize else text or "").lower())
                words += [part for w in words if not w.isalnum() for part in _PARTS.split(w)]
                counted = Counter(words)
                terms += counted
                times += counted.values()
                n.append(len(counted))
                lengths.append(len(words))
            take = pa.array(np.repeat(np.arange(len(n)), n))
            yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), batch.column("id").take(take), pa.array(times, pa.int64()), pa.array(lengths, pa.int64()).take(take)], names=["term", "id", "tf", "dl"])


def build_index(docs: DataFrame, key: str = "vector_id", text: str = "text", *, normalize: bool = True, keep: bool = False) -> Index:
    """A02 to A06.  With ``normalize`` identifiers are joined first.

    Terms are counted document by document as the texts pass by, so a posting
    is made where its text is and nothing is shuffled.  (Exploding and grouping
    shuffles every posting; counting inside rows with higher-order functions
    takes several times the CPU.)

    With ``keep`` the tables are written to the checkpoint folder, for several
    uses in one session: texts are then tokenized once, and lengths come from
    the stored postings (documents without tokens have length 0).
    """
    key_type = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    postings = rows.mapInArrow(partial(_count, normalize), f"term string, id {key_type}, tf long, dl long")
    if keep:
        checkpointing(docs.sparkSession)
        postings = postings.checkpoint()
        summed = postings.groupBy("id").agg(F.first("dl").alias("dl"))
        lengths = docs.select(F.col(key).alias("id")).join(summed, "id", "left").select("id", F.coalesce("dl", F.lit(0)).alias("dl")).checkpoint()
    else:
        body = T.normalize_identifiers(F.col("text")) if normalize else F.col("text")
        lengths = rows.select("id", F.size(T.tokens(body)).cast("long").alias("dl"))
    corpus = lengths.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("dl").alias("avgdl"))
    frequencies = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    terms = frequencies.crossJoin(F.broadcast(corpus)).select("term", "df", idf.alias("idf"))  # one row: no cross product
    return Index(postings, lengths, terms.checkpoint(), corpus.checkpoint()) if keep else Index(postings, lengths, terms, corpus)


def write_index(index: Index, path: str, buckets: int = 64) -> None:
    """The four tables; postings are clustered by term, so a query reads the files of its terms."""
    index.postings.repartition(buckets, "term").sortWithinPartitions("term", "id").write.mode("overwrite").parquet(f"{path}/postings")
    for name in ("docs", "terms", "corpus"):
        getattr(index, name).write.mode("overwrite").parquet(f"{path}/{name}")


def read_index(spark, path: str) -> Index:
    """S13."""
    return Index(*(spark.read.parquet(f"{path}/{n}") for n in ("postings", "docs", "terms", "corpus")))


def weight(tf: Column, dl: Column, avgdl: Column) -> Column:
    """A term's BM25 weight without its idf."""
    length = F.greatest(tf + K1 * (1 - B + B * dl / F.greatest(avgdl, F.lit(1e-9))), F.lit(1e-9))
    return tf * (K1 + 1) / length


def query_terms(queries: DataFrame, *, normalize: bool = True) -> DataFrame:
    """``qid, term, qtf`` of ``qid, query``."""
    body = T.normalize_identifiers(F.col("query")) if normalize else F.col("query")
    return queries.select("qid", F.explode(T.tokens(body)).alias("term")).groupBy("qid", "term").agg(F.count(F.lit(1)).alias("qtf"))


def search(index: Index, queries: DataFrame, k: int, *, normalize: bool = True) -> DataFrame:
    """``qid, id, score, rank``, the ``k`` best of every query.

    The queries' terms are counted first.  Up to ``CARRIED`` of them go to the
    postings: those of the asked terms are weighted, brought together by
    document (each once, however many queries ask for it), and only then met
    with the queries, in a matrix of documents and queries for blocks of
    documents, so that scores are summed and the ``k`` best of every task are
    kept without a row for every (query, document) pair.  Beyond
    that the postings are shuffled by term, salted, since a term may stand in
    every document.  Ties go to the smaller id.
    """
    asked = query_terms(queries, normalize=normalize)
    small = asked.limit(CARRIED + 1).count() <= CARRIED
    known = index.terms.join(asked.select("term").distinct(), "term", "left_semi").select("term", "idf")
    value = (F.col("idf") * weight(F.col("tf"), F.col("dl"), F.col("avgdl"))).alias("w")
    corpus = F.broadcast(index.corpus)  # one row
    if small:
        known = F.broadcast(known)
        mine = index.postings.join(known, "term").crossJoin(corpus).select("id", F.xxhash64("term").alias("t"), value).repartition("id").sortWithinPartitions("id")
        wanted = asked.select("qid", F.xxhash64("term").alias("t"), "qtf").orderBy("qid", "t").toArrow()  # bounded by CARRIED
        shape = f"qid {queries.schema['qid'].dataType.simpleString()}, id {index.postings.schema['id'].dataType.simpleString()}, score double"
        scores = mine.mapInArrow(partial(_score, wanted, k), shape)
    else:
        salt = F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int").alias("_s")
        spread = asked.join(known, "term").withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        matched = index.postings.select("*", salt).join(spread, ["term", "_s"]).crossJoin(corpus).select("qid", "id", value, "qtf")
        scores = matched.groupBy("qid", "id").agg(F.round(F.sum(F.col("w") * F.col("qtf")), 9).alias("score"))
    order = W.partitionBy("qid").orderBy(F.desc("score"), "id")
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _score(wanted: pa.Table, k: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The ``k`` best documents of a partition for every query, of its weighted postings ``id, t, w`` sorted by document."""
    qids, which = np.unique(np.array(wanted.column("qid").to_pylist(), dtype=object).astype(str), return_inverse=True) if len(wanted) else (np.zeros(0, dtype=object), np.zeros(0, dtype=np.int64))
    names = wanted.column("qid").take(pa.array([int(np.flatnonzero(which == i)[0]) for i in range(len(qids))], pa.int64())).to_pylist()
    t, f = wanted.column("t").to_numpy(), wanted.column("qtf").to_numpy().astype(np.float64)
    order = np.argsort(t, kind="stable")
    t, f, which = t[order], f[order], which[order]
    top = Top(len(names), k)
    rest = None

    def block(ids: np.ndarray, terms: np.ndarray, w: np.ndarray) -> None:
        docs, row = np.unique(ids, return_inverse=True)
        by_term = np.argsort(terms, kind="stable")
        cuts = np.flatnonzero(np.diff(terms[by_term])) + 1
        groups = np.split(by_term, cuts)
        tall = max(1, Top.TILE // max(1, len(docs)))
        def tiles() -> Iterator[np.ndarray]:
            for at in range(0, len(names), tall):
                scores = np.zeros((min(tall, len(names) - at), len(docs)))
                for g in groups:
                    lo, hi = np.searchsorted(t, terms[g[0]], side="left"), np.searchsorted(t, terms[g[0]], side="right")
                    inside = (which[lo:hi] >= at) & (which[lo:hi] < at + len(scores))
                    if inside.any():
                        # a document has one posting of a term, so no cell is met twice
                        scores[np.ix_(which[lo:hi][inside] - at, row[g])] += f[lo:hi][inside][:, None] * w[g][None]
                yield np.where(scores > 0, np.round(scores, 9), -np.inf)
        top.put(tiles(), docs)

    for batch in batches:
        ids, terms, w = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", "t", "w"))
        if rest is not None:
            ids, terms, w = (np.concatenate(x) for x in zip(rest, (ids, terms, w)))
        # the last document may go on in the next batch
        whole = int(np.searchsorted(ids, ids[-1], side="left")) if len(ids) else 0
        rest = (ids[whole:], terms[whole:], w[whole:])
        if whole and len(names):
            block(ids[:whole], terms[:whole], w[:whole])
    if rest is not None and len(rest[0]) and len(names):
        block(*rest)
    for at in range(0, len(names) if top.ids is not None else 0, 4096):
        yield top.rows(names, at, at + 4096)


def score_texts(index: Index, pairs: DataFrame, *, normalize: bool = True) -> DataFrame:
    """``qid, item, score`` of ``qid, item, query, text``: BM25 of a text for a query under the index's statistics.

    Query and text tokens are counted inside each row, once each, so only the
    terms that both have are exploded, with their two counts, and joined to
    the term table.
    """
    q, t = (T.normalize_identifiers(F.col(c)) if normalize else F.col(c) for c in ("query", "text"))
    rows = pairs.select("qid", "item", T.tokens(q).alias("q"), T.tokens(t).alias("t"))
    rows = rows.select("qid", "item", F.size("t").alias("dl"), "q", F.filter("t", lambda x: F.array_contains("q", x)).alias("t"))
    shared = F.transform(F.array_distinct("t"), lambda w: F.struct(w.alias("term"), F.size(F.filter("q", lambda x: x == w)).alias("qtf"), F.size(F.filter("t", lambda x: x == w)).alias("tf")))
    counted = rows.select("qid", "item", "dl", F.explode_outer(shared).alias("c")).select("qid", "item", "dl", "c.term", "c.qtf", "c.tf")
    part = F.col("idf") * weight(F.col("tf"), F.col("dl"), F.col("avgdl")) * F.col("qtf")
    joined = counted.join(index.terms.select("term", "idf"), "term", "left").crossJoin(F.broadcast(index.corpus))
    return joined.groupBy("qid", "item").agg(F.round(F.coalesce(F.sum(part), F.lit(0.0)), 9).alias("score"))
