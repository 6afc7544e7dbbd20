"""Lines repeated across the chunks of one document, by content-defined chunking."""
from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .batches import by_size

#: Distinct chunks in which a line must stand to count as repeated.
REPEATED = 5
#: Letters of the rolling window, and how many of its hash's top bits must be zero for a cut (segments of about 2^6 letters).
WINDOW, BITS = 8, 6
SALTS = 8


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x + np.uint64(0x9E3779B97F4A7C15)).astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For every code point, whether it is a letter."""
    return np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)), dtype=bool, count=0x110000)


class Rolling:
    """Polynomial hashes modulo 2^64 of any stretch of a stream, from prefix sums."""

    BASES = (0x9DDFEA08EB382D69, 0xC2B2AE3D27D4EB4F)  # odd, so they have inverses

    def __init__(self, codes: np.ndarray, which: int = 0):
        base = self.BASES[which]
        n = len(codes) + 1
        power = np.full(n, base, dtype=np.uint64)
        power[0] = 1
        power = np.multiply.accumulate(power)
        self.back = np.full(n, pow(base, -1, 2**64), dtype=np.uint64)
        self.back[0] = 1
        self.back = np.multiply.accumulate(self.back)
        self.sums = np.zeros(n, dtype=np.uint64)
        np.cumsum(_mix(codes.astype(np.uint64) + np.uint64(which << 32)) * power[:-1], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[start]) * self.back[start])


def lines_of(texts: list[str]) -> dict[str, np.ndarray]:
    """All lines with letters of ``texts`` and their content-defined segments.

    ``text, line_no`` (from 1), ``s1, s2`` (the hash of the line's letters, 128
    bits), ``n_segs``; ``seg_line, seg``: the segments, each with the index of
    its line and a hash that also says whether it begins and ends its line.
    The letters of a line, ignoring case, are cut where a rolling hash over the
    last ``WINDOW`` letters has ``BITS`` zero bits, so equal lines have equal
    segments.
    """
    codes = np.frombuffer(("\n".join(texts) + "\n").casefold().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    mask = _letters()[codes]
    ends = np.flatnonzero(codes == 10)
    upto = np.cumsum(mask)
    le = upto[ends]  # letters up to the end of each line
    ls = np.concatenate(([0], le[:-1]))
    per_text = np.array([t.count("\n") + 1 for t in texts])
    text = np.repeat(np.arange(len(texts)), per_text)
    line_no = np.arange(len(text)) - np.repeat(np.cumsum(per_text) - per_text, per_text) + 1
    some = le > ls
    text, line_no, ls, le = text[some], line_no[some], ls[some], le[some]
    stream = codes[mask]
    one, two = Rolling(stream, 0), Rolling(stream, 1)
    at = np.arange(WINDOW, len(stream))  # a cut before letter `at`
    cut = at[(one.of(at - WINDOW, at) >> np.uint64(64 - BITS)) == 0]
    line = np.searchsorted(ls, cut, side="right") - 1
    inside = (cut - ls[line] >= WINDOW) & (cut < le[line])
    cut, line = cut[inside], line[inside]
    start = np.sort(np.concatenate((ls, cut)))
    seg_line = np.searchsorted(ls, start, side="right") - 1
    end = np.concatenate((start[1:], le[-1:]))
    # a segment that is a whole line differs from one that only begins or ends like it
    role = np.isin(start, ls).astype(np.uint64) + np.uint64(2) * np.isin(end, le).astype(np.uint64)
    seg = _mix(one.of(start, end) + role).view(np.int64)
    n_segs = np.bincount(seg_line, minlength=len(ls)).astype(np.int32)
    return {"text": text, "line_no": line_no, "s1": one.of(ls, le).view(np.int64), "s2": two.of(ls, le).view(np.int64), "n_segs": n_segs, "seg_line": seg_line, "seg": seg}


def _first_of(*keys: np.ndarray) -> np.ndarray:
    """True at the first row of every distinct combination."""
    order = np.lexsort(keys[::-1])
    new = np.ones(len(order), dtype=bool)
    same = np.ones(max(len(order) - 1, 0), dtype=bool)
    for k in keys:
        k = k[order]
        same &= k[1:] == k[:-1]
    new[1:] = ~same
    out = np.empty(len(order), dtype=bool)
    out[order] = new
    return out


def chunk_texts(hits: DataFrame) -> DataFrame:
    """One row ``doc_id, chunk_id, text`` for every chunk with a text (the greatest, if they differ)."""
    rows = hits.select("doc_id", "chunk_id", "text").dropna()
    return rows.groupBy("doc_id", "chunk_id").agg(F.max("text").alias("text"))


def repeated_lines(hits: DataFrame, least: int = REPEATED) -> DataFrame:
    """``doc_id, chunk_id, line_no`` of every line that stands in at least ``least`` chunks of its document.

    Segments decide.  Every line's letters fall into content-defined segments,
    and the distinct chunks that hold a segment are counted for each document,
    pre-aggregated before the shuffle.  A line all of whose segments are
    repeated is repeated; for a line of one segment (most are) the count is
    exact, since a segment's hash says where it begins and ends, and for the
    others an exact check follows: the hashes of their letters (128 bits) are
    counted over distinct chunks.  Texts travel once, to bring the hits of a
    chunk together, and are read once; after that only hashes and ids do.  A
    document or a line that holds a third of all rows is spread over tasks by
    its chunks (counts are partial sums, the joins are salted).

    Defined cases: rows with a null ``doc_id``, ``chunk_id`` or ``text`` are
    left out; a chunk counts once however often it was hit; lines end at line
    feeds; a line without letters never counts; empty texts and tables give
    nothing; other columns are ignored.
    """
    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_size(batches, "text"):
            got = lines_of(batch.column("text").to_pylist())
            line = got["seg_line"]
            row = got["text"][line]
            several = got["n_segs"][line] > 1
            take = pa.array(row)
            mark = lambda x: pa.array(x[line], mask=~several)
            yield pa.RecordBatch.from_arrays(
                [batch.column("d").take(take), pa.array(got["seg"]), batch.column("salt").take(take), batch.column("doc_id").take(take), batch.column("chunk_id").take(take),
                 pa.array(got["line_no"][line].astype(np.int32)), pa.array(_first_of(row, got["seg"])), pa.array(got["n_segs"][line]), mark(got["s1"]), mark(got["s2"])],
                names=["d", "seg", "salt", "doc_id", "chunk_id", "line_no", "first", "n_segs", "s1", "s2"],
            )

    salt = F.pmod(F.hash("chunk_id"), F.lit(SALTS)).alias("salt")
    keyed = chunk_texts(hits).select(F.xxhash64("doc_id").alias("d"), salt, "doc_id", "chunk_id", "text")
    shape = "d long, seg long, salt int, doc_id string, chunk_id string, line_no int, first boolean, n_segs int, s1 long, s2 long"
    # both uses below read this one exchange: both name all columns, so that neither is pruned to another one
    rows = keyed.mapInArrow(segments, shape).where(F.col("d").isNotNull() & F.col("seg").isNotNull() & F.col("salt").isNotNull() & F.col("doc_id").isNotNull()).repartition("d", "seg", "salt")
    whole = F.col("doc_id").isNotNull() & F.col("chunk_id").isNotNull() & F.col("line_no").isNotNull() & F.col("n_segs").isNotNull() & (F.coalesce("s1", "s2", F.lit(0)) >= F.lit(-(2**63)))
    often = rows.groupBy("d", "seg").agg(F.count(F.when(F.col("first") & whole, 1)).alias("n")).where(F.col("n") >= least).drop("n")
    every = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    held = rows.join(often.withColumn("salt", every), ["d", "seg", "salt"])
    line = held.groupBy("doc_id", "chunk_id", "line_no").agg(
        F.count(F.when(F.col("first").isNotNull(), 1)).alias("held"), F.max("n_segs").alias("n_segs"), F.max(F.coalesce("s1", "seg")).alias("s1"), F.max(F.coalesce("s2", "d")).alias("s2"))
    key = ["doc_id", "s1", "s2"]
    salted = F.coalesce(F.pmod(F.hash("chunk_id"), F.lit(SALTS)), F.lit(0))
    likely = line.where(F.col("held") == F.col("n_segs")).select(*key, "chunk_id", "line_no").withColumn("salt", salted)
    likely = likely.where(F.col("doc_id").isNotNull() & F.col("s1").isNotNull() & F.col("s2").isNotNull()).repartition(*key, "salt")
    # the chunks of one line in one salt are in one place, so a chunk that holds it twice counts once before the shuffle
    chunk = F.when(F.col("line_no").isNotNull(), F.col("chunk_id"))
    per_salt = likely.groupBy(*key, "salt", chunk.alias("chunk_id")).agg(F.count(F.lit(1)).alias("_"))
    exact = per_salt.groupBy(*key).agg(F.count("chunk_id").alias("n")).where(F.col("n") >= least).drop("n")
    return likely.join(exact.withColumn("salt", every), [*key, "salt"]).select("doc_id", "chunk_id", "line_no")


def without_repeated_lines(hits: DataFrame, least: int = REPEATED) -> DataFrame:
    """``doc_id, chunk_id, n_removed, text``: every chunk's text without its repeated lines (see ``repeated_lines``)."""
    found = repeated_lines(hits, least).groupBy("doc_id", "chunk_id").agg(F.collect_list("line_no").alias("cut"))
    rows = chunk_texts(hits).join(found, ["doc_id", "chunk_id"], "left")
    kept = F.filter(F.split("text", "\n", -1), lambda x, i: ~F.array_contains("cut", (i + 1).cast("int")))
    text = F.when(F.col("cut").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    return rows.select("doc_id", "chunk_id", F.when(F.col("cut").isNull(), 0).otherwise(F.size("cut")).alias("n_removed"), text.alias("text"))
