"""Splitting oversized blocks at natural boundaries, by pointer doubling."""
from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .batches import by_size

LIMIT, OVERLAP = 2200, 200
#: What a natural boundary is, by block type; a boundary lies after the match.
NATURAL = {
    "text": re.compile(r"\n+|(?<=[.!?…])[\"”’)\]]*\s+"),
    "list": re.compile(r"\n(?=\s*(?:[-*•+]|\d+[.):]|\())|\n+"),
    "table": re.compile(r"\n+"),
    "algorithm": re.compile(r"\n+"),
    "code": re.compile(r"\n+"),
    "math": re.compile(r"\n+|\$\$\s*(?=\S)|\\\\\s*"),
}
WORD = re.compile(r"\s+")
PIECES = "block_id long, piece_no int, start int, end int, block_type string, section_path string, text string"


def positions(text: str, kind: str | None, limit: int, overlap: int) -> tuple[np.ndarray, np.ndarray]:
    """Cut positions of a text from 0 to its length, and which of them are natural.

    Where two natural positions are further apart than a piece can reach, word
    ends come between them, and where even those are too far apart, hard cuts.
    """
    n, step = len(text), limit - overlap
    pattern = NATURAL.get((kind or "text").strip().lower(), NATURAL["text"])
    nat = np.unique(np.fromiter((m.end() for m in pattern.finditer(text)), dtype=np.int64))
    nat = np.unique(np.concatenate(([0], nat[(nat > 0) & (nat < n)], [n])))
    extra = []
    for a in np.flatnonzero(np.diff(nat) > step).tolist():
        lo, hi = int(nat[a]), int(nat[a + 1])
        words = [m.end() for m in WORD.finditer(text, lo + 1, hi) if m.end() < hi]
        marks = np.array([lo, *words, hi], dtype=np.int64)
        extra.extend(words)
        for b in np.flatnonzero(np.diff(marks) > step).tolist():
            extra.extend(range(int(marks[b]) + step, int(marks[b + 1]), step))
    both = np.unique(np.concatenate((nat, np.array(extra, dtype=np.int64))))
    return both, np.isin(both, nat)


def cuts(texts: list[str], kinds: list[str | None], limit: int = LIMIT, overlap: int = OVERLAP) -> list[np.ndarray]:
    """The greedy cuts of every text, derived for all texts together.

    All positions of all texts form one table.  Each is joined to its farthest
    legal successor; then the table is squared again and again, and the set of
    positions reached from the starts doubles its depth with every square, so
    log2(pieces) rounds give all cuts.
    """
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be less than the limit")
    marks = [positions(t, k, limit, overlap) for t, k in zip(texts, kinds)]
    if not marks:
        return []
    sizes = np.array([len(p) for p, _ in marks])
    first = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    width = max(int(p[-1]) for p, _ in marks) + limit + 1  # keeps the texts apart on one axis
    base = np.repeat(np.arange(len(marks), dtype=np.int64) * width, sizes)
    pos = np.concatenate([p for p, _ in marks]) + base
    natural = np.concatenate([f for _, f in marks])
    index = np.arange(len(pos))
    reach = pos + (limit - overlap)
    reach[first] = pos[first] + limit  # the first piece repeats nothing
    far = np.searchsorted(pos, reach, side="right") - 1
    far = np.minimum(far, np.repeat(first + sizes - 1, sizes))
    last_natural = np.maximum.accumulate(np.where(natural, index, 0))[far]
    least = index.copy()
    # the first piece must be long enough to share the overlap with the next
    least[first] = np.searchsorted(pos, pos[first] + max(overlap, 1), side="left") - 1
    succ = np.where(last_natural > least, last_natural, far)
    reached = np.zeros(len(pos), dtype=bool)
    reached[first] = True
    while True:
        more = succ[np.flatnonzero(reached)]
        if reached[more].all():
            break
        reached[more] = True
        succ = succ[succ]
    hit = np.flatnonzero(reached)
    ends = np.searchsorted(hit, first + sizes)
    starts = np.searchsorted(hit, first)
    return [pos[hit[a:b]] - i * width for i, (a, b) in enumerate(zip(starts, ends))]


def split_blocks(df: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """Pieces of every block of ``df`` whose text is longer than ``limit``: ``PIECES``.

    Needs ``block_id, block_type, section_path, text``; other columns are
    ignored.  Spaces, tabs and line breaks at both ends of a text do not count
    and are not part of a piece.  A piece has at most ``limit`` code points,
    ends at a natural boundary of its type (sentence and line ends; rows;
    items; code lines) where one is in reach, else at a word end, else
    anywhere; each piece after the first starts ``overlap`` code points before
    the end of the one before, so the pieces together cover the text.
    ``start`` and ``end`` are offsets in the trimmed text.

    Defined cases: null, blank and short texts give no piece.  An unknown or
    null ``block_type`` is cut like ``text`` and is kept as it is, as is a null
    or empty ``section_path``.  Rows sent twice count once (by ``block_id``;
    rows with a null id by their content).  The stale ``char_len`` is not read.
    An empty table gives an empty result.
    """
    text = F.btrim("text", F.lit(" \t\r\n"))
    big = df.select("block_id", "block_type", "section_path", text.alias("text")).where(F.length("text") > limit)
    # only oversized texts travel; a null id is told apart by content
    apart = F.coalesce(F.col("block_id"), F.xxhash64("text", "block_type", "section_path"))
    big = big.withColumn("_k", apart).withColumn("_n", F.col("block_id").isNull())
    big = big.dropDuplicates(["_k", "_n"]).drop("_k", "_n")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("block_id", pa.int64()), ("piece_no", pa.int32()), ("start", pa.int32()), ("end", pa.int32()),
                            ("block_type", pa.string()), ("section_path", pa.string()), ("text", pa.string())])
        for batch in by_size(batches, "text"):
            rows = batch.to_pydict()
            out: list[list] = [[] for _ in schema]
            for b, cut in enumerate(cuts(rows["text"], rows["block_type"], limit, overlap)):
                whole, ends = rows["text"][b], cut.tolist()
                for i in range(1, len(ends)):
                    start = max(0, ends[i - 1] - overlap) if i > 1 else 0
                    for column, value in zip(out, (rows["block_id"][b], i - 1, start, ends[i], rows["block_type"][b], rows["section_path"][b], whole[start : ends[i]])):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema)], schema=schema)

    return big.mapInArrow(pieces, PIECES)
