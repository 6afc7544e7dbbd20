"""Encoding of a corpus with a public byte-level BPE, by forced-boundary splitting."""
from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .batches import by_size

FOLDER = "/opt/tokenizers"
#: Fixed value: the pattern by which the vocabulary's texts are cut before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Fragments whose ids a task remembers; beyond it the memory is emptied and filled again.
REMEMBERED = 400_000


class Encoder:
    """Token ids of texts by a rank file.

    A byte pair that occurs inside no token of the vocabulary is never bridged
    by a merge: a text may be cut there, its parts encoded on their own and the
    ids put together.  A cut must also leave the pre-splitting pattern as it is,
    so it is only made after a printable ASCII byte other than space (the
    pattern looks ahead only from white space), and never between a mark and an
    apostrophe (a contraction could begin there).
    """

    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.bpe = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        inside = np.zeros((256, 256), dtype=bool)
        for token in ranks:
            if len(token) > 1:
                part = np.frombuffer(token, dtype=np.uint8)
                inside[part[:-1], part[1:]] = True
        cut = ~inside
        left, right = np.arange(256)[:, None], np.arange(256)[None, :]
        cut &= (left > 32) & (left < 127)
        cut &= (right < 128) | (right >= 192)  # not inside a character
        letter = ((left | 32) >= 97) & ((left | 32) <= 122) | (left >= 48) & (left <= 57)
        cut &= letter | (right != 39)
        self.cut = cut.reshape(-1)
        self.known: dict[bytes, int] = {}
        self.ids: list[np.ndarray] = []

    def fragments(self, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Positions at which ``data`` (UTF-8) falls apart: the certain cuts and the ``ends`` of texts."""
        if len(data) < 2:
            return np.unique(ends)
        pair = data[:-1].astype(np.int32) * 256 + data[1:]
        return np.union1d(np.flatnonzero(self.cut[pair]) + 1, ends)

    def encode(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts that end at ``ends`` in ``data``, and how many each text has."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
            self.ids.clear()
        ends = ends.astype(np.int64)
        at = self.fragments(data, ends[ends > 0])
        raw = data.tobytes()
        known, new = self.known, []
        starts, stops = [0, *at[:-1].tolist()], at.tolist()
        which = []
        for a, b in zip(starts, stops):
            part = raw[a:b]
            k = known.get(part)
            if k is None:
                known[part] = k = len(known)
                new.append(part)
            which.append(k)
        for part in new:
            self.ids.append(np.array(self.bpe.encode_ordinary(part.decode()), dtype=np.int32))
        if not which:
            return np.empty(0, np.int32), np.zeros(len(ends), np.int64)
        each = np.array([len(self.ids[k]) for k in which], dtype=np.int64)
        total = np.concatenate(([0], np.cumsum(each)))
        upto = total[np.searchsorted(at, ends, side="right")]  # ids before the end of each text
        return np.concatenate([self.ids[k] for k in which]), np.diff(upto, prepend=0)


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _joined(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column end to end, and where each value ends (null and empty: no bytes)."""
    values = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(values.buffers()[1], dtype=np.int64)[values.offset : values.offset + len(values) + 1]
    body = values.buffers()[2]
    data = np.frombuffer(body, dtype=np.uint8)[offsets[0] : offsets[-1]] if body is not None else np.empty(0, np.uint8)
    return data, offsets[1:] - offsets[0]


def encode_texts(df: DataFrame, key: str = "doc_id", text: str = "text", *, path: str | None = None, count_only: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """``(key, ids)`` of every row, or ``(key, n_tokens)`` with ``count_only``.

    Narrow: one pass over the rows, no shuffle.  Defined cases: null and empty
    texts have no ids (an empty list); white space has its ids; special tokens
    are never added and their strings are ordinary text; repeated rows are
    encoded each; a null key stays null.  ``keep`` names further columns to
    carry along.  ``path``: the rank file, by default byte_bpe_50k.tiktoken in
    $TOKENIZER_DIR or in ``FOLDER``.
    """
    path = path or os.path.join(os.environ.get("TOKENIZER_DIR", FOLDER), "byte_bpe_50k.tiktoken")
    carried = [key, *keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for batch in by_size(batches, "_t"):
            ids, sizes = bpe.encode(*_joined(batch.column("_t")))
            if count_only:
                last = pa.array(sizes, pa.int32())
            else:
                offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
                last = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids, pa.int32()))
            names = [*carried, "n_tokens" if count_only else "ids"]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(carried))), last], names=names)

    shape = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in carried)
    shape += ", n_tokens int" if count_only else ", ids array<int>"
    return df.select(*carried, F.col(text).alias("_t")).mapInArrow(run, shape)
