"""Filling containers of fixed capacity, by conflict-constrained best fit."""
from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .encode import encode_texts

CAPACITY = 2048
#: Documents that are packed together in one task.  Each such shard leaves about one container partly empty.
SHARD = 4096
#: Containers of a level that are looked at for one without an item's source, where sources only guide the choice.
LOOK = 32
PACKED = "container long, doc_id long, start int, end int"


class Bins:
    """Open containers ordered by the room left in them.

    ``levels[r]`` holds the containers with exactly ``r`` free, in the order in
    which they got there, and bit ``r`` of ``mask`` says that there are any: the
    tightest level that takes an item is one shift and one lowest-bit away.
    Every container carries the bitmap of the sources and the bitmap of the
    duplicate clusters in it.
    """

    def __init__(self, capacity: int, one_of_source: bool = False):
        self.capacity = capacity
        self.one_of_source = one_of_source
        self.levels: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.mask = 0
        self.sources: list[int] = []
        self.clusters: list[int] = []

    def put(self, size: int, source: int, cluster: int) -> int:
        """The container for an item; ``source`` and ``cluster`` are bits (0: none).

        A container with a copy of the item is never taken, nor, with
        ``one_of_source``, one with its source: the search goes on to the next
        level until one is compatible.  Without it, among the compatible ones of
        the tightest level one without the item's source is preferred; of each
        level only the first ``LOOK`` containers are looked at for that, since
        it decides on nothing but the mixture.
        """
        rest = self.mask >> size << size
        while rest:
            room = (rest & -rest).bit_length() - 1
            level, found = self.levels[room], -1
            for at, b in enumerate(level):
                if self.clusters[b] & cluster:
                    continue
                if not self.sources[b] & source:
                    found = at
                    break
                if found < 0 and not self.one_of_source:
                    found = at
                if found >= 0 and at >= LOOK:
                    break
            if found >= 0:
                b = level.pop(found)
                if not level:
                    self.mask &= ~(1 << room)
                break
            rest &= rest - 1
        else:
            b, room = len(self.sources), self.capacity
            self.sources.append(0)
            self.clusters.append(0)
        self.sources[b] |= source
        self.clusters[b] |= cluster
        self.levels[room - size].append(b)
        self.mask |= 1 << (room - size)
        return b


def pack(items: Iterable[tuple], capacity: int = CAPACITY, one_of_source: bool = False) -> list[tuple]:
    """``(container, key, start, end)`` of ``(size, key, source, cluster)`` items, largest first.

    An item beyond the capacity fills containers of its own and its remainder
    is packed like any other; no other item is divided.  Items of size 0 get
    the container None.
    """
    out, rest, full = [], [], []
    for size, key, source, cluster in items:
        if size <= 0:
            out.append((None, key, 0, 0))
            continue
        start = 0
        while size - start > capacity:
            full.append((key, start, start + capacity))
            start += capacity
        rest.append((size - start, key, start, source, cluster))
    rest.sort(key=lambda x: (-x[0], x[1] is None, x[1], x[2]))
    copies: dict = {}
    for _, _, _, _, cluster in rest:
        copies[cluster] = copies.get(cluster, 0) + 1
    bits: dict = {}
    bins, sources = Bins(capacity, one_of_source), {}
    for size, key, start, source, cluster in rest:
        s = 0 if source is None else 1 << sources.setdefault(source, len(sources))
        c = 0 if cluster is None or copies[cluster] < 2 else 1 << bits.setdefault(cluster, len(bits))
        out.append((bins.put(size, s, c), key, start, start + size))
    first = len(bins.sources)
    out.extend((first + i, key, a, b) for i, (key, a, b) in enumerate(full))
    return out


def pack_documents(df: DataFrame, capacity: int = CAPACITY, shard: int = SHARD, path: str | None = None, one_of_source: bool = False) -> DataFrame:
    """``container, doc_id, start, end`` (token range, end excluded) of every row with ``doc_id, source, text``.

    Texts are measured in tokens of byte_bpe_50k.  The rows are dealt to shards
    of about ``shard`` rows by a hash of id and text, so no source, copy group
    or null key gathers in one, and every shard is packed on its own: best fit
    in decreasing order, which leaves little but the shard's last container
    open.  Only ids and sizes travel, never texts.

    Defined cases: empty and null texts have no tokens and stand in the result
    with a null container and the range 0 to 0.  A text of more than
    ``capacity`` tokens is divided, others never.  Copies of one text never
    share a container; with ``one_of_source`` neither do documents of one
    source (a conflict like that of copies; off by default, since a source with
    a third of all documents would leave containers half empty, and the aim is
    as little unused room as possible).  A null source or id is allowed; repeated rows are
    packed each.  An empty table gives an empty result.
    """
    shards = max(1, -(-df.count() // shard))
    rows = df.select("doc_id", "source", "text", F.xxhash64("text").alias("cluster"))
    sized = encode_texts(rows, keep=("source", "cluster"), path=path, count_only=True)
    dealt = sized.withColumn("shard", F.pmod(F.xxhash64("doc_id", "cluster"), F.lit(shards)))

    def fill(key: tuple, table: pa.Table) -> pa.Table:
        got = pack(zip(*(table.column(c).to_pylist() for c in ("n_tokens", "doc_id", "source", "cluster"))), capacity, one_of_source)
        first = key[0].as_py() << 32
        columns = [[None if c is None else c + first for c, *_ in got], *([x[i] for x in got] for i in (1, 2, 3))]
        return pa.table({n: pa.array(v, t) for n, v, t in zip(("container", "doc_id", "start", "end"), columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32()))})

    return dealt.groupBy("shard").applyInArrow(fill, PACKED)
