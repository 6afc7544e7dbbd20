"""Most similar vectors for every vector, by a forest of random-projection trees."""
from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.internal import InternalFunction

from ..session import checkpointing

TREES, LEAF = 4, 4096
#: Leaves that a vector is sent to, at most; each forest takes as many as it needs for ``RECALL`` among the vectors it was fitted on.
PROBES, RECALL = 64, 0.98
#: Vectors of a collection on which its forest is fitted, at most (about; drawn by a hash of the id), and their bytes, at most.
SAMPLE, SAMPLE_BYTES = 250_000, 64_000_000
#: A node is split only where it has so many vectors of the sample.
LEAST = 32
#: Vectors whose neighbours are looked up exactly, to see how many leaves a forest needs.
TRIED = 200
#: Members of a leaf that one task compares with its queries, about; larger leaves are cut into several blocks.
BLOCK = 16_384
#: Bytes of directions that a forest may have, and that one round of routing carries to the tasks (about).
FOREST, ROUND = 32_000_000, 32_000_000


def depth_of(total: int, sample: int, dim: int, trees: int, leaf: int) -> int:
    """Levels of the trees for ``total`` vectors: leaves of about ``leaf``, but no node with hardly any of the sample and no forest beyond ``FOREST`` bytes."""
    wanted = math.ceil(math.log2(max(1, total) / leaf))
    return max(0, min(wanted, int(math.log2(max(1, sample / LEAST))), int(math.log2(FOREST / (4 * trees * max(1, dim)) + 1))))


def fit(vectors: np.ndarray, total: int, trees: int, leaf: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Directions (trees, 2^depth - 1, dim) and thresholds (trees, 2^depth - 1) of a forest for ``total`` vectors.

    Every node has a direction of its own, the difference of two of its vectors
    (of three pairs the one along which they spread most), and splits at the
    median of its part of the sample.
    """
    rng = np.random.default_rng(seed)
    n, dim = vectors.shape
    depth = depth_of(total, n, dim, trees, leaf)
    dirs = np.zeros((trees, 2**depth - 1, dim), dtype=np.float32)
    cuts = np.zeros((trees, 2**depth - 1), dtype=np.float32)
    for t in range(trees):
        parts = [np.arange(n)]
        for level in range(depth):
            below = []
            for i, rows in enumerate(parts):
                some = rows if len(rows) <= 256 else rng.choice(rows, 256, replace=False)
                best, spread = None, -1.0
                for _ in range(3):
                    a, b = rng.choice(some, 2)
                    d = vectors[a] - vectors[b]
                    if not np.linalg.norm(d) > 1e-6:
                        d = rng.normal(size=dim).astype(np.float32)
                    d = d / np.linalg.norm(d)
                    if (wide := float((vectors[some] @ d).std())) > spread:
                        best, spread = d, wide
                p = vectors[rows] @ best
                at = 2**level - 1 + i
                dirs[t, at], cuts[t, at] = best, np.median(p)
                side = p > cuts[t, at]
                # equal values all lie on one side; then any vector may go to either
                if side.all() or not side.any():
                    side = np.arange(len(rows)) % 2 == 0
                below += [rows[~side], rows[side]]
            parts = below
    return dirs, cuts


def route(vectors: np.ndarray, dirs: np.ndarray, cuts: np.ndarray, probes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every vector the ``probes`` best leaves over all trees: tree, leaf, and whether it is the vector's own leaf.

    One priority queue is shared by all trees: a way down costs the sum of the
    squared distances to the hyperplanes it crosses.  The near child costs as
    much as its parent, so keeping the cheapest ``probes`` nodes at every level
    gives the same leaves as popping a queue node by node.
    """
    n, (trees, nodes, _) = len(vectors), dirs.shape
    tree = np.repeat(np.arange(trees)[None], n, axis=0)
    node, cost = np.zeros_like(tree), np.zeros(tree.shape, dtype=np.float32)
    crossed = np.zeros(tree.shape, dtype=bool)
    for level in range(int(math.log2(nodes + 1))):
        at = 2**level - 1 + node
        gap = np.einsum("npd,nd->np", dirs[tree, at], vectors) - cuts[tree, at]
        near = node * 2 + (gap > 0)
        tree = np.concatenate((tree, tree), 1)
        cost = np.concatenate((cost, cost + gap * gap), 1)
        crossed = np.concatenate((crossed, np.ones_like(crossed)), 1)
        node = np.concatenate((near, near ^ 1), 1)
        if cost.shape[1] > probes:
            # own leaves come first, whatever the others cost
            best = np.argpartition(np.where(crossed, cost, -1.0), probes - 1, axis=1)[:, :probes]
            tree, node, cost, crossed = (np.take_along_axis(x, best, 1) for x in (tree, node, cost, crossed))
    return tree, node, ~crossed


def probes_needed(vectors: np.ndarray, dirs: np.ndarray, cuts: np.ndarray, k: int, most: int, recall: float, seed: int) -> int:
    """How many leaves the forest must be searched in, so that ``recall`` of the true ``k`` neighbours within the sample are in them.

    The sample is thinner than the collection, so its neighbours are farther
    apart and the number is rather too high than too low.
    """
    trees, n = len(dirs), len(vectors)
    tried = np.random.default_rng(seed).choice(n, min(TRIED, n), replace=False)
    near = np.full((len(tried), k), -np.inf, dtype=np.float32)
    who = np.zeros((len(tried), k), dtype=np.int64)
    for lo in range(0, n, 16_384):
        sims = vectors[tried] @ vectors[lo : lo + 16_384].T
        sims[np.arange(lo, lo + sims.shape[1])[None] == tried[:, None]] = -np.inf
        near, who = np.concatenate((near, sims), 1), np.concatenate((who, np.broadcast_to(np.arange(lo, lo + sims.shape[1]), sims.shape)), 1)
        best = np.argpartition(-near, k - 1, axis=1)[:, :k]
        near, who = np.take_along_axis(near, best, 1), np.take_along_axis(who, best, 1)
    real = np.isfinite(near)
    if not real.any():
        return trees
    spots = np.unique(who[real])
    at = np.searchsorted(spots, np.where(real, who, spots[0]))
    tree, node, own = route(vectors[spots], dirs, cuts, trees)
    home = np.zeros((len(spots), trees), dtype=np.int64)
    np.put_along_axis(home, tree, node, 1)  # the own leaf in every tree
    probes = trees
    while True:
        tree, node, _ = route(vectors[tried], dirs, cuts, probes)
        there = np.stack([(home[at[i]][:, tree[i]] == node[i]).any(1) for i in range(len(tried))])
        if probes >= most or there[real].mean() >= recall:
            return probes
        probes = min(most, probes + 2)


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    raw = column.to_pylist()
    return np.frombuffer(b"".join(raw), dtype=np.float32).reshape(len(raw), -1)


def usable(vectors: DataFrame, meta: DataFrame) -> DataFrame:
    """``path, vector_id, vec, h``: the vectors that count, scaled to length 1 (float32 bytes), and a hash of their direction."""
    known = meta.where(F.col("embeddings_path").isNotNull()).groupBy("embeddings_path").agg(F.max("dim").alias("_dim"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col("embeddings_path"), "vector_id", "embedding").where(F.col("vector_id").isNotNull() & F.col("embedding").isNotNull())
    rows = rows.join(known, "embeddings_path").where(F.size("embedding") == F.col("_dim"))
    rows = rows.where(finite & F.exists("embedding", lambda x: x != 0)).select(F.col("embeddings_path").alias("path"), "vector_id", "embedding")

    def scale(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vec, marks = [], []
            for v in batch.column("embedding").to_numpy(zero_copy_only=False):
                v = np.asarray(v, dtype=np.float64)
                v = v / np.abs(v).max()
                v = v / np.linalg.norm(v)
                vec.append(v.astype(np.float32).tobytes())
                marks.append(xxhash.xxh64_intdigest((np.round(v, 5) + 0.0).astype(np.float32).tobytes()) - 2**63)
            yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("vector_id"), pa.array(vec, pa.binary()), pa.array(marks, pa.int64())], names=["path", "vector_id", "vec", "h"])

    return rows.mapInArrow(scale, "path string, vector_id long, vec binary, h long").dropDuplicates(["path", "h", "vector_id"])


def nearest(vectors: DataFrame, meta: DataFrame, k: int = 5, trees: int = TREES, leaf: int | None = LEAF, probes: int = PROBES, sample: int = SAMPLE, recall: float = RECALL) -> DataFrame:
    """``a, b``: every usable vector ``a`` with its ``k`` most similar vectors ``b`` of the same collection (cosine).

    ``vectors`` has ``vector_id, embeddings_path, embedding``, ``meta`` has
    ``embeddings_path, dim``.  Vectors of one direction (equal to five places)
    are one class, which is searched once.  A collection of at most ``leaf``
    classes is one leaf, that is, searched exactly; a larger one has ``trees``
    trees, fitted on a bounded sample and holding every class.  Each class is
    sent to its own leaves as a member and to the cheapest leaves as a query,
    to as many as its forest needs for ``recall`` within the sample, at most
    ``probes``; leaves are searched by exact products in blocks of bounded
    size, reranked in double precision, and the bounded lists of a class are
    merged.  ``leaf=None`` searches every collection exactly: it is one leaf of
    many blocks, and every vector goes to all of them.

    Defined cases: a vector counts if its path is in ``meta``, its id is not
    null and its embedding has ``dim`` elements, all finite and not all zero.
    Rows sent twice count once.  A collection of one vector gives no row, one
    of fewer than k + 1 gives all others.  Equal similarities go by id.  Empty
    tables give an empty result; other columns are ignored.
    """
    spark = vectors.sparkSession
    checkpointing(spark)
    rows = usable(vectors, meta)
    # a class keeps the k + 1 smallest ids: enough for each of its members to leave itself out
    classes = rows.groupBy("path", "h").agg(
        F.min("vector_id").alias("rep"), F.min_by("vec", "vector_id").alias("vec"), F.count(F.lit(1)).alias("n"),
        F.array_sort(InternalFunction.collect_top_k(F.col("vector_id"), k + 1, True)).alias("heads"),
    ).checkpoint()
    reps = classes.select("path", "rep", "vec")
    totals = reps.groupBy("path").agg(F.count(F.lit(1)).alias("total"), F.max(F.length("vec")).alias("width"))
    large = totals.where(F.lit(False) if leaf is None else F.col("total") > leaf)
    # about `sample` classes of each large collection, the same at every run
    fraction = F.pmod(F.xxhash64("rep"), F.lit(1_000_003)) / 1_000_003
    drawn = reps.join(large, "path").where(fraction < F.least(F.lit(float(sample)), F.lit(float(SAMPLE_BYTES)) / F.col("width")) / F.col("total"))

    def grow(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rep")
        x = np.frombuffer(b"".join(pdf["vec"]), dtype=np.float32).reshape(len(pdf), -1)
        total, seed = int(pdf["total"].iloc[0]), xxhash.xxh32_intdigest(key[0])
        dirs, cuts = fit(x, total, trees, leaf, seed)
        need = probes_needed(x, dirs, cuts, k, max(probes, trees), recall, seed)
        blocks = -(-total // (cuts.shape[1] + 1) // BLOCK)
        return pd.DataFrame({"path": [key[0]], "dirs": [dirs.tobytes()], "cuts": [cuts.tobytes()], "probes": [need], "blocks": [blocks]})

    forests = drawn.groupBy("path").applyInPandas(grow, "path string, dirs binary, cuts binary, probes int, blocks long").checkpoint()
    # whole collections without a forest that are larger than a block are cut into blocks as well
    wide = {r["path"]: -(-r["total"] // BLOCK) for r in totals.where(F.col("total") > BLOCK).join(forests.select("path"), "path", "left_anti").collect()} if leaf is None or leaf > BLOCK else {}
    weight, n_forests = forests.agg(F.coalesce(F.sum(F.length("dirs") + F.length("cuts")), F.lit(0)), F.count(F.lit(1))).head()
    rounds = max(1, min(n_forests, -(-weight // ROUND)))

    def sender(own: dict):
        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for batch in (whole.slice(lo, 2048) for lo in range(0, len(whole), 2048)):
                    paths = np.array(batch.column("path").to_pylist(), dtype=object)
                    for p in sorted(set(paths)):
                        part = batch.filter(pa.array(paths == p))
                        dirs, cuts, need, blocks = own.get(p) or (None, None, 1, wide.get(p, 1))
                        if dirs is not None:
                            x = _matrix(part.column("vec"))
                            tree, node, member = route(x, dirs.reshape(trees, -1, x.shape[1]), cuts.reshape(trees, -1), need)
                        else:  # a collection without a forest is one leaf
                            tree, node, member = np.zeros((len(part), 1)), np.zeros((len(part), 1)), np.ones((len(part), 1), dtype=bool)
                        n, sent = tree.shape
                        home = part.column("rep").to_numpy() % blocks  # a member is in one block of its leaf, a query goes to all
                        block = np.broadcast_to(np.arange(blocks), (n, sent, blocks))
                        member = (member[:, :, None] & (block == home[:, None, None])).reshape(-1)
                        take = pa.array(np.repeat(np.arange(n), sent * blocks))
                        place = (np.repeat(node.reshape(-1), blocks) * blocks + block.reshape(-1)).astype(np.int64)
                        yield pa.RecordBatch.from_arrays(
                            [*[part.column(c).take(take) for c in ("path", "rep", "vec")], pa.array(np.repeat(tree.reshape(-1), blocks).astype(np.int32)), pa.array(place), pa.array(member)],
                            names=["path", "rep", "vec", "tree", "leaf", "member"])
        return send

    def search(table: pa.Table) -> pa.Table:
        ids = table.column("rep").to_numpy()
        x = _matrix(table.column("vec"))
        own = table.column("member").to_numpy(zero_copy_only=False)
        who, m = ids[own], x[own]
        take = min(k + 3, len(who))  # itself and a few more than needed, for the exact comparison
        out: list[list] = [[], [], []]
        for lo in range(0, len(ids) if take else 0, 1024):
            q = x[lo : lo + 1024]
            sims = q @ m.T
            best = np.argpartition(-sims, take - 1, axis=1)[:, :take]
            exact = np.einsum("qd,qkd->qk", q.astype(np.float64), m[best].astype(np.float64))
            exact[who[best] == ids[lo : lo + 1024, None]] = -np.inf
            order = np.lexsort((who[best], -exact), axis=1)[:, :k]
            best, exact = np.take_along_axis(best, order, 1), np.take_along_axis(exact, order, 1)
            a = np.repeat(ids[lo : lo + 1024], best.shape[1])
            keep = np.isfinite(exact.reshape(-1))
            for column, values in zip(out, (a, who[best].reshape(-1), exact.reshape(-1))):
                column.append(values[keep])
        cols = [np.concatenate(c) if c else np.empty(0) for c in out]
        return pa.table({"a": pa.array(cols[0].astype(np.int64)), "b": pa.array(cols[1].astype(np.int64)), "sim": pa.array(np.round(cols[2].astype(np.float64), 9))})

    found = None
    turn = F.pmod(F.xxhash64("path"), F.lit(rounds))
    for i in range(rounds):
        own = {r["path"]: (np.frombuffer(r["dirs"], np.float32), np.frombuffer(r["cuts"], np.float32), r["probes"], r["blocks"]) for r in forests.where(turn == i).toLocalIterator()}
        sent = reps.where(turn == i).mapInArrow(sender(own), "path string, rep long, vec binary, tree int, leaf long, member boolean")
        part = sent.groupBy("path", "tree", "leaf").applyInArrow(search, "a long, b long, sim double")
        # a finished round leaves no forest behind on the driver
        part = part.checkpoint() if rounds > 1 else part
        found = part if found is None else found.unionByName(part)

    def top(df: DataFrame, name: str) -> DataFrame:
        heap = InternalFunction.collect_top_k(F.struct((-F.col("sim")).alias("neg"), F.col("b")), k, True)
        return df.groupBy("a").agg(F.array_sort(heap).alias(name))

    lists = top(found.groupBy("a", "b").agg(F.max("sim").alias("sim")), "near")
    several = classes.where(F.col("n") > 1).select(F.col("path").alias("_p"), F.col("h").alias("_h"), "rep", "heads")
    # a neighbouring class stands for its members
    flat = lists.select("a", F.explode("near").alias("e")).select("a", F.col("e.b").alias("rep"), (-F.col("e.neg")).alias("sim"))
    flat = flat.join(several.select("rep", "heads"), "rep", "left").select("a", "sim", F.explode(F.coalesce("heads", F.array("rep"))).alias("b"))
    lists = top(flat, "near").withColumn("near", F.transform("near", lambda e: e["b"]))
    # members of a class come before any other; salted, as one class may hold a third of all vectors
    salts = 16
    spread = several.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    members = rows.select("path", "h", "vector_id").withColumn("_s", F.pmod(F.hash("vector_id"), F.lit(salts)))
    members = members.join(spread, (F.col("path") == F.col("_p")) & (F.col("h") == F.col("_h")) & (members["_s"] == spread["_s"]))
    members = members.select("rep", "vector_id", F.filter("heads", lambda x: x != F.col("vector_id")).alias("own"))
    full = members.where(F.size("own") >= k).select("vector_id", F.slice("own", 1, k).alias("near"))
    part = members.where(F.size("own") < k).join(lists, F.col("rep") == F.col("a"), "left")
    part = part.select("vector_id", F.slice(F.concat("own", F.coalesce("near", F.array().cast("array<long>"))), 1, k).alias("near"))
    single = lists.join(several.select(F.col("rep").alias("a")), "a", "left_anti").select(F.col("a").alias("vector_id"), "near")
    every = single.unionByName(full).unionByName(part)
    return every.select(F.col("vector_id").alias("a"), F.explode("near").alias("b"))


def near_pairs(vectors: DataFrame, meta: DataFrame, k: int = 5) -> DataFrame:
    """``vec_a, vec_b`` (``vec_a < vec_b``): pairs in which at least one is among the ``k`` most similar of the other."""
    both = nearest(vectors, meta, k)
    return both.select(F.least("a", "b").alias("vec_a"), F.greatest("a", "b").alias("vec_b")).distinct()
