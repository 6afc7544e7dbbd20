import os
import random

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from folioscope.llm.encode import FOLDER, encode_texts, encoder
from folioscope.llm.knn import fit, near_pairs, nearest, route
from folioscope.llm.pack import Bins, pack, pack_documents

RANKS = os.path.join(os.environ.get("TOKENIZER_DIR", FOLDER), "byte_bpe_50k.tiktoken")


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from(" \n\t\r.,!?'’sStdabXé0123-_| ​ 漢字😀"), st.characters(exclude_categories=["Cs"])), max_size=60), max_size=5))
def test_fragments_give_the_plain_encoding(texts):
    enc = encoder(RANKS)
    raw = [t.encode() for t in texts]
    ids, sizes = enc.encode(np.frombuffer(b"".join(raw), dtype=np.uint8), np.cumsum([len(r) for r in raw]))
    assert [p.tolist() for p in np.split(ids, np.cumsum(sizes)[:-1])] == [enc.bpe.encode_ordinary(t) for t in texts] if texts else True


def test_encode_edge_cases(spark):
    long = "Some words, don't they?\n\n  And more 😀. " * 20_000
    rows = [(1, "", "x"), (2, None, "x"), (3, "<|endoftext|>", "x"), (4, long, "x"), (5, "  a", "x"), (None, "b", "x"), (5, "  a", "x")]
    got = {(r["doc_id"], tuple(r["ids"])) for r in encode_texts(spark.createDataFrame(rows, "doc_id long, text string, ids string")).collect()}
    bpe = encoder(RANKS).bpe
    assert got == {(i, tuple(bpe.encode_ordinary(t or ""))) for i, t, _ in rows}
    counts = encode_texts(spark.createDataFrame(rows, "doc_id long, text string, ids string"), count_only=True, keep=("ids",)).collect()
    assert {(r["doc_id"], r["n_tokens"], r["ids"]) for r in counts} == {(i, len(bpe.encode_ordinary(t or "")), "x") for i, t, _ in rows}


def test_best_fit_takes_the_tightest_compatible():
    b = Bins(10)
    assert [b.put(7, 1, 0), b.put(6, 1, 0), b.put(3, 1, 0), b.put(3, 1, 0)] == [0, 1, 0, 1]
    b = Bins(10)
    assert [b.put(6, 1, 1), b.put(3, 1, 1)] == [0, 1]  # a copy never joins its copy
    b = Bins(10)
    assert [b.put(6, 1, 0), b.put(6, 2, 0), b.put(4, 1, 0)] == [0, 1, 1]  # another source is preferred


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 70), st.integers(0, 3), st.integers(0, 5)), max_size=60))
def test_pack_properties(items):
    rows = [(n, i, f"s{s}", c) for i, (n, s, c) in enumerate(items)]
    out = pack(rows, 20)
    for n, i, _, _ in rows:
        ranges = sorted((a, e) for b, k, a, e in out if k == i)
        assert ranges == ([(0, 0)] if n == 0 else [(a, min(n, a + 20)) for a in range(0, n, 20)])
    bins = {}
    for b, k, a, e in out:
        if b is not None:
            bins.setdefault(b, []).append((k, e - a, items[k][2]))
    for b in bins.values():
        assert sum(n for _, n, _ in b) <= 20
        copies = [c for k, n, c in b if n < 20]
        assert len(copies) == len(set(copies))


def test_pack_documents(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice(["a", None, "hot", "hot"]), rng.choice([None, "", "copy text " * 30, f"w{i} " * rng.randrange(1, 900), "solid" * 4000]), "c") for i in range(300)] + [(None, "a", "tail", "c")]
    got = pack_documents(spark.createDataFrame(rows, "doc_id long, source string, text string, container string"), shard=100).collect()
    used = {}
    for r in got:
        assert 0 <= r["end"] - r["start"] <= 2048
        if r["container"] is not None:
            used[r["container"]] = used.get(r["container"], 0) + r["end"] - r["start"]
    assert max(used.values()) <= 2048 and {r["doc_id"] for r in got} == {r[0] for r in rows}
    assert sum(used.values()) / len(used) > 0.9 * 2048
    assert pack_documents(spark.createDataFrame([], "doc_id long, source string, text string")).count() == 0


VEC, META = "vector_id long, embeddings_path string, embedding array<float>, a string", "embeddings_path string, dim int, num_vectors int"


def exact(vectors, k):
    out = set()
    for group in vectors.values():
        ids = np.array([i for i, _ in group])
        x = np.array([v for _, v in group], dtype=np.float64)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        s = np.round(x @ x.T, 9)
        for r in range(len(ids)):
            order = sorted((-s[r, j], ids[j]) for j in range(len(ids)) if j != r)[:k]
            out |= {(min(ids[r], j), max(ids[r], j)) for _, j in order}
    return out


def test_nearest_small_collections_are_exact(spark):
    rng = np.random.default_rng(1)
    groups, rows = {"p": [], "q": [], "one": []}, []
    for i in range(150):
        v = rng.normal(size=8).astype(np.float32) * float(rng.choice([1e-6, 1, 1e6]))
        p = "p" if i % 3 else "q"
        groups[p].append((i, v))
        rows.append((i, p, v.tolist(), "x"))
    for i in range(200, 212):  # copies, more than k
        v = groups["p"][0][1]
        groups["p"].append((i, v))
        rows.append((i, "p", v.tolist(), "x"))
    groups["one"].append((900, np.ones(8)))
    bad = [(300, "p", [0.0] * 8, "x"), (301, "p", [1.0] * 7, "x"), (302, "p", None, "x"), (303, "p", [float("nan")] * 8, "x"), (304, None, [1.0] * 8, "x"), (305, "lost", [1.0] * 8, "x"), (None, "p", [1.0] * 8, "x"), (306, "p", [float("inf")] + [1.0] * 7, "x"), (900, "one", [1.0] * 8, "x")]
    vectors = spark.createDataFrame(rows + bad + rows[:9], VEC)
    meta = spark.createDataFrame([("p", 8, 5), ("q", 8, None), ("one", 8, 1), (None, 8, 1)], META)
    got = {tuple(r) for r in near_pairs(vectors, meta).collect()}
    copies = {0 + 1, *range(200, 212)}
    want = exact(groups, 5)
    apart = {p for p in want if not set(p) <= copies}
    assert {p for p in got if not set(p) <= copies} == apart
    inside = {p for p in got if set(p) <= copies}
    assert all(sum(c in p for p in inside) >= 5 for c in copies)
    assert near_pairs(vectors.limit(0), meta).count() == 0


def test_forest_recall(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 16))
    x = (centres[rng.integers(40, size=3000)] + 0.5 * rng.normal(size=(3000, 16))).astype(np.float32)
    vectors = spark.createDataFrame([(i, "p", v.tolist(), "x") for i, v in enumerate(x)], VEC)
    meta = spark.createDataFrame([("p", 16, 0)], META)
    got = {(r["a"], r["b"]) for r in nearest(vectors, meta, leaf=256, sample=1500).collect()}
    y = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = y @ y.T
    np.fill_diagonal(s, -2)
    want = {(i, int(j)) for i, r in enumerate(np.argsort(-s, axis=1)[:, :5]) for j in r}
    assert len(got & want) / len(want) >= 0.9 and len(got) == len(want)


def test_routes_cover_own_leaves():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(2000, 8)).astype(np.float32)
    dirs, cuts = fit(x, 2000, 3, 100, 1)
    tree, node, own = route(x, dirs, cuts, 9)
    assert dirs.shape == (3, 31, 8) and (own.sum(1) == 3).all()
    sizes = np.bincount(node[own & (tree == 0)], minlength=32)
    assert sizes.max() <= 4 * 2000 / 32
    with pytest.raises(IndexError):
        dirs[3]


def test_rounds_give_the_same_pairs(spark, monkeypatch):
    from folioscope.llm import knn

    rng = np.random.default_rng(5)
    rows = [(i, f"p{i % 3}", rng.normal(size=4).astype(np.float32).tolist(), "x") for i in range(700)] + [(9000 + i, "tiny", [1.0, float(i), 0.0, 0.0], "x") for i in range(3)]
    meta = spark.createDataFrame([("p0", 4, 0), ("p1", 4, 0), ("p2", 4, 0), ("tiny", 4, 0)], META)
    vectors = spark.createDataFrame(rows, VEC)
    once = {tuple(r) for r in nearest(vectors, meta, leaf=64).collect()}
    monkeypatch.setattr(knn, "ROUND", 1)
    assert {tuple(r) for r in nearest(vectors, meta, leaf=64).collect()} == once


def _exact(x, k=5):
    y = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float64)
    s = y @ y.T
    np.fill_diagonal(s, -2)
    return {(i, int(j)) for i, r in enumerate(np.argsort(-s, axis=1)[:, :k]) for j in r}


@pytest.mark.parametrize("clusters, sample", [(5, 4000), (60, 1000)])
def test_a_forest_takes_as_many_leaves_as_it_needs(spark, clusters, sample):
    rng = np.random.default_rng(clusters)
    centres = rng.normal(size=(clusters, 24))
    x = (centres[rng.integers(clusters, size=4000)] + 0.5 * rng.normal(size=(4000, 24))).astype(np.float32)
    vectors = spark.createDataFrame([(i, "p", v.tolist(), "x") for i, v in enumerate(x)], VEC)
    meta = spark.createDataFrame([("p", 24, 0)], META)
    want = _exact(x)
    got = {(r["a"], r["b"]) for r in nearest(vectors, meta, leaf=128, sample=sample).collect()}
    assert len(got & want) / len(want) >= 0.9 and len(got) == len(want)


def test_exact_search_in_blocks(spark, monkeypatch):
    from folioscope.llm import knn

    monkeypatch.setattr(knn, "BLOCK", 100)
    rng = np.random.default_rng(8)
    x = rng.normal(size=(450, 12)).astype(np.float32)
    vectors = spark.createDataFrame([(i, "p", v.tolist(), "x") for i, v in enumerate(x)] + [(900 + i, "q", v.tolist(), "x") for i, v in enumerate(x[:30])], VEC)
    meta = spark.createDataFrame([("p", 12, 0), ("q", 12, 0)], META)
    got = {(r["a"], r["b"]) for r in nearest(vectors, meta, leaf=None).collect()}
    assert {p for p in got if p[0] < 900} == _exact(x) and {(a - 900, b - 900) for a, b in got if a >= 900} == _exact(x[:30])
    # leaves beyond a block are cut up, too
    forest = {(r["a"], r["b"]) for r in nearest(vectors, meta, leaf=120, recall=1.0).collect()}
    assert len({p for p in forest if p[0] < 900} & _exact(x)) >= 0.98 * 450 * 5


def test_depth_is_bounded():
    from folioscope.llm.knn import FOREST, LEAST, depth_of

    for total, sample, dim in ((10**9, 250_000, 64), (10**9, 20_000, 768), (10**6, 10**6, 4096), (100, 100, 4), (1, 1, 1)):
        depth = depth_of(total, sample, dim, 4, 4096)
        assert 2**depth * LEAST <= max(sample, LEAST) and (2**depth - 1) * 16 * dim <= FOREST and depth >= 0


def test_equal_projections_do_not_gather():
    from folioscope.llm.knn import fit, probes_needed, route

    x = np.tile(np.array([[1.0, 0.0]], dtype=np.float32), (500, 1))
    dirs, cuts = fit(x, 500, 2, 50, 1)
    assert np.isfinite(dirs).all() and probes_needed(x, dirs, cuts, 5, 8, 0.9, 1) >= 2
    assert (route(x, dirs, cuts, 2)[2].sum(1) == 2).all()


def test_sources_as_conflicts():
    from folioscope.llm.pack import pack

    items = [(100 + i % 700, i, f"s{i % 7}", None) for i in range(400)]
    got = pack(items, 2048, one_of_source=True)
    inside: dict = {}
    for container, key, start, end in got:
        inside.setdefault(container, []).append(key % 7)
        assert end - start == 100 + key % 700
    assert all(len(x) == len(set(x)) for x in inside.values()) and len(got) == 400
    assert len(inside) > len({c for c, *_ in pack(items, 2048)})


def test_large_ids_survive_packing(spark):
    from folioscope.llm.pack import pack_documents

    big = 2**53 + 1
    df = spark.createDataFrame([(big, "s", "one two three"), (None, "s", "four"), (big + 2, None, "")], "doc_id long, source string, text string")
    assert {r["doc_id"] for r in pack_documents(df).collect()} == {big, None, big + 2}
