import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscope.conf import EngineConf, parse_ks
from folioscope.operators import dense, fuse, lexical, planner, rerank, retrieve, rewrite

HIT = "qid string, ranking_id int, rank int, score double, chunk_id string, doc_id string, start_page int, end_page int, text string"
TEXTS = ["the hash tree binds leaves", "ML-KEM.KeyGen makes keys", "a tree of keys and keys", "nothing here", ""]


def store(spark):
    return spark.createDataFrame([(i, f"c{i}", "d", i, i, t) for i, t in enumerate(TEXTS)], "vector_id long, chunk_id string, doc_id string, start_page int, end_page int, text string")


def words(t):
    import re

    out = []
    for w in re.findall(r"[a-z0-9]+(?:[-._][a-z0-9]+)+|[a-z0-9]+", t.lower()):
        out += [w, *re.split("[-._]", w)] if re.search("[-._]", w) else [w]
    return out


def test_bm25_against_brute_force(spark):
    index = lexical.build_index(store(spark))
    got = {(r["qid"], r["id"]): r["score"] for r in lexical.search(index, spark.createDataFrame([("q", "tree keys keys unknown")], "qid string, query string"), 10).collect()}
    docs = [words(t) for t in TEXTS]
    avg = sum(map(len, docs)) / len(docs)
    for i, d in enumerate(docs):
        tf, score = Counter(d), 0.0
        for term, qtf in Counter(words("tree keys keys unknown")).items():
            df = sum(term in x for x in docs)
            if tf[term]:
                score += math.log(1 + (len(docs) - df + 0.5) / (df + 0.5)) * tf[term] * 2.5 / (tf[term] + 1.5 * (0.25 + 0.75 * len(d) / avg)) * qtf
        assert abs(got.get(("q", i), 0.0) - score) < 1e-8
    pairs = spark.createDataFrame([("q", str(i), "tree keys keys unknown", t) for i, t in enumerate(TEXTS)], "qid string, item string, query string, text string")
    for r in lexical.score_texts(index, pairs).collect():
        assert abs(r["score"] - got.get(("q", int(r["item"])), 0.0)) < 1e-8


def test_index_round_trip(spark, tmp_path):
    index = lexical.build_index(store(spark))
    lexical.write_index(index, str(tmp_path), 2)
    again = lexical.read_index(spark, str(tmp_path))
    assert {tuple(r) for r in again.postings.collect()} == {tuple(r) for r in index.postings.select("term", "id", "tf", "dl").collect()}


def test_dense_search_and_pages(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 8))
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, vector array<double>").repartition(5)
    got = {(r["qid"], r["rank"]): r["id"] for r in dense.search(v.where("id < 3").select(F.col("id").alias("qid"), "vector"), v, 4).collect()}
    for q in range(3):
        assert [got[(q, k)] for k in range(1, 5)] == np.argsort(-(x @ x[q]), kind="stable")[:4].tolist()
    ranked = spark.createDataFrame([("q", r, "d", r // 2, r // 2) for r in range(1, 9)], "qid string, rank int, doc_id string, start_page int, end_page int")
    assert [r["start_page"] for r in dense.spread_pages(ranked, 3).orderBy("rank").collect()] == [0, 1, 2]
    unit = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "e array<float>").select(dense.normalized(F.col("e")).alias("v")).collect()
    assert unit[0]["v"] == [0.6, 0.8] and unit[1]["v"] == [0.0, 0.0]


def test_rrf(spark):
    rows = [("q", 0, 1, 0.9, "a", "d", 1, 1, "ta"), ("q", 0, 2, 0.8, "b", "d", 1, 1, None), ("q", 1, 1, 0.9, "b", "d", 1, 1, "tb"), ("q", 1, 2, 0.5, "c", "c", 1, 1, "tc"), ("q", 1, 3, 0.5, "e", "d", 0, 0, "te")]
    got = fuse.rrf(spark.createDataFrame(rows, HIT), 10).orderBy("rank").collect()
    assert [r["chunk_id"] for r in got] == ["b", "a", "c", "e"] and abs(got[0]["score"] - (1 / 62 + 1 / 61)) < 1e-9 and got[0]["text"] == "tb"
    again = fuse.rrf(spark.createDataFrame(rows[::-1], HIT).repartition(3), 10).orderBy("rank").collect()
    assert again == got
    with pytest.raises(ValueError):
        fuse.rrf(spark.createDataFrame(rows, HIT), 10, 0)


@pytest.mark.parametrize("query, mode", [("Compare A and B", "compare"), ("what is Algorithm 3", "algorithm"), ("What is LWE?", "definition"), ("Why does it work?", "general"), ("x stands for y", "definition")])
def test_modes(spark, query, mode):
    assert spark.range(1).select(rewrite.mode(F.lit(query)).alias("m")).head()["m"] == mode


def test_variants(spark):
    q = spark.createDataFrame([("1", "What is ML-KEM?"), ("2", "difference between A-1 and B-2?"), ("3", "Algorithm 12 steps"), ("4", "  "), ("5", "pqc standards for ML-DSA verify")], "qid string, query string")
    got = {}
    for r in rewrite.expand(q).orderBy("qid", "variant_no").collect():
        got.setdefault(r["qid"], []).append(r["variant"])
    assert got["1"] == ["What is ML-KEM?", "definition of ML-KEM", "ML-KEM stands for", "ML-KEM notation"]
    assert got["2"] == ["difference between A-1 and B-2?", "A-1 intended use-cases", "B-2 intended use-cases", "A-1 vs B-2"]
    assert got["3"] == ["Algorithm 12 steps", "Algorithm 12", "Algorithm 12 ML-KEM.KeyGen"] and "4" not in got
    assert got["5"][1].startswith("FIPS 203") and "ML-DSA.Verify" in got["5"]


def test_rerank_promotes_only_through_the_gate(spark):
    rows = [("q", r, f"c{r}", "d", r, r, t, 1.0 / r) for r, t in enumerate(["plain words", "other words", "here is ML-KEM.KeyGen and Algorithm steps ML-KEM.KeyGen"], 1)]
    hits = spark.createDataFrame(rows, "qid string, rank int, chunk_id string, doc_id string, start_page int, end_page int, text string, score double")
    index = lexical.build_index(store(spark))
    q = lambda text: spark.createDataFrame([("q", text)], "qid string, query string")
    got = rerank.rerank(hits, q("algorithm ML-KEM.KeyGen steps"), index, 4).orderBy("rank").collect()
    assert [r["chunk_id"] for r in got] == ["c3", "c1", "c2"] and got[0]["promoted"] and got[0]["score"] == rows[2][7]
    same = rerank.rerank(hits, q("zzz"), index, 4).orderBy("rank").collect()
    assert [r["chunk_id"] for r in same] == ["c1", "c2", "c3"]
    sections = spark.createDataFrame([("q", "section::d::2 Key Terms")], "qid string, section_id string")
    meta = spark.createDataFrame([("c2", "2 Key Terms > 2.1 X"), ("c1", "9 Other")], "chunk_id string, section_path string")
    prior = rerank.rerank(hits, q("zzz"), index, 4, sections, meta).orderBy("rank").collect()
    assert prior[0]["chunk_id"] == "c2" and prior[0]["section_prior_applied"]


def test_plans(spark):
    rows = [("1", "Compare ML-KEM and ML-DSA"), ("2", "What is LWE?"), ("3", "Explain Algorithm 7 in FIPS 203"), ("4", "how are keys stored")]
    got = {r["qid"]: r for r in planner.analyse(spark.createDataFrame(rows, "qid string, query string")).collect()}
    assert got["1"]["mode_hint"] == "compare" and got["1"]["doc_ids"] == ["NIST.FIPS.203", "NIST.FIPS.204"] and len(got["1"]["subqueries"]) == 2 and got["1"]["confidence"] == 0.88
    assert got["2"]["mode_hint"] == "definition" and got["2"]["canonical_query"] == "LWE" and got["2"]["sparse_query"] == "LWE definition"
    assert got["3"]["mode_hint"] == "algorithm" and got["3"]["required_anchors"] == ["Algorithm 7"] and got["3"]["dense_query"] == "steps and procedure for Algorithm 7 in FIPS 203"
    assert got["4"]["mode_hint"] == "general" and not got["4"]["rewrite_needed"] and got["4"]["confidence"] == 0.52
    plans = planner.analyse(spark.createDataFrame(rows, "qid string, query string"))
    merged = planner.merge_suggestion(plans, spark.createDataFrame([("4", 'ok {"sparse_query": "key storage", "confidence": 7, "mode_hint": "compare"}')], "qid string, reply string"))
    four = merged.where("qid = '4'").head()
    assert four["sparse_query"] == "key storage" and four["confidence"] == 1.0 and four["mode_hint"] == "general"


def test_hybrid_end_to_end(spark):
    corpus = retrieve.corpus_of(store(spark))
    out = retrieve.retrieve(spark.createDataFrame([("q", "hash tree leaves")], "qid string, query string"), corpus, EngineConf(top_k=2))
    got = out.final.orderBy("rank").collect()
    assert got[0]["chunk_id"] == "c0" and len(got) == 2
    assert retrieve.in_scope(out.final, ["x"]).count() == 0 and retrieve.in_scope(out.final, []).count() == 2


def test_settings():
    conf = EngineConf.from_env({"TOP_K": "3", "RETRIEVAL_QUERY_FUSION": "no", "ASK_MIN_EVIDENCE_HITS": "4", "RETRIEVAL_MODE": " base "})
    assert (conf.top_k, conf.retrieval_query_fusion, conf.agent_min_evidence_hits, conf.retrieval_mode) == (3, False, 4, "base")
    assert parse_ks("5,1, 3,5") == [1, 3, 5]
    with pytest.raises(ValueError):
        EngineConf(top_k=0, retrieval_mode="x").checked()
    with pytest.raises(ValueError):
        parse_ks("0")


def test_dense_tiles_keep_ties_and_order(spark, monkeypatch):
    monkeypatch.setattr(dense.Top, "TILE", 50)
    rng = np.random.default_rng(7)
    x = rng.integers(-1, 2, size=(300, 3)).astype(float)  # many equal scores
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, vector array<double>").repartition(3)
    got = {(r["qid"], r["rank"]): r["id"] for r in dense.search(v.where("id < 40").select(F.col("id").alias("qid"), "vector"), v, 6).collect()}
    for q in range(40):
        assert [got[(q, k)] for k in range(1, 7)] == sorted(range(300), key=lambda i: (-round(x[i] @ x[q], 9), i))[:6]


def test_search_with_shuffled_terms_is_the_same(spark, monkeypatch):
    index = lexical.build_index(store(spark))
    asked = spark.createDataFrame([("q", "tree keys keys unknown"), ("r", "the root")], "qid string, query string")
    want = {tuple(r) for r in lexical.search(index, asked, 10).collect()}
    monkeypatch.setattr(lexical, "CARRIED", 0)
    assert {tuple(r) for r in lexical.search(index, asked, 10).collect()} == want


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from folioscope.session import checkpointing

    made = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: ""), sparkContext=SimpleNamespace(master="spark://x:7077", getCheckpointDir=lambda: None))
    with pytest.raises(RuntimeError):
        checkpointing(made)
