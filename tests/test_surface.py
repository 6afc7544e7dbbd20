"""HTTP, back ends by name, vectors on disk, batches of pages, rounds of the agent, scopes."""
import io
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscope import api
from folioscope.conf import EngineConf
from folioscope.http import application
from folioscope.operators import agent, dense, graph, reports, retrieve, rewrite
from folioscope.sources import files

TEXTS = ["The hash tree binds keys to the root.", "A key schedule makes keys from a seed.", "The root of the tree is public.", "Nothing else here but words and more words.", "ML-KEM.KeyGen makes a key pair."]


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [(i, f"c{i}", "A" if i % 2 else "B", i + 1, i + 1, t) for i, t in enumerate(TEXTS)]
    return retrieve.corpus_of(spark.createDataFrame(rows, "vector_id long, chunk_id string, doc_id string, start_page int, end_page int, text string"))


def call(app, method, path, body=None):
    got = {}
    raw = json.dumps(body).encode() if body is not None else b""
    out = app({"REQUEST_METHOD": method, "PATH_INFO": path, "CONTENT_LENGTH": str(len(raw)), "wsgi.input": io.BytesIO(raw)}, lambda s, h: got.update(status=s))
    return got["status"][:3], json.loads(b"".join(out))


def test_http(spark, corpus, tmp_path):
    app = application(spark, corpus, EngineConf(), str(tmp_path))
    assert call(app, "GET", "/health")[1]["status"] == "degraded"
    status, found = call(app, "POST", "/search", {"q": "hash tree root", "k": 2})
    assert status == "200" and len(found["hits"]) == 2
    assert call(app, "POST", "/search", {"q": " "})[0] == "422" and call(app, "POST", "/search", {"q": "x", "k": 0})[0] == "422" and call(app, "GET", "/nothing")[0] == "404" and call(app, "GET", "/search")[0] == "405"
    broken = application(spark, None, EngineConf(), str(tmp_path))
    assert call(broken, "POST", "/ask", {"q": "x"})[0] == "500"


def test_retrievers_by_name(spark, corpus):
    asked = spark.createDataFrame([("q", "hash tree root")], "qid string, query string")
    for name in ("bm25", "faiss"):
        assert retrieve.retriever(name)(corpus, asked, 2).where("rank = 1").head()["id"] == 0
    with pytest.raises(ValueError):
        retrieve.retriever("other")


def test_vectors_on_disk(spark, corpus, tmp_path):
    dense.write_vectors(corpus.vectors, str(tmp_path / "v"), "m1", normalized=True)
    assert dense.read_vectors(spark, str(tmp_path / "v"), "m1").count() == len(TEXTS)
    with pytest.raises(ValueError):
        dense.read_vectors(spark, str(tmp_path / "v"), "m2")
    np.save(tmp_path / "x.npy", np.arange(6.0).reshape(3, 2))
    assert [(r["row"], list(r["vector"])) for r in dense.read_npy(spark, str(tmp_path / "x.npy")).orderBy("row").collect()] == [(0, [0.0, 1.0]), (1, [2.0, 3.0]), (2, [4.0, 5.0])]


def test_batches_of_pages_are_halved():
    seen = []

    def render(numbers):
        seen.append(len(numbers))
        if 5 in numbers:
            raise RuntimeError("page 5")
        return [{"page_number": n, "text": f"p{n}"} for n in numbers]

    got = files.in_batches(render, list(range(1, 13)), 8)
    assert [r["page_number"] for r in got] == list(range(1, 13)) and got[4]["text"] == "RuntimeError: page 5" and max(seen) == 8


def test_markdown_parser(spark, tmp_path):
    (tmp_path / "a.md").write_text("# One\ntext\n-----\nsecond page")
    rows = files.parse_documents(spark, str(tmp_path), files.parser("markdown"), "*.md").orderBy("page_number").collect()
    assert [(r["doc_id"], r["page_number"], r["text"]) for r in rows] == [("a", 1, "# One\ntext"), ("a", 2, "second page")]


def test_scopes_narrow_before_the_cut(spark, corpus):
    plans = spark.createDataFrame([("q", "keys", "keys", "keys", [], "general", ["B"]), ("r", "keys", "keys", "keys", [], "general", [])], "qid string, canonical_query string, dense_query string, sparse_query string, subqueries array<string>, mode_hint string, doc_ids array<string>")
    got = retrieve.retrieve_plans(plans, corpus, EngineConf()).final
    assert {r["doc_id"] for r in got.where("qid = 'q'").collect()} == {"B"} and {r["doc_id"] for r in got.where("qid = 'r'").collect()} == {"A", "B"}


def test_rounds_of_the_agent_are_traced(spark, corpus):
    from folioscope.operators import planner

    plans = planner.analyse(spark.createDataFrame([("q", "What is Table 99 of nothing?"), ("r", "hash tree root keys")], "qid string, query string"))
    rounds = []
    agent.run(plans, lambda active: retrieve.retrieve_plans(active, corpus, EngineConf()).final, EngineConf(), trace=rounds)
    events = reports.round_events(rounds)
    per_round = {(r["run_id"], r["round"]) for r in events.where("type = 'retrieval_round_result'").select("run_id", F.col("payload")["round"].alias("round")).collect()}
    assert ("q", "1") in per_round and ("q", "2") in per_round and ("r", "1") in per_round
    assert events.where("node = 'analyze_query'").groupBy("run_id").count().where("count > 2").count() == 0


def test_upsert_and_terms(spark):
    a, b = spark.createDataFrame([("x", 1), ("y", 2)], "id string, v int"), spark.createDataFrame([("y", 3), ("z", 4)], "id string, v int")
    assert sorted(tuple(r) for r in graph.upsert(a, b, "id").collect()) == [("x", 1), ("y", 3), ("z", 4)]
    df = spark.createDataFrame([("Key  Gen", "the key gen, done"), ("key", "monkeys"), ("", "x")], "t string, x string")
    assert [r[0] for r in df.select(rewrite.occurs_in(F.col("t"), F.col("x"))).collect()] == [True, False, False]
    assert api.health("/nowhere")["status"] == "degraded"
