import json
import math

import pytest
from pyspark.sql import functions as F

from folioscope import api
from folioscope.conf import EngineConf
from folioscope.operators import agent, evalkit, evidence, graph, manifest, planner, trace
from folioscope.sources import files
from folioscope.streaming import pages as streaming

HIT = "qid string, chunk_id string, doc_id string, start_page int, end_page int, text string, score double"
STORE = "vector_id long, chunk_id string, doc_id string, start_page int, end_page int, text string"
CITES = "array<struct<key:string,doc_id:string,start_page:int,end_page:int,chunk_id:string>>"


def hits(spark, texts):
    return spark.createDataFrame([("q", f"c{i}", "d", i, i, t, 1.0 / (i + 1)) for i, t in enumerate(texts)], HIT)


def test_evidence_interleaves_neighbours_and_keeps_the_budget(spark):
    store = spark.createDataFrame([(i, f"c{i}", "d", i, i, f"text {i}") for i in range(10)], STORE)
    found = spark.createDataFrame([("q", "c5", "d", 5, 5, "text 5", 0.9), ("q", "c5", "d", 5, 5, "text 5", 0.8), ("q", "c1", "d", 1, 1, "text 1", 0.7), ("q", "c8", "d", 8, 8, " ", 0.6)], HIT)
    got = evidence.select_evidence(found, store).orderBy("pos").collect()
    assert [r["chunk_id"] for r in got] == ["c5", "c4", "c6", "c1", "c0", "c2"]
    short = evidence.select_evidence(found, store, EngineConf(ask_max_context_chars=12)).orderBy("pos").collect()
    assert [r["chunk_id"] for r in short] == ["c5", "c4"]


def test_contexts_and_enforcement(spark):
    items = evidence.select_evidence(hits(spark, ["A. text", "B. text"]), None)
    row = evidence.contexts(items).head()
    assert row["context"].startswith("[c1] d p0-p0 chunk_id=c0\nA. text\n\n---\n\n[c2]") and [c["key"] for c in row["citations"]] == ["c1", "c2"]
    cites = [("c1", "d", 1, 1, "x"), ("c2", "d", 1, 1, "y"), ("c10", "d", 1, 1, "z")]
    drafts = ["Ok [C1, c2].", "No marker.", "Bad [c9].", "One [c1]. Two.", "Not found", "Z [c10] and [c2].", None]
    got = evidence.enforce(spark.createDataFrame([(i, x, cites) for i, x in enumerate(drafts)], f"i int, draft string, citations {CITES}")).orderBy("i").collect()
    assert [r["answer"] == evidence.REFUSAL for r in got] == [False, True, True, True, True, False, True]
    assert [c["key"] for c in got[5]["used"]] == ["c2", "c10"]


def test_answers_and_fallbacks(spark):
    texts = ["Algorithm 4 Foo 1: a <- b 2: return a", "Alpha is a key-encapsulation mechanism for all.", "Beta is a digital signature scheme for all."]
    q = spark.createDataFrame([("q", "Steps of Algorithm 4")], "qid string, query string")
    cmp_q = spark.createDataFrame([("q", "Compare Alpha and Beta?")], "qid string, query string")
    refuse = lambda q, c: "not found in provided docs"
    a = evidence.answer(q, hits(spark, texts), None, refuse).head()
    assert a["source"] == "algorithm" and a["answer"] == "- 1: a <- b [c1].\n- 2: return a [c1]." and [c["chunk_id"] for c in a["citations"]] == ["c0"]
    b = evidence.answer(cmp_q, hits(spark, texts), None, refuse).head()
    assert b["source"] == "comparison" and "- Beta is specified as a digital signature scheme [c2]." in b["answer"] and len(b["citations"]) == 2

    def fail(q, c):
        raise OSError("down")

    assert evidence.answer(cmp_q, hits(spark, texts), None, fail).head()["refusal_reason"] == "backend_error"
    assert evidence.answer(cmp_q, hits(spark, texts[:1]), None, refuse).head()["refusal_reason"] == "insufficient_evidence"
    ok = evidence.answer(cmp_q, hits(spark, texts), None).head()
    assert ok["source"] == "generator" and ok["refusal_reason"] is None


def test_answer_contract(spark):
    rows = [("ok [c1]", [("c1", "d", 1, 2, "x")]), ("ok [c1]", [("c1", "d", 0, 2, "x")]), ("ok [c1]", [("c1", "d", 3, 2, "x")]), ("not found in provided docs", []), ("Not found in provided docs", [("c1", "d", 1, 2, "x")]), ("ok", []), ("ok", [("c1", "d", 1, 2, "x")]), ("ok [c2]", [("c1", "d", 1, 2, "x")])]
    got = evidence.check_answers(spark.createDataFrame(rows, f"answer string, citations {CITES}")).collect()
    assert [r["problem"] for r in got] == [None, "page_not_positive", "pages_reversed", None, "refusal_with_citations", "no_citations", "no_markers", "unknown_markers"]


CHUNKS = "chunk_id string, doc_id string, start_page int, end_page int, section_path string, text string"


def graph_rows(spark):
    return spark.createDataFrame([
        ("a", "D", 1, 1, "Contents", "Algorithm 9 Bar"), ("b", "D", 2, 3, "1 Terms", "ML-KEM | a scheme\nCiphertext | bytes"), ("c", "D", 4, 5, "2 Keys > Algorithm 3 ML-KEM.KeyGen", "Algorithm 3 ML-KEM.KeyGen\n1: a"),
        ("d", "D", 6, 6, "3 Shared secret", "Algorithm 3 mentioned\nhere"), ("e", "E", 1, 2, "1 Keys", "Algorithm 3 Other.Name shared secret\nthe end"), ("f", "E", 3, 3, None, "none"),
    ], CHUNKS)


def test_graph(spark):
    nodes, edges = graph.build(graph_rows(spark))
    ids = {r["node_id"]: r for r in nodes.collect()}
    assert len(ids) == nodes.count() and edges.count() == edges.select("edge_id").distinct().count()
    assert json.loads(ids["alg::D::3"]["properties"])["section_id"] == "section::D::2 Keys > Algorithm 3 ML-KEM.KeyGen" and "alg::D::9" not in ids
    assert ids["doc::D"]["end_page"] == 6 and ids["section::D::2 Keys"]["start_page"] == 4
    term = json.loads(ids["term::ml-kem"]["properties"])
    assert term["definition_strength"] == "heuristic_definition_section" and ids["term::ml-kem"]["display_name"] == "ML-KEM"
    kinds = {(r["type"], r["source_id"], r["target_id"]) for r in edges.collect()}
    assert ("CHILD_OF", "section::D::2 Keys > Algorithm 3 ML-KEM.KeyGen", "section::D::2 Keys") in kinds and ("DEFINED_IN", "term::ml-kem", "section::D::1 Terms") in kinds
    assert ("IN_DOCUMENT", "term::shared secret", "doc::E") in kinds
    again = graph.build(graph_rows(spark).repartition(5))
    assert {tuple(r) for r in again[0].collect()} == {tuple(r) for r in nodes.collect()}


def test_lookups(spark):
    nodes, edges = (x.cache() for x in graph.build(graph_rows(spark)))
    q = spark.createDataFrame([("1", "ml-kem"), ("2", "Shared  Secret"), ("3", "nothing")], "qid string, query string")
    got = {r["qid"]: r for r in graph.lookup_terms(q, nodes, edges).collect()}
    assert got["1"]["match_reason"] == "exact_normalized_term" and got["1"]["section_ids"][0] == "section::D::1 Terms" and set(got["2"]["doc_ids"]) == {"D", "E"} and "3" not in got
    q = spark.createDataFrame([("1", "steps of ML-KEM.KeyGen", []), ("2", "Algorithm 3", []), ("3", "Algorithm 3", ["E"]), ("4", "Algorithm 77", [])], "qid string, query string, doc_ids array<string>")
    got = {r["qid"]: r for r in graph.lookup_algorithms(q, nodes, edges).collect()}
    assert got["1"]["match_reason"] == "exact_algorithm_name" and got["1"]["doc_ids"] == ["D"] and got["2"]["ambiguous"] and got["3"]["doc_ids"] == ["E"] and "4" not in got
    n, e = graph.export_rows(nodes, edges)
    assert n.columns[0] == "node_id:ID" and e.columns[1:4] == [":START_ID", ":END_ID", ":TYPE"] and "REQUIRE n.node_id IS UNIQUE" in graph.load_script()[0]


@pytest.mark.parametrize("term, kind", [("ML-KEM.KeyGen", "identifier"), ("NTT", "acronym"), ("key generation", "operation"), ("ab", "symbol"), ("long concept", "concept")])
def test_term_types(spark, term, kind):
    assert spark.range(1).select(graph.term_type(F.lit(term)).alias("t")).head()["t"] == kind


GOLDQ = f"qid string, question string, answerable boolean, gold {evalkit.GOLD}"
RANKED = "qid string, rank int, chunk_id string, doc_id string, start_page int, end_page int"


def test_metrics(spark):
    q = spark.createDataFrame([("a", "x", True, [("d", 1, 2), ("e", 5, 5)]), ("b", "x", True, [("d", 1, 1)]), ("c", "x", False, [])], GOLDQ)
    r = spark.createDataFrame([("a", 1, "1", "z", 1, 1), ("a", 2, "2", "d", 2, 3), ("a", 3, "3", "d", 1, 1), ("b", 1, "1", "d", 9, 9)], RANKED)
    got = {(x["qid"], x["k"]): x for x in evalkit.metrics(r, q, [1, 3]).collect()}
    three = got[("a", 3)]
    assert (three["recall"], three["mrr"]) == (0.5, 0.5) and abs(three["ndcg"] - (1 / math.log2(3)) / (1 + 1 / math.log2(3))) < 1e-6
    assert got[("b", 3)]["recall"] == 0.0 and ("c", 1) not in got
    rates = {x["k"]: x for x in evalkit.hit_rates(r, q, [1, 3]).collect()}
    assert (rates[3]["strict"], rates[3]["doc"], rates[1]["doc"]) == (0.5, 1.0, 0.5)
    with pytest.raises(ValueError):
        evalkit.matches(F.struct(F.lit("d").alias("doc_id")), F.struct(F.lit("d").alias("doc_id")), "tolerant", -1)


def test_greedy_gains_against_a_loop(spark):
    import random

    rng = random.Random(4)
    rows, want = [], {}
    for i in range(40):
        gold = [("d", s, s + rng.randrange(4)) for s in (rng.randrange(10) for _ in range(rng.randrange(1, 4)))]
        found = [("d" if rng.random() < 0.8 else "e", s, s + rng.randrange(3)) for s in (rng.randrange(10) for _ in range(6))]
        used, g = set(), []
        for d, a, b in found:
            m = next((j for j, (e, x, y) in enumerate(gold) if j not in used and d == e and b >= x and y >= a), None)
            used |= {m} - {None}
            g.append(int(m is not None))
        rows.append((i, found, gold))
        want[i] = g
    span = evalkit.GOLD
    got = spark.createDataFrame(rows, f"i int, hits {span}, gold {span}").select("i", evalkit.gains(F.col("hits"), F.col("gold")).alias("g")).collect()
    assert {r["i"]: r["g"] for r in got} == want


@pytest.mark.parametrize("args, cause", [((False, False, None, None), "upstream_missing"), ((True, False, None, None), "outside_pool"), ((True, True, 3, 5), "retained_or_recovered"), ((True, True, 3, 12), "rerank_demotion"), ((True, True, 20, 10), "rerank_insufficient_promotion")])
def test_miss_causes(spark, args, cause):
    fused, pool, before, after = args
    col = lambda v: F.lit(v).cast("int")
    assert spark.range(1).select(evalkit.miss_cause(F.lit(fused), F.lit(pool), col(before), col(after), 8).alias("c")).head()["c"] == cause


def test_question_rules_and_coverage(spark):
    q = spark.createDataFrame([("a", "x", True, [("d", 1, 1)]), ("a", "", True, []), ("b", "x", None, [("", 1, 1)]), ("c", "x", False, [("d", 2, 1)]), ("", "x", False, [])], GOLDQ)
    got = {tuple(r) for r in evalkit.question_problems(q).collect()}
    assert got == {("a", "duplicate_qid"), ("a", "empty_question"), ("a", "answerable_without_gold"), ("b", "answerable_missing"), ("b", "bad_gold_span"), ("c", "bad_gold_span"), ("c", "unanswerable_with_gold"), ("", "empty_qid")}
    pages = spark.createDataFrame([("d", 1), ("d", 1), ("d", 4), ("e", 1)], "doc_id string, page_number int")
    want = {r["doc_id"]: r for r in evalkit.page_coverage(pages, spark.createDataFrame([("d", 3), ("e", 1), ("f", 2)], "doc_id string, n_pages int")).collect()}
    assert (want["d"]["missing"], want["d"]["duplicates"], want["d"]["out_of_range"], want["d"]["ok"]) == ([2, 3], [1], 1, False) and want["e"]["ok"] and want["f"]["missing"] == [1, 2]


def test_agent_assessment_and_refinement(spark):
    plans = planner.analyse(spark.createDataFrame([("1", "Explain Table 7"), ("2", "Compare ML-KEM and ML-DSA"), ("3", "anything")], "qid string, query string"))
    items = spark.createDataFrame([("1", "a", "d", 1, 1, "Table 7 says", 1.0), ("1", "b", "d", 1, 1, "x", 1.0), ("2", "a", "NIST.FIPS.203", 1, 1, "ML-KEM", 1.0), ("2", "b", "NIST.FIPS.203", 1, 1, "x", 1.0)], HIT)
    got = {r["qid"]: r for r in agent.assess(plans, items).collect()}
    assert got["1"]["sufficient"] and got["2"]["reasons"] == ["one_sided_comparison"] and got["2"]["missing_topics"] == ["ML-DSA"] and got["3"]["reasons"] == ["insufficient_hits"]
    state = plans.where("qid = '2'").withColumns({"stop_reason": F.lit("one_sided_comparison"), "missing_spans": planner.empty(), "missing_topics": F.array(F.lit("ML-DSA"))})
    assert agent.refine(state.withColumn("dense_query", F.lit("d"))).head()["dense_query"] == "d ML-DSA FIPS 204 ML-DSA"
    rounds = []

    def fetch(active):
        rounds.append(active.count())
        return active.select("qid", F.concat("qid", F.lit(str(len(rounds)))).alias("chunk_id"), F.lit("d").alias("doc_id"), F.lit(1).alias("start_page"), F.lit(1).alias("end_page"), F.lit("x").alias("text"), F.lit(1.0).alias("score"), F.lit(1).alias("rank"))

    state, found = agent.run(plans.where("qid = '3'"), fetch)
    row = state.head()
    assert (row["sufficient"], row["round"], row["stop_reason"], found.count()) == (True, 2, "sufficient_evidence", 2)
    done = agent.verify(state.withColumns({"draft": F.lit("ok [c1]"), "citations": F.array(F.lit("c1"))})).head()
    assert done["result"] == "ok" and done["final_answer"] == "ok [c1]"


def test_traces(spark):
    rows = [("r", 1, "step", "analyze", {}), ("r", 2, "analysis_applied", None, {"k": "1"}), ("r", 3, "step", "retrieve", {}), ("r", 4, "retrieval_round_started", "", {"round": "1"}), ("r", 5, "evidence_updated", None, {"total_hits": "4"}), ("r", 6, "evidence_updated", None, {"total_hits": "6"}), ("r", 7, "step", "retrieve", {})]
    events = spark.createDataFrame(rows, "run_id string, seq long, type string, node string, payload map<string,string>")
    assert [r["node"] for r in trace.carry_node(events).orderBy("seq").collect()] == ["analyze", "analyze", "retrieve", "retrieve", "retrieve", "retrieve", "retrieve"]
    assert [(r["node"], r["node_visit"], r["event_types"]) for r in trace.by_node(events).orderBy("visit").collect()][1:] == [("retrieve", 1, ["retrieval_round_started", "evidence_updated", "evidence_updated"]), ("retrieve", 2, [])]
    assert trace.by_round(events, {"total": ("evidence_updated", "total_hits")}).head()["total"] == "6"
    assert trace.latest(events, "evidence_updated").head()["payload"] == {"total_hits": "6"}


def test_files_manifest_streaming(spark, tmp_path):
    df = spark.createDataFrame([("b", 2), ("a", 1)], "k string, n int")
    files.write_jsonl(df, str(tmp_path / "j"), "k", files=1)
    assert [json.loads(r["value"]) for r in spark.read.text(str(tmp_path / "j")).collect()] == [{"k": "a", "n": 1}, {"k": "b", "n": 2}]
    assert files.read_jsonl(spark, str(tmp_path / "j"), "k string, n int").count() == 2
    (tmp_path / "bad.jsonl").write_text('{"a": 1}\n\nnope\n[1]\n')
    assert [(r["line"], r["value"]) for r in files.broken_lines(spark, str(tmp_path / "bad.jsonl")).orderBy("line").collect()] == [(3, "nope"), (4, "[1]")]
    (tmp_path / "x.pdf").write_bytes(b"one|two")
    parsed = files.parse_documents(spark, str(tmp_path), lambda p, b: [{"page_number": i, "text": t} for i, t in enumerate(b.decode().split("|"), 1)])
    assert [(r["doc_id"], r["page_number"], r["text"]) for r in parsed.orderBy("page_number").collect()] == [("x", 1, "one"), ("x", 2, "two")]
    with pytest.raises(FileNotFoundError):
        files.parse_documents(spark, str(tmp_path), None, "*.doc")
    conf = EngineConf()
    m = manifest.update(str(tmp_path / "m.json"), "embed", {"dim": 64, "model_name": "m"}, {"a": "h"}, conf)
    assert manifest.incompatibilities(m, dim=32) and not manifest.incompatibilities(m, dim=64, tokenizer="t") and not manifest.incompatibilities(None, dim=1)
    assert not manifest.drifted(m, conf) and manifest.drifted(m, EngineConf(top_k=9))
    folder = tmp_path / "in"
    folder.mkdir()
    page = "A page of prose that is long enough. " * 12
    (folder / "p.json").write_text(json.dumps({"doc_id": "d", "page_number": 1, "text": page}) + "\n")
    q = streaming.append_chunks(streaming.read_pages(spark, str(folder)), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1
    assert api.health(str(tmp_path))["status"] == "degraded"
