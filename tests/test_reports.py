import json


from folioscope.operators import evalkit, evidence, reports

GOLDQ = f"qid string, question string, answerable boolean, gold {evalkit.GOLD}"
RANKED = "qid string, rank int, chunk_id string, doc_id string, start_page int, end_page int, text string"


def test_evaluation_run(spark, tmp_path):
    q = spark.createDataFrame([("a", "x", True, [("d", 1, 2)]), ("b", "y", True, [("d", 7, 7)]), ("c", "z", False, [])], GOLDQ)
    r = spark.createDataFrame([("a", 1, "1", "d", 2, 3, "Algorithm 3"), ("b", 1, "1", "d", 9, 9, "x")], RANKED)
    out = reports.evaluate(r, r, q, [1, 8], str(tmp_path), "my set.jsonl")
    assert out["primary_k"] == 8 and out["metrics"][0]["recall"] == 0.5 and {c["cause"]: c["n"] for c in out["miss_causes"]} == {"retained_or_recovered": 1, "upstream_missing": 1}
    md = next(tmp_path.glob("my-set_*_summary.md")).read_text()
    assert "| 1 | 2 | 0.5000 |" in md and json.loads(next(tmp_path.glob("*.json")).read_text())["run_id"] == out["run_id"]
    assert spark.read.text(str(next(tmp_path.glob("*_per_question")))).count() == 2
    delta = reports.spec_delta(r.where("qid = 'b'"), r, doc_id="d").orderBy("qid").collect()
    assert [(d["qid"], d["delta"]) for d in delta] == [("a", 1), ("b", 0)]
    cites = "array<struct<key:string,doc_id:string,start_page:int,end_page:int,chunk_id:string>>"
    good = spark.createDataFrame([("a", "ok [c1]", [("c1", "d", 1, 1, "x")]), ("b", evidence.REFUSAL, []), ("c", evidence.REFUSAL, [])], f"qid string, answer string, citations {cites}")
    table = {x["config"]: x for x in reports.compare({"one": lambda _: (r, good), "two": lambda _: (r.limit(0), good)}, q).collect()}
    assert table["one"]["recall"] == 0.5 and table["two"]["recall"] == 0.0 and table["one"]["citation_compliance"] == 0.5
    assert evalkit.best_config(reports.compare({"two": lambda _: (r.limit(0), good), "one": lambda _: (r, good)}, q)).head()["config"] == "one"


def test_sanity_and_traces(spark):
    plan = "qid string, doc_ids array<string>, required_anchors array<string>"
    row = reports.definition_sanity(spark.createDataFrame([("1", [], [])], plan), spark.createDataFrame([("1", ["D"], ["LWE"])], plan), spark.createDataFrame([("1", ["D"], "lwe")], "qid string, expected_doc_ids array<string>, expected_anchor string")).head()
    assert tuple(row)[1:] == (False, True, False, True, True)
    state = spark.createDataFrame([("q", 5, "general", "s", "d", 1, 2, 1, True, "sufficient_evidence", "")], "qid string, steps int, mode_hint string, sparse_query string, dense_query string, round int, hits long, tool_calls int, sufficient boolean, stop_reason string, strategy string")
    events = reports.trace_events(state).orderBy("seq").collect()
    assert [e["type"] for e in events][:2] == ["step", "analysis_applied"] and events[3]["payload"]["total_hits"] == "2"
    pages = spark.createDataFrame([("d", "ab"), ("d", None)], "doc_id string, text string")
    assert tuple(reports.page_totals(pages).head()) == ("d", 2, 2, 1)
    assert reports.markdown_table([{"a": 1.0, "b": None}], ["a", "b"]).endswith("| 1.0000 | - |")
