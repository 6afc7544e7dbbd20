"""Queries over rows that plain ASCII and SQL leave out, against brute force on small tables."""
import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from folioscope.functions import text as T
from folioscope.plans import catalog

TEXTS = [
    "Maßnahmen für 12 ÜBERSICHT\u00a0\nplain  3 line\tend\n\u2003Été 2024 — fin\u2003", "plain 7 line end\nΟΔΟΣ ٣ x\n", "  ¿Qué?  Sí.\u00a0Señor ANSI\u2013NIST ÄNSI CO² A_B KDF ",
    "naïve " * 30 + "Ende.", "", " \n ", None,
]
DIGEST = lambda t: hashlib.md5(t.encode()).hexdigest()


@pytest.fixture(scope="module")
def data(tmp_path_factory):
    d = tmp_path_factory.mktemp("whole")
    n = range(len(TEXTS))
    write = lambda name, **columns: pq.write_table(pa.table(columns), d / f"{name}.parquet")
    write("documents", doc_id=pa.array(n, pa.int64()), text=TEXTS)
    write("chunk_hits", chunk_id=[f"c{i}" for i in n], doc_id=["d"] * len(n), start_page=pa.array(n, pa.int32()), end_page=pa.array(n, pa.int32()), text=TEXTS)
    write("structured_blocks", block_id=pa.array(n, pa.int64()), doc_id=["d"] * len(n), page_number=pa.array(n, pa.int32()), section_path=["1 Größe", None, " ", "2 A > 2.1 É", "3", "3", "3"], text=TEXTS)
    return str(d)


def rows(spark, name, data):
    return Counter(tuple(r) for r in catalog.queries()[name](spark, data).collect())


def test_lines_previews_and_embedding_texts_of_all_rows(spark, data):
    canon = lambda x: re.sub(r"[ \t]+", " ", re.sub(r"\d+", "", x.lower())).strip()
    lines = Counter(canon(x) for t in TEXTS if t is not None for x in t.split("\n"))
    assert rows(spark, "canon_lines_whole", data) == Counter(lines.items())
    flat = [(f"c{i}", t.strip().replace("\n", " ")) for i, t in enumerate(TEXTS) if t is not None]
    assert rows(spark, "previews_whole", data) == Counter((c, t[:80] + "..." if len(t) > 80 else t) for c, t in flat)
    paths = ["1 Größe", "", "", "2 A > 2.1 É", "3", "3", "3"]
    texts = [(t or "").strip() for t in TEXTS]
    assert rows(spark, "embedding_texts_whole", data) == Counter((str(i), DIGEST(f"d > {p}\n\n{t}" if t and p else t)) for i, (p, t) in enumerate(zip(paths, texts)))


def test_windows_and_counts_of_texts_as_stored(spark, data):
    texts = [t or "" for t in TEXTS]
    assert rows(spark, "acronym_counts_whole", data) == Counter(Counter(a for t in texts for a in re.findall(r"\b[A-Z]{2,8}\b", t)).items())
    assert rows(spark, "approx_token_counts_whole", data) == Counter((i, max(1, len(t.split()))) for i, t in enumerate(texts))
    assert rows(spark, "sentence_counts_whole", data) == Counter((i, sum(1 for x in re.split(r"(?<=[.?!])\s+", t.strip()) if x.strip())) for i, t in enumerate(texts))
    assert rows(spark, "token_windows_whole", data) == Counter((i, 0, DIGEST(" ".join(t.split()))) for i, t in enumerate(texts) if t.split())
    assert rows(spark, "char_windows_whole", data) == Counter((i, 0, len(t.strip()), DIGEST(t.strip())) for i, t in enumerate(texts) if t.strip())


def test_answers_of_all_rows(spark, tmp_path):
    cite = pa.list_(pa.struct([("key", pa.string()), ("doc_id", pa.string()), ("start_page", pa.int32()), ("end_page", pa.int32()), ("chunk_id", pa.string())]))
    c1 = [{"key": "c1", "doc_id": "d", "start_page": 1, "end_page": 1, "chunk_id": "x"}]
    answers = ["Größe ist 3 [c1].\u2003Ja [c1].", None, "Known [c1].", "É. Oui [c1].", "not found in provided docs", "x [c1]"]
    pq.write_table(pa.table({"pair_id": pa.array(range(6), pa.int64()), "answer": answers, "citations": pa.array([c1, c1, None, c1, [], c1], cite), "answerable": [True, True, True, False, None, None]}), tmp_path / "answers.parquet")
    assert rows(spark, "enforced_answers_whole", str(tmp_path)) == Counter([(0, False, 1), (1, True, 0), (2, True, 0), (3, True, 0), (4, True, 0), (5, False, 1)])
    assert rows(spark, "answer_metrics_whole", str(tmp_path)) == Counter([
        (0, False, 1, True, 1.0, 1.0), (1, False, 1, True, None, 1.0), (2, False, 0, False, 1.0, 1.0), (3, False, 1, True, 0.5, 0.0), (4, True, 0, True, None, None), (5, False, 1, True, 1.0, None),
    ])


# ---- identifiers whose separators are spaced out ------------------------------------------------------------

SPACED = ["ML - KEM . KeyGen makes keys", "the KC _ Step label of keys", "ML-KEM.KeyGen again", "plain words only", "MAC\\_Data - x"]
ASKED = ["What is ML - KEM . KeyGen?", "KC_Step label"]


@pytest.fixture(scope="module")
def spaced(tmp_path_factory):
    d = tmp_path_factory.mktemp("spaced")
    write = lambda name, **columns: pq.write_table(pa.table(columns), d / f"{name}.parquet")
    qids, n, k = ["q100", "q200"], len(SPACED), range(2 * len(SPACED))
    gold = pa.array([[{"doc_id": "d", "start_page": 0, "end_page": 0}], []], pa.list_(pa.struct([("doc_id", pa.string()), ("start_page", pa.int32()), ("end_page", pa.int32())])))
    write("questions", qid=qids, question=ASKED, answerable=[True, False], category=["x", "x"], gold=gold)
    write("chunk_hits", hit_id=pa.array(k, pa.int64()), qid=[qids[i // n] for i in k], ranking_id=pa.array([0] * len(k), pa.int32()), rank=pa.array([n - i % n for i in k], pa.int32()), score=[0.5] * len(k),
          chunk_id=[f"c{i % n}" for i in k], doc_id=["d"] * len(k), start_page=pa.array([i % n for i in k], pa.int32()), end_page=pa.array([i % n for i in k], pa.int32()), text=[SPACED[i % n] for i in k])
    return str(d)


def words(text):
    out = []
    for w in re.findall(T.WORD, T.join_identifiers(text).lower()):
        out += [w, *re.split("[-._]", w)] if re.search("[-._]", w) else [w]
    return out


def bm25(query, text):
    docs = [words(x) for x in SPACED]
    avg, tf, dl = sum(map(len, docs)) / len(docs), Counter(words(text)), len(words(text))
    df = {t: sum(t in x for x in docs) for t in tf}
    return sum(math.log(1 + (len(docs) - df[t] + 0.5) / (df[t] + 0.5)) * tf[t] * 2.5 / (tf[t] + 1.5 * (0.25 + 0.75 * dl / avg)) * n for t, n in Counter(words(query)).items() if tf[t])


def test_lexical_queries_join_identifiers(spark, spaced):
    run = lambda name: catalog.queries()[name](spark, spaced).collect()
    docs = [words(x) for x in SPACED]
    df = Counter(t for x in docs for t in set(x))
    assert {"ml-kem.keygen", "kc_step", "mac_data-x"} <= set(df) and df["ml-kem.keygen"] == 2
    got = {r["term"]: (r["df"], r["idf"]) for r in run("index_terms_whole")}
    assert got == {t: (n, pytest.approx(math.log(1 + (len(docs) - n + 0.5) / (n + 0.5)), abs=1e-8)) for t, n in df.items()}
    assert [tuple(r) for r in run("index_corpus_whole")] == [(len(docs), pytest.approx(sum(map(len, docs)) / len(docs)))]
    want = {(q, f"c{i}"): bm25(a, t) for q, a in zip(("q100", "q200"), ASKED) for i, t in enumerate(SPACED)}
    assert {(r["qid"], r["chunk_id"]): r["score"] for r in run("bm25_topk_whole")} == {k: pytest.approx(v, abs=2e-6) for k, v in want.items() if v}
    assert {(r["qid"], r["chunk_id"]): r["score"] for r in run("bm25_score_texts_whole")} == {k: pytest.approx(v, abs=2e-6) for k, v in want.items()}


def test_reranking_searches_and_assessment_join_identifiers(spark, spaced):
    run = lambda name: catalog.queries()[name](spark, spaced).collect()
    # plain tokens tell neither spelling of ML-KEM.KeyGen from the other's parts; joined, both chunks hold it and come first
    first = {r["chunk_id"] for r in run("rerank_hits_whole") if r["qid"] == "q100" and r["promoted"]}
    assert {"c0", "c2"} <= first
    assert [tuple(r) for r in run("miss_causes_whole")] == [("retained_or_recovered", 1)]
    corpus = catalog.corpus(spark, spaced)
    assert corpus.normalize and {r["term"] for r in corpus.index.terms.collect()} == {t for x in SPACED for t in words(x)}
    for name in ("hybrid_topk", "base_topk", "planned_topk"):
        assert {"c0", "c2"} == {r["chunk_id"] for r in run(name) if r["qid"] == "q100" and r["rank"] <= 2}, name
    assert {r["qid"]: r["round"] for r in run("agent_answers")}.keys() == {"q100", "q200"}
    reasons = {r["qid"]: r["reasons"] for r in run("evidence_assessment")}
    assert "missing_protected_span" not in reasons["q100"] and "missing_protected_span" not in reasons["q200"]


def test_hashes_of_tables_that_grow(spark, spaced, tmp_path):
    order = [3, 0, 9, 1, 8, 2, 7, 4, 6, 5]
    for d, less in ((tmp_path / "same", 0), (tmp_path / "other", 1)):
        d.mkdir()
        hits = pq.read_table(f"{spaced}/chunk_hits.parquet").take(order[less:])
        pq.write_table(hits, d / "chunk_hits.parquet")
    for d in (spaced, tmp_path / "same", tmp_path / "other"):
        pq.write_table(pa.table({"x": [1, 2]}), f"{d}/sources.parquet")
        pq.write_table(pa.table({"x": TEXTS}), f"{d}/documents.parquet")
    first, same, other = ({r["name"]: (r["n"], r["digest"]) for r in catalog.queries()["table_hashes"](spark, str(d)).collect()} for d in (spaced, tmp_path / "same", tmp_path / "other"))
    postings = sum(len(set(words(x))) for x in SPACED)
    assert {k: n for k, (n, _) in first.items()} == {"sources": 2, "documents": len(TEXTS), "chunk_hits": 10, "chunk_store": 5, "postings": postings}
    assert same == first and other["chunk_hits"] != first["chunk_hits"] and other["documents"] == first["documents"]
