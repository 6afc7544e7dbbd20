"""Command line (K15): build, search, ask, agent, eval over a data directory of Parquet tables."""
from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from . import api
from .conf import EngineConf, parse_ks
from .operators import dense, evalkit, lexical, retrieve
from .plans import catalog


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="folioscope")
    p.add_argument("command", choices=["search", "ask", "agent", "eval", "query", "build", "serve"])
    p.add_argument("data", help="folder of the Parquet tables")
    p.add_argument("text", nargs="?", default="", help="the question, or the name of a catalogue query")
    p.add_argument("--k", type=int)
    p.add_argument("--ks", default="1,3,5,8")
    p.add_argument("--save-json")
    p.add_argument("--out", default="index", help="folder of build")
    p.add_argument("--port", type=int, default=8000)
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("folioscope").getOrCreate()
    conf = EngineConf.from_env().checked()
    if a.command == "query":
        catalog.queries()[a.text](spark, a.data).show(50, truncate=80)
        return 0
    store = catalog.chunk_store(spark, a.data)
    if a.command == "build":
        corpus = retrieve.corpus_of(store)
        store.write.mode("overwrite").parquet(f"{a.out}/chunk_store")
        lexical.write_index(corpus.index, a.out)
        dense.write_vectors(corpus.vectors, a.out, "hashed-64")
        return 0
    corpus = retrieve.corpus_of(store)
    if a.command == "serve":
        from wsgiref.simple_server import make_server

        from .http import application

        make_server("127.0.0.1", a.port, application(spark, corpus, conf, a.out)).serve_forever()
    if a.command == "search":
        out = api.search(spark, a.text, corpus, a.k, conf)
    elif a.command == "ask":
        out = api.ask(spark, a.text, corpus, k=a.k, conf=conf)
    elif a.command == "agent":
        out = api.ask_agent(api.one(spark, a.text, a.k), corpus, conf).head().asDict(recursive=True)
    else:
        questions = catalog.questions(spark, a.data)
        hits = catalog.fused(spark, a.data)
        out = {"metrics": [r.asDict() for r in evalkit.mean_metrics(evalkit.metrics(hits, questions, parse_ks(a.ks))).orderBy("k").collect()]}
    text = json.dumps(out, indent=2, ensure_ascii=False, default=str)
    print(text)
    if a.save_json:
        with open(a.save_json, "w", encoding="utf-8") as f:
            f.write(text)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
