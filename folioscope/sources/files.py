"""File sources and sinks: JSON lines, text, binary files, CSV, and the registries of parsers and retrievers."""
from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text as T
from ..session import ship

PAGES = "doc_id string, source_path string, page_number int, text string, markdown string, parser_backend string"
CHUNKS = "chunk_id string, doc_id string, page_number int, start_page int, end_page int, text string, char_len int, approx_tokens int, block_type string, section_path string, chunker_version string"
QUESTIONS = "qid string, question string, answerable boolean, gold array<struct<doc_id:string,start_page:int,end_page:int>>"
NODES = "node_id string, label string, doc_id string, start_page int, end_page int, display_name string, properties string"
EDGES = "edge_id string, type string, source_id string, target_id string, doc_id string, start_page int, end_page int, properties string"
SCHEMAS = {"pages": PAGES, "chunks": CHUNKS, "questions": QUESTIONS, "nodes": NODES, "edges": EDGES}

#: Parsers by name; one maps (path, bytes) to pages.  See ``markdown_pages`` for one, ``operators.retrieve.retriever`` for searches.
PARSERS: dict[str, Callable[[str, bytes], list[dict]]] = {}


def read_jsonl(spark: SparkSession, path: str, schema: str, *, strict: bool = True) -> DataFrame:
    """JSON lines with a given schema; blank lines are skipped, broken ones are an error (or null rows)."""
    ship(spark)
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "PERMISSIVE").json(path)


def broken_lines(spark: SparkSession, path: str) -> DataFrame:
    """``file, line, value`` of the lines that are no JSON objects, numbered within their file."""
    ship(spark)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import json

        for pdf in batches:
            out = []
            for name, content in zip(pdf["path"], pdf["content"]):
                for n, line in enumerate(content.decode("utf-8", "replace").splitlines(), 1):
                    if line.strip():
                        try:
                            ok = isinstance(json.loads(line), dict)
                        except ValueError:
                            ok = False
                        if not ok:
                            out.append((name, n, line))
            yield pd.DataFrame(out, columns=["file", "line", "value"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(scan, "file string, line int, value string")


def pages_from_records(rows: DataFrame) -> DataFrame:
    """Page records under all their key aliases as the page schema; empty optional fields become null."""
    have = set(rows.columns)
    pick = lambda *names: T.first_filled(*[F.col(n) for n in names if n in have], F.lit(None).cast("string"))
    return rows.select(
        F.coalesce(pick("doc_id", "source_path", "source"), F.lit("unknown_doc")).alias("doc_id"), pick("source_path").alias("source_path"),
        pick("page_number", "page").try_cast("int").alias("page_number"), F.coalesce(pick("text"), F.lit("")).alias("text"), pick("markdown").alias("markdown"), pick("parser_backend").alias("parser_backend"),
    )


def write_jsonl(df: DataFrame, path: str, *order: str, files: int | None = None) -> None:
    """JSON lines with sorted keys; sorted by ``order`` (range-partitioned, so in any number of files) where given."""
    cols = sorted(df.columns)
    if order:
        df = (df.repartitionByRange(files, *order) if files else df.repartitionByRange(*order)).sortWithinPartitions(*order)
    df.select(F.to_json(F.struct(*cols)).alias("value")).write.mode("overwrite").text(path)


def write_per_document(df: DataFrame, path: str) -> None:
    """JSON files in a folder per document."""
    df.repartition("doc_id").write.mode("overwrite").partitionBy("doc_id").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header."""
    df.write.mode("overwrite").option("header", True).csv(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """The non-blank lines of text files."""
    return spark.read.text(path).where(T.strip(F.col("value")) != "").select(T.strip(F.col("value")).alias("question"))


def markdown_pages(path: str, content: bytes) -> list[dict]:
    """A parser of Markdown or text files: a form feed or a line of five dashes or more ends a page."""
    pages = re.split(r"\f|^-{5,}[ \t]*$", content.decode("utf-8", "replace"), flags=re.M)
    return [{"page_number": n, "text": p.strip("\n"), "markdown": p.strip("\n"), "parser_backend": "markdown"} for n, p in enumerate(pages, 1)]


PARSERS["markdown"] = markdown_pages


def in_batches(render: Callable[[list[int]], list[dict]], numbers: list[int], size: int = 16) -> list[dict]:
    """Pages of a back end that reads several at once: a batch that fails is halved, down to single pages; a page that fails alone holds its error."""
    out, todo = [], [numbers[i : i + size] for i in range(0, len(numbers), size)]
    while todo:
        batch = todo.pop(0)
        try:
            out += render(batch)
        except Exception as e:  # noqa: BLE001 - a back end may raise anything
            if len(batch) > 1:
                todo = [batch[: len(batch) // 2], batch[len(batch) // 2 :], *todo]
            else:
                out.append({"page_number": batch[0], "text": f"{type(e).__name__}: {e}"})
    return sorted(out, key=lambda r: r["page_number"])


def parser(name: str) -> Callable[[str, bytes], list[dict]]:
    """S21."""
    if name not in PARSERS:
        raise ValueError(f"no parser {name!r}; registered: {sorted(PARSERS)}")
    return PARSERS[name]


def parse_documents(spark: SparkSession, folder: str, parse: Callable[[str, bytes], list[dict]], pattern: str = "*.pdf") -> DataFrame:
    """Pages of all files of a folder by a parser plug-in, run next to the files; an empty folder is an error.

    A parser's failure is the page 0 with the error as its text, so one broken
    file does not end the job.
    """
    ship(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    if files.isEmpty():
        raise FileNotFoundError(f"no {pattern} in {folder}")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for path, content in zip(pdf["path"], pdf["content"]):
                doc = Path(path).stem
                try:
                    rows = parse(path, bytes(content))
                except Exception as e:  # noqa: BLE001 - a parser may raise anything
                    rows = [{"page_number": 0, "text": f"{type(e).__name__}: {e}"}]
                out += [(doc, path, int(r["page_number"]), r.get("text") or "", r.get("markdown") or None, r.get("parser_backend")) for r in rows]
            yield pd.DataFrame(out, columns=[c.split()[0] for c in PAGES.split(", ")])

    return files.select("path", "content").mapInPandas(run, PAGES)
