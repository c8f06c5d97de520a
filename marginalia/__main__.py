"""Command line: ``python -m marginalia ingest|ask|inspect|serve``.

A parser of documents is named as ``package.module:function`` (bytes to the texts of pages).
"""

from __future__ import annotations

import argparse
import importlib
import sys

from pyspark.sql import functions as F

from marginalia import answering, plugins
from marginalia.operators import quality
from marginalia.server import serve
from marginalia.service import KnowledgeService
from marginalia.session import local_session
from marginalia.sources.store import ReferenceStore, VectorStore


def _service(args: argparse.Namespace) -> KnowledgeService:
    extract = None
    if args.parser:
        module, name = args.parser.split(":")
        extract = getattr(importlib.import_module(module), name)
    spark = local_session("*", "marginalia", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    store = VectorStore(spark, f"{args.home}/index", plugins.HashedWords().dimension)
    return KnowledgeService(spark, f"{args.home}/files", store, extract, references=ReferenceStore(spark, f"{args.home}/references"))


def _ask(s: KnowledgeService, question: str) -> None:
    points = s.store.scan(vectors=True)
    if points is None:
        print("No relevant context found.")
        return
    q = s.spark.createDataFrame([(0, question)], "query_id bigint, text string")
    done = answering.answer(q, points.withColumn("doc", F.xxhash64("point_id")), s.references.all())
    row = done.answers.first()
    print(row.rendered if row and row.rendered else "No usable evidence found." if row is None else "The model gave no answer.")
    for r in done.bibliography.orderBy("pos").collect():
        print(f"[{r.source}, ref {r.number}] {r.content}")
    for r in done.results.orderBy("rank").collect():
        print(f"{r['rank']}. {r.source}, page {r.page} | vector {r.vector_score} | rerank {r.rerank_score}")


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="marginalia")
    p.add_argument("--home", default="data", help="folder of the index, the references and the files")
    p.add_argument("--parser", help="package.module:function from a document's bytes to the texts of its pages")
    sub = p.add_subparsers(dest="what", required=True)
    one = sub.add_parser("ingest", help="index documents, store workbooks")
    one.add_argument("paths", nargs="+")
    one.add_argument("--pipeline", help=", ".join(plugins.names()))
    one = sub.add_parser("ask", help="answer one question, or those of the standard input, one a line")
    one.add_argument("question", nargs="?")
    sub.add_parser("inspect", help="numbers on the indexed chunks")
    sub.add_parser("serve", help="the six tools over standard input and output")
    args = p.parse_args(argv)
    s = _service(args)
    if args.what == "ingest":
        done = s.ingest_documents(args.paths, args.pipeline)
        for r in done["results"]:
            print(" | ".join(f"{k}: {v}" for k, v in r.items()))
        return 1 if any(r["status"] == "error" for r in done["results"]) else 0
    if args.what == "ask":
        for line in [args.question] if args.question else sys.stdin:
            if line.strip().lower() in ("exit", "quit"):
                break
            if line.strip():
                _ask(s, line.strip())
    elif args.what == "inspect":
        points = s.store.scan()
        for k, v in (quality.token_distribution(points).first().asDict() if points is not None else {}).items():
            print(f"{k}: {v}")
    else:
        serve(s, sys.stdin, sys.stdout)
    return 0


if __name__ == "__main__":
    sys.exit(main())
