"""Command line: ``python -m pagewright.cli build|search|benchmark|upgrade|serve|load ...``"""

from __future__ import annotations

import argparse
import json
import time

from pyspark.sql import SparkSession

from pagewright import __version__
from pagewright.plans import index as ix
from pagewright.plans.reports import benchmark, load_test
from pagewright.plans.search import MODES, search
from pagewright.plans.service import create_server
from pagewright.sources.corpus import read_corpus, read_queries


def _count(text: str) -> int:
    """A positive number."""
    n = int(text)
    if n < 1:
        raise argparse.ArgumentTypeError("must be positive")
    return n


def _counts(text: str) -> list[int]:
    return [_count(x) for x in text.split(",")]


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="pagewright")
    p.add_argument("--version", action="version", version=__version__)
    sub = p.add_subparsers(dest="command", required=True)
    b = sub.add_parser("build", help="index a folder or ZIP archive of JSON records")
    b.add_argument("corpus")
    b.add_argument("output")
    b.add_argument("--overwrite", action="store_true", help="replace an index that is there")
    s = sub.add_parser("search", help="answer a query, or prompt until a blank line")
    s.add_argument("index")
    s.add_argument("--query")
    m = sub.add_parser("benchmark", help="time the queries of a file")
    m.add_argument("index")
    m.add_argument("queries")
    m.add_argument("--runs", type=_count, default=5)
    for q in (s, m):
        q.add_argument("--limit", type=int, default=5)
        q.add_argument("--mode", choices=MODES, default="auto")
    u = sub.add_parser("upgrade", help="bring a version 1 index up to date in place")
    u.add_argument("index")
    v = sub.add_parser("serve", help="HTTP service")
    v.add_argument("index")
    v.add_argument("--host", default="127.0.0.1")
    v.add_argument("--port", type=int, default=8000)
    v.add_argument("--workers", type=_count, default=8, help="searches that run at a time")
    v.add_argument("--verbose", action="store_true", help="log every request")
    t = sub.add_parser("load", help="load test of a running service")
    t.add_argument("url")
    t.add_argument("queries")
    t.add_argument("--concurrency", type=_counts, default=[1, 2, 4, 8, 16], help="numbers of clients, with commas between")
    t.add_argument("--requests", type=_count, default=100)
    for r in (m, t):
        r.add_argument("--output", help="file for the report")
    return p


def result_lines(rows: list, ms: float) -> list[str]:
    """What a search prints."""
    lines = [f"{r['rank']:>2}. {r['score']:9.4f}  [{r['matched_terms']}/{r['query_terms']}]  {r['url']}" for r in rows]
    return [*(lines or ["No matching documents."]), f"{ms:.2f} ms"]


def _print_search(spark: SparkSession, index: ix.Index, query: str, limit: int, mode: str) -> None:
    began = time.perf_counter()
    rows = search(spark, index, query, limit, mode).collect()
    print("\n".join(result_lines(rows, (time.perf_counter() - began) * 1000)))


def _prompt(spark: SparkSession, index: ix.Index, limit: int, mode: str) -> None:
    """Queries from the keyboard until a blank line, the end of the input or an interrupt."""
    while True:
        try:
            query = input("search> ").strip()
        except (EOFError, KeyboardInterrupt):
            print()
            return
        if not query:
            return
        _print_search(spark, index, query, limit, mode)


def _report(report: dict, output: str | None) -> None:
    text = json.dumps(report, indent=2)
    print(text)
    if output:
        with open(output, "w", encoding="utf-8") as f:
            f.write(text + "\n")


def main(argv: list[str] | None = None) -> None:
    p = parser()
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("pagewright").getOrCreate()

    def queries() -> list[str]:
        found = [r["query"] for r in read_queries(spark, a.queries).orderBy("query_id").collect()]
        if not found:
            p.error("no queries in the file")
        return found

    if a.command == "build":
        records = read_corpus(spark, a.corpus)
        print(json.dumps(ix.build(spark, records, a.output, a.overwrite, order="position").__dict__, indent=2))
    elif a.command == "search":
        with ix.open_index(spark, a.index) as index:
            if a.query is not None:
                _print_search(spark, index, a.query, a.limit, a.mode)
            else:
                _prompt(spark, index, a.limit, a.mode)
    elif a.command == "benchmark":
        with ix.open_index(spark, a.index) as index:
            _report(benchmark(spark, index, queries(), a.runs, a.limit, a.mode), a.output)
    elif a.command == "upgrade":
        print(json.dumps(ix.upgrade(spark, a.index), indent=2))
    elif a.command == "serve":
        with ix.open_index(spark, a.index) as index:
            server = create_server(spark, index, a.host, a.port, a.workers, a.verbose)
            print(f"http://{a.host}:{server.server_port}")
            try:
                server.serve_forever()
            except KeyboardInterrupt:
                print()
            finally:
                server.server_close()
    else:
        _report(load_test(spark, a.url, queries(), a.concurrency, a.requests), a.output)


if __name__ == "__main__":
    main()
