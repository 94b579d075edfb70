"""python -m buildloom.cli FILE [--query NAME] [--report [OUT.md]] [--sparql TEXT] [--whole] [--quiet]: reports over a provenance file."""

from __future__ import annotations

import argparse
import sys
import time
from pathlib import Path

from pyspark.sql import SparkSession

from .plans import model, render
from .plans.sparql import SparqlError, compile_query
from .sources import turtle


# What the command line says.
NOT_FOUND = "ERROR: файл не найден: {}"
LOADED = "Загрузка {} ... {} троек за {:.1f}с"
SAVED = "\n✓ Отчёт сохранён: {}"

#: What is returned when the file holds statements that aren't understood, and how many of these are shown.
UNREAD = 3
SHOWN = 10


def session() -> SparkSession:
    return SparkSession.builder.appName("buildloom").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("file", help="a Turtle file")
    p.add_argument("--query", "-q", default="all", choices=["all", *render.AVAILABLE, "report"])
    p.add_argument("--report", "-r", nargs="?", const=True, metavar="OUTPUT.md", help="write the Markdown report, beside the file unless a path is given")
    p.add_argument("--sparql", help="run a query text and print its rows, tab-separated")
    p.add_argument("--whole", action="store_true", help="read the file as one text; without it, files that aren't a statement on each line are found")
    p.add_argument("--quiet", action="store_true", help="with --report: don't print it as well")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """--report goes before --query; --query report writes the report and always prints it."""
    args = parser().parse_args(argv)
    path = Path(args.file)
    if not path.exists():
        print(NOT_FOUND.format(path), file=sys.stderr)
        return 1
    spark = spark or session()
    began = time.time()
    loaded = turtle.load(spark, str(path), whole=args.whole)
    triples = loaded.triples.cache()
    graph = model.from_triples(triples)
    missed = loaded.unread.orderBy("build_id", "line").limit(SHOWN + 1).collect()
    for r in missed[:SHOWN]:
        print(f"ERROR: line {r['line']} isn't read: {r['unread'][:200]}", file=sys.stderr)
    if missed:
        print(f"ERROR: statements that aren't read: {loaded.unread.count()}", file=sys.stderr)
    done = UNREAD if missed else 0
    if args.sparql:
        try:
            rows = compile_query(graph, args.sparql)
        except SparqlError as e:
            print(f"ERROR: {e}", file=sys.stderr)
            return 1
        print("\t".join(rows.columns))
        for r in rows.toLocalIterator():
            print("\t".join("" if v is None else str(v) for v in r))
        return done
    print(LOADED.format(path.name, triples.count() + len(turtle.schema_triples()), time.time() - began))
    if args.report is not None or args.query == "report":
        text = render.markdown(graph, str(path))
        out = Path(args.report) if isinstance(args.report, str) else path.with_suffix(".md")
        out.write_text(text, encoding="utf-8")
        if not (args.quiet and args.report is not None):
            print(text)
        print(SAVED.format(out), file=sys.stderr)
        return done
    for name in render.AVAILABLE if args.query == "all" else [args.query]:
        print("\n".join(render.AVAILABLE[name](graph)))
    print()
    return done


if __name__ == "__main__":
    sys.exit(main())
