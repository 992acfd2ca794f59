"""Commands over a store: index, search, report, test, roots."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from paperloom.engine import Engine
from paperloom.sources import readers as rd


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="paperloom", description=__doc__)
    p.add_argument("--store", required=True, help="folder of the tables and the index")
    sub = p.add_subparsers(dest="command", required=True)
    one = sub.add_parser("index", help="read folders")
    one.add_argument("folders", nargs="+")
    one.add_argument("--limit", type=int)
    one.add_argument("--confirm-missing", action="store_true")
    one = sub.add_parser("search", help="find pages")
    one.add_argument("words", nargs="+")
    one.add_argument("--limit", type=int, default=10)
    one.add_argument("--synonyms")
    one = sub.add_parser("report", help="states and problems")
    one.add_argument("--csv")
    one = sub.add_parser("test", help="evaluate a list of questions")
    one.add_argument("questions")
    one.add_argument("--k", type=int, default=5, choices=range(1, 51), metavar="1..50")
    one.add_argument("--json")
    one = sub.add_parser("roots", help="folders of the collection")
    one.add_argument("--remove")
    return p


def run(spark: SparkSession, args: argparse.Namespace) -> None:
    engine = Engine(spark, args.store)
    if args.command == "index":
        print(engine.ingest(args.folders, args.confirm_missing, args.limit))
        engine.index()
    elif args.command == "search":
        synonyms = rd.read_synonyms(spark, args.synonyms) if args.synonyms else None
        for r in engine.search([(1, " ".join(args.words))], args.limit, synonyms).orderBy("rank").collect():
            print(f"{r['rank']:3d}  {r.score:.4f}  {r.root}/{r.relpath}, page {r.page_no}" + (f" (+{r.copies - 1})" if r.copies > 1 else "") + f"\n     {r.snippet}")
    elif args.command == "report":
        tables = engine.report()
        for name in ("status", "duplicates", "parts"):
            tables[name].show(100, False)
        tables["problems"].orderBy("priority", "relpath").show(25, False)
        if args.csv:
            print(rd.write_problems(tables["problems"], args.csv), "problems written")
    elif args.command == "test":
        metrics, rows = engine.evaluate(rd.read_questions(spark, args.questions), args.k)
        metrics.show(1, False)
        if args.json:
            rd.write_evaluation(metrics, rows, args.json)
    else:
        if args.remove:
            engine.remove_root(args.remove)
        engine.roots().orderBy("root_id").show(1000, False)


def main() -> None:
    run(SparkSession.builder.getOrCreate(), parser().parse_args())


if __name__ == "__main__":
    main()
