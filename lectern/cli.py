"""Command line: ``python -m lectern.cli <command> --store PATH ...``."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import functions as F

from lectern import fixed_values as V
from lectern.operators import catalog
from lectern.plans import indexing
from lectern.plans.engine import Engine
from lectern.session import build_session
from lectern.sources import corpus
from lectern.sources.store import Store


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="lectern")
    top.add_argument("--store", required=True, help="base path of the engine's tables")
    commands = top.add_subparsers(dest="command", required=True)
    for name in ("extract", "index", "knowledge"):
        p = commands.add_parser(name)
        p.add_argument("--root", required=True)
        p.add_argument("--country", default=V.DEFAULT_COUNTRY)
        p.add_argument("--gi", default=None)
        for flag in ("--force", "--fast", "--dry-run"):
            p.add_argument(flag, action="store_true")
    commands.add_parser("tables")
    p = commands.add_parser("graph")
    p.add_argument("--force", action="store_true")
    p.add_argument("--no-llm", action="store_true")
    p.add_argument("--gi", default=None)
    for name in ("ask", "sql", "explore"):
        commands.add_parser(name).add_argument("text")
    p = commands.add_parser("evaluate")
    p.add_argument("--questions", required=True)
    p.add_argument("--limit", type=int, default=0)
    p.add_argument("--out", default=None)
    commands.add_parser("check")
    return top


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    engine = Engine(Store(build_session(), args.store))
    if args.command in ("extract", "index", "knowledge"):
        country = V.KNOWLEDGE_COUNTRY if args.command == "knowledge" else args.country
        options = {"force": args.force, "fast": args.fast, "dry_run": args.dry_run, "name_like": args.gi}
        if args.command == "extract":
            out: object = indexing.extract(engine.store, args.root, country, engine.reader, cfg=engine.cfg, **options)
        else:
            out = engine.build_index(args.root, country, **options)
    elif args.command == "tables":
        out = engine.build_tables()
    elif args.command == "graph":
        engine.build_graph(force=args.force, chat=None if args.no_llm else engine.chat, designation=args.gi)
        out = engine.graph_stats()
    elif args.command == "ask":
        out = {k: v for k, v in engine.ask(args.text).items() if k != "context_chunks"}
    elif args.command == "sql":
        out = engine.sql(args.text)
    elif args.command == "explore":
        out = engine.search_graph(args.text)
    elif args.command == "evaluate":
        questions = corpus.question_set(engine.spark, args.questions, args.limit)
        scores, means = engine.evaluate(questions, engine.chat)
        out = {"means": {r.metric: r["mean"] for r in means.collect()}, "per_question": [r.asDict() for r in scores.collect()]}
        if args.out:
            engine.spark.createDataFrame([(json.dumps(out, ensure_ascii=False),)], "value string").coalesce(1).write.mode("overwrite").text(args.out)
    else:
        out = [r.asDict() for r in catalog.collection_prefix_counts(engine.store.chunks()).orderBy(F.col("collection")).collect()]
    print(json.dumps(out, ensure_ascii=False, indent=2, default=str))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
