"""Command line: query, check, stats, facts, version.

    python -m quarrylog.cli query FILE --facts DIR [--format json|csv|sarif|markdown]
    python -m quarrylog.cli check FILE
    python -m quarrylog.cli stats (compute|inspect) --facts DIR --output DIR
    python -m quarrylog.cli facts FACTFILE --output DIR
"""

from __future__ import annotations

import argparse
import sys
import threading
import time

VERSION = "0.1.0"


def load_program(path: str):
    """A program in a file: plain Datalog if it ends in .dl, else the object-oriented language."""
    from quarrylog.library.bridge import Loader
    from quarrylog.library.relations import entity
    from quarrylog.ql.datalog import parse_program
    from quarrylog.ql.lower import lower_module

    with open(path, encoding="utf-8") as f:
        text = f.read()
    return text, parse_program(text) if path.endswith(".dl") else lower_module(text, Loader(), entity)


def _session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("quarrylog").getOrCreate()


def _engine(spark, args):
    from quarrylog.library.code import code_engine, read_facts
    from quarrylog.sources import factfile

    facts = factfile.read(spark, args.facts) if args.facts.endswith((".db", ".bin")) else read_facts(spark, args.facts)
    return code_engine(spark, facts, max_iterations=args.max_iterations, allow_partial=args.allow_partial, max_bindings=args.max_bindings)


def main(argv: list[str] | None = None) -> int:
    top = argparse.ArgumentParser(prog="quarrylog")
    top.add_argument("--timeout", type=float, default=0, help="seconds after which the work is cancelled")
    commands = top.add_subparsers(dest="command", required=True)
    query = commands.add_parser("query")
    query.add_argument("file")
    query.add_argument("--facts", required=True)
    query.add_argument("--format", choices=["json", "csv", "sarif", "markdown"], default="json")
    query.add_argument("--source-root")
    query.add_argument("--max-iterations", type=int, default=100)
    query.add_argument("--max-bindings", type=int, default=0)
    query.add_argument("--allow-partial", action="store_true")
    query.add_argument("--magic-sets", action="store_true")
    query.add_argument("--dump-plan", action="store_true")
    query.add_argument("--dump-rules", action="store_true")
    query.add_argument("--print-rel-sizes", action="store_true", help="rows of each given relation, to standard error")
    commands.add_parser("check").add_argument("file")
    stats = commands.add_parser("stats")
    stats.add_argument("action", choices=["compute", "inspect"])
    stats.add_argument("--facts")
    stats.add_argument("--output", required=True)
    facts = commands.add_parser("facts")
    facts.add_argument("file")
    facts.add_argument("--output", required=True)
    commands.add_parser("version")
    args = top.parse_args(argv)

    if args.command == "version":
        print(VERSION)
        return 0
    from quarrylog.plans.ir import LogicError
    from quarrylog.ql.syntax import SyntaxFault

    try:
        return _run(args)
    except (LogicError, SyntaxFault, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


def _run(args) -> int:
    if args.command == "check":
        _, program = load_program(args.file)
        print(f"{len(program.rules)} rules, {'a' if program.query else 'no'} query")
        return 0
    spark = _session()
    spark.addTag("quarrylog")
    if args.timeout:
        timer = threading.Timer(args.timeout, lambda: spark.interruptTag("quarrylog"))
        timer.daemon = True
        timer.start()
    if args.command == "facts":
        from quarrylog.sources import factfile

        for name, df in factfile.read(spark, args.file).items():
            df.write.mode("overwrite").parquet(f"{args.output}/{name}.parquet")
        return 0
    if args.command == "stats":
        from quarrylog.library.code import read_facts
        from quarrylog.operators import statistics

        if args.action == "compute":
            statistics.compute(spark, read_facts(spark, args.facts)).write.mode("overwrite").parquet(args.output)
        else:
            spark.read.parquet(args.output).orderBy("relation", "column").drop("histogram").show(1000, False)
        return 0
    from quarrylog.sinks import formats

    started = time.time()
    text, program = load_program(args.file)
    if args.dump_rules:
        print(*program.rules, sep="\n", file=sys.stderr)
    engine = _engine(spark, args).add_rules(program.rules)
    if args.print_rel_sizes:
        for (name, arity), df in sorted(engine.stored.items()):
            print(f"{name}/{arity}: {df.count()}", file=sys.stderr)
    if program.query is None:
        print("error: the file has no query", file=sys.stderr)
        return 1
    if args.magic_sets:
        from quarrylog.plans.magic import rewrite

        program.query = rewrite(engine, program.query)
    rows = engine.query(program.query)
    if args.dump_plan:
        print(rows._jdf.queryExecution().toString(), file=sys.stderr)
    about = formats.query_metadata(text)
    if args.format == "json":
        formats.json_lines(rows, sys.stdout)
    elif args.format == "csv":
        formats.csv_text(rows, sys.stdout)
    elif args.format == "sarif":
        formats.sarif(rows, sys.stdout, about.get("id", "query"), VERSION)
    else:
        formats.markdown(rows, sys.stdout, text, args.source_root, started)
    return 0


if __name__ == "__main__":
    sys.exit(main())
