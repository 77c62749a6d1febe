"""Command line: wf, index, info, search, gen. Exit status 0 fine, 1 faults or no hits, 2 usage or I/O.

    python -m tessera.cli wf FILE... [--max-errors N]
    python -m tessera.cli index FILE... --out DIR
    python -m tessera.cli info DIR
    python -m tessera.cli search NEEDLE FILE... [-i] [--max N]
    python -m tessera.cli gen --size 10MiB --documents 4 --out DIR
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.scalars import human, parse_size
from tessera.operators import search
from tessera.operators.scan import scan, totals
from tessera.operators.scanner import ScanConfig
from tessera.sources import index_file
from tessera.sources.documents import generate_size, read_documents

VERSION = "0.1.0"


def _print(rows: DataFrame, column: str) -> int:
    n = 0
    for row in rows.toLocalIterator():
        print(row[column])
        n += 1
    return n


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="tessera", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("--version", action="version", version=VERSION)
    commands = parser.add_subparsers(dest="command", required=True)
    wf = commands.add_parser("wf", help="report every well-formedness fault")
    wf.add_argument("files", nargs="+")
    wf.add_argument("--max-errors", type=int, default=100)
    index = commands.add_parser("index", help="write index files as a table")
    index.add_argument("files", nargs="+")
    index.add_argument("--out", required=True)
    info = commands.add_parser("info", help="show what index files hold")
    info.add_argument("table")
    find = commands.add_parser("search", help="literal search")
    find.add_argument("needle")
    find.add_argument("files", nargs="+")
    find.add_argument("-i", "--ignore-case", action="store_true")
    find.add_argument("--max", type=int, default=search.MAX_HITS)
    gen = commands.add_parser("gen", help="write a generated corpus as a table of documents")
    gen.add_argument("--size", type=parse_size, required=True)
    gen.add_argument("--documents", type=int, default=1)
    gen.add_argument("--out", required=True)
    return parser


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    try:
        args = _parser().parse_args(argv)
    except SystemExit as e:
        return 2 if e.code else 0
    spark = spark or SparkSession.builder.appName("tessera").getOrCreate()
    try:
        return _run(spark, args)
    except Exception as e:  # noqa: BLE001  a command line reports, it does not trace
        print(f"error: {str(e).splitlines()[0]}", file=sys.stderr)
        return 2


def _run(spark: SparkSession, args: argparse.Namespace) -> int:
    match args.command:
        case "wf":
            docs = read_documents(spark, *args.files)
            found = scan(docs, ScanConfig(max_errors=args.max_errors, contents=False))
            _print(found.report(docs).orderBy("doc_id", "seq"), "report")
            faults = 0
            for r in totals(docs).join(docs.select("doc_id", "name"), "doc_id").orderBy("name").toLocalIterator():
                print(f"{r['name']}: {r['elements']:,} elements, {r['lines']:,} lines, {human(r['bytes'])}, {r['errors']:,} errors")
                faults += r["errors"]
            return int(faults > 0)
        case "index":
            index_file.index_files(read_documents(spark, *args.files)).write.mode("overwrite").parquet(args.out)
        case "info":
            for r in index_file.inspect(spark.read.parquet(args.table)).toLocalIterator():
                print(f"{r.doc_id}: {r.elements:,} elements ({r.indexed:,} indexed), {r.attributes:,} attributes, depth {r.max_depth}, {r.lines:,} lines, {r.errors:,} errors, heap {human(r.heap_bytes)}, names {', '.join(r.names)}")
        case "search":
            docs = read_documents(spark, *args.files)
            hits = search.search(docs, args.needle, args.ignore_case, args.max)
            return int(_print(search.report(hits, docs).orderBy("doc_id", "offset"), "report") == 0)
        case "gen":
            generate_size(spark, args.size, args.documents).write.mode("overwrite").parquet(args.out)
    return 0


def frame_times(times: DataFrame, last: int = 240) -> DataFrame:
    """p50, p99 and max of the last measurements (seq, ms), by rank floor(n q)."""
    rows = times.orderBy(F.desc("seq")).limit(last)
    ranked = rows.select("ms", (F.row_number().over(Window.orderBy("ms")) - 1).alias("r"), F.count("*").over(Window.partitionBy()).alias("n"))
    at = lambda q: F.max(F.when(F.col("r") == F.least(F.floor(F.col("n") * q), F.col("n") - 1), F.col("ms")))
    return ranked.agg(at(0.5).alias("p50"), at(0.99).alias("p99"), F.max("ms").alias("max"))


if __name__ == "__main__":
    sys.exit(main())
