"""Command line: ingest, search, answer, upload, stats over a store. `python -m textloom.cli --store PATH COMMAND ...`"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from textloom.functions import rules
from textloom.plans.engine import Engine
from textloom.sources import readers


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="textloom")
    p.add_argument("--store", required=True, help="folder of the engine's tables")
    sub = p.add_subparsers(dest="command", required=True)
    ingest = sub.add_parser("ingest", help="markdown pages into documents, chunks and index")
    ingest.add_argument("pages")
    ingest.add_argument("--clear-index", action="store_true", help="drop what the store holds first")
    ingest.add_argument("--min-tokens", type=int, default=rules.GATE_TOKENS)
    for name in ("search", "answer"):
        ask = sub.add_parser(name, help=f"{name} for each line of queries")
        ask.add_argument("queries", help="text file, a query on each line")
        ask.add_argument("--top-k", type=int, default=rules.TOP_K)
        ask.add_argument("--output", help="folder for JSON lines; the first rows are printed without it")
    upload = sub.add_parser("upload", help="text files as one chunk each")
    upload.add_argument("files")
    sub.add_parser("stats", help="rows of each table")
    return p


def asked(spark: SparkSession, path: str):
    """Non-blank lines of a text file, each with a number of its own."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.select(F.monotonically_increasing_id().alias("query_id"), F.col("value").alias("query"), F.lit(None).cast("string").alias("session_id"))


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(args)
    spark = spark or SparkSession.builder.appName("textloom").getOrCreate()
    engine = Engine(spark, a.store)
    if a.command == "ingest":
        print(json.dumps(engine.ingest(readers.pages(spark, a.pages), a.clear_index, a.min_tokens)))
    elif a.command == "upload":
        print(json.dumps(engine.append_document(spark.read.format("binaryFile").load(a.files).select("path", "content"))))
    elif a.command == "stats":
        print(json.dumps(engine.health()))
    else:
        found = getattr(engine, a.command)(asked(spark, a.queries), a.top_k)
        if a.output:
            found.write.mode("overwrite").json(a.output)
        else:
            found.show(20, 80)
    return 0


if __name__ == "__main__":
    sys.exit(main())
