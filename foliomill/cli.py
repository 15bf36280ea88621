"""Command line: index, query, extract and delete over a store."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import functions as F

from foliomill.engine import Engine
from foliomill.session import build_session
from foliomill.sources.parsers import read_files


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="foliomill")
    parser.add_argument("--store", default="./index_store")
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("index").add_argument("path")
    commands.add_parser("query").add_argument("text")
    commands.add_parser("extract").add_argument("examples", nargs="+")
    commands.add_parser("delete").add_argument("doc_ids", nargs="+", type=int)
    asked = parser.parse_args(arguments)
    spark = build_session()
    engine = Engine(spark, asked.store)
    if asked.command == "index":
        rows = read_files(spark, asked.path).withColumn("doc_id", F.xxhash64("doc_id"))
        out = engine.index(rows).collect()
    elif asked.command == "query":
        out = engine.query(spark.createDataFrame([(1, asked.text)], "query_id int, text string")).collect()
    elif asked.command == "extract":
        out = engine.extract(spark.createDataFrame(list(enumerate(asked.examples)), "item_id int, text string")).collect()
    else:
        engine.delete(spark.createDataFrame([(i,) for i in asked.doc_ids], "doc_id long"))
        out = []
    for row in out:
        print(json.dumps(row.asDict()))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
