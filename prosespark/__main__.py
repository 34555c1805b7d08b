"""Command line: measure files or run an audit; one JSON object a line, never a file's text.

    python -m prosespark scan --format text FILE...
    python -m prosespark audit --format markdown FILE...

Exit codes: 0 ok, 1 a file that can't be read or isn't UTF-8, 2 wrong arguments, 10 Markdown beyond the scanner.
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from prosespark.functions import markdown
from prosespark.operators import extract, genre, metrics
from prosespark.sources import io


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="prosespark")
    parser.add_argument("command", choices=("scan", "audit"))
    parser.add_argument("--format", choices=("text", "markdown"), required=True)
    parser.add_argument("files", nargs="+")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("prosespark").getOrCreate()
    code = 0
    docs = None
    for f in args.files:
        one = io.read_texts(spark, f)
        docs = one if docs is None else docs.unionByName(one)
    bad = [r.path for r in docs.where("status <> 'ok'").select("path").collect()]
    for path in bad:
        print(json.dumps({"path": path, "status": "decode_error"}))
        code = 1
    good = docs.where("status = 'ok'").select(F.col("path").alias("doc_id"), "path", "text", "source_sha256")
    if args.command == "audit":
        good = genre.classify(good, path_col="path")
    if args.format == "markdown":
        good = markdown.with_units(good)
        for r in good.where("units is null").select("doc_id").collect():
            print(json.dumps({"path": r.doc_id, "status": "capability_unavailable"}))
            code = code or 10
        good = good.where("units is not null").drop("md")
    else:
        good = extract.with_units(good)
    rows = metrics.envelope(metrics.measured(good), "genre" if args.command == "audit" else None, f"{args.format}-v1")
    for r in rows.groupBy("doc_id").agg(F.to_json(F.sort_array(F.collect_list(F.struct(*[c for c in rows.columns if c != "doc_id"])))).alias("metrics")).orderBy("doc_id").collect():
        print(json.dumps({"path": r.doc_id, "status": "ok", "metrics": json.loads(r.metrics)}))
    return code


if __name__ == "__main__":
    sys.exit(main())
