"""Command line: ``redact`` texts, files or standard input; ``eval`` predictions against gold documents."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from spanforge.api import MODES, Redactor
from spanforge.plans import evaluation
from spanforge.sources import readers, sinks


def redact(spark: SparkSession, args) -> None:
    lines = args.text or sys.stdin
    docs = readers.read_texts(spark, args.file) if args.file else readers.lines_of(spark, lines)
    out = Redactor(args.mode).transform(docs)
    if args.out:
        out.write.json(args.out)
        return
    for r in out.select(F.to_json(F.struct("doc_id", "redacted_text", "spans", "summary"))).toLocalIterator():
        print(r[0])


def evaluate(spark: SparkSession, args) -> None:
    with sinks.Timings() as took:
        gold, pred = evaluation.span_frames(readers.read_gold(spark, args.gold), readers.read_predictions(spark, args.predictions))
        took.lap("read")
        values = sinks.metrics_json(evaluation.scores(gold, pred, args.k), args.out, {"k": args.k})["metrics"]
        took.lap("score")
    if wrong := evaluation.broken(values):
        raise SystemExit(f"metrics do not add up: {wrong}")
    if args.timings:
        took.write(args.timings, {"spans": int(values["overall.pred"])}, {"k": args.k})


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    top = argparse.ArgumentParser(prog="spanforge")
    sub = top.add_subparsers(required=True)
    r = sub.add_parser("redact")
    r.add_argument("text", nargs="*")
    r.add_argument("--file", help="a file or folder of whole texts")
    r.add_argument("--mode", choices=MODES, default="typed")
    r.add_argument("--out", help="folder for JSON lines; without it they are printed")
    r.set_defaults(run=redact)
    e = sub.add_parser("eval")
    e.add_argument("gold")
    e.add_argument("predictions")
    e.add_argument("out", help="metrics as JSON")
    e.add_argument("-k", type=int, default=3, help="characters that a match shares at least")
    e.add_argument("--timings", help="seconds by stage as JSON")
    e.set_defaults(run=evaluate)
    args = top.parse_args(argv)
    args.run(spark or SparkSession.builder.appName("spanforge").getOrCreate(), args)


if __name__ == "__main__":
    main()
