"""Command line: ``python -m tidelog.cli convert | shell | analyze``."""

from __future__ import annotations

import argparse
import sys
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.errors import TidelogError
from tidelog.functions.names import topic_name
from tidelog.operators.export import export
from tidelog.plans.analyze import analyze, report
from tidelog.shell import Shell
from tidelog.sources.formats import detect_input, infer_output, open_input, write_output


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="tidelog", description="Convert, query and measure recordings.")
    sub = out.add_subparsers(dest="command", required=True)
    convert = sub.add_parser("convert", help="convert between formats")
    convert.add_argument("inputs", nargs="+")
    convert.add_argument("-o", "--output")
    convert.add_argument("--stdout", action="store_true", help="write one ordered recording to standard output")
    convert.add_argument("--output-format", choices=["mcap", "parquet", "duckdb", "tables"])
    convert.add_argument("--topics", nargs="*")
    convert.add_argument("--encoding", default="ros1", choices=["ros1", "cdr", "protobuf"])
    convert.add_argument("-m", "--mode", default="error", choices=["error", "overwrite", "append"])
    convert.add_argument("--shell", action="store_true", help="open a shell on the output")
    shell = sub.add_parser("shell", help="query with SQL")
    shell.add_argument("source")
    measure = sub.add_parser("analyze", help="report sizes in several formats")
    measure.add_argument("inputs", nargs="+")
    measure.add_argument("-o", "--output", required=True)
    measure.add_argument("--clean", action="store_true")
    return out


def counted(frames: dict[str, DataFrame]) -> dict[str, int]:
    """Rows of each table, by one job."""
    if not frames:
        return {}
    each = reduce(DataFrame.unionAll, (f.select(F.lit(n).alias("n")) for n, f in frames.items()))
    return dict.fromkeys(frames, 0) | {r.n: r["count"] for r in each.groupBy("n").count().collect()}


def _convert(spark: SparkSession, args: argparse.Namespace) -> int:
    if not args.stdout and not args.output:
        raise TidelogError("give --output or --stdout")
    source_format = detect_input(spark, args.inputs[0])
    target = "mcap" if args.stdout else args.output_format or infer_output(args.output)
    recording = source_format == "mcap"
    source = open_input(spark, args.inputs, source_format, args.topics if recording else None)
    frames = source.chosen(None if recording else args.topics)
    if target == "mcap" and not recording:
        frames = {topic_name(n): f for n, f in frames.items()}
    if args.stdout:
        stats = export(frames, sys.stdout.buffer, args.encoding)
        print(f"{stats.messages} messages, {len(stats.by_topic)} topics", *(f"  {t}: {n}" for t, n in sorted(stats.by_topic.items())), sep="\n", file=sys.stderr)
        return 0
    tables = frames | ({n: source.table(n) for n in ("_channels", "_schemas")} if recording and target != "mcap" else {})
    written = write_output(spark, tables, args.output, target, args.mode, args.encoding)
    counts = counted(frames)
    print(f"{len(args.inputs)} inputs, {len(frames)} tables, {sum(counts.values())} rows", *(f"  {t} -> {written[t]}: {n}" for t, n in sorted(counts.items())), sep="\n", file=sys.stderr)
    if args.shell:
        Shell(spark, open_input(spark, args.output, target)).run()
    return 0


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("tidelog").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    try:
        if args.command == "convert":
            return _convert(spark, args)
        if args.command == "shell":
            Shell(spark, open_input(spark, args.source)).run()
        else:
            print(report(analyze(spark, args.inputs, args.output, args.clean), sys.stdout.isatty()))
        return 0
    except TidelogError as e:
        print(f"{type(e).__name__}: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
