"""Command line: prepare, segment, deploy, assign, report (Markdown, notebook or PDF), dashboard (HTML)."""

from __future__ import annotations

import argparse
import sys

from cairn.plans import dashboard, flows, reports
from cairn.runtime import build_session, ship
from cairn.sources import tables as io


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="cairn")
    parser.add_argument("step", choices=("prepare", "segment", "deploy", "assign", "report", "dashboard", "all"))
    parser.add_argument("--input")
    parser.add_argument("--output", required=True)
    parser.add_argument("--format", choices=("markdown", "notebook", "pdf"), default="markdown")
    parser.add_argument("--clusters", type=int, nargs="*", help="clusters that the dashboard's explorer shows (all)")
    args = parser.parse_args(argv)
    spark = build_session()
    ship(spark)
    if args.step in ("prepare", "all", "assign") and not args.input:
        parser.error("--input is needed")
    if args.step in ("prepare", "all"):
        flows.prepare(spark, io.read_csv(spark, args.input, io.raw_schema(text=True)), args.output)
    if args.step in ("segment", "all"):
        flows.segment(spark, args.output)
    if args.step in ("deploy", "all"):
        flows.deploy(spark, args.output)
    if args.step == "assign":
        io.write(flows.assign(spark, io.read_csv(spark, args.input, None), args.output), f"{args.output}/assigned", "csv")
    if args.step in ("report", "all"):
        told = reports.notebook(spark, args.output) if args.format == "notebook" else reports.report(spark, args.output)
        sys.stdout.buffer.write(reports.pdf(told) if args.format == "pdf" else told.encode())
    if args.step == "dashboard":
        sys.stdout.buffer.write(dashboard.page(spark, args.output, args.clusters).encode())
    return 0


if __name__ == "__main__":
    sys.exit(main())
