"""python -m lineweave.plans.cli match REFS MODELS --output DIR, or clean FILES --output DIR."""

from __future__ import annotations

import argparse
from dataclasses import replace

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lineweave.operators import matching, points
from lineweave.plans import pipeline
from lineweave.plans.thresholds import Thresholds
from lineweave.sources import readers, writers


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="lineweave")
    sub = out.add_subparsers(dest="command", required=True)
    match = sub.add_parser("match", help="link reference lines to model lines")
    match.add_argument("refs")
    match.add_argument("models")
    match.add_argument("--output", "-o", default="output/links")
    match.add_argument("--dc-lines")
    match.add_argument("--lines-110kv")
    match.add_argument("--include-dc-matching", action="store_true")
    match.add_argument("--include-110kv-matching", action="store_true")
    match.add_argument("--dc-output", action=argparse.BooleanOptionalAction, default=True)
    match.add_argument("--110kv-output", dest="output_110kv", action=argparse.BooleanOptionalAction, default=True)
    match.add_argument("--manual", action=argparse.BooleanOptionalAction, default=True)
    match.add_argument("--manual-file")
    match.add_argument("--predefined", action=argparse.BooleanOptionalAction, default=True)
    match.add_argument("--import-new-lines", metavar="FILE")
    match.add_argument("--viz", action=argparse.BooleanOptionalAction, default=True)
    match.add_argument("--grid-comparison", action=argparse.BooleanOptionalAction, default=True)
    match.add_argument("--transformers", nargs=2, metavar=("REFS", "MODELS"))
    match.add_argument("--transformers-distance", type=float, default=5.0)
    match.add_argument("--target-ratio", type=float, default=0.8)
    match.add_argument("--quiet", action="store_true")
    clean = sub.add_parser("clean", help="normalise line files to one table")
    clean.add_argument("files", nargs="+")
    clean.add_argument("--output", "-o", default="output/clean")
    return out


def run(spark: SparkSession, args: argparse.Namespace) -> None:
    if args.command == "clean":
        frames = [readers.read_lines(spark, f, metres=True) for f in args.files]
        merged = frames[0]
        for f in frames[1:]:
            merged = merged.unionByName(f)
        writers.write_csv(merged.drop("parts"), args.output)
        return
    refs, models = readers.read_lines(spark, args.refs), readers.read_lines(spark, args.models, metres=True)
    if args.import_new_lines:
        models = readers.import_lines(models, readers.read_lines(spark, args.import_new_lines, metres=True))
    dc = readers.read_dc_links(spark, args.dc_lines) if args.dc_lines else None
    low = readers.read_110kv(spark, args.lines_110kv) if args.lines_110kv else None
    for extra, wanted in ((dc, args.include_dc_matching), (low, args.include_110kv_matching)):
        if extra is not None and wanted:
            models = models.unionByName(extra)
    manual = None
    if args.manual:
        parts = [matching.manual_links(spark)] if args.predefined else []
        parts += [readers.read_manual_links(spark, args.manual_file).select("a_id", "b_ids")] if args.manual_file else []
        manual = parts[0] if parts else None
        for p in parts[1:]:
            manual = manual.join(p.select("a_id"), "a_id", "left_anti").unionByName(p)
    result = pipeline.link(refs, models, manual, replace(Thresholds(), extend_ratio=args.target_ratio))
    links = result.links.persist()
    writers.write_csv(links, f"{args.output}/links")
    exported = models
    for extra, wanted, there in ((dc, args.dc_output, args.include_dc_matching), (low, args.output_110kv, args.include_110kv_matching)):
        if extra is not None and wanted and not there:
            exported = exported.unionByName(extra)
    writers.write_csv(writers.with_code(exported.drop("parts"), links, refs), f"{args.output}/models", quote_all=True)
    writers.write_csv(result.unmatched.drop("parts"), f"{args.output}/unmatched")
    each = links.where("matched").select("a_id", F.explode("b_ids").alias("b_id"))
    writers.write_csv(matching.transfer(models, each, refs), f"{args.output}/parameters")
    if args.grid_comparison:
        writers.write_csv(result.by_voltage, f"{args.output}/length_by_voltage")
    if args.viz:
        drawn = writers.line_features(pipeline.with_points(refs), links.drop("b_ids"))
        writers.write_geojson_lines(drawn, "points", ["id", "kv", "status", "class"], f"{args.output}/features")
    if args.transformers:
        a, b = (readers.read_transformers(spark, f) for f in args.transformers)
        a, b = a.withColumnRenamed("id", "a_id"), b.withColumnRenamed("id", "b_id")
        writers.write_csv(points.link(a, b, args.transformers_distance), f"{args.output}/transformers")


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("lineweave").getOrCreate()
    if args.quiet:
        spark.sparkContext.setLogLevel("ERROR")
    run(spark, args)


if __name__ == "__main__":
    main()
