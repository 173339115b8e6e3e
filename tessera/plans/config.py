"""Configuration from JSON and the command line: python -m tessera.plans.config --features F --examples E --out O."""

from __future__ import annotations

import argparse
import json
from dataclasses import asdict, replace

from pyspark.sql import SparkSession, functions as F

from tessera.plans import pipelines
from tessera.plans.pipelines import Config
from tessera.sources import runs


def from_dict(values: dict) -> Config:
    """A checked configuration; an unknown key is a TypeError, a value out of bounds a ValueError."""
    return Config(**values)


def parse(argv: list[str] | None = None) -> tuple[argparse.Namespace, Config]:
    p = argparse.ArgumentParser(description="Run all views over an activation table.")
    for name, text in (("features", "table of row_idx, side, feature, max_act, freq"), ("examples", "table of row_idx, example_id"), ("out", "folder of runs")):
        p.add_argument(f"--{name}", required=True, help=text)
    p.add_argument("--config", default="", help="JSON file of parameters, on any storage that Spark reads")
    p.add_argument("--name", default="run")
    p.add_argument("--set", action="append", default=[], metavar="KEY=VALUE", help="a parameter; VALUE is JSON")
    p.add_argument("--force-rerun", action="store_true", help="begin a new folder even where one can be gone on with")
    args = p.parse_args(argv)
    try:
        args.set = {k: json.loads(v) for k, v in (s.split("=", 1) for s in args.set)}
    except ValueError:
        p.error("--set takes KEY=VALUE with a JSON value")
    return args, from_dict(args.set)


def main(argv: list[str] | None = None) -> str:
    """Run, or leave a folder whose manifest has the same state and configuration as it is; returns the folder."""
    args, cfg = parse(argv)
    spark = SparkSession.builder.getOrCreate()
    if args.config:
        cfg = replace(from_dict(runs.read_json(spark, args.config) or {}), **args.set)
    features, examples = spark.read.parquet(args.features), spark.read.parquet(args.examples)
    folder = runs.resolve(spark, args.out, args.name, cfg.seed, use=not args.force_rerun)
    now = runs.state(examples, int(features.agg(F.coalesce(F.max("feature"), F.lit(-1)) + 1).first()[0]))
    old = runs.read_json(spark, f"{folder}/{runs.MANIFEST}")
    if old and not args.force_rerun and old.get("config") == asdict(cfg) and runs.state_valid(spark, folder, now):
        return folder
    tables = pipelines.run(spark, features, examples, cfg)
    for name, t in tables.items():
        t.write.mode("overwrite").parquet(f"{folder}/{name}")
    lists = {"b1": tables["b1"].orderBy(F.desc("delta_min"), "k", "m"), "b2": tables["b2"].orderBy(F.desc(F.abs("z_score")), "k", "m")}
    runs.write_manifest(spark, folder, asdict(cfg), tables["summary"].first().asDict(), lists, now=now)
    runs.write_state(spark, folder, now)
    return folder


if __name__ == "__main__":
    print(main())
