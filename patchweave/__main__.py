"""Command line: ``python -m patchweave select | summarize | doctor``."""

from __future__ import annotations

import argparse
import importlib.util
import json
import shutil
import sys


def doctor() -> list[tuple[str, bool, str]]:
    """(what, usable, detail) of what the engine needs, and of what it can do without."""
    rows = [(n, importlib.util.find_spec(n) is not None, "needed") for n in ("pyspark", "pyarrow", "numpy", "pandas")]
    rows.append(("java", shutil.which("java") is not None, shutil.which("java") or "not found"))
    return rows + [(n, shutil.which(n) is not None, "optional: decoding is outside the engine") for n in ("ffprobe", "ffmpeg")]


def _session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("patchweave").getOrCreate()


def _select(args) -> int:
    from .plans.cache import run_missing
    from .plans.selection import Config

    spark = _session()
    config = Config.from_env(**{k: v for k, v in vars(args).items() if k in Config.__annotations__ and v is not None})
    placed = run_missing(spark.read.parquet(args.grid), args.out, config, spark.read.parquet(args.frames) if args.frames else None)
    print(json.dumps({"config": config.key(), "patches": placed.count()}))
    return 0


def _summarize(args) -> int:
    from .operators import rollup
    from .sources import records

    spark = _session()
    runs = {label: records.read_eval_samples(spark, path, label).cache() for label, path in (r.split("=", 1) for r in args.run)}
    tables = [r.asDict() | {"run": label} for label, rows in runs.items() for r in rollup.scores_by_sets(rows, "score").orderBy("level", "value").collect()]
    print(records.markdown(tables, ["run", "level", "value", "n", "score_sum", "accuracy"]))
    first = next(iter(runs))
    paired = [rollup.paired(runs[first], rows).first().asDict() | {"run": label} for label, rows in runs.items() if label != first]
    if paired:
        print(records.markdown(paired, ["run", "n", "baseline_sum", "candidate_sum", "gained", "lost", "p_value"]))
    return 0


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="patchweave", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    s = commands.add_parser("select", help="placements of a cost grid, for videos that are not done yet")
    s.add_argument("--grid", required=True)
    s.add_argument("--out", required=True)
    s.add_argument("--frames")
    for name, kind in (("selector", str), ("grouping", str), ("anchor", str), ("group_size", int), ("images_per_group", int), ("patch", int), ("block", int), ("rows", int), ("cols", int), ("diversity_fraction", float), ("novelty_weight", float), ("dedup_descriptor", str), ("dedup_threshold", float)):
        s.add_argument(f"--{name.replace('_', '-')}", dest=name, type=kind)
    m = commands.add_parser("summarize", help="scores of runs; the first is the baseline")
    m.add_argument("--run", action="append", required=True, metavar="LABEL=PATH")
    commands.add_parser("doctor", help="what is there and what is missing")
    args = parser.parse_args(argv)
    if args.command == "doctor":
        rows = doctor()
        for what, usable, detail in rows:
            print(f"{what}: {'OK' if usable else 'missing'} ({detail})")
        return int(any(not usable and detail == "needed" for _, usable, detail in rows))
    return {"select": _select, "summarize": _summarize}[args.command](args)


if __name__ == "__main__":
    sys.exit(main())
