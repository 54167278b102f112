"""Command line: run, analyze, block, match, eval, edges, resolve, benchmark, benchmark-all, download."""

from __future__ import annotations

import argparse
import json
import time
from dataclasses import asdict, replace
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
import pyspark.sql.functions as F

from kinfold.operators.blocking import blocking_stats, nested, salt
from kinfold.operators.entities import dense_id, to_entities
from kinfold.operators.graph import connected_components
from kinfold.operators.matching import RuleMatcher
from kinfold.operators.merge import group_edges, merge_components, merge_edges
from kinfold.operators.metrics import er_report, format_report, pair_metrics
from kinfold.operators.pairs import predicted
from kinfold.operators.profiling import duplicate_rate, profile_columns, suggested_config
from kinfold.plans.config import ResolveConfig
from kinfold.plans.resolve import default_blocker, report, resolve
from kinfold.session import session
from kinfold.sources import benchmarks, files


def _entities(spark: SparkSession, path: str, config: ResolveConfig) -> DataFrame:
    df = files.load(spark, path)
    if config.id_field is None:
        df = dense_id(df, "__id")
    return to_entities(df, config.id_field or "__id", config.name_field, config.text_fields, config.entity_type)


def _config(args: argparse.Namespace) -> ResolveConfig:
    """The file's settings, with the flags that were given over them."""
    base = ResolveConfig.read(args.config) if getattr(args, "config", None) else ResolveConfig()
    given = {"max_iterations": "iterations", "blocking_method": "method", "target_block_size": "target", "max_block_size": "max_block", "name_field": "name", "limit_blocks": "limit", "convergence_threshold": "threshold", "entity_type": "entity_type"}
    return replace(base, **{k: v for k, flag in given.items() if (v := getattr(args, flag, None)) is not None})


def run(spark: SparkSession, args: argparse.Namespace) -> dict:
    df = files.load(spark, args.input)
    rows, done = resolve(df, _config(args))
    summary = {"iterations": [asdict(r) for r in done], "original_count": done[0].input_count, "final_count": done[-1].output_count, "overall_reduction_pct": done[-1].overall_reduction_pct}
    files.write_output(rows, args.output, summary)
    print(format_report(report(rows, done).first().asDict()))
    return summary


def analyze(spark: SparkSession, args: argparse.Namespace) -> dict:
    df = files.load(spark, args.input)
    profile = profile_columns(df)
    out = {"rows": df.count(), "fields": [r.asDict() for r in profile.collect()], **duplicate_rate(profile).first().asDict()}
    out["config"] = suggested_config(profile, out["rows"])
    if args.output:
        files.write_json(out, args.output)
    return out


def block(spark: SparkSession, args: argparse.Namespace) -> dict:
    config = _config(args)
    rows = _entities(spark, args.input, config)
    blocks = salt(default_blocker(config)(rows, 1), config.max_block_size)
    files.write_lines(nested(rows, blocks, config.blocking_method), f"{args.output}/blocks.jsonl")
    blocks.write.mode("overwrite").parquet(f"{args.output}/blocks.parquet")
    rows.write.mode("overwrite").parquet(f"{args.output}/entities.parquet")
    return blocking_stats(blocks).first().asDict()


def match(spark: SparkSession, args: argparse.Namespace) -> dict:
    rows, blocks = (spark.read.parquet(f"{args.input}/{n}.parquet") for n in ("entities", "blocks"))
    found = RuleMatcher()(rows, blocks)
    files.write_lines(found, f"{args.output}/matches.jsonl")
    linked = connected_components(rows.select(F.col("er_id").alias("id")), found.select(F.col("entity_a_id").alias("src"), F.col("entity_b_id").alias("dst")))
    merged = merge_components(rows.join(linked.select(F.col("id").alias("er_id"), "component"), "er_id")).drop("component")
    merged.write.mode("overwrite").parquet(f"{args.output}/resolved.parquet")
    resolutions = spark.range(1).select(F.lit(rows.count()).alias("original_count"), F.lit(spark.read.parquet(f"{args.output}/resolved.parquet").count()).alias("resolved_count"))
    return files.match_totals(resolutions).first().asDict()


def evaluate(spark: SparkSession, args: argparse.Namespace) -> dict:
    rows = spark.read.parquet(f"{args.input}/resolved.parquet")
    history = spark.read.parquet(args.history).select(F.col("er_uuid").alias("uuid")) if args.history else None
    out = er_report(rows, args.original or rows.count(), args.previous, history).first().asDict()
    if args.truth:
        found = files.read_decisions(spark, f"{args.input}/matches.jsonl")
        out |= pair_metrics(predicted(found, rows), files.read_truth(spark, args.truth, offset=args.offset)).first().asDict()
    if args.output:
        files.write_json(out, args.output)
    print(format_report(out))
    return out


def edges(spark: SparkSession, args: argparse.Namespace) -> dict:
    df = files.load(spark, args.input)
    numbers = tuple(f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float", "long", "integer") and f.name not in ("src", "dst", "src_id", "dst_id"))
    merge_edges(df, sums=numbers).write.mode("overwrite").parquet(args.output)
    return group_edges(df).agg(F.count(F.lit(1)).alias("groups"), F.sum("group_size").alias("edges")).first().asDict()


def resolve_in_steps(spark: SparkSession, args: argparse.Namespace) -> dict:
    out = {"block": block(spark, args)}
    args.input = args.output
    out["match"] = match(spark, args)
    args.original, args.previous, args.truth, args.history = out["match"]["original_count"], None, None, f"{args.output}/entities.parquet"
    args.output = f"{args.output}/evaluation.json"
    out["eval"] = evaluate(spark, args)
    return out


def benchmark(spark: SparkSession, args: argparse.Namespace) -> dict:
    data = benchmarks.read(spark, args.name, args.input)
    rows = data.entities()
    config = replace(_config(args), blocking_method=args.method or "name")
    found = RuleMatcher(config.match_threshold)(rows, salt(default_blocker(config)(rows, 1), config.max_block_size))
    out = {"dataset": args.name, **data.evaluate(found.select(F.col("entity_a_id").alias("a"), F.col("entity_b_id").alias("b")), args.cross_source_only).first().asDict()}
    if args.output:
        files.write_json(out, args.output)
    return out


def benchmark_all(spark: SparkSession, args: argparse.Namespace) -> dict:
    """Each registered data set that has a folder under the input; one that fails says why, and the others go on."""
    base, out, results = args.input, args.output, {}
    for name in sorted(benchmarks.REGISTRY):
        if not Path(base, name).is_dir():
            continue
        args.name, args.input, args.output = name, f"{base}/{name}", out and f"{out}/{name}_results.json"
        began = time.perf_counter()
        try:
            results[name] = benchmark(spark, args) | {"elapsed_seconds": time.perf_counter() - began}
        except Exception as e:  # noqa: BLE001 - reported in the results
            results[name] = {"dataset": name, "error": str(e)}
    if out:
        files.write_json(results, f"{out}/all_results.json")
    for name, r in results.items():
        print(f"{name:<16}" + (r["error"] if "error" in r else "".join(f"{k} {r[k]:.4f}  " for k in ("precision", "recall", "f1_score"))))
    return results


def download(spark: SparkSession, args: argparse.Namespace) -> dict:
    data = benchmarks.read(spark, args.name, benchmarks.fetch(args.name, args.output, args.input))
    return {"dataset": args.name, "left": data.left.count(), "right": data.right.count(), "pairs": data.truth.count()}


COMMANDS = {"run": run, "analyze": analyze, "block": block, "match": match, "eval": evaluate, "edges": edges, "resolve": resolve_in_steps, "benchmark": benchmark, "benchmark-all": benchmark_all, "download": download}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="kinfold", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    for name in COMMANDS:
        c = sub.add_parser(name)
        c.add_argument("--input", required=True)
        c.add_argument("--output", required=name in ("run", "block", "match", "edges", "resolve", "download"))
        if name in ("run", "block", "resolve", "benchmark", "benchmark-all"):
            c.add_argument("--config")
            c.add_argument("--iterations", type=int)
            c.add_argument("--method", choices=["semantic", "name"])
            c.add_argument("--target", type=int)
            c.add_argument("--max-block", type=int)
            c.add_argument("--limit", type=int)
            c.add_argument("--threshold", type=float)
            c.add_argument("--entity-type")
        if name in ("run", "block", "resolve"):
            c.add_argument("--name")
        if name in ("benchmark", "download"):
            c.add_argument("--name", required=True, choices=sorted(benchmarks.REGISTRY))
        if name in ("benchmark", "benchmark-all"):
            c.add_argument("--cross-source-only", action="store_true")
        if name == "eval":
            c.add_argument("--truth")
            c.add_argument("--history")
            c.add_argument("--original", type=int)
            c.add_argument("--previous", type=int)
            c.add_argument("--offset", type=int, default=0)
    return p


def main(argv: list[str] | None = None) -> dict:
    args = parser().parse_args(argv)
    out = COMMANDS[args.command](session(), args)
    print(json.dumps(out, indent=2, default=str))
    return out


if __name__ == "__main__":
    main()
