"""Command line: ``python -m plumbline evaluate``, ``generate``, ``synthesise`` and ``judge``."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import evaluate, metrics, synth
from .operators.durable import shared_out
from .sources import jsonl


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="plumbline")
    commands = top.add_subparsers(dest="command", required=True)
    ev = commands.add_parser("evaluate", help="evaluate responses and write detail and log")
    ev.add_argument("--input_data", required=True)
    ev.add_argument("--input_response_data", required=True)
    ev.add_argument("--output_dir", required=True)
    ev.add_argument("--model_name", required=True)
    ev.add_argument("--loose", action="store_true")
    ev.add_argument("--mode", choices=("failfast", "flag"), default="failfast")
    ge = commands.add_parser("generate", help="ask a server for responses to the prompts that have none yet")
    ge.add_argument("--model", required=True)
    ge.add_argument("--input_data", required=True)
    ge.add_argument("--output_dir", required=True)
    ge.add_argument("--runname")
    ge.add_argument("--system_prompt")
    served(ge, workers=16, temperature=0.0)
    sy = commands.add_parser("synthesise", help="ask a server for variants of prompts")
    sy.add_argument("--kind", choices=tuple(synth.KINDS), required=True)
    sy.add_argument("--input_file", required=True)
    sy.add_argument("--target_file", required=True)
    sy.add_argument("--model", required=True)
    sy.add_argument("--resume", action="store_true", help="go on with a run that was stopped")
    served(sy, workers=128, temperature=1.0)
    ju = commands.add_parser("judge", help="ask a server which prompts are valid")
    ju.add_argument("--input_file", required=True)
    ju.add_argument("--target_dir", required=True)
    ju.add_argument("--model", required=True)
    ju.add_argument("--resume", action="store_true", help="go on with a run that was stopped")
    served(ju, workers=128, temperature=1.0)
    return top


def served(command: argparse.ArgumentParser, workers: int, temperature: float) -> None:
    """What a command that asks a server may be told."""
    command.add_argument("--client_type", choices=("vllm", "oai"), default="vllm")
    command.add_argument("--num_workers", type=int, default=workers, help="requests at a time, in all tasks together")
    command.add_argument("--port", type=int, default=8102)
    command.add_argument("--temperature", type=float, default=temperature)
    command.add_argument("--reasoning-effort", choices=("minimal", "low", "medium", "high"))
    command.add_argument("--batch_rows", type=int, default=synth.BATCH_ROWS, help="rows after which what there is is kept")


def judged_paths(source: str, folder: str) -> tuple[str, str]:
    """Where the annotated and the valid rows of a file go."""
    core = source.rstrip("/").rsplit("/", 1)[-1].split(".")[0]
    return tuple(f"{folder.rstrip('/')}/{core}_{kind}.jsonl" for kind in ("annotated", "filtered"))


def ask(spark: SparkSession, args: argparse.Namespace, client: synth.Client, tasks: int) -> str:
    """Run a command that asks a server; where its rows went."""
    if args.command == "generate":
        out = f"{args.output_dir.rstrip('/')}/{args.runname or args.model}.jsonl"
        synth.generate_into(jsonl.read_prompts(spark, args.input_data), client, out, args.system_prompt, tasks=tasks, batch_rows=args.batch_rows)
        return out
    records = jsonl.read_prompt_records(spark, args.input_file).drop("pos")
    if args.command == "synthesise":
        synth.synthesise_into(records, args.kind, client, args.target_file, args.resume, tasks=tasks, batch_rows=args.batch_rows)
        return args.target_file
    annotated, valid = judged_paths(args.input_file, args.target_dir)
    kept = synth.judge_into(records, client, annotated, valid, args.resume, tasks=tasks, batch_rows=args.batch_rows)
    total = kept.agg(F.count(F.lit(1)), F.sum("valid"), F.count_if(F.col("valid") == 0)).first()
    return f"{annotated}\n{valid}\n{total[1] or 0} valid rows of {total[0]} roots, {total[2]} roots without any"


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("plumbline").getOrCreate()
    if args.command == "evaluate":
        done = evaluate.run(spark, args.input_data, args.input_response_data, args.output_dir, args.model_name, args.loose, args.mode)
        print(metrics.formatted(done["report"]))
        print(f"{done['detail']}\n{done['log']}")
    else:
        tasks, threads = shared_out(args.num_workers, spark.sparkContext.defaultParallelism)
        print(ask(spark, args, synth.client_from_env(args.model, args.client_type, args.port, temperature=args.temperature, effort=args.reasoning_effort, workers=threads), tasks))


if __name__ == "__main__":
    main()
