"""Evaluation of responses: lookup by prompt, checks, and a verdict for each prompt."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import loose_variants, solid, strip_thinking
from .checkers import JSON, PYTHON, REGISTRY, argument_names, dispatch, json_each, searched_each


def join_responses(prompts: DataFrame, responses: DataFrame) -> DataFrame:
    """Left outer join on the prompt's text; ``responses`` has each prompt once."""
    return prompts.join(responses.select("prompt", "response"), "prompt", "left")


def _instructions(mode: str, ids: list[str]) -> Column:
    """Each instruction with its arguments and what is wrong with it: an array of (id, args, error).

    failfast: an unknown id or missing arguments are an error when the rows are
    computed. flag: they have ``error`` set and count as not followed.
    """
    if mode not in ("failfast", "flag"):
        raise ValueError(f"unknown mode {mode!r}")
    given = F.greatest(F.coalesce(F.size("kwargs"), F.lit(0)), F.lit(0))

    def one(own: Column, i: Column) -> Column:
        error = F.when(~own.isin(*ids), F.concat(F.lit("unknown instruction "), own)).when(i >= given, F.lit("no arguments"))
        if mode == "failfast":
            error = F.when(error.isNotNull(), F.raise_error(error).cast("string"))
        return F.struct(own.alias("id"), F.get("kwargs", i).alias("args"), error.alias("error"))

    return F.transform(F.coalesce("instruction_id_list", F.array().cast("array<string>")), one)


class _Known:
    """Answers of Python functions that are columns of the row: of the reading, and of the instruction."""

    def __init__(self, json: Column, answers: Column):
        self.of_json, self.answers = json, answers

    def json(self, v: Column) -> Column:
        return self.of_json

    def searched(self, v: Column, asked: Column) -> Column:
        return self.answers


def _evaluated(rows: DataFrame, texts: Column, mode: str, only: list[str] | None) -> DataFrame:
    """Verdicts on rows(pos, key, prompt, instruction_id_list, kwargs, response): an instruction is followed if one of ``texts`` follows it.

    Checks run within the arrays of a row: neither texts nor instructions become
    rows. JSON and patterns that Java can't take are asked about once a row, and
    only for rows that need it. Users' checks that are Python functions get a
    row an instruction, joined back by ``pos``.
    """
    ids = list(REGISTRY) if only is None else list(only)
    native = [i for i in ids if i not in PYTHON]
    fields = rows.schema["kwargs"].dataType.elementType.names
    df = rows.withColumn("__pairs", _instructions(mode, ids)).withColumn("__texts", texts)
    asking = [i for i in native if hasattr(REGISTRY[i], "request")]
    if JSON in native:
        df = df.withColumn("__json", json_each(F.when(F.exists("__pairs", lambda p: p["id"] == JSON), F.col("__texts"))))
    if asking:

        def asked(p: Column) -> Column:
            out = F.when(F.lit(False), F.lit(""))
            for i in asking:
                out = out.when(p["id"] == i, REGISTRY[i].request(**{a: p["args"][a] for a in argument_names(REGISTRY[i])}))
            return out

        df = df.withColumn("__asked", F.transform("__pairs", asked))
        some = F.exists("__asked", lambda a: a.isNotNull())
        df = df.withColumn("__answers", searched_each(F.when(some, F.col("__texts")), F.when(some, F.col("__asked"))))
    readings = F.transform("__texts", lambda t, k: F.struct(t.alias("text"), (F.get("__json", k) if JSON in native else F.lit(False)).alias("json"), k.alias("k")))

    def followed(p: Column, i: Column) -> Column:
        def by(reading: Column) -> Column:
            answers = F.get(F.get("__answers", i), reading["k"]) if asking else F.lit(False)
            return solid(reading["text"]) & dispatch(reading["text"], p["id"], p["args"], native, _Known(reading["json"], answers), fields)

        ok = F.when(p["error"].isNotNull() | p["id"].isNull(), False)
        if len(native) < len(ids):
            ok = ok.when(p["id"].isin(*PYTHON), F.lit(None).cast("boolean"))
        return ok.otherwise(F.coalesce(F.exists("__readings", by), F.lit(False)))

    errors = F.array_sort(F.array_distinct(F.filter(F.transform("__pairs", lambda p: p["error"]), lambda e: e.isNotNull())))
    df = df.withColumn("__readings", readings).withColumn("follow_instruction_list", F.transform("__pairs", followed)).withColumn("errors", errors)
    if len(native) < len(ids):
        df = _by_python(df, [i for i in ids if i in PYTHON], fields)
    df = df.withColumn("follow_all_instructions", F.forall("follow_instruction_list", lambda x: x))
    return df.select("pos", "key", "prompt", "instruction_id_list", "response", "follow_all_instructions", "follow_instruction_list", "errors")


def _by_python(df: DataFrame, ids: list[str], fields: list[str]) -> DataFrame:
    """Fills in the flags of checks that are Python functions."""
    open_ = df.select("pos", "__texts", F.posexplode("__pairs").alias("i", "p")).where(F.col("p.id").isin(*ids) & F.col("p.error").isNull())
    each = open_.select("pos", "i", "p", F.explode("__texts").alias("text"))
    ok = F.coalesce(solid(F.col("text")) & dispatch(F.col("text"), F.col("p.id"), F.col("p.args"), ids, fields=fields), F.lit(False))
    told = each.select("pos", "i", ok.alias("ok")).groupBy("pos", "i").agg(F.max("ok").alias("ok"))
    told = told.groupBy("pos").agg(F.map_from_entries(F.collect_list(F.struct("i", "ok"))).alias("__told"))
    flags = F.transform("follow_instruction_list", lambda ok, i: F.coalesce(ok, F.try_element_at("__told", i), F.lit(False)))
    return df.join(told, "pos", "left").withColumn("follow_instruction_list", flags)


def evaluate_strict(prompts: DataFrame, responses: DataFrame, mode: str = "failfast", only: list[str] | None = None) -> DataFrame:
    """pos, key, prompt, instruction_id_list, response, follow_all_instructions, follow_instruction_list, errors.

    The response is what stands after a thinking part. Without a response, or
    with a blank one, nothing is followed. ``only``: the ids that occur, where
    that is known.
    """
    rows = join_responses(prompts, responses).withColumn("response", F.coalesce(strip_thinking(F.col("response")), F.lit("")))
    return _evaluated(rows, F.array("response"), mode, only)


def evaluate_loose(prompts: DataFrame, responses: DataFrame, mode: str = "failfast", only: list[str] | None = None) -> DataFrame:
    """As evaluate_strict, but an instruction counts as followed if any of eight readings of the raw response follows it.

    failfast: a prompt without a response is an error.
    """
    rows = join_responses(prompts, responses)
    if mode == "failfast":
        rows = rows.withColumn("response", F.when(F.col("response").isNull(), F.raise_error(F.concat(F.lit("no response to "), "prompt"))).otherwise(F.col("response")))
    rows = rows.withColumn("response", F.coalesce("response", F.lit("")))
    return _evaluated(rows, F.array_distinct(loose_variants(F.col("response"))), mode, only)


def run(spark: SparkSession, prompts: str, responses: str, out: str, model: str, loose: bool = False, mode: str = "failfast", groups: str = "auto") -> dict:
    """Evaluate a file of responses, write the detail and the log under ``out``, and give the report and the paths.

    Responses are evaluated once: the verdicts are written, and the detail and
    the report are made of what was written.
    """
    from ..sources import jsonl
    from .metrics import report

    done = (evaluate_loose if loose else evaluate_strict)(jsonl.read_prompts(spark, prompts), jsonl.read_responses(spark, responses), mode)
    paths = jsonl.output_paths(out, model, responses, "loose" if loose else "strict")
    kept = f"{paths['detail']}-{uuid.uuid4().hex}"
    try:
        done.write.parquet(kept)
        verdicts = spark.read.schema(done.schema).parquet(kept)
        jsonl.write_detail(verdicts.drop("pos", "errors") if mode == "failfast" else verdicts.drop("pos"), paths["detail"])
        log = report(verdicts, groups)
        jsonl.write_log(spark, log, paths["log"])
    finally:
        jsonl.remove(spark, kept)
    return {"report": log, **paths}
