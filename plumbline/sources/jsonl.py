"""Prompts, responses and records from JSON lines, and the tables that go back to them."""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.checkers import KWARGS, kwargs_schema

PROMPTS = T.StructType([
    T.StructField("key", T.StringType()),
    T.StructField("prompt", T.StringType()),
    T.StructField("instruction_id_list", T.ArrayType(T.StringType())),
    T.StructField("kwargs", T.ArrayType(KWARGS)),
])
RESPONSES = T.StructType([T.StructField(c, T.StringType()) for c in ("key", "prompt", "response")])
JUDGEMENT = "validity-checking"


def prompts_schema() -> T.StructType:
    """PROMPTS, with the arguments of users' checks that are registered now."""
    return T.StructType([*PROMPTS.fields[:-1], T.StructField("kwargs", T.ArrayType(kwargs_schema()))])


def read_lines(spark: SparkSession, path: str, schema: T.StructType | None = None, mode: str = "FAILFAST") -> DataFrame:
    """Records with ``pos``, a long that rises with the place in the input: by file, then by line.

    Blank lines are skipped. ``mode`` is Spark's: FAILFAST or DROPMALFORMED.
    """
    reader = spark.read.option("mode", mode)
    df = (reader.schema(schema) if schema else reader).json(path)
    names = df.columns
    # Scans deal splits out by size; a split begins a whole number of least sizes or more behind the one before it, so files' sizes
    # tell where each begins among all, and the rows of a split come in order.
    sizes = spark._jsparkSession.sessionState().conf()
    least = min(sizes.filesMaxPartitionBytes(), sizes.filesOpenCostInBytes())
    split = lambda size: F.floor(size / F.lit(least)).cast("long")
    files = spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_path").alias("__file"), split(F.col("_metadata.file_size")).alias("__splits"))  # a list: no file is read
    before = F.sum(F.col("__splits") + 1).over(Window.orderBy("__file")) - F.col("__splits") - 1
    files = files.select("__file", before.alias("__before"))
    df = df.select("*", F.col("_metadata.file_path").alias("__file"), split(F.col("_metadata.file_block_start")).alias("__split"), (F.monotonically_increasing_id() % (1 << 33)).alias("__row"))
    return df.join(F.broadcast(files) if len(df.inputFiles()) < 10_000 else files, "__file").select(((F.col("__before") + F.col("__split")) * (1 << 33) + F.col("__row")).alias("pos"), *names)


def read_prompts(spark: SparkSession, path: str) -> DataFrame:
    """pos, key, prompt, instruction_id_list, kwargs; other fields are dropped."""
    return read_lines(spark, path, prompts_schema())


def latest_responses(responses: DataFrame) -> DataFrame:
    """prompt, response: of several responses to one prompt, the last."""
    return responses.groupBy("prompt").agg(F.max_by("response", "pos").alias("response"))


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    return latest_responses(read_lines(spark, path, RESPONSES))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Records with all their fields."""
    return read_lines(spark, path)


def read_prompt_records(spark: SparkSession, path: str) -> DataFrame:
    """Prompts with all their fields: the known ones by their types, even where a file has only empty arguments, others as they are."""
    known = prompts_schema()
    others = [f for f in spark.read.json(path).schema if f.name not in known.names]
    return read_lines(spark, path, T.StructType([*known.fields, *others]))


def completed_keys(spark: SparkSession, path: str) -> DataFrame:
    """Keys of the lines that parse, once each."""
    return spark.read.schema(RESPONSES).option("mode", "DROPMALFORMED").json(path).select("key").where("key is not null").distinct()


def read_prompt_table(spark: SparkSession, path: str) -> DataFrame:
    """Prompts that were kept as Parquet."""
    return spark.read.parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


# --- sinks


def remove(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def write_detail(outputs: DataFrame, path: str, files: int | None = None) -> None:
    """Overwrite ``path`` with JSON lines, fields in order of name; an error where there are none, and what was there stays.

    The rows are counted as they are written, so they are computed once. One
    file only where ``files`` is 1: then one task writes all.
    """
    spark, seen, fresh = outputs.sparkSession, Observation(), f"{path}-{uuid.uuid4().hex}"
    df = outputs.observe(seen, F.count(F.lit(1)).alias("n")).select(*sorted(outputs.columns))
    try:
        (df.coalesce(files) if files else df).write.json(fresh)
        if not seen.get["n"]:
            raise ValueError("no outputs to write")
        remove(spark, path)
        source, target = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (fresh, path))
        source.getFileSystem(spark._jsc.hadoopConfiguration()).rename(source, target)
    finally:
        remove(spark, fresh)


def append_lines(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_variants(df: DataFrame, path: str, mode: str = "append") -> None:
    """Variants append to what is there, or overwrite it."""
    if mode not in ("append", "overwrite"):
        raise ValueError(f"unknown mode {mode!r}")
    df.write.mode(mode).json(path)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """One small file in any store that Spark reaches."""
    jvm, target = spark._jvm, spark._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def write_log(spark: SparkSession, report: dict, path: str) -> None:
    write_text(spark, path, json.dumps(report, indent=2, ensure_ascii=False))


def write_judged(judged: DataFrame, annotated: str, valid: str, keep: Column) -> None:
    """All rows to one place, those that ``keep`` holds for to another. Rows are judged once: the second place is filled from the first."""
    judged.write.mode("overwrite").json(annotated)
    judged.sparkSession.read.schema(judged.schema).json(annotated).where(keep).write.mode("overwrite").json(valid)


def output_paths(out: str, model: str, responses: str, kind: str = "strict") -> dict[str, str]:
    """Where an evaluation's detail and log go, by the name of its responses."""
    core = re.sub(r"\.jsonl$", "", responses.rstrip("/").rsplit("/", 1)[-1]).replace("input_response_data_", "")
    base = f"{out.rstrip('/')}/stat_{model}"
    return {"detail": f"{base}/raw/{core}_eval_results_{kind}_detail.jsonl", "log": f"{base}/log/{core}_eval_results_{kind}_log.json"}
