"""Evaluation of prompts as their files arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..operators.evaluate import evaluate_strict
from ..sources.jsonl import prompts_schema


def watch_prompts(spark: SparkSession, folder: str, responses: DataFrame, out: str, checkpoint: str, **kw) -> StreamingQuery:
    """Evaluate each new file of prompts in ``folder`` against ``responses(prompt, response)``, once, appending to ``out``.

    A batch overwrites its own part of the output, so one that runs again after
    a failure leaves no row twice.
    """

    def batch(prompts: DataFrame, number: int) -> None:
        rows = prompts.withColumn("pos", F.monotonically_increasing_id())
        evaluate_strict(rows, responses, **kw).write.mode("overwrite").json(f"{out}/batch={number}")

    stream = spark.readStream.schema(prompts_schema()).json(folder)
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
