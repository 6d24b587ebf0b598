"""Work on rows that costs too much to do twice, in batches that are kept one by one.

Rows are put in small files first; a stream that ends when it has read them all
takes some files at a time, works on them and appends what comes of it. Each
batch is a job of its own, so what it appended stays when a later one fails or
the run is killed, and the next run leaves out whatever has been kept.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame

from ..sources import jsonl

#: Rows in a batch.
BATCH_ROWS = 4096


def shared_out(workers: int, tasks: int) -> tuple[int, int]:
    """(tasks, requests at a time in each), together no more than ``workers`` and no more tasks than there are places for."""
    tasks = max(1, min(workers, tasks))
    return tasks, max(1, workers // tasks)


def in_batches(rows: DataFrame, work: Callable[[DataFrame], DataFrame], out: str, tasks: int = 8, batch_rows: int = BATCH_ROWS) -> None:
    """Append ``work`` of ``rows`` to the JSON lines at ``out``, about ``batch_rows`` rows at a time, each batch in ``tasks`` tasks.

    ``work`` must not depend on other rows. No rows append nothing.
    """
    spark, stage = rows.sparkSession, f"{out.rstrip('/')}-todo-{uuid.uuid4().hex}"
    try:
        rows.write.option("maxRecordsPerFile", max(1, batch_rows // tasks)).parquet(f"{stage}/rows")
        stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", tasks).parquet(f"{stage}/rows")

        def batch(part: DataFrame, number: int) -> None:
            jsonl.append_lines(work(part.repartition(tasks)), out)

        stream.writeStream.foreachBatch(batch).option("checkpointLocation", f"{stage}/kept").trigger(availableNow=True).start().awaitTermination()
    finally:
        jsonl.remove(spark, stage)
