"""Tasks that arrive out of order are applied in order, each shard for itself.

State of a shard: the next task number, and the tasks that came early. A task that cannot be applied yet stays in the
state, however long; one below the next number was applied before and goes out as late, never lost. The state is as large
as what came early: the source's back-pressure (``blocks``) bounds it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "shard long, task long, value long, applied long, late boolean"
STATE = "next long, applied long, tasks array<long>, values array<long>"


def _apply(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    following, applied, tasks, values = state.get if state.exists else (0, 0, [], [])
    held = dict(zip(tasks or [], values or [], strict=True))
    rows = []
    for batch in batches:
        for task, value in batch[["task", "value"]].itertuples(index=False):
            if task < following or task in held:
                rows.append((int(key[0]), int(task), int(value), -1, True))
            else:
                held[int(task)] = int(value)
    while following in held:
        rows.append((int(key[0]), following, held.pop(following), applied, False))
        following, applied = following + 1, applied + 1
    state.update((following, applied, list(held), list(held.values())))
    yield pd.DataFrame(rows, columns=["shard", "task", "value", "applied", "late"])


def in_order(tasks: DataFrame) -> DataFrame:
    """(shard, task, value) in any order -> rows in the order of task numbers from 0; repeats come out as late."""
    return tasks.select("shard", "task", "value").groupBy("shard").applyInPandasWithState(_apply, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def blocks(spark: SparkSession, schema: str, path: str, in_flight: int = 2) -> DataFrame:
    """A stream of block files of Parquet, at most ``in_flight`` of them in a micro-batch: the next ones wait until those are
    committed. A query over it that is stopped, or runs with ``availableNow``, drains what it has begun."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", in_flight).parquet(path)


def commit_blocks(stream: DataFrame, folder: str, checkpoint: str):
    """Writes every micro-batch's rows and then one commit row a height; a height counts once its commit row is there.

    A batch that is run again writes the same folder again, so a lost driver leaves no half commit.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").partitionBy("shard").parquet(f"{folder}/data/batch={number}")
        rows = batch.groupBy("height").agg(F.count("*").alias("entries"), F.max("sn").alias("last_sn")).withColumn("batch", F.lit(number).cast("bigint"))
        rows.write.mode("overwrite").parquet(f"{folder}/commits/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def prunable(heights: DataFrame, every: int = 500, keep: int = 10) -> DataFrame:
    """Heights whose data may go: at each multiple of ``every`` all but the last ``keep`` before it."""
    newest = heights.agg(F.max("height").alias("newest")).select((F.floor(F.col("newest") / every) * every - keep).alias("bound"))
    return heights.join(F.broadcast(newest), F.col("height") < F.col("bound")).select("height")
