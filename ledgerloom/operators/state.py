"""State from operations: last writer wins, layered reads, classification of changes, sorted change sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import hashing as H
from ..sources.views import CREATE, DELETE, READ, WRITE


def last_writes(operations: DataFrame) -> DataFrame:
    """(key, value, first_value, ops): the last value of each key that was created, written or deleted, and the first; reads change nothing."""
    order = F.struct("ts", "event_id")
    return operations.where(F.col("op") != READ).groupBy("key").agg(
        F.max_by("value_cents", order).alias("value"), F.min_by("value_cents", order).alias("first_value"), F.max_by("op", order).alias("last_op"), F.count("*").alias("ops"),
    )


def live(state: DataFrame) -> DataFrame:
    """What a store holds after the operations: deletes leave nothing."""
    return state.where(F.col("last_op") != DELETE)


def layered(keys: DataFrame, layers: list[DataFrame], default: F.Column | None = None) -> DataFrame:
    """(key, value, layer): the value from the first layer (key, value) that has the key; else the default and null."""
    out = keys.select("key").distinct()
    for n, layer in enumerate(layers):
        out = out.join(layer.select("key", F.col("value").alias(f"v{n}"), F.lit(n).alias(f"n{n}")), "key", "left")
    value = F.coalesce(*[F.col(f"v{n}") for n in range(len(layers))])
    which = F.coalesce(*[F.col(f"n{n}") for n in range(len(layers))])
    return out.select("key", (F.coalesce(value, default) if default is not None else value).alias("value"), which.alias("layer"))


def account_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Operations that turn ``before`` into ``after``, both (key, value, is_caller): equal values need none, a caller is always written."""
    both = after.select("key", F.col("value").alias("new"), "is_caller").join(before.select("key", F.col("value").alias("old")), "key", "left")
    op = F.when(F.col("is_caller"), WRITE).when(F.col("old").isNull(), CREATE).when(F.col("old") == F.col("new"), F.lit(None)).otherwise(WRITE)
    return both.withColumn("op", op).where("op IS NOT NULL").select("key", "op", "old", "new")


def slot_changes(slots: DataFrame) -> DataFrame:
    """(key, old, new) that differ -> op: from zero creates, to zero deletes, else writes."""
    op = F.when(F.col("old") == 0, CREATE).when(F.col("new") == 0, DELETE).otherwise(WRITE)
    return slots.where("old <> new").withColumn("op", op)


def net_dust(changes: DataFrame, group: str, cost_of_create: int) -> DataFrame:
    """(group, cost, reward, net): what creations cost and deletions give back."""
    cost = F.coalesce(F.sum(F.when(F.col("op") == CREATE, F.lit(cost_of_create))), F.lit(0))
    reward = F.coalesce(F.sum(F.when(F.col("op") == DELETE, F.col("old"))), F.lit(0))
    return changes.groupBy(group).agg(cost.cast("bigint").alias("cost"), reward.cast("bigint").alias("reward")).withColumn("net", F.col("cost") - F.col("reward"))


def with_shard(changes: DataFrame) -> DataFrame:
    return changes.withColumn("key_hash", F.sha2("key", 256)).withColumn("shard", H.shard(F.col("key_hash")))


def change_order(changes: DataFrame) -> list[F.Column]:
    """Shard, key hash, operation; what is left in the order of arrival."""
    return [F.col("shard"), F.col("key_hash"), F.col("op"), F.col("ts"), F.col("event_id")]


def checked_writes(rows: DataFrame, most_key_bytes: int = 255) -> DataFrame:
    """Writes (key, data) with a verdict: EmptyValue, KeyTooLong or ok. Nothing is dropped."""
    verdict = F.when(F.octet_length("data") == 0, "EmptyValue").when(F.octet_length("key") > most_key_bytes, "KeyTooLong").otherwise("ok")
    return rows.withColumn("verdict", verdict)
