"""Metrics: histograms with nearest-rank percentiles, parallelism, snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The percentiles that are reported.
PERCENTS = {"p10": 10.0, "p20": 20.0, "p25": 25.0, "p30": 30.0, "p40": 40.0, "p50": 50.0, "p60": 60.0, "p70": 70.0, "p75": 75.0, "p80": 80.0, "p90": 90.0, "p95": 95.0, "p99": 99.0, "p999": 99.9, "p9999": 99.99}


#: Distinct values to a bucket of the running counts.
STEP = 4096


def histogram(samples: DataFrame) -> DataFrame:
    """(name, label, value): count, min, max, mean (rounded) and, for each label of PERCENTS, the sample of rank round(p / 100 * (n - 1)).

    Equal values are counted first; ranks are running counts over distinct values, in buckets of ``STEP`` consecutive
    numbers, so that no task sorts all values of a name. Samples are (name, value) with integer values.
    """
    from ..functions.ordered import running_sum

    counts = samples.groupBy("name", "value").agg(F.count("*").alias("c")).withColumn("bucket", F.floor(F.col("value") / STEP))
    ranked = running_sum(counts, ["name"], "bucket", ["value"], "c", "first").withColumn("last", F.col("first") + F.col("c") - 1)
    totals = counts.groupBy("name").agg(F.sum("c").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"), F.sum(F.col("c") * F.col("value")).alias("all"))
    labels = F.explode(F.array(*[F.struct(F.lit(k).alias("label"), F.lit(p).alias("p")) for k, p in PERCENTS.items()]))
    wanted = totals.select("name", "n", labels.alias("l")).select("name", F.col("l.label").alias("label"), F.round(F.col("l.p") / 100.0 * (F.col("n") - 1)).cast("bigint").alias("rank"))
    ranks = wanted.join(ranked, "name").where("rank BETWEEN first AND last").select("name", "label", "value")
    whole = {"count": F.col("n").cast("bigint"), "min": F.col("lo"), "max": F.col("hi"), "mean": F.round(F.col("all") / F.col("n")).cast("bigint")}
    ends = totals.select("name", F.explode(F.array(*[F.struct(F.lit(k).alias("label"), v.alias("value")) for k, v in whole.items()])).alias("e")).select("name", "e.label", "e.value")
    return ends.unionByName(ranks)


def parallelism(frames: DataFrame) -> DataFrame:
    """frames, tasks and tasks per frame of each block."""
    return frames.groupBy("height").agg(F.countDistinct("flush_seq").alias("frames"), F.count("*").alias("tasks")).withColumn("per_frame", F.round(F.col("tasks") / F.col("frames"), 6))


def contiguous_complete(batches: DataFrame, group: str, batch: str, complete: str) -> DataFrame:
    """(group, upto): how many batches from the start are complete without a gap."""
    return batches.groupBy(group).agg(F.coalesce(F.min(F.when(~F.col(complete), F.col(batch))), F.max(batch) + 1).cast("bigint").alias("upto"))
