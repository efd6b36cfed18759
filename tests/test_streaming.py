"""Tasks that arrive in any order are applied in order; blocks are committed whole."""

import random

from ledgerloom.cluster import ship
from ledgerloom.streaming.ordered import blocks, commit_blocks, in_order, prunable


def test_out_of_order(spark, tmp_path):
    ship(spark)
    rng = random.Random(2)
    tasks = [(s, t, 100 * s + t) for s in range(3) for t in range(40)]
    rng.shuffle(tasks)
    tasks += [(0, 5, 999)]
    for k in range(0, len(tasks), 25):
        spark.createDataFrame(tasks[k : k + 25], "shard long, task long, value long").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("shard long, task long, value long").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    seen = []
    q = in_order(stream).writeStream.foreachBatch(lambda df, n: seen.extend(df.collect())).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    for s in range(3):
        mine = [r for r in seen if r.shard == s and not r.late]
        assert [r.task for r in mine] == list(range(40)) and [r.applied for r in mine] == list(range(40))
    assert sum(r.late for r in seen) == 1


def test_block_commits(spark, tmp_path):
    rows = [(h, s, h * 10 + s) for h in range(4) for s in range(3)]
    spark.createDataFrame(rows, "height long, shard int, sn long").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("height long, shard int, sn long").parquet(f"{tmp_path}/in")
    commit_blocks(stream, f"{tmp_path}/out", f"{tmp_path}/c").awaitTermination()
    commits = spark.read.parquet(f"{tmp_path}/out/commits")
    assert {(r.height, r.entries, r.last_sn) for r in commits.collect()} == {(h, 3, h * 10 + 2) for h in range(4)}
    assert spark.read.parquet(f"{tmp_path}/out/data").count() == 12


def test_pruning(spark):
    heights = spark.createDataFrame([(h,) for h in range(0, 1100, 100)], "height long")
    assert sorted(r.height for r in prunable(heights).collect()) == list(range(0, 990, 100))


def test_two_blocks_in_flight(spark, tmp_path):
    for h in range(5):
        spark.createDataFrame([(h, 0, h)], "height long, shard int, sn long").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    seen = []
    q = blocks(spark, "height long, shard int, sn long", f"{tmp_path}/in").writeStream.foreachBatch(lambda df, n: seen.append(df.count())).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sum(seen) == 5 and max(seen) <= 2  # what was begun is drained
