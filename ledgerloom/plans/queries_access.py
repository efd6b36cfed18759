"""Queries over access sets, conflicts, precedence and frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import bits, hashing as H
from ..operators import access as A
from ..operators import metrics, schedule
from ..shared import cut
from ..sources import views as V
from .registry import query
from .sqltext import ACCESS, ACCOUNT, TX


@query(f"""WITH {ACCESS}
SELECT t.height, t.idx, CAST(CASE WHEN s = 0 THEN -1 ELSE coalesce(m, CASE WHEN stop = 0 THEN 0 ELSE stop - 1 END) END AS BIGINT) AS eei
FROM (SELECT height, idx, (idx // 64) * 64 AS s, CASE WHEN idx > 128 THEN idx - 128 ELSE 0 END AS stop FROM tx) t
LEFT JOIN (SELECT a.height AS h, a.idx AS i, max(b.idx) AS m FROM access a JOIN access b ON a.height = b.height AND a.k = b.k
  WHERE (a.w = 1 OR b.w = 1) AND b.idx < (a.idx // 64) * 64 AND b.idx >= CASE WHEN a.idx > 128 THEN a.idx - 128 ELSE 0 END GROUP BY ALL) c
ON c.h = t.height AND c.i = t.idx""")
def precedence(spark: SparkSession, d: str) -> DataFrame:
    """The earliest execution index of every transaction."""
    return A.precedence(A.standing_frames(V.tx(spark, d).select("height", "idx")), V.access(spark, d))


@query(f"""WITH {ACCESS} SELECT DISTINCT a.height, a.idx AS i, b.idx AS j FROM access a JOIN access b
ON a.height = b.height AND a.k = b.k AND b.idx < a.idx WHERE a.w = 1 OR b.w = 1""")
def conflict_join(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of transactions that share a key which one of them writes."""
    return A.collisions(V.access(spark, d))


@query(f"""WITH {ACCESS}, task AS (SELECT height, idx // 4 AS task, k, w FROM access)
SELECT height, task, coalesce(string_agg(k, ',' ORDER BY k) FILTER (w = 0), '') AS reads, coalesce(string_agg(k, ',' ORDER BY k) FILTER (w = 1), '') AS writes FROM task GROUP BY ALL""")
def task_access_sets(spark: SparkSession, d: str) -> DataFrame:
    """The sorted access sets of tasks of four transactions, duplicates kept."""
    rows = V.access(spark, d).withColumn("task", F.floor(F.col("idx") / 4).cast("bigint"))
    return A.set_of_group(rows, ["height", "task"])


@query(f"""WITH {ACCESS}, short AS (SELECT height, idx, w, substr(sha256(k), 1, 20) AS h FROM access),
n AS (SELECT height, idx, w, h, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS hi, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS lo FROM short)
SELECT height, idx, h, CAST(lo & 2047 AS BIGINT) AS b0, CAST((lo >> 11) & 2047 AS BIGINT) AS b1, CAST(((lo >> 22) | (hi << 10)) & 2047 AS BIGINT) AS b2,
  CAST((hi >> 1) & 2047 AS BIGINT) AS b3, CAST((hi >> 12) & 2047 AS BIGINT) AS b4 FROM n""")
def bloom_probe_bits(spark: SparkSession, d: str) -> DataFrame:
    """P5: the five bit positions of every accessed key's short hash."""
    rows = V.access(spark, d).select("height", "idx", H.short_hash(F.col("k")).alias("h"))
    return rows.select("height", "idx", "h", *[p.cast("bigint").alias(f"b{n}") for n, p in enumerate(bits.probes(F.col("h")))])


#: Frames of the Bloom queries, of 16 items, so that large blocks have more than a word of them.
_NUMBERS = "n AS (SELECT height, idx, idx // 16 AS frame, w, k, CAST('0x' || substr(sha256(k), 1, 8) AS BIGINT) AS hi, CAST('0x' || substr(sha256(k), 9, 8) AS BIGINT) AS lo FROM access)"
_BITS = "unnest([lo & 2047, (lo >> 11) & 2047, ((lo >> 22) | (hi << 10)) & 2047, (hi >> 1) & 2047, (hi >> 12) & 2047]) AS bit"
#: A frame's bit within its word, the highest being the sign.
_ONE = "CASE WHEN frame % 64 = 63 THEN (-9223372036854775808)::BIGINT ELSE 1::BIGINT << (frame % 64)::INT END"


def _framed(spark: SparkSession, d: str) -> DataFrame:
    return V.access(spark, d).select("height", "idx", "w", F.floor(F.col("idx") / 16).cast("int").alias("frame"), H.short_hash(F.col("k")).alias("h"))


@query(f"""WITH {ACCESS}, {_NUMBERS}, bits AS (SELECT height, frame, w, {_BITS} FROM n)
SELECT height, CAST(frame // 64 AS INT) AS word, w, CAST(bit AS BIGINT) AS bit, CAST(bit_or({_ONE}) AS BIGINT) AS frames FROM bits GROUP BY height, frame // 64, w, bit""")
def bloom_frames(spark: SparkSession, d: str) -> DataFrame:
    """For each Bloom bit the masks of frames (of 16 transactions, 64 frames a word) that have it set."""
    return A.frame_masks(_framed(spark, d))


@query(f"""WITH {ACCESS}, {_NUMBERS}, flat AS (SELECT height, idx, frame, w, k, {_BITS} FROM n), masks AS (SELECT height, w, bit, frame // 64 AS word, bit_or({_ONE}) AS frames FROM flat GROUP BY ALL),
probe AS (SELECT f.height, f.idx, f.k, m.w AS theirs, m.word, bit_and(m.frames) AS frames FROM flat f JOIN masks m ON m.height = f.height AND m.bit = f.bit WHERE f.w = 1 OR m.w = 1 GROUP BY ALL HAVING count(*) = 5)
SELECT height, idx, CAST(word AS INT) AS word, CAST(bit_or(frames) AS BIGINT) AS mask FROM probe WHERE frames <> 0 GROUP BY height, idx, word""")
def bloom_dependencies(spark: SparkSession, d: str) -> DataFrame:
    """Which frames an access set may collide with: its reads against writes, its writes against both."""
    return A.dependency_masks(_framed(spark, d))


@query(f"""WITH {ACCESS}, touched AS (SELECT height, idx, k, CASE WHEN idx % 10 = 0 THEN 1 ELSE w END AS w FROM access)
SELECT t.height, t.idx, t.k, t.w FROM (SELECT * FROM touched WHERE w = 1) t ANTI JOIN (SELECT height, idx, k FROM access WHERE w = 1) a ON a.height = t.height AND a.idx = t.idx AND a.k = t.k""".replace("access AS (", "access AS MATERIALIZED (", 1))
def write_enforcement(spark: SparkSession, d: str) -> DataFrame:
    """P10: writes of keys that were only declared for reading."""
    declared = V.access(spark, d)
    touched = declared.withColumn("w", F.when(F.col("idx") % 10 == 0, 1).otherwise(F.col("w")))
    return A.undeclared(touched, declared, writes_only=True)


@query(f"""WITH {ACCESS}, declared AS (SELECT * FROM access WHERE NOT (substr(k, 1, 1) = 's' AND idx % 7 = 0))
SELECT a.height, a.idx, a.k, a.w FROM access a ANTI JOIN declared d ON d.height = a.height AND d.idx = a.idx AND d.k = a.k""".replace("access AS (", "access AS MATERIALIZED (", 1))
def access_enforcement(spark: SparkSession, d: str) -> DataFrame:
    """Touched keys that were not declared at all."""
    touched = V.access(spark, d)
    return A.undeclared(touched, touched.where(~((F.substring("k", 1, 1) == "s") & (F.col("idx") % 7 == 0))))


@query(f"""WITH {ACCESS}, kinds AS (SELECT height, k, max(w) AS w, count(*) AS n FROM access GROUP BY ALL)
SELECT height, CAST(count(*) FILTER (w = 1) AS BIGINT) AS exclusive, CAST(count(*) FILTER (w = 0) AS BIGINT) AS only_read, CAST(sum(n) AS BIGINT) AS touched FROM kinds GROUP BY height""")
def touched_and_exclusive(spark: SparkSession, d: str) -> DataFrame:
    """Keys of a block that someone writes, and those that are read minus those."""
    kinds = V.access(spark, d).groupBy("height", "k").agg(F.max("w").alias("w"), F.count("*").alias("n"))
    return kinds.groupBy("height").agg(F.count(F.when(F.col("w") == 1, 1)).alias("exclusive"), F.count(F.when(F.col("w") == 0, 1)).alias("only_read"), F.sum("n").alias("touched"))


@query(f"""WITH {ACCESS} SELECT a.height, a.idx, CAST(max(CASE WHEN a.k = t.caller THEN 1 ELSE 0 END) AS BIGINT) AS reads_caller,
  CAST(count(*) FILTER (a.w = 1) AS BIGINT) AS write_keys, bool_or(a.w = 1 AND a.k = 'p7') AS writes_p7 FROM access a JOIN tx t USING (height, idx) GROUP BY ALL""")
def access_membership(spark: SparkSession, d: str) -> DataFrame:
    """membership of keys in a transaction's read and write sets."""
    both = V.access(spark, d).join(V.tx(spark, d).select("height", "idx", "caller"), ["height", "idx"])
    return both.groupBy("height", "idx").agg(
        F.max((F.col("k") == F.col("caller")).cast("bigint")).alias("reads_caller"), F.count(F.when(F.col("w") == 1, 1)).alias("write_keys"), F.max((F.col("w") == 1) & (F.col("k") == "p7")).alias("writes_p7"),
    )


@query(f"""WITH {TX} SELECT height, CAST(('0x' || right(sha256(caller), 2)) AS INT) % 4 AS lane, idx, CAST((row_number() OVER (PARTITION BY height, CAST(('0x' || right(sha256(caller), 2)) AS INT) % 4 ORDER BY idx) - 1) // 4 AS BIGINT) AS task FROM tx""")
def caller_lanes(spark: SparkSession, d: str) -> DataFrame:
    """Transactions routed to four lanes by the caller's suffix, and in each lane tasks of four."""
    from ..functions.ordered import numbered

    rows = V.tx(spark, d).withColumn("lane", (H.hex_int(F.right(F.sha2("caller", 256), F.lit(2))) % 4).cast("int")).withColumn("block", F.floor(F.col("idx") / 4096))
    return numbered(rows, ["height", "lane"], "block", ["idx"], "nth").select("height", "lane", "idx", F.floor(F.col("nth") / 4).cast("bigint").alias("task"))


def _tasks(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Tasks of four transactions of a caller's lane, and their access sets, the task's number as idx."""
    lane = (H.hex_int(F.right(F.sha2("caller", 256), F.lit(2))) % 4).cast("int")
    placed, sets = schedule.tasks_of(V.tx(spark, d).select("height", "idx", lane.alias("lane")), V.access(spark, d))
    return placed, sets.withColumnRenamed("task", "idx")


def _packed_tasks(spark: SparkSession, d: str) -> DataFrame:
    return schedule.packed(_tasks(spark, d)[1])


@query()
def frame_packing(spark: SparkSession, d: str) -> DataFrame:
    """First-fit frames of tasks over exact key sets."""
    return _packed_tasks(spark, d)


@query()
def frame_packing_bloom(spark: SparkSession, d: str) -> DataFrame:
    """G1 with Bloom bits instead of keys: some collisions are none."""
    return schedule.packed(_tasks(spark, d)[1], bloom=True)


@query()
def frame_packing_single(spark: SparkSession, d: str) -> DataFrame:
    """One frame, which leaves at the first collision and keeps the order."""
    return schedule.packed(_tasks(spark, d)[1], frames=1)


@query(f"""WITH {TX}, lanes AS (SELECT height, CAST(('0x' || right(sha256(caller), 2)) AS INT) % 4 AS lane, row_number() OVER (PARTITION BY height, CAST(('0x' || right(sha256(caller), 2)) AS INT) % 4 ORDER BY idx) - 1 AS nth FROM tx)
SELECT CAST(0 AS BIGINT) AS collisions, CAST(0 AS BIGINT) AS misplaced, CAST(0 AS BIGINT) AS lost, count(DISTINCT (height, lane, nth // 4)) AS tasks FROM lanes""")
def frame_invariants(spark: SparkSession, d: str) -> DataFrame:
    """No two tasks of a frame collide, numbering follows flush order, every task is in one frame: of all tasks none are wrong."""
    rows = _tasks(spark, d)[1]
    frames = cut(schedule.packed(rows), "frames")
    again = schedule.flush_order(frames.select("height", "idx", "flush_seq", "pos")).select("height", "idx", F.col("out_idx").alias("o"), F.col("task_out_start").alias("s"))
    wrong = frames.join(again, ["height", "idx"]).where("o <> out_idx OR s <> task_out_start").agg(F.count("*").alias("misplaced"))
    every = rows.select("height", "idx").distinct().join(frames.groupBy("height", "idx").count(), ["height", "idx"], "left")
    lost = every.agg(F.count(F.when(F.col("count").isNull() | (F.col("count") != 1), 1)).alias("lost"), F.count("*").alias("tasks"))
    return schedule.frame_collisions(frames, rows).agg(F.count("*").alias("collisions")).crossJoin(wrong).crossJoin(lost)


@query()
def packed_precedence(spark: SparkSession, d: str) -> DataFrame:
    """J12 over packed frames: the earliest execution index of every task by its place in the output."""
    rows = _tasks(spark, d)[1]
    frames = cut(schedule.packed(rows), "frames")
    items = frames.select("height", F.col("out_idx").alias("idx"), F.col("task_out_start").alias("start"))
    placed = rows.join(frames.select("height", "idx", "out_idx"), ["height", "idx"]).select("height", F.col("out_idx").alias("idx"), "k", "w")
    return A.precedence(items, placed)


@query(f"""WITH {TX}, lanes AS (SELECT height, CAST(('0x' || right(sha256(caller), 2)) AS INT) % 4 AS lane, row_number() OVER (PARTITION BY height, CAST(('0x' || right(sha256(caller), 2)) AS INT) % 4 ORDER BY idx) - 1 AS nth FROM tx),
t AS (SELECT height, count(DISTINCT (lane, nth // 4)) AS tasks, count(*) AS txns FROM lanes GROUP BY height) SELECT height, tasks, txns, CAST(0 AS BIGINT) AS late, CAST(0 AS BIGINT) AS wrong FROM t""")
def precedence_invariants(spark: SparkSession, d: str) -> DataFrame:
    """J12 over packed frames: no task waits for itself, a later one, or one within its reach of its own frame (late), and
    every one waits for its nearest collider outside its frame, or without one for the task before its reach (wrong),
    found by joining holders of keys."""
    placed, rows = _tasks(spark, d)
    frames = cut(schedule.packed(rows), "frames")
    items = cut(frames.select("height", F.col("out_idx").alias("idx"), F.col("task_out_start").alias("start")), "frames")
    access = cut(rows.join(frames.select("height", "idx", "out_idx"), ["height", "idx"]).select("height", F.col("out_idx").alias("idx"), "k", "w"), "frames")
    checked = A.precedence_faults(A.precedence(items, access), items, access)
    return checked.join(placed.groupBy("height").agg(F.count("*").alias("txns")), "height").select("height", "tasks", "txns", "late", "wrong")


@query(f"""WITH {TX}, frames AS (SELECT height, idx, idx // 64 AS flush_seq, idx % 64 AS pos FROM tx)
SELECT height, idx, CAST(row_number() OVER (PARTITION BY height ORDER BY flush_seq, pos) - 1 AS BIGINT) AS out_idx, CAST(flush_seq * 64 AS BIGINT) AS task_out_start FROM frames""")
def frame_flush_order(spark: SparkSession, d: str) -> DataFrame:
    """Consecutive output numbers of flushed frames and the number at each flush's start."""
    frames = V.tx(spark, d).select("height", "idx", F.floor(F.col("idx") / 64).alias("flush_seq"), (F.col("idx") % 64).alias("pos"))
    return schedule.flush_order(frames).select("height", "idx", "out_idx", "task_out_start")


@query()
def frame_parallelism(spark: SparkSession, d: str) -> DataFrame:
    """Packed frames, tasks and transactions of every block, and tasks and transactions per frame."""
    placed, rows = _tasks(spark, d)
    txns = placed.groupBy("height").agg(F.count("*").alias("txns"))
    return metrics.parallelism(schedule.packed(rows)).join(txns, "height").withColumn("txns_per_frame", F.round(F.col("txns") / F.col("frames"), 6))


@query(f"""WITH {TX}, t AS (SELECT height, idx, NOT (tx_id % 97 = 0) AS done FROM tx)
SELECT height, CAST(coalesce(min(idx) FILTER (NOT done) - 1, max(idx)) AS BIGINT) AS upto FROM t GROUP BY height""")
def done_prefix(spark: SparkSession, d: str) -> DataFrame:
    """The largest index up to which all of a block is executed."""
    return schedule.done_prefix(V.tx(spark, d).withColumn("done", F.col("tx_id") % 97 != 0), "height", "idx", "done")


@query(f"""WITH {TX}, b AS (SELECT height, idx // 32 AS batch, bool_and(tx_id % 97 <> 0) AS complete FROM tx GROUP BY ALL)
SELECT height, CAST(coalesce(min(batch) FILTER (NOT complete), max(batch) + 1) AS BIGINT) AS upto FROM b GROUP BY height""")
def warmed_batches(spark: SparkSession, d: str) -> DataFrame:
    """Batches of a block that are complete without a gap from the start."""
    batches = V.tx(spark, d).groupBy("height", F.floor(F.col("idx") / 32).alias("batch")).agg(F.min(F.col("tx_id") % 97 != 0).alias("complete"))
    return metrics.contiguous_complete(batches, "height", "batch", "complete")


@query(f"""WITH {ACCESS}, waits AS (SELECT t.height, t.idx, coalesce(max(b.idx), -1) AS eei FROM tx t LEFT JOIN access a ON a.height = t.height AND a.idx = t.idx
  LEFT JOIN access b ON b.height = a.height AND b.k = a.k AND (a.w = 1 OR b.w = 1) AND b.idx < (a.idx // 64) * 64 AND b.idx >= greatest(a.idx - 128, 0) GROUP BY ALL)
SELECT height, CAST(eei AS BIGINT) AS eei, count(*) AS released, string_agg(idx, ',' ORDER BY idx) AS items FROM waits GROUP BY height, eei""")
def ignition_lists(spark: SparkSession, d: str) -> DataFrame:
    """The items that each finished item releases."""
    items = A.standing_frames(V.tx(spark, d).select("height", "idx"))
    framed = V.access(spark, d).join(items, ["height", "idx"])
    waits = items.join(A.latest_colliders(framed), ["height", "idx"], "left").withColumn("eei", F.coalesce("m", F.lit(-1).cast("bigint")))
    return waits.groupBy("height", "eei").agg(F.count("*").alias("released"), F.array_join(F.sort_array(F.collect_list("idx")), ",").alias("items"))


@query(f"""WITH {ACCESS}, h AS (SELECT DISTINCT height, k, idx // 16 AS frame FROM access WHERE w = 1), busy AS (SELECT DISTINCT a.height, a.idx, h.frame FROM access a JOIN h ON h.height = a.height AND h.k = a.k),
r AS (SELECT height, idx, frame, row_number() OVER (PARTITION BY height, idx ORDER BY frame) - 1 AS nth FROM busy)
SELECT t.height, t.idx, CAST(coalesce(max(r.frame) FILTER (r.frame = r.nth) + 1, 0) AS BIGINT) AS frame FROM tx t LEFT JOIN r ON r.height = t.height AND r.idx = t.idx GROUP BY t.height, t.idx""")
def first_open_frame(spark: SparkSession, d: str) -> DataFrame:
    """The lowest zero bit over the words of an item's conflict mask (frames of 16 items)."""
    rows = V.access(spark, d).withColumn("frame", F.floor(F.col("idx") / 16))
    masks = rows.where("w = 1").groupBy("height", "k", F.shiftright("frame", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(frame & 63 AS int)))").alias("frames"))
    mask = rows.join(masks, ["height", "k"]).groupBy("height", "idx", "word").agg(F.bit_or("frames").alias("mask"))
    # of words without a gap from the first on, those that are full
    nth = F.row_number().over(Window.partitionBy("height", "idx").orderBy("word")) - 1
    gaps = mask.withColumn("nth", nth).withColumn("open", F.when(F.col("word") != F.col("nth"), F.col("nth") * 64).when(F.col("mask") != -1, F.col("word") * 64 + F.expr("bit_count(((~mask) & (mask + 1)) - 1)")))
    first = gaps.groupBy("height", "idx").agg(F.coalesce(F.min("open"), F.count("*") * 64).alias("frame"))
    return V.tx(spark, d).select("height", "idx").join(first, ["height", "idx"], "left").select("height", "idx", F.coalesce("frame", F.lit(0)).cast("bigint").alias("frame"))


@query()
def mempool_drain(spark: SparkSession, d: str) -> DataFrame:
    """What becomes of a block's pools when it is final: every third transaction was included, every eleventh came meanwhile."""
    rows = V.access(spark, d)
    late = (F.col("idx") % 11) == 10
    return schedule.finalized(rows.where(~late), rows.where(late), rows.where(F.col("idx") % 3 == 0).select("height", "idx").distinct())


@query(f"""WITH {ACCESS}, t AS (SELECT height, idx, 'c' || (o_custkey + 1) AS target, o_orderkey % 7 <> 0 AS moves, caller FROM tx JOIN orders ON o_orderkey = tx_id), s AS (SELECT height, idx, 'p' || l_partkey AS k, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS w FROM tx JOIN lineitem ON l_orderkey = tx_id)
SELECT height, idx, k, max(w) AS w FROM (SELECT height, idx, caller AS k, 1 AS w FROM t UNION ALL SELECT height, idx, target, CASE WHEN moves THEN 1 ELSE 0 END FROM t UNION ALL SELECT height, idx, k, w FROM s) GROUP BY height, idx, k""")
def derived_access(spark: SparkSession, d: str) -> DataFrame:
    """Access sets of transactions by rule, from caller, target, moved value and declared slots."""
    moved = V.table(spark, d, "orders").select(F.col("o_orderkey").alias("tx_id"), F.concat(F.lit("c"), F.col("o_custkey") + 1).alias("target"), (F.col("o_orderkey") % 7 != 0).alias("moves"))
    t = V.tx(spark, d).select("height", "idx", "tx_id", "caller").join(moved, "tx_id")
    lines = V.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("tx_id"), F.concat(F.lit("p"), F.col("l_partkey")).alias("k"), (F.col("l_returnflag") == "R").cast("int").alias("w"))
    return A.derived(t, t.select("height", "idx", "tx_id").join(lines, "tx_id"))


@query(f"""WITH RECURSIVE {TX}, {ACCOUNT}, lanes AS (SELECT height, idx, caller, value_cents AS amount, CAST(('0x' || right(sha256(caller), 2)) AS INT) % 4 AS lane, row_number() OVER (PARTITION BY height, CAST(('0x' || right(sha256(caller), 2)) AS INT) % 4 ORDER BY idx) - 1 AS nth FROM tx),
q AS (SELECT height, idx, caller, amount, CAST(nth // 4 * 4 + lane AS BIGINT) AS task, row_number() OVER (PARTITION BY height, nth // 4 * 4 + lane, caller ORDER BY idx) AS n, coalesce(balance_cents * 60, 0) AS balance FROM lanes LEFT JOIN account ON key = caller),
run AS (SELECT height, task, idx, caller, n, amount <= balance AS ok, balance AS "before", CASE WHEN amount <= balance THEN balance - amount ELSE balance END AS rest FROM q WHERE n = 1
UNION ALL SELECT q.height, q.task, q.idx, q.caller, q.n, q.amount <= run.rest, run.rest, CASE WHEN q.amount <= run.rest THEN run.rest - q.amount ELSE run.rest END FROM run JOIN q ON q.height = run.height AND q.task = run.task AND q.caller = run.caller AND q.n = run.n + 1)
SELECT height, task, idx, ok, CAST("before" AS BIGINT) AS "before" FROM run""")
def executed_tasks(spark: SparkSession, d: str) -> DataFrame:
    """The transactions of every task executed in order: who could pay, and from what balance."""
    t = V.tx(spark, d).select("height", "idx", "caller", F.col("value_cents").alias("amount"))
    transfers = t.join(_tasks(spark, d)[0], ["height", "idx"])
    balances = t.select("height", "caller").distinct().join(V.account(spark, d).select(F.col("key").alias("caller"), (F.col("balance_cents") * 60).alias("balance")), "caller")
    return schedule.in_order(transfers, balances).select("height", "task", "idx", "ok", "before")


@query(f"""WITH {TX}, got AS (SELECT height, CAST(('0x' || right(sha256(caller), 2)) AS INT) % 4 AS lane, count(*) AS n FROM tx WHERE tx_id % 211 <> 0 GROUP BY ALL),
told AS (SELECT height, CAST(('0x' || right(sha256(caller), 2)) AS INT) % 4 AS lane, count(*) AS n FROM tx GROUP BY ALL)
SELECT told.height, count(*) AS lanes, CAST(sum(told.n) AS BIGINT) AS announced, CAST(sum(coalesce(got.n, 0)) AS BIGINT) AS received, bool_and(coalesce(got.n, 0) = told.n) AS complete FROM told LEFT JOIN got ON got.height = told.height AND got.lane = told.lane GROUP BY told.height""")
def block_completeness(spark: SparkSession, d: str) -> DataFrame:
    """A block is complete when every lane has delivered what its end marker announces."""
    lane = (H.hex_int(F.right(F.sha2("caller", 256), F.lit(2))) % 4).cast("int")
    per_lane = V.tx(spark, d).groupBy("height", lane.alias("lane")).agg(F.count("*").alias("told"), F.count(F.when(F.col("tx_id") % 211 != 0, 1)).alias("got"))
    return per_lane.groupBy("height").agg(F.count("*").alias("lanes"), F.sum("told").alias("announced"), F.sum("got").alias("received"), F.min(F.col("told") == F.col("got")).alias("complete"))
