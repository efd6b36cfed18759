"""Queries over state, change sets, layered reads and admission."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import admission, state as S
from ..sources import views as V
from .registry import query
from .sqltext import ACCOUNT, OPS, TX


@query(f"""WITH {OPS} SELECT key, arg_max(value_cents, (ts, event_id)) AS value, arg_min(value_cents, (ts, event_id)) AS first_value, arg_max(op, (ts, event_id)) AS last_op, count(*) AS ops FROM ops WHERE op <> 1 GROUP BY key""")
def last_writes(spark: SparkSession, d: str) -> DataFrame:
    """Last value, first value and last operation of every key."""
    return S.last_writes(V.operations(spark, d))


@query(f"""WITH {OPS}, s AS (SELECT key, arg_max(value_cents, (ts, event_id)) AS value, arg_max(op, (ts, event_id)) AS last_op FROM ops WHERE op <> 1 GROUP BY key) SELECT key, value FROM s WHERE last_op <> 4""")
def live_state(spark: SparkSession, d: str) -> DataFrame:
    """What the store holds in the end."""
    return S.live(S.last_writes(V.operations(spark, d))).select("key", "value")


@query(f"""WITH {OPS} SELECT height, key, op, count(*) AS n FROM ops GROUP BY ALL""")
def operation_kinds(spark: SparkSession, d: str) -> DataFrame:
    """The classified operations of every block and key."""
    return V.operations(spark, d).groupBy("height", "key", "op").agg(F.count("*").alias("n"))


@query(f"""WITH {OPS}, h AS (SELECT *, sha256(key) AS key_hash, CAST(('0x' || substr(sha256(key), 1, 1)) AS INT) AS shard FROM ops)
SELECT height, event_id, shard, op, CAST(row_number() OVER (PARTITION BY height ORDER BY shard, key_hash, op, ts, event_id) - 1 AS BIGINT) AS place FROM h""")
def change_set_order(spark: SparkSession, d: str) -> DataFrame:
    """The place of every operation in its block's sorted change set."""
    from pyspark.sql import Window

    rows = S.with_shard(V.operations(spark, d))
    return rows.select("height", "event_id", "shard", "op", (F.row_number().over(Window.partitionBy("height").orderBy(*S.change_order(rows))) - 1).cast("bigint").alias("place"))


@query(f"""WITH {OPS}, h AS (SELECT *, CAST(('0x' || substr(sha256(key), 1, 1)) AS INT) AS shard FROM ops), c AS (SELECT height, shard, count(*) AS n, bool_or(op IN (2, 4)) AS creates_or_deletes FROM h GROUP BY ALL)
SELECT height, shard, n, creates_or_deletes, CAST(sum(n) OVER (PARTITION BY height ORDER BY shard) - n AS BIGINT) AS start FROM c""")
def shard_slices(spark: SparkSession, d: str) -> DataFrame:
    """A3, A4, O3: operations of each shard in a block, where its slice starts, and whether it creates or deletes."""
    from pyspark.sql import Window

    counts = S.with_shard(V.operations(spark, d)).groupBy("height", "shard").agg(F.count("*").alias("n"), F.max(F.col("op").isin(2, 4)).alias("creates_or_deletes"))
    return counts.withColumn("start", (F.sum("n").over(Window.partitionBy("height").orderBy("shard")) - F.col("n")).cast("bigint"))


_BLOCKS = f"""{OPS}, top AS (SELECT max(height) AS t FROM ops), w AS (SELECT * FROM ops, top WHERE op <> 1),
cur AS (SELECT key, arg_max(value_cents, (ts, event_id)) AS value FROM w WHERE height = t GROUP BY key),
prev AS (SELECT key, arg_max(value_cents, (ts, event_id)) AS value FROM w WHERE height = t - 1 GROUP BY key),
store AS (SELECT key, arg_max(value_cents, (ts, event_id)) AS value FROM w WHERE height < t - 1 GROUP BY key)"""


def _layers(spark: SparkSession, d: str) -> tuple[DataFrame, list[DataFrame]]:
    rows = V.operations(spark, d)
    top = rows.agg(F.max("height").alias("t"))
    timed = rows.where("op <> 1").crossJoin(F.broadcast(top))
    layers = [S.last_writes(timed.where(c)).select("key", "value") for c in ("height = t", "height = t - 1", "height < t - 1")]
    return rows, layers


@query(f"""WITH {_BLOCKS} SELECT k.key, coalesce(cur.value, prev.value, store.value) AS value, CASE WHEN cur.value IS NOT NULL THEN 0 WHEN prev.value IS NOT NULL THEN 1 WHEN store.value IS NOT NULL THEN 2 END AS layer
FROM (SELECT DISTINCT key FROM ops) k LEFT JOIN cur USING (key) LEFT JOIN prev USING (key) LEFT JOIN store USING (key)""")
def layered_reads(spark: SparkSession, d: str) -> DataFrame:
    """The value from the current block, else the one before, else the store."""
    rows, layers = _layers(spark, d)
    return S.layered(rows, layers)


@query(f"""WITH {_BLOCKS}, asked AS (SELECT DISTINCT key FROM ops UNION SELECT 'none:' || user_id FROM events WHERE event_id % 50 = 0) SELECT k.key, coalesce(cur.value, store.value, 0) AS value FROM asked k LEFT JOIN cur USING (key) LEFT JOIN store USING (key)""")
def layered_slots(spark: SparkSession, d: str) -> DataFrame:
    """The same for slots, an absent one being zero."""
    rows, (current, _, store) = _layers(spark, d)
    extra = V.table(spark, d, "events").where("event_id % 50 = 0").select(F.concat(F.lit("none:"), F.col("user_id")).alias("key"))
    return S.layered(rows.select("key").unionByName(extra), [current, store], F.lit(0).cast("bigint")).select("key", "value")


_TRANSFER = f"""{TX}, {ACCOUNT}, spent AS (SELECT caller AS key, sum(value_cents) AS v FROM tx WHERE height = (SELECT max(height) FROM tx) GROUP BY ALL),
paid AS (SELECT 's' || l_suppkey AS key, sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS v FROM tx JOIN lineitem ON l_orderkey = tx_id WHERE height = (SELECT max(height) FROM tx) AND l_suppkey % 3 = 0 GROUP BY ALL),
after AS (SELECT a.key, balance_cents - coalesce(s.v, 0) + coalesce(p.v, 0) AS value, s.v IS NOT NULL AS is_caller FROM account a LEFT JOIN spent s USING (key) LEFT JOIN paid p USING (key)
  UNION ALL SELECT 'new:' || p_partkey, p_size, false FROM part WHERE p_partkey % 10 = 0)"""


@query(f"""WITH {_TRANSFER} SELECT after.key, CASE WHEN is_caller THEN 3 WHEN b.key IS NULL THEN 2 ELSE 3 END AS op, CAST(coalesce(b.balance_cents, 0) AS BIGINT) AS "old", CAST(after.value AS BIGINT) AS "new"
FROM after LEFT JOIN account b USING (key) WHERE is_caller OR b.key IS NULL OR b.balance_cents <> after.value""")
def account_changes(spark: SparkSession, d: str) -> DataFrame:
    """The operations that a block's transfers make of accounts before and after."""
    t, before = V.tx(spark, d), V.account(spark, d)
    last = t.join(F.broadcast(t.agg(F.max("height").alias("height"))), "height", "left_semi")
    spent = last.groupBy(F.col("caller").alias("key")).agg(F.sum("value_cents").alias("spent"))
    lines = V.table(spark, d, "lineitem").where("l_suppkey % 3 = 0").select(F.col("l_orderkey").alias("tx_id"), "l_suppkey", V.cents("l_extendedprice").alias("v"))
    paid = last.join(lines, "tx_id").groupBy(F.concat(F.lit("s"), F.col("l_suppkey")).alias("key")).agg(F.sum("v").alias("paid"))
    zero = F.lit(0)
    after = before.join(spent, "key", "left").join(paid, "key", "left").select("key", (F.col("balance_cents") - F.coalesce("spent", zero) + F.coalesce("paid", zero)).alias("value"), F.col("spent").isNotNull().alias("is_caller"))
    made = V.table(spark, d, "part").where("p_partkey % 10 = 0").select(F.concat(F.lit("new:"), F.col("p_partkey")).alias("key"), F.col("p_size").cast("bigint").alias("value"), F.lit(False).alias("is_caller"))
    changes = S.account_changes(before.select("key", F.col("balance_cents").alias("value")), after.unionByName(made))
    return changes.withColumn("old", F.coalesce("old", F.lit(0).cast("bigint")))


_SLOTS = """slots AS (SELECT l_orderkey, l_suppkey || ':' || l_partkey || ':' || l_linenumber AS key, CASE WHEN l_returnflag = 'N' THEN 0 ELSE CAST(l_quantity AS BIGINT) END AS "old", CASE WHEN l_linestatus = 'F' THEN 0 ELSE CAST(l_quantity AS BIGINT) + l_linenumber - 3 END AS "new" FROM lineitem)"""


def _slots(spark: SparkSession, d: str) -> DataFrame:
    quantity = F.col("l_quantity").cast("bigint")
    return V.table(spark, d, "lineitem").select(
        "l_orderkey", F.concat_ws(":", "l_suppkey", "l_partkey", "l_linenumber").alias("key"), F.when(F.col("l_returnflag") == "N", 0).otherwise(quantity).alias("old"),
        F.when(F.col("l_linestatus") == "F", 0).otherwise(quantity + F.col("l_linenumber") - 3).alias("new"),
    )


@query(f"""WITH {_SLOTS} SELECT l_orderkey, key, "old", "new", CASE WHEN "old" = 0 THEN 2 WHEN "new" = 0 THEN 4 ELSE 3 END AS op FROM slots WHERE "old" <> "new" """)
def slot_changes(spark: SparkSession, d: str) -> DataFrame:
    """Slot operations from old and new values."""
    return S.slot_changes(_slots(spark, d))


@query(f"""WITH {_SLOTS} SELECT l_orderkey, CAST(sum(CASE WHEN "old" = 0 THEN 20 ELSE 0 END) AS BIGINT) AS cost, CAST(sum(CASE WHEN "old" <> 0 AND "new" = 0 THEN "old" ELSE 0 END) AS BIGINT) AS reward,
  CAST(sum(CASE WHEN "old" = 0 THEN 20 ELSE 0 END) - sum(CASE WHEN "old" <> 0 AND "new" = 0 THEN "old" ELSE 0 END) AS BIGINT) AS net FROM slots WHERE "old" <> "new" GROUP BY l_orderkey""")
def dust_fees(spark: SparkSession, d: str) -> DataFrame:
    """Creation cost, deletion reward and net fee of each transaction."""
    return S.net_dust(S.slot_changes(_slots(spark, d)), "l_orderkey", 20)


@query(f"""WITH {TX}, {ACCOUNT} SELECT tx_id, caller, value_cents FROM tx JOIN account ON key = caller WHERE balance_cents * 100 >= value_cents + 21000""")
def transaction_checks(spark: SparkSession, d: str) -> DataFrame:
    """Transactions whose caller exists and can pay value and limit (balances in hundredths)."""
    a = V.account(spark, d).select(F.col("key").alias("caller"), "balance_cents")
    return V.tx(spark, d).join(a, "caller").where(F.col("balance_cents") * 100 >= F.col("value_cents") + 21000).select("tx_id", "caller", "value_cents")


_QUEUE = """queue AS (SELECT o_custkey AS caller, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS BIGINT) AS nonce, CAST(round(o_totalprice * 100) AS BIGINT) AS cost FROM orders)"""


def _queue(spark: SparkSession, d: str) -> DataFrame:
    from ..functions.ordered import numbered

    rows = V.table(spark, d, "orders").select(F.col("o_custkey").alias("caller"), "o_orderkey", V.cents("o_totalprice").alias("cost"), F.floor(F.col("o_orderkey") / V.KEY_BLOCK).alias("block"))
    return numbered(rows, ["caller"], "block", ["o_orderkey"], "nonce")


@query(f"""WITH {_QUEUE}, pool AS (SELECT * FROM queue WHERE o_orderkey % 3 <> 0), asked AS (SELECT DISTINCT caller, nonce FROM queue)
SELECT a.caller, a.nonce, CAST(coalesce(sum(p.cost), 0) AS BIGINT) AS cost, coalesce(bool_or(p.nonce = a.nonce), false) AS duplicate, coalesce(bool_or(p.nonce + 1 = a.nonce), false) AS continues
FROM asked a LEFT JOIN pool p ON p.caller = a.caller GROUP BY ALL""")
def pending_of_caller(spark: SparkSession, d: str) -> DataFrame:
    """A caller's pending cost and what its pool says of a nonce."""
    q = _queue(spark, d)
    return admission.pending(q.where("o_orderkey % 3 <> 0"), q.select("caller", "nonce").distinct())


def _pool_sql(name: str, rule: str) -> str:
    return f"{name}_p AS (SELECT a.caller, a.nonce AS n, coalesce(sum(p.cost), 0) AS cost, coalesce(bool_or(p.nonce = a.nonce), false) AS dup, coalesce(bool_or(p.nonce + 1 = a.nonce), false) AS cont FROM (SELECT DISTINCT caller, nonce FROM asked) a LEFT JOIN (SELECT * FROM queue WHERE {rule}) p ON p.caller = a.caller GROUP BY ALL)"


_RULES = {"draining": "o_orderkey % 7 = 1", "finalized": "o_orderkey % 7 = 2", "proposed": "o_orderkey % 7 = 3", "own": "o_orderkey % 7 = 4"}


@query(f"""WITH {_QUEUE}, {ACCOUNT}, asked AS (SELECT caller, o_orderkey, nonce + o_orderkey % 2 AS nonce, cost, CASE WHEN o_orderkey % 31 = 0 THEN 3 ELSE 4 END AS access_len, o_orderkey % 4 <> 0 AS external, o_orderkey % 8 = 0 AS drained FROM queue),
{', '.join(_pool_sql(n, r) for n, r in _RULES.items())},
j AS (SELECT a.*, CASE WHEN b.key IS NULL THEN NULL ELSE b.balance_cents * 1000 END AS balance, a.caller % 3 AS account_nonce, {', '.join(f'{n}_p.cost AS {n}_c, {n}_p.dup AS {n}_d, {n}_p.cont AS {n}_t' for n in _RULES)}
  FROM asked a LEFT JOIN account b ON b.key = 'c' || a.caller {' '.join(f'JOIN {n}_p ON {n}_p.caller = a.caller AND {n}_p.n = a.nonce' for n in _RULES)}),
e AS (SELECT *, external AND NOT drained AS dr, balance - CASE WHEN external AND NOT drained THEN draining_c ELSE 0 END AS l1 FROM j)
SELECT o_orderkey, nonce, CASE WHEN nonce IS NULL THEN 'NoNonce' WHEN access_len <> 4 THEN 'BadAccessList' WHEN balance IS NULL THEN 'BalanceNotEnough' WHEN dr AND draining_d THEN 'Duplicate' WHEN dr AND l1 < cost THEN 'BalanceNotEnough'
  WHEN finalized_d THEN 'Duplicate' WHEN l1 - finalized_c < cost THEN 'BalanceNotEnough' WHEN proposed_d THEN 'Duplicate' WHEN l1 - finalized_c - proposed_c < cost THEN 'BalanceNotEnough' WHEN own_d THEN 'Duplicate' WHEN l1 - finalized_c - proposed_c - own_c < cost THEN 'BalanceNotEnough'
  WHEN nonce > 0 AND NOT (account_nonce = nonce - 1 OR draining_t OR finalized_t OR proposed_t OR own_t) THEN 'NotContinuous' ELSE 'Added' END AS outcome FROM e""")
def admission_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """The outcome of offering transactions to pools that hold others."""
    q = _queue(spark, d)
    key = F.col("o_orderkey")
    asked = q.select("caller", "o_orderkey", (F.col("nonce") + key % 2).alias("nonce"), "cost", F.when(key % 31 == 0, 3).otherwise(4).alias("access_len"), (key % 4 != 0).alias("external"), (key % 8 == 0).alias("drained"), (F.col("caller") % 3).alias("account_nonce"))
    balances = V.account(spark, d).select(F.col("key").alias("_k"), (F.col("balance_cents") * 1000).alias("balance"))
    rows = asked.join(balances, F.concat(F.lit("c"), F.col("caller")) == F.col("_k"), "left").drop("_k")
    wanted = asked.select("caller", "nonce").distinct()
    for name, rule in _RULES.items():
        pool = admission.pending(q.where(rule), wanted).select("caller", "nonce", F.col("cost").alias(f"{name}_cost"), F.col("duplicate").alias(f"{name}_duplicate"), F.col("continues").alias(f"{name}_continues"))
        rows = rows.join(pool, ["caller", "nonce"])
    return admission.outcomes(rows).select("o_orderkey", "nonce", "outcome")


@query(f"""WITH {_QUEUE}, {ACCOUNT}, s AS (SELECT caller, o_orderkey, cost, CAST(sum(cost) OVER (PARTITION BY caller ORDER BY o_orderkey) - cost AS BIGINT) AS "before" FROM queue)
SELECT caller, o_orderkey, "before", "before" + cost <= balance_cents * 1 AS ok FROM s JOIN account ON key = 'c' || caller""")
def running_affordability(spark: SparkSession, d: str) -> DataFrame:
    """Cost pending before each transaction of a caller, and whether the balance covers both."""
    q = _queue(spark, d).select(F.concat(F.lit("c"), F.col("caller")).alias("caller"), F.col("caller").alias("number"), F.col("o_orderkey").alias("order"), "cost", "block")
    return admission.affordable(q, V.account(spark, d)).select(F.col("number").alias("caller"), F.col("order").alias("o_orderkey"), "before", "ok")


@query(f"""WITH {_QUEUE} SELECT caller, o_orderkey, caller % 3 + CAST(row_number() OVER (PARTITION BY caller ORDER BY o_orderkey) - 1 AS BIGINT) AS expected FROM queue""")
def expected_nonces(spark: SparkSession, d: str) -> DataFrame:
    """The nonce each transaction must have in its batch."""
    q = _queue(spark, d).drop("nonce").withColumnRenamed("o_orderkey", "order").withColumn("start", F.col("caller") % 3)
    return admission.expected_nonces(q, "start").select("caller", F.col("order").alias("o_orderkey"), "expected")


@query("""WITH u AS (SELECT user_id || ':' || event_type AS key, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS h FROM events), m AS (SELECT max(h) AS newest FROM u)
SELECT key, max(h) AS "last", newest - max(h) < 24 AS kept FROM u, m GROUP BY key, newest""")
def cache_retention(spark: SparkSession, d: str) -> DataFrame:
    """Keys that were used within the last 24 heights."""
    uses = V.operations(spark, d).select("key", "height")
    return admission.still_cached(uses, "height", 24)


@query(f"""WITH {TX}, a AS (SELECT height, sum(value_cents) AS fee FROM tx GROUP BY height), {ACCOUNT}
SELECT height, CAST(fee AS BIGINT) AS fee, CASE WHEN fee = 0 THEN 0 WHEN b.key IS NULL THEN 2 ELSE 3 END AS op, CAST(coalesce(balance_cents, 0) + fee AS BIGINT) AS balance FROM a LEFT JOIN account b ON b.key = 's' || height % 200""")
def coinbase_credit(spark: SparkSession, d: str) -> DataFrame:
    """A block's fees credited to its beneficiary: none, a new account, or an old one."""
    fees = V.tx(spark, d).groupBy("height").agg(F.sum("value_cents").alias("fee"))
    both = fees.join(V.account(spark, d), F.concat(F.lit("s"), F.col("height") % 200) == F.col("key"), "left")
    return both.select("height", "fee", F.when(F.col("fee") == 0, 0).when(F.col("key").isNull(), 2).otherwise(3).alias("op"), (F.coalesce("balance_cents", F.lit(0)) + F.col("fee")).cast("bigint").alias("balance"))


@query(f"""WITH {OPS} SELECT height, event_id, key, CASE WHEN value_cents % 10 = 0 THEN 'EmptyValue' WHEN length(key) > 9 THEN 'KeyTooLong' ELSE 'ok' END AS verdict FROM ops WHERE op IN (2, 3)""")
def write_errors(spark: SparkSession, d: str) -> DataFrame:
    """Error rows instead of panics: writes without a value (ending in 0 here), keys over the limit (9 bytes here)."""
    rows = V.operations(spark, d).where("op IN (2, 3)").withColumn("data", F.when(F.col("value_cents") % 10 == 0, F.lit("")).otherwise(F.col("value_cents").cast("string")))
    return S.checked_writes(rows, 9).select("height", "event_id", "key", "verdict")
