"""Queries over generated workloads and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hashing as H
from ..operators import metrics, workload as W
from ..sources import views as V
from .registry import query
from .sqltext import TX

_SEED = 1234 & 0x1FFF | 1
#: As many draws as there are customers.
_COUNT = "(SELECT count(*) FROM customer)"


def _register(name: str, bits: int, seed: int) -> str:
    return f"{name}(i, state) AS (SELECT 0::BIGINT, {seed}::UBIGINT UNION ALL SELECT i + 1, CASE WHEN state % 2 = 0 THEN state >> 1 ELSE xor(state, ({W.taps(bits)})::UBIGINT)::UBIGINT >> 1 END FROM {name} WHERE i < {_COUNT})"


@query(f"WITH RECURSIVE {_register('r', 13, _SEED)} SELECT i, state::BIGINT AS state FROM r WHERE i > 0")
def shift_register(spark: SparkSession, d: str) -> DataFrame:
    """States of a 13-bit register."""
    return W.register(spark, 13, _SEED, V.table(spark, d, "customer").count())


@query(f"WITH RECURSIVE {_register('r', 13, _SEED)}, {_register('w', 63, _SEED)} SELECT r.i, CAST(r.state * 8 + w.state % 8 - 8 + 1 AS BIGINT) AS account FROM r JOIN w ON w.i = r.i WHERE r.i > 0")
def account_draws(spark: SparkSession, d: str) -> DataFrame:
    """Account numbers from a group that a 13-bit register draws and a member that a 63-bit one draws."""
    count = V.table(spark, d, "customer").count()
    return W.accounts(W.register(spark, 13, _SEED, count), W.register(spark, 63, _SEED, count), 8)


def _uniform(key: str, salt: str) -> str:
    return f"CAST(('0x' || substr(md5({key} || '{salt}'), 1, 8)) AS BIGINT) % 2147483648"


_K = "o_orderkey"
_COLD = lambda salt: f"({_uniform(_K, salt)}) % 9900 + 101"
_TRANSFERS = f"t AS (SELECT o_orderkey, CASE WHEN ({_uniform(_K, 'p')}) % 1000 < 250 THEN ({_uniform(_K, 'h')}) % 100 + 1 ELSE {_COLD('s')} END AS src, {_COLD('d')} AS dst FROM orders)"


def _transfers(spark: SparkSession, d: str) -> DataFrame:
    return W.transfers(V.table(spark, d, "orders"), "o_orderkey", 10_000, 100, 250)


@query(f"WITH {_TRANSFERS} SELECT o_orderkey, src, dst FROM t")
def contended_transfers(spark: SparkSession, d: str) -> DataFrame:
    """A quarter of all transfers start at one of 100 hot accounts."""
    return _transfers(spark, d)


@query(f"WITH {_TRANSFERS} SELECT o_orderkey, CASE WHEN ({_uniform(_K, 'f')}) % 1000 < 100 THEN 256 ELSE src END AS src, CASE WHEN ({_uniform(_K, 'f')}) % 1000 < 100 THEN 257 ELSE dst END AS dst FROM t")
def fixed_pair_transfers(spark: SparkSession, d: str) -> DataFrame:
    """A tenth are one fixed pair."""
    return W.fixed_pair(_transfers(spark, d), "o_orderkey", 100).select("o_orderkey", F.col("src").cast("bigint").alias("src"), F.col("dst").cast("bigint").alias("dst"))


@query(f"WITH {_TRANSFERS} SELECT o_orderkey, CASE WHEN ({_uniform(_K, 'n')}) % 1000 < 500 THEN src % 20 + 1 ELSE src END AS src, CASE WHEN ({_uniform(_K, 'n')}) % 1000 < 500 THEN dst % 20 + 1 ELSE dst END AS dst FROM t")
def hot_transfers(spark: SparkSession, d: str) -> DataFrame:
    """Half are folded onto 20 hot accounts."""
    return W.hot_modulus(_transfers(spark, d), "o_orderkey", 500, 20)


@query(f"WITH {_TRANSFERS} SELECT min(least(src, dst)) AS low, max(greatest(src, dst)) AS high, count(*) AS transfers FROM t")
def account_range(spark: SparkSession, d: str) -> DataFrame:
    """Smallest and largest account of a workload."""
    return _transfers(spark, d).agg(F.min(F.least("src", "dst")).alias("low"), F.max(F.greatest("src", "dst")).alias("high"), F.count("*").alias("transfers"))


@query(f"WITH {_TRANSFERS}, r AS (SELECT o_orderkey, src, dst, row_number() OVER (ORDER BY o_orderkey) AS n FROM t) SELECT o_orderkey, src, dst FROM r WHERE n <= 100")
def bounded_batch(spark: SparkSession, d: str) -> DataFrame:
    """A batch of the first transfers, in order."""
    return _transfers(spark, d).orderBy("o_orderkey").limit(100)


_LE6 = lambda x: "lower(" + " || ".join(f"substr(lpad(to_hex({x}), 12, '0'), {11 - 2 * k}, 2)" for k in range(6)) + ")"


@query(f"WITH {_TRANSFERS} SELECT o_orderkey, {_LE6('src')} || repeat('0', 12) || {_LE6('dst')} || repeat('0', 12) AS record, src, dst FROM t")
def workload_records(spark: SparkSession, d: str) -> DataFrame:
    """Transfers as 24-byte records and read from them again."""
    gap = F.unhex(F.lit("0" * 12))
    rows = _transfers(spark, d).select("o_orderkey", F.concat(H.little_endian(F.col("src"), 6), gap, H.little_endian(F.col("dst"), 6), gap).alias("record"))
    read = lambda at: H.from_little_endian(F.substring("record", at, F.lit(6)), 6)
    return rows.select("o_orderkey", F.lower(F.hex("record")).alias("record"), read(F.lit(1)).alias("src"), read(F.lit(13)).alias("dst"))


def _samples(spark: SparkSession, d: str) -> DataFrame:
    return V.table(spark, d, "events").select(F.col("event_type").alias("name"), V.cents("value").alias("value"))


@query("WITH s AS (SELECT event_type AS name, CAST(round(value * 100) AS BIGINT) AS value FROM events), r AS (SELECT name, value, row_number() OVER (PARTITION BY name ORDER BY value) - 1 AS i FROM s), n AS (SELECT name, count(*) AS c, min(value) AS lo, max(value) AS hi, CAST(sum(value) AS BIGINT) AS t FROM s GROUP BY name), p(label, q) AS (VALUES " + ", ".join(f"('{k}', {v}::DOUBLE)" for k, v in metrics.PERCENTS.items()) + ") SELECT n.name, p.label, r.value FROM n, p, r WHERE r.name = n.name AND r.i = CAST(round(q / 100.0::DOUBLE * (c - 1)) AS BIGINT) UNION ALL SELECT name, 'count', c FROM n UNION ALL SELECT name, 'min', lo FROM n UNION ALL SELECT name, 'max', hi FROM n UNION ALL SELECT name, 'mean', CAST(round(t / c::DOUBLE) AS BIGINT) FROM n")
def histograms(spark: SparkSession, d: str) -> DataFrame:
    """A10: count, least, greatest, mean and nearest-rank percentiles of samples."""
    return metrics.histogram(_samples(spark, d))


@query("""SELECT event_type AS name, '{"name":"' || event_type || '","count":' || count(*) || ',"total":' || CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) || '}' AS line FROM events GROUP BY event_type""")
def metrics_json(spark: SparkSession, d: str) -> DataFrame:
    """A snapshot of counters as JSON lines."""
    rows = _samples(spark, d).groupBy("name").agg(F.count("*").alias("count"), F.sum("value").alias("total"))
    return rows.select("name", F.to_json(F.struct("name", "count", "total")).alias("line"))


@query(f"WITH {TX} SELECT height, count(*) AS txns, CAST(sum(value_cents) AS BIGINT) AS moved, count(DISTINCT caller) AS callers FROM tx GROUP BY height")
def block_totals(spark: SparkSession, d: str) -> DataFrame:
    """Transactions, moved value and callers of each block."""
    return V.tx(spark, d).groupBy("height").agg(F.count("*").alias("txns"), F.sum("value_cents").alias("moved"), F.countDistinct("caller").alias("callers"))
