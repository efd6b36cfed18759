"""Domain views over the tables: transactions, access sets, accounts, operations, log entries, blobs and traces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..cluster import ship
from ..functions import hashing as H
from ..functions.ordered import numbered, previous

#: Operation codes.
READ, CREATE, WRITE, DELETE = 1, 2, 3, 4
#: Order keys to a numbering bucket.
KEY_BLOCK = 1 << 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cents(column: str) -> F.Column:
    return F.round(F.col(column) * 100).cast("bigint")


def tx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """height (month), idx (order within the block), tx_id, caller, value_cents."""
    rows = table(spark, sf_dir, "orders").select(
        (F.year("o_orderdate") * 12 + F.month("o_orderdate")).cast("bigint").alias("height"), F.col("o_orderkey").alias("tx_id"),
        F.concat(F.lit("c"), F.col("o_custkey")).alias("caller"), cents("o_totalprice").alias("value_cents"), F.floor(F.col("o_orderkey") / KEY_BLOCK).alias("block"),
    )
    return numbered(rows, ["height"], "block", ["tx_id"], "idx").drop("block")


def access(spark: SparkSession, sf_dir: str) -> DataFrame:
    """height, idx, k, w: the keys a transaction touches; w is 1 if it writes. A write covers a read."""
    t = tx(spark, sf_dir).select("height", "idx", "tx_id", "caller")
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("tx_id"), "l_partkey", "l_suppkey", "l_returnflag")
    touched = t.join(lines, "tx_id").select("height", "idx", F.explode(F.array(
        F.struct(F.concat(F.lit("p"), F.col("l_partkey")).alias("k"), (F.col("l_returnflag") == "R").cast("int").alias("w")),
        F.struct(F.concat(F.lit("s"), F.col("l_suppkey")).alias("k"), F.lit(0).alias("w")),
    )).alias("a")).select("height", "idx", "a.k", "a.w")
    own = t.select("height", "idx", F.col("caller").alias("k"), F.lit(1).alias("w"))
    return own.unionByName(touched).groupBy("height", "idx", "k").agg(F.max("w").alias("w"))


def account(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key, balance_cents of customers and suppliers."""
    c = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), F.col("c_custkey")).alias("key"), cents("c_acctbal").alias("balance_cents"))
    s = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey")).alias("key"), cents("s_acctbal").alias("balance_cents"))
    return c.unionByName(s)


def operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """height (hour), ts, event_id, key, op, value_cents.

    Every fifth error event deletes its key; what finds no value creates it, else writes; a delete that finds none reads.
    """
    rows = table(spark, sf_dir, "events").select(
        F.floor(F.unix_timestamp("ts") / 3600).cast("bigint").alias("height"), "ts", "event_id", F.concat_ws(":", "user_id", "event_type").alias("key"),
        ((F.col("event_type") == "error") & (F.col("event_id") % 5 == 0)).alias("removes"), cents("value").alias("value_cents"),
    )
    rows = previous(rows, ["key"], "height", ["ts", "event_id"], "removes", "removed")
    missing = F.coalesce("removed", F.lit(True))
    op = F.when(F.col("removes") & missing, READ).when(F.col("removes"), DELETE).when(missing, CREATE).otherwise(WRITE)
    return rows.select("height", "ts", "event_id", "key", op.alias("op"), "value_cents")


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The simplified log: shard, sn (dense within the shard), height, ts, event_id, key, key_hash, value, op, dead_sn (what it supersedes)."""
    rows = operations(spark, sf_dir).where(F.col("op") != READ).withColumn("key_hash", F.sha2("key", 256))
    rows = rows.withColumn("shard", H.shard(F.col("key_hash")))
    kept = numbered(rows.where(F.col("op") != DELETE), ["shard"], "height", ["ts", "event_id"], "sn")
    every = kept.unionByName(rows.where(F.col("op") == DELETE).withColumn("sn", F.lit(None).cast("bigint")))
    every = previous(every, ["key"], "height", ["ts", "event_id"], "sn", "dead_sn")
    return every.select("shard", "sn", "height", "ts", "event_id", "key", "key_hash", F.col("value_cents").cast("string").alias("value"), "op", "dead_sn")


def blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """address (20 bytes as hex), code and its hash, of pages."""
    return table(spark, sf_dir, "pages").select("page_id", F.substring(F.sha2("url", 256), 1, 40).alias("address"), F.col("html").alias("code"), F.sha2("html", 256).alias("code_hash"))


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tx_id and a JSON line: plain transfers, token calls of three selectors, calls that are too short, and malformed lines."""
    key = F.col("o_orderkey")
    address = lambda c: F.substring(F.sha2(c.cast("string"), 256), 1, 40)
    padded = lambda c: F.concat(F.lit("0" * 24), address(c))
    amount = F.lpad(F.lower(F.hex(cents("o_totalprice"))), 64, "0")
    source, target = F.col("o_custkey"), key + 1
    call = (
        F.when(key % 6 == 1, F.concat(F.lit("0xa9059cbb"), padded(target), amount))
        .when(key % 6 == 2, F.concat(F.lit("0x23b872dd"), padded(source), padded(target), amount))
        .when(key % 6 == 3, F.concat(F.lit("0x095EA7B3"), padded(target), amount))
        .when(key % 6 == 4, F.lit("0xa9059cbb00"))
        .otherwise(F.lit("0x"))
    )
    value = F.when(key % 7 == 0, F.lit("0x0")).otherwise(F.concat(F.lit("0x"), F.lower(F.hex(cents("o_totalprice")))))
    line = F.concat(
        F.lit('{"from":"'), address(source), F.lit('",'), F.when(key % 11 == 0, F.lit("")).otherwise(F.concat(F.lit('"to":"'), address(target), F.lit('",'))),
        F.lit('"value":"'), value, F.lit('","input":"'), call, F.lit('"'), F.when(key % 13 == 0, F.lit("")).otherwise(F.lit("}")),
    )
    return table(spark, sf_dir, "orders").select(key.alias("tx_id"), line.alias("line"))
