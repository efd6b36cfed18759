"""Admission of pending transactions: nonces, pending cost, the ordered outcome."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The pools that are consulted, in order.
POOLS = ("draining", "finalized", "proposed", "own")


def pending(pool: DataFrame, asked: DataFrame) -> DataFrame:
    """asked(caller, nonce) with the pool's pending cost of the caller, whether it holds that nonce, and the one before."""
    found = asked.join(pool.select("caller", F.col("nonce").alias("held"), "cost"), "caller", "left").groupBy("caller", "nonce").agg(
        F.coalesce(F.sum("cost"), F.lit(0)).cast("bigint").alias("cost"), F.coalesce(F.max(F.col("held") == F.col("nonce")), F.lit(False)).alias("duplicate"),
        F.coalesce(F.max(F.col("held") + 1 == F.col("nonce")), F.lit(False)).alias("continues"),
    )
    return found


def outcomes(rows: DataFrame) -> DataFrame:
    """rows with ``outcome``: the first rule that applies.

    Columns: nonce, access_len, balance (null: no account), account_nonce, cost, external, drained, and for each pool
    p of POOLS p_cost, p_duplicate, p_continues. The balance shrinks by each pool's pending cost in turn. The draining
    pool's costs and duplicates count only for external transactions while it is not drained.
    """
    left, out = F.col("balance"), F.when(F.col("nonce").isNull(), "NoNonce").when(F.col("access_len") != 4, "BadAccessList").when(F.col("balance").isNull(), "BalanceNotEnough")
    follows = F.col("account_nonce") == F.col("nonce") - 1
    for pool in POOLS:
        counts = F.col("external") & ~F.col("drained") if pool == "draining" else F.lit(True)
        left = left - F.when(counts, F.col(f"{pool}_cost")).otherwise(0)
        out = out.when(counts & F.col(f"{pool}_duplicate"), "Duplicate").when(counts & (left < F.col("cost")), "BalanceNotEnough")
        follows = follows | F.col(f"{pool}_continues")
    return rows.withColumn("outcome", out.when((F.col("nonce") > 0) & ~follows, "NotContinuous").otherwise("Added"))


def affordable(transactions: DataFrame, balances: DataFrame) -> DataFrame:
    """Transactions (caller, block, order, cost) with the cost pending before each and whether the balance covers both."""
    from ..functions.ordered import running_sum

    summed = running_sum(transactions, ["caller"], "block", ["order"], "cost", "before")
    return summed.join(balances.select(F.col("key").alias("caller"), "balance_cents"), "caller").withColumn("ok", F.col("before") + F.col("cost") <= F.col("balance_cents"))


def expected_nonces(transactions: DataFrame, start: str) -> DataFrame:
    """The nonce that each transaction of a caller must have: the first one's, counted on in order."""
    from ..functions.ordered import numbered

    return numbered(transactions, ["caller"], "block", ["order"], "_nth").withColumn("expected", F.col(start) + F.col("_nth")).drop("_nth")


def still_cached(uses: DataFrame, now: str, retention: int) -> DataFrame:
    """(key, last, kept): a key stays cached while fewer than ``retention`` heights have passed since its last use."""
    newest = uses.agg(F.max(now).alias("newest"))
    return uses.groupBy("key").agg(F.max(now).alias("last")).crossJoin(F.broadcast(newest)).select("key", "last", (F.col("newest") - F.col("last") < retention).alias("kept"))

