"""Workload generation: shift-register sequences, account draws, and contention by hot keys.

A register is a sequence, so its states are made by jumps: the state after n steps is a product of bit matrices, and a
partition that starts at n jumps there once. No row waits for the one before it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tap positions (bits that a set lowest bit flips) of registers of 5 to 63 bits, maximal period.
TAPS = {
    5: (5, 4, 3, 2), 6: (6, 5, 3, 2), 7: (7, 6, 5, 4), 8: (8, 6, 5, 4), 9: (9, 8, 6, 5), 10: (10, 9, 7, 6), 11: (11, 10, 9, 7), 12: (12, 11, 8, 6), 13: (13, 12, 10, 9), 14: (14, 13, 11, 9),
    15: (15, 14, 13, 11), 16: (16, 14, 13, 11), 17: (17, 16, 15, 14), 18: (18, 17, 16, 13), 19: (19, 18, 17, 14), 20: (20, 19, 16, 14), 21: (21, 20, 19, 16), 22: (22, 19, 18, 17), 23: (23, 22, 20, 18),
    24: (24, 23, 21, 20), 25: (25, 24, 23, 22), 26: (26, 25, 24, 20), 27: (27, 26, 25, 22), 28: (28, 27, 24, 22), 29: (29, 28, 27, 25), 30: (30, 29, 26, 24), 31: (31, 30, 29, 28), 32: (32, 30, 26, 25),
    33: (33, 32, 29, 27), 34: (34, 31, 30, 26), 35: (35, 34, 28, 27), 36: (36, 35, 29, 28), 37: (37, 36, 33, 31), 38: (38, 37, 33, 32), 39: (39, 38, 35, 32), 40: (40, 37, 36, 35), 41: (41, 40, 39, 38),
    42: (42, 40, 37, 35), 43: (43, 42, 38, 37), 44: (44, 42, 39, 38), 45: (45, 44, 42, 41), 46: (46, 40, 39, 38), 47: (47, 46, 43, 42), 48: (48, 44, 41, 39), 49: (49, 45, 44, 43), 50: (50, 48, 47, 46),
    51: (51, 50, 48, 45), 52: (52, 51, 49, 46), 53: (53, 52, 51, 47), 54: (54, 51, 48, 46), 55: (55, 54, 53, 49), 56: (56, 54, 52, 49), 57: (57, 55, 54, 52), 58: (58, 57, 53, 52), 59: (59, 57, 55, 52),
    60: (60, 58, 56, 55), 61: (61, 60, 59, 56), 62: (62, 59, 57, 56), 63: (63, 62, 59, 58),
}
SCHEMA = "i long, state long"


def taps(bits: int) -> int:
    return sum(1 << p for p in TAPS[bits])


def step(state: int, mask: int) -> int:
    return (state ^ (mask if state & 1 else 0)) >> 1


def jump(state: int, mask: int, n: int, bits: int) -> int:
    """The state after ``n`` steps, by squaring the step's matrix over the bits."""
    columns = [step(1 << k, mask) for k in range(bits + 1)]

    def apply(matrix: list[int], x: int) -> int:
        out = 0
        for k, c in enumerate(matrix):
            if x >> k & 1:
                out ^= c
        return out

    while n:
        if n & 1:
            state = apply(columns, state)
        columns = [apply(columns, c) for c in columns]
        n >>= 1
    return state


def register(spark: SparkSession, bits: int, seed: int, count: int, partitions: int | None = None) -> DataFrame:
    """(i, state): the states after 1 to ``count`` steps."""
    mask = taps(bits)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, state = None, 0
        for batch in batches:
            rows = []
            for i in batch.id.tolist():
                state = step(state, mask) if at == i - 1 else jump(seed, mask, i, bits)
                at = i
                rows.append((i, state))
            yield pd.DataFrame(rows, columns=["i", "state"])

    ids = spark.range(1, count + 1, 1, partitions) if partitions else spark.range(1, count + 1)
    return ids.mapInPandas(run, SCHEMA)


def accounts(draws: DataFrame, wide: DataFrame, group_size: int) -> DataFrame:
    """Account numbers from 1: a draw picks the group, a wide draw the member."""
    both = draws.join(wide.select("i", F.col("state").alias("wide")), "i")
    return both.select("i", (F.col("state") * group_size + F.col("wide") % group_size - group_size + 1).cast("bigint").alias("account"))


def chained_random(seed: bytes, source: bytes, count: int) -> list[int]:
    """Deterministic numbers for tests: each is the first eight bytes of a hash of the last hash and the next 32 bytes of ``source``, read in a circle."""
    from hashlib import blake2b

    last, at, out = blake2b(seed).digest(), 0, []
    for _ in range(count):
        part = source[at : at + 32]
        at = at + len(part) if at + len(part) < len(source) else 0
        last = blake2b(last + part).digest()
        out.append(int.from_bytes(last[:8], "little"))
    return out


def replayed_transfers(parsed: DataFrame, account: Callable[[F.Column], F.Column]) -> DataFrame:
    """(tx_id, src, dst) of the plain value transfers of a parsed trace: value other than zero, no call data, a recipient."""
    plain = ~F.coalesce("value", F.lit("0x0")).isin("0x0", "0") & (F.regexp_replace(F.coalesce("input", F.lit("")), "^(0x)+", "") == "") & F.col("to").isNotNull()
    return parsed.where(plain).select("tx_id", account(F.col("from")).alias("src"), account(F.col("to")).alias("dst"))


def uniform(key: F.Column, salt: str) -> F.Column:
    """A number in [0, 2^31) from a hash of the key, so that rows are drawn independently and alike in every run."""
    return F.conv(F.substring(F.md5(F.concat(key.cast("string"), F.lit(salt))), 1, 8), 16, 10).cast("bigint") % (1 << 31)


def transfers(rows: DataFrame, key: str, accounts_total: int, hot: int, hot_per_mille: int) -> DataFrame:
    """(key, src, dst): a transfer starts at one of the ``hot`` first accounts in so many of a thousand cases; it always ends at a cold one."""
    k = F.col(key)
    cold = lambda salt: uniform(k, salt) % (accounts_total - hot) + hot + 1
    src = F.when(uniform(k, "p") % 1000 < hot_per_mille, uniform(k, "h") % hot + 1).otherwise(cold("s"))
    return rows.select(key, src.alias("src"), cold("d").alias("dst"))


def fixed_pair(pairs: DataFrame, key: str, hot_per_mille: int, src: int = 256, dst: int = 257) -> DataFrame:
    """Replaces so many of a thousand transfers by one fixed pair."""
    hit = uniform(F.col(key), "f") % 1000 < hot_per_mille
    return pairs.select(key, F.when(hit, src).otherwise(F.col("src")).alias("src"), F.when(hit, dst).otherwise(F.col("dst")).alias("dst"))


def hot_modulus(pairs: DataFrame, key: str, hot_per_mille: int, hot: int) -> DataFrame:
    """Folds both ends of so many of a thousand transfers onto the first ``hot`` accounts."""
    hit = uniform(F.col(key), "n") % 1000 < hot_per_mille
    return pairs.select(key, F.when(hit, F.col("src") % hot + 1).otherwise(F.col("src")).alias("src"), F.when(hit, F.col("dst") % hot + 1).otherwise(F.col("dst")).alias("dst"))
