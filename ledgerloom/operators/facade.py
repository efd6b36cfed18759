"""The store as one object over DataFrames: what a caller of the ledger needs, in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ordered import numbered, previous
from ..shared import cut
from . import merkle, state, store


class LedgerStore:
    """A log of entries (shard, sn, height, ts, event_id, key, key_hash, value, op, dead_sn) and the views over it.

    Nothing is computed before a result is asked for, but for the trees, which are written once; each method gives a DataFrame.
    """

    def __init__(self, entries: DataFrame) -> None:
        self.entries, self._trees = entries, None

    def at(self, height: int) -> LedgerStore:
        """The store as it was after a height."""
        return LedgerStore(self.entries.where(F.col("height") <= height))

    def live(self) -> DataFrame:
        return store.active(self.entries)

    def read(self, keys: DataFrame) -> DataFrame:
        """The live entries of keys (key)."""
        return store.exact(keys, self.live())

    def missing(self, keys: DataFrame) -> DataFrame:
        """Keys that are not live, with the neighbours that prove it: (key, prev_hash, next_hash)."""
        live = self.live().select("key", "key_hash")
        gone = keys.select("key").distinct().join(live.select("key"), "key", "left_anti").withColumn("probe_hash", F.sha2("key", 256))
        before = store.predecessors(gone.select("probe_hash"), live.select("key_hash"))
        after = store.chained(live.select("key_hash")).select(F.col("key_hash").alias("prev_hash"), F.col("next_key_hash").alias("next_hash"))
        return gone.join(before, "probe_hash").join(after, "prev_hash").select("key", "prev_hash", "next_hash")

    def leaves(self) -> DataFrame:
        """(shard, sn, hash) of every entry."""
        return self.entries.where("sn IS NOT NULL").select("shard", "sn", F.sha2(F.concat_ws("|", "key", "value", "sn"), 256).alias("hash"))

    def trees(self) -> DataFrame:
        """One row a twig with its hashes; live entries are active."""
        live = self.live().select("shard", "sn", F.lit(True).alias("_live"))
        leaves = self.leaves().join(live, ["shard", "sn"], "left").withColumn("active", F.coalesce("_live", F.lit(False)))
        if self._trees is None:
            self._trees = cut(merkle.tree(leaves), "trees")
        return self._trees

    def roots(self) -> DataFrame:
        """(shard, level, root) of every shard's tree."""
        return merkle.shard_roots(self.trees().select("shard", "twig", "root"))

    def prove(self, asked: DataFrame) -> DataFrame:
        """Serialized whole proofs of (shard, sn)."""
        trees = self.trees()
        return merkle.proof_bytes(merkle.proofs(asked, trees, merkle.upper_tiers(trees.select("shard", "twig", "root"))))

    def compactable(self, threshold: int, ratio: int, div: int, batch: int) -> DataFrame:
        return store.compaction_candidates(self.live(), self.entries, threshold, ratio, div, batch)

    def append(self, operations: DataFrame) -> LedgerStore:
        """The store after more classified operations (height, ts, event_id, key, op, value_cents) later than its own."""
        rows = state.with_shard(operations.where("op <> 1"))
        ends = self.entries.groupBy("shard").agg((F.max("sn") + 1).alias("base"))
        fresh = numbered(rows.where("op <> 4"), ["shard"], "height", ["ts", "event_id"], "sn").join(ends, "shard", "left").withColumn("sn", F.col("sn") + F.coalesce("base", F.lit(0))).drop("base")
        every = fresh.unionByName(rows.where("op = 4").withColumn("sn", F.lit(None).cast("bigint")))
        every = every.select("shard", "sn", "height", "ts", "event_id", "key", "key_hash", F.col("value_cents").cast("string").alias("value"), "op")
        # what a new entry supersedes: the one before it in the batch, else its key's last in the log
        last = self.entries.join(every.select("key").distinct(), "key", "left_semi").groupBy("key").agg(F.max_by(F.struct("sn"), F.struct("height", "ts", "event_id")).alias("tail"))
        chained = previous(every.withColumn("own", F.struct("sn")), ["key"], "height", ["ts", "event_id"], "own", "prior")
        chained = chained.join(last, "key", "left").withColumn("dead_sn", F.coalesce("prior", "tail")["sn"]).drop("own", "prior", "tail")
        return LedgerStore(self.entries.unionByName(chained))
