"""The append-only log as a table: positions, segments, activity, exact and neighbouring look-ups, compaction, replay."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import hashing as H
from ..functions.bits import TWIG_SHIFT
from ..functions.ordered import numbered, running_sum
from ..shared import cut

#: Bytes before key and value, of the next key hash, of version and serial number, of one dead number; alignment.
HEAD, NEXT, NUMBERS, DEAD, ALIGN = 5, 32, 16, 8, 8
#: Fixed value: bytes that an appended entry may have.
MOST_BYTES = 1 << 14
#: Fixed value: an index unit is worth merging when so many times its erased and unmerged entries exceed its size.
INDEX_RATIO = 30
#: Fixed value: sentries of all shards, one for each pair of leading hash bytes.
SENTRIES = 1 << 16


def entry_length(key: F.Column, value: F.Column, dead: F.Column) -> F.Column:
    """Bytes of a serialized entry: all fields and ``dead`` superseded numbers, rounded up to the alignment."""
    raw = F.octet_length(key) + F.octet_length(value) + HEAD + NEXT + NUMBERS + dead * DEAD
    return (F.ceil(raw / ALIGN) * ALIGN).cast("bigint")


def entry_record(key: F.Column, value: F.Column, next_hash: F.Column, version: F.Column, number: F.Column, dead: F.Column) -> F.Column:
    """A serialized entry as BINARY: lengths of key (one byte) and value (three), the count of dead numbers, key, value,
    next key hash, version, number, dead numbers, zeros up to the alignment. Numbers are eight bytes, lowest first.
    ``dead``: ARRAY<BIGINT>. A longer entry than ``MOST_BYTES`` or key than 255 bytes is an error."""
    each = F.concat(F.unhex(F.lit("")), F.unhex(F.array_join(F.transform(dead, lambda x: F.hex(H.little_endian(x))), "")))
    body = F.concat(H.little_endian(F.octet_length(value) * 256 + F.octet_length(key), 4), H.little_endian(F.size(dead), 1), key, value, next_hash, H.little_endian(version), H.little_endian(number), each)
    padded = F.unhex(F.rpad(F.hex(body), (F.ceil(F.octet_length(body) / ALIGN) * ALIGN * 2).cast("int"), "0"))
    sound = (F.octet_length(padded) <= MOST_BYTES) & (F.octet_length(key) <= 255)
    return F.when(sound, padded).otherwise(F.raise_error(F.concat_ws(" ", F.lit("an entry of"), F.octet_length(padded), F.lit("bytes"))).cast("binary"))


def record_payload(record: F.Column) -> F.Column:
    """A serialized entry without its padding: what its hash is made of."""
    text = F.hex(record)
    at = lambda k: H.hex_int(F.substring(text, 2 * k + 1, 2))
    size = HEAD + at(0) + at(1) + at(2) * 256 + at(3) * 65536 + NEXT + NUMBERS + at(4) * DEAD
    return F.substring(record, F.lit(1), size.cast("int"))


def positioned(entries: DataFrame) -> DataFrame:
    """Appended entries with len and pos, the running sum of lengths in their shard."""
    kept = entries.where("sn IS NOT NULL")
    kept = kept.withColumn("len", entry_length(F.col("key"), F.col("value"), F.when(F.col("dead_sn").isNotNull(), 1).otherwise(0)))
    return running_sum(kept, ["shard"], "height", ["sn"], "len", "pos")


def active(entries: DataFrame) -> DataFrame:
    """Appended entries that no later operation supersedes."""
    dead = entries.where("dead_sn IS NOT NULL").select("shard", F.col("dead_sn").alias("sn"))
    return entries.where("sn IS NOT NULL").join(dead, ["shard", "sn"], "left_anti")


def sentries(spark) -> DataFrame:
    """shard, key_hash, next_key_hash of the entries that bound every gap; the last one's successor is all ones."""
    two = F.lpad(F.lower(F.hex(F.col("id"))), 4, "0")
    after = F.when(F.col("id") == SENTRIES - 1, F.lit("f" * 64)).otherwise(F.rpad(F.lpad(F.lower(F.hex(F.col("id") + 1)), 4, "0"), 64, "0"))
    return spark.range(SENTRIES).select(F.floor(F.col("id") / 4096).cast("int").alias("shard"), (F.col("id") % 4096).alias("sn"), F.rpad(two, 64, "0").alias("key_hash"), after.alias("next_key_hash"))


def chained(key_hashes: DataFrame) -> DataFrame:
    """Every live key hash and every sentry with its successor.

    A sentry opens each pair of leading bytes, so the successor is the next in the same pair or else the next sentry: no
    window is larger than a 65536th of the keys.
    """
    every = key_hashes.select("key_hash", F.lit(False).alias("is_sentry")).unionByName(sentries(key_hashes.sparkSession).select("key_hash", F.lit(True).alias("is_sentry")))
    pair = F.substring("key_hash", 1, 4)
    inner = F.lead("key_hash").over(Window.partitionBy(pair).orderBy("key_hash"))
    number = H.hex_int(pair)
    after = F.when(number == SENTRIES - 1, F.lit("f" * 64)).otherwise(F.rpad(F.lpad(F.lower(F.hex(number + 1)), 4, "0"), 64, "0"))
    return every.select("key_hash", "is_sentry", F.coalesce(inner, after).alias("next_key_hash"))


def exact(probes: DataFrame, entries: DataFrame) -> DataFrame:
    """Probes (key) joined to entries by short hash, with the key itself as the residual."""
    a = probes.select(F.col("key").alias("probe"), H.short_hash(F.col("key")).alias("short"))
    b = entries.withColumn("short", F.substring("key_hash", 1, 20))
    return a.join(b, "short").where("probe = key").drop("probe", "short")


def predecessors(probes: DataFrame, key_hashes: DataFrame) -> DataFrame:
    """(probe_hash, prev_hash): the largest live key hash or sentry below each probe, by one window a pair of leading bytes."""
    rows = key_hashes.select("key_hash", F.lit(0).alias("is_probe")).unionByName(sentries(key_hashes.sparkSession).select("key_hash", F.lit(0).alias("is_probe")))
    rows = rows.unionByName(probes.select(F.col("probe_hash").alias("key_hash"), F.lit(1).alias("is_probe")))
    # a probe comes before an equal key: its predecessor is strictly smaller
    order = Window.partitionBy(F.substring("key_hash", 1, 4)).orderBy("key_hash", F.desc("is_probe")).rowsBetween(Window.unboundedPreceding, -1)
    before = F.last(F.when(F.col("is_probe") == 0, F.col("key_hash")), ignorenulls=True).over(order)
    return rows.withColumn("prev_hash", before).where("is_probe = 1").select(F.col("key_hash").alias("probe_hash"), "prev_hash")


def chain_predecessors(asked: DataFrame, chain: DataFrame) -> DataFrame:
    """(key_hash, prev_hash): of a ``chained`` table the entries whose successors are the asked key hashes."""
    return asked.select("key_hash").join(chain.select(F.col("key_hash").alias("prev_hash"), F.col("next_key_hash").alias("key_hash")), "key_hash")


def index_compactible(erased: F.Column, unmerged: F.Column, size: F.Column) -> F.Column:
    return (erased + unmerged) * INDEX_RATIO > size


def compacted(live: DataFrame, entries: DataFrame, threshold: int, ratio: int, div: int, mutations: int) -> DataFrame:
    """What compaction appends in ``mutations`` mutations, two entries in each while the shard is worth compacting: the
    oldest active entries again, with the same key, value and version, the next numbers, and the numbers they supersede.

    An entry moved leaves as many active ones, takes the log's end one on and its start to the next active entry; so the
    test before the i-th pair depends on the entry that is then the oldest, and all moves follow from one order.
    """
    from ..functions.bits import compactible

    size = entries.where("sn IS NOT NULL").groupBy("shard").agg((F.max("sn") + 1).alias("sn_end"))
    use = live.groupBy("shard").agg(F.count("*").alias("active")).join(size, "shard")
    oldest = live.withColumn("nth", F.row_number().over(Window.partitionBy("shard").orderBy("sn")) - 1).where(F.col("nth") < 2 * mutations).join(use, "shard")
    worth = compactible(F.col("active"), F.col("sn"), F.col("sn_end") + F.col("nth"), threshold, ratio, div)
    stops = oldest.where((F.col("nth") % 2 == 0) & ~worth).groupBy("shard").agg(F.min("nth").alias("stop"))
    moved = oldest.join(stops, "shard", "left").where(F.col("stop").isNull() | (F.col("nth") < F.col("stop")))
    moved = moved.withColumn("dead_sn", F.col("sn")).withColumn("sn", (F.col("sn_end") + F.col("nth")).cast("bigint"))
    return moved.drop("nth", "active", "sn_end", "stop")


def compaction_candidates(live: DataFrame, entries: DataFrame, threshold: int, ratio: int, div: int, batch: int) -> DataFrame:
    """The ``batch`` oldest active entries of every shard that is worth compacting, with the number they get."""
    from ..functions.bits import compactible

    size = entries.where("sn IS NOT NULL").groupBy("shard").agg((F.max("sn") + 1).alias("sn_end"))
    use = live.groupBy("shard").agg(F.count("*").alias("active"), F.min("sn").alias("sn_start")).join(size, "shard")
    shards = use.where(compactible(F.col("active"), F.col("sn_start"), F.col("sn_end"), threshold, ratio, div)).select("shard", "sn_end")
    oldest = F.row_number().over(Window.partitionBy("shard").orderBy("sn"))
    return live.join(shards, "shard").withColumn("nth", oldest).where(F.col("nth") <= batch).select("shard", "sn", "key", (F.col("sn_end") + F.col("nth") - 1).cast("bigint").alias("new_sn"))


#: Operations of a range of hashes that a group should hold.
RANGE_ROWS = 20_000
_RANGE = "shard int, ts timestamp, event_id long, k int, key_hash string, next_key_hash string, op int, refs array<long>"


def _replay_range(digits: int):
    """Operations of one range of hashes (equal first ``digits``) in order -> what they append. A reference to an earlier
    entry is twice its event's number and its place there, or minus one less a sentry's number."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        import bisect

        shard, prefix = int(rows.shard.iloc[0]), rows.key_hash.iloc[0][:digits]
        low, count = int(prefix.ljust(4, "0"), 16), 16 ** (4 - digits)
        spelled = lambda n: f"{n:04x}" + "0" * 60 if n < SENTRIES else "f" * 64
        order = [spelled(n) for n in range(low, low + count)]
        after = {spelled(n): spelled(n + 1) for n in range(low, low + count)}
        made = {spelled(n): -1 - n % 4096 for n in range(low, low + count)}
        out = []
        for ts, event, h, op in rows.sort_values(["ts", "event_id"])[["ts", "event_id", "key_hash", "op"]].itertuples(index=False):
            appended: list[tuple[str, list[int]]] = []
            if op == 2:
                at = bisect.bisect_left(order, h)
                before = order[at - 1]
                after[h], after[before] = after[before], h
                order.insert(at, h)
                appended = [(h, []), (before, [made[before]])]
            elif op == 3:
                appended = [(h, [made[h]])]
            elif op == 4:
                at = bisect.bisect_left(order, h)
                before = order[at - 1]
                appended = [(before, [made.pop(h), made[before]])]
                after[before] = after.pop(h)
                order.pop(at)
            for k, (x, refs) in enumerate(appended):
                made[x] = 2 * event + k
                out.append((shard, ts, event, k, x, after[x], op, refs))
        return pd.DataFrame(out, columns=[c.split()[0] for c in _RANGE.split(", ")])

    return run


def replayed(operations: DataFrame, digits: int | None = None) -> DataFrame:
    """The exact log of each shard (shard, sn, key_hash, next_key_hash, op, dead): a create appends the entry and its
    predecessor again, a write the entry, a delete the predecessor again; sentries have the first 4096 numbers.
    ``operations``: shard, seq columns ts and event_id (unique), key_hash, op.

    A sentry opens each pair of leading hash bytes, so predecessors and successors lie within a range of hashes with equal
    first ``digits`` (up to 4; by default as many as leave some ``RANGE_ROWS`` operations a range): each range is a group. Only the numbers run through
    a shard; they are given afterwards, by the order of what was appended, and references are looked up.
    """
    if digits is None:
        rows, digits = operations.count(), 1
        while digits < 4 and rows > RANGE_ROWS * 16**digits:
            digits += 1
    if not 1 <= digits <= 4:
        raise ValueError("a sentry bounds ranges of 1 to 4 digits")
    rows = operations.select("shard", F.col("ts").cast("timestamp").alias("ts"), "event_id", "key_hash", "op")
    made = rows.groupBy(F.substring("key_hash", 1, digits)).applyInPandas(_replay_range(digits), _RANGE)
    made = cut(made.withColumn("hour", F.floor(F.unix_timestamp("ts") / 3600)), "replayed")
    log = numbered(made, ["shard"], "hour", ["ts", "event_id", "k"], "sn").withColumn("sn", F.col("sn") + 4096)
    log = cut(log, "replayed")
    refs = log.select("shard", "sn", F.posexplode("refs").alias("at", "ref"))
    names = log.select((F.col("event_id") * 2 + F.col("k")).alias("ref"), F.col("sn").alias("found"))
    found = refs.where("ref < 0").withColumn("found", -1 - F.col("ref")).unionByName(refs.where("ref >= 0").join(names, "ref").select("shard", "sn", "at", "ref", "found"))
    dead = found.groupBy("shard", "sn").agg(F.array_sort(F.collect_list(F.struct("at", "found"))).alias("l")).select("shard", "sn", F.expr("transform(l, x -> x.found)").alias("dead"))
    return log.join(dead, ["shard", "sn"], "left").select("shard", "sn", "key_hash", "next_key_hash", "op", F.coalesce("dead", F.expr("cast(array() AS array<bigint>)")).alias("dead"))


def prunable_twigs(live: DataFrame, entries: DataFrame, every: int = 500, keep: int = 10, least: int = 2) -> DataFrame:
    """(shard, start, end, prunable): the twigs that may go at the last multiple of ``every`` heights: those whose entries
    are older than the ``keep`` heights before it and lie before the oldest active entry, and only ``least`` or more at once."""
    bound = entries.agg((F.floor(F.max("height") / every) * every - keep).alias("bound"))  # one row
    kept = entries.where("sn IS NOT NULL").crossJoin(F.broadcast(bound)).groupBy("shard").agg(F.min(F.when(F.col("height") >= F.col("bound"), F.col("sn"))).alias("young"), F.max("sn").alias("last"))
    oldest = live.groupBy("shard").agg(F.min("sn").alias("oldest"))
    rows = kept.join(oldest, "shard", "left").withColumn("end", F.shiftright(F.least(F.coalesce("young", F.col("last") + 1), F.coalesce("oldest", F.col("last") + 1)), TWIG_SHIFT))
    return rows.select("shard", F.lit(0).cast("bigint").alias("start"), "end", (F.col("end") >= least).alias("prunable"))
