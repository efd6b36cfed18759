"""Access sets as exploded relations (item, key, w): unions, collisions, enforcement, precedence.

A hot key may hold a third of all accesses, so nothing but the list of all colliding pairs joins holders of a key with
each other: where only a maximum is asked for, one row a key and frame is kept.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bits import PROBES, probes
from ..shared import cut

#: Fixed value: how many items before its own an item looks back for what it must wait for.
WINDOW = 128
#: Items of the stand-in frames that are used where no packed frames are given.
FRAME = 64


def set_of_group(access: DataFrame, group: list[str]) -> DataFrame:
    """Sorted read-only and written keys of each group; a duplicate stays as often as it occurs."""
    return access.groupBy(*group).agg(
        F.array_join(F.sort_array(F.collect_list(F.when(F.col("w") == 0, F.col("k")))), ",").alias("reads"),
        F.array_join(F.sort_array(F.collect_list(F.when(F.col("w") == 1, F.col("k")))), ",").alias("writes"),
    )


def collisions(access: DataFrame) -> DataFrame:
    """(height, i, j): pairs of items of a block, j before i, that share a key which at least one of them writes.

    Only writers are joined with a key's holders, so keys that are only read make no rows. A key that many write makes as
    many pairs as the result has; its writers are dealt into blocks of 256 places, so that no one task makes them all.
    """
    writer = access.where("w = 1").select("height", "k", F.col("idx").alias("a"), F.floor(F.col("idx") / 256).alias("part"))
    parts = writer.groupBy("height", "k").agg(F.collect_set("part").alias("parts"))  # a block's places over 256 at most
    holder = access.join(parts, ["height", "k"]).select("height", "k", F.col("idx").alias("b"), F.explode("parts").alias("part"))
    met = writer.join(holder, ["height", "k", "part"]).where("a <> b")
    return met.select("height", F.greatest("a", "b").alias("i"), F.least("a", "b").alias("j")).distinct()


def standing_frames(items: DataFrame, frame: int = FRAME) -> DataFrame:
    """``items``(height, idx) with ``start``, the first item of frames of ``frame`` items each."""
    return items.withColumn("start", F.floor(F.col("idx") / frame) * frame)


def latest_colliders(access: DataFrame, back: int = WINDOW) -> DataFrame:
    """(height, idx, m): the largest colliding item before the item's frame, at most ``back`` before the item.

    ``access``: height, idx, start (the first item of the item's frame), k, w. Of each key and frame one row is kept, with
    its last holder and writer; positions rise with frames, so what an item waits for is a running maximum over the
    key's earlier frames, and a key has no more rows than its block has frames.
    """
    last = access.groupBy("height", "k", "start").agg(F.max("idx").alias("any"), F.max(F.when(F.col("w") == 1, F.col("idx"))).alias("writer"))
    earlier = Window.partitionBy("height", "k").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    before = last.select("height", "k", "start", F.max("any").over(earlier).alias("any"), F.max("writer").over(earlier).alias("writer")).where("any IS NOT NULL")
    seen = access.join(before, ["height", "k", "start"]).withColumn("at", F.when(F.col("w") == 1, F.col("any")).otherwise(F.col("writer")))
    return seen.where(F.col("at") >= F.greatest(F.lit(0), F.col("idx") - back)).groupBy("height", "idx").agg(F.max("at").alias("m"))


def precedence(items: DataFrame, access: DataFrame, back: int = WINDOW) -> DataFrame:
    """(height, idx, eei): the item whose completion lets this one run.

    ``items``: height, idx (the place in which items run) and start, the first item of its frame: of ``standing_frames``, or
    out_idx and task_out_start of packed frames. ``access``: height, idx, k, w. -1 in the first frame; else the latest
    collider within reach; else the item before the reach, or 0 at the start. In a frame longer than the reach that item may
    be one of the same frame: no collider, but what keeps items from running more than the reach ahead.
    """
    stop = F.when(F.col("idx") > back, F.col("idx") - back).otherwise(F.lit(0))
    framed = access.select("height", "idx", "k", "w").join(items.select("height", "idx", "start"), ["height", "idx"])
    found = items.select("height", "idx", "start").join(latest_colliders(framed, back), ["height", "idx"], "left")
    default = F.when(stop == 0, F.lit(0)).otherwise(stop - 1)
    return found.select("height", "idx", F.when(F.col("start") == 0, F.lit(-1)).otherwise(F.coalesce("m", default)).cast("bigint").alias("eei"))


def precedence_faults(waits: DataFrame, items: DataFrame, access: DataFrame, back: int = WINDOW) -> DataFrame:
    """(height, tasks, late, wrong): what is amiss with ``waits``(height, idx, eei), by a join of the holders of keys.

    ``items`` and ``access`` as for ``precedence``. ``late``: after the first frame, an item waits for itself, a later one, or
    one within its reach that is of its own frame; the item before the reach may be of that frame. ``wrong``: eei is not -1
    in the first frame, the nearest collider before the frame, or without one the item before the reach.
    """
    reach = F.greatest(F.lit(0), F.col("idx") - back)
    met = collisions(access).select("height", F.col("i").alias("idx"), "j").join(items.select("height", "idx", "start"), ["height", "idx"])
    near = met.where((F.col("j") < F.col("start")) & (F.col("j") >= reach)).groupBy("height", "idx").agg(F.max("j").alias("near"))
    both = waits.select("height", "idx", "eei").join(items.select("height", "idx", "start"), ["height", "idx"]).join(near, ["height", "idx"], "left")
    due = F.when(F.col("start") == 0, F.lit(-1)).otherwise(F.coalesce("near", F.greatest(F.lit(0), F.col("idx") - back - 1)))
    late = (F.col("start") > 0) & (F.col("eei") >= F.greatest("start", reach))
    return both.groupBy("height").agg(F.count("*").alias("tasks"), F.count(F.when(late, 1)).alias("late"), F.count(F.when(~F.col("eei").eqNullSafe(due), 1)).alias("wrong"))


def frame_masks(access: DataFrame) -> DataFrame:
    """(height, word, w, bit, frames): of each Bloom bit the frames that have it set, 64 frames a word. ``access``: height, frame, w, h (short hash)."""
    flat = access.select("height", "w", "frame", F.explode(F.array(*probes(F.col("h")))).alias("bit"))
    return flat.groupBy("height", F.shiftright("frame", 6).alias("word"), "w", "bit").agg(F.expr("bit_or(shiftleft(1L, cast(frame & 63 AS int)))").alias("frames"))


#: Rows of masks (32 KB each) up to which they are broadcast.
BROADCAST_MASKS = 2000


def dependency_masks(access: DataFrame) -> DataFrame:
    """(height, idx, word, mask): the frames an item's keys may collide with by Bloom bits: its reads against writes, its writes against both; words without any are left out.

    The masks of a block and word are one row of two arrays by bit, so a key looks its five bits up by place.
    """
    masks = frame_masks(access)
    dense = masks.select("height", "word").distinct().select("height", "word", F.explode(F.sequence(F.lit(0), F.lit(4095))).alias("at"))
    filled = dense.join(masks.select("height", "word", (F.col("w") * 2048 + F.col("bit")).cast("int").alias("at"), "frames"), ["height", "word", "at"], "left")
    rows = filled.groupBy("height", "word").agg(F.sort_array(F.collect_list(F.struct("at", F.coalesce("frames", F.lit(0).cast("bigint")).alias("frames")))).alias("l")).select("height", "word", F.expr("transform(l, x -> x.frames)").alias("by_bit"))
    rows = cut(rows, "bloom-masks")
    held = lambda kind: functools.reduce(lambda a, b: a.bitwiseAND(b), [F.col("by_bit")[F.lit(2048 * kind) + F.col(f"b{k}").cast("int")] for k in range(PROBES)])
    keys = access.select("height", "idx", "w", *[p.alias(f"b{k}") for k, p in enumerate(probes(F.col("h")))])
    met = keys.join(F.broadcast(rows) if rows.count() <= BROADCAST_MASKS else rows, "height")
    mask = F.when(F.col("w") == 1, held(1).bitwiseOR(held(0))).otherwise(held(1))
    return met.select("height", "idx", "word", mask.alias("mask")).where("mask <> 0").groupBy("height", "idx", "word").agg(F.bit_or("mask").alias("mask"))


def derived(transactions: DataFrame, slots: DataFrame) -> DataFrame:
    """The access sets of transactions by rule (height, idx, k, w), a write covering a read.

    ``transactions``: height, idx, caller, target, moves (value is moved). ``slots``: height, idx, k, w of what a call
    declares. The caller is written (its balance pays), so is the target if value moves to it, else it is read.
    """
    own = transactions.select("height", "idx", F.col("caller").alias("k"), F.lit(1).alias("w"))
    to = transactions.where("target IS NOT NULL").select("height", "idx", F.col("target").alias("k"), F.col("moves").cast("int").alias("w"))
    return own.unionByName(to).unionByName(slots.select("height", "idx", "k", "w")).groupBy("height", "idx", "k").agg(F.max("w").alias("w"))


def undeclared(touched: DataFrame, declared: DataFrame, writes_only: bool = False) -> DataFrame:
    """Touched (height, idx, k, w) that the declaration does not allow: an unknown key, or a write of a read-only key."""
    if writes_only:
        return touched.where("w = 1").join(declared.where("w = 1").select("height", "idx", "k"), ["height", "idx", "k"], "left_anti")
    return touched.join(declared.select("height", "idx", "k"), ["height", "idx", "k"], "left_anti")
