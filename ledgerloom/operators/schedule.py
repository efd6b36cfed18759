"""Frames: greedy packing of non-conflicting items, the order in which frames leave, and what that releases.

Packing is order-dependent within a block, so a block is one sorted stream through one packer; blocks are independent.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Frames that are open at once, items that fill a frame, and keys of one kind that do.
FRAMES, FULL, MOST_KEYS = 64, 256, 256
SCHEMA = "height long, idx long, flush_seq long, frame int, pos int, out_idx long, task_out_start long"


class Packer:
    """First-fit packing. What an open frame holds is one bit of a number kept for each key (or for each of the places that
    stand for a key in a sketch), so an item is held against all frames at once."""

    def __init__(self, frames: int = FRAMES, full: int = FULL, most_keys: int = MOST_KEYS) -> None:
        self.count, self.full, self.most = frames, full, most_keys
        self.items: list[list[int]] = [[] for _ in range(frames)]
        self.sizes = [[0, 0] for _ in range(frames)]
        self.held: tuple[dict, dict] = ({}, {})  # frames that read, frames that write, by place
        self.filled: list[tuple[set, set]] = [(set(), set()) for _ in range(frames)]
        self.rows: list[tuple[int, int, int, int, int, int]] = []
        self.flushes = 0

    def _holding(self, kind: int, key: tuple) -> int:
        """The frames all of whose places for the key are taken."""
        get, mask = self.held[kind].get, -1
        for place in key:
            mask &= get(place, 0)
        return mask

    def flush(self, f: int) -> None:
        start = len(self.rows)
        for pos, item in enumerate(self.items[f]):
            self.rows.append((item, self.flushes, f, pos, len(self.rows), start))
        self.flushes += 1
        for held, filled in zip(self.held, self.filled[f], strict=True):
            for place in filled:
                held[place] &= ~(1 << f)
        self.items[f], self.filled[f], self.sizes[f] = [], (set(), set()), [0, 0]

    def add(self, item: int, reads: list, writes: list) -> None:
        """``reads`` and ``writes``: each key as the tuple of the places that stand for it."""
        taken = 0
        for key in reads:
            taken |= self._holding(1, key)
        for key in writes:
            taken |= self._holding(1, key) | self._holding(0, key)
        f = (~taken & (taken + 1)).bit_length() - 1  # the lowest frame that is free
        if f >= self.count:
            f = 0
            self.flush(f)
        self.items[f].append(item)
        for kind, keys in enumerate((reads, writes)):
            held, filled = self.held[kind], self.filled[f][kind]
            for key in keys:
                for place in key:
                    held[place] = held.get(place, 0) | 1 << f
                filled.update(key)
            self.sizes[f][kind] += len(keys)
        if self.count > 1 and (f != 0 or self.items[1]) and (len(self.items[f]) >= self.full or max(self.sizes[f]) > self.most):
            self.flush(f)

    def offer(self, item: int, reads: list, writes: list) -> int | None:
        """The frame that takes the item, or None if it collides with all; a frame with too many keys is emptied."""
        before = self.flushes
        taken = 0
        for key in reads:
            taken |= self._holding(1, key)
        for key in writes:
            taken |= self._holding(1, key) | self._holding(0, key)
        f = (~taken & (taken + 1)).bit_length() - 1
        if f >= self.count:
            return None
        self.add(item, reads, writes)
        if self.flushes == before and max(self.sizes[f]) > self.most:
            self.flush(f)
        return f

    def close(self) -> list[tuple[int, int, int, int, int, int]]:
        for f in range(self.count):
            if self.items[f]:
                self.flush(f)
        return self.rows


def bloom_bits(key: str) -> tuple[int, ...]:
    """Five positions of 11 bits from the first eight bytes of the key's hash, the lowest bits first."""
    from hashlib import sha256

    number = int.from_bytes(sha256(key.encode()).digest()[:8], "big")
    return tuple(number >> 11 * n & 2047 for n in range(5))


def tasks_of(items: DataFrame, access: DataFrame, size: int = 4, lanes: int = 4) -> tuple[DataFrame, DataFrame]:
    """Tasks of ``size`` items of a lane, and their access sets: (height, idx, task) and (height, task, k, w).

    ``items``: height, idx, lane (0 to ``lanes`` - 1). The producers of a block's lanes hand over tasks in turn: the n-th
    task of lane l has number n * ``lanes`` + l. A task's keys are its items', a write covering a read.
    """
    from ..functions.ordered import numbered

    rows = numbered(items.withColumn("_bucket", F.floor(F.col("idx") / 4096)), ["height", "lane"], "_bucket", ["idx"], "_nth").drop("_bucket")
    placed = rows.select("height", "idx", (F.floor(F.col("_nth") / size) * lanes + F.col("lane")).cast("bigint").alias("task"))
    sets = access.join(placed, ["height", "idx"]).groupBy("height", "task", "k").agg(F.max("w").alias("w"))
    return placed, sets


def _streamed(access: DataFrame, start, schema: str) -> DataFrame:
    """Blocks in order through one packer each: rows of one block lie in one partition, sorted, and are read in batches, so
    that a task holds a block's open frames and output, not its keys. ``start`` gives (take item, finish block)."""
    rows = access.select("height", "idx", "k", F.col("w").cast("int").alias("w")).repartition("height").sortWithinPartitions("height", "idx", "k")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in schema.split(", ")]
        block = item = None
        take, finish, sets = None, None, ([], [])

        def out(found: list[tuple]) -> Iterator[pa.RecordBatch]:
            for lo in range(0, len(found), 1 << 16):
                part = list(zip(*found[lo : lo + (1 << 16)], strict=True))
                yield pa.RecordBatch.from_arrays([pa.array([block] * len(part[0]), pa.int64()), *[pa.array(c, pa.int32() if n in ("frame", "pos") else pa.int64()) for c, n in zip(part, names[1:], strict=True)]], names)

        for batch in batches:
            for height, idx, k, w in zip(*(batch.column(c).to_pylist() for c in ("height", "idx", "k", "w")), strict=True):
                if (height, idx) != (block, item):
                    if item is not None:
                        take(item, *sets)
                    if height != block:
                        if block is not None:
                            yield from out(finish())
                        take, finish = start()
                    block, item, sets = height, idx, ([], [])
                sets[w].append(k)
        if item is not None:
            take(item, *sets)
            yield from out(finish())

    return rows.mapInArrow(run, schema)


def packed(access: DataFrame, frames: int = FRAMES, full: int = FULL, most_keys: int = MOST_KEYS, bloom: bool = False) -> DataFrame:
    """(height, idx, flush_seq, frame, pos, out_idx, task_out_start) of every item of ``access``(height, idx, k, w).

    An item goes to the first open frame that it does not collide with; if there is none, frame 0 leaves and takes it. A
    full frame leaves, frame 0 only if frame 1 holds something. At the end of a block all leave by number. One frame
    keeps the order: it leaves at the first collision. ``bloom`` decides by Bloom bits instead of keys and may see
    collisions that are none.
    """

    def start() -> tuple:
        packer, known = Packer(frames, full, most_keys), {}

        def places(k: str) -> tuple:
            if k not in known:
                known[k] = bloom_bits(k) if bloom else (k,)
            return known[k]

        return (lambda item, reads, writes: packer.add(item, [places(k) for k in reads], [places(k) for k in writes])), packer.close

    return _streamed(access, start, SCHEMA)


def thinned(access: DataFrame, frames: int = 2 * FRAMES) -> DataFrame:
    """(height, idx, frame): items of each group, in order, that find an open frame by Bloom bits; the others are dropped.

    This is how a mempool is drained when a block is final: what collides with everything must be sent again.
    """

    def start() -> tuple:
        packer, found = Packer(frames, 1 << 30), []

        def take(item: int, reads: list, writes: list) -> None:
            f = packer.offer(item, [bloom_bits(k) for k in reads], [bloom_bits(k) for k in writes])
            if f is not None:
                found.append((item, f))

        return take, lambda: found

    return _streamed(access, start, "height long, idx long, frame int")


def finalized(proposed: DataFrame, arrived: DataFrame, included: DataFrame, frames: int = 2 * FRAMES) -> DataFrame:
    """What becomes of the pools when a block is final: (height, idx, fate) of every transaction of ``proposed`` and ``arrived``.

    ``proposed`` and ``arrived``: access rows (height, idx, k, w) of the pool that the block was proposed from, and of what
    came meanwhile; ``included``: (height, idx) of the block. What the block includes is ``done``. The rest of the
    proposed pool moves to the draining pool and is thinned: what finds a frame is ``kept``, the others are ``dropped``,
    to be sent again. What had arrived is offered anew and stays ``pending``.
    """
    left = proposed.join(included.select("height", "idx"), ["height", "idx"], "left_anti")
    kept = thinned(left, frames).select("height", "idx", F.lit("kept").alias("fate"))
    rest = left.select("height", "idx").distinct().join(kept, ["height", "idx"], "left").select("height", "idx", F.coalesce("fate", F.lit("dropped")).alias("fate"))
    done = proposed.select("height", "idx").distinct().join(included.select("height", "idx"), ["height", "idx"], "left_semi").select("height", "idx", F.lit("done").alias("fate"))
    came = arrived.select("height", "idx").distinct().join(proposed.select("height", "idx").distinct(), ["height", "idx"], "left_anti")
    return rest.unionByName(done).unionByName(came.select("height", "idx", F.lit("pending").alias("fate")))


def in_order(transfers: DataFrame, balances: DataFrame) -> DataFrame:
    """Transfers of each task executed in order: (height, task, idx, ok, before): whether the caller could pay, and what it had.

    ``transfers``: height, task, idx, caller, amount; ``balances``: height, caller, balance at the start. Within a task a
    transaction sees what the earlier ones left; one that cannot pay changes nothing. A task is a few transactions, so
    its callers' histories are bounded arrays, folded in the JVM.
    """
    rows = transfers.join(balances, ["height", "caller"], "left").withColumn("balance", F.coalesce("balance", F.lit(0).cast("bigint")))
    each = rows.groupBy("height", "task", "caller").agg(F.sort_array(F.collect_list(F.struct("idx", "amount"))).alias("l"), F.first("balance").alias("balance"))
    step = "(a, x) -> struct(CASE WHEN x.amount <= a.left THEN a.left - x.amount ELSE a.left END AS left, concat(a.done, array(struct(x.idx AS idx, x.amount <= a.left AS ok, a.left AS before))) AS done)"
    folded = F.expr(f"aggregate(l, struct(balance AS left, cast(array() AS array<struct<idx:bigint,ok:boolean,before:bigint>>) AS done), {step}, a -> a.done)")
    return each.select("height", "task", F.explode(folded).alias("r")).select("height", "task", "r.idx", "r.ok", "r.before")


def flush_order(frames: DataFrame) -> DataFrame:
    """out_idx and task_out_start again, from (height, idx, flush_seq, pos) alone."""
    order = Window.partitionBy("height").orderBy("flush_seq", "pos")
    numbered = frames.withColumn("out_idx", (F.row_number().over(order) - 1).cast("bigint"))
    return numbered.withColumn("task_out_start", F.min("out_idx").over(Window.partitionBy("height", "flush_seq")))


def frame_collisions(frames: DataFrame, access: DataFrame) -> DataFrame:
    """Pairs of items in one frame that collide; there must be none."""
    held = frames.select("height", "idx", "flush_seq").join(access, ["height", "idx"])
    keys = held.groupBy("height", "flush_seq", "k").agg(F.count("*").alias("holders"), F.max("w").alias("written"))
    return keys.where("holders > 1 AND written = 1")


def done_prefix(tasks: DataFrame, group: str, order: str, done: str) -> DataFrame:
    """(group, upto): the largest position up to which everything is done, -1 if the first is not.

    That is one before the first that is not done, or the last of all: two aggregates, no window.
    """
    ends = tasks.groupBy(group).agg(F.min(F.when(~F.col(done), F.col(order))).alias("stop"), F.max(order).alias("last"))
    return ends.select(group, F.coalesce(F.col("stop") - 1, F.col("last")).cast("bigint").alias("upto"))
