"""Chat formatting as a prefix tree: turns that conversations share from their start are emitted once, depth-first.

A turn is formatted as ``<|im_start|>role``, a line feed, its text, ``<|im_end|>`` and a line feed. In texts and roles a
backslash is doubled and ``<|`` becomes ``<\\|``; in roles a line feed becomes ``\\n``; so no text can hold a control
string and the original is restored exactly. Tokens are code points.

A node of the tree is a path of turns from the start, named by a chained hash. It is owned by the smallest conversation
that runs through it, so what a conversation owns is the end of its path: a chain. Chains hang on nodes of other chains;
depth-first order is that of their hops, deeper branches first. Every node gets its place in the one emitted sequence,
the position id its first token has on its path (the following tokens count on), and the intervals of the sequence that
its tokens may attend to besides their own node's earlier tokens: one interval for each chain on its path.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, prepare

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
#: The role whose texts are learned from.
LEARNED = "assistant"
_escaped = re.compile(r"\\([\\|n])")
_turn = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.S)


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return _escaped.sub(lambda m: "\n" if m[1] == "n" else m[1], text)


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """The formatted turn and the bounds of its escaped text."""
    head = OPEN + escape(role).replace("\n", "\\n") + "\n"
    body = escape(text)
    return head + body + CLOSE, len(head), len(head) + len(body)


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation."""
    return [(unescape(r), unescape(t)) for r, t in _turn.findall(formatted)]


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Turns sorted by conversation -> one row each with its depth, the chained hash of its path and the formatted turn."""
    kinds = {"conv": pa.int64(), "depth": pa.int64(), "path": pa.binary(), "formatted": pa.string(), "chars": pa.int64(), "loss_from": pa.int64(), "loss_to": pa.int64()}
    now, depth, chain = object(), 0, b""
    for batch in batches:
        out: dict[str, list] = {k: [] for k in kinds}
        for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv", "role", "text")), strict=True):
            if conv != now:
                now, depth, chain = conv, 0, b""
            formatted, low, high = format_turn(role or "", text or "")
            chain = hashlib.blake2b(chain + formatted.encode("utf-8", "surrogatepass"), digest_size=16).digest()
            learned = role == LEARNED
            for k, x in zip(kinds, (conv, depth, chain, formatted, len(formatted), low if learned else 0, high if learned else 0), strict=True):
                out[k].append(x)
            depth += 1
        yield pa.RecordBatch.from_arrays([pa.array(out[k], t) for k, t in kinds.items()], list(kinds))


def _unused(ids: DataFrame) -> int:
    """A number that no conversation has, for the one without a number: the lowest of all, else the first free one."""
    least, lowest = ids.agg(F.min("conv_id")).first()[0], -(1 << 63)
    if least is None or least > lowest:
        return lowest
    after = ids.where(F.col("conv_id") < (1 << 63) - 1).select((F.col("conv_id") + 1).alias("conv_id"))
    return after.join(ids.distinct(), "conv_id", "left_anti").agg(F.min("conv_id")).first()[0]


def chat_tree(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two tables in the shared folder.

    nodes: owner, depth, start, chars, position, formatted, loss_from and loss_to (bounds of the learned text within the
    node, 0 and 0 if none), attends (intervals of the sequence, in order of the path).
    leaves: conv_id, n_turns and spans: the intervals of the sequence that are the conversation, with the chain's owner.

    Rows are ordered by turn (null first, ties by role and text). Null role or text: empty. A null conv_id is one
    conversation of its own. Equal conversations share all nodes. An empty table gives two empty tables. Other columns
    are not read.
    """
    spark = conversations.sparkSession
    prepare(spark)
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    nameless = _unused(rows.select("conv_id"))
    numbers = rows.select(F.coalesce("conv_id", F.lit(nameless)).alias("conv"), "turn", "role", "text")
    ordered = numbers.repartition("conv").sortWithinPartitions("conv", "turn", "role", "text")
    turns = cut(ordered.mapInArrow(_paths, "conv long, depth long, path binary, formatted string, chars long, loss_from long, loss_to long"), "chat-turns")

    owners = cut(turns.groupBy("path").agg(F.min("conv").alias("owner")), "chat-owners", few=True)  # else the joins could not split a shared turn
    owned = cut(turns.select("conv", "depth", "path", "chars").join(owners, "path").select("conv", "depth", "chars", "owner"), "chat-owned", few=True)
    # relative end of each node in its owner's chain
    mine = owned.where("conv = owner")
    ends = cut(mine.select("owner", "depth", "chars", F.sum("chars").over(Window.partitionBy("owner").orderBy("depth")).alias("end")), "chat-ends", few=True)
    chains = mine.groupBy(F.col("conv").alias("owner")).agg(F.min("depth").alias("branch"), F.sum("chars").alias("total"))
    above = owned.where("conv <> owner").groupBy(F.col("conv").alias("owner")).agg(F.max_by("owner", "depth").alias("parent"))
    chains = chains.join(above, "owner", "left")
    hung = chains.join(ends.select(F.col("owner").alias("parent"), (F.col("depth") + 1).alias("branch"), F.col("end").alias("at")), ["parent", "branch"], "left")
    hung = cut(hung.select("owner", "parent", "branch", "total", "at"), "chat-chains", few=True)

    # hops of each chain, level by level: (parent, where it hangs) from the root; key: the depth-first order
    flip = F.lit((1 << 62)) - F.col("branch")  # deeper branches come first
    step = F.concat(F.lpad(F.hex(flip), 16, "0"), F.lpad(F.hex(F.col("owner").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0"))
    hop_type = "array<struct<chain:long,at:long>>"
    level = cut(hung.where("parent IS NULL").select("owner", "total", step.alias("key"), F.expr(f"cast(array() AS {hop_type})").alias("hops")), "chat-level", few=True)
    levels = [level]
    rest = hung.where("parent IS NOT NULL").withColumn("step", step)
    while True:
        up = level.select(F.col("owner").alias("parent"), F.col("key").alias("above"), F.col("hops").alias("before"))
        level = cut(rest.join(up, "parent").select("owner", "total", F.concat("above", "step").alias("key"), F.expr(f"concat(before, cast(array(struct(parent, at)) AS {hop_type}))").alias("hops")), "chat-level", few=True)
        if not level.limit(1).count():
            break
        levels.append(level)
    placed = levels[0]
    for more in levels[1:]:
        placed = placed.union(more)

    # offsets: running sums within ranges of the order, and the ranges' own sums (one row a range) before them
    ranges = max(1, spark.sparkContext.defaultParallelism)
    ranged = cut(placed.repartitionByRange(ranges, "key").withColumn("range", F.spark_partition_id()), "chat-order")
    sums, base = [], 0
    for r in ranged.groupBy("range").agg(F.sum("total").alias("total")).orderBy("range").collect():
        sums.append((r.range, base))
        base += r.total
    if sums:
        within = F.sum("total").over(Window.partitionBy("range").orderBy("key")) - F.col("total")
        offsets = ranged.withColumn("within", within).join(F.broadcast(spark.createDataFrame(sums, "range int, base long")), "range").select("owner", "hops", (F.col("base") + F.col("within")).alias("offset"))
    else:
        offsets = ranged.select("owner", "hops", F.lit(0).cast("long").alias("offset"))
    offsets = cut(offsets, "chat-offsets", few=True)
    spots = offsets.select(F.col("owner").alias("chain"), F.col("offset").alias("chain_offset"))
    far = offsets.select("owner", F.posexplode("hops").alias("nth", "hop")).select("owner", "nth", F.col("hop.chain").alias("chain"), F.col("hop.at").alias("at"))
    spans = far.join(spots, "chain").groupBy("owner").agg(F.array_sort(F.collect_list(F.struct("nth", "chain", F.col("chain_offset").alias("start"), (F.col("chain_offset") + F.col("at")).alias("stop")))).alias("far"))
    spans = spans.select("owner", F.expr("transform(far, x -> struct(x.chain AS chain, x.start AS start, x.stop AS stop))").alias("far"))
    none = F.expr("cast(array() AS array<struct<chain:long,start:long,stop:long>>)")
    chain_table = cut(offsets.select("owner", "offset").join(spans, "owner", "left").withColumn("far", F.coalesce("far", none)), "chat-spans", few=True)

    texts = turns.join(owners, "path").where("conv = owner").select("owner", "depth", "formatted", "loss_from", "loss_to")
    nodes = texts.join(ends, ["owner", "depth"]).join(chain_table, "owner")
    own = F.expr("struct(offset AS start, offset + end - chars AS stop)")
    nodes = nodes.select(
        "owner", "depth", (F.col("offset") + F.col("end") - F.col("chars")).alias("start"), "chars",
        (F.expr("aggregate(far, 0L, (s, x) -> s + x.stop - x.start)") + F.col("end") - F.col("chars")).alias("position"),
        "formatted", "loss_from", "loss_to",
        F.concat(F.expr("transform(far, x -> struct(x.start AS start, x.stop AS stop))"), F.when(F.col("end") > F.col("chars"), F.array(own)).otherwise(F.expr("cast(array() AS array<struct<start:long,stop:long>>)"))).alias("attends"),
    )
    nodes = cut(nodes, "chat-nodes")

    last = owned.groupBy("conv").agg(F.max_by("owner", "depth").alias("owner"), F.max("depth").alias("depth"))
    leaves = last.join(ends.select("owner", "depth", "end"), ["owner", "depth"]).join(chain_table, "owner")
    leaves = leaves.select(
        F.when(F.col("conv") != nameless, F.col("conv")).alias("conv_id"), (F.col("depth") + 1).alias("n_turns"),
        F.concat("far", F.array(F.expr("struct(owner AS chain, offset AS start, offset + end AS stop)"))).alias("spans"),
    )
    return nodes, cut(leaves, "chat-leaves", few=True)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes sorted by conversation and position -> one row a conversation with what its formatted turns say."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    nothing = object()
    now, state = nothing, None

    def row(state: list) -> list:
        return [state[0], state[1], state[2].hexdigest(), state[3], state[4].hexdigest(), state[5]]

    for batch in batches:
        out: list[list] = []
        for conv, formatted, low, high in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "loss_from", "loss_to")), strict=True):
            if state is None or conv != now:
                if state is not None:
                    out.append(row(state))
                now, state = conv, [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            state[5] += len(formatted)
            for role, text in parse(formatted):
                state[1] += 1
                state[2].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
            if high > low:
                learned = unescape(formatted[low:high])
                state[3] += len(learned)
                state[4].update(learned.encode("utf-8", "surrogatepass"))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names)
    if state is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row(state), kinds, strict=True)], names)


def read_back(nodes: DataFrame, leaves: DataFrame) -> DataFrame:
    """Per conversation its turns' and learned texts' digests, put together from the emitted sequence alone."""
    parts = leaves.select("conv_id", F.explode("spans").alias("span")).select("conv_id", F.col("span.chain").alias("owner"), F.col("span.stop").alias("stop"))
    found = parts.join(nodes.select("owner", "start", "position", "formatted", "loss_from", "loss_to"), "owner").where("start < stop")
    ordered = found.select("conv_id", "position", "formatted", "loss_from", "loss_to").repartition("conv_id").sortWithinPartitions("conv_id", "position")
    return ordered.mapInArrow(_digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
