"""N-gram Jaccard join by token-combination prefixes.

A document's tokens are its distinct hashed word shingles. All documents order their tokens alike: rare tokens first,
then frequent ones, each by hash. If two sets reach the threshold, a set of n tokens misses at most
``n - ceil(t n)`` of them in the other, so one of the first ``missing + 1`` tokens is shared: a rare token is indexed
by itself. Where a document has not that many rare tokens, its prefix is extended by frequent tokens, dealt into
classes by hash range, and every pair of tokens within a class is indexed: a class of c tokens still yields a shared
pair after c - 2 of them are missing, so the prefix goes on until those c - 1 allowances make up what the rare tokens
lack. The number of classes follows the size of the set (by powers of two; a set near a border indexes both sides), so
the pairs stay linear in the prefix.

A token is frequent if ``FREQUENT`` sets or more hold it (an equal set counts once in a chunk). All tokens are counted,
in packed blocks by hash range, by as many leading bits of their hashes as tell them apart at the size of the input. At
most ``MOST_FREQUENT`` of them are listed, the most frequent, which bounds what is broadcast. The choice steers only work:
any class function gives the same links.

No bucket is expanded into all pairs. Equal sets are one class. In each bucket every member is verified against the
bucket's smallest member; then buckets whose members are still in different components are joined with themselves,
leaving out pairs that the distances to that smallest member (a metric) rule out, and in buckets of frequent tokens pairs
that would have to share a rare token: who is indexed by frequent tokens has all its rare ones indexed, so a pair that
meets in no rare token's bucket differs in all rare tokens of both, and in the numbers of their frequent ones. Members of
such buckets are joined by the bucket's smallest member, once for all buckets it is the smallest of. A bucket or family of
more than ``BLOCK`` members is dealt into blocks, each of which meets all members in a task of its own.

Candidates are first held against a parity bitmap of each set (about one bit a token): every token in which two sets
differ flips one bit, so the bits that differ bound the difference from below. Only pairs that pass fetch their sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, discard, mix, pack, pack_counts, prepare, release, settle, shingle_sets, slices, unpack, unpack_counts, utf8
from .components import components

#: A bound on the broadcast list of frequent tokens (8 bytes each).
MOST_FREQUENT = 1 << 20
#: Sets that must hold a token to make it frequent.
FREQUENT = 8
#: Tokens that a task gathers before it counts them, text bytes to a hash range, and to a task at least where there are several a core.
CHUNK_TOKENS, RANGE_BYTES, TASK_BYTES = 1 << 20, 8 << 20, 32 << 20
#: Members of a bucket that one task holds against all of its members.
BLOCK = 2048
#: Slots of the broadcast filter that says whose sets are needed; it only saves work.
SLOTS = 1 << 23

_A, _B = np.uint64(0x2545F4914F6CDD1D), np.uint64(0xD1342543DE82EF95)


def _sets(batch: pa.RecordBatch, size: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    data, offsets = utf8(batch.column("text"))
    for lo, hi in slices(offsets):
        part = offsets[lo : hi + 1]
        yield lo, shingle_sets(data[part[0] : part[-1]], part - part[0], size)


def _describe(size: int, bits: int, short: int):
    """Rows of two kinds: 0 a document with the size and the 128-bit key of its set; 1 the counted tokens of a chunk of sets in one hash range."""
    from hashlib import blake2b

    names = ["kind", "doc_id", "n", "key", "range", "ids", "counts"]
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        held: list[np.ndarray] = []
        count = 0

        def counted() -> pa.RecordBatch:
            tokens, found = np.unique(np.concatenate(held) >> np.uint64(short), return_counts=True)
            ranges = (tokens >> np.uint64(64 - short - bits)).astype(np.int64) if bits else np.zeros(len(tokens), np.int64)
            cuts = [0, *(np.flatnonzero(ranges[1:] != ranges[:-1]) + 1).tolist(), len(tokens)]
            parts = list(zip(cuts[:-1], cuts[1:], strict=True))
            none = [None] * len(parts)
            columns = ([1] * len(parts), none, none, none, [int(ranges[lo]) for lo, _ in parts], [pack(tokens[lo:hi]) for lo, hi in parts], [pack_counts(found[lo:hi]) for lo, hi in parts])
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], names)

        for batch in batches:
            ids = batch.column("doc_id").cast(pa.int64())
            n, key = [], []
            for _, sets in _sets(batch, size):
                for s in sets:
                    n.append(len(s))
                    key.append(k := blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                    if k is not None and k not in seen:
                        seen.add(k)
                        held.append(s)
                        count += len(s)
                        if count >= CHUNK_TOKENS:
                            yield counted()
                            held.clear()
                            seen.clear()
                            count = 0
            none = [None] * len(n)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) if x is not ids else ids for x, t in zip(([0] * len(n), ids, n, key, none, none, none), kinds, strict=True)], names)
        if held:
            yield counted()
            held.clear()
        settle()

    return run, "kind int, doc_id long, n long, key binary, range long, ids binary, counts binary"


def _frequent(least: int):
    def run(table: pa.Table) -> pa.Table:
        ids = np.concatenate([unpack(x) for x in table.column("ids").to_pylist()])
        counts = np.concatenate([unpack_counts(x) for x in table.column("counts").to_pylist()])
        order = np.argsort(ids, kind="stable")
        ids, counts = ids[order], counts[order]
        first = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
        total = np.add.reduceat(counts, first)
        often = total >= least
        return pa.table({"token": pa.array(ids[first][often].view(np.int64)), "found": pa.array(total[often], pa.int64())})

    return run, "token long, found long"


def missing(n: int, percent: int) -> int:
    """The most tokens of a set of n that can be missing from a set that reaches the threshold."""
    return n - -(-percent * n // 100)


def bands(n: int, percent: int) -> list[int]:
    """The powers of two whose sizes a linked set can have, one or two."""
    low, high = -(-percent * n // 100), 100 * n // percent
    return list(range(max(1, low).bit_length() - 1, max(1, high).bit_length()))


def signatures(tokens: np.ndarray, frequent: np.ndarray, percent: int) -> np.ndarray:
    """The index entries of one set: ``tokens`` sorted, ``frequent`` their flags. The lowest bit tells pairs from single tokens."""
    need = missing(len(tokens), percent) + 1
    rare = tokens[~frequent][:need] & ~np.uint64(1)
    need -= len(rare)
    if need <= 0:
        return rare
    often, out = tokens[frequent], [rare]
    for band in bands(len(tokens), percent):
        bits = max(0, band - 2)  # classes of four to eight tokens when all are frequent
        group = often >> np.uint64(64 - bits) if bits else np.zeros(len(often), np.uint64)
        cuts = [0, *(np.flatnonzero(group[1:] != group[:-1]) + 1).tolist(), len(often)]
        left = need
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            if left <= 0:
                break
            if hi - lo > 1:
                i, j = np.triu_indices(hi - lo, 1)
                out.append(mix(mix(often[lo:hi][i] * _A + np.uint64(band)) + often[lo:hi][j] * _B) | np.uint64(1))
                left -= hi - lo - 1
    return np.unique(np.concatenate(out))


def _index(size: int, percent: int, short: int, listed):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = listed.value
        gate = np.zeros(1 << 22, bool)
        cut_off, coarse = np.uint64(short), np.uint64(max(0, 42 - short))
        gate[hot >> coarse] = True
        for batch in batches:
            ids = batch.column("doc_id").cast(pa.int64())
            for lo, sets in _sets(batch, size):
                every = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
                every >>= cut_off
                flag = gate[every >> coarse]
                if len(hot) and flag.any():
                    at = np.flatnonzero(flag)
                    flag[at] = hot[np.minimum(np.searchsorted(hot, every[at]), len(hot) - 1)] == every[at]
                ends = np.cumsum([len(s) for s in sets])
                found = [signatures(s, flag[e - len(s) : e], percent) if len(s) else s for s, e in zip(sets, ends.tolist(), strict=True)]
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
                flat = np.concatenate(found) if found else np.zeros(0, np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(lo, len(sets)), pa.array([len(s) for s in sets], pa.int64()), pa.array([int(len(s) - flag[e - len(s) : e].sum()) for s, e in zip(sets, ends.tolist(), strict=True)], pa.int64()), pa.array([parity(s) for s in sets], pa.binary()), *[pa.array(x) for x in folded(sets)], pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(np.int64)))],
                    ["doc_id", "n", "rare", "bits", "p0", "p1", "entries"],
                )
        settle()

    return run, "doc_id long, n long, rare long, bits binary, p0 long, p1 long, entries array<long>"


def parity(tokens: np.ndarray) -> bytes:
    """A bitmap of 8 bits or the largest power of two up to the set's size; a bit is the parity of the tokens that hash to it."""
    size = max(8, 1 << (max(1, len(tokens)).bit_length() - 1))
    return np.packbits((np.bincount((tokens & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1).astype(bool)).tobytes()


def folded(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Of each set the parities of 128 hash classes as two numbers, a bound that the JVM can evaluate."""
    words = [np.frombuffer(np.packbits((np.bincount((s & np.uint64(127)).astype(np.int64), minlength=128) & 1).astype(bool)).tobytes(), np.int64) for s in sets]
    both = np.array(words, np.int64).reshape(-1, 2)
    return both[:, 0].copy(), both[:, 1].copy()


def least_difference(x: bytes, y: bytes) -> int:
    """A lower bound of the tokens that are in one of two sets only, from their bitmaps (the longer is folded)."""
    a, b = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    if len(a) > len(b):
        a, b = b, a
    folded = np.bitwise_xor.reduce(b.reshape(-1, len(a)), axis=0) if len(b) > len(a) else b
    return int(np.bitwise_count(a ^ folded).sum())


def _could_link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds ``low``, a lower bound of the distance of each pair."""
    for batch in batches:
        differ = [least_difference(x, y) for x, y in zip(batch.column("bits_a").to_pylist(), batch.column("bits_b").to_pylist(), strict=True)]
        both = batch.column("na").to_numpy() + batch.column("nb").to_numpy()
        differ = np.maximum(np.array(differ, float), np.abs(batch.column("na").to_numpy() - batch.column("nb").to_numpy()))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(2 * differ / (both + differ))], ["a", "b", "low"])


def _blobs(size: int, wanted):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(np.frombuffer(wanted.value, np.uint8), bitorder="little").astype(bool)
        for batch in batches:
            batch = batch.filter(pa.array(bits[batch.column("slot").to_numpy()]))
            if batch.num_rows:
                ids = batch.column("doc_id").cast(pa.int64())
                for lo, sets in _sets(batch, size):
                    yield pa.RecordBatch.from_arrays([ids.slice(lo, len(sets)), pa.array([s.tobytes() for s in sets], pa.binary())], ["doc_id", "tokens"])
        settle()

    return run, "doc_id long, tokens binary"


def _overlap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        shared, sizes = [], []
        for x, y in zip(batch.column("ta"), batch.column("tb"), strict=True):
            a, b = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
            shared.append(len(np.intersect1d(a, b, assume_unique=True)))
            sizes.append(len(a) + len(b))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(shared, pa.int64()), pa.array([n - s for n, s in zip(sizes, shared, strict=True)], pa.int64())], ["a", "b", "shared", "every"])
    settle()


def _met(members: DataFrame, key: str, possible) -> DataFrame:
    """The pairs (a, b) of members of one ``key`` that are ``possible``; large groups in blocks."""
    large = members.groupBy(key).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")).where("blocks > 1")
    sized = members.join(large, key, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    x = sized.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")).alias("x")
    y = sized.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).alias("y")
    met = x.join(y, (F.col(f"x.{key}") == F.col(f"y.{key}")) & (F.col("x.block") == F.col("y.block")) & possible)
    return met.select(F.col("x.doc_id").alias("a"), F.col("y.doc_id").alias("b"))


def linked_documents(documents: DataFrame, size: int = 4, percent: int = 85) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the smallest doc_id reachable).

    Two documents link when ``100 * |intersection| >= percent * |union|`` of their sets of ``size``-word shingles (64-bit
    hashes). Null or wordless text: an empty set, linked with nothing, its own component. Rows that repeat a doc_id are
    one document: the components of their texts are merged. A null doc_id is returned with a null component and links
    with nothing. Other columns are not read.
    """
    spark = documents.sparkSession
    prepare(spark)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    length = docs.agg(F.sum(F.octet_length("text")).alias("s")).first().s or 0
    # many small files: few tasks, and so few files to write
    docs = docs.coalesce(max(4 * spark.sparkContext.defaultParallelism, int(length) // TASK_BYTES))
    short = max(0, 64 - max(32, int(length).bit_length() + 10))  # bits of a hash that counting leaves out
    run, schema = _describe(size, max(0, (int(length) // RANGE_BYTES).bit_length()), short)
    described = cut(docs.mapInArrow(run, schema), "shingle-sets", ["kind"])
    info = described.where("kind = 0").select("doc_id", "n", "key")

    # frequent tokens, the list bounded: where more qualify, the bar is raised
    run, schema = _frequent(FREQUENT)
    frequent = cut(described.where("kind = 1").select("range", "ids", "counts").groupBy("range").applyInArrow(run, schema), "shingle-frequent", few=True)
    discard(described, "kind=1")
    steps = frequent.groupBy(F.floor(F.log2("found") * 4).cast("int").alias("step")).count().orderBy(F.desc("step")).collect()
    bar, listed_so_far = None, 0
    for r in steps:
        if listed_so_far + r["count"] > MOST_FREQUENT:
            break
        bar, listed_so_far = r.step, listed_so_far + r["count"]
    chosen = frequent.where(F.floor(F.log2("found") * 4).cast("int") >= F.lit(bar if bar is not None else 1 << 30)).select("token")
    hot = np.sort(np.asarray(chosen.toArrow().column("token").to_numpy(), np.int64).view(np.uint64))
    listed = spark.sparkContext.broadcast(hot)

    # one class per set; its smallest doc_id stands for it
    known = info.where("n > 0 AND doc_id IS NOT NULL")
    classes = cut(known.groupBy("key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "shingle-classes", few=True)
    reps = classes.select(F.col("rep").alias("doc_id")).distinct()

    run, schema = _index(size, percent, short, listed)
    indexed = cut(docs.where("doc_id IS NOT NULL").mapInArrow(run, schema).where("n > 0").join(reps.hint("merge"), "doc_id", "left_semi"), "shingle-index")  # shuffled at any size, as it must be at a large one
    entries = indexed.select("doc_id", F.explode("entries").alias("entry"))
    pivots = entries.groupBy("entry").agg(F.min("doc_id").alias("pivot"), F.count("*").alias("held")).where("held > 1").select("entry", "pivot")
    pivots = cut(pivots, "shingle-pivots", few=True)  # else the join could not split a large bucket
    buckets = cut(entries.join(pivots, "entry"), "shingle-buckets")
    discard(pivots)
    release(spark)

    far = 1.0 - percent / 100.0 + 1e-9
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(SLOTS))

    def bounded(pairs: DataFrame, what: str) -> DataFrame:
        left = indexed.select(F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("bits").alias("bits_a"))
        right = indexed.select(F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("bits_b"))
        return cut(pairs.join(left, "a").join(right, "b").select("a", "b", "na", "nb", "bits_a", "bits_b").mapInArrow(_could_link, "a long, b long, low double"), what, few=True)

    def verified(pairs: DataFrame, what: str) -> DataFrame:
        needed = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
        filled = needed.select(slot.alias("slot")).groupBy((F.col("slot") / 8).cast("int").alias("at")).agg(F.expr("bit_or(shiftleft(1, cast(slot % 8 as int)))").alias("byte")).toArrow()
        wanted = np.zeros(SLOTS // 8, np.uint8)
        wanted[filled.column("at").to_numpy()] = filled.column("byte").to_numpy()
        run, schema = _blobs(size, spark.sparkContext.broadcast(wanted.tobytes()))
        blobs = cut(docs.where("doc_id IS NOT NULL").withColumn("slot", slot).mapInArrow(run, schema).join(needed, "doc_id", "left_semi"), "shingle-blobs", few=True)
        left = blobs.select(F.col("doc_id").alias("a"), F.col("tokens").alias("ta"))
        right = blobs.select(F.col("doc_id").alias("b"), F.col("tokens").alias("tb"))
        out = cut(pairs.join(left, "a").join(right, "b").select("a", "b", "ta", "tb").mapInArrow(_overlap, "a long, b long, shared long, every long"), what, few=True)
        discard(blobs)
        return out

    pairs = buckets.where("doc_id <> pivot").select(F.col("pivot").alias("a"), F.col("doc_id").alias("b")).distinct()
    bounds = bounded(pairs, "shingle-bounds")
    tried = verified(bounds.where(F.col("low") <= far).select("a", "b"), "shingle-tried")
    close = F.col("shared") * 100 >= F.col("every") * percent
    several = known.groupBy("doc_id").agg(F.min("key").alias("low"), F.max("key").alias("high")).where("low <> high").select("doc_id")
    same = known.join(several, "doc_id", "left_semi").join(classes, "key").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    links = tried.where(close).select("a", "b").union(same)
    first = components(links, "shingle-first")
    release(spark)

    # buckets that still hold several components: pairs that the distances to the bucket's pivot leave open
    exact = tried.groupBy("a", "b").agg(F.min(1.0 - F.col("shared") / F.col("every")).alias("d"))
    distance = bounds.groupBy("a", "b").agg(F.min("low").alias("low")).join(exact, ["a", "b"], "left")
    distance = distance.select(F.col("a").alias("pivot"), F.col("b").alias("doc_id"), F.coalesce("d", "low").alias("low"), F.coalesce("d", F.lit(1.0)).alias("high"))
    placed = buckets.join(first.select(F.col("node").alias("doc_id"), "root"), "doc_id", "left").withColumn("root", F.coalesce("root", "doc_id"))
    open_buckets = placed.where("doc_id <> pivot").groupBy("entry").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("entry")
    members = cut(placed.where("doc_id <> pivot").join(open_buckets, "entry", "left_semi").join(distance, ["pivot", "doc_id"]).join(indexed.select("doc_id", "n", "rare", "p0", "p1"), "doc_id").select("entry", "pivot", "doc_id", "n", "rare", "p0", "p1", "root", "low", "high"), "shingle-open", few=True)
    discard(buckets)
    allowed = (F.col("x.n") + F.col("y.n")) * (100 - percent)
    bits_differ = F.bit_count(F.col("x.p0").bitwiseXOR(F.col("y.p0"))) + F.bit_count(F.col("x.p1").bitwiseXOR(F.col("y.p1")))
    differ = F.col("x.rare") + F.col("y.rare") + F.abs((F.col("x.n") - F.col("x.rare")) - (F.col("y.n") - F.col("y.rare")))
    possible = (
        (F.col("x.doc_id") < F.col("y.doc_id")) & (F.col("x.root") != F.col("y.root"))
        & (F.col("x.low") - F.col("y.high") <= far) & (F.col("y.low") - F.col("x.high") <= far)
        & (F.least("x.n", "y.n") * 100 >= F.greatest("x.n", "y.n") * percent) & (bits_differ * (100 + percent) <= allowed)
    )
    paired = F.col("entry").bitwiseAND(F.lit(1)) == 1
    single, family = members.where(~paired), members.where(paired).drop("entry").dropDuplicates(["pivot", "doc_id"])
    by_token = _met(single, "entry", possible)
    by_pivot = _met(family, "pivot", possible & (differ * (100 + percent) <= allowed))
    rest = by_token.union(by_pivot).distinct()
    open_pairs = bounded(rest, "shingle-rest").where(F.col("low") <= far).select("a", "b")
    for done in (indexed, members, bounds):
        discard(done)
    final = first
    if open_pairs.limit(1).count():
        final = components(links.union(verified(open_pairs, "shingle-retried").where(close).select("a", "b")), "shingle-final")

    placed_classes = classes.join(final.select(F.col("node").alias("rep"), "root"), "rep", "left").select("key", F.coalesce("root", "rep").alias("component_id"))
    in_sets = info.where("n > 0").join(placed_classes, "key", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))
    empty = info.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return in_sets.union(empty)
