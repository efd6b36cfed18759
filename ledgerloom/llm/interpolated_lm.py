"""Language-model scoring by deleted interpolation of word n-grams.

Tokens are the words of a text and one end. The model mixes maximum-likelihood estimates of the bigram, the unigram and
a uniform share; the mixture weights depend on a bucket of how often the context was seen, and are learned by
expectation-maximisation on held-out counts: the occurrences of a held-out fold of training documents, each deleted from
the counts that estimate it.

Counts are gathered by request and reply over packed blocks, so that no token becomes a row of its own. Documents are
dealt into chunks by hash, those of the held-out fold into chunks of their own; equal rows that fill a chunk are one row
that counts so many times. A chunk sends its sorted distinct n-gram hashes with its training counts, cut into hash
ranges; each range adds up what all chunks sent and replies with totals in the same order. A chunk's replies, put
together by range, line up with the sorted distinct n-grams that the chunk finds again in its texts. A range holds about
as many n-grams as a chunk at any size of the input; a word that every chunk knows costs one entry a chunk.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, fold, mix, pack, pack_counts, prepare, release, slices, unpack, unpack_counts, utf8, words

#: Text bytes of a chunk.
CHUNK_BYTES = 8 << 20
#: One document in so many, by hash, is in the held-out fold that the mixture weights are learned on.
HELD_FOLD = 7
END = np.uint64(0xE4D0E4D0E4D0E4D1)
START = np.uint64(0x57A4757A4757A475)
_K = np.uint64(0x9E3779B97F4A7C15)
BUCKETS = 24
#: Bins of the logarithms of the two estimates in the statistic that expectation-maximisation works on.
FINE = 4
BINS = 64 * FINE


class Grams:
    """The n-grams of a chunk: sorted distinct hashes of words and of word pairs, and where each token finds its own."""

    def __init__(self, texts: pa.Array) -> None:
        data, offsets = utf8(texts)
        tokens, contexts, sizes = [], [], []
        for lo, hi in slices(offsets):
            part = offsets[lo : hi + 1]
            _, _, hashed, at = words(data[part[0] : part[-1]], part - part[0])
            n = np.diff(at)
            rows = len(n)
            ends = np.cumsum(n + 1) - 1
            flat = np.empty(len(hashed) + rows, np.uint64)
            inner = np.ones(len(flat), bool)
            inner[ends] = False
            flat[inner], flat[ends] = hashed, END
            before = np.empty(len(flat), np.uint64)
            before[1:] = flat[:-1]
            before[ends - n] = START
            tokens.append(flat)
            contexts.append(before)
            sizes.append(n + 1)
        none = np.zeros(0, np.uint64)
        flat, before = (np.concatenate(x) if x else none for x in (tokens, contexts))
        self.sizes = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
        self.doc = np.repeat(np.arange(len(self.sizes)), self.sizes)
        self.words, self.word_at = np.unique(flat, return_inverse=True)
        self.pairs, self.pair_at = np.unique(mix(before * _K + flat), return_inverse=True)
        asked = before.copy()
        asked[before == START] = END  # as often a context as there are documents, so as ends
        self.context_at = np.searchsorted(self.words, asked)


def _requests(bits: int):
    def run(table: pa.Table) -> pa.Table:
        grams = Grams(table.column("text"))
        times = np.where(np.asarray(table.column("learn").to_pylist(), bool), table.column("times").to_numpy(), 0)[grams.doc]
        out: dict[str, list] = {"range": [], "chunk": [], "ids": [], "counts": []}
        chunk = table.column("chunk")[0].as_py()
        for space, ids, at in ((0, grams.words, grams.word_at), (1, grams.pairs, grams.pair_at)):
            counts = np.bincount(at, times, len(ids)).astype(np.int64)
            ranges = (ids >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(ids), np.int64)
            cuts = [0, *(np.flatnonzero(ranges[1:] != ranges[:-1]) + 1).tolist(), len(ids)]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if hi > lo:
                    out["range"].append(2 * int(ranges[lo]) + space)
                    out["chunk"].append(chunk)
                    out["ids"].append(pack(ids[lo:hi]))
                    out["counts"].append(pack_counts(counts[lo:hi]))
        return pa.table(out, schema=pa.schema([("range", pa.int64()), ("chunk", pa.int64()), ("ids", pa.binary()), ("counts", pa.binary())]))

    return run, "range long, chunk long, ids binary, counts binary"


def _replies(table: pa.Table) -> pa.Table:
    """The totals of each request of a range, and once for words their sum and how many have any."""
    number = table.column("range")[0].as_py()
    asked = [unpack(x) for x in table.column("ids").to_pylist()]
    ids, at = np.unique(np.concatenate(asked), return_inverse=True)
    total = np.zeros(len(ids), np.int64)
    place = 0
    for a, c in zip(asked, table.column("counts").to_pylist(), strict=True):
        total[at[place : place + len(a)]] += unpack_counts(c)
        place += len(a)
    out, place = [], 0
    for a in asked:
        out.append(pack_counts(total[at[place : place + len(a)]]))
        place += len(a)
    rows = len(out)
    first = [number % 2 == 0] + [False] * (rows - 1)
    return pa.table({
        "range": table.column("range"), "chunk": table.column("chunk"), "counts": pa.array(out, pa.binary()),
        "sum": pa.array([int(total.sum()) if f else 0 for f in first], pa.int64()),
        "distinct": pa.array([int((total > 0).sum()) if f else 0 for f in first], pa.int64()),
    })


def _found(texts: pa.Table, replies: pa.Table) -> tuple[Grams, np.ndarray, np.ndarray, np.ndarray]:
    """The chunk's n-grams and each token's counts: of itself, of its pair and of its context."""
    grams = Grams(texts.column("text"))
    rows = sorted(zip(replies.column("range").to_pylist(), replies.column("counts").to_pylist(), strict=True))
    one, two = (np.concatenate([unpack_counts(c) for r, c in rows if r % 2 == space] or [np.zeros(0, np.int64)]) for space in (0, 1))
    return grams, one[grams.word_at], two[grams.pair_at], one[grams.context_at]


def bucket(context: np.ndarray) -> np.ndarray:
    """0 for a context never seen, else one more than the floor of the logarithm to base 2, up to the last bucket."""
    return np.minimum(np.frexp(context.astype(float))[1], BUCKETS - 1)


def estimates(word: np.ndarray, pair: np.ndarray, context: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximum-likelihood estimates of the pair and of the word; zero where nothing was counted."""
    return pair / np.maximum(context, 1), word / max(total, 1)


def _statistic(total: int):
    """Held-out occurrences by bucket and logarithms of both estimates, each occurrence deleted from its counts."""

    def run(texts: pa.Table, replies: pa.Table) -> pa.Table:
        schema = pa.schema([("bin", pa.int64()), ("found", pa.int64()), ("pair", pa.float64()), ("word", pa.float64())])
        if not texts.num_rows or not replies.num_rows:
            return schema.empty_table()
        grams, word, pair, context = _found(texts, replies)
        use = np.asarray(texts.column("learn").to_pylist(), bool)[grams.doc]
        times = texts.column("times").to_numpy().astype(float)[grams.doc][use]
        word, pair, context = word[use] - 1, pair[use] - 1, context[use] - 1
        p2, p1 = estimates(word, pair, context, total - 1)
        with np.errstate(divide="ignore"):
            bins = [np.where(p > 0, np.clip(np.floor(-np.log2(np.maximum(p, 1e-300)) * FINE) + 1, 1, BINS - 1), 0).astype(np.int64) for p in (p2, p1)]
        at, where = np.unique((bucket(context) * BINS + bins[0]) * BINS + bins[1], return_inverse=True)
        return pa.table({"bin": at, "found": np.bincount(where, times, len(at)).astype(np.int64), "pair": np.bincount(where, p2 * times, len(at)), "word": np.bincount(where, p1 * times, len(at))}, schema=schema)

    return run, "bin long, found long, pair double, word double"


def learn_weights(bins: np.ndarray, found: np.ndarray, pair: np.ndarray, word: np.ndarray, uniform: float, rounds: int = 200) -> np.ndarray:
    """Expectation-maximisation: for each bucket the weights of pair, word and uniform; a bucket without held-out
    occurrences takes those of the next lower one (the lowest: none for the pair)."""
    weights = np.empty((BUCKETS, 3))
    which = bins // (BINS * BINS)
    last = np.array([0.0, 0.9, 0.1])
    for b in range(BUCKETS):
        own = which == b
        if own.any():
            p = np.stack([pair[own], word[own], np.full(int(own.sum()), uniform)], axis=1)
            n = found[own].astype(float)
            w = np.array([1 / 3, 1 / 3, 1 / 3]) if p[:, 0].any() else np.array([0.0, 0.5, 0.5])
            for _ in range(rounds):
                share = p * w
                share /= np.maximum(share.sum(axis=1, keepdims=True), 1e-300)
                new = (share * n[:, None]).sum(axis=0) / n.sum()
                if np.abs(new - w).max() < 1e-9:
                    break
                w = new
            w = np.maximum(w, [0.0, 1e-6, 1e-6])  # a text's probability is never zero
            last = w / w.sum()
        weights[b] = last
    return weights


def _scores(total: int, distinct: int, weights: np.ndarray):
    def run(texts: pa.Table, replies: pa.Table) -> pa.Table:
        schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()), ("times", pa.int64())])
        if not texts.num_rows:
            return schema.empty_table()
        grams, word, pair, context = _found(texts, replies)
        rows = texts.num_rows
        base = np.log10((word + 1) / (total + (distinct + 1)))
        p2, p1 = estimates(word, pair, context, total)
        w = weights[bucket(context)]
        model = np.log10(w[:, 0] * p2 + w[:, 1] * p1 + w[:, 2] / (distinct + 1))
        return pa.table({
            "doc_id": texts.column("doc_id"), "held_out": texts.column("held_out"), "n_tokens": grams.sizes,
            "n_known": np.bincount(grams.doc, word > 0, rows).astype(np.int64), "train_tokens": np.full(rows, total),
            "base_score": np.bincount(grams.doc, base, rows), "score": np.bincount(grams.doc, model, rows), "times": texts.column("times"),
        }, schema=schema)

    return run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, times long"


def counted(docs: DataFrame, most: int) -> DataFrame:
    """The rows of (doc_id, text, ...) with ``times``, how often each stands for: 1, but rows that together hold over ``most`` bytes of one doc_id and text are one row.

    The rows to put together are found by hashes, without moving texts; usually there are none.
    """
    key = F.xxhash64("doc_id", "text")
    heavy = docs.groupBy(key.alias("key")).agg(F.count("*").alias("n"), F.sum(F.octet_length("text") + 16).alias("s"))
    heavy = cut(heavy.where((F.col("n") > 1) & (F.coalesce("s", F.col("n") * 16) > most)).select("key"), "lm-repeated", few=True)  # no more than a chunk each
    if not heavy.limit(1).count():
        return docs.withColumn("times", F.lit(1).cast("long"))
    keyed = docs.withColumn("key", key)
    once = keyed.join(heavy, "key", "left_anti").select(*docs.columns, F.lit(1).cast("long").alias("times"))
    return once.unionByName(keyed.join(heavy, "key", "left_semi").groupBy(*docs.columns).agg(F.count("*").alias("times")))


def lm_scores(documents: DataFrame, folds: int = 7, held_fold: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document.

    Learns from the documents whose crc32(doc_id as text) modulo ``folds`` is not ``held_fold``. A null text is empty: its
    one token is the end. A null doc_id is scored but not learned from, its held_out is null. Repeated rows count as often
    as they occur; the fold on which the weights are learned is by document. Words are told apart by 64-bit hashes. Without any training document all counts are zero. Other
    columns are not read.
    """
    spark = documents.sparkSession
    prepare(spark)
    part = fold("doc_id", folds)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = docs.agg(F.sum(F.octet_length("text") + 16).alias("n")).first().n or 0
    chunks = max(1, -(-int(size) // CHUNK_BYTES))
    bits = max(0, (chunks - 1).bit_length())
    held_chunks = -(-chunks // HELD_FOLD)
    number, held = F.xxhash64("doc_id", "text"), F.pmod(F.xxhash64("doc_id", "text", F.lit(41)), F.lit(HELD_FOLD)) == 0
    dealt = counted(docs, CHUNK_BYTES // 2).select(
        "doc_id", "text", (part == held_fold).alias("held_out"), F.coalesce(part != held_fold, F.lit(False)).alias("learn"), "times",
        F.when(held, F.pmod(number, F.lit(held_chunks))).otherwise(held_chunks + F.pmod(number, F.lit(chunks))).alias("chunk"),
    )
    run, schema = _requests(bits)
    requests = dealt.groupBy("chunk").applyInArrow(run, schema)
    replies = cut(requests.groupBy("range").applyInArrow(_replies, "range long, chunk long, counts binary, sum long, distinct long"), "lm-replies")
    stats = replies.agg(F.sum("sum").alias("total"), F.sum("distinct").alias("distinct")).first()
    total, distinct = int(stats.total or 0), int(stats.distinct or 0)
    release(spark)

    answers = replies.select("chunk", "range", "counts")
    run, schema = _statistic(total)
    held = F.col("chunk") < held_chunks
    gathered = dealt.where(held).groupBy("chunk").cogroup(answers.where(held).groupBy("chunk")).applyInArrow(run, schema)
    summed = gathered.groupBy("bin").agg(F.sum("found").alias("found"), F.sum("pair").alias("pair"), F.sum("word").alias("word")).toArrow()
    bins, found, pair, word = (summed.column(c).to_numpy() for c in ("bin", "found", "pair", "word"))
    weights = learn_weights(bins, found, pair / np.maximum(found, 1), word / np.maximum(found, 1), 1.0 / (distinct + 1))
    release(spark)

    run, schema = _scores(total, distinct, weights)
    scored = dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(run, schema)
    # each row as often as it stands for, in steps whose lists are bounded
    blocks = scored.withColumn("block", F.explode(F.expr("sequence(0L, (times - 1) div 65536)")))
    return blocks.withColumn("nth", F.explode(F.expr("sequence(1L, least(65536L, times - block * 65536))"))).drop("times", "block", "nth")
