import collections
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import interpolated_lm as L
from ledgerloom.llm.common import table

from .helpers import documents, words


def brute(rows, weights=None):
    """Counts, base scores and, given the weights of buckets, the scores of the model."""
    tokens = [(i, [*words(t), None]) for i, t in rows]
    learn = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 != 2
    one, two = collections.Counter(), collections.Counter()
    for i, w in tokens:
        if learn(i):
            one.update(w)
            two.update(zip(["<s>", *w[:-1]], w, strict=True))
    total, distinct = sum(one.values()), len(one)
    out = []
    for i, w in tokens:
        base = sum(math.log10((one[x] + 1) / (total + distinct + 1)) for x in w)
        score = 0.0
        for a, b in zip(["<s>", *w[:-1]], w, strict=True) if weights is not None else ():
            context = one[None] if a == "<s>" else one[a]
            l2, l1, l0 = weights[min(math.frexp(context)[1], L.BUCKETS - 1)]
            score += math.log10(l2 * two[a, b] / max(context, 1) + l1 * one[b] / max(total, 1) + l0 / (distinct + 1))
        out.append((i, len(w), sum(one[x] > 0 for x in w), total, base, score))
    return out


def learned(monkeypatch):
    seen = []
    original = L.learn_weights
    monkeypatch.setattr(L, "learn_weights", lambda *a: seen.append(original(*a)) or seen[-1])
    return seen


@pytest.mark.parametrize("chunk", [8 << 20, 60_000])
def test_against_counters(spark, sf_dir, monkeypatch, chunk):
    seen = learned(monkeypatch)
    monkeypatch.setattr(L, "CHUNK_BYTES", chunk)
    docs = table(spark, sf_dir, "documents")
    got = {r.doc_id: r for r in L.lm_scores(docs).collect()}
    for i, n, known, total, base, score in brute([(r.doc_id, r.text) for r in docs.collect()], seen[0]):
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (n, known, total, zlib.crc32(str(i).encode()) % 7 == 2)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score == pytest.approx(score, rel=1e-9)


def test_repeated_rows_are_put_together(spark, monkeypatch):
    """Rows that would fill a chunk count as often as they occur, and each gets its row."""
    monkeypatch.setattr(L, "CHUNK_BYTES", 2000)
    rows = [(1, "a b c " * 20)] * 300 + [(2, "a c")] * 3 + [(None, None)] * 300 + [(k, f"b c w{k}") for k in range(3, 60)]
    seen = learned(monkeypatch)
    got = sorted((str(r.doc_id), r.n_tokens, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in L.lm_scores(documents(spark, rows)).collect())
    assert got == sorted((str(i), n, k, round(b, 6), round(s, 6)) for i, n, _, k, b, s in brute(rows, seen[0]))


def test_weights_do_not_depend_on_the_chunks(spark, sf_dir, monkeypatch):
    seen = learned(monkeypatch)
    docs = table(spark, sf_dir, "documents")
    for chunk in (8 << 20, 100_000):
        monkeypatch.setattr(L, "CHUNK_BYTES", chunk)
        L.lm_scores(docs).count()
    assert np.allclose(seen[0], seen[1])


def test_words_that_collide_in_polynomial_hashes(spark):
    from .test_token_shards import twins

    rows = [(k, f"{w} x {w}") for k, w in enumerate(w for n in (1024, 2048, 4096) for w in twins(n))]
    got = {r.doc_id: r for r in L.lm_scores(documents(spark, rows)).collect()}
    for i, n, known, total, base, _ in brute(rows):
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (n, known, total) and got[i].base_score == pytest.approx(base, rel=1e-9)


def test_better_than_base_on_held_out(spark):
    held = [r for r in L.lm_scores(table(spark, "/root/testdata/sf0.01", "documents")).collect() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_expectation_maximisation():
    """The weights are those that make held-out tokens likeliest: no small change is better."""
    rng = np.random.default_rng(0)
    bins = rng.integers(0, 3, 500) * L.BINS * L.BINS
    found, pair, word = rng.integers(1, 50, 500), rng.random(500) * (rng.random(500) < 0.5), rng.random(500) * 0.01
    w = L.learn_weights(bins, found, pair, word, 1e-3)
    assert np.allclose(w.sum(axis=1), 1)
    for b in range(3):
        own = bins == b * L.BINS * L.BINS
        p = np.stack([pair[own], word[own], np.full(own.sum(), 1e-3)], axis=1)
        value = lambda v: (found[own] * np.log(p @ v)).sum()
        for _ in range(50):
            other = np.abs(w[b] + rng.normal(0, 0.02, 3))
            assert value(w[b]) >= value(other / other.sum()) - 1e-4


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "A a\tB"), (None, "a b c"), (5, "x " * 100000), (5, "x " * 100000), (6, "é É ß")]
    docs = documents(spark, rows)
    for name in ("chunk", "learn", "counts", "ids", "range", "score"):
        docs = docs.withColumn(name, F.lit(1))
    got = sorted(((r.doc_id or -1, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in L.lm_scores(docs).collect()))
    assert got == sorted((i or -1, n, k, t, round(b, 6)) for i, n, k, t, b, _ in brute(rows))
    assert L.lm_scores(documents(spark, [])).count() == 0
    lonely = L.lm_scores(documents(spark, [(None, "a b")])).first()
    assert lonely.train_tokens == 0 and lonely.held_out is None and lonely.base_score == 0
