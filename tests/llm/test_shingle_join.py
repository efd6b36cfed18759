import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import shingle_join as J
from ledgerloom.llm.components import components

from .helpers import documents, groups


def check(spark, rows, size=4, percent=85):
    got = J.linked_documents(documents(spark, rows), size, percent).collect()
    assert len(got) == len(rows)
    want, sizes = groups(dict(rows), size, percent)
    assert {r.doc_id: r.component_id for r in got} == want
    assert {r.doc_id: r.n_shingles for r in got} == sizes


def corpus(seed, count, vocabulary=400):
    """Texts, families of edited copies, texts that are mostly shared passages, and short ones."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randint(0, vocabulary)}"
    text = lambda n: [word() for _ in range(n)]
    passages = [text(rng.randint(20, 60)) for _ in range(4)]
    out = []
    while len(out) < count:
        kind = rng.random()
        base = text(rng.randint(1, 120))
        if kind < 0.3:
            out.append(base)
        elif kind < 0.6:
            for _ in range(rng.randint(2, 14)):
                copy = list(base)
                for _ in range(rng.randint(0, 3)):
                    copy[rng.randrange(len(copy))] = word()
                out.append(copy)
        elif kind < 0.9:
            some = [x for p in rng.sample(passages, rng.randint(1, 3)) for x in p]
            out.append(text(rng.randint(0, 12)) + some + text(rng.randint(0, 12)))
        else:
            out.append(base[: rng.randint(1, 8)])
    rng.shuffle(out)
    return [(i, " ".join(x)) for i, x in enumerate(out[:count])]


@pytest.mark.parametrize(("seed", "size", "percent"), [(1, 4, 85), (2, 5, 80), (3, 2, 60)])
def test_against_brute_force(spark, seed, size, percent):
    check(spark, corpus(seed, 500), size, percent)


def test_everything_frequent(spark, monkeypatch):
    monkeypatch.setattr(J, "FREQUENT", 1)
    check(spark, corpus(4, 300))


def test_nothing_frequent(spark, monkeypatch):
    monkeypatch.setattr(J, "MOST_FREQUENT", 0)
    check(spark, corpus(5, 300))


def test_signatures_meet(spark):
    """Any two sets that reach the threshold share an index entry, whatever is frequent."""
    rng = np.random.default_rng(0)
    for _ in range(400):
        n = int(rng.integers(1, 200))
        x = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2))
        n, drop = len(x), int(rng.integers(0, J.missing(len(x), 85) + 1))
        y = np.sort(rng.permutation(x)[: n - drop])
        room = int(100 * len(y) / 85) - n
        if room > 0:
            y = np.unique(np.concatenate([y, rng.integers(0, 1 << 63, int(rng.integers(0, room + 1))).astype(np.uint64)]))
        shared = len(np.intersect1d(x, y))
        if 100 * shared < 85 * (len(x) + len(y) - shared) or (len(x) == len(y) == shared):
            continue
        share = rng.random()
        hot = np.unique(np.concatenate([x, y]))
        hot = hot[rng.random(len(hot)) < share]
        a, b = J.signatures(x, np.isin(x, hot), 85), J.signatures(y, np.isin(y, hot), 85)
        assert len(np.intersect1d(a, b)), (len(x), len(y), shared, share)


def test_bitmaps_bound_differences():
    rng = np.random.default_rng(1)
    for _ in range(200):
        x, y = (np.unique(rng.integers(0, 2000, int(rng.integers(1, 900))).astype(np.uint64) * J._A) for _ in range(2))
        assert J.least_difference(J.parity(x), J.parity(y)) <= len(np.setxor1d(x, y))


def test_edges(spark):
    rows = [(0, None), (1, ""), (2, " \n\t "), (3, "A b"), (4, "a B"), (5, "a b c d"), (6, "A\tB C\x0bd"), (7, "a b"), (8, "x " * 30000), (9, "x " * 29000), (10, "Ä b"), (11, "ä b")]
    check(spark, rows)


def test_empty_and_clashing_columns(spark):
    assert J.linked_documents(documents(spark, [])).count() == 0
    clash = documents(spark, [(1, "a b c d e"), (2, "a b c d e")])
    for name in ("n", "key", "entry", "component_id", "rep", "token"):
        clash = clash.withColumn(name, F.lit("z"))
    assert sorted(map(tuple, J.linked_documents(clash).select("doc_id", "component_id").collect())) == [(1, 1), (2, 1)]


def test_repeats_and_null_ids(spark):
    rows = [(5, "a b c d e f"), (5, "p q r s t u"), (7, "p q r s t u"), (9, "a b c d e f"), (None, "a b c d e f"), (None, None), (3, "z z z z")]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in J.linked_documents(documents(spark, rows)).collect()), key=str)
    assert got == sorted([(5, 3, 5), (5, 3, 5), (7, 3, 5), (9, 3, 5), (None, 3, None), (None, 0, None), (3, 1, 3)], key=str)


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(100, 300)] + [(7, 7), (50, 40)], "a long, b long")
    got = {r.node: r.root for r in components(links).collect()}
    assert got == {**{i: 100 for i in range(100, 301)}, 7: 7, 50: 40, 40: 40}
    assert components(links.where("a < 0")).count() == 0


def test_large_groups_in_blocks(spark, monkeypatch):
    """Groups of more members than a block give the same links as whole ones."""
    rng = random.Random(8)
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(40)]
    texts = {}
    for i in range(120):
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = f"v{rng.randint(0, 10**6)}"
        texts[i] = " ".join(w)
    monkeypatch.setattr(J, "BLOCK", 7)
    got = {r.doc_id: r.component_id for r in J.linked_documents(documents(spark, list(texts.items())), 2, 70).collect()}
    assert got == groups(texts, 2, 70)[0]


def test_words_that_collide_in_polynomial_hashes(spark):
    from .test_token_shards import twins

    texts = {k: f"{w} a b c" for k, w in enumerate(w for n in (1024, 2048, 4096) for w in twins(n))}
    got = {r.doc_id: r.component_id for r in J.linked_documents(documents(spark, list(texts.items())), 4, 85).collect()}
    assert got == {k: k for k in texts}
