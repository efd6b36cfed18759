import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import hnsw
from ledgerloom.llm.common import table


def brute(rows, every, k):
    rows = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and len(v) and None not in v and np.isfinite(np.array(v, float)).all() and np.any(np.array(v, float))]
    out = {}
    for q, x in rows:
        if q % every == 0:
            best = {}
            for i, y in rows:
                if i != q and len(y) == len(x):
                    best[i] = max(best.get(i, -2.0), float(x @ y / np.sqrt((x @ x) * (y @ y))))
            out[q] = sorted(best.items(), key=lambda p: (-round(p[1], 12), p[0]))[:k]
    return out


def test_recall(spark):
    df = table(spark, "/root/testdata/sf0.01", "embeddings")
    got = {}
    for r in hnsw.nearest(df).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    want = brute([(r.vec_id, r.embedding) for r in df.collect()], 50, 5)
    assert set(got) == set(want) and all(sorted(g) == [1, 2, 3, 4, 5] for g in got.values())
    found = sum(len({v for v, _ in got[q].values()} & {v for v, _ in want[q]}) for q in want)
    assert found / sum(len(w) for w in want.values()) >= 0.9
    for q, w in want.items():
        scores = dict(w)
        assert all(s == pytest.approx(scores[v], abs=1e-12) for v, s in got[q].values() if v in scores)


def test_many_shards(spark, monkeypatch):
    monkeypatch.setattr(hnsw, "SHARD_VECTORS", 300)
    monkeypatch.setattr(hnsw, "BLOCK_QUERIES", 7)
    rng = np.random.default_rng(0)
    centres = rng.standard_normal((20, 16))
    rows = [(i, (centres[i % 20] + 0.5 * rng.standard_normal(16)).tolist()) for i in range(2000)]
    got = hnsw.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    want = brute(rows, 50, 5)
    found = {}
    for r in got:
        found.setdefault(r.query_id, set()).add(r.vec_id)
    hit = sum(len(found[q] & {v for v, _ in w}) for q, w in want.items())
    assert hit / (5 * len(want)) >= 0.9 and len(got) == 5 * len(want)


def test_edges(spark):
    inf, nan = float("inf"), float("nan")
    rows = [
        (0, [1.0, 0.0]), (50, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0]), (4, [-1.0, 0.0]), (5, None), (6, []), (7, [0.0, 0.0]), (8, [None, 1.0]), (9, [inf, 1.0]), (10, [nan, 1.0]),
        (None, [1.0, 0.0]), (100, [1.0, 2.0, 3.0]), (-50, [0.0, 2.0]), (11, [-0.0, 5.0]), (50, [0.0, 1.0]),
    ] + [(1000 + i, [3.0, 4.0]) for i in range(0, 40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("dim", F.lit(1)).withColumn("score", F.lit("x")).withColumn("ids", F.lit(0))
    got = {}
    for r in sorted(hnsw.nearest(df).collect(), key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    want = {q: w for q, w in brute(rows, 50, 5).items() if w}
    for q in (0, -50, 1000):
        assert [v for v, _ in got[q]] == [v for v, _ in want[q]]
    assert 100 not in got and {v for v, _ in got[50]} <= {r[0] for r in rows}
    assert [v for v, _ in got[0]] == [1, 2, 50, 1000, 1001]


def test_empty(spark):
    assert hnsw.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    one = spark.createDataFrame([(0, [1.0])], "vec_id long, embedding array<float>")
    assert hnsw.nearest(one).count() == 0


def test_flat_arrays_round_trip():
    rng = np.random.default_rng(1)
    unit = hnsw._unit(rng.standard_normal((400, 8)))
    g = hnsw.Graph(unit)
    again = hnsw.Graph.load(unit, g.flat())
    assert all(g.search(unit[k], 20) == again.search(unit[k], 20) for k in range(50))


def test_extreme_components(spark):
    """Vectors whose squares overflow or vanish have the neighbours of their directions."""
    rng = np.random.default_rng(4)
    unit = rng.normal(size=(120, 6))
    scale = np.where(np.arange(120) % 3 == 0, 1e300, np.where(np.arange(120) % 3 == 1, 1e-300, 1.0))
    rows = [(i, [float(c) for c in v * s]) for i, (v, s) in enumerate(zip(unit, scale, strict=True))]
    got = {}
    for r in hnsw.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), every=10).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    want = brute([(i, list(v)) for i, v in enumerate(unit)], 10, 5)
    assert set(got) == set(want)
    for q, w in want.items():
        assert [v for _, v, _ in sorted(got[q])] == [v for v, _ in w] and all(s == pytest.approx(x, abs=1e-9) for (_, _, s), (_, x) in zip(sorted(got[q]), w, strict=True))
