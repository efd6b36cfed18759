import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import raking as R

from .helpers import documents, span_hash, words


def corpus(spark, count=4000):
    rng = random.Random(3)
    rows = []
    for i in range(count):
        source = rng.choice(["big"] * 6 + ["mid"] * 3 + ["tiny", None])
        lang = rng.choice(["en", "en", "en", "de", None])
        rows.append((i, " ".join(rng.choice(["harvest", "quantum", "guitar", "the", "of", "planet", "bridge"]) for _ in range(rng.randint(0, 30))), lang, source))
    return documents(spark, rows)


def test_margins_meet_targets():
    rng = np.random.default_rng(0)
    cells = [(s, l, t) for s in "abc" for l in ("x", "y") for t in range(4)]
    tokens = rng.integers(1, 1000, len(cells)).astype(float)
    targets = {"source": {"a": 0.5, "b": 0.3, "c": 0.2}, "lang": {"x": 0.6, "y": 0.4}, "topic": {t: 0.25 for t in range(4)}}
    weight = R.rake(cells, tokens, targets)
    for m, name in enumerate(R.MARGINS):
        for value, share in targets[name].items():
            got = sum(w for c, w in zip(cells, weight, strict=True) if c[m] == value) / weight.sum()
            assert got == pytest.approx(share, abs=1e-6)
    # raking keeps the odds ratios of the table
    at = {c: k for k, c in enumerate(cells)}
    odds = lambda v, t: v[at["a", "x", t]] * v[at["b", "y", t]] / (v[at["a", "y", t]] * v[at["b", "x", t]])
    assert odds(weight, 1) == pytest.approx(odds(tokens, 1), rel=1e-6)


def test_probabilities_spend_the_budget():
    tokens, weight = np.array([100.0, 50.0, 10.0, 0.0]), np.array([40.0, 60.0, 60.0, 0.0])
    p = R.probabilities(tokens, weight, 0.5)
    assert (p * tokens).sum() == pytest.approx(80) and p.max() <= 1 and p[3] == 1
    assert R.probabilities(np.zeros(2), np.zeros(2), 0.5).tolist() == [1, 1]


def test_sample(spark):
    docs = corpus(spark)
    out = R.sampled_documents(docs).cache()
    rows = out.collect()
    assert len(rows) == 4000
    for r in rows[:300]:
        w = [x for x in words(r.text) if len(x.encode()) >= 6]
        assert r.n_tokens == len(words(r.text)) and (w or r.topic == 0)
    total = sum(r.n_tokens for r in rows)
    assert sum(r.n_tokens * r.probability for r in rows) == pytest.approx(R.KEPT_TOKENS * total, rel=1e-6)
    assert sum(r.n_tokens for r in rows if r.kept) == pytest.approx(R.KEPT_TOKENS * total, rel=0.05)
    share = lambda s, key: sum(r.n_tokens for r in rows if key(r) and r.source == s) / sum(r.n_tokens for r in rows if key(r))
    assert share("tiny", lambda r: r.kept) > 1.1 * share("tiny", lambda r: True)
    again = {r.doc_id for r in R.sampled_documents(docs.repartition(7)).where("kept").collect()}
    assert again == {r.doc_id for r in rows if r.kept}


def test_frames_agree_with_driver(spark, monkeypatch):
    docs = corpus(spark, 1500)
    near = {r.doc_id: r.probability for r in R.sampled_documents(docs).collect()}
    monkeypatch.setattr(R, "DRIVER_CELLS", -1)
    far = {r.doc_id: r.probability for r in R.sampled_documents(docs).collect()}
    assert all(far[k] == pytest.approx(p, abs=2e-3) for k, p in near.items())


def test_edges(spark):
    docs = documents(spark, [(1, None, None, None), (None, "abc def", "en", "a"), (None, None, None, "a"), (2, "word " * 100000, "en", "a"), (2, "x", "en", "a")])
    for name in ("n_tokens", "topic", "weight", "probability", "kept"):
        docs = docs.withColumn(name, F.lit("clash"))
    rows = R.sampled_documents(docs).collect()
    assert len(rows) == 5 and all(0 <= r.probability <= 1 for r in rows) and all(r.kept for r in rows if r.n_tokens == 0)
    assert R.sampled_documents(documents(spark, [])).count() == 0


def test_frames_take_targets(spark, monkeypatch):
    """Beyond the driver's cells the fit is the same: targets, convergence, caps; a cell without words is no error."""
    docs = corpus(spark, 400).union(documents(spark, [(-1, "", "xx", "empty"), (-2, None, "en", "empty")]))
    targets = {"source": {"big": 0.2, "mid": 0.3, "tiny": 0.5}, "lang": {"en": 0.5, "de": 0.5}}
    near = {r.doc_id: r for r in R.sampled_documents(docs, targets).collect()}
    monkeypatch.setattr(R, "DRIVER_CELLS", -1)
    far = {r.doc_id: r for r in R.sampled_documents(docs, targets).collect()}
    assert set(near) == set(far) and {r.probability for r in near.values()} > {1.0}
    for k, r in near.items():
        assert far[k].probability == pytest.approx(r.probability, abs=1e-6) and far[k].weight == pytest.approx(r.weight, rel=1e-5, abs=1e-9)
        assert far[k].kept == r.kept


def test_against_plain_python(spark):
    """Topics, cells, raked weights, capped probabilities and the choice, document by document."""
    import xxhash

    docs = corpus(spark, 600)
    got = {r.doc_id: r for r in R.sampled_documents(docs, kept=0.6).collect()}
    rows = docs.collect()
    topic, size, cell = {}, {}, {}
    for r in rows:
        classes = [span_hash(w.encode()) % R.TOPICS for w in words(r.text) if len(w.encode()) >= 6]
        topic[r.doc_id] = max(range(R.TOPICS), key=lambda t: (classes.count(t), -t))
        size[r.doc_id] = len(words(r.text))
        cell[r.doc_id] = (r.source, r.lang, topic[r.doc_id])
    tokens = {}
    for i, c in cell.items():
        tokens[c] = tokens.get(c, 0) + size[i]
    total = sum(tokens.values())
    weight = {c: float(t) for c, t in tokens.items()}
    for _ in range(400):
        for m, name in enumerate(R.MARGINS):
            own = {}
            for c, t in tokens.items():
                own[c[m]] = own.get(c[m], 0) + t
            raised = {v: (t / total) ** R.TEMPER[name] for v, t in own.items() if t}
            now = {}
            for c, w in weight.items():
                now[c[m]] = now.get(c[m], 0) + w
            for c in weight:
                aim = raised.get(c[m], 0) / sum(raised.values()) * total
                weight[c] *= aim / now[c[m]] if now[c[m]] else 0
    ratio = {c: weight[c] / tokens[c] if tokens[c] else 0.0 for c in tokens}
    capped = set()
    while True:
        scale = (0.6 * total - sum(tokens[c] for c in capped)) / sum(ratio[c] * tokens[c] for c in tokens if c not in capped)
        over = {c for c in tokens if c not in capped and ratio[c] * scale >= 1}
        if not over:
            break
        capped |= over
    assert capped
    for i, r in got.items():
        c = cell[i]
        chance = 1.0 if not tokens[c] or c in capped else ratio[c] * scale
        assert (r.topic, r.n_tokens) == (topic[i], size[i]) and r.probability == pytest.approx(chance, rel=1e-6) and r.weight == pytest.approx(ratio[c] if tokens[c] else 1.0, rel=1e-6)
        h = xxhash.xxh64_intdigest((29).to_bytes(4, "little"), xxhash.xxh64_intdigest(str(i).encode(), 42))
        h -= (h >> 63) << 64
        assert r.kept == (h % (1 << 53) / (1 << 53) < r.probability or size[i] == 0)
