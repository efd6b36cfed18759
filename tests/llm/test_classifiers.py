import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import byte_lang_id, byte_quality
from ledgerloom.llm.byte_conv import ByteConv, lay_out
from ledgerloom.llm.common import table

from .helpers import documents


@pytest.fixture(scope="module")
def large():
    return "/root/testdata/sf0.01"


def test_held_out_languages(spark, large):
    docs = table(spark, large, "documents")
    got = byte_lang_id.predict_languages(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert len(got) == docs.count() and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_held_out_quality(spark, large):
    docs, labels = table(spark, large, "documents"), table(spark, large, "labels")
    got = byte_quality.quality_scores(docs, labels).join(labels, "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert sum(r.quality == r.predicted for r in held) / len(held) > 0.95
    good, bad = ([r.score for r in held if r.quality == q] for q in (1, 0))
    assert sum(g > b for g in good for b in bad) / (len(good) * len(bad)) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)


def test_language_edges(spark):
    rows = [(i, "the cat and the dog were there with them", "en") for i in range(0, 60, 2)] + [(i, "der hund und die katze waren nicht hier", "de") for i in range(1, 60, 2)]
    odd = [(100, None), (101, ""), (102, "1234 !!! ###"), (103, "\U0001f600"), (104, "the and with " * 30000), (None, "der und nicht die katze"), (105, "x")]
    docs = documents(spark, rows + [(i, t, None) for i, t in odd] + [(100, None, "fr")])
    for name in ("held_out", "pieces", "score", "lang_pred"):
        docs = docs.withColumn(name, F.lit(1))
    got = byte_lang_id.predict_languages(docs).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows) + len(odd) + 1
    assert [by[k].lang_pred for k in (100, 101, 102, 103)] == ["und"] * 4 and by[100].score == 0
    assert by[104].lang_pred == "en" and by[None].lang_pred == "de" and by[None].held_out is None and by[105].lang_pred in ("en", "de")


def test_nothing_to_learn(spark):
    docs = documents(spark, [(1, "abc", None), (2, None, None)])
    assert {r.lang_pred for r in byte_lang_id.predict_languages(docs).collect()} == {"und"}
    assert byte_lang_id.predict_languages(docs.limit(0)).count() == 0
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in byte_quality.quality_scores(docs, none).collect()} == {0.5}
    one = spark.createDataFrame([(2, 1, 0), (2, 1, 0), (None, 1, 0), (1, None, 0)], "doc_id long, quality int, toxic int")
    assert {r.score for r in byte_quality.quality_scores(docs, one).collect()} <= {1.0, 0.5}
    assert byte_quality.quality_scores(docs.limit(0), one).count() == 0


def test_whole_text_counts(spark):
    """What comes after the first window changes the score."""
    good, bad = "plain words in a calm sentence. ", "BUY!! NOW!! $$$ ### "
    rows = [(i, (good if i % 2 else bad) * 40) for i in range(120)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(120)], "doc_id long, quality int, toxic int")
    tests = [(200, good * 200), (201, good * 60 + bad * 300), (202, None), (203, "")]
    got = {r.doc_id: r for r in byte_quality.quality_scores(documents(spark, rows + tests), labels).collect()}
    assert got[200].predicted == 1 and got[201].predicted == 0 and got[202].score == got[203].score


def test_labelled_rows_are_bounded_after_the_join(spark, monkeypatch):
    seen = []
    original = byte_quality.train
    monkeypatch.setattr(byte_quality, "TRAINING_ROWS", 50)
    monkeypatch.setattr(byte_quality, "train", lambda df: seen.append(df.count()) or original(df))
    learned = next(i for i in range(20) if zlib.crc32(str(i).encode()) % 3 != 1)
    docs = documents(spark, [(learned, f"text {i}") for i in range(3000)])
    labels = spark.createDataFrame([(learned, 1, 0), (learned, 0, 0), (learned, 1, 0)], "doc_id long, quality int, toxic int")
    assert byte_quality.quality_scores(docs, labels).count() == 3000 and seen == [50]


def test_pieces_are_drawn_from_whole_texts(spark):
    from ledgerloom.llm.byte_lang_id import pieces

    texts = ["", "a", "x" * 10, "".join(chr(97 + i % 26) for i in range(35)), "".join(chr(0x3B1 + i % 20) for i in range(1000))]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").select("doc_id", pieces("text", "doc_id", 4, 10).alias("p")).collect()
    for r in rows:
        every = [texts[r.doc_id][k : k + 10] for k in range(0, max(1, len(texts[r.doc_id])), 10)]
        assert (r.p == every) if len(every) <= 4 else (len(r.p) == 4 and set(r.p) <= set(every))
    # over many texts the draw reaches all parts alike, the last one too
    many = spark.range(2000).selectExpr("id AS doc_id", "concat(repeat('a', 90), repeat('z', 5)) AS text").select(pieces("text", "doc_id", 2, 10).alias("p"))
    last = sum("z" in p for r in many.collect() for p in r.p)
    assert 300 < last < 500


def test_network_against_plain_loops():
    """Windows, filters, maximum and sum of a small network, place by place."""
    net = ByteConv({2: 3, 4: 2}, 3, 16, seed=3)
    net.bias[:] = np.linspace(-0.2, 0.2, 5)
    for text in (b"", b"a", b"some words of a text that is longer than a window", b"x" * 16, b"\xff" * 33):
        got = net.logits(*lay_out([text], 16, 4))
        size = max(1, -(-(len(text) + 3) // 16))
        raw = text.ljust(size * 16 + 4, b"\0")
        assert len(got) == size
        for k in range(size):
            pooled = []
            for w, tables in net.tables.items():
                ends = 16 - w + 1 if k == size - 1 else 16
                for f in range(tables.shape[2]):
                    pooled.append(max(sum(float(tables[j, raw[16 * k + i + j], f]) for j in range(w)) for i in range(ends)))
            hidden = [max(0.0, p + float(b)) for p, b in zip(pooled, net.bias, strict=True)]
            want = [sum(h * float(net.weight[i, c]) for i, h in enumerate(hidden)) + float(net.offset[c]) for c in range(3)]
            assert np.allclose(got[k], want, atol=1e-4)


def test_windows_cover_texts():
    texts = [b"", b"a", b"x" * 255, b"y" * 256, b"z" * 1000]
    buffer, owner = lay_out(texts, 256, 5)
    assert bytes(buffer).count(b"z") == 1000 and sorted(set(owner.tolist())) == list(range(5))
    net = ByteConv({2: 4, 5: 4}, 2, 256)
    for k, t in enumerate(texts):  # a text's neighbours do not change its windows
        alone = net.logits(*lay_out([t], 256, 5))
        assert abs(net.logits(buffer, owner)[owner == k] - alone).max() < 1e-4
