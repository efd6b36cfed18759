import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerloom.llm import token_shards as S
from ledgerloom.llm.common import new_folder, table

from .helpers import documents

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    "a  b", "x\n\ny", " lead", "trail ", "tab\there a b", "don't we'll", "<|endoftext|> a b", "\n", "", None, "  ", "a \n b", "é è\r\nz q", "1 2  3 <|endoftext|>", "q r s", "“x” y", "日本 語\nあ", "a  b",
    "word " * 20000 + "end", "x" * 5000,
]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def ids(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]


def test_round_trip(spark, sf_dir, tokenizer):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").union(spark.createDataFrame([(10**12 + k, t) for k, t in enumerate(ODD)], "doc_id long, text string"))
    got = {r.doc_id: r for r in S.token_shards(docs.repartition(5)).collect()}
    at = 0
    for r in sorted(docs.collect(), key=lambda r: r.doc_id):
        want, mine = ids(tokenizer, r.text), got[r.doc_id]
        assert (mine.start, mine.n_tokens, mine.ids_crc32) == (at, len(want), zlib.crc32(np.array(want, "<u4").tobytes()))
        at += len(want)


def twins(n):
    """Two words of n characters that a polynomial hash modulo 2^64 cannot tell apart."""
    swap, a = str.maketrans("ab", "ba"), "a"
    while len(a) < n:
        a += a.translate(swap)
    return a, a.translate(swap)


def test_words_that_collide_in_polynomial_hashes(tokenizer):
    coder = S.Encoder(PATH)
    texts = [f"say {w} now\n{w}" for n in (16, 32, 1024, 2048, 4096) for w in twins(n)]
    for some in (texts, texts[::-1], texts[:1], texts[1:2]):
        raw = [t.encode() for t in some]
        data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.r_[0, np.cumsum([len(t) for t in raw])]
        got = coder.encode(data, offsets)
        assert [g.tolist() for g in got] == [tokenizer.encode(t, add_special_tokens=False).ids for t in some]


def test_any_collision_is_noticed(tokenizer, monkeypatch):
    """With a hash of four values the ids are still right: pieces are compared byte for byte."""
    monkeypatch.setattr(S, "hash_spans", lambda data, start, end, eight: (end - start).astype(np.uint64) % np.uint64(4))
    coder = S.Encoder(PATH)
    for some in (["one two six ten", "two one ten six"], ["six six nine\nzero one"], ["a" * 40 + " " + "b" * 40]):
        raw = [t.encode() for t in some]
        data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.r_[0, np.cumsum([len(t) for t in raw])]
        assert [g.tolist() for g in coder.encode(data, offsets)] == [tokenizer.encode(t, add_special_tokens=False).ids for t in some]


def test_other_tokenizers_encode_whole_texts(tmp_path, tokenizer):
    from tokenizers import normalizers

    other = Tokenizer.from_file(PATH)
    other.normalizer = normalizers.Lowercase()
    other.save(str(tmp_path / "t.json"))
    coder = S.Encoder(str(tmp_path / "t.json"))
    assert S.Encoder(PATH).in_pieces and not coder.in_pieces
    raw = "Some WORDS here".encode()
    assert coder.encode(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0].tolist() == other.encode(raw.decode(), add_special_tokens=False).ids


def test_repeated_rows_are_split(spark, monkeypatch, tokenizer):
    monkeypatch.setattr(S, "SHARD_BYTES", 2000)
    same = spark.range(400, numPartitions=8).select(F.lit(None).cast("long").alias("doc_id"), F.lit("the same words " * 5).alias("text"))
    manifest = S.write_shards(same, PATH, new_folder(spark, "test")).collect()
    assert len(manifest) > 3 and sum(r.docs for r in manifest) == 400


def test_lookup_over_several_shards(spark, monkeypatch, tokenizer):
    monkeypatch.setattr(S, "SHARD_BYTES", 2000)
    rows = [(i * 3 - 150, f"text number {i} " * (i % 9)) for i in range(200)] + [(6, "again"), (6, "again"), (None, "no name"), (None, None)]
    manifest = S.write_shards(documents(spark, rows), PATH, new_folder(spark, "test"))
    shards = manifest.orderBy("shard").collect()
    assert len(shards) > 3 and sum(r.docs for r in shards) == len(rows)
    tables = []
    for r in shards:
        store, place = S._open(r.path)
        tables.append(S.Table(store.open_input_file(place)))
    for i, text in rows:
        found = [list(x) for t in tables for x in t.get(i)]
        assert ids(tokenizer, text) in [list(map(int, f)) for f in found]
    assert sum(len(t.get(6)) for t in tables) == 3 and sum(len(t.get(None)) for t in tables) == 2
    assert not any(t.get(7) for t in tables)
    order = [k for t in tables for k, _ in t.scan()]
    assert order == sorted(order, key=lambda k: (k is not None, k or 0)) and order[:2] == [None, None]


def test_many_blocks(tmp_path, monkeypatch):
    monkeypatch.setattr(S, "BLOCK_BYTES", 300)
    with open(tmp_path / "t", "wb") as f:
        w = S.Writer(f, 4)
        for i in range(-500, 500):
            for _ in range(2 if i == 7 else 1):
                w.add(S.encode_key(i), np.arange(i % 13, dtype="<u4").tobytes())
        w.close()
    with open(tmp_path / "t", "rb") as f:
        t = S.Table(f)
        assert len(t.blocks) > 50 and t.docs == 1001
        assert all([list(x) for x in t.get(i)] == [list(range(i % 13))] * (2 if i == 7 else 1) for i in range(-500, 500))
        assert t.get(500) == [] and [k for k, _ in t.scan()] == sorted([*range(-500, 500), 7])


def test_damage_is_noticed(tmp_path):
    with open(tmp_path / "t", "wb") as f:
        w = S.Writer(f, 2)
        w.add(S.encode_key(1), b"ab")
        with pytest.raises(ValueError, match="ascend"):
            w.add(S.encode_key(0), b"")
        w.close()
    data = bytearray((tmp_path / "t").read_bytes())
    data[-80] ^= 1
    (tmp_path / "t").write_bytes(data)
    with pytest.raises(ValueError, match="damaged"), open(tmp_path / "t", "rb") as f:
        S.Table(f)


def test_empty_and_extra_columns(spark):
    assert S.token_shards(documents(spark, [])).count() == 0
    clash = documents(spark, [(1, "a"), (2, None)])
    for name in ("tie", "shard", "path", "start", "n_tokens"):
        clash = clash.withColumn(name, F.lit(5))
    assert sorted((r.doc_id, r.n_tokens) for r in S.token_shards(clash).collect()) == [(1, 2), (2, 1)]
