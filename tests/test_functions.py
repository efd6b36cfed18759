"""Golden values of hashes, codecs and bit arithmetic."""

import hashlib
import struct

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import bits, codecs, hashing as H
from ledgerloom.functions.ordered import numbered, previous, running_sum


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_pair_hash(spark):
    a, b = F.lit("hello").cast("binary"), F.lit("world").cast("binary")
    assert one(spark, H.hash_pair(8, a, b)) == "8e6fc50a3f98a3c314021b89688ca83a9b5697ca956e211198625fc460ddf1e9"
    assert one(spark, H.hash_pair_swapped(8, b, a, F.lit(True))) == one(spark, H.hash_pair(8, a, b))


def test_first_proof_leaf(spark):
    """The payload of k12 = v1 at height 1 with number 4096."""
    prefix = int(hashlib.sha256(b"k12").hexdigest()[:4], 16) + 1
    after = F.unhex(F.lit(f"{prefix:04x}" + "0" * 60))
    head = F.concat(H.little_endian(F.lit(2 * 256 + 3), 4), F.unhex(F.lit("00")))
    payload = F.concat(head, F.lit("k12").cast("binary"), F.lit("v1").cast("binary"), after, H.little_endian(F.lit(1 << 24)), H.little_endian(F.lit(4096)))
    assert one(spark, F.sha2(payload, 256)) == "5db2d4382567accdffb827e75ee40ed2d1a57afdbb64050d37a9f6b5f7c99f98"


@pytest.mark.parametrize(("number", "text"), [(0, "00"), (0x12, "0112"), (0x1234, "021234"), (0x12005600, "0412005600")])
def test_var_int(spark, number, text):
    assert one(spark, codecs.var_int(F.lit(number))) == text
    assert codecs.put_var(number).hex() == text
    assert codecs.get_var(bytes.fromhex(text), 0) == (number, len(text) // 2)


def test_accounts(spark):
    rows = [((0x1234).to_bytes(32, "big"), 0x56, None), ((0x8899 << 200).to_bytes(32, "big"), 0x11223344, b"\x52" * 32), (None, 1, None)]
    df = spark.createDataFrame(rows, "b binary, n long, c binary")
    out = df.select(codecs.encode_account(F.col("b"), F.col("n"), F.col("c")).alias("e"), "b", "n", "c")
    got = out.withColumn("d", codecs.decode_account(F.col("e"))).collect()
    assert got[0].e.hex() == "0212340156"
    assert got[1].e.hex() == "1b8899" + "00" * 25 + "0411223344" + "52" * 32
    assert bytes(got[1].d.balance) == rows[1][0] and got[1].d.nonce == 0x11223344 and bytes(got[1].d.code) == b"\x52" * 32
    assert got[2].e is None and got[2].d.balance is None


def test_wide_sum(spark):
    rows = [(((1 << 255) + 5).to_bytes(32, "big"),), (((1 << 255) + 6).to_bytes(32, "big"),)]
    total = spark.createDataFrame(rows, "v binary").agg(codecs.sum_wide(F.col("v")).alias("s")).first().s
    assert int.from_bytes(total, "big") == 11


def test_keccak():
    assert codecs.keccak256(b"").hex() == "c5d2460186f7233c927e7db2dcc703c0e500b653ca82273b7bfad8045d85a470"
    assert codecs.keccak256(b"transfer(address,uint256)").hex().startswith("a9059cbb")
    assert codecs.keccak256(b"approve(address,uint256)").hex().startswith("095ea7b3")
    assert len(codecs.keccak256(b"x" * 500)) == 32


@pytest.mark.parametrize(("dust", "kept"), [(1, 1), ((1 << 47) + 1, (1 << 47) + 1), ((1 << 48) + 1, 1 << 48)])
def test_dust(spark, dust, kept):
    df = spark.range(1).select(F.lit(dust).cast("bigint").alias("d")).withColumn("s", bits.dust_shift(F.col("d")).cast("int"))
    assert df.select(F.expr("shiftleft(shiftright(d, s), s)").alias("k")).first().k == kept


@pytest.mark.parametrize(("twig", "level"), [(0, 12), (1, 13), (2, 14), (3, 14), (4, 15), (255, 20), (65535, 28)])
def test_max_level(spark, twig, level):
    assert one(spark, bits.max_level(F.lit(twig))) == level


def test_compaction(spark):
    rows = [(n,) for n in range(1, 21)]
    df = spark.createDataFrame(rows, "live long").where(bits.compactible(F.col("live"), F.lit(0), F.lit(20), 10, 7, 10))
    assert sorted(r.live for r in df.collect()) == [10, 11, 12, 13, 14]


def test_bloom_probes(spark):
    key = "p17"
    number = int(hashlib.sha256(key.encode()).hexdigest()[:16], 16)
    got = spark.range(1).select(*[p.alias(f"b{k}") for k, p in enumerate(bits.probes(H.short_hash(F.lit(key))))]).first()
    assert list(got) == [number >> 11 * k & 2047 for k in range(5)]


def test_little_endian(spark):
    assert bytes(one(spark, H.little_endian(F.lit(12345)))) == struct.pack("<q", 12345)
    assert bytes(one(spark, H.little_endian(F.lit(-2)))) == struct.pack("<q", -2)
    assert one(spark, H.from_little_endian(F.unhex(F.lit("665544332211")), 6)) == 0x112233445566


def test_key_hash_cases(spark):
    empty, key, value = F.lit("").cast("binary"), F.unhex(F.lit("2005" + "00" * 30)), F.lit("v").cast("binary")
    assert one(spark, H.entry_key_hash(empty, value)) == "0" * 64
    assert one(spark, H.entry_key_hash(key, empty)) == "2005" + "0" * 60
    assert one(spark, H.entry_key_hash(F.lit("k").cast("binary"), value)) == hashlib.sha256(b"k").hexdigest()


def test_ordered_helpers(spark):
    import random

    rng = random.Random(3)
    rows = [(rng.choice("ab"), i // 7, i, rng.randint(0, 9)) for i in range(200)]
    df = spark.createDataFrame(rows, "g string, bucket long, i long, v long")
    out = numbered(df, ["g"], "bucket", ["i"], "n")
    out = running_sum(out, ["g"], "bucket", ["i"], "v", "s")
    out = previous(out, ["g"], "bucket", ["i"], "v", "p")
    state = {}
    for r in sorted(out.collect(), key=lambda r: r.i):
        n, s, p = state.get(r.g, (0, 0, None))
        assert (r.n, r.s, r.p) == (n, s, p)
        state[r.g] = (n + 1, s + r.v, r.v)


def test_var_int_read_again(spark):
    rows = spark.createDataFrame([(x,) for x in (0, 1, 255, 256, 0x12005600, 2**63 - 1)], "n long").withColumn("again", codecs.read_var_int(codecs.var_int(F.col("n"))))
    assert all(r.n == r.again for r in rows.collect())
    with pytest.raises(Exception, match="short variable-length"):
        spark.range(1).select(codecs.read_var_int(F.lit("0212"))).collect()
