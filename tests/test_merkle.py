"""Trees against hashlib."""

from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import merkle as M


def h(level, a, b):
    return sha256(bytes([level]) + bytes.fromhex(a) + bytes.fromhex(b)).hexdigest()


def fold(leaves):
    level, out = 0, [leaves]
    while len(out[-1]) > 1:
        now = out[-1]
        out.append([h(level, now[i], now[i + 1]) for i in range(0, len(now), 2)])
        level += 1
    return out


def test_twigs_paths_and_roots(spark):
    count = 2048 * 2 + 700
    leaves = [sha256(str(i).encode()).hexdigest() for i in range(count)]
    df = spark.createDataFrame([(3, i, x, i % 3 != 0) for i, x in enumerate(leaves)], "shard int, sn long, hash string, active boolean").cache()
    padded = leaves + [M.NULL_LEAF] * (3 * 2048 - count)
    trees = [fold(padded[k : k + 2048]) for k in range(0, len(padded), 2048)]
    levels = M.levels(M.twigs(df)).cache()
    for r in levels.collect():
        assert [list(x) for x in r.levels] == trees[r.twig]

    active = {r.twig: r.l3 for r in M.active_roots(df.where("active")).collect()}
    for twig in range(3):
        bits = bytearray(256)
        for k in range(2048):
            sn = twig * 2048 + k
            if sn < count and sn % 3 != 0:
                bits[k // 8] |= 1 << k % 8
        pages = [bits[32 * k : 32 * k + 32].hex() for k in range(8)]
        l1 = [h(8, pages[2 * k], pages[2 * k + 1]) for k in range(4)]
        l2 = [h(9, l1[0], l1[1]), h(9, l1[2], l1[3])]
        assert active[twig] == h(10, l2[0], l2[1])
    roots = M.twig_roots(levels, M.active_roots(df.where("active")))
    got = {r.twig: r.root for r in roots.collect()}
    assert got == {k: h(11, trees[k][11][0], active[k]) for k in range(3)}

    whole = {r.twig: r for r in M.tree(df).collect()}
    assert {k: (r.root, r.l3, [list(x) for x in r.levels]) for k, r in whole.items()} == {k: (got[k], active[k], trees[k]) for k in range(3)}
    top = M.shard_roots(roots).collect()
    assert [(r.shard, r.level, r.root) for r in top] == [(3, 14, h(13, h(12, got[0], got[1]), h(12, got[2], M.null_root(12))))]
    some = M.left_paths(df.where("sn % 501 = 0").select("shard", "sn"), levels).collect()
    assert len(some) == 11 * len({r.sn for r in some}) and all(r.peer == trees[r.sn // 2048][r.level][(r.sn % 2048 >> r.level) ^ 1] for r in some)


def test_inactive_twig(spark):
    df = spark.createDataFrame([(0, 0, "ab" * 32)], "shard int, sn long, hash string")
    levels = M.levels(M.twigs(df))
    nothing = M.active_roots(df.where("sn < 0"))
    want = h(11, levels.first().levels[11][0], M.active_root_of_zeros())
    assert M.twig_roots(levels, nothing).first().root == want


def plain_tiers(roots):
    """Roots folded pair by pair to the top that the youngest twig asks for."""
    now, level, out = list(roots), 12, []
    while True:
        out.append(now)
        if len(now) == 1:
            return out
        now = [h(level, now[k], now[k + 1] if k + 1 < len(now) else M.null_root(level)) for k in range(0, len(now), 2)]
        level += 1


def test_uppers_of_any_height(spark):
    """One twig, a few, a whole block and more than a block, in shards of their own."""
    counts = {0: 1, 1: 2, 2: 5, 3: 2048, 4: 2049, 5: 4500}
    made = {s: [sha256(f"{s}:{k}".encode()).hexdigest() for k in range(n)] for s, n in counts.items()}
    df = spark.createDataFrame([(s, k, x) for s, xs in made.items() for k, x in enumerate(xs)], "shard int, twig long, root string").cache()
    want = {s: plain_tiers(xs) for s, xs in made.items()}
    assert {(r.shard, r.level, r.root) for r in M.shard_roots(df).collect()} == {(s, 11 + len(t), t[-1][0]) for s, t in want.items()}
    tiers = M.upper_tiers(df)
    nodes = {(r.shard, r.level, r.n): r.hash for r in M.upper_nodes(tiers).collect()}
    for s, t in want.items():
        for k, level in enumerate(t):
            assert all(nodes[s, 12 + k, i] == x for i, x in enumerate(level))
    for r in M.with_upper_paths(df.where("twig % 97 = 0 OR shard < 3"), tiers).collect():
        acc = made[r.shard][r.twig]
        for k, peer in enumerate(r.upper):
            acc = h(12 + k, peer, acc) if r.twig >> k & 1 else h(12 + k, acc, peer)
        assert acc == r.shard_root == want[r.shard][-1][0]
    ends = spark.createDataFrame([(s, n // 2) for s, n in counts.items()], "shard int, end long")
    for r in M.edges(M.upper_nodes(tiers), ends).collect():
        end = counts[r.shard] // 2 >> r.level - 12
        assert r.n == (end if r.level == 12 else end - end % 2) and r.hash == want[r.shard][r.level - 12][r.n]
    assert M.upper_tiers(df.limit(0)) == [] and M.shard_roots(df.limit(0)).count() == 0


def test_whole_proofs(spark):
    """The golden shape: many twigs before, a first twig without active entries, null leaves at the end; every number verifies and comes back from its bytes."""
    gone = {*range(2048), 5000, 5500, 5700, 5813, 6001}
    count = 2047 * 4 + 1600
    leaves = [sha256(f"y{i}".encode()).hexdigest() for i in range(count)]
    df = spark.createDataFrame([(2, i, x, i not in gone) for i, x in enumerate(leaves)], "shard int, sn long, hash string, active boolean").cache()
    trees = M.tree(df).cache()
    tiers = M.upper_tiers(trees.select("shard", "twig", "root"))
    every = spark.range(2048 * 5).select(F.lit(2).alias("shard"), F.col("id").alias("sn"))  # null leaves as well
    made = M.proofs(every, trees, tiers)
    as_bytes = M.proof_bytes(made).cache()
    assert {len(r.proof) for r in as_bytes.collect()} == {16 + 64 * (1 + 11 + 1 + 3 + 3 + 1)}
    back = M.parse_proofs(as_bytes)
    assert sorted(map(str, back.select(*made.columns).collect())) == sorted(map(str, made.collect()))
    root = M.shard_roots(trees.select("shard", "twig", "root")).first().root
    checked = M.verified(back).collect()
    assert len(checked) == 2048 * 5 and all(r.sound and r.root == root for r in checked)
    assert [r.leaf for r in sorted(checked, key=lambda r: r.sn)] == leaves + [M.NULL_LEAF] * (2048 * 5 - count)
    # any changed digit is noticed
    broken = as_bytes.where("sn % 1500 = 7").withColumn("proof", F.expr("concat(substr(proof, 1, 700), translate(substr(proof, 701, 1), '0123456789abcdef', '123456789abcdef0'), substr(proof, 702))"))
    assert not any(r.sound for r in M.verified(M.parse_proofs(broken)).collect())
    with pytest.raises(Exception, match="digits"):
        M.parse_proofs(as_bytes.withColumn("proof", F.substring("proof", 1, 500))).collect()


def test_twig_file(spark, tmp_path):
    df = spark.createDataFrame([(s, i, sha256(f"{s}{i}".encode()).hexdigest(), True) for s in (0, 1) for i in range(3000)], "shard int, sn long, hash string, active boolean")
    trees = M.tree(df).cache()
    M.store_twigs(trees, trees.select("shard", "twig", ((F.col("twig") + 1) * 1000).alias("last_pos")), f"{tmp_path}/twigs")
    back = M.read_twigs(spark, f"{tmp_path}/twigs")
    key = lambda r: (r.shard, r.twig, str(r.levels))
    assert sorted(map(key, back.collect())) == sorted(map(key, trees.collect()))
    assert {(r.shard, r.twig, r.first_pos) for r in M.first_positions(back).collect()} == {(s, t, 1000 * t) for s in (0, 1) for t in (0, 1)}
    raw = spark.read.parquet(f"{tmp_path}/twigs")
    raw.withColumn("last_pos", F.col("last_pos") + F.col("twig")).write.parquet(f"{tmp_path}/damaged")
    with pytest.raises(Exception, match="damaged twig 1"):
        M.read_twigs(spark, f"{tmp_path}/damaged").select("levels").collect()
