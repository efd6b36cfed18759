"""Hash trees over the log: twigs of 2048 leaves, their active bits, upper levels, proofs.

A twig is one bounded group: its leaves are gathered once and all its levels folded in the JVM, without a shuffle a level.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.bits import TWIG_LEVEL, TWIG_SHIFT
from ..functions.hashing import from_little_endian, little_endian

LEAVES = 1 << TWIG_SHIFT
#: The hash that stands for an unused leaf.
NULL_LEAF = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def pair_hash(level: str, a: str, b: str) -> str:
    """SQL of the hash of a level byte and two hex hashes."""
    return f"sha2(concat(unhex(lpad(hex({level}), 2, '0')), unhex({a}), unhex({b})), 256)"


_STEP = pair_hash("l", "element_at(acc, l + 1)[2 * i]", "element_at(acc, l + 1)[2 * i + 1]")
_FOLD = f"aggregate(sequence(0, {TWIG_SHIFT - 1}), array(leaf_hashes), (acc, l) -> concat(acc, array(transform(sequence(0, cast(shiftleft(1, {TWIG_SHIFT - 1} - l) AS int) - 1), i -> {_STEP}))))"


def _by_twig(rows: DataFrame) -> DataFrame:
    """Rows of (shard, twig, ...) dealt by twig into as many tasks as shuffles have: hashes are made there, so few bytes are no reason for few tasks."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "shard", "twig")


def _dense(value: str, empty: str) -> F.Column:
    """The 2048 values in order from the sorted structs ``l``: numbers are dense, so only the youngest twig has unused leaves, all at its end; holes are looked up."""
    dense = f"concat(transform(l, x -> x.{value}), array_repeat({empty}, {LEAVES} - size(l)))"
    holes = f"transform(sequence(0, {LEAVES - 1}), i -> coalesce(element_at(m, i).{value}, {empty}))"
    return F.expr(f"CASE WHEN m IS NULL THEN {dense} ELSE {holes} END")


def _leaf_rows(leaves: DataFrame, *values: str) -> DataFrame:
    """(shard, twig, l, m): the sorted leaves of each twig, and as a map by place where there are holes."""
    rows = leaves.select("shard", F.shiftright("sn", TWIG_SHIFT).alias("twig"), F.col("sn").bitwiseAND(F.lit(LEAVES - 1)).cast("int").alias("leaf"), *values)
    grouped = _by_twig(rows).groupBy("shard", "twig").agg(F.sort_array(F.collect_list(F.struct("leaf", *values))).alias("l"))
    return grouped.withColumn("m", F.expr("CASE WHEN element_at(l, -1).leaf <> size(l) - 1 THEN map_from_entries(transform(l, x -> struct(x.leaf, x))) END"))


def twigs(leaves: DataFrame) -> DataFrame:
    """(shard, twig, leaf_hashes): 2048 in order, unused ones null leaves, from (shard, sn, hash)."""
    return _leaf_rows(leaves, "hash").select("shard", "twig", _dense("hash", f"'{NULL_LEAF}'").alias("leaf_hashes"))


def tree(leaves: DataFrame) -> DataFrame:
    """(shard, twig, levels, bitmap, l1, l2, l3, root) from (shard, sn, hash, active), by one shuffle."""
    rows = _leaf_rows(leaves, "hash", "active").select("shard", "twig", _dense("hash", f"'{NULL_LEAF}'").alias("leaf_hashes"), _dense("active", "false").alias("flags"))
    # the flags are bound to a variable: Catalyst would put the expression they come from into the lambda
    byte = "aggregate(sequence(0, 7), 0, (a, j) -> a + CASE WHEN f[8 * i + j] THEN shiftleft(1, j) ELSE 0 END)"
    bitmap = f"transform(array(flags), f -> array_join(transform(sequence(0, 255), i -> lower(lpad(hex({byte}), 2, '0'))), ''))[0]"
    rows = rows.select("shard", "twig", F.expr(_FOLD).alias("levels"), F.expr(bitmap).alias("bitmap"))
    rows = _active_levels(rows)
    return rows.withColumn("root", F.expr(pair_hash("11", f"levels[{TWIG_SHIFT}][0]", "l3")))


def levels(twig_table: DataFrame) -> DataFrame:
    """(shard, twig, levels): the arrays of hashes of levels 0 (leaves) to 11 (the left root)."""
    return twig_table.select("shard", "twig", F.expr(_FOLD).alias("levels"))


def nodes(level_table: DataFrame) -> DataFrame:
    """(shard, level, n, hash) of all twig levels; n counts over the whole shard."""
    flat = level_table.select("shard", "twig", F.posexplode("levels").alias("level", "hashes")).select("shard", "twig", "level", F.posexplode("hashes").alias("i", "hash"))
    return flat.select("shard", "level", F.expr(f"shiftleft(twig, {TWIG_SHIFT} - level) + i").cast("bigint").alias("n"), "hash")


def active_tree(bits: DataFrame) -> DataFrame:
    """(shard, twig, bitmap, l1, l2, l3): the tree over the 256-byte bitmap of active leaves, from (shard, sn) of active entries.

    Bits are counted from the lowest of a byte. Pages of 32 bytes; pairs hash with level bytes 8, 9 and 10.
    """
    rows = bits.select("shard", F.shiftright("sn", TWIG_SHIFT).alias("twig"), F.col("sn").bitwiseAND(F.lit(LEAVES - 1)).cast("int").alias("leaf"))
    byte = rows.groupBy("shard", "twig", F.floor(F.col("leaf") / 8).cast("int").alias("at")).agg(F.expr("bit_or(shiftleft(1, leaf % 8))").alias("byte"))
    grouped = byte.groupBy("shard", "twig").agg(F.map_from_entries(F.collect_list(F.struct("at", "byte"))).alias("m"))
    text = grouped.select("shard", "twig", F.expr("array_join(transform(sequence(0, 255), i -> lower(lpad(hex(coalesce(element_at(m, i), 0)), 2, '0'))), '')").alias("bitmap"))
    return _active_levels(text)


def _active_levels(text: DataFrame) -> DataFrame:
    """The three levels above a twig's ``bitmap``."""
    pages = text.withColumn("l1", F.expr("transform(sequence(0, 3), i -> " + pair_hash("8", "substr(bitmap, i * 128 + 1, 64)", "substr(bitmap, i * 128 + 65, 64)") + ")"))
    pages = pages.withColumn("l2", F.expr("transform(sequence(0, 1), i -> " + pair_hash("9", "l1[2 * i]", "l1[2 * i + 1]") + ")"))
    return pages.withColumn("l3", F.expr(pair_hash("10", "l2[0]", "l2[1]")))


def active_roots(bits: DataFrame) -> DataFrame:
    """(shard, twig, l3): the roots of the active trees."""
    return active_tree(bits).select("shard", "twig", "l3")


def right_paths(asked: DataFrame, tree: DataFrame) -> DataFrame:
    """(shard, sn, level, own, peer, peer_at_left): the way from the page of active bits that holds a leaf to the active root, levels 8 to 10."""
    page = "cast(((sn & 2047) div 256) AS int)"
    steps = [
        (8, f"substr(bitmap, {page} * 64 + 1, 64)", f"substr(bitmap, ({page} ^ 1) * 64 + 1, 64)", f"({page} & 1) = 1"),
        (9, f"l1[{page} div 2]", f"l1[cast({page} div 2 AS int) ^ 1]", f"(({page} div 2) & 1) = 1"),
        (10, f"l2[{page} div 4]", f"l2[cast({page} div 4 AS int) ^ 1]", f"(({page} div 4) & 1) = 1"),
    ]
    rows = asked.withColumn("twig", F.shiftright("sn", TWIG_SHIFT)).join(tree, ["shard", "twig"])
    each = ", ".join(f"struct({level} AS level, {own} AS own, {peer} AS peer, {left} AS peer_at_left)" for level, own, peer, left in steps)
    return rows.select("shard", "sn", F.expr(f"inline(array({each}))"))


def _nulls(level: int) -> str:
    return "array(" + ", ".join(f"'{null_root(level + k)}'" for k in range(TWIG_SHIFT)) + ")"


def upper_tiers(roots: DataFrame) -> list[tuple[int, DataFrame]]:
    """The tree above the twig roots (shard, twig, root), eleven levels a tier: for each tier its lowest level and
    (shard, block, youngest, height, levels). A block is 2048 nodes of the lowest level, folded in one row; the last tier
    has one block a shard, whose ``height`` follows from the shard's youngest twig and whose top is the shard's root.
    """
    newest = roots.agg(F.max("twig")).first()[0]
    now = roots.select("shard", F.col("twig").alias("n"), F.col("root").alias("hash"))
    youngest = roots.groupBy("shard").agg(F.max("twig").alias("youngest"))  # a row a shard
    level, tiers = TWIG_LEVEL, []
    while newest is not None:
        rows = now.select("shard", F.shiftright("n", TWIG_SHIFT).alias("block"), F.col("n").bitwiseAND(F.lit(LEAVES - 1)).cast("int").alias("i"), "hash")
        rows = rows.groupBy("shard", "block").agg(F.sort_array(F.collect_list(F.struct("i", "hash"))).alias("l")).join(youngest, "shard")
        height = f"CASE WHEN youngest >= {LEAVES} THEN {TWIG_SHIFT} WHEN youngest = 0 THEN 0 ELSE length(bin(youngest)) END"
        rows = rows.withColumn("height", F.expr(height)).withColumn("nulls", F.expr(_nulls(level))).withColumn("last", F.expr("element_at(l, -1).i"))
        holes = "transform(sequence(0, last), i -> coalesce(element_at(map_from_entries(l), i), nulls[0]))"
        rows = rows.withColumn("base", F.expr(f"CASE WHEN last = size(l) - 1 THEN transform(l, x -> x.hash) ELSE {holes} END"))
        pair = pair_hash(f"{level} + l", "element_at(acc, l + 1)[2 * i]", "coalesce(get(element_at(acc, l + 1), 2 * i + 1), nulls[l])")
        fold = f"aggregate(slice(sequence(0, {TWIG_SHIFT - 1}), 1, height), array(base), (acc, l) -> concat(acc, array(transform(sequence(0, (size(element_at(acc, l + 1)) + 1) div 2 - 1), i -> {pair}))))"
        tier = rows.select("shard", "block", "youngest", "height", F.expr(fold).alias("levels"))
        tiers.append((level, tier))
        newest >>= TWIG_SHIFT
        if not newest:
            break
        now = tier.select("shard", F.col("block").alias("n"), F.expr("element_at(levels, -1)[0]").alias("hash"))
        youngest = youngest.withColumn("youngest", F.shiftright("youngest", TWIG_SHIFT))
        level += TWIG_SHIFT
    return tiers


def upper_nodes(tiers: list[tuple[int, DataFrame]]) -> DataFrame:
    """(shard, level, n, hash) of all nodes of the tiers, twig roots included."""
    out = None
    for level, tier in tiers:
        flat = tier.select("shard", "block", F.posexplode("levels").alias("k", "hashes")).select("shard", "block", "k", F.posexplode("hashes").alias("i", "hash"))
        flat = flat.where("k > 0") if level > TWIG_LEVEL else flat  # a tier's lowest level is the top of the one below
        flat = flat.select("shard", (F.col("k") + level).alias("level"), F.expr(f"shiftleft(block, {TWIG_SHIFT} - k) + i").cast("bigint").alias("n"), "hash")
        out = flat if out is None else out.unionByName(flat)
    return out


def edges(nodes: DataFrame, ends: DataFrame) -> DataFrame:
    """The leftmost node of ``upper_nodes`` on each level that a pruned prefix of twigs below ``ends``(shard, end) leaves; above the twigs the left one of its pair."""
    place = F.expr(f"CASE WHEN level = {TWIG_LEVEL} THEN end ELSE shiftleft(shiftright(end, level - {TWIG_LEVEL} + 1), 1) END")
    return nodes.join(ends, "shard").where(F.col("n") == place).select("shard", "level", "n", "hash")


def shard_roots(roots: DataFrame) -> DataFrame:
    """(shard, level, root): the root of each shard's tree, on the level that its youngest twig asks for."""
    tiers = upper_tiers(roots)
    if not tiers:
        return roots.select("shard", F.lit(TWIG_LEVEL).alias("level"), "root").limit(0)
    youngest = roots.groupBy("shard").agg(F.max("twig").alias("y"))
    top = F.expr(f"CASE WHEN y = 0 THEN {TWIG_LEVEL} ELSE {TWIG_LEVEL} + length(bin(y)) END")
    return tiers[-1][1].join(youngest, "shard").select("shard", top.alias("level"), F.expr("element_at(levels, -1)[0]").alias("root"))


def with_upper_paths(rows: DataFrame, tiers: list[tuple[int, DataFrame]]) -> DataFrame:
    """``rows`` of (shard, twig, ...) with ``upper``, the siblings from the twig root up (an unused subtree's where there is none), and ``shard_root``."""
    out = rows.withColumn("upper", F.expr("cast(array() AS array<string>)")).withColumn("shard_root", F.lit(None).cast("string"))
    for k, (level, tier) in enumerate(tiers):
        out = out.withColumn("block", F.expr(f"shiftright(twig, {TWIG_SHIFT * (k + 1)})")).withColumn("_j", F.expr(f"cast(shiftright(twig, {TWIG_SHIFT * k}) & {LEAVES - 1} AS int)"))
        out = out.join(tier.select("shard", "block", "height", F.col("levels").alias("_up")), ["shard", "block"])
        steps = f"transform(slice(sequence(0, {TWIG_SHIFT - 1}), 1, height), l -> coalesce(get(_up[l], shiftright(_j, l) ^ 1), {_nulls(level)}[l]))"
        out = out.withColumn("upper", F.expr(f"concat(upper, {steps})")).withColumn("shard_root", F.expr("element_at(_up, -1)[0]")).drop("block", "_j", "height", "_up")
    return out


def proofs(asked: DataFrame, trees: DataFrame, tiers: list[tuple[int, DataFrame]]) -> DataFrame:
    """(shard, sn, leaf, left, page, right, upper, root): the whole way of each asked (shard, sn) to its shard's root.

    ``left``: siblings of levels 0 to 10; ``page``: the 32 bytes of active bits that hold the leaf's; ``right``: siblings
    of levels 8 to 10 of the active tree; ``upper``: siblings from the twig root up. ``trees``: of ``tree``, one row a twig.
    A leaf looks its siblings up by place in its twig's row; no node becomes a row of its own.
    """
    above = with_upper_paths(trees.select("shard", "twig"), tiers)
    rows = _places(asked).join(trees.select("shard", "twig", "levels", "bitmap", "l1", "l2"), ["shard", "twig"]).join(above, ["shard", "twig"])
    page = "cast(i div 256 AS int)"
    each = (
        f"struct(shiftleft(twig, {TWIG_SHIFT}) + i AS sn, levels[0][i] AS leaf, transform(sequence(0, {TWIG_SHIFT - 1}), l -> levels[l][shiftright(i, l) ^ 1]) AS left, substr(bitmap, {page} * 64 + 1, 64) AS page, "
        f"array(substr(bitmap, ({page} ^ 1) * 64 + 1, 64), l1[cast({page} div 2 AS int) ^ 1], l2[cast({page} div 4 AS int) ^ 1]) AS right)"
    )
    made = rows.select("shard", "upper", "shard_root", F.expr(f"transform(places, i -> {each})").alias("each"))
    return made.select("shard", "upper", "shard_root", F.expr("inline(each)")).select("shard", "sn", "leaf", "left", "page", "right", "upper", F.col("shard_root").alias("root"))


def _places(asked: DataFrame) -> DataFrame:
    """(shard, twig, places): the asked leaves of each twig, each once, so that a twig's hashes are joined to one row and not to each leaf's."""
    rows = asked.select("shard", F.shiftright("sn", TWIG_SHIFT).alias("twig"), F.col("sn").bitwiseAND(F.lit(LEAVES - 1)).cast("int").alias("_i"))
    return rows.groupBy("shard", "twig").agg(F.collect_set("_i").alias("places"))


def _climb(path: str, start: str, level: int, shift: int) -> str:
    """SQL of ``start`` hashed up the siblings ``path``, the first of them on ``level``; sides by the bits of sn from ``shift``."""
    step = f"CASE WHEN (shiftright(sn, {shift} + k) & 1) = 1 THEN {pair_hash(f'{level} + k', f'{path}[k]', 'acc')} ELSE {pair_hash(f'{level} + k', 'acc', f'{path}[k]')} END"
    return f"aggregate(slice(sequence(0, 63), 1, size({path})), {start}, (acc, k) -> {step})"


def verified(proof_table: DataFrame) -> DataFrame:
    """Proofs with ``made``, the root that their parts give, and whether it is theirs."""
    rows = proof_table.withColumn("_a", F.expr(_climb("left", "leaf", 0, 0))).withColumn("_b", F.expr(_climb("right", "page", 8, 8)))
    rows = rows.withColumn("_t", F.expr(pair_hash("11", "_a", "_b"))).withColumn("made", F.expr(_climb("upper", "_t", TWIG_LEVEL, TWIG_SHIFT)))
    return rows.withColumn("sound", F.col("made") == F.col("root")).drop("_a", "_b", "_t")


def proof_bytes(proof_table: DataFrame) -> DataFrame:
    """(shard, sn, proof): the number's eight bytes, lowest first, then leaf, left, page, right, upper and root, as hex."""
    number = F.lower(F.hex(little_endian(F.col("sn"))))
    return proof_table.select("shard", "sn", F.concat(number, "leaf", F.array_join("left", ""), "page", F.array_join("right", ""), F.array_join("upper", ""), "root").alias("proof"))


def parse_proofs(proofs_as_hex: DataFrame) -> DataFrame:
    """The parts of serialized proofs (shard, proof) again; one of a wrong length is an error."""
    least = 16 + 64 * (1 + TWIG_SHIFT + 1 + 3 + 1)
    whole = F.expr(f"CASE WHEN length(proof) >= {least} AND (length(proof) - 16) % 64 = 0 THEN proof ELSE raise_error('a proof of ' || length(proof) || ' digits') END")
    part = lambda first, count: F.expr(f"transform(slice(sequence(0, 63), 1, {count}), k -> substr(proof, 17 + ({first} + k) * 64, 64))")
    rows = proofs_as_hex.withColumn("proof", whole).withColumn("n", F.expr(f"cast((length(proof) - {least}) div 64 AS int)"))
    return rows.select(
        "shard", from_little_endian(F.unhex(F.substring("proof", 1, 14)), 7).alias("sn"), F.substring("proof", 17, 64).alias("leaf"), part(1, TWIG_SHIFT).alias("left"),
        F.expr(f"substr(proof, {17 + 64 * (1 + TWIG_SHIFT)}, 64)").alias("page"), part(2 + TWIG_SHIFT, 3).alias("right"), part(5 + TWIG_SHIFT, "n").alias("upper"), F.right("proof", F.lit(64)).alias("root"),
    )


def twig_roots(level_table: DataFrame, active: DataFrame) -> DataFrame:
    """(shard, twig, root): left root and active root under level byte 11; a twig without active entries has zero bits."""
    empty = active_root_of_zeros()
    both = level_table.select("shard", "twig", F.expr(f"levels[{TWIG_SHIFT}][0]").alias("left_root")).join(active.select("shard", "twig", "l3"), ["shard", "twig"], "left")
    return both.select("shard", "twig", F.expr(pair_hash("11", "left_root", f"coalesce(l3, '{empty}')")).alias("root"))


def active_root_of_zeros() -> str:
    from hashlib import sha256

    a = "00" * 32
    for level in (8, 9, 10):
        a = sha256(bytes([level]) + bytes.fromhex(a) * 2).hexdigest()
    return a


def null_root(level: int) -> str:
    """The hash of a whole unused subtree whose root is on an upper level."""
    from hashlib import sha256

    left = NULL_LEAF
    for k in range(TWIG_SHIFT):
        left = sha256(bytes([k]) + bytes.fromhex(left) * 2).hexdigest()
    root = sha256(bytes([TWIG_SHIFT]) + bytes.fromhex(left) + bytes.fromhex(active_root_of_zeros())).hexdigest()
    for k in range(TWIG_LEVEL, level):
        root = sha256(bytes([k]) + bytes.fromhex(root) * 2).hexdigest()
    return root


def left_paths(asked: DataFrame, level_table: DataFrame) -> DataFrame:
    """(shard, sn, level, peer, peer_at_left) of the sibling on every level of the twig, by place in the twig's row."""
    rows = _places(asked).join(level_table.select("shard", "twig", "levels"), ["shard", "twig"])
    each = f"transform(sequence(0, {TWIG_SHIFT - 1}), l -> struct(shiftleft(twig, {TWIG_SHIFT}) + i AS sn, l AS level, levels[l][shiftright(i, l) ^ 1] AS peer, (shiftright(i, l) & 1) = 1 AS peer_at_left))"
    return rows.select("shard", F.expr(f"flatten(transform(places, i -> {each}))").alias("each")).select("shard", F.expr("inline(each)"))


def store_twigs(trees: DataFrame, last_positions: DataFrame, path: str) -> None:
    """The twig file as a table by shard: of each twig the end of its last entry (shard, twig, last_pos), a checksum of it
    and of the hashes, the top 255 left nodes and the 2048 leaves; the levels between are made again when read."""
    top = F.expr("flatten(transform(sequence(11, 4, -1), l -> levels[l]))")
    rows = trees.join(last_positions, ["shard", "twig"]).select("shard", "twig", "last_pos", top.alias("top"), F.expr("levels[0]").alias("leaf_hashes"))
    rows.withColumn("checksum", F.expr(_CHECKSUM)).write.mode("append").partitionBy("shard").parquet(path)


_CHECKSUM = "crc32(cast(concat(last_pos, array_join(top, ''), array_join(leaf_hashes, '')) AS binary))"


def read_twigs(spark, path: str) -> DataFrame:
    """(shard, twig, last_pos, levels) of a twig file; a damaged row is an error."""
    rows = spark.read.parquet(path)
    sound = F.expr(f"CASE WHEN checksum = {_CHECKSUM} THEN leaf_hashes ELSE raise_error('damaged twig ' || twig || ' of shard ' || shard) END")
    return rows.withColumn("leaf_hashes", sound).select("shard", "twig", "last_pos", F.expr(_FOLD).alias("levels"))


def first_positions(twig_file: DataFrame) -> DataFrame:
    """(shard, twig, first_pos): where the twig before ends, 0 for the first."""
    after = twig_file.select("shard", (F.col("twig") + 1).alias("twig"), F.col("last_pos").alias("first_pos"))
    return twig_file.select("shard", "twig").join(after, ["shard", "twig"], "left").select("shard", "twig", F.coalesce("first_pos", F.lit(0).cast("bigint")).alias("first_pos"))


def evicted(trees: DataFrame, start: F.Column, end: F.Column) -> DataFrame:
    """(shard, level, n, hash): the roots of twigs from ``start`` to before ``end``, which stay when the twigs go."""
    return trees.where((F.col("twig") >= start) & (F.col("twig") < end)).select("shard", F.lit(TWIG_LEVEL).alias("level"), F.col("twig").alias("n"), F.col("root").alias("hash"))
