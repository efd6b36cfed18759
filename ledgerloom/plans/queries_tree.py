"""Queries over hash trees of the line items, whose numbers are dense in their shard."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hashing as H
from ..functions.ordered import numbered
from ..operators import merkle as M, store
from ..shared import cut, folder, once
from ..sources import views as V
from .registry import query


def leaves(spark: SparkSession, d: str) -> DataFrame:
    """(shard, sn, hash, active) of line items in key order; returned items are not active."""
    rows = V.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
    number = F.concat_ws(":", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    rows = rows.withColumn("hash", F.sha2(number, 256)).withColumn("shard", H.shard(F.col("hash"))).withColumn("block", F.floor(F.col("l_orderkey") / V.KEY_BLOCK))
    out = numbered(rows, ["shard"], "block", ["l_orderkey", "hash"], "sn")
    return out.select("shard", "sn", "hash", (F.col("l_returnflag") != "R").alias("active"))


def trees(spark: SparkSession, d: str) -> DataFrame:
    """One row a twig with all its hashes, written once."""
    return once(spark, "trees", f"{d}/lineitem.parquet", lambda: M.tree(leaves(spark, d)))


def proofs(spark: SparkSession, d: str) -> DataFrame:
    """The whole proof of every leaf."""
    rows = trees(spark, d)
    asked = rows.select("shard", F.explode(F.expr(f"filter(transform(sequence(0, {M.LEAVES - 1}), i -> shiftleft(twig, 11) + i), n -> levels[0][cast(n & {M.LEAVES - 1} AS int)] <> '{M.NULL_LEAF}')")).alias("sn"))
    return M.proofs(asked, rows, M.upper_tiers(rows.select("shard", "twig", "root")))


_LEAF = """raw_leaf AS (SELECT sha256(l_orderkey || ':' || l_linenumber || ':' || l_partkey || ':' || l_suppkey) AS hash, l_orderkey, l_returnflag FROM lineitem),
leaf AS (SELECT CAST(('0x' || substr(hash, 1, 1)) AS INT) AS shard, row_number() OVER (PARTITION BY substr(hash, 1, 1) ORDER BY l_orderkey, hash) - 1 AS sn, hash, l_returnflag <> 'R' AS active FROM raw_leaf)"""


def _pair(level: int, a: str, b: str) -> str:
    return f"sha256(unhex('{level:02x}') || unhex({a}) || unhex({b}))"


def _levels(leaf: str) -> str:
    return f"""{leaf}, span AS (SELECT shard, max(sn) >> 11 AS top FROM leaf GROUP BY shard), slot AS (SELECT shard, CAST(i AS BIGINT) AS n FROM span, unnest(range((top + 1) * 2048)) t(i)),
l0 AS (SELECT s.shard, s.n, coalesce(hash, '{M.NULL_LEAF}') AS hash FROM slot s LEFT JOIN leaf ON leaf.shard = s.shard AND leaf.sn = s.n)""" + "".join(
        f", l{k + 1} AS (SELECT shard, n // 2 AS n, {_pair(k, 'arg_min(hash, n)', 'arg_max(hash, n)')} AS hash FROM l{k} GROUP BY shard, n // 2)" for k in range(11)
    )


_LEVELS = _levels(_LEAF)

_ZERO = "'" + "00" * 32 + "'"
_ACTIVE = f"""byte AS (SELECT l0.shard, l0.n >> 11 AS twig, (l0.n & 2047) >> 3 AS spot, bit_or(CASE WHEN coalesce(active, false) THEN 1 << (l0.n & 7)::INT ELSE 0 END) AS b FROM l0 LEFT JOIN leaf ON leaf.shard = l0.shard AND leaf.sn = l0.n GROUP BY ALL),
page AS (SELECT shard, twig, spot >> 5 AS p, string_agg(lpad(lower(to_hex(b)), 2, '0'), '' ORDER BY spot) AS h FROM byte GROUP BY ALL),
a1 AS (SELECT shard, twig, p // 2 AS p, {_pair(8, 'arg_min(h, p)', 'arg_max(h, p)')} AS h FROM page GROUP BY ALL), a2 AS (SELECT shard, twig, p // 2 AS p, {_pair(9, 'arg_min(h, p)', 'arg_max(h, p)')} AS h FROM a1 GROUP BY ALL),
a3 AS (SELECT shard, twig, {_pair(10, 'arg_min(h, p)', 'arg_max(h, p)')} AS l3 FROM a2 GROUP BY ALL),
twig_root AS (SELECT l11.shard, l11.n AS twig, {_pair(11, 'l11.hash', 'a3.l3')} AS root FROM l11 JOIN a3 ON a3.shard = l11.shard AND a3.twig = l11.n)"""


#: The hashes of unused subtrees by level, as many as a 64-bit number of twigs could ask for.
_NULLS = "nulls AS (SELECT unnest(range(12, 65)) AS level, unnest([" + ", ".join(f"'{M.null_root(k)}'" for k in range(12, 65)) + "]) AS null_hash)"
#: All nodes from the twig roots up to each shard's root; the top follows from the shard's youngest twig.
_UPPER = f"""{_NULLS}, tops AS (SELECT shard, max(twig) AS youngest, 12 + CASE WHEN max(twig) = 0 THEN 0 ELSE length(bin(max(twig))) END AS top FROM twig_root GROUP BY shard),
up(shard, level, n, hash) AS (SELECT shard, 12::BIGINT, twig, root FROM twig_root UNION ALL
SELECT up.shard, up.level + 1, up.n // 2, sha256(unhex(printf('%02x', up.level)) || unhex(coalesce(max(up.hash) FILTER (up.n % 2 = 0), max(null_hash))) || unhex(coalesce(max(up.hash) FILTER (up.n % 2 = 1), max(null_hash))))
FROM up JOIN tops ON tops.shard = up.shard JOIN nulls ON nulls.level = up.level WHERE up.level < top GROUP BY up.shard, up.level, up.n // 2),
shard_root AS (SELECT up.shard, up.level, up.hash AS root FROM up JOIN tops ON tops.shard = up.shard AND tops.top = up.level)"""


@query(f"WITH {_LEVELS} SELECT shard, n AS twig, hash AS left_root FROM l11")
def twig_left_roots(spark: SparkSession, d: str) -> DataFrame:
    """The left root of every twig, unused leaves being null leaves."""
    return trees(spark, d).select("shard", "twig", F.expr("levels[11][0]").alias("left_root"))


@query(f"WITH {_LEVELS}, {_ACTIVE} SELECT shard, twig, root FROM twig_root")
def twig_roots(spark: SparkSession, d: str) -> DataFrame:
    """Roots of twigs from leaves and active bits."""
    return trees(spark, d).select("shard", "twig", "root")


@query(f"WITH {_LEVELS}, {_ACTIVE} SELECT shard, twig, l3 AS active_root FROM a3")
def active_bit_roots(spark: SparkSession, d: str) -> DataFrame:
    """M2: the root over each twig's active bits."""
    return trees(spark, d).select("shard", "twig", F.col("l3").alias("active_root"))


@query(f"WITH RECURSIVE {_LEVELS}, {_ACTIVE}, {_UPPER} SELECT shard, level, root FROM shard_root")
def upper_roots(spark: SparkSession, d: str) -> DataFrame:
    """M4, M5, M6: twig roots folded up to each shard's root, missing siblings being unused subtrees."""
    return M.shard_roots(trees(spark, d).select("shard", "twig", "root")).select("shard", F.col("level").cast("bigint").alias("level"), "root")


@query(f"WITH RECURSIVE {_LEVELS}, {_ACTIVE}, {_UPPER} SELECT shard, root, true AS same FROM shard_root")
def recovered_roots(spark: SparkSession, d: str) -> DataFrame:
    """Roots made again from a twig file that was written, checked and read, and from the active bits, against those of the tree."""
    rows = trees(spark, d)
    path = folder(spark, "twig-file")
    M.store_twigs(rows, rows.select("shard", "twig", (F.col("twig") * 8).alias("last_pos")), path)
    again = M.twig_roots(M.read_twigs(spark, path), rows.select("shard", "twig", "l3"))
    old, new = (M.shard_roots(x).select("shard", "root") for x in (rows.select("shard", "twig", "root"), again))
    return old.join(new.withColumnRenamed("root", "made"), "shard").select("shard", "root", (F.col("root") == F.col("made")).alias("same"))


@query(f"WITH {_LEVELS} " + " UNION ALL ".join(f"SELECT shard, {k} AS level, n, hash FROM l{k}" for k in range(12)))
def tree_nodes(spark: SparkSession, d: str) -> DataFrame:
    """The hash of every node of every twig."""
    return M.nodes(trees(spark, d)).select("shard", F.col("level").cast("int").alias("level"), "n", "hash")


_LEFT = " UNION ALL ".join(f"SELECT a.shard, a.sn, {k} AS level, l.hash AS peer, l.n < a.sn >> {k} AS peer_at_left FROM leaf a JOIN l{k} l ON l.shard = a.shard AND l.n = xor(a.sn >> {k}, 1)" for k in range(11))
_RIGHT = """SELECT a.shard, a.sn, 8 AS level, o.h AS own, q.h AS peer, q.p < o.p AS peer_at_left FROM asked a JOIN page o ON o.shard = a.shard AND o.twig = a.twig AND o.p = a.p JOIN page q ON q.shard = a.shard AND q.twig = a.twig AND q.p = xor(a.p, 1)
UNION ALL SELECT a.shard, a.sn, 9, o.h, q.h, q.p < o.p FROM asked a JOIN a1 o ON o.shard = a.shard AND o.twig = a.twig AND o.p = a.p // 2 JOIN a1 q ON q.shard = a.shard AND q.twig = a.twig AND q.p = xor(a.p // 2, 1)
UNION ALL SELECT a.shard, a.sn, 10, o.h, q.h, q.p < o.p FROM asked a JOIN a2 o ON o.shard = a.shard AND o.twig = a.twig AND o.p = a.p // 4 JOIN a2 q ON q.shard = a.shard AND q.twig = a.twig AND q.p = xor(a.p // 4, 1)"""
_ASKED = "asked AS (SELECT shard, sn, sn >> 11 AS twig, (sn & 2047) // 256 AS p FROM leaf)"
_ABOVE = """SELECT t.shard, t.twig, nulls.level, coalesce(u.hash, null_hash) AS peer, xor(t.twig >> (nulls.level - 12), 1) < t.twig >> (nulls.level - 12) AS peer_at_left
FROM twig_root t JOIN tops ON tops.shard = t.shard JOIN nulls ON nulls.level < tops.top LEFT JOIN up u ON u.shard = t.shard AND u.level = nulls.level AND u.n = xor(t.twig >> (nulls.level - 12), 1)"""


@query(f"WITH {_LEVELS}, p AS ({_LEFT}) SELECT shard, sn, level, peer, peer_at_left FROM p")
def inclusion_paths(spark: SparkSession, d: str) -> DataFrame:
    """The siblings on the way from every leaf to its twig's left root."""
    rows = trees(spark, d)
    return M.left_paths(leaves(spark, d), rows).select("shard", "sn", F.col("level").cast("int").alias("level"), "peer", "peer_at_left")


@query(f"WITH {_LEVELS}, {_ACTIVE}, {_ASKED} {_RIGHT}")
def active_paths(spark: SparkSession, d: str) -> DataFrame:
    """The way from every leaf's page of active bits to the active root."""
    return M.right_paths(leaves(spark, d).select("shard", "sn"), trees(spark, d).select("shard", "twig", "bitmap", "l1", "l2", "l3"))


@query(f"WITH RECURSIVE {_LEVELS}, {_ACTIVE}, {_UPPER} SELECT shard, twig, level, peer, peer_at_left FROM ({_ABOVE})")
def upper_paths(spark: SparkSession, d: str) -> DataFrame:
    """The siblings on the way from every twig root to its shard's root."""
    roots = trees(spark, d).select("shard", "twig", "root")
    rows = M.with_upper_paths(roots.select("shard", "twig"), M.upper_tiers(roots))
    return rows.select("shard", "twig", F.posexplode("upper").alias("k", "peer")).select("shard", "twig", (F.col("k") + 12).cast("bigint").alias("level"), "peer", F.expr("(shiftright(twig, k) & 1) = 1").alias("peer_at_left"))


@query(f"WITH RECURSIVE {_LEVELS}, {_ACTIVE}, {_UPPER} SELECT leaf.shard, leaf.sn, root, true AS sound FROM leaf JOIN shard_root ON shard_root.shard = leaf.shard")
def verified_paths(spark: SparkSession, d: str) -> DataFrame:
    """Every leaf's proof, read from its bytes, gives the root of its shard's tree."""
    made = M.verified(M.parse_proofs(M.proof_bytes(proofs(spark, d)))).select("shard", "sn", "made", "sound")
    roots = M.shard_roots(trees(spark, d).select("shard", "twig", "root")).select("shard", "root")
    return made.join(F.broadcast(roots), "shard").select("shard", "sn", "root", (F.col("sound") & (F.col("made") == F.col("root"))).alias("sound"))  # a row a shard


@query(f"""WITH RECURSIVE {_LEVELS}, {_ACTIVE}, {_UPPER}, {_ASKED}, lp AS (SELECT shard, sn, string_agg(peer, '' ORDER BY level) AS h FROM ({_LEFT}) GROUP BY shard, sn),
rp AS (SELECT shard, sn, max(own) FILTER (level = 8) || string_agg(peer, '' ORDER BY level) AS h FROM ({_RIGHT}) GROUP BY shard, sn),
ap AS (SELECT shard, twig, string_agg(peer, '' ORDER BY level) AS h FROM ({_ABOVE}) GROUP BY shard, twig), le AS (SELECT shard, sn, printf('%016x', sn) AS x FROM leaf)
SELECT leaf.shard, leaf.sn, {' || '.join(f'substr(x, {15 - 2 * k}, 2)' for k in range(8))} || leaf.hash || lp.h || rp.h || coalesce(ap.h, '') || root AS proof FROM leaf JOIN le ON le.shard = leaf.shard AND le.sn = leaf.sn
JOIN lp ON lp.shard = leaf.shard AND lp.sn = leaf.sn JOIN rp ON rp.shard = leaf.shard AND rp.sn = leaf.sn JOIN shard_root r ON r.shard = leaf.shard LEFT JOIN ap ON ap.shard = leaf.shard AND ap.twig = leaf.sn >> 11""")
def serialized_proofs(spark: SparkSession, d: str) -> DataFrame:
    """Every leaf's whole proof as bytes."""
    return M.proof_bytes(proofs(spark, d))


@query(f"WITH {_LEVELS} SELECT CAST(0 AS BIGINT) AS broken, CAST(count(*) * 2047 AS BIGINT) AS checked FROM l11")
def tree_audit(spark: SparkSession, d: str) -> DataFrame:
    """Inner nodes that are not the hash of their children, of all that are checked; there are none."""
    nodes = M.nodes(trees(spark, d))
    kids = nodes.groupBy("shard", F.col("level").alias("below"), F.expr("shiftright(n, 1)").alias("n")).agg(F.min_by("hash", "n").alias("a"), F.max_by("hash", "n").alias("b"))
    made = kids.select("shard", (F.col("below") + 1).alias("level"), "n", F.expr(M.pair_hash("below", "a", "b")).alias("made"))
    found = nodes.where("level > 0").join(made, ["shard", "level", "n"], "left")
    return found.agg(F.count(F.when(F.col("made").isNull() | (F.col("made") != F.col("hash")), 1)).alias("broken"), F.count("*").alias("checked"))


#: Of each shard the older half of the twigs is pruned in the queries.
_KEPT = "(youngest + 1) // 2"


@query(f"""WITH RECURSIVE {_LEVELS}, {_ACTIVE}, {_UPPER}, w AS (SELECT tops.shard, nulls.level, ({_KEPT}) >> (nulls.level - 12) AS m FROM tops JOIN nulls ON nulls.level <= tops.top),
e AS (SELECT w.shard, w.level, CASE WHEN w.level > 12 THEN m - m % 2 ELSE m END AS n FROM w), f AS (SELECT up.shard, up.level, up.n, up.hash, printf('%016x', (up.level << 56) + up.n) AS x FROM e JOIN up ON up.shard = e.shard AND up.level = e.level AND up.n = e.n)
SELECT shard, level, n, {' || '.join(f'substr(x, {15 - 2 * k}, 2)' for k in range(8))} || hash AS node FROM f""")
def edge_nodes(spark: SparkSession, d: str) -> DataFrame:
    """When the older half of the twigs goes, the leftmost node that stays on each level, as bytes: place (level in the top byte), lowest first, and hash."""
    roots = trees(spark, d).select("shard", "twig", "root")
    nodes = M.upper_nodes(M.upper_tiers(roots))
    ends = roots.groupBy("shard").agg(F.max("twig").alias("youngest")).select("shard", F.expr("shiftright(youngest + 1, 1)").alias("end"))
    found = M.edges(nodes, ends)
    return found.select("shard", F.col("level").cast("bigint").alias("level"), "n", F.concat(F.lower(F.hex(H.little_endian(F.shiftleft(F.col("level").cast("bigint"), 56) + F.col("n")))), "hash").alias("node"))


@query(f"WITH RECURSIVE {_LEVELS}, {_ACTIVE}, {_UPPER} SELECT t.shard, CAST(12 AS BIGINT) AS level, t.twig AS n, t.root AS hash FROM twig_root t JOIN tops ON tops.shard = t.shard WHERE t.twig < {_KEPT}")
def evicted_twigs(spark: SparkSession, d: str) -> DataFrame:
    """The roots that stay when the older half of the twigs is evicted."""
    rows = trees(spark, d).select("shard", "twig", "root")
    ends = rows.groupBy("shard").agg(F.expr("shiftright(max(twig) + 1, 1)").alias("end"))
    out = M.evicted(rows.join(ends, "shard"), F.lit(0), F.col("end"))
    return out.select("shard", F.col("level").cast("bigint").alias("level"), "n", "hash")


_GENESIS = """two AS (SELECT n, lpad(lower(to_hex(n)), 4, '0') AS a, CASE WHEN n = 65535 THEN repeat('f', 64) ELSE rpad(lpad(lower(to_hex(n + 1)), 4, '0'), 64, '0') END AS b, printf('%04x', n % 4096) AS s FROM range(65536) t(n)),
leaf AS (SELECT CAST(n // 4096 AS INT) AS shard, CAST(n % 4096 AS BIGINT) AS sn, sha256(unhex('2000000000' || rpad(a, 64, '0') || b || repeat('0', 16) || substr(s, 3, 2) || substr(s, 1, 2) || repeat('0', 12))) AS hash, true AS active FROM two)"""


@query(f"WITH RECURSIVE {_levels(_GENESIS)}, {_ACTIVE}, {_UPPER} SELECT shard, level, root FROM shard_root")
def genesis_roots(spark: SparkSession, d: str) -> DataFrame:
    """The roots of a new store, whose leaves are the hashes of the sentries' records without padding."""
    rows = store.sentries(spark)
    none, key = F.unhex(F.lit("")), F.unhex("key_hash")
    record = store.entry_record(key, none, F.unhex("next_key_hash"), F.lit(0).cast("bigint"), F.col("sn"), F.expr("cast(array() AS array<bigint>)"))
    made = rows.select("shard", "sn", F.sha2(store.record_payload(record), 256).alias("hash"), F.lit(True).alias("active"))
    tree = cut(M.tree(made).select("shard", "twig", "root"), "genesis")
    return M.shard_roots(tree).select("shard", F.col("level").cast("bigint").alias("level"), "root")
