"""Queries of scalar functions: hashes, numbers of tasks, codecs, trace filters, tree levels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bits, codecs, hashing as H
from ..operators import store, workload as W
from ..sources import files
from ..sources import views as V
from .registry import query
from .sqltext import ENTRY, TRACE, TX

_HEX = lambda c: f"lower(hex({c}))"


@query("""SELECT c_custkey, sha256(c_name) AS full_hash, substr(sha256(c_name), 1, 20) AS short_hash, CAST(('0x' || substr(sha256(c_name), 1, 2)) AS INT) // 16 AS shard,
  sha256(unhex('05') || c_name::BLOB) AS one, sha256(unhex('08') || c_name::BLOB || c_mktsegment::BLOB) AS pair,
  CASE WHEN c_custkey % 2 = 0 THEN sha256(unhex('0B') || c_mktsegment::BLOB || c_name::BLOB) ELSE sha256(unhex('0B') || c_name::BLOB || c_mktsegment::BLOB) END AS swapped FROM customer""")
def hashes(spark: SparkSession, d: str) -> DataFrame:
    """Plain, level-prefixed, paired and swapped hashes, shard and short hash."""
    c, name, segment = V.table(spark, d, "customer"), F.col("c_name").cast("binary"), F.col("c_mktsegment").cast("binary")
    return c.select(
        "c_custkey", F.sha2(name, 256).alias("full_hash"), H.short_hash(name).alias("short_hash"), H.shard(F.sha2(name, 256)).alias("shard"), H.hash_one(5, name).alias("one"),
        H.hash_pair(8, name, segment).alias("pair"), H.hash_pair_swapped(11, name, segment, F.col("c_custkey") % 2 == 0).alias("swapped"),
    )


@query("""SELECT p_partkey, substr(sha256(p_name), 1, 40) || lpad(lower(to_hex(p_partkey % 256)), 2, '0') || lpad(lower(to_hex((p_partkey // 256) % 256)), 2, '0') || lpad(lower(to_hex((p_partkey // 65536) % 256)), 2, '0') || repeat('0', 58) AS slot_key FROM part""")
def address_slot_key(spark: SparkSession, d: str) -> DataFrame:
    """20 address bytes and a 32-byte little-endian slot number."""
    slot = F.concat(H.little_endian(F.col("p_partkey"), 3), F.unhex(F.lit("0" * 58)))
    return V.table(spark, d, "part").select("p_partkey", F.lower(F.hex(F.concat(F.unhex(F.substring(F.sha2("p_name", 256), 1, 40)), slot))).alias("slot_key"))


@query(f"""WITH {TX}, last AS (SELECT height, max(idx) AS top FROM tx GROUP BY ALL)
SELECT height, idx, (height << 24) + idx AS task, ((height << 24) + idx) >> 24 AS height_again, ((height << 24) + idx) & 16777215 AS idx_again, idx = 0 AS is_first, idx = top AS is_last FROM tx JOIN last USING (height)""")
def task_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Packed task numbers, their parts, first and last of a block."""
    t = V.tx(spark, d).withColumn("task", bits.task_id(F.col("height"), F.col("idx")))
    last = t.groupBy("height").agg(F.max("idx").alias("top"))
    return t.join(last, "height").select("height", "idx", "task", bits.task_height(F.col("task")).alias("height_again"), bits.task_index(F.col("task")).alias("idx_again"), (F.col("idx") == 0).alias("is_first"), (F.col("idx") == F.col("top")).alias("is_last"))


@query("""SELECT c_custkey, CAST(('0x' || substr(sha256(c_name), 25, 16)) AS UBIGINT)::VARCHAR AS suffix, CAST(('0x' || substr(sha256(c_name), 25, 16)) AS UBIGINT) % 4 AS lane, CAST(('0x' || substr(sha256(c_name), 39, 2)) AS INT) % 64 AS pool FROM customer""")
def address_suffixes(spark: SparkSession, d: str) -> DataFrame:
    """an address's last eight bytes as an unsigned number, its lane, and its pool from the last byte."""
    address = F.substring(F.sha2("c_name", 256), 1, 40)
    suffix = F.conv(F.substring(address, 25, 16), 16, 10)
    return V.table(spark, d, "customer").select("c_custkey", suffix.alias("suffix"), (suffix.cast("decimal(20,0)") % 4).cast("bigint").alias("lane"), (H.hex_int(F.substring(address, 39, 2)) % 64).cast("int").alias("pool"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, CAST(round(l_extendedprice * 100) AS BIGINT) + CAST(round(l_tax * 100) AS BIGINT) * 21000 AS cost,
  CASE WHEN round(l_discount * 100) = 0 AND l_returnflag <> 'R' THEN 0 ELSE 1 END AS access, l_returnflag = 'A' AND l_linestatus = 'F' AS is_contract FROM lineitem""")
def transaction_predicates(spark: SparkSession, d: str) -> DataFrame:
    """Cost, access mode of the recipient, contract account."""
    reads = (F.round(F.col("l_discount") * 100) == 0) & (F.col("l_returnflag") != "R")
    return V.table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", (V.cents("l_extendedprice") + V.cents("l_tax") * 21000).alias("cost"), F.when(reads, 0).otherwise(1).alias("access"),
        ((F.col("l_returnflag") == "A") & (F.col("l_linestatus") == "F")).alias("is_contract"),
    )


@query(f"""WITH {TX}, n AS (SELECT tx_id, value_cents, lower(to_hex(value_cents)) AS x FROM tx), e AS (SELECT *, CASE WHEN value_cents = 0 THEN '' WHEN length(x) % 2 = 1 THEN '0' || x ELSE x END AS v FROM n)
SELECT tx_id, lpad(lower(to_hex(length(v) // 2)), 2, '0') || v AS encoded, value_cents AS decoded FROM e""")
def variable_ints(spark: SparkSession, d: str) -> DataFrame:
    """length byte and minimal big-endian bytes, and the number read from them again."""
    rows = V.tx(spark, d).select("tx_id", codecs.var_int(F.col("value_cents")).alias("encoded"))
    return rows.withColumn("decoded", codecs.read_var_int(F.col("encoded")))


@query(f"""WITH {TX}, n AS (SELECT tx_id, value_cents * 92233720 AS dust FROM tx), s AS (SELECT tx_id, dust, greatest(0, length(bin(dust)) - 48) AS shift FROM n)
SELECT tx_id, CAST(shift AS INT) AS shift, CAST(dust >> shift AS BIGINT) AS mantissa, CAST((dust >> shift) << shift AS BIGINT) AS kept FROM s""")
def dust_codec(spark: SparkSession, d: str) -> DataFrame:
    """shift and 48-bit mantissa of an amount, and what they keep of it."""
    rows = V.tx(spark, d).select("tx_id", (F.col("value_cents") * 92233720).alias("dust")).withColumn("shift", bits.dust_shift(F.col("dust")).cast("int"))
    return rows.select("tx_id", "shift", F.expr("shiftright(dust, shift)").alias("mantissa"), F.expr("shiftleft(shiftright(dust, shift), shift)").alias("kept"))


@query(f"""WITH {ENTRY} SELECT shard, sn, CAST(ceil((octet_length(key::BLOB) + octet_length(value::BLOB) + 53 + CASE WHEN dead_sn IS NULL THEN 0 ELSE 8 END) / 8.0) * 8 AS BIGINT) AS len,
  lower(hex(key::BLOB || value::BLOB || unhex(key_hash))) AS payload, sha256(key::BLOB || value::BLOB || unhex(key_hash)) AS payload_hash FROM entry WHERE sn IS NOT NULL""")
def entry_bytes(spark: SparkSession, d: str) -> DataFrame:
    """serialized length, a payload's bytes and its hash."""
    e = V.entries(spark, d).where("sn IS NOT NULL")
    payload = F.concat(F.col("key").cast("binary"), F.col("value").cast("binary"), F.unhex("key_hash"))
    dead = F.when(F.col("dead_sn").isNotNull(), 1).otherwise(0)
    return e.select("shard", "sn", store.entry_length(F.col("key"), F.col("value"), dead).alias("len"), F.lower(F.hex(payload)).alias("payload"), F.sha2(payload, 256).alias("payload_hash"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN repeat('0', 64) WHEN p_partkey % 5 = 1 THEN rpad(lower(hex(substr(p_name, 1, 2)::BLOB)), 64, '0') ELSE sha256(p_name) END AS key_hash FROM part""")
def entry_key_hashes(spark: SparkSession, d: str) -> DataFrame:
    """key hash of unused entries, sentries and others."""
    key = F.when(F.col("p_partkey") % 5 == 0, F.lit("")).otherwise(F.col("p_name")).cast("binary")
    value = F.when(F.col("p_partkey") % 5 == 1, F.lit("")).otherwise(F.col("p_type")).cast("binary")
    return V.table(spark, d, "part").select("p_partkey", H.entry_key_hash(key, value).alias("key_hash"))


@query(f"""WITH {TX} SELECT tx_id, lower(to_hex(value_cents % 256)) AS low, tx_id * 281474976710 % 72057594037927936 AS again FROM tx""")
def little_endian_ints(spark: SparkSession, d: str) -> DataFrame:
    """little-endian bytes of a number and back."""
    t = V.tx(spark, d)
    wide = F.col("tx_id") * 281474976710 % 72057594037927936
    low = F.lower(F.ltrim(F.regexp_replace(F.hex(F.substring(H.little_endian(F.col("value_cents")), F.lit(1), F.lit(1))), "^0(.)$", "$1")))
    return t.select("tx_id", low.alias("low"), H.from_little_endian(F.substring(H.little_endian(wide), F.lit(1), F.lit(7)), 7).alias("again"))


_ID = "CAST(('0x' || substr(sha256({0}), 11, 2) || substr(sha256({0}), 9, 2) || substr(sha256({0}), 7, 2) || substr(sha256({0}), 5, 2) || substr(sha256({0}), 3, 2) || substr(sha256({0}), 1, 2)) AS BIGINT) % 65535 + 1"


def _account(address: F.Column) -> F.Column:
    """an account number from the first six hash bytes, little-endian, of 65536 accounts."""
    return H.hex_int(H.swap_bytes(F.substring(F.sha2(address, 256), 1, 12), 6)) % 65535 + 1


@query(f"""WITH {TRACE} SELECT tx_id, {_ID.format('"from"')} AS src, {_ID.format('"to"')} AS dst FROM trace
WHERE value NOT IN ('0x0', '0') AND ltrim(coalesce(input, ''), '0x') = '' AND "to" IS NOT NULL""")
def trace_transfers(spark: SparkSession, d: str) -> DataFrame:
    """Plain value transfers of the trace; malformed lines are left out."""
    return W.replayed_transfers(files.parse_traces(V.traces(spark, d)), _account)


@query(f"""WITH {TRACE}, t AS (SELECT tx_id, {_ID.format('"from"')} AS src, {_ID.format('"to"')} AS dst FROM trace WHERE value NOT IN ('0x0', '0') AND ltrim(coalesce(input, ''), '0x') = '' AND "to" IS NOT NULL)
SELECT tx_id, src, dst, CAST((row_number() OVER (ORDER BY tx_id) - 1) // 64 AS BIGINT) AS batch FROM t""")
def replayed_batches(spark: SparkSession, d: str) -> DataFrame:
    """The trace's transfers replayed in order, in batches of 64."""
    from ..functions.ordered import numbered

    rows = W.replayed_transfers(files.parse_traces(V.traces(spark, d)), _account)
    rows = numbered(rows.withColumn("all", F.lit(0)).withColumn("block", F.floor(F.col("tx_id") / V.KEY_BLOCK)), ["all"], "block", ["tx_id"], "nth")
    return rows.select("tx_id", "src", "dst", F.floor(F.col("nth") / 64).cast("bigint").alias("batch"))


@query(f"""WITH {TRACE}, c AS (SELECT tx_id, "from", CASE WHEN starts_with(input, '0x') THEN substr(input, 3) ELSE input END AS data FROM trace WHERE input IS NOT NULL),
s AS (SELECT *, lower(substr(data, 1, 8)) AS selector, length(data) AS n FROM c),
p AS (SELECT tx_id, selector, CASE WHEN selector = '23b872dd' THEN substr(data, 33, 40) ELSE "from" END AS a, CASE WHEN selector = '23b872dd' THEN substr(data, 97, 40) ELSE substr(data, 33, 40) END AS b FROM s
  WHERE (selector IN ('a9059cbb', '095ea7b3') AND n >= 72) OR (selector = '23b872dd' AND n >= 136))
SELECT tx_id, selector, {_ID.format('a')} AS src, {_ID.format('b')} AS dst FROM p""")
def trace_token_calls(spark: SparkSession, d: str) -> DataFrame:
    """token transfers and approvals by selector, with the guards on length."""
    t = files.parse_traces(V.traces(spark, d)).where("input IS NOT NULL").withColumn("data", F.regexp_replace("input", "^(0x)+", ""))
    t = t.withColumn("selector", F.lower(F.substring("data", 1, 8))).withColumn("n", F.length("data"))
    moved = F.col("selector") == "23b872dd"
    t = t.where((F.col("selector").isin("a9059cbb", "095ea7b3") & (F.col("n") >= 72)) | (moved & (F.col("n") >= 136)))
    src = F.when(moved, F.substring("data", 33, 40)).otherwise(F.col("from"))
    dst = F.when(moved, F.substring("data", 97, 40)).otherwise(F.substring("data", 33, 40))
    return t.select("tx_id", "selector", _account(src).alias("src"), _account(dst).alias("dst"))


@query(f"""WITH {TX} SELECT tx_id, '0xa9059cbb' || lpad(substr(sha256(caller), 1, 40), 64, '0') || lpad(lower(to_hex(value_cents)), 64, '0') AS data FROM tx""")
def transfer_call_data(spark: SparkSession, d: str) -> DataFrame:
    """call data of a token transfer."""
    return V.tx(spark, d).select("tx_id", F.concat(F.lit("0xa9059cbb"), F.lpad(F.substring(F.sha2("caller", 256), 1, 40), 64, "0"), F.lpad(F.lower(F.hex("value_cents")), 64, "0")).alias("data"))


@query("""SELECT p_partkey, 12 + CASE WHEN p_partkey = 0 THEN 0 ELSE length(bin(p_partkey)) END AS max_level, p_partkey >> 3 AS max_n_15, p_size >= 10 AND NOT (50 * 7 < p_size * 10) AS compactible,
  CAST(xor(p_partkey * 8 >> 8, p_partkey * 8) % 512 AS BIGINT) AS cache_slot FROM part""")
def tree_numbers(spark: SparkSession, d: str) -> DataFrame:
    """top level, nodes of a level, compaction predicate, cache slot."""
    p, pos = F.col("p_partkey"), F.col("p_partkey") * 8
    return V.table(spark, d, "part").select(
        "p_partkey", bits.max_level(p).cast("int").alias("max_level"), F.shiftright(p, 15 - 12).alias("max_n_15"),
        bits.compactible(F.col("p_size"), F.lit(0), F.lit(50), 10, 7, 10).alias("compactible"), (F.shiftright(pos, 8).bitwiseXOR(pos) % 512).cast("bigint").alias("cache_slot"),
    )


@query("""SELECT event_id, CASE WHEN event_id % 4 = 0 THEN -1 ELSE user_id END AS a, CASE WHEN event_id % 4 = 0 THEN -1 ELSE event_id END AS b FROM events""")
def extra_data(spark: SparkSession, d: str) -> DataFrame:
    """two numbers from 'a:b', or -1 and -1 from anything else."""
    text = F.when(F.col("event_id") % 4 == 0, F.concat_ws(":", "user_id", "event_id", "event_type")).otherwise(F.concat_ws(":", "user_id", "event_id"))
    rows = V.table(spark, d, "events").select("event_id", F.split(text, ":").alias("p"))
    part = lambda k: F.when(F.size("p") == 2, F.col("p")[k].cast("bigint")).otherwise(F.lit(-1).cast("bigint"))
    return rows.select("event_id", part(0).alias("a"), part(1).alias("b"))


@query("""WITH c AS (SELECT c_custkey, c_name, regexp_replace(printf('%016x', c_custkey) || repeat('0', 32) || printf('%016x', CAST(abs(round(c_acctbal * 100)) AS BIGINT)), '^(00)+', '') AS b, regexp_replace(printf('%016x', c_custkey), '^(00)+', '') AS n FROM customer)
SELECT c_custkey, printf('%02x', length(b) // 2) || b || printf('%02x', length(n) // 2) || n || CASE WHEN c_custkey % 3 = 0 THEN sha256(c_name) WHEN c_custkey % 3 = 1 THEN substr(sha256(c_name), 1, 40) ELSE '' END AS encoded, true AS same, c_custkey AS nonce FROM c""")
def account_codec(spark: SparkSession, d: str) -> DataFrame:
    """Accounts encoded and decoded again, balances beyond 128 bits."""
    c = V.table(spark, d, "customer")
    wide = F.unhex(F.concat(F.lpad(F.hex(F.col("c_custkey")), 16, "0"), F.lpad(F.hex(F.abs(V.cents("c_acctbal"))), 48, "0")))
    code = F.when(F.col("c_custkey") % 3 == 0, F.unhex(F.sha2("c_name", 256))).when(F.col("c_custkey") % 3 == 1, F.unhex(F.substring(F.sha2("c_name", 256), 1, 40)))
    encoded = c.select("c_custkey", wide.alias("balance"), codecs.encode_account(wide, F.col("c_custkey"), code).alias("encoded"))
    return encoded.withColumn("decoded", codecs.decode_account(F.col("encoded"))).select("c_custkey", F.lower(F.hex("encoded")).alias("encoded"), (F.col("decoded.balance") == F.col("balance")).alias("same"), F.col("decoded.nonce").alias("nonce"))


@query()
def token_slots(spark: SparkSession, d: str) -> DataFrame:
    """the token balance slot of supplier addresses."""
    address = F.unhex(F.substring(F.sha2("s_name", 256), 1, 40))
    return V.table(spark, d, "supplier").select("s_suppkey", F.lower(F.hex(codecs.token_slot(address))).alias("slot"))
