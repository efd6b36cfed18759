"""The domain views in DuckDB SQL, for the oracles."""

TX = """tx AS (SELECT CAST(year(o_orderdate) * 12 + month(o_orderdate) AS BIGINT) AS height,
  row_number() OVER (PARTITION BY year(o_orderdate) * 12 + month(o_orderdate) ORDER BY o_orderkey) - 1 AS idx,
  o_orderkey AS tx_id, 'c' || o_custkey AS caller, CAST(round(o_totalprice * 100) AS BIGINT) AS value_cents FROM orders)"""

ACCESS = f"""{TX}, access AS (SELECT height, idx, k, max(w) AS w FROM (
  SELECT height, idx, caller AS k, 1 AS w FROM tx
  UNION ALL SELECT height, idx, 'p' || l_partkey, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END FROM tx JOIN lineitem ON l_orderkey = tx_id
  UNION ALL SELECT height, idx, 's' || l_suppkey, 0 FROM tx JOIN lineitem ON l_orderkey = tx_id) GROUP BY ALL)"""

ACCOUNT = """account AS (SELECT 'c' || c_custkey AS key, CAST(round(c_acctbal * 100) AS BIGINT) AS balance_cents FROM customer
  UNION ALL SELECT 's' || s_suppkey, CAST(round(s_acctbal * 100) AS BIGINT) FROM supplier)"""

OPS = """raw_ops AS (SELECT CAST(floor(epoch(ts) / 3600) AS BIGINT) AS height, ts, event_id, user_id || ':' || event_type AS key,
  event_type = 'error' AND event_id % 5 = 0 AS removes, CAST(round(value * 100) AS BIGINT) AS value_cents FROM events),
seen_ops AS (SELECT *, coalesce(lag(removes) OVER (PARTITION BY key ORDER BY ts, event_id), true) AS missing FROM raw_ops),
ops AS (SELECT height, ts, event_id, key, CASE WHEN removes AND missing THEN 1 WHEN removes THEN 4 WHEN missing THEN 2 ELSE 3 END AS op, value_cents FROM seen_ops)"""

ENTRY = f"""{OPS}, hashed AS (SELECT *, sha256(key) AS key_hash, CAST(('0x' || substr(sha256(key), 1, 1)) AS INT) AS shard FROM ops WHERE op <> 1),
numbered AS (SELECT *, row_number() OVER (PARTITION BY shard ORDER BY ts, event_id) - 1 AS sn FROM hashed WHERE op <> 4),
both_kinds AS (SELECT * FROM numbered UNION ALL SELECT *, NULL FROM hashed WHERE op = 4),
entry AS (SELECT shard, sn, height, ts, event_id, key, key_hash, CAST(value_cents AS VARCHAR) AS value, op, lag(sn) OVER (PARTITION BY key ORDER BY ts, event_id) AS dead_sn FROM both_kinds)"""

LIVE = f"""{ENTRY}, live AS (SELECT * FROM entry e WHERE sn IS NOT NULL AND NOT EXISTS (SELECT 1 FROM entry d WHERE d.shard = e.shard AND d.dead_sn = e.sn))"""

POSITIONED = f"""{ENTRY}, sized AS (SELECT *, CAST(ceil((octet_length(key::BLOB) + octet_length(value::BLOB) + 53 + CASE WHEN dead_sn IS NULL THEN 0 ELSE 8 END) / 8.0) * 8 AS BIGINT) AS len FROM entry WHERE sn IS NOT NULL),
positioned AS (SELECT *, CAST(sum(len) OVER (PARTITION BY shard ORDER BY sn) - len AS BIGINT) AS pos FROM sized)"""

_A = "substr(sha256(CAST({} AS VARCHAR)), 1, 40)"
TRACE = f"""trace AS (SELECT o_orderkey AS tx_id, {_A.format('o_custkey')} AS "from",
  CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE {_A.format('o_orderkey + 1')} END AS "to",
  CASE WHEN o_orderkey % 7 = 0 THEN '0x0' ELSE '0x' || lower(to_hex(CAST(round(o_totalprice * 100) AS BIGINT))) END AS value,
  CASE o_orderkey % 6 WHEN 1 THEN '0xa9059cbb' || repeat('0', 24) || {_A.format('o_orderkey + 1')} || lpad(lower(to_hex(CAST(round(o_totalprice * 100) AS BIGINT))), 64, '0')
    WHEN 2 THEN '0x23b872dd' || repeat('0', 24) || {_A.format('o_custkey')} || repeat('0', 24) || {_A.format('o_orderkey + 1')} || lpad(lower(to_hex(CAST(round(o_totalprice * 100) AS BIGINT))), 64, '0')
    WHEN 3 THEN '0x095EA7B3' || repeat('0', 24) || {_A.format('o_orderkey + 1')} || lpad(lower(to_hex(CAST(round(o_totalprice * 100) AS BIGINT))), 64, '0')
    WHEN 4 THEN '0xa9059cbb00' ELSE '0x' END AS input FROM orders WHERE o_orderkey % 13 <> 0)"""
