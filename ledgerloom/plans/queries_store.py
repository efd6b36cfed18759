"""Queries over the log store: scans, positions, look-ups, activity, merges, compaction, commits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hashing as H
from ..operators import store
from ..shared import once
from ..sources import files
from ..sources import views as V
from ..streaming.ordered import prunable
from .registry import query
from .sqltext import ENTRY, LIVE, OPS, POSITIONED, TX


def log(spark: SparkSession, d: str) -> DataFrame:
    """The simplified log, written once a session."""
    return once(spark, "log", f"{d}/events.parquet", lambda: V.entries(spark, d))


@query(f"WITH {POSITIONED} SELECT shard, sn, pos, key_hash FROM positioned")
def log_scan(spark: SparkSession, d: str) -> DataFrame:
    """The log without its values: number, position, key hash."""
    return store.positioned(log(spark, d)).select("shard", "sn", "pos", "key_hash")


@query(f"WITH {ENTRY} SELECT shard, sn, key_hash FROM entry WHERE sn >> 7 >= 2")
def log_scan_from_twig(spark: SparkSession, d: str) -> DataFrame:
    """The scan from a twig on (of 128 leaves here, to have some at any scale)."""
    return log(spark, d).where(F.shiftright("sn", 7) >= 2).select("shard", "sn", "key_hash")


@query(f"WITH {POSITIONED}, probe AS (SELECT shard, pos FROM positioned UNION SELECT shard, pos + 4 FROM positioned) SELECT p.shard, p.pos, coalesce(e.sn, -1) AS sn, coalesce(e.key, '') AS key FROM probe p LEFT JOIN positioned e ON e.shard = p.shard AND e.pos = p.pos")
def point_reads(spark: SparkSession, d: str) -> DataFrame:
    """Entries at every position of the log, and at places between, where there is none."""
    rows = store.positioned(log(spark, d))
    probe = rows.select("shard", "pos").union(rows.select("shard", F.col("pos") + 4)).distinct()
    return probe.join(rows, ["shard", "pos"], "left").select("shard", "pos", F.coalesce("sn", F.lit(-1).cast("bigint")).alias("sn"), F.coalesce("key", F.lit("")).alias("key"))


@query(f"""WITH {POSITIONED}, b AS (SELECT shard, sn, pos, len, rpad(printf('%016x', sn) || substr(key_hash, 1, 32), CAST(len AS INT) * 2, '0') AS bytes FROM positioned)
SELECT shard, sn, substr(bytes, 9, 16) AS head, substr(bytes, CAST(len AS INT) * 2 - 15, 16) AS tail FROM b""")
def range_reads(spark: SparkSession, d: str) -> DataFrame:
    """Ranges of bytes of every entry: some at its start, and the last eight; a range out of bounds would be an error."""
    rows = store.positioned(log(spark, d)).withColumn("hex", F.concat(F.lower(F.lpad(F.hex("sn"), 16, "0")), F.substring("key_hash", 1, 32)))
    rows = rows.withColumn("bytes", F.unhex(F.rpad("hex", F.col("len").cast("int") * 2, "0")))
    return rows.select("shard", "sn", F.lower(F.hex(files.byte_range(F.col("bytes"), F.lit(4), F.lit(12)))).alias("head"), F.lower(F.hex(files.byte_range(F.col("bytes"), F.col("len") - 8, F.col("len")))).alias("tail"))


@query(f"WITH {POSITIONED}, old AS (SELECT shard, max(pos + len) // 16 * 8 AS size FROM positioned GROUP BY shard) SELECT p.shard, p.sn, p.pos FROM positioned p JOIN old o ON o.shard = p.shard WHERE p.pos >= o.size")
def appended_since(spark: SparkSession, d: str) -> DataFrame:
    """What was appended after known sizes of the shards."""
    rows = store.positioned(log(spark, d))
    old = rows.groupBy("shard").agg((F.floor(F.max(F.col("pos") + F.col("len")) / 16) * 8).alias("size"))
    return rows.join(old, "shard").where("pos >= size").select("shard", "sn", "pos")


@query(f"""WITH {POSITIONED} SELECT shard, pos // 16384 AS segment, count(*) AS entries, CAST(min(pos) AS BIGINT) AS first_pos, CAST(sum(len) AS BIGINT) AS bytes,
CAST(greatest(0, max(pos + len) - (pos // 16384 + 1) * 16384) AS BIGINT) AS overflow FROM positioned GROUP BY shard, pos // 16384""")
def segments(spark: SparkSession, d: str) -> DataFrame:
    """Segments of the log with their contents, and what the last entry of each writes past its end into the next."""
    return files.segment_files(store.positioned(log(spark, d)), 16384)


_SIZES = "z AS (SELECT shard, max(pos + len) AS size FROM positioned GROUP BY shard)"


@query(f"WITH {POSITIONED}, {_SIZES} SELECT p.shard, p.sn FROM positioned p JOIN z ON z.shard = p.shard WHERE pos // 16384 >= (size // 4) // 16384 AND pos + len <= size // 4 * 3")
def pruned_and_truncated(spark: SparkSession, d: str) -> DataFrame:
    """Whole segments below a quarter of each shard's bytes dropped, and the last quarter cut."""
    rows = files.segmented(store.positioned(log(spark, d)), 16384)
    sizes = rows.groupBy("shard").agg(F.max(F.col("pos") + F.col("len")).alias("size"))
    quarter = F.floor(F.col("size") / 4)
    return files.truncate_tail(files.prune_head(rows.join(sizes, "shard"), quarter, 16384), quarter * 3).select("shard", "sn")


@query(f"WITH {POSITIONED} SELECT shard, sn >> 7 AS twig, CAST(min(pos) AS BIGINT) AS first_pos FROM positioned GROUP BY shard, sn >> 7")
def twig_first_positions(spark: SparkSession, d: str) -> DataFrame:
    """The position of each twig's first entry."""
    return store.positioned(log(spark, d)).groupBy("shard", F.shiftright("sn", 7).alias("twig")).agg(F.min("pos").alias("first_pos"))


@query(f"""WITH {ENTRY}, c AS (SELECT height, count(*) AS entries, max(sn) AS last_sn FROM entry GROUP BY height), s AS (SELECT arg_max(struct_pack(height, entries, last_sn), height) AS c FROM c GROUP BY height % 2)
SELECT c.height AS height, c.entries AS entries, c.last_sn AS last_sn FROM (SELECT arg_max(c, c.height) AS c FROM s)""")
def newest_commit(spark: SparkSession, d: str) -> DataFrame:
    """The newer of two alternating commit slots."""
    commits = log(spark, d).groupBy("height").agg(F.count("*").alias("entries"), F.max("sn").alias("last_sn"))
    return files.newest(commits)


@query("""SELECT n AS account, sha256(n::VARCHAR) AS key_hash, CAST(('0x' || substr(sha256(n::VARCHAR), 1, 1)) AS INT) AS shard, (n - 1) // 64 AS task FROM (SELECT c_custkey + 1 AS n FROM customer)""")
def bulk_accounts(spark: SparkSession, d: str) -> DataFrame:
    """An account for every customer, 64 to a task."""
    h = F.sha2(F.col("id").cast("string"), 256)
    return V.table(spark, d, "customer").select((F.col("c_custkey") + 1).alias("id")).select(F.col("id").alias("account"), h.alias("key_hash"), H.shard(h).alias("shard"), F.floor((F.col("id") - 1) / 64).cast("bigint").alias("task"))


@query("""WITH b AS (SELECT page_id, substr(sha256(url), 1, 40) AS address, html, sha256(html) AS code_hash FROM pages), asked AS (SELECT page_id, substr(sha256(url), 1, 40) AS address FROM pages)
SELECT a.page_id, b.address, b.code_hash, CAST(length(b.html) AS BIGINT) AS chars, sha256(b.html) = b.code_hash AS sound FROM asked a JOIN b ON a.address = b.address AND a.page_id = b.page_id""")
def code_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Blobs of addresses with their hash checked."""
    b = V.blobs(spark, d)
    asked = b.select("page_id", "address")
    return asked.join(b, ["page_id", "address"]).select("page_id", "address", "code_hash", F.length("code").cast("bigint").alias("chars"), (F.sha2("code", 256) == F.col("code_hash")).alias("sound"))


@query("""SELECT substr(sha256(url), 1, 40) AS address, max(page_id) AS newest, count(*) AS versions FROM pages GROUP BY 1""")
def code_index(spark: SparkSession, d: str) -> DataFrame:
    """The index over blobs, the newest of each address."""
    return V.blobs(spark, d).groupBy("address").agg(F.max("page_id").alias("newest"), F.count("*").alias("versions"))


@query("""SELECT CAST(n // 4096 AS INT) AS shard, n % 4096 AS sn, rpad(lpad(lower(to_hex(n)), 4, '0'), 64, '0') AS key_hash, CASE WHEN n = 65535 THEN repeat('f', 64) ELSE rpad(lpad(lower(to_hex(n + 1)), 4, '0'), 64, '0') END AS next_key_hash FROM range(65536) t(n)""")
def sentries(spark: SparkSession, d: str) -> DataFrame:
    """The entries every store starts with."""
    return store.sentries(spark)


@query(f"WITH {LIVE} SELECT shard, sn, key FROM live")
def active_entries(spark: SparkSession, d: str) -> DataFrame:
    """Entries that nothing supersedes."""
    return store.active(log(spark, d)).select("shard", "sn", "key")


@query(f"WITH {LIVE} SELECT shard, count(*) AS live FROM live GROUP BY shard")
def live_counts(spark: SparkSession, d: str) -> DataFrame:
    """A2: live entries of each shard."""
    return store.active(log(spark, d)).groupBy("shard").agg(F.count("*").alias("live"))


@query(f"WITH {LIVE}, p AS (SELECT shard, key, sn FROM entry WHERE sn IS NOT NULL) SELECT p.shard, p.key, p.sn FROM p WHERE EXISTS (SELECT 1 FROM live l WHERE l.shard = p.shard AND l.key = p.key AND l.sn = p.sn)")
def liveness_probe(spark: SparkSession, d: str) -> DataFrame:
    """Which (key, number) pairs are live."""
    e = log(spark, d)
    return e.where("sn IS NOT NULL").select("shard", "key", "sn").join(store.active(e), ["shard", "key", "sn"], "left_semi")


@query(f"WITH {LIVE} SELECT shard, sn >> 3 AS at, CAST(bit_or(1 << (sn % 8)::INT) AS BIGINT) AS byte FROM live GROUP BY shard, sn >> 3")
def active_bitmap(spark: SparkSession, d: str) -> DataFrame:
    """The bytes of the active bitmap."""
    rows = store.active(log(spark, d))
    return rows.groupBy("shard", F.shiftright("sn", 3).alias("at")).agg(F.expr("cast(bit_or(shiftleft(1, cast(sn % 8 AS int))) AS bigint)").alias("byte"))


@query(f"WITH {LIVE}, p AS (SELECT DISTINCT key FROM ops UNION SELECT 'none:' || user_id FROM events) SELECT l.key, l.shard, l.sn, l.value FROM p JOIN live l ON substr(l.key_hash, 1, 20) = substr(sha256(p.key), 1, 20) AND l.key = p.key")
def exact_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Every key, and absent ones, looked up by short hash with the key as the residual."""
    absent = V.table(spark, d, "events").select(F.concat(F.lit("none:"), F.col("user_id")).alias("key"))
    probes = log(spark, d).select("key").union(V.operations(spark, d).select("key")).union(absent).distinct()
    return store.exact(probes, store.active(log(spark, d))).select("key", "shard", "sn", "value")


@query(f"WITH {ENTRY}, p AS (SELECT DISTINCT substr(key_hash, 1, 20) AS short FROM entry) SELECT p.short, e.shard, e.sn FROM p JOIN entry e ON substr(e.key_hash, 1, 20) = p.short WHERE e.sn IS NOT NULL")
def all_positions(spark: SparkSession, d: str) -> DataFrame:
    """All appended entries of a short hash."""
    e = log(spark, d).withColumn("short", F.substring("key_hash", 1, 20))
    return e.select("short").distinct().join(e.where("sn IS NOT NULL"), "short").select("short", "shard", "sn")


_SENTRY = "sentry AS (SELECT rpad(lpad(lower(to_hex(n)), 4, '0'), 64, '0') AS key_hash FROM range(65536) t(n))"


@query(f"""WITH {LIVE}, {_SENTRY}, every AS (SELECT key_hash, false AS is_sentry FROM live UNION ALL SELECT key_hash, true FROM sentry)
SELECT key_hash, is_sentry, coalesce(lead(key_hash) OVER (ORDER BY key_hash), repeat('f', 64)) AS next_key_hash FROM every""")
def neighbour_chain(spark: SparkSession, d: str) -> DataFrame:
    """Every live key hash and sentry with its successor."""
    return store.chained(store.active(log(spark, d)).select("key_hash"))


_PROBES = "probe AS (SELECT sha256('probe' || event_id) AS probe_hash FROM events UNION SELECT key_hash FROM live)"


@query(f"""WITH {LIVE}, {_SENTRY}, {_PROBES}, every AS (SELECT key_hash, 1 AS is_key FROM live UNION ALL SELECT key_hash, 1 FROM sentry UNION ALL SELECT probe_hash, 0 FROM probe)
SELECT key_hash AS probe_hash, prev_hash FROM (SELECT key_hash, is_key, last_value(CASE WHEN is_key = 1 THEN key_hash END IGNORE NULLS) OVER (ORDER BY key_hash, is_key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_hash FROM every) WHERE is_key = 0""")
def predecessor_lookup(spark: SparkSession, d: str) -> DataFrame:
    """The largest key hash below each probe, absent keys and present ones."""
    live = store.active(log(spark, d))
    probes = V.table(spark, d, "events").select(F.sha2(F.concat(F.lit("probe"), F.col("event_id")), 256).alias("probe_hash")).union(live.select("key_hash")).distinct()
    return store.predecessors(probes, live.select("key_hash"))


@query(f"""WITH {LIVE}, {_SENTRY}, asked AS (SELECT DISTINCT key, op FROM ops WHERE op IN (2, 3)), h AS (SELECT key, op, sha256(key) AS kh FROM asked),
every AS (SELECT key_hash, 1 AS is_key, NULL AS key FROM live UNION ALL SELECT key_hash, 1, NULL FROM sentry UNION ALL SELECT kh, 0, key FROM h WHERE op = 2),
prev AS (SELECT key, is_key, last_value(CASE WHEN is_key = 1 THEN key_hash END IGNORE NULLS) OVER (ORDER BY key_hash, is_key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS found FROM every)
SELECT h.key, h.op, l.key_hash AS found FROM h JOIN live l ON l.key_hash = h.kh WHERE h.op = 3 UNION ALL SELECT key, 2, found FROM prev WHERE is_key = 0""")
def directed_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Writes look up their own entry, creates the one before."""
    live = store.active(log(spark, d)).select("key_hash")
    asked = V.operations(spark, d).where("op IN (2, 3)").select("key", "op", F.sha2("key", 256).alias("kh")).distinct()
    own = asked.where("op = 3").join(live, F.col("kh") == F.col("key_hash")).select("key", "op", F.col("key_hash").alias("found"))
    before = asked.where("op = 2").join(store.predecessors(asked.where("op = 2").select(F.col("kh").alias("probe_hash")).distinct(), live), F.col("kh") == F.col("probe_hash")).select("key", "op", F.col("prev_hash").alias("found"))
    return own.unionByName(before)


@query(f"""WITH {ENTRY}, cut AS (SELECT max(height) - 24 AS h FROM ops), base AS (SELECT key, max(sn) AS sn FROM entry, cut WHERE height < h AND sn IS NOT NULL GROUP BY key),
later AS (SELECT key, arg_max(op, (ts, event_id)) AS op, arg_max(coalesce(sn, -1), (ts, event_id)) AS sn FROM entry, cut WHERE height >= h GROUP BY key)
SELECT key, sn FROM base WHERE key NOT IN (SELECT key FROM later) UNION ALL SELECT key, sn FROM later WHERE op <> 4""")
def overlay_merge(spark: SparkSession, d: str) -> DataFrame:
    """A base index minus what an overlay changed or erased, plus what the overlay holds."""
    e = log(spark, d)
    e = e.crossJoin(F.broadcast(e.agg((F.max("height") - 24).alias("h"))))
    order = F.struct("ts", "event_id")
    base = e.where("height < h AND sn IS NOT NULL").groupBy("key").agg(F.max("sn").alias("sn"))
    later = e.where("height >= h").groupBy("key").agg(F.max_by("op", order).alias("op"), F.max_by(F.coalesce("sn", F.lit(-1).cast("bigint")), order).alias("sn"))
    return base.join(later.select("key"), "key", "left_anti").unionByName(later.where("op <> 4").select("key", "sn"))


@query(f"""WITH {ENTRY}, c AS (SELECT key, shard, sn, row_number() OVER (PARTITION BY key ORDER BY sn DESC) AS r FROM entry WHERE sn IS NOT NULL AND value_len < 4) SELECT key, shard, sn FROM c WHERE r = 1""".replace("value_len", "length(value)"))
def first_match(spark: SparkSession, d: str) -> DataFrame:
    """Of a key's candidates the first, newest first, that meets a predicate."""
    e = log(spark, d).where("sn IS NOT NULL AND length(value) < 4")
    return e.groupBy("key").agg(F.max_by(F.struct("shard", "sn"), "sn").alias("m")).select("key", "m.shard", "m.sn")


@query(f"""WITH {LIVE}, size AS (SELECT shard, max(sn) + 1 AS e FROM entry GROUP BY shard), use AS (SELECT l.shard, count(*) AS active, min(sn) AS s FROM live l GROUP BY l.shard),
ok AS (SELECT use.shard, e FROM use JOIN size ON size.shard = use.shard WHERE active >= 10 AND NOT ((e - s) * 7 < active * 10)), r AS (SELECT l.shard, l.sn, l.key, e, row_number() OVER (PARTITION BY l.shard ORDER BY l.sn) AS nth FROM live l JOIN ok ON ok.shard = l.shard)
SELECT shard, sn, key, CAST(e + nth - 1 AS BIGINT) AS new_sn FROM r WHERE nth <= 8""")
def compaction_batch(spark: SparkSession, d: str) -> DataFrame:
    """The oldest live entries of shards worth compacting, and their new numbers."""
    e = log(spark, d)
    return store.compaction_candidates(store.active(e), e, 10, 7, 10, 8)


@query(f"""WITH {LIVE}, size AS (SELECT shard, max(sn) + 1 AS sn_end, count(*) FILTER (sn IS NOT NULL) AS entries FROM entry GROUP BY shard), n AS (SELECT shard, count(*) AS active, min(sn) AS sn_start FROM live GROUP BY shard)
SELECT size.shard, entries, active, active >= 10 AND NOT ((sn_end - sn_start) * 7 < active * 10) AS compactible FROM size JOIN n ON n.shard = size.shard""")
def utilization(spark: SparkSession, d: str) -> DataFrame:
    """How full each shard is and whether it is worth compacting."""
    from ..functions.bits import compactible

    e = log(spark, d)
    size = e.groupBy("shard").agg((F.max("sn") + 1).alias("sn_end"), F.count("sn").alias("entries"))
    n = store.active(e).groupBy("shard").agg(F.count("*").alias("active"), F.min("sn").alias("sn_start"))
    return size.join(n, "shard").select("shard", "entries", "active", compactible(F.col("active"), F.col("sn_start"), F.col("sn_end"), 10, 7, 10).alias("compactible"))


@query(f"WITH {OPS}, b AS (SELECT floor(max(height) / 500) * 500 - 10 AS bound FROM ops) SELECT DISTINCT height FROM ops, b WHERE height < bound")
def prunable_heights(spark: SparkSession, d: str) -> DataFrame:
    """Heights that the pruning policy lets go."""
    return prunable(V.operations(spark, d).select("height").distinct())


@query(f"""WITH {LIVE}, b AS (SELECT floor(max(height) / 500) * 500 - 10 AS bound FROM ops), k AS (SELECT shard, min(sn) FILTER (height >= bound) AS young, max(sn) AS top FROM entry, b WHERE sn IS NOT NULL GROUP BY shard), o AS (SELECT shard, min(sn) AS oldest FROM live GROUP BY shard)
SELECT k.shard, CAST(0 AS BIGINT) AS start, CAST(least(coalesce(young, top + 1), coalesce(oldest, top + 1)) >> 11 AS BIGINT) AS "end", least(coalesce(young, top + 1), coalesce(oldest, top + 1)) >> 11 >= 2 AS prunable FROM k LEFT JOIN o ON o.shard = k.shard""")
def prunable_twigs(spark: SparkSession, d: str) -> DataFrame:
    """Twigs that the pruning policy lets go: old enough, before the oldest active entry, and two at least."""
    e = log(spark, d)
    return store.prunable_twigs(store.active(e), e)


@query(f"WITH {ENTRY} SELECT height, shard, count(*) AS entries, coalesce(max(sn), -1) AS last_sn FROM entry WHERE height <= (SELECT min(height) + 100 FROM entry) GROUP BY height, shard")
def stopped_at_height(spark: SparkSession, d: str) -> DataFrame:
    """What is committed of each shard up to a height."""
    e = log(spark, d)
    bound = e.agg((F.min("height") + 100).alias("bound"))
    return e.join(F.broadcast(bound), F.col("height") <= F.col("bound")).groupBy("height", "shard").agg(F.count("*").alias("entries"), F.coalesce(F.max("sn"), F.lit(-1).cast("bigint")).alias("last_sn"))


@query()
def exact_replay(spark: SparkSession, d: str) -> DataFrame:
    """The exact log with predecessors appended again."""
    from ..operators.state import with_shard

    return store.replayed(with_shard(V.operations(spark, d)).where("op <> 1"))


@query(f"WITH {LIVE} SELECT shard, key_hash FROM live")
def replayed_live(spark: SparkSession, d: str) -> DataFrame:
    """The live keys of the exact log are those of the simplified one."""
    log = exact_replay(spark, d)
    dead = log.select("shard", F.explode("dead").alias("sn"))
    return log.join(dead, ["shard", "sn"], "left_anti").where(F.substring("key_hash", 5, 60) != "0" * 60).select("shard", "key_hash")


@query(f"WITH {TX} SELECT DISTINCT height, CAST(('0x' || right(sha256(caller), 2)) AS INT) AS suffix FROM tx")
def caller_suffixes(spark: SparkSession, d: str) -> DataFrame:
    """Distinct caller suffixes of a block."""
    return V.tx(spark, d).select("height", H.hex_int(F.right(F.sha2("caller", 256), F.lit(2))).cast("int").alias("suffix")).distinct()


@query(f"WITH {OPS}, a AS (SELECT DISTINCT key FROM ops WHERE height % 2 = 0), b AS (SELECT DISTINCT key FROM ops WHERE height % 2 = 1) SELECT key, 'both' AS side FROM (SELECT key FROM a INTERSECT SELECT key FROM b) UNION ALL SELECT key, 'even' FROM (SELECT key FROM a EXCEPT SELECT key FROM b) UNION ALL SELECT key, 'odd' FROM (SELECT key FROM b EXCEPT SELECT key FROM a)")
def key_sets(spark: SparkSession, d: str) -> DataFrame:
    """Keys in both of two sets, and in one only, by one aggregation."""
    side = F.max(F.col("height") % 2)
    other = F.min(F.col("height") % 2)
    grouped = V.operations(spark, d).groupBy("key").agg(side.alias("hi"), other.alias("lo"))
    return grouped.select("key", F.when(F.col("hi") != F.col("lo"), "both").when(F.col("hi") == 0, "even").otherwise("odd").alias("side"))


@query(f"WITH {ENTRY}, t AS (SELECT DISTINCT height, shard, sn >> 6 AS n FROM entry WHERE sn IS NOT NULL) SELECT DISTINCT height, shard, n >> 1 AS n FROM t")
def touched_parents(spark: SparkSession, d: str) -> DataFrame:
    """The parents of the nodes that each block touches, each once."""
    return log(spark, d).where("sn IS NOT NULL").select("height", "shard", F.shiftright("sn", 7).alias("n")).distinct()


@query(f"""WITH {LIVE}, {_SENTRY}, gone AS (SELECT DISTINCT sha256(key) AS key_hash FROM ops WHERE op = 4), every AS (SELECT key_hash, 1 AS is_key FROM live UNION ALL SELECT key_hash, 1 FROM sentry UNION ALL SELECT g.key_hash, 0 FROM gone g WHERE NOT EXISTS (SELECT 1 FROM live l WHERE l.key_hash = g.key_hash)),
chain AS (SELECT key_hash AS prev_hash, coalesce(lead(key_hash) OVER (ORDER BY key_hash), repeat('f', 64)) AS key_hash FROM every)
SELECT c.key_hash, c.prev_hash FROM chain c JOIN gone g ON g.key_hash = c.key_hash""")
def delete_predecessors(spark: SparkSession, d: str) -> DataFrame:
    """For every deleted key the entry whose next key hash is its own, over the live entries merged with the deleted ones as an overlay."""
    e = log(spark, d)
    gone = e.where("op = 4").select("key_hash").distinct()
    merged = store.active(e).select("key_hash").union(gone).distinct()
    return store.chain_predecessors(gone, store.chained(merged))


@query(f"""WITH {POSITIONED}, {{prev}} SELECT shard, sn, rpad(lpad(lower(to_hex(octet_length(key::BLOB))), 2, '0') || lpad(lower(to_hex(octet_length(value::BLOB))), 2, '0') || '0000' || CASE WHEN dead_sn IS NULL THEN '00' ELSE '01' END
|| lower(hex(key::BLOB)) || lower(hex(value::BLOB)) || key_hash || {{version}} || {{number}} || CASE WHEN dead_sn IS NULL THEN '' ELSE {{dead}} END, CAST(len AS INT) * 2, '0') AS record FROM le""".format(
    prev="le AS (SELECT *, printf('%016x', height << 24) AS v, printf('%016x', sn) AS s, printf('%016x', coalesce(dead_sn, 0)) AS x FROM positioned)",
    version=" || ".join(f"substr(v, {15 - 2 * k}, 2)" for k in range(8)), number=" || ".join(f"substr(s, {15 - 2 * k}, 2)" for k in range(8)), dead="(" + " || ".join(f"substr(x, {15 - 2 * k}, 2)" for k in range(8)) + ")"))
def entry_records(spark: SparkSession, d: str) -> DataFrame:
    """every entry in the record layout (its own key hash stands for the next one's), padded to the alignment."""
    rows = store.positioned(log(spark, d))
    dead = F.when(F.col("dead_sn").isNull(), F.expr("cast(array() AS array<bigint>)")).otherwise(F.array("dead_sn"))
    record = store.entry_record(F.col("key").cast("binary"), F.col("value").cast("binary"), F.unhex("key_hash"), F.shiftleft("height", 24), F.col("sn"), dead)
    return rows.select("shard", "sn", F.lower(F.hex(record)).alias("record"))


@query(f"""WITH {LIVE}, u AS (SELECT substr(key_hash, 1, 4) AS unit, count(*) AS size, count(*) FILTER (op = 2) AS small FROM live GROUP BY 1), n AS (SELECT substr(key_hash, 1, 4) AS unit, count(*) AS nil FROM entry WHERE op = 4 GROUP BY 1)
SELECT u.unit, size, small, coalesce(nil, 0) AS nil, (coalesce(nil, 0) + small) * 30 > size AS compactible FROM u LEFT JOIN n USING (unit)""")
def index_units(spark: SparkSession, d: str) -> DataFrame:
    """Units of the index (a pair of leading hash bytes) with their erased and unmerged entries, and whether these are more than a thirtieth."""
    e = log(spark, d)
    unit = F.substring("key_hash", 1, 4).alias("unit")
    size = store.active(e).groupBy(unit).agg(F.count("*").alias("size"), F.count(F.when(F.col("op") == 2, 1)).alias("small"))
    nil = e.where("op = 4").groupBy(unit).agg(F.count("*").alias("nil"))
    rows = size.join(nil, "unit", "left").withColumn("nil", F.coalesce("nil", F.lit(0).cast("bigint")))
    return rows.withColumn("compactible", store.index_compactible(F.col("nil"), F.col("small"), F.col("size")))


@query(f"""WITH {LIVE}, size AS (SELECT shard, max(sn) + 1 AS e FROM entry GROUP BY shard), use AS (SELECT l.shard, count(*) AS active, min(sn) AS s FROM live l GROUP BY l.shard),
r AS (SELECT l.*, e, active, row_number() OVER (PARTITION BY l.shard ORDER BY l.sn) - 1 AS i, coalesce(lead(l.sn) OVER (PARTITION BY l.shard ORDER BY l.sn), e) AS after FROM live l JOIN size ON size.shard = l.shard JOIN use ON use.shard = l.shard),
w AS (SELECT *, active >= 10 AND NOT ((e + i - sn) * 7 < active * 10) AS worth FROM r), first_stop AS (SELECT shard, min(i) AS stop FROM w WHERE i % 2 = 0 AND NOT worth GROUP BY shard)
SELECT w.shard, e + i AS sn, key, sn AS dead_sn, height FROM w LEFT JOIN first_stop f ON f.shard = w.shard WHERE i < least(coalesce(stop, 1 << 40), 16)""")
def compacted_entries(spark: SparkSession, d: str) -> DataFrame:
    """The entries that eight mutations append by compacting twice each while it is worth it: the oldest active ones, with their version, new numbers and the ones they supersede."""
    e = log(spark, d)
    return store.compacted(store.active(e), e, 10, 7, 10, 8).select("shard", "sn", "key", "dead_sn", "height")
