"""Scheduling, replay, admission, metrics, workloads and files against plain Python."""

import bisect
import hashlib
import json
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import access, admission, metrics, schedule, state, store, workload
from ledgerloom.plans import catalog
from ledgerloom.sources import files, views

from .oracle import compare


def accesses(spark, items):
    rows = [(1, i, k, w) for i, (reads, writes) in enumerate(items) for keys, w in ((reads, 0), (writes, 1)) for k in keys]
    return spark.createDataFrame(rows, "height long, idx long, k string, w int")


def placed(frames):
    return {r.idx: (r.frame, r.out_idx, r.task_out_start) for r in frames.collect()}


def test_first_fit(spark):
    items = [("", "a"), ("", "a"), ("", "b"), ("a", ""), ("", "c")]
    got = placed(schedule.packed(accesses(spark, items), frames=4))
    assert [got[i][0] for i in range(5)] == [0, 1, 0, 2, 0]
    assert [got[i][1] for i in (0, 2, 4, 1, 3)] == [0, 1, 2, 3, 4]
    assert [got[i][2] for i in (0, 1, 3)] == [0, 3, 4]


def test_full_collision_flushes_the_first(spark):
    got = placed(schedule.packed(accesses(spark, [("", "a")] * 4), frames=2))
    assert [got[i] for i in range(4)] == [(0, 0, 0), (1, 3, 3), (0, 1, 1), (0, 2, 2)]


def test_size_flush_keeps_frame_zero_alone(spark):
    alone = schedule.packed(accesses(spark, [("", f"k{i}") and ([], [f"k{i}"]) for i in range(6)]), frames=2, full=3)
    assert {r.flush_seq for r in alone.collect()} == {0}
    both = [([], ["x"]), ([], ["x"])] + [([], [f"k{i}"]) for i in range(6)]
    assert len({r.flush_seq for r in schedule.packed(accesses(spark, both), frames=2, full=3).collect()}) > 2


def test_single_frame_keeps_order(spark, sf_dir):
    rows = schedule.packed(views.access(spark, sf_dir), frames=1).collect()
    assert rows and all(r.idx == r.out_idx for r in rows)


@pytest.mark.parametrize("bloom", [False, True])
def test_frames_never_collide(spark, sf_dir, bloom):
    rows = views.access(spark, sf_dir)
    frames = schedule.packed(rows, frames=4, full=16, bloom=bloom).cache()
    assert schedule.frame_collisions(frames, rows).count() == 0
    assert frames.groupBy("height", "idx").count().where("count > 1").count() == 0
    assert frames.count() == rows.select("height", "idx").distinct().count()


def test_precedence_defaults(spark):
    items = [([], ["hot"] if i in (3, 70, 200, 400) else [f"k{i}"]) for i in range(401)]
    a = accesses(spark, items)
    got = {r.idx: r.eei for r in access.precedence(access.standing_frames(a.select("height", "idx").distinct()), a).collect()}
    assert got[10] == -1 and got[70] == 3 and got[100] == 0 and got[130] == 1 and got[200] == 71 and got[400] == 271
    assert all(e < i for i, e in got.items())


def test_state_cache(spark):
    rows = [("c", 2, 1, 0), ("w", 3, 2, 1), ("d", 4, 3, 2), ("r", 1, 4, 3)]
    ops = spark.createDataFrame(rows, "key string, op int, value_cents long, event_id long").withColumn("ts", F.lit(0))
    assert {r.key for r in state.last_writes(ops).collect()} == {"c", "w", "d"}
    assert {r.key for r in state.live(state.last_writes(ops)).collect()} == {"c", "w"}


def test_change_order(spark):
    def spelled(shard, digit):
        return f"{shard:x}" + digit * 63

    rows = [(1, 1, spelled(1, "1"), 0), (2, 0, spelled(0, "1"), 1), (3, 0, spelled(0, "0"), 2)]
    df = spark.createDataFrame(rows, "op int, shard int, key_hash string, event_id long").withColumn("ts", F.lit(0))
    assert [r.op for r in df.orderBy(*state.change_order(df)).collect()] == [3, 2, 1]


def model(ops):
    """Replay by dictionaries: next hash and number of every live key, and what each append kills."""
    chain, out, counter = {}, [], {}
    for s in range(16):
        for k in range(4096):
            n = s * 4096 + k
            chain[f"{n:04x}" + "0" * 60] = [f"{n + 1:04x}" + "0" * 60 if n < 65535 else "f" * 64, k]
        counter[s] = 4096
    order = sorted(chain)
    for key, op in ops:
        h = hashlib.sha256(key.encode()).hexdigest()
        s = int(h[0], 16)
        at = bisect.bisect_left(order, h)
        before = order[at - 1]

        def append(x, dead):
            out.append((s, counter[s], x, chain[x][0], tuple(dead)))
            chain[x][1] = counter[s]
            counter[s] += 1

        if op == 2:
            dead = chain[before][1]
            chain[h] = [chain[before][0], None]
            chain[before][0] = h
            order.insert(at, h)
            append(h, [])
            append(before, [dead])
        elif op == 3:
            append(h, [chain[h][1]])
        else:
            dead = [chain[h][1], chain[before][1]]
            chain[before][0] = chain.pop(h)[0]
            order.remove(h)
            append(before, dead)
    return out


def test_exact_replay(spark):
    rng, live, ops = random.Random(5), set(), []
    for _ in range(300):
        key = f"k{rng.randint(0, 60)}"
        op = 2 if key not in live else rng.choice([3, 3, 4])
        (live.add if op == 2 else (live.discard if op == 4 else (lambda _: None)))(key)
        ops.append((key, op))
    rows = [(k, o, i) for i, (k, o) in enumerate(ops)]
    df = state.with_shard(spark.createDataFrame(rows, "key string, op int, event_id long").withColumn("ts", F.lit(0)))
    for digits in (1, 3, 4):
        got = sorted((r.shard, r.sn, r.key_hash, r.next_key_hash, tuple(r.dead)) for r in store.replayed(df, digits).collect())
        assert got == sorted(model(ops))


def test_admission_branches(spark):
    base = {"nonce": 2, "access_len": 4, "balance": 100, "account_nonce": 1, "cost": 10, "external": True, "drained": False}
    base |= {f"{p}_{k}": v for p in admission.POOLS for k, v in (("cost", 0), ("duplicate", False), ("continues", False))}
    cases = [
        ({}, "Added"), ({"nonce": None}, "NoNonce"), ({"access_len": 3}, "BadAccessList"), ({"balance": None}, "BalanceNotEnough"), ({"draining_duplicate": True}, "Duplicate"),
        ({"draining_duplicate": True, "external": False}, "Added"), ({"draining_duplicate": True, "drained": True}, "Added"), ({"draining_cost": 95}, "BalanceNotEnough"), ({"finalized_duplicate": True}, "Duplicate"),
        ({"finalized_cost": 91}, "BalanceNotEnough"), ({"proposed_duplicate": True}, "Duplicate"), ({"finalized_cost": 50, "proposed_cost": 41}, "BalanceNotEnough"), ({"own_duplicate": True}, "Duplicate"),
        ({"own_cost": 91}, "BalanceNotEnough"), ({"account_nonce": 7}, "NotContinuous"), ({"account_nonce": 7, "own_continues": True}, "Added"), ({"nonce": 0, "account_nonce": 7}, "Added"),
    ]
    rows = [{**base, **change, "want": want} for change, want in cases]
    kinds = {"nonce": "long", "access_len": "int", "balance": "long", "account_nonce": "long", "cost": "long", "external": "boolean", "drained": "boolean", "want": "string"}
    kinds |= {f"{p}_{k}": t for p in admission.POOLS for k, t in (("cost", "long"), ("duplicate", "boolean"), ("continues", "boolean"))}
    df = spark.createDataFrame([tuple(r[c] for c in kinds) for r in rows], ", ".join(f"{c} {t}" for c, t in kinds.items()))
    got = admission.outcomes(df).collect()
    assert [r.outcome for r in got] == [r.want for r in got]


@pytest.mark.parametrize("n", [1, 2, 3, 1000])
def test_nearest_rank(spark, n):
    values = [random.Random(n + k).randint(0, 50) * 1000 for k in range(n)]
    got = {r.label: r.value for r in metrics.histogram(spark.createDataFrame([("x", v) for v in values], "name string, value long")).collect()}
    ranked = sorted(values)
    assert got["count"] == n and got["min"] == ranked[0] and got["max"] == ranked[-1] and abs(got["mean"] - sum(ranked) / n) <= 0.5
    for label, p in metrics.PERCENTS.items():
        assert got[label] == ranked[int(p / 100 * (n - 1) + 0.5)]


def test_no_samples(spark):
    assert metrics.histogram(spark.createDataFrame([], "name string, value long")).count() == 0


@pytest.mark.parametrize("bits", range(5, 17))
def test_register_period(bits):
    state_, mask, n = 1, workload.taps(bits), 0
    while True:
        state_, n = workload.step(state_, mask), n + 1
        if state_ == 1:
            break
    assert n == 2**bits - 1


def test_register_jumps(spark):
    mask, state_ = workload.taps(63), 12345
    got = {r.i: r.state for r in workload.register(spark, 63, 12345, 500, 7).collect()}
    for i in range(1, 501):
        state_ = workload.step(state_, mask)
        assert got[i] == state_


def test_traces(spark, tmp_path):
    lines = ['{"from":"a","to":"b","value":"0x1","input":"0x"}', "{broken", '{"from":"a","value":"0x1"}', "[1, 2", '{"from":"c","to":null,"value":"0","input":""}']
    (tmp_path / "t.json").write_text("\n".join(lines))
    assert files.read_traces(spark, str(tmp_path / "t.json")).count() == 3
    rows = files.parse_traces(spark.createDataFrame([(k, x) for k, x in enumerate(lines)], "n int, line string")).collect()
    assert sorted(r.n for r in rows) == [0, 2, 4]


def test_workload_files(spark, tmp_path):
    from ledgerloom.cluster import ship

    ship(spark)
    spark.dataSource.register(files.WorkloadSource)
    rows = [(i, (1 << 47) + i) for i in range(1000)]
    path = f"file://{tmp_path}/w"
    spark.createDataFrame(rows, "src long, dst long").repartition(3).write.format("workload").mode("append").option("path", path).save()
    got = spark.read.format("workload").option("path", path).load()
    assert sorted(map(tuple, got.collect())) == rows
    whole = spark.read.format("binaryFile").load(f"{tmp_path}/w/*.bin")
    assert sorted((r.src, r.dst) for r in files.decode_records(whole).collect()) == rows


def test_commits_and_log(spark, tmp_path):
    commits = spark.createDataFrame([(h, h * 10) for h in range(1, 8)], "height long, size long")
    assert files.newest(commits).first().asDict() == {"height": 7, "size": 70}
    log = spark.createDataFrame([(0, 0, 8), (0, 8, 16), (0, 24, 8)], "shard int, pos long, len long")
    files.write_log(log, f"{tmp_path}/log", 16)
    back = spark.read.parquet(f"{tmp_path}/log")
    assert back.count() == 3 and back.where("segment >= 1").count() == 1
    assert json.dumps(sorted(r.pos for r in files.truncate_tail(files.segmented(log, 16), 24).collect())) == "[0, 8]"


def test_neighbours_by_hand(spark):
    live = sorted(hashlib.sha256(f"k{i}".encode()).hexdigest() for i in range(500))
    every = sorted(live + [f"{n:04x}" + "0" * 60 for n in range(65536)])
    df = spark.createDataFrame([(h,) for h in live], "key_hash string")
    chain = {r.key_hash: r.next_key_hash for r in store.chained(df).collect()}
    assert all(chain[a] == b for a, b in zip(every, [*every[1:], "f" * 64], strict=True))
    probes = [hashlib.sha256(f"p{i}".encode()).hexdigest() for i in range(300)] + live[::7]
    got = {r.probe_hash: r.prev_hash for r in store.predecessors(spark.createDataFrame([(p,) for p in probes], "probe_hash string"), df).collect()}
    assert all(got[p] == every[bisect.bisect_left(every, p) - 1] for p in probes)


def plain_collisions(items):
    return {(i, j) for i, (r, w) in enumerate(items) for j, (r2, w2) in enumerate(items[:i]) if set(w) & (set(r2) | set(w2)) or set(r) & set(w2)}


def some_items(seed, count, keys):
    rng = random.Random(seed)
    return [([f"k{rng.randrange(keys)}" for _ in range(rng.randint(0, 2))], ["hot" if rng.random() < 0.3 else f"k{rng.randrange(keys)}"]) for _ in range(count)]


def deduplicated(spark, items):
    """A write covers a read of the same item."""
    rows = {(1, i, k): 0 for i, (reads, _) in enumerate(items) for k in reads} | {(1, i, k): 1 for i, (_, writes) in enumerate(items) for k in writes}
    return spark.createDataFrame([(*k, w) for k, w in rows.items()], "height long, idx long, k string, w int")


def test_all_pairs_however_far_apart(spark):
    items = some_items(4, 700, 300)
    got = {(r.i, r.j) for r in access.collisions(deduplicated(spark, items)).collect()}
    assert got == plain_collisions(items) and max(i - j for i, j in got) > 600


def test_precedence_over_packed_frames(spark):
    """Every task's wait against a plain search over its packed predecessors."""
    items = some_items(9, 500, 60)
    a = deduplicated(spark, items)
    frames = schedule.packed(a, frames=6, full=8).cache()
    place = {r.idx: r for r in frames.collect()}
    placed = a.join(frames.select("height", "idx", "out_idx"), ["height", "idx"]).select("height", F.col("out_idx").alias("idx"), "k", "w")
    got = {r.idx: r.eei for r in access.precedence(frames.select("height", F.col("out_idx").alias("idx"), F.col("task_out_start").alias("start")), placed).collect()}
    out = {r.out_idx: items[r.idx] for r in place.values()}
    start = {r.out_idx: r.task_out_start for r in place.values()}
    assert sorted(got) == list(range(500)) and len(set(start.values())) > 20
    for i in range(500):
        r, w = out[i]
        back = max(0, i - 128)
        near = [j for j in range(back, start[i]) if set(w) & (set(out[j][0]) | set(out[j][1])) or set(r) & set(out[j][1])]
        assert got[i] == (-1 if start[i] == 0 else near[-1] if near else max(back - 1, 0))


def test_precedence_in_frames_longer_than_the_reach(spark, tmp_path):
    """200 callers of two tasks each fill two frames of 200 tasks: the second frame's last tasks wait for one of their own frame."""
    orders = spark.range(1600).selectExpr("id AS o_orderkey", "id div 8 AS o_custkey", "1.0D AS o_totalprice", "timestamp '1995-01-01' AS o_orderdate")
    orders.write.parquet(str(tmp_path / "orders.parquet"))
    spark.sql("SELECT 0L AS l_orderkey, 1L AS l_partkey, 1L AS l_suppkey, 'N' AS l_returnflag").write.parquet(str(tmp_path / "lineitem.parquet"))
    duck = duckdb.connect()
    for table in ("orders", "lineitem"):
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{tmp_path}/{table}.parquet/*.parquet')")
    got = catalog.queries()["packed_precedence"](spark, str(tmp_path)).collect()
    assert {r.idx: r.eei for r in got} == {i: -1 if i < 200 else i - 129 for i in range(400)}
    compare(catalog.queries()["precedence_invariants"](spark, str(tmp_path)), duck, catalog.oracle_sql()["precedence_invariants"])


def test_precedence_faults_are_seen(spark):
    """Two frames of 200 items, of which only 150 and 250 collide."""
    a = accesses(spark, [([], ["hot" if i in (150, 250) else f"k{i}"]) for i in range(400)])
    items = a.select("height", "idx").distinct().withColumn("start", F.floor(F.col("idx") / 200) * 200)
    right = {r.idx: r.eei for r in access.precedence(items, a).collect()}
    assert right[250] == 150 and right[199] == -1 and right[200] == 71 and right[399] == 270

    def faults(**changed):
        rows = [(1, i, changed.get(f"i{i}", e)) for i, e in right.items()]
        (r,) = access.precedence_faults(spark.createDataFrame(rows, "height long, idx long, eei long"), items, a).collect()
        return r.tasks, r.late, r.wrong

    assert faults() == (400, 0, 0)
    assert faults(i250=199, i251=121) == (400, 0, 2)
    assert faults(i399=271, i398=398, i397=399, i250=200) == (400, 4, 4)
    assert faults(i5=4) == (400, 0, 1)


def test_masks_beyond_64_frames(spark):
    items = [([f"r{i % 50}"], [f"w{i}"]) for i in range(200)]
    rows = deduplicated(spark, items).select("height", "idx", "w", F.col("idx").cast("int").alias("frame"), F.substring(F.sha2("k", 256), 1, 20).alias("h"))
    masks = {}
    for r in access.dependency_masks(rows).collect():
        masks[r.idx] = masks.get(r.idx, 0) | (r.mask & (1 << 64) - 1) << 64 * r.word
    bits = {(i, w): [set(schedule.bloom_bits(k)) for k in keys] for i, item in enumerate(items) for w, keys in enumerate(item)}
    held = {(i, w): set().union(*bits[i, w]) if bits[i, w] else set() for i in range(200) for w in (0, 1)}
    for i in range(200):
        want = 0
        for f in range(200):
            hit = any(b <= held[f, 1] for w in (0, 1) for b in bits[i, w]) or any(b <= held[f, 0] for b in bits[i, 1])
            want |= hit << f
        assert masks.get(i, 0) == want
    frames = access.frame_masks(rows).collect()
    assert {r.word for r in frames} == {0, 1, 2, 3}


def test_tasks_and_lanes(spark):
    items = spark.createDataFrame([(1, i, i % 3) for i in range(30)], "height long, idx long, lane int")
    a = spark.createDataFrame([(1, i, f"k{i // 9}", i % 2) for i in range(30)], "height long, idx long, k string, w int")
    placed, sets = schedule.tasks_of(items, a)
    got = {r.idx: r.task for r in placed.collect()}
    assert all(got[i] == i // 3 // 4 * 4 + i % 3 for i in range(30))
    want = {}
    for i in range(30):
        want[got[i], f"k{i // 9}"] = max(want.get((got[i], f"k{i // 9}"), 0), i % 2)
    assert {(r.task, r.k): r.w for r in sets.collect()} == want


def test_tasks_run_in_order(spark):
    rng = random.Random(6)
    rows = [(1, i // 4, i, f"c{rng.randrange(3)}", rng.randrange(1, 60)) for i in range(40)]
    balances = {"c0": 100, "c1": 30}
    got = {r.idx: (r.ok, r.before) for r in schedule.in_order(spark.createDataFrame(rows, "height long, task long, idx long, caller string, amount long"), spark.createDataFrame([(1, c, b) for c, b in balances.items()], "height long, caller string, balance long")).collect()}
    for task in range(10):
        left = dict(balances)
        for _, _, i, c, amount in rows[4 * task : 4 * task + 4]:
            had = left.get(c, 0)
            assert got[i] == (amount <= had, had)
            left[c] = had - amount if amount <= had else had


def test_pools_when_a_block_is_final(spark):
    items = some_items(2, 120, 25)
    a = deduplicated(spark, items)
    proposed, arrived = a.where("idx < 100"), a.where("idx >= 90")
    included = spark.createDataFrame([(1, i) for i in range(0, 90, 4)], "height long, idx long")
    fate = {r.idx: r.fate for r in schedule.finalized(proposed, arrived, included, frames=3).collect()}
    assert sorted(fate) == list(range(120))
    assert all(fate[i] == "done" for i in range(0, 90, 4)) and all(fate[i] == "pending" for i in range(100, 120))
    # the others by hand: first of three frames whose Bloom bits leave it free
    sets = {i: [[set(schedule.bloom_bits(k)) for k in keys] for keys in ([x for x in items[i][0] if x not in items[i][1]], items[i][1])] for i in range(100) if fate[i] != "done"}
    held = [[set(), set()] for _ in range(3)]
    sizes = [[0, 0] for _ in range(3)]
    for i in sorted(sets):
        reads, writes = sets[i]
        free = [f for f in range(3) if not (any(b <= held[f][1] for b in reads + writes) or any(b <= held[f][0] for b in writes))]
        assert fate[i] == ("kept" if free else "dropped")
        if free:
            for kind, keys in enumerate((reads, writes)):
                held[free[0]][kind] |= set().union(*keys) if keys else set()
                sizes[free[0]][kind] += len(keys)
            if max(sizes[free[0]]) > schedule.MOST_KEYS:
                held[free[0]], sizes[free[0]] = [set(), set()], [0, 0]
    assert {"kept", "dropped"} <= set(fate.values())


def test_derived_sets(spark):
    t = spark.createDataFrame([(1, 0, "a", "b", True), (1, 1, "a", "b", False), (1, 2, "c", None, True)], "height long, idx long, caller string, target string, moves boolean")
    slots = spark.createDataFrame([(1, 1, "b", 0), (1, 1, "s", 1), (1, 2, "c", 0)], "height long, idx long, k string, w int")
    got = {(r.idx, r.k): r.w for r in access.derived(t, slots).collect()}
    assert got == {(0, "a"): 1, (0, "b"): 1, (1, "a"): 1, (1, "b"): 0, (1, "s"): 1, (2, "c"): 1}


def test_record_layout(spark):
    """The golden entry of 96 bytes, and its payload without padding."""
    rows = spark.range(1).select(store.entry_record(
        F.lit("key").cast("binary"), F.lit("value").cast("binary"), F.unhex(F.lit("ab" * 32)), F.lit(12345).cast("bigint"), F.lit(99999).cast("bigint"), F.array(*[F.lit(x).cast("bigint") for x in (0xF1, 0xF2, 0xF3, 0xF4)]),
    ).alias("r"))
    got = rows.select("r", store.record_payload(F.col("r")).alias("p")).first()
    want = "0305000004" + b"keyvalue".hex() + "ab" * 32 + "3930000000000000" + "9f86010000000000" + "".join(f"{x:02x}" + "00" * 7 for x in (0xF1, 0xF2, 0xF3, 0xF4)) + "000000"
    assert got.r.hex() == want and len(got.r) == 96 and got.p.hex() == want[:-6]
    long = spark.range(1).select(store.entry_record(F.lit("k").cast("binary"), F.repeat(F.lit("v"), store.MOST_BYTES).cast("binary"), F.unhex(F.lit("00" * 32)), F.lit(1).cast("bigint"), F.lit(1).cast("bigint"), F.expr("cast(array() AS array<bigint>)")))
    with pytest.raises(Exception, match="an entry of"):
        long.collect()


def test_byte_ranges(spark):
    df = spark.range(1).select(F.unhex(F.lit("00112233")).alias("b"))
    part = lambda a, z: files.byte_range(F.col("b"), F.lit(a), F.lit(z))
    assert [bytes(x).hex() for x in df.select(part(0, 4), part(1, 3), part(4, 4)).first()] == ["00112233", "1122", ""]
    for a, z in ((-1, 2), (3, 2), (0, 5)):
        with pytest.raises(Exception, match="no bytes"):
            df.select(part(a, z)).collect()


def test_compaction_by_hand(spark):
    """Two entries a mutation, tested before each pair, against a model of the shard."""
    rng = random.Random(12)
    for live_count in (5, 12, 14, 19):
        numbers = sorted(rng.sample(range(20), live_count))
        entries = spark.createDataFrame([(0, n, f"k{n}") for n in range(20)], "shard int, sn long, key string")
        live = entries.where(F.col("sn").isin(numbers))
        got = sorted((r.sn, r.dead_sn) for r in store.compacted(live, entries, 10, 7, 10, 3).collect())
        want, active, end = [], list(numbers), 20
        for _ in range(3):
            if len(active) >= 10 and not (end - active[0]) * 7 < len(active) * 10:
                for _ in range(2):
                    old = active.pop(0)
                    want.append((end, old))
                    active.append(end)
                    end += 1
            else:
                break
        assert got == want


def test_chained_random():
    a = workload.chained_random(b"seed", bytes(range(80)), 50)
    assert a == workload.chained_random(b"seed", bytes(range(80)), 50) and len(set(a)) == 50
    first = hashlib.blake2b(hashlib.blake2b(b"seed").digest() + bytes(range(32))).digest()
    assert a[0] == int.from_bytes(first[:8], "little") and a != workload.chained_random(b"other", bytes(range(80)), 50)


@pytest.mark.parametrize("bits", range(17, 64))
def test_wide_registers(bits):
    """The step's matrix has the full order: the state comes back after 2^bits - 1 steps, and not after that by any small prime."""
    mask, whole = workload.taps(bits), (1 << bits) - 1
    assert workload.jump(1, mask, whole, bits) == 1
    for p in (3, 5, 7, 11, 13, 17, 31, 127):
        if whole % p == 0 and whole > p:
            assert workload.jump(1, mask, whole // p, bits) != 1


def test_segment_overflow(spark):
    log = spark.createDataFrame([(0, 0, 8), (0, 8, 24), (0, 32, 8), (0, 40, 8)], "shard int, pos long, len long")
    got = {r.segment: (r.entries, r.first_pos, r.overflow) for r in files.segment_files(log, 16).collect()}
    assert got == {0: (2, 0, 16), 2: (2, 32, 0)}
