"""The store as one object: reads, absence, append, proofs."""

from ledgerloom.operators import merkle
from ledgerloom.operators.facade import LedgerStore
from ledgerloom.operators.state import last_writes, live
from ledgerloom.sources import views


def test_store(spark, sf_dir):
    ops = views.operations(spark, sf_dir).cache()
    whole = LedgerStore(views.entries(spark, sf_dir))
    want = {r.key: str(r.value) for r in live(last_writes(ops)).collect()}
    assert {r.key: r.value for r in whole.live().collect()} == want

    asked = spark.createDataFrame([(k,) for k in [*sorted(want)[:20], "nobody:none"]], "key string")
    assert {r.key: r.value for r in whole.read(asked).collect()} == {k: want[k] for k in sorted(want)[:20]}
    gap = whole.missing(asked).collect()
    assert [r.key for r in gap] == ["nobody:none"] and gap[0].prev_hash < gap[0].next_hash

    middle = sorted(r.height for r in ops.select("height").distinct().collect())[200]
    early = LedgerStore(whole.entries.where(f"height <= {middle}"))
    later = early.append(ops.where(f"height > {middle}"))
    columns = ["shard", "sn", "key", "op", "dead_sn"]
    assert sorted(map(str, later.entries.select(columns).collect())) == sorted(map(str, whole.entries.select(columns).collect()))
    roots = {(r.shard, r.level, r.root) for r in whole.roots().collect()}
    assert {(r.shard, r.level, r.root) for r in later.roots().collect()} == roots and len({r[0] for r in roots}) == len(roots)
    proofs = merkle.verified(merkle.parse_proofs(whole.prove(whole.live().select("shard", "sn")))).collect()
    assert len(proofs) == whole.live().count() and all(r.sound and (r.shard, r.root) in {(s, x) for s, _, x in roots} for r in proofs)
    assert whole.compactable(1, 99, 100, 2).count() <= 32
