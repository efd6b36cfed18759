import random

from pyspark.sql import functions as F

import corpus_pipeline as P
from ledgerloom.llm.common import table
from ledgerloom.llm.raking import sampled_documents

from .helpers import groups
from .test_decontam import brute


def test_stages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    columns, now = docs.columns, docs
    kept = {}
    for name, stage in P.STAGES[:-1]:
        before = now
        now = spark.createDataFrame(stage(spark, before, sf_dir).toPandas(), docs.schema)
        assert now.columns == columns
        kept[name] = (before.select("doc_id", "text").collect(), {r.doc_id for r in now.collect()})
        if name == "mixing sources to target weights":
            assert kept[name][1] == {r.doc_id for r in sampled_documents(before).where("kept").collect()}
    labels = {r.doc_id: r.quality for r in table(spark, sf_dir, "labels").collect()}
    rows, left = kept["quality classifier"]
    known = [r.doc_id for r in rows if r.doc_id in labels]
    assert sum((i in left) == bool(labels[i]) for i in known) / len(known) > 0.95
    rows, left = kept["n-gram Jaccard join"]
    root, _ = groups({r.doc_id: r.text for r in rows}, 5, 80)
    assert left == {i for i, r in root.items() if i == r} and len(left) < len(rows)
    rows, left = kept["benchmark decontamination"]
    items = [(r.item_id, r.text) for r in table(spark, sf_dir, "benchmark").collect()]
    dirty = {d for d, _ in brute([(r.doc_id, r.text) for r in rows], items)}
    assert dirty and left == {r.doc_id for r in rows} - dirty
    last = P.STAGES[-1][1](spark, now, sf_dir).collect()
    assert {r.doc_id for r in last} == {r.doc_id for r in now.collect()}
    assert {r.doc_id for r in P.run(spark, sf_dir).collect()} == {r.doc_id for r in last}


def test_odd_rows(spark, tmp_path):
    rng = random.Random(1)
    rows = [(i, " ".join(f"w{rng.randint(0, 99)}" for _ in range(20)), "en", "s", None) for i in range(40)] + [(None, None, None, None, None), (None, "a b", "en", None, 3), (3, "", None, "s", 0), (7, None, None, None, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).withColumn("score", F.lit("kept")).withColumn("probability", F.lit(1)).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, "not in any document at all")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = P.run(spark, str(tmp_path)).collect()
    assert out and len({r.doc_id for r in out if r.doc_id is not None}) >= len([r for r in out if r.doc_id is not None]) - 1


def test_repeated_and_nameless_rows(spark, tmp_path):
    """Rows of one doc_id keep each of their texts once, the same ones in every run; rows without one are judged by their text."""
    rng = random.Random(3)
    text = lambda: " ".join(f"w{rng.randint(0, 999)}" for _ in range(30))
    a, b, c, item = text(), text(), text(), text()
    rows = [(1, a, "en", "x", 1), (1, a, "en", "w", 2), (1, b, "en", "y", 1), (2, c, "en", "z", 1), (4, c, "en", "z", 1), (None, item, "en", "z", 1), (None, a, "en", "z", 1), (None, None, "en", "z", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted((tuple(r) for r in P.near_duplicates(spark, docs.repartition(3), "").collect()), key=str)
    assert got == sorted([rows[1], rows[2], rows[3], rows[5], rows[6], rows[7]], key=str)
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = sorted((tuple(r) for r in P.decontaminated(spark, docs, str(tmp_path)).collect()), key=str)
    assert got == sorted([r for r in rows if r[1] != item], key=str)


def test_empty(spark, tmp_path):
    for name, schema in (("documents", "doc_id long, text string, lang string, source string, n_chars long"), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0
