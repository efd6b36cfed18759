"""The corpus pipeline: quality classifier, near-duplicate join, benchmark decontamination, mixing, token shards.

Every stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns the columns of documents; the
last returns what reading its shards back says of each document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import byte_quality, raking, shingle_join, template_decontam, token_shards
from ledgerloom.llm.common import cut, new_folder, prepare, table

#: Identifiers up to which a list of documents to drop is broadcast (8 bytes each).
BROADCAST_ROWS = 1_000_000


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose predicted quality is 0. A null text is scored as an empty one; rows are judged one by one."""
    prepare(spark)
    return byte_quality.accepted_rows(docs, byte_quality.quality_model(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each group of documents that reach a Jaccard similarity of 0.8 of five-word shingles.

    Documents without words and rows with a null doc_id are in no group and stay. Rows that repeat a doc_id are one
    document: if it stays, each of its different texts does once, with the smallest of the repeated rows' other values.
    """
    found = shingle_join.linked_documents(docs, size=5, percent=80)
    kept = found.where("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("rows"))
    kept = cut(kept, "near-kept", few=True)
    once = docs.join(kept.where("rows = 1").select("doc_id").hint("merge"), "doc_id", "left_semi")  # shuffled at any size, as it must be at a large one
    several = kept.where("rows > 1").select("doc_id")
    if several.limit(1).count():
        rest = [c for c in docs.columns if c not in ("doc_id", "text")]
        again = docs.join(several, "doc_id", "left_semi")
        again = again.groupBy("doc_id", "text").agg(F.min_by(F.struct(*rest), F.to_json(F.struct(*rest))).alias("rest")) if rest else again.distinct()
        once = once.unionByName(again.select("doc_id", "text", *[F.col("rest")[c].alias(c) for c in rest]))
    return once.select(docs.columns).union(docs.where("doc_id IS NULL"))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item, re-parameterised ones included.

    A document without words holds none. Rows that repeat a doc_id go together; rows with a null doc_id are each judged
    by their own text.
    """
    benchmark = table(spark, sf_dir, "benchmark")
    hit = cut(template_decontam.contaminated(docs, benchmark).select("doc_id").distinct(), "decontaminated", few=True)
    out = docs.join(F.broadcast(hit) if hit.count() <= BROADCAST_ROWS else hit, "doc_id", "left_anti")
    nameless = docs.where("doc_id IS NULL AND text IS NOT NULL")
    if not nameless.limit(1).count():
        return out.select(docs.columns)
    named = nameless.select(F.xxhash64("text").alias("doc_id"), "text").distinct()
    held = cut(template_decontam.contaminated(named, benchmark).select(F.col("doc_id").alias("own text")).distinct(), "decontaminated", few=True)
    nameless = docs.where("doc_id IS NULL").withColumn("own text", F.xxhash64("text")).join(held, "own text", "left_anti")
    return out.where("doc_id IS NOT NULL").select(docs.columns).union(nameless.select(docs.columns))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Samples documents by their calibrated probabilities: by hash of the doc_id, so equal rows share their fate; documents without words stay."""
    mine = [c for c in docs.columns if c in ("n_tokens", "topic", "weight", "probability", "kept")]
    named = docs.withColumnsRenamed({c: f"own {c}" for c in mine})
    kept = raking.sampled_documents(named).where("kept").select(named.columns)
    return kept.withColumnsRenamed({f"own {c}": c for c in mine})


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the token shards and reads them back: a row for each row, a null or empty text with the end id alone, null doc_ids first."""
    return token_shards.token_shards(docs).drop("path")


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontaminated),
    ("mixing sources to target weights", mixed),
    ("token-ID / binary output", shards),
]

#: Trained and sampled stages have no SQL; tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each stage's rows are written as Parquet to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = new_folder(spark, f"stage-{k}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
