"""Quality classifier: a byte-level convolutional network over overlapping chunks that cover the whole document.

Each chunk's max-pooled responses give the chunk a quality logit; a document's probability is a logistic function of the
mean logit and of the share of good chunks, fitted on the same sample of labelled documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byte_conv import ByteConv, batches_of, lay_out, training_windows
from .byte_lang_id import pieces, sampled
from .common import fold, prepare, settle, utf8

#: The bound of the sample of labelled rows, and of the pieces that are drawn from each whole text.
TRAINING_ROWS, PIECES, PIECE_CHARS = 2400, 8, 512
WIDTHS, WINDOW, STEPS = {3: 8, 5: 16, 8: 8}, 512, 400


def _combine(z: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """For each document: mean clipped logit and share of good chunks of its chunks (in order), and one."""
    starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    n = np.diff(np.r_[starts, len(owner)])
    z = np.clip(z, -8, 8)
    return np.stack([np.add.reduceat(z, starts) / n, np.add.reduceat(1 / (1 + np.exp(-z)), starts) / n, np.ones(len(starts))], axis=1)


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 25) -> np.ndarray:
    """Ridge-regularised logistic regression by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(x.shape[1])
        w += np.linalg.solve(h, x.T @ (y - p) - 0.05 * w)
    return w


def train(labelled: DataFrame) -> tuple[ByteConv, np.ndarray] | tuple[None, float]:
    """Fits on a bounded sample of (doc_id, text, quality); with one class or none only its share is known."""
    rows = sorted(labelled.collect(), key=lambda r: (r.doc_id, r.quality, r.pieces))
    y = np.array([r.quality for r in rows], np.int64)
    if len(set(y.tolist())) < 2:
        return None, float(y.mean()) if len(y) else 0.5
    texts = [p for r in rows for p in r.pieces]
    of_doc = np.repeat(np.arange(len(rows)), [len(r.pieces) for r in rows])
    net = ByteConv(WIDTHS, 2, WINDOW)
    windows, of = training_windows(texts, WINDOW, net.widest, 5, 0.3)
    labels = y[of_doc[of]]
    net.fit(windows, labels, 1.0 / np.sqrt(np.bincount(labels, minlength=2)[labels]), STEPS, batch=64)
    buffer, owner = lay_out([t.encode() for t in texts], net.window, net.widest)
    z = net.logits(buffer, owner)
    return net, _logistic(_combine(z[:, 1] - z[:, 0], of_doc[owner]), y.astype(float))


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, weights = model.value
        for batch in batches:
            scores = []
            for _, texts in batches_of(*utf8(batch.column("text"))):
                if net is None:
                    scores.append(np.full(len(texts), weights))
                    continue
                buffer, owner = lay_out(texts, net.window, net.widest)
                z = net.logits(buffer, owner)
                scores.append(1 / (1 + np.exp(-np.clip(_combine(z[:, 1] - z[:, 0], owner) @ weights, -30, 30))))
            score = np.concatenate(scores) if scores else np.zeros(0)
            columns = {n: batch.column(n) for n in batch.schema.names if n not in ("text", "score", "predicted")}
            columns |= {"score": pa.array(score, pa.float64()), "predicted": pa.array((score >= 0.5).astype(np.int32))}
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return run


def quality_model(documents: DataFrame, labels: DataFrame, folds: int = 3, held_fold: int = 1):
    """The fitted model as a broadcast variable. Labels with a null doc_id or quality say nothing; quality over 0 is 1.

    Repeated labels count once, conflicting ones each; rows that repeat a labelled doc_id are labelled each, at most
    ``TRAINING_ROWS`` in all, whichever hash lowest.
    """
    spark = documents.sparkSession
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("quality") > 0).cast("int").alias("quality")).where("doc_id IS NOT NULL AND quality IS NOT NULL")
    chosen = sampled(known.where(fold("doc_id", folds) != held_fold).dropDuplicates(), "doc_id", TRAINING_ROWS)
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    labelled = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "quality", pieces("text", "doc_id", PIECES, PIECE_CHARS).alias("pieces"))
    # documents may repeat a labelled doc_id, so the bound holds after the join
    labelled = labelled.orderBy(F.xxhash64("doc_id", "quality", "pieces"), "doc_id", "quality").limit(TRAINING_ROWS)
    return spark.sparkContext.broadcast(train(labelled))


def accepted_rows(rows: DataFrame, model) -> DataFrame:
    """Those of ``rows``, with whatever columns, whose text is predicted to be of quality 1."""
    run = _score(model)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for out in run(iter([pa.RecordBatch.from_arrays([batch.column("text").cast(pa.string())], ["text"])])):
                yield batch.filter(pa.array(out.column("predicted").to_numpy() == 1))
        settle()

    return rows.mapInArrow(keep, rows.schema)


def quality_scores(documents: DataFrame, labels: DataFrame, folds: int = 3, held_fold: int = 1) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted (1 if score >= 0.5) of every document.

    Learns from labels whose crc32(doc_id as text) modulo ``folds`` is not ``held_fold``. A null text is scored as an
    empty one; a null doc_id is scored, its held_out is null. With labels of one value only the score is that value, with
    none 0.5. A text of any length is scored whole, by all its chunks. Other columns are not read.
    """
    prepare(documents.sparkSession)
    part = fold("doc_id", folds)
    model = quality_model(documents, labels, folds, held_fold)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), (part == held_fold).alias("held_out"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_score(model), "doc_id long, held_out boolean, score double, predicted int")
