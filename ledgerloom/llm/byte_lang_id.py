"""Language identification by a byte convolutional network over fixed-length windows of the whole text."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byte_conv import ByteConv, batches_of, lay_out, training_windows
from .common import _LOWER, fold, prepare, utf8

#: The bound of the sample of labelled rows that the network is fitted on, and of the pieces that are drawn from each whole text.
TRAINING_ROWS, PIECES, PIECE_CHARS = 2400, 6, 300
WIDTHS, WINDOW, STEPS = {2: 8, 3: 16, 4: 16, 5: 16}, 256, 500
UNKNOWN = "und"
_letter = re.compile(r"[^\W\d_]")


def pieces(text: str, key: str, count: int, chars: int):
    """The consecutive pieces of ``chars`` characters that make up the text, or ``count`` of them drawn from all by hash of ``key``."""
    every = f"sequence(0, greatest(0, cast((char_length({text}) - 1) div {chars} AS int)))"
    drawn = f"transform(slice(array_sort(transform({every}, i -> struct(xxhash64(i, {key}) AS h, i AS i))), 1, {count}), x -> x.i)"
    return F.expr(f"transform(CASE WHEN char_length({text}) <= {count * chars} THEN {every} ELSE {drawn} END, i -> substring({text}, i * {chars} + 1, {chars}))")


def sampled(rows: DataFrame, key: str, most: int) -> DataFrame:
    """At most ``most`` rows, those with the smallest hashes of ``key``, gathered through a hash threshold."""
    total = rows.count()
    spread = 1 << 30
    chosen = F.pmod(F.xxhash64(F.col(key), F.lit(17)), F.lit(spread))
    bound = spread if total <= most else int(spread * min(1.0, 1.3 * most / total + 200 / total))
    return rows.withColumn("_order", chosen).where(F.col("_order") < bound).orderBy("_order", key).limit(most).drop("_order")


def train(labelled: DataFrame) -> tuple[ByteConv | None, list[str]]:
    """Fits the network on a bounded sample of (doc_id, text, lang); None where there is nothing to learn from."""
    rows = sampled(labelled.where("lang IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", "lang", pieces("text", "doc_id", PIECES, PIECE_CHARS).alias("pieces")), "doc_id", TRAINING_ROWS).collect()
    langs = sorted({r.lang for r in rows})
    if not langs:
        return None, []
    texts, owners = [], []
    for r in sorted(rows, key=lambda r: r.doc_id):
        for p in r.pieces:
            texts.append(p)
            owners.append(langs.index(r.lang))
    net = ByteConv(WIDTHS, len(langs), WINDOW)
    windows, of = training_windows(texts, WINDOW, net.widest, 3, 0.5)
    labels = np.array(owners)[of]
    counts = np.bincount(labels, minlength=len(langs))
    net.fit(_LOWER[windows], labels, 1.0 / np.sqrt(counts[labels]), STEPS)
    return net, langs


def _predict(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, langs = model.value
        for batch in batches:
            predicted, score = [], []
            for _, texts in batches_of(*utf8(batch.column("text"))):
                if net is not None:
                    buffer, owner = lay_out(texts, net.window, net.widest)
                    z = net.logits(_LOWER[buffer], owner)
                    z -= z.max(axis=1, keepdims=True)
                    p = np.exp(z)
                    p /= p.sum(axis=1, keepdims=True)
                    filled = (buffer[: len(owner) * net.window].reshape(-1, net.window) > 0x40).sum(axis=1) + 1e-3
                    p *= filled[:, None]
                    summed = np.add.reduceat(p, np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]), axis=0)
                    summed /= summed.sum(axis=1, keepdims=True)
                    best = summed.argmax(axis=1)
                for k, t in enumerate(texts):
                    if net is None or not _letter.search(t.decode("utf-8", "replace")):
                        predicted.append(UNKNOWN)
                        score.append(0.0)
                    else:
                        predicted.append(langs[best[k]])
                        score.append(float(min(1.0, summed[k, best[k]])))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(predicted, pa.string()), pa.array(score, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return run, "doc_id long, held_out boolean, lang_pred string, score double"


def predict_languages(documents: DataFrame, folds: int = 3, held_fold: int = 1) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document.

    Learns from text and non-null lang of rows whose crc32(doc_id as text) modulo ``folds`` is not ``held_fold``; a null
    doc_id is predicted but not learned from, its held_out is null. A text that is null or has no letter is ``und`` with
    score 0, and so is every text where there is no row to learn from. The score is the mean probability over the
    windows, weighted by their letters; equal languages fall to the first in order. Other columns are not read.
    """
    spark = documents.sparkSession
    prepare(spark)
    part = fold("doc_id", folds)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    model = spark.sparkContext.broadcast(train(docs.where(part != held_fold)))
    run, schema = _predict(model)
    return docs.select("doc_id", "text", (part == held_fold).alias("held_out")).mapInArrow(run, schema)
