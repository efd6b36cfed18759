"""Mixing sources to target weights by iterative proportional fitting.

Every document has a cell: source, language and topic. Token weights of the cells are raked, one marginal after the
other, until all three match their targets; documents are then sampled by the calibrated ratio of their cell's raked to
its own tokens. The topic is the commonest of ``TOPICS`` hash classes among the words of six letters or more (bytes),
so texts that share content words share a topic; ties go to the smaller class.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, prepare, settle, slices, utf8, words

TOPICS = 8
MARGINS = ("source", "lang", "topic")
#: Exponents of the default targets: a marginal's shares to this power, normalised.
TEMPER = {"source": 0.5, "lang": 0.7, "topic": 0.5}
#: The share of all tokens that is sampled.
KEPT_TOKENS = 0.7
#: Cells up to which the fit runs on the driver and the result is broadcast; beyond, it runs as DataFrame steps.
DRIVER_CELLS = 1 << 18
ROUNDS, CLOSE = 200, 1e-9


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        tokens, topics = [], []
        data, offsets = utf8(batch.column("text"))
        for lo, hi in slices(offsets):
            part = offsets[lo : hi + 1]
            start, end, hashed, at = words(data[part[0] : part[-1]], part - part[0])
            doc = np.repeat(np.arange(hi - lo), np.diff(at))
            content = end - start >= 6
            table = np.bincount(doc[content] * TOPICS + (hashed[content] % np.uint64(TOPICS)).astype(np.int64), minlength=(hi - lo) * TOPICS)
            tokens.append(np.diff(at))
            topics.append(table.reshape(-1, TOPICS).argmax(axis=1))
        columns = {n: batch.column(n) for n in batch.schema.names if n not in ("n_tokens", "topic")}
        columns |= {"n_tokens": pa.array(np.concatenate(tokens) if tokens else [], pa.int64()), "topic": pa.array((np.concatenate(topics) if topics else np.zeros(0)).astype(np.int32))}
        yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))
    settle()


def described(documents: DataFrame) -> DataFrame:
    """The documents with n_tokens (words) and topic; a null text has no words and topic 0."""
    prepare(documents.sparkSession)
    base = documents.drop("n_tokens", "topic")
    schema = T.StructType([*base.schema.fields, T.StructField("n_tokens", T.LongType()), T.StructField("topic", T.IntegerType())])
    return base.mapInArrow(_describe, schema)


def default_targets(shares: dict, exponent: float) -> dict:
    raised = {k: v**exponent for k, v in shares.items() if v > 0}
    total = sum(raised.values())
    return {k: v / total for k, v in raised.items()}


def rake(cells: list[tuple], tokens: np.ndarray, targets: dict[str, dict] | None = None) -> np.ndarray:
    """Raked token weights of cells (tuples in the order of MARGINS), with the sum of ``tokens``.

    A target for a value without tokens cannot be met and is left out; a value without a target gets none.
    """
    weight, total = tokens.astype(float).copy(), float(tokens.sum())
    if total <= 0:
        return weight
    plans = []
    for m, name in enumerate(MARGINS):
        values = sorted({c[m] for c in cells}, key=str)
        code = np.array([values.index(c[m]) for c in cells]) if len(values) < 50 else np.array([{v: i for i, v in enumerate(values)}[c[m]] for c in cells])
        own = np.bincount(code, tokens, len(values))
        wanted = (targets or {}).get(name) or default_targets(dict(zip(values, own / total, strict=True)), TEMPER[name])
        aim = np.array([wanted.get(v, 0.0) if o > 0 else 0.0 for v, o in zip(values, own, strict=True)])
        plans.append((code, aim / aim.sum() * total if aim.sum() > 0 else own))
    for _ in range(ROUNDS):
        worst = 0.0
        for code, aim in plans:
            now = np.bincount(code, weight, len(aim))
            factor = np.where(now > 0, aim / np.where(now > 0, now, 1), 0.0)
            worst = max(worst, float(np.abs(now - aim).max()) / total)
            weight *= factor[code]
        if worst < CLOSE:
            break
    return weight


def probabilities(tokens: np.ndarray, weight: np.ndarray, kept: float) -> np.ndarray:
    """Inclusion probabilities in proportion to weight over tokens, scaled so that ``kept`` of all tokens are expected; those that would exceed 1 are 1 and the rest is scaled again."""
    ratio = np.where(tokens > 0, weight / np.maximum(tokens, 1), 0.0)
    if not len(ratio) or ratio.max() <= 0:
        return np.ones(len(tokens))
    capped = np.zeros(len(ratio), bool)
    scale = 1.0
    for _ in range(len(ratio) + 1):
        open_tokens = (ratio * tokens)[~capped].sum()
        scale = max(0.0, kept * tokens.sum() - tokens[capped].sum()) / open_tokens if open_tokens > 0 else 0.0
        over = ~capped & (ratio * scale >= 1)
        if not over.any():
            break
        capped |= over
    return np.where(tokens > 0, np.where(capped, 1.0, np.minimum(1.0, ratio * scale)), 1.0)


def _rake_frames(cells: DataFrame, targets: dict[str, dict] | None, kept: float) -> DataFrame:
    """The fit for more cells than the driver takes: the steps of ``rake`` and ``probabilities`` over a table of cells."""
    now = cells.withColumn("weight", F.col("tokens").cast("double"))
    total = float(cells.agg(F.sum("tokens")).first()[0] or 0)
    if total <= 0:
        return now.withColumn("probability", F.lit(1.0))
    aims = {}
    for m in MARGINS:
        own = cells.groupBy(m).agg(F.sum("tokens").cast("double").alias("own"))
        given = (targets or {}).get(m)
        if given:
            wanted = cells.sparkSession.createDataFrame([(k, float(v)) for k, v in given.items()], f"{m} string, share double")
            own = own.join(wanted, m, "left").withColumn("raised", F.when(F.col("own") > 0, F.coalesce("share", F.lit(0.0))).otherwise(0.0))
        else:
            own = own.withColumn("raised", F.when(F.col("own") > 0, F.pow(F.col("own") / F.lit(total), F.lit(TEMPER[m]))).otherwise(0.0))
        norm = own.agg(F.sum("raised")).first()[0] or 0.0
        aims[m] = cut(own.select(m, (F.col("raised") / F.lit(norm) * F.lit(total) if norm > 0 else F.col("own")).alias("aim")), "raking-aims", few=True)
    for _ in range(ROUNDS):
        now = now.withColumn("gap", F.lit(0.0))
        for m in MARGINS:
            factor = F.when(F.col("now") > 0, F.col("aim") / F.col("now")).otherwise(0.0)
            sums = now.groupBy(m).agg(F.sum("weight").alias("now")).join(aims[m], m).select(m, factor.alias("factor"), F.abs(F.col("now") - F.col("aim")).alias("off"))
            now = now.join(sums, m).withColumn("weight", F.col("weight") * F.col("factor")).withColumn("gap", F.greatest("gap", "off")).drop("factor", "off")
        now = cut(now, "raking-cells", few=True)
        worst = now.agg(F.max("gap")).first()[0]
        now = now.drop("gap")
        if worst / total < CLOSE:
            break
    ratio = F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens")).otherwise(0.0)
    rows, capped, cap, scale = now.withColumn("ratio", ratio), F.lit(False), 0.0, 1.0
    if (rows.agg(F.max("ratio")).first()[0] or 0.0) <= 0:
        return now.withColumn("probability", F.lit(1.0))
    while True:  # every turn caps a cell at least
        got = rows.agg(F.sum(F.when(~capped, F.col("ratio") * F.col("tokens"))), F.sum(F.when(capped, F.col("tokens"))), F.max(F.when(~capped, F.col("ratio")))).first()
        scale = max(0.0, kept * total - (got[1] or 0)) / got[0] if got[0] else 0.0
        if got[2] is None or got[2] * scale < 1:
            break
        cap = max(cap, scale)
        capped = F.col("ratio") * F.lit(cap) >= 1
    chance = F.when(capped, 1.0).otherwise(F.least(F.lit(1.0), F.col("ratio") * F.lit(scale)))
    return rows.withColumn("probability", F.when(F.col("tokens") > 0, chance).otherwise(1.0)).drop("ratio")


def sampled_documents(documents: DataFrame, targets: dict[str, dict] | None = None, kept: float = KEPT_TOKENS) -> DataFrame:
    """The documents with n_tokens, topic, weight (raked over own tokens of the cell), probability and kept.

    A document is kept if a hash of its doc_id (of its text where that is null) falls under its probability, so the
    choice is the same in every run; documents without words count nothing and are kept. Null sources and languages are
    values of their own. Other columns pass through; columns named like the added ones are replaced.
    """
    spark = documents.sparkSession
    docs = described(documents.drop("weight", "probability", "kept"))
    cells = cut(docs.groupBy(*MARGINS).agg(F.sum("n_tokens").alias("tokens")), "raking-cells", few=True)
    names = [F.coalesce(F.col(m).cast("string"), F.lit("\u0000")).alias(m) for m in MARGINS]
    cells = cells.select(*names, "tokens")
    if cells.count() <= DRIVER_CELLS:
        rows = cells.orderBy(*MARGINS).collect()
        tokens = np.array([r.tokens or 0 for r in rows], float)
        keys = [tuple(r[m] for m in MARGINS) for r in rows]
        weight = rake(keys, tokens, targets)
        chance = probabilities(tokens, weight, kept)
        fitted = [(*k, float(w / t) if t > 0 else 1.0, float(p)) for k, t, w, p in zip(keys, tokens, weight, chance, strict=True)]
        plan = F.broadcast(spark.createDataFrame(fitted, "c_source string, c_lang string, c_topic string, weight double, probability double"))
    else:
        share = F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens")).otherwise(1.0)
        plan = _rake_frames(cells, targets, kept).select(*[F.col(m).alias(f"c_{m}") for m in MARGINS], share.alias("weight"), "probability")
    match = [F.coalesce(F.col(m).cast("string"), F.lit("\u0000")) == F.col(f"c_{m}") for m in MARGINS]
    chance = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.col("text"), F.lit("")), F.lit(29)), F.lit(1 << 53)) / F.lit(float(1 << 53))
    out = docs.join(plan, match[0] & match[1] & match[2], "left").drop(*[f"c_{m}" for m in MARGINS])
    return out.withColumn("weight", F.coalesce("weight", F.lit(1.0))).withColumn("probability", F.coalesce("probability", F.lit(1.0))).withColumn("kept", (chance < F.col("probability")) | (F.col("n_tokens") == 0))
