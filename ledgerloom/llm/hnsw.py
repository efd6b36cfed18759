"""Approximate nearest neighbours by cosine: a hierarchical navigable small-world graph per shard, results merged.

Equal vectors are indexed once, with their smallest identifiers: a vector can never give more than ``k`` results besides
the query's own row. Shards hold about ``SHARD_VECTORS`` distinct vectors, dealt by hash; a shard's graph is stored as
flat arrays: for each level the nodes on it and a table of neighbours, filled up with -1. Queries go through every shard
in blocks. Candidates are scored again in double precision on the original vectors.
"""

from __future__ import annotations

import heapq
import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, prepare

#: Vectors of a shard, and queries that are sent to a shard at once: about as many bytes as its index, so that neither is copied often.
SHARD_VECTORS, BLOCK_QUERIES = 4096, 8192
#: Neighbours of a node on the upper levels (twice as many on the lowest), and the beams of building and searching.
LINKS, BUILD_BEAM, SEARCH_BEAM = 12, 64, 128


class Graph:
    """The graph over unit vectors; ``levels`` are (nodes, table of neighbours by node) from the lowest."""

    def __init__(self, unit: np.ndarray, seed: int = 5) -> None:
        n = len(unit)
        self.unit, self.entry = unit, 0
        rng = np.random.default_rng(seed)
        height = np.minimum((-np.log(np.maximum(rng.random(n), 1e-12)) / np.log(LINKS)).astype(int), 12)
        height[0] = max(height[0], 0)
        top = -1
        self.tables: list[np.ndarray] = []
        self.degree: list[np.ndarray] = []
        for node in range(n):
            h = int(height[node])
            while len(self.tables) <= h:
                wide = LINKS * 2 if not self.tables else LINKS
                self.tables.append(np.full((n, wide), -1, np.int32))
                self.degree.append(np.zeros(n, np.int32))
            if top < 0:
                self.entry, top = node, h
                continue
            q, at = unit[node], [(float(unit[self.entry] @ unit[node]), self.entry)]
            for level in range(top, h, -1):
                at = self._beam(q, at, 1, level)
            for level in range(min(h, top), -1, -1):
                at = self._beam(q, at, BUILD_BEAM, level)
                for other in self._choose(at, LINKS):
                    self._link(node, other, level)
                    self._link(other, node, level)
            if h > top:
                self.entry, top = node, h

    def _link(self, a: int, b: int, level: int) -> None:
        table, degree = self.tables[level], self.degree[level]
        n, wide = int(degree[a]), table.shape[1]
        if n < wide:
            table[a, n] = b
            degree[a] = n + 1
            return
        every = np.append(table[a], b)
        sims = self.unit[every] @ self.unit[a]
        order = np.argsort(-sims, kind="stable")
        kept = self._choose([(float(sims[i]), int(every[i])) for i in order], wide)
        table[a] = -1
        table[a, : len(kept)] = kept
        degree[a] = len(kept)

    def _choose(self, near: list[tuple[float, int]], most: int) -> list[int]:
        """Of candidates, nearest first, those that are nearer to the node than to any chosen one; filled up with the nearest left."""
        ids = [i for _, i in near]
        if len(ids) <= most:
            return ids
        among = self.unit[ids] @ self.unit[ids].T
        best = np.full(len(ids), -2.0)
        chosen: list[int] = []
        for k, (sim, _) in enumerate(near):
            if sim > best[k]:
                chosen.append(k)
                np.maximum(best, among[k], out=best)
                if len(chosen) == most:
                    break
        if len(chosen) < most:
            taken = set(chosen)
            chosen += [k for k in range(len(ids)) if k not in taken][: most - len(chosen)]
        return [ids[k] for k in chosen]

    def _beam(self, q: np.ndarray, start: list[tuple[float, int]], width: int, level: int) -> list[tuple[float, int]]:
        """The ``width`` nearest nodes found from ``start`` on one level, nearest first."""
        table, unit = self.tables[level], self.unit
        seen = {i for _, i in start}
        open_ = [(-s, i) for s, i in start]
        heapq.heapify(open_)
        found = list(start)
        heapq.heapify(found)
        while len(found) > width:
            heapq.heappop(found)
        while open_:
            s, i = heapq.heappop(open_)
            if len(found) >= width and -s < found[0][0]:
                break
            fresh = [j for j in table[i].tolist() if j >= 0 and j not in seen]
            if not fresh:
                continue
            seen.update(fresh)
            for sim, j in zip((unit[fresh] @ q).tolist(), fresh, strict=True):
                if len(found) < width:
                    heapq.heappush(found, (sim, j))
                    heapq.heappush(open_, (-sim, j))
                elif sim > found[0][0]:
                    heapq.heapreplace(found, (sim, j))
                    heapq.heappush(open_, (-sim, j))
        return sorted(found, reverse=True)

    def search(self, q: np.ndarray, width: int) -> list[int]:
        at = [(float(self.unit[self.entry] @ q), self.entry)]
        for level in range(len(self.tables) - 1, 0, -1):
            at = self._beam(q, at, 1, level)
        return [i for _, i in self._beam(q, at, width, 0)]

    def flat(self) -> dict[str, np.ndarray]:
        """Level 0 has a row for each node; an upper level its nodes and their rows."""
        out = {"entry": np.array([self.entry]), "height": np.array([len(self.tables)]), "links0": self.tables[0]}
        for level in range(1, len(self.tables)):
            on = np.flatnonzero(self.degree[level] > 0)
            out[f"nodes{level}"], out[f"links{level}"] = on.astype(np.int32), self.tables[level][on]
        return out

    @classmethod
    def load(cls, unit: np.ndarray, flat: dict[str, np.ndarray]) -> Graph:
        g = cls.__new__(cls)
        g.unit, g.entry, g.tables, g.degree = unit, int(flat["entry"][0]), [flat["links0"]], []
        for level in range(1, int(flat["height"][0])):
            table = np.full((len(unit), LINKS), -1, np.int32)
            table[flat[f"nodes{level}"]] = flat[f"links{level}"]
            g.tables.append(table)
        return g


def _unit(x: np.ndarray) -> np.ndarray:
    wide = x.astype(np.float64)
    largest = np.abs(wide).max(axis=1, keepdims=True)
    wide /= largest
    return (wide / np.sqrt((wide * wide).sum(axis=1, keepdims=True))).astype(np.float32)


def _tame(x: np.ndarray) -> np.ndarray:
    """The vectors, those divided by their largest component whose squares would overflow or vanish: a cosine is the same."""
    with np.errstate(all="ignore"):
        size = np.sqrt((x * x).sum(axis=1))
    wild = ~np.isfinite(size) | (size < 1e-140)
    if wild.any():
        x = x.copy()
        x[wild] /= np.abs(x[wild]).max(axis=1, keepdims=True)
    return x


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), -1)


def _build(table: pa.Table) -> pa.Table:
    x = _matrix(table.column("v"))
    stored = io.BytesIO()
    np.savez(stored, vectors=x, **Graph(_unit(x)).flat())
    ids = table.column("ids").combine_chunks()
    return pa.table({"dim": pa.array([x.shape[1]], pa.int32()), "index": pa.array([stored.getvalue()], pa.binary()), "ids": pa.array([ids.to_pylist()], pa.list_(pa.list_(pa.int64())))})


def _search(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                row = {c: batch.column(c)[n].as_py() for c in ("index", "ids", "queries", "vectors")}
                stored = dict(np.load(io.BytesIO(row["index"])))
                x = _tame(stored.pop("vectors"))
                graph, size = Graph.load(_unit(x), stored), np.sqrt((x * x).sum(axis=1))
                asked = _tame(np.array(row["vectors"], np.float64).reshape(len(row["queries"]), -1))
                out: list[list] = [[], [], []]
                for own, q, u in zip(row["queries"], asked, _unit(asked), strict=True):
                    near = graph.search(u, max(SEARCH_BEAM, 4 * k))
                    with np.errstate(all="ignore"):
                        exact = x[near] @ q / (size[near] * np.sqrt(q @ q))
                    best: dict[int, float] = {}
                    for s, i in sorted((-s, i) for s, at in zip(exact.tolist(), near, strict=True) for i in row["ids"][at] if i != own):
                        if len(best) < k:
                            best.setdefault(i, -s)
                    for i, s in best.items():
                        for column, value in zip(out, (own, i, s), strict=True):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.float64()), strict=True)], ["query_id", "vec_id", "score"])

    return run, "query_id long, vec_id long, score double"


def nearest(embeddings: DataFrame, every: int = 50, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose vec_id is divisible by ``every`` its ``k`` nearest others found.

    Nearest first, ties to the smaller vec_id; all candidates where there are fewer than ``k``. Vectors that are null,
    empty, zero or hold null, infinite or NaN components take no part, nor do null identifiers; only vectors of one
    length are compared. Rows that repeat an identifier are one candidate and one query, whose score is the best that their
    vectors give. Vectors whose squares overflow or vanish are scaled first, which no cosine notices. Other columns are not
    read.
    """
    spark = embeddings.sparkSession
    prepare(spark)
    v = F.col("embedding").cast("array<double>")
    sound = "size(v) > 0 AND forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity')) AND exists(v, x -> x <> 0)"
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where("vec_id IS NOT NULL AND v IS NOT NULL").where(sound)
    rows = rows.withColumn("v", F.expr("transform(v, x -> x + 0.0D)"))  # one zero
    keyed = rows.select("vec_id", F.size("v").alias("dim"), F.expr("sha2(array_join(transform(v, x -> cast(x AS string)), ','), 256)").alias("key"), "v")

    # the k + 1 smallest identifiers of each distinct vector, through salted groups
    salted = Window.partitionBy("key", (F.pmod(F.xxhash64("vec_id"), F.lit(256))).alias("salt")).orderBy("vec_id")
    few = keyed.select("key", "vec_id").withColumn("nth", F.row_number().over(salted)).where(f"nth <= {k + 1}").select("key", "vec_id")
    few = few.withColumn("nth", F.row_number().over(Window.partitionBy("key").orderBy("vec_id"))).where(f"nth <= {k + 1}")
    ids = few.groupBy("key").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"), F.min("vec_id").alias("vec_id"))
    distinct = cut(keyed.dropDuplicates(["key", "vec_id"]).join(ids, ["key", "vec_id"]).select("key", "dim", "ids", "v"), "hnsw-vectors")
    count = distinct.count()
    schema = "query_id long, rank int, vec_id long, score double"
    if not count:
        return spark.createDataFrame([], schema)
    shards = -(-count // SHARD_VECTORS)
    dealt = distinct.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)))
    index = cut(dealt.groupBy("dim", "shard").applyInArrow(_build, "dim int, index binary, ids array<array<long>>"), "hnsw-index")

    asked = keyed.where(f"pmod(vec_id, {every}) = 0").select(F.col("vec_id").alias("query_id"), "dim", "v").distinct()
    blocks = max(1, -(-asked.count() // BLOCK_QUERIES))
    blocked = asked.withColumn("block", F.pmod(F.xxhash64("query_id", "v"), F.lit(blocks)))
    listed = F.collect_list(F.struct("query_id", "v")).alias("rows")
    query_blocks = blocked.groupBy("dim", "block").agg(listed).select("dim", "block", F.col("rows.query_id").alias("queries"), F.col("rows.v").alias("vectors"))
    query_blocks = cut(query_blocks, "hnsw-queries", few=True)
    spread = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("salt", F.pmod(F.xxhash64("index"), F.lit(shards)))
    run, out = _search(k)
    found = spread.repartition(max(1, shards * blocks), "salt", "block").join(query_blocks, ["dim", "block"]).select("block", "index", "ids", "queries", "vectors").mapInArrow(run, out)
    found = cut(found, "hnsw-found", few=True).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(f"rank <= {k}").select("query_id", "rank", "vec_id", "score")
