"""Approximate nearest neighbours: a hierarchical navigable small-world graph per shard, results merged."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches, store

#: Shards: this many at least (so that a small table is spread too), and no shard over so many distinct vectors.
LEAST_SHARDS, SHARD_ROWS = 8, 1 << 14
#: Links of a node (twice as many on the ground layer), and list lengths while building and searching.
LINKS, EF_BUILD, EF_SEARCH = 16, 80, 160


class Hnsw:
    """Graph over unit vectors (nearness: largest inner product); neighbours lie in flat integer arrays."""

    def __init__(self, vectors: np.ndarray, links: int = LINKS, ef: int = EF_BUILD, seed: int = 5):
        self.x = np.ascontiguousarray(vectors, dtype=np.float32)
        n = len(self.x)
        self.m = links
        levels = np.minimum((-np.log(np.maximum(np.random.default_rng(seed).random(n), 1e-12)) / np.log(links)).astype(int), 12)
        self.levels = levels
        top = int(levels.max()) if n else 0
        self.rows = [np.flatnonzero(levels >= k) for k in range(top + 1)]  # nodes of each layer
        self.slot = [np.full(n, -1, dtype=np.int32) for _ in range(top + 1)]
        self.near, self.size = [], []
        for k, rows in enumerate(self.rows):
            self.slot[k][rows] = np.arange(len(rows), dtype=np.int32)
            self.near.append(np.full((len(rows), self.width(k)), -1, dtype=np.int32))
            self.size.append(np.zeros(len(rows), dtype=np.int32))
        self.seen = np.zeros(n, dtype=np.int32)
        self.stamp = 0
        self.entry, self.height = -1, -1
        for i in range(n):
            self._insert(i, ef)

    def width(self, layer: int) -> int:
        return self.m * (2 if layer == 0 else 1)

    def neighbours(self, layer: int, i: int) -> np.ndarray:
        s = self.slot[layer][i]
        return self.near[layer][s, : self.size[layer][s]]

    def _layer(self, q: np.ndarray, entries: list[tuple[float, int]], ef: int, layer: int) -> list[tuple[float, int]]:
        """The `ef` nearest found from the entries: (similarity, node), nearest first."""
        self.stamp += 1
        seen, stamp, x, near, size, slot = self.seen, self.stamp, self.x, self.near[layer], self.size[layer], self.slot[layer]
        todo = [(-s, i) for s, i in entries]
        best = list(entries)
        heapq.heapify(todo)
        heapq.heapify(best)
        for _, i in entries:
            seen[i] = stamp
        while todo:
            s, c = heapq.heappop(todo)
            if -s < best[0][0] and len(best) >= ef:
                break
            k = slot[c]
            nb = near[k, : size[k]]
            nb = nb[seen[nb] != stamp]
            if not len(nb):
                continue
            seen[nb] = stamp
            sims = x[nb] @ q
            if len(best) >= ef:
                good = sims > best[0][0]
                nb, sims = nb[good], sims[good]
            for sim, i in zip(sims.tolist(), nb.tolist()):
                if len(best) < ef:
                    heapq.heappush(best, (sim, i))
                elif sim > best[0][0]:
                    heapq.heapreplace(best, (sim, i))
                else:
                    continue
                heapq.heappush(todo, (-sim, i))
        return sorted(best, reverse=True)

    def _choose(self, sims: np.ndarray, nodes: np.ndarray, most: int) -> np.ndarray:
        """Neighbours, nearest first, each nearer to the new node than to a neighbour chosen before; rest fills up."""
        if len(nodes) <= most:
            return nodes
        between = self.x[nodes] @ self.x[nodes].T
        closest = np.full(len(nodes), -2.0, dtype=np.float32)
        kept = np.zeros(len(nodes), dtype=bool)
        n = 0
        for k in range(len(nodes)):
            if closest[k] < sims[k]:
                kept[k] = True
                n += 1
                if n == most:
                    break
                np.maximum(closest, between[k], out=closest)
        if n < most:
            kept[np.flatnonzero(~kept)[: most - n]] = True
        return nodes[kept]

    def _insert(self, i: int, ef: int) -> None:
        level, q = int(self.levels[i]), self.x[i]
        if self.entry < 0:
            self.entry, self.height = i, level
            return
        at = [(float(self.x[self.entry] @ q), self.entry)]
        for layer in range(self.height, level, -1):
            at = self._layer(q, at[:1], 1, layer)
        for layer in range(min(level, self.height), -1, -1):
            at = self._layer(q, at, ef, layer)
            nodes = self._choose(np.asarray([s for s, _ in at], dtype=np.float32), np.asarray([j for _, j in at], dtype=np.int32), self.m)
            s = self.slot[layer][i]
            self.near[layer][s, : len(nodes)] = nodes
            self.size[layer][s] = len(nodes)
            for j in nodes.tolist():
                self._link(layer, j, i)
        if level > self.height:
            self.entry, self.height = i, level

    def _link(self, layer: int, j: int, i: int) -> None:
        s, width = self.slot[layer][j], self.width(layer)
        n = self.size[layer][s]
        if n < width:
            self.near[layer][s, n] = i
            self.size[layer][s] = n + 1
            return
        nodes = np.append(self.near[layer][s, :n], np.int32(i))
        sims = self.x[nodes] @ self.x[j]
        order = np.argsort(-sims, kind="stable")
        nodes = self._choose(sims[order], nodes[order], width - width // 4)
        self.near[layer][s, : len(nodes)] = nodes
        self.size[layer][s] = len(nodes)

    def search(self, q: np.ndarray, ef: int) -> np.ndarray:
        if self.entry < 0:
            return np.zeros(0, dtype=np.int64)
        at = [(float(self.x[self.entry] @ q), self.entry)]
        for layer in range(self.height, 0, -1):
            at = self._layer(q, at[:1], 1, layer)
        return np.asarray([i for _, i in self._layer(q, at, ef, 0)], dtype=np.int64)


def usable(v: Column) -> Column:
    """Not null, not empty, not zero, and all components finite."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.coalesce(~F.exists(v, bad) & F.exists(v, lambda x: x != 0), F.lit(False))


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, ef: int = EF_SEARCH) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest by inner product (in doubles, on the original vectors).

    vectors: vec_id, embedding (array of floats). Rows for which is_query holds are searched for among all rows but
    those of their own vec_id, nearest first, ties to the smaller vec_id. Equal vectors are one node of the graph and
    keep the k + 1 smallest vec_ids, which is all that a result can hold, so copies neither hurt the graph nor make a
    hot key: partial group limits drop the rest before the shuffle. Inner products become cosines by one more
    component (the largest norm is a single aggregate), so the graph works on unit vectors. A shard is a hash of the
    vector; each has its own graph over every one of its vectors, built in one task; queries pass by in batches.
    Unusable vectors (see usable()) and null vec_ids take no part; a repeated row counts once; vectors are compared
    only with those of their own dimension. A query without candidates has no rows. Other columns are not read.
    """
    spark = vectors.sparkSession
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>").alias("embedding"), F.coalesce(is_query, F.lit(False)).alias("q"))
    v = v.where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    norm2 = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    facts = v.groupBy(F.size("embedding").alias("dim")).agg(F.count("*").alias("n"), F.max(norm2).alias("top")).orderBy("dim").collect()
    out = "query_id long, rank int, vec_id long, score double"
    if not facts:
        return spark.createDataFrame([], out)
    base, parts = {}, 0
    for r in facts:
        shards = max(LEAST_SHARDS, -(-r["n"] // SHARD_ROWS))
        base[r["dim"]] = (parts, shards, float(r["top"]) ** 0.5)
        parts += shards
    of_dim = lambda i: F.coalesce(*[F.when(F.size("embedding") == d, F.lit(x[i])) for d, x in base.items()])
    placed = v.withColumn("_h", F.xxhash64("embedding"))
    copies = Window.partitionBy("embedding").orderBy("vec_id")
    kept = placed.select("vec_id", "embedding", "_h").distinct().withColumn("_r", F.row_number().over(copies)).where(F.col("_r") <= k + 1)
    nodes = kept.groupBy("embedding", "_h").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))  # k + 1 at most
    nodes = nodes.select((of_dim(0) + F.pmod("_h", of_dim(1))).cast("int").alias("shard"), F.lit(0).alias("kind"), F.col("_h").alias("qid"), "ids", "embedding")
    asked = placed.where("q").select("vec_id", "embedding").distinct()
    asked = asked.select(F.explode(F.sequence(of_dim(0), of_dim(0) + of_dim(1) - 1)).alias("shard"), F.lit(1).alias("kind"), F.col("vec_id").alias("qid"), F.array().cast("array<long>").alias("ids"), "embedding")
    norms = {d: x[2] for d, x in base.items()}
    small_batches(spark)

    def matrix(column: pa.Array) -> np.ndarray:
        return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held, ids, graph, exact = None, [], [], None, None
        for batch in batches:
            edges = batch.column(0).to_numpy() * 2 + batch.column(1).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(edges)) + 1).tolist(), len(edges)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                part = batch.slice(a, b - a)
                if part.column(0)[0].as_py() != shard:
                    shard, held, ids, graph = part.column(0)[0].as_py(), [], [], None
                if part.column(1)[0].as_py() == 0:
                    held.append(matrix(part.column(4)))
                    ids += part.column(3).to_pylist()
                    continue
                if not held:
                    continue
                if graph is None:
                    raw = np.concatenate(held)
                    exact = raw.astype(np.float64)
                    unit = exact / norms[raw.shape[1]]
                    rest = np.sqrt(np.maximum(0.0, 1.0 - (unit * unit).sum(axis=1, keepdims=True)))
                    graph = Hnsw(np.hstack((unit, rest)))
                rows: list[tuple[int, int, float]] = []
                queries = matrix(part.column(4)).astype(np.float64)
                for qid, q in zip(part.column(2).to_pylist(), queries):
                    unit = np.append(q / np.sqrt(q @ q), 0.0).astype(np.float32)
                    found = graph.search(unit, max(ef, 2 * k))
                    scores = (exact[found] * q).sum(axis=1)
                    mine: list[tuple[float, int]] = []
                    for j in np.argsort(-scores, kind="stable").tolist():
                        if len(mine) >= k and scores[j] < mine[k - 1][0]:
                            break
                        mine += [(float(scores[j]), i) for i in ids[found[j]] if i != qid]
                        mine.sort(key=lambda x: (-x[0], x[1]))
                    rows += [(qid, i, s) for s, i in mine[:k]]
                if rows:
                    yield pa.record_batch([pa.array(c) for c in zip(*rows)], names=["query_id", "vec_id", "score"])

    both = nodes.unionByName(asked).repartitionById(parts, F.col("shard")).sortWithinPartitions("shard", "kind", "qid")
    found = store(both.mapInArrow(run, "query_id long, vec_id long, score double"), "ann-found")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
