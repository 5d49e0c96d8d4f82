"""Nearest neighbours by inner product: a forest of random-projection trees and a shared priority queue.

Inner products become distances when every vector gets one more coordinate that lifts it to the largest norm and a
query gets 0 there. Trees are fitted on a bounded sample of vectors, each node cutting its points at the median of
their projections on the difference of two of them; every vector is then routed to one leaf a tree. A query walks
all trees through one priority queue ordered by its smallest margin so far, and visits as many leaves as the sample's
own queries needed for a recall of ``RECALL`` (a bound on the fit; every vector is indexed and no leaf is capped).
Leaf tasks score a block of queries against the leaf's vectors, recompute what may be among the nearest exactly, and the
best of all visited leaves are ranked.

Of equal vectors only the ``k`` + 1 with the smallest ids can be among anybody's ``k`` nearest, so only they are
indexed. Vectors that are null, empty, zero or hold a null, infinite or undefined number take no part, nor do rows
without an id; vectors of different lengths are never compared. Repeated rows count once. Other columns are ignored.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from catchwise.llm.common import side
from catchwise.llm.hyperplanes import valid
from catchwise.runtime import Cut

TREES, SAMPLE, LEAF, RECALL, TRIALS = 4, 16_384, 512, 0.97, 256
#: Sampled vectors a leaf at least, and queries of one leaf scored in one task.
LEAST, QUERIES = 64, 4096
#: Scores this near are compared exactly.
SLACK = 1e-9


@dataclass
class Forest:
    """Nodes of all trees in one table; children below 0 are leaves (-1 - leaf)."""

    norm: float
    planes: np.ndarray
    cuts: np.ndarray
    children: np.ndarray
    roots: list[int]
    leaves: int
    points: np.ndarray  # the sample
    ids: np.ndarray
    leaf_of: np.ndarray | None = None  # (trees, sample): where the sample lies
    visits: int = 1

    def lifted(self, vectors: np.ndarray) -> np.ndarray:
        return np.hstack([vectors, np.sqrt(np.maximum(self.norm**2 - (vectors**2).sum(axis=1), 0))[:, None]])

    def route(self, vectors: np.ndarray) -> np.ndarray:
        """(trees, vectors): the leaf of each vector."""
        lifted, out = self.lifted(vectors), np.empty((len(self.roots), len(vectors)), dtype=np.int64)
        for tree, root in enumerate(self.roots):
            at = np.full(len(vectors), root)
            while len(own := np.flatnonzero(at >= 0)):
                right = (lifted[own] * self.planes[at[own]]).sum(axis=1) > self.cuts[at[own]]
                at[own] = self.children[at[own], right.astype(int)]
            out[tree] = -1 - at
        return out

    def walk(self, queries: np.ndarray, visits: int) -> list[list[int]]:
        """Leaves of all trees in the order in which each query's shared queue gives them."""
        margins = queries @ self.planes[:, :-1].T - self.cuts if len(self.planes) else np.zeros((len(queries), 0))
        children, out = self.children.tolist(), []
        for own in margins.tolist():
            queue, found = [(-np.inf, root) for root in self.roots], []
            while queue and len(found) < visits:
                least, at = heapq.heappop(queue)  # least: minus the smallest margin on the way
                if at < 0:
                    found.append(-1 - at)
                    continue
                margin = own[at]
                heapq.heappush(queue, (max(least, margin), children[at][0]))
                heapq.heappush(queue, (max(least, -margin), children[at][1]))
            out.append(found)
        return out


def _grow(points: np.ndarray, least: int, rng: np.random.Generator) -> tuple[list, list, list, list[int], int]:
    planes, cuts, children, roots, leaves = [], [], [], [], 0
    for _ in range(TREES):
        todo: list[tuple[np.ndarray, int, int]] = [(np.arange(len(points)), -1, 0)]
        while todo:
            rows, parent, which = todo.pop()
            plane = None
            if len(rows) >= 2 * least:
                for _ in range(3):
                    a, b = rng.choice(rows, 2, replace=False)
                    plane = points[a] - points[b]
                    size = np.linalg.norm(plane)
                    if size > 1e-12:
                        plane = plane / size
                        on = points[rows] @ plane
                        cut = float(np.median(on))
                        right = on > cut
                        if 0 < right.sum() < len(rows):
                            break
                    plane = None
            if plane is None:
                at, leaves = -1 - leaves, leaves + 1
            else:
                at = len(planes)
                planes.append(plane)
                cuts.append(cut)
                children.append([0, 0])
                todo += [(rows[~right], at, 0), (rows[right], at, 1)]
            if parent < 0:
                roots.append(at)
            else:
                children[parent][which] = at
    return planes, cuts, children, roots, leaves


def fit(ids: np.ndarray, vectors: np.ndarray, norm: float, rows: int, k: int, seed: int = 8) -> Forest:
    """Forest over a sample of a table of ``rows`` vectors, with the visits that its own trial queries need."""
    rng = np.random.default_rng(seed)
    f = Forest(norm, np.zeros((0, vectors.shape[1] + 1)), np.zeros(0), np.zeros((0, 2), dtype=np.int64), [], 0, vectors, ids)
    least = max(LEAST, round(LEAF * len(vectors) / max(rows, 1)))
    planes, cuts, children, f.roots, f.leaves = _grow(f.lifted(vectors), least, rng)
    if planes:
        f.planes, f.cuts, f.children = np.array(planes), np.array(cuts), np.array(children)
    trial = rng.permutation(len(vectors))[:TRIALS]
    exact = vectors[trial] @ vectors.T
    exact[np.arange(len(trial)), trial] = -np.inf
    near = np.argsort(-exact, axis=1)[:, : min(k, len(vectors) - 1)]
    leaf_of = f.leaf_of = f.route(vectors)
    if near.shape[1] == 0:
        f.visits = f.leaves
        return f
    met = np.full((len(trial), f.leaves), f.leaves)
    for i, order in enumerate(f.walk(vectors[trial], f.leaves)):
        met[i, order] = np.arange(1, len(order) + 1)
    when = np.sort(met[np.arange(len(trial))[:, None, None], leaf_of.T[near]].min(axis=2).ravel())
    f.visits = int(when[int(np.ceil(RECALL * len(when))) - 1])
    return f


def _vectors(batch: pa.RecordBatch, name: str) -> np.ndarray:
    column = batch.column(batch.schema.get_field_index(name))
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _by_length(batches, name: str):
    """Batches whose vectors are all of one length."""
    for batch in batches:
        sizes = np.array([len(v) for v in batch.column(batch.schema.get_field_index(name))])
        for size in np.unique(sizes):
            yield int(size), batch.filter(pa.array(sizes == size))


def search(df: DataFrame, vec_id: str, vector: str, asks: Column, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found to each row for which ``asks`` (over ``vec_id``) holds."""
    spark = df.sparkSession
    rows = df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector")).filter(F.col("vec_id").isNotNull() & valid("vector")).distinct()
    rows = Cut(rows)
    low = F.row_number().over(W.partitionBy("vector").orderBy("vec_id"))
    items = Cut(rows.df.withColumn("_n", low).filter(F.col("_n") <= k + 1).drop("_n"))
    queries = rows.df.filter(asks)

    sizes = items.df.groupBy(F.size("vector").alias("dim")).agg(F.count("*").alias("n"), F.max(F.aggregate("vector", F.lit(0.0), lambda s, v: s + v * v)).alias("most")).collect()  # a row a length
    forests: dict[int, Forest] = {}
    for dim, n, most in sizes:
        drawn = items.df.filter(F.size("vector") == dim).orderBy(F.xxhash64("vec_id", F.lit(8)), "vec_id").limit(SAMPLE).toPandas()
        forests[dim] = fit(drawn["vec_id"].to_numpy(), np.array(drawn["vector"].tolist()).reshape(len(drawn), dim), float(np.sqrt(most)), n, k)
    shared = spark.sparkContext.broadcast(forests)

    def place(batches):
        for dim, batch in _by_length(batches, "vector"):
            ids, kept = batch.column(0), batch.column(1)
            for tree in shared.value[dim].route(_vectors(batch, "vector")):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), dim, dtype=np.int32)), pa.array(tree), ids, kept], names=["dim", "leaf", "vec_id", "vector"])

    def ask(batches):
        for dim, batch in _by_length(batches, "vector"):
            f = shared.value.get(dim)
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                ids, own = part.column(0).to_numpy(), _vectors(part, "vector")
                order = f.walk(own, f.visits)
                # the k-th best sampled vector of the leaves to be visited bounds what they can add
                visited = np.zeros((len(ids), f.leaves), dtype=bool)
                for i, leaves in enumerate(order):
                    visited[i, leaves] = True
                reached = np.logical_or.reduce([visited[:, leaf] for leaf in f.leaf_of]) & (ids[:, None] != f.ids[None, :])
                known = np.where(reached, own @ f.points.T, -np.inf)
                floor = np.partition(known, -k, axis=1)[:, -k] if known.shape[1] >= k else np.full(len(ids), -np.inf)
                who = np.repeat(np.arange(len(ids)), [len(o) for o in order])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(who), dim, dtype=np.int32)), pa.array(np.concatenate(order).astype(np.int64)), pa.array(ids[who]), part.column(1).take(pa.array(who)), pa.array(floor[who])],
                    names=["dim", "leaf", "query_id", "query", "floor"])

    def rank_leaf(key, asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if not len(asked) or not len(held):
            return pd.DataFrame({"query_id": np.empty(0, np.int64), "vec_id": np.empty(0, np.int64), "score": np.empty(0)})
        x, ids, found = np.stack(held["vector"].to_list()), held["vec_id"].to_numpy(), []
        for at in range(0, len(asked), 512):
            part = asked.iloc[at : at + 512]
            q, who = np.stack(part["query"].to_list()), part["query_id"].to_numpy()
            near = np.where(who[:, None] == ids[None, :], -np.inf, q @ x.T)
            best = np.partition(near, -k, axis=1)[:, -k] if len(ids) > k else np.full(len(q), -np.inf)
            i, j = np.nonzero((near >= np.maximum(best, part["floor"].to_numpy())[:, None] - SLACK * (1 + np.abs(near))) & (near > -np.inf))
            exact = np.cumsum(q[i] * x[j], axis=1)[:, -1] if len(i) else np.empty(0)
            found.append(pd.DataFrame({"query_id": who[i], "vec_id": ids[j], "score": exact}))
        return pd.concat(found)

    placed = items.df.select("vec_id", "vector").mapInArrow(place, "dim int, leaf long, vec_id long, vector array<double>")
    asked = Cut(queries.mapInArrow(ask, "dim int, leaf long, query_id long, query array<double>, floor double"))
    parts = Cut(asked.df.groupBy("dim", "leaf").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("parts")))
    of_leaf = side(parts)
    asked_in = asked.df.join(of_leaf, ["dim", "leaf"]).withColumn("part", F.pmod(F.xxhash64("query_id"), F.col("parts")).cast("int")).drop("parts")
    placed_in = placed.join(of_leaf, ["dim", "leaf"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    keys = ["dim", "leaf", "part"]
    found = asked_in.groupBy(*keys).cogroup(placed_in.groupBy(*keys)).applyInPandas(rank_leaf, "query_id long, vec_id long, score double")
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")).cast("int")
    return once.withColumn("rank", order).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
