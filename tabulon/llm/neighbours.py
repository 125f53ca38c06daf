"""Approximate nearest neighbours: a robust-pruned directed graph per shard, searched by beams."""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import table, written

#: Vectors of a shard at most, and queries that a task searches one shard for.
SHARD, BLOCK = 1 << 16, 1 << 14
#: Out-edges that pruning leaves, places more that reverse edges may fill before it, beams of building and of
#: searching, nodes expanded in one step of a search, nodes added in one step of building, relaxation.
DEGREE, SLACK, BUILD_BEAM, SEARCH_BEAM, EXPAND, STEP, ALPHA = 28, 16, 48, 288, 4, 256, 1.4


def lifted(vectors: np.ndarray) -> np.ndarray:
    """Vectors with a coordinate more that gives all of them one length.

    Then the order by distance from a query (whose extra coordinate is 0) is the order by inner
    product, so the graph, which needs distances, serves inner products of any vectors.
    """
    square = (vectors**2).sum(axis=1)
    return np.concatenate([vectors, np.sqrt(np.maximum(square.max(initial=0.0) - square, 0))[:, None]], axis=1).astype(np.float32)


def beam_search(points: np.ndarray, edges: np.ndarray, entry: np.ndarray, queries: np.ndarray, beam: int, expand: int = EXPAND):
    """Greedy search of many queries in step. Returns the beam's node numbers (nearest first; -1: none) and all expanded nodes.

    Each step expands every query's nearest ``expand`` nodes that are not expanded yet, scores their new
    neighbours and keeps the best ``beam``. A query ends when its whole beam is expanded.
    """
    n, q = len(points), len(queries)
    beam = min(beam, n)
    expand = min(expand, beam)
    width = max(beam, len(entry))
    square = (points**2).sum(axis=1)
    nodes = np.full((q, width), n, np.int32)
    dist = np.full((q, width), np.inf, np.float32)
    nodes[:, : len(entry)] = entry
    dist[:, : len(entry)] = square[entry] - 2 * queries @ points[entry].T
    if width > beam:
        best = np.argpartition(dist, beam - 1, axis=1)[:, :beam]
        nodes, dist = np.take_along_axis(nodes, best, 1), np.take_along_axis(dist, best, 1)
    open_ = dist.copy()  # as dist, but infinite once expanded
    # which place of a step first reached a node; node n stands for none
    reached = np.zeros((q, n + 1), np.int16)
    reached[np.arange(q)[:, None], nodes] = 1
    reached[:, n] = 1
    place = np.arange(1, expand * edges.shape[1] + 1, dtype=np.int16)[None, :]
    visited: list[np.ndarray] = []
    live = np.arange(q)
    while len(live):
        own = open_[live]
        at = np.argpartition(own, expand - 1, axis=1)[:, :expand]
        row = np.arange(len(live))[:, None]
        here = np.where(np.isfinite(own[row, at]), nodes[live[:, None], at], n)
        open_[live[:, None], at] = np.inf
        step = np.full((q, expand), -1, np.int64)
        step[live] = np.where(here < n, here, -1)
        visited.append(step)
        near = edges[np.minimum(here, n - 1)]
        near = np.where((here < n)[:, :, None] & (near >= 0), near, n).reshape(len(live), -1)
        near = np.where(reached[live[:, None], near] == 0, near, n)
        reached[live[:, None], near] = np.broadcast_to(place, near.shape)
        i, j = np.nonzero((reached[live[:, None], near] == place) & (near < n))
        reached[:, n] = 1
        new = near[i, j]
        far = np.full(near.shape, np.inf, np.float32)
        far[i, j] = square[new] - 2 * np.einsum("id,id->i", points[new], queries[live[i]])
        all_dist = np.concatenate([dist[live], far], axis=1)
        best = np.argpartition(all_dist, beam - 1, axis=1)[:, :beam]
        dist[live] = np.take_along_axis(all_dist, best, 1)
        nodes[live] = np.take_along_axis(np.concatenate([nodes[live], near], axis=1), best, 1)
        left = np.take_along_axis(np.concatenate([open_[live], far], axis=1), best, 1)
        open_[live] = left
        live = live[np.isfinite(left).any(axis=1)]
    order = np.argsort(dist, axis=1, kind="stable")
    nodes = np.take_along_axis(np.where(np.isfinite(dist), nodes, -1), order, 1).astype(np.int64)
    return nodes, np.concatenate(visited, axis=1) if visited else np.full((q, 0), -1)


def robust_prune(points: np.ndarray, own: np.ndarray, pool: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Out-edges of the nodes ``own`` from candidate pools (-1: none), diverse rather than merely near.

    The nearest candidate is kept, and drops each other one that is nearer to it, by a factor of
    alpha, than to the node itself; then the nearest that is left, and so on.
    """
    edges = np.full((len(own), degree), -1, np.int32)
    for lo in range(0, len(own), 256):
        _prune_some(points, own[lo : lo + 256], np.sort(pool[lo : lo + 256], axis=1), edges[lo : lo + 256], alpha)
    return edges


def _prune_some(points: np.ndarray, own: np.ndarray, pool: np.ndarray, edges: np.ndarray, alpha: float) -> None:
    bad = (pool < 0) | (pool == own[:, None])
    bad[:, 1:] |= pool[:, 1:] == pool[:, :-1]
    flat = points[pool] - points[own][:, None, :]
    dist = np.einsum("npd,npd->np", flat, flat)
    dot = flat @ flat.transpose(0, 2, 1)
    row = np.arange(len(own))
    alive = np.where(bad, np.inf, dist)
    for k in range(edges.shape[1]):
        at = alive.argmin(axis=1)
        ok = np.isfinite(alive[row, at])
        if not ok.any():
            break
        edges[ok, k] = pool[row, at][ok]
        between = dist[row, at][:, None] + dist - 2 * dot[row, at]
        alive[alpha * alpha * between <= dist] = np.inf
        alive[row, at] = np.inf


def build_graph(points: np.ndarray, degree: int = DEGREE, slack: int = SLACK, beam: int = BUILD_BEAM, alpha: float = ALPHA, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Edges (-1: none) and entry nodes of a shard's graph.

    Nodes are added in batches of growing size: a greedy search over the graph so far proposes its beam,
    pruning picks the out-edges, and every edge is offered in reverse. A node takes reverse edges
    beyond ``degree`` until ``slack`` places more are full, and is pruned then, so few are pruned often.
    """
    n = len(points)
    edges = np.full((n, degree + slack), -1, np.int32)
    order = np.random.default_rng(seed).permutation(n)
    centre = int(((points - points.mean(axis=0)) ** 2).sum(axis=1).argmin()) if n else 0
    entry = np.unique(np.r_[centre, order[: min(n, 8)]])
    edges[entry, :degree] = robust_prune(points, entry, np.tile(entry, (len(entry), 1)), degree, alpha)
    rest = order[~np.isin(order, entry)]
    at, size = 0, 8
    while at < len(rest):
        own = rest[at : at + size]
        found, _ = beam_search(points, edges, entry, points[own], beam)
        edges[own, :degree] = robust_prune(points, own, found, degree, alpha)
        _offer_back(points, edges, own, degree, alpha)
        at += size
        size = min(size * 2, STEP)
    return _all_reached(points, edges, entry, beam), entry


def _all_reached(points: np.ndarray, edges: np.ndarray, entry: np.ndarray, beam: int) -> np.ndarray:
    """The edges, and one more to each node that no path from the entries meets: from the nearest node found that has a place left.

    Where none has, all nodes get a place more.
    """
    met = np.zeros(len(points), bool)
    front = entry
    while len(front):
        met[front] = True
        near = np.unique(edges[front])
        near = near[near >= 0]
        front = near[~met[near]]
    lost = np.flatnonzero(~met)
    for lo in range(0, len(lost), STEP):
        own = lost[lo : lo + STEP]
        found, _ = beam_search(points, edges, entry, points[own], beam)
        for node, near in zip(own, found):
            near = near[near >= 0]
            if node in near:  # an edge given to another node has opened a path
                continue
            free = near[edges[near, -1] < 0]
            if not len(free):
                edges = np.pad(edges, ((0, 0), (0, 1)), constant_values=-1)
                free = near
            edges[free[0], np.argmax(edges[free[0]] < 0)] = node
    return edges


def _offer_back(points: np.ndarray, edges: np.ndarray, own: np.ndarray, degree: int, alpha: float) -> None:
    """Adds each edge in reverse; a node with no place left is pruned."""
    most = edges.shape[1]
    source, target = np.repeat(own, most), edges[own].ravel()
    source, target = source[target >= 0], target[target >= 0]
    by = np.argsort(target, kind="stable")
    source, target = source[by], target[by]
    if not len(target):
        return
    heads = np.flatnonzero(np.r_[True, target[1:] != target[:-1]])
    sizes = np.diff(np.r_[heads, len(target)])
    rank = np.arange(len(target)) - np.repeat(heads, sizes)
    for lo in range(0, int(sizes.max()), 2 * degree):  # a node that many point to takes them in portions
        part = (rank >= lo) & (rank < lo + 2 * degree)
        nodes, row = np.unique(target[part], return_inverse=True)
        pool = np.full((len(nodes), most + 2 * degree), -1, np.int32)
        pool[:, :most] = edges[nodes]
        pool[row, most + rank[part] - lo] = source[part]
        ordered = np.sort(pool, axis=1)
        fresh = (ordered >= 0) & (ordered != nodes[:, None])
        fresh[:, 1:] &= ordered[:, 1:] != ordered[:, :-1]
        packed = np.take_along_axis(np.where(fresh, ordered, -1), np.argsort(~fresh, axis=1, kind="stable"), 1)
        count = fresh.sum(axis=1)
        fits = count <= most
        edges[nodes[fits]] = packed[fits, :most]
        full = np.flatnonzero(~fits)
        for i in range(0, len(full), 1024):
            some = full[i : i + 1024]
            edges[nodes[some]] = -1
            edges[nodes[some], :degree] = robust_prune(points, nodes[some], packed[some, : int(count[some].max())], degree, alpha)


class ShardIndex:
    """The vectors of one shard; equal vectors are one node that knows its smallest ids."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, keep: int):
        order = np.lexsort((ids,))
        ids, vectors = ids[order], vectors[order]
        raw = np.ascontiguousarray(vectors + 0.0).view(np.dtype((np.void, vectors.dtype.itemsize * vectors.shape[1]))).ravel()
        _, first, node = np.unique(raw, return_index=True, return_inverse=True)
        self.vectors = vectors[first].astype(float)
        by = np.argsort(node, kind="stable")
        heads = np.flatnonzero(np.r_[True, node[by][1:] != node[by][:-1]])
        sizes = np.diff(np.r_[heads, len(by)])
        # of equal vectors, those after the first `keep` ids can be nobody's neighbours
        self.members = [ids[by[a : a + 1]] if s == 1 else np.unique(ids[by[a : a + s]])[:keep] for a, s in zip(heads, sizes)]
        scale = float(np.sqrt((self.vectors**2).sum(axis=1).max(initial=0.0))) or 1.0
        self.points = lifted(self.vectors / scale)
        self.edges, self.entry = build_graph(self.points)

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int, beam: int):
        """(query id, id, score) of the k nearest found for each query, itself left out."""
        length = np.maximum(np.sqrt((queries**2).sum(axis=1, keepdims=True)), 1e-300)
        flat = np.concatenate([queries / length, np.zeros((len(queries), 1))], axis=1).astype(np.float32)
        found, _ = beam_search(self.points, self.edges, self.entry, flat, max(beam, k + 1))
        for q, (qid, vector) in enumerate(zip(query_ids.tolist(), queries)):
            nodes = found[q][found[q] >= 0]
            score = (self.vectors[nodes] * vector).sum(axis=1)
            own = [self.members[i] for i in nodes]
            ids = np.concatenate(own)
            scores = np.repeat(score, [len(o) for o in own])
            other = ids != qid
            ids, scores = ids[other], scores[other]
            best = np.lexsort((ids, -scores))
            # of rows that share an id, the best
            best = best[np.sort(np.unique(ids[best], return_index=True)[1])][:k]
            yield np.full(len(best), qid), ids[best], scores[best]


def _matrix(rows: pa.Table) -> np.ndarray:
    column = rows.column("v").combine_chunks()
    return column.flatten().to_numpy().reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _building(keep: int):
    def run(key, rows):
        graph = ShardIndex(rows.column("vec_id").to_numpy(), _matrix(rows), keep)
        return pa.table({"dim": pa.array([key[0].as_py()], pa.int32()), "shard": pa.array([key[1].as_py()], pa.int64()), "index": pa.array([pickle.dumps(graph)], pa.binary())})

    return run


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, beam: int = SEARCH_BEAM, shard: int = SHARD) -> DataFrame:
    """``vectors`` and ``queries`` (vec_id long, embedding array of numbers) to (query_id, rank, vec_id, score).

    Nearest is the largest inner product, in double precision; ties go to the smaller vec_id; a
    vector is not its own neighbour. Rows are dealt to shards of about ``shard`` vectors by hash, so a
    vector that many rows share is spread over all of them; every shard is searched for every query,
    in blocks of queries. Vectors that are null, empty, zero, or hold null or non-finite numbers take no
    part, nor do rows with a null id; only vectors of one dimension are compared. Of rows that
    repeat an id, each is a vector, and the id's best score counts.

    Every query meets every shard, so work and shuffle grow with queries times shards: shards are as large
    as a task's memory allows (65,536 vectors of 64 numbers and their graph take some 80 MB), which
    keeps them few, and a search grows far slower than its shard. Shards are built side by side, a partition each.
    """
    def usable(df: DataFrame) -> DataFrame:
        v = F.col("embedding").cast("array<double>")
        fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
        return df.where(F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long"), v.alias("v"), F.size(v).alias("dim")).where(fine)

    rows, asked = usable(vectors), usable(queries)
    counts = {r["dim"]: r["n"] for r in rows.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each dimension
    asks = {r["dim"]: r["n"] for r in asked.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()}
    spark = vectors.sparkSession
    plan = spark.createDataFrame([(d, -(-n // shard), -(-asks[d] // BLOCK)) for d, n in counts.items() if d in asks], "dim int, shards long, blocks long")
    dealt = rows.join(plan, "dim").select("dim", F.pmod(F.xxhash64("vec_id"), "shards").alias("shard"), "vec_id", "v")
    # a number of partitions of its own keeps small shards from being put into one task
    parts = max(1, 4 * sum(-(-n // shard) for d, n in counts.items() if d in asks))
    index = written(dealt.repartition(parts, "dim", "shard").groupBy("dim", "shard").applyInArrow(_building(k + 1), "dim int, shard long, index binary"), "graphs")
    series = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    copies = index.join(plan, "dim").select("dim", "shard", "index", series("blocks").alias("block"))
    sent = asked.join(plan, "dim").select("dim", F.pmod(F.xxhash64("vec_id", F.lit(1)), "blocks").alias("block"), "vec_id", "v", series("shards").alias("shard"))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if left.num_rows and right.num_rows:
            graph = pickle.loads(left.column("index")[0].as_py())
            ids, vecs = right.column("vec_id").to_numpy(), _matrix(right)
            for lo in range(0, len(ids), STEP):
                out += graph.search(ids[lo : lo + STEP], vecs[lo : lo + STEP], k, beam)
        q, i, s = (np.concatenate(x) for x in zip(*out))
        return pa.table({"query_id": q.astype(np.int64), "vec_id": i.astype(np.int64), "score": s})

    found = copies.groupBy("dim", "shard", "block").cogroup(sent.groupBy("dim", "shard", "block")).applyInArrow(run, "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op4_neighbours(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(rows, rows.where("vec_id % 20 = 0"))
