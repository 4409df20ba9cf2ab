"""Approximate nearest neighbours by cosine: one robust-pruned directed graph per shard, searched by beams.

Equal vectors are one point that carries the smallest ids which can ever be among the ``k`` nearest.
Points are dealt to shards of about ``SHARD`` by a hash. A shard's task builds its graph: for each point,
a greedy search of the graph so far proposes neighbours, and pruning keeps those that no kept neighbour
is nearer to by the factor ``ALPHA``; back edges are pruned alike. Every block of queries meets every
shard once (a stated query set against all rows, in blocks), as a beam search whose steps run for all
queries of the block together. The beam's points get their exact cosine in double precision.

Vectors that are null, empty, zero, or hold null or non-finite components take no part; vectors of
another dimension are no candidates. Ties go to the smaller id. Rows without ``vec_id`` take no part;
repeated equal rows are one; rows that repeat an id with another vector are separate candidates.
Extra columns are not read. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framesafe.session import checkpoint

from .common import whole_groups

SHARD, BLOCK = 8192, 1024
DEGREE, ALPHA = 32, 1.2
BUILD_BEAM, SEARCH_BEAM, WIDTH = 48, 96, 4


def valid(df: DataFrame) -> DataFrame:
    """``vec_id, vector`` of the rows that take part."""
    rows = df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"))
    fine = ~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where("vec_id IS NOT NULL AND vector IS NOT NULL AND size(vector) > 0").where(fine & F.exists("vector", lambda x: x != 0))


def _beam(units: np.ndarray, graph: np.ndarray, start: int, queries: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``size`` nearest points found for each query and their squared distances; -1 where there are fewer."""
    q, n = len(queries), len(units)
    rows = np.arange(q)[:, None]
    seen = np.zeros((q, n + 1), bool)
    seen[:, n] = True  # the filler's place
    ids = np.full((q, size), n)
    far = np.full((q, size), np.inf, np.float32)
    done = np.ones((q, size), bool)
    ids[:, 0], far[:, 0], done[:, 0] = start, 2 - 2 * queries @ units[start], False
    seen[:, start] = True
    while True:
        open_ = np.where(done, np.inf, far)
        pick = np.argpartition(open_, min(WIDTH, size) - 1, axis=1)[:, :WIDTH]
        usable = np.isfinite(np.take_along_axis(open_, pick, 1))
        live = usable.any(1)
        if not live.any():
            break
        at = np.where(usable, np.take_along_axis(ids, pick, 1), n)
        np.put_along_axis(done, pick, True, 1)
        near = graph[at].reshape(q, -1)
        near[seen[rows, near]] = n
        # a point that two of the picks lead to counts once
        order = np.argsort(near, axis=1, kind="stable")
        ranked = np.take_along_axis(near, order, 1)
        ranked[:, 1:][ranked[:, 1:] == ranked[:, :-1]] = n
        near = ranked
        seen[rows, near] = True
        active = np.flatnonzero((near < n).any(1))
        if not len(active):
            continue
        new = near[active]
        dist = 2 - 2 * np.einsum("qd,qrd->qr", queries[active], units[np.minimum(new, n - 1)])
        dist[new == n] = np.inf
        both = np.concatenate([far[active], dist], 1)
        best = np.argpartition(both, size - 1, axis=1)[:, :size]
        far[active] = np.take_along_axis(both, best, 1)
        ids[active] = np.take_along_axis(np.concatenate([ids[active], new], 1), best, 1)
        done[active] = np.take_along_axis(np.concatenate([done[active], np.zeros(new.shape, bool)], 1), best, 1)
    order = np.argsort(far, axis=1, kind="stable")
    ids, far = np.take_along_axis(ids, order, 1), np.take_along_axis(far, order, 1)
    return np.where(np.isfinite(far), ids, -1), far


def _prune(units: np.ndarray, points: np.ndarray, pool: np.ndarray) -> np.ndarray:
    """Up to ``DEGREE`` diverse neighbours from each point's pool (``len(units)`` is a filler)."""
    n = len(units)
    pool = np.sort(np.where(pool == points[:, None], n, pool), 1)
    pool[:, 1:][pool[:, 1:] == pool[:, :-1]] = n
    vectors = units[np.minimum(pool, n - 1)]
    own = 2 - 2 * np.einsum("pd,pcd->pc", units[points], vectors)
    own[pool == n] = np.inf
    between = (2 - 2 * np.einsum("pcd,ped->pce", vectors, vectors)) * np.float32(ALPHA**2)
    kept = np.full((len(points), DEGREE), n)
    rows = np.arange(len(points))
    for k in range(DEGREE):
        pick = own.argmin(1)
        there = np.isfinite(own[rows, pick])
        if not there.any():
            break
        kept[there, k] = pool[rows, pick][there]
        own[between[rows, pick] <= own] = np.inf
        own[rows, pick] = np.inf
    return kept


def build_graph(units: np.ndarray, seed: int = 0) -> tuple[np.ndarray, int]:
    """Neighbour lists of unit vectors (``len(units)`` fills short ones; the last row is the filler's) and the start."""
    n = len(units)
    rng = np.random.default_rng(seed)
    graph = np.full((n + 1, DEGREE), n)
    few = min(DEGREE // 2, n - 1)
    if few:
        graph[:n, :few] = (np.arange(n)[:, None] + rng.integers(1, n, (n, few))) % n
    start = int(np.argmax(units @ units.mean(0)))
    for group in np.array_split(rng.permutation(n), max(1, n // 256)):
        found, _ = _beam(units, graph, start, units[group], BUILD_BEAM)
        graph[group] = _prune(units, group, np.concatenate([np.where(found < 0, n, found), graph[group]], 1))
        source, target = np.repeat(group, DEGREE), graph[group].ravel()
        real = target < n
        source, target = source[real], target[real]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        ends, first, counts = np.unique(target, return_index=True, return_counts=True)
        new = np.full((len(ends), counts.max()), n) if len(ends) else np.zeros((0, 1), int)
        new[np.repeat(np.arange(len(ends)), counts), np.arange(len(target)) - np.repeat(first, counts)] = source
        for at in range(0, len(ends), 512):
            graph[ends[at : at + 512]] = _prune(units, ends[at : at + 512], np.concatenate([graph[ends[at : at + 512]], new[at : at + 512]], 1))
    return graph, start


def _fit_to_square(vectors: np.ndarray) -> np.ndarray:
    """The vectors, those that would overflow or vanish when squared scaled to a largest component of 1."""
    top = np.abs(vectors).max(1, keepdims=True)
    return np.where((top > 1e100) | (top < 1e-100), vectors / top, vectors)


def _units(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(1, keepdims=True)  # no overflow or underflow in the norm
    return (scaled / np.linalg.norm(scaled, axis=1, keepdims=True)).astype(np.float32)


def _matrix(column, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, dim)


def _packed(df: DataFrame, group: str, ids: str) -> DataFrame:
    """One row ``group, dim, ids, vectors`` (packed) for each group and dimension."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, number in whole_groups(batches, ["dim", group]):
            cuts = np.flatnonzero(np.r_[True, number[1:] != number[:-1], True])
            for a, b in zip(cuts, cuts[1:]):
                part = t.slice(a, b - a).combine_chunks()
                lists = part.column("ids").to_pylist()
                width = max(map(len, lists))
                table = np.full((len(lists), width), np.iinfo(np.int64).max)
                for k, x in enumerate(lists):
                    table[k, : len(x)] = sorted(x)
                vectors = part.column("vector").combine_chunks().flatten().to_numpy()
                yield pa.RecordBatch.from_arrays(
                    [part.column(group).combine_chunks()[:1], part.column("dim").combine_chunks()[:1], pa.array([width], pa.int32()),
                     pa.array([table.tobytes()], pa.binary()), pa.array([vectors.astype(np.float64).tobytes()], pa.binary())],
                    [group, "dim", "width", "ids", "vectors"],
                )

    rows = df.select(F.col(group).cast("int").alias(group), F.size("vector").alias("dim"), F.col(ids).alias("ids"), "vector", F.array_min(ids).alias("at"))
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows.repartition(n, "dim", group).sortWithinPartitions("dim", group, "at").drop("at")
    return dealt.mapInArrow(work, f"{group} int, dim int, width int, ids binary, vectors binary")


def _with_graph(packed: DataFrame) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                one = batch.slice(k, 1)
                dim = one.column("dim")[0].as_py()
                graph, start = build_graph(_units(_matrix(one.column("vectors"), dim)), one.column("shard")[0].as_py())
                extra = [pa.array([graph.astype(np.int32).tobytes()], pa.binary()), pa.array([start], pa.int32())]
                yield pa.RecordBatch.from_arrays([*one.columns, *extra], [*one.schema.names, "graph", "start"])

    return packed.mapInArrow(work, "shard int, dim int, width int, ids binary, vectors binary, graph binary, start int")


def _search(pairs: DataFrame, k: int) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                one = {name: batch.column(name)[r].as_py() for name in batch.schema.names}
                dim = one["dim"]
                vectors = np.frombuffer(one["vectors"], np.float64).reshape(-1, dim)
                queries = np.frombuffer(one["q_vectors"], np.float64).reshape(-1, dim)
                ids = np.frombuffer(one["ids"], np.int64).reshape(len(vectors), -1)
                query_ids = np.frombuffer(one["q_ids"], np.int64)
                graph = np.frombuffer(one["graph"], np.int32).reshape(len(vectors) + 1, DEGREE).astype(np.int64)
                found, _ = _beam(_units(vectors), graph, one["start"], _units(queries), SEARCH_BEAM)
                scaled, q_scaled = _fit_to_square(vectors), _fit_to_square(queries)
                norms, q_norms = np.linalg.norm(scaled, axis=1), np.linalg.norm(q_scaled, axis=1)
                out: list[tuple] = []
                for q, points in enumerate(found):
                    points = points[points >= 0]
                    score = scaled[points] @ q_scaled[q] / (norms[points] * q_norms[q])
                    each = [(-s, i) for s, p in zip(score.tolist(), points) for i in ids[p].tolist() if i != query_ids[q] and i < np.iinfo(np.int64).max]
                    out += [(int(query_ids[q]), i, -s) for s, i in sorted(each)[:k]]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.float64()))], ["query_id", "vec_id", "score"])

    return pairs.mapInArrow(work, "query_id long, vec_id long, score double")


def nearest(embeddings: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest other rows found for each row that ``is_query`` selects."""
    rows = checkpoint(valid(embeddings).distinct())
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("vector").orderBy("vec_id"))).where(F.col("rank") <= k + 1)
    points = checkpoint(ranked.groupBy("vector").agg(F.collect_list("vec_id").alias("ids")))
    shards = max(1, -(-points.count() // SHARD))
    placed = points.withColumn("shard", F.pmod(F.xxhash64("vector"), F.lit(shards)))
    index = checkpoint(_with_graph(_packed(placed, "shard", "ids")))

    asked = rows.where(is_query)
    blocks = max(1, -(-asked.count() // BLOCK))
    asked = asked.select(F.array("vec_id").alias("ids"), "vector", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).alias("block"))
    packed = checkpoint(_packed(asked, "block", "ids")).select("dim", F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"))
    pairs = packed.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).join(index, ["shard", "dim"])
    n = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    found = _search(pairs.select("dim", "ids", "vectors", "graph", "start", "q_ids", "q_vectors").repartition(n), k)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", "score")
