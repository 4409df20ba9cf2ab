"""Embeddings: similarity joins, vector search, clustering into people, summaries."""

from __future__ import annotations

import functools
import tempfile
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import seq_id
from ..session import checkpoint, fits_in_broadcast, spread

# Similarity limits of face clustering.
ASSIGN_SIM = 0.42
CENTROID_SIM = 0.40
LINK_SIM = 0.38
MAX_PASSES = 10
MEMBER_LIMIT = 60
LINK_SAMPLE = 30


# -- similarity ------------------------------------------------------------------------------


def dot(a: Column, b: Column) -> Column:
    """Dot product inside the JVM; right for short vectors."""
    prod = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(prod, F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """The vector scaled to length one; a zero vector stays as it is."""
    n = F.sqrt(dot(v, v))
    return F.when(n > 0, F.transform(v, lambda x: x.cast("double") / n)).otherwise(
        F.transform(v, lambda x: x.cast("double"))
    )


def _rows(arr: pa.Array) -> np.ndarray:
    """A list column without nulls as a matrix."""
    flat = arr.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(arr), -1) if len(arr) else flat.reshape(0, 0)


def _cosine_arrow(a: pa.Array, b: pa.Array) -> pa.Array:
    import pyarrow.compute as pc

    if isinstance(a, pa.ChunkedArray):
        a, b = a.combine_chunks(), b.combine_chunks()
    ok = pc.and_(pc.is_valid(a), pc.is_valid(b))
    mask = ok.to_numpy(zero_copy_only=False)
    out = np.full(len(mask), np.nan)
    if mask.any():
        x, y = _rows(a.filter(ok)), _rows(b.filter(ok))
        nx, ny = np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)
        scale = np.where(nx > 0, nx, 1.0) * np.where(ny > 0, ny, 1.0)
        out[mask] = np.einsum("ij,ij->i", x, y) / scale
    return pa.array(out, mask=~mask)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two vector columns, one Arrow batch at a time; null when either is null."""
    return F.arrow_udf(_cosine_arrow, "double")(a, b)


# -- identification --------------------------------------------------------------------------


def identify(dets: DataFrame, known: DataFrame, on: Sequence[str], frame: Sequence[str], tol: float = 0.55,
             seq: str = "seq", person: str = "person_id", digits: int = 4) -> DataFrame:
    """Name detections: most similar known person of the job if close enough, then per frame and person
    the best detection by (similarity, detector score).

    ``dets``: ``on`` + ``frame`` keys, ``seq``, ``det_score``, ``encoding``; ``known``: ``on``, person, ``encoding``.
    Among equal similarities the smaller person id and the smaller ``seq`` win.
    """
    on, frame = list(on), list(frame)
    k = known.select(*on, person, F.col("encoding").alias("__k")).where(F.col("__k").isNotNull())
    pairs = dets.where(F.col("encoding").isNotNull()).select(*on, *frame, seq, "det_score", "encoding").join(k, on)
    sim = pairs.withColumn("match_score", F.bround(cosine(F.col("encoding"), F.col("__k")), digits))
    best = sim.groupBy(*on, *frame, seq).agg(
        F.min(F.struct((-F.col("match_score")).alias("ns"), F.col(person), "det_score")).alias("m")
    )
    best = best.select(*on, *frame, seq, F.col(f"m.{person}").alias(person), (-F.col("m.ns")).alias("match_score"),
                       F.bround("m.det_score", 4).alias("det_score")).where(F.col("match_score") >= 1.0 - tol)
    top = best.groupBy(*on, *frame, person).agg(
        F.min(F.struct((-F.col("match_score")).alias("ns"), (-F.col("det_score")).alias("nd"), seq)).alias("m")
    )
    return top.select(*on, *frame, person, F.col(f"m.{seq}").alias(seq), (-F.col("m.ns")).alias("match_score"),
                      (-F.col("m.nd")).alias("det_score"))


def match_any(dets: DataFrame, targets: DataFrame, on: Sequence[str], key: Sequence[str], tol: float = 0.55,
              digits: int = 4) -> DataFrame:
    """Detections close to any target vector of their job."""
    on, key = list(on), list(key)
    t = targets.select(*on, F.col("encoding").alias("__k")).where(F.col("__k").isNotNull())
    pairs = dets.where(F.col("encoding").isNotNull()).select(*on, *key, "encoding").join(t, on)
    sim = pairs.select(*on, *key, F.bround(cosine(F.col("encoding"), F.col("__k")), digits).alias("s"))
    hit = sim.groupBy(*on, *key).agg(F.max("s").alias("s")).where(F.col("s") >= 1.0 - tol)
    return dets.join(hit.select(*on, *key), [*on, *key], "left_semi")


# -- vector search ---------------------------------------------------------------------------

QUERY_BLOCK = 4_096  # queries shipped to every task
QUERY_HELD, ITEM_BLOCK = 32_768, 65_536  # vectors of a pair of blocks that one task holds
SALTED_FROM = 64  # blocks
SCORES = 1 << 21  # scores held at a time


def _local_top(q_ids: np.ndarray, q: np.ndarray, i_ids: np.ndarray, x: np.ndarray, k: int, skip_self: bool,
               digits: int | None) -> pd.DataFrame:
    """Top k items of one block for every query, ordered by (score desc, id)."""
    by_id = np.argsort(i_ids, kind="stable")
    ids, x = i_ids[by_id], x[by_id]
    parts = []
    step = max(1, SCORES // max(1, len(ids)))
    for at in range(0, len(q_ids), step):
        mine = q_ids[at : at + step]
        s = q[at : at + step] @ x.T
        if skip_self:
            lo, hi = np.searchsorted(ids, mine), np.searchsorted(ids, mine, "right")
            for row in np.flatnonzero((lo < hi) & (mine == mine)):
                s[row, lo[row] : hi[row]] = -np.inf
        row, item, score = _best(s, k, digits)
        parts.append(pd.DataFrame({"query_id": mine[row], "item_id": ids[item], "score": score}))
    out = pd.concat(parts) if parts else pd.DataFrame({"query_id": q_ids[:0], "item_id": i_ids[:0], "score": np.zeros(0)})
    return out[np.isfinite(out["score"])]


def _best(s: np.ndarray, k: int, digits: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, column and rounded score of the ``k`` best of every row, the smaller column first among equals.

    Only scores that can round to the k-th best are rounded and sorted.
    """
    rows, n = s.shape
    width = max(1, min(64, n // (4 * k + 1)))
    tops = np.maximum.reduceat(s, np.arange(0, n, width), axis=1) if n else s  # the k-th best of them is no more than that of all
    if np.isnan(tops).any():
        s = np.where(np.isnan(s), -np.inf, s)
        tops = np.maximum.reduceat(s, np.arange(0, n, width), axis=1)
    near = 0.0 if digits is None else 10.0**-digits
    groups = tops.shape[1]
    floor = np.partition(tops, groups - k, axis=1)[:, groups - k] - near if 0 < k < groups else np.full(rows, -np.inf)
    row, column = np.nonzero(s >= floor[:, None])
    score = s[row, column] if digits is None else np.round(s[row, column], digits)
    order = np.lexsort((column, -score, row))
    row, column, score = row[order], column[order], score[order]
    first = np.searchsorted(row, row)
    keep = np.arange(len(row)) - first < k
    return row[keep], column[keep], score[keep]


def _matrix(col: pd.Series) -> np.ndarray:
    return np.stack(col.to_numpy()).astype(np.float64) if len(col) else np.zeros((0, 0))


def vector_topk(queries: DataFrame, items: DataFrame, k: int, query_id: str = "query_id", item_id: str = "item_id",
                vec: str = "vec", skip_self: bool = False, digits: int | None = None,
                query_block: int = QUERY_BLOCK) -> DataFrame:
    """The k most similar items of every query, ``(query_id, item_id, score, rank)``. Exact.

    Vectors are unit length; ids are integers. Up to ``query_block`` queries are shipped to every task,
    which keeps only its k best rows, so items are never shuffled. More queries go through blocks of
    queries against blocks of items.
    """
    q = queries.select(F.col(query_id).cast("long").alias("query_id"), F.col(vec).alias("qv"))
    i = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(vec).alias("iv"))
    schema = "query_id long, item_id long, score double"
    spans = None  # blocks of items that a query meets, where they are counted
    if fits_in_broadcast(q, query_block):
        local = q.toPandas()
        q_ids, qm = local["query_id"].to_numpy(), _matrix(local["qv"])
        shared = q.sparkSession.sparkContext.broadcast((q_ids, qm))

        def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ids, m = shared.value
            best = None
            for b in batches:
                if not len(b) or not len(ids):
                    continue
                top = _local_top(ids, m, b["item_id"].to_numpy(), _matrix(b["iv"]), k, skip_self, digits)
                best = top if best is None else _keep_top(pd.concat([best, top]), k)
            if best is not None:
                yield best

        partial = i.mapInPandas(scan, schema)
    else:
        qb, ib, spans = _crossed(q, i, query_block)

        def block(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            if not len(a) or not len(b):
                return pd.DataFrame({"query_id": [], "item_id": [], "score": []})
            return _local_top(a["query_id"].to_numpy(), _matrix(a["qv"]), b["item_id"].to_numpy(), _matrix(b["iv"]), k,
                              skip_self, digits)

        partial = qb.groupBy("jq", "ji").cogroup(ib.groupBy("jq", "ji")).applyInPandas(block, schema)
    # partial results: where they are many, a salted round first, so that one query with many blocks is not one task
    order = [F.col("score").desc(), F.col("item_id")]
    w2 = Window.partitionBy("query_id").orderBy(*order)
    if spans is None or spans > SALTED_FROM:
        w1 = Window.partitionBy("query_id", "__salt").orderBy(*order)
        salted = partial.withColumn("__salt", F.pmod(F.xxhash64("item_id"), F.lit(32)))
        partial = salted.withColumn("rank", F.row_number().over(w1)).where(F.col("rank") <= k).drop("__salt", "rank")
    return partial.withColumn("rank", F.row_number().over(w2)).where(F.col("rank") <= k)


def _crossed(q: DataFrame, i: DataFrame, query_block: int) -> tuple[DataFrame, DataFrame, int]:
    """Queries and items with ``jq, ji``, their pairs of blocks, and the number of item blocks.

    A vector is sent once to every block of the other side, so the blocks of a large table are as large as a task can hold.
    """
    n = q.count()
    nq = n // max(query_block, min(QUERY_HELD, n // 16)) + 1
    ni = i.count() // ITEM_BLOCK + 1
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    qb = q.withColumn("jq", F.pmod(F.xxhash64("query_id"), F.lit(nq))).withColumn("ji", every(ni))
    ib = i.withColumn("ji", F.pmod(F.xxhash64("item_id"), F.lit(ni))).withColumn("jq", every(nq))
    return qb, ib, ni


def vector_topk_grouped(queries: DataFrame, items: DataFrame, group: str, k_groups: int, k_items: int, query_id: str = "query_id",
                        item_id: str = "item_id", vec: str = "vec", digits: int | None = None, query_block: int = QUERY_BLOCK) -> DataFrame:
    """The best ``k_groups`` groups of every query by their best item, and the best ``k_items`` items of each. Exact.

    ``(query_id, group_rank, <group>, rank, item_id, score)``; ties go to the smaller group and item. Vectors are unit
    length; ids and groups are integers; items without a group or vector take no part.

    Two levels: a task keeps ``k_groups`` groups per query, which is enough, as a group that is among the best has its
    best item in some task and is among that task's best. Then tasks keep ``k_items`` items of each chosen group. Up to
    ``query_block`` queries are shipped to the tasks, and items never move; more go through blocks of queries against
    blocks of items. A task holds one block of either, however many there are.
    """
    q = queries.select(F.col(query_id).cast("long").alias("query_id"), F.col(vec).alias("qv")).where("query_id IS NOT NULL AND qv IS NOT NULL")
    i = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(group).cast("long").alias("grp"), F.col(vec).alias("iv"))
    i = i.where("item_id IS NOT NULL AND grp IS NOT NULL AND iv IS NOT NULL")
    out = (_grouped_shipped if fits_in_broadcast(q, query_block) else functools.partial(_grouped_crossed, query_block=query_block))(q, i, k_groups, k_items, digits)
    return out.withColumnRenamed("grp", group)


def _slices(rows: int, columns: int) -> Iterator[slice]:
    step = max(1, SCORES // max(1, columns))
    return (slice(at, at + step) for at in range(0, rows, step))


def _best_groups(ids: np.ndarray, m: np.ndarray, b: pd.DataFrame, k_groups: int, digits: int | None) -> pd.DataFrame:
    """The best groups of every query among the items of ``b``."""
    x, grp = _matrix(b["iv"]), b["grp"].to_numpy()
    order = np.argsort(grp, kind="stable")
    x, (groups, starts) = x[order], np.unique(grp[order], return_index=True)
    parts = []
    for some in _slices(len(ids), len(x)):
        row, column, score = _best(np.maximum.reduceat(m[some] @ x.T, starts, axis=1), k_groups, digits)
        parts.append(pd.DataFrame({"query_id": ids[some][row], "grp": groups[column], "score": score}))
    return pd.concat(parts)


def _best_items(ids: np.ndarray, m: np.ndarray, wanted: dict[int, np.ndarray], b: pd.DataFrame, k_items: int, digits: int | None) -> pd.DataFrame:
    """The best items of ``b`` for every query and each group that ``wanted`` names for some of their rows."""
    b = b[b["grp"].isin(list(wanted))].sort_values(["grp", "item_id"])
    x, items = _matrix(b["iv"]), b["item_id"].to_numpy()
    groups, starts = np.unique(b["grp"].to_numpy(), return_index=True)
    parts = [pd.DataFrame({"query_id": ids[:0], "grp": groups[:0], "item_id": items[:0], "score": np.zeros(0)})]
    for g, lo, hi in zip(groups.tolist(), starts.tolist(), [*starts[1:].tolist(), len(b)]):
        rows = wanted[g]
        for some in _slices(len(rows), hi - lo):
            row, column, score = _best(m[rows[some]] @ x[lo:hi].T, k_items, digits)
            parts.append(pd.DataFrame({"query_id": ids[rows[some]][row], "grp": g, "item_id": items[lo + column], "score": score}))
    return pd.concat(parts)


GROUPS, ITEMS = "query_id long, grp long, score double", "query_id long, grp long, item_id long, score double"


def _ranked_groups(found: DataFrame, k_groups: int) -> DataFrame:
    by_score = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "grp")
    found = found.groupBy("query_id", "grp").agg(F.max("score").alias("score"))
    return checkpoint(found.withColumn("group_rank", F.row_number().over(by_score)).where(F.col("group_rank") <= k_groups).select("query_id", "grp", "group_rank"))


def _ranked_items(hits: DataFrame, chosen: DataFrame, k_items: int) -> DataFrame:
    within = Window.partitionBy("query_id", "grp").orderBy(F.col("score").desc(), "item_id")
    hits = hits.withColumn("rank", F.row_number().over(within)).where(F.col("rank") <= k_items)
    return hits.join(chosen, ["query_id", "grp"]).select("query_id", "group_rank", "grp", "rank", "item_id", "score")


def _grouped_crossed(q: DataFrame, i: DataFrame, k_groups: int, k_items: int, digits: int | None, query_block: int) -> DataFrame:
    """By pairs of blocks, which are dealt over the tasks."""
    qb, ib, _ = _crossed(q, i, query_block)

    def groups(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"query_id": [], "grp": [], "score": []})
        return _best_groups(a["query_id"].to_numpy(), _matrix(a["qv"]), b, k_groups, digits)

    def items(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"query_id": [], "grp": [], "item_id": [], "score": []})
        picked = a["groups"].explode().reset_index(drop=True)
        row = np.repeat(np.arange(len(a)), a["groups"].map(len))
        wanted = {g: row[at] for g, at in picked.groupby(picked.astype("int64")).indices.items()}
        return _best_items(a["query_id"].to_numpy(), _matrix(a["qv"]), wanted, b, k_items, digits)

    by = ("jq", "ji")
    chosen = _ranked_groups(qb.groupBy(*by).cogroup(ib.groupBy(*by)).applyInPandas(groups, GROUPS), k_groups)
    listed = qb.join(chosen.groupBy("query_id").agg(F.collect_list("grp").alias("groups")), "query_id")
    return _ranked_items(listed.groupBy(*by).cogroup(ib.groupBy(*by)).applyInPandas(items, ITEMS), chosen, k_items)


def _grouped_shipped(q: DataFrame, i: DataFrame, k_groups: int, k_items: int, digits: int | None) -> DataFrame:
    """Few queries are shipped to every task."""
    spark = q.sparkSession
    local = q.toPandas()
    shared = spark.sparkContext.broadcast((local["query_id"].to_numpy(), _matrix(local["qv"])))

    def groups(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        (ids, m), best = shared.value, None
        for b in batches:
            if len(b) and len(ids):
                new = _best_groups(ids, m, b, k_groups, digits)
                best = new if best is None else pd.concat([best, new]).groupby(["query_id", "grp"], as_index=False)["score"].max()
                best = best.sort_values(["query_id", "score", "grp"], ascending=[True, False, True]).groupby("query_id", sort=False).head(k_groups)
        if best is not None:
            yield best

    chosen = _ranked_groups(i.mapInPandas(groups, GROUPS), k_groups)
    at: dict[int, list[int]] = {}
    for n, x in enumerate(local["query_id"].tolist()):
        at.setdefault(x, []).append(n)
    wanted: dict[int, list[int]] = {}
    for r in chosen.collect():  # k_groups for each query
        wanted.setdefault(r["grp"], []).extend(at[r["query_id"]])
    of_group = spark.sparkContext.broadcast({g: np.array(rows) for g, rows in wanted.items()})

    def best_items(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        (ids, m), best = shared.value, None
        for b in batches:
            if len(b) and len(ids):
                best = pd.concat([best, _best_items(ids, m, of_group.value, b, k_items, digits)])
                best = best.sort_values(["query_id", "grp", "score", "item_id"], ascending=[True, True, False, True]).groupby(["query_id", "grp"], sort=False).head(k_items)
        if best is not None:
            yield best

    return _ranked_items(i.mapInPandas(best_items, ITEMS), chosen, k_items)


def _keep_top(df: pd.DataFrame, k: int) -> pd.DataFrame:
    df = df.sort_values(["query_id", "score", "item_id"], ascending=[True, False, True], kind="stable")
    return df.groupby("query_id", sort=False).head(k)


# -- centroids and summaries -----------------------------------------------------------------


def centroids(df: DataFrame, keys: Sequence[str], vec: str = "encoding", normalise: bool = True) -> DataFrame:
    """Mean vector per key. Tasks add up vectors first; sums are shuffled, and added up in order of their keys."""
    keys = list(keys)
    src = df.where(F.col(vec).isNotNull() & (F.size(vec) > 0)).select(*keys, F.col(vec).alias("__v"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema if f.name != "__v") + ", n long, s array<double>"

    def added(b: pd.DataFrame, counts: np.ndarray, vectors: pd.Series) -> pd.DataFrame:
        codes, firsts = _codes(b, keys)
        order = np.argsort(codes, kind="stable")
        sums = np.add.reduceat(_matrix(vectors)[order], np.searchsorted(codes[order], np.arange(len(firsts))), axis=0)
        return b.iloc[firsts][keys].assign(n=np.bincount(codes, counts, len(firsts)).astype(np.int64), s=list(sums))

    def add_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield added(b, np.ones(len(b)), b["__v"])

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = None  # the last key, which may go on
        for b in batches:
            if len(b):
                b = b if last is None else pd.concat([last, b], ignore_index=True)
                b = added(b, b["n"], b["s"])
                last = b.iloc[-1:]
                yield b.iloc[:-1]
        if last is not None:
            yield last

    part = src.mapInPandas(add_up, schema)
    met = spread(part, *keys).sortWithinPartitions(*keys).mapInPandas(meet, schema)
    out = met.select(*keys, F.transform("s", lambda x: x / F.col("n")).alias("centroid"), F.col("n").alias("members"))
    return out.withColumn("centroid", unit(F.col("centroid"))) if normalise else out


def _codes(b: pd.DataFrame, keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
    codes = b.groupby(keys, sort=False, dropna=False).ngroup().to_numpy()
    _, firsts = np.unique(codes, return_index=True)
    return codes, firsts


def summarise_people(assigned: DataFrame, job: str = "job_id", cluster: str = "cluster", seq: str = "seq") -> DataFrame:
    """One row per person: best snapshot by detector score + .01·sharpness, appearance count, ids.

    Ids follow the cluster number; ``order_pos`` is the display order (most appearances first).
    """
    score = F.coalesce("det_score", F.lit(0.0)) + F.coalesce("sharpness", F.lit(0.0)) * 0.01
    best = F.max(F.struct(score.alias("score"), (-F.col(seq)).alias("first"), "x1", "y1", "x2", "y2"))
    g = assigned.groupBy(job, cluster).agg(best.alias("b"), F.count(F.lit(1)).alias("appearance_count"))
    pid = seq_id("person_", F.col(cluster))
    w = Window.partitionBy(job).orderBy(F.col("appearance_count").desc(), cluster)
    return g.select(
        job, cluster, pid.alias("person_id"), "appearance_count", F.col("b.score").alias("best_score"),
        (-F.col("b.first")).alias("best_seq"), *(F.col(f"b.{n}").alias(n) for n in ("x1", "y1", "x2", "y2")),
        F.row_number().over(w).alias("order_pos"),
    )


def cluster_objects(dets: DataFrame, job: str = "job_id", seq: str = "seq", name: str = "identification") -> DataFrame:
    """Objects by class: count, largest example (earliest on ties), ids in first-seen order."""
    best = F.max(F.struct("crop_area", (-F.col(seq)).alias("first"), "x1", "y1", "x2", "y2"))
    g = dets.groupBy(job, F.coalesce(name, F.lit("unknown")).alias(name)).agg(
        F.count(F.lit(1)).alias("appearance_count"), F.min(seq).alias("first_seq"), best.alias("b")
    )
    w = Window.partitionBy(job).orderBy("first_seq")
    return g.select(
        job, name, "appearance_count", "first_seq", (-F.col("b.first")).alias("best_seq"),
        *(F.col(f"b.{n}").alias(n) for n in ("x1", "y1", "x2", "y2")),
        seq_id("object_", F.row_number().over(w) - 1).alias("object_id"),
    )


def pick_reference_face(images: DataFrame, dets: DataFrame, key: Sequence[str], seq: str = "seq") -> tuple[DataFrame, DataFrame]:
    """Best face per reference image by (detector score, sharpness), and images without one with the reason."""
    key = list(key)
    best = dets.where(F.col("encoding").isNotNull()).groupBy(*key).agg(
        F.max(F.struct("det_score", "sharpness", (-F.col(seq)).alias("first"))).alias("m")
    )
    chosen = best.select(*key, (-F.col("m.first")).alias(seq)).join(dets, [*key, seq])
    seen = dets.select(*key).distinct().withColumn("__any", F.lit(True))
    failed = images.join(best.select(*key), key, "left_anti").join(seen, key, "left")
    reason = F.when(F.col("__any"), "no encoding for the detected face").otherwise("no face detected")
    return chosen, failed.withColumn("reason", reason).drop("__any")


# -- clustering ------------------------------------------------------------------------------


def _units(m: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(m, axis=-1, keepdims=True)
    return m / np.where(n > 0, n, 1.0)


class _Vectors:
    """Rows of one width in order of arrival, the first ``held`` bytes of them in memory, the rest in a scratch file of the task."""

    def __init__(self, held: int):
        self.held, self.size, self.blocks, self.file, self.n = held, 0, [], None, 0
        self.mapped: np.ndarray | None = None

    def append(self, x: np.ndarray) -> None:
        self.n += len(x)
        self.size += x.nbytes
        self.blocks.append(x)
        if self.size > self.held:
            self.file = self.file or tempfile.TemporaryFile()
            for block in self.blocks:
                self.file.write(np.ascontiguousarray(block).data)
            self.blocks, self.size, self.width = [], 0, x.shape[1]

    def rows(self) -> np.ndarray:
        """All rows, mapped from the file where there is one; nothing may be appended afterwards."""
        if self.mapped is None:
            if self.file is None:
                self.mapped = np.concatenate(self.blocks)
            else:
                for block in self.blocks:
                    self.file.write(np.ascontiguousarray(block).data)
                self.file.flush()
                self.mapped = np.memmap(self.file, np.float64, "r", shape=(self.n, self.width))
            self.blocks = []
        return self.mapped


class JobClusters:
    """The detections of one job, in order, clustered by one rule whatever their number.

    A detection joins the most similar cluster above the limit or opens one; similar to the centroid, and to each
    member while there are at most ``MEMBER_LIMIT``. Then clusters are merged by centroid, by the best of evenly
    spaced members, and by their best member. Similarities come from one matrix product per block of detections;
    within a block, sums and best members move on by the block's own Gram matrix. Held are a sum per cluster, the
    members of small clusters, and some twenty bytes a detection; vectors wait in a scratch file for the merges.
    """

    def __init__(self, limit: float = ASSIGN_SIM, block: int = 256, held: int = 32 << 20):
        self.limit, self.block = limit, block
        self.vectors = _Vectors(held)
        self.quality: list[np.ndarray] = []
        self.owner: list[np.ndarray] = []
        self.sums: np.ndarray | None = None
        self.counts = np.zeros(0, np.int64)

    def add(self, x: np.ndarray, quality: np.ndarray) -> None:
        x = _units(x.astype(np.float64))
        if self.sums is None:
            self.sums, self.near, self.near_of = np.zeros((0, x.shape[1])), np.zeros((0, x.shape[1])), np.zeros(0, np.int64)
        self.vectors.append(x)
        self.quality.append(np.asarray(quality, float))
        for at in range(0, len(x), self.block):
            self._assign(x[at : at + self.block])

    def _assign(self, x: np.ndarray) -> None:
        had, n = len(self.counts), len(x)
        gram = x @ x.T
        along = np.zeros((had + n, n))  # sums by the block's rows
        direct = np.full((had + n, n), -np.inf)  # best members by them
        along[:had] = self.sums @ x.T
        if len(self.near_of):  # members lie in order of their clusters
            starts = np.flatnonzero(np.r_[True, self.near_of[1:] != self.near_of[:-1]])
            direct[self.near_of[starts]] = np.maximum.reduceat(self.near @ x.T, starts)
        counts = np.concatenate([self.counts, np.zeros(n, np.int64)])
        square = np.concatenate([(self.sums**2).sum(1), np.zeros(n)])
        c, owner = had, np.empty(n, np.int64)
        for i in range(n):
            length = np.sqrt(np.maximum(square[:c], 0.0))
            sims = along[:c, i] / np.where(length > 0, length, 1.0)
            sims = np.where(counts[:c] <= MEMBER_LIMIT, np.maximum(sims, direct[:c, i]), sims)
            best = int(sims.argmax()) if c else -1
            if best < 0 or sims[best] <= self.limit:
                best, c = c, c + 1
            square[best] += 2 * along[best, i] + gram[i, i]
            along[best] += gram[i]
            np.maximum(direct[best], gram[i], out=direct[best])
            counts[best] += 1
            owner[i] = best
        self.counts = counts[:c]
        self.sums = np.vstack([self.sums, np.zeros((c - had, x.shape[1]))])
        np.add.at(self.sums, owner, x)
        of = np.concatenate([self.near_of, owner])
        order = np.argsort(of, kind="stable")
        order = order[self.counts[of[order]] <= MEMBER_LIMIT]
        self.near, self.near_of = np.vstack([self.near, x])[order], of[order]
        self.owner.append(owner.astype(np.int32))

    def labels(self) -> np.ndarray:
        """The cluster of every detection, numbered by first appearance."""
        if self.sums is None:
            return np.zeros(0, np.int64)
        owner, quality, x = np.concatenate(self.owner), np.concatenate(self.quality), self.vectors.rows()
        order = np.argsort(owner, kind="stable")
        members = np.split(order, np.flatnonzero(np.diff(owner[order])) + 1)
        sums = self.sums.copy()
        best = [int(m[int(np.argmax(quality[m]))]) for m in members]

        def absorb(i: int, j: int) -> None:
            members[i] = np.concatenate([members[i], members[j]])
            sums[i] += sums[j]
            if quality[best[j]] > quality[best[i]]:
                best[i] = best[j]

        alive = list(range(len(members)))
        for similar in (self._by_centroid(sums), self._by_members(members, x), self._by_best(best, x)):
            for _ in range(MAX_PASSES):
                gone: set[int] = set()
                for i in alive:
                    rest = [j for j in alive if j > i and j not in gone] if i not in gone else []
                    while rest:  # the next similar one by the cluster as it is by then
                        at = similar(i, rest)
                        if at is None:
                            break
                        absorb(i, rest[at])
                        gone.add(rest[at])
                        rest = rest[at + 1 :]
                if not gone:
                    break
                alive = [i for i in alive if i not in gone]
        out = np.empty(len(owner), np.int64)
        for n, i in enumerate(alive):
            out[members[i]] = n
        return out

    def _by_centroid(self, sums: np.ndarray):
        def first(i: int, rest: list[int]) -> int | None:
            above = np.flatnonzero(_units(sums[rest]) @ _units(sums[i]) > CENTROID_SIM)
            return int(above[0]) if len(above) else None

        return first

    def _by_members(self, members: list[np.ndarray], x: np.ndarray):
        held: dict[int, tuple[int, np.ndarray]] = {}

        def some(i: int) -> np.ndarray:
            m = members[i]
            if held.get(i, (0,))[0] != len(m):  # evenly spaced over the members in their order
                held[i] = len(m), np.asarray(x[m if len(m) <= LINK_SAMPLE else m[np.linspace(0, len(m) - 1, LINK_SAMPLE, dtype=int)]])
            return held[i][1]

        def first(i: int, rest: list[int]) -> int | None:
            mine = some(i)
            for k in range(0, len(rest), 64):
                pools = [some(j) for j in rest[k : k + 64]]
                starts = np.cumsum([0] + [len(p) for p in pools[:-1]])
                above = np.flatnonzero(np.maximum.reduceat((np.concatenate(pools) @ mine.T).max(1), starts) > LINK_SIM)
                if len(above):
                    return k + int(above[0])
            return None

        return first

    def _by_best(self, best: list[int], x: np.ndarray):
        def first(i: int, rest: list[int]) -> int | None:
            above = np.flatnonzero(x[[best[j] for j in rest]] @ x[best[i]] > self.limit)
            return int(above[0]) if len(above) else None

        return first


def cluster_faces(dets: DataFrame, job: str = "job_id", seq: str = "seq", threshold: float = ASSIGN_SIM, held: int = 32 << 20) -> DataFrame:
    """Give every detection with an encoding its cluster number within the job.

    The rule depends on the order of detections, so a job is one stream of rows, which Spark partitions and sorts;
    jobs are spread over tasks. One rule holds at every size (see ``JobClusters``): a job of any length takes a
    bounded number of vectors in memory.
    """
    quality = F.coalesce("det_score", F.lit(0.0)) + F.coalesce("sharpness", F.lit(0.0)) * 0.01
    slim = dets.where(F.col("encoding").isNotNull()).select(F.col(job).alias("job"), F.col(seq).alias("seq"), F.col("encoding").cast("array<double>").alias("v"), quality.alias("q"))
    src = spread(slim, "job").sortWithinPartitions("job", "seq")
    types = dict(slim.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, clusters, rows = None, None, []

        def done() -> Iterator[pa.RecordBatch]:
            labels, at = clusters.labels(), 0
            for part in rows:
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(labels[at : at + part.num_rows])], ["job", "seq", "cluster"])
                at += part.num_rows

        for batch in batches:
            jobs = batch.column("job").to_pylist()
            cuts = [0, *(i for i in range(1, len(jobs)) if jobs[i] != jobs[i - 1]), len(jobs)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if clusters is None or jobs[a] != key:
                    if clusters is not None:
                        yield from done()
                    key, clusters, rows = jobs[a], JobClusters(threshold, held=held), []
                part = batch.slice(a, b - a)
                clusters.add(_rows(part.column("v")), part.column("q").to_numpy())
                rows.append(part.select(["job", "seq"]))
        if clusters is not None:
            yield from done()

    return src.mapInArrow(run, f"job {types['job']}, seq {types['seq']}, cluster long").toDF(job, seq, "cluster")


# -- identities across jobs ------------------------------------------------------------------


def _linked_keys(left: np.ndarray, right: np.ndarray, linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A tree of keys for each component of a matrix of links: as many rows as members, however dense the links."""
    open_left, open_right = linked.any(1), linked.any(0)
    a, b = [left[:0]], [left[:0]]
    for first in np.flatnonzero(open_left):
        rows = np.array([first]) if open_left[first] else np.zeros(0, int)
        while len(rows):
            open_left[rows] = False
            columns = np.flatnonzero(linked[rows].any(0) & open_right)
            open_right[columns] = False
            b += [left[rows], right[columns]]
            a += [np.repeat(left[first : first + 1], len(rows) + len(columns))]
            rows = np.flatnonzero(linked[:, columns].any(1) & open_left)
    return np.concatenate(a), np.concatenate(b)


def resolve_identities(people: DataFrame, key: str = "person_key", vec: str = "centroid", threshold: float = LINK_SIM, block: int = 2048,
                       centroid_sim: float | None = CENTROID_SIM) -> DataFrame:
    """Link people of different jobs that look alike: ``(key, identity)``, the identity named by its smallest key.

    People above ``threshold`` are linked, links closed to connected components. Then rounds: identities whose
    centroids (of unit vectors) are above ``centroid_sim`` are linked likewise, until a round merges nothing; ``None``
    leaves the rounds out. Every round has fewer identities than the one before.
    """
    base = people.where(F.col(vec).isNotNull()).select(F.col(key).alias("node"), F.col(vec).alias("v")).distinct()
    labels = checkpoint(_linked(base, threshold, block))
    while centroid_sim is not None:
        members = base.join(labels, "node").select("label", unit(F.col("v")).alias("v"))
        centre = checkpoint(centroids(members, ["label"], "v").select(F.col("label").alias("node"), F.col("centroid").alias("v")))
        merged = checkpoint(_linked(centre, centroid_sim, block))
        if merged.where("node <> label").isEmpty():
            break
        step = merged.select(F.col("node").alias("label"), F.col("label").alias("__to"))
        labels = checkpoint(labels.join(step, "label").select("node", F.col("__to").alias("label")))
    return labels.select(F.col("node").alias(key), F.col("label").alias("identity"))


def _linked(base: DataFrame, threshold: float, block: int) -> DataFrame:
    """``node, label`` of the components of all pairs of vectors above the threshold.

    Every pair is compared: blocks of vectors meet in pairs, one matrix product each, and a pair of blocks gives a tree
    of its links. The work grows with the square of the vectors, divided over the pairs of blocks.
    """
    blocks = max(1, -(-base.count() // block))
    each = base.withColumn("mine", F.pmod(F.xxhash64("node", "v"), F.lit(blocks))).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<long>")))
    met = each.withColumns({"i": F.least("mine", "other"), "j": F.greatest("mine", "other")})

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        v = _matrix(rows["v"])
        v = v / np.maximum(np.abs(v).max(1, keepdims=True), 1e-300)
        v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
        of, keys = rows["mine"].to_numpy(), rows["node"].to_numpy()
        left, right = of == rows["i"].iloc[0], of == rows["j"].iloc[0]
        a, b = _linked_keys(keys[left], keys[right], v[left] @ v[right].T > threshold)
        return pd.DataFrame({"a": a, "b": b})[a != b]

    kind = base.schema["node"].dataType.simpleString()
    edges = met.groupBy("i", "j").applyInPandas(compare, f"a {kind}, b {kind}").distinct()
    return connected_components(base.select("node"), edges)


def connected_components(nodes: DataFrame, edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """Smallest node id of every component, by passing labels along edges with pointer jumping."""
    both = checkpoint(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = checkpoint(nodes.select("node", F.col("node").alias("label")).distinct())
    for _ in range(max_rounds):
        seen = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("__m"))
        near = labels.join(seen, labels["node"] == seen["a"], "left").select("node", "label", F.least("label", "__m").alias("__n"))
        jump = labels.select(F.col("node").alias("__n"), F.col("label").alias("__j"))
        nxt = checkpoint(near.join(jump, "__n", "left").select("node", F.col("label").alias("__old"), F.least("__n", "__j").alias("label")))
        changed = not nxt.where(F.col("label") != F.col("__old")).isEmpty()
        labels = nxt.drop("__old")
        if not changed:
            return labels
    raise RuntimeError("labels did not settle")
