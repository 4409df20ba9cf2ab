"""Shared pieces: hashing of whole text batches with numpy, bounded two-level bit filters, connected components.

Texts reach Python as Arrow batches and are handled as UTF-8 bytes, a piece of about a quarter of a megabyte of
whole documents at a time, so that a task's memory does not grow with the batch.
"""

from __future__ import annotations

import contextlib
import itertools
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framesafe.session import checkpoint

PIECE_BYTES = 1 << 18

_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_MASK = (1 << 64) - 1

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers: dict[str, np.ndarray] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: spreads every input bit over all output bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def seeds(n: int, start: int = 1) -> np.ndarray:
    """``n`` odd 64-bit multipliers, the same in every task."""
    return mix(np.arange(start, start + n, dtype=np.uint64) * np.uint64(_BASE)) | np.uint64(1)


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        size = max(n, PIECE_BYTES * 2)
        for key, base in (("up", _BASE), ("down", _BASE_INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[key] = np.multiply.accumulate(steps)
    return _powers["up"], _powers["down"]


class RangeHash:
    """64-bit hashes of any byte ranges of one buffer, from prefix sums of a polynomial."""

    def __init__(self, data: np.ndarray):
        up, self.down = _power_table(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=self.sums[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.down[starts] + (ends - starts).astype(np.uint64))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the ``len + 1`` offsets of its rows; null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not (pa.types.is_string(column.type) or pa.types.is_large_string(column.type)):
        column = column.cast(pa.large_string())
    wide = pa.types.is_large_string(column.type)
    n = len(column)
    if n == 0 or column.buffers()[1] is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + n + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, offsets.astype(np.int64)


def runs(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """First and end row of runs of whole rows of about ``limit`` values, from the ``len + 1`` offsets of the rows."""
    first, n = 0, len(offsets) - 1
    while first < n:
        end = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        end = min(n, max(end, first + 1))
        yield first, end
        first = end


def pieces(column: pa.Array, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a column into runs of whole rows of about ``limit`` bytes: first row, end row, bytes, offsets within."""
    raw, offsets = text_buffers(column)
    for first, end in runs(offsets, limit):
        yield first, end, raw[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the rows of a piece, with A-Z lower-cased for the hashes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, between: np.ndarray = SPACE):
        n = len(data)
        inside = ~between[data]
        begins, stops = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        stops[:-1] &= ~inside[1:]
        edges = offsets[1:-1]
        edges = edges[(edges > 0) & (edges < n)]
        begins[edges] = inside[edges]
        stops[edges - 1] = inside[edges - 1]
        self.starts = np.flatnonzero(begins)
        self.ends = np.flatnonzero(stops) + 1
        self.hash = RangeHash(LOWER[data])(self.starts, self.ends)
        self.row = np.searchsorted(offsets, self.starts, side="right") - 1
        self.rows = len(offsets) - 1
        self.first = np.searchsorted(self.row, np.arange(self.rows + 1))  # word range of each row

    def shingles(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of ``size``-word shingles and their rows; a shorter row gives its whole sequence as one."""
        return shingle_hashes(self.hash, self.row, self.first, size)


def shingle_hashes(words: np.ndarray, row: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    factors = seeds(size, 101)
    n = max(0, len(words) - size + 1)
    total = np.zeros(n, np.uint64)
    for k in range(size):
        total += words[k : k + n] * factors[k]
    whole = row[:n] == row[size - 1 : size - 1 + n]
    out, rows = mix(total[whole]), row[:n][whole]
    counts = np.diff(first)
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        extra = np.zeros(len(short), np.uint64)
        for k in range(size - 1):
            has = counts[short] > k
            extra[has] += words[first[short[has]] + k] * factors[k]
        extra = mix(extra + counts[short].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        order = np.argsort(np.concatenate([rows, short]), kind="stable")
        out, rows = np.concatenate([out, extra])[order], np.concatenate([rows, short])[order]
    return out, rows


def row_order(hashes: np.ndarray, row: np.ndarray) -> np.ndarray:
    """An order by row, then hash: one sort of packed keys; by both columns in the rare case that the packing tells too little."""
    if len(row) and int(row.max()) < 1 << 20:
        key = (row.astype(np.uint64) << np.uint64(44)) | (hashes >> np.uint64(20))
        order = np.argsort(key)
        k, h = key[order], hashes[order]
        if not ((k[1:] == k[:-1]) & (h[1:] != h[:-1])).any():
            return order
    return np.lexsort((hashes, row))


def distinct_in_rows(hashes: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct hashes of each row, in order of rows, their rows, and how often each comes."""
    order = row_order(hashes, row)
    h, r = hashes[order], row[order]
    first = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (r[1:] != r[:-1])]) if len(h) else np.zeros(0, np.int64)
    return h[first], r[first], np.diff(np.r_[first, len(h)])


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` whose workers give freed memory back at the end of a task, as others of their executor run on."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        for pool in (pa.default_memory_pool(), pa.system_memory_pool()):  # the latter is the C library's, numpy's too
            pool.release_unused()

    return df.mapInArrow(task, schema)


def per_batch(df: DataFrame, work: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` for functions that take one batch at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from work(batch)

    return map_batches(df, run, schema)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def byte_strings(lengths: np.ndarray, data: bytes | np.ndarray) -> pa.Array:
    """A binary column from one buffer and the rows' lengths."""
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.BinaryArray.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


# Bit filters for values seen twice.

BUCKET_BITS = 18


def filter_bits(expected: int, most: int = 28, per_value: int = 16) -> int:
    """log2 of the size of a filter for ``expected`` values; ``most`` bounds what is broadcast (28: 32 MB)."""
    return int(min(most, max(BUCKET_BITS, int(np.ceil(np.log2(max(1, expected) * per_value))))))


def filter_positions(values: np.ndarray, bits: int) -> np.ndarray:
    """Two bit positions for each 64-bit hash."""
    shift = np.uint64(64 - bits)
    return np.stack([values >> shift, (values * np.uint64(0xC2B2AE3D27D4EB4F)) >> shift])


class SeenTwice:
    """Two bit filters of a task: hashes seen in at least one row, and hashes seen in at least two."""

    def __init__(self, bits: int):
        self.bits, self.once, self.twice = bits, np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.waiting: list[np.ndarray] = []
        self.size = 0

    def add(self, values: np.ndarray) -> None:
        """``values`` of one piece; a value stands there once for each row that holds it."""
        self.waiting.append(values)
        self.size += len(values)
        if self.size > 1 << 20:
            self._settle()

    def _settle(self) -> None:
        new, counts = np.unique(np.concatenate([np.zeros(0, np.uint64), *self.waiting]), return_counts=True)
        again = new[(counts > 1) | np.isin(new, self.once, assume_unique=True)]
        self.once, self.twice = np.union1d(self.once, new), np.union1d(self.twice, again)
        self.waiting, self.size = [], 0

    def rows(self) -> Iterator[pa.RecordBatch]:
        """The set bits of both filters by bucket: positions while they are few, else a bit map."""
        self._settle()
        once, twice = (np.unique(filter_positions(x, self.bits)) for x in (self.once, self.twice))
        buckets = np.unique(once >> np.uint64(BUCKET_BITS))
        out: tuple[list, list, list] = ([], [], [])
        for b in buckets:
            edge = np.array([b, b + np.uint64(1)], np.uint64) << np.uint64(BUCKET_BITS)
            out[0].append(int(b))
            for k, bitset in ((1, once), (2, twice)):
                lo, hi = np.searchsorted(bitset, edge)
                out[k].append(_pack((bitset[lo:hi] - edge[0]).astype(np.uint32)))
        for at in range(0, len(buckets), 256):
            yield pa.RecordBatch.from_arrays([pa.array(out[0][at : at + 256], pa.int32()), *(pa.array(x[at : at + 256], pa.binary()) for x in out[1:])], ["bucket", "once", "twice"])


def _pack(positions: np.ndarray) -> bytes:
    if len(positions) * 32 < 1 << BUCKET_BITS:
        return b"s" + positions.tobytes()
    dense = np.zeros(1 << BUCKET_BITS, bool)
    dense[positions] = True
    return b"d" + np.packbits(dense).tobytes()


def _unpack(packed: bytes) -> np.ndarray:
    dense = np.zeros(1 << BUCKET_BITS, bool)
    if packed[:1] == b"s":
        dense[np.frombuffer(packed, np.uint32, offset=1)] = True
    else:
        dense[:] = np.unpackbits(np.frombuffer(packed, np.uint8, offset=1)).view(bool)
    return dense


def seen_twice_filter(df: DataFrame, values: Callable[[pa.RecordBatch], Iterator[np.ndarray]], bits: int):
    """A broadcast bit map that holds every hash which at least two rows give; other hashes rarely test positive.

    Tasks send the set bits of their own two filters; partitions of buckets add them up (a bit that two
    tasks have set, or one of them twice, is set). The map has ``2 ** bits`` bits however large the input is.
    """

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = SeenTwice(bits)
        for batch in batches:
            for hashes in values(batch):
                seen.add(hashes)
        yield from seen.rows()

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maps: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for bucket, once, twice in zip(*(c.to_pylist() for c in batch.columns)):
                a, b = _unpack(once), _unpack(twice)
                if bucket in maps:
                    have = maps[bucket]
                    have[1] |= b | (have[0] & a)
                    have[0] |= a
                else:
                    maps[bucket] = [a, b]
        for bucket, (_, twice) in maps.items():
            yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([np.packbits(twice).tobytes()], pa.binary())], ["bucket", "bits"])

    parts = map_batches(map_batches(df, own, "bucket int, once binary, twice binary").repartition("bucket"), add_up, "bucket int, bits binary")
    whole = np.zeros(1 << (bits - 3), np.uint8)
    step = 1 << (BUCKET_BITS - 3)
    for r in parts.collect():  # at most 2 ** bits bits
        whole[r["bucket"] * step : (r["bucket"] + 1) * step] = np.frombuffer(r["bits"], np.uint8)
    return df.sparkSession.sparkContext.broadcast(whole)


def may_hold(bitmap: np.ndarray, values: np.ndarray, bits: int) -> np.ndarray:
    a, b = filter_positions(values, bits)
    test = lambda p: (bitmap[p >> np.uint64(3)] >> (np.uint64(7) - (p & np.uint64(7))).astype(np.uint8)) & 1
    return (test(a) & test(b)).astype(bool)


SETTLE_EDGES = 500_000


def components(edges: DataFrame, a: str = "a", b: str = "b", settle: int = SETTLE_EDGES) -> DataFrame:
    """``node, component`` of every node that has an edge; the component is its smallest node.

    While there are more than ``settle`` edges, each node hooks on its smallest neighbour, and edges are
    contracted to where the hooks end (which keeps who is connected, and the smallest node).
    The hooks are minima, added up on the map side however large a star is. What is left of the edges,
    of that bounded number, is settled in one task.
    """
    e = checkpoint(edges.select(F.least(a, b).alias("v"), F.greatest(a, b).alias("u")).where("u <> v").distinct())
    hops: list[DataFrame] = []
    while e.count() > settle:
        both = e.select("v", "u").union(e.select(F.col("u").alias("v"), F.col("v").alias("u")))
        hook = checkpoint(both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("to")).select("node", F.least("node", "to").alias("to")))
        while True:  # jump along the hooks to their ends; each jump doubles the reach
            beyond = hook.select(F.col("node").alias("to"), F.col("to").alias("beyond"))
            jumped = checkpoint(hook.join(beyond, "to"))
            hook = jumped.select("node", F.col("beyond").alias("to"))
            if jumped.where("to <> beyond").isEmpty():
                break
        hops.append(hook)
        ends = [hook.select(F.col("node").alias(c), F.col("to").alias(f"{c}_to")) for c in ("u", "v")]
        moved = e.join(ends[0], "u").join(ends[1], "v").where("u_to <> v_to")
        e = checkpoint(moved.select(F.least("u_to", "v_to").alias("v"), F.greatest("u_to", "v_to").alias("u")).distinct())

    def union_find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while parent.setdefault(x, x) != x:
                parent[x] = x = parent[parent[x]]
            return x

        for batch in batches:
            for u, v in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist()):
                u, v = root(u), root(v)
                parent[max(u, v)] = min(u, v)
        if parent:
            nodes = list(parent)
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([root(x) for x in nodes], pa.int64())], ["node", "to"])

    hops.append(map_batches(e.select("u", "v").coalesce(1), union_find, "node long, to long"))
    found = hops[0]
    for hop in hops[1:]:
        step = hop.select(F.col("node").alias("to"), F.col("to").alias("beyond"))
        found = found.join(step, "to", "left").select("node", F.coalesce("beyond", "to").alias("to"))
    return checkpoint(found.select("node", F.col("to").alias("component")))


def plain_names(docs: DataFrame) -> DataFrame:
    """``docs`` with all columns but ``doc_id`` and ``text`` named by their position, so that none clashes with a step's own."""
    return docs.toDF(*[c if c in ("doc_id", "text") else f"c{i}" for i, c in enumerate(docs.columns)])


def text_or_empty(c: str = "text") -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], least: int = 20_000) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of some ``least`` rows from a partition sorted by ``keys`` that never cut a group, and the group's number of each row."""

    def numbered(t: pa.Table) -> np.ndarray:
        new = np.zeros(t.num_rows, bool)
        for k in keys:
            x = t.column(k).to_numpy()
            new[1:] |= x[1:] != x[:-1]
        return np.cumsum(new)

    kept: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows == 0:
            continue
        kept.append(batch)
        if sum(b.num_rows for b in kept) < least:
            continue
        t = pa.Table.from_batches(kept).combine_chunks()
        group = numbered(t)
        cut = int(np.searchsorted(group, group[-1]))
        if cut:
            yield t.slice(0, cut), group[:cut]
        kept = t.slice(cut).to_batches()
    if kept:
        t = pa.Table.from_batches(kept).combine_chunks()
        yield t, numbered(t)


def id_filter(ids: DataFrame, column: str, bits: int):
    """A broadcast bit map of bounded size that holds every id of a long column; other ids rarely test positive."""

    def values(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        h = mix(batch.column(0).to_numpy().view(np.uint64))
        yield np.concatenate([h, h])

    return seen_twice_filter(ids.select(column), values, bits)


def may_hold_ids(bitmap: np.ndarray, ids: np.ndarray, bits: int) -> np.ndarray:
    return may_hold(bitmap, mix(ids.astype(np.int64).view(np.uint64)), bits)


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors reach; where the cluster names none (tests), the session's own checkpoint folder."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if spark.sparkContext.getCheckpointDir() is None:
        checkpoint(spark.range(1))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: cuts lineage, compressed."""
    path = f"{shared_folder(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """A function like ``stored`` whose files go when the block ends; what the block returns must not read them later."""
    folder = f"{shared_folder(spark)}/scratch-{uuid.uuid4().hex}"
    number = itertools.count()

    def keep(df: DataFrame) -> DataFrame:
        path = f"{folder}/{next(number)}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    try:
        yield keep
    finally:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
