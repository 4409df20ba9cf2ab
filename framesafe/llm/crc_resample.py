"""Importance resampling towards a target: hashed n-gram features, their CRCs derived from prefix CRCs.

Documents are drawn without replacement by the ratio of two bags of hashed n-grams, the target's and the corpus's.

1. Each document is reduced to its words joined by one space, and scanned once; the running CRC after every
   byte is kept (raw: from zero, nothing inverted). The scan runs in lanes, so that a step serves a thousand of them.
2. The CRC of any n-gram comes from two prefixes: a prefix of ``a`` bytes moved on by ``b - a`` zero bytes is what
   the prefix of ``b`` bytes owes to its head, and cancels against it. Moving on is linear over GF(2): one table of
   operators for each power of two, so ``log2`` of the gram's length look-ups.
3. A document's buckets (CRC modulo ``buckets``) are stored packed; counts per bucket are added up in each task and
   then by bucket. A bucket's gain is the floor of 1000 times the logarithm of the smoothed ratio.
4. A document's weight is the floored mean of its gains; its score adds Gumbel noise from a hash of its id. The
   highest scores are drawn. Counts per score (whole numbers, so a bounded table) give each score's place, and ranks
   are counted within equal scores only: no global sort.

Results: null texts and texts without words have no features and weight 0; they are never drawn, as
``least_words`` rows are asked for (with ``least_words=0`` they take part). A null ``doc_id`` counts as an empty
text in the noise and comes first in ties; rows with equal id and score are ranked in any order. Repeated rows count
as often as they stand there. An empty table gives an empty table; an empty target is a ratio to nothing, which
still has smoothed gains. Columns other than ``doc_id`` and ``text`` are not read; ``resample`` hands them on.
A text longer than a piece is cut between words, with the words that a gram may need repeated; one word is never cut.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, PIECE_BYTES, byte_strings, per_batch, pieces, stored

POLYNOMIAL = 0xEDB88320
ONES = np.uint32(0xFFFFFFFF)
BETWEEN = np.ones(256, bool)  # bytes that no word holds: [\x00-\x2F\x3A-\x60\x7B-\x7F] after lower-casing
BETWEEN[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
LEAST_LANE = 256


def _byte_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(POLYNOMIAL), t >> 1).astype(np.uint32)
    return t


BYTE = _byte_table()


def _apply(operator: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return operator[0][crc & 255] ^ operator[1][(crc >> 8) & 255] ^ operator[2][(crc >> 16) & 255] ^ operator[3][crc >> 24]


def _operators(n: int) -> list[np.ndarray]:
    """Operator ``k`` moves a raw CRC on by ``2 ** k`` zero bytes: what each of its four bytes becomes."""
    each = np.arange(256, dtype=np.uint32)
    lone = np.stack([each << np.uint32(8 * j) for j in range(4)])
    out = [BYTE[lone & 255] ^ (lone >> 8)]
    while len(out) < n:
        out.append(_apply(out[-1], out[-1]))
    return out


OPERATORS = _operators(40)


def moved_on(crc: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
    """Raw CRCs after ``n_bytes`` more zero bytes each."""
    out = crc.copy()
    k = 0
    while len(out) and int(n_bytes.max()) >> k:
        has = np.flatnonzero((n_bytes >> k) & 1)
        out[has] = _apply(OPERATORS[k], out[has])
        k += 1
    return out


def _carried(ends: list[int], width: int) -> list[int]:
    """The prefix before each lane, from the lanes' own CRCs."""
    each = np.arange(256, dtype=np.uint32)
    a, b, c, d = (moved_on(each << np.uint32(8 * j), np.full(256, width)).tolist() for j in range(4))
    crc, out = 0, []
    for own in ends:
        out.append(crc)
        crc = a[crc & 255] ^ b[(crc >> 8) & 255] ^ c[(crc >> 16) & 255] ^ d[crc >> 24] ^ own
    return out


def running_crcs(data: np.ndarray) -> np.ndarray:
    """Raw CRC of each prefix of ``data``: ``len + 1`` numbers, the first of them 0."""
    n = len(data)
    width = max(LEAST_LANE, math.isqrt(n))
    lanes = -(-n // width) if n else 0
    padded = np.zeros(lanes * width, np.uint8)
    padded[:n] = data
    steps = np.ascontiguousarray(padded.reshape(lanes, width).T)
    crcs = np.empty((width, lanes), np.uint32)
    state = np.zeros(lanes, np.uint32)
    for k in range(width if lanes else 0):
        state = BYTE.take((state ^ steps[k]) & 255) ^ (state >> 8)
        crcs[k] = state
    # what stands before a lane, moved on along it, is added to all of its prefixes
    before = np.array(_carried(crcs[-1].tolist(), width), np.uint32) if lanes else state
    for k in range(width if lanes > 1 else 0):
        before = BYTE.take(before & 255) ^ (before >> 8)
        crcs[k] ^= before
    out = np.zeros(n + 1, np.uint32)
    out[1:] = crcs.T.reshape(-1)[:n]
    return out


class Grams:
    """Prefix CRCs of the separator-normalised rows of a piece, and the CRC of any run of words of one row."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        lower = LOWER[data]
        inside = ~BETWEEN[lower]
        begins, stops = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        stops[:-1] &= ~inside[1:]
        edges = offsets[1:-1]
        edges = edges[(edges > 0) & (edges < len(data))]
        begins[edges] = inside[edges]
        stops[edges - 1] = inside[edges - 1]
        starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
        kept = inside.copy()
        after = ends[ends < len(data)]
        kept[after] = True  # the one separator after each word
        lower[~inside] = 0x20
        place = np.zeros(len(data) + 1, np.int64)
        np.cumsum(kept, out=place[1:])
        self.starts, self.ends = place[starts], place[ends]
        self.prefix = running_crcs(lower[kept])
        self.row = np.searchsorted(offsets, starts, side="right") - 1
        self.first = np.searchsorted(self.row, np.arange(len(offsets)))

    def crcs(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """CRC-32 of every run of ``size`` words of a row, and the number of its first word."""
        n = max(0, len(self.starts) - size + 1)
        at = np.flatnonzero(self.row[:n] == self.row[size - 1 : size - 1 + n])
        a, b = self.starts[at], self.ends[at + size - 1]
        return self.prefix[b] ^ moved_on(self.prefix[a] ^ ONES, b - a) ^ ONES, at


def _cuts(data: np.ndarray, limit: int, overlap: int) -> Iterator[tuple[int, int, int]]:
    """Stretches of a long row that end between words: start, end, and how many words at the start were in the last one."""
    start, end, known = 0, 0, 0
    while end < len(data):
        end = min(len(data), end + limit)
        while end < len(data):
            between = np.flatnonzero(BETWEEN[LOWER[data[end : end + limit]]])
            if len(between):
                end += int(between[0])
                break
            end = min(len(data), end + limit)
        yield start, end, known
        inside = ~BETWEEN[LOWER[data[start:end]]]
        begins = np.flatnonzero(inside & ~np.r_[False, inside[:-1]])
        known = min(overlap, len(begins))
        start = start + int(begins[-known]) if known else end


def _features(data: np.ndarray, offsets: np.ndarray, most_words: int, buckets: int, kind: np.dtype, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words and features of each row of a piece, and the packed buckets of all rows in their order."""
    rows = len(offsets) - 1
    n_words, n_features, found = np.zeros(rows, np.int64), np.zeros(rows, np.int64), []
    if rows == 1 and len(data) > 2 * limit:
        stretches = [(data[a:b], np.array([0, b - a]), known) for a, b, known in _cuts(data, limit, most_words - 1)]
    else:
        stretches = [(data, offsets, 0)]
    for part, edges, known in stretches:
        grams = Grams(part, edges)
        counts = np.diff(grams.first)
        n_words += counts - known
        keys, row = [], []
        for size in range(1, most_words + 1):
            crc, at = grams.crcs(size)
            new = at + size > known  # the others ended in the stretch before
            keys.append((crc[new] % np.uint32(buckets)).astype(kind))
            row.append(grams.row[at[new]])
            n_features += np.bincount(row[-1], minlength=rows)
        joined = np.concatenate(keys)
        found.append(joined if most_words == 1 else joined[np.argsort(np.concatenate(row), kind="stable")])
    return n_words, n_features, np.concatenate(found) if found else np.zeros(0, kind)


def _kind(buckets: int) -> np.dtype:
    return np.dtype("<u2" if buckets <= 1 << 16 else "<u4")


def bags(docs: DataFrame, most_words: int = 1, buckets: int = 10_000, limit: int = PIECE_BYTES) -> DataFrame:
    """``doc_id, n_words, n_features, bag``: a row's feature buckets, packed."""
    kind = _kind(buckets)

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for a, b, data, offsets in pieces(batch.column("text"), limit):
            words, features, packed = _features(data, offsets, most_words, buckets, kind, limit)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(a, b - a), pa.array(words), pa.array(features), byte_strings(features * kind.itemsize, packed.tobytes())],
                ["doc_id", "n_words", "n_features", "bag"],
            )

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return per_batch(docs.select("doc_id", F.col("text").cast("string").alias("text")), work, f"doc_id {id_type}, n_words long, n_features long, bag binary")


def _bag_runs(column: pa.Array, kind: np.dtype, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole bags of about ``limit`` bytes: first row, end row, buckets, offsets within."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        end = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        end = min(len(column), max(end, first + 1))
        yield first, end, raw[offsets[first] : offsets[end]].view(kind), (offsets[first : end + 1] - offsets[first]) // kind.itemsize
        first = end


def bucket_counts(bagged: DataFrame, buckets: int) -> np.ndarray:
    """How often each bucket comes: ``buckets`` numbers, added up in each task and then by bucket."""
    kind = _kind(buckets)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, values, _ in _bag_runs(batch.column(0), kind) if batch.num_rows else ():
                total += np.bincount(values, minlength=buckets)
        has = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(has), pa.array(total[has])], ["bucket", "n"])

    counts = np.zeros(buckets, np.int64)
    for r in bagged.select("bag").mapInArrow(add, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        counts[r["bucket"]] = r["n"]
    return counts


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Of each bucket, 1000 times the logarithm of the smoothed ratio of its shares in target and corpus, floored."""
    n = len(corpus)
    s_all, t_all = int(corpus.sum()) + n, int(target.sum()) + n
    return np.array([math.floor(1000 * math.log(((t + 1) * s_all) / ((s + 1) * t_all))) for s, t in zip(corpus.tolist(), target.tolist())], np.int64)


def _weighted(bagged: DataFrame, gain: np.ndarray, buckets: int) -> DataFrame:
    kind = _kind(buckets)

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        counts = batch.column("n_features").to_numpy()
        sums = np.zeros(len(counts), np.int64)
        for first, end, values, offsets in _bag_runs(batch.column("bag"), kind):
            so_far = np.zeros(len(values) + 1, np.int64)
            np.cumsum(gain[values], out=so_far[1:])
            sums[first:end] = np.diff(so_far[offsets])
        weight = np.where(counts > 0, sums // np.maximum(counts, 1), 0)
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "n_words", "n_features")), pa.array(weight)], ["doc_id", "n_words", "n_features", "weight"])

    id_type = bagged.schema["doc_id"].dataType.simpleString()
    return per_batch(bagged, work, f"doc_id {id_type}, n_words long, n_features long, weight long")


def scores(docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, seed: int = 2024, most_words: int = 1, buckets: int = 10_000) -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` of every row; rank is null where a row is not drawn.

    ``percent`` of the rows with at least ``least_words`` words are drawn, rounded down.
    """
    spark = docs.sparkSession
    bagged = stored(bags(docs, most_words, buckets))
    gain = gains(bucket_counts(bagged, buckets), bucket_counts(bags(target.select(F.lit(0).alias("doc_id"), "text"), most_words, buckets), buckets))
    id_text = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), id_text).cast("binary"), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(F.lit(-1000) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))
    scored = _weighted(bagged, gain, buckets).withColumn("score", F.col("weight") + noise)
    scored = stored(scored.select("doc_id", "n_features", "weight", "score", (F.col("n_words") >= least_words).alias("may")))
    # scores are whole numbers between bounds that the logarithms set, so this table stays small
    tally = scored.where("may").groupBy("score").count().orderBy(F.desc("score")).collect()
    draw = percent * sum(r["count"] for r in tally) // 100
    above, places = 0, []
    for r in tally:
        if above >= draw:
            break
        places.append((r["score"], above))
        above += r["count"]
    out = ["doc_id", "n_features", "weight", "score"]
    if not places:
        return scored.select(*out, F.lit(None).cast("long").alias("rank"))
    place = F.broadcast(spark.createDataFrame(places, "score long, above long"))
    high = F.col("may") & (F.col("score") >= places[-1][0])
    within = F.row_number().over(Window.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_first()))
    ranked = scored.where(high).join(place, "score").withColumn("rank", F.col("above") + within)
    ranked = ranked.select(*out, F.when(F.col("rank") <= draw, F.col("rank")).cast("long").alias("rank"))
    return scored.where(~high).select(*out, F.lit(None).cast("long").alias("rank")).union(ranked)


def resample(docs: DataFrame, target: DataFrame, **how) -> DataFrame:
    """The rows of ``docs``, all their columns, whose ``doc_id`` is drawn (see ``scores`` for the parameters)."""
    drawn = scores(docs, target, **how).where("rank IS NOT NULL").select(F.col("doc_id").alias("drawn")).distinct()
    return docs.join(drawn, docs["doc_id"].eqNullSafe(drawn["drawn"]), "left_semi")
