"""Benchmark decontamination: word n-gram seeds, then Smith-Waterman alignment.

Words are runs of letters and digits (any character above ASCII counts as a letter), lower-cased.

1. The seeds of an item are all its three-word grams, however many documents hold them: copies of one item
   that change different words share different grams with it, so none can be left out for being frequent.
2. A pass over all documents emits, around each seed in a document, a passage that reaches two item lengths
   to both sides (a bit map of bounded size tells the seeds); joined on the seed they give the pairs of
   passage and item. Both joins are dealt by a salt too, as a seed or an item may be hot.
3. A pair whose passage holds too few of the item's words to reach ``threshold`` with all of them matched is
   dropped; the bound is exact.
4. The alignment (match 2, mismatch -1, gap -1) is scored against that of the item with itself. Pairs of
   ``threshold`` or more are leaks: exact, edited and paraphrased copies, and parts of half an item. A copy
   that keeps no three words in a row of the item is not looked up (every third word changed scores 0.5).

Null and empty texts, rows without ``doc_id`` and items without ``item_id`` or with fewer than three words
match nothing. Repeated rows give one result per ``doc_id`` and ``item_id``: the best. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framesafe.session import checkpoint

from .common import Words, filter_bits, id_filter, may_hold_ids, per_batch, pieces, plain_names, signed

GRAM = 3
SALTS = 16
MATCH, MISMATCH, GAP = 2, -1, -1
CELLS = 1 << 19  # of the alignment rows that are computed together

BETWEEN = np.ones(256, bool)
BETWEEN[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False

MATCHES = "doc_id long, item_id long, score double, first_word int, last_word int"


def _grams(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, row and first word of every gram (rows with fewer words have none)."""
    n = max(0, len(w.hash) - GRAM + 1)
    whole = np.flatnonzero(w.row[:n] == w.row[GRAM - 1 : GRAM - 1 + n])
    counts = np.diff(w.first)
    hashes, row = w.shingles(GRAM)
    long = counts[row] >= GRAM
    return hashes[long], row[long], whole


def _lists(rows: list[np.ndarray]) -> pa.Array:
    cuts = np.zeros(len(rows) + 1, np.int32)
    np.cumsum([len(r) for r in rows], out=cuts[1:])
    return pa.ListArray.from_arrays(pa.array(cuts), pa.array(signed(np.concatenate([np.zeros(0, np.uint64), *rows]))))


def _items(benchmark: DataFrame) -> DataFrame:
    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for first, end, data, offsets in pieces(batch.column("text")):
            w = Words(data, offsets, BETWEEN)
            hashes, row, _ = _grams(w)
            each = [np.unique(hashes[row == r]) for r in range(end - first)]
            words = [w.hash[w.first[r] : w.first[r + 1]] for r in range(end - first)]
            yield pa.RecordBatch.from_arrays([batch.column("item_id").slice(first, end - first), _lists(words), _lists(each)], ["item_id", "item", "grams"])

    texts = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.lower("text").alias("text")).where("item_id IS NOT NULL AND length(text) > 0").distinct()
    return per_batch(texts, work, "item_id long, item array<long>, grams array<long>").where(F.size("item") >= GRAM)


def _windows(start: int, end: int, seeds: np.ndarray, first: int, reach: int) -> Iterator[tuple[int, int, int, int]]:
    """A stretch as windows of at most ``4 * reach`` words: start, end, and its seeds' numbers.

    A reportable alignment spans at most ``reach`` words, and neighbours share as many, so one window holds it whole.
    """
    size = 4 * reach
    while True:
        stop = min(end, start + size)
        x, y = np.searchsorted(seeds, [start, stop - GRAM + 1])
        if x < y:
            yield start, stop, first + int(x), first + int(y)
        if stop == end:
            return
        start = stop - reach


def _passages(texts: DataFrame, bitmap, bits: int, reach: int) -> DataFrame:
    """``doc_id, start, words, seeds``: stretches of words around the seeds; overlapping ones are one."""

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids = batch.column("doc_id").to_numpy()
        for first, _, data, offsets in pieces(batch.column("text")):
            w = Words(data, offsets, BETWEEN)
            hashes, row, at = _grams(w)
            hit = np.flatnonzero(may_hold_ids(bitmap.value, signed(hashes), bits))
            if not len(hit):
                continue
            lo = np.maximum(at[hit] - reach, w.first[row[hit]])
            hi = np.minimum(at[hit] + GRAM + reach, w.first[row[hit] + 1])
            new = np.r_[True, (lo[1:] > hi[:-1]) | (row[hit][1:] != row[hit][:-1])]
            heads, tails = np.flatnonzero(new), np.r_[np.flatnonzero(new)[1:], len(hit)] - 1
            starts, ends = lo[heads], hi[tails]
            spans = [s for k, (a, b) in enumerate(zip(heads.tolist(), tails.tolist())) for s in _windows(int(starts[k]), int(ends[k]), at[hit[a : b + 1]], a, reach)]
            words = [w.hash[a:b] for a, b, _, _ in spans]
            seeds = [np.unique(hashes[hit[x:y]]) for _, _, x, y in spans]
            begin = np.array([a for a, _, _, _ in spans])
            rows = w.row[begin]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[first + rows]), pa.array((begin - w.first[rows]).astype(np.int32)), _lists(words), _lists(seeds)],
                ["doc_id", "start", "words", "seeds"],
            )

    return per_batch(texts, work, "doc_id long, start int, words array<long>, seeds array<long>")


def local_alignments(items: list[np.ndarray], passages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The best local score of each pair, and the passage's words up to where it ends (the first such end)."""
    n, m, width = len(items), max(map(len, items)), max(map(len, passages))
    # no word has hash 0 or 1 in practice; unlike fillers never match each other
    a, b = np.zeros((n, m), np.int64), np.ones((n, width), np.int64)
    for k, (x, y) in enumerate(zip(items, passages)):
        a[k, : len(x)], b[k, : len(y)] = x, y
    above = np.zeros((n, width + 1), np.int32)
    best, end = np.zeros(n, np.int32), np.zeros(n, np.int64)
    ramp = np.arange(width, dtype=np.int32) * -GAP
    for i in range(m):
        here = above[:, :-1] + np.where(b == a[:, i : i + 1], np.int32(MATCH), np.int32(MISMATCH))
        np.maximum(here, above[:, 1:] + GAP, out=here)
        np.maximum(here, 0, out=here)
        here = np.maximum.accumulate(here + ramp, axis=1) - ramp  # gaps along the passage
        top = here.argmax(1)
        value = here[np.arange(n), top]
        better = value > best
        best[better], end[better] = value[better], top[better] + 1
        above[:, 1:] = here
    return best, end


def _align(pairs: DataFrame, threshold: float) -> DataFrame:
    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        items = [x.values.to_numpy() for x in batch.column("item")]
        passages = [x.values.to_numpy() for x in batch.column("words")]
        able = [i for i, (x, y) in enumerate(zip(items, passages)) if np.isin(x, y).mean() >= threshold]
        order = sorted(able, key=lambda i: (len(passages[i]), len(items[i])))
        ids, starts, item_ids = batch.column("doc_id").to_numpy(), batch.column("start").to_numpy(), batch.column("item_id").to_numpy()
        found: list[tuple] = []
        while order:
            n = 1
            while n < len(order) and n < 512 and (n + 1) * len(passages[order[n]]) <= CELLS:
                n += 1
            group, order = order[:n], order[n:]
            best, end = local_alignments([items[i] for i in group], [passages[i] for i in group])
            share = best / np.array([MATCH * len(items[i]) for i in group])
            keep = np.flatnonzero(share >= threshold)
            if len(keep):
                # the same alignment backwards, from its end, tells where it starts
                back, begin = local_alignments([items[group[k]][::-1] for k in keep], [passages[group[k]][: end[k]][::-1] for k in keep])
                for k, x in zip(keep, begin):
                    i = group[k]
                    found.append((ids[i], item_ids[i], share[k], starts[i] + end[k] - x, starts[i] + end[k] - 1))
        if found:
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), kinds)], ["doc_id", "item_id", "score", "first_word", "last_word"])

    return per_batch(pairs, work, MATCHES)


def leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``doc_id, item_id, score, first_word, last_word`` of every document that holds a copy of an item."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lower("text").alias("text")).where("doc_id IS NOT NULL AND length(text) > 0")
    items = checkpoint(_items(benchmark))
    size = items.agg(F.max(F.size("item")), F.sum(F.size("grams"))).first()
    if size[0] is None:
        return spark.createDataFrame([], MATCHES)
    reach, bits = 2 * size[0], filter_bits(size[1])
    grams = checkpoint(items.select("item_id", F.explode("grams").alias("gram")).distinct())
    passages = checkpoint(_passages(texts, id_filter(grams, "gram", bits), bits, reach))
    key = ["doc_id", "start", "mark"]
    passages = passages.withColumn("mark", F.xxhash64("words"))
    salted = lambda df: df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salt = F.pmod(F.xxhash64(*key), F.lit(SALTS)).cast("int").alias("salt")
    pairs = passages.select(*key, salt, F.explode("seeds").alias("gram")).join(salted(grams), ["gram", "salt"]).select(*key, "salt", "item_id").distinct()
    ready = pairs.join(passages.select(*key, "words"), key).join(salted(items.select("item_id", "item")), ["item_id", "salt"])
    found = _align(ready.select("doc_id", "start", "words", "item_id", "item"), threshold)
    best = found.groupBy("doc_id", "item_id").agg(F.max(F.struct("score", -F.col("first_word"), -F.col("last_word"))).alias("b"))
    return best.select("doc_id", "item_id", "b.score", (-F.col("b.col2")).alias("first_word"), (-F.col("b.col3")).alias("last_word"))


def clean(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``docs`` without the documents that hold a copy of a benchmark item."""
    bad = leaks(docs, benchmark, threshold).select(F.col("doc_id").alias("_leak_id")).distinct()
    rows = plain_names(docs)
    return rows.join(bad, rows.doc_id.cast("long") == F.col("_leak_id"), "left_anti").toDF(*docs.columns)
