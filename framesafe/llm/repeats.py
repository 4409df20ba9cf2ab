"""Removal of long repeated strings by prefix-free parsing.

Every byte that a ``WINDOW``-byte string covers which also starts anywhere else, the same document included,
is removed; matches never cross documents, and strings are judged on the input. Texts are UTF-8 bytes.

Parsing. A rolling hash of eight bytes triggers a phrase border about every 32 bytes. The first trigger
within a window depends on the window alone, so equal windows stand alike to it: they end the same phrase
(``lead`` bytes before the trigger) and go on alike after it. A border's context is the phrase before it
and the ``WINDOW`` bytes from it; the dictionary holds the distinct contexts, the parse their places.

1. A bit map of bounded size tells which borders' next ``CORE`` bytes come twice; others have no repeated
   window. Only suspected borders go on.
2. All windows of a context that comes twice are repeated. This settles whatever is copied with its
   surroundings, without a look at single bytes, in counts that are added up in tasks first.
3. Contexts that share their core but differ are sorted: the suffix array of what follows the borders, with
   the longest common prefixes of neighbours, cuts into intervals for each length; the suffixes of the
   phrases before them fall into classes. Windows are equal if class and interval are: the corpus order of
   prefix-free parsing, truncated to the window. Cores of very many contexts are counted window by window instead.
4. Windows without a trigger in their first ``LEAD`` bytes take the first of a denser kind (every ``DENSE``
   bytes); those without any (runs of one character, say) are counted by themselves.

Contexts and windows are told apart by 64-bit hashes.

Null and empty texts, and texts shorter than the window, lose nothing. Rows without ``doc_id`` and repeated rows are texts like
any other (a repeated long row is a repeat). Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import (
    RangeHash,
    byte_strings,
    filter_bits,
    id_filter,
    may_hold,
    may_hold_ids,
    mix,
    per_batch,
    pieces,
    scratch,
    seen_twice_filter,
    signed,
    stored,
    whole_groups,
)

WINDOW = 200
GRAM, EVERY, DENSE = 8, 32, 8
LEAD = 152  # of a window before its trigger, at most
CORE = WINDOW - LEAD
HOT_CORE = 4_096  # contexts; a larger group is counted window by window


def _lead(lo: np.ndarray, hi: np.ndarray, of: np.ndarray, trigger: np.ndarray):
    """Triggers that are the first within ``LEAD`` bytes of some of the window starts ``lo`` to ``hi`` (ascending ranges).

    Returns the triggers with their leads (bytes to the first such start) and rows, and the ranges of the other starts.
    """
    some = hi > lo
    lo, hi, of = lo[some], hi[some], of[some]
    first, last = np.searchsorted(trigger, lo), np.searchsorted(trigger, hi + LEAD)
    counts = last - first
    which = np.repeat(np.arange(len(lo)), counts)
    t = trigger[np.repeat(first - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())]
    start = lo[which]
    again = np.flatnonzero(which[1:] == which[:-1]) + 1
    start[again] = t[again - 1] + 1  # starts after the trigger before
    none_lo, none_hi = start, np.minimum(t - LEAD, hi[which])
    lead = np.minimum(t - start, LEAD)
    use = t - lead < hi[which]
    end = lo.copy()
    if len(t):
        final = np.flatnonzero(np.r_[which[1:] != which[:-1], True])
        end[which[final]] = t[final] + 1
    left_lo, left_hi, left_of = np.r_[none_lo, end], np.r_[none_hi, hi], np.r_[of[which], of]
    order = np.argsort(left_lo, kind="stable")
    left_lo, left_hi, left_of = left_lo[order], left_hi[order], left_of[order]
    some = left_hi > left_lo
    return (t[use], lead[use], of[which][use]), (left_lo[some], left_hi[some], left_of[some])


class Parse:
    """Phrase borders of the texts of a piece, and the windows that no border leads."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.hash = data, RangeHash(data)
        n = len(data)
        at = np.arange(max(0, n - GRAM + 1))
        rolling = self.hash(at, at + GRAM)
        row = np.searchsorted(offsets, at, side="right") - 1
        dense = np.flatnonzero(((rolling & np.uint64(DENSE - 1)) == 0) & (at + GRAM <= offsets[row + 1]))
        trigger = dense[(rolling[dense] & np.uint64(EVERY - 1)) == 0]
        rows = np.arange(len(offsets) - 1)
        borders, (lo, hi, of) = _lead(offsets[:-1], np.maximum(offsets[1:] - WINDOW + 1, offsets[:-1]), rows, trigger)
        more, (lo, hi, of) = _lead(lo, hi, of, dense)
        self.at, self.lead, self.row = (np.concatenate(x) for x in zip(borders, more))
        self.tail = np.minimum(offsets[self.row + 1] - self.at, WINDOW)
        sizes = hi - lo
        self.gap = np.repeat(lo - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        self.gap_row = np.repeat(of, sizes)

    def cores(self) -> np.ndarray:
        return self.hash(self.at, self.at + CORE)

    def contexts(self, pick: np.ndarray) -> np.ndarray:
        at, lead, tail = self.at[pick], self.lead[pick], self.tail[pick]
        return mix(self.hash(at - lead, at + tail) ^ mix((lead * 1000 + tail).astype(np.uint64)))

    def windows(self, start: np.ndarray) -> np.ndarray:
        return mix(self.hash(start, start + WINDOW) ^ np.uint64(0x5851F42D4C957F2D))


def _places(docs: DataFrame, bits: int) -> DataFrame:
    """``id, mark, core, context, at, lead, tail`` of suspected borders; ``context, at`` alone of windows without border."""

    def values(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for _, _, data, offsets in pieces(batch.column("text")):
            p = Parse(data, offsets)
            yield np.concatenate([p.cores(), p.windows(p.gap)])

    bitmap = seen_twice_filter(docs.select("text"), values, bits)

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids, marks = batch.column("id").to_numpy(), batch.column("mark").to_numpy()
        for first, _, data, offsets in pieces(batch.column("text")):
            p = Parse(data, offsets)
            cores, alone = p.cores(), p.windows(p.gap)
            pick = np.flatnonzero(may_hold(bitmap.value, cores, bits))
            lone = np.flatnonzero(may_hold(bitmap.value, alone, bits))
            rows = np.r_[p.row[pick], p.gap_row[lone]]
            if not len(rows):
                continue
            k = len(lone)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[first + rows]), pa.array(marks[first + rows]), pa.array(signed(np.r_[cores[pick], np.zeros(k, np.uint64)])), pa.array(signed(np.r_[p.contexts(pick), alone[lone]])),
                 pa.array((np.r_[p.at[pick], p.gap[lone]] - offsets[rows]).astype(np.int32)), pa.array(np.r_[p.lead[pick], np.zeros(k, int)].astype(np.int16)),
                 pa.array(np.r_[p.tail[pick], np.full(k, -1)].astype(np.int16))],
                ["id", "mark", "core", "context", "at", "lead", "tail"],
            )

    return per_batch(docs.select("id", "mark", "text"), work, "id long, mark long, core long, context long, at int, lead short, tail short")


def _context_bytes(docs: DataFrame, cores: tuple, but: tuple | None = None) -> DataFrame:
    """``core, context, bytes, lead`` of borders with one of the ``cores`` (and rare others), once per task.

    ``cores``, and ``but`` for those to leave out, are bit maps with their sizes; a core is in or out as a whole.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent = np.zeros(0, np.uint64)
        for column in (b.column("text") for b in batches if b.num_rows):
            for _, _, data, offsets in pieces(column):
                p = Parse(data, offsets)
                core = signed(p.cores())
                wanted = may_hold_ids(cores[0].value, core, cores[1])
                if but:
                    wanted &= ~may_hold_ids(but[0].value, core, but[1])
                pick = np.flatnonzero(wanted)
                context, once = np.unique(p.contexts(pick), return_index=True)
                place = np.searchsorted(sent, context)
                fresh = np.flatnonzero(np.r_[sent, np.uint64(0)][place] != context)
                fresh = np.r_[fresh, np.flatnonzero((place == len(sent)) & (context == 0))]
                if not len(fresh):
                    continue
                sent = np.insert(sent, place[fresh], context[fresh])
                context, pick = context[fresh], pick[once[fresh]]
                lo, sizes = p.at[pick] - p.lead[pick], p.lead[pick] + p.tail[pick]
                every = np.repeat(lo - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(core[pick]), pa.array(signed(context)), byte_strings(sizes, data[every]), pa.array(p.lead[pick].astype(np.int16))],
                    ["core", "context", "bytes", "lead"],
                )

    return docs.select("text").mapInArrow(work, "core long, context long, bytes binary, lead short")


def repeated_leads(group: np.ndarray, left: np.ndarray, lead: np.ndarray, right: np.ndarray, tail: np.ndarray) -> np.ndarray:
    """For each context and lead, whether another context of its group holds the same window.

    ``left`` holds the phrases before the borders, aligned at the right; ``right`` what follows, filled up at the end.
    """
    n = len(group)
    order = np.argsort(np.ascontiguousarray(right).view(f"S{right.shape[1]}").ravel(), kind="stable")  # the suffix array
    same = right[order[1:]] == right[order[:-1]]
    common = np.where(same.all(1), WINDOW, same.argmin(1)) if n > 1 else np.zeros(0, int)  # common prefixes of neighbours
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    kind = np.unique(group, return_inverse=True)[1].astype(np.int64)  # classes of phrase suffixes, one byte longer at each step
    found = np.zeros((n, left.shape[1] + 1), bool)
    for k in range(int(lead.max()) + 1):
        rows = np.flatnonzero((lead >= k) & (tail >= WINDOW - k))
        if k:
            longer = np.flatnonzero(lead >= k)
            kind[longer] = np.unique(kind[longer] * 256 + left[longer, left.shape[1] - k], return_inverse=True)[1]
        if len(rows) < 2:
            continue
        interval = np.r_[0, np.cumsum(common < WINDOW - k)][place[rows]]
        _, which, times = np.unique(kind[rows] * n + interval, return_inverse=True, return_counts=True)
        found[rows, k] = times[which] > 1
    return found


def _runs(found: np.ndarray) -> list[list[dict]]:
    """The runs of set leads of each row."""
    edge = np.diff(np.pad(found.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    (r, a), (_, b) = np.nonzero(edge == 1), np.nonzero(edge == -1)
    out: list[list[dict]] = [[] for _ in range(len(found))]
    for row, lo, hi in zip(r.tolist(), a.tolist(), (b - 1).tolist()):
        out[row].append({"lo": lo, "hi": hi})
    return out


RUN_LIST = "array<struct<lo: int, hi: int>>"
RUNS = f"context long, runs {RUN_LIST}"
_RUNS = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))


def _matrices(t: pa.Table) -> tuple[np.ndarray, ...]:
    lead = t.column("lead").to_numpy().astype(np.int64)
    raw = t.column("bytes").to_pylist()
    left, right = np.zeros((len(raw), LEAD), np.uint8), np.zeros((len(raw), WINDOW), np.uint8)
    tail = np.array([len(b) for b in raw]) - lead
    for i, b in enumerate(raw):
        x = np.frombuffer(b, np.uint8)
        left[i, LEAD - lead[i] :] = x[: lead[i]]
        right[i, : tail[i]] = x[lead[i] :]
    return left, lead, right, tail


def _sorted_repeats(contexts: DataFrame) -> DataFrame:
    """``context, runs``: the leads at which a context's window comes in another context with its core."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, group in whole_groups(batches, ["core"]):
            ids = t.column("context").to_numpy()
            new = np.r_[True, (ids[1:] != ids[:-1]) | (group[1:] != group[:-1])]  # tasks may send the same context
            t, group = t.filter(pa.array(new)), group[new]
            found = repeated_leads(group, *_matrices(t))
            some = np.flatnonzero(found.any(1))
            ids = t.column("context").to_numpy()[some]
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(_runs(found[some]), _RUNS)], ["context", "runs"])

    return contexts.repartition("core").sortWithinPartitions("core", "context").mapInArrow(work, RUNS)


def _counted_repeats(contexts: DataFrame, keep) -> DataFrame:
    """The same for cores of very many contexts, by counting windows across tasks."""

    def windows(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for at in range(0, batch.num_rows, 1000):
            t = batch.slice(at, 1000)
            raw, lead = t.column("bytes").to_pylist(), t.column("lead").to_numpy().astype(np.int64)
            sizes = np.array([len(b) for b in raw])
            base = np.cumsum(sizes) - sizes
            counts = np.maximum(0, np.minimum(lead, sizes - WINDOW) + 1)  # starts that the trigger leads and that fit
            start = np.repeat(base - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
            hashes = RangeHash(np.frombuffer(b"".join(raw), np.uint8))(start, start + WINDOW)
            of = np.repeat(np.arange(len(raw)), counts)
            leads = lead[of] - (start - base[of])
            yield pa.RecordBatch.from_arrays([pa.array(signed(hashes)), pa.array(t.column("context").to_numpy()[of]), pa.array(leads.astype(np.int32))], ["window", "context", "k"])

    each = keep(per_batch(contexts.select("context", "bytes", "lead"), windows, "window long, context long, k int"))
    often = each.groupBy("window").agg(F.count("*").alias("n")).where("n > 1").select("window")
    hit = each.join(keep(often), "window").groupBy("context").agg(F.collect_set("k").alias("ks"))
    return hit.select("context", F.transform("ks", lambda k: F.struct(k.alias("lo"), k.alias("hi"))).alias("runs"))


def _all_spans(docs: DataFrame, keep) -> DataFrame:
    """``id, mark, spans`` (start * 2 ** 32 + end in bytes, not yet joined) of rows ``id, mark, text``; ``keep`` stores steps."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = filter_bits(size // EVERY)
    places = keep(_places(docs, bits))
    lone = places.where("tail < 0")
    often = lone.groupBy("context").agg(F.count("*").alias("n")).where("n > 1").select("context", F.lit(True).alias("whole"), F.lit(None).cast(RUN_LIST).alias("runs"))

    borders = places.where("tail >= 0")
    dictionary = keep(borders.groupBy("context").agg(F.first("core").alias("core"), F.count("*").alias("n")))
    twice = dictionary.where("n > 1").select("context", F.lit(True).alias("whole"), F.lit(None).cast(RUN_LIST).alias("runs"))

    shared = keep(dictionary.groupBy("core").agg(F.count("*").alias("contexts")).where("contexts > 1"))
    few = filter_bits(shared.count())
    cores = (id_filter(shared, "core", few), few)
    crowded = shared.where(F.col("contexts") > HOT_CORE)
    n_hot = crowded.count()
    hot = (id_filter(crowded, "core", filter_bits(n_hot)), filter_bits(n_hot)) if n_hot else None
    runs = _sorted_repeats(_context_bytes(docs, cores, hot))
    if hot:
        contexts = _context_bytes(docs, hot).groupBy("context").agg(F.first("bytes").alias("bytes"), F.first("lead").alias("lead"))
        runs = runs.union(_counted_repeats(contexts, keep))
    # contexts of single borders only: all windows of the others are settled
    once = dictionary.where("n = 1").select("context")
    partly = runs.join(once, "context", "left_semi").select("context", F.lit(False).alias("whole"), "runs")

    lo, hi = F.greatest(F.lit(0), WINDOW - F.col("tail")), F.col("lead")  # the leads of a border's windows that fit
    whole = F.array(F.struct(F.when(F.col("tail") < 0, 0).otherwise(lo).cast("int").alias("lo"), hi.cast("int").alias("hi")))
    found = places.join(keep(often.union(twice).union(partly)), "context")
    found = found.select("id", "mark", "at", F.explode(F.when(F.col("whole"), whole).otherwise(F.col("runs"))).alias("run"))
    start, end = (c.cast("long") for c in (F.col("at") - F.col("run.hi"), F.col("at") - F.col("run.lo") + WINDOW))
    span = F.shiftleft(start, 32).bitwiseOR(end)  # packed: a list of structs takes four times the room
    return found.groupBy("id", "mark").agg(F.collect_set(span).alias("spans"))


def _joined(spans: list[int]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in (divmod(s, 1 << 32) for s in sorted(spans)):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def repeated_spans(docs: DataFrame) -> DataFrame:
    """``id, mark, spans`` (start * 2 ** 32 + end in bytes, ascending and apart) of rows ``id, mark, text`` that hold repeated strings."""

    def join(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        spans = [[(a << 32) + b for a, b in _joined(x)] for x in batch.column("spans").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("mark"), pa.array(spans, pa.list_(pa.int64()))], ["id", "mark", "spans"])

    with scratch(docs.sparkSession) as keep:
        return stored(per_batch(_all_spans(docs, keep), join, "id long, mark long, spans array<long>"))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept`` (the remaining bytes) of every row."""
    # ids may be null or come twice; rows of one id and one text have the same spans
    id_ = F.coalesce(F.col("doc_id").cast("long"), F.lit(-1))
    rows = docs.select(id_.alias("id"), F.xxhash64("text").alias("mark"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    spans = repeated_spans(rows.select("id", "mark", "text").where(F.octet_length("text") >= WINDOW))
    kind = docs.schema["doc_id"].dataType.simpleString()
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
    names, schema = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"], f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary"

    # most texts keep all their bytes: only the others (and rare ones besides) meet their spans in a shuffle
    marks = F.xxhash64("id", "mark")
    bits = filter_bits(spans.count())
    bitmap = id_filter(spans.select(marks.alias("row")), "row", bits)

    def split(touched: bool):
        def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            mine = batch.filter(pa.array(may_hold_ids(bitmap.value, batch.column("row").to_numpy(), bits) == touched))
            if touched:
                yield mine.select(["id", "mark", "doc_id", "text"])
                return
            text = mine.column("text").cast(pa.binary())
            none = pa.array(np.zeros(mine.num_rows, np.int64))
            yield pa.RecordBatch.from_arrays([mine.column("doc_id"), pc.binary_length(text).cast(pa.int64()), none, none, text], names)

        return per_batch(rows.withColumn("row", marks), work, f"id long, mark long, doc_id {kind}, text string" if touched else schema)

    def cut(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            out: tuple[list, ...] = ([], [], [], [])
            for text, spans in zip(part.column("text").to_pylist(), part.column("spans").to_pylist()):
                raw, gone = text.encode(), [divmod(s, 1 << 32) for s in spans or []]
                edges = [0, *[x for s in gone for x in s], len(raw)]
                kept = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2]))
                for o, x in zip(out, (len(raw), len(raw) - len(kept), len(gone), kept)):
                    o.append(x)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(o, t) for o, t in zip(out, kinds))], names)

    joined = split(True).join(spans, ["id", "mark"], "left").select("doc_id", "text", "spans")
    return per_batch(joined, cut, schema).union(split(False))
