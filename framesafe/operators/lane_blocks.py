"""Whole lanes as arrays: replay, fusing, scale and smoothing between one shuffle of what is seen and the lane rows.

A lane has far more frames than detections, so its frames are laid out in the task that computes them and reach Spark as
finished rows. A task reads what is seen of a lane in order of frames, gathers some thousand rows of one lane or of many
(a block) and runs every step on the block. Nothing passes a pinned row: tracks, sizes and smoothing start anew there. So
a long lane is cut at a frame with a single anchor, and its parts come out as the whole would.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.boxes import Box
from .lanes import (
    CENTRE_WEIGHTS,
    GROWTH,
    LOST_GRACE,
    PINNED,
    PREDICTION_CAP,
    SCALE_SOURCES,
    SIZE_WEIGHTS,
    SOURCE_WEIGHTS,
    SPEEDS,
    VELOCITY_ALPHA,
    _Track,
    _step,
)

BLOCK_ROWS = 2_048  # rows of what is seen; each is worth 92 frames at most as long as no signal keeps a track alive
OUT_ROWS = 20_000  # lane rows of an output batch

SINGLE = ["anchor", "tracker+optical", "optical", "tracker+template", "template", "tracker", "global", "predicted"]
SOURCES = [*SINGLE, *(f"{a}|{b}" for a in SINGLE for b in SINGLE)]  # the second half: means of two directions
ANCHOR, PREDICTED = SINGLE.index("anchor"), SINGLE.index("predicted")


class Lanes(NamedTuple):
    """Lane rows of a block in order of (part, frame); one row a frame."""

    part: np.ndarray
    f: np.ndarray
    box: np.ndarray  # (4, rows)
    src: np.ndarray  # index into SOURCES
    conf: np.ndarray


class Block(NamedTuple):
    """What is seen of some lanes, or of a part of one, in order of (part, frame)."""

    keys: list[pa.Array]  # of each part
    part: np.ndarray
    f: np.ndarray
    way: np.ndarray  # of a signal 1 or -1, of an anchor 0
    box: np.ndarray
    source: list | None
    score: list | None
    lo: np.ndarray  # of each part: where the backward run ends
    hi: np.ndarray  # and the forward run
    cut_head: bool  # the first part goes on from a pinned frame that the block before gave out
    cut_tail: bool


class LaneBlocks:
    """Lanes on their way through one Python stage: the rows it reads and the steps so far."""

    def __init__(self, source: DataFrame, keys: Sequence[str], make: Callable | None = None):
        self.source, self.keys, self.make = source, list(keys), make

    def then(self, step: Callable, *others: LaneBlocks) -> LaneBlocks:
        if any(o.source is not self.source for o in others):
            raise ValueError("lanes of different stages")
        return LaneBlocks(self.source, self.keys, partial(_chained, step, [self.make, *(o.make for o in others)]))

    def replay(self, direction: int, fw: float, fh: float) -> LaneBlocks:
        return self.then(partial(replay, direction, fw, fh))

    def fuse(self, backward: LaneBlocks, fw: float, fh: float) -> LaneBlocks:
        return self.then(partial(fuse, fw, fh), backward)

    def stabilize(self, fw: float, fh: float) -> LaneBlocks:
        return self.then(partial(stabilize, fw, fh))

    def smooth(self, alpha: float, fw: float, fh: float) -> LaneBlocks:
        return self.then(partial(smooth, alpha, fw, fh))

    def rows(self) -> DataFrame:
        kinds = {c.name: c.dataType.simpleString() for c in self.source.schema}
        schema = ", ".join(f"`{k}` {kinds[k]}" for k in self.keys) + ", f long, x1 double, y1 double, x2 double, y2 double, src string, conf double"
        return self.source.mapInArrow(partial(_lane_rows, self.make, self.keys), schema)


def _chained(step: Callable, makes: list, block: Block) -> Lanes:
    return step(block, *(m(block) for m in makes if m))  # what is seen makes no lanes yet


# -- reading and writing ---------------------------------------------------------------------


def seen_rows(segments: DataFrame, anchors: DataFrame, signals: DataFrame | None, keys: Sequence[str]) -> LaneBlocks:
    """Rows of what is seen in the segments, one lane after the other; see :func:`lanes.replay_frames`."""
    k = [*keys, "segment"]
    ends = segments.select(*k, F.col("start_frame").cast("long").alias("__lo"), F.col("end_frame").cast("long").alias("__hi"))
    cols = ["f", "seq", *Box._fields]
    rows, order = anchors.select(*k, *cols), ["f", "seq", *Box._fields]
    if signals is not None:
        own = signals.select(*k, "f", F.col("direction").cast("int").alias("__way"), "source", F.col("score").cast("double").alias("score"), *Box._fields)
        rows = rows.withColumn("__way", F.lit(0)).unionByName(own, allowMissingColumns=True)
        order = ["f", F.col("__way") != 0, "__way", "seq", "source", "score", *Box._fields]
    # the window deals lanes out whole, sorts their rows and marks the first
    rows = rows.join(ends, k).withColumn("__n", F.row_number().over(Window.partitionBy(*k).orderBy(*order)))
    extra = [] if signals is None else ["__way", "source", "score"]
    return LaneBlocks(rows.select(*k, "__n", "__lo", "__hi", F.col("f").cast("long").alias("f"), *(F.col(n).cast("double").alias(n) for n in Box._fields), *extra), k)


def _numbers(t: pa.Table, name: str) -> np.ndarray:
    return t.column(name).combine_chunks().to_numpy(zero_copy_only=False)


def _single_anchor(t: pa.Table) -> int | None:
    """First row of the last frame that can cut a lane: it has one anchor, there are anchors before it, and it is not the last, which may go on."""
    f = _numbers(t, "f")
    anchor = _numbers(t, "__way") == 0 if "__way" in t.column_names else np.ones(len(f), bool)
    first = np.flatnonzero(np.r_[True, f[1:] != f[:-1]])
    single = first[np.add.reduceat(anchor, first) == 1]
    single = single[(single > np.argmax(anchor)) & (single < first[-1])]
    return int(single[-1]) if len(single) else None


def _tables(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, bool, bool]]:
    """Tables of whole lanes, or of a part of one, with the marks of :class:`Block`."""
    held, rows, cut, wanted = [], 0, False, BLOCK_ROWS
    for b in batches:
        for at in range(0, b.num_rows, BLOCK_ROWS):
            held.append(b.slice(at, BLOCK_ROWS))
            rows += held[-1].num_rows
            if rows < wanted:
                continue
            t = pa.Table.from_batches(held)
            starts = np.flatnonzero(_numbers(t, "__n") == 1)
            if len(starts) and starts[-1] > 0:
                end = int(starts[-1])
                yield t.slice(0, end), cut, False
                t, cut, wanted = t.slice(end), False, BLOCK_ROWS
            elif (at_frame := _single_anchor(t)) is not None:
                f = _numbers(t, "f")
                yield t.slice(0, int(np.searchsorted(f, f[at_frame], side="right"))), cut, True
                t, cut, wanted = t.slice(at_frame), True, BLOCK_ROWS
            else:
                wanted = 2 * rows  # looked at again when there is twice as much
            held, rows = t.to_batches(), t.num_rows
    if rows:
        yield pa.Table.from_batches(held), cut, False


def _block(t: pa.Table, keys: list[str], cut_head: bool, cut_tail: bool) -> Block:
    first = _numbers(t, "__n") == 1
    first[0] = True
    starts = np.flatnonzero(first)
    signals = "__way" in t.column_names
    way = _numbers(t, "__way") if signals else np.zeros(t.num_rows, np.int32)
    boxes = [t.column(n) for n in Box._fields]
    if any(c.null_count for c in boxes):
        raise ValueError("a box without all its numbers")
    return Block(
        [t.column(k).combine_chunks().take(pa.array(starts)) for k in keys], np.cumsum(first) - 1, _numbers(t, "f"), way,
        np.stack([c.combine_chunks().to_numpy(zero_copy_only=False) for c in boxes]),
        t.column("source").to_pylist() if signals else None, t.column("score").to_pylist() if signals else None,
        _numbers(t, "__lo")[starts], _numbers(t, "__hi")[starts], cut_head, cut_tail,
    )


def _lane_rows(make: Callable, keys: list[str], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = pa.array(SOURCES)
    for t, cut_head, cut_tail in _tables(batches):
        block = _block(t, keys, cut_head, cut_tail)
        out = make(block)
        skip = int(cut_head and len(out.f) > 0)  # the pinned frame that the block before gave out
        for at in range(skip, len(out.f), OUT_ROWS):
            s = slice(at, at + OUT_ROWS)
            part = pa.array(out.part[s])
            cols = [*(c.take(part) for c in block.keys), pa.array(out.f[s]), *(pa.array(np.ascontiguousarray(x[s])) for x in out.box), names.take(pa.array(out.src[s])), pa.array(out.conf[s])]
            yield pa.RecordBatch.from_arrays(cols, names=[*keys, "f", *Box._fields, "src", "conf"])


# -- replay ----------------------------------------------------------------------------------


class _Seen(NamedTuple):
    """Frames with anchors, in order of (part, step); a step is a frame times the direction."""

    part: np.ndarray
    step: np.ndarray
    row: np.ndarray  # of the first anchor
    n: np.ndarray  # anchors
    last: np.ndarray  # step in which the run of the part ends


def _seen(block: Block, way: int) -> _Seen:
    at = np.flatnonzero(block.way == 0)
    part, f = block.part[at], block.f[at]
    first = np.flatnonzero(np.r_[True, (part[1:] != part[:-1]) | (f[1:] != f[:-1])]) if len(at) else at
    part, f, row, n = part[first], f[first], at[first], np.diff(np.r_[first, len(at)])
    if not len(part):
        return _Seen(part, f, row, n, f)
    # a run goes from its first anchor to the end of the segment, or from the last one to the start
    new = np.r_[True, part[1:] != part[:-1]]
    edge = np.flatnonzero(new if way > 0 else np.r_[new[1:], True])
    which = np.cumsum(new) - 1
    end = np.maximum(f[edge], block.hi[part[edge]]) if way > 0 else -np.minimum(f[edge], block.lo[part[edge]])
    if way > 0 and block.cut_tail:
        end[-1] = min(end[-1], f[-1])
    if way < 0 and block.cut_head:
        end[0] = min(end[0], -f[0])
    last, step = end[which], f * way
    keep = np.flatnonzero(step <= last)[::way]
    return _Seen(part[keep], step[keep], row[keep], n[keep], last[keep])


def _state(b: np.ndarray) -> np.ndarray:
    return np.stack([(b[0] + b[2]) / 2, (b[1] + b[3]) / 2, np.maximum(1.0, b[2] - b[0]), np.maximum(1.0, b[3] - b[1])])


def _framed(c: np.ndarray, fw: float, fh: float) -> tuple[np.ndarray, np.ndarray]:
    """Boxes of centres and sizes, and which of them lie in the frame."""
    half_w, half_h = c[2] / 2, c[3] / 2
    b = np.stack([np.maximum(0.0, c[0] - half_w), np.maximum(0.0, c[1] - half_h), np.minimum(fw, c[0] + half_w), np.minimum(fh, c[1] + half_h)])
    return b, (b[2] > b[0]) & (b[3] > b[1])


def _expected(box: np.ndarray, v: np.ndarray, fw: float, fh: float) -> tuple[np.ndarray, np.ndarray]:
    c = _state(box) + v
    c[2:] = np.maximum(8.0, c[2:])
    return _framed(c, fw, fh)


def _limited(b: np.ndarray, ref: np.ndarray, fw: float, fh: float) -> np.ndarray:
    new, old = b[2:] - b[:2], ref[2:] - ref[:2]
    kept = np.clip(new, old / GROWTH, old * GROWTH)
    change = (np.minimum(new, old).min(axis=0) > 0) & (np.abs(kept - new).max(axis=0) >= 1e-3)
    if not change.any():
        return b
    out, ok = _framed(np.stack([(b[0] + b[2]) / 2, (b[1] + b[3]) / 2, *kept]), fw, fh)
    return np.where(change & ok, out, b)


def _eased(new: np.ndarray, prev: np.ndarray, a: np.ndarray | float, s: np.ndarray | float, fw: float, fh: float) -> np.ndarray:
    top = np.array([[fw], [fh]])
    c = a * (new[:2] + new[2:]) / 2 + (1 - a) * (prev[:2] + prev[2:]) / 2
    z = (s * np.maximum(1.0, new[2:] - new[:2]) + (1 - s) * np.maximum(1.0, prev[2:] - prev[:2])) / 2
    lo, hi = np.clip(c - z, 0.0, top), np.clip(c + z, 0.0, top)
    return np.where((hi > lo).all(axis=0), np.vstack([lo, hi]), new)


def _unseen_step(box: np.ndarray, v: np.ndarray, early: bool, fw: float, fh: float) -> tuple[np.ndarray, np.ndarray]:
    """:func:`lanes._step` of many tracks in a frame without anchors and signals: boxes and velocities after it."""
    fused = box
    if early:  # the expected box is the only candidate
        w = SOURCE_WEIGHTS["velocity"]
        lead, known = _expected(box, v, fw, fh)
        mean = _state(lead) * w / w
        half = mean[2:] / 2
        top = np.array([[fw], [fh]])
        lo, hi = np.clip(mean[:2] - half, 0.0, top), np.clip(mean[:2] + half, 0.0, top)
        lead = np.where((hi > lo).all(axis=0), np.vstack([lo, hi]), lead)
        fused = np.where(known, lead, box)
    fused = _limited(fused, box, fw, fh)
    before = _state(box)
    rate = np.hypot(v[0], v[1]) / np.maximum(8.0, np.hypot(before[2], before[3]))
    zoom = np.maximum(np.abs(v[2]) / np.maximum(1.0, before[2]), np.abs(v[3]) / np.maximum(1.0, before[3]))
    a, s = (np.interp(rate, SPEEDS, x) for x in (CENTRE_WEIGHTS, SIZE_WEIGHTS))
    s = np.where(zoom > 0.04, np.minimum(1.0, s + np.minimum(0.25, zoom * 2.5)), s)
    out = _eased(fused, box, a, s, fw, fh)
    return out, VELOCITY_ALPHA * (_state(out) - before) + (1 - VELOCITY_ALPHA) * v


def _fit(b: np.ndarray, ref: np.ndarray) -> np.ndarray:
    """How well anchors continue the expected boxes, as :func:`lanes._step` weighs them."""
    inter = np.maximum(0.0, np.minimum(b[2], ref[2]) - np.maximum(b[0], ref[0])) * np.maximum(0.0, np.minimum(b[3], ref[3]) - np.maximum(b[1], ref[1]))
    area, own = ((x[2] - x[0]) * (x[3] - x[1]) for x in (b, ref))
    whole = area + own - inter
    iou = np.where(whole > 0, inter / np.where(whole > 0, whole, 1.0), 0.0)
    shift = np.hypot((b[0] + b[2] - ref[0] - ref[2]) / 2, (b[1] + b[3] - ref[1] - ref[3]) / 2)
    diag = np.hypot(ref[2] - ref[0], ref[3] - ref[1])
    return iou * 3.2 - shift / np.maximum(1.0, diag) * 1.8 - np.abs(np.log(np.maximum(1.0, area) / np.maximum(1.0, own))) * 0.35


def _pinned_runs(box: np.ndarray, e: _Seen, way: int, fw: float, fh: float) -> Lanes:
    """Tracks that only anchors steer. All stretches between two anchors advance together, one frame a step."""
    if not len(e.part):
        return Lanes(e.part, e.step, np.empty((4, 0)), e.part, np.empty(0))
    same = np.r_[e.part[1:] == e.part[:-1], False]
    until = np.where(same, np.r_[e.step[1:], 0] - 1, e.last)
    after = np.minimum(np.minimum(until, e.last), e.step + LOST_GRACE) - e.step  # frames behind the anchor
    # an anchor of several is chosen by the track that comes to it, if one does
    met = np.r_[False, same[:-1] & (e.step[1:] - e.step[:-1] <= LOST_GRACE + 1)]
    waits = met & (e.n > 1)
    chosen = e.row.copy()
    off = np.cumsum(after + 1) - (after + 1)
    total = int(off[-1] + after[-1] + 1)
    out, done = np.empty((4, total)), np.zeros(total, bool)
    now = np.flatnonzero(~waits)
    while len(now):
        b, v = box[:, chosen[now]], np.zeros((4, len(now)))
        out[:, off[now]], done[off[now]] = b, True
        live = np.arange(len(now))
        for j in range(1, int(after[now].max()) + 1):
            early = j - 1 < PREDICTION_CAP
            if j - 1 == PREDICTION_CAP:
                live = np.arange(len(now))  # a track that stood still may not do so any more
            live = live[after[now[live]] >= j]
            if not len(live):
                if j - 1 < PREDICTION_CAP:
                    continue
                break
            nb, nv = _unseen_step(b[:, live], v[:, live], early, fw, fh)
            moved = ((nb != b[:, live]) | (nv != v[:, live])).any(axis=0)
            b[:, live], v[:, live] = nb, nv
            at = off[now[live]] + j
            out[:, at], done[at] = nb, True
            live = live[moved]
        follow = np.flatnonzero(np.r_[waits[1:], False][now])
        if not len(follow):
            break
        ref, ok = _expected(b[:, follow], v[:, follow], fw, fh)
        ref = np.where(ok, ref, b[:, follow])
        now = now[follow] + 1
        n = e.n[now]
        which = np.repeat(np.arange(len(now)), n)
        rows = np.repeat(e.row[now], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        fit = _fit(box[:, rows], ref[:, which])
        best = np.lexsort((rows, -fit, which))  # the first of equal ones
        chosen[now] = rows[best[np.cumsum(n) - n]]
    at = np.arange(total)
    out = out[:, np.maximum.accumulate(np.where(done, at, 0))]  # a track that stands still keeps its box
    which = np.repeat(np.arange(len(off)), after + 1)
    pinned = at == off[which]
    got = Lanes(e.part[which], (e.step[which] + at - off[which]) * way, out, np.where(pinned, ANCHOR, PREDICTED), np.where(pinned, 1.0, 0.4))
    return got if way > 0 else Lanes(*(x[..., ::-1] for x in got))


def _signal_runs(block: Block, e: _Seen, way: int, fw: float, fh: float) -> Lanes:
    """Tracks with signals, frame by frame."""
    rows = []
    seen = {}
    for p, s, i, n, last in zip(*(x.tolist() for x in e)):
        seen.setdefault(p, (last, {}))[1][s] = ([tuple(block.box[:, r].tolist()) for r in range(i, i + n)], {})
    for i in np.flatnonzero(block.way == way).tolist():
        p, s = int(block.part[i]), int(block.f[i]) * way
        if p in seen and s <= seen[p][0]:
            seen[p][1].setdefault(s, ([], {}))[1][block.source[i]] = (tuple(block.box[:, i].tolist()), float(block.score[i] or 0.0))
    for p, (last, at) in seen.items():
        steps = sorted(at)
        track = _Track(fw, fh)
        for s, until in zip(steps, [*steps[1:], last + 1]):
            while s < until:
                pins, found = at.get(s, ([], {}))
                if track.box is None:
                    if not pins:
                        break
                    track.pin(pins[0])
                    got = (pins[0], "anchor", 1.0)
                else:
                    got = _step(track, pins, found)
                if got is None:  # lost for good; the next anchor starts over
                    track = _Track(fw, fh)
                    break
                rows.append((p, s * way, *got[0], SINGLE.index(got[1]), got[2]))
                s += 1
    m = np.array(rows, float).reshape(-1, 8).T
    return Lanes(m[0].astype(np.int64), m[1].astype(np.int64), m[2:6], m[6].astype(np.int64), m[7])


def replay(way: int, fw: float, fh: float, block: Block) -> Lanes:
    """Tracks of one direction."""
    e = _seen(block, way)
    steered = np.unique(block.part[block.way == way]) if block.source is not None else []
    if not len(steered):
        return _pinned_runs(block.box, e, way, fw, fh)
    mixed = np.isin(e.part, steered)
    both = [_pinned_runs(block.box, _Seen(*(x[~mixed] for x in e)), way, fw, fh), _signal_runs(block, _Seen(*(x[mixed] for x in e)), way, fw, fh)]
    out = Lanes(*(np.concatenate(x, axis=-1) for x in zip(*both)))
    order = np.lexsort((out.f, out.part))
    return Lanes(*(x[..., order] for x in out))


# -- steps on lane rows ----------------------------------------------------------------------


def _among(names: Sequence[str], src: np.ndarray) -> np.ndarray:
    return np.array([n in names for n in SOURCES])[src]


def fuse(fw: float, fh: float, block: Block, a: Lanes, b: Lanes) -> Lanes:
    """:func:`lanes.fuse_lanes`."""
    if not len(a.f) and not len(b.f):
        return a
    order = np.lexsort((np.r_[a.f, b.f], np.r_[a.part, b.part]))
    part, f = np.r_[a.part, b.part][order], np.r_[a.f, b.f][order]
    first = np.r_[True, (part[1:] != part[:-1]) | (f[1:] != f[:-1])]
    place = np.empty(len(order), np.int64)
    place[order] = np.cumsum(first) - 1
    part, f = part[first], f[first]
    n, at_a, at_b = len(f), place[: len(a.f)], place[len(a.f) :]
    ia, ib = np.full(n, -1), np.full(n, -1)
    ia[at_a], ib[at_b] = np.arange(len(a.f)), np.arange(len(b.f))
    from_a = ia >= 0
    box, src, conf = np.empty((4, n)), np.empty(n, np.int64), np.empty(n)
    box[:, at_b], src[at_b], conf[at_b] = b.box, b.src, b.conf
    box[:, at_a], src[at_a], conf[at_a] = a.box, a.src, a.conf
    both = np.flatnonzero(from_a & (ib >= 0))
    xa, xb = ia[both], ib[both]
    sa, sb, ca, cb = a.src[xa], b.src[xb], a.conf[xa], b.conf[xb]
    pin_a, pin_b = _among(PINNED, sa), _among(PINNED, sb)
    keep = (pin_a & ~pin_b) | (pin_a & pin_b & (ca >= cb))
    other = ~keep & ((pin_b & ~pin_a) | (pin_a & pin_b & (ca < cb)))
    wa, wb = np.maximum(0.05, ca), np.maximum(0.05, cb)
    top = np.array([[fw], [fh], [fw], [fh]])
    mean = np.maximum(0.0, np.minimum((a.box[:, xa] * wa + b.box[:, xb] * wb) / (wa + wb), top))
    blend = ~keep & ~other & (mean[2] > mean[0]) & (mean[3] > mean[1])
    box[:, both[other]], src[both[other]], conf[both[other]] = b.box[:, xb[other]], sb[other], cb[other]
    box[:, both[blend]], conf[both[blend]] = mean[:, blend], np.minimum(0.99, np.maximum(wa, wb)[blend])
    src[both[blend]] = len(SINGLE) * (1 + sa[blend]) + sb[blend]
    return Lanes(part, f, box, src, conf)


def stabilize(fw: float, fh: float, block: Block, x: Lanes) -> Lanes:
    """:func:`lanes.stabilize_scale`."""
    n = len(x.f)
    if not n:
        return x
    at = np.arange(n)
    ref = _among(SCALE_SOURCES, x.src)
    head = np.r_[True, x.part[1:] != x.part[:-1]]
    tail = np.r_[head[1:], True]
    begin = np.maximum.accumulate(np.where(head, at, 0))
    end = np.minimum.accumulate(np.where(tail, at, n)[::-1])[::-1]
    left = np.maximum.accumulate(np.where(ref, at, -1))
    right = np.minimum.accumulate(np.where(ref, at, n)[::-1])[::-1]
    count = np.cumsum(ref)
    refs = count[end] - count[begin] + ref[begin]
    if block.cut_head:  # the rest of the lane has references too
        refs = np.where(x.part == x.part[0], np.maximum(refs, 2), refs)
    if block.cut_tail:
        refs = np.where(x.part == x.part[-1], np.maximum(refs, 2), refs)
    change = np.flatnonzero((refs >= 2) & ~_among(PINNED, x.src))
    left, right, no_left, no_right = left[change], right[change], left[change] < begin[change], right[change] > end[change]
    left, right = np.where(no_left, right, left), np.where(no_right, left, right)
    size = np.maximum(0.0, x.box[2:] - x.box[:2])
    share = (x.f[change] - x.f[left]) / np.maximum(1, x.f[right] - x.f[left])
    wh = np.where(left == right, size[:, left], size[:, left] * (1 - share) + size[:, right] * share)
    b = x.box[:, change]
    c, top = (b[:2] + b[2:]) / 2.0, np.array([[fw], [fh]])
    lo, hi = np.maximum(0.0, c - wh / 2), np.minimum(top, c + wh / 2)
    ok = (wh > 0).all(axis=0) & (hi > lo).all(axis=0)
    box = x.box.copy()
    box[:, change[ok]] = np.vstack([lo, hi])[:, ok]
    return x._replace(box=box)


def _smoothed(box: np.ndarray, starts: np.ndarray, a: float, s: float, fw: float, fh: float) -> np.ndarray:
    """Smoothing inside runs; all runs advance one row a step, and the long ones come first."""
    if a >= 0.999 and s >= 0.999:
        return box
    first = np.flatnonzero(starts)
    size = np.diff(np.r_[first, box.shape[1]])
    order = np.argsort(-size, kind="stable")
    first, size = first[order], size[order]
    out = box.copy()
    left = np.searchsorted(-size, -np.arange(1, int(size.max(initial=1))), side="left")  # runs with more than j rows
    prev = box[:, first]
    for j, n in enumerate(left.tolist(), 1):
        at = first[:n] + j
        prev = _eased(box[:, at], prev[:, :n], a, s, fw, fh)
        out[:, at] = prev
    return out


def smooth(alpha: float, fw: float, fh: float, block: Block, x: Lanes) -> Lanes:
    """:func:`lanes.smooth_bidirectional`."""
    if not len(x.f):
        return x
    a, s = (min(1.0, max(0.0, v)) for v in (alpha, alpha * 0.7))
    pinned = _among(PINNED, x.src)
    other = x.part[1:] != x.part[:-1]
    box = _smoothed(x.box, pinned | np.r_[True, other], a, s, fw, fh)
    back = (pinned | np.r_[other, True])[::-1]
    return x._replace(box=_smoothed(np.ascontiguousarray(box[:, ::-1]), back, a, s, fw, fh)[:, ::-1])
