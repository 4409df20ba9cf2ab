"""Per-frame lanes: fusing directions, scale, smoothing, velocity, anchors, memory, track replay.

A lane row is ``(keys…, f, x1, y1, x2, y2, src, conf)``. Recursive rules (exponential smoothing, track
replay) run over rows that Spark has partitioned and sorted; a task streams through its rows and
holds one state, so a long lane needs no more memory than a short one. Replay, fusing, scale, smoothing
and output also take lanes as :class:`LaneBlocks` and then run one after the other in one Python stage.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from typing import TYPE_CHECKING

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import boxes as B
from ..functions.boxes import Box, box, box_of
from ..functions.scalars import null_safe_hash
from ..session import spread
from . import scans

if TYPE_CHECKING:
    from .lane_blocks import LaneBlocks

# Fixed values.
PINNED = ["anchor", "verified"]
SCALE_SOURCES = [*PINNED, "head_fallback"]
VELOCITY_ALPHA = 0.45
PREDICTION_CAP = 30
LOST_GRACE = 45
SOURCE_WEIGHTS = {"optical": 3.4, "template": 2.15, "tracker": 2.2, "global": 1.1, "velocity": 0.7}
LANE_CHUNK = 15_000  # frames per chunk of a scan, ten minutes at 25 fps


def is_pinned(src: Column | str) -> Column:
    c = F.col(src) if isinstance(src, str) else src
    return F.coalesce(c.isin(PINNED), F.lit(False))


# -- directions and scale --------------------------------------------------------------------


def fuse_lanes(fwd: DataFrame | LaneBlocks, bwd: DataFrame | LaneBlocks, keys: Sequence[str], fw: float, fh: float) -> DataFrame | LaneBlocks:
    """Forward and backward lanes into one: a pinned side wins, two pinned sides by confidence, else the
    confidence-weighted mean."""
    if not isinstance(fwd, DataFrame):
        return fwd.fuse(bwd, fw, fh)
    cols = ["x1", "y1", "x2", "y2", "src", "conf"]
    a = fwd.select(*keys, "f", F.struct(*cols).alias("a"))
    b = bwd.select(*keys, "f", F.struct(*cols).alias("b"))
    j = a.join(b, [*keys, "f"], "full_outer")
    ba, bb = box_of("a"), box_of("b")
    pa, pb = is_pinned(F.col("a.src")), is_pinned(F.col("b.src"))
    ca, cb = F.coalesce("a.conf", F.lit(0.0)), F.coalesce("b.conf", F.lit(0.0))
    wa, wb = F.greatest(F.lit(0.05), ca), F.greatest(F.lit(0.05), cb)
    mean = Box(*((x * wa + y * wb) / (wa + wb) for x, y in zip(ba, bb)))
    mean = B.clamp_box(mean, fw, fh)
    take_a = F.col("b").isNull() | (pa & ~pb) | (pa & pb & (ca >= cb))
    take_b = F.col("a").isNull() | (pb & ~pa) | (pa & pb & (ca < cb))
    blended = F.struct(
        *mean.columns(),
        F.concat_ws("|", F.coalesce("a.src", F.lit("?")), F.coalesce("b.src", F.lit("?"))).alias("src"),
        F.least(F.lit(0.99), F.greatest(wa, wb)).alias("conf"),
    )
    out = F.when(take_a, F.col("a")).when(take_b, F.col("b")).when(B.is_valid(mean), blended).otherwise(F.col("a"))
    return j.select(*keys, "f", out.alias("o")).select(*keys, "f", "o.*")


def stabilize_scale(lane: DataFrame | LaneBlocks, keys: Sequence[str], fw: float, fh: float) -> DataFrame | LaneBlocks:
    """Sizes between scale references are interpolated in frame; centres stay; pinned rows stay.

    Before the first and after the last reference the nearest size is used. Lanes with fewer than two
    references are left alone.
    """
    if not isinstance(lane, DataFrame):
        return lane.stabilize(fw, fh)
    ref = F.when(F.col("src").isin(SCALE_SOURCES), F.struct("f", B.width(box()).alias("w"), B.height(box()).alias("h")))
    specs = {"__l": scans.last(ref), "__r": scans.following(ref), "__refs": scans.total(F.col("src").isin(SCALE_SOURCES))}
    j = scans.scan(lane, keys, ["f"], LANE_CHUNK, specs)
    left, right = F.col("__l"), F.col("__r")
    share = (F.col("f") - left["f"]) / F.greatest(F.lit(1), right["f"] - left["f"])

    def size(n: str) -> Column:
        between = left[n] * (1 - share) + right[n] * share
        return F.when(left.isNull(), right[n]).when(right.isNull(), left[n]).when(left["f"] == right["f"], left[n]).otherwise(between)

    # step by step, so that every value is computed once
    j = j.withColumns({"__w": size("w"), "__h": size("h")})
    cx, cy = B.box_center(box())
    w, h = F.col("__w"), F.col("__h")
    new = Box(
        F.greatest(F.lit(0.0), cx - w / 2),
        F.greatest(F.lit(0.0), cy - h / 2),
        F.least(F.lit(float(fw)), cx + w / 2),
        F.least(F.lit(float(fh)), cy + h / 2),
    )
    j = j.withColumns({f"__n_{n}": c for n, c in zip(Box._fields, new)})
    change = (F.col("__refs") >= 2) & ~is_pinned("src") & (w > 0) & (h > 0) & B.is_valid(box("__n_"))
    j = j.withColumn("__ok", F.coalesce(change, F.lit(False)))
    out = B.choose(F.col("__ok"), box("__n_"), box())
    return j.withColumns(dict(zip(Box._fields, out))).select(*lane.columns)


# -- smoothing -------------------------------------------------------------------------------


def _blend(new: np.ndarray, prev: np.ndarray, a: np.ndarray, s: np.ndarray, fw, fh) -> np.ndarray:
    """One smoothing step for many rows at once; rows that would vanish keep their new box."""
    c0, c1 = (new[:, :2] + new[:, 2:]) / 2, (prev[:, :2] + prev[:, 2:]) / 2
    s0, s1 = np.maximum(1.0, new[:, 2:] - new[:, :2]), np.maximum(1.0, prev[:, 2:] - prev[:, :2])
    c = a[:, None] * c0 + (1 - a[:, None]) * c1
    z = s[:, None] * s0 + (1 - s[:, None]) * s1
    top = np.array([fw, fh], dtype=float)
    lo, hi = np.clip(c - z / 2, 0, top), np.clip(c + z / 2, 0, top)
    ok = (hi > lo).all(axis=1) & ~((a >= 0.999) & (s >= 0.999))
    return np.where(ok[:, None], np.hstack([lo, hi]), new)


def smooth_runs(boxes: np.ndarray, starts: np.ndarray, a: np.ndarray, s: np.ndarray, fw: float, fh: float) -> np.ndarray:
    """Exponential smoothing inside runs. All runs of a batch advance one row per step."""
    out = boxes.copy()
    pos = np.arange(len(boxes))
    pos = pos - np.maximum.accumulate(np.where(starts, pos, 0))
    by_step = np.argsort(pos, kind="stable")
    bounds = np.searchsorted(pos[by_step], np.arange(1, pos.max(initial=0) + 2))
    for lo, hi in zip(bounds[:-1], bounds[1:]):
        i = by_step[lo:hi]
        out[i] = _blend(boxes[i], out[i - 1], a[i], s[i], fw, fh)
    return out


def fading_rows(alpha: float) -> int:
    """After how many rows the weight of what came before is below e^-40."""
    return max(1, math.ceil(40.0 / -math.log(max(1.0 - alpha, 1e-12))))


def ema_boxes(df: DataFrame, keys: Sequence[str], alpha: Column | float, size_alpha: Column | float | None = None,
              fw: float = 1920, fh: float = 1080, order: str = "f", descending: bool = False,
              run: str | None = None) -> DataFrame:
    """Smooth the boxes of each key (and run) along ``order``; the first row of a run keeps its box.

    With fixed alphas above zero, a run is cut into stretches that are smoothed apart, each after a warm-up by the
    rows before it, as many as it takes for the box before them to fade below e^-40: one lane is spread over tasks.
    Alphas by row may be zero and keep a box for ever, so a run stays one stretch then.
    """
    group = [*keys, run] if run else list(keys)
    fixed = [x for x in (alpha, alpha if size_alpha is None else size_alpha) if not isinstance(x, Column)]
    a = alpha if isinstance(alpha, Column) else F.lit(float(alpha))
    s = a if size_alpha is None else (size_alpha if isinstance(size_alpha, Column) else F.lit(float(size_alpha)))
    cols = df.columns
    src = df.withColumns({"__a": a.cast("double"), "__s": s.cast("double"), "__k": F.struct(*group)})
    for n in Box._fields:
        src = src.withColumn(n, F.col(n).cast("double"))
    if len(fixed) == 2 and min(fixed) >= 0.01:
        warm = fading_rows(min(fixed))
        size = 8 * warm
        src = scans.scan(src, ["__k"], [order], LANE_CHUNK, {"__n": scans.count_so_far(F.lit(True)), "__all": scans.total(F.lit(True))})
        nth = F.col("__all") - F.col("__n") if descending else F.col("__n") - 1
        own = F.floor(nth / size)
        parts = F.when(nth % size >= size - warm, F.array(own, own + 1)).otherwise(F.array(own))
        src = src.withColumn("__own", own).withColumn("__part", F.explode(parts)).withColumn("__warm", F.col("__part") != F.col("__own"))
    else:
        src = src.withColumns({"__part": F.lit(0).cast("long"), "__warm": F.lit(False)})
    src = src.withColumn("__g", null_safe_hash("__part", *group))
    way = F.col(order).desc() if descending else F.col(order).asc()
    parted = spread(src.select(*cols, "__a", "__s", "__g", "__part", "__warm"), *group, "__part").sortWithinPartitions(*group, "__part", way)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last_g, last_box = None, None
        for b in batches:
            if not len(b):
                continue
            g, x = b["__g"].to_numpy(), b[list(Box._fields)].to_numpy(dtype=float)
            starts = np.r_[True, g[1:] != g[:-1]]
            av, sv = np.clip(b["__a"].to_numpy(float), 0, 1), np.clip(b["__s"].to_numpy(float), 0, 1)
            if last_g is not None and g[0] == last_g:  # the run goes on from the batch before
                starts[0] = False
                x, starts = np.vstack([last_box, x]), np.r_[True, starts]
                y = smooth_runs(x, starts, np.r_[1.0, av], np.r_[1.0, sv], fw, fh)[1:]
            else:
                y = smooth_runs(x, starts, av, sv, fw, fh)
            last_g, last_box = g[-1], y[-1]
            b[list(Box._fields)] = y
            yield b[~b["__warm"].to_numpy(bool)][cols]

    schema = src.select(*cols).schema
    return parted.mapInPandas(scan, schema)


def smooth_bidirectional(lane: DataFrame | LaneBlocks, keys: Sequence[str], alpha: float = 0.6, fw: float = 1920, fh: float = 1080) -> DataFrame | LaneBlocks:
    """Forward then backward smoothing that never moves pinned rows; runs restart at every pinned row."""
    if not isinstance(lane, DataFrame):
        return lane.smooth(alpha, fw, fh)
    pinned = is_pinned("src")
    ahead = scans.scan(lane, keys, ["f"], LANE_CHUNK, {"__pins": scans.count_so_far(pinned)})
    # backward runs end with the pinned row that opens them, so they count pins before the row
    ahead = ahead.withColumn("__back", F.col("__pins") - F.when(pinned, 1).otherwise(0))
    fwd = ema_boxes(ahead, keys, alpha, alpha * 0.7, fw, fh, run="__pins")
    out = ema_boxes(fwd, keys, alpha, alpha * 0.7, fw, fh, descending=True, run="__back")
    return out.select(*lane.columns)


# -- velocity --------------------------------------------------------------------------------


def velocities(df: DataFrame, keys: Sequence[str], order: str = "f", alpha: float = VELOCITY_ALPHA) -> DataFrame:
    """Smoothed velocity of (cx, cy, w, h) plus motion rate and scale-change strength; frames of a key differ.

    The first row of a key has velocity zero. The recurrence ``v = alpha * step + (1 - alpha) * v`` is linear, so it is
    a running sum of steps weighted by powers, over stretches of rows that are long enough for what came before a
    stretch to have faded below the precision of doubles, plus the faded end of the stretch before. A lane is so
    spread over tasks, and nothing leaves the JVM.
    """
    names, cols = ("cx", "cy", "w", "h"), df.columns
    fade = 1.0 - alpha
    size = fading_rows(alpha)
    st = B.box_state(box())
    src = df.withColumns({"__g": F.struct(*keys), "__s": F.struct(*(st[n].cast("double").alias(n) for n in names))})
    spec = {"__p": scans.last(F.col("__s"), current=False), "__n": scans.count_so_far(F.lit(True))}
    src = scans.scan(src, ["__g"], [order], LANE_CHUNK, spec)
    src = src.withColumns({"__part": F.floor((F.col("__n") - 1) / size), "__at": (F.col("__n") - 1) % size})
    so_far = Window.partitionBy("__g", "__part").orderBy("__n").rowsBetween(Window.unboundedPreceding, 0)
    step = lambda n: F.coalesce(F.col(f"__s.{n}") - F.col(f"__p.{n}"), F.lit(0.0))
    local = {f"__{n}": alpha * F.pow(F.lit(fade), F.col("__at")) * F.sum(step(n) * F.pow(F.lit(fade), -F.col("__at"))).over(so_far) for n in names}
    src = src.withColumns(local)
    ends = src.where(F.col("__at") == size - 1).select("__g", (F.col("__part") + 1).alias("__part"), F.struct(*(F.col(f"__{n}").alias(n) for n in names)).alias("__e"))
    src = src.join(ends, ["__g", "__part"], "left")
    left = F.pow(F.lit(fade), F.col("__at") + 1)
    out = src.select(*cols, *((F.col(f"__{n}") + left * F.coalesce(F.col(f"__e.{n}"), F.lit(0.0))).alias(f"v{n}") for n in names))
    w, h = B.width(box()), B.height(box())
    diag = F.greatest(F.lit(8.0), F.hypot(F.greatest(w, F.lit(1.0)), F.greatest(h, F.lit(1.0))))
    zoom = F.greatest(F.abs("vw") / F.greatest(F.lit(1.0), w), F.abs("vh") / F.greatest(F.lit(1.0), h))
    return out.withColumns({"motion_rate": F.hypot("vcx", "vcy") / diag, "zoom": zoom})


def predict(df: DataFrame, steps: Column | int, fw: float, fh: float) -> DataFrame:
    """Boxes moved on by their velocity for some frames; sizes never below 8."""
    n = steps if isinstance(steps, Column) else F.lit(steps)
    n = F.greatest(F.lit(0), n)
    cx, cy = B.box_center(box())
    w = F.greatest(F.lit(8.0), B.width(box()) + F.col("vw") * n)
    h = F.greatest(F.lit(8.0), B.height(box()) + F.col("vh") * n)
    out = B.state_box(cx + F.col("vcx") * n, cy + F.col("vcy") * n, w, h, fw, fh)
    return df.withColumns({f"p_{k}": c for k, c in zip(Box._fields, out)})


# -- memory and anchors ----------------------------------------------------------------------


def preserve_memory(boxes: DataFrame, frames: DataFrame, keys: Sequence[str], fw: float, fh: float, grace: int = 18,
                    per_frame: float = 0.035, cap: float = 0.85) -> DataFrame:
    """Preserve boxes for every frame: the frame's own, else the last ones carried up to ``grace`` frames
    and grown with their age. Adds ``age`` (0 for own boxes)."""
    own = boxes.select(*keys, F.col("f").alias("__from")).distinct()
    spread = own.select(*keys, "__from", F.explode(F.sequence(F.col("__from"), F.col("__from") + grace)).alias("f"))
    newest = spread.groupBy(*keys, "f").agg(F.max("__from").alias("__from"))
    near = newest.join(frames.select(*keys, "f"), [*keys, "f"], "left_semi").withColumn("age", F.col("f") - F.col("__from"))
    src = boxes.select(*keys, F.col("f").alias("__from"), *Box._fields)
    j = near.select(*keys, "f", "age", "__from").join(src, [*keys, "__from"])
    factor = F.least(F.lit(cap), F.greatest(F.lit(1), F.col("age")) * per_frame) + 1.0
    grown = B.box_expand(box(), factor, fw, fh)
    out = B.choose(F.col("age") == 0, box(), grown)
    return j.select(*keys, "f", "age", *out.columns())


def continuity_score(b: Box, ref: Box) -> Column:
    return B.box_iou(b, ref) * 3.2 - B.center_ratio(b, ref) * 1.8 - B.log_area_gap(b, ref) * 0.35


def choose_anchor(anchors: DataFrame, refs: DataFrame, keys: Sequence[str], seq: str = "seq") -> DataFrame:
    """One anchor per frame: the best continuation of the reference box, the first without a reference."""
    r = refs.select(*keys, *(F.col(n).alias(f"__r_{n}") for n in Box._fields))
    j = anchors.join(r, list(keys), "left")
    score = F.when(F.col("__r_x1").isNotNull(), continuity_score(box(), box("__r_"))).otherwise(0.0)
    best = j.groupBy(*keys).agg(F.max(F.struct(score.alias("score"), (-F.col(seq)).alias("first"), *Box._fields)).alias("m"))
    return best.select(*keys, (-F.col("m.first")).alias(seq), *(F.col(f"m.{n}").alias(n) for n in Box._fields))


def without_nulls(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows that have all of ``cols``. One filter each: what was filtered before is recognised, unlike with ``dropna``."""
    for c in cols:
        df = df.where(F.col(c).isNotNull())
    return df


def choose_seed(anchors: DataFrame, keys: Sequence[str], refs: DataFrame | None = None, forward: bool = True,
                seq: str = "seq") -> DataFrame:
    """The anchor a track starts from: at the first (last) anchor frame of the key, the candidate that fits
    the anchors of the next three anchor frames, and the reference box, best on average.

    ``anchors``: keys, ``f``, ``seq``, box. Ties go to the smaller ``seq``.
    """
    k = list(keys)
    known = without_nulls(anchors.select(*k, "f", seq, *Box._fields), [*k, "f"])
    # the four outermost frames; Spark cuts the rows to them before it deals them out by key
    nth = F.dense_rank().over(Window.partitionBy(*k).orderBy(F.col("f").asc() if forward else F.col("f").desc()))
    outer = known.withColumn("__nth", nth).where(F.col("__nth") <= 4)
    nb = outer.where(F.col("__nth") > 1).select(*k, F.col("f").alias("__nf"), F.col(seq).alias("__ns"),
                                                *(F.col(n).alias(f"__n_{n}") for n in Box._fields))
    c = outer.where((F.col("__nth") == 1) & F.col(seq).isNotNull()).drop("__nth").withColumns({"__fit": F.lit(0.0), "__has": F.lit(0)})
    b, n = box(), box("__n_")
    if refs is not None:
        c = c.drop("__fit", "__has").join(refs.select(*k, *(F.col(x).alias(f"__r_{x}") for x in Box._fields)), k, "left")
        ref = box("__r_")
        fit = B.box_iou(b, ref) * 4.0 - B.center_ratio(b, ref) * 1.55 - B.log_area_gap(b, ref) * 0.3
        has = ref.x1.isNotNull()
        c = c.withColumns({"__fit": F.when(has, fit).otherwise(0.0), "__has": F.when(has, 1).otherwise(0)})
    pair = c.join(nb, k, "left")
    # the neighbour a candidate would pick in that frame; alone in its frame it needs no score
    chosen = pair.groupBy(*k, seq, "__nf").agg(
        F.max(F.struct(continuity_score(n, b).alias("c"), (-F.col("__ns")).alias("first"),
                       (B.box_iou(b, n) * 2.6 - B.box_center_dist(b, n) / F.greatest(B.box_diag(b), F.lit(1.0))).alias("s"))).alias("m"),
        F.max(F.struct("__fit", "__has", "f", *Box._fields)).alias("own"),
    )
    scored = chosen.groupBy(*k, seq).agg(
        F.sum(F.when(F.col("__nf").isNotNull(), F.col("m.s")).otherwise(0.0)).alias("__s"),
        F.count("__nf").alias("__n"),
        F.max("own").alias("own"),
    )
    n, s = F.col("__n") + F.col("own.__has"), F.col("__s") + F.col("own.__fit")
    mean = F.when(n > 0, s / n).otherwise(F.lit(0.0))
    top = scored.groupBy(*k).agg(F.max(F.struct(mean.alias("score"), (-F.col(seq)).alias("first"), "own.f", *(f"own.{x}" for x in Box._fields))).alias("m"))
    return top.select(*k, F.col("m.f").alias("f"), (-F.col("m.first")).alias(seq), *(F.col(f"m.{x}").alias(x) for x in Box._fields))


def lane_confidence(optical: Column, template: Column, tracker: Column, global_: Column) -> Column:
    """``struct(src, conf)`` from the signals present in a frame."""
    pick = lambda s, c: F.struct(F.lit(s).alias("src"), F.lit(c).alias("conf"))
    return (
        F.when(optical & tracker, pick("tracker+optical", 0.92))
        .when(optical, pick("optical", 0.85))
        .when(template & tracker, pick("tracker+template", 0.83))
        .when(template, pick("template", 0.76))
        .when(tracker, pick("tracker", 0.78))
        .when(global_, pick("global", 0.55))
        .otherwise(pick("predicted", 0.4))
    )


def verified_confidence(src: Column, conf: Column, similarity: Column, agrees: Column, has_signal: Column) -> Column:
    """Upgrade of a frame whose identity was verified: ``struct(src, conf)``."""
    sure = similarity >= 0.45
    weak = ~has_signal | (conf < 0.62) | src.isin("predicted", "global")
    up = lambda s, c: F.struct(s.alias("src"), F.greatest(conf, c).alias("conf"))
    return (
        F.when(agrees, up(F.lit("motion_verified"), F.when(sure, 0.93).otherwise(0.89)))
        .when(weak, up(F.when(sure, F.lit("verified")).otherwise(F.lit("motion_verified")), F.lit(0.91)))
        .otherwise(up(F.concat(src, F.lit("+identity_guard")), F.lit(0.86)))
    )


# -- track replay ----------------------------------------------------------------------------


class _Track:
    """State of one track during replay: box, velocity, time since a measurement."""

    def __init__(self, fw: float, fh: float):
        self.fw, self.fh = fw, fh
        self.box: tuple[float, ...] | None = None
        self.v = (0.0, 0.0, 0.0, 0.0)
        self.unseen = 0
        self.still: bool | None = None  # set while a step without a measurement changes neither box nor velocity: before the cap or after it

    def pin(self, b: tuple[float, ...]) -> None:
        self.box, self.v, self.unseen, self.still = b, (0.0, 0.0, 0.0, 0.0), 0, None

    def state(self) -> tuple[float, float, float, float]:
        x1, y1, x2, y2 = self.box
        return (x1 + x2) / 2, (y1 + y2) / 2, max(1.0, x2 - x1), max(1.0, y2 - y1)

    def expected(self) -> tuple[float, ...] | None:
        cx, cy, w, h = self.state()
        w, h = max(8.0, w + self.v[2]), max(8.0, h + self.v[3])
        return _frame_box(cx + self.v[0], cy + self.v[1], w, h, self.fw, self.fh)


def _frame_box(cx, cy, w, h, fw, fh):
    b = (max(0.0, cx - w / 2), max(0.0, cy - h / 2), min(fw, cx + w / 2), min(fh, cy + h / 2))
    return b if b[2] > b[0] and b[3] > b[1] else None


def _iou(a, b) -> float:
    iw, ih = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    inter = max(0.0, iw) * max(0.0, ih)
    area = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - inter
    return inter / area if area > 0 else 0.0


def _shift(a, b) -> float:
    return math.hypot((a[0] + a[2] - b[0] - b[2]) / 2, (a[1] + a[3] - b[1] - b[3]) / 2)


def _diag(a) -> float:
    return math.hypot(a[2] - a[0], a[3] - a[1])


def _fuse(cands: list[tuple[tuple[float, ...], float]], fw: float, fh: float):
    """Weighted mean state of the boxes that agree with the heaviest one."""
    if not cands:
        return None
    lead = max(cands, key=lambda c: c[1])[0]
    reach = max(1.0, _diag(lead)) * 0.7
    near = [(b, w) for b, w in cands if b == lead or _iou(b, lead) >= 0.18 or _shift(b, lead) <= reach]
    total = sum(w for _, w in near)
    cx = sum((b[0] + b[2]) / 2 * w for b, w in near) / total
    cy = sum((b[1] + b[3]) / 2 * w for b, w in near) / total
    w, h = (sum(max(1.0, b[i + 2] - b[i]) * x for b, x in near) / total for i in (0, 1))
    out = (min(max(cx - w / 2, 0.0), fw), min(max(cy - h / 2, 0.0), fh), min(max(cx + w / 2, 0.0), fw), min(max(cy + h / 2, 0.0), fh))
    return out if out[2] > out[0] and out[3] > out[1] else lead


def _ease(new, prev, a: float, s: float, fw: float, fh: float):
    """One smoothing step on plain numbers; a box that would vanish stays new."""
    lo, hi = [0.0, 0.0], [0.0, 0.0]
    for i, top in ((0, fw), (1, fh)):
        c = a * (new[i] + new[i + 2]) / 2 + (1 - a) * (prev[i] + prev[i + 2]) / 2
        z = s * max(1.0, new[i + 2] - new[i]) + (1 - s) * max(1.0, prev[i + 2] - prev[i])
        lo[i], hi[i] = min(max(c - z / 2, 0.0), top), min(max(c + z / 2, 0.0), top)
    return (lo[0], lo[1], hi[0], hi[1]) if hi[0] > lo[0] and hi[1] > lo[1] else new


# A box may grow or shrink by 7.5 % a frame; the weights of a new centre and a new size fall
# between two speeds (in diagonals a frame); the trust in a tracker's box falls between two ratios of areas.
GROWTH = 1.075
SPEEDS, CENTRE_WEIGHTS, SIZE_WEIGHTS = (0.012, 0.06), (0.62, 0.36), (0.42, 0.24)
AREA_RATIOS, TRUST = (1.25, 2.0), (1.0, 0.4)


def _sizes(*boxes) -> np.ndarray:
    """Width and height of each box."""
    b = np.asarray(boxes, float)
    return b[:, 2:] - b[:, :2]


def _limit_scale(b, ref, fw, fh):
    new, old = _sizes(b, ref)
    kept = np.clip(new, old / GROWTH, old * GROWTH)
    if min(new.min(), old.min()) <= 0 or np.abs(kept - new).max() < 1e-3:
        return b
    return _frame_box((b[0] + b[2]) / 2, (b[1] + b[3]) / 2, *kept.tolist(), fw, fh) or b


def _lock_alphas(rate: float, zoom: float) -> tuple[float, float]:
    centre, size = (float(np.interp(rate, SPEEDS, w)) for w in (CENTRE_WEIGHTS, SIZE_WEIGHTS))
    return centre, min(1.0, size + min(0.25, zoom * 2.5)) if zoom > 0.04 else size


def _penalty(tracker, other) -> float:
    areas = _sizes(tracker, other).prod(1)
    return float(np.interp(areas.max() / areas.min(), AREA_RATIOS, TRUST)) if areas.min() > 0 else 1.0


def _step(t: _Track, anchors, signals: dict) -> tuple[tuple[float, ...], str, float] | None:
    """Advance a track by one frame; None ends it."""
    if anchors:
        ref = t.expected() or t.box
        best = max(anchors, key=lambda a: _iou(a, ref) * 3.2 - _shift(a, ref) / max(1.0, _diag(ref)) * 1.8
                   - abs(math.log(max(1.0, (a[2] - a[0]) * (a[3] - a[1])) / max(1.0, (ref[2] - ref[0]) * (ref[3] - ref[1])))) * 0.35) if len(anchors) > 1 else anchors[0]
        t.pin(best)
        return best, "anchor", 1.0
    if t.unseen >= LOST_GRACE:
        return None
    early = t.unseen < PREDICTION_CAP
    if not signals and t.still is early:
        t.unseen += 1
        return t.box, "predicted", 0.4
    opt, tem, tra, glo = (signals.get(s) for s in ("optical", "template", "tracker", "global"))
    measured = any(x is not None for x in (opt, tem, tra, glo))
    expected = t.expected()
    cands = []
    if opt:
        cands.append((opt[0], SOURCE_WEIGHTS["optical"]))
    if tem:
        cands.append((tem[0], SOURCE_WEIGHTS["template"] * max(0.5, tem[1])))
    if tra:
        other = opt or tem
        cands.append((tra[0], SOURCE_WEIGHTS["tracker"] * (_penalty(tra[0], other[0]) if other else 1.0)))
    if glo and glo[1] >= 0.14:
        cands.append((glo[0], SOURCE_WEIGHTS["global"] + glo[1]))
    if expected is not None and (measured or early):
        cands.append((expected, SOURCE_WEIGHTS["velocity"]))
    fused = _limit_scale(_fuse(cands, t.fw, t.fh) or t.box, t.box, t.fw, t.fh)
    before = t.state()
    rate = math.hypot(t.v[0], t.v[1]) / max(8.0, math.hypot(before[2], before[3]))
    zoom = max(abs(t.v[2]) / max(1.0, before[2]), abs(t.v[3]) / max(1.0, before[3]))
    a, s = _lock_alphas(rate, zoom)
    was, out = t.box, _ease(fused, t.box, a, s, t.fw, t.fh)
    t.box = out
    now = t.state()
    speed = tuple(VELOCITY_ALPHA * (n - b) + (1 - VELOCITY_ALPHA) * v for n, b, v in zip(now, before, t.v))
    t.still = early if not measured and out == was and speed == t.v else None
    t.v = speed
    t.unseen = 0 if measured else t.unseen + 1
    has_glo = bool(glo and glo[1] >= 0.14)
    for yes, src, conf in (
        (opt and tra, "tracker+optical", 0.92), (opt, "optical", 0.85), (tem and tra, "tracker+template", 0.83),
        (tem, "template", 0.76), (tra, "tracker", 0.78), (has_glo, "global", 0.55), (True, "predicted", 0.4),
    ):
        if yes:
            return out, src, conf
    return None


def replay_tracks(frames: DataFrame | LaneBlocks, keys: Sequence[str], fw: float, fh: float, direction: int | None = None) -> DataFrame | LaneBlocks:
    """Replay tracks over candidate boxes instead of pixels.

    ``frames`` has one row per key, direction and frame: ``direction`` (1 or -1), ``f``, ``anchors``
    (array of box structs) and ``signals`` (array of ``struct(source, score, x1, y1, x2, y2)``). Tracks are
    independent, so forward and backward runs of every segment are spread over tasks; a task streams
    through its sorted frames with one state. Output: keys, direction, f, box, src, conf. Lane blocks are
    replayed in the one ``direction`` that is given.
    """
    if not isinstance(frames, DataFrame):
        return frames.replay(direction, fw, fh)
    keys = list(keys)
    frames = frames if direction is None else frames.where(F.col("direction") == direction)
    step = F.col("f") * F.col("direction")
    src = frames.withColumns({"__step": step, "__g": null_safe_hash(*keys, "direction")})
    parted = spread(src, *keys, "direction").sortWithinPartitions(*keys, "direction", "__step")
    key_schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frames.schema if f.name in keys)
    schema = f"{key_schema}, direction int, f long, x1 double, y1 double, x2 double, y2 double, src string, conf double"
    fields = Box._fields

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, track = None, None
        for b in batches:
            rows = []
            for i, (g, anchors, signals) in enumerate(zip(b["__g"], b["anchors"], b["signals"])):
                if g != group:
                    group, track = g, _Track(fw, fh)
                pins = [tuple(float(a[n]) for n in fields) for a in (anchors if anchors is not None else [])]
                if track.box is None and not pins:
                    continue
                if track.box is None:
                    track.pin(pins[0])
                    got = (pins[0], "anchor", 1.0)
                else:
                    found = {s["source"]: (tuple(float(s[n]) for n in fields), float(s["score"] or 0.0)) for s in (signals if signals is not None else [])}
                    got = _step(track, pins, found)
                if got is None:  # lost for good; the next anchor starts over
                    track = _Track(fw, fh)
                    continue
                rows.append((i, *got[0], got[1], got[2]))
            if rows:
                r = pd.DataFrame(rows, columns=["i", *fields, "src", "conf"])
                head = b.iloc[r["i"].to_numpy()][[*keys, "direction", "f"]].reset_index(drop=True)
                yield pd.concat([head, r.drop(columns="i")], axis=1)

    return parted.mapInPandas(scan, schema)


def replay_frames(segments: DataFrame, anchors: DataFrame, signals: DataFrame | None, keys: Sequence[str], grid: bool = True) -> DataFrame | LaneBlocks:
    """Frame rows for :func:`replay_tracks`: the forward run from the first anchor to the segment end, the
    backward run from the last anchor to the segment start, without the frames in which a lost track waits for an anchor.

    ``segments``: keys, ``segment``, ``start_frame``, ``end_frame``; ``anchors``: keys, ``segment``, ``f``, ``seq``, box;
    ``signals``: keys, ``segment``, ``direction``, ``f``, ``source``, ``score``, box. Without ``grid`` the same frames are
    laid out only where the tracks are replayed, and rows of what is seen go there.
    """
    k = [*keys, "segment"]
    if not grid:
        from .lane_blocks import seen_rows  # which takes its rules from here

        return seen_rows(segments, anchors, signals, keys)
    ends = anchors.groupBy(*k).agg(F.min("f").alias("__first"), F.max("f").alias("__last"))
    s = segments.join(ends, k)
    # the end is never before the start, so both sequences rise
    runs = s.select(*k, F.lit(1).alias("direction"), F.col("__first").alias("__lo"), F.greatest("__first", "end_frame").alias("__hi")).unionByName(
        s.select(*k, F.lit(-1).alias("direction"), F.least("__last", "start_frame").alias("__lo"), F.col("__last").alias("__hi"))
    )
    seen = anchors.select(*k, F.explode(F.array(F.lit(1), F.lit(-1))).alias("direction"), "f")
    if signals is not None:
        seen = seen.unionByName(signals.select(*k, F.col("direction").cast("int").alias("direction"), "f"))
    # a track that saw nothing for LOST_GRACE frames ends in the next one, and nothing happens until it sees something again
    step = F.col("f") * F.col("direction")
    after = F.lead(step).over(Window.partitionBy(*k, "direction").orderBy(step))
    until = F.least(step + LOST_GRACE + 1, F.coalesce(after - 1, step + LOST_GRACE + 1)) * F.col("direction")
    near = seen.distinct().withColumn("__until", until).join(runs, [*k, "direction"]).where("f BETWEEN __lo AND __hi")
    a, z = F.greatest("__lo", F.least("f", "__until")), F.least("__hi", F.greatest("f", "__until"))
    grid = near.select(*k, "direction", F.explode(F.sequence(a, z)).alias("f"))
    pins = anchors.groupBy(*k, "f").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("seq", *Box._fields))), lambda x: F.struct(*(x[n].cast("double").alias(n) for n in Box._fields))).alias("anchors")
    )
    out = grid.join(pins, [*k, "f"], "left")
    if signals is None:
        none = "array<struct<source:string,score:double,x1:double,y1:double,x2:double,y2:double>>"
        return out.withColumn("signals", F.lit(None).cast(none))
    sig = signals.groupBy(*k, "direction", "f").agg(F.collect_list(F.struct("source", "score", *Box._fields)).alias("signals"))
    return out.join(sig, [*k, "direction", "f"], "left")


# -- output ----------------------------------------------------------------------------------


def serialize_lane(lane: DataFrame | LaneBlocks, keys: Sequence[str], fps: Column | float, fw: float, fh: float) -> DataFrame:
    """Lane rows as stored: safety pad applied, time from the frame, rounded."""
    lane = lane if isinstance(lane, DataFrame) else lane.rows()
    f = fps if isinstance(fps, Column) else F.lit(float(fps))
    m = _step_out(lane.withColumn("__r", B.safety_ratio(box(), F.col("src"))), "__o", B.padded_mask(box(), fw, fh))
    m = _step_out(m, "__m", B.choose(B.is_valid(box_of("__o")), box_of("__o"), box()))
    m = _step_out(m, "__p", B.padded_margin(box_of("__m"), F.col("__r"), fw, fh))
    return m.where(B.is_valid(box_of("__p"))).select(
        *keys, "f", F.bround(F.col("f") / F.greatest(f, F.lit(1.0)), 4).alias("t"),
        *(F.bround(c, 3).alias(n) for n, c in zip(Box._fields, box_of("__p"))),
        F.coalesce(F.nullif("src", F.lit("")), F.lit("track")).alias("src"),
        F.bround(F.coalesce("conf", F.lit(0.0)), 4).alias("conf"),
    )


def _step_out(df: DataFrame, name: str, b: Box) -> DataFrame:
    """Add a box through a generator: it is computed once, not again in every term that reads it, and in a method of its
    own; the JVM does not compile one that holds all terms of a row."""
    return df.withColumn(name, F.explode(F.array(b.struct())))


def lane_stats(lane: DataFrame, keys: Sequence[str]) -> DataFrame:
    return lane.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("frames"),
        F.count_if(F.col("src") == "anchor").alias("anchors"),
        F.min("f").alias("start_frame"),
        F.max("f").alias("end_frame"),
    )


def lane_detections(lane: DataFrame, keys: Sequence[str], person: str, vw: Column, vh: Column) -> DataFrame:
    """Lane boxes as normalised live detections."""
    b = box()
    unit = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    x, y = unit(b.x1 / vw), unit(b.y1 / vh)
    w = F.greatest(F.lit(0.0), F.least(1 - x, (b.x2 - b.x1) / vw))
    h = F.greatest(F.lit(0.0), F.least(1 - y, (b.y2 - b.y1) / vh))
    return lane.select(*keys, F.col("f"), F.concat(F.lit("lane-"), F.col(person)).alias("track_id"), F.lit("face").alias("kind"),
                       F.lit(1.0).alias("confidence"), x.alias("x"), y.alias("y"), w.alias("width"), h.alias("height"))


def sample_regions(boxes: DataFrame, keys: Sequence[str], preview_fps: float, fps: float, fw: float, fh: float) -> DataFrame:
    """Region samples on a preview grid: each grid time takes the first frame within half a frame of it.

    ``boxes``: keys, ``f``, box. Frames without a box give no sample.
    """
    step = 1.0 / max(1.0, preview_fps)
    slack = 0.5 / max(fps, 1.0)
    # grid times t_k = k·step are taken by the first frame with t_k <= f/fps + slack
    hi = F.floor((F.col("f") / fps + slack) / step).cast("long")
    lo = F.floor(((F.col("f") - 1) / fps + slack) / step).cast("long") + 1
    lo = F.when(F.col("f") == 0, F.lit(0).cast("long")).otherwise(lo)
    spread = boxes.withColumn("__lo", lo).withColumn("__hi", hi).where("__hi >= __lo")
    k = spread.select(*keys, "f", *Box._fields, F.explode(F.sequence("__lo", "__hi")).alias("__k"))
    region = B.box_to_region(box(), fw, fh)
    return k.select(*keys, F.bround(F.col("__k") * step, 4).alias("t"), *(c.alias(n) for n, c in region.items()))
