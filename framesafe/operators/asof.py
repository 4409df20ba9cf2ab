"""Nearest-in-time lookups: one ordered pass over probes and builds together, never a pair join."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.boxes import Box, box_of
from . import scans


def bracket(
    probes: DataFrame,
    build: DataFrame,
    keys: Sequence[str],
    t: str = "t",
    tie: str | None = None,
    chunk: float = 3600.0,
    reach: float | None = None,
) -> DataFrame:
    """Attach the build rows just before and after each probe as structs ``prev`` and ``next``.

    ``prev`` is at or before the probe, ``next`` strictly after it; both hold every non-key build column.
    Build rows at one time fold to the one with the smallest ``tie``. The probe and build columns are
    kept apart by packing them into structs. When only neighbours within ``reach`` matter, build rows are
    also put into the chunks they reach, and no state has to be carried between chunks.
    """
    keys = list(keys)
    b_cols = [c for c in build.columns if c not in keys]
    p_cols = [c for c in probes.columns if c not in keys]
    packed = F.struct(*(F.col(c) for c in b_cols))
    others = [F.col(c).cast("string") for c in b_cols if c != t]
    rank = F.col(tie) if tie else (F.xxhash64(*others) if others else F.lit(0))
    t_type = dict(build.dtypes)[t]
    one = build.where(F.col(t).isNotNull()).groupBy(*keys, F.col(t).alias("__t")).agg(F.min_by(packed, rank).alias("__b"))
    b_type = one.schema["__b"].dataType
    p_struct = F.struct(*(F.col(c) for c in p_cols))
    pr = probes.select(*keys, F.col(t).cast(t_type).alias("__t"), F.lit(1).alias("__probe"),
                       F.lit(None).cast(b_type).alias("__b"), p_struct.alias("__p"))
    p_type = pr.schema["__p"].dataType
    bl = one.select(*keys, "__t", F.lit(0).alias("__probe"), "__b", F.lit(None).cast(p_type).alias("__p"))
    if reach is None:
        specs = {"prev": scans.last(F.col("__b")), "next": scans.following(F.col("__b"))}
        seen = scans.scan(bl.unionByName(pr), keys, ["__t", "__probe"], chunk, specs)
    else:
        at = lambda c: F.floor(c / F.lit(chunk)).cast("long")
        near = F.explode(F.sequence(at(F.col("__t") - reach), at(F.col("__t") + reach)))
        both = bl.withColumn(scans.CHUNK, near).unionByName(pr.withColumn(scans.CHUNK, at(F.col("__t"))))
        part = Window.partitionBy(*keys, scans.CHUNK)
        fwd = part.orderBy("__t", "__probe").rowsBetween(Window.unboundedPreceding, 0)
        bwd = part.orderBy(F.col("__t").desc(), F.col("__probe").desc()).rowsBetween(Window.unboundedPreceding, 0)
        seen = both.withColumns({"prev": F.last("__b", ignorenulls=True).over(fwd), "next": F.last("__b", ignorenulls=True).over(bwd)})
    return seen.where("__probe = 1").select(*keys, *(F.col(f"__p.{c}").alias(c) for c in p_cols), "prev", "next")


def nearest(probes: DataFrame, build: DataFrame, keys: Sequence[str], t: str = "t", tie: str | None = None,
            chunk: float = 3600.0) -> DataFrame:
    """The build row closest in time as ``near`` with its ``gap``; on equal gaps the smaller ``tie`` wins."""
    both = bracket(probes, build, keys, t, tie, chunk)
    back = F.abs(F.col(t) - F.col(f"prev.{t}"))
    ahead = F.abs(F.col(f"next.{t}") - F.col(t))
    earlier = F.col(f"prev.{tie}") <= F.col(f"next.{tie}") if tie else F.lit(True)
    use_prev = F.col("next").isNull() | (back < ahead) | ((back == ahead) & earlier)
    take_prev = F.col("prev").isNotNull() & F.coalesce(use_prev, F.lit(False))
    return both.withColumn("near", F.when(take_prev, F.col("prev")).otherwise(F.col("next"))).withColumn(
        "gap", F.when(take_prev, back).otherwise(ahead)
    ).drop("prev", "next")


def nearest_anchor(probes: DataFrame, appearances: DataFrame, keys: Sequence[str], max_gap: float = 1.5,
                   own: DataFrame | None = None, t: str = "t", tie: str = "seq", chunk: float = 3600.0) -> DataFrame:
    """Saved box nearest in time: fresh within ``max_gap``, else of any age, else the face's own box.

    Adds ``x1..y2``, ``gap`` and ``anchor`` (``fresh``, ``stale``, ``own``); ``own`` has the keys and a box.
    """
    near = nearest(probes, appearances, keys, t, tie, chunk)
    b = box_of("near")
    fresh = F.when(F.col("gap") <= max_gap, "fresh").when(F.col("gap").isNotNull(), "stale")
    if own is None:
        return near.select(*[c for c in near.columns if c != "near"], *b.columns(), fresh.alias("anchor"))
    o = own.select(*keys, F.struct("x1", "y1", "x2", "y2").alias("__own"))
    j = near.join(o, list(keys), "left")
    fb = box_of("__own")
    picked = Box(*(F.coalesce(x, y) for x, y in zip(b, fb)))
    label = F.coalesce(fresh, F.when(fb.x1.isNotNull(), F.lit("own")))
    return j.select(*[c for c in near.columns if c != "near"], *picked.columns(), label.alias("anchor"))


def lane_at_frame(probes: DataFrame, lane: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The lane box stored for exactly this frame."""
    return probes.join(lane.select(*keys, "f", "x1", "y1", "x2", "y2"), [*keys, "f"])


def lane_at_time(probes: DataFrame, lane: DataFrame, keys: Sequence[str], fps: Column | float = 25.0,
                 max_gap: float = 0.06, t: str = "t", half_up: bool = False, chunk_frames: int = 90_000) -> DataFrame:
    """Lane box at a time in seconds, linearly interpolated between neighbouring frames.

    The exact rounded frame wins. Probes further than ``max_gap`` from any lane frame drop out. In a
    bracket wider than ``max_gap`` the nearer frame is used as it is. ``half_up`` rounds like the editor.
    """
    fps_col = fps if isinstance(fps, Column) else F.lit(fps)
    rate = F.when(fps_col > 0, fps_col).otherwise(25.0)
    target = F.col(t).cast("double") * rate
    want = F.floor(target + 0.5) if half_up else F.bround(target, 0).cast("long")
    pr = probes.withColumns({"__target": target, "f": want, "__rate": rate})
    lane = lane.select(*keys, F.col("f").cast("long").alias("f"), "x1", "y1", "x2", "y2")
    # neighbours that can matter lie within max_gap plus one frame; where rates differ by row, state is carried instead
    j = bracket(pr, lane, keys, "f", chunk=chunk_frames, reach=None if isinstance(fps, Column) else max_gap * max(fps, 25.0) + 2)
    lo, hi = box_of("prev"), box_of("next")
    lf, hf = F.col("prev.f"), F.col("next.f")
    g_lo = F.abs(lf - F.col("__target")) / F.col("__rate")
    g_hi = F.abs(hf - F.col("__target")) / F.col("__rate")
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("__target") - lf) / (hf - lf)))
    span = max_gap * F.col("__rate")
    wide = (hf - lf) > ((F.floor(span + 0.5) if half_up else span.cast("long")) + 1)
    exact = lf == F.col("f")

    def mix(a: Column, b: Column) -> Column:
        return (
            F.when(exact, a)
            .when(F.col("next").isNull(), a)
            .when(F.col("prev").isNull(), b)
            .when(wide, F.when(g_lo <= g_hi, a).otherwise(b))
            .otherwise(a * (1 - share) + b * share)
        )

    near = F.least(F.coalesce(g_lo, g_hi), F.coalesce(g_hi, g_lo))
    kept = j.where(exact | (near <= max_gap))
    out = Box(*(mix(a, b) for a, b in zip(lo, hi)))
    extra = [c for c in probes.columns if c not in keys]
    return kept.select(*keys, *extra, *out.columns())


def region_at_time(probes: DataFrame, samples: DataFrame, regions: DataFrame, keys: Sequence[str],
                   t: str = "t") -> DataFrame:
    """Region geometry at a time: last sample at or before it, the first sample before that, the region
    itself without samples; nothing before the region's ``anchor_sec``."""
    cols = ["x", "y", "width", "height"]
    shifted = samples.withColumn(t, F.col(t) - F.lit(1e-4))
    j = bracket(probes, shifted.select(*keys, t, *cols), keys, t)
    r = regions.select(*keys, "anchor_sec", F.struct(*cols).alias("__region"))
    j = j.join(r, list(keys)).where(~(F.col(t) + 0.05 < F.coalesce("anchor_sec", F.lit(0.0))))
    out = [F.coalesce(F.col(f"prev.{c}"), F.col(f"next.{c}"), F.col(f"__region.{c}")).alias(c) for c in cols]
    extra = [c for c in probes.columns if c not in keys]
    return j.select(*keys, *extra, *out)


def seek_time(probes: DataFrame, appearances: DataFrame, segments: DataFrame, keys: Sequence[str],
              t: str = "t") -> DataFrame:
    """Where to jump: the nearest appearance, else the middle of the nearest (disjoint) segment."""
    a = nearest(probes, appearances.select(*keys, t), keys, t)
    seg = segments.select(*keys, F.col("start").alias(t), "start", "end")
    j = bracket(a.select(*keys, t, F.col(f"near.{t}").alias("__at")), seg, keys, t)
    behind = F.greatest(F.col(t) - F.col("prev.end"), F.lit(0.0))
    ahead = F.col("next.start") - F.col(t)
    use_prev = F.col("prev").isNotNull() & (F.col("next").isNull() | (behind <= ahead))
    pick = F.when(use_prev, F.col("prev")).otherwise(F.col("next"))
    return j.select(*keys, t, F.coalesce("__at", (pick["start"] + pick["end"]) / 2.0).alias("seek"))
