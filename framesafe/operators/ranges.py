"""Time ranges: merging, membership, overlap scores, timelines, keyframes.

Ranges are rows ``(keys…, start, end)`` in one time unit, seconds as double or milliseconds as long.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scans


def fold_cells(df: DataFrame, keys: Sequence[str], gap: float, start: Column, end: Column) -> DataFrame:
    """One row ``(keys…, __s, __e, __n)`` per cell of half a gap.

    Ranges that start in one cell always belong together, so folding them is exact. It happens on the map
    side, and it bounds a key: however many rows it has, at most duration / (gap / 2) are left of it.
    """
    cell = F.floor(start / F.lit(gap / 2.0)).cast("long") if gap > 0 else start
    return (
        df.where(start.isNotNull() & end.isNotNull())
        .groupBy(*keys, cell.alias("__cell"))
        .agg(F.min(start).alias("__s"), F.max(F.greatest(start, end)).alias("__e"), F.count(F.lit(1)).alias("__n"))
    )


def _islands(folded: DataFrame, keys: Sequence[str], gap: float) -> DataFrame:
    """Folded cells with the number of their island; the window sees folded rows only."""
    w = Window.partitionBy(*keys).orderBy("__s", "__e")
    reach = F.max("__e").over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(reach.isNull() | (F.col("__s") > reach + F.lit(gap)), 1).otherwise(0)
    marked = folded.withColumn("__new", fresh)
    return marked.withColumn("__island", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))


def merge_ranges(
    df: DataFrame,
    keys: Sequence[str],
    gap: float = 0.5,
    min_len: float | None = None,
    start: str = "start",
    end: str = "end",
) -> DataFrame:
    """Merge ranges of a key that overlap or lie within ``gap``; islands as ``(keys…, start, end)``.

    ``min_len`` widens short islands about their centre, never below zero. Two shuffles: the fold per
    cell and the window per key; the islands are then grouped where they lie.
    """
    cells = _islands(fold_cells(df, keys, gap, F.col(start), F.col(end)), keys, gap)
    out = cells.groupBy(*keys, "__island").agg(F.min("__s").alias(start), F.max("__e").alias(end)).drop("__island")
    return widen(out, min_len, start, end) if min_len else out


def _type(df: DataFrame, col: str) -> str:
    return dict(df.dtypes)[col]


def widen(df: DataFrame, min_len: float, start: str = "start", end: str = "end") -> DataFrame:
    """Ranges shorter than ``min_len`` grow about their centre."""
    s, e = F.col(start), F.col(end)
    half = F.lit(min_len / 2.0)
    short = (e - s) < F.lit(min_len)
    lo = F.greatest(F.lit(0.0), (s + e) / 2.0 - half)
    hi = F.greatest((s + e) / 2.0 + half, s + F.lit(min_len))
    return df.withColumns({start: F.when(short, lo).otherwise(s), end: F.when(short, hi).otherwise(e)})


# -- points against ranges -------------------------------------------------------------------


def bucketed_ranges(ranges: DataFrame, width: float, start: str = "start", end: str = "end") -> DataFrame:
    """One row per time bucket that a range touches; points then join on an equal bucket."""
    b = lambda c: F.floor(F.col(c) / F.lit(width)).cast("long")
    return ranges.withColumn("__bucket", F.explode(F.sequence(b(start), b(end))))


FLAT = 16  # buckets; a shorter range stands in each of its buckets
_EDGE = 1 << 60


def _bucket_of(c: Column, width: float) -> Column:
    return F.greatest(F.lit(-_EDGE), F.least(F.lit(_EDGE), F.floor(c / F.lit(width)).cast("long")))


def covered_ranges(ranges: DataFrame, width: float, start: str = "start", end: str = "end") -> DataFrame:
    """Ranges as nodes ``(__level, __node)`` of a tree over time buckets: node i of level l holds 4^l buckets from i * 4^l.

    A range of n > ``FLAT`` buckets becomes the at most 6 * log4(n) + 7 nodes that fill it and share no bucket,
    a shorter one its buckets. Ranges that lack an end, or end before they start, give no row.
    """
    nodes = f"""CASE WHEN __b - __a < {FLAT} THEN transform(sequence(__a, __b), i -> struct(0 AS level, i AS node))
    ELSE flatten(transform(sequence(0, (length(bin(__b - __a + 1)) - 1) DIV 2), l -> transform(flatten(transform(
        array(struct(-shiftright(-__a, 2 * l) AS lo, shiftright(__b + 1, 2 * l) AS hi, -shiftright(-__a, 2 * l + 2) * 4 AS in_lo, shiftright(__b + 1, 2 * l + 2) * 4 AS in_hi)),
        x -> CASE WHEN x.in_lo >= x.in_hi THEN IF(x.lo < x.hi, sequence(x.lo, x.hi - 1), array())
             ELSE concat(IF(x.lo < x.in_lo, sequence(x.lo, x.in_lo - 1), array()), IF(x.in_hi < x.hi, sequence(x.in_hi, x.hi - 1), array())) END)),
        i -> struct(CAST(l AS INT) AS level, i AS node)))) END"""
    ends = ranges.where(F.col(start) <= F.col(end)).withColumns({"__a": _bucket_of(F.col(start), width), "__b": _bucket_of(F.col(end), width)})
    each = ends.withColumn("__at", F.explode(F.expr(nodes)))
    return each.withColumns({"__level": F.col("__at.level"), "__node": F.col("__at.node")}).drop("__a", "__b", "__at")


def _meet(points: DataFrame, ranges: DataFrame, on: Sequence[str], t: str, width: float, start: str, end: str) -> DataFrame:
    """Each point with each range of its key that holds it: one equal join, a point asks the node above it on every level in use."""
    r = covered_ranges(ranges, width, start, end)
    levels = F.coalesce(r.agg(F.sort_array(F.collect_set("__level"))).scalar(), F.array(F.lit(0)))  # at most 31 numbers
    asked = points.withColumn("__ask", F.explode(levels)).withColumn("__bucket", _bucket_of(F.col(t), width))
    p = asked.withColumn("__bucket", F.expr("shiftright(__bucket, 2 * __ask)"))
    r = r.withColumnsRenamed({c: f"__r_{c}" for c in on})
    cond = (p["__ask"] == r["__level"]) & (p["__bucket"] == r["__node"]) & p[t].between(r[start], r[end])
    for c in on:
        cond = cond & (p[c] == r[f"__r_{c}"])
    return p.join(r, cond).drop("__ask", "__bucket", "__level", "__node", *(f"__r_{c}" for c in on))


def points_in_ranges(points: DataFrame, ranges: DataFrame, on: Sequence[str], t: str = "t",
                     width: float = 5.0, how: str = "inner") -> DataFrame:
    """Equi join on ``(on…, node)`` of a tree over time buckets, with the exact inclusive test on top.

    The nodes of a range share no bucket, so no pair comes out twice, and a range of any length is some
    dozens of rows. ``how`` may be inner, left_semi, left_anti or left. The range columns must be named
    ``start`` and ``end`` and not occur in ``points``.
    """
    if how == "inner":
        return _meet(points, ranges, on, t, width, "start", "end")
    if how == "left_semi":
        # merged ranges are disjoint, so a point meets at most one
        whole = merge_ranges(ranges.where("start <= end"), on, 0).withColumnsRenamed({"start": "__start", "end": "__end"})
        return _meet(points, whole, on, t, width, "__start", "__end").select(*points.columns)
    hits = _meet(points.select(*on, t).distinct(), ranges, on, t, width, "start", "end")
    if how == "left_anti":
        return points.join(hits.select(*on, t).distinct(), [*on, t], "left_anti").select(*points.columns)
    return points.join(hits, [*on, t], "left").select(*points.columns, *(c for c in ranges.columns if c not in on))


def in_ranges(points: DataFrame, ranges: DataFrame, on: Sequence[str], t: str = "t", width: float = 5.0,
              empty_means_all: bool = False) -> DataFrame:
    """Points inside any range of their key. With ``empty_means_all`` keys without ranges keep all points."""
    inside = points_in_ranges(points, ranges, on, t, width, "left_semi")
    if not empty_means_all:
        return inside
    return inside.unionByName(points.join(ranges.select(*on).distinct(), list(on), "left_anti"))


def detection_schedule(frames: DataFrame, every_n: Column | int, has_faces: Column | bool = False,
                       seconds: Column | None = None, fps: Column | float = 25.0) -> DataFrame:
    """Frames on which detectors run: every n-th, n from seconds when given, 1..10, always 1 for faces."""
    n = every_n if isinstance(every_n, Column) else F.lit(every_n)
    if seconds is not None:
        f = fps if isinstance(fps, Column) else F.lit(fps)
        n = F.coalesce(F.when(seconds > 0, F.greatest(F.lit(1), F.bround(seconds * f, 0).cast("int"))), n)
    n = F.greatest(F.lit(1), F.least(F.lit(10), n))
    faces = has_faces if isinstance(has_faces, Column) else F.lit(has_faces)
    n = F.when(faces, 1).otherwise(n)
    return frames.where(F.pmod(F.col("frame_idx"), n) == 0)


def overlap_score(appearances: DataFrame, ranges: DataFrame, group: Sequence[str], face: str, desc: str,
                  t: str = "t", pad: float = 0.45, width: float = 5.0) -> DataFrame:
    """How well the appearances of a face fit the ranges of a description.

    Score = 4·inside + 2.5·inside/appearances + ranges hit/ranges; pairs with nothing inside are absent.
    A timestamp inside two ranges counts twice. ``ranges`` needs ``range_id``, ``start``, ``end``.
    """
    g = list(group)
    padded = ranges.select(
        *g,
        desc,
        "range_id",
        (F.least("start", "end") - F.lit(pad)).alias("start"),
        (F.greatest("start", "end") + F.lit(pad)).alias("end"),
    )
    # appearances at the same time are folded before the join; the weight keeps the counts exact
    folded = appearances.groupBy(*g, face, t).agg(F.count(F.lit(1)).alias("__n"))
    hits = points_in_ranges(folded, padded, g, t, width)
    per_range = hits.groupBy(*g, face, desc, "range_id").agg(F.sum("__n").alias("__inside"))
    pairs = per_range.groupBy(*g, face, desc).agg(
        F.sum("__inside").alias("inside"), F.count(F.lit(1)).alias("hit_ranges")
    )
    totals = folded.groupBy(*g, face).agg(F.sum("__n").alias("appearances"))
    spans = ranges.groupBy(*g, desc).agg(F.count(F.lit(1)).alias("ranges"))
    return (
        pairs.join(totals, [*g, face])
        .join(spans, [*g, desc])
        .withColumn(
            "score",
            F.col("inside") * 4.0
            + F.col("inside") / F.col("appearances") * 2.5
            + F.col("hit_ranges") / F.col("ranges"),
        )
    )


def nearest_gap(probes: DataFrame, segments: DataFrame, on: Sequence[str], item: str, t: str = "t",
                visible_within: float = 0.18, items: DataFrame | None = None, chunk: float = 3600.0) -> DataFrame:
    """Gap from each probe time to the nearest segment of every item of its key, 0 inside.

    Segments of an item must be disjoint (use :func:`merge_ranges`). The nearest segment is then the last
    one that starts at or before the probe or the first one after it: two ordered scans, no pair join.
    """
    on = list(on)
    items = (segments if items is None else items).select(*on, item).distinct()
    pr = probes.select(*on, t).distinct().join(items, on)
    keys = [*on, item]
    t_type = _type(pr, t)
    tagged = pr.select(*keys, F.col(t).alias("__t"), F.lit(1).alias("__probe"), F.lit(None).cast(t_type).alias("__s"),
                       F.lit(None).cast(t_type).alias("__e"))
    built = segments.select(*keys, F.col("start").cast(t_type).alias("__t"), F.lit(0).alias("__probe"),
                            F.col("start").cast(t_type).alias("__s"), F.col("end").cast(t_type).alias("__e"))
    specs = {"__last_end": scans.last(F.col("__e")), "__next_start": scans.following(F.col("__s"))}
    seen = scans.scan(tagged.unionByName(built), keys, ["__t", "__probe"], chunk, specs)
    # greatest() skips nulls, so a missing end must stay missing
    behind = F.when(F.col("__last_end").isNotNull(), F.greatest(F.col("__t") - F.col("__last_end"), F.lit(0).cast(t_type)))
    ahead = F.col("__next_start") - F.col("__t")
    return seen.where("__probe = 1").select(
        *keys,
        F.col("__t").alias(t),
        F.least(behind, ahead).alias("gap"),
        (F.least(behind, ahead) <= F.lit(visible_within)).alias("visible"),
    )


def active_at(probes: DataFrame, segments: DataFrame, on: Sequence[str], t: str = "t", width: float = 5.0) -> DataFrame:
    """Segments (clips, events) that contain the probe time."""
    return points_in_ranges(probes, segments, on, t, width)


# -- ranges from appearances -----------------------------------------------------------------


def around(df: DataFrame, keys: Sequence[str], before: float, after: float, t: str = "t") -> DataFrame:
    """A range about every appearance, floored at zero."""
    typ = _type(df, t)
    zero = F.lit(0).cast(typ)
    return df.where(F.col(t).isNotNull()).select(
        *keys,
        F.greatest(zero, F.col(t) - F.lit(before).cast(typ)).alias("start"),
        F.greatest(zero, F.col(t) + F.lit(after).cast(typ)).alias("end"),
    )


def target_ranges(appearances: DataFrame, keys: Sequence[str], before: float = 1.0, after: float = 1.35,
                  gap: float = 0.5, t: str = "t") -> DataFrame:
    """Merged ranges in which a selected face must be looked for."""
    return merge_ranges(around(appearances, keys, before, after, t), keys, gap)


def first_source(sources: Sequence[tuple[str, DataFrame]], keys: Sequence[str]) -> list[tuple[str, DataFrame]]:
    """Each source without the keys that an earlier source has rows for."""
    out, seen = [], None
    for label, df in sources:
        out.append((label, df if seen is None else df.join(seen, list(keys), "left_anti")))
        have = df.select(*keys).distinct()
        seen = have if seen is None else seen.unionByName(have).distinct()
    return out


def _labelled(parts: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    out = None
    for label, df in parts:
        df = df.withColumn("source", F.lit(label))
        out = df if out is None else out.unionByName(df)
    return out


def person_timeline(appearances: DataFrame, own: DataFrame, remote: DataFrame, keys: Sequence[str],
                    scale: float = 1.0, t: str = "t") -> DataFrame:
    """Timeline of a person: appearances, else own ranges, else remote ranges.

    ``scale`` is the number of time units per second, 1000 for milliseconds.
    """
    usable = lambda df: df.where(F.col("start").isNotNull())
    (_, a), (_, o), (_, r) = first_source(
        [("appearances", appearances.where(F.col(t).isNotNull())), ("ranges", usable(own)), ("remote", usable(remote))], keys
    )
    seen = merge_ranges(around(a, keys, 0.18 * scale, 0.28 * scale, t), keys, 0.7 * scale, 0.7 * scale)

    def ranged(df: DataFrame) -> DataFrame:
        fixed = df.select(
            *keys,
            F.greatest(F.lit(0.0), F.col("start").cast("double")).alias("start"),
            F.greatest(F.col("start"), F.coalesce("end", "start")).cast("double").alias("end"),
        )
        return merge_ranges(fixed, keys, 0.45 * scale, 0.55 * scale)

    return _labelled([("appearances", seen), ("ranges", ranged(o)), ("remote", ranged(r))])


def effective_ranges(faces: DataFrame, entities: DataFrame, people: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Ranges that limit a job: selected faces, else entities, else described people."""
    return _labelled(first_source([("faces", faces), ("entities", entities), ("people", people)], keys))


def appearance_groups(df: DataFrame, keys: Sequence[str], gap: float = 4.0, t: str = "t") -> DataFrame:
    """Runs of appearances no further apart than ``gap``: ``(keys…, start, end, appearances)``.

    Appearances are folded per cell narrower than the gap first, as in :func:`merge_ranges`.
    """
    cells = _islands(fold_cells(df, keys, gap, F.col(t), F.col(t)), keys, gap)
    return cells.groupBy(*keys, "__island").agg(
        F.min("__s").alias("start"), F.max("__e").alias("end"), F.sum("__n").alias("appearances")
    ).drop("__island")


def extend_by_ranges(groups: DataFrame, ranges: DataFrame, keys: Sequence[str], slack: float = 4.0) -> DataFrame:
    """Groups stretched by every range that reaches within ``slack`` of them."""
    g = groups.withColumns({"__gs": F.col("start"), "__ge": F.col("end")})
    wide = g.withColumns({"start": F.col("start") - slack, "end": F.col("end") + slack})
    width = max(slack * 4, 1e-9)
    a = bucketed_ranges(wide, width).withColumnsRenamed({"start": "ws", "end": "we"})
    b = bucketed_ranges(ranges.select(*keys, "start", "end"), width)
    b = b.select(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)), F.col("__bucket").alias("__b"), "start", "end")
    cond = (F.col("__bucket") == F.col("__b")) & (F.col("start") <= F.col("we")) & (F.col("end") >= F.col("ws"))
    for i, k in enumerate(keys):
        cond = cond & (F.col(k) == F.col(f"__k{i}"))
    # a pair may meet in several buckets: min and max do not mind
    rest = [c for c in groups.columns if c not in (*keys, "start", "end")]
    out = a.join(b, cond, "left").groupBy(*keys, "__gs", "__ge", *rest).agg(F.min("start").alias("__rs"), F.max("end").alias("__re"))
    return out.select(
        *keys,
        F.least("__gs", F.coalesce("__rs", "__gs")).alias("start"),
        F.greatest("__ge", F.coalesce("__re", "__ge")).alias("end"),
        *rest,
    )


def lane_segments(appearances: DataFrame, ranges: DataFrame | None, keys: Sequence[str], fps: Column,
                  total_frames: Column, duration: Column, t: str = "t", gap: float = 4.0, pad: float = 0.9,
                  unit: float = 1.0) -> DataFrame:
    """Frame segments in which a person is tracked.

    Appearance runs, stretched by overlapping ranges, padded in time, clamped to the video, turned into
    frames, and merged again where frame segments touch. ``unit`` is time units per second. ``fps``,
    ``total_frames`` and ``duration`` (in time units) are columns of ``appearances``.
    """
    video = appearances.groupBy(*keys).agg(
        F.first(fps).alias("__fps"), F.first(total_frames).alias("__frames"), F.first(duration).alias("__dur")
    )
    groups = appearance_groups(appearances, keys, gap * unit, t)
    if ranges is not None:
        groups = extend_by_ranges(groups, ranges, keys, gap * unit)
    g = groups.join(video, list(keys))
    f = F.when(F.col("__fps") > 0, F.col("__fps")).otherwise(25.0)
    lo = F.greatest(F.lit(0.0), F.col("start") - pad * unit)
    hi = F.col("end") + pad * unit
    hi = F.when(F.col("__dur") > 0, F.least(F.col("__dur").cast("double"), hi)).otherwise(hi)
    a = F.greatest(F.lit(0), F.bround(lo * f / unit, 0).cast("long"))
    b = F.greatest(a, F.bround(hi * f / unit, 0).cast("long"))
    b = F.when(F.col("__frames") > 0, F.least(b, F.col("__frames").cast("long") - 1)).otherwise(b)
    frames = g.select(*keys, a.alias("start"), b.alias("end"))
    out = merge_ranges(frames, keys, 1)
    return out.withColumnsRenamed({"start": "start_frame", "end": "end_frame"})


# -- keyframes -------------------------------------------------------------------------------


def keyframes(ranges: DataFrame, keys: Sequence[str], interval: float = 5.0, gap: float = 0.5,
              digits: int | None = 3) -> DataFrame:
    """Sample times: both ends of every merged range and every ``interval`` inside, distinct."""
    s = F.coalesce("start", F.lit(0))
    e = F.greatest(s, F.coalesce("end", F.lit(0)))
    m = merge_ranges(ranges.select(*keys, s.alias("start"), e.alias("end")), keys, gap)
    steps = F.greatest(F.lit(0), F.ceil((F.col("end") - F.col("start")) / F.lit(interval)).cast("int") - 1)
    inner = F.when(
        F.col("end") - F.col("start") > interval,
        F.transform(F.sequence(F.lit(1), F.greatest(steps, F.lit(1))), lambda i: F.col("start") + i * F.lit(interval)),
    ).otherwise(F.array().cast("array<double>"))
    times = F.concat(F.array(F.col("start").cast("double"), F.col("end").cast("double")), inner.cast("array<double>"))
    out = m.select(*keys, F.explode(times).alias("t"))
    if digits is not None:
        out = out.withColumn("t", F.bround("t", digits))
    return out.distinct()


def frames_at(times: DataFrame, fps: Column, total_frames: Column | None = None, nearest: bool = False) -> DataFrame:
    """Frame index of each time: truncated, or the nearest frame clamped to the video."""
    f = F.col("t") * fps
    idx = F.bround(f, 0).cast("long") if nearest else f.cast("long")
    if nearest and total_frames is not None:
        clamped = F.greatest(F.lit(0), F.least(total_frames - 1, idx))
        idx = F.when(total_frames > 0, clamped).otherwise(idx)
    return times.withColumn("frame_idx", idx)


def uniform_keyframes(videos: DataFrame, keys: Sequence[str], interval: float = 1.0) -> DataFrame:
    """Every ``int(fps * interval)``-th frame of a video (columns ``fps``, ``total_frames``)."""
    step = F.greatest(F.lit(1), (F.col("fps") * interval).cast("long"))
    idx = F.explode(F.sequence(F.lit(0).cast("long"), F.col("total_frames").cast("long") - 1, step)).alias("frame_idx")
    return videos.where("total_frames > 0").select(*keys, "fps", idx).select(
        *keys, "frame_idx", F.bround(F.col("frame_idx") / F.col("fps"), 3).alias("t")
    )
