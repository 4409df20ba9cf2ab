"""Search hits: grouping, deduplication, set operations, density series, order."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CLIP = ["start", "end", "rank", "score", "thumbnail_url"]
BUCKET_FALL, BUCKET_FLOOR = 0.16, 0.22
PEAK_SHARE = 0.52  # fixed value: share of the highest bar from which a bar counts as a peak


def clip_order() -> list[Column]:
    """Rank first (missing last), then score, start, end."""
    return [
        F.col("rank").isNull(),
        F.col("rank"),
        -F.coalesce("score", F.lit(0)),
        F.coalesce("start", F.lit(0)),
        F.coalesce("end", F.lit(0)),
    ]


def flatten_hits(raw: DataFrame, keys: Sequence[str] = ("query_id",)) -> DataFrame:
    """Raw hits to clip rows. A hit has nested ``clips`` or is a clip itself (``start``/``end``).

    ``item_score`` stays on every row; a hit without clips or times gives one row with null times.
    """
    own = F.when(F.col("start").isNotNull() & F.col("end").isNotNull(),
                 F.array(F.struct("start", "end", "score", "rank", "thumbnail_url")))
    nested = F.when(F.size("clips") > 0, F.transform("clips", lambda c: F.struct(
        c["start"].alias("start"), c["end"].alias("end"), c["score"].alias("score"), c["rank"].alias("rank"), c["thumbnail_url"].alias("thumbnail_url"))))
    vid = F.coalesce(F.col("video_id").cast("string"), F.col("id").cast("string")) if "id" in raw.columns else F.col("video_id")
    rows = raw.select(*keys, vid.alias("video_id"), F.col("score").alias("item_score"), F.explode_outer(F.coalesce(nested, own)).alias("__c"))
    return rows.where(F.col("video_id").isNotNull()).select(*keys, "video_id", "item_score", "__c.*")


def video_scores(clips: DataFrame, keys: Sequence[str], score: str = "item_score") -> DataFrame:
    """Best score and clip count per video: aggregates only, safe for a video with very many clips."""
    return clips.groupBy(*keys).agg(
        F.max(score).alias("score"),
        F.count_if(F.col("start").isNotNull()).alias("clips"),
        F.min("rank").alias("best_rank"),
    )


def dedupe_clips(clips: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct clips; null ranks, scores and thumbnails count as equal."""
    have = [c for c in CLIP if c in clips.columns]
    return clips.where(F.col("start").isNotNull()).select(*keys, *have).distinct()


def rank_clips(clips: DataFrame, keys: Sequence[str], top: int, salts: int = 64) -> DataFrame:
    """The ``top`` first clips of every video with their position.

    A salted round keeps the best of each slice before the final order, so a video with very many clips is
    not sorted in one task. Clips that are equal in every column share a slice; fold them with
    :func:`dedupe_clips` first.
    """
    order = clip_order()
    have = [c for c in CLIP if c in clips.columns]
    salted = clips.withColumn("__salt", F.pmod(F.xxhash64(*have), F.lit(salts)))
    ws = Window.partitionBy(*keys, "__salt").orderBy(*order)
    best = salted.withColumn("__rn", F.row_number().over(ws)).where(F.col("__rn") <= top).drop("__rn", "__salt")
    out = best.withColumn("clip_pos", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return out.where(F.col("clip_pos") <= top)


def group_hits(clips: DataFrame, keys: Sequence[str], score: str = "item_score") -> DataFrame:
    """One row per video with its clips in rank order as an array (for results a page shows)."""
    have = [c for c in CLIP if c in clips.columns]
    body = F.struct(*(c.alias(f"o{i}") for i, c in enumerate(clip_order())), *(F.col(c) for c in have))
    arr = F.array_sort(F.collect_list(F.when(F.col("start").isNotNull(), body)))
    return clips.groupBy(*keys).agg(
        F.max(score).alias("score"),
        F.transform(arr, lambda x: F.struct(*(x[c].alias(c) for c in have))).alias("clips"),
    )


def combine_hits(clips: DataFrame, set_col: str, op: str = "or", keys: Sequence[str] = ("video_id",),
                 n_sets: int | None = None, score: str = "item_score") -> tuple[DataFrame, DataFrame]:
    """OR or AND of result sets: videos with their best score, and their deduplicated clips.

    An unknown operator means OR. For AND a video must occur in every one of ``n_sets`` sets, empty ones
    included, so their number has to be given.
    """
    if op == "and" and n_sets is None:
        raise ValueError("AND needs the number of sets: an empty one leaves no rows to count")
    keys = list(keys)
    per_set = clips.groupBy(*keys, set_col).agg(F.max(score).alias("__s"))
    videos = per_set.groupBy(*keys).agg(F.max("__s").alias("score"), F.count(F.lit(1)).alias("__sets"))
    if op == "and":
        videos = videos.where(F.col("__sets") == n_sets)
    videos = videos.select(*keys, "score")
    kept = dedupe_clips(clips, keys)
    if op == "and":
        kept = kept.join(videos.select(*keys), keys, "left_semi")
    return videos, kept


def default_operator(op: Column, inputs: Column) -> Column:
    return F.when(op.isin("and", "or"), op).when(inputs > 1, "and")


def order_hits(videos: DataFrame, mode: str = "score") -> DataFrame:
    """``score``: best score, id. ``dashboard``: best rank (missing last), best score, title."""
    if mode == "score":
        return videos.orderBy(F.coalesce("score", F.lit(0)).desc(), F.coalesce("video_id", F.lit("")))
    return videos.orderBy(F.col("best_rank").asc_nulls_last(), F.col("best_score").desc_nulls_last(), "title")


def hits_with_videos(hits: DataFrame, videos: DataFrame) -> DataFrame:
    """Hits with title and duration from the catalogue; unknown videos keep their id as title."""
    j = hits.join(videos, "video_id", "left")
    return j.withColumns({
        "title": F.coalesce(F.nullif("filename", F.lit("")), F.col("video_id").cast("string")),
        "total_minutes": F.coalesce(F.col("duration") / 60.0, F.lit(0.0)),
    })


def entity_ranges(hits: DataFrame, entity: Column | None = None, video: Column | None = None) -> DataFrame:
    """Time ranges of hits, of one entity and optionally one video."""
    out = hits
    if entity is not None:
        out = out.where(entity)
    if video is not None:
        out = out.where(video)
    return out.where(F.col("start").isNotNull()).select("video_id", *(["entity_id"] if "entity_id" in hits.columns else []), "start", "end")


def segments_as_hits(segments: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Timeline segments as hits ranked by their order."""
    w = Window.partitionBy(*keys).orderBy("start", "end")
    return segments.withColumn("rank", F.row_number().over(w))


def fallback_hits(hits: DataFrame, segments: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Hits, and ranked segments for the keys that have none."""
    free = segments.join(hits.select(*keys).distinct(), list(keys), "left_anti")
    ranked = segments_as_hits(free, keys).select(*keys, "start", "end", "rank")
    return hits.select(*keys, "start", "end", "rank").unionByName(ranked)


def latest_sessions(sessions: DataFrame, session: str = "session_id", order: str = "seq") -> DataFrame:
    """The newest of the sessions that share an id."""
    newest = sessions.groupBy(session).agg(F.max(order).alias(order))
    return sessions.join(newest, [session, order], "left_semi")


# -- density ---------------------------------------------------------------------------------


def clip_importance(rank: Column, score: Column, max_rank: Column) -> Column:
    s = F.greatest(F.lit(0.7), F.least(F.lit(1.0), F.coalesce(score, F.lit(0.0)) * 2.2 + 0.78))
    bucket = F.greatest(F.lit(BUCKET_FLOOR), F.lit(1.0) - F.floor((rank - 1) / 10) * BUCKET_FALL)
    inside = (F.lit(1.0) - F.pmod(rank - 1, F.lit(10)) / 9.0) * 0.06 + 0.94
    r = F.when(rank <= 0, 0.3).otherwise(F.greatest(F.lit(BUCKET_FLOOR), F.least(F.lit(1.0), bucket * inside)))
    ranked = F.greatest(F.lit(0.12), F.least(F.lit(1.0), r * s))
    plain = F.greatest(F.lit(0.18), F.least(F.lit(0.42), s * F.when(max_rank > 0, 0.55).otherwise(1.0)))
    return F.when(rank.isNotNull() & (max_rank > 0), ranked).otherwise(plain)


def search_series(clips: DataFrame, keys: Sequence[str], duration: Column, samples: Column | int, bars: int | None = None,
                  max_samples: int = 320) -> DataFrame:
    """Density of hits over a timeline: ``(keys…, bucket, value)`` with every bucket present.

    Clips raise a sine bump over the buckets they cover, the highest bump wins, three-tap smoothing, scaled
    to the peak, power 1.28. Clips are folded per bucket before anything is ordered, so a video with very
    many clips shrinks to ``samples`` rows first. With ``bars`` the maximum per bar and the peak flag follow.
    """
    keys = list(keys)
    n = samples if isinstance(samples, Column) else F.lit(samples)
    c = clips.withColumns({"__d": duration.cast("double"), "__n": n.cast("int")}).where((F.col("__d") > 0) & (F.col("__n") > 0))
    top = c.groupBy(*keys).agg(F.coalesce(F.max("rank"), F.lit(0)).alias("__top"), F.max("__d").alias("__d"), F.max("__n").alias("__n"))
    j = c.drop("__d", "__n").join(top, keys)
    s = F.greatest(F.lit(0.0), F.least(F.col("__d"), F.col("start")))
    e = F.greatest(s, F.least(F.col("__d"), F.col("end")))
    i0 = F.greatest(F.lit(0), F.floor(s / F.col("__d") * F.col("__n")).cast("int"))
    i1 = F.least(F.col("__n") - 1, F.greatest(i0, F.ceil(e / F.col("__d") * F.col("__n")).cast("int") - 1))
    imp = clip_importance(F.col("rank"), F.col("score"), F.col("__top"))
    # equal bumps are folded before they are spread over buckets
    j = j.where(e > s).select(*keys, i0.alias("__i0"), i1.alias("__i1"), imp.alias("__imp"))
    j = j.groupBy(*keys, "__i0", "__i1").agg(F.max("__imp").alias("__imp")).where("__i1 >= __i0")
    b = j.withColumn("bucket", F.explode(F.sequence("__i0", "__i1")))
    span = F.greatest(F.lit(1), F.col("__i1") - F.col("__i0"))
    progress = F.when(span <= 1, 0.5).otherwise((F.col("bucket") - F.col("__i0")) / span)
    env = F.pow(F.greatest(F.lit(0.0), F.sin(progress * math.pi)), F.lit(0.82))
    peaks = b.groupBy(*keys, "bucket").agg(F.max(F.col("__imp") * (env * 0.74 + 0.26)).alias("__v"))
    grid = top.select(*keys, "__n", F.explode(F.sequence(F.lit(0), F.col("__n") - 1)).alias("bucket"))
    full = grid.join(peaks, [*keys, "bucket"], "left").withColumn("__v", F.coalesce("__v", F.lit(0.0)))
    w = Window.partitionBy(*keys).orderBy("bucket")  # at most `samples` rows per key
    v = F.col("__v")
    smooth = F.coalesce(F.lag(v).over(w), v) * 0.18 + v * 0.64 + F.coalesce(F.lead(v).over(w), v) * 0.18
    sm = full.withColumn("__s", smooth)
    peak = F.greatest(F.max("__s").over(Window.partitionBy(*keys)), F.lit(0.001))
    out = sm.select(*keys, "__n", "bucket", F.pow(F.least(F.lit(1.0), F.col("__s") / peak), F.lit(1.28)).alias("value"))
    if bars is None:
        return out.drop("__n")
    lo = F.floor(F.col("bar") / bars * F.col("__n"))
    hi = F.greatest(lo + 1, F.floor((F.col("bar") + 1) / bars * F.col("__n")))
    slots = top.select(*keys, "__n", F.explode(F.sequence(F.lit(0), F.lit(bars - 1))).alias("bar"))
    slots = slots.withColumn("bucket", F.explode(F.sequence(lo.cast("int"), F.least(hi, F.col("__n")).cast("int") - 1)))
    per_bar = slots.join(out.drop("__n"), [*keys, "bucket"]).groupBy(*keys, "bar").agg(F.max("value").alias("value"))
    best = F.max("value").over(Window.partitionBy(*keys))
    return per_bar.withColumn("is_peak", (best > 0.05) & (F.col("value") >= best * PEAK_SHARE))


def waveform(signal: DataFrame, keys: Sequence[str], n: int, index: str = "i", value: str = "v", strided: bool = False) -> DataFrame:
    """Peak of the signal per bucket, scaled by the 96th-percentile order statistic of the positive peaks,
    power .72. Rows are samples of one or more channels. All samples count; ``strided`` reads 600 of a bucket at most."""
    keys = list(keys)
    size = signal.groupBy(*keys).agg((F.max(index) + 1).alias("__len"))
    s = signal.join(size, keys).withColumn("__w", F.greatest(F.lit(1), F.floor(F.col("__len") / n)).cast("long"))
    bucket = F.least(F.lit(n - 1), F.floor(F.col(index) / F.col("__w")).cast("long"))
    s = s.withColumn("bucket", bucket)
    start = F.col("bucket") * F.col("__w")
    width = F.when(F.col("bucket") == n - 1, F.col("__len") - start).otherwise(F.col("__w"))
    step = F.greatest(F.lit(1), F.floor(width / 600)).cast("long")
    picked = s.where(F.pmod(F.col(index) - start, step) == 0) if strided else s
    grid = size.select(*keys, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("bucket"))
    peaks = picked.groupBy(*keys, "bucket").agg(F.max(F.abs(value)).alias("__p"))
    full = grid.join(peaks, [*keys, "bucket"], "left").withColumn("__p", F.coalesce("__p", F.lit(0.0)))
    pos = full.groupBy(*keys).agg(F.array_sort(F.collect_list(F.when(F.col("__p") > 0, F.col("__p")))).alias("__a"))
    at = F.greatest(F.lit(1), F.least(F.size("__a"), F.floor(F.size("__a") * 0.96).cast("int") + 1))
    ref = pos.select(*keys, F.greatest(F.coalesce(F.try_element_at("__a", at), F.lit(0.0)), F.lit(0.001)).alias("__ref"))
    return full.join(ref, keys).select(*keys, "bucket", F.pow(F.least(F.lit(1.0), F.col("__p") / F.col("__ref")), F.lit(0.72)).alias("value"))
