"""The mask plan: which box of which frame gets which effect."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import boxes as B
from ..functions.boxes import Box, box
from ..operators import boxjoins, lanes, ranges
from ..sources.documents import lane_boxes

PLAN = ["f", "kind", "origin", *Box._fields]


def frames_to_mask(appearances: DataFrame, frames: DataFrame, keys: Sequence[str], on: Sequence[str], before: float = 1.0,
                   after: float = 1.35, gap: float = 0.5, width: float = 5.0, t: str = "t") -> DataFrame:
    """Frames in which each person must be masked.

    ``keys`` name a person, ``on`` the video; ``frames`` has ``on``, ``f`` and time ``t``. The merged ranges of a person
    are disjoint, so every frame meets at most one of them per person.
    """
    merged = ranges.target_ranges(appearances, keys, before, after, gap, t)
    return ranges.points_in_ranges(frames, merged, on, t, width, "inner").select(*keys, "f", t)


def frame_grid_masks(appearances: DataFrame, videos: DataFrame, keys: Sequence[str], on: Sequence[str], frame_ms: int = 40,
                     before: int = 1000, after: int = 1350, gap: int = 500, t: str = "t_ms") -> DataFrame:
    """Frames to mask when frames lie on a regular grid: the frame numbers follow from the range ends.

    No frame table is read or joined; ``videos`` (``on``, ``total_frames``) only bounds the last frame.
    """
    merged = ranges.target_ranges(appearances, keys, before, after, gap, t).join(videos, list(on))
    first = F.ceil(F.col("start") / frame_ms).cast("long")
    last = F.least(F.floor(F.col("end") / frame_ms).cast("long"), F.col("total_frames").cast("long") - 1)
    span = merged.withColumns({"__a": first, "__z": last}).where("__a <= __z")
    return span.select(*keys, F.explode(F.sequence("__a", "__z")).alias("frame_idx"))


def mask_plan(
    lane: DataFrame,
    detections: DataFrame,
    regions: DataFrame,
    preserve: DataFrame,
    limit: DataFrame | None,
    keys: Sequence[str],
    fw: float,
    fh: float,
    every_n: int = 1,
    reverse: bool = False,
    fps: float = 25.0,
    style: str = "blur",
    strength: int = 220,
) -> tuple[DataFrame, DataFrame]:
    """Masks and restore boxes per frame.

    ``lane`` (keys, person_id, f, box) is drawn as it is; ``detections`` (keys, f, kind, person_id, box) count
    inside ``limit`` (keys, start, end in seconds), faces padded, faces of people with a lane left out. The
    detection schedule ``every_n`` thins detector rows of objects only: faces and rows that a tracker carries on
    between detections (boolean ``tracked``, optional) are drawn on every frame;
    ``regions`` (keys, f, box, shape, effect) are drawn frames of custom regions. In reverse mode every face is
    masked except near ``preserve`` boxes (keys, f, box), whose boxes are carried over short gaps and come
    back as restore boxes.
    """
    keys = list(keys)
    lane = lane_boxes(lane)
    covered = lane.select(*keys, "person_id").where(F.col("person_id").isNotNull()).distinct()
    face_kind = F.lower(F.col("kind")) == "face"
    free = face_kind | F.coalesce("tracked", F.lit(False)) if "tracked" in detections.columns else face_kind
    det = detections.where(free | (F.pmod(F.col("f"), F.lit(max(1, min(10, every_n)))) == 0))
    if limit is not None:
        det = ranges.in_ranges(det.withColumn("t", F.col("f") / F.lit(fps)), limit, keys, empty_means_all=True).drop("t")
    if not reverse:
        held = det.join(covered.withColumn("__lane", F.lit(True)), [*keys, "person_id"], "left")
        det = held.where(~(F.lower(F.col("kind")) == "face") | F.col("__lane").isNull()).drop("__lane")
    on = [*keys, "f"]
    hold = None
    if reverse:
        frames = det.select(*keys, "f").unionByName(preserve.select(*keys, "f")).distinct()
        hold = lanes.preserve_memory(preserve, frames, keys, fw, fh)
        det = boxjoins.drop_focus_any(det, hold, on)
    face = F.lower(F.col("kind")) == "face"
    pad = B.mask_pad(box(), fw, fh, "reverse" if reverse else "mask")
    padded = B.choose(face, pad, box())
    rows = det.select(*keys, "f", "kind", F.lit("detection").alias("origin"), *padded.columns())
    if reverse:
        rows = boxjoins.anti_preserved(rows, hold, on)
    else:
        rows = rows.unionByName(lane.select(*keys, "f", F.lit("face").alias("kind"), F.lit("lane").alias("origin"), *box().columns()))
    rows = rows.withColumns({"shape": F.lit("rect"), "effect": F.lit(style)})
    drawn = regions.select(*keys, "f", F.lit("region").alias("kind"), F.lit("region").alias("origin"), *box().columns(),
                           F.coalesce("shape", F.lit("rect")).alias("shape"), F.coalesce("effect", F.lit(style)).alias("effect"))
    plan = rows.unionByName(drawn).withColumn("strength", F.lit(strength)).where(B.is_valid(box()))
    if hold is None:
        return plan, preserve.select(*keys, "f", *box().columns()).limit(0)
    restore = B.mask_pad(box(), fw, fh, "restore")
    return plan, hold.select(*keys, "f", *restore.columns())


def run_stats(plan: DataFrame, restore_source: DataFrame | None, keys: Sequence[str]) -> DataFrame:
    """Frames touched, masks by origin, and preserve frames by kind (own or carried)."""
    keys = list(keys)
    a = plan.groupBy(*keys).agg(
        F.countDistinct("f").alias("masked_frames"),
        *(F.count_if(F.col("origin") == o).alias(f"{o}_masks") for o in ("lane", "detection", "region")),
        F.min("f").alias("first_frame"),
        F.max("f").alias("last_frame"),
    )
    if restore_source is None:
        return a
    p = restore_source.groupBy(*keys).agg(
        F.countDistinct("f").alias("preserve_frames"),
        F.countDistinct(F.when(F.col("age") > 0, F.col("f"))).alias("memory_frames"),
    )
    return a.join(p, keys, "left")


def run_report(requests: DataFrame, found: DataFrame, lost: DataFrame, lane_head: DataFrame, stats: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Result rows per request, and the people without a lane with the fallback used.

    A request names few people, so its id lists are short arrays.
    """
    used = found.groupBy("request_id").agg(F.sort_array(F.collect_set("person_id")).alias("person_ids_used"))
    missing = lost.groupBy("request_id").agg(F.sort_array(F.collect_set("person_id")).alias("unresolved_person_ids"))
    none = F.array().cast("array<string>")
    report = (
        requests.select("request_id", "job_id", "mode", "requested_person_ids", F.col("entity_ids").alias("entity_ids_used"),
                        F.concat(F.col("output_height").cast("string"), F.lit("p")).alias("export_quality"))
        .join(used, "request_id", "left").join(missing, "request_id", "left").join(stats, "job_id", "left")
        .withColumns({c: F.coalesce(c, none) for c in ("person_ids_used", "unresolved_person_ids")})
    )
    failures = found.join(lane_head.select("job_id", "person_id"), ["job_id", "person_id"], "left_anti").select(
        "request_id", "job_id", "person_id", F.lit("lane build returned no frames").alias("reason"), F.lit("per_frame").alias("fallback")
    )
    return report, failures
