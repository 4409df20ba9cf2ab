"""Ingestion, lane builds and privacy results as pipelines of operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.boxes import Box
from ..operators import identity, lanes, privacy, ranges, review
from ..operators.ranges import overlap_score
from ..session import checkpoint, spread


def ingest(dets: DataFrame, people: DataFrame, people_ranges: DataFrame, job: str = "job_id") -> tuple[DataFrame, DataFrame]:
    """Detections to enriched faces and their appearances.

    ``dets``: job, seq, frame_idx, t, box, det_score, sharpness, encoding. ``people``: job, desc_index, name,
    description, flags, tags, confidence, redaction_reason. ``people_ranges``: job, desc_index, range_id, start, end.
    """
    assigned = checkpoint(identity.cluster_faces(dets, job))  # the costly step; its header and its ranges read it
    rows = dets.join(assigned, [job, "seq"])
    header = identity.summarise_people(rows, job).withColumn("face_pos", F.col("order_pos") - 1)
    app = rows.join(header.select(job, "cluster", "person_id", "face_pos"), [job, "cluster"])
    scores = overlap_score(app, people_ranges, [job], "face_pos", "desc_index")
    matches = review.match_descriptions(scores, [job])
    faces = header.withColumns({"stable_person_id": F.col("person_id"), "cluster_person_id": F.col("person_id"), "name": F.lit(None).cast("string")})
    return review.enrich_faces(faces, people, matches, job), app.select(job, "person_id", "face_pos", "seq", "frame_idx", "t", "x1", "y1", "x2", "y2")


def build_lanes(appearances: DataFrame, signals: DataFrame | None, entity_ranges: DataFrame | None, keys: Sequence[str], fps: float,
                total_frames: Column, fw: float, fh: float, unit: float = 1.0, own: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Lanes of people: segments, seeds, replay both ways, fusing, scale, smoothing, stored form.

    ``appearances``: keys, ``t``, ``f``, ``seq``, box; ``signals``: keys, direction, f, source, score, box. Returns lane rows and
    segments.
    """
    keys = list(keys)
    duration = total_frames / F.lit(fps) * unit
    seg = ranges.lane_segments(appearances, entity_ranges, keys, F.lit(float(fps)), total_frames, duration, "t", unit=unit)
    seg = seg.withColumn("segment", F.col("start_frame"))
    width = 15_000.0  # frames per bucket of the frame-in-segment join
    as_ranges = seg.select(*keys, "segment", F.col("start_frame").alias("start"), F.col("end_frame").alias("end"))
    # without what cannot meet a range: else Spark infers that filter later, and not alike for all who read the anchors
    seen = lanes.without_nulls(appearances.select(*keys, "f", "seq", *Box._fields), [*keys, "f"])
    anchors = ranges.points_in_ranges(seen, as_ranges, keys, "f", width)
    k = [*keys, "segment"]
    # the one shuffle of the anchors: seeds, pins and replay go on where it puts them
    anchors = spread(anchors.select(*k, "f", "seq", *Box._fields), *k)
    # one seed per direction replaces the other candidates of the first and last anchor frame
    pins, rival = anchors, F.lit(False)
    for n, forward in enumerate((True, False)):
        seed = lanes.choose_seed(anchors, k, own, forward=forward)
        pins = pins.join(seed.select(*k, F.col("f").alias(f"__f{n}"), F.col("seq").alias(f"__seq{n}")), k, "left")
        rival = rival | F.coalesce((F.col("f") == F.col(f"__f{n}")) & (F.col("seq") != F.col(f"__seq{n}")), F.lit(False))
    pins = pins.where(~rival).select(*anchors.columns)
    sig = None
    if signals is not None:
        sig = ranges.points_in_ranges(signals, as_ranges, keys, "f", width).drop("start", "end")
    # frames are laid out in the stage that replays them and leave it as lane rows: none of them is shuffled or stored
    frames = lanes.replay_frames(seg, pins, sig, keys, grid=False)
    fwd = lanes.replay_tracks(frames, k, fw, fh, direction=1)
    bwd = lanes.replay_tracks(frames, k, fw, fh, direction=-1)
    fused = lanes.fuse_lanes(fwd, bwd, k, fw, fh)
    stable = lanes.stabilize_scale(fused, k, fw, fh)
    smooth = lanes.smooth_bidirectional(stable, k, 0.5, fw, fh)
    return lanes.serialize_lane(smooth, keys, fps, fw, fh), seg


def normalize_privacy(payloads: DataFrame, keys: Sequence[str], payload: str = "payload", finder: str = "Analysis") -> dict[str, DataFrame]:
    """Raw payload text to events, actions and summary."""
    rows = privacy.privacy_rows(privacy.explode_segments(payloads, keys, payload), keys)
    kept = checkpoint(privacy.keep_privacy_target(rows))  # the merge reads it several times; payloads are parsed once
    merged = privacy.merge_events(kept, keys)
    events, actions = privacy.merge_actions(merged, keys)
    cut = {"label": 120, "description": 600, "reason": 600, "inclusion_reason": 600, "handling_note": 220, "redaction_target": 120,
           "scene_role": 120, "redaction_decision": 120, "subject_selection": 120}
    shown = events.withColumns({c: F.substring(c, 1, n) for c, n in cut.items()}).withColumn("review_required", F.lit(True))
    summary = privacy.with_quiet(privacy.risk_summary(events, keys, finder), payloads, keys, finder)
    return {"events": shown, "actions": actions, "summary": summary}
