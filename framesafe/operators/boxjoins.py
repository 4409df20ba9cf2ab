"""Joins and folds on boxes of one frame.

Every pair join starts from equal keys (job, frame[, kind]); the geometry is the residual test.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import boxes as B
from ..functions.boxes import Box, box, box_of
from ..functions.scalars import FORENSIC_CLASSES, norm_class
from .matching import greedy_match, suppress

# Fixed values: (min side, min sharpness, min confidence) per detection preset.
QUALITY = {
    "normal": (30.0, 10.0, 0.35),
    "small": (10.0, 3.0, 0.2),
    "reverse": (8.0, 2.0, 0.16),
    "upload": (22.0, 3.25, 0.22),
}


def quality_filter(df: DataFrame, preset: str = "normal") -> DataFrame:
    side, sharp, conf = QUALITY[preset]
    b = box()
    return df.where(
        (b.x2 - b.x1 >= side)
        & (b.y2 - b.y1 >= side)
        & (F.coalesce("sharpness", F.lit(float("inf"))) >= sharp)
        & (F.col("det_score") >= conf)
    )


def class_filter(df: DataFrame, classes: Sequence[str] | DataFrame | None = None, col: str = "identification") -> DataFrame:
    """Rows of the wanted classes; a table of classes is a semi join, none means the forensic list."""
    if isinstance(classes, DataFrame):
        want = classes.select(norm_class(classes.columns[0]).alias("__class")).distinct()
        return df.withColumn("__class", norm_class(col)).join(want, "__class", "left_semi").drop("__class")
    names = sorted({c.strip().lower() for c in (classes or FORENSIC_CLASSES)})
    return df.where(norm_class(col).isin(names))


def filter_selected(dets: DataFrame, persons: DataFrame, classes: DataFrame, on: Sequence[str]) -> DataFrame:
    """Detections of selected people or object classes of their job; a job without selection keeps all.

    Tracked faces that carry no person yet stay when the job selects any person.
    """
    on = list(on)
    p = persons.select(*on, F.trim("person_id").alias("__pid")).where("__pid <> ''").distinct()
    c = classes.select(*on, norm_class("object_class").alias("__cls")).where("__cls <> ''").distinct()
    has_p = p.select(*on).distinct().withColumn("__has_p", F.lit(True))
    has_c = c.select(*on).distinct().withColumn("__has_c", F.lit(True))
    d = (
        dets.withColumn("__pid", F.trim(F.coalesce("person_id", F.lit(""))))
        .withColumn("__cls", norm_class("object_class"))
        .join(p.withColumn("__is_p", F.lit(True)), [*on, "__pid"], "left")
        .join(c.withColumn("__is_c", F.lit(True)), [*on, "__cls"], "left")
        .join(has_p, on, "left")
        .join(has_c, on, "left")
    )
    face = (F.lower(F.trim("kind")) == "face") & F.col("__has_p").isNotNull()
    face = face & (F.col("__is_p").isNotNull() | ((F.col("__pid") == "") & F.col("track_id").isNotNull()))
    thing = (F.lower(F.trim("kind")) == "object") & F.col("__is_c").isNotNull()
    everything = F.col("__has_p").isNull() & F.col("__has_c").isNull()
    return d.where(everything | face | thing).select(*dets.columns)


# -- pairs -----------------------------------------------------------------------------------


def _prefixed(df: DataFrame, on: Sequence[str], p: str) -> DataFrame:
    return df.select(*on, *(F.col(c).alias(p + c) for c in df.columns if c not in on))


def overlap_pairs(a: DataFrame, b: DataFrame, on: Sequence[str], left_id: str = "seq", right_id: str = "seq",
                  min_iou: float = 0.0, strict: bool = True, cell: float = 256.0) -> DataFrame:
    """Pairs of overlapping boxes with their IoU.

    Boxes go into the grid cells they touch and meet only inside a cell, so a crowded frame is split by
    place. A pair counts in the one cell that holds the corner of its intersection.
    """

    def cells(df: DataFrame, p: str, ident: str) -> DataFrame:
        g = lambda c: F.floor(F.col(c) / F.lit(cell)).cast("int")
        d = df.select(*on, F.col(ident).alias(f"{p}id"), *(F.col(c).alias(f"{p}{c}") for c in Box._fields))
        d = d.withColumn("__cx", F.explode(F.sequence(g(f"{p}x1"), g(f"{p}x2"))))
        return d.withColumn("__cy", F.explode(F.sequence(g(f"{p}y1"), g(f"{p}y2"))))

    j = cells(a, "left_", left_id).join(cells(b, "right_", right_id), [*on, "__cx", "__cy"])
    l, r = box("left_"), box("right_")
    home = (F.floor(F.greatest(l.x1, r.x1) / cell) == F.col("__cx")) & (F.floor(F.greatest(l.y1, r.y1) / cell) == F.col("__cy"))
    iou = B.box_iou(l, r)
    test = (iou > min_iou) if strict else (iou >= min_iou)
    return j.where(home & test).select(*on, "left_id", "right_id", iou.alias("iou"))


def _near_focus(c: Box, p: Box, floor: float = 1.0) -> Column:
    """The loose test: a share of either box covered, or centres close."""
    ca, pa = F.greatest(B.box_area(c), F.lit(floor)), F.greatest(B.box_area(p), F.lit(floor))
    cd, pd = F.greatest(B.box_diag(c), F.lit(floor)), F.greatest(B.box_diag(p), F.lit(floor))
    inter = B.box_inter(c, p)
    return (
        (B.box_iou(c, p) >= 0.05)
        | (inter / ca >= 0.18)
        | (inter / pa >= 0.18)
        | (B.box_center_dist(c, p) <= F.greatest(cd * 0.65, pd * 0.55))
    )


def is_preserved(c: Box, p: Box, variant: str = "export", floor: float = 1.0) -> Column:
    """The protected face itself: covered, overlapping or centred on the preserve box.

    The ``live`` variant works on normalised boxes and has no test without overlap.
    """
    floor = 1e-6 if variant == "live" else floor
    ca, pa = F.greatest(B.box_area(c), F.lit(floor)), F.greatest(B.box_area(p), F.lit(floor))
    cd, pd = F.greatest(B.box_diag(c), F.lit(floor)), F.greatest(B.box_diag(p), F.lit(floor))
    inter, dist = B.box_inter(c, p), B.box_center_dist(c, p)
    iou = inter / F.greatest(F.lit(floor), ca + pa - inter) if variant == "export" else B.box_iou(c, p)
    touching = (inter > 0) & (dist <= F.greatest(cd * 0.52, pd * 0.42))
    out = (inter > 0) & ((iou >= 0.10) | (inter / ca >= 0.42))
    out = out | touching
    if variant == "export":
        out = out | (dist <= F.least(cd, pd) * 0.42)
    return out


def _theta_anti(boxes: DataFrame, preserve: DataFrame, on: Sequence[str], test) -> DataFrame:
    p = preserve.select(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(on)), *(F.col(c).alias(f"__p_{c}") for c in Box._fields))
    cond = test(box(), box("__p_"))
    for i, k in enumerate(on):
        cond = cond & (F.col(k) == F.col(f"__k{i}"))
    return boxes.join(p, cond, "left_anti")


def _faces_only(test, kind: str | None):
    return test if kind is None else (lambda c, p: test(c, p) & (F.lower(F.col(kind)) == "face"))


def anti_preserved(boxes: DataFrame, preserve: DataFrame, on: Sequence[str], kind: str | None = "kind",
                   variant: str = "export") -> DataFrame:
    """Boxes that are not the preserved face of their frame; only faces are ever dropped."""
    return _theta_anti(boxes, preserve, on, _faces_only(lambda c, p: is_preserved(c, p, variant), kind))


def drop_focus_any(boxes: DataFrame, preserve: DataFrame, on: Sequence[str], kind: str | None = "kind") -> DataFrame:
    """Drop every face near any preserve box, strict or loose test."""
    return _theta_anti(boxes, preserve, on, _faces_only(lambda c, p: is_preserved(c, p) | _near_focus(c, p), kind))


def focus_score(c: Box, p: Box, floor: float = 1.0) -> Column:
    ca, pa = F.greatest(B.box_area(c), F.lit(floor)), F.greatest(B.box_area(p), F.lit(floor))
    diag = F.greatest(B.box_diag(c), B.box_diag(p), F.lit(floor))
    inter = B.box_inter(c, p)
    return B.box_iou(c, p) * 5.0 + inter / ca * 2.0 + inter / pa - B.box_center_dist(c, p) / diag


def drop_focus_best(boxes: DataFrame, preserve: DataFrame, on: Sequence[str], seq: str = "seq",
                    preserve_pos: str = "pos", kind: str | None = "kind", floor: float = 1.0,
                    digits: int | None = None) -> DataFrame:
    """Each preserve box, in order, removes the best remaining face near it.

    That is a greedy matching ordered by (preserve position, −score, box). ``digits`` rounds the scores
    before comparing them.
    """
    p = preserve.select(*on, preserve_pos, *(F.col(c).alias(f"__p_{c}") for c in Box._fields))
    cand = boxes if kind is None else boxes.where(F.lower(F.col(kind)) == "face")
    j = cand.select(*on, seq, *Box._fields).join(p, list(on))
    c, q = box(), box("__p_")
    score = focus_score(c, q, floor)
    score = F.round(score, digits) if digits is not None else score
    pairs = j.where(_near_focus(c, q, floor)).select(*on, seq, preserve_pos, score.alias("score"))
    taken = greedy_match(pairs, on, preserve_pos, seq, [F.col(preserve_pos), -F.col("score"), F.col(seq)])
    return boxes.join(taken.select(*on, seq), [*on, seq], "left_anti").select(*boxes.columns)


# -- one best partner ------------------------------------------------------------------------


def attach_embeddings(boxes: DataFrame, embs: DataFrame, on: Sequence[str], box_id: str = "seq", emb_id: str = "emb_id",
                      value: str = "embedding", min_iou: float = 0.3) -> tuple[DataFrame, DataFrame]:
    """Boxes with the embedding of best IoU above ``min_iou`` (earliest wins ties), and unclaimed embeddings."""
    e = _prefixed(embs, on, "__e_")
    pair = boxes.select(*on, box_id, *Box._fields).join(e, list(on))
    iou = B.box_iou(box(), box("__e_"))
    usable = pair.where((iou > min_iou) & F.col(f"__e_{value}").isNotNull())
    best = usable.groupBy(*on, box_id).agg(
        F.max(F.struct(iou.alias("iou"), (-F.col(f"__e_{emb_id}")).alias("first"))).alias("__m")
    )
    best = best.select(*on, box_id, F.col("__m.iou").alias("match_iou"), (-F.col("__m.first")).alias("match_id"))
    payload = embs.select(*on, F.col(emb_id).alias("match_id"), F.col(value))
    attached = boxes.join(best, [*on, box_id], "left").join(payload, [*on, "match_id"], "left")
    claimed = best.select(*on, F.col("match_id").alias(emb_id))
    free = embs.where(F.col(value).isNotNull()).join(claimed, [*on, emb_id], "left_anti")
    return attached, free


def unclaimed(free: DataFrame, min_side: float = 30.0) -> DataFrame:
    b = box()
    return free.where((b.x2 - b.x1 >= min_side) & (b.y2 - b.y1 >= min_side))


def _best_and_margin(df: DataFrame, keys: Sequence[str], score: Column, order: Column, payload: Sequence[str]) -> DataFrame:
    """Best row per key with the score of the runner-up, rows with a null score left out.

    A fold of two maxima, combined on the map side: the second is the best of all rows but the first.
    """
    row = F.when(score.isNotNull(), F.struct(score.alias("score"), (-order).alias("first"), *payload))
    best = df.groupBy(*keys).agg(F.max(row).alias("best")).where(F.col("best").isNotNull())
    rest = df.withColumn("__s", score).join(best.select(*keys, F.col("best.first").alias("__f")), list(keys))
    second = rest.groupBy(*keys).agg(F.max(F.when(-order != F.col("__f"), F.col("__s"))).alias("second"))
    return best.join(second, list(keys), "left")


def relock(cands: DataFrame, anchors: DataFrame, on: Sequence[str], tol: float = 0.55, fallback: bool = False,
           seq: str = "seq") -> DataFrame:
    """Find a known face again inside its search window.

    ``cands``: ``on`` keys, ``seq``, box, ``det_score``, ``embedding`` (may be null). ``anchors``: keys, box
    (the preferred box, may be null) and ``encoding`` (may be null). Identity wins; without it the geometry
    fallback needs an isolated, close candidate. Adds ``match_score``.
    """
    from .identity import cosine

    a = _prefixed(anchors, on, "__a_")
    j = cands.select(*on, seq, *Box._fields, "det_score", "embedding").join(a, list(on))
    b, ref = box(), box("__a_")
    known = ref.x1.isNotNull()
    overlap = B.box_iou(b, ref)
    center = F.when(known, B.center_ratio(b, ref)).otherwise(0.0)
    area = F.when(known, B.log_area_gap(b, ref)).otherwise(0.0)
    geometry = F.col("det_score") * 1.65 + overlap * 4.1 - center * 1.45 - area * 0.45
    sim = cosine(F.col("embedding"), F.col("__a_encoding"))
    j = j.withColumns({"__g": geometry, "__overlap": overlap, "__center": center, "__area": area, "__sim": sim})
    body = [*Box._fields, "det_score", "__overlap", "__center", "__area", "__sim", F.col("__a_encoding").isNotNull().alias("__known")]

    def top(df: DataFrame, score: Column) -> DataFrame:
        return _best_and_margin(df, on, score, F.col(seq), body)

    ident = top(j.where(F.col("__sim") >= 1.0 - tol), F.col("__g") + F.col("__sim") * 5.0)

    def shaped(df: DataFrame, match: Column) -> DataFrame:
        return df.select(*on, (-F.col("best.first")).alias(seq), *(F.col(f"best.{c}").alias(c) for c in Box._fields),
                         F.bround("best.det_score", 4).alias("det_score"), F.bround(match, 4).alias("match_score"))

    found = shaped(ident, F.col("best.__sim"))
    if not fallback:
        return found
    g = top(j, F.col("__g"))
    isolated = F.col("second").isNull() | (F.col("best.score") - F.col("second") >= 0.85)
    close = ((F.col("best.__overlap") >= 0.48) | (F.col("best.__center") <= 0.16)) & (F.col("best.__area") <= 0.9)
    with_vec = F.col("best.__known") & isolated & close
    without = ~F.col("best.__known") & ((F.col("best.__overlap") >= 0.34) | (F.col("best.__center") <= 0.24))
    weak = shaped(g.where(with_vec | without), F.greatest(F.lit(0.12), F.least(F.lit(0.74), F.col("best.__overlap") * 0.42 + 0.18)))
    return found.unionByName(weak.join(found.select(*on), list(on), "left_anti"))


def best_head(persons: DataFrame, anchors: DataFrame, on: Sequence[str], fw, fh, strict: bool = True,
              seq: str = "seq") -> DataFrame:
    """Head near the expected place, from person boxes; an unclear choice gives no row.

    ``anchors``: keys, ``s_x1..`` search box and ``p_x1..`` preferred box (may be null).
    """
    j = persons.select(*on, seq, *Box._fields, "det_score").join(anchors, list(on))
    # one projection per step: each box is computed once and then read as plain columns
    put = lambda df, p, b: df.withColumns({p + n: c for n, c in zip(Box._fields, b)})
    j = put(put(j, "w_", B.valid_box(box("s_"), "frame", fw, fh)), "v_", B.valid_box(box("p_"), "frame", fw, fh))
    j = put(j, "r_", B.choose(F.col("v_x1").isNull(), box("w_"), box("v_")))
    j = put(j, "q_", B.valid_box(box(), "frame", fw, fh))
    j = put(j, "g_", B.head_from_person(box("q_"), fw, fh))
    j = put(j, "e_", B.fit_head(box("g_"), box("r_"), fw, fh))
    j = put(j, "h_", B.choose(F.col("p_x1").isNull(), box("g_"), box("e_")))
    h, p, s, q = box("h_"), box("r_"), box("w_"), box("q_")
    hs, ps, pi = B.box_iou(h, s), B.box_iou(q, s), B.box_iou(h, p)
    sc, pc, area = B.center_ratio(h, s), B.center_ratio(h, p), B.log_area_gap(h, p)
    max_s, max_p = (0.78, 0.72) if strict else (1.05, 1.0)
    ok = ~((hs < 0.02) & (ps < 0.02) & (sc > max_s)) & ~((pi < 0.03) & (pc > max_p))
    if strict:
        ok = ok & ~((area > 1.25) & (pi < 0.08))
    score = F.col("det_score") * 1.4 + pi * 4.2 + hs * 2.0 + ps * 0.6 - pc * 1.55 - sc * 0.55 - area * 0.28
    # no filter on computed boxes: it would be pushed down and the boxes computed over and over
    usable = F.col("h_x1").isNotNull() & F.col("w_x1").isNotNull() & ok
    j = j.withColumn("__score", F.when(usable, score))
    best = _best_and_margin(j, on, F.col("__score"), F.col(seq), ["h_x1", "h_y1", "h_x2", "h_y2", "det_score"])
    if strict:
        best = best.where(F.col("second").isNull() | (F.col("best.score") - F.col("second") >= 0.45))
    return best.select(*on, (-F.col("best.first")).alias(seq), *(F.col(f"best.h_{n}").alias(n) for n in Box._fields),
                       F.bround("best.det_score", 4).alias("det_score"), F.col("best.score").alias("geometry_score"))


def best_face(cands: DataFrame, search: DataFrame, on: Sequence[str], seq: str = "seq") -> DataFrame:
    """Best detection in a search box (``s_``), near the preferred box (``p_``) when there is one."""
    j = cands.select(*on, seq, *Box._fields, "det_score").join(search, list(on))
    b, s, p = box(), box("s_"), box("p_")
    near = B.box_iou(b, p) * 4.0 - B.center_ratio(b, p) * 1.35 - B.log_area_gap(b, p) * 0.35
    score = F.col("det_score") * 2.0 + B.box_area(b) / F.greatest(B.box_area(s), F.lit(1.0)) * 0.2
    score = score + F.when(p.x1.isNotNull(), near).otherwise(0.0)
    top = j.groupBy(*on).agg(F.max(F.struct(score.alias("score"), (-F.col(seq)).alias("first"), *Box._fields)).alias("m"))
    return top.select(*on, (-F.col("m.first")).alias(seq), *(F.col(f"m.{n}").alias(n) for n in Box._fields), F.col("m.score").alias("score"))


def localize_known(anchored: DataFrame, identified: DataFrame, on: Sequence[str], person: str = "person_id",
                   order: str = "person_pos", thr: float = 0.72) -> DataFrame:
    """Known faces of a frame: the anchor result first, full-frame identity for the rest, then ordered
    suppression. ``anchored`` carries the ``gap`` to its anchor, which floors the scores when recent."""
    recent = F.col("gap").isNull() | (F.col("gap") <= 10.0)
    penalty = F.coalesce(F.least(F.lit(0.48), F.greatest(F.lit(0.0), F.col("gap") - 0.25) * 0.07), F.lit(0.0))
    lifted = anchored.withColumns({
        "match_score": F.when(recent, F.bround(F.greatest("match_score", F.lit(0.98) - penalty), 4)).otherwise(F.col("match_score")),
        "det_score": F.when(recent, F.greatest("det_score", F.lit(0.34))).otherwise(F.col("det_score")),
    })
    cols = [*on, person, order, *Box._fields, "match_score", "det_score"]
    rest = identified.join(anchored.select(*on, person), [*on, person], "left_anti")
    return suppress(lifted.select(*cols).unionByName(rest.select(*cols)), on, order, thr)


# -- detections and tracks -------------------------------------------------------------------


def associate(dets: DataFrame, tracks: DataFrame, on: Sequence[str], det: str = "det_id", track: str = "track_id",
              digits: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Matches, unmatched detections and unmatched tracks of a frame. ``on`` includes the kind."""
    t = _prefixed(tracks, on, "__t_").withColumnRenamed(f"__t_{track}", track)
    j = dets.select(*on, det, "person_id", *Box._fields).join(t, list(on))
    d, p = F.nullif("person_id", F.lit("")), F.nullif("__t_person_id", F.lit(""))
    same = F.coalesce(d == p, F.lit(False))
    conflict = F.coalesce(d != p, F.lit(False))
    b, tb = box(), box("__t_")
    iou, ratio = B.box_iou(b, tb), B.center_ratio(b, tb)
    score = F.when(same, 3.0).otherwise(0.0) + iou * 2.5 - ratio
    score = F.round(score, digits) if digits is not None else score
    pairs = j.where(~conflict & (same | (iou >= 0.28) | (ratio <= 0.5))).select(*on, det, track, score.alias("score"))
    won = greedy_match(pairs, on, det, track, [-F.col("score"), F.col(det), F.col(track)])
    return won, dets.join(won, [*on, det], "left_anti"), tracks.join(won, [*on, track], "left_anti")


def live_match(prefix_a: str = "t_", prefix_b: str = "d_") -> Column:
    """Score of a tracked box against a detection (normalised x, y, width, height), null when they cannot match."""
    a = {n: F.col(prefix_a + n) for n in ("x", "y", "width", "height")}
    b = {n: F.col(prefix_b + n) for n in ("x", "y", "width", "height")}
    ba = Box(a["x"], a["y"], a["x"] + a["width"], a["y"] + a["height"])
    bb = Box(b["x"], b["y"], b["x"] + b["width"], b["y"] + b["height"])
    c = lambda p, n: F.nullif(F.col(p + n), F.lit(""))
    kind_a, kind_b = F.col(prefix_a + "kind"), F.col(prefix_b + "kind")
    face = kind_a == "face"
    pa, pb = c(prefix_a, "person_id"), c(prefix_b, "person_id")
    clash = (kind_a != kind_b) | (face & F.coalesce(pa != pb, F.lit(False)))
    clash = clash | (~face & ~F.col(prefix_a + "label").eqNullSafe(F.col(prefix_b + "label")))
    strength = F.greatest(F.lit(0.0), F.coalesce(F.col(prefix_a + "motion_strength"), F.lit(0.0)))
    iou, dist = B.box_iou(ba, bb), B.box_center_dist(ba, bb)
    limit = F.when(kind_b == "face", 0.16).otherwise(0.22) + F.least(F.lit(0.24), strength * 3.0)
    limit = limit + F.when(F.col(prefix_a + "tracking_mode") == "global", 0.05).otherwise(0.0)
    ratio = B.size_ratio(ba, bb, 1e-6)
    bonus = F.when(face & pa.isNotNull() & pb.isNotNull(), 4.0)
    both_cls = c(prefix_a, "object_class").isNotNull() & c(prefix_b, "object_class").isNotNull()
    bonus = bonus.when((kind_a == "object") & both_cls, 2.0).otherwise(0.0)
    score = bonus + iou * 5.0 - dist * 1.2 - (ratio - 1.0) * 0.2 + F.least(F.lit(0.28), strength * 0.9)
    bad = clash | ((iou < 0.04) & (dist > limit)) | ((ratio > 3.0) & (iou < 0.08))
    return F.when(~bad, score)


def blend_boxes(prefix_a: str = "t_", prefix_b: str = "d_") -> dict[str, Column]:
    """The detection pulled toward its track: x, y, width, height (6 digits) and confidence (4 digits)."""
    strength = F.greatest(F.lit(0.0), F.coalesce(F.col(prefix_a + "motion_strength"), F.lit(0.0)))
    alpha = F.least(
        F.lit(0.86),
        F.lit(0.62) + F.least(F.lit(0.18), strength * 1.6) + F.when(F.col(prefix_a + "tracking_mode") == "global", 0.08).otherwise(0.0),
    )
    someone = F.coalesce(F.nullif(F.col(prefix_b + "person_id"), F.lit("")), F.nullif(F.col(prefix_a + "person_id"), F.lit("")))
    floor = F.when(someone.isNotNull(), 0.88).otherwise(0.78)
    alpha = F.when(F.col(prefix_b + "kind") == "face", F.greatest(alpha, floor)).otherwise(alpha)
    out = {
        n: F.bround(F.col(prefix_a + n) * (1 - alpha) + F.col(prefix_b + n) * alpha, 6)
        for n in ("x", "y", "width", "height")
    }
    out["confidence"] = F.bround(F.greatest(F.col(prefix_a + "confidence"), F.col(prefix_b + "confidence")), 4)
    return out


# -- fusing ----------------------------------------------------------------------------------


def fuse_boxes(cands: DataFrame, keys: Sequence[str], fw: float, fh: float, order: str = "source_pos") -> DataFrame:
    """Weighted mean of the candidate boxes of a frame that agree with the heaviest one."""
    valid = cands.where((F.col("weight") > 0) & F.col("x1").isNotNull())
    anchor = valid.groupBy(*keys).agg(
        F.max(F.struct("weight", (-F.col(order)).alias("first"), *Box._fields)).alias("__a")
    )
    anchor = anchor.select(*keys, *(F.col(f"__a.{n}").alias(f"__a_{n}") for n in Box._fields))
    j = valid.join(anchor, list(keys))
    b, a = box(), box("__a_")
    agree = (B.box_iou(b, a) >= 0.18) | (B.box_center_dist(b, a) <= F.greatest(B.box_diag(a), F.lit(1.0)) * 0.7)
    st = B.box_state(b)
    w = F.col("weight")
    g = j.where(agree).groupBy(*keys).agg(
        *(F.sum(st[n] * w).alias(f"__s_{n}") for n in ("cx", "cy", "w", "h")),
        F.sum(w).alias("__w"),
        F.count(F.lit(1)).alias("members"),
        *(F.first(f"__a_{n}").alias(f"__a_{n}") for n in Box._fields),
    )
    mean = [F.col(f"__s_{n}") / F.col("__w") for n in ("cx", "cy", "w", "h")]
    fused = B.state_box(*mean, fw, fh)
    out = B.choose(fused.x1.isNull(), box("__a_"), fused)
    return g.select(*keys, *out.columns(), "members")


def merge_temporal(dets: DataFrame, keys: Sequence[str], requested: str = "t", sample: str = "sample_time",
                   distinct_faces: bool = False, seq: str = "seq") -> DataFrame:
    """Merge the detections of a burst of samples about a requested time.

    Samples nearest in time go first, the more confident ones before others; each joins the best
    compatible merged detection or starts a new one. A burst is a handful of frames, one array fold.
    """
    dt = F.abs(F.coalesce(F.col(sample), F.col(requested)) - F.col(requested))
    conf = F.coalesce("confidence", F.lit(0.0))
    weight = F.greatest(F.lit(0.05), conf) / (dt * 12.0 + 1.0)
    s = lambda n: F.coalesce(F.col(n).cast("string"), F.lit(""))
    row = F.struct(
        dt.alias("dt"), (-conf).alias("nconf"), F.col(seq).cast("long").alias("seq"), s("kind").alias("kind"),
        s("label").alias("label"), s("person_id").alias("person_id"), s("object_class").alias("object_class"),
        conf.alias("confidence"), weight.alias("w"),
        *(F.col(n).cast("double").alias(n) for n in ("x", "y", "width", "height")),
    )
    lists = dets.groupBy(*keys).agg(F.array_sort(F.collect_list(row)).alias("__rows"))

    def start(d: Column) -> Column:
        return F.struct(
            d["kind"].alias("kind"), d["label"].alias("label"), d["person_id"].alias("person_id"),
            d["object_class"].alias("object_class"), d["confidence"].alias("confidence"), d["w"].alias("sw"),
            *((d[n] * d["w"]).alias(f"s_{n}") for n in ("x", "y", "width", "height")), F.lit(1).alias("members"),
        )

    def mean(g: Column, n: str) -> Column:
        return g[f"s_{n}"] / g["sw"]

    def score(g: Column, d: Column) -> Column:
        gb = Box(mean(g, "x"), mean(g, "y"), mean(g, "x") + mean(g, "width"), mean(g, "y") + mean(g, "height"))
        db = Box(d["x"], d["y"], d["x"] + d["width"], d["y"] + d["height"])
        iou, dist = B.box_iou(gb, db), B.box_center_dist(gb, db)
        face = d["kind"] == "face"
        differ = lambda n: (g[n] != "") & (d[n] != "") & (g[n] != d[n])
        bad = (g["kind"] != d["kind"]) | (face & differ("person_id"))
        bad = bad | ((d["kind"] == "object") & ((g["label"] != d["label"]) | differ("object_class")))
        if distinct_faces:
            diag = F.least(F.greatest(B.box_diag(gb), F.lit(1e-6)), F.greatest(B.box_diag(db), F.lit(1e-6)))
            bad = bad | (face & (iou < 0.35) & (dist > F.greatest(F.lit(0.025), diag * 0.45)))
        bad = bad | ((iou < 0.05) & (dist > F.when(face, 0.18).otherwise(0.24)))
        return F.when(~bad, iou * 4.0 - dist)

    def step(acc: Column, d: Column) -> Column:
        scored = F.transform(acc, lambda g, i: F.struct(score(g, d).alias("s"), (-i).alias("i")))
        best = F.array_max(F.filter(scored, lambda x: x["s"].isNotNull()))
        joined = F.transform(
            acc,
            lambda g, i: F.when(
                i == -best["i"],
                F.struct(
                    *(g[n].alias(n) for n in ("kind", "label", "person_id", "object_class")),
                    F.greatest(g["confidence"], d["confidence"]).alias("confidence"),
                    (g["sw"] + d["w"]).alias("sw"),
                    *((g[f"s_{n}"] + d[n] * d["w"]).alias(f"s_{n}") for n in ("x", "y", "width", "height")),
                    (g["members"] + 1).alias("members"),
                ),
            ).otherwise(g),
        )
        return F.when(best.isNull(), F.array_append(acc, start(d))).otherwise(joined)

    zero = "array<struct<kind:string,label:string,person_id:string,object_class:string,confidence:double,sw:double,s_x:double,s_y:double,s_width:double,s_height:double,members:int>>"
    folded = lists.select(*keys, F.posexplode(F.aggregate("__rows", F.array().cast(zero), step)).alias("pos", "g"))
    g = F.col("g")
    return folded.select(
        *keys,
        F.concat(g["kind"], F.lit("-"), F.col("pos").cast("string")).alias("id"),
        *(g[n].alias(n) for n in ("kind", "label", "person_id", "object_class")),
        F.bround(g["confidence"], 4).alias("confidence"),
        *(F.bround(mean(g, n), 6).alias(n) for n in ("x", "y", "width", "height")),
        g["members"].alias("members"),
    )
