"""Boxes: geometry, pair joins, preserved faces, association, fusing, suppression."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import boxes as B
from ..functions.boxes import box
from ..operators import boxjoins, matching
from .bindings import DET, det
from .registry import query

VS = ["video_id", "sec"]
BOX = ["x1", "y1", "x2", "y2"]
INTER = "greatest(0.0, least(a.x2,b.x2)-greatest(a.x1,b.x1))*greatest(0.0, least(a.y2,b.y2)-greatest(a.y1,b.y1))"
AREA_A, AREA_B = "((a.x2-a.x1)*(a.y2-a.y1))", "((b.x2-b.x1)*(b.y2-b.y1))"
DIAG_A, DIAG_B = "sqrt((a.x2-a.x1)*(a.x2-a.x1)+(a.y2-a.y1)*(a.y2-a.y1))", "sqrt((b.x2-b.x1)*(b.x2-b.x1)+(b.y2-b.y1)*(b.y2-b.y1))"
DIST = "sqrt(((a.x1+a.x2)/2-(b.x1+b.x2)/2)*((a.x1+a.x2)/2-(b.x1+b.x2)/2)+((a.y1+a.y2)/2-(b.y1+b.y2)/2)*((a.y1+a.y2)/2-(b.y1+b.y2)/2))"
IOU = f"(CASE WHEN {AREA_A}+{AREA_B}-({INTER}) > 0 THEN ({INTER})/({AREA_A}+{AREA_B}-({INTER})) ELSE 0 END)"
STRICT = f"({DIST} <= least({DIAG_A},{DIAG_B})*0.42 OR {IOU} >= 0.10 OR ({INTER})/{AREA_A} >= 0.42 OR (({INTER}) > 0 AND {DIST} <= greatest({DIAG_A}*0.52, {DIAG_B}*0.42)))"
LOOSE = f"({IOU} >= 0.05 OR ({INTER})/{AREA_A} >= 0.18 OR ({INTER})/{AREA_B} >= 0.18 OR {DIST} <= greatest({DIAG_A}*0.65, {DIAG_B}*0.55))"


def greedy_sql(pairs: str, group: str, left: str, right: str, order: str, out: str) -> str:
    """Recursive CTE that walks the ordered pairs of every group and keeps the free ones."""
    used = f"(list_contains(ul, p.{left}) OR list_contains(ur, p.{right}))"
    return f"""{out}_p AS (SELECT *, hash({group}) AS g, row_number() OVER (PARTITION BY {group} ORDER BY {order}) AS rn FROM {pairs}),
{out}_r AS (SELECT DISTINCT g, CAST(0 AS BIGINT) AS rn, CAST([] AS BIGINT[]) AS ul, CAST([] AS BIGINT[]) AS ur, FALSE AS ok FROM {out}_p
  UNION ALL SELECT r.g, p.rn, CASE WHEN {used} THEN ul ELSE list_append(ul, p.{left}) END, CASE WHEN {used} THEN ur ELSE list_append(ur, p.{right}) END, NOT {used}
  FROM {out}_r r JOIN {out}_p p ON p.g = r.g AND p.rn = r.rn + 1),
{out} AS (SELECT p.* FROM {out}_p p JOIN {out}_r r ON r.g = p.g AND r.rn = p.rn WHERE r.ok)"""


@query("box_overlap_pairs", f"""
WITH {DET} SELECT a.video_id, a.sec, a.seq AS left_id, b.seq AS right_id, round({IOU} + 1e-9, 6) AS iou FROM det a JOIN det b ON a.video_id=b.video_id AND a.sec=b.sec AND a.seq < b.seq WHERE ({INTER}) > 0""")  # fmt: skip
def box_overlap_pairs(spark, sf):
    d = det(spark, sf)
    p = boxjoins.overlap_pairs(d, d, VS).where("left_id < right_id")
    return p.withColumn("iou", F.round(F.col("iou") + 1e-9, 6))


@query("preserved_anti", f"WITH {DET} SELECT seq FROM det a WHERE kind='face' AND NOT EXISTS (SELECT 1 FROM det b WHERE b.kind='object' AND a.video_id=b.video_id AND a.sec=b.sec AND {STRICT})")
def preserved_anti(spark, sf):
    d = det(spark, sf)
    return boxjoins.anti_preserved(d.where("kind = 'face'"), d.where("kind = 'object'"), VS).select("seq")


@query("focus_any", f"WITH {DET} SELECT seq FROM det a WHERE kind='face' AND NOT EXISTS (SELECT 1 FROM det b WHERE b.kind='object' AND a.video_id=b.video_id AND a.sec=b.sec AND ({STRICT} OR {LOOSE}))")
def focus_any(spark, sf):
    d = det(spark, sf)
    return boxjoins.drop_focus_any(d.where("kind = 'face'"), d.where("kind = 'object'"), VS).select("seq")


@query("focus_best", f"""
WITH RECURSIVE {DET}, pr AS (SELECT a.video_id, a.sec, a.seq, b.seq AS pos, round({IOU}*5 + ({INTER})/{AREA_A}*2 + ({INTER})/{AREA_B} - {DIST}/greatest({DIAG_A},{DIAG_B}), 9) AS score
  FROM det a JOIN det b ON a.video_id=b.video_id AND a.sec=b.sec WHERE a.kind='face' AND b.kind='object' AND {LOOSE}),
{greedy_sql("pr", "video_id, sec", "pos", "seq", "pos, score DESC, seq", "m")}
SELECT seq FROM det WHERE kind='face' AND seq NOT IN (SELECT seq FROM m)""")  # fmt: skip
def focus_best(spark, sf):
    d = det(spark, sf)
    p = d.where("kind = 'object'").select(*VS, F.col("seq").alias("pos"), *BOX)
    return boxjoins.drop_focus_best(d.where("kind = 'face'"), p, VS, digits=9).select("seq")


ATTACH = f"""pr AS (SELECT a.video_id, a.sec, a.seq, b.seq AS emb, {IOU} AS iou FROM det a JOIN det b ON a.video_id=b.video_id AND a.sec=b.sec WHERE a.kind='face' AND b.kind='object' AND {IOU} > 0.3),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY iou DESC, emb) AS rn FROM pr) WHERE rn=1)"""


def attached(spark, sf):
    d = det(spark, sf)
    e = d.where("kind = 'object'").select(*VS, F.col("seq").alias("emb_id"), *BOX, F.col("base_vec").alias("embedding"))
    return boxjoins.attach_embeddings(d.where("kind = 'face'"), e, VS)


@query("attach_embeddings", f"WITH {DET}, {ATTACH} SELECT det.seq, best.emb AS match_id, round(best.iou + 1e-9, 6) AS match_iou, v.base_vec AS embedding FROM det LEFT JOIN best ON best.seq=det.seq LEFT JOIN det v ON v.seq=best.emb WHERE det.kind='face'")
def attach_embeddings(spark, sf):
    a, _ = attached(spark, sf)
    return a.select("seq", "match_id", F.round(F.col("match_iou") + 1e-9, 6).alias("match_iou"), "embedding")


@query("unclaimed_embeddings", f"WITH {DET}, {ATTACH} SELECT seq AS emb_id FROM det WHERE kind='object' AND x2-x1>=30 AND y2-y1>=30 AND seq NOT IN (SELECT emb FROM best)")
def unclaimed_embeddings(spark, sf):
    return boxjoins.unclaimed(attached(spark, sf)[1]).select("emb_id")


ASSOC = f"""d0 AS (SELECT *, CASE WHEN score100 >= 50 THEN person_no END AS pid FROM det),
pr AS (SELECT a.video_id, a.sec, a.kind, a.seq AS det_id, b.seq AS track_id, round(CASE WHEN a.pid=b.pid THEN 3 ELSE 0 END + {IOU}*2.5 - {DIST}/greatest(1.0,{DIAG_B}), 9) AS score
  FROM d0 a JOIN d0 b ON a.video_id=b.video_id AND a.sec=b.sec+1 AND a.kind=b.kind
  WHERE NOT coalesce(a.pid<>b.pid, FALSE) AND (coalesce(a.pid=b.pid, FALSE) OR {IOU} >= 0.28 OR {DIST}/greatest(1.0,{DIAG_B}) <= 0.5)),
{greedy_sql("pr", "video_id, sec, kind", "det_id", "track_id", "score DESC, det_id, track_id", "m")}"""


def association(spark, sf):
    d = det(spark, sf).withColumn("person_id", F.when(F.col("score100") >= 50, F.col("person_no").cast("string")))
    on = [*VS, "kind"]
    dets = d.select(*on, F.col("seq").alias("det_id"), "person_id", *BOX)
    tracks = d.select("video_id", (F.col("sec") + 1).alias("sec"), "kind", F.col("seq").alias("track_id"), "person_id", *BOX)
    return boxjoins.associate(dets, tracks, on, digits=9)


@query("associate_tracks", f"WITH RECURSIVE {DET}, {ASSOC} SELECT det_id, track_id, score FROM m")
def associate_tracks(spark, sf):
    return association(spark, sf)[0].select("det_id", "track_id", "score")


@query("unmatched_detections", f"WITH RECURSIVE {DET}, {ASSOC} SELECT seq AS det_id FROM det WHERE seq NOT IN (SELECT det_id FROM m)")
def unmatched_detections(spark, sf):
    return association(spark, sf)[1].select("det_id")


@query("fuse_boxes", f"""
WITH {DET}, w AS (SELECT *, (score100+1)/100.0::DOUBLE AS wt FROM det), a0 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY video_id, sec ORDER BY wt DESC, seq) AS rn FROM w) WHERE rn=1),
k AS (SELECT a.*, b.x1 AS ax1, b.y1 AS ay1, b.x2 AS ax2, b.y2 AS ay2 FROM w a JOIN a0 b ON a.video_id=b.video_id AND a.sec=b.sec WHERE {IOU} >= 0.18 OR {DIST} <= greatest(1.0,{DIAG_B})*0.7),
g AS (SELECT video_id, sec, count(*) AS members, sum((x1+x2)/2*wt)/sum(wt) AS cx, sum((y1+y2)/2*wt)/sum(wt) AS cy, sum((x2-x1)*wt)/sum(wt) AS bw, sum((y2-y1)*wt)/sum(wt) AS bh FROM k GROUP BY 1, 2)
SELECT video_id, sec, members, round(greatest(0.0,least(1920.0,cx-bw/2)) + 1e-9, 5) AS x1, round(greatest(0.0,least(1080.0,cy-bh/2)) + 1e-9, 5) AS y1, round(greatest(0.0,least(1920.0,cx+bw/2)) + 1e-9, 5) AS x2, round(greatest(0.0,least(1080.0,cy+bh/2)) + 1e-9, 5) AS y2 FROM g""")  # fmt: skip
def fuse_boxes(spark, sf):
    d = det(spark, sf).withColumn("weight", (F.col("score100") + 1) / 100.0)
    f = boxjoins.fuse_boxes(d, VS, 1920, 1080, "seq")
    return f.select(*VS, "members", *(F.round(F.col(c) + 1e-9, 5).alias(c) for c in BOX))


@query("suppress_boxes", f"""
WITH RECURSIVE {DET}, o AS (SELECT *, hash(video_id, sec) AS g, row_number() OVER (PARTITION BY video_id, sec ORDER BY seq) AS rn FROM det),
r AS (SELECT DISTINCT g, CAST(0 AS BIGINT) AS rn, CAST([] AS BIGINT[]) AS kept, FALSE AS ok FROM o
  UNION ALL SELECT r.g, a.rn, CASE WHEN c.n > 0 THEN kept ELSE list_append(kept, a.seq) END, c.n = 0
  FROM r JOIN o a ON a.g=r.g AND a.rn=r.rn+1, LATERAL (SELECT count(*) AS n FROM det b WHERE list_contains(r.kept, b.seq) AND b.video_id=a.video_id AND b.sec=a.sec AND {IOU} > 0.15) c)
SELECT o.video_id, o.sec, o.seq FROM o JOIN r ON r.g=o.g AND r.rn=o.rn WHERE r.ok""")  # fmt: skip
def suppress_boxes(spark, sf):
    return matching.suppress(det(spark, sf).select(*VS, "seq", *BOX), VS, "seq", 0.15).select(*VS, "seq")


@query("best_face", f"""
WITH {DET}, sr AS (SELECT video_id, sec, min(seq) AS seq FROM det WHERE kind='object' GROUP BY 1, 2), b0 AS (SELECT d.* FROM det d JOIN sr ON sr.seq=d.seq),
s AS (SELECT a.video_id, a.sec, a.seq, round(a.score100/100.0::DOUBLE*2 + {AREA_A}/{AREA_B}*0.2 + {IOU}*4 - {DIST}/{DIAG_B}*1.35 - abs(ln({AREA_A}/{AREA_B}))*0.35, 9) AS score FROM det a JOIN b0 b ON a.video_id=b.video_id AND a.sec=b.sec WHERE a.kind='face')
SELECT video_id, sec, seq, round(score + 1e-9, 5) AS score FROM (SELECT *, row_number() OVER (PARTITION BY video_id, sec ORDER BY score DESC, seq) AS rn FROM s) WHERE rn=1""")  # fmt: skip
def best_face(spark, sf):
    d = det(spark, sf)
    s = d.where("kind = 'object'").groupBy(*VS).agg(F.min_by(F.struct(*BOX), "seq").alias("b"))
    s = s.select(*VS, *(F.col(f"b.{c}").alias(f"{p}{c}") for p in ("s_", "p_") for c in BOX))
    c = d.where("kind = 'face'").withColumn("det_score", F.col("score100") / 100.0)
    return boxjoins.best_face(c, s, VS).select(*VS, "seq", F.round(F.col("score") + 1e-9, 5).alias("score"))


@query("best_head")
def best_head(spark, sf):
    d = det(spark, sf)
    s = d.where("kind = 'object'").groupBy(*VS).agg(F.min_by(F.struct(*BOX), "seq").alias("b"))
    wide = {f"s_{c}": F.col(f"b.{c}") + v for c, v in zip(BOX, (-80, -80, 80, 80))}
    s = s.select(*VS, *(v.alias(k) for k, v in wide.items()), *(F.col(f"b.{c}").alias(f"p_{c}") for c in BOX))
    tall = d.where("kind = 'face'").withColumns({"det_score": F.col("score100") / 100.0, "y2": F.col("y2") + 260})
    return boxjoins.best_head(tall, s, VS, 1920, 1080)


def anchored_candidates(spark, sf):
    from .bindings import with_encoding

    d = with_encoding(spark, sf, det(spark, sf))
    cands = d.where("kind = 'face'").select("video_id", "sec", "person_no", "seq", *BOX, (F.col("score100") / 100.0).alias("det_score"), F.col("encoding").alias("embedding"))
    anchors = d.where("kind = 'object'").groupBy("video_id", "sec", "person_no").agg(F.min_by(F.struct(*BOX, "encoding"), "seq").alias("b"))
    return cands, anchors.select("video_id", "sec", "person_no", "b.*")


@query("relock_faces")
def relock_faces(spark, sf):
    cands, anchors = anchored_candidates(spark, sf)
    return boxjoins.relock(cands, anchors, ["video_id", "sec", "person_no"], 0.55, True)


@query("localize_known")
def localize_known(spark, sf):
    cands, anchors = anchored_candidates(spark, sf)
    found = boxjoins.relock(cands, anchors, ["video_id", "sec", "person_no"], 0.55, True)
    a = found.withColumns({"gap": F.lit(0.5), "person_pos": F.col("person_no")})
    every = cands.select("video_id", "sec", "person_no", F.col("person_no").alias("person_pos"), *BOX, F.lit(0.5).alias("match_score"), "det_score")
    i = every.dropDuplicates(["video_id", "sec", "person_no"])
    return boxjoins.localize_known(a, i, VS, "person_no", "person_pos").select("video_id", "sec", "person_no")


@query("live_match", f"""
WITH {DET}, n AS (SELECT *, x1/1920 AS x, y1/1080 AS y, (x2-x1)/1920 AS w, (y2-y1)/1080 AS h, CASE WHEN score100>=50 THEN person_no END AS pid FROM det),
p AS (SELECT a.seq AS track_seq, b.seq AS det_seq, a.kind, a.pid AS ap, b.pid AS bp, a.label AS al, b.label AS bl,
  greatest(0.0,least(a.x+a.w,b.x+b.w)-greatest(a.x,b.x))*greatest(0.0,least(a.y+a.h,b.y+b.h)-greatest(a.y,b.y)) AS it, a.w*a.h AS aa, b.w*b.h AS ba,
  sqrt(power(a.x+a.w/2-b.x-b.w/2,2)+power(a.y+a.h/2-b.y-b.h/2,2)) AS dist FROM n a JOIN n b ON a.video_id=b.video_id AND b.sec=a.sec+1 AND a.kind=b.kind),
q AS (SELECT *, it/(aa+ba-it) AS iou, greatest(aa,ba)/least(aa,ba) AS rt FROM p)
SELECT track_seq, det_seq, round(CASE WHEN kind='face' AND ap IS NOT NULL AND bp IS NOT NULL THEN 4 WHEN kind='object' THEN 2 ELSE 0 END + iou*5 - dist*1.2 - (rt-1)*0.2 + 1e-9, 5) AS score FROM q
WHERE NOT (kind='face' AND coalesce(ap<>bp, FALSE)) AND NOT (kind='object' AND al<>bl) AND NOT (iou<0.04 AND dist > CASE kind WHEN 'face' THEN 0.16 ELSE 0.22 END) AND NOT (rt>3 AND iou<0.08)""")  # fmt: skip
def live_match(spark, sf):
    d = det(spark, sf)
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    n = {"x": F.col("x1") / 1920, "y": F.col("y1") / 1080, "width": w / 1920, "height": h / 1080}
    cols = [
        "seq", "kind", "label", F.when(F.col("score100") >= 50, F.col("person_no").cast("string")).alias("person_id"),
        F.col("label").alias("object_class"), F.lit(0.0).alias("motion_strength"), F.lit("local").alias("tracking_mode"), *(c.alias(k) for k, c in n.items()),
    ]
    a, b = d.select("video_id", (F.col("sec") + 1).alias("sec"), *cols), d.select("video_id", "sec", *cols)
    a = a.select("video_id", "sec", *(F.col(c).alias(f"t_{c}") for c in a.columns[2:])).withColumn("kind", F.col("t_kind"))
    b = b.select("video_id", "sec", *(F.col(c).alias(f"d_{c}") for c in b.columns[2:])).withColumn("kind", F.col("d_kind"))
    j = a.join(b, ["video_id", "sec", "kind"]).withColumn("score", boxjoins.live_match())
    return j.where("score IS NOT NULL").select(F.col("t_seq").alias("track_seq"), F.col("d_seq").alias("det_seq"), F.round(F.col("score") + 1e-9, 5).alias("score"))


@query("merge_temporal")
def merge_temporal(spark, sf):
    d = det(spark, sf)
    n = B.to_norm(box(), 1920, 1080)
    rows = d.select("video_id", "sec", "seq", "kind", "label", F.col("person_no").cast("string").alias("person_id"), F.col("label").alias("object_class"),
                    (F.col("score100") / 100.0).alias("confidence"), (F.col("sec") + 0.5).alias("t"), (F.col("t_ms") / 1000.0).alias("sample_time"),
                    *(c.alias(k) for k, c in n.items()))
    return boxjoins.merge_temporal(rows, VS)


@query("quality_filter", f"WITH {DET} SELECT seq FROM det WHERE x2-x1>=30 AND y2-y1>=30 AND seq % 40 >= 10 AND score100/100.0 >= 0.35")
def quality_filter(spark, sf):
    d = det(spark, sf).withColumns({"det_score": F.col("score100") / 100.0, "sharpness": (F.col("seq") % 40).cast("double")})
    return boxjoins.quality_filter(d, "normal").select("seq")


@query("class_filter", f"WITH {DET} SELECT seq, label FROM det WHERE label IN (SELECT DISTINCT event_type FROM events WHERE event_type <> 'view')")
def class_filter(spark, sf):
    from .bindings import table

    want = table(spark, sf, "events").where("event_type <> 'view'").select(F.upper("event_type").alias("c"))
    return boxjoins.class_filter(det(spark, sf), want, "label").select("seq", "label")


@query("filter_selected", f"""
WITH {DET}, p AS (SELECT DISTINCT video_id, person_no FROM det WHERE score100 >= 99), c AS (SELECT DISTINCT video_id, label FROM det WHERE kind='object' AND score100 >= 100)
SELECT seq FROM det d WHERE (NOT EXISTS (SELECT 1 FROM p WHERE p.video_id=d.video_id) AND NOT EXISTS (SELECT 1 FROM c WHERE c.video_id=d.video_id))
  OR (kind='face' AND EXISTS (SELECT 1 FROM p WHERE p.video_id=d.video_id) AND (score100 < 20 OR EXISTS (SELECT 1 FROM p WHERE p.video_id=d.video_id AND p.person_no=d.person_no)))
  OR (kind='object' AND EXISTS (SELECT 1 FROM c WHERE c.video_id=d.video_id AND c.label=d.label))""")  # fmt: skip
def filter_selected(spark, sf):
    d = det(spark, sf)
    persons = d.where("score100 >= 99").select("video_id", F.col("person_no").cast("string").alias("person_id"))
    classes = d.where("kind = 'object' AND score100 >= 100").select("video_id", F.col("label").alias("object_class"))
    rows = d.select("video_id", "seq", "kind", F.when(F.col("score100") >= 20, F.col("person_no").cast("string")).alias("person_id"),
                    F.when(F.col("kind") == "object", F.col("label")).alias("object_class"), F.col("seq").cast("string").alias("track_id"))
    return boxjoins.filter_selected(rows, persons, classes, ["video_id"]).select("seq")


@query("mask_boxes", f"""
WITH {DET}, m AS (SELECT *, x2-x1 AS w, y2-y1 AS h FROM det WHERE kind='face'),
p AS (SELECT *, greatest(0.0, round_even(x1-w*0.10,0)) AS px1, greatest(0.0, round_even(y1-h*0.18,0)) AS py1, least(1920.0, round_even(x2+w*0.10,0)) AS px2, least(1080.0, round_even(y2+h*0.10,0)) AS py2,
  least(0.14::DOUBLE, 0.035::DOUBLE + CASE WHEN greatest(w,h) < 64 THEN 0.065::DOUBLE WHEN greatest(w,h) < 112 THEN 0.065::DOUBLE*0.55::DOUBLE ELSE 0 END) AS r FROM m)
SELECT seq, px1, py1, px2, py2, round(greatest(0.0, px1-(px2-px1)*r) + 1e-9, 4) AS sx1, round(greatest(0.0, py1-(py2-py1)*r-(py2-py1)*r*0.4::DOUBLE) + 1e-9, 4) AS sy1, round(least(1920.0, px2+(px2-px1)*r) + 1e-9, 4) AS sx2, round(least(1080.0, py2+(py2-py1)*r) + 1e-9, 4) AS sy2 FROM p""")  # fmt: skip
def mask_boxes(spark, sf):
    d = det(spark, sf).where("kind = 'face'")
    m, s = B.mask_pad(box(), 1920, 1080), B.safety_pad(box(), 1920, 1080)
    return d.select("seq", *m.columns("p"), *(F.round(c + 1e-9, 4).alias(f"s{n}") for n, c in zip(BOX, s)))


@query("normalised_boxes", f"""
WITH {DET}, n AS (SELECT *, least(x2, 1920.0) AS cx2, least(y2, 1080.0) AS cy2 FROM det)
SELECT seq, round(x1/1920 + 1e-9, 6) AS x, round(y1/1080 + 1e-9, 6) AS y, round((cx2-x1)/1920 + 1e-9, 6) AS width, round((cy2-y1)/1080 + 1e-9, 6) AS height FROM n WHERE cx2>x1 AND cy2>y1""")  # fmt: skip
def normalised_boxes(spark, sf):
    n = B.to_norm(box(), 1920, 1080)
    # to_norm has six digits already; the shift matches the SQL side on exact halves
    c = B.valid_box(B.clamp_box(box(), 1920, 1080))
    vals = {"x": c.x1 / 1920, "y": c.y1 / 1080, "width": (c.x2 - c.x1) / 1920, "height": (c.y2 - c.y1) / 1080}
    return det(spark, sf).where(n["x"].isNotNull()).select("seq", *(F.round(v + 1e-9, 6).alias(k) for k, v in vals.items()))


@query("relock_tests", f"""
WITH {DET}, p AS (SELECT a.seq AS a_seq, b.seq AS b_seq, {IOU} AS iou, greatest({AREA_A},{AREA_B})/least({AREA_A},{AREA_B}) AS rt, {DIST}/{DIAG_B} AS cr FROM det a JOIN det b ON a.video_id=b.video_id AND a.person_no=b.person_no AND a.sec=b.sec AND a.seq<>b.seq)
SELECT a_seq, b_seq, NOT ((rt>2.7 OR cr>0.9) AND iou<0.08) AS loose, NOT ((rt>2.2 OR cr>0.72) AND iou<0.08) AS strict, (iou>=0.42 OR cr<=0.26) AS consistent, (iou>=0.28 OR cr<=0.52) AS agrees, cr>1.5 AS teleport FROM p""")  # fmt: skip
def relock_tests(spark, sf):
    d = det(spark, sf)
    k = ["video_id", "person_no", "sec"]
    a = d.select(*k, F.col("seq").alias("a_seq"), *box().columns("a_"))
    b = d.select(*k, F.col("seq").alias("b_seq"), *box().columns("b_"))
    x, y = box("a_"), box("b_")
    return a.join(b, k).where("a_seq <> b_seq").select(
        "a_seq", "b_seq", B.accept_relock(x, y).alias("loose"), B.accept_relock(x, y, strict=True).alias("strict"),
        B.motion_consistent(x, y).alias("consistent"), B.agrees_with_motion(x, y).alias("agrees"), B.is_teleport(x, y).alias("teleport"),
    )


@query("head_boxes", f"""
WITH {DET}, q AS (SELECT seq, x1, y1, least(x2,1920.0) AS x2, least(y2+260,1080.0) AS y2 FROM det WHERE x1 < 1920 AND y1 < 1080), s AS (SELECT *, x2-x1 AS w, y2-y1 AS h FROM q WHERE x2>x1 AND y2>y1),
t AS (SELECT *, greatest(8.0, h*CASE WHEN h<96 THEN 0.30::DOUBLE WHEN h<180 THEN 0.26::DOUBLE ELSE 0.22::DOUBLE END) AS hh FROM s), u AS (SELECT *, greatest(8.0, least(w*0.62::DOUBLE, greatest(w*0.42::DOUBLE, hh*0.82::DOUBLE))) AS hw FROM t WHERE w>=8 AND h>=8)
SELECT seq, round_even(greatest(0.0,(x1+x2)/2-hw/2), 0) AS x1, round_even(greatest(0.0,y1-h*0.01::DOUBLE), 0) AS y1, round_even(least(1920.0,(x1+x2)/2+hw/2), 0) AS x2, round_even(least(1080.0,y1+hh+h*0.02::DOUBLE), 0) AS y2 FROM u""")  # fmt: skip
def head_boxes(spark, sf):
    d = det(spark, sf).withColumn("y2", F.col("y2") + 260)
    d = d.select("seq", *B.valid_box(box(), "frame", 1920, 1080).columns())
    h = B.head_from_person(box(), 1920, 1080)
    return d.select("seq", *h.columns()).where("x1 IS NOT NULL")
