"""Ranges, segments, timelines, lookups in time."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.boxes import box_of
from ..operators import asof, lanes, ranges
from ..plans.masks import frame_grid_masks
from .bindings import CLIP, DET, FPS, MERGED, PAD, clip, det, faces, islands, objects
from .registry import query

VP = ["video_id", "person_no"]


@query("merged_person_ranges", f"""
WITH {DET}, {PAD}, {MERGED}
SELECT video_id, person_no, s AS start_ms, e AS end_ms FROM merged""")  # fmt: skip
def merged_person_ranges(spark, sf):
    m = ranges.target_ranges(faces(spark, sf), VP, 1000, 1350, 500, "t_ms")
    return m.withColumnsRenamed({"start": "start_ms", "end": "end_ms"})


@query("frames_to_mask", f"""
WITH {DET}, {PAD}, {MERGED},
len AS (SELECT video_id, max(frame_idx) AS last FROM det GROUP BY video_id),
grid AS (SELECT video_id, unnest(generate_series(0, last)) AS f FROM len)
SELECT m.video_id, m.person_no, g.f AS frame_idx FROM merged m JOIN grid g ON g.video_id = m.video_id AND g.f*40 BETWEEN m.s AND m.e""")  # fmt: skip
def frames_to_mask(spark, sf):
    d = det(spark, sf)
    videos = d.groupBy("video_id").agg((F.max("frame_idx") + 1).alias("total_frames"))
    return frame_grid_masks(d.where("kind = 'face'"), videos, VP, ["video_id"], frame_ms=40, t="t_ms")


@query("points_in_ranges", f"""
WITH {DET}, pad AS (SELECT video_id, greatest(0, t_ms-1000) AS s, greatest(0, t_ms+1350) AS e FROM det WHERE label='purchase'),
{islands("pad", "video_id", 500, "m")}
SELECT seq, video_id, t_ms FROM det d WHERE kind='object' AND EXISTS (SELECT 1 FROM m WHERE m.video_id=d.video_id AND d.t_ms BETWEEN m.s AND m.e)""")  # fmt: skip
def points_in_ranges(spark, sf):
    d = det(spark, sf)
    m = ranges.target_ranges(d.where("label = 'purchase'"), ["video_id"], 1000, 1350, 500, "t_ms")
    return ranges.in_ranges(d.where("kind = 'object'"), m, ["video_id"], "t_ms", 5000).select("seq", "video_id", "t_ms")


@query("detection_schedule", f"""
WITH {DET} SELECT seq, frame_idx FROM det WHERE (kind='face') OR frame_idx % (1 + score100 % 12 - CASE WHEN score100 % 12 > 9 THEN score100 % 12 - 9 ELSE 0 END) = 0""")  # fmt: skip
def detection_schedule(spark, sf):
    d = det(spark, sf)
    every = (F.col("score100") % 12 + 1).cast("int")
    return ranges.detection_schedule(d, every, F.col("kind") == "face").select("seq", "frame_idx")


@query("appearance_groups", f"""
WITH {DET}, a AS (SELECT video_id, person_no, t_ms, lag(t_ms) OVER (PARTITION BY video_id, person_no ORDER BY t_ms, seq) AS p FROM det WHERE kind='face'),
b AS (SELECT *, sum(CASE WHEN p IS NULL OR t_ms - p > 4000 THEN 1 ELSE 0 END) OVER (PARTITION BY video_id, person_no ORDER BY t_ms ROWS UNBOUNDED PRECEDING) AS g FROM a)
SELECT video_id, person_no, min(t_ms) AS start_ms, max(t_ms) AS end_ms, count(*) AS appearances FROM b GROUP BY video_id, person_no, g""")  # fmt: skip
def appearance_groups(spark, sf):
    g = ranges.appearance_groups(faces(spark, sf), VP, 4000, "t_ms")
    return g.withColumnsRenamed({"start": "start_ms", "end": "end_ms"})


SEGMENTS = f"""
a AS (SELECT video_id, person_no, t_ms, lag(t_ms) OVER (PARTITION BY video_id, person_no ORDER BY t_ms, seq) AS p FROM det WHERE kind='face'),
b AS (SELECT *, sum(CASE WHEN p IS NULL OR t_ms - p > 4000 THEN 1 ELSE 0 END) OVER (PARTITION BY video_id, person_no ORDER BY t_ms ROWS UNBOUNDED PRECEDING) AS g FROM a),
grp AS (SELECT video_id, person_no, g, min(t_ms) AS gs, max(t_ms) AS ge FROM b GROUP BY video_id, person_no, g),
rng AS (SELECT video_id, person_no, t_ms AS rs, t_ms + 2000 AS re FROM det WHERE kind='object'),
ext AS (SELECT grp.video_id, grp.person_no, g, least(gs, coalesce(min(rs), gs)) AS es, greatest(ge, coalesce(max(re), ge)) AS ee
  FROM grp LEFT JOIN rng ON rng.video_id=grp.video_id AND rng.person_no=grp.person_no AND re >= gs-4000 AND rs <= ge+4000
  GROUP BY grp.video_id, grp.person_no, g, gs, ge),
vid AS (SELECT video_id, max(frame_idx)+1 AS n FROM det GROUP BY video_id),
fr AS (SELECT ext.video_id, person_no, greatest(0, CAST(round_even(greatest(0.0, es-900.0)*25/1000, 0) AS BIGINT)) AS s,
   least(n-1, CAST(round_even(least(n*40.0, ee+900.0)*25/1000, 0) AS BIGINT)) AS e FROM ext JOIN vid ON vid.video_id=ext.video_id),
{islands("fr", "video_id, person_no", 1, "sg")}"""


@query("lane_segments", f"""
WITH {DET}, {SEGMENTS}
SELECT video_id, person_no, s AS start_frame, e AS end_frame FROM sg""")  # fmt: skip
def lane_segments(spark, sf):
    d = det(spark, sf)
    videos = d.groupBy("video_id").agg((F.max("frame_idx") + 1).alias("n"))
    a = d.where("kind = 'face'").join(videos, "video_id")
    extra = d.where("kind = 'object'").select(*VP, F.col("t_ms").alias("start"), (F.col("t_ms") + 2000).alias("end"))
    return ranges.lane_segments(a, extra, VP, F.lit(FPS), F.col("n"), F.col("n") * 40.0, "t_ms", unit=1000)


@query("keyframe_times", f"""
WITH {DET}, pad AS (SELECT video_id, greatest(0, t_ms-1000) AS s, greatest(0, t_ms+1350) AS e FROM det WHERE kind='face'),
{islands("pad", "video_id", 500, "m")}
SELECT DISTINCT video_id, t AS t_ms FROM (SELECT video_id, s AS t FROM m UNION ALL SELECT video_id, e FROM m UNION ALL
  SELECT video_id, x FROM (SELECT video_id, e, unnest(generate_series(s+5000, e, 5000)) AS x FROM m WHERE e-s>5000) WHERE x < e)""")  # fmt: skip
def keyframe_times(spark, sf):
    r = ranges.around(faces(spark, sf), ["video_id"], 1000, 1350, "t_ms")
    k = ranges.keyframes(r, ["video_id"], 5000, 500, digits=None)
    return k.select("video_id", F.col("t").cast("long").alias("t_ms"))


@query("uniform_keyframes", f"""
WITH {DET}, vid AS (SELECT video_id, max(frame_idx)+1 AS n FROM det GROUP BY video_id)
SELECT video_id, f AS frame_idx, f*40 AS t_ms FROM (SELECT video_id, unnest(generate_series(0, n-1, 25)) AS f FROM vid)""")  # fmt: skip
def uniform_keyframes(spark, sf):
    v = det(spark, sf).groupBy("video_id").agg((F.max("frame_idx") + 1).alias("total_frames")).withColumn("fps", F.lit(FPS))
    k = ranges.uniform_keyframes(v, ["video_id"], 1.0)
    return k.select("video_id", "frame_idx", F.round(F.col("t") * 1000).cast("long").alias("t_ms"))


@query("person_timeline", f"""
WITH {DET}, app AS (SELECT video_id, person_no, greatest(0, t_ms-180) AS s, greatest(0, t_ms+280) AS e FROM det WHERE label='purchase'),
own AS (SELECT video_id, person_no, t_ms AS s, t_ms+2000 AS e FROM det WHERE label='view'),
rem AS (SELECT video_id, person_no, t_ms AS s, t_ms+1000 AS e FROM det WHERE label='click'),
{islands("app", "video_id, person_no", 700, "a")}, {islands("own", "video_id, person_no", 450, "o")}, {islands("rem", "video_id, person_no", 450, "r")},
al AS (SELECT 'appearances' AS source, 0 AS rk, video_id, person_no, s, e, 700 AS ml FROM a UNION ALL SELECT 'ranges', 1, video_id, person_no, s, e, 550 FROM o
  UNION ALL SELECT 'remote', 2, video_id, person_no, s, e, 550 FROM r),
best AS (SELECT video_id, person_no, min(rk) AS rk FROM al GROUP BY video_id, person_no)
SELECT al.video_id, al.person_no, source,
  CAST(CASE WHEN e-s < ml THEN greatest(0.0, (s+e)/2.0 - ml/2.0) ELSE s END AS DOUBLE) AS start_ms,
  CAST(CASE WHEN e-s < ml THEN greatest((s+e)/2.0 + ml/2.0, s+ml) ELSE e END AS DOUBLE) AS end_ms
FROM al JOIN best ON best.video_id=al.video_id AND best.person_no=al.person_no AND best.rk=al.rk""")  # fmt: skip
def person_timeline(spark, sf):
    d = det(spark, sf)
    a = d.where("label = 'purchase'")
    own = d.where("label = 'view'").select(*VP, F.col("t_ms").alias("start"), (F.col("t_ms") + 2000).alias("end"))
    remote = d.where("label = 'click'").select(*VP, F.col("t_ms").alias("start"), (F.col("t_ms") + 1000).alias("end"))
    out = ranges.person_timeline(a, own, remote, VP, 1000, "t_ms")
    return out.select(*VP, "source", F.col("start").cast("double").alias("start_ms"), F.col("end").cast("double").alias("end_ms"))


@query("effective_ranges", f"""
WITH {DET}, al AS (SELECT 'faces' AS source, 0 AS rk, video_id, t_ms AS s, t_ms+1000 AS e FROM det WHERE label='purchase'
  UNION ALL SELECT 'entities', 1, video_id, t_ms, t_ms+2000 FROM det WHERE label='view'
  UNION ALL SELECT 'people', 2, video_id, t_ms, t_ms+3000 FROM det WHERE kind='object'),
best AS (SELECT video_id, min(rk) AS rk FROM al GROUP BY video_id)
SELECT al.video_id, source, s AS start_ms, e AS end_ms FROM al JOIN best ON best.video_id=al.video_id AND best.rk=al.rk""")  # fmt: skip
def effective_ranges(spark, sf):
    d = det(spark, sf)
    r = lambda cond, w: d.where(cond).select("video_id", F.col("t_ms").alias("start"), (F.col("t_ms") + w).alias("end"))
    out = ranges.effective_ranges(r("label = 'purchase'", 1000), r("label = 'view'", 2000), r("kind = 'object'", 3000), ["video_id"])
    return out.withColumnsRenamed({"start": "start_ms", "end": "end_ms"})


J1 = """ap AS (SELECT video_id, person_no AS face_no, t_ms FROM det WHERE kind='face'),
rg AS (SELECT video_id, person_no AS desc_no, seq AS range_id, t_ms-450 AS s, t_ms+3000+450 AS e FROM det WHERE kind='object'),
tot AS (SELECT video_id, face_no, count(*) AS n FROM ap GROUP BY 1, 2), nr AS (SELECT video_id, desc_no, count(*) AS m FROM rg GROUP BY 1, 2),
hit AS (SELECT ap.video_id, face_no, desc_no, count(*) AS inside, count(DISTINCT range_id) AS hit_ranges FROM ap JOIN rg ON rg.video_id=ap.video_id AND t_ms BETWEEN s AND e GROUP BY 1, 2, 3),
sc AS (SELECT hit.*, round(inside*4.0 + inside/n*2.5 + hit_ranges/m, 6) AS score FROM hit JOIN tot ON tot.video_id=hit.video_id AND tot.face_no=hit.face_no JOIN nr ON nr.video_id=hit.video_id AND nr.desc_no=hit.desc_no)"""


def scores(spark, sf):
    d = det(spark, sf)
    a = d.where("kind = 'face'").select("video_id", F.col("person_no").alias("face_no"), "t_ms")
    r = d.where("kind = 'object'").select("video_id", F.col("person_no").alias("desc_no"), F.col("seq").alias("range_id"), F.col("t_ms").alias("start"), (F.col("t_ms") + 3000).alias("end"))
    s = ranges.overlap_score(a, r, ["video_id"], "face_no", "desc_no", "t_ms", 450, 5000)
    return s.select("video_id", "face_no", "desc_no", "inside", "hit_ranges", F.round("score", 6).alias("score"))


@query("range_overlap_score", f"WITH {DET}, {J1} SELECT video_id, face_no, desc_no, inside, hit_ranges, score FROM sc")
def range_overlap_score(spark, sf):
    return scores(spark, sf)


@query("greedy_description_match", f"""
WITH RECURSIVE {DET}, {J1},
p AS (SELECT video_id, face_no, desc_no, score, row_number() OVER (PARTITION BY video_id ORDER BY score DESC, desc_no, face_no) AS rn FROM sc WHERE score >= 4),
r AS (SELECT DISTINCT video_id, CAST(0 AS BIGINT) AS rn, CAST([] AS BIGINT[]) AS uf, CAST([] AS BIGINT[]) AS ud, CAST(NULL AS BIGINT) AS face_no, CAST(NULL AS BIGINT) AS desc_no, CAST(NULL AS DOUBLE) AS score FROM p
  UNION ALL SELECT r.video_id, p.rn,
    CASE WHEN list_contains(uf, p.face_no) OR list_contains(ud, p.desc_no) THEN uf ELSE list_append(uf, p.face_no) END,
    CASE WHEN list_contains(uf, p.face_no) OR list_contains(ud, p.desc_no) THEN ud ELSE list_append(ud, p.desc_no) END,
    CASE WHEN list_contains(uf, p.face_no) OR list_contains(ud, p.desc_no) THEN NULL ELSE p.face_no END, p.desc_no, p.score
  FROM r JOIN p ON p.video_id = r.video_id AND p.rn = r.rn + 1)
SELECT video_id, face_no, desc_no, score FROM r WHERE face_no IS NOT NULL""")  # fmt: skip
def greedy_description_match(spark, sf):
    from ..operators.review import match_descriptions

    return match_descriptions(scores(spark, sf), ["video_id"], "face_no", "desc_no").select("video_id", "face_no", "desc_no", "score")


@query("nearest_anchor", f"""
WITH {DET}, b AS (SELECT video_id, person_no, t_ms, min(seq) AS seq FROM det WHERE kind='face' GROUP BY 1, 2, 3),
pr AS (SELECT video_id, person_no, t_ms, seq FROM det WHERE kind='object'),
bk AS (SELECT pr.seq, pr.video_id, pr.person_no, pr.t_ms, b.seq AS s1, pr.t_ms - b.t_ms AS g1 FROM pr ASOF LEFT JOIN b ON pr.video_id=b.video_id AND pr.person_no=b.person_no AND pr.t_ms >= b.t_ms),
fw AS (SELECT pr.seq, b.seq AS s2, b.t_ms - pr.t_ms AS g2 FROM pr ASOF LEFT JOIN b ON pr.video_id=b.video_id AND pr.person_no=b.person_no AND pr.t_ms < b.t_ms),
ch AS (SELECT bk.seq, CASE WHEN s1 IS NOT NULL AND (s2 IS NULL OR g1 < g2 OR (g1 = g2 AND s1 <= s2)) THEN s1 ELSE s2 END AS near_seq,
  CASE WHEN s1 IS NOT NULL AND (s2 IS NULL OR g1 < g2 OR (g1 = g2 AND s1 <= s2)) THEN g1 ELSE g2 END AS gap FROM bk JOIN fw ON fw.seq=bk.seq)
SELECT ch.seq, gap AS gap_ms, CASE WHEN gap <= 1500 THEN 'fresh' WHEN gap IS NOT NULL THEN 'stale' END AS anchor, d.x1, d.y2 FROM ch LEFT JOIN det d ON d.seq=ch.near_seq""")  # fmt: skip
def nearest_anchor(spark, sf):
    d = det(spark, sf)
    a = d.where("kind = 'face'").select(*VP, "t_ms", "seq", "x1", "y1", "x2", "y2")
    pr = d.where("kind = 'object'").select(*VP, "t_ms", F.col("seq").alias("probe"))
    n = asof.nearest_anchor(pr, a, VP, 1500, None, "t_ms", "seq", 60_000)
    return n.select(F.col("probe").alias("seq"), F.col("gap").alias("gap_ms"), "anchor", "x1", "y2")


LANE = "lane AS (SELECT video_id, person_no, f, x1, y1, x2, y2 FROM (SELECT *, frame_idx AS f, row_number() OVER (PARTITION BY video_id, person_no, frame_idx ORDER BY seq) AS rn FROM det WHERE kind='face') WHERE rn=1)"


def lane_of(d):
    """Faces as a lane: one box per frame, the first detection."""
    one = d.where("kind = 'face'").groupBy(*VP, F.col("frame_idx").alias("f")).agg(F.min_by(F.struct("x1", "y1", "x2", "y2", "score100"), "seq").alias("b"))
    return one.select(*VP, "f", "b.*")


@query("lane_at_time", f"""
WITH {DET}, {LANE}, pr AS (SELECT seq, video_id, person_no, t_ms, t_ms/1000.0*25 AS target, CAST(round_even(t_ms/1000.0*25, 0) AS BIGINT) AS f FROM det WHERE kind='object'),
lo AS (SELECT pr.*, l.f AS lf, l.x1 AS a1, l.y1 AS a2, l.x2 AS a3, l.y2 AS a4 FROM pr ASOF LEFT JOIN lane l ON pr.video_id=l.video_id AND pr.person_no=l.person_no AND pr.f >= l.f),
hi AS (SELECT pr.seq, l.f AS hf, l.x1 AS b1, l.y1 AS b2, l.x2 AS b3, l.y2 AS b4 FROM pr ASOF LEFT JOIN lane l ON pr.video_id=l.video_id AND pr.person_no=l.person_no AND pr.f < l.f),
j AS (SELECT lo.*, hf, b1, b2, b3, b4, abs(lf-target)/25 AS gl, abs(hf-target)/25 AS gh, greatest(0.0, least(1.0, (target-lf)/(hf-lf))) AS w FROM lo JOIN hi ON hi.seq=lo.seq),
m AS (SELECT *, CASE WHEN lf=f OR hf IS NULL THEN 0.0 WHEN lf IS NULL THEN 1.0 WHEN hf-lf > 101 THEN CASE WHEN gl<=gh THEN 0.0 ELSE 1.0 END ELSE w END AS u FROM j
  WHERE lf=f OR least(coalesce(gl,gh), coalesce(gh,gl)) <= 4.0)
SELECT seq, round(coalesce(a1,0)*(1-u)+coalesce(b1,0)*u, 4) AS x1, round(coalesce(a2,0)*(1-u)+coalesce(b2,0)*u, 4) AS y1, round(coalesce(a3,0)*(1-u)+coalesce(b3,0)*u, 4) AS x2, round(coalesce(a4,0)*(1-u)+coalesce(b4,0)*u, 4) AS y2 FROM m""")  # fmt: skip
def lane_at_time(spark, sf):
    d = det(spark, sf)
    pr = d.where("kind = 'object'").select(*VP, "seq", (F.col("t_ms") / 1000.0).alias("t"))
    out = asof.lane_at_time(pr, lane_of(d), VP, FPS, 4.0, "t")
    return out.select("seq", *(F.round(c, 4).alias(c) for c in ("x1", "y1", "x2", "y2")))


@query("lane_at_frame", f"""
WITH {DET}, {LANE} SELECT d.seq, l.x1, l.y1, l.x2, l.y2 FROM det d JOIN lane l ON l.video_id=d.video_id AND l.person_no=d.person_no AND l.f=d.frame_idx WHERE d.kind='object'""")  # fmt: skip
def lane_at_frame(spark, sf):
    d = det(spark, sf)
    pr = d.where("kind = 'object'").select(*VP, "seq", F.col("frame_idx").alias("f"))
    return asof.lane_at_frame(pr, lane_of(d), VP).select("seq", "x1", "y1", "x2", "y2")


@query("region_at_time", f"""
WITH {DET}, reg AS (SELECT video_id, person_no, min(t_ms) AS anchor, min(seq) AS seq FROM det GROUP BY 1, 2),
sm AS (SELECT video_id, person_no, t_ms, min(seq) AS seq FROM det WHERE label='view' GROUP BY 1, 2, 3),
pr AS (SELECT seq, video_id, person_no, t_ms FROM det WHERE kind='object'),
b AS (SELECT pr.seq, pr.video_id, pr.person_no, pr.t_ms, sm.seq AS s1 FROM pr ASOF LEFT JOIN sm ON sm.video_id=pr.video_id AND sm.person_no=pr.person_no AND pr.t_ms >= sm.t_ms),
f AS (SELECT video_id, person_no, arg_min(seq, t_ms) AS s0 FROM sm GROUP BY 1, 2)
SELECT b.seq, coalesce(s1, s0, reg.seq) AS sample_seq FROM b LEFT JOIN f ON f.video_id=b.video_id AND f.person_no=b.person_no JOIN reg ON reg.video_id=b.video_id AND reg.person_no=b.person_no WHERE b.t_ms >= reg.anchor""")  # fmt: skip
def region_at_time(spark, sf):
    d = det(spark, sf)
    sec = (F.col("t_ms") / 1000.0).alias("t")
    zero = [F.lit(0.0).alias(c) for c in ("y", "width", "height")]
    regions = d.groupBy(*VP).agg((F.min("t_ms") / 1000.0 + 0.05).alias("anchor_sec"), F.min("seq").cast("double").alias("x")).select("*", *zero)
    sm = d.where("label = 'view'").groupBy(*VP, "t_ms").agg(F.min("seq").cast("double").alias("x")).select(*VP, sec, "x", *zero)
    pr = d.where("kind = 'object'").select(*VP, "seq", sec)
    out = asof.region_at_time(pr, sm, regions, VP)
    return out.select("seq", F.col("x").cast("long").alias("sample_seq"))


@query("nearest_gap", f"""
WITH {DET}, {PAD}, {MERGED}, pr AS (SELECT DISTINCT video_id, t_ms FROM det WHERE label='signup')
SELECT pr.video_id, m.person_no, pr.t_ms, min(greatest(m.s - pr.t_ms, pr.t_ms - m.e, 0)) AS gap_ms, min(greatest(m.s - pr.t_ms, pr.t_ms - m.e, 0)) <= 180 AS visible
FROM pr JOIN merged m ON m.video_id=pr.video_id GROUP BY 1, 2, 3""")  # fmt: skip
def nearest_gap(spark, sf):
    d = det(spark, sf)
    m = ranges.target_ranges(d.where("kind = 'face'"), VP, 1000, 1350, 500, "t_ms")
    g = ranges.nearest_gap(d.where("label = 'signup'").select("video_id", "t_ms"), m, ["video_id"], "person_no", "t_ms", 180,
                           items=d.where("kind = 'face'").select("video_id", "person_no"), chunk=60_000)
    return g.withColumnRenamed("gap", "gap_ms")


@query("active_clips", f"""
WITH {DET}, {CLIP} SELECT d.seq, c.ok, c.ln, c."start" AS start_s, c."end" AS end_s FROM det d JOIN clip c ON c.video_id=d.person_no AND d.sec % 60 BETWEEN c."start" AND c."end" """)  # fmt: skip
def active_clips(spark, sf):
    d = det(spark, sf).select("seq", F.col("person_no").alias("video_id"), (F.col("sec") % 60).alias("t"))
    c = clip(spark, sf).select("video_id", "ok", "ln", "start", "end")
    return ranges.active_at(d, c, ["video_id"], "t", 5).select("seq", "ok", "ln", F.col("start").alias("start_s"), F.col("end").alias("end_s"))


@query("seek_time", f"""
WITH {DET}, pr AS (SELECT DISTINCT video_id, person_no, t_ms FROM det WHERE kind='object'), ap AS (SELECT DISTINCT video_id, person_no, t_ms FROM det WHERE label='purchase'),
bk AS (SELECT pr.*, ap.t_ms AS a FROM pr ASOF LEFT JOIN ap ON ap.video_id=pr.video_id AND ap.person_no=pr.person_no AND pr.t_ms >= ap.t_ms),
fw AS (SELECT pr.*, ap.t_ms AS b FROM pr ASOF LEFT JOIN ap ON ap.video_id=pr.video_id AND ap.person_no=pr.person_no AND pr.t_ms < ap.t_ms)
SELECT bk.video_id, bk.person_no, bk.t_ms, CAST(CASE WHEN a IS NOT NULL AND (b IS NULL OR bk.t_ms - a <= b - bk.t_ms) THEN a ELSE b END AS DOUBLE) AS seek_ms
FROM bk JOIN fw ON fw.video_id=bk.video_id AND fw.person_no=bk.person_no AND fw.t_ms=bk.t_ms""")  # fmt: skip
def seek_time(spark, sf):
    d = det(spark, sf)
    seg = ranges.target_ranges(d.where("label = 'view'"), VP, 1000, 1350, 500, "t_ms")
    pr = d.where("kind = 'object'").select(*VP, "t_ms").distinct()
    have = d.where("label = 'purchase'").select(*VP).distinct()
    out = asof.seek_time(pr, d.where("label = 'purchase'"), seg.join(have, VP, "left_anti"), VP, "t_ms")
    return out.select(*VP, "t_ms", F.col("seek").cast("double").alias("seek_ms"))


def second_lane(spark, sf, where: str):
    """Detections as lane rows on a one-second grid."""
    d = det(spark, sf).where(where)
    one = d.groupBy(*VP, F.col("sec").alias("f")).agg(F.min_by(F.struct("x1", "y1", "x2", "y2", "score100"), "seq").alias("b"))
    src = F.when(F.col("score100") >= 80, "anchor").when(F.col("score100") >= 70, "head_fallback").otherwise("tracker")
    return one.select(*VP, "f", "b.*").select(*VP, "f", "x1", "y1", "x2", "y2", src.alias("src"), (F.col("score100") / 100.0).alias("conf"))


def second_lane_sql(name: str, where: str) -> str:
    return f"""{name} AS (SELECT video_id, person_no, f, x1, y1, x2, y2, CASE WHEN score100>=80 THEN 'anchor' WHEN score100>=70 THEN 'head_fallback' ELSE 'tracker' END AS src, score100/100.0 AS conf
  FROM (SELECT *, sec AS f, row_number() OVER (PARTITION BY video_id, person_no, sec ORDER BY seq) AS rn FROM det WHERE {where}) WHERE rn=1)"""


def rounded(df, *cols, digits: int = 4):
    """Rounded columns; the small shift keeps exact halves off the rounding edge."""
    return df.withColumns({c: F.round(F.col(c) + 1e-9, digits) for c in cols})


BOX = ("x1", "y1", "x2", "y2")
ROUND_BOX = ", ".join(f"round({c} + 1e-9, 4) AS {c}" for c in BOX)


@query("fuse_lanes", f"""
WITH {DET}, {second_lane_sql("fa", "kind='face'")}, {second_lane_sql("fb", "kind='object'")},
j AS (SELECT coalesce(a.video_id,b.video_id) AS video_id, coalesce(a.person_no,b.person_no) AS person_no, coalesce(a.f,b.f) AS f, a.f IS NOT NULL AS ha, b.f IS NOT NULL AS hb,
  a.src='anchor' AS pa, b.src='anchor' AS pb, a.conf AS ca, b.conf AS cb, greatest(0.05, a.conf) AS wa, greatest(0.05, b.conf) AS wb, a AS ra, b AS rb FROM fa a FULL JOIN fb b ON a.video_id=b.video_id AND a.person_no=b.person_no AND a.f=b.f),
k AS (SELECT *, CASE WHEN NOT hb OR (pa AND NOT pb) OR (pa AND pb AND ca>=cb) THEN 1 WHEN NOT ha OR (pb AND NOT pa) OR (pa AND pb) THEN 2 ELSE 3 END AS how FROM j)
SELECT video_id, person_no, f, {", ".join(f"round(CASE how WHEN 1 THEN ra.{c} WHEN 2 THEN rb.{c} ELSE (ra.{c}*wa + rb.{c}*wb)/(wa+wb) END + 1e-9, 4) AS {c}" for c in BOX)},
  CASE how WHEN 1 THEN ra.src WHEN 2 THEN rb.src ELSE ra.src || '|' || rb.src END AS src, CASE how WHEN 1 THEN ra.conf WHEN 2 THEN rb.conf ELSE least(0.99, greatest(wa, wb)) END AS conf FROM k""")  # fmt: skip
def fuse_lanes(spark, sf):
    out = lanes.fuse_lanes(second_lane(spark, sf, "kind = 'face'"), second_lane(spark, sf, "kind = 'object'"), VP, 1920, 1080)
    return rounded(out, *BOX)


@query("scale_between_pins", f"""
WITH {DET}, {second_lane_sql("l", "kind='face'")}, n AS (SELECT video_id, person_no, count(*) FILTER (src IN ('anchor','head_fallback')) AS refs FROM l GROUP BY 1, 2),
r AS (SELECT *, CASE WHEN src IN ('anchor','head_fallback') THEN f END AS rf, CASE WHEN src IN ('anchor','head_fallback') THEN x2-x1 END AS rw, CASE WHEN src IN ('anchor','head_fallback') THEN y2-y1 END AS rh FROM l),
q AS (SELECT *, last_value(rf IGNORE NULLS) OVER a AS lf, last_value(rw IGNORE NULLS) OVER a AS lw, last_value(rh IGNORE NULLS) OVER a AS lh,
  first_value(rf IGNORE NULLS) OVER b AS nf, first_value(rw IGNORE NULLS) OVER b AS nw, first_value(rh IGNORE NULLS) OVER b AS nh FROM r
  WINDOW a AS (PARTITION BY video_id, person_no ORDER BY f ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), b AS (PARTITION BY video_id, person_no ORDER BY f ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
z AS (SELECT q.*, refs, (q.f-lf)/greatest(1, nf-lf) AS w FROM q JOIN n ON n.video_id=q.video_id AND n.person_no=q.person_no),
s AS (SELECT *, CASE WHEN lf IS NULL THEN nw WHEN nf IS NULL OR lf=nf THEN lw ELSE lw*(1-w)+nw*w END AS tw, CASE WHEN lf IS NULL THEN nh WHEN nf IS NULL OR lf=nf THEN lh ELSE lh*(1-w)+nh*w END AS th, refs>=2 AND src<>'anchor' AS ch FROM z)
SELECT video_id, person_no, f, src, round(CASE WHEN ch THEN greatest(0.0,(x1+x2)/2-tw/2) ELSE x1 END + 1e-9, 4) AS x1, round(CASE WHEN ch THEN greatest(0.0,(y1+y2)/2-th/2) ELSE y1 END + 1e-9, 4) AS y1,
  round(CASE WHEN ch THEN least(1920.0,(x1+x2)/2+tw/2) ELSE x2 END + 1e-9, 4) AS x2, round(CASE WHEN ch THEN least(1080.0,(y1+y2)/2+th/2) ELSE y2 END + 1e-9, 4) AS y2 FROM s""")  # fmt: skip
def scale_between_pins(spark, sf):
    out = lanes.stabilize_scale(second_lane(spark, sf, "kind = 'face'"), VP, 1920, 1080)
    return rounded(out, *BOX).drop("conf")


def _ema_sql(src: str, out: str, order: str, a: float, s: float, reset: str) -> str:
    """Recursive smoothing of the lane ``src`` in the given order; rows where ``reset`` holds keep their box."""
    nx = f"({a}*((p.x1+p.x2)/2) + {round(1 - a, 10)}*((r.x1+r.x2)/2))"
    ny = f"({a}*((p.y1+p.y2)/2) + {round(1 - a, 10)}*((r.y1+r.y2)/2))"
    nw = f"({s}*greatest(1.0,p.x2-p.x1) + {round(1 - s, 10)}*greatest(1.0,r.x2-r.x1))"
    nh = f"({s}*greatest(1.0,p.y2-p.y1) + {round(1 - s, 10)}*greatest(1.0,r.y2-r.y1))"
    clip_ = lambda e, top: f"greatest(0.0, least({e}, {top}))"
    return f"""{out}_n AS (SELECT *, row_number() OVER (PARTITION BY video_id, person_no ORDER BY {order}) AS rn FROM {src}),
{out} AS (SELECT video_id, person_no, f, src, rn, x1, y1, x2, y2 FROM {out}_n WHERE rn=1
  UNION ALL SELECT p.video_id, p.person_no, p.f, p.src, p.rn, CASE WHEN {reset} THEN p.x1 ELSE {clip_(nx + "-" + nw + "/2", "1920.0")} END, CASE WHEN {reset} THEN p.y1 ELSE {clip_(ny + "-" + nh + "/2", "1080.0")} END,
    CASE WHEN {reset} THEN p.x2 ELSE {clip_(nx + "+" + nw + "/2", "1920.0")} END, CASE WHEN {reset} THEN p.y2 ELSE {clip_(ny + "+" + nh + "/2", "1080.0")} END
  FROM {out} r JOIN {out}_n p ON p.video_id=r.video_id AND p.person_no=r.person_no AND p.rn=r.rn+1)"""


@query("ema_lane", f"""
WITH RECURSIVE {DET}, {second_lane_sql("l", "kind='face'")}, {_ema_sql("l", "e", "f", 0.5, 0.35, "FALSE")}
SELECT video_id, person_no, f, {ROUND_BOX} FROM e""")  # fmt: skip
def ema_lane(spark, sf):
    out = lanes.ema_boxes(second_lane(spark, sf, "kind = 'face'"), VP, 0.5, 0.35, 1920, 1080)
    return rounded(out, *BOX).drop("src", "conf")


@query("smooth_lane", f"""
WITH RECURSIVE {DET}, {second_lane_sql("l", "kind='face'")}, {_ema_sql("l", "e", "f", 0.5, 0.35, "p.src='anchor'")}, {_ema_sql("e", "b", "f DESC", 0.5, 0.35, "p.src='anchor'").replace("SELECT *, row_number()", "SELECT * EXCLUDE (rn), row_number()")}
SELECT video_id, person_no, f, src, {ROUND_BOX} FROM b""")  # fmt: skip
def smooth_lane(spark, sf):
    out = lanes.smooth_bidirectional(second_lane(spark, sf, "kind = 'face'"), VP, 0.5, 1920, 1080)
    return rounded(out, *BOX).drop("conf")


@query("track_velocity", f"""
WITH RECURSIVE {DET}, {second_lane_sql("l", "kind='face'")}, n AS (SELECT *, row_number() OVER (PARTITION BY video_id, person_no ORDER BY f) AS rn FROM l),
v AS (SELECT video_id, person_no, f, rn, x1, y1, x2, y2, 0.0::DOUBLE AS vx, 0.0::DOUBLE AS vy, 0.0::DOUBLE AS vw, 0.0::DOUBLE AS vh FROM n WHERE rn=1
 UNION ALL SELECT n.video_id, n.person_no, n.f, n.rn, n.x1, n.y1, n.x2, n.y2, 0.45::DOUBLE*((n.x1+n.x2)/2-(v.x1+v.x2)/2)+0.55::DOUBLE*vx, 0.45::DOUBLE*((n.y1+n.y2)/2-(v.y1+v.y2)/2)+0.55::DOUBLE*vy,
  0.45::DOUBLE*((n.x2-n.x1)-(v.x2-v.x1))+0.55::DOUBLE*vw, 0.45::DOUBLE*((n.y2-n.y1)-(v.y2-v.y1))+0.55::DOUBLE*vh FROM v JOIN n ON n.video_id=v.video_id AND n.person_no=v.person_no AND n.rn=v.rn+1)
SELECT video_id, person_no, f, round(vx + 1e-9, 5) AS vcx, round(vy + 1e-9, 5) AS vcy, round(vw + 1e-9, 5) AS vw, round(vh + 1e-9, 5) AS vh, round(sqrt(vx*vx+vy*vy)/greatest(8.0, sqrt((x2-x1)*(x2-x1)+(y2-y1)*(y2-y1))) + 1e-9, 5) AS motion_rate FROM v""")  # fmt: skip
def track_velocity(spark, sf):
    v = lanes.velocities(second_lane(spark, sf, "kind = 'face'"), VP)
    # adding zero turns a negative zero into zero
    return v.select(*VP, "f", *((F.round(F.col(c) + 1e-9, 5) + 0.0).alias(c) for c in ("vcx", "vcy", "vw", "vh", "motion_rate")))


@query("preserve_memory", f"""
WITH {DET}, own AS (SELECT DISTINCT video_id, frame_idx AS f FROM det WHERE label='purchase'), fr AS (SELECT DISTINCT video_id, frame_idx AS f FROM det),
a AS (SELECT fr.video_id, fr.f, o.f AS src FROM fr ASOF JOIN own o ON o.video_id=fr.video_id AND fr.f >= o.f), g AS (SELECT *, f-src AS age, 1.0::DOUBLE + least(0.85::DOUBLE, 0.035::DOUBLE*greatest(1, f-src)) AS k FROM a WHERE f-src <= 18),
j AS (SELECT g.video_id, g.f, age, k, d.seq, d.x1, d.y1, d.x2, d.y2, (d.x1+d.x2)/2 AS cx, (d.y1+d.y2)/2 AS cy, (d.x2-d.x1)/2*k AS hw, (d.y2-d.y1)/2*k AS hh FROM g JOIN det d ON d.video_id=g.video_id AND d.frame_idx=g.src AND d.label='purchase')
SELECT video_id, f, age, CASE WHEN age=0 THEN x1 ELSE greatest(0.0, trunc(cx-hw)) END AS x1, CASE WHEN age=0 THEN y1 ELSE greatest(0.0, trunc(cy-hh)) END AS y1,
 CASE WHEN age=0 THEN x2 ELSE least(1920.0, trunc(cx+hw)) END AS x2, CASE WHEN age=0 THEN y2 ELSE least(1080.0, trunc(cy+hh)) END AS y2 FROM j""")  # fmt: skip
def preserve_memory(spark, sf):
    d = det(spark, sf).withColumnRenamed("frame_idx", "f")
    own = d.where("label = 'purchase'").select("video_id", "f", *BOX)
    return lanes.preserve_memory(own, d.select("video_id", "f").distinct(), ["video_id"], 1920, 1080)


@query("choose_anchor", f"""
WITH {DET}, ref AS (SELECT video_id, sec, min(seq) AS seq FROM det WHERE kind='object' GROUP BY 1, 2), r AS (SELECT d.* FROM det d JOIN ref ON ref.seq=d.seq),
p AS (SELECT a.video_id, a.sec, a.seq, r.seq IS NOT NULL AS has, greatest(0.0,least(a.x2,r.x2)-greatest(a.x1,r.x1))*greatest(0.0,least(a.y2,r.y2)-greatest(a.y1,r.y1)) AS it, (a.x2-a.x1)*(a.y2-a.y1) AS aa, (r.x2-r.x1)*(r.y2-r.y1) AS ra,
 sqrt(power((a.x1+a.x2-r.x1-r.x2)/2,2)+power((a.y1+a.y2-r.y1-r.y2)/2,2))/sqrt(power(r.x2-r.x1,2)+power(r.y2-r.y1,2)) AS cr FROM det a LEFT JOIN r ON r.video_id=a.video_id AND r.sec=a.sec WHERE a.kind='face'),
s AS (SELECT *, CASE WHEN has THEN round(it/(aa+ra-it)*3.2 - cr*1.8 - abs(ln(aa/ra))*0.35, 9) ELSE 0 END AS score FROM p)
SELECT video_id, sec, seq FROM (SELECT *, row_number() OVER (PARTITION BY video_id, sec ORDER BY score DESC, seq) AS rn FROM s) WHERE rn=1""")  # fmt: skip
def choose_anchor(spark, sf):
    d = det(spark, sf)
    ref = d.where("kind = 'object'").groupBy("video_id", "sec").agg(F.min_by(F.struct(*BOX), "seq").alias("b"))
    ref = ref.select("video_id", "sec", *box_of("b").columns())
    out = lanes.choose_anchor(d.where("kind = 'face'").select("video_id", "sec", "seq", *BOX), ref, ["video_id", "sec"])
    return out.select("video_id", "sec", "seq")


@query("choose_seed")
def choose_seed(spark, sf):
    a = faces(spark, sf).select("video_id", F.col("sec").alias("f"), "seq", *BOX)
    return lanes.choose_seed(a, ["video_id"]).select("video_id", "f", "seq")


@query("appearance_sessions", f"""
WITH {DET}, a AS (SELECT video_id, person_no, t_ms, lag(t_ms) OVER (PARTITION BY video_id, person_no ORDER BY t_ms) AS p FROM det WHERE kind='face'),
b AS (SELECT *, sum(CASE WHEN p IS NULL OR t_ms - p > 4000 THEN 1 ELSE 0 END) OVER (PARTITION BY video_id, person_no ORDER BY t_ms ROWS UNBOUNDED PRECEDING) AS g FROM a)
SELECT video_id, person_no, min(t_ms) AS first_ms, max(t_ms) AS last_ms, count(*) AS appearances FROM b GROUP BY video_id, person_no, g""")  # fmt: skip
def appearance_sessions(spark, sf):
    from ..streaming.events import appearance_sessions as sessions

    d = faces(spark, sf).withColumn("ts", F.timestamp_millis("t_ms"))
    s = sessions(d, VP)
    return s.select(*VP, F.unix_millis("first_seen").alias("first_ms"), F.unix_millis("last_seen").alias("last_ms"), "appearances")


@query("sampled_regions", f"""
WITH {DET}, {LANE.replace("lane AS", "l AS")}, k AS (SELECT video_id, person_no, f, x1, y1, x2, y2, CASE WHEN f=0 THEN 0 ELSE CAST(floor(((f-1)/25.0::DOUBLE + 0.02::DOUBLE)/0.125::DOUBLE) AS BIGINT)+1 END AS lo, CAST(floor((f/25.0::DOUBLE + 0.02::DOUBLE)/0.125::DOUBLE) AS BIGINT) AS hi FROM l)
SELECT video_id, person_no, round(t*0.125::DOUBLE, 4) AS t, round(x1/1920 + 1e-9, 6) AS x, round(y1/1080 + 1e-9, 6) AS y, round((x2-x1)/1920 + 1e-9, 6) AS width, round((y2-y1)/1080 + 1e-9, 6) AS height FROM (SELECT *, unnest(generate_series(lo, hi)) AS t FROM k WHERE hi >= lo)""")  # fmt: skip
def sampled_regions(spark, sf):
    s = lanes.sample_regions(lane_of(det(spark, sf)), VP, 8, FPS, 1920, 1080)
    return s.select(*VP, "t", *(F.round(F.col(c) + 1e-9, 6).alias(c) for c in ("x", "y", "width", "height")))


@query("object_ranges_by_video", f"WITH {DET}, pad AS (SELECT video_id, t_ms AS s, t_ms+2000 AS e FROM det WHERE kind='object'), {islands('pad', 'video_id', 0, 'm')} SELECT video_id, s AS start_ms, e AS end_ms FROM m")
def object_ranges_by_video(spark, sf):
    r = objects(spark, sf).select("video_id", F.col("t_ms").alias("start"), (F.col("t_ms") + 2000).alias("end"))
    return ranges.merge_ranges(r, ["video_id"], 0).withColumnsRenamed({"start": "start_ms", "end": "end_ms"})
