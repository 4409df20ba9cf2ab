"""Vectors, clustering, people; composite plans and live tracks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import boxes as B
from ..functions.boxes import box
from ..operators import identity, lanes, ranges, review
from ..plans import jobs, masks, requests
from ..streaming import live
from .bindings import DET, ENC, FPS, JOB, det, faces, islands, job, objects, table, with_encoding
from .registry import query

VP = ["video_id", "person_no"]
VS = ["video_id", "sec"]
BOX = ["x1", "y1", "x2", "y2"]


@query("vector_topk", """
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), s AS (SELECT a.vec_id AS query_id, b.vec_id AS item_id, round(list_dot_product(a.v, b.v), 6) AS score FROM e a, e b WHERE a.vec_id<>b.vec_id)
SELECT query_id, item_id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM s) WHERE rank <= 10""")  # fmt: skip
def vector_topk(spark, sf):
    e = table(spark, sf, "embeddings")
    q = e.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vec"))
    i = e.select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vec"))
    return identity.vector_topk(q, i, 10, skip_self=True, digits=6)


@query("vector_topk_by_video", """
WITH e AS (SELECT vec_id, vec_id * 7 % 23 AS video_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
s AS (SELECT a.vec_id AS query_id, b.video_id, b.vec_id AS item_id, round(list_dot_product(a.v, b.v), 6) AS score FROM e a, e b),
g AS (SELECT query_id, video_id, row_number() OVER (PARTITION BY query_id ORDER BY max(score) DESC, video_id) AS group_rank FROM s GROUP BY 1, 2),
r AS (SELECT s.*, group_rank, row_number() OVER (PARTITION BY query_id, video_id ORDER BY score DESC, item_id) AS rank FROM s JOIN g USING (query_id, video_id) WHERE group_rank <= 5)
SELECT query_id, CAST(group_rank AS INTEGER) AS group_rank, video_id, CAST(rank AS INTEGER) AS rank, item_id, score FROM r WHERE rank <= 3""")  # fmt: skip
def vector_topk_by_video(spark, sf):
    e = table(spark, sf, "embeddings")
    q = e.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vec"))
    i = e.select(F.col("vec_id").alias("item_id"), (F.col("vec_id") * 7 % 23).alias("video_id"), F.col("embedding").alias("vec"))
    return identity.vector_topk_grouped(q, i, "video_id", 5, 3, digits=6)


def known_people(spark, sf, d):
    """One known vector per person: the encoding of the first object detection."""
    k = d.where("kind = 'object'").groupBy(*VP).agg(F.min_by("encoding", "seq").alias("encoding"))
    return k.select("video_id", F.col("person_no").alias("person_id"), "encoding")


KNOWN = f"""{ENC}, kn AS (SELECT video_id, person_no AS person_id, arg_min(encoding, seq) AS k FROM enc WHERE kind='object' GROUP BY 1, 2)"""
COS = "list_dot_product(encoding, k)/(sqrt(list_dot_product(encoding, encoding))*sqrt(list_dot_product(k, k)))"


@query("identify_people", f"""
WITH {DET}, {KNOWN}, s AS (SELECT e.video_id, e.sec, e.seq, person_id, score100/100.0::DOUBLE AS ds, round({COS}, 4) AS sim FROM enc e JOIN kn ON kn.video_id=e.video_id WHERE kind='face'),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY sim DESC, person_id) AS rn FROM s) WHERE rn=1 AND sim >= 0.45),
t AS (SELECT *, row_number() OVER (PARTITION BY video_id, sec, person_id ORDER BY sim DESC, ds DESC, seq) AS r2 FROM b)
SELECT video_id, sec, person_id, seq, sim AS match_score FROM t WHERE r2=1""")  # fmt: skip
def identify_people(spark, sf):
    d = with_encoding(spark, sf, det(spark, sf))
    dets = d.where("kind = 'face'").withColumn("det_score", F.col("score100") / 100.0)
    out = identity.identify(dets, known_people(spark, sf, d), ["video_id"], ["sec"])
    return out.select(*VS, "person_id", "seq", "match_score")


@query("match_any", f"""
WITH {DET}, {KNOWN}, s AS (SELECT e.seq, max(round({COS}, 4)) AS sim FROM enc e JOIN kn ON kn.video_id=e.video_id WHERE kind='face' AND (e.video_id, person_id) IN (SELECT video_id, person_no FROM det WHERE score100 >= 99) GROUP BY 1) SELECT seq FROM s WHERE sim >= 0.45""")  # fmt: skip
def match_any(spark, sf):
    d = with_encoding(spark, sf, det(spark, sf))
    wanted = d.where("score100 >= 99").select("video_id", F.col("person_no").alias("person_id")).distinct()
    known = known_people(spark, sf, d).join(wanted, ["video_id", "person_id"], "left_semi")
    return identity.match_any(d.where("kind = 'face'"), known, ["video_id"], ["seq"]).select("seq")


@query("person_centroids", f"""
WITH {DET}, {ENC}, x AS (SELECT video_id, person_no, unnest(encoding) AS v, generate_subscripts(encoding, 1) AS i FROM enc WHERE kind='face'), m AS (SELECT video_id, person_no, i, avg(v) AS v, count(*) AS n FROM x GROUP BY 1, 2, 3),
z AS (SELECT video_id, person_no, sqrt(sum(v*v)) AS l, max(n) AS members FROM m GROUP BY 1, 2)
SELECT m.video_id, m.person_no, max(members) AS members, round(max(CASE WHEN i=1 THEN v/l END) + 1e-9, 6) AS c0, round(max(CASE WHEN i=64 THEN v/l END) + 1e-9, 6) AS c63 FROM m JOIN z ON z.video_id=m.video_id AND z.person_no=m.person_no GROUP BY 1, 2""")  # fmt: skip
def person_centroids(spark, sf):
    c = identity.centroids(with_encoding(spark, sf, faces(spark, sf)), VP)
    return c.select(*VP, "members", F.round(F.col("centroid")[0] + 1e-9, 6).alias("c0"), F.round(F.col("centroid")[63] + 1e-9, 6).alias("c63"))


@query("object_classes", f"""
WITH {DET}, o AS (SELECT *, (x2-x1)*(y2-y1) AS ar FROM det WHERE kind='object')
SELECT video_id, label AS identification, count(*) AS appearance_count, min(seq) AS first_seq, min_by(seq, -ar*10000000.0::DOUBLE + seq) AS best_seq, 'object_' || (row_number() OVER (PARTITION BY video_id ORDER BY min(seq)) - 1) AS object_id FROM o GROUP BY 1, 2""")  # fmt: skip
def object_classes(spark, sf):
    d = objects(spark, sf).withColumn("crop_area", B.box_area(box()))
    return identity.cluster_objects(d, "video_id", "seq", "label").select("video_id", F.col("label").alias("identification"), "appearance_count", "first_seq", "best_seq", "object_id")


@query("reference_faces", f"""
WITH {DET} SELECT video_id, person_no, seq FROM (SELECT *, row_number() OVER (PARTITION BY video_id, person_no ORDER BY score100 DESC, seq%40 DESC, seq) AS rn FROM det WHERE kind='face') WHERE rn=1""")  # fmt: skip
def reference_faces(spark, sf):
    d = faces(spark, sf).withColumns({"det_score": F.col("score100") / 100.0, "sharpness": F.col("seq") % 40, "encoding": F.lit(1)})
    chosen, _ = identity.pick_reference_face(d.select(*VP).distinct(), d, VP)
    return chosen.select(*VP, "seq")


@query("cluster_people")
def cluster_people(spark, sf):
    d = with_encoding(spark, sf, faces(spark, sf)).withColumns({"det_score": F.col("score100") / 100.0, "sharpness": F.lit(10.0)})
    c = identity.cluster_faces(d, "video_id")
    s = identity.summarise_people(d.join(c, ["video_id", "seq"]), "video_id")
    return s.select("video_id", "person_id", "appearance_count", "best_seq", "order_pos")


@query("link_identities", """
WITH RECURSIVE e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), u AS (SELECT vec_id, v, sqrt(list_dot_product(v, v)) AS n FROM e),
p AS (SELECT a.vec_id AS x, b.vec_id AS y FROM u a JOIN u b ON a.vec_id <> b.vec_id AND list_dot_product(a.v, b.v) > 0.38::DOUBLE * a.n * b.n),
r AS (SELECT vec_id AS x, vec_id AS y FROM e UNION SELECT r.x, p.y FROM r JOIN p ON r.y = p.x)
SELECT x AS person_key, min(y) AS identity FROM r GROUP BY x""")  # fmt: skip
def link_identities(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("person_key"), F.col("embedding").alias("centroid"))
    return identity.resolve_identities(e, centroid_sim=None)


@query("resolve_identities")
def resolve_identities(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("person_key"), F.col("embedding").alias("centroid"))
    return identity.resolve_identities(e)


@query("selected_ids", f"WITH {DET} SELECT DISTINCT video_id, person_no AS person_id FROM det WHERE kind='face' EXCEPT SELECT video_id, person_no FROM det WHERE score100 >= 99")
def selected_ids(spark, sf):
    d = det(spark, sf).withColumn("person_id", F.col("person_no"))
    return review.selected_ids(d.where("kind = 'face'"), d.where("score100 >= 99"), ["video_id"])


@query("uncovered_targets", f"WITH {DET} SELECT DISTINCT video_id, person_no, sec FROM det d WHERE kind='object' AND NOT EXISTS (SELECT 1 FROM det l WHERE l.label='purchase' AND l.video_id=d.video_id AND l.person_no=d.person_no AND l.sec=d.sec)")
def uncovered_targets(spark, sf):
    d = det(spark, sf)
    return review.uncovered_targets(d.where("kind = 'object'").select(*VP, "sec").distinct(), d.where("label = 'purchase'"), [*VP, "sec"])


@query("visible_boxes", f"""
WITH {DET}, l AS (SELECT * FROM det WHERE label='purchase') SELECT seq, 'lane' AS origin FROM l
UNION ALL SELECT seq, 'live' FROM det d WHERE kind='object' AND NOT EXISTS (SELECT 1 FROM l WHERE l.video_id=d.video_id AND l.person_no=d.person_no)""")  # fmt: skip
def visible_boxes(spark, sf):
    d = det(spark, sf)
    cols = d.select("video_id", F.col("person_no").alias("person_id"), F.col("seq").alias("f"), F.col("x1").alias("x"), F.col("y1").alias("y"),
                    (F.col("x2") - F.col("x1")).alias("width"), (F.col("y2") - F.col("y1")).alias("height"), "label", "kind", "score100")
    v = review.visible_boxes(cols.where("label = 'purchase'"), cols.where("kind = 'object'"), ["video_id"])
    return v.select(F.col("f").alias("seq"), "origin")


@query("progress_changes", f"""
WITH {DET}, p AS (SELECT video_id, seq, label AS stage, CAST(floor(score100/25.0) AS INTEGER) AS percent FROM det), q AS (SELECT *, lag(stage) OVER w AS ps, lag(percent) OVER w AS pp FROM p WINDOW w AS (PARTITION BY video_id ORDER BY seq))
SELECT video_id, seq, stage, percent FROM q WHERE ps IS NULL OR ps<>stage OR pp<>percent""")  # fmt: skip
def progress_changes(spark, sf):
    p = det(spark, sf).select("video_id", "seq", F.col("label").alias("stage"), F.floor(F.col("score100") / 25.0).cast("int").alias("percent"))
    return review.progress_changes(p, ["video_id"], "seq")


@query("build_summary", f"""
WITH {JOB}, s AS (SELECT video_id, CASE status WHEN 'ready' THEN 'ready' WHEN 'processing' THEN 'running' ELSE 'failed' END AS st, job_id%101 AS pc FROM job)
SELECT video_id, count(*) FILTER (st='running') AS building, count(*) FILTER (st='ready') AS ready, count(*) AS total, CAST(CASE WHEN count(*) FILTER (st='running')>0 THEN floor(avg(pc) FILTER (st='running')+0.5) WHEN count(*)=count(*) FILTER (st='ready') THEN 100 ELSE 0 END AS INTEGER) AS percent FROM s GROUP BY 1""")  # fmt: skip
def build_summary(spark, sf):
    st = F.when(F.col("status") == "ready", "ready").when(F.col("status") == "processing", "running").otherwise("failed")
    return review.build_summary(job(spark, sf).select("video_id", st.alias("status"), (F.col("job_id") % 101).alias("percent")), ["video_id"])


def ingest_tables(spark, sf):
    d = det(spark, sf)
    dets = with_encoding(spark, sf, d.where("kind = 'face'")).withColumns({"det_score": F.col("score100") / 100.0, "sharpness": F.lit(10.0), "t": F.col("t_ms") / 1000.0})
    ob = d.where("kind = 'object'")
    people = ob.groupBy("video_id", F.col("person_no").cast("int").alias("desc_index")).agg(
        F.concat(F.lit("Person "), F.min("person_no").cast("string")).alias("name"), F.lit("seen").alias("description"), F.bool_or(F.col("score100") > 95).alias("should_anonymize"),
        F.lit(False).alias("is_official"), F.lit(False).alias("review_required"), F.lit("").alias("redaction_reason"), F.array(F.lit("vip")).alias("tags"), (F.max("score100") / 100.0).alias("confidence"),
    )
    rg = ob.select("video_id", F.col("person_no").cast("int").alias("desc_index"), F.col("seq").alias("range_id"), (F.col("t_ms") / 1000.0).alias("start"), (F.col("t_ms") / 1000.0 + 3).alias("end"))
    return dets, people, rg


@query("ingest_faces")
def ingest_faces(spark, sf):
    f, _ = jobs.ingest(*ingest_tables(spark, sf), job="video_id")
    return f.select("video_id", "stable_person_id", "name", "appearance_count", "description_match_score", "priority_rank", F.array_join("tags", "|").alias("tags"), "should_anonymize", "review_required")


@query("review_list")
def review_list(spark, sf):
    f, _ = jobs.ingest(*ingest_tables(spark, sf), job="video_id")
    return review.order_review(review.review_items(f, job="video_id"), "video_id").select("video_id", "id", "label", "appearance_count", "priority_rank")


def stored_faces(d):
    """One stored face per person of a video."""
    f = d.where("kind = 'face'").groupBy(F.col("video_id").alias("job_id"), "person_no").agg(F.count(F.lit(1)).alias("encoding"))
    return f.select("job_id", F.concat(F.lit("person_"), F.col("person_no").cast("string")).alias("stable_person_id"), "encoding")


def request_rows(spark, sf):
    o, k = table(spark, sf, "orders"), F.col("o_orderkey")
    text = lambda c: c.cast("string")
    return o.select(
        k.alias("request_id"), F.when(k % 97 > 0, F.col("o_custkey") % 7).alias("job_id"),
        F.when(k % 4 == 0, F.concat(F.lit('["person_'), text(k % 40), F.lit('","person_'), text(k % 40), F.lit('"]'))).when(k % 4 == 1, F.concat(F.lit("person_"), text(k % 31), F.lit(", person_99 "))).alias("person_ids"),
        F.lit(None).cast("string").alias("focus_person_ids"), F.when(k % 8 == 2, "e1,e2").alias("entity_ids"), F.when(k % 4 == 3, '[{"x":0.1,"y":0.1,"width":0.2,"height":0.2,"reason":"Face"}]').alias("custom_regions"),
        F.when(k % 3 == 0, "Black").when(k % 3 == 1, "pixel").alias("redaction_style"), F.lit(None).cast("string").alias("redaction_mode"), F.lit(None).cast("string").alias("reverse_face_redaction"),
        text(k % 400).alias("blur_strength"), F.lit("5").alias("detect_every_n"), F.lit(None).cast("string").alias("detect_every_seconds"), F.lit("no").alias("use_temporal_optimization"),
        F.when(k % 5 == 0, "1080p").when(k % 5 == 1, "333").alias("export_quality"),
    )


def planned(spark, sf):
    d = det(spark, sf)
    js = d.select(F.col("video_id").alias("job_id")).distinct().withColumn("status", F.when(F.col("job_id") == 3, "processing").otherwise("ready"))
    return requests.plan_requests(request_rows(spark, sf), js, stored_faces(d))


PLAN = f"""f AS (SELECT DISTINCT video_id AS job_id, person_no FROM det WHERE kind='face'), q AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey%97>0 THEN o_custkey%7 END AS job_id FROM orders),
w AS (SELECT q.*, f1.person_no IS NOT NULL AS found, CASE WHEN k%5=0 THEN 1080 WHEN k%5=1 THEN 333 ELSE 720 END AS oh FROM q LEFT JOIN f f1 ON f1.job_id=q.job_id AND f1.person_no = CASE k%4 WHEN 0 THEN k%40 WHEN 1 THEN k%31 END),
z AS (SELECT *, CASE WHEN job_id IS NULL THEN 400 WHEN job_id NOT IN (SELECT job_id FROM f) THEN 404 WHEN job_id=3 THEN 409 WHEN oh=333 THEN 400 WHEN k%4 IN (0,1) AND NOT found THEN 400 WHEN k%4=2 AND k%8<>2 THEN 400 END AS code FROM w)"""


@query("plan_requests", f"""
WITH {DET}, {PLAN} SELECT k AS request_id, CAST(job_id AS BIGINT) AS job_id, CASE WHEN k%3=0 THEN 'black' ELSE 'blur' END AS style, CAST(CASE WHEN k%3=0 THEN k%400 ELSE greatest(220, k%400) END AS INTEGER) AS strength, CAST(oh AS INTEGER) AS output_height,
 CASE WHEN found OR k%4=3 THEN 1 ELSE 5 END AS every_n FROM z WHERE code IS NULL""")  # fmt: skip
def plan_requests(spark, sf):
    return planned(spark, sf)[0].select("request_id", "job_id", "style", "strength", "output_height", "every_n")


@query("rejected_requests", f"WITH {DET}, {PLAN} SELECT k AS request_id, CAST(code AS INTEGER) AS error_code FROM z WHERE code IS NOT NULL")
def rejected_requests(spark, sf):
    return planned(spark, sf)[1].select("request_id", "error_code")


@query("unresolved_targets", f"""
WITH {DET}, {PLAN}, ids AS (SELECT DISTINCT z.k, z.job_id, 'person_' || CASE k%4 WHEN 0 THEN k%40 ELSE k%31 END AS pid, found FROM z WHERE code IS NULL AND k%4 IN (0,1) UNION ALL SELECT k, job_id, 'person_99', FALSE FROM z WHERE code IS NULL AND k%4=1)
SELECT k AS request_id, pid AS person_id, 'No matching face encoding was available' AS reason FROM ids WHERE NOT found""")  # fmt: skip
def unresolved_targets(spark, sf):
    return planned(spark, sf)[3].select("request_id", "person_id", "reason")


@query("run_report")
def run_report(spark, sf):
    good, _, found, lost = planned(spark, sf)
    d = det(spark, sf)
    head = d.where("label = 'purchase'").select(F.col("video_id").alias("job_id"), F.concat(F.lit("person_"), F.col("person_no").cast("string")).alias("person_id")).distinct()
    stats = d.groupBy(F.col("video_id").alias("job_id")).agg(F.countDistinct("frame_idx").alias("masked_frames"))
    report, _ = masks.run_report(good, found, lost, head, stats)
    return report.select("request_id", "export_quality", F.size("person_ids_used").alias("used"), F.size("unresolved_person_ids").alias("unresolved"), "masked_frames")


def plan_tables(spark, sf):
    d = det(spark, sf).withColumns({"person_id": F.col("person_no").cast("string"), "f": F.col("frame_idx")})
    lane = d.where("label = 'purchase'").groupBy("video_id", "person_id", "f").agg(F.min_by(F.struct(*BOX), "seq").alias("b")).select("video_id", "person_id", "f", "b.*")
    dets = d.where("label <> 'purchase'").select("video_id", "f", "kind", "person_id", *BOX, "seq")
    limit = ranges.target_ranges(d.where("label = 'view'").withColumn("t", F.col("t_ms") / 1000.0), ["video_id"])
    regions = d.where("label = 'error'").select("video_id", "f", *BOX, F.lit("oval").alias("shape"), F.lit("blur").alias("effect"))
    return lane, dets, regions, limit


PLAN = f"""{DET}, lane AS (SELECT video_id, person_no, frame_idx AS f, arg_min({{'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}}, seq) AS b FROM det WHERE label='purchase' GROUP BY 1, 2, 3),
vw AS (SELECT video_id, greatest(0, t_ms-1000) AS s, t_ms+1350 AS e FROM det WHERE label='view'), {islands("vw", "video_id", 500, "lim")},
dd AS (SELECT * FROM det d WHERE label NOT IN ('purchase') AND (kind='face' OR frame_idx % 2 = 0)
  AND (kind='object' OR NOT EXISTS (SELECT 1 FROM lane l WHERE l.video_id=d.video_id AND l.person_no=d.person_no))
  AND (EXISTS (SELECT 1 FROM lim WHERE lim.video_id=d.video_id AND d.frame_idx*40 BETWEEN s AND e) OR NOT EXISTS (SELECT 1 FROM lim WHERE lim.video_id=d.video_id))),
plan AS (SELECT video_id, f, 'lane' AS origin, b.x1 AS x1, b.y1 AS y1, b.x2 AS x2, b.y2 AS y2, 'rect' AS shape FROM lane
  UNION ALL SELECT video_id, frame_idx, 'detection', x1, y1, x2, y2, 'rect' FROM dd
  UNION ALL SELECT video_id, frame_idx, 'region', x1, y1, x2, y2, 'oval' FROM det WHERE label='error')"""


@query("mask_plan", f"WITH {PLAN} SELECT video_id, f, origin, x1, y1, x2, y2, shape FROM plan")
def mask_plan(spark, sf):
    lane, dets, regions, limit = plan_tables(spark, sf)
    p, _ = masks.mask_plan(lane, dets, regions, lane, limit, ["video_id"], 1920, 1080, every_n=2)
    return p.select("video_id", "f", "origin", *BOX, "shape")


@query("reverse_mask_plan")
def reverse_mask_plan(spark, sf):
    lane, dets, regions, _ = plan_tables(spark, sf)
    p, r = masks.mask_plan(lane, dets, regions, lane, None, ["video_id"], 1920, 1080, reverse=True)
    return p.select("video_id", "f", F.col("origin"), *BOX).unionByName(r.select("video_id", "f", F.lit("restore").alias("origin"), *BOX))


@query("mask_stats", f"""
WITH {PLAN} SELECT video_id, count(DISTINCT f) AS masked_frames, count(*) FILTER (origin='lane') AS lane_masks, count(*) FILTER (origin='detection') AS detection_masks,
  count(*) FILTER (origin='region') AS region_masks, min(f) AS first_frame, max(f) AS last_frame FROM plan GROUP BY 1""")  # fmt: skip
def mask_stats(spark, sf):
    lane, dets, regions, limit = plan_tables(spark, sf)
    p, _ = masks.mask_plan(lane, dets, regions, lane, limit, ["video_id"], 1920, 1080, every_n=2)
    return masks.run_stats(p, None, ["video_id"])


@query("lane_build")
def lane_build(spark, sf):
    d = faces(spark, sf)
    a = d.select(*VP, (F.col("t_ms") / 1000.0).alias("t"), F.col("frame_idx").alias("f"), "seq", *BOX)
    lane, _ = jobs.build_lanes(a, None, None, VP, FPS, F.lit(10_800), 1920, 1080)
    return lanes.lane_stats(lane, VP)


def live_rows(spark, sf):
    n = B.to_norm(box(), 1920, 1080)
    return det(spark, sf).select(
        F.col("video_id").cast("string").alias("job_id"), (F.col("t_ms") / 1000.0).alias("time_sec"), F.col("seq").alias("det_id"), "kind", "label",
        F.when(F.col("score100") >= 30, F.col("person_no").cast("string")).alias("person_id"), F.col("label").alias("object_class"), (F.col("score100") / 100.0).alias("confidence"), *(c.alias(k) for k, c in n.items()),
    )


@query("live_replay")
def live_replay(spark, sf):
    return live.replay_live_tracks(live_rows(spark, sf))


@query("stabilize_replay")
def stabilize_replay(spark, sf):
    return live.replay_stabilize(live_rows(spark, sf))


@query("display_replay")
def display_replay(spark, sf):
    """Tracking, then display: what the chained stream shows."""
    return live.replay_stabilize(live.replay_live_tracks(live_rows(spark, sf), display_runs=True))
