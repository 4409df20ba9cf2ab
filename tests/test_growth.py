"""Operators whose cost once grew faster than their input: same results, bounded work."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from framesafe.functions import boxes as B
from framesafe.operators import catalog, identity, lane_blocks, lanes
from framesafe.plans import jobs
from framesafe.workload import bindings, identity_queries


def most_joined(df) -> int:
    """The most rows that a join of the query puts out."""
    df.collect()
    most, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        plan = todo.pop()
        name = plan.nodeName()
        if name.startswith("AdaptiveSparkPlan"):
            todo.append(plan.executedPlan())
        elif name.endswith("QueryStage"):
            todo.append(plan.plan())
        else:
            if "Join" in name:
                most = max(most, plan.metrics().apply("numOutputRows").value())
            todo += [plan.children().apply(i) for i in range(plan.children().size())]
    return most


def plain_source(t, files, variant):
    bonus_of = catalog.JOB_BONUS if variant == "job" else catalog.VIDEO_BONUS
    diff = lambda a, b, k: abs(a - b) * k if a and b else 0.0
    best = None
    for path, mtime, w, h, d in files:
        s = abs(mtime - t[1]) - next((v for p, v in bonus_of.items() if path.lower().startswith(p)), 0.0)
        s += diff(w, t[2], 1.5) + diff(h, t[3], 1.5) + diff(d, t[4], 30.0)
        s -= 240.0 if variant == "video" and t[5] and path.lower() == t[5].lower() else 0.0
        if best is None or (round(s, 6), path) < best:
            best = (round(s, 6), path)
    return best


def test_source_files_equal_all_pairs_and_few_are_compared(spark):
    r = random.Random(5)
    size = lambda: r.choice([(640, 360), (1920, 1080), (1918, 1080), (0, 0), (None, 720)])
    names = [r.choice(["input_", "Upload_", "clip_", "index_"]) + str(k) for k in range(2000)]
    files = [(n, r.uniform(0, 600), *size(), r.choice([None, 0.0, r.uniform(1, 90)])) for n in names]
    files += [("zz", *files[0][1:]), ("aa", *files[0][1:])]
    targets = [(k, r.uniform(-50, 5000) if k % 9 else r.uniform(0, 600), *size(), r.choice([None, r.uniform(1, 90)]), r.choice(["", names[k], None])) for k in range(250)]
    f = spark.createDataFrame([(p, p, *x) for p, *x in files], "path string, name string, mtime double, width int, height int, duration double")
    t = spark.createDataFrame(targets, "job_id long, time double, width int, height int, duration double, filename string")
    for variant in ("job", "video"):
        got = {x.job_id: (round(x.score, 6), x.path) for x in catalog.infer_source(t, f, variant=variant).collect()}
        assert got == {x[0]: plain_source(x, files, variant) for x in targets}
    timed = t.withColumn("time", F.col("job_id") * 2.0).where("width > 0 AND height > 0 AND duration IS NOT NULL")
    full = f.where("width > 0 AND height > 0 AND duration > 0")
    assert most_joined(catalog.infer_source(timed, full, bucket=600.0)) < timed.count() * full.count() // 10


def test_topk_by_group_sends_no_queries_through_the_driver(spark, monkeypatch):
    r = np.random.default_rng(3)
    v = np.repeat(r.normal(size=(40, 8)), 5, axis=0)  # copies of vectors: ties
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    df = spark.createDataFrame([(k, k % 9, v[k].tolist()) for k in range(200)], "id long, video long, vec array<double>").repartition(5)
    q, it = df.withColumnRenamed("id", "query_id"), df.withColumnRenamed("id", "item_id")
    ordered = lambda d: sorted(tuple(x) for x in d.collect())
    top = lambda block: ordered(identity.vector_topk(q, it, 6, digits=6, skip_self=True, query_block=block).select("query_id", "rank", "item_id", "score"))
    by_group = lambda block: identity.vector_topk_grouped(q, it, "video", 3, 2, digits=6, query_block=block)
    shipped, plain = ordered(by_group(1000)), top(1000)
    monkeypatch.setattr(identity, "ITEM_BLOCK", 70)
    monkeypatch.setattr(identity, "SCORES", 64)
    assert top(30) == plain
    monkeypatch.setattr(type(q), "toPandas", None)
    assert ordered(by_group(30)) == shipped


def test_centroids_are_added_up_without_a_row_per_dimension(spark):
    r = np.random.default_rng(8)
    v = r.normal(size=(300, 5))
    rows = [("hot" if k % 3 else None, None if k % 7 == 0 else k % 4, v[k].tolist() if k % 5 else None) for k in range(300)]
    df = spark.createDataFrame(rows, "job string, person int, encoding array<double>").repartition(6)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        out = identity.centroids(df, ["job", "person"], normalise=False)
        got = {(x.job, x.person): (x.members, x.centroid) for x in out.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    of = {}
    for k, (j, p, x) in enumerate(rows):
        if x is not None:
            of.setdefault((j, p), []).append(v[k])
    assert set(got) == set(of) and all(got[g][0] == len(x) and np.allclose(got[g][1], np.mean(x, axis=0)) for g, x in of.items())
    assert "posexplode" not in out._jdf.queryExecution().executedPlan().toString()


def test_detections_stay_where_they_are_when_few_vectors_are_used(spark, sf):
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # as with large tables of embeddings
    try:
        d = bindings.with_encoding(spark, sf, bindings.faces(spark, sf))
        plan = d._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert "SortMergeJoin [base_vec" not in plan and "SortMergeJoin [noise_vec" not in plan
    e = bindings.table(spark, sf, "embeddings").select("vec_id").distinct().count()
    assert d.count() == bindings.faces(spark, sf).where(f"base_vec < {e} AND noise_vec < {e}").count()


def test_ingestion_clusters_once(spark, sf, monkeypatch):
    dets, people, ranges = identity_queries.ingest_tables(spark, sf)
    runs = spark.sparkContext.accumulator(0)
    add = identity.JobClusters.add

    class Counted(identity.JobClusters):
        def add(self, x, quality):
            runs.add(len(x))
            add(self, x, quality)

    monkeypatch.setattr(identity, "JobClusters", Counted)
    faces, _ = jobs.ingest(dets, people, ranges, job="video_id")
    faces.collect()
    assert runs.value == dets.count()


@pytest.mark.parametrize("with_signals", [False, True])
def test_replay_leaves_out_frames_of_lost_tracks_only(spark, with_signals):
    r = random.Random(2)
    at = [5, 20, 64, 65, 66, 112, 113, 160, 400, 900, 946, 993]  # gaps around the grace, and long ones
    box = lambda f: (10.0 + f % 7, 20.0, 60.0 + f % 9, 90.0)
    anchors = [("v", 0, f, n, *box(f + n)) for f in at for n in range(1 + (f % 2))]
    signals = [("v", 0, d, f, "optical", 0.9, *box(f)) for d in (1, -1) for f in r.sample(range(1000), 30)] + [("v", 0, 1, 1000, "global", 0.1, *box(3))]
    a = spark.createDataFrame(anchors, "k string, segment int, f long, seq long, x1 double, y1 double, x2 double, y2 double")
    sg = spark.createDataFrame(signals, "k string, segment int, direction int, f long, source string, score double, x1 double, y1 double, x2 double, y2 double")
    seg = spark.createDataFrame([("v", 0, 0, 2000)], "k string, segment int, start_frame long, end_frame long")
    frames = lanes.replay_frames(seg, a, sg if with_signals else None, ["k"])
    every = frames.select("k", "segment").distinct().crossJoin(spark.createDataFrame([(1, 5, 2000), (-1, 0, 993)], "direction int, lo long, hi long"))
    every = every.select("k", "segment", "direction", F.explode(F.sequence("lo", "hi")).alias("f")).join(frames, ["k", "segment", "direction", "f"], "left")
    of = lambda df: sorted((x.direction, x.f, *(round(x[n], 9) for n in ("x1", "y1", "x2", "y2")), x.src, x.conf) for x in lanes.replay_tracks(df, ["k", "segment"], 640, 480).collect())
    assert of(frames) == of(every)
    assert with_signals or frames.count() < 1200


LANE = "k string, segment int, f long, seq long, x1 double, y1 double, x2 double, y2 double"


def seen(seed: int, signals: bool):
    """Anchors (also several in a frame, also the same twice) and signals of some lanes, dense and sparse ones."""
    r = random.Random(seed)
    place = lambda f: (x := 300 + 40 * math.sin(f / 9) + r.uniform(-6, 6), y := 150 + r.uniform(-6, 6), x + r.uniform(5, 90), y + r.uniform(5, 110))
    anchors, sig, segments = [], [], []
    for lane in range(9):
        at = sorted(r.sample(range(0, 3000 if lane % 3 else 120), 60))
        anchors += [(f"v{lane}", 7, f, 10 * f + n, *place(f)) for f in at for n in range(r.choice((1, 1, 1, 2, 3)))]
        segments.append((f"v{lane}", 7, max(0, at[0] - 60), at[-1] + 60))
        if lane % 2 and signals:
            for d in (1, -1):
                sig += [(f"v{lane}", 7, d, f, s, r.choice((0.1, 0.6, None)), *place(f)) for f in r.sample(range(at[0] - 30, at[-1] + 40), 50) for s in r.sample(["optical", "template", "tracker", "global"], 2)]
    anchors += anchors[:3]
    return anchors, sig, segments


@pytest.mark.parametrize("signals, rows", [(False, 2048), (True, 7)])
def test_lanes_in_blocks_are_those_of_the_operators_on_frames(spark, monkeypatch, signals, rows):
    anchors, sig, segments = seen(3, signals)
    a, seg = spark.createDataFrame(anchors, LANE), spark.createDataFrame(segments, "k string, segment int, start_frame long, end_frame long")
    sg = spark.createDataFrame(sig, "k string, segment int, direction int, f long, source string, score double, x1 double, y1 double, x2 double, y2 double") if signals else None
    monkeypatch.setattr(lane_blocks, "BLOCK_ROWS", rows)
    monkeypatch.setattr(lane_blocks, "OUT_ROWS", 100)
    k = ["k", "segment"]
    grid = lanes.replay_tracks(lanes.replay_frames(seg, a, sg, ["k"]), k, 640, 480).cache()
    blocks = lanes.replay_frames(seg, a, sg, ["k"], grid=False)

    def all_steps(way):
        fwd, bwd = way(1), way(-1)
        yield from (fwd, bwd)
        lane = lanes.stabilize_scale(lanes.fuse_lanes(fwd, bwd, k, 640, 480), k, 640, 480)
        yield lanes.smooth_bidirectional(lane, k, 0.5, 640, 480)

    plain = all_steps(lambda d: grid.where(f"direction = {d}").drop("direction"))
    whole = all_steps(lambda d: lanes.replay_tracks(blocks, k, 640, 480, direction=d))
    for want, got in zip(plain, whole):
        x, y = (sorted(df.collect(), key=lambda r: (r.k, r.f)) for df in (want, got.rows()))
        assert [(r.k, r.segment, r.f, r.src) for r in x] == [(r.k, r.segment, r.f, r.src) for r in y] and len(x) > 900
        assert max(abs(p[c] - q[c]) for p, q in zip(x, y) for c in ("x1", "y1", "x2", "y2", "conf")) < 1e-6
    grid.unpersist()


def test_lane_build_shuffles_no_frames(spark):
    rows = [(v, p, 0.04 * f, f, 100 * f + p, 50.0 + f % 9, 60.0, 90.0 + f % 9, 120.0) for v in range(3) for p in range(2) for f in range(0, 4000, 37)]
    a = spark.createDataFrame(rows, "video_id int, person_no int, t double, f long, seq long, x1 double, y1 double, x2 double, y2 double")
    lane, _ = jobs.build_lanes(a, None, None, ["video_id", "person_no"], 25.0, F.lit(10_800), 1920, 1080)
    assert lanes.lane_stats(lane, ["video_id", "person_no"]).select("frames", "anchors").distinct().collect() == [(3997 + 22, 109)]
    plan = lane._jdf.queryExecution().executedPlan().toString()
    after = plan[: plan.index("MapInArrow")]  # a plan begins with its last step
    assert not any(x in after for x in ("Exchange", "Join", "Window", "MapInPandas", "RDD"))


@pytest.mark.parametrize("forward", [True, False])
def test_choose_seed_looks_at_the_next_three_anchor_frames(spark, forward):
    def iou(a, b):
        w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
        inter = max(0.0, w) * max(0.0, h)
        return inter / (area(a) + area(b) - inter)

    area = lambda a: (a[2] - a[0]) * (a[3] - a[1])
    diag = lambda a: math.hypot(a[2] - a[0], a[3] - a[1])
    dist = lambda a, b: math.hypot((a[0] + a[2] - b[0] - b[2]) / 2, (a[1] + a[3] - b[1] - b[3]) / 2)
    gap = lambda a, b: abs(math.log(area(a) / area(b)))
    anchors, _, _ = seen(5, False)
    refs = {f"v{n}": (300.0, 150.0, 340.0, 200.0 + 9 * n) for n in range(0, 9, 2)}
    a, r = spark.createDataFrame(anchors, LANE), spark.createDataFrame([(k, *b) for k, b in refs.items()], "k string, x1 double, y1 double, x2 double, y2 double")
    for known in ({}, refs):
        got = {x.k: x.seq for x in lanes.choose_seed(a, ["k"], r if known else None, forward).collect()}
        want = {}
        for k in {x[0] for x in anchors}:
            own = [x for x in anchors if x[0] == k]
            frames = sorted({x[2] for x in own}, reverse=not forward)[:4]
            marks = []
            for c in (x for x in own if x[2] == frames[0]):
                s = []
                for f in frames[1:]:
                    n = max((x for x in own if x[2] == f), key=lambda n: (iou(n[4:], c[4:]) * 3.2 - dist(n[4:], c[4:]) / max(1.0, diag(c[4:])) * 1.8 - gap(n[4:], c[4:]) * 0.35, -n[3]))
                    s.append(iou(c[4:], n[4:]) * 2.6 - dist(c[4:], n[4:]) / max(1.0, diag(c[4:])))
                if b := known.get(k):
                    s.append(iou(c[4:], b) * 4 - dist(c[4:], b) / max(1.0, diag(b)) * 1.55 - gap(c[4:], b) * 0.3)
                marks.append((sum(s) / len(s), -c[3]))
            want[k] = -max(marks)[1]
        assert got == want


def test_stored_lane_boxes_are_padded_as_before(spark):
    r = random.Random(1)
    rows = [("v", f, x := r.uniform(-5, 600), y := r.uniform(-5, 440), x + r.choice((0.0, 3.5, 40.0, 150.0)), y + r.uniform(0, 160), r.choice(["anchor", "head_fallback", "", None]), r.choice((0.123456, None))) for f in range(400)]
    rows += [("v", 400, None, None, None, None, "anchor", 1.0), ("v", 401, 700.0, 10.0, 720.0, 30.0, "anchor", 1.0)]
    df = spark.createDataFrame(rows, "k string, f long, x1 double, y1 double, x2 double, y2 double, src string, conf double")
    pad = B.safety_pad(B.box(), 640, 480, F.col("src"))
    want = df.select("f", *(F.bround(c, 3).alias(n) for n, c in zip(B.Box._fields, pad))).where("x1 IS NOT NULL").collect()
    got = lanes.serialize_lane(df, ["k"], 25.0, 640, 480)
    assert got.columns == ["k", "f", "t", "x1", "y1", "x2", "y2", "src", "conf"]
    assert sorted(want) == sorted(got.select("f", *B.Box._fields).collect()) and 300 < len(want) < 402
