"""Small exact cases and properties, against plain Python where SQL is no help."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from framesafe.functions import boxes as B
from framesafe.functions import payload as P
from framesafe.functions import scalars as S
from framesafe.functions.boxes import Box, box
from framesafe.operators import boxjoins, catalog, identity, lanes, matching, privacy, ranges, scans
from framesafe.session import checkpoint

BOX = ["x1", "y1", "x2", "y2"]


def rows(df):
    return sorted(tuple(r) for r in df.collect())


# -- ranges ----------------------------------------------------------------------------------


def plain_merge(items, gap):
    out = []
    for s, e in sorted(items):
        if out and s <= out[-1][1] + gap:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [tuple(x) for x in out]


@pytest.mark.parametrize("gap", [0, 3, 50])
def test_merge_equals_plain_merge_with_a_hot_key(spark, gap):
    rng = random.Random(gap)
    data = []
    for _ in range(3000):
        key = "hot" if rng.random() < 0.5 else f"k{rng.randrange(20)}"
        s = rng.randrange(20_000)
        data.append((key, s, s + rng.randrange(40)))
    df = spark.createDataFrame(data, "k string, start long, end long")
    got = rows(ranges.merge_ranges(df, ["k"], gap))
    want = sorted((k, *r) for k in {d[0] for d in data} for r in plain_merge([d[1:] for d in data if d[0] == k], gap))
    assert got == want
    again = rows(ranges.merge_ranges(ranges.merge_ranges(df, ["k"], gap), ["k"], gap))
    assert again == want


def test_points_meet_ranges_of_any_length(spark):
    rng = random.Random(11)
    spans = []
    for i in range(400):
        s = rng.uniform(-3e4, 3e4)
        spans.append((rng.choice(["hot", "hot", "a", None]), i, s, s + rng.choice([0.0, 0.3, 70.0, 81.0, 500.0, 2e4, -5.0])))
    spans += [("far", 400, -1e9, 1e9), ("far", 401, float("-inf"), float("inf")), ("a", 402, None, 5.0), ("a", 403, 5.0, None)]
    at = [(i, rng.choice(["hot", "a", "far", "none", None]), rng.choice([rng.uniform(-4e4, 4e4), float(rng.randrange(-50, 50)), None])) for i in range(600)]
    at += [(600, "hot", spans[0][2]), (601, "far", 1e12), (601, "far", 1e12)]
    r = spark.createDataFrame(spans, "k string, r int, start double, end double")
    p = spark.createDataFrame(at, "i int, k string, t double")
    holds = lambda x, y: None not in (x[1], x[2], y[0], y[2], y[3]) and x[1] == y[0] and y[2] <= x[2] <= y[3]
    pairs = [(x, y) for x in at for y in spans if holds(x, y)]
    inside = {x for x, _ in pairs}
    order = lambda z: sorted(z, key=repr)
    meet = lambda how: ranges.points_in_ranges(p, r, ["k"], "t", 5.0, how)
    assert order(tuple(z) for z in meet("inner").select("i", "r").collect()) == order((x[0], y[1]) for x, y in pairs)
    assert order(tuple(z) for z in meet("left_semi").collect()) == order(x for x in at if x in inside)
    assert order(tuple(z) for z in meet("left_anti").collect()) == order(x for x in at if x not in inside)
    assert order(tuple(z) for z in meet("left").select("i", "r").collect()) == order([(x[0], y[1]) for x, y in pairs] + [(x[0], None) for x in at if x not in inside])
    assert ranges.points_in_ranges(p, r.limit(0), ["k"], "t", 5.0, "left_anti").count() == len(at)
    rows_of_long = ranges.covered_ranges(r.where("r = 400"), 5.0).count()
    assert rows_of_long < 100


def test_scan_carries_state_across_chunks(spark):
    rng = random.Random(5)
    data = [(rng.choice("ab"), i, rng.choice([None, None, i])) for i in range(400)]
    df = spark.createDataFrame(data, "k string, i long, v long")
    specs = {"prev": scans.last(F.col("v")), "nxt": scans.following(F.col("v"), current=False), "n": scans.count_so_far(F.col("v").isNotNull()),
             "top": scans.max_before(F.col("v")), "all": scans.total(F.col("v").isNotNull())}
    for chunk in (7, 1000):
        got = {(r.k, r.i): (r.prev, r.nxt, r.n, r.top, r.all) for r in scans.scan(df, ["k"], ["i"], chunk, specs).collect()}
        for key in "ab":
            seq = [(i, v) for k, i, v in data if k == key]
            have = [v for _, v in seq if v is not None]
            for i, _ in seq:
                seen = [v for j, v in seq if v is not None and j <= i]
                later = [v for j, v in seq if v is not None and j > i]
                before = [v for j, v in seq if v is not None and j < i]
                assert got[key, i] == (seen[-1] if seen else None, later[0] if later else None, len(seen), max(before, default=None), len(have))


def test_norm_and_widen(spark):
    df = spark.createDataFrame([("a", 1.0, 1.1)], "k string, start double, end double")
    assert rows(ranges.merge_ranges(df, ["k"], 0.45, 0.55)) == [("a", pytest.approx(0.775), pytest.approx(1.55))]


# -- boxes -----------------------------------------------------------------------------------


def test_box_rules(spark):
    df = spark.createDataFrame([(10.0, 20.0, 50.0, 80.0, 30.0, 20.0, 70.0, 80.0)], ", ".join(f"{p}{c} double" for p in ("a_", "b_") for c in BOX))
    a, b = box("a_"), box("b_")
    r = df.select(B.box_iou(a, b).alias("iou"), B.box_center_dist(a, b).alias("d"), *B.mask_pad(a, 1920, 1080).columns("m_"),
                  *B.box_expand(a, 2.0, 55, 90).columns("e_"), *B.roi_to_box(a.x1, a.y1, a.x2, a.y2, 0.5, 100, 100).columns("r_")).first()
    assert r.iou == pytest.approx(1 / 3) and r.d == 20
    assert (r.m_x1, r.m_y1, r.m_x2, r.m_y2) == (6, 9, 54, 86)
    assert (r.e_x1, r.e_y1, r.e_x2, r.e_y2) == (0, 0, 55, 90)
    assert (r.r_x1, r.r_y1, r.r_x2, r.r_y2) == (5, 10, 30, 50)


def test_missing_boxes_stay_missing(spark):
    df = spark.createDataFrame([(None, None, None, None)], ", ".join(f"{c} double" for c in BOX))
    v = B.valid_box(box())
    r = df.select(B.box_iou(box(), box()).alias("iou"), B.box_center_dist(box(), box()).alias("d"), v.x1.alias("x")).first()
    assert (r.iou, r.d, r.x) == (0.0, 1e9, None)


def test_affine_and_union(spark):
    one = spark.range(1)
    a = Box(*(F.lit(float(v)) for v in (10, 10, 20, 20)))
    b = Box(*(F.lit(float(v)) for v in (30, 15, 40, 35)))
    m = [F.lit(float(v)) for v in (1, 0, 5, 0, 1, -3)]
    r = one.select(*B.box_affine(a, m, 100, 100).columns("m"), *B.box_union(a, b, 100, 100).columns("u")).first()
    assert tuple(r) == (15, 7, 25, 17, 10, 10, 40, 35)


# -- matching --------------------------------------------------------------------------------


def plain_greedy(pairs):
    out, left, right = [], set(), set()
    for s, i, j in sorted(pairs, key=lambda p: (-p[0], p[1], p[2])):
        if i not in left and j not in right:
            left.add(i)
            right.add(j)
            out.append((i, j))
    return sorted(out)


@pytest.mark.parametrize("limit", [5, 10_000])
def test_greedy_match_in_folds_and_in_rounds(spark, limit):
    rng = random.Random(3)
    pairs = [("g", i, j, float(rng.randrange(12))) for i in range(15) for j in range(15) if rng.random() < 0.5]
    df = spark.createDataFrame(pairs, "g string, l long, r long, score double")
    got = matching.greedy_match(df, ["g"], "l", "r", [-F.col("score"), F.col("l"), F.col("r")], fold_limit=limit)
    assert sorted((r.l, r.r) for r in got.collect()) == plain_greedy([(p[3], p[1], p[2]) for p in pairs])


@pytest.mark.parametrize("limit", [3, 10_000])
def test_suppress_in_folds_and_in_rounds(spark, limit):
    rng = random.Random(8)
    data = [("f", i, float(x := rng.randrange(60)), float(y := rng.randrange(60)), float(x + 30), float(y + 30)) for i in range(25)]
    df = spark.createDataFrame(data, "g string, seq long, x1 double, y1 double, x2 double, y2 double")
    kept = []
    for r in data:
        if all(lanes._iou(r[2:], k[2:]) <= 0.3 for k in kept):
            kept.append(r)
    got = matching.suppress(df, ["g"], "seq", 0.3, fold_limit=limit)
    assert sorted(r.seq for r in got.collect()) == [k[1] for k in kept]


def test_focus_best_removes_one_face_per_preserve_box(spark):
    faces = spark.createDataFrame([(1, i, "face", 10.0 * i, 0.0, 10.0 * i + 30, 30.0) for i in range(4)], "f long, seq long, kind string, x1 double, y1 double, x2 double, y2 double")
    focus = spark.createDataFrame([(1, 0, 0.0, 0.0, 30.0, 30.0)], "f long, pos long, x1 double, y1 double, x2 double, y2 double")
    assert sorted(r.seq for r in boxjoins.drop_focus_best(faces, focus, ["f"]).collect()) == [1, 2, 3]


# -- identity --------------------------------------------------------------------------------


def plain_clusters(vecs, quality, limit):
    """The clustering rule restated with lists."""
    unit = lambda v: v / np.linalg.norm(v)
    cl = []
    for n, v in enumerate(vecs):
        best, top = None, -1.0
        for c in cl:
            sims = [float(v @ unit(np.mean([vecs[m] for m in c], axis=0)))]
            if len(c) <= 60:
                sims += [float(v @ vecs[m]) for m in c]
            if max(sims) > limit and max(sims) > top:
                best, top = c, max(sims)
        best.append(n) if best is not None else cl.append([n])

    def passes(cl, test):
        for _ in range(10):
            new, used = [], set()
            for i, c in enumerate(cl):
                if i in used:
                    continue
                for j in range(i + 1, len(cl)):
                    if j not in used and test(c, cl[j]):
                        c.extend(cl[j])
                        used.add(j)
                new.append(c)
            cl = new
            if not used:
                break
        return cl

    some = lambda c: c if len(c) <= 30 else [c[i] for i in np.linspace(0, len(c) - 1, 30, dtype=int)]
    cen = lambda c: unit(np.mean([vecs[m] for m in c], axis=0))
    rep = lambda c: vecs[max(c, key=lambda m: (quality[m], -c.index(m)))]
    cl = passes(cl, lambda a, b: cen(a) @ cen(b) > 0.40)
    cl = passes(cl, lambda a, b: max(vecs[x] @ vecs[y] for x in some(a) for y in some(b)) > 0.38)
    cl = passes(cl, lambda a, b: rep(a) @ rep(b) > limit)
    return sorted(tuple(sorted(c)) for c in cl)


def people(n, spread, seed=1, dim=24):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((6, dim))
    v = base[rng.integers(0, 6, n)] + spread * rng.standard_normal((n, dim))
    return v / np.linalg.norm(v, axis=1, keepdims=True)


@pytest.mark.parametrize("spread", [0.3, 0.8, 1.6])
def test_clusters_equal_the_plain_rule(spark, spread):
    v = people(150, spread)
    q = [float(x) for x in np.random.default_rng(2).random(150)]
    df = spark.createDataFrame([("j", i, v[i].tolist(), q[i], 0.0) for i in range(150)], "job_id string, seq long, encoding array<double>, det_score double, sharpness double")
    got = {}
    for r in identity.cluster_faces(df.repartition(5)).collect():
        got.setdefault(r.cluster, []).append(r.seq)
    assert sorted(tuple(sorted(c)) for c in got.values()) == plain_clusters(v, q, 0.42)


@pytest.mark.parametrize("block, held", [(1, 1 << 30), (7, 0), (64, 5000), (256, 0), (10_000, 1 << 30)])
def test_one_clustering_rule_at_every_size(block, held):
    """Blocks and scratch files change nothing, also where clusters outgrow the limits of members and samples."""
    v, q = people(420, 0.9, seed=4), np.random.default_rng(5).random(420)
    c = identity.JobClusters(0.42, block, held)
    for at in range(0, 420, 50):
        c.add(v[at : at + 50] * 3.0, q[at : at + 50])
    got = {}
    for n, label in enumerate(c.labels().tolist()):
        got.setdefault(label, []).append(n)
    want = plain_clusters(v, q.tolist(), 0.42)
    assert sorted(tuple(x) for x in got.values()) == want and max(map(len, want)) > 60
    assert [got[k][0] for k in sorted(got)] == sorted(x[0] for x in got.values())


def test_clusters_of_many_jobs_and_batches(spark):
    v = people(300, 0.8)
    df = spark.createDataFrame([(f"j{i % 3}", i, v[i].tolist() if i % 10 else None, 0.5, None) for i in range(300)], "job_id string, seq long, encoding array<double>, det_score double, sharpness double")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 17)
    try:
        got = {}
        for r in identity.cluster_faces(df, held=1000).collect():
            got.setdefault((r.job_id, r.cluster), []).append(r.seq)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for k in range(3):
        mine = [i for i in range(300) if i % 3 == k and i % 10]
        want = [tuple(mine[n] for n in c) for c in plain_clusters(v[mine], [0.5] * len(mine), 0.42)]
        assert sorted(tuple(sorted(s)) for (j, _), s in got.items() if j == f"j{k}") == sorted(want)
    assert identity.cluster_faces(df.limit(0)).collect() == []


def test_topk_by_group_in_blocks_and_batches(spark):
    v = people(90, 1.0)
    df = spark.createDataFrame([(i, i % 7 if i % 11 else None, v[i].tolist() if i % 13 else None) for i in range(90)], "id long, video long, vec array<double>").repartition(6)
    q, it = df.withColumnRenamed("id", "query_id"), df.withColumnRenamed("id", "item_id")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 5)
    try:
        got = [rows(identity.vector_topk_grouped(q, it, "video", 3, 2, digits=6, query_block=b)) for b in (1000, 40)]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = []
    for n in (n for n in range(90) if n % 13):
        best = {}
        for i in range(90):
            if i % 11 and i % 13:
                best.setdefault(i % 7, []).append((-round(float(v[n] @ v[i]), 6), i))
        for rank, (g, found) in enumerate(sorted(best.items(), key=lambda x: (min(x[1])[0], x[0]))[:3]):
            want += [(n, rank + 1, g, k + 1, i, -s) for k, (s, i) in enumerate(sorted(found)[:2])]
    assert got[0] == got[1] and [r[:5] for r in got[0]] == [r[:5] for r in sorted(want)]
    assert identity.vector_topk_grouped(q, it.limit(0), "video", 3, 2).collect() == []


def test_topk_blocks_equal_broadcast(spark):
    v = people(60, 1.0)
    df = spark.createDataFrame([(i, v[i].tolist()) for i in range(60)], "id long, vec array<double>")
    q, it = df.withColumnRenamed("id", "query_id"), df.withColumnRenamed("id", "item_id")
    a = identity.vector_topk(q, it, 5, digits=6)
    b = identity.vector_topk(q, it, 5, digits=6, query_block=7)
    assert rows(a.select("query_id", "item_id", "score", "rank")) == rows(b.select("query_id", "item_id", "score", "rank"))


def test_components(spark):
    nodes = spark.createDataFrame([(i,) for i in range(9)], "node long")
    edges = spark.createDataFrame([(0, 1), (1, 2), (2, 3), (5, 6), (8, 6)], "a long, b long")
    got = dict(rows(identity.connected_components(nodes, edges)))
    assert got == {0: 0, 1: 0, 2: 0, 3: 0, 4: 4, 5: 5, 6: 5, 7: 7, 8: 5}


# -- lanes -----------------------------------------------------------------------------------


def test_replay_follows_candidates_and_pins(spark):
    b = "struct<x1:double,y1:double,x2:double,y2:double>"
    data = []
    for f in range(20):
        x = 100.0 + 3 * f
        pins = [{"x1": 100.0, "y1": 50.0, "x2": 160.0, "y2": 130.0}] if f == 0 else None
        sig = [{"source": "optical", "score": 1.0, "x1": x, "y1": 50.0, "x2": x + 60, "y2": 130.0}] if 0 < f < 10 else None
        data.append(("j", 1, f, pins, sig))
    df = spark.createDataFrame(data, f"job_id string, direction int, f long, anchors array<{b}>, signals array<struct<source:string,score:double,x1:double,y1:double,x2:double,y2:double>>")
    got = {r.f: r for r in lanes.replay_tracks(df, ["job_id"], 640, 480).collect()}
    assert got[0].src == "anchor" and got[5].src == "optical" and got[15].src == "predicted"
    assert 100 < got[9].x1 < 127 and got[15].x1 > got[9].x1
    assert len(got) == 20


def test_smoothing_ignores_batch_cuts(spark):
    rng = np.random.default_rng(0)
    data = [("a", int(i), *(float(v) for v in (x, y, x + 40, y + 50)), "tracker", 0.5) for i, (x, y) in enumerate(rng.random((300, 2)) * 200)]
    df = spark.createDataFrame(data, "k string, f long, x1 double, y1 double, x2 double, y2 double, src string, conf double")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    a = rows(lanes.ema_boxes(df, ["k"], 0.4, 0.3, 1000, 1000))
    v = rows(lanes.velocities(df, ["k"]).select("f", "vcx"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    assert a == rows(lanes.ema_boxes(df, ["k"], 0.4, 0.3, 1000, 1000))
    assert v == rows(lanes.velocities(df, ["k"]).select("f", "vcx"))


def test_long_lanes_are_cut_without_a_trace(spark):
    """One lane of many stretches, and lanes with null keys, against the recurrences row by row."""
    rng = np.random.default_rng(3)
    place = np.cumsum(rng.normal(0, 5, (3000, 2)), axis=0) % 800
    data = [("a" if i < 2900 else None, 3 * i, *(float(v) for v in (x, y, x + 30 + i % 50, y + 40 + i % 70))) for i, (x, y) in enumerate(place)]
    df = spark.createDataFrame(data, "k string, f long, x1 double, y1 double, x2 double, y2 double")
    for down in (False, True):
        want, prior = {}, None
        for r in sorted(data[:2900], key=lambda r: -r[1] if down else r[1]):
            x = np.array([r[2:]])
            prior = x if prior is None else lanes._blend(x, prior, np.array([0.5]), np.array([0.24]), 1920, 1080)
            want[r[1]] = prior[0]
        out = lanes.ema_boxes(df, ["k"], 0.5, 0.24, 1920, 1080, descending=down)
        got = {r.f: [r.x1, r.y1, r.x2, r.y2] for r in out.where("k = 'a'").collect()}
        assert got.keys() == want.keys() and max(np.abs(want[f] - got[f]).max() for f in want) < 1e-9
        assert out.where("k IS NULL").count() == 100
    state = lambda r: np.array([(r[2] + r[4]) / 2, (r[3] + r[5]) / 2, r[4] - r[2], r[5] - r[3]])
    got = {r.f: [r.vcx, r.vcy, r.vw, r.vh] for r in lanes.velocities(df, ["k"]).collect()}
    v = np.zeros(4)
    for i, r in enumerate(data):
        v = np.zeros(4) if i in (0, 2900) else 0.45 * (state(r) - state(data[i - 1])) + 0.55 * v
        assert np.abs(v - got[r[1]]).max() < 1e-9
    plan = lanes.velocities(df, ["k"])._jdf.queryExecution().executedPlan().toString()
    assert "MapInPandas" not in plan and "ArrowEvalPython" not in plan


# -- payloads and scalars --------------------------------------------------------------------

CASES = [
    ('[{"a": 1}, {"a": 2}]', 2),
    ('{"segments": [{"a": 1}]}', 1),
    ('```json\n{"result": {"privacy_risk_segment": [{"a": 1}, {"a": 2}, {"a": 3}]}}\n```', 3),
    ('{"result": "{\\"items\\": [{\\"a\\": 1}]}"}', 1),
    ('{"whatever": [{"a": 1}, {"b": 2}]}', 2),
    ('{"result": {"result": {"chapters": [{"a": 1}]}}}', 1),
    ("no json at all", 0),
    ('{"result": null, "output": {"data": [{"z": 1}]}}', 1),
]


def test_segment_shapes(spark):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "id long, payload string")
    n = {r.id: r.n for r in privacy.explode_segments(df, ["id"]).groupBy("id").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert [n.get(i, 0) for i in range(len(CASES))] == [c[1] for c in CASES]


def test_segment_fields_precedence(spark):
    df = spark.createDataFrame([('[{"fields": {"label": "low", "kind": "pii"}, "response": {"label": "mid"}, "label": "top", "time": {"from": "3.5"}, "end": 9}]',)], "payload string")
    r = privacy.privacy_rows(privacy.explode_segments(df.withColumn("k", F.lit(1)), ["k"]), ["k"]).first()
    assert (r.label, r.category, r.start_sec, r.end_sec, r.severity, r.confidence) == ("top", "text", 3.5, 9.0, "medium", 0.65)
    assert r.reason == "Review top for privacy risk."


def test_lenient_values(spark):
    df = spark.createDataFrame([(" 1.5 ",), ("nan",), ("x",), ("YES",), ("0",), (None,)], "c string")
    got = [tuple(r) for r in df.select(S.lenient_double("c", -1.0), S.lenient_bool("c", None)).collect()]
    assert got == [(1.5, True), (-1.0, True), (-1.0, None), (-1.0, True), (0.0, False), (-1.0, None)] or got[1][0] == -1.0


def test_names_and_lists(spark):
    df = spark.createDataFrame([("redacted_ab12_20240101_120000_720p.mp4", '["a","b","a"]', "x, y,,x")], "n string, j string, c string")
    r = df.select(S.is_valid_export_name("n").alias("ok"), S.ordered_distinct(S.parse_list("j")).alias("j"), S.ordered_distinct(S.parse_list("c", csv=True)).alias("c")).first()
    assert r.ok and r.j == ["a", "b"] and r.c == ["x", "y"]


def test_pages_are_flattened(spark):
    df = spark.createDataFrame([(1, '{"data": [{"a": 1}, {"a": 2}], "page_info": {"next_page_token": "t"}}'), (2, "[1,2,3]"), (3, '{"x": 1}')], "p long, j string")
    v = df.select("p", F.try_parse_json("j").alias("v"))
    assert P.flatten_pages(v, "v", "p").count() == 5
    assert [r[0] for r in v.orderBy("p").select(P.next_page_token(F.col("v"))).collect()] == ["t", None, None]


def test_best_job_prefers_time_then_status(spark):
    df = spark.createDataFrame([("v", "a", 2, "failed"), ("v", "b", 2, "ready"), ("v", "c", 1, "ready")], "video_id string, job_id string, created_at long, status string")
    assert catalog.best_job(df).first().job_id == "b"


def test_checkpoint_keeps_rows(spark):
    assert checkpoint(spark.range(5)).count() == 5


def test_and_needs_the_number_of_sets_and_counts_empty_ones(spark):
    from framesafe.operators import search

    clips = spark.createDataFrame([("a", 1, 0, 5, 1, 9)], "set_id string, video_id long, start long, end long, rank long, item_score long")
    with pytest.raises(ValueError):
        search.combine_hits(clips, "set_id", "and")
    assert search.combine_hits(clips, "set_id", "and", n_sets=2)[0].count() == 0
    assert search.combine_hits(clips, "set_id", "and", n_sets=1)[0].count() == 1


def test_row_hashes_tell_nulls_apart(spark):
    from framesafe.functions.scalars import null_safe_hash

    rows = spark.createDataFrame([(None, "a"), ("a", None), ("a", None)], "x string, y string").select(null_safe_hash("x", "y").alias("h")).collect()
    assert rows[0].h != rows[1].h == rows[2].h


def test_jobs_without_people_are_told_to_refresh(spark):
    from framesafe.operators import review

    faces = spark.createDataFrame([(1, None, True, False, False, 0.5, ["x"])], "job_id long, priority_rank long, should_anonymize boolean, is_official boolean, review_required boolean, description_match_score double, tags array<string>")
    people = spark.createDataFrame([], "job_id long, should_anonymize boolean, is_official boolean, tags array<string>")
    assert [tuple(r) for r in review.needs_refresh(faces, people).collect()] == [(1, True)]


def test_lane_at_time_with_high_rates_per_row(spark):
    from pyspark.sql import functions as F

    from framesafe.operators import asof

    lane = spark.createDataFrame([(1, 89_980, 0.0, 0.0, 9.0, 9.0)], "job_id long, f long, x1 double, y1 double, x2 double, y2 double")
    probe = spark.createDataFrame([(1, 90.03, 1000.0)], "job_id long, t double, fps double")
    assert asof.lane_at_time(probe, lane, ["job_id"], F.col("fps")).count() == 1


def test_mask_plan_thins_detector_objects_only(spark):
    from framesafe.plans import masks

    box = "x1 double, y1 double, x2 double, y2 double"
    b = (10.0, 10.0, 60.0, 60.0)
    lane = spark.createDataFrame([(1, "p", 3, *b)], f"job_id long, person_id string, f long, {box}")
    kinds = [("object", "p", False), ("object", None, True), ("face", "q", False), ("face", "p", False)]
    rows = [(1, f, k, p, *b, t) for f in range(6) for k, p, t in kinds]
    dets = spark.createDataFrame(rows, f"job_id long, f long, kind string, person_id string, {box}, tracked boolean")
    regions = spark.createDataFrame([], f"job_id long, f long, {box}, shape string, effect string")
    plan, _ = masks.mask_plan(lane, dets, regions, lane, None, ["job_id"], 640, 360, every_n=3)
    got = {(r.kind, r.origin): r.n for r in plan.groupBy("kind", "origin").count().withColumnRenamed("count", "n").collect()}
    assert got == {("face", "lane"): 1, ("face", "detection"): 6, ("object", "detection"): 2 + 6}


def test_identities_merge_by_centroids_until_nothing_changes(spark):
    rng = np.random.default_rng(8)
    v = rng.standard_normal((5, 12))[rng.integers(0, 5, 90)] + 1.1 * rng.standard_normal((90, 12))
    unit = lambda x: x / np.linalg.norm(x)
    v = np.array([unit(x) * (1 + i % 3) for i, x in enumerate(v)])

    def components(x, limit):
        label = list(range(len(x)))
        for i in range(len(x)):
            for j in range(i):
                if unit(x[i]) @ unit(x[j]) > limit and label[i] != label[j]:
                    low, high = sorted((label[i], label[j]))
                    label = [low if w == high else w for w in label]
        return label

    want, rounds = components(v, 0.75), 0
    while True:
        names = sorted(set(want))
        merged = components([np.mean([unit(v[i]) for i in range(90) if want[i] == n], axis=0) for n in names], 0.6)
        if merged == list(range(len(names))):
            break
        want, rounds = [names[merged[names.index(w)]] for w in want], rounds + 1
    assert rounds >= 2 and len(set(want)) > 1
    people = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "person_key long, centroid array<double>")
    got = {r.person_key: r.identity for r in identity.resolve_identities(people, threshold=0.75, block=30, centroid_sim=0.6).collect()}
    assert got == dict(enumerate(want))


def test_identities_link_every_pair_above_the_limit(spark):
    import numpy as np
    from framesafe.operators import identity

    rng = np.random.default_rng(3)
    v = rng.standard_normal((150, 16))
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(150, [0.0] * 16), (151, None)]
    people = spark.createDataFrame(rows, "person_key long, centroid array<double>")
    people.createOrReplaceTempView("people_pairs")
    dot = lambda x, y: f"aggregate(zip_with({x}, {y}, (p, q) -> p * q), 0D, (s, p) -> s + p)"
    a, b = "a.centroid", "b.centroid"
    for limit in (0.55, 0.6, 0.7):
        links = spark.sql(f"SELECT a.person_key x, b.person_key y FROM people_pairs a JOIN people_pairs b ON a.person_key < b.person_key AND {dot(a, b)} > {limit} * sqrt({dot(a, a)} * {dot(b, b)})").collect()
        want = list(range(151))
        for x, y in [(r.x, r.y) for r in links]:
            low, high = sorted((want[x], want[y]))
            want = [low if w == high else w for w in want]
        for block in (2048, 40):
            got = {r.person_key: r.identity for r in identity.resolve_identities(people, threshold=limit, block=block, centroid_sim=None).collect()}
            assert got == dict(enumerate(want))
