"""Documents on disk, frames, streams."""

from __future__ import annotations

import base64
import json
import os
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from framesafe import schemas
from framesafe.operators import frames
from framesafe.sources import documents, files, snapshots
from framesafe.streaming import events, live


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def put(path, doc):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(doc if isinstance(doc, str) else json.dumps(doc, indent=1))


def test_manifests(spark, tmp_path):
    person = {"name": "A", "time_ranges": [{"start_sec": 1, "end_sec": 2.5}], "tags": ["x"], "should_anonymize": True}
    put(tmp_path / "j1/job_manifest.json", {"job_id": "j1", "status": "ready", "svc_video_id": "v1", "svc_people": [person], "video_metadata": {"fps": 25.0, "width": 10}})
    put(tmp_path / "j2/job_manifest.json", {"status": "failed", "svc_video_id": None})
    put(tmp_path / "j3/job_manifest.json", "{broken")
    m = documents.read_manifests(spark, str(tmp_path), service="svc")
    assert rows(m.select("job_id", "status")) == [("j1", "ready"), ("j2", "failed")]
    people, ranges, _ = documents.people_of(m)
    assert people.first().name == "A" and rows(ranges.select("start", "end")) == [(1.0, 2.5)]


def test_detections_round_trip(spark, tmp_path):
    face = {"person_id": "person_0", "encoding": [0.5, 0.25], "appearances": [{"frame_idx": 3, "timestamp": 0.12, "bbox": [1, 2, 30, 40]}, {"frame_idx": 4, "timestamp": 0.2, "bbox": [5, 5, 5, 9]}]}
    put(tmp_path / "a/detection_metadata.json", {"version": 1, "unique_faces": [face], "unique_objects": [{"object_id": "object_0", "identification": "car"}]})
    f, a, o = documents.read_detections(spark, str(tmp_path))
    assert rows(a.select("frame_idx", "x1")) == [(3, 1.0), (4, None)] or a.count() == 2
    documents.write_detections(f.withColumn("score", F.lit(float("inf"))), a, o, str(tmp_path / "out"))
    back = spark.read.json(str(tmp_path / "out"))
    assert back.first().version == 1 and back.first().unique_faces[0].person_id == "person_0"


def test_lanes_have_a_version_gate(spark, tmp_path):
    row = {"f": 1, "t": 0.04, "x1": 1, "y1": 1, "x2": 5, "y2": 6, "src": "anchor", "conf": 1}
    put(tmp_path / "new.json", {"build_version": 6, "job_id": "j", "person_id": "p", "lane": [row, {**row, "f": 2, "x2": 0}]})
    put(tmp_path / "old.json", {"build_version": 5, "job_id": "j", "person_id": "q", "lane": [row]})
    put(tmp_path / "empty.json", {"build_version": 6, "job_id": "j", "person_id": "r", "lane": []})
    head, lane = documents.read_lanes(spark, str(tmp_path / "*.json"))
    assert [r.person_id for r in head.collect()] == ["p"]
    assert [r.f for r in documents.lane_boxes(lane).collect()] == [1]


def test_artifacts_and_cache(spark, tmp_path):
    put(tmp_path / "a.json", {"metadata": {"artifact_id": "x", "video_id": "v", "cache_key": "k1", "status": "ready"}, "timeline_events": [{"id": "evt_001"}, {"id": "evt_002"}], "recommended_actions": [{"id": "act_001", "event_ids": ["evt_001"]}]})
    art, ev, ac = documents.read_privacy_artifacts(spark, str(tmp_path / "*.json"))
    assert (art.count(), ev.count(), ac.count()) == (1, 2, 1)
    req = spark.createDataFrame([("r1", "v", "k1", "own", "canon"), ("r2", "v", "k2", "own", "canon"), ("r3", "w", "k3", "own", "canon")], "request_id string, video_id string, cache_key string, own_path string, canonical_path string")
    stored = spark.createDataFrame([("v", "k1", "ready", "z"), ("v", "k0", None, "canon"), ("v", "k9", "failed", "own")], "video_id string, cache_key string, status string, path string")
    assert rows(documents.resolve_cached_artifact(req, stored)) == [("r1", "z", "ready", "hit"), ("r2", "canon", "ready", "video_id_fallback")]


def test_snapshots(spark, tmp_path):
    for p in ("j/faces/person_1.png", "j/faces/notes.txt", "j/objects/object_2_cell_phone.jpg"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_bytes(b"img")
    s = snapshots.read_snapshots(spark, str(tmp_path / "*/*/*"))
    f, o = snapshots.snapshots_to_identities(s)
    assert f.first().description == "Person 1" and (o.first().object_id, o.first().identification) == ("object_2", "Cell Phone")
    face = spark.createDataFrame([("j", "person_1", "Jane Doe", base64.b64encode(b"abc").decode())], "job_id string, person_id string, name string, snap_base64 string")
    obj = spark.createDataFrame([("j", "object_2", "cell phone", "")], "job_id string, object_id string, identification string, snap_base64 string")
    plan = snapshots.snapshot_export_plan(face, obj)
    snapshots.write_snapshots(plan, str(tmp_path / "out"))
    assert (tmp_path / "out/j/faces/Jane_Doe.png").read_bytes() == b"abc"


def test_files_appear_on_commit_only(spark, tmp_path):
    files_ = spark.createDataFrame([(f"a/{i}.bin", bytes([i]) * i) for i in range(20)] + [("none", None), (None, b"x")], "path string, content binary").repartition(4)
    broken = files_.withColumn("content", F.when(F.col("path") == "a/13.bin", F.raise_error(F.lit("lost"))).otherwise(F.col("content")))
    with pytest.raises(Exception, match="lost"):
        files.write_files(broken, str(tmp_path / "out"))
    assert [p for p in (tmp_path / "out").rglob("*") if p.is_file()] == [] if (tmp_path / "out").exists() else True
    for _ in range(2):
        files.write_files(files_, (tmp_path / "out").as_uri())
    assert {str(p.relative_to(tmp_path / "out")): p.read_bytes() for p in (tmp_path / "out").rglob("*") if p.is_file()} == {f"a/{i}.bin": bytes([i]) * i for i in range(20)}
    assert not (tmp_path / "out" / files.PENDING).exists()
    for path in ("../x", "/x", "", "a/../../x", f"{files.PENDING}/x"):
        with pytest.raises(ValueError):
            files.safe_path(path)


def test_artifacts_are_written_to_both_paths(spark, tmp_path):
    root = str(tmp_path / "store")
    df = spark.createDataFrame(
        [("k1", "v1", "j1", "ready", "2", "{\"n\": 1}"), ("k2", "v2", None, "failed", "1", "{\"n\": 2}"), ("k1", "v1", "j1", "queued", "1", "{\"n\": 0}")],
        "cache_key string, video_id string, local_job_id string, status string, updated_at string, document string",
    )
    placed = documents.artifact_paths(df, root, "p", f"{root}/runs", "assist.json")
    broken = placed.withColumn("document", F.when(F.col("video_id") == "v2", F.raise_error(F.lit("lost"))).otherwise(F.col("document")))
    with pytest.raises(Exception, match="lost"):
        documents.write_privacy_artifacts(broken, root)
    assert [p for p in tmp_path.rglob("*") if p.is_file()] == []
    documents.write_privacy_artifacts(placed, root)
    for r in placed.where("updated_at <> '1' OR video_id = 'v2'").collect():
        for path in (r.path, r.canonical_path):
            assert json.loads(open(path).read()) == json.loads(r.document)
        assert json.loads(open(r.record_path).read()) == {"job_id": r.artifact_id, "status": r.status, "artifact_path": r.path, "cached": False, "updated_at": r.updated_at}
    assert len([p for p in tmp_path.rglob("*") if p.is_file()]) == 5


def test_frames_are_masked_and_audited(spark):
    rng = np.random.default_rng(0)
    img = rng.integers(0, 255, (120, 160, 3), dtype=np.uint8)
    src = spark.createDataFrame([("j", 0, 120, 160, 3, bytearray(img.tobytes()))], "job_id string, f long, h int, w int, c int, data binary")
    plan = spark.createDataFrame([("j", 0, 10.0, 10.0, 60.0, 40.0, "black", 220, "rect"), ("j", 0, 80.0, 5.0, 140.0, 45.0, "blur", 220, "face")], "job_id string, f long, x1 double, y1 double, x2 double, y2 double, effect string, strength int, shape string")
    keep = spark.createDataFrame([("j", 0, 10.0, 10.0, 20.0, 20.0)], "job_id string, f long, x1 double, y1 double, x2 double, y2 double")
    out = frames.apply_plan(src, plan, keep, ["job_id"])
    got = np.frombuffer(out.first().data, dtype=np.uint8).reshape(120, 160, 3)
    assert (got[25:40, 25:60] == 0).all() and (got[10:20, 10:20] == img[10:20, 10:20]).all() and (got[60:] == img[60:]).all()
    boxes = spark.createDataFrame([("j", 0, 1, False, 25.0, 21.0, 60.0, 40.0), ("j", 0, 2, True, 10.0, 10.0, 20.0, 20.0)], "job_id string, f long, id int, focus boolean, x1 double, y1 double, x2 double, y2 double")
    assert all(r.passed for r in frames.audit(src, out, boxes, ["job_id"]).collect())
    st = frames.frame_stats(src, ["job_id"]).first()
    assert 100 < st.mean_luma < 150 and st.std_luma > 10 and st.sharpness > 0
    assert frames.crops(src, boxes, ["job_id"], "face").count() == 2


def test_thumbnail_choice(spark):
    st = spark.createDataFrame([("v", 0, 10.0, 20.0), ("v", 1, 30.0, 12.0), ("v", 2, 90.0, 40.0), ("w", 0, 5.0, 1.0), ("w", 1, 20.0, 2.0)], "v string, pos int, mean_luma double, std_luma double")
    assert rows(frames.choose_thumbnail(st, ["v"])) == [("v", 1, True), ("w", 1, False)]


# -- streams ---------------------------------------------------------------------------------

LIVE = "job_id string, time_sec double, det_id long, kind string, label string, person_id string, object_class string, confidence double, x double, y double, width double, height double"


def live_data():
    out, n = [], 0
    for job in ("a", "b"):
        for i in range(12):
            t = i * 0.2 + (2.0 if i > 8 else 0.0)
            for p in range(3):
                if (i + p) % 5:
                    out.append((job, t, n, "face", "Face", f"p{p}" if i % 2 else None, None, 0.8, 0.1 + p * 0.3 + i * 0.004, 0.2, 0.1, 0.15))
                    n += 1
    return out


def run(spark, stream, name, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def stream_of(spark, data, schema, path, parts):
    for i in range(parts):
        spark.createDataFrame(data[i::parts] if parts == 1 else data[i * len(data) // parts : (i + 1) * len(data) // parts], schema).coalesce(1).write.mode("append").parquet(str(path))
    return spark.readStream.schema(spark.createDataFrame(data, schema).schema).parquet(str(path))


FAR = ("far", 1e6, 0, "face", "Face", None, None, 0.8, 0.1, 0.1, 0.1, 0.1)  # moves the watermark past all else


def cut_stream(spark, batches, schema, path):
    """A stream whose micro-batches are the given lists of rows, one file each."""
    for i, rows_ in enumerate(batches):
        spark.createDataFrame(rows_, schema).coalesce(1).write.parquet(str(path / f"{i:03d}"))
        for part in (path / f"{i:03d}").glob("part-*"):
            os.utime(part, (1_700_000_000 + i, 1_700_000_000 + i))
    kind = spark.createDataFrame(batches[0], schema).schema
    return spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(path))


def cuts_of(data, how):
    """The rows in order of time, cut so that single times fall apart, or shuffled by up to a second."""
    data = sorted(data, key=lambda r: (r[1], r[0], r[2]))
    if how == "whole":
        return [data, [FAR]]
    if how == "shuffled":
        rng = random.Random(5)
        data = sorted(data, key=lambda r: r[1] + rng.random())
    step = {"five": -(-len(data) // 5), "seven": 7, "shuffled": 11}[how]
    return [data[i : i + step] for i in range(0, len(data), step)] + [[FAR]]


@pytest.mark.parametrize("how", ["whole", "five", "seven", "shuffled"])
def test_track_stream_equals_replay_however_batches_cut(spark, tmp_path, how):
    data = live_data()
    want = live.replay_live_tracks(spark.createDataFrame(data, LIVE))
    got = run(spark, live.live_tracks(cut_stream(spark, cuts_of(data, how), LIVE, tmp_path / "in")), f"tracks_{how}")
    cols = ["job_id", "time_sec", "det_id", "track_id", "confidence", "x", "late"]
    assert rows(got.select(*cols)) == rows(want.select(*cols))
    assert want.where("late").count() == 0 and want.select("track_id").distinct().count() >= 6


def test_display_stream_equals_replay(spark, tmp_path):
    data = live_data()
    want = live.replay_stabilize(spark.createDataFrame(data, LIVE))
    got = run(spark, live.stabilize(cut_stream(spark, cuts_of(data, "seven"), LIVE, tmp_path / "in")), "shown")
    cols = ["job_id", "time_sec", "id", "x", "held"]
    assert rows(got.select(*cols)) == rows(want.select(*cols))


@pytest.mark.parametrize("how", ["five", "shuffled"])
def test_tracking_and_display_in_one_query(spark, tmp_path, how):
    data = live_data()
    want = live.replay_stabilize(live.replay_live_tracks(spark.createDataFrame(data, LIVE)))
    got = run(spark, live.live_display(cut_stream(spark, cuts_of(data, how), LIVE, tmp_path / "in")), f"chain_{how}")
    cols = ["job_id", "time_sec", "id", "track_id", "x", "width", "held"]
    assert rows(got.select(*cols)) == rows(want.select(*cols)) and got.count() > 60


def test_late_rows_go_to_the_side(spark, tmp_path):
    data = sorted(live_data(), key=lambda r: (r[1], r[0], r[2]))
    late = [r for r in data if r[0] == "a" and r[1] < 0.5]
    on_time = [r for r in data if r not in late]
    batches = [on_time, [("far", 50.0, *FAR[2:])], late, [FAR]]
    fine, side = live.split_late(run(spark, live.live_tracks(cut_stream(spark, batches, LIVE, tmp_path / "in")), "with_late"))
    want = live.replay_live_tracks(spark.createDataFrame([*on_time, ("far", 50.0, *FAR[2:])], LIVE))
    cols = ["job_id", "time_sec", "track_id", "x"]
    assert rows(fine.select(*cols)) == rows(want.select(*cols))
    assert sorted((r.job_id, r.det_id, r.track_id) for r in side.collect()) == sorted((r[0], r[2], None) for r in late)


def test_replay_spreads_one_job_over_tasks(spark):
    data = [("j", k * 100 + i * 0.2, k * 10 + i, "face", "Face", None, None, 0.8, 0.1 + i * 0.01, 0.2, 0.1, 0.1) for k in range(40) for i in range(4)]
    runs = live._runs(live._prepared(spark.createDataFrame(data, LIVE)), live.MAX_GAP)
    assert runs.select("__run").distinct().count() == 40
    got = live.replay_live_tracks(spark.createDataFrame(data, LIVE))
    assert sorted(int(r.track_id.split(":")[1]) for r in got.where("det_id % 10 = 0").collect()) == list(range(40))


def test_track_rules():
    base = {"kind": "face", "label": "Face", "person_id": "", "object_class": "", "confidence": 0.5, "x": 0.1, "y": 0.1, "width": 0.1, "height": 0.1}
    out, st = live.track_step("j", {}, 1.0, [base])
    assert out[0]["track_id"] == "j:0"
    out, st = live.track_step("j", st, 1.2, [])
    assert out[0]["confidence"] == pytest.approx(0.47)
    late, same = live.track_step("j", st, 1.1, [base])
    assert late[0]["late"] and same is st
    out, _ = live.track_step("j", st, 3.0, [base])
    assert [r["track_id"] for r in out] == ["j:1"]


def test_progress_stream_keeps_changes(spark, tmp_path):
    schema = "redaction_job_id string, ts timestamp, stage string, percent int, message string"
    from datetime import datetime, timedelta

    t0 = datetime(2024, 1, 1)
    data = [("r", t0 + timedelta(seconds=i), "render", i // 3, "m") for i in range(9)]
    got = run(spark, events.progress_stream(stream_of(spark, data, schema, tmp_path / "in", 1)), "progress", "update")
    assert sorted(r.percent for r in got.collect()) == [0, 1, 2]


def test_sessions_stream(spark, tmp_path):
    from datetime import datetime, timedelta

    t0 = datetime(2024, 1, 1)
    data = [("p", t0 + timedelta(seconds=s)) for s in (0, 4, 8, 20, 21, 300)]
    got = run(spark, events.appearance_sessions(stream_of(spark, data, "person string, ts timestamp", tmp_path / "in", 1), ["person"]), "sessions")
    assert sorted(r.appearances for r in got.collect())[-2:] == [2, 3]


SAMPLE = "job_id string, sample_ts timestamp, seq long, kind string, label string, person_id string, object_class string, confidence double, x double, y double, width double, height double"


def bursts(t0):
    """Requests beside the edges of seconds, and five samples about each."""
    ms = lambda n: t0 + timedelta(milliseconds=n)
    asked = [("a", f"r{i}", ms(t)) for i, t in enumerate((1000, 1990, 2950, 4040, 4100))] + [("b", "s0", ms(1000)), ("b", "empty", ms(9000))]
    taken = []
    for job, _, ts in [r for r in asked if r[1] != "empty"]:
        for k, off in enumerate((-120, -60, 0, 60, 120)):
            taken.append((job, ts + timedelta(milliseconds=off), len(taken), "face", "Face", None, None, 0.5 + k / 10, 0.1 + k / 100, 0.2, 0.1, 0.1))
        taken.append((job, ts + timedelta(microseconds=120_001), len(taken), "object", "Car", None, "car", 0.5, 0.7, 0.2, 0.1, 0.1))
    return asked, taken


def expected_pairs(asked, taken):
    return sorted((j, r, s[2]) for j, r, ts in asked for s in taken if s[0] == j and abs(s[1] - ts) <= timedelta(milliseconds=120))


def test_bursts_meet_their_requests_across_seconds(spark):
    asked, taken = bursts(datetime(2024, 1, 1))
    req, smp = spark.createDataFrame(asked, "job_id string, request_id string, ts timestamp"), spark.createDataFrame(taken, SAMPLE)
    pairs = events.burst_pairs(req, smp, ["job_id"])
    assert sorted((r.job_id, r.request_id, r.seq) for r in pairs.collect()) == expected_pairs(asked, taken)
    merged = events.sample_bursts(req, smp, ["job_id"]).collect()
    assert {r.request_id for r in merged} == {"r0", "r1", "r2", "r3", "r4", "s0"}
    one = next(r for r in merged if r.request_id == "s0" and r.kind == "face")
    weights = [(0.5 + k / 10) / (1 + abs(o) * 12) for k, o in enumerate((-0.12, -0.06, 0, 0.06, 0.12))]
    assert one.members == 5 and one.x == pytest.approx(sum(w * (0.1 + k / 100) for k, w in enumerate(weights)) / sum(weights), abs=1e-6)


def test_burst_stream_with_late_samples(spark, tmp_path):
    asked, taken = bursts(datetime(2024, 1, 1))
    end = datetime(2024, 1, 1, 1)
    late = [s for s in taken if s[0] == "b"][:2]
    early = [s for s in taken if s not in late and s[1] < datetime(2024, 1, 1, 0, 0, 3)]
    rest = [s for s in taken if s not in late and s not in early]
    far = ("far", end, 99, *taken[0][3:])
    requests = cut_stream(spark, [asked[:3] + asked[5:6], asked[3:5], [("far", "x", end)], [("far", "y", end + timedelta(hours=1))], [("far", "z", end + timedelta(hours=2))]], "job_id string, request_id string, ts timestamp", tmp_path / "req")
    samples = cut_stream(spark, [rest[:4], early + rest[4:], [far], [*late, ("far", end + timedelta(hours=1), 98, *taken[0][3:])], [("far", end + timedelta(hours=2), 97, *taken[0][3:])]], SAMPLE, tmp_path / "smp")
    got = run(spark, events.sample_bursts(requests, samples, ["job_id"]), "bursts").where("job_id <> 'far'")
    want = events.sample_bursts(spark.createDataFrame(asked, "job_id string, request_id string, ts timestamp"), spark.createDataFrame([s for s in taken if s not in late], SAMPLE), ["job_id"])
    cols = ["job_id", "request_id", "id", "members", "x", "confidence"]
    assert rows(got.select(*cols)) == rows(want.select(*cols)) and got.count() > 5


def artifact(i, status, at, task=None, job="j", text="x"):
    return {"metadata": {"artifact_id": i, "job_id": job, "status": status, "updated_at": at, "service_task_id": task}, "summary": {"overall_summary": text}}


def tree(path):
    return {str(p.relative_to(path).parent): len(p.read_bytes()) for p in sorted(path.rglob("part-*.parquet"))}


def test_artifact_batches_are_upserts(spark, tmp_path):
    schema, sink = schemas.privacy_artifact(), str(tmp_path / "sink")
    read = lambda docs: spark.read.schema(schema).json(spark.sparkContext.parallelize(map(json.dumps, docs)))
    first = [artifact("a", "Pending", "2024-01-01"), artifact("b", "completed", "2024-01-02"), artifact("a", "ready", "2024-01-03", text="new"), artifact(None, "queued", "2024-01-01", job="only")]
    for _ in range(2):
        events.upsert_artifacts(events.folded_artifacts(read(first)), 0, sink)
    events.upsert_artifacts(events.folded_artifacts(read([artifact("b", "processing", "2024-01-01"), artifact("c", "failed", "2024-01-01")])), 1, sink)
    before = tree(tmp_path / "sink")
    for n in (0, 1):  # batches run again
        docs = first if n == 0 else [artifact("b", "processing", "2024-01-01"), artifact("c", "failed", "2024-01-01")]
        events.upsert_artifacts(events.folded_artifacts(read(docs)), n, sink)
    assert tree(tmp_path / "sink") == before
    got = {r.artifact_id: (r.metadata.status, r.batch_id, r.summary.overall_summary) for r in events.current_artifacts(spark, sink).collect()}
    assert got == {"a": ("ready", 0, "new"), "b": ("ready", 0, "x"), "c": ("failed", 1, "x"), "job:only": ("queued", 0, "x")}


def test_stuck_artifacts_turn_ready_or_failed(spark, tmp_path):
    schema, sink = schemas.privacy_artifact(), str(tmp_path / "sink")
    docs = [artifact("t1", "processing", "1", "task1"), artifact("t2", "running", "1", "task2"), artifact("t3", "processing", "1", "task3"), artifact("f", "processing", "1", job="with"), artifact("n", "processing", "1", job="without"), artifact("q", "queued", "1")]
    read = spark.read.schema(schema).json(spark.sparkContext.parallelize(map(json.dumps, docs)))
    events.upsert_artifacts(events.folded_artifacts(read), 0, sink)
    tasks = spark.createDataFrame([("task1", "completed", None), ("task2", "error", "no audio"), ("task3", "indexing", None)], "task_id string, status string, error string")
    faces = spark.createDataFrame([("with",), ("with",), ("other",)], "job_id string")
    assert events.repair_artifacts(spark, sink, tasks, faces) == 4
    got = {r.artifact_id: (r.metadata.status, r.error) for r in events.current_artifacts(spark, sink).collect()}
    assert got == {"t1": ("ready", None), "t2": ("failed", "no audio"), "t3": ("processing", None), "f": ("ready", None), "n": ("failed", None), "q": ("queued", None)}
    assert events.repair_artifacts(spark, sink, tasks, faces) == 0
    events.upsert_artifacts(events.folded_artifacts(spark.read.schema(schema).json(spark.sparkContext.parallelize([json.dumps(artifact("n", "ready", "2"))]))), 1, sink)
    assert [r.metadata.status for r in events.current_artifacts(spark, sink).where("artifact_id = 'n'").collect()] == ["ready"]


def test_artifact_ingest_is_repeatable(spark, tmp_path):
    put(tmp_path / "in/a.json", {"metadata": {"artifact_id": "x", "status": "queued"}})
    schema = schemas.privacy_artifact()
    for _ in range(2):
        events.ingest_artifacts(spark, str(tmp_path / "in"), schema, str(tmp_path / "sink"), str(tmp_path / "cp")).awaitTermination(120)
    put(tmp_path / "in/b.json", {"metadata": {"artifact_id": "x", "status": "ready"}})
    events.ingest_artifacts(spark, str(tmp_path / "in"), schema, str(tmp_path / "sink"), str(tmp_path / "cp")).awaitTermination(120)
    cur = events.current_artifacts(spark, str(tmp_path / "sink"))
    assert [r.metadata.status for r in cur.collect()] == ["ready"]


def mixed_rows(n_jobs=6, n=120, seed=3):
    """Rows with equal times, missing values, gaps and doubtful matches, as ``live.IN_COLUMNS`` after the job."""
    rng = random.Random(seed)
    out = []
    for k in range(n_jobs):
        t = 0.0
        for i in range(n):
            t += rng.choice([0.0, 0.0, 0.1, 0.2, 0.4, 0.9, 2.0])
            kind = rng.choice(["face", "face", "object", None])
            box = [rng.choice([0.1, 0.4, 0.7, 0.9]) + rng.random() * 0.05 for _ in range(2)] + [rng.choice([0.05, 0.1, 0.3]) for _ in range(2)]
            box[rng.randrange(4)] = None if rng.random() < 0.05 else 0.2
            out.append((f"j{k}", round(t, 3), i, kind, rng.choice(["Face", "car", None]), rng.choice(["p1", "p2", None]), rng.choice(["c", None]), rng.choice([0.75, 0.7525, 0.3, None]), *box, rng.choice([None, 0.02, 0.3]), rng.choice(["global", None])))
    return out


MIXED = LIVE + ", motion_strength double, tracking_mode string"


def stepped(data, step, names):
    """The rows of the plain steps, one job and one time after another."""
    out = []
    for job in sorted({r[0] for r in data}):
        state, mine = {}, [live._clean(dict(zip(names, r))) for r in data if r[0] == job]
        for t in sorted({r["time_sec"] for r in mine}):
            got, state = step(job, state, t, sorted((r for r in mine if r["time_sec"] == t), key=lambda r: (r["det_id"], r.get("track_id") or "")))
            out += got
    return out


def test_replay_equals_plain_steps(spark, monkeypatch):
    monkeypatch.setattr(live.lockstep, "BUCKET", 2.5)
    names = [c.split()[0] for c in MIXED.split(", ")]
    df = spark.createDataFrame(mixed_rows(), MIXED)
    as_rows = lambda rs, schema: sorted((tuple(r[c] for c in live._names(schema) if c != "event_time") for r in rs), key=repr)
    want = stepped(mixed_rows(), live._track_rows, names)
    tracks = live.replay_live_tracks(df)
    assert as_rows(tracks.collect(), live.TRACK_SCHEMA) == as_rows(want, live.TRACK_SCHEMA) and len(want) > 1000
    shown = stepped([tuple(r.get(c) for c in ("job_id", *live.IN_COLUMNS, "track_id")) for r in want], live._stable_rows, ["job_id", *live.IN_COLUMNS, "track_id"])
    for got in (live.replay_stabilize(tracks), live.replay_stabilize(live.replay_live_tracks(df, display_runs=True))):
        assert as_rows(got.collect(), live.STABLE_SCHEMA) == as_rows([{"track_id": None, **r} for r in shown], live.STABLE_SCHEMA)
    plain = stepped(mixed_rows(), live._stable_rows, names)
    assert as_rows(live.replay_stabilize(df).collect(), live.STABLE_SCHEMA) == as_rows([{"track_id": None, **r} for r in plain], live.STABLE_SCHEMA)


@pytest.mark.parametrize("rule, put", [("Tracking", "put_tracks"), ("Display", "put_display")])
def test_replay_steps_many_runs_at_once(monkeypatch, rule, put):
    """The number of steps follows the longest run of a buffer, not the rows; small buffers give the same rows."""
    import pyarrow as pa

    from framesafe.streaming import lockstep

    names, n_runs, n_times = live._names(live.ROW), 60, 40
    kinds = {"double": pa.float64(), "long": pa.int64(), "string": pa.string()}
    schema = pa.schema([("job_id", pa.string()), ("__run", pa.int64()), ("__bucket", pa.int64()), ("__before", pa.int64()), *((c.split()[0], kinds[c.split()[1]]) for c in live.ROW.split(", "))])
    row = lambda k, i: {"job_id": f"j{k}", "__run": k, "__bucket": int(i * 0.2 / lockstep.BUCKET), "__before": 0, "time_sec": i * 0.2, "det_id": i, "kind": "face", "label": "Face", "confidence": 0.8, "x": 0.1 + i % 3 * 0.2, "y": 0.2, "width": 0.1, "height": 0.1}
    data = sorted((row(k, i) for k in range(n_runs) for i in range(n_times)), key=lambda r: (r["__bucket"], r["job_id"], r["time_sec"]))
    table = pa.Table.from_pylist([{c: None for c in names} | r for r in data], schema)
    kind, calls = getattr(lockstep, rule), []
    step = kind.step
    monkeypatch.setattr(kind, "step", lambda *a: calls.append(1) or step(*a))
    columns = [*names, *(["id"] if rule == "Display" else [])]
    fold = lambda: sorted((r for b in lockstep.fold(iter(table.to_batches(max_chunksize=100)), kind, columns, getattr(lockstep, put)) for r in b.to_pylist()), key=repr)
    once = fold()
    assert len(calls) == n_times and len(once) >= n_runs * n_times
    monkeypatch.setattr(lockstep, "ROWS", 70)
    assert fold() == once
