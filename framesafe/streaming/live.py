"""Live detections as keyed state on event time: tracking per job, and display smoothing behind it.

The step functions are pure: state and the detections of one time in, rows and state out; all tracks are scored
against all detections of a time at once, as matrices.

A stream holds the rows of a time in a typed buffer until the watermark has passed it, and then steps once for the
whole time, in order of time, by an event-time timer. How micro-batches cut a time, and in which order rows arrive
within the delay, so has no influence. A row that comes after its time was stepped is late: tracking puts it out
flagged, display drops it. ``live_display`` chains both in one query; the first operator hands its event-time column
and watermark to the second. State that has run out (tracks after ``MAX_GAP``, boxes after their hold) is dropped by
timers, and what numbers a job's tracks after ``forget`` seconds without rows.

The batch replays cut a job at gaps after which no state is left, and step with one state per run, many runs at once
(``lockstep``); the numbers of tracks are made up from the counts per run. So a job is spread over tasks, and a stream
can be checked against its replay.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from ..operators import scans
from ..session import checkpoint, spread
from . import lockstep
from .rules import (
    DECAY, DOUBTFUL_OVERLAP, HOLD, HOLD_IDENTIFIED, KEEP_CONFIDENCE, LAG, LEAD, LEAST_OVERLAP, MAX_GAP, MOST_GROWTH, MOTION_CAP, PAD, SHIFT,
    SHOW_BONUS_KEYED, SHOW_REACH, SHOW_REACH_KEYED, SHOW_WEIGHTS, SIZE, SLOWING, SMOOTH, TOP_SIZE_SPEED, TOP_SPEED, TRACK_BONUS, TRACK_REACH,
    TRACK_WEIGHTS, UNSEEN, VELOCITY, VELOCITY_BLEND,
)

KINDS = ("face", "object")  # column order of the tables below

IN_COLUMNS = ["time_sec", "det_id", "kind", "label", "person_id", "object_class", "confidence", *SIZE, "motion_strength", "tracking_mode"]
TRACK_SCHEMA = "job_id string, event_time timestamp, time_sec double, det_id long, track_id string, kind string, label string, person_id string, object_class string, confidence double, x double, y double, width double, height double, late boolean"
STABLE_SCHEMA = "job_id string, event_time timestamp, time_sec double, id string, track_id string, kind string, label string, person_id string, confidence double, x double, y double, width double, height double, held boolean"


# -- pairs of boxes --------------------------------------------------------------------------


def _numbers(rows: list[dict], names: tuple[str, ...] = SIZE) -> np.ndarray:
    return np.array([[r.get(n) or 0.0 for n in names] for r in rows], float).reshape(len(rows), len(names))


def _texts(rows: list[dict], name: str) -> np.ndarray:
    return np.array([r.get(name) or "" for r in rows], object)


def _kind(rows: list[dict]) -> np.ndarray:
    """0 for faces, 1 for all else."""
    return np.array([r["kind"] != "face" for r in rows], int)


def _same(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a[:, None] == b[None, :]).astype(bool)


def _geometry(a: np.ndarray, b: np.ndarray) -> dict[str, np.ndarray]:
    """Overlap, distance of centres, ratio of areas and change of size of every box of ``a`` with every box of ``b``."""
    corner, other = a[:, None, :2], b[None, :, :2]
    size, size_b = a[:, None, 2:], b[None, :, 2:]
    shared = np.maximum(0.0, np.minimum(corner + size, other + size_b) - np.maximum(corner, other)).prod(2)
    area, area_b = size.prod(2), size_b.prod(2)
    union = area + area_b - shared
    floor, floor_b = np.maximum(1e-6, area), np.maximum(1e-6, area_b)
    return {
        "iou": np.divide(shared, union, out=np.zeros_like(shared), where=union > 0),
        "distance": np.linalg.norm(corner - other + (size - size_b) / 2, axis=2),
        "growth": np.maximum(floor, floor_b) / np.minimum(floor, floor_b) - 1.0,
        "change": (np.abs(size_b - size) / np.maximum(size, 1e-3)).max(2),
    }


def _weighted(parts: dict[str, np.ndarray], weights: dict[str, float]) -> np.ndarray:
    return sum(w * parts[name] for name, w in weights.items())


def _assign(score: np.ndarray, possible: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the matches: the best pair that is left, first in row order among equals."""
    left = np.where(possible, score, -np.inf)
    pairs = []
    for _ in range(min(left.shape)):
        i, j = divmod(int(left.argmax()), left.shape[1])
        if left[i, j] == -np.inf:
            break
        pairs.append((i, j))
        left[i], left[:, j] = -np.inf, -np.inf
    rows, columns = np.array(pairs, int).reshape(-1, 2).T
    return rows, columns


# -- tracking --------------------------------------------------------------------------------


def _motion(tracks: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    strength = np.maximum(0.0, _numbers(tracks, ("motion_strength",))[:, 0])
    return strength, _texts(tracks, "tracking_mode") == "global"


def track_scores(tracks: list[dict], dets: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    """How well each detection continues each track, and where it can at all."""
    pair = _geometry(_numbers(tracks), _numbers(dets))
    kind, person, person_d = _kind(tracks), _texts(tracks, "person_id"), _texts(dets, "person_id")
    strength, moving = _motion(tracks)
    named = (person != "")[:, None] & (person_d != "")[None, :]
    face = (kind == 0)[:, None]
    alike = _same(_texts(tracks, "kind"), _texts(dets, "kind")) & np.where(face, ~named | _same(person, person_d), _same(_texts(tracks, "label"), _texts(dets, "label")))
    reach = np.array(TRACK_REACH)[kind] + np.minimum(0.24, strength * 3.0) + 0.05 * moving
    near = (pair["iou"] >= LEAST_OVERLAP) | (pair["distance"] <= reach[:, None])
    steady = (pair["growth"] <= MOST_GROWTH - 1.0) | (pair["iou"] >= DOUBTFUL_OVERLAP)
    classed = (_texts(tracks, "object_class") != "")[:, None] & (_texts(dets, "object_class") != "")[None, :]
    is_object = (_texts(tracks, "kind") == "object")[:, None]
    bonus = np.where(face & named, TRACK_BONUS[0], np.where(is_object & classed, TRACK_BONUS[1], 0.0))
    pair["motion"] = np.broadcast_to(np.minimum(MOTION_CAP, TRACK_WEIGHTS["motion"] * strength)[:, None], bonus.shape)
    return bonus + _weighted(pair, TRACK_WEIGHTS | {"motion": 1.0}), alike & near & steady


def _blended(tracks: list[dict], dets: list[dict]) -> list[dict]:
    """Each track moved towards its detection."""
    strength, moving = _motion(tracks)
    share = np.minimum(0.86, 0.62 + np.minimum(0.18, 1.6 * strength) + 0.08 * moving)
    known = (_texts(tracks, "person_id") != "") | (_texts(dets, "person_id") != "")
    share = np.where(_kind(dets) == 0, np.maximum(share, np.where(known, 0.88, 0.78)), share)[:, None]
    boxes = np.round(_numbers(tracks) * (1 - share) + _numbers(dets) * share, 6).tolist()
    return [d | dict(zip(SIZE, b)) | {"confidence": round(max(t["confidence"], d["confidence"]), 4), "track_id": t["track_id"]} for t, d, b in zip(tracks, dets, boxes)]


def track_step(job: str, state: dict, time_sec: float, dets: list[dict], reset: bool = False) -> tuple[list[dict], dict]:
    """Detections of one time against the tracks of a job.

    Times that do not advance are late: their rows come out flagged and leave the state alone. A jump of
    more than .85 s, or a reset, starts with no tracks. Unseen tracks fade and end after ``UNSEEN`` seconds.
    """
    last = state.get("time")
    if last is not None and not reset and time_sec <= last:
        return [{**d, "track_id": None, "late": True} for d in dets], state
    fresh_start = last is None or reset or time_sec - last > MAX_GAP
    alive = [] if fresh_start else [t for t in state["tracks"] if time_sec - t.get("seen", last) <= UNSEEN]
    tracks = [{**t, "confidence": round(max(KEEP_CONFIDENCE, t["confidence"] * DECAY), 4)} for t in alive]
    rows, columns = _assign(*track_scores(tracks, dets)) if tracks and dets else (np.zeros(0, int), np.zeros(0, int))
    n = state.get("next", 0)
    found = _blended([tracks[i] for i in rows], [dets[j] for j in columns]) if len(rows) else []
    new = [{**dets[j], "track_id": f"{job}:{n + k}"} for k, j in enumerate(sorted(set(range(len(dets))) - set(columns.tolist())))]
    seen = [{**r, "seen": time_sec} for r in found + new]
    out = seen + [t for i, t in enumerate(tracks) if i not in set(rows.tolist())]
    return [{**r, "late": False} for r in out], {"time": time_sec, "tracks": out, "next": n + len(new)}


# -- display smoothing -----------------------------------------------------------------------


def _keys(rows: list[dict]) -> np.ndarray:
    """What identifies a displayed box over time, or an empty text."""
    track, person = _texts(rows, "track_id"), _texts(rows, "person_id")
    return np.array([f"track:{t}" if t else f"face:{p}" if k == 0 and p else "" for t, p, k in zip(track, person, _kind(rows))], object)


def _padded(dets: list[dict]) -> np.ndarray:
    boxes = _numbers(dets)
    size = np.clip(boxes[:, 2:] * (1 + 2 * np.array(PAD)[_kind(dets)])[:, None], 0, 1)
    return np.hstack([np.clip(boxes[:, :2] + boxes[:, 2:] / 2 - size / 2, 0, 1), size])


def _ahead(shown: list[dict], now: float) -> np.ndarray:
    """The boxes moved on by their velocities, a bounded time ahead or back."""
    boxes, speed, kind = _numbers(shown), _numbers(shown, VELOCITY), _kind(shown)
    step = np.clip(now - _numbers(shown, ("time",))[:, 0], -np.array(LAG)[kind], np.array(LEAD)[kind])[:, None]
    size = np.clip(boxes[:, 2:] + speed[:, 2:] * step, 0, 1)
    moved = np.hstack([np.clip(np.minimum(1 - size, boxes[:, :2] + speed[:, :2] * step), 0, 1), size])
    return np.where(np.abs(step) < 1e-4, boxes, moved)


def display_scores(shown: list[dict], ahead: np.ndarray, dets: list[dict], boxes: np.ndarray) -> tuple[np.ndarray, np.ndarray, dict]:
    """How well each detection continues each displayed box, where it can at all, and the geometry of the pairs."""
    pair = _geometry(ahead, boxes)
    key, key_d, kind = _keys(shown), _keys(dets), _kind(shown)
    keyed, both = (key != "")[:, None], (key != "")[:, None] & (key_d != "")[None, :]
    equal = both & _same(key, key_d)
    renamed = ~_same(_texts(shown, "label"), _texts(dets, "label"))
    unnamed = (_texts(shown, "label") == "Face")[:, None] | (_texts(dets, "label") == "Face")[None, :]
    is_object, face = (_texts(shown, "kind") == "object")[:, None], (kind == 0)[:, None]
    other_name = renamed & (is_object | (face & ~keyed & ~unnamed))
    alike = _same(_texts(shown, "kind"), _texts(dets, "kind")) & (~both | equal) & ~other_name
    speed = np.linalg.norm(_numbers(shown, ("vx", "vy")), axis=1)
    reach = np.where(key != "", SHOW_REACH_KEYED, np.array(SHOW_REACH)[kind]) + np.minimum(np.where(key != "", 0.14, 0.08), 0.09 * speed)
    near = (pair["iou"] >= LEAST_OVERLAP) | (pair["distance"] <= reach[:, None])
    steady = (pair["change"] <= 1.15) | (pair["distance"] <= 0.09) | (pair["iou"] >= DOUBTFUL_OVERLAP)
    pair["confidence"] = np.broadcast_to(np.clip(_numbers(dets, ("confidence",))[:, 0], 0, 1), near.shape)
    return SHOW_BONUS_KEYED * equal + _weighted(pair, SHOW_WEIGHTS), alike & near & steady, pair


def _eased(shown: list[dict], ahead: np.ndarray, dets: list[dict], boxes: np.ndarray, distance: np.ndarray, change: np.ndarray, now: float) -> list[dict]:
    """Displayed boxes eased towards their detections: little for small shifts, nearly all the way for large ones."""
    still, moving, small, large, small_change, large_change = SHIFT[((_kind(shown) == 0) & (_keys(shown) != "") == 0).astype(int)].T
    share = np.where((distance >= large) | (change >= large_change), moving, SMOOTH)
    share = np.where((distance <= small) & (change <= small_change), still, share)[:, None]
    new = ahead * (1 - share) + boxes * share
    span = np.maximum(1 / 120, np.abs(now - _numbers(shown, ("time",))))
    top = np.array(TOP_SPEED)[_kind(dets)]
    limit = np.stack([top, top, np.full(len(top), TOP_SIZE_SPEED), np.full(len(top), TOP_SIZE_SPEED)], 1)
    speed = _numbers(shown, VELOCITY) * (1 - VELOCITY_BLEND) + np.clip((new - _numbers(shown)) / span, -limit, limit) * VELOCITY_BLEND
    state = np.hstack([new, speed]).tolist()
    return [d | dict(zip(SIZE + VELOCITY, v)) | {"time": now, "seen": now, "id": p["id"], "held": False} for p, d, v in zip(shown, dets, state)]


def stabilize_step(shown: list[dict], time_sec: float, dets: list[dict]) -> list[dict]:
    """What to show after the detections of one time: matched boxes eased toward them, missing ones held.

    A box whose hold has run out is gone before anything is matched.
    """
    hold = lambda p: HOLD_IDENTIFIED if p["kind"] == "face" and p["person_id"] else HOLD
    shown = [p for p in shown if time_sec - p["seen"] <= hold(p)]
    boxes = _padded(dets)
    rows = columns = np.zeros(0, int)
    if shown and dets:
        ahead = _ahead(shown, time_sec)
        score, possible, pair = display_scores(shown, ahead, dets, boxes)
        rows, columns = _assign(score, possible)
        eased = _eased([shown[i] for i in rows], ahead[rows], [dets[j] for j in columns], boxes[columns], pair["distance"][rows, columns], pair["change"][rows, columns], time_sec)
    moved = dict(zip(rows.tolist(), eased)) if len(rows) else {}
    out = []
    for i, p in enumerate(shown):
        if i in moved:
            out.append(moved[i])
        else:
            out.append(p | dict(zip(VELOCITY, (_numbers([p], VELOCITY)[0] * SLOWING).tolist())) | {"held": True})
    keys = _keys(dets)
    for j in sorted(set(range(len(dets))) - set(columns.tolist())):
        d = dets[j]
        start = dict(zip(SIZE, boxes[j].tolist())) | dict.fromkeys(VELOCITY, 0.0)
        out.append(d | start | {"time": time_sec, "seen": time_sec, "id": keys[j] or f"{d['kind']}:{d['label']}:{d['det_id']}", "held": False})
    return out


# -- running the steps -----------------------------------------------------------------------


def _clean(r: dict) -> dict:
    """Missing values of a row as None or empty text."""
    out = {k: (None if v is None or (isinstance(v, float) and math.isnan(v)) or v is pd.NA else v) for k, v in r.items()}
    for k in ("label", "person_id", "object_class"):
        out[k] = out.get(k) or ""
    out["confidence"] = float(out.get("confidence") or 0.0)
    return out


def _track_rows(job: str, state: dict, t: float, dets: list[dict]) -> tuple[list[dict], dict]:
    out, state = track_step(job, state, t, dets)
    return [{**r, "job_id": job, "time_sec": t} for r in out], {**state, "kept": state["tracks"]}


def _stable_rows(job: str, state: dict, t: float, dets: list[dict]) -> tuple[list[dict], dict]:
    shown = stabilize_step(state.get("kept", []), t, dets)
    return [{**r, "job_id": job, "time_sec": t} for r in shown], {"time": t, "kept": shown}


Step = Callable[[str, dict, float, list[dict]], tuple[list[dict], dict]]

#: What waits for its time, and what the steps keep from time to time.
ROW = "time_sec double, det_id long, kind string, label string, person_id string, object_class string, confidence double, x double, y double, width double, height double, motion_strength double, tracking_mode string, track_id string"
WAITING = f"event_ms long, {ROW}"
KEPT = f"{ROW}, seen double, time double, id string, held boolean, vx double, vy double, vwidth double, vheight double"


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _typed(rows: list[dict], schema: str) -> list[tuple]:
    """Rows as tuples of a state's schema; numpy numbers as plain ones."""
    plain = lambda v: v.item() if isinstance(v, np.generic) else v
    return [tuple(plain(r.get(n)) for n in _names(schema)) for r in rows]


class _TimedSteps(StatefulProcessor):
    """Buffers rows by job until the watermark passes their time, then steps through the times in order."""

    def __init__(self, step: Step, schema: str, void_after: float, forget: float, show_late: bool, settled: bool):
        self.step, self.schema, self.show_late, self.settled = step, schema, show_late, settled
        self.void_ms, self.forget_ms = int(math.ceil(void_after * 1000)), int(forget * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", WAITING)
        self.kept = handle.getListState("kept", KEPT)
        self.clock = handle.getValueState("clock", "time double, next long, done_ms long")

    def _frame(self, out: list[dict]) -> pd.DataFrame:
        frame = pd.DataFrame(out, columns=[*_names(self.schema), "event_ms"])
        frame["event_time"] = pd.to_datetime(frame["event_ms"].astype("int64"), unit="ms", utc=True)
        return frame[_names(self.schema)]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        reached = timerValues.getCurrentWatermarkInMs()
        done = self.clock.get()[2] if self.clock.exists() else -1
        # what an operator before this one settled comes when the watermark has passed it
        closed = done if self.settled else max(done, reached)
        late: list[dict] = []
        for batch in rows:
            records = [_clean(r) for r in batch.to_dict("records")]
            fresh = [r for r in records if r["event_ms"] > closed]
            late += [r for r in records if r["event_ms"] <= closed]
            if fresh:
                self.waiting.appendList(_typed(fresh, WAITING))
                for ms in {r["event_ms"] for r in fresh}:
                    self.handle.registerTimer(int(ms))
        if late and self.show_late:  # known only now, so that is their event time
            yield self._frame([{**r, "job_id": str(key[0]), "track_id": None, "late": True, "event_ms": reached + 1} for r in late])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        reached = timerValues.getCurrentWatermarkInMs()
        names = _names(WAITING)
        rows = [dict(zip(names, r)) for r in self.waiting.get()] if self.waiting.exists() else []
        due = sorted((r for r in rows if r["event_ms"] <= reached), key=lambda r: (r["time_sec"], r["det_id"] is not None, r["det_id"] or 0, r["track_id"] or ""))
        if not due:
            self._tidy(reached)
            return
        rest = [r for r in rows if r["event_ms"] > reached]
        if rest:
            self.waiting.put(_typed(rest, WAITING))
        else:
            self.waiting.clear()
        time, number, _ = self.clock.get() if self.clock.exists() else (None, 0, 0)
        kept = [_clean(dict(zip(_names(KEPT), r))) for r in self.kept.get()] if self.kept.exists() else []
        state = {"time": time, "next": number, "tracks": kept, "kept": kept}
        out: list[dict] = []
        job = str(key[0])
        for k, r in enumerate(due):
            if k == 0 or r["time_sec"] != due[k - 1]["time_sec"]:
                now: list[dict] = []
            now.append(_clean(r))
            if k + 1 == len(due) or due[k + 1]["time_sec"] != r["time_sec"]:
                shown, state = self.step(job, state, r["time_sec"], now)
                out += [{**x, "event_ms": max(y["event_ms"] for y in now)} for x in shown]
        last = max(r["event_ms"] for r in due)
        self.clock.update((float(state["time"]), int(state.get("next") or number or 0), int(last)))
        if state["kept"]:
            self.kept.put(_typed(state["kept"], KEPT))
        else:
            self.kept.clear()
        self.handle.registerTimer(last + self.void_ms + 1)
        self.handle.registerTimer(last + self.forget_ms)
        yield self._frame(out)

    def _tidy(self, reached: int) -> None:
        if not self.clock.exists() or self.waiting.exists():
            return
        done = self.clock.get()[2]
        if reached > done + self.void_ms:
            self.kept.clear()
        if reached >= done + self.forget_ms:
            self.clock.clear()

    def close(self) -> None:
        pass


def _prepared(df: DataFrame, *more: Column) -> DataFrame:
    """The input columns with defaults for the optional ones."""
    optional = {"det_id": "bigint", "motion_strength": "double", "tracking_mode": "string", "person_id": "string", "object_class": "string", "track_id": "string"}
    kinds = {f.name: f.dataType.simpleString() for f in StructType.fromDDL(ROW).fields}
    have = set(df.columns)
    pick = lambda c: (F.col(c) if c in have or c not in optional else F.lit(None)).cast(kinds[c]).alias(c)
    return df.select(F.col("job_id").cast("string").alias("job_id"), *map(pick, kinds), *more)


def _event_time(df: DataFrame) -> DataFrame:
    """A stream with an ``event_time``; without one, the time in the video counts from a fixed day on."""
    return df if "event_time" in df.columns else df.withColumn("event_time", F.timestamp_seconds(F.col("time_sec") + F.lit(86_400.0)))


def _run_stream(df: DataFrame, step: Step, schema: str, void_after: float, forget: float, show_late: bool, settled: bool = False) -> DataFrame:
    # the buffer decides what is late; the column with the watermark itself stays out, or Spark would drop late rows unseen
    src = _prepared(df, F.unix_millis("event_time").alias("event_ms"))
    return src.groupBy("job_id").transformWithStateInPandas(
        statefulProcessor=_TimedSteps(step, schema, void_after, forget, show_late, settled),
        outputStructType=StructType.fromDDL(schema), outputMode="Append", timeMode="EventTime", eventTimeColumnName="event_time",
    )


def _runs(df: DataFrame, void_after: float, show_after: float | None = None, chunk: float = 600.0) -> DataFrame:
    """``df`` with ``__run`` and its ``__start``: a job is cut where more than ``void_after`` seconds pass without a row.

    With ``show_after``, also ``__show`` and ``__show_start`` for that many seconds.
    """
    order, time = ["time_sec", "det_id", "track_id"], F.col("time_sec")
    cuts = {"__run": ("__start", void_after)} | ({"__show": ("__show_start", show_after)} if show_after is not None else {})
    gaps = scans.scan(df.withColumn("__job", F.struct("job_id")), ["__job"], order, chunk, {"__prior": scans.last(time, current=False)})
    specs = {}
    for run, (start, gap) in cuts.items():
        new = time - F.col("__prior") > gap
        gaps = gaps.withColumns({f"__new{run}": new, f"__first{run}": F.when(F.col("__prior").isNull() | new, time)})
        specs |= {run: scans.count_so_far(F.col(f"__new{run}")), start: scans.last(F.col(f"__first{run}"))}
    return scans.scan(gaps, ["__job"], order, chunk, specs).select(*df.columns, *specs)


def _replay(df: DataFrame, rule: type, schema: str, put: Callable, counted: Callable | None = None) -> DataFrame:
    """The same steps over a table with ``__run`` and ``__start``: runs of jobs spread over tasks, many stepped at once."""
    bucket = F.coalesce(F.floor((F.col("time_sec") - F.col("__start")) / lockstep.BUCKET).cast("long"), F.lit(-1))
    # rows of one time and number have a fixed order too, so that a second pass finds the same
    order = ["__bucket", "job_id", "__run", "time_sec", "det_id", "track_id"]
    order += [c for c in _names(ROW) if c not in order]
    src = spread(df.withColumn("__bucket", bucket), "job_id", "__run").sortWithinPartitions(*order)
    columns = [*_names(ROW), *(["id"] if rule is lockstep.Display else [])]
    return src.mapInArrow(lambda batches: lockstep.fold(batches, rule, columns, put, counted), schema)


def _without(schema: str, name: str) -> str:
    return ", ".join(c for c in schema.split(", ") if c.split()[0] != name)


def live_tracks(stream: DataFrame, delay: str = "2 seconds", forget: float = 86_400.0) -> DataFrame:
    """Tracked detections of a stream, a time at once when the watermark (``delay`` behind ``event_time``) has passed it.

    Rows that come after their time was stepped come out with ``late`` true and no track. After ``forget`` seconds
    without rows a job's numbering starts anew.
    """
    return _run_stream(_event_time(stream).withWatermark("event_time", delay), _track_rows, TRACK_SCHEMA, MAX_GAP, forget, True)


def replay_live_tracks(df: DataFrame, display_runs: bool = False) -> DataFrame:
    """The same for a table, without ``event_time``; nothing is late there, and rows without a job are left out.

    A first pass counts the tracks of each run, a second one puts them out with their numbers. ``display_runs`` adds the
    runs of ``replay_stabilize`` (``__show, __show_start``): the times are the same, so they need not be looked for again.
    """
    rows = _prepared(df).where(F.col("job_id").isNotNull())
    runs = checkpoint(_runs(rows, MAX_GAP, HOLD_IDENTIFIED if display_runs else None))
    counts = _replay(runs, lockstep.Tracking, "job_id string, __run long, n long", lockstep.put_tracks, lockstep.put_counts)
    counts = counts.groupBy("job_id", "__run").agg(F.max("n").alias("n"))
    before = Window.partitionBy("job_id").orderBy("__run").rowsBetween(Window.unboundedPreceding, -1)
    # a run's own numbers start at 0, so the count of new tracks before it is the sum over earlier runs
    offset = counts.select("job_id", "__run", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__before"))
    schema = _without(TRACK_SCHEMA, "event_time") + (", __show long, __show_start double" if display_runs else "")
    return _replay(runs.join(offset, ["job_id", "__run"]), lockstep.Tracking, schema, lockstep.put_tracks)


def stabilize(stream: DataFrame, delay: str | None = "2 seconds", forget: float = 86_400.0) -> DataFrame:
    """Displayed boxes of a stream with stable ids. ``delay=None``: the stream comes from ``live_tracks``, with its watermark."""
    src = stream if delay is None else _event_time(stream).withWatermark("event_time", delay)
    return _run_stream(src, _stable_rows, STABLE_SCHEMA, HOLD_IDENTIFIED, forget, False, settled=delay is None)


def replay_stabilize(df: DataFrame) -> DataFrame:
    """The same for a table, without ``event_time``."""
    if "__show" in df.columns:
        runs = _prepared(df, F.col("__show").alias("__run"), F.col("__show_start").alias("__start"))
    else:
        runs = _runs(_prepared(df), HOLD_IDENTIFIED)
    return _replay(runs, lockstep.Display, _without(STABLE_SCHEMA, "event_time"), lockstep.put_display)


def live_display(stream: DataFrame, delay: str = "2 seconds", forget: float = 86_400.0) -> DataFrame:
    """Tracking and display in one query: equals ``replay_stabilize(replay_live_tracks(...))`` of the rows that were not late."""
    return stabilize(live_tracks(stream, delay, forget).where(~F.col("late")), None, forget)


def split_late(tracked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """On-time rows, and the late side output."""
    return tracked.where(~F.col("late")), tracked.where("late")
