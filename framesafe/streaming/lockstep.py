"""The steps of tracking and display over a table, for many runs of jobs at once.

A task gets the rows of its runs in stretches of ``BUCKET`` seconds, run after run within a stretch, so that a buffer of
rows holds a piece of many runs. The n-th time of every run in the buffer is stepped together, as flat arrays of tracks,
detections and their pairs; what a run keeps goes from buffer to buffer, and is dropped when the run is over. So the cost
of a step is shared by the runs, and a task needs a buffer and what its runs keep, whatever their length.

The rules are those of ``live.track_step`` and ``live.stabilize_step``, value for value.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import rules as R

BUCKET = 4.0  # seconds; longer than any hold, so a run that goes on has rows in every stretch
ROWS = 32_768  # of a buffer
PAIRS = 1 << 18  # that are scored together
OUT_ROWS = 100_000  # that are put out together

Arrays = dict[str, np.ndarray]


class Table:
    """Rows with typed columns as arrays: what is kept from before, then the rows of the buffer."""

    def __init__(self, table: pa.Table):
        self.table = table
        self._codes: Arrays = {}

    def text(self, name: str) -> pa.Array:
        return pc.fill_null(_one(self.table.column(name)), "")

    def code(self, name: str) -> np.ndarray:
        """A number per text; missing texts are empty ones."""
        if name not in self._codes:
            self._codes[name] = _codes(self.text(name))
        return self._codes[name]

    def equals(self, name: str, value: str) -> np.ndarray:
        return pc.equal(self.text(name), value).to_numpy(zero_copy_only=False)

    def number(self, name: str) -> np.ndarray:
        """Values with NaN for missing ones."""
        return _floats(self.table.column(name))


def _one(column: pa.ChunkedArray | pa.Array) -> pa.Array:
    out = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return pa.concat_arrays(out.chunks) if isinstance(out, pa.ChunkedArray) else out


def _codes(texts: pa.Array) -> np.ndarray:
    return pc.fill_null(texts.dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)


def _floats(column: pa.ChunkedArray) -> np.ndarray:
    return _one(column.cast(pa.float64())).to_numpy(zero_copy_only=False)


def _filled(x: np.ndarray) -> np.ndarray:
    return np.where(np.isnan(x), 0.0, x)


def _round4(x: np.ndarray) -> np.ndarray:
    """``round(v, 4)`` of every value, which rounds the exact value where scaling would make or break a tie."""
    scaled = x * 1e4
    out = np.rint(scaled) / 1e4
    for i in np.flatnonzero((np.abs(scaled - np.floor(scaled) - 0.5) < 1e-6) | ~(np.abs(x) < 1e4)):
        out[i] = round(float(x[i]), 4)
    return out


def _pairs(run: np.ndarray, det_run: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Kept row and detection of every pair of a run, a bounded number at once. Both are sorted by run."""
    lo, hi = np.searchsorted(det_run, run, "left"), np.searchsorted(det_run, run, "right")
    ends = np.cumsum(hi - lo)
    a = 0
    while a < len(run):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + PAIRS, "right")))
        n = (hi - lo)[a:b]
        i = np.repeat(np.arange(a, b), n)
        yield i, np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo[a:b], n)
        a = b


def _geometry(a: np.ndarray, b: np.ndarray) -> Arrays:
    """Overlap, distance of centres, ratio of areas and change of size of every pair; boxes are columns."""
    shared = np.maximum(0.0, np.minimum(a[:2] + a[2:], b[:2] + b[2:]) - np.maximum(a[:2], b[:2]))
    shared = shared[0] * shared[1]
    area, area_b = a[2] * a[3], b[2] * b[3]
    union = area + area_b - shared
    floor, floor_b = np.maximum(1e-6, area), np.maximum(1e-6, area_b)
    off = a[:2] - b[:2] + (a[2:] - b[2:]) / 2
    return {
        "iou": np.divide(shared, union, out=np.zeros_like(shared), where=union > 0),
        "distance": np.sqrt(off[0] * off[0] + off[1] * off[1]),
        "growth": np.maximum(floor, floor_b) / np.minimum(floor, floor_b) - 1.0,
        "change": (np.abs(b[2:] - a[2:]) / np.maximum(a[2:], 1e-3)).max(0),
    }


def _weighted(parts: Arrays, weights: dict[str, float]) -> np.ndarray:
    return sum(w * parts[name] for name, w in weights.items())


def assign(i: np.ndarray, j: np.ndarray, score: np.ndarray) -> np.ndarray:
    """Numbers of the matched pairs, best first: the best pair that is left, first in order of ``i, j`` among equals.

    A pair that is the best left for both its sides is matched whatever the others do, so all such pairs are taken at once.
    """
    order = np.lexsort((j, i, -score))
    left = order[score[order] > -np.inf]
    taken = []
    while len(left):
        x, y, at = i[left], j[left], np.arange(len(left))
        first_i, first_j = np.empty(x.max() + 1, int), np.empty(y.max() + 1, int)
        first_i[x[::-1]], first_j[y[::-1]] = at[::-1], at[::-1]
        picked = (first_i[x] == at) & (first_j[y] == at)
        taken.append(left[picked])
        used_i, used_j = np.zeros(len(first_i), bool), np.zeros(len(first_j), bool)
        used_i[x[picked]], used_j[y[picked]] = True, True
        left = left[~(used_i[x] | used_j[y])]
    if not taken:
        return np.zeros(0, int)
    found = np.concatenate(taken)
    place = np.empty(len(score), int)
    place[order] = np.arange(len(order))
    return found[np.argsort(place[found])]


def _unmatched(n: int, matched: np.ndarray) -> np.ndarray:
    free = np.ones(n, bool)
    free[matched] = False
    return np.flatnonzero(free)


def _within(run: np.ndarray) -> np.ndarray:
    """Number of a row within its run; rows are sorted by run."""
    return np.arange(len(run)) - np.searchsorted(run, run, "left")


def _joined(parts: list[Arrays], order: np.ndarray | None = None) -> Arrays:
    out = {k: np.concatenate([p[k] for p in parts], axis=-1) for k in parts[0]}
    return out if order is None else {k: v[..., order] for k, v in out.items()}


def _at(rows: Arrays, i: np.ndarray) -> Arrays:
    return {k: v[..., i] for k, v in rows.items()}


class Tracking:
    """Kept per track: row, box, confidence, time last seen, number within the run."""

    KEEPS = ("conf", "seen", "no")

    def __init__(self, rows: Table, kept: int):
        self.code = {c: rows.code(c) for c in ("kind", "label", "person_id")}
        self.face, self.object = rows.equals("kind", "face"), rows.equals("kind", "object")
        self.person, self.classed = ~rows.equals("person_id", ""), ~rows.equals("object_class", "")
        self.strength, self.moving = np.maximum(0.0, _filled(rows.number("motion_strength"))), rows.equals("tracking_mode", "global")
        self.box = np.stack([rows.number(c) for c in R.SIZE])
        self.conf = _filled(rows.number("confidence"))

    def step(self, kept: Arrays, det: np.ndarray, det_run: np.ndarray, det_time: np.ndarray, last: np.ndarray, number: np.ndarray) -> tuple[Arrays, Arrays]:
        """Tracks after the detections ``det`` (rows) of one time of every run; the same rows come out."""
        now = det_time[np.searchsorted(det_run, kept["run"], "left")]
        alive = ~(now - last[kept["run"]] > R.MAX_GAP) & (now - kept["seen"] <= R.UNSEEN)
        kept = _at(kept, np.flatnonzero(alive))
        kept["conf"] = _round4(np.maximum(R.KEEP_CONFIDENCE, kept["conf"] * R.DECAY))
        i, j, score = self._scores(kept, det, det_run)
        best = assign(i, j, score)
        i, j = i[best], j[best]
        t, d = kept["ref"][i], det[j]
        strength, moving = self.strength[t], self.moving[t]
        share = np.minimum(0.86, 0.62 + np.minimum(0.18, 1.6 * strength) + 0.08 * moving)
        known = self.person[t] | self.person[d]
        share = np.where(self.face[d], np.maximum(share, np.where(known, 0.88, 0.78)), share)
        box = np.round(_filled(kept["box"][:, i]) * (1 - share) + _filled(self.box[:, d]) * share, 6)
        found = {"run": det_run[j], "ref": d, "box": box, "conf": _round4(np.maximum(kept["conf"][i], self.conf[d])), "seen": det_time[j], "no": kept["no"][i]}
        new = _unmatched(len(det), j)
        d, run = det[new], det_run[new]
        fresh = {"run": run, "ref": d, "box": self.box[:, d], "conf": self.conf[d], "seen": det_time[new], "no": (number[run] + _within(run)).astype(float)}
        np.add.at(number, run, 1)
        last[det_run] = det_time
        rest = _at(kept, _unmatched(len(kept["run"]), i))
        parts = [found, fresh, rest]
        # rows of a run: matches, best first, then new tracks, then those that were not seen
        order = np.argsort(np.concatenate([p["run"] for p in parts]), kind="stable")
        kept = _joined(parts, order)
        return kept, kept

    def _scores(self, kept: Arrays, det: np.ndarray, det_run: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        box, box_d = _filled(kept["box"]), _filled(self.box[:, det])
        found = [(np.zeros(0, int), np.zeros(0, int), np.zeros(0))]
        for i, j in _pairs(kept["run"], det_run):
            t, d = kept["ref"][i], det[j]
            same = {c: x[t] == x[d] for c, x in self.code.items()}
            alike = same["kind"] & np.where(self.face[t], ~(self.person[t] & self.person[d]) | same["person_id"], same["label"])
            i, j, t, d = i[alike], j[alike], t[alike], d[alike]
            pair = _geometry(box[:, i], box_d[:, j])
            face, named, strength = self.face[t], self.person[t] & self.person[d], self.strength[t]
            reach = np.where(face, *R.TRACK_REACH) + np.minimum(0.24, strength * 3.0) + 0.05 * self.moving[t]
            near = (pair["iou"] >= R.LEAST_OVERLAP) | (pair["distance"] <= reach)
            steady = (pair["growth"] <= R.MOST_GROWTH - 1.0) | (pair["iou"] >= R.DOUBTFUL_OVERLAP)
            bonus = np.where(face & named, R.TRACK_BONUS[0], np.where(self.object[t] & self.classed[t] & self.classed[d], R.TRACK_BONUS[1], 0.0))
            pair["motion"] = np.minimum(R.MOTION_CAP, R.TRACK_WEIGHTS["motion"] * strength)
            can = np.flatnonzero(near & steady)
            found.append((i[can], j[can], (bonus + _weighted(pair, R.TRACK_WEIGHTS | {"motion": 1.0}))[can]))
        return tuple(np.concatenate(x) for x in zip(*found))


class Display:
    """Kept per displayed box: row, box, velocity, time of the box, time last seen, the row that gave it its id."""

    KEEPS = ("time", "seen", "held", "born")

    def __init__(self, rows: Table, kept: int):
        table = rows.table
        self.code = {c: rows.code(c) for c in ("kind", "label")}
        self.face, self.object = rows.equals("kind", "face"), rows.equals("kind", "object")
        self.person, self.unnamed = ~rows.equals("person_id", ""), rows.equals("label", "Face")
        track, person = rows.text("track_id"), rows.text("person_id")
        by_person = pc.if_else(pa.array(self.face & self.person), pc.binary_join_element_wise("face", person, ":"), "")
        key = pc.if_else(pc.not_equal(track, ""), pc.binary_join_element_wise("track", track, ":"), by_person)
        self.key, self.keyed = _codes(key), pc.not_equal(key, "").to_numpy(zero_copy_only=False)
        # an id is a row's key, or else made up from its kind, label and number
        number = pc.fill_null(_one(table.column("det_id")).cast(pa.string()), "None")
        made = pc.binary_join_element_wise(pc.fill_null(_one(table.column("kind")), "None"), rows.text("label"), number, ":")
        own = pc.if_else(pa.array(self.keyed), key, made)
        self.id = pa.concat_arrays([_one(table.column("id").slice(0, kept)), own.slice(kept)])
        box = _filled(np.stack([rows.number(c) for c in R.SIZE]))
        size = np.clip(box[2:] * (1 + 2 * np.where(self.face, *R.PAD)), 0, 1)
        self.box = np.concatenate([np.clip(box[:2] + box[2:] / 2 - size / 2, 0, 1), size])
        self.conf = np.clip(_filled(rows.number("confidence")), 0, 1)

    def step(self, kept: Arrays, det: np.ndarray, det_run: np.ndarray, det_time: np.ndarray, last: np.ndarray, number: np.ndarray) -> tuple[Arrays, Arrays]:
        """What to show after the detections ``det`` (rows) of one time of every run; the same rows come out."""
        now = det_time[np.searchsorted(det_run, kept["run"], "left")]
        p = kept["ref"]
        hold = np.where(self.face[p] & self.person[p], R.HOLD_IDENTIFIED, R.HOLD)
        there = np.flatnonzero(now - kept["seen"] <= hold)
        kept, now = _at(kept, there), now[there]
        p = kept["ref"]
        face = self.face[p]
        step = np.clip(now - kept["time"], -np.where(face, *R.LAG), np.where(face, *R.LEAD))
        size = np.clip(kept["box"][2:] + kept["speed"][2:] * step, 0, 1)
        moved = np.concatenate([np.clip(np.minimum(1 - size, kept["box"][:2] + kept["speed"][:2] * step), 0, 1), size])
        ahead = np.where(np.abs(step) < 1e-4, kept["box"], moved)
        i, j, score, distance, change = self._scores(kept, ahead, det, det_run)
        best = assign(i, j, score)
        i, j, distance, change = i[best], j[best], distance[best], change[best]
        d = det[j]
        still, moving, small, large, small_change, large_change = R.SHIFT[(~(face & self.keyed[p])).astype(int)[i]].T
        share = np.where((distance >= large) | (change >= large_change), moving, R.SMOOTH)
        share = np.where((distance <= small) & (change <= small_change), still, share)
        box = ahead[:, i] * (1 - share) + self.box[:, d] * share
        span = np.maximum(1 / 120, np.abs(now[i] - kept["time"][i]))
        top = np.where(self.face[d], *R.TOP_SPEED)
        limit = np.stack([top, top, np.full(len(top), R.TOP_SIZE_SPEED), np.full(len(top), R.TOP_SIZE_SPEED)])
        speed = kept["speed"][:, i] * (1 - R.VELOCITY_BLEND) + np.clip((box - kept["box"][:, i]) / span, -limit, limit) * R.VELOCITY_BLEND
        shown = dict(kept)  # unmatched boxes stay, and slow down
        shown["ref"], shown["box"], shown["speed"] = p.copy(), kept["box"].copy(), kept["speed"] * R.SLOWING[:, None]
        shown["time"], shown["seen"], shown["held"] = kept["time"].copy(), kept["seen"].copy(), np.ones(len(p))
        shown["ref"][i], shown["box"][:, i], shown["speed"][:, i], shown["held"][i] = d, box, speed, 0.0
        shown["time"][i] = shown["seen"][i] = now[i]
        new = _unmatched(len(det), j)
        d, t = det[new], det_time[new]
        fresh = {"run": det_run[new], "ref": d, "box": self.box[:, d], "speed": np.zeros((4, len(d))), "time": t, "seen": t, "held": np.zeros(len(d)), "born": d.astype(float)}
        order = np.argsort(np.concatenate([shown["run"], fresh["run"]]), kind="stable")
        kept = _joined([shown, fresh], order)
        return kept, kept

    def _scores(self, kept: Arrays, ahead: np.ndarray, det: np.ndarray, det_run: np.ndarray) -> tuple[np.ndarray, ...]:
        box = self.box[:, det]
        speed = np.sqrt(kept["speed"][0] * kept["speed"][0] + kept["speed"][1] * kept["speed"][1])
        p = kept["ref"]
        keyed = self.keyed[p]
        reaches = np.where(keyed, R.SHOW_REACH_KEYED, np.where(self.face[p], *R.SHOW_REACH)) + np.minimum(np.where(keyed, 0.14, 0.08), 0.09 * speed)
        found = [(np.zeros(0, int), np.zeros(0, int), np.zeros(0), np.zeros(0), np.zeros(0))]
        for i, j in _pairs(kept["run"], det_run):
            p, d = kept["ref"][i], det[j]
            both = self.keyed[p] & self.keyed[d]
            equal = both & (self.key[p] == self.key[d])
            some = np.flatnonzero(~both | equal)
            i, j, p, d, equal = i[some], j[some], p[some], d[some], equal[some]
            same = {c: x[p] == x[d] for c, x in self.code.items()}
            other_name = ~same["label"] & (self.object[p] | (self.face[p] & ~self.keyed[p] & ~(self.unnamed[p] | self.unnamed[d])))
            alike = same["kind"] & ~other_name
            i, j, d, equal = i[alike], j[alike], d[alike], equal[alike]
            pair = _geometry(ahead[:, i], box[:, j])
            near = (pair["iou"] >= R.LEAST_OVERLAP) | (pair["distance"] <= reaches[i])
            steady = (pair["change"] <= 1.15) | (pair["distance"] <= 0.09) | (pair["iou"] >= R.DOUBTFUL_OVERLAP)
            pair["confidence"] = self.conf[d]
            can = np.flatnonzero(near & steady)
            score = R.SHOW_BONUS_KEYED * equal + _weighted(pair, R.SHOW_WEIGHTS)
            found.append((i[can], j[can], score[can], pair["distance"][can], pair["change"][can]))
        return tuple(np.concatenate(x) for x in zip(*found))


class _Kept(NamedTuple):
    """What a run keeps: the stretch it was last met in, its clock and count, and its rows among those of a buffer."""

    bucket: int
    last: float
    number: int
    rows: pa.Table
    values: Arrays
    start: int
    end: int


def _buffers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows in tables of ``ROWS`` or more, no time of a run cut."""
    held: list[pa.RecordBatch] = []
    n, enough = 0, ROWS
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n < enough:
            continue
        table = pa.Table.from_batches(held)
        run, time = table.column("__run").to_numpy(), _floats(table.column("time_sec"))
        job = _codes(_one(table.column("job_id")))
        same = (run == run[-1]) & (time == time[-1]) & (job == job[-1])
        cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
        if cut:
            yield table.slice(0, cut)
            held, n, enough = table.slice(cut).to_batches(), table.num_rows - cut, ROWS
        else:
            enough = 2 * n
    if n:
        yield pa.Table.from_batches(held)


def _batches(columns: dict[str, pa.Array]) -> Iterator[pa.RecordBatch]:
    for b in pa.table(columns).to_batches(max_chunksize=10_000):
        yield b


def _put_boxes(box: np.ndarray) -> dict[str, pa.Array]:
    return {n: pa.array(x, pa.float64(), from_pandas=True) for n, x in zip(R.SIZE, box)}


def put_tracks(steps: Tracking, rows: Table, table: pa.Table, pending: list) -> Iterator[pa.RecordBatch]:
    """Tracks of a time; their numbers follow those of the job's earlier runs (``__before``)."""
    kept = _joined([k for k, _ in pending])
    time = table.select([c for c in table.column_names if c in ("job_id", "time_sec", "__before", "__show", "__show_start")]).take(pa.array(np.concatenate([a for _, a in pending])))
    ref = pa.array(kept["ref"])
    number = pa.array(_one(time.column("__before")).to_numpy() + kept["no"].astype(np.int64))
    job = _one(time.column("job_id"))
    texts = {c: rows.text(c).take(ref) for c in ("label", "person_id", "object_class")}
    out = {"job_id": job, "time_sec": time.column("time_sec"), "det_id": rows.table.column("det_id").take(ref), "track_id": pc.binary_join_element_wise(job, number.cast(pa.string()), ":")}
    out |= {"kind": rows.table.column("kind").take(ref), **texts, "confidence": pa.array(kept["conf"]), **_put_boxes(kept["box"]), "late": pa.array(np.zeros(len(ref), bool))}
    yield from _batches(out | {c: time.column(c) for c in ("__show", "__show_start") if c in time.column_names})


def put_counts(jobs: list, runs: list[int], counts: np.ndarray) -> pa.RecordBatch:
    """How many tracks a run had so far."""
    return pa.RecordBatch.from_arrays([pa.array(jobs, pa.string()), pa.array(runs, pa.int64()), pa.array(counts)], ["job_id", "__run", "n"])


def put_display(steps: Display, rows: Table, table: pa.Table, pending: list) -> Iterator[pa.RecordBatch]:
    """Boxes displayed at a time."""
    kept = _joined([k for k, _ in pending])
    time = table.select(["job_id", "time_sec"]).take(pa.array(np.concatenate([a for _, a in pending])))
    ref = pa.array(kept["ref"])
    same = {c: rows.table.column(c).take(ref) for c in ("track_id", "kind")}
    texts = {c: rows.text(c).take(ref) for c in ("label", "person_id")}
    confidence = pa.array(_filled(rows.number("confidence"))[kept["ref"]])
    out = {"job_id": time.column("job_id"), "time_sec": time.column("time_sec"), "id": steps.id.take(pa.array(kept["born"].astype(np.int64))), **same, **texts}
    yield from _batches(out | {"confidence": confidence, **_put_boxes(kept["box"]), "held": pa.array(kept["held"] > 0)})


def _numbers(table: pa.Table) -> np.ndarray:
    """A number for every run of the table, from 0."""
    job, run = _codes(_one(table.column("job_id"))).astype(np.int64), table.column("__run").to_numpy()
    return np.unique(job * (int(run.max()) + 1) + run, return_inverse=True)[1]


def fold(batches: Iterator[pa.RecordBatch], rule: type, columns: list[str], put: Callable, counted: Callable | None = None) -> Iterator[pa.RecordBatch]:
    """Steps through the rows of a task. They come with ``job_id, __run, __bucket``, in order of ``__bucket``, run and time.

    ``columns`` are those a kept row goes on with; ``put`` makes batches of what the times leave; ``counted``, if given,
    those of the numbers of new rows instead.
    """
    store: dict[tuple, _Kept] = {}
    for table in _buffers(batches):
        run = _numbers(table)
        n_runs = int(run.max()) + 1
        heads = np.unique(run, return_index=True)[1]
        jobs, runs = table.column("job_id").take(pa.array(heads)).to_pylist(), table.column("__run").to_numpy()[heads].tolist()
        last, number = np.full(n_runs, -np.inf), np.zeros(n_runs, np.int64)
        tables, values, kept_rows = [], [], 0
        for k, key in enumerate(zip(jobs, runs)):
            s = store.pop(key, None)
            if s is None:
                continue
            last[k], number[k] = s.last, s.number
            if s.end > s.start:
                n = s.end - s.start
                tables.append(s.rows.slice(s.start, n))
                part = _at(s.values, slice(s.start, s.end))
                here = np.arange(kept_rows, kept_rows + n)
                values.append(part | {"run": np.full(n, k), "ref": here} | ({"born": here.astype(float)} if "born" in part else {}))
                kept_rows += n
        own = table.select([c for c in columns if c in table.column_names])
        for c in columns:
            if c not in own.column_names:
                own = own.append_column(c, pa.nulls(len(own), pa.string()))
        rows = pa.concat_tables([*tables, own.select(columns)])
        rows = Table(rows)
        steps = rule(rows, kept_rows)
        empty = {"run": np.zeros(0, int), "ref": np.zeros(0, int), "box": np.zeros((4, 0)), **{c: np.zeros(0) for c in rule.KEEPS}}
        if rule is Display:
            empty["speed"] = np.zeros((4, 0))
        kept = _joined([empty, *values])

        time = _floats(table.column("time_sec"))
        order = np.argsort(run, kind="stable")
        r, t = run[order], time[order]
        turn = np.cumsum(np.r_[True, (r[1:] != r[:-1]) | (t[1:] != t[:-1])]) - 1
        nth = turn - turn[np.searchsorted(r, r, "left")]
        n_steps = np.zeros(n_runs, int)
        n_steps[r] = nth + 1  # the last one of a run stays
        by_step = np.argsort(nth, kind="stable")
        det, nth = order[by_step], nth[by_step]
        bounds = np.searchsorted(nth, np.arange(nth[-1] + 2))
        done, pending, n_pending = [], [], 0
        for k, (lo, hi) in enumerate(zip(bounds[:-1], bounds[1:])):
            at = det[lo:hi]
            kept, shown = steps.step(kept, at + kept_rows, run[at], time[at], last, number)
            if counted is None:
                first = np.searchsorted(run[at], shown["run"], "left")
                pending.append((shown, at[first]))
                n_pending += len(first)
                if n_pending >= OUT_ROWS:
                    yield from put(steps, rows, table, pending)
                    pending, n_pending = [], 0
            over = n_steps[kept["run"]] == k + 1
            if over.any():
                done.append(_at(kept, np.flatnonzero(over)))
                kept = _at(kept, np.flatnonzero(~over))
        if pending:
            yield from put(steps, rows, table, pending)
        if counted is not None:
            yield counted(jobs, runs, number)

        ended = _joined([empty, *done])
        ended = _at(ended, np.argsort(ended["run"], kind="stable"))
        state = rows.table.take(pa.array(ended["ref"]))
        if rule is Display:
            state = state.set_column(columns.index("id"), "id", steps.id.take(pa.array(ended["born"].astype(np.int64))))
        state = state.combine_chunks()
        starts = np.searchsorted(ended["run"], np.arange(n_runs + 1)).tolist()
        buckets = np.zeros(n_runs, np.int64)
        buckets[run] = table.column("__bucket").to_numpy()  # the last one of a run stays
        for k, key in enumerate(zip(jobs, runs)):
            store[key] = _Kept(int(buckets[k]), float(last[k]), int(number[k]), state, ended, starts[k], starts[k + 1])
        here = int(table.column("__bucket")[-1].as_py())
        for key in [k for k, s in store.items() if s.bucket < here - 1]:
            del store[key]
