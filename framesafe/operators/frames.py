"""Frames as raw arrays: applying a mask plan, statistics, crops, audit, thumbnail choice.

A frame row is ``(keys…, f, h, w, c, data)`` with ``data`` the bytes of an ``h × w × c`` uint8 array. Spark
joins frames with their plan and spreads them; a task holds one frame at a time.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
MIN_MASKED_DELTA, MASKED_RATIO = 6.0, 1.25
MAX_FOCUS_DELTA, FOCUS_RATIO = 24.0, 2.8
THUMB_LUMA, THUMB_STD = 28.0, 10.0
CROP_PAD = {"plain": 0.0, "face": 0.40, "object": 0.20, "context": 0.60}


def _clip(b, h: int, w: int) -> tuple[int, int, int, int] | None:
    x1, y1, x2, y2 = (int(v) for v in b)
    x1, y1, x2, y2 = max(0, x1), max(0, y1), min(w, x2), min(h, y2)
    return (x1, y1, x2, y2) if x2 > x1 and y2 > y1 else None


def shape_weights(shape: str | None, h: int, w: int) -> np.ndarray | None:
    """Weights of an oval or face-oval mask, None for a full rectangle."""
    kind = (shape or "rect").strip().lower()
    y, x = np.mgrid[0:h, 0:w].astype(float)
    if kind in ("oval", "ellipse"):
        d = np.hypot((x - w / 2) / max(w / 2, 1), (y - h / 2) / max(h / 2, 1))
        return np.clip((1 - d) / 0.08, 0, 1)
    if kind in ("face", "face_oval", "face-oval"):
        v, u = (y - h * 0.48) / max(h * 0.52, 1), (x - w / 2) / max(w / 2, 1)
        cheek = 0.10 * np.exp(-(((v - 0.02) / 0.38) ** 2))
        brow = 0.06 * np.clip((-v - 0.56) / 0.42, 0, 1) ** 1.35
        chin = 0.18 * np.clip((v - 0.34) / 0.66, 0, 1) ** 1.45
        d = np.hypot(u / np.clip(0.92 + cheek - brow - chin, 0.70, 1.0), v)
        return np.clip((1 - d) / 0.075, 0, 1)
    return None


def _block_mean(roi: np.ndarray, nx: int, ny: int) -> np.ndarray:
    """The region averaged over an ``ny × nx`` grid and spread out again."""
    h, w = roi.shape[:2]
    ys, xs = np.minimum(np.arange(h) * ny // h, ny - 1), np.minimum(np.arange(w) * nx // w, nx - 1)
    cell = ys[:, None] * nx + xs[None, :]
    n = np.bincount(cell.ravel(), minlength=nx * ny)
    flat = roi.reshape(-1, roi.shape[2]).astype(float)
    mean = np.stack([np.bincount(cell.ravel(), flat[:, k], nx * ny) / np.maximum(n, 1) for k in range(roi.shape[2])], axis=1)
    return mean[cell]


def redact(frame: np.ndarray, b, effect: str = "blur", strength: int = 220, shape: str | None = None) -> None:
    """Black fill, pixelate or strong blur of a box, in place. The blur is a block mean flattened toward the
    mean colour; it hides as much as a kernel blur but is not equal to one."""
    box = _clip(b, *frame.shape[:2])
    if box is None:
        return
    x1, y1, x2, y2 = box
    roi = frame[y1:y2, x1:x2]
    h, w = roi.shape[:2]
    kind = (effect or "blur").strip().lower()
    if kind in ("solid", "black", "mask"):
        new = np.zeros(roi.shape)
    elif kind == "pixelate":
        size = max(6, max(10, int(strength) // 3))
        new = _block_mean(roi, max(1, w // size), max(1, h // size))
    else:
        s = max(5, int(strength))
        ratio = max(0.008, 0.24 - min(s, 260) * 0.002)
        ratio = min(ratio, 0.012) if s >= 130 else min(ratio, 0.035) if s >= 85 else ratio
        new = _block_mean(roi, max(1, round(w * ratio)), max(1, round(h * ratio)))
        if s >= 160:
            flat = min(0.42, 0.18 + (s - 160) / 220.0)
            new = new * (1 - flat) + roi.reshape(-1, roi.shape[2]).mean(0) * flat
    weight = shape_weights(shape, h, w)
    if weight is not None:
        new = new * weight[..., None] + roi * (1 - weight[..., None])
    frame[y1:y2, x1:x2] = np.clip(new, 0, 255).astype(np.uint8)


def _array(r) -> np.ndarray:
    return np.frombuffer(r["data"], dtype=np.uint8).reshape(int(r["h"]), int(r["w"]), int(r["c"]))


def apply_plan(frames: DataFrame, plan: DataFrame, restore: DataFrame | None, keys: Sequence[str]) -> DataFrame:
    """Frames with their masks drawn and restore boxes copied back from the source frame."""
    on = [*keys, "f"]
    boxes = ["x1", "y1", "x2", "y2"]
    p = plan.groupBy(*on).agg(F.collect_list(F.struct(*boxes, "effect", "strength", "shape")).alias("masks"))
    j = frames.join(p, on, "left")
    r = restore.groupBy(*on).agg(F.collect_list(F.struct(*boxes)).alias("restores")) if restore is not None else None
    j = j.join(r, on, "left") if r is not None else j.withColumn("restores", F.lit(None).cast("array<struct<x1:double,y1:double,x2:double,y2:double>>"))
    cols = frames.columns

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.to_dict("records"):
                src = _array(r)
                img = src.copy()
                for m in r["masks"] if r["masks"] is not None else []:
                    redact(img, [m[c] for c in boxes], m["effect"], m["strength"], m["shape"])
                for m in r["restores"] if r["restores"] is not None else []:
                    box = _clip([m[c] for c in boxes], *img.shape[:2])
                    if box is not None:
                        x1, y1, x2, y2 = box
                        img[y1:y2, x1:x2] = src[y1:y2, x1:x2]
                out.append({**{c: r[c] for c in cols}, "data": img.tobytes()})
            yield pd.DataFrame(out, columns=cols)

    return j.mapInPandas(draw, frames.schema)


def _luma(img: np.ndarray) -> np.ndarray:
    return img[..., 0] * 0.114 + img[..., 1] * 0.587 + img[..., 2] * 0.299 if img.shape[2] >= 3 else img[..., 0].astype(float)


def _sharpness(g: np.ndarray) -> float:
    """Variance of the Laplacian."""
    if min(g.shape) < 3:
        return 0.0
    p = np.pad(g, 1, mode="reflect")
    return float((p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * g).var())


def frame_stats(frames: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean and deviation of the luma, and the sharpness, of every frame."""
    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frames.schema if f.name in (*keys, "f"))
    names = [c for c in frames.columns if c in (*keys, "f")]

    def stats(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            g = [_luma(_array(r)) for r in b.to_dict("records")]
            yield b[names].assign(mean_luma=[float(x.mean()) for x in g], std_luma=[float(x.std()) for x in g], sharpness=[_sharpness(x) for x in g])

    return frames.mapInPandas(stats, f"{head}, mean_luma double, std_luma double, sharpness double")


def choose_thumbnail(stats: DataFrame, keys: Sequence[str], pos: str = "pos") -> DataFrame:
    """The first candidate that is bright and varied enough, else the best score."""
    score = F.col("mean_luma") + F.col("std_luma") * 0.65 - F.col(pos) * 0.8
    good = (F.col("mean_luma") >= THUMB_LUMA) & (F.col("std_luma") >= THUMB_STD)
    key = F.struct(F.when(good, 0).otherwise(1).alias("r"), F.when(good, F.col(pos).cast("double")).otherwise(-score).alias("v"), F.col(pos).alias("pos"))
    return stats.groupBy(*keys).agg(F.min(key).alias("m")).select(*keys, F.col("m.pos").alias(pos), (F.col("m.r") == 0).alias("usable"))


def crops(frames: DataFrame, boxes: DataFrame, keys: Sequence[str], kind: str = "face") -> DataFrame:
    """The padded region of every box as raw bytes. ``boxes``: keys, ``f``, ``id``, box."""
    pad, on = CROP_PAD[kind], [*keys, "f"]
    j = boxes.join(frames, on)
    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in j.schema if f.name in (*on, "id"))
    names = [c for c in j.columns if c in (*on, "id")]

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.to_dict("records"):
                img = _array(r)
                x1, y1, x2, y2 = (int(r[c]) for c in ("x1", "y1", "x2", "y2"))
                px, py = int((x2 - x1) * pad), int((y2 - y1) * pad)
                box = _clip((x1 - px, y1 - py, x2 + px, y2 + py), *img.shape[:2])
                if box is not None:
                    c = img[box[1] : box[3], box[0] : box[2]]
                    out.append({**{n: r[n] for n in names}, "ch": c.shape[0], "cw": c.shape[1], "crop": c.tobytes()})
            yield pd.DataFrame(out, columns=[*names, "ch", "cw", "crop"])

    return j.mapInPandas(cut, f"{head}, ch int, cw int, crop binary")


def audit(source: DataFrame, output: DataFrame, boxes: DataFrame, keys: Sequence[str], shift: int = 80) -> DataFrame:
    """Mean absolute change inside each box and in a control area below it, with the verdict.

    ``boxes``: keys, ``f``, ``id``, ``focus`` (boolean), box. Masked boxes must change clearly more than the control area;
    focus boxes must hardly change.
    """
    on = [*keys, "f"]
    j = boxes.join(source, on).join(output.select(*on, F.col("data").alias("after")), on)
    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in j.schema if f.name in (*on, "id", "focus"))
    names = [c for c in j.columns if c in (*on, "id", "focus")]

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.to_dict("records"):
                a = _array(r).astype(float)
                d = np.abs(a - np.frombuffer(r["after"], dtype=np.uint8).reshape(a.shape))
                h, w = a.shape[:2]
                x1, y1, x2, y2 = (int(round(r[c])) for c in ("x1", "y1", "x2", "y2"))
                x1, y1 = max(0, min(x1, w - 1)), max(0, min(y1, h - 1))
                x2, y2 = max(x1 + 1, min(x2, w)), max(y1 + 1, min(y2, h))
                c1 = max(0, min(y1 + shift, h - (y2 - y1)))
                out.append({**{n: r[n] for n in names}, "target_delta": float(d[y1:y2, x1:x2].mean()), "control_delta": float(d[c1 : c1 + y2 - y1, x1:x2].mean())})
            yield pd.DataFrame(out, columns=[*names, "target_delta", "control_delta"])

    res = j.mapInPandas(check, f"{head}, target_delta double, control_delta double")
    masked = F.col("target_delta") >= F.greatest(F.lit(MIN_MASKED_DELTA), F.col("control_delta") * MASKED_RATIO)
    kept = F.col("target_delta") <= F.greatest(F.lit(MAX_FOCUS_DELTA), F.col("control_delta") * FOCUS_RATIO)
    return res.withColumn("passed", F.when(F.col("focus"), kept).otherwise(masked))


def shift_face(t: Column, start: Column, fps: float = 25.0) -> tuple[Column, Column]:
    """Time and frame of an appearance inside a clip that begins at ``start``."""
    s = t - start
    return s, F.greatest(F.lit(0), F.bround(s * fps, 0).cast("long"))
