"""Box geometry on columns.

A ``Box`` is four double columns ``x1, y1, x2, y2`` in pixels (or any unit). Helpers that can fail
return boxes whose four columns are null, so a bad box drops out with one ``is_valid`` filter.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

# Mask padding as (side, top, bottom) shares of the box.
MASK_PADS = {
    "mask": (0.10, 0.18, 0.10),
    "reverse": (0.04, 0.05, 0.08),
    "restore": (0.03, 0.04, 0.06),
}
# Lane safety padding.
PAD_BASE, PAD_FAR, PAD_HEAD, PAD_CAP = 0.035, 0.065, 0.025, 0.14
MIN_HEAD_SIDE = 8.0


class Box(NamedTuple):
    x1: Column
    y1: Column
    x2: Column
    y2: Column

    def columns(self, prefix: str = "") -> list[Column]:
        return [c.alias(prefix + n) for n, c in zip(self._fields, self)]

    def struct(self) -> Column:
        return F.struct(*self.columns())


def box(prefix: str = "", suffix: str = "") -> Box:
    """The box held in the columns ``{prefix}x1{suffix}`` and so on."""
    return Box(*(F.col(f"{prefix}{n}{suffix}").cast("double") for n in Box._fields))


def box_of(struct: Column | str) -> Box:
    """The box held in a struct column."""
    c = F.col(struct) if isinstance(struct, str) else struct
    return Box(*(c[n] for n in Box._fields))


def box_from_array(arr: Column | str) -> Box:
    """The box held in the first four items of an array; shorter arrays give nulls."""
    c = F.col(arr) if isinstance(arr, str) else arr
    return Box(*(F.try_element_at(c, F.lit(i)).cast("double") for i in (1, 2, 3, 4)))


def _num(v) -> Column:
    return v if isinstance(v, Column) else F.lit(v).cast("double")


def clip(c: Column, lo, hi) -> Column:
    return F.greatest(_num(lo), F.least(c, _num(hi)))


def is_valid(b: Box) -> Column:
    return F.coalesce((b.x2 > b.x1) & (b.y2 > b.y1), F.lit(False))


def keep_if(cond: Column, b: Box) -> Box:
    return Box(*(F.when(cond, c) for c in b))


def choose(cond: Column, yes: Box, no: Box) -> Box:
    return Box(*(F.when(cond, a).otherwise(b) for a, b in zip(yes, no)))


# -- sizes and distances ---------------------------------------------------------------------


def width(b: Box) -> Column:
    return F.greatest(F.lit(0.0), b.x2 - b.x1)


def height(b: Box) -> Column:
    return F.greatest(F.lit(0.0), b.y2 - b.y1)


def box_area(b: Box) -> Column:
    return width(b) * height(b)


def box_diag(b: Box) -> Column:
    return F.hypot(width(b), height(b))


def box_center(b: Box) -> tuple[Column, Column]:
    return (b.x1 + b.x2) / 2.0, (b.y1 + b.y2) / 2.0


def box_inter(a: Box, b: Box) -> Column:
    w = F.least(a.x2, b.x2) - F.greatest(a.x1, b.x1)
    h = F.least(a.y2, b.y2) - F.greatest(a.y1, b.y1)
    return F.greatest(F.lit(0.0), w) * F.greatest(F.lit(0.0), h)


def box_iou(a: Box, b: Box) -> Column:
    inter = box_inter(a, b)
    union = box_area(a) + box_area(b) - inter
    return F.coalesce(F.when(union > 0, inter / union), F.lit(0.0))


def box_center_dist(a: Box, b: Box, missing: float = 1e9) -> Column:
    (ax, ay), (bx, by) = box_center(a), box_center(b)
    return F.coalesce(F.hypot(ax - bx, ay - by), F.lit(missing))


def size_ratio(a: Box, b: Box, floor: float = 1.0) -> Column:
    """Larger area over smaller area."""
    sa, sb = F.greatest(box_area(a), F.lit(floor)), F.greatest(box_area(b), F.lit(floor))
    return F.greatest(sa, sb) / F.least(sa, sb)


def log_area_gap(a: Box, b: Box) -> Column:
    return F.abs(F.log(F.greatest(box_area(a), F.lit(1.0)) / F.greatest(box_area(b), F.lit(1.0))))


def center_ratio(a: Box, ref: Box) -> Column:
    return box_center_dist(a, ref) / F.greatest(box_diag(ref), F.lit(1.0))


# -- validation and units --------------------------------------------------------------------


def _round_int(c: Column) -> Column:
    return F.bround(c, 0)


def clamp_box(b: Box, fw, fh) -> Box:
    return Box(clip(b.x1, 0, fw), clip(b.y1, 0, fh), clip(b.x2, 0, fw), clip(b.y2, 0, fh))


def valid_box(b: Box, mode: str = "float", fw=None, fh=None) -> Box:
    """``float`` keeps sub-pixels, ``int`` rounds half-even first, ``frame`` clamps then rounds."""
    if mode == "float":
        return keep_if(is_valid(b), b)
    if mode == "int":
        r = Box(*map(_round_int, b))
        return keep_if(is_valid(r), r)
    if mode == "frame":
        c = clamp_box(b, fw, fh)
        return keep_if(is_valid(c), Box(*map(_round_int, c)))
    raise ValueError(f"unknown mode {mode!r}")


def to_norm(b: Box, fw, fh) -> dict[str, Column]:
    """Pixel box to x, y, width, height in 0..1 with 6 digits."""
    fw, fh = _num(fw), _num(fh)
    c = valid_box(clamp_box(b, fw, fh))
    vals = {"x": c.x1 / fw, "y": c.y1 / fh, "width": (c.x2 - c.x1) / fw, "height": (c.y2 - c.y1) / fh}
    return {k: F.when((fw > 0) & (fh > 0), F.bround(v, 6)) for k, v in vals.items()}


def to_px(x: Column, y: Column, w: Column, h: Column, fw, fh, mode: str = "round") -> Box:
    """Normalised box to pixels; detections round to the nearest pixel, drawn regions truncate."""
    fw, fh = _num(fw), _num(fh)
    snap = _round_int if mode == "round" else (lambda c: c.cast("long").cast("double"))
    raw = Box(snap(x * fw), snap(y * fh), snap((x + w) * fw), snap((y + h) * fh))
    return valid_box(clamp_box(raw, fw, fh))


def region_box(x: Column, y: Column, w: Column, h: Column, fw, fh) -> Box:
    d = lambda c, v: F.coalesce(c.cast("double"), F.lit(v))
    return to_px(d(x, 0.0), d(y, 0.0), d(w, 0.1), d(h, 0.1), fw, fh, mode="trunc")


def box_to_region(b: Box, fw, fh) -> dict[str, Column]:
    fw, fh = _num(fw), _num(fh)
    vals = {"x": b.x1 / fw, "y": b.y1 / fh, "width": (b.x2 - b.x1) / fw, "height": (b.y2 - b.y1) / fh}
    return {k: F.when((fw > 0) & (fh > 0), clip(v, 0, 1)) for k, v in vals.items()}


# -- growing and moving ----------------------------------------------------------------------


def box_expand(b: Box, factor, fw, fh, integer: bool = True) -> Box:
    """Grow about the centre and clamp. The integer form truncates and never shrinks."""
    f = _num(factor)
    cx, cy = box_center(b)
    hw, hh = width(b) / 2.0 * f, height(b) / 2.0 * f
    snap = (lambda c: c.cast("long").cast("double")) if integer else (lambda c: c)
    grown = Box(
        F.greatest(F.lit(0.0), snap(cx - hw)),
        F.greatest(F.lit(0.0), snap(cy - hh)),
        F.least(_num(fw), snap(cx + hw)),
        F.least(_num(fh), snap(cy + hh)),
    )
    return choose((f > 1.0) & is_valid(grown), grown, b) if integer else keep_if(is_valid(b), grown)


def mask_pad(b: Box, fw, fh, preset: str = "mask") -> Box:
    """Asymmetric padding: whole pixels in, rounded pixels out, original box if nothing is left."""
    out = padded_mask(b, fw, fh, preset)
    return choose(is_valid(out), out, b)


def padded_mask(b: Box, fw, fh, preset: str = "mask") -> Box:
    """The padding of :func:`mask_pad`, also where nothing is left."""
    # rint is the half-even rounding of _round_int without a decimal per value; a zero never keeps its sign here
    px, pt, pb = MASK_PADS[preset]
    i = Box(*(c.cast("long").cast("double") for c in b))
    w, h = F.greatest(i.x2 - i.x1, F.lit(1.0)), F.greatest(i.y2 - i.y1, F.lit(1.0))
    return Box(
        F.greatest(F.lit(0.0), F.rint(i.x1 - w * px)),
        F.greatest(F.lit(0.0), F.rint(i.y1 - h * pt)),
        F.least(_num(fw), F.rint(i.x2 + w * px)),
        F.least(_num(fh), F.rint(i.y2 + h * pb)),
    )


def safety_ratio(b: Box, src: Column | None = None) -> Column:
    side = F.greatest(width(b), height(b))
    far = F.when(side < 64, PAD_FAR).when(side < 112, PAD_FAR * 0.55).otherwise(0.0)
    head = F.when(src == "head_fallback", PAD_HEAD).otherwise(0.0) if src is not None else F.lit(0.0)
    return clip(F.lit(PAD_BASE) + far + head, 0.0, PAD_CAP)


def safety_margin(m: Box, r: Column, fw, fh) -> Box:
    """A masked box grown by a share ``r`` of its size, with 40 % more on top; null when nothing is left."""
    out = padded_margin(m, r, fw, fh)
    return keep_if(is_valid(out), out)


def padded_margin(m: Box, r: Column, fw, fh) -> Box:
    """The box of :func:`safety_margin`, also where nothing is left."""
    w, h = F.greatest(m.x2 - m.x1, F.lit(1.0)), F.greatest(m.y2 - m.y1, F.lit(1.0))
    return Box(
        F.greatest(F.lit(0.0), m.x1 - w * r),
        F.greatest(F.lit(0.0), m.y1 - h * r - h * (r * 0.4)),
        F.least(_num(fw), m.x2 + w * r),
        F.least(_num(fh), m.y2 + h * r),
    )


def safety_pad(b: Box, fw, fh, src: Column | None = None, ratio: Column | None = None) -> Box:
    """Mask padding followed by the lane safety margin."""
    return safety_margin(mask_pad(b, fw, fh), safety_ratio(b, src) if ratio is None else ratio, fw, fh)


def motion_pad(b: Box, strength, fw, fh, cap: float = 0.14) -> Box:
    bonus = F.least(F.lit(max(0.0, cap)), F.greatest(F.lit(0.0), _num(strength)) * 5.5)
    return box_expand(b, bonus + 1.0, fw, fh)


def tracked_face_pad(b: Box, strength, fw, fh) -> Box:
    return motion_pad(mask_pad(b, fw, fh), strength, fw, fh)


def box_scale(b: Box, sx, sy, fw, fh, integer: bool = False) -> Box:
    s = Box(b.x1 * _num(sx), b.y1 * _num(sy), b.x2 * _num(sx), b.y2 * _num(sy))
    if integer:
        s = Box(*map(_round_int, s))
    return valid_box(clamp_box(s, fw, fh))


def scale_appearances(arr: Column | str, sx, sy, fw, fh) -> Column:
    """Rescale the ``bbox`` array inside an array of appearance structs, 3 digits."""
    c = F.col(arr) if isinstance(arr, str) else arr

    def one(a: Column) -> Column:
        s = box_scale(box_from_array(a["bbox"]), sx, sy, fw, fh)
        scaled = F.array(*(F.bround(v, 3) for v in s))
        return a.withField("bbox", F.when(s.x1.isNotNull(), scaled).otherwise(a["bbox"]))

    return F.transform(c, one)


def roi_to_box(x: Column, y: Column, w: Column, h: Column, scale, fw, fh, min_side: float = 4.0) -> Box:
    """A window of a scaled-down frame, back in frame pixels."""
    s = _num(scale)
    t = lambda c: (c * s).cast("long").cast("double")
    fx, fy = t(x), t(y)
    bw, bh = F.greatest(F.lit(min_side), t(w)), F.greatest(F.lit(min_side), t(h))
    return valid_box(
        Box(
            F.greatest(F.lit(0.0), fx),
            F.greatest(F.lit(0.0), fy),
            F.least(_num(fw), fx + bw),
            F.least(_num(fh), fy + bh),
        )
    )


def _hull(xs: list[Column], ys: list[Column], fw, fh, min_side: float) -> Box:
    fw, fh = _num(fw), _num(fh)
    out = Box(
        clip(F.floor(F.least(*xs)).cast("double"), 0, fw - 1),
        clip(F.floor(F.least(*ys)).cast("double"), 0, fh - 1),
        clip(F.ceil(F.greatest(*xs)).cast("double"), 0, fw),
        clip(F.ceil(F.greatest(*ys)).cast("double"), 0, fh),
    )
    return keep_if((out.x2 - out.x1 >= min_side) & (out.y2 - out.y1 >= min_side), out)


def box_translate(b: Box, dx: Column, dy: Column, fw, fh, min_side: float = 4.0) -> Box:
    xs = [_round_int(b.x1 + dx), _round_int(b.x2 + dx)]
    ys = [_round_int(b.y1 + dy), _round_int(b.y2 + dy)]
    return _hull(xs, ys, fw, fh, min_side)


def box_affine(b: Box, m: list[Column], fw, fh, min_side: float = 4.0) -> Box:
    """Map the corners by the 2x3 matrix ``m`` (row order) and take the hull."""
    xs, ys = [], []
    for x in (b.x1, b.x2):
        for y in (b.y1, b.y2):
            xs.append(m[0] * x + m[1] * y + m[2])
            ys.append(m[3] * x + m[4] * y + m[5])
    return _hull(xs, ys, fw, fh, min_side)


def box_union(a: Box, b: Box, fw, fh) -> Box:
    """Hull of two boxes; a missing side leaves the other."""
    both = _hull([a.x1, b.x1, a.x2, b.x2], [a.y1, b.y1, a.y2, b.y2], fw, fh, 4.0)
    picked = choose(both.x1.isNotNull(), both, a)
    return choose(a.x1.isNull(), b, choose(b.x1.isNull(), a, picked))


# -- heads and manual boxes ------------------------------------------------------------------


def head_from_person(p: Box, fw, fh) -> Box:
    """The upper part of a person box that lies in the frame (see ``valid_box`` in frame mode)."""
    w, h = F.greatest(p.x2 - p.x1, F.lit(1.0)), F.greatest(p.y2 - p.y1, F.lit(1.0))
    share = F.when(h < 96, 0.30).when(h < 180, 0.26).otherwise(0.22)
    hh = F.greatest(F.lit(MIN_HEAD_SIDE), h * share)
    hw = F.greatest(F.lit(MIN_HEAD_SIDE), F.least(w * 0.62, F.greatest(w * 0.42, hh * 0.82)))
    cx = (p.x1 + p.x2) / 2.0
    ok = p.x1.isNotNull() & (w >= MIN_HEAD_SIDE) & (h >= MIN_HEAD_SIDE)
    head = Box(cx - hw / 2.0, p.y1 - h * 0.01, cx + hw / 2.0, p.y1 + hh + h * 0.02)
    # the head straddles its centre, so clamping cannot empty it
    return keep_if(ok, Box(*map(_round_int, clamp_box(head, fw, fh))))


def fit_head(head: Box, preferred: Box, fw, fh) -> Box:
    """Pull a valid head box toward a valid tracked face and bound its size by it."""
    h, p = head, preferred
    pw, ph = F.greatest(p.x2 - p.x1, F.lit(1.0)), F.greatest(p.y2 - p.y1, F.lit(1.0))
    bias = F.when(box_center_dist(h, p) / F.greatest(F.hypot(pw, ph), F.lit(1.0)) <= 0.8, 0.72).otherwise(0.56)
    (hcx, hcy), (pcx, pcy) = box_center(h), box_center(p)
    cx, cy = pcx * bias + hcx * (1 - bias), pcy * bias + hcy * (1 - bias)
    tw = F.least(F.greatest(pw * 1.10, F.lit(8.0)), F.greatest(h.x2 - h.x1, F.lit(1.0)))
    th = F.least(F.greatest(ph * 1.16, F.lit(8.0)), F.greatest(h.y2 - h.y1, F.lit(1.0)))
    fitted = clamp_box(Box(cx - tw / 2, cy - th / 2, cx + tw / 2, cy + th / 2), fw, fh)
    return choose(h.x1.isNull() | p.x1.isNull(), h, Box(*map(_round_int, fitted)))


def rel_padding(manual: Box, face: Box) -> Column:
    """Margins of a hand-drawn box around a face, in shares of the face size."""
    w, h = F.greatest(face.x2 - face.x1, F.lit(1.0)), F.greatest(face.y2 - face.y1, F.lit(1.0))
    return F.struct(
        ((face.x1 - manual.x1) / w).alias("left"),
        ((face.y1 - manual.y1) / h).alias("top"),
        ((manual.x2 - face.x2) / w).alias("right"),
        ((manual.y2 - face.y2) / h).alias("bottom"),
    )


def apply_padding(face: Box, pad: Column, fw, fh) -> Box:
    w, h = F.greatest(face.x2 - face.x1, F.lit(1.0)), F.greatest(face.y2 - face.y1, F.lit(1.0))
    z = lambda n: F.coalesce(pad[n], F.lit(0.0))
    x1, y1 = _round_int(face.x1 - z("left") * w), _round_int(face.y1 - z("top") * h)
    x2, y2 = _round_int(face.x2 + z("right") * w), _round_int(face.y2 + z("bottom") * h)
    return choose(pad.isNull(), face, roi_to_box(x1, y1, x2 - x1, y2 - y1, 1.0, fw, fh))


# -- steps between frames --------------------------------------------------------------------


def clamp_scale_step(cand: Box, ref: Box, fw, fh, max_step: float = 0.075) -> Box:
    """Bound the growth of width and height from one frame to the next."""
    g = 1.0 + max(0.0, max_step)
    cw, ch, rw, rh = width(cand), height(cand), width(ref), height(ref)
    w = F.least(F.greatest(cw, rw / g), rw * g)
    h = F.least(F.greatest(ch, rh / g), rh * g)
    cx, cy = box_center(cand)
    out = Box(
        F.greatest(F.lit(0.0), cx - w / 2),
        F.greatest(F.lit(0.0), cy - h / 2),
        F.least(_num(fw), cx + w / 2),
        F.least(_num(fh), cy + h / 2),
    )
    changed = (F.abs(w - cw) >= 0.001) | (F.abs(h - ch) >= 0.001)
    ok = F.least(cw, ch, rw, rh) > 0
    return choose(F.coalesce(ok & changed & is_valid(out), F.lit(False)), out, cand)


def scale_penalty(tracker: Box, optical: Box) -> Column:
    """Weight of a tracker box that disagrees in area with the optical box: 1 down to .4."""
    a, b = box_area(tracker), box_area(optical)
    excess = F.greatest(a, b) / F.least(a, b) - 1.0 - 0.25
    w = F.greatest(F.lit(0.4), F.lit(1.0) - F.least(F.lit(1.0), excess / 0.75) * 0.6)
    return F.when((F.least(a, b) > 0) & (excess > 0), w).otherwise(1.0)


def search_expand(gap: Column) -> Column:
    """Search-window growth with the age of the anchor."""
    return F.coalesce(
        F.when(gap > 1.5, F.least(F.lit(3.25), F.lit(1.85) + (gap - 1.5) * 0.24)), F.lit(1.85)
    )


def accept_relock(cand: Box, ref: Box, search: Box | None = None, strict: bool = False) -> Column:
    max_area, max_shift, share = (2.2, 0.72, 0.68) if strict else (2.7, 0.9, 0.78)
    area = F.greatest(box_area(cand), F.lit(1.0))
    too_big = F.lit(False)
    if search is not None:
        too_big = F.coalesce(area > F.greatest(box_area(search), F.lit(1.0)) * share, F.lit(False))
    far = (size_ratio(cand, ref) > max_area) | (center_ratio(cand, ref) > max_shift) | too_big
    with_ref = ~(far & (box_iou(cand, ref) < 0.08))
    return F.coalesce(
        F.when(cand.x1.isNull(), False).when(ref.x1.isNull(), ~too_big).otherwise(with_ref), F.lit(False)
    )


def motion_consistent(cand: Box, ref: Box) -> Column:
    near = (box_iou(cand, ref) >= 0.42) | (center_ratio(cand, ref) <= 0.26)
    return F.coalesce(cand.x1.isNotNull() & ref.x1.isNotNull() & near, F.lit(False))


def agrees_with_motion(verified: Box, motion: Box) -> Column:
    near = (box_iou(verified, motion) >= 0.28) | (center_ratio(verified, motion) <= 0.52)
    return F.coalesce(verified.x1.isNotNull() & motion.x1.isNotNull() & near, F.lit(False))


def is_teleport(cand: Box, tracked: Box, max_ratio: float = 1.5) -> Column:
    d = box_diag(tracked)
    return F.coalesce((d > 0) & (box_center_dist(cand, tracked) > d * max_ratio), F.lit(False))


# -- state form ------------------------------------------------------------------------------


def box_state(b: Box, floor: float = 1.0) -> Column:
    cx, cy = box_center(b)
    return F.when(
        b.x1.isNotNull(),
        F.struct(
            cx.alias("cx"),
            cy.alias("cy"),
            F.greatest(b.x2 - b.x1, F.lit(floor)).alias("w"),
            F.greatest(b.y2 - b.y1, F.lit(floor)).alias("h"),
        ),
    )


def state_box(cx: Column, cy: Column, w: Column, h: Column, fw, fh) -> Box:
    return valid_box(clamp_box(Box(cx - w / 2, cy - h / 2, cx + w / 2, cy + h / 2), fw, fh))


def blend(new: Box, prev: Box, alpha: Column, size_alpha: Column, fw, fh) -> Box:
    """One exponential smoothing step on centre and size with separate weights."""
    a, s = clip(_num(alpha), 0, 1), clip(_num(size_alpha), 0, 1)
    (nx, ny), (px, py) = box_center(new), box_center(prev)
    mix = lambda w, n, p: w * n + (1 - w) * p
    nw, nh = F.greatest(new.x2 - new.x1, F.lit(1.0)), F.greatest(new.y2 - new.y1, F.lit(1.0))
    pw, ph = F.greatest(prev.x2 - prev.x1, F.lit(1.0)), F.greatest(prev.y2 - prev.y1, F.lit(1.0))
    out = state_box(mix(a, nx, px), mix(a, ny, py), mix(s, nw, pw), mix(s, nh, ph), fw, fh)
    keep_new = prev.x1.isNull() | out.x1.isNull() | ((a >= 0.999) & (s >= 0.999))
    return choose(keep_new, new, out)


def adaptive_alpha(rate: Column, zoom: Column | float = 0.0) -> tuple[Column, Column]:
    """Smoothing weights: .62/.42 when still down to .36/.24 when moving, looser sizes in a zoom."""
    w = clip((F.greatest(rate, F.lit(0.0)) - 0.012) / (0.06 - 0.012), 0, 1)
    z = _num(zoom)
    pos = (1 - w) * 0.62 + w * 0.36
    size = (1 - w) * 0.42 + w * 0.24
    extra = F.least(F.lit(1.0), size + F.least(F.lit(0.25), z * 2.5))
    return pos, F.when(z > 0.04, extra).otherwise(size)
