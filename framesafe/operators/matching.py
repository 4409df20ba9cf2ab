"""Greedy one-to-one matching and ordered suppression.

Both are sequential rules inside a group (a frame, a job). Groups whose size is checked to be small
run as one array fold; larger groups run as rounds of aggregations that give the same answer, so no
group is ever gathered unless it is known to fit.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.boxes import box_iou, box_of
from ..session import checkpoint

FOLD_LIMIT = 2_000


def split_by_size(df: DataFrame, group: Sequence[str], limit: int) -> tuple[DataFrame, DataFrame | None]:
    """Rows of groups with at most ``limit`` rows, and the rest (None when there is no larger group)."""
    big = df.groupBy(*group).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > limit).select(*group)
    if big.isEmpty():
        return df, None
    return df.join(big, list(group), "left_anti"), df.join(big, list(group), "left_semi")


def greedy_match(pairs: DataFrame, group: Sequence[str], left: str, right: str, order: Sequence[Column],
                 fold_limit: int = FOLD_LIMIT) -> DataFrame:
    """Take pairs in ``order`` when both ends are still free.

    ``order`` is a list of ascending sort columns; left and right ids are appended, so it is total.
    Returns the chosen rows of ``pairs``.
    """
    ranked = pairs.withColumn("__ord", F.struct(*(c.alias(f"o{i}") for i, c in enumerate(order)), F.col(left), F.col(right)))
    small, big = split_by_size(ranked, group, fold_limit)
    out = _match_fold(small, group, left, right)
    if big is not None:
        out = out.unionByName(_match_rounds(big, group, left, right))
    return out.drop("__ord")


def _match_fold(ranked: DataFrame, group: Sequence[str], left: str, right: str) -> DataFrame:
    cols = [c for c in ranked.columns if c not in group and c != "__ord"]
    rows = F.array_sort(F.collect_list(F.struct("__ord", *cols)))
    lists = ranked.groupBy(*group).agg(rows.alias("__rows"))
    elem = lists.schema["__rows"].dataType

    def take(kept: Column, x: Column) -> Column:
        used = F.exists(kept, lambda k: (k[left] == x[left]) | (k[right] == x[right]))
        return F.when(used, kept).otherwise(F.array_append(kept, x))

    kept = F.aggregate("__rows", F.array().cast(elem), take)
    out = lists.select(*group, F.explode(kept).alias("__x"))
    return out.select(*group, *(F.col(f"__x.{c}").alias(c) for c in [*cols, "__ord"])).select(*ranked.columns)


def _match_rounds(ranked: DataFrame, group: Sequence[str], left: str, right: str) -> DataFrame:
    """Pairs that are the best of both their ends are safe to take; repeat on what is left."""
    g = list(group)
    rest, chosen = checkpoint(ranked), None
    while not rest.isEmpty():
        best_l = rest.groupBy(*g, left).agg(F.min("__ord").alias("__ord"))
        best_r = rest.groupBy(*g, right).agg(F.min("__ord").alias("__ord"))
        ends = best_l.select(*g, "__ord").join(best_r.select(*g, "__ord"), [*g, "__ord"], "left_semi")
        won = checkpoint(rest.join(ends, [*g, "__ord"], "left_semi").select(*ranked.columns))
        chosen = won if chosen is None else chosen.unionByName(won)
        rest = rest.join(won.select(*g, left), [*g, left], "left_anti")
        rest = checkpoint(rest.join(won.select(*g, right), [*g, right], "left_anti").select(*ranked.columns))
    return chosen if chosen is not None else ranked.limit(0)


def suppress(boxes: DataFrame, group: Sequence[str], order: str, thr: float = 0.72,
             fold_limit: int = FOLD_LIMIT) -> DataFrame:
    """Drop a box that overlaps an earlier kept one of its group by more than ``thr``."""
    small, big = split_by_size(boxes, group, fold_limit)
    cols = [c for c in boxes.columns if c not in group]
    rows = F.array_sort(F.collect_list(F.struct(order, *[c for c in cols if c != order])))
    lists = small.groupBy(*group).agg(rows.alias("__rows"))
    elem = lists.schema["__rows"].dataType

    def take(kept: Column, x: Column) -> Column:
        clash = F.exists(kept, lambda k: box_iou(box_of(x), box_of(k)) > thr)
        return F.when(clash, kept).otherwise(F.array_append(kept, x))

    kept = F.aggregate("__rows", F.array().cast(elem), take)
    out = lists.select(*group, F.explode(kept).alias("__x")).select(*group, *(F.col(f"__x.{c}").alias(c) for c in cols))
    out = out.select(*boxes.columns)
    return out if big is None else out.unionByName(_suppress_rounds(big, group, order, thr))


def _suppress_rounds(boxes: DataFrame, group: Sequence[str], order: str, thr: float) -> DataFrame:
    """Keep boxes without an undecided earlier overlap, drop what they cover, repeat."""
    from .boxjoins import overlap_pairs

    g = list(group)
    clash = overlap_pairs(boxes, boxes, g, left_id=order, right_id=order, min_iou=thr, strict=True)
    clash = clash.where(F.col("left_id") < F.col("right_id")).select(
        *g, F.col("left_id").alias("__first"), F.col("right_id").alias("__later")
    )
    edges = checkpoint(clash)
    rest, kept = checkpoint(boxes), None
    while not rest.isEmpty():
        live = edges.join(rest.select(*g, F.col(order).alias("__first")), [*g, "__first"], "left_semi")
        won = checkpoint(rest.join(live.select(*g, F.col("__later").alias(order)), [*g, order], "left_anti").select(*boxes.columns))
        kept = won if kept is None else kept.unionByName(won)
        gone = edges.join(won.select(*g, F.col(order).alias("__first")), [*g, "__first"], "left_semi")
        rest = rest.join(won.select(*g, order), [*g, order], "left_anti")
        rest = rest.join(gone.select(*g, F.col("__later").alias(order)), [*g, order], "left_anti")
        rest = checkpoint(rest.select(*boxes.columns))
    return kept if kept is not None else boxes.limit(0)

