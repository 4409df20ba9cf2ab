"""Ordered scans over long keys, cut into chunks.

A window over a whole key puts the key into one task, and one video may hold a third of all rows.
The scan here windows over ``(key, chunk)`` only, where a chunk is a bounded stretch of the order
column, and carries state from chunk to chunk through one summary with a row per chunk. All wanted
values share that summary, so the input is read twice whatever their number.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK = "__chunk"


class Spec(NamedTuple):
    """One value of a scan: ``last``, ``next``, ``max``, ``count`` or ``total`` of a column."""

    kind: str
    value: Column
    current: bool = True


def last(value: Column, current: bool = True) -> Spec:
    """Last non-null value at or before the row (``current=False``: before it)."""
    return Spec("last", value, current)


def following(value: Column, current: bool = True) -> Spec:
    """Next non-null value at or after the row (``current=False``: after it)."""
    return Spec("next", value, current)


def max_before(value: Column) -> Spec:
    return Spec("max", value, False)


def count_so_far(flag: Column) -> Spec:
    """Rows up to and including this one where the flag holds."""
    return Spec("count", flag, True)


def total(flag: Column) -> Spec:
    """Rows of the whole key where the flag holds."""
    return Spec("total", flag, True)


def scan(df: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: float, specs: dict[str, Spec]) -> DataFrame:
    """Add the wanted values to every row. ``order`` is a total order within the key; its first column is
    numeric and cut into chunks of width ``chunk``."""
    keys, part = list(keys), [*keys, CHUNK]
    src = df.withColumn(CHUNK, F.floor(F.col(order[0]) / F.lit(chunk)).cast("long"))
    asc = [F.col(o).asc() for o in order]
    desc = [F.col(o).desc() for o in order]
    stamp = [F.col(o) for o in order]
    wk = Window.partitionBy(*keys)
    before = wk.orderBy(F.col(CHUNK).asc()).rowsBetween(Window.unboundedPreceding, -1)
    after = wk.orderBy(F.col(CHUNK).desc()).rowsBetween(Window.unboundedPreceding, -1)
    local, sums, carries, final = {}, [], [], {}
    for i, (name, s) in enumerate(specs.items()):
        end = 0 if s.current else -1
        w = Window.partitionBy(*part).orderBy(*(desc if s.kind == "next" else asc)).rowsBetween(Window.unboundedPreceding, end)
        lo, sm, ca = f"__l{i}", f"__s{i}", f"__c{i}"
        if s.kind in ("last", "next"):
            marked = F.when(s.value.isNotNull(), F.struct(*stamp, s.value.alias("__x")))
            local[lo] = F.last(s.value, ignorenulls=True).over(w)
            sums.append((F.max if s.kind == "last" else F.min)(marked).alias(sm))
            carries.append(F.last(F.col(sm)["__x"], ignorenulls=True).over(before if s.kind == "last" else after).alias(ca))
            final[name] = F.coalesce(F.col(lo), F.col(ca))
        elif s.kind == "max":
            local[lo] = F.max(s.value).over(w)
            sums.append(F.max(s.value).alias(sm))
            carries.append(F.max(sm).over(before).alias(ca))
            final[name] = F.greatest(F.col(lo), F.col(ca))
        else:
            one = F.when(s.value, 1).otherwise(0).cast("long")
            sums.append(F.sum(one).alias(sm))
            if s.kind == "count":
                local[lo] = F.sum(one).over(w)
                carries.append(F.sum(sm).over(before).alias(ca))
                final[name] = F.col(lo) + F.coalesce(F.col(ca), F.lit(0).cast("long"))
            else:
                carries.append(F.sum(sm).over(wk).alias(ca))
                final[name] = F.col(ca)
    carry = src.groupBy(*part).agg(*sums).select(*part, *carries)
    out = src.withColumns(local) if local else src
    return out.join(carry, part, "left").select(*df.columns, *(c.alias(n) for n, c in final.items()))
