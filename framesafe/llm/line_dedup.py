"""Line dedup with two Bloom filters, for hashes seen once and hashes seen twice.

A line's key is the line without white space ``[\\x20\\x09-\\x0D]`` at its ends, A-Z lower-cased. Keys of
``min_chars`` code points or more that at least ``min_docs`` documents hold lose all their lines except
those in the largest ``doc_id`` that holds them.

1. Tasks fill two bit filters with the hashes of their lines; added up they give one map, of bounded
   size, of hashes that at least two documents hold. All other lines stay where they are.
2. Only lines that the map suspects are shuffled, as 16-byte digests with their document, to count
   documents exactly and choose the one that keeps the line. The count runs per (line, document) first,
   so a line that a third of all documents hold is pre-aggregated and spread.
3. Documents that lose lines get the list of their lost keys and are cut.

Null text is one empty line and stays null. Rows without a ``doc_id`` count for no line and stay whole.
Rows that repeat a ``doc_id`` are one document; all of them keep or lose a line together. Empty tables
give empty tables. Columns besides ``doc_id`` and ``text`` pass through unchanged.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framesafe.session import checkpoint

from .common import LOWER, SPACE, RangeHash, distinct_in_rows, filter_bits, may_hold, per_batch, pieces, plain_names, seen_twice_filter, signed

WHITE = b" \t\n\x0b\x0c\r"


def _line_keys(data: np.ndarray, offsets: np.ndarray, min_chars: int):
    """Start, end, hash and row of the keys of a piece that are long enough."""
    n = len(data)
    if n == 0:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, np.uint64), none
    inside = ~SPACE[data]
    at = np.flatnonzero(inside)  # a line's key runs from its first to its last byte that is no white space
    breaks = np.zeros(n + 1, bool)
    breaks[offsets[:-1]] = True
    breaks[1:][data == 10] = True
    line = np.cumsum(breaks[:n])[at]
    head = np.flatnonzero(np.r_[True, line[1:] != line[:-1]]) if len(at) else at
    starts, ends = at[head], at[np.r_[head[1:] - 1, len(at) - 1]] + 1 if len(at) else at
    points = np.zeros(n + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=points[1:])
    long = points[ends] - points[starts] >= min_chars
    starts, ends = starts[long], ends[long]
    return starts, ends, RangeHash(LOWER[data])(starts, ends), np.searchsorted(offsets, starts, side="right") - 1


def _digest(key: bytes) -> bytes:
    return hashlib.blake2b(key, digest_size=16).digest()


def _text_only(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id IS NOT NULL AND length(text) > 0")


def dropped_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """``doc_id, keys``: for each document that loses lines, the digests of their keys."""
    texts = _text_only(docs)
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = filter_bits(size // 256)

    def hashes(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for _, _, data, offsets in pieces(batch.column("text")):
            _, _, hashed, row = _line_keys(data, offsets, min_chars)
            yield distinct_in_rows(hashed, row)[0]

    bitmap = seen_twice_filter(texts, hashes, bits)

    def suspected(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids = batch.column("doc_id").to_numpy()
        for first, _, data, offsets in pieces(batch.column("text")):
            starts, ends, hashed, row = _line_keys(data, offsets, min_chars)
            hit = may_hold(bitmap.value, hashed, bits)
            lower = LOWER[data].tobytes()
            found = {(int(r), _digest(lower[s:e])) for s, e, r in zip(starts[hit], ends[hit], row[hit])}
            if found:
                rows, keys = zip(*found)
                yield pa.RecordBatch.from_arrays([pa.array(ids[first + np.array(rows)]), pa.array(keys, pa.binary())], ["doc_id", "key"])

    held = checkpoint(per_batch(texts, suspected, "doc_id long, key binary"))
    lost = (
        held.groupBy("key", "doc_id").agg(F.lit(1).alias("one"))
        .groupBy("key").agg(F.count("*").alias("n"), F.max("doc_id").alias("keeper"))
        .where(F.col("n") >= min_docs).select("key", "keeper")
    )
    return held.join(checkpoint(lost), "key").where("doc_id <> keeper").groupBy("doc_id").agg(F.collect_set("key").alias("keys"))


def _cut(text: str, keys: set[bytes], min_chars: int) -> tuple[str, int]:
    kept, dropped = [], 0
    for line in text.split("\n"):
        raw = line.encode().strip(WHITE).lower()
        if len(raw) >= min_chars and len(raw.decode()) >= min_chars and _digest(raw) in keys:
            dropped += 1
        else:
            kept.append(line)
    return "\n".join(kept), dropped


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """``docs`` with ``text`` cut, and ``_n_lines`` (before) and ``_n_dropped`` added (or replaced)."""
    names = [c for c in docs.columns if c not in ("_n_lines", "_n_dropped")]
    rows = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(names)])
    doc_id, text = f"c{names.index('doc_id')}", f"c{names.index('text')}"
    lost = dropped_lines(docs, min_chars, min_docs).select(F.col("doc_id").alias("lost_id"), "keys")
    joined = rows.join(lost, F.col(doc_id).cast("long") == F.col("lost_id"), "left").drop("lost_id")

    def cut(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        keys, at = batch.column("keys"), batch.schema.get_field_index(text)
        dropped = np.zeros(batch.num_rows, np.int64)
        column = batch.column(at)
        if keys.null_count < batch.num_rows:
            texts = column.to_pylist()
            for i in np.flatnonzero(keys.is_valid().to_numpy(zero_copy_only=False)):
                texts[i], dropped[i] = _cut(texts[i] or "", set(keys[i].as_py()), min_chars)
            column = pa.array(texts, column.type)
        columns = [column if i == at else c for i, c in enumerate(batch.columns[:-1])]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(dropped)], [*batch.schema.names[:-1], "dropped"])

    n_lines = F.coalesce(F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1, F.lit(1)).cast("long")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    done = per_batch(joined.select(*rows.columns, n_lines.alias("n_lines"), "keys"), cut, f"{schema}, n_lines long, dropped long")
    return done.toDF(*names, "_n_lines", "_n_dropped")


def cut_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """``docs`` with ``text`` cut and all other columns as they are, whatever their names."""
    rows = plain_names(docs)
    return dedup_lines(rows, min_chars, min_docs).select(*rows.columns).toDF(*docs.columns)
