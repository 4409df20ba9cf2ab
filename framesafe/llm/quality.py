"""Quality classifier: a generalised additive model with pairwise interactions.

Boosting goes round the features in turn and fits a shallow tree on the residuals over the bins of one
feature; the trees of a feature add up to one lookup table. Then the pairs with the largest gain get
tables of two features the same way. A score is the sum of the intercept and of one entry per table,
added up for a whole batch of documents at once.

Features are statistics of the whole text only. Labels, language, source and id are never features.
The model is fitted on at most ``max_rows`` labelled documents (those with the smallest hash of the id),
whose features are gathered; every document is scored.

Null and empty texts have a defined score (all statistics zero). Labels that are null or not 0 or 1 are
no labels; a document with both labels counts as half of each. Labels without document and documents
without label are fine. If no label of one kind is there, every score is the share of label 1
(1/2 without labels). Repeated rows are scored alike.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Words, distinct_in_rows, per_batch, pieces, plain_names, shingle_hashes

FEATURES = (
    "log_bytes", "log_words", "word_bytes", "upper", "digits", "marks", "symbols", "calls", "spaces", "wide", "log_lines",
    "words_per_line", "distinct_words", "distinct_triples", "sentence_ends", "symbol_words", "shout_words", "top_gap", "bars",
)

_SETS = {
    "upper": range(65, 91), "lower": range(97, 123), "digits": range(48, 58), "wide": range(128, 256),
    "spaces": (32, 9, 10, 11, 12, 13), "marks": b".,;:'\"()-?!", "symbols": b"#$%&*+/<=>@[\\]^_`{|}~", "calls": b"!?", "bars": b"|", "ends": b".!?",
}
_IN = {k: np.isin(np.arange(256), list(v)) for k, v in _SETS.items()}


def text_features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of ``FEATURES`` for each text of a piece."""
    rows, size = len(offsets) - 1, np.diff(offsets)

    def share(name: str) -> np.ndarray:
        sums = np.zeros(len(data) + 1, np.int64)
        np.cumsum(_IN[name][data], out=sums[1:])
        return (sums[offsets[1:]] - sums[offsets[:-1]]) / np.maximum(size, 1)

    upper, lower = share("upper"), share("lower")
    lines = np.zeros(len(data) + 1, np.int64)
    np.cumsum(data == 10, out=lines[1:])
    n_lines = lines[offsets[1:]] - lines[offsets[:-1]] + 1

    w = Words(data, offsets)
    n_words = np.diff(w.first)
    many = np.maximum(n_words, 1)

    def per_word(mask: np.ndarray) -> np.ndarray:
        return np.bincount(w.row[mask], minlength=rows) / many

    def distinct(hashes: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        _, r, times = distinct_in_rows(hashes, row)
        top, total = np.zeros(rows), np.maximum(np.bincount(row, minlength=rows), 1)
        if len(r):
            starts = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
            top[r[starts]] = np.maximum.reduceat(times, starts)
        return np.bincount(r, minlength=rows) / total, top / total

    words, top = distinct(w.hash, w.row)
    triples, _ = distinct(*shingle_hashes(w.hash, w.row, w.first, 3))
    low = np.zeros(len(data) + 1, np.int64)
    np.cumsum(_IN["lower"][data] | _IN["wide"][data], out=low[1:])
    high = np.zeros(len(data) + 1, np.int64)
    np.cumsum(_IN["upper"][data], out=high[1:])
    shout = (low[w.ends] == low[w.starts]) & (high[w.ends] - high[w.starts] > 1)
    last = data[w.ends - 1] if len(w.ends) else np.zeros(0, np.uint8)
    columns = [
        np.log1p(size), np.log1p(n_words), (size - share("spaces") * size) / many, upper / np.maximum(upper + lower, 1e-9), share("digits"),
        share("marks"), share("symbols"), share("calls"), share("spaces"), share("wide"), np.log1p(n_lines), n_words / n_lines, words, triples,
        per_word(_IN["ends"][last]), per_word(_IN["symbols"][last]), per_word(shout), top, share("bars"),
    ]
    return np.stack(columns, axis=1)


@dataclass
class Gam:
    """Bin edges, one table per feature, and tables of pairs over coarser edges."""

    intercept: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for k, (edges, tab) in enumerate(zip(self.edges, self.tables)):
            total += tab[np.searchsorted(edges, x[:, k], side="right")]
        for i, j, ei, ej, tab in self.pairs:
            total += tab[np.searchsorted(ei, x[:, i], side="right"), np.searchsorted(ej, x[:, j], side="right")]
        return 1 / (1 + np.exp(-np.clip(total, -40, 40)))


def _edges(x: np.ndarray, bins: int) -> np.ndarray:
    """Inner edges between distinct values, at quantiles."""
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1], method="lower"))


def _shallow_tree(g: np.ndarray, h: np.ndarray, leaves: int, ridge: float) -> np.ndarray:
    """Leaf values per bin: the best cuts of an ordered feature, one at a time."""
    gs, hs = np.r_[0, np.cumsum(g)], np.r_[0, np.cumsum(h)]
    cuts = [0, len(g)]
    gain_of = lambda a, b: (gs[b] - gs[a]) ** 2 / (hs[b] - hs[a] + ridge)
    for _ in range(leaves - 1):
        best = (1e-9, -1)
        for a, b in itertools.pairwise(cuts):
            if b - a > 1:
                m = np.arange(a + 1, b)
                gain = gain_of(a, m) + gain_of(m, b) - gain_of(a, b)
                k = int(np.argmax(gain))
                best = max(best, (float(gain[k]), int(m[k])))
        if best[1] < 0:
            break
        cuts = sorted([*cuts, best[1]])
    out = np.zeros(len(g))
    for a, b in itertools.pairwise(cuts):
        out[a:b] = (gs[b] - gs[a]) / (hs[b] - hs[a] + ridge)
    return out


def _quadrants(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[np.ndarray, float]:
    """The best pair of one cut per feature on a grid, and its gain."""
    gs, hs = (np.pad(np.cumsum(np.cumsum(t, 0), 1), ((1, 0), (1, 0))) for t in (g, h))
    best, out = 0.0, np.zeros(g.shape)
    total = gs[-1, -1] ** 2 / (hs[-1, -1] + ridge)
    for a in range(1, g.shape[0]):
        for b in range(1, g.shape[1]):
            cells = [(0, a, 0, b), (0, a, b, -1), (a, -1, 0, b), (a, -1, b, -1)]
            sums = [(gs[r1, c1] - gs[r0, c1] - gs[r1, c0] + gs[r0, c0], hs[r1, c1] - hs[r0, c1] - hs[r1, c0] + hs[r0, c0]) for r0, r1, c0, c1 in cells]
            gain = sum(x * x / (y + ridge) for x, y in sums) - total
            if gain > best + 1e-12:
                best, values = gain, [x / (y + ridge) for x, y in sums]
                out = np.empty(g.shape)
                out[:a, :b], out[:a, b:], out[a:, :b], out[a:, b:] = values
    return out, best


def fit(x: np.ndarray, y: np.ndarray, bins: int = 64, rounds: int = 150, rate: float = 0.15, leaves: int = 4, pairs: int = 5, grid: int = 8, ridge: float = 1.0) -> Gam:
    n, f = x.shape if x.ndim == 2 else (0, len(FEATURES))
    p = float(np.clip(y.mean(), 0, 1)) if n else 0.5
    if p in (0.0, 1.0) or not n:
        q = np.clip(p, 1e-6, 1 - 1e-6)
        return Gam(float(np.log(q / (1 - q))), [np.zeros(0)] * f, [np.zeros(1)] * f, [])
    edges = [_edges(x[:, k], bins) for k in range(f)]
    where = [np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(edges)]
    tables = [np.zeros(len(e) + 1) for e in edges]
    intercept = float(np.log(p / (1 - p)))
    total = np.full(n, intercept)

    def residual() -> tuple[np.ndarray, np.ndarray]:
        q = 1 / (1 + np.exp(-total))
        return y - q, np.maximum(q * (1 - q), 1e-6)

    for _ in range(rounds):
        for k in range(f):
            g, h = residual()
            size = len(tables[k])
            step = rate * _shallow_tree(np.bincount(where[k], g, size), np.bincount(where[k], h, size), leaves, ridge)
            tables[k] += step
            total += step[where[k]]
    coarse = [_edges(x[:, k], grid) for k in range(f)]
    cell = [np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(coarse)]

    def on_grid(i: int, j: int):
        g, h = residual()
        shape = (len(coarse[i]) + 1, len(coarse[j]) + 1)
        flat = cell[i] * shape[1] + cell[j]
        return flat, shape, [np.bincount(flat, t, shape[0] * shape[1]).reshape(shape) for t in (g, h)]

    gains = [(_quadrants(*on_grid(i, j)[2], ridge)[1], i, j) for i, j in itertools.combinations(range(f), 2)]
    chosen = [(i, j) for gain, i, j in sorted(gains, key=lambda t: (-t[0], t[1:]))[:pairs] if gain > 0]
    pair_tables = {}
    for _ in range(rounds // 5):
        for i, j in chosen:
            flat, shape, (g, h) = on_grid(i, j)
            step = rate * _quadrants(g, h, ridge)[0]
            pair_tables[i, j] = pair_tables.get((i, j), 0) + step
            total += step.ravel()[flat]
    return Gam(intercept, edges, tables, [(i, j, coarse[i], coarse[j], t) for (i, j), t in pair_tables.items()])


def held_out(c: str | Column = "doc_id") -> Column:
    """The fold that never teaches: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col(c).cast("string") if isinstance(c, str) else c) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000) -> Gam:
    """Fit on the labelled documents outside the held-out fold: at most ``max_rows`` labels, and as many rows."""
    usable = labels.where("quality IN (0, 1)").select(F.col("doc_id").alias("label_id"), F.col("quality").cast("double").alias("label_q"))
    usable = usable.where(~held_out("label_id")).groupBy("label_id").agg(F.avg("label_q").alias("label_q"))
    usable = usable.orderBy(F.xxhash64("label_id"), "label_id").limit(max_rows)
    texts = docs.select(F.col("doc_id").alias("label_id"), "text").join(F.broadcast(usable), "label_id").select("label_id", "label_q", "text")

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for first, end, data, offsets in pieces(batch.column("text")):
            x = text_features(data, offsets)
            values = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel()))
            part = batch.slice(first, end - first)
            yield pa.RecordBatch.from_arrays([part.column("label_id"), part.column("label_q"), values], ["label_id", "q", "x"])

    features = per_batch(texts, work, "label_id long, q double, x array<double>")
    rows = features.orderBy(F.xxhash64("label_id"), "label_id", "q", "x").limit(max_rows).collect()
    rows.sort(key=lambda r: (r["label_id"], r["q"], r["x"]))
    return fit(np.array([r["x"] for r in rows]), np.array([r["q"] for r in rows]))


def score(docs: DataFrame, model: Gam) -> DataFrame:
    """``docs`` with ``_score`` (replaced if there)."""
    names = [c for c in docs.columns if c != "_score"]
    rows = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(names)])
    text = f"c{names.index('text')}"

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        scores = [model.score(text_features(data, offsets)) for _, _, data, offsets in pieces(batch.column(text))]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(scores))], [*batch.schema.names, "score"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    return per_batch(rows, work, f"{schema}, score double").toDF(*names, "_score")


def accept(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Documents that the model does not reject, with their own columns."""
    rows = plain_names(docs)
    return score(rows, train(docs, labels)).where(F.col("_score") >= threshold).select(*rows.columns).toDF(*docs.columns)
