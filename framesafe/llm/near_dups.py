"""Near-duplicate documents by a chosen-path set similarity join.

A document's set holds the distinct shingles of five words; two documents are linked if the sets'
intersection is at least 75 % of the union. Documents with equal sets form a class first.

* Each of several independent trees sends a class down the paths of its minwise shingles: at the top to
  the node of its smallest shingle under the tree's hash, and from nodes that are too large to the nodes
  of its smallest shingles under ``BRANCHES`` further hashes each. A pair of similarity s shares a leaf of
  one tree with at least s (1 - (1 - s) ** BRANCHES) ** (LEVELS - 1); with s = 0.75 and the defaults the
  trees together miss it with less than 1e-7.
* Leaves are compared exhaustively on sketches (a byte of each minwise value; pairs under ``FLOOR`` are
  at 0.75 with less than 1e-6). Large leaves, of many almost equal documents, are compared in blocks.
* Candidates are confirmed on the full sets. So as not to form all pairs within a group, a first round
  confirms one partner per document; the second takes the full sets of those that still have a possible
  partner in another component to their leaf, finds every link there by one matrix product and returns
  only the links that join components.

Documents without words are linked with nothing. Null text is empty. Rows without ``doc_id`` are linked
with nothing, stay, and have no component. Rows that repeat a ``doc_id`` are one node of the graph.
Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framesafe.session import checkpoint

from .common import Words, byte_strings, components, distinct_in_rows, filter_bits, id_filter, map_batches, may_hold_ids, mix, per_batch, pieces, plain_names, seeds, signed, whole_groups

WORDS, PERCENT = 5, 75
TREES, LEVELS, BRANCHES = 16, 3, 2
LEAF = 64  # a larger node goes down a level
BLOCK = 1024  # of a large leaf; a comparison holds up to two blocks
FLOOR = 0.53
FEW_HOLDERS = 32
SMALL = 16  # larger groups are compared by matrices
HASHES = TREES * (1 + (LEVELS - 1) * BRANCHES)

ROW = "doc_id long, n_shingles int, fp_a long, fp_b long, keys binary"


def _sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each row, their rows and the rows' set sizes."""
    hashes, row = Words(data, offsets).shingles(WORDS)
    hashes, row, _ = distinct_in_rows(hashes, row)
    return hashes, row, np.bincount(row, minlength=len(offsets) - 1)


def sketches(docs: DataFrame) -> DataFrame:
    """Per row: size and fingerprint of the set, and the smallest value of each hash function."""
    factors, offs = seeds(HASHES, 1001), seeds(HASHES, 3001)

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for first, end, data, offsets in pieces(batch.column("text")):
            hashes, _, size = _sets(data, offsets)
            rows, has = end - first, size > 0
            starts = (np.cumsum(size) - size)[has]
            marks = [np.zeros(rows, np.uint64), np.zeros(rows, np.uint64)]
            keys = np.zeros((rows, HASHES), "<u4")
            if len(starts):
                for k, m in enumerate(marks):
                    m[has] = np.add.reduceat(mix(hashes ^ np.uint64(0xA5A5 + k)), starts)
                for k in range(HASHES):
                    keys[has, k] = np.minimum.reduceat(((hashes ^ offs[k]) * factors[k]) >> np.uint64(32), starts)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(first, rows), pa.array(size.astype(np.int32)), pa.array(signed(marks[0])), pa.array(signed(marks[1])),
                 byte_strings(np.full(rows, HASHES * 4), keys.tobytes())],
                ["doc_id", "n_shingles", "fp_a", "fp_b", "keys"],
            )

    return per_batch(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), work, ROW)


def _keys(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u4").reshape(-1, HASHES)


def _leaves(classes: DataFrame) -> DataFrame:
    """``node, id, size`` of the leaves with at least two classes."""

    def top(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        keys, ids = _keys(batch.column("keys")), batch.column("id")
        for t in range(TREES):
            node = mix(keys[:, t].astype(np.uint64) * np.uint64(TREES) + np.uint64(t))
            yield pa.RecordBatch.from_arrays([pa.array(signed(node)), pa.array(np.full(len(node), t, np.int32)), ids], ["node", "tree", "id"])

    entries = per_batch(classes.select("id", "keys"), top, "node long, tree int, id long")
    found = None
    for level in range(1, LEVELS + 1):
        counts = checkpoint(entries.groupBy("node").agg(F.count("*").alias("size")).where("size > 1"))
        shared = entries.join(counts, "node")
        last = level == LEVELS
        leaves = (shared if last else shared.where(F.col("size") <= LEAF)).select("node", "id", "size")
        found = leaves if found is None else found.union(leaves)
        if last or counts.where(F.col("size") > LEAF).isEmpty():
            break
        base = TREES + TREES * BRANCHES * (level - 1)

        def down(batch: pa.RecordBatch, base=base) -> Iterator[pa.RecordBatch]:
            keys, ids = _keys(batch.column("keys")), batch.column("id")
            node, tree = batch.column("node").to_numpy().view(np.uint64), batch.column("tree").to_numpy()
            for b in range(BRANCHES):
                key = keys[np.arange(len(node)), base + tree * BRANCHES + b].astype(np.uint64)
                child = mix(node ^ mix(key * np.uint64(BRANCHES) + np.uint64(b + 1)))
                yield pa.RecordBatch.from_arrays([pa.array(signed(child)), batch.column("tree"), ids], ["node", "tree", "id"])

        large = shared.where(F.col("size") > LEAF).select("node", "tree", "id").join(classes.select("id", "keys"), "id")
        entries = checkpoint(per_batch(large.select("node", "tree", "id", "keys"), down, "node long, tree int, id long"))
    return found


def _compared(batches: Iterator[pa.RecordBatch]):
    """Per table of whole blocks: the table, its groups, ids, and pairs of rows (upper, lower) that the sketches leave possible."""
    for t, group in whole_groups(batches, ["node", "block"]):
        ids, comp, n, rest = (t.column(c).to_numpy() for c in ("id", "comp", "n", "rest"))
        sketch = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint8).reshape(-1, HASHES)

        def fit(x: np.ndarray, y: np.ndarray, comp=comp, n=n, rest=rest, ids=ids) -> np.ndarray:
            apart = (comp[x] != comp[y]) & (rest[x] | rest[y]) & (ids[x] != ids[y])
            return apart & (np.minimum(n[x], n[y]) * 100 >= np.maximum(n[x], n[y]) * PERCENT)

        def pairs(group=group, rest=rest, sketch=sketch, fit=fit) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            first, size = np.unique(group, return_index=True, return_counts=True)[1:]
            few = np.flatnonzero(np.repeat(size <= SMALL, size))  # small groups: all of a distance together
            for d in range(1, SMALL):
                x = few[few + d < len(group)]
                x = x[group[x] == group[x + d]]
                if not len(x):
                    break
                x = x[fit(x, x + d)]
                x = x[(sketch[x] == sketch[x + d]).sum(1) >= FLOOR * HASHES]
                yield x, x + d
            for at, m in zip(first[size > SMALL], size[size > SMALL]):  # large ones: a count matrix, some rows at a time
                every, columns = np.arange(at, at + m), np.ascontiguousarray(sketch[at : at + m].T)
                mine = every[rest[every]]
                for k in range(0, len(mine), 512):
                    rows = mine[k : k + 512]
                    same = np.zeros((len(rows), m), np.uint8)
                    for column in columns:
                        same += column[rows - at, None] == column[None, :]
                    a, b = np.nonzero(same >= FLOOR * HASHES)
                    a, b = rows[a], every[b]
                    x, y = np.minimum(a, b), np.maximum(a, b)
                    good = (x < y) & fit(x, y)
                    yield x[good], y[good]

        yield t, ids, pairs()


def _dealt(members: DataFrame) -> DataFrame:
    return members.repartition("node", "block").sortWithinPartitions("node", "block", "id")


def _first_partners(members: DataFrame) -> DataFrame:
    """Pairs ``a < b``: for each class of a block its smallest possible partner."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, ids, pairs in _compared(batches):
            none = len(ids)
            low, up = np.full(none, none), np.full(none, none)
            for x, y in pairs:
                np.minimum.at(low, y, x)
                np.minimum.at(up, x, y)
            has = low < none
            only = ~has & (up < none)
            a, b = np.r_[ids[low[has]], ids[only]], np.r_[ids[has], ids[up[only]]]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    return map_batches(_dealt(members), work, "a long, b long").distinct()


def _still_open(members: DataFrame) -> DataFrame:
    """``node, block, id, comp`` of the classes that have a possible partner of another component in their block."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, ids, pairs in _compared(batches):
            active = np.zeros(len(ids), bool)
            for x, y in pairs:
                active[x] = active[y] = True
            yield from t.select(["node", "block", "id", "comp"]).filter(pa.array(active)).combine_chunks().to_batches()

    return map_batches(_dealt(members), work, "node long, block int, id long, comp long").distinct()


def _links_of_blocks(active: DataFrame, sets: DataFrame) -> DataFrame:
    """``a, b``: confirmed links that join components, one for each join within a block.

    The intersections of all pairs of a block are one product of its 0/1 matrix of documents and shared shingles.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, group in whole_groups(batches, ["node", "block"], 2000):
            out: list[tuple[int, int]] = []
            all_ids, all_comps = t.column("id").to_numpy(), t.column("comp").to_numpy()
            lists = t.column("shingles").combine_chunks()
            cuts = np.flatnonzero(np.r_[True, group[1:] != group[:-1], True])
            for lo, hi in zip(cuts, cuts[1:]):
                part = lists.slice(lo, hi - lo)
                sizes = part.value_lengths().to_numpy()
                both = _intersections(part.flatten().to_numpy(), sizes)
                wide = sizes.astype(np.int64)
                ids, comp = all_ids[lo:hi], np.unique(all_comps[lo:hi], return_inverse=True)[1]
                for k in range(hi - lo):
                    linked = both[k, :k] * 100 >= (wide[k] + wide[:k] - both[k, :k]) * PERCENT
                    for m in np.flatnonzero(linked & (comp[:k] != comp[k])):
                        if comp[m] != comp[k]:
                            out.append((int(ids[k]), int(ids[m])))
                            comp[comp == comp[m]] = comp[k]
            if out:
                a, b = np.array(out).T
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    joined = active.join(sets, "id").select("node", "block", "id", "comp", "shingles")
    dealt = joined.repartition("node", "block").sortWithinPartitions("node", "block", "id")
    return map_batches(dealt, work, "a long, b long").distinct()


def _intersections(shingles: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets: pairs are listed for shingles of few holders, others multiplied.

    Three matrices of the sets' number squared, of four bytes each, are all that it holds besides its input.
    """
    m = len(sizes)
    _, column, times = np.unique(shingles, return_inverse=True, return_counts=True)
    order = np.argsort(column, kind="stable")
    row, column = np.repeat(np.arange(m), sizes)[order], column[order]
    holders = times[column]
    few = (holders > 1) & (holders <= FEW_HOLDERS)
    r, c = row[few], column[few]
    both = np.zeros(m * m, np.int32)
    for d in range(1, min(FEW_HOLDERS, len(r))):
        pair = np.flatnonzero(c[d:] == c[:-d])
        if not len(pair):
            break
        code, n = np.unique(r[pair] * m + r[pair + d], return_counts=True)
        both[code] += n
    both = both.reshape(m, m)
    both += both.T
    many = holders > FEW_HOLDERS
    r, c = row[many], np.unique(column[many], return_inverse=True)[1]
    width = max(1, (1 << 22) // m)
    for at in range(0, int(c.max()) + 1 if len(c) else 0, width):
        lo, hi = np.searchsorted(c, [at, at + width])
        held = np.zeros((m, min(width, int(c[-1]) + 1 - at)), np.float32)
        held[r[lo:hi], c[lo:hi] - at] = 1
        np.add(both, held @ held.T, out=both, casting="unsafe")
    return both


def _confirm(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    joined = pairs.join(right, "b").join(left, "a").select("a", "b", both.alias("both"), (F.size("sa") + F.size("sb")).alias("total"))
    return joined.where(F.col("both") * 100 >= (F.col("total") - F.col("both")) * PERCENT).select("a", "b")


def _full_sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``id, shingles`` for documents among ``ids`` (told by a bit map, so that no text is shuffled)."""
    bits = filter_bits(ids.count())
    bitmap = id_filter(ids, "id", bits)

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        mine = may_hold_ids(bitmap.value, batch.column("doc_id").to_numpy(), bits)
        if not mine.any():
            return
        batch = batch.filter(pa.array(mine))
        for first, end, data, offsets in pieces(batch.column("text")):
            hashes, _, size = _sets(data, offsets)
            cuts = np.zeros(len(size) + 1, np.int32)
            np.cumsum(size, out=cuts[1:])
            shingles = pa.ListArray.from_arrays(pa.array(cuts), pa.array(signed(hashes)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, end - first), shingles], ["id", "shingles"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id IS NOT NULL AND length(text) > 0")
    return per_batch(texts, work, "id long, shingles array<long>")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs``."""
    rows = checkpoint(sketches(docs))
    marks = ["fp_a", "fp_b", "n_shingles"]
    known = rows.where("doc_id IS NOT NULL AND n_shingles > 0")
    classes = checkpoint(known.groupBy(*marks).agg(F.min("doc_id").alias("id"), F.first("keys").alias("keys")))
    leaves = checkpoint(_leaves(classes))

    sketch_of = classes.select("id", F.col("n_shingles").alias("n"), "keys")

    def narrow(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        low = (_keys(batch.column("keys")) & 0xFF).astype(np.uint8)
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("n"), byte_strings(np.full(len(low), HASHES), low.tobytes())], ["id", "n", "sketch"])

    grouped = leaves.select("id").distinct()
    sketch = checkpoint(per_batch(sketch_of.join(grouped, "id", "left_semi"), narrow, "id long, n int, sketch binary"))
    members = leaves.join(sketch, "id")
    n_blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    home = F.pmod(F.xxhash64("id", "node"), n_blocks).cast("int")

    # first round: one partner each, large leaves within their blocks
    alone = members.withColumns({"comp": F.col("id"), "rest": F.lit(True), "block": home})
    pairs = checkpoint(_first_partners(alone))
    both_ends = pairs.select(F.explode(F.array("a", "b")).alias("id"))
    involved = checkpoint(both_ends.union(leaves.where(F.col("size") > BLOCK).select("id")).distinct())
    sets = checkpoint(_full_sets(docs, involved))
    edges = checkpoint(_confirm(pairs, sets))
    groups = components(edges)

    # second round: classes outside their node's largest component against all of the node, block by block
    placed = members.join(groups.withColumnRenamed("node", "id"), "id", "left").withColumn("comp", F.coalesce("component", "id")).drop("component")
    sizes = placed.groupBy("node", "comp").agg(F.count("*").alias("c"))
    main = sizes.groupBy("node").agg(F.count("*").alias("comps"), F.max_by("comp", F.struct("c", "comp")).alias("main"), (F.sum("c") - F.max("c")).alias("rests"))
    open_ = placed.join(checkpoint(main.where("comps > 1")), "node").withColumn("rest", F.col("comp") != F.col("main"))
    across = F.ceil(F.col("rests") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("node", "id"), across).cast("int")
    as_member = F.transform(F.sequence(F.lit(0), across - 1), lambda j: home * across + j)
    as_rest = F.transform(F.sequence(F.lit(0), n_blocks - 1), lambda i: i * across + own)
    blocks = F.when(F.col("size") <= BLOCK, F.array(F.lit(0))).when(F.col("rest"), F.array_union(as_member, as_rest)).otherwise(as_member)
    dealt = open_.select("node", "id", "n", "sketch", "comp", "rest", F.explode(blocks).alias("block"))
    more = checkpoint(_links_of_blocks(checkpoint(_still_open(dealt)), sets))
    if not more.isEmpty():
        groups = components(edges.union(more))

    of_class = classes.select(*marks, "id").join(groups.withColumnRenamed("node", "id"), "id", "left")
    of_class = checkpoint(of_class.select(*marks, F.coalesce("component", "id").alias("component_id")))
    empty = rows.where("doc_id IS NULL OR n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    result = known.join(of_class, marks).select("doc_id", "n_shingles", "component_id").union(empty)
    return result.select("doc_id", F.col("n_shingles").cast("long").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` without the documents that a smaller ``doc_id`` of their component replaces."""
    gone = near_duplicates(docs).where(~F.col("kept")).select(F.col("doc_id").alias("_gone_id")).distinct()
    rows = plain_names(docs)
    return rows.join(gone, rows.doc_id.cast("long") == F.col("_gone_id"), "left_anti").toDF(*docs.columns)
