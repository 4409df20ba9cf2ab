"""Prefix trie of conversations, with subtree totals by time-forward processing.

Every distinct sequence of first turns is a node. A node's key is the exclusive or of 128-bit hashes of its turns,
each with its depth, so prefixes of one conversation are a running value that may be cut anywhere.

1. Turns are numbered, and keys run, within stretches of ``band`` turns of a conversation; a row per stretch carries
   count and key from one to the next. A conversation of any length is spread over tasks.
2. Rows are added up to nodes on the map side. A node with more than ``max(least_heavy, members / 1000)`` members is
   heavy; the bound makes them few. The trie is cut into fragments: a heavy node by itself, what hangs below a heavy
   node, and what starts a band of depths. A fragment so has bounded members and depth.
3. Within shards (the fragments that a task gets by hash) nodes come in reverse level order from Spark's external sort;
   each takes its children's messages from a priority queue, adds its own value and sends the sum to its parent.
   The queue writes sorted runs to scratch files of its task when it is full, and merges them as it is read.
4. Across shard roots the same sweep runs over the fragments that have others below them: at most one for each heavy
   node and each band of a long path; all other fragments are summed by parent before.
5. Fragments that have others below are swept once more, with the totals that reach each of their nodes.

Ids of conversations that end at a node are joined into blocks by ranges of ids first, so that the digest of a node
where very many end is a stream over blocks.

Results: null roles and texts count as empty; rows with a null ``conv_id`` take no part; null turns come first; equal
turns are ordered by role, then by the hash of the text (equal rows in any order, which changes nothing). An empty
table has no nodes. Columns other than ``conv_id, turn, role, text`` are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import pickle
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framesafe.session import maybe_broadcast, spread

from .common import stored

BAND = 1024
LEAST_HEAVY = 64
QUEUE_ENTRIES = 1 << 18
ID_BLOCK_BITS = 12  # ids of a block differ in these bits only
HEAVY_BROADCAST = 200_000
NOTHING = hashlib.sha256(b"").hexdigest()
NODE = ["depth", "k1", "k2"]


def fork_length(c: str = "conv_id", cuts: int = 6) -> Column:
    return F.crc32(F.col(c).cast("string").cast("binary")) % cuts


def _own(conversations: DataFrame, band: int) -> DataFrame:
    """Turns by digest, with the stretch of turn numbers that each lies in."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), text.alias("text"),
        F.xxhash64(role, text).alias("t1"), F.xxhash64(F.lit("second"), text, role).alias("t2"), F.length(text).cast("long").alias("chars"),
    )
    return rows.withColumn("stretch", F.coalesce(F.floor(F.col("turn") / band).cast("long"), F.lit(-(1 << 62))))


def _placed(conversations: DataFrame, band: int, cuts: int, hundred: int) -> DataFrame:
    """Turns with their number ``pos`` in their conversation, and how many turns ``base`` the fork took over."""
    rows = _own(conversations, band)
    key = Window.partitionBy("conv_id")
    before = key.orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    carry = rows.groupBy("conv_id", "stretch").agg(F.count("*").alias("n"))
    carry = stored(carry.select("conv_id", "stretch", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("skipped"), F.sum("n").over(key).alias("n")))
    bases = carry.where(F.col("conv_id") % hundred == 0).select(F.col("conv_id").alias("base_id"), F.col("n").alias("base_n")).distinct()
    carry = carry.withColumn("base_id", F.col("conv_id") - F.col("conv_id") % hundred).join(bases, "base_id", "left")
    fork = fork_length(cuts=cuts)
    carry = carry.select("conv_id", "stretch", "skipped", F.least(fork, F.coalesce("base_n", F.lit(0))).alias("base"))
    order = Window.partitionBy("conv_id", "stretch").orderBy(F.col("turn").asc_nulls_first(), "role", "t1", "t2")
    rows = rows.withColumn("at", F.row_number().over(order)).join(carry, ["conv_id", "stretch"])
    return rows.withColumn("pos", F.col("skipped") + F.col("at") - 1)


def forked(conversations: DataFrame, cuts: int = 6, hundred: int = 100, band: int = BAND) -> DataFrame:
    """``conv_id, depth, role, text, t1, t2, chars``: each conversation ``c`` rebuilt from the first ``h`` turns of ``c - c % hundred``
    and its own turns after its first ``h``, where ``h`` is the CRC-32 of ``c`` in decimal modulo ``cuts``.

    ``%`` keeps the sign of ``c``. A conversation whose rebuilt form has no turns has no rows here.
    """
    turns = _placed(conversations, band, cuts, hundred)
    payload = ["role", "text", "t1", "t2", "chars"]
    tail = turns.where(F.col("pos") >= fork_length(cuts=cuts))
    tail = tail.select("conv_id", (F.col("pos") - fork_length(cuts=cuts) + F.col("base") + 1).alias("depth"), *payload)
    heads = turns.where((F.col("conv_id") % hundred == 0) & (F.col("pos") < cuts - 1)).select(F.col("conv_id").alias("base_id"), "pos", *payload)
    ids = members(conversations).withColumn("base_id", F.col("conv_id") - F.col("conv_id") % hundred)
    head = ids.join(heads, "base_id").where(F.col("pos") < fork_length(cuts=cuts)).select("conv_id", (F.col("pos") + 1).alias("depth"), *payload)
    return tail.union(head)


def members(conversations: DataFrame) -> DataFrame:
    return conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id")).distinct()


def _paths(turns: DataFrame, band: int) -> DataFrame:
    """``conv_id, band, depth, k1, k2, g1, g2, chars``: keys of all prefixes, and the hash of each last turn."""
    rows = turns.select(
        "conv_id", F.col("depth").cast("long").alias("depth"), F.floor((F.col("depth") - 1) / band).cast("long").alias("band"),
        F.xxhash64("t1", "t2", "depth").alias("g1"), F.xxhash64("depth", "t2", "t1").alias("g2"), "chars",
    )
    run = Window.partitionBy("conv_id", "band").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("conv_id").orderBy("band").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("conv_id", "band").agg(F.bit_xor("g1").alias("x1"), F.bit_xor("g2").alias("x2"))
    carry = sums.select("conv_id", "band", F.bit_xor("x1").over(before).alias("b1"), F.bit_xor("x2").over(before).alias("b2")).where("band > 0")
    rows = rows.withColumns({"r1": F.bit_xor("g1").over(run), "r2": F.bit_xor("g2").over(run)}).join(carry, ["conv_id", "band"], "left")
    zero = F.lit(0).cast("long")
    return rows.select(
        "conv_id", "band", "depth", F.col("r1").bitwiseXOR(F.coalesce("b1", zero)).alias("k1"), F.col("r2").bitwiseXOR(F.coalesce("b2", zero)).alias("k2"),
        "g1", "g2", "chars",
    )


class SpillingQueue:
    """A priority queue of tuples that keeps at most ``limit`` of them; the rest waits in sorted runs in scratch files.

    A run is read by no other task, and its file has no name: it goes with the task, which starts anew if it is lost.
    """

    BLOCK = 4096

    def __init__(self, limit: int = QUEUE_ENTRIES):
        self.limit, self.heap, self.runs, self.spilled = limit, [], [], 0

    def push(self, entry: tuple) -> None:
        heapq.heappush(self.heap, entry)
        if len(self.heap) > self.limit:
            self._spill()

    def _spill(self) -> None:
        self.heap.sort()
        file = tempfile.TemporaryFile()
        keep = self.limit // 2
        rest = self.heap[keep:]
        for at in range(0, len(rest), self.BLOCK):
            pickle.dump(rest[at : at + self.BLOCK], file, pickle.HIGHEST_PROTOCOL)
        file.seek(0)
        self.spilled += len(rest)
        self.heap = self.heap[:keep]
        run = self._read(file)
        heapq.heappush(self.runs, (next(run), id(run), run))
        if len(self.runs) > 64:  # few open files and block buffers: runs are merged into one
            run = self._merged()
            self.runs = [(next(run), id(run), run)]

    def _merged(self) -> Iterator[tuple]:
        file = tempfile.TemporaryFile()
        block: list[tuple] = []
        runs = self.runs
        while runs:
            head, key, run = runs[0]
            block.append(head)
            follow = next(run, None)
            if follow is None:
                heapq.heappop(runs)
            else:
                heapq.heapreplace(runs, (follow, key, run))
            if len(block) == self.BLOCK or not runs:
                pickle.dump(block, file, pickle.HIGHEST_PROTOCOL)
                block = []
        file.seek(0)
        return self._read(file)

    @staticmethod
    def _read(file) -> Iterator[tuple]:
        with file:
            while True:
                try:
                    block = pickle.load(file)
                except EOFError:
                    return
                yield from block

    def peek(self) -> tuple | None:
        if self.runs and (not self.heap or self.runs[0][0] < self.heap[0]):
            return self.runs[0][0]
        return self.heap[0] if self.heap else None

    def pop(self) -> tuple:
        if self.runs and (not self.heap or self.runs[0][0] < self.heap[0]):
            head, key, run = self.runs[0]
            follow = next(run, None)
            if follow is None:
                heapq.heappop(self.runs)
            else:
                heapq.heapreplace(self.runs, (follow, key, run))
            return head
        return heapq.heappop(self.heap)


SWEPT = "leaves long, saved long"


def _sweep(nodes: DataFrame, shard: list[str], queue_entries: int, parts: int | None = None) -> DataFrame:
    """``nodes`` with their subtree totals ``leaves`` and ``saved`` within what a shard holds of the trie.

    ``nodes`` have ``depth, k1, k2``, their parent ``up_depth, u1, u2`` (null depth: sends nothing), ``own_leaves, own_saved``.
    """
    names = nodes.columns
    spot = [names.index(c) for c in ("depth", "k1", "k2", "up_depth", "u1", "u2", "own_leaves", "own_saved")]
    dealt = spread(nodes, *shard) if parts is None else nodes.repartition(parts)
    src = dealt.sortWithinPartitions(F.desc("depth"), "k1", "k2")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queue = SpillingQueue(queue_entries)
        for batch in batches:
            leaves_out, saved_out = [], []
            for depth, k1, k2, up, u1, u2, leaves, saved in zip(*(batch.column(i).to_pylist() for i in spot)):
                me = (-depth, k1, k2)
                while (head := queue.peek()) is not None and head[:3] == me:
                    queue.pop()
                    leaves += head[3]
                    saved += head[4]
                if up is not None:
                    queue.push((-up, u1, u2, leaves, saved))
                leaves_out.append(leaves)
                saved_out.append(saved)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaves_out, pa.int64()), pa.array(saved_out, pa.int64())], [*batch.schema.names, "leaves", "saved"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in nodes.schema.fields)
    return src.mapInArrow(run, f"{schema}, {SWEPT}")


def _ends(last: DataFrame) -> DataFrame:
    """``depth, k1, k2, ends_sha256`` of the nodes where conversations end."""
    blocks = last.groupBy(*NODE, F.shiftright("conv_id", ID_BLOCK_BITS).alias("block")).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda x: x.cast("string")), ",").alias("ids")  # 2 ** ID_BLOCK_BITS at most
    )

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, sha = None, None
        for batch in batches:
            done = []
            for depth, k1, k2, ids in zip(*(batch.column(c).to_pylist() for c in (*NODE, "ids"))):
                if (depth, k1, k2) == node:
                    sha.update(b",")
                else:
                    if node is not None:
                        done.append((*node, sha.hexdigest()))
                    node, sha = (depth, k1, k2), hashlib.sha256()
                sha.update(ids.encode())
            yield _rows(done)
        if node is not None:
            yield _rows([(*node, sha.hexdigest())])

    def _rows(done: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], k) for i, k in enumerate(kinds)], [*NODE, "ends_sha256"])

    return spread(blocks, "k1", "k2").sortWithinPartitions(*NODE, "block").mapInArrow(digest, "depth long, k1 long, k2 long, ends_sha256 string")


def trie(turns: DataFrame, ids: DataFrame, band: int = BAND, least_heavy: int = LEAST_HEAVY, queue_entries: int = QUEUE_ENTRIES) -> DataFrame:
    """The nodes of the trie of ``turns`` (as ``forked`` gives them) of the conversations ``ids`` (``conv_id``, distinct).

    ``conv_id`` (smallest member), ``depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, k1, k2``.
    """
    zero = F.lit(0).cast("long")
    paths = stored(_paths(turns, band))
    root_rows = ids.select("conv_id", zero.alias("depth"), zero.alias("k1"), zero.alias("k2"))
    every = root_rows.union(paths.select("conv_id", *NODE))
    limit = max(least_heavy, ids.count() // 1000)
    heavy = every.groupBy(*NODE).agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id")).where(F.col("n_convs") > limit)
    heavy = stored(heavy.select(*NODE, F.col("conv_id").alias("heavy_id")))

    # fragments: where the path's last heavy node, its child, or the band starts
    own = heavy.select(*NODE, F.lit(True).alias("is_heavy"))
    below = heavy.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("u1"), F.col("k2").alias("u2"), F.col("heavy_id").alias("up_id"))
    rows = paths.withColumns({"u1": F.col("k1").bitwiseXOR(F.col("g1")), "u2": F.col("k2").bitwiseXOR(F.col("g2"))})
    rows = rows.join(maybe_broadcast(own, HEAVY_BROADCAST), NODE, "left").join(maybe_broadcast(below, HEAVY_BROADCAST), ["depth", "u1", "u2"], "left")
    top = F.when(F.col("is_heavy").isNotNull() | F.col("up_id").isNotNull() | ((F.col("depth") - 1) % band == 0), F.struct(*NODE))
    run = Window.partitionBy("conv_id", "band").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("top", F.last(top, ignorenulls=True).over(run))
    nodes = rows.groupBy(*NODE).agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("chars").alias("chars"), F.max("u1").alias("u1"), F.max("u2").alias("u2"),
        F.max("top").alias("top"), F.max("up_id").alias("up_id"),
    )
    none = F.lit(None).cast("long")
    root = root_rows.groupBy(*NODE).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"))
    root = root.select(*NODE, "conv_id", "n_convs", zero.alias("chars"), none.alias("u1"), none.alias("u2"), F.struct(*NODE).alias("top"), none.alias("up_id"))
    nodes = stored(nodes.union(root))

    # children, and the parent's smallest member and fragment; a heavy parent is known already, any other has few children
    children = nodes.where("u1 IS NOT NULL").groupBy(F.col("u1").alias("k1"), F.col("u2").alias("k2")).agg(F.count("*").alias("n_children"))
    parents = nodes.select(F.col("k1").alias("u1"), F.col("k2").alias("u2"), F.col("conv_id").alias("p_id"), F.col("top").alias("p_top"))
    known = nodes.where("up_id IS NOT NULL OR u1 IS NULL").select(
        "*", F.col("up_id").alias("p_id"), F.when(F.col("u1").isNotNull(), F.struct((F.col("depth") - 1).alias("depth"), F.col("u1").alias("k1"), F.col("u2").alias("k2"))).alias("p_top")
    )
    other = nodes.where("up_id IS NULL AND u1 IS NOT NULL").join(parents, ["u1", "u2"])
    nodes = known.unionByName(other).join(children, ["k1", "k2"], "left")
    is_top = F.col("top") == F.struct(*NODE)
    nodes = stored(
        nodes.select(
            *NODE, F.when(~is_top, F.col("depth") - 1).alias("up_depth"), "u1", "u2", "top", "p_top", is_top.alias("is_top"), "conv_id", F.col("p_id").alias("parent_conv_id"), "n_convs",
            F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), F.col("n_children").isNull().cast("long").alias("own_leaves"),
            ((F.col("n_convs") - 1) * F.col("chars")).alias("own_saved"),
        ).withColumns({"t1": F.col("top.k1"), "t2": F.col("top.k2")})
    )

    # within shards, then across shard roots
    local = stored(_sweep(nodes, ["t1", "t2"], queue_entries))
    tops = local.where("is_top").select(*NODE, "u1", "u2", "p_top", "leaves", "saved")
    inner = stored(tops.where("p_top IS NOT NULL").select(F.col("p_top.k1").alias("t1"), F.col("p_top.k2").alias("t2")).distinct())
    small_inner = maybe_broadcast(inner, HEAVY_BROADCAST)
    as_top = small_inner.select(F.col("t1").alias("k1"), F.col("t2").alias("k2"))
    outer_tops = tops.join(as_top, ["k1", "k2"], "left_anti")
    sums = [F.sum("leaves").alias("add_leaves"), F.sum("saved").alias("add_saved")]
    below = outer_tops.groupBy(F.col("p_top.k1").alias("k1"), F.col("p_top.k2").alias("k2")).agg(*sums)
    inner_tops = tops.join(as_top, ["k1", "k2"], "left_semi").join(below, ["k1", "k2"], "left").select(
        *NODE, F.col("p_top.depth").alias("up_depth"), F.col("p_top.k1").alias("u1"), F.col("p_top.k2").alias("u2"), F.col("u1").alias("at1"), F.col("u2").alias("at2"),
        (F.col("leaves") + F.coalesce("add_leaves", zero)).alias("own_leaves"), (F.col("saved") + F.coalesce("add_saved", zero)).alias("own_saved"),
    )
    across = _sweep(inner_tops, [], queue_entries, parts=1).select(F.col("at1").alias("u1"), F.col("at2").alias("u2"), "leaves", "saved")
    reach = outer_tops.select("u1", "u2", "leaves", "saved").union(across).where("u1 IS NOT NULL")
    reach = reach.groupBy(F.col("u1").alias("k1"), F.col("u2").alias("k2")).agg(*sums)

    # what hangs below a fragment reaches its nodes
    again = nodes.join(small_inner, ["t1", "t2"], "left_semi").join(reach, ["k1", "k2"], "left")
    again = again.withColumns({"own_leaves": F.col("own_leaves") + F.coalesce("add_leaves", zero), "own_saved": F.col("own_saved") + F.coalesce("add_saved", zero)})
    again = _sweep(again.select(*nodes.columns), ["t1", "t2"], queue_entries)
    final = local.join(small_inner, ["t1", "t2"], "left_anti").unionByName(again)
    last = every.groupBy("conv_id").agg(F.max(F.struct(*NODE)).alias("n")).select("conv_id", "n.*")
    return final.join(_ends(last), NODE, "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(NOTHING)).alias("ends_sha256"), "k1", "k2",
    )


def forked_trie(conversations: DataFrame, cuts: int = 6, hundred: int = 100, band: int = BAND, **how) -> DataFrame:
    """The trie of the rebuilt conversations (see ``forked`` and ``trie``)."""
    return trie(forked(conversations, cuts, hundred, band), members(conversations), band=band, **how)


def node_texts(nodes: DataFrame, turns: DataFrame) -> DataFrame:
    """``nodes`` with the ``role`` and ``text`` of their last turn (null at the root)."""
    last = turns.select("conv_id", "depth", "role", "text")
    return nodes.join(last, ["conv_id", "depth"], "left")
