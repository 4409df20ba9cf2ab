"""Byte-level BPE encoding and decoding by merge ranks, with segment trees over byte positions.

Each distinct pretoken is a row of byte positions. A segment tree over the positions holds the leftmost
minimum rank of the pairs of live neighbours; a merge takes the root's pair, joins the two positions and
updates the three leaves it touches, together along their paths to the root. The trees of many pretokens are
levels of flat numpy arrays and step together, so that a step costs a few vectorised operations for all.

Texts are cut where a single space stands between two other characters: a pretoken holds a space only at
its start, so such cuts never divide one. A worker keeps the ids of parts and of their pretokens in a cache of
bounded size, whose content changes the speed only: when half of it is full, it becomes the older half, from
which only what is used again comes back. Texts with other white space next to a space are split by the
pattern as a whole.

Null and empty texts have no tokens and decode to nothing. Repeated rows are encoded alike. Extra columns
pass through ``encode`` unchanged.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import PIECE_BYTES, per_batch, pieces, runs

CACHE_PARTS = 100_000
NONE = np.int32(np.iinfo(np.int32).max)
TREE_CELLS = 1 << 18  # positions that step together


def read_ranks(path: str) -> list[bytes]:
    """The token bytes of a rank file, by rank. The vocabulary's size is the bound of what tasks hold."""
    tokens: dict[int, bytes] = {}
    with open(path, "rb") as f:
        for line in f:
            if line.strip():
                token, rank = line.split()
                tokens[int(rank)] = base64.b64decode(token)
    if sorted(tokens) != list(range(len(tokens))):
        raise ValueError(f"{path}: ranks are not 0 to {len(tokens) - 1}")
    return [tokens[i] for i in range(len(tokens))]


RARE_SPACE = [c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"]
_beside_space = re.compile(r" \s|\s ").search


def _mixed_space(text: str) -> bool:
    """Whether white space stands next to a space."""
    if "  " in text or " \n" in text or "\n " in text:
        return True
    return any(c in text for c in RARE_SPACE) and _beside_space(text) is not None


class Bpe:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, tokens: list[bytes], pattern: str):
        self.tokens = tokens
        self.token_bytes = np.array(tokens, object)
        self.rank = {t: i for i, t in enumerate(tokens)}
        self.find = regex.compile(pattern).findall
        self.bytes_rank = np.array([self.rank.get(bytes([b]), -1) for b in range(256)], np.int64)
        if (self.bytes_rank < 0).any():
            raise ValueError("the vocabulary lacks single bytes")
        pairs = {}
        for i, t in enumerate(tokens):
            for cut in range(1, len(t)):
                a, b = self.rank.get(t[:cut]), self.rank.get(t[cut:])
                if a is not None and b is not None:
                    pairs[(a << 32) | b] = i
        self.pair_keys = np.array(sorted(pairs), np.int64)
        self.pair_rank = np.array([pairs[k] for k in self.pair_keys.tolist()], np.int32)
        self.byte_pairs = self._ranks(np.repeat(self.bytes_rank, 256), np.tile(self.bytes_rank, 256))
        self.parts: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of the token that each pair makes, or ``NONE``."""
        if not len(self.pair_keys):
            return np.full(len(a), NONE, np.int32)
        key = (a << 32) | b
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_rank[at], NONE)

    def merge(self, words: list[bytes]) -> list[bytes]:
        """Packed token ids of each byte string."""
        out = [b""] * len(words)
        sizes = np.array([len(w) for w in words], np.int64)
        order = np.argsort(sizes, kind="stable")
        order = order[sizes[order] > 0]
        at = 0
        while at < len(order):
            width = 1 << int(sizes[order[at]] - 1).bit_length()
            end = int(np.searchsorted(sizes[order], width, side="right"))
            end = min(end, at + max(1, TREE_CELLS // width))
            group = order[at:end]
            for i, ids in zip(group, self._merge_group([words[i] for i in group], sizes[group], width)):
                out[i] = ids
            at = end
        return out

    def _merge_group(self, words: list[bytes], sizes: np.ndarray, width: int) -> Iterator[bytes]:
        n = len(words)
        cells = n * width  # the position behind the last one stands for no neighbour
        inside = (np.arange(width) < sizes[:, None]).ravel()
        text = np.zeros(cells, np.uint8)
        text[inside] = np.frombuffer(b"".join(words), np.uint8)
        ids = np.full(cells + 1, -1, np.int64)
        ids[:-1][inside] = self.bytes_rank[text[inside]]
        last = np.arange(n) * width + sizes - 1
        after = np.arange(1, cells + 2)  # the next live position
        after[last] = cells
        before = np.arange(-1, cells)
        before[:cells:width] = cells
        # a cell of the tree is (rank, position) in one number, so that the minimum is the leftmost minimum rank
        paired = inside.copy()
        paired[last] = False
        at = np.flatnonzero(paired)
        leaves = np.full(cells + 2, int(NONE) << 32)
        leaves[at] = (self.byte_pairs[(text[at].astype(np.int64) << 8) | text[at + 1]].astype(np.int64) << 32) | at
        levels = [leaves]
        while cells >> len(levels) - 1 > n:
            levels.append(np.full((cells >> len(levels)) + 2, int(NONE) << 32))
            np.minimum(levels[-2][0:-2:2], levels[-2][1:-1:2], out=levels[-1][:-2])

        row = np.arange(n)
        while True:
            root = levels[-1][row]
            live = (root >> 32) < NONE
            row, root = row[live], root[live]
            if not len(row):
                break
            pos = root & 0xFFFFFFFF
            ids[pos] = root >> 32
            gone = after[pos]
            ids[gone] = -1
            follow, prior = after[gone], before[pos]
            after[pos], before[follow] = follow, pos
            joined = ids[pos]
            ranks = self._ranks(np.concatenate([joined, ids[prior]]), np.concatenate([ids[follow], joined]))
            up = np.concatenate([pos, prior, gone])
            leaves[up[: len(ranks)]] = (ranks.astype(np.int64) << 32) | up[: len(ranks)]
            leaves[gone] = int(NONE) << 32
            for below, level in zip(levels, levels[1:]):
                up >>= 1
                level[up] = np.minimum(below[2 * up], below[2 * up + 1])
        left = ids[:-1] >= 0
        flat = ids[:-1][left].astype("<u4").tobytes()
        ends = np.cumsum(left.reshape(n, width).sum(1) * 4).tolist()
        for a, b in zip([0, *ends], ends):
            yield flat[a:b]

    def _learn(self, parts: set[str]) -> None:
        """Put the packed ids of new parts, and of the pretokens that they consist of, into the cache."""
        split = {}
        todo = set()
        for p in parts:
            if p[1:].isalpha() and (p[0] == " " or p[0].isalpha()):
                todo.add(p)
            else:
                split[p] = self.find(p)
        found = set().union(*split.values()).difference(self.parts, todo)
        self.parts.update((x, self.older[x]) for x in found & self.older.keys())
        todo.update(found.difference(self.older))
        merging, words = [], []
        for piece in todo:
            word = piece.encode()
            whole = self.rank.get(word)
            if whole is None:
                merging.append(piece)
                words.append(word)
            else:
                self.parts[piece] = whole.to_bytes(4, "little")
        self.parts.update(zip(merging, self.merge(words)))
        get = self.parts.__getitem__
        for p, found_in in split.items():
            self.parts[p] = b"".join(map(get, found_in))

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        """Packed little-endian ids of each text."""
        cut = []
        for t in texts:
            if not t:
                cut.append([])
            elif _mixed_space(t):
                cut.append(self.find(t))
            else:
                head, *rest = t.split(" ")
                cut.append([head, *[" " + x for x in rest]] if head else [" " + x for x in rest])
        out: list[bytes] = []
        for at in range(0, len(cut), 512):
            group = cut[at : at + 512]
            used = set().union(*group)
            new = used.difference(self.parts)
            if len(self.parts) + len(new) > CACHE_PARTS // 2:  # what is used again comes back from the older half
                self.older, self.parts, new = self.parts, {}, used
            self.parts.update((p, self.older[p]) for p in new & self.older.keys())
            self._learn(new.difference(self.older))
            get = self.parts.__getitem__
            out += [b"".join(map(get, parts)) for parts in group]
        return out

    def decode(self, packed: bytes) -> bytes:
        return b"".join(self.token_bytes[np.frombuffer(packed, "<u4")].tolist())


_in_worker: dict[str, Bpe] = {}


def _bpe(shared) -> Bpe:
    """One encoder per worker and vocabulary, so that its cache lives on between tasks."""
    tokens, pattern, key = shared.value
    if key not in _in_worker:
        _in_worker.clear()
        _in_worker[key] = Bpe(tokens, pattern)
    return _in_worker[key]


def _share(spark: SparkSession, path: str, pattern: str):
    tokens = read_ranks(path)
    key = hashlib.sha256(repr((tokens, pattern)).encode()).hexdigest()
    return spark.sparkContext.broadcast((tokens, pattern, key))


def _texts(batch: pa.RecordBatch, name: str) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    for first, end, _, _ in pieces(batch.column(name)):
        part = batch.slice(first, end - first)
        yield part, part.column(name).to_pylist()


def _with_ids(bpe: Bpe, batch: pa.RecordBatch, text: str) -> Iterator[pa.RecordBatch]:
    for part, texts in _texts(batch, text):
        packed = bpe.encode_batch(texts)
        offsets = np.zeros(len(packed) + 1, np.int32)
        np.cumsum([len(p) // 4 for p in packed], out=offsets[1:])
        values = np.frombuffer(b"".join(packed), "<u4").astype(np.int32)
        ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))
        yield pa.RecordBatch.from_arrays([*part.columns, ids], [*part.schema.names, "ids"])


def _with_bytes(bpe: Bpe, batch: pa.RecordBatch, ids: str) -> Iterator[pa.RecordBatch]:
    sizes = batch.column(ids).value_lengths().fill_null(0).to_numpy()
    for first, end in runs(np.r_[0, np.cumsum(sizes, dtype=np.int64)], PIECE_BYTES // 4):
        part = batch.slice(first, end - first)
        packed, ends = part.column(ids).flatten().to_numpy().astype("<u4"), np.cumsum(sizes[first:end])
        found = [bpe.decode(packed[b - n : b].tobytes()) for b, n in zip(ends, sizes[first:end])]
        yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.binary())], [*part.schema.names, "bytes"])


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``docs`` with ``_ids`` (array of token ids of the whole text); a column of that name is replaced."""
    shared = _share(docs.sparkSession, path, pattern)
    names = [c for c in docs.columns if c != "_ids"]
    rows = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(names)])
    text = f"c{names.index('text')}"

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        return _with_ids(_bpe(shared), batch, text)

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    return per_batch(rows, work, f"{schema}, ids array<int>").toDF(*names, "_ids")


def decode(tokens: DataFrame, path: str, pattern: str, ids: str = "_ids") -> DataFrame:
    """``tokens`` with ``_bytes``, the bytes that the ids stand for (null ids: none)."""
    shared = _share(tokens.sparkSession, path, pattern)
    names = [c for c in tokens.columns if c != "_bytes"]
    rows = tokens.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(names)])
    at = f"c{names.index(ids)}"

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        return _with_bytes(_bpe(shared), batch, at)

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    return per_batch(rows, work, f"{schema}, bytes binary").toDF(*names, "_bytes")


def encode_decode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``docs`` with ``_ids`` and ``_bytes``: ``encode``, then ``decode`` of its ids, by one Python worker for both."""
    shared = _share(docs.sparkSession, path, pattern)
    names = [c for c in docs.columns if c not in ("_ids", "_bytes")]
    rows = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(names)])
    text = f"c{names.index('text')}"

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(shared)
        for part in _with_ids(bpe, batch, text):
            yield from _with_bytes(bpe, part, "ids")

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    return per_batch(rows, work, f"{schema}, ids array<int>, bytes binary").toDF(*names, "_ids", "_bytes")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: encodes, decodes the ids and digests both, in one pass."""
    shared = _share(docs.sparkSession, path, pattern)

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(shared)
        for part, texts in _texts(batch, "text"):
            packed = bpe.encode_batch(texts)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    pa.array([len(p) // 4 for p in packed], pa.int64()),
                    pa.array([hashlib.sha256(p).hexdigest() for p in packed]),
                    pa.array([hashlib.sha256(bpe.decode(p)).hexdigest() for p in packed]),
                ],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return per_batch(docs.select("doc_id", "text"), work, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
