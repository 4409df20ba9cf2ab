"""Byte-level BPE of a tokenizer file, with a minimal transducer of frequent words.

Words are the pieces that the byte-level pre-tokenizer makes; each is encoded by itself.

1. Words of all documents are counted: in the tasks, then by word. The most frequent ones, as many as count at least
   as often as ``lexicon`` words allow, are collected; this bounds what the driver and tasks hold, not what is encoded.
2. They are compiled into the minimal acyclic subsequential transducer: words in byte order, outputs (token ids)
   moved towards the start, equal suffixes shared. Its transitions are packed into one array by row displacement.
3. The packed form is one file, which Spark ships to every executor; its workers map it into memory and share its pages.
4. A task splits its texts by vectorised rules on classes of code points, and walks all words of a piece through the
   transducer at once, a byte a step. Words that it does not hold are merged exactly, by a heap over linked pairs.

The choice of words changes the speed only. Special tokens of the file are found before splitting and keep their ids,
also where a text holds their names by chance; ids beyond the vocabulary decode to nothing, as in the library.

Results: null and empty texts have no tokens and decode to an empty text. Repeated rows are encoded alike. Extra
columns pass through ``encode`` unchanged, whatever their names. An empty table gives an empty table. Texts longer
than a piece are cut before white space that follows a visible ASCII character, where a word always ends.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import PIECE_BYTES, per_batch, pieces, shared_folder, stored

LEXICON = 131_072
LONGEST = 64  # bytes of a word of the lexicon
CACHE_BYTES = 32 << 20
TOGETHER = 64  # bytes of words that are merged many at a time
WAITING = 300_000  # words that a counting task holds
SPACE, LETTER, NUMBER, OTHER, SPECIAL = range(5)


def byte_names() -> dict[str, int]:
    """The character that stands for each byte in the vocabulary: itself where it is printable, else the next one from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """The tokens and merges of a tokenizer file; anything but plain byte-level BPE is refused."""

    def __init__(self, source: str):
        spec = json.loads(source)
        model, pre = spec["model"], spec["pre_tokenizer"] or {}
        plain = {"dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "byte_fallback": False, "ignore_merges": False}
        odd = [k for k, v in plain.items() if (model.get(k) or v) != v]
        steps = (pre.get("type"), pre.get("add_prefix_space"), pre.get("use_regex", True), (spec.get("decoder") or {}).get("type"))
        if model["type"] != "BPE" or odd or spec.get("normalizer") or spec.get("post_processor") or steps != ("ByteLevel", False, True, "ByteLevel"):
            raise ValueError(f"not a plain byte-level BPE file: {steps}, {odd}")
        added = spec.get("added_tokens") or []
        if any(a["single_word"] or a["lstrip"] or a["rstrip"] or re.search(r"\s", a["content"]) for a in added):
            raise ValueError("special tokens with rules for their surroundings")
        names = byte_names()
        vocab = model["vocab"]
        self.specials = {a["content"]: a["id"] for a in added}
        self.tokens = [b""] * (max([*vocab.values(), *self.specials.values()]) + 1)
        for token, i in vocab.items():
            self.tokens[i] = bytes(names[c] for c in token)
        for token, i in self.specials.items():
            self.tokens[i] = token.encode()
        self.of_byte = [-1] * 256
        for c, b in names.items():
            self.of_byte[b] = vocab.get(c, -1)
        if min(self.of_byte) < 0:
            raise ValueError("the vocabulary lacks single bytes")
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            self.merges.setdefault((vocab[a], vocab[b]), (rank, vocab[a + b]))
        pairs = sorted((a << 32 | b, rank) for (a, b), (rank, _) in self.merges.items())
        self.pair_keys = np.array([k for k, _ in pairs], np.int64)
        self.pair_ranks = np.array([r for _, r in pairs], np.int64)
        self.made = np.zeros(len(model["merges"]), np.int64)
        for rank, new in self.merges.values():
            self.made[rank] = new

    def merge(self, word: bytes) -> tuple[int, ...]:
        """The ids of a word: always the lowest-ranked pair, the leftmost of equals, is merged."""
        ids = [self.of_byte[b] for b in word]
        merges = self.merges
        n = len(ids)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(*merges[p], i, *p) for i, p in enumerate(zip(ids, ids[1:])) if p in merges]
        heapq.heapify(heap)
        while heap:
            _, new, i, a, b = heapq.heappop(heap)
            j = after[i] if ids[i] == a else -1
            if j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = new, -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and (found := merges.get((ids[x], ids[y]))):
                    heapq.heappush(heap, (*found, x, ids[x], ids[y]))
        return tuple(i for i in ids if i >= 0)


    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of the merge of each pair, or the number of merges where there is none (``b`` below 0: no pair)."""
        none = len(self.made)
        if not len(self.pair_keys):
            return np.full(len(a), none)
        key = (a << 32) | b
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where((self.pair_keys[at] == key) & (b >= 0), self.pair_ranks[at], none)

    def merge_many(self, words: list[bytes]) -> list[tuple[int, ...]]:
        """``merge`` of many words: those of like length step together, each by its own leftmost lowest pair."""
        out: list[tuple[int, ...]] = [()] * len(words)
        size = np.array([len(w) for w in words], np.int64)
        order = np.argsort(size, kind="stable")
        short = order[(size[order] > 0) & (size[order] <= TOGETHER)]
        for i in order[size[order] > TOGETHER].tolist():
            out[i] = self.merge(words[i])
        of_byte, none = np.array(self.of_byte, np.int64), len(self.made)
        for at in range(0, len(short), 4096):
            group = short[at : at + 4096]
            width = int(size[group[-1]])
            place = np.arange(width)
            ids = np.full((len(group), width), -1, np.int64)
            ids[place < size[group][:, None]] = of_byte[np.frombuffer(b"".join([words[i] for i in group.tolist()]), np.uint8)]
            ranks = np.full(ids.shape, none, np.int64)
            ranks[:, :-1] = self._ranks(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(group), width - 1)
            live = np.arange(len(group))
            while True:
                mine = ranks[live]
                i = mine.argmin(1)
                least = mine[np.arange(len(live)), i]
                go = least < none
                live, i, least, mine = live[go], i[go], least[go], mine[go]
                if not len(live):
                    break
                row = np.arange(len(live))
                ids[live, i] = self.made[least]
                follow = np.minimum(place + (place > i[:, None]), width - 1)  # what stands behind the pair moves up
                new, mine = np.take_along_axis(ids[live], follow, 1), np.take_along_axis(mine, follow, 1)
                new[:, -1], mine[:, -1] = -1, none
                right = new[row, np.minimum(i + 1, width - 1)]
                mine[row, i] = self._ranks(new[row, i], np.where(i + 1 < width, right, -1))
                left = np.flatnonzero(i > 0)
                mine[left, i[left] - 1] = self._ranks(new[left, i[left] - 1], new[left, i[left]])
                ids[live], ranks[live] = new, mine
            counts = (ids >= 0).sum(1).tolist()
            for i, n, found in zip(group.tolist(), counts, ids.tolist()):
                out[i] = tuple(found[:n])
        return out


# -- splitting -------------------------------------------------------------------------------


# The letters and numbers that Unicode 16.0, which the library follows, added to 15.1.
ADDED = [
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D40, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4),
    (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3),
    (0x116D0, 0x116E3), (0x11BC0, 0x11BE0), (0x11BF0, 0x11BF9), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16130, 0x16139), (0x16D40, 0x16D6C),
    (0x16D70, 0x16D79), (0x18CFF, 0x18CFF), (0x1CCF0, 0x1CCF9), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5FA),
]


def _classes() -> np.ndarray:
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    points = lambda chars: np.frombuffer("".join(chars).encode("utf-32-le"), "<u4")
    out = np.full(0x110000, OTHER, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\s")):
        out[points(regex.findall(pattern, every))] = kind
    later = np.zeros(0x110000, bool)  # not yet assigned in the library's tables
    later[points(c for c in every if unicodedata.category(c) == "Cn")] = True
    for a, b in ADDED:
        later[a : b + 1] = False
    out[later] = OTHER
    return out


_tables: dict[str, np.ndarray] = {}


def classes() -> np.ndarray:
    if "classes" not in _tables:
        _tables["classes"] = _classes()
    return _tables["classes"]


def split(points: np.ndarray, edges: np.ndarray, special: np.ndarray | None = None) -> np.ndarray:
    """Where words start. ``edges``: starts of texts (and ends), which every word respects; ``special``: starts and ends of special tokens.

    Runs of letters, of numbers, of other signs, and of white space; a single space goes with what follows; the last
    of several white-space characters stands alone, or goes with what follows if it is a space; English contractions
    after an apostrophe are words.
    """
    n = len(points)
    kind = classes()[points]
    forced = np.zeros(n + 1, bool)
    forced[edges] = True
    if special is not None:
        for a, b in special:
            kind[a:b] = SPECIAL
            forced[[a, b]] = True
    first = np.ones(n + 1, bool)
    first[1:n] = (kind[1:] != kind[:-1]) | forced[1:n]
    start = first.copy()
    # white space before something of the same text
    last = np.flatnonzero((kind == SPACE) & first[1:] & ~forced[1:])
    start[last] = True
    joins = last[points[last] == 0x20]
    start[joins + 1] = False
    # contractions
    quote = np.flatnonzero((points == 0x27) & start[:n] & first[1:] & ~forced[1:])
    if len(quote):
        follow = np.full((len(quote), 2), 0, np.uint32)
        follow[:, 0] = points[quote + 1]
        more = quote + 2 < n
        more[more] = ~forced[quote[more] + 2]
        follow[more, 1] = points[quote[more] + 2]
        one = np.isin(follow[:, 0], [ord(c) for c in "stmd"])
        pair = (follow[:, 0].astype(np.uint64) << np.uint64(32)) | follow[:, 1]
        two = np.isin(pair, np.array([(ord(a) << 32) | ord(b) for a, b in ("re", "ve", "ll")], np.uint64))
        start[quote[one | two] + 1] = False
        start[quote[one] + 2] = True
        start[quote[two] + 3] = True
    return np.flatnonzero(start[:n])


# -- the transducer --------------------------------------------------------------------------


def _common(a: tuple, b: tuple) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


class Transducer:
    """Minimal acyclic subsequential transducer from words in byte order to their ids."""

    def __init__(self) -> None:
        self.known: dict[tuple, int] = {}
        self.states: list[tuple] = []  # (final output or None, ((byte, target, output), ...))

    def build(self, words: list[tuple[bytes, tuple[int, ...]]]) -> Transducer:
        path: list[list] = [[None, []]]  # of the last word: [final output, [[byte, target, output], ...]]
        prior = b""
        for word, out in words:
            if word <= prior and (word or path[0][0] is not None):
                raise ValueError("words must be distinct and in order")
            shared = _common(word, prior)
            self._freeze(path, shared)
            for b in word[shared:]:
                path[-1][1].append([b, -1, ()])
                path.append([None, []])
            path[-1][0] = ()
            for i in range(shared):  # what the words share of their outputs stays in front, the rest moves on
                step = path[i][1][-1]
                same = _common(step[2], out)
                if rest := step[2][same:]:
                    step[2] = step[2][:same]
                    state = path[i + 1]
                    for t in state[1]:
                        t[2] = rest + t[2]
                    if state[0] is not None:
                        state[0] = rest + state[0]
                out = out[same:]
            if len(word) > shared:
                path[shared][1][-1][2] = out
            else:
                path[-1][0] = out
            prior = word
        self._freeze(path, 0)
        self.root = self._register(path[0])
        return self

    def _freeze(self, path: list[list], depth: int) -> None:
        while len(path) > depth + 1:
            state = path.pop()
            path[-1][1][-1][1] = self._register(state)

    def _register(self, state: list) -> int:
        key = (state[0], tuple(map(tuple, state[1])))
        if key not in self.known:
            self.known[key] = len(self.states)
            self.states.append(key)
        return self.known[key]

    def packed(self) -> bytes:
        """One block of 32-bit numbers: sizes, then per state its base and final output, per slot its owner, target and output, then the outputs."""
        outputs: dict[tuple, int] = {}
        ref = lambda o: outputs.setdefault(o, len(outputs))
        ref(())
        owner: list[int] = [-1] * 1024
        base = [0] * len(self.states)
        start = 256  # no base is negative
        by_size = sorted(range(len(self.states)), key=lambda s: -len(self.states[s][1]))
        for s in by_size:  # states with several transitions: the first place that fits, not searched for long
            used = [t[0] for t in self.states[s][1]]
            if len(used) < 2:
                break
            at, tries = start, 0
            while owner[at] >= 0 or any(owner[at - used[0] + b] >= 0 for b in used):
                at += 1
                tries += 1
                if at + 512 > len(owner):
                    owner += [-1] * len(owner)
            if tries > 200:
                start = at - 100
            base[s] = at - used[0]
            for b in used:
                owner[base[s] + b] = s
        at = 256
        for s in by_size:  # all others fill the gaps
            if len(self.states[s][1]) == 1:
                while owner[at] >= 0:
                    at += 1
                    if at + 512 > len(owner):
                        owner += [-1] * len(owner)
                owner[at] = s
                base[s] = at - self.states[s][1][0][0]
        slots = max((i for i, o in enumerate(owner) if o >= 0), default=-1) + 257
        own = np.array((owner + [-1] * 257)[:slots], "<i4")
        target, out = np.zeros(slots, "<i4"), np.zeros(slots, "<i4")
        final = np.full(len(self.states), -1, "<i4")
        for s, (last, steps) in enumerate(self.states):
            if last is not None:
                final[s] = ref(last)
            for b, t, o in steps:
                target[base[s] + b], out[base[s] + b] = t, ref(o)
        sizes = np.array([len(o) for o in outputs], "<i4")
        ids = np.array([i for o in outputs for i in o], "<i4")
        head = np.array([len(self.states), slots, len(sizes), len(ids), self.root], "<i4")
        return b"".join(x.tobytes() for x in (head, np.array(base, "<i4"), final, own, target, out, sizes, ids))


class Lexicon:
    """A packed transducer, mapped from its file (or from bytes)."""

    def __init__(self, source: str | bytes):
        block = np.frombuffer(source, "<i4") if isinstance(source, bytes) else np.memmap(source, "<i4", "r")
        states, slots, outputs, ids, self.root = block[:5].tolist()
        ends = np.cumsum([5, states, states, slots, slots, slots, outputs, ids])
        self.base, self.final, self.owner, self.target, self.out, self.size, self.ids = (block[a:b] for a, b in zip(ends, ends[1:]))
        self.begin = np.cumsum(self.size) - self.size

    def walk(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
        """Which words it holds, how many ids each has, and the outputs met: words, places among their ids, outputs."""
        n = len(starts)
        held, count = np.zeros(n, bool), np.zeros(n, np.int64)
        met: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def note(words: np.ndarray, outputs: np.ndarray) -> None:
            says = np.flatnonzero(outputs > 0)
            if len(says):
                words, outputs = words[says], outputs[says]
                met.append((words, count[words], outputs))
                count[words] += self.size[outputs]

        word, state, at = np.arange(n), np.full(n, self.root, np.int64), starts.copy()
        while len(word):
            done = at == ends[word]
            if done.any():
                over, last = word[done], self.final[state[done]]
                held[over] = last >= 0
                note(over[last >= 0], last[last >= 0])
                word, state, at = word[~done], state[~done], at[~done]
            slot = self.base[state] + data[at]
            on = np.flatnonzero(self.owner[slot] == state)
            if len(on) < len(word):
                word, slot, at = word[on], slot[on], at[on]
            note(word, self.out[slot])
            state, at = self.target[slot].astype(np.int64), at + 1
        return held, count, met


def _ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """``begin[i], begin[i] + 1, ...``: ``size[i]`` numbers each, one after the other."""
    ends = np.cumsum(size)
    return np.repeat(begin - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)


def _packed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Words of at most 7 bytes as one number each: their bytes and their length."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    window = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    size = (ends - starts).astype(np.uint64)
    return (window[starts] & ((np.uint64(1) << (size * np.uint64(8))) - np.uint64(1))) | (size << np.uint64(56))


def _distinct(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words that stand for all equal ones (short words; others stand for themselves), and the number of each word's among them."""
    short = (ends - starts <= 7) & (token < 0)
    at, rest = np.flatnonzero(short), np.flatnonzero(~short)
    _, first, which = np.unique(_packed(data, starts[at], ends[at]), return_index=True, return_inverse=True)
    out = np.empty(len(starts), np.int64)
    out[at] = which
    out[rest] = np.arange(len(first), len(first) + len(rest))
    return np.concatenate([at[first], rest]), out


class Encoder:
    def __init__(self, vocabulary: Vocabulary, lexicon: Lexicon):
        self.vocabulary, self.lexicon = vocabulary, lexicon
        self.special = re.compile("|".join(map(re.escape, sorted(vocabulary.specials, key=len, reverse=True)))) if vocabulary.specials else None
        self.seen: dict[bytes, tuple[int, ...]] = {}
        self.seen_bytes = 0
        self.token_sizes = np.array([len(t) for t in vocabulary.tokens], np.int64)
        self.token_ends = np.cumsum(self.token_sizes)
        self.token_bytes = np.frombuffer(b"".join(vocabulary.tokens), np.uint8)

    def _unseen(self, words: list[bytes]) -> list[tuple[int, ...]]:
        """The ids of words that the lexicon does not hold; the last ones merged are remembered."""
        new = list(dict.fromkeys(w for w in words if w not in self.seen))
        if new:
            merged = self.vocabulary.merge_many(new)
            weight = lambda pairs: sum(150 + 2 * len(w) + 36 * len(m) for w, m in pairs)
            if self.seen_bytes + weight(zip(new, merged)) > CACHE_BYTES:
                self.seen = {w: self.seen[w] for w in words if w in self.seen}
                self.seen_bytes = weight(self.seen.items())
            self.seen_bytes += weight(zip(new, merged))
            self.seen.update(zip(new, merged))
        return [self.seen[w] for w in words]

    def words(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Byte ranges of the words of the texts of a piece, and the id of each that is a special token (else -1)."""
        text = data.tobytes().decode()
        points = np.frombuffer(text.encode("utf-32-le"), "<u4")
        at = np.zeros(len(points) + 1, np.int64)
        np.cumsum(1 + (points >= 0x80) + (points >= 0x800).astype(np.int64) + (points >= 0x10000), out=at[1:])
        edges = np.searchsorted(at, offsets)
        special, names = [], []
        if self.special and self.special.search(text):
            bounds = edges.tolist()
            for a, b in zip(bounds, bounds[1:]):
                for m in self.special.finditer(text, a, b):
                    special.append(m.span())
                    names.append(self.vocabulary.specials[m.group()])
        starts = split(points, edges, special or None)
        ends = np.append(starts[1:], len(points)) if len(starts) else starts
        token = np.full(len(starts), -1, np.int64)
        if special:
            token[np.searchsorted(starts, [a for a, _ in special])] = names
        return at[starts], at[ends], token

    def encode_piece(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts of a piece, and the ``rows + 1`` offsets of the texts among them."""
        every, every_end, token = self.words(data, offsets)
        own, which = _distinct(data, every, every_end, token)
        starts, ends, token = every[own], every_end[own], token[own]
        held, count, met = self.lexicon.walk(data, starts, ends)
        held &= token < 0
        lone = np.flatnonzero(~held)
        raw, plain = data.tobytes(), token[lone].tolist()
        merged = self._unseen([raw[a:b] for a, b in zip(starts[lone].tolist(), ends[lone].tolist())])
        merged = [m if t < 0 else (t,) for m, t in zip(merged, plain)]
        count[lone] = [len(m) for m in merged]
        begin_own = np.cumsum(count) - count
        ids = np.zeros(count.sum(), np.int32)
        lex = self.lexicon
        for words, place, outputs in met:
            keep = held[words]
            to, outputs = (begin_own[words] + place)[keep], outputs[keep]
            begin, size = lex.begin[outputs], lex.size[outputs]
            for k in range(int(size.max(initial=0))):
                has = size > k
                ids[to[has] + k] = lex.ids[begin[has] + k]
        if len(lone):
            ids[_ranges(begin_own[lone], count[lone])] = [i for m in merged for i in m]
        size = count[which]
        first = np.zeros(len(every) + 1, np.int64)
        np.cumsum(size, out=first[1:])
        return ids[_ranges(begin_own[which], size)], first[np.searchsorted(every, offsets)]

    def encode_texts(self, column: pa.Array, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """Runs of rows: first row, end row, ids, offsets of the rows among them."""
        for a, b, data, offsets in pieces(column, limit):
            if b - a == 1 and len(data) > 2 * limit:
                parts = [self.encode_piece(data[x:y], np.array([0, y - x]))[0] for x, y in _stretches(data, limit)]
                ids = np.concatenate(parts)
                yield a, b, ids, np.array([0, len(ids)])
            else:
                yield a, b, *self.encode_piece(data, offsets)

    def bytes_of(self, ids: np.ndarray) -> bytes:
        ids = ids[(ids >= 0) & (ids < len(self.token_sizes))]
        size = self.token_sizes[ids]
        return self.token_bytes[_ranges(self.token_ends[ids] - size, size)].tobytes()

    def decode(self, ids: np.ndarray) -> str:
        return self.bytes_of(ids).decode("utf-8", "replace")


def _stretches(data: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    start = 0
    while start < len(data):
        end, look = len(data), start + limit
        while look < len(data):
            block = data[look - 1 : look + limit]
            cut = np.flatnonzero(((block[1:] == 0x20) | (block[1:] == 0x0A)) & (block[:-1] > 0x20) & (block[:-1] < 0x7F))
            if len(cut):
                end = look + int(cut[0])
                break
            look += limit
        yield start, end
        start = end


# -- Spark -----------------------------------------------------------------------------------


def count_words(docs: DataFrame, vocabulary) -> DataFrame:
    """``word, n`` of the words of all texts, up to ``LONGEST`` bytes each. ``vocabulary`` is a broadcast one."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _Worker.get(vocabulary, None)
        total: dict[bytes, int] = {}

        def rows() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()), pa.array(list(total.values()), pa.int64())], ["word", "n"])
            total.clear()
            return out

        for batch in batches:
            for _, _, data, offsets in pieces(batch.column(0)) if batch.num_rows else ():
                for x, y in _stretches(data, PIECE_BYTES) if len(offsets) == 2 else [(0, len(data))]:
                    part = data[x:y]
                    starts, ends, token = encoder.words(part, offsets if len(offsets) > 2 else np.array([0, y - x]))
                    use = (token < 0) & (ends - starts <= LONGEST)
                    starts, ends = starts[use], ends[use]
                    own, which = _distinct(part, starts, ends, token[use])
                    at, n = own, np.bincount(which, minlength=len(own))
                    raw = part.tobytes()
                    for a, b, k in zip(starts[at].tolist(), ends[at].tolist(), n.tolist()):
                        w = raw[a:b]
                        total[w] = total.get(w, 0) + k
                    if len(total) > WAITING:
                        yield rows()
        if total:
            yield rows()

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(counts: DataFrame, lexicon: int = LEXICON) -> list[bytes]:
    """The words that come at least ``n`` times, for the smallest ``n`` with at most ``lexicon`` of them."""
    kept = stored(counts.where("n > 1"))
    tally = kept.select(F.least("n", F.lit(1_000_000)).alias("n")).groupBy("n").count().orderBy(F.desc("n"))
    least, have = None, 0
    for r in tally.collect():  # as many rows as there are different counts
        have += r["count"]
        if have > lexicon:
            break
        least = r["n"]
    if least is None:
        return []
    return sorted(bytes(r["word"]) for r in kept.where(F.col("n") >= least).select("word").collect())


def _ship(spark: SparkSession, block: bytes) -> str:
    """Write the block into the shared folder and have Spark fetch it to every executor; the file's name there."""
    sc = spark.sparkContext
    name = f"lexicon-{hashlib.sha256(block).hexdigest()[:32]}.bin"
    path = sc._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/{name}")
    files = path.getFileSystem(sc._jsc.hadoopConfiguration())
    if not files.exists(path):
        draft = sc._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/_{name}")
        out = files.create(draft, True)
        out.write(block)
        out.close()
        files.rename(draft, path)
    sc.addFile(files.makeQualified(path).toString())
    return name


class _Worker:
    """One encoder per Python worker."""

    key: tuple | None = None
    encoder: Encoder | None = None

    @classmethod
    def get(cls, vocabulary, lexicon: str | None) -> Encoder:
        key = (vocabulary.value[0], lexicon)
        if cls.key != key:
            cls.encoder = Encoder(Vocabulary(vocabulary.value[1]), Lexicon(SparkFiles.get(lexicon)) if lexicon else Lexicon(Transducer().build([]).packed()))
            cls.key = key
        return cls.encoder


def prepare(docs: DataFrame, path: str, lexicon: int = LEXICON) -> tuple:
    """The broadcast vocabulary of the file at ``path``, and the name of the shipped transducer of the frequent words of ``docs``."""
    spark = docs.sparkSession
    with open(path, encoding="utf-8") as f:
        source = f.read()
    vocabulary = Vocabulary(source)
    shared = spark.sparkContext.broadcast((hashlib.sha256(source.encode()).hexdigest(), source))
    words = frequent_words(count_words(docs, shared), lexicon)
    return shared, _ship(spark, Transducer().build(list(zip(words, vocabulary.merge_many(words)))).packed())


def encode(docs: DataFrame, path: str, lexicon: int = LEXICON) -> DataFrame:
    """``docs`` with ``_ids`` (array of token ids of the whole text); a column of that name is replaced."""
    shared, name = prepare(docs, path, lexicon)
    names = [c for c in docs.columns if c != "_ids"]
    rows = docs.select(*[docs[f"`{c}`"].alias(f"c{i}") for i, c in enumerate(names)])
    text = f"c{names.index('text')}"

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for a, b, ids, offsets in _Worker.get(shared, name).encode_texts(batch.column(text)):
            column = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids))
            yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns, column], [*batch.schema.names, "ids"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    return per_batch(rows, work, f"{schema}, ids array<int>").toDF(*names, "_ids")


def decode(tokens: DataFrame, path: str, ids: str = "_ids") -> DataFrame:
    """``tokens`` with ``_text``, the text that the ids stand for (null ids: an empty one)."""
    with open(path, encoding="utf-8") as f:
        source = f.read()
    Vocabulary(source)
    shared = tokens.sparkSession.sparkContext.broadcast((hashlib.sha256(source.encode()).hexdigest(), source))
    names = [c for c in tokens.columns if c != "_text"]
    rows = tokens.select(*[tokens[f"`{c}`"].alias(f"c{i}") for i, c in enumerate(names)])
    at = f"c{names.index(ids)}"

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        encoder = _Worker.get(shared, None)
        for first in range(0, batch.num_rows, 512):
            part = batch.slice(first, 512)
            found = [encoder.decode(np.array([i for i in x or [] if i is not None], np.int64)) for x in part.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.string())], [*part.schema.names, "text_out"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    return per_batch(rows, work, f"{schema}, text_out string").toDF(*names, "_text")


def round_trip(docs: DataFrame, path: str, lexicon: int = LEXICON) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: encodes, decodes the ids and digests both, in one pass."""
    shared, name = prepare(docs, path, lexicon)

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        encoder = _Worker.get(shared, name)
        for a, b, ids, offsets in encoder.encode_texts(batch.column("text")):
            rows = [ids[x:y] for x, y in zip(offsets.tolist(), offsets[1:].tolist())]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").slice(a, b - a),
                    pa.array([len(r) for r in rows], pa.int64()),
                    pa.array([hashlib.sha256(r.astype("<u4").tobytes()).hexdigest() for r in rows]),
                    pa.array([hashlib.sha256(encoder.decode(r).encode()).hexdigest() for r in rows]),
                ],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return per_batch(rows, work, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
