"""Language-model scores by a Brown class-based bigram model.

Tokens are words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased, then one end per document. All counts are taken
over all training documents: crc32 of the id as text leaves other than 2 when divided by 7.

* Exchange clustering moves each of the ``CLASS_WORDS`` most frequent words to the class that raises the
  likelihood of the class bigrams most, in turn, until a sweep changes nothing (gains below the rounding of
  the likelihood do not count). The end is a class of its own.
* Every other training word joins the class that raises that likelihood most, by how often each class stands
  before and after it; words outside the first block count as one class there. These counts are gathered by
  word over the whole vocabulary; then the class bigrams are counted anew with the classes of all words.
  Only unseen words have the class ``REST``.
* A token's probability is ``MIX`` times the class transition (smoothed by a half) times the word's share of
  its class, plus the rest times the base: (count + 1) / (N + V + 1). Both parts sum to one over all words
  and one unseen.

The counts and classes of the ``HEAD`` most frequent words (a bounded table) go to every task. Pairs of tokens
with another word are joined with the full table of words, in which no word is frequent.

Null and empty texts are a single end. Rows without ``doc_id`` are training rows. Repeated rows are scored
alike. With no training documents all words are unseen. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framesafe.session import checkpoint

from .common import Words, distinct_in_rows, per_batch, pieces, signed, whole_groups

CLASS_WORDS, CLASSES = 1024, 32
HEAD = 400_000
MIX = 0.9
END_HASH = np.uint64(0x452821E638D01377)
END, REST = 0, 1  # the first two classes

ROW = "id long, n_tokens long, known long, base double, score double, before array<long>, before_kind array<int>, word array<long>, kind array<int>, n array<long>"
PAIR = "before long, before_kind int, word long, kind int, times long"


def held_out(c: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(c).cast("string")) % 7 == 2, F.lit(False))


def _tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens of a piece with the ends put in, and their rows."""
    w = Words(data, offsets)
    rows = len(offsets) - 1
    at = w.first[1:]
    return np.insert(w.hash, at, END_HASH), np.insert(w.row, at, np.arange(rows))


def _count_in_tasks(texts: DataFrame, codes, name: str) -> DataFrame:
    """``name, n``: how often each code comes, counted in the tasks first."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        waiting: list[tuple[np.ndarray, np.ndarray]] = []

        def add():
            every, where = np.unique(np.concatenate([keys, *[k for k, _ in waiting]]), return_inverse=True)
            return every, np.bincount(where, np.concatenate([counts, *[c for _, c in waiting]]), len(every)).astype(np.int64)

        for batch in batches:
            for _, _, data, offsets in pieces(batch.column("text")):
                waiting.append(np.unique(codes(data, offsets), return_counts=True))
                if sum(len(k) for k, _ in waiting) > 1 << 20:
                    keys, counts = add()
                    waiting = []
                if len(keys) > 1 << 22:  # a bounded table per task; the rest is added up after the shuffle
                    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], [name, "n"])
                    keys, counts = keys[:0], counts[:0]
        keys, counts = add()
        for at in range(0, len(keys), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(keys[at : at + (1 << 16)]), pa.array(counts[at : at + (1 << 16)])], [name, "n"])

    return texts.mapInArrow(work, f"{name} long, n long").groupBy(name).agg(F.sum("n").alias("n"))


def exchange_classes(pairs: np.ndarray, classes: int, sweeps: int | None = None) -> np.ndarray:
    """The class of each word by exchange clustering of the matrix of word bigrams.

    The first two words keep classes of their own; others start dealt round by frequency.
    """
    n = len(pairs)
    of = np.r_[END, REST, 2 + np.arange(n - 2) % classes] if n > 2 else np.arange(n)
    size = classes + 2
    member = np.zeros((n, size))
    member[np.arange(n), of] = 1
    table = member.T @ pairs @ member
    phi = lambda x: x * np.log(np.maximum(x, 1e-300))
    least = 1e-9 + 1e-13 * float(phi(pairs.sum()))  # smaller gains are rounding and could go round for ever
    for _ in itertools.count() if sweeps is None else range(sweeps):
        moved = False
        for w in range(2, n):
            itself = pairs[w, w]
            right, left = pairs[w] @ member, member.T @ pairs[:, w]
            old = of[w]
            right[old] -= itself
            left[old] -= itself
            table[old] -= right
            table[:, old] -= left
            table[old, old] -= itself
            rows = phi(table + right).sum(1) - phi(table).sum(1)
            columns = phi(table + left[:, None]).sum(0) - phi(table).sum(0)
            d = np.diagonal(table)
            corner = phi(d + right + left + itself) - phi(d + right) - phi(d + left) + phi(d)
            out, into = table.sum(1) + left, table.sum(0) + right  # these gains are the same for every class
            gain = rows + columns + corner - phi(out + right.sum() + itself) + phi(out) - phi(into + left.sum() + itself) + phi(into)
            gain[:2] = -np.inf
            best = int(np.argmax(gain))
            if gain[best] <= gain[old] + least:
                best = old
            table[best] += right
            table[:, best] += left
            table[best, best] += itself
            member[w, old], member[w, best] = 0, 1
            of[w] = best
            moved |= best != old
        if not moved:
            break
    return of


@dataclass
class ClassModel:
    """What the tasks hold: bounded tables only."""

    tokens: int  # N
    distinct: int  # V
    head: np.ndarray  # sorted hashes of frequent words
    head_n: np.ndarray
    head_class: np.ndarray
    step: np.ndarray  # transition probabilities, row: the class before
    share: np.ndarray  # of a class's mass: 1 / class count; for the shared class 1 / (count + words + 1)
    moves: np.ndarray  # counts of class bigrams

    def looked_up(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Whether the head or the end, count and class of each token; ``REST`` where unknown."""
        at = np.minimum(np.searchsorted(self.head, hashes), max(0, len(self.head) - 1))
        frequent = self.head[at] == hashes if len(self.head) else np.zeros(len(hashes), bool)
        n = np.where(frequent, self.head_n[at], 0) if len(self.head) else np.zeros(len(hashes), np.int64)
        kind = np.where(frequent, self.head_class[at], REST) if len(self.head) else np.full(len(hashes), REST)
        end = hashes == END_HASH
        kind[end] = END
        return frequent | end, n, kind

    def chance(self, before: np.ndarray, kind: np.ndarray, n: np.ndarray) -> np.ndarray:
        own = np.where(kind == REST, (n + 1) * self.share[REST], np.where(kind == END, 1.0, n * self.share[kind]))
        return MIX * self.step[before, kind] * own + (1 - MIX) * (n + 1) / (self.tokens + self.distinct + 1)

    def rows(self, data: np.ndarray, offsets: np.ndarray):
        """Per text: tokens, known tokens, base and score without the rare words' counts, and those words."""
        hashes, row = _tokens(data, offsets)
        rows = len(offsets) - 1
        frequent, n, kind = self.looked_up(hashes)
        under = self.tokens + self.distinct + 1
        p = self.chance(np.r_[END, kind[:-1]], kind, n)
        base = np.log10((n + 1) / under)
        add = lambda x: np.bincount(row, x, rows)
        rare = np.flatnonzero(~frequent)
        words, r, times = distinct_in_rows(hashes[rare], row[rare])
        cuts = np.searchsorted(r, np.arange(rows + 1)).astype(np.int32)
        return add(None).astype(np.int64), add((n > 0).astype(float)).astype(np.int64), add(base), add(np.log10(p)), words, times.astype(np.int32), cuts


    def pairs(self, data: np.ndarray, offsets: np.ndarray):
        """Row, word before, its class, word, its class and count of each token, and whether both words are of the head.

        A word that is not has class -1; one of the head beside such a word is named by that word, which is never frequent.
        """
        hashes, row = _tokens(data, offsets)
        frequent, n, kind = self.looked_up(hashes)
        kind = np.where(frequent, kind, -1).astype(np.int32)
        before, before_kind = np.r_[END_HASH, hashes[:-1]], np.r_[np.int32(END), kind[:-1]]
        word = np.where(kind < 0, hashes, before)
        before = np.where(before_kind < 0, before, hashes)
        return row, before, before_kind, word, kind, n, (kind >= 0) & (before_kind >= 0)


def train(docs: DataFrame, class_words: int = CLASS_WORDS, classes: int = CLASSES, head: int = HEAD) -> tuple[ClassModel, DataFrame]:
    """The model and the table ``word, n`` of all counts."""
    texts = docs.where(~held_out()).select(F.coalesce("text", F.lit("")).alias("text"))
    counts = checkpoint(_count_in_tasks(texts, lambda d, o: signed(_tokens(d, o)[0]), "word"))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    # the frequent words: all with at least the count that keeps them within the bound
    floor, room = 0, head
    tally = sorted(((r[0], r[1]) for r in counts.groupBy(F.least("n", F.lit(100_000)).alias("n")).count().collect()), reverse=True)
    for n, words in tally:
        if words > room:
            floor = n + 1
            break
        room -= words
    end_word = int(np.array([END_HASH]).view(np.int64)[0])
    table = counts.where((F.col("n") >= floor) | (F.col("word") == end_word)).toArrow()
    hashes, n = table.column("word").to_numpy().view(np.uint64), table.column("n").to_numpy()
    order = np.argsort(hashes)
    hashes, n = hashes[order], n[order]
    by_count = np.lexsort((hashes, -n))
    top = by_count[hashes[by_count] != END_HASH][:class_words]
    vocabulary = np.sort(hashes[top])

    def word_pairs(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        h, _ = _tokens(data, offsets)
        at = np.minimum(np.searchsorted(vocabulary, h), max(0, len(vocabulary) - 1))
        code = np.where(vocabulary[at] == h, at + 2, 1) if len(vocabulary) else np.ones(len(h), np.int64)
        code[h == END_HASH] = 0
        return np.r_[0, code[:-1]] * (len(vocabulary) + 2) + code

    found = _count_in_tasks(texts, word_pairs, "pair").toArrow()  # at most (class_words + 2) ** 2 rows
    size = len(vocabulary) + 2
    pairs = np.zeros(size * size)
    pairs[found.column("pair").to_numpy()] = found.column("n").to_numpy()
    pairs = pairs.reshape(size, size)
    # frequent words are dealt first
    rank = np.r_[0, 1, 2 + np.lexsort((vocabulary, -pairs[:, 2:].sum(0)))]
    of = np.empty(size, np.int64)
    of[rank] = exchange_classes(pairs[np.ix_(rank, rank)], classes)
    member = np.zeros((size, classes + 2))
    member[np.arange(size), of] = 1
    moves = member.T @ pairs @ member
    step = (moves + 0.5) / (moves.sum(1, keepdims=True) + 0.5 * (classes + 2))
    mass = moves.sum(0)
    share = 1 / np.maximum(mass, 1)
    distinct = total[1]
    share[REST] = 1 / (mass[REST] + max(0, distinct - len(vocabulary) - (1 if end_word in hashes.view(np.int64) else 0)) + 1)
    kind = np.full(len(hashes), REST)
    if len(vocabulary):
        at = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
        mine = vocabulary[at] == hashes
        kind[mine] = of[at[mine] + 2]
    return ClassModel(int(total[0]), int(distinct), hashes, n, kind, step, share, moves), counts


def _neighbour_classes(texts: DataFrame, model: ClassModel) -> DataFrame:
    """``word, code, n``: how often each class stands before a word outside the first block (code: class) and after it (code: size + class)."""
    shared = texts.sparkSession.sparkContext.broadcast(model)
    size = len(model.step)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple] = []

        def added() -> tuple:
            words, codes, counts = (np.concatenate(x) for x in zip(*waiting))
            every, where = np.unique(words, return_inverse=True)
            keys, at = np.unique(where * (2 * size) + codes, return_inverse=True)
            return every[keys // (2 * size)], keys % (2 * size), np.bincount(at, counts, len(keys)).astype(np.int64)

        def rows() -> Iterator[pa.RecordBatch]:
            for at in range(0, len(waiting[0][0]), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(x[at : at + (1 << 16)], t) for x, t in zip((signed(waiting[0][0]), *waiting[0][1:]), (pa.int64(), pa.int32(), pa.int64()))], ["word", "code", "n"])

        for batch in batches:
            for _, _, data, offsets in pieces(batch.column("text")):
                hashes, _ = _tokens(data, offsets)
                kind = shared.value.looked_up(hashes)[2]
                at = np.flatnonzero(kind == REST)
                before, after = np.r_[END, kind[:-1]][at], np.r_[kind[1:], END][at]
                waiting.append((np.r_[hashes[at], hashes[at]], np.r_[before, size + after], np.ones(2 * len(at), np.int64)))
                if sum(len(w[0]) for w in waiting) > 1 << 20:
                    waiting = [added()]
                    if len(waiting[0][0]) > 1 << 19:
                        yield from rows()
                        waiting = []
        if waiting:
            waiting = [added()]
            yield from rows()

    return texts.mapInArrow(work, "word long, code int, n long").groupBy("word", "code").agg(F.sum("n").alias("n"))


def best_classes(table: np.ndarray, word: np.ndarray, code: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The class that raises the likelihood most of each word 0, 1, ...; ``word`` is sorted, ``code`` and ``n`` as above."""
    size = len(table)
    phi = lambda x: x * np.log(np.maximum(x, 1e-300))
    both = np.hstack([table, table.T])  # by class: counts to each class after, and from each class before
    near = both[:, np.where(code < size, code + size, code - size)].T
    first = np.searchsorted(word, np.arange(word[-1] + 1))
    gain = np.add.reduceat(phi(near + n[:, None]) - phi(near), first)
    words = len(first)
    left, right = np.zeros((words, size)), np.zeros((words, size))
    was = code < size
    left[word[was], code[was]], right[word[~was], code[~was] - size] = n[was], n[~was]
    d = np.diagonal(table)
    gain += phi(d + right + left) - phi(d + right) - phi(d + left) + phi(d)
    out, into = table.sum(1), table.sum(0)
    gain -= phi(out + right.sum(1, keepdims=True)) - phi(out) + phi(into + left.sum(1, keepdims=True)) - phi(into)
    gain[:, :2] = -np.inf
    return gain.argmax(1)


def train_all(docs: DataFrame, class_words: int = CLASS_WORDS, classes: int = CLASSES, head: int = HEAD) -> tuple[ClassModel, DataFrame]:
    """The model with a class for every training word, and the table ``word, n, kind`` of them all."""
    block, counts = train(docs, class_words, classes, head)
    spark = docs.sparkSession
    texts = docs.where(~held_out()).select(F.coalesce("text", F.lit("")).alias("text"))
    first = block.head_class != REST
    known = spark.createDataFrame(list(zip(signed(block.head[first]).tolist(), np.where(block.head == END_HASH, END, block.head_class)[first].tolist())), "word long, kind int")
    table = block.moves

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, number in whole_groups(batches, ["word"]):
            words = t.column("word").to_numpy()
            kind = best_classes(table, number - number[0], t.column("code").to_numpy(), t.column("n").to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(words[np.r_[True, words[1:] != words[:-1]]]), pa.array(kind, pa.int32())], ["word", "kind"])

    near = _neighbour_classes(texts, block).repartition("word").sortWithinPartitions("word")
    end = signed(np.array([END_HASH])).tolist()[0]
    kinds = near.mapInArrow(assign, "word long, kind int").union(known.where(F.col("word") != end))
    words = checkpoint(counts.join(kinds, "word", "left").select("word", "n", F.coalesce("kind", F.lit(END)).alias("kind")))  # only the end has none yet
    if not len(block.head):
        return block, words
    least = int(min(block.head_n[block.head != END_HASH], default=0))
    top = words.where((F.col("n") >= least) | (F.col("word") == end)).toArrow()
    hashes = top.column("word").to_numpy().view(np.uint64)
    order = np.argsort(hashes)
    model = replace(block, head=hashes[order], head_n=top.column("n").to_numpy()[order], head_class=top.column("kind").to_numpy()[order].astype(np.int64))

    shared, size = spark.sparkContext.broadcast(model), classes + 2

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        moves = np.zeros(size * size, np.int64)
        every = np.arange(size * size)
        for batch in batches:
            for _, _, data, offsets in pieces(batch.column("text")):
                _, before, before_kind, word, kind, _, whole = shared.value.pairs(data, offsets)
                moves += np.bincount(before_kind[whole] * size + kind[whole], minlength=size * size)
                part = ~whole
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(before[part])), pa.array(before_kind[part]), pa.array(signed(word[part])), pa.array(kind[part]), pa.array(np.ones(part.sum(), np.int64))],
                    [c.split()[0] for c in PAIR.split(", ")],
                )
        yield pa.RecordBatch.from_arrays(
            [pa.array(every), pa.array((every // size).astype(np.int32)), pa.array(every), pa.array((every % size).astype(np.int32)), pa.array(moves)],
            [c.split()[0] for c in PAIR.split(", ")],
        )

    pairs = texts.mapInArrow(work, PAIR).groupBy("before", "before_kind", "word", "kind").agg(F.sum("times").alias("times"))
    found = _with_kinds(pairs, words, "times").groupBy("before_kind", "kind").agg(F.sum("times").alias("times")).toArrow()
    moves = np.zeros((size, size))
    moves[found.column("before_kind").to_numpy(), found.column("kind").to_numpy()] = found.column("times").to_numpy()
    share = 1 / np.maximum(moves.sum(0), 1)
    share[REST] = 1.0  # one unseen word
    step = (moves + 0.5) / (moves.sum(1, keepdims=True) + 0.5 * size)
    return replace(model, step=step, share=share, moves=moves), words


def _with_kinds(pairs: DataFrame, words: DataFrame, *keep: str) -> DataFrame:
    """``pairs`` with the classes that were not known, and ``word_n``, the count of a word whose class was not; unseen words are ``REST``."""
    of = lambda c: words.select(F.col("word").alias(c), F.col("n").alias(f"{c}_n"), F.col("kind").alias(f"{c}_is"))
    kind = lambda k, c: F.when(F.col(k) >= 0, F.col(k)).otherwise(F.coalesce(f"{c}_is", F.lit(REST)))
    new = F.col("kind") < 0
    return pairs.join(of("word"), "word", "left").join(of("before"), "before", "left").select(
        *keep, kind("before_kind", "before").alias("before_kind"), kind("kind", "word").alias("kind"),
        F.when(new, F.coalesce("word_n", F.lit(0))).alias("word_n"),
    )


def score(docs: DataFrame, class_words: int = CLASS_WORDS, classes: int = CLASSES, head: int = HEAD) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    model, words = train_all(docs, class_words, classes, head)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()
    lists = ["before", "before_kind", "word", "kind", "n"]

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for first, end, data, offsets in pieces(batch.column("text")):
            m, rows = shared.value, end - first
            row, before, before_kind, word, kinds, n, whole = m.pairs(data, offsets)
            add = lambda x, at=slice(None): np.bincount(row[at], x, rows)  # noqa: B023, E731
            base = np.log10((n + 1) / (m.tokens + m.distinct + 1))
            scores = np.log10(m.chance(before_kind[whole], kinds[whole], n[whole]))
            part = np.flatnonzero(~whole)
            cuts = pa.array(np.searchsorted(row[part], np.arange(rows + 1)).astype(np.int32))
            values = [pa.array(x) for x in (signed(before[part]), before_kind[part], signed(word[part]), kinds[part], n[part].astype(np.int64))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(first, rows), pa.array(add(None).astype(np.int64)), pa.array(add((n > 0).astype(float)).astype(np.int64)),
                 pa.array(add(base).astype(float)), pa.array(add(scores, whole).astype(float)), *(pa.ListArray.from_arrays(cuts, v) for v in values)],
                ["doc_id", "n_tokens", "known", "base", "score", *lists],
            )

    def chances(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        before, kinds, n = (batch.column(c).to_numpy() for c in ("before_kind", "kind", "all_n"))
        yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("word_n"), pa.array(np.log10(shared.value.chance(before, kinds, n)))], ["key", "word_n", "gain"])

    rows = checkpoint(per_batch(docs, work, ROW.replace("id long", f"doc_id {kind}", 1)).withColumn("key", F.monotonically_increasing_id()))
    each = rows.select("key", F.explode(F.arrays_zip(*lists)).alias("w")).select("key", *(F.col(f"w.{c}").alias(c) for c in lists))
    joined = _with_kinds(each, words, "key", "n").withColumn("all_n", F.coalesce("word_n", "n")).drop("n")
    more = per_batch(joined, chances, "key long, word_n long, gain double").groupBy("key").agg(
        F.sum((F.col("word_n") > 0).cast("long")).alias("more_known"), F.sum(F.log10(F.col("word_n") + 1)).alias("more_base"), F.sum("gain").alias("gain")
    )
    zero = lambda c: F.coalesce(c, F.lit(0))
    return rows.join(more, "key", "left").select(
        "doc_id", held_out().alias("held_out"), "n_tokens", (F.col("known") + zero("more_known")).alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"), (F.col("base") + zero("more_base")).alias("base_score"), (F.col("score") + zero("gain")).alias("score"),
    )
