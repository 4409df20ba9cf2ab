"""Resampling by prefix CRCs, BPE by a lexicon transducer and the conversation trie, each against brute force."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from framesafe.llm import crc_resample, lexicon_bpe, prefix_trie

DOC = "doc_id long, text string"
FILE = public_tokenizers.path("byte_bpe_50k.json")


def sha(x: bytes | str) -> str:
    return hashlib.sha256(x.encode() if isinstance(x, str) else x).hexdigest()


# resampling


def gram_list(text: str | None, most: int) -> list[bytes]:
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w.encode() for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)]
    return [b" ".join(words[i : i + k]) for k in range(1, most + 1) for i in range(len(words) - k + 1)]


def expected_scores(docs, target, percent, least, seed, most, buckets):
    bag = lambda t: [zlib.crc32(g) % buckets for g in gram_list(t, most)]
    s, t = collections.Counter(), collections.Counter()
    for _, text in docs:
        s.update(bag(text))
    for (text,) in target:
        t.update(bag(text))
    s_all, t_all = sum(s.values()) + buckets, sum(t.values()) + buckets
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * s_all / ((s[b] + 1) * t_all)))
    rows = []
    for i, text in docs:
        b = bag(text)
        weight = sum(map(gain, b)) // len(b) if b else 0
        h = int(sha(f"{seed}:{'' if i is None else i}")[:8], 16)
        rows.append((i, len(b), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), len(gram_list(text, 1)) >= least))
    may = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], -math.inf if r[0] is None else r[0]))
    drawn = percent * len(may) // 100
    place = collections.defaultdict(list)
    for k, r in enumerate(may[:drawn]):
        place[r[:4]].append(k + 1)
    return sorted((*r[:4], place[r[:4]].pop(0) if r[4] and place[r[:4]] else None) for r in rows if r[0] is not None), drawn


@pytest.fixture(scope="module")
def texts() -> list[tuple]:
    rng = random.Random(3)
    word = lambda: rng.choice(["the", "The", "cat", "é", "42", "don't", "中文", "x" * 30, f"w{rng.randrange(200)}"])
    rows: list = [None, "", " ,. ", "one", "ONE two"]
    rows += [rng.choice([" ", ", ", "\n", "--"]).join(word() for _ in range(rng.randrange(1, 120))) for _ in range(120)]
    rows += [rows[9]] * 5
    return [*enumerate(rows), (None, rows[7]), (7, rows[7])]


@pytest.mark.parametrize("most, buckets, percent, least", [(1, 10_000, 10, 20), (3, 97, 50, 5), (2, 100_000, 100, 0)])
def test_resample_against_brute_force(spark, texts, most, buckets, percent, least):
    target = [("the cat sat on 42 mats",), (None,), ("é 中文 the",)]
    got = crc_resample.scores(
        spark.createDataFrame(texts, DOC), spark.createDataFrame(target, "text string"), percent=percent, least_words=least, most_words=most, buckets=buckets
    ).collect()
    want, drawn = expected_scores(texts, target, percent, least, 2024, most, buckets)
    assert len(got) == len(texts)
    assert sorted((tuple(r) for r in got if r["doc_id"] is not None), key=str) == sorted(want, key=str)
    assert sorted(r["rank"] for r in got if r["rank"] is not None) == list(range(1, drawn + 1))


def test_resample_of_empty_tables_and_clashing_columns(spark):
    none, target = spark.createDataFrame([], DOC), spark.createDataFrame([("a b",)], "text string")
    assert crc_resample.scores(none, target).collect() == []
    docs = spark.createDataFrame([(i, "word " * 30, i, "k") for i in range(20)], DOC + ", drawn long, score string")
    assert {r["rank"] for r in crc_resample.scores(docs, none).collect()} == {None, 1, 2}
    kept = crc_resample.resample(docs, target)
    assert kept.columns == docs.columns and kept.count() == 2


def test_crcs_of_word_runs_come_from_prefixes():
    text = ("Zwei,  Wörter " * 300 + "x" * 3000 + " end").encode()
    grams = crc_resample.Grams(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    words = [g for g in gram_list(text.decode(), 1)]
    for size in (1, 2, 5):
        crc, at = grams.crcs(size)
        assert crc.tolist() == [zlib.crc32(b" ".join(words[i : i + size])) for i in at.tolist()]


@pytest.mark.parametrize("limit", [7, 64, 1000])
def test_long_texts_are_cut_without_losing_grams(limit):
    rng = random.Random(limit)
    text = " ".join("w" * rng.randrange(1, 40) for _ in range(400)) + " , "
    data = np.frombuffer(text.encode(), np.uint8)
    for most in (1, 3):
        words, features, packed = crc_resample._features(data, np.array([0, len(data)]), most, 1000, np.dtype("<u2"), limit)
        want = [zlib.crc32(g) % 1000 for g in gram_list(text, most)]
        assert (words[0], features[0]) == (400, len(want)) and sorted(packed.tolist()) == sorted(want)


# lexicon BPE

PARTS = ["a", "b", "s", "t", "re", "ve", "ll", "'", "'s", " ", "  ", "\n", "\t", " ", " ", "1", "23", "!", "?", "é", "ß", "中", "😀", "<|endoftext|>", "<|", "\r\n", "\x1c", "\x85", "The", " the", "_", "́"]


def odd_texts(n: int, seed: int) -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randrange(40))) for _ in range(n)]


def test_transducer_holds_its_words_only_and_shares_suffixes():
    rng = random.Random(1)
    words = sorted({bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 9))) for _ in range(600)} | {b"x" + s + b"ing" for s in (b"ab", b"cde", b"f")})
    items = [(w, tuple(rng.randrange(5) for _ in range(rng.randrange(1, 4)))) for w in words]
    built = lexicon_bpe.Transducer().build(items)
    assert len(built.states) < len({w[:k] for w in words for k in range(len(w) + 1)})
    lexicon = lexicon_bpe.Lexicon(built.packed())
    probe = words + [w + b"z" for w in words] + [w[:-1] for w in words if len(w) > 1] + [b"z"]
    data = np.frombuffer(b"".join(probe), np.uint8)
    ends = np.cumsum([len(p) for p in probe])
    held, count, met = lexicon.walk(data, np.concatenate([[0], ends[:-1]]), ends)
    assert [h for h in held.tolist()] == [p in set(words) for p in probe]
    out = collections.defaultdict(list)
    for w, place, o in met:
        for a, p, b in zip(w.tolist(), place.tolist(), o.tolist()):
            out[a] += list(zip(range(p, p + lexicon.size[b]), lexicon.ids[lexicon.begin[b] : lexicon.begin[b] + lexicon.size[b]].tolist()))
    for k, (w, ids) in enumerate(items):
        assert tuple(i for _, i in sorted(out[k])) == ids and count[k] == len(ids)
    with pytest.raises(ValueError):
        lexicon_bpe.Transducer().build([(b"b", (1,)), (b"a", (1,))])


@pytest.mark.parametrize("limit", [50, 1 << 20])
def test_encoder_equals_the_library(limit):
    library = Tokenizer.from_file(FILE)
    vocabulary = lexicon_bpe.Vocabulary(open(FILE, encoding="utf-8").read())
    words = sorted({b" the", b"The", b"a", b"'s", b" \xc3\xa9", b"  ", b"23"})
    encoder = lexicon_bpe.Encoder(vocabulary, lexicon_bpe.Lexicon(lexicon_bpe.Transducer().build([(w, vocabulary.merge(w)) for w in words]).packed()))
    texts = [*odd_texts(3000, 5), None, "", "x" * 5000, "ab" * 4000, " ".join(odd_texts(300, 6)), "don't 'tis we'll they'VE I'm'd"]
    texts += ["a" + chr(i) + "b " + chr(i) + " " + chr(i) + "'s" for i in range(0, 0x30000, 37) if not 0xD800 <= i < 0xE000]
    want = [e.ids for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    for a, b, ids, offsets in encoder.encode_texts(pa.array(texts, pa.string()), limit):
        for k in range(a, b):
            got = ids[offsets[k - a] : offsets[k - a + 1]]
            assert got.tolist() == want[k], texts[k][:100]
            assert encoder.decode(got) == library.decode(want[k], skip_special_tokens=False) == (texts[k] or "")


@pytest.mark.parametrize("lexicon", [0, 20, 131_072])
def test_lexicon_bpe_job(spark, lexicon):
    texts = [*odd_texts(200, 9), None, "", "same words same words", "same words same words"]
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], DOC + ", _ids string, c1 string")
    library = Tokenizer.from_file(FILE)
    want = {i: library.encode(t or "", add_special_tokens=False).ids for i, t in enumerate(texts)}
    encoded = lexicon_bpe.encode(docs, FILE, lexicon)
    assert encoded.columns == ["doc_id", "text", "c1", "_ids"]
    decoded = lexicon_bpe.decode(encoded, FILE)
    for r in decoded.collect():
        assert r["_ids"] == want[r["doc_id"]] and r["_text"] == (texts[r["doc_id"]] or "")
    for r in lexicon_bpe.round_trip(docs, FILE, lexicon).collect():
        ids = np.array(want[r["doc_id"]], "<u4").tobytes()
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids) // 4, sha(ids), sha(texts[r["doc_id"]] or ""))
    assert lexicon_bpe.round_trip(docs.limit(0), FILE, lexicon).collect() == []
    broken = spark.createDataFrame([([64, None, 10**6, 119, 238],), (None,)], "_ids array<int>")
    assert [r["_text"] for r in lexicon_bpe.decode(broken, FILE).collect()] == [library.decode([64, 119, 238], skip_special_tokens=False), ""]


# conversation trie


def expected_trie(rows: list[tuple], cuts: int = 6) -> list[tuple]:
    own = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in own.items()}
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % cuts
        rebuilt[c] = own.get(c - int(math.fmod(c, 100)), [])[:h] + turns[h:]
    nodes = collections.defaultdict(list)
    for c, p in rebuilt.items():
        for d in range(len(p) + 1):
            nodes[tuple(p[:d])].append(c)
    children = collections.Counter(n[:-1] for n in nodes if n)
    saved, leaves = collections.Counter(), collections.Counter()
    for n, m in nodes.items():
        for d in range(len(n) + 1):
            saved[n[:d]] += (len(m) - 1) * len(n[-1][1]) if n else 0
            leaves[n[:d]] += not children[n]
    return sorted(
        (min(m), len(n), min(nodes[n[:-1]]) if n else -1, len(m), children[n], leaves[n], saved[n], sha(",".join(map(str, sorted(c for c in m if len(rebuilt[c]) == len(n))))))
        for n, m in nodes.items()
    )


CONVERSATION = "conv_id long, turn long, role string, text string"


def found_trie(df) -> list[tuple]:
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(tuple(-1 if v is None else v for v in r) for r in df.select(*columns).collect())


@pytest.fixture(scope="module")
def conversations() -> list[tuple]:
    rng = random.Random(11)
    rows = []
    for c in range(330):
        if c % 7 == 3:
            continue
        for t in range(rng.randrange(1, 9)):
            rows.append((c, t, rng.choice(["user", "assistant"]) if t else "system", "Hallo" if t < 2 else rng.choice(["a", "bé", None, "long text"])))
    rows += [(5000, t, "user", f"turn {t // 2}") for t in range(300)]  # one long path
    rows += [(5001, t, "user", f"turn {t // 2}") for t in range(290)]
    rows += [(9000 + c, t, "user", "copy") for c in range(200) for t in range(8)]  # one large group of copies
    rows += [(7, None, None, "first"), (7, 3, "user", "same"), (7, 3, "user", "same"), (None, 1, "user", "nobody"), (-250, 0, "user", "minus"), (-200, 0, "user", "base")]
    return rows


@pytest.mark.parametrize("band, least_heavy, queue", [(1024, 64, 1 << 18), (16, 3, 5), (1, 1, 1)])
def test_trie_against_brute_force(spark, conversations, band, least_heavy, queue):
    rows = conversations if band > 1 else [r for r in conversations if r[0] != 5000 and r[0] != 5001]
    df = spark.createDataFrame(rows, CONVERSATION).repartition(4)
    got = found_trie(prefix_trie.forked_trie(df, band=band, least_heavy=least_heavy, queue_entries=queue))
    assert got == expected_trie(rows)


def test_trie_of_few_rows(spark):
    assert prefix_trie.forked_trie(spark.createDataFrame([], CONVERSATION)).collect() == []
    one = [(3, None, None, None)]
    assert found_trie(prefix_trie.forked_trie(spark.createDataFrame([(*r, "x", 1) for r in one], CONVERSATION + ", k1 string, depth int"))) == expected_trie(one)
    turns = prefix_trie.forked(spark.createDataFrame([(100, 0, "user", "hi"), (100, 1, "bot", "yo")], CONVERSATION))
    nodes = prefix_trie.node_texts(prefix_trie.trie(turns, turns.select("conv_id").distinct()), turns)
    assert sorted((r["depth"], r["role"], r["text"]) for r in nodes.collect()) == [(0, None, None), (1, "user", "hi"), (2, "bot", "yo")]


@pytest.mark.parametrize("limit", [1, 7, 1000])
def test_spilling_queue_is_a_priority_queue(limit):
    rng = random.Random(limit)
    queue, held = prefix_trie.SpillingQueue(limit), []
    for _ in range(3000):
        if rng.random() < 0.6 or not held:
            entry = (rng.randrange(50), rng.randrange(9))
            queue.push(entry)
            held.append(entry)
        else:
            least = min(held)
            held.remove(least)
            assert queue.peek() == least and queue.pop() == least
    assert [queue.pop() for _ in range(len(held))] == sorted(held) and queue.peek() is None
    assert (queue.spilled > 0) == (limit < 1000)


def test_trie_keeps_the_whole_tables_texts(spark, sf):
    df = spark.read.parquet(f"{sf}/conversations.parquet")
    rows = [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]
    assert found_trie(prefix_trie.forked_trie(df.withColumn("n", F.lit(1)))) == expected_trie(rows)
