"""The text operators against brute force, with nulls, empty and long texts, ties, repeated rows, empty tables and clashing names."""

from __future__ import annotations

import collections
import hashlib
import itertools
import json
import random
import re
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from framesafe.llm import bpe, class_lm, common, decontaminate, html_text, line_dedup, near_dups, neighbours, quality, repeats, warc

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
DOC = "doc_id long, text string"


def sha(x: str | bytes) -> str:
    return hashlib.sha256(x.encode() if isinstance(x, str) else x).hexdigest()


def words_of(text: str | None) -> list[str]:
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lower)


def prose(rng: random.Random, n: int, vocabulary: int = 3000) -> str:
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def corpus() -> list[tuple]:
    """Copies, near copies, shared passages, lines, odd and empty texts."""
    rng = random.Random(7)
    base = [prose(rng, rng.randrange(5, 200)) for _ in range(60)]
    passage = prose(rng, 70)
    texts: list = [None, "", " ", "a", "\n\n", "Zwei  Wörter", "x" * 1500, "ab" * 700, "é" * 300, prose(rng, 9000)]
    for t in base:
        texts.append(t)
        w = t.split()
        for k in range(rng.randrange(3)):
            v = list(w)
            for _ in range(rng.randrange(1, 5)):
                v[rng.randrange(len(v))] = f"edit{rng.randrange(99)}"
            texts.append(" ".join(v) if k else t.upper())
    texts += [prose(rng, 60) + "\n" + passage + "\n " + prose(rng, 50) for _ in range(12)]
    texts += [base[0]] * 5
    rows = list(enumerate(texts))
    return [*rows, (None, base[1]), (3, "a"), (12, texts[12])]


# common helpers


def test_range_hashes_tell_ranges_apart_and_alike():
    data = np.frombuffer(b"abcabcabd", np.uint8)
    h = common.RangeHash(data)(np.array([0, 3, 6, 0]), np.array([3, 6, 9, 2]))
    assert h[0] == h[1] and len(set(h.tolist())) == 3


def test_words_follow_rows(corpus):
    import pyarrow as pa

    texts = [t for _, t in corpus]
    for first, end, data, offsets in common.pieces(pa.array(texts, pa.string()), 500):
        w = common.Words(data, offsets)
        assert np.diff(w.first).tolist() == [len(words_of(t)) for t in texts[first:end]]


@pytest.mark.parametrize("settle", [5, 10_000])
def test_components_are_the_same_however_few_edges_settle_in_a_task(spark, settle):
    rng = random.Random(3)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(100 + i, 101 + i) for i in range(20)] + [(7, 7)]
    got = {r.node: r.component for r in common.components(spark.createDataFrame(edges, "a long, b long"), settle=settle).collect()}
    near = collections.defaultdict(set)
    for a, b in edges:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    want = {}
    for s in sorted(near):
        todo = [s] if s not in want else []
        while todo:
            x = todo.pop()
            if x not in want:
                want[x] = s
                todo += near[x]
    assert got == want


def test_seen_twice_filter_misses_no_repeat(spark):
    rows = [(i, f"t{i % 900}") for i in range(1500)]
    df = spark.createDataFrame(rows, DOC).repartition(5)

    def values(batch):
        yield np.array([zlib.crc32(t.encode()) * 0x9E3779B97F4A7C15 % 2**64 for t in batch.column("text").to_pylist()], np.uint64)

    held = common.seen_twice_filter(df.select("text"), values, 20)
    hashes = np.array([zlib.crc32(f"t{k}".encode()) * 0x9E3779B97F4A7C15 % 2**64 for k in range(900)], np.uint64)
    hit = common.may_hold(held.value, hashes, 20)
    assert hit[:600].all() and hit[600:].mean() < 0.1


# page text


@pytest.mark.parametrize("name", ["social-science", "form-study", "search-theory", "notice-period", "alert-fatigue", "related-work", "share-prices", "dialog-systems"])
def test_topics_in_names_are_no_furniture(name):
    text = prose(random.Random(7), 60)
    for tag in ("article", "main"):
        assert html_text.main_text(f'<body><{tag}><div class="{name}"><p>{text}</p></div></{tag}></body>') == text
        assert html_text.main_text(f'<body><{tag} class="{name}"><p>{text}</p></{tag}></body>') == text


@pytest.mark.parametrize("name", ["social", "social-links", "share-buttons", "search-form", "related-posts", "notice", "site-notice", "login-box", "reply-form"])
def test_furniture_names_stay_furniture(name):
    text = prose(random.Random(8), 60)
    assert html_text.main_text(f'<body><article><p>{text}</p><div class="{name}">{prose(random.Random(9), 30)}</div></article></body>') == text


@pytest.mark.parametrize("words", [3, 10, 25, 40, 80, 150])
def test_text_outside_of_the_article_goes(words):
    text, other = prose(random.Random(3), 70), prose(random.Random(4), words)
    assert html_text.main_text(f"<body><p>{other}</p><article><p>{text}</p></article><p>{other}</p><div>{other}</div></body>") == text
    assert html_text.main_text(f"<body><h2>{other}</h2><main><p>{text}</p></main><h2>{other}</h2></body>") == text


def test_stages_keep_columns_of_any_name(spark):
    text = "a line that is long enough to count\nsome more words in a text of its own"
    rows = [(i, text if i < 4 else f"words number {i} alone in here {i * 7}", 0.1 * i, i, f"g{i}", None, i) for i in range(8)] + [(None, None, None, None, None, None, None), (4, "", 0.0, 0, "", "", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _score double, _n_lines int, _gone_id string, _leak_id string, c0 int")
    labels = spark.createDataFrame([(i, i % 2) for i in range(8)], "doc_id long, quality int")
    items = spark.createDataFrame([(1, text)], "item_id long, text string")
    for stage in (lambda d: quality.accept(d, labels, 0.0), line_dedup.cut_lines, near_dups.keep_one, lambda d: decontaminate.clean(d, items)):
        for given in (docs, docs.limit(0)):
            got = stage(given)
            assert got.columns == docs.columns
            kept = [r.asDict() for r in got.collect()]
            own = [dict(zip(docs.columns, r)) for r in rows]
            rest = lambda r: {k: v for k, v in r.items() if k != "text"}
            assert all(rest(r) in [rest(x) for x in own] for r in kept)
    assert quality.accept(docs, labels, 0.0).count() == len(rows)
    assert {r._gone_id for r in decontaminate.clean(docs, items).collect()} == {None, "", "g4", "g5", "g6", "g7"}


def test_main_text_leaves_furniture_out():
    page = """<html><body class="has-sidebar"><header><h1>Site</h1></header><nav><a href=x>Home</a></nav><div class="cookie-notice">We use cookies.</div>
    <main><article><header><h1>Title &amp; more</h1></header><p>First &nbsp; para<br>goes <a href="">on</a>.<p>Second &lt;b&gt;<div class="ad">Buy now</div>
    <form><label>Mail</label></form><aside>Side</aside><script>var t="</p>";</script><!-- no --><p>Last.</p>
    <section id="comments"><article class="comment"><p>Great post, I liked it</p></article></section></article></main><footer>&copy; me</footer></body></html>"""
    assert html_text.main_text(page) == "Title & more\n\nFirst para goes on.\n\nSecond <b>\n\nLast."


def test_pages_without_article_keep_long_blocks():
    long = " ".join(f"word{i}" for i in range(60))
    page = f"<ul><li><a href=a>One</a><li><a href=b>Two</a></ul><div>{long}</div><div>{long} end</div><div class=sidebar>{long}</div>"
    assert html_text.main_text(page) == f"{long}\n\n{long} end"


@pytest.mark.parametrize("name", ["layout has-sidebar", "content-with-sidebar", "sidebar-layout", "wrap with-left-sidebar no-comments", "search-page", "related-on"])
@pytest.mark.parametrize("tag", ["article", "main"])
def test_articles_in_containers_with_furniture_names_are_kept(name, tag):
    page = f"""<nav class="main-nav"><a href=x>Home</a></nav><div class="{name}"><{tag}><h1>Title</h1><p>First of the text.</p><div class="ad">Buy now</div>
    <p>Second.</p></{tag}><div class="sidebar"><p>Elsewhere</p></div></div><footer>me</footer>"""
    assert html_text.main_text(page) == "Title\n\nFirst of the text.\n\nSecond."


@pytest.mark.parametrize("name", ["main-nav", "main-menu", "main-header", "main-logo", "sidebar"])
def test_names_of_furniture_mark_no_article(name):
    long = " ".join(f"word{i}" for i in range(60))
    for tag in ("nav", "div"):
        page = f"<body><{tag} class='{name}'><a href=x>Home</a></{tag}><div>{long}</div><div>{long} end</div></body>"
        assert html_text.main_text(page) == f"{long}\n\n{long} end"
    teasers = "<div class='related'><article>Read this as well</article></div><div class='widgets'><article>And this</article></div>"
    assert html_text.main_text(f"<div>{long}</div><div>{long} end</div>{teasers}") == f"{long}\n\n{long} end"
    assert html_text.main_text(f"<main><article>{long}</article>{teasers}</main>") == long


def test_page_rows(spark):
    long = "<article>" + "<p>one &lt; two</p>" * 20000
    rows = [(1, "u", "<article><p>A"), (2, None, None), (3, "u", ""), (None, "u", "<article>B</article>"), (5, "u", long), (5, "u", "<<a<p x='>'>")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")
    got = sorted(html_text.extract(df).collect(), key=str)
    assert {(r.page_id, r.n_chars) for r in got} >= {(1, 1), (2, 0), (3, 0), (None, 1), (5, 20000 * 9 + 2 * 19999)}
    assert html_text.extract(df.limit(0)).count() == 0


def test_extraction_of_the_given_pages(spark, sf):
    import html

    for r in html_text.extract(spark.read.parquet(f"{sf}/pages.parquet")).join(spark.read.parquet(f"{sf}/pages.parquet").drop("url"), "page_id").collect():
        inner = re.split("</article>|<footer>", r.html[r.html.index("<article>") + 9 :])[0]
        blocks = [" ".join(html.unescape(re.sub("</?b>|<br>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", inner)]
        assert r.text == "\n\n".join(b for b in blocks if b)


# byte-pair encoding


def test_encoding_equals_the_public_library(spark, corpus):
    import tiktoken

    tokens = bpe.read_ranks(RANKS)
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
    rng = random.Random(1)
    odd = ["  ", " a", "a  b", "a \n b", "\x1c a\x1d\x1e b", "é x  y", "'s it's 'sx", "a" * 3000, " \n\n x\t\ty ", "日本語 漢字", "🎉🎉", "<|endoftext|>", "\r\n\r\n x"]
    odd += ["".join(rng.choice(["a", "the", " ", "  ", "\n", "'s", "é", "1", "!", " ", "\x1f", "日"]) for _ in range(rng.randrange(40))) for _ in range(150)]
    rows = [*corpus, *((1000 + i, t) for i, t in enumerate(odd))]
    df = spark.createDataFrame(rows, DOC).withColumn("ids", F.lit("clash"))
    got = bpe.decode(bpe.encode(df, RANKS, public_tokenizers.PATTERN), RANKS, public_tokenizers.PATTERN).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["_ids"] == own.encode_ordinary(r.text or "") and bytes(r["_bytes"]) == (r.text or "").encode()
    digests = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.round_trip(df, RANKS, public_tokenizers.PATTERN).collect()}
    for i, t in rows:
        ids = own.encode_ordinary(t or "")
        assert (i, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(t or "")) in digests
    assert bpe.encode(df.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


# nearest neighbours


def test_neighbours_find_most_of_brute_force(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = df.collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    units = x / np.linalg.norm(x, axis=1, keepdims=True)
    got = collections.defaultdict(list)
    for r in neighbours.nearest(df, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
        assert r.score == pytest.approx(float(units[ids == r.query_id][0] @ units[ids == r.vec_id][0]), abs=1e-12)
    hits = 0
    for q in ids[ids % 50 == 0]:
        score = units @ units[ids == q][0]
        best = [i for i in ids[np.lexsort((ids, -score))] if i != q][:5]
        hits += len(set(best) & {i for i, _ in got[q]})
    assert hits / (5 * (ids % 50 == 0).sum()) >= 0.9


def test_neighbours_in_several_shards(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "SHARD", 300)
    rng = np.random.default_rng(0)
    x = rng.normal(size=(1500, 16))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {(r.query_id, r.vec_id) for r in neighbours.nearest(df, F.col("vec_id") % 50 == 0).collect()}
    units = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {(q, int(i)) for q in range(0, 1500, 50) for i in [j for j in np.argsort(-(units @ units[q])) if j != q][:5]}
    assert len(got) == 150 and len(got & want) / len(want) >= 0.9


def test_neighbours_of_odd_vectors(spark):
    same = [1.0, 2.0, 0.0]
    rows = [(i, same) for i in range(0, 40)] + [(0, same), (100, [0.0, 0.0, 0.0]), (101, None), (102, [None, 1.0, 2.0]), (103, [float("nan"), 1.0, 1.0])]
    rows += [(104, [float("inf"), 1.0, 0.0]), (105, []), (106, [1.0, 0.5]), (None, same), (107, [1e-300, 1e-300, 0.0]), (150, [0.0, 0.0, 1e300])]
    df = spark.createDataFrame([(i, v, i) for i, v in rows], "vec_id long, embedding array<double>, rank long")
    got = [(r.query_id, r["rank"], r.vec_id) for r in neighbours.nearest(df, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect()]
    assert got[:5] == [(0, k, k) for k in range(1, 6)]
    assert {g[0] for g in got} == {0, 150} and all(g[2] < 100 for g in got[:5])
    assert neighbours.nearest(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    two = spark.createDataFrame([(0, same), (1, [1.0, 0.0, 0.0])], "vec_id long, embedding array<double>")
    assert [(r.query_id, r.vec_id) for r in neighbours.nearest(two, F.col("vec_id") % 50 == 0).collect()] == [(0, 1)]


# archives


def test_archives_give_back_true_records_only(spark):
    fake = "x" * 40 + "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:99>\r\nContent-Length: 30\r\n\r\nHTTP/1.1 200 OK\r\n\r\nabcdefghijk\r\n\r\n" + "y" * 60
    chain = "WARC/1.0\r\nContent-Length: 5\r\n\r\n12345\r\n\r\n" * 4
    pages = [(i, f"http://h/{i}", f"<p>{i}</p>" * 30) for i in range(5, 25)]
    pages += [(1, "u", fake), (2, "a\r\nWARC-Type: x", chain), (3, None, None), (4, "u", ""), (30, "u", "é" * 60), (31, "u", "é" * 60), (29, "u", "é" * 60)]
    pages += [(40, "u", "short"), (41, "u", "short"), (None, "u", "n" * 200), (1, "u", fake), (50, "u", fake), (60, "u", "WARC/1.0\r\n"), (61, "u", "\r\n\r\n" * 50)]
    df = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, digest string").repartition(3)
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.archive(df).collect()), key=str)
    heads = collections.defaultdict(list)
    for i, _, h in pages:
        if i is not None and len((h or "").encode()) >= 100:
            heads[h].append(i)
    want = []
    for i, _, h in pages:
        head = min(heads.get(h, [i])) if h in heads else i
        again = head != i
        want.append((i, len((h or "").encode()), sha(h or ""), "revisit" if again else "response", head if again else None))
    assert got == sorted(want, key=str)
    assert warc.archive(df.limit(0)).count() == 0


# decontamination


def test_leaks_are_exact_edited_and_partial_copies(spark):
    rng = random.Random(5)
    items = [(i, prose(rng, rng.randrange(15, 60), 400)) for i in range(20)] + [(20, None), (21, ""), (22, "two words"), (None, prose(rng, 20)), (3, "Wörter ganz anders hier als sonst")]
    docs, want = [], set()
    for d in range(120):
        text = prose(rng, rng.randrange(30, 200), 400)
        if d % 3 == 0:
            i, t = items[d // 3 % 20]
            w = t.split()
            for _ in range(d % 4 * len(w) // 30):
                w[rng.randrange(len(w))] = "edited"
            w = w[: max(15, len(w) * 3 // 4)] if d % 5 == 0 else w
            text += " - " + (", ".join(w).upper() if d % 2 else " ".join(w)) + "\n" + prose(rng, 30, 400)
            want.add((d, i))
        docs.append((d, text))
    docs += [(200, None), (201, ""), (None, items[0][1]), (0, docs[0][1]), (202, "WÖRTER GANZ ANDERS HIER ALS SONST")]
    df = spark.createDataFrame([(*d, "x") for d in docs], DOC + ", item_id string").repartition(4)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.leaks(df, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want | {(202, 3)} and len(got) == len(want) + 1
    for r in got:
        assert r.score >= 0.5 and 0 <= r.first_word <= r.last_word
    left = decontaminate.clean(df, bench)
    assert left.columns == df.columns and left.count() == len(docs) - len(want) - 2  # document 0 comes twice
    assert decontaminate.leaks(df.limit(0), bench).count() == 0 == decontaminate.leaks(df, bench.limit(0)).count()


@pytest.mark.parametrize("copies", [8, 9, 1000])
def test_edited_copies_are_found_however_many_beside_a_full_one(spark, copies):
    item = [f"w{k}" for k in range(40)]
    edited = " ".join("other" if k % 4 == 3 else w for k, w in enumerate(item))
    docs = [(0, "before " + " ".join(item) + " after")] + [(d, f"before x{d} {edited} after") for d in range(1, copies + 1)] + [(5000, "before w0 w1 w2 after")]
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    got = {r.doc_id: r.score for r in decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()}
    assert got.pop(0) == 1.0 and sorted(got) == list(range(1, copies + 1)) and min(got.values()) >= 0.5


def test_alignment_equals_the_plain_recurrence():
    rng = np.random.default_rng(2)
    items = [rng.integers(10, 16, rng.integers(1, 12)) for _ in range(60)]
    passages = [rng.integers(10, 16, rng.integers(1, 30)) for _ in range(60)]
    best, end = decontaminate.local_alignments(items, passages)
    for a, b, s, e in zip(items, passages, best, end):
        h = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, j in itertools.product(range(1, len(a) + 1), range(1, len(b) + 1)):
            h[i, j] = max(0, h[i - 1, j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
        assert s == h.max() and (s == 0 or (h[:, e] == s).any())


# repeated strings


def brute_repeats(texts: list[bytes]) -> list[tuple]:
    seen = collections.Counter(t[i : i + 200] for t in texts for i in range(len(t) - 199))
    out = []
    for t in texts:
        gone = np.zeros(len(t) + 2, bool)
        for i in range(len(t) - 199):
            if seen[t[i : i + 200]] > 1:
                gone[i + 1 : i + 201] = True
        edges = np.flatnonzero(np.diff(gone.astype(int)))
        kept = bytes(np.frombuffer(t, np.uint8)[~gone[1:-1]])
        out.append((len(t), int(gone.sum()), len(edges) // 2, sha(kept)))
    return out


@pytest.mark.parametrize("hot", [20_000, 1])
def test_repeats_equal_brute_force(spark, corpus, monkeypatch, hot):
    monkeypatch.setattr(repeats, "HOT_CORE", hot)
    rng = random.Random(hot)
    rows = [*corpus, *((500 + i, "z" * 199 + c) for i, c in enumerate("abz")), (600, ("q" * 250 + prose(rng, 40)) * 3)]
    for k in range(30):  # the same passage with unlike surroundings, cut anywhere
        text = corpus[9][1].encode()
        a = rng.randrange(2000)
        rows.append((700 + k, prose(rng, 20) + text[a : a + rng.randrange(150, 900)].decode() + prose(rng, 20)))
    df = spark.createDataFrame([(*r, "x") for r in rows], DOC + ", spans string").repartition(4)
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_removed, r.n_spans, sha(bytes(r.kept))) for r in repeats.remove_repeats(df).collect())
    want = brute_repeats([(t or "").encode() for _, t in rows])
    assert got == sorted((i is None, i or 0, *w) for (i, _), w in zip(rows, want))
    assert repeats.remove_repeats(df.limit(0)).count() == 0


# quality


def test_quality_of_held_out_labels(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    scored = quality.score(docs, quality.train(docs, labels)).join(labels.where("quality IS NOT NULL"), "doc_id")
    rows = scored.select(quality.held_out().alias("h"), "_score", "quality").where("h").collect()
    assert np.mean([(r["_score"] >= 0.5) == (r.quality == 1) for r in rows]) >= 0.95


def test_quality_of_odd_tables(spark, corpus):
    docs = spark.createDataFrame([(*r, "x") for r in corpus], DOC + ", label_q string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(1, 0), (2, None), (None, 1), (999, 1), (4, 7)], "doc_id long, quality int")
    got = quality.score(docs, quality.train(docs, labels)).collect()
    assert len(got) == len(corpus) and all(0 <= r["_score"] <= 1 for r in got)
    assert all(r["_score"] == pytest.approx(0.5) for r in quality.score(docs, quality.train(docs, labels.limit(0))).collect())
    one = quality.score(docs, quality.train(docs, labels.where("quality = 1"))).collect()
    assert all(r["_score"] > 0.99 for r in one)
    assert quality.score(docs.limit(0), quality.train(docs.limit(0), labels)).count() == 0
    assert quality.accept(docs, labels).columns == docs.columns


def test_additive_model_learns_single_features_and_pairs():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 4))
    y = (x[:, 1] * x[:, 2] > 0).astype(float)
    model = quality.fit(x[:3000], y[:3000], pairs=6)
    assert ((model.score(x[3000:]) >= 0.5) == y[3000:]).mean() > 0.7
    y = (x[:, 0] ** 2 > 0.5).astype(float)
    assert ((quality.fit(x[:3000], y[:3000]).score(x[3000:]) >= 0.5) == y[3000:]).mean() > 0.97


# language model


def test_class_model_scores(spark, corpus):
    df = spark.createDataFrame([(*r, "x") for r in corpus], DOC + ", word string").repartition(3)
    got = sorted(class_lm.score(df).collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0, r.n_tokens))
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    counts = collections.Counter(w for i, t in corpus if not out(i) for w in [*words_of(t), "\n"])
    n, v = sum(counts.values()), len(counts)
    rows = sorted(corpus, key=lambda r: (r[0] is None, r[0] or 0, len(words_of(r[1]))))
    for r, (i, t) in zip(got, rows):
        tokens = [*words_of(t), "\n"]
        assert (r.doc_id, r.held_out, r.n_tokens, r.train_tokens) == (i, out(i), len(tokens), n)
        assert r.n_known == sum(counts[w] > 0 for w in tokens)
        assert r.base_score == pytest.approx(sum(np.log10((counts[w] + 1) / (n + v + 1)) for w in tokens), rel=1e-9)
        assert r.score < 0
    assert class_lm.score(df.limit(0)).count() == 0


def test_class_model_with_few_head_words_gives_the_same(spark, corpus):
    df = spark.createDataFrame(corpus, DOC)
    model, counts = class_lm.train(df, class_words=20, classes=4)
    small, _ = class_lm.train(df, class_words=20, classes=4, head=40)
    assert len(small.head) <= 41 < len(model.head)
    import pyarrow as pa

    n = {r.word: r.n for r in counts.collect()}
    for _, _, data, offsets in common.pieces(pa.array([t for _, t in corpus])):
        a, b = model.rows(data, offsets), small.rows(data, offsets)
        gain = [sum(k * np.log10(n.get(int(w), 0) + 1) for w, k in zip(b[4][x:y].view(np.int64), b[5][x:y])) for x, y in itertools.pairwise(b[6])]
        assert np.allclose(a[3], b[3] + gain)


def test_class_model_is_a_distribution(spark, corpus):
    model, counts = class_lm.train(spark.createDataFrame(corpus, DOC), class_words=30, classes=5)
    n = {r.word: r.n for r in counts.collect()}
    under = model.tokens + model.distinct + 1
    for before in range(7):
        total = 0.0
        for h, k, c in zip(model.head.tolist(), model.head_n, model.head_class):
            end = h == int(class_lm.END_HASH)
            c = class_lm.END if end else c
            own = 1.0 if end else (k + 1) * model.share[1] if c == class_lm.REST else k * model.share[c]
            total += class_lm.MIX * model.step[before, c] * own + (1 - class_lm.MIX) * (k + 1) / under
        assert len(n) == len(model.head)
        total += class_lm.MIX * model.step[before, class_lm.REST] * model.share[1] + (1 - class_lm.MIX) / under  # one unseen word
        assert total == pytest.approx(1, abs=1e-9)


def test_every_training_word_has_a_class(spark, corpus):
    df = spark.createDataFrame(corpus, DOC)
    model, words = class_lm.train_all(df, class_words=20, classes=4)
    table = {r.word: (r.n, r.kind) for r in words.collect()}
    end = int(class_lm.END_HASH.view(np.int64))
    assert table[end][1] == class_lm.END and {k for w, (_, k) in table.items() if w != end} <= {2, 3, 4, 5} and len(table) == model.distinct
    for before in range(6):
        n, kind = np.array(list(table.values())).T
        unseen = model.chance(np.array([before]), np.array([class_lm.REST]), np.array([0]))
        assert model.chance(np.full(len(n), before), kind, n).sum() + unseen.sum() == pytest.approx(1, abs=1e-9)
    # the class bigrams and the scores by brute force, whatever number of words the tasks hold
    import pyarrow as pa

    moves, want = np.zeros((6, 6)), []
    for i, t in corpus:
        tokens = class_lm._tokens(*next((d, o) for _, _, d, o in common.pieces(pa.array([t or ""]))))[0].view(np.int64)
        n, kind = np.array([table.get(int(w), (0, class_lm.REST)) for w in tokens]).T
        before = np.r_[class_lm.END, kind[:-1]]
        want.append((str(i), len(tokens), round(float(np.log10(model.chance(before, kind, n)).sum()), 6)))
        if i is None or zlib.crc32(str(i).encode()) % 7 != 2:
            np.add.at(moves, (before, kind), 1)
    assert (model.moves == moves).all()
    for head in (40, 100_000):
        got = class_lm.score(df, class_words=20, classes=4, head=head).collect()
        for g, w in zip(sorted((str(r.doc_id), r.n_tokens, r.score) for r in got), sorted(want)):
            assert g[:2] == w[:2] and g[2] == pytest.approx(w[2], abs=1e-5)


def test_exchange_clustering_ends_where_no_move_helps():
    pairs = np.random.default_rng(0).poisson(2, (24, 24)).astype(float)

    def gain(of):
        m = np.zeros((24, 6))
        m[np.arange(24), of] = 1
        t = m.T @ pairs @ m
        phi = lambda x: (x * np.log(np.maximum(x, 1e-300))).sum()
        return phi(t) - phi(t.sum(0)) - phi(t.sum(1))

    of = class_lm.exchange_classes(pairs, 4)
    moves = [gain(np.where(np.arange(24) == w, c, of)) for w in range(2, 24) for c in range(2, 6)]
    assert gain(of) >= max(moves) - 1e-6 and gain(of) > gain(class_lm.exchange_classes(pairs, 4, 0))


# near duplicates


def brute_components(rows: list[tuple]) -> list[tuple]:
    def shingles(t):
        w = words_of(t)
        return frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[i : i + 5]) for i in range(len(w) - 4)])

    sets = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in rows if i is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (i, a), (j, b) in itertools.combinations([(i, s) for i, s in sets if i is not None and s], 2):
        if 100 * len(a & b) >= 75 * len(a | b):
            x, y = root(i), root(j)
            parent[max(x, y)] = min(x, y)
    out = [(i, len(s), root(i) if i is not None and s else i) for i, s in sets]
    return [(*r, r[0] == r[2]) for r in out]


@pytest.mark.parametrize("leaf", [64, 3])
def test_near_duplicates_equal_brute_force(spark, corpus, monkeypatch, leaf):
    monkeypatch.setattr(near_dups, "LEAF", leaf)
    monkeypatch.setattr(near_dups, "BLOCK", 4 if leaf == 3 else 2048)
    rng = random.Random(11)
    seed = prose(rng, 120).split()
    rows = list(corpus)
    for k in range(60):  # one large group whose members are at all distances from each other
        w = list(seed)
        for _ in range(rng.randrange(8)):
            w[rng.randrange(120)] = f"n{rng.randrange(50)}"
        rows.append((300 + k, " ".join(w)))
    df = spark.createDataFrame([(*r, "x") for r in rows], DOC + ", id string").repartition(4)
    got = sorted(near_dups.near_duplicates(df).collect(), key=str)
    assert [tuple(r) for r in got] == sorted([tuple(r) for r in brute_components(rows)], key=lambda r: str(type(got[0])(*r)))
    assert near_dups.near_duplicates(df.limit(0)).count() == 0
    assert near_dups.keep_one(df).count() == sum(r[3] for r in brute_components(rows))


# lines


def test_line_dedup_equals_brute_force(spark):
    rng = random.Random(4)
    lines = [prose(rng, 6) for _ in range(12)] + ["short one", "é" * 19, "é" * 20, "  Padded line with some words \t", "padded LINE with some words"]
    rows = [(i, "\n".join(rng.choice([*lines, f"only here {i} {rng.random()}"]) for _ in range(rng.randrange(1, 12)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "\n\n"), (None, "\n".join(lines)), (5, rows[5][1]), (103, lines[0] + "\n" + prose(rng, 5000))]
    df = spark.createDataFrame([(*r, "x") for r in rows], DOC + ", keys string").repartition(4)

    def key(line):
        return line.strip(" \t\n\x0b\x0c\r").lower()

    held = collections.defaultdict(set)
    for i, t in rows:
        if i is not None:
            for line in (t or "").split("\n"):
                held[key(line)].add(i)
    want = []
    for i, t in rows:
        all_ = (t or "").split("\n")
        kept = [x for x in all_ if i is None or not (len(key(x)) >= 20 and len(held[key(x)]) >= 3 and max(held[key(x)]) != i)]
        want.append((str(i), len(all_), len(all_) - len(kept), "\n".join(kept) if t is not None else None))
    got = line_dedup.dedup_lines(df)
    assert got.columns == [*df.columns, "_n_lines", "_n_dropped"]
    assert sorted(((str(r.doc_id), r["_n_lines"], r["_n_dropped"], r.text) for r in got.collect()), key=str) == sorted(want, key=str)
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0


def test_registry_has_eleven_queries():
    import __spark_entry__ as entry

    queries, sql = entry.queries(), entry.oracle_sql()
    assert {k.split("_")[0] for k in queries if re.match(r"op\d+_", k)} == {f"op{n}" for n in range(1, 11)} and "pipeline" in queries
    assert json.dumps(sorted(k for k in sql if k.startswith("op"))) == json.dumps(["op10_line_dedup", "op4_warc", "op9_near_dups"])


def test_pieces_of_a_large_batch_need_little_memory():
    column = pa.array(["some words that a text may hold " * 64] * 4096)  # 8 MB
    tracemalloc.start()
    for _, _, data, offsets in common.pieces(column):
        common.distinct_in_rows(*common.Words(data, offsets).shingles(5))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 32 << 20


def test_bpe_worker_keeps_few_parts():
    encoder = bpe.Bpe(bpe.read_ranks(RANKS), public_tokenizers.PATTERN)
    rows = [" ".join(f"w{k * 150 + i:x}" for i in range(150)) for k in range(1024)]
    most, n = 0, 0
    for _, texts in bpe._texts(pa.RecordBatch.from_arrays([pa.array(rows)], ["text"]), "text"):
        assert [encoder.decode(p).decode() for p in encoder.encode_batch(texts)] == texts
        most, n = max(most, len(encoder.parts)), n + len(texts)
    assert n == len(rows) and most <= 100_000


def test_bpe_worker_merges_frequent_pretokens_once(monkeypatch):
    encoder = bpe.Bpe(bpe.read_ranks(RANKS), public_tokenizers.PATTERN)
    merged = []
    merge = encoder.merge
    monkeypatch.setattr(encoder, "merge", lambda words: merged.extend(words) or merge(words))
    common_words = [f"qzx{a}{b}vk" for a in "abcdefghij" for b in "abcdefghij"]
    for k in range(800):  # 160,000 words that come once, more than the cache takes
        text = " ".join(["x", *common_words, *(w + "!" * (1 + k % 3) for w in common_words), *(f"w{k * 200 + i:x}" for i in range(200))])
        assert encoder.decode(encoder.encode_batch([text])[0]).decode() == text
    assert [merged.count(f" {w}".encode()) for w in common_words] == [1] * 100
    assert len(encoder.parts) + len(encoder.older) <= 100_000


def test_bpe_merges_as_the_plain_rule():
    rng = random.Random(3)
    tokens = [bytes([b]) for b in range(256)]
    while len(tokens) < 400:
        token = rng.choice(tokens[97:100] + tokens[256:]) + rng.choice(tokens[97:100] + tokens[256:])
        if token not in tokens:
            tokens.append(token)
    encoder = bpe.Bpe(tokens, public_tokenizers.PATTERN)

    def plain(word):
        parts = [bytes([b]) for b in word]
        while True:
            ranks = [encoder.rank.get(a + b, len(tokens)) for a, b in zip(parts, parts[1:])]
            if min(ranks, default=len(tokens)) == len(tokens):
                return [encoder.rank[p] for p in parts]
            at = ranks.index(min(ranks))
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    words = [bytes(rng.choice(b"aaabbcd") for _ in range(n)) for n in [*range(70), *[5] * 50, 300]] + [b"a" * 257, b"\xff\x00"]
    assert [np.frombuffer(p, "<u4").tolist() for p in encoder.merge(words)] == [plain(w) for w in words]


def test_bpe_decodes_nulls_and_runs_of_ids(spark):
    rows = [(0, None), (1, []), (2, [64] * 70_000), (3, [65]), (4, None), (5, [64, 65])]
    got = bpe.decode(spark.createDataFrame(rows, "doc_id long, _ids array<int>").coalesce(1), RANKS, public_tokenizers.PATTERN).collect()
    tokens = bpe.read_ranks(RANKS)
    assert {r.doc_id: bytes(r["_bytes"]) for r in got} == {k: b"".join(tokens[i] for i in ids or []) for k, ids in rows}


def test_bpe_pipeline_needs_one_python_worker_a_core(spark):
    rows = [(0, None), (1, ""), (2, "a b" * 70_000), (3, "two words"), (4, "two  words\n")]
    docs = spark.createDataFrame(rows, DOC).coalesce(1)
    both = bpe.encode_decode(docs, RANKS, public_tokenizers.PATTERN)
    apart = bpe.decode(bpe.encode(docs, RANKS, public_tokenizers.PATTERN), RANKS, public_tokenizers.PATTERN)
    assert sorted(map(tuple, both.collect())) == sorted(map(tuple, apart.select(*both.columns).collect()))
    import corpus_pipeline

    last = corpus_pipeline.tokenize(spark, docs.selectExpr("doc_id", "'en' lang", "'web' source", "text"), "")
    assert last._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
