"""The corpus pipeline: every stage against brute force on its own input."""

from __future__ import annotations

import collections
import re

import corpus_pipeline
import numpy as np
import public_tokenizers
from test_llm_operators import brute_components

from framesafe.llm import bpe, quality


def cut_lines(rows: dict[int, str]) -> dict[int, str]:
    key = lambda line: re.sub(r"[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))
    held = collections.defaultdict(set)
    for i, t in rows.items():
        for line in t.split("\n"):
            held[key(line)].add(i)
    lost = {k: max(v) for k, v in held.items() if len(k) >= 20 and len(v) >= 3}
    return {i: "\n".join(x for x in t.split("\n") if lost.get(key(x), i) == i) for i, t in rows.items()}


def plain(text: str) -> str:
    return " " + " ".join(re.findall(r"[0-9a-z\u0080-\U0010ffff]+", text.lower())) + " "


def test_stages(spark, sf, tmp_path):
    import tiktoken

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, seen = docs.columns, [{r.doc_id: r.text for r in docs.collect()}]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if k < 4:
            assert docs.columns == columns
            seen.append({r.doc_id: r.text for r in docs.collect()})
            assert all(r.n_chars == len(r.text) for r in docs.collect())
    everything, good, lines, single, clean = seen
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    model = quality.train(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    import pyarrow as pa
    from framesafe.llm.common import pieces

    ids = list(everything)
    scores = np.concatenate([model.score(quality.text_features(d, o)) for _, _, d, o in pieces(pa.array([everything[i] for i in ids]))])
    assert set(good) == {i for i, s in zip(ids, scores) if s >= 0.5}
    assert np.mean([labels[i] == (i in good) for i in labels]) > 0.95
    assert lines == cut_lines(good)
    assert set(single) == {r[0] for r in brute_components(list(lines.items())) if r[3]}
    items = [plain(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert set(single) - set(clean) >= {i for i, t in single.items() if any(x in plain(t) for x in items)}
    for i in set(single) - set(clean):  # what goes shares a long part with an item
        words = plain(single[i]).split()
        assert any(f" {' '.join(words[a : a + 5])} " in x for a in range(len(words) - 4) for x in items)
    tokens = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
    last = docs.collect()
    assert {r.doc_id for r in last} == set(clean)
    for r in last:
        assert r.ids == own.encode_ordinary(clean[r.doc_id]) and r.n_tokens == len(r.ids) and r.decoded == clean[r.doc_id]
