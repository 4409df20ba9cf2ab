"""The registered queries of the operators, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, class_lm, crc_resample, decontaminate, html_text, lexicon_bpe, line_dedup, near_dups, neighbours, prefix_trie, quality, repeats, warc
from .common import table, text_or_empty

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn

    return add


_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


@query(
    "op10_line_dedup",
    rf"""
    WITH lines AS (
        SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
        FROM documents),
    keyed AS (
        SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), {_LOWER}) AS key FROM lines),
    lost AS (
        SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 20
        GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
    marked AS (
        SELECT k.doc_id, k.line, k.pos, l.key IS NOT NULL AND k.doc_id <> l.keeper AS gone
        FROM keyed k LEFT JOIN lost l ON k.key = l.key)
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
           sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
    FROM marked GROUP BY doc_id
    """,
)
def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select(
        "doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"),
        F.sha2(text_or_empty().cast("binary"), 256).alias("kept_sha256"),
    )


@query("op2_bpe")
def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@query("op7_quality")
def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", quality.held_out().alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= 0.5).cast("int").alias("predicted"))


@query(
    "op9_near_dups",
    rf"""
    WITH RECURSIVE words AS (
        SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_LOWER}), '[^\x20\x09-\x0D]+') AS w FROM documents),
    sets AS (
        SELECT doc_id, unnest(list_distinct(
            CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                 ELSE [array_to_string(w[i : i + 4], ' ') FOR i IN range(1, len(w) - 3)] END)) AS s
        FROM words),
    sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
    shared AS (
        SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c
        FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
    links AS (
        SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y
        WHERE 100 * c >= 75 * (p.n + q.n - c)),
    both_ways AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
    reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, b.y FROM reach r JOIN both_ways b ON r.y = b.x),
    parts AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x)
    SELECT d.doc_id, coalesce(z.n, 0) AS n_shingles, p.component_id, d.doc_id = p.component_id AS kept
    FROM documents d JOIN parts p ON p.x = d.doc_id LEFT JOIN sizes z ON z.doc_id = d.doc_id
    """,
)
def op9_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op5_leaks")
def op5_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query(
    "op4_warc",
    """
    WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
    h AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS head FROM p)
    SELECT page_id, payload_bytes, payload_digest, CASE WHEN head <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN head <> page_id THEN head END AS refers_to
    FROM h
    """,
)
def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op1_html_text")
def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


@query("op3_neighbours")
def op3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


@query("op8_class_lm")
def op8_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_lm.score(table(spark, sf_dir, "documents"))


@query("op6_repeats")
def op6_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = repeats.remove_repeats(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


#: The remainder of each byte under the CRC-32 polynomial, as a list; ``{crc}`` below folds the bytes of a word by it.
_CRC_TABLE = """
    steps AS (
        SELECT i AS byte, list_reduce([i, 1, 2, 3, 4, 5, 6, 7, 8], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
        FROM (SELECT CAST(unnest(range(256)) AS BIGINT) AS i)),
    crc_table AS (SELECT list(c ORDER BY byte) AS t FROM steps)
"""


def _crc_of(text: str) -> str:
    """SQL for the unsigned CRC-32 of a text's UTF-8 bytes, in a query that reads ``crc_table``."""
    return (
        f"xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, strlen({text}) + 1), "
        f"lambda i: CAST('0x' || substr(hex(encode({text})), CAST(2 * i - 1 AS BIGINT), 2) AS BIGINT))), "
        "lambda c, b: xor(t[CAST(xor(c, b) & 255 AS BIGINT) + 1], c >> 8)))"
    )


@query(
    "op11_crc_resample",
    rf"""
    WITH {_CRC_TABLE},
    bags AS (
        SELECT TRUE AS corpus, doc_id, regexp_extract_all(translate(coalesce(text, ''), {_LOWER}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
        UNION ALL
        SELECT FALSE, item_id, regexp_extract_all(translate(coalesce(text, ''), {_LOWER}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
    words AS (SELECT corpus, doc_id, unnest(w) AS word FROM bags),
    hashed AS (SELECT word, {_crc_of('word')} % 10000 AS bucket FROM (SELECT DISTINCT word FROM words), crc_table),
    counts AS (
        SELECT bucket, count(*) FILTER (corpus) AS s, count(*) FILTER (NOT corpus) AS t
        FROM words JOIN hashed USING (word) GROUP BY bucket),
    totals AS (SELECT count(*) FILTER (corpus) AS s_all, count(*) FILTER (NOT corpus) AS t_all FROM words),
    gain AS (
        SELECT bucket, CAST(floor(1000 * ln(CAST((t + 1) * (s_all + 10000) AS DOUBLE) / CAST((s + 1) * (t_all + 10000) AS DOUBLE))) AS BIGINT) AS g
        FROM counts, totals),
    weights AS (
        SELECT doc_id, count(*) AS n, CAST(sum(g) AS BIGINT) AS g
        FROM words JOIN hashed USING (word) JOIN gain USING (bucket) WHERE corpus GROUP BY doc_id),
    scored AS (
        SELECT d.doc_id, coalesce(n, 0) AS n_features,
               CASE WHEN n IS NULL THEN 0 ELSE (g - ((g % n) + n) % n) // n END AS weight,
               CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || d.doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS noise
        FROM documents d LEFT JOIN weights USING (doc_id)),
    drawn AS (
        SELECT doc_id, row_number() OVER (ORDER BY weight + noise DESC, doc_id) AS rank, count(*) OVER () AS n_all
        FROM scored WHERE n_features >= 20)
    SELECT s.doc_id, n_features, weight, weight + noise AS score, CASE WHEN rank <= 10 * n_all // 100 THEN rank END AS rank
    FROM scored s LEFT JOIN drawn USING (doc_id)
    """,
)
def op11_crc_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crc_resample.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query(
    "op13_prefix_trie",
    f"""
    WITH {_CRC_TABLE},
    turns AS (
        SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
               row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS pos
        FROM conversations WHERE conv_id IS NOT NULL),
    own AS (SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY pos) AS l FROM turns GROUP BY conv_id),
    forks AS (SELECT conv_id, CAST(conv_id AS VARCHAR) AS id, l FROM own),
    forks_h AS (SELECT conv_id, {_crc_of('id')} % 6 AS h, l FROM forks, crc_table),
    rebuilt AS (
        SELECT f.conv_id, list_concat(coalesce(b.l[1 : f.h], []), f.l[f.h + 1 :]) AS p
        FROM forks_h f LEFT JOIN own b ON b.conv_id = f.conv_id - f.conv_id % 100),
    spots AS (SELECT conv_id, d AS depth, p[1 : d] AS path, len(p) = d AS ends FROM rebuilt, unnest(range(len(p) + 1)) AS r(d)),
    nodes AS (
        SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
               sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
        FROM spots GROUP BY path, depth),
    kin AS (SELECT path[1 : depth - 1] AS path, depth - 1 AS depth, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL),
    valued AS (
        SELECT n.*, coalesce(n_children, 0) AS n_children, CASE WHEN depth = 0 THEN 0 ELSE (n_convs - 1) * length(path[depth].text) END AS saved
        FROM nodes n LEFT JOIN kin USING (path, depth)),
    totals AS (
        SELECT path[1 : a] AS path, a AS depth, count(*) FILTER (n_children = 0) AS n_leaves, CAST(sum(saved) AS BIGINT) AS saved_tokens
        FROM valued, unnest(range(depth + 1)) AS r(a) GROUP BY ALL)
    SELECT v.conv_id, v.depth, p.conv_id AS parent_conv_id, v.n_convs, v.n_children, t.n_leaves, t.saved_tokens, v.ends_sha256
    FROM valued v JOIN totals t USING (path, depth) LEFT JOIN nodes p ON p.depth = v.depth - 1 AND p.path = v.path[1 : v.depth - 1]
    """,
)
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.forked_trie(table(spark, sf_dir, "conversations")).drop("k1", "k2")


@query("op12_lexicon_bpe")
def op12_lexicon_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexicon_bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
