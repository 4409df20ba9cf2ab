"""Domain views over the given tables, once as DataFrames and once as SQL.

All formulas use integer arithmetic, so both engines read the same rows. Media time runs in
milliseconds (``t_ms``), one six-thousandth of the event time since 2024-01-01.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import maybe_broadcast

FW, FH, FPS = 1920.0, 1080.0, 25.0
EPOCH_US = 1704067200000000
FEW_VECTORS = 20_000  # embeddings that are sent to every task


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf}/{name}.parquet")


def det(spark: SparkSession, sf: str) -> DataFrame:
    """Detections: one row per event, video and person from the user id."""
    us = F.unix_micros(F.col("ts").cast("timestamp")) - F.lit(EPOCH_US)
    t = F.floor(us / F.lit(6_000_000)).cast("long")
    e, u = F.col("event_id"), F.col("user_id")
    x1 = (u * 197) % 1500 + (e * 7) % 60
    y1 = (u * 131) % 800 + (e * 13) % 40
    return table(spark, sf, "events").select(
        e.alias("seq"), F.floor(u / 30).cast("long").alias("video_id"), (u % 30).alias("person_no"), t.alias("t_ms"),
        F.floor(t * 25 / 1000).cast("long").alias("frame_idx"), F.floor(t / 1000).cast("long").alias("sec"),
        F.when(F.col("event_type").isin("error", "signup"), "object").otherwise("face").alias("kind"), F.col("event_type").alias("label"),
        x1.cast("double").alias("x1"), y1.cast("double").alias("y1"), (x1 + 60 + (e % 5) * 12).cast("double").alias("x2"),
        (y1 + 75 + (e % 5) * 15).cast("double").alias("y2"), (F.round(F.col("value") * 100).cast("long") % 101).alias("score100"),
        (e % 500).alias("noise_vec"), (u % 500).alias("base_vec"),
    )


DET = f"""det AS (
  SELECT event_id AS seq, CAST(floor(user_id/30) AS BIGINT) AS video_id, user_id % 30 AS person_no, t_ms,
    CAST(floor(t_ms*25/1000) AS BIGINT) AS frame_idx, CAST(floor(t_ms/1000) AS BIGINT) AS sec,
    CASE WHEN event_type IN ('error','signup') THEN 'object' ELSE 'face' END AS kind, event_type AS label,
    CAST((user_id*197)%1500 + (event_id*7)%60 AS DOUBLE) AS x1, CAST((user_id*131)%800 + (event_id*13)%40 AS DOUBLE) AS y1,
    CAST((user_id*197)%1500 + (event_id*7)%60 + 60 + (event_id%5)*12 AS DOUBLE) AS x2,
    CAST((user_id*131)%800 + (event_id*13)%40 + 75 + (event_id%5)*15 AS DOUBLE) AS y2,
    CAST(round(value*100) AS BIGINT) % 101 AS score100, event_id % 500 AS noise_vec, user_id % 500 AS base_vec
  FROM (SELECT *, CAST(floor((epoch_us(ts) - {EPOCH_US}) / 6000000) AS BIGINT) AS t_ms FROM events))"""


def faces(spark: SparkSession, sf: str) -> DataFrame:
    return det(spark, sf).where("kind = 'face'")


def objects(spark: SparkSession, sf: str) -> DataFrame:
    return det(spark, sf).where("kind = 'object'")


def clip(spark: SparkSession, sf: str) -> DataFrame:
    """Search hits in three result sets."""
    q, n = F.col("l_quantity").cast("long"), F.col("l_linenumber")
    return table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("set_id"), F.col("l_suppkey").alias("video_id"), F.col("l_orderkey").alias("ok"), n.alias("ln"),
        F.col("l_partkey").alias("part_id"), q.alias("start"), (q + n).alias("end"), F.when(n <= 3, n).alias("rank"),
        F.round(F.col("l_discount") * 100).cast("long").alias("score"),
    )


CLIP = """clip AS (
  SELECT l_returnflag AS set_id, l_suppkey AS video_id, l_orderkey AS ok, l_linenumber AS ln, l_partkey AS part_id,
    CAST(l_quantity AS BIGINT) AS "start", CAST(l_quantity AS BIGINT)+l_linenumber AS "end",
    CASE WHEN l_linenumber<=3 THEN l_linenumber END AS rank, CAST(round(l_discount*100) AS BIGINT) AS score FROM lineitem)"""


def job(spark: SparkSession, sf: str) -> DataFrame:
    """Job manifests, many per video."""
    s = F.col("o_orderstatus")
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("job_id"), F.col("o_custkey").alias("video_id"), F.col("o_orderdate").alias("created_at"),
        F.when(s == "F", "ready").when(s == "O", "processing").otherwise("failed").alias("status"), F.col("o_orderpriority").alias("priority"),
    )


JOB = """job AS (
  SELECT o_orderkey AS job_id, o_custkey AS video_id, o_orderdate AS created_at, o_orderpriority AS priority,
    CASE o_orderstatus WHEN 'F' THEN 'ready' WHEN 'O' THEN 'processing' ELSE 'failed' END AS status FROM orders)"""


def seg(spark: SparkSession, sf: str) -> DataFrame:
    """Raw privacy segments."""
    d, lb = table(spark, sf, "documents"), table(spark, sf, "labels")
    lang = F.col("lang")
    j = d.join(lb, "doc_id", "left")
    s = (F.col("doc_id") * 3) % 600
    return j.select(
        F.col("doc_id").alias("seq"), F.substring("source", 4, 20).cast("long").alias("video_id"), s.alias("start_s"),
        (s + F.col("n_chars") % 7).alias("end_s"), F.col("n_chars").alias("n_chars"),
        F.when(lang == "fr", "Person").when(lang == "en", "id-card").when(lang == "de", "plate").otherwise("mystery").alias("raw_category"),
        F.when(F.col("toxic") == 1, "Critical").when(F.col("quality") == 1, "med").otherwise("low").alias("raw_severity"),
    )


SEG = """seg AS (
  SELECT d.doc_id AS seq, CAST(substr(d.source,4) AS BIGINT) AS video_id, d.doc_id*3 % 600 AS start_s,
    d.doc_id*3 % 600 + n_chars % 7 AS end_s, n_chars,
    CASE d.lang WHEN 'fr' THEN 'Person' WHEN 'en' THEN 'id-card' WHEN 'de' THEN 'plate' ELSE 'mystery' END AS raw_category,
    CASE WHEN l.toxic=1 THEN 'Critical' WHEN l.quality=1 THEN 'med' ELSE 'low' END AS raw_severity
  FROM documents d LEFT JOIN labels l ON d.doc_id=l.doc_id)"""


def with_encoding(spark: SparkSession, sf: str, d: DataFrame, noise: float = 0.2) -> DataFrame:
    """Detections with an encoding: the person's vector plus some noise."""
    e = table(spark, sf, "embeddings").select("vec_id", "embedding")
    used = d.select("base_vec").distinct().union(d.select("noise_vec").distinct()).distinct()
    e = maybe_broadcast(e.join(used.toDF("vec_id"), "vec_id", "left_semi"), FEW_VECTORS)  # else detections move with their vectors
    base = e.select(F.col("vec_id").alias("base_vec"), F.col("embedding").alias("__b"))
    nz = e.select(F.col("vec_id").alias("noise_vec"), F.col("embedding").alias("__n"))
    mix = F.zip_with("__b", "__n", lambda a, b: a.cast("double") + b.cast("double") * noise)
    return d.join(base, "base_vec").join(nz, "noise_vec").withColumn("encoding", mix).drop("__b", "__n")


ENC = """enc AS (
  SELECT d.*, list_transform(list_zip(b.embedding, n.embedding), lambda x: CAST(x[1] AS DOUBLE) + CAST(x[2] AS DOUBLE) * 0.2) AS encoding
  FROM det d JOIN embeddings b ON b.vec_id = d.base_vec JOIN embeddings n ON n.vec_id = d.noise_vec)"""


def islands(src: str, keys: str, gap: float | int, out: str, s: str = "s", e: str = "e") -> str:
    """Merged ranges of the relation ``src`` as the CTEs ``{out}_a``, ``{out}_b``, ``{out}``."""
    return f"""{out}_a AS (
  SELECT {keys}, {s}, {e}, max({e}) OVER (PARTITION BY {keys} ORDER BY {s}, {e} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM {src}),
{out}_b AS (
  SELECT *, sum(CASE WHEN reach IS NULL OR {s} > reach + {gap} THEN 1 ELSE 0 END) OVER (PARTITION BY {keys} ORDER BY {s}, {e} ROWS UNBOUNDED PRECEDING) AS isl FROM {out}_a),
{out} AS (SELECT {keys}, min({s}) AS s, max({e}) AS e FROM {out}_b GROUP BY {keys}, isl)"""


PAD = "pad AS (SELECT video_id, person_no, greatest(0, t_ms-1000) AS s, greatest(0, t_ms+1350) AS e FROM det WHERE kind='face')"
MERGED = islands("pad", "video_id, person_no", 500, "merged")
