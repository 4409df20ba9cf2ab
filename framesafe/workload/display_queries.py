"""Labels, pages, refresh flags, thumbnails, review order."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import payload as P
from ..functions import scalars as S
from ..operators import frames, privacy, review, search
from .bindings import CLIP, DET, SEG, clip, det, seg, table
from .registry import query


@query("relevance_labels", f"""
WITH {CLIP}, g AS (SELECT video_id, part_id, min(rank) AS r, max(score/100.0) AS s FROM clip GROUP BY 1, 2)
SELECT video_id, part_id, CASE WHEN r IS NOT NULL THEN 'Rank ' || greatest(r, 1) WHEN s >= 0.10 THEN 'Highest' WHEN s >= 0.08 THEN 'High' WHEN s >= 0.06 THEN 'Medium' ELSE 'Match' END AS label FROM g""")  # fmt: skip
def relevance_labels(spark, sf):
    c = clip(spark, sf).groupBy("video_id", "part_id").agg(F.collect_list(F.struct("rank", (F.col("score") / 100.0).alias("score"))).alias("clips"))
    return c.select("video_id", "part_id", S.relevance_label(F.col("clips")).alias("label"))


@query("default_operators", """
SELECT o_orderkey, CASE WHEN o_orderstatus='F' THEN 'or' WHEN o_orderkey % 4 > 1 THEN 'and' END AS operator FROM orders""")  # fmt: skip
def default_operators(spark, sf):
    op = F.when(F.col("o_orderstatus") == "F", "or").otherwise("xor")
    return table(spark, sf, "orders").select("o_orderkey", search.default_operator(op, F.col("o_orderkey") % 4).alias("operator"))


@query("needs_refresh", f"""
WITH {DET}, f AS (SELECT video_id, person_no, bool_or(score100 >= 100) AS anon, min(score100) AS lo FROM det WHERE kind='face' GROUP BY 1, 2), l AS (SELECT video_id, bool_or(anon) AS loc, bool_or(lo < 1 AND person_no % 10 = 0) AS miss FROM f GROUP BY 1),
r AS (SELECT video_id, bool_or(score100 >= 100) AS rem FROM det WHERE kind='object' GROUP BY 1)
SELECT l.video_id, miss OR (rem AND NOT loc) AS needs_refresh FROM l JOIN r ON r.video_id=l.video_id""")  # fmt: skip
def needs_refresh(spark, sf):
    d = det(spark, sf)
    f = d.where("kind = 'face'").groupBy("video_id", "person_no").agg(F.bool_or(F.col("score100") >= 100).alias("should_anonymize"), F.min("score100").alias("lo"))
    rank = F.when(~((F.col("lo") < 1) & (F.col("person_no") % 10 == 0)), F.lit(1))
    f = f.withColumns({"priority_rank": rank, "is_official": F.lit(False), "review_required": F.lit(False), "description_match_score": F.lit(0.0), "tags": F.array(F.lit("vip"))})
    p = d.where("kind = 'object'").select("video_id", (F.col("score100") >= 100).alias("should_anonymize"), F.lit(False).alias("is_official"), F.array().cast("array<string>").alias("tags"))
    return review.needs_refresh(f, p, "video_id")


@query("entity_rows", """
SELECT c_custkey % 50 AS job_id, CASE WHEN c_custkey % 5 = 0 THEN 'person_' || c_custkey ELSE c_name END AS name, CASE WHEN c_custkey % 2 = 0 THEN 'd' ELSE 'Detected face: ' || CASE WHEN c_custkey % 5 = 0 THEN 'person_' || c_custkey ELSE c_name END END AS description,
 '{"person_id":"person_' || c_custkey || '","source":"detections"}' AS metadata FROM customer WHERE c_custkey % 3 > 0""")  # fmt: skip
def entity_rows(spark, sf):
    c = F.col("c_custkey")
    f = table(spark, sf, "customer").select(
        (c % 50).alias("job_id"), F.lit("").alias("stable_person_id"), F.lit(None).cast("string").alias("cluster_person_id"), F.concat(F.lit("person_"), c.cast("string")).alias("person_id"),
        F.when(c % 5 > 0, F.col("c_name")).otherwise(" ").alias("name"), F.when(c % 2 == 0, "d").alias("description"), F.when(c % 3 > 0, "s.png").alias("snap_path"),
    )
    return review.entity_rows(f).select("job_id", "name", "description", "metadata")


@query("listing_pages", "SELECT conv_id, count(*) AS items, sum(turn)::BIGINT AS turns FROM conversations GROUP BY 1")
def listing_pages(spark, sf):
    c = table(spark, sf, "conversations")
    body = F.concat(F.lit('{"entities": [{"turn": '), F.col("turn").cast("string"), F.lit("}]}"))
    pages = c.select("conv_id", F.try_parse_json(body).alias("page"))
    items = P.flatten_pages(pages, "page", "conv_id")
    return items.groupBy("conv_id").agg(F.count(F.lit(1)).alias("items"), F.sum(F.try_variant_get("item", "$.turn", "long")).alias("turns"))


@query("thumbnail_choice", f"""
WITH {DET}, s AS (SELECT video_id, person_no, seq % 9 AS pos, max(score100*0.6::DOUBLE) AS m, min((seq % 25)*1.0::DOUBLE) AS d FROM det GROUP BY 1, 2, 3)
SELECT video_id, person_no, pos, m >= 28 AND d >= 10 AS usable FROM (SELECT *, row_number() OVER (PARTITION BY video_id, person_no ORDER BY CASE WHEN m >= 28 AND d >= 10 THEN 0 ELSE 1 END, CASE WHEN m >= 28 AND d >= 10 THEN pos ELSE -(m + d*0.65::DOUBLE - pos*0.8::DOUBLE) END, pos) AS rn FROM s) WHERE rn=1""")  # fmt: skip
def thumbnail_choice(spark, sf):
    s = det(spark, sf).groupBy("video_id", "person_no", (F.col("seq") % 9).alias("pos")).agg(
        F.max(F.col("score100") * 0.6).alias("mean_luma"), F.min((F.col("seq") % 25) * 1.0).alias("std_luma")
    )
    return frames.choose_thumbnail(s, ["video_id", "person_no"])


@query("filtered_events", f"""WITH {SEG} SELECT seq, video_id FROM seg WHERE raw_category='Person' AND raw_severity IN ('Critical','med')""")
def filtered_events(spark, sf):
    s = seg(spark, sf).withColumns({"category": S.norm_category("raw_category"), "severity": S.norm_severity("raw_severity")})
    return review.filter_events(s, ["high", "medium"], "person").select("seq", "video_id")


@query("review_search", "SELECT c_custkey FROM customer WHERE lower(c_name) LIKE '%7%' OR lower(c_mktsegment) LIKE '%7%'")
def review_search(spark, sf):
    items = table(spark, sf, "customer").select("c_custkey", F.lit("face").alias("kind"), F.col("c_name").alias("label"), F.array("c_mktsegment").alias("tags"), F.lit(True).alias("should_anonymize"))
    return review.filter_review(items, " 7 ").select("c_custkey")


@query("numbered_segments", f"WITH {SEG} SELECT seq, video_id, row_number() OVER (PARTITION BY video_id ORDER BY seq) AS position FROM seg")
def numbered_segments(spark, sf):
    return privacy.number_rows(seg(spark, sf), ["video_id"], "seq", "position").select("seq", "video_id", "position")


@query("duration_labels", r"""
SELECT doc_id, CASE WHEN n_chars//3600 > 0 THEN (n_chars//3600) || ':' || lpad(CAST(n_chars%3600//60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(n_chars%60 AS VARCHAR), 2, '0') ELSE (n_chars//60) || ':' || lpad(CAST(n_chars%60 AS VARCHAR), 2, '0') END AS hms,
 CASE WHEN n_chars//3600 > 0 THEN (n_chars//3600) || ' h ' || (n_chars%3600//60) || ' min' ELSE (n_chars//60) || ' min' END AS total, CAST(floor(least(1.0::DOUBLE, n_chars/5000.0::DOUBLE)*100+0.5) AS BIGINT) || '%' AS share FROM documents""")  # fmt: skip
def duration_labels(spark, sf):
    n = F.col("n_chars")
    return table(spark, sf, "documents").select("doc_id", S.sec_to_clock(n, "hmmss").alias("hms"), S.sec_to_clock(n, "total").alias("total"), S.pct_label(n / 5000.0).alias("share"))
