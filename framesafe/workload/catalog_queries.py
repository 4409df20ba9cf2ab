"""Jobs, videos, files, search hits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import catalog, search
from .bindings import CLIP, DET, JOB, clip, det, job, table
from .registry import query


@query("best_job", f"""
WITH {JOB} SELECT video_id, job_id, status, priority FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY created_at DESC, CASE status WHEN 'ready' THEN 3 WHEN 'processing' THEN 2 ELSE 1 END DESC, job_id DESC) AS rn FROM job) WHERE rn=1""")  # fmt: skip
def best_job(spark, sf):
    return catalog.best_job(job(spark, sf)).select("video_id", "job_id", "status", "priority")


@query("dedupe_bindings", f"""
WITH {JOB} SELECT job_id, CASE WHEN rn=1 THEN video_id END AS video_id, rn>1 AS cleared FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY created_at DESC, job_id DESC) AS rn FROM job)""")  # fmt: skip
def dedupe_bindings(spark, sf):
    j = job(spark, sf).withColumn("run_time", F.unix_micros(F.col("created_at").cast("timestamp")))
    return catalog.dedupe_bindings(j).select("job_id", "video_id", "cleared")


@query("upsert_manifests", f"""
WITH {JOB}, o AS (SELECT job_id, video_id, status, priority FROM job WHERE job_id % 3 <> 0), n AS (SELECT job_id, CASE WHEN status<>'failed' THEN status END AS status, 'n' || priority AS priority FROM job WHERE job_id % 2 = 0),
x AS (SELECT job_id, 'ready' AS status FROM job WHERE priority='1-URGENT' AND job_id % 3 <> 0)
SELECT coalesce(o.job_id, n.job_id) AS job_id, o.video_id, coalesce(x.status, n.status, o.status, 'ready') AS status, coalesce(n.priority, o.priority) AS priority FROM o FULL JOIN n ON o.job_id=n.job_id LEFT JOIN x ON x.job_id=coalesce(o.job_id, n.job_id)""")  # fmt: skip
def upsert_manifests(spark, sf):
    j = job(spark, sf)
    old = j.where("job_id % 3 <> 0").select("job_id", "video_id", "status", "priority")
    new = j.where("job_id % 2 = 0").select("job_id", F.when(F.col("status") != "failed", F.col("status")).alias("status"), F.concat(F.lit("n"), "priority").alias("priority"))
    over = j.where("priority = '1-URGENT' AND job_id % 3 <> 0").select("job_id", F.lit("ready").alias("status"))
    return catalog.upsert_manifests(old, new, over)


@query("repair_status", f"WITH {JOB} SELECT job_id, CASE WHEN status='processing' THEN CASE WHEN job_id IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber=7) THEN 'ready' ELSE 'failed' END ELSE status END AS status FROM job")
def repair_status(spark, sf):
    f = table(spark, sf, "lineitem").where("l_linenumber = 7").select(F.col("l_orderkey").alias("job_id"))
    return catalog.repair_status(job(spark, sf), f).select("job_id", "status")


@query("videos_with_jobs", f"""
WITH {JOB}, v AS (SELECT c_custkey AS video_id, c_name AS filename, c_mktsegment AS seg FROM customer), b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY created_at DESC, CASE status WHEN 'ready' THEN 3 WHEN 'processing' THEN 2 ELSE 1 END DESC, job_id DESC) AS rn FROM job) WHERE rn=1)
SELECT v.video_id, b.job_id, CASE WHEN b.priority <> '2-HIGH' THEN b.priority || '.mp4' ELSE v.filename END AS filename, CASE WHEN seg <> 'MACHINERY' THEN seg END AS about, CASE WHEN seg <> 'MACHINERY' THEN 2 END AS topics
FROM v LEFT JOIN b ON b.video_id=v.video_id""".replace("CASE WHEN b.priority <> '2-HIGH' THEN", "CASE WHEN b.priority IS NOT NULL AND b.priority <> '2-HIGH' THEN"))  # fmt: skip
def videos_with_jobs(spark, sf):
    seg = F.col("c_mktsegment")
    meta = F.when(seg != "MACHINERY", F.create_map(F.lit("about"), seg, F.lit("topics"), F.lit('["a","b"]')))
    v = table(spark, sf, "customer").select(F.col("c_custkey").alias("video_id"), F.col("c_name").alias("filename"), meta.alias("user_metadata"))
    j = job(spark, sf).withColumn("video_filename", F.when(F.col("priority") != "2-HIGH", F.concat("priority", F.lit(".mp4"))))
    out = catalog.videos_with_jobs(v, j)
    return out.select("video_id", "job_id", "filename", F.col("overview.about").alias("about"), F.when(F.col("overview").isNotNull(), F.size("overview.topics")).alias("topics"))


@query("recover_jobs", """
WITH v AS (SELECT s_suppkey AS video_id, s_name AS filename FROM supplier), j AS (SELECT o_orderkey AS job_id, CASE WHEN o_orderkey % 2 = 0 THEN o_custkey END AS bound, 'Supplier#' || lpad(CAST(o_custkey % 300 AS VARCHAR), 9, '0') AS fn FROM orders)
SELECT v.video_id, min(job_id) AS job_id, arg_min(CASE WHEN bound IS NOT NULL THEN 'bound' ELSE 'filename' END, job_id) AS how FROM v JOIN j ON (bound = v.video_id OR (bound IS NULL AND lower(fn)=lower(filename))) GROUP BY 1""")  # fmt: skip
def recover_jobs(spark, sf):
    v = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("video_id"), F.col("s_name").alias("filename"))
    o = table(spark, sf, "orders")
    j = o.select(F.col("o_orderkey").alias("job_id"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_custkey")).alias("video_id"),
                 F.concat(F.lit("supplier#"), F.lpad((F.col("o_custkey") % 300).cast("string"), 9, "0")).alias("video_filename"))
    return catalog.recover_jobs(v, j)


@query("infer_source", """
WITH t AS (SELECT c_custkey AS job_id, CAST(c_custkey*97 % 50000 AS DOUBLE) AS tm, 640+(c_custkey%3)*320 AS w, 360+(c_custkey%3)*180 AS h, CAST(c_custkey%50 AS DOUBLE) AS d FROM customer),
f AS (SELECT CASE p_partkey%4 WHEN 0 THEN 'input_' ELSE 'clip_' END || p_partkey AS name, CAST(p_partkey*53 % 50000 AS DOUBLE) AS mt, 640+(p_partkey%4)*320 AS w, 360+(p_partkey%4)*180 AS h, CAST(p_size AS DOUBLE) AS d FROM part),
s AS (SELECT job_id, name AS path, abs(mt-tm) - CASE WHEN name LIKE 'input\\_%' ESCAPE '\\' THEN 45 ELSE 0 END + abs(f.w-t.w)*1.5 + abs(f.h-t.h)*1.5 + CASE WHEN t.d<>0 AND f.d<>0 THEN abs(f.d-t.d)*30 ELSE 0 END AS score FROM t, f)
SELECT job_id, path, score FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY score, path) AS rn FROM s) WHERE rn=1""")  # fmt: skip
def infer_source(spark, sf):
    c, p = F.col("c_custkey"), F.col("p_partkey")
    t = table(spark, sf, "customer").select(c.alias("job_id"), (c * 97 % 50000).cast("double").alias("time"), (640 + (c % 3) * 320).alias("width"), (360 + (c % 3) * 180).alias("height"), (c % 50).cast("double").alias("duration"))
    name = F.concat(F.when(p % 4 == 0, "input_").otherwise("clip_"), p.cast("string"))
    f = table(spark, sf, "part").select(name.alias("path"), name.alias("name"), (p * 53 % 50000).alias("mtime"), (640 + (p % 4) * 320).alias("width"), (360 + (p % 4) * 180).alias("height"), F.col("p_size").cast("double").alias("duration"))
    return catalog.infer_source(t, f, bucket=600.0)


@query("source_videos", """
WITH f AS (SELECT p_partkey, CASE p_partkey%5 WHEN 0 THEN 'redacted_' WHEN 1 THEN 'TMP' WHEN 2 THEN 'person_' ELSE '' END || replace(p_name, ' ', '_') || CASE p_partkey%3 WHEN 0 THEN '.mp4' WHEN 1 THEN '.MOV' ELSE '.txt' END AS name FROM part)
SELECT p_partkey, name FROM f WHERE regexp_matches(lower(name), '\\.(mp4|mov|mkv|avi|m4v|webm)$') AND NOT regexp_matches(lower(name), '^(redacted_|person_|tmp)')""")  # fmt: skip
def source_videos(spark, sf):
    return catalog.list_source_videos(files_of(spark, sf)).select("p_partkey", "name")


@query("orphan_videos", """
WITH f AS (SELECT p_partkey, CASE p_partkey%5 WHEN 0 THEN 'redacted_' WHEN 1 THEN 'TMP' WHEN 2 THEN 'person_' ELSE '' END || replace(p_name, ' ', '_') || CASE p_partkey%3 WHEN 0 THEN '.mp4' WHEN 1 THEN '.MOV' ELSE '.txt' END AS name FROM part)
SELECT p_partkey, name FROM f WHERE lower(name) LIKE 'tmp%' AND regexp_matches(lower(name), '\\.(mp4|mov|mkv|avi|m4v|webm)$')""")  # fmt: skip
def orphan_videos(spark, sf):
    return catalog.list_orphans(files_of(spark, sf)).select("p_partkey", "name")


def files_of(spark, sf):
    p = F.col("p_partkey")
    head = F.when(p % 5 == 0, "redacted_").when(p % 5 == 1, "TMP").when(p % 5 == 2, "person_").otherwise("")
    tail = F.when(p % 3 == 0, ".mp4").when(p % 3 == 1, ".MOV").otherwise(".txt")
    return table(spark, sf, "part").select("p_partkey", F.concat(head, F.replace("p_name", F.lit(" "), F.lit("_")), tail).alias("name"))


@query("job_page", f"WITH {JOB} SELECT job_id, video_id, status FROM job WHERE status IN ('ready','failed') ORDER BY created_at DESC, job_id LIMIT 20 OFFSET 20")
def job_page(spark, sf):
    j = catalog.filter_status(job(spark, sf), ["ready", "failed"])
    return catalog.page(j, 2, 20, [F.col("created_at").desc(), F.col("job_id")]).select("job_id", "video_id", "status")


@query("library_totals", "SELECT n_regionkey AS region_id, n_nationkey AS nation_id, count(*) AS video_count, CAST(sum(c_custkey % 600) AS BIGINT) AS total_duration FROM customer JOIN nation ON n_nationkey=c_nationkey GROUP BY ROLLUP (n_regionkey, n_nationkey)")
def library_totals(spark, sf):
    v = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    v = v.select(F.col("n_regionkey").alias("region_id"), F.col("n_nationkey").alias("nation_id"), (F.col("c_custkey") % 600).alias("duration"))
    return catalog.library_totals(v, ["region_id", "nation_id"])


@query("library_order", """
SELECT s_suppkey AS video_id, row_number() OVER (ORDER BY CASE s_suppkey WHEN 42 THEN 0 WHEN 7 THEN 1 ELSE 2 END, lower(s_name), s_suppkey) AS position FROM supplier""")  # fmt: skip
def library_order(spark, sf):
    from ..operators.privacy import number_rows

    v = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("video_id"), F.col("s_name").alias("title"), F.col("s_suppkey").alias("pos"), F.lit("Uploaded").alias("category"))
    o = catalog.order_library(v, [42, 7], by_name=True)
    # the position is only shown here; Spark keeps the order of a sorted result through the id
    ranked = o.withColumn("__id", F.monotonically_increasing_id()).withColumn("__all", F.lit(1))
    return number_rows(ranked, ["__all"], "__id", "position").select("video_id", "position")


@query("attach_snapshots", """
WITH r AS (SELECT p_partkey, 'person_' || p_partkey AS pid, replace(p_name, ' ', '_') || '_' || p_partkey AS nm, p_brand FROM part),
s AS (SELECT p_brand, CASE p_partkey%3 WHEN 0 THEN 'person_' || p_partkey || '.png' WHEN 1 THEN replace(p_name, ' ', '_') || '_' || p_partkey || '.jpg' ELSE 'x' || p_partkey || '.png' END AS fn FROM part)
SELECT r.p_partkey, a.fn AS snap_filename FROM r LEFT JOIN s a ON a.p_brand=r.p_brand AND a.fn IN (pid || '.png', nm || '.jpg')""")  # fmt: skip
def attach_snapshots(spark, sf):
    p = table(spark, sf, "part")
    key = F.col("p_partkey").cast("string")
    pid, name = F.concat(F.lit("person_"), key), F.concat_ws("_", F.col("p_name"), key)
    snaps = p.select(F.col("p_brand").alias("job_id"), F.when(F.col("p_partkey") % 3 == 0, F.concat(pid, F.lit(".png")))
                     .when(F.col("p_partkey") % 3 == 1, F.concat(S.safe_filename(name), F.lit(".jpg"))).otherwise(F.concat(F.lit("x"), key, F.lit(".png"))).alias("filename"),
                     F.base64(key).alias("snap_base64"))
    rows = p.select(F.col("p_brand").alias("job_id"), "p_partkey", pid.alias("person_id"), name.alias("name")).withColumn("row", F.col("p_partkey"))
    out = catalog.attach_snapshots(rows, snaps, ["job_id"], F.array(S.safe_filename("person_id"), S.safe_filename("name")))
    return out.select("p_partkey", "snap_filename")


# -- search ----------------------------------------------------------------------------------


@query("group_hits", f"""
WITH {CLIP}, o AS (SELECT *, row_number() OVER (PARTITION BY set_id, video_id ORDER BY rank IS NULL, rank, score DESC, "start", "end") AS rn FROM clip)
SELECT set_id, video_id, max(score) AS score, count(*) AS clips, min(rank) AS best_rank, max(CASE WHEN rn=1 THEN "start" END) AS first_start, max(CASE WHEN rn=1 THEN "end" END) AS first_end FROM o GROUP BY 1, 2""")  # fmt: skip
def group_hits(spark, sf):
    c = clip(spark, sf)
    k = ["set_id", "video_id"]
    v = search.video_scores(c, k, "score")
    first = search.rank_clips(c, k, top=1).select(*k, F.col("start").alias("first_start"), F.col("end").alias("first_end"))
    return v.join(first, k)


@query("flatten_hits", f"""
WITH {CLIP} SELECT part_id AS query_id, CAST(video_id AS VARCHAR) AS video_id, score AS item_score, "start" + x AS start_s, "end" + x AS end_s FROM (SELECT *, unnest(CASE WHEN ln=1 THEN [0, 100] ELSE [0] END) AS x FROM clip)""")  # fmt: skip
def flatten_hits(spark, sf):
    c = clip(spark, sf)
    body = lambda d: F.struct((F.col("start") + d).alias("start"), (F.col("end") + d).alias("end"), "score", "rank", F.lit(None).cast("string").alias("thumbnail_url"))
    raw = c.select(F.col("part_id").alias("query_id"), "video_id", "score", "rank", F.lit(None).cast("string").alias("thumbnail_url"),
                   F.when(F.col("ln") > 1, F.col("start")).alias("start"), F.when(F.col("ln") > 1, F.col("end")).alias("end"),
                   F.when(F.col("ln") == 1, F.array(body(0), body(100))).alias("clips"))
    raw = raw.withColumn("video_id", F.col("video_id").cast("string"))
    return search.flatten_hits(raw).select("query_id", "video_id", "item_score", F.col("start").alias("start_s"), F.col("end").alias("end_s"))


@query("dedupe_clips", f"""WITH {CLIP} SELECT DISTINCT set_id, video_id, "start" AS start_s, "end" AS end_s, rank, score FROM clip""")
def dedupe_clips(spark, sf):
    c = search.dedupe_clips(clip(spark, sf), ["set_id", "video_id"])
    return c.withColumnsRenamed({"start": "start_s", "end": "end_s"})


@query("top_clips", f"""
WITH {CLIP}, d AS (SELECT DISTINCT video_id, "start", "end", rank, score FROM clip)
SELECT video_id, pos AS clip_pos, "start" AS start_s, "end" AS end_s, score FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY rank IS NULL, rank, score DESC, "start", "end") AS pos FROM d) WHERE pos <= 5""")  # fmt: skip
def top_clips(spark, sf):
    c = search.rank_clips(search.dedupe_clips(clip(spark, sf), ["video_id"]), ["video_id"], top=5)
    return c.select("video_id", F.col("clip_pos").cast("long").alias("clip_pos"), F.col("start").alias("start_s"), F.col("end").alias("end_s"), "score")


def sets(spark, sf):
    """Result sets by part: one set per return flag."""
    c = table(spark, sf, "lineitem")
    return c.select(F.col("l_returnflag").alias("set_id"), F.col("l_partkey").alias("video_id"), F.col("l_quantity").cast("long").alias("start"),
                    (F.col("l_quantity").cast("long") + F.col("l_linenumber")).alias("end"), F.col("l_linenumber").alias("rank"),
                    F.round(F.col("l_discount") * 100).cast("long").alias("score"))


SETS = """st AS (SELECT l_returnflag AS set_id, l_partkey AS video_id, CAST(l_quantity AS BIGINT) AS "start", CAST(l_quantity AS BIGINT)+l_linenumber AS "end", l_linenumber AS rank, CAST(round(l_discount*100) AS BIGINT) AS score FROM lineitem),
dd AS (SELECT DISTINCT video_id, "start", "end", rank, score FROM st), cn AS (SELECT video_id, count(*) AS clips FROM dd GROUP BY 1)"""


def combined(spark, sf, op):
    c = sets(spark, sf)
    v, kept = search.combine_hits(c, "set_id", op, n_sets=3, score="score")
    n = kept.groupBy("video_id").agg(F.count(F.lit(1)).alias("clips"))
    return v.join(n, "video_id")


@query("hits_or", f"WITH {SETS} SELECT st.video_id, max(score) AS score, max(clips) AS clips FROM st JOIN cn ON cn.video_id=st.video_id GROUP BY 1")
def hits_or(spark, sf):
    return combined(spark, sf, "or")


@query("hits_and", f"WITH {SETS} SELECT st.video_id, max(score) AS score, max(clips) AS clips FROM st JOIN cn ON cn.video_id=st.video_id GROUP BY 1 HAVING count(DISTINCT set_id)=3")
def hits_and(spark, sf):
    return combined(spark, sf, "and")


@query("hits_with_videos", f"""
WITH {CLIP}, v AS (SELECT video_id, max(score) AS score, min(rank) AS best_rank FROM clip GROUP BY 1), cat AS (SELECT s_suppkey AS video_id, CASE WHEN s_suppkey%5>0 THEN s_name ELSE '' END AS filename, s_suppkey*11 % 700 AS duration FROM supplier)
SELECT v.video_id, coalesce(nullif(filename, ''), CAST(v.video_id AS VARCHAR)) AS title, coalesce(duration/60.0::DOUBLE, 0) AS total_minutes, score, row_number() OVER (ORDER BY score DESC, v.video_id) AS position FROM v LEFT JOIN cat ON cat.video_id=v.video_id""")  # fmt: skip
def hits_with_videos(spark, sf):
    from ..operators.privacy import number_rows

    v = search.video_scores(clip(spark, sf), ["video_id"], "score")
    s = F.col("s_suppkey")
    cat = table(spark, sf, "supplier").select(s.alias("video_id"), F.when(s % 5 > 0, F.col("s_name")).otherwise("").alias("filename"), (s * 11 % 700).alias("duration"))
    o = search.order_hits(search.hits_with_videos(v, cat)).withColumn("__id", F.monotonically_increasing_id()).withColumn("__all", F.lit(1))
    return number_rows(o, ["__all"], "__id", "position").select("video_id", "title", "total_minutes", "score", "position")


@query("entity_ranges", f"""WITH {CLIP} SELECT video_id, part_id AS entity_id, "start" AS start_s, "end" AS end_s FROM clip WHERE part_id IN (SELECT p_partkey FROM part WHERE p_brand='Brand#7')""")
def entity_ranges(spark, sf):
    want = table(spark, sf, "part").where("p_brand = 'Brand#7'").select(F.col("p_partkey").alias("entity_id"))
    h = clip(spark, sf).withColumnRenamed("part_id", "entity_id").join(want, "entity_id", "left_semi")
    return search.entity_ranges(h).withColumnsRenamed({"start": "start_s", "end": "end_s"})


@query("fallback_hits", f"""
WITH {DET}, {CLIP}, h AS (SELECT video_id, "start" AS s, "end" AS e, rank FROM clip WHERE score >= 10 AND ln=1), g AS (SELECT DISTINCT person_no AS video_id, sec AS s, sec+2 AS e FROM det WHERE label='view')
SELECT video_id, s AS start_s, e AS end_s, CAST(rank AS INTEGER) AS rank FROM h UNION ALL SELECT video_id, s, e, CAST(row_number() OVER (PARTITION BY video_id ORDER BY s, e) AS INTEGER) FROM g WHERE video_id NOT IN (SELECT video_id FROM h)""")  # fmt: skip
def fallback_hits(spark, sf):
    h = clip(spark, sf).where("score >= 10 AND ln = 1").select("video_id", "start", "end", "rank")
    g = det(spark, sf).where("label = 'view'").select(F.col("person_no").alias("video_id"), F.col("sec").alias("start"), (F.col("sec") + 2).alias("end")).distinct()
    return search.fallback_hits(h, g, ["video_id"]).withColumnsRenamed({"start": "start_s", "end": "end_s"})


@query("latest_sessions", "SELECT o_custkey AS session_id, max(o_orderkey) AS seq FROM orders GROUP BY 1")
def latest_sessions(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("session_id"), F.col("o_orderkey").alias("seq"))
    return search.latest_sessions(o).select("session_id", "seq")


SERIES = f"""{CLIP}, tp AS (SELECT video_id, coalesce(max(rank), 0) AS top FROM clip GROUP BY 1),
c AS (SELECT clip.video_id, greatest(0, CAST(floor("start"/60.0::DOUBLE*120) AS INTEGER)) AS i0, rank, score, top, "start", "end" FROM clip JOIN tp ON tp.video_id=clip.video_id WHERE least("end", 60) > least("start", 60)),
d AS (SELECT *, least(119, greatest(i0, CAST(ceil(least("end", 60)/60.0::DOUBLE*120) AS INTEGER)-1)) AS i1,
  CASE WHEN rank IS NOT NULL AND top > 0 THEN greatest(0.12::DOUBLE, least(1.0::DOUBLE, greatest(0.22::DOUBLE, least(1.0::DOUBLE, greatest(0.22::DOUBLE, 1 - floor((rank-1)/10)*0.16::DOUBLE)*(0.94::DOUBLE + (1-((rank-1)%10)/9.0::DOUBLE)*0.06::DOUBLE)))*greatest(0.7::DOUBLE, least(1.0::DOUBLE, 0.78::DOUBLE+score/100.0::DOUBLE*2.2::DOUBLE))))
   ELSE greatest(0.18::DOUBLE, least(0.42::DOUBLE, greatest(0.7::DOUBLE, least(1.0::DOUBLE, 0.78::DOUBLE+score/100.0::DOUBLE*2.2::DOUBLE))*CASE WHEN top>0 THEN 0.55::DOUBLE ELSE 1 END)) END AS imp FROM c),
b AS (SELECT *, unnest(generate_series(i0, i1)) AS bucket FROM (SELECT DISTINCT video_id, i0, i1, imp FROM d)),
v AS (SELECT video_id, bucket, max(imp*(0.26::DOUBLE + 0.74::DOUBLE*pow(greatest(0, sin(pi()*CASE WHEN greatest(1, i1-i0)<=1 THEN 0.5::DOUBLE ELSE (bucket-i0)/CAST(greatest(1, i1-i0) AS DOUBLE) END)), 0.82::DOUBLE))) AS v FROM b GROUP BY 1, 2),
g AS (SELECT tp.video_id, x.bucket, coalesce(v.v, 0) AS v FROM tp, (SELECT unnest(generate_series(0, 119)) AS bucket) x LEFT JOIN v ON v.video_id=tp.video_id AND v.bucket=x.bucket),
s AS (SELECT video_id, bucket, coalesce(lag(v) OVER w, v)*0.18::DOUBLE + v*0.64::DOUBLE + coalesce(lead(v) OVER w, v)*0.18::DOUBLE AS s FROM g WINDOW w AS (PARTITION BY video_id ORDER BY bucket)),
z AS (SELECT video_id, bucket, pow(least(1.0::DOUBLE, s/greatest(max(s) OVER (PARTITION BY video_id), 0.001::DOUBLE)), 1.28::DOUBLE) AS value FROM s)"""


def series(spark, sf, bars=None):
    c = clip(spark, sf).withColumn("score", F.col("score") / 100.0)
    return search.search_series(c, ["video_id"], F.lit(60.0), 120, bars)


@query("search_series", f"WITH {SERIES} SELECT video_id, bucket, round(value + 1e-9, 6) AS value FROM z")
def search_series(spark, sf):
    return series(spark, sf).withColumn("value", F.round(F.col("value") + 1e-9, 6))


@query("search_bars", f"""
WITH {SERIES}, m AS (SELECT video_id, bar, max(value) AS value FROM z, (SELECT unnest(generate_series(0, 71)) AS bar) WHERE bucket >= floor(bar/72.0::DOUBLE*120) AND bucket < greatest(floor(bar/72.0::DOUBLE*120)+1, floor((bar+1)/72.0::DOUBLE*120)) GROUP BY 1, 2)
SELECT video_id, bar, round(value + 1e-9, 6) AS value, max(value) OVER (PARTITION BY video_id) > 0.05 AND value >= max(value) OVER (PARTITION BY video_id)*0.52::DOUBLE AS is_peak FROM m""")  # fmt: skip
def search_bars(spark, sf):
    return series(spark, sf, 72).withColumn("value", F.round(F.col("value") + 1e-9, 6))


@query("waveform", """
WITH s AS (SELECT l_suppkey AS ch, l_quantity - 25 AS v, l_orderkey*8 + l_linenumber AS i FROM lineitem),
z AS (SELECT ch, max(i)+1 AS len, greatest(1, CAST(floor((max(i)+1)/32) AS BIGINT)) AS w FROM s GROUP BY 1),
b AS (SELECT s.ch, least(31, CAST(floor(i/w) AS BIGINT)) AS bucket, abs(v) AS a, i, len, w FROM s JOIN z ON z.ch=s.ch),
q AS (SELECT ch, bucket, max(a) AS a FROM b GROUP BY 1, 2),
p AS (SELECT z.ch, x.bucket, coalesce(a, 0) AS p FROM z CROSS JOIN (SELECT unnest(generate_series(0, 31)) AS bucket) x LEFT JOIN q ON q.ch=z.ch AND q.bucket=x.bucket),
r AS (SELECT ch, list_sort(list(p) FILTER (p > 0)) AS l FROM p GROUP BY 1)
SELECT p.ch, p.bucket, round(pow(least(1.0::DOUBLE, p/greatest(l[CAST(floor(len(l)*0.96::DOUBLE) AS BIGINT)+1], 0.001::DOUBLE)), 0.72::DOUBLE) + 1e-9, 6) AS value FROM p JOIN r ON r.ch=p.ch""")  # fmt: skip
def waveform(spark, sf):
    i = (F.col("l_orderkey") * 8 + F.col("l_linenumber")).cast("long")
    s = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("ch"), (F.col("l_quantity") - 25).alias("v"), i.alias("i"))
    return search.waveform(s, ["ch"], 32).withColumn("value", F.round(F.col("value") + 1e-9, 6))
