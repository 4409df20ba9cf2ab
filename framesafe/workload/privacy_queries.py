"""Privacy segments, events, actions, preview; payloads and texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import payload as P
from ..functions import scalars as S
from ..operators import privacy
from ..plans.jobs import normalize_privacy
from .bindings import SEG, seg, table
from .registry import query

CAT = "CASE replace(replace(lower(raw_category),'-','_'),' ','_') WHEN 'person' THEN 'person' WHEN 'id_card' THEN 'document' WHEN 'plate' THEN 'license_plate' ELSE 'scene' END"
SEV = "CASE lower(raw_severity) WHEN 'critical' THEN 'high' WHEN 'med' THEN 'medium' WHEN 'low' THEN 'low' ELSE 'medium' END"
ACT = "CASE {c} WHEN 'person' THEN 'select_detected_entity' WHEN 'document' THEN 'draw_custom_region_prompt' WHEN 'license_plate' THEN 'draw_custom_region_prompt' ELSE 'create_review_bookmark' END"
NORM = f"""{SEG}, nz AS (SELECT *, {CAT} AS category, {SEV} AS severity FROM seg), nrm AS (SELECT *, {ACT.format(c="category")} AS action_type FROM nz)"""


def normed(spark, sf):
    s = seg(spark, sf)
    s = s.withColumns({"category": S.norm_category("raw_category"), "severity": S.norm_severity("raw_severity")})
    return s.withColumn("action_type", S.norm_action(F.lit(None).cast("string"), "category"))


@query("norm_segments", f"WITH {NORM} SELECT seq, video_id, category, severity, action_type FROM nrm")
def norm_segments(spark, sf):
    return normed(spark, sf).select("seq", "video_id", "category", "severity", "action_type")


@query("risk_levels", f"""
WITH {NORM} SELECT video_id, count(*) AS events, CASE WHEN bool_or(severity='high') THEN 'high' WHEN bool_or(severity='medium') THEN 'medium' ELSE 'low' END AS privacy_risk_level,
 'Analysis found ' || count(*) || ' privacy review segment' || CASE WHEN count(*)=1 THEN '' ELSE 's' END || ' for this video.' AS overall_summary FROM nrm GROUP BY 1""")  # fmt: skip
def risk_levels(spark, sf):
    return privacy.risk_summary(normed(spark, sf), ["video_id"])


def event_rows(spark, sf):
    """Segments with labels, entities and texts, as the merge reads them."""
    n = normed(spark, sf)
    return n.select(
        "video_id", "seq", F.col("start_s").cast("double").alias("start_sec"), F.col("end_s").cast("double").alias("end_sec"), "category", "severity",
        "action_type", (F.col("n_chars") % 100 / 100.0).alias("confidence"), F.concat(F.lit("Label "), (F.col("n_chars") % 2).cast("string")).alias("label"),
        F.substring(F.lit("abcdefghij"), F.lit(1), (F.col("n_chars") % 10).cast("int")).alias("description"), F.concat(F.lit("r"), (F.col("n_chars") % 1000).cast("string")).alias("reason"),
        F.lit("").alias("object_class"), F.when(F.col("seq") % 3 > 0, F.concat(F.lit("E"), (F.col("n_chars") % 2).cast("string"))).otherwise("").alias("entity_hint"),
        F.lit("").alias("redaction_target"), F.lit("").alias("scene_role"),
    )


ROWS = f"""{NORM}, ev AS (SELECT video_id, seq, CAST(start_s AS DOUBLE) AS ss, CAST(end_s AS DOUBLE) AS es, category, severity, action_type, (n_chars%100)/100.0::DOUBLE AS conf, 'Label ' || (n_chars%2) AS label,
 substr('abcdefghij', 1, CAST(n_chars%10 AS INTEGER)) AS descr, 'r' || (n_chars%1000) AS reason, CASE WHEN seq%3>0 THEN 'E' || (n_chars%2) ELSE '' END AS ent FROM nrm),
o AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY seq) AS rn FROM ev),
mr AS (SELECT video_id, rn, 1 AS run, seq AS head, ss, es, category, severity, action_type, conf, label, descr, reason, ent FROM o WHERE rn=1
 UNION ALL SELECT p.video_id, p.rn, CASE WHEN j THEN m.run ELSE m.run+1 END, CASE WHEN j THEN m.head ELSE p.seq END, CASE WHEN j THEN least(m.ss,p.ss) ELSE p.ss END, CASE WHEN j THEN greatest(m.es,p.es) ELSE p.es END,
  p.category, p.severity, p.action_type, CASE WHEN j THEN greatest(m.conf,p.conf) ELSE p.conf END, CASE WHEN j THEN m.label ELSE p.label END,
  CASE WHEN j AND length(p.descr)<=length(m.descr) THEN m.descr ELSE p.descr END, CASE WHEN j AND length(p.reason)<=length(m.reason) THEN m.reason ELSE p.reason END, CASE WHEN j THEN m.ent ELSE p.ent END
 FROM mr m JOIN o p ON p.video_id=m.video_id AND p.rn=m.rn+1, LATERAL (SELECT p.ss <= m.es+2 AND p.category=m.category AND p.severity=m.severity AND p.action_type=m.action_type AND CASE WHEN m.ent<>'' AND p.ent<>'' THEN m.ent=p.ent ELSE m.label=p.label END AS j) q),
me AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY video_id, run ORDER BY rn DESC) AS back, count(*) OVER (PARTITION BY video_id, run) AS members FROM mr) WHERE back=1)"""


@query("merge_events", f"""
WITH RECURSIVE {ROWS} SELECT video_id, head AS seq, ss AS start_sec, es AS end_sec, category, severity, conf AS confidence, label, descr AS description, reason, ent AS entity_hint, CAST(members AS INTEGER) AS members FROM me""")  # fmt: skip
def merge_events(spark, sf):
    m = privacy.merge_events(event_rows(spark, sf), ["video_id"])
    return m.select("video_id", "seq", "start_sec", "end_sec", "category", "severity", "confidence", "label", "description", "reason", "entity_hint", "members")


ACTIONS = f"""{ROWS}, e2 AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY head) AS n FROM me),
ac AS (SELECT video_id, action_type, lower(ent) AS k1, lower(label) AS k2, min(n) AS n0, max(conf) AS confidence, min(ss) AS start_sec, max(es) AS end_sec, count(*) AS events,
  arg_min(label, n) AS label, arg_min(ent, n) AS ent, min((CAST(1000-length(reason) AS BIGINT))*100000 + n) AS rk FROM e2 GROUP BY 1, 2, 3, 4),
a2 AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY n0) AS pos FROM ac)"""


@query("merge_actions", f"""
WITH RECURSIVE {ACTIONS} SELECT a2.video_id, 'act_' || lpad(CAST(pos AS VARCHAR), CAST(greatest(3, length(CAST(pos AS VARCHAR))) AS INTEGER), '0') AS action_id, a2.action_type, a2.label, confidence, r.reason, start_sec, end_sec, events,
 a2.label || ': ' || replace(a2.action_type, '_', ' ') AS action_label, CASE WHEN a2.action_type IN ('select_detected_entity','select_object_class') THEN 'automatic_if_matched' ELSE 'review_only' END AS apply_mode
FROM a2 JOIN e2 r ON r.video_id=a2.video_id AND r.n = a2.rk % 100000""")  # fmt: skip
def merge_actions(spark, sf):
    _, a = merged(spark, sf)
    return a.select("video_id", "action_id", "action_type", "label", "confidence", "reason", "start_sec", "end_sec", "events", "action_label", "apply_mode")


def merged(spark, sf):
    return privacy.merge_actions(privacy.merge_events(event_rows(spark, sf), ["video_id"]), ["video_id"])


@query("event_actions", f"""
WITH RECURSIVE {ACTIONS} SELECT e2.video_id, 'evt_' || lpad(CAST(n AS VARCHAR), CAST(greatest(3, length(CAST(n AS VARCHAR))) AS INTEGER), '0') AS event_id, 'act_' || lpad(CAST(pos AS VARCHAR), CAST(greatest(3, length(CAST(pos AS VARCHAR))) AS INTEGER), '0') AS action_id
FROM e2 JOIN a2 ON a2.video_id=e2.video_id AND a2.action_type=e2.action_type AND k1=lower(e2.ent) AND k2=lower(e2.label)""")  # fmt: skip
def event_actions(spark, sf):
    e, _ = merged(spark, sf)
    return e.select("video_id", "event_id", "action_id")


@query("apply_preview", f"""
WITH RECURSIVE {ACTIONS}, fc AS (SELECT c_custkey%20 AS video_id, c_custkey AS pos, 'person_' || c_custkey AS pid, 'e' || (c_custkey%4) AS eid, c_name AS nm FROM customer),
mt AS (SELECT a2.video_id, a2.pos, min(fc.pos) AS fp FROM a2 JOIN fc ON fc.video_id=a2.video_id AND (eid=lower(a2.ent) OR contains(lower(a2.label || ': ' || replace(action_type,'_',' ')) || ' ' || '', eid)) WHERE action_type='select_detected_entity' GROUP BY 1, 2)
SELECT a2.video_id, 'act_' || lpad(CAST(a2.pos AS VARCHAR), CAST(greatest(3, length(CAST(a2.pos AS VARCHAR))) AS INTEGER), '0') AS action_id, CASE WHEN fp IS NOT NULL THEN 'can_apply' ELSE 'review_only' END AS route,
 CASE WHEN fp IS NULL AND action_type='select_detected_entity' THEN 'create_review_bookmark' ELSE action_type END AS type, CASE WHEN fp IS NOT NULL THEN 'face-person_' || fp END AS selection_id
FROM a2 LEFT JOIN mt ON mt.video_id=a2.video_id AND mt.pos=a2.pos""")  # fmt: skip
def apply_preview(spark, sf):
    _, a = merged(spark, sf)
    c = F.col("c_custkey")
    faces = table(spark, sf, "customer").select((c % 20).alias("video_id"), c.alias("pos"), F.concat(F.lit("e"), (c % 4).cast("string")).alias("entity_id"),
                                                F.concat(F.lit("person_"), c.cast("string")).alias("person_id"), F.col("c_name").alias("name"), F.lit("").alias("description"))
    objects = table(spark, sf, "part").select((F.col("p_partkey") % 20).alias("video_id"), F.col("p_partkey").alias("pos"), F.lower("p_type").alias("identification"))
    a = a.withColumn("reason", F.lit(""))
    p = privacy.apply_preview(a, faces, objects, ["video_id"])
    return p.select("video_id", "action_id", "route", "type", "selection_id")


@query("event_groups", f"""
WITH {NORM}, g AS (SELECT 'high' AS event_group, severity, category FROM nrm WHERE severity='high' UNION ALL SELECT CASE WHEN category IN ('person','face') THEN 'people' WHEN category IN ('screen','document','text','license_plate') THEN 'sensitive' ELSE 'objects' END, severity, category FROM nrm)
SELECT event_group, count(*) AS events, count(*) FILTER (severity='low') AS n_low, count(*) FILTER (severity='medium') AS n_medium, count(*) FILTER (severity='high') AS n_high, count(DISTINCT category) AS categories FROM g GROUP BY 1""")  # fmt: skip
def event_groups(spark, sf):
    return privacy.event_groups(normed(spark, sf))


@query("keep_rule", """
WITH d AS (SELECT doc_id, lower(text) AS t, CASE lang WHEN 'en' THEN 'person' WHEN 'de' THEN 'face' ELSE 'document' END AS category, CASE doc_id%11 WHEN 0 THEN 'No Redaction' ELSE 'redact' END AS dec, CASE doc_id%7 WHEN 0 THEN 'Judge' WHEN 1 THEN 'defendant' ELSE '' END AS role FROM documents)
SELECT doc_id FROM d WHERE dec<>'No Redaction' AND (category='document' OR role='defendant'
 OR regexp_matches(' ' || t, 'main verdict subject|verdict subject|defendant|respondent|accused|sentencing subject|protected witness|victim|minor|vulnerable|private non-party|private non party|protected person')
 OR NOT (role='Judge' OR regexp_matches(t || ' ' || lower(role), 'judge|lawyer|attorney|clerk|officer|jury|juror|audience|reporter|bystander|court staff|surrounding courtroom|courtroom participant|person is visible|visible person|face is visible|visible face|appears in the courtroom|shown in the courtroom')))""")  # fmt: skip
def keep_rule(spark, sf):
    d = table(spark, sf, "documents")
    blank = [F.lit("").alias(c) for c in ("label", "reason", "inclusion_reason", "redaction_target", "subject_selection")]
    i = F.col("doc_id")
    rows = d.select("doc_id", F.col("text").alias("description"), F.when(F.col("lang") == "en", "person").when(F.col("lang") == "de", "face").otherwise("document").alias("category"),
                    F.when(i % 11 == 0, "No Redaction").otherwise("redact").alias("redaction_decision"), F.when(i % 7 == 0, "Judge").when(i % 7 == 1, "defendant").otherwise("").alias("scene_role"), *blank)
    return privacy.keep_privacy_target(rows).select("doc_id")


def payloads(spark, sf):
    """Raw task payload text per video from the segment view: a fenced result under one of several keys."""
    s = seg(spark, sf)
    one = F.to_json(F.struct(
        (F.col("start_s")).alias("start_time"), F.struct(F.col("end_s").alias("end"), F.col("raw_severity").alias("risk_level")).alias("fields"),
        F.col("raw_category").alias("category"), F.concat(F.lit("L"), F.col("n_chars") % 2).alias("label"), F.lit("protected person").alias("reason"),
        (F.col("n_chars") % 100 / 100.0).cast("string").alias("confidence"),
    ))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", one.alias("j")))), lambda x: x["j"]), ",")
    g = s.groupBy("video_id").agg(body.alias("b"))
    text = F.when(F.col("video_id") % 3 == 0, F.concat(F.lit('```json\n{"result": {"segments": ['), "b", F.lit("]}}\n```")))
    text = text.when(F.col("video_id") % 3 == 1, F.concat(F.lit('{"data": ['), "b", F.lit("]}"))).otherwise(F.concat(F.lit('{"output": {"privacy_risk_segment": ['), "b", F.lit("]}}")))
    return g.select("video_id", text.alias("payload"))


@query("privacy_events", f"""
WITH RECURSIVE {NORM}, o AS (SELECT *, 'l' || (n_chars%2) AS lab, (n_chars%100)/100.0::DOUBLE AS conf, CAST(start_s AS DOUBLE) AS ss, CASE WHEN end_s=start_s THEN end_s+1.0 ELSE CAST(end_s AS DOUBLE) END AS es, row_number() OVER (PARTITION BY video_id ORDER BY seq) AS rn FROM nrm),
mr AS (SELECT video_id, rn, 1 AS run, ss, es, category, severity, conf, lab FROM o WHERE rn=1 UNION ALL
 SELECT p.video_id, p.rn, CASE WHEN j THEN m.run ELSE m.run+1 END, CASE WHEN j THEN least(m.ss,p.ss) ELSE p.ss END, CASE WHEN j THEN greatest(m.es,p.es) ELSE p.es END, p.category, p.severity, CASE WHEN j THEN greatest(m.conf,p.conf) ELSE p.conf END, CASE WHEN j THEN m.lab ELSE p.lab END
 FROM mr m JOIN o p ON p.video_id=m.video_id AND p.rn=m.rn+1, LATERAL (SELECT p.ss <= m.es+2 AND p.category=m.category AND p.severity=m.severity AND m.lab=p.lab AS j) q)
SELECT video_id, 'evt_' || lpad(CAST(run AS VARCHAR), CAST(greatest(3, length(CAST(run AS VARCHAR))) AS INTEGER), '0') AS event_id, max_by(ss, rn) AS start_sec, max_by(es, rn) AS end_sec, max_by(category, rn) AS category, max_by(severity, rn) AS severity, max_by(conf, rn) AS confidence FROM mr GROUP BY video_id, run""")  # fmt: skip
def privacy_events(spark, sf):
    return normalize_privacy(payloads(spark, sf), ["video_id"])["events"].select("video_id", "event_id", "start_sec", "end_sec", "category", "severity", "confidence")


@query("privacy_summary")
def privacy_summary(spark, sf):
    return normalize_privacy(payloads(spark, sf), ["video_id"])["summary"]


# -- texts and payload fields ----------------------------------------------------------------


@query("parsed_props", "SELECT event_id, CAST(json_extract(props, '$.k') AS DOUBLE) AS k, CAST(json_extract(props, '$.k') AS BIGINT) % 2 = 1 AS odd FROM events")
def parsed_props(spark, sf):
    v = P.fenced_json(F.col("props"))
    k = P.number_of(P.get(v, "k"))
    return table(spark, sf, "events").select("event_id", k.alias("k"), S.lenient_bool((k % 2).cast("string")).alias("odd"))


@query("fenced_segments", """SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS start_sec, CAST(json_extract(props, '$.k') AS BIGINT) + 3 AS end_sec FROM events""")
def fenced_segments(spark, sf):
    k = F.regexp_extract("props", r"(\d+)", 1)
    text = F.concat(F.lit('Here it is:\n```json\n{"items": [{"values": {"end_time": "'), (k.cast("int") + 3).cast("string"), F.lit('"}, "time": {"start": '), k, F.lit("}}]}\n```"))
    e = table(spark, sf, "events").select("event_id", text.alias("payload"))
    rows = privacy.explode_segments(e, ["event_id"])
    m = F.col("fields")
    return rows.select("event_id", P.segment_time(m, True).cast("long").alias("start_sec"), P.segment_time(m, False).cast("long").alias("end_sec"))


@query("task_status", "SELECT o_orderkey AS job_id, CASE o_orderstatus WHEN 'F' THEN 'ready' WHEN 'O' THEN 'queued' ELSE 'processing' END AS status, 't' || o_orderkey AS task_id FROM orders")
def task_status(spark, sf):
    word = F.when(F.col("o_orderstatus") == "F", "Completed").when(F.col("o_orderstatus") == "O", " pending ").otherwise("running")
    o = table(spark, sf, "orders").select("o_orderkey", F.to_json(F.struct(word.alias("state"), F.concat(F.lit(" t"), F.col("o_orderkey")).alias("_id"))).alias("j"))
    v = F.try_parse_json("j")
    return o.select(F.col("o_orderkey").alias("job_id"), P.task_status(v).alias("status"), P.task_id(v).alias("task_id"))


@query("timestamp_mentions", r"""SELECT doc_id, len(l) AS mentions, coalesce(l[1], '') AS first_mention FROM (SELECT doc_id, regexp_extract_all(text, '(\d{1,2}:\d{2}(?::\d{2})?)', 1) AS l FROM documents)""")
def timestamp_mentions(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", S.extract_timestamps("text").alias("l"))
    return d.select("doc_id", F.size("l").cast("long").alias("mentions"), F.coalesce(F.try_element_at("l", F.lit(1)), F.lit("")).alias("first_mention"))


@query("clock_labels", r"""
WITH d AS (SELECT doc_id, n_chars, n_chars/8.0 AS s FROM documents)
SELECT doc_id, lpad(CAST(CAST(floor(s/60) AS BIGINT) AS VARCHAR), CAST(greatest(2, length(CAST(CAST(floor(s/60) AS BIGINT) AS VARCHAR))) AS INTEGER), '0') || ':' || lpad(CAST(CAST(floor(s) AS BIGINT)%60 AS VARCHAR), 2, '0') AS mmss,
 lpad(CAST(CAST(floor(s/60) AS BIGINT) AS VARCHAR), CAST(greatest(2, length(CAST(CAST(floor(s/60) AS BIGINT) AS VARCHAR))) AS INTEGER), '0') || ':' || lpad(CAST(CAST(floor(s) AS BIGINT)%60 AS VARCHAR), 2, '0') || '.' || lpad(CAST((n_chars%8)*125 AS VARCHAR), 3, '0') AS millis,
 CAST(floor(s) AS BIGINT) AS back FROM d""")  # fmt: skip
def clock_labels(spark, sf):
    s = F.col("n_chars") / 8.0
    d = table(spark, sf, "documents").select("doc_id", S.sec_to_clock(s, "mmss").alias("mmss"), S.sec_to_clock(s, "millis").alias("millis"))
    return d.withColumn("back", S.clock_to_sec("mmss").cast("long"))


@query("conversation_tags", r"""
SELECT conv_id, turn, len(l) AS tags, array_to_string(l, '|') AS joined FROM (SELECT conv_id, turn, list_filter(list_transform(string_split(text, ','), lambda x: trim(x, ' ')), lambda x: x <> '') AS l FROM conversations)""")  # fmt: skip
def conversation_tags(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "turn", S.parse_tags("text").alias("l"))
    return c.select("conv_id", "turn", F.size("l").cast("long").alias("tags"), F.array_join("l", "|").alias("joined"))


@query("cache_keys", """
SELECT page_id, sha256(k) AS digest, 'assist_' || substr(sha256(k), 1, 16) AS artifact_id FROM (SELECT page_id, page_id || '|video:' || page_id || '|updated:|indexed:' || length(html) || '|filename:' || url || '|1.2|v4' AS k FROM pages)""")  # fmt: skip
def cache_keys(spark, sf):
    p = F.col("page_id").cast("string")
    fp = S.source_fingerprint(p, F.lit(None).cast("string"), F.length("html"), F.col("url"))
    k = S.cache_key(p, fp, "1.2", "v4")
    return table(spark, sf, "pages").select("page_id", S.digest(k).alias("digest"), S.artifact_id(k, "assist_").alias("artifact_id"))


@query("safe_names", r"""
SELECT page_id, coalesce(nullif(regexp_replace(regexp_replace(trim(url), '[^A-Za-z0-9_.-]+', '_', 'g'), '^[._]+|[._]+$', '', 'g'), ''), 'video') AS safe_id,
 CASE WHEN lower(regexp_replace(split_part(url, '/', -1), '[^A-Za-z0-9_.-]+', '_', 'g')) LIKE '%.mp4' THEN regexp_replace(split_part(url, '/', -1), '[^A-Za-z0-9_.-]+', '_', 'g') ELSE coalesce(nullif(regexp_replace(split_part(url, '/', -1), '[^A-Za-z0-9_.-]+', '_', 'g'), ''), 'redacted-video.mp4') || CASE WHEN split_part(url, '/', -1)='' THEN '' ELSE '.mp4' END END AS mp4_name FROM pages""")  # fmt: skip
def safe_names(spark, sf):
    return table(spark, sf, "pages").select("page_id", S.safe_id("url").alias("safe_id"), S.ensure_mp4("url").alias("mp4_name"))


@query("export_sizes", """
WITH d AS (SELECT p_partkey, 200+p_partkey*7%1800 AS w, 100+p_partkey*11%1300 AS h, CASE p_size%4 WHEN 0 THEN 480 WHEN 1 THEN 1080 ELSE 720 END AS t FROM part),
e AS (SELECT *, CASE WHEN h<=t THEN h ELSE t END AS r FROM d), f AS (SELECT *, greatest(2, r - r%2) AS oh FROM e), g AS (SELECT *, CAST(round_even(w*(oh/CAST(h AS DOUBLE)), 0) AS BIGINT) AS rw FROM f)
SELECT p_partkey, greatest(2, rw - rw%2) AS width, oh AS height FROM g""")  # fmt: skip
def export_sizes(spark, sf):
    p = F.col("p_partkey")
    t = F.when(F.col("p_size") % 4 == 0, "480p").when(F.col("p_size") % 4 == 1, "1080P").otherwise("potato")
    d = S.export_dims(200 + p * 7 % 1800, 100 + p * 11 % 1300, t)
    return table(spark, sf, "part").select("p_partkey", d["width"].alias("width"), d["height"].cast("long").alias("height"))


@query("face_tag_rules", """
WITH d AS (SELECT d.doc_id, coalesce(l.toxic=1, FALSE) AS anon0, coalesce(l.quality=1, FALSE) AS off, (n_chars%100)/100.0::DOUBLE AS conf FROM documents d LEFT JOIN labels l ON l.doc_id=d.doc_id),
f AS (SELECT doc_id, off, conf < 0.68 AS rev, anon0 AND NOT (conf < 0.68) AND NOT off AS anon FROM d)
SELECT doc_id, anon AS should_anonymize, off AS is_official, rev AS review_required,
 CASE WHEN doc_id%2=1 AND anon THEN 'vip|Anonymized' WHEN anon THEN 'Anonymized|vip' ELSE 'vip' END || CASE WHEN off THEN '|Official' ELSE '' END || CASE WHEN rev THEN '|Review' ELSE '' END AS tags FROM f""")  # fmt: skip
def face_tag_rules(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    raw = F.when(F.col("doc_id") % 2 == 1, F.array(F.lit(" vip "), F.lit("ANONYMIZED"), F.lit("vip"), F.lit(""), F.lit("anonymized"))).otherwise(F.array(F.lit("vip"), F.lit("VIP")))
    t = S.face_tags(raw, F.col("toxic") == 1, F.col("quality") == 1, F.lit(False), F.col("n_chars") % 100 / 100.0)
    d = d.select("doc_id", t.alias("t"))
    return d.select("doc_id", F.col("t.anonymize").alias("should_anonymize"), F.col("t.official").alias("is_official"), F.col("t.review").alias("review_required"), F.array_join("t.tags", "|").alias("tags"))


@query("people_from_segments", """
WITH s AS (SELECT doc_id AS seq, CAST(substr(source,4) AS BIGINT) AS video_id, lang AS name, CASE WHEN lang='fr' THEN 'D' ELSE '' END || substr('abcdefgh', 1, CAST(n_chars%3 AS INTEGER)+1) AS descr, doc_id*3%600 AS st, doc_id*3%600 + n_chars%7 AS en, (n_chars%100)/100.0::DOUBLE AS conf, n_chars%5=0 AS anon FROM documents)
SELECT video_id, arg_min(name, seq) AS name, count(*) AS ranges, max(conf) AS confidence, bool_or(anon) AS should_anonymize FROM s GROUP BY video_id, lower(name), lower(descr)""")  # fmt: skip
def people_from_segments(spark, sf):
    people, _ = people_tables(spark, sf)
    return people.select("video_id", "name", "ranges", "confidence", "should_anonymize")


def people_tables(spark, sf):
    d = table(spark, sf, "documents")
    n = F.col("n_chars")
    descr = F.concat(F.when(F.col("lang") == "fr", "D").otherwise(""), F.substring(F.lit("abcdefgh"), F.lit(1), (n % 3 + 1).cast("int")))
    st = F.col("doc_id") * 3 % 600
    j = F.to_json(F.struct(F.array(F.struct(
        F.col("lang").alias("name"), descr.alias("description"), F.struct(st.alias("begin"), (st + n % 7).alias("finish")).alias("time_range"),
        (n % 100 / 100.0).alias("score"), F.when(n % 5 == 0, "yes").otherwise("no").alias("redact"), F.lit("a, b").alias("tags"),
        F.lit("person").alias("category"),
    )).alias("chapters")))
    p = d.select(F.col("doc_id").alias("doc"), F.substring("source", 4, 20).cast("long").alias("video_id"), j.alias("payload"))
    rows = privacy.people_rows(privacy.explode_segments(p, ["video_id", "doc"], definition_ids=["people", "scenes"], order="ids_first", any_key=False), ["video_id", "doc"])
    return privacy.people_from_segments(rows.withColumn("seq", F.col("doc")).drop("doc"), ["video_id"])


@query("person_ranges", """
WITH s AS (SELECT doc_id AS seq, CAST(substr(source,4) AS BIGINT) AS video_id, doc_id*3%600 AS st, doc_id*3%600 + n_chars%7 AS en FROM documents)
SELECT video_id, seq, CAST(st AS DOUBLE) AS start_sec, CAST(CASE WHEN en=st THEN en+1 ELSE en END AS DOUBLE) AS end_sec FROM s""")  # fmt: skip
def person_ranges(spark, sf):
    return people_tables(spark, sf)[1].select("video_id", "seq", "start_sec", "end_sec")
