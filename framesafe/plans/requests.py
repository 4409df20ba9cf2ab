"""Validation of a table of redaction requests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import EXPORT_HEIGHTS, lenient_bool, ordered_distinct, parse_list
from ..operators.review import resolve_targets

# Fixed values.
MIN_BLUR = 220
REVERSE_WORDS = ["reverse", "reverse_faces", "reverse_face_redaction"]
STYLES = ["blur", "black"]
REGIONS = "array<struct<id:string,x:double,y:double,width:double,height:double,shape:string,effect:string,reason:string,tracking_mode:string,anchor_sec:double,start_sec:double>>"


def plan_requests(req: DataFrame, jobs: DataFrame, faces: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Accepted requests with defaults, rejected requests with code and message, resolved targets and
    unresolved ids.

    ``req`` holds text columns as sent: request_id, job_id, person_ids, focus_person_ids, entity_ids,
    custom_regions, redaction_style, redaction_mode, reverse_face_redaction, blur_strength, detect_every_n,
    detect_every_seconds, use_temporal_optimization, export_quality. Faces need job_id, stable_person_id, encoding.
    """
    none = F.array().cast("array<string>")
    lst = lambda c: ordered_distinct(F.coalesce(parse_list(c, csv=True), none))
    mode = F.lower(F.trim(F.coalesce("redaction_mode", F.lit(""))))
    reverse = mode.isin(REVERSE_WORDS) | lenient_bool("reverse_face_redaction")
    style = F.lower(F.trim(F.coalesce(F.nullif("redaction_style", F.lit("")), F.lit("blur"))))
    style = F.when(style.isin(STYLES), style).otherwise("blur")
    blur = F.coalesce(F.trim("blur_strength").try_cast("int"), F.lit(MIN_BLUR))
    raw_h = F.nullif(F.trim("export_quality"), F.lit(""))
    height = F.when(raw_h.isNull(), 720).otherwise(F.regexp_replace(F.lower(raw_h), "p$", "").try_cast("int"))
    r = req.join(jobs.select("job_id", F.col("status").alias("__status")), "job_id", "left").withColumns({
        "requested_person_ids": lst("person_ids"),
        "focus_ids": lst("focus_person_ids"),
        "entity_list": lst("entity_ids"),
        "regions": F.coalesce(F.from_json("custom_regions", REGIONS), F.array().cast(REGIONS)),
        "reverse": F.coalesce(reverse, F.lit(False)),
        "style": style,
        "output_height": height,
        "temporal": lenient_bool("use_temporal_optimization", True),
        "every_n": F.coalesce(F.trim("detect_every_n").try_cast("int"), F.lit(1)),
        "every_seconds": F.trim("detect_every_seconds").try_cast("double"),
    })
    r = r.withColumns({
        "strength": F.when(F.col("style") == "blur", F.greatest(F.lit(MIN_BLUR), blur)).otherwise(blur),
        "mode": F.when(F.col("reverse"), "reverse_faces").otherwise("standard"),
        "person_list": F.when(F.col("reverse"), none).otherwise(F.col("requested_person_ids")),
    })
    people = r.select("request_id", "job_id", F.col("person_list").alias("person_ids"))
    found, lost = resolve_targets(people, faces)
    focus, _ = resolve_targets(r.where("reverse").select("request_id", "job_id", F.col("focus_ids").alias("person_ids")), faces)
    n = found.groupBy("request_id").agg(F.count(F.lit(1)).alias("__found"))
    nf = focus.groupBy("request_id").agg(F.count(F.lit(1)).alias("__focus"))
    r = r.join(n, "request_id", "left").join(nf, "request_id", "left")
    n_found = F.when(F.col("reverse"), 1).otherwise(F.coalesce("__found", F.lit(0)))
    n_focus = F.coalesce("__focus", F.lit(0))
    face_region = F.exists("regions", lambda g: (F.lower(F.trim(F.coalesce(g["tracking_mode"], F.lit("")))) == "face") | F.lower(F.coalesce(g["reason"], F.lit(""))).rlike("face|person|head"))
    nothing = (n_found + F.size("regions") == 0) & (F.size("entity_list") == 0)
    err = lambda code, msg: F.struct(F.lit(code).alias("error_code"), F.lit(msg).alias("error"))
    problem = (
        F.when(F.coalesce(F.col("job_id").cast("string"), F.lit("")) == "", err(400, "job_id is required"))
        .when(F.col("__status").isNull(), err(404, "job not found"))
        .when(F.col("__status") != "ready", err(409, "job is not ready for redaction"))
        .when(F.col("reverse") & (F.size("focus_ids") > 0) & (n_focus == 0), err(400, "focused face could not be resolved"))
        .when(~F.coalesce(F.col("output_height").isin(EXPORT_HEIGHTS), F.lit(False)), err(400, "export_quality must be one of 480p, 720p, or 1080p"))
        .when(nothing & (F.size("person_list") > 0), err(400, "none of the selected faces could be resolved"))
        .when(nothing, err(400, "no targets selected"))
    )
    r = r.withColumn("__problem", problem).withColumn("every_n", F.when((n_found > 0) | face_region, 1).otherwise(F.col("every_n")))
    good = r.where(F.col("__problem").isNull()).select(
        "request_id", "job_id", "mode", "reverse", "style", "strength", "output_height", "every_n", "every_seconds", "temporal",
        F.col("person_list").alias("person_ids"), "requested_person_ids", F.col("focus_ids").alias("focus_person_ids"),
        F.col("entity_list").alias("entity_ids"), "regions",
    )
    bad = r.where(F.col("__problem").isNotNull()).select("request_id", "job_id", "__problem.*")
    ok = good.select("request_id")
    return good, bad, found.join(ok, "request_id", "left_semi"), lost.join(ok, "request_id", "left_semi")
