"""Descriptions on faces, review lists, selections, requested targets, progress."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import clean_str, face_identity, face_tags
from . import scans
from .matching import greedy_match

MIN_MATCH_SCORE = 4.0


def match_descriptions(scores: DataFrame, group: Sequence[str], face: str = "face_pos", desc: str = "desc_index",
                       min_score: float = MIN_MATCH_SCORE) -> DataFrame:
    """One description per face and one face per description, best scores first, then description, then face."""
    pairs = scores.where(F.col("score") >= min_score)
    return greedy_match(pairs, group, face, desc, [-F.col("score"), F.col(desc), F.col(face)])


def enrich_faces(faces: DataFrame, people: DataFrame, matches: DataFrame, job: str = "job_id", preserve: bool = False) -> DataFrame:
    """Faces with the description matched to them, tags, flags and display rank.

    ``faces``: job, ``face_pos``, ids, ``name``; ``people``: job, ``desc_index``, name, description, flags, tags,
    confidence, redaction_reason; ``matches``: job, face_pos, desc_index, score. With ``preserve`` stored tags
    and flags stay. Unmatched faces go to review.
    """
    n_people = people.groupBy(job).agg(F.count(F.lit(1)).alias("__people"))
    tag = face_tags(F.col("tags"), F.col("should_anonymize"), F.col("is_official"), F.col("review_required"), F.col("confidence"))
    d = people.select(job, "desc_index", F.col("name").alias("__name"), F.col("description").alias("description"),
                      F.bround("confidence", 3).alias("description_confidence"),
                      F.nullif("redaction_reason", F.lit("")).alias("redaction_reason"), tag.alias("__t"))
    m = matches.select(job, "face_pos", "desc_index", F.bround("score", 3).alias("description_match_score"))
    stored = ["tags", "should_anonymize", "is_official", "review_required"]
    drop = ["description", "description_confidence", "redaction_reason", "description_match_score", "priority_rank"]
    base = faces.drop(*drop) if preserve else faces.drop(*drop, *stored)
    j = base.join(m, [job, "face_pos"], "left").join(d, [job, "desc_index"], "left").join(n_people, job, "left")
    pid = face_identity(F.col("stable_person_id"), F.col("cluster_person_id"), F.col("person_id"), F.col("face_pos"))
    hit = F.col("desc_index").isNotNull()
    none = F.array().cast("array<string>")
    fresh = {
        "tags": F.when(hit, F.col("__t.tags")).otherwise(F.array(F.lit("Review"))),
        "should_anonymize": F.when(hit, F.col("__t.anonymize")).otherwise(False),
        "is_official": F.when(hit, F.col("__t.official")).otherwise(False),
        "review_required": F.when(hit, F.col("__t.review")).otherwise(True),
    }
    if preserve:
        zero = {"tags": none, "should_anonymize": F.lit(False), "is_official": F.lit(False), "review_required": F.lit(False)}
        fresh = {c: F.coalesce(F.col(c), zero[c]) if c in base.columns else zero[c] for c in stored}
    out = j.withColumns({
        "stable_person_id": pid,
        "name": F.coalesce(F.nullif("__name", F.lit("")), F.nullif("name", F.lit("")), pid),
        "description_match_score": F.coalesce("description_match_score", F.lit(0.0)),
        "priority_rank": F.when(hit, F.col("desc_index")).otherwise(F.coalesce("__people", F.lit(0)) + F.col("face_pos")),
        **fresh,
    })
    return out.drop("__name", "__t", "__people", "desc_index")


def needs_refresh(faces: DataFrame, people: DataFrame, job: str = "job_id") -> DataFrame:
    """Per job: a face lacks a field, or annotations exist upstream and none locally."""
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    fields = ["priority_rank", "should_anonymize", "is_official", "review_required", "description_match_score", "tags"]
    missing = F.bool_or(F.greatest(*(F.col(c).isNull() for c in fields)))
    tagged = F.exists(F.coalesce("tags", F.array().cast("array<string>")), lambda t: F.lower(F.trim(t)).isin("anonymized", "official"))
    f = faces.groupBy(job).agg(missing.alias("__missing"), F.bool_or(yes("should_anonymize") | yes("is_official") | tagged).alias("__local"))
    p = people.groupBy(job).agg(F.bool_or(yes("should_anonymize") | yes("is_official") | (F.size("tags") > 0)).alias("__remote"))
    remote = F.coalesce("__remote", F.lit(False))
    return f.join(p, job, "left").select(job, (F.col("__missing") | (remote & ~F.col("__local"))).alias("needs_refresh"))


# -- review lists ----------------------------------------------------------------------------


def review_items(faces: DataFrame, objects: DataFrame | None = None, job: str = "job_id") -> DataFrame:
    """Rows of the review list: id, kind, label (60 characters), tags, flags, rank, count."""
    pid = F.coalesce(F.nullif(F.trim("person_id"), F.lit("")), F.concat(F.lit("person_"), F.col("face_pos").cast("string")))
    off = F.coalesce("is_official", F.lit(False))
    anon = F.coalesce("should_anonymize", F.lit(False)) & ~off
    rev = F.coalesce("review_required", F.lit(False))
    tags = face_tags(F.col("tags"), anon, off, rev, F.lit(None).cast("double"), variant="editor")["tags"]
    has = F.exists(tags, lambda t: F.lower(t) == "review")
    tags = F.when(rev & ~has, F.array_append(tags, F.lit("Review"))).otherwise(tags)
    name = F.coalesce(F.nullif("name", F.lit("")), F.nullif("description", F.lit("")), pid)
    out = faces.select(
        job, F.concat(F.lit("face-"), pid).alias("id"), F.lit("face").alias("kind"), F.substring(F.trim(name), 1, 60).alias("label"),
        tags.alias("tags"), pid.alias("person_id"), anon.alias("should_anonymize"), off.alias("is_official"), rev.alias("review_required"),
        F.col("priority_rank"), F.coalesce("appearance_count", F.lit(0)).cast("long").alias("appearance_count"),
    )
    if objects is None:
        return out
    cls = F.lower(clean_str("identification"))
    o = objects.select(
        job, F.concat(F.lit("object-"), cls).alias("id"), F.lit("object").alias("kind"), F.substring(F.trim("identification"), 1, 60).alias("label"),
        F.array().cast("array<string>").alias("tags"), F.lit(None).cast("string").alias("person_id"),
        *(F.lit(False).alias(c) for c in ("should_anonymize", "is_official", "review_required")),
        F.lit(None).cast(dict(out.dtypes)["priority_rank"]).alias("priority_rank"), F.col("appearance_count").cast("long").alias("appearance_count"),
    )
    return out.unionByName(o)


def review_order(job: str | None = "job_id") -> list[Column]:
    """Faces to anonymise, other faces, objects; then rank, count, label."""
    face = F.col("kind") == "face"
    group = F.when(face & F.col("should_anonymize"), 0).when(face, 1).otherwise(2)
    rank = F.when(face, F.coalesce(F.col("priority_rank").cast("long"), F.lit(2**53 - 1)))
    count = F.when(face, -F.coalesce("appearance_count", F.lit(0)))
    keys = [F.col(job)] if job else []
    return [*keys, group, rank, count, F.col("label"), F.col("id")]


def order_review(items: DataFrame, job: str | None = "job_id") -> DataFrame:
    return items.orderBy(*review_order(job))


def order_at(items: DataFrame, gaps: DataFrame, excluded: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Items by playhead: active first, visible now, nearest gap, label. ``gaps``: keys, id, ``gap``."""
    j = items.join(gaps.select(*keys, "id", "gap"), [*keys, "id"], "left")
    j = j.join(excluded.select(*keys, "id").withColumn("__ex", F.lit(1)), [*keys, "id"], "left")
    gap = F.coalesce(F.col("gap").cast("double"), F.lit(float("inf")))
    return j.withColumn("active", F.col("__ex").isNull()).drop("__ex").orderBy(
        *keys, F.col("active").desc(), (gap <= 0.18).desc(), F.round(gap, 3), "label", "id"
    )


def filter_review(items: DataFrame, text: str = "", anonymise_only: bool = False) -> DataFrame:
    out = items.where((F.col("kind") == "face") & F.col("should_anonymize")) if anonymise_only else items
    q = text.strip().lower()
    if not q:
        return out
    return out.where(F.lower("label").contains(q) | F.exists("tags", lambda t: F.lower(t).contains(q)))


def filter_events(events: DataFrame, severities: Sequence[str] | None = None, category: str = "all") -> DataFrame:
    out = events if severities is None else events.where(F.col("severity").isin(list(severities)))
    return out if category == "all" else out.where(F.col("category") == category)


def entity_rows(faces: DataFrame, source: str = "detections") -> DataFrame:
    """Entities to register: faces that have a snapshot, with a default description and person metadata."""
    pid = face_identity(F.col("stable_person_id"), F.col("cluster_person_id"), F.col("person_id"))
    pid = F.coalesce(F.nullif(pid, F.lit("")), F.lit("unknown"))
    name = F.coalesce(F.nullif(F.trim("name"), F.lit("")), pid)
    about = F.coalesce(F.nullif("description", F.lit("")), F.concat(F.lit("Detected face: "), name))
    f = faces.where(F.coalesce("snap_path", F.lit("")) != "")
    return f.select("job_id", name.alias("name"), about.alias("description"), "snap_path",
                    F.to_json(F.struct(pid.alias("person_id"), F.lit(source).alias("source"))).alias("metadata"))


# -- selections and requested targets --------------------------------------------------------


def selected_ids(faces: DataFrame, excluded: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All people minus the excluded ones."""
    return faces.select(*keys, "person_id").where(F.col("person_id").isNotNull()).distinct().join(
        excluded.select(*keys, "person_id").distinct(), [*keys, "person_id"], "left_anti"
    )


def reverse_ids(faces: DataFrame, focus: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All people minus the focused ones; without a focus, everyone."""
    return selected_ids(faces, focus, keys)


def resolve_targets(requests: DataFrame, faces: DataFrame, ids: str = "person_ids", job: str = "job_id",
                    request: str = "request_id") -> tuple[DataFrame, DataFrame]:
    """Requested people of a request: the faces found, and the ids not found with label and reason."""
    wanted = requests.select(request, job, F.posexplode(ids).alias("id_pos", "person_id"))
    have = faces.select(job, F.col("stable_person_id").alias("person_id"), *[c for c in faces.columns if c not in (job, "person_id", "stable_person_id")])
    found = wanted.join(have, [job, "person_id"])
    lost = wanted.join(faces.select(job, F.col("stable_person_id").alias("person_id")), [job, "person_id"], "left_anti")
    labels = F.coalesce(F.try_element_at(F.col("person_labels"), F.col("person_id")), F.col("person_id")) if "person_labels" in requests.columns else F.col("person_id")
    if "person_labels" in requests.columns:
        lost = lost.join(requests.select(request, "person_labels"), request)
    lost = lost.select(request, job, "person_id", labels.alias("label"), F.lit("No matching face encoding was available").alias("reason"))
    return found, lost


def encodings_for_entities(requests: DataFrame, faces: DataFrame, job: str = "job_id", request: str = "request_id") -> DataFrame:
    """Encodings of the faces bound to a request's entities, for requests that name no face."""
    want = requests.where(F.coalesce(F.size("person_ids"), F.lit(0)) <= 0).select(request, job, F.explode("entity_ids").alias("entity_id"))
    f = faces.where(F.col("encoding").isNotNull() & F.col("entity_id").isNotNull())
    return want.join(f.select(job, "entity_id", "stable_person_id", "encoding"), [job, "entity_id"])


def uncovered_targets(targets: DataFrame, lanes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Targets without a lane; the lane already covers the others."""
    return targets.join(lanes.select(*keys).distinct(), list(keys), "left_anti")


def visible_boxes(lanes: DataFrame, live: DataFrame, keys: Sequence[str], person: str = "person_id") -> DataFrame:
    """Lane boxes, and live boxes of everyone without a lane."""
    covered = lanes.select(*keys, person).distinct()
    ok = live.where((F.col("width") > 0) & (F.col("height") > 0)).join(covered, [*keys, person], "left_anti")
    cols = [*keys, person, "f", "x", "y", "width", "height"]
    return lanes.select(*cols, F.lit("lane").alias("origin")).unionByName(ok.select(*cols, F.lit("live").alias("origin")))


# -- progress --------------------------------------------------------------------------------


def progress_percent(done: Column, total: Column) -> Column:
    """Rendering progress: .05 + .87 of the frames done, in whole percent."""
    share = F.least(done, total) / F.greatest(total, F.lit(1))
    return F.bround(F.least(F.lit(1.0), F.greatest(F.lit(0.0), share * 0.87 + 0.05)) * 100, 0).cast("int")


def progress_changes(df: DataFrame, keys: Sequence[str], order: str, chunk: float = 10_000) -> DataFrame:
    """Only rows where the stage or the whole percent differs from the row before."""
    now = F.struct("stage", "percent")
    d = scans.scan(df.withColumn("__now", now), keys, [order], chunk, {"__prev": scans.last(F.col("__now"), current=False)})
    return d.where(F.col("__prev").isNull() | (F.col("__prev") != F.col("__now"))).select(*df.columns)


def build_summary(states: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Lane builds per job: building, ready, total, mean percent of those building (100 when all are ready)."""
    busy = F.col("status").isin("queued", "running")
    g = states.groupBy(*keys).agg(
        F.count_if(busy).alias("building"), F.count_if(F.col("status") == "ready").alias("ready"), F.count(F.lit(1)).alias("total"),
        F.avg(F.when(busy, F.coalesce("percent", F.lit(0)))).alias("__mean"),
    )
    pct = F.when(F.col("building") > 0, F.floor(F.col("__mean") + 0.5)).when((F.col("total") > 0) & (F.col("ready") == F.col("total")), 100).otherwise(0)
    return g.withColumn("percent", pct.cast("int")).drop("__mean")
