"""Privacy analysis results: segments to events and actions, merging, risk, apply preview."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import payload as P
from ..functions.scalars import clean_str, norm_action, norm_category, norm_class, norm_severity, null_safe_hash, snake_key, text_key
from ..session import checkpoint, spread
from . import scans

# Words of the keep rule.
NO_REDACTION = ["no_redaction", "do_not_redact", "ignore", "exclude", "none"]
ALLOWED_TARGETS = ["main_verdict_subject", "protected_person", "private_non_party", "minor_or_vulnerable_person"]
ALLOWED_SELECTIONS = ["main_verdict_subject", "protected_or_vulnerable_person"]
ALLOWED_ROLES = [
    "verdict_subject", "defendant", "respondent", "accused", "protected_witness", "victim", "minor", "private_non_party",
]
ALLOWED_TERMS = [
    "main verdict subject", "verdict subject", "defendant", "respondent", "accused", "sentencing subject",
    "protected witness", "victim", "minor", "vulnerable", "private non-party", "private non party", "protected person",
]
EXCLUDED_ROLES = [
    "judge", "lawyer", "attorney", "clerk", "officer", "police", "jury", "juror", "audience", "reporter", "bystander",
    "court_staff", "surrounding_participant", "public_official",
]
EXCLUDED_TERMS = [
    "judge", "lawyer", "attorney", "clerk", "officer", "jury", "juror", "audience", "reporter", "bystander",
    "court staff", "surrounding courtroom", "courtroom participant",
]
GENERIC_TERMS = [
    "person is visible", "visible person", "face is visible", "visible face", "appears in the courtroom",
    "shown in the courtroom",
]
AUTOMATIC = ["select_detected_entity", "select_object_class"]
REVIEW_ACTIONS = ["create_review_bookmark", "jump_to_time", "draw_custom_region_prompt"]
PRIVACY_SEGMENT_IDS = ["privacy_risk_segment"]
MERGE_GAP = 2.0

TEXT_FIELDS = {
    "label": ("label", "title", "name"),
    "description": ("description", "summary"),
    "reason": ("reason", "rationale", "privacy_reason"),
    "inclusion_reason": ("inclusion_reason", "selection_reason", "target_reason"),
    "redaction_target": ("redaction_target", "target_type", "privacy_target"),
    "scene_role": ("scene_role", "role", "subject_role"),
    "redaction_decision": ("redaction_decision", "decision", "privacy_decision"),
    "subject_selection": ("subject_selection", "selection", "selection_type"),
    "handling_note": ("handling_note", "handling", "review_note"),
    "object_class": ("object_class", "class", "object_type"),
    "entity_hint": ("entity_hint", "person_hint", "entity_id", "person_id"),
}


def _mentions(text: Column, terms: Sequence[str]) -> Column:
    return text.rlike("|".join(terms))


def keep_target() -> Column:
    """The keep rule on the columns of :func:`privacy_rows` output."""
    c = lambda n: F.coalesce(F.col(n), F.lit(""))
    names = ["label", "description", "reason", "inclusion_reason", "redaction_target", "scene_role", "subject_selection"]
    text = F.lower(F.concat_ws(" ", *(c(n) for n in names)))
    role = snake_key("scene_role")
    protected = (
        snake_key("redaction_target").isin(ALLOWED_TARGETS)
        | snake_key("subject_selection").isin(ALLOWED_SELECTIONS)
        | role.isin(ALLOWED_ROLES)
        | _mentions(text, ALLOWED_TERMS)
    )
    excluded = role.isin(EXCLUDED_ROLES) | _mentions(text, EXCLUDED_TERMS) | _mentions(text, GENERIC_TERMS)
    return (
        F.when(snake_key("redaction_decision").isin(NO_REDACTION), False)
        .when(~F.col("category").isin("person", "face"), True)
        .when(protected, True)
        .otherwise(~excluded)
    )


def keep_privacy_target(df: DataFrame) -> DataFrame:
    return df.where(keep_target())


def explode_segments(payloads: DataFrame, keys: Sequence[str], payload: str = "payload",
                     definition_ids: Sequence[str] = PRIVACY_SEGMENT_IDS, order: str = "keys_first",
                     any_key: bool = True) -> DataFrame:
    """One row per segment: keys, ``seq``, ``fields`` (map of VARIANT), ``texts`` (map of text)."""
    segs = P.segments(P.open_payload(F.col(payload)), list(definition_ids), order=order, any_key=any_key)
    maps = F.transform(segs, lambda x: F.when(P.is_object(x), P.let(P.segment_fields(x), lambda m: F.struct(m.alias("m"), P.field_texts(m).alias("t")))))
    # the maps are built inside the generator, so later filters cannot be pushed into their construction
    rows = payloads.select(*keys, F.posexplode(maps).alias("seq", "__x")).where(F.col("__x").isNotNull())
    return rows.select(*keys, F.col("seq").cast("long").alias("seq"), F.col("__x.m").alias("fields"), F.col("__x.t").alias("texts"))


def privacy_rows(segments: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Typed, normalised segment rows from ``fields`` maps; the keep rule is not applied yet."""
    m, tx = F.col("fields"), F.col("texts")
    s, e = P.segment_time(m, True), P.segment_time(m, False)
    rows = segments.select(
        *keys, "seq", s.alias("start_sec"), F.greatest(s, e).alias("__e"),
        norm_category(P.text(tx, "privacy_category", "category", "type", "kind")).alias("category"),
        norm_severity(P.text(tx, "risk_level", "severity", "priority")).alias("severity"),
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(P.field_number(m, "confidence", "score"), F.lit(0.65)))).alias("confidence"),
        P.text(tx, "recommended_action", "action", "action_type").alias("__action"),
        *(P.text(tx, *names).alias(n) for n, names in TEXT_FIELDS.items()),
    )
    title = F.initcap(F.translate("category", "_", " "))
    rows = rows.withColumn("label", F.when(F.col("label") == "", title).otherwise(F.col("label")))
    ask = F.concat(F.lit("Review "), F.col("label"), F.lit(" for privacy risk."))
    reason = F.coalesce(*(F.nullif(n, F.lit("")) for n in ("reason", "inclusion_reason", "description")), ask)
    return rows.select(
        *keys, "seq", F.bround("start_sec", 3).alias("start_sec"),
        F.bround(F.when(F.col("__e") == F.col("start_sec"), F.col("start_sec") + 1.0).otherwise(F.col("__e")), 3).alias("end_sec"),
        "category", "severity", F.bround("confidence", 3).alias("confidence"), "label", "description", reason.alias("reason"),
        "inclusion_reason", "redaction_target", "scene_role", "redaction_decision", "subject_selection", "handling_note",
        norm_action("__action", "category").alias("action_type"), norm_class("object_class").alias("object_class"), "entity_hint",
    )


# -- merging ---------------------------------------------------------------------------------


def merge_events(rows: DataFrame, keys: Sequence[str], seq: str = "seq", gap: float = MERGE_GAP,
                 chunk: float = 10_000) -> DataFrame:
    """Merge consecutive rows of a key, in ``seq`` order, that tell of the same target close in time.

    A row joins the run before it when it starts within ``gap`` of the run's end, has its category,
    severity, action type and object class, and its entity — or its label where either has no entity.
    The run keeps the first row's other values, the longest texts and the highest confidence.

    Rows where a run must end whatever came before (one of the four attributes changes, or the start lies
    beyond every earlier end) cut a key into blocks; the blocks are spread over tasks, and a task streams
    through its sorted blocks with one open run.
    """
    keys = list(keys)
    cols = rows.columns
    same = F.struct(*(clean_str(c).alias(c) for c in ("category", "severity", "action_type")), text_key("object_class").alias("object"))
    specs = {"__prev": scans.last(F.col("__same"), current=False), "__reach": scans.max_before(F.col("end_sec"))}
    d = scans.scan(rows.withColumn("__same", same), keys, [seq], chunk, specs)
    cut = F.col("__prev").isNull() | (F.col("__prev") != F.col("__same")) | (F.col("start_sec") > F.col("__reach") + gap)
    d = scans.scan(d, keys, [seq], chunk, {"__block": scans.count_so_far(cut)}).drop("__prev", "__reach", "__same")
    d = d.withColumns({
        "__ent": text_key("entity_hint"), "__lab": text_key("label"),
        "__g": null_safe_hash(*keys, "__block"),
    })
    parted = spread(d, *keys, "__block").sortWithinPartitions(*keys, "__block", seq)
    out_schema = d.select(*cols).withColumn("members", F.lit(1)).schema

    def joins(run: dict, r: dict) -> bool:
        if r["start_sec"] > run["end_sec"] + gap:
            return False
        if run["__ent"] and r["__ent"]:
            return run["__ent"] == r["__ent"]
        return run["__lab"] == r["__lab"]

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        run = None
        for b in batches:
            done = []
            for r in b.to_dict("records"):
                if run is not None and run["__g"] == r["__g"] and joins(run, r):
                    run["start_sec"] = min(run["start_sec"], r["start_sec"])
                    run["end_sec"] = max(run["end_sec"], r["end_sec"])
                    run["confidence"] = max(run["confidence"], r["confidence"])
                    for text in ("description", "reason"):
                        if len((r[text] or "").strip()) > len((run[text] or "").strip()):
                            run[text] = r[text]
                    run["members"] += 1
                else:
                    if run is not None:
                        done.append(run)
                    run = {**r, "members": 1}
            if done:
                yield pd.DataFrame(done)[[*cols, "members"]]
        if run is not None:
            yield pd.DataFrame([run])[[*cols, "members"]]

    return parted.mapInPandas(scan, out_schema)


def number_rows(df: DataFrame, keys: Sequence[str], order: str, out: str, chunk: float = 10_000) -> DataFrame:
    """1-based position within the key without sorting a whole key in one task."""
    return scans.scan(df, keys, [order], chunk, {out: scans.count_so_far(F.lit(True))})


ACTION_KEY = ["action_type", "object_class", "entity_hint", "redaction_target", "scene_role", "label"]


def merge_actions(events: DataFrame, keys: Sequence[str], seq: str = "seq") -> tuple[DataFrame, DataFrame]:
    """Actions with equal 6-part key become one. Returns events with ``event_id`` and ``action_id``, and actions.

    An action keeps its first event's values, the highest confidence, the longest reason, the widest span.
    """
    keys = list(keys)
    events = checkpoint(events)  # read several times below
    parts = [text_key(c).alias(f"__k{i}") for i, c in enumerate(ACTION_KEY)]
    e = number_rows(events, keys, seq, "__n").select("*", *parts)
    kcols = [f"__k{i}" for i in range(len(ACTION_KEY))]
    first = ["action_type", "label", "object_class", "entity_hint", "redaction_target", "scene_role", "redaction_decision",
             "subject_selection", "inclusion_reason"]
    have = [c for c in first if c in events.columns]
    a = e.groupBy(*keys, *kcols).agg(
        F.min(F.struct("__n", *have)).alias("__f"),
        F.max("confidence").alias("confidence"),
        F.max(F.struct(F.length(clean_str("reason")).alias("n"), (-F.col("__n")).alias("first"), "reason"))["reason"].alias("reason"),
        F.min("start_sec").alias("start_sec"),
        F.max("end_sec").alias("end_sec"),
        F.count(F.lit(1)).alias("events"),
    )
    a = number_rows(a.withColumn("__n", F.col("__f.__n")), keys, "__n", "__a")
    aid = F.format_string("act_%03d", "__a")
    ids = a.select(*keys, *kcols, aid.alias("action_id"))
    out_events = e.join(ids, [*keys, *kcols]).withColumn("event_id", F.format_string("evt_%03d", "__n"))
    actions = a.select(
        *keys, aid.alias("action_id"), F.col("__a").alias("action_pos"), *(F.col(f"__f.{c}").alias(c) for c in have),
        "confidence", "reason", "start_sec", "end_sec", "events",
    )
    text = F.concat(F.col("label"), F.lit(": "), F.translate("action_type", "_", " "))
    mode = F.when(F.col("action_type").isin(AUTOMATIC), "automatic_if_matched").otherwise("review_only")
    actions = actions.withColumns({"action_label": text, "apply_mode": mode})
    return out_events.drop("__n", *kcols), actions


def risk_summary(events: DataFrame, keys: Sequence[str], finder: str = "Analysis") -> DataFrame:
    """Risk level and summary text per key. Keys without events are the caller's to add (see ``quiet``)."""
    n = F.count(F.lit(1))
    level = F.when(F.bool_or(F.col("severity") == "high"), "high").when(F.bool_or(F.col("severity") == "medium"), "medium").otherwise("low")
    text = F.concat(F.lit(f"{finder} found "), n.cast("string"), F.lit(" privacy review segment"), F.when(n == 1, "").otherwise("s"),
                    F.lit(" for this video."))
    return events.groupBy(*keys).agg(n.alias("events"), level.alias("privacy_risk_level"), text.alias("overall_summary"))


def with_quiet(summary: DataFrame, all_keys: DataFrame, keys: Sequence[str], finder: str = "Analysis") -> DataFrame:
    quiet = F.lit(f"{finder} did not find obvious privacy hotspots in this video.")
    return all_keys.select(*keys).distinct().join(summary, list(keys), "left").withColumns({
        "events": F.coalesce("events", F.lit(0).cast("long")),
        "privacy_risk_level": F.coalesce("privacy_risk_level", F.lit("low")),
        "overall_summary": F.coalesce("overall_summary", quiet),
    })


def event_groups(events: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Counts by overlapping groups, with severity and category breakdowns as grouping sets."""
    cat = F.col("category")
    kind = F.when(cat.isin("person", "face"), "people").when(cat.isin("screen", "document", "text", "license_plate"), "sensitive").otherwise("objects")
    groups = F.array_compact(F.array(F.when(F.col("severity") == "high", F.lit("high")), kind))
    return events.select(*keys, F.explode(groups).alias("event_group"), "severity", "category").groupBy(*keys, "event_group").agg(
        F.count(F.lit(1)).alias("events"),
        *(F.count_if(F.col("severity") == s).alias(f"n_{s}") for s in ("low", "medium", "high")),
        F.countDistinct("category").alias("categories"),
    )


# -- apply preview ---------------------------------------------------------------------------


def match_actions(actions: DataFrame, faces: DataFrame, objects: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """First face and first object (list order ``pos``) that each action means.

    ``actions``: keys, ``action_id``, ``action_type``, ``action_label``, ``reason``, ``entity_hint``, ``object_class``;
    ``faces``: keys, ``pos``, ``entity_id``, ``person_id``, ``name``, ``description``; ``objects``: keys, ``pos``, ``identification``.
    """
    keys = list(keys)
    text = F.concat_ws(" ", F.lower(clean_str("action_label")), F.lower(clean_str("reason")))
    a = actions.select(*keys, "action_id", "action_type", text.alias("__text"), F.lower(clean_str("entity_hint")).alias("__hint"),
                       norm_class("object_class").alias("__class"))
    names = ["entity_id", "person_id", "name", "description"]
    f = faces.select(*keys, "pos", *(F.lower(clean_str(n)).alias(f"__{n}") for n in names), "person_id", "name", "description")
    hit = F.lit(False)
    for n in names:
        c = F.col(f"__{n}")
        hit = hit | ((c != "") & ((c == F.col("__hint")) | F.col("__text").contains(c)))
    fp = a.where(F.col("action_type") == "select_detected_entity").join(f, keys).where(hit)
    face = fp.groupBy(*keys, "action_id").agg(F.min(F.struct("pos", "person_id", "name", "description")).alias("__m"))
    face = face.select(*keys, "action_id", "__m.*").withColumnRenamed("pos", "face_pos")
    o = objects.select(*keys, "pos", norm_class("identification").alias("__obj")).where(F.col("__obj") != "")
    op = a.where(F.col("action_type") == "select_object_class").join(o, keys)
    op = op.where((F.col("__obj") == F.col("__class")) | F.col("__text").contains(F.col("__obj")))
    obj = op.groupBy(*keys, "action_id").agg(F.min(F.struct("pos", "__obj")).alias("__m"))
    return face, obj.select(*keys, "action_id", F.col("__m.pos").alias("object_pos"), F.col("__m.__obj").alias("matched_class"))


def apply_preview(actions: DataFrame, faces: DataFrame, objects: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Route every action to ``can_apply``, ``review_only`` or ``unsupported``."""
    keys = list(keys)
    face, obj = match_actions(actions, faces, objects, keys)
    j = actions.join(face, [*keys, "action_id"], "left").join(obj, [*keys, "action_id"], "left")
    t, pid = F.col("action_type"), F.nullif(F.trim("person_id"), F.lit(""))
    by_face, by_obj = t == "select_detected_entity", t == "select_object_class"
    can = (by_face & pid.isNotNull()) | (by_obj & F.col("matched_class").isNotNull())
    route = F.when(F.coalesce(can, F.lit(False)), "can_apply").when(by_face | by_obj | t.isin(REVIEW_ACTIONS), "review_only").otherwise("unsupported")
    j = j.withColumn("route", route)
    apply_it = F.col("route") == "can_apply"
    chosen = F.when(by_face, F.concat(F.lit("face-"), pid)).when(by_obj, F.concat(F.lit("object-"), F.col("matched_class")))
    name = F.when(by_face, F.coalesce(F.nullif("name", F.lit("")), F.nullif("description", F.lit("")), pid)).otherwise(F.col("matched_class"))
    return j.select(
        *keys, "action_id", "route",
        F.when(F.col("route") == "review_only", F.when(by_face | by_obj, "create_review_bookmark").otherwise(t)).otherwise(t).alias("type"),
        F.when(apply_it, chosen).alias("selection_id"),
        F.when(apply_it, name).otherwise(F.col("action_label")).alias("label"),
        F.when(F.col("route") == "unsupported", "This recommendation cannot be mapped to an editor action yet.").otherwise(F.col("reason")).alias("reason"),
    )


def preview_summary(preview: DataFrame, events: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Selected faces, selected object classes and bookmarked events per key.

    ``events`` links ``event_id`` to ``action_id``.
    """
    keys = list(keys)
    sel = preview.where(F.col("route") == "can_apply")
    a = sel.groupBy(*keys).agg(
        F.countDistinct(F.when(F.col("selection_id").startswith("face-"), F.col("selection_id"))).alias("selected_faces"),
        F.countDistinct(F.when(F.col("selection_id").startswith("object-"), F.col("selection_id"))).alias("selected_object_classes"),
    )
    review = events.join(preview.where(F.col("route") == "review_only").select(*keys, "action_id"), [*keys, "action_id"], "left_semi")
    b = review.groupBy(*keys).agg(F.countDistinct("event_id").alias("review_bookmarks"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return preview.select(*keys).distinct().join(a, keys, "left").join(b, keys, "left").select(
        *keys, zero("selected_faces"), zero("selected_object_classes"), zero("review_bookmarks")
    )


# -- people and scenes from analysis payloads ------------------------------------------------


def people_rows(segments: DataFrame, keys: Sequence[str], definition: str | None = None) -> DataFrame:
    """Typed rows of a people/scene analysis, ``kind`` person or scene."""
    m, tx = F.col("fields"), F.col("texts")
    s, e = P.segment_time(m, True), P.segment_time(m, False)
    lo, hi = F.least(s, e), F.greatest(s, e)
    raw = F.lower(P.text(tx, "segment_definition_id", "definition_id", "segment_id", "category", "type"))
    raw = F.lower(F.col(definition)) if definition else raw
    return segments.select(
        *keys, "seq", F.bround(lo, 3).alias("start_sec"), F.bround(F.when(hi == lo, lo + 1.0).otherwise(hi), 3).alias("end_sec"),
        F.when(raw.contains("scene"), "scene").otherwise("person").alias("kind"),
        P.text(tx, "name", "label", "person_name").alias("name"),
        P.text(tx, "description", "summary", "visual_description", "scene_description").alias("description"),
        P.field_number(m, "confidence", "score").alias("confidence"),
        P.field_bool(m, "should_anonymize", "redact", "needs_redaction").alias("should_anonymize"),
        P.field_bool(m, "is_official", "official").alias("is_official"),
        P.field_bool(m, "review_required", "needs_review", "human_review").alias("review_required"),
        P.text(tx, "redaction_reason", "reason", "rationale").alias("redaction_reason"),
        P.field_tags(m).alias("tags"),
    )


def people_from_segments(rows: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """People headers and their time ranges.

    Rows of one person share the lower-case name and the first 120 characters of the lower-case
    description. Flags are ORed, texts are the longest (first on ties), tags a union in first-seen order.
    ``desc_index`` is the display order: to anonymise first, then first start, then name.
    """
    keys = list(keys)
    p = rows.where((F.col("kind") == "person") & ((F.col("name") != "") | (F.col("description") != "")))
    p = p.withColumns({"__name": F.lower("name"), "__desc": F.substring(F.lower("description"), 1, 120)})
    k = [*keys, "__name", "__desc"]
    longest = lambda c: F.max(F.struct(F.length(c).alias("n"), (-F.col("seq")).alias("first"), F.col(c)))[c].alias(c)
    head = p.groupBy(*k).agg(
        F.min(F.struct("seq", "name", "start_sec")).alias("__f"), longest("description"), longest("redaction_reason"),
        F.max("confidence").alias("confidence"),
        *(F.bool_or(c).alias(c) for c in ("should_anonymize", "is_official", "review_required")), F.count(F.lit(1)).alias("ranges"),
    )
    t = p.select(*k, "seq", F.posexplode("tags").alias("tp", "tag")).groupBy(*k, "tag").agg(F.min(F.struct("seq", "tp")).alias("o"))
    t = t.groupBy(*k).agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "tag"))), lambda x: x["tag"]).alias("tags"))
    head = head.join(t, k, "left").withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))
    # display order as one numeric sort column per person
    shown = F.coalesce(F.nullif(F.col("__f.name"), F.lit("")), F.col("description"))
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy(~F.col("should_anonymize"), F.col("__f.start_sec"), shown, F.col("__f.seq"))
    head = head.withColumn("desc_index", F.row_number().over(w) - 1)
    ranges = p.select(*k, "seq", "start_sec", "end_sec").join(head.select(*k, "desc_index"), k).select(*keys, "desc_index", "seq", "start_sec", "end_sec")
    people = head.select(*keys, "desc_index", F.col("__f.name").alias("name"), "description", "redaction_reason", "confidence",
                         "should_anonymize", "is_official", "review_required", "tags", "ranges")
    return people, ranges


def scenes_from_segments(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.where((F.col("kind") == "scene") & (F.col("description") != "")).select(*keys, "start_sec", "end_sec", "description").orderBy(
        *keys, "start_sec", "end_sec"
    )
