"""Lenient parsing, text keys, labels, identities and other scalar rules, as Column helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
TRUE_WORDS = ["1", "true", "yes", "on"]
FALSE_WORDS = ["0", "false", "no", "off"]
SEVERITIES = ["low", "medium", "high"]
SEVERITY_WORDS = {"critical": "high", "severe": "high", "moderate": "medium", "med": "medium"}
CATEGORIES = ["person", "face", "screen", "document", "text", "license_plate", "logo", "object", "scene"]
CATEGORY_WORDS = {
    "license": "license_plate",
    "licenseplate": "license_plate",
    "plate": "license_plate",
    "pii": "text",
    "name": "text",
    "id": "document",
    "id_card": "document",
    "screen_text": "text",
    "person_face": "face",
}
ACTIONS = [
    "select_detected_entity",
    "select_object_class",
    "create_review_bookmark",
    "jump_to_time",
    "draw_custom_region_prompt",
]
EXPORT_HEIGHTS = [480, 720, 1080]
EXPORT_NAME = r"(?i)^redacted_[A-Za-z0-9][A-Za-z0-9_-]{2,80}_\d{8}_\d{6}(_\d{3,6})?(_(480|720|1080)p)?\.mp4$"
FORENSIC_CLASSES = [
    "car", "truck", "bus", "motorcycle", "bicycle",
    "knife", "scissors", "gun",
    "cell phone", "laptop",
    "handbag", "backpack", "suitcase",
]
REVIEW_BELOW = 0.68


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# -- lenient values --------------------------------------------------------------------------


def finite(c: Column | str) -> Column:
    """NaN and infinities become null."""
    c = _c(c).cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), c)


def lenient_double(c: Column | str, default: float | None = None) -> Column:
    """A number, or text holding one; NaN and anything else give the default."""
    v = F.trim(_c(c).cast("string")).try_cast("double")
    v = F.when(~F.isnan(v), v)
    return v if default is None else F.coalesce(v, F.lit(default))


def lenient_bool(c: Column | str, default: bool | None = False) -> Column:
    """Yes/no words first, then numeric truthiness, else the default."""
    t = F.lower(F.trim(_c(c).cast("string")))
    n = t.try_cast("double")
    return (
        F.when(t.isin(TRUE_WORDS), True)
        .when(t.isin(FALSE_WORDS), False)
        .when(n.isNotNull(), n != 0)
        .otherwise(F.lit(default).cast("boolean"))
    )


def clean_str(c: Column | str) -> Column:
    return F.coalesce(F.trim(_c(c)), F.lit(""))


def text_key(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(F.lower(clean_str(c)), r"\s+", " "))


def snake_key(c: Column | str) -> Column:
    return F.translate(F.lower(clean_str(c)), "- ", "__")


def _fold(key: Column, allowed: list[str], words: dict[str, str], default: str) -> Column:
    table = {**{w: w for w in allowed}, **words}
    lookup = F.create_map(*(F.lit(x) for pair in table.items() for x in pair))
    return F.coalesce(F.try_element_at(lookup, key), F.lit(default))


def norm_severity(c: Column | str) -> Column:
    return _fold(F.translate(F.lower(clean_str(c)), " ", "_"), SEVERITIES, SEVERITY_WORDS, "medium")


def norm_category(c: Column | str) -> Column:
    return _fold(snake_key(c), CATEGORIES, CATEGORY_WORDS, "scene")


def norm_action(c: Column | str, category: Column | str) -> Column:
    key, cat = snake_key(c), _c(category)
    return (
        F.when(key.isin(ACTIONS), key)
        .when(cat.isin("person", "face"), "select_detected_entity")
        .when(cat.isin("screen", "document", "text", "license_plate"), "draw_custom_region_prompt")
        .when(cat.isin("logo", "object"), "select_object_class")
        .otherwise("create_review_bookmark")
    )


def norm_class(c: Column | str) -> Column:
    return F.lower(clean_str(c))


def non_blank(c: Column | str) -> Column:
    return F.nullif(F.trim(_c(c).cast("string")), F.lit(""))


def face_identity(stable: Column, cluster: Column, person: Column, index: Column | None = None) -> Column:
    """First non-blank id, else ``person_<index>``, else empty."""
    fallback = F.lit("") if index is None else F.concat(F.lit("person_"), index.cast("string"))
    return F.coalesce(non_blank(stable), non_blank(cluster), non_blank(person), fallback)


# -- lists and tags --------------------------------------------------------------------------


def trimmed_list(arr: Column | str) -> Column:
    t = F.transform(_c(arr), lambda x: F.trim(x))
    return F.filter(t, lambda x: x != "")


def parse_tags(c: Column | str) -> Column:
    """Comma text to trimmed, non-empty tags."""
    return trimmed_list(F.coalesce(F.split(_c(c), ","), F.array().cast("array<string>")))


def ordered_distinct(arr: Column | str) -> Column:
    return F.array_distinct(trimmed_list(arr))


def parse_list(c: Column | str, csv: bool = False) -> Column:
    """A request list: JSON array text, or comma text when allowed; null stays null."""
    c = _c(c)
    is_json = F.try_parse_json(c).isNotNull()
    as_list = F.from_json(c, "array<string>")
    empty = F.array().cast("array<string>")
    plain = parse_tags(c) if csv else empty
    return F.when(c.isNull() | (c == ""), None).otherwise(F.when(is_json, F.coalesce(as_list, empty)).otherwise(plain))


def face_tags(tags: Column, anonymize: Column, official: Column, review: Column, confidence: Column,
              variant: str = "pipeline") -> Column:
    """Normalised tags and flags as ``struct(tags, anonymize, official, review)``.

    The ``editor`` variant has no review rule: it neither adds nor drops the Review tag.
    """
    yes = lambda c: F.coalesce(c, F.lit(False))
    if variant == "pipeline":
        rev = yes(review) | F.coalesce(confidence < REVIEW_BELOW, F.lit(False))
        anon = yes(anonymize) & ~rev
    else:
        rev, anon = yes(review), yes(anonymize)
    off = yes(official)
    anon = anon & ~off

    raw = trimmed_list(F.coalesce(tags, F.array().cast("array<string>")))
    gates = [("anonymized", "Anonymized", anon), ("official", "Official", off)]
    if variant == "pipeline":
        gates.append(("review", "Review", rev))

    def allowed(t: Column) -> Column:
        ok = F.lit(True)
        for key, _, flag in gates:
            ok = ok & ((F.lower(t) != key) | flag)
        return ok

    def spelled(t: Column) -> Column:
        out = t
        for key, label, _ in gates:
            out = F.when(F.lower(t) == key, F.lit(label)).otherwise(out)
        return out

    kept = F.transform(F.filter(raw, allowed), spelled)
    first_only = F.filter(
        kept,
        lambda t, i: ~F.exists(F.slice(kept, F.lit(1), i), lambda u: F.lower(u) == F.lower(t)),
    )
    has = lambda key: F.exists(first_only, lambda t: F.lower(t) == key)
    add = lambda flag, key, label: F.when(
        flag & ~has(key), F.array(F.lit(label))
    ).otherwise(F.array().cast("array<string>"))
    parts = [add(anon, "anonymized", "Anonymized"), first_only, add(off, "official", "Official")]
    if variant == "pipeline":
        parts.append(add(rev, "review", "Review"))
    return F.struct(
        F.concat(*parts).alias("tags"), anon.alias("anonymize"), off.alias("official"), rev.alias("review")
    )


# -- names, sizes, keys ----------------------------------------------------------------------


def _strip(c: Column, chars: str) -> Column:
    cls = "".join("\\" + ch for ch in chars)
    return F.regexp_replace(c, f"^[{cls}]+|[{cls}]+$", "")


def safe_filename(c: Column | str) -> Column:
    """Characters outside letters, digits, ``_ - .`` become ``_``."""
    s = _strip(F.regexp_replace(_c(c), r"(?U)[^\w\-.]", "_"), "_")
    return F.coalesce(F.nullif(s, F.lit("")), F.lit("item"))


def safe_id(c: Column | str, default: str = "video") -> Column:
    s = _strip(F.regexp_replace(F.trim(_c(c)), r"[^A-Za-z0-9_.-]+", "_"), "._")
    return F.coalesce(F.nullif(s, F.lit("")), F.lit(default))


def is_valid_export_name(c: Column | str) -> Column:
    return F.coalesce(_c(c).rlike(EXPORT_NAME), F.lit(False))


def ensure_mp4(c: Column | str, default: str = "redacted-video.mp4") -> Column:
    base = F.coalesce(F.nullif(F.regexp_extract(clean_str(c), r"([^\\/]*)$", 1), F.lit("")), F.lit(default))
    t = F.regexp_replace(base, r"[^\w.-]+", "_")
    return F.when(F.lower(t).endswith(".mp4"), t).otherwise(F.concat(t, F.lit(".mp4")))


def norm_height(c: Column | str, default: int = 720) -> Column:
    h = F.regexp_replace(F.lower(F.trim(_c(c).cast("string"))), "p$", "").try_cast("int")
    return F.when(h.isin(EXPORT_HEIGHTS), h).otherwise(F.lit(default))


def even_dim(c: Column) -> Column:
    r = F.bround(c.cast("double"), 0).cast("long")
    return F.greatest(F.lit(2).cast("long"), r - F.pmod(r, F.lit(2)))


def export_dims(w: Column, h: Column, target: Column) -> Column:
    """Even output size with the aspect kept and no upscaling; null for an empty source."""
    out_h = even_dim(F.least(h.cast("long"), norm_height(target).cast("long")))
    out_w = even_dim(w.cast("double") * (out_h / h.cast("double")))
    return F.when((w > 0) & (h > 0), F.struct(out_w.alias("width"), out_h.alias("height")))


def source_fingerprint(video_id: Column, updated: Column, indexed: Column, filename: Column) -> Column:
    z = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return F.concat_ws(
        "|",
        F.concat(F.lit("video:"), video_id.cast("string")),
        F.concat(F.lit("updated:"), z(updated)),
        F.concat(F.lit("indexed:"), z(indexed)),
        F.concat(F.lit("filename:"), z(filename)),
    )


def file_fingerprint(name: Column, size: Column, mtime: Column) -> Column:
    return F.concat_ws(":", F.lit("file"), name, size.cast("string"), mtime.cast("long").cast("string"))


def cache_key(video_id: Column, fingerprint: Column, schema_version: str, prompt_version: str) -> Column:
    return F.concat_ws("|", video_id.cast("string"), fingerprint, F.lit(schema_version), F.lit(prompt_version))


def digest(c: Column) -> Column:
    return F.sha2(c, 256)


def artifact_id(key: Column, prefix: str) -> Column:
    return F.concat(F.lit(prefix), F.substring(digest(key), 1, 16))


# -- times -----------------------------------------------------------------------------------


def iso_to_epoch(c: Column | str) -> Column:
    ts = F.try_to_timestamp(F.regexp_replace(_c(c), "Z$", "+00:00"))
    return F.unix_micros(ts) / 1e6


def clock_to_sec(c: Column | str) -> Column:
    """``mm:ss`` or ``hh:mm:ss`` to seconds."""
    p = F.transform(F.split(F.trim(_c(c)), ":"), lambda x: x.try_cast("int"))
    at = lambda i: F.try_element_at(p, F.lit(i))
    return F.when(F.size(p) == 2, at(1) * 60 + at(2)).when(F.size(p) == 3, at(1) * 3600 + at(2) * 60 + at(3))


def sec_to_clock(c: Column, style: str = "mmss") -> Column:
    """``mmss`` 02:05, ``millis`` 02:05.250, ``hmmss`` 1:02:05 or 2:05, ``total`` 1 h 2 min."""
    v = finite(c)
    s = F.when(v >= 0, v)
    whole = F.floor(F.coalesce(s, F.lit(0.0)))
    h, m, sec = F.floor(whole / 3600), F.floor(F.pmod(whole, F.lit(3600)) / 60), F.pmod(whole, F.lit(60))
    if style == "mmss":
        return F.format_string("%02d:%02d", F.floor(whole / 60), sec)
    if style == "millis":
        ms = F.floor((F.coalesce(s, F.lit(0.0)) - whole) * 1000 + 0.5)
        return F.format_string("%02d:%02d.%03d", F.floor(whole / 60), sec, ms)
    if style == "hmmss":
        text = F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, sec)).otherwise(F.format_string("%d:%02d", m, sec))
        return F.when(s.isNull(), F.lit("\u2014")).otherwise(text)
    if style == "total":
        return F.when(h > 0, F.format_string("%d h %d min", h, m)).otherwise(F.format_string("%d min", m))
    raise ValueError(f"unknown style {style!r}")


def duration_label(c: Column | str, style: str = "short") -> Column:
    """Reformat ``hh:mm:ss`` text; ``short`` drops empty hours, ``minutes`` folds hours into minutes."""
    c = _c(c)
    p = F.transform(F.split(c, ":"), lambda x: F.coalesce(x.try_cast("int"), F.lit(0)))
    at = lambda i: F.try_element_at(p, F.lit(i))
    if style == "minutes":
        out = F.format_string("%02d:%02d", at(1) * 60 + at(2), at(3))
    else:
        out = F.when(at(1) > 0, F.format_string("%d:%02d:%02d", at(1), at(2), at(3))).otherwise(
            F.format_string("%d:%02d", at(2), at(3))
        )
    return F.when(F.size(p) >= 3, out).otherwise(c)


def extract_timestamps(c: Column | str) -> Column:
    """Every ``mm:ss`` or ``hh:mm:ss`` mention, in order."""
    return F.regexp_extract_all(_c(c), F.lit(r"(\d{1,2}:\d{2}(?::\d{2})?)"), 1)


def norm_range(start: Column, end: Column, on_reverse: str = "swap", floor: float | None = None) -> Column:
    """One range as ``struct(start, end)``; reversed ends are swapped or clamped to the start."""
    s, e = start.cast("double"), end.cast("double")
    if on_reverse == "swap":
        lo, hi = F.least(s, e), F.greatest(s, e)
    elif on_reverse == "clamp":
        lo, hi = s, F.greatest(s, e)
    else:
        raise ValueError(f"unknown on_reverse {on_reverse!r}")
    if floor is not None:
        lo, hi = F.greatest(lo, F.lit(floor)), F.greatest(hi, F.lit(floor))
    return F.when(s.isNotNull() & e.isNotNull(), F.struct(lo.alias("start"), hi.alias("end")))


# -- search and display ----------------------------------------------------------------------


def relevance_label(clips: Column) -> Column:
    """From an array of ``struct(rank, score)``: the best rank, else a band of the best score."""
    rank = F.array_min(F.transform(clips, lambda x: x["rank"]))
    score = F.array_max(F.transform(clips, lambda x: x["score"]))
    band = F.when(score >= 0.10, "Highest").when(score >= 0.08, "High").when(score >= 0.06, "Medium").otherwise("Match")
    by_rank = F.concat(F.lit("Rank "), F.greatest(rank, F.lit(1)).cast("int").cast("string"))
    empty = F.coalesce(F.size(clips) <= 0, F.lit(True))
    return F.when(empty, "").when(rank.isNotNull(), by_rank).otherwise(band)


def preferred_thumbnail(urls: Column, metadata: Column, key: str = "preferred_thumbnail_url") -> Column:
    override = non_blank(F.try_element_at(metadata, F.lit(key)))
    return F.coalesce(override, F.try_element_at(urls, (F.floor(F.size(urls) / 2) + 1).cast("int")))


def overview_from_metadata(m: Column, about: str, topics: str, categories: str) -> Column:
    """A free metadata map to ``struct(about, topics, categories)``; null when all are missing."""
    at = lambda k: F.try_element_at(m, F.lit(k))
    empty = F.array().cast("array<string>")
    lst = lambda k: F.coalesce(F.from_json(at(k), "array<string>"), empty)
    some = at(about).isNotNull() | (F.coalesce(at(topics), F.lit("")) != "") | (F.coalesce(at(categories), F.lit("")) != "")
    return F.when(some, F.struct(at(about).alias("about"), lst(topics).alias("topics"), lst(categories).alias("categories")))


def overview_to_metadata(m: Column, text: Column, topic_list: Column, category_list: Column,
                         about: str, topics: str, categories: str) -> Column:
    """Write the supplied parts back into the map; null parts leave it alone."""
    new = F.map_filter(
        F.create_map(F.lit(about), text, F.lit(topics), F.to_json(topic_list), F.lit(categories), F.to_json(category_list)),
        lambda k, v: v.isNotNull(),
    )
    old = F.coalesce(m, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))
    return F.map_concat(F.map_filter(old, lambda k, v: ~F.map_contains_key(new, k)), new)


def region_mode(mode: Column, reason: Column) -> Column:
    m = F.lower(clean_str(mode))
    about_face = F.lower(F.coalesce(reason, F.lit(""))).rlike("face|person|head")
    return F.when(m.isin("face", "generic"), m).when(about_face, "face").otherwise("generic")


def mention_parts(c: Column | str) -> Column:
    """``before @name rest``: the text before the last mention and the first token after it."""
    c = _c(c)
    has = F.coalesce(c.contains("@"), F.lit(False))
    return F.struct(
        has.alias("has_mention"),
        F.when(has, F.regexp_extract(c, r"@([^@\s]*)[^@]*$", 1)).otherwise("").alias("mention"),
        F.when(has, F.regexp_extract(c, r"^([\s\S]*)@[^@]*$", 1)).otherwise(c).alias("before"),
    )


def entity_query(ids: Column, suffix: Column) -> Column:
    marks = F.array_join(F.transform(ids, lambda x: F.concat(F.lit("<@"), x, F.lit(">"))), " ")
    return F.trim(F.concat_ws(" ", marks, non_blank(suffix)))


def initials(c: Column | str) -> Column:
    """The first letter of a name, ``?`` when there is none."""
    first = F.upper(F.substring(clean_str(c), 1, 1))
    return F.when(first == "", "?").otherwise(first)


def title_label(c: Column | str, default: str = "Review") -> Column:
    t = F.trim(F.translate(clean_str(c), "_", " "))
    return F.when(t == "", default).otherwise(F.initcap(t))


def pct_label(c: Column) -> Column:
    share = F.least(F.lit(1.0), F.greatest(F.lit(0.0), finite(c)))
    return F.coalesce(F.concat(F.floor(share * 100 + 0.5).cast("string"), F.lit("%")), F.lit("N/A"))


def session_id(explicit: Column, entity_ids: Column, query: Column, query_text: Column, result_ids: Column,
               index: Column) -> Column:
    """Explicit id, else the joined entity ids, else query texts, first three results and position."""
    ids = F.array_join(F.filter(entity_ids, lambda x: x != ""), "|")
    z = lambda c: F.coalesce(c, F.lit(""))
    first = F.array_join(F.slice(F.filter(result_ids, lambda x: x != ""), 1, 3), "|")
    by_query = F.concat_ws(":", F.lit("search"), z(query), z(query_text), z(first), index.cast("string"))
    by_entity = F.when(z(ids) != "", F.concat(F.lit("entities:"), ids))
    return F.coalesce(F.nullif(explicit, F.lit("")), by_entity, by_query)


def seq_id(prefix: str, n: Column, width: int = 0) -> Column:
    """``evt_001`` or ``person_7`` style ids."""
    return F.format_string(f"{prefix}%0{width}d" if width else f"{prefix}%d", n)


def null_safe_hash(*cols: str) -> Column:
    """A 64-bit hash of columns in which a null counts: (null, a) and (a, null) differ."""
    return F.xxhash64(*(x for c in cols for x in (F.col(c).isNull(), F.col(c).cast("string"))))
