"""Loose JSON payloads as VARIANT: parsing, result lookup, segment lists, segment fields.

A payload column is VARIANT. Segment fields are ``MAP<STRING, VARIANT>`` with own keys winning over
container keys, so every later lookup is one map access.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scalars import lenient_double

# Key names a payload may use.
RESULT_KEYS = ["result", "results", "data", "output", "response"]
LIST_KEYS = ["segments", "items", "chapters", "highlights", "data"]
CONTAINER_KEYS = ["fields", "metadata", "attributes", "values", "response"]
START_KEYS = ["start_sec", "start_time", "start", "begin", "from"]
END_KEYS = ["end_sec", "end_time", "end", "finish", "to"]
SPAN_KEYS = ["time_range", "timestamp", "time"]
PAGE_KEYS = ["data", "entity_collections", "entities", "items"]
READY_WORDS = ["ready", "completed", "complete", "succeeded", "success"]
FAILED_WORDS = ["failed", "error"]
QUEUED_WORDS = ["queued", "pending"]

_ARRAY = "array<variant>"
_MAP = "map<string,variant>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it.

    Column expressions have no local names; nesting helpers that read their argument several times would
    grow the plan exponentially. A one-element transform binds the value.
    """
    return F.transform(F.array(value), body)[0]


def _kind(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v), F.lit("VOID"))


def is_list(v: Column) -> Column:
    return _kind(v).startswith("ARRAY")


def is_object(v: Column) -> Column:
    return _kind(v).startswith("OBJECT")


def text_of(v: Column) -> Column:
    """The text of a JSON string; null for any other kind."""
    return F.when(_kind(v) == "STRING", F.try_variant_get(v, "$", "string"))


def number_of(v: Column) -> Column:
    """A JSON number or a string holding one; booleans and the rest give null."""
    return F.when(_kind(v) != "BOOLEAN", lenient_double(F.try_variant_get(v, "$", "string")))


def get(v: Column, key: str) -> Column:
    return F.try_variant_get(v, f"$['{key}']", "variant")


def fenced_json(c: Column, extract: bool = False) -> Column:
    """JSON text, possibly inside a code fence, to VARIANT; invalid text gives null.

    With ``extract`` the outermost object or list inside other text is taken.
    """
    blank = F.lit(" \t\r\n")

    def unfence(t: Column) -> Column:
        inner = F.regexp_replace(F.regexp_replace(t, r"^```[^\n]*(\n|$)", ""), r"(^|\n)[ \t]*```[ \t]*$", "")
        return F.when(t.startswith("```"), F.trim(inner, blank)).otherwise(t)

    def cut(t: Column) -> Column:
        inside = F.regexp_extract(t, r"(\{[\s\S]*\}|\[[\s\S]*\])", 1)
        return F.coalesce(F.nullif(inside, F.lit("")), t)

    t = let(F.trim(c, blank), unfence)
    if extract:
        t = let(t, cut)
    return F.try_parse_json(F.nullif(t, F.lit("")))


def _opened(v: Column, extract: bool) -> Column:
    """A JSON string holding JSON becomes that JSON."""
    return let(v, lambda x: F.when(_kind(x) == "STRING", fenced_json(F.try_variant_get(x, "$", "string"), extract)).otherwise(x))


def _members(v: Column, keys: list[str], pick: Callable[[Column], Column] | None = None) -> Column:
    """The values an object has under ``keys``, in the order of ``keys``."""
    names = F.array(*(F.lit(k) for k in keys))
    body = pick or (lambda x: x)
    found = let(F.try_variant_get(v, "$", _MAP), lambda m: F.transform(names, lambda k: body(F.try_element_at(m, k))))
    return F.array_compact(found)


def _first(arr: Column) -> Column:
    return F.try_element_at(arr, F.lit(1))


def task_result(v: Column) -> Column:
    """First result-like key that is neither null nor empty text, else the payload itself."""
    filled = lambda x: ~F.is_variant_null(x) & (F.coalesce(text_of(x), F.lit("-")) != "")
    return let(v, lambda p: F.coalesce(_first(F.filter(_members(p, RESULT_KEYS), filled)), p))


def open_payload(c: Column) -> Column:
    """Task payload text to its result: the payload, its result key, JSON inside text opened."""
    return let(fenced_json(c, extract=True), lambda v: F.coalesce(_opened(task_result(v), True), v))


def task_id(v: Column) -> Column:
    ids = [F.nullif(F.trim(text_of(get(v, k))), F.lit("")) for k in ("id", "_id", "task_id")]
    return F.coalesce(*ids, F.lit(""))


def fold_status(c: Column) -> Column:
    t = F.lower(F.trim(c))
    return (
        F.when(t.isin(READY_WORDS), "ready")
        .when(t.isin(FAILED_WORDS), "failed")
        .when(t.isin(QUEUED_WORDS), "queued")
        .otherwise("processing")
    )


def task_status(v: Column) -> Column:
    return fold_status(text_of(F.coalesce(get(v, "status"), get(v, "state"))))


def _objects_under_any_key(v: Column) -> Column:
    lists = F.transform(F.map_values(F.try_variant_get(v, "$", _MAP)), lambda x: F.try_variant_get(x, "$", _ARRAY))
    good = F.filter(lists, lambda a: a.isNotNull() & (F.size(a) > 0) & F.forall(a, is_object))
    return F.flatten(good)


def _non_empty(a: Column) -> Column:
    return let(a, lambda x: F.when(F.size(x) > 0, x))


def segments(v: Column, definition_ids: list[str], order: str = "keys_first", extract: bool = True,
             any_key: bool = True, depth: int = 3) -> Column:
    """The segment list of a payload as ``ARRAY<VARIANT>``; empty when there is none.

    A list is taken as it is. An object is searched under the usual list keys, then under the
    definition ids, then under any key holding a list of objects, then inside ``result``; strings
    holding JSON are opened on the way. ``order="ids_first"`` looks under the definition ids first.
    Nesting is followed ``depth`` levels.
    """
    empty = F.array().cast(_ARRAY)
    opened = lambda x: _opened(x, extract)
    as_list = lambda x: F.try_variant_get(x, "$", _ARRAY)

    def search(cur: Column, inside: Column, left: int) -> Column:
        own = F.when(is_list(cur), as_list(cur))
        by_key = _first(F.array_compact(F.transform(F.slice(inside, 1, len(LIST_KEYS)), as_list)))
        found = [by_key]
        if definition_ids:
            grouped = _non_empty(F.flatten(F.transform(_members(cur, definition_ids, opened), lambda x: F.coalesce(as_list(x), empty))))
            found = [by_key, grouped] if order == "keys_first" else [grouped, by_key]
        loose = [_non_empty(_objects_under_any_key(cur))] if any_key else []
        deeper = [let(F.coalesce(_first(F.filter(inside, is_object)), F.element_at(inside, -1)), lambda x: level(x, left - 1))] if left > 1 else []
        return F.coalesce(own, *found, *loose, *deeper)

    def level(cur: Column, left: int) -> Column:
        # every listed key keeps its place, so the list keys are the first ones
        names = F.array(*(F.lit(k) for k in [*LIST_KEYS, "result"]))
        inside = let(F.try_variant_get(cur, "$", _MAP), lambda m: F.transform(names, lambda k: opened(F.try_element_at(m, k))))
        return let(inside, lambda i: search(cur, i, left))

    return F.coalesce(let(_opened(v, extract), lambda c: level(c, depth)), empty)


def segment_fields(v: Column) -> Column:
    """Container maps merged in order, own keys on top."""
    as_map = lambda x: F.try_variant_get(x, "$", _MAP)
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast(_ARRAY))
    layers = F.array_compact(F.concat(F.transform(_members(v, CONTAINER_KEYS), as_map), F.array(as_map(v))))
    over = lambda below, top: F.map_concat(F.map_filter(below, lambda k, _: ~F.map_contains_key(top, k)), top)
    return F.aggregate(layers, none, over)


def field_texts(m: Column) -> Column:
    """The fields as text: JSON strings trimmed, every other kind empty."""
    return F.transform_values(m, lambda _, x: F.coalesce(F.trim(text_of(x)), F.lit("")))


def text(texts: Column, *keys: str) -> Column:
    """The text of the first key present, empty when there is none."""
    return F.coalesce(*(F.try_element_at(texts, F.lit(k)) for k in keys), F.lit(""))


def field(m: Column, *keys: str) -> Column:
    """The first key present, JSON null included."""
    return F.coalesce(*(F.try_element_at(m, F.lit(k)) for k in keys))


def field_number(m: Column, *keys: str) -> Column:
    return number_of(field(m, *keys))


def field_bool(m: Column, *keys: str) -> Column:
    v = field(m, *keys)
    t = F.lower(F.trim(F.try_variant_get(v, "$", "string")))
    return F.coalesce(t.isin("1", "true", "yes", "on") | ((_kind(v) != "STRING") & (t.try_cast("double") != 0)), F.lit(False))


def segment_time(m: Column, start: bool) -> Column:
    """Seconds from the first of the usual keys, else from a nested span, never below 0."""
    keys = START_KEYS if start else END_KEYS
    nested = F.coalesce(*(F.when(is_object(field(m, k)), field(m, k)) for k in SPAN_KEYS))
    inner = number_of(F.coalesce(*(get(nested, k) for k in keys)))
    return F.greatest(F.lit(0.0), F.coalesce(field_number(m, *keys), inner, F.lit(0.0)))


def field_tags(m: Column, key: str = "tags") -> Column:
    v = field(m, key)
    many = F.transform(F.try_variant_get(v, "$", _ARRAY), lambda x: F.try_variant_get(x, "$", "string"))
    tags = F.transform(F.coalesce(many, F.split(text_of(v), ","), F.array().cast("array<string>")), lambda x: F.trim(x))
    return F.filter(tags, lambda x: x != "")


def list_items(v: Column) -> Column:
    """Items of one page of a listing."""
    as_list = lambda x: F.try_variant_get(x, "$", _ARRAY)
    own = F.when(is_list(v), as_list(v))
    return F.coalesce(own, _first(_members(v, PAGE_KEYS, as_list)), F.array().cast(_ARRAY))


def next_page_token(v: Column) -> Column:
    inner = text_of(get(get(v, "page_info"), "next_page_token"))
    return F.coalesce(F.nullif(inner, F.lit("")), F.nullif(text_of(get(v, "next_page_token")), F.lit("")))


def flatten_pages(pages: DataFrame, payload: str, *keys: str) -> DataFrame:
    """One row per item of each page, with its position."""
    items = list_items(F.col(payload))
    return pages.select(*keys, F.posexplode(items).alias("item_pos", "item"))
