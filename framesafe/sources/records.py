"""Loose service records (VARIANT) to canonical columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.payload import get
from ..functions.scalars import non_blank, preferred_thumbnail


def _text(v: Column, *keys: str) -> Column:
    return F.coalesce(*(F.try_variant_get(get(v, k), "$", "string") for k in keys))


def _num(v: Column, *keys: str, type_: str = "double") -> Column:
    return F.coalesce(*(F.try_variant_get(get(v, k), "$", type_) for k in keys))


def project_entity(v: Column) -> list[Column]:
    return [
        _text(v, "_id", "id").alias("entity_id"), _text(v, "name").alias("name"), _text(v, "description").alias("description"),
        _text(v, "status").alias("status"),
        F.coalesce(*(F.try_variant_get(get(v, k), "$", "array<string>") for k in ("asset_ids", "assetIds"))).alias("asset_ids"),
        F.try_variant_get(get(v, "metadata"), "$", "map<string,string>").alias("metadata"),
        _text(v, "created_at", "createdAt").alias("created_at"),
    ]


def project_collection(v: Column) -> list[Column]:
    return [_text(v, "_id", "id").alias("id"), _text(v, "name").alias("name"), _text(v, "description").alias("description"),
            _text(v, "created_at", "createdAt").alias("created_at")]


def project_video(v: Column) -> list[Column]:
    s = get(v, "system_metadata")
    h = get(v, "hls")
    urls = F.try_variant_get(get(h, "thumbnail_urls"), "$", "array<string>")
    meta = F.try_variant_get(get(v, "user_metadata"), "$", "map<string,string>")
    return [
        _text(v, "video_id", "id", "_id").alias("video_id"), _text(s, "filename").alias("filename"), _num(s, "duration").alias("duration"),
        _num(s, "fps").alias("fps"), _num(s, "width", type_="int").alias("width"), _num(s, "height", type_="int").alias("height"),
        _num(s, "size", type_="bigint").alias("size"), meta.alias("user_metadata"), _text(h, "video_url").alias("stream_url"),
        _text(h, "status").alias("stream_status"), preferred_thumbnail(urls, meta).alias("thumbnail_url"),
        *(_text(v, c).alias(c) for c in ("created_at", "updated_at", "indexed_at")),
    ]


def project_task(v: Column) -> list[Column]:
    s = get(v, "system_metadata")
    return [
        _text(v, "task_id", "_id", "id").alias("task_id"), _text(v, "video_id").alias("video_id"), _text(v, "status").alias("status"),
        _text(v, "index_id").alias("index_id"), _text(s, "filename").alias("filename"), _num(s, "duration").alias("duration"),
        _num(s, "width", type_="int").alias("width"), _num(s, "height", type_="int").alias("height"),
        _text(v, "created_at").alias("created_at"), _text(v, "updated_at").alias("updated_at"),
    ]


def project_entity_option(v: Column) -> list[Column]:
    eid = _text(v, "id", "entity_id")
    m = get(v, "metadata")
    face = non_blank(_text(m, "face_snap_base64"))
    return [eid.alias("id"), F.coalesce(non_blank(_text(m, "name")), non_blank(_text(v, "name")), eid).alias("name"),
            F.coalesce(F.concat(F.lit("data:image/png;base64,"), face), F.lit("")).alias("preview_url")]
