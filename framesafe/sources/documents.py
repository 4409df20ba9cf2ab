"""Manifests, detection metadata, privacy artifacts, lanes: JSON documents to tables and back."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from ..functions.boxes import box_from_array, is_valid, valid_box
from ..functions.scalars import artifact_id, digest, finite, safe_id
from .files import write_files

LANE_VERSION = 6
DETECTION_VERSION = 1


def _documents(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Whole-file JSON documents with their path; unreadable files give no row."""
    raw = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("file_path"))
    good = raw.where(F.try_parse_json("value").isNotNull())
    return good.select(F.from_json("value", schema).alias("d"), "file_path").select("d.*", "file_path")


def run_id(path: Column) -> Column:
    """The directory that holds the file."""
    parts = F.split(path, "/")
    return F.element_at(parts, -2)


# -- manifests -------------------------------------------------------------------------------


def read_manifests(spark: SparkSession, root: str, service: str = "service", pattern: str = "*/job_manifest.json") -> DataFrame:
    """Job rows, with the service's columns under neutral names and the directory as fallback id."""
    df = _documents(spark, f"{root.rstrip('/')}/{pattern}", schemas.manifest(service))
    names = {f"{service}_{n}": n if n == "video_id" else f"analysis_{n}" for n in ("video_id", "status", "people", "objects", "scene_summary")}
    return df.withColumnsRenamed(names).withColumn("job_id", F.coalesce("job_id", run_id(F.col("file_path"))))


def write_manifests(jobs: DataFrame, path: str, buckets: int = 64) -> None:
    """The job table as parquet, partitioned by a hash bucket of the job id for pruned lookups."""
    jobs.withColumn("job_bucket", F.pmod(F.xxhash64("job_id"), F.lit(buckets)).cast("int")).write.mode("overwrite").partitionBy("job_bucket").parquet(path)


def people_of(manifests: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """People, their time ranges and the scenes of the manifests."""
    p = manifests.select("job_id", F.posexplode("analysis_people").alias("desc_index", "p"))
    people = p.select("job_id", "desc_index", "p.*").drop("time_ranges")
    ranges = p.select("job_id", "desc_index", F.posexplode("p.time_ranges").alias("range_id", "r")).select(
        "job_id", "desc_index", "range_id", F.col("r.start_sec").alias("start"), F.col("r.end_sec").alias("end")
    )
    scenes = manifests.select("job_id", F.posexplode("analysis_scene_summary.scenes").alias("pos", "s")).select("job_id", "pos", "s.*")
    return people, ranges, scenes


# -- detection metadata ----------------------------------------------------------------------


def read_detections(spark: SparkSession, root: str, pattern: str = "*/detection_metadata.json") -> tuple[DataFrame, DataFrame, DataFrame]:
    """``faces``, ``appearances`` and ``objects``."""
    df = _documents(spark, f"{root.rstrip('/')}/{pattern}", schemas.detections()).withColumn("job_id", run_id(F.col("file_path")))
    f = df.select("job_id", F.posexplode("unique_faces").alias("face_pos", "f"))
    faces = f.select("job_id", "face_pos", "f.*").drop("appearances")
    b = box_from_array("a.bbox")
    app = f.select("job_id", "face_pos", F.col("f.person_id").alias("person_id"), F.posexplode("f.appearances").alias("seq", "a"))
    appearances = app.select("job_id", "face_pos", "person_id", "seq", F.col("a.frame_idx").alias("frame_idx"), F.col("a.timestamp").alias("t"), *valid_box(b).columns())
    objects = df.select("job_id", F.posexplode("unique_objects").alias("object_pos", "o")).select("job_id", "object_pos", "o.*")
    return faces, appearances, objects


def clean_numbers(df: DataFrame) -> DataFrame:
    """Non-finite numbers in top-level columns and numeric arrays become null."""
    fixes = {}
    for f in df.schema:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            fixes[f.name] = finite(F.col(f.name)).cast(f.dataType)
        elif isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, (T.DoubleType, T.FloatType)):
            fixes[f.name] = F.transform(F.col(f.name), lambda x: finite(x)).cast(f.dataType)
    return df.withColumns(fixes) if fixes else df


def detection_documents(faces: DataFrame, appearances: DataFrame, objects: DataFrame) -> DataFrame:
    """One document per job, ready to be written as JSON: no image bytes, no non-finite numbers, version 1.

    The arrays are what the document format asks for; a job is one video.
    """
    a = appearances.groupBy("job_id", "face_pos").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("seq", "frame_idx", "t", "x1", "y1", "x2", "y2"))),
            lambda r: F.struct(r["frame_idx"].alias("frame_idx"), r["t"].alias("timestamp"),
                               F.array(r["x1"], r["y1"], r["x2"], r["y2"]).alias("bbox")),
        ).alias("appearances")
    )
    f = clean_numbers(faces.drop("snap_base64")).join(a, ["job_id", "face_pos"], "left")
    f = f.groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct("face_pos", *[c for c in f.columns if c not in ("job_id", "face_pos")]))).alias("unique_faces"))
    o = clean_numbers(objects.drop("snap_base64"))
    o = o.groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct("object_pos", *[c for c in o.columns if c not in ("job_id", "object_pos")]))).alias("unique_objects"))
    j = f.join(o, "job_id", "full_outer")
    return j.select("job_id", F.lit(DETECTION_VERSION).alias("version"), "unique_faces", "unique_objects")


def write_detections(faces: DataFrame, appearances: DataFrame, objects: DataFrame, path: str) -> None:
    detection_documents(faces, appearances, objects).write.mode("overwrite").partitionBy("job_id").json(path)


# -- privacy artifacts -----------------------------------------------------------------------


def read_privacy_artifacts(spark: SparkSession, glob: str, service: str = "service") -> tuple[DataFrame, DataFrame, DataFrame]:
    """``artifacts``, ``events`` and ``actions``."""
    df = _documents(spark, glob, schemas.privacy_artifact(service))
    art = df.select("file_path", "metadata.*", "summary.*").withColumnRenamed(f"{service}_task_id", "task_id")
    key = F.col("metadata.artifact_id").alias("artifact_id")
    events = df.select("file_path", key, F.posexplode("timeline_events").alias("pos", "e")).select("file_path", "artifact_id", "pos", "e.*")
    actions = df.select("file_path", key, F.posexplode("recommended_actions").alias("pos", "a")).select("file_path", "artifact_id", "pos", "a.*")
    return art, events, actions


def artifact_paths(df: DataFrame, root: str, prefix: str, job_dir: str, filename: str) -> DataFrame:
    """Where an artifact goes: the job directory, the canonical path, and the record of its id."""
    d = digest(F.col("cache_key"))
    canonical = F.concat(F.lit(f"{root}/artifacts/"), safe_id("video_id"), F.lit("_"), F.substring(d, 1, 12), F.lit(".json"))
    local = F.concat(F.lit(f"{job_dir}/"), F.col("local_job_id"), F.lit(f"/{filename}"))
    aid = artifact_id(F.col("cache_key"), prefix)
    return df.withColumns({
        "artifact_id": aid, "canonical_path": canonical,
        "path": F.when(F.col("local_job_id").isNotNull(), local).otherwise(canonical),
        "record_path": F.concat(F.lit(f"{root}/jobs/"), safe_id(aid), F.lit(".json")),
    })


def artifact_files(df: DataFrame, root: str) -> DataFrame:
    """``path, content`` of the documents of artifacts (see ``artifact_paths``), relative to ``root``.

    Each artifact stands at its ``path`` and at the canonical one, and the newest of an id has a job record.
    ``df``: ``artifact_id, path, canonical_path, record_path, status, updated_at`` and ``document``, the artifact as text.
    Paths outside ``root`` are refused when written.
    """
    below = lambda c: F.regexp_replace(c, f"^{re.escape(root.rstrip('/'))}/", "")
    places = F.array_distinct(F.array("path", "canonical_path"))
    documents = df.select("updated_at", "artifact_id", F.explode(places).alias("path"), F.col("document").alias("content"))
    newest = df.groupBy("artifact_id").agg(F.max(F.struct("updated_at", "status", "path", "record_path")).alias("m"))
    record = F.to_json(F.struct(F.col("artifact_id").alias("job_id"), "m.status", F.col("m.path").alias("artifact_path"), F.lit(False).alias("cached"), "m.updated_at"))
    records = newest.select("m.updated_at", "artifact_id", F.col("m.record_path").alias("path"), record.alias("content"))
    # two artifacts of one place: the newest stays
    each = documents.unionByName(records).groupBy("path").agg(F.max_by("content", F.struct("updated_at", "content")).alias("content"))
    return each.select(below("path").alias("path"), F.col("content").cast("binary").alias("content"))


def write_privacy_artifacts(df: DataFrame, root: str) -> None:
    """Write artifacts to both their paths and their job records, all files or none (see ``artifact_files``)."""
    write_files(artifact_files(df, root), root)


def resolve_cached_artifact(requests: DataFrame, artifacts: DataFrame) -> DataFrame:
    """The stored artifact of each request: same cache key first, else same video and ready.

    Among several, the request's own job directory comes first, then the canonical path, then other paths in
    order. ``requests``: request_id, video_id, cache_key, own_path, canonical_path; ``artifacts``: video_id,
    cache_key, status, path.
    """
    a = artifacts.select("video_id", F.col("cache_key").alias("__key"), "status", "path")
    exact = requests.join(a.drop("video_id"), F.col("cache_key") == F.col("__key"))
    same = requests.join(a, "video_id").where(F.col("status").isNull() | (F.col("status") == "ready"))
    place = F.when(F.col("path") == F.col("own_path"), 0).when(F.col("path") == F.col("canonical_path"), 1).otherwise(2)
    def ranked(df: DataFrame, how: str, step: int) -> DataFrame:
        return df.select("request_id", F.struct(F.lit(step).alias("step"), place.alias("place"), "path", F.coalesce("status", F.lit("ready")).alias("status"), F.lit(how).alias("cache_status")).alias("m"))

    both = ranked(exact, "hit", 0).unionByName(ranked(same, "video_id_fallback", 1))
    best = both.groupBy("request_id").agg(F.min("m").alias("m"))
    return best.select("request_id", "m.path", "m.status", "m.cache_status")


# -- lanes -----------------------------------------------------------------------------------


def read_lanes(spark: SparkSession, glob: str, min_version: int = LANE_VERSION) -> tuple[DataFrame, DataFrame]:
    """Lane headers and rows; empty or outdated lanes count as missing."""
    df = _documents(spark, glob, schemas.lane()).where((F.col("build_version") >= min_version) & (F.size("lane") > 0))
    head = df.select("job_id", "person_id", "build_version", "video.*", "segments", "built_at")
    rows = df.select("job_id", "person_id", F.explode("lane").alias("r")).select("job_id", "person_id", "r.*")
    return head, rows


def write_lanes(lane: DataFrame, path: str, keys: Sequence[str] = ("job_id", "person_id")) -> None:
    """Serialised lane rows as parquet, a lane's rows together and in frame order."""
    lane.repartition(*keys).sortWithinPartitions(*keys, "f").write.mode("overwrite").parquet(path)


def lane_documents(lane: DataFrame, header: DataFrame, keys: Sequence[str] = ("job_id", "person_id")) -> DataFrame:
    """Lane documents for tools that want one JSON per person."""
    body = lane.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("f", "t", "x1", "y1", "x2", "y2", "src", "conf"))).alias("lane"))
    return header.join(body, list(keys)).withColumn("build_version", F.lit(LANE_VERSION))


def lane_boxes(lane: DataFrame, job: str = "job_id") -> DataFrame:
    """Lane rows usable as masks: numbers present, area not empty."""
    from ..functions.boxes import box

    return lane.where(F.col("f").isNotNull() & is_valid(box()))
