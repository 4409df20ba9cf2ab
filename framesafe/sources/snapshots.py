"""Snapshot images as tables: reading, naming, writing, recovering identities from names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import safe_filename
from .files import write_files

IMAGE_SUFFIX = r"(?i)\.(png|jpg|jpeg)$"


def read_snapshots(spark: SparkSession, glob: str, content: bool = True) -> DataFrame:
    """``job_id`` (two directories up), ``folder``, ``filename`` and the base64 content."""
    df = spark.read.format("binaryFile").load(glob).where(F.col("path").rlike(IMAGE_SUFFIX))
    parts = F.split("path", "/")
    out = df.select(F.element_at(parts, -3).alias("job_id"), F.element_at(parts, -2).alias("folder"), F.element_at(parts, -1).alias("filename"), "path",
                    *([F.base64("content").alias("snap_base64")] if content else []))
    return out


def snapshots_to_identities(snaps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Faces and objects told from bare file names, for runs without metadata."""
    stem = F.regexp_replace("filename", r"\.[^.]*$", "")
    extra = [c for c in ("snap_base64",) if c in snaps.columns]
    faces = snaps.where(F.col("folder") == "faces").select(
        "job_id", stem.alias("person_id"), stem.alias("stable_person_id"), F.initcap(F.translate(stem, "_", " ")).alias("description"), *extra
    )
    p = F.split(stem, "_")
    oid = F.when(F.size(p) >= 2, F.concat_ws("_", F.try_element_at(p, F.lit(1)), F.try_element_at(p, F.lit(2)))).otherwise(stem)
    rest = F.array_join(F.slice(p, F.lit(3), F.greatest(F.size(p) - 2, F.lit(0))), "_")
    name = F.when(F.size(p) > 2, rest).when(F.size(p) == 2, F.try_element_at(p, F.lit(2))).otherwise(stem)
    objects = snaps.where(F.col("folder") == "objects").select(
        "job_id", oid.alias("object_id"), F.initcap(F.translate(name, "_", " ")).alias("identification"), *extra
    )
    return faces, objects


def snapshot_export_plan(faces: DataFrame, objects: DataFrame) -> DataFrame:
    """Relative file name and bytes of every snapshot."""
    fn = F.concat(F.lit("faces/"), safe_filename(F.coalesce(F.nullif("name", F.lit("")), F.col("person_id"))), F.lit(".png"))
    on = F.concat(F.lit("objects/"), F.col("object_id"), F.lit("_"), safe_filename(F.coalesce("identification", F.lit("object"))), F.lit(".jpg"))
    has = F.coalesce("snap_base64", F.lit("")) != ""
    return (
        faces.where(has).select("job_id", fn.alias("path"), F.unbase64("snap_base64").alias("content"))
        .unionByName(objects.where(has).select("job_id", on.alias("path"), F.unbase64("snap_base64").alias("content")))
    )


def write_snapshots(plan: DataFrame, root: str) -> None:
    """Write every snapshot to ``root/job_id/path``, all of them or none; ``root`` is a folder that all executors can reach."""
    write_files(plan.select(F.concat_ws("/", F.col("job_id").cast("string"), "path").alias("path"), "content"), root)


def list_files(spark: SparkSession, glob: str) -> DataFrame:
    """Path, name, size and time of files, without reading them."""
    df = spark.read.format("binaryFile").load(glob)
    return df.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"),
                     (F.unix_micros("modificationTime") / 1e6).alias("mtime"))
