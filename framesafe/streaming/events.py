"""Progress changes, appearance sessions, sample bursts, artifact ingest."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from ..functions.payload import fold_status
from ..operators.boxjoins import merge_temporal

PROGRESS_SCHEMA = "redaction_job_id string, ts timestamp, stage string, percent int, message string"


class _Changes(StatefulProcessor):
    """Remembers the last stage and percent of a job."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "stage string, percent int, ts timestamp")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        b = pd.concat(list(rows)).sort_values("ts", kind="stable")
        prev = self.last.get() if self.last.exists() else None
        if prev is not None:  # late progress is of no use
            b = b[b["ts"] >= pd.Timestamp(prev[2])]
        if len(b):
            stage = b["stage"].shift(1, fill_value=prev[0] if prev else None)
            pct = b["percent"].shift(1, fill_value=prev[1] if prev else -1)
            end = b.iloc[-1]
            self.last.update((str(end["stage"]), int(end["percent"]), end["ts"].to_pydatetime()))
            b = b[(b["stage"] != stage) | (b["percent"] != pct)]
        yield b[["redaction_job_id", "ts", "stage", "percent", "message"]]

    def close(self) -> None:
        pass


def progress_stream(stream: DataFrame) -> DataFrame:
    """Progress rows of each job, changes only."""
    return (
        stream.select("redaction_job_id", "ts", "stage", F.col("percent").cast("int").alias("percent"), "message")
        .groupBy("redaction_job_id")
        .transformWithStateInPandas(
            statefulProcessor=_Changes(), outputStructType=StructType.fromDDL(PROGRESS_SCHEMA), outputMode="Update", timeMode="None"
        )
    )


def latest_progress(progress: DataFrame) -> DataFrame:
    """The newest progress row per job."""
    m = progress.groupBy("redaction_job_id").agg(F.max(F.struct("ts", "stage", "percent", "message")).alias("m"))
    return m.select("redaction_job_id", "m.*")


def appearance_sessions(df: DataFrame, keys: Sequence[str], ts: str = "ts", gap: str = "4 seconds", late: str = "10 seconds") -> DataFrame:
    """Sessions of appearances, stream or table; a gap of exactly ``gap`` still joins."""
    src = df.withWatermark(ts, late) if df.isStreaming else df
    s = F.session_window(ts, gap).alias("w")
    g = src.groupBy(*keys, s).agg(F.count(F.lit(1)).alias("appearances"), F.max(ts).alias("last_seen"))
    return g.select(*keys, F.col("w.start").alias("first_seen"), "last_seen", "appearances")


def burst_pairs(requests: DataFrame, samples: DataFrame, keys: Sequence[str], reach: float = 0.12, delay: str = "2 seconds") -> DataFrame:
    """Each request with each sample within ``reach`` seconds of it, streams or tables.

    ``requests``: ``keys, request_id, ts``; ``samples``: ``keys, sample_ts`` and the columns of a detection with its
    ``seq``. Both ends count. Streams are joined by an interval of event times behind both watermarks, so state ends
    ``reach`` and ``delay`` after a row. A sample serves every request that it is near to; requests without samples
    have no rows.

    The join is by key and second, so that a busy key is many small groups; a request stands in the one or two
    seconds that its interval touches, a sample in one, so no pair comes twice.
    """
    width = F.expr(f"INTERVAL {round(reach * 1_000_000)} MICROSECOND")
    second = lambda c: F.floor(F.unix_micros(c) / F.lit(1_000_000)).cast("long")
    if requests.isStreaming:
        requests, samples = requests.withWatermark("ts", delay), samples.withWatermark("sample_ts", delay)
    asked = requests.select(*keys, "request_id", "ts", F.explode(F.sequence(second(F.col("ts") - width), second(F.col("ts") + width))).alias("__second"))
    taken = samples.withColumn("__second", second(F.col("sample_ts")))
    near = F.expr(f"sample_ts BETWEEN ts - INTERVAL {round(reach * 1_000_000)} MICROSECOND AND ts + INTERVAL {round(reach * 1_000_000)} MICROSECOND")
    return asked.join(taken, [*keys, "__second"]).where(near).drop("__second")


def sample_bursts(requests: DataFrame, samples: DataFrame, keys: Sequence[str], reach: float = 0.12, delay: str = "2 seconds", distinct_faces: bool = False) -> DataFrame:
    """The merged detections of the samples about each request (see ``burst_pairs``); of a stream, when no sample can join any more."""
    seconds = lambda c: F.unix_micros(c) / F.lit(1e6)
    pairs = burst_pairs(requests, samples, keys, reach, delay).withColumns({"t": seconds("ts"), "sample_time": seconds("sample_ts")})
    return merge_temporal(pairs, [*keys, "request_id", "ts"], distinct_faces=distinct_faces)


# -- artifacts -------------------------------------------------------------------------------

VERSIONS, CURRENT = "versions", "current"
REPAIRS = 1 << 40  # number of the first batch of repairs, behind all batches of streams


def folded_artifacts(artifacts: DataFrame, tasks: DataFrame | None = None, faces: DataFrame | None = None) -> DataFrame:
    """Artifacts with their status folded, and those stuck in ``processing`` repaired.

    ``tasks`` (``task_id, status, error``): what the service says of a task that is not done. Its folded status holds;
    a failed task takes its error, or a general one, along. ``faces`` (``job_id``, one row or more where a job has
    faces on disk): an artifact that no task answers for and that is still ``processing`` is ready if its job has
    faces, else failed. Without ``faces`` it stays as it is. Done artifacts are left alone.
    """
    m = F.col("metadata")
    status = F.coalesce(F.nullif(F.trim(m["status"]), F.lit("")), F.lit("processing"))
    out = artifacts.withColumn("status", F.when(F.lower(status).isin("ready", "failed"), F.lower(status)).otherwise(fold_status(status)))
    out = out if "error" in out.columns else out.withColumn("error", F.lit(None).cast("string"))
    service = next(c for c in artifacts.schema["metadata"].dataType.names if c.endswith("_task_id"))
    open_ = ~F.col("status").isin("ready", "failed")
    out = out.withColumn("__task", F.when(open_, F.nullif(F.trim(m[service]), F.lit(""))))
    if tasks is not None:
        said = tasks.groupBy(F.col("task_id").alias("__task")).agg(F.max(F.struct(fold_status(F.col("status")).alias("s"), F.col("error").alias("e"))).alias("__said"))
        out = out.join(said, "__task", "left")
        failed = F.col("__said.s") == "failed"
        error = F.when(failed, F.coalesce(F.nullif(F.trim("__said.e"), F.lit("")), F.lit("analysis failed"))).otherwise(F.col("error"))
        out = out.withColumns({"error": error, "__answered": F.col("__said").isNotNull(), "status": F.coalesce("__said.s", "status")})
    else:
        out = out.withColumn("__answered", F.lit(False))
    if faces is not None:
        found = faces.select(F.col("job_id").alias("__job"), F.lit(True).alias("__faces")).distinct()
        out = out.withColumn("__job", F.coalesce(m["local_job_id"], m["job_id"])).join(found, "__job", "left").drop("__job")
        stuck = (F.col("status") == "processing") & ~F.col("__answered")
        out = out.withColumn("status", F.when(~stuck, F.col("status")).when(F.col("__faces"), "ready").otherwise("failed"))
    fields = [F.col("status").alias(f) if f == "status" else m[f].alias(f) for f in artifacts.schema["metadata"].dataType.names]
    names = [c for c in artifacts.columns if c not in ("metadata", "error")]
    return out.select(F.struct(*fields).alias("metadata"), *names, "error")


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("artifact_id"), F.lit(buckets)).cast("int").alias("bucket")


def upsert_artifacts(batch: DataFrame, batch_id: int, sink: str, buckets: int = 64) -> None:
    """Fold a batch of artifacts into the versions under ``sink``; a batch that comes again replaces itself.

    ``versions/batch_id=N`` holds the rows of batch N, in folders by a bucket of the artifact's id: one row per
    artifact, that with the newest ``updated_at`` of its batch, done ones before open ones of the same time.
    ``current/batch_id=N`` points to them. Readers take the newest pointer of each artifact and that one version.
    A batch writes its own two folders only, so running it twice, or anew after a failure between both writes, gives
    the same files, and a version that comes late does not become current.
    """
    spark = batch.sparkSession
    key = F.coalesce(F.col("metadata.artifact_id"), F.concat(F.lit("job:"), F.col("metadata.job_id")))
    # a done artifact beats an open one of the same time, and a full row order makes ties the same in every run
    rank = F.struct(F.coalesce("metadata.updated_at", "metadata.created_at", F.lit("")).alias("at"), F.col("metadata.status").isin("ready", "failed").alias("done"), F.xxhash64(F.to_json(F.struct(*batch.columns))).alias("tie"))
    rows = batch.withColumn("artifact_id", key).where("artifact_id IS NOT NULL")
    newest = rows.groupBy("artifact_id").agg(F.max_by(F.struct(*batch.columns, rank.alias("__rank")), rank).alias("r"))
    newest = newest.select("artifact_id", _bucket(buckets), "r.*")
    newest = newest.select("artifact_id", "bucket", F.col("__rank.at").alias("at"), F.col("__rank.done").alias("done"), *batch.columns)
    newest.write.mode("overwrite").partitionBy("bucket").parquet(f"{sink}/{VERSIONS}/batch_id={batch_id}")
    written = spark.read.parquet(f"{sink}/{VERSIONS}/batch_id={batch_id}")
    written.select("artifact_id", "at", "done", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{sink}/{CURRENT}/batch_id={batch_id}")


def _pointers(spark: SparkSession, sink: str) -> DataFrame:
    return spark.read.schema("artifact_id string, at string, done boolean, batch_id long, bucket int").parquet(f"{sink}/{CURRENT}")


def ingest_artifacts(spark: SparkSession, glob: str, schema: StructType, sink: str, checkpoint: str, once: bool = True,
                     tasks: DataFrame | None = None, faces: DataFrame | None = None, buckets: int = 64):
    """Stream artifact documents into versions with a current one each (see ``folded_artifacts``, ``upsert_artifacts``).

    ``tasks`` and ``faces`` are read anew for every batch. A batch that is run again changes nothing.
    """
    src = spark.readStream.schema(schema).option("multiLine", True).json(glob)

    def save(batch: DataFrame, batch_id: int) -> None:
        upsert_artifacts(folded_artifacts(batch, tasks, faces), batch_id, sink, buckets)

    w = src.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()


def repair_artifacts(spark: SparkSession, sink: str, tasks: DataFrame | None = None, faces: DataFrame | None = None, buckets: int = 64) -> int:
    """Fold what the service says now into the current artifacts that are not done; how many changed.

    The changed rows are a batch of their own, numbered behind those of streams, with ``updated_at`` as it was: running it again
    finds nothing to change.
    """
    open_ = current_artifacts(spark, sink).where(~F.col("metadata.status").isin("ready", "failed"))
    names = [c for c in open_.columns if c not in ("artifact_id", "batch_id")]
    was = F.col("metadata.status")
    after = folded_artifacts(open_.select(*names), tasks, faces)
    before = open_.select(F.col("metadata.artifact_id").alias("__id"), F.col("metadata.job_id").alias("__job"), was.alias("__was")).distinct()
    same = F.col("__id").eqNullSafe(F.col("metadata.artifact_id")) & F.col("__job").eqNullSafe(F.col("metadata.job_id")) & (F.col("__was") == F.col("metadata.status"))
    changed = after.join(before, same, "left_anti").persist()
    try:
        n = changed.count()
        if n:
            last = _pointers(spark, sink).agg(F.max("batch_id")).first()[0]
            upsert_artifacts(changed, last + 1 if last >= REPAIRS else REPAIRS, sink, buckets)
        return n
    finally:
        changed.unpersist()


def current_artifacts(spark: SparkSession, sink: str) -> DataFrame:
    """The current version of every artifact: the newest pointer's. With ``artifact_id`` and ``batch_id``."""
    newest = _pointers(spark, sink).groupBy("bucket", "artifact_id").agg(F.max_by("batch_id", F.struct("at", "done", "batch_id")).alias("batch_id"))
    rows = spark.read.parquet(f"{sink}/{VERSIONS}")
    return rows.join(newest, ["bucket", "artifact_id", "batch_id"]).drop("bucket", "at", "done")
