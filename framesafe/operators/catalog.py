"""Jobs, videos and source files: best job, bindings, upserts, recovery, listings."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import clean_str, null_safe_hash, overview_from_metadata
from ..session import checkpoint
from . import asof

# Fixed values.
STATUS_RANK = {"ready": 3, "processing": 2, "failed": 1}
VIDEO_SUFFIX = r"(?i)\.(mp4|mov|mkv|avi|m4v|webm)$"
OUTPUT_PREFIX = r"(?i)^(redacted_|person_|tmp)"


def status_rank(c: Column) -> Column:
    out = F.lit(0)
    for word, rank in STATUS_RANK.items():
        out = F.when(c == word, rank).otherwise(out)
    return out


def best_job(jobs: DataFrame, video: str = "video_id", job: str = "job_id", created: str = "created_at",
             run_time: str | None = None, status: str = "status") -> DataFrame:
    """One job per video: latest creation (else run time), then best status, then largest id.

    A maximum over an ordered struct: combined on the map side, so a video with very many jobs is no
    hot task.
    """
    when = F.col(created) if run_time is None else F.coalesce(F.col(created), F.col(run_time))
    rest = [c for c in jobs.columns if c not in (video, job)]
    order = F.struct(when.alias("w"), status_rank(F.col(status)).alias("s"), F.col(job), *rest)
    top = jobs.where(F.col(video).isNotNull()).groupBy(video).agg(F.max(order).alias("m"))
    return top.select(video, F.col(f"m.{job}").alias(job), *(F.col(f"m.{c}").alias(c) for c in rest))


def dedupe_bindings(jobs: DataFrame, video: str = "video_id", job: str = "job_id", run_time: str = "run_time") -> DataFrame:
    """Only the newest run of a video keeps its binding; the others get null and ``cleared`` true."""
    bound = F.nullif(F.trim(F.col(video).cast("string")), F.lit(""))
    newest = jobs.where(bound.isNotNull()).groupBy(video).agg(
        F.max(F.struct(F.coalesce(run_time, F.lit(0).cast(dict(jobs.dtypes)[run_time])).alias("t"), F.col(job)))[job].alias("__keep")
    )
    j = jobs.join(newest, video, "left")
    lost = bound.isNotNull() & (F.col(job) != F.col("__keep"))
    return j.withColumns({"cleared": F.coalesce(lost, F.lit(False)), "__v": F.when(~F.coalesce(lost, F.lit(False)), F.col(video))}).drop(video, "__keep").withColumnRenamed("__v", video)


def upsert_manifests(old: DataFrame, new: DataFrame, overrides: DataFrame | None = None, key: str = "job_id",
                     defaults: dict[str, object] | None = None) -> DataFrame:
    """Supplied (non-null) new values win, stored values stay, overrides go on top, defaults fill gaps."""
    out = old
    for layer in [new, overrides]:
        if layer is None:
            continue
        names = [c for c in dict.fromkeys([*out.columns, *layer.columns]) if c != key]
        a = out.select(key, *(F.col(c).alias(f"__o_{c}") for c in out.columns if c != key))
        b = layer.select(key, *(F.col(c).alias(f"__n_{c}") for c in layer.columns if c != key))
        j = a.join(b, key, "full_outer")
        pick = lambda c: F.coalesce(*(F.col(f"{p}{c}") for p in ("__n_", "__o_") if f"{p}{c}" in j.columns)).alias(c)  # noqa: E731, B023
        out = j.select(key, *(pick(c) for c in names))
    for c, v in (defaults or {"status": "ready"}).items():
        if c in out.columns:
            out = out.withColumn(c, F.coalesce(c, F.lit(v)))
    return out


def repair_status(jobs: DataFrame, faces: DataFrame, job: str = "job_id") -> DataFrame:
    """Jobs stuck in processing are ready when they have faces and failed otherwise."""
    have = faces.select(job).distinct().withColumn("__has", F.lit(True))
    stuck = F.when(F.col("__has"), "ready").otherwise("failed")
    j = jobs.join(have, job, "left")
    return j.withColumn("status", F.when(F.col("status") == "processing", stuck).otherwise(F.coalesce("status", F.lit("ready")))).drop("__has")


def videos_with_jobs(videos: DataFrame, jobs: DataFrame, about: str = "about", topics: str = "topics",
                     categories: str = "categories") -> DataFrame:
    """Videos under the file name of their best job, with the overview from the metadata map."""
    top = best_job(jobs).select("video_id", "job_id", F.nullif("video_filename", F.lit("")).alias("__name"))
    j = videos.join(top, "video_id", "left").withColumn("filename", F.coalesce("__name", "filename")).drop("__name")
    if "user_metadata" in videos.columns:
        j = j.withColumn("overview", overview_from_metadata(F.col("user_metadata"), about, topics, categories))
    return j


def recover_jobs(videos: DataFrame, jobs: DataFrame) -> DataFrame:
    """A job for each video: the first (by id) already bound to it or unbound with the same file name.

    Jobs bound to another video are never taken.
    """
    bound = F.nullif(F.trim(F.col("video_id").cast("string")), F.lit(""))
    j = jobs.select("job_id", bound.alias("__bound"), F.lower(clean_str("video_filename")).alias("__name"))
    v = videos.select("video_id", F.lower(clean_str("filename")).alias("__name"))
    a = v.join(j.where(F.col("__bound").isNotNull()).select("job_id", "__bound"), F.col("video_id").cast("string") == F.col("__bound"))
    a = a.select("video_id", "job_id", F.lit("bound").alias("how"))
    free = j.where(F.col("__bound").isNull() & (F.col("__name") != ""))
    b = v.where(F.col("__name") != "").join(free.select("job_id", "__name"), "__name").select("video_id", "job_id", F.lit("filename").alias("how"))
    return a.unionByName(b).groupBy("video_id").agg(F.min(F.struct("job_id", "how")).alias("m")).select("video_id", "m.job_id", "m.how")


def list_source_videos(files: DataFrame, name: str = "name") -> DataFrame:
    """Source videos among the files: a video suffix and no output prefix, by name."""
    return files.where(F.col(name).rlike(VIDEO_SUFFIX) & ~F.col(name).rlike(OUTPUT_PREFIX)).orderBy(name)


def list_orphans(files: DataFrame, name: str = "name") -> DataFrame:
    return files.where(F.col(name).rlike(VIDEO_SUFFIX) & F.lower(name).startswith("tmp"))


# Name bonuses when guessing the file of a job and of a video.
JOB_BONUS = {"input_": 45.0}
VIDEO_BONUS = {"index_": 60.0, "upload_": 45.0, "input_": 30.0}
EXACT_NAME_BONUS = 240.0
SIZE_COST, DURATION_COST = 1.5, 30.0
# Cells of files without a size or duration, and of targets that take files of any.
UNKNOWN, ANY = -(1 << 62), -(1 << 62) - 1


def infer_source(targets: DataFrame, files: DataFrame, key: str = "job_id", variant: str = "job", bucket: float = 3600.0) -> DataFrame:
    """The most likely source file of each job or video.

    Score = |time difference| − name bonus + 1.5·size difference + 30·duration difference; lowest wins, the
    smaller path on ties. The file nearest in time, also among those of equal size or of the same second of duration,
    gives a bound. A file that beats it lies within bound + its own bonus of the target in time, size and duration;
    such files are found through cells of all three, as wide as that distance, one search for each bonus.
    ``targets``: key, ``time``, ``width``, ``height``, ``duration`` and for videos ``filename``; ``files``: ``path``,
    ``name``, ``mtime``, ``width``, ``height``, ``duration``. Targets without a time get no file.
    """
    bonus_of = JOB_BONUS if variant == "job" else VIDEO_BONUS
    name = F.lower("name")
    bonus = F.lit(0.0)
    for prefix, v in reversed(list(bonus_of.items())):
        bonus = F.when(name.startswith(prefix), v).otherwise(bonus)
    f = files.select("path", name.alias("__name"), F.col("mtime").cast("double").alias("t"),
                     F.col("width").alias("__w"), F.col("height").alias("__h"), F.col("duration").alias("__d"), bonus.alias("__b"))
    alike = ["t", "__w", "__h", "__d", "__b", *(["__name"] if variant == "video" else [])]
    f = f.groupBy(*alike).agg(F.min(F.struct("path")).alias("__p")).select(*alike, F.col("__p.path").alias("path"))  # files that score alike
    t = targets.where(F.col("time").isNotNull()).withColumn("t", F.col("time").cast("double"))
    t = t.select(key, "t", "width", "height", "duration", *([F.lower(clean_str("filename")).alias("__want")] if variant == "video" else []))
    known = lambda c: F.coalesce(c != 0, F.lit(False))
    diff = lambda a, b, k: F.when(known(a) & known(b), F.abs(a - b) * k).otherwise(0.0)

    def score(get, time: Column) -> Column:
        s = F.abs(get("t") - time) - get("__b")
        s = s + diff(get("__w"), F.col("width"), SIZE_COST) + diff(get("__h"), F.col("height"), SIZE_COST) + diff(get("__d"), F.col("duration"), DURATION_COST)
        if variant == "video":
            s = s - F.when((F.col("__want") != "") & (get("__name") == F.col("__want")), EXACT_NAME_BONUS).otherwise(0.0)
        return s

    # upper bounds on the best score; time chunks keep the lookups spread over tasks
    near = lambda c: F.col(f"near.{c}")
    size, second = {"__kw": ("width", "__w"), "__kh": ("height", "__h")}, {"__kd": ("duration", "__d")}
    found = []
    for same in ({}, size, second, size | second):
        of = lambda c: F.floor(c).cast("long") if c == "duration" or c == "__d" else F.col(c).cast("double")
        probes = t.withColumns({"__all": F.lit(1)} | {k: of(x) for k, (x, _) in same.items()})
        builds = f.withColumns({"__all": F.lit(1)} | {k: of(x) for k, (_, x) in same.items()})
        found.append(asof.nearest(probes, builds, ["__all", *same], "t", "path", chunk=bucket).select(key, score(near, F.col("t")).alias("__u")))
    best = functools.reduce(DataFrame.unionByName, found).groupBy(key).agg(F.min("__u").alias("__u"))
    best = checkpoint(t.join(best, key).where("__u IS NOT NULL"))

    # cells: the search (a bonus or an exact name), its width, and the cells of time, size and duration
    searches = [best.withColumns({"__of": F.lit(f"{b:g}"), "__r": F.col("__u") + b}) for b in sorted({0.0, *bonus_of.values()})]
    fk = f.withColumn("__of", F.format_string("%.0f", "__b"))
    if variant == "video":
        searches.append(best.where("__want <> ''").withColumns({"__of": F.concat(F.lit("name "), "__want"), "__r": F.col("__u") + max(bonus_of.values()) + EXACT_NAME_BONUS}))
        fk = fk.unionByName(f.where("__name <> ''").withColumn("__of", F.concat(F.lit("name "), "__name")))
    slack, unknown, any_ = F.lit(1e-5), F.lit(UNKNOWN), F.lit(ANY)  # slack: rounding of the sums
    wide = functools.reduce(DataFrame.unionByName, searches).withColumn("__r", F.col("__r") + slack).where("__r >= 0")
    wide = wide.withColumn("__wide", F.pow(F.lit(4.0), F.ceil(F.log(F.greatest("__r", F.lit(1.0))) / F.log(F.lit(4.0)))))
    wide = wide.withColumns({"__sized": known(F.col("width")) & known(F.col("height")), "__timed": known(F.col("duration"))})
    cell = lambda c, cost: F.floor(c / F.col("__wide") * cost).cast("long")
    around = lambda c, cost: F.sequence(cell(c - F.col("__r") / cost, cost), cell(c + F.col("__r") / cost, cost))
    sizes = F.flatten(F.transform(around(F.col("width"), SIZE_COST), lambda w: F.transform(around(F.col("height"), SIZE_COST), lambda h: F.xxhash64(w, h))))
    wide = wide.withColumns({  # a target without a size looks at every size, and a file without one is looked at by all
        "__ct": around(F.col("t"), 1.0), "__cs": F.when(F.col("__sized"), F.concat(sizes, F.array(unknown))).otherwise(F.array(any_)),
        "__cd": F.when(F.col("__timed"), F.concat(around(F.col("duration"), DURATION_COST), F.array(unknown))).otherwise(F.array(any_)),
    })
    asked = wide.select("__of", "__wide", "__sized", "__timed").distinct()  # a few rows for each search
    for c in ("__ct", "__cs", "__cd"):
        wide = wide.withColumn(c, F.explode(c))
    place = F.xxhash64("__of", "__wide", "__ct", "__cs", "__cd").alias("__cell")
    fk = fk.withColumnRenamed("t", "__t").join(asked, "__of")
    own_size = F.when(known(F.col("__w")) & known(F.col("__h")), F.xxhash64(cell(F.col("__w"), SIZE_COST), cell(F.col("__h"), SIZE_COST))).otherwise(unknown)
    own_time = F.when(known(F.col("__d")), cell(F.col("__d"), DURATION_COST)).otherwise(unknown)
    fk = fk.withColumns({"__ct": cell(F.col("__t"), 1.0), "__cs": F.when(F.col("__sized"), own_size).otherwise(any_), "__cd": F.when(F.col("__timed"), own_time).otherwise(any_)})
    fk = fk.select("path", "__name", "__t", "__w", "__h", "__d", "__b", place) if variant == "video" else fk.select("path", "__t", "__w", "__h", "__d", "__b", place)
    get = lambda c: F.col("__t") if c == "t" else F.col(c)
    j = wide.select(*best.columns, place).join(fk, "__cell").withColumn("__score", score(get, F.col("t"))).where(F.col("__score") <= F.col("__u") + slack)
    won = j.groupBy(key).agg(F.min(F.struct(F.col("__score").alias("score"), "path")).alias("m"))
    return won.select(key, "m.path", "m.score")


def filter_status(df: DataFrame, statuses: Sequence[str] | None, col: str = "status") -> DataFrame:
    return df if not statuses else df.where(F.col(col).isin(list(statuses)))


def page(df: DataFrame, n: int, size: int, order: Sequence[Column]) -> DataFrame:
    """Page ``n`` (from 1) of ``size`` rows in a total order."""
    return df.orderBy(*order).offset(max(0, n - 1) * size).limit(size)


def order_library(videos: DataFrame, pinned: Sequence[str], category: str | None = None, by_name: bool = False) -> DataFrame:
    """Pinned ids first in their order, then the rest by name or as listed (``pos``)."""
    v = videos if category in (None, "All") else videos.where(F.col("category") == category)
    rank = F.lit(len(pinned))
    for i, vid in reversed(list(enumerate(pinned))):
        rank = F.when(F.col("video_id") == vid, i).otherwise(rank)
    return v.orderBy(rank, F.lower("title") if by_name else F.col("pos"), "video_id")


def pick_video(videos: DataFrame, preferred: str | None, demo: str | None) -> DataFrame:
    """The one video to open: the preferred, else the demo, else the first listed."""
    vid = F.trim(F.col("video_id").cast("string"))
    rank = F.when(vid == F.lit((preferred or "").strip()), 0).when(vid == F.lit(demo or ""), 1).otherwise(2)
    v = videos.where(vid != "")
    return v.agg(F.min(F.struct(rank.alias("r"), "pos", vid.alias("video_id"))).alias("m")).select("m.video_id")


def library_totals(videos: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Video count and total duration, with subtotals when grouped."""
    g = videos.rollup(*by) if by else videos.groupBy()
    return g.agg(F.count(F.lit(1)).alias("video_count"), F.sum(F.coalesce("duration", F.lit(0))).alias("total_duration"))


def attach_snapshots(rows: DataFrame, snaps: DataFrame, keys: Sequence[str], candidates: Column, prefix: Column | None = None) -> DataFrame:
    """Attach the snapshot of each row: the first candidate name that exists, with or without suffix, else a
    file that starts with ``prefix``.

    ``snaps``: keys, ``filename``, ``snap_base64``. ``candidates`` is an array of names, explicit name first.
    """
    keys = list(keys)
    suffixes = F.array(*(F.lit(s) for s in ("", ".png", ".jpg", ".jpeg")))
    names = F.flatten(F.transform(candidates, lambda c: F.when(c.isNull() | (c == ""), F.array().cast("array<string>")).otherwise(
        F.transform(suffixes, lambda s: F.concat(c, s)))))
    r = rows.withColumn("__row", null_safe_hash(*(c for c in rows.columns if c in keys or not c.startswith("__"))))
    tried = r.select(*keys, "__row", F.posexplode(names).alias("__pos", "filename"))
    hit = tried.join(snaps.select(*keys, "filename"), [*keys, "filename"]).groupBy(*keys, "__row").agg(
        F.min(F.struct(F.lit(0).alias("step"), F.col("__pos"), "filename")).alias("m")
    )
    if prefix is not None:
        want = r.select(*keys, "__row", prefix.alias("__prefix"))
        p = want.join(snaps.select(*keys, "filename"), keys).where(F.col("filename").startswith(F.col("__prefix")))
        late = p.groupBy(*keys, "__row").agg(F.min(F.struct(F.lit(1).alias("step"), F.lit(0).alias("__pos"), "filename")).alias("m"))
        hit = hit.unionByName(late).groupBy(*keys, "__row").agg(F.min("m").alias("m"))
    named = hit.select(*keys, "__row", F.col("m.filename").alias("snap_filename")).join(
        snaps.select(*keys, F.col("filename").alias("snap_filename"), "snap_base64"), [*keys, "snap_filename"]
    )
    base = r.drop("snap_filename", "snap_base64")
    return base.join(named, [*keys, "__row"], "left").drop("__row")
