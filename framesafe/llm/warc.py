"""WARC archives of pages: writing through Spark, and reading with boundary-chain verification.

Writing: one response record per page, its block an HTTP response with the html in UTF-8 (null: empty).
Of pages with equal payloads of at least ``min_revisit`` bytes, that with the smallest ``page_id`` is the
response; the others become revisit records without payload that refer to it. Records are rows of Spark's
text writer, so the archives land in any store that Spark writes to.

Reading: Spark's text reader cuts files, in splits, at every ``WARC/1.0`` line; a record, not a file, is
what a task holds. Each cut is a candidate whose header says where its successor must start.

1. Offsets are sums of lengths within a split plus the sums of the splits before it.
2. Within a split, candidates that are followed directly by their successor form runs.
3. Pointer jumping over runs from offset 0 of each file doubles the reach in each round. Only reached
   records stay; a record head inside a payload is never any record's successor and goes.
4. Payloads that such a head had cut are put together again from their pieces.

A page with null ``page_id`` is written without an id and read with a null one; it is never referred to.
Rows that repeat an id and a payload are all responses if theirs is the smallest id. Null urls are left
out; line breaks in urls are percent-encoded. An empty table gives an empty archive. Other columns are not read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_folder, stored

MAGIC = "WARC/1.0\r\n"
END = "\r\n\r\n"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8"


def _records(pages: DataFrame, min_revisit: int) -> DataFrame:
    html = F.coalesce("html", F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    rows = rows.withColumns({"digest": F.sha2(F.col("html").cast("binary"), 256), "bytes": F.octet_length("html")})
    heads = pages.select(F.col("page_id").cast("long").alias("page_id"), html.alias("html")).where(F.octet_length("html") >= min_revisit)
    heads = heads.groupBy(F.sha2(F.col("html").cast("binary"), 256).alias("digest")).agg(F.min("page_id").alias("head"), F.count("*").alias("n"))
    joined = rows.join(stored(heads.where("n > 1 AND head IS NOT NULL").select("digest", "head")), "digest", "left")
    revisit = F.col("head").isNotNull() & ~F.col("head").eqNullSafe(F.col("page_id"))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))
    url = F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    http = F.concat(F.lit(HTTP + "\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit(END))
    block = F.concat(http, F.when(revisit, "").otherwise(F.col("html")))
    head = F.concat_ws(
        "\r\n",
        F.concat(F.lit(MAGIC + "WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), urn("page_id")),
        F.lit("WARC-Date: 1970-01-01T00:00:00Z"),
        F.concat(F.lit("WARC-Target-URI: "), url),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("digest")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), urn("head"))),
        F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest")),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length("block").cast("string")),
    )
    return joined.withColumn("block", block).select(F.concat(head, F.lit(END), F.col("block")).alias("value"))


def write_archives(pages: DataFrame, folder: str, min_revisit: int = 100) -> None:
    """Write ``pages`` as WARC files into a new folder."""
    _records(pages, min_revisit).write.option("lineSep", END).text(folder)


def _cuts(spark: SparkSession, folder: str) -> DataFrame:
    """``file, split, seq, value``: what stands between record heads."""
    read = spark.read.option("lineSep", MAGIC).text(folder)
    place = {"file": F.col("_metadata.file_path"), "split": F.col("_metadata.file_block_start"), "seq": F.monotonically_increasing_id()}
    return read.select("value", *[c.alias(k) for k, c in place.items()])


def _offsets(cuts: DataFrame) -> DataFrame:
    """``cuts`` with ``off``, where the record's head starts; ``length`` is that of the value."""
    step = F.col("length") + len(MAGIC)
    within = F.sum(step).over(Window.partitionBy("file", "split").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    splits = cuts.groupBy("file", "split").agg(F.sum(step).alias("step"))
    before = F.sum("step").over(Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1))
    base = splits.select("file", "split", F.coalesce(before, F.lit(0)).alias("base"))
    placed = cuts.withColumn("within", F.coalesce(within, F.lit(0))).join(base, ["file", "split"])
    return placed.withColumn("off", F.col("base") + F.col("within") - len(MAGIC)).drop("base", "within").where("off >= 0")


def _field(head: Column, name: str) -> Column:
    found = F.regexp_extract(head, rf"(?im)^{name}: *([^\r\n]*)", 1)
    return F.when(found != "", found)


def _page(urn: Column) -> Column:
    return F.regexp_extract(urn, r"<urn:page:(-?\d+)>", 1).try_cast("long")


def _parse(cuts: DataFrame) -> DataFrame:
    """What a candidate's own header says, and the payload's digest where no other head cut it."""
    head = F.substring_index("value", END, 1)
    found = cuts.withColumns({"head": head, "length": F.octet_length("value").cast("long")})
    found = found.withColumns({"head_bytes": F.octet_length("head") + len(END), "block_bytes": _field(F.col("head"), "Content-Length").try_cast("long")})
    rest = F.substr("value", F.length("head") + len(END) + 1)
    http = F.octet_length(F.substring_index(rest, END, 1)) + len(END)
    found = found.withColumn("skip", F.col("head_bytes") + http).withColumn("payload_bytes", F.col("head_bytes") + F.col("block_bytes") - F.col("skip"))
    whole = F.col("length") >= F.col("head_bytes") + F.col("block_bytes")
    payload = F.substr(F.col("value").cast("binary"), (F.col("skip") + 1).cast("int"), F.col("payload_bytes").cast("int"))
    return found.select(
        "file", "split", "seq", "length", "head_bytes", "block_bytes", "skip", "payload_bytes",
        F.when(whole, F.sha2(payload, 256)).alias("digest"),
        F.lower(_field(F.col("head"), "WARC-Type")).alias("type"), _page(_field(F.col("head"), "WARC-Record-ID")).alias("page_id"),
        _field(F.col("head"), "WARC-Target-URI").alias("url"), _page(_field(F.col("head"), "WARC-Refers-To")).alias("refers_to"),
        F.regexp_extract(_field(F.col("head"), "WARC-Payload-Digest"), r"sha256:([0-9a-f]{64})", 1).alias("said"),
    )


def _reached(found: DataFrame) -> DataFrame:
    """The candidates on the chain of records from the start of their file."""
    order = Window.partitionBy("file", "split").orderBy("off")
    next_ = F.col("off") + len(MAGIC) + F.col("head_bytes") + F.col("block_bytes") + len(END)
    named = found.where("block_bytes IS NOT NULL").withColumn("next", next_)
    breaks = F.when(F.lag("next").over(order).eqNullSafe(F.col("off")), 0).otherwise(1)
    runs = named.withColumn("new", breaks).withColumn("run", F.sum("new").over(order)).drop("new")
    runs = stored(runs.withColumn("run", F.struct("split", "run")))
    exits = runs.groupBy("file", "run").agg(F.max("next").alias("next"))
    goal = runs.select("file", F.col("off").alias("next"), F.col("run").alias("to"))
    jump = stored(exits.join(goal, ["file", "next"]).select("file", "run", "to", F.col("next").alias("entry")))
    step, reach = jump.select("file", "run", "to"), runs.where("off = 0").select("file", "run")
    known = reach.count()
    while True:
        ahead = reach.join(step, ["file", "run"]).select("file", F.col("to").alias("run"))
        reach = stored(reach.union(ahead).distinct())
        now = reach.count()
        if now == known:
            break
        known = now
        second = step.select("file", F.col("run").alias("to"), F.col("to").alias("beyond"))
        step = stored(step.join(second, ["file", "to"]).select("file", "run", F.col("beyond").alias("to")))
    entries = reach.join(jump, ["file", "run"]).select("file", F.col("to").alias("run"), "entry")
    entries = entries.union(runs.where("off = 0").select("file", "run", F.lit(0).cast("long").alias("entry")))
    entries = entries.groupBy("file", "run").agg(F.min("entry").alias("entry"))
    return runs.join(entries, ["file", "run"]).where("off >= entry").drop("entry", "run")


def _cut_payloads(spark: SparkSession, folder: str, records: DataFrame, found: DataFrame) -> DataFrame:
    """``file, off, digest`` of payloads that hold record heads, put together from their pieces."""
    broken = records.where("digest IS NULL").select("file", "off", F.col("next").alias("end"), "skip", "payload_bytes")
    starts = records.select("file", "off", F.lit(True).alias("real"))
    order = Window.partitionBy("file").orderBy("off")
    owner = F.last(F.when(F.col("real"), F.col("off")), ignorenulls=True).over(order)
    owned = found.select("file", "off").join(starts, ["file", "off"], "left").withColumn("owner", owner)
    needed = stored(owned.join(broken.select("file", F.col("off").alias("owner"), "skip", "payload_bytes"), ["file", "owner"]))
    again = _offsets(_cuts(spark, folder).withColumn("length", F.octet_length("value").cast("long")))
    parts = needed.join(again.select("file", "off", "value"), ["file", "off"])
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("off", "value"))), lambda x: x["value"]), MAGIC)
    whole = parts.groupBy("file", "owner").agg(text.alias("text"), F.first("skip").alias("skip"), F.first("payload_bytes").alias("n"))
    payload = F.substr(F.col("text").cast("binary"), (F.col("skip") + 1).cast("int"), F.col("n").cast("int"))
    return whole.select("file", F.col("owner").alias("off"), F.sha2(payload, 256).alias("joined"))


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """``page_id, url, record_type, payload_bytes, payload_digest, refers_to, file, off`` of every true record.

    The digest is computed from the payload read; a revisit has the length and digest of its response.
    """
    found = stored(_offsets(_parse(_cuts(spark, folder))))
    records = stored(_reached(found))
    if not records.where("digest IS NULL").isEmpty():
        joined = _cut_payloads(spark, folder, records, found)
        records = stored(records.join(joined, ["file", "off"], "left").withColumn("digest", F.coalesce("digest", "joined")))
    responses = records.where("type = 'response'").select(F.col("page_id").alias("refers_to"), F.col("digest").alias("said"), F.col("payload_bytes").alias("of"))
    out = ["page_id", "url", "type", "payload_bytes", "digest", "refers_to", "file", "off"]
    own = records.where("type IS DISTINCT FROM 'revisit'").select(*out)
    again = records.where("type = 'revisit'").drop("payload_bytes", "digest").join(stored(responses.distinct()), ["refers_to", "said"], "left")
    again = again.select(*[F.col({"payload_bytes": "of", "digest": "said"}.get(c, c)).alias(c) for c in out])
    return own.union(again).withColumnsRenamed({"type": "record_type", "digest": "payload_digest"})


def archive(pages: DataFrame, min_revisit: int = 100) -> DataFrame:
    """Write the archives into a new folder beside the checkpoints and read them back."""
    spark = pages.sparkSession
    folder = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(pages, folder, min_revisit)
    return read_archives(spark, folder)
