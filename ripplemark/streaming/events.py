"""Review events: routing, one live review for each key, retraction, redelivery, incremental scans with a kept result.

Each operator is a function of a DataFrame that serves batch and stream; upserts of a stream go through foreachBatch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import IntegerType, StructField, StructType

from ..functions import patterns

# The actions that start a review.
ACTIONABLE = ("opened", "synchronize", "reopened", "ready_for_review")


def route(event: Column, action: Column) -> Column:
    return F.when(event == "ping", "ping").when(event != "pull_request", "unhandled").when(action.isin(*ACTIONABLE), "actionable").otherwise("ignored")


def routed(events: DataFrame) -> DataFrame:
    """events (event, action, …) with route."""
    return events.withColumn("route", route(F.col("event"), F.col("action")))


def latest(reviews: DataFrame) -> DataFrame:
    """The newest review for each key (ts, then delivery_id)."""
    newest = F.max(F.struct("ts", "delivery_id", *[c for c in reviews.columns if c not in ("ts", "delivery_id", "key")])).alias("r")
    return reviews.groupBy("key").agg(newest).select("key", "r.*")


def live(reviews: DataFrame) -> DataFrame:
    """latest() of runs that didn't fail, less those whose latest has nothing to report."""
    return latest(reviews.where("not failed")).where("not nothing_to_report")


def retracted(reviews: DataFrame) -> DataFrame:
    """Keys that once had something to report and whose latest run that didn't fail has nothing."""
    ran = reviews.where("not failed")
    had = ran.where("not nothing_to_report").select("key").distinct()
    return latest(ran).where("nothing_to_report").join(had, "key", "left_semi")


def deduped(deliveries: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each delivery once: in a stream within the watermark, else over all rows."""
    if deliveries.isStreaming:
        return deliveries.withWatermark("ts", late).dropDuplicatesWithinWatermark(["delivery_id"])
    return deliveries.dropDuplicates(["delivery_id"])


Merge = Callable[[DataFrame], DataFrame]


def keep_state(rows: DataFrame, keys: list[str], merge: Merge, table: str, checkpoint: str, buckets: int = 64, trigger: dict | None = None, changes: Callable[[DataFrame, DataFrame], DataFrame] | None = None, feed: str | None = None) -> StreamingQuery:
    """Keep merge() of all rows of a stream in a table at a path, which live_state() reads.

    merge: rows to one row for each of keys, with the rows' columns, and such that merging what has been merged with more
    rows is merging all. Keys are dealt to buckets by hash. A batch merges and rewrites only the buckets that its keys fall
    into, as version=<batch>/bucket=<bucket>. A batch that runs again reads what was there before it and writes its own
    version again, so it changes nothing; versions that an earlier batch has replaced are deleted. table, checkpoint,
    buckets and feed belong together. trigger: as of writeStream.trigger, by default all that is there, then the end.

    changes(old, new), of the touched buckets' rows before and after a batch, are written as batch=<batch> of the feed, in
    place of what a broken run of that batch has left there.
    """

    def step(batch: DataFrame, number: int) -> None:
        new = merge(batch).withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
        old = new.limit(0)
        if number:
            touched = [r.bucket for r in new.select("bucket").distinct().collect()]
            schema = StructType([*new.schema.fields, StructField("version", IntegerType())])
            old = live_state(batch.sparkSession, table, schema, number).where(F.col("bucket").isin(touched)).select(*new.columns)
            new = merge(old.unionByName(new).drop("bucket")).withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
        new.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{table}/version={number}")
        if changes is not None:
            made = batch.sparkSession.read.schema(new.schema).parquet(f"{table}/version={number}")
            changes(old, made).write.mode("overwrite").parquet(f"{feed}/batch={number}")
        _retire(batch.sparkSession, table, number)

    return rows.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def maintain_live(reviews: DataFrame, table: str, checkpoint: str, buckets: int = 64, trigger: dict | None = None) -> StreamingQuery:
    """Keep latest() of a stream's reviews that didn't fail in a table, as keep_state() does."""
    return keep_state(reviews.where("not failed"), ["key"], latest, table, checkpoint, buckets, trigger)


def latest_with_history(reviews: DataFrame) -> DataFrame:
    """latest() with reported: whether any run of the key had something to report."""
    told = reviews if "reported" in reviews.columns else reviews.withColumn("reported", ~F.col("nothing_to_report"))
    newest = F.max(F.struct("ts", "delivery_id", *[c for c in reviews.columns if c not in ("ts", "delivery_id", "key", "reported")])).alias("r")
    return told.groupBy("key").agg(newest, F.bool_or("reported").alias("reported")).select("key", "r.*", "reported")


def review_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """What readers of live reviews have to do from one state of latest_with_history() to the next: op and the new state's
    row, only of keys for which that differs. upsert: the latest run has something to report and is another one; retract: it
    has nothing, but some run had, which wasn't so before."""
    gone = lambda side: F.col(f"{side}.nothing_to_report") & F.col(f"{side}.reported")
    both = new.alias("new").join(old.alias("old"), F.col("new.key") == F.col("old.key"), "left")
    another = F.col("old.key").isNull() | (F.col("old.delivery_id") != F.col("new.delivery_id")) | (F.col("old.ts") != F.col("new.ts")) | F.col("old.nothing_to_report")
    op = F.when(~F.col("new.nothing_to_report") & another, "upsert").when(gone("new") & ~F.coalesce(gone("old"), F.lit(False)), "retract")
    return both.select(op.alias("op"), *[F.col(f"new.{c}").alias(c) for c in new.columns if c not in ("reported", "bucket")]).where("op is not null")


def maintain_feed(reviews: DataFrame, table: str, feed: str, checkpoint: str, buckets: int = 64, trigger: dict | None = None) -> StreamingQuery:
    """Keep the state of a stream's reviews that didn't fail, and a feed of upserts and retractions with a folder for each
    batch number, written once however often a batch runs. Late and repeated deliveries change nothing that they needn't."""
    return keep_state(reviews.where("not failed"), ["key"], latest_with_history, table, checkpoint, buckets, trigger, review_changes, feed)


def feed_state(spark: SparkSession, feed: str) -> DataFrame:
    """The feed summed up: each key's last row, with batch. op tells what is live (upsert) and what was taken back (retract)."""
    rows = spark.read.parquet(feed)
    last = F.max_by(F.struct(*[c for c in rows.columns if c != "key"]), "batch").alias("r")
    return rows.groupBy("key").agg(last).select("key", "r.*")


def live_state(spark: SparkSession, table: str, schema: StructType | None = None, before: int | None = None) -> DataFrame:
    """The newest version of every bucket of a table that maintain_live keeps, of those before a version if one is given;
    with schema (bucket and version included) also where the table holds no row yet."""
    rows = (spark.read.schema(schema) if schema else spark.read).parquet(table)
    if before is not None:
        rows = rows.where(F.col("version") < before)
    newest = rows.groupBy("bucket").agg(F.max("version").alias("version"))
    return rows.join(F.broadcast(newest), ["bucket", "version"], "left_semi")


def _retire(spark: SparkSession, table: str, number: int) -> None:
    """Delete versions of buckets that another one before number has replaced. Batch number may run again, those before
    it can't."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    store = path(table).getFileSystem(spark._jsc.hadoopConfiguration())
    found = [str(s.getPath()).rsplit("/", 2) for s in store.globStatus(path(f"{table}/version=*/bucket=*")) or []]
    held = [(int(version.split("=")[1]), bucket, f"{base}/{version}/{bucket}") for base, version, bucket in found]
    newest = {}
    for version, bucket, _ in held:
        if version < number:
            newest[bucket] = max(version, newest.get(bucket, 0))
    for version, bucket, at in held:
        if version < newest.get(bucket, 0):
            store.delete(path(at), True)
    for s in store.globStatus(path(f"{table}/version=*")) or []:
        version = int(s.getPath().getName().split("=")[1])
        if version < number and version not in newest.values():
            store.delete(s.getPath(), True)


def scanned(lines: DataFrame) -> DataFrame:
    """(pr if there is one, path, line_no, kind, preview) of appended lines that expose a secret: stateless, so old lines
    never fire again."""
    keys = [c for c in ("pr", "path", "line_no") if c in lines.columns]
    return lines.select(*keys, patterns.secret(F.col("text"), F.col("path")).alias("s")).where("s is not null").select(*keys, "s.kind", "s.preview")


FINDING = ["pr", "path", "kind"]


def first_of_kind(found: DataFrame) -> DataFrame:
    """(pr, path, kind, line_no, preview): the first line of each kind in a file of a change set. Of repeated line numbers
    the least preview."""
    return found.groupBy(*FINDING).agg(F.min(F.struct("line_no", "preview")).alias("f")).select(*FINDING, "f.line_no", "f.preview")


def maintain_findings(lines: DataFrame, table: str, checkpoint: str, buckets: int = 64, trigger: dict | None = None) -> StreamingQuery:
    """Keep the first finding of each kind in a file of a change set over all lines (pr, path, line_no, text) of a stream, in
    a table that live_state() reads. Lines may come late, twice, or in a batch that runs again."""
    return keep_state(scanned(lines), FINDING, first_of_kind, table, checkpoint, buckets, trigger)
