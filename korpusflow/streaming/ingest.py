"""Incremental ingest as a stream of files: resumable, deduplicated across batches, idempotent per batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: Hexadecimal digits of a hash that name its part of the ledger: 4,096 parts.
PART_DIGITS = 3


def new_documents(stream: DataFrame, watermark: str | None = None, event_time: str = "ts") -> DataFrame:
    """Rows whose content comes first. With an event time, state older than the watermark is dropped."""
    hashed = stream.withColumn("content_hash", F.sha2(F.coalesce("text", F.lit("")), 256))
    if watermark is None:
        return hashed.dropDuplicates(["content_hash"])
    return hashed.withWatermark(event_time, watermark).dropDuplicatesWithinWatermark(["content_hash"])


def ledger_of(sink: str) -> str:
    """Where the hashes of a sink's rows are kept: beside it."""
    return sink.rstrip("/") + "-ledger"


def ledger_parts(spark: SparkSession, ledger: str, parts: list[str]) -> DataFrame:
    """content_hash and batch of a ledger's parts that exist; no other part is listed or read."""
    jvm = spark._jvm.org.apache.hadoop.fs
    system = jvm.Path(ledger).getFileSystem(spark._jsc.hadoopConfiguration())
    there = [f"{ledger}/part={p}" for p in parts if system.exists(jvm.Path(f"{ledger}/part={p}"))]
    schema = "content_hash string, part string, batch long"
    return spark.read.schema(schema).option("basePath", ledger).parquet(*there) if there else spark.createDataFrame([], schema)


def first_of_each(batch: DataFrame) -> DataFrame:
    """One row of each content in a batch: the one whose columns come first. Equal rows meet before the shuffle."""
    rest = [c for c in batch.columns if c != "content_hash"]
    kept = batch.groupBy("content_hash").agg(F.min(F.struct(*rest)).alias("__row"))
    return kept.select("content_hash", "__row.*")


def upsert(batch: DataFrame, batch_id: int, sink: str) -> None:
    """Append what the sink does not have; a batch that runs again replaces its own rows. A ledger of hashes, by the first
    digits of the hash, says what is stored: a batch reads the parts that its own hashes fall into, so its work grows with
    the batch, and nothing is kept in memory between batches."""
    spark = batch.sparkSession
    rows = first_of_each(batch).withColumn("part", F.substring("content_hash", 1, PART_DIGITS)).persist()
    parts = [r.part for r in rows.select("part").distinct().collect()]  # 16^PART_DIGITS at most
    ledger = ledger_of(sink)
    stored = ledger_parts(spark, ledger, parts).filter(F.col("batch") != batch_id).select("content_hash")
    rows.join(stored, "content_hash", "left_anti").drop("part").write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")
    written = spark.read.parquet(f"{sink}/batch={batch_id}").select("content_hash", F.substring("content_hash", 1, PART_DIGITS).alias("part"), F.lit(batch_id).alias("batch"))
    written.repartition("part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part", "batch").parquet(ledger)
    rows.unpersist()


def compact(spark: SparkSession, sink: str, before: int) -> None:
    """The ledger's files of batches before a number, which run no more, as one file a part, in a new folder that replaces
    the old one."""
    jvm = spark._jvm.org.apache.hadoop.fs
    ledger, new, old = (ledger_of(sink) + x for x in ("", "-new", "-old"))
    system = jvm.Path(sink).getFileSystem(spark._jsc.hadoopConfiguration())
    rows = spark.read.schema("content_hash string, part string, batch long").parquet(ledger)
    merged = rows.withColumn("batch", F.when(F.col("batch") < before, F.lit(-1).cast("long")).otherwise(F.col("batch")))
    merged.repartition("part").write.mode("overwrite").partitionBy("part", "batch").parquet(new)
    system.rename(jvm.Path(ledger), jvm.Path(old))
    system.rename(jvm.Path(new), jvm.Path(ledger))
    system.delete(jvm.Path(old), True)


def stream_ingest(spark: SparkSession, source: str, schema: str, checkpoint: str, sink: str, max_files: int = 100) -> StreamingQuery:
    """Read what is new under source, once, and stop; a later call goes on where this one ended. Contents that come again,
    in this batch or a later one, are left out by upsert(), without a state that grows."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(source)
    hashed = stream.withColumn("content_hash", F.sha2(F.coalesce("text", F.lit("")), 256))
    write = lambda batch, batch_id: upsert(batch, batch_id, sink)
    return hashed.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def running_counters(outcomes: DataFrame) -> DataFrame:
    """Streaming counters of each run, for update mode."""
    return outcomes.groupBy("run_id").agg(F.count(F.lit(1)).alias("discovered"), *(F.sum((F.col("status") == s).cast("long")).alias(s) for s in ("imported", "duplicate", "failed")))
