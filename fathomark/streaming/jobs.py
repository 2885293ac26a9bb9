"""Ingest with deduplication, running confusion counts, and conflict-checked appends."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import IntegerType, StructField, StructType

from ..functions.hashing import canonical_json
from ..operators.ledger import VOLATILE


def file_stream(spark: SparkSession, path: str, schema, fmt: str = "json", glob: str | None = None, per_trigger: int = 1000) -> DataFrame:
    reader = spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", per_trigger)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path)


def ingest(stream: DataFrame, key: Sequence[str], event_time: str, delay: str, out: str, checkpoint: str) -> StreamingQuery:
    """Append each key once; duplicates within the watermark delay are dropped."""
    once = stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(list(key))
    return (
        once.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )


def running_confusion(stream: DataFrame, by: Sequence[str], out: str, checkpoint: str) -> StreamingQuery:
    """Confusion counts kept as state; each batch writes the rows it changed under its batch number.

    A repeated batch overwrites its own folder, so a restart cannot count twice.
    """
    counts = stream.groupBy(*by, "y_true", "y_pred").agg(F.count(F.lit(1)).alias("n"))

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{out}/part={batch_id}")

    return (
        counts.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)
        .outputMode("update").trigger(availableNow=True).start()
    )


def latest_counts(spark: SparkSession, out: str, by: Sequence[str]) -> DataFrame:
    """Newest count of every cell."""
    df = spark.read.parquet(out)
    return df.groupBy(*by, "y_true", "y_pred").agg(F.max_by("n", "batch").alias("n"))


BUCKET = "key_bucket"


def _stored(spark: SparkSession, path: str, like: DataFrame, buckets: Sequence[int]) -> DataFrame:
    """The stored rows of some buckets; only their folders are read."""
    schema = StructType([*like.schema.fields, StructField(BUCKET, IntegerType())])
    try:
        old = spark.read.schema(schema).parquet(path)
    except AnalysisException as exc:
        if "PATH_NOT_FOUND" not in str(exc):
            raise
        return like.limit(0)
    return old.where(F.col(BUCKET).isin(list(buckets))).select(*like.columns)


def checked_append(
    stream: DataFrame, key: Sequence[str], out: str, rejects: str, checkpoint: str, ignore: Sequence[str] = VOLATILE,
    on_reject: Callable[[int, int], None] | None = None, buckets: int = 256,
) -> StreamingQuery:
    """Append batches that agree with what is stored and with themselves.

    The store is partitioned by a hash of the key into ``buckets`` folders (column ``key_bucket``), and a
    batch reads only the folders its own keys fall into. The number of folders stays as it is for a store's
    life: choose it so that one folder is a fair share of a batch's work.

    A batch with a contradiction outside the volatile columns goes to ``rejects`` whole. Rows already
    stored, and exact repeats inside the batch, are not written again. So a batch that is replayed after it
    was written adds nothing; a replay after a write that never committed finds none of its rows. Keys are
    compared as values, nulls included.
    """
    stable = sorted(c for c in stream.columns if c not in set(key) | set(ignore))
    digest = F.sha2(canonical_json(stable), 256)
    # The key as text: null parts count as values, in the hash and in the joins.
    name = F.to_json(F.struct(*[F.col(c) for c in key]), {"ignoreNullFields": "false"})
    bucket = F.pmod(F.xxhash64(F.col("_k")), F.lit(buckets)).cast("int")

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark, columns = batch.sparkSession, batch.columns
        batch = batch.withColumn("_h", digest).withColumn("_k", name).withColumn(BUCKET, bucket).persist()
        try:
            # At most ``buckets`` numbers.
            touched = [r[0] for r in batch.select(BUCKET).distinct().collect()]
            old = _stored(spark, out, batch.select(*columns), touched).select(name.alias("_k"), digest.alias("_h"))
            old = old.join(batch.select("_k").distinct(), "_k", "left_semi")
            seen = batch.select("_k", "_h").unionByName(old)
            n = seen.groupBy("_k").agg(F.min("_h").alias("a"), F.max("_h").alias("b")).where("a <> b").count()
            if n:
                batch.select(*columns).write.mode("overwrite").parquet(f"{rejects}/part={batch_id}")
                if on_reject:
                    on_reject(batch_id, n)
                return
            fresh = batch.dropDuplicates(["_k"]).join(old.select("_k"), "_k", "left_anti").select(*columns, BUCKET)
            fresh.repartition(BUCKET).write.mode("append").partitionBy(BUCKET).parquet(out)
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
