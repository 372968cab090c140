"""Incremental jobs over snapshot files as they land.

Each micro-batch runs the same batch operators. Outputs are named by batch, so a batch replayed after a failure
overwrites what it wrote before.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pricetide.operators import changes, ingest
from pricetide.schemas import SNAPSHOTS
from pricetide.sources import catalog_store
from pricetide.sources.lineage import cut

STATE = "key string, prior_status string, prior_price double, prior_observed double"


def snapshot_stream(spark: SparkSession, path: str, *, files_per_trigger: int = 1000) -> DataFrame:
    return (
        spark.readStream.schema(SNAPSHOTS).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    )


def ingest_stream(
    snapshots: DataFrame, base: str, checkpoint: str, *, clock, first_version: int = 2, slices: int | None = None
) -> StreamingQuery:
    """Merge each micro-batch into the catalog store at ``base`` as its next version.

    The store must hold version ``first_version - 1``. ``clock(batch_id)`` gives the batch's time.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark, version = batch.sparkSession, first_version + batch_id
        if (catalog_store.current_version(spark, base) or 0) >= version:
            return
        current = catalog_store.load(spark, base, version - 1)
        done = ingest.ingest_batch(current, batch, as_of=clock(batch_id), slices=slices)
        catalog_store.publish(done.catalog, base, version, new_observations=done.new_observations)

    return (
        snapshots.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def change_stream(snapshots: DataFrame, out: str, checkpoint: str, *, slices: int | None = None) -> StreamingQuery:
    """Keep only snapshots that change price or status per URL; read them with ``changed``.

    The state, one row per URL, is written once per micro-batch: a crawl touches most URLs anyway. Within a
    batch a hot URL is split by the change-capture operator.
    """

    def emit(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        prior = spark.read.schema(STATE).parquet(f"{out}/state/{batch_id - 1}") if batch_id else spark.createDataFrame([], STATE)
        valid, _ = ingest.validate(batch)
        rows = valid.withColumn("key", F.col("url"))
        followed = cut(changes.follow(rows, prior, slices=slices))
        followed.filter(changes.is_change()).select(
            "url", "seq", "price", "status", F.col("before.price").alias("previous_price"), "run_id"
        ).write.mode("overwrite").parquet(f"{out}/changes/{batch_id}")
        tail = followed.groupBy("key").agg(
            F.max_by(F.struct("status", "price"), "seq").alias("t"),
            F.max_by("price", F.when(F.col("price").isNotNull(), F.col("seq"))).alias("p"),
        )
        state = prior.join(tail, "key", "full").select(
            "key",
            F.when(F.col("t").isNotNull(), F.col("t.status")).otherwise(F.col("prior_status")).alias("prior_status"),
            F.when(F.col("t").isNotNull(), F.col("t.price")).otherwise(F.col("prior_price")).alias("prior_price"),
            F.coalesce("p", "prior_observed").alias("prior_observed"),
        )
        state.write.mode("overwrite").parquet(f"{out}/state/{batch_id}")

    return (
        snapshots.writeStream.foreachBatch(emit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def changed(spark: SparkSession, out: str) -> DataFrame:
    schema = "url string, seq long, price double, status string, previous_price double, run_id string"
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{out}/changes")


def fixed_clock(start: datetime, step):
    return lambda batch_id: start + step * batch_id
