"""Sinks and drains for Structured Streaming jobs."""

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskfabric.operators.store import latest_per_key
from riskfabric.session import checkpoint_dir

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder under the shared checkpoint folder of the session."""
    return f"{checkpoint_dir(spark)}/streams/{name}-{uuid.uuid4().hex}"


def write_batches(stream: DataFrame, folder: str, mode="append", prepare=None, **trigger):
    """Start a query that writes every micro-batch to its own partition.

    A batch that is repeated after a failure overwrites its own partition only, so each input is applied exactly once.
    """
    def write(batch, batch_id):
        rows = prepare(batch) if prepare else batch
        rows.write.mode("overwrite").parquet(f"{folder}/data/batch={batch_id}")

    return (stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").foreachBatch(write).trigger(**(trigger or {"availableNow": True})).start())


def drain(stream: DataFrame, name: str, mode="append", prepare=None) -> DataFrame:
    """Process everything that is available and return what was written, with its ``batch`` number."""
    spark = stream.sparkSession
    folder = work_folder(spark, name)
    write_batches(stream, folder, mode, prepare).awaitTermination()
    return spark.read.parquet(f"{folder}/data")


def drain_stateful(stream: DataFrame, name: str, mode="append") -> DataFrame:
    """Drain a query with arbitrary state, which needs the RocksDB state store."""
    spark, key = stream.sparkSession, "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, ROCKSDB)
    try:
        return drain(stream, name, mode)
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)


def last_batch(written: DataFrame) -> DataFrame:
    """Complete-mode result: the rows of the newest batch."""
    newest = written.agg(F.max("batch").alias("__newest"))
    return written.join(F.broadcast(newest), F.col("batch") == F.col("__newest")).drop("batch", "__newest")  # one-row aggregate


def upserted(written: DataFrame, keys, order) -> DataFrame:
    """Current table behind an upsert stream: the newest row of each key."""
    return latest_per_key(written, list(keys), [*order, "batch"]).drop("batch")


def _run(folder: str, level: int, number: int) -> str:
    return f"{folder}/level={level}/run={number}"


def covering_runs(end: int, fan: int) -> list[tuple[int, int]]:
    """(level, number) of the runs that hold batches 0 to ``end`` - 1; run ``n`` of level ``l`` holds ``fan**l`` batches from ``n * fan**l`` on."""
    runs, start, level = [], 0, 0
    while fan ** (level + 1) <= end:
        level += 1
    while start < end:
        size = fan ** level
        while start + size <= end:
            runs.append((level, start // size))
            start += size
        level -= 1
    return runs


def write_upserts(stream: DataFrame, folder: str, keys, order, fan=8, files=16, **trigger):
    """Start a query that keeps the newest row of each key in runs of growing size.

    Every batch is reduced to one row per key and becomes a run of level 0; whenever ``fan`` runs of a level are complete they are merged into one run of the next level, dealt
    by key to at most ``files`` files. A one-row marker, written last and in turn to two places, tells readers how many batches count. A batch that died before it
    shows nothing: readers go on with the marker and the runs of the batch before, and the repeated batch overwrites its own runs only.
    """
    keys, order = list(keys), list(order)

    def write(batch, batch_id):
        spark, end = batch.sparkSession, batch_id + 1
        latest_per_key(batch, keys, order).withColumn("batch", F.lit(batch_id).cast("long")).write.mode("overwrite").parquet(_run(folder, 0, batch_id))
        level = 1
        while end % fan ** level == 0:
            number = end // fan ** level - 1
            parts = spark.read.schema(_stored(batch)).parquet(*[_run(folder, level - 1, number * fan + i) for i in range(fan)])
            latest_per_key(parts, keys, [*order, "batch"]).repartition(files, *keys).write.mode("overwrite").parquet(_run(folder, level, number))
            level += 1
        spark.range(1, numPartitions=1).select(F.lit(end).cast("long").alias("end"), F.lit(fan).alias("fan")).write.mode("overwrite").parquet(f"{folder}/end/slot={batch_id % 2}")

    return stream.writeStream.option("checkpointLocation", f"{folder}/checkpoint").foreachBatch(write).trigger(**(trigger or {"availableNow": True})).start()


def _stored(batch: DataFrame):
    return batch.withColumn("batch", F.lit(0).cast("long")).schema


def stored_batches(spark: SparkSession, folder: str) -> tuple[int, int]:
    """Number of batches that count and the fan of the store; no batches before the first. A marker that is being replaced is passed over: the other one holds."""
    found = [(0, 2)]
    for slot in (0, 1):
        try:
            found += [(r["end"], r["fan"]) for r in spark.read.schema("end long, fan int").parquet(f"{folder}/end/slot={slot}").collect()]  # one row
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
    return max(found)


def read_upserts(spark: SparkSession, folder: str, keys, order) -> DataFrame | None:
    """Current table behind ``write_upserts``, None before the first batch. Fewer than ``fan`` runs of each level are read, whatever the number of batches."""
    end, fan = stored_batches(spark, folder)
    if not end:
        return None
    rows = spark.read.parquet(*[_run(folder, level, number) for level, number in covering_runs(end, fan)])
    return upserted(rows, keys, order)
