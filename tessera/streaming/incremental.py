"""Resumable processing: skip what is done, ledgers, latest state of append-only logs, streams that stop when caught up."""

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.windows import last_row


def pending(source: DataFrame, done: Sequence[DataFrame], key: str) -> DataFrame:
    """Rows whose key is in none of the tables of finished work (outputs count as well as the ledger)."""
    for d in done:
        source = source.join(d.select(key).distinct(), key, "left_anti")
    return source


def latest(log: DataFrame, key: Sequence[str], order: Column) -> DataFrame:
    return last_row(log, key, order)


def to_retry(log: DataFrame, key: Sequence[str], order: Column, failed: Column) -> DataFrame:
    """Keys whose latest row is a failure."""
    return latest(log, key, order).where(failed)


def compacted(log: DataFrame, manifest: DataFrame, key: str, order: Column, place: str) -> DataFrame:
    """Latest row of each key in the manifest's order, keys that the manifest lacks at the end."""
    rows = latest(log, [key], order).join(manifest.select(key, place), key, "left")
    return rows.withColumn(place, F.coalesce(place, F.lit(2147483647)))


def no_repeats(ledger: DataFrame, key: Sequence[str]) -> None:
    """Stops if the ledger holds a key twice."""
    found = ledger.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").limit(5).collect()
    if found:
        raise ValueError(f"repeated keys in the ledger: {[tuple(r[k] for k in key) for r in found]}")


def ingest(spark: SparkSession, path: str, schema: str, key: Sequence[str], event_time: str | None, late: str, work: Callable[[DataFrame], DataFrame], out: str, ledger: str, checkpoint: str, form: str = "parquet", files_a_batch: int = 1000) -> None:
    """Reads what is new under path, drops keys seen before, works on each batch, writes rows and a ledger, and stops.

    Batches are written under their number, so a repeated batch replaces its own files.  With an event time, the
    state of seen keys is kept for the time given; without one, for ever.
    """
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch)
    rows = reader.format(form).load(path)
    if event_time:
        rows = rows.withWatermark(event_time, late).dropDuplicatesWithinWatermark(list(key))
    else:
        rows = rows.dropDuplicates(list(key))

    def batch(df: DataFrame, number: int) -> None:
        df.persist()
        work(df).write.mode("overwrite").parquet(f"{out}/batch={number}")
        df.select(*key).withColumn("finished", F.current_timestamp()).write.mode("overwrite").parquet(f"{ledger}/batch={number}")
        df.unpersist()

    query = rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def windowed_counts(stream: DataFrame, time: str, window: str, late: str, *by: str) -> DataFrame:
    """Events and sum of values in tumbling windows, with a watermark; also runs on a batch table."""
    rows = stream.withWatermark(time, late) if stream.isStreaming else stream
    return rows.groupBy(F.window(time, window).alias("w"), *by).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), *by, "n", "total")
