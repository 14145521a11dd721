"""Live summary of draws while they are being written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def summarise(draws: DataFrame, keys: list[str], index: str, value: str) -> DataFrame:
    """Running count, last index, mean, least and largest value; works on streams and tables."""
    return draws.groupBy(*keys).agg(F.count("*").alias("n"), F.max(index).alias("last"), F.avg(value).alias("mean"), F.min(value).alias("least"), F.max(value).alias("most"))


def monitor(spark: SparkSession, path: str, schema, keys: list[str], index: str, value: str, checkpoint: str, sink, once: bool = True):
    """Start the summary over a folder of Parquet files; ``sink(batch, epoch)`` gets the whole summary each time."""
    stream = spark.readStream.schema(schema).parquet(path)
    writer = summarise(stream, keys, index, value).writeStream.outputMode("complete").option("checkpointLocation", checkpoint).foreachBatch(sink)
    return (writer.trigger(availableNow=True) if once else writer).start()


def monitored(spark: SparkSession, source: str, schema, keys: list[str], index: str, value: str, folder: str, files: int = 1000) -> DataFrame:
    """The summary of all files that match ``source`` now, as a stream makes it: ``files`` an epoch, in update mode.

    Each epoch's changed rows are written below ``folder``, with the stream's checkpoint; a later call with the same folder goes
    on where this one ended, and an epoch that is tried again replaces its rows. The result has each key's last row.
    """

    def keep(batch: DataFrame, epoch: int) -> None:
        batch.withColumn("epoch", F.lit(epoch).cast("long")).write.mode("overwrite").parquet(f"{folder}/epochs/epoch={epoch}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source)
    out = summarise(stream, keys, index, value)
    writer = out.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/checkpoint").foreachBatch(keep)
    writer.trigger(availableNow=True).start().awaitTermination()
    names = [c for c in out.columns if c not in keys]
    rows = spark.read.schema(T.StructType([*out.schema.fields, T.StructField("epoch", T.LongType())])).parquet(f"{folder}/epochs/*")
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*names), "epoch").alias("_last"))
    return last.select(*keys, *[F.col(f"_last.{n}").alias(n) for n in names])
