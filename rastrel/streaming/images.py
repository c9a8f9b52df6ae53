"""Image files as a stream: decoding is a stateless map, and pixel operators run on each micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..sources import codecs


def read_stream(spark: SparkSession, path: str, channels: int = 0, files_per_trigger: int = 256) -> DataFrame:
    """``images`` as files arrive."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("maxFilesPerTrigger", files_per_trigger).load(path)
    return codecs.decode_files(files, channels)


def each_batch(images: DataFrame, work: Callable[[DataFrame], DataFrame], target: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Applies ``work`` (pixels to any frame) to each micro-batch and writes Parquet; windows over coordinates are allowed there.

    A batch that is run again overwrites its own folder, so results are exact.
    """

    def save(batch: DataFrame, number: int) -> None:
        work(codecs.unpack(batch.drop("path"))).write.mode("overwrite").parquet(f"{target}/batch={number}")

    writer = images.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
