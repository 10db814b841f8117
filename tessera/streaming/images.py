"""Folders that grow: new image files are packed batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.plans.quantize import Options, quantize

FILES = "path string, modificationTime timestamp, length bigint, content binary"


def pack_folder(spark: SparkSession, source: str, target: str, checkpoint: str, options: Options = Options(), *, pattern: str = "*.png", once: bool = True) -> StreamingQuery:  # noqa: B008
    """Pack each new file of ``source`` into Parquet below ``target``, a folder per batch.

    A batch that is run again after a failure overwrites its own folder, so every file comes out
    once.  All three folders must be shared.  ``once`` stops when all present files are done.
    """
    files = spark.readStream.schema(FILES).format("binaryFile").option("pathGlobFilter", pattern).load(source)

    def write(batch: DataFrame, number: int) -> None:
        quantize(batch.select(F.xxhash64("path").alias("image_id"), "content"), options).write.mode("overwrite").parquet(f"{target}/batch={number}")

    stream = files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (stream.trigger(availableNow=True) if once else stream).start()
