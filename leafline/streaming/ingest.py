"""Documents as a stream: blocks of arriving files, and cache entries appended once a micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import blocks
from ..sources import log

#: Groups that the rows of a micro-batch are counted in.
GROUPS = 64
DOCUMENTS = "doc_id long, text string, format string"


def block_stream(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """Blocks of the JSON-lines documents that arrive in a folder. Scanning keeps no state, so no watermark is needed."""
    documents = spark.readStream.schema(DOCUMENTS).option("maxFilesPerTrigger", files_per_trigger).json(folder)
    return blocks.scan(documents)


def to_cache(stream: DataFrame, folder: str, checkpoint: str, key: str, value: str):
    """Appends (key, value) to a cache log, a directory a micro-batch: a batch that is run again replaces its directory, so each is there once."""

    def put(batch: DataFrame, number: int) -> None:
        # unique, and rising with the micro-batch: rows are counted in GROUPS groups by key, so that equal keys have an order
        group = F.pmod(F.xxhash64(key), F.lit(GROUPS))
        place = F.row_number().over(Window.partitionBy(group).orderBy(key, value)).cast("long")
        seq = F.lit(number).cast("long") * F.lit(1 << 36) + place * GROUPS + group
        entries = batch.select(F.lit("entry").alias("t"), F.col(key).alias("key"), seq.alias("seq"), F.col(value).alias("value"), F.lit("translated").alias("status"))
        record = F.to_json(F.struct("t", "key", "seq", "value", "status"))
        entries.select(record.alias("value")).write.mode("overwrite").text(f"{folder}/batch={number}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)


def replayed(spark: SparkSession, folder: str) -> DataFrame:
    return log.replay(log.read(spark, f"{folder}/batch=*"))
