"""The result cache as an append-only log of JSON lines: scan, replay, trim, compact."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.cache import latest, trimmed

SCHEMA = "t string, key string, seq long, value string, status string"
LONGEST_LINE = 8 << 20
VERSION = 1


def parse(lines: DataFrame, longest: int = LONGEST_LINE) -> DataFrame:
    """Records of lines(value); lines that are too long or no JSON of a known tag are skipped (null tag)."""
    record = F.from_json("value", SCHEMA, {"mode": "PERMISSIVE"})
    fits = F.octet_length("value") <= longest
    parsed = lines.select("*", F.when(fits, record).alias("r"))
    known = F.coalesce(F.col("r.t").isin("header", "entry", "evict", "doc_meta", "glossary"), F.lit(False))
    return parsed.select(*lines.columns, F.when(known, F.col("r")).alias("r"))


def replay(lines: DataFrame) -> DataFrame:
    """(key, seq, value, status, bytes): the last record of each key, evicted keys gone."""
    records = parse(lines).where("r.t in ('entry', 'evict')").select("r.*", (F.octet_length("value") + 1).cast("long").alias("bytes"), (F.col("r.t") == "evict").alias("evict"))
    return latest(records, ["key"], "seq").select("key", "seq", "value", "status", "bytes")


def read(spark: SparkSession, path: str) -> DataFrame:
    """A log's lines; a last line without its end was torn by a crash and is no record (its JSON doesn't parse)."""
    return spark.read.text(path)


def skipped(lines: DataFrame) -> DataFrame:
    return parse(lines).where("r is null").agg(F.count(F.lit(1)).alias("skipped"))


def append(entries: DataFrame, path: str) -> None:
    """A record a line, a file a task and batch."""
    record = F.to_json(F.struct(F.coalesce("t", F.lit("entry")).alias("t"), "key", "seq", "value", "status"))
    entries.select(record.alias("value")).write.mode("append").text(path)


def needs_compaction(live: int, dead: int, live_bytes: int, dead_bytes: int, trimmed_now: bool) -> bool:
    return trimmed_now or (dead > 0 and dead >= live) or (dead_bytes > 0 and dead_bytes >= live_bytes)


def compact(spark: SparkSession, path: str, target: str, max_bytes: int | None = None, max_entries: int | None = None) -> DataFrame:
    """Writes the live records, within the budgets, to a new place, and returns them."""
    live = trimmed(replay(read(spark, path)), "seq", "bytes", max_bytes, max_entries)
    append(live.withColumn("t", F.lit("entry")), target)
    return live


def rotate_aside(spark: SparkSession, path: str, suffix: str) -> str:
    """Renames a log that can't be used and gives its new place."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    old, new = hadoop.Path(path), hadoop.Path(f"{path.rstrip('/')}.{suffix}")
    old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).rename(old, new)
    return f"{path.rstrip('/')}.{suffix}"
