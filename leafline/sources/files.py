"""Documents from files, with a byte cap, and routing of HTML that was named Markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a document at most, and bytes looked at for an HTML marker.
CAP, SNIFF = 16 << 20, 4096


def html_marker(text: Column) -> Column:
    """`<!doctype` or `<html` if a text begins so, after a byte order mark, blank lines, small indents and comments."""
    found = F.lower(F.regexp_extract(F.substring(text, 1, SNIFF), r"(?is)^\x{FEFF}?(?:\s*\n)? {0,3}(?:<!--.*?-->(?:\s*\n)? {0,3})*(<!doctype|<html)(?=[>\s]|\z)", 1))
    return F.when(found != "", found)


def read_documents(spark: SparkSession, path: str, cap: int = CAP) -> tuple[DataFrame, DataFrame]:
    """(path, text, format) of the files at path, and (path, reason) of those over the cap or not UTF-8."""
    # the source skips the content of files that its filter on length leaves out
    every = spark.read.format("binaryFile").load(path)
    files = every.where(F.col("length") <= cap)
    text = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string"))
    judged = files.select("path", F.when(text.isNull(), "not_utf8").alias("reason"), text.alias("text"))
    form = F.when(F.col("path").rlike(r"(?i)\.html?$") | html_marker(F.col("text")).isNotNull(), "html").otherwise("markdown")
    return judged.where("reason is null").select("path", "text", form.alias("format")), judged.where("reason is not null").select("path", "reason").unionByName(every.where(F.col("length") > cap).select("path", F.lit("oversize").alias("reason")))


def capped(df: DataFrame, text: str, cap: int) -> tuple[DataFrame, DataFrame]:
    """Rows within the byte cap, and those beyond."""
    fits = F.octet_length(text) <= cap
    return df.where(fits), df.where(~fits)


def write_documents(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Publishes (doc_id, text) as JSON lines; Spark's committer stages files and renames them, and an existing target is refused by default."""
    df.select("doc_id", "text").write.mode(mode).json(path)
