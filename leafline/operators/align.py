"""Merging windows, regenerating documents, alignment, reports, and the active block of a scroll position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .blocks import sync_role, translatable

STATUSES = ("translated", "preserved", "fallback_source", "partially_translated", "failed")


def merged_status(status: Column) -> Column:
    """An aggregate: one status of all windows if it is a plain one, else partially_translated."""
    low = F.min(status)
    return F.when((low == F.max(status)) & (low != "partially_translated") & low.isin("translated", "preserved", "fallback_source"), low).otherwise("partially_translated")


def merge_windows(windows: DataFrame) -> DataFrame:
    """(doc_id, unit_id, status, payload) of tables from windows(doc_id, parent, window_index, status, payload): the first window whole, of the others the body."""
    body = lambda p: F.array_join(F.slice(F.split(p, "\n"), 3, F.greatest(F.size(F.split(p, "\n")) - 2, F.lit(0))), "\n")
    parts = F.array_sort(F.collect_list(F.struct("window_index", "payload")))  # the windows of one table
    one = windows.groupBy("doc_id", F.col("parent").alias("unit_id")).agg(merged_status(F.col("status")).alias("status"), parts.alias("parts"))
    text = F.array_join(F.transform("parts", lambda x, i: F.when(i == 0, x.payload).otherwise(body(x.payload))), "\n")
    return one.select("doc_id", "unit_id", "status", text.alias("payload"))


def regenerate(blocks: DataFrame, accepted: DataFrame, documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents with accepted payloads in place of blocks, all else as it was; and each block's place in them.

    blocks(doc_id, ord, block_id, start, end), accepted(doc_id, block_id, payload), documents(doc_id, text).
    Gives (doc_id, text) and (doc_id, block_id, target_start, target_end).
    """
    pieces = blocks.select("doc_id", "ord", "block_id", "start", "end").join(accepted.select("doc_id", "block_id", F.col("payload").alias("new")), ["doc_id", "block_id"], "left")
    w = Window.partitionBy("doc_id").orderBy("ord")
    size = F.coalesce(F.octet_length("new"), F.col("end") - F.col("start"))
    shift = F.coalesce(F.sum(size - (F.col("end") - F.col("start"))).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = pieces.withColumn("target_start", F.col("start") + shift).withColumn("target_end", F.col("start") + shift + size)
    edits = placed.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ord", "start", "end", "new"))).alias("edits"))  # the blocks of one document
    raw = F.col("text").cast("binary")
    cut = lambda a, b: F.substring(raw, (a + 1).cast("int"), (b - a).cast("int"))
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.lit(b"").alias("out"))
    add = lambda acc, x: F.struct(x["end"].alias("at"), F.concat(acc.out, cut(acc["at"], x["start"]), F.coalesce(x.new.cast("binary"), cut(x["start"], x["end"]))).alias("out"))
    whole = F.aggregate(F.coalesce("edits", F.array().cast("array<struct<ord:int,start:bigint,end:bigint,new:string>>")), zero, add)
    built = documents.select("doc_id", "text").join(edits, "doc_id", "left").withColumn("_b", whole)
    text = F.concat(F.col("_b.out"), F.substring(raw, (F.col("_b.at") + 1).cast("int"), (F.octet_length("text") - F.col("_b.at")).cast("int"))).cast("string")
    return built.select("doc_id", text.alias("text")), placed.select("doc_id", "block_id", "target_start", "target_end")


def unknown_accepted(accepted: DataFrame, blocks: DataFrame) -> DataFrame:
    return accepted.join(blocks.select("doc_id", "block_id"), ["doc_id", "block_id"], "left_anti")


def alignment(blocks: DataFrame, statuses: DataFrame, offsets: DataFrame) -> DataFrame:
    """A row a block: blocks joined to statuses(doc_id, block_id, status) and target ranges. What can't be translated is preserved, unless its segments couldn't be read."""
    can = translatable(F.col("kind"), F.col("spelling"), F.col("outcome"))
    default = F.when(can, "fallback_source").when((F.col("spelling") == "html") & (F.col("outcome") == "failed"), "fallback_source").otherwise("preserved")
    rows = blocks.join(statuses.select("doc_id", "block_id", "status"), ["doc_id", "block_id"], "left").join(offsets, ["doc_id", "block_id"], "left")
    return rows.select(
        "doc_id", F.col("block_id").alias("source_block_id"), F.col("block_id").alias("target_block_id"), F.col("kind").alias("block_kind"), F.col("ord").alias("source_order"), F.col("ord").alias("target_order"),
        F.struct("start", "end").alias("source_range"), F.struct(F.coalesce("target_start", F.lit(0)).alias("start"), F.coalesce("target_end", F.lit(0)).alias("end")).alias("target_range"),
        sync_role(F.col("kind")).alias("sync_role"), F.coalesce("status", default).alias("fallback_status"), F.lit(None).cast("string").alias("parent_id"), F.col("spelling").alias("source_format"), can.alias("translatable"),
    )


def summary(aligned: DataFrame) -> DataFrame:
    """Counts by status over translatable rows of each document."""
    count = lambda s: F.count_if(F.col("translatable") & (F.col("fallback_status") == s)).alias(s)
    return aligned.groupBy("doc_id").agg(F.count_if("translatable").alias("total_units"), *[count(s) for s in STATUSES])


def retries(attempts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, retries, retried) of attempts(keys, attempt, batch_fault): content dispatches after the first; any attempt above 1."""
    content = F.count_if((F.col("attempt") > 0) & ~F.col("batch_fault"))
    return attempts.groupBy(*keys).agg(F.greatest(content - 1, F.lit(0)).alias("retries"), (F.max("attempt") > 1).alias("retried"))


def active_block(scrolls: DataFrame, anchors: DataFrame, key: str) -> DataFrame:
    """(key, at, block, progress): the anchor that holds each scroll position or, between anchors, the nearest below, the last at the bottom.

    The last anchor that begins at or above a position, and the first below it, come from one window over both.
    """
    marks = scrolls.select(key, F.col("at").cast("double").alias("pos"), F.lit(1).alias("kind"), F.lit(None).cast("struct<id:string,top:double,height:double>").alias("a"))
    tops = anchors.select(key, F.col("top").cast("double").alias("pos"), F.lit(0).alias("kind"), F.struct(F.col("id"), F.col("top").cast("double").alias("top"), F.col("height").cast("double").alias("height")).alias("a"))
    both = marks.unionByName(tops)
    w = Window.partitionBy(key).orderBy("pos", "kind")
    above = F.last("a", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    below = F.first("a", ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    seen = both.withColumn("above", above).withColumn("below", below).where("kind = 1")
    holds = F.coalesce(F.col("pos") < F.col("above.top") + F.col("above.height"), F.lit(False))
    chosen = F.when(holds, F.col("above")).otherwise(F.coalesce("below", "above"))
    progress = F.least(F.greatest((F.col("pos") - F.col("c.top")) / F.greatest(F.lit(1.0), F.col("c.height")), F.lit(0.0)), F.lit(1.0))
    return seen.withColumn("c", chosen).select(key, F.col("pos").alias("at"), F.col("c.id").alias("block"), progress.alias("progress"))


def sync_attributes(row_id: Column, role: Column, kind: Column, status: Column, order: Column) -> Column:
    """A pane element's attributes."""
    esc = lambda c: F.replace(F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit('"'), F.lit("&quot;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return F.format_string('data-sync-id="%s" data-sync-role="%s" data-sync-kind="%s" data-sync-status="%s" data-sync-order="%d"', esc(row_id), role, kind, status, order)


def first_anchors(anchors: DataFrame, key: str, name: str, order: str) -> DataFrame:
    """The first of each id."""
    return anchors.withColumn("_n", F.row_number().over(Window.partitionBy(key, name).orderBy(order))).where("_n = 1").drop("_n")


ROLES = ("anchor", "container", "child-only", "non-sync")


def loaded(maps: DataFrame, key: str, text: str, more: str = "") -> DataFrame:
    """Rows of alignment maps in JSON with the first fault of each, of maps whose major version is known.

    Faults: no_id, unknown_role, range (inverted).
    """
    row = (more.replace(" ", ":") + "," if more else "") + "source_block_id:string,sync_role:string,source_range:struct<start:bigint,end:bigint>"
    parsed = maps.select(key, F.from_json(text, f"struct<schema_version:string,blocks:array<struct<{row}>>>").alias("m"))
    rows = parsed.where(F.col("m.schema_version").startswith("1.")).select(key, F.explode("m.blocks").alias("b")).select(key, "b.*")
    fault = F.when(F.col("source_block_id").isNull(), "no_id").when(~F.col("sync_role").isin(*ROLES), "unknown_role").when(F.col("source_range.start") > F.col("source_range.end"), "range")
    return rows.withColumn("fault", fault)


def synchronised(rows: DataFrame) -> DataFrame:
    return rows.where("sync_role <> 'non-sync'")


def drift(rows: DataFrame, anchors: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, drift): rows without an anchor in the pane, and anchors without a row."""
    a = rows.select(*keys).join(anchors.select(*keys), keys, "left_anti").withColumn("drift", F.lit("row_without_anchor"))
    return a.unionByName(anchors.select(*keys).join(rows.select(*keys), keys, "left_anti").withColumn("drift", F.lit("anchor_without_row")))
