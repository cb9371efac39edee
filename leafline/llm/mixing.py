"""Mixing sources to target weights along a time-varying curriculum.

Targets: each source's share of all words by weight, stopped at `cap` times the source's size,
the excess reshared by weight until none is above (water-filling, from one pass over sources
ordered by cap / weight). A source's documents stand in the order of the MD5 of doc_id; the
source is passed through floor(target / size) times and then partly, the last document cut, so
that the words taken are the target rounded down.

Curriculum: each source has a schedule, a piecewise linear rate over training time 0 to 1. Its
integral is the source's cumulative demand of words; a pass of a document that begins after the
fraction y of the source's target is trained at the time t where the integral reaches y. mix()
returns documents range-sorted by that time; account() reads that mix through and says by document what it holds.

Prefix sums of a source are taken in two levels, BUCKETS ranges of the hash and then rows within
a range, so that a source with a third of all rows is 4096 small windows, not one.

Cases: null text has size 0 and is never taken; a null source is a source of its own, the last. Rows of one doc_id
are rows of their own, by size and the text's hash; those without stand in the order of the MD5 of their text. A source of size 0 has target 0. An empty table gives an empty
table. Other columns are carried by mix() if named, else ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, mapped, word_count, written

WEIGHTS = (5, 2, 1)
#: Rates by the source's place among the weights: knots of (time, rate).
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (1.0, 1.5)))
HEX = 3  # digits of the hash that name a bucket: 4096 for each source


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, cap: int = 3) -> DataFrame:
    """_source, slot, source_size, target of sizes(_source, source_size). One row a source, so one window may hold them."""
    everything = Window.partitionBy()
    by_name = Window.orderBy("_source")
    ranked = sizes.withColumn("slot", (F.row_number().over(by_name) - 1) % len(weights))
    ranked = ranked.withColumn("w", F.element_at(F.array(*[F.lit(int(w)) for w in weights]), F.col("slot") + 1).cast("long")).withColumn("top", F.col("source_size") * cap)
    before = Window.orderBy(F.col("top") / F.col("w"), "_source").rowsBetween(Window.unboundedPreceding, -1)
    of_all = lambda c: F.sum(c).over(everything)
    level = (of_all("source_size") - F.coalesce(F.sum("top").over(before), F.lit(0))) / (of_all("w") - F.coalesce(F.sum("w").over(before), F.lit(0)))
    full = ranked.withColumn("capped", level * F.col("w") > F.col("top"))
    free = lambda c: F.sum(F.when(~F.col("capped"), F.col(c)).otherwise(0)).over(everything)
    rest = of_all("source_size") - F.sum(F.when(F.col("capped"), F.col("top")).otherwise(0)).over(everything)
    share = rest / free("w") * F.col("w")
    return full.select("_source", "slot", "source_size", F.when(F.col("capped"), F.col("top").cast("double")).otherwise(share).alias("target"))


def time_of(y: Column, knots: Sequence[tuple[float, float]]) -> Column:
    """The time at which the integral of a piecewise linear rate reaches the fraction y of its whole."""
    areas = [(t1 - t0) * (r0 + r1) / 2 for (t0, r0), (t1, r1) in zip(knots, knots[1:], strict=False)]
    total, done, out = sum(areas), 0.0, F.lit(float(knots[-1][0]))
    pieces = []
    for (t0, r0), (t1, r1), area in zip(knots, knots[1:], areas, strict=False):
        need, slope = y * total - done, (r1 - r0) / (t1 - t0)
        step = need / r0 if slope == 0 else (F.sqrt(r0 * r0 + 2 * slope * need) - r0) / slope
        pieces.append((y * total < done + area, t0 + step))
        done += area
    for condition, value in reversed(pieces):
        out = F.when(condition, value).otherwise(out)
    return out


def plan(docs: DataFrame, carry: Sequence[str] = (), weights: Sequence[int] = WEIGHTS, schedules=SCHEDULES, cap: int = 3) -> DataFrame:
    """doc_id, size, source_size, target, taken, passes, first_position of each row, and the columns to carry with their names under `_doc`."""
    source, text = F.col("source").cast("string"), F.col("text").cast("string")
    key = F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source))  # orders as the source does, null last
    rows = docs.select("doc_id", key.alias("_source"), F.md5(F.coalesce(F.col("doc_id").cast("string"), text, F.lit("")).cast("binary")).alias("_h"), F.xxhash64(text).alias("_tie"), word_count(text).alias("size"), *([F.struct(*[F.col(f"`{c}`") for c in carry]).alias("_doc")] if carry else []))
    if not carry:
        rows = written(docs.sparkSession, rows, "sizes")
    rows = rows.withColumn("_bucket", F.substring("_h", 1, HEX))
    buckets = rows.groupBy("_source", "_bucket").agg(F.sum("size").alias("n"))
    if carry:
        buckets = written(docs.sparkSession, buckets, "buckets")
    goals = targets(buckets.groupBy("_source").agg(F.sum("n").alias("source_size")), weights, cap)
    ahead = Window.partitionBy("_source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.withColumn("_ahead", F.coalesce(F.sum("n").over(ahead), F.lit(0))).drop("n").join(goals, "_source")
    inside = Window.partitionBy("_source", "_bucket").orderBy("_h", "doc_id", "size", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    out = rows.join(buckets, ["_source", "_bucket"]).withColumn("_start", F.col("_ahead") + F.sum("size").over(inside) - F.col("size"))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    rest = F.floor("target") - F.col("_whole") * F.col("source_size")
    part = F.least(F.greatest(rest - F.col("_start"), F.lit(0)), F.col("size"))
    out = out.withColumn("_whole", whole.cast("long")).withColumn("_part", part.cast("long")).withColumn("taken", F.col("_whole") * F.col("size") + F.col("_part"))
    out = out.withColumn("passes", F.when(F.col("taken") > 0, F.col("_whole") + (F.col("_part") > 0).cast("long")).otherwise(0))
    out = out.withColumn("first_position", F.when(F.col("passes") > 0, _position(F.lit(0), schedules)))
    return out


def _position(lap: Column, schedules) -> Column:
    """Training time of a pass, by its source's schedule."""
    y = (lap * F.col("source_size") + F.col("_start")) / F.col("target")
    out = F.lit(None).cast("double")
    for slot, knots in enumerate(schedules):
        out = F.when(F.col("slot") % len(schedules) == slot, time_of(y, knots)).otherwise(out)
    return out


def mix(docs: DataFrame, columns: Sequence[str], weights: Sequence[int] = WEIGHTS, schedules=SCHEDULES, cap: int = 3, with_position: bool = False, with_plan: bool = False) -> DataFrame:
    """The mix: these columns of docs, a row for each pass of a document, in the order of training.

    A document that ends a source's target is cut after the words still needed (its white space
    then becomes single spaces); n_chars follows. Partition i of n holds training times from i / n on, sorted.

    with_plan: also the position, and as `_plan` the row's size, source_size, target and place in its source; documents that the mix
    doesn't take have a row too, without position and text, behind the others and dealt over all partitions.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = plan(docs, columns, weights, schedules, cap)
    rows = rows if with_plan else rows.where("passes > 0")
    last = F.greatest(F.col("passes") - 1, F.lit(0))  # sequence() would count down
    laps = rows.withColumn("_lap", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    laps = laps.withColumn("position", F.when(F.col("passes") > 0, _position(F.col("_lap"), schedules)))
    cut = (F.col("_lap") == F.col("_whole")) & (F.col("_part") < F.col("size"))
    short = F.array_join(F.slice(F.split(F.regexp_replace(F.col("_doc.text"), f"^{SPACE}+", ""), SPACE + "+"), F.lit(1), F.col("_part").cast("int")), " ")
    laps = laps.withColumn("_text", F.when(F.col("passes") == 0, None).when(cut, short).otherwise(F.col("_doc.text")))
    value = {"text": F.col("_text"), "n_chars": F.when(cut, F.char_length("_text").cast("long")).otherwise(F.col("_doc.n_chars"))} if "n_chars" in columns else {"text": F.col("_text")}
    planned = F.struct("size", "source_size", "target", F.col("_source").alias("source"), F.col("_start").alias("start")).alias("_plan")
    out = laps.select("position", *[value.get(c, F.col(f"_doc.`{c}`")).alias(c) for c in columns], *[planned] * with_plan)
    slot = F.least(F.floor(F.col("position") * parts), F.lit(parts - 1)).cast("int")
    if with_plan:
        slot = F.when(F.col("position").isNotNull(), slot).otherwise(F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in columns], "_plan.source", "_plan.start"), F.lit(parts)).cast("int"))
    out = out.repartitionById(parts, slot).sortWithinPartitions(F.asc_nulls_last("position"), *[c for c in ("doc_id",) if c in columns])
    return out if with_position or with_plan else out.drop("position")


def account(docs: DataFrame, weights: Sequence[int] = WEIGHTS, schedules=SCHEDULES, cap: int = 3) -> DataFrame:
    """doc_id, size, source_size, target, taken, passes, first_position of each row of docs, by what stands in the mix.

    The mix is made whole, texts repeated, cut and range-sorted, and read through; taken are the words of its texts. Only
    their numbers are kept, as a table. A document of at least one word is known by its source and its place there.
    """
    mixed = mix(docs, ["doc_id", "text"], weights, schedules, cap, with_plan=True)
    kind, names = docs.schema["doc_id"].dataType.simpleString(), ["position", "doc_id", "size", "source_size", "target", "source", "start"]

    def make():
        def step(batch: pa.RecordBatch) -> dict:
            # bytes.split() splits at just the contract's white space
            return {c: batch.column(c) for c in names} | {"words": [len(t.split()) if t else 0 for t in batch.column("text").to_pylist()]}

        return step

    laid = mixed.select("position", "doc_id", "_plan.*", F.col("text").cast("string").cast("binary").alias("text"))
    counted = mapped(laid, make, f"position double, doc_id {kind}, size long, source_size long, target double, source string, start long, words long")
    rows = written(docs.sparkSession, counted, "mix-rows")
    keys = ["doc_id", "size", "source_size", "target"]
    found = rows.where("position is not null").groupBy("source", "start", *keys).agg(F.sum("words").alias("taken"), F.count(F.lit(1)).alias("passes"), F.min("position").alias("first_position"))
    missed = rows.where("position is null").select(*keys, F.col("words").alias("taken"), F.lit(0).cast("long").alias("passes"), F.col("position").alias("first_position"))
    return found.select(*missed.columns).unionByName(missed)
