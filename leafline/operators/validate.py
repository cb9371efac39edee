"""Validation of results: schema faults by joins, structure by comparing facts, document gates by position."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..arrow import mapped
from ..functions import html, markdown
from ..functions.blocks import html_document
from ..functions.text import INVISIBLE, cut_bytes, has_visible_text
from .units import received

#: Warnings kept and their bytes.
WARNINGS, WARNING_BYTES = 8, 512


def schema_faults(units: DataFrame, results: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, fault): request_duplicate, missing, duplicated or foreign, from the counts of each id on both sides."""
    k = list(keys)
    asked, got = units.groupBy(*k).agg(F.count(F.lit(1)).alias("asked")), results.groupBy(*k).agg(F.count(F.lit(1)).alias("got"))
    both = asked.join(got, k, "full_outer")
    faults = F.filter(
        F.array(
            F.when(F.col("asked") > 1, F.lit("request_duplicate")),
            F.when(F.col("asked").isNotNull() & F.col("got").isNull(), F.lit("missing")),
            F.when(F.col("asked").isNotNull() & (F.col("got") > 1), F.lit("duplicated")),
            F.when(F.col("asked").isNull(), F.lit("foreign")),
        ),
        lambda x: x.isNotNull(),
    )
    return both.select(*k, F.explode(faults).alias("fault"))


def visible(text: Column) -> Column:
    """Whether anything shows: a character that is neither white space nor invisible."""
    ranges = "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in INVISIBLE)
    return text.rlike(rf"[^\s\p{{Z}}{ranges}]")


def bounded_warnings(warnings: Column) -> Column:
    """The first warnings, each cut to a number of bytes between characters."""

    def short(w: Column) -> Column:
        # a character has four bytes at most, so one of four cuts is between characters
        cuts = [F.substring(w.cast("binary"), 1, n).cast("string") for n in range(WARNING_BYTES, WARNING_BYTES - 4, -1)]
        return F.when(F.octet_length(w) <= WARNING_BYTES, w).otherwise(F.coalesce(*[F.when(F.is_valid_utf8(c), c) for c in cuts]))

    return F.transform(F.slice(warnings, 1, WARNINGS), short)


def check_unit(kind: str, spelling: str, source: str, result: str, refs: dict[str, str] | None = None, urls: bool = True, code: bool = False) -> tuple[str, str] | None:
    """(layer, reason) of the first check that rejects a result, None if all accept it."""
    if "\0" in result:
        return "bytes", "payload has NUL"
    if result == source:  # has all that is compared below
        return None
    try:
        if spelling == "html":
            return _check_html(source, result)
    except html.TooDeep as e:
        return "nesting", str(e)
    nodes = markdown.parse_lines(markdown.split_lines(result.encode())[0])
    first = nodes[0] if nodes else None
    if first is None:
        return "fragment", "payload is empty"
    if kind == "list-item" and not (first.kind == "list" and len(first.children) == 1 and len(nodes) == 1):
        return "fragment", "payload isn't one list item"
    wanted = {"list-item": "list"}.get(kind, "heading" if kind.startswith("heading") else kind)
    if first.kind != wanted or len(nodes) != 1:
        return "fragment", f"payload is {markdown.label_of(first)}, {len(nodes)} blocks"
    if kind.startswith("heading") and first.level != int(kind[-1]):
        return "per_kind", f"heading level {first.level}"
    if kind == "table" and markdown.table_facts(source) != markdown.table_facts(result):
        return "per_kind", f"table {markdown.table_facts(result)}"
    if kind == "list-item" and markdown.list_topology(source) != markdown.list_topology(result):
        return "per_kind", "list topology differs"
    if kind == "blockquote" and markdown.quote_children(source) != markdown.quote_children(result):
        return "per_kind", "quote children differ"
    if kind == "code-block":
        info = lambda t: next((n.info for n in markdown.parse_lines(markdown.split_lines(t.encode())[0])), None) or ""
        return None if info(source) == info(result) else ("per_kind", "fence info differs")
    if has_visible_text(markdown.visible_body(source, refs)) and not has_visible_text(markdown.visible_body(result, refs)):
        return "text", "no visible text"
    a, b = markdown.inline(source, refs), markdown.inline(result, refs)
    if urls and a.destinations != b.destinations:
        return "inline", "destinations differ"
    if code and not markdown.code_multiset_equal(a.code, b.code):
        return "inline", "code spans differ"
    return None if a.html == b.html else ("inline", "inline html differs")


def _check_html(source: str, result: str) -> tuple[str, str] | None:
    a, b = html.segments(source), html.segments(result)
    if len(a) != len(b):
        return "per_kind", f"{len(a)} segments became {len(b)}"
    if html.inventory(source) != html.inventory(result):
        return "html", "tags differ"
    if any(has_visible_text(x) and not has_visible_text(y) for (x, _), (y, _) in zip(a, b, strict=True)):
        return "text", "a segment lost its visible text"
    return None


def verdicts(units: DataFrame, results: DataFrame) -> DataFrame:
    """(doc_id, unit_id, status, accepted, rejected_by, reason, answer) of units(doc_id, unit_id, kind, spelling, html_type, payload, sent) against results(doc_id, unit_id, translated). A unit without exactly one result is rejected by schema.

    Further columns of units: refs (JSON: the link definitions that it uses), urls and code (whether destinations and code spans must
    stay); of results: error (why the provider gave none).
    """
    error = F.min("error") if "error" in results.columns else F.lit(None).cast("string")
    got = results.groupBy("doc_id", "unit_id").agg(F.count(F.lit(1)).alias("n"), F.min("translated").alias("translated"), error.alias("error"))
    extra = {"refs": F.lit(None).cast("string"), "urls": F.lit(True), "code": F.lit(False)}
    units = units.withColumns({c: v for c, v in extra.items() if c not in units.columns})
    inputs = ("doc_id", "unit_id", "kind", "spelling", "html_type", "payload", "sent", "refs", "urls", "code", "n", "error", "translated")
    both = units.join(got, ["doc_id", "unit_id"], "left").select(*inputs)

    def judge(kind, spelling, html_type, payload, was_sent, refs, urls, code, n, error, new) -> tuple[str | None, tuple[str, str] | None]:
        if error is not None:
            return None, ("provider", error)
        if n != 1 or new is None:
            return None, ("schema", "missing" if not n else "duplicated" if n > 1 else "null")
        text, reason = received(kind, spelling, html_type, payload, was_sent, new)
        fault = ("per_kind", reason) if reason else check_unit(kind, spelling, payload, text, json.loads(refs) if refs else None, urls, code)
        return (None if fault else text), fault

    def step(rows: dict) -> dict:
        out: dict = {c: [] for c in ("doc_id", "unit_id", "status", "accepted", "rejected_by", "reason", "answer")}
        columns = [rows[c] for c in inputs]
        for doc_id, unit, *rest in zip(*columns, strict=True):
            text, fault = judge(*rest)
            values = (doc_id, unit, "fallback_source" if fault else "translated", text, fault and fault[0], fault and cut_bytes(fault[1], WARNING_BYTES)[0], rest[-1])
            for c, v in zip(out, values, strict=True):
                out[c].append(v)
        return out

    return mapped(both, step, "doc_id long, unit_id string, status string, accepted string, rejected_by string, reason string, answer string")


def gate_fault(before: str, after: str, form: str, urls: bool = True) -> tuple[int, str] | None:
    """(place, reason) of the first block at which a regenerated document leaves its source's structure: kinds, tags, link destinations (with urls), link definitions, the bytes between blocks, boundaries."""
    read = lambda t: html_document(t) if form == "html" else markdown.document(t)
    a, b = read(before), read(after)
    for i, (x, y) in enumerate(zip(a.blocks, b.blocks, strict=False)):
        if x.kind != y.kind:
            return i, f"{x.kind} became {y.kind}"
        if form == "html":
            tags = [html.inventory(d.raw[n.start : n.end].decode("utf-8", "replace")) for d, n in ((a, x), (b, y))]
            if tags[0] != tags[1]:
                return i, "tags differ"
        elif x.kind == "list-item" and (x.ordered, x.task) != (y.ordered, y.task):
            return i, "list item differs"
        elif urls and x.kind not in ("code-block", "html") and (p := a.raw[x.start : x.end]) != (q := b.raw[y.start : y.end]):
            links = [markdown.inline(part.decode("utf-8", "replace"), refs).destinations for part, refs in ((p, refs_of(before)), (q, refs_of(after)))]
            if links[0] != links[1]:
                return i, "destinations differ"
    if len(a.blocks) != len(b.blocks):
        return min(len(a.blocks), len(b.blocks)), f"{len(a.blocks)} blocks became {len(b.blocks)}"
    if form != "html" and (label := definition_change(before, after)) is not None:
        return next((i for i, y in enumerate(b.blocks) if f"[{label}]".encode() in b.raw[y.start : y.end].lower()), 0), f"definition of {label} differs"
    for i, (x, y) in enumerate(zip(markdown.gaps(a), markdown.gaps(b), strict=True)):
        if a.raw[x[0] : x[1]] != b.raw[y[0] : y[1]]:
            return max(0, min(i, len(a.blocks) - 1)), "bytes between blocks differ"
    return None


def refs_of(text: str) -> dict[str, str]:
    """The link definitions of a document; most have none, which needs no parse."""
    return markdown.references(text) if "]:" in text else {}


def gate(documents: DataFrame, regenerated: DataFrame, urls: bool = True) -> DataFrame:
    """(doc_id, place, reason) of regenerated(doc_id, text) that fail against documents(doc_id, text, format). Unchanged texts pass unread."""
    changed = regenerated.join(documents.select("doc_id", "format", F.col("text").alias("before")), "doc_id").where("text <> before")

    def step(rows: dict) -> dict:
        found = [(d, f) for d, a, b, form in zip(rows["doc_id"], rows["before"], rows["text"], rows["format"], strict=True) if (f := gate_fault(a, b, form, urls))]
        return {"doc_id": [d for d, _ in found], "place": [f[0] for _, f in found], "reason": [f[1] for _, f in found]}

    return mapped(changed.select("doc_id", "before", "text", "format"), step, "doc_id long, place int, reason string")


def definition_change(source: str, translated: str) -> str | None:
    """The first label whose link definition was added, lost or changed."""
    a, b = refs_of(source), refs_of(translated)
    return next((k for k in [*a, *b] if a.get(k) != b.get(k)), None)


def owners(offsets: DataFrame, ranges: DataFrame, key: str) -> DataFrame:
    """(key, at, owner, before, after) of offsets(key, at) among ranges(key, id, start, end): the range that holds the place, else the nearest ones.

    Blocks don't overlap, so the last that begins at or before a place is the only one that can hold it: one
    window over places and starts together finds it and its neighbours, without a range join.
    """
    marks = offsets.select(key, F.col("at").alias("pos"), F.lit(1).alias("kind"), F.lit(None).cast("string").alias("id"), F.lit(None).cast("long").alias("end"))
    starts = ranges.select(key, F.col("start").cast("long").alias("pos"), F.lit(0).alias("kind"), "id", F.col("end").cast("long").alias("end"))
    both = marks.unionByName(starts)
    back = Window.partitionBy(key).orderBy("pos", "kind").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(key).orderBy("pos", "kind").rowsBetween(1, Window.unboundedFollowing)
    last = F.last(F.when(F.col("kind") == 0, F.struct("id", "end")), ignorenulls=True).over(back)
    following = F.first(F.when(F.col("kind") == 0, F.col("id")), ignorenulls=True).over(ahead)
    seen = both.withColumn("last", last).withColumn("next", following).where("kind = 1")
    inside = F.col("last.end") > F.col("pos")
    return seen.select(
        key, F.col("pos").alias("at"), F.when(inside, F.col("last.id")).alias("owner"), F.when(~F.coalesce(inside, F.lit(False)), F.col("last.id")).alias("before"), F.when(~F.coalesce(inside, F.lit(False)), F.col("next")).alias("after")
    )


def offenders(ranges: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """(key, id, n) of ranges in which not exactly one of fresh(key, at) begins."""
    own = owners(fresh, ranges, key).where("owner is not null").groupBy(key, F.col("owner").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return ranges.select(key, "id").join(own, [key, "id"], "left").withColumn("n", F.coalesce("n", F.lit(0))).where("n <> 1")


def widened(blocks: DataFrame, seeds: DataFrame, key: str, order: str) -> DataFrame:
    """(key, order) of the seeds' rows and the ones beside them."""
    near = seeds.select(key, F.explode(F.array(F.col(order) - 1, F.col(order), F.col(order) + 1)).alias(order)).distinct()
    return blocks.join(near, [key, order], "left_semi")


def first_difference(source: DataFrame, target: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """(key, place) of the first row whose value isn't that of the same place on the other side."""
    both = source.select(key, order, F.col(value).alias("a")).join(target.select(key, order, F.col(value).alias("b")), [key, order], "full_outer")
    return both.where(~F.col("a").eqNullSafe(F.col("b"))).groupBy(key).agg(F.min(order).alias("place"))


def broken_boundaries(ranges: DataFrame, key: str, order: str, start: str, end: str, size: str) -> DataFrame:
    """Rows whose range is inverted, past the text or before the end of the row above."""
    before = F.max(end).over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    return ranges.withColumn("_before", F.coalesce(before, F.lit(0))).where((F.col(start) > F.col(end)) | (F.col(end) > F.col(size)) | (F.col(start) < F.col("_before"))).drop("_before")
