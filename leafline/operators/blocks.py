"""Documents to blocks, and what windows over blocks give: ids, sections, gaps, islands, neighbours."""

from __future__ import annotations

import json
from bisect import bisect_left

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..arrow import mapped, spread
from ..functions import markdown
from ..functions.blocks import KINDS, UNTRANSLATED, Block, Document, html_document
from ..functions.html import TooDeep, inventory, segments
from ..functions.text import siphash13

BLOCKS = (
    "doc_id long, ord int, block_id string, kind string, info string, fenced boolean, ordered boolean, task boolean, label string, spelling string, html_type int, start long, end long, "
    "source_hash long, section_path array<string>, ast_path array<int>, payload string, outcome string, refs string, headings array<string>"
)


def literal_map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def id_code(kind: Column) -> Column:
    return literal_map({k: c for k, (c, _) in KINDS.items()})[kind]


def sync_role(kind: Column) -> Column:
    return literal_map({k: r for k, (_, r) in KINDS.items()})[kind]


def translatable(kind: Column, spelling: Column, outcome: Column) -> Column:
    """HTML blocks by whether they yielded segments, others by kind."""
    return F.when(spelling == "html", F.coalesce(outcome == "unit", F.lit(False))).otherwise(~kind.isin(*UNTRANSLATED))


def read(text: str, form: str) -> Document:
    return html_document(text) if form == "html" else markdown.document(text)


def outcome(doc: Document, b: Block) -> str | None:
    """For an HTML block: unit or preserved (no segments), failed if it nests too deeply."""
    if b.spelling != "html":
        return None
    if doc.texts:
        i = bisect_left(doc.texts, b.start)
        return "unit" if i < len(doc.texts) and doc.texts[i] < b.end else "preserved"
    try:
        return "unit" if segments(doc.raw[b.start : b.end].decode("utf-8", "replace")) else "preserved"
    except TooDeep:
        return "failed"


def _title(b: Block, payload: str, refs: dict[str, str]) -> str:
    """A heading's own text."""
    if b.spelling != "html":
        return markdown.heading_text(payload, refs)
    try:
        return " ".join(t.strip() for t, _ in segments(payload))
    except TooDeep:
        return ""


def scan(documents: DataFrame) -> DataFrame:
    """The blocks of documents(doc_id, text, format: markdown or html). Null texts and texts nested too deeply have none: see rejects().

    refs are the document's link definitions (JSON), at the blocks that may use one; headings the texts of the open headings.
    """

    def step(rows: dict) -> dict:
        out: dict = {f.split()[0]: [] for f in BLOCKS.split(", ")}
        slices: list[bytes] = []
        for doc_id, text, form in zip(rows["doc_id"], rows["text"], rows["format"], strict=True):
            doc = None if text is None else read(text, form)
            if doc is None or doc.too_deep:
                continue
            known = markdown.references(text) if form != "html" and "]:" in text else {}
            titles: dict[str, str] = {}
            for i, b in enumerate(doc.blocks):
                part = doc.raw[b.start : b.end]
                slices.append(part)
                payload = part.decode("utf-8", "replace")
                if b.kind.startswith("heading"):
                    titles[b.block_id] = _title(b, payload, known)
                values = (doc_id, i, b.block_id, b.kind, b.info, b.fenced, b.ordered, b.task, b.label, b.spelling, b.html_type, b.start, b.end, None, b.section, b.path, payload, outcome(doc, b), json.dumps(known) if known and b.spelling != "html" and "[" in payload else None, [titles.get(x, "") for x in b.section])
                for c, v in zip(out, values, strict=True):
                    out[c].append(v)
        out["source_hash"] = siphash13(slices).astype("int64").tolist()
        return out

    return mapped(spread(documents.select("doc_id", "text", "format")), step, BLOCKS)


def rejects(documents: DataFrame, cap: int | None = None) -> DataFrame:
    """(doc_id, reason) of documents that scan() leaves out."""

    def step(rows: dict) -> dict:
        out: dict = {"doc_id": [], "reason": []}
        for doc_id, text, form in zip(rows["doc_id"], rows["text"], rows["format"], strict=True):
            reason = "null" if text is None else "oversize" if cap is not None and len(text.encode()) > cap else "nesting" if read(text, form).too_deep else None
            if reason:
                out["doc_id"].append(doc_id)
                out["reason"].append(reason)
        return out

    return mapped(documents.select("doc_id", "text", "format"), step, "doc_id long, reason string")


def html_segments(blocks: DataFrame) -> DataFrame:
    """(doc_id, block_id, seg, text, parent_label) of HTML blocks."""

    def step(rows: dict) -> dict:
        out: dict = {c: [] for c in ("doc_id", "block_id", "seg", "text", "parent_label")}
        for doc_id, block, payload in zip(rows["doc_id"], rows["block_id"], rows["payload"], strict=True):
            for i, (text, label) in enumerate(segments(payload)):
                for c, v in zip(out, (doc_id, block, i, text, label), strict=True):
                    out[c].append(v)
        return out

    return mapped(blocks.where("spelling = 'html' and outcome = 'unit'").select("doc_id", "block_id", "payload"), step, "doc_id long, block_id string, seg int, text string, parent_label string")


def tag_inventory(documents: DataFrame) -> DataFrame:
    """(doc_id, tags) with the names of all tags in order."""
    return mapped(spread(documents.select("doc_id", "text")), lambda rows: {"doc_id": rows["doc_id"], "tags": [inventory(t or "") for t in rows["text"]]}, "doc_id long, tags array<string>")


# --- relations over blocks in order: keys are the columns of a document, order its order ---


def with_ids(df: DataFrame, key: str, order: str, kind: str) -> DataFrame:
    """block_id: the kind's code and the place among all blocks of the document, four digits at least."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return df.withColumn("block_id", F.format_string("%s-%04d", id_code(F.col(kind)), place))


def with_sections(df: DataFrame, key: str, order: str, level: str, name: str) -> DataFrame:
    """section_path: the names of the headings open before each row, by windows only.

    A heading of level L is open if no later heading of a level up to L came before this row.
    """
    before = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    last = {k: F.max(F.when(F.col(level) == k, F.struct(F.col(order).alias("at"), F.col(name).alias("name")))).over(before) for k in range(1, 7)}
    df = df.withColumns({f"_p{k}": c for k, c in last.items()})
    open_ = [
        F.when((F.col(level).isNull() | (F.col(level) > k)) & F.col(f"_p{k}").isNotNull() & F.coalesce(*[F.when(F.col(f"_p{j}.at") > F.col(f"_p{k}.at"), F.lit(False)) for j in range(1, k)], F.lit(True)), F.col(f"_p{k}.name"))
        for k in range(1, 7)
    ]
    return df.withColumn("section_path", F.filter(F.array(*open_), lambda x: x.isNotNull())).drop(*[f"_p{k}" for k in range(1, 7)])


def gap_ranges(df: DataFrame, key: str, order: str, start: str, end: str, size: str) -> DataFrame:
    """(key, gap_start, gap_end) before each block, and after the last up to size."""
    w = Window.partitionBy(key).orderBy(order)
    own = df.select(key, F.coalesce(F.lag(end).over(w), F.lit(0)).alias("gap_start"), F.col(start).alias("gap_end"))
    tail = df.groupBy(key).agg(F.max(end).alias("gap_start"), F.max(size).alias("gap_end"))
    return own.unionByName(tail)


def top_level(df: DataFrame, key: str, order: str, list_key: str) -> DataFrame:
    """Adjacent rows of one list merged: (key, place, first, last, items)."""
    w = Window.partitionBy(key).orderBy(order)
    same = F.coalesce(F.col(list_key) == F.lag(list_key).over(w), F.lit(False))
    runs = df.withColumn("place", F.sum(F.when(same, 0).otherwise(1)).over(w))
    return runs.groupBy(key, "place").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count(F.lit(1)).alias("items"))


def with_context(df: DataFrame, key: str, order: str, kind: str, text: str, keep: int = 120) -> DataFrame:
    """Kind and trimmed beginning of the blocks before and after, of all blocks: filter afterwards."""
    w = Window.partitionBy(key).orderBy(order)
    short = F.substring(F.regexp_replace(F.col(text), r"^\s+|\s+$", ""), 1, keep)
    return df.withColumns({
        "preceding_kind": F.lag(kind).over(w), "preceding": F.lag(short).over(w), "following_kind": F.lead(kind).over(w), "following": F.lead(short).over(w),
    })


def with_section_number(df: DataFrame, key: str, order: str, heading: Column) -> DataFrame:
    """section: 0 before the first heading, then one more at each."""
    return df.withColumn("section", F.sum(heading.cast("int")).over(Window.partitionBy(key).orderBy(order)))


def document_title(df: DataFrame, key: str, order: str, kind: str, text: str) -> DataFrame:
    """The first title, else the first heading of level 1."""
    named = df.where(F.col(kind).isin("title", "heading-1"))
    return named.groupBy(key).agg(F.min_by(text, F.struct(F.col(kind) != "title", F.col(order))).alias("title"))


def html_dominance(df: DataFrame, key: str, spelling: str, size: str) -> DataFrame:
    """Whether four fifths of a document's bytes, and half a KiB at least, are HTML blocks."""
    total, markup = F.sum(size), F.sum(F.when(F.col(spelling) == "html", F.col(size)).otherwise(0))
    return df.groupBy(key).agg(((markup * 100 >= total * 80) & (total >= 512)).alias("dominated"))
