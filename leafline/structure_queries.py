"""Queries of operators on text structure, on fragments made of whole rows of the test tables, with SQL that counts the same in the rows themselves.

A query's Markdown or HTML is built from the columns that its SQL reads, so a scanner that misread it would differ.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import functions as F

from .arrow import mapped
from .functions import html, markdown
from .functions import text as texts
from .operators import blocks, validate
from .plans import engine
from .queries import _BARE, pages, query, table
from .sources import log, profile


def each(df, key: str, column: str, make, schema: str):
    """(key, make(text)...) of each row; make gives a tuple for the columns after the key."""
    names = [x.split()[0] for x in schema.split(", ")]

    def step(rows: dict) -> dict:
        got = [make(t) for t in rows["_t"]]
        return {key: rows[key]} | {n: [g[i] for g in got] for i, n in enumerate(names)}

    kind = df.schema[key].dataType.simpleString()
    return mapped(df.select(key, F.col(column).alias("_t")), step, f"{key} {kind}, {schema}")


# --- tags ---


@query("T9_T10_T20_void_and_raw_tags", rf"""
select page_id as doc_id, cast(len(regexp_extract_all({_BARE}, '<(area|base|br|col|embed|hr|img|input|link|meta|param|source|track|wbr)[ />]')) as bigint) as void,
       cast(len(regexp_extract_all({_BARE}, '<(script|style|textarea|title|xmp|iframe|noembed|noframes)[ >]')) as bigint) as raw from pages
""")
def void_and_raw(spark, sf_dir):
    return each(pages(spark, sf_dir), "doc_id", "text", lambda t: tuple(sum(x in names for x in html.inventory(t or "") if not x.startswith("/")) for names in (html.VOID, html.RAW)), "void long, raw long")


@query("T17_T19_sync_attributes", "select page_id as doc_id, md5(html) as md5, cast(len(regexp_extract_all(html, '<p>')) as bigint) as marked from pages")
def sync_attributes(spark, sf_dir):
    """Reserved attributes that an author wrote go, and nothing else changes."""
    marked = pages(spark, sf_dir).withColumn("text", F.replace("text", F.lit("<p>"), F.lit('<p data-sync-id="x">')))
    cleaned = each(marked, "doc_id", "text", lambda t: (html.strip_sync_attributes(t), t.count("data-sync-id")), "clean string, marked long")
    return cleaned.select("doc_id", F.md5(F.replace("clean", F.lit("<p >"), F.lit("<p>"))).alias("md5"), "marked")


@query("P13_P14_P31_P32_slices", "select page_id as doc_id, true as whole, true as apart from pages")
def slices(spark, sf_dir):
    """Each payload is the bytes of its range, and ranges stand in order."""
    d = pages(spark, sf_dir)
    b = blocks.scan(d).join(d.select("doc_id", F.col("text").cast("binary").alias("raw")), "doc_id")
    part = F.expr("substring(raw, cast(start as int) + 1, cast(`end` - start as int))")
    same = F.col("payload").cast("binary") == part
    inside = (F.col("start") <= F.col("end")) & (F.col("end") <= F.octet_length("raw"))
    return b.groupBy("doc_id").agg(F.bool_and(same).alias("whole"), F.bool_and(inside).alias("apart"))


@query("P25_P44_P46_T8_nesting", "select conv_id, turn, length(text) + 500 > 512 as too_deep from conversations where length(text) <= 60")
def nesting(spark, sf_dir):
    """As many open elements as a text has letters, and 500."""
    t = table(spark, sf_dir, "conversations").where("length(text) <= 60").withColumn("doc_id", F.col("conv_id") * 10_000 + F.col("turn"))
    deep = t.select("doc_id", F.repeat(F.lit("<div>"), F.length("text") + 500).alias("text"), F.lit("html").alias("format"))
    found = blocks.rejects(deep).where("reason = 'nesting'").select("doc_id", F.lit(True).alias("hit"))
    return t.join(found, "doc_id", "left").select("conv_id", "turn", F.coalesce("hit", F.lit(False)).alias("too_deep"))


@query("P3_P12_nul_and_line_ends", "select conv_id, turn, cast(5 + octet_length(encode(replace(text, chr(0), '�'))) + 3 + 1 as bigint) as start from conversations where regexp_matches(text, '^[A-Za-z]+[A-Za-z .,]*$')")
def line_ends(spark, sf_dir):
    """The place of a heading after CRLF lines and a replaced NUL of three bytes."""
    t = table(spark, sf_dir, "conversations").where(F.col("text").rlike("^[A-Za-z]+[A-Za-z .,]*$")).withColumn("doc_id", F.col("conv_id") * 10_000 + F.col("turn"))
    d = t.select("doc_id", F.concat(F.lit("a\0\r"), "text", F.lit("\r\n\r\n# h\n")).alias("text"), F.lit("markdown").alias("format"))
    found = blocks.scan(d).where("kind = 'heading-1'").select("doc_id", "start")
    return t.join(found, "doc_id").select("conv_id", "turn", "start")


# --- Markdown facts ---


@query("U6_U21_M24_table_facts", "select n_regionkey as region, 3 as columns, ':-|-:|-' as marks, cast(count(*) as bigint) as rows from nation group by n_regionkey")
def table_facts(spark, sf_dir):
    row = F.concat(F.lit("| "), "n_nationkey", F.lit(" | "), "n_name", F.lit(" | x \\| y |"))
    t = table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("region")).agg(F.concat_ws("\n", F.lit("| k | name | c |\n|:-|-:|-|"), F.array_sort(F.collect_list(row))).alias("t"))

    def facts(t: str) -> tuple:
        columns, marks, rows = markdown.table_facts(t)
        shown = {"left": ":-", "right": "-:", "none": "-", "": "-", None: "-", "center": ":-:"}
        return columns, "|".join(shown[m] for m in marks), rows if rows == len(markdown.table_rows(t)[2]) else -1

    return each(t, "region", "t", facts, "columns int, marks string, rows long")


@query("U7_U8_U9_V8_list_topology", "select r_regionkey as region, cast(1 + count(n_nationkey) as bigint) as items, cast(count(n_nationkey) as bigint) as nested from region left join nation on r_regionkey = n_regionkey group by r_regionkey")
def list_topology(spark, sf_dir):
    """A region's item with its nations as a nested list, and the same as a quote."""
    n = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.concat_ws("\n", F.array_sort(F.collect_list(F.concat(F.lit("  1. "), "n_name")))).alias("inner"))
    t = table(spark, sf_dir, "region").join(n, F.col("r_regionkey") == F.col("n_regionkey"), "left").select(F.col("r_regionkey").alias("region"), F.concat(F.lit("- "), "r_name", F.lit("\n"), F.coalesce("inner", F.lit(""))).alias("t"))

    def topology(t: str) -> tuple:
        items = markdown.list_topology(t)
        quote = markdown.quote_children("\n".join("> " + x for x in t.rstrip().split("\n")))
        return len(items) if len(quote) == 1 else -1, sum(i["depth"] > min(x["depth"] for x in items) for i in items)

    return each(t, "region", "t", topology, "items long, nested long")


@query("U13_P6_heading_text", "select page_id, cast(page_id % 6 + 1 as int) as level, url as text from pages")
def heading_text(spark, sf_dir):
    t = table(spark, sf_dir, "pages").select("page_id", F.concat(F.repeat(F.lit("#"), (F.col("page_id") % 6 + 1).cast("int")), F.lit(" **[`"), "url", F.lit("`](/u)** #")).alias("t"))
    return each(t, "page_id", "t", lambda t: (markdown.document(t).blocks[0].kind[-1], markdown.heading_text(t)), "l string, text string").select("page_id", F.col("l").cast("int").alias("level"), "text")


@query("V15_V16_V33_inline_inventory", "select page_id, url || ' /p' || page_id || ' ' || url as destinations, 'k' || page_id as code, 1 as html from pages")
def inline_inventory(spark, sf_dir):
    """Destinations in order: a link, a reference, an autolink; a code span that holds a link, and inline HTML."""
    t = table(spark, sf_dir, "pages").select("page_id", F.to_json(F.struct(F.concat(F.lit("[a]("), "url", F.lit(") [b][r] <"), "url", F.lit("> `k"), "page_id", F.lit("` <b>")).alias("t"), F.concat(F.lit("/p"), "page_id").alias("r"))).alias("j"))

    def found(j: str) -> tuple:
        x = json.loads(j)
        got = markdown.inline(x["t"], {"r": x["r"]})
        return " ".join(got.destinations), got.code[0], len(got.html)

    return each(t, "page_id", "j", found, "destinations string, code string, html int")


@query("P16_P40_V18_definitions", "select page_id, 'r' || page_id as label, url as target, true as pure, 'r' || page_id as changed from pages")
def definitions(spark, sf_dir):
    t = table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("see [R"), "page_id", F.lit("]\n\n[R"), "page_id", F.lit("]: "), "url", F.lit("\n")).alias("t"))

    def found(t: str) -> tuple:
        (label, target), *more = markdown.references(t).items()
        definition = t.split("\n\n")[1]
        return label, target, not more and markdown.pure_definitions(definition), validate.definition_change(t, t.replace("]: ", "]: x"))

    return each(t, "page_id", "t", found, "label string, target string, pure boolean, changed string")


@query("M7_M8_V38_fences", """
select conv_id, turn, cast(greatest(3, 1 + coalesce(list_max(list_transform(regexp_extract_all(text || repeat('`', turn % 7), '`+'), lambda x: length(x))), 0)) as int) as fence, true as same from conversations
""")
def fences(spark, sf_dir):
    t = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 10_000 + F.col("turn")).alias("key"), "conv_id", "turn", F.concat("text", F.repeat(F.lit("`"), (F.col("turn") % 7).cast("int"))).alias("t"))

    def fenced(t: str) -> tuple:
        made = markdown.fence(t, "info")
        node = markdown.parse_lines(markdown.split_lines(made.encode())[0])
        return len(re.match("`+", made)[0]), len(node) == 1 and node[0].kind == "code-block" and node[0].info == "info"

    return t.join(each(t, "key", "t", fenced, "fence int, same boolean"), "key").select("conv_id", "turn", "fence", "same")


@query("G7_V29_byte_cut", """
with k as (select doc_id, text, list_max(list_filter(range(0, 101), lambda k: octet_length(encode(left(text, k))) <= 100)) as n from documents where text is not null)
select doc_id, left(text, n) as cut, octet_length(encode(text)) > 100 as was_cut from k
""")
def byte_cut(spark, sf_dir):
    return each(table(spark, sf_dir, "documents").where("text is not null"), "doc_id", "text", lambda t: texts.cut_bytes(t, 100), "cut string, was_cut boolean")


@query("T14_blank_lines", r"select doc_id, cast(len(regexp_extract_all(text || chr(10) || 'z', '\n')) as bigint) as ends, md5('a' || chr(10) || regexp_replace(regexp_replace(text, '[\r\n]+', ' ', 'g'), '^ +| +$', '', 'g') || chr(10) || 'z') as md5 from documents where regexp_matches(text, '^[^\s][^\r\n]*$')")
def blank_lines(spark, sf_dir):
    """A one-line text between blank lines stands without them."""
    d = table(spark, sf_dir, "documents").where(F.col("text").rlike(r"^[^\s][^\r\n]*$"))
    made = d.select("doc_id", F.concat(F.lit("a\n \t\n\n"), F.regexp_replace("text", "^ +| +$", ""), F.lit("\n\n\nz")).alias("t"))
    return each(made, "doc_id", "t", lambda t: (html.collapse_blank_lines(t),), "t string").select("doc_id", F.regexp_count("t", F.lit("\n")).cast("long").alias("ends"), F.md5(F.col("t")).alias("md5")).withColumn("ends", F.col("ends") - 1)


# --- units that must be rejected, layer by layer ---


@query("V4_V5_V6_V7_V9_V11_V12_V13_unit_checks", """
select n_nationkey as key, r.name, r.layer from nation, (values ('nul', 'bytes'), ('level', 'per_kind'), ('rows', 'per_kind'), ('quote', 'per_kind'), ('info', 'per_kind'), ('kind', 'fragment'), ('empty', 'text'), ('link', 'inline'), ('same', null), ('good', null)) as r(name, layer)
""")
def unit_checks(spark, sf_dir):
    """Results for units made of each nation's comment, one for each layer that must reject, and two that pass."""

    def cases(t: str) -> list[tuple]:
        cut = f"| a |\n|---|\n| {t} |\n"
        return [
            ("nul", "paragraph", t, t + "\0"), ("level", "heading-2", f"## {t}", f"# {t}"), ("rows", "table", cut, cut + f"| {t} |\n"), ("quote", "blockquote", f"> {t}", f"> {t}\n>\n> - {t}"),
            ("info", "code-block", f"```a\n{t}\n```", f"```b\n{t}\n```"), ("kind", "paragraph", t, f"# {t}"), ("empty", "heading-2", f"## {t}", "## ​"), ("link", "paragraph", f"[{t}](u)", f"[{t}](v)"),
            ("same", "paragraph", t, t), ("good", "list-item", f"- {t}", f"- x {t}"),
        ]

    def step(rows: dict) -> dict:
        got = [(k, name, fault and fault[0]) for k, t in zip(rows["key"], rows["t"], strict=True) for name, kind, a, b in cases(t) for fault in [validate.check_unit(kind, "markdown", a, b)]]
        return {"key": [g[0] for g in got], "name": [g[1] for g in got], "layer": [g[2] for g in got]}

    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("key"), F.concat(F.lit("Word "), F.translate("n_name", "|`*_<>[]", "")).alias("t"))
    return mapped(n, step, "key long, name string, layer string")


# --- runs of the engine over all pages ---


def _titles(df):
    return df.select("doc_id", F.regexp_extract("text", "(?s)<title>(.*?)</title>", 1).alias("title"))


@query("D7_D9_D13_D25_G9_G12_G13_requests", "select page_id as doc_id, 'Titel: ' || regexp_extract(html, '<title>(.*?)</title>', 1, 's') as title from pages")
def requests(spark, sf_dir):
    """Titles change only in a request that says why the first result was rejected, and each batch's first call fails in passing."""
    seen: set = set()

    def provider(request: engine.Request) -> list[str]:
        if request.prompt not in seen:
            seen.add(request.prompt)
            raise engine.Transient("busy", 0)
        asked = {u["unit_id"] for u in json.loads(request.prompt)["units"]}
        if "en" not in request.system or "de" not in request.system or asked != {u["unit_id"] for u in request.units}:
            return []
        title = lambda u: json.dumps(["Titel: " + x for x in json.loads(u["payload"])]) if u["reason"] else "no array"
        return [title(u) if u["kind"] == "title" else u["payload"] for u in request.units]

    return _titles(engine.run(pages(spark, sf_dir), engine.Options(source_language="en", target_language="de"), provider=provider)["document"])


@query("D2_D3_D4_D18_D19_D22_B7_warm_cache", "select page_id as doc_id, html as text from pages")
def warm_cache(spark, sf_dir):
    """A second run takes every answer from the first one's entries: a call of its provider would end it."""

    def never(request: engine.Request) -> list[str]:
        raise ValueError("a unit wasn't in the cache")

    first = engine.run(pages(spark, sf_dir))
    return engine.run(pages(spark, sf_dir), provider=never, known=first["entries"])["document"].select("doc_id", "text")


# --- profile and log ---

PROFILE = """
slug = "docs"
version = "3"
odd = 1
[system]
prompt = "p"
prompt_html = "h"
[constraints]
preserve_urls = false
table_strategy = "whole"
[batching]
max_units_per_batch = 7
target_output_tokens = -1
extra = 1
"""


@query("S3_S4_G10_G11_G22_profile", "select 'docs' as slug, '3' as version, 'h' as prompt, false as urls, 'whole' as tables, 7 as units, 0 as output, 3 as warnings union all select 'default', '1', null, true, 'windows', 0, 0, 0")
def profiles(spark, sf_dir):
    rows = [(p.slug, p.version, p.prompt_html, p.preserve_urls, p.table_strategy, p.max_units_per_batch or 0, p.target_output_tokens or 0, len(p.warnings)) for p in (profile.load(PROFILE), profile.default())]
    return spark.createDataFrame(rows, "slug string, version string, prompt string, urls boolean, tables string, units int, output int, warnings int")


@query("S7_S9_S15_compacted", "select cast(conv_id as varchar) as key, max_by(text, turn) as value from conversations group by conv_id")
def compacted(spark, sf_dir):
    """Appended records and a torn last line, compacted to the live ones and replayed."""
    t = table(spark, sf_dir, "conversations")
    record = F.to_json(F.struct(F.lit("entry").alias("t"), F.col("conv_id").cast("string").alias("key"), F.col("turn").alias("seq"), F.col("text").alias("value"), F.lit("translated").alias("status")))
    lines = t.select(record.alias("value")).unionByName(t.where("turn = 0").select(F.substring(record, 1, 30).alias("value")))
    live = log.trimmed(log.replay(lines), "seq", "bytes")
    again = live.select(F.to_json(F.struct(F.lit("entry").alias("t"), "key", "seq", "value", "status")).alias("value"))
    return log.replay(again).select("key", "value")
