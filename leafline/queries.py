"""Queries of the document-structure engine over the test tables, and the SQL that gives the same results.

Names begin with the ids of the operator inventory that they exercise. `conversations` serves as an ordered
relation of blocks, `pages` as HTML documents, `documents` as texts. A query without SQL parses a language that SQL can't.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.blocks import KINDS
from .operators import align, blocks, cache, glossary, language, packing, prompt, units, validate
from .plans import engine
from .sources import files, log

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

KIND_LIST = list(KINDS)
_SQL_KINDS = "[" + ", ".join(f"'{k}'" for k in KIND_LIST) + "]"
_SQL_CODES = "[" + ", ".join(f"'{KINDS[k][0]}'" for k in KIND_LIST) + "]"
_SQL_ROLES = "[" + ", ".join(f"'{KINDS[k][1]}'" for k in KIND_LIST) + "]"
#: Blocks made of conversation turns: kind by a rule, ranges two bytes apart.
_B = f"""
with b0 as (select conv_id, turn, role, text, octet_length(encode(text)) as size, (conv_id * 7 + turn * 5) % 16 as k from conversations),
     b as (select conv_id, turn, role, text, size, ({_SQL_KINDS})[k + 1] as kind, ({_SQL_CODES})[k + 1] as code, ({_SQL_ROLES})[k + 1] as sync_role, case when k < 6 then k + 1 end as level,
                  cast(sum(size + 2) over (partition by conv_id order by turn) - size - 2 as bigint) as s, cast(sum(size + 2) over (partition by conv_id order by turn) - 2 as bigint) as e from b0)
"""


def query(name: str, sql: str | None = None) -> Callable:
    def keep(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The relation `b` of the SQL above."""
    from pyspark.sql import Window

    t = table(spark, sf_dir, "conversations").withColumn("size", F.octet_length("text").cast("long")).withColumn("k", ((F.col("conv_id") * 7 + F.col("turn") * 5) % 16).cast("int"))
    after = F.sum(F.col("size") + 2).over(Window.partitionBy("conv_id").orderBy("turn"))
    t = t.withColumn("kind", F.element_at(F.array(*[F.lit(k) for k in KIND_LIST]), F.col("k") + 1)).withColumn("level", F.when(F.col("k") < 6, F.col("k") + 1))
    return t.withColumns({"s": after - F.col("size") - 2, "e": after - 2}).drop("k")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.col("html").alias("text"), F.lit("html").alias("format"))


# --- scans ---

_BARE = r"regexp_replace(regexp_replace(html, '<!--.*?-->', '', 'gs'), '<(script|style|title)([^>]*)>.*?</(script|style|title)>', '<\1></\1>', 'gs')"


@query("blocks_by_kind", f"""
with p as (select page_id, html, {_BARE} as t from pages),
     n as (select len(regexp_extract_all(html, '<title[ >]')) as title, len(regexp_extract_all(t, '<h1[ >]')) as h1, len(regexp_extract_all(t, '<li[ >]')) as li,
                  len(regexp_extract_all(t, '<p[ >]')) + len(regexp_extract_all(t, '<(div|footer)[^>]*>[ \n]*[^< \n]')) as p from p)
select 'title' as kind, cast(sum(title) as bigint) as n from n union all select 'heading-1', cast(sum(h1) as bigint) from n union all select 'list-item', cast(sum(li) as bigint) from n union all select 'paragraph', cast(sum(p) as bigint) from n
""")
def blocks_by_kind(spark, sf_dir):
    return blocks.scan(pages(spark, sf_dir)).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("P18_html_blocks")
def html_blocks(spark, sf_dir):
    b = blocks.scan(pages(spark, sf_dir))
    return b.select("doc_id", "ord", "block_id", "kind", "start", "end", "source_hash", F.array_join("section_path", ">").alias("section"), F.concat_ws(".", F.col("ast_path").cast("array<string>")).alias("path"), "outcome")


@query("P1_markdown_blocks")
def markdown_blocks(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text", F.lit("markdown").alias("format"))
    return blocks.scan(d).select("doc_id", "ord", "block_id", "kind", "start", "end", "source_hash")


@query("P36_translatable_documents", "select page_id as doc_id from pages")
def translatable_documents(spark, sf_dir):
    b = blocks.scan(pages(spark, sf_dir))
    return b.where(blocks.translatable(F.col("kind"), F.col("spelling"), F.col("outcome"))).select("doc_id").distinct()


@query("T2_tag_inventory", rf"""
select page_id as doc_id, list_aggregate(list_transform(regexp_extract_all({_BARE}, '</?[a-zA-Z][a-zA-Z0-9]*'), lambda x: lower(replace(x, '<', ''))), 'string_agg', ' ') as tags from pages
""")
def tags(spark, sf_dir):
    return blocks.tag_inventory(pages(spark, sf_dir)).select("doc_id", F.array_join("tags", " ").alias("tags"))


@query("T11_segments")
def segment_rows(spark, sf_dir):
    return blocks.html_segments(blocks.scan(pages(spark, sf_dir)))


@query("T12_D1_M5_echo_round_trip", "select page_id as doc_id, true as same from pages")
def round_trip(spark, sf_dir):
    d = pages(spark, sf_dir)
    return engine.run(d)["document"].join(d.select("doc_id", F.col("text").alias("source")), "doc_id").select("doc_id", F.col("text").eqNullSafe(F.col("source")).alias("same"))


@query("D1_M9_run_summary")
def run_summary(spark, sf_dir):
    return engine.run(pages(spark, sf_dir))["summary"]


@query("S1_capped", "select doc_id, octet_length(encode(text)) <= 4000 as fits from documents where text is not null")
def capped(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    fits, beyond = files.capped(d, "text", 4000)
    return fits.select("doc_id", F.lit(True).alias("fits")).unionByName(beyond.select("doc_id", F.lit(False).alias("fits")))


@query("S2_html_marker", r"select page_id, nullif(lower(regexp_extract(html, '^\s*(<!doctype|<html)', 1, 'i')), '') as marker from pages")
def markers(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", files.html_marker(F.col("html")).alias("marker"))


# --- ids, sections, gaps, islands, context ---


@query("P26_block_ids", _B + "select conv_id, turn, printf('%s-%04d', code, row_number() over (partition by conv_id order by turn)) as block_id from b")
def block_ids(spark, sf_dir):
    return blocks.with_ids(turns(spark, sf_dir), "conv_id", "turn", "kind").select("conv_id", "turn", "block_id")


@query("P28_P34_M10_kind_maps", _B + "select kind, code, sync_role, kind not in ('thematic-break', 'image', 'skipped') as translatable, count(*) as n from b group by all")
def kind_maps(spark, sf_dir):
    t = turns(spark, sf_dir)
    return t.select("kind", blocks.id_code(F.col("kind")).alias("code"), blocks.sync_role(F.col("kind")).alias("sync_role"), blocks.translatable(F.col("kind"), F.lit("markdown"), F.lit(None)).alias("translatable")).groupBy("kind", "code", "sync_role", "translatable").agg(F.count(F.lit(1)).alias("n"))


@query("P11_section_path", _B + ", p as (select conv_id, turn, level, " + ", ".join(f"max(case when level = {k} then turn end) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding) as p{k}" for k in range(1, 7)) + " from b) select conv_id, turn, array_to_string(list_filter([" + ", ".join(f"case when p{k} is not null and (level is null or level > {k})" + "".join(f" and coalesce(p{j}, -1) < p{k}" for j in range(1, k)) + f" then p{k} end" for k in range(1, 7)) + "], lambda x: x is not null), '>') as path from p")
def section_path(spark, sf_dir):
    t = turns(spark, sf_dir).withColumn("name", F.col("turn").cast("string"))
    return blocks.with_sections(t, "conv_id", "turn", "level", "name").select("conv_id", "turn", F.array_join("section_path", ">").alias("path"))


@query("P17_gap_ranges", _B + """
select conv_id, coalesce(lag(e) over (partition by conv_id order by turn), 0) as gap_start, s as gap_end from b
union all select conv_id, max(e), max(e) + 2 from b group by conv_id
""")
def gap_ranges(spark, sf_dir):
    t = turns(spark, sf_dir).withColumn("total", F.col("e") + 2)
    return blocks.gap_ranges(t, "conv_id", "turn", "s", "e", "total")


@query("P37_P39_top_level", """
with c as (select *, case when role = lag(role) over (partition by conv_id order by turn) then 0 else 1 end as new from conversations),
     r as (select *, sum(new) over (partition by conv_id order by turn) as place from c)
select conv_id, cast(place as bigint) as place, min(turn) as first, max(turn) as last, count(*) as items from r group by conv_id, place
""")
def top_level(spark, sf_dir):
    return blocks.top_level(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role")


@query("U12_U14_context", r"""
with c as (select conv_id, turn, role, substr(regexp_replace(text, '^\s+|\s+$', '', 'g'), 1, 120) as t from conversations)
select conv_id, turn, lag(role) over w as preceding_kind, lag(t) over w as preceding, lead(role) over w as following_kind, lead(t) over w as following from c window w as (partition by conv_id order by turn)
""")
def context(spark, sf_dir):
    return blocks.with_context(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text").select("conv_id", "turn", "preceding_kind", "preceding", "following_kind", "following")


@query("U15_sections", _B + "select conv_id, turn, cast(sum(case when level is null then 0 else 1 end) over (partition by conv_id order by turn) as bigint) as section from b")
def sections(spark, sf_dir):
    return blocks.with_section_number(turns(spark, sf_dir), "conv_id", "turn", F.col("level").isNotNull()).select("conv_id", "turn", "section")


@query("U11_document_title", _B + "select conv_id, arg_min(text, (case when kind = 'title' then 0 else 1 end) * 1000000 + turn) as title from b where kind in ('title', 'heading-1') group by conv_id")
def titles(spark, sf_dir):
    return blocks.document_title(turns(spark, sf_dir), "conv_id", "turn", "kind", "text")


@query("U34_html_dominance", _B + "select conv_id, sum(case when role = 'assistant' then size else 0 end) * 100 >= sum(size) * 80 and sum(size) >= 512 as dominated from b group by conv_id")
def html_dominance(spark, sf_dir):
    t = turns(spark, sf_dir).withColumn("spelling", F.when(F.col("role") == "assistant", "html").otherwise("markdown"))
    return blocks.html_dominance(t, "conv_id", "spelling", "size")


# --- units and packing ---


@query("U24_U35_packing", _B + """
, c as (select conv_id, turn, cast(ceil(size / 4.0) as bigint) as cost, row_number() over (partition by conv_id order by turn) as n from b),
  r as (
    with recursive w as (
      select conv_id, n, turn, cost as total, 1 as units, 0 as batch from c where n = 1
      union all
      select c.conv_id, c.n, c.turn, case when w.total + c.cost > 60 or w.units >= 3 then c.cost else w.total + c.cost end, case when w.total + c.cost > 60 or w.units >= 3 then 1 else w.units + 1 end,
             case when w.total + c.cost > 60 or w.units >= 3 then w.batch + 1 else w.batch end
      from w join c on c.conv_id = w.conv_id and c.n = w.n + 1)
    select * from w)
select conv_id, turn, cast(batch as bigint) as batch from r
""")
def packed(spark, sf_dir):
    t = turns(spark, sf_dir).withColumn("cost", packing.tokens(F.col("text")))
    return packing.pack(t, "conv_id", "turn", "cost", 60, 3).select("conv_id", "turn", "batch")


@query("U25_section_packing")
def packed_sections(spark, sf_dir):
    t = blocks.with_section_number(turns(spark, sf_dir), "conv_id", "turn", F.col("level").isNotNull()).withColumn("cost", packing.tokens(F.col("text")))
    return packing.pack_by_sections(t, "conv_id", "section", "turn", "cost", 60, 3)


@query("U22_U28_U29_U32_estimates", """
with e as (select conv_id, turn, cast(ceil(octet_length(encode(text)) / 4.0) as bigint) as t, case turn % 4 when 0 then null when 1 then -1.0 when 2 then 0.5 else 2.5 end as f0, case when turn % 3 = 0 then 0 else turn * 50 end as c from conversations)
select conv_id, turn, coalesce(case when f0 <= 0 then null else f0 end, 2.0) as factor, cast(ceil(t * coalesce(case when f0 <= 0 then null else f0 end, 2.0)) + 3 + 40 as bigint) as estimate,
       case when c > 0 then greatest(1, c - 64) end as target, case when turn % 5 <> 2 then turn % 5 when turn % 2 = 0 then 7 else 2 end as chosen from e
""")
def estimates(spark, sf_dir):
    t = table(spark, sf_dir, "conversations")
    raw = F.when(F.col("turn") % 4 == 1, -1.0).when(F.col("turn") % 4 == 2, 0.5).when(F.col("turn") % 4 == 3, 2.5)
    ceiling = F.when(F.col("turn") % 3 == 0, 0).otherwise(F.col("turn") * 50)
    t = t.withColumn("factor", packing.expansion_factor(raw))
    chosen = packing.caller_wins(F.col("turn") % 5, F.lit(2), F.when(F.col("turn") % 2 == 0, 7))
    return t.select("conv_id", "turn", "factor", packing.output_estimate(packing.tokens(F.col("text")), F.lit(3), F.col("factor")).alias("estimate"), packing.output_target(ceiling).cast("long").alias("target"), chosen.cast("long").alias("chosen"))


@query("U19_U20_window_ids", r"""
with w as (select conv_id, turn, case when turn % 2 = 0 then printf('t-%04d.w%02d', conv_id, turn + 1) else printf('t-%04d', conv_id) end as id from conversations)
select conv_id, turn, id, nullif(regexp_extract(id, '^(.+)\.w([0-9]+)$', 1), '') as parent, cast(nullif(regexp_extract(id, '^(.+)\.w([0-9]+)$', 2), '') as bigint) as number from w
""")
def window_ids(spark, sf_dir):
    parent = F.format_string("t-%04d", F.col("conv_id"))
    t = table(spark, sf_dir, "conversations").withColumn("id", F.when(F.col("turn") % 2 == 0, packing.window_id(parent, F.col("turn"))).otherwise(parent))
    up, number = packing.window_parts(F.col("id"))
    return t.select("conv_id", "turn", "id", up.alias("parent"), number.alias("number"))


@query("U30_over_output", "select conv_id, turn from conversations where ceil(octet_length(encode(text)) / 4.0) > 100")
def over_output(spark, sf_dir):
    t = table(spark, sf_dir, "conversations").withColumns({"est": packing.tokens(F.col("text")), "target": F.lit(100)})
    return packing.over_output(t, "est", "target").select("conv_id", "turn")


@query("U2_U3_U5_assembled_units")
def assembled_units(spark, sf_dir):
    b = units.assembled(blocks.scan(pages(spark, sf_dir)).where("outcome = 'unit'"))
    return b.select("doc_id", "block_id", "input_mode", "sent", "constraints")


@query("U3_G24_input_modes", _B + "select kind, case kind when 'table' then 'table_rows' when 'code-block' then 'code' when 'list-item' then 'list_item' when 'blockquote' then 'blockquote' when 'html' then 'html_segments' else 'markdown' end as mode, count(*) as n from b group by all")
def input_modes(spark, sf_dir):
    return turns(spark, sf_dir).select("kind", units.mode(F.col("kind"), F.lit("markdown")).alias("mode")).groupBy("kind", "mode").agg(F.count(F.lit(1)).alias("n"))


@query("G13_G16_prompt_round_trip", "select conv_id, cast(turn as varchar) as unit_id, text as translated from conversations")
def prompt_round_trip(spark, sf_dir):
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("turn").cast("string").alias("unit_id"), F.col("role").alias("kind"), F.col("text").alias("payload"), F.lit(None).cast("string").alias("context"))
    p = prompt.user_prompt(t, ["conv_id"], "turn").withColumn("answer", F.replace("prompt", F.lit('"payload":'), F.lit('"translated_payload":')))
    return prompt.answers(p, ["conv_id"], "answer").select("conv_id", "unit_id", "translated")


@query("G14_batch_facts", "select conv_id, bool_or(role = 'assistant') as any_html, bool_or(turn % 5 = 4) as any_window from conversations group by conv_id")
def batch_facts(spark, sf_dir):
    t = table(spark, sf_dir, "conversations").withColumns({"spelling": F.when(F.col("role") == "assistant", "html").otherwise("markdown"), "unit_id": F.when(F.col("turn") % 5 == 4, "t-0001.w02").otherwise("t-0001")})
    return prompt.facts(t, ["conv_id"])


@query("G18_json_body", r"select conv_id, turn, substr(cast(to_json(role || chr(34) || chr(92) || chr(10)) as varchar), 2, length(cast(to_json(role || chr(34) || chr(92) || chr(10)) as varchar)) - 2) as body from conversations")
def json_bodies(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", prompt.json_body(F.concat("role", F.lit('"\\\n'))).alias("body"))


@query("M20_M21_loaded_rows", "select conv_id, turn, case when turn % 6 = 0 then 'no_id' when turn % 6 = 1 then 'unknown_role' when turn % 6 = 2 then 'range' end as fault from conversations where conv_id % 5 <> 0")
def loaded_rows(spark, sf_dir):
    t, m = table(spark, sf_dir, "conversations"), F.col("turn") % 6
    row = F.struct("turn", F.when(m != 0, F.col("role")).alias("source_block_id"), F.when(m == 1, "odd").otherwise("anchor").alias("sync_role"), F.struct(F.when(m == 2, 9).otherwise(1).alias("start"), F.lit(5).alias("end")).alias("source_range"))
    maps = t.groupBy("conv_id").agg(F.to_json(F.struct(F.when(F.col("conv_id") % 5 == 0, "2.0.0").otherwise("1.3.0").alias("schema_version"), F.collect_list(row).alias("blocks"))).alias("map"))
    return align.loaded(maps, "conv_id", "map", "turn long").select("conv_id", "turn", "fault")


@query("M28_M29_drift", "select conv_id, turn, case when turn % 4 = 0 then 'row_without_anchor' else 'anchor_without_row' end as drift from conversations where turn % 4 in (0, 1)")
def drift(spark, sf_dir):
    t = table(spark, sf_dir, "conversations")
    return align.drift(t.where("turn % 4 <> 1"), t.where("turn % 4 <> 0"), ["conv_id", "turn"])


@query("L3_L7_L10_languages", "select c.conv_id % 5 as k, ['ko', 'ja', 'en', 'ru', 'xx'][c.conv_id % 5 + 1] as code, ['kor', 'jpn', 'eng', 'rus', null][c.conv_id % 5 + 1] as iso, ['hangul', 'kana', null, 'cyrillic', null][c.conv_id % 5 + 1] as script, count(*) as n from conversations c group by all")
def languages(spark, sf_dir):
    t = table(spark, sf_dir, "conversations").select((F.col("conv_id") % 5).alias("k"))
    t = t.withColumn("code", F.element_at(F.array(*[F.lit(x) for x in ("ko", "ja", "en", "ru", "xx")]), (F.col("k") + 1).cast("int")))
    return t.withColumns({"iso": blocks.literal_map({k: v[0] for k, v in language.LANGUAGES.items()})[F.col("code")], "script": blocks.literal_map(language.SCRIPT_OF)[F.col("code")]}).groupBy("k", "code", "iso", "script").agg(F.count(F.lit(1)).alias("n"))


# --- validation ---


@query("V1_V2_schema_faults", """
with u as (select conv_id, turn // 2 as id from conversations where turn % 3 <> 0), r as (select conv_id, turn as id from conversations where turn % 2 = 0 union all select conv_id, turn from conversations where turn % 4 = 0),
     a as (select conv_id, id, count(*) as n from u group by all), g as (select conv_id, id, count(*) as n from r group by all),
     j as (select coalesce(a.conv_id, g.conv_id) as conv_id, coalesce(a.id, g.id) as id, a.n as asked, g.n as got from a full join g on a.conv_id = g.conv_id and a.id = g.id)
select conv_id, id, 'request_duplicate' as fault from j where asked > 1 union all select conv_id, id, 'missing' from j where got is null
union all select conv_id, id, 'duplicated' from j where asked is not null and got > 1 union all select conv_id, id, 'foreign' from j where asked is null
""")
def schema_faults(spark, sf_dir):
    t = table(spark, sf_dir, "conversations")
    asked = t.where("turn % 3 <> 0").select("conv_id", F.expr("turn div 2").alias("id"))
    results = t.where("turn % 2 = 0").select("conv_id", F.col("turn").alias("id")).unionByName(t.where("turn % 4 = 0").select("conv_id", F.col("turn").alias("id")))
    return validate.schema_faults(asked, results, ["conv_id", "id"])


@query("V14_V37_visible", "select doc_id, regexp_matches(coalesce(text, ''), '[^\\s]') as visible from documents")
def visible(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", validate.visible(F.coalesce("text", F.lit(""))).alias("visible"))


@query("V3_verdicts")
def verdict_rows(spark, sf_dir):
    b = units.assembled(blocks.scan(pages(spark, sf_dir)).where("outcome = 'unit'")).withColumn("unit_id", F.col("block_id"))
    results = b.select("doc_id", "unit_id", F.when(F.col("ord") % 5 == 0, F.lit("[]")).otherwise(F.upper("sent")).alias("translated")).where("ord % 7 <> 0")
    return validate.verdicts(b, results).select("doc_id", "unit_id", "status", "rejected_by")


#: Probes spread over the whole of each conversation, its end included.
_SPREAD = "(select distinct conv_id, (turn * 1000003) % (max(e) over (partition by conv_id) + 2) as pos from b union select conv_id, max(e) + 1 from b group by conv_id)"


def _spread(t: DataFrame) -> DataFrame:
    from pyspark.sql import Window

    spread = t.select("conv_id", (F.col("turn") * 1000003 % (F.max("e").over(Window.partitionBy("conv_id")) + 2)).alias("at"))
    return spread.unionByName(t.groupBy("conv_id").agg((F.max("e") + 1).alias("at"))).distinct()


@query("V23_owning_or_flanking", _B + """
, o as (select distinct conv_id, (turn * 61) % 400 as pos from b)
select o.conv_id, pos as at, (select code || turn from b where b.conv_id = o.conv_id and s <= pos and pos < e) as owner,
       case when not exists (select 1 from b where b.conv_id = o.conv_id and s <= pos and pos < e) then (select arg_max(code || turn, s) from b where b.conv_id = o.conv_id and s <= pos) end as before,
       case when not exists (select 1 from b where b.conv_id = o.conv_id and s <= pos and pos < e) then (select arg_min(code || turn, s) from b where b.conv_id = o.conv_id and s > pos) end as after
from o
""")
def owning(spark, sf_dir):
    t = turns(spark, sf_dir).where("size > 0")
    ranges = t.select("conv_id", F.concat(blocks.id_code(F.col("kind")), F.col("turn").cast("string")).alias("id"), F.col("s").alias("start"), F.col("e").alias("end"))
    return validate.owners(turns(spark, sf_dir).select("conv_id", (F.col("turn") * 61 % 400).alias("at")).distinct(), ranges, "conv_id")


@query("V23_owning_or_flanking_whole", _B + """
, o as """ + _SPREAD + """
select o.conv_id, pos as at, (select code || turn from b where b.conv_id = o.conv_id and s <= pos and pos < e) as owner,
       case when not exists (select 1 from b where b.conv_id = o.conv_id and s <= pos and pos < e) then (select arg_max(code || turn, s) from b where b.conv_id = o.conv_id and s <= pos) end as before,
       case when not exists (select 1 from b where b.conv_id = o.conv_id and s <= pos and pos < e) then (select arg_min(code || turn, s) from b where b.conv_id = o.conv_id and s > pos) end as after
from o
""")
def owning_whole(spark, sf_dir):
    t = turns(spark, sf_dir).where("size > 0")
    ranges = t.select("conv_id", F.concat(blocks.id_code(F.col("kind")), F.col("turn").cast("string")).alias("id"), F.col("s").alias("start"), F.col("e").alias("end"))
    return validate.owners(_spread(turns(spark, sf_dir)), ranges, "conv_id")


@query("V24_offenders", _B + """
, f as (select distinct conv_id, (turn * 61) % 400 as pos from b)
select b.conv_id, cast(b.turn as varchar) as id, count(pos) as n from b left join f on f.conv_id = b.conv_id and s <= pos and pos < e group by all having count(pos) <> 1
""")
def offending(spark, sf_dir):
    t = turns(spark, sf_dir)
    ranges = t.select("conv_id", F.col("turn").cast("string").alias("id"), F.col("s").alias("start"), F.col("e").alias("end"))
    return validate.offenders(ranges, t.select("conv_id", (F.col("turn") * 61 % 400).alias("at")).distinct(), "conv_id")


@query("V24_offenders_whole", _B + """
, f as """ + _SPREAD + """
select b.conv_id, cast(b.turn as varchar) as id, count(pos) as n from b left join f on f.conv_id = b.conv_id and s <= pos and pos < e group by all having count(pos) <> 1
""")
def offending_whole(spark, sf_dir):
    t = turns(spark, sf_dir)
    ranges = t.select("conv_id", F.col("turn").cast("string").alias("id"), F.col("s").alias("start"), F.col("e").alias("end"))
    return validate.offenders(ranges, _spread(t), "conv_id")


@query("V26_neighbours", "select distinct c.conv_id, c.turn from conversations c join conversations s on s.conv_id = c.conv_id and s.turn % 7 = 3 and abs(c.turn - s.turn) <= 1")
def neighbours(spark, sf_dir):
    t = table(spark, sf_dir, "conversations")
    return validate.widened(t, t.where("turn % 7 = 3"), "conv_id", "turn").select("conv_id", "turn")


@query("V19_V30_first_difference", "select conv_id, min(turn) as place from conversations where (conv_id + turn) % 11 = 0 group by conv_id")
def first_difference(spark, sf_dir):
    t = table(spark, sf_dir, "conversations")
    changed = t.withColumn("role", F.when((F.col("conv_id") + F.col("turn")) % 11 == 0, "changed").otherwise(F.col("role")))
    return validate.first_difference(t, changed, "conv_id", "turn", "role")


@query("V32_boundaries", _B + ", m as (select conv_id, turn, s - (turn % 4) * 3 as s, e from b) select conv_id, turn from (select *, coalesce(max(e) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding), 0) as p from m) where s > e or e > 5000 or s < p")
def boundaries(spark, sf_dir):
    t = turns(spark, sf_dir).withColumns({"s": F.col("s") - F.col("turn") % 4 * 3, "total": F.lit(5000)})
    return validate.broken_boundaries(t, "conv_id", "turn", "s", "e", "total").select("conv_id", "turn")


@query("V28_bounded_warnings", """
with w as (select conv_id, text, row_number() over (partition by conv_id order by turn) as n from conversations)
select conv_id, cast(count(*) as int) as kept, cast(max(list_max(list_filter(range(0, 513), lambda k: octet_length(encode(left(text, k))) <= 512 and k <= length(text)))) as bigint) as longest from w where n <= 8 group by conv_id
""")
def warnings(spark, sf_dir):
    t = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("w"))
    kept = validate.bounded_warnings(F.transform("w", lambda x: x.text))
    return t.select("conv_id", F.size(kept).alias("kept"), F.array_max(F.transform(kept, F.char_length)).cast("long").alias("longest"))


# --- merging, regeneration, alignment, report ---


@query("M1_M2_merged_status", """
with w as (select conv_id, ['translated', 'preserved', 'fallback_source', 'partially_translated'][(conv_id + (turn // 4)) % 4 + 1] as status from conversations)
select conv_id as doc_id, case when count(distinct status) = 1 and min(status) <> 'partially_translated' then min(status) else 'partially_translated' end as status, count(*) as windows from w group by conv_id
""")
def merged(spark, sf_dir):
    s = F.element_at(F.array(*[F.lit(x) for x in ("translated", "preserved", "fallback_source", "partially_translated")]), ((F.col("conv_id") + F.floor(F.col("turn") / 4)) % 4 + 1).cast("int"))
    t = table(spark, sf_dir, "conversations").withColumn("status", s)
    return t.groupBy(F.col("conv_id").alias("doc_id")).agg(align.merged_status(F.col("status")).alias("status"), F.count(F.lit(1)).alias("windows"))


@query("M4_merged_tables", "select conv_id as doc_id, 'translated' as status, '| h |' || chr(10) || '|---|' || chr(10) || string_agg('| ' || turn || ' |', chr(10) order by turn) as payload from conversations group by conv_id")
def merged_tables(spark, sf_dir):
    t = table(spark, sf_dir, "conversations")
    w = t.select(F.col("conv_id").alias("doc_id"), F.lit("t-0001").alias("parent"), F.col("turn").cast("int").alias("window_index"), F.lit("translated").alias("status"), F.concat(F.lit("| h |\n|---|\n| "), F.col("turn").cast("string"), F.lit(" |")).alias("payload"))
    return align.merge_windows(w).select("doc_id", "status", "payload")


def _regenerated(spark, sf_dir):
    t = turns(spark, sf_dir)
    own = t.select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("ord"), F.col("turn").cast("string").alias("block_id"), F.col("s").alias("start"), F.col("e").alias("end"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x.text), "\n\n")
    source = t.groupBy(F.col("conv_id").alias("doc_id")).agg(text.alias("text"))
    new = t.where("turn % 2 = 1").select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("string").alias("block_id"), F.concat(F.lit("é:"), F.upper("role")).alias("payload"))
    return align.regenerate(own, new, source)


@query("M5_regenerate", "select conv_id as doc_id, string_agg(case when turn % 2 = 1 then 'é:' || upper(role) else text end, chr(10) || chr(10) order by turn) as text from conversations group by conv_id")
def regenerated(spark, sf_dir):
    return _regenerated(spark, sf_dir)[0]


@query("M5_target_offsets", """
with c as (select conv_id, turn, octet_length(encode(case when turn % 2 = 1 then 'é:' || upper(role) else text end)) as n from conversations)
select conv_id as doc_id, cast(turn as varchar) as block_id, cast(sum(n + 2) over w - n - 2 as bigint) as target_start, cast(sum(n + 2) over w - 2 as bigint) as target_end from c window w as (partition by conv_id order by turn)
""")
def target_offsets(spark, sf_dir):
    return _regenerated(spark, sf_dir)[1]


@query("M6_unknown_accepted", "select conv_id as doc_id, turn + 1 as block_id from conversations c where not exists (select 1 from conversations d where d.conv_id = c.conv_id and d.turn = c.turn + 1)")
def unknown_accepted(spark, sf_dir):
    t = table(spark, sf_dir, "conversations")
    return align.unknown_accepted(t.select(F.col("conv_id").alias("doc_id"), (F.col("turn") + 1).alias("block_id")), t.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("block_id")))


@query("M9_M14_alignment_summary", _B + """
, a as (select conv_id, kind not in ('thematic-break', 'image', 'skipped') as can, case when turn % 3 = 0 then 'translated' when turn % 3 = 1 then 'preserved' when kind in ('thematic-break', 'image', 'skipped') then 'preserved' else 'fallback_source' end as status from b)
select conv_id as doc_id, count(*) filter (can) as total_units, count(*) filter (can and status = 'translated') as translated, count(*) filter (can and status = 'preserved') as preserved,
       count(*) filter (can and status = 'fallback_source') as fallback_source, 0 as partially_translated, 0 as failed from a group by conv_id
""")
def alignment_summary(spark, sf_dir):
    t = turns(spark, sf_dir)
    own = t.select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("ord"), F.col("turn").cast("string").alias("block_id"), "kind", F.lit("markdown").alias("spelling"), F.lit(None).cast("string").alias("outcome"), F.col("s").alias("start"), F.col("e").alias("end"))
    statuses = own.where("ord % 3 < 2").select("doc_id", "block_id", F.when(F.col("ord") % 3 == 0, "translated").otherwise("preserved").alias("status"))
    offsets = own.select("doc_id", "block_id", F.col("start").alias("target_start"), F.col("end").alias("target_end"))
    return align.summary(align.alignment(own, statuses, offsets))


@query("M11_M13_retries", "select conv_id, role, greatest(count(*) filter (turn % 4 > 0 and turn % 5 <> 0) - 1, 0) as retries, max(turn % 4) > 1 as retried from conversations group by all")
def retries(spark, sf_dir):
    t = table(spark, sf_dir, "conversations").withColumns({"attempt": F.col("turn") % 4, "batch_fault": F.col("turn") % 5 == 0})
    return align.retries(t, ["conv_id", "role"])


@query("M12_report_order", r"select conv_id, turn, cast(row_number() over (partition by conv_id order by turn % 3, turn) as bigint) as place from conversations")
def report_order(spark, sf_dir):
    from pyspark.sql import Window

    t = table(spark, sf_dir, "conversations").withColumn("id", packing.window_id((F.col("turn") % 3).cast("string"), F.col("turn")))
    parent, number = packing.window_parts(F.col("id"))
    return t.select("conv_id", "turn", F.row_number().over(Window.partitionBy("conv_id").orderBy(parent.cast("int"), number)).cast("long").alias("place"))


@query("M19_active_block", _B + """
, p as (select distinct conv_id, (turn * 61) % 400 as pos from b),
  h as (select p.*, (select arg_max(turn, s) from b where b.conv_id = p.conv_id and s <= pos) as up, (select arg_min(turn, s) from b where b.conv_id = p.conv_id and s > pos) as down from p),
  c as (select h.conv_id, pos, case when pos < x.s + x.size - 1 then up else coalesce(down, up) end as block from h left join b x on x.conv_id = h.conv_id and x.turn = up)
select c.conv_id, cast(pos as double) as at, cast(block as varchar) as block, least(greatest((pos - s) / greatest(1.0, size - 1.0), 0.0), 1.0) as progress from c join b on b.conv_id = c.conv_id and b.turn = block
""")
def active_block(spark, sf_dir):
    t = turns(spark, sf_dir)
    anchors = t.select("conv_id", F.col("turn").cast("string").alias("id"), F.col("s").alias("top"), (F.col("size") - 1).alias("height"))
    return align.active_block(t.select("conv_id", (F.col("turn") * 61 % 400).alias("at")).distinct(), anchors, "conv_id")


@query("M19_active_block_whole", _B + """
, p as """ + _SPREAD + """,
  h as (select p.*, (select arg_max(turn, s) from b where b.conv_id = p.conv_id and s <= pos) as up, (select arg_min(turn, s) from b where b.conv_id = p.conv_id and s > pos) as down from p),
  c as (select h.conv_id, pos, case when pos < x.s + x.size - 1 then up else coalesce(down, up) end as block from h left join b x on x.conv_id = h.conv_id and x.turn = up)
select c.conv_id, cast(pos as double) as at, cast(block as varchar) as block, least(greatest((pos - s) / greatest(1.0, size - 1.0), 0.0), 1.0) as progress from c join b on b.conv_id = c.conv_id and b.turn = block
""")
def active_block_whole(spark, sf_dir):
    t = turns(spark, sf_dir)
    anchors = t.select("conv_id", F.col("turn").cast("string").alias("id"), F.col("s").alias("top"), (F.col("size") - 1).alias("height"))
    return align.active_block(_spread(t), anchors, "conv_id")


@query("M18_M26_sync_attributes", "select conv_id, turn, 'data-sync-id=\"' || replace(replace(replace(replace(role || '<&\"', '&', '&amp;'), '\"', '&quot;'), '<', '&lt;'), '>', '&gt;') || '\" data-sync-role=\"anchor\" data-sync-kind=\"paragraph\" data-sync-status=\"translated\" data-sync-order=\"' || turn || '\"' as attributes from conversations")
def sync_attributes(spark, sf_dir):
    t = table(spark, sf_dir, "conversations")
    return t.select("conv_id", "turn", align.sync_attributes(F.concat("role", F.lit('<&"')), F.lit("anchor"), F.lit("paragraph"), F.lit("translated"), F.col("turn")).alias("attributes"))


@query("M27_first_anchors", "select conv_id, role, min(turn) as turn from conversations group by all")
def first_anchors(spark, sf_dir):
    return align.first_anchors(table(spark, sf_dir, "conversations"), "conv_id", "role", "turn").select("conv_id", "role", "turn")


# --- cache, dispatch ---


def _log(spark, sf_dir) -> DataFrame:
    """A cache log of conversation turns: keys recur, some lines are broken, some evict."""
    t = table(spark, sf_dir, "conversations")
    seq = F.col("conv_id") * 1000 + F.col("turn")
    line = F.to_json(F.struct(F.when(F.col("turn") % 5 == 4, "evict").otherwise("entry").alias("t"), (F.col("conv_id") % 50).cast("string").alias("key"), seq.alias("seq"), F.substring("text", 1, 20).alias("value"), F.lit("translated").alias("status")))
    return t.select(F.when(F.col("turn") % 7 == 6, F.substring(line, 1, 12)).otherwise(line).alias("value"))


_LOG = "with l as (select cast(conv_id % 50 as varchar) as key, conv_id * 1000 + turn as seq, substr(text, 1, 20) as value, turn % 5 = 4 as evict from conversations where turn % 7 <> 6), k as (select *, row_number() over (partition by key order by seq desc) as n from l)"


@query("S5_S6_replay", _LOG + " select key, seq, value from k where n = 1 and not evict")
def replay(spark, sf_dir):
    return log.replay(_log(spark, sf_dir)).select("key", "seq", "value")


@query("S17_skipped_lines", "select count(*) as skipped from conversations where turn % 7 = 6")
def skipped_lines(spark, sf_dir):
    return log.skipped(_log(spark, sf_dir))


def _whole_log(spark, sf_dir) -> DataFrame:
    """The same log with whole texts as values; torn lines are as before."""
    t = table(spark, sf_dir, "conversations")
    seq = F.col("conv_id") * 1000 + F.col("turn")
    line = F.to_json(F.struct(F.when(F.col("turn") % 5 == 4, "evict").otherwise("entry").alias("t"), (F.col("conv_id") % 50).cast("string").alias("key"), seq.alias("seq"), F.col("text").alias("value"), F.lit("translated").alias("status")))
    return t.select(F.when(F.col("turn") % 7 == 6, F.substring(line, 1, 12)).otherwise(line).alias("value"))


@query("S5_S6_replay_whole", "with l as (select cast(conv_id % 50 as varchar) as key, conv_id * 1000 + turn as seq, text as value, turn % 5 = 4 as evict from conversations where turn % 7 <> 6), k as (select *, row_number() over (partition by key order by seq desc) as n from l) select key, seq, value from k where n = 1 and not evict")
def replay_whole(spark, sf_dir):
    return log.replay(_whole_log(spark, sf_dir)).select("key", "seq", "value")


@query("S17_skipped_lines_whole", "select count(*) as skipped from conversations where turn % 7 = 6")
def skipped_lines_whole(spark, sf_dir):
    return log.skipped(_whole_log(spark, sf_dir))


@query("S8_trim", "with t as (select conv_id * 1000 + turn as seq, octet_length(encode(text)) as n from conversations), r as (select *, sum(n) over (order by seq desc) as b, row_number() over (order by seq desc) as c from t) select seq from r where b + 100 <= 9000 and c <= 80")
def trim(spark, sf_dir):
    t = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("seq"), F.octet_length("text").cast("long").alias("n"))
    return cache.trimmed(t, "seq", "n", 9000, 80, 100).select("seq")


@query("D2_D5_D18_probe", "select conv_id, turn, exists (select 1 from conversations e where e.turn % 2 = 0 and e.text = c.text and e.role = c.role) as hit from conversations c")
def probe(spark, sf_dir):
    t = table(spark, sf_dir, "conversations")
    entries = t.where("turn % 2 = 0").select("text", "role").distinct()
    hits, misses = cache.probe(t, entries, ["text", "role"])
    return hits.select("conv_id", "turn", F.lit(True).alias("hit")).unionByName(misses.select("conv_id", "turn", F.lit(False).alias("hit")))


@query("D8_D9_D10_retry_policy", """
select conv_id, turn, case when turn % 3 = 0 then least(turn * 5000, 30000) else cast(least(200 * pow(2, turn % 8), 5000) as bigint) end as delay,
       case when turn % 2 = 0 and conv_id % 2 = 0 then 'accept' when turn % 4 >= 2 then case when conv_id % 2 = 1 or turn % 2 = 1 then 'fallback' else 'accept' end when conv_id % 2 = 1 then 'retry' else 'redispatch' end as disposition, 1 + 2 + turn * 2 as rounds from conversations
""")
def retry_policy(spark, sf_dir):
    t, turn, odd = table(spark, sf_dir, "conversations"), F.col("turn"), F.col("conv_id") % 2 == 1
    return t.select("conv_id", "turn", cache.backoff(turn % 8, F.when(turn % 3 == 0, turn * 5000)).alias("delay"), cache.disposition(turn % 2 == 0, odd, turn % 4, 2).alias("disposition"), cache.max_rounds(turn, 2, 2).alias("rounds"))


@query("D14_cacheable", "select conv_id, turn from conversations where turn % 3 <> 0")
def cacheable(spark, sf_dir):
    return cache.cacheable(table(spark, sf_dir, "conversations").withColumn("status", F.when(F.col("turn") % 3 == 0, "fallback_source").otherwise("translated"))).select("conv_id", "turn")


@query("D16_D17_detected_language", """
with d as (select conv_id, arg_min(role, turn) as detected, count(distinct role) > 1 as conflict from conversations where turn > 0 group by conv_id)
select conv_id, detected, conflict, coalesce(case when conv_id % 2 = 0 then detected end, case when conv_id % 3 = 0 then 'cached' end) as resolved from d
""")
def detected(spark, sf_dir):
    t = table(spark, sf_dir, "conversations").withColumn("language", F.when(F.col("turn") > 0, F.col("role")))
    d = cache.detected_language(t, "conv_id", "turn", "language")
    return d.withColumn("resolved", cache.resolved_language(F.when(F.col("conv_id") % 2 == 0, F.col("detected")), F.lit("cached"), F.col("conv_id") % 3))


# --- glossary ---


def _entries(spark, sf_dir) -> DataFrame:
    t = table(spark, sf_dir, "customer").where("c_custkey <= 400")
    return t.select(
        F.col("c_custkey").cast("int").alias("idx"), F.concat(F.when(F.col("c_custkey") % 2 == 0, " Term").otherwise("tERM"), (F.col("c_custkey") % 60).cast("string")).alias("source"),
        F.when(F.col("c_custkey") % 13 == 0, " ").otherwise(F.concat(F.lit("z"), F.col("c_custkey").cast("string"))).alias("target"), F.lit(None).cast("string").alias("note"),
        F.when(F.col("c_custkey") % 3 == 0, "section").otherwise("global").alias("scope"), F.array(F.concat(F.lit("Sec "), (F.col("c_custkey") % 4).cast("string"))).alias("sections"),
    )


_ENTRIES = """
with e as (select cast(c_custkey as int) as idx, 'term' || c_custkey % 60 as key, c_custkey % 13 = 0 as bad, case when c_custkey % 3 = 0 then 'section' else 'global' end as scope, 'sec ' || c_custkey % 4 as sec from customer where c_custkey <= 400),
     k as (select *, row_number() over (partition by key, scope, case when scope = 'section' then sec end order by idx) as n from e where not bad)
"""


@query("G1_G2_G20_normalise", _ENTRIES + "select idx, key, scope from k where n = 1")
def normalise(spark, sf_dir):
    return glossary.normalise(glossary.with_keys(_entries(spark, sf_dir))).select("idx", "key", "scope")


@query("G3_G4_effective", _ENTRIES + """
, s(section, path) as (values (1, ['sec 0', 'sec 3']), (2, ['sec 1']), (3, [])), f as (select idx, key, scope, sec from k where n = 1),
  m as (select section, f.*, min(case when scope = 'section' then idx end) over (partition by section, key) as winner from s join f on scope = 'global' or list_contains(path, sec))
select section, idx from m where winner is null or winner = idx
""")
def effective(spark, sf_dir):
    kept = glossary.normalise(glossary.with_keys(_entries(spark, sf_dir)))
    stacks = spark.createDataFrame([(1, ["sec 0", "sec 3"]), (2, ["sec 1"]), (3, [])], "section int, stack_keys array<string>")
    return glossary.effective(stacks, kept)


@query("G5_G6_merge_extracted", _ENTRIES + """
, x as (select cast(c_custkey as int) as idx, 'term' || (c_custkey * 7 % 90) as key, c_custkey % 17 = 0 as bad from customer where c_custkey <= 120),
  y as (select *, case when bad then 'invalid' when key in (select key from k where n = 1 and scope = 'global') then 'conflict' end as st from x),
  z as (select *, row_number() over (partition by key, st is null order by idx) as r from y),
  w as (select *, coalesce(st, case when r > 1 then 'invalid' end) as st2 from z),
  v as (select *, row_number() over (partition by st2 is null order by idx) as p from w)
select idx, coalesce(st2, case when p > 24 then 'invalid' else 'accepted' end) as state from v
""")
def merge_extracted(spark, sf_dir):
    static = glossary.normalise(glossary.with_keys(_entries(spark, sf_dir)))
    x = table(spark, sf_dir, "customer").where("c_custkey <= 120")
    new = x.select(F.col("c_custkey").cast("int").alias("idx"), F.concat(F.lit("Term"), (F.col("c_custkey") * 7 % 90).cast("string")).alias("source"), F.when(F.col("c_custkey") % 17 == 0, " ").otherwise("t").alias("target"), F.concat(F.lit("term"), (F.col("c_custkey") * 7 % 90).cast("string")).alias("key"))
    return glossary.merge_extracted(static, new).select("idx", "state")


# The same over the whole table: profiles of 400 entries and documents of 120 extracted terms, however many there are.


def _all_entries(spark, sf_dir) -> DataFrame:
    c = F.col("c_custkey")
    name = F.concat_ws(".", F.floor(c / 400).cast("string"), (c % 60).cast("string"))
    return table(spark, sf_dir, "customer").select(
        c.cast("int").alias("idx"), F.concat(F.when(c % 2 == 0, " Term").otherwise("tERM"), name).alias("source"), F.when(c % 13 == 0, " ").otherwise(F.concat(F.lit("z"), c.cast("string"))).alias("target"),
        F.lit(None).cast("string").alias("note"), F.when(c % 3 == 0, "section").otherwise("global").alias("scope"), F.array(F.concat(F.lit("Sec "), (c % 4).cast("string"))).alias("sections"),
    )


_ALL_ENTRIES = """
with e as (select cast(c_custkey as int) as idx, 'term' || c_custkey // 400 || '.' || c_custkey % 60 as key, c_custkey % 13 = 0 as bad, case when c_custkey % 3 = 0 then 'section' else 'global' end as scope, 'sec ' || c_custkey % 4 as sec from customer),
     k as (select *, row_number() over (partition by key, scope, case when scope = 'section' then sec end order by idx) as n from e where not bad)
"""


@query("G1_G2_G20_normalise_whole", _ALL_ENTRIES + "select idx, key, scope from k where n = 1")
def normalise_whole(spark, sf_dir):
    return glossary.normalise(glossary.with_keys(_all_entries(spark, sf_dir))).select("idx", "key", "scope")


@query("G3_G4_effective_whole", _ALL_ENTRIES + """
, s(section, path) as (values (1, ['sec 0', 'sec 3']), (2, ['sec 1']), (3, [])), f as (select idx, key, scope, sec from k where n = 1),
  m as (select section, f.*, min(case when scope = 'section' then idx end) over (partition by section, key) as winner from s join f on scope = 'global' or list_contains(path, sec))
select section, idx from m where winner is null or winner = idx
""")
def effective_whole(spark, sf_dir):
    kept = glossary.normalise(glossary.with_keys(_all_entries(spark, sf_dir)))
    stacks = spark.createDataFrame([(1, ["sec 0", "sec 3"]), (2, ["sec 1"]), (3, [])], "section int, stack_keys array<string>")
    return glossary.effective(stacks, kept)


@query("G5_G6_merge_extracted_whole", _ALL_ENTRIES + """
, x as (select cast(c_custkey as int) as idx, c_custkey // 120 as doc, 'term' || c_custkey // 400 || '.' || (c_custkey * 7 % 90) as key, c_custkey % 17 = 0 as bad from customer),
  y as (select *, case when bad then 'invalid' when key in (select key from k where n = 1 and scope = 'global') then 'conflict' end as st from x),
  z as (select *, row_number() over (partition by doc, key, st is null order by idx) as r from y),
  w as (select *, coalesce(st, case when r > 1 then 'invalid' end) as st2 from z),
  v as (select *, row_number() over (partition by doc, st2 is null order by idx) as p from w)
select idx, coalesce(st2, case when p > 24 then 'invalid' else 'accepted' end) as state from v
""")
def merge_extracted_whole(spark, sf_dir):
    static = glossary.normalise(glossary.with_keys(_all_entries(spark, sf_dir)))
    c = F.col("c_custkey")
    name = F.concat_ws(".", F.floor(c / 400).cast("string"), (c * 7 % 90).cast("string"))
    new = table(spark, sf_dir, "customer").select(c.cast("int").alias("idx"), F.floor(c / 120).alias("doc_id"), F.concat(F.lit("Term"), name).alias("source"), F.when(c % 17 == 0, " ").otherwise("t").alias("target"), F.concat(F.lit("term"), name).alias("key"))
    return glossary.merge_extracted(static, new, document="doc_id").select("idx", "state")


@query("G23_template_variables", "select conv_id, turn, case when role = 'user' then 'user' || '_x' else role || '_x' end as unknown from conversations")
def template_variables(spark, sf_dir):
    t = table(spark, sf_dir, "conversations")
    prompt = F.concat(F.lit("a {{target_language}} {{"), F.col("role"), F.lit("_x}} {{ source_language }}"))
    return t.select("conv_id", "turn", F.array_join(glossary.template_variables(prompt, ["target_language", "source_language"]), ",").alias("unknown"))


# --- language ---


@query("L1_L2_gate", """
with t as (select doc_id, coalesce(text, '') as x from documents), u as (select doc_id, case doc_id % 4 when 0 then 'Привет мир ' || substr(x, 1, 5) when 1 then 'Привіт світ є' when 2 then '123 !' else x end as x from t)
select doc_id, case when not regexp_matches(x, '\\p{L}') then 'no_letters' when regexp_matches(x, '[іІєЄїЇґҐ]') then 'foreign' when len(regexp_extract_all(x, '[А-яЁё]')) = 0 then 'absent'
  when len(regexp_extract_all(x, '[А-яЁё]')) * 5 >= len(regexp_extract_all(x, '\\p{L}')) then 'dominant' else 'minority' end as reading from u
""")
def readings(spark, sf_dir):
    x = F.coalesce("text", F.lit(""))
    t = table(spark, sf_dir, "documents")
    m = F.col("doc_id") % 4
    return t.select("doc_id", F.when(m == 0, F.concat(F.lit("Привет мир "), F.substring(x, 1, 5))).when(m == 1, "Привіт світ є").when(m == 2, "123 !").otherwise(x).alias("x")).select("doc_id", language.reading(F.col("x"), "cyrillic").alias("reading"))


@query("L1_L2_gate_whole", """
with u as (select doc_id, case when prefixed then 'Привет мир ' else '' end || coalesce(text, '') as x, prefixed from documents, (values (false), (true)) p(prefixed))
select doc_id, prefixed, case when not regexp_matches(x, '\\p{L}') then 'no_letters' when regexp_matches(x, '[іІєЄїЇґҐ]') then 'foreign' when len(regexp_extract_all(x, '[А-яЁё]')) = 0 then 'absent'
  when len(regexp_extract_all(x, '[А-яЁё]')) * 5 >= len(regexp_extract_all(x, '\\p{L}')) then 'dominant' else 'minority' end as reading from u
""")
def readings_whole(spark, sf_dir):
    # every document's whole text, as it is and behind words in Cyrillic
    t = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("x"), F.explode(F.array(F.lit(False), F.lit(True))).alias("prefixed"))
    x = F.when(F.col("prefixed"), F.concat(F.lit("Привет мир "), F.col("x"))).otherwise(F.col("x"))
    return t.select("doc_id", "prefixed", language.reading(x, "cyrillic").alias("reading"))


@query("L6_detect")
def detect(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", "lang").join(language.detected(d).select("doc_id", "detected"), "doc_id")


@query("L1_verdicts")
def verdicts_of_language(spark, sf_dir):
    return language.gate(table(spark, sf_dir, "documents"), "de")


@query("L8_L9_direction", "select conv_id, turn, case when turn % 3 = 0 then 'rtl' else 'ltr' end as dir from conversations")
def direction(spark, sf_dir):
    label = F.when(F.col("turn") % 3 == 0, "Arabic (Egypt)").when(F.col("turn") % 3 == 1, "fr-CA").otherwise("English")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", language.direction(label).alias("dir"))


from . import structure_queries  # noqa: E402, F401  adds its queries to QUERIES and SQL
