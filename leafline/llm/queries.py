"""One query for each operator, over its whole table with production parameters, and its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, exact_dedup, licenses, mixing, ngram_join, pii, toxicity, url_rules, warc, winnow
from .common import table

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN, with_ids=False)


#: Rules of the contract: host and path, longest wins.
URL_RULES = (("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block"))


def op2_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(table(spark, sf_dir, "pages"), [url_rules.host_rule(*r) for r in URL_RULES])


def op3_winnow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnow.compare(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").where(~toxicity.held_out(F.col("doc_id")))
    scored = toxicity.fit_score(docs, labels, ["doc_id"])
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "evidence")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.account(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "source_size", "target", "taken", "passes", F.round("first_position", 9).alias("first_position"))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents"))
    of = lambda f: F.array_join(F.transform("found", f), ",")
    return found.select(
        "doc_id", "blocks", F.size("found").alias("n_found"), of(lambda x: x.license).alias("licenses"), of(lambda x: x.verdict).alias("verdicts"),
        of(lambda x: F.concat_ws(":", x.start.cast("string"), x.end.cast("string"))).alias("spans"),
    )


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc.read(warc.write(table(spark, sf_dir, "pages")), payloads=False)
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup(table(spark, sf_dir, "documents"))


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents"), n=4, percent=85)


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(table(spark, sf_dir, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op1_byte_bpe": op1_byte_bpe, "op2_url_rules": op2_url_rules, "op3_winnow": op3_winnow, "op4_toxicity": op4_toxicity, "op5_mixing": op5_mixing, "op6_licenses": op6_licenses, "op7_warc": op7_warc, "op8_exact_dedup": op8_exact_dedup, "op9_ngram_join": op9_ngram_join, "op10_pii": op10_pii}

SQL: dict[str, str] = {
    "op2_url_rules": r"""
with u as (select page_id, case when url like '%://%' then regexp_extract(substr(url, position('://' in url) + 3), '^([^/?#]*)', 1) else '' end as h0,
                  case when url like '%://%' then regexp_extract(substr(url, position('://' in url) + 3), '^[^/?#]*([^?#]*)', 1) else '' end as path from pages),
     v as (select page_id, lower(h0) as host, path from u),
     r(rule, rule_host, rule_path, verdict) as (values ('com/en/', 'com', '/en/', 'block'), ('example.com/en/7', 'example.com', '/en/7', 'allow'), ('net/de/', 'net', '/de/', 'allow'),
                                   ('example.net/de/8', 'example.net', '/de/8', 'block'), ('org/es/', 'org', '/es/', 'block')),
     m as (select page_id, host, path, rule, r.verdict, row_number() over (partition by page_id order by length(rule) desc) as n
           from v left join r on (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path)),
     q(pattern, re) as (select '^' || n || '^', '(^|[^a-z0-9])' || n || '($|[^a-z0-9])' from (select unnest(['ads', 'adserver', 'banner', 'banners', 'casino', 'clickbait', 'download', 'lottery', 'malware',
             'phishing', 'popup', 'porn', 'sexcam', 'torrent', 'tracker', 'warez', 'xxx']) as n) union all select '.' || n || '|', '[.]' || n || '$' from (select unnest(['exe', 'apk', 'msi']) as n)),
     p as (select page_id, min(pattern) as pattern from v, q where regexp_matches(lower(host || path), re) group by page_id)
select m.page_id, host, path, rule, coalesce(verdict, case when pattern is not null then 'block' else 'allow' end) as verdict, case when rule is null then pattern end as pattern
from m left join p using (page_id) where n = 1
""",
    "op7_warc": r"""
with d as (select page_id, octet_length(encode(coalesce(html, ''))) as payload_bytes, sha256(coalesce(html, '')) as payload_digest from pages),
     f as (select *, min(page_id) over (partition by payload_digest) as first from d)
select page_id, payload_bytes, payload_digest, case when payload_bytes >= 100 and page_id > first then 'revisit' else 'response' end as record_type,
       case when payload_bytes >= 100 and page_id > first then first end as refers_to from f
""",
    "op5_mixing": r"""
with d as (select doc_id, source, md5(coalesce(cast(doc_id as varchar), '')) as h, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as size from documents),
     s0 as (select source, cast(sum(size) as bigint) as source_size from d group by source),
     s1 as (select *, (row_number() over (order by source nulls last) - 1) % 3 as slot from s0),
     s2 as (select *, case slot when 0 then 5 when 1 then 2 else 1 end as w, source_size * 3 as top from s1),
     s3 as (select *, (sum(source_size) over () - coalesce(sum(top) over o, 0)) / (sum(w) over () - coalesce(sum(w) over o, 0)) * w > top as capped
            from s2 window o as (order by top / w, source nulls last rows between unbounded preceding and 1 preceding)),
     s4 as (select source, slot, source_size, case when capped then cast(top as double) else
              (cast(sum(source_size) over () as double) - sum(case when capped then top else 0 end) over ()) / sum(case when capped then 0 else w end) over () * w end as target from s3),
     r0 as (select d.doc_id, d.size, s4.*, sum(size) over (partition by d.source order by h, doc_id, size rows between unbounded preceding and current row) - size as start
            from d join s4 on d.source is not distinct from s4.source),
     r1 as (select *, case when source_size > 0 then cast(floor(target / source_size) as bigint) else 0 end as whole from r0),
     r2 as (select *, cast(least(greatest(floor(target) - whole * source_size - start, 0), size) as bigint) as part from r1),
     r3 as (select *, whole * size + part as taken, case when whole * size + part > 0 then whole + cast(part > 0 as bigint) else 0 end as passes, start / target as y from r2)
select doc_id, size, source_size, target, taken, passes,
       round(case when passes = 0 then null when slot = 0 then 0.0 + (sqrt(1.5 * 1.5 + 2 * -1.0 * y) - 1.5) / -1.0 when slot = 1 then y else 0.0 + (sqrt(0.5 * 0.5 + 2 * 1.0 * y) - 0.5) / 1.0 end, 9) as first_position
from r3
""",
    "op8_exact_dedup": r"""
with n as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as t from documents),
     g as (select t, min(doc_id) as keep_id, count(*) as group_size from n group by t)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(t) as text_sha256 from n join g using (t)
""",
}
