"""Every query of the engine against its SQL; those without SQL run and give rows."""

import duckdb
import pytest
from compare import duck, same

from leafline.queries import QUERIES, SQL


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(name, spark, sf, con):
    df = QUERIES[name](spark, sf)
    if name in SQL:
        same(df, con, SQL[name])
    else:
        assert df.count() > 0


def test_entry_points(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() == 4


def test_detector_is_right_for_nearly_all_documents(spark, sf):
    d = QUERIES["L6_detect"](spark, sf)
    assert d.where("lang = detected").count() >= 0.97 * d.count()


def test_glossary_reads_the_whole_table(spark, sf):
    states = QUERIES["G5_G6_merge_extracted_whole"](spark, sf).collect()
    customers = {r.c_custkey for r in spark.read.parquet(f"{sf}/customer.parquet").select("c_custkey").collect()}
    assert {r.idx for r in states} == customers and {r.state for r in states} == {"accepted", "conflict", "invalid"}
    assert max(r.idx for r in QUERIES["G1_G2_G20_normalise_whole"](spark, sf).collect()) > 400


def test_replay_gives_whole_values(spark, sf):
    whole = {r.conv_id * 1000 + r.turn: r.text for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()}
    got = QUERIES["S5_S6_replay_whole"](spark, sf).collect()
    assert got and all(r.value == whole[r.seq] for r in got) and any(len(r.value) > 20 for r in got)


def test_gate_reads_every_text_whole(spark, sf):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {(r.doc_id, r.prefixed): r.reading for r in QUERIES["L1_L2_gate_whole"](spark, sf).collect()}
    assert len(got) == 2 * len(docs)
    latin = [d for d, t in docs.items() if t.isascii() and sum(map(str.isalpha, t)) > 100]
    assert latin and {got[d, True] for d in latin} == {"minority"} and {got[d, False] for d in latin} == {"absent"}


@pytest.mark.parametrize("text, reading", [("Привет мир abcde", "dominant"), ("Привіт світ є", "foreign"), ("123 !", "no_letters")])
def test_gate_constants(spark, text, reading):
    from leafline.operators import language

    df = spark.createDataFrame([(text,)], "x string")
    assert df.select(language.reading(df.x, "cyrillic")).first()[0] == reading


def test_probes_reach_beyond_the_first_bytes(spark, sf):
    assert QUERIES["V23_owning_or_flanking_whole"](spark, sf).where("at >= 400 and owner is not null").count() > 0
    clamped = QUERIES["M19_active_block_whole"](spark, sf).where("progress = 1.0 and at >= 400")
    assert clamped.count() > 0


def test_requests_on_titles_that_end_within_an_entity(spark, tmp_path):
    titles = ["The&a", "Das&amp;&amp;am", "x&amp", "a > b", "R&D &eacute;", "&#84;itel"]
    spark.createDataFrame([(i, "/u", f"<html><head><title>{t}</title></head><body><p>text</p></body></html>") for i, t in enumerate(titles)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    name, con = "D7_D9_D13_D25_G9_G12_G13_requests", duckdb.connect()
    con.sql(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    same(QUERIES[name](spark, str(tmp_path)), con, SQL[name])
