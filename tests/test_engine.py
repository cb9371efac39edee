"""The engine end to end with providers that keep, break and lose things; sources and streaming."""

import json

import pytest
from pyspark.sql import functions as F

from leafline.operators import blocks, packing
from leafline.plans import engine
from leafline.sources import files, log, profile
from leafline.streaming import ingest

TEXT = "# T\n\npara [l](u)\n\n- a\n- b\n\n| a |\n|--|\n| 1 |\n"
SCHEMA = "doc_id long, text string, format string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(1, TEXT, "markdown"), (2, None, "markdown"), (3, "<p>a &amp; b<p>c", "html"), (4, "", "html")], SCHEMA)


def texts(out):
    return {r.doc_id: r.text for r in out["document"].collect()}


def test_echo_gives_documents_back(docs):
    out = engine.run(docs)
    assert texts(out) == {1: TEXT, 2: "", 3: "<p>a &amp; b<p>c", 4: ""}
    assert {r.doc_id: r.translated for r in out["summary"].collect()} == {1: 5, 3: 2}


def test_changed_destination_falls_back(docs):
    change = lambda payloads, kinds: [p.replace("para [l](u)", "PARA [l](v)") for p in payloads]
    out = engine.run(docs, engine.Options(unit_retries=1), change)
    assert texts(out)[1] == TEXT
    assert {(r.rejected_by, r.attempt) for r in out["attempts"].where("status <> 'translated'").collect()} == {("inline", 1), ("inline", 2)}
    assert out["summary"].where("doc_id = 1").first().fallback_source == 1


def test_good_translations_move_offsets(docs):
    up = lambda payloads, kinds: [p.replace("para", "längerer Absatz") for p in payloads]
    out = engine.run(docs, translator=up)
    assert texts(out)[1] == TEXT.replace("para", "längerer Absatz")
    row = out["alignment"].where("doc_id = 1 and source_block_id = 'li-0003'").first()
    assert texts(out)[1].encode()[row.target_range["start"] : row.target_range["end"]] == b"- a"


def test_lost_results_fall_back(docs):
    out = engine.run(docs, engine.Options(unit_retries=0), lambda payloads, kinds: list(payloads)[:-1])
    assert texts(out)[1] == TEXT
    assert out["attempts"].where("rejected_by = 'schema'").count() >= 1


def test_cache_answers_and_equal_units_are_sent_once(spark, tmp_path):
    docs = spark.createDataFrame([(i, "# same\n", "markdown") for i in range(5)], SCHEMA)
    out = engine.run(docs)
    assert out["attempts"].count() == 1
    again = engine.run(docs, translator=lambda p, k: 1 / 0, known=out["entries"])
    assert set(texts(again).values()) == {"# same\n"}


def test_requests_carry_prompt_glossary_context_and_reasons(spark, tmp_path):
    p = profile.load('slug = "s"\nversion = "7"\n[system]\nprompt = "From {{source_language}} to {{target_language}}."\n[[glossary]]\nsource = "Para"\ntarget = "Absatz"\n[[glossary]]\nsource = "para"\ntarget = "Stelle"\nsections = ["t"]\n')
    log_ = str(tmp_path / "requests")

    def provider(request):
        with open(log_, "a") as f:
            f.write(json.dumps([request.system, request.instruction, request.prompt, request.source_language, request.target_language]) + "\n")
        return [u["payload"].replace("para", "Stelle") if u["reason"] else "# broken" if u["kind"] == "paragraph" else u["payload"] for u in request.units]

    docs = spark.createDataFrame([(1, "para zero\n\n# T\n\npara [l](u)\n", "markdown")], SCHEMA)
    out = engine.run(docs, engine.Options(source_language="en", target_language="de", profile=p), provider=provider)
    assert texts(out) == {1: "Stelle zero\n\n# T\n\nStelle [l](u)\n"}
    seen = [json.loads(x) for x in open(log_)]
    assert {(s[0], *s[3:]) for s in seen} == {("From en to de.", "en", "de")} and "rejected" in seen[-1][1] and "rejected" not in seen[0][1]
    first, again = ({u["unit_id"]: u for u in json.loads(s[2])["units"]} for s in (seen[0], seen[-1]))
    assert json.loads(first["p-0001"]["terms"])[0]["target"] == "Absatz" and json.loads(first["p-0003"]["terms"])[0]["target"] == "Stelle"
    assert first["p-0003"]["context"]["preceding_kind"] == "heading-1" and "reason" not in first["p-0003"]
    assert set(again) == {"p-0001", "p-0003"} and again["p-0003"]["rejected_by"] == "fragment"
    assert {(r.profile, r.source_language) for r in out["entries"].collect()} == {("s@7", "en")}
    # each axis keeps old answers from being taken
    never = lambda request: 1 / 0
    assert texts(engine.run(docs, engine.Options(source_language="en", target_language="de", profile=p), provider=never, known=out["entries"])) == texts(out)
    for other in (engine.Options(source_language="fr", target_language="de", profile=p), engine.Options(source_language="en", target_language="de", profile=p, provider="x"), engine.Options(source_language="en", target_language="de")):
        with pytest.raises(engine.ProviderError):
            engine.run(docs, other, provider=never, known=out["entries"])


def test_transient_errors_pass_and_fatal_ones_keep_progress(spark, tmp_path):
    def flaky(request):
        mark = tmp_path / str(abs(hash(request.prompt)))
        if not mark.exists():
            mark.touch()
            raise engine.Transient("busy", 1)
        return [u["payload"] for u in request.units]

    docs = spark.createDataFrame([(1, "one\n", "markdown"), (2, "two\n", "markdown")], SCHEMA)
    assert engine.run(docs, engine.Options(unit_retries=0), provider=flaky)["attempts"].where("status = 'translated'").count() == 2

    def always(request):
        raise engine.Transient("busy", 0)

    out = engine.run(docs, engine.Options(unit_retries=0, transient_retries=1), provider=always)
    assert texts(out) == {1: "one\n", 2: "two\n"} and {r.reason for r in out["attempts"].collect()} == {"transient: busy"}

    def half(request):
        return [u["payload"] if "one" in u["payload"] else 1 / 0 for u in request.units]

    with pytest.raises(engine.ProviderError) as e:
        engine.run(docs, provider=half)
    assert [r.translated for r in e.value.entries.collect()] == ["one\n"] or [r.translated for r in e.value.entries.collect()] == ["one"]
    many = engine.run(docs, engine.Options(unit_retries=0), translator=lambda p, k: [*p, "more"])
    assert {r.rejected_by for r in many["attempts"].collect()} == {"provider"}


def test_link_definitions_count_in_units_and_documents(spark):
    from leafline.operators import validate

    text = "see [the x][a] here\n\n[a]: http://x\n[b]: http://y\n"
    docs = spark.createDataFrame([(1, text, "markdown")], SCHEMA)
    swap = lambda payloads, kinds: [p.replace("[a]", "[b]") for p in payloads]
    out = engine.run(docs, engine.Options(unit_retries=0), swap)
    assert texts(out) == {1: text} and out["attempts"].first().reason == "destinations differ"
    free = profile.Profile(preserve_urls=False)
    assert texts(engine.run(docs, engine.Options(unit_retries=0, profile=free), swap)) == {1: text.replace("x][a]", "x][b]")}
    code = profile.Profile(preserve_code_identifiers=True)
    docs = spark.createDataFrame([(1, "call `f` now\n", "markdown")], SCHEMA)
    rename = lambda payloads, kinds: [p.replace("`f`", "`g`") for p in payloads]
    assert texts(engine.run(docs, engine.Options(unit_retries=0, profile=code), rename)) == {1: "call `f` now\n"} and texts(engine.run(docs, engine.Options(unit_retries=0), rename)) == {1: "call `g` now\n"}
    assert validate.gate_fault("a [l](u)\n", "a [l](v)\n", "markdown") == (0, "destinations differ") and validate.gate_fault("a [l](u)\n", "a [l](v)\n", "markdown", False) is None
    assert "definition of" in validate.gate_fault("a\n\n[k]: http://x\n", "a\n\n[k]: http://z\n", "markdown")[1]


def test_warnings_are_cut_by_bytes(spark):
    from leafline.operators import validate

    df = spark.createDataFrame([(["é" * 600, "x" * 600, "a" + "日" * 300, "🙂" * 200, "ok"],)], "w array<string>")
    got = df.select(validate.bounded_warnings(F.col("w")).alias("w")).first().w
    assert got == ["é" * 256, "x" * 512, "a" + "日" * 170, "🙂" * 128, "ok"]


def test_packing_is_linear(spark):
    assert packing.batches([5, 5, 5, 20, 1, 1], [0] * 6, 10, 2) == [0, 0, 1, 2, 3, 3]
    df = spark.range(60_000).select(F.lit(1).alias("d"), "id", F.lit(10).alias("c"))
    assert packing.pack(df, "d", "id", "c", 100, 32).agg(F.max("batch")).first()[0] == 5999


def test_gate_hard(docs, monkeypatch):
    from leafline.operators import validate

    monkeypatch.setattr(validate, "verdicts", lambda units, results: units.join(results, ["doc_id", "unit_id"]).select("doc_id", "unit_id", F.lit("translated").alias("status"), F.col("translated").alias("accepted"), F.lit(None).cast("string").alias("rejected_by"), F.lit(None).cast("string").alias("reason"), F.col("translated").alias("answer")))
    split = lambda payloads, kinds: [p.replace("para", "p\n\nq") for p in payloads]
    with pytest.raises(engine.GateError):
        engine.run(docs, engine.Options(full_reparse_failure="hard"), split)
    assert texts(engine.run(docs, engine.Options(), split))[1] == TEXT


def test_html_is_sent_as_segments(docs):
    seen = []
    out = engine.run(docs.where("doc_id = 3"), translator=lambda payloads, kinds: [p.replace("a & b", "x < y") for p in payloads])
    assert texts(out)[3] == "<p>x &lt; y<p>c"
    out = engine.run(docs.where("doc_id = 3"), engine.Options(unit_retries=0), lambda payloads, kinds: ['["one", "two"]' for _ in payloads])
    assert texts(out)[3] == "<p>a &amp; b<p>c" and out["attempts"].first().rejected_by == "per_kind" and not seen


def test_gate_finds_structure_and_gaps():
    from leafline.operators import validate

    assert validate.gate_fault("# a\n\nb", "# a\n\nc", "markdown") is None
    assert validate.gate_fault("# a\n\nb", "# a\n\n- c", "markdown")[0] == 1
    assert validate.gate_fault("<p>a</p> <p>b</p>", "<p>a</p>  <p>b</p>", "html")[1] == "bytes between blocks differ"
    assert validate.gate_fault("<p>a</p>", "<p><b>a</b></p>", "html")[1] == "tags differ"
    assert validate.definition_change("[a]: http://x\n", "[a]: http://y\n") == "a"


def test_prompts_and_answers(spark):
    from leafline.operators import prompt

    units = spark.createDataFrame([(1, 0, 1, "p-0002", "paragraph", 'say "é"', None, "markdown"), (1, 0, 0, "t-0001.w01", "table", "x", "c", "html")], "doc_id long, batch long, ord int, unit_id string, kind string, payload string, context string, spelling string")
    got = json.loads(prompt.user_prompt(units, ["doc_id", "batch"], "ord").first().prompt)["units"]
    assert [u["unit_id"] for u in got] == ["t-0001.w01", "p-0002"] and got[1]["payload"] == 'say "é"' and "context" not in got[1]
    assert prompt.facts(units, ["doc_id"]).first()[1:] == (True, True)
    answers = spark.createDataFrame([(1, '{"units":[{"unit_id":"a","translated_payload":"b"}]}'), (2, "no json")], "batch long, text string")
    assert {(r.batch, r.unit_id, r.translated) for r in prompt.answers(answers, ["batch"], "text").collect()} == {(1, "a", "b"), (2, None, None)}
    assert prompt.terms(spark.createDataFrame([(1, '{"terms":[{"source":"s","target":"t"}]}')], "batch long, text string"), ["batch"], "text").first().source == "s"
    assert units.select(prompt.json_body(F.col("payload")).alias("b")).where("b like 'say%'").first().b == 'say \\"é\\"'


def test_empty_corpus(spark):
    out = engine.run(spark.createDataFrame([], SCHEMA))
    assert out["document"].count() == out["alignment"].count() == 0


def test_rejects(spark):
    docs = spark.createDataFrame([(1, "<div>" * 600, "html"), (2, None, "html"), (3, "x" * 50, "markdown")], SCHEMA)
    assert {(r.doc_id, r.reason) for r in blocks.rejects(docs, 40).collect()} == {(1, "oversize"), (2, "null"), (3, "oversize")}
    assert {(r.doc_id, r.reason) for r in blocks.rejects(docs).collect()} == {(1, "nesting"), (2, "null")}


def test_render_is_balanced(docs):
    out = engine.run(docs)
    pane = {r.doc_id: r.pane for r in engine.render(out["blocks"], out["alignment"]).collect()}
    assert pane[3].count("</p>") == 2 and 'data-sync-id="p-0001"' in pane[3]


def test_row_windows(spark):
    table = "| h |\n|---|\n" + "".join(f"| row {i} |\n" for i in range(30))
    units = spark.createDataFrame([(1, "t-0001", "table", table), (1, "p-0002", "paragraph", "x")], "doc_id long, unit_id string, kind string, payload string")
    got = packing.split_tables(units, 90).orderBy("window_index").collect()
    windows = [r for r in got if r.parent]
    assert len(windows) > 1 and all(r.payload.startswith("| h |\n|---|\n") for r in windows)
    assert sum(r.payload.count("row") for r in windows) == 30


def test_oversize_tables_go_in_windows_and_come_back_whole(spark):
    table = "| h |\n|---|\n" + "".join(f"| row {i} |\n" for i in range(30))
    docs = spark.createDataFrame([(1, "# t\n\n" + table + "\nend\n", "markdown")], SCHEMA)
    sizes = []
    out = engine.run(docs, engine.Options(output_tokens=160, unit_retries=0), lambda payloads, kinds: [p.replace("row", "Zeile") for p in payloads])
    assert texts(out)[1] == "# t\n\n" + table.replace("row", "Zeile") + "\nend\n"
    assert out["attempts"].where("unit_id like 't-0002.w%'").count() > 1 and not sizes
    lose = lambda payloads, kinds: ["| broken" if "row 29" in p else p.replace("row", "Zeile") for p in payloads]
    out = engine.run(docs, engine.Options(output_tokens=160, unit_retries=0), lose)
    assert "Zeile 0" in texts(out)[1] and "row 29" in texts(out)[1]
    assert out["alignment"].where("source_block_id = 't-0002'").first().fallback_status == "partially_translated"


def test_sections_share_batches():
    assert packing.pack_sections([[1, 1], [1], [9, 9, 9], [], [1]], 10, 3) == [[(0, 0), (0, 1), (1, 0)], [(2, 0)], [(2, 1)], [(2, 2)], [(4, 0)]]


def test_files(spark, tmp_path):
    (tmp_path / "a.md").write_text("# x")
    (tmp_path / "b.md").write_text("\n<!-- c -->\n<!DOCTYPE html><p>x")
    (tmp_path / "c.md").write_bytes(b"\xff\xfe")
    (tmp_path / "d.md").write_text("y" * 100)
    good, bad = files.read_documents(spark, str(tmp_path), cap=60)
    assert sorted(r.format for r in good.collect()) == ["html", "markdown"]
    assert sorted(r.reason for r in bad.collect()) == ["not_utf8", "oversize"]


def test_log(spark, tmp_path):
    lines = [json.dumps({"t": t, "key": k, "seq": s, "value": v, "status": "translated"}) for t, k, s, v in [("entry", "a", 1, "x"), ("entry", "a", 3, "y"), ("entry", "b", 2, "z"), ("evict", "b", 4, None)]]
    (tmp_path / "log").write_text("\n".join([*lines, '{"t": "ent']))
    assert [(r.key, r.value) for r in log.replay(log.read(spark, str(tmp_path / "log"))).collect()] == [("a", "y")]
    assert log.skipped(log.read(spark, str(tmp_path / "log"))).first().skipped == 1
    log.compact(spark, str(tmp_path / "log"), str(tmp_path / "new"))
    assert log.replay(log.read(spark, str(tmp_path / "new"))).count() == 1
    assert log.needs_compaction(1, 1, 10, 0, False) and not log.needs_compaction(2, 1, 10, 5, False)


def test_profile(spark):
    p = profile.load('slug = "s"\nodd = 1\n[system]\nprompt = "p"\nprompt_html = "h"\n[batching]\nmax_units_per_batch = 0\n[[glossary]]\nsource = "a"\ntarget = "b"\nsections = ["S"]\n')
    assert p.max_units_per_batch is None and len(p.warnings) == 2 and profile.prompt_for(p, "html") == "h"
    assert profile.glossary_table(spark, p).first().scope == "section"
    p = profile.load('system = 1\n[batching]\nmax_units_per_batch = "many"\noutput_expansion_factor = true\nextra = 2\n[constraints]\npreserve = 1\n')
    assert p.max_units_per_batch is None and p.output_expansion_factor is None and len(p.warnings) == 5
    with pytest.raises(profile.ProfileError):
        profile.load("=")
    assert profile.default().slug == "default"


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text(json.dumps({"doc_id": 1, "text": TEXT, "format": "markdown"}) + "\n")
    stream = ingest.block_stream(spark, str(tmp_path / "in"))
    q = ingest.to_cache(stream, str(tmp_path / "cache"), str(tmp_path / "cp"), "block_id", "payload").start()
    q.processAllAvailable()
    q.stop()
    seqs = [r.seq for r in ingest.replayed(spark, str(tmp_path / "cache")).collect()]
    assert len(set(seqs)) == len(seqs) == 5
    assert {r.key for r in ingest.replayed(spark, str(tmp_path / "cache")).collect()} == {"h1-0001", "p-0002", "li-0003", "li-0004", "t-0005"}
