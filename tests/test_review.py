"""Folds, reports, audits, presets, memories, jobs, services and the sources that feed them."""

import json
import subprocess
import time
from pathlib import Path

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quire.functions import markup
from quire.functions import text as t
from quire.operators import audit, batches, folds, jobs, memory, reports, terms, usage
from quire.plans import services, transform
from quire.sources import books, formats, glossaries, html, records


def values(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_a_key_of_a_million_rows_is_folded_in_seconds(spark):
    e = spark.range(1_000_000).select(F.lit("j").alias("k"), F.col("id").alias("n"), (F.col("id") % 7).alias("c"))
    began = time.time()
    x = usage.admitted(e, "k", ["n"], "c", 100)
    assert x.where("admitted").agg(F.sum("c")).first()[0] == 100
    assert time.time() - began < 60


def test_folds_start_anew_for_each_key(spark):
    df = spark.createDataFrame([(k, i, 1) for k in ("a", "b", None) for i in range(50)], "k string, i int, w int").repartition(3)
    got = folds.folded(df, "k", [F.col("i")], ["w"], 0, lambda s, r: (s + r[0], (s + r[0],)), "upto long")
    assert values(got.withColumn("k", F.coalesce("k", F.lit(""))), "k", "i", "upto") == sorted((k, i, i + 1) for k in ("", "a", "b") for i in range(50))
    assert folds.folded(df.limit(0), "k", [F.col("i")], ["w"], 0, lambda s, r: (s, (s,)), "upto long").count() == 0


def test_positions_are_global(spark):
    df = spark.createDataFrame([(i * 7919 % 500, i) for i in range(2000)], "a int, b int").repartition(7)
    got = [(r["a"], r["b"]) for r in folds.positions(df, "a", [F.col("b")], "n", 9).orderBy("n").collect()]
    assert got == sorted(got) and [r["n"] for r in folds.positions(df, "a", [F.col("b")], "n").orderBy("n").collect()] == list(range(1, 2001))


SOME = st.one_of(st.sampled_from(["page_12", "PAGE_3", "12.5 - 3", "#ffaa00", "color: red", ".a = b", "Note: it works!", "中文", "x", "  ", "٣٤", "a_b: ü", "Ünï: code", "page_x", "#fffffffff"]), st.text(alphabet="aZé中 1٣:=#._-%(),!\n ", max_size=12))


@settings(max_examples=20, deadline=None)
@given(st.lists(SOME, min_size=20, max_size=60))
def test_prose_of_one_value_is_that_of_columns(spark, texts):
    df = spark.createDataFrame([(x,) for x in texts], "x string")
    assert [r[0] for r in df.select(t.has_prose(F.col("x"))).collect()] == [markup.prose(x) for x in texts]


def test_blocks_need_prose():
    page = "<html><body>" + "".join(f"<p>{x}</p>" for x in ("page_12", "#ffaa00", "color: red", "Some text")) + "</body></html>"
    assert [b[2] for b in markup.blocks_of(page)] == ["Some text"]


def book(**more: bytes) -> bytes:
    files = books.entries(books.minimal_book("T", ['<p id="a">one</p>', '<p><a href="#a">two</a> <a href="c2.xhtml#zz">three</a> <a href="gone.xhtml">four</a> <a href="http://x/y">out</a><img src="i.png"/></p>']))
    items = '<item id="c2" href="c2.xhtml" media-type="application/xhtml+xml"/><item id="lost" href="lost.css" media-type="text/css"/><item id="ncx" href="toc.ncx" media-type="application/x-dtbncx+xml"/>'
    files["content.opf"] = files["content.opf"].replace(b"</manifest>", items.encode() + b"</manifest>").replace(b"</spine>", b'<itemref idref="c2"/></spine>')
    files["c2.xhtml"] = b"<html><body><p>fine</p></body></html>"
    files["toc.ncx"] = (
        b'<ncx xmlns="http://www.daisy.org/z3986/2005/ncx/"><docTitle><text>T</text></docTitle><navMap><navPoint><navLabel><text>Two</text></navLabel><content src="c2.xhtml"/></navPoint></navMap>'
        b'<pageList><pageTarget><content src="c1.xhtml#a"/></pageTarget><pageTarget><content src="c1.xhtml#nope"/></pageTarget><pageTarget><content src="c1.xhtml"/></pageTarget></pageList></ncx>'
    )
    return books.package(files | more)


def test_a_bad_chapter_loses_only_itself(spark, tmp_path):
    (tmp_path / "a.epub").write_bytes(book(**{"c2.xhtml": b"<html><body><p>broken</body>"}))
    got = books.blocks(spark, str(tmp_path)).orderBy("order", "seq").collect()
    assert [(r["file"], r["text"], bool(r["error"])) for r in got] == [("c1.xhtml", "one", False), ("c1.xhtml", "two three four out", False), ("c2.xhtml", None, True)]
    assert values(books.chapters(spark, str(tmp_path)), "order", "file", "block_count", "label") == [(1, "c1.xhtml", 2, "T"), (2, "c2.xhtml", 0, "Two")]


def test_audit_of_a_book(spark, tmp_path):
    (tmp_path / "a.epub").write_bytes(book())
    r = books.audited(spark, str(tmp_path)).first()
    assert (r["manifest_count"], r["spine_count"], r["spine_xhtml_count"], r["ncx_navpoints"], r["ncx_page_targets"], r["external_links"], r["image_count"]) == (5, 2, 2, 1, 3, 2, 0)
    assert r["missing_manifest_items"] == ["lost.css"] and r["missing_page_anchors"] == ["c1.xhtml#nope"]
    assert r["broken_internal_links"] == ["c1.xhtml: missing anchor c2.xhtml#zz", "c1.xhtml: missing href gone.xhtml"] and r["broken_resource_links"] == ["c1.xhtml: missing resource i.png"]
    assert r["issue_count"] == 5
    assert books.intact(book()) == {"zip_intact": True, "mimetype_first": True, "mimetype_stored": True, "mimetype_ok": True}


def test_later_manifest_items_replace_earlier_ones(spark):
    m = spark.createDataFrame([("b", "i", 1, "x"), ("b", "i", 2, "y"), ("b", "j", 3, "z")], "book string, id string, pos int, file string")
    assert values(audit.last_manifest(m), "id", "file") == [("i", "y"), ("j", "z")]


def test_metadata_of_a_book():
    new = books.entries(books.with_metadata(book(), "Neu & gut", "de"))
    assert b"Neu &amp; gut" in new["content.opf"] and b"Neu &amp; gut" in new["toc.ncx"] and books.read_blocks(books.package(new))[0][5] == "one"


def test_formats_become_books(spark, tmp_path):
    (tmp_path / "a.txt").write_text("First one\nstill\n\n\n<b> & second\n")
    (tmp_path / "b.html").write_text("<html><head><title>T &amp; U</title></head><body><script>x</script><p>Some text</p></body></html>")
    (tmp_path / "c.htm").write_text("<body><div>plain<br>words &amp; more</div></body>")
    (tmp_path / "d.mobi").write_bytes(b"m")
    (tmp_path / "e.xyz").write_bytes(b"?")

    def fake(source: Path, target: Path, seconds: float) -> None:
        target.write_bytes(books.minimal_book("conv", [f"<p>{source.suffix} {seconds:g} words</p>"]))

    got = {r["path"].rpartition("/")[2]: r for r in formats.as_books(spark, str(tmp_path), fake, 5).collect()}
    texts = {k: [b[5] for b in books.read_blocks(bytes(r["book"]))] for k, r in got.items() if r["book"]}
    assert texts == {"a.txt": ["First one still", "<b> & second"], "b.html": ["Some text"], "c.htm": ["plain words & more"], "d.mobi": [".mobi 5 words"]}
    assert [got[k]["conversion"] for k in sorted(texts)] == ["internal-text", "internal-html", "internal-html", "calibre"] and "unsupported" in got["e.xyz"]["error"]


def test_external_converters_fail_with_reasons(tmp_path):
    a, b = tmp_path / "a.pdf", tmp_path / "b.epub"
    with pytest.raises(ValueError, match="requires calibre"):
        formats.external(find=lambda _: None)(a, b, 1)

    def slow(*_, **k):
        raise subprocess.TimeoutExpired("x", k["timeout"])

    with pytest.raises(ValueError, match="timed out after 1 s"):
        formats.external(find=lambda _: "prog", run=slow)(a, b, 1)
    with pytest.raises(ValueError, match="failed: no"):
        formats.external(find=lambda _: "prog", run=lambda *_, **__: subprocess.CompletedProcess([], 1, "", "no"))(a, b, 1)
    assert formats.timeout_seconds("7") == 7 and formats.timeout_seconds() == 600
    with pytest.raises(ValueError):
        formats.timeout_seconds(0)


def test_output_problems(spark):
    rows = [("a.epub", "epub", False), ("a", "", True), ("a.pdf", None, False), ("a.pdf", "epub", True), ("a.zip", None, True)]
    df = spark.createDataFrame(rows, "p string, f string, bad boolean")
    assert df.where(formats.output_problem(F.col("p"), F.col("f")).isNotNull() != F.col("bad")).count() == 0


def test_fragments_without_blocks_become_one_paragraph(spark):
    df = spark.createDataFrame([("<div>a <b>b</b> &amp; c</div>",), ("<p>x</p>",)], "h string").select(html.paragraphed(F.col("h")))
    assert [r[0] for r in df.collect()] == ["<p>a b &amp; c</p>", "<p>x</p>"]


def test_json_lines_name_what_is_wrong(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": "1", "n": 2}\n\n{"id": \n[3]\n')
    x = records.parsed(records.numbered_lines(spark, str(tmp_path / "a.jsonl")), "id string, n int").orderBy("line").collect()
    assert [(r["line"], bool(r["error"])) for r in x] == [(1, False), (3, True), (4, True)] and x[1]["error"].endswith("a.jsonl:3: no JSON object")
    assert records.read_lines(spark, str(tmp_path / "a.jsonl"), "id string, n int", strict=False).collect() == [("1", 2)]
    with pytest.raises(Exception, match="a.jsonl:3"):
        records.read_lines(spark, str(tmp_path / "a.jsonl"), "id string, n int").collect()
    assert records.read_lines(spark, str(tmp_path / "none*.jsonl"), "id string").count() == 0
    (tmp_path / "m.json").write_text('[{"id": "a"}, {"id": "b"}]')
    assert values(records.read_array(spark, str(tmp_path / "m.json"), "id string"), "id") == [("a",), ("b",)]


def test_batches_are_written_in_order(spark, tmp_path):
    df = spark.createDataFrame([(b, i, f"é{i}") for b in (1, 2) for i in range(30)], "batch int, seq int, text string").repartition(5)
    records.write_ordered(df, str(tmp_path / "out"), "batch", [F.col("seq")])
    files = {p.parent.name: p.read_text() for p in (tmp_path / "out").rglob("part-*.txt")}
    assert set(files) == {"q_group=1", "q_group=2"} and [json.loads(x)["seq"] for x in files["q_group=2"].splitlines()] == list(range(30)) and "é3" in files["q_group=1"]


def test_batch_names(spark):
    m = spark.createDataFrame([(2, "a/b.c.xhtml", 1), (1, "z.xhtml", 2), (1, "z.xhtml", 1)], "rank int, file string, chunk int")
    got = batches.files(m, "file", "rank").orderBy("batch").collect()
    assert [r["input"] for r in got] == ["batches/batch_001_z_01.jsonl", "batches/batch_002_z_02.jsonl", "batches/batch_003_b.c_01.jsonl"]
    assert [r[0] for r in batches.files(m, "file", "rank").orderBy("batch").select(batches.number_of(F.col("output"))).collect()] == [1, 2, 3]
    assert batches.found(batches.files(m, "file", "rank"), 3).first()["file"] == "a/b.c.xhtml" and batches.found(batches.files(m, "file", "rank"), 9).count() == 0
    assert spark.range(1).select(batches.number_of(F.lit("x"))).first()[0] == 0


ROWS = [(1, "a", "King Oak met the Elm in the old wood.", "King Oak traf die Ulme."), (1, "b", "Elm!", "Ulme!"), (2, "a", "Elm and Oak went home together again that night", "the old and gray were again home together all that night long (")]
TERMS = [("King Oak", "König Eiche", ["Oak"]), ("Elm", "Ulme", []), ("Ash", "Esche", [])]


@pytest.fixture
def reviewed(spark):
    return spark.createDataFrame(ROWS, "batch int, row_id string, source string, target string"), spark.createDataFrame(TERMS, "term string, translation string, aliases array<string>")


def test_term_issues(reviewed):
    rows, names = reviewed
    got = values(reports.term_issues(rows, names), "batch", "row_id", "kind", "message")
    assert got == [
        (1, "a", "untranslated-source-term", "King Oak remains untranslated"), (2, "a", "missing-locked-translation", "Elm does not use locked translation Ulme"),
        (2, "a", "missing-locked-translation", "King Oak does not use locked translation König Eiche"),
    ]
    assert values(reports.person_drift(rows, names).select("row_id", F.col("details")["source"].alias("s")), "row_id", "s") == [("a", "Elm"), ("a", "King Oak")]
    fixed = reports.repaired(rows, reports.term_issues(rows, names), names).collect()
    assert [(r["row_id"], r["target"], r["changed"]) for r in fixed] == [("a", "König Eiche traf die Ulme.", True)]


def test_quality_report(reviewed, spark):
    rows, names = reviewed
    issues = reports.quality_issues(rows, names)
    assert ("person-name-drift", "nonblocking") in values(issues, "kind", "severity") and {r["batch"] for r in issues.where("kind = 'person-name-drift'").collect()} == {2}
    chapters = spark.createDataFrame([(1, "One", "f"), (2, " ", "")], "batch int, label string, file string")
    r = reports.quality_report(rows, issues, chapters).first()
    assert r["row_count"] == 3 and r["issue_count"] == issues.count() == r["blocking_count"] + r["nonblocking_count"] == r["listed"]
    assert r["worst"] == ["batch 2"] and r["chapters"] == 2 and 0 < r["untranslated_ratio"] < 1
    empty = reports.quality_report(rows.limit(0), issues.limit(0), chapters).first()
    assert empty["untranslated_ratio"] == 0 and empty["issue_count"] == 0 and empty["worst"] == [] and empty["issues"] == [] and empty["person_name_drift"] == []
    # The lists hold the issues themselves, in order, with their details.
    assert [(x["batch"], x["row_id"], x["kind"], x["message"]) for x in r["issues"]] == sorted((x["batch"], x["row_id"], x["kind"], x["message"]) for x in issues.collect())
    assert {x["details"]["source"] for x in r["person_name_drift"]} == {"Elm", "King Oak"} and all(x["kind"] == "punctuation-quote-drift" for x in r["punctuation_quote_drift"])
    assert [(x["chapter"], x["issues"], x["blocking"] + x["nonblocking"]) for x in r["worst_chapters"]] == [("batch 2", r["issue_count"], r["issue_count"])]
    both = reports.combined_report(reports.term_issues(rows, names), reports.quality_report(rows, issues, chapters), 3, 1).first()
    assert (both["status"], both["detected"], both["fixed"]) == ("failed", 3 + r["issue_count"], 1) and both["remaining"] == 3 + r["issue_count"] == len(both["issues"]) == both["blocking_remaining"] + both["nonblocking_remaining"]
    assert [x["kind"] for x in both["issues"][:3]] == [x["kind"] for x in both["glossary_issues"]] and both["quality"]["issue_count"] == r["issue_count"]
    fine = reports.combined_report(reports.term_issues(rows.limit(0), names), reports.quality_report(rows.limit(0), issues.limit(0), chapters), 0, 0).first()
    assert (fine["status"], fine["remaining"], fine["issues"]) == ("passed", 0, [])


def test_issues_leave_out_empty_details(spark):
    r = spark.range(1).select(*reports.issue(F.lit(1), F.lit("a"), "k", "blocking", F.lit("m"), x=F.lit(""), y=F.lit(None).cast("string"), z=F.lit(3))).first()
    assert r["details"] == {"z": "3"}


def test_last_source_row_counts(spark):
    target = spark.createDataFrame([(1, "a", "x"), (1, "q", "y")], "batch int, row_id string, target string")
    source = spark.createDataFrame([(1, "a", 1, "old"), (1, "a", 2, "new")], "batch int, row_id string, pos int, source string")
    assert values(reports.sourced(target, source), "row_id", "source") == [("a", "new"), ("q", "")]
    df = spark.createDataFrame([("t", "<p>h</p>"), ("", "<p>h</p>"), (None, None)], "t string, h string")
    assert [r[0] for r in df.select(reports.source_text(F.col("t"), F.col("h"))).collect()] == ["t", "h", ""]


def test_validation_report_counts_before_its_cap(spark, monkeypatch):
    monkeypatch.setattr(reports, "VALIDATION_LISTED", 3)
    every = spark.range(6).select(F.col("id").alias("batch"))
    issues = spark.createDataFrame([(1, "missing", str(i)) for i in range(5)] + [(5, "missing", "x")], "batch long, rule string, row_id string")
    r = reports.validation_report(every, every.where("batch < 5"), issues).first()
    assert (r["batch_count"], r["completed_without_issues"], r["issue_count"]) == (6, 4, 6) and r["issues"] == ["missing 1 0", "missing 1 1", "missing 1 2"]
    assert reports.progress(every, every.limit(2)).first()["completed"] == 2


def test_presets(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps({"translations": {"old wood": "Altwald", "Oak": "Eiche"}, "title_words": ["King"], "place_words": ["Vale"], "org_words": ["Guild"], "creature_words": ["Wyvern"]}))
    p = terms.preset(str(tmp_path / "p.json"))
    assert p.known == ["old wood"] and terms.preset(None) == terms.Preset() and terms.preset({"translations": 3}).translations == {}
    with pytest.raises(ValueError):
        (tmp_path / "q.json").write_text("[1]")
        terms.preset(str(tmp_path / "q.json"))
    words = {"King Oak": "title", "Oak Guild": "organization", "Guild": "person", "Vale": "place", "Wyvern": "creature", "wyvern lair": "creature", "lair": "special", "Oak Elm": "person"}
    df = spark.createDataFrame(list(words.items()), "w string, k string")
    assert df.where(terms.kind(F.col("w"), p) != F.col("k")).count() == 0
    docs = spark.createDataFrame([(1, "The wyvern of the old wood met Oak. A wyvern! King Oak, King Oak."), (2, "In the old wood a wyvern and Elm; King Oak.")], "id int, text string")
    got = {r["term"]: r for r in terms.glossary(docs, "id", "text", p).collect()}
    assert (got["old wood"]["frequency"], got["old wood"]["translation"], got["old wood"]["status"], got["old wood"]["locked"]) == (2, "Altwald", "approved", True)
    assert (got["wyvern"]["type"], got["wyvern"]["frequency"], got["wyvern"]["confidence"]) == ("creature", 3, 0.7) and got["Oak"]["confidence"] == 0.95 and got["King Oak"]["type"] == "title" and "Elm" not in got


def test_drafts_fill_pending_terms_only(spark):
    x = spark.createDataFrame([("a", "", "pending", True), ("b", "x", "pending", False), ("c", "", "approved", False), ("d", " ", None, False)], "source string, translation string, status string, locked boolean")
    drafts = spark.createDataFrame([("a", " A "), ("a", "B"), ("b", "n"), ("c", "n"), ("d", " ")], "source string, draft string")
    assert values(terms.filled(x, drafts), "source", "translation", "locked", "filled") == [("a", "A", False, True), ("b", "x", False, False), ("c", "", False, False), ("d", " ", False, False)]
    many = spark.range(95).select(F.col("id").alias("pos"), F.format_string("t%03d", "id").alias("source"), F.lit("").alias("translation"), F.lit("pending").alias("status"))
    assert sorted(r["count"] for r in terms.to_fill(many, "pos").groupBy("group").count().collect()) == [15, 40, 40]


def test_glossary_round_trips(spark, tmp_path):
    (tmp_path / "g.csv").write_text('source,translation,type,aliases,frequency,evidence,status,confidence,locked\nOak & <b>,Eiche,person,"Oa; Ok",3,"x | y",approved,0.95,true\nElm,Ulme,place,,2,,pending,0.50,false\n')
    (tmp_path / "a.md").write_text("| Term | Source | Target | Aliases |\n| --- | --- | --- | --- |\n| 1 | Oak | Eiche | Oa, Ok |\n- Ash -> Esche (7, place, confidence 0.95)\n- Fir (2, special, confidence 0.10)\n- No pending candidates.\n")
    (tmp_path / "b.md").write_text("no table here | at all\n| Elm | Ulme |\n- Yew\n")
    csv = glossaries.read(spark, str(tmp_path / "g.csv"))
    body = "".join(r[0] for r in glossaries.tbx(csv).collect())
    (tmp_path / "g.tbx").write_text(f"<martif><text><body>{body}</body></text></martif>")
    keep = ("source", "translation", "type", "aliases", "status", "confidence", "locked")
    assert values(glossaries.read(spark, str(tmp_path / "g.tbx")), *keep) == values(csv, *keep)
    md = glossaries.read_markdown(spark, str(tmp_path / "*.md"))
    assert values(md, "source", "translation", "frequency", "type", "status") == [("Ash", "Esche", 7, "place", "approved"), ("Fir", "", 2, "special", "pending"), ("Oak", "Eiche", 0, "special", "pending"), ("Yew", "", 0, "special", "pending")]
    assert md.where("source = 'Oak'").first()["aliases"] == ["Oa", "Ok"]


def test_memories_are_imported(spark, tmp_path):
    one = {"source_text": "Hello", "translated_html": "<p>Hallo</p>"}
    (tmp_path / "a.json").write_text(json.dumps({"segments": {"k": one | {"source_hash": "k"}, "l": {"translated_html": " "}}}))
    (tmp_path / "b.jsonl").write_text(json.dumps(one) + "\n" + json.dumps(one | {"translated_html": "later", "target_language": "de"}) + "\n")
    (tmp_path / "c.json").write_text(json.dumps([one | {"confidence": 0.5, "updated_at": "2020-01-02T03:04:05Z"}, 7]))
    (tmp_path / "d.jsonl").write_text(json.dumps(one) + "\n7\n")
    none = spark.createDataFrame([], memory.SCHEMA)
    after, counts = memory.imported(none, memory.read(spark, str(tmp_path / "a.json")), "p", "fr")
    assert tuple(counts.first()) == (1, 1) and values(after, "source_hash", "target_language", "source_project", "confidence") == [("k", "fr", "p", 1.0)]
    after, counts = memory.imported(after, memory.read(spark, str(tmp_path / "b.jsonl")), "p", "fr")
    assert counts.first()["imported"] == 2 and values(after, "translated_html") == [("<p>Hallo</p>",), ("later",)]
    assert memory.stats(after).first()["segment_entries"] == 2
    # What is no object is dropped from a list, and skipped as an entry of JSON Lines; a time that is told is kept.
    after_list, counts = memory.imported(none, memory.read(spark, str(tmp_path / "c.json")), "p", "fr")
    assert tuple(counts.first()) == (1, 0) and str(after_list.first()["updated_at"]) == "2020-01-02 03:04:05"
    _, counts = memory.imported(none, memory.read(spark, str(tmp_path / "d.jsonl")), "p", "fr")
    assert tuple(counts.first()) == (1, 1)
    memory.exported(after, str(tmp_path / "out"))
    again, _ = memory.imported(none, memory.read(spark, str(tmp_path / "out" / "part-*.json")), "p", "fr")
    assert values(again, "source_hash", "translated_html") == values(after, "source_hash", "translated_html")


def test_job_states(spark, tmp_path):
    for name, content in {"a": {"job_id": "a", "status": "running", "filename": "f", "target_language": "de", "last_active_at": "2", "api_key": "k"}, "b": {"job_id": "b", "status": "completed", "filename": "f", "target_language": "de", "last_active_at": "3"}, "c": {"status": "x"}}.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "job.json").write_text(json.dumps(content, indent=1))
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "job.json").write_text("{broken")
    got = jobs.scan(spark, str(tmp_path))
    assert values(got, "job_id", "status", "output_format", "total_batches") == [("a", "failed", ".epub", 0), ("b", "completed", ".epub", 0)]
    listed = jobs.public(jobs.by_activity(got, "last_active_at", "job_id")).collect()
    assert [r["job_id"] for r in listed] == ["b", "a"] and [r["has_api_key"] for r in listed] == [False, True] and "work_dir" not in listed[0].asDict()
    jobs.saved(got, str(tmp_path / "saved"))
    assert spark.read.json(str(tmp_path / "saved")).count() == 2


def test_lifecycle(spark):
    log = spark.createDataFrame(
        [("j", 1, 0, "created"), ("j", 2, 1, "batch-started"), ("j", 3, 2, "batch-started"), ("j", 4, 1, "batch-completed"), ("j", 5, 3, "batch-started"), ("j", 6, 3, "batch-failed"), ("j", 7, 3, "batch-failed"), ("k", 1, 1, "batch-started"), ("k", 2, 0, "completed"), ("k", 3, 0, "packaging")],
        "job string, n int, batch int, type string",
    )
    assert values(jobs.in_flight(log, "job", "batch", "n", "type"), "job", "batch", "current") == [("j", 2, True)]
    assert values(jobs.failed_batches(log, "job", "batch", "n", "type"), "job", "batch", "at") == [("j", 3, 6)]
    assert values(jobs.folded_status(log, "job", "n", "type"), "job", "status", "stage") == [("j", "running", "translate"), ("k", "completed", "package")]
    pages = [[r[0] for r in jobs.page(spark.range(60), [F.col("id")], n).collect()] for n in (1, 3, 9)]
    assert pages == [list(range(25)), list(range(50, 60)), list(range(50, 60))]


def test_settings():
    s = services.Settings(provider="openai", max_concurrency="99", request_timeout=None, max_retries="x", budget_limit=-3, api_key="k")
    assert (s.max_concurrency, s.request_timeout, s.max_retries, s.budget_limit) == (8, 300, 2, 0) and "api_key" not in s.public() and s.public()["has_api_key"]
    assert services.Settings(provider="fake", api_key="k").api_key == "" and services.loaded("{") == services.loaded(None) == {}
    stored = {"provider": "openai", "base_url": "u", "api_key": "k", "model": "m"}
    assert services.merged({"model": ""}, stored).api_key == "k" and services.merged({"base_url": "v"}, stored).api_key == "" and services.merged({"model": ""}, stored).model == "m"
    plan = lambda p, n, a=True: services.execution(services.Settings(provider=p, max_concurrency=5), n, a)
    assert [(x.max_concurrency, x.request_timeout) for x in (plan("ollama", 1), plan("deepl", 1), plan("openai", 8000), plan("openai", 7999), plan("openai", 1, False))] == [(1, 900), (4, 300), (2, 600), (3, 480), (5, 300)]
    with pytest.raises(ValueError, match="model"):
        services.validated(services.Settings(provider="openai", base_url="u"))
    with pytest.raises(ValueError, match="hand one in"):
        services.transform_for(services.Settings(provider="deepl", api_key="k"))
    with pytest.raises(ValueError, match="unknown"):
        services.Settings(provider="nobody")


def test_limiter_waits_with_its_own_clock():
    now, slept = [0.0], []

    def sleep(s):
        slept.append(s)
        now[0] += s

    x = services.Limiter(2, 100, lambda: now[0], sleep)
    assert [x.acquire(10), x.acquire(10)] == [0, 0]
    now[0] = 20
    assert x.acquire(10) == 40 and x.acquire(95) == 60 and slept == [40, 60]
    now[0] += 61
    assert x.acquire(500) == 60  # larger than a window: it passes after a reset


def test_chat_through_a_transport():
    seen = {}

    def carry(address, headers, payload, seconds):
        seen.update(address=address, headers=headers, payload=payload, seconds=seconds)
        return {"choices": [{"message": {"content": '```json\n{"rows": [{"id": "1", "translated_html": "<p>ja</p>"}]}\n```'}}]}

    s = services.Settings(provider="openai", base_url="http://h/v1/", model="m", api_key="k", structured=True, target_language="German")
    out = services.transform_for(s, transport=carry)(pd.DataFrame({"id": ["1"], "source_html": ["<p>yes</p>"]}))
    assert out.to_dict("list") == {"id": ["1"], "translated_html": ["<p>ja</p>"]} and seen["address"] == "http://h/v1/chat/completions" and seen["payload"]["response_format"] and "German" in seen["payload"]["messages"][0]["content"]
    assert services.reply_text({"output": [{"content": [{"text": "a"}]}]}) == services.reply_text({"content": [{"text": "a"}]}) == services.reply_text({"output_text": "a"}) == "a"


def test_long_rows_are_cut_and_put_together(spark):
    long = "word and more. " * 1000
    rows = spark.createDataFrame([(1, 1, "a", f'<p id="x">{long}</p>'), (1, 2, "b", "<p>short</p>")], "batch long, seq int, id string, source_html string")
    sizes = []

    def upper(part: pd.DataFrame) -> pd.DataFrame:
        if part["source_html"].str.len().sum() > 3000:
            raise RuntimeError("too long")
        sizes.append(len(part))
        return pd.DataFrame({"id": part["id"], "translated_html": part["source_html"].str.replace("word", "WORD")})

    out = {r["id"]: r for r in transform.transformed(rows, upper, retries=0, limit=2500).collect()}
    assert out["a"]["error"] is None and out["a"]["translated_html"] == f'<p id="x">{long.replace("word", "WORD")}</p>' and out["b"]["translated_html"] == "<p>short</p>"


def test_advice_for_every_code(spark):
    codes = {c for _, c, *_ in usage.LADDER} | {"output-build-failed", "unexpected-error"}
    df = spark.createDataFrame([(c,) for c in codes], "c string").select(usage.advised(F.col("c")).alias("x"))
    assert set(usage.ADVICE) == codes and df.where("x.title IS NULL").count() == 0


def test_titles(spark):
    df = spark.createDataFrame([(" ", "", "a/b.c.epub", "French"), ("M", "G", "x", "zh"), ("", "G", "x", "zh"), ("", "", "x.epub", "Simplified Chinese")], "m string, g string, f string, l string")
    assert [r[0] for r in df.select(jobs.title(*map(F.col, "mgfl"))).collect()] == ["b.c (French)", "M", "G", "x（简体中文版）"]
    df = spark.createDataFrame([("Simplified Chinese",), ("zh-CN",), ("Japanese",), ("日本語",), ("it",), ("",), (None,)], "l string")
    assert [r[0] for r in df.select(jobs.language_code(F.col("l"))).collect()] == ["zh", "zh", "ja", "ja", "it", "zh", "zh"]


def test_stored_glossaries(spark, tmp_path):
    (tmp_path / "t.json").write_text(json.dumps([{"source": "Oak", "translation": "a"}, {"source": "Oak", "translation": "b"}, {"source": "The"}]))
    (tmp_path / "bad.json").write_text("{")
    assert values(glossaries.stored(spark, str(tmp_path / "t.json")), "source", "translation") == [("Oak", "a")]
    assert glossaries.stored(spark, str(tmp_path / "none.json")).count() == glossaries.stored(spark, str(tmp_path / "bad.json")).count() == 0
    assert glossaries.stored(spark, str(tmp_path / "none.json"), lambda: spark.range(3)).count() == 3


def test_command_line(spark, tmp_path):
    from quire.__main__ import main

    (tmp_path / "a.epub").write_bytes(books.minimal_book("T", ["<p>one</p>", "<p>two</p>"]))
    main(["audit", str(tmp_path / "a.epub"), str(tmp_path / "audit")])
    assert spark.read.json(str(tmp_path / "audit")).first()["issue_count"] == 0
    rows = [{"id": f"c1.xhtml::{i:04d}", "translated_html": f"<p>{x}</p>"} for i, x in ((1, "eins"), (2, "zwei"))]
    (tmp_path / "new.jsonl").write_text("\n".join(map(json.dumps, rows)))
    main(["apply", str(tmp_path / "a.epub"), str(tmp_path / "new.jsonl"), str(tmp_path / "b.epub"), "--title", "U"])
    assert [b[5] for b in books.read_blocks((tmp_path / "b.epub").read_bytes())] == ["eins", "zwei"]
    source = [{"batch": 1, "pos": i, "id": str(i), "source_html": "<p>x</p>"} for i in range(3)]
    target = [{"batch": 1, "pos": i, "id": str(i), "translated_html": "<div>x</div>" if i else "<p>y</p>"} for i in range(3)]
    for name, rows in (("s", source), ("t", target)):
        (tmp_path / f"{name}.jsonl").write_text("\n".join(map(json.dumps, rows)))
    main(["validate", str(tmp_path / "s.jsonl"), str(tmp_path / "t.jsonl"), str(tmp_path / "v")])
    assert spark.read.json(str(tmp_path / "v/report")).first()["issue_count"] == 2
    (tmp_path / "m.json").write_text(json.dumps([{"source_text": "a", "translated_html": "b"}]))
    main(["memory", str(tmp_path / "m.json"), str(tmp_path / "mem")])
    assert spark.read.parquet(str(tmp_path / "mem")).count() == 1
