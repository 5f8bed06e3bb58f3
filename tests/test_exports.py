"""Notes, verse, tables and corrections through the pipeline and its exports."""

import io
import json
import zipfile
from xml.etree import ElementTree as ET

from pyspark.sql import types as T

from folio.functions import spans as S
from folio.operators import arbitration, notes, structure
from folio.plans.pipeline import Options, run_corpus
from folio.sources import docx, docx_writer, tei

ARRAY = T.ArrayType(S.SPAN).simpleString()
SCHEMA = f"doc_id long, pos long, block_type string, text string, spans {ARRAY}, table_ooxml string"
Q = f"{{{tei.NS}}}"
OOXML = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def span(text, **more):
    return {"text": text, **{f: False for f in S.STYLES}, "kind": "text", "note_ref": None} | more


def call(ref):
    return span("[1]", kind="note_call", note_ref=ref)


def paragraph(doc, pos, *spans, kind="paragraph"):
    return (doc, pos, kind, "".join(s["text"] for s in spans), list(spans), None)


def note_frame(spark, rows):
    return spark.createDataFrame(rows, f"doc_id long, note_id string, label string, text string, spans {ARRAY}")


def test_notes_reach_every_export(spark, tmp_path):
    blocks = spark.createDataFrame([paragraph(1, 0, span("Un texte"), call('a&"b'), span(" fini.", italic=True)), paragraph(1, 1, span("Sans note.")), paragraph(2, 0, span("Autre"), call("unknown"))], SCHEMA)
    given = note_frame(spark, [(1, 'a&"b', "3", "", [span("  voir "), span("Loc. cit", italic=True), call("in"), span(" & p. 3")]), (1, "in", None, "dedans.", []), (1, "in", None, "dedans.", [])])
    done = run_corpus(blocks, Options(), given)
    xml = {r["doc_id"]: ET.fromstring(r["xml"]) for r in done.tei().collect()}
    note = next(xml[1].iter(f"{Q}note"))
    assert note.get("n") == "3" and note.get(tei.XML_ID) == 'a&"b' and "".join(note.itertext()).startswith("Voir loc. cit") and "".join(note.itertext()).endswith(" & p. 3.")
    assert any("cit" in (h.text or "") for h in note.iter(f"{Q}hi")) and [n.text for n in note.iter(f"{Q}note")][1:] == ["Dedans."]
    assert not list(xml[2].iter(f"{Q}note")) and "Autre" in "".join(xml[2].itertext())
    assert next(p for p in xml[1].iter(f"{Q}p") if "Un" in (p.text or "")).find(f"{Q}hi").get("rend") == "italic"
    assert any(r"\footnote{Voir " in r["tex"] and r"\textit{" in r["tex"] for r in done.latex().collect())
    files = docx.rows(done.docx().select(S.F.col("doc_id").cast("string"), "content"))
    assert {r["text"] for r in docx.notes(files).where("doc_id = '1'").collect()} >= {"Dedans."} and any(s["italic"] for r in docx.notes(files).collect() for s in r["spans"])
    assert len(json.loads(next(r["json"] for r in done.pivot().collect() if r["doc_id"] == 1))["document"]["notes"]) == 3
    assert done.write(f"file://{tmp_path}/out") == [] and "Dedans" in spark.read.parquet(f"{tmp_path}/out/tei").where("doc_id = 1").first()["xml"]
    changed = [(r["module"], r["target"], r["rule"]) for r in done.transformations.where("target = 'a&\"b'").collect()]
    assert ("footnotes", 'a&"b', "purh.note.batch") in changed and ("typography", 'a&"b', "typography.batch") in changed


def test_call_and_quote_diagnostics(spark):
    nbsp = " "
    blocks = spark.createDataFrame(
        [paragraph(1, 0, call("n0"), span("fin."), span(""), call("n1"), span(f"mot{nbsp}"), call("n2"), call("n3"), span("x"), call("n4")), paragraph(1, 1, span("dit : «oui».")), paragraph(1, 2, span("dit : «oui»."), kind="quote_block"), (1, 3, "paragraph", "x", None, None)], SCHEMA
    )
    found = [(r["note_ref"], r["rule"], r["space_kind"]) for r in notes.call_diagnostics(blocks).orderBy("pos").collect()]
    assert found == [("n1", "R-AN-002", None), ("n2", "R-AN-003", "nbsp")]
    assert [(r["pos"], r["excerpt"]) for r in notes.quote_diagnostics(blocks).collect()] == [(1, "«oui».")]
    done = run_corpus(blocks, Options())
    assert {r["rule"] for r in done.diagnostics.collect()} >= {"R-AN-002", "R-AN-003", "R-GQ-004"}


def test_merged_stanzas_keep_styles_and_calls(spark):
    lines = [paragraph(1, 1, span("Sous le pont "), span("coule,", italic=True)), paragraph(1, 2, span("la Seine,"), call("n")), (1, 3, "paragraph", "et nos amours.", [], None)]
    blank = lambda p: (1, p, "paragraph", "", [], None)
    blocks = spark.createDataFrame([blank(0), *lines, blank(4)], SCHEMA)
    done = structure.merge_runs(structure.stripped(structure.complete(blocks)).withColumn("run", S.F.when(S.F.col("pos").between(1, 3), 1)).withColumn("rule", S.F.lit(None).cast("string")), "run", "stanza", S.F.lit(True))
    xml = tei.write(done.where("text <> ''").drop("run", "rule"), note_frame(spark, [(1, "n", None, "Une note.", [])])).first()["xml"]
    got = list(ET.fromstring(xml).iter(f"{Q}l"))
    assert ["".join(x.itertext()) for x in got] == ["Sous le pont coule,", "la Seine,Une note.", "et nos amours."] and got[0].find(f"{Q}hi") is not None and got[1].find(f"{Q}note") is not None


def test_lines_of_spans(spark):
    brk = span("\n", kind="line_break")
    df = spark.createDataFrame([([span("a"), span("b"), brk, brk, span("c")],), ([brk],), ([],), (None,)], f"spans {ARRAY}")
    got = [None if r[0] is None else [[s["text"] for s in line] for line in r[0]] for r in df.select(S.cut_lines(S.F.col("spans"))).collect()]
    assert got == [[["a", "b"], ["c"]], [], None, None]


def test_tables(spark):
    w = f'<w:tbl xmlns:w="{OOXML}">'
    cell = lambda *p: "<w:tc>" + "".join(f"<w:p><w:r><w:t>{x}</w:t></w:r></w:p>" for x in p) + "</w:tc>"
    inner = f"<w:tc><w:p/><w:tbl><w:tr>{cell('in')}</w:tr></w:tbl></w:tc>"
    tables = [f"{w}<w:tr>{cell('A &amp; B', 'c')}{cell()}</w:tr><w:tr>{inner}</w:tr></w:tbl>", f"{w}</w:tbl>", "<w:tbl", None, f"<w:tbl><w:tr>{cell('x')}</w:tr></w:tbl>"]
    blocks = spark.createDataFrame([(1, k, "table", "", [], t) for k, t in enumerate(tables)], SCHEMA)
    root = ET.fromstring(tei.write(blocks).first()["xml"])
    assert [[[c.text for c in r] for r in t] for t in root.iter(f"{Q}table")] == [[["A & B\nc", None], [None]], [["x"]]]
    assert sum("not exported" in (p.text or "") for p in root.iter(f"{Q}p")) == 3
    assert [(r["reason"], r["cells"]) for r in tei.table_diagnostics(blocks).orderBy("pos").collect()] == [(None, 3), ("no_rows", 0), ("invalid_table_ooxml", 0), ("missing_table_ooxml", 0), (None, 1)]
    assert tei.table_counts(blocks).first()[1:] == (2, 3)


def test_corrections_are_folded_in_order(spark):
    blocks = structure.complete(spark.createDataFrame([paragraph(1, 0, span("Un "), span("mot", italic=True), span(" ici.")), paragraph(1, 1, span("a a"))], SCHEMA))
    hints = spark.createDataFrame([(1, 0, 2, "Un terme ici", "Un terme là"), (1, 0, 1, "mot", "terme"), (1, 0, 3, "mot", "z"), (1, 1, 1, "a", "b"), (1, 1, 2, None, "b")], "doc_id long, pos long, k long, original string, replacement string")
    done = arbitration.corrections(blocks, hints)
    got = {r["pos"]: r for r in done.collect()}
    assert len(got) == 2 and got[0]["text"] == "Un terme là." and len(got[0]["corrected"]) == 2 and got[0]["applied"] and not got[1]["applied"] and got[1]["text"] == "a a"
    assert "".join(s["text"] for s in got[0]["spans"]) == "Un terme là." and "".join(s["text"] for s in got[0]["spans"] if s["italic"]) == "terme"
    assert [(r["before"], r["after"]) for r in arbitration.correction_changes(done).orderBy("k").collect()] == [("Un mot ici.", "Un terme ici."), ("Un terme ici.", "Un terme là.")]


def test_the_editor_is_asked_by_the_pipeline(spark, tmp_path):
    text = "Une phrase assez longue. " * 10 + "Le chat dor."

    def editor(text, before, after):
        return json.dumps({"corrections": [{"original": "dor", "corrected": "dort", "raison": "verbe"}, {"original": "chat dort", "corrected": "chien dort", "raison": "x"}]})

    done = run_corpus(spark.createDataFrame([(1, 0, text)], "doc_id long, pos long, text string"), Options(mode="heuristic", editor=editor, stage_path=str(tmp_path)))
    assert done.blocks.first()["text"].endswith("Le chien dort.") and done.transformations.where("module = 'editorial'").count() == 2
    assert "editor" not in json.loads(Options(editor=editor).to_json())
    report = done.report().first()["report"]
    assert report.startswith("diagnostics: ") and "Changed:\n- editorial | 2" in report
    assert [Options(mode=m, editor=editor).edited for m in ("heuristic", "heuristic_ai_local", "deterministic", "ai_exploratory")] == [True, True, False, False]
    assert not Options(editor=editor, editorial_ai=False).edited and not Options().edited


def test_prompts(spark):
    row = spark.createDataFrame([("a", None, 3)], "text string, before string, n int").select(arbitration.editorial_prompt(S.F.col("text"), S.F.col("before"), S.F.lit("z")).alias("e"), arbitration.cluster_prompt(S.F.col("text"), S.F.col("n")).alias("c")).first()
    assert "\nBefore: \nText: a\nAfter: z\n" in row["e"] and "raison" in row["e"] and row["c"].startswith("Candidate: 3 ") and "\na\n" in row["c"]


def test_notes_are_highlighted(spark):
    blocks = spark.createDataFrame([(1, 0, "x")], "doc_id long, pos long, text string")
    notes = spark.createDataFrame([(1, f"n{k}", f"note {k}", h) for k, h in enumerate(["footnote", "ai_structure", None, "odd"])], "doc_id long, note_id string, text string, highlight string")
    assert {r["note_id"]: r["colour"] for r in docx.note_formatting(notes).collect()} == {"n0": "bright green", "n1": None, "n2": None, "n3": None}
    archive = zipfile.ZipFile(io.BytesIO(bytes(docx_writer.write(blocks, notes).first()["content"])))
    assert archive.read("word/footnotes.xml").decode().count("<w:highlight w:val=\"green\"/>") == 1 and archive.read("word/footnotes.xml").decode().count("<w:highlight") == 1


def test_broken_files_are_rows(spark):
    def archive(document, encrypted=False):
        buffer = io.BytesIO()
        with zipfile.ZipFile(buffer, "w") as z:
            z.writestr("word/document.xml", document)
        data = bytearray(buffer.getvalue())
        if encrypted:
            for mark, at in ((b"PK\x03\x04", 6), (b"PK\x01\x02", 8)):
                data[data.find(mark) + at] |= 1
        return bytes(data)

    body = lambda inner: f'<w:document xmlns:w="{OOXML}"><w:body><w:p><w:r>{inner}<w:t>x</w:t></w:r></w:p></w:body></w:document>'
    files = [("ok", archive(body(""))), ("locked", archive(body(""), encrypted=True)), ("no id", archive(body("<w:footnoteReference/>"))), ("none", None), ("junk", b"junk")]
    raw = docx.rows(spark.createDataFrame(files, "doc_id string, content binary"))
    assert {r["doc_id"] for r in docx.errors(raw).collect()} == {"locked", "none", "junk"}
    assert {r["doc_id"]: r["text"] for r in docx.blocks(raw).collect()} == {"ok": "x", "no id": "x"}
