import pytest

from folio.operators import arbitration, report, scoring, semantics, sequences, structure
from folio.operators.blocks import complete, stripped

COLUMNS = ("doc_id", "pos", "text", "block_type", "style_id", "all_bold", "all_italic", "blank_before", "blank_after", "ind_left", "heading_level")
SCHEMA = "doc_id long, pos long, text string, block_type string, style_id string, all_bold boolean, all_italic boolean, blank_before boolean, blank_after boolean, ind_left int, heading_level int"
VERSE = ["Sous le pont coule la Seine,", "Et nos amours lointaines,", "Faut-il que je m'en souvienne,", "La joie venait après la peine."]
PROSE = "Ceci est un long paragraphe de prose qui compte bien plus de seize mots afin de ne jamais passer pour un vers dans la suite."


def blocks(spark, *items, doc=1):
    rows = [{"doc_id": doc, "pos": k} | ({"text": x} if isinstance(x, str) else x) for k, x in enumerate(items)]
    return spark.createDataFrame([tuple(r.get(c) for c in COLUMNS) for r in rows], SCHEMA)


def run(spark, *items, profile="conservative", heuristics=True):
    done = structure.prepare(blocks(spark, *items), scoring.thresholds(profile)[0], heuristics)
    return sorted(done.blocks.collect(), key=lambda r: r["pos"]), done


def test_stanza_between_blanks(spark):
    got, done = run(spark, PROSE, "", *VERSE, "", PROSE)
    assert [r["block_type"] for r in got] == ["paragraph", "lineated_block", "paragraph"]
    assert got[1]["text"] == "\n".join(VERSE) and got[1]["merged_from"] == ["b3", "b4", "b5", "b6"] and got[1]["semantic"]["lines"] == VERSE and got[1]["rule"] == "stanza.between_blanks"
    assert [r["after"] for r in structure.transformations(done).collect()] == ["lineated_block"]


@pytest.mark.parametrize("lines", [["- un mot", "- deux mots", "- trois mots"], ["1914 - la guerre", "1915 - encore", "1918 - la paix"], ["TITRE UN", "TITRE DEUX", "TITRE TROIS"], VERSE[:2], ["Dupont, Paris, 1998", "Durand, Lyon, 1999", "Martin, Lille, 2001"]])
def test_what_is_no_stanza(spark, lines):
    got, _ = run(spark, PROSE, "", *lines, "", PROSE)
    assert "lineated_block" not in [r["block_type"] for r in got]


def test_no_stanza_without_blanks(spark):
    df = stripped(complete(blocks(spark, PROSE, *VERSE, PROSE)))
    assert sequences.blank_bounded(df).where("stanza is not null").count() == 0


def test_scored_sequence_leaves_its_lead_out_and_is_cut_at_twenty(spark):
    df = stripped(complete(blocks(spark, "Le chœur dit :", *VERSE, *VERSE)))
    got = {r["pos"] for r in sequences.scored_sequences(df).where("verse is not null").collect()}
    assert got == set(range(1, 9))
    long = stripped(complete(blocks(spark, *[f"Une ligne courte numéro {k}," for k in range(45)])))
    sizes = sorted(r["count"] for r in sequences.scored_sequences(long).where("verse is not null").groupBy("verse").count().collect())
    assert sizes == [5, 20, 20]


@pytest.mark.parametrize("text", ["VI, I, 52", "Voir la planche", "p. 12", "- un point de liste", "Dupont, Titre, Paris, 1998", "Seul", "Mais pourtant rien", "Jean Dupont, Marie Durand et Paul Martin"])
def test_never_a_heading(spark, text):
    got, _ = run(spark, PROSE, {"text": text, "all_bold": True}, PROSE)
    assert got[1]["block_type"] != "heading" and got[1]["heading_decision"] == "ignore"


def test_headings(spark):
    got, _ = run(spark, {"text": "Un titre", "style_id": "Titre2"}, {"text": "La naissance du roman", "all_bold": True}, {"text": "PREMIÈRE PARTIE", "all_bold": None}, {"text": "déjà là", "block_type": "heading"}, PROSE)
    assert [(r["block_type"], r["heading_level"]) for r in got] == [("heading", 2), ("heading", 2), ("heading", 1), ("heading", 2), ("paragraph", None)]
    assert got[0]["rule"] == "heading.source_style" and got[1]["rule"] == "heading.bold" and got[1]["highlight"] == "structure_applied"


def test_grey_zone_is_reported(spark):
    got, done = run(spark, PROSE, "La naissance du roman", PROSE)
    assert got[1]["block_type"] == "paragraph" and got[1]["heading_score"] == 0.9 and got[1]["heading_decision"] == "diagnostic" and got[1]["highlight"] == "suspect_unhandled"
    assert [(r["category"], r["severity"]) for r in structure.diagnostics(done).collect()] == [("heading", "info")]
    explored, _ = run(spark, PROSE, "La naissance du roman", PROSE, profile="exploratory")
    assert explored[1]["block_type"] == "heading" and explored[1]["rule"] == "heading.heuristic"


def test_bibliography_section_and_other_rules(spark):
    got, _ = run(
        spark, "un début sans point et assez de mots", {"text": "Sources", "block_type": "heading"}, "Première entrée du fonds", {"text": "Jean Dupont", "all_italic": True}, {"text": "Suite", "block_type": "heading"},
        {"text": PROSE, "ind_left": 720}, {"text": PROSE, "ind_left": 360}, {"text": PROSE, "ind_left": 360}, "Dupont, Jean et autres, Paris, 1998", "« " + PROSE + " " + PROSE,
    )
    kinds = [r["block_type"] for r in got]
    assert kinds == ["paragraph", "heading", "bibliography_item", "author", "heading", "quote_block", "paragraph", "paragraph", "bibliography_item", "quote_block"]
    first, _ = run(spark, "un début sans point et assez de mots", PROSE)
    assert first[0]["block_type"] == "epigraph"


def test_deterministic_mode_keeps_to_given_facts(spark):
    got, done = run(spark, {"text": "Bibliographie", "block_type": "heading"}, "Une entrée", "", {"text": "La naissance du roman", "all_bold": True, "style_id": "Titre1"}, *VERSE, heuristics=False)
    assert [r["block_type"] for r in got] == ["heading", "bibliography_item", "heading", *["paragraph"] * 4] and done.verse is None


def test_thresholds():
    t, w = scoring.thresholds("équilibré")
    assert (t.heading_transform, t.verse_diagnostic, w) == (0.85, 0.55, [])
    t, w = scoring.thresholds("odd", heading_transform=2, verse_transform="x", verse_diagnostic=0.95)
    assert t.heading_transform == 1.0 and t.verse_transform == 0.82 and t.verse_diagnostic == 0.60 and len(w) == 4
    assert scoring.thresholds("exploratory")[0].auto_apply and not scoring.thresholds()[0].auto_apply


def test_ties_in_the_dominant_indent(spark):
    df = blocks(spark, *[{"text": "x", "ind_left": v} for v in (0, 720, 360, 360, 720, None)])
    assert [tuple(r) for r in structure.dominant_indent(df).collect()] == [(1, 720)]


def test_canonical_rows_are_valid_and_stable(spark):
    got = semantics.canonicalise(structure.prepare(blocks(spark, PROSE, "", *VERSE, "", {"text": "T", "block_type": "heading"}, {"text": "q", "block_type": "quote_block"})).blocks)
    again = semantics.canonicalise(got.withColumn("semantic", got["canonical"]).drop("canonical", "changed"))
    assert again.where("changed").count() == 0 and semantics.validate(got, "canonical").count() == 0
    roles = {r["block_type"]: r["canonical"]["role"] for r in got.collect()}
    assert roles == {"paragraph": "paragraph", "lineated_block": "lineated_block", "heading": "heading", "quote_block": "quote"}


def test_gate(spark):
    bad = blocks(spark, {"text": "sans niveau", "block_type": "heading"}).union(blocks(spark, "bien", doc=2))
    problems = semantics.validate(bad)
    assert [(r["doc_id"], r["rule"]) for r in problems.collect()] == [(1, "heading_level")]
    assert sorted((r["doc_id"], r["blocked"]) for r in semantics.gate(bad, problems).collect()) == [(1, True), (2, False)]


def test_styles(spark):
    df = blocks(spark, {"text": "T", "block_type": "heading", "style_id": "Titre3"}, {"text": "Résumé : x"}, {"text": "q", "block_type": "quote_block"}, "suite", "fin", {"text": "v", "block_type": "lineated_block"}, {"text": "o", "block_type": "odd"})
    assert [r["style"] for r in sorted(semantics.output_styles(df).collect(), key=lambda r: r["pos"])] == ["Heading 3", "TEI_abstract", "TEI_quote", "TEI_paragraph_consecutive", "Normal", "TEI_verse", "Normal"]


def test_budgets_and_replies(spark):
    assert [arbitration.budget(x) for x in (None, "balanced", "aggressive")] == [(0.90, 3), (0.85, 6), (0.75, 6)] and arbitration.budget("conservative", 1) == (0.90, 1)
    good = '{"classification": "heading", "confidence": 0.5, "reason": "r", "recommended_action": "ignore"}'
    cases = [(good, None), ("```json\n" + good + "\n```", None), ("text " + good + " text", None), ("", "empty_response"), ("nothing", "invalid_json"), ("[1]", "non_object_json"), (good.replace("heading", "x"), "unknown_classification"),
             (good.replace("ignore", "x"), "unknown_recommended_action"), (good.replace("0.5", '"a"'), "invalid_confidence_type"), (good.replace("0.5", "7"), "confidence_out_of_range")]
    df = spark.createDataFrame([(k, c) for k, (c, _) in enumerate(cases)], "k int, raw string")
    got = [r["p"]["error"] for r in df.select("k", arbitration.parse_reply(df["raw"]).alias("p")).orderBy("k").collect()]
    assert got == [e for _, e in cases]


def test_clusters_are_applied_and_refused(spark):
    df = stripped(complete(blocks(spark, PROSE, *VERSE, PROSE))).withColumn("rule", scoring.F.lit(None).cast("string"))
    merged, judged = arbitration.apply_clusters(df, level="aggressive")
    row = merged.where("block_type = 'lineated_block'").first()
    assert row["text"] == "\n".join(VERSE) and row["semantic"]["genre_hint"] == "poetry" and merged.count() == 3
    lists = lambda p: p.withColumn("reply", scoring.F.lit('{"classification": "list_item", "confidence": 1, "reason": "", "recommended_action": "transform"}'))
    merged, judged = arbitration.apply_clusters(df, lists)
    assert merged.count() == 6 and [r["reason"] for r in judged.collect()] == ["list_not_supported"]
    counts = report.refusal_reasons(judged).first()
    assert (counts["candidates"], counts["applied"], counts["refused"], counts["reasons"]) == (1, 0, 1, {"list_not_supported": 1})


def test_corrections_need_one_short_hit(spark):
    df = blocks(spark, "un mot deux", "un un", "rien")
    hints = spark.createDataFrame([(1, 0, "mot", "terme"), (1, 1, "un", "x"), (1, 2, "mot", "x")], "doc_id long, pos long, original string, replacement string")
    assert [(r["text"], r["applied"]) for r in sorted(arbitration.corrections(df, hints).collect(), key=lambda r: r["pos"])] == [("un terme deux", True), ("un un", False), ("rien", False)]


def test_report_listing(spark):
    df = spark.createDataFrame([(1, 2, "heading", "info", "b"), (1, 0, "verse", "warning", "a")], "doc_id long, pos long, category string, severity string, excerpt string")
    assert report.listing(df).first()["report"] == "[warning] verse @0: a\n[info] heading @2: b"


def test_exports_show_corrected_spans(spark):
    """Block text and inline spans get the same rewrite; century numerals are styled in the spans."""
    from pyspark.sql import types as T

    from folio.functions.spans import SPAN, STYLES
    from folio.plans.pipeline import Options, run_corpus

    plain = dict.fromkeys(STYLES, False) | {"kind": "text", "note_ref": None}
    spans = [plain | {"text": "Il dit... au "}, plain | {"text": "XIXe", "italic": True}, plain | {"text": " siècle: oui"}]
    text = "".join(s["text"] for s in spans)
    blocks = spark.createDataFrame([(1, 0, text, spans), (1, 1, "sans styles: non", None)], f"doc_id long, pos long, text string, spans {T.ArrayType(SPAN).simpleString()}")
    done = run_corpus(blocks, Options(mode="deterministic"))
    rows = {r["pos"]: r for r in done.blocks.collect()}
    joined = "".join(s["text"] for s in rows[0]["spans"])
    assert joined.lower() == rows[0]["text"].lower() == "il dit… au xixe siècle\u202f: oui" and rows[1]["text"] == "sans styles\u202f: non"
    assert [(s["text"], s["small_caps"], s["sup"], s["italic"]) for s in rows[0]["spans"] if s["small_caps"] or s["sup"]] == [("xix", True, False, True), ("e", False, True, True)]
    xml = done.tei().first()["xml"]
    assert "Il dit… au " in xml and '<hi rend="italic small-caps">xix</hi>' in xml and "siècle\u202f: oui" in xml and "sans styles\u202f: non" in xml


def test_bibliography_sections(spark):
    from folio.operators import notes

    rows = [("paragraph", "", "avant"), ("heading", "", "Sources"), ("paragraph", "", "a"), ("heading", "Titre3", "Autres"), ("paragraph", "", "b"), ("heading", "Titre1", "Suite"), ("paragraph", "", "c")]
    df = spark.createDataFrame([(1, k, *r) for k, r in enumerate(rows)], "doc_id long, pos long, block_type string, style_id string, text string")
    got = notes.bibliography(notes.bibliography_sections(df)).orderBy("pos").collect()
    assert [(r["item_id"], r["raw_text"]) for r in got] == [("bib1", "a"), ("bib2", "b")]


def test_editor_is_asked_until_enough_calls_succeed(spark):
    import json

    words = "mot " * 60
    df = spark.createDataFrame([(d, p, f"{d}.{p} {words}") for d in (1, 2) for p in range(6)] + [(1, 6, "court"), (3, 0, ""), (None, 0, words)], "doc_id long, pos long, text string")

    def call(text, before, after):
        if text[2] in "02":
            raise TimeoutError
        return json.dumps({"corrections": [{"original": text[:3], "corrected": "x", "raison": "r"}, {"original": "mot", "corrected": "mot", "raison": ""}]})

    replies = arbitration.ask_editor(arbitration.editorial_prompts(df), call, calls=3).cache()
    assert sorted((r["doc_id"], r["pos"]) for r in replies.collect()) == [(d, p) for d in (1, 2) for p in (1, 3, 4)]
    wanted = arbitration.suggestions(replies)
    done = arbitration.corrections(df, wanted.select("doc_id", "pos", "original", "replacement")).where("applied")
    assert sorted(r["text"].split()[0] for r in done.collect()) == ["x"] * 6 and wanted.count() == 6


def test_lines_of_verse_are_numbered_in_groups(spark):
    from folio.operators.structure import verse_lines

    line = "Un vers assez long pour compter,"
    df = blocks(spark, *[{"text": line}] * 4, {"text": "Une phrase " * 20}, *[{"text": line}] * 3)
    got = verse_lines(df, scoring.thresholds("exploratory")[0]).orderBy("pos").collect()
    assert [(r["pos"], r["group_id"][-3:], r["line_index"]) for r in got] == [(0, "001", 1), (1, "001", 2), (2, "001", 3), (3, "001", 4), (5, "002", 1), (6, "002", 2), (7, "002", 3)]
    assert {(r["after"], r["highlight"]) for r in got} == {("lineated_block", "exploratory_structure")}


def test_lineage_lists_what_was_given(spark):
    line = "Un vers assez long pour compter,"
    rows = [{"text": "Une phrase qui va. " * 20}, {"text": ""}, *[{"text": line}] * 4, {"text": ""}, {"text": "Fin de la chose. " * 20}, *[{"text": f"Court {k}"} for k in range(4)]]
    given = blocks(spark, *rows)
    done = structure.prepare(given, scoring.thresholds("exploratory")[0])
    got = {r["pos"]: (r["into"], r["how"]) for r in structure.lineage(given, done.blocks).collect()}
    assert got[0] == ("b1", "kept") and got[1] == (None, "removed") and got[2] == ("b3", "kept") and {got[p] for p in (3, 4, 5)} == {("b3", "merged")} and len(got) == len(rows)
    logged = structure.transformations(done).collect()
    assert any(r["merged_from"] and len(r["merged_from"]) == 4 for r in logged)
    again = structure.merge_runs(done.blocks.withColumn("run", structure.F.when(structure.F.col("pos") <= 2, 1)), "run", "again", structure.F.lit(True))
    closed = {r["pos"]: r["into"] for r in structure.lineage(given, again).collect()}
    assert {closed[p] for p in (0, 2, 3, 4, 5)} == {"b1"}  # a merge of a merge


def test_verse_lines_are_logged_and_documents_facts_are_windows(spark):
    line = "Un vers assez long pour compter,"
    given = blocks(spark, *[{"text": line}] * 4, {"text": "Une phrase " * 20, "ind_left": 360}, {"text": "Deux phrases " * 20, "ind_left": 720}, {"text": "Trois phrases " * 20, "ind_left": 360})
    logged = structure.transformations(structure.prepare(given, scoring.thresholds("exploratory")[0])).where("line_index is not null").collect()
    assert [r["line_index"] for r in sorted(logged, key=lambda r: r["pos"])] == [1, 2, 3, 4] and {r["rule"] for r in logged} == {"structure.lineated.group.annotate"}
    facts = structure.with_document_facts(given).select("dominant", "had_heading").distinct().collect()
    assert [tuple(r) for r in facts] == [(360, False)] and structure.dominant_indent(given).first()["dominant"] == 360


def test_accents_are_folded(spark):
    from folio.functions.text import fold

    row = spark.createDataFrame([("Éàç Ñ č ŝ ỹ ậ έ ё é o\u0308",)], "t string").select(fold(structure.F.col("t")).alias("t")).first()
    assert row["t"] == "eac n c s y a ε е e o"


def test_written_stages_are_counted(spark, tmp_path):
    from folio.plans.pipeline import Options, run_corpus

    done = run_corpus(spark.createDataFrame([(1, 0, "Un mot , deux."), (1, 1, "Trois.")], "doc_id long, pos long, text string"), Options(stage_path=str(tmp_path)))
    runs = {r["module"]: r for r in done.module_runs().collect()}
    assert list(runs) == ["typography", "structure", "verse", "semantics"] and runs["typography"]["summary"] == {"rows": 2, "corrections": 1} and runs["structure"]["summary"]["rows"] == 2
    assert all(r["started_at"] <= r["finished_at"] and r["status"] == "success" for r in runs.values()) and done.lineage().where("how = 'kept'").count() == 2
    assert run_corpus(spark.createDataFrame([(1, 0, "a")], "doc_id long, pos long, text string")).module_runs().count() == 0
