import random
from difflib import SequenceMatcher

from folio.functions import spans as S
from folio.functions import typography
from folio.plans import registry
from folio.sources import tei

PLAIN = {f: False for f in S.STYLES} | {"kind": "text", "note_ref": None}


def span(text, **more):
    return {"text": text} | PLAIN | more


def test_regions():
    assert S.regions("mot , suite", "mot, suite") == [] and S.regions("a b", "a b") == [] and S.regions(None, "ab") == [(0, 2)]
    assert S.regions("un cas: oui", "un cas : oui") == [(6, 7)] and S.regions("a...b...c", "a…b…c") == [(1, 4)]


def test_steps_of_long_texts_are_those_of_the_table():
    r = random.Random(5)
    for k in range(60):
        before = "".join(r.choice("ab" if k % 3 == 0 else "abcdefgh , .") for _ in range(r.randrange(200, 900)))
        after = "".join(r.choice(["", c, c + "x", "é"]) if r.random() < 0.05 else c for c in before)
        assert S._steps(before, after) == SequenceMatcher(None, before, after, autojunk=False).get_opcodes()


def test_queries_see_whole_lines(spark, tmp_path):
    line = "de mot " * 30 + "mot, puis. " * 12 + "le de fin"
    spark.createDataFrame([(1, line + "\nx, y"), (2, "rien")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = registry.queries()["span_centuries"](spark, str(tmp_path)).collect()
    assert {(x["doc_id"], x["pos"]) for x in rows} == {(1, 0), (1, 1), (2, 0)}
    long = next(x["spans"] for x in rows if (x["doc_id"], x["pos"]) == (1, 0))
    assert sum(s["sup"] for s in long) == line.count(" de ") + 1 and "".join(s["text"] for s in long).lower() == (line.replace(" de ", " XIXe siècle, XVe an ") + " XIXe siècle").lower()
    got = {(x["doc_id"], x["pos"]): [(a["start"], a["stop"]) for a in x["regions"]] for x in registry.queries()["span_regions_lines"](spark, str(tmp_path)).collect()}
    moved = registry.queries()["typo_all"](spark, str(tmp_path)).collect()
    assert set(got) == {(x["doc_id"], x["pos"]) for x in moved} and len(got[1, 0]) > 5
    for x in moved:
        expected = []
        for kind, _, _, a, b in SequenceMatcher(None, x["before"], x["after"], autojunk=False).get_opcodes():
            if kind in ("replace", "insert"):
                expected = expected[:-1] + [(expected[-1][0], b)] if expected and a - expected[-1][1] <= 3 else expected + [(a, b)]
        assert got[x["doc_id"], x["pos"]] == expected


def test_new_characters_join_the_span_they_are_put_in():
    got = S.carry([span("mot", italic=True), span(": fin...")], "mot : fin…")
    assert "".join(s["text"] for s in got) == "mot : fin…" and got[0]["text"] == "mot" and got[0]["italic"] and not got[0]["changed"]
    assert [s["text"] for s in got if s["changed"]] == [" ", "…"]
    assert S.carry([span("x")], "x") == [span("x", changed=False)] and S.carry([], "x") == []


def test_centuries():
    got = S.style_centuries([span("au "), span("XIXe", bold=True), span(" siècle")])
    assert [(s["text"], s["small_caps"], s["sup"], s["bold"]) for s in got] == [("au ", False, False, False), ("xix", True, False, True), ("e", False, True, True), (" siècle", False, False, False)]
    for text in ("le XIXe jour", "le XLIVe siècle", "XIX siècle"):
        assert S.style_centuries([span(text)]) == [span(text)]


def test_columns(spark):
    df = spark.createDataFrame([([span("XVe siècle : x")], "XVe siècle ; x"), (None, "y")], f"spans {S.T.ArrayType(S.SPAN).simpleString()}, after string")
    a, b = df.select(S.carried_spans(df.spans, df.after).alias("c"), S.century_spans(df.spans).alias("d"), S.changed_regions(S.F.lit("ab"), df.after).alias("r")).collect()
    assert "".join(x["text"] for x in a["c"]) == "XVe siècle ; x" and a["d"][0]["text"] == "xv" and b["c"] == [] and b["r"]


def test_normalised_tei():
    xml = tei.normalise('<b><p xml:id="x">a<hi rend="i">b</hi><hi rend="i">c</hi> <hi rend="i">d</hi>-<hi rend="i">e</hi><hi rend="b">f</hi><note n="9">q</note></p><p xml:id="x"/><note/><list><item/></list><lb xml:id="x"/></b>')
    assert xml.count("<hi") == 3 and ">bc d<" in xml and 'n="1"' in xml and 'n="2"' in xml and xml.count('id="x"') == 1
    for made in ("p-001", "note-001", "note-002", "list-001", "item-001", "lb-001"):
        assert f'id="{made}"' in xml
    inner = tei.normalise(f'<TEI xmlns="{tei.NS}"><p><hi rend="i">a<hi rend="b">x</hi></hi> <hi rend="i">c</hi></p></TEI>')
    assert "ns0" not in inner and inner.count("<hi") == 2 and "</hi> c</hi>" in inner


AWKWARD = [
    "", "mot , suite...", 'Il dit "oui" et “ non ” puis a="b", « il "dit" oui ».', "le xixe siècle; SOEURS et coeur : 10:30 http://a.b/c?d=1 !", "1 500 000 x -- y ,z", "M. Durand, p. 3 et n° 4 etc..... fin", "1ère 5eme l'ami  d'  une", "a – b – c - d", "«mot»; «»",
]


def test_pieces_of_a_rewrite_are_what_an_alignment_finds(spark):
    r = random.Random(8)
    texts = AWKWARD + [" ".join(r.choice(AWKWARD) for _ in range(6)) for _ in range(40)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select("t", typography.rewrite(df.t).alias("plain"), typography.rewrite_steps(df.t).alias("s")).collect()
    for x in got:
        assert x["s"]["text"] == x["plain"] and bool(x["s"]["steps"]) >= (x["plain"] != x["t"])
        table = S.piece_table(len(x["t"]), x["s"]["steps"])
        at = 0
        for origin, size in table:  # what is kept is what was there
            assert origin < 0 or x["t"][origin : origin + size] == x["plain"][at : at + size]
            at += size
        assert at == len(x["plain"])
        half = len(x["t"]) // 2
        spans = [span(x["t"][:half], italic=True), span(x["t"][half:])]
        moved = S.move(spans, x["s"]["steps"], x["plain"])
        assert "".join(s["text"] for s in moved) == x["plain"]
    same = [x for x in got if len(x["t"]) < 40]
    assert same and all(S.piece_regions(S.piece_table(len(x["t"]), x["s"]["steps"])) == S.regions(x["t"], x["plain"]) for x in same), [(x["t"], S.piece_regions(S.piece_table(len(x["t"]), x["s"]["steps"])), S.regions(x["t"], x["plain"])) for x in same]


def test_pieces_are_composed():
    edit = typography._edit
    table = S.piece_table(6, ["ab" + edit("c", "XY") + "def", edit("abX", "Q") + "Y" + edit("", "Z") + "def"])
    assert table == [(-1, 1), (-3, 1), (-4, 1), (3, 3)] and S.piece_regions(table) == [(0, 3)]
    assert S.move([span("abc"), span("def", bold=True)], [edit("abc", "abd") + "def"], "abddef")[0]["text"] == "ab"


def test_a_side_that_lies_in_the_other_needs_no_search(monkeypatch):
    """The longest match of a text and the same text between marks is the text itself: no table and no hashes are made."""
    from folio.functions import spans

    def refuse(*_):
        raise AssertionError("searched")

    monkeypatch.setattr(spans.Matcher, "_prefixes", staticmethod(refuse))
    text = "abcdefghij" * 50
    assert spans.regions(text, f"+++++{text}+++++") == [(0, 5), (505, 510)] and spans.regions(f"+++++{text}+++++", text) == []
