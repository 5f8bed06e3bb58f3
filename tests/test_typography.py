import pytest
from pyspark.sql import functions as F

from folio.functions import typography
from folio.functions.text import fold, is_upper, strip, word_count
from folio.operators import notes

N, B = "\u202f", "\u00a0"
VECTORS = [
    ("space_strong", "Voici: un cas", f"Voici{N}: un cas"), ("space_strong", "Quoi ?!", f"Quoi{N}?{N}!"), ("space_strong", "http://exemple.org:8080/test", None), ("space_strong", "10:30", None),
    ("space_strong", "16:9", None), ("space_strong", r"C:\dossier\fichier", None), ("space_weak", "mot , suite", "mot, suite"), ("space_weak", "vaut ,5", None), ("space_weak", f"fin{N}.", "fin."),
    ("ellipsis", "bon....", "bon…."), ("etc", "etc….", "etc."), ("etc", "etc...", "etc."), ("double_space", "a  b\t\tc", "a b c"), ("double_dash", "a -- b", "a – b"), ("apostrophe", "l'été d'où 5'", "l’été d’où 5'"),
    ("ligatures", "coeur Oeuvre SOEURS coexister poete", "cœur Œuvre SŒURS coexister poete"), ("quote_open", f"«{B} x", f"«{N}x"), ("quote_close", "x »", f"x{N}»"), ("civility", "M. Dupont et Mme Élise", f"M.{B}Dupont et Mme{B}Élise"),
    ("centuries", "XIXème xiie XLIVe au vie", "XIXe XIIe XLIVe au VIe"), ("ordinals", "1ère 5ème 1er", "1re 5e 1er"), ("pages", "pp. 3-5 vol. II p. ab", f"pp.{N}3-5 vol.{N}II p. ab"), ("number", "n° 3", f"n°{N}3"),
    ("thousands", "1 500 000 hab.", f"1{N}500{N}000 hab."), ("thousands", "ISBN 978 2 1234 5678 9", None), ("dash", "été – hiver", "été — hiver"), ("dash", "a - b", "a — b"),
    ("space_strong", "a/" + "b" * 300 + "?", None), ("space_strong", "b" * 300 + " ?", "b" * 300 + f"{N}?"), ("space_strong", f"a/b ; c{B}: d\n! e", f"a/b{N}; c{N}: d\n{N}! e"), ("space_strong", "http://a/b?c: d:", f"http://a/b?c: d{N}:"),
    ("thousands", "1" + " 000" * 12 + " x", "1" + f"{N}000" * 12 + " x"), ("thousands", "12 345 678 9", f"12{N}345{N}678 9"), ("thousands", "1234 567", None),
    ("quotes", 'il dit "oui" hier', f"il dit «{N}oui{N}» hier"), ("quotes", 'print("x")', None), ("quotes", 'a class="b" c', None), ("quotes", '« il dit "oui" hier »', "« il dit “oui” hier »"), ("quotes", 'mot "cité", puis', None),
]


def one(spark, value, make):
    return spark.createDataFrame([(value,)], "t string").select(make(F.col("t"))).first()[0]


def test_rules(spark):
    """All vectors in one job: each text under its own rule, and that result under the rule again."""
    df = spark.createDataFrame([(k, rule, given) for k, (rule, given, _) in enumerate(VECTORS)], "k int, rule string, t string")
    by_rule = lambda c: F.coalesce(*(F.when(F.col("rule") == r, f(c)) for r, f in typography.RULES.items()))
    once = {r["k"]: r["t"] for r in df.withColumn("t", by_rule(F.col("t"))).collect()}
    again = spark.createDataFrame([(k, VECTORS[k][0], t) for k, t in once.items()], df.schema)
    twice = {r["k"]: r["t"] for r in again.withColumn("t", by_rule(F.col("t"))).collect()}
    for k, (rule, given, expected) in enumerate(VECTORS):
        assert once[k] == (given if expected is None else expected), (rule, given)
        assert twice[k] == once[k] or rule == "ellipsis", (rule, given)


def test_all_rules_are_idempotent_and_keep_nulls(spark):
    text = "L'oeuvre du XIXème siècle : 1 500 000 ex. , p. 12 ... \"citation\" etc..."
    first = one(spark, text, typography.rewrite)
    assert one(spark, first, typography.rewrite) == first and first != text
    assert one(spark, None, typography.rewrite) is None and one(spark, "", typography.rewrite) == ""


@pytest.mark.parametrize(
    ("given", "expected"),
    [("  voir la suite", "Voir la suite."), ("Voir op. cit. p. 3", f"Voir op.{N}cit. p. 3."), ("Paris, s. l. n. d.", f"Paris, s.{N}l. n. d."), ("Voir Ibid.", "Voir ibid."), ("Ibid., p. 4", "Ibid., p. 4."), ("http://a.org/x", "Http://a.org/x."), ("fin »", "Fin »"), ("", "")],
)
def test_notes(spark, given, expected):
    if given.startswith("http"):
        expected = "Http://a.org/x."  # the capital comes first, and what follows is no address any more
    assert one(spark, given, typography.note_text) == expected


def test_bibliography(spark):
    assert one(spark, " Dupont, Titre, p. 12, n° 3 ", typography.bibliography_text) == f"Dupont, Titre, p.{N}12, n°{N}3."


def test_century_styling_and_doubtful_quotes(spark):
    assert one(spark, "au XIXe siècle et XVe an", typography.century_styling) == ["XIX"]
    doubtful = lambda t: one(spark, t, typography.quote_point_suspects)
    assert doubtful("Il dit «oui !». Fin") == ["«oui !»."] and doubtful("Il dit : «oui».") == ["«oui»."] and doubtful("Il dit «oui».") == [] and doubtful("«a “b”.».") == []


def test_text_primitives(spark):
    assert one(spark, f"{N} a b {B}\t", strip) == "a b" and one(spark, f"annonce{N}: oui", word_count) == 3 and one(spark, "ÉTÉ 12", is_upper) and not one(spark, "12", is_upper) and one(spark, "Forêt ÇÀ", fold) == "foret ca"


def test_note_calls(spark):
    spans = spark.createDataFrame(
        [(1, 0, 0, "fin.", "text", None), (1, 0, 1, "", "text", None), (1, 0, 2, "[1]", "note_call", "n1"), (1, 1, 0, f"mot{N}", "text", None), (1, 1, 1, "[2]", "note_call", "n2"), (1, 2, 0, "[3]", "note_call", "n1"), (1, 3, 0, "mot", "text", None), (1, 3, 1, "[4]", "note_call", "n9")],
        "doc_id long, pos long, i long, text string, kind string, note_ref string",
    )
    assert sorted((r["pos"], r["rule"], r["space_kind"]) for r in notes.call_problems(spans).collect()) == [(0, "call_placement", None), (1, "call_spacing", "nnbsp")]
    table = spark.createDataFrame([(1, "n1", "x"), (1, "n2", "y"), (1, "n3", "z")], "doc_id long, note_id string, text string")
    got = {r["note_id"]: (r["target_pos"], r["call_positions"], r["number"]) for r in notes.numbered(notes.resolve_calls(table, spans)).collect()}
    assert got == {"n1": (0, [0, 2], 1), "n2": (1, [1], 2), "n3": (None, None, 3)}
    done = {r["note_id"]: (r["text"], r["changed"]) for r in notes.normalise(table).collect()}
    assert done["n1"] == ("X.", True)


def test_capitals_of_notes_are_those_of_sql(spark):
    """Letters whose capital takes several characters (ß, ligatures, Greek with iota) get one, as in SQL."""
    import duckdb

    letters = [c for c in map(chr, [*range(0x20, 0x530), *range(0x1E00, 0x2000), *range(0xFB00, 0xFB18)]) if len(c.upper()) > 1 or c.isalpha() and c.isascii()]
    got = [r[0] for r in spark.createDataFrame([(k, c + "x.") for k, c in enumerate(letters)], "k int, t string").orderBy("k").select(F.substring(typography.note_text(F.col("t")), 1, 1)).collect()]
    assert got == [duckdb.execute("select upper(?)", [c]).fetchone()[0] for c in letters]
    assert one(spark, "ßheit", typography.note_text) == "ẞheit."


def test_addresses_are_no_thousands(spark):
    """Addresses side by side stay as they are, as in the query's SQL; numbers beside them and with decimals don't."""
    text = "hôte 190.137.223.204 170.106.47.218 fin 1 500 000 192.168.1.1 et 12 345.50"
    assert one(spark, text, typography.RULES["thousands"]) == f"hôte 190.137.223.204 170.106.47.218 fin 1{N}500{N}000 192.168.1.1 et 12{N}345.50"


def test_spaces_before_strong_marks_by_whole_tokens(spark):
    """Only tokens with a slash are cut out; a noncharacter of the text's own is no mark."""
    given = f"a/b; c: d \ufdd0 e{B}; x:1 1:x 1:2 f\\g? h ?"
    assert one(spark, given, typography.RULES["space_strong"]) == f"a/b; c{N}: d \ufdd0 e{N}; x{N}:1 1{N}:x 1:2 f\\g? h{N}?"
