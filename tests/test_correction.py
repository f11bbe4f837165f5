import pytest

from lutrin.operators import correction

#: The words of the small hand-made list the expectations are for.
WORDS = """innovation innovation,innovations innovation,innovant innover,innovants innover,textile textile,textiles textile,international international,octobre octobre"""


@pytest.fixture(scope="module")
def lines(spark):
    rows = [(i, *x.split()) for i, x in enumerate(WORDS.split(","), 1)]
    return spark.createDataFrame(rows, "line_no int, word string, lemma string")


def run(spark, lines, query, **more):
    return {r.token: (r.status, r.correction, r.lemma, r.candidates) for r in correction.analyze(spark, query, lines, **more).collect()}


def test_statuses(spark, lines):
    got = run(spark, lines, "innovatoin textile 2024 12/10/2025 internationel textil octobre xyz")
    assert got["innovatoin"] == ("corrige-levenshtein", "innovation", "innovation", ["innovation", "innovations", "innovant", "innovants"])
    assert got["textile"] == ("valide", "textile", "textile", [])
    assert got["2024"] == ("entite", "2024", "2024", [])
    assert got["12/10/2025"] == ("entite", "12/10/2025", "12/10/2025", [])
    assert got["internationel"] == ("corrige-candidat-unique", "international", "international", ["international"])
    assert got["textil"] == ("corrige-levenshtein", "textile", "textile", ["textile", "textiles"])
    assert got["octobre"] == ("valide", "octobre", "octobre", [])
    assert got["xyz"] == ("introuvable", None, None, [])


def test_no_prefix_needed(spark, lines):
    assert run(spark, lines, "xextile", seuil_min=0, seuil_proximite=0.0)["xextile"][1] == "textile"
    assert run(spark, lines, "xextile", seuil_min=-1, seuil_proximite=0.0)["xextile"][1] == "textile"


def test_order_and_repeats(spark, lines):
    rows = correction.analyze(spark, "textile octobre textile", lines).orderBy("pos").collect()
    assert [(r.pos, r.token) for r in rows] == [(0, "textile"), (1, "octobre"), (2, "textile")]


def test_report(spark, lines):
    line = correction.report(correction.analyze(spark, "textil xyz", lines)).orderBy("pos").collect()
    assert line[0].line == "- token=textil | statut=corrige-levenshtein | correction=textile | lemme=textile | candidats=['textile', 'textiles']"
    assert line[1].line == "- token=xyz | statut=introuvable | correction=None | lemme=None | candidats=[]"


def test_errors(spark, lines):
    with pytest.raises(ValueError):
        correction.analyze(spark, "  ", lines)
    with pytest.raises(FileNotFoundError):
        correction.analyze(spark, "a", None)


def test_lexicon_votes(spark):
    rows = [(1, "a", "x"), (2, "a", "y"), (3, "B ", "m"), (4, "b", "n"), (5, "b", "n"), (6, "", "z"), (7, None, "z"), (8, "c", None), (9, "É", "é")]
    got = correction.lexicon(spark.createDataFrame(rows, "line_no int, word string, lemma string"))
    assert {(r.word, r.lemma) for r in got.collect()} == {("a", "x"), ("b", "n"), ("e", "e")}


def test_empty_and_null_queries(spark, lines):
    schema = "query_id int, query string, seuil_min int, seuil_max int, seuil_proximite double, token string"
    rows = [(1, None, 2, 3, 0.4, "x"), (2, "", 2, 3, 0.4, "x"), (3, " ? ", 2, 3, 0.4, "x"), (4, "textil", None, None, None, "x"), (4, "textil", None, None, None, "x")]
    got = correction.analysis(spark.createDataFrame(rows, schema), lines).collect()
    assert [(r.query_id, r.correction) for r in got] == [(4, "textile")]
    assert correction.analysis(spark.createDataFrame([], schema), lines).count() == 0
    assert correction.analysis(spark.createDataFrame(rows, schema), lines.limit(0)).first().status == "introuvable"


def test_lexicon_choice():
    assert correction.lexicon_path("mini", folder="/x/") == "/x/mini_lexicon.tsv" and correction.lexicon_path() == "./mot_lemma_list.txt" and correction.lexicon_path("full", "/y") == "/y"
    with pytest.raises(ValueError):
        correction.lexicon_path("other")
