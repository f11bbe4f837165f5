import pytest

from lutrin.operators import substitution
from lutrin.operators.substitution import filtered_corpus, ordered_pairs, replacer

CASES = [("l'un des", ["un", "l'"], "l' des"), ("À Paris", ["à"], " Paris"), ("un, UN; aucun", ["un"], ", ; aucun"), ("", ["un"], ""), (None, ["un"], None), ("a.b axb", ["a.b"], " axb")]


@pytest.mark.parametrize("text,stop,want", CASES)
def test_in_order(spark, text, stop, want):
    df = spark.createDataFrame([(text,)], "t string")
    pairs = [(s, "") for s in stop]
    assert df.select(replacer(pairs)("t").alias("r")).first().r == want


def test_substitutes_are_literal(spark):
    df = spark.createDataFrame([("un deux",)], "t string")
    pairs = [("un", "$1\\"), ("deux", "2")]
    assert df.select(replacer(pairs)("t").alias("r")).first().r == "$1\\ 2"


def test_list(spark):
    anti = spark.createDataFrame([(1, "des", ""), (2, "un", ""), (3, "des", "x"), (4, None, ""), (5, "", "")], "ord int, token string, subst string")
    assert ordered_pairs(anti) == [("des", "x"), ("un", "")]
    df = spark.createDataFrame([(1, "un des deux", None)], "rec_id int, titre string, texte string")
    assert filtered_corpus(df, anti).first().titre == " x deux"
    assert filtered_corpus(df, anti.limit(0)).first().titre == "un des deux"


@pytest.mark.parametrize("n", [6, 100, 300])
def test_boundaries_at_every_length(spark, n, monkeypatch):
    # A combining mark belongs to its word, however long the list and in how many parts it is applied.
    monkeypatch.setattr(substitution, "LIST", 40)
    texts = ["de\u0301but de la", "cote\u0301 COTE cote", "l'e\u0301te\u0301 l' e\u0301te\u0301", "a\u0327 a a_ a2 a² a", "de\u20dd de", "ete\u0301 e\u0301te"]
    stop = ["de", "cote", "l'", "a", "ete\u0301", "e\u0301te", *(f"mot{i}" for i in range(n - 6))]
    anti = spark.createDataFrame([(i, t, "") for i, t in enumerate(stop)], "ord int, token string, subst string")
    df = spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)], "rec_id int, titre string, texte string")
    got = [r.titre for r in filtered_corpus(df, anti).orderBy("rec_id").collect()]
    assert got == ["de\u0301but  la", "cote\u0301  ", "e\u0301te\u0301 l' e\u0301te\u0301", "a\u0327  a_ a2 a² ", "de\u20dd ", " "]
