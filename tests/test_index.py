import math

import pytest

from lutrin.operators import index
from lutrin.plans import queries as plans

SCHEMA = "rec_id long, bulletin string, titre string, texte string"
ROWS = [(1, "a", "Le four", "le four chaud"), (2, "b", None, "le froid"), (3, "b", "", None), (4, None, "le vide", "le vide"), (1, "a", "Le four", "le four chaud"), (5, "c", "", "  ")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def as_dict(df, *keys):
    return {tuple(r[k] for k in keys[:-1]): r[keys[-1]] for r in df.collect()}


def test_frequencies(docs):
    tf = as_dict(index.term_frequency(docs), "doc_key", "term", "tf")
    assert tf == {("a", "le"): 4, ("a", "four"): 4, ("a", "chaud"): 2, ("b", "le"): 1, ("b", "froid"): 1}
    assert as_dict(index.document_frequency(docs), "term", "df")[("le",)] == 2


def test_scores(docs):
    best = as_dict(index.max_scores(docs), "term", "score")
    assert best[("le",)] == pytest.approx(4 * math.log(3 / 2))
    assert best[("four",)] == pytest.approx(4 * math.log(3))
    full = {(r.doc_key, r.term): r.score for r in index.tfidf(docs).collect()}
    assert max(v for (_, t), v in full.items() if t == "le") == pytest.approx(best[("le",)])


def test_anti_dictionary_is_terms_of_every_document(docs):
    two = docs.filter("bulletin in ('a', 'b')")
    assert {r.token for r in index.anti_dictionary(two).collect()} == {"le"} == {r.token for r in index.in_every_document(two).collect()}
    one = docs.filter("bulletin = 'a'")
    assert {r.token for r in index.anti_dictionary(one).collect()} == {"le", "four", "chaud"}


def test_report_has_fixed_width(docs):
    lines = [r.line for r in index.score_report(docs).collect()]
    assert lines[0].startswith("four                 4.39444915467243")
    assert all(len(x) == 41 for x in lines)


def test_index_and_postings(spark, docs):
    lemmas = spark.createDataFrame([("chaud", "chaleur"), ("froid", "froid")], "word string, lemma string")
    inv = index.inverted_index(docs, lemmas)
    assert as_dict(inv, "lemma", "doc_id", "tf") == {("le", "a"): 4, ("four", "a"): 4, ("chaleur", "a"): 2, ("le", "b"): 1, ("froid", "b"): 1}
    assert as_dict(index.postings(inv), "lemma", "postings")[("le",)] == "a: 4, b: 1"


def test_long_lists_are_split(spark, monkeypatch):
    monkeypatch.setattr(index, "LIST", 10)
    inv = spark.range(95).selectExpr("'eau' AS lemma", "CAST(id AS STRING) AS doc_id", "1L AS tf")
    rows = index.postings(inv).collect()
    assert len(rows) > 5 and {r.n_docs for r in rows} == {95}
    assert sorted(int(e.split(":")[0]) for r in rows for e in r.postings.split(", ")) == list(range(95))


def test_pairs_and_rate(spark, docs):
    lemmas = spark.createDataFrame([("chaud", "chaleur")], "word string, lemma string")
    pairs = index.word_lemma_pairs(docs.filter("rec_id = 2 or rec_id = 4"), lemmas)
    assert [(r.part, r.pos, r.word) for r in pairs.filter("rec_id = 4").orderBy("part", "pos").collect()] == [(0, 0, "le"), (0, 1, "vide"), (1, 0, "le"), (1, 1, "vide")]
    r = index.compression_rate(pairs).first()
    assert (r.n_lemmas, r.n_words) == (3, 6) and r.rate == 0.5


def test_empty_table(spark):
    none = spark.createDataFrame([], SCHEMA)
    lemmas = spark.createDataFrame([], "word string, lemma string")
    for df in (index.term_frequency(none), index.tfidf(none), index.max_scores(none), index.anti_dictionary(none), index.postings(index.inverted_index(none, lemmas)), index.stem_frequency(none)):
        assert df.count() == 0
    assert index.compression_rate(index.word_lemma_pairs(none, lemmas)).first().rate is None


def test_clashing_columns(spark, docs):
    more = docs.selectExpr("*", "'x' AS term", "1 AS tf", "2 AS df", "'y' AS doc_key", "3 AS n")
    assert index.tfidf(more).count() == index.tfidf(docs).count() == 5


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_against_sql(name, same, sf):
    same(name, plans.queries()[name], plans.oracle_sql()[name], sf)


@pytest.mark.parametrize("name", sorted(set(plans.queries()) - set(plans.oracle_sql())))
def test_runs(name, spark, sf):
    assert plans.queries()[name](spark, sf).count() > 0


def test_order_in_which_tokens_are_met(spark):
    rows = [(1, "b", "", "le a"), (2, "a", "de", "la le"), (3, "b", "la", "de")]
    df = spark.createDataFrame(rows, SCHEMA)
    anti = spark.createDataFrame([("de", ""), ("la", ""), ("le", "")], "token string, subst string")
    assert [(r.ord, r.token) for r in index.in_order_met(df, anti).orderBy("ord").collect()] == [(1, "le"), (2, "la"), (3, "de")]


def test_filter_is_on_the_token(spark):
    df = spark.createDataFrame([(1, "a", "", "pare-feu ado x2")], SCHEMA)
    lemmas = spark.createDataFrame([("pare-feu", "mur"), ("ado", "adolescent-e"), ("x2", "double")], "word string, lemma string")
    assert [r.lemma for r in index.inverted_index(df, lemmas).collect()] == ["adolescent-e"]
    assert {r.term for r in index.lemma_max_scores(df, lemmas).collect()} == {"mur", "adolescent-e", "double"}


def test_total_of_stemmed_words(spark, docs):
    r = index.stem_total(docs).first()
    assert (r.n_words, r.n_distinct) == (16, 5) and index.stem_total(docs.limit(0)).first().n_words == 0
