import pytest

from lutrin.functions.html import RECORD
from lutrin.sources import files

ROW = ("1", "258", "9/08/2012", "", "Titre & <b>", "A", "Un texte\nà deux lignes", [("u", "l")], "")


def test_corpus_round_trip(spark, tmp_path):
    df = spark.createDataFrame([ROW, (None, "259", "", "", "", "", "", [], "")], RECORD)
    files.write_corpus(df, str(tmp_path / "c"))
    back = {r.bulletin: r for r in files.read_corpus(spark, str(tmp_path / "c")).collect()}
    assert back["258"].titre == "Titre & <b>" and back["258"].texte == "Un texte\nà deux lignes" and back["258"].rubrique == ""
    assert back["258"].images[0].url == "u" and back["259"].auteur == ""


def test_tolerant_read(spark, tmp_path):
    (tmp_path / "x.xml").write_text("<corpus><document><titre>a</titre></document><document><titre>b</titr></document></corpus>")
    assert [r.titre for r in files.read_corpus(spark, str(tmp_path / "x.xml"), tolerant=True).collect()][:1] == ["a"]


def test_word_lists(spark, tmp_path):
    (tmp_path / "anti.txt").write_text('un\t ""\nc\'\t ""\nun\t "x"\nseul\n')
    got = files.read_anti_dictionary(spark, str(tmp_path / "anti.txt")).orderBy("ord").collect()
    assert [(r.ord, r.token, r.subst) for r in got] == [(1, "un", "x"), (2, "c'", "")]
    (tmp_path / "lex.tsv").write_text("a\tb\n\nsans tab\n c \td\te\n")
    got = files.read_lexicon(spark, str(tmp_path / "lex.tsv")).orderBy("line_no").collect()
    assert [(r.line_no, r.word, r.lemma) for r in got] == [(1, "a", "b"), (4, "c ", "d\te")]
    (tmp_path / "n.txt").write_text("a\n \n \nb\tc\n")
    assert files.count_lines(spark, str(tmp_path / "n.txt")) == 2
    assert {r.value for r in files.read_last_column(spark, str(tmp_path / "n.txt")).collect()} >= {"a", "c"}


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([("a", 2), ("b", 1)], "token string, n int")
    files.write_pairs(df, str(tmp_path / "p"), ["token", "n"])
    assert {r.value for r in spark.read.text(str(tmp_path / "p")).collect()} == {"a\t2", "b\t1"}
    files.write_anti_dictionary(df, str(tmp_path / "a"))
    assert {r.value for r in spark.read.text(str(tmp_path / "a")).collect()} == {'a\t ""', 'b\t ""'}


def test_pages(spark, tmp_path):
    (tmp_path / "1.htm").write_text("<title>BE X 7</title>")
    (tmp_path / "2.txt").write_text("no")
    got = files.articles_of(files.read_pages(spark, f" {tmp_path} ")).collect()
    assert [(r.path.rsplit("/", 1)[1], r.bulletin) for r in got] == [("1.htm", "7")]
    with pytest.raises(ValueError):
        files.read_pages(spark, " ")


def test_corpus_as_others_write_it(spark, tmp_path):
    (tmp_path / "c.xml").write_text("""<?xml version="1.0" ?>
<corpus>
    <document>
        <article>9</article>
        <titre>Un titre</titre>
        <texte> deux
lignes </texte>
        <images>
            <image>a.jpg</image>
            <legend>Une image</legend>
            <image>b.jpg</image>
            <legend/>
        </images>
        <contact/>
    </document>
    <document><article/><images/></document>
</corpus>""")
    a, b = sorted(files.read_corpus(spark, str(tmp_path / "c.xml")).collect(), key=lambda r: r.article is None)
    assert [(i.url, i.legend) for i in a.images] == [("a.jpg", "Une image"), ("b.jpg", "")] and a.texte == " deux\nlignes " and a.contact == ""
    assert b.article is None and b.images == []


def test_errors_are_told(spark, tmp_path):
    (tmp_path / "x.xml").write_text("<corpus><document><titre>a</titre></document><document><titre>b</titr></document></corpus>")
    assert [r.record.count("b") for r in files.corpus_errors(spark, str(tmp_path / "x.xml")).collect()] == [1]


def test_folder(spark, tmp_path):
    (tmp_path / "1.htm").write_text("x")
    assert files.choose_folder(spark, f" {tmp_path} ", "/d") == str(tmp_path)
    assert {files.choose_folder(spark, f, "/d") for f in (None, " ", "/nowhere", str(tmp_path.parent / "none"))} == {"/d"}


def test_list_keeps_order_and_substitutes(spark, tmp_path):
    df = spark.createDataFrame([(2, "a", "x"), (1, "b", None)], "ord int, token string, subst string")
    files.write_anti_dictionary(df, str(tmp_path / "a"))
    got = files.read_anti_dictionary(spark, str(tmp_path / "a")).orderBy("ord").collect()
    assert [(r.ord, r.token, r.subst) for r in got] == [(1, "b", ""), (2, "a", "x")]
