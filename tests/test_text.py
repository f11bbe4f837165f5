from pyspark.sql import functions as F

from lutrin.functions import text
from lutrin.functions.stemmer import stem


def one(spark, value, make):
    return spark.createDataFrame([(value,)], "t string").select(make(F.col("t")).alias("r")).first()["r"]


def test_normalize(spark):
    assert one(spark, " L’Été ﬁ œ ", text.normalize) == "l'ete fi œ"
    assert one(spark, " ÀÉÎ ", text.normalize) == "aei"
    assert one(spark, None, text.normalize) is None
    assert one(spark, "", text.normalize) == ""
    assert one(spark, "é", text.normalize) == "e"


def test_native_and_exact_agree(spark):
    values = ["Été", "ﬁn ﬀ", "Ａ１", "ǆ", "Å Ω", "x² ₂", "", "Łódź", "naïf"]
    df = spark.createDataFrame([(v,) for v in values], "t string")
    rows = df.select("t", text.strip_accents(F.col("t")).alias("a"), text.strip_accents_exact("t").alias("b")).collect()
    assert [(r.t, r.a) for r in rows if r.t != "ǆ"] == [(r.t, r.b) for r in rows if r.t != "ǆ"]


def test_query_tokens(spark):
    assert one(spark, "l'innovation du cœur 3,14 2024-2025", text.query_tokens) == ["l'innovation", "du", "c", "ur", "3,14", "2024", "2025"]
    assert one(spark, "123/10/2025", text.query_tokens) == ["123", "10", "2025"]
    assert one(spark, "12/10/2025 2024-01-31", text.query_tokens) == ["12/10/2025", "2024-01-31"]
    assert one(spark, "l’été", text.query_tokens) == ["l'été"]
    assert one(spark, " ", text.query_tokens) == []
    assert one(spark, None, text.query_tokens) is None


def test_entities(spark):
    df = spark.createDataFrame([(v,) for v in ("2024", "3,14", "12/10/2025", "1-2-24", "2024-01-31", "12/10", "a1", "3,14,1")], "t string")
    assert [r.t for r in df.filter(text.is_entity(F.col("t"))).collect()] == ["2024", "3,14", "12/10/2025", "1-2-24", "2024-01-31"]


def test_tokens_keep_elisions(spark):
    assert one(spark, "L'eau, qu'il n’a pas : parc'2", text.tokens) == ["l'", "eau", "qu'", "il", "n’", "a", "pas", "parc", "2"]


def test_common_prefix(spark):
    rows = [("innovatoin", "innovation", 7), ("", "a", 0), ("a", "a", 1), ("é", "e", 0), ("ab", "abc", 2), ("", "", 0)]
    df = spark.createDataFrame(rows, "a string, b string, n int")
    assert df.filter(text.common_prefix_length(F.col("a"), F.col("b")) == F.col("n")).count() == len(rows)


def test_common_prefix_of_null(spark):
    df = spark.createDataFrame([(None, "a")], "a string, b string")
    assert df.select(text.common_prefix_length(F.col("a"), F.col("b")).alias("n")).first().n is None


def test_stems_of_published_sample():
    sample = """continu continu,continua continu,continuait continu,continuation continu,continuel continuel,continuelle continuel,continuellement continuel,continuité continu,
    continuons continuon,contorsions contors,contournait contourn,contractée contract,contradictoirement contradictoir,contraindre contraindr,contraria contrari,maintenaient mainten,
    maintenue maintenu,maintint maintint,mairie mair,maître maîtr,maîtresses maîtress,majesté majest,majestueusement majestu,majestueux majestu,majorité major,malades malad,maladive malad"""
    for pair in sample.split(","):
        word, want = pair.split()
        assert stem(word) == want, word


def test_whole_tokens(spark):
    assert one(spark, "Un micro-ondes de l'eau, 3,14 km : R2D2 n’a pas_ été. a_b", text.alnum_words) == ["un", "de", "km", "r2d2", "pas", "été"]
    assert one(spark, "Le micro-ondes : l'Eau 2 R2", text.alpha_tokens) == ["Le", "Eau"]
    assert one(spark, "Le micro-ondes", text.tokens) == ["le", "micro-ondes"]
    assert one(spark, "a_b l'été-2", text.regex_tokens) == ["a_b", "l", "été", "2"]
    assert one(spark, None, text.alnum_words) is None
