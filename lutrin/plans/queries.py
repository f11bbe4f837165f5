"""The library's operators as queries over whole tables, and the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable
from html.entities import codepoint2name

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lutrin.functions.text import ENTITY, QUERY_TOKEN, is_entity, normalize, regex_tokens, strip_accents
from lutrin.operators import correction, index, substitution
from lutrin.session import scratch, spread
from lutrin.sources import files
from lutrin.sources.files import articles_of, corpus_records

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "articles"))


def _lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lexicon")


def _lemmas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lemmas of words as they stand in texts, accents kept: the most voted, then first seen."""
    rows = _lexicon(spark, sf_dir).select("line_no", F.lower(F.trim("word")).alias("word"), F.lower(F.trim("lemma")).alias("lemma"))
    votes = rows.groupBy("word", "lemma").agg(F.count("*").alias("votes"), F.min("line_no").alias("first"))
    return votes.groupBy("word").agg(F.max_by("lemma", F.struct("votes", (-F.col("first")).alias("early"))).alias("lemma"))


def tokens_per_bulletin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.token_counts(_articles(spark, sf_dir))


def term_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.term_frequency(_articles(spark, sf_dir))


def document_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.document_frequency(_articles(spark, sf_dir))


def tfidf_per_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.tfidf(_articles(spark, sf_dir)).withColumn("score", F.round("score", 6))


def tfidf_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.max_scores(_articles(spark, sf_dir)).withColumn("score", F.round("score", 6))


def tfidf_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.score_report(_articles(spark, sf_dir))


def anti_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.anti_dictionary(_articles(spark, sf_dir))


def anti_dictionary_by_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.in_every_document(_articles(spark, sf_dir))


def lemma_tfidf_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.lemma_max_scores(_articles(spark, sf_dir), _lemmas(spark, sf_dir)).withColumn("score", F.round("score", 6))


def lemma_anti_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.lemma_anti_dictionary(_articles(spark, sf_dir), _lemmas(spark, sf_dir))


def filtered_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles and texts of all articles without the words of the given list."""
    return substitution.filtered_corpus(_articles(spark, sf_dir), table(spark, sf_dir, "anti_dict")).select("rec_id", "titre", "texte")


def filtered_corpus_own_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the collection's own anti-dictionary, in the order in which its tokens are first met."""
    articles = _articles(spark, sf_dir)
    own = index.in_order_met(articles, index.anti_dictionary(articles))
    return substitution.filtered_corpus(articles, own).select("rec_id", "titre", "texte")


def anti_dictionary_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    articles = _articles(spark, sf_dir)
    return index.in_order_met(articles, index.anti_dictionary(articles)).withColumn("ord", F.col("ord").cast("long"))


def regex_term_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the tokens that a pattern without a language makes."""
    return index.term_frequency(_articles(spark, sf_dir), split=regex_tokens)


def stem_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.stem_total(_articles(spark, sf_dir))


def inverted_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.inverted_index(_articles(spark, sf_dir), _lemmas(spark, sf_dir))


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.postings(inverted_index(spark, sf_dir))


def word_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.word_counts(_articles(spark, sf_dir))


def word_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.word_stems(_articles(spark, sf_dir))


def stem_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.stem_frequency(_articles(spark, sf_dir))


def word_lemma_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.word_lemma_pairs(_articles(spark, sf_dir), _lemmas(spark, sf_dir))


def lemma_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.lemma_frequency(word_lemma_pairs(spark, sf_dir))


def compression_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.compression_rate(word_lemma_pairs(spark, sf_dir)).withColumn("rate", F.round("rate", 9))


def page_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Article records of all pages."""
    return articles_of(spread(table(spark, sf_dir, "raw_articles")))


def page_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fields of pages that a regular expression reaches too."""
    return page_fields(spark, sf_dir).select("path", "article", "bulletin", "date", F.size("images").cast("long").alias("n_images"))


def page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Further fields of pages, those that are one run of text in their place."""
    return page_fields(spark, sf_dir).select("path", "rubrique", "titre", "auteur", "texte")


def corpus_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number and title of each page as the corpus has them."""
    return corpus_records(spread(table(spark, sf_dir, "raw_articles"))).select("path", "article", "titre")


def corpus_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles written as corpus XML and read again."""
    files.write_corpus(_articles(spark, sf_dir), folder := scratch(spark))
    return files.read_corpus(spark, folder).select("article", "bulletin", "date", "rubrique", "titre", "auteur", "texte", F.size("images").cast("long").alias("n_images"), F.concat_ws("|", "images.url").alias("urls"), F.concat_ws("|", "images.legend").alias("legends"), "contact")


def filtered_corpus_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles and texts without the words of the given list, written as corpus XML and read again."""
    kept = substitution.filtered_corpus(_articles(spark, sf_dir), table(spark, sf_dir, "anti_dict"))
    files.write_corpus(kept, folder := scratch(spark))
    return files.read_corpus(spark, folder).select("article", "titre", "texte")


def anti_dictionary_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The given list written to a file and read again, lines numbered anew."""
    files.write_anti_dictionary(table(spark, sf_dir, "anti_dict"), folder := scratch(spark))
    return files.read_anti_dictionary(spark, folder).select(F.col("ord").cast("long").alias("ord"), "token", "subst")


def lexicon_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and lemmas of the lexicon written to a file and read again; surrounding blanks of a line don't count."""
    files.write_pairs(_lexicon(spark, sf_dir), folder := scratch(spark), ["word", "lemma"])
    return files.read_lexicon(spark, folder).select("word", "lemma")


def word_lemma_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frequencies of the last column of the file of words and lemmas."""
    files.write_pairs(word_lemma_pairs(spark, sf_dir), folder := scratch(spark), ["word", "lemma"])
    return files.read_last_column(spark, folder).groupBy(F.col("value").alias("lemma")).agg(F.count("*").alias("freq"))


def compression_from_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The compression rate by the lines of the two files, of lemma frequencies and of words with lemmas."""
    pairs = word_lemma_pairs(spark, sf_dir)
    files.write_pairs(pairs, all_words := scratch(spark), ["word", "lemma"])
    files.write_pairs(index.lemma_frequency(pairs), lemmas := scratch(spark), ["lemma", "freq"])
    n, k = files.count_lines(spark, lemmas), files.count_lines(spark, all_words)
    return spark.createDataFrame([(n, k)], "n_lemmas long, n_words long").withColumn("rate", F.round(F.try_divide("n_lemmas", "n_words"), 9))


def inverted_index_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of the file of postings."""
    files.write_pairs(postings(spark, sf_dir), folder := scratch(spark), ["lemma", "postings"])
    return spark.read.text(folder).select(F.col("value").alias("line"))


def word_stem_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of the file of words and stems, and whether each has a stem."""
    files.write_pairs(word_stems(spark, sf_dir), folder := scratch(spark), ["word", "stem"])
    parts = F.split("value", "\t")
    return spark.read.text(folder).select(parts[0].alias("word"), (F.length(parts[1]) > 0).alias("stemmed"))


def normalized_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return correction.tokenized(table(spark, sf_dir, "queries")).select("query_id", "pos", "token", "word")


def query_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return correction.tokenized(table(spark, sf_dir, "queries")).select("query_id", "pos", "token")


def entity_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query_tokens(spark, sf_dir).filter(is_entity(F.col("token")))


def normalized_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and lemmas of the lexicon, normalised."""
    return _lexicon(spark, sf_dir).select("line_no", normalize(F.col("word")).alias("word"), strip_accents(F.col("lemma")).alias("lemma"))


def lexicon_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return correction.lexicon_votes(_lexicon(spark, sf_dir))


def lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return correction.lexicon(_lexicon(spark, sf_dir))


def lexicon_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of queries that the lexicon has, with their lemmas."""
    asked = correction.tokenized(table(spark, sf_dir, "queries"))
    return asked.join(lexicon(spark, sf_dir), "word").select("query_id", "pos", "word", "lemma")


def prefix_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return correction.ranked_candidates(table(spark, sf_dir, "queries"), _lexicon(spark, sf_dir)).withColumn("prefix_ratio", F.round("prefix_ratio", 6))


def best_correction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return correction.ranked_candidates(table(spark, sf_dir, "queries"), _lexicon(spark, sf_dir)).filter("rank = 1").select("query_id", "pos", "word", "lemma", "distance")


def query_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return correction.analysis(table(spark, sf_dir, "queries"), _lexicon(spark, sf_dir))


def query_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return correction.report(query_analysis(spark, sf_dir))


def queries() -> dict[str, Query]:
    found = (
        tokens_per_bulletin, term_frequency, document_frequency, tfidf_per_document, tfidf_max, tfidf_report, anti_dictionary, anti_dictionary_by_df, lemma_tfidf_max, lemma_anti_dictionary,
        filtered_text, filtered_corpus_own_list, inverted_index, postings, word_frequency, word_stems, stem_frequency, word_lemma_pairs, lemma_frequency, compression_rate, page_fields, page_keys,
        page_texts, corpus_titles, corpus_file, filtered_corpus_file, anti_dictionary_file, anti_dictionary_in_order, regex_term_frequency, stem_total, lexicon_file, word_lemma_file, compression_from_files, inverted_index_file, word_stem_file,
        query_tokens, entity_tokens, normalized_tokens, normalized_words, lexicon_votes, lexicon, lexicon_lookup, prefix_candidates, best_correction, query_analysis, query_report,
    )
    return {f.__name__: f for f in found}


_TEXT = "coalesce(titre, '') || ' ' || coalesce(texte, '')"
_TOKEN = r"(?:[cdjlmnst]|qu|jusqu|lorsqu|puisqu|quoiqu)[''’]|[\p{L}\p{N}]+(?:-[\p{L}\p{N}]+)*"
_TF = f"""
WITH words AS (
    SELECT bulletin AS doc_key, unnest(regexp_extract_all(lower({_TEXT}), '{_TOKEN}')) AS term FROM articles WHERE bulletin IS NOT NULL
), counts AS (
    SELECT doc_key, term, count(*) AS tf FROM words GROUP BY ALL
), stats AS (
    SELECT term, count(*) AS df, max(tf) AS best FROM counts GROUP BY term
), size AS (
    SELECT count(DISTINCT bulletin) AS n FROM articles
)
"""
_LEMMAS = """
votes AS (
    SELECT lower(trim(word, ' ')) AS word, lower(trim(lemma, ' ')) AS lemma, count(*) AS votes, min(line_no) AS first FROM lexicon GROUP BY ALL
), lemmas AS (
    SELECT word, arg_max(lemma, {'v': votes, 'f': -first}) AS lemma FROM votes GROUP BY word
)
"""
_LEMMA_TF = _TF.rstrip() + ", " + _LEMMAS.strip() + """, lemma_counts AS (
    SELECT doc_key, coalesce(lemma, term) AS term, sum(tf)::BIGINT AS tf FROM counts LEFT JOIN lemmas ON term = word GROUP BY ALL
), lemma_stats AS (
    SELECT term, count(*) AS df, max(tf) AS best FROM lemma_counts GROUP BY term
)
"""
_BODY_TF = _LEMMA_TF.replace("WHERE bulletin IS NOT NULL", r"WHERE bulletin IS NOT NULL AND regexp_matches(texte, '[^\s\p{Z}]')")
_INDEX = r"""SELECT coalesce(lemma, term) AS lemma, doc_key AS doc_id, sum(tf)::BIGINT AS tf FROM counts LEFT JOIN lemmas ON term = word
    WHERE regexp_full_match(term, '\p{L}+') GROUP BY ALL"""
_PAIRS = "WITH " + _LEMMAS.strip() + rf""", split AS (
    SELECT rec_id, 0 AS part, regexp_extract_all(texte, '(?i){_TOKEN}') AS w FROM articles UNION ALL SELECT rec_id, 1, regexp_extract_all(titre, '(?i){_TOKEN}') FROM articles
), pairs AS (
    SELECT rec_id, part, unnest(range(len(w))) AS pos, unnest(w) AS word FROM (SELECT rec_id, part, list_filter(w, lambda t: regexp_full_match(t, '\p{{L}}+')) AS w FROM split)
), lemmatized AS (
    SELECT rec_id, part, pos, pairs.word, coalesce(lemma, lower(pairs.word)) AS lemma FROM pairs LEFT JOIN lemmas ON lower(pairs.word) = lemmas.word
)
"""
# A word is cut out with its neighbours, which are put back; twice, as two words share the sign between them.
_OUTSIDE = r"[^\p{L}\p{N}\p{M}_]"


def _dropped(col: str) -> str:
    """One token of a list replaced in a column: whole words, any case."""
    inside = _OUTSIDE.replace("^", "")
    begin = f"CASE WHEN regexp_matches(token, '^{inside}') THEN '(^|{_OUTSIDE})' ELSE '({inside})' END"
    end = f"CASE WHEN regexp_matches(token, '{inside}$') THEN '($|{_OUTSIDE})' ELSE '({inside})' END"

    def once(x: str) -> str:
        return f"regexp_replace({x}, '(?i)' || {begin} || regexp_escape(token) || {end}, '\\1' || subst || '\\2', 'g')"

    return f"CASE WHEN contains(lower({col}), lower(token)) THEN {once(once(col))} ELSE {col} END"


_FILTERED = f"""
, steps AS (
    SELECT rec_id, article, titre, texte, 0::BIGINT AS k FROM articles
    UNION ALL
    SELECT rec_id, article, {_dropped("titre")}, {_dropped("texte")}, steps.k + 1 FROM steps JOIN numbered ON numbered.k = steps.k + 1
), filtered AS (
    SELECT rec_id, article, titre, texte FROM steps WHERE k = (SELECT count(*) FROM numbered)
)
"""
_GIVEN = "WITH RECURSIVE numbered AS (SELECT token, arg_max(coalesce(subst, ''), ord) AS subst, row_number() OVER (ORDER BY min(ord)) AS k FROM anti_dict WHERE token <> '' GROUP BY token)" + _FILTERED
_MET = _TF.rstrip() + f""", listed AS (
    SELECT term AS token, '' AS subst FROM stats, size WHERE best * ln(n / df) <= 0.0001
), split AS (
    SELECT bulletin AS doc, rec_id, regexp_extract_all(lower({_TEXT}), '{_TOKEN}') AS w FROM articles WHERE bulletin IS NOT NULL
), placed AS (
    SELECT doc, rec_id, unnest(w) AS token, unnest(range(len(w))) AS pos FROM split
), begun AS (
    SELECT doc, min(rec_id) AS begin FROM split GROUP BY doc
), met AS (
    SELECT token, subst, min((begin, doc, rec_id, pos)) AS place FROM placed JOIN begun USING (doc) JOIN listed USING (token) GROUP BY ALL
), numbered AS (
    SELECT token, subst, row_number() OVER (ORDER BY place) AS k FROM met
)
"""
_OWN = _MET.replace("WITH words", "WITH RECURSIVE words", 1) + _FILTERED
_ALNUM = r"[\p{L}\p{N}]+(?:[''’\-./_@+]+[\p{L}\p{N}]+|[,:]\p{Nd}[\p{L}\p{N}]*)*"
_WORDS = rf"SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower({_TEXT}), '{_ALNUM}')) AS word FROM articles) WHERE regexp_full_match(word, '[\p{{L}}\p{{N}}]+') GROUP BY word"
# The entities of Latin-1, punctuation and Greek by their names, ampersands last.
_ENTITIES = sorted((name, chr(code)) for code, name in codepoint2name.items() if name not in ("amp", "lt", "gt"))


def _unescaped(x: str) -> str:
    for name, ch in _ENTITIES:
        x = f"replace({x}, '&{name};', chr({ord(ch)}))"
    numbers = "list_distinct(regexp_extract_all(x, '&#\\d+;'))"
    x = f"(SELECT list_reduce(list_prepend(x, {numbers}), lambda a, b: replace(a, b, chr(regexp_extract(b, '\\d+')::INT))) FROM (SELECT {x} AS x))"
    return f"replace(replace(replace({x}, '&lt;', '<'), '&gt;', '>'), '&amp;', '&')"


def _between(begin: str, end: str, html: str = "html") -> str:
    return f"regexp_extract({html}, '{begin}(.*?){end}', 1, 's')"


def _trimmed(x: str) -> str:
    return f"regexp_replace({x}, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')"


_BODY = _between('<p class="style96"><span class="style95">', "</span>")
for _tag in ("b", "i", "em", "a", "strong", "u"):
    _BODY = f"regexp_replace({_BODY}, '<{_tag}(?: [^>]*)?>.*?</{_tag}>', '', 'gs')"
_PAGE_TEXTS = f"""
SELECT path, {_trimmed(_unescaped(_between('<p class="style96"><span class="style42">', "<br")))} AS rubrique,
       {_trimmed(_unescaped(_between('<span class="style17">', "</span>")))} AS titre,
       {_trimmed("regexp_extract(" + _unescaped(_between('dacteur :</span></p></td><td><p class="style44"><span class="style95">', "</span>")) + ", '-[\\s\\p{Z}]*(.+?)-[\\s\\p{Z}]*email', 1)")} AS auteur,
       {_unescaped(f"regexp_replace({_BODY}, '<[^>]+>', '', 'g')")} AS texte
FROM raw_articles"""
_CORPUS_TITLES = f"""
SELECT path, nullif(regexp_extract(html, '<span class="style88">[^<]*/(\\d+)\\.htm</span>', 1), '') AS article, {_unescaped("regexp_extract(html, '<span class=\"style17\">([^<]*)', 1)")} AS titre FROM raw_articles"""
_CLEAN = "regexp_replace(coalesce({0}, ''), '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]', '', 'g')"
_NORMAL = "strip_accents(replace(lower(regexp_replace({}, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')), '’', ''''))"
_QUERY = QUERY_TOKEN.replace("'", "''")
_ENTITY = ENTITY.removeprefix("^").removesuffix("$")
_ASKED = rf"""
asked AS (
    SELECT query_id, pos, token, {_NORMAL.format("token")} AS word, seuil_min, seuil_max, seuil_proximite, regexp_full_match(token, '{_ENTITY}') AS entity
    FROM (
        SELECT query_id, unnest(range(len(t))) AS pos, unnest(t) AS token, seuil_min, seuil_max, seuil_proximite
        FROM (SELECT query_id, regexp_extract_all(replace(query, '’', ''''), '{_QUERY}') AS t, coalesce(seuil_min, 2) AS seuil_min, coalesce(seuil_max, 3) AS seuil_max, coalesce(seuil_proximite, 0.4) AS seuil_proximite
              FROM (SELECT DISTINCT query_id, query, seuil_min, seuil_max, seuil_proximite FROM queries))
    )
)
"""
_LEXICON = rf"""
normal AS (
    SELECT line_no, {_NORMAL.format("word")} AS word, {_NORMAL.format("lemma")} AS lemma FROM lexicon
), lexicon_votes AS (
    SELECT word, lemma, count(*) AS votes, min(line_no) AS first FROM normal WHERE word <> '' AND lemma IS NOT NULL GROUP BY ALL
), known AS (
    SELECT word, arg_max(lemma, {{'v': votes, 'f': -first}}) AS lemma FROM lexicon_votes GROUP BY word
)
"""
# levenshtein counts bytes there; outside of ASCII only œ and æ are left, and one sign stands for each.
_CANDIDATES = "WITH " + _ASKED.strip() + ", " + _LEXICON.strip() + """, targets AS (
    SELECT DISTINCT word AS target, seuil_min, seuil_max, seuil_proximite FROM asked WHERE NOT entity AND word NOT IN (SELECT word FROM known)
), measured AS (
    SELECT *, list_sum([(left(target, i) = left(word, i))::INT FOR i IN range(1, least(length(target), length(word)) + 1)])::INT AS prefix_len
    FROM targets, known WHERE abs(length(word) - length(target)) <= seuil_max AND left(target, 1) = left(word, 1)
), kept AS (
    SELECT *, prefix_len / greatest(1, least(length(target), length(word))) AS prefix_ratio, levenshtein(translate(target, 'œæ', '01'), translate(word, 'œæ', '01'))::INT AS distance FROM measured
    WHERE prefix_len >= seuil_min AND prefix_len / greatest(1, least(length(target), length(word))) >= seuil_proximite
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY target, seuil_min, seuil_max, seuil_proximite ORDER BY distance, prefix_len DESC, word) AS rank FROM kept
)
"""
_ANALYSIS = _CANDIDATES.rstrip() + """, lists AS (
    SELECT target, seuil_min, seuil_max, seuil_proximite, list(word ORDER BY rank) AS names, list(lemma ORDER BY rank) AS lemmas FROM ranked GROUP BY ALL
), results AS (
    SELECT query_id, pos, token,
           CASE WHEN entity THEN 'entite' WHEN known.lemma IS NOT NULL THEN 'valide' WHEN names IS NULL THEN 'introuvable' WHEN len(names) = 1 THEN 'corrige-candidat-unique' ELSE 'corrige-levenshtein' END AS status,
           CASE WHEN entity THEN token WHEN known.lemma IS NOT NULL THEN asked.word ELSE names[1] END AS correction,
           CASE WHEN entity THEN token ELSE coalesce(known.lemma, lemmas[1]) END AS lemma,
           CASE WHEN entity OR known.lemma IS NOT NULL THEN []::VARCHAR[] ELSE coalesce(names, []::VARCHAR[]) END AS candidates
    FROM asked LEFT JOIN known ON asked.word = known.word
    LEFT JOIN lists ON asked.word = target AND asked.seuil_min = lists.seuil_min AND asked.seuil_max = lists.seuil_max AND asked.seuil_proximite = lists.seuil_proximite
    WHERE asked.word <> ''
)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "tokens_per_bulletin": _TF + "SELECT doc_key, sum(tf)::BIGINT AS n_tokens, count(*) AS n_terms FROM counts GROUP BY doc_key",
        "term_frequency": _TF + "SELECT doc_key, term, tf FROM counts",
        "document_frequency": _TF + "SELECT term, df FROM stats",
        "tfidf_per_document": _TF + "SELECT doc_key, term, tf, df, round(tf * ln(n / df), 6) AS score FROM counts JOIN stats USING (term), size",
        "tfidf_max": _TF + "SELECT term, round(best * ln(n / df), 6) AS score FROM stats, size",
        "anti_dictionary": _TF + "SELECT term AS token, '' AS subst FROM stats, size WHERE best * ln(n / df) <= 0.0001",
        "anti_dictionary_by_df": _TF + "SELECT term AS token, '' AS subst FROM stats, size WHERE df = n",
        "lemma_tfidf_max": _LEMMA_TF + "SELECT term, round(best * ln(n / df), 6) AS score FROM lemma_stats, size",
        "lemma_anti_dictionary": _LEMMA_TF + "SELECT term AS token, '' AS subst FROM lemma_stats, size WHERE best * ln(n / df) <= 0.0001",
        "inverted_index": _BODY_TF + _INDEX,
        "postings": _BODY_TF + f"SELECT lemma, 0 AS block, count(*) AS n_docs, string_agg(doc_id || ': ' || tf, ', ' ORDER BY doc_id) AS postings FROM ({_INDEX}) GROUP BY lemma",
        "word_frequency": _WORDS,
        "stem_total": f"SELECT coalesce(sum(n), 0)::BIGINT AS n_words, count(*) AS n_distinct FROM ({_WORDS})",
        "word_stem_file": f"SELECT word, true AS stemmed FROM ({_WORDS})",
        "regex_term_frequency": _TF.replace(_TOKEN, r"[\p{L}\p{N}_]+") + "SELECT doc_key, term, tf FROM counts",
        "filtered_text": _GIVEN + "SELECT rec_id, titre, texte FROM filtered",
        "filtered_corpus_own_list": _OWN + "SELECT rec_id, titre, texte FROM filtered",
        "corpus_file": f"SELECT nullif({_CLEAN.format('article')}, '') AS article, " + ", ".join(f"{_CLEAN.format(c)} AS {c}" for c in ("bulletin", "date", "rubrique", "titre", "auteur", "texte", "contact")) + """,
                coalesce(len(images), 0) AS n_images, coalesce(array_to_string([i.url FOR i IN images], '|'), '') AS urls, coalesce(array_to_string([coalesce(i.legend, '') FOR i IN images], '|'), '') AS legends FROM articles""",
        "filtered_corpus_file": _GIVEN + f"SELECT nullif({_CLEAN.format('article')}, '') AS article, {_CLEAN.format('titre')} AS titre, {_CLEAN.format('texte')} AS texte FROM filtered",
        "anti_dictionary_in_order": _MET + "SELECT k AS ord, token, subst FROM numbered",
        "anti_dictionary_file": "SELECT min(k) AS ord, token, arg_max(subst, k) AS subst FROM (SELECT token, coalesce(subst, '') AS subst, row_number() OVER (ORDER BY ord, token) AS k FROM anti_dict) GROUP BY token",
        "lexicon_file": r"""
            SELECT split_part(line, chr(9), 1) AS word, split_part(line, chr(9), 2) AS lemma
            FROM (SELECT regexp_replace(word || chr(9) || lemma, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') AS line FROM lexicon) WHERE contains(line, chr(9))""",
        "word_lemma_file": _PAIRS + "SELECT lemma, count(*) AS freq FROM lemmatized GROUP BY lemma",
        "compression_from_files": _PAIRS + "SELECT count(DISTINCT lemma) AS n_lemmas, count(*) AS n_words, round(count(DISTINCT lemma) / count(*), 9) AS rate FROM lemmatized",
        "inverted_index_file": _BODY_TF + f"SELECT lemma || chr(9) || string_agg(doc_id || ': ' || tf, ', ' ORDER BY doc_id) AS line FROM ({_INDEX}) GROUP BY lemma",
        "word_lemma_pairs": _PAIRS + "SELECT rec_id, part, pos, word, lemma FROM lemmatized",
        "lemma_frequency": _PAIRS + "SELECT lemma, count(*) AS freq FROM lemmatized GROUP BY lemma",
        "compression_rate": _PAIRS + "SELECT count(DISTINCT lemma) AS n_lemmas, count(*) AS n_words, round(count(DISTINCT lemma) / count(*), 9) AS rate FROM lemmatized",
        "page_texts": _PAGE_TEXTS,
        "corpus_titles": _CORPUS_TITLES,
        "page_keys": r"""
            SELECT path, regexp_extract(html, 'class="style88">[^<]*/(\d+)\.htm', 1) AS article, regexp_extract(html, '<title>[^<]*?BE(?:\s|&nbsp;)+\w+(?:\s|&nbsp;)+(\d+)', 1) AS bulletin,
                   regexp_extract(html, 'class="style15">[^<]*?(\d{1,2}/\d{2}/\d{4})', 1) AS date, len(regexp_extract_all(html, '<img[^>]*margin-bottom:5px')) AS n_images
            FROM raw_articles""",
        "query_tokens": "WITH " + _ASKED + "SELECT query_id, pos, token FROM asked WHERE word <> ''",
        "entity_tokens": "WITH " + _ASKED + "SELECT query_id, pos, token FROM asked WHERE entity",
        "normalized_tokens": "WITH " + _ASKED + "SELECT query_id, pos, token, word FROM asked WHERE word <> ''",
        "normalized_words": f"SELECT line_no, {_NORMAL.format('word')} AS word, strip_accents(lemma) AS lemma FROM lexicon",
        "lexicon_votes": "WITH " + _LEXICON + "SELECT word, lemma, votes FROM lexicon_votes",
        "lexicon": "WITH " + _LEXICON + "SELECT word, lemma FROM known",
        "lexicon_lookup": "WITH " + _ASKED.strip() + ", " + _LEXICON + "SELECT query_id, pos, word, lemma FROM asked JOIN known USING (word)",
        "prefix_candidates": _CANDIDATES + """
            SELECT query_id, pos, rank, ranked.word, lemma, prefix_len, round(prefix_ratio, 6) AS prefix_ratio, distance FROM asked
            JOIN ranked ON asked.word = target AND asked.seuil_min = ranked.seuil_min AND asked.seuil_max = ranked.seuil_max AND asked.seuil_proximite = ranked.seuil_proximite WHERE NOT entity""",
        "best_correction": _CANDIDATES + """
            SELECT query_id, pos, ranked.word, lemma, distance FROM asked
            JOIN ranked ON asked.word = target AND asked.seuil_min = ranked.seuil_min AND asked.seuil_max = ranked.seuil_max AND asked.seuil_proximite = ranked.seuil_proximite WHERE NOT entity AND rank = 1""",
        "query_analysis": _ANALYSIS + "SELECT query_id, pos, token, status, correction, lemma, candidates FROM results",
        "query_report": _ANALYSIS + """
            SELECT query_id, pos, '- token=' || token || ' | statut=' || status || ' | correction=' || coalesce(correction, 'None') || ' | lemme=' || coalesce(lemma, 'None')
                || ' | candidats=[' || coalesce(array_to_string([chr(39) || c || chr(39) FOR c IN candidates], ', '), '') || ']' AS line FROM results""",
    }
