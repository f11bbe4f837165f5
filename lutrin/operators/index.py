"""Term statistics, scores, stop list and inverted index of a collection.

A document is whatever ``doc_key`` groups: by default a bulletin, all its articles together. Rows without a key belong to
no document and are left out everywhere. Nulls in titles and texts count as empty.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lutrin.functions.stemmer import french_stem
from lutrin.functions.text import alnum_words, alpha_tokens, full_text, is_alpha, tokens
from lutrin.session import ship

#: Highest score of a term in the anti-dictionary. Fixed value.
SEUIL = 0.0001
#: Share of all documents from which a term's statistics are broadcast. A document of m different terms takes part in m document
#: frequencies, so there are at most (mean of m) / HEAD_SHARE such terms: a bound that doesn't grow with the collection.
HEAD_SHARE = 0.05
#: Documents in one block of a list of postings, about.
LIST = 100_000


def term_frequency(df: DataFrame, doc_key: str = "bulletin", split: Callable[[Column], Column] = tokens) -> DataFrame:
    """(doc_key, term, tf) of the tokens that ``split`` makes of title and text. Counts are combined within tasks before the one shuffle."""
    rows = df.filter(F.col(doc_key).isNotNull()).select(F.col(doc_key).alias("doc_key"), F.explode(split(full_text())).alias("term"))
    return rows.groupBy("doc_key", "term").agg(F.count("*").alias("tf"))


def token_counts(df: DataFrame, doc_key: str = "bulletin") -> DataFrame:
    """(doc_key, n_tokens, n_terms) of each document that has a token."""
    return term_frequency(df, doc_key).groupBy("doc_key").agg(F.sum("tf").alias("n_tokens"), F.count("*").alias("n_terms"))


def n_documents(df: DataFrame, doc_key: str = "bulletin") -> Column:
    """The number of documents as a scalar subquery: no row comes to the driver, nothing is joined."""
    return df.agg(F.count_distinct(F.col(doc_key)).alias("n")).scalar()


def document_frequency(df: DataFrame, doc_key: str = "bulletin") -> DataFrame:
    """(term, df): documents that have each term."""
    return term_frequency(df, doc_key).groupBy("term").agg(F.count("*").alias("df"))


def tfidf(df: DataFrame, doc_key: str = "bulletin") -> DataFrame:
    """(doc_key, term, tf, df, score) with score = tf * ln(N / df), no smoothing and no length norm.

    Terms of many documents would be hot join keys: those of at least HEAD_SHARE of all take their df from a broadcast, whose size
    the mean number of terms of a document bounds, and the others, of fewer documents each, by a shuffle. All sides read the
    same counts, so texts are split and shuffled once.
    """
    tf, n = term_frequency(df, doc_key), n_documents(df, doc_key)
    # The total keeps the counts from being pruned on this side, else its exchange would differ and nothing be reused.
    stats = tf.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("total")).filter("total > 0")
    is_head = F.col("df") >= F.greatest(F.lit(HEAD_SHARE) * n, F.lit(2))
    near = F.broadcast(stats.filter(is_head).select("term", F.col("df").alias("head_df")))
    # A term met in the head needs no partner: it gets a key of its own, spread over all partitions, that finds none.
    key = F.when(F.col("head_df").isNull(), F.col("term")).otherwise(F.concat(F.lit("\0"), F.col("doc_key").cast("string")))
    tail = stats.filter(~is_head).select(F.col("term").alias("key"), F.col("df").alias("tail_df"))
    found = tf.join(near, "term", "left").withColumn("key", key).join(tail, "key", "left").withColumn("df", F.coalesce("head_df", "tail_df"))
    return found.select("doc_key", "term", "tf", "df", (F.col("tf") * F.log(n / F.col("df"))).alias("score"))


def max_scores(df: DataFrame, doc_key: str = "bulletin") -> DataFrame:
    """(term, score): the highest tf-idf of each term. A term's idf is one number, so its highest tf decides: no join."""
    best = term_frequency(df, doc_key).groupBy("term").agg(F.max("tf").alias("tf"), F.count("*").alias("df"))
    return best.select("term", (F.col("tf") * F.log(n_documents(df, doc_key) / F.col("df"))).alias("score"))


def score_report(df: DataFrame, doc_key: str = "bulletin") -> DataFrame:
    """(line): terms and scores in columns of fixed width, highest score first, equal scores by term.

    A term has one line, so formatting works on distinct terms. Java rounds the shortest decimal of a double, where the format
    asks for its exact value; hence a vectorised function.
    """

    @F.pandas_udf(StringType())
    def fixed(scores: pd.Series) -> pd.Series:
        return scores.map(lambda x: f"{x:<20.15f}")

    scores = max_scores(df, doc_key).withColumn("shown", fixed("score"))
    return scores.orderBy(F.desc("score"), "term").select(F.concat(F.rpad("term", F.greatest(F.length("term"), F.lit(20)), F.lit(" ")), F.lit(" "), "shown").alias("line"))


def anti_dictionary(df: DataFrame, doc_key: str = "bulletin", seuil: float = SEUIL) -> DataFrame:
    """(token, subst): terms whose highest score is at most ``seuil``; with few documents, those of every document."""
    return max_scores(df, doc_key).filter(F.col("score") <= seuil).select(F.col("term").alias("token"), F.lit("").alias("subst"))


def in_order_met(df: DataFrame, anti: DataFrame, doc_key: str = "bulletin", order: str = "rec_id") -> DataFrame:
    """(ord, token, subst): an anti-dictionary in the order in which its tokens are first met, document by document in the order
    in which these are first met, within one by ``order`` and place. Only the list itself is numbered in one task."""
    begun = df.filter(F.col(doc_key).isNotNull()).groupBy(F.col(doc_key).alias("doc")).agg(F.min(order).alias("begin"))
    rows = df.select(F.col(doc_key).alias("doc"), F.col(order).alias("at"), F.posexplode(tokens(full_text())).alias("pos", "token"))
    first = rows.groupBy("doc", "token").agg(F.min(F.struct("at", "pos")).alias("place")).join(begun, "doc")
    found = first.join(anti, "token").groupBy("token", "subst").agg(F.min(F.struct("begin", "doc", "place")).alias("place"))
    return found.select(F.row_number().over(Window.orderBy("place")).alias("ord"), "token", "subst")


def in_every_document(df: DataFrame, doc_key: str = "bulletin") -> DataFrame:
    """(token, subst): terms of all documents, the second form of the anti-dictionary."""
    return document_frequency(df, doc_key).filter(F.col("df") == n_documents(df, doc_key)).select(F.col("term").alias("token"), F.lit("").alias("subst"))


def lemmatized(df: DataFrame, lemmas: DataFrame, doc_key: str = "bulletin", alpha: bool = False) -> DataFrame:
    """(doc_key, term, tf) of lemmas: distinct terms are looked up in ``lemmas`` (word, lemma); others stand for themselves. With
    ``alpha`` only terms of letters alone, whatever their lemma is like."""
    tf = term_frequency(df, doc_key)
    tf = tf.filter(is_alpha(F.col("term"))) if alpha else tf
    found = tf.join(lemmas.select(F.col("word").alias("term"), "lemma"), "term", "left")
    return found.groupBy("doc_key", F.coalesce("lemma", "term").alias("term")).agg(F.sum("tf").alias("tf"))


def lemma_max_scores(df: DataFrame, lemmas: DataFrame, doc_key: str = "bulletin") -> DataFrame:
    """(term, score): the highest tf-idf of each lemma."""
    best = lemmatized(df, lemmas, doc_key).groupBy("term").agg(F.max("tf").alias("tf"), F.count("*").alias("df"))
    return best.select("term", (F.col("tf") * F.log(n_documents(df, doc_key) / F.col("df"))).alias("score"))


def lemma_anti_dictionary(df: DataFrame, lemmas: DataFrame, doc_key: str = "bulletin", seuil: float = SEUIL) -> DataFrame:
    return lemma_max_scores(df, lemmas, doc_key).filter(F.col("score") <= seuil).select(F.col("term").alias("token"), F.lit("").alias("subst"))


def inverted_index(df: DataFrame, lemmas: DataFrame, doc_key: str = "bulletin", body: str = "texte") -> DataFrame:
    """(lemma, doc_id, tf) of the lemmas of alphabetic tokens; rows whose text is null or blank have none, even if they have a title."""
    rows = df.filter(F.col(body).rlike(r"(?U)\S"))
    return lemmatized(rows, lemmas, doc_key, alpha=True).select(F.col("term").alias("lemma"), F.col("doc_key").alias("doc_id"), "tf")


def postings(index: DataFrame) -> DataFrame:
    """(lemma, block, n_docs, postings): ``doc_id: tf`` of each lemma, by document.

    A lemma of more than LIST documents has its list in several blocks, documents spread over them by hash, so no row and no
    task holds a list that grows with the collection; others have block 0 only. ``n_docs`` counts the whole lemma.
    """
    sizes = index.groupBy("lemma").agg(F.count("*").alias("n_docs"))
    block = F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("n_docs") / LIST)).cast("int")
    entry = F.sort_array(F.collect_list(F.struct("doc_id", "tf")))
    text = F.array_join(F.transform(entry, lambda e: F.concat(e["doc_id"], F.lit(": "), e["tf"].cast("string"))), ", ")
    return index.join(sizes, "lemma").groupBy("lemma", block.alias("block"), "n_docs").agg(text.alias("postings"))


def word_counts(df: DataFrame) -> DataFrame:
    """(word, n): occurrences of each token of letters and digits alone, lower case, over titles and texts."""
    return df.select(F.explode(alnum_words(full_text())).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def stem_frequency(df: DataFrame) -> DataFrame:
    """(stem, n): occurrences of French stems. Words are counted first, so each different one is stemmed once."""
    ship(df.sparkSession)
    return word_counts(df).select(french_stem("word").alias("stem"), "n").groupBy("stem").agg(F.sum("n").alias("n"))


def stem_total(df: DataFrame) -> DataFrame:
    """(n_words, n_distinct): all words that are stemmed, and the different ones among them."""
    return word_counts(df).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_words"), F.count("*").alias("n_distinct"))


def word_stems(df: DataFrame) -> DataFrame:
    """(word, stem) of each different word."""
    ship(df.sparkSession)
    return word_counts(df).select("word", french_stem("word").alias("stem"))


def word_lemma_pairs(df: DataFrame, lemmas: DataFrame, id_col: str = "rec_id") -> DataFrame:
    """(id, part, pos, word, lemma): tokens of letters alone of texts (part 0) and titles (part 1) as written, with lemmas; others are
    their own. Words are looked up in lower case. Each row keeps its own pairs; repeated rows repeat theirs.
    """
    rows = None
    for part, col in enumerate(("texte", "titre")):
        own = df.select(F.col(id_col), F.lit(part).alias("part"), F.posexplode(alpha_tokens(F.col(col))).alias("pos", "word"))
        rows = own if rows is None else rows.unionByName(own)
    known = lemmas.select(F.col("word").alias("low"), "lemma")
    return rows.withColumn("low", F.lower("word")).join(known, "low", "left").select(id_col, "part", "pos", "word", F.coalesce("lemma", "low").alias("lemma"))


def lemma_frequency(pairs: DataFrame) -> DataFrame:
    """(lemma, freq), highest first, equal ones by lemma."""
    return pairs.groupBy("lemma").agg(F.count("*").alias("freq")).orderBy(F.desc("freq"), "lemma")


def compression_rate(pairs: DataFrame) -> DataFrame:
    """(n_lemmas, n_words, rate): different lemmas over all words; the rate of no words is null."""
    return pairs.agg(F.count_distinct("lemma").alias("n_lemmas"), F.count("*").alias("n_words")).withColumn("rate", F.try_divide("n_lemmas", "n_words"))
