"""Lexicon, spelling candidates and analysis of queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lutrin.functions.text import common_prefix_length, is_entity, normalize, query_tokens

#: Thresholds where a query names none: shared prefix, length difference, closeness. Fixed values.
SEUIL_MIN, SEUIL_MAX, SEUIL_PROXIMITE = 2, 3, 0.4
QUERY_COLUMNS = ["query_id", "query", "seuil_min", "seuil_max", "seuil_proximite"]


def lexicon(lines: DataFrame) -> DataFrame:
    """(word, lemma), one row a word: the lemma with most votes, of equal ones the one seen first.

    ``lines`` has (line_no, word, lemma). Both are normalised; null lemmas don't vote; empty words are left out.
    """
    rows = lines.select("line_no", normalize(F.col("word")).alias("word"), normalize(F.col("lemma")).alias("lemma")).filter("word != '' and lemma is not null")
    votes = rows.groupBy("word", "lemma").agg(F.count("*").alias("votes"), F.min("line_no").alias("first"))
    return votes.groupBy("word").agg(F.max_by("lemma", F.struct("votes", (-F.col("first")).alias("early"))).alias("lemma"))


def lexicon_votes(lines: DataFrame) -> DataFrame:
    """(word, lemma, votes) of all competing lemmas."""
    rows = lines.select(normalize(F.col("word")).alias("word"), normalize(F.col("lemma")).alias("lemma")).filter("word != '' and lemma is not null")
    return rows.groupBy("word", "lemma").agg(F.count("*").alias("votes"))


def tokenized(queries: DataFrame) -> DataFrame:
    """Rows of ``queries`` by token: query_id, pos (from 0), token, word (normalised), thresholds.

    Exact repeats of a query are one query. Null, empty and blank ones have no token; null thresholds take their defaults.
    """
    q = queries.select(*QUERY_COLUMNS).distinct()
    q = q.fillna({"seuil_min": SEUIL_MIN, "seuil_max": SEUIL_MAX, "seuil_proximite": SEUIL_PROXIMITE})
    rows = q.select("query_id", F.posexplode(query_tokens(F.col("query"))).alias("pos", "token"), "seuil_min", "seuil_max", "seuil_proximite")
    return rows.withColumn("word", normalize(F.col("token"))).filter("word != ''")


def candidates(unknown: DataFrame, words: DataFrame) -> DataFrame:
    """Candidates of unknown words: (target, seuil_*, word, lemma, prefix_len, prefix_ratio, distance).

    ``unknown`` has (target, seuil_min, seuil_max, seuil_proximite), each combination once, however often it was asked. A
    shared prefix of seuil_min characters is an equal one of that length, and a length that differs by at most seuil_max is one of
    few, so words and targets enter once for each and the join is an equi-join on prefix and length; a seuil_min of 0 or less meets
    the words of those lengths by the empty prefix. Keys that many targets have are split by adaptive execution: a word is met by its
    own length only.
    """
    prefixes = words.select("word", "lemma", F.explode(F.sequence(F.lit(0), F.length("word"))).alias("k"))
    prefixes = prefixes.select("word", "lemma", "k", F.expr("left(word, k)").alias("head"), F.length("word").alias("size"))
    k, size = F.greatest("seuil_min", F.lit(0)), F.length("target")
    asked = unknown.filter((F.col("seuil_max") >= 0) & (size >= k)).withColumn("k", k).withColumn("head", F.expr("left(target, k)"))
    asked = asked.withColumn("size", F.explode(F.sequence(F.greatest(size - F.col("seuil_max"), k), size + F.col("seuil_max"))))
    met = asked.join(prefixes, ["k", "head", "size"])
    met = met.withColumn("prefix_len", common_prefix_length(F.col("target"), F.col("word")))
    met = met.withColumn("prefix_ratio", F.col("prefix_len") / F.greatest(F.lit(1), F.least(F.length("target"), F.length("word"))))
    met = met.filter(F.col("prefix_ratio") >= F.col("seuil_proximite"))
    return met.select("target", "seuil_min", "seuil_max", "seuil_proximite", "word", "lemma", "prefix_len", "prefix_ratio", F.levenshtein("target", "word").alias("distance"))


def analysis(queries: DataFrame, lines: DataFrame) -> DataFrame:
    """(query_id, pos, token, status, correction, lemma, candidates) of every token of every query.

    status: ``entite`` for dates and numbers, ``valide`` for words of the lexicon, ``corrige-candidat-unique`` and
    ``corrige-levenshtein`` for corrected ones, ``introuvable`` (correction and lemma null). Candidates come by distance, then
    longer shared prefix, then word.
    """
    words = lexicon(lines)
    asked = tokenized(queries).withColumn("entity", is_entity(F.col("token")))
    known = asked.join(words.select("word", F.col("lemma").alias("direct")), "word", "left")
    keys = ["target", "seuil_min", "seuil_max", "seuil_proximite"]
    unknown = known.filter("not entity and direct is null").select(F.col("word").alias("target"), *keys[1:]).distinct()
    found = candidates(unknown, words)
    ordered = F.array_sort(F.collect_list(F.struct("distance", (-F.col("prefix_len")).alias("minus"), "word", F.col("lemma").alias("of"))))
    best = found.groupBy(*keys).agg(ordered.alias("c"))
    # Tokens that need no candidates get keys that meet none, spread over all partitions.
    apart = F.concat(F.lit("\0"), F.col("query_id").cast("string"))
    rows = known.withColumn("target", F.when(~F.col("entity") & F.col("direct").isNull(), F.col("word")).otherwise(apart)).join(best, keys, "left")
    n = F.coalesce(F.size("c"), F.lit(0))
    status = F.when(F.col("entity"), "entite").when(F.col("direct").isNotNull(), "valide").when(n <= 0, "introuvable").when(n == 1, "corrige-candidat-unique").otherwise("corrige-levenshtein")
    correction = F.when(F.col("entity"), F.col("token")).when(F.col("direct").isNotNull(), F.col("word")).otherwise(F.get("c", F.lit(0))["word"])
    lemma = F.when(F.col("entity"), F.col("token")).otherwise(F.coalesce("direct", F.get("c", F.lit(0))["of"]))
    names = F.coalesce(F.transform("c", lambda x: x["word"]), F.array().cast("array<string>"))
    return rows.select("query_id", "pos", "token", status.alias("status"), correction.alias("correction"), lemma.alias("lemma"), names.alias("candidates"))


def ranked_candidates(queries: DataFrame, lines: DataFrame) -> DataFrame:
    """(query_id, pos, rank, word, lemma, prefix_len, prefix_ratio, distance) of unknown words, rank 1 the chosen one."""
    words = lexicon(lines)
    asked = tokenized(queries).filter(~is_entity(F.col("token"))).join(words.select("word"), "word", "left_anti").withColumnRenamed("word", "target")
    keys = ["target", "seuil_min", "seuil_max", "seuil_proximite"]
    found = candidates(asked.select(*keys).distinct(), words)
    order = Window.partitionBy(*keys).orderBy("distance", F.desc("prefix_len"), "word")
    return asked.join(found.withColumn("rank", F.row_number().over(order)), keys).select("query_id", "pos", "rank", "word", "lemma", "prefix_len", "prefix_ratio", "distance")


def report(results: DataFrame) -> DataFrame:
    """(query_id, pos, line): the results as lines of text; null is shown as None, candidates as a list in brackets."""
    shown = F.concat(F.lit("["), F.array_join(F.transform("candidates", lambda x: F.concat(F.lit("'"), x, F.lit("'"))), ", "), F.lit("]"))
    text = F.concat(F.lit("- token="), "token", F.lit(" | statut="), "status", F.lit(" | correction="), F.coalesce("correction", F.lit("None")), F.lit(" | lemme="), F.coalesce("lemma", F.lit("None")), F.lit(" | candidats="), shown)
    return results.select("query_id", "pos", text.alias("line"))


def lexicon_path(choice: str = "full", path: str | None = None, folder: str = ".") -> str:
    """Where the lexicon is: ``path`` if given, else the small (``mini``) or the whole one (``full``) of ``folder``."""
    names = {"mini": "mini_lexicon.tsv", "full": "mot_lemma_list.txt"}
    if choice not in names:
        raise ValueError("the lexicon is mini or full")
    return path or f"{folder.rstrip('/')}/{names[choice]}"


def analyze(spark, query: str | None, lines: DataFrame | None, seuil_min: int = SEUIL_MIN, seuil_max: int = SEUIL_MAX, seuil_proximite: float = SEUIL_PROXIMITE) -> DataFrame:
    """The analysis of one query. An empty query is a ValueError, a missing lexicon a FileNotFoundError."""
    if not query or not query.strip():
        raise ValueError("the query is empty")
    if lines is None:
        raise FileNotFoundError("there is no lexicon")
    row = [(0, query.strip(), seuil_min, seuil_max, float(seuil_proximite))]
    q = spark.createDataFrame(row, "query_id int, query string, seuil_min int, seuil_max int, seuil_proximite double")
    return analysis(q, lines)
