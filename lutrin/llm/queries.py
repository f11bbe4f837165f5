"""Queries of the training-data problems, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lutrin.session import spread

from . import p01_names, p02_frequency, p03_boilerplate, p04_subjects, p05_distinctive, p06_encoding_damage, p07_lookalikes, p08_encoding, p09_leaks, p10_repetition

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def p1_signatories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each spelling with the id of the signatory it names."""
    return p01_names.signatories(_table(spark, sf_dir, "articles"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p01_names.same_signatory(_table(spark, sf_dir, "articles"))


def p1_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each spelling with its signatory's number of spellings and the one that stands for them."""
    return p01_names.classes(_table(spark, sf_dir, "articles"))


def p2_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every term with its occurrences, records and mark."""
    return p02_frequency.marked_terms(_table(spark, sf_dir, "articles"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2_terms(spark, sf_dir).filter("mark is not null").select("term", "mark")


def p3_main(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts and contacts of articles without their page furniture."""
    return p03_boilerplate.main_text(_table(spark, sf_dir, "articles"), _table(spark, sf_dir, "raw_articles"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p03_boilerplate.furniture_lines(_table(spark, sf_dir, "articles"), _table(spark, sf_dir, "raw_articles")).distinct()


def p4_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of each article's own sentences that treat each area."""
    return p04_subjects.subject_shares(*(_table(spark, sf_dir, t) for t in ("articles", "subject_samples", "raw_articles")))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p04_subjects.subjects(*(_table(spark, sf_dir, t) for t in ("articles", "subject_samples", "raw_articles")))


def p5_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every term of every article with its weight."""
    return p05_distinctive.distinctive_terms(_table(spark, sf_dir, "articles")).select("rec_id", "term", "tf", "n_docs", F.round("weight", 6).alias("weight"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p05_distinctive.characteristic_terms(_table(spark, sf_dir, "articles")).select("rec_id", "term")


def p6_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every damaged value with its text as far as it can be restored."""
    return p06_encoding_damage.damage(_table(spark, sf_dir, "articles"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p6_repaired(spark, sf_dir).filter("rec_id is not null").select("rec_id", "field").distinct()


def _p7_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = p07_lookalikes.unified(_table(spark, sf_dir, "candidates"), "cand_id", ["word"], spare_damaged=False, only_changed=True)
    texts = p07_lookalikes.unified(_table(spark, sf_dir, "articles"), "rec_id", ["texte", "titre"], only_changed=True)
    return (
        texts.select(F.lit("articles").alias("tbl"), F.col("rec_id").alias("row_id"), "field", "form")
        .unionByName(words.select(F.lit("candidates").alias("tbl"), F.col("cand_id").alias("row_id"), "field", "form"))
    )


def p7_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The consistent form of every value that is written with other characters."""
    return _p7_values(spark, sf_dir)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _p7_values(spark, sf_dir).filter("row_id is not null").select("tbl", "row_id", "field").distinct()


def p7_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles and texts of articles and candidate words with the skeleton of their group; equal ones look the same."""
    texts = p07_lookalikes.look_alikes(_table(spark, sf_dir, "articles"), ["texte", "titre"])
    words = p07_lookalikes.look_alikes(_table(spark, sf_dir, "candidates"), ["word"])
    return texts.select(F.lit("articles").alias("tbl"), "*").unionByName(words.select(F.lit("candidates").alias("tbl"), "*"))


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p08_encoding.encode_corpus(_table(spark, sf_dir, "documents"))


def p8_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts encoded and decoded again: the empty text for null, every other one as it was."""
    return p08_encoding.decode_corpus(p8_ids(spark, sf_dir))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p09_leaks.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark_items"))


def p10_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of repeated content of every document."""
    return p10_repetition.shares(_table(spark, sf_dir, "documents")).select("doc_id", F.round("repeated_share", 6).alias("repeated_share"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p10_repetition.repetitive(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (p1_found, p1_signatories, p1_classes, p2_found, p2_terms, p3_found, p3_main, p4_found, p4_shares, p5_found, p5_weights, p6_found, p6_repaired, p7_found, p7_forms, p7_groups, p8_ids, p8_decoded, p9_found, p10_found, p10_shares)}


_COUNTS = r"""
WITH words AS (
    SELECT rec_id, unnest(regexp_extract_all(lower(coalesce(titre, '')), '\p{L}+')) AS term FROM articles
    UNION ALL
    SELECT rec_id, unnest(regexp_extract_all(lower(coalesce(texte, '')), '\p{L}+')) AS term FROM articles
), counts AS (
    SELECT rec_id, term, count(*) AS tf FROM words WHERE rec_id IS NOT NULL GROUP BY ALL
), stats AS (
    SELECT term, sum(tf)::BIGINT AS n_occ, count(*) AS n_docs FROM counts GROUP BY term
), size AS (
    SELECT count(*) AS n_rows FROM articles
), marked AS (
    SELECT term, n_occ, n_docs, CASE WHEN n_docs <= 1 THEN 'rare' WHEN n_docs >= 0.5 * n_rows THEN 'common' END AS mark
    FROM stats, size
), lengths AS (
    SELECT rec_id, sum(tf) AS length FROM counts GROUP BY rec_id
), weighed AS (
    SELECT rec_id, term, tf, n_docs, n_occ / n_rows AS lam,
           tf * log2(1 + ((SELECT sum(n_occ) FROM stats) / n_rows) / length) AS tfn
    FROM counts JOIN stats USING (term) JOIN lengths USING (rec_id), size
)
"""

_UNSEEN = r"[\x{00ad}\x{200b}-\x{200f}\x{2060}-\x{2064}\x{feff}]"
_FOLDED = r"regexp_extract_all(lower(strip_accents(regexp_replace({}, 'UNSEEN', '', 'g'))), '[\p{{L}}\p{{N}}]+')"


def _folded(text: str) -> str:
    return _FOLDED.format(text).replace("UNSEEN", _UNSEEN)


#: Runs of ten words of documents and items, with mark-up and without it.
_LEAKS = rf"""
WITH views AS (
    SELECT 'd' AS side, doc_id AS id, {_folded("text")} AS w FROM documents
    UNION ALL SELECT 'd', doc_id, {_folded("regexp_replace(text, '</?[A-Za-z][^<>]{0,200}>', '', 'g')")} FROM documents WHERE contains(text, '<')
    UNION ALL SELECT 'i', item_id, {_folded("text")} FROM benchmark_items
), runs AS (
    SELECT DISTINCT side, id, array_to_string(w[i : i + 9], ' ') AS run FROM (SELECT side, id, w, unnest(range(1, len(w) - 8)) AS i FROM views)
)
SELECT DISTINCT d.id AS doc_id, i.id AS item_id FROM runs d JOIN runs i ON d.run = i.run AND d.side = 'd' AND i.side = 'i'
"""
_REPEATED = rf"""
WITH words AS (
    SELECT doc_id, {_folded("text")} AS w FROM documents
), runs AS (
    SELECT doc_id, i, row_number() OVER (PARTITION BY doc_id, run ORDER BY i) AS nth
    FROM (SELECT doc_id, i, array_to_string(w[i : i + 4], ' ') AS run FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM words))
), covered AS (
    SELECT doc_id, count(DISTINCT pos) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS pos FROM runs WHERE nth > 1) GROUP BY doc_id
)
SELECT doc_id FROM covered JOIN words USING (doc_id) WHERE n >= 0.4 * len(w)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p2_terms": _COUNTS + "SELECT term, n_occ, n_docs, mark FROM marked",
        "p2_found": _COUNTS + "SELECT term, mark FROM marked WHERE mark IS NOT NULL",
        "p5_weights": _COUNTS + "SELECT rec_id, term, tf, n_docs, round((log2(1 + lam) + tfn * log2((1 + lam) / lam)) / (tfn + 1), 6) AS weight FROM weighed",
        "p5_found": _COUNTS + "SELECT rec_id, term FROM counts JOIN stats USING (term) WHERE tf >= 3 AND n_docs <= 5",
        "p9_found": _LEAKS,
        "p10_found": _REPEATED,
        "p8_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
    }
