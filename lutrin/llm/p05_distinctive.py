"""Problem 5: how distinctive a term is of its record, by divergence from randomness.

The weight is the information content of the term under a geometric model of its spread over the collection,
times the Laplace gain of the after-effect, on the term frequency normalised by length:

    tfn    = tf * log2(1 + c * mean_length / length)
    lambda = F / N                               F occurrences in the collection of N records
    info   = log2(1 + lambda) + tfn * log2((1 + lambda) / lambda)
    weight = info / (tfn + 1)
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, map_rows
from .p02_frequency import term_counter, term_frequencies

#: Terms of at least this share of all records are joined by broadcast. A record of m different terms takes part in
#: m document frequencies, so there are at most (mean of m) / HEAD_SHARE such terms: a bound that doesn't grow with the data.
HEAD_SHARE = 0.005


def term_counts(df: DataFrame, id_col: str, text_cols: list[str]) -> DataFrame:
    """(rid, term, tf, length) for the terms of each row; ``length`` is in terms. No shuffle."""

    def make():
        count = term_counter()

        def run(parts: Iterator[dict[str, list]]) -> Iterator[list[tuple]]:
            for part in parts:
                rows = []
                for rid, *fields in zip(part["rid"], *(part[c] for c in text_cols)):
                    counts = count(fields)
                    length = sum(counts.values())
                    if rid is not None:
                        rows += [(rid, w, k, length) for w, k in counts.items()]
                yield rows

        return run

    some = df.select(F.col(id_col).alias("rid"), *text_cols)
    kind = some.schema["rid"].dataType.simpleString()
    return map_rows(some, f"rid {kind}, term string, tf int, length int", make)


def _weighed(df: DataFrame, id_col: str, text_cols: list[str], c: float, least_tf: int) -> DataFrame:
    """(rid, term, tf, n_docs, n_occ, lam, weight, bar): ``lam`` is the mean of the term's occurrences in a record, ``bar`` what the
    term would weigh in this record if it occurred ``least_tf`` times.

    Statistics cover all rows. Terms of many records, which would make hot join keys, take theirs from a broadcast of
    bounded size (HEAD_SHARE); the others meet their statistics by a shuffle on the term.
    """
    # One row for each different term, read three times below: counted once.
    stats = cut(term_frequencies(df, id_col, text_cols))
    sizes = df.agg(F.count("*").alias("n_rows")).scalar()
    total = stats.agg(F.sum("n_occ")).scalar()
    is_head = F.col("n_docs") >= F.greatest(F.lit(HEAD_SHARE) * sizes, F.lit(2))
    near = F.broadcast(stats.filter(is_head).select("term", F.col("n_docs").alias("h_docs"), F.col("n_occ").alias("h_occ")))
    # A term met in the head needs no partner: it gets a key of its own, spread over all partitions, that finds none.
    key = F.when(F.col("h_docs").isNull(), F.col("term")).otherwise(F.concat(F.lit("\0"), F.col("rid").cast("string")))
    tail = stats.filter(~is_head).select(F.col("term").alias("key"), "n_docs", "n_occ")
    joined = term_counts(df, id_col, text_cols).join(near, "term", "left").withColumn("key", key).join(tail, "key", "left")
    joined = joined.withColumn("n_docs", F.coalesce("h_docs", "n_docs")).withColumn("n_occ", F.coalesce("h_occ", "n_occ")).withColumn("lam", F.col("n_occ") / sizes)
    spread = F.log2(1 + c * (total / sizes) / F.col("length"))

    def weight(tf: Column) -> Column:
        tfn = tf * spread
        return (F.log2(1 + F.col("lam")) + tfn * F.log2((1 + F.col("lam")) / F.col("lam"))) / (tfn + 1)

    return joined.select("rid", "term", F.col("tf").cast("long").alias("tf"), "n_docs", "n_occ", "lam", weight(F.col("tf")).alias("weight"), weight(F.lit(least_tf)).alias("bar"))


def distinctive_terms(df: DataFrame, id_col: str = "rec_id", text_cols: list[str] | None = None, c: float = 1.0) -> DataFrame:
    """(id, term, tf, n_docs, n_occ, weight) for every term of every record.

    Null and empty fields hold no term; rows without an id get none; an empty table gives no row. Rows that repeat an id
    are weighed each by its own counts, and equal rows come out once for each.
    """
    found = _weighed(df, id_col, text_cols or ["titre", "texte"], c, 1)
    return found.select(F.col("rid").alias(id_col), "term", "tf", "n_docs", "n_occ", "weight")


def characteristic_terms(df: DataFrame, id_col: str = "rec_id", text_cols: list[str] | None = None, c: float = 1.0, least_tf: int = 3, most_docs: int = 5) -> DataFrame:
    """(id, term, tf, n_docs, weight): the terms whose weight reaches the bar that ``least_tf`` occurrences set in their record, of
    those in at most ``most_docs`` records.

    The weight rises with the term's frequency while it occurs less than once a record, and falls beyond that; so the bar is a
    floor there and a ceiling here. Counts are checked exactly afterwards. Edge cases as in ``distinctive_terms``.
    """
    found = _weighed(df, id_col, text_cols or ["titre", "texte"], c, least_tf)
    reached = F.when(F.col("lam") < 1, F.col("weight") >= F.col("bar") - 1e-9).otherwise(F.col("weight") <= F.col("bar") + 1e-9)
    found = found.filter(reached).filter((F.col("tf") >= least_tf) & (F.col("n_docs") <= most_docs))
    return found.select(F.col("rid").alias(id_col), "term", "tf", "n_docs", "weight")
