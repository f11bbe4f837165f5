import math
import re
from collections import Counter

import pytest

from lutrin.llm import p02_frequency as freq
from lutrin.llm import p05_distinctive as dist
from lutrin.llm import queries as q

SCHEMA = "rec_id long, titre string, texte string, term string, n_docs int, rid int"
ROWS = [(1, "Été m²", "l'été de l'eau"), (2, None, "eau"), (3, "", ""), (4, "x", None), (None, "perdu", "perdu"), (70000, "eau", "Eau EAU"), (70000, "eau", "Eau EAU"), (5, "ét", "²½ⁿ")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, "clash", 1, 2) for r in ROWS], SCHEMA)


def brute(rows):
    occ, docs = Counter(), {}
    for rid, *fields in rows:
        if rid is not None:
            for f in fields:
                for w in re.findall(r"[^\W\d_]+", re.sub("[²½]", " ", (f or "").lower())):
                    occ[w] += 1
                    docs.setdefault(w, set()).add(rid)
    return {w: (occ[w], len(docs[w])) for w in occ}


def test_counts(docs):
    got = {r.term: (r.n_occ, r.n_docs) for r in freq.term_frequencies(docs).collect()}
    assert got == brute(ROWS)
    assert got["eau"] == (8, 3)


def test_marks(docs):
    got = {r.term: r.mark for r in freq.marked_terms(docs).collect()}
    assert got["été"] == "rare" and got["eau"] is None
    few = docs.filter("rec_id in (1, 2, 4, 70000)")
    assert {r.term: r.mark for r in freq.marked_terms(few).collect()}["eau"] == "common"


def test_containers():
    sparse, dense = freq.pack([5, 1, 5]), freq.pack(list(range(0, 65536, 3)))
    assert freq.cardinality(sparse) == 2 and freq.cardinality(dense) == 21846 and len(dense) == 8193
    both = freq.union([sparse, dense, freq.pack([1, 2])])
    assert freq.cardinality(both) == len({5, 1, 2} | set(range(0, 65536, 3)))
    assert freq.union([freq.pack([1]), freq.pack([2])]) == freq.pack([2, 1])


def test_many_records_of_one_term(spark):
    df = spark.range(0, 20000).selectExpr("id * 3 AS rec_id", "'commun' AS titre", "CAST(NULL AS STRING) AS texte")
    assert freq.term_frequencies(df.repartition(8)).first().n_docs == 20000


def test_empty(docs):
    assert freq.marked_terms(docs.limit(0)).count() == 0
    assert dist.distinctive_terms(docs.limit(0)).count() == 0


def weights(rows, c=1.0):
    stats = brute(rows)
    n, total = len(rows), sum(k for k, _ in stats.values())
    out = []
    for r in rows:
        own = brute([(1, *r[1:])])
        length = sum(k for k, _ in own.values())
        for w, (tf, _) in own.items():
            lam = stats[w][0] / n
            tfn = tf * math.log2(1 + c * (total / n) / length)
            out.append((r[0], w, tf, stats[w][1], round((math.log2(1 + lam) + tfn * math.log2((1 + lam) / lam)) / (tfn + 1), 9)))
    return sorted(out)


def test_weights(spark):
    rows = [(1, "a a b", "c"), (2, "a", "b b b"), (3, None, "a d"), (4, "", ""), (5, "a", None)]
    df = spark.createDataFrame(rows, "rec_id long, titre string, texte string")
    got = sorted((r.rec_id, r.term, r.tf, r.n_docs, round(r.weight, 9)) for r in dist.distinctive_terms(df).collect())
    assert got == weights(rows)
    some = sorted((r.rec_id, r.term, r.tf, r.n_docs, round(r.weight, 9)) for r in dist.characteristic_terms(df, least_tf=2, most_docs=2).collect())
    assert some == [x for x in weights(rows) if x[2] >= 2 and x[3] <= 2]


def test_characteristic_terms_are_chosen_by_weight(spark):
    # Few records and many occurrences: here the weight falls with the frequency.
    rows = [(1, "a a a a a a a a a", "b"), (2, "b b", "c c c"), (3, "a a", "d d d d")]
    df = spark.createDataFrame(rows, "rec_id long, titre string, texte string")
    found = dist.characteristic_terms(df)
    assert sorted((r.rec_id, r.term) for r in found.collect()) == [(1, "a"), (2, "c"), (3, "d")]
    plan = found.select("rec_id", "term")._jdf.queryExecution().executedPlan().toString()
    assert "LOG2" in plan.upper()


def test_row_without_id_has_no_terms(docs):
    assert {r.rec_id for r in dist.distinctive_terms(docs).collect()} == {1, 2, 4, 5, 70000}


@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
def test_against_sql(name, same, sf):
    same(name, q.queries()[name], q.oracle_sql()[name], sf)
