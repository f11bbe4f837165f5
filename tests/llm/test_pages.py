import itertools
import random

import numpy as np
import pytest

from lutrin.llm import p03_boilerplate as p3
from lutrin.llm import p04_subjects as p4


def best_total(scores, cost):
    """The largest total of any set of regions, less ``cost`` for each, by trying all sets of lines."""
    best = 0.0
    for inside in itertools.product((False, True), repeat=len(scores)):
        begins = sum(x and (i == 0 or not inside[i - 1]) for i, x in enumerate(inside))
        best = max(best, sum(s for s, x in zip(scores, inside) if x) - cost * begins)
    return best


def test_regions():
    assert p3.regions([4, -5, 3, -3, 1, 2, -2, 2, -2, 1, 5], 4.5) == [(2, 11)]
    assert p3.regions([4, -5, 3, -1, 3], 1.5) == [(0, 1), (2, 5)]
    assert p3.regions([]) == [] == p3.regions([-1.0, -2.0]) == p3.regions([1.0], 2.0)
    r = random.Random(1)
    for _ in range(300):
        s, cost = [r.choice([-1, 1]) * r.random() for _ in range(r.randrange(10))], r.choice([0.0, 0.2, 0.5, 1.0])
        found = p3.regions(s, cost)
        assert all(a < b <= c for (a, b), (c, _) in zip(found, [*found[1:], (len(s), 0)]))
        assert sum(sum(s[a:b]) for a, b in found) - cost * len(found) == pytest.approx(best_total(s, cost))


def weighed(**words):
    """Weights set by hand, of words alone."""
    weight = np.zeros(p3.BUCKETS, dtype=np.float32)
    for word, w in words.items():
        weight[p3.bucket(word)] = w
    return weight


def test_scan_decides():
    # A line of weak score goes with its neighbours: inside content it is content, alone or in furniture it is none.
    model = p3.Weights(weighed(tribunal=6.0, menu=-6.0, suite=-1.0, fin=1.0), 0.0, 2.0)
    texts = [["tribunal", "suite", "tribunal"], ["menu", "fin", "menu"], ["tribunal", "menu", "tribunal"], ["suite", "", "fin"], []]
    assert model.content(texts) == [[True, True, True], [False, False, False], [True, False, True], [False, False, False], []]
    assert model.furniture(["tribunal\nsuite\ntribunal", None, "", "menu\n\nfin"]) == [[], [], [], [0, 2]]
    # Without the scan, by the sign of each line's own score, these lines would be judged the other way.
    alone = [[s > 0 for s in model.scores(x)] for x in texts[:2]]
    assert alone == [[True, False, True], [False, True, False]]


def test_features_of_lines_are_their_own():
    lines = ["- Plan du site", "Le juge » Numéro 12 » fin", "", "Aller au contenu ?", "©", "a | b | c"]
    at, col = p3.features(lines)
    for i, line in enumerate(lines):
        one = p3.features([line])
        assert sorted(col[at == i]) == sorted(one[1]) and set(one[0]) == {0}
    assert p3.Weights(None, 0.0).scores(["x", " "]) == [1.0, 0.0] and p3.Weights(weighed(), 0.0).content([]) == []


def test_page_lines():
    page = '<ul><li><a href="/">Accueil</a></li></ul><p><span class="style95">Un &eacute;t&eacute;.<br /><br />Deux</span></p><div class="foot">(c) 2020</div>'
    content, furniture = p3.page_lines(page)
    assert content == ["Un été.", "Deux"] and furniture[:2] == ["Accueil", "(c) 2020"]


@pytest.fixture(scope="module")
def tables(spark, sf):
    return {t: spark.read.parquet(f"{sf}/../sf0.01/{t}.parquet") for t in ("articles", "raw_articles", "subject_samples")}


def test_furniture_on_pages_not_trained_on(tables):
    pages = tables["raw_articles"].collect()
    texts = {}
    for r in tables["articles"].select("article", "texte", "contact").collect():
        texts.setdefault(r.article, []).extend(t for t in (r.texte, r.contact) if t)
    rows = [p3.labelled(p.html, texts.get(p.path.rsplit("/", 1)[1][:-4], [])) for p in pages]
    model = p3.fit([x for i, r in enumerate(rows) if i % 4 for x in r])
    held = [x for i, r in enumerate(rows) if i % 4 == 0 for x in r]
    inside = model.content([[x for x, _ in text] for text in held])
    judged = [yes == label for text, own in zip(held, inside) for (_, label), yes in zip(text, own) if label is not None]
    assert model.cost > 0 and len(judged) > 500 and sum(judged) / len(judged) > 0.97


def test_sample_ignores_order(tables):
    a, p = tables["articles"].limit(60), tables["raw_articles"]
    assert p3.training_texts(a, p) == p3.training_texts(a.repartition(3), p.repartition(5))


def test_furniture_edges(spark, tables):
    rows = [(1, None, None, 9), (2, "", "", 9), (3, "\n\n", "Haut de page", 9), (4, "Accueil\nLe tribunal nuance le décret, sous réserve de confirmation.\nHaut de page\nHaut de page", None, 9), (None, "Accueil", "Accueil", 9)]
    df = spark.createDataFrame(rows, "rec_id long, texte string, contact string, line_no int").selectExpr("*", "CAST(NULL AS STRING) AS article")
    labelled = tables["articles"].select("rec_id", "texte", "contact", "article").unionByName(df.drop("line_no"))
    got = {(r.rec_id, r.field, r.line_no) for r in p3.furniture_lines(labelled, tables["raw_articles"]).filter("rec_id <= 4").collect()}
    assert {x for x in got if x[0] == 4 and x[1] == "texte"} >= {(4, "texte", 0), (4, "texte", 2), (4, "texte", 3)} and (4, "texte", 1) not in got
    assert (3, "contact", 0) in got and not any(x[:2] == (2, "texte") and x[2] > 50 for x in got)
    # Without pages nothing is furniture; empty tables give nothing.
    assert p3.furniture_lines(df, tables["raw_articles"].limit(0)).count() == 0
    assert p3.furniture_lines(df.limit(0), tables["raw_articles"]).count() == 0
    assert p3.main_text(df, tables["raw_articles"].limit(0)).count() == 5


def test_sentences():
    assert p4.sentences("Un tribunal. Deux juges ? « Trois », dit-il. quatre.") == ["Un tribunal.", "Deux juges ?", "« Trois », dit-il. quatre."]
    assert p4.sentences("- le juge ;") == [] == p4.sentences("Une méthode") == p4.sentences("")
    assert p4.sentences("Et demain ?") == ["Et demain ?"]


@pytest.fixture(scope="module")
def samples(tables):
    return [(f"{r.titre or ''}\n{r.texte or ''}", r.subject) for r in tables["subject_samples"].collect()]


def treated(model, found):
    row, number = model.vocab.rows(found, model.vocab.codes())
    p = model.scorer().posteriors(row, number, len(found))
    return [{model.areas[a] for a in (x >= 0.5).nonzero()[0]} for x in p], p


def test_subjects_held_out(samples):
    model = p4.train([r for i, r in enumerate(samples) if i % 4])
    held = [r for i, r in enumerate(samples) if i % 4 == 0]
    right = 0
    for text, subject in held:
        found = [s for line in text.split("\n") for s in p4.sentences(line)]
        share = (treated(model, found)[1] >= 0.5).mean(axis=0)
        right += {model.areas[i] for i in (share >= p4.SHARE).nonzero()[0]} == {subject}
    assert right / len(held) > 0.9


def test_a_sentence_of_two_areas(samples):
    model = p4.train(samples)
    law, space = "Le tribunal annule le décret et la jurisprudence.", "La fusée place le satellite sur une orbite basse."
    got, _ = treated(model, [law, space, law[:-1] + " quand " + space[3:], "Et demain ?"])
    assert got == [{"droit"}, {"espace"}, {"droit", "espace"}, set()]


def test_terms():
    v = p4.vocabulary(["le juge rend un avis", "le juge rend l'arrêt", "Juge rend", "seul"], least=3)
    assert v.words == {"juge": 0, "rend": 1} and v.pairs.tolist() == [1] and v.size == 3
    row, number = v.rows(["Un JUGE rend", "", "rend juge", "juge et rend", "juge x1 rend"], v.codes())
    assert sorted(zip(row.tolist(), number.tolist())) == [(0, 0), (0, 1), (0, 2), (2, 0), (2, 1), (3, 0), (3, 1), (3, 2), (4, 0), (4, 1)]
    assert p4.vocabulary(["bb cc", "bb cc"], most=2, least=1).size == 2


def test_expectation_over_all_sentences(spark, samples):
    model = p4.train(samples)
    texts = ["Le tribunal annule le décret. La fusée est prête.", None, "", "Le satellite.\nUn titre\nLe juge."] * 3
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "rid long, text string").repartition(3)
    table = p4.term_table(df, model.vocab, p3.Weights(None, 0.0))
    found = ["Le tribunal annule le décret.", "La fusée est prête.", "Le satellite.", "Le juge."] * 3
    row, number = model.vocab.rows(found, model.vocab.codes())
    p = model.scorer().posteriors(row, number, len(found))
    want = np.stack([np.bincount(number, weights=p[row, a], minlength=model.vocab.size) for a in range(len(model.areas))])
    assert np.abs(p4.expectation(model.scorer(), table) - want).max() < 0.01
    assert 1 < p4.refine(model, table) < p4.PASSES


def test_subjects_edges(spark, tables):
    law = "Le tribunal nuance le décret. La jurisprudence éclaire le contentieux. Le greffier complète la plainte."
    rows = [(1, law, "a1"), (2, None, "a2"), (3, "", "a3"), (4, "Haut de page", "a4"), (None, law, "a5"), (1, law, "a1")]
    df = spark.createDataFrame(rows, "rec_id long, texte string, article string").selectExpr("*", "CAST(NULL AS STRING) AS contact", "'x' AS subject")
    args = (tables["subject_samples"], tables["raw_articles"])
    assert [(r.rec_id, r.subject) for r in p4.subjects(df, *args).collect()] == [(1, "droit")]
    assert p4.subjects(df.limit(0), *args).count() == 0
    assert p4.subjects(df, tables["subject_samples"].limit(0), args[1]).count() == 0


def test_subjects_judge_whole_lines(spark, tables, monkeypatch):
    monkeypatch.setattr(p3, "weights", lambda *_: p3.Weights(weighed(haut=-1.0, tribunal=3.0, accueil=-9.0), 0.0, 1.0))
    rows = [(1, "Haut. Le tribunal nuance le décret. Le greffier complète la plainte."), (2, "Le tribunal nuance le décret. Retour à l'accueil.")]
    df = spark.createDataFrame(rows, "rec_id long, texte string")
    got = {(r.rec_id, r.n_sentences) for r in p4.subject_shares(df, tables["subject_samples"], tables["raw_articles"]).collect()}
    assert got == {(1, 3)}
