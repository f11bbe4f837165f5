import itertools
import random

import pytest

from lutrin.llm import p01_names as names


@pytest.mark.parametrize(
    "text,kind,words,initials",
    [
        ("Claire Floonquier", "p", ["claire", "floonquier"], ""),
        ("FLOONQUIER Claire", "p", ["floonquier", "claire"], ""),
        ("Floonquier, Claire", "p", ["claire", "floonquier"], ""),
        ("Dr Maëlle de Zeldalier (corr.)", "p", ["maelle", "zeldalier"], ""),
        ("Félix Zorn, envoyé spécial", "p", ["felix", "zorn"], ""),
        ("Véronique L. Barmotitour - rédaction", "p", ["veronique", "barmotitour"], ""),
        ("Marie Hélène Zorn", "p", ["marie-helene", "zorn"], ""),
        ("M. H. Zorn", "i", ["zorn"], "mh"),
        ("Zorn, M.-H.", "i", ["zorn"], "mh"),
        ("JN Zorn", "i", ["zorn"], "jn"),
        ("OcÃ©ane Zorn", "p", ["oceane", "zorn"], ""),
        ("Inès deZorn", "p", ["ines", "zorn"], ""),
        ("La rédaction", "s", ["redaction"], ""),
        ("P.F.H.V.", "a", [], ""),
        ("PFHV", "a", [], ""),
        ("...", "", [], ""),
    ],
)
def test_parse(text, kind, words, initials):
    assert names.parse(text)[:3] == (kind, words, initials)


def test_organisations():
    want = ("o", ["ferutin", "hydrologie", "pole", "volcanologie"])
    for t in ("Pôle Ferutin d'hydrologie et volcanologie", "Ferutin, Pôle d'hydrologie et volcanologie", "Pôle Ferutin (hydrologie, volcanologie)", "Pole Ferutin hydrologie & volcanologie", "Plôe Ferutin d'hydrologie et volcanologie (PFHV)"):
        assert names.parse(t)[:2] == want, t
    assert names.parse("Plôe Ferutin d'hydrologie et volcanologie (PFHV)")[3] == ["PFHV"]


def test_distance():
    assert names.distance("chrsitophe", "christophe") == 1
    assert names.distance("abc", "abcd") == 1 and names.distance("abc", "xbcd") == 2 and names.distance("a", "abcd") == 2
    assert names.distance("mich?le", "michele") == 0 and names.distance("mich?le", "michel") == 2


def resolve(spark, spellings):
    rows = [(i, s, 1) for i, s in enumerate(spellings)]
    df = spark.createDataFrame(rows, "rec_id int, auteur string, signatory int")
    return {tuple(sorted(x)) for x in names.same_signatory(df).collect()}


def all_pairs(*groups):
    return {tuple(sorted(p)) for g in groups for p in itertools.combinations(g, 2)}


def test_groups(spark):
    one = ["Élisabeth Rollonèau", "Babeth Rollonèau", "ROLLONÈAU Élisabeth", "É. Rollonèau", "Élisabbeth Rollonèau", "Babeth  Rollonneau", "�lisabeth Rollonèau"]
    twin, other = ["Michel Zelenlier", "ZELENLIER Michel"], ["Michèle Zelenlier", "Michele Zelenlier"]
    org = ["Pôle Ferutin d'hydrologie et volcanologie", "Pôle Ferutin d'hydrologie et volcanologie (PFHV)", "P.F.H.V.", "Ferutin, Pôle d'hydrologie et volcanologie", "Pôle Ferytin d'hydrologie et volcanologie"]
    alone = ["La rédaction", "Camille Coronnel"]
    assert resolve(spark, one + twin + other + org + alone + one) == all_pairs(one, twin, other, org)


def test_initials_that_fit_two_join_none(spark):
    assert resolve(spark, ["Claire Floon", "Carla Floon", "C. Floon"]) == set()


def test_merged_profile_matches_more(spark):
    # Short form and typo at once match no single spelling, only the merged person's combinations.
    many = [f"Isabelle {x}" for x in ("Karalo", "Vermot", "Pindrel", "Losquin", "Tarvek", "Bulgrin")]
    got = resolve(spark, [*many, "Isabelle Valleran", "Isa Valleran", "Isabelle Vallaran", "Isa Vallaran"])
    assert got == all_pairs(["Isabelle Valleran", "Isa Valleran", "Isabelle Vallaran", "Isa Vallaran"])


def test_nothing_to_name(spark):
    df = spark.createDataFrame([(None,), ("",), ("  ",), ("?!",), ("12",)], "auteur string")
    assert names.same_signatory(df).count() == 0
    assert names.signatories(df).count() == 2
    assert names.same_signatory(df.limit(0)).count() == 0


GIVEN = "Adele Bernard Claire Damien Edith Fabrice Gaspard Hortense Igor Jules Karim Laurent Mathilde Nestor Octave Pascal Quentin Raoul Sophie Thibault Ursule Victor Wanda Xavier Yasmine".split()


def test_common_surname(spark):
    # More than 20 partners, and more than any of its given names: initials and nicknames still meet the full name.
    got = resolve(spark, [*(f"{x} Martin" for x in GIVEN), "Zoé Martin", "Z. Martin", "Élisabeth Martin", "Babeth Martin"])
    assert got == all_pairs(["Zoé Martin", "Z. Martin"], ["Babeth Martin", "Élisabeth Martin"])


def test_large_block_finds_all_that_match():
    r = random.Random(3)
    base = [*names.NICKNAMES, *(x.lower() for x in GIVEN), "elisabeth", "isabelle", "isa", "mar", "martin", "martine", "marti?", "thomas"]

    def word():
        w = r.choice(base)
        i = r.randrange(len(w))
        return r.choice([w, w, w[:i] + w[i + 1 :] or w, w[:i] + r.choice("abe?") + w[i:], w[: max(i, 3)], w[:i] + w[i : i + 2][::-1] + w[i + 2 :]])

    for _ in range(20):
        block, surname = names.Block(), r.choice(base)
        for n in range(names.INDEXED * 4):
            p = ("p", [word(), r.choice([surname, surname, word()])], "", [], [r.randrange(30), r.randrange(30)])
            r.shuffle(p[1])
            want = [q for _, q in block.leaders if names.alike(p, q)]
            assert [q for _, q in block.near(p) if names.alike(p, q)] == want
            block.add(str(n), p)


def test_merged_profile_of_rare_names_matches_more(spark):
    # No word has many partners, and the last spelling is a neighbour of a combination only.
    pairs = [(["isabelle", "valleran"], [1, 2]), (["isa", "valleran"], [1, 2]), (["isabelle", "vallaran"], [1, 1])]
    assert {frozenset(p[1]) for p in names.combinations(pairs)} == {frozenset(("isa", "vallaran"))}
    group = ["Isabelle Valleran", "Isa Valleran", "Isabelle Vallaran", "Isa Vallarann"]
    assert resolve(spark, group) == all_pairs(group)


@pytest.mark.parametrize("n", [5, 50, 500])
def test_initials_meet_the_full_name_at_every_size(spark, n, monkeypatch):
    # One surname, many given names of other initials; blocks are split from four profiles on.
    monkeypatch.setattr(names, "SPLIT", 4)
    others = ["".join(x) for x in itertools.product("bcdfghjklmnpqrst", "aeiou", "blmnrst", ("on", "as"))][:n]
    got = resolve(spark, [*(f"{x.capitalize()} Kormandel" for x in others), "Zoé Kormandel", "Z. Kormandel"])
    assert ("Z. Kormandel", "Zoé Kormandel") in got


def test_split_blocks_lose_no_link(spark, monkeypatch):
    r = random.Random(9)
    spellings = sorted({f"{r.choice(['Zoé', 'Zoe', 'Zohra', 'Zacharie', 'Z.', 'Zélie', 'Zacharrie'])} {r.choice(['Kormandel', 'Kormandell', 'Kormmandel', 'Kormadel'])}" for _ in range(80)})
    whole = resolve(spark, spellings)
    monkeypatch.setattr(names, "SPLIT", 3)
    assert resolve(spark, spellings) == whole and whole


def test_initials_stay_with_the_cluster_that_fits_best(spark):
    # Once joined to the exact surname, they don't join the next best in another round.
    assert resolve(spark, ["Zoé Kormandel", "Z. Kormandel", "Zélie Kormadel"]) == {("Z. Kormandel", "Zoé Kormandel")}


def test_united():
    titles = [["ferutin", "hydrologie", "pole", "volcanologie"], ["ferytin", "hydrologie", "pole", "volcanologie"], ["ferutin", "hydrologei", "pole", "volcanologie"]]
    made = names.united([("o", t, "", a, []) for t, a in zip(titles, (["PFHV"], ["~PFHV"], ["~PFHV"]))])
    assert [p[1] for p in made] == [titles[1], titles[2], sorted(["ferytin", "hydrologei", "pole", "volcanologie"])] and all("PFHV" in p[3] for p in made)
    made = names.united([("p", ["zoe", "martin"], "", [], [1, 2]), ("p", ["zoe", "martinn"], "", [], [1, 1]), ("i", ["martin"], "zj", [], [0])])
    assert [p[:3] for p in made] == [("i", ["martinn"], "zj")]


def test_classes(spark):
    df = spark.createDataFrame([("Claire Floon",), ("Claire Floon",), ("FLOON Claire",), ("Autre Nom",), (None,), (" ",)], "auteur string")
    got = sorted((r.auteur, r.n_spellings, r.n_links, r.representative) for r in names.classes(df).collect())
    assert got == [("Autre Nom", 1, 0, "Autre Nom"), ("Claire Floon", 2, 1, "Claire Floon"), ("FLOON Claire", 2, 1, "Claire Floon")]
    assert names.classes(df.limit(0)).count() == 0
