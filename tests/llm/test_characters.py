import random

import pytest

from lutrin.llm import p06_encoding_damage as p6
from lutrin.llm import p07_lookalikes as p7
from lutrin.llm import queries as q

TEXT = "L'été à Noël : « où » est le cœur ? Ça coûte 3 € — dès février."


@pytest.mark.parametrize("codec", ["cp1252", "mac_roman", "cp437", "cp850", "cp1250"])
def test_utf8_read_as(codec):
    table = {b: c for c, b in p6._MAPS[codec].items()}
    bad = "".join(table.get(b, chr(b)) for b in TEXT.encode())
    assert p6.repair(bad) == (True, TEXT, True)
    twice = "".join(table.get(b, chr(b)) for b in bad.encode())
    if codec in ("cp1252",):
        assert p6.repair(twice)[1] == TEXT


@pytest.mark.parametrize("codec", ["mac_roman", "cp437", "cp1251"])
def test_single_byte_read_as(codec):
    text = "La démarche a été confrontée à la qualité du tribunal, même ancien"
    assert p6.repair(text.encode("cp1252").decode(codec))[:2] == (True, text)


@pytest.mark.parametrize("text", ["un sourire 😀 ici", "مرحبا بالعالم", "שלום עולם", "日本語のテキスト", "Việt Nam", "coché ✓ ou non", "наука и жизнь", "한국어 문장"])
@pytest.mark.parametrize("codec", ["cp1252", "mac_roman", "cp437", "latin-1"])
def test_every_alphabet(text, codec):
    table = {b: c for c, b in p6._MAPS[codec].items()}
    bad = "".join(table.get(b, chr(b)) for b in text.encode())
    assert p6.repair(bad) == (True, text, True)
    assert p6.repair(text) == (False, text, True)


@pytest.mark.parametrize("text", ["наука и жизнь", "日本語", "l'été", "prix : 3 €", "ελληνικά"])
def test_utf7(text):
    assert p6.repair(text.encode("utf-7").decode())[:2] == (True, text)


@pytest.mark.parametrize("text", ["a+bonjour", "C++ et C+Bonjour-", "+33123456789", "x+abcdefgh-", "CAFÉ» et «é…», «à»", "É»É»", "2+2222=2224"])
def test_no_chance_finds(text):
    assert p6.repair(text) == (False, text, True)


def test_in_places_only():
    assert p6.repair("été puis Ã©tÃ©")[1] == "été puis été"
    assert p6.repair("prot+AOk-ger l'+AOk-t+AOk")[1] == "protéger l'été"
    assert p6.repair("l'�t�") == (True, "l'�t�", False)
    assert p6.repair("prot?ger")[0] and p6.repair("une qualit? rare")[0]


@pytest.mark.parametrize("text", [None, "", TEXT, "Est-ce utile ? Oui.", "« Ångströmia » et « Łódzka »", "le mot russe « наука » et le grec « φάσμα »", "SÃO VALDIRO - PÂTE À MODELER", "14 m² pour 2ⁿ, soit ¾", "La marque Ombrellia® (© 2003) vise 10⁶ unités de CO₂", "Le соntеntіеuх", "+33 (0)1", "naïf", "É»"])
def test_not_damaged(text):
    assert p6.repair(text) == (False, text, True)


def test_automaton_against_decoder():
    r = random.Random(3)
    for _ in range(3000):
        data = bytes(r.choice([0xC3, 0xA9, 0xE2, 0x82, 0xAC, 0xF0, 0x9F, 0x98, 0x80, 0xED, 0xA0, 0xC0, 0xFF, 0xE0]) for _ in range(r.randrange(1, 9)))
        covered = [data[a:b] for a, b in p6.spans(list(data))]
        for x in covered:
            x.decode("utf-8")
        kept = "".join(x.decode("utf-8") for x in covered)
        assert kept == "".join(c for c in data.decode("utf-8", "replace") if c != "�")


def test_damage_frame(spark):
    rows = [(1, "Ã©tÃ©", None, "", "x"), (1, "Ã©tÃ©", None, "", "x"), (None, "a", "b", "lÃ\xa0", "x"), (2, "été" * 50_000, "t", "u", "x")]
    df = spark.createDataFrame(rows, "rec_id long, texte string, titre string, auteur string, field string")
    got = sorted(((r.rec_id or 0, r.field, r.repaired) for r in p6.damage(df).collect()))
    assert got == [(0, "auteur", "là"), (1, "texte", "été"), (1, "texte", "été")]
    assert p6.damage(df.limit(0)).count() == 0


@pytest.mark.parametrize(
    "text,want",
    [
        ("Ｌ＇ｅｎｊｅｕ　ici", "L'enjeu ici"), ("été", "été"), ("ac​cès﻿", "accès"), ("le\xa0mot :", "le mot :"), ("соntеntіеuх", "contentieux"),
        ("clımɑtıque ⅼoi", "climatique loi"), ("ﬁn eﬀet", "fin effet"), ("pare‑feu", "pare-feu"), ("prοpulsiοn", "propulsion"), ("\xadcoup\xadure", "coupure"), ("Аérodyne", "Aérodyne"),
    ],
)
def test_forms(text, want):
    assert p7.form(text) == want
    assert p7.form(want) == want


@pytest.mark.parametrize("text", [None, "", "Été", "ÉTÉ", "14 m² ₂ ½", "« наука » et « φάσμα »", "l’œuvre “x”…", "a\tb\nc", "Ångström Łódź", "10⁶ 2ⁿ ®"])
def test_forms_left_alone(text):
    assert p7.form(text) == text


@pytest.mark.parametrize(
    "text,want",
    [
        ("Ꮪcope", "Scope"), ("ꓐonjour", "Bonjour"), ("ᒪe juge", "Le juge"), ("ᎪᏢᏢᎬᏞ", "APPEL"), ("ꓡꓰ ꓐꓳꓠ", "LE BON"), ("ʟoi", "loi"), ("ɴoʙʟe", "noble"), ("ɪcɪ", "ici"), ("Ɩci", "Ici"), ("le сера", "le cepa"),
    ],
)
def test_other_alphabets(text, want):
    assert p7.form(text) == want and p7.disguised(text) and not p7.disguised(want)
    assert p7.skeleton(text) == p7.skeleton(want)


def test_words_of_an_alphabet_in_use_stay():
    # The Lisu word could be Latin, but the text has one that can't.
    assert p7.form("ꓡꓰ et ꓬꓺꓷ") == "ꓡꓰ et ꓬꓺꓷ" and p7.form("coefficient σ") == "coefficient σ"


def test_table_of_look_alikes():
    from lutrin.llm import confusables

    table = confusables.parse(confusables.find())
    assert len(table) > 6000 and table["а"] == "a" and table["ﬁ"] == "fi" and table["m"] == "rn" and "a" not in table
    with pytest.raises(ValueError):
        confusables.parse(b"\0\2" + bytes(40))
    # Each letter that has a plain one has its skeleton.
    assert all(p7.skeleton(c) == p7.skeleton(p7.letter(c)) for c in map(chr, range(0x80, 0x1FFFF)) if p7.letter(c))


def test_skeletons():
    same = ["scope", "ѕсоре", "sc​ope", "ｓｃｏｐｅ", "sсοpe"]
    assert len({p7.skeleton(x) for x in same}) == 1
    assert p7.skeleton("Scope") != p7.skeleton("scope") and p7.skeleton("scopé") == p7.skeleton("scopé") and p7.skeleton(None) is None


def test_frames(spark):
    rows = [(1, "соde", "x"), (2, "code", "x"), (3, None, "x"), (4, "", "x"), (5, "code", "x"), (None, "co​de", "x"), (6, "été", "x")]
    df = spark.createDataFrame(rows, "cand_id long, word string, form string")
    got = {(r.cand_id, r.form, r.changed) for r in p7.unified(df, "cand_id", ["word"]).collect()}
    assert (1, "code", True) in got and (2, "code", False) in got and (3, None, False) in got and (None, "code", True) in got and len(got) == 7
    groups = {r.skeleton: (r.n_forms, r.n_rows) for r in p7.same_looking(df, "word").collect()}
    assert groups["code"] == (3, 4) and groups[""] == (1, 1) and len(groups) == 3
    assert p7.unified(df.limit(0), "cand_id", ["word"]).count() == 0 == p7.same_looking(df.limit(0), "word").count()


def test_damage_is_spared(spark):
    df = spark.createDataFrame([(1, "Ã\xa0 la une"), (2, "à\xa0la une")], "rec_id long, titre string")
    assert [r.rec_id for r in p7.unified(df, "rec_id", ["titre"], only_changed=True).collect()] == [2]


def test_groups_of_all_fields(spark, tmp_path):
    articles = [(1, "Le соde", "Un tехte.\nFin"), (2, "Le code", "Un texte.\nFin"), (3, "Le code", None), (4, None, "")]
    spark.createDataFrame(articles, "rec_id long, titre string, texte string").write.parquet(f"{tmp_path}/articles.parquet")
    spark.createDataFrame([(1, "code"), (2, "соde"), (3, None)], "cand_id long, word string").write.parquet(f"{tmp_path}/candidates.parquet")
    got = {(r.tbl, r.field, r.original, r.skeleton, r.n_rows, r.n_forms) for r in q.p7_groups(spark, str(tmp_path)).collect()}
    assert got == {
        ("articles", "titre", "Le соde", "Le code", 1, 2), ("articles", "titre", "Le code", "Le code", 2, 2),
        ("articles", "texte", "Un tехte.\nFin", "Un texte.\nFin", 1, 2), ("articles", "texte", "Un texte.\nFin", "Un texte.\nFin", 1, 2), ("articles", "texte", "", "", 1, 1),
        ("candidates", "word", "code", "code", 1, 2), ("candidates", "word", "соde", "code", 1, 2),
    }
