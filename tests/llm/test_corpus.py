import os
import random

import numpy as np
import pytest

from lutrin.llm import p08_encoding as p8
from lutrin.llm import p09_leaks as p9
from lutrin.llm import p10_repetition as p10
from lutrin.llm import queries as q

TEXTS = ["", "a", "Le four à micro-ondes, c'est l'été !", " " * 700, "a" * 1500, "é" * 900, "日本語のテキスト" * 60, "👩‍💻🙂" * 80, "\t\r\n x\n\n", "<|endoftext|> 1234567", "ab" * 800 + "c" * 300]


@pytest.fixture(scope="module")
def ranks():
    if not os.path.exists(p8.default_path()):
        pytest.skip("no vocabulary here")
    return p8.load_ranks(p8.default_path())


@pytest.fixture(scope="module")
def public(ranks):
    tiktoken = pytest.importorskip("tiktoken")
    return tiktoken.Encoding("own", pat_str=p8.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_transducer(ranks, public):
    t = p8.Transducer(ranks)
    r = random.Random(5)
    texts = TEXTS + ["".join(r.choice("abeé ,'") for _ in range(r.randrange(1, 900))) for _ in range(60)]
    for text in texts:
        data = text.encode()
        whole = [i for piece in p8_pieces(text) for i in t.encode(piece.encode())]
        assert whole == public.encode_ordinary(text)
        size = r.randrange(1, 9)
        blocks = [data[i : i + size] for i in range(0, len(data), size)]
        assert [i for some in t.stream(iter(blocks)) for i in some] == (public._encode_single_piece(data) if data else [])


def p8_pieces(text):
    import regex

    return regex.findall(p8.PATTERN, text)


def test_tokens_come_before_the_end(ranks):
    t = p8.Transducer(ranks)
    first = next(t.stream(iter([b"ab" * 400, b"ab" * 400])))
    assert first and sum(len(t.bytes_of[i]) for i in first) <= 1600


def test_encode_frame(spark, ranks, public):
    rows = [(i, t, 7) for i, t in enumerate(TEXTS)] + [(None, "x", 7), (1, "a", 7), (99, None, 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    got = [(r.doc_id, r.ids) for r in p8.encode_corpus(df).collect()]
    want = [(i, public.encode_ordinary(t or "")) for i, t, _ in rows]
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert sorted(got, key=key) == sorted(want, key=key)
    back = {r.doc_id: r.text for r in p8.decode_corpus(p8.encode_corpus(df.filter("text is not null"))).collect()}
    assert all(back[i] == t for i, t in enumerate(TEXTS))
    assert p8.encode_corpus(df.limit(0)).count() == 0


def test_decoder_waits_for_whole_characters(ranks):
    d = p8.Decoder({0: b"\xe2\x82", 1: b"\xac", 2: b"x"})
    assert [d.feed(0), d.feed(1), d.feed(2), d.end()] == ["", "€", "x", ""]


def machine(patterns, length):
    shifts, pairs = {}, []
    for p in patterns:
        own, pair = p9.WuManber.entries(list(p))
        pairs.append(pair)
        for slot, n in own:
            shifts[slot] = min(n, shifts.get(slot, n))
    return p9.WuManber(shifts, pairs, length)


@pytest.mark.parametrize("bits", [(22, 24), (3, 4)])
def test_wu_manber_against_search(bits, monkeypatch):
    # With tables far too small for the patterns more is selected, but nothing is lost.
    monkeypatch.setattr(p9, "SHIFT_BITS", bits[0])
    monkeypatch.setattr(p9, "PAIR_BITS", bits[1])
    r = random.Random(2)
    for _ in range(100 if bits[0] < 9 else 10):
        patterns = {tuple(r.choice("abc") for _ in range(4)) for k in range(r.randrange(1, 12))}
        words = [r.choice("abc") for _ in range(r.randrange(40))]
        found = {p for p in patterns if any(tuple(words[i : i + 4]) == p for i in range(len(words)))}
        assert {p for p in map(tuple, machine(patterns, 4).selected(words)) if p in patterns} == found


ITEM = "Quel lien unit l'été puis la greffe lorsque Ulmo confirme nettement 551 fois la PME du Nord ?"


def test_leaks(spark):
    items = spark.createDataFrame([(1, ITEM, "x"), (2, None, "x"), (3, "", "x"), (4, "trop court pour fuir", "x"), (5, ITEM, "x"), (None, ITEM, "x")], "item_id long, text string, doc_id string")
    rows = [
        (1, "Avant. " + ITEM + " Après."), (2, "QUEL LIEN UNIT L’ETE, puis — la   greffe\nlorsque Ulmo"), (3, "unit l'été puis la greffe lorsque Ulmo confirme"), (4, "quel lien unit la greffe puis l'été lorsque Ulmo confirme fois 551"),
        (5, "Quel <b>lien</b> unit **l'été** puis [la](http://x.y/z) greffe lorsque Ulmo confirme"), (6, None), (7, ""), (None, ITEM), (8, "mot " * 60_000 + ITEM), (1, "Avant. " + ITEM), (9, "Quel lien u​nit l'été puis la greffe lorsque Ulmo confirme"),
    ]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, item_id int")
    got = {(r.doc_id, r.item_id) for r in p9.leaks(docs, items).collect()}
    assert got == {(d, i) for d in (1, 2, 5, 8, 9) for i in (1, 5)}
    assert p9.leaks(docs.limit(0), items).count() == 0 == p9.leaks(docs, items.limit(0)).count()


def test_markup_of_any_length():
    want = "quel lien unit l ete puis la greffe lorsque ulmo confirme".split()
    long = "x" * 900
    for text in (
        f'Quel <b style="{long}">lien</b> unit l\'été puis la greffe lorsque Ulmo confirme',
        f"Quel lien unit l'été puis [la](http://{long}) greffe lorsque Ulmo confirme",
        f"Quel lien unit l'été puis [url={long}]la[/url] greffe lorsque Ulmo confirme",
        "Quel&nbsp;lien unit l&rsquo;&eacute;t&#xE9; puis la greffe lors&shy;que &#00085;lmo confirme",
    ):
        assert want in p9.word_views(text)
    # An item's entities are its letters as well, and a bare sign or an overlong number is no entity.
    assert p9.word_views("AT&T &#" + "9" * 5000 + "; &x")[0] == p9.word_views("AT&T &#" + "9" * 5000 + "; &x")[-1]


def test_many_items(spark):
    words = [f"w{i}" for i in range(40)]
    r = random.Random(8)
    texts = [" ".join(r.choice(words) for _ in range(14)) for _ in range(300)]
    items = spark.createDataFrame(list(enumerate(texts)), "item_id long, text string").repartition(3)
    docs = spark.createDataFrame([(k, f"avant {texts[k]} apres" if k % 3 else texts[k][:20]) for k in range(300)], "doc_id long, text string")
    assert {(x.doc_id, x.item_id) for x in p9.leaks(docs, items).collect()} == {(k, k) for k in range(300) if k % 3}
    with pytest.raises(ValueError):
        p9.leaks(docs, items, min_words=2)


def brute_share(words, run=5):
    inside = set()
    for i in range(len(words) - run + 1):
        if any(words[j : j + run] == words[i : i + run] for j in range(i)):
            inside.update(range(i, i + run))
    return len(inside) / len(words) if words else 0.0


def test_share():
    r = random.Random(4)
    for _ in range(200):
        words = [r.choice("ab" if r.random() < 0.5 else "abcdefgh") for _ in range(r.randrange(30))]
        assert p10.repeated_share(words) == pytest.approx(brute_share(words))


def labelled(texts):
    rows = [r for t in texts for r in p10.labelled(t)]
    return np.array([x for x, _ in rows], dtype=float), np.array([y for _, y in rows])


def test_learned_list(spark):
    r = random.Random(6)
    vocabulary = [f"mot{i}" for i in range(400)]
    texts = [" ".join(r.choice(vocabulary) + r.choice(["", "", ".", "\n"]) for _ in range(r.randrange(30, 300))) for _ in range(300)]
    x, y = labelled(texts[:200])
    rules = p10.learn(x, y)
    assert rules and not any(p10._covers(rule, x[~y]).any() for rule in rules)
    # On texts held out: none that repeats is cleared, most others are.
    x, y = labelled(texts[200:])
    cleared = np.zeros(len(x), dtype=bool)
    for rule in rules:
        cleared |= p10._covers(rule, x)
    assert (cleared & ~y).sum() <= 0.01 * (~y).sum() and (cleared & y).sum() > 0.9 * y.sum()
    # The same as one Spark expression.
    rows = [tuple(float(v) for v in row[:-1]) + (int(row[-1]),) for row in x]
    df = spark.createDataFrame(rows, p10.KINDS)
    assert [k.k > 0 for k in df.select(p10.as_column(rules).alias("k")).collect()] == cleared.tolist()
    assert df.select(p10.as_column([]).alias("k")).first().k == 0 and p10.learn(x[:0], y[:0]) == [] == p10.learn(x[~y], y[~y])


def test_conjunctions():
    # What two thresholds together tell apart takes a rule of both.
    rng = np.random.default_rng(1)
    x = rng.random((600, len(p10.MEASURES)))
    y = (x[:, 1] < 0.5) & (x[:, 4] > 0.3)
    rules = p10.learn(x, y)
    assert {(m, op) for m, op, _ in rules[0]} == {("sentence_share", "<="), ("distinct_share", ">=")}
    assert not any(p10._covers(rule, x[~y]).any() for rule in rules)


def test_repetitive(spark):
    phrase = "le tribunal nuance encore le décret du nord "
    rows = [(1, phrase * 6), (2, phrase + "et rien d'autre ne se répète ici"), (3, None), (4, ""), (5, "mot"), (None, phrase * 6), (1, phrase * 6), (6, phrase.upper() + phrase.replace(" ", ", ")), (7, " ".join(str(i) for i in range(50_000)))]
    df = spark.createDataFrame([(*r, 1, 2.0) for r in rows], "doc_id long, text string, rule int, repeated_share double")
    assert sorted(r.doc_id for r in p10.repetitive(df).collect()) == [1, 6]
    assert p10.repetitive(df.limit(0)).count() == 0
    assert p10.measures(df).count() == len(rows) == p10.shares(df).count()
    assert p10.measure(None) == p10.measure("?!") == (0.0,) * 6 + (0,)


@pytest.mark.parametrize("name", sorted(set(q.queries()) - set(q.oracle_sql())))
def test_queries_run(name, spark, sf):
    df = q.queries()[name](spark, sf)
    assert df.count() >= 0
    if name == "p8_ids":
        assert df.columns == ["doc_id", "ids"]
