"""Problem 1: variant spellings of names typed by people, resolved by merging and matching again.

Every spelling is parsed to a profile: of a person the words of the name and the initials, of an organisation the words of
its title and its acronyms. Profiles meet in blocks and are compared there. Profiles that match are merged: the merged one unites
the spellings, initials and acronyms of both, with every combination of a person's given names and surnames, of its initials
and surnames, and of two variants of an organisation's words. With those it enters the blocks again and may now match what neither
part matched alone. This repeats until a round merges nothing.

Initials and acronyms alone are weak: they join a profile only if no other one in the collection fits as well.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, map_rows, strip_marks
from .p06_encoding_damage import repair
from .p07_lookalikes import form

#: Titles before a name and words that introduce surnames. Fixed values.
TITLES = frozenset("mme mlle mr dr pr prof me mm monsieur madame docteur professeur".split())
PARTICLES = frozenset("de du des d le la les l von van et".split())
#: Additions that don't belong to a name. Fixed values.
NOTES = re.compile(r"\s*(?:\((?:corr|trad|coord|dir|red)\.?\)|[-–,]\s*(?:redaction|envoyee? speciale?|correspondante?|de notre correspondante?|pigiste|stagiaire|propos recueillis)\s*$)")
#: Kinds of organisation with their abbreviations. Fixed values.
HEADS = {
    "agence": ("ag",), "association": ("assoc", "asso"), "bureau": (), "centre": ("ctre", "ctr", "cent"), "comite": (), "ecole": ("ec",), "federation": ("fed",),
    "fondation": ("fond", "fdn"), "groupe": ("grp",), "groupement": ("grpt", "group", "gpt", "groupt"), "institut": ("inst",), "laboratoire": ("lab", "labo"),
    "observatoire": ("obs",), "office": ("off",), "pole": ("pol",), "reseau": ("res",), "societe": ("soc", "ste"), "syndicat": ("synd",), "unite": (), "universite": ("univ",),
}
#: Short forms of French given names that aren't their beginnings. Fixed values.
NICKNAMES = {
    "babeth": ("elisabeth",), "babette": ("elisabeth",), "lisa": ("elisabeth",), "guigui": ("guillaume",), "marilene": ("marie-helene",), "tom": ("thomas",), "tonio": ("antoine",),
    "toine": ("antoine",), "titi": ("thierry",), "manu": ("emmanuel", "emmanuelle"), "max": ("maxime",), "seb": ("sebastien",), "jeff": ("jean-francois",), "jojo": ("joseph",),
    "kiki": ("christophe", "christine"), "chris": ("christophe", "christine"), "cricri": ("christophe", "christine"), "lulu": ("lucie", "lucien"), "momo": ("maurice",), "nanou": ("anne",), "nono": ("arnaud",),
    "pierrot": ("pierre",), "pierro": ("pierre",), "py": ("pierre-yves",), "ritou": ("henri",), "sandy": ("sandrine",), "soso": ("sophie",), "vero": ("veronique",), "viv": ("viviane",), "zab": ("elisabeth",),
    "didi": ("didier",), "dede": ("andre",), "fanfan": ("francois", "francoise"), "fanch": ("francois",), "gege": ("gerard",), "jim": ("jean-marc",), "jano": ("jean-noel",), "lolo": ("laurent",),
    "ginou": ("genevieve", "virginie"), "jeanmi": ("jean-marc", "jean-michel"), "josy": ("josephine", "josiane"), "lili": ("aurelie", "elisabeth", "liliane"), "malou": ("marie-louise",), "mimi": ("michele", "michel"), "nath": ("nathalie",), "cathy": ("catherine",), "kathy": ("catherine",), "cath": ("catherine",), "beber": ("bernard",), "ber": ("bernard",), "benji": ("benjamin",),
}
#: Given names that go before another one. Fixed values.
DOUBLES = frozenset("jean marie anne pierre".split())
#: What turns a given name into its feminine; such neighbours are two people. Fixed values.
ENDINGS = ("e", "le", "ne", "te", "se", "ette", "ine")
#: Typing errors: for each partner of a word, so many others at most are written with an error in that word, which makes another word.
ERRORS = 0.05
#: Profiles of a block that one task compares; a larger block is split in groups, and each two of them compared by a task.
SPLIT = 2000
#: Persons of a block compared one by one; in larger blocks an index finds those that can match, with the same result.
INDEXED = 64


def distance(a: str, b: str, most: int = 1) -> int:
    """Edit distance with transpositions, or ``most`` + 1 if it is larger. A ? stands for one lost character; a word with one
    matches another that has some character there, and no further edit is allowed: what is lost could tell two names apart."""
    if a == b:
        return 0
    if "?" in a or "?" in b:
        return 0 if len(a) == len(b) and all(x == y or "?" in x + y for x, y in zip(a, b)) else most + 1
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, now = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(now[j] + 1, row[j - 1] + 1, now[j - 1] + (x != y))
            if before is not None and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            row.append(d)
        before, now = now, row
    return min(now[-1], most + 1)


def shortened(word: str) -> list[str]:
    """A word and what is left of it without one of its characters: words one edit apart share one of these."""
    word = word.replace("?", "")
    return [word] + ([word[:i] + word[i + 1 :] for i in range(len(word)) if i == 0 or word[i] != word[i - 1]] if len(word) > 3 else [])


def _head(word: str) -> str | None:
    word = word.rstrip(".")
    for h, short in HEADS.items():
        if word == h or word in short:
            return h
    return next((h for h in HEADS if len(h) > 3 and word[:1] and distance(word, h) <= 1), None)


def parse(auteur: str) -> tuple[str, list[str], str, list[str]]:
    """(kind, words, initials, acronyms) of a spelling. kind: 'p' a person of two words or more, 'i' one of a word and
    initials, 's' of one word, 'o' an organisation, 'a' an acronym, '' nothing that could be a name."""
    text = form(repair(auteur)[1]).strip()
    text = re.sub(r"�+|(?<=\w)\?+|\?+(?=\w)", "?", text)
    bare = re.sub(r"[\s.]", "", text)
    if re.fullmatch(r"[A-Z]{3,8}", bare) and (re.fullmatch(r"(?:[A-Z]\.\s?)+[A-Z]?", text) or len(bare) <= 6 and " " not in text):
        return "a", [], "", [bare]
    acronyms, fields = [], ""
    for inside in re.findall(r"\(([^()]*)\)", text):
        if re.fullmatch(r"[A-Z]\.?(?:\s?[A-Z]\.?){2,7}", inside.strip()):
            acronyms.append(re.sub(r"[\s.]", "", inside))
        elif "," in inside or " et " in inside or " & " in inside:
            fields += " " + inside
    folded = strip_marks(text)
    base = NOTES.sub("", folded)
    base = re.sub(r"\([^()]*\)", " ", base) + strip_marks(fields)
    words = [w for w in re.findall(r"[a-z?0-9]+(?:-[a-z?0-9]+)*\.?", base.replace("'", " ").replace("’", " "))]
    at = next((i for i, w in enumerate(words) if _head(w)), None)
    rest = [w.rstrip(".") for i, w in enumerate(words) if i != at and w.rstrip(".") not in PARTICLES]
    if at is not None and at <= 1 and len(rest) >= 2 and (re.search(r" et |&|\(|,| d[e']\b|\bd'", folded) or words[at].endswith(".") or _head(words[at]) != words[at] or len(rest) > 2):
        head = _head(words[at])
        if not acronyms:  # what it would be: initials of all words, or without the second word of the last field
            made = "~" + head[0].upper() + "".join(w[0] for w in rest).upper()
            acronyms += [made, made[:-1]] if len(rest) > 3 else [made]
        return "o", sorted([head, *(p for w in rest for p in w.split("-"))]), "", acronyms
    # A person. Initials are found in the spelling itself, where capitals tell them from short words.
    plain = re.sub(r"\([^()]*\)", " ", text)
    while (m := NOTES.search(strip_marks(plain))) and m.start() > 0 and len(strip_marks(plain)) == len(plain):
        plain = plain[: m.start()]
    if "," in plain:
        plain = " ".join(reversed(plain.split(",", 1)))
    tokens, initials = [], ""
    plain = re.sub(r"\b([Dd]e|[Dd]u|[Dd]es|[Ll]e|[Ll]a)(?=[A-ZÀ-ÖØ-Þ][a-zà-ÿ])", r"\1 ", plain)
    for t in re.findall(r"\S+", re.sub(r"(?<=\.)(?=[A-ZÀ-ÖØ-Þ]\.)", " ", plain)):
        low = strip_marks(t).strip(".,;:")
        letters = [x for x in re.split(r"[.\-\s]+", t) if x]
        if all(len(x) == 1 and x.isalpha() for x in letters) and letters:
            initials += "".join(map(strip_marks, letters))
        elif re.fullmatch(r"[A-ZÀ-ÖØ-Þ]{2}", t) and not plain.isupper():
            initials += low
        elif low in TITLES or low in PARTICLES or not re.search(r"[a-z?]", low):
            continue
        else:
            tokens.append(re.sub(r"^(?:d|l)['’]", "", low))
    for i, t in enumerate(tokens[:-1]):
        if t in DOUBLES and len(tokens) > 2:
            tokens[i : i + 2] = [f"{t}-{tokens[i + 1]}"]
            break
    tokens = [t for t in tokens if t not in ("redaction", "corr")] or tokens
    if len(tokens) >= 2:
        if len(tokens) > 2:  # the longest spelling of a surname in several words
            tokens = [tokens[0], "-".join(tokens[1:])]
        return "p", tokens, "", []
    if tokens and initials:
        return "i", tokens, initials, []
    return ("s", tokens, "", []) if tokens else ("", [], initials, [])


def profile_key(kind: str, words: list[str], initials: str, acronyms: list[str]) -> str:
    """Equal for spellings that differ in case, accents, order, titles, notes and hyphens only."""
    if kind == "a":
        return "a " + acronyms[0]
    return kind + " " + " ".join(sorted(p for w in words for p in w.split("-"))) + (" " + initials if initials else "")


def initials_of(given: str) -> str:
    return "".join(p[0] for p in given.split("-") if p)


def established(px: int, py: int) -> bool:
    """Whether the rarer of two neighbouring words has more partners than errors in the other would bring it: more than the
    upper bound, three deviations and three, of a Poisson count of that mean. So it is a name in its own right."""
    errors = ERRORS * max(px, py)
    return min(px, py) > errors + 3 * errors**0.5 + 3


def conflict(x: str, px: int, y: str, py: int) -> bool:
    """Whether two neighbouring words are both names in their own right, not one the typo or short form of the other."""
    if established(px, py):
        return True
    a, b = sorted((x, y), key=len)
    return b.startswith(a) and b[len(a) :] in ENDINGS


def short_for(x: str, px: int, y: str, py: int) -> bool:
    """Whether one given name is a short form of the other: known as one, or its beginning and rarer in names."""
    a, b = sorted((x, y), key=len)
    if b in NICKNAMES.get(a, ()) or a in NICKNAMES.get(b, ()):
        return True
    if established(px, py) and min(px, py) >= 0.6 * max(px, py):
        return False
    return len(a) >= 3 and len(b) - len(a) >= 2 and b.startswith(a) and b[len(a) :] not in ENDINGS and b[len(a)] != "-" and "-" not in a


Payload = tuple[str, list[str], str, list[str], list[int]]


def pack(p: Payload) -> str:
    return "\t".join((p[0], " ".join(p[1]), p[2], " ".join(p[3]), " ".join(map(str, p[4]))))


def unpack(s: str) -> Payload:
    kind, words, initials, acronyms, partners = s.split("\t")
    return kind, words.split(), initials, acronyms.split(), [int(x) for x in partners.split()]


def alike(p: Payload, q: Payload) -> bool:
    """Whether two persons or two organisations match strongly."""
    if p[0] != q[0]:
        return False
    if p[0] == "o":
        a, b = list(p[1]), list(q[1])
        for w in p[1]:
            if w in b:
                a.remove(w)
                b.remove(w)
        return len(a) == len(b) == 0 or len(a) == len(b) == 1 and min(len(a[0]), len(b[0])) > 3 and distance(a[0], b[0]) <= 1 or len(a) == len(b) > 0 and all("?" in x + y and distance(x, y, 0) == 0 for x, y in zip(a, b))
    if p[0] == "s":
        return p[1] == q[1] or len(p[1][0]) > 5 and distance(p[1][0], q[1][0]) <= 1
    if p[0] != "p":
        return False
    (a, b), (pa, pb) = p[1], p[4]
    for (c, d), (pc, pd) in ((q[1], q[4]), (q[1][::-1], q[4][::-1])):
        for (x, px, y, py), (u, v) in (((a, pa, c, pc), (b, d)), ((b, pb, d, pd), (a, c))):
            if u == v or "?" in u + v and distance(u, v, 0) == 0:
                if x == y or "?" in x + y and distance(x, y, 0) == 0:
                    return True
                if short_for(x, px, y, py):
                    return True
                if min(len(x), len(y)) > 3 and distance(x, y) <= 1 and not conflict(x, px, y, py):
                    return True
    return False


def weak(p: Payload, q: Payload) -> int | None:
    """How far a profile of initials or an acronym ``p`` is from a full one ``q``: 0, 1, or None if it doesn't fit."""
    if p[0] == "a" and q[0] == "o":
        return 0 if p[3][0] in q[3] else 1 if "~" + p[3][0] in q[3] else None
    if p[0] == "i" and q[0] == "p":
        for given, name in (q[1], q[1][::-1]):
            own = initials_of(given)
            if p[2] == own or p[2] == own[:1] or len(p[2]) > len(own) and p[2].startswith(own):
                d = distance(p[1][0], name)
                if d == 0 or d == 1 and len(name) > 4:
                    return d
    return None


def keys(p: Payload) -> set[str]:
    """Blocks a profile enters. Either word of a person may be the surname, so both meet the other's initial, however many
    partners they have."""
    kind, words, initials, acronyms, _ = p
    if kind == "a":
        return {"a " + acronyms[0]}
    if kind == "o":
        return {"o " + " ".join(words[:i] + words[i + 1 :]) for i in range(len(words))} | {"a " + a.lstrip("~") for a in acronyms} | {"q " + _bare(words)}
    if kind == "s":
        return {"s " + x for x in shortened(words[0])}
    if kind == "i":
        return {f"i {x} {initials[0]}" for x in shortened(words[0])}
    a, b = words
    out = {f"p {x} {b.replace('?', '')}" for x in shortened(a)} | {f"p {x} {a.replace('?', '')}" for x in shortened(b)}
    for name, given in ((a, b), (b, a)):
        firsts = {given[0], *(full[0] for full in NICKNAMES.get(given, ()))}
        out |= {f"i {x} {f}" for x in shortened(name) for f in firsts}
    return out | {"q " + _bare(words)}


def _bare(words: list[str]) -> str:
    """What damage by a lost character leaves of a word for certain: its consonants but the last."""
    return " ".join(sorted(re.sub(r"[aeiouyc?-]", "", w) for w in words))


def _near(word: str) -> tuple[set[str], set[str]]:
    """(what a word is kept under, what it is looked up by): equal words, words one edit apart and short forms share one."""
    same = {"=" + x for x in shortened(word)} | {"~" + x for x in (word, *NICKNAMES.get(word, ()))}
    begins = [word[:k] for k in range(3, len(word))]
    return same | {"<" + word, *(">" + x for x in begins)}, same | {">" + word, *("<" + x for x in begins)}


class Block:
    """Full profiles of a block in order, and those of them a profile can match."""

    def __init__(self):
        self.leaders: list[tuple[str, Payload]] = []
        self.index: dict[tuple[str, str], list[int]] = {}
        self.damaged: list[int] = []
        self.done = 0

    def add(self, cid: str, p: Payload) -> None:
        self.leaders.append((cid, p))

    def near(self, p: Payload) -> list[tuple[str, Payload]]:
        """All leaders that are alike, and few others. Persons that match have a word in common and the other words near
        each other, unless one is damaged."""
        if len(self.leaders) <= INDEXED or p[0] != "p" or "?" in "".join(p[1]):
            return self.leaders
        for i in range(self.done, len(self.leaders)):
            kind, words = self.leaders[i][1][:2]
            if kind == "p" and "?" in "".join(words):
                self.damaged.append(i)
            elif kind == "p":
                for same, other in (words, words[::-1]):
                    for k in _near(other)[0]:
                        self.index.setdefault((same, k), []).append(i)
        self.done = len(self.leaders)
        found = set(self.damaged)
        for same, other in (p[1], p[1][::-1]):
            for k in _near(other)[1]:
                found.update(self.index.get((same, k), ()))
        return [self.leaders[i] for i in sorted(found)]


def _profiles(auteurs: DataFrame) -> DataFrame:
    """(auteur, vid, kind, words, initials, acronyms) of each different spelling."""

    def make():
        def run(parts: Iterator[dict[str, list]]) -> Iterator[list[tuple]]:
            for part in parts:
                rows = []
                for s in part["auteur"]:
                    p = parse(s)
                    rows.append((s, profile_key(*p) if p[0] else "? " + s, p[0], p[1], p[2], p[3]))
                yield rows

        return run

    return map_rows(auteurs, "auteur string, vid string, kind string, words array<string>, initials string, acronyms array<string>", make)


def _blocks(profiles: DataFrame) -> DataFrame:
    """Comparisons within blocks: rows (vid, a, b, far) of a profile, its cluster and one it meets; far is -1 for a strong match.

    Blocks stream by in order, full profiles first. Equal spellings are one profile by then and a block's key is most of a name
    or a word and an initial; in large blocks only profiles that can match are compared. A profile gives one link for each cluster it
    matches, never one for each pair. No task holds more than about two groups of SPLIT profiles: the profiles of a block beyond that
    are spread over groups by their hash, and each enters with its own group and with every other.
    """

    def enter():
        def run(parts: Iterator[dict[str, list]]) -> Iterator[list[tuple]]:
            for part in parts:
                rows = []
                for cid, vid, payload in zip(part["cid"], part["vid"], part["payload"]):
                    p = unpack(payload)
                    rank = 0 if p[0] in "pos" else 1
                    rows += [(k, rank, vid, cid, payload) for k in keys(p)]
                yield rows

        return run

    def meet():
        def run(parts: Iterator[dict[str, list]]) -> Iterator[list[tuple]]:
            block, full = None, Block()
            for part in parts:
                out = []
                for key, vid, cid, payload in zip(part["key"], part["vid"], part["cid"], part["payload"]):
                    if key != block:
                        block, full = key, Block()
                    p = unpack(payload)
                    if p[0] in "ia":
                        seen = set()
                        for other, q in full.leaders:
                            d = weak(p, q)
                            if d is not None and (other, d) not in seen:
                                seen.add((other, d))
                                out.append((vid, cid, other, d))
                        continue
                    # One link to each cluster it matches. It stays itself, as it may match what the earlier ones don't.
                    linked = {cid}
                    for other, q in full.near(p):
                        if other not in linked and alike(p, q):
                            linked.add(other)
                            out.append((vid, cid, other, -1))
                    full.add(cid, p)
                yield out

        return run

    entered = cut(map_rows(profiles.select("cid", "vid", "payload"), "key string, rank int, vid string, cid string, payload string", enter))
    large = entered.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > SPLIT)
    groups = F.ceil(F.coalesce("n", F.lit(1)) / SPLIT).cast("int")
    spread = entered.join(large, "key", "left").withColumn("own", F.pmod(F.xxhash64("vid"), groups).cast("int"))
    spread = spread.withColumn("with", F.explode(F.sequence(F.lit(0), groups - 1)))
    spread = spread.withColumn("key", F.concat_ws("\t", "key", F.least("own", "with").cast("string"), F.greatest("own", "with").cast("string")))
    ordered = spread.select("key", "rank", "vid", "cid", "payload").repartition("key").sortWithinPartitions("key", "rank", "vid")
    return map_rows(ordered, "vid string, a string, b string, far int", meet)


def _components(edges: DataFrame) -> DataFrame:
    """(node, label): the least node of each component, by label spreading with pointer jumping; rounds until nothing changes."""
    both = cut(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = cut(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("label")).select(F.col("a").alias("node"), "label"))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near.withColumnRenamed("a", "node"), "node").select("node", F.least("label", "near").alias("next"), "label")
        jump = labels.select(F.col("node").alias("next"), F.col("label").alias("far"))
        new = cut(step.join(jump, "next", "left").select("node", F.least("next", "far").alias("label"), (F.least("next", "far") != F.col("label")).alias("moved")))
        labels = new.select("node", "label")
        if new.filter("moved").isEmpty():
            return labels


def signatories(articles: DataFrame, col: str = "auteur") -> DataFrame:
    """(auteur, signatory): each different non-blank spelling with the id of its entity, the same for all that name it.

    Null, empty and blank values name nobody and are left out; spellings without a letter stand for themselves. Repeated rows
    count once: spellings are made distinct before anything else, so a name in a third of all rows is one row here.
    """
    spellings = articles.filter(F.length(F.trim(F.col(col))) > 0).select(F.col(col).alias("auteur")).distinct()
    # Parsing is work for Python, not bytes to move: adaptive execution would put all spellings into one task.
    parsed = cut(_profiles(spellings.repartition(spellings.sparkSession.sparkContext.defaultParallelism)))
    profiles = parsed.groupBy("vid").agg(F.first("kind").alias("kind"), F.min("words").alias("words"), F.min("initials").alias("initials"), F.array_distinct(F.flatten(F.collect_set("acronyms"))).alias("acronyms")).filter("kind != ''")
    # Partners of a word: with how many different words it makes up names, damaged ones aside.
    pairs = profiles.filter("kind = 'p' and not contains(vid, '?')").select(F.col("words")[0].alias("x"), F.col("words")[1].alias("y"))
    partners = pairs.union(pairs.select("y", "x")).groupBy("x").agg(F.count_distinct("y").alias("n"))
    for i in (0, 1):
        profiles = profiles.withColumn("word", F.get("words", F.lit(i)))
        profiles = profiles.join(partners.select(F.col("x").alias("word"), F.col("n").alias(f"n{i}")), "word", "left").drop("word")
    counts = F.concat_ws(" ", F.coalesce("n0", F.lit(0)).cast("string"), F.coalesce("n1", F.lit(0)).cast("string"))
    payload = F.concat_ws("\t", "kind", F.array_join("words", " "), "initials", F.array_join("acronyms", " "), counts)
    known = cut(profiles.select("vid", F.col("vid").alias("cid"), payload.alias("payload")))
    while True:
        # Merged profiles enter with all combinations of their given names and surnames.
        found = cut(_blocks(known.unionByName(_combined(known))))
        strong = found.filter("far < 0 and a != b").select("a", "b")
        if strong.isEmpty():
            # Initials and acronyms: only where a single cluster fits best, their own among them.
            fits = found.filter("far >= 0").groupBy("vid", "a", "b").agg(F.min("far").alias("far"))
            best = fits.groupBy("vid", "a").agg(F.min("far").alias("least"))
            only = fits.join(best, ["vid", "a"]).filter("far = least").groupBy("vid", "a").agg(F.count("*").alias("n"), F.min("b").alias("b"))
            strong = only.filter("n = 1 and a != b").select("a", "b").distinct()
            if strong.isEmpty():
                break
        labels = _components(strong)
        known = cut(known.join(labels.withColumnRenamed("node", "cid"), "cid", "left").select("vid", F.coalesce("label", "cid").alias("cid"), "payload"))
    return parsed.join(known.select("vid", "cid"), "vid", "left").select("auteur", F.coalesce("cid", "vid").alias("signatory"))


def combinations(pairs: list[tuple[list[str], list[int]]]) -> list[Payload]:
    """Each given name of a merged person with each of its surnames, without the pairs there are.

    Which word is the given name needn't be known: a word of most partners and those that are forms of it are one side, the words
    beside them the other. Both sides lead once, as the forms of one may tell pairs apart that those of the other don't.
    """
    words = {w: n for ws, ns in pairs for w, n in zip(ws, ns)}
    known = {frozenset(ws) for ws, _ in pairs}
    made: dict[frozenset[str], Payload] = {}

    def sides(lead: str) -> tuple[set[str], set[str]]:
        own, others = {lead}, set()
        for ws, _ in pairs:
            like = [w == lead or short_for(w, words[w], lead, words[lead]) or len(w) > 3 and distance(w, lead) <= 1 for w in ws]
            if sum(like) == 1:
                own.add(ws[like.index(True)])
                others.add(ws[like.index(False)])
        return own, others

    def most(some: Iterable[str]) -> str:
        return max(some, key=lambda w: (words[w], w))

    first = sides(most(words))
    for own, others in (first, sides(most(first[1]))[::-1]) if first[1] else ():
        for g in sorted(own):
            for s in sorted(others):
                if g != s and frozenset((g, s)) not in known:
                    made.setdefault(frozenset((g, s)), ("p", [g, s], "", [], [words[g], words[s]]))
    return list(made.values())


def variants(titles: list[list[str]]) -> list[list[str]]:
    """Of an organisation's titles, sorted words each: the most common with two of its words at once as another title has them."""
    lead = max(titles, key=lambda t: (sum(len(t) == len(u) and len(set(t) - set(u)) <= 1 for u in titles), t))
    slots: dict[int, set[str]] = {}
    for t in titles:
        gone, new = [w for w in lead if w not in t], [w for w in t if w not in lead]
        if len(t) == len(lead) and len(gone) == len(new) == 1:
            slots.setdefault(lead.index(gone[0]), set()).add(new[0])
    known, made = {tuple(t) for t in titles}, set()
    for i in slots:
        for j in slots:
            if i < j:
                for x in slots[i]:
                    for y in slots[j]:
                        t = list(lead)
                        t[i], t[j] = x, y
                        made.add(tuple(sorted(t)))
    return [list(t) for t in sorted(made - known)]


def united(payloads: list[Payload]) -> list[Payload]:
    """The profiles a merged entity has beside those of its parts."""
    persons, titles = [p for p in payloads if p[0] == "p"], [p for p in payloads if p[0] == "o"]
    made = combinations([(p[1], p[4]) for p in persons]) if len(persons) > 1 else []
    # Typed initials with every surname: the words beside given names that begin with them.
    words = {w: n for p in persons for w, n in zip(p[1], p[4])}
    typed = {(p[1][0], p[2]) for p in payloads if p[0] == "i"}
    for initials in sorted({i for _, i in typed}):
        for name in sorted({w for p in persons for w, given in (p[1], p[1][::-1]) if initials[0] == given[0] and any(distance(w, t) <= 1 for t, _ in typed)}):
            if (name, initials) not in typed:
                made.append(("i", [name], initials, [], [words[name]]))
    acronyms = sorted({a for p in titles for a in p[3] if a[0] != "~"} | {p[3][0] for p in payloads if p[0] == "a"})
    for p in titles:
        if not set(acronyms) <= set(p[3]):
            made.append(("o", p[1], "", sorted({*p[3], *acronyms}), p[4]))
    if len(titles) > 1:
        made += [("o", t, "", acronyms, []) for t in variants([p[1] for p in titles])]
    return made


def _combined(known: DataFrame) -> DataFrame:
    """New profiles of merged entities, for the next round. The spellings of one entity are one row here."""
    merged = known.groupBy("cid").agg(F.sort_array(F.collect_set("payload")).alias("payloads")).filter(F.size("payloads") > 1)

    def make():
        def run(parts: Iterator[dict[str, list]]) -> Iterator[list[tuple]]:
            for part in parts:
                yield [(profile_key(*p[:4]) + " +", cid, pack(p)) for cid, payloads in zip(part["cid"], part["payloads"]) for p in united([unpack(x) for x in payloads])]

        return run

    return map_rows(merged, "vid string, cid string, payload string", make)


def classes(articles: DataFrame, col: str = "auteur") -> DataFrame:
    """(auteur, signatory, n_spellings, n_links, representative): each different spelling with its entity, how many spellings that has,
    how many of them this one is linked with, and the one of them in most rows (of equal ones the least). Left out as in ``signatories``."""
    counts = articles.filter(F.length(F.trim(F.col(col))) > 0).groupBy(F.col(col).alias("auteur")).agg(F.count("*").alias("n"))
    named = signatories(articles, col).join(counts, "auteur")
    each = named.groupBy("signatory").agg(F.count("*").alias("n_spellings"), F.min(F.struct((-F.col("n")).alias("n"), "auteur")).alias("first"))
    found = named.join(each, "signatory")
    return found.select("auteur", "signatory", "n_spellings", (F.col("n_spellings") - 1).alias("n_links"), F.col("first.auteur").alias("representative"))


def same_signatory(articles: DataFrame, col: str = "auteur") -> DataFrame:
    """(auteur_a, auteur_b): each pair of different spellings of one signatory, ``auteur_a`` first by code point."""
    a = signatories(articles, col)
    left, right = a.select("signatory", F.col("auteur").alias("auteur_a")), a.select("signatory", F.col("auteur").alias("auteur_b"))
    return left.join(right, "signatory").filter("auteur_a < auteur_b").select("auteur_a", "auteur_b")
