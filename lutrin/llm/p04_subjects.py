"""Problem 4: the subject areas of each document.

A complement naive Bayes classifier is trained on labelled samples: a term speaks for an area as much as it is rarer outside of
that area than in all of them. Each area has a margin of its own against its complement, none is compared with another, so a
sentence may treat two areas or none. All texts are read once: their content lines (problem 3) become sentences, these become
term numbers in a narrow table. Over that table expectation-maximization runs until the expected counts stay: tasks add up what
each area's posterior gives its terms, the driver forms new weights. Margins are calibrated to posteriors on labelled sentences
held out of the counts, again after every change of the weights. A document has the areas that at least a fifth of its own
sentences treat.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import p03_boilerplate as p3
from .common import cut, map_rows, strip_marks

#: Labelled samples used, at most, chosen by a hash of their texts, and terms of the model: the most frequent words, then pairs. A
#: term of fewer than LEAST labelled sentences is a name or chance, and tells no area.
SAMPLE_ROWS = 20_000
VOCABULARY = 200_000
LEAST = 3
#: Expectation-maximization ends when less than this share of the expected counts moves, or after so many passes.
TOLERANCE, PASSES = 0.01, 20
#: Weight of an expected count beside a labelled one.
UNLABELLED = 0.5
#: Share of a document's own sentences that must treat an area.
SHARE = 0.2
ALPHA = 0.1
FOLDS = 5
#: Counts of one row of partial sums.
CHUNK = 4096

_END = re.compile(r"(?<=[.!?…])\s+(?=[A-ZÀ-ÖØ-ÞŒ0-9«])")
_WORD = re.compile(r"[^\W_]+|\n")
#: Words that join a term's parts. Fixed values.
_JOINTS = frozenset("a au aux d de des du en et l la le les qu que qui s sur un une".split())


def sentences(line: str) -> list[str]:
    """Sentences of a line; a line that doesn't end as one (a heading, an entry of a list) has none."""
    line = line.strip()
    if not line or line[-1] not in ".!?…»":
        return []
    return [s for s in _END.split(line) if s]


class Vocabulary:
    """Numbers of words, and of pairs of neighbouring words after them; words that join the parts of a term are passed over."""

    def __init__(self, words: list[str], pairs: list[tuple[int, int]]):
        import numpy as np

        self.words = {w: i for i, w in enumerate(words)}
        keys = sorted(a * len(words) + b for a, b in pairs)
        self.pairs = np.array(keys, dtype=np.int64)
        self.size = len(words) + len(keys)

    class _Codes(dict):
        """-1 for a word that isn't known, -2 for one passed over."""

        def __missing__(self, w: str) -> int:
            return -2 if w in _JOINTS or len(w) < 2 or w.isdigit() else -1

    def codes(self) -> dict[str, int]:
        return self._Codes({**self.words, "\n": -3})

    def rows(self, texts: list[str], codes: dict[str, int]):
        """(row, number) of the known terms of ``texts``, as two arrays in the order of rows."""
        import numpy as np

        found = np.fromiter(map(codes.__getitem__, _WORD.findall(strip_marks("\n".join(texts)))), dtype=np.int64)
        row = np.cumsum(found == -3)
        keep = found > -2
        found, row = found[keep], row[keep]
        known = found >= 0
        both = known[1:] & known[:-1] & (row[1:] == row[:-1])
        key = found[:-1][both] * len(self.words) + found[1:][both]
        at = np.searchsorted(self.pairs, key)
        hit = at < len(self.pairs)
        hit[hit] = self.pairs[at[hit]] == key[hit]
        rows = np.concatenate([row[known], row[1:][both][hit]])
        numbers = np.concatenate([found[known], len(self.words) + at[hit]])
        order = np.argsort(rows, kind="stable")
        return rows[order], numbers[order]


def vocabulary(texts: list[str], most: int = VOCABULARY, least: int = LEAST) -> Vocabulary:
    """The ``most`` most frequent words of ``texts``, then pairs of them, each in ``least`` texts or more; equal counts by the word."""
    words: dict[str, int] = {}
    kept = []
    for t in texts:
        own = [w for w in _WORD.findall(strip_marks(t)) if w != "\n" and w not in _JOINTS and len(w) > 1 and not w.isdigit()]
        kept.append(own)
        for w in set(own):
            words[w] = words.get(w, 0) + 1
    chosen = sorted((w for w in words if words[w] >= least), key=lambda w: (-words[w], w))[:most]
    number = {w: i for i, w in enumerate(chosen)}
    pairs: dict[tuple[int, int], int] = {}
    for own in kept:
        for p in {(number[a], number[b]) for a, b in zip(own, own[1:]) if a in number and b in number}:
            pairs[p] = pairs.get(p, 0) + 1
    often = sorted((p for p in pairs if pairs[p] >= least), key=lambda p: (-pairs[p], p))
    return Vocabulary(chosen, often[: most - len(chosen)])


def complement_weights(counts):
    """Of areas x terms counts: how much rarer a term is outside of each area than in all of them, as a logarithm."""
    import numpy as np

    total = counts.sum(axis=0)
    other = total[None, :] - counts + ALPHA
    every = total + ALPHA * len(counts)
    return (np.log(every / every.sum())[None, :] - np.log(other / other.sum(axis=1, keepdims=True))).astype(np.float32)


def margins(weights, row, number, n: int):
    """Each area's margin against its complement, of ``n`` rows of terms."""
    import numpy as np

    return np.stack([np.bincount(row, weights=w[number], minlength=n) for w in weights], axis=1) if n else np.zeros((0, len(weights)))


class Model:
    """Weights of complement naive Bayes over labelled and expected counts, and the calibration of each area's margin."""

    def __init__(self, areas: list[str], vocab: Vocabulary, units: list[tuple[int, str, int]]):
        """``units``: (sample, sentence, area), the labelled sentences."""
        import numpy as np

        self.areas, self.vocab = areas, vocab
        self.fold = np.array([i % FOLDS for i, _, _ in units])
        self.y = np.array([y for _, _, y in units])
        self.row, self.number = vocab.rows([s for _, s, _ in units], vocab.codes())
        self.labelled = self._counts(np.ones(len(units), dtype=bool))
        self.learn(np.zeros_like(self.labelled))

    def _counts(self, keep):
        import numpy as np

        use = keep[self.row]
        flat = self.y[self.row[use]] * self.vocab.size + self.number[use]
        return np.bincount(flat, minlength=len(self.areas) * self.vocab.size).reshape(len(self.areas), -1).astype(float)

    def learn(self, expected) -> None:
        """New weights, then a new calibration on the labelled sentences of each fold by what all the others teach."""
        import numpy as np

        # Unlabelled sentences weigh at most as much as the labelled ones do together, however many they are.
        extra = UNLABELLED * min(1.0, self.labelled.sum() / max(expected.sum(), 1e-9)) * expected
        self.weights = complement_weights(self.labelled + extra)
        margin = np.zeros((len(self.y), len(self.areas)))
        for f in range(FOLDS):
            own = self.fold == f
            use = own[self.row]
            held = margins(complement_weights(self._counts(~own) + extra), self.row[use], self.number[use], len(self.y))
            margin[own] = held[own]
        fits = [calibrate(margin[:, a], self.y == a) for a in range(len(self.areas))]
        self.scale, self.shift = np.array([a for a, _ in fits]), np.array([b for _, b in fits])

    def scorer(self) -> Scorer:
        return Scorer(self.areas, self.weights, self.scale, self.shift)


class Scorer:
    """What tasks need of a model."""

    def __init__(self, areas, weights, scale, shift):
        self.areas, self.weights, self.scale, self.shift = areas, weights, scale, shift

    def posteriors(self, row, number, n: int):
        """Calibrated, independent posteriors of the areas for ``n`` rows of terms."""
        import numpy as np

        return 1 / (1 + np.exp(-np.clip(margins(self.weights, row, number, n) * self.scale + self.shift, -30, 30)))


def calibrate(margin, y) -> tuple[float, float]:
    """Platt's sigmoid of a margin, by Newton's method with targets off 0 and 1."""
    import numpy as np

    p, n = y.sum(), len(y) - y.sum()
    t = np.where(y, (p + 1) / (p + 2), 1 / (n + 2))

    def loss(a: float, b: float) -> float:
        z = a * margin + b
        return float((np.logaddexp(0, z) - t * z).sum()) + 5e-4 * a * a

    a, b = 1.0, 0.0
    for _ in range(100):
        q = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        g, h = q - t, q * (1 - q) + 1e-9
        ga, gb = (g * margin).sum() + 1e-3 * a, g.sum()
        haa, hab, hbb = (h * margin * margin).sum() + 1e-3, (h * margin).sum(), h.sum()
        d = max(haa * hbb - hab * hab, 1e-12)
        da, db = (hbb * ga - hab * gb) / d, (haa * gb - hab * ga) / d
        step, now = 1.0, loss(a, b)
        while step > 1e-4 and loss(a - step * da, b - step * db) > now:
            step /= 2
        a, b = a - step * da, b - step * db
        if step <= 1e-4 or abs(da) + abs(db) < 1e-6:
            break
    return float(a), float(b)


def train(samples: list[tuple[str, str]]) -> Model | None:
    """A model of the labelled (text, subject) samples; None without two areas. A sample's sentences carry its label."""
    areas = sorted({y for _, y in samples})
    if len(areas) < 2:
        return None
    units = [(i, s, areas.index(y)) for i, (text, y) in enumerate(samples) for line in text.split("\n") for s in sentences(line) or ([line] if line.strip() else [])]
    return Model(areas, vocabulary([s for _, s, _ in units]), units) if units else None


def _arrays(part: dict[str, list]):
    """(row, number, sentences of each text) of a batch of the narrow table; rows count through the batch."""
    import numpy as np

    sizes = [np.frombuffer(x, dtype="<i4") for x in part["sizes"]]
    number = np.frombuffer(b"".join(part["terms"]), dtype="<i4")
    size = np.concatenate(sizes) if sizes else np.zeros(0, dtype=np.int32)
    return np.repeat(np.arange(len(size)), size), number, [len(s) for s in sizes]


def term_table(texts: DataFrame, vocab: Vocabulary, lines: p3.Weights) -> DataFrame:
    """(rid, sizes, terms): of each (rid, text) with a sentence of its own, the number of known terms of every sentence, and their
    numbers, as 32-bit integers. All lines of a text are judged whole, with problem 3; furniture and headings have no sentence."""
    sent = texts.sparkSession.sparkContext.broadcast((vocab, lines.weight, lines.bias, lines.cost))

    def make():
        import numpy as np

        vocab, *weights = sent.value
        lines, codes = p3.Weights(*weights), vocab.codes()

        def run(parts: Iterator[dict[str, list]]) -> Iterator[list[tuple]]:
            for part in parts:
                own = [(rid, p3.clean_lines(t)) for rid, t in zip(part["rid"], part["text"]) if rid is not None and t]
                ids, found, ends = [], [], []
                for (rid, text), inside in zip(own, lines.content([x for _, x in own])):
                    some = [s for line, yes in zip(text, inside) if yes for s in sentences(line)]
                    if some:
                        ids.append(rid)
                        found += some
                        ends.append(len(found))
                row, number = vocab.rows(found, codes)
                size = np.bincount(row, minlength=len(found)).astype("<i4")
                at = np.concatenate([[0], np.cumsum(size)])
                number = number.astype("<i4")
                out, begin = [], 0
                for rid, end in zip(ids, ends):
                    out.append((rid, size[begin:end].tobytes(), number[at[begin] : at[end]].tobytes()))
                    begin = end
                yield out

        return run

    kind = texts.schema["rid"].dataType.simpleString()
    return map_rows(texts, f"rid {kind}, sizes binary, terms binary", make)


def expectation(scorer: Scorer, table: DataFrame):
    """Expected counts, areas x terms, over all sentences of the table: summed in each task, then by chunks of CHUNK counts, so
    what comes to the driver is one number for each area and term. Thousandths, as integers: no order of tasks changes them."""
    import numpy as np

    n_areas, size = scorer.weights.shape
    sent = table.sparkSession.sparkContext.broadcast(scorer)

    def add():
        own: Scorer = sent.value

        def run(parts: Iterator[dict[str, list]]) -> Iterator[list[tuple]]:
            total = np.zeros((n_areas, size))
            for part in parts:
                row, number, texts = _arrays(part)
                p = own.posteriors(row, number, sum(texts))
                for a in range(n_areas):
                    total[a] += np.bincount(number, weights=p[row, a], minlength=size)
            flat = np.round(total * 1000).astype("<i8").ravel()
            yield [(i, flat[i : i + CHUNK].tobytes()) for i in range(0, len(flat), CHUNK) if flat[i : i + CHUNK].any()]

        return run

    def merge():
        def run(parts: Iterator[dict[str, list]]) -> Iterator[list[tuple]]:
            sums: dict[int, np.ndarray] = {}
            for part in parts:
                for at, counts in zip(part["at"], part["counts"]):
                    own = np.frombuffer(counts, dtype="<i8")
                    sums[at] = sums[at] + own if at in sums else own
            yield [(at, x.tobytes()) for at, x in sums.items()]

        return run

    added = map_rows(table.select("sizes", "terms"), "at long, counts binary", add)
    flat = np.zeros(n_areas * size)
    for r in map_rows(added.repartition("at"), "at long, counts binary", merge).collect():
        own = np.frombuffer(r["counts"], dtype="<i8")
        flat[r["at"] : r["at"] + len(own)] = own / 1000
    return flat.reshape(n_areas, size)


def refine(model: Model, table: DataFrame) -> int:
    """Expectation-maximization over the table, until less than TOLERANCE of the expected counts moves; the number of passes."""
    import numpy as np

    before = np.zeros_like(model.labelled)
    for k in range(1, PASSES + 1):
        now = expectation(model.scorer(), table)
        moved = np.abs(now - before).sum()
        model.learn(now)
        if moved <= TOLERANCE * max(now.sum(), 1e-9):
            return k
        before = now
    return PASSES


def training_samples(samples: DataFrame) -> list[tuple[str, str]]:
    """(text, subject) of at most SAMPLE_ROWS labelled samples."""
    text = F.concat_ws("\n", "titre", "texte")
    rows = samples.filter("subject is not null").select(text.alias("text"), "subject").orderBy(F.xxhash64("text", "subject"), "text", "subject").limit(SAMPLE_ROWS)
    return [(r["text"], r["subject"]) for r in rows.collect()]


def subject_shares(articles: DataFrame, samples: DataFrame, pages: DataFrame, id_col: str = "rec_id", text_col: str = "texte") -> DataFrame:
    """(id, subject, share, n_sentences): the share of a text's own sentences that treat each area, where it isn't 0.

    Null, empty and furniture-only texts have no sentence and no row, rows without an id neither; repeated rows come out
    each. Without samples of two areas there is no area. Whole texts are read once and none is shuffled.
    """
    some = articles.select(F.col(id_col).alias("rid"), F.col(text_col).alias("text"))
    kind = some.schema["rid"].dataType.simpleString()
    schema = f"rid {kind}, subject string, share double, n_sentences int"
    model = train(training_samples(samples))
    if model is None:
        return some.sparkSession.createDataFrame([], schema).withColumnRenamed("rid", id_col)
    table = cut(term_table(some, model.vocab, p3.weights(articles, pages)))
    refine(model, table)
    sent = articles.sparkSession.sparkContext.broadcast(model.scorer())

    def make():
        own: Scorer = sent.value

        def run(parts: Iterator[dict[str, list]]) -> Iterator[list[tuple]]:
            for part in parts:
                row, number, texts = _arrays(part)
                treats = own.posteriors(row, number, sum(texts)) >= 0.5
                out, begin = [], 0
                for rid, n in zip(part["rid"], texts):
                    share = treats[begin : begin + n].mean(axis=0)
                    out += [(rid, own.areas[a], float(share[a]), n) for a in share.nonzero()[0]]
                    begin += n
                yield out

        return run

    return map_rows(table, schema, make).withColumnRenamed("rid", id_col)


def subjects(articles: DataFrame, samples: DataFrame, pages: DataFrame, id_col: str = "rec_id", text_col: str = "texte") -> DataFrame:
    """(id, subject): the areas that at least SHARE of the text's own sentences treat."""
    return subject_shares(articles, samples, pages, id_col, text_col).filter(F.col("share") >= SHARE - 1e-9).select(id_col, "subject").distinct()
