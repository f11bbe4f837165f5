"""Problem 10: repetition inside a document, judged by a learned decision list.

Each text is measured once: how much of its lines and sentences stands there twice, how often its most frequent pair and triple of
words occur, how few different words it has, how many pairs of words came before. Sequential covering grows conjunctions of
thresholds on labelled measures and prunes them on rows held out, as in RIPPER. The list comes out as one ordered Spark
conditional expression that anybody can read. It is learned for the texts that say everything once, the larger class, and no rule
may cover a repetitive one: what no rule covers is repetitive. Those texts alone, a few in a hundred, are then measured exactly.

The labels are what the definition says, the share of words in runs that occurred before; no rule may read that share.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BATCH_ROWS, fold_words, map_rows, ship

RUN = 5
#: Share of words in repeated runs from which a document counts as repetitive.
SHARE = 0.4
#: Labelled rows the list is learned from, at most, chosen by a hash of their texts; each also comes with repetition put in.
SAMPLE_ROWS = 2000
#: Characters of a text that may be in the sample; all texts are measured whole.
SAMPLE_CHARS = 20_000
#: Labelled rows a rule covers, at least: fewer are chance. What no rule covers is measured exactly.
LEAST = 20
#: Share of its own rows a threshold gives up to keep off the other class.
MARGIN = 0.05
MEASURES = ["line_share", "sentence_share", "top_pair_share", "top_triple_share", "distinct_share", "pair_share", "n_words"]
KINDS = ", ".join(f"{m} {'long' if m == 'n_words' else 'double'}" for m in MEASURES)

_SENTENCE = re.compile(r"[.!?\n]+")


def repeated_share(words: list[str], run: int = RUN) -> float:
    """Share of the words that lie in runs of ``run`` or more consecutive words that already occurred earlier (overlaps allowed)."""
    n = len(words)
    if n <= run:
        return 0.0
    seen: set[tuple] = set()
    covered, reach = 0, 0  # words before ``reach`` are counted
    for at, gram in enumerate(zip(*(words[k:] for k in range(run)))):
        if gram in seen:
            covered += at + run - max(at, reach)
            reach = at + run
        else:
            seen.add(gram)
    return covered / n


def _again(parts: list[str]) -> float:
    """Share of the characters of ``parts`` that stand in a part that came before."""
    if len(set(parts)) == len(parts):
        return 0.0
    total = sum(map(len, parts))
    return (total - sum(map(len, set(parts)))) / total if total else 0.0


def measure(text: str | None) -> tuple:
    """The measures of one text, in the order of MEASURES; zeros without words."""
    words = fold_words(text or "")
    n = len(words)
    if not n:
        return (0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0)
    lines = [s for s in map(str.strip, text.split("\n")) if s]
    sentences = [s for s in map(str.strip, _SENTENCE.split(text)) if s]
    number: dict[str, int] = {}
    codes = [number.setdefault(w, len(number)) for w in words]
    distinct = len(number)
    pairs: dict[int, int] = {}
    for a, b in zip(codes, codes[1:]):
        k = a * distinct + b
        pairs[k] = pairs.get(k, 0) + 1
    again = n - 1 - len(pairs)
    triples: dict[tuple, int] = {}
    if again > 0.1 * n:  # without pairs that come again no triple does; below that share the top one counts as 1
        for t in zip(codes, codes[1:], codes[2:]):
            triples[t] = triples.get(t, 0) + 1
    top = 2 * max(pairs.values(), default=0) / n
    third = 3 * max(triples.values(), default=1) / n
    return (_again(lines), _again(sentences), top, third, distinct / n, again / n, n)


def measures(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, *MEASURES, text) of every row, whole texts; ``text`` is the text itself.

    Null, empty and wordless texts have zeros; rows come out once each, null and repeated ids as they are; no shuffle.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    ship(df.sparkSession)
    some = df.select(F.col(id_col).alias("rid"), F.col(text_col).alias("text"))
    kind = _parse_datatype_string(f"rid {some.schema['rid'].dataType.simpleString()}, {KINDS}, text string")
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_ROWS):
                part = batch.slice(at, BATCH_ROWS)
                found = list(zip(*map(measure, part.column("text").to_pylist())))
                own = [pa.array(c, type=arrow.field(m).type) for m, c in zip(MEASURES, found)]
                # Ids and texts go back as they came, without Python.
                yield pa.RecordBatch.from_arrays([part.column("rid"), *own, part.column("text").cast(pa.string())], schema=arrow)

    return some.mapInArrow(run, kind).withColumnRenamed("rid", id_col)


Rule = list[tuple[str, str, float]]


def _covers(rule: Rule, x):
    """Which rows of the table of measures (an array by MEASURES) a rule covers."""
    import numpy as np

    yes = np.ones(len(x), dtype=bool)
    for m, op, t in rule:
        v = x[:, MEASURES.index(m)]
        yes &= v >= t if op == ">=" else v <= t
    return yes


def _grow(x, y, rule: Rule) -> Rule:
    """Adds to ``rule`` the condition of the highest information gain until it covers no row of the other class. All gaps between
    values of different classes are tried as thresholds; the threshold taken then keeps off the other class by MARGIN."""
    import numpy as np

    x, y = x[(c := _covers(rule, x))], y[c]
    while y.any() and not y.all():
        base, best = np.log2(y.mean()), (0.0, None)
        for k, m in enumerate(MEASURES):
            order = np.argsort(x[:, k], kind="stable")
            v, yes = x[order, k], np.cumsum(y[order])
            n = np.arange(1, len(v) + 1)
            edge = np.flatnonzero(np.append(v[1:] > v[:-1], True))
            for op, p, total in (("<=", yes[edge], n[edge]), (">=", yes[-1] - np.append(0, yes[edge[:-1]]), len(v) - np.append(0, n[edge[:-1]]))):
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(p > 0, p * (np.log2(p / total) - base), -1.0)
                i = int(np.argmax(gain))
                if gain[i] > best[0] + 1e-12:
                    # Of the rule's own values, not the last before the edge but one that leaves MARGIN of them outside.
                    inside = v[: edge[i] + 1] if op == "<=" else v[(edge[i - 1] + 1 if i else 0) :]
                    own = inside[y[order][: edge[i] + 1] if op == "<=" else y[order][(edge[i - 1] + 1 if i else 0) :]]
                    best = (float(gain[i]), (m, op, float(np.quantile(own, 1 - MARGIN, method="lower") if op == "<=" else np.quantile(own, MARGIN, method="higher"))))
        if best[1] is None:
            return []
        # A further condition on the same side of a measure is the narrower one and takes the place of the first.
        rule = [*(c for c in rule if c[:2] != best[1][:2]), best[1]]
        x, y = x[(c := _covers([best[1]], x))], y[c]
    return rule if y.any() else []


def learn(x, y) -> list[Rule]:
    """A decision list for the rows of ``x`` where ``y``: rules in order, each a conjunction. Two rows of three grow a rule, the third
    prunes it: conditions go from its end as long as it covers no more rows of the other class. A rule that covers any is not
    taken but grown again on all rows, so the list covers no row of the other class."""
    import numpy as np

    rules: list[Rule] = []
    at = np.arange(len(x))
    left = np.ones(len(x), dtype=bool)
    while (left & y).any():
        some = left & (at % 3 != 0)
        rule = _grow(x[some], y[some], []) if (some & y).any() else []
        held, other = x[left & (at % 3 == 0)], ~y[left & (at % 3 == 0)]
        while len(rule) > 1 and (_covers(rule[:-1], held) & other).sum() <= (_covers(rule, held) & other).sum() and not (_covers(rule[:-1], x[~y])).any():
            rule = rule[:-1]
        if not rule or _covers(rule, x[~y]).any():
            rule = _grow(x[left | ~y], y[left | ~y], rule)
        covered = _covers(rule, x) & left & y if rule else np.zeros(len(x), dtype=bool)
        if covered.sum() < min(LEAST, y.sum()):
            break
        rules.append(rule)
        left &= ~covered
    return rules


def as_column(rules: list[Rule]) -> Column:
    """The list as an ordered conditional expression: the number of the first rule that covers a row (from 1), else 0."""
    ready, column = False, F
    for k, rule in enumerate(rules, 1):
        test = F.lit(True)
        for m, op, t in rule:
            test = test & (F.col(m) >= t if op == ">=" else F.col(m) <= t)
        column, ready = column.when(test, F.lit(k)), True
    return column.otherwise(F.lit(0)) if ready else F.lit(0)


def training_rows(df: DataFrame, text_col: str):
    """(measures, whether a text says everything once) of at most SAMPLE_ROWS texts, labelled by the definition; two arrays. Tasks
    measure; what comes to the driver are the measures."""
    import numpy as np

    whole = df.select(F.col(text_col).alias("text")).filter(F.length("text").between(1, SAMPLE_CHARS))
    some = whole.orderBy(F.xxhash64("text"), "text").limit(SAMPLE_ROWS)

    def make():
        def run(parts: Iterator[dict[str, list]]) -> Iterator[list[tuple]]:
            for part in parts:
                yield [(*x, y) for text in part["text"] for x, y in labelled(text)]

        return run

    spread = some.repartition(df.sparkSession.sparkContext.defaultParallelism)
    rows = sorted(tuple(r) for r in map_rows(spread, f"{KINDS}, once boolean", make).collect())
    table = np.array(rows, dtype=float).reshape(-1, len(MEASURES) + 1)
    return table[:, :-1], table[:, -1] > 0.5


def labelled(text: str) -> list[tuple[tuple, bool]]:
    """The measures of a text and of three of its kind with repetition put in, and whether they say everything once.

    Parts of the text are said again, as phrases of five to thirteen words, as a part or as a whole, in a share that its hash tells, so both
    labels are there whatever the corpus holds; texts whose share lies between 0.35 and 0.45, which don't occur, are left out.
    """
    words = text.split()
    n, k = len(words), zlib.crc32(text.encode())
    share = (k % 20 + 1) / 20
    step = 5 + k % 9
    # Phrases from all over the text, each said again at once.
    phrases = [w for i in range(0, n, step) for w in words[i : i + step] * (2 if i % 20 < 20 * share else 1)]
    found = []
    for t in (text, text + "\n" + text[: int(len(text) * share)], " ".join(words + words[: int(n * share)] * (1 + k % 3)), " ".join(phrases)):
        s = repeated_share(fold_words(t))
        if not 0.35 < s < 0.45:
            found.append((measure(t), s < SHARE))
    return found


def repetition(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, *MEASURES, text, rule) of every row: the number of the learned rule that finds it to say everything once, or 0.

    Without training rows (an empty table, or only very long texts) there is no rule, and all texts are 0.
    """
    return measures(df, id_col, text_col).withColumn("rule", as_column(learn(*training_rows(df, text_col))))


def shares(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, repeated_share) of every row: the share of its words in runs that occurred before. Null, empty and wordless texts have
    0; rows come out once each, null and repeated ids as they are; no shuffle."""
    some = df.select(F.col(id_col).alias("rid"), F.col(text_col).alias("text"))

    def make():
        def run(parts: Iterator[dict[str, list]]) -> Iterator[list[tuple]]:
            for part in parts:
                yield [(rid, repeated_share(fold_words(text or ""))) for rid, text in zip(part["rid"], part["text"])]

        return run

    kind = some.schema["rid"].dataType.simpleString()
    return map_rows(some, f"rid {kind}, repeated_share double", make).withColumnRenamed("rid", id_col)


def repetitive(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id): rows that no rule of the list clears, confirmed by the exact share, which is taken of these alone. Rows without an id
    are left out; repeats come out once."""
    named = df.select(F.col(id_col).alias("rid"), F.col(text_col).alias("text")).filter("rid is not null")
    found = repetition(named, "rid", "text").filter("rule = 0")
    return shares(found, "rid", "text").filter(F.col("repeated_share") >= SHARE).select(F.col("rid").alias(id_col)).distinct()
