"""Problem 3: page furniture mixed with main content.

A field is a sequence of tokens: words, and the tags of its layout (separators, bullets, the border before each line with what
the line begins and ends with). Each token has a score learned from labelled pages: words of content score positive, tags and
words of furniture negative. One linear scan over the field finds the contiguous regions of largest total score, where every
region costs OPEN: the best set of regions instead of the one best region, since furniture also stands between paragraphs. Regions
begin and end at the border of a line, as a line is wholly furniture or wholly content; what lies outside of them is furniture. So
a line of weak score stands or falls with its neighbours: among content it is content, alone it opens no region.

Labels come from the pages that articles were taken from: a line of an article that its page has in a content block is
content, a line that the page has nowhere in its content is furniture, and so are the page's menu and footer.
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows
from .p06_encoding_damage import repair
from .p07_lookalikes import form

#: Labelled pages the weights are learned from, at most, and texts taken from them; chosen by a hash of their paths and ids.
SAMPLE_PAGES = 1500
SAMPLE_TEXTS = 3000
#: Characters of a page or a text that may be in the sample; all texts are read whole.
SAMPLE_CHARS = 200_000
BUCKETS = 1 << 17
#: Times the weights are fitted, each without the labels the pass before contradicts.
PASSES = 2
#: Costs of a region from which the labelled texts choose.
OPENS = (0.0, 0.5, 1.0, 1.5, 2.0, 3.0, 4.0)
#: Classes of the spans that hold a page's body text and contacts; headlines are quoted by furniture and tell nothing. Fixed values.
CONTENT_CLASSES = ("style95", "style85")

_TOKEN = re.compile(r"[a-z]+|[0-9]+|\n|[^\sa-z0-9]")
_BREAK = re.compile(r"<br\s*/?>", re.I)
_TAG = re.compile(r"<[^>]+>")
#: Signs beyond ASCII that are tags, as control characters that no text needs.
_SIGNS = {"·": "\x01", "»": "\x02", "©": "\x03", "«": "\x04"}
_WORD, _SIGN, _BORDER = 0, 1, 2


class _Numbers(dict):
    """A number for each token, remembered up to a bound: its hash and, in the last two bits, its kind."""

    def __missing__(self, token: str) -> int:
        kind = _BORDER if token == "\n" else _WORD if token.isalnum() else _SIGN
        n = zlib.crc32((token if token[0] > "9" or kind else "0").encode()) << 2 | kind
        if len(self) < 200_000:
            self[token] = n
        return n


_NUMBER = _Numbers()


def bucket(word: str) -> int:
    """Bucket of a word alone."""
    return zlib.crc32(word.encode()) % BUCKETS


def features(lines: list[str]):
    """(line, bucket) of all tokens of ``lines``, as two arrays.

    Words count without what accents and damage change, alone and with the word before; signs too, alone and with the sign before.
    The tag at a line's border tells its number of words and which words or signs begin and end it.
    """
    import numpy as np

    text = "\n".join(lines).lower()
    if not text.isascii():
        for sign, plain in _SIGNS.items():
            text = text.replace(sign, plain)
        text = text.encode("ascii", "ignore").decode()
    text = text.replace("?", "")
    got = np.fromiter(map(_NUMBER.__getitem__, _TOKEN.findall(text)), dtype=np.int64)
    kind, code = got & 3, got >> 2
    line = np.cumsum(kind == _BORDER)
    line, kind, code = line[kind != _BORDER], kind[kind != _BORDER], code[kind != _BORDER]
    n = len(lines)
    w, at = code[kind == _WORD], line[kind == _WORD]
    count = np.bincount(at, minlength=n)
    same = at[1:] == at[:-1]
    begin = np.flatnonzero(np.concatenate([[True], ~same])) if len(at) else np.zeros(0, dtype=np.int64)
    end = np.flatnonzero(np.concatenate([~same, [True]])) if len(at) else begin
    two = begin[count[at[begin]] > 1]
    change = line[1:] != line[:-1]
    first = np.flatnonzero(np.concatenate([[True], change])) if len(line) else np.zeros(0, dtype=np.int64)
    last = np.flatnonzero(np.concatenate([change, [True]])) if len(line) else first
    signs, where = code[kind == _SIGN], line[kind == _SIGN]
    near = where[1:] == where[:-1]
    size = np.searchsorted([1, 2, 3, 4, 8, 16], count, side="right")
    parts = [
        (at, w),
        (at[1:][same], w[:-1][same] * 31 + w[1:][same] + 1),
        (at[begin], w[begin] * 37 + 2),
        (at[end], w[end] * 41 + 3),
        (at[two], w[two] * 43 + w[two + 1] * 47 + 4),
        (where, signs),
        (where[1:][near], signs[:-1][near] * 67 + signs[1:][near] * 71 + 8),
        (line[first], np.where(kind[first] == _SIGN, code[first], 0) * 53 + 5),
        (line[last], np.where(kind[last] == _SIGN, code[last], 0) * 59 + 6),
        (np.arange(n), size * 61 + 7),
    ]
    return np.concatenate([a for a, _ in parts]), np.concatenate([b for _, b in parts]) % BUCKETS


def clean_lines(text: str) -> list[str]:
    """Lines of a text with encoding damage and look-alike characters undone, as many as ``text`` has."""
    whole = form(repair(text)[1])
    lines = whole.split("\n")
    return lines if len(lines) == text.count("\n") + 1 else [form(repair(line)[1]) for line in text.split("\n")]


def regions(scores: list[float], cost: float = 0.0) -> list[tuple[int, int]]:
    """The contiguous regions whose scores, less ``cost`` for each, are largest together, as half-open spans, in one scan.

    The running total of the scores falls and rises; a region is a rise by more than ``cost`` and ends where a fall by more than
    ``cost`` begins. Smaller falls are crossed, smaller rises left out.
    """
    spans: list[tuple[int, int]] = []
    total = low = high = 0.0
    begin = end = 0
    inside = False
    for i, s in enumerate(scores, 1):
        total += s
        if inside:
            if total > high:
                high, end = total, i
            elif high - total > cost:
                spans.append((begin, end))
                inside, low, begin = False, total, i
        elif total < low:
            low, begin = total, i
        elif total - low > cost:
            inside, high, end = True, total, i
    if inside:
        spans.append((begin, end))
    return spans


class Weights:
    """Weights of tokens by bucket and the cost of a region. Without weights, all text is content."""

    def __init__(self, weight, bias: float, cost: float = 0.0):
        self.weight, self.bias, self.cost = weight, bias, cost

    def scores(self, lines: list[str]) -> list[float]:
        """What the tokens of each line score together; blank lines score 0."""
        import numpy as np

        if self.weight is None:
            return [float(bool(x.strip())) for x in lines]
        if not lines:
            return []
        at, col = features(lines)
        z = np.bincount(at, weights=self.weight[col], minlength=len(lines)) + self.bias
        return [s if x and not x.isspace() else 0.0 for s, x in zip(z.tolist(), lines)]

    def content(self, texts: list[list[str]]) -> list[list[bool]]:
        """Of the lines of each text, whether they lie in a content region. Any number of texts are scored at once."""
        scores = self.scores([x for lines in texts for x in lines])
        out, begin = [], 0
        for lines in texts:
            own = scores[begin : begin + len(lines)]
            begin += len(lines)
            inside = [False] * len(own)
            for a, b in regions(own, self.cost if self.weight is not None else 0.0):
                inside[a:b] = [True] * (b - a)
            out.append(inside)
        return out

    def furniture(self, texts: list[str | None]) -> list[list[int]]:
        """Of each text the numbers of the lines outside of every content region; empty lines aren't counted among them."""
        lines = [clean_lines(t) if t else [] for t in texts]
        return [[i for i, (x, yes) in enumerate(zip(own, inside)) if not yes and x and not x.isspace()] for own, inside in zip(lines, self.content(lines))]


def _spaced(line: str) -> str:
    return " ".join(line.split())


def page_lines(page: str) -> tuple[list[str], list[str]]:
    """(content lines, furniture lines) of a page, by its own mark-up."""
    content = []
    for cls in CONTENT_CLASSES:
        for block in re.findall(rf'<span class="{cls}">(.*?)</span>', page, re.S):
            content += [_spaced(html.unescape(_TAG.sub("", x))) for x in _BREAK.split(block)]
    menu = [_spaced(html.unescape(_TAG.sub("", x))) for x in re.findall(r"<li>(.*?)</li>", page, re.S)]
    foot = [_spaced(html.unescape(_TAG.sub("", x))) for x in re.findall(r'<div class="foot">(.*?)</div>', page, re.S)]
    return [x for x in content if x], [x for x in menu + foot + [" | ".join(menu), " > ".join(menu), " - ".join(menu)] if x]


def labelled(page: str, texts: list[str]) -> list[list[tuple[str, bool | None]]]:
    """Lines with whether they are content, or None where that isn't sure: first those of the page, each a list of its own, then
    those of each text taken from it, in order."""
    content, furniture = page_lines(page)
    known = set(content) - set(furniture)
    grams = {g for x in content for w in (x.lower().split(),) for g in zip(w, w[1:], w[2:])}
    out: list[list[tuple[str, bool | None]]] = [[(x, False)] for x in furniture] + [[(x, True)] for x in sorted(known)]
    for text in texts:
        own: list[tuple[str, bool | None]] = []
        for line in map(_spaced, clean_lines(text)):
            label = None
            if line in known:
                label = True
            elif line and "@" not in line and "://" not in line:  # addresses differ in form from page to record
                words = line.lower().split()
                if not any(g in grams for g in zip(words, words[1:], words[2:])) or len(words) < 16 and not line.endswith("."):
                    label = False
            own.append((line, label))
        out.append(own)
    return out


def _kind(line: str) -> str:
    """How a line begins and ends."""
    words = re.findall(r"[^\W\d_]+|[^\w\s]", line.lower())
    return " ".join(words[:2]) + " " + (line[-1:] if not line[-1:].isalnum() else "w")


def fit(texts: list[list[tuple[str, bool | None]]], rounds: int = 150) -> Weights:
    """Logistic regression by full-batch AdaGrad; lines of equal text and label count by the logarithm of their number. The cost of
    a region is the one by which the scan is wrong in the fewest labelled lines."""
    import numpy as np

    counts: dict[tuple[str, bool], int] = {}
    for r in (r for text in texts for r in text if r[1] is not None):
        counts[r] = counts.get(r, 0) + 1
    if len({y for _, y in counts}) < 2:
        return Weights(None, 0.0)
    # Some pages have furniture among their content: a label that most lines of the same beginning and end contradict goes.
    votes: dict[str, list[int]] = {}
    for line, y in counts:
        votes.setdefault(_kind(line), [0, 0])[y] += 1
    items = sorted((r, n) for r, n in counts.items() if votes[_kind(r[0])][r[1]] * 2 >= sum(votes[_kind(r[0])]))
    at, col = features([line for (line, _), _ in items])
    y = np.array([float(y) for (_, y), _ in items])
    k = 1 + np.log(np.array([n for _, n in items], dtype=float))
    k *= np.where(y > 0, len(items) / (2 * max(k[y > 0].sum(), 1)), len(items) / (2 * max(k[y == 0].sum(), 1)))
    for _ in range(PASSES):
        w, b = np.zeros(BUCKETS), 0.0
        gw, gb = np.full(BUCKETS, 1e-8), 1e-8
        for _ in range(rounds):
            z = np.bincount(at, weights=w[col], minlength=len(items)) + b
            r = k * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(items)
            d = np.bincount(col, weights=r[at], minlength=BUCKETS) + 1e-7 * w
            gw += d * d
            gb += r.sum() ** 2
            w -= 0.3 * d / np.sqrt(gw)
            b -= 0.3 * r.sum() / gb**0.5
        # Labels that the others outvote don't count in the next pass.
        z = np.bincount(at, weights=w[col], minlength=len(items)) + b
        k = np.where((z > 0) == (y > 0.5), k, 0.0)
    trusted = {line: label for ((line, label), _), n in zip(items, k) if n > 0}
    model = Weights(w.astype(np.float32), float(b))
    runs = [[(x, trusted.get(x)) for x, _ in text] for text in texts if len(text) > 1]
    scores = model.scores([x for text in runs for x, _ in text])
    wrong = dict.fromkeys(OPENS, 0)
    begin = 0
    for text in runs:
        own = scores[begin : begin + len(text)]
        begin += len(text)
        for cost in OPENS:
            inside = {i for a, b in regions(own, cost) for i in range(a, b)}
            wrong[cost] += sum(label is not None and (i in inside) != label for i, (_, label) in enumerate(text))
    # Of equal ones the middle: it is the furthest from those that err.
    best = [c for c in OPENS if wrong[c] == min(wrong.values())]
    model.cost = best[len(best) // 2]
    return model


def training_texts(articles: DataFrame, pages: DataFrame) -> list[list[tuple[str, bool | None]]]:
    """Labelled lines of at most SAMPLE_PAGES pages (path: .../<bulletin>/<article>.htm) and SAMPLE_TEXTS texts taken from them.

    Which ones follows from hashes of paths and ids, whatever the order of files and rows. Pages are parsed in tasks; only lines with
    their labels come to the driver, and their number is bounded by the sample.
    """
    whole = pages.filter(F.col("path").isNotNull() & (F.length("html") <= SAMPLE_CHARS))
    some = whole.select("path", "html").orderBy(F.xxhash64("path"), "path", F.xxhash64("html")).limit(SAMPLE_PAGES)
    some = some.select(F.regexp_extract("path", r"([^/]+)\.html?$", 1).alias("page"), "html")
    own = articles.select(F.col("article").alias("page"), *(F.when(F.length(c) <= SAMPLE_CHARS, F.col(c)).alias(c) for c in ("texte", "contact")))
    near = own.join(F.broadcast(some.select("page").distinct()), "page", "left_semi")  # SAMPLE_PAGES short names
    near = near.orderBy(F.xxhash64("page", "texte", "contact")).limit(SAMPLE_TEXTS)
    both = some.join(near, "page", "left").groupBy("page", "html").agg(F.collect_list(F.struct("texte", "contact")).alias("texts"))

    def make():
        def run(parts: Iterator[dict[str, list]]) -> Iterator[list[tuple]]:
            for part in parts:
                rows = []
                for page, texts in zip(part["html"], part["texts"]):
                    found = labelled(page, [t for pair in texts for t in (pair["texte"], pair["contact"]) if t])
                    rows += [([x for x, _ in text], [y for _, y in text]) for text in found]
                yield rows

        return run

    got = map_rows(both.select("html", "texts"), "lines array<string>, labels array<boolean>", make).collect()
    # The weights are sums: equal texts in equal order give equal ones.
    return sorted((list(zip(r["lines"], r["labels"])) for r in got), key=repr)


def weights(articles: DataFrame, pages: DataFrame) -> Weights:
    return fit(training_texts(articles, pages))


def furniture_lines(articles: DataFrame, pages: DataFrame, id_col: str = "rec_id", text_cols: list[str] | None = None) -> DataFrame:
    """(id, field, line_no): every line of ``text_cols`` (texte, contact) that is page furniture, counted from 0 at ``\\n``.

    Null and empty texts and empty lines have none; rows without an id are left out; lines of repeated rows come out each.
    Without labelled pages nothing is known of furniture, and all lines are content. Whole texts are read, none is shuffled;
    the weights (BUCKETS numbers, whatever the data) go to the executors.
    """
    text_cols = text_cols or ["texte", "contact"]
    model = weights(articles, pages)
    sent = articles.sparkSession.sparkContext.broadcast((model.weight, model.bias, model.cost))

    def make():
        own = Weights(*sent.value)

        def run(parts: Iterator[dict[str, list]]) -> Iterator[list[tuple]]:
            for part in parts:
                rows = []
                for field in text_cols:
                    rows += [(rid, field, i) for rid, found in zip(part["rid"], own.furniture(part[field])) if rid is not None for i in found]
                yield rows

        return run

    some = articles.select(F.col(id_col).alias("rid"), *text_cols)
    kind = some.schema["rid"].dataType.simpleString()
    return map_rows(some, f"rid {kind}, field string, line_no int", make).withColumnRenamed("rid", id_col)


def main_text(articles: DataFrame, pages: DataFrame, id_col: str = "rec_id", text_cols: list[str] | None = None) -> DataFrame:
    """(id, *text_cols): the texts without their furniture lines; null stays null, rows come out once each."""
    text_cols = text_cols or ["texte", "contact"]
    model = weights(articles, pages)
    sent = articles.sparkSession.sparkContext.broadcast((model.weight, model.bias, model.cost))

    def make():
        own = Weights(*sent.value)

        def keep(text: str | None, found: list[int]) -> str | None:
            if not text or not found:
                return text
            out = set(found)
            return "\n".join(x for i, x in enumerate(text.split("\n")) if i not in out)

        def run(parts: Iterator[dict[str, list]]) -> Iterator[list[tuple]]:
            for part in parts:
                yield list(zip(part["rid"], *(list(map(keep, part[c], own.furniture(part[c]))) for c in text_cols)))

        return run

    some = articles.select(F.col(id_col).alias("rid"), *text_cols)
    kind = some.schema["rid"].dataType.simpleString()
    return map_rows(some, f"rid {kind}, " + ", ".join(f"{c} string" for c in text_cols), make).withColumnRenamed("rid", id_col)
