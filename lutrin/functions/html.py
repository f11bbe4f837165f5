"""Article records from bulletin pages: one parse of a page gives all fields."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

IMAGE = StructType([StructField("url", StringType()), StructField("legend", StringType())])
RECORD = StructType([*(StructField(n, StringType()) for n in ("article", "bulletin", "date", "rubrique", "titre", "auteur", "texte")), StructField("images", ArrayType(IMAGE)), StructField("contact", StringType())])

_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Elements that end an open paragraph. Fixed values.
_BLOCKS = frozenset("address blockquote center div dl fieldset form h1 h2 h3 h4 h5 h6 hr ol p pre table ul".split())


class Node:
    __slots__ = ("tag", "attrs", "parent", "items")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.items: list[Node | str] = []

    def walk(self) -> Iterator[Node]:
        """All elements below, in document order."""
        stack = [x for x in reversed(self.items) if isinstance(x, Node)]
        while stack:
            n = stack.pop()
            yield n
            stack.extend(x for x in reversed(n.items) if isinstance(x, Node))

    def has_class(self, name: str) -> bool:
        return name in self.attrs.get("class", "").split()

    def text(self) -> str:
        return "".join(self.strings())

    def strings(self) -> Iterator[str]:
        """All texts below, in document order, whatever the depth of nesting."""
        stack: list[Node | str] = list(reversed(self.items))
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                yield x
            else:
                stack.extend(reversed(x.items))

    def stripped(self) -> str:
        """Its strings, each without outer white space, put together."""
        return "".join(s.strip() for s in self.strings())

    def following(self, tag: str) -> Node | None:
        """The next sibling of this tag."""
        items = self.parent.items if self.parent else []
        at = next((i for i, x in enumerate(items) if x is self), len(items))
        return next((x for x in items[at + 1 :] if isinstance(x, Node) and x.tag == tag), None)


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.here = Node("", {}, None)

    def handle_starttag(self, tag, attrs):
        if tag in _BLOCKS:
            self._close("p", "td", "table")
        if tag in ("td", "tr", "li"):
            self._close(tag, "table" if tag != "li" else "ul")
        node = Node(tag, {k: v or "" for k, v in attrs}, self.here)
        self.here.items.append(node)
        if tag not in _VOID:
            self.here = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.here = self.here.parent or self.root

    def handle_endtag(self, tag):
        n = self.here
        while n.parent is not None and n.tag != tag:
            n = n.parent
        if n.parent is not None:
            self.here = n.parent

    def handle_data(self, data):
        self.here.items.append(data)

    def _close(self, tag: str, *limits: str) -> None:
        n = self.here
        while n.parent is not None and n.tag not in limits:
            if n.tag == tag:
                self.here = n.parent
                return
            n = n.parent


def parse_html(page: str) -> Node:
    b = _Builder()
    b.feed(page)
    b.close()
    return b.root


def _cells(root: Node, label: str) -> Iterator[Node]:
    """The cells beside those whose first label holds ``label``, in document order."""
    # One walk: a label is the first one of every cell around it that has none yet.
    cells: list[Node] = []
    first: dict[int, Node] = {}
    for n in root.walk():
        if n.tag == "td":
            cells.append(n)
        elif n.tag == "span" and n.has_class("style28"):
            up = n.parent
            while up is not None and not (up.tag == "td" and id(up) in first):
                if up.tag == "td":
                    first[id(up)] = n
                up = up.parent
    for td in cells:
        if (span := first.get(id(td))) is not None and label in span.text() and (beside := td.following("td")) is not None:
            yield beside


def _images(root: Node) -> list[dict[str, str]]:
    """Images of the article with the caption that follows, before the next image."""
    out: list[dict[str, str]] = []
    for n in root.walk():
        if n.tag == "img" and "margin-bottom:5px" in n.attrs.get("style", ""):
            out.append({"url": n.attrs.get("src", ""), "legend": ""})
        elif n.tag == "span" and n.has_class("style21") and out and not out[-1]["legend"]:
            out[-1]["legend"] = n.stripped()
    return out


#: What the fields look like in a page. Fixed values.
_NUMBER, _BULLETIN, _AUTHOR = r"/(\d+)\.htm", r"BE\s+\w+\s+(\d+)", r"-\s*(.+?)-\s*email"
_DAY, _TWO_DIGIT_DAY, _ISSUE_DAY = r"(\d{1,2}/\d{2}/\d{4})", r"(\d{2}/\d{2}/\d{4})", r"\d+/\d+/\d+"


def extract(page: str | None, strict_images: bool = False, article_from: str = "style88", first_title_node: bool = False, two_digit_days: bool = False) -> dict | None:
    """The record of a page; null for null. Fields that aren't found are '', an article number that isn't found is null.

    Where several places match: bulletin, rubrique, titre and auteur take the first, date and contact the last; an author's cell that
    holds no author is passed over. ``texte`` has only the text directly in its spans. Variants: ``strict_images`` leaves images
    empty, as a parser does that treats br as empty; ``article_from="style15"`` takes the number from the closing line instead of
    the address (last match, '' if none); ``first_title_node`` takes the first own text of any title span as it is (null if none), as
    the corpus has it; ``two_digit_days`` knows no other dates.
    """
    if page is None:
        return None
    root = parse_html(page)
    spans = [n for n in root.walk() if n.tag == "span"]

    def of(cls: str) -> list[Node]:
        return [n for n in spans if n.has_class(cls)]

    def own_text(cls: str) -> str | None:
        """The first text directly in any span of exactly this class."""
        return next((x for n in spans if n.attrs.get("class") == cls for x in n.items if isinstance(x, str)), None)

    title = next((n.text() for n in root.walk() if n.tag == "title"), "")
    dates = [m[1] for n in of("style15") if (m := re.search(_TWO_DIGIT_DAY if two_digit_days else _DAY, n.text()))]
    if article_from == "style15":
        article = next((m[1] for n in reversed(of("style15")) if (m := re.search(_NUMBER, n.text()))), "")
    else:
        article = m[1] if (m := re.search(_NUMBER + "$", own_text("style88") or "")) else None
    heading = next(iter(of("style17")), None)
    headings = (t for n in of("style42") if not re.match(_ISSUE_DAY, t := n.stripped()))
    authors = (m[1].strip() for cell in _cells(root, "dacteur") if (m := re.search(_AUTHOR, cell.text())))
    contact = None
    for contact in _cells(root, "contact"):
        pass
    pieces = [x for p in root.walk() if p.tag == "p" and p.attrs.get("class") == "style96" for n in p.walk() if n.tag == "span" and n.attrs.get("class") == "style95" for x in n.items if isinstance(x, str) and x != "\n"]
    return {
        "article": article,
        "bulletin": m[1] if (m := re.search(_BULLETIN, title)) else "",
        "date": dates[-1] if dates else "",
        "rubrique": next(headings, ""),
        "titre": own_text("style17") if first_title_node else heading.stripped() if heading else "",
        "auteur": next(authors, ""),
        "texte": "".join(pieces),
        "images": [] if strict_images else _images(root),
        "contact": contact.stripped() if contact else "",
    }


def extractor(**variants):
    """A vectorised function from pages to records; ``variants`` as in ``extract``."""

    @F.pandas_udf(RECORD)
    def run(pages: pd.Series) -> pd.DataFrame:
        empty = dict.fromkeys(RECORD.fieldNames())
        return pd.DataFrame([extract(p, **variants) or empty for p in pages], columns=RECORD.fieldNames())

    return run
