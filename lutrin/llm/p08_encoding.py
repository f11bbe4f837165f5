"""Problem 8: encoding of a corpus with a public byte-level BPE vocabulary, as a streaming transducer.

The merges of a rank file fix which tokens may stand side by side: a sequence of tokens is the encoding of its text
exactly if each token encodes itself and each neighbouring pair is the encoding of its own bytes. So the
last token of the encoding of every prefix follows from the last tokens of shorter prefixes, no further back than
the longest token. That length is the lookahead that suffices: the transducer keeps the last tokens of so many prefixes
and emits what all of them agree on, so its memory doesn't grow with the piece, and its time grows linearly.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows

#: How the vocabulary splits text before its merges; a fixed value that belongs to the rank file.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces up to this many characters are remembered, at most CACHE of them in a task.
CACHED_CHARS, CACHE = 40, 200_000


def default_path() -> str:
    return os.environ.get("LUTRIN_TOKENIZERS", "/opt/tokenizers") + "/byte_bpe_50k.tiktoken"


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to id from a rank file; the id is also the order of the merge that makes the token."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Transducer:
    """Byte pieces to token ids, one byte at a time, with bounded lookahead."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        #: The lookahead that suffices: no token of an encoding begins further back from a prefix' end.
        self.lookahead = max(map(len, ranks))
        # A trie of the reversed tokens finds all tokens that end at a position.
        self.trie: dict = {}
        for b, i in ranks.items():
            node = self.trie
            for x in reversed(b):
                node = node.setdefault(x, {})
            node[-1] = i
        self.splits: dict[int, tuple[int, int] | None] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.before = -1  # the last token emitted of the current piece

    def split(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge gives this one; None for a single byte. The pair is the one left before the last merge."""
        if token not in self.splits:
            b = self.bytes_of[token]
            parts = [self.ranks[b[i : i + 1]] for i in range(len(b))]
            while len(parts) > 2:
                best, at = None, -1
                for i in range(len(parts) - 1):
                    r = self.ranks.get(self.bytes_of[parts[i]] + self.bytes_of[parts[i + 1]])
                    if r is not None and r < token and (best is None or r < best):
                        best, at = r, i
                if best is None:
                    break
                parts[at : at + 2] = [best]
            self.splits[token] = (parts[0], parts[1]) if len(parts) == 2 else None
        return self.splits[token]

    def may_follow(self, left: int, right: int) -> bool:
        """Whether left, right is the encoding of its own bytes: no merge over the border comes before those that made the two."""
        known = self.pairs.get((left, right))
        if known is None:
            known = self._may_follow(left, right)
            if len(self.pairs) < 2_000_000:
                self.pairs[left, right] = known
        return known

    def _may_follow(self, left: int, right: int) -> bool:
        limit = 1 << 60
        while True:
            over = self.ranks.get(self.bytes_of[left] + self.bytes_of[right])
            if over is not None and over < limit:
                return False
            # Undo the later of the two merges; the border then lies between its nearer part and the other token.
            # Equal merges run from the left, so one over the border also precedes an equal one on the right.
            for on_left in (True, False) if left > right else (False, True):
                if parts := self.split(left if on_left else right):
                    limit = left if on_left else right + 1
                    left, right = (parts[1], right) if on_left else (left, parts[0])
                    break
            else:
                return True

    def encode(self, piece: bytes) -> list[int]:
        """All tokens of a piece."""
        return [t for some in self.stream(iter((piece,))) for t in some]

    def stream(self, blocks: Iterator[bytes]) -> Iterator[list[int]]:
        """Tokens of the bytes that arrive in blocks, each as soon as it is stable."""
        keep = self.lookahead
        last: list[int] = []  # last[i]: last token of the encoding of the first base + i + 1 bytes
        data = bytearray()
        base = 0  # bytes before these are encoded and emitted
        ranks, trie, may_follow, size = self.ranks, self.trie, self.may_follow, self.bytes_of
        for block in blocks:
            for x in block:
                data.append(x)
                end = len(data)
                node, at, chosen = trie, end, -1
                # From the longest token that ends here to the shortest, the one that may follow its prefix' last token.
                ends: list[tuple[int, int]] = []
                while at > 0 and (node := node.get(data[at - 1])) is not None:
                    at -= 1
                    if (t := node.get(-1)) is not None:
                        ends.append((at, t))
                for at, t in reversed(ends):
                    if at == 0 and base == 0 or at > 0 and may_follow(last[at - 1], t) or at == 0 and may_follow(self.before, t):
                        chosen = t
                        break
                last.append(chosen)
                if end >= 4 * keep and end % keep == 0:
                    # What the encodings of the last prefixes share from the left is stable.
                    ways = [self.path(last, e) for e in range(end - keep, end + 1)]
                    shared = 0
                    while all(shared < len(w) and w[shared] == ways[0][shared] for w in ways):
                        shared += 1
                    if shared:
                        done = ways[0][:shared]
                        n = sum(len(size[t]) for t in done)
                        yield done
                        del data[:n], last[:n]
                        base += n
                        self.before = done[-1]
        yield self.path(last, len(data))

    def path(self, last: list[int], end: int) -> list[int]:
        """Tokens of the first ``end`` kept bytes, by stepping back from the last one."""
        way = []
        while end > 0:
            t = last[end - 1]
            way.append(t)
            end -= len(self.bytes_of[t])
        return way[::-1]


class Decoder:
    """Token ids to text, incrementally: bytes of a character that isn't whole yet wait for the next token."""

    def __init__(self, bytes_of: dict[int, bytes]):
        import codecs

        self.bytes_of = bytes_of
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, token: int) -> str:
        return self.state.decode(self.bytes_of[token])

    def end(self) -> str:
        return self.state.decode(b"", True)


def encode_corpus(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(id, ids): the token ids of every text, without special tokens; their strings in a text are ordinary text.

    Null and empty texts both get an empty list. Ids may be null or repeat: each row comes out once, with its id as it is.
    The rank file at ``path`` is read on the driver and sent to each executor once (under 1 MB).
    """
    ranks = df.sparkSession.sparkContext.broadcast(load_ranks(path or default_path()))

    def make():
        import regex

        t = Transducer(ranks.value)
        pieces = regex.compile(PATTERN)
        cache: dict[str, list[int]] = {}

        def run(parts: Iterator[dict[str, list]]) -> Iterator[list[tuple]]:
            for part in parts:
                rows = []
                for rid, text in zip(part["rid"], part["text"]):
                    ids: list[int] = []
                    if text:
                        for w in pieces.findall(text) if len(text) < 1_000_000 else (m[0] for m in pieces.finditer(text)):
                            ids += cache.get(w) or learn(w)
                    rows.append((rid, ids))
                yield rows

        def learn(w: str) -> list[int]:
            got = t.encode(w.encode("utf-8", "surrogatepass"))
            if len(w) <= CACHED_CHARS:
                if len(cache) >= CACHE:
                    cache.clear()
                cache[w] = got
            return got

        return run

    some = df.select(F.col(id_col).alias("rid"), F.col(text_col).alias("text"))
    kind = some.schema["rid"].dataType.simpleString()
    return map_rows(some, f"rid {kind}, text array<int>", make).select(F.col("rid").alias(id_col), F.col("text").alias("ids"))


def decode_corpus(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """(id, text): the texts of lists of token ids; null lists give null, empty ones the empty text."""
    ranks = df.sparkSession.sparkContext.broadcast(load_ranks(path or default_path()))

    def make():
        bytes_of = {i: b for b, i in ranks.value.items()}

        def run(parts: Iterator[dict[str, list]]) -> Iterator[list[tuple]]:
            for part in parts:
                rows = []
                for rid, ids in zip(part["rid"], part["ids"]):
                    d = Decoder(bytes_of)
                    rows.append((rid, None if ids is None else "".join(map(d.feed, ids)) + d.end()))
                yield rows

        return run

    some = df.select(F.col(id_col).alias("rid"), F.col(ids_col).alias("ids"))
    kind = some.schema["rid"].dataType.simpleString()
    return map_rows(some, f"rid {kind}, text string", make).select(F.col("rid").alias(id_col), "text")
