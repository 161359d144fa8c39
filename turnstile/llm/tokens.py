"""Edit-aware token counts.

A text is cut into pre-tokens, which a byte-level BPE encodes one by one; its
token count is the sum over them.  A document's counts are kept in a segment
tree: leaves are runs of ``LEAF`` pre-tokens with their code points and tokens, an
inner node sums two children.  An edit replaces a stretch of code points.  Only
the leaves that it touches are cut and encoded again, with the leaf before if the
edit is at a leaf's beginning (a pre-token's end depends on what follows) and on to
where a new border falls on an old one behind the edit; from there on the old
pre-tokens hold.  Their sums are then updated up to the root.

Pre-tokens' counts are kept in a table of bounded size per task, so that a
repeated word is encoded once.

Defined cases: a null text is empty and has no tokens; an empty text has one
empty leaf; edits beyond the end of a text are cut to it; a document without
edits keeps its counts; rows that repeat a ``doc_id`` are counted each by itself
and edited alike.  Other columns are not read.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAF = 64
CONTEXT = 3  # code points behind a pre-token that its end may depend on
KEPT = 1 << 18  # pre-tokens whose counts a task keeps

# Fixed value: how the byte-level vocabularies cut texts.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Counter:
    """Tokens of pre-tokens under a vocabulary file (base64 token and rank per line)."""

    def __init__(self, vocabulary: bytes, pattern: str = PATTERN):
        ranks = {base64.b64decode(token): int(rank)
                 for token, rank in (line.split() for line in vocabulary.splitlines() if line)}
        self.coding = tiktoken.Encoding("counting", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(pattern)
        self.known: dict[str, int] = {}

    def cut(self, text: str, start: int = 0) -> list[str]:
        return self.pattern.findall(text, start)

    def counts(self, pieces: list[str]) -> list[int]:
        known = self.known
        out = []
        for piece in pieces:
            n = known.get(piece)
            if n is None:
                if len(known) >= KEPT:
                    known.clear()
                n = known[piece] = len(self.coding.encode_ordinary(piece))
            out.append(n)
        return out


@dataclass
class Tree:
    """Sums of a text: per leaf its pre-tokens, code points and tokens; ``nodes`` above them.

    ``nodes`` is a binary heap from 1 on; the leaves stand from ``width`` on.
    """

    leaves: list[tuple[int, int, int]]
    nodes: np.ndarray = field(init=False)

    def __post_init__(self):
        width = 1
        while width < len(self.leaves):
            width *= 2
        self.nodes = np.zeros((2 * width, 3), dtype=np.int64)
        if self.leaves:
            self.nodes[width:width + len(self.leaves)] = self.leaves
        level = width
        while level > 1:
            below = self.nodes[level:2 * level]
            self.nodes[level // 2:level] = below[0::2] + below[1::2]
            level //= 2

    @property
    def width(self) -> int:
        return len(self.nodes) // 2

    @property
    def tokens(self) -> int:
        return int(self.nodes[1][2])

    @property
    def chars(self) -> int:
        return int(self.nodes[1][1])

    def find(self, place: int) -> tuple[int, int]:
        """Leaf that holds the code point, and where the leaf begins; the last one beyond the end."""
        node, start = 1, 0
        while node < self.width:
            node *= 2
            if place >= start + self.nodes[node][1] and self.nodes[node + 1][1]:
                start += int(self.nodes[node][1])
                node += 1
        return node - self.width, start

    def replace(self, first: int, last: int, leaves: list[tuple[int, int, int]]) -> int:
        """Puts leaves in place of first to last; returns how many nodes were summed anew."""
        if len(leaves) != last - first:
            self.leaves[first:last] = leaves
            self.__post_init__()
            return len(self.nodes)
        self.leaves[first:last] = leaves
        touched = set(range(self.width + first, self.width + last))
        for node, leaf in zip(sorted(touched), leaves):
            self.nodes[node] = leaf
        count = len(touched)
        while touched and touched != {1}:
            touched = {node // 2 for node in touched}
            for node in touched:
                self.nodes[node] = self.nodes[2 * node] + self.nodes[2 * node + 1]
            count += len(touched)
        return count


def build(text: str, counter: Counter) -> Tree:
    pieces = counter.cut(text)
    return Tree(shared_out(pieces, counter.counts(pieces), 0))


def edit(text: str, tree: Tree, start: int, end: int, new: str, counter: Counter) -> tuple[str, int]:
    """Replaces code points ``start`` to ``end`` and updates the tree; returns the text and how
    many pre-tokens were encoded."""
    start, end = min(max(start, 0), len(text)), min(max(start, end, 0), len(text))
    changed, shift = text[:start] + new + text[end:], len(new) - (end - start)
    first, low, last, high = 0, 0, len(tree.leaves), tree.chars
    if tree.leaves:
        first, low = tree.find(start)
        while first > 0 and start - low < CONTEXT:
            first -= 1
            low -= tree.leaves[first][1]
        last, high = tree.find(end)
        high += tree.leaves[last][1]
        last += 1
    # Behind the edit, texts agree: once a new border is an old leaf's, all that follow are.
    pieces = []
    for found in counter.pattern.finditer(changed, low):
        while found.start() > high + shift and last < len(tree.leaves):
            high += tree.leaves[last][1]
            last += 1
        if found.start() == high + shift and found.start() > low:
            break
        pieces.append(found.group())
    else:
        last = len(tree.leaves)
    tree.replace(first, last, shared_out(pieces, counter.counts(pieces), last - first))
    return changed, len(pieces)


def shared_out(pieces: list[str], counts: list[int], leaves: int) -> list[tuple[int, int, int]]:
    """Leaves of these pre-tokens; as many as before where that leaves them a fair size."""
    share = -(-len(pieces) // max(1, leaves))
    if not (0 < share <= 2 * LEAF and share * (leaves - 1) < len(pieces)):
        share = LEAF
    return [
        (len(part), sum(map(len, part)), sum(counts[at:at + share]))
        for at in range(0, len(pieces), share) for part in (pieces[at:at + share],)
    ]


def with_edits(docs: DataFrame, edits: DataFrame) -> DataFrame:
    """``doc_id``, ``text`` and the document's array of ``edits``."""
    wanted = edits.select(F.col("doc_id").alias("_id"), "edits")
    return docs.select("doc_id", "text").join(
        wanted, F.col("doc_id").eqNullSafe(F.col("_id")), "left").select("doc_id", "text", "edits")


def count_tokens(docs: DataFrame, vocabulary: bytes, pattern: str = PATTERN) -> DataFrame:
    """Token counts of ``docs`` (``doc_id``, ``text``, ``edits``) before and after their edits.

    ``edits`` is an array of (``start``, ``end``, ``new``) in the order in which they are made,
    each in code points of the text it finds.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # a vocabulary file, some megabytes
    names = ["doc_id", "n_chars", "n_pretokens", "n_tokens", "n_edits", "n_tokens_edited", "n_encoded", "n_leaves"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(shared.value, pattern)
        for batch in batches:
            rows = []
            for text, changes in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                text = text or ""
                tree = build(text, counter)
                before, encoded = tree.nodes[1].tolist(), 0
                for change in changes or []:
                    text, n = edit(text, tree, change["start"], change["end"], change["new"] or "", counter)
                    encoded += n
                rows.append((before[1], before[0], before[2], len(changes or []), tree.tokens, encoded,
                             len(tree.leaves)))
            columns = list(zip(*rows)) if rows else [[]] * 7
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, pa.int64()) for c in columns]], names)

    return docs.select("doc_id", "text", "edits").mapInArrow(
        count, f"doc_id {kind}, " + ", ".join(f"{name} bigint" for name in names[1:]))
