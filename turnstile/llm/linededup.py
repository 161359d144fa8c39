"""Near-duplicate lines by an exact set-similarity join.

A line's tokens are its shingles of five words (a shorter line is one token).
Tokens are ordered by rarity: a table of fixed size counts all tokens of the
corpus by a part of their hash, which ranks common passages last.  Lines of
similarity ``percent`` share a token among their first ``k - ceil(k * percent)
+ 1``, so only these prefixes are joined.  A pair must also have sizes within
the threshold (length filter) and enough tokens left behind the shared one
(positional filter); full token sets verify it.  Of two matching lines the later
one, by ``doc_id`` and line number, is removed.

Lines with equal sets of whole tokens (64 bits; the order of prefixes uses shortened
ones) are one class, represented by its first line.  Lines with
a shared prefix token are compared to the first line that has it, which settles
most of a large group.  In lists with lines that still match nothing, these are
compared to all earlier ones, inside tasks and in blocks, so that no task holds a
whole list and no pair becomes a row: first by their prefixes and sizes, then
what is left by whole sets.

Defined cases: lines without words stay; a null text stays null; rows without a
``doc_id`` stay as they are and remove nothing; rows that repeat a ``doc_id`` and
its text are one document and don't remove each other's lines, while rows that repeat
it with other texts count as later documents; a document may lose all lines and then
has an empty text.  Other columns are passed through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnstile.llm.blocks import (
    block_pairs, bundles, in_blocks, pairs_within, runs, shared_counts, shared_in_pairs,
)
from turnstile.llm.common import GIVEN, discard, given_ids, own_ids, staged
from turnstile.llm.filters import bit_filter, bits_for, tester
from turnstile.llm.words import (
    ONE, TWO, fold_table, lists, mix64, shingles, signed, slices, words_of,
)

COUNTERS = 16
RANK_BITS, HASH_BITS = 6, 38
BUCKET_BITS = RANK_BITS + HASH_BITS - 32  # name a token's bucket, in which 32 bits tell it from others
BLOCK = 512  # lines of a list in one block
FEW = 64  # lines of a list that is compared with others at a time


def line_edges(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(line starts and the end, first line of each text and the count)."""
    breaks = np.flatnonzero(raw == 10) + 1
    per_text = np.diff(np.searchsorted(breaks, offsets, side="right")) + 1
    heads = np.concatenate([[0], np.cumsum(per_text)])
    edges = np.empty(heads[-1] + 1, dtype=np.int64)
    head = np.zeros(len(edges), dtype=bool)
    head[heads] = True
    edges[head] = offsets
    edges[~head] = breaks
    return edges, heads


def line_tokens(raw: np.ndarray, edges: np.ndarray, table: np.ndarray, size: int):
    """Tokens in reading order and the line of each."""
    found = words_of(raw, edges, table)
    return shingles(found.hashes, found.firsts, size)


def rarity_ranks(docs: DataFrame, size: int) -> np.ndarray:
    """Rank (0 rarest) by the low bits of a token, from counts over the whole corpus."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = fold_table("non_space")
        total = np.zeros(1 << COUNTERS, dtype=np.int64)
        for batch in batches:
            for _, raw, offsets in slices(batch.column(0)):
                tokens, _ = line_tokens(raw, line_edges(raw, offsets)[0], table, size)
                slot = (tokens & np.uint64((1 << COUNTERS) - 1)).astype(np.int64)
                total += np.bincount(slot, minlength=1 << COUNTERS)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(used.astype(np.int32)), pa.array(total[used])], ["slot", "n"])

    counts = docs.select("text").mapInArrow(count, "slot int, n bigint").groupBy("slot").agg(
        F.sum("n").alias("n")).toArrow()
    total = np.zeros(1 << COUNTERS)
    total[counts["slot"].to_numpy()] = counts["n"].to_numpy()
    # Slots hold a share of all rare tokens each; ranks tell what stands out above that.
    even = max(1.0, float(np.median(total)))
    return np.clip(np.round(8 * np.log2(np.maximum(total, 1) / even)), 0, 63).astype(np.uint8)


def ordered_sets(tokens: np.ndarray, lines: np.ndarray, ranks: np.ndarray):
    """Distinct tokens of each line: shortened ones by (rank, hash), their lines, and whole ones.

    Tokens are distinct as a whole: two that only shorten to the same number both stay.  Whole
    tokens follow each other by line; within one they have an order of their own.
    """
    rank = ranks[(tokens & np.uint64((1 << COUNTERS) - 1)).astype(np.int64)].astype(np.uint64)
    short = (rank << np.uint64(HASH_BITS)) | (tokens >> np.uint64(64 - HASH_BITS))
    if len(lines) and lines[-1] >> (64 - RANK_BITS - HASH_BITS):  # one text of a million lines
        order = np.lexsort((tokens, short, lines))
        short, lines, tokens = short[order], lines[order], tokens[order]
        new = np.append(True, (lines[1:] != lines[:-1]) | (tokens[1:] != tokens[:-1]))
        return short[new], lines[new], tokens[new]
    width = np.uint64(RANK_BITS + HASH_BITS)
    packed = (lines.astype(np.uint64) << width) | short
    ordered = np.sort(packed)
    again = np.flatnonzero(ordered[1:] == ordered[:-1])
    if len(again):  # only lines with equal numbers need their whole tokens compared
        repeats = np.zeros(lines[-1] + 1, dtype=bool)
        repeats[(ordered[again] >> width).astype(np.int64)] = True
        at = np.flatnonzero(repeats[lines])
        order = at[np.lexsort((tokens[at], packed[at]))]
        tokens, packed = tokens.copy(), packed.copy()
        tokens[at], packed[at] = tokens[order], packed[order]
        new = np.ones(len(tokens), dtype=bool)
        new[at[1:]] = (packed[at[1:]] != packed[at[:-1]]) | (tokens[at[1:]] != tokens[at[:-1]])
        tokens = tokens[new]
        ordered = np.sort(packed[new])
    return ordered & ((np.uint64(1) << width) - np.uint64(1)), (ordered >> width).astype(np.int64), tokens


def line_keys(tokens: np.ndarray, lines: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Two numbers that tell sets of whole tokens apart."""
    edges = np.searchsorted(lines, np.arange(count + 1))
    out = []
    with np.errstate(over="ignore"):
        for values in (mix64(tokens * TWO + ONE), mix64((tokens ^ ONE) * ONE)):
            sums = np.concatenate([[np.uint64(0)], np.cumsum(values, dtype=np.uint64)])
            out.append(sums[edges[1:]] - sums[edges[:-1]])
    return out[0], out[1]


def sketched(docs: DataFrame, ranks: np.ndarray, size: int, percent: int) -> DataFrame:
    """Per document: lines, and of each line with words its number, set size, key and prefix.

    Prefixes follow each other as 64-bit numbers in one ``prefix``; ``prefix_length`` tells them apart.
    """

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = fold_table("non_space")
        for batch in batches:
            for first, raw, offsets in slices(batch.column(1)):
                edges, heads = line_edges(raw, offsets)
                tokens, lines, whole = ordered_sets(*line_tokens(raw, edges, table, size), ranks)
                sizes = np.bincount(lines, minlength=len(edges) - 1)
                key_a, key_b = line_keys(whole, lines, len(sizes))
                ends = np.concatenate([[0], np.cumsum(sizes)])
                prefix = np.where(sizes > 0, prefix_length(sizes, percent), 0)
                place = np.arange(len(tokens)) - np.repeat(ends[:-1], sizes)
                kept = place < np.repeat(prefix, sizes)
                used = np.flatnonzero(sizes)
                text = np.repeat(np.arange(len(heads) - 1), np.diff(heads))
                edges_of = np.searchsorted(used, heads)
                ends_of = np.concatenate([[0], np.cumsum(prefix)])[heads]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(offsets) - 1),
                     batch.column(2).slice(first, len(offsets) - 1), pa.array(np.diff(heads), pa.int64()),
                     lists((used - heads[text[used]]).astype(np.int32), edges_of),
                     lists(sizes[used].astype(np.int32), edges_of),
                     lists(signed(key_a[used]), edges_of), lists(signed(key_b[used]), edges_of),
                     packed_lists(tokens[kept], ends_of)],
                    ["doc_id", GIVEN, "n_lines", "line", "k", "key_a", "key_b", "prefix"])

    given = docs.schema[GIVEN].dataType.simpleString()
    return docs.select("doc_id", "text", GIVEN).mapInArrow(
        sketch, f"doc_id bigint, {GIVEN} {given}, n_lines bigint, line array<int>, k array<int>, key_a array<bigint>, "
                "key_b array<bigint>, prefix binary")


def packed_lists(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """One run of bytes per row from flat 64-bit values."""
    ends = (8 * offsets).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [
        None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(values))])


def unpacked(rows: pa.Array) -> np.ndarray:
    """All values of ``packed_lists``."""
    ends = np.frombuffer(rows.buffers()[1], dtype=np.int32)[rows.offset:rows.offset + len(rows) + 1]
    if not len(rows) or ends[0] == ends[-1]:
        return np.zeros(0, dtype=np.int64)
    return np.frombuffer(rows.buffers()[2], dtype=np.int64)[ends[0] // 8:ends[-1] // 8]


def prefix_length(sizes: np.ndarray, percent: int) -> np.ndarray:
    return sizes - -(-sizes * percent // 100) + 1


def line_prefixes(batch: pa.RecordBatch, percent: int):
    """Row of each line in a batch of (``doc_id``, ``line``, ``k``, ``prefix``), number, size and
    length of its prefix, and all tokens."""
    row = np.repeat(np.arange(batch.num_rows), np.diff(batch.column(1).offsets.to_numpy()))
    line, k = batch.column(1).flatten().to_numpy(), batch.column(2).flatten().to_numpy()
    return row, line, k, prefix_length(k.astype(np.int64), percent), unpacked(batch.column(3))


def first_of_equals(tokens: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Tokens of a line that shorten to the same number stand side by side: the first stands for them."""
    return np.append(True, (tokens[1:] != tokens[:-1]) | (of[1:] != of[:-1]))[:len(tokens)]


def shared_tokens(lines: DataFrame, percent: int) -> DataFrame:
    """``token`` of all that stand in the prefixes of two lines or more.

    Tokens travel as lists of 32 bits by bucket, each at most twice from a batch.
    """
    low = (1 << BUCKET_BITS) - 1

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *_, counts, tokens = line_prefixes(batch, percent)
            tokens = tokens[first_of_equals(tokens, np.repeat(np.arange(len(counts)), counts))]
            tokens, times = np.unique(tokens, return_counts=True)
            tokens = np.repeat(tokens, np.minimum(times, 2))
            bucket = (tokens & low).astype(np.uint16)
            order = np.argsort(bucket, kind="stable")
            edges = np.searchsorted(bucket[order], np.arange(low + 2))
            used = np.flatnonzero(np.diff(edges))
            rest = (tokens[order] >> BUCKET_BITS).astype(np.uint32).view(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(used.astype(np.int32)), lists(rest, np.append(edges[used], len(rest)))],
                ["bucket", "rest"])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in runs(batches, 1):
            rest = np.sort(run.column(1).flatten().to_numpy().view(np.uint32))
            rest = np.unique(rest[1:][rest[1:] == rest[:-1]]).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array((rest << BUCKET_BITS) | run.column(0)[0].as_py())], ["token"])

    sent = lines.filter("doc_id IS NOT NULL").select("doc_id", "line", "k", "prefix").mapInArrow(
        send, "bucket int, rest array<int>")
    return sent.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(find, "token bigint")


def postings(lines: DataFrame, percent: int, wanted: np.ndarray) -> DataFrame:
    """(``token``, ``doc_id``, ``line``, size, position) of (at least) the wanted tokens of all prefixes."""

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        test = tester(wanted)
        for batch in batches:
            doc, line, k, counts, tokens = line_prefixes(batch, percent)
            row = np.repeat(np.arange(len(k)), counts)
            place = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
            kept = np.flatnonzero(first_of_equals(tokens, row) & test(tokens.view(np.uint64)))
            tokens, row, place = tokens[kept], row[kept], place[kept]
            yield pa.RecordBatch.from_arrays(
                [pa.array(tokens), batch.column(0).take(pa.array(doc[row])), pa.array(line[row]),
                 pa.array(k[row]), pa.array(place.astype(np.int32))], ["token", "doc_id", "line", "k", "at"])

    return lines.filter("doc_id IS NOT NULL").select("doc_id", "line", "k", "prefix").mapInArrow(
        post, "token bigint, doc_id bigint, line int, k int, at int")


def with_hubs(postings_: DataFrame) -> DataFrame:
    """Every posting but the first of its list, by ``doc_id`` and line, with that one, the list's hub."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token, held = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            tokens, *values = (column.to_numpy() for column in batch.columns)
            starts = np.flatnonzero(np.append(True, tokens[1:] != tokens[:-1]))
            of = np.repeat(starts, np.diff(np.append(starts, len(tokens))))
            hubs = [value[of] for value in values]
            if tokens[0] == token:  # a list goes on
                for hub, value in zip(hubs, held):
                    hub[of == 0] = value
            token, held = tokens[-1], [hub[-1] for hub in hubs]
            kept = np.flatnonzero((values[0] != hubs[0]) | (values[1] != hubs[1]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(column[kept]) for column in (tokens, *values, *hubs)],
                [*names, *(f"hub_{name}" for name in names[1:])])

    names = ["token", "doc_id", "line", "k", "at"]
    rows = postings_.select(*names).repartition("token").sortWithinPartitions("token", "doc_id", "line")
    return rows.mapInArrow(
        add, "token bigint, doc_id bigint, line int, k int, at int, "
             "hub_doc_id bigint, hub_line int, hub_k int, hub_at int")


def keyed(lines: DataFrame, wanted: np.ndarray) -> DataFrame:
    """Size and keys of (at least) the lines whose first key passes the filter."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        test = tester(wanted)
        for batch in batches:
            doc = np.repeat(np.arange(batch.num_rows), np.diff(batch.column(1).offsets.to_numpy()))
            line, k, key_a, key_b = (batch.column(i).flatten() for i in range(1, 5))
            kept = np.flatnonzero(test(key_a.to_numpy().view(np.uint64)))
            at = pa.array(kept)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(doc[kept])), line.take(at), k.take(at), key_a.take(at),
                 key_b.take(at)], ["doc_id", "line", "k", "key_a", "key_b"])

    return lines.filter("doc_id IS NOT NULL").select("doc_id", "line", "k", "key_a", "key_b").mapInArrow(
        cut, "doc_id bigint, line int, k int, key_a bigint, key_b bigint")


LINE_FACTOR = 2654435761  # spreads line numbers over the low bits that filters use


def full_sets(docs: DataFrame, wanted: np.ndarray, size: int) -> DataFrame:
    """Whole token sets of (at least) the lines whose number passes the filter.

    Only the bytes of such lines are looked at for words.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, test = fold_table("non_space"), tester(wanted)
        for batch in batches:
            ids = batch.column(0).fill_null(0).to_numpy()
            for first, raw, offsets in slices(batch.column(1)):
                edges, heads = line_edges(raw, offsets)
                text = np.repeat(np.arange(len(heads) - 1), np.diff(heads))
                line = np.arange(len(edges) - 1) - heads[text]
                used = np.flatnonzero(test((ids[first + text] ^ (line * LINE_FACTOR)).view(np.uint64)))
                lengths = edges[used + 1] - edges[used]
                borders = np.concatenate([[0], np.cumsum(lengths)])
                take = np.arange(borders[-1]) + np.repeat(edges[used] - borders[:-1], lengths)
                full, of = line_tokens(raw[take], borders, table, size)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(offsets) - 1).take(pa.array(text[used])),
                     pa.array(line[used].astype(np.int32)),
                     lists(signed(full), np.searchsorted(of, np.arange(len(used) + 1)))],
                    ["doc_id", "line", "tokens"])

    return docs.select("doc_id", "text").filter("doc_id IS NOT NULL").mapInArrow(
        emit, "doc_id bigint, line int, tokens array<bigint>").filter(F.size("tokens") > 0)


def prefixes(lines: DataFrame, percent: int, wanted: np.ndarray) -> DataFrame:
    """Sizes and whole prefixes of (at least) the lines whose number passes the filter."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        test = tester(wanted)
        for batch in batches:
            doc, line, k, counts, tokens = line_prefixes(batch, percent)
            ids = batch.column(0).to_numpy()
            kept = np.flatnonzero(test((ids[doc] ^ (line.astype(np.int64) * LINE_FACTOR)).view(np.uint64)))
            ends = np.cumsum(counts)
            borders = np.concatenate([[0], np.cumsum(counts[kept])])
            take = np.arange(borders[-1]) + np.repeat(ends[kept] - counts[kept] - borders[:-1], counts[kept])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(doc[kept])), pa.array(line[kept]), pa.array(k[kept]),
                 lists(tokens[take], borders)], ["doc_id", "line", "k", "prefix"])

    return lines.filter("doc_id IS NOT NULL").select("doc_id", "line", "k", "prefix").mapInArrow(
        cut, "doc_id bigint, line int, k int, prefix array<bigint>")


def open_pairs(
    run: pa.RecordBatch, edges: np.ndarray, marks: np.ndarray, units: np.ndarray,
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of an earlier line and a later one that matches nothing so far, in one list,
    how many ``marks`` the two share, and whether both are one line of rows that repeat a document."""
    nodes = run.column(4)
    if pa.types.is_integer(nodes.type):
        rank = nodes.to_numpy()
    else:
        nodes = nodes.to_pylist()
        places = {node: place for place, node in enumerate(sorted(set(nodes)))}
        rank = np.array([places[node] for node in nodes], dtype=np.int64)
    done = run.column(5).to_numpy(zero_copy_only=False)
    if len(edges) > 2 or run.num_rows <= FEW:
        a, b = pairs_within(edges)
        shared = shared_in_pairs(marks, units, edges, a, b)
    else:
        a, b = block_pairs(run)
        shared = shared_counts(marks, units, run.num_rows)[a, b]
    swap = rank[a] > rank[b]
    a, b = np.where(swap, b, a), np.where(swap, a, b)
    kept = ~done[b]
    return a[kept], b[kept], shared[kept], rank[a[kept]] == rank[b[kept]]


def close_lines(members: DataFrame, percent: int) -> DataFrame:
    """(``token``, ``node``, ``done``) of lines of a list that the filters leave a partner in it.

    Two lines are compared in the list of the first token that their prefixes share.  If one of them
    is that list's first line they have been compared, and if the later still is open, they don't match.
    Of two lines, the prefix that ends first in the order of tokens holds all that the
    other can share with it up to there, so the tokens shared by the prefixes and
    what is left of that line bound their intersection.  Tokens that shorten to the
    same number leave open which prefix ends first, and count as shared.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run, edges in bundles(batches, 3, FEW):
            k = run.column(6).to_numpy().astype(np.int64)
            prefix = run.column(7)
            counts = np.diff(prefix.offsets.to_numpy())
            tokens = prefix.flatten().to_numpy()
            ends = np.cumsum(counts)
            last, behind = tokens[ends - 1], k - counts
            of = np.repeat(np.arange(len(k)), counts)
            repeated = np.append(False, (tokens[1:] == tokens[:-1]) & (of[1:] == of[:-1]))
            again = np.bincount(of[repeated], minlength=len(k))
            a, b, shared, same = open_pairs(run, edges, tokens[~repeated], of[~repeated])
            fits = 100 * np.minimum(k[a], k[b]) >= percent * np.maximum(k[a], k[b])
            a, b = a[fits], b[fits]
            shared = shared[fits] + np.minimum(again[a], again[b])
            most = shared + np.where(last[a] == last[b], np.maximum(behind[a], behind[b]),
                                     np.where(last[a] < last[b], behind[a], behind[b]))
            kept = 100 * most >= percent * (k[a] + k[b] - most)
            if kept.any():
                early = ~repeated & (tokens < run.column(0).to_numpy()[of])
                before = open_pairs(run, edges, tokens[early], of[early])[2]
                kept &= same[fits] | (before[fits] == 0)
            rows = pa.array(np.unique(np.concatenate([a[kept], b[kept]])))
            yield pa.RecordBatch.from_arrays(
                [run.column(i).take(rows) for i in (0, 4, 5)], ["token", "node", "done"])

    node = members.schema["node"].dataType.simpleString()
    return in_blocks(members, BLOCK, "token", "node", "done", "k", "prefix").mapInArrow(
        cut, f"token bigint, node {node}, done boolean")


def matching_lines(members: DataFrame, percent: int) -> DataFrame:
    """``node`` of open lines whose whole set matches an earlier line's of their list."""

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run, edges in bundles(batches, 3, FEW):
            tokens = run.column(6)
            k = np.diff(tokens.offsets.to_numpy())
            a, b, shared, _ = open_pairs(run, edges, tokens.flatten().to_numpy(), np.repeat(np.arange(len(k)), k))
            hit = 100 * shared >= percent * (k[a] + k[b] - shared)
            yield pa.RecordBatch.from_arrays(
                [run.column(4).take(pa.array(np.unique(b[hit])))], ["node"])

    node = members.schema["node"].dataType.simpleString()
    return in_blocks(members, BLOCK, "token", "node", "done", "tokens").mapInArrow(match, f"node {node}")


class LineDedup:
    """Lines of ``docs`` (``doc_id``, ``text``) that match an earlier line."""

    def __init__(self, docs: DataFrame, size: int = 5, percent: int = 80):
        self.columns, self.size, self.percent = docs.columns, size, percent
        self.docs = own_ids(docs)
        self.ranks = rarity_ranks(self.docs, size)
        self.lines = staged(sketched(self.docs, self.ranks, size, percent), "lines")
        each = self.lines.filter("doc_id IS NOT NULL").select(
            "doc_id", F.inline(F.arrays_zip("line", "k", "key_a", "key_b")))
        # Order of lines as one number; ids that leave no room for it need a decimal.
        low, high, most = self.lines.filter("doc_id IS NOT NULL").agg(
            F.min("doc_id"), F.max("doc_id"), F.max("n_lines")).first()
        fits = low is not None and low >= 0 and high < 1 << 39 and most <= 1 << 24
        kind, room = ("long", 24) if fits else ("decimal(38,0)", 31)
        self.place = lambda doc="doc_id", line="line": (
            F.col(doc).cast(kind) * F.lit(1 << room).cast(kind) + F.col(line)).cast(kind).alias("node")
        doc = F.shiftright("node", room) if fits else F.floor(F.col("node") / F.lit(1 << room).cast(kind)).cast("long")
        line = F.col("node") - doc.cast(kind) * F.lit(1 << room).cast(kind)
        self.parts = doc.alias("doc_id"), line.cast("int").alias("line")
        self.number = doc.bitwiseXOR(line.cast("long") * F.lit(LINE_FACTOR)).alias("number")
        self.copies = staged(self._copies(each.select("k", "key_a", "key_b", self.place())), "copies")
        self.later = staged(self._later(), "later")

    def _copies(self, each: DataFrame) -> DataFrame:
        """``node`` of lines whose class has an earlier one."""
        key = ["k", "key_a", "key_b"]
        classes = staged(
            each.groupBy(*key).agg(F.min("node").alias("first"), F.max("node").alias("last"))
            .filter("first < last").drop("last"), "classes")
        lines = keyed(self.lines, bit_filter(classes, "key_a", bits_for(classes.count())))
        return lines.select(*key, self.place()).join(classes, key).filter("node > first").select("node")

    def _later(self) -> DataFrame:
        """``node`` of first lines that match the first line of an earlier class."""
        tokens = staged(shared_tokens(self.lines, self.percent), "tokens")
        some = postings(self.lines, self.percent, bit_filter(tokens, "token", bits_for(tokens.count())))
        discard(tokens)
        hub = self.place("hub_doc_id", "hub_line").alias("hub")
        shared = staged(
            with_hubs(some).select("token", self.place(), "k", "at", hub, "hub_k", "hub_at"), "postings")
        later = self._matches(shared)

        # Lists in which a line still matches nothing: all others in it are compared, too.
        settled = later.withColumn("copy", F.lit(False)).unionByName(self.copies.withColumn("copy", F.lit(True)))
        open_ = shared.select("token", "node").join(settled, "node", "left").filter(
            ~F.coalesce("copy", F.lit(False))).select("token", "node", F.col("copy").isNotNull().alias("done"))
        open_ = staged(open_, "open")
        discard(shared)
        lists_ = open_.groupBy("token").agg(F.count(F.lit(1)).alias("members"), F.min("done").alias("all_done"))
        lists_ = lists_.filter("members > 1 AND NOT all_done").select("token", "members")
        left = staged(open_.join(lists_, "token"), "left")
        discard(open_)
        near = staged(close_lines(left.join(self._prefixes(left.select("node").distinct()), "node"), self.percent)
                      .groupBy("token", "node", "done").agg(F.count(F.lit(1)).alias("rows")), "near")
        discard(left)
        sets = self._sets(near.select("node").distinct())
        # Rows may be counted more than once: the count only tells how many blocks to make.
        members = near.join(near.groupBy("token").agg(F.sum("rows").alias("members")), "token").join(sets, "node")
        found = staged(matching_lines(members, self.percent).distinct(), "found")
        discard(near, sets)
        return later.unionByName(found).distinct()

    def _matches(self, shared: DataFrame) -> DataFrame:
        """Distinct later lines that match the first line of a list they are in.

        With a token at the places ``at``, the sets share as many as both have before it, the token
        itself, and as many as both have behind it, at most (positional filter).  What is left is
        held against whole prefixes, as in ``close_lines``, before whole sets are read.
        """
        most = F.least("at", "hub_at") + 1 + F.least(
            F.col("k") - F.col("at") - 1, F.col("hub_k") - F.col("hub_at") - 1)
        pairs = shared.filter(100 * most >= self.percent * (F.col("k") + F.col("hub_k") - most))
        pairs = pairs.select("hub", "node").distinct().join(self.copies, "node", "left_anti")
        pairs = staged(pairs.select("hub", "node"), "pairs")
        prefix = staged(self._prefixes(pairs.select(F.explode(F.array("hub", "node")).alias("node")).distinct())
                        .withColumn("again", F.size("prefix") - F.size(F.array_distinct("prefix"))), "prefixes")
        by_node = prefix.repartition("node")  # one exchange for both lines of a pair
        hub = by_node.select(*[F.col(c).alias("hub" if c == "node" else f"hub_{c}") for c in prefix.columns])
        last, hub_last = F.element_at("prefix", -1), F.element_at("hub_prefix", -1)
        behind, hub_behind = F.col("k") - F.size("prefix"), F.col("hub_k") - F.size("hub_prefix")
        most = F.size(F.array_intersect("prefix", "hub_prefix")) + F.least("again", "hub_again") + (
            F.when(last == hub_last, F.greatest(behind, hub_behind))
            .when(last < hub_last, behind).otherwise(hub_behind))
        close = staged(
            pairs.join(hub, "hub").join(by_node, "node")
            .filter(100 * most >= self.percent * (F.col("k") + F.col("hub_k") - most)).select("hub", "node"), "close")
        discard(pairs, prefix)
        sets = self._sets(close.select(F.explode(F.array("hub", "node")).alias("node")).distinct())
        by_node = sets.repartition("node")
        both = F.size(F.array_intersect("tokens", "hub_tokens"))
        union = F.size("tokens") + F.size("hub_tokens") - both
        found = staged(
            close.join(by_node.select(F.col("node").alias("hub"), F.col("tokens").alias("hub_tokens")), "hub")
            .join(by_node, "node")
            .filter(100 * both >= self.percent * union)
            .select("node").distinct(), "matched")
        discard(close, sets)
        return found

    def _wanted(self, nodes: DataFrame) -> np.ndarray:
        """Filter of some lines, roomy since what passes it is written."""
        nodes = staged(nodes, "nodes")
        wanted = bit_filter(nodes.select(self.number), "number", bits_for(8 * nodes.count()))
        discard(nodes)
        return wanted

    def _prefixes(self, nodes: DataFrame) -> DataFrame:
        """Sizes and prefixes of (at least) some lines; joins drop the others."""
        return prefixes(self.lines, self.percent, self._wanted(nodes)).select(self.place(), "k", "prefix")

    def _sets(self, nodes: DataFrame) -> DataFrame:
        """Whole token sets of (at least) some first lines; joins drop the others."""
        return staged(
            full_sets(self.docs, self._wanted(nodes), self.size)
            .select(self.place(), F.array_distinct("tokens").alias("tokens")), "sets")

    def removed(self) -> DataFrame:
        """``doc_id`` and ``line`` (from 0) of every line that goes."""
        return self.copies.unionByName(self.later).select(*self.parts).distinct()

    def removed_lists(self) -> DataFrame:
        return self.removed().groupBy("doc_id").agg(
            F.array_sort(F.collect_list("line")).alias("removed"))

    def report(self) -> DataFrame:
        """Per document: lines, lines removed, and which (numbers from 0, comma-joined)."""
        return self.lines.join(self.removed_lists(), "doc_id", "left").select(
            F.col(GIVEN).cast("long").alias("doc_id"), "n_lines",
            F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"),
            F.coalesce(F.array_join(F.col("removed").cast("array<string>"), ","), F.lit(""))
            .alias("removed_lines"),
        )

    def apply(self) -> DataFrame:
        """The documents, all columns, with the removed lines gone from their texts."""
        goes = self.removed_lists().select(
            F.col("doc_id").alias("__id"), line_mask("removed").alias("__goes"))
        lines = F.filter(
            F.split("text", "\n", -1), lambda _, i: ~F.coalesce(F.get(F.col("__goes"), i), F.lit(False)))
        text = F.when(F.col("__goes").isNull(), F.col("text")).otherwise(F.array_join(lines, "\n"))
        joined = self.docs.join(goes, F.col("doc_id") == F.col("__id"), "left")
        return given_ids(joined.withColumn("text", text)).select(*[f"`{name}`" for name in self.columns])


@F.pandas_udf(T.ArrayType(T.BooleanType()))
def line_mask(removed: pd.Series) -> pd.Series:
    """Line numbers as flags, so that a lookup by line takes one step."""

    def mask(numbers):
        out = np.zeros(int(max(numbers)) + 1, dtype=bool)
        out[np.asarray(numbers, dtype=np.int64)] = True
        return out

    return removed.map(mask)
