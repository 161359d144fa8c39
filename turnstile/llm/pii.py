"""Personal data: spans by rules, and more spans by a character tagger.

Rules find emails, IP addresses, cards and phones in whole texts.  A
bidirectional LSTM with CRF transitions, trained in numpy, then reads every part
of a text that holds a digit, an at sign or a spelled "at" or "dot", which no spelling of
a kind that it knows does without, and tags characters of the same kinds.  It works on
overlapping windows; the scores of a character are averaged over its windows, most where it is
central, and the best tag line of a whole stretch is decoded at once, so that window borders
leave no trace.  Long stretches overlap by more than any span, and a span is the one's in whose
middle it begins.  A tagged span is added where it holds as many digits as its kind asks for (a card
with its check sum, an address with numbers up to 255) and touches no span of the rules; these stay
as they are.
How it is separated or spelled is the tagger's to know.

Training takes windows of at most ``MAX_WINDOWS`` documents (those with the
smallest hashes of their ids; a documented bound) labelled by the rules, and the
same windows with their spans replaced by other spellings, such as phones without
a plus sign, cards with dots or over lines, and spelled-out addresses.  Where no document holds a span, there is no model and the rules
stand alone.  Stretches go to the tagger ``SLICE`` characters at a time.

Defined cases: a null text is empty; very long runs of digits, letters or signs
take time in proportion to their length; rows that repeat a ``doc_id`` are read
each for itself.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnstile.llm.tagger import Tagger, char_ids

KINDS = ("email", "ip", "card", "phone")
MAX_WINDOWS = 3000
RESPELLINGS = 6  # copies of a window that holds spans, each with other spellings
STEPS = 400
WIDTH = 48
STRIDE = 24
MARGIN = 20
BATCH = 1024  # windows run at once
STRETCH, OVERLAP = 2000, 200  # characters decoded at once, and what two of them share
SLICE = 200_000  # characters tagged at once

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match never begins inside a run of digits, so the lookbehind only spares retries.
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]+")
TRIGGER = re.compile(r"[0-9@]")
SPELLED = r"[(\[] ?(?:at|dot) ?[)\]]|\bdot\b"
ANY_TRIGGER = re.compile(rf"[0-9@]+|{SPELLED}", re.I)


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """From at sign to at sign: the longest local part before it that is still free."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            free = found.end()
            yield start, free
        at = text.find("@", max(at + 1, free))


def valid(kind: int, span: str) -> bool:
    if kind == 1:
        return all(int(part[-4:]) <= 255 and not part[:-4].strip("0") for part in span.split("."))
    digits = NOT_DIGIT.sub("", span)
    if kind == 2:
        return 14 <= len(digits) <= 19 and luhn(digits)
    return kind == 0 or 10 <= len(digits) <= 15


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end), ordered."""
    if not TRIGGER.search(text):
        return []
    spans = [(start, 0, end) for start, end in emails(text)] if "@" in text else []
    for kind, pattern in ((1, IP), (2, CARD), (3, PHONE)):
        spans += [(m.start(), kind, m.end()) for m in pattern.finditer(text) if valid(kind, m.group())]
    return sorted(spans)


def parts(text: str) -> list[tuple[int, int]]:
    """Stretches around digits, at signs and spelled ones, merged where they meet."""
    out: list[list[int]] = []
    for found in ANY_TRIGGER.finditer(text):
        low, high = max(0, found.start() - MARGIN), min(len(text), found.end() + MARGIN)
        if out and low <= out[-1][1]:
            out[-1][1] = high
        else:
            out.append([low, high])
    return [(low, high) for low, high in out]


def tag_line(length: int, spans: list[tuple[int, int, int]], low: int = 0) -> np.ndarray:
    """Tags of characters: 0, or 1 + 2 * kind at a beginning and the next inside; first kind wins."""
    line = np.zeros(length, dtype=np.int64)
    for start, kind, end in spans:
        start, end = start - low, end - low
        if start >= 0 and end <= length and not line[start:end].any():
            line[start:end] = 2 + 2 * kind
            line[start] = 1 + 2 * kind
    return line


def spans_of(line: np.ndarray) -> list[tuple[int, int, int]]:
    out, start, kind = [], None, None
    for i, tag in enumerate([*line.tolist(), 0]):
        here = None if tag == 0 else (tag - 1) // 2
        if start is not None and (here != kind or tag % 2 == 1):
            out.append((start, kind, i))
            start = None
        if start is None and here is not None:
            start, kind = i, here
    return out


def respelled(kind: int, dice: np.random.Generator) -> str:
    """A made-up value of a kind in one of several spellings."""
    def number(n):
        return "".join(map(str, dice.integers(0, 10, n)))

    def word():
        return "".join(chr(97 + c) for c in dice.integers(0, 26, int(dice.integers(3, 9))))

    if kind == 0:
        return f"{word()}{dice.choice(['.', '_', '', '+'])}{word()}@{word()}.{dice.choice(['com', 'org', 'net', 'de'])}"
    if kind == 1:
        return ".".join(str(n) for n in dice.integers(0, 256, 4))
    if kind == 2:
        body = number(15)
        digits = next(body + str(d) for d in range(10) if luhn(body + str(d)))
        return str(dice.choice(["", " ", "-", "."])).join(digits[i:i + 4] for i in range(0, 16, 4))
    a, b, c = number(3), number(3), number(4)
    return str(dice.choice([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"+1 ({a}) {b}-{c}", f"{a}.{b}.{c}", f"+44 {a} {b} {c}"]))


def disguised(kind: int, dice: np.random.Generator) -> str:
    """A made-up value in a spelling that no rule finds."""
    plain = respelled(kind, dice)
    if kind == 0:
        at, dot = [("(at)", "."), (" (at) ", " (dot) "), (" [at] ", " [dot] "), (" at ", " dot "), ("[at]", "[dot]"),
                   (" @ ", " . ")][int(dice.integers(0, 6))]
        name, host = plain.split("@")
        return f"{name}{at}{host.replace('.', dot)}"
    if kind == 1:
        return plain.replace(".", str(dice.choice(["[.]", " . ", "(.)"])))
    digits = NOT_DIGIT.sub("", plain)
    if kind == 2:
        return str(dice.choice([".", "\n", "/", " - "])).join(digits[i:i + 4] for i in range(0, 16, 4))
    a, b, c = digits[:3], digits[3:6], digits[6:10]
    return str(dice.choice([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"0{a}/{b} {c}", f"00{a[:2]} {b} {c}{a}",
                            f"{a} {b} {c}"]))


def labelled_windows(docs: DataFrame, most: int) -> list[tuple[str, list]]:
    """Windows of text with their spans, two of a document at most."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                where = parts(text or "")
                for low, high in (where[:1] + where[-1:] if len(where) > 1 else where):
                    ids.append(doc_id)
                    texts.append(text[low:min(high, low + 4 * WIDTH)])
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(texts, pa.string())], ["doc_id", "text"])

    found = (
        docs.select(F.col("doc_id").cast("long"), "text").filter(F.col("text").rlike(rf"(?i)[0-9@]|{SPELLED}"))
        .mapInArrow(cut, "doc_id bigint, text string")
        .orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(most).collect()
    )
    return [(row["text"], base_spans(row["text"])) for row in found]


def examples(windows: list[tuple[str, list]], seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Lines of characters and tags, ``WIDTH`` each; every window also with its spans respelled."""
    dice = np.random.default_rng(seed)
    xs, ys = [], []

    def add(text: str, spans: list) -> None:
        line, ids = tag_line(len(text), spans), char_ids(text)
        shift = int(dice.integers(0, WIDTH // 2))
        ids, line = np.pad(ids, (shift, WIDTH)), np.pad(line, (shift, WIDTH))
        for at in range(0, max(1, len(ids) - WIDTH), WIDTH):
            xs.append(ids[at:at + WIDTH])
            ys.append(line[at:at + WIDTH])

    for text, spans in windows:
        apart, end = [], 0
        for span in spans:
            if span[0] >= end:
                apart.append(span)
                end = span[2]
        add(text, apart)
        for _ in range(RESPELLINGS if apart else 0):
            built, new, at = "", [], 0
            for start, _, stop in apart:
                kind = int(dice.integers(0, 4))
                built += text[at:start]
                value = (respelled if dice.random() < 0.4 else disguised)(kind, dice)
                new.append((len(built), kind, len(built) + len(value)))
                built, at = built + value, stop
            add(built + text[at:], new)
    return np.array(xs).reshape(-1, WIDTH), np.array(ys).reshape(-1, WIDTH)


def train(docs: DataFrame, max_windows: int = MAX_WINDOWS, steps: int = STEPS) -> Tagger | None:
    windows = labelled_windows(docs, max_windows)
    if not any(spans for _, spans in windows):
        return None
    x, y = examples(windows)
    model = Tagger.fresh(1 + 2 * len(KINDS))
    model.fit(x, y, steps)
    return model


def stretches(where: list[tuple[int, int]]) -> list[tuple[int, int, int, int]]:
    """(low, high) of what is decoded at once, and where spans that count begin."""
    out = []
    for low, high in where:
        at = low
        while True:
            end = min(high, at + STRETCH)
            out.append((at, end, at if at == low else at + OVERLAP // 2, end if end == high else end - OVERLAP // 2))
            if end == high:
                break
            at = end - OVERLAP
    return out


def tagged(model: Tagger, pieces: list[str]) -> list[np.ndarray]:
    """Tag lines of pieces of text, from overlapping windows reconciled by their scores."""
    owners, starts, lines = [], [], []
    for owner, piece in enumerate(pieces):
        ids = np.pad(char_ids(piece), (STRIDE, WIDTH))
        for at in range(0, len(piece) + STRIDE, STRIDE):
            owners.append(owner)
            starts.append(at)
            lines.append(ids[at:at + WIDTH])
    weight = np.minimum(np.arange(WIDTH) + 1, WIDTH - np.arange(WIDTH)).astype(float)
    totals = [np.zeros((len(piece) + STRIDE + WIDTH, model.tags)) for piece in pieces]
    weights = [np.zeros(len(total)) for total in totals]
    for low in range(0, len(lines), BATCH):
        scores = model.scores(np.stack(lines[low:low + BATCH]))
        for i, line in enumerate(scores):
            at = starts[low + i]
            totals[owners[low + i]][at:at + WIDTH] += line * weight[:, None]
            weights[owners[low + i]][at:at + WIDTH] += weight
    return model.decode([
        total[STRIDE:STRIDE + len(piece)] / w[STRIDE:STRIDE + len(piece), None]
        for piece, total, w in zip(pieces, totals, weights)])


def sliced(model: Tagger, pieces: list[str]) -> Iterator[np.ndarray]:
    """``tagged`` for any number of pieces, some at a time; only the short lines of tags stay."""
    held, length = [], 0
    for piece in pieces:
        held.append(piece)
        length += len(piece)
        if length > SLICE:
            yield from tagged(model, held)
            held, length = [], 0
    if held:
        yield from tagged(model, held)


def meets(kind: int, span: str) -> bool:
    """What a kind asks for, however it is separated or spelled."""
    digits = NOT_DIGIT.sub("", span)
    if kind == 0:
        return len(re.findall(r"[A-Za-z0-9]+", span)) >= 3 and bool(
            re.search(r"[^\W_](?:@| @ |.{0,2}\bat\b.{0,2})[^\W_]", span, re.I))
    if kind == 1:
        numbers = NOT_DIGIT.split(span)
        return len(numbers) == 4 and all(numbers) and all(len(n) < 4 and int(n) <= 255 for n in numbers)
    if re.search(r"[^\W\d]", span):
        return False
    if kind == 2:
        return 14 <= len(digits) <= 19 and luhn(digits)
    return 10 <= len(digits) <= 15


def added_spans(
    text: str, where: list[tuple[int, int, int, int]], lines: list[np.ndarray], base: list,
) -> list[tuple[int, int, int]]:
    """Tagged spans that hold what their kind asks for and touch no span of the rules."""
    taken = np.zeros(len(text) + 1, dtype=bool)
    for start, _, end in base:
        taken[start:end] = True
    out = []
    for (low, _, first, last), line in zip(where, lines):
        for start, kind, end in spans_of(line):
            if not first <= start + low < last:
                continue
            start, end = start + low, end + low
            span = text[start:end]
            while span and not (span[0].isalnum() or span[0] in "+("):
                start, span = start + 1, span[1:]
            while span and not span[-1].isalnum():
                end, span = end - 1, span[:-1]
            whole = not (text[start - 1:start].isalnum() and span[:1].isalnum()) and not text[end:end + 1].isalnum()
            if span and whole and meets(kind, span) and not taken[start:end].any():
                taken[start:end] = True
                out.append((start, kind, end))
    return out


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in sorted(spans))


def find(docs: DataFrame, model: Tagger | None) -> DataFrame:
    """Per document: counts of the rules' spans by kind, their digest, all spans, spans added."""
    kind_of_id = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans", "n_added"]
    empty = hashlib.sha256(b"").hexdigest()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                part = batch.slice(low, 512)
                counts = np.zeros((part.num_rows, len(KINDS)), dtype=np.int64)
                digests, spans = [empty] * part.num_rows, [""] * part.num_rows
                added = np.zeros(part.num_rows, dtype=np.int64)
                open_, held = [], 0

                def close():
                    pieces = [t[a:b] for _, t, _, where in open_ for a, b, _, _ in where]
                    lines = sliced(model, pieces)
                    for row, text, base, where in open_:
                        more = added_spans(text, where, [next(lines) for _ in where], base)
                        spans[row] = listed(base + more)
                        added[row] = len(more)
                    open_.clear()

                for row, text in enumerate(part.column(1).to_pylist()):
                    if not text or not ANY_TRIGGER.search(text):
                        continue
                    base = base_spans(text)
                    for _, kind, _ in base:
                        counts[row, kind] += 1
                    spans[row] = listed(base)
                    digests[row] = hashlib.sha256(spans[row].encode()).hexdigest()
                    if model is not None:
                        open_.append((row, text, base, stretches(parts(text))))
                        held += sum(b - a for a, b, _, _ in open_[-1][3])
                        if held > SLICE:
                            close()
                            held = 0
                if open_:
                    close()
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *[pa.array(counts[:, i]) for i in range(len(KINDS))],
                     pa.array(digests), pa.array(spans), pa.array(added)], names)

    return docs.select("doc_id", "text").mapInArrow(
        read, f"doc_id {kind_of_id}, " + ", ".join(f"n_{k} bigint" for k in KINDS)
        + ", base_sha256 string, spans string, n_added bigint")
