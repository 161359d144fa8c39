import random
import re

import numpy as np
import pytest
from samples import corpus, documents, empty_documents, odd_documents, prose

from turnstile.llm import linededup
from turnstile.llm.linededup import LineDedup


def brute(rows, size=5, percent=80):
    """Line numbers that go, by comparing every line to all earlier ones."""
    seen, out = [], {}
    for doc_id, text in sorted(rows):
        out[doc_id] = []
        for n, line in enumerate(text.split("\n")):
            words = re.findall(r"[^\x20\x09-\x0D]+", line.lower())
            if not words:
                continue
            tokens = {tuple(words[i:i + size]) for i in range(max(1, len(words) - size + 1))}
            if any(100 * len(tokens & t) >= percent * len(tokens | t) for t in seen):
                out[doc_id].append(n)
            seen.append(tokens)
    return out


def result(frame):
    return {r.doc_id: [int(n) for n in r.removed_lines.split(",") if n] for r in frame.collect()}


@pytest.mark.parametrize("block", [3, 512])
def test_against_all_lines(spark, monkeypatch, block):
    monkeypatch.setattr(linededup, "BLOCK", block)
    rows = corpus(seed=5, count=60) + [(1000 + i, t) for i, t in family()]
    assert result(LineDedup(documents(spark, rows)).report()) == brute(rows)


def family():
    """Copies of a line with an edit or two: some match the first, some only each other."""
    dice = random.Random(3)
    base = prose(dice, 60).split(" ")
    for i in range(40):
        words = list(base)
        for _ in range(dice.randrange(0, 4)):
            words[dice.choice([4, 5, 6, 30, 55, 56])] = f"w{dice.randrange(4)}"
        yield i, " ".join(words)


def test_large_ids(spark):
    rows = [(i * 10**16 - 5 * 10**17, t) for i, t in corpus(seed=6, count=30)]
    assert result(LineDedup(documents(spark, rows)).report()) == brute(rows)


def test_apply_keeps_everything_else(spark):
    rows = corpus(seed=7, count=50)
    docs = documents(spark, rows)
    got = {r.doc_id: r for r in LineDedup(docs).apply().collect()}
    gone = brute(rows)
    for doc_id, text in rows:
        kept = [line for n, line in enumerate(text.split("\n")) if n not in gone[doc_id]]
        assert got[doc_id].text == "\n".join(kept)
        assert got[doc_id].node == "mine"
    assert LineDedup(docs).apply().columns == docs.columns


def test_odd_documents(spark):
    docs = odd_documents(spark)
    got = LineDedup(docs).apply().collect()
    assert len(got) == docs.count()
    texts = {r.doc_id: r.text for r in got if r.doc_id is not None}
    assert texts[0] is None and texts[1] == "" and texts[2] == " \t\n"
    assert texts[9] == "line\n" and texts[13] == "same text here" and texts[14] == ""
    assert sorted(r.text or "" for r in got if r.doc_id is None) == ["", "no id"]
    assert [r.text for r in got if r.doc_id == 3] == ["one"] * 3


def test_empty_table(spark):
    assert LineDedup(empty_documents(spark)).report().count() == 0
    assert LineDedup(empty_documents(spark)).apply().count() == 0


def test_tokens_that_agree_when_shortened(spark):
    """Hashes of these words agree in their first 38 bits, but they are different lines."""
    rows = [(1, "w1104588"), (2, "w1203347"), (3, "w189978\nw2210528"), (4, "w1104588\nx")]
    assert result(LineDedup(documents(spark, rows)).report()) == {1: [], 2: [], 3: [], 4: [0]}


def test_distinct_tokens_are_whole():
    base = 5 << 40
    tokens = np.array([base, base + (1 << 20), base, 7, base], dtype=np.uint64)
    ranks = np.zeros(1 << linededup.COUNTERS, dtype=np.uint8)
    short, lines, whole = linededup.ordered_sets(tokens, np.array([0, 0, 0, 0, 1]), ranks)
    assert lines.tolist() == [0, 0, 0, 1] and whole.tolist() == [7, base, base + (1 << 20), base]
    assert short[1] == short[2]


def test_unlike_rows_of_one_id_lose_only_their_own_lines(spark):
    copied = "a copy of a line that stands in two documents"
    rows = [(0, f"{copied}\nfirst document only"), (1, f"{copied}\nkept one here now"),
            (1, "text found in this row only\nsecond line here is unique"), (1, f"more text\n{copied}"),
            (2, "kept one here now"), (1, f"{copied}\nkept one here now")]
    kept = sorted(r.text for r in LineDedup(documents(spark, rows)).apply().collect())
    texts = [t for _, t in rows]
    lines = [line for text in kept for line in text.split("\n") if line]
    # Equal rows of an id are one document; it comes first or after, but is decided as a whole.
    once = sorted({line for text in texts for line in text.split("\n")})
    assert sorted(set(lines)) == once
    assert "text found in this row only\nsecond line here is unique" in kept and "more text" in "\n".join(kept)
    got = LineDedup(documents(spark, rows)).report().collect()
    assert sorted(r.doc_id for r in got) == [0, 1, 1, 1, 1, 2]
    assert {r.doc_id for r in got if r.removed_lines == ""} >= {0, 1}


def test_ids_beyond_others_are_found_at_both_ends(spark):
    for low, high in ((5, 2**63 - 1), (-2**63, 7)):
        rows = [(low, "one line here"), (low, "another line there"), (high, "one line here")]
        got = LineDedup(documents(spark, rows)).apply().collect()
        assert {r.doc_id for r in got} == {low, high}
        assert sorted(line for r in got for line in r.text.split("\n") if line) == ["another line there", "one line here"]
    rows = [(-2**63, "a"), (2**63 - 1, "b"), (2**63 - 1, "c")]
    with pytest.raises(ValueError):
        LineDedup(documents(spark, rows))


def test_many_lines_with_one_common_passage(spark):
    dice = random.Random(9)
    passage = prose(dice, 8)
    rows = [(i, f"{passage} {prose(dice, dice.randrange(1, 30))}") for i in range(150)]
    rows += [(1000 + i, f"{prose(dice, 3)} {passage}") for i in range(50)]
    assert result(LineDedup(documents(spark, rows)).report()) == brute(rows)


def test_tokens_of_two_lines_are_found_by_bucket(spark):
    """Few rows are shuffled for them, not one per token."""
    dice = random.Random(4)
    rows = [(i, "\n".join(prose(dice, 12) for _ in range(20))) for i in range(30)]
    rows += [(100 + i, t) for i, t in rows[:5]]
    dedup = LineDedup(documents(spark, rows))
    lines = [t for r in dedup.lines.collect() for t in linededup_tokens(r)]
    often = {t for t in lines if lines.count(t) > 1}
    assert often
    assert {r.token for r in linededup.shared_tokens(dedup.lines, 80).collect()} == often
    plan = linededup.shared_tokens(dedup.lines, 80)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(bucket" in plan and "hashpartitioning(token" not in plan


def linededup_tokens(row):
    """Distinct prefix tokens of each line of a sketched document, one after another."""
    tokens, at = np.frombuffer(row.prefix, dtype=np.int64).tolist(), 0
    for k in row.k:
        n = int(linededup.prefix_length(np.array([k]), 80)[0])
        yield from set(tokens[at:at + n])
        at += n


def test_hubs_over_batches(spark):
    rows = [(t, d, n, 9, t) for t in range(7) for d in range(5) for n in range(3)]
    rows += [(1, 0, 0, 9, 1)]  # rows of one document
    frame = spark.createDataFrame(rows, "token bigint, doc_id bigint, line int, k int, at int")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 4)
    try:
        got = linededup.with_hubs(frame).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert len(got) == 7 * 14 and {(r.hub_doc_id, r.hub_line) for r in got} == {(0, 0)}
    assert len(set(got)) == 7 * 14 and all(r.hub_at == r.token for r in got)
