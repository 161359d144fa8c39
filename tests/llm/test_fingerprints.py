import bisect
import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F
from samples import corpus, documents, empty_documents, odd_documents

from turnstile.llm import fingerprints as fp


def units(text):
    return set(re.findall(r"[^\n]{1,%d}" % fp.CUT, text))


def alike(a, b):
    return 1.0 if not a and not b else 1 - len(a ^ b) / (len(a) + len(b))


@pytest.mark.parametrize("bucket_rows", [4000, 7])
def test_against_sets(spark, monkeypatch, bucket_rows):
    monkeypatch.setattr(fp, "BUCKET_ROWS", bucket_rows)
    rows = sorted(corpus(seed=2, count=50) + [(1001, ""), (1002, "a\nb\na"), (1003, "x" * 2000), (1004, "é漢\U0001F600" * 30)])
    rows.append((1005, "\n".join(f"line {i}" for i in range(300))))
    got = {r.doc_id: r for r in fp.fingerprints(documents(spark, rows)).collect()}
    for i, (doc_id, text) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][1]
        quarter = len(text) // 4
        changed = text[:len(text) - quarter] + after[:quarter]
        row = got[doc_id]
        assert row.n_chars == len(text)
        assert row.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        assert row.near_edited == pytest.approx(alike(units(text), units(changed)))
        assert row.near_next == pytest.approx(alike(units(text), units(after)))
    by_text = {}
    for doc_id, text in rows:
        assert by_text.setdefault(text, got[doc_id].fingerprint) == got[doc_id].fingerprint
    assert len(set(by_text.values())) == len({frozenset(units(t)) for t in by_text})


def test_peeling_recovers_the_difference(spark):
    a, b = list(range(0, 60)), list(range(20, 75))
    row = spark.createDataFrame([(1, [f"p{i}" for i in a], [f"p{i}" for i in b])], "key int, a array<string>, b array<string>")
    made = row.select("key", *[fp.digests(F.array_join(c, "\n")).alias(c) for c in "ab"])
    found = fp.differences(made).select(
        F.size("left").alias("left"), F.size("right").alias("right"),
        (F.array_sort("left") == F.array_sort(F.array_except("a", "b"))).alias("same_left"),
        (F.array_sort("right") == F.array_sort(F.array_except("b", "a"))).alias("same_right")).first()
    assert (found.left, found.right) == (20, 15) and found.same_left and found.same_right


def test_odd_and_empty_tables(spark):
    got = fp.fingerprints(odd_documents(spark)).collect()
    assert len(got) == odd_documents(spark).count()
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert fp.fingerprints(empty_documents(spark)).count() == 0
    alone = fp.fingerprints(documents(spark, [(5, "a b c\nd")])).first()
    assert alone.near_next == 1.0
    assert fp.fingerprints(documents(spark, [(None, "abcd")])).first().edited_sha256 == hashlib.sha256(b"abc").hexdigest()


def test_weak_checks_of_cells_leave_differences_exact(spark, monkeypatch):
    # Every cell of one digest's count passes for a pure one.
    monkeypatch.setattr(fp, "check", lambda d: d.bitwiseAND(F.lit(0xFFFF)).bitwiseOR(F.lit(0)))
    dice = random.Random(4)
    rows = [(i, dice.sample(range(200), dice.randrange(3, 12)), dice.sample(range(200), dice.randrange(3, 12)))
            for i in range(150)]
    made = spark.createDataFrame(
        [(i, [f"p{x}" for x in a], [f"p{x}" for x in b]) for i, a, b in rows], "key int, a array<string>, b array<string>")
    made = made.select("key", *[fp.digests(F.array_join(c, "\n")).alias(c) for c in "ab"])
    wrong = fp.differences(made).filter(
        (F.array_sort("left") != F.array_sort(F.array_except("a", "b")))
        | (F.array_sort("right") != F.array_sort(F.array_except("b", "a"))))
    assert wrong.count() == 0 and fp.differences(made).count() == 150


@pytest.mark.parametrize(("cuts", "ids"), [
    (4096, [*range(1000), 10**15]), (4096, [-2**63, 2**63 - 1, *range(0, 5000, 5)]), (4, [*range(1000), 10**15]),
    (4096, [7] * 900 + [8, 9])])
def test_ranges_hold_a_bounded_number_of_documents_in_order(spark, monkeypatch, cuts, ids):
    monkeypatch.setattr(fp, "BUCKET_ROWS", 50)
    monkeypatch.setattr(fp, "MAX_CUTS", cuts)
    rows = spark.createDataFrame([(i,) for i in ids], "doc_id long")
    got = rows.select("doc_id", fp.ranges(rows, len(ids)).alias("bucket")).orderBy("doc_id").collect()
    buckets = [r.bucket for r in got]
    assert buckets == sorted(buckets)
    if cuts == 4096 and len(set(ids)) > 500:
        assert max(buckets.count(b) for b in set(buckets)) <= 110


@pytest.mark.parametrize("count", [60, 5000])
def test_ranges_of_many_cuts_are_a_short_expression(spark, monkeypatch, count):
    monkeypatch.setattr(fp, "BUCKET_ROWS", 1)
    rows = spark.range(count).select((F.col("id") * 3 - 50).alias("doc_id"))
    parts = min(count, fp.MAX_CUTS)
    wanted = [i / parts for i in range(parts)] + [1.0]
    cuts = sorted(set(rows.agg(F.percentile_approx("doc_id", wanted, 40 * fp.MAX_CUTS)).first()[0]))
    if count == 60:  # with more cuts, an expression that is not linear in them fills the memory
        assert len(str(fp.ranges(rows, count))) < 30 * len(cuts) + 1000
    # Ids between the cuts, too, and beyond them.
    ids = spark.range(-70, 3 * count).select(F.col("id").alias("doc_id"))
    got = ids.select("doc_id", fp.ranges(rows, parts).alias("bucket")).collect()
    assert all(r.bucket == max(0, bisect.bisect_right(cuts, r.doc_id) - 1) for r in got)


def test_outlying_ids_and_long_texts(spark, monkeypatch):
    monkeypatch.setattr(fp, "BUCKET_ROWS", 5)
    rows = sorted([(i, f"a {i}\nb {i % 3}") for i in range(60)] + [(10**15, "far\naway"), (-2**63, "z " * 200_000)])
    got = {r.doc_id: r for r in fp.fingerprints(documents(spark, rows)).collect()}
    for i, (doc_id, text) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][1]
        changed = text[:len(text) - len(text) // 4] + after[:len(text) // 4]
        assert got[doc_id].edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        assert got[doc_id].near_next == pytest.approx(alike(units(text), units(after)))
