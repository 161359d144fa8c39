import hashlib
import random
import re

import pytest
from samples import WORDS, documents, empty_documents, odd_documents, prose

from turnstile.llm.decontam import Decontamination, contaminated


def words(text):
    text = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)


def brute(docs, items, window=10):
    cut = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            cut.setdefault(tuple(w[i:i + window]), set()).add(item)
    out = []
    for doc_id, text in docs:
        w, hit, named = words(text), set(), set()
        for size in {len(k) for k in cut}:
            for i in range(len(w) - size + 1):
                owners = cut.get(tuple(w[i:i + size]))
                if owners:
                    hit.update(range(i, i + size))
                    named |= owners
        text = ",".join(sorted(str(n) for n in named if n is not None))
        out.append((doc_id, len(w), len(hit), len(named - {None}),
                    hashlib.sha256(text.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def result(frame):
    names = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    return sorted((tuple(r[n] for n in names) for r in frame.collect()), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_against_every_window(spark, seed):
    dice = random.Random(seed)
    items = [(i, prose(dice, n)) for i, n in enumerate([30, 12, 10, 9, 3, 2, 1, 0, 25])]
    items += [(20, items[0][1]), (None, prose(dice, 14)), (21, None), (22, items[0][1].upper() + "!!")]
    docs = []
    for i in range(40):
        text = prose(dice, dice.randrange(0, 60))
        for _ in range(dice.randrange(3)):
            w = (dice.choice(items)[1] or "").split(" ")
            at = dice.randrange(len(w))
            text += " " + ", ".join(w[at:at + dice.randrange(1, 25)]) + "\n" + prose(dice, 5)
        docs.append((i, text))
    docs += [(100, None), (101, ""), (102, (items[1][1] + " ") * 20), (103, items[1][1]), (103, "x")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    frame = documents(spark, docs)
    got = Decontamination(frame, bench)
    assert result(got.report()) == brute(docs, items)
    assert {r.doc_id for r in contaminated(frame, bench).collect()} == {
        row[0] for row in brute(docs, items) if row[-1]}


def test_window_count_beyond_the_broadcast(spark, monkeypatch):
    from turnstile.llm import decontam

    monkeypatch.setattr(decontam, "BROADCAST_WINDOWS", 0)
    dice = random.Random(9)
    items = [(1, prose(dice, 20))]
    docs = [(1, items[0][1]), (2, " ".join(dice.sample(WORDS, 20)))]
    frame = Decontamination(documents(spark, docs), spark.createDataFrame(items, "item_id long, text string"))
    assert result(frame.report()) == brute(docs, items)


def test_odd_and_empty_tables(spark):
    bench = spark.createDataFrame([(1, "same text here"), (2, None)], "item_id long, text string")
    rows = result(Decontamination(odd_documents(spark), bench).report())
    assert sum(r[-1] for r in rows) == 2 and len(rows) == odd_documents(spark).count()
    assert Decontamination(empty_documents(spark), bench).report().count() == 0
    nothing = bench.limit(0)
    assert not any(r[-1] for r in result(Decontamination(odd_documents(spark), nothing).report()))
