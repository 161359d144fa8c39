import random
import re

import pytest
from samples import documents, empty_documents, odd_documents, prose

from turnstile.llm.licenses import BLOCK, NOTICES, LicenseScan


def found(spark, rows):
    return {r.doc_id: r for r in LicenseScan(documents(spark, rows)).report().collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_every_notice_is_found_anywhere(spark, seed):
    dice = random.Random(seed)
    rows, expected = [], {}
    for i in range(5 * len(NOTICES)):
        name, text = NOTICES[i % len(NOTICES)]
        rows.append((i, f"{prose(dice, dice.randrange(0, 60))}\n{text.upper() if i % 2 else text}. {prose(dice, dice.randrange(0, 60))}"))
        expected[i] = name
    rows += [(1000 + i, prose(dice, 200)) for i in range(20)]
    got = found(spark, rows)
    missed = [i for i, name in expected.items() if name not in got[i].licenses.split(",")]
    assert len(missed) <= 1  # a band is shared with a probability of 0.997 or more
    exact = [i for i, name in expected.items() if got[i].licenses == name]
    assert len(exact) >= 0.97 * len(expected)
    assert all(got[1000 + i].n_licenses == 0 for i in range(20))


def test_containment_is_exact(spark):
    text = dict((name, text) for name, text in NOTICES)["MPL-2.0"]
    words = text.split(" ")
    half = " ".join(words[:len(words) // 2])
    got = found(spark, [(1, text), (2, half), (3, text.replace("Mozilla", "Mozzarella"))])
    assert got[1].licenses == "MPL-2.0" and got[1].containment == 1.0
    assert got[2].n_licenses == 0
    assert got[3].licenses == "MPL-2.0" and 0.6 <= got[3].containment < 1


GPL_2 = """This program is free software; you can redistribute it and/or modify it under the terms of the
GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or
(at your option) any later version."""


def test_short_notices_and_versions(spark):
    dice = random.Random(4)
    lines = [("All rights reserved.", "proprietary")] * 60 + [
        (GPL_2, "GPL-2.0"), (GPL_2.replace("; either version 2", ", either version 3"), "GPL-3.0"),
        (GPL_2.replace("program", "library").replace("GNU", "GNU Lesser").replace("version 2", "version 2.1"), "LGPL-2.1"),
        ("Licensed under CC BY-ND 4.0", "CC-BY-ND-4.0"), ("Licensed under CC BY-NC 3.0", "CC-BY-NC-3.0"),
        ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
         "hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
         "ISC")]
    rows = [(i, f"{prose(dice, dice.randrange(60))}\n{text}\n{prose(dice, dice.randrange(60))}")
            for i, (text, _) in enumerate(lines)]
    got = found(spark, rows)
    assert [got[i].licenses for i in range(len(lines))] == [name for _, name in lines]


def test_licenses_side_by_side(spark):
    mit, apache = "Licensed under the MIT License.", "Licensed under the Apache License, Version 2.0."
    edited = dict(NOTICES)["MPL-2.0"].replace("Mozilla", "Mozzarella")
    two = "This work is licensed under the GNU General Public License, version 2."
    got = found(spark, [
        (1, f"{mit} {apache}"), (2, f"{apache} {mit}"), (3, f"{edited}. {apache}"),
        (4, f"{two} {two.replace('version 2', 'version 3')}"), (5, two.replace("General", "Lesser General") + " " + mit)])
    assert got[1].licenses == got[2].licenses == "Apache-2.0,MIT"
    assert got[3].licenses == "Apache-2.0,MPL-2.0"
    assert got[4].licenses == "GPL-2.0,GPL-3.0"
    assert "GPL-2.0" not in got[5].licenses.split(",") and "MIT" in got[5].licenses


def test_odd_and_empty_tables(spark):
    got = LicenseScan(odd_documents(spark)).report().collect()
    assert len(got) == odd_documents(spark).count() and not any(r.n_licenses for r in got)
    assert LicenseScan(empty_documents(spark)).report().count() == 0
    assert LicenseScan(odd_documents(spark), notices=[("x", "one")]).report().count() == len(got)


def words_of(text):
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower()) if w]


def triples_of(text):
    words = words_of(text)
    return [tuple(words[i:i + 3]) for i in range(len(words) - 2)]


def brute(text, templates, common=0):
    """(license, best containment) over every window and template, nothing retrieved first.

    With ``common``, only of windows that have as many triples of the template's family: a window
    that a notice just touches sees a part of it, which variants may hold as well, and need not
    be retrieved.
    """
    triples, found = triples_of(text), {}
    count = -(-len(triples) // BLOCK)
    for window in range(max(count - 1, min(count, 1))):
        inside, own = [], set(triples[window * BLOCK:(window + 2) * BLOCK])
        shared = {}
        for t in templates:
            shared.setdefault(t["family"], set()).update(t["triples"] & own)
        for t in templates:
            if len(shared[t["family"]]) < common:
                continue
            start = max(window * BLOCK - t["reach"], 0)
            around = triples[start:start + 2 * t["reach"] + 2 * BLOCK]
            held = t["triples"] & set(around)
            if 100 * len(held) >= 60 * len(t["triples"]):
                places = {i for i, w in enumerate(around) if w in t["triples"]}
                inside.append((t, len(held) / len(t["triples"]), places))
        for t, share, places in inside:
            beaten = any(
                t["family"] == u["family"] and not places - more and (
                    other > share or other == share and len(more) > len(places))
                for u, other, more in inside)
            if not beaten:
                found[t["license"]] = max(share, found.get(t["license"], 0))
    return found


@pytest.mark.parametrize("seed", [6, 7])
def test_matches_equal_brute_force_over_all_windows(spark, seed):
    dice = random.Random(seed)
    rows = []
    for i in range(250):
        parts = [prose(dice, dice.randrange(0, 40))]
        for _ in range(dice.randrange(3)):
            words = dice.choice(NOTICES)[1].split(" ")
            for _ in range(dice.randrange(0, 1 + len(words) // 8)):
                words[dice.randrange(len(words))] = dice.choice(["other", "of", "software"])
            parts += [" ".join(words), prose(dice, dice.randrange(0, 30))]
        rows.append((i, "\n".join(parts)))
    scan = LicenseScan(documents(spark, rows))
    texts = dict(enumerate(text for _, text in NOTICES))
    templates = [{"license": t.license, "family": t.family, "reach": t.reach, "triples": set(triples_of(texts[t.template]))}
                 for t in scan.templates.collect()]
    got = {r.doc_id: r for r in scan.report().collect()}
    expected = {i: brute(text, templates) for i, text in rows}
    pairs = {(i, name) for i, r in got.items() for name in r.licenses.split(",") if name}
    wanted = {(i, name) for i, found in expected.items() for name in found}
    certain = {(i, name) for i, text in rows for name in brute(text, templates, BLOCK)}
    assert pairs <= wanted and len(certain & pairs) >= 0.98 * len(certain) > 100
    for i, r in got.items():
        if r.licenses == ",".join(sorted(expected[i])):
            assert abs(r.containment - max(expected[i].values(), default=0)) < 1e-12


def test_very_long_texts(spark):
    dice = random.Random(5)
    name, text = NOTICES[0]
    got = found(spark, [(1, f"{prose(dice, 150_000)} {text} {prose(dice, 10)}"), (2, prose(dice, 150_000))])
    assert name in got[1].licenses.split(",") and got[2].n_licenses == 0
