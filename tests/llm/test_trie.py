import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from turnstile.llm.trie import MESSAGE, LevelQueue, PrefixTrie, as_they_are, numbered, rebuilt

KIND = "conv_id long, turn long, role string, text string, n int, depth string, key int"


def conversations(spark, rows):
    return spark.createDataFrame([(*row, 1, "x", 2) for row in rows], KIND)


def in_order(rows):
    """Turns of each conversation as (role, text), in the order that the contract names."""
    def key(row):
        role, text = row[2] or "", row[3] or ""
        return row[1] is not None, row[1] or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()

    out = {}
    for row in sorted((row for row in rows if row[0] is not None), key=key):
        out.setdefault(row[0], []).append((row[2] or "", row[3] or ""))
    return out


def rebuild(own):
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = own.get(c - int(np.fmod(c, 20)), [])[:h] + turns[h:]
    return out


def nodes(conversations):
    members = {}
    for c, turns in conversations.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children = {path: 0 for path in members}
    leaves, saved = dict(children), dict(children)
    for path, own in members.items():
        if path:
            children[path[:-1]] += 1
    for path, own in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", path[-1][1])) if path else 0
        for d in range(len(path) + 1):
            leaves[path[:d]] += children[path] == 0
            saved[path[:d]] += (len(own) - 1) * words
    out = []
    for path, own in members.items():
        ends = sorted(c for c in own if len(conversations[c]) == len(path))
        out.append((min(own), len(path), min(members[path[:-1]]) if path else None, len(own), children[path],
                    leaves[path], saved[path], hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=str)


def got(trie):
    return sorted(map(tuple, trie.report().collect()), key=str)


def branching(seed, count=80):
    dice, rows = random.Random(seed), []
    texts = ["go on", "one two  three", "", None, "word", "four\nwords in\tall"]
    known = [[]]
    for c in dice.sample(range(-100, 400), count):
        begin = dice.choice(known)
        turns = begin[:dice.randrange(len(begin) + 1)] + [
            (dice.choice(["user", "assistant", None, ""]), dice.choice(texts)) for _ in range(dice.randrange(9))]
        known.append(turns)
        places = list(range(len(turns)))
        rows += [(c, turn, *turns[turn]) for turn in dice.sample(places, len(places))]
    return rows


# Limits so low that nearly every node is above them, and queues that spill at once.
@pytest.mark.parametrize(("seed", "limit", "stretch", "most"), [(1, 200_000, 4096, 1 << 20), (2, 6, 2, 1), (3, 40, 3, 4)])
def test_equals_brute_force(spark, seed, limit, stretch, most):
    rows = branching(seed)
    turns = numbered(conversations(spark, rows).repartition(6))
    own = in_order(rows)
    assert got(PrefixTrie(*rebuilt(turns), limit, stretch, most)) == nodes(rebuild(own))
    assert got(PrefixTrie(*as_they_are(turns), limit, stretch, most)) == nodes(own)


def test_null_equal_and_repeated_turns(spark):
    rows = [(3, None, "user", "b"), (3, None, "user", "a"), (3, 1, None, None), (3, 1, "", ""), (3, 1, "", ""),
            (4, 5, "user", "x " * 50_000), (None, 1, "user", "a"), (20, None, None, None), (23, 7, "u", "last")]
    rows += [(7, 2, "user", "same")] * 500
    trie = PrefixTrie(*rebuilt(numbered(conversations(spark, rows).repartition(5))), 10, 16, 5)
    assert got(trie) == nodes(rebuild(in_order(rows)))


def test_copies_and_one_long_conversation(spark):
    rows = [(c, t, "user", f"text {t}") for c in range(1000, 1600) for t in range(3)]
    rows += [(20_000, t, "user", f"{t % 7} words") for t in range(10_000)]
    trie = PrefixTrie(*as_they_are(numbered(conversations(spark, rows).repartition(5))), 500, 64, 100)
    found = {(r.conv_id, r.depth): r for r in trie.report().collect()}
    assert len(found) == 1 + 3 + 10_000
    root, copy = found[1000, 0], found[1000, 3]
    assert (root.n_convs, root.n_children, root.n_leaves) == (601, 2, 2)
    assert root.saved_tokens == 3 * 2 * 599 and copy.saved_tokens == 2 * 599
    ids = ",".join(map(str, range(1000, 1600)))
    assert copy.ends_sha256 == hashlib.sha256(ids.encode()).hexdigest()
    last = found[20_000, 10_000]
    assert (last.n_children, last.n_leaves, last.parent_conv_id) == (0, 1, 20_000)


def test_empty_and_turnless(spark):
    assert got(PrefixTrie(*rebuilt(numbered(conversations(spark, []))))) == []
    # crc32("1") % 4 == 3: the only turn goes, and no conversation 0 stands in.
    rows = [(1, 0, "user", "a")]
    assert zlib.crc32(b"1") % 4 == 3
    expected = [(1, 0, None, 1, 0, 1, 0, hashlib.sha256(b"1").hexdigest())]
    assert got(PrefixTrie(*rebuilt(numbered(conversations(spark, rows))))) == expected


@pytest.mark.parametrize("most", [0, 7, 10_000])
def test_queue_returns_sums_by_level_and_receiver(most):
    dice = np.random.default_rng(1)
    queue = LevelQueue(most)
    expected = {}
    queue.pop(5, 0)
    for _ in range(40):
        sent = np.zeros(50, MESSAGE)
        sent["to"], sent["leaves"] = dice.integers(-30, 30, 50), dice.integers(0, 9, 50)
        for to, _, leaves, _ in sent.tolist():
            expected[to] = expected.get(to, 0) + leaves
        queue.push(sent)
    found = [queue.pop(4, last) for last in (-10, 0, 0, 11, 99)]
    assert not len(found[2]) and max(found[0]["to"]) <= -10
    assert {int(m["to"]): int(m["leaves"]) for part in found for m in part} == expected
    assert not len(queue.pop(3, 99))
