import os
import random
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from turnstile.operators import keyfilter
from turnstile.session import shared_dir
from turnstile.sources import files, versions
from turnstile.sources.buffers import Buffer
from turnstile.sources.versions import Change, TakenVersion, published, snapshot

KIND = "id long, day string, hour int"


@pytest.fixture
def root(spark):
    return shared_dir(spark, "versions")


def rows(spark, *triples):
    return spark.createDataFrame(triples, KIND)


def ids(df):
    return sorted(r.id for r in df.collect())


def schema(spark):
    return spark.createDataFrame([], KIND).schema


def store(spark, root, triples, how="replace", **options):
    change = Change(snapshot(spark, root))
    getattr(change, how)("t", rows(spark, *triples), schema(spark), "day", "hour", **options)
    return change.publish()


def test_reader_keeps_its_version(spark, root):
    kind = schema(spark)
    store(spark, root, [(1, "a", 0), (2, "a", 1), (3, "b:c d", 0)])
    before = snapshot(spark, root)
    lazy = before.scan("t", kind)
    store(spark, root, [(4, "a", 1)], replaced=[("a",)])
    store(spark, root, [(5, "b:c d", 0)], "append")
    assert ids(lazy) == [1, 2, 3]
    assert ids(snapshot(spark, root).scan("t", kind)) == [3, 4, 5]
    assert [ids(snapshot(spark, root, v).scan("t", kind)) for v in published(spark, root)] == [
        [1, 2, 3], [3, 4], [3, 4, 5]]
    only = snapshot(spark, root).scan("t", kind, lambda values: values == ("b:c d", "0"))
    assert ids(only) == [3, 5]


def test_partitions_that_are_replaced_by_nothing_are_empty(spark, root):
    kind = schema(spark)
    store(spark, root, [(1, "a", 0), (2, "a", 1), (3, None, None), (4, "b", 0)])
    now = store(spark, root, [], replaced=[("a", 1), (None,)])
    assert ids(now.scan("t", kind)) == [1, 4]
    assert ids(store(spark, root, [], replaced=[("a",), ("b",)]).scan("t", kind)) == []
    assert ids(snapshot(spark, root).scan("unknown", kind)) == []


def test_change_that_breaks_off_leaves_no_trace(spark, root):
    kind = schema(spark)
    store(spark, root, [(1, "a", 0)])
    broken = Change(snapshot(spark, root))
    broken.replace("t", rows(spark, (2, "a", 0), (3, "z", 0)), kind, "day", "hour")
    assert ids(broken.scan("t", kind)) == [2, 3]
    assert ids(snapshot(spark, root).scan("t", kind)) == [1]
    # The next change takes the same number and writes over what was left behind.
    assert ids(store(spark, root, [(4, "a", 0)]).scan("t", kind)) == [4]


def test_second_writer_fails(spark, root):
    one, two = Change(snapshot(spark, root)), Change(snapshot(spark, root))
    one.publish()
    with pytest.raises(TakenVersion):
        two.publish()
    with pytest.raises(ValueError):
        for _ in range(2):
            two.append("t", rows(spark, (1, "a", 0)), schema(spark), "day", "hour")


def test_expired_versions_go_with_what_only_they_knew(spark, root):
    kind = schema(spark)
    store(spark, root, [(1, "a", 0), (2, "b", 0)])
    store(spark, root, [(3, "a", 0)])
    store(spark, root, [(4, "a", 0)], "append")
    assert versions.expire(spark, root) == []
    assert versions.expire(spark, root, timedelta(0)) == [1, 2]
    assert published(spark, root) == [3]
    assert ids(snapshot(spark, root).scan("t", kind)) == [2, 3, 4]
    assert files.children(spark, f"{root}/t/v=1") != [] and not os.path.exists(f"{root}/t/v=1/day=a/hour=0")
    with pytest.raises(LookupError):
        snapshot(spark, root, 1)


def test_small_files_appear_whole_or_not_at_all(spark, root):
    assert files.write_new(spark, f"{root}/x.json", "é1")
    assert not files.write_new(spark, f"{root}/x.json", "2")
    assert files.read(spark, f"{root}/x.json") == "é1"
    assert [name for name in files.children(spark, root) if not name.endswith(".crc")] == ["x.json"]
    assert files.children(spark, f"{root}/none") == []


def buffer(spark, root):
    return Buffer(spark, root, spark.createDataFrame([], "id long, data string").schema, "id")


def numbers(spark, *values):
    return spark.createDataFrame([(v, f"d{v}") for v in values], "id long, data string").coalesce(2)


def test_purge_opens_only_the_files_that_the_mark_cuts(spark, root):
    held = buffer(spark, root)
    for low in range(0, 100, 20):
        held.append(numbers(spark, *random.Random(low).sample(range(low, low + 20), 20)))
    before = held.files()
    opened = held.purge(45)
    assert 1 <= opened <= 2
    assert ids(held.rows()) == list(range(46, 100))
    spared = {name for name, r in before.items() if r.low > 45}
    assert spared <= held.files().keys()
    assert held.purge(45) == 0 and held.purge(1000) == 0
    assert held.files() == {} and ids(held.rows()) == []
    assert ids(held.rows(version=5)) == list(range(100))  # as a reader that began before
    held.expire(timedelta(0))
    assert not [f for f in os.listdir(f"{root}/rows") if any(
        n.endswith(".parquet") for n in os.listdir(f"{root}/rows/{f}"))]


def test_bounded_reads_open_only_files_they_need(spark, root):
    held = buffer(spark, root)
    assert held.read_after(0, 5).count() == 0
    for low in (80, 0, 40, 20, 60):
        held.append(numbers(spark, *range(low, low + 20)))
    held.append(numbers(spark, 5, 95, None))
    for after, size in ((-1, 7), (4, 3), (17, 5), (39, 20), (90, 50), (99, 1), (0, 1000)):
        batch = held.read_after(after, size)
        expected = sorted([*range(100), 5, 95])
        assert [r.id for r in batch.collect()] == [i for i in expected if i > after][:size]
    assert len(held.read_after(39, 10).inputFiles()) < len(held.files()) / 2


def test_rows_without_an_id_stay(spark, root):
    held = buffer(spark, root)
    held.append(numbers(spark, 1, None, 2, 9))
    held.append(numbers(spark, None))
    held.append(numbers(spark, 9, 9))
    assert held.append(spark.createDataFrame([], held.schema)) == 0
    held.purge(9)
    assert [r.id for r in held.rows().collect()] == [None, None]


def test_appends_of_two_writers_both_count(spark, root, monkeypatch):
    held, other = buffer(spark, root), buffer(spark, root)
    write = held._write

    def meanwhile(df):
        files = write(df)
        if df.first().id == 1:
            # Published between the other writer's files and its manifest.
            take = versions.snapshot
            seen = []

            def slow(*args):
                found = take(*args)
                if not seen:
                    seen.append(1)
                    other.append(numbers(spark, 2))
                return found

            monkeypatch.setattr("turnstile.sources.buffers.snapshot", slow)
        return files

    monkeypatch.setattr(held, "_write", meanwhile)
    held.append(numbers(spark, 1))
    assert ids(held.rows()) == [1, 2]


PART = ["day"]


def sizes(spark, **words):
    return spark.createDataFrame(list(words.items()), "day string, words long")


def test_key_filters_find_every_key_and_few_others(spark):
    keys = spark.range(20_000).select(
        F.when(F.col("id") % 4 == 0, "big").otherwise("small").alias("day"), F.col("id").cast("string").alias("key"))
    asked_sizes = sizes(spark, big=keyfilter.words_for(5000), small=keyfilter.words_for(15_000))
    held = keyfilter.filter_rows(keys.filter("key % 2 = 0"), "key", PART, asked_sizes)
    parts = [keyfilter.filter_rows(keys.filter(f"key % 2 = 0 AND key % 3 = {i}"), "key", PART, asked_sizes)
             for i in range(3)]
    together = keyfilter.merged(parts[0].unionByName(parts[1]).unionByName(parts[2]), PART)
    assert sorted(map(tuple, together.collect())) == sorted(map(tuple, held.collect()))
    found = keyfilter.suspected(keys, "key", PART, held, asked_sizes)
    assert found.filter("key % 2 = 0 AND NOT suspected").count() == 0
    assert found.filter("key % 2 = 1 AND suspected").count() <= 10


def test_unknown_partitions_and_missing_keys_are_not_suspected(spark):
    keys = spark.createDataFrame([("a", "1"), ("a", None), ("b", "1"), (None, "1")], "day string, key string")
    held = keyfilter.filter_rows(keys, "key", PART, sizes(spark, a=1024))
    found = keyfilter.suspected(keys, "key", PART, held, sizes(spark, a=1024))
    assert sorted(map(str, found.filter("suspected").collect())) == ["Row(day='a', key='1', suspected=True)"]
    assert found.count() == 4


def test_filters_are_as_large_as_their_keys_need():
    assert keyfilter.words_for(1) == keyfilter.LEAST_WORDS
    for keys in (10_000, 123_456):
        words = keyfilter.words_for(keys)
        assert keyfilter.room(words) >= keys > keyfilter.room(words // 2)
