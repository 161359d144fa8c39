"""The stages over a small folder of tables, against what brute force makes of them."""

import random

import corpus_pipeline as pipeline
import pytest
from samples import documents, prose
from test_decontam import brute as windows_of
from test_linededup import brute as lines_of
from test_neardup import brute as groups_of


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    dice, root = random.Random(12), tmp_path_factory.mktemp("tables")
    items = [(i, prose(dice, 20)) for i in range(5)]
    rows, labels = [], []
    for i in range(240):
        text = "\n".join(prose(dice, dice.randrange(8, 40)) for _ in range(3))
        if i % 7 == 0:
            text += " scoundrel rotten vermin"
        if i % 10 == 1:
            text += "\n" + items[i % 5][1]
        if i % 12 == 2 and rows:
            text = rows[-1][1].replace(" ", "  ", 3)
        rows.append((i, text, f"s{i % 4}"))
        labels.append((i, 1, int(i % 7 == 0 and "vermin" in text)))
    documents(spark, rows).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    return str(root), rows, items


def pairs(frame):
    return sorted((r.doc_id, r.text) for r in frame.select("doc_id", "text").collect())


def test_stages(spark, folder):
    root, rows, items = folder
    docs = spark.read.parquet(f"{root}/documents.parquet")
    names, stages = zip(*pipeline.STAGES)
    assert len(stages) == 5
    columns, outputs = docs.columns, []
    for stage in stages:
        docs = pipeline.staged(stage(spark, docs, root), "test")
        outputs.append(docs)
    toxic, lines, near, clean, mixed = outputs
    assert all(frame.columns == columns for frame in outputs[:4])
    assert pairs(toxic) == sorted((i, t) for i, t, _ in rows if "vermin" not in t)
    gone = lines_of(pairs(toxic))
    assert pairs(lines) == [
        (i, "\n".join(line for n, line in enumerate(t.split("\n")) if n not in gone[i])) for i, t in pairs(toxic)]
    assert all(r.n_chars == len(r.text) for r in lines.collect())
    groups = groups_of(pairs(lines), 5, 80)
    assert pairs(near) == [(i, t) for i, t in pairs(lines) if groups[i][1] == i]
    hit = {row[0] for row in windows_of(pairs(near), items) if row[-1]}
    assert hit and pairs(clean) == [(i, t) for i, t in pairs(near) if i not in hit]
    assert sorted(r.doc_id for r in mixed.collect()) == [i for i, _ in pairs(clean)]
    ran = pipeline.run(spark, root)
    assert sorted(map(tuple, ran.collect())) == sorted(map(tuple, mixed.collect()))


def test_repeated_ids_leave_one_row(spark):
    docs = documents(spark, [(1, "a b c d e f"), (1, "a b c d e f"), (2, "x y"), (None, "n"), (None, "n")])
    kept = pipeline.near_dedup(spark, docs, "")
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "None", "None"]


def test_unlike_rows_of_one_id_are_all_kept(spark):
    dice = random.Random(8)
    items = spark.createDataFrame([(0, prose(dice, 12))], "item_id long, text string")
    leak = items.first().text
    rows = [(0, "a copy of a line\nseen here first"), (1, "a copy of a line\nkept one here now"),
            (1, "text found in this row only\nsecond line here is unique"), (1, f"clean words {leak} and more"),
            (2, "something else altogether")]
    docs = documents(spark, rows)
    lines = pipeline.line_dedup(spark, docs, "")
    assert lines.columns == docs.columns
    assert sorted(pairs(lines)) == sorted(
        (i, t if i != 1 or "kept" not in t else "kept one here now") for i, t in rows)
    near = pipeline.near_dedup(spark, docs, "")
    assert pairs(near) == sorted(rows) and near.columns == docs.columns
    again = pipeline.near_dedup(spark, documents(spark, rows * 2).repartition(5), "")
    assert pairs(again) == sorted(rows)


def test_decontamination_decides_row_by_row(spark, tmp_path):
    dice = random.Random(9)
    leak = prose(dice, 12)
    spark.createDataFrame([(0, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(1, "one clean row"), (1, f"a row that leaks {leak}"), (2, "other"), (None, leak)]
    clean = pipeline.decontamination(spark, documents(spark, rows), str(tmp_path))
    assert sorted(pairs(clean.filter("doc_id IS NOT NULL"))) == [(1, "one clean row"), (2, "other")]


def test_empty_tables(spark, tmp_path):
    documents(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0
