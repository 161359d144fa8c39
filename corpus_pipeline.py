"""From raw documents to a training mix.

Each stage takes what the one before kept.  A filtering stage drops whole
documents, line dedup rewrites texts, and the last stage says how many words the
mix takes of each document.  All but the last return the columns of the
documents.  Rows without a ``doc_id`` pass the filters that work by id; rows that
repeat one are documents of their own unless their texts are equal, too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnstile.llm.common import arrow_bytes, given_ids, own_ids, staged, table
from turnstile.llm.decontam import contaminated
from turnstile.llm.linededup import LineDedup
from turnstile.llm.mixing import mix
from turnstile.llm.neardup import NearDuplicates
from turnstile.llm.toxicity import corpus_chain, without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain does not reject."""
    return without_toxic(docs, corpus_chain(docs, table(spark, sf_dir, "labels")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that match an earlier one; ``n_chars`` follows the text."""
    with arrow_bytes(spark):
        found = LineDedup(docs)
    rest = found.apply()
    if "n_chars" in rest.columns:
        length = F.length("text").cast(rest.schema["n_chars"].dataType)
        rest = rest.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(length))
    return rest


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose five-word shingles agree to four fifths."""
    rows = own_ids(docs)
    found = NearDuplicates(rows).report()
    return given_ids(one_each(without(rows, found.filter("NOT kept"))))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    rows = own_ids(docs)
    return given_ids(without(rows, contaminated(rows, table(spark, sf_dir, "benchmark"))))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document: size, its source's size and target, words that the mix takes."""
    return mix(docs).taken()


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows whose ``doc_id`` is not among the ids."""
    return docs.join(ids.select("doc_id").distinct(), "doc_id", "left_anti").select(
        *[f"`{name}`" for name in docs.columns])


def one_each(docs: DataFrame) -> DataFrame:
    """One row of each ``doc_id``, the same in every run; only ids that repeat are compared."""
    counts = docs.filter("doc_id IS NOT NULL").groupBy("doc_id").count()
    repeated = staged(counts.filter("count > 1").select("doc_id"), "repeated")
    if not repeated.limit(1).count():
        return docs
    row = F.struct(*[f"`{name}`" for name in docs.columns])
    again = docs.join(repeated, "doc_id", "left_semi").select("doc_id", row.alias("row"))
    first = again.groupBy("doc_id").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    return without(docs, repeated).unionByName(first.select("row.*"))


STAGES = [
    ("toxicity", toxicity),
    ("line dedup", line_dedup),
    ("near dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
]

# Trained models and similarity classes are not for SQL; tests compare the stages
# with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written and read again for the next."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
