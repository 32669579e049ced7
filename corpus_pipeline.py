"""The corpus pipeline: five stages, each over all that the one before it kept.

Rows are documents (doc_id, text, lang, source, n_chars, and any columns more); every stage but the last returns the columns that it got.
Defined results, of all stages: null doc_ids, texts and other columns are kept as they are (null and empty texts are
documents without words: no near duplicates, hits or personal data, and the classifier judges them like any other);
very long texts are read whole; of rows that repeat a doc_id and text one stays, and rows of one doc_id with different texts are each judged by their
own text; ties (rows of a group with the same smallest doc_id) go by the text's hash; an empty table gives an empty result; columns whose
names an operator uses for itself are carried under other names and come back untouched.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import op1_quality, op2_decontaminate, op3_neardup, op4_packing, op6_pii
from siltstone.llm.common import materialise, scratch, table

#: What operators read of a document.
READ = ("doc_id", "text", "n_chars")


def shielded(docs: DataFrame) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``docs`` with the columns that no operator reads under reserved names, and what gives them back, in their order."""
    names = {c: c if c in READ else f"_carried_{i}" for i, c in enumerate(docs.columns)}
    inside = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    return inside, lambda out: out.select(*[F.col(n).alias(c) for c, n in names.items()])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts."""
    inside, restored = shielded(docs)
    model = op1_quality.train(inside, table(spark, sf_dir, "labels"))
    return restored(op1_quality.score_documents(inside, model).where("predicted = 1"))


#: Removed rows that may be broadcast (16 bytes each, 32 MB), by their count; more are met by a merge join, which moves the texts.
BROADCAST_ROWS = 2_000_000


#: Near copies share 80 per cent of their shingles of five words; the query of the operator alone takes four.
NEAR = op3_neardup.ForestParams(words=5)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies. Rows go, not ids: a text that nobody else has stays, whatever other texts its doc_id has."""
    inside, restored = shielded(docs)
    found = materialise(op3_neardup.survivors(inside, NEAR), "near-duplicates")
    key = ["doc_id", "_text_key"]
    gone = found.where("gone").select("doc_id", F.col("text_key").alias("_text_key"))
    how = "broadcast" if gone.count() <= BROADCAST_ROWS else "merge"
    keyed = inside.withColumn("_text_key", F.xxhash64("text"))
    kept = keyed.join(gone.hint(how), key, "left_anti")
    again = found.where("not gone and copies > 1 and doc_id is not null").select("doc_id", F.col("text_key").alias("_text_key"))
    n = again.count()
    if n:
        again = again.hint("broadcast" if n <= BROADCAST_ROWS else "merge")
        kept = kept.join(again, key, "left_anti").unionByName(kept.join(again, key, "left_semi").dropDuplicates(key))
    return restored(kept)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth is in the benchmark and that hold no item of it whole, without what is; n_chars follows the text where it is cut."""
    inside, restored = shielded(docs)
    cut = op2_decontaminate.find(inside, table(spark, sf_dir, "benchmark"), cut=True).where("not contaminated and not whole")
    return restored(cut.withColumn("n_chars", F.when(F.col("n_hit") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; n_chars follows the text where it is changed."""
    inside, restored = shielded(docs)
    out = op6_pii.redact(op6_pii.find(inside), [*inside.columns, "findings"])
    return restored(out.withColumn("n_chars", F.when(F.size("findings") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces, their token ids (little-endian bytes) and their places in sequences of 4096 tokens."""
    return op4_packing.pack(docs, remembered=200_000)  # its workers serve the other stages as well


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("packing", packing),
]

#: The classifier's and the packer's decisions can't be told in SQL; tests/llm holds the run against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again, and what a stage no longer needs is deleted."""
    docs = table(spark, sf_dir, "documents")
    with scratch(spark) as done:
        for name, stage in STAGES:
            with scratch(spark) as made:
                docs = materialise(stage(spark, docs, sf_dir), name)
                made.remove(docs._siltstone_path)
        done.remove(docs._siltstone_path)
    return docs
