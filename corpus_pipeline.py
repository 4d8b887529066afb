"""Corpus pipeline: from raw documents to packed training sequences.

Each stage is ``(name, function)``; a function takes (spark, docs, sf_dir) and returns a DataFrame that is
written as Parquet and read again as the next one's docs. All but the last return the columns of documents.

1. toxicity: documents that the compression-distance model rejects go.
2. line_dedup: lines that an equal or near line precedes go; so do documents that had words and have none left.
3. near_dedup: of each group of near-duplicate documents (shingles and similarity of op1) one stays.
4. mixing: documents repeat as often as their source's target weight asks, at most twice.
5. packing: token pieces in sequences of 1024.

Null texts, empty ones, rows without an id and repeated rows pass all stages; what each does with them is in its
docstring. Extra columns, whatever their names, are left out at the first stage. No documents give no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltworks.llm import lines, minhash, mixing, packing, toxicity
from siltworks.llm.common import WORD_PATTERN, crc_bucket, discard, keep, materialise, scratch_area, table
from siltworks.llm.queries import ship

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A document is rejected from this score on.
TOXIC_FROM = 0.7
#: Words of a shingle and similarity in percent of the near-dedup stage: those that the contract of op1 names.
SHINGLE, PERCENT = 2, 80


def _documents(docs: DataFrame) -> DataFrame:
    """The columns of documents, n_chars following the text."""
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents scored toxic by a model of all but the held-out third of the labels.

    Null and empty texts score as texts without words and stay unless most labelled rows are toxic. Repeated rows
    have one score and stay or go together; a null id is no label's.
    """
    ship(spark)
    model = toxicity.fit_table(docs, table(spark, sf_dir, "labels"), crc_bucket(F.col("doc_id"), 3) != 1)
    scored = toxicity.score_toxicity(docs.select(*COLUMNS), model, score="_toxic")
    return scored.filter(F.col("_toxic") < TOXIC_FROM).select(*COLUMNS)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines seen before go. A document left without a word was nothing but copies; one that never had any stays.

    Null and empty texts stay as they are. Of equal rows one keeps its lines, the others go as copies do.
    """
    ship(spark)
    kept = lines.dedup_lines(docs.select(*COLUMNS))
    emptied = (F.col("n_kept") < F.col("n_lines")) & ~F.col("text").rlike(WORD_PATTERN)
    return _documents(kept.filter(~F.coalesce(emptied, F.lit(False))))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: the one of least id.

    Texts without words are in no group and stay, and so do rows without an id. Rows that share an id are one document
    and stay or go together.
    """
    ship(spark)
    groups = minhash.near_duplicates(docs, size=SHINGLE, percent=PERCENT)
    # Written out, so that the join below stands alone.
    gone = materialise(groups.filter(~F.col("kept")).select("doc_id").distinct())
    return docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows repeat with their copies; documents of no size, which no mix counts, stay once.

    Each row has copies of its own, those that share an id or have none too. A null source is one of its own.
    """
    ship(spark)
    mixed = mixing.mix_sources(docs.select(*COLUMNS), keep_text=True)
    copies = F.when(F.col("size") == 0, F.lit(1)).otherwise(F.col("copies"))
    return mixed.withColumn("_copy", F.explode(F.when(copies > 0, F.sequence(F.lit(1).cast("long"), copies)))).select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per token piece with its sequence and place; see ``packing.pack_documents``.

    Null and empty texts are the end token alone. Repeated rows and rows without an id are packed as often as they occur.
    """
    ship(spark)
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity_stage),
    ("line_dedup", line_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Compression, hashing and tokenisation are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over documents. What a stage wrote on its way is deleted once its result is written."""
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES[:-1]):
        with scratch_area():
            before, docs = docs, keep(materialise(stage(spark, docs, sf_dir)))
        if number:
            discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
