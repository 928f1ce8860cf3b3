"""Training-data pipeline: quality, line dedup, near-duplicate dedup, benchmark decontamination, packing.

Every stage takes (spark, docs, sf_dir) and works on all rows of ``docs``. All but the last return documents with
their columns; :func:`run` writes each result as Parquet under the shared checkpoint folder and reads it
again as the next stage's input, and then deletes the one before it.

Edge cases: a null text is scored, split and packed as an empty one and stays null in between; a null doc_id stays with its row. Very long texts are
worked on whole. Of rows that tie in near-dedup (equal ids and texts) one stays. Repeated rows are judged alike. Empty tables pass through, and the packing of
none is none. Columns that the stages do not use are carried along, whatever their names; only n_chars follows a text that lost lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.llm import op01_quality, op04_packing, op05_line_dedup, op09_decontamination, op10_simhash
from touchline.llm.common import discard, free_names, stored, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier, trained on their labelled part, accepts."""
    return op01_quality.keep_good(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without their repeated lines; n_chars follows the text."""
    counts = free_names(docs, "lines_all", "lines_dropped")
    kept = op05_line_dedup.dedup_lines(docs, counts=counts)
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.when(F.col(counts[1]) > 0, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return kept.select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return op10_simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without those that hold a benchmark item."""
    return op09_decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, each a sequence, with their token ids."""
    pieces = op04_packing.pack(docs)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "ids")


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontamination", decontamination), ("packing", packing)]

#: A convolutional network and a tokenizer have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, paths = table(spark, sf_dir, "documents"), []
    for _, stage in STAGES[:-1]:
        before, paths = paths, []
        docs = stored(stage(spark, docs, sf_dir), paths)
        discard(spark, before)
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLES = {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
