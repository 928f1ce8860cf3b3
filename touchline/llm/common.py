"""Helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one block of documents is meant to hold.
BLOCK_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Keep the folder the cluster names; make one only where none is set."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    named = context.getConf().get("spark.checkpoint.dir", None)
    if named is None and not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))


def checkpoint(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it from there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def shuffles_cleaned(spark: SparkSession) -> Iterator[None]:
    """A query run inside deletes its shuffle files when it ends, not when the driver collects its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def stored(df: DataFrame, paths: list[str] | None = None) -> DataFrame:
    """``df`` written as a Parquet table under the shared checkpoint folder, which takes less room than a checkpoint.

    Its path is added to ``paths``, so that :func:`discard` can delete the table once nothing reads it any more.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{uuid.uuid4().hex}.parquet"
    with shuffles_cleaned(spark):
        df.write.parquet(path)
    if paths is not None:
        paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Delete tables of :func:`stored`."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    for path in paths:
        place = hadoop.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
    paths.clear()


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores behind it as it takes to clash with no column of ``df`` (Spark minds no case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def labelled_sample(docs: DataFrame, labels: DataFrame, target: str, rows: int, seed: int) -> DataFrame:
    """doc_id, label, order, text: at most ``rows`` training rows of each label, those whose ids hash lowest, with their whole texts.

    Of rows that repeat a doc_id the one whose text hashes lowest stands for all; a repeated label counts once.
    """
    known = labels.select("doc_id", F.col(target).cast("int").alias("label")).where(F.col("label").isin(0, 1) & ~held_out(F.col("doc_id")))
    known = known.distinct().withColumn("order", F.xxhash64("doc_id", F.lit(seed)))
    picked = [known.where(F.col("label") == k).orderBy("order", "doc_id").limit(rows) for k in (0, 1)]
    picked = F.broadcast(picked[0].union(picked[1]))  # 2 * rows rows at most, each an id and two numbers
    met = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(picked, "doc_id")
    least = F.min(F.struct(F.xxhash64("text").alias("hash"), "text"))
    return met.groupBy("doc_id", "label", "order").agg(least.alias("x")).select("doc_id", "label", "order", "x.text")


def held_out(doc_id: Column, remainder: int = 0) -> Column:
    """True where crc32 of the id as text leaves ``remainder`` by 5; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == remainder, F.lit(False))


def text_bytes(name: str = "text") -> Column:
    """The text as UTF-8 bytes; null is empty."""
    return F.coalesce(F.col(name).cast("binary"), F.lit("").cast("binary"))


def row_key(doc_id: str = "doc_id", text: str = "text") -> list[Column]:
    """Columns that tell rows apart though ids repeat: equal keys mean equal rows for every operator."""
    body = F.coalesce(F.col(text), F.lit(""))
    return [F.col(doc_id).alias("doc_id"), F.xxhash64(body).alias("text_hash"), F.octet_length(body).cast("long").alias("text_bytes")]


def block_count(docs: DataFrame, name: str = "text", block_bytes: int = BLOCK_BYTES) -> int:
    """Blocks that hold ``block_bytes`` of text each, from the exact total."""
    total = docs.agg(F.sum(F.octet_length(F.col(name)).cast("long"))).first()[0] or 0
    return max(1, -(-int(total) // block_bytes))


def block_of(blocks: int, doc_id: str = "doc_id", text: str = "text") -> Column:
    """A block number that spreads rows evenly, repeated ids included."""
    return F.pmod(F.xxhash64(F.col(doc_id), F.col(text)), F.lit(blocks)).cast("int")
