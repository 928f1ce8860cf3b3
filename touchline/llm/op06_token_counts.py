"""Token counts from an exact length histogram.

Documents are counted by encoded length; suffix sums over that small table answer totals, quantiles
and truncated totals for every context limit without touching a text again. The suffix sums are taken in two
levels (spans of lengths, then lengths within a span), so that no task holds more than one span.

Edge cases: a null or empty text has length 0. A very long text is encoded whole, like any other. Texts of equal length share a row. Repeated rows count
once each. An empty table gives an empty histogram. Columns besides ``text`` are ignored.
"""

from __future__ import annotations

import base64
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from touchline.llm.common import stored, table

SPAN = 1024
_ENCODERS: dict = {}


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def _encoder(path: str):
    if path not in _ENCODERS:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _ENCODERS[path] = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[path]


def length_histogram(docs: DataFrame, ranks_path: str | None = None) -> DataFrame:
    """n_tokens, n_docs: how many documents have each encoded length."""
    path = ranks_path or default_ranks()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(path).encode_ordinary
        for batch in batches:
            found = Counter(len(encode(t.as_py() or "")) for t in batch.column(0))
            yield pa.RecordBatch.from_pydict({"n_tokens": pa.array(found.keys(), pa.int64()), "n_docs": pa.array(found.values(), pa.int64())})

    return docs.select("text").mapInArrow(count, "n_tokens long, n_docs long").groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs"))


def context_report(histogram: DataFrame, span: int = SPAN) -> DataFrame:
    """For each length L: documents and tokens at L or longer, documents at L or shorter, and tokens kept if every text is cut at L."""
    h = histogram.withColumn("span", F.floor(F.col("n_tokens") / span).cast("long")).withColumn("tokens", F.col("n_tokens") * F.col("n_docs"))
    spans = h.groupBy("span").agg(F.sum("n_docs").alias("span_docs"), F.sum("tokens").alias("span_tokens"))
    everything = Window.partitionBy(F.lit(0))
    later = everything.orderBy("span").rowsBetween(1, Window.unboundedFollowing)
    spans = spans.select(
        "span",
        F.coalesce(F.sum("span_docs").over(later), F.lit(0)).alias("later_docs"),
        F.coalesce(F.sum("span_tokens").over(later), F.lit(0)).alias("later_tokens"),
        F.sum("span_docs").over(everything).alias("total_docs"),
        F.sum("span_tokens").over(everything).alias("total_tokens"),
    )
    rest = Window.partitionBy("span").orderBy("n_tokens").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    h = h.join(spans, "span")
    docs_from, tokens_from = F.sum("n_docs").over(rest) + F.col("later_docs"), F.sum("tokens").over(rest) + F.col("later_tokens")
    return (
        h.withColumn("docs_from", docs_from)
        .withColumn("tokens_from", tokens_from)
        .select(
            "n_tokens",
            "n_docs",
            "docs_from",
            "tokens_from",
            (F.col("total_docs") - F.col("docs_from") + F.col("n_docs")).alias("docs_upto"),
            (F.col("total_tokens") - F.col("tokens_from") + F.col("n_tokens") * F.col("docs_from")).alias("truncated_total"),
            "total_docs",
            "total_tokens",
        )
    )


def _with_each(report: DataFrame, name: str, values: list, kind: str) -> DataFrame:
    """Every histogram row once for each of the caller's values (repeated values count once)."""
    return report.withColumn(name, F.explode(F.array(*(F.lit(v) for v in sorted(set(values)))).cast(f"array<{kind}>")))


def totals_at(report: DataFrame, limits: list[int]) -> DataFrame:
    """Truncated total and documents cut for arbitrary limits, from the report alone; no rows for an empty one."""
    return (
        _with_each(report, "context_limit", limits, "long")
        .groupBy("context_limit")
        .agg(
            F.sum(F.least("n_tokens", "context_limit") * F.col("n_docs")).alias("truncated_total"),
            F.sum(F.when(F.col("n_tokens") > F.col("context_limit"), F.col("n_docs")).otherwise(0)).alias("docs_cut"),
        )
    )


def quantiles(report: DataFrame, shares: list[float]) -> DataFrame:
    """Smallest length that at least the given share of documents does not exceed."""
    reached = F.col("docs_upto") >= F.ceil(F.col("share") * F.col("total_docs"))
    return _with_each(report, "share", shares, "double").where(reached).groupBy("share").agg(F.min("n_tokens").alias("n_tokens"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The report reads the histogram more than once; stored, it is counted from the texts once.
    return context_report(stored(length_histogram(table(spark, sf_dir, "documents"))))


QUERIES = {"op6_token_counts": op6_token_counts}
