"""Document fingerprints from closed syncmers, in DataFrame functions only.

A text is a run of units: words, where a word of more than ``UNIT`` characters is cut into units of that length. A k-mer of
``K`` units is an anchor if, of its inner runs of ``S`` units, the one with the least hash stands at its first or last place. The
choice needs nothing but the k-mer itself, so the same passage has the same anchors in any text around it (:func:`anchors`
gives them with their places). The fingerprint of a text has, of its distinct anchors, the ``SIZE`` of least hash and all whose hash lies
in the lowest ``SHARE``-th of the range, so that it grows with the text; each comes with its first place. Anchors of two
fingerprints match by position: equal hashes count if a neighbouring match lies on the same diagonal, as within a shared passage. The likeness is
the share of the smaller fingerprint's anchors that are matched, among the hashes that both cover, and can be worked out from the two
returned strings. It covers all anchors of texts of at most ``SIZE`` each, and of longer ones at least ``SIZE`` or an expected ``SHARE``-th.

Each document also meets its successor by doc_id: ids alone are sorted by range, and a document is sent no more of its successor
than the characters it takes over.

Edge cases: a null or empty text (or white space alone) has an empty fingerprint; two empty fingerprints have likeness 1, an
empty and another one 0. In a text of fewer than ``K`` units every unit is an anchor. Inner runs of equal hash tie, and each tied one at an edge makes an
anchor. A very long text is handled in the arrays of its one row. A single match of two fingerprints counts. Rows that repeat doc_id and text count as one document
for the order, and each gets the same result; rows that repeat a doc_id alone are ordered by their texts' hashes. A null doc_id comes first. A
single document is its own successor. An empty table gives no rows. Columns besides ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from touchline.llm.common import checkpoint, row_key, table

K, S, UNIT = 5, 2, 16
#: A fingerprint holds the SIZE least hashes and all in the lowest SHARE-th of their range.
SIZE, SHARE = 48, 8
TOP = 0x7FFFFFFF
KEY = ["doc_id", "text_hash", "text_bytes"]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def unit_hashes(text: Column, unit: int = UNIT) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(rf"[^ \t\n\x0B\f\r]{{1,{unit}}}"), F.lit(0)), lambda w: F.xxhash64(w))


def inner_hashes(units: Column) -> Column:
    """Of each two neighbouring units; one fewer than the units."""
    return F.transform(F.slice(units, 2, F.greatest(F.size(units) - 1, F.lit(0))), lambda u, i: F.xxhash64(F.get(units, i), u))


def _closed(inner: Column, i: Column) -> Column:
    at = lambda j: F.get(inner, i + j)
    last = K - S
    middle = F.least(*(at(j) for j in range(1, last))) if last > 2 else at(1)
    return F.least(at(0), at(last)) <= middle


def _kmer_hash(units: Column, inner: Column, i: Column) -> Column:
    return F.xxhash64(F.get(inner, i), F.get(units, i + S), F.get(inner, i + K - S))


def anchor_hashes(text: Column, unit: int = UNIT) -> Column:
    """array<struct<at, hash>>: the closed syncmers of a text, by place."""

    def found(units: Column, inner: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(units) - K)
        return F.transform(F.filter(starts, lambda i: _closed(inner, i)), lambda i: F.struct(i.cast("int").alias("at"), _kmer_hash(units, inner, i).alias("hash")))

    short = lambda u: F.transform(u, lambda x, i: F.struct(i.alias("at"), x.alias("hash")))
    return let(unit_hashes(text, unit), lambda u: F.when(F.size(u) < K, short(u)).otherwise(let(inner_hashes(u), lambda s: found(u, s))))


def anchors(docs: DataFrame, unit: int = UNIT) -> DataFrame:
    """doc_id, at, hash: every anchor with its place, counted in units."""
    return docs.select("doc_id", F.explode(anchor_hashes(F.coalesce("text", F.lit("")), unit)).alias("a")).select("doc_id", "a.at", "a.hash")


def fingerprint(text: Column, size: int = SIZE, share: int = SHARE, unit: int = UNIT) -> Column:
    """Ascending longs, a hash of 31 bits above a place of 32: of each distinct anchor hash the first place, for the ``size`` least hashes and all below ``1 / share`` of the range."""
    codes = F.transform(anchor_hashes(text, unit), lambda a: F.shiftleft(a["hash"].bitwiseAND(F.lit(TOP)), 32).bitwiseOR(a["at"].cast("long")))
    distinct = lambda held: F.filter(held, lambda x, i: (i == 0) | (F.shiftright(F.get(held, i - 1), 32) != F.shiftright(x, 32)))
    limit = F.lit(TOP // share << 32)
    return let(let(F.sort_array(codes), distinct), lambda held: F.filter(held, lambda x, i: (i < size) | (x < limit)))


def likeness(a: Column, b: Column, size: int = SIZE, share: int = SHARE) -> Column:
    """Of two fingerprints, 0 to 1: matched anchors by those of the smaller one, among the hashes that both cover.

    Anchors match if their hashes are equal and, where there is more than one match, another match next to it (by place) lies on the same diagonal, that
    is at the same distance of places.
    """
    hash_of = lambda x: F.shiftright(x, 32)
    place = lambda x: x.bitwiseAND(F.lit(0xFFFFFFFF))
    reach = lambda x: F.when(F.size(x) < size, F.lit(TOP)).otherwise(F.greatest(hash_of(F.get(x, F.lit(size - 1))), F.lit(TOP // share - 1)))

    def matches(both: Column) -> Column:
        """(place in a, diagonal) of each hash that both have, by place: the two lists merged, where equal hashes are neighbours."""
        after = lambda i: F.get(both, i + 1)
        met = F.filter(F.transform(both, lambda x, i: F.when(x["hash"] == after(i)["hash"], F.struct(x["at"].alias("at"), (after(i)["at"] - x["at"]).alias("diagonal")))), lambda x: x.isNotNull())
        return F.sort_array(met)

    def supported(met: Column) -> Column:
        on = lambda x, j: F.coalesce(F.get(met, j)["diagonal"] == x["diagonal"], F.lit(False))
        beside = lambda x, i: on(x, i + 1) | on(x, i - 1)
        return F.when(F.size(met) == 1, F.lit(1)).otherwise(F.size(F.filter(met, beside)))

    def compared(most: Column) -> Column:
        within = lambda x, side: F.transform(F.filter(x, lambda c: hash_of(c) <= most), lambda c: F.struct(hash_of(c).alias("hash"), F.lit(side).alias("side"), place(c).alias("at")))
        own = F.struct(within(a, 0).alias("a"), within(b, 1).alias("b"))
        return let(own, lambda x: let(matches_of(x), supported) / F.greatest(F.least(F.size(x["a"]), F.size(x["b"])), F.lit(1)))

    matches_of = lambda x: let(F.sort_array(F.concat(x["a"], x["b"])), matches)
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(let(F.least(reach(a), reach(b)), compared))


def as_text(codes: Column) -> Column:
    """Sixteen hex digits of each anchor: its hash and its place."""
    return F.array_join(F.transform(codes, lambda x: F.lower(F.lpad(F.hex(x), 16, "0"))), "")


def successors(docs: DataFrame) -> DataFrame:
    """The key of each distinct document with that of the document before it (p_...), and how many characters that one has."""
    ids = docs.select(*row_key(), F.char_length(F.coalesce("text", F.lit(""))).cast("long").alias("n")).distinct()
    laid = checkpoint(ids.repartitionByRange(*KEY).withColumn("part", F.spark_partition_id()))
    row = F.struct(*KEY, "n")
    # One row per range: the last document of the range before it that has any; the very first is preceded by the very last.
    ends = laid.groupBy("part").agg(F.max(row).alias("end"))
    line = Window.partitionBy(F.lit(0)).orderBy("part")
    ends = ends.select("part", F.coalesce(F.lag("end").over(line), F.last("end").over(line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("end"))
    inside = F.lag(row).over(Window.partitionBy("part").orderBy(*(F.col(c).asc_nulls_first() for c in KEY)))
    before = laid.withColumn("before", inside).join(ends, "part").withColumn("before", F.coalesce("before", "end"))
    return before.select(*KEY, *(F.col(f"before.{c}").alias(f"p_{c}") for c in [*KEY, "n"]))


def _pair(doc_id: str, text_hash: str | Column, text_bytes: str | Column, name: str) -> list[Column]:
    """The document key as two hashes that are never null, for plain equality."""
    return [F.xxhash64(F.lit(n), doc_id, text_hash, text_bytes).alias(f"{name}{n}") for n in (1, 2)]


def edited_fingerprints(docs: DataFrame, size: int = SIZE, share: int = SHARE, unit: int = UNIT) -> DataFrame:
    """doc_id, n_chars, edited (the text whose last quarter its successor's beginning replaces), next_id, and the fingerprints own, of_edited, of_next."""
    held = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("body"))
    # Both roles of a document, before and behind another, read this one exchange with all its columns, to be the same plan in both.
    held = held.select(*_pair("doc_id", F.xxhash64("body"), F.octet_length("body").cast("long"), "k"), "doc_id", "body", fingerprint(F.col("body"), size, share, unit).alias("own"))
    links = successors(docs)
    links = links.select(*_pair(*KEY, "l"), *_pair(*(f"p_{c}" for c in KEY), "p"), "p_n")
    # Of repeated rows one is enough to give its beginning; a rank would need a row limit of its own before the exchange.
    first = F.lag("k1").over(Window.partitionBy("k1", "k2").orderBy("k1")).isNull()
    giver = held.withColumn("first", first).where("first").join(links, (F.col("k1") == F.col("l1")) & (F.col("k2") == F.col("l2")))
    given = giver.select("p1", "p2", F.col("doc_id").alias("next_id"), F.expr("substring(body, 1, cast(p_n div 4 as int))").alias("start"), F.col("own").alias("of_next"))
    met = (F.col("k1") == F.col("p1")) & (F.col("k2") == F.col("p2"))
    n = F.char_length("body").cast("long")
    joined = held.join(given, met).select("doc_id", n.alias("n_chars"), F.expr("concat(substring(body, 1, cast(char_length(body) - char_length(body) div 4 as int)), start)").alias("edited"), "own", "next_id", "of_next")
    return joined.withColumn("of_edited", fingerprint(F.col("edited"), size, share, unit))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = edited_fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited"), 256).alias("edited_sha256"),
        as_text(F.col("own")).alias("fingerprint"),
        as_text(F.col("of_edited")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("of_edited")).alias("near_edited"),
        likeness(F.col("own"), F.col("of_next")).alias("near_next"),
        "next_id",  # without it the two roles would read different columns, and not one exchange
    )


QUERIES = {"op8_fingerprints": op8_fingerprints}
