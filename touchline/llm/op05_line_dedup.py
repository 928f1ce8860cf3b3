"""Line dedup over range-partitioned line hashes, in DataFrame functions only.

Lines are keyed by a 128-bit hash. First the lines of each (hash, salt) are laid out by range and streamed from the
largest document down: a line behind three larger documents is a repeat whatever other salts hold. What is left of a hash (the lines
of three documents a salt at most) is streamed again, all salts together. The salts grow with the number of lines, so that a salt of one
hash holds about ``LINES_PER_SALT`` lines at most, however common the line. Decisions travel as (document, position); texts do not. The result is
one run-length compressed keep bitmap per document. The lines are hashed once, into a table that both layouts read.

Edge cases: a null or empty text is one empty line. Keys shorter than ``min_chars`` are never dropped. Rows that repeat a doc_id
count as one document. A null doc_id is a document of its own, smaller than any id. Of equal lines in one document all stay or all go. A very long text is one array of lines in its row. An empty
table gives no rows. :func:`dedup_lines` keeps all other columns, whatever their names; where they have the names of its two counts, they get the counts'
values.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from touchline.llm.common import free_names, row_key, stored, table

MIN_CHARS = 20
MIN_DOCS = 3
#: Lines that one salt stands for: the number of salts follows the number of long lines, and is ``SALTS`` at least.
LINES_PER_SALT = 1_000_000
SALTS = 64
#: The ASCII white space of the contract: space and U+0009 to U+000D.
BLANKS = " \t\n\x0b\x0c\r"


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """Stripped of ASCII white space, A-Z lower-cased; other letters stay as they are."""
    bare = F.trim(line, F.lit(BLANKS))
    ascii_only = F.octet_length(bare) == F.length(bare)
    return F.when(ascii_only, F.lower(bare)).otherwise(F.translate(bare, string.ascii_uppercase, string.ascii_lowercase))


def _hashed_lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """One row for each long line: its document, position and hash."""
    lines = F.transform(split_lines(F.col("text")), lambda line, at: F.struct(at.alias("at"), line_key(line).alias("key")))
    long_lines = F.filter(lines, lambda x: F.length(x["key"]) >= min_chars)
    hashed = F.transform(long_lines, lambda x: F.struct(x["at"].alias("at"), F.xxhash64(x["key"]).alias("h1"), F.xxhash64(F.lit(1), x["key"]).alias("h2")))
    return docs.select(*row_key(), F.explode(hashed).alias("x")).select("doc_id", "text_hash", "text_bytes", "x.at", "x.h1", "x.h2")


def dropped_lines(docs: DataFrame, min_chars: int = MIN_CHARS, salts: int | None = None) -> DataFrame:
    """doc_id, text_hash, text_bytes, at: the positions of the lines that go (lines of three documents or more, but for the largest doc_id)."""
    lines = stored(_hashed_lines(docs, min_chars))
    salts = salts or max(SALTS, -(-lines.count() // LINES_PER_SALT))
    lines = lines.withColumn("salt", F.pmod(F.xxhash64("doc_id", "text_hash", "at"), F.lit(salts)).cast("int"))
    salted = Window.partitionBy("h1", "salt", "h2").orderBy(F.col("doc_id").desc_nulls_last())
    rank = F.dense_rank().over(salted)
    seen = lines.repartitionByRange("h1", "salt").withColumn("rank", rank)
    surplus = seen.where(f"rank > {MIN_DOCS}").select("doc_id", "text_hash", "text_bytes", "at")

    # The three largest documents of each salt settle what its other lines leave open: the largest of all, and whether there are three.
    heads = seen.where(f"rank <= {MIN_DOCS}")
    group = Window.partitionBy("h1", "h2").orderBy(F.col("doc_id").desc_nulls_last())
    whole = group.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    place = F.dense_rank().over(group)
    ranked = heads.repartitionByRange("h1").withColumn("place", place).withColumn("places", F.max("place").over(whole))
    repeated = ranked.where(f"place > 1 and places >= {MIN_DOCS}").select("doc_id", "text_hash", "text_bytes", "at")
    return surplus.unionByName(repeated)


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, salts: int | None = None) -> DataFrame:
    """For each document that loses lines: n_dropped and its keep bitmap as runs (kept, dropped, kept, ...), the last run left out."""
    gone = dropped_lines(docs, min_chars, salts)
    held = gone.groupBy("doc_id", "text_hash", "text_bytes").agg(F.array_sort(F.collect_set("at")).alias("gone"))
    start = F.filter("gone", lambda x, i: (i == 0) | (F.element_at("gone", F.greatest(i, F.lit(1))) != x - 1))
    end = F.filter("gone", lambda x, i: (i == F.size("gone") - 1) | (F.element_at("gone", F.least(i + 2, F.size("gone"))) != x + 1))
    held = held.withColumn("first", start).withColumn("last", end)
    kept = F.transform("first", lambda x, i: x - F.when(i == 0, F.lit(0)).otherwise(F.element_at("last", F.greatest(i, F.lit(1))) + 1))
    runs = F.flatten(F.zip_with(kept, F.zip_with("first", "last", lambda a, b: b - a + 1), lambda k, d: F.array(k, d)))
    return held.select("doc_id", "text_hash", "text_bytes", F.size("gone").cast("long").alias("n_dropped"), runs.alias("keep_runs"))


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, salts: int | None = None, counts: tuple[str, str] = ("n_lines", "n_dropped")) -> DataFrame:
    """The documents with their kept lines in ``text``, and the ``counts`` of all and of dropped lines; all other columns stay."""
    maps = keep_bitmaps(docs, min_chars, salts)
    names = free_names(docs, *(f"m_{c}" for c in maps.columns))
    m_id, m_hash, m_bytes, m_dropped, m_runs = names
    maps = maps.toDF(*names)
    key = row_key()
    same = key[0].eqNullSafe(F.col(m_id)) & (key[1] == F.col(m_hash)) & (key[2] == F.col(m_bytes))
    lines = split_lines(F.col("text"))
    flags = F.flatten(F.transform(m_runs, lambda n, i: F.array_repeat(i % 2 == 0, n)))
    # zip_with reads both arrays once, whatever the number of runs; lines behind the last run meet null, and array_join skips nulls.
    marked = F.zip_with(lines, flags, lambda line, stays: F.when(F.coalesce(stays, F.lit(True)), line))
    kept = F.when(F.col(m_runs).isNull(), F.col("text")).otherwise(F.array_join(marked, "\n"))
    others = [c for c in docs.columns if c.lower() not in ("text", *counts)]
    joined = docs.join(maps, same, "left")
    return joined.select(*others, kept.alias("text"), F.size(lines).cast("long").alias(counts[0]), F.coalesce(m_dropped, F.lit(0)).cast("long").alias(counts[1]))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


_BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES = {
    "op5_line_dedup": f"""
with l as (
  select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) as pos from documents),
k as (select doc_id, line, pos, {_LOWER.format(f"trim(line, {_BLANK})")} as key from l),
g as (select key, max(doc_id) as top from k where length(key) >= 20 group by key having count(distinct doc_id) >= 3),
j as (select k.doc_id, k.line, k.pos, g.key is not null and k.doc_id <> g.top as gone from k left join g on k.key = g.key)
select doc_id, count(*) as n_lines, cast(sum(case when gone then 1 else 0 end) as bigint) as n_dropped,
  sha256(coalesce(string_agg(case when gone then null else line end, chr(10) order by pos), '')) as kept_sha256
from j group by doc_id"""
}
QUERIES = {"op5_line_dedup": op5_line_dedup}
