"""Benchmark decontamination by template canonicalisation.

Every white-space token becomes its lower-cased letters or a typed placeholder: a number, a unit behind a
number, or a name (a capitalised word inside a sentence). Windows of the templates are hash-joined between
documents and benchmark items. A window of an item with fewer than ``min_literals`` plain words would match anything as a template; it is joined by its
lower-cased tokens instead, so that verbatim copies of items full of numbers or names are found too. Joined windows are read along diagonals (document
position less item position). On a diagonal the fillings of the slots must be one to one for each kind: a number, unit or name of the item
always became the same one, and no two became one; other diagonals are thrown out. An item counts as leaked
when the windows left cover ``coverage`` of its windows (or of those joined as templates) or ``run`` of its tokens.

The benchmark's windows go to every task only while they take less than ``BROADCAST_BYTES``; beyond it all
document windows are shuffled to the join instead, with the same result.

Edge cases: null or empty texts and items have no windows. Items shorter than a window are one window of their own
length. Texts of any length are cut window by window, in runs of whole documents. Where several diagonals of one pair stand, their windows are pooled (each item
window counts once). Repeated rows are reported once each for (doc_id, item_id). Rows with a null doc_id are reported under null, and an item with
a null item_id under null. Empty tables give no rows. Further columns are ignored by :func:`leaks` and kept by :func:`decontaminate`, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.llm.common import free_names, row_key, stored, table, text_bytes

WINDOW = 8
MIN_LITERALS = 4
COVERAGE = 0.5
RUN = 25
#: Bytes of benchmark windows that are sent to every task at most.
BROADCAST_BYTES = 32 << 20
MEMO_WORDS = 900_000
#: Bytes of text whose tokens are handled together.
RUN_BYTES = 2 << 20

NUMBER = re.compile(r"[+-]?(\d[\d.,:/]*|\d*\.\d+)%?\Z")
NUMBER_UNIT = re.compile(r"([+-]?\d[\d.,]*)([^\W\d_]+|%|°[CF]?)\Z")
#: Number words and units that become placeholders.
NUMBER_WORDS = {"one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "twenty", "thirty", "forty", "fifty", "hundred", "thousand", "million"}
UNITS = {"mm", "cm", "m", "km", "inch", "inches", "foot", "feet", "mile", "miles", "g", "kg", "lb", "lbs", "ton", "tons", "ml", "l", "liter", "liters", "litre", "litres", "s", "sec", "second", "seconds", "min", "minute", "minutes", "h", "hour", "hours", "day", "days", "week", "weeks", "month", "months", "year", "years", "dollar", "dollars", "euro", "euros", "cent", "cents", "percent", "degrees"}
LITERAL, NUM, UNIT, NAME = 0, 1, 2, 3
ENDS, CAPITAL, IS_UNIT = 4, 8, 16
#: Stands for the hash of a number with its unit attached.
UNIT_CODE = np.uint64(0x5DEECE66D5DEECE6)
#: Marks that are stripped from words without a look at the rest.
MARKS = b".,;:!?()[]\"'|&*#"
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")

_NUMBERS, _UNITS = {w.encode() for w in NUMBER_WORDS}, {w.encode() for w in UNITS}
#: Last bytes of a word that ends a sentence, brackets and quotes behind them left aside.
_STOPS = b".!?:|"


class Words(dict):
    """Raw word -> its number in the tables of hashes and traits that grow along."""

    def __init__(self):
        from xxhash import xxh64_intdigest

        super().__init__()
        self.hash = xxh64_intdigest
        self.raw: list[bytes] = []
        self.code: list[int] = []
        self.plain: list[int] = []
        self.traits: list[int] = []  # kind, and flags from bit 2 on

    def __missing__(self, raw: bytes) -> int:
        bare = raw.strip(MARKS)
        if bare.isalpha():  # ASCII letters alone, as in most words
            low = bare.lower()
            kind = NUM if low in _NUMBERS else LITERAL
            self.code.append(self.hash(low, 7))
            self.plain.append(self.code[-1])
            stop = raw.rstrip(b"\"')]")
            self.traits.append(kind | ENDS * (stop[-1] in _STOPS) | CAPITAL * (len(bare) > 1 and bare.istitle()) | IS_UNIT * (low in _UNITS))
        else:
            self._learn(raw.decode("utf-8", "replace"))
        self.raw.append(raw)
        self[raw] = len(self.raw) - 1
        return self[raw]

    def _learn(self, word: str) -> None:
        bare, low, number, joint = parse(word)
        ends = word.rstrip("\"')]»”").endswith((".", "!", "?", ":", "|"))
        capital = len(bare) > 1 and bare[0].isupper() and bare[1:].islower()
        self.plain.append(self.hash(low, 7) if bare else 0)
        self.code.append(int(UNIT_CODE) if joint and not number else self.plain[-1])
        self.traits.append((NUM if number or joint else LITERAL) | ENDS * ends | CAPITAL * capital | IS_UNIT * (low in UNITS))

    def form(self, number: int) -> str:
        return parse(self.raw[number].decode("utf-8", "replace"))[1]


def parse(word: str) -> tuple[str, str, bool, bool]:
    """The word without marks around it, in lower case, whether it is a number, and whether a number with its unit."""
    stripped = word.strip(MARKS.decode())
    if stripped.isalpha():
        return stripped, stripped.lower(), stripped.lower() in NUMBER_WORDS, False
    signed = NUMBER.match(word.rstrip(".,;:!?)"))
    bare = signed.group(0) if signed else _EDGE.sub("", word)
    low = bare.lower()
    return bare, low, bool(NUMBER.match(bare)) or low in NUMBER_WORDS, bool(NUMBER_UNIT.match(bare))


_WORDS = Words()


def templates(texts: list[bytes], words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text's number, word number, kind, template hash and plain hash of each token of all texts; tokens of punctuation alone are left out."""
    raw = [t.split() for t in texts]
    lengths = np.fromiter(map(len, raw), np.int64, len(raw))
    index = np.fromiter(map(words.__getitem__, chain.from_iterable(raw)), np.int64, lengths.sum())
    owner = np.repeat(np.arange(len(raw)), lengths)
    code, traits = _column(words, "code", np.uint64)[index], _column(words, "traits", np.uint8)[index]
    kind, ends, capital = (traits & 3).astype(np.int8), traits & ENDS > 0, traits & CAPITAL > 0
    inside = np.append(False, (owner[1:] == owner[:-1]) & ~ends[:-1])[: len(index)]
    kind[(kind == LITERAL) & capital & inside] = NAME
    kept = code != 0
    owner, index, code, kind, traits = owner[kept], index[kept], code[kept], kind[kept], traits[kept]
    after_number = np.append(False, (owner[1:] == owner[:-1]) & (kind[:-1] == NUM))[: len(index)]
    kind[after_number & (traits & IS_UNIT > 0)] = UNIT
    with_unit = (kind == NUM) & (code == UNIT_CODE)
    code[kind != LITERAL] = (kind[kind != LITERAL] + 10).astype(np.uint64)
    code[with_unit] = 20
    return owner, index, kind, code, _column(words, "plain", np.uint64)[index]


def _column(words: Words, name: str, kind) -> np.ndarray:
    """A trait's table as an array, made anew only when words were added."""
    cache = words.__dict__.setdefault("arrays", {})
    if name not in cache or len(cache[name]) < len(words.raw):
        have = cache.get(name, np.zeros(0, kind))
        cache[name] = np.concatenate([have, np.array(getattr(words, name)[len(have) :], kind)])
    return cache[name]


def window_hashes(code: np.ndarray, size: int) -> np.ndarray:
    n = len(code) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total, factor = np.full(n, size, np.uint64), 0x9E3779B97F4A7C15
    for j in range(size):
        total += code[j : j + n] * np.uint64(factor)
        factor = factor * 0xD1342543DE82EF95 % (1 << 64)
        total ^= total >> np.uint64(29)
    return total * np.uint64(0xBF58476D1CE4E5B9)


def literal_counts(kind: np.ndarray, size: int) -> np.ndarray:
    sums = np.append(0, np.cumsum(kind == LITERAL))
    return sums[size:] - sums[:-size]


def _slots(index: np.ndarray, kind: np.ndarray, at: int, size: int, words: Words) -> list[str]:
    return [f"{kind[k]}{words.form(index[k])}" if kind[k] != LITERAL else "" for k in range(at, at + size)]


def item_windows(items: DataFrame, size: int = WINDOW, min_literals: int = MIN_LITERALS) -> DataFrame:
    """h, size, exact, item_id, item_at, item_tokens, item_windows, item_templates, item_slots: the windows of each item, as templates or else exact."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            rows = []
            for i, text in enumerate(batch.column(1).to_pylist()):
                _, index, kind, code, plain = templates([text], words)
                own = min(size, len(code))
                if not own:
                    continue
                variants = [code]
                if kind[0] == LITERAL and words.traits[index[0]] & CAPITAL:
                    # Behind other text the first word of the item may look like a name.
                    variants.append(np.concatenate([np.array([NAME + 10], np.uint64), code[1:]]))
                rich = literal_counts(kind, own) >= min_literals
                shape = (len(code), len(rich), int(rich.sum()))
                for variant in variants:
                    hashes = window_hashes(variant, own)
                    rows += [(int(hashes[k].view(np.int64)), own, False, i, int(k), *shape, _slots(index, kind, k, own, words)) for k in np.flatnonzero(rich) if variant is code or k == 0]
                hashes = window_hashes(plain, own)
                rows += [(int(hashes[k].view(np.int64)), own, True, i, int(k), *shape, []) for k in np.flatnonzero(~rich)]
            cols = list(zip(*rows, strict=True)) or [[]] * 9
            kinds = (pa.int64(), pa.int32(), pa.bool_(), None, pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) if k else batch.column(0).take(pa.array(c, pa.int64())) for c, k in zip(cols, kinds, strict=True)],
                names=["h", "size", "exact", "item_id", "item_at", "item_tokens", "item_windows", "item_templates", "item_slots"],
            )

    id_type = items.schema["item_id"].dataType.simpleString()
    schema = f"h long, size int, exact boolean, item_id {id_type}, item_at int, item_tokens int, item_windows int, item_templates int, item_slots array<string>"
    return items.select("item_id", text_bytes().alias("text")).mapInArrow(cut, schema).distinct()


class Filter:
    """Which of many hashes are in a fixed set: a bit table first, then a search."""

    def __init__(self, hashes: np.ndarray):
        self.sorted = np.sort(hashes.astype(np.uint64))
        self.bits = np.zeros(1 << 20, bool)
        self.bits[self.sorted >> np.uint64(44)] = True

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        maybe = np.flatnonzero(self.bits[hashes >> np.uint64(44)])
        at = np.searchsorted(self.sorted, hashes[maybe])
        at[at == len(self.sorted)] = 0
        return maybe[self.sorted[at] == hashes[maybe]]


def _runs(batch: pa.RecordBatch, column: int, most: int = RUN_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts have some ``most`` bytes together."""
    sizes = np.fromiter((len(t) for t in batch.column(column).to_pylist()), np.int64, batch.num_rows)
    group = np.cumsum(sizes) // most
    edges = [0, *(np.flatnonzero(group[1:] != group[:-1]) + 1).tolist(), batch.num_rows]
    for a, b in zip(edges, edges[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)


def document_windows(docs: DataFrame, forms: list[tuple[int, bool]], wanted: dict[tuple[int, bool], np.ndarray] | None, min_literals: int = MIN_LITERALS) -> DataFrame:
    """h, size, exact, doc_at, doc_slots and the row's key for each window in the given forms (size, exact); with ``wanted`` only for hashes of the benchmark."""
    shared = docs.sparkSession.sparkContext.broadcast(wanted) if wanted is not None else None

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        global _WORDS
        filters = {s: Filter(h) for s, h in shared.value.items()} if shared is not None else None
        for batch in batches:
            for part in _runs(batch, 3):
                if len(_WORDS) > MEMO_WORDS:
                    _WORDS = Words()
                words, rows = _WORDS, []
                owner, index, kind, code, plain = templates(part.column(3).to_pylist(), words)
                starts = np.searchsorted(owner, np.arange(part.num_rows))
                for size, exact in forms:
                    hashes = window_hashes(plain if exact else code, size)
                    if not len(hashes):
                        continue
                    at = filters[size, exact](hashes) if filters is not None else np.arange(len(hashes))
                    at = at[owner[at] == owner[at + size - 1]]
                    if not exact:
                        # One literal may be taken for a name where a passage begins.
                        at = at[literal_counts(kind, size)[at] >= min_literals - 1]
                    rows += [(int(hashes[k].view(np.int64)), size, exact, int(owner[k]), int(k - starts[owner[k]]), [] if exact else _slots(index, kind, k, size, words)) for k in at]
                cols = list(zip(*rows, strict=True)) or [[]] * 6
                take = pa.array(cols[3], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.bool_()), *(part.column(c).take(take) for c in range(3)), pa.array(cols[4], pa.int32()), pa.array(cols[5], pa.list_(pa.string()))],
                    names=["h", "size", "exact", "doc_id", "text_hash", "text_bytes", "doc_at", "doc_slots"],
                )

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select(*row_key(), text_bytes().alias("text")).mapInArrow(cut, f"h long, size int, exact boolean, doc_id {id_type}, text_hash long, text_bytes long, doc_at int, doc_slots array<string>")


def one_to_one(pairs: Column) -> Column:
    """Whether distinct (a, b) pairs, whose kinds stand in front, give each a one b and each b one a."""
    distinct = lambda side: F.size(F.array_distinct(F.transform(pairs, lambda p: p[side])))
    return (F.size(pairs) == distinct("a")) & (F.size(pairs) == distinct("b"))


def leaks(docs: DataFrame, items: DataFrame, size: int = WINDOW, min_literals: int = MIN_LITERALS, coverage: float = COVERAGE, run: int = RUN, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """doc_id, text_hash, text_bytes, item_id, n_windows, item_windows, coverage, first_token, last_token for each item leaked into a row."""
    bench = stored(item_windows(items, size, min_literals))  # a small table, which the result still reads
    slots = F.aggregate("item_slots", F.lit(0).cast("long"), lambda a, x: a + F.octet_length(x) + 16)
    forms = bench.groupBy("size", "exact").agg(F.sum(slots + 64).alias("bytes")).collect()  # at most 2 * ``size`` rows
    wanted = None
    if sum(r.bytes for r in forms) <= broadcast_bytes:
        found = bench.select("size", "exact", "h").distinct().toPandas()
        wanted = {(int(s), bool(e)): g.h.to_numpy(np.int64).view(np.uint64) for (s, e), g in found.groupby(["size", "exact"])}
    windows = document_windows(docs, sorted((r["size"], r["exact"]) for r in forms), wanted, min_literals)
    met = windows.join(F.broadcast(bench) if wanted is not None else bench, ["h", "size", "exact"])
    key = ["doc_id", "text_hash", "text_bytes", "item_id", "item_tokens", "item_windows", "item_templates", "size"]
    pairs = F.filter(F.zip_with("item_slots", "doc_slots", lambda a, b: F.struct(a.alias("a"), b.alias("b"))), lambda p: p["a"] != "")
    diagonals = (
        met.withColumn("diagonal", F.col("doc_at") - F.col("item_at"))
        .groupBy(*key, "diagonal")
        .agg(F.collect_set("item_at").alias("at"), F.collect_set(F.when(~F.col("exact"), F.col("item_at"))).alias("rich"), F.array_distinct(F.flatten(F.collect_set(pairs))).alias("pairs"))
        .where(one_to_one(F.col("pairs")))
    )
    merged = diagonals.groupBy(*key).agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("at")))).alias("at"),
        F.size(F.array_distinct(F.flatten(F.collect_list("rich")))).alias("n_rich"),
        F.min(F.col("diagonal") + F.array_min("at")).alias("first_token"),
        F.max(F.col("diagonal") + F.array_max("at") + F.col("size") - 1).alias("last_token"),
    )
    covered = F.col("size") + F.aggregate(F.sequence(F.lit(2), F.size("at")), F.lit(0), lambda s, i: s + F.least(F.element_at("at", i) - F.element_at("at", i - 1), F.col("size")))
    covered = F.when(F.size("at") > 1, covered).otherwise(F.col("size"))
    share = F.greatest(F.size("at") / F.col("item_windows"), F.when(F.col("item_templates") > 0, F.col("n_rich") / F.col("item_templates")).otherwise(F.lit(0.0)))
    found = merged.where((share >= coverage) | (covered >= run))
    return found.select("doc_id", "text_hash", "text_bytes", "item_id", F.size("at").cast("long").alias("n_windows"), F.col("item_windows").cast("long").alias("item_windows"), F.round(share, 6).alias("coverage"), F.col("first_token").cast("long").alias("first_token"), F.col("last_token").cast("long").alias("last_token"))


def decontaminate(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The documents that leak no item; all columns stay."""
    names = free_names(docs, "l_id", "l_hash", "l_bytes")
    bad = leaks(docs, items, **options).select(*(F.col(c).alias(n) for c, n in zip(("doc_id", "text_hash", "text_bytes"), names, strict=True))).distinct()
    key = row_key()
    return docs.join(bad, key[0].eqNullSafe(F.col(names[0])) & (key[1] == F.col(names[1])) & (key[2] == F.col(names[2])), "left_anti")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_hash", "text_bytes")


QUERIES = {"op9_decontamination": op9_decontamination}
