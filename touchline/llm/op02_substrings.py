"""Removal of repeated byte strings with run-length BWT indexes.

Which bytes go: those covered by a window of ``SPAN`` bytes that also starts anywhere else. The windows are dealt out first. Each has an
anchor, the ``GRAM`` bytes within it whose hash is least (the leftmost, in a tie); a pair of equal windows has equal
anchors at equal places, so windows meet by their anchors' hashes. Neighbouring windows of one anchor make a stretch. Anchors seen once are
let go, and equal stretches are counted, not compared: all their windows are repeated.

Stretches that share an anchor but differ are split into cells of ``CELL`` windows. The windows of a cell have in common a core
of ``SPAN - CELL + 1`` bytes, which stands as one symbol between the few bytes at its sides. The distinct cells around shared cores are
indexed in bounded batches of whole groups: the batch's suffixes are sorted, its Burrows-Wheeler transform is cut into
runs, and the suffix positions at the runs' ends are kept with the lengths matched there. Matching statistics stream from
these samples in text order (between two samples the match only gets shorter, by one symbol a step), and a window whose longest match
elsewhere spans its whole length is marked.

A core with more than ``GROUP`` distinct cells around it is not indexed as it is: its cells are halved, which takes half of the sides into the core, and
counted again, down to single windows if need be. So no task gets an unbounded group, and nothing is left out.

What a run of equal stretches has in common needs no index: one distinct stretch stands for all its copies, which is where most repeated bytes of an
ordinary corpus are settled. The index decides about distinct stretches that share a core.

Edge cases: a null or empty text has no bytes. Very long texts are cut into passes of ``PASS`` windows. Equal least hashes of a window tie to the
leftmost. Texts shorter than ``SPAN`` keep everything. Repeated rows are documents of their
own, so a repeated row of ``SPAN`` bytes or more loses everything. An empty table gives no rows. Columns besides ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.llm.common import discard, stored, table, text_bytes

SPAN, GRAM, CELL = 400, 64, 32
#: Distinct cells around one core that are indexed together; and those that one index takes.
GROUP, BATCH = 16_384, 32_768
#: Windows that one numpy pass takes, which is also where stretches of very long texts are cut.
PASS = 1 << 18
_PLACE = np.uint64((1 << 20) - 1)
_BYTES = np.random.default_rng(2).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def anchor_places(flat: np.ndarray, span: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window of a buffer the place of its anchor; and the hash of each gram."""
    h, size = _BYTES[flat], 1
    while size < gram:
        step = min(size, gram - size)
        h = h[:-step] * _FACTOR + h[step:]
        h ^= h >> np.uint64(31)
        size += step
    least = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)
    width, size = span - gram + 1, 1
    while size < width:
        step = min(size, width - size)
        least = np.minimum(least[:-step], least[step:])
        size += step
    return (least & _PLACE).astype(np.int64), h


def stretches(texts: list[bytes], span: int = SPAN, gram: int = GRAM, most: int = PASS) -> Iterator[tuple[int, int, int, int, int, int, int]]:
    """text's number, first and last window, anchor's place, anchor's hash, hash of the bytes, copies.

    A stretch that comes again within its text and pass is folded into its first copy; where it stood comes as a row without copies.
    """
    pieces = [(i, at, t[at : at + most + span - 1]) for i, t in enumerate(texts) for at in range(0, len(t) - span + 1, most)]
    while pieces:
        taken, size = 0, 0
        while taken < len(pieces) and (not taken or size + len(pieces[taken][2]) <= most + span):
            size += len(pieces[taken][2])
            taken += 1
        own, pieces = pieces[:taken], pieces[taken:]
        yield from _pass(own, span, gram)


def _pass(pieces: list[tuple[int, int, bytes]], span: int, gram: int) -> Iterator[tuple]:
    from xxhash import xxh3_64_intdigest

    data = b"".join(p for _, _, p in pieces)
    lengths = np.array([len(p) for _, _, p in pieces])
    starts = np.cumsum(lengths) - lengths
    places, hashes = anchor_places(np.frombuffer(data, np.uint8), span, gram)
    counts = lengths - span + 1
    owner = np.repeat(np.arange(len(pieces)), counts)
    windows = np.arange(counts.sum()) + np.repeat(starts - (np.cumsum(counts) - counts), counts)
    at = places[windows]
    new = np.flatnonzero(np.append(True, (at[1:] != at[:-1]) | (owner[1:] != owner[:-1])))
    last = np.append(new[1:], len(at)) - 1
    view, seen, again = memoryview(data), {}, []
    rows = zip(owner[new].tolist(), windows[new].tolist(), windows[last].tolist(), at[new].tolist(), hashes[at[new]].view(np.int64).tolist(), strict=True)
    for j, a, b, place, h in rows:
        i, shift = pieces[j][0], pieces[j][1] - int(starts[j])
        f = xxh3_64_intdigest(view[a : b + span]) - (1 << 63)
        key = (i, h, f)
        if key in seen:
            seen[key][-1] += 1
            if again and again[-1][0] == i and again[-1][2] == a + shift - 1:
                again[-1][2] = b + shift
            else:
                again.append([i, a + shift, b + shift])
        else:
            seen[key] = [i, a + shift, b + shift, place + shift, h, f, 1]
    yield from map(tuple, seen.values())
    for i, a, b in again:
        yield i, a, b, 0, 0, 0, 0


def find_stretches(docs: DataFrame, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """k1, k2, first, last, at, h, f, copies: the stretches of every row of ``docs`` (k1, k2, body)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                got = list(zip(*stretches(part.column(2).to_pylist(), span, gram), strict=True)) or [[]] * 7
                take = pa.array(got[0], pa.int64())
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0).take(take), part.column(1).take(take), *(pa.array(c, k) for c, k in zip(got[1:], kinds, strict=True))], names=["k1", "k2", "first", "last", "at", "h", "f", "copies"])

    return docs.select("k1", "k2", "body").mapInArrow(cut, "k1 long, k2 long, first long, last long, at long, h long, f long, copies long")


_CELLS = "k1 long, k2 long, first long, ya int, yb int, lo int, c1 long, c2 long, g long, before binary, behind binary, copies long"
_NAMES = [c.split()[0] for c in _CELLS.split(", ")]


def _cells(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [[]] * len(_NAMES)
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[d.split()[1]]) for c, d in zip(cols, _CELLS.split(", "), strict=True)], names=_NAMES)


def _cell(k1: int, k2: int, first: int, ya: int, yb: int, lo: int, core: bytes, before: bytes, behind: bytes, copies: int) -> tuple:
    """A row for the windows that start ya to yb bytes before their anchor; ``core`` stands for what all windows of the cell share."""
    from xxhash import xxh3_64_intdigest, xxh3_128_digest

    key = xxh3_128_digest(core, lo)
    g = xxh3_64_intdigest(b"%d %d %d " % (ya, yb, len(before)) + before + behind) - (1 << 63)
    return k1, k2, first, ya, yb, lo, int.from_bytes(key[:8], "little", signed=True), int.from_bytes(key[8:], "little", signed=True), g, before, behind, min(copies, 2)


def cells_of_stretches(docs: DataFrame, chosen: DataFrame, span: int = SPAN, cell: int = CELL) -> DataFrame:
    """The chosen stretches (k1, k2, first, last, at, copies) of the documents, split into cells."""
    lists = chosen.groupBy("k1", "k2").agg(F.collect_list(F.struct("first", "last", "at", "copies")).alias("own"))
    met = docs.join(lists, ["k1", "k2"]).select("k1", "k2", "body", "own")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                k1, k2, body, own = (batch.column(c)[row].as_py() for c in range(4))
                rows = []
                for s in own:
                    a, xa, xb = s["at"], s["at"] - s["last"], s["at"] - s["first"]
                    for lo in range(xa - xa % cell, xb + 1, cell):
                        hi, ya, yb = lo + cell - 1, max(xa, lo), min(xb, lo + cell - 1)
                        rows.append(_cell(k1, k2, a - yb, ya, yb, lo, body[a - lo : a - hi + span], body[a - yb : a - lo], body[a - hi + span : a - ya + span], s["copies"]))
                yield _cells(rows)

    return met.mapInArrow(cut, _CELLS)


def halves(cells: DataFrame, size: int) -> DataFrame:
    """Cells of ``size`` windows as cells of half the size, with half of the sides taken into the core."""
    half = size // 2

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                lo, mid, hi, ya, yb, before, behind = r["lo"], r["lo"] + half, r["lo"] + size - 1, r["ya"], r["yb"], r["before"], r["behind"]
                core = r["c1"].to_bytes(8, "little", signed=True) + r["c2"].to_bytes(8, "little", signed=True)
                if ya < mid:
                    y = min(yb, mid - 1)
                    rows.append(_cell(r["k1"], r["k2"], r["first"] + yb - y, ya, y, lo, b"0" + core + behind[:half], before[len(before) - (y - lo) :], behind[half:], r["copies"]))
                if yb >= mid:
                    y = max(ya, mid)
                    rows.append(_cell(r["k1"], r["k2"], r["first"], y, yb, mid, b"1" + core + before[len(before) - half :], before[: len(before) - half], behind[: hi - y], r["copies"]))
            yield _cells(rows)

    return cells.select(*_NAMES).mapInArrow(cut, _CELLS)


def suffix_array(text: np.ndarray) -> np.ndarray:
    """By doubling; the text's separators differ, so the ranks part within the longest piece."""
    _, rank = np.unique(text, return_inverse=True)
    n, step = len(text), 1
    while True:
        behind = np.zeros(n, np.int64)
        behind[:-step] = rank[step:] + 1
        key = rank * (n + 1) + behind
        order = np.argsort(key, kind="stable")
        ranked = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.append(0, np.cumsum(ranked[1:] != ranked[:-1]))
        if rank[order[-1]] == n - 1:
            return order
        step *= 2


class RunLengthIndex:
    """Run-compressed Burrows-Wheeler transform of a text, with the suffix positions at both ends of each run."""

    def __init__(self, text: np.ndarray):
        order = suffix_array(text)
        bwt = text[order - 1]
        cut = np.flatnonzero(bwt[1:] != bwt[:-1])
        self.text = text
        first, last = order[np.append(0, cut + 1)], order[np.append(cut, len(text) - 1)]
        # A run's first suffix matches the last one of the run before it; a run's last suffix the first one of the run behind it.
        self.above = self._samples(first[1:], last[:-1], first[0])
        self.below = self._samples(last[:-1], first[1:], last[-1])

    def _samples(self, here: np.ndarray, there: np.ndarray, alone: int) -> tuple[np.ndarray, np.ndarray]:
        """Sampled positions in text order and how far each matches its neighbour."""
        length, live, n = np.zeros(len(here), np.int64), np.arange(len(here)), len(self.text)
        while len(live):
            i, j = here[live] + length[live], there[live] + length[live]
            inside = (i < n) & (j < n)
            live, i, j = live[inside], i[inside], j[inside]
            same = self.text[i] == self.text[j]
            live = live[same]
            length[live] += 1
        at, length = np.append(here, alone), np.append(length, 0)
        by = np.argsort(at)
        return at[by], length[by]

    def matching_statistics(self) -> np.ndarray:
        """For every position, the longest match that starts there and also starts elsewhere."""
        place = np.arange(len(self.text))
        best = np.zeros(len(self.text), np.int64)
        for at, length in (self.above, self.below):
            sample = np.searchsorted(at, place, side="right") - 1
            have = sample >= 0
            best[have] = np.maximum(best[have], length[sample[have]] - (place[have] - at[sample[have]]))
        return best


def mark(cores: np.ndarray, before: list[bytes], behind: list[bytes], widths: np.ndarray, size: int) -> list[np.ndarray]:
    """For each cell, which of its ``widths`` windows (from the leftmost) also are in another cell."""
    parts = []
    for i, (core, left, right) in enumerate(zip(cores.tolist(), before, behind, strict=True)):
        parts += [np.frombuffer(left, np.uint8), np.array([256 + core, -1 - i]), np.frombuffer(right, np.uint8)]
    text, starts, at = np.empty(sum(map(len, parts)), np.int64), np.empty(len(before), np.int64), 0
    for i in range(len(before)):
        left, (core, end), right = parts[3 * i : 3 * i + 3]
        starts[i] = at
        text[at : at + len(left)] = left
        at += len(left)
        text[at] = core
        text[at + 1 : at + 1 + len(right)] = right
        at += 1 + len(right)
        text[at] = end
        at += 1
    found = RunLengthIndex(text).matching_statistics() >= size
    return [found[s : s + w] for s, w in zip(starts.tolist(), widths.tolist(), strict=True)]


def indexed_spans(classes: DataFrame, size: int, span: int = SPAN, batch_rows: int = BATCH) -> DataFrame:
    """k1, k2, from, to: the repeated windows of the open cells; each group of a core (c1, c2) is in one batch."""
    names = ["c1", "c2", "k1", "k2", "first", "ya", "yb", "before", "behind", "total"]
    laid = classes.select(*names).repartition("c1", "c2").sortWithinPartitions("c1", "c2")

    def spans(rows: pa.Table) -> pa.RecordBatch:
        c1, c2, k1, k2, first, ya, yb, total = (rows.column(c).to_numpy() for c in ("c1", "c2", "k1", "k2", "first", "ya", "yb", "total"))
        core = np.append(0, np.cumsum((c1[1:] != c1[:-1]) | (c2[1:] != c2[:-1])))
        marks = mark(core, rows.column("before").to_pylist(), rows.column("behind").to_pylist(), yb - ya + 1, size)
        out = []
        for i in np.flatnonzero(total == 1).tolist():
            hit = np.flatnonzero(np.diff(np.concatenate([[False], marks[i], [False]]).astype(np.int8)))
            out += [(k1[i], k2[i], first[i] + a, first[i] + b - 1 + span) for a, b in zip(hit[::2].tolist(), hit[1::2].tolist(), strict=True)]
        cols = list(zip(*out, strict=True)) or [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["k1", "k2", "from", "to"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def settle(last: bool) -> Iterator[pa.RecordBatch]:
            rows = pa.Table.from_batches(held)
            c1, c2 = rows.column("c1").to_numpy(), rows.column("c2").to_numpy()
            ends = np.append(np.flatnonzero((c1[1:] != c1[:-1]) | (c2[1:] != c2[:-1])) + 1, len(c1) if last else [])
            start = 0
            while len(ends) and start < ends[-1]:
                fits = ends[(ends > start) & (ends <= start + batch_rows)]
                stop = int(fits[-1] if len(fits) else ends[ends > start][0])
                yield spans(rows.slice(start, stop - start))
                start = stop
            held[:] = rows.slice(start).to_batches()

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= batch_rows:
                yield from settle(False)
        if any(b.num_rows for b in held):
            yield from settle(True)

    return laid.mapInArrow(run, "k1 long, k2 long, from long, to long")


def keyed(docs: DataFrame) -> DataFrame:
    body = text_bytes()
    return docs.select(*(F.xxhash64(F.lit(n), "doc_id", F.xxhash64(body), F.octet_length(body)).alias(f"k{n}") for n in (1, 2)), "doc_id", body.alias("body"))


def repeated_spans(docs: DataFrame, span: int = SPAN, gram: int = GRAM, cell: int = CELL, group: int = GROUP) -> DataFrame:
    """k1, k2, from, to: byte ranges, which may overlap, that cover just the bytes of repeated windows of the documents (:func:`keyed`)."""
    paths: list[str] = []
    every = stored(find_stretches(docs, span, gram), paths)
    inside = every.where("copies = 0").select("k1", "k2", F.col("first").alias("from"), (F.col("last") + span).alias("to"))
    some = every.where("copies > 0")
    shared = some.groupBy("h").agg(F.sum("copies").alias("n"), F.min("f").alias("f0"), F.max("f").alias("f1")).where("n > 1").select("h", (F.col("f0") != F.col("f1")).alias("mixed"))
    kept = stored(some.join(shared, "h"), paths)
    columns = ["k1", "k2", "first", "last", "at"]
    classes = kept.groupBy("h", "f", "mixed").agg(F.sum("copies").alias("n"), *(F.first(c).alias(c) for c in columns))
    equal = kept.join(classes.where("n > 1").select("h", "f"), ["h", "f"])
    spans = [inside, equal.select("k1", "k2", F.col("first").alias("from"), (F.col("last") + span).alias("to"))]
    cells, size = cells_of_stretches(docs, classes.where("mixed").select(*columns, F.col("n").alias("copies")), span, cell), cell
    while True:
        cells = stored(cells, paths)
        shared = cells.groupBy("c1", "c2").agg(F.sum("copies").alias("n"), F.min("g").alias("g0"), F.max("g").alias("g1")).where("n > 1").select("c1", "c2", (F.col("g0") != F.col("g1")).alias("mixed"))
        kept = stored(cells.join(shared, ["c1", "c2"]), paths)
        others = [c for c in _NAMES if c not in ("c1", "c2", "g", "copies")]
        classes = kept.groupBy("c1", "c2", "g", "mixed").agg(F.sum("copies").alias("total"), *(F.first(c).alias(c) for c in others))
        equal = kept.where("copies = 1").join(classes.where("total > 1").select("c1", "c2", "g"), ["c1", "c2", "g"])
        spans.append(equal.select("k1", "k2", F.col("first").alias("from"), (F.col("first") + F.col("yb") - F.col("ya") + span).alias("to")))
        classes = classes.where("mixed").drop("mixed")
        groups = classes.groupBy("c1", "c2").agg(F.count("*").alias("m"), F.min("total").alias("least")).where("least = 1").drop("least")
        classes = stored(classes.join(groups, ["c1", "c2"]), paths)
        spans.append(indexed_spans(classes.where(F.col("m") <= group), size, span))
        large = classes.where(F.col("m") > group)
        if size == 1 or large.isEmpty():
            break
        cells, size = halves(large.withColumnRenamed("total", "copies"), size), size // 2
    out = spans[0]
    for more in spans[1:]:
        out = out.unionByName(more)
    found = stored(out)
    discard(docs.sparkSession, paths)
    return found


def remove_repeats(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, removed (the maximal runs, from and to) and kept (the bytes left) for every row."""
    rows = keyed(docs)
    lists = repeated_spans(rows, **options).groupBy("k1", "k2").agg(F.collect_list(F.struct("from", "to")).alias("spans"))
    joined = rows.join(lists, ["k1", "k2"], "left").select("doc_id", "body", "spans")
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                out = [_cut_out(*row) for row in zip(*(part.column(c).to_pylist() for c in (1, 2)), strict=True)]
                cols = list(zip(*out, strict=True))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())])), pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "removed", "kept"])

    return joined.mapInArrow(cut, f"doc_id {id_type}, n_bytes long, n_removed long, n_spans long, removed array<struct<from: long, to: long>>, kept binary")


def _runs(spans: list[dict] | None) -> list[list[int]]:
    """The spans as maximal runs."""
    runs: list[list[int]] = []
    for s in sorted((s["from"], s["to"]) for s in spans or ()):
        if runs and s[0] <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], s[1])
        else:
            runs.append(list(s))
    return runs


def _cut_out(body: bytes, spans: list[dict] | None) -> tuple:
    runs, left, at = _runs(spans), [], 0
    for a, b in runs:
        left.append(body[at:a])
        at = b
    kept = b"".join([*left, body[at:]])
    return len(body), len(body) - len(kept), len(runs), [{"from": a, "to": b} for a, b in runs], kept


def op2_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2(F.col("kept"), 256).alias("kept_sha256"))


QUERIES = {"op2_substrings": op2_substrings}
