"""SimHash near-dedup by bit-sliced comparison.

Fingerprint: the bitwise majority over the XXH64 hashes of a text's word shingles. Equal fingerprints are one
class. Two fingerprints within ``radius`` bits agree on two of five blocks of bits, so classes meet in
buckets keyed by each pair of blocks. Inside a bucket the fingerprints are stored as bit planes, 64
lanes to a machine word; carry-save counters add up all lanes' differing bits at once and a block is
abandoned as soon as all its lanes exceed the radius. A bucket sends on a spanning forest of its links, never all pairs, and
a bucket beyond ``BUCKET`` rows is split into tiles compared pairwise in tasks of their own, so that n distinct fingerprints that share 26 bits take
n squared / 2 comparisons of bits, spread over tasks of ``BUCKET`` rows a side (copies of one fingerprint are one row).

Edge cases: a null or empty text (or white space alone) has fingerprint 0, which links like any other; fewer
words than a shingle hash as the whole sequence. A very long text is hashed whole. A bit set in exactly half of the hashes is 0. Repeated rows share a class. A null doc_id gets a fingerprint
and a component, and counts as the largest id. An empty table gives no rows. Columns besides ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from touchline.llm.common import checkpoint, free_names, row_key, table, text_bytes
from touchline.llm.components import connected_components

SHINGLE = 3
SEED = 42
RADIUS = 3
#: (first bit, width) of the blocks; a pair of fingerprints within RADIUS bits agrees on two of them.
BLOCKS = [(0, 13), (13, 13), (26, 13), (39, 13), (52, 12)]
#: Rows of a bucket that one task compares; larger ones are split into tiles of this size.
BUCKET = 4096
LANES = 64
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Planes added between two looks at which blocks are still within the radius.
STRIDE = 8


def shingle_hashes(text: bytes, size: int = SHINGLE, seed: int = SEED) -> list[int]:
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    if not words:
        return []
    if len(words) <= size:
        return [xxh64_intdigest(b" ".join(words), seed)]
    return list(map(xxh64_intdigest, map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False)), repeat(seed)))


def majority(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each run of hashes, the bits set in over half of them."""
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    counts = np.diff(np.append(starts, len(hashes)))
    sums = np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
    return np.packbits(2 * sums > counts[:, None], axis=1, bitorder="little").view("<u8").ravel()


def fingerprints(docs: DataFrame, size: int = SHINGLE, seed: int = SEED, carry: list[Column] | None = None) -> DataFrame:
    """doc_id (or the columns ``carry``) and fp (the fingerprint's 64 bits as a long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                found = [shingle_hashes(t, size, seed) for t in part.column(part.num_columns - 1).to_pylist()]
                out = np.zeros(len(found), np.uint64)
                full = [i for i, h in enumerate(found) if h]
                if full:
                    lengths = np.array([len(found[i]) for i in full])
                    flat = np.fromiter((h for i in full for h in found[i]), np.uint64, lengths.sum())
                    out[full] = majority(flat, np.cumsum(lengths) - lengths)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(out.view(np.int64))], names=[*part.schema.names[:-1], "fp"])

    rows = docs.select(*(carry or [F.col("doc_id")]), text_bytes().alias("__bytes"))
    return rows.mapInArrow(run, StructType(rows.schema.fields[:-1]).add("fp", LongType()))


def bucket_keys(fp: Column) -> Column:
    """One key for each pair of blocks: the pair's number and its bits."""
    keys = []
    for i in range(len(BLOCKS)):
        for j in range(i + 1, len(BLOCKS)):
            (a, m), (b, n) = BLOCKS[i], BLOCKS[j]
            left = F.shiftrightunsigned(fp, a).bitwiseAND(F.lit((1 << m) - 1))
            right = F.shiftrightunsigned(fp, b).bitwiseAND(F.lit((1 << n) - 1))
            keys.append(F.lit(len(keys)) * (1 << 40) + left * (1 << 20) + right)
    return F.array(*keys)


def bit_planes(values: np.ndarray) -> np.ndarray:
    """(64, blocks): bit b of 64 consecutive values as one word, padded with zeros."""
    padded = np.zeros(-(-len(values) // LANES) * LANES, np.uint64)
    padded[: len(values)] = values
    bits = np.unpackbits(padded.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view("<u8")


def lanes_within(queries: np.ndarray, planes: np.ndarray, blocks: np.ndarray, lanes: np.ndarray, radius: int) -> np.ndarray:
    """For query i, which of ``lanes[i]`` of block ``blocks[i]`` differ from it in at most ``radius`` bits (radius < 4)."""
    hits = np.zeros(len(queries), np.uint64)
    alive = np.flatnonzero(lanes)
    ones = np.zeros(len(alive), np.uint64)
    twos, over = ones.copy(), ~lanes[alive]
    for first in range(0, 64, STRIDE):
        value, where = queries[alive], blocks[alive]
        for b in range(first, first + STRIDE):
            differs = planes[b, where] ^ (ALL * (value >> np.uint64(b) & np.uint64(1)))
            carry = ones & differs
            ones ^= differs
            over |= twos & carry
            twos ^= carry
        if radius < 3:
            done = over | (twos & ones if radius == 2 else twos if radius == 1 else twos | ones)
        else:
            done = over
        keep = done != ALL
        if first + STRIDE == 64:
            hits[alive] = ~done
        elif not keep.all():
            alive, ones, twos, over = alive[keep], ones[keep], twos[keep], over[keep]
        if not len(alive):
            break
    return hits


def low_lanes(n: np.ndarray) -> np.ndarray:
    """Words whose lanes below n (0 to 64) are set."""
    return np.where(n >= LANES, ALL, (np.uint64(1) << np.minimum(n, LANES - 1).astype(np.uint64)) - np.uint64(1))


def forest(groups: np.ndarray, values: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """For rows sorted by group, the index of each row's root among the rows linked within its group."""
    n = len(values)
    root, index = np.arange(n), np.arange(n)
    if n < 2:
        return root
    new = np.flatnonzero(np.append(groups[1:] != groups[:-1], True)) + 1
    end = np.repeat(new, np.diff(np.append(0, new)))
    planes, block = bit_planes(values), index // LANES
    rows, offset = index[end - index > 1], 0
    while len(rows):
        at = block[rows] + offset
        rows, at = rows[at * LANES < end[rows]], at[at * LANES < end[rows]]
        low = np.clip(rows + 1 - at * LANES, 0, LANES)
        high = np.clip(end[rows] - at * LANES, 0, LANES)
        for s in range(0, len(rows), 1 << 17):
            part = slice(s, s + (1 << 17))
            hit = lanes_within(values[rows[part]], planes, at[part], low_lanes(high[part]) & ~low_lanes(low[part]), radius)
            some = np.flatnonzero(hit)
            for t in range(0, len(some), 1 << 13):
                pick = some[t : t + (1 << 13)]
                i, lane = np.nonzero(np.unpackbits(hit[pick].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
                _unite(root, rows[part][pick][i], at[part][pick][i] * LANES + lane)
        offset += 1
    return root


def _unite(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    while True:
        a, b = root[i], root[j]
        apart = a != b
        if not apart.any():
            return
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root[:] = up


def fingerprint_links(classes: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """a, b: links that join the classes (one row per distinct fp) exactly as all pairs within the radius would."""
    if not 0 <= radius <= 3:
        raise ValueError("the blocks serve a radius of 0 to 3")
    keyed = classes.select(F.explode(bucket_keys(F.col("fp"))).alias("key"), "fp")
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    tiles = F.ceil(F.col("n") / bucket).cast("int")
    keyed = keyed.join(sizes, "key").withColumn("tiles", tiles).withColumn("tile", F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int"))
    # A row meets every tile of its bucket once: as (tile, other) for each other tile, or (0, 0) in a bucket of one tile.
    others = F.expr("transform(sequence(0, tiles - 1), t -> struct(least(t, tile) as lo, greatest(t, tile) as hi))")
    spread = keyed.select("key", "fp", F.explode(others).alias("pair")).select("key", "pair.lo", "pair.hi", "fp")
    spread = spread.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "fp")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None

        def links(rows: np.ndarray) -> pa.RecordBatch:
            change = (rows[1:, :3] != rows[:-1, :3]).any(axis=1)
            groups, values = np.append(0, np.cumsum(change)), rows[:, 3].view(np.uint64)
            root = forest(groups, values, radius)
            linked = np.flatnonzero(root != np.arange(len(root)))
            pairs = np.unique(np.stack([rows[linked, 3], rows[root[linked], 3]], 1), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

        for batch in batches:
            rows = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns], 1)
            if not len(rows):
                continue
            rows = rows if held is None else np.concatenate([held, rows])
            last = np.flatnonzero((rows[:, :3] != rows[-1, :3]).any(axis=1))
            cut = last[-1] + 1 if len(last) else 0
            held = rows[cut:]
            if cut:
                yield links(np.ascontiguousarray(rows[:cut]))
        if held is not None and len(held):
            yield links(np.ascontiguousarray(held))

    return spread.mapInArrow(compare, "a long, b long")


def class_roots(prints: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """fp, root: one root for all fingerprints that links join."""
    classes = prints.select("fp").distinct()
    roots = connected_components(fingerprint_links(classes, radius, bucket))
    return classes.join(roots, classes.fp == roots.node, "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, radius: int = RADIUS, bucket: int = BUCKET, size: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id, fp, component_id (smallest doc_id reachable) for every row."""
    prints = checkpoint(fingerprints(docs, size, seed))
    joined = prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")).join(class_roots(prints, radius, bucket), "fp")
    smallest = joined.groupBy("root").agg(F.min("first_id").alias("component_id"))
    labels = joined.join(smallest, "root").select("fp", "component_id")
    return prints.join(labels, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, radius: int = RADIUS, bucket: int = BUCKET, size: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """Of each group the document of the smallest doc_id (nulls last, then the smallest text hash), with its columns."""
    prints = checkpoint(fingerprints(docs, size, seed, carry=row_key()))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash", "text_bytes"))
    of_class = prints.groupBy("fp").agg(first.alias("first")).join(class_roots(prints, radius, bucket), "fp")
    names = free_names(docs, "c_id", "c_hash", "c_bytes")
    chosen = of_class.groupBy("root").agg(F.min("first").alias("first")).select(*(F.col(f"first.{c}").alias(n) for c, n in zip(("doc_id", "text_hash", "text_bytes"), names, strict=True)))
    key = row_key()
    kept = docs.join(chosen, key[0].eqNullSafe(F.col(names[0])) & (key[1] == F.col(names[1])) & (key[2] == F.col(names[2])))
    return kept.dropDuplicates(names).select(*docs.columns)


def hex_fingerprint(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")


QUERIES = {"op10_simhash": op10_simhash}
