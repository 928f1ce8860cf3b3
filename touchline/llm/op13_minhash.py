"""MinHash near-dedup by a multi-index Hamming join over b-bit signatures.

A document's set is that of its distinct word shingles, as 64-bit hashes. Equal sets are one class from the start, so copies are never compared. A class has a signature of
``SYMBOLS`` minhash values cut to ``BITS`` bits. The signature is split into ``CHUNKS`` chunks; two signatures that differ in at most ``THRESHOLD`` symbols differ, by
pigeonhole, in at most ``ERRORS`` symbols of some chunk. Each class therefore enumerates, for every chunk, the keys that an allowed error leaves (the chunk without one of its symbols), and
all pairs within the threshold meet in a bucket. At a similarity of 0.85, one pair in 5e7 meets nowhere (every chunk would have to differ in two symbols or more).

A pair belongs to the bucket of the first key that its signatures share. There it is held against the signature distance and two exact bounds on the similarity: the ratio of the set sizes, and the bits
in which the sets' parity sketches differ, as these are never more than the elements that are in one set only. A bucket emits a spanning forest of its
own pairs that are left, lightest edges first, not the pairs. Each edge is then confirmed on the full sets. Where a forest edge fails and its ends stay apart, the bucket is opened again in the next round, without the refuted
pairs and what is connected by now, and each class asks ``MORE`` of its nearest partners, then ``MORE`` times as many, then all. The rounds end when no bucket has an edge left to ask for; then every
pair that passes in a bucket is either confirmed, refuted or within one component.

A bucket beyond ``BUCKET`` rows is cut into tiles compared pairwise in tasks of their own, so n distinct sets in one bucket take at most n squared / 2 comparisons of signatures,
spread over tasks of ``BUCKET`` rows a side. Only classes that have an edge get their full sets, from one further pass over the texts.

Edge cases: a null or empty text, or white space alone, has the empty set, which links with nothing. Fewer words than a shingle are one shingle. A very long text is hashed whole. Repeated
rows share a class. A null doc_id gets the component of its class and counts as the largest id; its component is null if no id is in reach, and it is kept if so. Ties go to the smallest doc_id. An empty
table gives no rows. Columns besides ``doc_id`` and ``text`` are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.llm.common import discard, row_key, stored, table, text_bytes
from touchline.llm.components import connected_components

SHINGLE = 3
#: Pairs link at 100 * intersection >= PERCENT * union.
PERCENT = 85
CHUNKS, WIDTH, ERRORS, BITS = 8, 4, 1, 16
SYMBOLS = CHUNKS * WIDTH
#: Signature distance up to which all pairs meet.
THRESHOLD = CHUNKS * (ERRORS + 1) - 1
#: Pairs that meet are looked at up to this distance; beyond it lies one pair of similarity 0.85 in 1e8.
FARTHEST = THRESHOLD + 3
SKETCH_WORDS = 8
BUCKET = 2048
#: From the second round on a row asks so many of its nearest partners, and so many times as many in each round that follows.
MORE = 64
#: A table of up to so many rows (an id and two numbers each, 40 MB at most) may be broadcast.
BROADCAST_ROWS = 500_000
SEED = 13

_rng = np.random.default_rng(SEED)
MULTIPLIERS = _rng.integers(1, 1 << 63, SYMBOLS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
MASKS = _rng.integers(0, 1 << 63, SYMBOLS, dtype=np.uint64)
#: For each kept combination of a chunk's symbols, their places.
KEPT = list(combinations(range(WIDTH), WIDTH - ERRORS))


def shingle_set(text: bytes, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    grams = [b" ".join(words)] if len(words) < size else map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False))
    return np.unique(np.fromiter(map(xxh64_intdigest, grams), np.uint64))


def signatures(flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """(sets, SYMBOLS) uint16: low bits of the least permuted hash of each run of ``flat``."""
    out = np.empty((len(starts), SYMBOLS), np.uint16)
    for k in range(SYMBOLS):
        out[:, k] = np.minimum.reduceat((flat ^ MASKS[k]) * MULTIPLIERS[k], starts).astype(np.uint16)
    return out


def parity_sketch(hashes: np.ndarray) -> np.ndarray:
    """One bit for each of 64 * SKETCH_WORDS bins: whether an odd number of elements falls in it."""
    bins = np.bincount((hashes >> np.uint64(20)).astype(np.int64) % (64 * SKETCH_WORDS), minlength=64 * SKETCH_WORDS)
    return np.packbits((bins & 1).astype(np.uint8), bitorder="little")


def prints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """The row's key, n, and for sets with elements: c (128-bit hash of the set), sig, sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                sets = [shingle_set(t.as_py(), size) for t in part.column(part.num_columns - 1)]
                counts = np.array([len(s) for s in sets])
                full = np.flatnonzero(counts)
                ids, sigs, sketches = ([None] * len(sets) for _ in range(3))
                if len(full):
                    lengths = counts[full]
                    found = signatures(np.concatenate([sets[i] for i in full]), np.cumsum(lengths) - lengths)
                    for i, sig in zip(full, found, strict=True):
                        ids[i], sigs[i], sketches[i] = xxh3_128_digest(sets[i].tobytes()), sig.tobytes(), parity_sketch(sets[i]).tobytes()
                made = [pa.array(counts, pa.int64()), *(pa.array(x, pa.binary()) for x in (ids, sigs, sketches))]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *made], names=[*part.schema.names[:-1], "n", "c", "sig", "sketch"])

    rows = docs.select(*row_key(), text_bytes().alias("__bytes"))
    return rows.mapInArrow(run, "doc_id " + rows.schema["doc_id"].dataType.simpleString() + ", text_hash long, text_bytes long, n long, c binary, sig binary, sketch binary")


def fixed(column: pa.Array, dtype: type, width: int) -> np.ndarray:
    """A column of byte strings of one length as a matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(-1, width)


def bucket_keys(classes: DataFrame) -> DataFrame:
    """key, c: CHUNKS * len(KEPT) rows for each class; the key is the chunk, which symbols stay, and those symbols."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sig = fixed(batch.column(1), np.uint16, SYMBOLS).astype(np.int64)
            for chunk in range(CHUNKS):
                for k, places in enumerate(KEPT):
                    key = np.full(len(sig), chunk * len(KEPT) + k, np.int64)
                    for p in places:
                        key = key << BITS | sig[:, chunk * WIDTH + p]
                    yield pa.RecordBatch.from_arrays([pa.array(key), batch.column(0)], names=["key", "c"])

    return classes.select("c", "sig").mapInArrow(run, "key long, c binary")


def differing_bits(percent: int, sizes: np.ndarray) -> np.ndarray:
    """The most elements that may be in one set only, for linked sets of so many elements together."""
    return (100 - percent) * sizes // (100 + percent)


def first_common_key(equal: np.ndarray) -> np.ndarray:
    """For each pair, given which symbols are equal, the number of the first kind of key that both have."""
    chunks = equal.reshape(-1, CHUNKS, WIDTH)
    shared = np.stack([chunks[:, :, list(places)].all(axis=2) for places in KEPT], axis=2)
    return shared.reshape(-1, CHUNKS * len(KEPT)).argmax(axis=1)


def passing_pairs(group: np.ndarray, kind: np.ndarray, tile: np.ndarray, crossing: np.ndarray, n: np.ndarray, sig: np.ndarray, sketch: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """i, j, distance of the pairs of one group that no bound rules out; rows come sorted by group and then by n.

    A pair belongs to the bucket of its first common key (``kind`` is the number of a group's key) and is passed over in all others.
    """
    total = len(group)
    new = np.flatnonzero(np.append(group[1:] != group[:-1], True)) + 1
    end = np.repeat(new, np.diff(np.append(0, new)))
    rows, offset, found = np.arange(total), 1, []
    while len(rows):
        rows = rows[rows + offset < end[rows]]
        rows = rows[100 * n[rows] >= percent * n[rows + offset]]  # sizes rise, so a row whose partner is too large is done
        for s in range(0, len(rows), 1 << 15):
            i = rows[s : s + (1 << 15)]
            i = i[~crossing[i] | (tile[i] != tile[i + offset])]
            j = i + offset
            apart = np.bitwise_count(sketch[i] ^ sketch[j]).sum(axis=1, dtype=np.int64)
            ok = apart <= differing_bits(percent, n[i] + n[j])
            i, j = i[ok], j[ok]
            far = (sig[i] != sig[j]).sum(axis=1)
            ok = far <= FARTHEST
            i, j, far = i[ok], j[ok], far[ok]
            own = first_common_key(sig[i] == sig[j]) == kind[i]
            found.append((i[own], j[own], far[own]))
        offset += 1
    if not found:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def forest_edges(i: np.ndarray, j: np.ndarray, weight: np.ndarray, comp: np.ndarray) -> np.ndarray:
    """Indices of edges that join all that the edges join, lightest first; ``comp`` gives the start and is updated."""
    chosen = []
    for level in np.unique(weight):
        edges = np.flatnonzero(weight == level)
        while len(edges):
            a, b = comp[i[edges]], comp[j[edges]]
            apart = a != b
            edges, a, b = edges[apart], a[apart], b[apart]
            if not len(edges):
                break
            high, low = np.maximum(a, b), np.minimum(a, b)
            hook, first = np.unique(high, return_index=True)
            chosen.append(edges[first])
            parent = np.arange(len(comp))
            parent[hook] = low[first]
            while (parent[parent] != parent).any():
                parent = parent[parent]
            comp[:] = parent[comp]
    return np.concatenate(chosen) if chosen else np.zeros(0, np.int64)


def nearest_asked(i: np.ndarray, j: np.ndarray, weight: np.ndarray, comp: np.ndarray, asked: int) -> np.ndarray:
    """Indices of the ``asked`` lightest edges of each row that is in the smaller component of its edge."""
    sizes = np.bincount(comp, minlength=len(comp))
    asker = np.where(sizes[comp[i]] <= sizes[comp[j]], i, j)
    order = np.lexsort((weight, asker))
    run = asker[order]
    start = np.flatnonzero(np.append(True, run[1:] != run[:-1]))
    rank = np.arange(len(order)) - np.repeat(start, np.diff(np.append(start, len(order))))
    return order[rank < asked]


def candidate_edges(rows: DataFrame, percent: int, asked: int) -> DataFrame:
    """key, lo, hi, a, b: edges worth a look on the full sets, for rows of key, lo, hi, n, tile, c, root, sig, sketch, refuted."""
    rows = rows.select("key", "lo", "hi", "n", "tile", "c", "root", "sig", "sketch", "refuted")
    rows = rows.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "n")

    def edges(part: pa.Table) -> pa.RecordBatch:
        whole = part.combine_chunks()
        col = {name: whole.column(name).combine_chunks() for name in whole.schema.names}
        unit = np.stack([col[k].to_numpy().astype(np.int64) for k in ("key", "lo", "hi")], 1)
        group = np.append(0, np.cumsum((unit[1:] != unit[:-1]).any(axis=1)))
        n, tile, sig = col["n"].to_numpy(), col["tile"].to_numpy(), fixed(col["sig"], np.uint16, SYMBOLS)
        kind = unit[:, 0] >> (BITS * (WIDTH - ERRORS))
        i, j, far = passing_pairs(group, kind, tile, unit[:, 1] != unit[:, 2], n, sig, fixed(col["sketch"], np.uint64, SKETCH_WORDS), percent)
        root = fixed(col["root"], np.uint64, 2)
        # Rows of one group that are connected already start in one component.
        _, comp = np.unique(np.column_stack([group.astype(np.uint64), root]), axis=0, return_inverse=True)
        comp = comp.reshape(-1)
        open_ = comp[i] != comp[j]
        if col["refuted"].null_count < len(group):
            names = col["c"].to_pylist()
            refuted = {(names[k], x) for k, known in enumerate(col["refuted"].to_pylist()) for x in known or ()}
            open_ &= np.array([(names[a], names[b]) not in refuted and (names[b], names[a]) not in refuted for a, b in zip(i.tolist(), j.tolist(), strict=True)], bool)
        i, j, far = i[open_], j[open_], far[open_]
        more = nearest_asked(i, j, far, comp, asked) if asked and len(i) else np.zeros(0, np.int64)
        take = np.union1d(forest_edges(i, j, far, comp), more)
        a, b = (col["c"].take(pa.array(x[take])) for x in (i, j))
        return pa.RecordBatch.from_arrays([*(pa.array(unit[i[take], k], (pa.int64(), pa.int32(), pa.int32())[k]) for k in range(3)), a, b], names=["key", "lo", "hi", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            unit = np.stack([batch.column(k).to_numpy().astype(np.int64) for k in range(3)], 1)
            others = np.flatnonzero((unit != unit[-1]).any(axis=1))
            cut = int(others[-1]) + 1 if len(others) else 0
            if not cut and (last is None or (last == unit[-1]).all()):
                held.append(batch)  # still the same group
            else:
                yield edges(pa.Table.from_batches([*held, batch.slice(0, cut)] if cut else held))
                held = [batch.slice(cut)]
            last = unit[-1]
        if held:
            yield edges(pa.Table.from_batches(held))

    return rows.mapInArrow(run, "key long, lo int, hi int, a binary, b binary")


def full_sets(docs: DataFrame, needed: DataFrame, size: int) -> DataFrame:
    """c, elements: the sets of the classes ``needed`` (c and the key of a row that has the set), from the texts."""
    if needed.count() <= BROADCAST_ROWS:
        needed = F.broadcast(needed)
    key = row_key()
    rows = docs.select(*key, text_bytes().alias("text"))
    met = rows.join(needed, rows.doc_id.eqNullSafe(F.col("r_id")) & (rows.text_hash == F.col("r_hash")) & (rows.text_bytes == F.col("r_bytes")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([shingle_set(t.as_py(), size).tobytes() for t in part.column(1)], pa.binary())], names=["c", "elements"])

    return met.select("c", "text").mapInArrow(run, "c binary, elements binary")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (key, lo, hi, a, b) and linked: each held against its full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for x, y in zip(batch.column(0), batch.column(1), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                small, large = (x, y) if len(x) < len(y) else (y, x)
                at = np.minimum(np.searchsorted(large, small), len(large) - 1)
                both = int((large[at] == small).sum())
                linked.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([*batch.columns[2:], pa.array(linked, pa.bool_())], names=[*batch.schema.names[2:], "linked"])

    left, right = (sets.select(F.col("c").alias(k), F.col("elements").alias(f"set_{k}")) for k in ("a", "b"))
    rows = pairs.join(left, "a").join(right, "b").select("set_a", "set_b", "key", "lo", "hi", "a", "b")
    return rows.mapInArrow(run, "key long, lo int, hi int, a binary, b binary, linked boolean")


def class_links(docs: DataFrame, classes: DataFrame, paths: list[str], percent: int = PERCENT, size: int = SHINGLE, bucket: int = BUCKET) -> DataFrame | None:
    """c, root for every class that links with another (None if none does): components of all confirmed links."""
    keyed = bucket_keys(classes)
    sizes = keyed.groupBy("key").agg(F.count("*").alias("rows")).where("rows > 1")
    tiled = keyed.join(sizes, "key").withColumn("tiles", F.ceil(F.col("rows") / bucket).cast("int"))
    tiled = tiled.withColumn("tile", F.pmod(F.xxhash64("c"), F.col("tiles")).cast("int"))
    units = F.expr("transform(sequence(0, tiles - 1), t -> struct(least(t, tile) as lo, greatest(t, tile) as hi))")
    spread = stored(tiled.select("key", "tile", "c", F.explode(units).alias("unit")).select("key", "unit.lo", "unit.hi", "tile", "c"), paths)
    shown = classes.select("c", "n", "sig", "sketch")
    roots, refuted, sets, links, asked = None, None, None, None, 0
    while True:
        rows = spread.join(shown, "c")
        if roots is None:
            rows = rows.withColumn("root", F.col("c"))
        else:
            rows = rows.join(roots, "c", "left").withColumn("root", F.coalesce("root", "c"))
        if refuted is None:
            rows = rows.withColumn("refuted", F.lit(None).cast("array<binary>"))
        else:
            rows = rows.join(refuted.groupBy("key", "lo", "hi", F.col("a").alias("c")).agg(F.collect_list("b").alias("refuted")), ["key", "lo", "hi", "c"], "left")
        edges = stored(candidate_edges(rows, percent, asked), paths)
        if sets is None:
            ends = edges.select(F.col("a").alias("c")).union(edges.select("b")).distinct()
            needed = ends.join(classes, "c").select("c", F.col("rep.doc_id").alias("r_id"), F.col("rep.text_hash").alias("r_hash"), F.col("rep.text_bytes").alias("r_bytes"))
            sets = stored(full_sets(docs, needed, size), paths)
        told = stored(confirmed(edges, sets, percent).distinct(), paths)
        good, bad = told.where("linked").select("a", "b"), told.where("not linked").drop("linked")
        links = good if links is None else links.union(good)
        refuted = bad if refuted is None else refuted.union(bad)
        if told.isEmpty():
            return roots
        every = asked >= 2 * bucket  # no row has more partners in its unit: each pair that was open has been asked for
        roots = stored(connected_components(links).select(F.col("node").alias("c"), "root"), paths)
        if every:
            return roots
        far = bad.join(roots.toDF("a", "root_a"), "a", "left").join(roots.toDF("b", "root_b"), "b", "left")
        far = far.where(~F.coalesce("root_a", "a").eqNullSafe(F.coalesce("root_b", "b")))
        still = stored(far.select("key", "lo", "hi").distinct(), paths)
        if still.isEmpty():
            return roots
        spread = stored(spread.join(still, ["key", "lo", "hi"], "left_semi"), paths)
        asked = max(MORE, asked * MORE)


def near_duplicates(docs: DataFrame, percent: int = PERCENT, size: int = SHINGLE, bucket: int = BUCKET) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable), kept for every row."""
    paths: list[str] = []
    marks = stored(prints(docs, size))
    rep = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash", "text_bytes", "n", "sig", "sketch")
    grouped = marks.where("c is not null").groupBy("c").agg(F.min(rep).alias("rep"))
    classes = stored(grouped.select("c", "rep.n", "rep.sig", "rep.sketch", F.struct("rep.doc_id", "rep.text_hash", "rep.text_bytes").alias("rep")))
    found = class_links(docs, classes, paths, percent, size, bucket)  # a table among ``paths``
    ids = classes.select("c", F.col("rep.doc_id").alias("first"))
    if found is None:
        labels = ids.select("c", F.col("first").alias("component_id"))
    else:
        rooted = ids.join(found, "c", "left").withColumn("root", F.coalesce("root", "c"))
        least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
        labels = rooted.join(least, "root").select("c", "component_id")
    labels = stored(labels)
    discard(docs.sparkSession, paths)
    linked = marks.where("c is not null").join(labels, "c").select("doc_id", "n", "component_id")
    alone = marks.where("c is null").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    kept = F.col("doc_id").eqNullSafe(F.col("component_id"))
    return linked.union(alone).select("doc_id", F.col("n").alias("n_shingles"), "component_id", kept.alias("kept"))


def op13_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


ORACLES = {
    "op13_minhash": r"""
with recursive
t as (select doc_id, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+')) as word,
  unnest(range(1, 1 + len(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+')))) as pos from documents),
w as (select doc_id, word, row_number() over p as pos, count(*) over (partition by doc_id) as words, lead(word, 1) over p as w2, lead(word, 2) over p as w3
  from t where word <> '' window p as (partition by doc_id order by pos)),
s as (select distinct doc_id, case when words = 1 then word when words = 2 then word || ' ' || w2 else word || ' ' || w2 || ' ' || w3 end as gram
  from w where pos <= greatest(1, words - 2)),
n as (select doc_id, count(*) as n from s group by doc_id),
i as (select a.doc_id as a, b.doc_id as b, count(*) as common from s a join s b on a.gram = b.gram and a.doc_id < b.doc_id group by a.doc_id, b.doc_id),
l as (select a, b from i join n x on x.doc_id = a join n y on y.doc_id = b where 100 * common >= 85 * (x.n + y.n - common)),
e as (select a as u, b as v from l union all select b, a from l),
r(node, reached) as (select u, v from e union select r.node, e.v from r join e on r.reached = e.u),
c as (select node, least(node, min(reached)) as root from r group by node)
select d.doc_id, coalesce(n.n, 0) as n_shingles, coalesce(c.root, d.doc_id) as component_id, coalesce(c.root, d.doc_id) = d.doc_id as kept
from documents d left join n on n.doc_id = d.doc_id left join c on c.node = d.doc_id"""
}
QUERIES = {"op13_minhash": op13_minhash}
