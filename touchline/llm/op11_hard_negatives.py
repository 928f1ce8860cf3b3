"""Hard-negative mining with vantage-point trees over norm-augmented vectors.

Vectors are made integer. Every row gets one more component, the root of (largest squared norm - its squared norm), and every anchor a zero there; the squared distance of an anchor q and a row is
then |q|^2 + M - 2 * score, with M the largest squared norm: the higher the score, the nearer the row, and a window of scores is an annulus of distances around the anchor.

A top tree, fitted on at most ``SAMPLE`` rows, deals all rows into cells, and cells of more than ``CELL`` rows are salted. A task holds one cell and one block of queries. It grows a
tree of its own over the cell and takes the leaves in the order of their least possible distance, for all its queries side by side, passing over leaves inside the annulus' inner
radius; a query ends when no leaf can hold a better row than the ones it has, or when it leaves the annulus. The bounds follow from the triangle inequality (with room for rounding), and scores are
exact integers, so the answers are exact; the sample decides where cells lie, not what is found. Answers of all cells are merged by rank.

Positives come from a first search (same label, no annulus), negatives from a second, with one query for each anchor and positive. Before that, rows of one vector and label are cut to
those that can be among an answer, the six of least id, however many copies there are: k others and the anchor itself.

Edge cases: rows with a null id, label or vector, or a null or non-finite component, take no part. Vectors of fewer components than others end in zeros. Scores and their hundredfold must fit a long. A row that repeats
another's id, label and vector is the same row; rows that share an id only are rows of their own, but never a positive or a negative of an anchor of that id. A window without rows (a negative
positive score, say) gives none; an anchor without positives gives none. Ties go to the smaller id. An empty table gives no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from touchline.llm.common import stored, table

SCALE = 256
ANCHOR_EVERY = 100
POSITIVES, NEGATIVES = 5, 5
PERCENT = 80
#: Rows the top tree is fitted on, at most; it has one leaf for 64 of them at most.
SAMPLE = 16_384
#: Rows of a cell, and queries of a block, that one task holds.
CELL, BLOCK = 4096, 4096
LEAF = 64
LOW, HIGH = -(1 << 62), 1 << 62
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


@dataclass
class Tree:
    """A binary vantage-point tree with leaves of equal depth or less; children below zero are leaves, -1 - child is their number."""

    vantage: np.ndarray  # (nodes, dim + 1), augmented
    child: np.ndarray  # (nodes, 2): inside, outside
    inner: np.ndarray  # (nodes, 2): least distance from the vantage point on that side
    outer: np.ndarray
    radius: np.ndarray
    leaves: int

    def route(self, points: np.ndarray) -> np.ndarray:
        """The leaf of each augmented point."""
        at = np.zeros(len(points), np.int64) if len(self.radius) else np.full(len(points), -1)
        while (open_ := np.flatnonzero(at >= 0)).size:
            node = at[open_]
            gap = points[open_] - self.vantage[node]
            far = np.sqrt(np.einsum("ij,ij->i", gap, gap)) > self.radius[node]
            at[open_] = self.child[node, far.astype(int)]
        return -1 - at

    def bounds(self, queries: np.ndarray, slack: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(queries, leaves): the least and the largest distance that a row of the leaf can have."""
        low, high = np.zeros((len(queries), self.leaves)), np.full((len(queries), self.leaves), np.inf)
        if not len(self.radius):
            return low, high
        squared = (queries**2).sum(1)[:, None] + (self.vantage**2).sum(1) - 2 * queries @ self.vantage.T
        gap = np.sqrt(np.maximum(squared, 0))
        stack = [(0, np.zeros(len(queries)), np.full(len(queries), np.inf))]
        while stack:
            node, least, most = stack.pop()
            for side in (0, 1):
                near = np.maximum(least, np.maximum(gap[:, node] - self.outer[node, side], self.inner[node, side] - gap[:, node]) - slack)
                far = np.minimum(most, gap[:, node] + self.outer[node, side] + slack)
                if (below := self.child[node, side]) < 0:
                    low[:, -1 - below], high[:, -1 - below] = near, far
                else:
                    stack.append((below, near, far))
        return low, high


def grow(points: np.ndarray, leaf_rows: int, sampled: bool = False) -> tuple[Tree, np.ndarray]:
    """A tree over augmented points, and each point's leaf. Where ``points`` are a sample, its bounds hold for all points it routes."""
    nodes: list[list] = []
    leaf_of, leaves = np.zeros(len(points), np.int64), 0
    stack = [(np.arange(len(points)), -1, 0)]
    while stack:
        rows, parent, side = stack.pop()
        if len(rows) <= leaf_rows:
            leaf_of[rows] = leaves
            leaves, name = leaves + 1, -1 - leaves
        else:
            name = len(nodes)
            start = points[rows[0]]
            vantage = points[rows[np.argmax(((points[rows] - start) ** 2).sum(1))]]
            gap = np.sqrt(((points[rows] - vantage) ** 2).sum(1))
            order, half = np.argsort(gap, kind="stable"), len(rows) // 2
            near, far = gap[order[half - 1]], gap[order[half]]
            nodes.append([vantage, [0, 0], [0.0, near if sampled else far], [near, np.inf if sampled else gap.max()], near])
            stack += [(rows[order[:half]], name, 0), (rows[order[half:]], name, 1)]
        if parent >= 0:
            nodes[parent][1][side] = name
    columns = zip(*nodes, strict=True) if nodes else (np.zeros((0, points.shape[1])), *(np.zeros((0, 2)),) * 3, np.zeros(0))
    vantage, child, inner, outer, radius = map(np.array, columns)
    return Tree(vantage, child.astype(np.int64), inner, outer, radius, leaves), leaf_of


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """A list column as int64 rows, shorter ones ending in zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), dim), np.int64)
    out[np.arange(dim) < lengths[:, None]] = flat
    return out


def augmented(x: np.ndarray, limit: float) -> np.ndarray:
    wide = x.astype(np.float64)
    return np.column_stack([wide, np.sqrt(np.maximum(limit - (wide**2).sum(1), 0))])


def scores(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact integer inner products."""
    bound = float(np.abs(queries).max(initial=0)) * float(np.abs(rows).max(initial=0)) * queries.shape[1]
    if bound < 2**53:
        return (queries.astype(np.float64) @ rows.T.astype(np.float64)).astype(np.int64)
    return queries @ rows.T


def nearest_in_cell(ids: np.ndarray, labels: np.ndarray, x: np.ndarray, query: dict[str, np.ndarray], limit: float, k: int, leaf_rows: int = LEAF) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """query index, row index, score: the first k rows of the cell for each query (q, anchor, label, same, low, high)."""
    order = np.argsort(ids, kind="stable")
    ids, labels, x = ids[order], labels[order], x[order]
    tree, leaf = grow(augmented(x, limit), leaf_rows)
    members = [np.flatnonzero(leaf == t) for t in range(tree.leaves)]
    q, count = query["q"], len(query["q"])
    wide = np.column_stack([q.astype(np.float64), np.zeros(count)])
    norms = (wide**2).sum(1) + limit
    slack = 1e-6 * np.sqrt(norms)
    low, high = tree.bounds(wide, slack)
    reach = lambda norm, score: np.sqrt(np.maximum(norm - 2.0 * score, 0))
    start, stop = reach(norms, query["high"]), reach(norms, query["low"])
    visits = np.argsort(low, axis=1, kind="stable")
    best, held, have = np.zeros((count, k), np.int64), np.full((count, k), -1), np.zeros(count, np.int64)
    active = np.arange(count)
    for turn in range(tree.leaves):
        at = visits[active, turn]
        least = low[active, at]
        last = np.where(have[active] == k, reach(norms[active], best[active, k - 1]), np.inf)
        go = (least <= last + slack[active]) & (least <= stop[active] + slack[active])
        active, at = active[go], at[go]
        if not len(active):
            break
        looks = high[active, at] >= start[active] - slack[active]
        for t in np.unique(at[looks]):
            who, rows = active[looks & (at == t)], members[t]
            found = scores(q[who], x[rows])
            same = labels[rows] == query["label"][who, None]
            ok = (found >= query["low"][who, None]) & (found <= query["high"][who, None]) & (same == query["same"][who, None]) & (ids[rows] != query["anchor"][who, None])
            some = ok.any(axis=1)
            who, found, ok = who[some], found[some], ok[some]
            if not len(who):
                continue
            all_scores = np.concatenate([best[who], found], 1)
            all_rows = np.concatenate([held[who], np.broadcast_to(rows, found.shape)], 1)
            void = np.concatenate([held[who] < 0, ~ok], 1)
            top = np.lexsort((all_rows, -all_scores, void), axis=1)[:, :k]  # rows are in the order of their ids
            best[who], void = np.take_along_axis(all_scores, top, 1), np.take_along_axis(void, top, 1)
            held[who] = np.where(void, -1, np.take_along_axis(all_rows, top, 1))
            have[who] = (~void).sum(1)
    i, j = np.nonzero(held >= 0)
    return i, order[held[i, j]], best[i, j]


def integer_rows(embeddings: DataFrame) -> DataFrame:
    """vec_id, label, x, mark (hash of x) of the rows that take part."""
    finite = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    rows = embeddings.select("vec_id", F.col("label").cast("long").alias("label"), "embedding").where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(finite, F.lit(False)))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    x = F.transform("embedding", lambda c: F.floor(c.cast("double") * SCALE).cast("long"))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), x.alias("x")).withColumn("mark", F.xxhash64("x"))


class Index:
    """Rows dealt into cells by a top tree; searched with queries of q, anchor, label, same, low, high and further columns."""

    def __init__(self, rows: DataFrame, sample: int = SAMPLE, cell: int = CELL, block: int = BLOCK):
        self.block, self.spark = block, rows.sparkSession
        norm = F.aggregate("x", F.lit(0.0), lambda a, c: a + c.cast("double") * c)
        facts = rows.agg(F.count("*").alias("n"), F.max(norm).alias("limit"), F.max(F.size("x")).alias("dim")).first()
        self.n, self.limit, self.dim = facts.n, (facts.limit or 0.0) * (1 + 1e-12), max(1, facts.dim or 0)
        if not self.n:
            return
        picked = rows.orderBy(F.xxhash64("vec_id", "mark"), "vec_id").limit(sample).select("x")
        points = augmented(np.array([np.pad(r.x, (0, self.dim - len(r.x))) for r in picked.collect()], np.int64).reshape(-1, self.dim), self.limit)
        leaves = max(1, min(-(-self.n // cell), sample // LEAF))
        self.tree, _ = grow(points, max(1, -(-len(points) // leaves)), sampled=True)
        tree, limit, dim = self.tree, self.limit, self.dim

        def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    leaf = tree.route(augmented(matrix(batch.column(2), dim), limit))
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf, pa.int32())], names=[*batch.schema.names, "leaf"])

        routed = stored(rows.select("vec_id", "label", "x").mapInArrow(route, "vec_id long, label long, x array<long>, leaf int"))
        salts = F.ceil(F.count("*") / cell).cast("int")
        # One row for each leaf of the top tree, of which there are sample / LEAF at most.
        self.salts = F.broadcast(stored(routed.groupBy("leaf").agg(salts.alias("salts"))))
        salt = F.pmod(F.xxhash64("vec_id", "label", "x"), F.col("salts")).cast("int")
        self.cells = routed.join(self.salts, "leaf").select("leaf", salt.alias("salt"), F.struct("vec_id", "label", "x").alias("row"))

    def search(self, queries: DataFrame, keys: list[str], k: int) -> DataFrame:
        """The columns ``keys`` of each query with vec_id, score and place (from 1) of its first ``k`` rows."""
        tree, limit, dim = self.tree, self.limit, self.dim
        blocks = max(1, -(-queries.count() // self.block))
        names = [*keys, "q", "anchor", "label", "same", "low", "high"]
        flat = queries.select(*[c for c in names if c not in keys], F.struct(*keys).alias("keys"))
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in flat.schema.fields) + ", leaf int"

        def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """One row for each leaf that may hold an answer."""
            for batch in batches:
                if not batch.num_rows:
                    continue
                wide = np.column_stack([matrix(batch.column(0), dim).astype(np.float64), np.zeros(batch.num_rows)])
                norms = (wide**2).sum(1) + limit
                slack = 1e-6 * np.sqrt(norms)
                low, high = tree.bounds(wide, slack)
                bound = {c: np.sqrt(np.maximum(norms - 2.0 * batch.column(batch.schema.get_field_index(c)).to_numpy(), 0)) for c in ("low", "high")}
                for leaf in range(tree.leaves):
                    hit = np.flatnonzero((low[:, leaf] <= bound["low"] + slack) & (high[:, leaf] >= bound["high"] - slack))
                    part = batch.take(pa.array(hit))
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.full(len(hit), leaf), pa.int32())], names=[*batch.schema.names, "leaf"])

        asked = flat.mapInArrow(spread, schema).join(self.salts, "leaf")
        dealt = F.pmod(F.xxhash64("keys"), F.lit(blocks)).cast("int")
        asked = asked.select("leaf", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), dealt.alias("block"), F.struct("q", "anchor", "label", "same", "low", "high", "keys").alias("query"))
        held = self.cells.select("leaf", "salt", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "row")

        def answer(rows: pa.Table, wanted: pa.Table) -> pa.Table:
            found = ([], [], [])
            whole = wanted.column("query").combine_chunks() if wanted.num_rows else None
            row = rows.column("row").combine_chunks() if rows.num_rows else None
            if whole is not None and row is not None:
                query = {c: whole.field(c).to_numpy(zero_copy_only=False) for c in ("anchor", "label", "same", "low", "high")}
                query["q"] = matrix(whole.field("q"), dim)
                ids = row.field("vec_id").to_numpy()
                i, j, score = nearest_in_cell(ids, row.field("label").to_numpy(), matrix(row.field("x"), dim), query, limit, k)
                found = (whole.field("keys").take(pa.array(i)), ids[j], score)
            kind = wanted.schema.field("query").type.field("keys").type
            return pa.table([pa.array(found[0], kind) if isinstance(found[0], list) else found[0], pa.array(found[1], pa.int64()), pa.array(found[2], pa.int64())], names=["keys", "vec_id", "score"])

        key_type = flat.schema["keys"].dataType.simpleString()
        parts = held.groupBy("leaf", "salt", "block").cogroup(asked.groupBy("leaf", "salt", "block")).applyInArrow(answer, f"keys {key_type}, vec_id long, score long")
        best = Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id")
        return parts.select("keys.*", "vec_id", "score").withColumn("place", F.row_number().over(best)).where(F.col("place") <= k)


def mine(embeddings: DataFrame, anchor_every: int = ANCHOR_EVERY, positives: int = POSITIVES, negatives: int = NEGATIVES, percent: int = PERCENT, sample: int = SAMPLE, cell: int = CELL, block: int = BLOCK) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    rows = stored(integer_rows(embeddings).dropDuplicates(["vec_id", "label", "mark", "x"]))
    anchors = rows.where(F.col("vec_id") % anchor_every == 0)
    copies = Window.partitionBy("mark", "x", "label").orderBy("vec_id")
    useful = rows.withColumn("nth", F.row_number().over(copies)).where(F.col("nth") <= max(positives, negatives) + 1)
    index = Index(useful, sample, cell, block)
    if not index.n or anchors.isEmpty():
        return embeddings.sparkSession.createDataFrame([], RESULT)
    keys = ["anchor_id", "anchor_label", "mark"]
    asked = anchors.select(F.col("vec_id").alias("anchor_id"), F.col("label").alias("anchor_label"), "mark", F.col("x").alias("q"), F.col("vec_id").alias("anchor"), "label")
    near = index.search(asked.withColumns({"same": F.lit(True), "low": F.lit(LOW), "high": F.lit(HIGH)}), keys, positives)
    near = stored(near.select(*keys, F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))
    score = F.col("positive_score")
    least = F.expr(f"(positive_score * {percent}) div 100 + if((positive_score * {percent}) % 100 > 0, 1, 0)")
    windows = asked.join(near, keys).where(score >= 0).withColumns({"same": F.lit(False), "low": least, "high": score})
    found = index.search(windows, [*keys, "positive_id", "positive_score"], negatives)
    return found.select("anchor_id", "positive_id", F.col("place").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine(table(spark, sf_dir, "embeddings"))


ORACLES = {
    "op11_hard_negatives": """
with r as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, [floor(256 * cast(c as double)) for c in embedding] as x
  from embeddings where label is not null and embedding is not null and len([c for c in embedding if c is null or not isfinite(c)]) = 0),
s as (select a.vec_id as anchor_id, b.vec_id as other_id, a.label = b.label as same, cast(list_dot_product(a.x, b.x) as bigint) as score
  from r a join r b on a.vec_id <> b.vec_id where a.vec_id % 100 = 0),
p as (select anchor_id, other_id as positive_id, score as positive_score from s where same
  qualify row_number() over (partition by anchor_id order by score desc, other_id) <= 5)
select p.anchor_id, positive_id, cast(row_number() over w as integer) as rank, other_id as negative_id, positive_score, score as negative_score
from p join s on s.anchor_id = p.anchor_id and not same and 80 * positive_score <= 100 * score and score <= positive_score
window w as (partition by p.anchor_id, positive_id order by score desc, other_id)
qualify row_number() over w <= 5"""
}
QUERIES = {"op11_hard_negatives": op11_hard_negatives}
