"""Connected components of a link table, without gathering links anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.common import discard, stored


#: Links that one task is given at least: few links are not dealt over many tasks.
TASK_LINKS = 200_000


def connected_components(links: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """node, root: the smallest node reachable, for every node that has a link.

    Alternates large-star and small-star rounds (each a grouping on one column and a join back) until the
    links no longer change. Null ends and self links are ignored; an empty table gives no rows.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct()
    paths: list[str] = []
    edges, before = stored(edges, paths), None
    count = edges.count()
    for _ in range(max_rounds):
        tasks = max(1, -(-2 * count // TASK_LINKS))
        own = edges.coalesce(tasks)
        both = own.union(own.select(F.col("v").alias("u"), F.col("u").alias("v"))).coalesce(tasks)
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")).coalesce(tasks)
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u > v").coalesce(tasks).distinct().coalesce(tasks)
        low = large.groupBy("u").agg(F.min("v").alias("m")).coalesce(tasks)
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v")
        old, paths = paths, []
        edges = stored(small.union(low.select("u", F.col("m").alias("v"))).coalesce(tasks).distinct().coalesce(tasks), paths)
        discard(edges.sparkSession, old)
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        count = state[0]
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("connected components did not settle")
    edges = edges.coalesce(max(1, -(-2 * count // TASK_LINKS)))
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(edges.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
