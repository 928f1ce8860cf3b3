"""Scores, leaderboards, ranks and calibration of outcome probabilities.

Predictions: model_id, key, season, block, target, p (array of three). All summaries come from one pass over the scored rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.functions import exact
from touchline.functions import probability as P
from touchline.session import checkpointed

METRICS = {"brier": "brier", "log_loss": "log_loss", "rps": "rps", "hit_rate": "fractional_hit"}


def score(predictions: DataFrame) -> DataFrame:
    """Adds brier, log_loss, rps, top (the largest part), fractional_hit, argmax_hit and bin."""
    p, y = F.col("p"), F.col("target")
    return predictions.withColumns({"brier": P.brier(p, y), "log_loss": P.log_loss(p, y), "rps": P.ranked_probability_score(p, y), "top": F.array_max(p), "fractional_hit": P.fractional_hit(p, y), "argmax_hit": P.argmax_hit(p, y), "bin": P.bin_of(F.array_max(p))})


def leaderboard(scored: DataFrame) -> DataFrame:
    """n, weeks and the exact mean of each metric by model."""
    return _board(_bins(scored, ["model_id"]), ["model_id"])


def season_leaderboard(scored: DataFrame) -> DataFrame:
    """Whole (season null, overall 1) and per-season summaries from one pass over the scored rows."""
    bins = _bins(scored, ["model_id", "season"])
    whole = _board(bins, ["model_id"]).select("model_id", F.lit(None).cast(scored.schema["season"].dataType).alias("season"), F.lit(1).alias("overall"), "n", "week_count", *METRICS)
    each = _board(bins, ["model_id", "season"]).select("model_id", "season", F.lit(0).alias("overall"), "n", "week_count", *METRICS)
    return whole.unionByName(each)


def _bins(scored: DataFrame, keys: list[str]) -> DataFrame:
    """Exact partial sums by keys and block: a few rows for each model, season and week. They are stored, as sums and counts of weeks both read them."""
    return checkpointed(exact.bin_sums(scored, [*keys, "block"], {n: F.col(c) for n, c in METRICS.items()}))


def _board(bins: DataFrame, keys: list[str]) -> DataFrame:
    weeks = bins.groupBy(*keys).agg(F.countDistinct("block").alias("week_count"))
    names = list(METRICS)
    means = exact.wide(exact.rounded_sums(exact.add_bins(bins, [*keys, "name", "bin"]), keys), keys, names)
    return means.join(weeks, keys).select(*keys, F.col(f"n_{names[0]}").alias("n"), "week_count", *names)


def ranked(board: DataFrame, registry: DataFrame, digits: int = 10, history_only: bool = False) -> DataFrame:
    """Adds rank by rounded Brier score; equals keep the registry's order (model_order) and ranks are consecutive."""
    rows = board.join(F.broadcast(registry), "model_id")  # one row per model
    if history_only:
        rows = rows.where("history_only")
    order = Window.orderBy(exact.half_even(F.col("brier"), digits), "model_order")
    return rows.withColumn("rank", F.row_number().over(order))


def best(board: DataFrame, registry: DataFrame, digits: int = 10, history_only: bool = True) -> DataFrame:
    """The row of the lowest rounded Brier score, the first of the registry among equals."""
    rows = board.join(F.broadcast(registry), "model_id")  # one row per model
    rows = rows.where("history_only") if history_only else rows
    return rows.orderBy(exact.half_even(F.col("brier"), digits), "model_order").limit(1)


def reliability(scored: DataFrame, bins: int = 10) -> DataFrame:
    """For every model and bin of the largest part: n, mean confidence, mean hit and their gap; empty bins stay, with nulls."""
    held = scored.groupBy("model_id", "bin").agg(F.count("*").alias("n"), F.avg("top").alias("confidence"), F.avg("fractional_hit").alias("hit_rate"))
    every = scored.select("model_id").distinct().select("model_id", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    rows = every.join(held, ["model_id", "bin"], "left")
    return rows.select("model_id", "bin", F.coalesce("n", F.lit(0)).alias("n"), "confidence", "hit_rate", F.abs(F.col("confidence") - F.col("hit_rate")).alias("gap"))


def top_label_ece(scored: DataFrame, hit: str = "fractional_hit") -> DataFrame:
    """Expected calibration error of the largest part, with either kind of hit."""
    held = scored.groupBy("model_id", "bin").agg(F.count("*").alias("n"), F.abs(F.avg("top") - F.avg(hit)).alias("gap"))
    return held.groupBy("model_id").agg((F.sum(F.col("n") * F.col("gap")) / F.sum("n")).alias("ece"))


def classwise_ece(scored: DataFrame, digits: int = 10) -> DataFrame:
    """Calibration error of each outcome's part, rounded, and the mean of the three."""
    parts = scored.select("model_id", "target", F.posexplode("p").alias("outcome", "part"))
    held = parts.groupBy("model_id", "outcome", P.bin_of(F.col("part")).alias("bin")).agg(F.count("*").alias("n"), F.abs(F.avg("part") - F.avg((F.col("target") == F.col("outcome")).cast("double"))).alias("gap"))
    each = held.groupBy("model_id", "outcome").agg(F.round(F.sum(F.col("n") * F.col("gap")) / F.sum("n"), digits).alias("ece"))
    return each.groupBy("model_id").agg(*(F.max(F.when(F.col("outcome") == i, F.col("ece"))).alias(f"ece_{c}") for i, c in enumerate(("home", "draw", "away"))), F.avg("ece").alias("macro_ece"))


#: Edges of the confidence buckets.
BUCKET_EDGES = [0.0, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0000001]


def confidence_buckets(scored: DataFrame) -> DataFrame:
    """n, mean confidence and accuracy of the first largest part by fixed buckets; empty ones stay."""
    pairs = list(zip(BUCKET_EDGES, BUCKET_EDGES[1:], strict=False))
    bucket = F.coalesce(*(F.when((F.col("top") >= a) & (F.col("top") < b), i) for i, (a, b) in enumerate(pairs)))
    held = scored.groupBy("model_id", bucket.alias("bucket")).agg(F.count("*").alias("n"), F.avg("top").alias("confidence"), F.avg("argmax_hit").alias("accuracy"))
    names = F.array(*(F.struct(F.lit(i).alias("bucket"), F.lit(a).alias("lower"), F.lit(min(b, 1.0)).alias("upper")) for i, (a, b) in enumerate(pairs)))
    every = scored.select("model_id").distinct().select("model_id", F.explode(names).alias("x")).select("model_id", "x.*")
    return every.join(held, ["model_id", "bucket"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def invalid_predictions(predictions: DataFrame) -> DataFrame:
    return predictions.where(~P.is_valid(F.col("p")) | F.col("target").isNull() | ~F.col("target").isin(0, 1, 2))


def coverage_gaps(predictions: DataFrame, keys: DataFrame) -> DataFrame:
    """model_id, key, side: keys that a model lacks (missing) or has beyond the evaluation's (extra)."""
    wanted = keys.select("key").distinct().join(F.broadcast(predictions.select("model_id").distinct()))  # a row a model
    have = predictions.select("model_id", "key").distinct()
    missing = wanted.join(have, ["model_id", "key"], "left_anti").withColumn("side", F.lit("missing"))
    extra = have.join(keys.select("key"), "key", "left_anti").select("model_id", "key", F.lit("extra").alias("side"))
    return missing.unionByName(extra)


def coverage_samples(gaps: DataFrame, most: int = 3) -> DataFrame:
    """model_id, side, n, sample: how many keys are missing or extra, and the first of them, for an error message."""
    order = Window.partitionBy("model_id", "side").orderBy("key")
    first = gaps.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)
    samples = first.groupBy("model_id", "side").agg(F.concat_ws(",", F.array_sort(F.collect_list("key"))).alias("sample"))
    return gaps.groupBy("model_id", "side").agg(F.count("*").alias("n")).join(samples, ["model_id", "side"])


def bundle(scored: DataFrame) -> DataFrame:
    """model_id, n, brier, log_loss, hit_rate, ece (both by the first largest part) and buckets, from one pass over the scored rows."""
    pairs = list(zip(BUCKET_EDGES, BUCKET_EDGES[1:], strict=False))
    bucket = F.coalesce(*(F.when((F.col("top") >= a) & (F.col("top") < b), i) for i, (a, b) in enumerate(pairs)))
    cells = scored.groupBy("model_id", "bin", bucket.alias("bucket")).agg(F.count("*").alias("n"), *(F.sum(c).alias(c) for c in ("brier", "log_loss", "argmax_hit", "top")))
    bins = cells.groupBy("model_id", "bin").agg(*(F.sum(c).alias(c) for c in ("n", "brier", "log_loss", "argmax_hit", "top")), F.collect_list(F.struct("bucket", "n", "top", "argmax_hit")).alias("held"))
    n = F.sum("n")
    whole = bins.groupBy("model_id").agg(n.alias("n"), (F.sum("brier") / n).alias("brier"), (F.sum("log_loss") / n).alias("log_loss"), (F.sum("argmax_hit") / n).alias("hit_rate"), (F.sum(F.abs(F.col("top") - F.col("argmax_hit"))) / n).alias("ece"), F.flatten(F.collect_list("held")).alias("held"))

    def of(i: int) -> Column:
        own = F.filter("held", lambda x: x["bucket"] == i)
        total = lambda c: F.aggregate(own, F.lit(0.0), lambda a, x: a + x[c])
        share = lambda c: F.when(total("n") > 0, total(c) / total("n"))
        return F.struct(F.lit(pairs[i][0]).alias("lower"), F.lit(min(pairs[i][1], 1.0)).alias("upper"), total("n").cast("long").alias("n"), share("top").alias("confidence"), share("argmax_hit").alias("accuracy"))

    return whole.withColumn("buckets", F.array(*(of(i) for i in range(len(pairs))))).drop("held")


def paired_blocks(scored: DataFrame, reference: str, metric: str) -> DataFrame:
    """model_id, block, diff, n: summed differences to the reference model by ISO week."""
    ref = scored.where(F.col("model_id") == reference).select("key", F.col(metric).alias("of_reference"))
    pairs = scored.where(F.col("model_id") != reference).join(ref, "key")
    return pairs.groupBy("model_id", "block").agg(F.sum(F.col(metric) - F.col("of_reference")).alias("diff"), F.count("*").alias("n"))
