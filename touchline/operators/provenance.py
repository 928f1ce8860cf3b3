"""Provenance worked out from a bitemporal revision history, instead of being claimed.

Revisions: fixture_id, revision (1, 2, ... per fixture), observed_at (epoch seconds when it was seen) and what it says: kickoff, home, away, home_goals, away_goals, is_final. The valid
time of a result is its kickoff, its transaction time is observed_at. The history is held against the table that features are made from: each fixture's revisions must be numbered without a gap and
say in the end what the table says; all must have been observed, in order; and the replay must show that a result read as it was known at any as-of time is the one in the table, that is, that its last change was
observed before the first as-of time at which the league's features count it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from touchline.operators.asof import AsOfConfig

SAYS = ["kickoff", "home", "away", "home_goals", "away_goals", "is_final"]
#: Fixtures, blocks or groups of blocks under one digest.
FAN_OUT = 1000


def known_at(revisions: DataFrame, at: Column | int) -> DataFrame:
    """Each fixture as its latest revision observed before ``at`` (epoch seconds, a number or a column) had it."""
    limit = F.lit(at) if isinstance(at, int) else at
    last = Window.partitionBy("fixture_id").orderBy(F.desc("revision"))
    return revisions.where(F.col("observed_at") < limit).withColumn("__n", F.row_number().over(last)).where("__n = 1").drop("__n")


def first_uses(fixtures: DataFrame, config: AsOfConfig = AsOfConfig()) -> DataFrame:
    """league_id, kickoff, first_use: the earliest as-of time of the league that counts results of that kickoff (null if none does). Works on distinct kickoffs."""
    times = fixtures.select("league_id", "kickoff").distinct()
    ask, known = F.struct((F.col("kickoff") - config.lead).alias("at"), F.lit(True).alias("ask")), F.struct((F.col("kickoff") + config.lag).alias("at"), F.lit(False).alias("ask"))
    line = times.withColumn("e", F.explode(F.array(ask, known))).select("league_id", "kickoff", "e.at", "e.ask")
    later = Window.partitionBy("league_id").orderBy("at").rangeBetween(1, Window.unboundedFollowing)  # strictly after it is known
    return line.withColumn("first_use", F.min(F.when(F.col("ask"), F.col("at"))).over(later)).where("not ask").select("league_id", "kickoff", "first_use")


def history(revisions: DataFrame) -> DataFrame:
    """A row for each fixture: n, numbered (revisions are 1 to n), observed (all, in order), changed_at (of its last change that concerns results) and what the last revision says."""
    order = Window.partitionBy("fixture_id").orderBy("revision")
    says = F.struct(*SAYS)
    rows = revisions.withColumns({"said": says, "before": F.lag(says).over(order), "seen_before": F.lag("observed_at").over(order)})
    in_order = F.col("observed_at").isNotNull() & (F.col("seen_before").isNull() | (F.col("seen_before") <= F.col("observed_at")))
    changed = F.col("is_final") & ~F.col("said").eqNullSafe(F.col("before"))
    return rows.groupBy("fixture_id").agg(
        F.count("*").alias("n"),
        ((F.min("revision") == 1) & (F.max("revision") == F.count("*")) & (F.count_distinct("revision") == F.count("*"))).alias("numbered"),
        F.min(in_order).alias("observed"),
        F.max(F.when(changed, F.coalesce("observed_at", F.lit((1 << 63) - 1)))).alias("changed_at"),
        F.max_by("said", "revision").alias("last"),
    )


def faults(revisions: DataFrame, fixtures: DataFrame, config: AsOfConfig = AsOfConfig()) -> DataFrame:
    """fixture_id, n, kickoff, incomplete, unobserved, unreplayable: a row for each fixture of the table or the history."""
    held = fixtures.select("fixture_id", "league_id", F.struct(*SAYS).alias("now")).join(history(revisions), "fixture_id", "full")
    rows = held.withColumn("kickoff", F.col("now.kickoff")).join(first_uses(fixtures, config), ["league_id", "kickoff"], "left")
    unlike = ~F.col("last").eqNullSafe(F.col("now"))
    late = F.coalesce(F.col("now.is_final"), F.lit(False)) & (F.col("changed_at").isNull() | F.coalesce(F.col("changed_at") >= F.col("first_use"), F.lit(False)))
    return rows.select("fixture_id", F.coalesce("n", F.lit(0)).alias("n"), "kickoff", (F.coalesce(~F.col("numbered"), F.lit(True)) | unlike).alias("incomplete"), F.coalesce(~F.col("observed"), F.lit(True)).alias("unobserved"), (unlike | late).alias("unreplayable"))


def manifest_digest(revisions: DataFrame) -> DataFrame:
    """revisionManifestSha256: one row with a digest of digests over all revisions in the order of their ids.

    Fixtures whose ids share a thousand are one block, blocks that share a thousand one group, and so on for three levels: no digest is of more than the lines of FAN_OUT fixtures or FAN_OUT
    digests while ids are below FAN_OUT^4.
    """
    text = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("fixture_id", "revision", "observed_at", *SAYS)]
    rows = revisions.select(F.floor(F.col("fixture_id") / FAN_OUT).cast("long").alias("block"), F.struct("fixture_id", "revision", F.concat_ws("|", *text).alias("line")).alias("x"))

    def digest(found: DataFrame) -> DataFrame:
        lines = F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"])
        return found.groupBy("block").agg(F.sha2(F.concat_ws("\n", lines), 256).alias("line"))

    for level in range(3):
        at = F.floor(F.col("block") / FAN_OUT).cast("long") if level < 2 else F.lit(0).cast("long")
        rows = digest(rows).select(at.alias("block"), F.struct(F.col("block").alias("fixture_id"), F.lit(0).alias("revision"), "line").alias("x"))
    return digest(rows).select(F.col("line").alias("revisionManifestSha256"))


def proof_row(revisions: DataFrame, fixtures: DataFrame, config: AsOfConfig = AsOfConfig()) -> DataFrame:
    """One row: the three flags, counts of fixtures and revisions, coverage by fixtures whose history is whole, and the manifest's digest."""
    found = faults(revisions, fixtures, config)
    whole = F.when(~F.col("incomplete") & ~F.col("unobserved"), F.col("kickoff"))
    summary = found.agg(
        (F.coalesce(F.max("incomplete"), F.lit(False)) == F.lit(False)).alias("sourceRevisionHistoryComplete"),
        (F.coalesce(F.max("unobserved"), F.lit(False)) == F.lit(False)).alias("correctionObservedAtComplete"),
        (F.coalesce(F.max("unreplayable"), F.lit(False)) == F.lit(False)).alias("asOfReplayVerified"),
        F.sum((F.col("n") > 0).cast("long")).alias("fixtureCount"),
        F.sum("n").alias("revisionCount"),
        F.min(whole).alias("coverageStartUtc"),
        F.max(whole).alias("coverageEndUtc"),
    )
    return summary.crossJoin(manifest_digest(revisions)) if not revisions.isEmpty() else summary.withColumn("revisionManifestSha256", F.lit(None).cast("string"))  # one row each


def proof(revisions: DataFrame, fixtures: DataFrame, schema: str, mode: str, config: AsOfConfig = AsOfConfig()) -> dict:
    """The proof that a report carries: scalars only."""
    return {"schemaVersion": schema, "sourceRevisionMode": mode} | proof_row(revisions, fixtures, config).first().asDict()


def revisions_of(fixtures: DataFrame, config: AsOfConfig = AsOfConfig()) -> DataFrame:
    """A whole history of ``fixtures``: each announced a week before kickoff, finals told half a lag after it."""
    told = F.struct(F.lit(2).alias("revision"), (F.col("kickoff") + config.lag // 2).alias("observed_at"), F.col("home_goals"), F.col("away_goals"), F.lit(True).alias("is_final"))
    none = F.lit(None).cast(fixtures.schema["home_goals"].dataType)
    # An unfinished fixture keeps what the table says of it.
    goals = [F.when(F.col("is_final"), none).otherwise(F.col(c)).alias(c) for c in ("home_goals", "away_goals")]
    announced = F.struct(F.lit(1).alias("revision"), (F.col("kickoff") - 7 * 86_400).alias("observed_at"), *goals, F.lit(False).alias("is_final"))
    both = F.when(F.col("is_final"), F.array(announced, told)).otherwise(F.array(announced))
    rows = fixtures.withColumn("r", F.explode(both))
    return rows.select("fixture_id", "r.revision", "r.observed_at", "kickoff", "home", "away", "r.home_goals", "r.away_goals", "r.is_final")


def with_faults(revisions: DataFrame, case: str) -> DataFrame:
    """``revisions`` with one planted kind of fault in a share of the fixtures: "gap", "unobserved", "late", "missing", or none ("whole")."""
    picked = F.col("fixture_id") % 97 == 5
    final = F.col("is_final")
    if case == "whole":
        return revisions
    if case == "gap":  # a revision between the two is lost
        return revisions.withColumn("revision", F.when(picked & final, F.col("revision") + 1).otherwise(F.col("revision")))
    if case == "missing":
        return revisions.where(~picked)
    if case == "unobserved":
        return revisions.withColumn("observed_at", F.when(picked & final, F.lit(None)).otherwise(F.col("observed_at")))
    if case == "late":  # the result told first was another one, and was corrected forty days later
        wrong = revisions.withColumn("home_goals", F.when(picked & final, F.col("home_goals") + 1).otherwise(F.col("home_goals")))
        put_right = revisions.where(picked & final).withColumns({"revision": F.lit(3), "observed_at": F.col("observed_at") + 40 * 86_400})
        return wrong.unionByName(put_right)
    raise ValueError(f"no such case: {case}")


def failures_of(spark: SparkSession, failures: list[str]) -> DataFrame:
    return spark.createDataFrame([(f,) for f in failures], "failure string")
