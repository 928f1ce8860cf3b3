"""The competing systems: their registry, and all their predictions as one long table."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import partial, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.functions import probability as P
from touchline.operators import asof, bootstrap, gbdt, models, scoring
from touchline.session import FITS, checkpointed, started

#: Systems in the order that breaks ties; whether they use past results only (and so compete for history rank); and what each one is:
#: label, category, what it knows, how it predicts, when it is fitted.
REGISTRY = [
    ("uniform", 0, False, "Equal thirds", "baseline", "nothing", "a third for each outcome", "never"),
    ("prior", 1, True, "Shares so far", "baseline", "results known a day before kickoff", "shares of the outcomes known so far", "at every kickoff"),
    ("elo_logit", 2, True, "Elo difference", "rating", "results known a day before kickoff", "multinomial logit", "every season"),
    ("feature_logit", 3, True, "All features", "features", "results known a day before kickoff", "multinomial logit", "every season"),
    ("poisson", 4, True, "Goal rates", "goals", "earlier seasons", "ridge Poisson regression", "every season"),
    ("dixon_coles", 5, True, "Goal rates with low-score dependence", "goals", "earlier seasons", "ridge Poisson regression, then rho", "every season"),
    ("boosted_raw", 6, True, "Boosted trees", "features", "results known a day before kickoff", "gradient boosting", "every season"),
    ("boosted_isotonic", 7, True, "Boosted trees, calibrated", "features", "results known a day before kickoff", "gradient boosting, then isotonic curves", "every season"),
    ("market_proportional", 8, False, "Closing prices, scaled", "market", "closing prices", "proportional de-vigging", "at every kickoff"),
    ("market_shin", 9, False, "Closing prices, Shin", "market", "closing prices", "insider-share de-vigging", "at every kickoff"),
]
#: Features that each system reads; the others read none.
INPUTS = {"elo_logit": ["elo_diff_home_adv"], "feature_logit": asof.FEATURES, "boosted_raw": asof.FEATURES, "boosted_isotonic": asof.FEATURES, "market_proportional": ["odds"], "market_shin": ["odds"]}


def registry(spark: SparkSession) -> DataFrame:
    rows = [(*r, list(INPUTS.get(r[0], []))) for r in REGISTRY]
    return spark.createDataFrame(rows, "model_id string, model_order int, history_only boolean, label string, category string, information string, method string, schedule string, inputs array<string>")


def fold_diagnostics(fixtures: DataFrame, seasons: list[int]) -> DataFrame:
    """season, training_seasons, training_matches, teams, iterations, low_scores, rho, cold_starts: how the goal models of each evaluation season came about."""
    rows, done = [], fixtures.where("is_final")
    for season in seasons:
        past = done.where(F.col("season") < season)
        fitted, rho, low = models.fitted_goals(past)
        cold = models.goal_rates(done.where(F.col("season") == season), fitted).where("cold_start").count()
        size = past.agg(F.countDistinct("season").alias("s"), F.count("*").alias("n")).first()
        rows.append((season, size.s, size.n, len(fitted.teams), fitted.iterations, low, rho, cold))
    return fixtures.sparkSession.createDataFrame(rows, "season int, training_seasons long, training_matches long, teams long, iterations long, low_scores long, rho double, cold_starts long")


def intervals(scored: DataFrame, version: str, replicates: int = bootstrap.REPLICATES) -> DataFrame:
    """metric, model_id, reference, point, low, high, blocks: every system against the Shin prices, and calibrated against raw trees."""
    parts = []
    for metric in bootstrap.METRICS:
        for rows, reference, label in ((scored, "market_shin", "{model}:{metric}:vs-{reference}"), (scored.where("model_id in ('boosted_raw', 'boosted_isotonic')"), "boosted_raw", "{model}-vs-raw:{metric}")):
            found = bootstrap.block_bootstrap(scoring.paired_blocks(rows, reference, metric), version, metric, reference, replicates, label)
            parts.append(found.select(F.lit(metric).alias("metric"), "model_id", F.lit(reference).alias("reference"), "point", "low", "high", "blocks"))
    return reduce(DataFrame.unionByName, parts)


def predict_all(fixtures: DataFrame, odds: DataFrame, seasons: list[int], config: gbdt.BoostConfig = gbdt.BoostConfig(), least_earlier: int = 2) -> DataFrame:
    """model_id, fixture_id, season, p for the final fixtures of the evaluation seasons.

    Every fitted system is fitted anew for each season on all earlier ones; boosted predictions of earlier seasons, each made without
    its own season, calibrate the later ones. ``odds``: fixture_id, odds.
    """
    known = asof.snapshots(fixtures).where("target is not null").persist()
    known.count()  # fits that run side by side would each work it out
    prior = asof.outcome_prior(fixtures)
    done = fixtures.where("is_final")
    wanted = done.where(F.col("season").isin(seasons)).select("fixture_id", "season")
    third = F.array(*[F.lit(1 / 3)] * 3)
    name = lambda n, p="p": (F.lit(n).alias("model_id"), "fixture_id", "season", (F.col(p) if isinstance(p, str) else p).alias("p"))
    parts = [wanted.select(*name("uniform", third)), wanted.join(prior, "fixture_id").select(*name("prior", F.coalesce("p", third)))]
    market = wanted.join(odds, "fixture_id")
    parts += [market.select(*name("market_proportional", P.proportional(F.col("odds")))), market.join(shin_shares(market), "odds").select(*name("market_shin"))]
    every = sorted(r.season for r in done.select("season").distinct().collect())  # seasons are few
    folds = fixtures.sparkSession.createDataFrame([(i, s) for i, s in enumerate(every) if i >= least_earlier], "fold int, season int")

    def logits(model: str) -> list[DataFrame]:
        scales = {s: fit.result() for s, fit in scaling.items()}
        return [rows.select(*name(model)) for rows in models.logits_by_season(known, seasons, INPUTS[model], scales)]

    def scale(season: int) -> models.Scale:
        return models.imputation(known.where(F.col("season") < season), asof.FEATURES)

    def goals(season: int) -> list[DataFrame]:
        model, rho, _ = models.fitted_goals(done.where(F.col("season") < season))
        now = done.where(F.col("season") == season)
        return [models.goal_probabilities(now, model).select(*name("poisson")), models.goal_probabilities(now, model, rho).select(*name("dixon_coles"))]

    def trees(season: int) -> list[DataFrame]:
        own = boosted.where(F.col("season") == season)
        curves = models.fit_isotonic(boosted.where(F.col("season") < season))
        return [own.select(*name("boosted_raw")), own.select(*name("boosted_isotonic", models.calibrate(F.col("p"), curves)))]

    with ThreadPoolExecutor(FITS) as pool:
        start = partial(started, pool, fixtures.sparkSession)
        scaling = {s: start(scale, s) for s in seasons}
        fits = [start(logits, model) for model in ("elo_logit", "feature_logit")] + [start(goals, s) for s in seasons]
        boosted = checkpointed(gbdt.fold_probabilities(known, folds, asof.FEATURES, config, ["season", "target"]))
        fits += [start(trees, s) for s in seasons]
        parts += [part for fit in fits for part in fit.result()]
    return reduce(DataFrame.unionByName, parts)


def shin_shares(market: DataFrame) -> DataFrame:
    """odds, p: prices are solved once for each distinct triple."""
    return market.select("odds").distinct().withColumn("p", P.shin(F.col("odds")))
