"""The walk-forward backtest: fit, calibrate and evaluate on purged folds, pool, gate, and settle the rows of the final fit."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import partial, reduce

import numpy as np
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from touchline.functions import probability as P
from touchline.operators import backtest, gbdt, models, scoring
from touchline.session import FITS, checkpointed, started

PROTOCOL = "walk-forward"


@dataclass(frozen=True)
class Backtest:
    """stages: the plan; predictions: fixture_id, fold, raw, p; folds: metrics by fold, and pooled with a null fold; report: what the gate reads."""

    stages: list[Row]
    predictions: DataFrame
    folds: DataFrame
    report: dict


def predictions_of(examples: DataFrame, roles: DataFrame, features: list[str], config: gbdt.BoostConfig, folds: list[int]) -> DataFrame:
    """fixture_id, kickoff, target, fold, raw, p of the rows to evaluate: boosted on a fold's training rows, calibrated on its calibration rows; ``roles`` has kickoff, fold, role.

    Training rows alike in all features are made one before they are dealt to the folds, as most of a kickoff's are.
    """
    train = gbdt.alike(examples, ["kickoff"], features).persist().join(roles.where("role = 'train'"), "kickoff")
    grown = gbdt.grown_alike(train.select("fold", *features, *gbdt.COUNTS), features, config)
    asked = examples.join(roles.where("role <> 'train'"), "kickoff")
    raw = checkpointed(gbdt.boosted_probabilities(asked, *grown, features, config, carry=["kickoff", "role", "target"]))

    def calibrated(fold: int) -> DataFrame:
        own = raw.where(F.col("fold") == fold)
        curves = models.fit_isotonic(own.where("role = 'calibrate'"))
        return own.where("role = 'evaluate'").select("fixture_id", "kickoff", "target", "fold", F.col("p").alias("raw"), models.calibrate(F.col("p"), curves).alias("p"))

    with ThreadPoolExecutor(FITS) as pool:  # a plan has a handful of folds
        fits = list(map(partial(started, pool, examples.sparkSession, calibrated), folds))
        return reduce(DataFrame.unionByName, [fit.result() for fit in fits])


def run(examples: DataFrame, features: list[str], config: backtest.PlanConfig = backtest.PlanConfig(), boost: gbdt.BoostConfig | None = None, schema: str = "1", mode: str = "append-only", proof: dict | None = None) -> Backtest:
    """examples: fixture_id, kickoff, as_of, target_available, target and the features; ``proof`` is that of :func:`provenance.proof`."""
    spark = examples.sparkSession
    examples = checkpointed(examples.select("fixture_id", "kickoff", "as_of", "target_available", "target", *features))
    stages = backtest.plan(examples.select("fixture_id", "kickoff", "as_of", "target_available"), config)
    roles = checkpointed(backtest.roles(examples, stages))
    found = checkpointed(predictions_of(examples, roles, features, boost or gbdt.BoostConfig(), sorted({r.fold for r in stages})))
    of = lambda model, p: found.select(F.lit(model).alias("model_id"), F.col("fixture_id").alias("key"), "fold", "kickoff", "target", P.week_block(F.col("kickoff")).alias("block"), F.col(p).alias("p"))
    scored = scoring.score(of("boosted_isotonic", "p").unionByName(of("boosted_raw", "raw")))
    measures = [F.count("*").alias("n"), F.min("kickoff").alias("first_kickoff"), F.max("kickoff").alias("last_kickoff"), *(F.avg(c).alias(c) for c in ("brier", "log_loss", "argmax_hit"))]
    folds = checkpointed(scored.groupingSets([("model_id",), ("model_id", "fold")], "model_id", "fold").agg(*measures))
    whole = folds.where("model_id = 'boosted_isotonic' and fold is null").first()
    report = {
        "protocol": PROTOCOL if backtest.is_forward(stages) else "other",
        "foldCount": len({r.fold for r in stages}),
        "sampleCount": whole.n,
        "hitRate": whole.argmax_hit,
        "brier": whole.brier,
        "logLoss": whole.log_loss,
        "evaluationStartUtc": whole.first_kickoff,
        "evaluationEndUtc": whole.last_kickoff,
        "confidenceBuckets": [r.asDict() for r in scoring.confidence_buckets(scored.where("model_id = 'boosted_isotonic'")).orderBy("bucket").collect()],
        "expectedCalibrationError": scoring.top_label_ece(scored.where("model_id = 'boosted_isotonic'"), "argmax_hit").first().ece,
        "folds": [r.asDict() for r in stages],
    }
    trained = min(r.to_row for r in stages if r.role == "train")
    raw_end, calibration_start = backtest.final_fit(examples, trained, max(config.least_calibration, int(examples.count() * 0.10)))
    report["finalFit"] = {"rawEnd": raw_end, "calibrationStart": calibration_start}
    if proof is not None:
        report["pointInTimeProvenance"] = proof
    backtest.apply_gate(spark, report, schema, mode)
    return Backtest(stages, found.select("fixture_id", "fold", "raw", "p"), folds, report)


def final_tables(examples: DataFrame, features: list[str], done: Backtest, boost: gbdt.BoostConfig | None = None) -> dict[str, DataFrame]:
    """The candidate's tables, fitted on the rows that the backtest's report settles for the final fit: models and their edges, and the calibration curves."""
    boost = boost or gbdt.BoostConfig()
    spark, rows = examples.sparkSession, done.report["finalFit"]
    groups = backtest.kickoff_groups(examples.select("fixture_id", "kickoff", "as_of", "target_available"))
    placed = examples.join(groups.select("kickoff", "end_row"), "kickoff").select("fixture_id", "target", "end_row", *features)
    trains, calibrates = F.col("end_row") <= rows["rawEnd"], F.col("end_row") > rows["calibrationStart"]
    dealt = checkpointed(placed.where(trains | calibrates).withColumns({"fold": F.lit(0), "trains": trains}).drop("end_row"))
    models_of, edges, slices = gbdt.grown(dealt.where("trains"), features, boost)
    models_of = checkpointed(models_of)
    asked = dealt.where("not trains")
    raw = gbdt.boosted_probabilities(asked, models_of, edges, slices, features, boost).join(asked.select("fixture_id", "target"), "fixture_id")
    curves = models.fit_isotonic(checkpointed(raw))
    cuts = [(place, name, [float(x) for x in e]) for place, (name, e) in enumerate(zip(features, edges[0], strict=True))]
    knots = [(k, i, x, y) for k, curve in enumerate(curves) for i, (x, y) in enumerate(curve)]
    return {"models": models_of, "edges": spark.createDataFrame(cuts, "place int, feature string, edges array<double>"), "curves": spark.createDataFrame(knots, "outcome int, knot int, x double, y double")}


def candidate_probabilities(rows: DataFrame, tables: dict[str, DataFrame], boost: gbdt.BoostConfig | None = None) -> DataFrame:
    """fixture_id, raw, p of ``rows`` (fixture_id and the features) by the tables of a candidate."""
    cuts = sorted(tables["edges"].collect(), key=lambda r: r.place)  # a row a feature
    features = [r.feature for r in cuts]
    knots = sorted((r.outcome, r.knot, r.x, r.y) for r in tables["curves"].collect())  # a knot or two a level
    curves = [[(x, y) for k, _, x, y in knots if k == outcome] for outcome in range(3)]
    slices = F.broadcast(tables["models"].groupBy("fold").agg(F.count("*").cast("int").alias("slices")))
    asked = rows.select(F.lit(0).alias("fold"), "fixture_id", *features)
    raw = gbdt.boosted_probabilities(asked, tables["models"], {0: [np.array(r.edges, float) for r in cuts]}, slices, features, boost or gbdt.BoostConfig())
    return raw.select("fixture_id", F.col("p").alias("raw"), models.calibrate(F.col("p"), curves).alias("p"))
