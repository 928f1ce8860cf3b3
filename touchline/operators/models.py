"""Fitted probability models: multinomial logit, ridge Poisson goals with a low-score shift, isotonic calibration."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.functions import exact
from touchline.functions.probability import normalise, poisson_outcomes

# ---- logit


#: Rows whose values one aggregation buffer may hold; medians of more are found by histograms, with the same result.
FEW_ROWS = 1_000_000


def imputation(train: DataFrame, features: list[str], few: int = FEW_ROWS, exactly: bool = False) -> dict[str, tuple[float, float, float]]:
    """feature -> (exact median, mean and population deviation after imputation); an all-null feature is 0.

    With ``exactly`` mean and deviation come from exact sums and do not depend on how rows are partitioned, at the price of two more passes.
    """
    if train.limit(few + 1).count() <= few:
        row = train.agg(*(F.percentile(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")), F.lit(0.5)).alias(c) for c in features)).first()
        medians = {c: (row[c] or 0.0) for c in features}
    else:
        medians = {c: (found[0] or 0.0) for c, found in exact.exact_quantiles(train, features, [0.5]).items()}
    filled = {c: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")), F.lit(medians[c])) for c in features}
    if exactly:
        means = exact.exact_means(train, [], filled).first()
        spread = exact.exact_means(train, [], {c: (x - means[c]) * (x - means[c]) for c, x in filled.items()}).first()
        return {c: (medians[c], means[c], math.sqrt(spread[c]) or 1.0) for c in features}
    stats = train.agg(*(F.avg(x).alias(f"m_{c}") for c, x in filled.items()), *(F.stddev_pop(x).alias(f"s_{c}") for c, x in filled.items())).first()
    return {c: (medians[c], stats[f"m_{c}"], stats[f"s_{c}"] or 1.0) for c in features}


def scaled(df: DataFrame, fitted: dict[str, tuple[float, float, float]]) -> DataFrame:
    return df.withColumns({c: (F.coalesce(F.col(c).cast("double"), F.lit(median)) - mean) / deviation for c, (median, mean, deviation) in fitted.items()})


FAN_IN, NEWTON_STEPS = 64, 50


Scale = dict[str, tuple[float, float, float]]


def _logit_sums(rows: DataFrame, features: list[str], scales: dict[int, Scale], weights: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """season -> loss, gradient and Hessian of the multinomial loss over all rows of earlier seasons, scaled as the season's are; one pass over ``rows`` for all ``weights``.

    Each partition sums its own, FAN_IN groups sum the partitions'.
    """
    width = len(features) + 1
    scaling = {s: np.array([scales[s][c] for c in features]).T for s in weights}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        totals = {s: np.zeros(1 + 3 * width + 9 * width * width) for s in weights}
        for batch in batches:
            season, target = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            values = np.stack([batch.column(2 + i).to_numpy(zero_copy_only=False) for i in range(len(features))], 1)
            for s, total in totals.items():
                own = season < s
                if not own.any():
                    continue
                median, mean, deviation = scaling[s]
                x, y = values[own], np.eye(3)[target[own].astype(int)]
                x = np.hstack([np.ones((len(x), 1)), (np.where(np.isnan(x), median, x) - mean) / deviation])
                z = x @ weights[s].T
                z -= z.max(axis=1, keepdims=True)
                log_p = z - np.log(np.exp(z).sum(axis=1, keepdims=True))
                p = np.exp(log_p)
                total[0] -= (y * log_p).sum()
                total[1 : 1 + 3 * width] += ((p - y).T @ x).ravel()
                blocks = [[(x * (p[:, i] * ((i == j) - p[:, j]))[:, None]).T @ x for j in range(3)] for i in range(3)]
                total[1 + 3 * width :] += np.block(blocks).ravel()
        part = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays([pa.array([part % FAN_IN] * len(totals), pa.int32()), pa.array(list(totals), pa.int32()), pa.array([t.tolist() for t in totals.values()], pa.list_(pa.float64()))], names=["part", "season", "sums"])

    def add(group: pa.Table) -> pa.Table:
        total = np.sum(group.column("sums").to_pylist(), axis=0)
        return pa.table({"season": group.column("season")[:1], "sums": pa.array([total.tolist()], pa.list_(pa.float64()))})

    parts = rows.select(F.col("season").cast("int"), "target", *(F.col(c).cast("double") for c in features)).mapInArrow(run, "part int, season int, sums array<double>")
    found = parts.groupBy("part", "season").applyInArrow(add, "season int, sums array<double>").collect()  # FAN_IN rows a season at most
    return {s: np.sum([r.sums for r in found if r.season == s], axis=0) for s in weights}


def fit_logits(rows: DataFrame, features: list[str], scales: dict[int, Scale], c: float = 1.0, tolerance: float = 1e-9) -> dict[int, np.ndarray]:
    """season -> (3, features + 1) weights, intercepts first, of the logit that minimises the loss of the earlier seasons' ``rows``, scaled by the season's ``scales``,
    plus half the squared weights over ``c``. The seasons take their Newton steps together: each is one pass over the rows."""
    width = len(features) + 1
    penalty = np.tile(np.append(0.0, np.full(width - 1, 1 / c)), 3)
    # The loss does not change with a common shift of the intercepts; curvature along it alone keeps the steps from using it.
    shift = np.tile(np.append(1.0, np.zeros(width - 1)), 3)

    def at(asked: dict[int, np.ndarray]) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
        sums = _logit_sums(rows, features, scales, asked)
        penalised = lambda w, t: (t[0] + 0.5 * (penalty * w.ravel() ** 2).sum(), t[1 : 1 + 3 * width] + penalty * w.ravel(), t[1 + 3 * width :].reshape(3 * width, -1) + np.diag(penalty) + np.outer(shift, shift))
        return {s: penalised(w, sums[s]) for s, w in asked.items()}

    weights, done = {s: np.zeros((3, width)) for s in scales}, {}
    state = at(weights)
    for _ in range(NEWTON_STEPS):
        delta = {s: np.linalg.solve(state[s][2], state[s][1]).reshape(3, width) for s in weights if s not in done}
        moved: dict[int, np.ndarray] = {}
        for half in range(21):
            trial = {s: weights[s] - d / 2**half for s, d in delta.items() if s not in moved}
            for s, found in at(trial).items():
                if found[0] <= state[s][0] + 1e-9 * abs(state[s][0]):
                    moved[s], state[s] = trial[s], found
            if len(moved) == len(delta):
                break
        else:
            raise ValueError("no step lowers the loss")
        for s, new in moved.items():
            small, weights[s] = np.abs(new - weights[s]).max() <= tolerance, new
            if small:
                done[s] = new
        if len(done) == len(weights):
            return done
    raise ValueError("the logit did not converge")


def fit_logit(rows: DataFrame, features: list[str], c: float = 1.0, tolerance: float = 1e-9) -> np.ndarray:
    """The weights of :func:`fit_logits` for all ``rows``, which are scaled already."""
    return fit_logits(rows.withColumn("season", F.lit(0)), features, {1: dict.fromkeys(features, (0.0, 0.0, 1.0))}, c, tolerance)[1]


def logit_probabilities(train: DataFrame, test: DataFrame, features: list[str], c: float = 1.0) -> DataFrame:
    """``test`` with p, from a multinomial logit with an L2 penalty fitted to ``train`` (column target of 0, 1, 2)."""
    train = train.select("target", *features).persist()  # read for medians, for deviations and by the solver
    fitted = imputation(train, features)
    if train.select("target").distinct().count() != 3:
        raise ValueError("training rows must have all three outcomes")
    rows = scaled(train, fitted).persist()
    weights = fit_logit(rows, features, c)
    rows.unpersist()
    train.unpersist()
    return _logit_shares(test, features, fitted, weights)


def logits_by_season(rows: DataFrame, seasons: list[int], features: list[str], scales: dict[int, Scale] | None = None, c: float = 1.0) -> list[DataFrame]:
    """The rows of each season with p, as :func:`logit_probabilities` from all earlier seasons' ones. ``rows`` are read some ten times, whatever the number of seasons."""
    outcomes = rows.select("season", "target").distinct().collect()  # three rows a season
    if any(len({r.target for r in outcomes if r.season < s}) != 3 for s in seasons):
        raise ValueError("training rows must have all three outcomes")
    scales = scales or {s: imputation(rows.where(F.col("season") < s), features) for s in seasons}
    weights = fit_logits(rows, features, {s: scales[s] for s in seasons}, c)
    return [_logit_shares(rows.where(F.col("season") == s), features, {f: scales[s][f] for f in features}, weights[s]) for s in seasons]


def _logit_shares(test: DataFrame, features: list[str], fitted: Scale, weights: np.ndarray) -> DataFrame:
    value = {f: (F.coalesce(F.col(f).cast("double"), F.lit(median)) - mean) / deviation for f, (median, mean, deviation) in fitted.items()}
    logits = [reduce(lambda a, x: a + x, [F.lit(float(w[0])), *(F.lit(float(k)) * value[f] for k, f in zip(w[1:], features, strict=True))]) for w in weights]
    # Logits first, then shares: each is worked out once a row.
    with_logits = test.withColumn("__z", F.array(*logits))
    shares = F.transform("__z", lambda z: F.exp(z - F.array_max("__z")))
    return with_logits.withColumn("__e", shares).select(*test.columns, F.transform("__e", lambda e: e / F.aggregate("__e", F.lit(0.0), lambda a, x: a + x)).alias("p"))


# ---- goals

RIDGE, GLOBAL_RIDGE, MOST_ETA, LEAST_MATCHES = 1.0, 1e-8, 20.0, 380
#: Teams whose effects are sent to every task at most.
MOST_TEAMS = 500_000


@dataclass(frozen=True)
class GoalModel:
    teams: list
    beta: np.ndarray
    iterations: int
    objective: float

    def effects(self, spark) -> DataFrame:
        """team, attack, defence: one row per team."""
        t = len(self.teams)
        return spark.createDataFrame([(team, float(self.beta[2 + i]), float(self.beta[2 + t + i])) for i, team in enumerate(self.teams)], "team long, attack double, defence double")


def pair_statistics(matches: DataFrame) -> DataFrame:
    """home, away, n, home_goals, away_goals: all that the Poisson likelihood needs, one row per ordered pair of teams."""
    return matches.groupBy("home", "away").agg(F.count("*").alias("n"), F.sum("home_goals").cast("long").alias("home_goals"), F.sum("away_goals").cast("long").alias("away_goals"))


def fit_goals(pairs: list, least: int = LEAST_MATCHES) -> GoalModel:
    """Penalised Poisson regression by damped Newton steps on the pair statistics (at most teams squared rows); memory grows with the pairs and with teams squared."""
    teams = sorted({r["home"] for r in pairs} | {r["away"] for r in pairs})
    number = {t: i for i, t in enumerate(teams)}
    size = 2 + 2 * len(teams)
    if sum(r["n"] for r in pairs) < least:
        raise ValueError(f"at least {least} matches are needed")
    t = len(teams)
    n, away = len(pairs), np.repeat([0, 1], len(pairs))
    h, a = (np.array([number[r[c]] for r in pairs]) for c in ("home", "away"))
    # Two rows a pair: what the home team and what the away team scored. Each has an intercept, an attack and a defence, home ones the advantage too.
    own, other = 2 + np.concatenate([h, a]), 2 + t + np.concatenate([a, h])
    w = np.tile(np.array([r["n"] for r in pairs], float), 2)
    y = np.array([r["home_goals"] for r in pairs] + [r["away_goals"] for r in pairs], float)
    penalty = np.full(size, RIDGE)
    penalty[:2] = GLOBAL_RIDGE

    def etas(b: np.ndarray) -> np.ndarray:
        return b[0] + b[1] * (away == 0) + b[own] - b[other]

    def back(v: np.ndarray) -> np.ndarray:
        """What a number for each row adds up to for each parameter."""
        return np.bincount(own, v, size) - np.bincount(other, v, size) + np.append([v.sum(), v[:n].sum()], np.zeros(size - 2))

    def hessian(mu: np.ndarray) -> np.ndarray:
        out = np.zeros((size, size))
        places = [(np.zeros(2 * n, int), np.ones(2 * n)), (np.ones(2 * n, int), (away == 0).astype(float)), (own, np.ones(2 * n)), (other, -np.ones(2 * n))]
        for i, x in places:
            for j, z in places:
                np.add.at(out, (i, j), mu * x * z)
        return out

    def objective(b: np.ndarray) -> float:
        eta = etas(b)
        return np.inf if np.abs(eta).max() > MOST_ETA else float((w * np.exp(eta) - y * eta).sum() + 0.5 * (penalty * b * b).sum())

    beta = np.zeros(size)
    beta[0] = np.log(max(y.sum(), 1.0) / (2 * w.sum()))
    now = objective(beta)
    for k in range(50):
        mu = w * np.exp(etas(beta))
        delta = np.linalg.solve(hessian(mu) + np.diag(penalty), back(mu - y) + penalty * beta)
        for half in range(21):
            trial = beta - delta / 2**half
            value = objective(trial)
            if value <= now + 1e-10:
                break
        else:
            raise ValueError("no step lowers the objective")
        moved = np.abs(trial - beta).max()
        beta, now = trial, value
        if moved <= 1e-9:
            return GoalModel(teams, beta, k + 1, now)
    raise ValueError("the goal model did not converge")


def goal_rates(fixtures: DataFrame, model: GoalModel) -> DataFrame:
    """``fixtures`` with home_rate, away_rate and cold_start (a team that the model has not seen counts as average)."""
    effects = model.effects(fixtures.sparkSession)
    effects = F.broadcast(effects) if len(model.teams) <= MOST_TEAMS else effects  # three numbers a team
    home = effects.select(F.col("team").alias("home"), F.col("attack").alias("ha"), F.col("defence").alias("hd"), F.lit(True).alias("h_seen"))
    away = effects.select(F.col("team").alias("away"), F.col("attack").alias("aa"), F.col("defence").alias("ad"), F.lit(True).alias("a_seen"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    b0, b1 = float(model.beta[0]), float(model.beta[1])
    rows = fixtures.join(home, "home", "left").join(away, "away", "left")
    return rows.select(*fixtures.columns, F.exp(b0 + b1 + zero("ha") - zero("ad")).alias("home_rate"), F.exp(b0 + zero("aa") - zero("hd")).alias("away_rate"), (F.col("h_seen").isNull() | F.col("a_seen").isNull()).alias("cold_start"))


def low_score_cells(rated: DataFrame) -> DataFrame:
    """home, away, home_goals, away_goals, coefficient, n: the scores of 0 or 1 a side, with the factor of rho in their likelihood."""
    h, a = F.col("home_rate"), F.col("away_rate")
    none, one = F.col("home_goals") == 0, F.col("home_goals") == 1
    factor = F.when(none & (F.col("away_goals") == 0), -h * a).when(none, h).when(F.col("away_goals") == 0, a).otherwise(F.lit(-1.0))
    cells = rated.where((none | one) & F.col("away_goals").isin(0, 1)).withColumn("coefficient", factor)
    return cells.groupBy("home", "away", "home_goals", "away_goals").agg(F.first("coefficient").alias("coefficient"), F.count("*").alias("n"))


def fit_rho(coefficients: np.ndarray, n: np.ndarray, rates: list[tuple[float, float]], limit: float = 0.25, least: int = 25) -> float:
    """The interior root of the score of rho, by bisection within what keeps every factor positive."""
    if n.sum() < least:
        raise ValueError(f"at least {least} low scores are needed")
    low, high = -limit, limit
    for h, a in rates:
        low, high = max(low, -1 / h, -1 / a), min(high, 1 / (h * a), 1.0)
    low, high = low + 1e-9 * (high - low), high - 1e-9 * (high - low)
    slope = lambda r: float((n * coefficients / (1 + coefficients * r)).sum())
    if slope(low) <= 0 or slope(high) >= 0:
        raise ValueError("the best rho is not inside its interval")
    for _ in range(160):
        mid = (low + high) / 2
        low, high = (mid, high) if slope(mid) > 0 else (low, mid)
    return (low + high) / 2


def fitted_goals(done: DataFrame) -> tuple[GoalModel, float, int]:
    """The goal model of final matches, its rho, and how many low scores that rests on."""
    model = fit_goals(pair_statistics(done).collect())  # teams squared rows at most
    rated = goal_rates(done, model)
    cells = low_score_cells(rated).collect()  # four for each pair of teams at most
    rates = [(r.home_rate, r.away_rate) for r in rated.select("home_rate", "away_rate").distinct().collect()]
    n = np.array([r.n for r in cells], float)
    return model, fit_rho(np.array([r.coefficient for r in cells]), n, rates), int(n.sum())


def poisson_probabilities(train: DataFrame, test: DataFrame, with_shift: bool = False) -> DataFrame:
    """``test`` with p from goal rates fitted to the final matches of ``train``; with_shift adds the low-score dependence."""
    done = train.where("is_final")
    if with_shift:
        model, value, _ = fitted_goals(done)
    else:
        model = fit_goals(pair_statistics(done).collect())  # teams squared rows at most
    return goal_probabilities(test, model, value if with_shift else None)


def goal_probabilities(test: DataFrame, model: GoalModel, rho: float | None = None) -> DataFrame:
    """``test`` with p from the model's goal rates, worked out once for each distinct pair of rates."""
    rated = goal_rates(test, model)
    pairs = rated.select("home_rate", "away_rate").distinct()
    pairs = pairs.withColumn("p", poisson_outcomes(F.col("home_rate"), F.col("away_rate"), None if rho is None else F.lit(rho)))
    few = (len(model.teams) + 1) ** 2 <= MOST_TEAMS  # a pair of teams has one pair of rates, and teams that the model lacks are alike
    return rated.join(F.broadcast(pairs) if few else pairs, ["home_rate", "away_rate"]).select(*test.columns, "p")


# ---- isotonic


def fit_isotonic(rows: DataFrame, raw: str = "p", target: str = "target") -> list[list[tuple[float, float]]]:
    """For each outcome the (part, frequency) knots of a monotone fit; one constant knot if parts or labels do not vary."""
    curves = []
    for k in range(3):
        one = rows.select(F.get(F.col(raw), F.lit(k)).alias("x"), (F.col(target) == k).cast("double").alias("y"))
        pooled = one.groupBy("x").agg(F.avg("y").alias("y"), F.count("*").cast("double").alias("w"))
        few = pooled.limit(2).collect()
        total = one.agg(F.avg("y").alias("mean"), F.min("y").alias("lo"), F.max("y").alias("hi")).first()
        if len(few) < 2 or total.lo == total.hi:
            curves.append([(0.0, total["mean"])])
            continue
        model = IsotonicRegression(featuresCol="x", labelCol="y", weightCol="w").fit(pooled)
        curves.append(list(zip(model.boundaries.toArray().tolist(), np.clip(model.predictions.toArray(), 0, 1).tolist(), strict=True)))
    return curves


def along(curve: list[tuple[float, float]], x: Column) -> Column:
    """Linear between the knots, constant beyond them, by binary search; null stays null. A curve has a knot or two for each level of the fit."""
    at, value = (np.array([k[i] for k in curve], float) for i in (0, 1))

    @F.pandas_udf("double")
    def value_of(column: pd.Series) -> pd.Series:
        return pd.Series(np.interp(column.to_numpy(float), at, value), index=column.index).where(column.notna())

    return value_of(x)


def calibrate(p: Column, curves: list[list[tuple[float, float]]]) -> Column:
    """Each part along its curve, floored at 1e-9 and scaled to sum 1; thirds if that is not finite."""
    parts = F.array(*[F.least(F.greatest(along(c, F.get(p, F.lit(i))), F.lit(1e-9)), F.lit(1.0)) for i, c in enumerate(curves)])
    return F.coalesce(normalise(parts), F.array(*[F.lit(1 / 3)] * 3))
