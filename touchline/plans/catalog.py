"""Registered queries on the star-schema tables and their SQL twins."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import partial, reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from touchline.functions import exact
from touchline.functions import probability as P
from touchline.operators import asof, backtest, bootstrap, elo, gbdt, models, provenance, publish, scoring, seasons, systems, walkforward
from touchline.operators.running import running
from touchline.plans import oracles
from touchline.session import shared_folder
from touchline.sources import fixtures as source
from touchline.sources import ingest
from touchline.streaming import live_form, pending

VERSION = "demo-1"
FIXED_TIME = 883_612_800  # 1998-01-01


def _r(column: str | Column, digits: int = 6) -> Column:
    return F.round(F.col(column) if isinstance(column, str) else column, digits)


def _triple(p: str = "p") -> list[Column]:
    return [_r(F.get(F.col(p), F.lit(i))).alias(n) for i, n in enumerate(("p_home", "p_draw", "p_away"))]


def asof_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = {k: v for k, v in asof.form_columns().items() if "points" in k}
    return asof.by_side(asof.team_form(source.from_orders(spark, sf_dir)), columns)


def asof_goals(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = {k: v for k, v in asof.form_columns().items() if "goals" in k}
    return asof.by_side(asof.team_form(source.from_orders(spark, sf_dir)), columns)


def asof_venue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asof.by_side(asof.team_form(source.from_orders(spark, sf_dir), venue=True), asof.venue_columns())


def asof_h2h(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asof.head_to_head(source.from_orders(spark, sf_dir)).select("fixture_id", "h2h_home_points_sum_5")


def asof_rest_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asof.by_side(asof.team_form(source.from_orders(spark, sf_dir)), asof.rest_columns())


def asof_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asof.outcome_prior(source.from_orders(spark, sf_dir)).select("fixture_id", *_triple())


def asof_source_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asof.source_max(source.from_orders(spark, sf_dir))


def asof_fixed_timestamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = {k: v for k, v in asof.form_columns().items() if "points" in k}
    return asof.by_side(asof.form_at(source.from_orders(spark, sf_dir), FIXED_TIME), columns)


def elo_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return elo.elo_snapshots(source.from_orders(spark, sf_dir))


def feature_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asof.snapshots(source.from_orders(spark, sf_dir))


def snapshots_fixed_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All features as known at one prediction time."""
    return asof.snapshots(source.from_orders(spark, sf_dir), at=FIXED_TIME)


def fixture_keys_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    fx = source.from_orders(spark, sf_dir).withColumn("key", F.concat_ws("|", F.col("season").cast("string"), F.col("kickoff").cast("string"), F.col("home").cast("string"), F.col("away").cast("string")))
    return fx.groupBy("league_id", "season").agg(F.count("*").alias("n"), P.key_digest(F.col("key")).alias("digest"))


def duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.duplicate_keys(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), "l_orderkey", "l_linenumber")


def iso_week_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    fx = source.from_orders(spark, sf_dir)
    return fx.groupBy(P.week_block(F.col("kickoff")).alias("block")).agg(F.count("*").alias("n"), F.min(P.iso_date(F.col("kickoff"))).alias("first_date"), F.max(P.iso_date(F.col("kickoff"))).alias("last_date"))


def season_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    fx = source.from_orders(spark, sf_dir)
    return fx.groupBy("season").agg(F.count("*").alias("n"), F.sum(F.col("is_final").cast("long")).alias("finals"), F.countDistinct(P.week_block(F.col("kickoff"))).alias("week_count"))


def team_dense_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.dense_ids(source.from_orders(spark, sf_dir))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three systems made from prices alone: model_id, key, season, block, target, p."""
    third = F.array(*[F.lit(1 / 3)] * 3)
    squared = P.normalise(F.transform("odds", lambda o: 1 / (o * o)))
    models_of = [("uniform", third), ("proportional", P.proportional(F.col("odds"))), ("sharpened", squared)]
    rows = source.odds_from_orders(spark, sf_dir)
    each = F.array(*(F.struct(F.lit(n).alias("model_id"), p.alias("p")) for n, p in models_of))
    return rows.select("key", "season", "block", "target", F.explode(each).alias("m")).select("m.model_id", "key", "season", "block", "target", "m.p")


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.score(predictions(spark, sf_dir))


def registry(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("uniform", 0, False), ("proportional", 1, True), ("sharpened", 2, True)], "model_id string, model_order int, history_only boolean")


def coverage_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = predictions(spark, sf_dir).select("model_id", "key").where("not (model_id = 'sharpened' and key % 97 = 0)")
    keys = source.odds_from_orders(spark, sf_dir).where("key % 89 <> 0").select("key")
    return scoring.coverage_gaps(rows, keys)


def _payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    fx = source.from_orders(spark, sf_dir)
    team = lambda c: F.struct((F.col(c) + 1).alias("id"), F.concat(F.lit("team "), F.col(c).cast("string")).alias("name"))
    status = F.struct(F.when(F.col("is_final"), " ft ").otherwise("NS").alias("short"))
    stamp = F.when(F.col("fixture_id") % 5 != 0, F.col("kickoff"))
    date = F.date_format(F.timestamp_seconds("kickoff"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    payload = F.struct(
        F.struct(F.when(F.col("fixture_id") % 50 != 0, F.col("fixture_id")).otherwise(F.lit(0)).alias("id"), stamp.alias("timestamp"), date.alias("date"), status.alias("status")).alias("fixture"),
        F.struct((F.col("league_id") + 1).cast("long").alias("id"), F.col("season")).alias("league"),
        F.struct(team("home").alias("home"), F.when(F.col("fixture_id") % 49 != 0, team("away")).alias("away")).alias("teams"),
        F.struct(F.col("home_goals").alias("home"), (F.col("away_goals") - F.when(F.col("fixture_id") % 47 == 0, 10).otherwise(0)).alias("away")).alias("goals"),
    )
    return fx.select(F.to_json(payload).alias("payload"))


def api_json_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, _ = ingest.parse_payloads(_payloads(spark, sf_dir))
    return good.select("fixture_id", "league_id", "season", "kickoff", "home", "away", "away_name", "status", "home_goals", "away_goals", "is_final")


def api_json_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, bad = ingest.parse_payloads(_payloads(spark, sf_dir))
    return bad.groupBy("fault").agg(F.count("*").alias("n"))


def date_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = source.orders(spark, sf_dir)
    key, at = F.col("o_orderkey"), F.col("o_orderdate")
    date = F.concat_ws("/", F.dayofmonth(at).cast("string"), F.month(at).cast("string"), F.when(key % 2 == 0, F.year(at)).otherwise(F.year(at) % 100 + F.when(F.year(at) < 2000, 0).otherwise(0)).cast("string"))
    time = F.when(key % 3 == 0, F.lit(None)).when(key % 3 == 1, F.lit(" ")).otherwise(F.concat((key % 24).cast("string"), F.lit(":05:59")))
    late = F.when((key % 2 == 0) | (F.year(at) >= 2000), 0).otherwise(100)
    return o.select(key.alias("key"), P.parse_kickoff(date, time).alias("kickoff"), late.alias("century_shift"))


def odds_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    text = F.when(key % 7 == 0, "nan").when(key % 7 == 1, "inf").when(key % 7 == 2, "").when(key % 7 == 3, "abc").when(key % 7 == 4, "1.0").otherwise(F.concat((key % 9).cast("string"), F.lit(".25")))
    return source.orders(spark, sf_dir).select(key.alias("key"), P.decimal_odds(text).alias("odds"))


def market_proportional(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source.odds_from_orders(spark, sf_dir).select("key", P.proportional(F.col("odds")).alias("p")).select("key", *_triple())


def market_shin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices are solved once for each distinct triple."""
    rows = source.odds_from_orders(spark, sf_dir).select("key", "odds")
    solved = rows.select("odds").distinct().select("odds", P.shin(F.col("odds")).alias("p"), P.shin_z(F.col("odds")).alias("z"))
    return rows.join(solved, "odds").select("key", *_triple(), _r("z").alias("z"))


def score_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scored(spark, sf_dir)
    return s.select("model_id", "key", *(_r(c).alias(c) for c in ("brier", "log_loss", "rps", "top", "fractional_hit", "argmax_hit")), F.col("bin").cast("int").alias("bin"))


def _board(board: DataFrame, *keys: str) -> DataFrame:
    return board.select(*keys, "n", "week_count", *(_r(c).alias(c) for c in scoring.METRICS))


def leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _board(scoring.leaderboard(scored(spark, sf_dir)), "model_id")


def leaderboard_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _board(scoring.season_leaderboard(scored(spark, sf_dir)), "model_id", "season", "overall")


def brier_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.ranked(scoring.leaderboard(scored(spark, sf_dir)), registry(spark)).select("model_id", "rank")


def history_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.ranked(scoring.leaderboard(scored(spark, sf_dir)), registry(spark), history_only=True).select("model_id", "rank")


def reliability_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.reliability(scored(spark, sf_dir)).select("model_id", "bin", "n", *(_r(c).alias(c) for c in ("confidence", "hit_rate", "gap")))


def top_label_ece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.top_label_ece(scored(spark, sf_dir)).select("model_id", _r("ece").alias("ece"))


def argmax_ece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.top_label_ece(scored(spark, sf_dir), "argmax_hit").select("model_id", _r("ece").alias("ece"))


def classwise_ece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.classwise_ece(scored(spark, sf_dir)).select("model_id", *(_r(c).alias(c) for c in ("ece_home", "ece_draw", "ece_away", "macro_ece")))


def confidence_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.confidence_buckets(scored(spark, sf_dir)).select("model_id", "bucket", "lower", "upper", "n", _r("confidence").alias("confidence"), _r("accuracy").alias("accuracy"))


def argmax_hit_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).groupBy("model_id").agg(_r(F.avg("argmax_hit")).alias("hit_rate"))


def invalid_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = predictions(spark, sf_dir)
    spoilt = F.when(F.col("key") % 101 == 0, F.transform("p", lambda x: x * 1.1)).when(F.col("key") % 103 == 0, F.array(F.lit(float("nan")), F.lit(0.5), F.lit(0.5))).otherwise(F.col("p"))
    return scoring.invalid_predictions(rows.withColumn("p", spoilt)).select("model_id", "key")


def paired_block_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.paired_blocks(scored(spark, sf_dir), "proportional", "brier").select("model_id", "block", _r("diff").alias("diff"), "n")


def paired_bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored(spark, sf_dir).persist()
    parts = [bootstrap.block_bootstrap(scoring.paired_blocks(rows, "proportional", m), VERSION, m, "proportional").withColumn("metric", F.lit(m)) for m in bootstrap.METRICS]
    return reduce(DataFrame.unionByName, parts)


def ablation_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = scoring.paired_blocks(scored(spark, sf_dir).where("model_id <> 'uniform'"), "proportional", "log_loss")
    return blocks.groupBy("model_id").agg(_r(F.sum("diff") / F.sum("n")).alias("mean_diff"), F.count("*").alias("blocks"))


def feature_imputation_scaling(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("balance"), F.when(F.col("c_custkey") % 5 != 0, (F.col("c_custkey") % 7).cast("double")).alias("weekday"), F.lit(None).cast("double").alias("nothing"))
    fitted = models.imputation(rows, ["balance", "weekday", "nothing"], few=0, exactly=True)
    return spark.createDataFrame([(n, *v) for n, v in fitted.items()], "feature string, median double, mean double, deviation double").select("feature", *(_r(c, 4).alias(c) for c in ("median", "mean", "deviation")))


def poisson_sufficient_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.pair_statistics(source.from_orders(spark, sf_dir).where("is_final"))


def _rated(spark: SparkSession, sf_dir: str) -> DataFrame:
    fx = source.from_orders(spark, sf_dir)
    return fx.withColumns({"home_rate": 0.5 + F.col("home") / 10, "away_rate": 0.4 + F.col("away") / 12})


def goal_rates_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = _rated(spark, sf_dir).select("home", "away", "home_rate", "away_rate").distinct()
    return rates.withColumn("p", P.poisson_outcomes(F.col("home_rate"), F.col("away_rate"))).select("home", "away", *_triple())


def dixon_coles_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = _rated(spark, sf_dir).select("home", "away", "home_rate", "away_rate").distinct()
    return rates.withColumn("p", P.poisson_outcomes(F.col("home_rate"), F.col("away_rate"), F.lit(-0.05))).select("home", "away", *_triple())


def low_score_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.low_score_cells(_rated(spark, sf_dir).where("is_final")).withColumn("coefficient", _r("coefficient"))


def isotonic_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = source.orders(spark, sf_dir)
    x = (F.col("o_custkey") % 20) / 20
    target = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    rows = o.select(F.array(x, 1 - x, x).alias("p"), target.alias("target"))
    curves = models.fit_isotonic(rows)
    return rows.select(F.get("p", F.lit(0)).alias("x")).distinct().select("x", _r(models.along(curves[0], F.col("x"))).alias("fitted"))


def _last_season(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    fx = source.from_orders(spark, sf_dir)
    last = fx.agg(F.max("season")).first()[0]
    return fx, fx.where(F.col("season") < last), fx.where(F.col("season") == last), last


def _seasons(rows: DataFrame, earlier: int = 1, matches: int = 0) -> list[int]:
    """Seasons with at least so many seasons and matches before them."""
    counts = sorted((r.season, r["count"]) for r in rows.groupBy("season").count().collect())  # seasons are few
    return [s for i, (s, _) in enumerate(counts) if i >= earlier and sum(n for _, n in counts[:i]) >= matches]


def logit_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every season that has an earlier one, predicted from all earlier ones."""
    snaps = asof.snapshots(source.from_orders(spark, sf_dir)).where("target is not null").persist()  # read by every season's fit
    parts = models.logits_by_season(snaps, _seasons(snaps), asof.FEATURES)
    return reduce(DataFrame.unionByName, parts).select("fixture_id", *_triple())


def poisson_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every season that has enough final fixtures before it for a goal model, predicted from all of them."""
    fx = source.from_orders(spark, sf_dir)
    parts = [models.poisson_probabilities(fx.where(F.col("season") < s), fx.where(F.col("season") == s)) for s in _seasons(fx.where("is_final"), 1, models.LEAST_MATCHES)]
    return reduce(DataFrame.unionByName, parts).select("fixture_id", *_triple())


def dixon_coles_rho(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Goals here do not follow the goal model, so rho is sought in a wide interval of its score's sign."""
    rated = _rated(spark, sf_dir).where("is_final")
    cells = models.low_score_cells(rated)
    return cells.agg(F.sum("n").alias("n"), *(_r(F.sum(F.col("n") * F.col("coefficient") / (1 + F.col("coefficient") * r))).alias(f"score_{i}") for i, r in enumerate((-0.05, 0.0, 0.05))))


def dixon_coles_fitted_rho(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rho of ``fit_rho`` on rates fitted to goals that follow a goal model; ``dixon_coles_rho`` has only its score, as SQL can tell it."""
    _, rho, n = models.fitted_goals(source.with_drawn_goals(source.from_orders(spark, sf_dir)).where("is_final"))
    return spark.createDataFrame([(n, rho)], "n long, rho double").select("n", _r("rho").alias("rho"))


def gbdt_oof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every season that has an earlier one, predicted once from all earlier ones by the production setting."""
    fx = source.from_orders(spark, sf_dir)
    folds = spark.createDataFrame(list(enumerate(_seasons(fx.where("is_final")))), "fold int, season int")  # every final fixture has goals, so a target
    return gbdt.fold_probabilities(asof.snapshots(fx).where("target is not null"), folds, asof.FEATURES, gbdt.BoostConfig()).select("fixture_id", "fold", *_triple())


def _examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    fx = source.from_orders(spark, sf_dir).where("is_final")
    return fx.select("fixture_id", "kickoff", (F.col("kickoff") - asof.DAY).alias("as_of"), (F.col("kickoff") + asof.DAY).alias("target_available"))


def kickoff_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backtest.kickoff_groups(_examples(spark, sf_dir))


def fold_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    examples = _examples(spark, sf_dir)
    return backtest.stage_table(examples, backtest.plan(examples))


def purge_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    examples = _examples(spark, sf_dir)
    return backtest.deal(examples, backtest.plan(examples)).groupBy("fold", "role").agg(F.count("*").alias("n"), F.min("kickoff").alias("first_kickoff"), F.max("kickoff").alias("last_kickoff"))


def _gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row of the gate's measures, on the fixtures that the plan's folds evaluate."""
    examples = _examples(spark, sf_dir)
    stages = backtest.plan(examples)
    dealt = backtest.deal(examples, stages).where("role = 'evaluate'").select(F.col("fixture_id").alias("key"), "kickoff", "fold")
    s = scored(spark, sf_dir).where("model_id = 'proportional'").join(dealt, "key")
    protocol = walkforward.PROTOCOL if backtest.is_forward(stages) else "other"
    return s.agg(F.avg("argmax_hit").alias("hitRate"), F.avg("brier").alias("brier"), F.count("*").alias("sampleCount"), F.countDistinct("fold").alias("foldCount"), F.min("kickoff").alias("evaluationStartUtc"), F.max("kickoff").alias("evaluationEndUtc"), F.lit(protocol).alias("protocol"))


def gate_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the gate asks of the metrics and is not met."""
    return backtest.metric_failures(_gated(spark, sf_dir)).select(F.explode("failures").alias("failure"))


def candidate_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All failures of the gate: metrics of the plan's folds, and the provenance that a whole revision history proves."""
    report = _gated(spark, sf_dir).first().asDict()
    fx = source.from_orders(spark, sf_dir)
    report["pointInTimeProvenance"] = provenance.proof(provenance.revisions_of(fx), fx, "1", "append-only")
    return provenance.failures_of(spark, backtest.apply_gate(spark, report, "1", "append-only"))


def provenance_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The proof of a whole revision history and of four with planted faults, with the failures that each raises."""
    fx = source.from_orders(spark, sf_dir)
    told = provenance.revisions_of(fx)
    finals = fx.where("is_final").agg(F.count("*").alias("sampleCount"), F.min("kickoff").alias("evaluationStartUtc"), F.max("kickoff").alias("evaluationEndUtc")).first().asDict()
    rows = []
    for case in ("whole", "gap", "unobserved", "late", "missing"):
        proof = provenance.proof(provenance.with_faults(told, case), fx, "1", "append-only")
        failures = backtest.provenance_failures(finals | {"pointInTimeProvenance": proof}, "1", "append-only")
        rows.append((case, *(proof[c] for c in ("fixtureCount", "revisionCount", "coverageStartUtc", "coverageEndUtc", "revisionManifestSha256")), "; ".join(failures)))
    return spark.createDataFrame(rows, "history string, fixtures long, revisions long, coverage_start long, coverage_end long, digest string, failures string")


def late_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixtures whose result, read as it was known, was another one when the league's features first counted it."""
    fx = source.from_orders(spark, sf_dir)
    found = provenance.faults(provenance.with_faults(provenance.revisions_of(fx), "late"), fx)
    return found.where("unreplayable").select("fixture_id", "n", "kickoff")


def coverage_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.coverage_samples(coverage_anti_join(spark, sf_dir))


def best_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.best(scoring.leaderboard(scored(spark, sf_dir)), registry(spark)).select("model_id", _r("brier").alias("brier"))


def final_fit_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where training ends and calibration begins when all examples are used."""
    examples = _examples(spark, sf_dir)
    config, total = backtest.PlanConfig(), examples.count()
    raw_end, calibration_start = backtest.final_fit(examples, config.least_train, max(config.least_calibration, int(total * 0.10)))
    return spark.createDataFrame([(raw_end, calibration_start, total)], "raw_end long, calibration_start long, rows long")


def season_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Season files written from all final fixtures, read back, numbered, and joined with their snapshots."""
    fx = source.from_orders(spark, sf_dir).where("is_final")
    odds = source.odds_from_orders(spark, sf_dir).select(F.col("key").alias("fixture_id"), "odds")
    name = lambda c: F.format_string("L%d T%02d", "league_id", c)
    at = F.timestamp_seconds("kickoff")
    result = F.when(F.col("home_goals") > F.col("away_goals"), "H").when(F.col("home_goals") == F.col("away_goals"), "D").otherwise("A")
    lines = fx.join(odds, "fixture_id").select("season", "fixture_id", F.date_format(at, "d/M/yyyy").alias("Date"), F.date_format(at, "HH:mm").alias("Time"), name("home").alias("HomeTeam"), name("away").alias("AwayTeam"), F.col("home_goals").alias("FTHG"), F.col("away_goals").alias("FTAG"), result.alias("FTR"), *(F.get("odds", F.lit(i)).alias(c) for i, c in enumerate(ingest.ODDS)))
    home = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    lines.repartition("season").sortWithinPartitions("season", "fixture_id").drop("fixture_id").write.partitionBy("season").csv(home, header=True)
    years = _seasons(fx, 0)
    read = [ingest.read_season(spark, f"{home}/season={y}", f"{y}/{(y + 1) % 100:02d}", i, True) for i, y in enumerate(years)]
    found = seasons.examples(ingest.number_matches(reduce(DataFrame.unionByName, read)))
    return found.select("fixture_id", "key", "season_name", "block", "target", "home_points_sum_5", "away_points_sum_5", "h2h_home_points_sum_5", "home_rest_days", "away_rest_days", _r(F.get("closing_odds", F.lit(0))).alias("home_price"))


def half_even_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ties of the third decimal, m / 16 and its kind, and their neighbours a 2^-20 of a unit away, rounded as their exact value lies."""
    key = F.col("o_orderkey")
    tie = (key % 4001 - 2000).cast("double") / 16
    near = tie + (key % 3 - 1).cast("double") / (1 << 20)
    return source.orders(spark, sf_dir).select(key.alias("key"), exact.half_even(near, 3).alias("third"), exact.half_even(near, 2).alias("second"), exact.half_even(tie, 1).alias("first"))


def exact_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantiles of every fixture's stake and of the line prices, by histogram refinement."""
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_extendedprice").alias("price"), F.when(F.col("l_quantity") > 10, F.col("l_quantity")).alias("quantity"), (F.col("l_extendedprice") * F.col("l_discount")).alias("rebate"))
    shares = [0.0, 0.025, 0.25, 0.5, 0.975, 1.0]
    found = exact.exact_quantiles(line, line.columns, shares)
    return spark.createDataFrame([(c, q, x) for c, xs in found.items() for q, x in zip(shares, xs, strict=True)], "name string, share double, value double").withColumn("value", _r("value"))


def evaluation_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scoring.bundle(scored(spark, sf_dir))
    return rows.select("model_id", "n", *(_r(c).alias(c) for c in ("brier", "log_loss", "hit_rate", "ece")), F.size(F.filter("buckets", lambda b: b["n"] > 0)).cast("long").alias("used_buckets"))


def match_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of each fixture in the global order (kickoff, home, away, id), by running totals instead of one sort in one task."""
    fx = source.from_orders(spark, sf_dir)
    return running(fx, "kickoff", ["kickoff", "home", "away", "fixture_id"], {"place": ("sum", F.lit(1))}).select("fixture_id", "place")


def fold_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    fx = source.with_drawn_goals(source.from_orders(spark, sf_dir))
    rows = systems.fold_diagnostics(fx, _seasons(fx.where("is_final"), 2, models.LEAST_MATCHES))
    return rows.withColumn("rho", _r("rho"))


def walk_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of the whole backtest by fold and pooled (fold null), raw and calibrated, with the gate's verdict."""
    fx = source.with_drawn_goals(source.from_orders(spark, sf_dir)).persist()  # goals are drawn once
    done = walkforward.run(asof.snapshots(fx).where("target is not null"), asof.FEATURES)
    verdict = F.lit("; ".join(done.report["gate"]["failures"]))
    return done.folds.select("model_id", "fold", "n", "first_kickoff", "last_kickoff", *(_r(c).alias(c) for c in ("brier", "log_loss", "argmax_hit")), verdict.alias("gate_failures"))


def record_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scored(spark, sf_dir)
    boards = scoring.season_leaderboard(s)
    parts = {"model": boards.where("overall = 1").drop("season", "overall"), "season": boards.where("overall = 0"), "reliability": scoring.reliability(s), "difference": scoring.paired_blocks(s, "proportional", "brier").groupBy("model_id").agg((F.sum("diff") / F.sum("n")).alias("point"))}
    records = publish.record_union(parts)
    return records.groupBy("record_type").agg(F.count("*").alias("n"), F.countDistinct("model_id").alias("model_count"), F.count("season").alias("with_season"), F.count("point").alias("with_point"))


def weekly_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The streaming aggregate by ISO week, on a table instead of a stream."""
    return live_form.weekly_results(source.from_orders(spark, sf_dir))


def _replayed(spark: SparkSession, sf_dir: str, answers: Callable[..., DataFrame], schema: str) -> DataFrame:
    """What a stream of all announcements and results answers, run over files under the shared folder."""
    home = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    files = spark.sparkContext.defaultParallelism
    delay = pending.store_feed(pending.messages(source.from_orders(spark, sf_dir)), f"{home}/feed", files=files)
    pending.replay(spark, f"{home}/feed", partial(answers, delay=delay), f"{home}/out", f"{home}/marks", files=files)
    return spark.read.schema(schema).parquet(f"{home}/out")


def stream_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The form that timers answer at each question's time: the rows of asof_points and asof_goals."""
    form = _replayed(spark, sf_dir, pending.form_answers, pending.TeamForm.OUT)
    return asof.by_side(form.withColumn("seen", F.struct("points", "scored", "conceded")), asof.form_columns())


def stream_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rating differences that timers answer at each question's time: the rows of elo_ratings."""
    return _replayed(spark, sf_dir, pending.rating_answers, pending.LeagueRatings.OUT).select("fixture_id", "elo_diff_home_adv")


def season_training_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many final fixtures of earlier seasons train each season's systems, and how many it is evaluated on."""
    finals = source.from_orders(spark, sf_dir).where("is_final").groupBy("season").agg(F.count("*").alias("evaluated"))
    earlier = Window.orderBy("season").rowsBetween(Window.unboundedPreceding, -1)  # one row per season
    return finals.withColumn("trained", F.coalesce(F.sum("evaluated").over(earlier), F.lit(0)))


def cold_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixtures of the last season by whether the goal model has seen both teams; it is fitted here without the two last teams."""
    _, past, now, _ = _last_season(spark, sf_dir)
    known = past.where("is_final and home < 18 and away < 18")
    model = models.fit_goals(models.pair_statistics(known).collect())  # one row per ordered pair of teams
    return models.goal_rates(now, model).groupBy("cold_start").agg(F.count("*").alias("n"))


def systems_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ten systems with their ranks, on every season before which another one has out-of-fold predictions to calibrate on."""
    fx = source.with_drawn_goals(source.from_orders(spark, sf_dir)).persist()  # goals are drawn once
    odds = source.odds_from_orders(spark, sf_dir).select(F.col("key").alias("fixture_id"), "odds")
    rows = systems.predict_all(fx, odds, _seasons(fx.where("is_final"), 2, models.LEAST_MATCHES), gbdt.BoostConfig(), 1)
    truth = fx.select("fixture_id", P.week_block(F.col("kickoff")).alias("block"), P.outcome(F.col("home_goals"), F.col("away_goals")).alias("target"))
    board = scoring.leaderboard(scoring.score(rows.join(truth, "fixture_id")))
    return scoring.ranked(board, systems.registry(spark)).select("model_id", "rank", "n", "week_count", *(_r(c).alias(c) for c in scoring.METRICS))


QUERIES = {
    f.__name__: f
    for f in (
        asof_points,
        asof_goals,
        asof_venue,
        asof_h2h,
        asof_rest_days,
        asof_prior,
        asof_source_max,
        asof_fixed_timestamp,
        elo_ratings,
        feature_snapshots,
        snapshots_fixed_time,
        fixture_keys_digest,
        duplicate_keys,
        iso_week_blocks,
        season_counts,
        team_dense_ids,
        coverage_anti_join,
        api_json_parse,
        api_json_quarantine,
        date_parse,
        odds_filter,
        market_proportional,
        market_shin,
        score_rows,
        leaderboard,
        leaderboard_grouping_sets,
        brier_rank,
        history_rank,
        reliability_bins,
        top_label_ece,
        argmax_ece,
        classwise_ece,
        confidence_buckets,
        argmax_hit_rate,
        invalid_predictions,
        paired_block_sums,
        paired_bootstrap_ci,
        ablation_diff,
        feature_imputation_scaling,
        poisson_sufficient_stats,
        goal_rates_outcomes,
        dixon_coles_shift,
        low_score_cells,
        isotonic_fit,
        logit_predict,
        poisson_fit,
        dixon_coles_rho,
        dixon_coles_fitted_rho,
        gbdt_oof,
        kickoff_groups,
        fold_plan,
        purge_counts,
        gate_report,
        candidate_gate,
        provenance_cases,
        late_corrections,
        walk_forward,
        coverage_samples,
        best_history,
        final_fit_rows,
        season_examples,
        half_even_ties,
        exact_quantiles,
        evaluation_bundle,
        match_order,
        fold_diagnostics,
        record_union,
        weekly_results,
        stream_form,
        stream_ratings,
        season_training_rows,
        cold_starts,
        systems_board,
    )
}
ORACLES = oracles.ORACLES
