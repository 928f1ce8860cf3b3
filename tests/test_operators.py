import heapq
import json
import math
import random
import subprocess

import numpy as np
import pytest
from pyspark.sql import functions as F

from touchline.functions import probability as P
from touchline.operators import asof, backtest, bootstrap, elo, gbdt, models, provenance, publish, scoring, seasons, systems, walkforward
from touchline.plans import catalog
from touchline.sources import ingest
from touchline.streaming.live_form import live_form, weekly_results

FIXTURE = "fixture_id long, league_id int, season int, kickoff long, home long, away long, home_goals long, away_goals long, is_final boolean"


def league(n=300, seed=1, teams=8, hour=3600):
    """Fixtures with same-time groups, rounds nearer than the gap, exact-gap pairs and unfinished ones."""
    rng, rows, now = random.Random(seed), [], 1_500_000_000
    for i in range(n):
        now += rng.choice([0, 0, hour, 86_400, 172_800, 172_801, 40 * 86_400])
        h, a = rng.sample(range(teams), 2)
        rows.append((1000 + i, i % 2, 2000 + i * 4 // n, now, h, a, rng.randint(0, 4), rng.randint(0, 3), rng.random() > 0.1))
    return rows


def points(g, c):
    return 3 if g > c else 1 if g == c else 0


def simulate(rows, cfg=asof.AsOfConfig(), at=None):
    """Batch by batch with a queue of pending results."""
    out = {}
    for lg in {r[1] for r in rows}:
        own = sorted((r for r in rows if r[1] == lg), key=lambda r: (r[3], r[0]))
        queue, past, rating, season = [], [], {}, None
        for ko in sorted({r[3] for r in own}):
            batch = [r for r in own if r[3] == ko]
            as_of = at if at is not None and ko > at else ko - cfg.lead
            while queue and queue[0][0] < as_of:
                r = heapq.heappop(queue)[3]
                past.append(r)
                rh, ra = rating.get(r[4], cfg.elo_base), rating.get(r[5], cfg.elo_base)
                e = 1 / (1 + 10 ** (-((rh + cfg.home_advantage) - ra) / 400))
                d = cfg.elo_k * ((1 if r[6] > r[7] else 0.5 if r[6] == r[7] else 0) - e)
                rating[r[4]], rating[r[5]] = rh + d, ra - d
            s = min(r[2] for r in batch)
            if season is not None and s > season:
                rating = {t: cfg.elo_base + cfg.season_carry * (x - cfg.elo_base) for t, x in rating.items()}
            season = s
            for r in batch:
                def games(team, venue=None, opponent=None):
                    found = []
                    for p in past:
                        for t, o, home, g, c in ((p[4], p[5], True, p[6], p[7]), (p[5], p[4], False, p[7], p[6])):
                            if t == team and venue in (None, home) and opponent in (None, o):
                                found.append((points(g, c), g, c, p[3]))
                    return found[-cfg.window :]

                total = lambda gs, k: float(sum(x[k] for x in gs)) if gs else None
                h, a = games(r[4]), games(r[5])
                hh, aa, hth = games(r[4], True), games(r[5], False), games(r[4], None, r[5])
                rest = lambda gs: round(min((ko - gs[-1][3]) / 86_400, 30.0), 6) if gs else None
                diff = lambda gs: total(gs, 1) - total(gs, 2) if gs else None
                elo_diff = round(rating.get(r[4], cfg.elo_base) + cfg.home_advantage - rating.get(r[5], cfg.elo_base), 8)
                out[r[0]] = [total(h, 0), total(a, 0), total(h, 1), total(h, 2), total(a, 1), total(a, 2), total(hh, 0), diff(hh), total(aa, 0), diff(aa), elo_diff, total(hth, 0), rest(h), rest(a)]
            for r in batch:
                if r[8]:
                    heapq.heappush(queue, (ko + cfg.lag, ko, r[0], r))
    return out


def test_snapshots_agree_with_simulation(spark):
    rows = league()
    got = asof.snapshots(spark.createDataFrame(rows, FIXTURE).repartition(5)).collect()
    want = simulate(rows)
    assert len(got) == len(rows)
    for r in got:
        mine = [r[c] for c in asof.FEATURES]
        assert all(x == y or x is not None and y is not None and math.isclose(x, y, abs_tol=1e-6) for x, y in zip(mine, want[r.fixture_id], strict=True)), (r.fixture_id, mine, want[r.fixture_id])
        assert r.source_max < r.as_of


def test_fixed_prediction_time(spark):
    rows = league(160, seed=4)
    at = sorted(r[3] for r in rows)[90] + 7
    form = asof.by_side(asof.form_at(spark.createDataFrame(rows, FIXTURE), at), asof.form_columns())
    want = simulate(rows, at=at)
    for r in form.collect():
        assert [r[c] for c in asof.FEATURES[:6]] == want[r.fixture_id][:6]


def test_future_results_change_nothing(spark):
    rows = league(120, seed=7)
    cut = rows[80][3]
    changed = [(*r[:6], 9, 0, r[8]) if r[3] > cut else r for r in rows]
    a, b = (asof.snapshots(spark.createDataFrame(x, FIXTURE)).where(F.col("kickoff") <= cut).drop("target").collect() for x in (rows, changed))
    assert sorted(map(tuple, a), key=str) == sorted(map(tuple, b), key=str)


def test_seasons_must_not_go_back(spark):
    rows = [(1, 0, 2001, 1_000_000, 1, 2, 0, 0, True), (2, 0, 2000, 9_000_000, 1, 2, 0, 0, True)]
    with pytest.raises(Exception, match="season"):
        elo.elo_snapshots(spark.createDataFrame(rows, FIXTURE)).collect()
    with pytest.raises(ValueError):
        asof.AsOfConfig(window=0)


def test_edge_of_the_gap(spark):
    base = (1, 0, 2000, 1_000_000, 1, 2, 3, 0, True)
    for gap, seen in ((172_800, None), (172_801, 3.0)):
        rows = [base, (2, 0, 2000, 1_000_000 + gap, 1, 3, 0, 0, True)]
        got = {r.fixture_id: r.home_points_sum_5 for r in asof.by_side(asof.team_form(spark.createDataFrame(rows, FIXTURE)), asof.form_columns()).collect()}
        assert got[2] == seen


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(n) for n, c in columns.items())).first()


def test_golden_values(spark):
    odds = F.array(*map(F.lit, (2.1, 3.4, 3.6)))
    r = one(spark, a=P.proportional(odds), b=P.shin(odds), z=P.shin_z(odds), fair=P.shin_z(F.array(*map(F.lit, (3.0, 3.0, 3.0)))))
    assert np.allclose(r.a, [0.454342984, 0.280623608, 0.265033408], atol=1e-9)
    assert np.allclose(r.b, [0.458665716, 0.278737637, 0.262596647], atol=1e-9) and math.isclose(r.z, 0.024082837, abs_tol=1e-9)
    assert r.fair == 0
    with pytest.raises(Exception, match="underround"):
        one(spark, under=P.shin_z(F.array(*map(F.lit, (4.0, 4.0, 4.0)))))
    rates = (F.lit(1.6), F.lit(1.1))
    r = one(spark, a=P.poisson_outcomes(*rates), b=P.poisson_outcomes(*rates, F.lit(-0.05)))
    assert np.allclose(r.a, [0.489573537, 0.248910981, 0.261515482], atol=1e-9) and np.allclose(r.b, [0.483659452, 0.260739151, 0.255601397], atol=1e-9)
    p = F.array(*map(F.lit, (0.5, 0.3, 0.2)))
    for y, brier, loss, rps in ((0, 0.126666667, 0.693147181, 0.145), (1, 0.26, 1.203972804, 0.145), (2, 0.326666667, 1.609437912, 0.445)):
        r = one(spark, b=P.brier(p, F.lit(y)), l=P.log_loss(p, F.lit(y)), r=P.ranked_probability_score(p, F.lit(y)))
        assert np.allclose([r.b, r.l, r.r], [brier, loss, rps], atol=1e-8)
    third = F.array(*[F.lit(1 / 3)] * 3)
    r = one(spark, f=P.fractional_hit(third, F.lit(2)), s=P.argmax_hit(third, F.lit(0)), n=P.argmax_hit(third, F.lit(1)))
    assert math.isclose(r.f, 1 / 3) and (r.s, r.n) == (1, 0)
    r = one(spark, a=P.parse_kickoff(F.lit("13/08/16"), F.lit(None).cast("string")), b=P.parse_kickoff(F.lit("05/08/2022"), F.lit("20:00")), w=P.week_block(F.lit(1471089600)))
    assert (r.a, r.b, r.w) == (1471089600, 1659729600, "2016-08-08")
    keys = spark.createDataFrame([("b",), ("a",), ("a",)], "k string")
    assert keys.agg(P.key_digest(F.col("k"))).first()[0] == "911169ddaaf146aff539f58c26c489af3b892dff0fe283c1c264c65ae5aa59a2"
    texts = spark.createDataFrame([("1.0",), ("nan",), ("inf",), ("",), ("abc",), ("1.01",)], "o string")
    assert [r[0] for r in texts.select(P.decimal_odds(F.col("o"))).collect()] == [None] * 5 + [1.01]
    edges = spark.createDataFrame([(i / 10,) for i in range(11)] + [(math.nextafter(i / 10, 0),) for i in range(1, 10)], "x double")
    assert [r[0] for r in edges.select(P.bin_of(F.col("x"))).collect()] == [*range(10), 9, *range(9)]


def test_bootstrap_draws_one_stream():
    x, stream = 993330851, []
    for _ in range(3):
        x ^= x << 13 & 0xFFFFFFFF
        x ^= x >> 17
        x ^= x << 5 & 0xFFFFFFFF
        stream.append(x)
    assert stream == [3888398643, 2476789378, 3295263994]
    rng = np.random.default_rng(0)
    diff, n = rng.normal(0, 1, 23), rng.integers(1, 9, 23).astype(float)
    got = bootstrap.replicate_means(diff, n, 993330851, 40)
    state, want = 993330851, []
    for _ in range(40):
        picks = []
        for _ in range(23):
            state ^= state << 13 & 0xFFFFFFFF
            state ^= state >> 17
            state ^= state << 5 & 0xFFFFFFFF
            picks.append(int(state / 4294967296 * 23))
        want.append(diff[picks].sum() / n[picks].sum())
    assert np.allclose(got, want)


def test_bootstrap_needs_blocks(spark):
    few = spark.createDataFrame([("m", str(i), 0.1, 2) for i in range(5)], "model_id string, block string, diff double, n long")
    with pytest.raises(Exception, match="blocks"):
        bootstrap.block_bootstrap(few, "v", "brier", "r").collect()


def goals_league(n=900, seed=5):
    rng = np.random.default_rng(seed)
    strength = rng.normal(0, 0.3, (10, 2))
    rows = []
    for i in range(n):
        h, a = rng.choice(10, 2, replace=False)
        lh, la = math.exp(0.4 + strength[h, 0] - strength[a, 1]), math.exp(0.1 + strength[a, 0] - strength[h, 1])
        rows.append((i, 0, 2000 + i // 300, 1_000_000_000 + i * 90_000, int(h), int(a), int(rng.poisson(lh)), int(rng.poisson(la)), True))
    return rows


def test_goal_model_is_optimal(spark):
    rows = goals_league()
    df = spark.createDataFrame(rows, FIXTURE)
    pairs = models.pair_statistics(df).collect()
    fitted = models.fit_goals(pairs)
    t, b = len(fitted.teams), fitted.beta
    gradient = np.concatenate([models.GLOBAL_RIDGE * b[:2], models.RIDGE * b[2:]])
    for r in rows:
        for own, other, adv, y in ((r[4], r[5], 1, r[6]), (r[5], r[4], 0, r[7])):
            x = np.zeros(2 + 2 * t)
            x[[0, 2 + own]], x[1], x[2 + t + other] = 1, adv, -1
            gradient += (math.exp(x @ b) - y) * x
    assert np.abs(gradient).max() < 1e-5
    p = [r.p for r in models.poisson_probabilities(df, df.limit(20).unionByName(spark.createDataFrame([(9999, 0, 2003, 1, 77, 1, 0, 0, False)], FIXTURE)), with_shift=False).collect()]
    assert len(p) == 21 and all(math.isclose(sum(x), 1, abs_tol=1e-9) for x in p)
    with pytest.raises(ValueError):
        models.fit_goals(pairs[:3])


def test_logit_is_optimal(spark):
    rng = np.random.default_rng(12)
    x = rng.normal(0, 1, (400, 2))
    y = np.array([rng.choice(3, p=np.exp(v) / np.exp(v).sum()) for v in np.stack([x[:, 0], 0 * x[:, 0], -x[:, 1]], 1)])
    rows = [(*map(float, v), int(t)) for v, t in zip(x, y, strict=True)]
    df = spark.createDataFrame(rows, "a double, b double, target int").repartition(5)
    w = models.fit_logit(df, ["a", "b"], c=2.0)
    full = np.column_stack([np.ones(400), x])
    p = np.exp(full @ w.T) / np.exp(full @ w.T).sum(axis=1, keepdims=True)
    gradient = (p - np.eye(3)[y]).T @ full + np.column_stack([np.zeros(3), w[:, 1:] / 2.0])
    assert np.abs(gradient).max() < 1e-6
    missing = spark.createDataFrame([(1, None, 0.5, 9), (2, 0.1, None, 9)], "id int, a double, b double, p_old int")
    out = models.logit_probabilities(df, missing, ["a", "b"]).collect()
    assert [r.id for r in sorted(out)] == [1, 2] and all(math.isclose(sum(r.p), 1) for r in out)
    with pytest.raises(ValueError):
        models.logit_probabilities(df.where("target < 2"), missing, ["a", "b"])


def test_rho_is_a_root():
    rng = np.random.default_rng(2)
    c, n = np.concatenate([-rng.uniform(1, 2, 30), rng.uniform(1, 2, 40)]), np.full(70, 2.0)
    rho = models.fit_rho(c, n, [(1.2, 1.1)])
    assert abs((n * c / (1 + c * rho)).sum()) < 1e-6
    with pytest.raises(ValueError):
        models.fit_rho(c[:3], n[:3], [(1.2, 1.1)])


def test_isotonic_curves_and_calibration(spark):
    rng = np.random.default_rng(3)
    raw = rng.dirichlet([2, 2, 2], 400)
    y = [int(rng.choice(3, p=x)) for x in raw]
    df = spark.createDataFrame([(x.tolist(), t) for x, t in zip(raw, y, strict=True)], "p array<double>, target int")
    curves = models.fit_isotonic(df)
    for curve in curves:
        ys = [v for _, v in curve]
        assert ys == sorted(ys)
    out = df.select(models.calibrate(F.col("p"), curves).alias("q")).collect()
    assert all(math.isclose(sum(r.q), 1, abs_tol=1e-9) and min(r.q) > 0 for r in out)
    single = models.fit_isotonic(spark.createDataFrame([([0.2, 0.3, 0.5], 1)] * 3, "p array<double>, target int"))
    assert [c[0][1] for c in single] == [0.0, 1.0, 0.0]


def test_boosting_learns_and_handles_missing_values(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(0, 1, (900, 4))
    y = np.where(x[:, 0] + 0.3 * rng.normal(size=900) > 0.4, 0, np.where(x[:, 1] > 0, 1, 2))
    x[rng.random(x.shape) < 0.1] = np.nan
    rows = [(i, 2000 + i // 300, int(t), *(None if np.isnan(v) else float(v) for v in f)) for i, (f, t) in enumerate(zip(x, y, strict=True))]
    df = spark.createDataFrame(rows, "fixture_id long, season int, target int, a double, b double, c double, d double")
    folds = spark.createDataFrame([(0, 2000), (1, 2001), (2, 2002)], "fold int, season int")
    out = gbdt.fold_probabilities(df, folds, ["a", "b", "c", "d"], gbdt.BoostConfig(rounds=40, rate=0.1)).collect()
    assert sorted(r.fixture_id for r in out) == list(range(300, 900))
    last = {r.fixture_id: r.p for r in out if r.fold == 2}
    assert all(math.isclose(sum(p), 1) for p in last.values())
    assert np.mean([np.argmax(p) == y[i] for i, p in last.items()]) > 0.75
    dealt = df.withColumns({"fold": F.lit(0), "trains": F.col("season") < 2002})
    halves = gbdt.dealt_probabilities(dealt, ["a", "b", "c", "d"], gbdt.BoostConfig(rounds=40, rate=0.1), slice_rows=300).collect()
    assert len(halves) == 300 and np.mean([np.argmax(r.p) == y[r.fixture_id] for r in halves]) > 0.7


def test_trees_lower_the_loss_and_keep_leaves_large():
    rng = np.random.default_rng(6)
    x = rng.normal(0, 1, (500, 3))
    y = (x[:, 0] > 0).astype(int) + (x[:, 1] > 0.5)
    c = gbdt.BoostConfig(rounds=30, rate=0.1, least_rows=40, leaves=6)
    bins = gbdt.binned(x, [np.quantile(x[:, j], np.linspace(0, 1, 33)[1:-1]) for j in range(3)])
    base, trees = gbdt.boost(bins, y, c)
    f, losses = np.tile(base, (500, 1)), []
    for t, nodes in enumerate(trees):
        assert (nodes[:, 0] < 0).sum() <= c.leaves
        value = gbdt.leaf_values(nodes, bins)
        f[:, t % 3] += c.rate * value
        if t % 3 == 2:
            losses.append(-np.log(gbdt.softmax(f)[np.arange(500), y]).mean())
    assert losses[-1] < 0.7 * losses[0]
    one = gbdt.grow(bins, np.arange(500), (y == 0) - 0.3, np.full(500, 0.2), np.arange(3), int(bins.max()) + 2, c)
    assert min(np.unique(gbdt.leaf_values(one, bins), return_counts=True)[1]) >= c.least_rows


def _plain_tree(bins, rows, g, h, columns, c):
    """Growth with one histogram a feature and child, and each row's value by the leaf that it ends in."""
    worth = lambda a, b: np.maximum(np.abs(a) - c.l1, 0) ** 2 / (b + c.l2)

    def best(own):
        found = (1e-9,)
        for j in columns:
            for last in range(1, int(bins[:, j].max()) + 1):
                for missing_left in (False, True):
                    left = np.where(bins[own, j] == 0, missing_left, bins[own, j] <= last)
                    if min(left.sum(), (~left).sum()) < c.least_rows:
                        continue
                    gain = sum(worth(g[s].sum(), h[s].sum()) for s in (own[left], own[~left])) - worth(g[own].sum(), h[own].sum())
                    if gain > found[0] + 1e-9:
                        found = (gain, own[left], own[~left])
        return found, own

    leaves = [best(rows)]
    while len(leaves) < c.leaves and max(f[0] for f, _ in leaves) > 1e-9:
        at = max(range(len(leaves)), key=lambda i: leaves[i][0][0])
        (_, left, right), _ = leaves.pop(at)
        leaves += [best(left), best(right)]
    out = np.full(len(bins), np.nan)
    for _, own in leaves:
        total = g[own].sum()
        out[own] = -np.sign(total) * max(abs(total) - c.l1, 0) / (h[own].sum() + c.l2)
    return out


def test_joint_cells_grow_and_evaluate_trees_as_single_features_do(monkeypatch):
    rng = np.random.default_rng(11)
    bins = np.stack([rng.integers(0, k, 1200) for k in (5, 9, 3, 7, 4)], 1)
    bins[:, 0] = np.maximum(bins[:, 0], 1)  # never missing
    g, h, rows, columns = rng.normal(0, 1, 1200) + (bins[:, 1] > 4) - (bins[:, 3] == 0), rng.random(1200) + 0.1, np.sort(rng.choice(1200, 900, replace=False)), np.array([0, 1, 3, 4])
    for least, leaves in ((35, 12), (5, 50)):
        c = gbdt.BoostConfig(leaves=leaves, least_rows=least)
        nodes = gbdt.grow(bins, rows, g, h, columns, int(bins.max()) + 2, c)
        for most in (1, 60, 1 << 13):
            monkeypatch.setattr(gbdt, "CELLS", most)
            monkeypatch.setattr(gbdt, "CELL_ROWS", 1)
            held = gbdt.Cells(bins)
            assert len(held.groups) == {1: 5, 60: 3, 1 << 13: 2}[most]
            assert (held.values(nodes) == gbdt.leaf_values(nodes, bins)).all()
            assert (held.values(nodes, rows) == gbdt.leaf_values(nodes, bins[rows])).all()
            again = gbdt.grow(bins, rows, g, h, columns, int(bins.max()) + 2, c)  # an empty bin may lie on either side of a cut
            assert np.allclose(gbdt.leaf_values(again, bins)[rows], gbdt.leaf_values(nodes, bins)[rows], atol=1e-5)
        if leaves == 12:
            assert np.allclose(gbdt.leaf_values(nodes, bins)[rows], _plain_tree(bins, rows, g, h, columns, c)[rows], atol=1e-5)
    assert (nodes[:, 0] < 0).sum() > gbdt.MASK_LEAVES  # both ways of evaluation were taken


def test_a_row_is_scored_by_a_bounded_number_of_models(spark):
    rng = np.random.default_rng(12)
    rows = [(i, i >= 2000, int(k), float(x), float(z)) for i, (k, x, z) in enumerate(zip(rng.integers(0, 3, 2600), rng.normal(0, 1, 2600), rng.normal(0, 1, 2600), strict=True))]
    df = spark.createDataFrame([(0, not late, i, k, x + k, z) for i, late, k, x, z in rows], "fold int, trains boolean, fixture_id long, target int, a double, b double")
    c = gbdt.BoostConfig(rounds=3, least_rows=5)
    models, edges, slices = gbdt.grown(df.where("trains"), ["a", "b"], c, slice_rows=50)
    kept = sorted(models.collect(), key=lambda r: r.slice)
    assert [r.slice for r in kept] == list(range(gbdt.SLICES)) and slices.first().slices == gbdt.SLICES < 2000 // 50
    asked = df.where("not trains")
    for part_rows in (100, 10_000):
        found = {r.fixture_id: r.p for r in gbdt.boosted_probabilities(asked, spark.createDataFrame(kept, gbdt.MODELS), edges, slices, ["a", "b"], c, part_rows).collect()}
        assert len(found) == 600
        for r in asked.limit(50).collect():
            bins, f = gbdt.binned(np.array([[r.a, r.b]]), edges[0]), np.zeros(3)
            for m in kept:
                nodes, at = np.frombuffer(m.nodes, np.float32).reshape(-1, 6), 0
                f += np.array(m.base) / len(kept)
                for t, n in enumerate(m.lengths):
                    f[t % 3] += c.rate * gbdt.leaf_values(nodes[at : at + n], bins)[0] / len(kept)
                    at += n
            assert np.allclose(found[r.fixture_id], np.exp(f) / np.exp(f).sum())


def test_all_systems_cover_the_same_keys(spark):
    rows = goals_league(1500, seed=8)
    fx = spark.createDataFrame(rows, FIXTURE)
    odds = fx.select("fixture_id", F.array(F.lit(2.0), 3.0 + F.col("home") / 10, F.lit(3.9)).alias("odds"))
    out = systems.predict_all(fx, odds, [2003, 2004], gbdt.BoostConfig(rounds=5)).collect()
    by = {}
    for r in out:
        assert math.isclose(sum(r.p), 1, abs_tol=1e-6)
        by.setdefault(r.model_id, set()).add(r.fixture_id)
    assert by.keys() == {m for m, *_ in systems.REGISTRY} == {r.model_id for r in systems.registry(spark).collect()}
    assert len({frozenset(v) for v in by.values()}) == 1 and len(by["prior"]) == 600
    kept = spark.createDataFrame(out).join(fx.select("fixture_id", P.week_block(F.col("kickoff")).alias("block"), P.outcome(F.col("home_goals"), F.col("away_goals")).alias("target")), "fixture_id")
    found = systems.intervals(scoring.score(kept.withColumn("key", F.col("fixture_id"))).persist(), "v", 50).collect()
    assert len(found) == 27 + 3 and all(r.low <= r.high for r in found)
    assert {(r.metric, r.reference) for r in found} == {(m, k) for m in bootstrap.METRICS for k in ("market_shin", "boosted_raw")}
    notes = systems.fold_diagnostics(fx, [2003, 2004]).collect()
    assert [(r.season, r.training_seasons, r.training_matches, r.teams, r.cold_starts) for r in notes] == [(2003, 3, 900, 10, 0), (2004, 4, 1200, 10, 0)]
    assert all(abs(r.rho) < 0.25 and r.low_scores >= 25 for r in notes)


def test_walk_forward_reports_every_fold(spark):
    fx = spark.createDataFrame(goals_league(1500, seed=9), FIXTURE)
    snaps = asof.snapshots(fx).where("target is not null")
    done = walkforward.run(snaps, asof.FEATURES, boost=gbdt.BoostConfig(rounds=5))
    sizes = {(r.fold, r.role): r.to_row - r.from_row for r in done.stages}
    rows = done.predictions.collect()
    assert len(rows) == sum(n for (_, role), n in sizes.items() if role == "evaluate") == done.report["sampleCount"]
    assert all(math.isclose(sum(r.p), 1, abs_tol=1e-9) and math.isclose(sum(r.raw), 1, abs_tol=1e-9) for r in rows)
    assert {(r.model_id, r.fold) for r in done.folds.collect()} == {(m, k) for m in ("boosted_raw", "boosted_isotonic") for k in (None, 0, 1, 2)}
    assert done.report["protocol"] == "walk-forward" and done.report["foldCount"] == 3 and sum(b["n"] for b in done.report["confidenceBuckets"]) == len(rows)
    assert "pointInTimeProvenance is required" in done.report["gate"]["failures"]
    assert done.report["finalFit"]["rawEnd"] <= done.report["finalFit"]["calibrationStart"]


def test_fold_plan_is_purged(spark):
    rows = [(i, 1_000_000 + (i // 3) * 50_000) for i in range(1500)]
    df = spark.createDataFrame(rows, "fixture_id long, kickoff long").select("fixture_id", "kickoff", (F.col("kickoff") - 86_400).alias("as_of"), (F.col("kickoff") + 86_400).alias("target_available"))
    stages = backtest.plan(df)
    by = {(r.fold, r.role): r for r in stages}
    assert len(stages) == 9 and by[2, "evaluate"].to_row == 1500 and backtest.is_forward(stages)
    known = lambda n: max(k + 86_400 for i, k in rows if i < n)
    for i in range(3):
        train, calibrate, evaluate = (by[i, role] for role in ("train", "calibrate", "evaluate"))
        assert train.from_row == 0 and known(train.to_row) < rows[calibrate.from_row][1] - 86_400
        assert known(calibrate.to_row) < rows[evaluate.from_row][1] - 86_400
        assert train.to_row >= 525 and 150 <= calibrate.to_row - calibrate.from_row < 153
        assert calibrate.purged == calibrate.from_row - train.to_row and evaluate.purged == evaluate.from_row - calibrate.to_row
        # No later boundary would have been safe.
        assert not known(calibrate.to_row + 3) < rows[evaluate.from_row][1] - 86_400
        assert i == 2 or by[i + 1, "evaluate"].from_row == evaluate.to_row
    dealt = {(r.fold, r.role): r["count"] for r in backtest.deal(df, stages).groupBy("fold", "role").count().collect()}
    assert dealt == {(r.fold, r.role): r.to_row - r.from_row for r in stages}
    raw, start = backtest.final_fit(df, 525, 150)
    assert start == 1350 and known(raw) < rows[start][1] - 86_400 <= known(raw + 3)
    with pytest.raises(ValueError):
        backtest.plan(df.limit(60))
    with pytest.raises(ValueError):
        backtest.final_fit(df, 1400, 150)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_fold_plan_agrees_with_search(spark, seed):
    """Every boundary by trying them all, on kickoffs of uneven size and uneven delays of the results."""
    rng = random.Random(seed)
    times = sorted(rng.choices(range(1_000_000, 60_000_000, 7_200), k=1200))
    delay = {t: rng.choice([3_600, 86_400, 400_000]) for t in times}
    rows = [(i, t, t - 86_400, t + delay[t]) for i, t in enumerate(times)]
    bounds = [i for i in range(1200) if i == 0 or times[i] != times[i - 1]] + [1200]
    safe = lambda row: max(b for b in bounds if b <= row and max([-1, *(r[3] for r in rows[:b])]) < rows[row][2])

    def stage(start):
        end = safe(start)
        cut = max((b for b in bounds if b <= end - 120), default=None)
        return None if cut is None or safe(cut) < 420 else (safe(cut), cut, end, start)

    df = spark.createDataFrame(rows, "fixture_id long, kickoff long, as_of long, target_available long")
    first = next(i for i in range(2, len(bounds) - 3) if stage(bounds[i]))
    cuts = [first]
    for k in (1, 2):
        wanted = bounds[first] + (1200 - bounds[first]) * k / 3
        cuts.append(min(range(cuts[-1] + 1, len(bounds) - 1 - (3 - k) + 1), key=lambda i: (abs(bounds[i] - wanted), i)))
    want = []
    for i, (at, stop) in enumerate(zip(cuts, [*(bounds[c] for c in cuts[1:]), 1200], strict=True)):
        raw, cut, end, start = stage(bounds[at])
        want += [(i, "train", 0, raw, 0), (i, "calibrate", cut, end, cut - raw), (i, "evaluate", start, stop, start - end)]
    assert [tuple(r) for r in backtest.plan(df)] == want


def test_gates(spark):
    failing = lambda report: backtest.metric_failures(backtest.report_row(spark, report)).first().failures
    report = {"hitRate": 0.5, "brier": 0.2, "sampleCount": 600, "foldCount": 3, "evaluationStartUtc": 0, "evaluationEndUtc": 400 * 86_400, "protocol": "walk-forward"}
    assert failing(report) == []
    assert failing({}) == list(backtest.REQUIRED)
    at_the_edge = {"hitRate": 0.48, "brier": 0.22, "sampleCount": 499, "foldCount": 2, "evaluationEndUtc": 365 * 86_400 - 1, "protocol": "random"}
    for (name, value), message in zip(at_the_edge.items(), backtest.REQUIRED, strict=True):
        assert failing({**report, name: value}) == [message]
    assert failing({**report, "hitRate": float("nan"), "brier": float("nan")}) == list(backtest.REQUIRED)[:2]
    proof = {"schemaVersion": "s", "sourceRevisionMode": "m", **dict.fromkeys(backtest.FLAGS, True), "revisionManifestSha256": "a" * 64, "fixtureCount": 700, "revisionCount": 800, "coverageStartUtc": 0, "coverageEndUtc": 500 * 86_400}
    report["pointInTimeProvenance"] = proof
    assert backtest.apply_gate(spark, report, "s", "m") == [] and report["gate"]["passed"]
    for name, value in (("fixtureCount", True), ("fixtureCount", 10), ("revisionCount", 3), ("revisionManifestSha256", "xyz"), ("asOfReplayVerified", 1), ("coverageEndUtc", 5)):
        bad = {**report, "pointInTimeProvenance": {**proof, name: value}}
        assert backtest.apply_gate(spark, bad, "s", "m") and not bad["gate"]["passed"]


def test_release_round_trip(spark, tmp_path, monkeypatch):
    board = spark.createDataFrame([("a", 3, 0.25), ("b, c", 4, None)], "model_id string, n long, brier double")
    records = publish.record_union({"model": board})
    publish.write_release(tmp_path, {"b": 1, "a": "é"}, records, [], "v")
    assert (tmp_path / "release.json").read_text() == '{"b":1,"a":"é"}'
    assert (tmp_path / "release.csv").read_text().splitlines()[1].startswith("model,a,")
    assert publish.release_faults(tmp_path) == []
    (tmp_path / "release.csv").write_text("x")
    assert publish.release_faults(tmp_path)
    assert publish.write_release(tmp_path / "b", {}, records, [], "v", (__file__,), revision="cd" * 20)["revision"] == "cd" * 20
    assert publish.release_faults(tmp_path / "b") == []
    good = {"version": "v", "evaluation": {"matches": 3, "weeks": 1, "fullCoverage": True, "keySetSha256": "x"}, "leaderboard": [{"n": 3, "keySetSha256": "x"}] * 2, "activationEligible": False, "rawRowsIncluded": False}
    assert publish.document_faults(good, "v", 3, 1, 2) == [] and len(publish.document_faults({}, "v", 3, 1, 2)) == 8
    assert publish.document_faults(good | {"activationEligible": True}, "v", 3, 1, 2) == ["activation must be off"]
    monkeypatch.delenv("GITHUB_SHA", raising=False)
    own = tmp_path / "tree"
    own.mkdir()
    git = ["git", "-C", str(own), "-c", "user.name=t", "-c", "user.email=t@example.org"]
    subprocess.run([*git, "init", "-q"], check=True)
    with pytest.raises(RuntimeError):
        publish.revision_id(own)
    subprocess.run([*git, "commit", "-q", "--allow-empty", "-m", "x"], check=True)
    assert len(publish.revision_id(own)) == 40
    monkeypatch.setenv("GITHUB_SHA", "ab" * 20)
    assert publish.revision_id(tmp_path / "nowhere") == "ab" * 20
    with pytest.raises(ValueError):
        publish.rounded(float("nan"))
    assert publish.rounded(0.125, 2) == 0.12
    assert publish.write_candidate(tmp_path, {"gate": {"passed": False}}, {}, "v1") is None
    assert publish.write_candidate(tmp_path, {"gate": {"passed": True}}, {"w": [1]}, "v1").exists()


def test_season_files(spark, tmp_path):
    head = "Date,Time,HomeTeam,AwayTeam,FTHG,FTAG,FTR,AvgCH,AvgCD,AvgCA"
    good = ["13/08/16,,A , B,2,1,H,2.0,3.0,4.0", "14/08/16,15:30,C,D,0,0,D,2,3,nan", "15/08/16,,E,F,,,,,,"]
    path = tmp_path / "16" / "E0.csv"
    path.parent.mkdir()
    path.write_text("﻿" + "\n".join([head, *good]) + "\n", encoding="utf-8")
    rows = ingest.number_matches(ingest.read_season(spark, str(path), "2016/17", 0, False)).orderBy("fixture_id").collect()
    assert [(r.source_order, r.home_team, r.target, r.closing_odds) for r in rows] == [(2, "A", 0, [2.0, 3.0, 4.0]), (3, "C", 1, None)]
    assert rows[0].key == "2016/17|1471089600|A|B" and rows[0].block == "2016-08-08" and rows[0].season_start == 2016
    with pytest.raises(Exception, match="incomplete odds"):
        ingest.read_season(spark, str(path), "2016/17", 0, True).collect()
    manifest = {"sourceInputs": [{"season": "2016/17", "role": "x", "url": "u", "sha256": publish.file_sha256(path), "completedMatchRows": 2}]}
    (tmp_path / "m.json").write_text(json.dumps(manifest))
    pins = ingest.read_manifest(spark, str(tmp_path / "m.json"), ["2016/17"])
    assert pins.first().role == "evaluation"
    local = pins.withColumn("local_path", F.lit("16/E0.csv"))
    assert ingest.digest_mismatches(spark, local, str(tmp_path / "16")).count() == 0
    assert ingest.digest_mismatches(spark, local.withColumn("sha256", F.lit("0")), str(tmp_path / "16")).count() == 1
    matches = ingest.number_matches(ingest.read_season(spark, str(path), "2016/17", 0, False))
    about = ingest.source_metadata(pins, matches).collect()
    assert [(r.season, r.completed_rows, r.first_date, r.last_date, len(r.fields)) for r in about] == [("2016/17", 2, "2016-08-13", "2016-08-14", 10)]
    where = spark.createDataFrame([("https://x.org/mmz4281/1617/E0.csv",), ("https://x.org/none",)], "url string").select(ingest.path_behind(F.col("url"), "/mmz4281/")).collect()
    assert [r[0] for r in where] == ["1617/E0.csv", None]
    assert ingest.contract_faults(matches, pins).count() == 0
    assert ingest.contract_faults(matches.unionByName(matches), pins).count() == 3


def test_season_files_become_examples(spark, tmp_path):
    names = ["Alpha", "Beta", "Gamma", "Delta"]
    rng, parts = random.Random(3), []
    for index, season in enumerate(("2016/17", "2017/18")):
        lines = ["Date,Time,HomeTeam,AwayTeam,FTHG,FTAG,FTR"]
        for k in range(24):
            home, away = rng.sample(names, 2)
            h, a = rng.randint(0, 3), rng.randint(0, 3)
            lines.append(f"{1 + k % 28}/{9 + k // 28}/{2016 + index},15:00,{home},{away},{h},{a},{'H' if h > a else 'D' if h == a else 'A'}")
        path = tmp_path / f"{index}.csv"
        path.write_text("\n".join(lines) + "\n")
        parts.append(ingest.read_season(spark, str(path), season, index, False))
    matches = ingest.number_matches(parts[0].unionByName(parts[1])).persist()
    fixtures = {r.fixture_id: r for r in seasons.as_fixtures(matches).collect()}
    ids = {n: i for i, n in enumerate(sorted(names), 1)}
    for r in matches.collect():
        f = fixtures[r.fixture_id]
        assert (f.home, f.away, f.league_id, f.season, f.kickoff) == (ids[r.home_team], ids[r.away_team], 39, r.season_start, r.kickoff)
    found = seasons.examples(matches)
    assert found.count() == 48 and seasons.coverage_faults(matches, found).count() == 0
    assert seasons.coverage_faults(matches.where("fixture_id > 1"), found.where("fixture_id < 48")).count() == 2
    with pytest.raises(Exception, match="target"):
        seasons.examples(matches.withColumn("target", (F.col("target") + 1) % 3)).collect()


def test_bad_payloads_are_set_apart(spark):
    texts = ["{", "", "{}", '{"fixture":{"id":true}}', None]
    good, bad = ingest.parse_payloads(spark.createDataFrame([(t,) for t in texts], "payload string"))
    assert good.count() == 0 and bad.count() == len(texts)


def test_stream_equals_batch(spark, tmp_path):
    rows = sorted(league(80, seed=3), key=lambda r: r[3])
    src = tmp_path / "in"
    for k in range(4):
        part = spark.createDataFrame(rows[k * 20 : k * 20 + 20], FIXTURE)
        asof.appearances(part).where("is_final").coalesce(1).write.mode("append").parquet(str(src))
    schema = spark.read.parquet(str(src)).schema
    stream = live_form(spark.readStream.schema(schema).parquet(str(src)))
    query = stream.writeStream.format("memory").queryName("live").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {(r.fixture_id, r.team): (r.points_sum, r.games) for r in spark.table("live").collect()}
    past, want = {}, {}
    for r in sorted((r for r in rows if r[8]), key=lambda r: (r[3], r[0])):
        for team, g, c in ((r[4], r[6], r[7]), (r[5], r[7], r[6])):
            own = past.setdefault((r[1], team), [])
            own.append(points(g, c))
            want[r[0], team] = (sum(own[-5:]), len(own[-5:]))
    assert got == want
    weeks = weekly_results(spark.createDataFrame(rows, FIXTURE)).collect()
    assert sum(w.n for w in weeks) == sum(r[8] for r in rows)
    assert {w.block for w in weeks} == {r[0] for r in spark.createDataFrame(rows, FIXTURE).where("is_final").select(P.week_block(F.col("kickoff"))).collect()}


def test_flagship(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries()) and set(catalog.QUERIES) <= set(e.queries())


def test_boosted_and_fitted_queries_predict_every_season_with_an_earlier_one(spark, monkeypatch):
    sf, configs, deal = "/root/testdata/sf0.001", [], gbdt.fold_probabilities

    def spied(rows, folds, features, config=gbdt.BoostConfig()):
        configs.append(config)
        return deal(rows, folds, features, gbdt.BoostConfig(rounds=2))

    monkeypatch.setattr(gbdt, "fold_probabilities", spied)
    fx = catalog.source.from_orders(spark, sf)
    first = fx.agg(F.min("season")).first()[0]
    finals = {r.fixture_id for r in fx.where(F.col("is_final") & (F.col("season") > first)).collect()}
    counts = sorted((r.season, r["count"]) for r in fx.where("is_final").groupBy("season").count().collect())
    enough = [s for i, (s, _) in enumerate(counts) if sum(n for _, n in counts[:i]) >= 380]
    every = {r.fixture_id for r in fx.where(F.col("season").isin(enough)).collect()}
    assert len(enough) > 2
    for query, want in ((catalog.gbdt_oof, finals), (catalog.poisson_fit, every)):
        assert sorted(r.fixture_id for r in query(spark, sf).select("fixture_id").collect()) == sorted(want)
    assert configs == [gbdt.BoostConfig()]


def test_systems_board_asks_for_every_season_that_can_be_calibrated(spark, monkeypatch):
    class Asked(Exception):
        pass

    def spied(fixtures, odds, seasons, config=gbdt.BoostConfig(), least_earlier=2):
        raise Asked(seasons, config, least_earlier)

    monkeypatch.setattr(systems, "predict_all", spied)
    sf = "/root/testdata/sf0.001"
    counts = sorted((r.season, r["count"]) for r in catalog.source.from_orders(spark, sf).where("is_final").groupBy("season").count().collect())
    want = [s for i, (s, _) in enumerate(counts) if i >= 2 and sum(n for _, n in counts[:i]) >= 380]
    with pytest.raises(Asked) as asked:
        catalog.systems_board(spark, sf)
    assert asked.value.args == (want, gbdt.BoostConfig(), 1)


def test_candidate_gate_asks_for_provenance(spark):
    sf = "/root/testdata/sf0.001"
    assert "pointInTimeProvenance is required" in backtest.apply_gate(spark, {}, "1", "append-only")
    found = {r.failure for r in catalog.candidate_gate(spark, sf).collect()}
    assert found == {r.failure for r in catalog.gate_report(spark, sf).collect()}  # a whole history lacks nothing
    rows = {r.history: r for r in catalog.provenance_cases(spark, sf).collect()}
    cases = {name: r.failures for name, r in rows.items()}
    assert cases["whole"] == "" and "asOfReplayVerified" in cases["late"] and "sourceRevisionHistoryComplete" not in cases["late"]
    assert "sourceRevisionHistoryComplete" in cases["gap"] and "asOfReplayVerified" not in cases["gap"]
    assert "correctionObservedAtComplete" in cases["unobserved"] and "sourceRevisionHistoryComplete" not in cases["unobserved"]
    assert "sourceRevisionHistoryComplete" in cases["missing"] and rows["missing"].fixtures < rows["whole"].fixtures == rows["gap"].fixtures
    assert len({r.digest for r in rows.values()}) == 5


def test_known_at_and_late_corrections(spark):
    day = 86_400
    fixtures = spark.createDataFrame([(1, 0, 10 * day, 1, 2, 2, 1, True), (2, 0, 20 * day, 1, 2, 0, 0, True), (3, 0, 40 * day, 2, 1, None, None, False)], "fixture_id long, league_id int, kickoff long, home long, away long, home_goals long, away_goals long, is_final boolean")
    told = provenance.revisions_of(fixtures)
    assert [tuple(r) for r in provenance.first_uses(fixtures).orderBy("kickoff").select("kickoff", "first_use").collect()] == [(10 * day, 19 * day), (20 * day, 39 * day), (40 * day, None)]
    assert not provenance.faults(told, fixtures).where("incomplete or unobserved or unreplayable").collect()
    early = {r.fixture_id: r.is_final for r in provenance.known_at(told, 11 * day).collect()}
    assert early == {1: True} or early == {1: True, 2: False}
    for seen, late in ((19 * day - 1, False), (19 * day, True)):  # known just before its first use, or not
        wrong = told.withColumn("home_goals", F.when(F.col("fixture_id") == 1, F.col("home_goals") + 1).otherwise(F.col("home_goals")))
        fixed = told.where("fixture_id = 1 and revision = 2").withColumns({"revision": F.lit(3), "observed_at": F.lit(seen).cast("long")})
        found = {r.fixture_id: (r.incomplete, r.unobserved, r.unreplayable) for r in provenance.faults(wrong.unionByName(fixed), fixtures).collect()}
        assert found[1] == (False, False, late)
    one = provenance.manifest_digest(told).first()[0]
    assert provenance.manifest_digest(told.repartition(5)).first()[0] == one != provenance.manifest_digest(told.where("revision = 1")).first()[0]



def test_dixon_coles_query_fits_rho(spark):
    got = catalog.QUERIES["dixon_coles_fitted_rho"](spark, "/root/testdata/sf0.001").collect()
    assert len(got) == 1 and got[0].n >= 25 and abs(got[0].rho) < 0.25


def test_as_of_windows_run_over_few_rows_a_kickoff(spark):
    """A team's windows held all its fixtures in one task, of which only the last few results of a kickoff can count."""
    day = asof.DAY
    rows = [(i, 0, 2000, (i // 40) * day, i % 2, 2 + i % 3, i % 4, i % 3, i % 5 != 0) for i in range(800)]
    fx = spark.createDataFrame(rows, "fixture_id long, league_id int, season int, kickoff long, home long, away long, home_goals long, away_goals long, is_final boolean")
    seen = []

    def answer(few, sums):
        seen.append(few.count())
        return few.withColumn("seen", F.lit(1))

    config = asof.AsOfConfig()
    teams = asof.appearances(fx)
    assert asof.by_kickoff(teams, ["league_id", "team"], asof.form_sums(), config, "seen", answer).count() == 1600
    assert seen == [20 * 5 * config.window]
    got = {(r.fixture_id, r.is_home): (r.seen.points, r.seen.scored, r.seen.last_kickoff) if r.seen else None for r in asof.team_form(fx).collect()}
    fixed = {(r.fixture_id, r.is_home): (r.seen.points, r.seen.scored, r.seen.last_kickoff) if r.seen else None for r in asof.form_at(fx, 10**9).collect()}
    assert fixed == got
    for fixture, _, _, kickoff, home, away, *_ in rows:
        for is_home, team in ((True, home), (False, away)):
            known = sorted((r[3], r[0], r) for r in rows if r[8] and team in (r[4], r[5]) and r[3] + config.lag < kickoff - config.lead)[-config.window :]
            mine = [(r[6], r[7]) if r[4] == team else (r[7], r[6]) for *_, r in known]
            want = (sum(3 if a > b else int(a == b) for a, b in mine), sum(a for a, _ in mine), known[-1][0]) if known else None
            assert got[fixture, is_home] == want


def test_leaderboards_score_each_row_once(spark):
    """Sums and counts of weeks each scored all rows anew, and every metric was a row of its own."""
    calls = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def seen(x):
        calls.add(1)
        return x

    rows = [("a", i, 2000 + i % 2, f"w{i % 7}", i % 3, [0.5, 0.3, 0.2]) for i in range(60)]
    df = spark.createDataFrame(rows, "model_id string, key long, season int, block string, target int, p array<double>")
    scored = scoring.score(df).withColumn("brier", seen.asNondeterministic()("brier"))
    board = scoring.season_leaderboard(scored).collect()
    assert calls.value == 60
    assert {(r.season, r.overall, r.n, r.week_count) for r in board} == {(None, 1, 60, 7), (2000, 0, 30, 7), (2001, 0, 30, 7)}


def test_record_union_sums_its_boards_once(spark, monkeypatch):
    calls, make = [], scoring._bins
    monkeypatch.setattr(scoring, "_bins", lambda *a: calls.append(a) or make(*a))
    assert {r.record_type for r in catalog.record_union(spark, "/root/testdata/sf0.001").collect()} == {"model", "season", "reliability", "difference"}
    assert len(calls) == 1


def test_shares_of_goals_and_prices_are_worked_out_once(spark, monkeypatch):
    """Every fixture had its own sums over scores, and its own search for the insider share."""
    calls = spark.sparkContext.accumulator(0)

    @F.udf("array<double>")
    def seen(*_):
        calls.add(1)
        return [0.5, 0.3, 0.2]

    fx = spark.createDataFrame(goals_league(600, seed=8), FIXTURE)
    pairs = fx.select("home", "away").distinct().count()
    model = models.fit_goals(models.pair_statistics(fx).collect())
    want = {r.fixture_id: r.p for r in models.goal_rates(fx, model).select("fixture_id", P.poisson_outcomes(F.col("home_rate"), F.col("away_rate"), F.lit(-0.05)).alias("p")).collect()}
    assert {r.fixture_id: r.p for r in models.goal_probabilities(fx, model, -0.05).collect()} == want
    monkeypatch.setattr(models, "poisson_outcomes", lambda home, away, rho=None: seen.asNondeterministic()(home, away))
    assert models.poisson_probabilities(fx, fx).count() == 600 and len(models.poisson_probabilities(fx, fx).collect()) == 600
    assert 0 < calls.value <= 2 * pairs < 600
    calls.value = 0
    monkeypatch.setattr(systems.P, "shin", lambda odds: seen.asNondeterministic()(odds))
    market = fx.select("fixture_id", F.array(F.lit(2.0), 3.0 + F.col("home") % 2, F.lit(3.9)).alias("odds"))
    assert len(market.join(systems.shin_shares(market), "odds").collect()) == 600 and calls.value == 2


def test_logits_of_all_seasons_share_their_passes(spark, monkeypatch):
    """Every season's logit read its rows anew for each Newton step."""
    rng = np.random.default_rng(21)
    x = rng.normal(0, 1, (800, 2))
    y = np.argmax(np.stack([x[:, 0], x[:, 1], 0 * x[:, 0]], 1) + rng.gumbel(size=(800, 3)), axis=1)
    rows = [(i, 2000 + i // 200, int(t), None if i % 9 == 0 else float(a), float(b)) for i, ((a, b), t) in enumerate(zip(x, y, strict=True))]
    df = spark.createDataFrame(rows, "fixture_id long, season int, target int, a double, b double")
    calls, make = [], models._logit_sums
    monkeypatch.setattr(models, "_logit_sums", lambda *a: calls.append(a) or make(*a))
    got = models.logits_by_season(df, [2001, 2002, 2003], ["a", "b"])
    passes = len(calls)
    for season, found in zip((2001, 2002, 2003), got, strict=True):
        want = {r.fixture_id: r.p for r in models.logit_probabilities(df.where(F.col("season") < season), df.where(F.col("season") == season), ["a", "b"]).collect()}
        found = {r.fixture_id: r.p for r in found.collect()}
        assert found.keys() == want.keys() and len(found) == 200 and all(np.allclose(found[k], want[k], atol=1e-7) for k in want)
    assert passes < 2 / 3 * (len(calls) - passes)
    with pytest.raises(ValueError):
        models.logits_by_season(df, [2000], ["a", "b"])


def test_rows_alike_are_grown_and_scored_as_one(spark, monkeypatch):
    """Growing and scoring took every row by itself, though rows of one pair of teams and kickoff have the same features."""
    rng = np.random.default_rng(22)
    bins, counts = rng.integers(0, 9, (300, 3)), rng.integers(0, 4, (300, 3))
    bins, counts = bins[counts.sum(axis=1) > 0], counts[counts.sum(axis=1) > 0]
    single = np.repeat(bins, counts.sum(axis=1), axis=0)
    y = np.concatenate([np.repeat([0, 1, 2], n) for n in counts])
    c = gbdt.BoostConfig(rounds=8, rate=0.2, row_share=1.0, column_share=1.0, leaves=6)
    (base, trees), (want, plain) = gbdt.boost(bins, counts, c), gbdt.boost(single, y, c)
    assert np.allclose(base, want)
    assert all(np.allclose(gbdt.leaf_values(a, single), gbdt.leaf_values(b, single), atol=1e-5) for a, b in zip(trees, plain, strict=True))
    many = np.array([1, 1, 5, 40, 1, 300])
    taken = [gbdt.drawn(np.random.default_rng(i), many, 250) for i in range(400)]
    assert all(t.sum() == 250 and (t >= 0).all() and (t <= many).all() for t in taken)
    assert np.allclose(np.mean(taken, axis=0) / many, 250 / many.sum(), atol=0.06)
    odd = [None, float("nan"), -0.0, 0.0, 1.0]
    rows = [(i, 2000 + i // 3000, i % 3 if i % 7 else (i // 7) % 3, odd[i % 5], float(i // 5 % 4)) for i in range(6000)]
    df = spark.createDataFrame(rows, "fixture_id long, season int, target int, a double, b double")
    sizes, code = [], gbdt._coded
    monkeypatch.setattr(gbdt, "_coded", lambda rows, *a: sizes.append(rows.count()) or code(rows, *a))
    out = gbdt.fold_probabilities(df, spark.createDataFrame([(0, 2001)], "fold int, season int"), ["a", "b"], gbdt.BoostConfig(rounds=3)).collect()
    assert sorted(r.fixture_id for r in out) == list(range(3000, 6000))
    assert sizes == [16, 16]  # null, NaN, zero and one; either zero is the same
    held = {}
    for r in out:
        held.setdefault((str(odd[r.fixture_id % 5]).lstrip("-"), r.fixture_id // 5 % 4), set()).add(tuple(r.p))
    assert len(held) == 16 and all(len(p) == 1 for p in held.values())


def test_edges_count_a_row_as_often_as_it_stands_for_one(spark, monkeypatch):
    monkeypatch.setattr(gbdt, "REPEATS", 7)
    df = spark.createDataFrame([(0, i % 3, float(min(i, 900))) for i in range(1000)] + [(1, i % 3, float(i % 10)) for i in range(500)], "fold int, target int, a double")
    edges = gbdt.fold_edges(gbdt.alike(df, ["fold"], ["a"]), ["a"], 8)
    assert np.allclose(edges[0][0], [124, 249, 374, 499, 624, 749, 874], atol=2) and edges[1][0].tolist() == [1, 2, 3, 4, 6, 7, 8]


def test_walk_forward_deals_rows_alike_as_one(spark, monkeypatch):
    """Every training row was dealt to each fold by itself, and the rows to evaluate were joined to their targets again."""
    day, held, grow = asof.DAY, [], gbdt.grown_alike
    rows = [(i, (i // 6) * day, i % 3, float(i // 6 % 5)) for i in range(1800)]
    df = spark.createDataFrame(rows, "fixture_id long, kickoff long, target int, a double").withColumns({"as_of": F.col("kickoff") - day, "target_available": F.col("kickoff") + day})

    def spied(train, *more):
        held.extend(train.collect())
        return grow(train, *more)

    monkeypatch.setattr(gbdt, "grown_alike", spied)
    done = walkforward.run(df, ["a"], boost=gbdt.BoostConfig(rounds=2))
    sizes = {(r.fold, r.role): r.to_row - r.from_row for r in done.stages}
    assert len(held) == sum(n for (_, role), n in sizes.items() if role == "train") // 6
    assert all(r[n] == 2 for r in held for n in gbdt.COUNTS)
    assert sorted(r.fixture_id for r in done.predictions.collect()) == list(range(1800 - sum(n for (_, role), n in sizes.items() if role == "evaluate"), 1800))
