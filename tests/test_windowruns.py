"""Moments, walk-forward runs and selection against plain numpy and pandas."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickloom.operators import models, scale, selection, walkforward as wf, windowruns as wr
from tickloom.operators.moments import cell_moments, centred, merge, pair_moments, unfold

X = ["a", "b", "c"]


def frame(rows=230, series=("p", "q"), seed=1):
    rng = np.random.default_rng(seed)
    parts = []
    for k, s in enumerate(series):
        n = rows - 37 * k
        a = rng.normal(1000.0, 1.0, n)  # far from zero: sums of squares would cancel
        d = pd.DataFrame({"symbol": s, "t": np.arange(n) * (1 + k), "a": a, "b": rng.normal(0, 1, n), "c": 5.0})
        d["close"] = np.exp(np.cumsum(rng.normal(0, 0.02, n)))
        d["y"] = (d["b"] + 0.3 * (a - 1000) + rng.normal(0, 1, n) > 0).astype(int)
        d.loc[rng.random(n) < 0.05, "b"] = np.nan
        d.loc[n - 1, "y"] = np.nan
        parts.append(d)
    return pd.concat(parts, ignore_index=True)


@pytest.fixture(scope="module")
def data(spark):
    pdf = frame()
    d = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), "symbol string, t long, a double, b double, c double, close double, y double")
    return d.withColumn("ts", (F.lit(0) + F.col("t") * 86_400).cast("timestamp")).repartition(5).cache(), pdf


def ridge(part, penalty):
    part = part.dropna(subset=[*X, "y"])
    x, y = part[X].to_numpy(), part["y"].to_numpy(dtype=float)
    mean, sd = x.mean(axis=0), x.std(axis=0)
    sd[sd < 1e-9] = 1.0
    z = (x - mean) / sd
    beta = np.linalg.lstsq(z.T @ z + penalty * np.eye(3), z.T @ (y - y.mean()), rcond=1e-12)[0] / sd
    return len(part), y.mean() - beta @ mean, beta


def windows(n, plan):
    w = 0
    while plan.train + w * plan.step + plan.test <= n:
        begin, edge = 0 if plan.expanding else w * plan.step, plan.train + w * plan.step
        if edge - begin >= plan.min_train:
            yield w, begin, edge
        w += 1


PLANS = [
    wr.Plan(60, 20, 20), wr.Plan(50, 30, 20), wr.Plan(45, 25, 10, expanding=False), wr.Plan(30, 10, 40, min_train=100),
    wr.Plan(30, 10, 40, expanding=False, min_train=31), wr.Plan(500, 10, 10),
]


@pytest.mark.parametrize("plan", PLANS)
@pytest.mark.parametrize("by", [("symbol",), ()])
def test_every_window_has_the_model_of_its_training_rows(data, plan, by):
    df, pdf = data
    d = wr.positions(df, by=by)
    got = {(r.symbol if by else "", r.window_id, r.model): r for r in wr.linear_models(d, X, "y", plan, by=by).collect()}
    want = {}
    if by:
        groups = [(s, g.assign(pos=range(len(g)))) for s, g in pdf.groupby("symbol")]
    else:
        times = sorted(pdf["t"].unique())
        groups = [("", pdf.assign(pos=pdf["t"].map({t: i for i, t in enumerate(times)})))]
    for s, g in groups:
        for w, begin, edge in windows(int(g["pos"].max()) + 1, plan):
            part = g[(g["pos"] >= begin) & (g["pos"] < edge)]
            want |= {(s, w, name): ridge(part, p) for name, p in wr.LINEAR.items()}
    assert got.keys() == want.keys()
    for key, (n, intercept, beta) in want.items():
        assert got[key].n_train == n
        assert np.allclose([got[key].intercept, *got[key].coefficients], [intercept, *beta], rtol=1e-6, atol=1e-6)
    # test rows and their windows
    tested = sorted((r.symbol, r.t, r.window_id) for r in wr.tested_rows(d, plan, by=by).collect())
    assert tested == sorted(
        (r.symbol, r.t, w) for s, g in groups for w, _, edge in windows(int(g["pos"].max()) + 1, plan)
        for r in g[(g["pos"] >= edge) & (g["pos"] < edge + plan.test)].itertuples()
    )


def test_scaling_is_that_of_the_assigned_training_rows(data):
    df, _ = data
    df = df.drop("y")
    plan = wr.Plan(50, 30, 20)
    old = wf.window_scaling(wf.assign_windows(df, 50, 30, 20), ["a", "close"]).filter("role = 'test'")
    key = ["symbol", "t", "window_id"]
    a, b = (sorted((r.symbol, r.t, r.window_id, round(r.a, 6), round(r.close, 6)) for r in x.select(*key, "a", "close").collect()) for x in (old, wr.scaled_tests(df, ["a", "close"], plan)))
    assert a == b and a


def test_results_hold_the_baseline_and_missing_scores_are_not_held(data):
    df, pdf = data
    plan = wr.Plan(60, 20, 20)
    res = wr.walk_forward(df, X, "y", plan).toPandas()
    n = sum(len(list(windows(len(g), plan))) for _, g in pdf.groupby("symbol"))
    assert res.groupby("model").size().to_dict() == {"linear": n, "ridge": n, "buy_and_hold": n}
    hold = res[res["model"] == "buy_and_hold"].set_index(["symbol", "window_id"])["total_return"]
    p = pdf[pdf["symbol"] == "p"].reset_index(drop=True)
    assert np.isclose(hold["p", 0], p.loc[79, "close"] / p.loc[60, "close"] - 1)
    none = wr.walk_forward(df.withColumn("a", F.lit(None).cast("double")), X, "y", plan, penalties={"linear": 0.0}).filter("model = 'linear'").toPandas()
    assert len(none) == n and (none["num_trades"] == 0).all() and (none["total_return"] == 0).all() and none["accuracy"].isna().all()


def test_fitted_models_share_the_windows_of_common_times(data):
    df, _ = data
    plan = wr.Plan(150, 60, 60)
    scored = wr.fitted_scores(df.filter("b IS NOT NULL"), X, "y", plan, {"random_forest": {"numTrees": 5}}).toPandas()
    times = sorted(set(scored["t"]))
    assert set(scored["window_id"]) == {0, 1} and set(scored["model"]) == {"random_forest"} and scored["score"].between(0, 1).all()
    assert scored.groupby("window_id")["t"].min().is_monotonic_increasing and times
    none = wr.fitted_scores(df, X, "y", wr.Plan(10_000, 1, 1), {"random_forest": {}})
    assert none.collect() == [] and none.columns == scored.columns.tolist()


def test_moments_merge_like_one_pass():
    x = np.random.default_rng(2).normal(1e6, 1, (500, 4))
    x[7, 2] = np.nan
    parts = [centred(x[a : a + 90]) for a in range(0, 500, 90)]
    n, mean, products = merge(*(np.array(c) for c in zip(*parts)))
    full = x[~np.isnan(x).any(axis=1)]
    assert n == len(full) and np.allclose(mean, full.mean(axis=0)) and np.allclose(products / n, np.cov(full.T, bias=True), rtol=1e-6, atol=1e-6)


def test_cell_moments_count_all_rows(data):
    df, pdf = data
    d = df.withColumn("cell", F.floor(F.col("t") / 50))
    parts = cell_moments(d, ["a", "b"], "cell").toPandas()
    assert parts["rows"].sum() == len(pdf) and parts["n"].sum() == pdf["b"].notna().sum()
    assert unfold(parts, 2)[2].shape == (len(parts), 2, 2)


def test_pair_correlations_equal_pandas_on_pairwise_complete_rows(data):
    df, pdf = data
    cols = ["a", "b", "c", "close", "y"]
    want = pdf[cols].corr()
    got = pair_moments(df, cols).toPandas()
    assert len(got) == 10
    for r in got.itertuples():
        w = want.iloc[r.i, r.j]
        assert (np.isnan(w) and (r.r is None or np.isnan(r.r))) or np.isclose(r.r, w, atol=1e-9)
        assert r.n == (pdf[cols[r.i]].notna() & pdf[cols[r.j]].notna()).sum()
    by = pair_moments(df, ["a", "b"], by=("symbol",)).toPandas().set_index("symbol")["r"]
    for s, g in pdf.groupby("symbol"):
        assert np.isclose(by[s], g["a"].corr(g["b"]), atol=1e-9)


def test_selection_logs_why_each_feature_went(data):
    df, _ = data
    d = df.withColumn("twin", F.col("b") * -2.0 + 1.0)
    log = models.select_features(d, ["a", "b", "c", "twin"], "y", max_features=2, numTrees=10)
    rows = {r.feature: r for r in log.collect()}
    assert rows.keys() == {"a", "b", "c", "twin"}
    assert rows["twin"].decision == "correlated" and rows["twin"].correlated_with == "b" and np.isclose(rows["twin"].value, 1.0)
    assert rows["c"].decision == "low importance" and models.selected(log) == ["b", "a"]


def test_pooled_splits_are_cut_at_one_time(data):
    df, pdf = data
    d = scale.split_times(df, 0.2).toPandas()
    assert len(d) == len(pdf) and d[d["split"] == "train"]["t"].max() < d[d["split"] == "test"]["t"].min()
    for fold, part in scale.time_folds(df, 3, by=()).toPandas().groupby("fold"):
        assert part[part["role"] == "train"]["t"].max() < part[part["role"] == "test"]["t"].min()


def test_reports_compare_by_logarithms_where_returns_are_out_of_range(spark):
    rows = [(1, m, w, r) for m, r in (("good", 3.0), ("better", 5.0), ("buy_hold", 1.0)) for w in range(1200)] + [(1, "lost", w, -1.0 if w == 3 else 0.5) for w in range(5)]
    a = wf.aggregate_windows(spark.createDataFrame(rows, "horizon int, model string, window_id int, total_return double"), by=("horizon", "model"))
    report = wf.horizon_report(a).collect()
    assert [r.model for r in report] == ["better", "good", "buy_hold", "lost"]
    assert [r.compound_return_pct for r in report] == [None, None, None, -100.0] and np.isclose(report[0].compound_log_return, 1200 * np.log(6))
    best = wf.best_per_horizon(a).first()
    assert best.model == "better" and best.gap is None and np.isclose(best.log_gap, 1200 * np.log(3))
