"""Monthly models from sums of blocks against refits from the rows of each window."""

import numpy as np
import pandas as pd
import pytest

from sigspark.plans import models as md
from sigspark.plans import walk_forward as wf
from sigspark.plans.splits import Task

COLUMNS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def panel():
    """70 sessions of 12 to 19 stocks; missing features and labels, and sessions without any label."""
    rng = np.random.default_rng(5)
    rows = []
    for code in range(70):
        for permno in rng.permutation(25)[: rng.integers(12, 20)]:
            x = rng.normal(size=3)
            y = 0.3 * x[0] - 0.2 * x[1] + rng.normal() + 0.5
            gone = rng.random(4) < [0.1, 0.0, 0.05, 0.08]
            rows.append((code, f"2001-{1 + code // 28:02d}-{1 + code % 28:02d}", int(permno), *(None if g else float(v) for g, v in zip(gone, [*x, y], strict=True))))
    frame = pd.DataFrame(rows, columns=["code", "date", "permno", *COLUMNS, "q"])
    frame.loc[frame["code"].isin([7, 31]), "q"] = None
    frame["c"] = frame["c"] * 3 + 100
    return frame


def spark_panel(spark, panel):
    return spark.createDataFrame(panel.astype(object).where(panel.notna(), None).values.tolist(), "code int, date string, permno long, a double, b double, c double, q double")


def refit(rows, by_date):
    """Moments, mean and scale of one window, from its rows."""
    all_w = 1.0 / rows.groupby("code")["code"].transform("count") if by_date else pd.Series(1.0, rows.index)
    mean, scale = [], []
    for c in COLUMNS:
        on = rows[c].notna()
        w = all_w[on] / all_w[on].sum()
        mean.append((w * rows[c][on]).sum())
        scale.append(np.sqrt((w * (rows[c][on] - mean[-1]) ** 2).sum()))
    z = ((rows[COLUMNS] - mean) / scale).fillna(0.0)
    on = rows["q"].notna()
    w = 1.0 / rows[on].groupby("code")["code"].transform("count") if by_date else pd.Series(1.0, rows[on].index)
    w = (w / w.sum()).to_numpy()
    z, y = z[on].to_numpy(), rows["q"][on].to_numpy()
    xm, ym = w @ z, w @ y
    zc, yc = z - xm, y - ym
    return md.Moments((zc * w[:, None]).T @ zc, (zc * w[:, None]).T @ yc, xm, ym, w @ (yc * yc), len(z)), np.array(mean), np.array(scale)


def average(x):
    return pd.Series(x).rank().to_numpy()


def rank_correlation(p, y):
    return np.corrcoef(average(p), average(y))[0, 1] if len(set(p)) > 1 and len(set(y)) > 1 else 0.0


SPANS = [("m1", 0, 29), ("m2", 5, 34), ("m3", 0, 49), ("m4", 30, 32), ("m5", 31, 31)]


@pytest.mark.parametrize("by_date", [True, False])
def test_window_moments_equal_a_refit(spark, panel, by_date):
    seen = wf.fit_windows(spark_panel(spark, panel), SPANS, COLUMNS, "q", lambda m: [md.Candidate("ridge", a, 0.0, b, float(m.y_mean - m.x_mean @ b), 0.0) for a, b in zip((0.0, 0.5), md.spectral(m, (0.0, 0.5)), strict=True)], by_date).toPandas()
    assert sorted(seen["key"].unique()) == ["m1", "m2", "m3", "m4"]  # m5 has no label
    for key, low, high in SPANS[:4]:
        m, mean, scale = refit(panel[panel["code"].between(low, high)], by_date)
        for a, beta in zip((0.0, 0.5), md.spectral(m, (0.0, 0.5)), strict=True):
            one = seen[(seen["key"] == key) & (seen["penalty"] == a)].iloc[0]
            assert np.allclose(one["beta"], beta, atol=1e-9) and np.isclose(one["intercept"], m.y_mean - m.x_mean @ beta, atol=1e-9)
            assert np.allclose(one["mean"], mean) and np.allclose(one["scale"], scale) and one["n"] == m.n


def test_walk_forward_equals_a_loop_over_months(spark, panel):
    tasks = [Task(f"2001-{i:02d}", f, f + 25, f + 27, f + 38, f + 40, f + 45, 1) for i, f in enumerate((0, 6, 12, 20), 1)]
    got = wf.walk_forward(spark_panel(spark, panel), tasks, COLUMNS).toPandas()
    assert sorted(got["month"].unique()) == [t.month for t in tasks]
    for t in tasks:
        m, mean, scale = refit(panel[panel["code"].between(t.fit_first, t.fit_last)], True)
        found = md.candidates(m)
        valid = panel[panel["code"].between(t.valid_first, t.valid_last) & panel["q"].notna()]
        scores = []
        for c in found:
            daily = []
            for _, rows in valid.groupby("code"):
                if len(rows) >= 10 and rows["q"].nunique() > 1:
                    daily.append(rank_correlation(((rows[COLUMNS] - mean) / scale).fillna(0.0).to_numpy() @ c.beta + c.intercept if c.beta.any() else np.zeros(len(rows)), rows["q"].to_numpy()))
            scores.append(float(np.mean(daily)))
        best = md.first_best(scores)
        mine = got[got["month"] == t.month].sort_values(["date", "permno"])
        assert set(zip(mine["estimator"], np.round(mine["penalty"], 9), mine["mix"], strict=True)) == {(found[best].estimator, round(found[best].penalty, 9), found[best].mix)}
        assert np.allclose(mine["ic"], scores[best])
        rows = panel[panel["code"].between(t.test_first, t.test_last)].sort_values(["date", "permno"])
        want = ((rows[COLUMNS] - mean) / scale).fillna(0.0).to_numpy() @ found[best].beta + found[best].intercept
        assert np.allclose(mine["prediction"], want, atol=1e-9) and mine["permno"].tolist() == rows["permno"].tolist()


def test_past_record_chooses_as_a_loop_does(spark, panel):
    windows = [(f"2001-{i:02d}", 4 * i, 4 * i + 12, 4 * i + 14, 4 * i + 17) for i in range(13)]
    choices, _ = wf.past_choices(spark_panel(spark, panel), windows, COLUMNS, "q")
    got = choices.toPandas().set_index(["key", "criterion", "estimator"])
    records = {}
    for key, low, high, first, last in windows:
        m, mean, scale = refit(panel[panel["code"].between(low, high)], False)
        test = panel[panel["code"].between(first, last) & panel["q"].notna()]
        for k, c in enumerate(wf.past_candidates()(m)):
            sse, rc = 0.0, []
            for _, rows in test.groupby("code"):
                z = ((rows[COLUMNS] - mean) / scale).fillna(0.0).to_numpy()
                p, y = (z @ c.beta + c.intercept) if c.beta.any() else np.zeros(len(z)), rows["q"].to_numpy()
                sse += (((y - y.mean()) - (p - p.mean())) ** 2).sum()
                rc.append(rank_correlation(p, y))
            records.setdefault(c.estimator, {}).setdefault(key, []).append((sse, np.mean(rc), c.penalty, c.mix))
    for estimator, by_month in records.items():
        months = sorted(by_month)
        for i, month in enumerate(months):
            past = months[max(0, i - 12) : i]
            for criterion in ("sse", "rankcorr"):
                now = by_month[month]
                if not past:
                    want = next(r for r in now if r[2:] == wf.PAST_DEFAULT[estimator])
                elif criterion == "sse":
                    want = now[int(np.argmin([round(sum(by_month[p][k][0] for p in past), 10) for k in range(len(now))]))]
                else:
                    want = now[int(np.argmax([round(np.mean([by_month[p][k][1] for p in past]), 10) for k in range(len(now))]))]
                one = got.loc[(month, criterion, estimator)]
                assert (one["penalty"], one["mix"]) == want[2:] and np.isclose(one["sse"], want[0]) and np.isclose(one["rankcorr"], want[1])


def test_jobs_do_not_grow_with_months(spark, panel):
    frame = spark_panel(spark, panel)
    tracker = spark.sparkContext.statusTracker()
    used = []
    for n in (2, 12):
        tasks = [Task(f"2001-{i:02d}", i, i + 25, i + 27, i + 38, i + 40, i + 45, 1) for i in range(1, n + 1)]
        spark.sparkContext.setJobGroup(f"months-{n}", "")
        wf.walk_forward(frame, tasks, COLUMNS, fit=lambda m: md.candidates(m, ridge=(1.0,), shares=(), mixes=())).count()
        used.append(len(tracker.getJobIdsForGroup(f"months-{n}")))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert used[1] <= used[0] + 2, used


def test_average_ranks_and_correlations():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 4, (5, 9)).astype(float)
    assert np.array_equal(wf.average_ranks(x), np.stack([average(r) for r in x]))
    y = rng.integers(0, 3, 9).astype(float)
    assert np.allclose(wf.correlations(x, y), [np.corrcoef(average(r), average(y))[0, 1] for r in x])
    assert np.isnan(wf.correlations(np.ones((1, 9)), y)).all()


def test_complete_columns_and_choices_per_estimator(spark, panel):
    whole = panel.fillna({"a": 0.0, "b": 0.0, "c": 100.0})
    frame = spark_panel(spark, whole)
    tasks = [Task("2001-01", 0, 25, 27, 38, 40, 45, 1), Task("2001-02", 10, 35, 37, 48, 50, 55, 1)]
    fit = lambda m: md.candidates(m, ridge=(1.0, 0.1), shares=(), mixes=())
    a, b = (wf.walk_forward(frame, tasks, COLUMNS, fit=fit, per=("estimator",), complete=c).toPandas().sort_values(["month", "estimator", "date", "permno"]).reset_index(drop=True) for c in (False, True))
    assert sorted(a["estimator"].unique()) == ["ols", "ridge"] and np.allclose(a["prediction"], b["prediction"]) and np.allclose(a["ic"], b["ic"])
    one = wf.walk_forward(frame, tasks, COLUMNS, fit=fit).toPandas()
    assert len(a) == 2 * len(one)


def test_cross_validation_equals_a_loop_over_folds(spark, panel, monkeypatch):
    for name, value in (("CV_RIDGE", (0.01, 1.0, 30.0)), ("CV_MIXES", (0.5, 1.0)), ("CV_STEPS", 6)):
        monkeypatch.setattr(wf, name, value)
    windows = [("2001-01", 0, 29, 31, 34), ("2001-02", 8, 37, 39, 44)]
    # the menus are constants of the module: workers get them with the function, so the fit is called here
    cells = wf.window_cells(spark_panel(spark, panel), [(f"{w[0]}/{i}", w[1] + 6 * i, w[1] + 6 * i + 5) for w in windows for i in range(5)], COLUMNS, "q", False).toPandas()
    for key, low, high, _, _ in windows:
        m, mean, scale = refit(panel[panel["code"].between(low, high)], False)
        own = cells[cells["key"].str.startswith(key)]
        sums = [wf._scaled_sums(g["cell"].to_numpy(), g["v"].to_numpy(), mean, scale) for _, g in own.groupby("key")]
        got = wf.cross_validated(sums)
        rows = panel[panel["code"].between(low, high)]
        z = ((rows[COLUMNS] - mean) / scale).fillna(0.0)[rows["q"].notna()]
        y, fold = rows["q"].dropna(), (rows["code"][rows["q"].notna()] - low) // 6
        scores = {}
        for i in range(5):
            a, b = fold != i, fold == i
            za, ya, zb, yb = z[a].to_numpy(), y[a].to_numpy(), z[b].to_numpy(), y[b].to_numpy()
            xm, ym = za.mean(axis=0), ya.mean()
            gram, cross = (za - xm).T @ (za - xm) / len(za), (za - xm).T @ (ya - ym) / len(za)
            mm = md.Moments(gram, cross, xm, ym, ((ya - ym) ** 2).mean(), len(za))
            top = np.abs(m.cross).max()
            menu = [("ridge", p, 0.0) for p in wf.CV_RIDGE] + [("enet", top / x * 1e-3 ** (j / 5), x) for x in wf.CV_MIXES for j in range(6)]
            for name, p, x in menu:
                beta = np.linalg.solve(gram + p / len(za) * np.eye(3), cross) if name == "ridge" else md.elastic_net(mm, p * x, p * (1 - x))
                mse = ((yb - ym - (zb - xm) @ beta) ** 2).mean()
                scores.setdefault((name, p, x), []).append(1 - mse / yb.var() if name == "ridge" else -mse)
        best = lambda on: max((k for k in scores if on(k)), key=lambda k: np.mean(scores[k]))  # noqa: E731, B023
        for name, on in (("ridge", lambda k: k[0] == "ridge"), ("enet", lambda k: k[0] == "enet"), ("lasso", lambda k: k[0] == "enet" and k[2] == 1.0)):
            want = best(on)
            assert np.isclose(got[name].penalty, want[1]) and got[name].mix == want[2], (key, name)
            beta = np.linalg.solve(m.gram + want[1] / m.n * np.eye(3), m.cross) if name == "ridge" else md.elastic_net(m, want[1] * want[2], want[1] * (1 - want[2]))
            assert np.allclose(got[name].beta, beta, atol=1e-7)


def test_history_is_the_one_that_validates_best(spark, panel):
    frame = spark_panel(spark, panel)
    by_history = {h: [Task(f"2001-0{i}", 40 + i - h, 39 + i, 41 + i, 48 + i, 50 + i, 52 + i, 1) for i in (1, 2)] for h in (20, 10, 30)}
    fit = lambda m: md.candidates(m, ridge=(1.0, 0.1), shares=(), mixes=())
    got = wf.history_forecasts(frame, by_history, COLUMNS, fit=fit).toPandas()
    alone = {h: wf.walk_forward(frame, t, COLUMNS, fit=fit).toPandas() for h, t in by_history.items()}
    for month in ("2001-01", "2001-02"):
        best = max(by_history, key=lambda h: alone[h][alone[h]["month"] == month]["ic"].iloc[0])
        a, b = (d[d["month"] == month].sort_values(["date", "permno"]) for d in (got, alone[best]))
        assert (a["history"] == best).all() and np.allclose(a["prediction"], b["prediction"]) and len(a) == len(b)


def test_choices_with_a_month_left_out(spark, panel):
    tasks = [Task("2001-01", 0, 15, 17, 60, 62, 65, 1), Task("2001-02", 4, 19, 21, 50, 62, 65, 1)]
    fit = lambda m: md.candidates(m, ridge=(10.0, 1.0, 0.1), shares=(0.3, 0.03), mixes=())
    got = wf.stability(spark_panel(spark, panel), tasks, COLUMNS, fit=fit).toPandas().set_index(["month", "left_out"])
    assert len(got) == 3 + 2
    for t in tasks:
        m, mean, scale = refit(panel[panel["code"].between(t.fit_first, t.fit_last)], True)
        found = fit(m)
        valid = panel[panel["code"].between(t.valid_first, t.valid_last) & panel["q"].notna()]
        daily = []
        for date, rows in valid.groupby("date"):
            if len(rows) >= 10 and rows["q"].nunique() > 1:
                z = ((rows[COLUMNS] - mean) / scale).fillna(0.0).to_numpy()
                daily.append((date[:7], [rank_correlation(z @ c.beta + c.intercept if c.beta.any() else np.zeros(len(z)), rows["q"].to_numpy()) for c in found]))
        whole = md.first_best(np.mean([d for _, d in daily], axis=0).tolist())
        for left in sorted({d for d, _ in daily}):
            rest = [d for month, d in daily if month != left]
            scores = np.mean(rest, axis=0)
            best = md.first_best(scores.tolist())
            one = got.loc[(t.month, left)]
            assert (one["estimator"], one["penalty"], one["mix"]) == (found[best].estimator, pytest.approx(found[best].penalty), found[best].mix)
            top = np.sort(scores)[::-1]
            assert one["n_dates"] == len(rest) and np.isclose(one["ic"], scores[best]) and np.isclose(one["gap"], top[0] - top[1]) and one["same"] == (best == whole)


def test_the_expanded_menu_lies_between_the_steps_of_the_plain_one(panel):
    m, _, _ = refit(panel[panel["code"].between(0, 30)], True)
    found = wf.expanded_candidates(m)
    assert [c.estimator for c in found] == ["ols"] + ["ridge"] * 19 + ["lasso"] * 17 + ["enet"] * 85
    assert all(a.penalty > b.penalty for a, b in zip(found[1:19], found[2:20], strict=True))


def test_scaled_blocks_are_scaled_by_each_fit_block(spark, panel):
    found = [Task("2001-02", 0, 29, 31, 36, 38, 44, 1), Task("2001-03", 10, 39, 41, 46, 48, 54, 1)]
    d = spark_panel(spark, panel)
    out = wf.scaled_blocks(d, found, COLUMNS).toPandas()
    for task in found:
        inside = d.where(f"code between {task.fit_first} and {task.fit_last} and q is not null")
        scaler = md.weighted_scaler(md.equal_date_weights(inside, "code"), COLUMNS)
        for block in ("fit", "valid", "test"):
            low, high = getattr(task, f"{block}_first"), getattr(task, f"{block}_last")
            own = out[(out.month == task.month) & (out.block == block)].sort_values(["code", "permno"])
            rows = panel[panel.code.between(low, high)].sort_values(["code", "permno"])
            expected = np.column_stack([((rows[c] - scaler[c][0]) / scaler[c][1]).fillna(0.0) for c in COLUMNS])
            np.testing.assert_allclose(np.stack(own.features), expected, rtol=1e-9, atol=1e-12)
            assert own.q.isna().tolist() == rows.q.isna().tolist()
    assert wf.scaled_blocks(d.where("code < 0"), found, COLUMNS).count() == 0


def test_refits_of_all_months_are_those_of_each_windows_rows(spark, panel):
    tasks = [Task(f"2001-{i:02d}", f, f + 25, f + 27, f + 38, f + 40, f + 45, 1) for i, f in enumerate((0, 6, 20), 1)]
    d = spark_panel(spark, panel)
    got = wf.refit_forecasts(d, tasks, COLUMNS).toPandas()
    first = wf.walk_forward(d, tasks, COLUMNS).toPandas().sort_values(["month", "date", "permno"], ignore_index=True)
    retained = got[got["policy"] == "retain"].sort_values(["month", "date", "permno"], ignore_index=True)
    pd.testing.assert_frame_equal(retained.drop(columns="policy"), first, rtol=1e-9)
    for t in tasks:
        m, _, _ = refit(panel[panel["code"].between(t.fit_first, t.fit_last)], True)
        own = first[first["month"] == t.month].iloc[0]
        at = next(k for k, c in enumerate(md.candidates(m)) if c.estimator == own["estimator"] and c.mix == own["mix"] and np.isclose(c.penalty, own["penalty"], rtol=1e-6, atol=0))
        code = panel["code"]
        for policy, inside in (("recent", code.between(t.valid_last - 25, t.valid_last)), ("union", code.between(t.fit_first, t.fit_last) | code.between(t.valid_first, t.valid_last))):
            m, mean, scale = refit(panel[inside], True)
            c = md.candidates(m)[at]
            mine = got[(got["month"] == t.month) & (got["policy"] == policy)].sort_values(["date", "permno"])
            rows = panel[code.between(t.test_first, t.test_last)].sort_values(["date", "permno"])
            want = ((rows[COLUMNS] - mean) / scale).fillna(0.0).to_numpy() @ c.beta + c.intercept
            assert mine["permno"].tolist() == rows["permno"].tolist() and np.allclose(mine["prediction"], want, atol=1e-8) and np.allclose(mine["penalty"], c.penalty)
    with pytest.raises(ValueError):
        wf.refit_spans(tasks[0], "all")
