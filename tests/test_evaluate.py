import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tapeloom.functions.skew import average_ranks, join_heavy
from tapeloom.operators import backtest, evaluate

SCHEMA = "run string, y_cls double, next_ret_1 double, pred_cls_score double, pred_reg double"


def frame(seed=0, n=600):
    rng = np.random.default_rng(seed)
    f = pd.DataFrame({"run": rng.choice(["a", "b", "b", "b"], n), "next_ret_1": np.round(rng.normal(0, 1, n), 1)})
    f["y_cls"] = (f.next_ret_1 > 0).astype(float)
    f["pred_cls_score"] = np.round(rng.random(n), 1)
    f["pred_reg"] = np.round(f.next_ret_1 + rng.normal(0, 1, n), 1)
    flat = f.head(50).assign(run="flat", pred_reg=0.0, y_cls=1.0)
    return pd.concat([f, flat])[["run", "y_cls", "next_ret_1", "pred_cls_score", "pred_reg"]]


def auc(y, s):
    pos, neg = s[y == 1], s[y == 0]
    return np.mean([(p > neg).mean() + (p == neg).mean() / 2 for p in pos]) if len(pos) and len(neg) else None


def test_metrics_match_plain_formulas(spark):
    f = frame()
    got = {r.run: r for r in evaluate.evaluate_predictions(spark.createDataFrame(f, SCHEMA), ["run"]).collect()}
    for run, g in f.groupby("run"):
        y, said = g.y_cls.values, (g.pred_cls_score >= 0.5).values
        tp, fp, fn, tn = (y * said).sum(), ((1 - y) * said).sum(), (y * ~said).sum(), ((1 - y) * ~said).sum()
        r = got[run]
        assert r.accuracy == pytest.approx((tp + tn) / len(g))
        assert r.f1 == pytest.approx(2 * tp / (2 * tp + fp + fn))
        assert r.mse == pytest.approx(((g.next_ret_1 - g.pred_reg) ** 2).mean())
        if run == "flat":
            assert r.auc is None and r.ic is None and r.rank_ic is None and r.mcc == 0.0
            assert r.balanced_accuracy == pytest.approx(tp / (tp + fn))
        else:
            assert r.auc == pytest.approx(auc(y, g.pred_cls_score.values))
            assert r.rank_ic == pytest.approx(g.next_ret_1.rank().corr(g.pred_reg.rank()))
            assert r.ic == pytest.approx(g.next_ret_1.corr(g.pred_reg))
            assert r.balanced_accuracy == pytest.approx((tp / (tp + fn) + tn / (tn + fp)) / 2)


def test_tasks_without_predictions_are_null(spark):
    df = spark.createDataFrame(frame(), SCHEMA).withColumn("pred_cls_score", F.lit(None).cast("double"))
    row = evaluate.evaluate_predictions(df, ["run"]).where("run = 'a'").first()
    assert row.accuracy is None and row.auc is None and row.rank_ic is not None


def test_groups(spark):
    df = spark.createDataFrame(frame(), SCHEMA).withColumns({"up": F.col("y_cls").cast("int"), "one": F.lit(1)})
    out = evaluate.evaluate_groups(df, ["up", "one"], ["run"])
    assert out.count() == 2 + 2 + 1 + 3
    assert out.where("group_column = 'up' and cls_auc is not null").count() == 0


def test_ranks_with_few_buckets(spark):
    f = frame(3)
    got = average_ranks(spark.createDataFrame(f, SCHEMA), ["run"], "pred_reg", "r", buckets=4).toPandas()
    f["r"] = f.groupby("run").pred_reg.rank()
    want = f.drop_duplicates(["run", "pred_reg"])
    merged = got.merge(want, on=["run", "pred_reg"])
    assert len(merged) == len(want) and np.allclose(merged.r_x, merged.r_y)


@pytest.mark.parametrize("hot_rows", [0, 1000])
def test_join_heavy_equals_a_left_join(spark, hot_rows):
    left = spark.range(500).select("id", F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") % 50 == 1, F.lit(None))
                                   .otherwise(F.concat(F.lit("k"), F.col("id") % 40)).alias("k"))
    right = left.where("k is not null and k <> 'k7'").groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("top"))
    got = join_heavy(left, right, "k", "n", heavy=2, hot_rows=hot_rows).orderBy("id").collect()
    want = left.join(right, "k", "left").select("id", "k", "n", "top").orderBy("id").collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in want]


def test_backtest_by_hand(spark):
    rows = [(1, 0.9, 0.10), (2, 0.9, -0.20), (3, 0.1, 0.50), (4, 0.7, None), (5, 0.8, 0.05)]
    df = spark.createDataFrame([("t", *r, None) for r in rows], "split string, trade_date int, pred_cls_score double, next_oc_return double, pred_reg double")
    frame = backtest.strategy_frame(df, 0.5, 0.01)
    got = frame.orderBy("trade_date").toPandas()
    returns = [0.09, -0.2, -0.01, None, 0.05]
    assert got.signal.tolist() == [1, 1, 0, 1, 1] and got.turnover.tolist() == [1, 0, 1, 1, 0]
    known = [r for r in returns if r is not None]
    np.testing.assert_allclose(got.strategy_return.dropna(), known)
    np.testing.assert_allclose(got.equity_curve.dropna(), np.cumprod(1 + np.array(known)))
    assert np.isnan(got.equity_curve[3])
    m = backtest.strategy_metrics(frame, 252).first()
    equity = np.cumprod(1 + np.array(known))
    assert m.n_days == 4 and m.n_missing == 1 and m.win_rate == 0.5
    assert m.cumulative_return == pytest.approx(equity[-1] - 1)
    assert m.annualized_return == pytest.approx(equity[-1] ** 63 - 1)
    assert m.sharpe == pytest.approx(np.mean(known) / np.std(known) * 252 ** 0.5)
    assert m.max_drawdown == pytest.approx((equity / np.maximum.accumulate(equity) - 1).min())


def test_signal_falls_back_to_the_regression(spark):
    df = spark.createDataFrame([("t", 1, 0.2), ("t", 2, -0.2), ("u", 1, None)], "split string, trade_date int, pred_reg double") \
        .withColumns({"pred_cls_score": F.lit(None).cast("double"), "next_oc_return": F.lit(0.1)})
    got = {(r.split, r.trade_date): r.signal for r in backtest.strategy_frame(df).collect()}
    assert got == {("t", 1): 1, ("t", 2): 0, ("u", 1): 0}
    flat = backtest.strategy_metrics(backtest.strategy_frame(df)).where("split = 'u'").first()
    assert flat.sharpe == 0.0 and flat.cumulative_return == 0.0
