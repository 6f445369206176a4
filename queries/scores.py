"""Prediction metrics, backtest, models and suites."""

from pyspark.sql import functions as F

from tapeloom.contracts import REGIMES
from tapeloom.functions.storage import cut
from tapeloom.operators import backtest, dataset, evaluate, market, model
from tapeloom.plans import jobs

from . import query
from .fixtures import FEATURES, PREDICTIONS, RUNS, bars, features, predictions, r6, rounded, sql_div, table
from .text import main_table as _main

RUN = ["run_name", "split"]
CLS, REG = evaluate.CLS_METRICS, evaluate.REG_METRICS


def stored(spark, d):
    """Predictions as a stored table, the way an evaluation job finds them."""
    return cut(predictions(spark, d))


def _metrics(source, keys, name):
    """CTEs ``<name>``: all metrics of ``source`` per keys."""
    k = ", ".join(keys)
    on = " AND ".join(f"g.{c} = {{t}}.{c}" for c in keys)
    q = {c: sql_div(*ab) for c, ab in {
        "precision": ("tp", "tp + fp"), "recall": ("tp", "tp + fn"), "spec": ("tn", "tn + fp"),
        "f1": ("2 * tp", "2 * tp + fp + fn"), "accuracy": ("tp + tn", "tp + fp + fn + tn"),
        "mcc": ("tp * tn - fp * fn", "(sqrt(tp + fp) * sqrt(tp + fn) * sqrt(tn + fp) * sqrt(tn + fn))"),
        "auc": ("wins", "(p * n)")}.items()}
    pearson = "CASE WHEN stddev_pop({x}) > 0 AND stddev_pop({y}) > 0 THEN covar_pop({x}, {y}) / (stddev_pop({x}) * stddev_pop({y})) END"
    return f"""
{name}_cells AS (SELECT {k},
    CAST(sum(CASE WHEN y_cls = 1 AND pred_cls_score >= 0.5 THEN 1 ELSE 0 END) AS DOUBLE) AS tp,
    CAST(sum(CASE WHEN y_cls = 0 AND pred_cls_score >= 0.5 THEN 1 ELSE 0 END) AS DOUBLE) AS fp,
    CAST(sum(CASE WHEN y_cls = 1 AND pred_cls_score < 0.5 THEN 1 ELSE 0 END) AS DOUBLE) AS fn,
    CAST(sum(CASE WHEN y_cls = 0 AND pred_cls_score < 0.5 THEN 1 ELSE 0 END) AS DOUBLE) AS tn,
    avg((next_ret_1 - pred_reg) * (next_ret_1 - pred_reg)) AS mse, avg(abs(next_ret_1 - pred_reg)) AS mae,
    {pearson.format(x='next_ret_1', y='pred_reg')} AS ic FROM {source} GROUP BY {k}),
{name}_ranks AS (SELECT {k}, y_cls, next_ret_1, pred_reg, pred_cls_score,
    rank() OVER (PARTITION BY {k} ORDER BY pred_cls_score)
      + (count(*) OVER (PARTITION BY {k}, pred_cls_score) - 1) / 2.0::DOUBLE AS rs,
    rank() OVER (PARTITION BY {k} ORDER BY next_ret_1)
      + (count(*) OVER (PARTITION BY {k}, next_ret_1) - 1) / 2.0::DOUBLE AS ra,
    rank() OVER (PARTITION BY {k} ORDER BY pred_reg)
      + (count(*) OVER (PARTITION BY {k}, pred_reg) - 1) / 2.0::DOUBLE AS rp FROM {source}),
{name}_order AS (SELECT {k}, sum(CASE WHEN y_cls = 1 THEN rs END) - p * (p + 1) / 2 AS wins, p, n,
    rank_ic FROM (SELECT *, CAST(count(CASE WHEN y_cls = 1 THEN 1 END) OVER (PARTITION BY {k}) AS DOUBLE) AS p,
                            CAST(count(CASE WHEN y_cls = 0 THEN 1 END) OVER (PARTITION BY {k}) AS DOUBLE) AS n FROM {name}_ranks)
    JOIN (SELECT {k}, {pearson.format(x='ra', y='rp')} AS rank_ic FROM {name}_ranks GROUP BY {k}) USING ({k})
    GROUP BY {k}, p, n, rank_ic),
{name} AS (SELECT {', '.join(f'g.{c}' for c in keys)}, {q['accuracy']} AS accuracy,
    coalesce({q['precision']}, 0) AS precision, coalesce({q['recall']}, 0) AS recall, coalesce({q['f1']}, 0) AS f1,
    coalesce(({q['recall']} + {q['spec']}) / 2, {q['recall']}, {q['spec']}) AS balanced_accuracy,
    coalesce({q['mcc']}, 0) AS mcc, {q['auc']} AS auc, mse, sqrt(mse) AS rmse, mae, ic, rank_ic
  FROM {name}_cells g JOIN {name}_order o ON {on.format(t='o')})"""


_SPLIT_METRICS = f"{PREDICTIONS}, {_metrics('pred', RUN, 'm')}"


def _pick(names):
    return ", ".join(r6(c, c) for c in names)


@query("classification_metrics", f"WITH {_SPLIT_METRICS} SELECT run_name, split, {_pick(CLS[:-1])} FROM m")
def classification_metrics(spark, d):
    return rounded(evaluate.classification_metrics(stored(spark, d), RUN, auc=False))


@query("roc_auc", f"WITH {_SPLIT_METRICS} SELECT run_name, split, {_pick(['auc'])} FROM m")
def roc_auc(spark, d):
    return rounded(evaluate.roc_auc(stored(spark, d), RUN))


@query("regression_metrics", f"WITH {_SPLIT_METRICS} SELECT run_name, split, {_pick(REG[:-1])} FROM m")
def regression_metrics(spark, d):
    return rounded(evaluate.regression_metrics(stored(spark, d), RUN, rank=False))


@query("rank_ic", f"WITH {_SPLIT_METRICS} SELECT run_name, split, {_pick(['rank_ic'])} FROM m")
def rank_ic(spark, d):
    return rounded(evaluate.rank_ic(stored(spark, d), RUN))


@query("evaluate_predictions", f"WITH {_SPLIT_METRICS} SELECT run_name, split, {_pick(CLS + REG)} FROM m")
def evaluate_predictions(spark, d):
    return rounded(evaluate.evaluate_predictions(predictions(spark, d), RUN))


_LONG = f"""{PREDICTIONS},
long AS (SELECT * FROM (SELECT run_name, split, y_cls, next_ret_1, pred_cls_score, pred_reg, {', '.join(REGIMES)} FROM pred)
         UNPIVOT (group_value FOR group_column IN ({', '.join(REGIMES)}))), {_metrics('long', [*RUN, 'group_column', 'group_value'], 'm')}"""


@query("evaluate_groups", f"""WITH {_LONG} SELECT run_name, split, group_column, group_value,
       {', '.join(r6(c, 'cls_' + c) for c in CLS)}, {', '.join(r6(c, 'reg_' + c) for c in REG)} FROM m""")
def evaluate_groups(spark, d):
    return rounded(evaluate.evaluate_groups(predictions(spark, d), REGIMES, RUN))


@query("regime_grouping_sets", f"""WITH {PREDICTIONS} SELECT run_name, split, trend_regime, vol_regime, drawdown_state,
       count(*) AS n, {r6('avg(y_cls)', 'up_share')}, {r6('avg(next_ret_1)', 'mean_return')} FROM pred
       GROUP BY GROUPING SETS ((run_name, split, trend_regime), (run_name, split, vol_regime), (run_name, split, drawdown_state))""")
def regime_grouping_sets(spark, d):
    from pyspark.sql.functions import count, lit

    p = predictions(spark, d)
    sets = [[p.run_name, p.split, p[c]] for c in REGIMES]
    out = p.groupingSets(sets, p.run_name, p.split, *[p[c] for c in REGIMES]).agg(
        count(lit(1)).alias("n"), F.avg("y_cls").alias("up_share"), F.avg("next_ret_1").alias("mean_return"))
    return rounded(out)


@query("label_classes", f"WITH {PREDICTIONS} SELECT run_name, split, count(DISTINCT y_cls) AS n_classes FROM pred GROUP BY 1, 2")
def label_classes(spark, d):
    return evaluate.label_classes(predictions(spark, d), RUN)


# ---------------------------------------------------------------- backtest

COST, SERIES_KEYS, RANGES = 0.001, ["run_name", "split", "symbol"], 64
_BY = "PARTITION BY run_name, split, symbol"
_TO_NOW = f"({_BY} ORDER BY trade_date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
_STRATEGY = f"""{PREDICTIONS},
s1 AS (SELECT *, CASE WHEN pred_cls_score >= 0.5 THEN 1 ELSE 0 END AS signal FROM pred),
s2 AS (SELECT *, lag(signal, 1, 0) OVER ({_BY} ORDER BY trade_date) AS prev_signal FROM s1),
s3 AS (SELECT *, abs(signal - prev_signal) AS turnover,
         signal * next_oc_return - abs(signal - prev_signal) * {COST} AS strategy_return FROM s2),
s4 AS (SELECT *, CASE WHEN strategy_return IS NOT NULL THEN product(1 + strategy_return) OVER {_TO_NOW} END AS equity_curve FROM s3),
s5 AS (SELECT *, equity_curve / nullif(max(equity_curve) OVER {_TO_NOW}, 0) - 1 AS drawdown FROM s4)"""


_FRAME = f"""WITH {_STRATEGY} SELECT run_name, split, symbol, trade_date, signal, prev_signal, turnover,
       {r6('strategy_return', 'strategy_return')}, {r6('ln(equity_curve)', 'log_equity')} FROM s4"""


def _frame(out):
    return rounded(out.select(*SERIES_KEYS, "trade_date", "signal", "prev_signal", "turnover", "strategy_return",
                              F.ln("equity_curve").alias("log_equity")))


@query("strategy_frame", _FRAME)
def strategy_frame(spark, d):
    return _frame(backtest.strategy_frame(predictions(spark, d), 0.5, COST, SERIES_KEYS))


@query("strategy_frame_ranges", _FRAME)
def strategy_frame_ranges(spark, d):
    """The same rows with every series dealt out to many ranges."""
    return _frame(backtest.strategy_frame(predictions(spark, d), 0.5, COST, SERIES_KEYS, ranges=RANGES))


_TRADED = f"""{_STRATEGY},
a AS (SELECT run_name, split, symbol, count(strategy_return) AS n_days,
        count(CASE WHEN strategy_return IS NULL THEN 1 END) AS n_missing,
        arg_max(equity_curve, CASE WHEN strategy_return IS NOT NULL THEN trade_date END) AS last,
        avg(strategy_return) AS mean, stddev_pop(strategy_return) AS std, min(drawdown) AS down,
        avg(CASE WHEN strategy_return > 0 THEN 1.0::DOUBLE WHEN strategy_return IS NOT NULL THEN 0.0::DOUBLE END) AS wins
      FROM s5 GROUP BY 1, 2, 3),
traded AS (SELECT run_name, split, symbol, n_days, n_missing,
        last - 1 AS cumulative_return, CASE WHEN last > 0 THEN pow(last, 252.0::DOUBLE / n_days) - 1 ELSE -1 END AS annualized_return,
        CASE WHEN std > 0 THEN mean / std * sqrt(252.0::DOUBLE) ELSE 0 END AS sharpe, down AS max_drawdown, wins AS win_rate FROM a)"""

# Compounded returns span many magnitudes; they are compared as logarithms.
_LOGS = f"{r6('ln(nullif(1 + cumulative_return, 0))', 'log_return')}, {r6('ln(nullif(1 + annualized_return, 0))', 'log_annualized')}"


_METRICS = f"""WITH {_TRADED} SELECT run_name, split, symbol, n_days, n_missing, {_LOGS},
       {_pick(['sharpe', 'max_drawdown', 'win_rate'])} FROM traded"""


def _strategy_metrics(spark, d, ranges):
    frame = backtest.strategy_frame(predictions(spark, d), 0.5, COST, SERIES_KEYS, ranges=ranges)
    m = backtest.strategy_metrics(frame, 252, SERIES_KEYS, ranges=ranges)
    return rounded(m.select(*SERIES_KEYS, "n_days", "n_missing", F.ln(1 + F.col("cumulative_return")).alias("log_return"),
                            F.ln(1 + F.col("annualized_return")).alias("log_annualized"), "sharpe", "max_drawdown", "win_rate"))


@query("strategy_metrics", _METRICS)
def strategy_metrics(spark, d):
    return _strategy_metrics(spark, d, None)


@query("strategy_metrics_ranges", _METRICS)
def strategy_metrics_ranges(spark, d):
    """The same metrics, products and peaks carried from range to range."""
    return _strategy_metrics(spark, d, RANGES)


@query("suite_summary", f"""WITH {_TRADED}, {_metrics('pred', RUN, 'm')},
       grid AS (SELECT run_name, k AS factor FROM runs)
       SELECT grid.run_name, factor, symbol, {', '.join(r6(c, 'test_cls_' + c) for c in CLS)},
         {', '.join(r6(c, 'test_reg_' + c) for c in REG)},
         {', '.join(r6(c, 'test_strategy_' + c) for c in ('sharpe', 'max_drawdown', 'win_rate'))}
       FROM grid LEFT JOIN m ON m.run_name = grid.run_name AND m.split = 'test'
       LEFT JOIN traded t ON t.run_name = grid.run_name AND t.split = 'test'""")
def suite_summary(spark, d):
    p = stored(spark, d)
    traded = backtest.strategy_metrics(backtest.strategy_frame(p, 0.5, COST, SERIES_KEYS), 252, SERIES_KEYS)
    grid = spark.createDataFrame(list(RUNS), "run_name string, factor double")
    out = jobs.suite_summary(evaluate.evaluate_predictions(p, RUN), traded, grid)
    return rounded(out.drop("test_strategy_cumulative_return", "test_strategy_annualized_return"))


# ---------------------------------------------------------------- models

@query("score_label", f"""WITH {FEATURES} SELECT symbol, trade_date, {r6('1 / (1 + exp(-10 * coalesce(ret_1, 0)))', 'pred_cls_score')},
       CASE WHEN 1 / (1 + exp(-10 * coalesce(ret_1, 0))) >= 0.6 THEN 1 ELSE 0 END AS pred_cls_label FROM f3""")
def score_label(spark, d):
    f = features(spark, d).select("symbol", "trade_date", (10 * F.col("ret_1")).alias("logit"))
    return rounded(model.score_label(f, "logit", 0.6).drop("logit"))


@query("constant_model", f"""WITH {FEATURES} SELECT CAST(NULL AS DOUBLE) AS constant_class,
       CASE WHEN stddev_pop(next_ret_1) = 0 THEN avg(next_ret_1) END AS constant_return,
       {r6('avg(next_ret_1)', 'mean_return')}, 1.0::DOUBLE AS up_class
       FROM f3 WHERE split = 'train' AND next_ret_1 IS NOT NULL""")
def constant_model(spark, d):
    """Both labels vary on all training rows; the rows of rising days hold one class only."""
    train = dataset.tabular_rows(features(spark, d), ["close"], "train")
    varied = model.constant_labels(train)
    mean = train.agg(F.avg("next_ret_1").alias("mean_return"))
    rising = model.constant_labels(train.where("y_cls = 1")).select(F.col("constant_class").alias("up_class"))
    one = F.lit(1).alias("one")
    joined = varied.select("*", one).join(mean.select("*", one), "one").join(rising.select("*", one), "one")
    return joined.select("constant_class", "constant_return", *rounded(joined.select("mean_return")).columns, "up_class").withColumn(
        "mean_return", F.floor(F.col("mean_return") * 1000000 + 0.5) / 1000000.0)


@query("union_splits", f"""WITH {PREDICTIONS} SELECT run_name, symbol, trade_date, split FROM pred
                           WHERE split IN ('train', 'valid', 'test')""")
def union_splits(spark, d):
    p = cut(predictions(spark, d).select("run_name", "symbol", "trade_date", "split"))  # worked out once for the three parts
    parts = [p.where(F.col("split") == s) for s in model.SCORED_SPLITS]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("fit_predict_gbt")
def fit_predict_gbt(spark, d):
    f = cut(features(spark, d))
    names = dataset.feature_space(f.columns, "num", without_regimes=False)["inputs"]
    models = model.fit_tabular(dataset.tabular_rows(f, names, "train"), names, "multitask")
    scored = model.predict(dataset.tabular_rows(f, names, "test"), models, names)
    return scored.select("symbol", "trade_date", "pred_cls_score", "pred_cls_label", "pred_reg")


@query("train_predictions")
def train_predictions(spark, d):
    main = cut(_main(spark, d).join(bars(spark, d), ["symbol", "trade_date"]))
    predicted, _ = model.train_tabular(main, "multitask", carry=["symbol"])
    return predicted


@query("train_suite")
def train_suite(spark, d):
    main = cut(features(spark, d))
    predicted, grid = model.train_suite(main, {"task": ["cls", "reg"]}, {"modality": "num"}, carry=["symbol"])
    predicted = cut(predicted)
    keys = ["run_name", "split", "symbol"]
    traded = backtest.strategy_metrics(backtest.strategy_frame(predicted, 0.5, 0.0, keys), 252, keys)
    options = spark.createDataFrame([tuple(g.values()) for g in grid], list(grid[0]))
    return jobs.suite_summary(evaluate.evaluate_predictions(predicted, RUN), traded, options)
