"""Generated code of the market features, metrics by shared order, and classes of common shingles."""

from queries.fixtures import rounded
from tapeloom.operators import backtest, evaluate, market

from test_repairs_r03 import series


def test_no_generated_method_of_the_features_is_too_long_to_compile(spark):
    """Java interprets methods of more than 8000 bytes; before, the projection behind the rolling pass was one of them."""
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = rounded(market.market_features(series(spark, 40)))._jdf.queryExecution().debug().codegenToSeq()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    sizes = [plan.apply(i)._3().maxMethodCodeSize() for i in range(plan.size())]
    assert sizes and max(sizes) < 8000


def test_features_of_prices_that_overflow(spark):
    """An infinite quotient is NULL, a zero divisor too."""
    rows = spark.sql("select 'a' symbol, date_add(date'2020-01-01', cast(id as int)) trade_date, 1.0D open, 2.0D high, 1.0D low, "
                     "if(id = 1, 1e-300D, if(id = 2, 1e300D, 0.0D)) close, 1.0D volume from range(4)")
    got = market.market_features(rows, fill_value=None).orderBy("trade_date").collect()
    assert [r["ret_1"] for r in got] == [None, None, None, -1.0]
    assert [r["hl_range"] for r in got] == [None, 1 / 1e-300, 1 / 1e300, None]


PREDICTIONS = """select concat('r', id % 2) run_name, 'test' split, cast(id % 7 as string) symbol,
    date_add(date'2020-01-01', cast(id / 7 as int)) trade_date, if(id % 11 = 0, null, cast(id % 2 as double)) y_cls,
    if(id % 13 = 0, null, cast(id % 5 as double)) next_ret_1, 0.01D next_oc_return, cast(id % 4 / 4 as double) pred_cls_score,
    if(id % 17 = 0, double('nan'), cast(id % 6 as double)) pred_reg, cast(id % 2 as int) trend_regime,
    if(id % 9 = 0, null, cast(id % 3 as int)) vol_regime, 1 drawdown_state from range(600)"""


def test_strategy_sorts_once_in_more_tasks(spark):
    """Before, a task sorted its rows twice, and only the default number of tasks shared them."""
    rows = spark.sql(PREDICTIONS).localCheckpoint()
    out = backtest.strategy_frame(rows, keys=["run_name", "split", "symbol"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    tasks = backtest.SPREAD * int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert plan.count(" Sort [") == 1 and f", {tasks}), REPARTITION_BY_NUM" in plan
    assert out.count() == 600


def test_groups_count_pairs_once(spark, monkeypatch):
    """The pairs of all group columns are shuffled once; before, each prediction went there once per column."""
    rows, seen, pairs = spark.sql(PREDICTIONS).localCheckpoint(), [], evaluate._pairs
    monkeypatch.setattr(evaluate, "_pairs", lambda df, keys, *more: seen.append((df.count(), list(keys))) or pairs(df, keys, *more))
    got = evaluate.evaluate_groups(rows, keys=("run_name",))
    assert seen == [(600, ["run_name", "trend_regime", "vol_regime", "drawdown_state"])]
    long = evaluate.long_groups(rows, keys=("run_name",))
    plain = evaluate.evaluate_predictions(long, ("run_name", "group_column", "group_value"))

    def flat(df):
        return sorted([tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect()], key=repr)

    assert len(flat(got)) == 10 and flat(got) == flat(plain)
