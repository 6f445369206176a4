"""Bars, rolling features, labels and splits."""

from pyspark.sql import functions as F

from tapeloom.contracts import MARKET_FEATURES
from tapeloom.functions.storage import cut
from tapeloom.operators import calendar as cal, dataset, market

from . import query
from .fixtures import BARS, FEATURES, SPLITS, bars, features, r6, rounded

KEY = ["symbol", "trade_date"]


def _oracle(*columns, ints=()):
    cols = ", ".join([r6(c, c) for c in columns] + list(ints))
    return f"WITH {FEATURES} SELECT symbol, trade_date, {cols} FROM f3"


def _keep(df, *columns):
    return rounded(df.select(*KEY, *columns))


@query("returns", _oracle(*[f"ret_{n}" for n in market.RETURN_STEPS]))
def returns(spark, d):
    return _keep(market.with_returns(bars(spark, d)), *[f"ret_{n}" for n in market.RETURN_STEPS])


@query("volatility", _oracle("volatility_5", "volatility_10", "volatility_20"))
def volatility(spark, d):
    df = market.with_volatility(market.with_returns(bars(spark, d), (1,)))
    return _keep(df, "volatility_5", "volatility_10", "volatility_20")


@query("moving_average", _oracle("ma_5", "ma_10", "ma_20", "ma_gap_5", "ma_gap_10", "ma_gap_20"))
def moving_average(spark, d):
    df = market.with_moving_average(bars(spark, d))
    return _keep(df, "ma_5", "ma_10", "ma_20", "ma_gap_5", "ma_gap_10", "ma_gap_20")


@query("gap_return", _oracle("gap_return"))
def gap_return(spark, d):
    return _keep(market.with_gap_return(bars(spark, d)), "gap_return")


@query("price_shape", _oracle("hl_range", "oc_return"))
def price_shape(spark, d):
    return _keep(market.with_price_shape(bars(spark, d)), "hl_range", "oc_return")


@query("rsi", _oracle("rsi_14"))
def rsi(spark, d):
    return _keep(market.with_rsi(bars(spark, d)), "rsi_14")


@query("momentum", _oracle("momentum_5", "momentum_10"))
def momentum(spark, d):
    return _keep(market.with_momentum(bars(spark, d)), "momentum_5", "momentum_10")


@query("volume_change", _oracle("volume_change_1", "volume_change_5"))
def volume_change(spark, d):
    return _keep(market.with_volume_change(bars(spark, d)), "volume_change_1", "volume_change_5")


@query("price_volume_corr", _oracle("price_volume_corr_5", "price_volume_corr_10"))
def price_volume_corr(spark, d):
    df = market.with_volume_change(market.with_returns(bars(spark, d), (1,)), (1,))
    return _keep(market.with_price_volume_corr(df), "price_volume_corr_5", "price_volume_corr_10")


@query("regimes", _oracle("close", ints=["trend_regime", "vol_regime", "drawdown_state"]))
def regimes(spark, d):
    df = market.with_volatility(market.with_returns(market.with_moving_average(bars(spark, d)), (1,)))
    return _keep(market.with_regimes(df), "close", "trend_regime", "vol_regime", "drawdown_state")


@query("labels_next_day", _oracle("next_ret_1", "next_oc_return", "y_cls"))
def labels_next_day(spark, d):
    return _keep(market.with_next_day(bars(spark, d)), "next_ret_1", "next_oc_return", "y_cls")


@query("assign_split", f"WITH {FEATURES} SELECT symbol, trade_date, split FROM f3")
def assign_split(spark, d):
    return bars(spark, d).select(*KEY, market.split_of("trade_date", SPLITS).alias("split"))


_INTS = ("trend_regime", "vol_regime", "drawdown_state")
_ALL = f"""WITH {FEATURES} SELECT symbol, trade_date, split, {', '.join(r6(f'coalesce({c}, 0)', c) for c in MARKET_FEATURES if c not in _INTS)},
  {', '.join(_INTS)}, {', '.join(r6(c, c) for c in ('next_ret_1', 'next_oc_return', 'y_cls'))} FROM f3"""


def _all(df):
    return rounded(df.select(*KEY, "split", *MARKET_FEATURES, "next_ret_1", "next_oc_return", "y_cls"))


@query("market_features", _ALL)
def market_features(spark, d):
    return _all(features(spark, d))


@query("market_features_blocks", _ALL)
def market_features_blocks(spark, d):
    """The same features with every series cut into blocks."""
    rows = cut(bars(spark, d))  # read twice: to number the blocks and to fill them
    return _all(market.market_features(rows, SPLITS, block_rows=100))


@query("trade_calendar", f"WITH {BARS} SELECT DISTINCT trade_date FROM bars")
def trade_calendar(spark, d):
    return cal.trade_calendar(bars(spark, d))


_SEQ = ["open", "close", "ret_1"]


_WINDOWS = f"""WITH {FEATURES},
s AS (SELECT symbol, trade_date, split, next_ret_1,
        list([{', '.join(f'CAST({c} AS FLOAT)' for c in ('open', 'close', 'coalesce(ret_1, 0)'))}]) OVER w AS x,
        count(*) OVER w AS n, min(split) OVER w AS lo, max(split) OVER w AS hi
      FROM f3 WINDOW w AS (PARTITION BY symbol ORDER BY trade_date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))
SELECT symbol, trade_date, split, i - 1 AS step, j - 1 AS feature, round(CAST(x[i][j] AS DOUBLE), 3) + 0.0 AS value
FROM s, range(1, 6) AS a(i), range(1, 4) AS b(j)
WHERE n = 5 AND lo = hi AND next_ret_1 IS NOT NULL"""


def _cells(windows):
    steps = windows.select(*KEY, "split", F.posexplode("x").alias("step", "row"))
    cells = steps.select(*KEY, "split", F.col("step").cast("long").alias("step"), F.posexplode("row").alias("feature", "value"))
    return cells.select(*KEY, "split", "step", F.col("feature").cast("long").alias("feature"),
                        (F.round(F.col("value").cast("double"), 3) + 0.0).alias("value"))


@query("sequence_windows", _WINDOWS)
def sequence_windows(spark, d):
    return _cells(dataset.sequence_windows(features(spark, d), _SEQ, 5))


@query("sequence_windows_blocks", _WINDOWS)
def sequence_windows_blocks(spark, d):
    """The same windows with every series cut into blocks."""
    f = features(spark, d, ["symbol"]).select(*KEY, "split", "next_ret_1", *_SEQ)  # rows are stored to be numbered: only what is read
    return _cells(dataset.sequence_windows(f, _SEQ, 5, block_rows=100))
