"""Rolling market features, regimes, splits and next-day labels.

Windows run over ``keys`` in ``order``. A series has one row per calendar day, so a window partition is bounded by the
length of the calendar. For longer series (no key at all, or intraday rows) ``market_features(block_rows=...)`` cuts
each series into blocks that carry the rows their first windows look back on.
"""

import numpy as np
from pyspark.sql import Window, functions as F

from ..contracts import (BASE_INPUTS, DEFAULT_SPLITS, MARKET_FEATURES, MOMENTUM, MOVING_AVERAGES, REGIMES, RETURNS, SERIES,
                         VOLATILITY)
from ..functions.numeric import as_col, change, flag, ratio, with_finite
from ..functions.rolling import (lagged, quotient, relative, rolling_cov, rolling_mean, rolling_median, rolling_std,
                                 with_rolling)

RETURN_STEPS = (1, 2, 3, 5, 10, 20)
VOLATILITY_WINDOWS = (5, 10, 20)
MA_WINDOWS = (5, 10, 20)
RSI_PERIOD = 14
MOMENTUM_STEPS = (5, 10)
VOLUME_STEPS = (1, 5)
CORR_WINDOWS = (5, 10)
VOL_MEDIAN_WINDOW, VOL_MEDIAN_MIN = 60, 20
DRAWDOWN_LIMIT = -0.1

# The columns in the order in which the ``with_*`` functions add them.
FEATURE_COLUMNS = (RETURNS + ["hl_range", "oc_return", "gap_return"] + MOVING_AVERAGES + MOMENTUM + ["volume_change_1", "volume_change_5"]
                   + ["next_ret_1", "next_oc_return", "y_cls"] + VOLATILITY + ["price_volume_corr_5", "price_volume_corr_10"] + REGIMES)

# Rows before a row that can reach it: 60-row median over 20-row volatility over a 1-row return.
LOOK_BACK = (VOL_MEDIAN_WINDOW - 1) + (max(VOLATILITY_WINDOWS) - 1) + 1


def series_window(keys=SERIES, order="trade_date"):
    return Window.partitionBy(*keys).orderBy(order)


def _last(n, keys, order):
    return series_window(keys, order).rowsBetween(-(n - 1), 0)


def _so_far(keys, order):
    return series_window(keys, order).rowsBetween(Window.unboundedPreceding, 0)


def _full(value, agg, n, keys, order):
    """``agg(value)`` over the last n rows, NULL unless all n values are known."""
    w = _last(n, keys, order)
    return F.when(F.count(value).over(w) == n, agg(value).over(w))


def with_returns(df, windows=RETURN_STEPS, keys=SERIES, order="trade_date"):
    w = series_window(keys, order)
    return df.withColumns({f"ret_{n}": change("close", F.lag("close", n).over(w)) for n in windows})


def with_gap_return(df, keys=SERIES, order="trade_date"):
    return df.withColumn("gap_return", change("open", F.lag("close", 1).over(series_window(keys, order))))


def with_price_shape(df):
    return df.withColumns({
        "hl_range": ratio(F.col("high") - F.col("low"), "close"),
        "oc_return": ratio(F.col("close") - F.col("open"), "open"),
    })


def with_volatility(df, windows=VOLATILITY_WINDOWS, keys=SERIES, order="trade_date"):
    """Needs ``ret_1``."""
    return df.withColumns({f"volatility_{n}": _full(F.col("ret_1"), F.stddev_samp, n, keys, order) for n in windows})


def with_moving_average(df, windows=MA_WINDOWS, keys=SERIES, order="trade_date"):
    df = df.withColumns({f"ma_{n}": _full(F.col("close"), F.avg, n, keys, order) for n in windows})
    return df.withColumns({f"ma_gap_{n}": change("close", f"ma_{n}") for n in windows})


def with_rsi(df, period=RSI_PERIOD, keys=SERIES, order="trade_date"):
    """Simple-mean RSI; NULL when the window has no loss."""
    step = F.col("close") - F.lag("close", 1).over(series_window(keys, order))
    df = df.withColumn("_step", step)
    gain = F.when(F.col("_step").isNotNull(), F.greatest(F.col("_step"), F.lit(0.0)))
    loss = F.when(F.col("_step").isNotNull(), F.greatest(-F.col("_step"), F.lit(0.0)))
    strength = ratio(_full(gain, F.avg, period, keys, order), _full(loss, F.avg, period, keys, order))
    return df.withColumn(f"rsi_{period}", 100.0 - ratio(F.lit(100.0), 1.0 + strength)).drop("_step")


def with_momentum(df, windows=MOMENTUM_STEPS, keys=SERIES, order="trade_date"):
    w = series_window(keys, order)
    return df.withColumns({f"momentum_{n}": F.col("close") - F.lag("close", n).over(w) for n in windows})


def with_volume_change(df, windows=VOLUME_STEPS, keys=SERIES, order="trade_date"):
    w = series_window(keys, order)
    return df.withColumns({f"volume_change_{n}": change("volume", F.lag("volume", n).over(w)) for n in windows})


def with_price_volume_corr(df, windows=CORR_WINDOWS, keys=SERIES, order="trade_date"):
    """Rolling Pearson of ``ret_1`` and ``volume_change_1``; NULL when one of them does not vary."""
    x, y = F.col("ret_1"), F.col("volume_change_1")
    both = x.isNotNull() & y.isNotNull()
    cols = {}
    for n in windows:
        w = _last(n, keys, order)
        sx, sy = F.stddev_samp(x).over(w), F.stddev_samp(y).over(w)
        known = (F.count(F.when(both, 1)).over(w) == n) & (sx > 1e-12) & (sy > 1e-12)
        cols[f"price_volume_corr_{n}"] = F.when(known, ratio(F.covar_samp(x, y).over(w), sx * sy))
    return df.withColumns(cols)


def with_regimes(df, keys=SERIES, order="trade_date", earlier_peak=None):
    """Needs ``ma_gap_20`` and ``volatility_20``. ``earlier_peak``: highest close before the rows at hand."""
    df = with_finite(df, ["ma_gap_20", "volatility_20", "close"])
    w = _last(VOL_MEDIAN_WINDOW, keys, order)
    vol = F.col("volatility_20")
    df = df.withColumn("_vols", F.sort_array(F.collect_list(vol).over(w)))
    known = F.size("_vols")
    middle = F.get("_vols", F.floor((known - 1) / 2).cast("int")) + F.get("_vols", F.floor(known / 2).cast("int"))
    median = F.when(known >= VOL_MEDIAN_MIN, middle / 2.0)
    return _with_flags(df, median, F.max("close").over(_so_far(keys, order)), earlier_peak).drop("_vols")


def _with_flags(df, median, peak, earlier_peak):
    if earlier_peak is not None:
        peak = F.greatest(peak, as_col(earlier_peak))
    return df.withColumns({
        "trend_regime": flag(F.col("ma_gap_20") > 0.0),
        "vol_regime": flag(F.col("volatility_20") > median),
        "drawdown_state": flag(change("close", peak) <= DRAWDOWN_LIMIT),
    })


def with_next_day(df, keys=SERIES, order="trade_date"):
    """Next-day return, next day's open-to-close return and up/down label."""
    df = with_finite(df, ["open", "close"])
    w = series_window(keys, order)
    df = df.withColumns({
        "next_ret_1": change(F.lead("close", 1).over(w), "close"),
        "next_oc_return": change(F.lead("close", 1).over(w), F.lead("open", 1).over(w)),
    })
    up = F.when(F.col("next_ret_1").isNotNull(), flag(F.col("next_ret_1") > 0.0).cast("double"))
    return df.withColumn("y_cls", up)


def split_of(date, bounds=None):
    """Name of the split a date falls in; an unknown date counts as test."""
    bounds = bounds or DEFAULT_SPLITS
    d = as_col(date)

    def upto(name):
        return d <= F.to_date(F.lit(bounds[name]))

    return (F.when(upto("train_end"), "train").when(upto("valid_end"), "valid").when(upto("test_end"), "test")
            .when(d.isNotNull(), "holdout").otherwise("test"))


def series_blocks(df, block_rows, keys=SERIES, order="trade_date", look_back=LOOK_BACK):
    """Cut every series into blocks of about ``block_rows`` rows.

    Adds ``_block`` and ``_own``: a block also holds copies (``_own = false``) of at least ``look_back`` rows before it
    and the row after it. Rows are counted per month first (map-side), so the window that numbers the blocks holds one
    row per month, and copies are whole months. Rows without a date are the first month; NULL keys are a series.
    """
    keys = list(keys)
    months = df.groupBy(*keys, F.trunc(order, "month").alias("_month")).agg(
        F.count("*").alias("_n"), F.max("close").alias("_high"))
    w = Window.partitionBy(*keys).orderBy("_month")
    before = F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    months = months.withColumn("_from", before)
    months = months.withColumn("_home", F.floor(F.col("_from") / block_rows))
    reach = F.floor((F.col("_from") + F.col("_n") + (look_back - 1)) / block_rows)
    previous = F.coalesce(F.lag("_home", 1).over(w), F.col("_home"))
    peak = F.max("_high").over(w.rowsBetween(Window.unboundedPreceding, -1))
    months = months.select(
        *[F.col(k).alias(f"_key_{i}") for i, k in enumerate(keys)], F.col("_month").alias("_of"), "_home", peak.alias("_peak"),
        F.array_union(F.sequence("_home", reach), F.array(previous)).alias("_blocks"))
    match = F.trunc(order, "month").eqNullSafe(F.col("_of"))
    for i, k in enumerate(keys):
        match = match & F.col(k).eqNullSafe(F.col(f"_key_{i}"))
    placed = df.join(months, match)
    return (placed.withColumn("_block", F.explode("_blocks"))
            .withColumn("_own", F.col("_block") == F.col("_home"))
            .drop("_blocks", "_home", "_of", *[f"_key_{i}" for i in range(len(keys))]))


_LAGGED = [*RETURNS, *[f"momentum_{n}" for n in MOMENTUM_STEPS], *[f"volume_change_{n}" for n in VOLUME_STEPS], "gap_return",
           "hl_range", "oc_return", *[f"{kind}_{n}" for kind in ("ma", "ma_gap") for n in MA_WINDOWS]]
_ROLLED = [*VOLATILITY, *[f"price_volume_corr_{n}" for n in CORR_WINDOWS], f"rsi_{RSI_PERIOD}", "_median"]


def _rolled(values, place):
    """The features of a batch of sorted rows; NaN stands for NULL and for infinities."""
    open_, close, volume = values["open"], values["close"], values["volume"]
    before = {n: lagged(close, place, n) for n in {1, *RETURN_STEPS, *MOMENTUM_STEPS}}
    made = {f"ret_{n}": relative(close, before[n]) for n in RETURN_STEPS}
    made |= {f"momentum_{n}": close - before[n] for n in MOMENTUM_STEPS}
    made |= {f"volume_change_{n}": relative(volume, lagged(volume, place, n)) for n in VOLUME_STEPS}
    made["gap_return"] = relative(open_, before[1])
    made["hl_range"], made["oc_return"] = quotient(values["high"] - values["low"], close), quotient(close - open_, open_)
    made |= {f"ma_{n}": np.where(place >= n, rolling_mean(close, n), np.nan) for n in MA_WINDOWS}
    made |= {f"ma_gap_{n}": relative(close, made[f"ma_{n}"]) for n in MA_WINDOWS}
    x, y, step = made["ret_1"], made["volume_change_1"], close - before[1]
    sx = {n: rolling_std(x, n) for n in {*VOLATILITY_WINDOWS, *CORR_WINDOWS}}
    made |= {f"volatility_{n}": np.where(place >= n, sx[n], np.nan) for n in VOLATILITY_WINDOWS}
    for n in CORR_WINDOWS:
        sy = rolling_std(y, n)
        varied = (place >= n) & ~(sx[n] <= 1e-12) & ~(sy <= 1e-12)
        made[f"price_volume_corr_{n}"] = np.where(varied, rolling_cov(x, y, n) / (sx[n] * sy), np.nan)
    full = place >= RSI_PERIOD
    gains = np.where(full, rolling_mean(np.maximum(step, 0.0), RSI_PERIOD), np.nan)
    losses = np.where(full, rolling_mean(np.maximum(-step, 0.0), RSI_PERIOD), np.nan)
    made[f"rsi_{RSI_PERIOD}"] = 100.0 - quotient(100.0, 1.0 + quotient(gains, losses))
    vol = made["volatility_20"]
    made["_median"] = rolling_median(np.where(np.isinf(vol), np.nan, vol), place, VOL_MEDIAN_WINDOW, VOL_MEDIAN_MIN)
    return {c: np.where(np.isfinite(v), v, np.nan) for c, v in made.items()}


def _features(df, keys, order, earlier_peak):
    """The columns of the ``with_*`` functions: one window pass over the bars, one rolling pass over the sorted rows.

    Spark's sliding frames go through all rows of a frame again for every row, one update at a time; the rolling pass does
    the same updates for a batch of rows at once. Only the bars, the next day's prices and the peak go through it, and few
    expressions follow it: Java does not compile a method of more than 8000 bytes, so a long projection would be interpreted.
    ``df`` holds finite inputs.
    """
    kept, w = df.columns, series_window(keys, order)
    df = df.withColumns({
        "_next_close": F.lead("close", 1).over(w), "_next_open": F.lead("open", 1).over(w),
        "_high_close": F.max("close").over(_so_far(keys, order)), "_place": F.row_number().over(w)})
    df = with_rolling(df, BASE_INPUTS, "_place", [*_LAGGED, *_ROLLED], LOOK_BACK, _rolled)
    df = df.withColumns({"next_ret_1": change("_next_close", "close"), "next_oc_return": change("_next_close", "_next_open")})
    up = F.when(F.col("next_ret_1").isNotNull(), flag(F.col("next_ret_1") > 0.0).cast("double"))
    df = _with_flags(df.withColumn("y_cls", up), F.col("_median"), F.col("_high_close"), earlier_peak)
    return df.select(*kept, *FEATURE_COLUMNS)


def market_features(bars, split_dates=None, keys=SERIES, order="trade_date", fill_value=0.0, block_rows=None):
    """All 28 features and 4 labels over ``bars``; feature NULLs become ``fill_value`` (None keeps them)."""
    bars = with_finite(bars, BASE_INPUTS)
    if block_rows:
        cut = series_blocks(bars, block_rows, keys, order)
        # A peak of the months before counts only once per block: the running peak takes it from there.
        df = _features(cut, [*keys, "_block"], order, "_peak")
        df = df.where("_own").drop("_own", "_block", "_peak")
    else:
        df = _features(bars, list(keys), order, None)
    if fill_value is not None:  # the features hold no infinities
        df = df.withColumns({c: F.coalesce(c, F.lit(float(fill_value))) for c in MARKET_FEATURES if c not in REGIMES})
    return df.withColumn("split", split_of(order, split_dates))
