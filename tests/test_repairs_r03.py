"""Steps that are worked out once, title joins without texts, and the rolling pass of the market features."""

import datetime
import random

import pytest

from queries import scores, text
from tapeloom.operators import market, near_titles


def series(spark, rows=130):
    rng, out = random.Random(5), []
    for symbol in ("a", "b", None):
        for day in range(rows if symbol == "a" else 30):
            close = None if rng.random() < 0.02 else round(rng.uniform(5, 9), 2) if symbol else 7.0
            out.append((symbol, datetime.date(2020, 1, 1) + datetime.timedelta(days=day), rng.uniform(5, 9), 9.5, 4.5, close,
                        float(rng.randint(0, 5))))
    return spark.createDataFrame(out, "symbol string, trade_date date, open double, high double, low double, close double, volume double")


@pytest.mark.parametrize("block_rows", [None, 40])
def test_features_equal_the_single_window_functions(spark, block_rows):
    """Bit for bit, with NULL prices, a NULL series and a series that does not vary."""
    bars = series(spark)
    one = market.with_price_shape(market.with_returns(bars))
    one = market.with_momentum(market.with_rsi(market.with_moving_average(market.with_gap_return(one))))
    one = market.with_volatility(market.with_next_day(market.with_volume_change(one)))
    one = market.with_regimes(market.with_price_volume_corr(one))
    got = market.market_features(bars, fill_value=None, block_rows=block_rows).drop("split")
    one = one.select(*got.columns)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, one.collect()))


def test_series_without_sliding_frames(spark):
    """Before, every row went through all rows of its frames again."""
    plan = market.market_features(series(spark, 40))._jdf.queryExecution().optimizedPlan().toString()
    assert "stddev_samp" not in plan and "collect_list" not in plan


def test_rows_out_of_order_end_the_rolling_pass(spark):
    from tapeloom.functions.rolling import with_rolling

    rows = spark.createDataFrame([(1, 1.0), (3, 2.0)], "place int, x double").coalesce(1)
    with pytest.raises(Exception, match="not sorted by series"):
        with_rolling(rows, ["x"], "place", ["y"], 5, lambda v, place: {"y": v["x"]}).collect()


def test_low_thresholds_join_keys_not_texts(spark, monkeypatch):
    seen, fetched = [], near_titles._fetched

    def spy(pairs, rows):
        seen.append(sorted(pairs.columns))
        return fetched(pairs, rows)

    monkeypatch.setattr(near_titles, "_fetched", spy)
    rows = spark.sql("select concat('n', id) news_id, timestamp_ntz'2020-01-01 00:00:00' publish_time, "
                     "concat(repeat('bank sector rises ', 20), id) title_clean, 1 content_len from range(3)")
    assert near_titles.similar_titles(rows, 0.8, 24).count() == 6
    assert seen == [["dst", "src"]]


@pytest.mark.parametrize("module, name", [(text, "standardize"), (text, "standardize_per_series"), (scores, "union_splits")])
def test_features_are_worked_out_once(spark, monkeypatch, module, name):
    stored, keep = [], module.cut
    monkeypatch.setattr(module, "cut", lambda df: stored.append(df.columns) or keep(df))
    getattr(module, name)(spark, "/root/testdata/sf0.001")
    assert len(stored) == 1 and "trade_date" in stored[0]
