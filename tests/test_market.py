import numpy as np
import pandas as pd
import pytest

from tapeloom.contracts import MARKET_FEATURES
from tapeloom.operators import dataset, market


def series(seed, n, symbol):
    rng = np.random.default_rng(seed)
    close = np.abs(np.round(100 + np.cumsum(rng.normal(0, 2, n)), 2))
    frame = pd.DataFrame({
        "symbol": symbol, "trade_date": pd.bdate_range("2020-01-01", periods=n).date, "open": close * 1.01,
        "high": close * 1.02, "low": close * 0.98, "close": close, "volume": rng.integers(0, 5, n).astype(float)})
    if seed == 1:
        frame.loc[10:40, "close"] = 50.0
        frame.loc[60, "close"] = 0.0
        frame.loc[70:110, "close"] = np.arange(41) + 20.0
    return frame


def by_hand(f):
    """The features of one series row by row, from their definitions; None where a window is short or a divisor is 0."""
    rows = f.to_dict("records")
    close = [r["close"] for r in rows]

    def over(a, b):
        return None if a is None or not b else a / b - 1

    def tail(values, i, n):
        part = values[max(0, i - n + 1):i + 1]
        return part if len(part) == n and None not in part else None

    def spread(part):
        mean = sum(part) / len(part)
        return (sum((x - mean) ** 2 for x in part) / (len(part) - 1)) ** 0.5

    def step(values, i, n):
        return over(values[i], values[i - n]) if i >= n else None

    ret = [step(close, i, 1) for i in range(len(rows))]
    traded = [step([r["volume"] for r in rows], i, 1) for i in range(len(rows))]
    vol20 = [spread(p) if (p := tail(ret, i, 20)) else None for i in range(len(rows))]
    out = []
    for i, r in enumerate(rows):
        x = {f"ret_{n}": step(close, i, n) for n in (1, 2, 3, 5, 10, 20)}
        for n in (5, 10, 20):
            x[f"volatility_{n}"] = spread(p) if (p := tail(ret, i, n)) else None
            x[f"ma_{n}"] = sum(p) / n if (p := tail(close, i, n)) else None
            x[f"ma_gap_{n}"] = over(r["close"], x[f"ma_{n}"])
        x["hl_range"] = (r["high"] - r["low"]) / r["close"] if r["close"] else None
        x["oc_return"] = over(r["close"], r["open"])
        x["gap_return"] = over(r["open"], close[i - 1]) if i else None
        moves = [close[k] - close[k - 1] for k in range(i - 13, i + 1)] if i >= 14 else []
        fell = -sum(m for m in moves if m < 0)
        x["rsi_14"] = 100 - 100 / (1 + sum(m for m in moves if m > 0) / fell) if fell else None
        for n in (5, 10):
            x[f"momentum_{n}"] = close[i] - close[i - n] if i >= n else None
            a, b = tail(ret, i, n), tail(traded, i, n)
            flat = not a or not b or spread(a) <= 1e-12 or spread(b) <= 1e-12
            x[f"price_volume_corr_{n}"] = None if flat else float(np.corrcoef(a, b)[0, 1])
        for n in (1, 5):
            x[f"volume_change_{n}"] = step([q["volume"] for q in rows], i, n)
        known = sorted(v for v in vol20[max(0, i - 59):i + 1] if v is not None)
        middle = (known[(len(known) - 1) // 2] + known[len(known) // 2]) / 2 if len(known) >= 20 else None
        x["trend_regime"] = int(x["ma_gap_20"] is not None and x["ma_gap_20"] > 0)
        x["vol_regime"] = int(None not in (vol20[i], middle) and vol20[i] > middle)
        below = over(r["close"], max(close[:i + 1]))
        x["drawdown_state"] = int(below is not None and below <= -0.1)
        x = {k: 0.0 if v is None else v for k, v in x.items()}
        after = rows[i + 1] if i + 1 < len(rows) else None
        x["next_ret_1"] = over(after["close"], r["close"]) if after else None
        x["next_oc_return"] = over(after["close"], after["open"]) if after else None
        out.append(x)
    return pd.DataFrame(out).astype(float)


@pytest.fixture(scope="module")
def frames():
    return [series(1, 260, "a"), series(2, 230, "b"), series(3, 1, "c")]


@pytest.mark.parametrize("block_rows", [None, 79, 100])
def test_features_match_the_definitions(spark, frames, block_rows):
    bars = spark.createDataFrame(pd.concat(frames), "symbol string, trade_date date, open double, high double, low double, close double, volume double")
    got = market.market_features(bars, {"train_end": "2020-06-30", "valid_end": "2020-09-30", "test_end": "2020-11-30"},
                                 block_rows=block_rows).toPandas()
    assert len(got) == sum(map(len, frames))
    for frame in frames:
        mine = got[got.symbol == frame.symbol[0]].sort_values("trade_date").reset_index(drop=True)
        want = by_hand(frame)
        for c in MARKET_FEATURES + ["next_ret_1", "next_oc_return"]:
            np.testing.assert_allclose(mine[c].astype(float), want[c].astype(float), rtol=1e-7, atol=1e-7, err_msg=c)
        assert np.isnan(mine["y_cls"].iloc[-1])
    assert set(got.split) == {"train", "valid", "test", "holdout"}


def test_one_series_without_a_key_in_blocks(spark, frames):
    bars = spark.createDataFrame(frames[0].drop(columns="symbol"), "trade_date date, open double, high double, low double, close double, volume double")
    got = market.market_features(bars, keys=(), block_rows=79).toPandas().sort_values("trade_date").reset_index(drop=True)
    want = by_hand(frames[0])
    np.testing.assert_allclose(got["rsi_14"], want["rsi_14"], rtol=1e-7)
    np.testing.assert_array_equal(got["vol_regime"], want["vol_regime"])
    np.testing.assert_array_equal(got["drawdown_state"], want["drawdown_state"])


def test_one_exchange_for_all_windows(spark, frames):
    bars = spark.createDataFrame(frames[1], "symbol string, trade_date date, open double, high double, low double, close double, volume double")
    plan = market.market_features(bars)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and plan.count("+- Sort ") == 1


def test_sequences_stay_inside_a_split(spark, frames):
    bars = spark.createDataFrame(frames[1].head(30), "symbol string, trade_date date, open double, high double, low double, close double, volume double")
    splits = {"train_end": "2020-01-20", "valid_end": "2020-02-04", "test_end": "2020-12-31"}
    f = market.market_features(bars, splits)
    rows = dataset.sequence_windows(f, {"x_num": ["open", "close", "ret_1"], "x_text": ["volume", "low"]}, 3).collect()
    first = min(str(r.trade_date) for r in rows if r.split == "valid")
    assert first == "2020-01-23"
    assert all(len(r.x_num) == 3 and len(r.x_num[0]) == 3 and len(r.x_text[0]) == 2 for r in rows)
    assert max(str(r.trade_date) for r in rows) < str(frames[1].head(30).trade_date.iloc[-1])


def test_feature_space():
    space = dataset.feature_space(["emb_001", "emb_000", "x"], "text", "cls_embedding")
    assert space["inputs"] == ["emb_000", "emb_001"]
    assert len(dataset.feature_space([], "num")["inputs"]) == 30
    assert len(dataset.feature_space([], "multimodal", without_regimes=False)["inputs"]) == 48
    with pytest.raises(ValueError):
        dataset.feature_space([], "sound")
