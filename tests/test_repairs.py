"""Cases that earlier versions lost or bent: NULL keys in blocks, long pointer chains, offsets, NaN."""

from datetime import date, datetime, timedelta

from pyspark.sql import functions as F

from tapeloom.functions import text as X
from tapeloom.operators import backtest, calendar as cal, dedup, evaluate, market
from tapeloom.sources import articles as art, tables as tb


def bars(spark, n=300):
    rows = []
    for i in range(n):
        day = None if i % 50 == 7 else date(2020, 1, 1) + timedelta(days=i)
        key = None if i % 60 == 9 else "a"
        rows.append((key, day, i, 10.0 + i % 7, 11.0 + i % 7, 9.0 + i % 7, 10.0 + (i * 37 % 11), 100.0 + i))
    return spark.createDataFrame(rows, "symbol string, trade_date date, i int, open double, high double, low double, close double, volume double")


def test_blocks_keep_rows_without_key_or_date(spark):
    plain = market.market_features(bars(spark))
    blocks = market.market_features(bars(spark), block_rows=79)
    assert blocks.count() == plain.count() == 300
    dated = [m.where("trade_date is not null and symbol is not null").select("i", "ret_1", "ma_20", "rsi_14", "drawdown_state")
             for m in (plain, blocks)]
    assert {r.i for r in dated[0].collect()} == {r.i for r in dated[1].collect()}


def test_roots_of_long_chains_and_rings(spark):
    rows = [(f"n{i:02d}", f"n{max(i - 1, 0):02d}") for i in range(40)] + [("r1", "r2"), ("r2", "r1"), ("s", "s")]
    out = {r.news_id: r.root_news_id for r in dedup.with_root(spark.createDataFrame(rows, "news_id string, canonical_news_id string")).collect()}
    assert {out[f"n{i:02d}"] for i in range(40)} == {"n00"} and out["s"] == "s" and out["r1"] in ("r1", "r2")


def test_offsets_become_market_time(spark):
    texts = ["2024-01-05T07:30:00Z", "2024-01-05 15:30:00+08:00", "2024-01-05T15:30:00", "2024-01-05T09:00:00+0100", "2024-01-05", "x", None]
    df = spark.createDataFrame([(i, t, "t", "c", "id") for i, t in enumerate(texts)], "k int, publish_time string, title string, content string, news_id string")
    out = {r.k: r.publish_time for r in art.normalize_articles(df).collect()}
    late = datetime(2024, 1, 5, 15, 30)
    assert [out[i] for i in range(7)] == [late, late, late, datetime(2024, 1, 5, 16), datetime(2024, 1, 5), None, None]
    days = spark.createDataFrame([(date(2024, 1, 5),), (date(2024, 1, 8),)], "trade_date date")
    dated = cal.assign_trade_dates(art.normalize_articles(df).where("k = 0"), days)
    assert dated.columns.count("trade_date") == 1 and dated.first().trade_date == date(2024, 1, 8)


def test_nan_is_missing(spark):
    nan = float("nan")
    rows = [("test", date(2024, 1, i + 1), nan, 0.5 if i % 2 else -0.5, 0.01 * i, float(i % 2), nan if i == 3 else 0.1 * i) for i in range(8)]
    p = spark.createDataFrame(rows, "split string, trade_date date, pred_cls_score double, pred_reg double, next_oc_return double, y_cls double, next_ret_1 double")
    signals = [r.signal for r in backtest.strategy_frame(p).orderBy("trade_date").collect()]
    assert signals == [0, 1] * 4
    row = evaluate.evaluate_predictions(p).first()
    assert row.accuracy is None and row.auc is None and row.mse is not None and row.mse == row.mse
    b = bars(spark, 60).where("trade_date is not null and symbol is not null").withColumn("close", F.when(F.col("i") == 30, nan).otherwise(F.col("close")))
    at = {r.i: r for r in market.market_features(b, fill_value=None).collect()}
    assert at[30].trend_regime == 0 and at[30].y_cls is None and at[29].y_cls is None


def test_csv_types_follow_the_contract(spark, tmp_path):
    path = str(tmp_path / "news.csv")
    (tmp_path / "news.csv").write_text('news_id,publish_time,title,content\n0012,2024-01-02 10:00:00,t,"two\nlines"\n')
    row = art.load_news(spark, path).first()
    assert row.news_id == "0012" and row.content == "two\nlines"
    (tmp_path / "m.csv").write_text("symbol,trade_date,open,high,low,close,volume\n01,2024-01-02,1,2,1,2,5\n")
    bar = tb.load_market(spark, str(tmp_path / "m.csv")).first()
    assert bar.symbol == "01" and bar.trade_date == date(2024, 1, 2) and bar.close == 2.0


def test_softmax_and_hash_embedding(spark):
    row = spark.createDataFrame([([1.0, 2.0, 3.0], "text")], "v array<double>, t string").select(
        X.softmax("v").alias("s"), X.hash_embedding("t", 40).alias("e")).first()
    assert abs(sum(row.s) - 1) < 1e-12 and row.s == sorted(row.s)
    assert len(row.e) == 40 and row.e[:8] == row.e[32:]
