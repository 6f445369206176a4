"""Disk: what queries shuffle and store on the way."""

from datetime import datetime, timedelta
import re

import pytest

from queries import fixtures, market as market_queries, text as text_queries
from tapeloom.functions import scan


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Line items of three suppliers over 200 days, some days twice, some without a supplier or a price."""
    at = tmp_path_factory.mktemp("tables")
    rows = [(k, 1 + k % 7, None if k % 97 == 0 else k % 3, k % 4, float(1 + k % 9), None if k % 89 == 0 else 100.0 + k * 37 % 113,
             datetime(1999, 10, 1) + timedelta(days=k * 31 % 200)) for k in range(900)]
    schema = ("l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, "
              "l_shipdate timestamp_ntz")
    spark.createDataFrame(rows, schema).write.parquet(f"{at}/lineitem.parquet")
    return str(at)


def plan(df):
    return re.sub(r"#\d+L?", "", df._jdf.queryExecution().executedPlan().toString())


def test_bars_and_windows_share_an_exchange(spark, folder):
    """F7, F8, F4: ticks went through one exchange as wide states of aggregates, bars through another."""
    shown = plan(fixtures.features(spark, folder, ["symbol"]))
    assert len(re.findall(r"Exchange", shown)) == 1
    assert len(re.findall(r"\bSort \[", shown)) == 1
    assert len(re.findall(r"Exchange", plan(fixtures.predictions(spark, folder)))) == 1


def test_standardized_per_series_stores_and_sorts_no_wide_rows(spark, folder, monkeypatch):
    """the features were stored, not the bars, and sorted to meet one row of statistics per series."""
    stored, cut = [], text_queries.cut
    monkeypatch.setattr(text_queries, "cut", lambda df: stored.append(set(df.columns)) or cut(df))
    out = text_queries.standardize_per_series(spark, folder)
    assert stored == [{"symbol", "trade_date", "open", "high", "low", "close", "volume"}]
    assert "SortMergeJoin" not in plan(out) and "ShuffledHashJoin" in plan(out)
    f = fixtures.features(spark, folder).toPandas()
    got = out.orderBy("symbol", "trade_date").toPandas()
    assert len(got) == len(f) and got["symbol"].isna().sum() == f["symbol"].isna().sum() > 0
    for symbol, own in f.groupby("symbol"):
        train = own.loc[own["split"] == "train", "close"]
        wanted = (own.sort_values("trade_date")["close"] - train.mean()) / train.std(ddof=0)
        seen = got.loc[got["symbol"] == symbol, "close"]
        assert seen.to_numpy() == pytest.approx(wanted.to_numpy(), abs=2e-6, nan_ok=True)


def test_blocks_of_windows_store_only_what_they_read(spark, folder, monkeypatch):
    """F8: rows were dealt out and stored with all features to be numbered."""
    stored, cut = [], scan.cut

    def seen(df):
        stored.append(set(df.columns))
        return cut(df)

    monkeypatch.setattr(scan, "cut", seen)
    out = market_queries.sequence_windows_blocks(spark, folder)
    assert stored == [{"symbol", "trade_date", "split", "next_ret_1", "open", "close", "ret_1", "_range"}]
    whole = market_queries.sequence_windows(spark, folder)
    assert out.exceptAll(whole).isEmpty() and whole.exceptAll(out).isEmpty() and not out.isEmpty()
