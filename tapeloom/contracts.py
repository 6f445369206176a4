"""Column groups and table schemas."""

from pyspark.sql import types as T

# Column names and split dates of the data contract.
RAW_MARKET = ["trade_date", "open", "high", "low", "close", "volume"]
RAW_NEWS = ["publish_time", "title", "content"]
BASE_INPUTS = ["open", "high", "low", "close", "volume"]
RETURNS = ["ret_1", "ret_2", "ret_3", "ret_5", "ret_10", "ret_20"]
VOLATILITY = ["volatility_5", "volatility_10", "volatility_20"]
PRICE_SHAPE = ["hl_range", "oc_return", "gap_return"]
MOVING_AVERAGES = ["ma_5", "ma_10", "ma_20", "ma_gap_5", "ma_gap_10", "ma_gap_20"]
MOMENTUM = ["rsi_14", "momentum_5", "momentum_10"]
VOLUME = ["volume_change_1", "volume_change_5", "price_volume_corr_5", "price_volume_corr_10"]
REGIMES = ["trend_regime", "vol_regime", "drawdown_state"]
TEXT_COUNTS = ["news_count", "has_news"]
TEXT_LENGTHS = [
    "title_len_mean", "title_len_median", "title_len_min", "title_len_max",
    "content_len_mean", "content_len_median", "content_len_min", "content_len_max",
]
TEXT_SENTIMENT = ["finbert_pos_mean", "finbert_neg_mean", "finbert_neu_mean", "sentiment_score", "sentiment_abs"]
LABELS = ["next_ret_1", "next_oc_return", "y_cls", "split"]
DEFAULT_SPLITS = {"train_end": "2022-12-31", "valid_end": "2023-12-31", "test_end": "2024-12-31"}

MARKET_FEATURES = RETURNS + VOLATILITY + PRICE_SHAPE + MOVING_AVERAGES + MOMENTUM + VOLUME + REGIMES
SENTIMENT_DAILY = TEXT_COUNTS + TEXT_SENTIMENT
TEXT_DAILY = TEXT_COUNTS + TEXT_LENGTHS + TEXT_SENTIMENT
PREDICTION_META = ["trade_date", "split", "y_cls", "next_ret_1", "next_oc_return"] + REGIMES

SERIES = ("symbol",)

_s, _d, _ts = T.StringType(), T.DoubleType(), T.TimestampNTZType()


def _schema(*fields):
    return T.StructType([T.StructField(name, kind) for name, kind in fields])


MARKET_SCHEMA = _schema(("trade_date", T.DateType()), ("open", _d), ("high", _d), ("low", _d), ("close", _d),
                        ("volume", _d))
RAW_NEWS_SCHEMA = _schema(("publish_time", _ts), ("title", _s), ("content", _s))
ARTICLE_SCHEMA = _schema(
    ("news_id", _s), ("source", _s), ("url", _s), ("title", _s), ("publish_time", _ts), ("content", _s),
    ("crawl_time", _ts), ("channel", _s), ("raw_title", _s), ("raw_content", _s), ("title_clean", _s),
    ("content_clean", _s), ("title_hash", _s), ("content_hash", _s), ("is_duplicate", T.BooleanType()),
    ("duplicate_reason", _s), ("canonical_news_id", _s), ("trade_date", T.DateType()),
)
ARTICLE_COLUMNS = ARTICLE_SCHEMA.fieldNames()


def require_columns(df, required, table):
    """Raise with the sorted missing names when a table lacks contract columns."""
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"table {table!r} lacks required columns {missing}")
