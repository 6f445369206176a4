"""Composite jobs: read tables, run operators, write tables. Paths are arguments; ``keys`` name a series."""

from dataclasses import dataclass, field
import logging

from pyspark.sql import functions as F

from ..contracts import ARTICLE_SCHEMA, DEFAULT_SPLITS, REGIMES, SERIES
from ..functions.storage import cut
from ..operators import backtest, calendar as cal, cleaning, dataset, dedup, evaluate, market, model, text_features as tf
from ..sources import articles as art, pages as pg, tables as tb

LOG = logging.getLogger(__name__)


@dataclass
class Paths:
    """Table locations under one root; each can be replaced."""

    root: str
    other: dict = field(default_factory=dict)

    def __getattr__(self, name):
        if name.startswith("_"):
            raise AttributeError(name)
        return self.other.get(name, f"{self.root}/{name}.parquet")


def extract_news(spark, paths, sources, starts, crawl_time=None, adapters=None, zone="Asia/Shanghai"):
    """Pages table to the raw article table: registry filter, links, pages, records, first record per id.

    What is left out has its own tables: ``unknown_sources`` (no reader for the adapter), ``missing_pages`` (links without a
    stored page), ``rejected_pages`` (parse errors and invalid records) and ``surplus_pages`` (ids with more records).
    """
    pages = tb.read_table(spark, paths.pages)
    active = pg.enabled_sources(sources, adapters)
    links = pg.listing_links(pages, active, starts.join(active.select("source"), "source", "left_semi"))
    links = cut(links)
    tb.write_table(pg.unknown_adapters(sources, adapters), paths.unknown_sources)
    tb.write_table(pg.missing_details(links, pages), paths.missing_pages)
    parsed = cut(pg.parse_articles(pg.fetch_details(links, pages), active, crawl_time, adapters, zone))
    tb.write_table(parsed.where("parse_error is not null or reject_reason is not null"), paths.rejected_pages)
    found = parsed.where("parse_error is null and reject_reason is null").drop("parse_error", "reject_reason")
    tb.write_table(art.surplus_ids(found), paths.surplus_pages)
    tb.write_table(art.first_per_id(found).select(*ARTICLE_SCHEMA.fieldNames()), paths.raw_news)
    return tb.read_table(spark, paths.raw_news)


def prepare_market(spark, paths, split_dates=None, keys=SERIES, fill_value=0.0, long_series=1_000_000,
                   block_rows=250_000):
    """Raw market table to market features. Series longer than ``long_series`` rows make it work in blocks."""
    bars = tb.load_market(spark, paths.market)
    longest = bars.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    blocks = block_rows if longest > long_series else None
    made = market.market_features(bars, split_dates or DEFAULT_SPLITS, keys, fill_value=fill_value, block_rows=blocks)
    tb.write_table(made, paths.prepared_market)
    return tb.read_table(spark, paths.prepared_market)


def _news_input(spark, paths, zone):
    """Valid records; the invalid ones go to the table ``rejected_news``, ids with several records to ``surplus_news``."""
    for name in ("raw_news", "news"):
        path = getattr(paths, name)
        if tb.path_exists(spark, path):
            records = cut(art.normalize_articles(tb.read_table(spark, path, multi_line=True), zone))
            tb.write_table(art.rejected_articles(records), paths.rejected_news)
            valid = art.valid_articles(records)
            tb.write_table(art.surplus_ids(valid), paths.surplus_news)
            return valid
    LOG.warning("no news table at %s or %s; going on with an empty one", paths.raw_news, paths.news)
    return spark.createDataFrame([], ARTICLE_SCHEMA)


def prepare_news(spark, paths, zone="Asia/Shanghai", close="15:00", threshold=0.95, window_hours=24,
                 title_fallback=True, dim=16):
    """Raw articles to clean, deduplicated and aligned articles and daily features: five tables."""
    prepared = paths.prepared_market
    bars = (tb.read_table(spark, prepared) if tb.path_exists(spark, prepared) else tb.load_market(spark, paths.market))
    days = cut(cal.trade_calendar(bars))
    news = art.first_per_id(_news_input(spark, paths, zone))
    tb.write_table(cleaning.clean_news(news, title_fallback), paths.cleaned_news)
    cleaned = tb.read_table(spark, paths.cleaned_news)
    tb.write_table(dedup.dedup_news(cleaned, threshold, window_hours), paths.deduped_news)
    flagged = tb.read_table(spark, paths.deduped_news)
    unique = dedup.unique_articles(flagged).drop("trade_date")
    tb.write_table(cal.assign_trade_dates(unique, days, zone, close), paths.aligned_news)
    aligned = tb.read_table(spark, paths.aligned_news)
    tb.write_table(tf.daily_text_features(aligned, days), paths.daily_text_features)
    tb.write_table(tf.placeholder_embeddings(days, dim), paths.daily_embeddings)
    return aligned


def encode_text(spark, paths, dim=16, text="content_clean", encoder=None, make_encoder=None):
    """Aligned articles to encoded articles."""
    aligned = tb.read_table(spark, paths.aligned_news)
    tb.write_table(tf.encode_news(aligned, dim, text, encoder, make_encoder), paths.encoded_news)
    return tb.read_table(spark, paths.encoded_news)


def build_dataset(spark, paths, dim=16):
    """Market features and daily text features to the model table, with the sentiment of encoded news if there is any."""
    bars = tb.read_table(spark, paths.prepared_market)
    days = cut(cal.trade_calendar(bars))
    if tb.path_exists(spark, paths.daily_text_features):
        daily = tb.read_table(spark, paths.daily_text_features)
    else:
        empty = spark.createDataFrame([], ARTICLE_SCHEMA)
        daily = tf.daily_text_features(empty, days)
    if tb.path_exists(spark, paths.encoded_news):
        encoded = tb.read_table(spark, paths.encoded_news)
        daily = tf.refresh_sentiment(daily, tf.daily_sentiment(encoded, days))
        vectors = tf.daily_embeddings(encoded, days, dim)
    elif tb.path_exists(spark, paths.daily_embeddings):
        vectors = tb.read_table(spark, paths.daily_embeddings)
    else:
        vectors = tf.placeholder_embeddings(days, dim)
    # Both tables may replace the ones just read.
    daily, vectors = cut(daily), cut(vectors)
    tb.write_table(daily, paths.daily_text_features)
    tb.write_table(vectors, paths.daily_embeddings)
    tb.write_table(dataset.main_table(bars, daily), paths.main_table)
    return tb.read_table(spark, paths.main_table)


def _training_table(spark, paths, text, dim):
    """The model table, with the daily embeddings as ``emb_*`` columns if ``text`` asks for them and they are stored."""
    main = tb.read_table(spark, paths.main_table)
    if text != "cls_embedding" or not tb.path_exists(spark, paths.daily_embeddings):
        return main
    return dataset.merge_embeddings(main, tf.widen_embeddings(tb.read_table(spark, paths.daily_embeddings), dim))


def train(spark, paths, text="sentiment", dim=16, keys=SERIES, **options):
    """Model table to predictions of the train, valid and test rows; fitted models are saved next to them."""
    main = _training_table(spark, paths, text, dim)
    predictions, models = model.train_tabular(main, text=text, carry=keys, **options)
    tb.write_table(predictions, paths.predictions)
    for kind, fitted in models.items():
        if not isinstance(fitted, model.Constant):
            fitted.write().overwrite().save(f"{paths.models}/{kind}")
    return tb.read_table(spark, paths.predictions)


def evaluate_run(spark, paths, threshold=0.5, annualization=252, cost=0.0, keys=SERIES, run=(), long_series=1_000_000):
    """Predictions to four tables: metrics per split, metrics per regime, backtest rows and backtest metrics.

    Backtests with a series longer than ``long_series`` rows are scanned range by range."""
    predictions = tb.read_table(spark, paths.predictions)
    tb.write_table(evaluate.evaluate_predictions(predictions, [*run, "split"], threshold), paths.split_metrics)
    tb.write_table(evaluate.evaluate_groups(predictions, REGIMES, [*run, "split"], threshold), paths.group_metrics)
    series = [*run, "split", *keys]
    longest = predictions.groupBy(*series).count().agg(F.max("count")).first()[0] or 0
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions")) if longest > long_series else None
    tb.write_table(backtest.strategy_frame(predictions, threshold, cost, series, ranges=ranges), paths.strategy, ["split"])
    frame = tb.read_table(spark, paths.strategy)
    tb.write_table(backtest.strategy_metrics(frame, annualization, series, ranges=ranges), paths.strategy_metrics)
    return {name: tb.read_table(spark, getattr(paths, name))
            for name in ("split_metrics", "group_metrics", "strategy", "strategy_metrics")}


def suite_summary(split_metrics, strategy_metrics, grid, keys=SERIES, split="test"):
    """One row per run (and series): the grid options, then test metrics prefixed ``test_cls_``, ``test_reg_`` and
    ``test_strategy_``."""
    cls = [F.col(c).alias(f"test_cls_{c}") for c in evaluate.CLS_METRICS]
    reg = [F.col(c).alias(f"test_reg_{c}") for c in evaluate.REG_METRICS]
    measured = split_metrics.where(F.col("split") == split).select("run_name", *cls, *reg)
    traded = strategy_metrics.where(F.col("split") == split).select(
        "run_name", *keys, *[F.col(c).alias(f"test_strategy_{c}") for c in backtest.STRATEGY_METRICS])
    return grid.join(measured, "run_name", "left").join(traded, "run_name", "left")


def run_suite(spark, paths, axes, base=None, name="suite", keys=SERIES, threshold=0.5, annualization=252, cost=0.0, dim=16):
    """Train and evaluate every combination of ``axes``; all runs share one predictions table and one metric pass.

    Each run reads the model table of its text representation; ``dim`` is the width of the daily embeddings.
    """
    predictions, grid = model.train_suite(lambda text: _training_table(spark, paths, text, dim), axes, base, name, carry=keys)
    tb.write_table(predictions, paths.predictions)
    tables = evaluate_run(spark, paths, threshold, annualization, cost, keys, run=["run_name"])
    options = spark.createDataFrame([tuple(str(v) for v in g.values()) for g in grid], list(grid[0]))
    tb.write_table(suite_summary(tables["split_metrics"], tables["strategy_metrics"], options, keys), paths.suite_summary)
    return tb.read_table(spark, paths.suite_summary)
