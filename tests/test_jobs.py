"""All jobs end to end on small tables."""

from datetime import date, datetime, timedelta

import pytest

from tapeloom.plans import jobs
from tapeloom.sources import tables as tb

SPLITS = {"train_end": "2011-05-31", "valid_end": "2011-06-30", "test_end": "2011-07-31"}
DAYS = [d for d in (date(2011, 3, 1) + timedelta(n) for n in range(160)) if d.weekday() < 5][:100]


def wave(n):
    """A price that climbs and falls by turns, in quarters."""
    return 40 + 0.25 * ((n * n * 7 + 3 * n) % 37) + 0.5 * (n // 9)


@pytest.fixture(scope="module")
def paths(spark, tmp_path_factory):
    paths = jobs.Paths(str(tmp_path_factory.mktemp("job")))
    bars = [("ore", day, wave(n), wave(n) + 1.5, wave(n) - 2.0, wave(n + 1), 500.0 * (3 + n % 11)) for n, day in enumerate(DAYS)]
    tb.write_table(spark.createDataFrame(bars, "symbol string, trade_date date, open double, high double, low double, close double, volume double"), paths.market)
    news = []
    for n, day in enumerate(DAYS[:96]):  # one before the close on three days of four, one after it on every fourth
        late = n % 4 == 3
        words = ("losses at pit number", "a probe and heavy losses") if late else ("strong growth at pit number", "orders rise, profit too")
        news.append((f"wire-{n}", f"https://wire.test/{n}", f"{words[0]} {n * 31}", words[1],
                     datetime(day.year, day.month, day.day, 19 if late else 9, 12)))
    tb.write_table(spark.createDataFrame(news, "news_id string, url string, title string, content string, publish_time timestamp"), paths.news)
    return paths


def test_market_to_summary(spark, paths):
    prepared = jobs.prepare_market(spark, paths, SPLITS)
    assert prepared.count() == 100 and jobs.prepare_market(spark, paths, SPLITS, long_series=10, block_rows=79).count() == 100
    aligned = jobs.prepare_news(spark, paths, dim=8)
    assert aligned.where("trade_date is null").count() == 0 and aligned.count() > 0
    assert tb.read_table(spark, paths.deduped_news).count() == 96
    assert jobs.build_dataset(spark, paths, dim=8).where("finbert_pos_mean > 0").count() == 0
    encoded = jobs.encode_text(spark, paths, dim=8)
    assert "embedding" in encoded.columns
    main = jobs.build_dataset(spark, paths, dim=8)
    assert main.count() == 100 and main.where("finbert_pos_mean > 0").count() > 40
    predictions = jobs.train(spark, paths, task="multitask", text="cls_embedding", dim=8, maxIter=1, maxDepth=2)
    assert {r.split for r in predictions.select("split").distinct().collect()} == {"train", "valid", "test"}
    assert predictions.where("pred_cls_score < 0 or pred_cls_score > 1").count() == 0
    tables = jobs.evaluate_run(spark, paths)
    assert tables["split_metrics"].count() == 3 and tables["strategy_metrics"].where("split = 'test'").count() == 1
    summary = jobs.run_suite(spark, paths, {"task": ["cls", "reg"], "modality": ["num"]}, {"maxIter": 1, "maxDepth": 2}, name="s")
    rows = {r.run_name: r for r in summary.collect()}
    assert set(rows) == {"s_01", "s_02"} and rows["s_01"].test_reg_mse is None and rows["s_02"].test_cls_accuracy is None
    assert rows["s_02"].task == "reg" and rows["s_01"].test_strategy_sharpe is not None


def test_no_news_gives_empty_tables(spark, tmp_path, paths):
    empty = jobs.Paths(str(tmp_path), {"market": paths.market})
    jobs.prepare_market(spark, empty, SPLITS)
    assert jobs.prepare_news(spark, empty, dim=4).count() == 0
    assert jobs.build_dataset(spark, empty, dim=4).where("finbert_neu_mean = 1").count() == 100


def test_constant_labels_need_no_model(spark):
    from tapeloom.operators import model

    df = spark.createDataFrame([(1.0, 1.0, 0.5), (2.0, 1.0, 0.5)], "f double, y_cls double, next_ret_1 double")
    out = model.predict(df, model.fit_tabular(df, ["f"], "multitask"), ["f"]).first()
    assert (out.pred_cls_score, out.pred_cls_label, out.pred_reg) == (1.0, 1, 0.5)
    with pytest.raises(ValueError):
        model.fit_tabular(df, ["f"], "rank")


def test_suite_merges_embeddings(spark, tmp_path, monkeypatch):
    from tapeloom.operators import dataset, model

    own = jobs.Paths(str(tmp_path))
    tb.write_table(spark.createDataFrame([("2022-10-03", 1.0), ("2022-10-04", 2.0)], "trade_date string, close double"), own.main_table)
    tb.write_table(spark.createDataFrame([("2022-10-03", [0.5, 0.25])], "trade_date string, embedding array<double>"), own.daily_embeddings)
    seen = []

    class Table:
        def __init__(self, rows, text="sentiment", modality="multimodal", carry=()):
            names = dataset.feature_space(rows.columns, modality, text)["inputs"]
            seen.append([c for c in names if c.startswith("emb_")])
            self.rows = rows

        def train(self):
            return self.rows, {"cls": 1.0}

        def predictions(self, models):
            return self.rows.select("trade_date")

    monkeypatch.setattr(model, "training_table", Table)
    monkeypatch.setattr(jobs, "evaluate_run", lambda *a, **b: {"split_metrics": None, "strategy_metrics": None})
    monkeypatch.setattr(jobs, "suite_summary", lambda m, s, options, keys: options)
    jobs.run_suite(spark, own, {"text": ["sentiment", "cls_embedding"], "modality": ["multimodal", "text"]}, dim=2)
    assert seen == [[], [], ["emb_000", "emb_001"], ["emb_000", "emb_001"]]
    missing = jobs.Paths(str(tmp_path), {"daily_embeddings": f"{tmp_path}/none.parquet"})
    with pytest.raises(ValueError, match="emb_"):
        jobs.run_suite(spark, missing, {"text": ["cls_embedding"]})
