"""Encoders, daily text features and the model table."""

from pyspark.sql import functions as F

from tapeloom.contracts import LABELS, MARKET_FEATURES, SENTIMENT_DAILY, TEXT_DAILY, TEXT_LENGTHS, TEXT_SENTIMENT
from tapeloom.functions import text as X
from tapeloom.functions.storage import cut
from tapeloom.operators import calendar as cal, cleaning, dataset, dedup, market, text_features as tf

from . import query
from .articles import _KEYED, THRESHOLD, WINDOW, cleaned
from .fixtures import (ALIGN, CALENDAR, CLEAN, ENCODED, FEATURES, NEWS, SPLITS, bars, calendar, encoded, features, news, r6, rounded, six,
                       table)

DIM = 16


def _sql_hits(text, words):
    return " + ".join(f"CASE WHEN contains(lower({text}), '{w}') THEN 1 ELSE 0 END" for w in words)


def _sql_sentiment(text):
    up, down = _sql_hits(text, X.POSITIVE_WORDS), _sql_hits(text, X.NEGATIVE_WORDS)
    parts = []
    for i, name in enumerate(("pos", "neg", "neu")):
        p = {k: v[i] for k, v in X.SENTIMENT_PROBABILITIES.items()}
        parts.append(f"CASE WHEN {up} > {down} THEN {p['pos']}::DOUBLE WHEN {down} > {up} THEN {p['neg']}::DOUBLE "
                     f"ELSE {p['tie']}::DOUBLE END AS {name}")
    return ", ".join(parts)


def _sql_byte(text, i):
    return f"CAST('0x' || substr(sha256({text}), ({i} % 32) * 2 + 1, 2) AS INTEGER) / 255.0::DOUBLE * 2 - 1"


@query("keyword_sentiment", f"SELECT doc_id, {_sql_sentiment('text')} FROM documents")
def keyword_sentiment(spark, d):
    docs = table(spark, d, "documents").withColumn("s", X.keyword_sentiment("text"))
    return docs.select("doc_id", "s.pos", "s.neg", "s.neu")


@query("hash_embedding", f"SELECT doc_id, i AS pos, {r6(_sql_byte('text', 'i'), 'value')} FROM documents, range(0, 40) AS r(i)")
def hash_embedding(spark, d):
    cells = table(spark, d, "documents").select("doc_id", F.posexplode(X.hash_embedding("text", 40)).alias("pos", "value"))
    return rounded(cells.withColumn("pos", F.col("pos").cast("long")))


@query("embedding_resize", """SELECT vec_id, dim, i AS pos, CASE WHEN i < 64 THEN CAST(embedding[i + 1] AS DOUBLE) ELSE 0 END AS value
       FROM embeddings, (VALUES (16), (80)) AS t(dim), range(0, 80) AS r(i) WHERE i < dim""")
def embedding_resize(spark, d):
    e = table(spark, d, "embeddings")
    out = [e.select("vec_id", F.lit(n).alias("dim"), F.posexplode(X.resize_vector("embedding", n)).alias("pos", "value"))
           for n in (16, 80)]
    return out[0].unionByName(out[1]).withColumn("pos", F.col("pos").cast("long"))


@query("softmax", f"""SELECT vec_id, i - 1 AS pos, {r6('exp(v[i] - list_max(v)) / list_sum(list_transform(v, lambda x: exp(x - list_max(v))))', 'p')}
       FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), range(1, 65) AS r(i)""")
def softmax(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.posexplode(X.softmax("embedding")).alias("pos", "p"))
    return rounded(e.withColumn("pos", F.col("pos").cast("long")))


@query("embedding_wide", "SELECT vec_id, " + ", ".join(
    f"CAST(embedding[{i + 1}] AS DOUBLE) AS {n}" for i, n in enumerate(X.embedding_names(64))) + " FROM embeddings")
def embedding_wide(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    return tf.widen_embeddings(e, 64)


_ENCODED_NEWS = f"""{NEWS}, {CALENDAR} {ALIGN.replace('{src}', 'news')},
encoded AS (SELECT *, {_sql_sentiment('content')} FROM aligned)"""


def encoded_news(spark, d):
    return tf.encode_news(cal.assign_trade_dates(news(spark, d), calendar(spark, d)), DIM, "content")


@query("encode_news", f"""WITH {_ENCODED_NEWS} SELECT news_id, trade_date, pos, neg, neu,
       {', '.join(r6(_sql_byte('content', i), n) for i, n in enumerate(X.embedding_names(DIM)))} FROM encoded""")
def encode_news(spark, d):
    df = tf.widen_embeddings(encoded_news(spark, d), DIM)
    return rounded(df.select("news_id", "trade_date", "pos", "neg", "neu", *X.embedding_names(DIM)))


# ---------------------------------------------------------------- daily features

def _sql_daily(source, lengths=("title_clean", "content_clean")):
    parts = ["count(news_id) AS news_count"]
    for c, name in zip(lengths, ("title_len", "content_len")):
        for agg in ("mean", "median", "min", "max"):
            f = {"mean": "avg"}.get(agg, agg)
            parts.append(f"CAST({f}(length({c})) AS DOUBLE) AS {name}_{agg}")
    daily = f"SELECT trade_date, {', '.join(parts)} FROM {source} GROUP BY 1"
    cols = ", ".join(r6(f"coalesce(g.{c}, 0)", c) for c in TEXT_LENGTHS)
    return f"""daily AS (SELECT c.trade_date, coalesce(g.news_count, 0) AS news_count,
      CASE WHEN g.news_count > 0 THEN 1 ELSE 0 END AS has_news, {cols}, 0.0::DOUBLE AS finbert_pos_mean,
      0.0::DOUBLE AS finbert_neg_mean, 1.0::DOUBLE AS finbert_neu_mean, 0.0::DOUBLE AS sentiment_score,
      0.0::DOUBLE AS sentiment_abs FROM calendar c LEFT JOIN ({daily}) g USING (trade_date))"""


_ALIGNED = f"{NEWS} {CLEAN}, {CALENDAR} {ALIGN.replace('{src}', 'cleaned')}"


def aligned(spark, d):
    return cal.assign_trade_dates(cleaned(spark, d), calendar(spark, d))


@query("daily_text_features", f"WITH {_ALIGNED}, {_sql_daily('aligned')} SELECT trade_date, {', '.join(TEXT_DAILY)} FROM daily")
def daily_text_features(spark, d):
    return rounded(tf.daily_text_features(aligned(spark, d), calendar(spark, d)))


def _sql_sent(source):
    return f"""sent AS (SELECT c.trade_date, coalesce(g.n, 0) AS news_count, CASE WHEN g.n > 0 THEN 1 ELSE 0 END AS has_news,
      coalesce(g.p, 0) AS finbert_pos_mean, coalesce(g.q, 0) AS finbert_neg_mean, coalesce(g.u, 1) AS finbert_neu_mean,
      coalesce(g.p - g.q, 0) AS sentiment_score, coalesce(abs(g.p - g.q), 0) AS sentiment_abs
    FROM calendar c LEFT JOIN (SELECT trade_date, count(news_id) AS n, avg(pos) AS p, avg(neg) AS q, avg(neu) AS u
                               FROM {source} GROUP BY 1) g USING (trade_date))"""


def _sent_columns(prefix=""):
    return ", ".join(f"{prefix}{c}" if c in ("news_count", "has_news") else r6(f"{prefix}{c}", c) for c in SENTIMENT_DAILY)


@query("daily_sentiment", f"WITH {_ENCODED_NEWS}, {_sql_sent('encoded')} SELECT trade_date, {_sent_columns()} FROM sent")
def daily_sentiment(spark, d):
    return rounded(tf.daily_sentiment(encoded_news(spark, d), calendar(spark, d)))


_ENC_ALIGNED = f"{ENCODED}, {CALENDAR} {ALIGN.replace('{src}', 'enc')}"
_MEANS = ", ".join(f"avg(CAST(embedding[{i + 1}] AS DOUBLE)) AS {n}" for i, n in enumerate(X.embedding_names(64)))
_DAILY_EMB = f"""{_ENC_ALIGNED},
emb AS (SELECT c.trade_date, {', '.join(f'coalesce(g.{n}, 0) AS {n}' for n in X.embedding_names(64))}
        FROM calendar c LEFT JOIN (SELECT trade_date, {_MEANS} FROM aligned GROUP BY 1) g USING (trade_date))"""


@query("daily_embeddings", f"""WITH {_DAILY_EMB} SELECT trade_date,
       {', '.join(r6(n, n) for n in X.embedding_names(64))} FROM emb""")
def daily_embeddings(spark, d):
    return rounded(tf.widen_embeddings(tf.daily_embeddings(encoded(spark, d), calendar(spark, d), 64), 64))


@query("placeholder_embeddings", f"WITH {CALENDAR} SELECT trade_date, {', '.join(f'0.0::DOUBLE AS {n}' for n in X.embedding_names(DIM))} FROM calendar")
def placeholder_embeddings(spark, d):
    return tf.widen_embeddings(tf.placeholder_embeddings(calendar(spark, d), DIM), DIM)


# ---------------------------------------------------------------- model table

_REFRESHED = f"""{_ALIGNED}, {_sql_daily('aligned')}, encoded AS (SELECT *, {_sql_sentiment('content_clean')} FROM aligned),
{_sql_sent('encoded')},
fresh AS (SELECT d.trade_date, {', '.join(f'd.{c}' for c in TEXT_LENGTHS)}, {_sent_columns('s.')}
          FROM daily d JOIN sent s USING (trade_date))"""


def refreshed(spark, d):
    days = calendar(spark, d)
    a = aligned(spark, d)
    return tf.refresh_sentiment(tf.daily_text_features(a, days), tf.daily_sentiment(tf.encode_news(a, DIM), days))


@query("refresh_sentiment", f"WITH {_REFRESHED} SELECT trade_date, {', '.join(TEXT_DAILY)} FROM fresh")
def refresh_sentiment(spark, d):
    return rounded(refreshed(spark, d).select("trade_date", *TEXT_DAILY))


_INTS = ("trend_regime", "vol_regime", "drawdown_state")
_MARKET = ", ".join([c if c in _INTS else r6(f"coalesce({c}, 0)", c) for c in MARKET_FEATURES]
                    + [c if c == "split" else r6(c, c) for c in LABELS])


@query("main_table", f"""WITH {_REFRESHED.replace(CALENDAR + ' ', CALENDAR + ' ')}, {FEATURES}
       SELECT symbol, f3.trade_date, {_MARKET}, {', '.join(TEXT_DAILY)} FROM f3 LEFT JOIN fresh USING (trade_date)""")
def main_table(spark, d):
    main = dataset.main_table(features(spark, d), refreshed(spark, d))
    return rounded(main.select("symbol", "trade_date", *MARKET_FEATURES, *LABELS, *TEXT_DAILY))


_WIDE = X.embedding_names(64)


@query("merge_embeddings", f"""WITH {_DAILY_EMB}, {FEATURES}
       SELECT symbol, f3.trade_date, {r6('close', 'close')}, {', '.join(r6(f'coalesce({n}, 0)', n) for n in _WIDE)}
       FROM f3 LEFT JOIN emb USING (trade_date)""")
def merge_embeddings(spark, d):
    """Days outside the calendar of the vectors take the fill value."""
    daily = tf.daily_embeddings(encoded(spark, d), calendar(spark, d), 64)
    wide = tf.widen_embeddings(daily, 64)
    out = dataset.merge_embeddings(features(spark, d).select("symbol", "trade_date", "close"), wide)
    return rounded(out.select("symbol", "trade_date", "close", *_WIDE))


_STD = dataset.feature_space([], "num")["numeric"]


@query("fit_standardizer", f"""WITH {FEATURES} SELECT {', '.join(
       r6(f'avg(coalesce({c}, 0))', f'{c}_mean') + ', ' + r6(f'stddev_pop(coalesce({c}, 0))', f'{c}_std') for c in _STD)}
       FROM f3 WHERE split = 'train'""")
def fit_standardizer(spark, d):
    return rounded(dataset.fit_standardizer(features(spark, d), _STD))


@query("standardize", f"""WITH {FEATURES}, st AS (SELECT {', '.join(
       f'avg(coalesce({c}, 0)) AS {c}_m, stddev_pop(coalesce({c}, 0)) AS {c}_s' for c in _STD)} FROM f3 WHERE split = 'train')
       SELECT symbol, trade_date, {', '.join(r6(f'(coalesce({c}, 0) - {c}_m) / {c}_s', c) for c in _STD)} FROM f3, st""")
def standardize(spark, d):
    f = cut(features(spark, d).select("symbol", "trade_date", "split", *_STD))  # read for the statistics and for the rows
    out = dataset.standardize(f, _STD, dataset.fit_standardizer(f, _STD))
    return rounded(out.select("symbol", "trade_date", *_STD))


@query("standardize_per_series", f"""WITH {FEATURES}, st AS (SELECT symbol, {', '.join(
       f'avg(coalesce({c}, 0)) AS {c}_m, CASE WHEN stddev_pop(coalesce({c}, 0)) > 0 THEN stddev_pop(coalesce({c}, 0)) ELSE 1 END AS {c}_s' for c in _STD)}
       FROM f3 WHERE split = 'train' GROUP BY 1)
       SELECT symbol, trade_date, {', '.join(r6(f'(coalesce({c}, 0) - {c}_m) / {c}_s', c) for c in _STD)}
       FROM f3 LEFT JOIN st USING (symbol)""")
def standardize_per_series(spark, d):
    days = cut(bars(spark, d, ["symbol", "trade_date"]))  # the features of a day are seven times as wide: worked out twice from one exchange, not stored
    f = market.market_features(days, SPLITS).select("symbol", "trade_date", "split", *_STD)
    out = dataset.standardize(f, _STD, dataset.fit_standardizer(f, _STD, ["symbol"]), ["symbol"])
    return rounded(out.select("symbol", "trade_date", *_STD))


@query("tabular_dataset", f"""WITH {FEATURES} SELECT symbol, trade_date, split, {r6('next_ret_1', 'next_ret_1')}
       FROM f3 WHERE next_ret_1 IS NOT NULL""")
def tabular_dataset(spark, d):
    f = features(spark, d)
    space = dataset.feature_space(f.columns, "num")
    return rounded(dataset.tabular_rows(f, space["inputs"]).select("symbol", "trade_date", "split", "next_ret_1"))
