"""Price bars, articles, encoded vectors and predictions derived from the test tables, in Spark and in DuckDB SQL."""

from pyspark.sql import functions as F

from tapeloom.functions.numeric import ratio
from tapeloom.operators import calendar as cal, market

SPLITS = {"train_end": "1999-12-31", "valid_end": "2000-12-31", "test_end": "2001-06-30"}
RUNS = (("momentum", 1.0), ("reversal", -1.0), ("flat", 0.0))


def table(spark, sf_dir, name):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def six(c):
    """A double at six places, halves up; the same arithmetic as ``r6`` in SQL."""
    return F.floor(c * 1000000 + 0.5) / 1000000.0


def rounded(df):
    """Every double column at six places."""
    return df.select(*[six(F.col(c)).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


def r6(expr, name):
    return f"floor(({expr}) * 1000000 + 0.5) / 1000000.0::DOUBLE AS {name}"


def sql_div(a, b):
    return f"(({a}) / nullif({b}, 0))"


def bars(spark, sf_dir, by=()):
    """One row per supplier and weekday: first, highest, lowest and last unit price, and quantity.

    With ``by`` ticks are dealt out by those columns before they are counted: hardly any share a day, and the states of the
    aggregates are three times as wide as a tick. The number of tasks is fixed then, so that none sorts several shares.
    """
    li = table(spark, sf_dir, "lineitem")
    order = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    ticks = li.where(~F.dayofweek("l_shipdate").isin(1, 7)).select(
        F.col("l_suppkey").alias("symbol"), F.to_date("l_shipdate").alias("trade_date"),
        "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity")
    if by:
        ticks = ticks.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *by)
    ticks = ticks.withColumns({"px": ratio("l_extendedprice", "l_quantity"), "ord": order})
    return ticks.groupBy("symbol", "trade_date").agg(
        F.min_by("px", "ord").alias("open"), F.max("px").alias("high"), F.min("px").alias("low"),
        F.max_by("px", "ord").alias("close"), F.sum("l_quantity").alias("volume"))


BARS = """
bars AS (
  SELECT l_suppkey AS symbol, CAST(l_shipdate AS DATE) AS trade_date, arg_min(px, ord) AS open, max(px) AS high,
         min(px) AS low, arg_max(px, ord) AS close, sum(l_quantity) AS volume
  FROM (SELECT *, l_extendedprice / l_quantity AS px,
               row(l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS ord
        FROM lineitem WHERE dayofweek(l_shipdate) NOT IN (0, 6))
  GROUP BY 1, 2)"""

CALENDAR = """
calendar AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS trade_date FROM lineitem
             WHERE dayofweek(l_shipdate) NOT IN (0, 6))"""


def calendar(spark, sf_dir):
    """Trading days: the dates of the bars."""
    li = table(spark, sf_dir, "lineitem").where(~F.dayofweek("l_shipdate").isin(1, 7))
    return cal.trade_calendar(li, "l_shipdate")


def news(spark, sf_dir):
    """One article per document, 37 minutes apart; every tenth shares the URL of the one before."""
    docs = table(spark, sf_dir, "documents")
    page = F.when(F.col("doc_id") % 10 == 9, F.col("doc_id") - 1).otherwise(F.col("doc_id"))
    minutes = F.make_dt_interval(F.lit(0), F.lit(0), (F.col("doc_id") * 37).cast("int"), F.lit(0))
    return docs.select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("news_id"), "source",
        F.concat(F.lit("https://News.Example.com/"), page.cast("string"), F.lit("/?ref="),
                 F.col("doc_id").cast("string")).alias("url"),
        F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"),
        (F.lit("1998-01-05 00:00:00").cast("timestamp_ntz") + minutes).alias("publish_time"),
        F.col("text").alias("content"), F.col("lang").alias("channel"))


NEWS = """
news AS (
  SELECT 'd' || doc_id AS news_id, source,
         'https://News.Example.com/' || (CASE WHEN doc_id % 10 = 9 THEN doc_id - 1 ELSE doc_id END) || '/?ref=' || doc_id AS url,
         split_part(text, chr(10), 1) AS title,
         TIMESTAMP '1998-01-05 00:00:00' + to_minutes(doc_id * 37) AS publish_time, text AS content, lang AS channel
  FROM documents)"""

# The documents hold no markup and no entities, so cleaning is white space only.
SPACES = r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
ZERO_WIDTH = r"[\x{200b}\x{200c}\x{200d}\x{feff}]+"


def sql_clean(c):
    return f"trim(regexp_replace(regexp_replace({c}, '{ZERO_WIDTH}', '', 'g'), '{SPACES}', ' ', 'g'))"


CLEAN = f""",
cleaned AS (
  SELECT *, sha1(title_clean) AS title_hash, sha1(content_clean) AS content_hash
  FROM (SELECT * REPLACE (CASE WHEN content_clean = '' THEN title_clean ELSE content_clean END AS content_clean)
        FROM (SELECT *, {sql_clean('title')} AS title_clean, {sql_clean('content')} AS content_clean FROM news)))"""

ALIGN = """,
aligned AS (
  SELECT n.*, c.trade_date, CAST(n.publish_time AS DATE) AS publish_date
  FROM (SELECT *, CAST(publish_time AS DATE)
               + CASE WHEN CAST(publish_time AS TIME) >= TIME '15:00:00' THEN 1 ELSE 0 END AS eff FROM {src}) n
  ASOF JOIN calendar c ON n.eff <= c.trade_date)"""


def encoded(spark, sf_dir):
    """Stand-in for encoder output: one vector per 97 minutes with a class label, aligned to trading days."""
    e = table(spark, sf_dir, "embeddings")
    minutes = F.make_dt_interval(F.lit(0), F.lit(0), (F.col("vec_id") * 97).cast("int"), F.lit(0))
    timed = e.select(F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("news_id"),
                     (F.lit("1998-01-05 00:00:00").cast("timestamp_ntz") + minutes).alias("publish_time"),
                     "embedding", "label")
    return cal.assign_trade_dates(timed, calendar(spark, sf_dir))


ENCODED = """
enc AS (SELECT 'v' || vec_id AS news_id, TIMESTAMP '1998-01-05 00:00:00' + to_minutes(vec_id * 97) AS publish_time,
               embedding, label FROM embeddings)""" 


def features(spark, sf_dir, by=()):
    """Market features. By ``symbol`` the bars and windows of a series share one exchange and one sort; where models are fitted
    rows stay in the order their samples were drawn from."""
    return market.market_features(bars(spark, sf_dir, by), SPLITS)


W = "OVER (PARTITION BY symbol ORDER BY trade_date)"


def win(n):
    return f"OVER (PARTITION BY symbol ORDER BY trade_date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


SO_FAR = "OVER (PARTITION BY symbol ORDER BY trade_date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def full(agg, value, n):
    return f"CASE WHEN count({value}) {win(n)} = {n} THEN {agg}({value}) {win(n)} END"


def lagged(c, n):
    return f"lag({c}, {n}) {W}"


_F1 = ", ".join(
    [f"{sql_div('close', lagged('close', n))} - 1 AS ret_{n}" for n in (1, 2, 3, 5, 10, 20)]
    + [f"{sql_div('volume', lagged('volume', n))} - 1 AS volume_change_{n}" for n in (1, 5)]
    + [f"{full('avg', 'close', n)} AS ma_{n}" for n in (5, 10, 20)]
    + [f"close - {lagged('close', n)} AS momentum_{n}" for n in (5, 10)]
    + [f"{sql_div('high - low', 'close')} AS hl_range", f"{sql_div('close - open', 'open')} AS oc_return",
       f"{sql_div('open', lagged('close', 1))} - 1 AS gap_return", f"close - {lagged('close', 1)} AS step",
       f"max(close) {SO_FAR} AS peak", f"{sql_div(f'lead(close, 1) {W}', 'close')} - 1 AS next_ret_1",
       f"{sql_div(f'lead(close, 1) {W}', f'lead(open, 1) {W}')} - 1 AS next_oc_return"])


def _corr(n):
    x, y = "ret_1", "volume_change_1"
    return (f"CASE WHEN count(CASE WHEN {x} IS NOT NULL AND {y} IS NOT NULL THEN 1 END) {win(n)} = {n} "
            f"AND stddev_samp({x}) {win(n)} > 1e-12 AND stddev_samp({y}) {win(n)} > 1e-12 "
            f"THEN covar_samp({x}, {y}) {win(n)} / (stddev_samp({x}) {win(n)} * stddev_samp({y}) {win(n)}) END "
            f"AS price_volume_corr_{n}")


_F2 = ", ".join(
    [f"{sql_div('close', f'ma_{n}')} - 1 AS ma_gap_{n}" for n in (5, 10, 20)]
    + [f"{full('stddev_samp', 'ret_1', n)} AS volatility_{n}" for n in (5, 10, 20)]
    + [_corr(n) for n in (5, 10)]
    + [f"{full('avg', 'greatest(step, 0)', 14)} AS gain", f"{full('avg', 'greatest(-step, 0)', 14)} AS loss",
       "CASE WHEN next_ret_1 IS NOT NULL THEN CASE WHEN next_ret_1 > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END END AS y_cls"])
_F2 = _F2.replace("greatest(step, 0)", "CASE WHEN step IS NOT NULL THEN greatest(step, 0) END").replace(
    "greatest(-step, 0)", "CASE WHEN step IS NOT NULL THEN greatest(-step, 0) END")

SPLIT_SQL = (f"CASE WHEN trade_date <= DATE '{SPLITS['train_end']}' THEN 'train' "
             f"WHEN trade_date <= DATE '{SPLITS['valid_end']}' THEN 'valid' "
             f"WHEN trade_date <= DATE '{SPLITS['test_end']}' THEN 'test' "
             "WHEN trade_date IS NOT NULL THEN 'holdout' ELSE 'test' END")

FEATURES = f"""{BARS},
f1 AS (SELECT *, {_F1} FROM bars),
f2 AS (SELECT *, {_F2} FROM f1),
f3 AS (SELECT *, 100 - 100 / (1 + {sql_div('gain', 'loss')}) AS rsi_14,
         CASE WHEN ma_gap_20 > 0 THEN 1 ELSE 0 END AS trend_regime,
         CASE WHEN count(volatility_20) {win(60)} >= 20 AND volatility_20 > quantile_cont(volatility_20, 0.5) {win(60)}
              THEN 1 ELSE 0 END AS vol_regime,
         CASE WHEN {sql_div('close', 'peak')} - 1 <= -0.1 THEN 1 ELSE 0 END AS drawdown_state,
         {SPLIT_SQL} AS split
       FROM f2)"""


def predictions(spark, sf_dir, runs=RUNS):
    """Deterministic predictions of three runs, from the one-day return of the bars."""
    f = features(spark, sf_dir, ["symbol"]).where("next_ret_1 is not null")
    keep = ["symbol", "trade_date", "split", "y_cls", "next_ret_1", "next_oc_return", "trend_regime", "vol_regime",
            "drawdown_state"]
    run = F.explode(F.array(*[F.struct(F.lit(n).alias("run_name"), F.lit(k).alias("k")) for n, k in runs]))
    tagged = f.select(*keep, "ret_1", run.alias("_run"))
    k = F.col("_run.k")
    return tagged.select(
        F.col("_run.run_name").alias("run_name"), *keep,
        F.round(1.0 / (1.0 + F.exp(-k * F.col("ret_1"))), 3).alias("pred_cls_score"),
        (F.round(0.1 * k * F.col("ret_1"), 4) + 0.0).alias("pred_reg"))


PREDICTIONS = f"""{FEATURES},
runs(run_name, k) AS (VALUES {', '.join(f"('{n}', {k}::DOUBLE)" for n, k in RUNS)}),
pred AS (
  SELECT run_name, symbol, trade_date, split, y_cls, next_ret_1, next_oc_return, trend_regime, vol_regime,
         drawdown_state, round(1 / (1 + exp(-k * coalesce(ret_1, 0))), 3) AS pred_cls_score,
         round(0.1 * k * coalesce(ret_1, 0), 4) + 0.0 AS pred_reg
  FROM f3, runs WHERE next_ret_1 IS NOT NULL)"""
