"""Tables, article records, cleaning, duplicates and trading days."""

from pyspark.sql import functions as F

from tapeloom.functions import text as X
from tapeloom.functions.markup import strip_markup
from tapeloom.functions.storage import cut
from tapeloom.operators import calendar as cal, cleaning, dedup, near_titles as near
from tapeloom.sources import articles as art, tables as tb

from . import query
from .fixtures import (ALIGN, BARS, CALENDAR, CLEAN, NEWS, SPACES, bars, calendar, news, r6, rounded, sql_clean, table)

THRESHOLD, WINDOW = 0.95, 24
LOOSE = 0.8


# ---------------------------------------------------------------- tables and records

@query("scan_lineitem", "SELECT l_orderkey, l_linenumber, l_partkey, l_shipdate, l_extendedprice FROM lineitem")
def scan_lineitem(spark, d):
    li = tb.read_table(spark, f"{d}/lineitem.parquet")
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate", "l_extendedprice")


@query("roundtrip_csv", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders")
def roundtrip_csv(spark, d):
    from tapeloom.functions.storage import ensure_checkpoint_dir
    import uuid

    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/roundtrip-{uuid.uuid4()}.csv"
    return tb.read_table(spark, tb.write_table(orders, path), orders.schema)


@query("load_market", f"""WITH {BARS} SELECT symbol, trade_date, {', '.join(r6(c, c) for c in ('open', 'high', 'low', 'close', 'volume'))} FROM bars""")
def load_market(spark, d):
    raw = bars(spark, d).withColumn("trade_date", F.col("trade_date").cast("timestamp_ntz"))
    return rounded(tb.market_table(raw).select("symbol", "trade_date", "open", "high", "low", "close", "volume"))


# Raw news with gaps: some ids, URLs, sources, titles and times are missing, blank or padded.
def raw_news(spark, d):
    n = news(spark, d)
    i = F.substring("news_id", 2, 20).cast("long")
    return n.select(
        F.when(i % 3 == 0, F.lit(None)).when(i % 7 == 1, F.lit(" ")).otherwise(F.col("news_id")).alias("news_id"),
        F.when(i % 5 == 0, F.lit(None)).when(i % 11 == 3, F.lit("  ")).otherwise(F.col("source")).alias("source"),
        F.when(i % 4 == 0, F.lit("")).otherwise(F.concat(F.lit(" "), "url")).alias("url"),
        F.when(i % 13 == 5, F.lit("")).otherwise(F.col("title")).alias("title"),
        F.when(i % 17 == 2, F.lit("not a time")).otherwise(F.date_format("publish_time", "yyyy-MM-dd HH:mm:ss")).alias("publish_time"),
        F.when(i % 19 == 4, F.lit(None)).otherwise(F.col("content")).alias("content"), i.alias("row_no"))


_RAW = f"""{NEWS},
raw AS (
  SELECT CASE WHEN i % 3 = 0 THEN NULL WHEN i % 7 = 1 THEN ' ' ELSE news_id END AS news_id,
         CASE WHEN i % 5 = 0 THEN NULL WHEN i % 11 = 3 THEN '  ' ELSE source END AS source,
         CASE WHEN i % 4 = 0 THEN '' ELSE ' ' || url END AS url,
         CASE WHEN i % 13 = 5 THEN '' ELSE title END AS title,
         CASE WHEN i % 17 = 2 THEN NULL ELSE publish_time END AS publish_time,
         CASE WHEN i % 19 = 4 THEN NULL ELSE content END AS content, i AS row_no
  FROM (SELECT *, CAST(substr(news_id, 2) AS BIGINT) AS i FROM news))"""


def _strip(c):
    return f"regexp_replace({c}, '^{SPACES}|{SPACES}$', '', 'g')"


_ISO = "strftime(publish_time, '%Y-%m-%dT%H:%M:%S')"
_NORMAL = f"""{_RAW},
n0 AS (SELECT row_no, publish_time, coalesce(content, '') AS content, trim(coalesce(news_id, '')) AS id0,
              trim(coalesce(nullif(source, ''), 'legacy_input')) AS source, trim(coalesce(url, '')) AS url0,
              {_strip("coalesce(title, '')")} AS title FROM raw),
n1 AS (SELECT *, coalesce(nullif(url0, ''), 'legacy://' || source || '/' ||
              substr(sha1(source || '|' || title || '|' || coalesce({_ISO}, 'NaT')), 1, 12)) AS place FROM n0),
n2 AS (SELECT *, CASE WHEN id0 <> '' THEN id0 WHEN title = '' THEN '' ELSE 'news_' || substr(sha1(
              source || '|' || place || '|' || coalesce({_ISO}, '1970-01-01T00:00:00') || '|' || title), 1, 16) END AS news_id FROM n1),
n3 AS (SELECT *, coalesce(nullif(url0, ''), 'legacy://' || source || '/' || news_id) AS url,
         CASE WHEN news_id = '' THEN 'news_id is required' WHEN source = '' THEN 'source is required'
              WHEN title = '' THEN 'title is required' WHEN publish_time IS NULL THEN 'publish_time is required' END AS reject_reason
       FROM n2)"""
_RECORD = "row_no, news_id, source, url, title, publish_time, content, publish_time AS crawl_time, '' AS channel, news_id AS canonical_news_id"
_RECORD_COLUMNS = ["row_no", "news_id", "source", "url", "title", "publish_time", "content", "crawl_time", "channel", "canonical_news_id"]


@query("normalize_article", f"WITH {_NORMAL} SELECT {_RECORD}, reject_reason FROM n3")
def normalize_article(spark, d):
    return art.normalize_articles(raw_news(spark, d)).select(*_RECORD_COLUMNS, "reject_reason")


@query("load_news", f"WITH {_NORMAL} SELECT {_RECORD} FROM n3 WHERE reject_reason IS NULL")
def load_news(spark, d):
    return art.news_table(raw_news(spark, d)).select(*_RECORD_COLUMNS)


@query("reject_articles", f"WITH {_NORMAL} SELECT row_no, reject_reason FROM n3 WHERE reject_reason IS NOT NULL")
def reject_articles(spark, d):
    return art.rejected_articles(art.normalize_articles(raw_news(spark, d))).select("row_no", "reject_reason")


@query("news_id", f"""WITH {NEWS} SELECT news_id AS doc, 'news_' || substr(sha1(trim(source) || '|' || trim(url) || '|' ||
                      {_ISO} || '|' || {_strip('title')}), 1, 16) AS news_id FROM news""")
def news_id(spark, d):
    return news(spark, d).select(F.col("news_id").alias("doc"),
                                 X.news_id("source", "url", "publish_time", "title").alias("news_id"))


@query("crawl_dedup", f"""WITH {NEWS} SELECT news_id, source, publish_time, url FROM (
         SELECT * , row_number() OVER (PARTITION BY news_id ORDER BY source, publish_time, url) AS rn
         FROM (SELECT * REPLACE ('t' || substr(sha1(content), 1, 16) AS news_id) FROM news)) WHERE rn = 1""")
def crawl_dedup(spark, d):
    """Articles whose id comes from their text, so copies share it: the first record of each id."""
    records = news(spark, d).select(
        F.concat(F.lit("t"), F.substring(X.hash_text("content"), 1, 16)).alias("news_id"), "source", "publish_time", "url")
    return art.first_per_id(records)


@query("sorted_articles", f"WITH {NEWS} SELECT news_id, source, publish_time, title FROM news ORDER BY publish_time, news_id")
def sorted_articles(spark, d):
    return news(spark, d).select("news_id", "source", "publish_time", "title").orderBy("publish_time", "news_id")


# ---------------------------------------------------------------- cleaning

@query("clean_text", f"SELECT doc_id, {sql_clean('text')} AS clean FROM documents")
def clean_text(spark, d):
    return table(spark, d, "documents").select("doc_id", strip_markup("text").alias("clean"))


def _sql_decoded(c):
    for name, char in (("copy", "©"), ("middot", "·"), ("quot", '"'), ("lt", "<"), ("gt", ">"), ("amp", "&")):
        c = f"replace({c}, '&{name};', '{char}')"
    return c


_SQL_SHOWN = f"regexp_replace({_sql_decoded('html')}, '<script>.*?</script>|<style>.*?</style>|<!--.*?-->|<[^<>]*>', ' ', 'gs')"


@query("clean_markup", f"SELECT page_id, coalesce({sql_clean(_sql_decoded(_SQL_SHOWN))}, '') AS clean FROM pages")
def clean_markup(spark, d):
    return table(spark, d, "pages").select("page_id", strip_markup("html").alias("clean"))


@query("text_hash", "SELECT doc_id, sha1(coalesce(text, '')) AS hash FROM documents")
def text_hash(spark, d):
    return table(spark, d, "documents").select("doc_id", X.hash_text("text").alias("hash"))


@query("text_lengths", "SELECT doc_id, CAST(length(coalesce(text, '')) AS INTEGER) AS text_len FROM documents")
def text_lengths(spark, d):
    return table(spark, d, "documents").select("doc_id", X.text_length("text").alias("text_len"))


_CLEANED = "news_id, title AS raw_title, title_clean, content_clean, title_hash, content_hash"


@query("clean_news", f"WITH {NEWS} {CLEAN} SELECT {_CLEANED} FROM cleaned")
def clean_news(spark, d):
    return cleaning.clean_news(news(spark, d)).select(
        "news_id", "raw_title", "title_clean", "content_clean", "title_hash", "content_hash")


def _sql_url(u):
    path = rf"regexp_replace(regexp_extract({u}, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), '/+$', '')"
    return (rf"lower(regexp_extract({u}, '^([A-Za-z]+://[^/?#]*)', 1)) || "
            f"CASE WHEN {path} = '' THEN '/' ELSE {path} END")


@query("normalize_url", f"SELECT url, {_sql_url('url')} AS url_normalized FROM pages UNION ALL "
                        f"SELECT url, {_sql_url('url')} FROM (WITH {NEWS} SELECT url FROM news)")
def normalize_url(spark, d):
    urls = table(spark, d, "pages").select("url").unionAll(news(spark, d).select("url"))
    return urls.select("url", X.normalize_url("url").alias("url_normalized"))


@query("localize_ts", "SELECT event_id, ts + INTERVAL 8 HOUR AS local_ts FROM events")
def localize_ts(spark, d):
    aware = table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    return aware.select("event_id", X.localize("ts", "timestamp", "Asia/Shanghai").alias("local_ts"))


# ---------------------------------------------------------------- duplicates

def cleaned(spark, d):
    return cleaning.clean_news(news(spark, d))


_KEYED = f"""{NEWS} {CLEAN},
keyed AS (SELECT *, {_sql_url('url')} AS url_normalized, title_hash || '|' || content_hash AS exact_key FROM cleaned),
ranked AS (
  SELECT *, first(news_id) OVER u AS url_first, count(*) OVER (PARTITION BY url_normalized) AS url_n,
         first(news_id) OVER t AS text_first, count(*) OVER (PARTITION BY exact_key) AS text_n
  FROM keyed
  WINDOW u AS (PARTITION BY url_normalized ORDER BY publish_time NULLS LAST, length(content_clean) DESC, news_id
               ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING),
         t AS (PARTITION BY exact_key ORDER BY publish_time NULLS LAST, length(content_clean) DESC, news_id
               ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
flags AS (
  SELECT *, CASE WHEN url_first <> news_id THEN 'exact_url' WHEN text_first <> news_id THEN 'exact_text' ELSE '' END
            AS duplicate_reason,
         CASE WHEN text_n > 1 AND text_first = news_id THEN news_id WHEN url_first <> news_id THEN url_first
              WHEN text_first <> news_id THEN text_first ELSE news_id END AS canonical_news_id
  FROM ranked)"""


@query("canonical_article", f"""WITH {_KEYED} SELECT DISTINCT exact_key, text_first AS canonical_id, text_n AS group_size
                                FROM ranked WHERE text_n > 1""")
def canonical_article(spark, d):
    return dedup.canonical_articles(dedup.dedup_keys(cleaned(spark, d)), "exact_key")


@query("dedup_exact_url", f"""WITH {_KEYED} SELECT news_id, url_normalized, canonical_news_id FROM flags
                              WHERE duplicate_reason = 'exact_url'""")
def dedup_exact_url(spark, d):
    flags = dedup.exact_flags(dedup.dedup_keys(cleaned(spark, d)))
    return flags.where("duplicate_reason = 'exact_url'").select("news_id", "url_normalized", "canonical_news_id")


@query("dedup_exact_text", f"""WITH {_KEYED} SELECT news_id, exact_key, canonical_news_id FROM flags
                               WHERE duplicate_reason = 'exact_text'""")
def dedup_exact_text(spark, d):
    flags = dedup.exact_flags(dedup.dedup_keys(cleaned(spark, d)))
    return flags.where("duplicate_reason = 'exact_text'").select("news_id", "exact_key", "canonical_news_id")


@query("dedup_exact", f"""WITH {_KEYED} SELECT news_id, title_clean, url_normalized, exact_key, duplicate_reason <> '' AS is_duplicate,
                          duplicate_reason, canonical_news_id FROM flags""")
def dedup_exact(spark, d):
    out = dedup.dedup_news(cleaned(spark, d), near=False)
    return out.select("news_id", "title_clean", "url_normalized", "exact_key", "is_duplicate", "duplicate_reason",
                      "canonical_news_id")


def open_titles(spark, d):
    """Articles that no exact rule has flagged."""
    flags = dedup.exact_flags(dedup.dedup_keys(cleaned(spark, d)))
    return flags.where("duplicate_reason = ''").select("news_id", "publish_time", "title_clean", "content_len")


_CANDIDATES = f"""WITH {_KEYED},
seen AS MATERIALIZED (SELECT DISTINCT sha1(title_clean) AS tid, title_clean AS title,
          CAST(floor(epoch(publish_time) / (3600 * {WINDOW})) AS BIGINT) AS b FROM flags WHERE duplicate_reason = ''),
pairs AS (SELECT tid, title, i, c[i] || c[i + 1] AS gram
          FROM (SELECT tid, title, c, unnest(range(1, len(c))) AS i
                FROM (SELECT DISTINCT tid, title, string_split(title, '') AS c FROM seen))),
grams AS MATERIALIZED (SELECT tid, any_value(title) AS title, list(gram || '#' || n) AS g
          FROM (SELECT *, row_number() OVER (PARTITION BY tid, gram ORDER BY i) AS n FROM pairs) GROUP BY tid),
met AS (SELECT DISTINCT least(x.tid, y.tid) AS src, greatest(x.tid, y.tid) AS dst
        FROM seen x JOIN seen y ON y.b IN (x.b, x.b + 1) AND x.tid <> y.tid),
shared AS (SELECT src, dst, CAST(len(list_intersect(x.g, y.g)) AS INTEGER) AS n_shared, length(x.title) AS a, length(y.title) AS c
           FROM met JOIN grams x ON x.tid = src JOIN grams y ON y.tid = dst)
SELECT src, dst, n_shared FROM shared
WHERE n_shared > 0 AND 2 * least(a, c) >= {LOOSE} * (a + c) - 1e-9
  AND n_shared >= (1.5 * {LOOSE} - 1) * (a + c) - 1 - 1e-9"""


@query("near_title_candidates", _CANDIDATES)
def near_title_candidates(spark, d):
    return near.title_candidates(cut(open_titles(spark, d)), LOOSE, WINDOW)


@query("near_title_pairs")
def near_title_pairs(spark, d):
    return near.similar_titles(cut(open_titles(spark, d)), LOOSE, WINDOW)


@query("dedup_near_title")
def dedup_near_title(spark, d):
    return near.near_title_flags(open_titles(spark, d), THRESHOLD, WINDOW)


@query("dedup_news")
def dedup_news(spark, d):
    return dedup.dedup_news(cleaned(spark, d), THRESHOLD, WINDOW).select(
        "news_id", "is_duplicate", "duplicate_reason", "canonical_news_id")


@query("time_band_pairs", f"""WITH {NEWS}, t AS (SELECT news_id, publish_time AS at FROM news)
       SELECT x.news_id, count(*) - 1 AS n_partners FROM t x JOIN t y
       ON y.at >= x.at AND y.at <= x.at + INTERVAL {WINDOW} HOUR GROUP BY 1""")
def time_band_pairs(spark, d):
    """Size of the time-band self-join per article."""
    return near.band_sizes(news(spark, d), WINDOW)


# ---------------------------------------------------------------- trading days

@query("assign_trade_dates", f"""WITH {NEWS}, {CALENDAR} {ALIGN.replace('{src}', 'news')}
                                 SELECT news_id, publish_time, trade_date, publish_date FROM aligned""")
def assign_trade_dates(spark, d):
    out = cal.assign_trade_dates(news(spark, d), calendar(spark, d))
    return out.select("news_id", "publish_time", "trade_date", "publish_date")


@query("dedup_root", "SELECT 'd' || doc_id AS news_id, 'd' || ((doc_id // 50) * 50) AS root_news_id FROM documents")
def dedup_root(spark, d):
    """Every article points to the one before it, in chains of fifty; the root is the first of the chain."""
    i = F.col("doc_id")
    name = lambda c: F.concat(F.lit("d"), c.cast("string"))
    chain = table(spark, d, "documents").select(name(i).alias("news_id"), name(F.when(i % 50 == 0, i).otherwise(i - 1)).alias("canonical_news_id"))
    return dedup.with_root(chain).select("news_id", "root_news_id")


@query("load_news_zoned", f"""WITH {NEWS} SELECT news_id, publish_time + to_hours(CASE CAST(substr(news_id, 2) AS BIGINT) % 4
         WHEN 0 THEN 8 WHEN 1 THEN 6 WHEN 2 THEN 13 ELSE 0 END) AS publish_time FROM news""")
def load_news_zoned(spark, d):
    """Publication times as text, three in four with an offset, become market time."""
    i = F.substring("news_id", 2, 20).cast("long") % 4
    offset = F.when(i == 0, "Z").when(i == 1, "+02:00").when(i == 2, "-0500").otherwise("")
    raw = news(spark, d).withColumn("publish_time", F.concat(F.date_format("publish_time", "yyyy-MM-dd'T'HH:mm:ss"), offset))
    return art.normalize_articles(raw).select("news_id", "publish_time")
