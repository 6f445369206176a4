"""Raw news tables to validated article records."""

from pyspark.sql import functions as F

from ..contracts import ARTICLE_COLUMNS, RAW_NEWS, require_columns
from ..functions import text as X
from .tables import read_table


def wall_time(c, zone):
    """Time of a text as wall time in ``zone``: an offset (``Z``, ``+08:00``, ``+0800``) is converted, else the text is local."""
    text = F.trim(X.as_col(c))
    offset = text.rlike(r"[:0-9](\s*[A-Za-z]{1,3}|\s*[+-]\d{2}:?\d{2})$") & text.rlike(r"\d:\d")
    spelled = F.regexp_replace(text, r"\s*([+-]\d{2}):?(\d{2})$", "$1:$2")
    instant = F.convert_timezone(None, F.lit(zone), F.try_to_timestamp(spelled).cast("timestamp_ntz"))
    return F.when(offset, instant).otherwise(text.try_cast("timestamp_ntz"))


def _timestamp(df, name, zone):
    kind = dict(df.dtypes)[name]
    if kind in ("timestamp", "timestamp_ntz"):
        return F.col(name)
    return wall_time(F.col(f"`{name}`").cast("string"), zone)


def normalize_articles(df, zone="Asia/Shanghai"):
    """Article records with the 18 contract columns first, other columns after them, and ``reject_reason``.

    Missing ids and URLs are made from the other fields. ``reject_reason`` is NULL for a valid record, else the first
    required field that is missing. Times given as text become wall time in ``zone``.
    """
    def text(name):
        return X.blank_if_null(F.col(name).cast("string")) if name in df.columns else F.lit("")

    times = {"publish_time": _timestamp(df, "publish_time", zone)}
    crawl = _timestamp(df, "crawl_time", zone) if "crawl_time" in df.columns else F.lit(None)
    times["crawl_time"] = F.coalesce(crawl, times["publish_time"])
    source = X.strip(F.coalesce(X.null_if_blank(text("source")), F.lit("legacy_input")))
    df = df.withColumns({**times, "_source": source, "_title": X.strip(text("title")), "_url": X.strip(text("url")),
                         "_id": X.strip(text("news_id"))})

    stamp = F.coalesce(X.iso_time("publish_time"), F.lit("NaT"))
    key = F.sha1(F.concat_ws("|", "_source", "_title", stamp).cast("binary"))
    legacy = F.concat(F.lit("legacy://"), F.col("_source"), F.lit("/"))
    place = F.coalesce(X.null_if_blank("_url"), F.concat(legacy, F.substring(key, 1, 12)))
    made = F.when(F.col("_title") != "", X.news_id("_source", place, "publish_time", "_title")).otherwise("")
    df = df.withColumn("_id", F.coalesce(X.null_if_blank("_id"), made))
    url = F.coalesce(X.null_if_blank("_url"), F.concat(legacy, F.col("_id")))

    given = {"news_id": F.col("_id"), "source": F.col("_source"), "url": url, "title": F.col("_title"),
             "publish_time": F.col("publish_time"), "content": text("content"), "crawl_time": F.col("crawl_time"),
             "channel": X.strip(text("channel"))}
    flag = F.coalesce(F.col("is_duplicate").cast("boolean"), F.lit(False)) if "is_duplicate" in df.columns else F.lit(False)
    pointer = F.coalesce(X.null_if_blank(text("canonical_news_id")), F.col("_id"))
    day = F.to_date("trade_date") if "trade_date" in df.columns else F.lit(None).cast("date")
    given |= {"is_duplicate": flag, "canonical_news_id": pointer, "trade_date": day}
    columns = [given.get(c, text(c)).alias(c) for c in ARTICLE_COLUMNS]
    extra = [c for c in df.columns if c not in ARTICLE_COLUMNS and not c.startswith("_")]
    out = df.select(*columns, *extra)

    reason = F.lit(None).cast("string")
    for c in ("crawl_time", "publish_time", "title", "url", "source", "news_id"):
        absent = F.col(c).isNull() if c.endswith("_time") else F.col(c) == ""
        reason = F.when(absent, F.lit(f"{c} is required")).otherwise(reason)
    return out.withColumn("reject_reason", reason)


def valid_articles(normalized, strict=False):
    """Valid records; ``strict`` fails the job at the first invalid one."""
    if strict:
        checked = F.when(F.col("reject_reason").isNull(), F.lit(True)).otherwise(
            F.raise_error(F.col("reject_reason")).cast("boolean"))
        return normalized.where(checked).drop("reject_reason")
    return normalized.where("reject_reason is null").drop("reject_reason")


def rejected_articles(normalized):
    return normalized.where("reject_reason is not null")


def news_table(df, strict=False, zone="Asia/Shanghai"):
    """Validated article records of a raw news table."""
    require_columns(df, RAW_NEWS, "news")
    return valid_articles(normalize_articles(df, zone), strict)


def load_news(spark, path, strict=False, zone="Asia/Shanghai"):
    return news_table(read_table(spark, path, multi_line=True), strict, zone)


def first_per_id(articles, order=("source", "publish_time")):
    """First record per ``news_id`` in ``order``, ties by the remaining columns; groups shrink before the shuffle."""
    rest = [c for c in articles.columns if c != "news_id" and c not in order]
    nulls = [F.col(c).isNull().alias(f"_n{i}") for i, c in enumerate(order)]
    record = F.struct(*nulls, *order, *rest)
    picked = articles.groupBy("news_id").agg(F.min(record).alias("_r"))
    return picked.select(*[F.col("news_id") if c == "news_id" else F.col(f"_r.{c}") for c in articles.columns])


def surplus_ids(articles):
    """Ids that occur more than once and how many records ``first_per_id`` leaves out for each."""
    counts = articles.groupBy("news_id").agg((F.count("*") - 1).alias("n_surplus"))
    return counts.where("n_surplus > 0")
