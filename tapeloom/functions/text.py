"""String expressions; lengths are code points."""

from pyspark.sql import functions as F

from .numeric import as_col

# Characters a Python string treats as white space, and zero-width characters to drop.
_SPACE = r"[\s\x1c-\x1f\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_ZERO_WIDTH = r"[\x{200b}\x{200c}\x{200d}\x{feff}]+"

# Sentiment keywords and class probabilities of the default encoder.
POSITIVE_WORDS = ["rise", "gain", "up", "bull", "profit", "improve", "optimistic", "growth"]
NEGATIVE_WORDS = ["fall", "drop", "down", "bear", "loss", "risk", "decline", "warning"]
SENTIMENT_PROBABILITIES = {"pos": (0.7, 0.1, 0.2), "neg": (0.1, 0.7, 0.2), "tie": (0.1, 0.1, 0.8)}


def blank_if_null(c):
    return F.coalesce(as_col(c), F.lit(""))


def null_if_blank(c):
    x = as_col(c)
    return F.when(x != "", x)


def strip(c):
    """Drop white space at both ends, for all Unicode spaces."""
    return F.regexp_replace(as_col(c), f"^{_SPACE}+|{_SPACE}+$", "")


def squeeze(c):
    """Drop zero-width characters, turn runs of white space into one space, trim."""
    return F.trim(F.regexp_replace(F.regexp_replace(as_col(c), _ZERO_WIDTH, ""), f"{_SPACE}+", " "))


def text_length(c):
    return F.length(blank_if_null(c))


def hash_text(c):
    return F.sha1(blank_if_null(c).cast("binary"))


def iso_time(ts):
    """ISO 8601 wall time; microseconds only when they are not zero."""
    ts = as_col(ts)
    micros = F.date_format(ts, "SSSSSS")
    tail = F.when(micros != "000000", F.concat(F.lit("."), micros)).otherwise("")
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), tail)


def news_id(source, url, publish_time, title):
    """Deterministic article id from source, url, time and title."""
    when = F.coalesce(iso_time(publish_time), F.lit("1970-01-01T00:00:00"))
    parts = [strip(blank_if_null(source)), strip(blank_if_null(url)), when, strip(blank_if_null(title))]
    return F.concat(F.lit("news_"), F.substring(F.sha1(F.concat_ws("|", *parts).cast("binary")), 1, 16))


def normalize_url(url):
    """Lower-case scheme and host, no trailing slash, no query, no fragment; ``legacy:`` ids stay as they are."""
    u = strip(blank_if_null(url))
    pattern = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(//[^/?#]*)?([^?#]*).*$"
    scheme = F.lower(F.regexp_extract(u, pattern, 1))
    host = F.lower(F.regexp_extract(u, pattern, 2))
    path = F.regexp_replace(F.regexp_extract(u, pattern, 3), "/+$", "")
    path = F.when(path == "", F.lit("/")).otherwise(path)
    prefix = F.when(scheme != "", F.concat(scheme, F.lit(":"))).otherwise("")
    return F.when((u == "") | (scheme == "legacy"), u).otherwise(F.concat(prefix, host, path))


def _hits(text, words):
    low = F.lower(blank_if_null(text))
    total = F.lit(0)
    for word in words:
        total = total + F.when(F.contains(low, F.lit(word)), 1).otherwise(0)
    return total


def keyword_sentiment(text):
    """Struct ``(pos, neg, neu)`` from the number of distinct keywords found in the text."""
    up, down = _hits(text, POSITIVE_WORDS), _hits(text, NEGATIVE_WORDS)

    def pick(i):
        return (F.when(up > down, SENTIMENT_PROBABILITIES["pos"][i])
                .when(down > up, SENTIMENT_PROBABILITIES["neg"][i])
                .otherwise(SENTIMENT_PROBABILITIES["tie"][i]))

    return F.struct(pick(0).alias("pos"), pick(1).alias("neg"), pick(2).alias("neu"))


def _once(value, use):
    """``use(value)`` with ``value`` worked out once, not once per element of an inner array function."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def hash_embedding(text, dim):
    """SHA-256 bytes of the text, cycled to ``dim`` numbers in [-1, 1]."""
    def numbers(digest):
        def byte(i):
            pair = F.substr(digest, (i % 32) * 2 + 1, F.lit(2))
            return F.conv(pair, 16, 10).cast("double") / 255.0 * 2.0 - 1.0

        return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), byte)

    return _once(F.sha2(blank_if_null(text).cast("binary"), 256), numbers)


def resize_vector(v, dim):
    """Cut or zero-pad to ``dim`` entries."""
    return F.slice(F.concat(as_col(v).cast("array<double>"), F.array_repeat(F.lit(0.0), dim)), 1, dim)


def softmax(v):
    v = as_col(v)

    def shares(weights):
        total = F.aggregate(weights, F.lit(0.0), lambda a, b: a + b)
        return _once(total, lambda t: F.transform(weights, lambda w: w / t))

    top = F.array_max(v).cast("double")
    return _once(_once(top, lambda m: F.transform(v, lambda x: F.exp(x.cast("double") - m))), shares)


def embedding_names(dim):
    return [f"emb_{i:03d}" for i in range(dim)]


def widen_vector(v, dim):
    return [F.get(as_col(v), F.lit(i)).alias(name) for i, name in enumerate(embedding_names(dim))]


def narrow_vector(names):
    return F.array(*[F.col(n).cast("double") for n in names])


def localize(ts, data_type, zone):
    """Wall time in ``zone``: naive values already are, zone-aware ones are converted."""
    ts = as_col(ts)
    if data_type == "timestamp_ntz":
        return ts
    return F.convert_timezone(None, F.lit(zone), ts.cast("timestamp_ntz"))
