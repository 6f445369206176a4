"""Tables on disk, chosen by suffix.

CSV directories written here keep a row on one line and carry their schema: in strings a backslash, a line break and U+0000
are written as a backslash and a letter, NULL as ``\\N``, nested values as JSON and bytes as base64, and the column types lie
in ``_schema.json`` inside the directory. Such a table reads back as it was, and its files can be split between tasks.
"""

from functools import reduce
import json

from pyspark.sql import functions as F, types as T

from ..contracts import MARKET_SCHEMA, RAW_MARKET, require_columns
from ..functions.numeric import finite

SCHEMA_FILE = "_schema.json"
ESCAPED = {"\n": "\\n", "\r": "\\r", "\0": "\\0"}
OWN_CSV = {"header": True, "escape": '"', "nullValue": "\\N", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False,
           "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def _format(path):
    low = str(path).lower().rstrip("/")
    if low.endswith(".csv"):
        return "csv"
    if low.endswith((".parquet", ".pq")):
        return "parquet"
    raise ValueError(f"unknown table format: {path}")


def _replace(text, old, new):
    return F.replace(text, F.lit(old), F.lit(new))


def escaped(text):
    """A string without line breaks from which ``restored`` gives the old one."""
    return reduce(lambda out, pair: _replace(out, *pair), ESCAPED.items(), _replace(text, "\\", "\\\\"))


def restored(text):
    pieces = F.transform(F.split(text, r"\\\\"), lambda piece: reduce(
        lambda out, pair: _replace(out, pair[1], pair[0]), ESCAPED.items(), piece))
    return F.array_join(pieces, "\\")


def _nested(kind):
    return isinstance(kind, (T.ArrayType, T.MapType, T.StructType))


def _in_text(kind):
    return _nested(kind) or isinstance(kind, (T.StringType, T.BinaryType))


def _to_text(field):
    value = F.col(f"`{field.name}`")
    if _nested(field.dataType):
        value = F.to_json(value, {"ignoreNullFields": "false"})
    elif isinstance(field.dataType, T.BinaryType):
        value = F.base64(value)
    return (escaped(value) if _in_text(field.dataType) else value).alias(field.name)


def _from_text(field):
    value = F.col(f"`{field.name}`")
    if _in_text(field.dataType):
        value = restored(value)
    if _nested(field.dataType):
        value = F.from_json(value, field.dataType)
    elif isinstance(field.dataType, T.BinaryType):
        value = F.unbase64(value)
    return value.alias(field.name)


def read_table(spark, path, schema=None, multi_line=False, infer=False):
    """CSV with a header or Parquet.

    CSV that ``write_table`` wrote comes back with its own types and needs no other argument. For any other CSV without
    ``schema`` the columns that the contract names take its types, and all others are strings, or with ``infer`` what one
    pass over the data shows. ``multi_line`` allows line breaks inside quotes there, at the price of one task per file.
    """
    if _format(path) == "parquet":
        return (spark.read.schema(schema) if schema is not None else spark.read).parquet(str(path))
    own = _stored_schema(spark, path)
    if own is not None:
        stored = T.StructType([T.StructField(f.name, T.StringType() if _in_text(f.dataType) else f.dataType) for f in own])
        out = spark.read.options(**OWN_CSV).schema(stored).csv(str(path)).select(*[_from_text(f) for f in own])
        return out if schema is None else out.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema])
    reader = spark.read.option("header", True).option("multiLine", multi_line).option("escape", '"')
    if schema is None:
        known = {f.name: f for f in MARKET_SCHEMA}
        seen = reader.option("inferSchema", infer).csv(str(path)).schema
        schema = T.StructType([known.get(f.name, f) for f in seen])
    return reader.schema(schema).csv(str(path))


def write_table(df, path, partition_by=()):
    """Overwrite a CSV or Parquet directory."""
    kind = _format(path)
    if kind == "parquet":
        _partitioned(df.write, partition_by).parquet(str(path))
        return str(path)
    order = [c for c in df.columns if c not in partition_by] + list(partition_by)  # as the files hold them
    _partitioned(df.select(*[_to_text(f) for f in df.schema]).write, partition_by).options(**OWN_CSV).csv(str(path))
    _put_text(df.sparkSession, f"{str(path).rstrip('/')}/{SCHEMA_FILE}", df.select(*[f"`{c}`" for c in order]).schema.json())
    return str(path)


def _partitioned(writer, columns):
    writer = writer.mode("overwrite")
    return writer.partitionBy(*columns) if columns else writer


def _hadoop(spark, path):
    where = spark._jvm.org.apache.hadoop.fs.Path(str(path))
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _put_text(spark, path, text):
    store, where = _hadoop(spark, path)
    out = store.create(where, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def _stored_schema(spark, path):
    """The schema that ``write_table`` left in a CSV directory, or None."""
    store, where = _hadoop(spark, path)
    if not (store.exists(where) and store.getFileStatus(where).isDirectory()):
        return None
    where = spark._jvm.org.apache.hadoop.fs.Path(where, SCHEMA_FILE)
    if not store.exists(where):
        return None
    source = store.open(where)
    try:
        return T.StructType.fromJson(json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8")))
    finally:
        source.close()


def path_exists(spark, path):
    """Whether a path exists on its Hadoop file system."""
    store, where = _hadoop(spark, path)
    return store.exists(where)


def market_table(df):
    """Check the market columns, make ``trade_date`` a date and every price and volume a finite double or NULL."""
    require_columns(df, RAW_MARKET, "market")
    return df.withColumns({"trade_date": F.to_date("trade_date"), **{c: finite(c) for c in RAW_MARKET[1:]}})


def load_market(spark, path):
    return market_table(read_table(spark, path))
