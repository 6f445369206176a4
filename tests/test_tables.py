"""Tables written and read back."""

from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tapeloom.sources import tables as tb

TEXTS = ["plain", "", None, "a,\"b\"\nc", "two\r\nlines", "\r", "\n", "\\", "\\n", "\\\\n\n\\", "\\N", "N", "null", " lead and trail ", "\t", '"', '""', "x\0y", "\0first",
         "#no comment", "数据 \U0001f600 \u2028 \u0085", "'", "a;b|c", '\\"', '"\\', "\\0", "long " * 5000]


def back(spark, df, path, **options):
    got = tb.read_table(spark, tb.write_table(df, path), **options)
    assert got.schema.simpleString() == df.schema.simpleString()
    return got


@pytest.mark.parametrize("suffix", ["CSV", "parquet", "pq"])
def test_texts_come_back(spark, tmp_path, suffix):
    df = spark.createDataFrame([(i, t, t) for i, t in enumerate(TEXTS)], "i int, s string, last string").repartition(3)
    got = back(spark, df, f"{tmp_path}/t.{suffix}").collect()
    assert {r.i: (r.s, r.last) for r in got} == {i: (t, t) for i, t in enumerate(TEXTS)} and len(got) == len(TEXTS)


def test_all_types_come_back_as_csv(spark, tmp_path):
    schema = ("d date, n timestamp_ntz, t timestamp, x double, f float, l long, b boolean, m decimal(20,5), a array<double>, "
              "o struct<u:string,v:int>, k map<string,string>, y binary, `odd name,` string")
    rows = [(date(1583, 1, 2), datetime(1998, 1, 5, 1, 2, 3, 456789), datetime(2024, 7, 1, 1, 2, 3, 7), 0.1 + 0.2, 1.5, -(1 << 62), True, Decimal("1.50000"),
             [1.0, None, 1e-300], ("a\nb", None), {"k\\": "v\n"}, b"\x00\xff", "x"),
            (None,) * 13, (date(9999, 12, 31), None, None, float("inf"), float("-inf"), 0, False, None, [], (None, 1), {}, b"", "")]
    df = spark.createDataFrame(rows, schema)
    assert sorted(map(str, back(spark, df, f"{tmp_path}/t.csv").collect())) == sorted(map(str, df.collect()))
    nan = spark.createDataFrame([(float("nan"),)], "x double")
    assert str(back(spark, nan, f"{tmp_path}/n.csv").first().x) == "nan"


def test_csv_lines_are_rows_and_partitions_come_back(spark, tmp_path):
    df = spark.createDataFrame([("a\nb", "p/1", 1.0), ("c\r", "p 2", 2.0), (None, "p 2", None)], "s string, part string, v double")
    path = tb.write_table(df, f"{tmp_path}/t.csv", ["part"])
    assert spark.read.text(path).where("not startswith(value, 's,')").count() == 3
    assert {tuple(r) for r in tb.read_table(spark, path).select(*df.columns).collect()} == {tuple(r) for r in df.collect()}
    none = df.where("s = 'zz'")
    assert back(spark, none, f"{tmp_path}/e.csv").count() == 0
    assert back(spark, df, f"{tmp_path}/t.csv").count() == 3  # overwritten, without partitions


def test_foreign_csv(spark, tmp_path):
    path = f"{tmp_path}/foreign.csv"
    with open(path, "w") as out:
        out.write('trade_date,close,note,rank\n2024-01-02,1.5,"two\nlines",7\n2024-01-03,,\\n,8\n')
    got = tb.read_table(spark, path, multi_line=True)
    assert [tuple(r) for r in got.collect()] == [(date(2024, 1, 2), 1.5, "two\nlines", "7"), (date(2024, 1, 3), None, "\\n", "8")]
    assert dict(tb.read_table(spark, path, multi_line=True, infer=True).dtypes)["rank"] == "int"
    assert tb.read_table(spark, path, "trade_date string, close string, note string, rank string", multi_line=True).first().close == "1.5"


def test_unknown_formats_and_missing_columns(spark):
    with pytest.raises(ValueError):
        tb.read_table(spark, "x.json")
    with pytest.raises(ValueError, match="close"):
        tb.market_table(spark.createDataFrame([("2024-01-02", 1.0)], "trade_date string, open double"))


def test_a_market_table_in_csv_feeds_the_features(spark, tmp_path):
    bars = spark.createDataFrame([("a\nb", date(2024, 1, 2 + i), 1.0 + i, 2.0 + i, 0.5, 1.5, 100.0) for i in range(3)],
                                 "symbol string, trade_date date, open double, high double, low double, close double, volume double")
    got = tb.load_market(spark, tb.write_table(bars, f"{tmp_path}/m.csv"))
    assert got.schema == bars.schema and got.where(F.col("symbol") == "a\nb").count() == 3
