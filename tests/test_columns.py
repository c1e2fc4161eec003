"""Column expressions on literals."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from placewise.functions import columns as C


def one(spark, col, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return df.select(col).first()[0]


@pytest.mark.parametrize(
    ("raw", "want"),
    [(" 12  main\tst,  Halifax, B3K", "12 MAIN ST"), ("a b ", "A B"), (",x", None), ("", None), (None, None)],
)
def test_clean_address(spark, raw, want):
    assert one(spark, C.clean_address(F.col("a")), a=raw) == want


def test_street(spark):
    for raw, want in [("12 MAIN ST", "MAIN ST"), ("12A MAIN ST & OAK ST", "MAIN ST"), ("MAIN ST", "MAIN ST"), ("12 & 14", None)]:
        assert one(spark, C.street_of(F.col("a")), a=raw) == want


def test_vehicle(spark):
    key = C.vehicle_key(F.col("a"), F.col("b"), F.col("c"))
    assert tuple(one(spark, key, a=" ford ", b="F ", c="red")) == ("FORD", "F", "RED")
    assert one(spark, key, a="", b=" ", c="") is None


def test_local_time_across_daylight_saving(spark):
    at = lambda s: one(spark, C.to_local(F.col("t").cast("timestamp_ntz")), t=s)
    assert at("2024-03-10 05:59:00") == dt.datetime(2024, 3, 10, 1, 59)
    assert at("2024-03-10 06:00:00") == dt.datetime(2024, 3, 10, 3, 0)
    assert at("2024-11-03 04:30:00") == dt.datetime(2024, 11, 3, 1, 30) == at("2024-11-03 05:30:00")


def test_epoch(spark):
    assert one(spark, F.date_format(C.epoch_to_utc(F.col("m")), "yyyy-MM-dd HH:mm:ss.SSS"), m="1700000000123") == "2023-11-14 22:13:20.123"
    assert one(spark, C.epoch_to_utc(F.col("m")), m="") is None
    assert one(spark, C.epoch_ms(C.epoch_to_utc(F.col("m"))), m=1700000000123) == 1700000000123


def test_text(spark):
    assert [one(spark, C.title_case(F.col("x")), x=x) for x in ("O'NEILL ST 7TH", "12-14 ÉCOLE ST")] == ["O'Neill St 7Th", "12-14 École St"]
    assert [one(spark, C.slug(F.col("x")), x=x) for x in ("No Stopping (here)!", "***")] == ["no-stopping-here", "type"]
    assert one(spark, C.utc_iso(F.col("x").cast("timestamp_ntz")), x="2024-01-02 03:04:05.5") == "2024-01-02T03:04:05.500000+00:00"


def test_numbers(spark):
    assert one(spark, C.percent(F.col("a"), F.col("b"), 0), a=2413, b=2528) == 95
    assert one(spark, C.percent(F.col("a"), F.col("b")), a=1, b=0) is None
    assert one(spark, C.per_thousand(F.col("a"), F.col("b")), a=5, b=0) is None
    assert one(spark, C.elapsed_minutes(F.lit("2024-01-01").cast("timestamp_ntz"), F.lit("2024-01-01 00:01:30").cast("timestamp_ntz"))) == 1.5
    assert one(spark, C.tow_status(F.col("a")), a=None) == "unknown"
