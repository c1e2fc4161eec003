"""Doorways with a large share of all calls, cut into runs by time, against windows over the doorway."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from placewise.operators import figures, places, select

LOADED = ("request_id long, local timestamp_ntz, door string, district string, community string, owner string, vehicle string, tow_flag string, tow_status string, "
          "latitude double, longitude double, kind string")  # fmt: skip
T0 = dt.datetime(2020, 1, 1)


@pytest.fixture
def ranges(spark):
    keys = ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")
    old = {k: spark.conf.get(k) for k in keys}
    spark.conf.set(keys[0], "false")
    spark.conf.set(keys[1], "12")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def calls(spark, n, seed=1):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        door = "1 HOT ST" if i % 2 else rnd.choice(["A", "B", "C", None])
        when = None if rnd.random() < 0.02 else T0 + dt.timedelta(days=rnd.choice([rnd.randint(0, 2000), 700]), seconds=rnd.choice([0, rnd.randint(0, 86399)]))
        flag, owner = rnd.choice([("Y", "towed"), ("N", "not_towed"), (None, "unknown")]), rnd.choice([None, "p", "q", "r"])
        out.append((i, when, door, rnd.choice(["1", "2", None]), rnd.choice(["c", None]), owner, rnd.choice([None, f"v{rnd.randint(0, 50)}"]), *flag,
                    rnd.choice([0.0, 44.0 + rnd.random(), None, 44.5]), rnd.choice([0.0, -63.0 - rnd.random(), -63.25]), rnd.choice(["x", "y", None])))
    return spark.createDataFrame(out, LOADED)


@pytest.mark.parametrize("by", [[], ["kind"]])
def test_runs_equal_windows(spark, ranges, by):
    df = calls(spark, 3000).cache()
    if by:
        df = df.filter("kind is not null")  # a selection has a name
    busy = spark.createDataFrame([("1 HOT ST", 1500), ("A", 1), ("not there", 9)], "door string, calls long")
    told = lambda rows: sorted(str({k: round(v, 9) if isinstance(v, float) else v for k, v in sorted(r.asDict().items())}) for r in rows.collect())
    for recur in (365, 1):
        assert told(places.with_gaps(df, recur, by, busy)) == told(places.with_gaps(df, recur, by))
        assert told(places.door_measures(df, recur, by=by, busy=busy)) == told(places.door_measures(df, recur, by=by))
        assert told(figures.recurrence_by_tow(figures.recurrence_flags(df, recur, by, busy), by)) == told(figures.recurrence_by_tow(figures.recurrence_flags(df, recur, by), by))
    assert told(places.doorways(df, by=by, busy=busy)) == told(places.doorways(df, by=by))


def test_no_task_holds_a_doorway_of_half_of_all_calls(spark, ranges):
    df = calls(spark, 1).limit(0).unionByName(
        spark.range(200_000).select(
            F.col("id").alias("request_id"), (F.lit(T0).cast("timestamp_ntz") + F.expr("make_dt_interval(0, 0, 0, id % 1000)")).alias("local"),
            F.when(F.col("id") % 2 == 0, "HOT").otherwise(F.concat(F.lit("d"), (F.col("id") % 999).cast("string"))).alias("door"),
            *[F.lit(None).cast("string").alias(c) for c in ("district", "community", "owner", "vehicle", "tow_flag")], F.lit("unknown").alias("tow_status"),
            F.lit(1.0).alias("latitude"), F.lit(1.0).alias("longitude"), F.lit("x").alias("kind"),
        )
    )
    busy = spark.createDataFrame([("HOT", 100_000)], "door string, calls long")
    hot = places.with_gaps(df, 365, [], busy).filter("door = 'HOT'")
    ordered = spark.read.parquet(*[p for p in hot.inputFiles() if "/ordered-" in p])
    sizes = sorted(r["n"] for r in ordered.groupBy(F.input_file_name()).agg(F.count("*").alias("n")).collect())
    assert sum(sizes) == 100_000 and len(sizes) >= 8 and sizes[-1] <= 2 * sizes[len(sizes) // 2]
    got = hot.agg(F.count("*"), F.max("seq"), F.count_distinct("seq"), F.count("gap_days")).first()
    assert tuple(got) == (100_000, 100_000, 100_000, 99_999)


def test_busy_doors_are_few(spark):
    rows = spark.createDataFrame([("1 a st, x",)] * 30 + [("1 A ST",)] * 5 + [("2 b st",)] * 20 + [(None,)] * 90, "address string")
    assert [tuple(r) for r in select.busy_doors(rows, 25).collect()] == [("1 A ST", 35)]
    assert select.busy_doors(rows).count() == select.busy_doors(rows.limit(0)).count() == 0
