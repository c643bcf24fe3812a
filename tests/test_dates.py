from datetime import date

from pyspark.sql import functions as F

from tenure.functions import dates


def _numbers(rows, t, stamps):
    df = rows("ts timestamp_ntz", [(s,) for s in stamps])
    return [r[0] for r in df.select(dates.week_number(F.col("ts"), t)).collect()]


def test_week_numbers_at_a_sunday_start_at_minus_one(rows):
    stamps = ["2017-11-05 10:00:00", "2017-11-06 00:00:00", "2017-12-31 00:00:00"]
    assert _numbers(rows, "2017-12-31", stamps) == [-1, 0, 7]
    assert dates.week_numbers("2017-12-31") == list(range(-1, 8))


def test_week_numbers_at_a_wednesday_start_at_zero(rows):
    stamps = ["2017-11-08 00:00:00", "2017-11-13 00:00:00", "2018-01-03 00:00:00"]
    assert _numbers(rows, "2018-01-03", stamps) == [0, 1, 8]
    assert dates.week_numbers("2018-01-03") == list(range(0, 9))


def test_every_day_of_the_lookback_has_a_listed_number(spark):
    for t in ("2018-01-01", "2018-01-03", "2018-01-06", "2018-01-07"):
        days = spark.range(57).select(
            F.date_sub(dates.snapshot_date(t), F.col("id").cast("int")).cast("timestamp_ntz").alias("ts")
        )
        found = {r[0] for r in days.select(dates.week_number(F.col("ts"), t)).collect()}
        assert found == set(dates.week_numbers(t))
        offsets = {r[0] for r in days.select(dates.week_offset(F.col("ts"), t, 8)).collect()}
        assert offsets == set(range(len(found)))


def test_months_clamp_at_the_end(spark):
    row = spark.range(1).select(dates.shifted("2017-12-31", months=2), dates.shifted("2018-04-01", years=-1)).first()
    assert str(row[0]) == "2018-02-28 00:00:00"
    assert str(row[1]) == "2017-04-01 00:00:00"


def test_previous_week_is_the_complete_week_before_the_snapshot_week():
    assert dates.previous_week("2018-04-01") == date(2018, 3, 19)
    assert dates.previous_week("2018-04-02") == date(2018, 3, 26)
    assert dates.previous_week("2018-04-04") == date(2018, 3, 26)


def test_unreadable_dates_become_null(rows):
    df = rows("x string", [("2018-02-03",), ("soon",), (None,), ("2018-13-01",)])
    found = [r[0] for r in df.select(dates.parse_date(F.col("x"))).collect()]
    assert found == [date(2018, 2, 3), None, None, None]


def test_results_do_not_depend_on_the_session_zone(spark, rows):
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
    try:
        df = rows("ts timestamp_ntz", [("2024-01-01 00:00:00",), ("2023-12-31 23:59:59",)])
        found = [r[0] for r in df.select(dates.week_start(F.col("ts"))).collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert found == [date(2024, 1, 1), date(2023, 12, 25)]
