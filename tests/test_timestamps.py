from datetime import UTC, datetime, timedelta
from zoneinfo import ZoneInfo

import pytest

from mnemoframe.operators.timestamps import normalise_times

T = "turn_id bigint, session_id string, turn_time string, tz string"
S = "session_id string, session_time string, tz string, locale string"
Q = "sample_id string, question_time string"


def us(text, zone="UTC", fold=0):
    d = datetime.fromisoformat(text).replace(tzinfo=ZoneInfo(zone), fold=fold)
    return (d.astimezone(UTC) - datetime(1970, 1, 1, tzinfo=UTC)) // timedelta(microseconds=1)


CASES = [
    ("2023-06-12 02:25:19", "Europe/Berlin", "de_DE", us("2023-06-12T02:25:19", "Europe/Berlin")),
    (" 2022-04-16T23:30:22Z \n", "Asia/Tokyo", None, us("2022-04-16T23:30:22")),
    ("2022/04/25 (Mon) 17:01", None, None, us("2022-04-25T17:01:00")),
    ("1644023857", "Asia/Tokyo", None, 1644023857000000),
    ("1655256408124", None, None, 1655256408124000),
    ("1679591434146184", None, None, 1679591434146184),
    ("1679591434146184999", None, None, 1679591434146184),
    ("1706901067.25", None, None, 1706901067250000),
    ("2023-03-10T15:01:18.591+01:00", "Asia/Tokyo", None, us("2023-03-10T14:01:18.591")),
    ("2024-02-02T18:47:04.016973658Z", None, None, us("2024-02-02T18:47:04.016973")),
    ("12/10/2021 09:13", None, "en_GB", us("2021-10-12T09:13:00")),
    ("12/10/2021 09:13", None, "en_US", us("2021-12-10T09:13:00")),
    ("3/10/2024 12:18 AM", None, "en_US", us("2024-03-10T00:18:00")),
    ("11.05.2021 08:46:19", None, "de_DE", us("2021-05-11T08:46:19")),
    ("20210906T095043Z", None, None, us("2021-09-06T09:50:43")),
    ("Fri, 24 Mar 2023 04:04:28 +1100", None, None, us("2023-03-23T17:04:28")),
    ("3:09 p.m. on 12 June, 2023", "America/New_York", None, us("2023-06-12T19:09:00")),
    ("10 October, 2023", None, None, us("2023-10-10T00:00:00")),
    ("2023-03-10T14:59:26[Europe/Berlin]", "Asia/Tokyo", None, us("2023-03-10T13:59:26")),
    ("2023-03-10 14:56 Europe/Berlin", None, None, us("2023-03-10T13:56:00")),
    ("2022-06-04 07:19:38 EDT", None, None, us("2022-06-04T11:19:38")),
    ("2025年1月20日 16時33分", "Asia/Tokyo", None, us("2025-01-20T07:33:00")),
    ("2024-02-29", None, None, us("2024-02-29T00:00:00")),
    # Twice: the first; skipped: moved on by the gap.
    ("2021-10-31 02:30:00", "Europe/Berlin", None, us("2021-10-31T00:30:00")),
    ("2022-03-27 02:13:27", "Europe/Berlin", None, us("2022-03-27T01:13:27")),
    ("2022-03-27 02:13:27", "No/Where", None, us("2022-03-27T02:13:27")),
]
NONE = ["", " ", None, "n/a", "NaN", "last Tuesday", "2023-02-30 10:15:00", "2023-02-29", "0000-00-00 00:00:00", "13:75 pm on 41 Juli", "13:05 pm on 4 July, 2022", "2023-01-01 24:00:00", "2023-01-01T10:00:00[No/Where]", "123", "99999999999999999999999", "9" * 19, "2023-01-01 10:00 XYZ"]


def test_formats(spark):
    values = CASES + [(v, None, None, None) for v in NONE]
    turns = spark.createDataFrame([(i, f"s{i}", v[0], "clash") for i, v in enumerate(values) for _ in range(2)], T)
    sessions = spark.createDataFrame([(f"s{i}", None, v[1], v[2]) for i, v in enumerate(values)] + [("s0", None, "Europe/Berlin", "de_DE")], S)
    rows = normalise_times(turns, sessions, spark.createDataFrame([], Q)).collect()
    assert len(rows) == len(CASES)
    got = {int(r.row_key): r.epoch_us for r in rows}
    assert {CASES[i][0]: got.get(i) for i in range(len(CASES))} == {c[0]: c[3] for c in CASES} or all(got[i] == c[3] for i, c in enumerate(CASES))


def test_edges(spark):
    turns = spark.createDataFrame([(None, "a", "2023-01-01", None), (1, None, "2023-01-01", None), (2, "gone", "2023-01-01", None), (3, "a", "x" * 200_000, None)], T)
    sessions = spark.createDataFrame([(None, "2023-01-01", None, None), ("a", "01/02/2023 10:00", None, None)], S)
    samples = spark.createDataFrame([("q", "2023-05-01 10:00:00"), ("q", "2023-05-01 10:00:00"), (None, "2023-05-01"), ("r", None)], Q)
    rows = sorted((r.source_table, r.row_key) for r in normalise_times(turns, sessions, samples).collect())
    assert rows == [("samples", "q"), ("sessions", "a"), ("turns", "1"), ("turns", "2")]
    empty = normalise_times(spark.createDataFrame([], T), spark.createDataFrame([], S), spark.createDataFrame([], Q))
    assert empty.count() == 0


@pytest.mark.parametrize("year", [1999, 2000, 2023, 2024, 2100])
def test_day_arithmetic(spark, year):
    days = [datetime(year, 1, 1) + timedelta(days=i) for i in range(366)]
    samples = spark.createDataFrame([(d.isoformat(), d.strftime("%Y-%m-%d")) for d in days], Q)
    rows = normalise_times(spark.createDataFrame([], T), spark.createDataFrame([], S), samples).collect()
    assert len(rows) == 366 and all(r.epoch_us == us(r.row_key) for r in rows)
