"""Timestamps against a reading with the standard library, and their SQL."""

import itertools
import re
from datetime import UTC, datetime, timedelta
from zoneinfo import ZoneInfo

import pytest

from lodestone.llm import timestamps
from lodestone.llm.common import Scratch

from .support import agrees

FORMS = {
    "y-m-d": r"(?P<y>20\d\d)-(?P<m>\d\d)-(?P<d>\d\d)", "ymd": r"(?P<y>20\d\d)(?P<m>\d\d)(?P<d>\d\d)", "d.m.y": r"(?P<d>\d\d)\.(?P<m>\d\d)\.(?P<y>20\d\d)",
    "dby": r"(?P<d>\d\d) (?P<b>Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec) (?P<y>20\d\d)", "slash": r"(?P<d>\d\d)/(?P<m>\d\d)/(?P<y>20\d\d)",
}
TIME = r"(?:[T ](?P<H>\d\d):(?P<M>\d\d)(?::(?P<S>\d\d))?(?: ?(?P<half>[AP])M)?(?: ?(?P<o>Z|[+-]\d\d:?\d\d))?)?"
EPOCH = datetime(1970, 1, 1, tzinfo=UTC)


def micros(t):
    return (t - EPOCH) // timedelta(microseconds=1)


def read(row):
    """None, an epoch value, or ({order: wall time}, offset, zone)."""
    t = None if row[3] is None else row[3].strip(" \t\n\x0b\f\r")
    if t is not None and re.fullmatch("[0-9]{10}|[0-9]{13}", t):
        return int(t) * (10**6 if len(t) == 10 else 1000)
    for form, pattern in FORMS.items():
        if t is not None and (m := re.fullmatch(pattern + TIME, t, re.ASCII)):
            g = m.groupdict()
            month = "JanFebMarAprMayJunJulAugSepOctNovDec".index(g["b"]) // 3 + 1 if "b" in g else int(g["m"])
            hour, minute, second = (int(g[x] or 0) for x in "HMS")
            if g["half"] and not 1 <= hour <= 12:
                return None
            hour = hour % 12 + 12 * (g["half"] == "P") if g["half"] else hour
            offset = None
            if g["o"]:
                o = g["o"].replace(":", "").replace("Z", "+0000")
                if int(o[1:3]) > 14 or int(o[3:]) > 59:
                    return None
                offset = timedelta(hours=int(o[1:3]), minutes=int(o[3:])) * (-1 if o[0] == "-" else 1)
            walls = {}
            for order, (a, b) in {"day": (month, int(g["d"])), "month": (int(g["d"]), month)}.items():
                if order == "day" or form == "slash":
                    try:
                        walls[order] = datetime(int(g["y"]), a, b, hour, minute, second)
                    except ValueError:
                        pass
            try:
                zone = ZoneInfo(row[2]) if offset is None else None
            except Exception:
                return None
            return (walls, offset, zone, form == "slash") if walls else None
    return None


def place(wall, offset, zone):
    if offset is not None:
        return micros(wall.replace(tzinfo=UTC) - offset), False
    before, after = (wall.replace(tzinfo=zone, fold=f).utcoffset() for f in (0, 1))
    # in a gap fold=1 has the offset before the change too
    back = lambda o: (wall - o).replace(tzinfo=UTC).astimezone(zone).utcoffset()
    if before == after:
        return micros(wall.replace(tzinfo=UTC) - after), False
    skipped = back(before) != before and back(after) != after
    return micros(wall.replace(tzinfo=UTC) - (before if skipped and before > after else after if not skipped else max(before, after))), True


def plain(rows):
    seen, votes = [read(r) for r in rows], {}
    for r, x in zip(rows, seen):
        if isinstance(x, tuple) and x[3] and len(x[0]) == 1:
            votes.setdefault(r[1], []).append(next(iter(x[0])))
    out = []
    for r, x in zip(rows, seen):
        if not isinstance(x, tuple):
            out.append((r[0], x, "bad" if x is None else "epoch", False))
            continue
        walls, own = x[0], votes.get(r[1], [])
        rule, order = "plain", next(iter(walls))
        if len(set(walls.values())) == 2:
            day, month = own.count("day"), own.count("month")
            rule, order = "default" if day == month else "votes", "month" if month > day else "day"
        utc, odd = place(walls[order], *x[1:3])
        out.append((r[0], utc, rule, rule in ("votes", "default") or odd))
    return sorted(out, key=str)


DATES = ["2024-02-29", "2023-02-29", "2024-02-30", "2100-02-29", "2000-02-29", "20240229", "20241301", "29.02.2024", "31.04.2024", "05 Nov 2024", "05 nov 2024", "31 Nov 2024", "05/06/2024", "13/06/2024", "06/13/2024", "13/13/2024", "07/07/2024", "00/05/2024", "5/6/2024", "1999-01-01", "2024-1-01", "2024/01/01"]
TIMES = ["", "T00:00", " 23:59:59", " 24:00", " 12:60", " 12:00:60", " 12:30 AM", " 12:30PM", " 00:30 AM", " 13:00 PM", "T01:02:03Z", " 01:02 +05:30", " 01:02-0800", " 01:02+14:59", " 01:02+15:00", " 01:02+05:60", " 11:59:58 PM -03:30", " 01:02 am", "T", " 1:02", " 01:02Z ", "  01:02", " 01:02 AM PM"]
WALLS = [  # skipped and repeated ones, by an hour, by half of one, by three, and by a day
    ("America/New_York", "2024-03-10 01:59:59"), ("America/New_York", "2024-03-10 02:00"), ("America/New_York", "2024-03-10 02:30"), ("America/New_York", "2024-03-10 03:00"), ("America/New_York", "2024-11-03 00:59:59"), ("America/New_York", "2024-11-03 01:00"),
    ("America/New_York", "2024-11-03 01:59:59"), ("America/New_York", "2024-11-03 02:00"), ("Europe/Berlin", "31.03.2024 02:15"), ("Europe/Berlin", "27.10.2024 02:15:01"), ("Europe/Berlin", "27 Oct 2024 03:00"), ("Australia/Lord_Howe", "2024-04-07 01:45"),
    ("Australia/Lord_Howe", "2024-10-06 02:15"), ("Pacific/Apia", "2011-12-30 12:00"), ("Antarctica/Casey", "2010-03-05 00:30"), ("Asia/Kolkata", "2024-03-10 02:30"), ("UTC", "2024-03-10 02:30"), ("America/New_York", "03/10/2024 02:30"), ("Nowhere/Land", "2024-03-10 02:30"), (None, "2024-03-10 02:30"), (None, "2024-03-10 02:30Z"), ("Nowhere/Land", "1710000000"),
]


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "stamp_id long, source string, zone string, raw string, rule string, day int").repartition(3)


def check(spark, rows):
    got = timestamps.normalised(table(spark, rows), Scratch(spark, "t"))
    assert got.columns == ["stamp_id", "utc_us", "rule", "ambiguous"]
    assert sorted([tuple(r) for r in got.collect()], key=str) == plain(rows)


def test_forms_equal_a_plain_reading(spark):
    texts = ["".join(x) for x in itertools.product(DATES, TIMES)] + [None, "", " \t", "1704067454", " 1704067454123\r\n", "17040674541", "0000000000", "9999999999999", "١٧٠٤٠٦٧٤٥٤", "2024-01-01\n00:00", "2024-01-01 00:00\nx", "05  Nov 2024", "20240105T10:00", "x" * 300_000]
    check(spark, [(i, f"s{i % 4}" if i % 5 else None, ("UTC", "Europe/Berlin", "Asia/Kolkata")[i % 3], t) for i, t in enumerate(texts)])


def test_wall_times_that_zones_skip_or_repeat(spark):
    rows = [(i, "s", z, t) for i, (z, t) in enumerate(WALLS)]
    check(spark, rows)
    told = {r["stamp_id"]: r for r in timestamps.normalised(table(spark, rows), Scratch(spark, "t")).collect()}
    at = lambda i: EPOCH + timedelta(microseconds=told[i]["utc_us"])
    assert at(2) == datetime(2024, 3, 10, 6, 30, tzinfo=UTC) and told[2]["ambiguous"] and told[2]["rule"] == "plain"  # 02:30 at -4
    assert at(5) == datetime(2024, 11, 3, 6, 0, tzinfo=UTC) and told[5]["ambiguous"]  # 01:00 at -5
    assert told[18]["rule"] == told[19]["rule"] == "bad" and told[20]["rule"] == "plain" and told[21]["rule"] == "epoch"


@pytest.mark.parametrize("hot", [0, 4000])
def test_votes_by_source(spark, hot):
    many = lambda source, day, month: [(source, "25/03/2024")] * day + [(source, "03/25/2024")] * month + [(source, "05/06/2024"), (source, "06/06/2024")]
    rows = many("day", 3, 2) + many("month", 2, 3) + many("tie", 2, 2) + many("none", 0, 0) + many(None, 0, 1) + many("", 1, 0) + [("hot", "04/05/2024 02:30")] * hot + [("hot", "05/31/2024 24:00"), ("hot", "05/31/2024")]
    rows = [(i, s, "UTC", t) for i, (s, t) in enumerate(rows)]
    check(spark, rows + rows[:5])


def test_empty_table(spark):
    assert timestamps.normalised(table(spark, [(1, "s", "UTC", "x")]).limit(0), Scratch(spark, "t")).count() == 0


def test_query_equals_its_sql(spark, duck):
    agrees(spark, duck, "op13_timestamp_normalisation", "/root/testdata/sf0.001")
