"""Mixed timestamp normalisation by candidate explosion.

A stamp's text is matched once and cut at fixed places. Every stamp then becomes rows, one a candidate date: a slashed one is day-first and
month-first, every other form has one. Slashed stamps with a single possible candidate are counted by source as votes; where both
are possible and differ, the source's verdict ranks the two and the first stays, so each stamp leaves one row without
being grouped. Votes meet only such contested candidates, and a source that holds many of them is cut over salts
(`common.spread_join`), so one source with a third of the rows is no larger task. Nothing is collected but one sum.

Wall times without an offset are placed by their zone. What it skips or repeats takes the offset after the change: the
first guess is the time that the earlier offset gives; a skipped time shows a different offset there, a repeated one is also right
under the offset that holds a day later.

Forms, after white space is stripped at both ends: ten digits (epoch seconds), thirteen (milliseconds), and the date forms of DATE with an
optional time, AM or PM, and offset.

Edge cases: null, empty, impossible or other texts are bad; a wall time whose zone is null or unknown can't be placed and is bad too, and
does not vote; an offset makes the zone unimportant; a null source is a source of its own; slashed dates equal in both orders are plain and don't vote; repeated rows
each stay; columns other than the four are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, spread_join, table

SPACE = " \t\n\x0b\f\r"
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")
YEAR, TWO = "20[0-9][0-9]", "[0-9][0-9]"
#: y-m-d, ymd, d.m.y, d b y, and d/m/y or m/d/y; a group for each part.
DATE = f"(?:({YEAR})-({TWO})-({TWO})|({YEAR})({TWO})({TWO})|({TWO})[.]({TWO})[.]({YEAR})|({TWO}) ({'|'.join(MONTHS)}) ({YEAR})|({TWO})(/)({TWO})/({YEAR}))"
TIME = rf"(?:[T ]({TWO}):({TWO})(?::({TWO}))?(?: ?([AP])M)?(?: ?(Z|[+-]{TWO}:?{TWO}))?)?"
#: The parts of a text that matches, of whichever form: year, month, day, slash, hour, minute, second, half of the day, offset.
PARTS = "$1$4$9$12$16,$2$5$8$11$15,$3$6$7$10$13,$14,$17,$18,$19,$20,$21"
SECOND, MINUTE, DAY = 1_000_000, 60_000_000, 86_400_000_000
#: The other side needs more than this many times its votes.
LEAD = 1
#: A zone is tried at this instant, to see if there is one of that name.
KNOWN = "2024-01-01 00:00:00"


def zone_offset(utc_us: Column, zone: Column) -> Column:
    """Microseconds that the zone's wall clock is ahead of UTC at an instant."""
    return F.unix_micros(F.from_utc_timestamp(F.timestamp_micros(utc_us), zone)) - utc_us


def _date(year: str, month: str, day: str) -> Column:
    """Days since 1970-01-01; null where there is no such date. Every fourth year from 2000 to 2099 is a leap year."""
    days = F.get(F.array(*[F.lit(n) for n in (0, 31, 29, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)]), F.col(month)) - F.when((F.col(month) == 2) & (F.col(year) % 4 != 0), 1).otherwise(0)
    return F.when(F.col(month).between(1, 12) & F.col(day).between(1, days), F.unix_date(F.make_date(year, month, day)))


def parsed(stamps: DataFrame) -> DataFrame:
    """stamp_id, source, zone, epoch_us, time_us (since midnight), offset_us (null without one), slashed, first_day and second_day: days of the candidates, day-first (or only) and month-first.

    Each step is a projection of few expressions that uses the one before it: in one piece they outgrow what the JVM compiles.
    """
    rows = stamps.select("stamp_id", "source", "zone", F.btrim("raw", F.lit(SPACE)).alias("t"))
    rows = rows.select("*", F.regexp_replace("t", rf"\A{DATE}{TIME}\z", PARTS).alias("parts"), F.when(F.col("t").rlike(r"\A(?:[0-9]{10}|[0-9]{13})\z"), F.col("t").cast("long")).alias("number"))
    epoch = F.col("number") * F.when(F.char_length("t") == 10, SECOND).otherwise(1000)
    # a text that matches has no comma, and its parts have some
    rows = rows.select("stamp_id", "source", "zone", epoch.alias("epoch_us"), F.split(F.when(F.col("number").isNull() & (F.col("parts") != F.col("t")), F.col("parts")), ",").alias("parts"))
    part = lambda i: F.get("parts", i)
    # an empty text is null before it is cast: a cast that fails costs an exception in the JVM, even where it gives null
    number = lambda text: F.when(F.char_length(text) > 0, text).cast("int")
    names = {"year": 0, "day": 2, "hour": 4, "minute": 5, "second": 6}
    whole = rows.select("stamp_id", "source", "zone", "epoch_us", *[number(part(i)).alias(n) for n, i in names.items()], part(1).alias("month"), (part(3) == "/").alias("slashed"), part(7).alias("half"), F.replace(part(8), F.lit(":")).alias("offset"))
    month = F.when(F.char_length("month") == 2, F.col("month").cast("int")).otherwise(F.array_position(F.array(*map(F.lit, MONTHS)), F.col("month")).cast("int"))
    rows = whole.withColumn("month", month)
    rows = rows.select("*", *[number(F.substr("offset", F.lit(at), F.lit(2))).alias(n) for n, at in (("ahead", 2), ("past", 4))])
    hour, half, offset = F.col("hour"), F.col("half"), F.col("offset")
    good = F.when(half == "", hour <= 23).otherwise(hour.between(1, 12)) & (F.col("minute") <= 59) & (F.coalesce("second", F.lit(0)) <= 59)
    hour = F.when(half == "", hour).otherwise(hour % 12 + F.when(half == "P", 12).otherwise(0))
    time = F.when(hour.isNull() & (F.col("year") > 0), 0).when(good, hour * 3600 + F.col("minute") * 60 + F.coalesce("second", F.lit(0)))
    moved = F.when(offset == "Z", 0).when((F.col("ahead") <= 14) & (F.col("past") <= 59), F.when(offset.startswith("-"), -1).otherwise(1) * (F.col("ahead") * 60 + F.col("past")))
    rows = rows.select("stamp_id", "source", "zone", "epoch_us", "year", "month", "day", "slashed", "offset", time.cast("long").alias("time"), moved.cast("long").alias("moved"))
    known = F.try_to_timestamp(F.concat(F.lit(KNOWN + " "), F.when(offset == "", F.col("zone"))), F.lit("yyyy-MM-dd HH:mm:ss VV")).isNotNull()
    rows = rows.withColumn("year", F.when(F.col("time").isNotNull() & (F.col("moved").isNotNull() | known), F.col("year")))
    second = F.when(F.col("slashed"), _date("year", "day", "month"))
    return rows.select("stamp_id", "source", "zone", "epoch_us", (F.col("time") * SECOND).alias("time_us"), (F.col("moved") * MINUTE).alias("offset_us"), F.coalesce("slashed", F.lit(False)).alias("slashed"), _date("year", "month", "day").alias("first_day"), second.alias("second_day"))


def candidates(stamps: DataFrame) -> DataFrame:
    """Rows of parsed stamps, one a candidate: month_first, day, and how many candidates the stamp has with different dates; a bad or epoch stamp is one row without a day."""
    first, second = F.col("first_day"), F.col("second_day")
    one = lambda month_first, day, choices: F.struct(F.lit(month_first).alias("month_first"), day.alias("day"), F.lit(choices).alias("choices"))
    explode = F.when(first.isNotNull() & second.isNotNull() & (first != second), F.array(one(False, first, 2), one(True, second, 2)))
    explode = explode.when(first.isNotNull(), F.array(one(False, first, 1))).when(second.isNotNull(), F.array(one(True, second, 1)))
    rows = stamps.withColumn("candidate", F.explode(explode.otherwise(F.array(one(False, F.lit(None).cast("int"), 0)))))
    single = F.col("slashed") & (F.col("candidate.choices") == 1) & ~F.coalesce(first == second, F.lit(False))
    return rows.select("stamp_id", "source", "zone", "epoch_us", "time_us", "offset_us", "candidate.*", single.alias("votes"))


def verdicts(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """source, month_first (null without a majority), n (contested candidates) of every source that has contested candidates."""
    votes = lambda month: F.count_if(F.col("votes") & (F.col("month_first") == month))
    counts = rows.groupBy("source").agg(votes(False).alias("day_votes"), votes(True).alias("month_votes"), F.count_if(F.col("choices") == 2).alias("n"))
    wins = F.when(F.col("month_votes") > LEAD * F.col("day_votes"), True).when(F.col("day_votes") > LEAD * F.col("month_votes"), False)
    return scratch.write(counts.filter("n > 0").select("source", wins.alias("verdict"), "n"), "verdicts")


def placed(rows: DataFrame) -> DataFrame:
    """stamp_id, utc_us, rule, ambiguous of the candidates that stayed."""
    wall, zone = F.col("wall_us"), F.col("zone")
    rows = rows.withColumn("wall_us", F.col("day").cast("long") * DAY + F.col("time_us"))
    local = wall.isNotNull() & F.col("offset_us").isNull()
    rows = rows.withColumn("guess_us", F.when(local, F.unix_micros(F.to_utc_timestamp(F.timestamp_micros(wall), zone))))
    guess = F.col("guess_us")
    rows = rows.select("*", F.when(local, zone_offset(guess, zone)).alias("there_us"), F.when(local, zone_offset(guess + DAY, zone)).alias("later_us"))
    there, later = F.col("there_us"), F.col("later_us")
    skipped = there != wall - guess
    repeated = ~skipped & (later != there) & (F.when(local, zone_offset(wall - later, zone)) == later)
    rows = rows.select("*", F.coalesce(skipped, F.lit(False)).alias("skipped"), F.coalesce(repeated, F.lit(False)).alias("repeated"))
    utc = F.when(F.col("epoch_us").isNotNull(), F.col("epoch_us")).when(F.col("offset_us").isNotNull(), wall - F.col("offset_us"))
    utc = utc.otherwise(wall - F.when(F.col("repeated"), later).otherwise(there))
    rule = F.when(F.col("epoch_us").isNotNull(), "epoch").when(F.col("day").isNull(), "bad").when(F.col("choices") == 1, "plain").when(F.col("verdict").isNull(), "default").otherwise("votes")
    return rows.select("stamp_id", utc.alias("utc_us"), rule.alias("rule"), ((F.col("choices") == 2) | F.col("skipped") | F.col("repeated")).alias("ambiguous"))


def normalised(stamps: DataFrame, scratch: Scratch) -> DataFrame:
    """stamp_id, utc_us, rule and ambiguous for every row of stamps (stamp_id, source, zone, raw)."""
    rows = candidates(parsed(stamps.select("stamp_id", "source", "zone", "raw")))
    contested = spread_join(rows.filter("choices = 2"), verdicts(rows, scratch), ["source"], "n")
    rank = F.when(F.col("month_first") == F.coalesce("verdict", F.lit(False)), 1).otherwise(2)
    settled = rows.filter("choices < 2").withColumn("verdict", F.lit(None).cast("boolean"))
    return placed(settled.unionByName(contested.filter(rank == 1).select(settled.columns)))


def op13_timestamp_normalisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalised(table(spark, sf_dir, "stamps"), Scratch(spark, "op13"))


def oracle() -> str:
    two, year, named = "([0-9][0-9])", "(20[0-9][0-9])", f"({'|'.join(MONTHS)})"
    full = f"^{DATE.replace('(', '(?:').replace('(?:?:', '(?:')}{TIME}$"
    part = lambda i, form=full: f"nullif(regexp_extract(t, '{form}', {i}), '')"
    dashed, digits, dotted, worded, slashed = (f"^{form}(?:[T ].*)?$" for form in (f"{year}-{two}-{two}", f"{year}{two}{two}", f"{two}[.]{two}[.]{year}", f"{two} {named} {year}", f"{two}/{two}/{year}"))
    date = lambda y, m, d: f"CASE WHEN {m}::INT BETWEEN 1 AND 12 AND {d}::INT >= 1 THEN try_cast({y} || '-' || lpad({m}, 2, '0') || '-' || {d} AS DATE) END"
    offset = lambda at: f"(epoch_us(timezone(zone, make_timestamptz({at}))) - {at})"
    months = ", ".join(f"'{m}'" for m in MONTHS)
    return f"""
WITH s AS (SELECT row_number() OVER () AS row_no, stamp_id, source, zone, trim(raw, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS t FROM stamps),
f AS (SELECT row_no, stamp_id, source, zone, CASE WHEN regexp_full_match(t, '[0-9]{{10}}|[0-9]{{13}}') THEN t END AS epoch, CASE WHEN regexp_matches(t, '{full}') THEN t END AS t FROM s),
p AS (SELECT * REPLACE (epoch IS NOT NULL AS epoch), epoch AS digits,
  coalesce({part(1, dashed)}, {part(1, digits)}, {part(3, dotted)}, {part(3, worded)}, {part(3, slashed)}) AS y,
  coalesce({part(2, dashed)}, {part(2, digits)}, {part(2, dotted)}, list_position([{months}], {part(2, worded)})::VARCHAR, {part(2, slashed)}) AS m,
  coalesce({part(3, dashed)}, {part(3, digits)}, {part(1, dotted)}, {part(1, worded)}, {part(1, slashed)}) AS d, {part(1, slashed)} IS NOT NULL AS slashed,
  {part(1)}::INT AS hh, {part(2)}::INT AS mi, coalesce({part(3)}::INT, 0) AS ss, {part(4)} AS half, replace({part(5)}, ':', '') AS o FROM f),
q AS (SELECT *, CASE WHEN hh IS NULL THEN 0 WHEN mi <= 59 AND ss <= 59 AND CASE WHEN half IS NULL THEN hh <= 23 ELSE hh BETWEEN 1 AND 12 END
    THEN (CASE WHEN half IS NULL THEN hh WHEN half = 'P' THEN hh % 12 + 12 ELSE hh % 12 END * 3600 + mi * 60 + ss) * 1000000::BIGINT END AS time_us,
  CASE WHEN o = 'Z' THEN 0 WHEN o[2:3]::INT <= 14 AND o[4:5]::INT <= 59 THEN CASE WHEN o[1] = '-' THEN -1 ELSE 1 END * (o[2:3]::INT * 60 + o[4:5]::INT) * 60000000::BIGINT END AS offset_us,
  {date("y", "m", "d")} AS first_day, CASE WHEN slashed THEN {date("y", "d", "m")} END AS second_day FROM p),
r AS (SELECT * REPLACE (CASE WHEN good THEN first_day END AS first_day, CASE WHEN good THEN second_day END AS second_day)
  FROM (SELECT *, NOT epoch AND time_us IS NOT NULL AND (o IS NULL OR offset_us IS NOT NULL) AND (o IS NOT NULL OR zone IS NOT NULL) AS good FROM q)),
v AS (SELECT source, count(*) FILTER (WHERE second_day IS NULL AND first_day IS NOT NULL) AS dv, count(*) FILTER (WHERE first_day IS NULL AND second_day IS NOT NULL) AS mv FROM r WHERE slashed GROUP BY source),
c AS (SELECT r.*, first_day IS NOT NULL AND second_day IS NOT NULL AND first_day <> second_day AS contested, coalesce(mv, 0) AS mv, coalesce(dv, 0) AS dv FROM r LEFT JOIN v ON r.source IS NOT DISTINCT FROM v.source),
w AS (SELECT *, CASE WHEN contested THEN CASE WHEN mv > dv THEN second_day ELSE first_day END ELSE coalesce(first_day, second_day) END AS day FROM c),
l AS (SELECT *, epoch_us(day::TIMESTAMP) + time_us AS wall FROM w),
g AS (SELECT *, CASE WHEN day IS NOT NULL AND o IS NULL THEN epoch_us(timezone(zone, make_timestamp(wall))) END AS guess FROM l),
h AS (SELECT *, CASE WHEN guess IS NOT NULL THEN {offset("guess")} END AS after, CASE WHEN guess IS NOT NULL THEN {offset(f"(guess - {DAY})")} END AS before FROM g)
SELECT stamp_id, CASE WHEN epoch THEN digits::BIGINT * CASE WHEN length(digits) = 10 THEN 1000000 ELSE 1000 END WHEN o IS NOT NULL THEN wall - offset_us ELSE wall - after END AS utc_us,
  CASE WHEN epoch THEN 'epoch' WHEN day IS NULL THEN 'bad' WHEN NOT contested THEN 'plain' WHEN mv = dv THEN 'default' ELSE 'votes' END AS rule,
  contested OR coalesce(after <> wall - guess, false) OR coalesce(before <> after AND {offset("(wall - before)")} = before, false) AS ambiguous
FROM h"""


QUERIES = {"op13_timestamp_normalisation": op13_timestamp_normalisation}
ORACLES = {"op13_timestamp_normalisation": oracle()}
