"""Mixed timestamp formats and zones to one UTC instant per row.

Texts are parsed by column expressions into local wall time plus, where the text has one, a numeric offset or a zone name.
Wall times are then matched as of zone-offset intervals, exploded by zone and local year: two matching intervals mean an
ambiguous time (the earlier instant is taken), none a nonexistent one, one gives the offset directly.
"""

from __future__ import annotations

import datetime as dt
import zoneinfo

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vinculum.session import materialise

SECOND = 1_000_000
DAY = 86_400 * SECOND

#: Hours from UTC of the zone abbreviations that are understood.
ABBREVIATIONS = {
    "UTC": 0.0, "GMT": 0.0, "Z": 0.0, "IST": 5.5, "NPT": 5.75, "GST": 4.0, "EST": -5.0, "EDT": -4.0,
    "CST": -6.0, "CDT": -5.0, "MST": -7.0, "MDT": -6.0, "PST": -8.0, "PDT": -7.0,
    "WET": 0.0, "WEST": 1.0, "CET": 1.0, "CEST": 2.0, "EET": 2.0, "EEST": 3.0, "BST": 1.0,
    "AEST": 10.0, "AEDT": 11.0, "ACST": 9.5, "ACDT": 10.5, "AWST": 8.0, "SGT": 8.0, "JST": 9.0, "HKT": 8.0,
}
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]

_CLOCK = r"(?:(?:[T ]\s*|,\s+)(\d{1,2})(?::(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?)?)?"
_HALF = r"\s*([AaPp]\.?[Mm]\.?(?![A-Za-z]))?"
_ZONE = r"\s*(Z|[+-]\d{1,2}(?::?\d{2})?|\[[A-Za-z_+\-/0-9]+\]|[A-Za-z]+(?:/[A-Za-z_+\-0-9]+)*)?"
#: Nine groups each: three of the date, four of the clock, the half of the day, the zone.
_DATE_FIRST_YEAR = rf"^(\d{{4}})[-/.](\d{{1,2}})[-/.](\d{{1,2}}){_CLOCK}{_HALF}{_ZONE}$"
_COMPACT = r"^(\d{4})(\d{2})(\d{2})(?:[T ]?(\d{2})(?:(\d{2})(?:(\d{2})(?:[.,](\d{1,9}))?)?)?)?" + _HALF + _ZONE + "$"
_NUMERIC = rf"^(\d{{1,4}})[-/.](\d{{1,2}})[-/.](\d{{1,4}}){_CLOCK}{_HALF}{_ZONE}$"
_NAMED = r"^(?:[A-Za-z]{3,9},?\s+)?(\d{1,2})[-\s]([A-Za-z]{3})[a-z]*\.?[-,\s]\s*(\d{2}|\d{4})" + _CLOCK + _HALF + _ZONE + "$"
_MONTH_FIRST = r"^(?:[A-Za-z]{3,9},?\s+)?([A-Za-z]{3})[a-z]*\.?\s+(\d{1,2}),?\s+(\d{4})" + _CLOCK + _HALF + _ZONE + "$"
_DIGITS = r"^-?(?:\d{10}|\d{13}|\d{16})$"


def _groups(text: Column, pattern: str, n: int) -> Column:
    """All groups of a whole-string match as an array, by one run of the pattern."""
    return F.split(F.regexp_replace(text, pattern, "\u0001".join(f"${k}" for k in range(1, n + 1))), "\u0001")


def _long(value: Column) -> Column:
    return value.try_cast("bigint")


def zone_intervals(zones: list[str], first_year: int = 1800, last_year: int = 2437) -> list[tuple[str, int, int, int, int]]:
    """(zone, local year, local start, local end, offset seconds) of each offset interval of each zone.

    Offsets are probed every four weeks and changes located to the second. A year that an interval touches in local time holds
    it, so a wall time finds all its intervals under its own year. The first interval is open to the past.
    Unknown zones give no rows.
    """
    rows = []
    epoch = dt.datetime(1970, 1, 1, tzinfo=dt.UTC)
    lo = int((dt.datetime(first_year, 1, 1, tzinfo=dt.UTC) - epoch).total_seconds())
    hi = int((dt.datetime(last_year + 1, 1, 1, tzinfo=dt.UTC) - epoch).total_seconds())
    for name in sorted(set(zones)):
        try:
            zone = zoneinfo.ZoneInfo(name)
        except (zoneinfo.ZoneInfoNotFoundError, ValueError, OSError):
            continue

        def offset(at: int, zone=zone) -> int:
            return int(dt.datetime.fromtimestamp(at, zone).utcoffset().total_seconds())

        cuts, at = [(lo, offset(lo))], lo
        while at < hi:
            step = min(at + 28 * 86_400, hi)
            if offset(step) != offset(at):
                a, b = at, step
                while b - a > 1:
                    mid = (a + b) // 2
                    a, b = (mid, b) if offset(mid) == offset(a) else (a, mid)
                cuts.append((b, offset(b)))
            at = step
        for k, (start, off) in enumerate(cuts):
            end = cuts[k + 1][0] if k + 1 < len(cuts) else hi
            local_start, local_end = start + off, end + off
            day = dt.date(1970, 1, 1) + dt.timedelta(seconds=local_start)
            last = dt.date(1970, 1, 1) + dt.timedelta(seconds=local_end - 1)
            begin = -(2**62) if k == 0 else local_start * SECOND
            rows += [(name, y, begin, local_end * SECOND, off) for y in range(day.year, last.year + 1)]
    return rows


def parse_wall(df: DataFrame, text: str, order: str | None, abbreviations: dict[str, float] | None = None) -> DataFrame:
    """Add ``_local`` (microseconds of wall time), ``_offset`` (seconds, if the text fixes it), ``_zone`` (zone name in the text)
    and ``_year`` (local year). ``order`` is a column DMY, MDY or YMD for all-number dates; null or None means DMY. ``abbreviations`` replaces
    the hours from UTC of zone abbreviations, of which some stand for several zones."""
    t = F.trim(F.regexp_replace(F.col(text), r"(?U)\s+", " "))
    df = df.withColumn("_t", t)
    t = F.col("_t")
    order_col = F.upper(F.coalesce(F.col(order), F.lit("DMY"))) if order else F.lit("DMY")
    # the text's first signs choose the one pattern that is then matched
    kind = (
        F.when(t.rlike(_DIGITS), "epoch")
        .when(t.rlike(r"^\d{4}[-/.]"), F.when(t.rlike(r"^\d{4}[-/.]\d{1,2}[-/.]\d{1,2}(?!\d)"), "ymd").otherwise("numeric"))
        .when(t.rlike(r"^\d{8}"), "compact")
        .when(t.rlike(r"^\d{1,3}[-/.]\d"), "numeric")
        .when(t.rlike(r"^(?:[A-Za-z]{3,9},?\s+)?[A-Za-z]{3,9}\.?\s+\d{1,2},?\s+\d{4}"), "month")
        .otherwise("named")
    )
    df = df.withColumn("_kind", kind)
    k = F.col("_kind")
    df = df.withColumn(
        "_g",
        F.when(k == "ymd", _groups(t, _DATE_FIRST_YEAR, 9))
        .when(k == "compact", _groups(t, _COMPACT, 9))
        .when(k == "numeric", _groups(t, _NUMERIC, 9))
        .when(k == "named", _groups(t, _NAMED, 9))
        .when(k == "month", _groups(t, _MONTH_FIRST, 9)),
    )
    df = df.withColumn("_g", F.when(F.size("_g") == 9, F.col("_g")))  # no match leaves the text in one piece
    g = [F.try_element_at(F.col("_g"), F.lit(i)) for i in range(1, 10)]
    numeric, named, turned = k == "numeric", k == "named", k == "month"
    year = F.when(numeric, F.when(order_col == "YMD", g[0]).otherwise(g[2])).when(named | turned, g[2]).otherwise(g[0])
    month_no = F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(F.when(turned, g[0]).otherwise(g[1])))
    month = F.when(numeric & (order_col == "MDY"), _long(g[0])).when(named | turned, F.nullif(month_no, F.lit(0).cast("bigint"))).otherwise(_long(g[1]))
    day = F.when(numeric, F.when(order_col == "DMY", g[0]).when(order_col == "MDY", g[1]).otherwise(g[2])).when(named, g[0]).when(turned, g[1]).otherwise(g[2])
    year = F.when(F.length(year) == 2, F.concat(F.lit("20"), year)).when(F.length(year) == 4, year)
    day = F.when(F.length(day) <= 2, day)
    date = F.try_to_date(F.concat_ws("-", year, F.lpad(month.cast("string"), 2, "0"), F.lpad(day, 2, "0")), "yyyy-MM-dd")
    date = F.when(year.isNotNull() & month.isNotNull() & day.isNotNull(), date)
    hour, half = F.coalesce(_long(g[3]), F.lit(0)), F.lower(F.substring(g[7], 1, 1))
    hour = (
        F.when(F.coalesce(half, F.lit("")) == "", F.when(hour <= 23, hour))
        .when((hour < 1) | (hour > 12), None)
        .otherwise(hour % 12 + F.when(half == "p", 12).otherwise(0))
    )
    minute, second = F.coalesce(_long(g[4]), F.lit(0)), F.coalesce(_long(g[5]), F.lit(0))
    micros = _long(F.substring(F.rpad(g[6], 6, "0"), 1, 6))
    clock = F.when((minute <= 59) & (second <= 59), ((hour * 60 + minute) * 60 + second) * SECOND + F.coalesce(micros, F.lit(0)))
    zone = g[8]
    zone = F.when(zone != "", F.regexp_replace(zone, r"[\[\]]", ""))
    hours, minutes = F.regexp_extract(zone, r"^[+-](\d{1,2})", 1), F.regexp_extract(zone, r"^[+-]\d{1,2}:?(\d{2})$", 1)
    sign = F.when(zone.startswith("-"), -1).otherwise(1)
    numeric_offset = sign * (_long(hours) * 3600 + F.coalesce(_long(minutes), F.lit(0)) * 60)
    abbreviation = F.create_map(*[F.lit(x) for a, h in (abbreviations or ABBREVIATIONS).items() for x in (a, int(h * 3600))])
    offset = F.when(k == "epoch", 0).when(zone.rlike(r"^[+-]\d"), numeric_offset).otherwise(F.try_element_at(abbreviation, F.upper(zone)))
    size = F.length(F.regexp_replace(t, "^-", ""))
    raw = _long(t)
    epoch = F.when(size == 10, raw * SECOND).when(size == 13, raw * 1000).otherwise(raw)
    return (
        df.withColumn("_date", date)
        .withColumn("_local", F.when(k == "epoch", epoch).otherwise(F.datediff("_date", F.lit(dt.date(1970, 1, 1))).cast("bigint") * DAY + clock))
        .withColumn("_offset", offset)
        .withColumn("_zone", F.when((k != "epoch") & F.col("_offset").isNull(), zone))
        .withColumn("_year", F.year("_date"))
        .drop("_g", "_kind", "_t", "_date")
    )


def normalise_instants(
    df: DataFrame, text: str, zone: str | None = None, order: str | None = None, abbreviations: dict[str, float] | None = None
) -> DataFrame:
    """Add ``instant_us`` BIGINT (UTC microseconds), ``instant`` TIMESTAMP and ``instant_status`` to each row.

    ``text`` is the column with the time text, ``zone`` a column with the row's zone (UTC where null or None), ``order`` one
    with the order of all-number dates. Status: ``ok``; ``ambiguous`` (wall time occurs twice, the earlier instant is given);
    ``nonexistent`` (skipped by a clock change or zone unknown, instant null); ``unreadable`` (null, empty or no valid time,
    instant null). All rows and columns are kept, repeated rows too; an empty table gives an empty one. Columns of the input
    named as the three new ones are replaced; helper names begin with ``_`` and must be free. Years are those of four digits.

    The interval table has one entry per known zone and year of 1800 to 2437, a bound that doesn't depend on the data,
    and is broadcast. Earlier times lie in each zone's first interval; later ones are looked up a multiple of 400 years before,
    after which the calendar and the rules of clock changes repeat.
    """
    spark = df.sparkSession
    df = df.drop("instant_us", "instant", "instant_status")
    parsed = parse_wall(df, text, order, abbreviations)
    cycles = F.greatest(F.ceil((F.col("_year") - F.lit(2437)) / F.lit(400.0)), F.lit(0)).cast("int")
    parsed = parsed.withColumn("_shift", F.coalesce(cycles, F.lit(0)) * F.lit(146_097 * DAY)).withColumn("_year", F.greatest(F.col("_year") - cycles * 400, F.lit(1800)))
    home = F.coalesce(F.col(zone), F.lit("UTC")) if zone else F.lit("UTC")
    parsed = parsed.withColumn("_zone", F.when(F.col("_offset").isNull(), F.coalesce("_zone", home)))
    names = F.regexp_extract(F.trim(F.col(text)), r"([A-Za-z]+/[A-Za-z_+\-/0-9]+)\]?$", 1).alias("z")
    in_text = df.filter(F.col(text).contains("/")).select(names).filter("z <> ''")
    used = in_text.union(df.select(F.col(zone).alias("z"))) if zone else in_text
    # distinct names that are no zones could be many; only those of the zone database come to the driver
    known = zoneinfo.available_timezones()
    zones = [r.z for r in used.distinct().filter(F.col("z").isin(*sorted(known))).collect()]
    table = spark.createDataFrame(
        zone_intervals([*zones, "UTC"]), "_zone string, _year int, _from bigint, _to bigint, _off bigint"
    )
    table = table.groupBy("_zone", "_year").agg(F.collect_list(F.struct("_from", "_to", "_off")).alias("_spans"))
    joined = parsed.join(F.broadcast(table), ["_zone", "_year"], "left")
    at = F.col("_local") - F.col("_shift")
    hits = F.filter("_spans", lambda s: (s["_from"] <= at) & (at < s["_to"]))
    joined = joined.withColumn("_hits", F.transform(hits, lambda s: F.col("_local") - s["_off"] * SECOND))
    found = F.coalesce(F.size("_hits"), F.lit(0))
    fixed = F.col("_offset").isNotNull()
    us = F.when(fixed, F.col("_local") - F.col("_offset") * SECOND).when(found > 0, F.array_min("_hits"))
    status = (
        F.when(F.col("_local").isNull(), "unreadable")
        .when(fixed | (found == 1), "ok")
        .when(found > 1, "ambiguous")
        .otherwise("nonexistent")
    )
    return joined.select(*df.columns, us.alias("instant_us"), F.timestamp_micros(us).alias("instant"), status.alias("instant_status"))


def same_instant_pairs(df: DataFrame, record: str, text: str, row: str) -> DataFrame:
    """Pairs (row_a, row_b) of rows with equal non-null ``record`` and equal instant whose texts differ; row_a < row_b.

    Input is the output of ``normalise_instants``; its few columns are written once to the shared folder, as three plans read
    them. Groups in which all texts are equal are sorted out by a partial aggregation before anything is joined, so a group of
    copies costs nothing.
    """
    rows = df.filter(F.col(record).isNotNull() & F.col("instant_us").isNotNull()).select(
        F.col(record).alias("_r"), "instant_us", F.col(text).alias("_x"), F.col(row).alias("_row")
    )
    rows = materialise(rows)
    keys = rows.groupBy("_r", "instant_us").agg(F.min("_x").alias("_lo"), F.max("_x").alias("_hi")).filter("_lo <> _hi").select("_r", "instant_us")
    rows = rows.join(keys, ["_r", "instant_us"], "left_semi")
    a = rows.select("_r", "instant_us", F.col("_x").alias("_xa"), F.col("_row").alias("row_a"))
    b = rows.select("_r", "instant_us", F.col("_x").alias("_xb"), F.col("_row").alias("row_b"))
    return a.join(b, ["_r", "instant_us"]).filter("row_a < row_b and _xa <> _xb").select("row_a", "row_b")
