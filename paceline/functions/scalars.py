"""Scalar column functions of the training domain. All stay inside the JVM except where noted."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(x: Column, digits: int = 0) -> Column:
    """Round half towards plus infinity: the same in every engine, unlike ``round`` on binary ties."""
    scale = float(10**digits)
    return F.floor(x * scale + 0.5) / scale


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is worked out once, however often ``f`` reads it: the value is bound to a lambda's variable."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is zero or null."""
    return a / F.nullif(b, F.lit(0.0))


def exact_mean(value: Column, digits: int = 6) -> Column:
    """Mean by an exact sum, values taken to ``digits`` decimals: the same whatever the order of the rows."""
    return F.sum(value.cast(f"decimal(18,{digits})")).cast("double") / F.count(value)


def percent_change(now: Column, before: Column) -> Column:
    return ratio((now - before) * 100.0, before)


def present(x: Column) -> Column:
    """Zero and null both mean missing in activity measures."""
    return F.coalesce(x, F.lit(0)) != 0


def sport_category(sport: Column) -> Column:
    return F.when(sport.rlike("(?i)run"), "run").when(sport.rlike("(?i)swim"), "swim").when(sport.rlike("(?i)ride|bike|cycling"), "bike")


def week_start(day: Column) -> Column:
    """The Monday of the week."""
    return F.date_trunc("week", day).cast("date")


def week_label(day: Column) -> Column:
    """Year and number of the week that begins on the day's Monday, counted in sevens from the first of January of the Monday's year; not the ISO number."""
    monday = week_start(day)
    number = F.ceil((F.datediff(monday, F.trunc(monday, "year")) + 1) / 7)
    return F.concat(F.year(monday).cast("string"), F.lit("-W"), F.lpad(number.cast("string"), 2, "0"))


def trend(metric: Column, change: Column) -> Column:
    """``better``, ``worse`` or ``same``: less is better for pace and heart rate, more for everything else."""
    good = F.when(metric.isin("pace", "hr"), change < 0).otherwise(change > 0)
    return F.when(change == 0, "same").when(good, "better").when(change.isNotNull(), "worse")


def hour_bucket(hour: Column) -> Column:
    return F.when(hour < 6, "night").when(hour < 12, "morning").when(hour < 18, "afternoon").otherwise("evening")


def season(month: Column) -> Column:
    """0 for December to February, then by quarters of the year."""
    return F.floor(F.pmod(month, F.lit(12)) / 3).cast("int")


def clock(seconds: Column) -> Column:
    """h:mm:ss, or m:ss below an hour."""
    s = F.floor(seconds + 0.5).cast("long")
    h, m, r = F.floor(s / 3600), F.floor(F.pmod(s, F.lit(3600)) / 60), F.pmod(s, F.lit(60))
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    return F.when(h > 0, F.concat_ws(":", h.cast("string"), two(m), two(r))).otherwise(F.concat_ws(":", m.cast("string"), two(r)))


def pace_text(minutes: Column) -> Column:
    """Minutes per kilometre as m:ss, seconds carried over at sixty."""
    s = F.floor(minutes * 60 + 0.5).cast("long")
    return F.concat_ws(":", F.floor(s / 60).cast("string"), F.lpad(F.pmod(s, F.lit(60)).cast("string"), 2, "0"))


def oxygen_cost(metres_per_minute: Column) -> Column:
    return -4.60 + 0.182258 * metres_per_minute + 0.000104 * metres_per_minute * metres_per_minute


def oxygen_share(minutes: Column) -> Column:
    """Share of VO2max that can be held for so many minutes."""
    return 0.8 + 0.1894393 * F.exp(-0.012778 * minutes) + 0.2989558 * F.exp(-0.1932605 * minutes)


def vdot(distance: Column, seconds: Column) -> Column:
    minutes = seconds / 60.0
    return oxygen_cost(distance / minutes) / oxygen_share(minutes)


def vdot_time(score: Column, metres: Column, steps: int = 50) -> Column:
    """Seconds for a distance at a VDOT: Newton's method with a numeric derivative, as a fold over a fixed number of steps."""

    def miss(t: Column) -> Column:
        return oxygen_cost(metres / t) / oxygen_share(t) - score

    def step(t: Column, _: Column) -> Column:
        slope = (miss(t + 0.001) - miss(t)) / 0.001
        return F.when(F.abs(slope) < 1e-10, t).otherwise(F.greatest(F.lit(0.1), t - miss(t) / slope))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), metres / 1000.0 * 4.5, step)
    return F.when(score > 0, found * 60.0)


def riegel(seconds: Column, metres: Column, target: Column, exponent: float = 1.06) -> Column:
    return seconds * F.pow(target / metres, F.lit(exponent))


def bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a, b, d = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    y = F.sin(d) * F.cos(b)
    x = F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(d)
    return F.pmod(F.degrees(F.atan2(y, x)) + 360.0, F.lit(360.0))


def wind_relation(route: Column, wind_from: Column) -> Column:
    d = F.pmod(F.abs(route - F.pmod(wind_from + 180.0, F.lit(360.0))), F.lit(360.0))
    off = F.when(d > 180, 360.0 - d).otherwise(d)
    return F.when(off.isNull(), "unknown").when(off <= 45, "tail").when(off >= 135, "head").otherwise("cross")


#: Names of the months in seven languages, without accents.
MONTHS = {
    "jan": 1, "january": 1, "enero": 1, "ene": 1, "janvier": 1, "janv": 1, "janeiro": 1, "gennaio": 1,
    "feb": 2, "february": 2, "febrero": 2, "fevrier": 2, "fevr": 2, "fevereiro": 2, "febbraio": 2,
    "mar": 3, "march": 3, "marzo": 3, "mars": 3,
    "apr": 4, "april": 4, "abril": 4, "avr": 4, "avril": 4,
    "may": 5, "mayo": 5, "mai": 5, "maggio": 5,
    "jun": 6, "june": 6, "junio": 6, "juin": 6, "giugno": 6,
    "jul": 7, "july": 7, "julio": 7, "juillet": 7, "luglio": 7,
    "aug": 8, "august": 8, "agosto": 8, "aout": 8, "ago": 8,
    "sep": 9, "sept": 9, "september": 9, "septiembre": 9, "setembro": 9, "septembre": 9, "settembre": 9,
    "oct": 10, "october": 10, "octubre": 10, "outubro": 10, "octobre": 10, "ottobre": 10,
    "nov": 11, "november": 11, "noviembre": 11, "novembro": 11, "novembre": 11,
    "dec": 12, "december": 12, "diciembre": 12, "dezembro": 12, "decembre": 12, "dicembre": 12,
}


def loose_day(text: Column, as_of: Column) -> Column:
    """A day written as year-month-day, day/month/year (month first where only that can be), or with a month's name in one of seven languages, before or after
    the day, with or without a year; separators may be ``.``, ``/`` or ``-``, two digits are a year of this century. Without a year it is that of ``as_of``, or the
    one before if the day would lie more than 30 days ahead. Null for anything else and for days that don't exist."""
    iso, numeric = r"^(\d{4})[./-](\d{1,2})[./-](\d{1,2})", r"^(\d{1,2})[./-](\d{1,2})[./-](\d{2,4})$"
    month_first, day_first = r"^([a-z]+) (\d{1,2})(?:,? ?(\d{4}))?$", r"^(\d{1,2}) ([a-z]+)(?: (\d{4}))?$"
    months = F.create_map(*(x for k, v in MONTHS.items() for x in (F.lit(k), F.lit(v))))
    number = lambda source, pattern, k: F.nullif(F.regexp_extract(source, pattern, k), F.lit("")).cast("int")
    some = lambda y, m, d, held: F.when(held, F.struct(y.alias("y"), m.alias("m"), d.alias("d")))

    def day(y: Column, m: Column, d: Column) -> Column:
        return F.to_date(F.try_to_timestamp(F.concat_ws("-", F.lpad(y.cast("string"), 4, "0"), F.lpad(m.cast("string"), 2, "0"), F.lpad(d.cast("string"), 2, "0")), F.lit("yyyy-MM-dd")))

    def slashed(n: Column) -> Column:
        turned, year = (n[0] <= 12) & (n[1] > 12), F.when(n[2] < 100, n[2] + 2000).otherwise(n[2])
        return some(year, F.when(turned, n[0]).otherwise(n[1]), F.when(turned, n[1]).otherwise(n[0]), n[2].isNotNull())

    def spelt(source: Column, pattern: str, name: int, nth: int) -> Column:
        return bound(F.try_element_at(months, F.regexp_extract(source, pattern, name)), lambda m: some(number(source, pattern, 3), m, number(source, pattern, nth), m.isNotNull()))

    def read(t: Column) -> Column:
        named = F.replace(folded(t), F.lit("."), F.lit(""))
        return F.coalesce(
            bound(F.array(*(number(t, iso, k) for k in (1, 2, 3))), lambda n: some(n[0], n[1], n[2], n[0].isNotNull())), bound(F.array(*(number(t, numeric, k) for k in (1, 2, 3))), slashed),
            bound(named, lambda s: spelt(s, month_first, 1, 2)), bound(named, lambda s: spelt(s, day_first, 2, 1)),
        )

    def resolved(p: Column) -> Column:
        """Without a year, that of ``as_of`` or the one before."""
        guess = bound(day(F.year(as_of), p["m"], p["d"]), lambda g: F.when(F.datediff(g, as_of) > 30, day(F.year(as_of) - 1, p["m"], p["d"])).otherwise(g))
        return F.when(p.isNotNull(), F.when(p["y"].isNotNull(), day(p["y"], p["m"], p["d"])).otherwise(guess))

    return bound(bound(F.trim(F.regexp_replace(text, r"\s+", " ")), read), resolved)


def loose_number(text: Column) -> Column:
    """A number written with decimal comma or point, thousands separators and units around it; null if none."""
    s = F.regexp_replace(text, r"[^0-9,.\-]", "")
    s = F.when(s.contains(",") & s.contains("."), F.when(F.instr(F.reverse(s), ",") < F.instr(F.reverse(s), "."), F.replace(F.replace(s, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).otherwise(F.replace(s, F.lit(","), F.lit("")))).otherwise(F.replace(s, F.lit(","), F.lit(".")))
    return s.try_cast("double")


def loose_range(text: Column) -> Column:
    """``low, high`` of two numbers with a dash between."""
    n = F.transform(F.regexp_extract_all(text, F.lit(r"([0-9]+(?:[.,][0-9]+)?)"), F.lit(1)), loose_number)
    a, b = F.get(n, F.lit(0)), F.get(n, F.lit(1))
    return F.struct(F.least(a, b).alias("low"), F.greatest(a, b).alias("high"))


def folded(text: Column) -> Column:
    """Lower case, trimmed, Latin accents dropped."""
    accented, plain = "áàâäãåéèêëíìîïóòôöõúùûüñçýÿ", "aaaaaaeeeeiiiiooooouuuuncyy"
    return F.translate(F.lower(F.trim(text)), accented, plain)


def decoded_polyline(line: Column) -> Column:
    """Vertices of an encoded polyline (five-bit groups, zig-zag deltas, five decimals) as array<struct<lat, lon>>.

    A fold over the characters: the state holds the value being read, the running pair and the vertices.
    """
    codes = F.transform(F.filter(F.split(line, ""), lambda c: c != ""), lambda c: F.ascii(c) - 63)
    start = F.struct(
        F.lit(0).cast("long").alias("value"), F.lit(0).alias("shift"), F.lit(0).alias("which"), F.lit(0).cast("long").alias("lat"), F.lit(0).cast("long").alias("lon"),
        F.array().cast("array<struct<lat:double,lon:double>>").alias("out"),
    )

    def step(s: Column, c: Column) -> Column:
        value = s["value"] + (c.bitwiseAND(31)).cast("long") * F.pow(F.lit(2.0), s["shift"]).cast("long")
        more = c >= 32
        delta = F.when(value % 2 == 1, -(value + 1) / 2).otherwise(value / 2).cast("long")
        lat = F.when(~more & (s["which"] == 0), s["lat"] + delta).otherwise(s["lat"])
        lon = F.when(~more & (s["which"] == 1), s["lon"] + delta).otherwise(s["lon"])
        done = ~more & (s["which"] == 1)
        out = F.when(done, F.concat(s["out"], F.array(F.struct((lat / 1e5).alias("lat"), (lon / 1e5).alias("lon"))))).otherwise(s["out"])
        return F.struct(
            F.when(more, value).otherwise(F.lit(0).cast("long")).alias("value"), F.when(more, s["shift"] + 5).otherwise(0).alias("shift"),
            F.when(more, s["which"]).otherwise(1 - s["which"]).alias("which"), lat.alias("lat"), lon.alias("lon"), out.alias("out"),
        )

    return F.aggregate(codes, start, step, lambda s: s["out"])


def resampled(series: Column, n: int) -> Column:
    """An array at ``n`` evenly spaced places, linear between neighbours; a null or empty array gives null."""
    last = F.size(series) - 1
    at = lambda i: F.element_at(series, i.cast("int") + 1)

    def value(i: Column) -> Column:
        x = i * last / F.lit(max(1, n - 1))
        low = F.floor(x)
        high = F.least(low + 1, last)
        return at(low) + (at(high) - at(low)) * (x - low)

    return F.when(F.size(series) > 0, F.transform(F.sequence(F.lit(0), F.lit(n - 1)), value))
