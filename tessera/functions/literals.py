"""Canonical forms of typed literals, as column expressions."""

from __future__ import annotations

from collections.abc import Callable, Mapping

import pyspark.sql.functions as F
from pyspark.sql import Column

XSD = "http://www.w3.org/2001/XMLSchema#"

#: The datatypes whose literals are held as integers.
INTEGER_TYPES = (
    "integer", "nonPositiveInteger", "negativeInteger", "long", "int", "short", "byte",
    "nonNegativeInteger", "unsignedLong", "unsignedInt", "unsignedShort", "unsignedByte", "positiveInteger",
)


def _decimal(lex: Column) -> Column:
    """No plus, no needless zeros, no bare point; zero has no sign."""
    sign = F.when(lex.startswith("-"), "-").otherwise("")
    whole = F.regexp_replace(F.regexp_extract(lex, r"^[+-]?(\d*)", 1), "^0+", "")
    rest = F.regexp_replace(F.regexp_extract(lex, r"\.(\d*)$", 1), "0+$", "")
    number = F.concat(F.when(whole == "", "0").otherwise(whole), F.when(rest == "", "").otherwise(F.concat(F.lit("."), rest)))
    return F.when(number == "0", "0").otherwise(F.concat(sign, number))


def _once(value: Column, function: Callable[[Column], Column]) -> Column:
    return F.element_at(F.transform(F.array(value), function), 1)


def _div(a: Column, by: int) -> Column:
    """Whole quotient, without going through a double."""
    return F.call_function("div", a, F.lit(by))


_WHOLE = r"^(-?(?:[1-9]\d{4,17}|\d{4}))-(\d\d)-(\d\d)T(\d\d:[0-5]\d:[0-5]\d)(?:\.(\d+))?(Z|[+-](?:(?:0\d|1[0-3]):[0-5]\d|14:00))?$"
#: Calendar types: what the beginning of a lexical form is replaced by to make it a whole dateTime, whose further parts mean nothing, and the parts that it has.
CALENDAR = {
    "dateTime": ("^", "", "ymdc"),
    "dateTimeStamp": ("^", "", "ymdc"),
    "time": ("^", "2000-01-01T", "c"),
    "date": (r"^(-?\d{4,}-\d\d-\d\d)", "$1T00:00:00", "ymd"),
    "gYear": (r"^(-?\d{4,})", "$1-01-01T00:00:00", "y"),
    "gYearMonth": (r"^(-?\d{4,}-\d\d)", "$1-01T00:00:00", "ym"),
    "gMonth": (r"^--(\d\d)", "2000-$1-01T00:00:00", "m"),
    "gDay": (r"^---(\d\d)", "2000-01-$1T00:00:00", "d"),
    "gMonthDay": (r"^--(\d\d-\d\d)", "2001-$1T00:00:00", "md"),  # of no year: of one that isn't leap
}


def days_in(year: Column, month: Column) -> Column:
    """Days of a month of the calendar that goes on before 1582 as after it, and has a year 0."""
    leap = (F.pmod(year, F.lit(4)) == 0) & ((F.pmod(year, F.lit(100)) != 0) | (F.pmod(year, F.lit(400)) == 0))
    return F.when(month == 2, F.when(leap, 29).otherwise(28)).when(month.isin(4, 6, 9, 11), 30).when(month.between(1, 12), 31)


def whole_time(lex: Column, kinds: Mapping[str, Column]) -> Column:
    """The whole dateTime that a calendar value begins, kinds: by type, whether the value is of it."""
    found = F.lit(None).cast("string")
    for kind, of in kinds.items():
        pattern, instead, _ = CALENDAR[kind]
        found = F.when(of, F.regexp_replace(lex, pattern, instead) if instead else lex).otherwise(found)
    return found


def time_parts(whole: Column) -> Column:
    """A struct of a dateTime: `year`, `month`, `day`, `clock`, `fraction` without trailing zeros, `zone`; null for what is none or names no real time."""

    def read(t: Column) -> Column:
        part = lambda i: F.regexp_extract(t, _WHOLE, i)
        number = lambda i: F.nullif(part(i), F.lit("")).try_cast("bigint")
        return F.when(t.rlike(_WHOLE) & ~F.startswith(t, F.lit("-0000")), F.struct(number(1).alias("year"), number(2).alias("month"), number(3).alias("day"), part(4).alias("clock"), F.rtrim(part(5), F.lit("0")).alias("fraction"), part(6).alias("zone")))

    def real(p: Column) -> Column:
        last = (p.clock == "24:00:00") & (p.fraction == "")
        return F.when((p.day >= 1) & (p.day <= days_in(p.year, p.month)) & (F.length(p.fraction) <= 18) & (last | (p.clock < "24")), p)

    return _once(_once(whole, read), real)


def _written_year(year: Column) -> Column:
    return F.concat(F.when(year < 0, "-").otherwise(""), F.when(F.abs(year) < 10_000, F.lpad(F.abs(year).cast("string"), 4, "0")).otherwise(F.abs(year).cast("string")))


def _calendar(lex: Column, kinds: Mapping[str, Column]) -> Column:
    """No trailing zeros of the fraction, a zero offset as `Z`, hour 24 as the next day's start; null for what names nothing real."""

    def written(p: Column) -> Column:
        two = lambda c: F.lpad(c.cast("string"), 2, "0")
        zone = F.when(p.zone.isin("+00:00", "-00:00"), "Z").otherwise(p.zone)
        over = p.clock == "24:00:00"
        ends = over & (p.day == days_in(p.year, p.month))
        day = two(F.when(ends, 1).otherwise(p.day + over.cast("int")))
        month = two(F.when(ends, p.month % 12 + 1).otherwise(p.month))
        year = _written_year(p.year + (ends & (p.month == 12)).cast("int"))
        clock = F.concat(F.when(over, "00:00:00").otherwise(p.clock), F.when(p.fraction == "", "").otherwise(F.concat(F.lit("."), p.fraction)))
        forms = {"ymdc": F.concat(year, F.lit("-"), month, F.lit("-"), day, F.lit("T"), clock), "c": clock, "ymd": F.concat_ws("-", year, month, day), "y": year, "ym": F.concat_ws("-", year, month), "m": F.concat(F.lit("--"), month), "d": F.concat(F.lit("---"), day), "md": F.concat(F.lit("--"), month, F.lit("-"), day)}
        head = F.lit(None).cast("string")
        for kind, of in kinds.items():
            head = F.when(of, forms[CALENDAR[kind][2]]).otherwise(head)
        return F.when(p.isNotNull(), F.concat(head, zone))

    return _once(time_parts(whole_time(lex, kinds)), written)


def _positional(text: Column) -> Column:
    """A number written `d.dddE±x` or `ddd.ddd` without exponent, needless zeros or point."""

    def spelled(p: Column) -> Column:
        shift = p.exponent - F.length(p.rest)  # places that the digits lie left of the point
        digits = F.concat(p.whole, p.rest)
        n = F.length(digits)
        wide = F.when(shift >= 0, F.concat(digits, F.repeat(F.lit("0"), shift))).otherwise(F.lpad(digits, F.greatest(n, 1 - shift), "0"))
        cut_at = F.length(wide) + F.least(shift, F.lit(0))
        whole = F.ltrim(F.substring(wide, F.lit(1), cut_at), F.lit("0"))
        rest = F.rtrim(F.when(shift < 0, F.substring(wide, cut_at + 1, -shift)).otherwise(""), F.lit("0"))
        return F.concat(p.sign, F.when(whole == "", "0").otherwise(whole), F.when(rest == "", "").otherwise(F.concat(F.lit("."), rest)))

    part = lambda i: F.regexp_extract(text, r"^(-?)(\d+)(?:\.(\d+))?(?:E(-?\d+))?$", i)
    return _once(F.struct(part(1).alias("sign"), part(2).alias("whole"), part(3).alias("rest"), F.coalesce(F.nullif(part(4), F.lit("")), F.lit("0")).try_cast("int").alias("exponent")), spelled)


def _float(lex: Column, single: Column) -> Column:
    """A double, or where `single` a float, in the fewest digits that read back as it, without exponent; infinite ones as `INF`.

    Java's digits read back, but are sometimes one more than needed: a last digit goes where what is left, rounded, reads back too.
    """
    read = lambda text: F.when(single, text.try_cast("float").cast("double")).otherwise(text.try_cast("double"))
    text = lambda v: F.when(single, v.cast("float").cast("string")).otherwise(v.cast("string"))

    def less(p: Column) -> Column:
        fewer = F.array(*(F.struct(m.alias("m"), (p.e + 1).alias("e"), p.v.alias("v")) for m in (_div(p.m + 5, 10), _div(p.m, 10), _div(p.m, 10) + 1)))  # the nearest first
        return F.coalesce(F.get(F.filter(fewer, lambda q: read(F.concat(q.m.cast("string"), F.lit("E"), q.e.cast("string"))) == F.abs(q.v)), F.lit(0)), p)

    def digits(v: Column) -> Column:
        part = lambda i: F.regexp_extract(text(F.abs(v)), r"^(\d+)\.(\d+)(?:E(-?\d+))?$", i)
        exponent = F.coalesce(F.nullif(part(3), F.lit("")), F.lit("0")).try_cast("int") - F.length(part(2))
        return F.struct(F.concat(part(1), part(2)).try_cast("bigint").alias("m"), exponent.alias("e"), v.alias("v"))

    def spelt(p: Column) -> Column:
        sign = F.when(F.startswith(p.v.cast("string"), F.lit("-")), "-").otherwise("")
        number = _positional(F.concat(sign, p.m.cast("string"), F.lit("E"), p.e.cast("string")))
        return F.when(F.abs(p.v) < float("inf"), number).when(p.v.isNotNull(), F.when(p.v > 0, "INF").otherwise("-INF"))

    value = F.when(lex.rlike(r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"), read(lex))
    finite = _once(_once(_once(_once(value, digits), less), less), spelt)
    return F.when(lex.isin("INF", "+INF"), "INF").when(lex.isin("-INF", "NaN"), lex).otherwise(finite)


_DURATION = r"^(-?)P(?=.)(?:(\d+)Y)?(?:(\d+)M)?(?:(\d+)D)?(?:T(?=.)(?:(\d+)H)?(?:(\d+)M)?(?:(\d+)(?:\.(\d+))?S)?)?$"


def _duration(lex: Column, kind: Column) -> Column:
    """A duration as years and months, and days, hours, minutes and seconds, each less than one of the next; null beyond 64 bits or for parts that its type hasn't."""

    def total(t: Column) -> Column:
        part = lambda i: F.coalesce(F.nullif(F.regexp_extract(t, _DURATION, i), F.lit("")), F.lit("0"))
        number = lambda i: part(i).try_cast("bigint")
        months = F.try_add(F.try_multiply(number(2), F.lit(12)), number(3))
        seconds = F.try_add(F.try_add(F.try_multiply(number(4), F.lit(86_400)), F.try_multiply(number(5), F.lit(3600))), F.try_add(F.try_multiply(number(6), F.lit(60)), number(7)))
        return F.struct(F.regexp_extract(t, _DURATION, 1).alias("sign"), months.alias("months"), seconds.alias("seconds"), F.rtrim(F.regexp_extract(t, _DURATION, 8), F.lit("0")).alias("fraction"))

    def written(d: Column) -> Column:
        some = lambda n, sign: F.when(n > 0, F.concat(n.cast("string"), F.lit(sign))).otherwise("")
        years, days, hours, minutes = (_div(n, by) for n, by in ((d.months, 12), (d.seconds, 86_400), (d.seconds % 86_400, 3600), (d.seconds % 3600, 60)))
        second = d.seconds % 60
        exact = F.when((second > 0) | (d.fraction != ""), F.concat(second.cast("string"), F.when(d.fraction == "", "").otherwise(F.concat(F.lit("."), d.fraction)), F.lit("S"))).otherwise("")
        clock = F.concat(some(hours, "H"), some(minutes, "M"), exact)
        text = F.concat(some(years, "Y"), some(d.months % 12, "M"), some(days, "D"), F.when(clock == "", "").otherwise(F.concat(F.lit("T"), clock)))
        none = F.when(kind == XSD + "yearMonthDuration", "P0M").otherwise("PT0S")
        fits = d.months.isNotNull() & d.seconds.isNotNull() & (F.length(d.fraction) <= 18)
        return F.when(fits, F.when(text == "", none).otherwise(F.concat(d.sign, F.lit("P"), text)))

    other = F.when(kind == XSD + "yearMonthDuration", lex.rlike("[DT]")).when(kind == XSD + "dayTimeDuration", lex.rlike("^[^T]*[YM]")).otherwise(False)
    return F.when(lex.rlike(_DURATION) & ~other, _once(total(lex), written))


_DURATIONS = ("duration", "dayTimeDuration", "yearMonthDuration")


def canonical(lex: Column, datatype: Column | str) -> Column:
    """A struct `lex, datatype` of a literal as it is held: integers of any kind within 64 bits as integers without needless zeros,
    decimals of at most 18 fractional and 20 whole digits, booleans as words, doubles and floats in the fewest digits, calendar values that name real days and times with a short fraction and
    zone, durations with each part less than one of the next. What can't be read, and any other datatype, stays as written. A datatype given as its name in XML Schema makes a smaller plan.
    """
    one = datatype if isinstance(datatype, str) else None
    of = F.lit(XSD + one) if one else datatype
    may = lambda *names: one is None or one in names
    is_a = lambda *names: of.isin(*(XSD + n for n in names))
    found, integer = [], F.lit(None).cast("string")
    if may(*INTEGER_TYPES):
        integer = F.when(is_a(*INTEGER_TYPES) & lex.rlike(r"^[+-]?\d+$"), lex.try_cast("bigint").cast("string"))
        found.append(integer)
    if may("decimal"):
        decimal = F.when(is_a("decimal") & lex.rlike(r"^[+-]?(\d+(\.\d*)?|\.\d+)$"), _decimal(lex))
        found.append(F.when(decimal.rlike(r"^-?\d{1,20}(\.\d{1,18})?$"), decimal))
    if may("boolean"):
        found.append(F.when(is_a("boolean"), F.when(lex.isin("true", "1"), "true").when(lex.isin("false", "0"), "false")))
    if may("double", "float"):
        found.append(F.when(is_a("double", "float"), _float(lex, is_a("float"))))
    if may(*CALENDAR):
        calendar = _calendar(lex, {kind: is_a(kind) for kind in CALENDAR if may(kind)})
        found.append(calendar)
    if may(*_DURATIONS):
        found.append(F.when(is_a(*_DURATIONS), _duration(lex, of)))
    stamp = (is_a("dateTimeStamp") & calendar.isNotNull()) if may("dateTimeStamp") else F.lit(False)
    return F.struct(F.coalesce(*found, lex).alias("lex"), F.when(integer.isNotNull(), XSD + "integer").when(stamp, XSD + "dateTime").otherwise(of).alias("datatype"))


def instant_key(lex: Column, datatype: Column) -> Column:
    """UTC text of the start of a dateTime or date, without a zone as if in UTC, with 18 fractional digits: sorts as the instants do, to the last digit. Null for anything else, what isn't real, and years outside 1 to 9999."""

    def moved(p: Column) -> Column:
        sign = F.when(F.startswith(p.zone, F.lit("-")), -1).otherwise(1)
        offset = F.when(p.zone.isin("", "Z"), 0).otherwise(sign * (F.substring(p.zone, 2, 2).try_cast("int") * 60 + F.substring(p.zone, 5, 2).try_cast("int")))
        hours, minutes, seconds = (F.substring(p.clock, k, 2).try_cast("int") for k in (1, 4, 7))
        near = F.when(p.year.between(0, 10_000), p.year.cast("int"))
        days = F.datediff(F.make_date(near, p.month.cast("int"), p.day.cast("int")), F.lit("1970-01-01").cast("date"))
        at = days.cast("bigint") * 86_400 + hours * 3600 + minutes * 60 + seconds - offset * 60
        written = lambda x: F.concat(F.date_format(F.timestamp_seconds(x), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("."), F.rpad(p.fraction, 18, "0"))
        return _once(at, lambda x: F.when((x >= -62_135_596_800) & (x < 253_402_300_800), written(x)))

    return _once(time_parts(whole_time(lex, {k: datatype == XSD + k for k in ("dateTime", "date")})), moved)


def day_key(lex: Column, datatype: Column) -> Column:
    """The day of a real dateTime or date as it is written, its zone ignored; null for anything else."""
    there = time_parts(whole_time(lex, {k: datatype == XSD + k for k in ("dateTime", "date")})).isNotNull()
    return F.when(there, F.regexp_extract(lex, r"^(-?\d{4,}-\d\d-\d\d)", 1))
