"""Dates and times: date Columns inside, serial numbers of the 1900 system at the edge."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quadrille.functions.registry import known, scalar

_L = F.lit
#: Serial 60 is a day that never was, 29 February 1900; later serials count from here.
_EPOCH = "1899-12-30"


def _dated(serial: Column, day: Column) -> Column:
    """The serial, which remembers the date it was made from, so that date functions need not convert it back."""
    serial.__dict__["_day"] = F.when(day >= F.to_date(_L("1899-12-31")), day)
    return serial


def or_zero(x: Column) -> Column:
    """0 for a blank, the date of serial 0 where one is remembered."""
    out, day = F.coalesce(x, _L(0.0)), x.__dict__.get("_day")
    if day is not None:
        out.__dict__["_day"] = F.when(x.isNull(), F.to_date(_L("1899-12-31"))).otherwise(day)
    return out


def day_serial(d: Column) -> Column:
    """Serial number of a date."""
    days = F.datediff(d, F.to_date(_L(_EPOCH)))
    return _dated((days - F.when(days <= 60, 1).otherwise(0)).cast("double"), d)


def to_serial(d: Column) -> Column:
    """Serial number of a date or timestamp."""
    days = F.datediff(F.to_date(d), F.to_date(_L(_EPOCH)))
    moment = F.to_timestamp(d)
    part = (F.hour(moment) * 3600 + F.minute(moment) * 60 + F.second(moment)) / 86400.0
    return _dated(F.when(days <= 60, days - 1).otherwise(days).cast("double") + part, F.to_date(d))


def from_serial(x: Column) -> Column:
    """Date of a serial number."""
    day = x.__dict__.get("_day")
    return day if day is not None else F.when(x >= 0, F.date_add(F.to_date(_L(_EPOCH)), (F.floor(x) + (x < 60).cast("int")).cast("int")))


def _ordered(a: Column, b: Column) -> tuple[Column, Column]:
    """The earlier and the later of two serials."""
    s, e = F.least(a, b), F.greatest(a, b)
    if "_day" in a.__dict__ and "_day" in b.__dict__:
        x, y = from_serial(a), from_serial(b)
        s.__dict__["_day"], e.__dict__["_day"] = F.least(x, y), F.greatest(x, y)
    return s, e


def moment_of(x: Column) -> Column:
    """Timestamp of a serial number, to the nearest second."""
    seconds = F.rint((x - F.floor(x)) * 86400)
    return F.to_timestamp(from_serial(x)) + F.make_dt_interval(secs=seconds)


def _date(*names: str, **more):
    return scalar(*names, **({"sig": "d", "returns": "num", "err": "#NUM!"} | more))


def _n(x: Column) -> Column:
    return x.cast("double")


_date("YEAR")(lambda d: _n(F.year(from_serial(d))))
_date("MONTH")(lambda d: F.when(F.floor(d) == 60, 2.0).when(F.floor(d) == 0, 1.0).otherwise(_n(F.month(from_serial(d)))))
_date("DAY")(lambda d: F.when(F.floor(d) == 60, 29.0).when(F.floor(d) == 0, 0.0).otherwise(_n(F.day(from_serial(d)))))
_date("HOUR")(lambda d: _n(F.hour(moment_of(d))))
_date("MINUTE")(lambda d: _n(F.minute(moment_of(d))))
_date("SECOND")(lambda d: _n(F.second(moment_of(d))))
_date("ISOWEEKNUM")(lambda d: _n(F.weekofyear(from_serial(d))))
_date("DAYS", sig="dd")(lambda e, s: F.floor(e) - F.floor(s))
_date("TODAY", sig="", returns="date")(lambda: day_serial(F.current_date()))
_date("NOW", sig="", returns="date")(lambda: to_serial(F.current_timestamp()))


def _ymd(d: Column) -> tuple[Column, Column, Column]:
    day = from_serial(d)
    return F.year(day), F.month(day), F.day(day)


@_date("DATE", sig="nnn", returns="date")
def date(y: Column, m: Column, d: Column) -> Column:
    y = F.floor(F.when(y < 1900, y + 1900).otherwise(y))
    start = F.add_months(F.make_date(y.cast("int"), _L(1), _L(1)), (F.floor(m) - 1).cast("int"))
    return day_serial(F.date_add(start, (F.floor(d) - 1).cast("int")))


@_date("EDATE", sig="dn", returns="date")
def edate(d: Column, m: Column) -> Column:
    return day_serial(F.add_months(from_serial(d), m.cast("int"))) + d - F.floor(d)


_date("EOMONTH", sig="dn", returns="date")(lambda d, m: day_serial(F.last_day(F.add_months(from_serial(d), m.cast("int")))))
_date("TIME", sig="nnn")(lambda h, m, s: F.pmod(F.floor(h) * 3600 + F.floor(m) * 60 + F.floor(s), _L(86400.0)) / 86400)


@_date("WEEKDAY", sig="d|n")
def weekday(d: Column, kind: Column = 1) -> Column:
    sunday = F.dayofweek(from_serial(d))  # 1 is Sunday
    if known(kind) == 1:
        return _n(sunday)
    monday = F.pmod(sunday - 2, _L(7))
    if known(kind) in (2, 3):
        return _n(monday + (1 if known(kind) == 2 else 0))
    shifted = lambda first: F.pmod(monday - (first - 11), _L(7)) + 1
    out = F.when(kind == 2, monday + 1).when(kind == 3, monday)
    for first in range(11, 18):
        out = out.when(kind == first, shifted(first))
    return _n(out.otherwise(sunday))


@_date("WEEKNUM", sig="d|n")
def weeknum(d: Column, kind: Column = 1) -> Column:
    day = from_serial(d)
    first = F.trunc(day, "year")
    monday = F.pmod(F.dayofweek(first) - 2, _L(7))
    if known(kind) == 1:
        return _n(F.floor((F.dayofyear(day) - 1 + F.pmod(monday - 6, _L(7))) / 7) + 1)
    start = F.when(kind.isin(2, 11), 0).when(kind == 12, 1).when(kind == 13, 2).when(kind == 14, 3).when(kind == 15, 4).when(kind == 16, 5).otherwise(6)
    week = F.floor((F.dayofyear(day) - 1 + F.pmod(monday - start, _L(7))) / 7) + 1
    return _n(F.when(kind == 21, F.weekofyear(day)).otherwise(week))


@_date("DATEDIF", sig="ddt")
def datedif(s: Column, e: Column, unit: Column) -> Column:
    (y1, m1, d1), (y2, m2, d2) = _ymd(s), _ymd(e)
    months = (y2 - y1) * 12 + m2 - m1 - F.when(d2 < d1, 1).otherwise(0)
    plain = {"Y": F.floor(months / 12), "M": months, "D": F.floor(e) - F.floor(s), "YM": F.pmod(months, _L(12))}.get(str(known(unit)).upper())
    if plain is not None:
        return F.when(F.floor(e) >= F.floor(s), _n(plain))
    u = F.upper(unit)
    whole = F.add_months(from_serial(s), months)
    year = F.add_months(from_serial(s), F.floor(months / 12).cast("int") * 12)
    out = F.when(u == "Y", F.floor(months / 12)).when(u == "M", months).when(u == "D", F.floor(e) - F.floor(s))
    out = out.when(u == "MD", F.datediff(from_serial(e), whole)).when(u == "YM", F.pmod(months, _L(12))).when(u == "YD", F.datediff(from_serial(e), year))
    return F.when(F.floor(e) >= F.floor(s), _n(out))


def _last_of_february(d: Column) -> Column:
    day = from_serial(d)
    return (F.month(day) == 2) & (F.last_day(day) == day)


def _day360(s: Column, e: Column, european: bool, nasd: bool) -> Column:
    (y1, m1, d1), (y2, m2, d2) = _ymd(s), _ymd(e)
    if european:
        d1, d2 = F.least(d1, _L(30)), F.least(d2, _L(30))
    elif nasd:
        both = _last_of_february(s) & _last_of_february(e)
        d2 = F.when(both, 30).otherwise(d2)
        d1 = F.when(_last_of_february(s) | (d1 == 31), 30).otherwise(d1)
        d2 = F.when((d2 == 31) & (d1 >= 30), 30).otherwise(d2)
    else:
        d1 = F.when(_last_of_february(s) | (d1 == 31), 30).otherwise(d1)
        rolls = (d2 == 31) & (d1 < 30)
        m2, d2 = F.when(rolls, m2 + 1).otherwise(m2), F.when(rolls, 1).when(d2 == 31, 30).otherwise(d2)
    return _n((y2 - y1) * 360 + (m2 - m1) * 30 + d2 - d1)


_date("DAYS360", sig="dd|b")(lambda s, e, euro=False: F.when(euro, _day360(s, e, True, False)).otherwise(_day360(s, e, False, False)))


@_date("YEARFRAC", sig="dd|n")
def yearfrac(a: Column, b: Column, basis: Column = 0) -> Column:
    s, e = _ordered(a, b)
    days = F.floor(e) - F.floor(s)
    simple = {0: lambda: _day360(s, e, False, True) / 360, 2: lambda: days / 360, 3: lambda: days / 365, 4: lambda: _day360(s, e, True, False) / 360}.get(known(basis))
    if simple is not None:
        return simple()
    y1, y2 = F.year(from_serial(s)), F.year(from_serial(e))
    leap = lambda y: ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
    within = F.add_months(from_serial(s), 12) >= from_serial(e)
    feb29 = lambda y: F.when(leap(y), F.make_date(y, _L(2), F.when(leap(y), 29).otherwise(28)))
    inside = lambda y: F.coalesce((feb29(y) >= from_serial(s)) & (feb29(y) <= from_serial(e)), _L(False))
    short = F.when(((y1 == y2) & leap(y1)) | inside(y1) | inside(y2), 366.0).otherwise(365.0)
    long = F.datediff(F.make_date(y2 + 1, _L(1), _L(1)), F.make_date(y1, _L(1), _L(1))) / (y2 - y1 + 1)
    actual = days / F.when(within, short).otherwise(long)
    if known(basis) == 1:
        return actual
    return F.when(basis == 1, actual).when(basis == 2, days / 360).when(basis == 3, days / 365).when(basis == 4, _day360(s, e, True, False) / 360).when(basis == 0, _day360(s, e, False, True) / 360)


def _weekend(spec: int | str | None) -> set[int]:
    """Week days off, Monday 0, of a weekend number or seven-character mask."""
    if isinstance(spec, str):
        return {i for i, c in enumerate(spec) if c == "1"}
    n = 1 if spec is None else int(spec)
    return {(n + 4) % 7, (n + 5) % 7} if n < 11 else {(n - 12) % 7}


def is_workday(day: Column, weekend: int | str | None = None, holidays: Column | None = None) -> Column:
    open_ = ~F.weekday(day).isin(*_weekend(weekend))
    return open_ & ~F.coalesce(F.array_contains(holidays, day), _L(False)) if holidays is not None else open_


def networkdays(s: Column, e: Column, weekend: int | str | None = None, holidays: Column | None = None) -> Column:
    """Working days between two serials, both included; negative if the end is first."""
    a, b = (from_serial(x) for x in _ordered(s, e))
    if holidays is None:
        # Whole weeks have the same number of working days; those of the rest are counted by week day.
        off = _weekend(weekend)
        days, first = F.datediff(b, a) + 1, F.weekday(a)
        n = F.floor(days / 7) * (7 - len(off)) + sum((F.pmod(first + i, _L(7)).isin(*set(range(7)) - off) & (i < days % 7)).cast("int") for i in range(6)) if len(off) < 7 else _L(0)
    else:
        n = F.size(F.filter(F.sequence(a, b, F.expr("interval 1 day")), lambda d: is_workday(d, weekend, holidays)))
    return _n(F.when(s <= e, n).otherwise(-n))


def workday(s: Column, n: Column, weekend: int | str | None = None, holidays: Column | None = None) -> Column:
    """Serial of the n-th working day after (before) a serial. A search window of 2 n + 30 days and holidays covers it."""
    k = F.floor(F.abs(n)).cast("int")
    extra = F.size(holidays) if holidays is not None else _L(0)
    reach = k * 7 + 30 + extra
    step = F.signum(n).cast("int")
    days = F.transform(F.sequence(_L(1), reach), lambda i: F.date_add(from_serial(s), i * step))
    found = F.get(F.filter(days, lambda d: is_workday(d, weekend, holidays)), k - 1)
    return F.when(n == 0, s).otherwise(day_serial(found))


_date("NETWORKDAYS", sig="dd|d*")(lambda s, e, *h: networkdays(s, e, None, F.array(*(from_serial(x) for x in h)) if h else None))
_date("WORKDAY", sig="dn|d*", returns="date")(lambda s, n, *h: workday(s, n, None, F.array(*(from_serial(x) for x in h)) if h else None))


@_date("DATEVALUE", sig="t", returns="date", err="#VALUE!")
def datevalue(t: Column) -> Column:
    forms = ("yyyy-M-d", "M/d/yyyy", "yyyy/M/d", "d-MMM-yyyy", "MMM d, yyyy", "MMMM d, yyyy")
    return day_serial(F.coalesce(*(F.try_to_date(F.trim(t), f) for f in forms)))


@_date("TIMEVALUE", sig="t", err="#VALUE!")
def timevalue(t: Column) -> Column:
    pattern = r"^\s*(\d{1,2}):(\d{2})(?::(\d{2}))?\s*([AaPp][Mm])?\s*$"
    part = lambda i: F.regexp_extract(t, pattern, i)
    hour = part(1).try_cast("int")
    meridiem = F.lower(part(4))
    hour24 = F.when(meridiem == "", hour).when(hour.between(1, 12), hour % 12 + F.when(meridiem == "pm", 12).otherwise(0))
    seconds = hour24 * 3600 + part(2).try_cast("int") * 60 + F.coalesce(part(3).try_cast("int"), _L(0))
    return F.pmod(seconds, _L(86400)) / 86400.0

