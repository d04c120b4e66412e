"""Financial functions. Dates are serial numbers; annuity formulas are Columns, root finding is in kernels."""

from __future__ import annotations

import calendar
import datetime as dt
import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from quadrille.functions.registry import FormulaError, aggregate, fold, kernel, scalar

_L = F.lit


def _need(*conditions: bool) -> None:
    if not all(conditions):
        raise FormulaError("#NUM!")


# -- annuities -----------------------------------------------------------------------------------


def _growth(r: Column, n: Column) -> tuple[Column, Column]:
    """(1+r)^n and the value of n payments of 1 at their end."""
    g = F.pow(1 + r, n)
    return g, F.when(r == 0, n).otherwise(F.try_divide(g - 1, r))


@scalar("PV", sig="nnn|nn")
def pv(r: Column, n: Column, pmt: Column, fv: Column = 0.0, due: Column = 0.0) -> Column:
    g, s = _growth(r, n)
    return -(fv + pmt * (1 + r * due) * s) / g


@scalar("FV", sig="nnn|nn")
def fv(r: Column, n: Column, pmt: Column, pv: Column = 0.0, due: Column = 0.0) -> Column:
    g, s = _growth(r, n)
    return -(pv * g + pmt * (1 + r * due) * s)


@scalar("PMT", sig="nnn|nn")
def pmt(r: Column, n: Column, pv: Column, fv: Column = 0.0, due: Column = 0.0) -> Column:
    g, s = _growth(r, n)
    return F.try_divide(-(pv * g + fv), (1 + r * due) * s)


@scalar("NPER", sig="nnn|nn")
def nper(r: Column, pmt: Column, pv: Column, fv: Column = 0.0, due: Column = 0.0) -> Column:
    p = pmt * (1 + r * due)
    ratio = F.try_divide(p - fv * r, p + pv * r)
    return F.when(r == 0, F.try_divide(-(pv + fv), pmt)).otherwise(F.when(ratio > 0, F.ln(ratio) / F.ln(1 + r)))


def _balance(r: Column, per: Column, n: Column, pv: Column, fv_: Column, due: Column) -> tuple[Column, Column]:
    """Payment, and interest in the period."""
    p = pmt(r, n, pv, fv_, due)
    owed = fv(r, per - 1, p, pv, due)
    interest = F.when((due != 0) & (per == 1), _L(0.0)).when(due != 0, (fv(r, per - 2, p, pv, due) - p) * r).otherwise(owed * r)
    return p, interest


@scalar("IPMT", sig="nnnn|nn")
def ipmt(r: Column, per: Column, n: Column, pv: Column, fv: Column = 0.0, due: Column = 0.0) -> Column:
    return F.when((per >= 1) & (per < n + 1), _balance(r, per, n, pv, fv, due)[1])


@scalar("PPMT", sig="nnnn|nn")
def ppmt(r: Column, per: Column, n: Column, pv: Column, fv: Column = 0.0, due: Column = 0.0) -> Column:
    p, interest = _balance(r, per, n, pv, fv, due)
    return F.when((per >= 1) & (per < n + 1), p - interest)


def _cumulated(part):
    def build(r: Column, n: Column, pv: Column, start: Column, end: Column, due: Column) -> Column:
        good = (r > 0) & (n > 0) & (pv > 0) & (start >= 1) & (end >= start) & (end <= n)
        periods = F.sequence(F.ceil(start).cast("int"), F.greatest(F.floor(end), F.ceil(start)).cast("int"))
        return F.when(good, F.aggregate(periods, _L(0.0), lambda a, i: a + part(r, i.cast("double"), n, pv, _L(0.0), due)))

    return build


scalar("CUMIPMT", sig="nnnnnn")(_cumulated(ipmt))
scalar("CUMPRINC", sig="nnnnnn")(_cumulated(ppmt))
scalar("ISPMT", sig="nnnn")(lambda r, per, n, pv: F.try_divide(pv * r * per, n) - pv * r)
scalar("EFFECT", sig="nn")(lambda r, n: F.when((r > 0) & (n >= 1), F.pow(1 + r / F.floor(n), F.floor(n)) - 1))
scalar("NOMINAL", sig="nn")(lambda r, n: F.when((r > 0) & (n >= 1), F.floor(n) * (F.pow(1 + r, 1 / F.floor(n)) - 1)))
scalar("RRI", sig="nnn")(lambda n, pv, fv: F.when((n > 0) & (pv != 0), F.pow(F.try_divide(fv, pv), F.try_divide(_L(1.0), n)) - 1))
scalar("PDURATION", sig="nnn")(lambda r, pv, fv: F.when((r > 0) & (pv > 0) & (fv > 0), F.ln(fv / pv) / F.ln(1 + r)))
scalar("SLN", sig="nnn", err="#DIV/0!")(lambda c, s, n: F.try_divide(c - s, n))
scalar("SYD", sig="nnnn")(lambda c, s, n, p: F.when((p >= 1) & (p <= n), F.try_divide((c - s) * (n - p + 1) * 2, n * (n + 1))))


def _fraction(decimal: bool):
    def build(x: Column, f: Column) -> Column:
        f = F.floor(f)
        whole = F.signum(x) * F.floor(F.abs(x))
        scale = F.pow(_L(10.0), F.ceil(F.log10(F.greatest(f, _L(1.0)))))
        return F.when(f >= 1, whole + (x - whole) * (scale / f if decimal else f / scale))

    return build


scalar("DOLLARDE", sig="nn")(_fraction(True))
scalar("DOLLARFR", sig="nn")(_fraction(False))


@kernel("DB", sig="nnnn|n")
def db(cost: float, salvage: float, life: float, period: float, month: float = 12) -> float:
    _need(cost >= 0, salvage >= 0, life > 0, 1 <= month <= 12, 1 <= period <= life + (month < 12))
    if cost == 0:
        return 0.0
    rate = round(1 - (salvage / cost) ** (1 / life), 3)
    book, out = cost, 0.0
    for i in range(1, int(period) + 1):
        share = month / 12 if i == 1 else (12 - month) / 12 if i > life else 1
        out = book * rate * share
        book -= out
    return out


@kernel("DDB", sig="nnnn|n")
def ddb(cost: float, salvage: float, life: float, period: float, factor: float = 2) -> float:
    _need(cost >= 0, salvage >= 0, life > 0, 0 < period <= life, factor > 0)
    book, out = cost, 0.0
    for _ in range(math.ceil(period)):
        out = max(0.0, min(book * factor / life, book - salvage))
        book -= out
    return out


@kernel("VDB", sig="nnnnn|nb")
def vdb(cost: float, salvage: float, life: float, start: float, end: float, factor: float = 2, no_switch: bool = False) -> float:
    _need(cost >= 0, salvage >= 0, life > 0, 0 <= start <= end <= life, factor > 0)
    book, total = cost, 0.0
    for i in range(math.ceil(end)):
        share = book * factor / life
        line = (book - salvage) / (life - i)
        one = max(0.0, min(line if line > share and not no_switch else share, book - salvage))
        total += one * max(0.0, min(end, i + 1) - max(start, i))
        book -= one
    return total


# -- series --------------------------------------------------------------------------------------


def _newton(value, guess: float, floor: float = -0.9999) -> float:
    r = guess
    for _ in range(200):
        f = value(r)
        h = 1e-6 * (1 + abs(r))
        slope = (value(r + h) - value(r - h)) / (2 * h)
        if not slope or not math.isfinite(slope):
            break
        step = f / slope
        while r - step <= floor:
            step /= 2
        r -= step
        if abs(step) < 1e-10 * (1 + abs(r)):
            break
    if not math.isfinite(r) or abs(value(r)) > 1e-6 * max(1.0, abs(value(0.0))):
        raise FormulaError("#NUM!")
    return r


def _root(value, guess: float) -> float:
    for start in (guess, 0.0, 0.5, -0.5):
        try:
            return _newton(value, start)
        except (FormulaError, ArithmeticError):
            continue
    raise FormulaError("#NUM!")


@kernel("RATE", sig="nnn|nnn")
def rate(n: float, pmt: float, pv: float, fv: float = 0.0, due: float = 0.0, guess: float = 0.1) -> float:
    _need(n > 0)

    def owed(r: float) -> float:
        if abs(r) < 1e-11:
            return pv + pmt * n + fv
        g = (1 + r) ** n
        return pv * g + pmt * (1 + r * due) * (g - 1) / r + fv

    return _root(owed, guess)


@fold("NPV", sig="nr*")
def npv(r: float, *values: list[float]) -> float:
    return math.fsum(v / (1 + r) ** (i + 1) for i, v in enumerate(x for part in values for x in part))


@fold("IRR", sig="r|n")
def irr(values: list[float], guess: float = 0.1) -> float:
    _need(any(v > 0 for v in values), any(v < 0 for v in values))
    return _root(lambda r: math.fsum(v / (1 + r) ** i for i, v in enumerate(values)), guess)


@fold("MIRR", sig="rnn", err="#DIV/0!")
def mirr(values: list[float], finance: float, reinvest: float) -> float:
    n = len(values)
    gains = math.fsum(v * (1 + reinvest) ** (n - 1 - i) for i, v in enumerate(values) if v > 0)
    costs = math.fsum(v / (1 + finance) ** i for i, v in enumerate(values) if v < 0)
    if not gains or not costs:
        raise FormulaError("#DIV/0!")
    return (gains / -costs) ** (1 / (n - 1)) - 1


def _xvalue(r: float, values: list[float], days: list[float]) -> float:
    return math.fsum(v / (1 + r) ** ((int(d) - int(days[0])) / 365) for v, d in zip(values, days, strict=True))


@fold("XNPV", sig="nrr")
def xnpv(r: float, values: list[float], days: list[float]) -> float:
    _need(r > -1)
    return _xvalue(r, values, days)


@fold("XIRR", sig="rr|n")
def xirr(values: list[float], days: list[float], guess: float = 0.1) -> float:
    _need(any(v > 0 for v in values), any(v < 0 for v in values))
    return _root(lambda r: _xvalue(r, values, days), guess)


aggregate("FVSCHEDULE", sig="nr")(lambda p, rates: p * F.coalesce(F.product(1 + rates), _L(1.0)))

# -- day counts ----------------------------------------------------------------------------------

_EPOCH = dt.date(1899, 12, 30)


def day(serial: float) -> dt.date:
    return _EPOCH + dt.timedelta(days=int(serial))


def serial(d: dt.date) -> float:
    return float((d - _EPOCH).days)


def _month_end(d: dt.date) -> bool:
    return d.day == calendar.monthrange(d.year, d.month)[1]


def _add_months(d: dt.date, months: int, end: bool = False) -> dt.date:
    y, m = divmod(d.year * 12 + d.month - 1 + months, 12)
    last = calendar.monthrange(y, m + 1)[1]
    return dt.date(y, m + 1, last if end else min(d.day, last))


def _days360(a: dt.date, b: dt.date, basis: int) -> int:
    d1, d2 = a.day, b.day
    if basis == 4:
        d1, d2 = min(d1, 30), min(d2, 30)
    else:
        feb = lambda d: d.month == 2 and _month_end(d)
        if feb(a) and feb(b):
            d2 = 30
        if feb(a) or d1 == 31:
            d1 = 30
        if d2 == 31 and d1 == 30:
            d2 = 30
    return (b.year - a.year) * 360 + (b.month - a.month) * 30 + d2 - d1


def day_count(a: dt.date, b: dt.date, basis: int) -> float:
    return _days360(a, b, basis) if basis in (0, 4) else (b - a).days


def year_part(a: dt.date, b: dt.date, basis: int) -> float:
    """Years between two dates on a basis of 0 to 4."""
    _need(basis in (0, 1, 2, 3, 4))
    if a > b:
        a, b = b, a
    if basis != 1:
        return day_count(a, b, basis) / {0: 360, 2: 360, 3: 365, 4: 360}[basis]
    days = (b - a).days
    if b <= _add_months(a, 12):
        leaps = [dt.date(y, 2, 29) for y in {a.year, b.year} if calendar.isleap(y)]
        long = (a.year == b.year and bool(leaps)) or any(a <= x <= b for x in leaps)
        return days / (366 if long else 365)
    years = b.year - a.year + 1
    return days / ((dt.date(b.year + 1, 1, 1) - dt.date(a.year, 1, 1)).days / years)


# -- coupons -------------------------------------------------------------------------------------


class Coupons:
    """The coupon dates around a settlement, counted back from maturity."""

    def __init__(self, settlement: float, maturity: float, frequency: float, basis: float = 0):
        self.s, self.m, self.f, self.basis = day(settlement), day(maturity), int(frequency), int(basis)
        _need(self.s < self.m, self.f in (1, 2, 4), self.basis in (0, 1, 2, 3, 4))
        self.step, end = 12 // self.f, _month_end(self.m)
        self.n = 1
        while _add_months(self.m, -self.n * self.step, end) > self.s:
            self.n += 1
        self.previous = _add_months(self.m, -self.n * self.step, end)
        self.next = _add_months(self.m, -(self.n - 1) * self.step, end)
        self.period = (self.next - self.previous).days if self.basis == 1 else (365 if self.basis == 3 else 360) / self.f
        self.accrued = day_count(self.previous, self.s, self.basis)
        self.left = (self.next - self.s).days if self.basis in (1, 2, 3) else self.period - self.accrued

    def price(self, rate: float, yld: float, redemption: float) -> float:
        c, e, a = 100 * rate / self.f, self.period, self.accrued
        d = (e - a) / e
        if self.n == 1:
            return (redemption + c) / (1 + d * yld / self.f) - c * a / e
        q = 1 + yld / self.f
        return redemption / q ** (self.n - 1 + d) + math.fsum(c / q ** (k + d) for k in range(self.n)) - c * a / e

    def duration(self, coupon: float, yld: float) -> float:
        c, q, d = 100 * coupon / self.f, 1 + yld / self.f, (self.period - self.accrued) / self.period
        flows = [(k + d, c + (100 if k == self.n - 1 else 0)) for k in range(self.n)]
        worth = [v / q**t for t, v in flows]
        return math.fsum(t * w for (t, _), w in zip(flows, worth, strict=True)) / math.fsum(worth) / self.f


_C = "ddn|n"
kernel("COUPDAYBS", sig=_C)(lambda *a: float(Coupons(*a).accrued))
kernel("COUPDAYS", sig=_C)(lambda *a: float(Coupons(*a).period))
kernel("COUPDAYSNC", sig=_C)(lambda *a: float(Coupons(*a).left))
kernel("COUPNCD", sig=_C, returns="date")(lambda *a: serial(Coupons(*a).next))
kernel("COUPPCD", sig=_C, returns="date")(lambda *a: serial(Coupons(*a).previous))
kernel("COUPNUM", sig=_C)(lambda *a: float(Coupons(*a).n))


def _bisect(value, target: float, low: float = -0.99, high: float = 10.0) -> float:
    """The yield at which a falling price reaches the target."""
    for _ in range(200):
        middle = (low + high) / 2
        if middle in (low, high):
            # Neighbours: further steps would end here too.
            return middle
        low, high = (middle, high) if value(middle) > target else (low, middle)
    return (low + high) / 2


@kernel("PRICE", sig="ddnnnn|n")
def price(s: float, m: float, rate: float, yld: float, redemption: float, f: float, basis: float = 0) -> float:
    _need(rate >= 0, yld >= 0, redemption > 0)
    return Coupons(s, m, f, basis).price(rate, yld, redemption)


@kernel("YIELD", sig="ddnnnn|n")
def yield_(s: float, m: float, rate: float, pr: float, redemption: float, f: float, basis: float = 0) -> float:
    _need(rate >= 0, pr > 0, redemption > 0)
    c = Coupons(s, m, f, basis)
    return _bisect(lambda y: c.price(rate, y, redemption), pr)


@kernel("DURATION", sig="ddnnn|n")
def duration(s: float, m: float, coupon: float, yld: float, f: float, basis: float = 0) -> float:
    _need(coupon >= 0, yld >= 0)
    return Coupons(s, m, f, basis).duration(coupon, yld)


kernel("MDURATION", sig="ddnnn|n")(lambda s, m, c, y, f, b=0: duration(s, m, c, y, f, b) / (1 + y / int(f)))


def _years(a: float, b: float, basis: float, positive: bool = True) -> float:
    y = year_part(day(a), day(b), int(basis))
    _need(int(a) < int(b) or not positive)
    return y


kernel("DISC", sig="ddnn|n")(lambda s, m, pr, red, b=0: (red - pr) / red / _years(s, m, b))
kernel("PRICEDISC", sig="ddnn|n")(lambda s, m, d, red, b=0: red - d * red * _years(s, m, b))
kernel("YIELDDISC", sig="ddnn|n")(lambda s, m, pr, red, b=0: (red / pr - 1) / _years(s, m, b))
kernel("RECEIVED", sig="ddnn|n")(lambda s, m, inv, d, b=0: inv / (1 - d * _years(s, m, b)))
kernel("INTRATE", sig="ddnn|n")(lambda s, m, inv, red, b=0: (red - inv) / inv / _years(s, m, b))
kernel("ACCRINTM", sig="ddn|nn")(lambda i, s, r, par=1000.0, b=0: par * r * _years(i, s, b))


@kernel("PRICEMAT", sig="dddnn|n")
def pricemat(s: float, m: float, issue: float, rate: float, yld: float, b: float = 0) -> float:
    im, is_, sm = _years(issue, m, b), _years(issue, s, b, False), _years(s, m, b)
    return 100 * (1 + im * rate) / (1 + sm * yld) - 100 * is_ * rate


@kernel("YIELDMAT", sig="dddnn|n")
def yieldmat(s: float, m: float, issue: float, rate: float, pr: float, b: float = 0) -> float:
    im, is_, sm = _years(issue, m, b), _years(issue, s, b, False), _years(s, m, b)
    return ((1 + im * rate) / (pr / 100 + is_ * rate) - 1) / sm


def _bill(s: float, m: float) -> int:
    days = int(m) - int(s)
    _need(0 < days, day(m) <= _add_months(day(s), 12))
    return days


@kernel("TBILLPRICE", sig="ddn")
def tbillprice(s: float, m: float, d: float) -> float:
    _need(d > 0)
    return 100 * (1 - d * _bill(s, m) / 360)


kernel("TBILLYIELD", sig="ddn")(lambda s, m, pr: (100 - pr) / pr * 360 / _bill(s, m))


@kernel("TBILLEQ", sig="ddn")
def tbilleq(s: float, m: float, d: float) -> float:
    n = _bill(s, m)
    if n <= 182:
        return 365 * d / (360 - d * n)
    p, t = 1 - d * n / 360, n / (366 if n > 365 else 365)
    return (-2 * t + 2 * math.sqrt(t * t - (2 * t - 1) * (1 - 1 / p))) / (2 * t - 1)


@kernel("ACCRINT", sig="dddnnn|nb")
def accrint(issue: float, first: float, s: float, rate: float, par: float, f: float, basis: float = 0, from_issue: bool = True) -> float:
    _need(rate > 0, par > 0, int(f) in (1, 2, 4), int(issue) < int(s))
    begin = day(issue) if from_issue or int(s) <= int(first) else day(first)
    step, end, start, stop = 12 // int(f), _month_end(day(first)), begin, day(s)
    k, total = 0, 0.0
    while _add_months(day(first), -k * step, end) > start:
        k += 1
    at = -k
    while True:
        a, b = (_add_months(day(first), (at + j) * step, end) for j in (0, 1))
        if a >= stop:
            break
        whole = (b - a).days if int(basis) == 1 else (365 if int(basis) == 3 else 360) / int(f)
        total += day_count(max(a, start), min(b, stop), int(basis)) / whole
        at += 1
    return par * rate / int(f) * total


@kernel("AMORLINC", sig="nddnnn|n")
def amorlinc(cost: float, bought: float, first: float, salvage: float, period: float, rate: float, basis: float = 0) -> float:
    _need(cost > 0, rate > 0, period >= 0)
    one, head = cost * rate, cost * rate * year_part(day(bought), day(first), int(basis))
    left = cost - salvage - head
    if int(period) == 0:
        return min(head, cost - salvage)
    return max(0.0, min(one, left - one * (int(period) - 1)))


@kernel("AMORDEGRC", sig="nddnnn|n")
def amordegrc(cost: float, bought: float, first: float, salvage: float, period: float, rate: float, basis: float = 0) -> float:
    _need(cost > 0, 0 < rate < 0.5, period >= 0, int(basis) != 2)
    life, half_up = 1 / rate, lambda x: float(math.floor(x + 0.5))
    pace = rate * (1.5 if life < 5 else 2.0 if life < 6 else 2.5)
    first_part = cost * pace * year_part(day(bought), day(first), int(basis))
    if period == 0:
        return half_up(min(first_part, cost - salvage))
    # The book value falls by the pace each period, unrounded; what is left above the salvage comes last.
    book = (cost - first_part) * (1 - pace) ** (int(period) - 1)
    return half_up(max(min(book * pace, book - salvage), 0.0))


# -- odd coupons ---------------------------------------------------------------------------------


def _quasi(start: dt.date, stop: dt.date, anchor: dt.date, f: int, basis: int) -> list[tuple[dt.date, dt.date, float]]:
    """Coupon periods (begin, end, length) on the anchor's grid that touch start to stop."""
    step, end, k, out = 12 // f, _month_end(anchor), 0, []
    while _add_months(anchor, -k * step, end) > start:
        k += 1
    while _add_months(anchor, -k * step, end) < stop:
        a, b = (_add_months(anchor, -j * step, end) for j in (k, k - 1))
        out.append((a, b, (b - a).days if basis == 1 else (365 if basis == 3 else 360) / f))
        k -= 1
    return out


def _share(begin: dt.date, stop: dt.date, periods: list, basis: int) -> float:
    return math.fsum(day_count(max(a, begin), min(b, stop), basis) / n for a, b, n in periods if max(a, begin) < min(b, stop))


@kernel("ODDFPRICE", sig="ddddnnnn|n")
def oddfprice(s: float, m: float, issue: float, first: float, rate: float, yld: float, redemption: float, f: float, basis: float = 0) -> float:
    f, basis = int(f), int(basis)
    _need(int(issue) < int(s) < int(first) < int(m), f in (1, 2, 4), rate >= 0, redemption > 0)
    periods = _quasi(day(issue), day(first), day(first), f, basis)
    n = round(((day(m).year - day(first).year) * 12 + day(m).month - day(first).month) / (12 // f))
    c, q = 100 * rate / f, 1 + yld / f
    ahead = _share(day(s), day(first), periods, basis)
    odd = _share(day(issue), day(first), periods, basis)
    accrued = _share(day(issue), day(s), periods, basis)
    coupons = c * odd / q**ahead + math.fsum(c / q ** (k + ahead) for k in range(1, n + 1))
    return redemption / q ** (n + ahead) + coupons - c * accrued


kernel("ODDFYIELD", sig="ddddnnnn|n")(lambda s, m, i, first, rate, pr, red, f, b=0: _bisect(lambda y: oddfprice(s, m, i, first, rate, y, red, f, b), pr))


@kernel("ODDLPRICE", sig="dddnnnn|n")
def oddlprice(s: float, m: float, last: float, rate: float, yld: float, redemption: float, f: float, basis: float = 0) -> float:
    f, basis = int(f), int(basis)
    _need(int(last) < int(s) < int(m), f in (1, 2, 4), rate >= 0, redemption > 0)
    stop, periods, k = day(m), [], 0
    while True:
        a, b = (_add_months(day(last), j * (12 // f), _month_end(day(last))) for j in (k, k + 1))
        if a >= stop:
            break
        periods.append((a, b, (b - a).days if basis == 1 else (365 if basis == 3 else 360) / f))
        k += 1
    c = 100 * rate / f
    whole, gone, left = (_share(x, y, periods, basis) for x, y in ((day(last), stop), (day(last), day(s)), (day(s), stop)))
    return (redemption + c * whole) / (1 + left * yld / f) - c * gone


kernel("ODDLYIELD", sig="dddnnnn|n")(lambda s, m, last, rate, pr, red, f, b=0: _bisect(lambda y: oddlprice(s, m, last, rate, y, red, f, b), pr))

# Units of each former currency for one euro, and its decimals.
_EURO = {
    "EUR": (1.0, 2), "BEF": (40.3399, 0), "DEM": (1.95583, 2), "ESP": (166.386, 0), "FRF": (6.55957, 2), "IEP": (0.787564, 2), "ITL": (1936.27, 0), "LUF": (40.3399, 0),
    "NLG": (2.20371, 2), "ATS": (13.7603, 2), "PTE": (200.482, 0), "FIM": (5.94573, 2), "GRD": (340.75, 0), "SIT": (239.64, 2),
}


@kernel("EUROCONVERT", sig="ntt|bn", err="#VALUE!")
def euroconvert(x: float, source: str, target: str, full: bool = False, digits: float = 0) -> float:
    if source.upper() not in _EURO or target.upper() not in _EURO:
        raise FormulaError("#VALUE!")
    (a, _), (b, places) = _EURO[source.upper()], _EURO[target.upper()]
    euros = x / a
    if digits >= 3:
        euros = round(euros, int(digits))
    return euros * b if full or source.upper() == target.upper() else round(euros * b, places)
