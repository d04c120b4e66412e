"""Text functions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from quadrille.functions.registry import FormulaError, kernel, scalar

_L = F.lit


def _text(*names: str, **more):
    return scalar(*names, **({"sig": "t", "returns": "text", "err": "#VALUE!"} | more))


_text("LOWER")(F.lower)
_text("UPPER")(F.upper)
_text("TRIM")(lambda t: F.trim(F.regexp_replace(t, r"\s+", " ")))
_text("CLEAN")(lambda t: F.regexp_replace(t, r"[\x00-\x1F]", ""))
_text("LEFT", "LEFTB", sig="t|n")(lambda t, n=1: F.when(n >= 0, F.substring(t, _L(1), n.cast("int"))))
_text("RIGHT", "RIGHTB", sig="t|n")(lambda t, n=1: F.when(n >= 0, F.call_function("right", t, n.cast("int"))))
_text("MID", "MIDB", sig="tnn")(lambda t, s, n: F.when((s >= 1) & (n >= 0), F.substring(t, s.cast("int"), n.cast("int"))))
_text("LEN", returns="num")(lambda t: F.char_length(t).cast("double"))
_text("LENB", returns="num")(lambda t: F.octet_length(t).cast("double"))
_text("REPT", sig="tn")(lambda t, n: F.when(n >= 0, F.call_function("repeat", t, n.cast("int"))))
_text("CHAR", sig="n")(lambda n: F.when(n.between(1, 255), F.call_function("chr", F.floor(n).cast("int"))))
_text("CODE", "UNICODE", returns="num")(lambda t: F.when(t != "", F.ascii(t).cast("double")))
_text("UNICHAR", sig="n")(lambda n: F.when((n >= 1) & (n <= 0x10FFFF), F.decode(F.unhex(F.lpad(F.hex(F.floor(n).cast("bigint")), 8, "0")), "UTF-32")))
_text("EXACT", sig="tt", returns="bool")(lambda a, b: a.eqNullSafe(b))
_text("FIND", "FINDB", sig="tt|n", returns="num")(lambda f, t, s=1: F.when((s >= 1) & (F.call_function("locate", f, t, s.cast("int")) > 0), F.call_function("locate", f, t, s.cast("int")).cast("double")))
_text("CONCAT", "CONCATENATE", "&", sig="t*")(lambda *t: F.concat(*(F.coalesce(x, _L("")) for x in t)))
_text("TEXTSPLIT", sig="tt", returns="array")(lambda t, d: F.split(t, F.concat(_L(r"\Q"), d, _L(r"\E"))))
_text("REGEXTEST", sig="tt", returns="bool")(lambda t, p: F.call_function("rlike", t, p))
_text("REGEXEXTRACT", sig="tt", err="#N/A")(lambda t, p: F.regexp_substr(t, p))
_text("REGEXREPLACE", sig="ttt")(lambda t, p, r: F.regexp_replace(t, p, r))
_text("REPLACE", "REPLACEB", sig="tnnt")(lambda t, s, n, new: F.when((s >= 1) & (n >= 0), F.overlay(t, new, s.cast("int"), n.cast("int"))))
_text("T", sig="a")(lambda v: F.coalesce(v, _L("")))
_text("STR", sig="t")(lambda v: v)
_text("PHONETIC", sig="t")(lambda t: t)
_text("TRANSLATE", sig="t|tt")(lambda t, *_: t)
_text("DETECTLANGUAGE")(lambda t: F.when(t.isNotNull(), "en"))
_text("VALUE", returns="num")(lambda t: F.trim(t).try_cast("double"))
_text("NUMBERVALUE", sig="t|tt", returns="num")(lambda t, d=".", g=",": F.replace(F.replace(F.regexp_replace(t, r"\s", ""), g, _L("")), d, _L(".")).try_cast("double"))
_text("VALUETOTEXT", sig="t|n")(lambda v, form=0: F.when(form == 1, F.concat(_L('"'), v, _L('"'))).otherwise(v))
_text("ENCODEURL")(lambda t: F.replace(F.url_encode(t), _L("+"), _L("%20")))
_text("FILTERXML", sig="tt")(lambda x, p: F.xpath_string(x, p))
_text("PROPER")(
    lambda t: F.array_join(F.transform(F.regexp_extract_all(t, _L(r"(\p{L}+|\P{L}+)"), _L(1)), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, _L(2), F.length(w))))), "")
)


@_text("SEARCH", "SEARCHB", sig="tt|n", returns="num")
def search(f: Column, t: Column, start: Column = 1) -> Column:
    """First place of f in t, without regard to case; ? is any character, * any run, ~ makes them plain."""
    escaped = F.regexp_replace(F.lower(f), r"([\\\[\](){}.+^$|])", r"\\$1")
    pattern = F.regexp_replace(F.regexp_replace(escaped, r"(?<!~)\?", "."), r"(?<!~)\*", ".*?")
    pattern = F.regexp_replace(pattern, r"~([*?~])", r"\\$1")
    rest = F.substring(F.lower(t), start.cast("int"), F.length(t))
    at = F.regexp_instr(rest, pattern)
    return F.when((start >= 1) & (at > 0), (at + start - 1).cast("double"))


@_text("SUBSTITUTE", sig="ttt|n")
def substitute(t: Column, old: Column, new: Column, which: Column | None = None) -> Column:
    everywhere = F.when(old == "", t).otherwise(F.replace(t, old, new))
    if which is None:
        return everywhere
    parts = F.split(t, F.concat(_L(r"\Q"), old, _L(r"\E")), -1)
    k = which.cast("int")
    nth = F.concat(F.array_join(F.slice(parts, _L(1), k), "\x00"), new, F.array_join(F.slice(parts, k + 1, F.size(parts)), "\x00"))
    return F.when((old == "") | (F.size(parts) <= k), t).otherwise(F.replace(nth, _L("\x00"), old))


def _around(t: Column, d: Column, n: Column, after: bool) -> Column:
    parts = F.split(t, F.concat(_L(r"\Q"), d, _L(r"\E")), -1)
    k = F.when(n > 0, n.cast("int")).otherwise(F.size(parts) + n.cast("int"))
    some = F.slice(parts, k + 1, F.size(parts)) if after else F.slice(parts, _L(1), k)
    joined = F.call_function("array_join", some, d)
    return F.when((d != "") & (k >= 1) & (k < F.size(parts)), joined)


_text("TEXTAFTER", sig="tt|n", err="#N/A")(lambda t, d, n=1: _around(t, d, n, True))
_text("TEXTBEFORE", sig="tt|n", err="#N/A")(lambda t, d, n=1: _around(t, d, n, False))
_text("TEXTJOIN", sig="tbt*")(lambda d, skip, *t: F.call_function("array_join", F.filter(F.array(*(F.coalesce(x, _L("")) for x in t)), lambda x: ~skip | (x != "")), d))


def _grouped(x: Column, places: Column, commas: bool) -> Column:
    """x rounded half away from zero, with the given places."""
    scale = F.pow(_L(10.0), F.floor(places))
    rounded = F.signum(x) * F.floor(F.rint(F.abs(x) * scale * 1e6) / 1e6 + 0.5) / scale
    shown = F.call_function("format_number", rounded, F.greatest(places, _L(0)).cast("int"))
    return shown if commas else F.replace(shown, _L(","), _L(""))


_text("FIXED", sig="n|nb")(lambda x, d=2.0, plain=False: F.when(plain, _grouped(x, d, False)).otherwise(_grouped(x, d, True)))
_text("DOLLAR", sig="n|n")(lambda x, d=2.0: F.when(x < 0, F.concat(_L("($"), _grouped(-x, d, True), _L(")"))).otherwise(F.concat(_L("$"), _grouped(x, d, True))))
_text("ARRAYTOTEXT", sig="t*")(lambda *t: F.concat_ws(", ", *t))


def _width(full: bool):
    ascii_, wide = "".join(map(chr, range(0x21, 0x7F))) + " ", "".join(map(chr, range(0xFF01, 0xFF5F))) + "　"
    return lambda t: F.translate(t, *((ascii_, wide) if full else (wide, ascii_)))


_text("ASC")(_width(False))
_text("JIS", "DBCS")(_width(True))

# Thai digits' and places' names.
_THAI = ("ศูนย์", "หนึ่ง", "สอง", "สาม", "สี่", "ห้า", "หก", "เจ็ด", "แปด", "เก้า")
_PLACES = ("", "สิบ", "ร้อย", "พัน", "หมื่น", "แสน")


def _thai(n: int) -> str:
    if n >= 10**6:
        return _thai(n // 10**6) + "ล้าน" + (_thai(n % 10**6) if n % 10**6 else "")
    out, digits = "", str(n)
    for i, c in enumerate(digits):
        place, d = len(digits) - 1 - i, int(c)
        if d == 0:
            continue
        word = "เอ็ด" if place == 0 and d == 1 and len(digits) > 1 else "ยี่" if place == 1 and d == 2 else "" if place == 1 and d == 1 else _THAI[d]
        out += word + _PLACES[place]
    return out or _THAI[0]


@kernel("BAHTTEXT", sig="n", returns="text")
def bahttext(x: float) -> str:
    satang = round(abs(x) * 100)
    whole, part = divmod(satang, 100)
    start = "ลบ" if x < 0 else ""
    if not part:
        return f"{start}{_thai(whole)}บาทถ้วน"
    return start + (f"{_thai(whole)}บาท" if whole else "") + f"{_thai(part)}สตางค์"


_DATE_TOKENS = {"yyyy": "yyyy", "yy": "yy", "mmmm": "MMMM", "mmm": "MMM", "mm": "MM", "m": "M", "dddd": "EEEE", "ddd": "EEE", "dd": "dd", "d": "d", "hh": "HH", "h": "H", "ss": "ss", "s": "s"}


def text_format(x: Column, form: str, moment: Column) -> Column:
    """TEXT with a literal format: a date one if it has y or d and no 0 or #, else a number one."""
    low = form.lower()
    if re.search("[yd]", low) and not re.search("[0#]", low):
        pattern, minutes = "", False
        for token in re.findall(r"y+|m+|d+|h+|s+|[^ymdhs]+", low):
            if token in ("m", "mm") and minutes:
                pattern += token
            else:
                pattern += _DATE_TOKENS.get(token, "".join(f"'{c}'" if c.isalpha() else c for c in token))
            minutes = token[0] == "h" or (minutes and not token[0].isalpha())
        return F.date_format(moment, pattern)
    number = re.search(r"[0#][0#,]*(?:\.([0#]+))?", form)
    if not number:
        return F.lit(form)
    places = len(number[1] or "")
    scaled = x * 100 if "%" in form else x
    shown = _grouped(F.abs(scaled), F.lit(float(places)), "," in number[0])
    sign = F.when((scaled < 0), F.lit("-")).otherwise(F.lit(""))
    return F.concat(sign, F.lit(form[: number.start()]), shown, F.lit(form[number.end() :]))


def display(x: Column) -> Column:
    """A number as it is shown: integers without a point, others with up to fifteen places."""
    shown = F.call_function("format_number", x, F.lit("0.###############"))
    return F.when((x == F.floor(x)) & (F.abs(x) < 1e15), x.cast("bigint").cast("string")).otherwise(shown)


@kernel("FMT15", sig="n", returns="text")
def fmt15(x: float) -> str:
    if x != x or abs(x) == float("inf"):
        raise FormulaError("#NUM!")
    return f"{x:.15g}".replace("e", "E")
