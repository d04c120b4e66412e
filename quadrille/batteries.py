"""Formulas of each family on literal arguments, a row each, with SQL twins that compute the values another way.

Distribution functions are checked by Simpson sums over densities and by closed forms, inverses by the probability
that they must give back, finance and engineering functions by their defining formulas or by published examples.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.plans import formula as fx
from quadrille.workbook import Workbook

DIGITS = 6


def simpson(density: str, a: float | str, b: float | str, steps: int = 4000) -> str:
    """SQL for the integral of a density of {x} from a to b."""
    x = f"({a} + i * (({b}) - ({a})) / {steps}::DOUBLE)"
    weight = f"CASE WHEN i IN (0, {steps}) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END"
    return f"list_sum(list_transform(range(0, {steps + 1}), lambda i: ({weight}) * ({density.format(x=x)}))) * (({b}) - ({a})) / {3 * steps}::DOUBLE"


def total(term: str, a: int, b: int) -> str:
    """SQL for the sum of a term of {k} for whole k from a to b."""
    return f"list_sum(list_transform(range({a}, {b + 1}), lambda k: {term.format(k='k::DOUBLE')}))"


def _choose(n: str, k: str) -> str:
    return f"round(gamma(({n}) + 1) / (gamma(({k}) + 1) * gamma(({n}) - ({k}) + 1)))"


_NORMAL = "exp(-1 * (({x}) ** 2) / 2) / sqrt(2 * pi())"
_PHI = lambda z: f"0.5 + {simpson(_NORMAL, 0, z)}"
_BETA = "({x}) ** 7 * (1 - ({x})) ** 9 * gamma(18) / (gamma(8) * gamma(10))"
_CHI = "({x}) ** 4 * exp(-({x}) / 2) / (2 ** 5 * gamma(5))"
_GAMMA = "({x}) ** 8 * exp(-({x}) / 2) / (2 ** 9 * gamma(9))"
_F = "sqrt((6 * ({x})) ** 6 * 4.0::DOUBLE ** 4 / (6 * ({x}) + 4) ** 10) * gamma(5) / (gamma(3) * gamma(2)) / greatest({x}, 1e-300)"
_T = "gamma(30.5) / (sqrt(60 * pi()) * gamma(30)) * (1 + ({x}) ** 2 / 60) ** -30.5::DOUBLE"
_T_TAIL = lambda t: f"0.5 - ({simpson(_T, 0, t)})"
_BINOM = _choose("10", "{k}") + " * 0.5::DOUBLE ** 10"

#: Formula to SQL; of a text (or a truth value, or an error value) in quotes.
BATTERIES: dict[str, dict[str, str]] = {}

BATTERIES["battery_distributions"] = {
    "=BETA.DIST(0.4,8,10,TRUE)": simpson(_BETA, 0, 0.4), "=BETA.DIST(2,8,10,TRUE,1,3)": simpson(_BETA, 0, 0.5), "=BETADIST(2,8,10,1,3)": simpson(_BETA, 0, 0.5), "=BETA.DIST(0.4,8,10,FALSE)": _BETA.format(x="0.4::DOUBLE"),
    "=BETA.DIST(BETA.INV(0.3,8,10),8,10,TRUE)": "0.3", "=BETA.DIST(BETAINV(0.85,8,10,1,3),8,10,TRUE,1,3)": "0.85",
    "=BINOM.DIST(6,10,0.5,FALSE)": "210 / 1024.0", "=BINOM.DIST(6,10,0.5,TRUE)": total(_BINOM, 0, 6), "=BINOMDIST(6,10,0.5,TRUE)": total(_BINOM, 0, 6), "=BINOM.DIST.RANGE(10,0.5,3,6)": total(_BINOM, 3, 6), "=BINOM.DIST.RANGE(60,0.75,48)": f"{_choose('60', '48')} * 0.75::DOUBLE ** 48 * 0.25::DOUBLE ** 12",
    "=BINOM.INV(6,0.5,0.75)": "4", "=CRITBINOM(6,0.5,0.75)": "4",
    "=CHISQ.DIST(3,10,TRUE)": simpson(_CHI, 0, 3), "=CHISQ.DIST(3,10,FALSE)": _CHI.format(x="3::DOUBLE"), "=CHISQ.DIST.RT(18.307,10)": f"1 - ({simpson(_CHI, 0, 18.307)})", "=CHIDIST(18.307,10)": f"1 - ({simpson(_CHI, 0, 18.307)})",
    "=CHISQ.DIST(CHISQ.INV(0.93,10),10,TRUE)": "0.93", "=CHISQ.DIST.RT(CHISQ.INV.RT(0.05,10),10)": "0.05", "=CHIDIST(CHIINV(0.05,10),10)": "0.05",
    "=EXPON.DIST(0.2,10,TRUE)": "1 - exp(-2.0::DOUBLE)", "=EXPON.DIST(0.2,10,FALSE)": "10 * exp(-2.0::DOUBLE)", "=EXPONDIST(0.2,10,TRUE)": "1 - exp(-2.0::DOUBLE)",
    "=F.DIST(15.2068649,6,4,TRUE)": simpson(_F, 0, 15.2068649, 40000), "=F.DIST(15.2068649,6,4,FALSE)": _F.format(x="15.2068649::DOUBLE"), "=F.DIST.RT(15.2068649,6,4)": f"1 - ({simpson(_F, 0, 15.2068649, 40000)})", "=FDIST(15.2068649,6,4)": f"1 - ({simpson(_F, 0, 15.2068649, 40000)})",
    "=F.DIST(F.INV(0.01,6,4),6,4,TRUE)": "0.01", "=F.DIST.RT(F.INV.RT(0.01,6,4),6,4)": "0.01", "=FDIST(FINV(0.02,6,4),6,4)": "0.02",
    "=FISHER(0.75)": "atanh(0.75::DOUBLE)", "=FISHERINV(0.972955)": "tanh(0.972955::DOUBLE)", "=GAMMA(2.5)": "gamma(2.5::DOUBLE)", "=GAMMA(-3.75)": "pi() / (sin(pi() * -3.75::DOUBLE) * gamma(4.75::DOUBLE))",
    "=GAMMA.DIST(10.00001131,9,2,TRUE)": simpson(_GAMMA, 0, 10.00001131), "=GAMMA.DIST(10,9,2,FALSE)": _GAMMA.format(x="10::DOUBLE"), "=GAMMADIST(10,9,2,TRUE)": simpson(_GAMMA, 0, 10), "=GAMMA.DIST(GAMMA.INV(0.068094,9,2),9,2,TRUE)": "0.068094", "=GAMMADIST(GAMMAINV(0.5,9,2),9,2,TRUE)": "0.5",
    "=GAMMALN(4.5)": "lgamma(4.5::DOUBLE)", "=GAMMALN.PRECISE(0.3)": "lgamma(0.3::DOUBLE)", "=GAUSS(2)": simpson(_NORMAL, 0, 2), "=PHI(0.75)": _NORMAL.format(x="0.75::DOUBLE"),
    "=HYPGEOM.DIST(1,4,8,20,FALSE)": f"{_choose('8', '1')} * {_choose('12', '3')} / {_choose('20', '4')}", "=HYPGEOMDIST(1,4,8,20)": f"{_choose('8', '1')} * {_choose('12', '3')} / {_choose('20', '4')}", "=HYPGEOM.DIST(1,4,8,20,TRUE)": total(f"{_choose('8', '{k}')} * {_choose('12', '4 - {k}')} / {_choose('20', '4')}", 0, 1),
    "=LOGNORM.DIST(4,3.5,1.2,TRUE)": f"0.5 - ({simpson(_NORMAL, 0, '(3.5 - ln(4.0::DOUBLE)) / 1.2')})", "=LOGNORM.DIST(4,3.5,1.2,FALSE)": f"{_NORMAL.format(x='(3.5 - ln(4.0::DOUBLE)) / 1.2')} / 4.8", "=LOGNORMDIST(4,3.5,1.2)": f"0.5 - ({simpson(_NORMAL, 0, '(3.5 - ln(4.0::DOUBLE)) / 1.2')})", "=LOGNORM.DIST(LOGNORM.INV(0.039084,3.5,1.2),3.5,1.2,TRUE)": "0.039084", "=LOGNORMDIST(LOGINV(0.6,3.5,1.2),3.5,1.2)": "0.6",
    "=NEGBINOM.DIST(10,5,0.25,FALSE)": f"{_choose('14', '4')} * 0.25::DOUBLE ** 5 * 0.75::DOUBLE ** 10", "=NEGBINOM.DIST(10,5,0.25,TRUE)": total(f"{_choose('{k} + 4', '4')} * 0.25::DOUBLE ** 5 * 0.75::DOUBLE ** {{k}}", 0, 10), "=NEGBINOMDIST(10,5,0.25)": f"{_choose('14', '4')} * 0.25::DOUBLE ** 5 * 0.75::DOUBLE ** 10",
    "=NORM.DIST(42,40,1.5,TRUE)": _PHI("2 / 1.5::DOUBLE"), "=NORM.DIST(42,40,1.5,FALSE)": f"{_NORMAL.format(x='2 / 1.5::DOUBLE')} / 1.5", "=NORMDIST(42,40,1.5,TRUE)": _PHI("2 / 1.5::DOUBLE"), "=NORM.DIST(NORM.INV(0.908789,40,1.5),40,1.5,TRUE)": "0.908789", "=NORMDIST(NORMINV(0.2,40,1.5),40,1.5,TRUE)": "0.2",
    "=NORM.S.DIST(1.333333,TRUE)": _PHI(1.333333), "=NORMSDIST(1.333333)": _PHI(1.333333), "=NORM.S.DIST(NORM.S.INV(0.01),TRUE)": "0.01", "=NORMSDIST(NORMSINV(0.7))": "0.7",
    "=POISSON.DIST(2,5,TRUE)": total("exp(-5.0::DOUBLE) * 5 ** {k} / gamma({k} + 1)", 0, 2), "=POISSON.DIST(2,5,FALSE)": "exp(-5.0::DOUBLE) * 12.5", "=POISSON(2,5,TRUE)": total("exp(-5.0::DOUBLE) * 5 ** {k} / gamma({k} + 1)", 0, 2),
    "=T.DIST(1.5,60,TRUE)": f"0.5 + {simpson(_T, 0, 1.5)}", "=T.DIST(1.5,60,FALSE)": _T.format(x="1.5::DOUBLE"), "=T.DIST.2T(1.959999998,60)": f"2 * ({_T_TAIL(1.959999998)})", "=TDIST(1.959999998,60,2)": f"2 * ({_T_TAIL(1.959999998)})", "=TDIST(1.959999998,60,1)": _T_TAIL(1.959999998), "=T.DIST.RT(1.959999998,60)": _T_TAIL(1.959999998),
    "=T.DIST(T.INV(0.75,60),60,TRUE)": "0.75", "=T.DIST.2T(T.INV.2T(0.546449,60),60)": "0.546449", "=TDIST(TINV(0.05,60),60,2)": "0.05",
    "=WEIBULL.DIST(105,20,100,TRUE)": "1 - exp(-(1.05::DOUBLE ** 20))", "=WEIBULL.DIST(105,20,100,FALSE)": "0.2 * 1.05::DOUBLE ** 19 * exp(-(1.05::DOUBLE ** 20))", "=WEIBULL(105,20,100,TRUE)": "1 - exp(-(1.05::DOUBLE ** 20))", "=PERMUTATIONA(3,2)": "9",
    "=CONFIDENCE.NORM(0.05,2.5,50)-NORM.S.INV(0.975)*2.5/SQRT(50)": "0", "=CONFIDENCE(0.05,2.5,50)-NORM.S.INV(0.975)*2.5/SQRT(50)": "0", "=CONFIDENCE.T(0.05,1,50)-T.INV.2T(0.05,49)/SQRT(50)": "0",
    "=ERF(0.745)": simpson("2 / sqrt(pi()) * exp(-1 * (({x}) ** 2))", 0, 0.745), "=ERF(0.5,1)": simpson("2 / sqrt(pi()) * exp(-1 * (({x}) ** 2))", 0.5, 1), "=ERF.PRECISE(1)": simpson("2 / sqrt(pi()) * exp(-1 * (({x}) ** 2))", 0, 1), "=ERFC(1)": f"1 - ({simpson('2 / sqrt(pi()) * exp(-1 * (({x}) ** 2))', 0, 1)})", "=ERFC.PRECISE(1)": f"1 - ({simpson('2 / sqrt(pi()) * exp(-1 * (({x}) ** 2))', 0, 1)})",
}

_BESSEL = lambda x, n: simpson(f"cos({n} * ({{x}}) - {x} * sin({{x}})) / pi()", 0, "pi()")
BATTERIES["battery_engineering"] = {
    "=BESSELJ(1.9,2)": _BESSEL(1.9, 2), "=BESSELJ(9.59,1)": _BESSEL(9.59, 1), "=BESSELI(1.5,1)": simpson("exp(1.5 * cos({x})) * cos({x}) / pi()", 0, "pi()"), "=BESSELK(1.5,1)": simpson("exp(-1.5 * cosh({x})) * cosh({x})", 0, 8),
    "=BESSELY(2.5,1)": f"{simpson('sin(2.5 * sin({x}) - ({x})) / pi()', 0, 'pi()')} - ({simpson('(exp({x}) - exp(-({x}))) * exp(-2.5 * sinh({x})) / pi()', 0, 7)})",
    '=BIN2HEX("11111011",4)': "'00FB'", '=BIN2HEX("1111111111")': "'FFFFFFFFFF'", '=BIN2OCT("1001",3)': "'011'", "=BITRSHIFT(13,2)": "13 >> 2", "=COMPLEX(3,4)": "'3+4i'", '=COMPLEX(0,1,"j")': "'j'", "=DEC2OCT(58,3)": "'072'", "=DEC2OCT(-100)": "'7777777634'",
    '=HEX2BIN("F",8)': "'00001111'", '=HEX2BIN("FFFFFFFFFF")': "'1111111111'", '=HEX2OCT("F",3)': "'017'", '=HEX2OCT("3B4E")': "'35516'", '=OCT2BIN("3",3)': "'011'", '=OCT2DEC("54")': "44", '=OCT2DEC("7777777533")': "-165", '=OCT2HEX("100",4)': "'0040'",
    '=IMABS("5+12i")': "13", '=IMAGINARY("3+4i")': "4", '=IMREAL("6-9i")': "6", '=IMARGUMENT("3+4i")': "atan2(4.0::DOUBLE, 3.0::DOUBLE)", '=IMCONJUGATE("3+4i")': "'3-4i'", '=IMDIV("-238+240i","10+24i")': "'5+12i'", '=IMPRODUCT("3+4i","5-3i")': "'27+11i'", '=IMSUB("13+4i","5+3i")': "'8+i'", '=IMSUM("3+4i","5-3i")': "'8+i'", '=IMPOWER("2+3i",3)': "'-46+9i'",
    '=IMREAL(IMCOS("1+i"))': "cos(1.0::DOUBLE) * cosh(1.0::DOUBLE)", '=IMAGINARY(IMCOS("1+i"))': "-sin(1.0::DOUBLE) * sinh(1.0::DOUBLE)", '=IMREAL(IMCOSH("4+3i"))': "cosh(4.0::DOUBLE) * cos(3.0::DOUBLE)", '=IMAGINARY(IMCOSH("4+3i"))': "sinh(4.0::DOUBLE) * sin(3.0::DOUBLE)",
    '=IMREAL(IMSIN("4+3i"))': "sin(4.0::DOUBLE) * cosh(3.0::DOUBLE)", '=IMAGINARY(IMSIN("4+3i"))': "cos(4.0::DOUBLE) * sinh(3.0::DOUBLE)", '=IMREAL(IMSINH("4+3i"))': "sinh(4.0::DOUBLE) * cos(3.0::DOUBLE)", '=IMAGINARY(IMSINH("4+3i"))': "cosh(4.0::DOUBLE) * sin(3.0::DOUBLE)",
    '=IMREAL(IMTAN("4+3i"))': "sin(8.0::DOUBLE) / (cos(8.0::DOUBLE) + cosh(6.0::DOUBLE))", '=IMAGINARY(IMTAN("4+3i"))': "sinh(6.0::DOUBLE) / (cos(8.0::DOUBLE) + cosh(6.0::DOUBLE))", '=IMREAL(IMCOT("4+3i"))': "sin(8.0::DOUBLE) / (cosh(6.0::DOUBLE) - cos(8.0::DOUBLE))", '=IMAGINARY(IMCOT("4+3i"))': "-sinh(6.0::DOUBLE) / (cosh(6.0::DOUBLE) - cos(8.0::DOUBLE))",
    '=IMABS(IMPRODUCT(IMCSC("4+3i"),IMSIN("4+3i")))': "1", '=IMARGUMENT(IMPRODUCT(IMCSC("4+3i"),IMSIN("4+3i")))': "0", '=IMREAL(IMPRODUCT(IMCSCH("4+3i"),IMSINH("4+3i")))': "1", '=IMREAL(IMPRODUCT(IMSEC("4+3i"),IMCOS("4+3i")))': "1", '=IMREAL(IMPRODUCT(IMSECH("4+3i"),IMCOSH("4+3i")))': "1",
    '=IMREAL(IMEXP("1+i"))': "exp(1.0::DOUBLE) * cos(1.0::DOUBLE)", '=IMAGINARY(IMEXP("1+i"))': "exp(1.0::DOUBLE) * sin(1.0::DOUBLE)", '=IMREAL(IMLN("3+4i"))': "ln(5.0::DOUBLE)", '=IMAGINARY(IMLN("3+4i"))': "atan2(4.0::DOUBLE, 3.0::DOUBLE)", '=IMREAL(IMLOG10("3+4i"))': "log10(5.0::DOUBLE)", '=IMREAL(IMLOG2("3+4i"))': "log2(5.0::DOUBLE)", '=IMAGINARY(IMLOG2("3+4i"))': "atan2(4.0::DOUBLE, 3.0::DOUBLE) / ln(2.0::DOUBLE)",
    '=IMREAL(IMSQRT("3+4i"))': "2", '=IMAGINARY(IMSQRT("3+4i"))': "1", '=CONVERT(1,"lbm","kg")': "0.45359237", '=CONVERT(68,"F","C")': "20", '=CONVERT(CONVERT(100,"ft","m"),"ft","m")': "100 * 0.3048 * 0.3048", '=CONVERT(1,"mi","km")': "1.609344",
}

BATTERIES["battery_math"] = {
    "=ACOSH(2)": "acosh(2.0::DOUBLE)", "=ACOTH(6)": "ln(7 / 5.0::DOUBLE) / 2", "=ARABIC(\"MCMXCIV\")": "1994", "=CEILING.MATH(24.3,5)": "25", "=CEILING.MATH(-8.1,2)": "-8", "=CEILING.PRECISE(-4.1)": "-4", "=ISO.CEILING(4.3)": "5", "=COMBINA(4,3)": "20", "=COT(1.1)": "1 / tan(1.1::DOUBLE)", "=COTH(2)": "1 / tanh(2.0::DOUBLE)", "=CSC(1.5)": "1 / sin(1.5::DOUBLE)", "=CSCH(1.5)": "1 / sinh(1.5::DOUBLE)",
    "=FACTDOUBLE(7)": "7 * 5 * 3", "=FLOOR.MATH(24.3,5)": "20", "=FLOOR.MATH(-8.1,2)": "-10", "=FLOOR.PRECISE(-3.2,-1)": "-4", "=GCD(24,36,60)": "gcd(24, gcd(36, 60))", "=LCM(5,24,36)": "lcm(5, lcm(24, 36))", "=MDETERM({3,6,1;1,1,0;3,10,2})": "1", "=MINVERSE({2,1;1,1})": "'[[1.0,-1.0],[-1.0,2.0]]'", "=MMULT({1,3;7,2},{2,0;0,2})": "'[[2.0,6.0],[14.0,4.0]]'", "=MULTINOMIAL(2,3,4)": "factorial(9) / (factorial(2) * factorial(3) * factorial(4))", "=MUNIT(2)": "'[[1.0,0.0],[0.0,1.0]]'", "=PI()": "pi()", "=POWER(98.6,3.2)": "98.6::DOUBLE ** 3.2::DOUBLE", "=PRODUCT(2,5,{3,4})": "120",
    "=AND(RAND()>=0,RAND()<1)": "'TRUE'", "=RANDBETWEEN(5,5)": "5", "=SUM(RANDARRAY(2,2,3,3,TRUE))": "12", "=ROMAN(499)": "'CDXCIX'", "=ROMAN(499,4)": "'ID'", "=SECH(2)": "1 / cosh(2.0::DOUBLE)", "=SERIESSUM(2,0,2,{1,3,5})": "1 + 3 * 4 + 5 * 16", "=SQRTPI(2)": "sqrt(2 * pi())", "=SUM(SEQUENCE(2,3,1,2))": "36", "=XMATCH(4,d[x])": "2", "=LOOKUP(4.5,d[lx],d[x])": "4",
}

BATTERIES["battery_text"] = {
    "=ARRAYTOTEXT({1,2,3})": "'1, 2, 3'", '=ASC("ＡＢＣ１")': "'ABC1'", '=JIS("AB1")': "'ＡＢ１'", '=DBCS("AB1")': "'ＡＢ１'", "=BAHTTEXT(1234)": "'หนึ่งพันสองร้อยสามสิบสี่บาทถ้วน'", "=CHAR(65)": "chr(65)", '=CLEAN(CHAR(9)&"ab"&CHAR(10))': "'ab'", '=CODE("Alpha")': "ascii('A')", '=CONCAT("a",1,"b")': "'a' || 1 || 'b'", '=CONCATENATE("x","-","y")': "'x-y'", "=DOLLAR(1234.567,2)": "'$1,234.57'", "=DOLLAR(-1234.567,-2)": "'($1,200)'",
    '=FINDB("b","abc")': "2", '=SEARCHB("B","abc")': "2", '=LEFTB("abcd",2)': "left('abcd', 2)", '=LENB("abcd")': "4", '=LOWER("E. E. Cummings")': "lower('E. E. Cummings')", '=MIDB("abcd",2,2)': "'bc'", '=RIGHTB("abcd",3)': "right('abcd', 3)", '=REPLACEB("abcdef",3,2,"X")': "'abXef'", '=NUMBERVALUE("2.500,27",",",".")': "2500.27",
    '=REGEXEXTRACT("ab12cd345","[0-9]+")': "regexp_extract('ab12cd345', '[0-9]+')", '=REGEXREPLACE("a1b2","[0-9]","#")': "regexp_replace('a1b2', '[0-9]', '#', 'g')", '=T("x")': "'x'", "=T(5)": "''", '=INDEX(TEXTSPLIT("a,b,c",","),2)': "'b'", '=TRIM("  a   b ")': "'a b'", "=UNICHAR(937)": "chr(937)", '=UNICODE("Ω")': "unicode('Ω')", "=VALUETOTEXT(1.5)": "'1.5'", '=ENCODEURL("a b&c/ü")': "url_encode('a b&c/ü')", '=FILTERXML("<r><b>5</b><b>7</b></r>","//b[2]")': "'7'", '=PHONETIC("abc")': "'abc'",
    '=TEXT(1234.567,"#,##0.00")': "format('{:,.2f}', 1234.567::DOUBLE)", '=TEXT(0.285,"0.0%")': "'28.5%'", '=TEXT(DATE(2024,3,5),"yyyy-mm-dd")': "strftime(DATE '2024-03-05', '%Y-%m-%d')",
}

_SERIAL = lambda d: f"date_diff('day', DATE '1899-12-30', DATE '{d}')"
BATTERIES["battery_dates"] = {
    '=DATEVALUE("2011-08-22")': _SERIAL("2011-08-22"), '=DATEVALUE("8/22/2011")': _SERIAL("2011-08-22"), "=DAYS360(DATE(2011,1,30),DATE(2011,2,1))": "1", "=DAYS360(DATE(2011,1,1),DATE(2011,12,31))": "360", "=DAYS360(DATE(2011,1,31),DATE(2011,3,31),TRUE)": "60", "=MINUTE(0.78125)": "45", "=SECOND(TIME(4,48,18))": "18", "=TIME(16,48,10)": "(16 * 3600 + 48 * 60 + 10) / 86400.0::DOUBLE", "=TIME(27,0,0)": "3 / 24.0::DOUBLE", '=TIMEVALUE("2:24 AM")': "0.1", '=TIMEVALUE("18:30:36")': "(18 * 3600 + 30 * 60 + 36) / 86400.0::DOUBLE",
    "=NETWORKDAYS.INTL(DATE(2006,1,1),DATE(2006,1,31))": "22", "=NETWORKDAYS.INTL(DATE(2006,2,28),DATE(2006,1,31))": "-21", '=NETWORKDAYS.INTL(DATE(2006,1,1),DATE(2006,2,1),"0010001")': "(SELECT count(*) FROM range(0, 32) t(i) WHERE isodow(DATE '2006-01-01' + i::INT) NOT IN (3, 7))", "=WORKDAY(DATE(2008,10,1),151)": _SERIAL("2009-04-30"), "=WORKDAY.INTL(DATE(2012,1,1),30,17)": _SERIAL("2012-02-05"), "=INT(NOW())=TODAY()": "'TRUE'", "=TODAY()>DATE(2020,1,1)": "'TRUE'",
}

BATTERIES["battery_logic"] = {
    "=ISNA(NA())": "'TRUE'", "=NA()": "'#N/A'", "=TYPE(1)": "1", '=TYPE("a")': "2", "=TYPE(TRUE)": "4", "=ISERR(1/0)": "'TRUE'", "=ISERR(NA())": "'FALSE'", "=ISODD(3)": "'TRUE'", "=ISODD(-2.5)": "'FALSE'", "=ISLOGICAL(1>2)": "'TRUE'", '=ISLOGICAL("TRUE")': "'FALSE'", "=ISNONTEXT(1)": "'TRUE'", '=ISNONTEXT("a")': "'FALSE'", "=ISNUMBER(1)": "'TRUE'", '=ISNUMBER("1")': "'FALSE'", '=ISTEXT("a")': "'TRUE'", '=ISBLANK("")': "'FALSE'", "=ADDRESS(2,3)": "'$C$2'", "=ADDRESS(2,3,2)": "'C$2'", "=ADDRESS(2,30,4)": "'AD2'", '=HYPERLINK("http://x.org","name")': "'name'", '=HYPERLINK("http://x.org")': "'http://x.org'",
    **{f"=ISERROR({name}({args}))": "'TRUE'" for name, args in {"STOCKHISTORY": '"X",1', "RTD": '"p","s","t"', "CUBEKPIMEMBER": '"c","k",1', "CUBEMEMBER": '"c","m"', "CUBEMEMBERPROPERTY": '"c","m","p"', "CUBERANKEDMEMBER": '"c","s",1', "CUBESET": '"c","s"', "CUBESETCOUNT": '"s"', "CUBEVALUE": '"c"', "WEBSERVICE": '"http://x.org"'}.items()},
}

_D = lambda y, m, d: f"DATE({y},{m},{d})"
BATTERIES["battery_finance"] = {
    "=PV(RATE(48,-200,8000),48,-200)": "8000", "=PPMT(0.1/12,1,24,2000)": "-(2000 * 0.1 / 12 / (1 - (1 + 0.1 / 12) ** -24::DOUBLE) - 2000 * 0.1 / 12)", "=CUMIPMT(0.09/12,360,125000,1,1,0)": "-125000 * 0.09 / 12", "=CUMIPMT(0.09/12,360,125000,13,24,0)+CUMPRINC(0.09/12,360,125000,13,24,0)": "-12 * 125000 * 0.0075 / (1 - 1.0075::DOUBLE ** -360)", "=CUMPRINC(0.09/12,360,125000,1,1,0)": "-(125000 * 0.0075 / (1 - 1.0075::DOUBLE ** -360) - 125000 * 0.0075)",
    "=NPV(IRR({-70000,12000,15000,18000,21000,26000}),{12000,15000,18000,21000,26000})": "70000", "=MIRR({-120000,39000,30000,21000,37000,46000},0.1,0.12)": "((39000 * 1.12 ** 4 + 30000 * 1.12 ** 3 + 21000 * 1.12 ** 2 + 37000 * 1.12 + 46000) / 120000) ** 0.2::DOUBLE - 1",
    "=XNPV(0.09,{-10000,2750,4250,3250,2750},{39448,39508,39751,39859,39904})": "-10000 + 2750 * 1.09 ** (-60 / 365.0::DOUBLE) + 4250 * 1.09 ** (-303 / 365.0::DOUBLE) + 3250 * 1.09 ** (-411 / 365.0::DOUBLE) + 2750 * 1.09 ** (-456 / 365.0::DOUBLE)", "=XIRR({-10000,2750,4250,3250,2750},{39448,39508,39751,39859,39904},0.1)": "0.373362535",
    "=DB(1000000,100000,6,1,7)": "1000000 * 0.319 * 7 / 12", "=DB(1000000,100000,6,2,7)": "(1000000 - 1000000 * 0.319 * 7 / 12) * 0.319", "=DDB(2400,300,3650,1)": "2400 * 2 / 3650.0", "=DDB(2400,300,10,2,1.5)": "2400 * 0.85 * 0.15", "=VDB(2400,300,10,0,1)": "480", "=VDB(2400,300,10,0,10)": "2100", "=DOLLARFR(1.125,16)": "1.02", "=FVSCHEDULE(1,d[s])": "1.09 * 1.11 * 1.1", "=PDURATION(0.025,2000,2200)": "ln(1.1::DOUBLE) / ln(1.025::DOUBLE)",
    f"=COUPDAYBS({_D(2011,1,25)},{_D(2011,11,15)},2,1)": "71", f"=COUPDAYS({_D(2011,1,25)},{_D(2011,11,15)},2,1)": "181", f"=COUPDAYSNC({_D(2011,1,25)},{_D(2011,11,15)},2,1)": "110", f"=COUPNCD({_D(2011,1,25)},{_D(2011,11,15)},2,1)": _SERIAL("2011-05-15"), f"=COUPPCD({_D(2011,1,25)},{_D(2011,11,15)},2,1)": _SERIAL("2010-11-15"), f"=COUPNUM({_D(2007,1,25)},{_D(2008,11,15)},2,1)": "4",
    f"=PRICE({_D(2008,2,15)},{_D(2017,11,15)},0.0575,0.065,100,2,0)": "94.634361621322", f"=PRICE({_D(2008,2,15)},{_D(2016,11,15)},0.0575,YIELD({_D(2008,2,15)},{_D(2016,11,15)},0.0575,95.04287,100,2,0),100,2,0)": "95.04287", f"=YIELD({_D(2008,2,15)},{_D(2016,11,15)},0.0575,95.04287,100,2,0)": "0.065000006880731",
    f"=DURATION({_D(2018,7,1)},{_D(2048,1,1)},0.08,0.09,2,1)": "10.9191452815919", f"=MDURATION({_D(2018,7,1)},{_D(2048,1,1)},0.08,0.09,2,1)": "10.9191452815919 / 1.045", f"=DISC({_D(2018,7,1)},{_D(2048,1,1)},97.975,100,1)": "(100 - 97.975) / 100 / ((DATE '2048-01-01' - DATE '2018-07-01') / ((DATE '2049-01-01' - DATE '2018-01-01') / 31.0))", f"=PRICEDISC({_D(2008,2,16)},{_D(2008,3,1)},0.0525,100,2)": "100 - 0.0525 * 100 * 14 / 360.0", f"=YIELDDISC({_D(2008,2,16)},{_D(2008,3,1)},99.795,100,2)": "(100 - 99.795) / 99.795 * 360 / 14",
    f"=PRICEMAT({_D(2008,2,15)},{_D(2008,4,13)},{_D(2007,11,11)},0.061,0.061,0)": "99.98449888", f"=YIELDMAT({_D(2008,3,15)},{_D(2008,11,3)},{_D(2007,11,8)},0.0625,100.0123,0)": "0.060954333691538", f"=RECEIVED({_D(2008,2,15)},{_D(2008,5,15)},1000000,0.0575,2)": "1000000 / (1 - 0.0575 * 90 / 360.0)", f"=INTRATE({_D(2008,2,15)},{_D(2008,5,15)},1000000,1014420,2)": "14420 / 1000000.0 * 360 / 90",
    f"=TBILLYIELD({_D(2008,3,31)},{_D(2008,6,1)},98.45)": "(100 - 98.45) / 98.45 * 360 / 62", f"=TBILLEQ({_D(2008,3,31)},{_D(2008,6,1)},0.0914)": "365 * 0.0914 / (360 - 0.0914 * 62)", "=ACCRINTM(39539,39614,0.1,1000,3)": "1000 * 0.1 * 75 / 365", f"=ACCRINT({_D(2008,3,1)},{_D(2008,8,31)},{_D(2008,5,1)},0.1,1000,2,0)": "1000 * 0.1 * 60 / 360", "=AMORLINC(2400,39679,39813,300,1,0.15,1)": "360", "=AMORDEGRC(2400,39679,39813,300,1,0.15,1)": "776", "=AMORDEGRC(27370.88,39814,40179,0,2,0.0909,0)": "round(27370.88 * (1 - 0.0909 * 2.5) ** 2 * 0.0909 * 2.5)", "=AMORDEGRC(1000,39814,40179,0,1,0.4,0)": "round(1000 * 0.4 * 0.6)", "=AMORDEGRC(1000,39814,40179,0,1,0.4,2)": "'#NUM!'", "=AMORDEGRC(1000,39814,40179,0,1,0.5,0)": "'#NUM!'",
    f"=ODDFPRICE({_D(2008,11,11)},{_D(2021,3,1)},{_D(2008,10,15)},{_D(2009,3,1)},0.0785,0.0625,100,2,1)": "113.59771747407883", f"=ODDFYIELD({_D(2008,11,11)},{_D(2021,3,1)},{_D(2008,10,15)},{_D(2009,3,1)},0.0575,84.5,100,2,0)": "0.077245542", f"=ODDLPRICE({_D(2008,2,7)},{_D(2008,6,15)},{_D(2007,10,15)},0.0375,0.0405,100,2,0)": "99.87828601472134", f"=ODDLYIELD({_D(2008,4,20)},{_D(2008,6,15)},{_D(2007,12,24)},0.0375,99.875,100,2,0)": "0.045192229",
    '=EUROCONVERT(1.2,"DEM","EUR")': "0.61", '=EUROCONVERT(1,"FRF","DEM",TRUE)': "1 / 6.55957 * 1.95583",
}

#: Columns of the sheet d that formulas of ranges read; shorter ones end in blanks.
DATA = {
    "x": [2, 4, 6], "lx": [4.14, 4.19, 5.17], "s": [0.09, 0.11, 0.1], "t1": [3, 4, 5, 8, 9, 1, 2, 4, 5], "t2": [6, 19, 3, 2, 14, 4, 5, 17, 1], "f1": [6, 7, 9, 15, 21], "f2": [20, 28, 31, 38, 40], "z": [3, 6, 7, 8, 6, 5, 4, 2, 1, 9], "c1": [58, 35, 11, 25, 10, 23], "c2": [45.35, 47.65, 17.56, 18.44, 16.09, 16.91],
    "p1": [0, 1, 2, 3], "p2": [0.2, 0.3, 0.1, 0.4], "r": [13, 12, 11, 8, 4, 3, 2, 1, 1, 1], "e": [1, 2, 3, 6, 6, 6, 7, 8, 9], "q": [6, 7, 15, 36, 39, 40, 41, 42, 43, 47, 49], "k": [7, 3.5, 3.5, 1, 2], "g": [89, 88, 92, 101, 94, 97, 95], "m": [5.6, 4, 4, 3, 2, 4], "sk": [3, 4, 5, 2, 3, 4, 5, 6, 4, 7],
    "sd": [1345, 1301, 1368, 1322, 1310, 1370, 1318, 1350, 1303, 1299], "a1": [9, 7, 5, 3, 1], "a2": [10, 6, 1, 5, 3], "v1": [3, 2, 4, 5, 6], "v2": [9, 7, 12, 15, 17], "l1": [1, 9, 5, 7], "l2": [0, 4, 2, 3], "g1": [2, 4, 8], "g2": [1, 2, 3], "b": [79, 85, 78, 85, 50, 81, 95, 88, 97],
}
_SD = f"[{', '.join(f'{v}::DOUBLE' for v in DATA['sd'])}]"
_VAR = f"list_sum(list_transform({_SD}, lambda v: (v - list_avg({_SD})) ** 2))"
_CHI_SUM = " + ".join(f"({a} - {b}) ** 2 / {b}" for a, b in zip(DATA["c1"], DATA["c2"], strict=True))
BATTERIES["battery_samples"] = {
    "=T.TEST(d[t1],d[t2],2,1)": "0.196015785", "=TTEST(d[t1],d[t2],2,1)": "0.196015785", "=F.TEST(d[f1],d[f2])": "0.648317847", "=FTEST(d[f1],d[f2])": "0.648317847", "=Z.TEST(d[z],4)": "0.090574197", "=ZTEST(d[z],4,2.5)": f"1 - ({_PHI('1.1 * sqrt(10.0::DOUBLE) / 2.5')})",
    "=CHISQ.TEST(d[c1],d[c2])": f"1 - ({simpson('({x}) ** 1.5::DOUBLE * exp(-({x}) / 2) / (2 ** 2.5::DOUBLE * gamma(2.5::DOUBLE))', 0, _CHI_SUM, 20000)})", "=CHITEST(d[c1],d[c2])": f"1 - ({simpson('({x}) ** 1.5::DOUBLE * exp(-({x}) / 2) / (2 ** 2.5::DOUBLE * gamma(2.5::DOUBLE))', 0, _CHI_SUM, 20000)})",
    "=PROB(d[p1],d[p2],1,3)": "0.8", "=PROB(d[p1],d[p2],2)": "0.1", "=STANDARDIZE(42,40,1.5)": "2 / 1.5", "=PERCENTRANK.INC(d[r],4)": "0.555", "=PERCENTRANK(d[r],8)": "0.666", "=PERCENTRANK.EXC(d[e],7)": "0.7", "=QUARTILE.EXC(d[q],1)": "15", "=QUARTILE(d[q],1)": "quantile_cont(v, 0.25) FROM (SELECT unnest([6, 7, 15, 36, 39, 40, 41, 42, 43, 47, 49]) AS v)", "=PERCENTILE(d[k],0.3)": "quantile_cont(v, 0.3) FROM (SELECT unnest([7, 3.5, 3.5, 1, 2]::DOUBLE[]) AS v)",
    "=RANK(3.5,d[k],1)": "3", "=RANK.EQ(7,d[k],1)": "5", "=RANK.AVG(94,d[g])": "4", "=RANK.AVG(3.5,d[k],1)": "3.5", "=MODE(d[m])": "4", "=AVERAGEA(d[f1])": "11.6", "=MAXA(d[p2])": "0.4", "=MINA(d[p2])": "0.1", "=SKEW.P(d[sk])": "0.303193339", "=STDEV(d[sd])": f"sqrt({_VAR} / 9)", "=STDEVP(d[sd])": f"sqrt({_VAR} / 10)", "=STDEVA(d[sd])": f"sqrt({_VAR} / 9)", "=STDEVPA(d[sd])": f"sqrt({_VAR} / 10)", "=VAR(d[sd])": f"{_VAR} / 9", "=VARP(d[sd])": f"{_VAR} / 10", "=VARA(d[sd])": f"{_VAR} / 9", "=VARPA(d[sd])": f"{_VAR} / 10",
    "=PEARSON(d[a1],d[a2])": "0.699378606", "=COVAR(d[v1],d[v2])": "5.2", "=FORECAST(30,d[f1],d[f2])": "10.607253086", "=MODE.MULT(d[e])": "'[6.0]'", "=FREQUENCY(d[b],{70,79,89})": "'[1.0,2.0,4.0,2.0]'", "=LINEST(d[l1],d[l2])": "'[2.0,1.0]'", "=LOGEST(d[g1],d[g2])": "'[2.0,1.0]'",
}


def value_rows(spark: SparkSession, formulas: list[str]) -> DataFrame:
    """formula, number, text of each formula, a row each; truth values and errors are text."""
    book = Workbook(spark, errors="lane")
    longest = max(map(len, DATA.values()))
    book.sheet("d", [list(DATA), *([v[i] if i < len(v) else None for v in DATA.values()] for i in range(longest))], header=True)
    compiler = book.compiler()

    def row(f: str) -> Column:
        v = compiler.value(fx.parse(f))
        kind = spark.range(1).select(v.col.alias("v")).schema["v"].dataType.simpleString()
        error = v.err if v.err is not None else F.lit(None).cast("string")
        number, text, several = F.lit(None).cast("double"), F.lit(None).cast("string"), F.lit(None).cast("array<double>")
        if kind == "boolean":
            text = F.when(v.col, "TRUE").when(~v.col, "FALSE")
        elif kind == "string":
            text = v.col
        elif kind == "array<double>":
            several = v.col
        elif kind.startswith("array"):
            text = F.to_json(v.col)
        else:
            number = F.round(v.col.cast("double"), DIGITS) + F.lit(0.0)
        return F.struct(F.lit(f).alias("formula"), F.when(error.isNull(), number).alias("number"), F.coalesce(error, text).alias("text"), several.alias("several"))

    # Each row's cells are computed apart and stacked.
    names = [f"c{i}" for i in range(len(formulas))]
    cells = spark.range(1).select(*(row(f).alias(n) for n, f in zip(names, formulas, strict=True)))
    rounded = F.to_json(F.transform("r.several", lambda x: F.round(x, DIGITS) + F.lit(0.0)))
    return cells.select(F.explode(F.array(*names)).alias("r")).select("r.formula", "r.number", F.coalesce("r.text", rounded).alias("text"))


def battery_sql(cells: dict[str, str]) -> str:
    def one(f: str, sql: str) -> str:
        sql, source, table = sql.partition(" FROM (SELECT unnest")
        shown = f.replace("'", "''")
        is_text = sql.startswith(("'", "chr(", "left(", "right(", "lower(", "regexp_", "format(", "strftime(", "lpad(", "url_encode("))
        return f"SELECT '{shown}' AS formula, {'NULL::DOUBLE' if is_text else f'round(({sql})::DOUBLE, {DIGITS}) + 0.0'} AS number, {f'({sql})::VARCHAR' if is_text else 'NULL::VARCHAR'} AS text{source}{table}"

    return "\nUNION ALL ".join(one(f, s) for f, s in cells.items())
