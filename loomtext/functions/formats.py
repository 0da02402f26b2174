"""Dates, numbers and plural rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Grouping mark, decimal mark, currency pattern, percent pattern.
LOCALES = {"en": (",", ".", "¤#", "#%"), "de": (".", ",", "# ¤", "# %"), "fr": (" ", ",", "# ¤", "# %"), "es": (".", ",", "# ¤", "# %")}


def format_decimal(c: Column, digits: int = 2, locale: str = "en") -> Column:
    """Null for values that aren't finite."""
    group, point, _, _ = LOCALES[locale]
    finite = ~F.isnan(c) & (F.abs(c) < float("inf"))
    return F.when(finite, F.translate(F.format_number(c, digits), ",.", group + point))


def format_currency(c: Column, symbol: str, digits: int = 2, locale: str = "en") -> Column:
    pattern = LOCALES[locale][2].replace("¤", symbol)
    head, tail = pattern.split("#")
    return F.concat(F.when(c < 0, "-").otherwise(""), F.lit(head), format_decimal(F.abs(c), digits, locale), F.lit(tail))


def format_percent(c: Column, digits: int = 0, locale: str = "en") -> Column:
    head, tail = LOCALES[locale][3].split("#")
    return F.concat(F.lit(head), format_decimal(c * 100, digits, locale), F.lit(tail))


def parse_iso_date(c: Column) -> Column:
    return F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(c, "yyyy-MM-dd"))


def is_leap(year: Column) -> Column:
    return (year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0))


def days_in_month(date: Column) -> Column:
    return F.dayofmonth(F.last_day(date))


def iso_weekday(date: Column) -> Column:
    return F.weekday(date) + 1


def plural_operands(c: Column) -> Column:
    """struct<n, i, v, w, f, t> of a number's shortest decimal form: value, whole part, fraction digits with and without closing zeros
    (how many, and as a number). Null for values that aren't finite."""
    n = F.abs(c.cast("double"))
    text = F.regexp_replace(n.cast("decimal(38,12)").cast("string"), r"0+$", "")
    digits = F.substring_index(text, ".", -1)
    tail = F.when(digits == "", F.lit(0).cast("long")).otherwise(digits.cast("long"))
    size = F.length(digits)
    finite = ~F.isnan(n) & (n < 1e18)
    return F.when(finite, F.struct(n.alias("n"), F.floor(n).alias("i"), size.alias("v"), size.alias("w"), tail.alias("f"), tail.alias("t")))


def _within(x: Column, *ranges: tuple[int, int]) -> Column:
    out = F.lit(False)
    for a, b in ranges:
        out = out | x.between(a, b)
    return out


# The plural rules of the locale data, by language, in their order; what none takes is "other".
_WHOLE_ONE = lambda o: (o["i"] == 1) & (o["v"] == 0)
_IS_ONE = lambda o: o["n"] == 1
_UP_TO_ONE = lambda o: (o["i"] == 0) | (o["n"] == 1)
_ZERO_ONE = lambda o: o["i"].isin(0, 1)
_MILLIONS = lambda o: (o["v"] == 0) & (o["i"] != 0) & (o["i"] % 1_000_000 == 0)
_SLAVIC_ONE = lambda o: (o["v"] == 0) & (o["i"] % 10 == 1) & (o["i"] % 100 != 11)
_SLAVIC_FEW = lambda o: (o["v"] == 0) & (o["i"] % 10).between(2, 4) & ~(o["i"] % 100).between(12, 14)
_SLAVIC_MANY = lambda o: (o["v"] == 0) & ((o["i"] % 10 == 0) | (o["i"] % 10).between(5, 9) | (o["i"] % 100).between(11, 14))
_SOUTH_ONE = lambda o: _SLAVIC_ONE(o) | ((o["f"] % 10 == 1) & (o["f"] % 100 != 11))
_SOUTH_FEW = lambda o: _SLAVIC_FEW(o) | ((o["f"] % 10).between(2, 4) & ~(o["f"] % 100).between(12, 14))
_CARDINAL = {
    "en de nl sv et fi": [("one", _WHOLE_ONE)],
    "no nn da el bg hu tr ka ta ml": [("one", _IS_ONE)],
    "hi bn fa am": [("one", _UP_TO_ONE)],
    "pa": [("one", lambda o: o["n"].isin(0.0, 1.0))],
    "mr": [("one", _IS_ONE)],
    "hy": [("one", _ZERO_ONE)],
    "fr": [("one", _ZERO_ONE), ("many", _MILLIONS)],
    "pt": [("one", _ZERO_ONE), ("many", _MILLIONS)],
    "es": [("one", _IS_ONE), ("many", _MILLIONS)],
    "it": [("one", _WHOLE_ONE), ("many", _MILLIONS)],
    "ru uk": [("one", _SLAVIC_ONE), ("few", _SLAVIC_FEW), ("many", _SLAVIC_MANY)],
    "be": [("one", lambda o: (o["n"] % 10 == 1) & (o["n"] % 100 != 11)), ("few", lambda o: (o["v"] == 0) & (o["n"] % 10).between(2, 4) & ~(o["n"] % 100).between(12, 14)), ("many", _SLAVIC_MANY)],
    "pl": [("one", _WHOLE_ONE), ("few", _SLAVIC_FEW), ("many", lambda o: (o["v"] == 0) & (((o["i"] != 1) & (o["i"] % 10).isin(0, 1)) | (o["i"] % 10).between(5, 9) | (o["i"] % 100).between(12, 14)))],
    "cs sk": [("one", _WHOLE_ONE), ("few", lambda o: (o["v"] == 0) & o["i"].between(2, 4)), ("many", lambda o: o["v"] != 0)],
    "sr": [("one", _SOUTH_ONE), ("few", _SOUTH_FEW)],
    "mk is": [("one", _SOUTH_ONE)],
    "ro": [("one", _WHOLE_ONE), ("few", lambda o: (o["v"] != 0) | (o["n"] == 0) | ((o["n"] != 1) & (o["n"] % 100).between(1, 19)))],
    "he": [("one", lambda o: _WHOLE_ONE(o) | ((o["i"] == 0) & (o["v"] != 0))), ("two", lambda o: (o["i"] == 2) & (o["v"] == 0))],
    "ar": [("zero", lambda o: o["n"] == 0), ("one", _IS_ONE), ("two", lambda o: o["n"] == 2), ("few", lambda o: (o["v"] == 0) & (o["i"] % 100).between(3, 10)), ("many", lambda o: (o["v"] == 0) & (o["i"] % 100).between(11, 99))],
    "ja ko zh vi th id": [],
}
_ORDINAL = {
    "en": [("one", _SLAVIC_ONE), ("two", lambda o: (o["v"] == 0) & (o["i"] % 10 == 2) & (o["i"] % 100 != 12)), ("few", lambda o: (o["v"] == 0) & (o["i"] % 10 == 3) & (o["i"] % 100 != 13))],
    "fr vi ro hy": [("one", _IS_ONE)],
    "it": [("many", lambda o: (o["v"] == 0) & o["i"].isin(8, 11, 80, 800))],
    "sv": [("one", lambda o: (o["v"] == 0) & (o["i"] % 10).isin(1, 2) & ~(o["i"] % 100).isin(11, 12))],
    "uk": [("few", lambda o: (o["v"] == 0) & (o["i"] % 10 == 3) & (o["i"] % 100 != 13))],
    "be": [("few", lambda o: (o["v"] == 0) & (o["i"] % 10).isin(2, 3) & ~(o["i"] % 100).isin(12, 13))],
    "hu": [("one", lambda o: (o["v"] == 0) & o["i"].isin(1, 5))],
    "hi": [("one", _IS_ONE), ("two", lambda o: o["n"].isin(2.0, 3.0)), ("few", lambda o: o["n"] == 4), ("many", lambda o: o["n"] == 6)],
    "mr": [("one", _IS_ONE), ("two", lambda o: o["n"].isin(2.0, 3.0)), ("few", lambda o: o["n"] == 4)],
    "bn": [("one", lambda o: o["n"].isin(1.0, 5.0, 7.0, 8.0, 9.0, 10.0)), ("two", lambda o: o["n"].isin(2.0, 3.0)), ("few", lambda o: o["n"] == 4), ("many", lambda o: o["n"] == 6)],
}


def _category(c: Column, lang: str, rules: dict) -> Column:
    code = lang.replace("_", "-").split("-")[0]
    found = next((r for langs, r in rules.items() if code in langs.split()), [])
    operands = plural_operands(c)

    def chosen(o: Column) -> Column:
        out = F.lit("other")
        for name, rule in reversed(found):
            out = F.when(rule(o), name).otherwise(out)
        return out

    # bound once; a number that isn't finite is "other"
    return F.when(c.isNotNull(), F.transform(F.array(operands), chosen)[0])


def plural_cardinal(n: Column, lang: str = "en") -> Column:
    """The category of a count, fractions included; unknown languages have only "other"."""
    return _category(n, lang, _CARDINAL)


def plural_ordinal(n: Column, lang: str = "en") -> Column:
    return _category(n, lang, _ORDINAL)


def plural_ordinal_en(n: Column) -> Column:
    return plural_ordinal(n, "en")


def bounded(c: Column) -> Column:
    """A similarity or distance in [0, 1]; null outside, and for values that aren't finite."""
    return F.when(c.between(0.0, 1.0) & ~F.isnan(c), c)


def parse_iso_time(c: Column) -> Column:
    """Seconds of the day of hh:mm:ss, null for other texts."""
    part = lambda i: F.substring(c, i, 2).cast("int")
    return F.when(c.rlike(r"\A([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9]\z"), part(1) * 3600 + part(4) * 60 + part(7))


def parse_iso_datetime(c: Column) -> Column:
    """A timestamp without zone, the date and time parted by T or a blank; null for other texts."""
    return F.when(c.rlike(r"\A\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}\z"), F.try_to_timestamp(F.translate(c, "T", " "), F.lit("yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz"))


def locale_patterns(spark, locale: str, length: str) -> dict[str, str]:
    """The date, time and joined patterns of the JVM's locale data; ``length`` is short, medium, long or full.

    Times have no zone, so a long or full time is the medium one."""
    time = spark._jvm.java.time.format
    of = time.DateTimeFormatterBuilder.getLocalizedDateTimePattern
    style = lambda name: getattr(time.FormatStyle, name.upper())
    chronology, place = spark._jvm.java.time.chrono.IsoChronology.INSTANCE, spark._jvm.java.util.Locale.forLanguageTag(locale)
    clock = "medium" if length in ("long", "full") else length
    return {"date": of(style(length), None, chronology, place), "time": of(None, style(clock), chronology, place), "both": of(style(length), style(clock), chronology, place)}


def _localised(c: Column, kind: str, pattern: str, locale: str) -> Column:
    """Formatted in the JVM with the locale's names; the quote and separator are characters that no pattern has."""
    return F.when(c.isNotNull(), F.to_csv(F.struct(c.alias("v")), {kind: pattern, "locale": locale, "sep": "\x01", "quote": "\x02", "escape": "\x02", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}))


def format_date(spark, c: Column, locale: str = "en", length: str = "medium") -> Column:
    """Of a date column or ISO text; null for what isn't one."""
    return _localised(F.try_to_date(c.cast("string"), "yyyy-MM-dd"), "dateFormat", locale_patterns(spark, locale, length)["date"], locale)


def format_time(spark, c: Column, locale: str = "en", length: str = "medium") -> Column:
    """Of ISO text."""
    seconds = parse_iso_time(c)
    at = F.timestamp_add("SECOND", seconds, F.lit("2000-01-01 00:00:00").cast("timestamp_ntz"))
    return F.when(seconds.isNotNull(), _localised(at, "timestampNTZFormat", locale_patterns(spark, locale, length)["time"], locale))


def format_datetime(spark, c: Column, locale: str = "en", length: str = "medium") -> Column:
    """Of a timestamp without zone."""
    return _localised(c.cast("timestamp_ntz"), "timestampNTZFormat", locale_patterns(spark, locale, length)["both"], locale)


# Languages that group by two after the first three digits.
_INDIC = ("hi", "bn", "mr", "pa", "ta", "ml", "te", "gu", "kn")


def number_symbols(spark, locale: str) -> dict:
    """The JVM's marks and group sizes of a locale."""
    text = spark._jvm.java.text
    place = spark._jvm.java.util.Locale.forLanguageTag(locale)
    symbols = text.DecimalFormatSymbols.getInstance(place)
    pattern = text.NumberFormat.getNumberInstance(place).toPattern().split(";")[0].split(".")[0]
    groups = pattern.split(",")
    primary = len(groups[-1]) if len(groups) > 1 else 0
    # the JVM's patterns know one group size only
    indic = locale.split("-")[0] in _INDIC or locale.upper().endswith("-IN")
    return {"group": symbols.getGroupingSeparator(), "decimal": symbols.getDecimalSeparator(), "primary": primary, "secondary": 2 if indic else primary, "percent": text.NumberFormat.getPercentInstance(place).toPattern()}


def format_number(spark, c: Column, locale: str = "en", least: int = 0, most: int = 3) -> Column:
    """Rounded half even to ``most`` fraction digits, closing zeros dropped down to ``least``, grouped as the locale does. Null for values that aren't finite."""
    symbols = number_symbols(spark, locale)
    finite = ~F.isnan(c) & (F.abs(c) < float("inf"))
    # through the shortest decimal form, so that 2.675 is what it reads
    plain = F.bround(F.abs(c).cast("decimal(38,12)"), most).cast("string")
    whole, digits = F.substring_index(plain, ".", 1), F.substring(F.when(F.contains(plain, F.lit(".")), F.substring_index(plain, ".", -1)).otherwise(""), 1, most)
    kept = F.regexp_replace(digits, "0+$", "")
    kept = F.when(F.length(kept) < least, F.rpad(kept, least, "0")).otherwise(kept)
    if symbols["primary"]:
        whole = F.regexp_replace(whole, rf"(?<=\d)(?=(?:\d{{{symbols['secondary']}}})*\d{{{symbols['primary']}}}$)", symbols["group"].replace("$", "\\$"))
    text = F.when(kept == "", whole).otherwise(F.concat(whole, F.lit(symbols["decimal"]), kept))
    zero = F.translate(F.concat(plain, F.lit("")), "0.", "") == ""
    return F.when(finite, F.concat(F.when((c < 0) & ~zero, "-").otherwise(""), text))
