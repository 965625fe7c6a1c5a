"""Dates, numbers, ranges and prose windows out of text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Month names and number words.
MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
NUMBER_WORDS = ["zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve"]
#: The number words that drinking windows know, one to twenty and two more.
WINDOW_WORDS = {
    "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10,
    "eleven": 11, "twelve": 12, "thirteen": 13, "fourteen": 14, "fifteen": 15, "sixteen": 16, "seventeen": 17, "eighteen": 18,
    "nineteen": 19, "twenty": 20, "twenty-five": 25, "thirty": 30,
}
#: The phrases that name a number of years, the more special ones after those that come first.
YEARS = r"(\w+(?:-\w+)?)\s*(?:to\s*(\w+))?\s*"
OVER_NEXT, DEVELOP = rf"over the next {YEARS}years?", rf"develop\s+(?:over\s+)?(?:the\s+next\s+)?{YEARS}years?"
ENJOY_NOW, DRINK_NOW = rf"enjoy\s+now\s+and\s+(?:over\s+)?(?:the\s+next\s+)?{YEARS}years?", rf"drink\s+now\s+and\s+for\s+{YEARS}(?:more\s+)?years?"
BEST_FROM = r"best\s+(?:from|starting)\s+((?:19|20)\d{2})\s*(?:(?:to|through|-)\s*((?:19|20)\d{2}))?"
BETWEEN = r"\b((?:19|20)\d{2})\s*[-–]\s*((?:19|20)\d{2})\b"


def _part(c: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def informal_date(c: Column) -> Column:
    """ISO date text of an ISO prefix, ``Month D, YYYY`` or ``Month YYYY`` (day 01), unchecked."""
    low = F.lower(F.trim(c))
    month = F.lpad(F.array_position(F.array(*map(F.lit, MONTHS)), F.regexp_extract(low, "^([a-z]+)", 1)).cast("string"), 2, "0")
    month = F.nullif(month, F.lit("00"))
    long_form = F.concat_ws("-", _part(low, r"^[a-z]+ \d{1,2},? (\d{4})$"), month, F.lpad(_part(low, r"^[a-z]+ (\d{1,2}),? \d{4}$"), 2, "0"))
    short_form = F.concat_ws("-", _part(low, r"^[a-z]+ (\d{4})$"), month, F.lit("01"))
    return F.when(low.rlike(r"^\d{4}-\d{2}-\d{2}"), F.substring(low, 1, 10)).when(low.rlike(r"^[a-z]+ \d{1,2},? \d{4}$") & month.isNotNull(), long_form).when(
        low.rlike(r"^[a-z]+ \d{4}$") & month.isNotNull(), short_form
    )


def us_date(c: Column) -> Column:
    """ISO date text of MM/DD/YYYY, else null."""
    t = F.trim(c)
    return F.when(t.rlike(r"^\d{2}/\d{2}/\d{4}$"), F.regexp_replace(t, r"^(\d{2})/(\d{2})/(\d{4})$", "$3-$1-$2"))


def number_range(c: Column) -> Column:
    """struct(low, high) of ``a-b``, ``a–b`` or a single number."""
    low, high = _part(c, r"(\d+)\s*[-–]\s*\d+"), _part(c, r"\d+\s*[-–]\s*(\d+)")
    one = _part(c, r"(\d+)")
    return F.struct(F.coalesce(low, one).cast("int").alias("low"), F.coalesce(high, one).cast("int").alias("high"))


def amount(c: Column, unit: str) -> Column:
    """The number before a unit, which may stand in the plural."""
    return _part(F.lower(c), rf"(\d+(?:\.\d+)?)\s*{unit}s?").cast("double")


def area(c: Column) -> Column:
    """The number that a text begins with, without its thousands separators; a unit may follow."""
    return _part(F.trim(F.replace(c, F.lit(","), F.lit(""))), r"^(\d+(?:\.\d+)?|\.\d+)").cast("double")


def new_share(c: Column) -> Column:
    """The percentage that stands right before "new"."""
    return _part(F.lower(c), r"(\d+)%\s*new").cast("double")


def high_percent(c: Column) -> Column:
    """The upper end of ``a-b%`` or of ``b%``."""
    return _part(c, r"(?:\d+(?:\.\d+)?\s*[-–]\s*)?(\d+(?:\.\d+)?)\s*%").cast("double")


def millilitres(size: Column, unit: Column) -> Column:
    value = size.try_cast("double")
    return F.when(F.upper(unit) == "L", value * 1000).when(F.upper(unit) == "ML", value)


def plain_number(c: Column) -> Column:
    """The number without currency, percent signs and thousands separators."""
    return F.nullif(F.regexp_replace(c, r"[$%€,\s]", ""), F.lit("")).try_cast("double")


def number_word(c: Column) -> Column:
    """The value of a number word or of digits."""
    words = {w: i for i, w in enumerate(NUMBER_WORDS)} | MORE_WORDS
    table = F.create_map(*[F.lit(x) for pair in words.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.lower(F.trim(c))), F.trim(c).try_cast("long"))


def drinking_window(c: Column, vintage: Column, now: Column) -> Column:
    """struct(start, end) of years, by the first phrase that fits and names a number; null without any.

    Years count from the vintage, or from ``now`` where there is none; "best from" without an end
    lasts ten years.
    """
    low = F.lower(c)
    base = F.coalesce(vintage, now)

    def number(pattern: str, group: int) -> Column:
        found = F.regexp_extract(low, pattern, group)
        words = F.create_map(*[F.lit(x) for pair in WINDOW_WORDS.items() for x in pair])
        value = F.when(found.rlike("^[0-9]+$"), found.try_cast("int")).otherwise(F.try_element_at(words, found))
        return F.nullif(value, F.lit(0))

    pair = lambda start, end: F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"))
    span = lambda p: F.coalesce(number(p, 2), number(p, 1))
    fits = lambda p: low.rlike(p) & number(p, 1).isNotNull()
    a, b = (_part(low, BETWEEN, g).cast("int") for g in (1, 2))
    since = _part(low, BEST_FROM).cast("int")
    return (
        F.when(fits(OVER_NEXT), pair(now, base + span(OVER_NEXT)))
        .when(fits(DEVELOP), pair(base + F.greatest(F.lit(1), F.floor(number(DEVELOP, 1) / 3)), base + span(DEVELOP)))
        .when(fits(ENJOY_NOW), pair(now, now + span(ENJOY_NOW)))
        .when(fits(DRINK_NOW), pair(now, now + span(DRINK_NOW)))
        .when(low.rlike(BEST_FROM), pair(since, F.coalesce(_part(low, BEST_FROM, 2).cast("int"), since + 10)))
        .when((a < b) & (a >= 1980) & (b <= 2080), pair(a, b))
    )


def guarded_year(c: Column, low: int = 1800, high: int = 2030) -> Column:
    value = c.try_cast("int")
    return F.when(value.between(low, high), value)


def guarded_count(c: Column) -> Column:
    """A positive count, commas and the word ``cases`` left out."""
    value = F.trim(F.regexp_replace(c, "(?i)cases|,", "")).try_cast("long")
    return F.when(value > 0, value)


def is_barcode(c: Column) -> Column:
    return F.coalesce(c.rlike(r"^\d{8,14}$"), F.lit(False))


def duration(seconds: Column) -> Column:
    """h:mm:ss."""
    s = seconds.cast("long")
    return F.format_string("%d:%02d:%02d", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60)


#: Number words of the second kind of windows, beyond those of ``NUMBER_WORDS``.
MORE_WORDS = {
    "thirteen": 13, "fourteen": 14, "fifteen": 15, "sixteen": 16, "seventeen": 17, "eighteen": 18, "nineteen": 19, "twenty": 20,
    "twenty-one": 21, "twenty-two": 22, "twenty-three": 23, "twenty-four": 24, "twenty-five": 25,
    "thirty": 30, "thirty-five": 35, "forty": 40, "fifty": 50,
}
YEARS_ON = r"([\w-]+)\s+(?:to\s+([\w-]+)\s+)?years?"
#: Phrases that name a number of years from the vintage on, the first that fits.
SPANS = [
    r"(?i)(?:over|for)\s+the\s+next\s+" + YEARS_ON,
    r"(?i)(?:develop|improve|evolve|age)\s+(?:over|for)\s+(?:the\s+next\s+)?" + YEARS_ON,
    r"(?i)enjoy\s+(?:now\s+and\s+)?(?:over|for)\s+(?:the\s+next\s+)?" + YEARS_ON,
    r"(?i)drink\s+now\s+and\s+(?:over|for)\s+(?:the\s+next\s+)?" + YEARS_ON,
]


def word_or_number(c: Column) -> Column:
    """The value of a number word from one to fifty or of digits, else null; zero counts as none."""
    words = {w: i for i, w in enumerate(NUMBER_WORDS) if i} | MORE_WORDS
    table = F.create_map(*[F.lit(x) for pair in words.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.lower(c)), F.nullif(F.when(c.rlike(r"^-?\d+$"), c).try_cast("int"), F.lit(0)))


def window_from_vintage(c: Column, vintage: Column) -> Column:
    """struct(start, end): from the vintage for the years that a phrase names, or from a year on for fifteen, or a span of years.

    Null without a text or a vintage, and where no phrase names a number.
    """
    pair = lambda start, end: F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"))
    part = lambda p, g: F.nullif(F.regexp_extract(c, p, g), F.lit(""))
    out = F.lit(None)
    span = r"(\d{4})\s*[-–]\s*(\d{4})"
    a, b = part(span, 1).cast("int"), part(span, 2).cast("int")
    out = F.when((a >= 1990) & (a <= 2050) & (b >= a) & (b <= 2100), pair(a, b))
    since = part(r"(?i)best\s+(?:from|after)\s+(\d{4})", 1).cast("int")
    out = F.when(since.isNotNull(), pair(since, since + 15)).otherwise(out)
    for phrase in reversed(SPANS):
        # Where the second number stands it counts, whether or not it can be read.
        years = F.when(part(phrase, 2).isNotNull(), word_or_number(part(phrase, 2))).otherwise(word_or_number(part(phrase, 1)))
        out = F.when(years.isNotNull(), pair(vintage, vintage + years)).otherwise(out)
    return F.when((c != "") & (vintage != 0), out)


#: Where a price stands in a page, the first that fits.
PRICES = [r"(?i)Item\s*Price\s*\$(\d+\.?\d*)", r"(?i)\$(\d+\.?\d*)\s*/?\s*750\s*ml", r'(?i)class="[^"]*price[^"]*"[^>]*>\s*\$(\d+\.?\d*)']


def page_price(c: Column) -> Column:
    """The price of a page, null without any."""
    return F.coalesce(*[_part(c, p).cast("double") for p in PRICES])
