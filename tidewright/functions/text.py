"""Scalar parsing and cleaning as Column expressions. They also run unchanged on streaming DataFrames.

Unless said otherwise null gives null and what can't be parsed gives null. Java's
``\\s \\d \\w`` match ASCII only; patterns here start with ``(?U)`` where Unicode counts.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Placeholders, words, patterns, factors and formats that results depend on.
PLACEHOLDERS = ("", "UNKNOWN", "N/A", "NA", "NONE", "NULL", "NAN", "-", "?", "TBD", "ERROR", "MISSING", "NOT RECORDED", "UNDEFINED")
TRUE_WORDS, FALSE_WORDS = ("true", "t", "yes", "y", "1"), ("false", "f", "no", "n", "0")
EMAIL = r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$"
MONEY = r"(?i)^\s*(?:usd|inr|rs\.?|eur|gbp|[$€£₹])?\s*(-?[\d,]*\.?\d+)\s*(k)?\s*(?:usd|inr|eur|gbp)?\s*$"
RATIO = r"^\s*(\d+(?:\.\d+)?)\s*/\s*(\d+(?:\.\d+)?)\s*$"
PERCENT = r"^\s*(-?\d+(?:\.\d+)?)\s*%\s*$"
DATE_HINT = r"\d{1,4}[-/.]\d{1,2}[-/.]\d{1,4}|[A-Za-z]{3,9}\s+\d{1,2},?\s+\d{4}"
MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"
CM_PER_FOOT, CM_PER_INCH, KG_PER_POUND = 30.48, 2.54, 0.453592

#: Two digits of a year from this one on are of the last century.
CENTURY = 69
_MONTH = "jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sep(?:t|tember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?"
_DAY_NAME, _ORDINAL = r"(?i)^(?:(?:mon|tues?|wed(?:nes)?|thu(?:rs)?|fri|sat(?:ur)?|sun)(?:day)?,?\s+)?", r"(\d{1,2})(?:st|nd|rd|th)?"
_END = r"(?!\d)"
#: Forms of dates by number, and what puts year, month and day in order. Each acts on what the ones before it left.
_FORMS = (
    (rf"^(\d{{4}})[-/.](\d{{1,2}})[-/.](\d{{1,2}}){_END}", "$1-$2-$3"),
    (rf"^(\d{{4}})(\d\d)(\d\d){_END}", "$1-$2-$3"),
    (rf"^(\d{{1,2}}[-/.]\d{{1,2}}[-/.])({CENTURY // 10}[{CENTURY % 10}-9]|[{CENTURY // 10 + 1}-9]\d){_END}", "$119$2"),
    (rf"^(\d{{1,2}}[-/.]\d{{1,2}}[-/.])(\d\d){_END}", "$120$2"),
    (rf"^(0?[1-9]|1[0-2])[-/.](\d{{1,2}})[-/.](\d{{4}}){_END}", "$3-$1-$2"),
    (rf"^(1[3-9]|[23]\d)[-/.](\d{{1,2}})[-/.](\d{{4}}){_END}", "$3-$2-$1"),
)
_NAMED = (
    (rf"{_DAY_NAME}({_MONTH})\.?[\s-]+{_ORDINAL},?[\s-]+(\d{{4}}){_END}", "$3-$1-$2"),
    (rf"{_DAY_NAME}{_ORDINAL}[\s-]+({_MONTH})\.?,?[\s-]+(\d{{4}}){_END}", "$3-$2-$1"),
)
#: Rarer forms, and what makes common ones of them: a zone by name or by hours, fourteen digits, two digits of a year after a month's name, and months without a day.
_RARE = (
    (r"(?i)(?<=:\d\d|\.\d{1,9})\s*(?:gmt|utc)$", "Z"),
    (r"(?<=:\d\d|\.\d{1,9})\s*([+-]\d\d)$", "$1:00"),
    (r"^(\d{4})(\d\d)(\d\d)T?(\d\d)(\d\d)(\d\d)(?!\d)", "$1-$2-$3 $4:$5:$6"),
    (rf"(?i)^(\d{{1,2}}[\s-]+(?:{_MONTH})\.?,?[\s-]+)({CENTURY // 10}[{CENTURY % 10}-9]|[{CENTURY // 10 + 1}-9]\d)$", "$119$2"),
    (rf"(?i)^(\d{{1,2}}[\s-]+(?:{_MONTH})\.?,?[\s-]+)(\d\d)$", "$120$2"),
    (rf"(?i)^({_MONTH})\.?,?[\s-]+(\d{{4}})$", "$1 1, $2"),
    (r"^(\d{4})[-/.](\d{1,2})$", "$1-$2-1"),
)
_ZONE = r"(?<=:\d\d|\.\d{1,9})\s*(?:Z|([+-]\d\d):?(\d\d))$"
_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def to_double(c: Column) -> Column:
    """A plain decimal number; unlike a cast, not ``1d`` or ``NaN``."""
    return F.when(c.rlike(_NUMBER), F.trim(c).try_cast("double"))


def trim_whitespace(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def collapse_whitespace(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def strip_special_characters(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)[^a-zA-Z0-9\s]", "")


def normalize_case(c: Column) -> Column:
    return F.lower(c)


def remove_line_breaks(c: Column) -> Column:
    return F.regexp_replace(c, r"[\r\n]+", " ")


def remove_non_ascii(c: Column) -> Column:
    return F.regexp_replace(c, r"[^\x00-\x7F]", "")


def null_placeholders(c: Column, placeholders=PLACEHOLDERS) -> Column:
    """Null for a placeholder in any case, white space around it aside."""
    return null_words(c, trim_whitespace(c), placeholders)


def null_words(c: Column, trimmed: Column, placeholders=PLACEHOLDERS) -> Column:
    """The same, given the trimmed value."""
    return F.when(~F.upper(trimmed).isin(list(placeholders)), c)


def parse_currency(c: Column, keep_sign: bool = False) -> Column:
    """Digits and dots with a final M or K. The sign is lost, as it always was, unless ``keep_sign``."""
    kept = F.regexp_replace(F.upper(c), r"[^0-9.MK]", "")
    times = F.when(kept.endswith("M"), 1_000_000.0).when(kept.endswith("K"), 1_000.0).otherwise(1.0)
    value = to_double(F.regexp_replace(kept, "[MK]$", "")) * times
    return F.when(c.rlike(r"^\s*[^0-9]*-"), -value).otherwise(value) if keep_sign else value


def parse_number(c: Column) -> Column:
    """Money with symbols, commas, codes and k; ``x/y`` is scaled to five."""
    up, down = F.regexp_extract(c, RATIO, 1).try_cast("double"), F.regexp_extract(c, RATIO, 2).try_cast("double")
    ratio = F.when(down == 5, up).when(down != 0, up / down * 5)
    # what doesn't match gives an empty text, and so null; the rarer patterns are tried only where their sign is there
    money = F.replace(F.regexp_extract(c, MONEY, 1), F.lit(","), F.lit("")).try_cast("double")
    thousands = F.lower(c).contains("k") & (F.regexp_extract(c, MONEY, 2) != "")
    return F.when(c.contains("/"), ratio).otherwise(money * F.when(thousands, 1000.0).otherwise(1.0))


def parse_percentage(c: Column) -> Column:
    """The number without percent signs, always divided by 100."""
    return to_double(F.replace(c, F.lit("%"), F.lit(""))) / 100


def parse_fraction(c: Column) -> Column:
    """``15%``, ``0.15`` and ``15`` all give 0.15."""
    return fraction_of(c, parse_number(c))


def fraction_of(c: Column, number: Column) -> Column:
    """The same, given the number parsed from ``c``; it is named in no branch, so that Spark computes it once."""
    scaled = number / (F.lit(1.0) + F.lit(99.0) * (number > 1).cast("double"))
    return F.when(c.contains("%"), F.regexp_extract(c, PERCENT, 1).try_cast("double") / 100).otherwise(scaled)


def parse_rating(c: Column) -> Column:
    """The first number in the text."""
    return F.regexp_substr(c, F.lit(r"\d+(?:\.\d+)?")).try_cast("double")


def parse_height(c: Column) -> Column:
    """Feet and inches to centimetres."""
    pattern, low = r"(\d+)\s*(?:'|ft)\s*(\d+)?", F.lower(c)
    feet, inches = F.regexp_extract(low, pattern, 1).try_cast("double"), F.regexp_extract(low, pattern, 2).try_cast("double")
    return feet * CM_PER_FOOT + F.coalesce(inches, F.lit(0.0)) * CM_PER_INCH


def parse_weight(c: Column) -> Column:
    """Pounds or kilograms to kilograms."""
    pattern, low = r"([\d.]+)\s*(lbs?|kg)", F.lower(c)
    amount = to_double(F.regexp_extract(low, pattern, 1))
    return F.when(F.regexp_extract(low, pattern, 2).startswith("lb"), amount * KG_PER_POUND).otherwise(amount)


def _ordered(c: Column, forms) -> Column:
    for pattern, order in forms:
        c = F.regexp_replace(c, pattern, order)
    return c


def parse_datetime(c: Column) -> Column:
    """A date with or without a time, as a timestamp without a zone.

    Year, month and day, or month before day whatever the separator, unless the
    first number can only be a day; eight digits; a month's name before or after
    the day. Two digits of a year are from 1969 to 2068. The time may have
    fractions (of which six digits count), AM or PM, and a zone, which is
    taken to UTC. A month without a day is its first. The parts are put into one order by patterns, each of which is
    evaluated once, and parsed once; a date that doesn't exist is null.
    """
    trimmed = trim_whitespace(c)
    trimmed = F.when(trimmed.rlike("|".join(f"(?:{x})" for x, _ in _RARE)), _ordered(trimmed, _RARE)).otherwise(trimmed)
    named = _ordered(trimmed, _NAMED)
    month = F.floor((F.instr(F.lit(MONTHS), F.lower(F.substring(named, 6, 3))) + 2) / 3).cast("string")
    named = F.concat(F.substring(named, 1, 5), month, F.regexp_replace(named, r"^\d{4}-[A-Za-z]+", ""))
    date = F.when(trimmed.rlike(r"[A-Za-z]{3}"), named).otherwise(_ordered(trimmed, _FORMS))
    date = F.regexp_replace(F.regexp_replace(date, r"(?<=-\d{1,2})[ T]+(?=\d{1,2}:)", " "), r"(?<=\.\d{6})\d+", "")
    half = F.upper(F.regexp_replace(date, r"(?i)\s*([ap]m)$", " $1"))
    local = F.regexp_replace(date, _ZONE, "")
    shift = F.make_dt_interval(F.lit(0), F.regexp_extract(date, _ZONE, 1).try_cast("int"), F.concat(F.regexp_extract(date, _ZONE, 1).substr(1, 1), F.regexp_extract(date, _ZONE, 2)).try_cast("int"))
    plain = lambda x, form: F.try_to_timestamp(x, F.lit(form)).cast("timestamp_ntz")
    whole = "yyyy-M-d[ H:m[:s[.SSSSSS]]]"
    return (
        F.when(date.rlike(r"(?i)[ap]m$"), plain(half, "yyyy-M-d h:m[:s[.SSSSSS]] a"))
        .when(date.rlike(r":\d\d.*[+-]\d\d:?\d\d$"), plain(local, whole) - shift)
        .when(date.endswith("Z"), plain(local, whole))
        .when(date.rlike(r"^\d{4}-"), plain(date, whole))
    )


def null_future(c: Column, as_of: datetime) -> Column:
    """Null for what lies after ``as_of``, which is given so that results repeat."""
    return F.when(~(c > F.lit(as_of).cast("timestamp_ntz")), c)


def standardize_boolean(c: Column) -> Column:
    low = F.lower(trim_whitespace(c.cast("string")))
    return F.when(low.isin(*TRUE_WORDS, "1.0"), True).when(low.isin(*FALSE_WORDS, "0.0"), False)


def normalize_phone(c: Column) -> Column:
    digits = F.regexp_replace(c, r"(?U)\D", "")
    return F.when(digits != "", digits)


def normalize_phone10(c: Column) -> Column:
    """Ten digits, after a leading 91 of twelve is dropped."""
    digits = F.regexp_replace(c, r"(?U)\D", "")
    short = F.when((F.length(digits) == 12) & digits.startswith("91"), F.substring(digits, 3, 10)).otherwise(digits)
    return F.when(F.length(short) == 10, short)


def normalize_email(c: Column) -> Column:
    return F.when(c.rlike(EMAIL), F.lower(c))


def map_values(c: Column, mapping: dict) -> Column:
    """Exact replacement by a small mapping; other values stay. For large ones use :func:`map_values_table`."""
    if not mapping:
        return c
    pairs = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, c), c)


def map_values_table(df: DataFrame, column: str, mapping: DataFrame) -> DataFrame:
    """Exact replacement by a table (old, new) with distinct old values; Spark picks the join."""
    m = mapping.select(F.col("old").alias("__old"), F.col("new").alias("__new"))
    return df.join(m, df[column] == F.col("__old"), "left").withColumn(column, F.coalesce("__new", column)).drop("__old", "__new")


def has_time(c: Column) -> Column:
    """Whether a timestamp has a time of day."""
    return c.cast("timestamp_ntz") != F.date_trunc("day", c).cast("timestamp_ntz")


def date_part(c: Column, part: str) -> Column:
    """year, month or day of a date, a timestamp, or text."""
    return {"year": F.year, "month": F.month, "day": F.dayofmonth}[part](c)
