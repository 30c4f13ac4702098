from datetime import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewright.functions import casts, rules, text


def values(spark, change, given, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(given)], f"i int, v {kind}")
    return [r["x"] for r in df.select("i", change(F.col("v")).alias("x")).orderBy("i").collect()]


CASES = [
    (text.parse_currency, ["$67.5M", "120.3m", "45K", "100", "n/a", None, "-5", "12K5", "Rs. 49.50"], [67.5e6, 120.3e6, 45e3, 100.0, None, None, 5.0, None, None]),
    (text.parse_number, ["$1,200", "55k", "USD 72,500", "4.5/5", "8/10", "3/0", "abc", "$-5", "-$5", "29.99 USD", "Rs. 49.50", None, ""], [1200.0, 55e3, 72500.0, 4.5, 4.0, None, None, -5.0, None, 29.99, 49.5, None, None]),
    (text.parse_percentage, ["99.9%", "100 %", "x", None], [pytest.approx(0.999), 1.0, None, None]),
    (text.parse_fraction, ["15%", "15 %", "0.15", "15", "x", None], [0.15, 0.15, 0.15, 0.15, None, None]),
    (text.parse_rating, ["4.5/5", "Rated 5.0", "none", None], [4.5, 5.0, None, None]),
    (text.parse_height, ["5'7\"", "5 ft 7 in", "6'", "tall", None], [pytest.approx(170.18), pytest.approx(170.18), pytest.approx(182.88), None, None]),
    (text.parse_weight, ["159lbs", "72kg", "1 lb", "heavy", "..kg", None], [pytest.approx(72.121128), 72.0, pytest.approx(0.453592), None, None, None]),
    (text.normalize_phone, ["(934) 854-1776", "none", None], ["9348541776", None, None]),
    (text.normalize_phone10, ["+91 9748541776", "934.854.1776", "12", None], ["9748541776", "9348541776", None, None]),
    (text.normalize_email, ["A.B@C.Com", "x@", "x at y", None], ["a.b@c.com", None, None, None]),
    (text.standardize_boolean, ["Yes", "N", "TRUE", "0", "1.0", "maybe", None], [True, False, True, False, True, None, None]),
    (text.trim_whitespace, ["\t a b \n", None], ["a b", None]),
    (text.collapse_whitespace, ["  a \t\n b  ", None], ["a b", None]),
    (text.strip_special_characters, ["he!!o-w@rld 1"], ["heowrld 1"]),
    (text.remove_line_breaks, ["a\r\n\nb"], ["a b"]),
    (text.remove_non_ascii, ["café"], ["caf"]),
    (text.null_placeholders, [" n/a ", "", "-", "x", "Not Recorded", None], [None, None, None, "x", None, None]),
    (lambda c: rules.validate(c, "email"), ["a@b.co", "bad", None], ["a@b.co", None, None]),
    (lambda c: rules.validate(c, "uuid"), ["123e4567-e89b-12d3-a456-426614174000", "123"], ["123e4567-e89b-12d3-a456-426614174000", None]),
    (lambda c: rules.validate(c, "country_code"), ["US", "usa", "USA"], ["US", None, "USA"]),
]


@pytest.mark.parametrize("change, given, want", CASES)
def test_text(spark, change, given, want):
    assert values(spark, change, given) == want


def test_dates(spark):
    given = ["2020-05-10", "5/10/2020", "2020/05/10", "May 10 2020", "May 10, 2020", "september 1 2020", "10.05.2020", "00/00/0000", "2031-02-30", "not recorded", None, "2020-05-10 14:05", "2020-05-10T14:05:06"]
    day = datetime(2020, 5, 10)
    want = [day, day, day, day, day, datetime(2020, 9, 1), datetime(2020, 10, 5), None, None, None, None, datetime(2020, 5, 10, 14, 5), datetime(2020, 5, 10, 14, 5, 6)]
    assert values(spark, text.parse_datetime, given) == want
    assert values(spark, lambda c: text.null_future(text.parse_datetime(c), datetime(2020, 5, 10)), ["2020-05-10", "2020-05-11", None]) == [day, None, None]


def test_forms_of_dates(spark):
    at = datetime(2020, 1, 2, 3, 4, 5)
    cases = {
        "13/02/2020": datetime(2020, 2, 13), "13.02.2020": datetime(2020, 2, 13), "01.02.2020": datetime(2020, 1, 2), "1-2-2020": datetime(2020, 1, 2), "2020.1.2": datetime(2020, 1, 2),
        "2 Jan 2020": datetime(2020, 1, 2), "2-Jan-2020": datetime(2020, 1, 2), "2nd January, 2020": datetime(2020, 1, 2), "Thu, 2 Jan 2020": datetime(2020, 1, 2), "JAN. 2, 2020": datetime(2020, 1, 2),
        "1/2/99": datetime(1999, 1, 2), "1/2/20": datetime(2020, 1, 2), "1/2/69": datetime(1969, 1, 2), "20200102": datetime(2020, 1, 2), "2020-01-02T03:04:05Z": at, "2020-01-02T03:04:05.5": at.replace(microsecond=500_000),
        "2020-01-02 03:04:05.123456789": at.replace(microsecond=123_456), "2020-01-02T03:04:05+05:30": datetime(2020, 1, 1, 21, 34, 5), "2020-01-02T03:04:05-0030": datetime(2020, 1, 2, 3, 34, 5),
        "1/2/2020 3:04 PM": datetime(2020, 1, 2, 15, 4), "Jan 2 2020 12:04:05 am": datetime(2020, 1, 2, 0, 4, 5), "2 Jan 2020 03:04:05": at, "20200102T03:04": datetime(2020, 1, 2, 3, 4),
        "13/13/2020": None, "2020-13-01": None, "2020-02-30T01:02:03Z": None, "1/2": None, "12345": None, "2020": None, "may be": None, "": None, "2020-01-02 25:00": None, "202001021": None, "2020-01-02 x": None,
    }
    got = dict(zip(cases, values(spark, text.parse_datetime, list(cases))))
    assert got == cases


def test_casts(spark):
    assert values(spark, lambda c: casts.cast_type(c, T.StringType(), "int64"), ["1.5", "2.5", "x", "1d", None]) == [2, 2, None, None, None]
    assert values(spark, lambda c: casts.cast_type(c, T.StringType(), "float64"), ["1e3", "NaN", "1d"]) == [1000.0, None, None]
    assert values(spark, lambda c: casts.cast_type(c, T.DoubleType(), "int64"), [0.5, 1.5, None], "double") == [0, 2, None]
    assert values(spark, lambda c: casts.cast_type(c, T.StringType(), "bool"), ["False", "0", "yes", None]) == [False, False, True, None]
    with pytest.raises(ValueError):
        casts.cast_type(F.col("v"), T.StringType(), "complex")


def test_domains_and_maps(spark):
    assert values(spark, lambda c: rules.apply_domain(c, "age"), [15, 16, 100, 101, None], "int") == [None, 16, 100, None, None]
    assert values(spark, lambda c: rules.apply_domain(c, "quantity"), [0, 1], "int") == [None, 1]
    assert values(spark, lambda c: text.map_values(c, {"a": "b"}), ["a", "c", None]) == ["b", "c", None]
    df = spark.createDataFrame([("a",), ("c",), (None,)], "v string")
    assert sorted(str(r[0]) for r in text.map_values_table(df, "v", spark.createDataFrame([("a", "b")], "old string, new string")).collect()) == ["None", "b", "c"]
