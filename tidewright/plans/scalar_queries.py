"""Queries of the scalar functions over dirty orders: (order_id, value) each, with SQL that gives the same rows."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import casts, rules, text
from . import dirty

_MONEY = text.MONEY.removeprefix("(?i)")  # the SQL lowers the text instead
_NUMBER_SQL = (
    "CASE WHEN regexp_matches({c}, '" + text.RATIO + "') THEN CASE WHEN regexp_extract({c}, '" + text.RATIO + "', 2)::DOUBLE = 5 THEN regexp_extract({c}, '" + text.RATIO + "', 1)::DOUBLE "
    "ELSE regexp_extract({c}, '" + text.RATIO + "', 1)::DOUBLE / nullif(regexp_extract({c}, '" + text.RATIO + "', 2)::DOUBLE, 0) * 5 END "
    "WHEN regexp_matches(lower({c}), '" + _MONEY + "') THEN TRY_CAST(replace(regexp_extract(lower({c}), '" + _MONEY + "', 1), ',', '') AS DOUBLE) * CASE WHEN regexp_extract(lower({c}), '" + _MONEY + "', 2) = 'k' THEN 1000 ELSE 1 END END"
)
_DATE_SQL = "TRY_STRPTIME({c}, ['%Y-%m-%d', '%m/%d/%Y', '%Y/%m/%d'])"
_KEPT = "regexp_replace(upper(price_txt), '[^0-9.MK]', '', 'g')"


def number_sql(c: str) -> str:
    return _NUMBER_SQL.replace("{c}", c)


def fraction_sql(c: str) -> str:
    n = number_sql(c)
    return f"CASE WHEN regexp_matches({c}, '{text.PERCENT}') THEN regexp_extract({c}, '{text.PERCENT}', 1)::DOUBLE / 100 WHEN ({n}) > 1 THEN ({n}) / 100 ELSE {n} END"


def _day(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd")


_PHONE10 = "regexp_replace(phone_txt, '\\D', '', 'g')"
_AS_OF = datetime(1996, 1, 1)
_STRING, _LONG, _DOUBLE = T.StringType(), T.LongType(), T.DoubleType()

#: name -> (column, Spark expression, DuckDB expression)
SCALARS: dict[str, tuple[str, object, str]] = {
    "c01_trim_whitespace": ("prio_txt", text.trim_whitespace, r"regexp_replace(prio_txt, '^\s+|\s+$', '', 'g')"),
    "c02_collapse_whitespace": ("text_txt", text.collapse_whitespace, r"trim(regexp_replace(text_txt, '\s+', ' ', 'g'))"),
    "c03_strip_special_characters": ("price_txt", text.strip_special_characters, r"regexp_replace(price_txt, '[^a-zA-Z0-9\s]', '', 'g')"),
    "c04_normalize_case": ("prio_txt", text.normalize_case, "lower(prio_txt)"),
    "c05_remove_line_breaks": ("text_txt", text.remove_line_breaks, r"regexp_replace(text_txt, '[\r\n]+', ' ', 'g')"),
    "c06_remove_non_ascii": ("text_txt", text.remove_non_ascii, r"regexp_replace(text_txt, '[^\x00-\x7F]', '', 'g')"),
    "c07_parse_currency": ("price_txt", text.parse_currency, f"TRY_CAST(nullif(regexp_replace({_KEPT}, '[MK]$', ''), '') AS DOUBLE) * CASE WHEN {_KEPT} LIKE '%M' THEN 1000000 WHEN {_KEPT} LIKE '%K' THEN 1000 ELSE 1 END"),
    "c08_parse_number": ("price_txt", text.parse_number, number_sql("price_txt")),
    "c08_parse_number_ratio": ("rating_txt", lambda c: F.round(text.parse_number(c), 4), f"round({number_sql('rating_txt')}, 4)"),
    "c09_parse_percentage": ("pct_txt", lambda c: F.round(text.parse_percentage(c), 4), "round(TRY_CAST(trim(replace(pct_txt, '%', '')) AS DOUBLE) / 100, 4)"),
    "c10_parse_fraction": ("pct_txt", lambda c: F.round(text.parse_fraction(c), 4), f"round({fraction_sql('pct_txt')}, 4)"),
    "c11_parse_rating": ("rating_txt", text.parse_rating, r"TRY_CAST(nullif(regexp_extract(rating_txt, '\d+(?:\.\d+)?', 0), '') AS DOUBLE)"),
    "c12_parse_height": ("height_txt", lambda c: F.round(text.parse_height(c), 4), r"round(TRY_CAST(nullif(regexp_extract(lower(height_txt), '(\d+)\s*(?:''|ft)\s*(\d+)?', 1), '') AS DOUBLE) * 30.48 + coalesce(TRY_CAST(nullif(regexp_extract(lower(height_txt), '(\d+)\s*(?:''|ft)\s*(\d+)?', 2), '') AS DOUBLE), 0) * 2.54, 4)"),
    "c12_parse_weight": ("weight_txt", lambda c: F.round(text.parse_weight(c), 4), r"round(TRY_CAST(nullif(regexp_extract(lower(weight_txt), '([\d.]+)\s*(lbs?|kg)', 1), '') AS DOUBLE) * CASE WHEN weight_txt LIKE '%lb%' THEN 0.453592 ELSE 1 END, 4)"),
    "c13_parse_datetime": ("date_txt", lambda c: _day(text.parse_datetime(c)), f"strftime({_DATE_SQL.format(c='date_txt')}, '%Y-%m-%d')"),
    "c14_null_future_dates": ("date_txt", lambda c: _day(text.null_future(text.parse_datetime(c), _AS_OF)), f"strftime(CASE WHEN {_DATE_SQL.format(c='date_txt')} <= TIMESTAMP '1996-01-01' THEN {_DATE_SQL.format(c='date_txt')} END, '%Y-%m-%d')"),
    "c16_extract_year": ("date_txt", lambda c: text.date_part(text.parse_datetime(c), "year").cast("string"), f"year({_DATE_SQL.format(c='date_txt')})::VARCHAR"),
    "c16_extract_month": ("date_txt", lambda c: text.date_part(text.parse_datetime(c), "month").cast("string"), f"month({_DATE_SQL.format(c='date_txt')})::VARCHAR"),
    "c16_extract_day": ("date_txt", lambda c: text.date_part(text.parse_datetime(c), "day").cast("string"), f"day({_DATE_SQL.format(c='date_txt')})::VARCHAR"),
    "c17_standardize_boolean": ("flag_txt", lambda c: text.standardize_boolean(c).cast("string"), "CASE WHEN lower(trim(flag_txt)) IN ('yes', 'y', 'true', 't', '1', '1.0') THEN 'true' WHEN lower(trim(flag_txt)) IN ('no', 'n', 'false', 'f', '0', '0.0') THEN 'false' END"),
    "c18_normalize_phone": ("phone_txt", text.normalize_phone, f"nullif({_PHONE10}, '')"),
    "c19_normalize_phone10": ("phone_txt", text.normalize_phone10, f"CASE WHEN length({_PHONE10}) = 12 AND {_PHONE10} LIKE '91%' THEN substr({_PHONE10}, 3) WHEN length({_PHONE10}) = 10 THEN {_PHONE10} END"),
    "c20_apply_domain_rule": ("price_txt", lambda c: rules.apply_domain(text.parse_number(c), "money"), f"CASE WHEN ({number_sql('price_txt')}) >= 0 THEN {number_sql('price_txt')} END"),
    "c21_normalize_email": ("email_txt", text.normalize_email, f"CASE WHEN regexp_matches(email_txt, '{text.EMAIL}') THEN lower(email_txt) END"),
    "c22_map_values": ("status", lambda c: text.map_values(c, {"O": "open", "F": "filled"}), "CASE status WHEN 'O' THEN 'open' WHEN 'F' THEN 'filled' ELSE status END"),
    "n01_sentinels_to_null": ("mark_txt", lambda c: text.null_placeholders(text.collapse_whitespace(c)), "CASE WHEN upper(trim(mark_txt)) NOT IN ('', 'UNKNOWN', 'N/A', 'NA', 'NONE', 'NULL', 'NAN', '-', '?', 'TBD', 'ERROR', 'MISSING', 'NOT RECORDED', 'UNDEFINED') THEN trim(mark_txt) END"),
    "l1_validate_email": ("email_txt", lambda c: rules.validate(c, "email"), r"CASE WHEN regexp_matches(email_txt, '^[\w\.-]+@[\w\.-]+\.\w+$') THEN email_txt END"),
    "l2_validate_phone": ("phone_txt", lambda c: rules.validate(c, "phone"), r"CASE WHEN regexp_matches(phone_txt, '^\+?[\d\s-]{7,15}$') THEN phone_txt END"),
    "l3_validate_postal_code": ("code_txt", lambda c: rules.validate(c, "postal_code"), r"CASE WHEN regexp_matches(code_txt, '^[A-Za-z0-9\s-]{3,10}$') THEN code_txt END"),
    "l4_validate_country_code": ("code_txt", lambda c: rules.validate(c, "country_code"), "CASE WHEN regexp_matches(code_txt, '^[A-Z]{2,3}$') THEN code_txt END"),
    "l5_validate_uuid": ("code_txt", lambda c: rules.validate(c, "uuid"), f"CASE WHEN regexp_matches(code_txt, '{rules.PATTERNS['uuid']}') THEN code_txt END"),
    "t1_cast_int64": ("half_txt", lambda c: casts.cast_type(c, _STRING, "int64").cast("string"), "round_even(TRY_CAST(half_txt AS DOUBLE), 0)::BIGINT::VARCHAR"),
    "t2_cast_float64": ("half_txt", lambda c: casts.cast_type(c, _STRING, "float64"), "TRY_CAST(half_txt AS DOUBLE)"),
    "t3_cast_datetime": ("date_txt", lambda c: _day(casts.cast_type(c, _STRING, "datetime")), f"strftime({_DATE_SQL.format(c='date_txt')}, '%Y-%m-%d')"),
    "t4_cast_string": ("amount", lambda c: casts.cast_type(c, _LONG, "string"), "amount::VARCHAR"),
    "t5_cast_bool": ("flag_txt", lambda c: casts.cast_type(c, _STRING, "bool").cast("string"), "CASE WHEN flag_txt IN ('False', 'false', '0') THEN 'false' WHEN flag_txt IS NOT NULL THEN 'true' END"),
    "t6_cast_category": ("status_gap", lambda c: casts.cast_type(c, _STRING, "category"), "status_gap"),
    "t9_cast_revenue": ("half_txt", casts.cast_revenue, "TRY_CAST(half_txt AS DOUBLE)"),
}


def _query(column: str, change):
    def run(spark, sf_dir):
        return dirty.dirty(spark, sf_dir, dirty.ORDERS).select("order_id", change(F.col(column)).alias("value"))

    return run


QUERIES = {name: _query(column, change) for name, (column, change, _) in SCALARS.items()}
ORACLE = {name: f"SELECT order_id, {sql} AS value FROM ({dirty.duck(dirty.ORDERS)}) AS dirty" for name, (_, _, sql) in SCALARS.items()}
