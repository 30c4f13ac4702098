"""Steps suggested by rules from a profile."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from ..operators.shape import normal

#: Names that are numbers when their samples are, and words of a time's name.
NUMBER_NAMES, TIME_WORDS = ("revenue", "amount", "price", "total", "score"), ("date", "time", "created", "updated")


def default_value(dtype: str):
    """What fills a column of a type, on request."""
    for word, value in (("bool", False), ("int", 0), ("float", 0.0), ("double", 0.0), ("decimal", 0.0), ("date", "1970-01-01"), ("timestamp", "1970-01-01")):
        if word in dtype:
            return value
    return "UNKNOWN"


def _is_number(v: str) -> bool:
    return re.fullmatch(r"\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*", v) is not None


def target_type(name: str, dtype: str, samples: list[str], request: str) -> str | None:
    low, given = name.lower(), [v for v in samples if v not in (None, "")]
    if dtype.startswith(("timestamp", "date")):
        return "datetime"
    if dtype.startswith(("float", "double", "decimal")):
        return "float64"
    if re.search("int|long", dtype) and "<" not in dtype:
        return "int64"
    if any(w in low for w in TIME_WORDS) and any(re.match(r"\d{4}-\d{1,2}-\d{1,2}", v) for v in given):
        return "datetime"
    if (low in NUMBER_NAMES or re.search("type|cast", request)) and given and all(map(_is_number, given)):
        return "float64"
    return None


def suggest_steps(columns: DataFrame, table: dict, request: str = "", normalize: bool = True) -> tuple[list[dict], list[str]]:
    """(steps, warnings) from the profile of a table: names, nested objects, copies, placeholders, fills on request only, and casts.

    ``columns`` and ``table`` are what ``operators.profile.profile`` returns, in any column order.
    """
    rows = columns.collect()  # a row per column
    request = request.lower()
    rename = normalize and any(r["column_name"] != normal(r["column_name"]) for r in rows)
    name = (lambda c: normal(c)) if rename else (lambda c: c)
    steps: list[dict] = [{"action": "normalize_columns"}] if rename else []
    warnings = []
    for r in rows:
        if r["structural_type"] == "nested_object":
            steps.append({"action": "flatten_object", "column": name(r["column_name"]), "prefix": f"{name(r['column_name'])}_"})
        elif r["structural_type"] == "nested_array":
            warnings.append(f"column {r['column_name']!r} holds arrays and is left as it is; explode_array or serialize_json can change it")
    if table["duplicate_rows"] > 0:
        steps.append({"action": "remove_duplicates"})
    for r in rows:
        if r["suspected_sentinels"] and r["structural_type"] == "flat":
            steps.append({"action": "replace_with_null", "column": name(r["column_name"]), "values": list(r["suspected_sentinels"])})
    if re.search("fill|impute", request):
        for r in rows:
            if r["missing_count"] and r["structural_type"] == "flat":
                steps.append({"action": "fill_missing", "column": name(r["column_name"]), "value": default_value(r["dtype"])})
            elif r["missing_count"]:
                warnings.append(f"column {r['column_name']!r} is nested and is not filled")
    for r in rows:
        if kind := target_type(r["column_name"], r["dtype"], list(r["sample_values"] or []), request):
            steps.append({"action": "cast_type", "column": name(r["column_name"]), "target_type": kind})
    return steps, warnings
