"""Row-local steps on streams, and first-per-key with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..plans import steps as plan

#: Steps that need no figure of the whole table and no row order, so they run on a stream as they are.
ROW_LOCAL = frozenset({
    *plan.PARSERS, *plan.CLEANERS, *(a for a in plan.ACTIONS if a.startswith("validate_")), "normalize_columns", "rename_column", "drop_column", "create_column", "merge_columns", "cast_type",
    "flatten_object", "explode_array", "serialize_json", "extract_pattern", "extract_year", "extract_month", "extract_day", "standardize_boolean", "normalize_phone", "replace_with_null",
    "map_values", "conditional_transform", "drop_missing_rows",
})


def apply_to_stream(stream: DataFrame, steps: list[dict]) -> DataFrame:
    """The stream with the steps applied. A step that isn't row-local raises, since a stream has no whole to look at."""
    for s in steps:
        local = s.get("action") in ROW_LOCAL or (s.get("action") == "fill_missing" and s.get("strategy", "constant") == "constant") or (s.get("action") == "split_column" and s.get("n"))
        if not local:
            raise ValueError(f"{s.get('action')!r} needs the whole table")
    out = plan.apply_steps(stream, steps)
    if bad := [x for x in out.log if x["status"] in ("error", "skipped")]:
        raise ValueError(f"steps failed: {bad}")
    return out.df


def first_per_key(stream: DataFrame, keys: list[str], time: str, delay: str = "1 hour") -> DataFrame:
    """The first arrival of each key; keys are forgotten once the watermark has passed."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)
