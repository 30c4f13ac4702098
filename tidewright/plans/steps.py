"""A list of declarative steps run over a DataFrame.

Steps are dictionaries with an ``action`` and its parameters. A bad step is an
``error`` row of the log, a missing column a ``skipped`` one; nothing is raised.
Row-local steps only add to the plan, so a list of them is one projection. Steps
that need a figure of the data (means, modes, quartiles, widths) run one small
aggregate each.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import casts, rules, text
from ..operators import dedupe, dependencies, missing, profile, shape
from ..operators.shape import quoted

#: Actions whose losses (values that became null) are reported.
PARSERS: dict[str, Callable[[Column], Column]] = {
    "parse_currency": text.parse_currency, "parse_percentage": text.parse_percentage, "parse_rating": text.parse_rating, "parse_datetime": text.parse_datetime,
    "parse_height": text.parse_height, "parse_weight": text.parse_weight,
}
CLEANERS: dict[str, Callable[[Column], Column]] = {
    "trim_whitespace": text.trim_whitespace, "strip_special_characters": text.strip_special_characters, "normalize_case": text.normalize_case,
    "remove_line_breaks": text.remove_line_breaks, "remove_non_ascii": text.remove_non_ascii,
}
#: These leave the table as it is and have a report, made when it is asked for; the other tables are those given to :func:`apply_steps`.
EVALUATED: dict[str, Callable[[DataFrame, str, dict[str, DataFrame]], DataFrame]] = {
    "identify_primary_key": lambda df, name, others: dependencies.keys(df),
    "identify_foreign_keys": lambda df, name, others: dependencies.inclusions({name: df} | others).where((F.col("table_name") == name) & (F.col("ref_table") != name)),
    "infer_relationships": lambda df, name, others: dependencies.relationships({name: df} | others),
    "schema_recommendation": lambda df, name, others: dependencies.recommendation(df),
}


@dataclass
class Result:
    df: DataFrame
    #: One dictionary per log row: step_index, action, status, details.
    log: list[dict] = field(default_factory=list)
    losses: DataFrame | None = None
    #: Step index -> what makes its report.
    reports: dict[int, Callable[[], DataFrame]] = field(default_factory=dict)

    def report(self, step_index: int) -> DataFrame:
        """The report of an ``identify_primary_key``, ``identify_foreign_keys``, ``infer_relationships`` or ``schema_recommendation`` step, over the table as it was there."""
        return self.reports[step_index]()

    def log_table(self) -> DataFrame:
        rows = [(x["step_index"], x["action"], x["status"], str(x["details"])) for x in self.log]
        return self.df.sparkSession.createDataFrame(rows, "step_index int, action string, status string, details string")


def _need(step: dict, *names: str) -> list:
    if lost := [n for n in names if step.get(n) is None]:
        raise ValueError(f"missing parameter {', '.join(lost)}")
    return [step[n] for n in names]


def _on_text(change: Callable[[Column], Column]):
    def run(df: DataFrame, step: dict, _order) -> DataFrame:
        (c,) = _need(step, "column")
        return df.withColumn(c, change(quoted(c).cast("string")))

    return run


def _fill(df: DataFrame, step: dict, order: str | None) -> DataFrame:
    (c,) = _need(step, "column")
    strategy = step.get("strategy", "constant")
    if strategy == "constant":
        return missing.fill_constant(df, c, step.get("value", "Unknown"))
    if strategy in ("mean", "median", "mode"):
        return missing.fill_statistic(df, c, strategy)
    if strategy in ("forward_fill", "backward_fill"):
        if order is None:
            raise ValueError("forward and backward fills need the row order: give order_by")
        return missing.fill_directed(df, c, order, strategy == "forward_fill")
    raise ValueError(f"unknown strategy {strategy!r}")


def _duplicates(df: DataFrame, step: dict, order: str | None) -> DataFrame:
    if (c := step.get("column")) is None:
        return dedupe.remove_duplicates(df)
    return dedupe.first_per_key(df, [c], [order] if order else df.columns)


def _conditional(df: DataFrame, step: dict, _order) -> DataFrame:
    condition, column = _need(step, "condition", "column")
    if (then := step.get("transformation", step.get("then", "set_null"))) != "set_null":
        raise ValueError(f"unknown transformation {then!r}")
    return missing.conditional_null(df, condition, column)


def _date_part(part: str):
    def run(df: DataFrame, step: dict, _order) -> DataFrame:
        (c,) = _need(step, "column")
        kind = dict(df.dtypes)[c]
        value = text.parse_datetime(quoted(c)) if kind == "string" else quoted(c)
        return df.withColumn(f"{c}_{part}", text.date_part(value, part))

    return run


ACTIONS: dict[str, Callable[[DataFrame, dict, str | None], DataFrame]] = {
    "normalize_columns": lambda df, s, o: shape.normalize_columns(df)[0],
    "fill_missing": _fill,
    "remove_duplicates": _duplicates,
    "cast_type": lambda df, s, o: df.withColumn(s["column"], casts.cast_type(quoted(s["column"]), df.schema[s["column"]].dataType, _need(s, "target_type")[0])),
    "rename_column": lambda df, s, o: shape.rename_column(df, *_need(s, "column", "new_name")),
    "flatten_object": lambda df, s, o: shape.flatten_object(df, _need(s, "column")[0], s.get("prefix", ""), s.get("schema")),
    "drop_column": lambda df, s, o: shape.drop_column(df, *_need(s, "column")),
    "drop_missing_rows": lambda df, s, o: missing.drop_missing_rows(df, s.get("column")),
    "keep_latest_duplicate": lambda df, s, o: dedupe.keep_latest(df, _need(s, "column")[0], s.get("timestamp_column"), [o] if o else None),
    "extract_year": _date_part("year"), "extract_month": _date_part("month"), "extract_day": _date_part("day"),
    "split_column": lambda df, s, o: shape.split_column(df, _need(s, "column")[0], s.get("delimiter"), s.get("regex"), s.get("n")),
    "extract_pattern": lambda df, s, o: shape.extract_pattern(df, *_need(s, "column", "regex")),
    "explode_array": lambda df, s, o: shape.explode_array(df, *_need(s, "column")),
    "serialize_json": lambda df, s, o: shape.serialize_json(df, *_need(s, "column")),
    "merge_columns": lambda df, s, o: shape.merge_columns(df, *_need(s, "columns", "new_name"), s.get("separator", " ")),
    "create_column": lambda df, s, o: shape.create_column(df, _need(s, "new_name")[0], s.get("value")),
    "generate_surrogate_key": lambda df, s, o: shape.generate_surrogate_key(df, s.get("column") or "surrogate_key", s.get("mode", "uuid")),
    "detect_outliers": lambda df, s, o: profile.detect_outliers(df, *_need(s, "column")),
    "clip_outliers": lambda df, s, o: profile.clip_outliers(df, *_need(s, "column")),
    "remove_outliers": lambda df, s, o: missing.remove_outliers(df, *_need(s, "column")),
    "conditional_transform": _conditional,
    "standardize_boolean": lambda df, s, o: df.withColumn(s["column"], text.standardize_boolean(quoted(s["column"]))),
    "normalize_phone": _on_text(text.normalize_phone),
    "replace_with_null": lambda df, s, o: missing.replace_with_null(df, _need(s, "column")[0], s.get("values", s.get("value"))),
    "map_values": lambda df, s, o: df.withColumn(s["column"], text.map_values(quoted(s["column"]), _need(s, "mapping")[0])),
    **{f"validate_{k}": _on_text(lambda c, k=k: rules.validate(c, k)) for k in rules.PATTERNS},
    **{k: _on_text(f) for k, f in (PARSERS | CLEANERS).items()},
    **{k: (lambda df, s, o: df) for k in EVALUATED},
}

#: Steps that make the column they name.
MAKES_COLUMN = ("create_column", "generate_surrogate_key")


def check(steps: object) -> list[str]:
    """What is wrong with the form of a step list; empty if nothing is."""
    if not isinstance(steps, list):
        return [f"steps must be a list, not {type(steps).__name__}"]
    out = []
    for i, s in enumerate(steps):
        if not isinstance(s, dict):
            out.append(f"step {i}: must be a dictionary, not {type(s).__name__}")
        elif s.get("action") is None:
            out.append(f"step {i}: no action")
        elif s["action"] not in ACTIONS:
            out.append(f"step {i}: unknown action {s['action']!r}")
    return out


def _rank(step: dict) -> int:
    """Parsing and cleaning of signs come first, then fills, then casts."""
    action = step.get("action")
    return 0 if action in PARSERS or action == "strip_special_characters" else 1 if action == "fill_missing" else 2


def reorder(steps: list) -> tuple[list, list[str]]:
    """Neighbouring steps on one column put in the order that works: parse before fill and cast, fill before a cast to int."""
    out, notes, moved = list(steps), [], True
    while moved:
        moved = False
        for i in range(len(out) - 1):
            a, b = out[i], out[i + 1]
            if not (isinstance(a, dict) and isinstance(b, dict)) or not a.get("column") or a.get("column") != b.get("column"):
                continue
            late = a.get("action") == "fill_missing" or a.get("action") == "cast_type"
            whole = a.get("action") == "cast_type" and "int" in str(a.get("target_type") or "").lower()
            if late and (_rank(b) == 0 or (whole and b.get("action") == "fill_missing")):
                out[i], out[i + 1], moved = b, a, True
                notes.append(f"{b['action']} goes before {a['action']} on {a['column']!r}")
    return out, notes


def _resolve(name: str, columns: list[str], renamed: dict[str, str]) -> str:
    """A column's present name: through renames, else whatever the case, with spaces as underscores."""
    if name in renamed and renamed[name] in columns:
        return renamed[name]
    if name in columns:
        return name
    same = name.lower().replace(" ", "_")
    return next((c for c in columns if c.lower() == same), name)


def apply_steps(df: DataFrame, steps: list, order_by: str | None = None, row_id: str | None = None, name: str = "data", tables: dict[str, DataFrame] | None = None) -> Result:
    """Run steps in order. ``order_by`` names a whole-number column that keeps the row order; ``row_id`` names rows in the loss report (default: ``order_by``). ``name`` is the table's, and ``tables`` are others by name that reports compare it with."""
    if not isinstance(steps, list):
        raise ValueError(f"steps must be a list, not {type(steps).__name__}")
    ordered, notes = reorder(steps)
    out = Result(df)
    if notes:
        out.log.append({"step_index": -1, "action": "plan_reorder", "status": "info", "details": {"swaps": notes}})
    renamed: dict[str, str] = {}
    losses: list[DataFrame] = []
    row_id = row_id or order_by

    def say(i: int, action: str, status: str, **details) -> None:
        out.log.append({"step_index": i, "action": action, "status": status, "details": details})

    for i, step in enumerate(ordered):
        if problems := check([step]):
            say(i, step.get("action") or "unknown" if isinstance(step, dict) else "unknown", "error", error=problems[0].split(": ", 1)[1])
            continue
        step, action = dict(step), step["action"]
        now = out.df
        asked = step.get("column")
        if asked is not None and action not in MAKES_COLUMN:
            step["column"] = _resolve(asked, now.columns, renamed)
            if step["column"] not in now.columns:
                say(i, action, "skipped", reason=f"column {asked!r} doesn't exist")
                continue
        if isinstance(step.get("columns"), list):
            step["columns"] = [_resolve(c, now.columns, renamed) for c in step["columns"]]
        try:
            then = ACTIONS[action](now, step, order_by)
            then.schema  # an analysis error shows here
        except Exception as e:  # noqa: BLE001  a step's failure is a row of the log
            say(i, action, "error", error=str(e).splitlines()[0] if str(e) else type(e).__name__)
            continue
        if action in EVALUATED:
            out.reports[i] = lambda df=now, make=EVALUATED[action]: make(df, name, tables or {})
        if action in PARSERS:
            losses.append(_loss(now, step["column"], action, i, row_id))
        if action == "normalize_columns":
            change = dict(zip(now.columns, then.columns, strict=True))
        else:
            change = {step["column"]: step["new_name"]} if action == "rename_column" else {}
        if change:
            renamed = {k: change.get(v, v) for k, v in renamed.items()} | change
            order_by, row_id = change.get(order_by, order_by), change.get(row_id, row_id)
        say(i, action, "success", **({"resolved_from": asked} if asked not in (None, step.get("column")) else {}), **({"evaluated": True} if action in EVALUATED else {}))
        out.df = then
    kind = "step_index int, action string, column_name string, rows_affected long, sample_rows array<string>"
    report = None
    for x in losses:
        report = x if report is None else report.unionByName(x)
    out.losses = (report if report is not None else df.sparkSession.createDataFrame([], kind)).where("rows_affected > 0")
    return out


def _loss(df: DataFrame, column: str, action: str, i: int, row_id: str | None, k: int = 20) -> DataFrame:
    """Values that a parser turned into null: how many, and the first ``k`` row ids, kept within bounds while aggregating."""
    c = quoted(column).cast("string")
    lost = c.isNotNull() & PARSERS[action](c).isNull()
    named = row_id is not None and row_id in df.columns
    ids = quoted(row_id) if named else F.lit(None).cast("string")
    bad = df.where(lost).select(ids.alias("id"))
    count = bad.agg(F.count(F.lit(1)).alias("rows_affected"))
    first = bad.where("id is not null").orderBy("id").limit(k).agg(F.sort_array(F.collect_list("id")).cast("array<string>").alias("sample_rows"))
    return count.join(first, how="cross").select(F.lit(i).alias("step_index"), F.lit(action).alias("action"), F.lit(column).alias("column_name"), "rows_affected", "sample_rows")  # one row each
