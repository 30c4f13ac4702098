"""Column names and table shape."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

IDENTIFIER = re.compile(r"^[A-Za-z_][A-Za-z0-9_]{0,47}$")


def quoted(name: str):
    """A column by its exact name, whatever signs the name holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def _renamed(df: DataFrame, rule: Callable[[str], str]) -> tuple[DataFrame, dict[str, str]]:
    """Names by ``rule``; a name that is taken gets the next free suffix ``_1``, ``_2``."""
    taken: set[str] = set()
    names = []
    for c in df.columns:
        name, k = (base := rule(c)), 0
        while name in taken:
            k += 1
            name = f"{base}_{k}"
        taken.add(name)
        names.append(name)
    return df.toDF(*names), dict(zip(df.columns, names, strict=True))


def snake(name: str) -> str:
    return re.sub(r"[^a-zA-Z0-9]+", "_", name.strip()).strip("_").lower() or "col"


def normal(name: str) -> str:
    return re.sub(r"_+", "_", re.sub(r"[^a-z0-9_]", "_", name.strip().lower())).strip("_")


def normalize_columns(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """Lower case, other signs as one underscore; equal names get a suffix. Also returns old -> new."""
    return _renamed(df, lambda c: normal(c) or "col")


def standardize_headers(df: DataFrame, keep_underscores: bool = False) -> tuple[DataFrame, dict[str, str]]:
    """Runs of other signs as one underscore. With ``keep_underscores``, runs of underscores in a name stay."""
    if keep_underscores:
        return _renamed(df, lambda c: re.sub(r"[^a-zA-Z0-9_]+", "_", c.strip()).strip("_").lower() or "col")
    return _renamed(df, snake)


def safe_columns(df: DataFrame) -> tuple[DataFrame, list[tuple[str, str]]]:
    """Valid SQL identifiers of at most 48 characters, with the renames made."""
    taken: set[str] = set()
    names = []
    for c in df.columns:
        name = c
        if not IDENTIFIER.match(c):
            name = snake(c)
            name = (name if name[0].isalpha() else f"c_{name}")[:48]
        base, k = name, 1
        while name in taken:
            k += 1
            name = f"{base[:45]}_{k}"
        taken.add(name)
        names.append(name)
    return df.toDF(*names), [(a, b) for a, b in zip(df.columns, names, strict=True) if a != b]


def rename_column(df: DataFrame, column: str, new_name: str) -> DataFrame:
    if column not in df.columns:
        raise KeyError(column)
    if new_name in df.columns and new_name != column:
        raise ValueError(f"a column {new_name!r} is already there")
    return df.withColumnRenamed(column, new_name)


def drop_column(df: DataFrame, column: str) -> DataFrame:
    if column not in df.columns:
        raise KeyError(column)
    return df.drop(quoted(column))


def drop_empty_columns(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """Without the columns that have no value in any row, found in one pass; a table without rows stays as it is."""
    if not df.columns:
        return df, []
    row = df.agg(F.count(F.lit(1)), *[F.count(quoted(c)) for c in df.columns]).first()
    empty = [c for c, n in zip(df.columns, row[1:], strict=True) if row[0] and not n]
    return df.drop(*[quoted(c) for c in empty]), empty


def create_column(df: DataFrame, new_name: str, value) -> DataFrame:
    return df.withColumn(new_name, F.lit(value))


def merge_columns(df: DataFrame, columns: list[str], new_name: str, separator: str = " ") -> DataFrame:
    """Texts joined; nulls are left out (they used to become the text ``nan``)."""
    return df.withColumn(new_name, F.concat_ws(separator, *[quoted(c).cast("string") for c in columns]))


def split_column(df: DataFrame, column: str, delimiter: str | None = None, regex: str | None = None, n: int | None = None) -> DataFrame:
    """Parts in ``column_1`` to ``column_n``. Without ``n``, one pass finds the widest row.

    A delimiter of one character is taken as it is, a longer one as a pattern.
    """
    pattern = regex if regex is not None else delimiter if delimiter is not None and len(delimiter) > 1 else re.escape(delimiter or " ")
    parts = F.split(quoted(column), pattern)
    if n is None:
        n = df.agg(F.max(F.when(quoted(column).isNotNull(), F.size(parts)))).first()[0] or 0
    return df.withColumns({f"{column}_{i + 1}": F.get(parts, F.lit(i)) for i in range(n)})


def extract_pattern(df: DataFrame, column: str, regex: str) -> DataFrame:
    """The first match, or of the first group if there is one, in ``column_extracted``."""
    has_group = re.compile(regex).groups > 0
    found = F.regexp_extract(quoted(column), regex, 1 if has_group else 0)
    return df.withColumn(f"{column}_extracted", F.when(quoted(column).rlike(regex), found))


def _leaves(kind: T.StructType, path: str, name: str, prefix: str):
    for f in kind.fields:
        at, label = f"{path}.`{f.name}`", f"{name}.{f.name}" if name else f.name
        if isinstance(f.dataType, T.StructType):
            yield from _leaves(f.dataType, at, label, prefix)
        else:
            yield F.col(at).alias(prefix + label)


def flatten_object(df: DataFrame, column: str, prefix: str = "", schema: str | None = None) -> DataFrame:
    """A struct's fields in its place, nested keys joined by dots. ``schema`` reads JSON text first."""
    if schema is not None:
        df = df.withColumn(column, F.from_json(quoted(column), schema))
    kind = df.schema[column].dataType
    if not isinstance(kind, T.StructType):
        raise TypeError(f"column {column!r} holds no objects")
    out = []
    for c in df.columns:
        out += list(_leaves(kind, f"`{column}`", "", prefix)) if c == column else [quoted(c)]
    return df.select(*out)


def explode_array(df: DataFrame, column: str) -> DataFrame:
    """One row per element; an empty or null array gives one row with null."""
    return df.select(*[F.explode_outer(quoted(c)).alias(c) if c == column else quoted(c) for c in df.columns])


def serialize_json(df: DataFrame, column: str | None = None) -> DataFrame:
    """Structs, arrays and maps as JSON text, in one column or in all; others are untouched."""
    nested = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType)) and column in (None, f.name)]
    return df.withColumns({c: F.to_json(quoted(c)) for c in nested}) if nested else df


def generate_surrogate_key(df: DataFrame, column: str = "surrogate_key", mode: str = "uuid") -> DataFrame:
    """A random UUID per row, or with ``mode="hash"`` a SHA-256 of the row, which recomputes to the same."""
    if mode == "hash":
        return df.withColumn(column, F.sha2(F.to_json(F.struct(*map(quoted, df.columns)), {"ignoreNullFields": "false"}), 256))
    return df.withColumn(column, F.uuid())
