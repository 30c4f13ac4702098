"""Missing values and row filters."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text
from .quantiles import quantiles
from .rows import carry
from .shape import quoted

#: Placeholders that the conditional rule looks at, and the share of rows above which they stay.
CONDITIONAL, MOSTLY = ("UNKNOWN", "ERROR", "N/A", "NONE"), 0.5


def _of_type(df: DataFrame, *kinds) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, kinds)]


def text_columns(df: DataFrame) -> list[str]:
    return _of_type(df, T.StringType)


def numeric_columns(df: DataFrame) -> list[str]:
    return _of_type(df, T.NumericType)


def drop_missing_rows(df: DataFrame, column: str | None = None) -> DataFrame:
    """Rows without null in ``column``, or in any column. NaN is a number here."""
    columns = [column] if column else df.columns
    keep = F.lit(True)
    for c in columns:
        keep = keep & quoted(c).isNotNull()
    return df.where(keep)


_WORDS = re.compile(r"""('(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"|`[^`]*`)|==|&&?|\|\|?|!=""")


def condition_sql(condition: str) -> str:
    """A condition with ``== & | and or`` as Spark SQL; quoted texts are left alone."""
    return _WORDS.sub(lambda m: m[0] if m[1] else {"==": "=", "&": " AND ", "&&": " AND ", "|": " OR ", "||": " OR ", "!=": "<>"}[m[0]], condition)


def conditional_null(df: DataFrame, condition: str, column: str) -> DataFrame:
    """Null in ``column`` where the condition holds. A comparison with null doesn't hold."""
    return df.withColumn(column, F.when(F.coalesce(F.expr(condition_sql(condition)), F.lit(False)), None).otherwise(quoted(column)))


def equals(df: DataFrame, column: str, value) -> DataFrame:
    return df.where(quoted(column) == F.lit(value))


def sentinels_to_null(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """White space collapsed and placeholders nulled in all text columns."""
    return df.withColumns({c: text.null_placeholders(text.collapse_whitespace(quoted(c))) for c in columns or text_columns(df)})


def replace_with_null(df: DataFrame, column: str, values) -> DataFrame:
    """Null for exact matches. An empty text among the values also nulls white space alone."""
    values = list(values) if isinstance(values, (list, tuple, set)) else [values]
    c = quoted(column)
    hit = c.cast("string").isin([str(v) for v in values])
    if "" in values:
        hit = hit | (text.trim_whitespace(c.cast("string")) == "")
    return df.withColumn(column, F.when(hit, None).otherwise(c))


def conditional_sentinels(df: DataFrame) -> tuple[DataFrame, dict[str, tuple[int, bool]]]:
    """Placeholders nulled where they are at most half of a column's rows. Also column -> (count, nulled)."""
    columns = text_columns(df)
    if not columns:
        return df, {}
    found = {c: F.upper(text.trim_whitespace(quoted(c))).isin(*CONDITIONAL) for c in columns}
    row = df.agg(F.count(F.lit(1)), *[F.count_if(found[c]) for c in columns]).first()
    counts = {c: (n, n <= MOSTLY * row[0]) for c, n in zip(columns, row[1:], strict=True) if n}
    return df.withColumns({c: F.when(~found[c], quoted(c)) for c, (_, nulled) in counts.items() if nulled}), counts


def _filled(df: DataFrame, column: str, value: Column) -> DataFrame:
    return df.withColumn(column, F.coalesce(quoted(column), value))


def fill_constant(df: DataFrame, column: str, value="Unknown") -> DataFrame:
    """A text fills a column of another type by turning it into text."""
    kind = df.schema[column].dataType
    if isinstance(value, str) and not isinstance(kind, T.StringType):
        return df.withColumn(column, F.coalesce(quoted(column).cast("string"), F.lit(value)))
    return _filled(df, column, F.lit(value))


def _number(df: DataFrame, column: str) -> Column:
    c = quoted(column)
    return text.to_double(c) if isinstance(df.schema[column].dataType, T.StringType) else c.cast("double")


def fill_statistic(df: DataFrame, column: str, strategy: str) -> DataFrame:
    """``mean`` or ``median`` of what is numeric in the column; the column becomes double. ``mode`` is the commonest value, the smallest on a tie."""
    if strategy == "mode":
        return fill_modes(df, [column])
    number = _number(df, column)
    if strategy == "mean":
        value = df.agg(F.avg(number)).first()[0]
    else:
        value = quantiles(df.select(number.alias("v")), ["v"], (0.5,))["v"][0]
    return df.withColumn(column, F.coalesce(number, F.lit(value).cast("double")))


def fill_directed(df: DataFrame, column: str, order_by: str, forward: bool = True, partition_by: list[str] | None = None) -> DataFrame:
    return carry(df, column, order_by, forward, partition_by)


def fill_by_type(df: DataFrame) -> DataFrame:
    """Text ``UNKNOWN``, fractions 0.0, whole numbers 0, in all columns."""
    values = {T.StringType: F.lit("UNKNOWN"), T.FractionalType: F.lit(0.0), T.IntegralType: F.lit(0)}
    out = {}
    for f in df.schema.fields:
        for kind, v in values.items():
            if isinstance(f.dataType, kind):
                out[f.name] = F.coalesce(quoted(f.name), v.cast(f.dataType))
    return df.withColumns(out) if out else df


def fill_medians(df: DataFrame) -> DataFrame:
    """Every numeric column filled by its median, all found together; those columns become double."""
    columns = numeric_columns(df)
    if not columns:
        return df
    medians = quantiles(df, columns, (0.5,))
    return df.withColumns({c: F.coalesce(quoted(c).cast("double"), F.lit(medians[c][0]).cast("double")) for c in columns})


def fill_modes(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Text columns (or those named) filled by their commonest value, the smallest on a tie.

    Values are counted by a grouped aggregate over (column, value), so a column
    of many distinct values is spread over tasks.
    """
    columns = columns or text_columns(df)
    if not columns:
        return df
    pairs = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), quoted(c).cast("string").alias("v")) for i, c in enumerate(columns)])).alias("p")
    counted = df.select(pairs).where("p.v is not null").groupBy("p.i", "p.v").count()
    best = {r["i"]: r["b"]["v"] for r in counted.groupBy("i").agg(F.min(F.struct((-F.col("count")).alias("n"), F.col("v"))).alias("b")).collect()}  # a row per column
    return df.withColumns({c: F.coalesce(quoted(c), F.lit(best[i]).cast(df.schema[c].dataType)) for i, c in enumerate(columns) if i in best})


def remove_outliers(df: DataFrame, column: str) -> DataFrame:
    """Rows within 1.5 interquartile ranges of the quartiles; nulls stay."""
    from .profile import outlier_bounds

    low, high = outlier_bounds(df, column)
    return df.where(quoted(column).isNull() | quoted(column).between(low, high)) if low is not None else df
