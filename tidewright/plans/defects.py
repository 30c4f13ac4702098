"""Seeded defects: clean rows made dirty by expressions of their key, and a manifest of what was done."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.shape import quoted

#: Kinds of defect, what a value becomes, and one row in how many gets it.
KINDS = {
    "currency": lambda c: F.concat(F.lit("$"), c), "code": lambda c: F.concat(c, F.lit(" USD")), "placeholder": lambda c: F.lit("N/A"), "padding": lambda c: F.concat(F.lit("  "), c, F.lit(" ")),
    "upper": F.upper, "blank": lambda c: F.lit(""), "negative": lambda c: F.concat(F.lit("-"), c),
}


def _dice(key: Column, seed: int, salt: str, every: int) -> Column:
    """One key in ``every``, by 32 bits of an md5, which any engine can compute."""
    return F.conv(F.substring(F.md5(F.concat(key, F.lit(f":{seed}:{salt}"))), 1, 8), 16, 10).cast("long") % every == 0


def _touched(column: str) -> Column:
    return F.exists("__done", lambda d: d.endswith(f":{column}"))


def inject_defects(df: DataFrame, key: str, plan: dict[str, list[str]], seed: int = 42, every: int = 10, duplicates: int = 20, conflicts: int = 50, missing_keys: int = 100) -> tuple[DataFrame, DataFrame]:
    """All-text rows with defects, and the manifest (kind, column_name, n).

    ``plan`` names the kinds of defect of each column. Of the rows, one in
    ``duplicates`` is copied, one in ``conflicts`` is repeated with another value
    in the first planned column, and one in ``missing_keys`` loses its key. ``_row``
    numbers the rows by key, copies after their originals.
    """
    k = quoted(key).cast("string")
    out = df.select(*[quoted(c).cast("string").alias(c) for c in df.columns]).withColumn("__k", k).withColumn("__done", F.array().cast("array<string>"))
    for column, kinds in plan.items():
        value, done = quoted(column), F.col("__done")
        for kind in kinds:
            hit = _dice(F.col("__k"), seed, f"{column}:{kind}", every) & value.isNotNull() & ~_touched(column)
            out = out.withColumns({column: F.when(hit, KINDS[kind](value)).otherwise(value), "__done": F.when(hit, F.array_append(done, F.lit(f"{kind}:{column}"))).otherwise(done)})
    first = next(iter(plan))
    lost = _dice(F.col("__k"), seed, "missing", missing_keys)
    base = out.withColumn(key, F.when(lost, F.lit(None)).otherwise(quoted(key))).withColumn("__done", F.when(lost, F.array_append("__done", F.lit(f"missing_key:{key}"))).otherwise(F.col("__done"))).withColumn("__copy", F.lit(0))
    copied = base.where(_dice(F.col("__k"), seed, "copy", duplicates) & ~lost).withColumn("__copy", F.lit(1)).withColumn("__done", F.array(F.lit(f"duplicate:{key}")))
    clash = base.where(_dice(F.col("__k"), seed, "conflict", conflicts) & ~lost).withColumn("__copy", F.lit(2)).withColumn(first, F.lit("7")).withColumn("__done", F.array(F.lit(f"conflict:{key}")))
    whole = base.unionByName(copied).unionByName(clash)
    manifest = whole.select(F.explode("__done").alias("d")).groupBy(F.split_part("d", F.lit(":"), F.lit(1)).alias("kind"), F.split_part("d", F.lit(":"), F.lit(2)).alias("column_name")).agg(F.count(F.lit(1)).alias("n"))
    return whole.withColumn("_row", F.col("__k").cast("long") * 3 + F.col("__copy")).drop("__k", "__done", "__copy"), manifest
