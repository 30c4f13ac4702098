"""Keys, inclusions and functional dependencies found in the data.

Inclusions of all pairs of columns come from one merge: each value is sent once
with the columns that hold it, and sets of columns are counted. Dependencies
come from the sizes of partitions: X decides Y just when (X, Y) has as many
distinct values as X. All sets of columns of a level are counted in one pass
over hashes of their values.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .dedupe import key_candidates
from .profile import NESTED
from .shape import quoted

INCLUSIONS = "table_name string, column_name string, ref_table string, ref_column string, n_values long, orphans long, included boolean"
DEPENDENCIES = "determinant string, dependent string, is_key boolean"


def _comparable(kind: T.DataType) -> str | None:
    """What values a column can share with another's; None for those that are never keys."""
    if isinstance(kind, T.IntegralType) or (isinstance(kind, T.DecimalType) and kind.scale == 0):
        return "number"
    if isinstance(kind, T.StringType):
        return "text"
    if isinstance(kind, T.DateType):
        return "date"
    return "time" if isinstance(kind, (T.TimestampType, T.TimestampNTZType)) else None


def inclusions(tables: dict[str, DataFrame], columns: dict[str, list[str]] | None = None) -> DataFrame:
    """(table_name, column_name, ref_table, ref_column, n_values, orphans, included) of each ordered pair of columns of one kind.

    ``orphans`` are the distinct values that the other column lacks; nulls are no
    values. ``columns`` names those to compare, by default all whole numbers,
    texts, dates and times. A value's columns are a set of bounded size, so a value that
    is everywhere is no hot key once each table has sent it.
    """
    chosen = [(t, c, kind) for t, df in sorted(tables.items()) for c in (columns or {}).get(t, df.columns) if (kind := _comparable(df.schema[c].dataType))]
    spark = next(iter(tables.values())).sparkSession
    pairs = [(i, j) for i, a in enumerate(chosen) for j, b in enumerate(chosen) if i != j and a[2] == b[2]]
    if not pairs:
        return spark.createDataFrame([], INCLUSIONS)
    cells = None
    for t, df in sorted(tables.items()):
        own = [(i, c, kind) for i, (name, c, kind) in enumerate(chosen) if name == t]
        if own:
            each = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(kind).alias("kind"), quoted(c).cast("string").alias("v")) for i, c, kind in own])).alias("x")
            one = df.select(each).select("x.*").where("v is not null").distinct()
            cells = one if cells is None else cells.unionByName(one)
    sets = cells.groupBy("kind", "v").agg(F.array_sort(F.collect_set("i")).alias("s")).groupBy("s").count()
    shared = sets.select("count", "s", F.explode("s").alias("i")).select("count", "i", F.explode("s").alias("j")).groupBy("i", "j").agg(F.sum("count").alias("n"))
    told = spark.createDataFrame([(i, j, *chosen[i][:2], *chosen[j][:2]) for i, j in pairs], "i int, j int, table_name string, column_name string, ref_table string, ref_column string")
    held = shared.where("i = j").select("i", F.col("n").alias("n_values"))
    # a row per column, and per pair of columns
    out = told.join(F.broadcast(held), "i", "left").join(F.broadcast(shared), ["i", "j"], "left").na.fill(0, ["n_values", "n"])
    orphans = F.col("n_values") - F.col("n")
    return out.select("table_name", "column_name", "ref_table", "ref_column", "n_values", orphans.alias("orphans"), ((orphans == 0) & (F.col("n_values") > 0)).alias("included"))


def relationships(tables: dict[str, DataFrame], columns: dict[str, list[str]] | None = None) -> DataFrame:
    """The inclusions in a column of another table whose values are all different and never null: foreign keys as the data has them."""
    found = inclusions(tables, columns).where(F.col("included") & (F.col("table_name") != F.col("ref_table")))
    spark = found.sparkSession
    unique = []
    for t, df in sorted(tables.items()):
        names = [c for c in (columns or {}).get(t, df.columns) if _comparable(df.schema[c].dataType)]
        unique += [(t, r["column_name"]) for r in keys(df, names).where("is_key").collect()]  # a row per column
    return found.join(F.broadcast(spark.createDataFrame(unique, "ref_table string, ref_column string")), ["ref_table", "ref_column"], "left_semi").select("table_name", "column_name", "ref_table", "ref_column", "n_values")


def _hash(columns: list[str]) -> list[Column]:
    parts = [x for c in columns for x in (quoted(c), quoted(c).isNull())]
    return [F.xxhash64(*parts).alias("a"), F.xxhash64(F.lit(1), *reversed(parts)).alias("b")]


#: Hashes that one task of the partial step meets.
CELLS = 1_000_000


def _dealt(df: DataFrame, columns: list[str], parts: int) -> DataFrame:
    """Columns of ``df`` in ``parts`` partitions or more, by the number of the row: equal rows are spread, and nothing is sorted for it."""
    if parts < 2:
        return df
    at = F.monotonically_increasing_id().alias("__at")
    return df.select(*map(quoted, columns), at).repartition(max(parts, df.sparkSession.sparkContext.defaultParallelism), "__at")


def partition_sizes(df: DataFrame, sets: list[tuple[str, ...]], n: int) -> dict[tuple[str, ...], int]:
    """Distinct values of each set of columns, nulls among them, by hashes of 128 bits in one pass with a partial step.

    ``n`` is the number of rows, which are dealt over as many tasks as keep each to ``CELLS`` hashes, so that
    the memory of a task doesn't grow with the table.
    """
    if not sets:
        return {}
    df = _dealt(df, sorted({c for s in sets for c in s}), -(-n * len(sets) // CELLS))
    cells = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), *_hash(list(s))) for i, s in enumerate(sets)])).alias("x")
    rows = df.select(cells).select("x.*").distinct().groupBy("i").count().collect()  # a row per set
    return dict.fromkeys(sets, 0) | {sets[r["i"]]: r["count"] for r in rows}


def keys(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column_name, n_rows, n_nulls, n_distinct, is_key): the report of a primary key."""
    names = columns if columns is not None else [f.name for f in df.schema.fields if not isinstance(f.dataType, NESTED)]
    kind = "column_name string, n_rows long, n_nulls long, n_distinct long, is_key boolean"
    if not names:
        return df.sparkSession.createDataFrame([], kind)
    row = df.agg(F.count(F.lit(1)), *[F.count_if(quoted(c).isNull()) for c in names]).first()
    sizes = partition_sizes(df, [(c,) for c in names], row[0])
    rows = [(c, row[0], nulls, sizes[(c,)] - (nulls > 0), row[0] > 0 and not nulls and sizes[(c,)] == row[0]) for c, nulls in zip(names, row[1:], strict=True)]
    return df.sparkSession.createDataFrame(rows, kind)


def functional_dependencies(df: DataFrame, columns: list[str] | None = None, width: int = 2) -> DataFrame:
    """(determinant, dependent, is_key): the smallest sets of up to ``width`` columns that decide another; names of a set are joined by commas.

    Nulls are a value. A set that holds a smaller determinant of the same column
    isn't told again, and none that holds a key. A table without rows has no dependencies; a column of one value
    depends on the empty set, which is told as an empty text.
    """
    names = columns if columns is not None else [f.name for f in df.schema.fields if not isinstance(f.dataType, (*NESTED, T.VariantType))]
    n = df.count()
    found: list[tuple[str, str, bool]] = []
    decided: dict[str, list[frozenset]] = {c: [] for c in names}
    if n:
        sizes = partition_sizes(df, [(c,) for c in names], n)
        for c in names:
            if sizes[(c,)] == 1:
                found.append(("", c, False))
                decided[c].append(frozenset())
        keyed: list[frozenset] = []
        for k in range(1, width + 1):
            level = [(x, y) for x in combinations(names, k) if not any(s < set(x) for s in keyed) for y in names if y not in x and not any(s <= set(x) for s in decided[y])]
            need = {tuple(sorted((*x, y), key=names.index)) for x, y in level} | {x for x, _ in level}
            whole = [set(x) for x, size in sizes.items() if size == n]
            sizes |= {x: n for x in need - sizes.keys() if any(w <= set(x) for w in whole)}  # what holds a key is one
            sizes |= partition_sizes(df, sorted(need - sizes.keys()), n)
            for x, y in level:
                if sizes[x] == sizes[tuple(sorted((*x, y), key=names.index))]:
                    found.append((",".join(x), y, sizes[x] == n))
                    decided[y].append(frozenset(x))
            keyed += [frozenset(x) for x in combinations(names, k) if sizes.get(x) == n]
    return df.sparkSession.createDataFrame(found, DEPENDENCIES)


def recommendation(df: DataFrame, candidates: list[str] | None = None) -> DataFrame:
    """(kind, columns, advice): a key, and the columns that depend on one that is no key, which belong in a table of their own."""
    told = keys(df)
    named = candidates if candidates is not None else key_candidates(df)
    best = told.where("is_key").orderBy(F.when(F.col("column_name").isin(*named), 0).otherwise(1), "column_name").limit(1)
    key = best.select(F.lit("primary_key").alias("kind"), F.col("column_name").alias("columns"), F.lit("never null and never repeated").alias("advice"))
    moved = functional_dependencies(df, width=1).where(~F.col("is_key") & (F.col("determinant") != "")).groupBy("determinant").agg(F.array_join(F.array_sort(F.collect_list("dependent")), ",").alias("d"))
    lookups = moved.select(F.lit("lookup_table").alias("kind"), F.col("determinant").alias("columns"), F.concat(F.lit("decides "), F.col("d")).alias("advice"))
    return key.unionByName(lookups)
