"""Profiling in a fixed number of passes, however many columns there are."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .quantiles import quantiles
from .rows import written
from .shape import quoted

#: Placeholders that a profile reports, and the weights of the quality score.
SENTINELS = ("ERROR", "UNKNOWN", "N/A", "MISSING", "999", "NULL", "NONE", "NA", "UNDEFINED")
MISSING_WEIGHT, DUPLICATE_WEIGHT, UNIQUE_WEIGHT, OUTLIER_WEIGHT = 0.4, 0.3, 0.15, 0.15
FENCE = 1.5
NESTED = (T.StructType, T.ArrayType, T.MapType)


def is_missing(df: DataFrame, column: str) -> Column:
    c = quoted(column)
    return c.isNull() | (F.trim(c) == "") if isinstance(df.schema[column].dataType, T.StringType) else c.isNull()


def _columns(df: DataFrame, kind, without=()) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, kind) and not isinstance(f.dataType, tuple(without))]


def numeric(df: DataFrame) -> list[str]:
    return _columns(df, T.NumericType)


def quartiles(df: DataFrame, columns: list[str], exact: bool = True) -> dict[str, tuple[float | None, float | None, float | None]]:
    """(Q1, median, Q3) per column with linear interpolation, by rank selection. ``exact=False`` takes one pass of mergeable sketches."""
    if exact or not columns:
        return quantiles(df, columns)
    at = F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))
    row = df.agg(*[F.percentile_approx(quoted(c).cast("double"), at, 100_000) for c in columns]).first()
    return {c: tuple(v) if v is not None else (None, None, None) for c, v in zip(columns, row, strict=True)}


def _fence(q: tuple) -> tuple[float | None, float | None]:
    return (None, None) if q[0] is None else (q[0] - FENCE * (q[2] - q[0]), q[2] + FENCE * (q[2] - q[0]))


def outlier_bounds(df: DataFrame, column: str) -> tuple[float | None, float | None]:
    return _fence(quartiles(df, [column])[column])


def detect_outliers(df: DataFrame, column: str) -> DataFrame:
    """``column_is_outlier``; null values are none."""
    low, high = outlier_bounds(df, column)
    return df.withColumn(f"{column}_is_outlier", F.coalesce(~quoted(column).between(low, high), F.lit(False)) if low is not None else F.lit(False))


def clip_outliers(df: DataFrame, column: str) -> DataFrame:
    low, high = outlier_bounds(df, column)
    c = quoted(column).cast("double")
    return df.withColumn(column, F.when(c < low, F.lit(low)).when(c > high, F.lit(high)).otherwise(c)) if low is not None else df


def _union(rows: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, rows)


def flag_outliers(df: DataFrame) -> DataFrame:
    """(column_name, outliers, low, high) of each numeric column with four values or more, a spread, and outliers."""
    columns = numeric(df)
    fences = {c: _fence(q) for c, q in quartiles(df, columns).items()}
    usable = [c for c in columns if fences[c][0] is not None and fences[c][0] < fences[c][1]]
    spark = df.sparkSession
    empty = spark.createDataFrame([], "column_name string, outliers long, low double, high double")
    if not usable:
        return empty
    totals = df.agg(*[F.count_if(~quoted(c).between(*fences[c])).alias(f"o{i}") for i, c in enumerate(usable)], *[F.count(quoted(c)).alias(f"n{i}") for i, c in enumerate(usable)])
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"o{i}").alias("outliers"), F.col(f"n{i}").alias("n"), F.lit(fences[c][0]).alias("low"), F.lit(fences[c][1]).alias("high")) for i, c in enumerate(usable)])).alias("r")
    return totals.select(rows).select("r.*").where("n >= 4 and outliers > 0").drop("n")


def missing_counts(df: DataFrame) -> DataFrame:
    """(column_name, missing_count, missing_pct): nulls and blanks, all columns in one pass."""
    total = F.count(F.lit(1))
    row = df.agg(total.alias("rows"), *[F.count_if(is_missing(df, c)).alias(f"m{i}") for i, c in enumerate(df.columns)])
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"m{i}").alias("missing_count")) for i, c in enumerate(df.columns)])).alias("r")
    pct = F.when(F.col("rows") > 0, F.col("missing_count") * 100.0 / F.col("rows")).otherwise(0.0)
    return row.select("rows", each).select("r.*", "rows").select("column_name", "missing_count", F.round(pct, 2).alias("missing_pct"))


def null_cells(df: DataFrame) -> DataFrame:
    """One row: the null cells of the whole table."""
    return df.agg(*[F.count_if(quoted(c).isNull()).alias(f"m{i}") for i, c in enumerate(df.columns)]).select(sum((F.col(f"m{i}") for i in range(len(df.columns))), F.lit(0)).cast("long").alias("null_cells"))


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, value, n) of all columns from one shuffle with a partial step: no expansion by distinct aggregates."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), quoted(c).cast("string").alias("value")) for c in columns])).alias("p")
    return df.select(pairs).select("p.*").where("value is not null").groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))


def unique_counts(df: DataFrame, exact: bool = True, counts: DataFrame | None = None) -> DataFrame:
    """(column_name, unique_count, non_null_count, duplicate_count) over the values that aren't null.

    ``counts`` are the table's :func:`value_counts` where they are there already.
    ``exact=False`` takes sketches (see :func:`distinct_sketches`), for which no cell is shuffled.
    """
    flat = [f.name for f in df.schema.fields if not isinstance(f.dataType, NESTED)]
    if exact:
        got = (value_counts(df, flat) if counts is None else counts).groupBy("column_name").agg(F.count(F.lit(1)).alias("unique_count"), F.sum("n").alias("non_null_count"))
    else:
        found = sketched_counts(distinct_sketches(df, flat))
        got = found.where("n > 0").select("column_name", F.least("unique_count", "n").alias("unique_count"), F.col("n").alias("non_null_count"))
    return got.withColumn("duplicate_count", F.col("non_null_count") - F.col("unique_count"))


def count_distinct(df: DataFrame, keys: list[str], exact: bool = True) -> DataFrame:
    """One row (n_distinct): the distinct keys without nulls. ``exact=False`` takes a sketch of their hashes."""
    whole = df.select(*[quoted(k).alias(f"k{i}") for i, k in enumerate(keys)]).dropna()
    if exact:
        return whole.distinct().agg(F.count(F.lit(1)).alias("n_distinct"))
    return whole.agg(F.hll_sketch_estimate(F.hll_sketch_agg(F.xxhash64(*whole.columns), F.lit(SKETCH_BITS))).alias("n_distinct"))


#: Sketches have 2 to this power registers; estimates are off by ``SKETCH_ERROR`` times the count as a rule, and by three times that hardly ever.
SKETCH_BITS = 14
SKETCH_ERROR = 0.83 / 2 ** (SKETCH_BITS / 2)


def distinct_sketches(df: DataFrame, columns: list[str] | None = None, by: list[str] | None = None) -> DataFrame:
    """(by..., column_name, n, sketch): what is needed to count the distinct values of each column, per group if any.

    One aggregate with a partial step: a task sends a sketch of some kilobytes
    a column, however many values there are. Rows of it can be kept, one set for each day
    or file, and merged later by :func:`sketched_counts` without the data.
    """
    columns = columns or [f.name for f in df.schema.fields if not isinstance(f.dataType, NESTED)]
    text = [quoted(c).cast("string") for c in columns]
    aggs = [x for i, c in enumerate(text) for x in (F.hll_sketch_agg(c, F.lit(SKETCH_BITS)).alias(f"s{i}"), F.count(c).alias(f"n{i}"))]
    by = by or []
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"n{i}").alias("n"), F.col(f"s{i}").alias("sketch")) for i, c in enumerate(columns)])).alias("x")
    return df.groupBy(*map(quoted, by)).agg(*aggs).select(*map(quoted, by), each).select(*map(quoted, by), "x.*")


def sketched_counts(sketches: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by..., column_name, n, unique_count, least, most): sketches merged, with bounds that hold but once in some hundred times."""
    keys = [*(by or []), "column_name"]
    merged = sketches.groupBy(*map(quoted, keys)).agg(F.sum("n").alias("n"), F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("unique_count"))
    off = F.col("unique_count") * (3 * SKETCH_ERROR)
    return merged.withColumns({"least": F.floor(F.col("unique_count") - off), "most": F.ceil(F.col("unique_count") + off)})


def duplicate_rows(df: DataFrame, exact: bool = True) -> DataFrame:
    """One row: how many rows repeat an earlier one, told apart by hashes of 128 bits. ``exact=False`` sketches the hashes, and shuffles none."""
    plain = df.select(*[F.to_json(quoted(f.name)).alias(f"c{i}") if isinstance(f.dataType, NESTED) else quoted(f.name).alias(f"c{i}") for i, f in enumerate(df.schema.fields)])
    parts = [x for c in plain.columns for x in (F.col(c), F.col(c).isNull())]
    hashes = plain.select(F.xxhash64(*parts).alias("a"), F.xxhash64(F.lit(1), *reversed(parts)).alias("b"))
    if not exact:
        estimate = F.hll_sketch_estimate(F.hll_sketch_agg(F.col("a"), F.lit(SKETCH_BITS)))
        return hashes.agg(F.greatest(F.lit(0), F.count(F.lit(1)) - estimate).alias("duplicate_rows"))
    return hashes.groupBy("a", "b").count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("duplicate_rows"))


def detect_sentinels(df: DataFrame) -> DataFrame:
    """(column_name, value, n): placeholders in text columns, and one row with an empty value for blanks."""
    columns = _columns(df, T.StringType)
    if not columns:
        return df.sparkSession.createDataFrame([], "column_name string, value string, n long")
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), quoted(c).alias("value")) for c in columns])).alias("p")
    trimmed = F.trim("value")
    found = df.select(pairs).select("p.*").where(F.upper(trimmed).isin(*SENTINELS) | (trimmed == ""))
    return found.groupBy("column_name", F.when(trimmed == "", "").otherwise(F.col("value")).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def sample_values(df: DataFrame, k: int = 5, exact: bool = True, counts: DataFrame | None = None) -> DataFrame:
    """(column_name, values): the k smallest distinct values as text.

    From counted values by default (``counts``, where they are there already). ``exact=False`` gives the same by k minima, each above the one
    before, which shuffle nothing but read the table k times.
    """
    flat = [f.name for f in df.schema.fields if not isinstance(f.dataType, NESTED)]
    if not exact:
        text = {c: quoted(c).cast("string") for c in flat}
        found: dict[str, list[str]] = {c: [] for c in flat}
        for i in range(k):
            row = df.agg(*[F.min(F.when(v > F.lit(found[c][-1]), v) if found[c] else v) if len(found[c]) == i else F.lit(None) for c, v in text.items()]).first()
            for c, v in zip(flat, row, strict=True):
                found[c] += [] if v is None else [v]
        return df.sparkSession.createDataFrame([(c, v) for c, v in found.items() if v], "column_name string, values array<string>")
    from pyspark.sql import Window

    top = F.row_number().over(Window.partitionBy("column_name").orderBy("value"))
    ranked = (value_counts(df, flat) if counts is None else counts).select("column_name", "value")
    return ranked.withColumn("r", top).where(F.col("r") <= k).groupBy("column_name").agg(F.array_sort(F.collect_list("value")).alias("values"))


def numeric_stats(df: DataFrame, columns: list[str] | None = None, exact: bool = True) -> DataFrame:
    """(column_name, min, max, mean, median, std, q1, q3, iqr, lower, upper, outlier_count, outlier_pct) in two passes."""
    columns = columns or numeric(df)
    q = quartiles(df, columns, exact)
    aggs = []
    for i, c in enumerate(columns):
        v, (low, high) = quoted(c).cast("double"), _fence(q[c])
        outliers = F.count_if(~v.between(low, high)) if low is not None else F.lit(0).cast("long")
        aggs += [F.min(v).alias(f"mn{i}"), F.max(v).alias(f"mx{i}"), F.avg(v).alias(f"av{i}"), F.stddev_samp(v).alias(f"sd{i}"), F.count(v).alias(f"n{i}"), outliers.alias(f"o{i}")]
    number = lambda x: F.lit(x).cast("double")
    rows = []
    for i, c in enumerate(columns):
        low, high = _fence(q[c])
        q1, q2, q3 = q[c]
        rows.append(F.struct(
            F.lit(c).alias("column_name"), F.col(f"mn{i}").alias("min"), F.col(f"mx{i}").alias("max"), F.col(f"av{i}").alias("mean"), number(q2).alias("median"), F.col(f"sd{i}").alias("std"),
            number(q1).alias("q1"), number(q3).alias("q3"), number(None if q1 is None else q3 - q1).alias("iqr"), number(low).alias("lower"), number(high).alias("upper"), F.col(f"o{i}").cast("long").alias("outlier_count"),
            F.when(F.col(f"n{i}") > 0, F.col(f"o{i}") * 100.0 / F.col(f"n{i}")).otherwise(0.0).alias("outlier_pct")))
    return df.agg(*aggs).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def structure(df: DataFrame) -> DataFrame:
    """(column_name, structural_type, nested_keys, nested_depth) from the schema; JSON text is flat here (see :func:`json_structure`)."""

    def walk(kind: T.DataType, prefix: str = "") -> tuple[list[str], int]:
        if isinstance(kind, T.ArrayType):
            keys, depth = walk(kind.elementType, prefix)
            return keys, depth + 1
        if isinstance(kind, T.StructType):
            keys, depth = [], 0
            for f in kind.fields:
                inner, d = walk(f.dataType, f"{prefix}{f.name}.")
                keys += [f"{prefix}{f.name}", *inner]
                depth = max(depth, d)
            return keys, depth + 1
        return [], 0

    rows = []
    for f in df.schema.fields:
        keys, depth = walk(f.dataType)
        kind = "nested_array" if isinstance(f.dataType, T.ArrayType) else "nested_object" if isinstance(f.dataType, (T.StructType, T.MapType)) else "flat"
        rows.append((f.name, kind, sorted(set(keys)), depth))
    return df.sparkSession.createDataFrame(rows, "column_name string, structural_type string, nested_keys array<string>, nested_depth int")


def json_structure(df: DataFrame, column: str) -> DataFrame:
    """(key, n) of the keys of JSON objects held as text."""
    return df.select(F.explode(F.json_object_keys(quoted(column))).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n"))


#: Levels of nesting that are followed in JSON text.
DEEPEST = 64


def json_paths(df: DataFrame, column: str) -> DataFrame:
    """(path, depth, types, n) of JSON held as text: the kinds of value at each path, over all rows, with how many there are.

    Paths are keys joined by dots; ``[]`` stands for the items of an array, and an empty path for
    the whole text. Kinds are null, bool, int, float, string, object and array;
    sets of them are merged by union, so parts of a table can be merged too. Texts
    that are no JSON are left out. Each level of nesting is a pass over what is nested deeper.
    """
    spark = df.sparkSession
    told = F.schema_of_variant("v")
    kind = (
        F.when(told.startswith("OBJECT"), "object").when(told.startswith("ARRAY"), "array").when(told == "VOID", "null").when(told == "BOOLEAN", "bool").when(told == "BIGINT", "int")
        .when(told.startswith("DECIMAL") | told.isin("DOUBLE", "FLOAT"), "float").otherwise("string")
    )
    level = df.select(F.lit("").alias("path"), F.try_parse_json(quoted(column)).alias("v")).where("v is not null").select("path", "v", kind.alias("kind"))
    counted = []
    for depth in range(DEEPEST):
        counted.append(level.groupBy("path", "kind").count().withColumn("depth", F.lit(depth)))
        nested = level.where(F.col("kind").isin("object", "array"))
        if nested.isEmpty():
            break
        inner = nested.select("path", "kind", "v").lateralJoin(spark.tvf.variant_explode(F.col("v").outer()).toDF("pos", "key", "value"))
        path = F.when(F.col("kind") == "array", F.concat("path", F.lit("[]"))).otherwise(F.concat("path", F.when(F.col("path") == "", "").otherwise("."), "key"))
        # as text, so that the next levels read what is nested there and not the whole table
        below = written(inner.select(path.alias("path"), F.to_json("value").alias("value")), "nested")
        level = below.select("path", F.parse_json("value").alias("v")).select("path", "v", kind.alias("kind"))
    return _union(counted).groupBy("path", "depth").agg(F.array_sort(F.collect_set("kind")).alias("types"), F.sum("count").alias("n"))


def profile(df: DataFrame, sample_limit: int | None = None, exact: bool = True) -> tuple[DataFrame, dict]:
    """A row per column, and the table's own figures (row_count, duplicate_rows, is_sampled, quality_score).

    The whole table is profiled; ``sample_limit`` takes the first rows only, as
    a preview. ``exact=False`` counts distinct values and finds quartiles by
    mergeable sketches, and shuffles no cells.
    """
    sampled = False
    if sample_limit is not None:
        sampled = df.limit(sample_limit + 1).count() > sample_limit
        df = df.limit(sample_limit) if sampled else df
    rows = df.count()
    flat = [f.name for f in df.schema.fields if not isinstance(f.dataType, NESTED)]
    counts = written(value_counts(df, flat), "values") if exact and flat else None
    base = missing_counts(df).join(unique_counts(df, exact, counts), "column_name", "left").na.fill(0, ["unique_count", "non_null_count", "duplicate_count"])
    kinds = df.sparkSession.createDataFrame(list(df.dtypes), "column_name string, dtype string")
    out = kinds.join(base, "column_name").join(structure(df), "column_name")
    if names := numeric(df):
        out = out.join(numeric_stats(df, names, exact), "column_name", "left")
    else:
        out = out.withColumns({c: F.lit(None).cast("double") for c in ("min", "max", "mean", "median", "std", "q1", "q3", "iqr", "lower", "upper", "outlier_pct")}).withColumn("outlier_count", F.lit(None).cast("long"))
    found = detect_sentinels(df).groupBy("column_name").agg(F.array_sort(F.collect_list("value")).alias("suspected_sentinels"))
    out = out.join(found, "column_name", "left").join(sample_values(df, exact=exact, counts=counts).withColumnRenamed("values", "sample_values"), "column_name", "left")
    out = written(out, "profile")  # the score is made from it too
    out = out.withColumn("suspected_sentinels", F.coalesce("suspected_sentinels", F.array().cast("array<string>")))
    pct = F.round(F.col("unique_count") * 100.0 / F.lit(rows), 2) if rows else F.lit(0.0)
    out = out.withColumn("unique_pct", pct).withColumn("is_potential_pk", (F.col("missing_count") == 0) & ((F.col("unique_count") == rows) if exact else (F.col("unique_count") >= rows * (1 - 3 * SKETCH_ERROR))) & F.lit(rows > 0))
    copies = duplicate_rows(df, exact).first()[0]
    score = quality_score(out, copies, rows).first()[0]
    return out, {"row_count": rows, "column_count": len(df.columns), "duplicate_rows": copies, "is_sampled": sampled, "quality_score": score}


def quality_score(columns: DataFrame, duplicates: int, rows: int) -> DataFrame:
    """One row: 100 less the weighted shares of missing values, copies, repeats outside keys, and outliers; within 0 to 100."""
    if not rows:
        return columns.sparkSession.createDataFrame([(0.0,)], "quality_score double")
    low = F.avg(F.when(~F.col("is_potential_pk"), 100 - F.col("unique_pct")))
    score = 100 - F.avg("missing_pct") * MISSING_WEIGHT - F.lit(duplicates * 100.0 / rows) * DUPLICATE_WEIGHT - F.coalesce(low, F.lit(0.0)) * UNIQUE_WEIGHT - F.coalesce(F.avg("outlier_pct"), F.lit(0.0)) * OUTLIER_WEIGHT
    return columns.agg(F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), score)), 2).alias("quality_score"))


def group_average(df: DataFrame, by: str, measure: str) -> DataFrame:
    """(by, n, avg) per group, most rows first."""
    return df.groupBy(quoted(by)).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(quoted(measure)), 2).alias("avg_value")).orderBy(F.desc("n"), quoted(by))
