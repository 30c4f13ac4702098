"""Duplicates, keys, quarantine and row accounting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .rows import written
from .shape import quoted

#: Words in a column's name that make it a timestamp.
TIME_WORDS = ("date", "time", "created", "updated")


def remove_duplicates(df: DataFrame) -> DataFrame:
    """One of each set of equal rows; nulls are equal."""
    return df.dropDuplicates()


def _picked(df: DataFrame, keys: list[str], rank: Column, least: bool) -> DataFrame:
    """One row per key, by an aggregate with a partial step, so that a hot key is no single task."""
    row = F.struct(*[quoted(c) for c in df.columns])
    best = (F.min_by if least else F.max_by)(row, rank)
    return df.groupBy(*[quoted(k).alias(f"__k{i}") for i, k in enumerate(keys)]).agg(best.alias("__row")).select("__row.*")


def _order(df: DataFrame, order_by: list[str]) -> Column:
    return F.struct(*[quoted(c) for c in order_by])


def first_per_key(df: DataFrame, keys: list[str], order_by: list[str]) -> DataFrame:
    """The first row of each key in the given order; all null keys are one key."""
    return _picked(df, keys, _order(df, order_by), True)


def timestamp_column(df: DataFrame) -> str | None:
    """The only datetime column, else the first whose name speaks of time, else the first."""
    times = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType))]
    named = [c for c in times if any(w in c.lower() for w in TIME_WORDS)]
    return times[0] if len(times) == 1 else next(iter(named or times), None)


def keep_latest(df: DataFrame, key: str, timestamp: str | None = None, order_by: list[str] | None = None) -> DataFrame:
    """The row with the greatest timestamp per key. A null timestamp is greatest; ties go to the last in ``order_by``."""
    timestamp = timestamp or timestamp_column(df)
    if timestamp is None:
        raise ValueError("no timestamp column was named or found")
    t = quoted(timestamp)
    rank = F.struct(t.isNull().alias("n"), t.alias("t"), *[quoted(c) for c in order_by or []])
    return _picked(df, [key], rank, False)


def key_candidates(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c == "id" or c.endswith("_id")]


#: Fixed value: the least share of distinct values in a detected key.
MIN_UNIQUE = 0.9


def detect_primary_key(df: DataFrame, min_unique: float = MIN_UNIQUE, candidates: list[str] | None = None) -> str | None:
    """The first id-like column whose distinct values are at least ``min_unique`` of its values."""
    names = candidates if candidates is not None else key_candidates(df)
    if not names:
        return None
    row = df.agg(*[x for c in names for x in (F.count(quoted(c)), F.count_distinct(quoted(c)))]).first()
    return next((c for i, c in enumerate(names) if row[2 * i] and row[2 * i + 1] >= min_unique * row[2 * i]), None)


def strict_primary_key(df: DataFrame, candidates: list[str] | None = None) -> str | None:
    """The first id-like column without nulls and repeats, in a table with rows."""
    names = candidates if candidates is not None else key_candidates(df)
    if not names:
        return None
    row = df.agg(F.count(F.lit(1)), *[x for c in names for x in (F.count(quoted(c)), F.count_distinct(quoted(c)))]).first()
    return next((c for i, c in enumerate(names) if row[0] and row[0] == row[2 * i + 1] == row[2 * i + 2]), None)


#: What becomes of a row.
LOADED, DUPLICATE, MISSING_KEY, REPEATED_KEY = "loaded", "duplicate", "missing_key", "repeated_key"


def row_hash(columns: list[str], df: DataFrame) -> list[Column]:
    """128 bits of the values of a row, in two columns; nulls count with their place."""
    parts = [x for c in columns for x in (F.to_json(quoted(c)) if isinstance(df.schema[c].dataType, T.MapType) else quoted(c), quoted(c).isNull())]
    return [F.xxhash64(*parts).alias("__h1"), F.xxhash64(F.lit("\u0001"), *reversed(parts)).alias("__h2")]


#: Rows with an outcome other than loaded are broadcast up to so many, and joined by their number beyond.
BROADCAST_ROWS = 500_000


def outcomes(df: DataFrame, pk: str | None, row: str = "_row", columns: list[str] | None = None) -> DataFrame:
    """(row, outcome) of the rows that are not loaded: copies of earlier rows, null keys, and keys that an earlier row has.

    Only the row's number, its key and a hash of 128 bits travel. First rows and
    first keys are minima with a partial step, and rows meet them by their own
    number, so neither a row nor a key of very many copies is one task's work.
    """
    columns = columns or [c for c in df.columns if c not in (row, "_raw")]
    key = quoted(pk) if pk else F.lit(None).cast("string")
    narrow = df.select(quoted(row).alias("__row"), key.alias("__key"), *row_hash(columns, df))
    first = narrow.groupBy("__h1", "__h2").agg(F.min(F.struct("__row", "__key")).alias("f")).select("f.*")
    status = first.select("__row", F.lit(LOADED).alias("__outcome"))
    if pk:
        keyed = first.where(F.col("__key").isNotNull()).groupBy("__key").agg(F.min("__row").alias("__row")).select("__row", F.lit(LOADED).alias("__won"))
        what = F.when(F.col("__key").isNull(), MISSING_KEY).otherwise(F.coalesce("__won", F.lit(REPEATED_KEY)))
        status = first.join(keyed, "__row", "left").select("__row", what.alias("__outcome"))
    return narrow.select("__row").join(status, "__row", "left").select("__row", F.coalesce("__outcome", F.lit(DUPLICATE)).alias("__outcome")).where(F.col("__outcome") != LOADED)


def with_outcome(df: DataFrame, pk: str | None, row: str = "_row", columns: list[str] | None = None, column: str = "_outcome") -> DataFrame:
    """``df`` with what becomes of each row: a copy of an earlier row is a duplicate, then null and repeated keys are set aside.

    ``row`` numbers the rows, each by a number of its own; ``columns`` are those
    compared. The rows that aren't loaded are written and counted first; where
    they are few, the table itself isn't shuffled.
    """
    odd = written(outcomes(df, pk, row, columns), "outcomes")
    odd = F.broadcast(odd) if odd.count() <= BROADCAST_ROWS else odd
    return df.join(odd, quoted(row) == F.col("__row"), "left").withColumn(column, F.coalesce("__outcome", F.lit(LOADED))).drop("__row", "__outcome")


def quarantine(tagged: DataFrame, pk: str, row: str = "_row", raw: str = "_raw", column: str = "_outcome") -> DataFrame:
    """(source_row, reason, raw) of the rows set aside."""
    reason = F.when(F.col(column) == MISSING_KEY, f"missing primary key '{pk}'").when(F.col(column) == REPEATED_KEY, f"duplicate primary key '{pk}' with conflicting values")
    return tagged.select(quoted(row).alias("source_row"), reason.alias("reason"), quoted(raw).alias("raw")).where("reason is not null")


def accounting(tagged: DataFrame, column: str = "_outcome") -> DataFrame:
    """source = loaded + duplicates + quarantined, as one row of counts."""
    n = lambda *what: F.count_if(F.col(column).isin(*what))
    return tagged.agg(
        F.count(F.lit(1)).alias("source_rows"), n(LOADED).alias("loaded_rows"), n(DUPLICATE).alias("exact_duplicates_removed"), n(MISSING_KEY, REPEATED_KEY).alias("quarantined_rows"),
    )


def identify_foreign_keys(df: DataFrame, others: dict[str, tuple[DataFrame, str]], candidates: list[str] | None = None) -> DataFrame:
    """Inclusion dependencies: (column, table, orphans, is_foreign_key) of candidate columns against other tables' keys."""
    out = None
    for c in candidates or key_candidates(df):
        for name, (table, key) in sorted(others.items()):
            values = df.select(quoted(c).alias("v")).where("v is not null").distinct()
            orphans = values.join(table.select(quoted(key).alias("v")).distinct(), "v", "left_anti").agg(F.count(F.lit(1)).alias("orphans"))
            row = orphans.select(F.lit(c).alias("column_name"), F.lit(name).alias("table_name"), "orphans", (F.col("orphans") == 0).alias("is_foreign_key"))
            out = row if out is None else out.unionByName(row)
    return out


def latest_first(df: DataFrame, order_by: str, k: int) -> DataFrame:
    """The k greatest by a column: a top-k, never a full sort."""
    return df.orderBy(quoted(order_by).desc()).limit(k)


def distinct_values(df: DataFrame, columns: list[str]) -> DataFrame:
    """The distinct values of some columns, in order: copies go before the sort, which is by ranges."""
    values = df.select(*map(quoted, columns)).distinct()
    return values.orderBy(*map(quoted, columns))
