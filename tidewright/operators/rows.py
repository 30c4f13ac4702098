"""Row order: numbering, and carrying values along it, without a sort in one task."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shape import quoted


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the folder of ``spark.checkpoint.dir`` and read again, so that later reads agree and survive lost executors.

    Only on a single machine (a local master) that setting may be absent, and a temporary folder is taken.
    What is written is deleted when the session's process ends.
    """
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def folder(spark: SparkSession, name: str) -> str:
    """The path of a new folder under ``spark.checkpoint.dir``, deleted when the session's process ends."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tidewright-")
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    atexit.register(_delete, spark, path)
    return path


def spread(df: DataFrame) -> DataFrame:
    """``df`` in at least as many partitions as there are cores, for work that is heavy for its bytes; the rows' order is lost where there were fewer."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.isStreaming or df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def _delete(spark: SparkSession, path: str) -> None:
    try:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001  the session may be gone at exit
        pass


def with_row(df: DataFrame, order_by: list[str], column: str = "_row") -> DataFrame:
    """Rows numbered from 1 in the order of ``order_by``; ties are in the order of the other columns that can be ordered.

    Ranges of the order go to partitions, which are counted; each then numbers
    its own rows from its offset. The offsets table has a row per partition.
    """
    rest = [f.name for f in df.schema.fields if f.name not in order_by and not isinstance(f.dataType, (T.MapType, T.VariantType))]
    order = [quoted(c) for c in [*order_by, *rest]]
    parts = written(df.repartitionByRange(*order[: len(order_by)]).withColumn("__part", F.spark_partition_id()), "rows")
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.groupBy("__part").count().select("__part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__skip"))
    inside = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return parts.join(F.broadcast(offsets), "__part").withColumn(column, (F.col("__skip") + inside).cast("long")).drop("__part", "__skip")


def carry(df: DataFrame, column: str, order_by: str, forward: bool = True, partition_by: list[str] | None = None, blocks: int | None = None) -> DataFrame:
    """Nulls of ``column`` filled by the last value before (or the next after) in the order of any column that can be ordered, within groups if named.

    Rows are cut into sampled ranges of (group, order), so that a group or a value of the order
    with very many rows is spread over them. Each range has one summary: its first and last
    group and the value it would hand on. Those are carried along the table of
    ranges, and the rest is a window inside each range. Equal places in the order
    are told apart by a hash of the row; null ones come first, and null groups are one group.
    ``blocks`` is the number of ranges, by default that of shuffle partitions.
    """
    groups = [quoted(c) for c in partition_by or []]
    group = F.struct(*groups, F.lit(0).alias("__one")).alias("__group")
    plain = [quoted(c) for f, c in zip(df.schema.fields, df.columns, strict=True) if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    ordered = df.select(*[quoted(c) for c in df.columns], group, F.xxhash64(*plain).alias("__tie"))
    ranges = [*([blocks] if blocks else []), "__group", quoted(order_by), "__tie"]
    parts = written(ordered.repartitionByRange(*ranges).withColumn("__part", F.spark_partition_id()), "carried")
    value, place = quoted(column), F.struct("__group", quoted(order_by).alias("o"), "__tie")
    handed = F.when(value.isNotNull(), F.struct(F.col("__group").alias("g"), value.alias("v")))
    ends = parts.groupBy("__part").agg(
        (F.min if forward else F.max)("__group").alias("near"),
        (F.max_by if forward else F.min_by)(handed, F.when(value.isNotNull(), place)).alias("edge"),
    )
    # backward is forward in the reverse order: a frame that ends at the last row is made anew for each row
    along = F.asc if forward else F.desc
    before = F.last("edge", ignorenulls=True).over(Window.orderBy(along("__part")).rowsBetween(Window.unboundedPreceding, -1))  # a row per range
    brought = ends.withColumn("before", before).where(F.col("before.g") == F.col("near")).select("__part", F.col("near").alias("__near"), F.col("before.v").alias("__brought"))
    inside = F.last(value, ignorenulls=True).over(Window.partitionBy("__part", "__group").orderBy(along(quoted(order_by)), along("__tie")).rowsBetween(Window.unboundedPreceding, 0))
    out = parts.withColumn("__inside", inside).join(F.broadcast(brought.withColumnRenamed("__part", "__of")), (F.col("__part") == F.col("__of")) & (F.col("__group") == F.col("__near")), "left")
    return out.withColumn(column, F.coalesce("__inside", "__brought")).select(*[quoted(c) for c in df.columns])
