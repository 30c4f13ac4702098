"""What the operators of this subpackage share: written intermediate tables, table reading, tokens and hashes."""

from __future__ import annotations

import atexit
import tempfile
import uuid

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Upper-case ASCII letters and their lower-case forms; the contracts lower-case these alone.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Scratch:
    """Tables written to the folder that all executors share, to cut lineage.

    The folder is ``spark.checkpoint.dir`` of the session. Only on a single
    machine (a local master) it may be unset, and a temporary folder is used.
    Tables are Parquet files, so a lost executor costs nothing that was
    written before.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="tidewright-")
        self.root = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
        #: Entries of the catalog that go with the files.
        self.tables: list[str] = []
        atexit.register(self.drop)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` once and return a DataFrame that reads it."""
        path = f"{self.root}/{name}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def forget(self, df: DataFrame) -> None:
        """Delete the files behind a table of ``save`` that nothing reads any more."""
        for f in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
            if f.startswith(self.root) or f.replace("file:///", "file:/").startswith(self.root.replace("file:///", "file:/")):
                self._delete(f)

    def drop(self) -> None:
        """Delete all of it. Called at exit; a caller may call it once results are written."""
        try:
            for t in self.tables:
                self.spark.sql(f"DROP TABLE IF EXISTS {t}")
            self.tables.clear()
            self._delete(self.root)
        except Exception:  # noqa: BLE001  the session may be gone at exit
            pass

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def words(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) words between ASCII white space, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


class WordHash(dict):
    """word -> 64-bit hash, remembered up to ``limit`` words at a time."""

    limit = 400_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h

    def of(self, tokens: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, tokens), np.uint64, len(tokens))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n = f"_{n}"
        taken.add(n.lower())
        out.append(n)
    return out


def crc_of(column) -> F.Column:
    """crc32 of a value written as text; 0 for null."""
    return F.coalesce(F.crc32(F.encode(column.cast("string"), "UTF-8")), F.lit(0))
