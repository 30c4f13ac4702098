"""Records of runs: one commit file per run, which makes its steps and quarantined rows visible."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .commits import Commits

RUNS = (
    "run_id int, started_at timestamp, finished_at timestamp, source_system string, source_table string, target_system string, target_table string, mode string, "
    "source_rows long, loaded_rows long, duplicates_removed long, quarantined_rows long, status string, checksum string, error string"
)
STEPS = "run_id int, step_no int, column_name string, action string, detail string, rows_affected long"
QUARANTINE = "run_id int, source_row long, reason string, raw_row string"


class History:
    """Runs under one folder. A run's steps and quarantine are written to a folder of their own first; the commit file names it.

    So a run that fails half-way leaves no trace that readers see, and runs that
    end at once get numbers of their own.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.commits = Commits(spark, f"{self.root}/runs")

    def runs(self, k: int = 20) -> DataFrame:
        """The newest k runs."""
        newest = self.commits.numbers()[-k:] if k > 0 else []
        if not newest:
            return self.spark.createDataFrame([], RUNS)
        number = F.regexp_extract(F.input_file_name(), r"(\d+)$", 1).cast("int")
        return self.spark.read.schema(RUNS).json([self.commits.path(n) for n in newest]).withColumn("run_id", number).orderBy(F.desc("run_id"))

    def _part(self, run_id: int, name: str, schema: str, order: str) -> DataFrame:
        if run_id not in self.commits.numbers():
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema.split(", ", 1)[1]).parquet(f"{self.commits.get(run_id)['folder']}/{name}")
        return rows.select(F.lit(run_id).alias("run_id"), "*").orderBy(order)

    def steps(self, run_id: int) -> DataFrame:
        return self._part(run_id, "steps", STEPS, "step_no")

    def quarantine(self, run_id: int) -> DataFrame:
        return self._part(run_id, "quarantine", QUARANTINE, "source_row")

    def record(self, log: DataFrame, quarantine: DataFrame, accounting: dict[str, int], status: str = "success", checksum: str | None = None, error: str | None = None, started: datetime | None = None, **names) -> int:
        """Add a run with its steps and quarantined rows; the id is the next free number. The accounting has to add up."""
        if status == "success" and accounting["source_rows"] != accounting["loaded_rows"] + accounting["exact_duplicates_removed"] + accounting["quarantined_rows"]:
            raise ValueError(f"the accounting doesn't add up: {accounting}")
        now, folder = datetime.now(), f"{self.root}/data/{uuid.uuid4().hex}"
        run = {"started_at": (started or now).isoformat(), "finished_at": now.isoformat(), **{n: names.get(n) for n in ("source_system", "source_table", "target_system", "target_table", "mode")}}
        run |= {"source_rows": accounting["source_rows"], "loaded_rows": accounting["loaded_rows"], "duplicates_removed": accounting["exact_duplicates_removed"], "quarantined_rows": accounting["quarantined_rows"]}
        log.select("step_no", "column_name", "action", "detail", "rows_affected").write.parquet(f"{folder}/steps")
        quarantine.select("source_row", "reason", F.col("raw").alias("raw_row")).write.parquet(f"{folder}/quarantine")
        return self.commits.append(run | {"status": status, "checksum": checksum, "error": error, "folder": folder})
