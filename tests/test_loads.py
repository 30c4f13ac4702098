"""Loads, run records, stored definitions and database files: what is seen when something fails or happens twice."""

import sqlite3
import threading

import pytest
from pyspark.sql import functions as F

from tidewright.functions import text
from tidewright.operators import design, verify
from tidewright.plans import steps
from tidewright.sources import commits, filedb, readers, records, writers


def test_each_number_is_taken_once(spark, tmp_path):
    log = commits.Commits(spark, f"file://{tmp_path}/log")
    assert log.numbers() == [] and log.put(1, {"a": 1}) and not log.put(1, {"a": 2}) and log.get(1) == {"a": 1}
    threads = [threading.Thread(target=lambda k=k: commits.Commits(spark, f"file://{tmp_path}/log").append({"by": k})) for k in range(6)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert log.numbers() == list(range(1, 8)) and {log.get(n).get("by") for n in range(2, 8)} == set(range(6))
    assert not [f for f in (tmp_path / "log").iterdir() if "tmp" in f.name]


def test_runs_are_whole_or_absent(spark, tmp_path):
    history = records.History(spark, str(tmp_path))
    log = spark.createDataFrame([(1, "c", "a", "d", 2)], "step_no int, column_name string, action string, detail string, rows_affected long")
    aside = spark.createDataFrame([(7, "r", "{}")], "source_row long, reason string, raw string")
    facts = {"source_rows": 3, "loaded_rows": 2, "exact_duplicates_removed": 0, "quarantined_rows": 1}
    assert history.runs().count() == 0 and history.steps(1).count() == 0
    assert [history.record(log, aside, facts, source_table=f"t{i}") for i in (1, 2)] == [1, 2]
    with pytest.raises(ValueError, match="add up"):
        history.record(log, aside, facts | {"loaded_rows": 9})
    broken = aside.withColumn("raw", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        history.record(log, broken, facts)
    assert [(r["run_id"], r["source_table"], r["loaded_rows"]) for r in history.runs().collect()] == [(2, "t2", 2), (1, "t1", 2)]
    assert history.steps(2).count() == 1 and history.quarantine(2).first()["source_row"] == 7 and history.runs(1).count() == 1


@pytest.fixture
def database(tmp_path):
    return f"jdbc:derby:{tmp_path}/db;create=true", "org.apache.derby.iapi.jdbc.AutoloadedDriver"


def test_a_failed_load_leaves_the_old_table(spark, database):
    url, driver = database
    made = design.TableDef("T", [design.ColumnDef("ID", "BIGINT", False, "pk")], "ID")
    old, new = spark.range(10).toDF("ID"), spark.range(20).toDF("ID")
    assert writers.load_table(old, "T", url, made, driver=driver) == 10
    read = lambda: readers.read_jdbc_table(spark, url, "T", driver=driver).count()
    for bad in (new.union(new), new.withColumn("ID", F.when(F.col("ID") != 3, F.col("ID"))), new.withColumn("ID", F.assert_true(F.col("ID") < 15).isNull().cast("long"))):
        with pytest.raises(writers.LoadError):
            writers.load_table(bad, "T", url, made, driver=driver)
        assert read() == 10
    assert writers.load_table(new, "T", url, made, driver=driver) == 20 and read() == 20


def test_ranges_of_a_skewed_key_hold_as_many_rows(spark, database):
    url, driver = database
    skewed = spark.range(4000).select(F.when(F.col("id") < 3900, F.col("id")).otherwise(F.col("id") * 1_000_000).alias("K"))
    writers.write_table(skewed.union(spark.sql("SELECT CAST(NULL AS BIGINT)")), "S", url, driver=driver)
    got = readers.read_jdbc_table(spark, url, "S", "K", partitions=5, driver=driver)
    sizes = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 5 and max(sizes) <= 2 * min(sizes) and got.count() == 4001 and got.where("K is null").count() == 1


def test_what_is_stored_is_compared_with_the_plan(spark, tmp_path):
    cols = [design.ColumnDef("id", "INT", False, "pk"), design.ColumnDef("price", "DECIMAL(12,2)", True, "money", "money")]
    made, store = design.TableDef("t", cols, "id"), writers.Store(spark, f"file://{tmp_path}/s")
    store.publish([(made, spark.createDataFrame([(1, 2.5)], "id int, price double"))])
    assert verify.definition_changes(made, store.read("t")).count() == 0
    cols[1] = design.ColumnDef("price", "DOUBLE", False, "float")
    changed = {(r["column_name"], r["property"]): (r["planned"], r["stored"]) for r in verify.definition_changes(made, store.read("t")).collect()}
    assert changed == {("price", "sql_type"): ("DOUBLE", "DECIMAL(12,2)"), ("price", "nullable"): ("false", "true"), ("price", "rule"): (None, "money")}
    with pytest.raises(writers.LoadError):
        store.publish([(made, spark.createDataFrame([(1, None)], "id int, price double"))])
    assert store.read("t").count() == 1


@pytest.mark.parametrize("engine", ["sqlite", "duckdb"])
def test_database_files(spark, tmp_path, engine):
    df = spark.range(0, 1000, 1, 3).select("id", F.when(F.col("id") % 7 != 0, F.concat(F.lit("ü'"), "id")).alias("name"), (F.col("id") / 4).alias("x y"), (F.col("id") % 2 == 0).alias("even"), F.lit(None).cast("date").alias("day"))
    assert filedb.write(df, f"file://{tmp_path}/{engine}", "t", engine) == 1000
    got = filedb.read(spark, f"file://{tmp_path}/{engine}", "t", engine, rows=100)
    assert got.rdd.getNumPartitions() >= 10 and [f.dataType.simpleString() for f in got.schema.fields] == ["bigint", "string", "double", "boolean", "string"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, df.withColumn("day", F.col("day").cast("string")).collect()), key=str)
    for condition in ("id >= 990", "name is null", "`x y` < 3.5 and even", "name = \"ü'15\"", "id = 3 or id = 5", "day is not null"):
        assert got.where(condition).count() == df.where(condition).count(), condition
    few = filedb.read(spark, f"file://{tmp_path}/{engine}", "t", engine, columns=["name", "id"], where="id >= 990 OR name IS NULL")
    assert few.columns == ["name", "id"] and few.count() == few.count() == df.where("id >= 990 or name is null").count() and few.where("id < 990").count() == 142


def test_a_database_of_ones_own(spark, tmp_path):
    con = sqlite3.connect(tmp_path / "own.db")
    con.execute("CREATE TABLE t (a INT, b TEXT)")
    con.executemany("INSERT INTO t VALUES (?, ?)", [(1, "x"), (2, 7), (None, None)])
    con.execute("DELETE FROM t WHERE a = 1")
    con.commit()
    con.close()
    assert sorted(map(str, filedb.read(spark, f"{tmp_path}/own.db", "t").collect())) == ["Row(a=2, b='7')", "Row(a=None, b=None)"]


def test_reports_of_steps(spark):
    orders = spark.createDataFrame([(1, 10, "u"), (2, 10, "u"), (3, 11, "v")], "order_id int, customer int, segment string")
    customers = spark.createDataFrame([(10,), (11,), (12,)], "id int")
    out = steps.apply_steps(orders, [{"action": a} for a in steps.EVALUATED], name="orders", tables={"customers": customers})
    assert [x["status"] for x in out.log] == ["success"] * 4 and out.df.collect() == orders.collect()
    assert {(r["column_name"], r["is_key"]) for r in out.report(0).collect()} == {("order_id", True), ("customer", False), ("segment", False)}
    assert [(r["column_name"], r["orphans"]) for r in out.report(1).where("included").collect()] == [("customer", 0)]
    assert [tuple(r)[:4] for r in out.report(2).collect()] == [("customers", "id", "orders", "customer")][:0] + [("orders", "customer", "customers", "id")]
    assert ("primary_key", "order_id") in {(r["kind"], r["columns"]) for r in out.report(3).collect()}


def test_rare_dates_and_encodings(spark, tmp_path):
    want = {
        "Thu, 02 Jan 2020 03:04:05 GMT": "2020-01-02 03:04:05", "20200102T030405": "2020-01-02 03:04:05", "20200102030405": "2020-01-02 03:04:05", "2020-01-02T03:04:05 -08": "2020-01-02 11:04:05",
        "2-Jan-20": "2020-01-02 00:00:00", "2 Jan 71": "1971-01-02 00:00:00", "Jan 2020": "2020-01-01 00:00:00", "2020-01": "2020-01-01 00:00:00", "2020-01-02": "2020-01-02 00:00:00", "May": None, "2020-13": None, "10:20:30 -08": None,
    }
    df = spark.createDataFrame([(k,) for k in want], "v string")
    assert {r["v"]: r["t"] for r in df.select("v", F.date_format(text.parse_datetime(F.col("v")), "yyyy-MM-dd HH:mm:ss").alias("t")).collect()} == want
    for name, data, encoding, value in (("a", "é€".encode(), "utf-8", "é€"), ("b", "é€".encode("cp1252"), "cp1252", "é€"), ("c", b"\xe9\x81x", "latin1", "é\x81x")):
        path = tmp_path / f"{name}.csv"
        path.write_bytes(b"h\n" + data + b"\n")
        assert readers.detect_encoding(spark, str(path)) == encoding and readers.read_csv_text(spark, str(path)).first()[0] == value
    assert spark.conf.get("spark.sql.legacy.javaCharsets", "false") == "false"
