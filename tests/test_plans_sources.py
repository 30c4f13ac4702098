import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from tidewright.operators import design, profile, verify
from tidewright.plans import defects, report, steps, suggest
from tidewright.sources import readers, records, writers
from tidewright.streaming import apply


def test_bad_steps_are_log_rows(spark):
    df = spark.createDataFrame([(1, "a")], "id int, v string")
    out = steps.apply_steps(df, ["x", {}, {"action": "nope"}, {"action": "drop_column", "column": "gone"}, {"action": "rename_column", "column": "v"}, {"action": "trim_whitespace", "column": "V"}])
    assert [x["status"] for x in out.log] == ["error", "error", "error", "skipped", "error", "success"]
    assert out.df.collect() == df.collect() and out.losses.count() == 0
    assert steps.check("x") and steps.check([{"action": "drop_column"}]) == [] and len(steps.check([1, {}, {"action": "q"}])) == 3
    with pytest.raises(ValueError):
        steps.apply_steps(df, {"steps": []})
    assert len(steps.ACTIONS) == 47


def test_order_renames_and_losses(spark):
    df = spark.createDataFrame([(1, "$5"), (2, None), (3, "x")], "`Row No` int, `Unit Price` string")
    plan = [
        {"action": "cast_type", "column": "Unit Price", "target_type": "int64"}, {"action": "fill_missing", "column": "Unit Price", "value": 0.0},
        {"action": "parse_currency", "column": "Unit Price"}, {"action": "normalize_columns"}, {"action": "rename_column", "column": "Unit Price", "new_name": "cost"}, {"action": "detect_outliers", "column": "unit_price"},
    ]
    out = steps.apply_steps(df, plan, order_by="Row No")
    assert [x["action"] for x in out.log] == ["plan_reorder", "parse_currency", "fill_missing", "cast_type", "normalize_columns", "rename_column", "detect_outliers"]
    assert all(x["status"] in ("success", "info") for x in out.log), out.log
    assert [(r["row_no"], r["cost"]) for r in out.df.orderBy("row_no").collect()] == [(1, 5), (2, 0), (3, 0)]
    assert [(r["action"], r["rows_affected"], r["sample_rows"]) for r in out.losses.collect()] == [("parse_currency", 1, ["3"])]


def test_suggestions(spark):
    df = spark.createDataFrame([(1, "n/a", "10", ("s",)), (2, None, "12", ("t",))], "`First Id` int, name string, revenue string, address struct<street:string>")
    made, _ = suggest.suggest_steps(*profile.profile(df))
    assert made[0] == {"action": "normalize_columns"} and {"action": "flatten_object", "column": "address", "prefix": "address_"} in made
    assert {"action": "cast_type", "column": "revenue", "target_type": "float64"} in made and not any(s["action"] == "fill_missing" for s in made)
    asked, _ = suggest.suggest_steps(*profile.profile(df), request="please fill gaps")
    assert {"action": "fill_missing", "column": "name", "value": "UNKNOWN"} in asked
    assert all(x["status"] == "success" for x in steps.apply_steps(df, made).log)


def test_reports(spark):
    df = spark.createDataFrame([(1, " a", None, "q"), (2, "b", "z", "q"), (3, "c ", None, "q")], "id int, Item string, gap string, `Unnamed: 8` string")
    plan = [{"action": "trim_whitespace", "column": "Item"}, {"action": "rename_column", "column": "Item", "new_name": "item"}, {"action": "drop_column", "column": "Unnamed: 8"}]
    shown = [(r["step_index"], r["before"], r["after"]) for r in report.preview(df, plan, "id").orderBy("step_index", "before").collect()]
    assert (0, " a", "a") in shown and (1, "Item", "item") in shown and (2, "Unnamed: 8", "(dropped)") in shown
    got = report.impact(df, steps.apply_steps(df, plan).df, plan, "id")
    assert (got["columns_dropped"], got["columns_renamed"], got["missing_filled"], got["fields_normalized"]) == (1, 1, 0, 2)
    assert report.risk([{"action": "fill_missing"}, {"action": "a", "confidence": 75}, {"action": "b"}]) == {"overall_confidence": 92, "low_risk": ["b"], "medium_risk": ["a"], "high_risk": ["fill_missing"]}


def test_defects_repeat(spark):
    src = spark.range(300).selectExpr("id AS k", "cast(id AS string) AS price")
    (one, m1), (two, m2) = (defects.inject_defects(src, "k", {"price": ["currency", "placeholder"]}) for _ in range(2))
    assert sorted(map(str, one.collect())) == sorted(map(str, two.collect())) and sorted(map(str, m1.collect())) == sorted(map(str, m2.collect()))
    assert {r["kind"] for r in m1.collect()} >= {"currency", "placeholder", "duplicate"}


def test_files(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_bytes("﻿Name,Value\n\"a, \"\"b\"\"\",\nc\nd,é\n".encode())
    rows = readers.read_csv_text(spark, str(path))
    assert rows.columns == ["Name", "Value"] and rows.first()["Name"] == 'a, "b"'
    (tmp_path / "w.csv").write_bytes("n,v\nx,caf\xe9 \x80\n".encode("latin1"))
    assert readers.detect_encoding(spark, str(tmp_path / "w.csv")) == "cp1252"
    assert readers.read_csv_text(spark, str(tmp_path / "w.csv")).first()["v"].strip() == "café €"
    writers.write_documents(spark.createDataFrame([(1, float("nan"))], "_id int, v double"), str(tmp_path / "docs"))
    assert readers.read_documents(spark, str(tmp_path / "docs"), "_id int, v double").first()["v"] is None
    kinds = readers.infer_document_schema(spark.createDataFrame([('{"a":1,"b":[1]}',), ('{"a":"x","b":null}',)], "value string"))
    assert {r["field"]: r["types"] for r in kinds.collect()} == {"a": ["int", "string"], "b": ["array", "null"]}


def test_jdbc(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path / 'db'};create=true"
    writers.write_table(spark.range(20).selectExpr("cast(id AS int) AS ID", "cast(id AS double) AS V"), "NUMBERS", url, driver="org.apache.derby.iapi.jdbc.AutoloadedDriver")
    back = readers.read_jdbc_table(spark, url, "NUMBERS", "ID", partitions=4, driver="org.apache.derby.iapi.jdbc.AutoloadedDriver")
    assert back.count() == 20 and back.rdd.getNumPartitions() == 4


def test_a_failed_load_leaves_the_old_tables(spark, tmp_path):
    store = writers.Store(spark, str(tmp_path / "store"))
    cols = [design.ColumnDef("id", "INT", False, "pk"), design.ColumnDef("price", "DECIMAL(12,2)", True, "money", "money")]
    table = design.TableDef("t", cols, "id")
    good = spark.createDataFrame([(1, 1.005), (2, float("nan"))], "id int, price double")
    assert store.publish([(table, good)]) == {"t": 2}
    with pytest.raises(writers.LoadError, match="check of price"):
        store.publish([(table, spark.createDataFrame([(1, 5.0), (3, -2.0)], "id int, price double"))])
    with pytest.raises(writers.LoadError, match="unique of id"):
        store.publish([(table, spark.createDataFrame([(1, 5.0), (1, 2.0)], "id int, price double"))])
    assert sorted(r["id"] for r in store.read("t").collect()) == [1, 2]
    assert len([d for d in os.listdir(tmp_path / "store") if d.startswith("v-")]) == 1
    store.publish([(table, good.where("id = 1"))])
    assert store.read("t").count() == 1
    store.rollback("t")
    assert store.current() == {}


def test_a_changed_load_is_noticed(spark):
    cols = [design.ColumnDef("id", "INT", False, "pk"), design.ColumnDef("price", "DECIMAL(12,2)", True, "money", "money")]
    table = design.TableDef("t", cols, "id")
    sent = writers.prepare_for_sink(spark.createDataFrame([(1, 1.0), (2, None)], "id int, price double"), table)
    counts = {"source_rows": 3, "exact_duplicates_removed": 1, "quarantined_rows": 0}
    assert verify.reconcile(sent, sent, table, counts, 3).where("not passed").count() == 0
    changed = sent.withColumn("price", F.coalesce("price", F.lit(1).cast("decimal(12,2)")))
    bad = {r["check_name"] for r in verify.reconcile(sent, changed, table, counts, 3).where("not passed").collect()}
    assert bad == {"sum of price", "nulls in price", "checksum"}


def test_history(spark, tmp_path):
    history = records.History(spark, str(tmp_path / "runs"))
    log = spark.createDataFrame([(1, "a", "trim", "x", 2)], "step_no int, column_name string, action string, detail string, rows_affected long")
    aside = spark.createDataFrame([(5, "missing", "{}")], "source_row long, reason string, raw string")
    n = {"source_rows": 3, "loaded_rows": 2, "exact_duplicates_removed": 0, "quarantined_rows": 1}
    assert [history.record(log, aside, n, mode="auto") for _ in range(2)] == [1, 2]
    assert [r["run_id"] for r in history.runs(1).collect()] == [2] and history.steps(1).count() == history.quarantine(2).count() == 1
    with pytest.raises(ValueError):
        history.record(log, aside, n | {"loaded_rows": 9})


def test_streams(spark, tmp_path):
    spark.createDataFrame([(1, " $5 "), (2, "x")], "id int, price string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id int, price string").parquet(str(tmp_path / "in"))
    out = apply.apply_to_stream(stream, [{"action": "trim_whitespace", "column": "price"}, {"action": "parse_currency", "column": "price"}])
    q = out.writeStream.format("memory").queryName("cleaned").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r["id"], r["price"]) for r in spark.table("cleaned").collect()) == [(1, 5.0), (2, None)]
    with pytest.raises(ValueError):
        apply.apply_to_stream(stream, [{"action": "fill_missing", "column": "price", "strategy": "mode"}])


def test_entry_without_the_optional_parts(tmp_path):
    """The entry module works where the llm folders and the pipeline are gone."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    os.makedirs(tmp_path / "tidewright")
    os.symlink(f"{root}/__spark_entry__.py", tmp_path / "__spark_entry__.py")
    for name in os.listdir(f"{root}/tidewright"):
        if name not in ("llm", "__pycache__"):
            os.symlink(f"{root}/tidewright/{name}", tmp_path / "tidewright" / name)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 100 and not any(n.startswith('op') for n in q) and set(e.oracle_sql()) <= set(q)"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, env=env | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr


def test_a_registered_union_reads_all_rows(spark, sf_dir):
    from tidewright.plans import catalog

    got = {r["part"]: r["count"] for r in catalog.QUERIES["u2_union_whole"](spark, sf_dir).groupBy("part").count().collect()}
    assert got == {"o": spark.read.parquet(f"{sf_dir}/orders.parquet").count(), "c": spark.read.parquet(f"{sf_dir}/customer.parquet").count()}
