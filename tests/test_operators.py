import pytest
from pyspark.sql import functions as F

from tidewright.operators import dedupe, design, missing, profile, rows, semantics, shape, verify


def lists(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_names(spark):
    df = spark.createDataFrame([(1, 2, 3)], ["Order ID", "order.id", " X (%) "])
    assert shape.normalize_columns(df)[0].columns == ["order_id", "order_id_1", "x"]
    assert shape.standardize_headers(df)[1] == {"Order ID": "order_id", "order.id": "order_id_1", " X (%) ": "x"}
    odd = spark.createDataFrame([(1, 2, 3, 4)], ["Price Per Unit", "1st", "ok", "ok "])
    out, renamed = shape.safe_columns(odd)
    assert out.columns == ["price_per_unit", "c_1st", "ok", "ok_2"] and len(renamed) == 3
    assert shape.drop_column(df, "order.id").columns == ["Order ID", " X (%) "]
    with pytest.raises(ValueError):
        shape.rename_column(odd, "1st", "ok")


def test_shapes(spark):
    nested = spark.createDataFrame([(1, ("s", ("c", None)), ["a", "b"]), (2, None, [])], "id int, address struct<street:string,geo:struct<city:string,zip:string>>, tags array<string>")
    flat = shape.flatten_object(nested, "address", "address_")
    assert flat.columns == ["id", "address_street", "address_geo.city", "address_geo.zip", "tags"]
    assert lists(shape.explode_array(nested.select("id", "tags"), "tags")) == [(1, "a"), (1, "b"), (2, None)]
    assert shape.serialize_json(nested).first()["tags"] == '["a","b"]'
    df = spark.createDataFrame([("a-b-c",), ("d",), (None,)], "v string")
    assert shape.split_column(df, "v", "-").columns == ["v", "v_1", "v_2", "v_3"]
    assert [r["v_extracted"] for r in shape.extract_pattern(df, "v", "[a-c]$").collect()] == ["c", None, None]
    assert shape.merge_columns(shape.create_column(df, "k", 1), ["v", "k"], "m", "/").first()["m"] == "a-b-c/1"
    keys = [r[0] for r in shape.generate_surrogate_key(df, "k", "hash").select("k").collect()]
    assert len(set(keys)) == 3 and len(keys[0]) == 64
    assert shape.drop_empty_columns(df.withColumn("e", F.lit(None).cast("int")))[1] == ["e"]
    assert shape.drop_empty_columns(df.limit(0))[1] == []


def test_missing(spark):
    df = spark.createDataFrame([(1, 1.0, "x"), (2, None, None), (3, 3.0, "x"), (4, None, "y")], "i int, a double, b string")
    assert missing.drop_missing_rows(df).count() == 2 and missing.drop_missing_rows(df, "b").count() == 3
    assert [r["a"] for r in missing.fill_statistic(df, "a", "mean").orderBy("i").collect()] == [1.0, 2.0, 3.0, 2.0]
    assert [r["b"] for r in missing.fill_statistic(df, "b", "mode").orderBy("i").collect()] == ["x", "x", "x", "y"]
    assert [r["a"] for r in missing.fill_directed(df, "a", "i").orderBy("i").collect()] == [1.0, 1.0, 3.0, 3.0]
    assert [r["a"] for r in missing.fill_directed(df, "a", "i", forward=False).orderBy("i").collect()] == [1.0, 3.0, 3.0, None]
    assert [r["a"] for r in missing.fill_constant(df, "a", "none").orderBy("i").collect()] == ["1.0", "none", "3.0", "none"]
    assert missing.condition_sql("a == 1 & b != 'x & y == z'") == "a = 1  AND  b <> 'x & y == z'"
    assert missing.conditional_null(df, "a > 2 or i == 1", "b").where("b is null").count() == 3
    assert [r["b"] for r in missing.replace_with_null(df, "b", ["x"]).orderBy("i").collect()] == [None, None, None, "y"]
    marked = spark.createDataFrame([("N/A", "N/A"), ("x", "n/a"), ("y", "Error"), ("z", "z")], "few string, many string")
    out, found = missing.conditional_sentinels(marked)
    assert found == {"few": (1, True), "many": (3, False)} and out.where("few is null").count() == 1
    nothing = missing.fill_modes(missing.fill_medians(df.where("false")))
    assert nothing.count() == 0


def test_order(spark):
    df = spark.range(0, 1000).select(((F.col("id") * 7919) % 1000).alias("k"))
    got = {r["k"]: r["_row"] for r in rows.with_row(df, ["k"]).collect()}
    assert got == {k: k + 1 for k in range(1000)}
    gaps = spark.range(0, 500).select("id", F.when(F.col("id") % 97 == 0, F.col("id")).alias("v"))
    assert all(r["v"] == r["id"] // 97 * 97 for r in rows.carry(gaps, "v", "id", blocks=13).collect())


def test_duplicates_and_keys(spark):
    df = spark.createDataFrame([(1, "a", 1), (1, "a", 2), (1, "b", 3), (None, "c", 4), (None, "d", 5), (2, "e", 6)], "emp_id int, v string, _row long")
    tagged = dedupe.with_outcome(df.withColumn("_raw", F.lit("{}")), "emp_id")
    assert {r["_row"]: r["_outcome"] for r in tagged.collect()} == {1: "loaded", 2: "duplicate", 3: "repeated_key", 4: "missing_key", 5: "missing_key", 6: "loaded"}
    n = dedupe.accounting(tagged).first()
    assert n["source_rows"] == n["loaded_rows"] + n["exact_duplicates_removed"] + n["quarantined_rows"] == 6
    assert [r["source_row"] for r in dedupe.quarantine(tagged, "emp_id").orderBy("source_row").collect()] == [3, 4, 5]
    assert lists(dedupe.first_per_key(df, ["emp_id"], ["_row"]).select("_row")) == [(1,), (4,), (6,)]
    latest = spark.createDataFrame([(1, "2020-01-01", "A"), (1, "2020-02-01", "B"), (1, None, "C"), (2, "2019-01-01", "D")], "id int, ts string, val string")
    assert lists(dedupe.keep_latest(latest, "id", "ts").select("val")) == [("C",), ("D",)]
    assert dedupe.detect_primary_key(df, 0.3) == "emp_id" and dedupe.strict_primary_key(df) is None
    assert dedupe.timestamp_column(df) is None


def test_profile(spark):
    df = spark.createDataFrame([(i, "n/a" if i == 3 else "", float(i if i < 9 else 9999), "x") for i in range(10)] + [(0, "", 0.0, "x")], "id long, name string, revenue double, category string")
    columns, table = profile.profile(df)
    got = {r["column_name"]: r for r in columns.collect()}
    assert table["duplicate_rows"] == 1 and 0 <= table["quality_score"] <= 100 and not table["is_sampled"]
    assert got["name"]["missing_count"] == 10 and got["name"]["suspected_sentinels"] == ["", "n/a"]
    assert got["revenue"]["outlier_count"] == 1 and not got["id"]["is_potential_pk"]
    assert profile.profile(df, sample_limit=5)[1]["is_sampled"]
    assert profile.detect_outliers(df, "revenue").where("revenue_is_outlier").count() == 1
    assert profile.clip_outliers(df, "revenue").agg(F.max("revenue")).first()[0] < 1000
    assert missing.remove_outliers(df, "revenue").count() == 10
    empty = profile.profile(df.limit(0))[1]
    assert empty["quality_score"] == 0.0 and empty["row_count"] == 0
    kinds = {r["column_name"]: r["structural_type"] for r in profile.structure(spark.createDataFrame([(1, ("a",), [1])], "i int, o struct<k:string>, l array<int>")).collect()}
    assert kinds == {"i": "flat", "o": "nested_object", "l": "nested_array"}


def test_auto_clean(spark):
    raw = [(str(i), f"${i},000", "North" if i % 2 else " north", f"2020-01-{i:02d}" if i % 2 else f"1/{i}/2020", "Yes" if i % 3 else "no") for i in range(1, 21)]
    raw += [raw[0], ("2", "$9", "North", "2020-01-01", "no"), ("", "$1", "North", "n/a", "?")]
    df = spark.createDataFrame([(n, *r, None) for n, r in enumerate(raw)], " n long, `Emp ID` string, ` Annual Salary ` string, Region string, `Join Date` string, Remote string, Unnamed string")
    out = semantics.auto_clean(df, row="n")
    n = out.accounting.first()
    assert (n["source_rows"], n["loaded_rows"], n["exact_duplicates_removed"], n["quarantined_rows"]) == (23, 20, 1, 2)
    assert out.primary_key == "emp_id" and out.semantics == {"emp_id": "pk", "annual_salary": "money", "region": "category", "join_date": "date", "remote": "bool"}
    assert {r["region"] for r in out.df.collect()} == {"North"} and dict(out.df.dtypes)["emp_id"] == "bigint"
    assert "unnamed" not in out.df.columns and out.quarantine.count() == 2
    assert {r["action"] for r in out.log.collect()} >= {"standardize_column_name", "trim_whitespace", "sentinel_to_null", "drop_empty_column", "canonicalize_category", "remove_exact_duplicates"}


def test_categories(spark):
    counts = {"Engineering": 9, "engineering": 2, "Enginering": 1, "HR": 3, "Human Resources": 12, "sales": 4, "--": 2}
    df = spark.createDataFrame([(v, "東京" if i % 2 else "大阪", str(i)) for i, v in enumerate(v for v, n in counts.items() for _ in range(n))] + [(None, None, "x")], "a string, b string, c string")
    out, log = semantics.canonicalize(df, ["a", "b", "c"])
    rows = out.collect()
    got = dict(zip((r["a"] for r in df.collect()), (r["a"] for r in rows)))
    assert got["engineering"] == got["Enginering"] == "Engineering" and got["HR"] == "Human Resources" and got["sales"] == "Sales" and got["--"] == "--" and got[None] is None
    assert [(r["b"], r["c"]) for r in rows] == [(r["b"], r["c"]) for r in df.collect()]
    assert log == {"a": (4, 10)}
    assert semantics.canonicalize(df.limit(0), ["a"])[1] == {}


def test_older_cleaners(spark):
    df = spark.createDataFrame([(" a ", "1,000", "2020-01-01"), (None, "2", "2020-01-02"), ("a", None, None), ("UNKNOWN", "2", "2020-01-02")], "`My Name` string, Amount string, Day string")
    out, log = semantics.impute_clean(df)
    assert out.columns == ["my_name", "amount", "day"] and out.where("my_name is null or amount is null").count() == 0
    assert out.count() == 3 and {r["action"] for r in log.collect()} >= {"cast_to_float64", "cast_to_datetime", "fill_null_mode", "remove_duplicates"}
    assert semantics.legacy_transform(df, {"amount": "revenue"}).columns == ["my name", "revenue", "day"]


def test_typed_semantics(spark):
    df = spark.createDataFrame([("t1", 2, 3.5, -1.0), ("t2", 1, 2.0, 4.0)], "transaction_id string, quantity int, price_per_unit double, total_spent double")
    assert semantics.infer_typed(df) == ({"transaction_id": "pk", "quantity": "quantity", "price_per_unit": "money", "total_spent": "float"}, "transaction_id")


def test_design_and_gate(spark):
    df = spark.createDataFrame([(1, "lamp", "home", 5.0), (2, "pen", "office", 1.0), (3, "lamp", "home", None), (4, None, "home", 2.0)], "id int, product string, category string, price double")
    kinds = {"id": "pk", "product": "category", "category": "category", "price": "money"}
    assert design.functional_dependents(df, "product", kinds) == ["category"]
    a, lookup, b, main = design.design_normalized(df.where("product is not null"), "orders", kinds, "id", "product", "products")
    assert lists(lookup) == [(1, "lamp", "home"), (2, "pen", "office")] and main.columns == ["id", "product_id", "price"]
    assert design.is_lossless(df.where("product is not null"), lookup, main, "product")
    assert a.uniques == ["product"] and {c.name: c.sql_type for c in b.columns} == {"id": "INT", "product_id": "INT", "price": "DECIMAL(12,2)"}
    assert verify.violations(main, b, {"products": lookup}).count() == 0
    bad = main.withColumn("price", F.lit(-1.0)).withColumn("product_id", F.lit(9)).withColumn("id", F.lit(1))
    assert {r["constraint_name"] for r in verify.violations(bad, b, {"products": lookup}).collect()} == {"check", "foreign_key", "unique"}
    assert all(r["rejected"] for r in verify.probe(main, b, {"products": lookup}).collect())
    assert design.text_type(10) == "VARCHAR(16)" and design.text_type(1001) == "TEXT" and design.text_type(None) == "VARCHAR(16)"


def test_checksum_ignores_order(spark):
    df = spark.createDataFrame([(1, "a", 1.5), (2, None, None)], "i int, s string, d double")
    assert verify.checksum(df).first() == verify.checksum(df.orderBy(F.desc("i"))).first()
    assert verify.checksum(df).first() != verify.checksum(df.withColumn("s", F.lit("a"))).first()
    sums = {verify.checksum(spark.createDataFrame([r], "a string, b string")).first()["checksum"] for r in [("a|b", "c"), ("a", "b|c"), ("\\N", "c"), (None, "c"), ("a\\|b", "c"), ("a\\", "b|c")]}
    assert len(sums) == 6
    huge = spark.createDataFrame([(1e300, float("nan")), (0.1 + 0.2, None)], "a double, b double")
    assert verify.checksum(huge).first()["n_rows"] == 2
