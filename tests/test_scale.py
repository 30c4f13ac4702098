"""Operators that must not gather a column, a group or a key in one task: against plain versions, with their bounds made small."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewright.operators import dedupe, dependencies, profile, quantiles, semantics
from tidewright.operators.rows import carry


@pytest.mark.parametrize("gather", [5, 100_000])
def test_quantiles_by_rank_selection(spark, monkeypatch, gather):
    monkeypatch.setattr(quantiles, "GATHER", gather)
    monkeypatch.setattr(quantiles, "ACCURACY", 50)
    rng = random.Random(3)
    columns = {
        "spread": [rng.gauss(0, 1e6) for _ in range(2000)],
        "ties": [rng.choice([1.0, 2.0, 2.0, 7.0]) for _ in range(2000)],
        "one": [3.5] * 2000,
        "mostly": [0.0] * 1999 + [1e300],
        "holes": [None if rng.random() < 0.7 else float(rng.randrange(40)) for _ in range(2000)],
        "none": [None] * 2000,
        "odd": [rng.choice([float("nan"), float("-inf"), 1.0, -1e-300]) for _ in range(2000)],
    }
    df = spark.createDataFrame(list(zip(*columns.values())), ", ".join(f"{c} double" for c in columns)).repartition(7)
    at = (0.0, 0.1, 0.25, 0.5, 0.9, 1.0)
    got = quantiles.quantiles(df, list(columns), at)
    want = df.agg(*[F.percentile(c, F.array(*map(F.lit, at))) for c in columns]).first()
    for c, w in zip(columns, want):
        assert str(got[c]) == str(tuple(w) if w is not None else (None,) * len(at)), c
    assert quantiles.quantiles(df.limit(0), ["ties"], (0.5,)) == {"ties": (None,)} and quantiles.quantiles(df, []) == {}
    assert "percentile(" not in df._jdf.queryExecution().toString()


def plain_outcomes(rows, pk):
    """Outcome by row number of rows (number, key, other)."""
    seen, keys, out = set(), set(), {}
    for n, k, x in sorted(rows):
        if (k, x) in seen:
            out[n] = dedupe.DUPLICATE
            continue
        seen.add((k, x))
        out[n] = dedupe.LOADED if not pk else dedupe.MISSING_KEY if k is None else dedupe.REPEATED_KEY if k in keys else dedupe.LOADED
        keys.add(k)
    return out


@pytest.mark.parametrize("few", [0, 500_000])
def test_outcomes_without_windows(spark, monkeypatch, few):
    monkeypatch.setattr(dedupe, "BROADCAST_ROWS", few)
    rng = random.Random(4)
    numbers = rng.sample(range(10_000), 900)
    rows = [(n, "hot" if rng.random() < 0.5 else rng.choice([None, "a", "b", ""]), rng.choice([None, "", "x", "y", str(rng.randrange(99))])) for n in numbers]
    df = spark.createDataFrame(rows, "_row long, k string, v string").repartition(5)
    for pk in ("k", None):
        tagged = dedupe.with_outcome(df, pk)
        assert {r["_row"]: r["_outcome"] for r in tagged.collect()} == plain_outcomes(rows, pk)
        assert tagged.columns == ["_row", "k", "v", "_outcome"]
        assert "Window" not in tagged._jdf.queryExecution().toString()
    assert dedupe.with_outcome(df.limit(0), "k").count() == 0


def test_category_keys_are_counted_up_to_the_bound(spark, monkeypatch):
    rows = [("few", f"{x} !", 3) for x in "abcde"] + [("few", "A", 1)] + [("many", f"v{i}", 1) for i in range(3000)] + [("edge", f"e{i}", 2) for i in range(25)] + [("over", f"e{i}", 2) for i in range(26)] + [("none", "--", 1)]
    values = spark.createDataFrame(rows, "column_name string, value string, n long")
    for classes in (1024, 16):
        monkeypatch.setattr(semantics, "KEY_CLASSES", classes)
        got = semantics._few_keys(values, ["few", "many", "edge", "over", "none", "absent"])
        assert (got["few"], got["edge"], got["none"], got["absent"]) == (5, 25, 0, 0) and got["many"] > 25 and got["over"] > 25


def test_cleaning_an_empty_table(spark):
    out = semantics.auto_clean(spark.createDataFrame([], "order_id string, price string"))
    assert out.df.count() == 0 and out.primary_key is None and out.accounting.first()["source_rows"] == 0
    blank = semantics.auto_clean(spark.createDataFrame([("1", " "), ("2", None)], "order_id string, price string"))
    assert blank.df.columns == ["_row", "order_id"] and {r["action"] for r in blank.log.collect()} >= {"drop_empty_column", "detect_primary_key"}


def plain_carry(rows, forward):
    """Values by id of rows (id, group, order, value): orders are distinct within groups here."""
    out, held = {}, {}
    for i, g, o, v in sorted(rows, key=lambda r: (str(r[1]), r[2]), reverse=not forward):
        held[g] = v if v is not None else held.get(g)
        out[i] = held[g]
    return out


@pytest.mark.parametrize("forward", [True, False])
@pytest.mark.parametrize("grouped", [True, False])
def test_values_are_carried_along_any_order(spark, forward, grouped):
    rng = random.Random(9)
    orders = rng.sample(range(4000), 2000)
    rows = [(i, None if rng.random() < 0.1 else "hot" if rng.random() < 0.5 else rng.choice("abc"), f"2020-{o:05d}", None if rng.random() < 0.9 else i) for i, o in enumerate(orders)]
    df = spark.createDataFrame(rows, "id long, g string, o string, v long").repartition(3)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r["id"]: r["v"] for r in carry(df, "v", "o", forward, ["g"] if grouped else None).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == plain_carry([(i, g if grouped else 0, o, v) for i, g, o, v in rows], forward)
    assert carry(df.limit(0), "v", "o", forward).count() == 0 and carry(df, "v", "o", forward).columns == df.columns


@pytest.mark.parametrize("forward", [True, False])
def test_a_carry_takes_time_in_proportion(spark, forward):
    """A frame that ends at the partition's last row is made anew for each row, so time would grow with the square of a range."""
    df = spark.range(500).select("id", F.when(F.col("id") % 4 != 0, F.col("id")).alias("v"))
    out = carry(df, "v", "id", forward, blocks=1)
    assert "unboundedfollowing" not in out._jdf.queryExecution().toString().lower().replace(" ", "")
    want = [i if i % 4 else i + 1 if not forward else i - 1 if i else None for i in range(500)]
    assert [r["v"] for r in out.orderBy("id").collect()] == want


def test_inclusions_and_relationships(spark):
    a = spark.createDataFrame([(1, "x", 5.0), (2, "y", 5.0), (3, None, 5.0), (3, "x", 1.0)], "k long, s string, f double")
    b = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z"), (4, "w")], "id int, name string")
    got = {tuple(r)[:4]: tuple(r)[4:] for r in dependencies.inclusions({"a": a, "b": b}).collect()}
    assert got == {("a", "k", "b", "id"): (3, 0, True), ("b", "id", "a", "k"): (4, 1, False), ("a", "s", "b", "name"): (2, 0, True), ("b", "name", "a", "s"): (4, 2, False)}
    assert {tuple(r)[:4] for r in dependencies.relationships({"a": a, "b": b}).collect()} == {("a", "k", "b", "id"), ("a", "s", "b", "name")}
    assert dependencies.inclusions({"a": a.limit(0), "b": b.limit(0)}).where("included").count() == 0


def test_functional_dependencies_against_all_pairs(spark):
    rng = random.Random(2)
    rows = [(i // 2, rng.randrange(4), rng.choice([None, "p", "q"]), 7) for i in range(60)]
    rows = [(a, b, c, (b or 0) % 2, f"{b}{c}", d) for a, b, c, d in rows]
    names = ["a", "b", "c", "even", "both", "one"]
    df = spark.createDataFrame(rows, "a int, b int, c string, even int, both string, one int")
    size = lambda cols: len({tuple(r[names.index(c)] for c in cols) for r in rows})
    from itertools import combinations

    want, decided = set(), {c: [] for c in names}
    for k in (0, 1, 2):
        for x in combinations(names, k):
            for y in names:
                if y not in x and not any(set(s) <= set(x) for s in decided[y]) and size((*x, y)) == size(x):
                    want.add((",".join(x), y, size(x) == len(rows)))
                    decided[y].append(x)
    assert {tuple(r) for r in dependencies.functional_dependencies(df).collect()} == want
    assert ("b", "even", False) in want and ("b,c", "both", False) in want
    assert dependencies.functional_dependencies(df.limit(0)).count() == 0
    assert ("lookup_table", "b", "decides even") in {tuple(r) for r in dependencies.recommendation(df).collect()}


def test_hashes_of_a_task_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(dependencies, "CELLS", 500)
    counted, plain = [], dependencies.partition_sizes
    monkeypatch.setattr(dependencies, "partition_sizes", lambda df, sets, n: counted.extend(sets) or plain(df, sets, n))
    df = spark.range(0, 2000, 1, 1).select("id", (F.col("id") % 7).alias("a"), (F.col("id") % 7 % 3).cast("string").alias("b"), F.lit(None).cast("int").alias("c d"))
    assert {tuple(r) for r in dependencies.functional_dependencies(df).collect()} == {("", "c d", False), ("id", "a", True), ("id", "b", True), ("a", "b", False)}
    assert not any("id" in s and len(s) > 1 for s in counted)  # what holds a key isn't counted
    rows = [len(x) for x in dependencies._dealt(df, ["id", "c d"], 16).rdd.glom().collect()]
    assert sum(rows) == 2000 and len(rows) == 16 and max(rows) < 250
    assert plain(df, [("id",), ("a",), ("a", "b")], 2000) == {("id",): 2000, ("a",): 7, ("a", "b"): 7}


def test_sketches_count_within_their_bounds(spark):
    df = spark.range(0, 60_000, 1, 6).select((F.col("id") % 3).alias("day"), F.col("id").alias("all"), (F.col("id") % 7000).cast("string").alias("many"), (F.col("id") % 5).alias("few"), F.lit(None).cast("int").alias("none"))
    kept = profile.distinct_sketches(df, ["all", "many", "few", "none"], by=["day"])
    assert kept.count() == 12
    got = {r["column_name"]: r for r in profile.sketched_counts(kept).collect()}
    for c, n in {"all": 60_000, "many": 7000, "few": 5, "none": 0}.items():
        assert got[c]["least"] <= n <= got[c]["most"], c
    rough = {r["column_name"]: r for r in profile.unique_counts(df, exact=False).collect()}
    assert abs(rough["many"]["unique_count"] - 7000) < 7000 * 3 * profile.SKETCH_ERROR and "none" not in rough
    plan = profile.unique_counts(df, exact=False)._jdf.queryExecution().optimizedPlan().toString()
    assert "count(distinct" not in plan.lower() and "value" not in plan
    columns, facts = profile.profile(df.drop("day").union(df.drop("day").limit(10)), exact=False)
    assert facts["row_count"] == 60_010 and facts["duplicate_rows"] < 1500 and columns.count() == 4
    values = lambda exact: {r["column_name"]: r["values"] for r in profile.sample_values(df, 4, exact).collect()}
    assert values(True) == values(False)


def test_structure_of_nested_json(spark):
    texts = ['{"a": {"b": [1, {"c": null}, []]}, "x y": true}', '{"a": {"b": 2.5}}', '{"a": "s"}', "[[1], [2, 3]]", "7", "no json", None, '{"a": {"b": {"d": "deep"}}}', "{}"]
    got = {r["path"]: (r["depth"], r["types"], r["n"]) for r in profile.json_paths(spark.createDataFrame([(t,) for t in texts], "t string"), "t").collect()}
    assert got == {
        "": (0, ["array", "int", "object"], 7), "a": (1, ["object", "string"], 4), "a.b": (2, ["array", "float", "object"], 3), "a.b[]": (3, ["array", "int", "object"], 3), "a.b[].c": (4, ["null"], 1),
        "a.b.d": (3, ["string"], 1), "x y": (1, ["bool"], 1), "[]": (1, ["array"], 2), "[][]": (2, ["int"], 3),
    }
    assert profile.json_paths(spark.createDataFrame([], "t string"), "t").count() == 0


@pytest.mark.parametrize("name", ["g3_accounting", "g6_whole_log"])
def test_rows_without_a_key_stay_apart_in_large_tables(spark, sf_dir, tmp_path, name):
    """Orders of a large table that are alike but for their keys: rows that lose the key are set aside, each of them."""
    import duckdb

    from tidewright.plans import catalog

    db = duckdb.connect()
    db.execute(f"CREATE TABLE orders AS SELECT * REPLACE (o_orderkey + 2100 * i AS o_orderkey) FROM '{sf_dir}/orders.parquet', range(3) r(i) WHERE o_orderkey < 700")
    db.execute(f"COPY orders TO '{tmp_path}/orders.parquet' (FORMAT parquet)")
    want = db.execute(catalog.ORACLE[name]).fetchall()
    assert sorted(tuple(r) for r in catalog.QUERIES[name](spark, str(tmp_path)).collect()) == sorted(want)
