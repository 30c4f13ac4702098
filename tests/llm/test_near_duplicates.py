import random

import numpy as np
import pytest

from tidewright.llm import grid_join, minhash
from tidewright.llm.common import Scratch
from tidewright.llm.components import components


def linked(n, pairs):
    root = list(range(n))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def plain_sets(texts, width):
    out = []
    for t in texts:
        w = (t or "").encode().lower().split()
        out.append({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    return out


def corpus(seed=1):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 80))) for _ in range(60)]
    shared = " ".join(rng.choice(vocabulary) for _ in range(60))
    texts += [shared + " " + " ".join(rng.choice(vocabulary) for _ in range(60)) for _ in range(40)]
    for base in range(0, 40, 3):
        for _ in range(8):
            w = texts[base].split()
            for _ in range(rng.randrange(1, 1 + max(1, len(w) // 12))):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            texts.append(" ".join(w))
    texts += [texts[5], texts[5].upper(), "", None, "  \t\n", "one", "ONE", "one two", "x " * 30_000, "x " * 30_000 + "y"]
    return texts


@pytest.mark.parametrize("width", [2, 5])
def test_all_links_and_only_links(spark, width):
    texts = corpus()
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in enumerate(texts)], "doc_id long, text string, rep string, sig int")
    got = {r["id"]: r for r in minhash.near_duplicates(df, rule=minhash.Rule(width, 80)).collect()}
    sets = plain_sets(texts, width)
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    want = linked(len(texts), pairs)
    assert len(pairs) > 15
    assert [got[i]["component_id"] for i in range(len(texts))] == want
    assert [got[i]["n_shingles"] for i in range(len(texts))] == [len(s) for s in sets]
    assert [got[i]["kept"] for i in range(len(texts))] == [i == c for i, c in enumerate(want)]


def test_a_large_group_of_near_copies(spark):
    rng = random.Random(2)
    base = [f"w{rng.randrange(1000)}" for _ in range(150)]
    texts = []
    for _ in range(250):
        w = list(base)
        for _ in range(rng.randrange(1, 9)):
            w[rng.randrange(150)] = f"z{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    got = {r["id"]: r["component_id"] for r in minhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), rule=minhash.Rule(2, 80)).collect()}
    sets = plain_sets(texts, 2)
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    assert [got[i] for i in range(len(texts))] == linked(len(texts), pairs)


def test_null_and_repeated_ids(spark):
    rows = [(None, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f"), (None, "q r s"), (9, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r["id"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(df).collect()]
    assert sorted(got, key=str) == sorted([(None, 4, False), (4, 4, True), (4, 4, True), (None, None, True), (9, 9, True)], key=str)
    assert minhash.near_duplicates(df.limit(0)).count() == 0
    kept = minhash.drop_near_duplicates(spark.createDataFrame([(1, "a b c d e f", 5), (2, "a b c d e f", 6), (3, "", 7)], "doc_id long, text string, id int"))
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3] and kept.columns == ["doc_id", "text", "id"]


def test_one_row_of_each_group_stays(spark):
    """Repeated ids, rows without an id and repeated rows: one row of a group stays, whatever its id says elsewhere."""
    rows = [
        (1, "a b c d e f", "x"), (2, "a b c d e f", "x"), (2, "g h i j k l", "y"), (3, "g h i j k l", "y"), (5, "m n o p q r", "z"), (5, "m n o p q r", "z"), (None, "m n o p q r", "z"),
        (None, "s t u v w x", "n"), (None, "s t u v w x", "n"), (7, "", "e"), (7, "", "e"), (8, None, "e"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, th string")
    kept = minhash.drop_near_duplicates(df)
    assert kept.columns == df.columns
    assert sorted(map(tuple, kept.collect()), key=str) == sorted([rows[0], rows[2], rows[4], rows[7], rows[9], rows[10], rows[11]], key=str)


def test_two_thousand_near_copies_below_the_threshold_of_each_other(spark):
    """Pairs at 0.6 to 0.8 collide often and link seldom: all links are found and little is written out."""
    rng = random.Random(21)
    base, texts = [f"w{rng.randrange(5000)}" for _ in range(120)], []
    for _ in range(2000):
        w = list(base)
        for _ in range(rng.randrange(2, 10)):
            w[rng.randrange(120)] = f"z{rng.randrange(10**7)}"
        texts.append(" ".join(w))
    sets = plain_sets(texts, 2)
    number = {g: i for i, g in enumerate({g for s in sets for g in s})}
    has = np.zeros((len(sets), len(number)), np.float32)
    for i, s in enumerate(sets):
        has[i, [number[g] for g in s]] = 1
    both, n = has @ has.T, np.array([len(s) for s in sets])
    linked_pairs = np.argwhere(np.tril(100 * both >= 80 * (n[:, None] + n[None, :] - both), -1))
    want = linked(len(sets), linked_pairs.tolist())
    assert len(set(want)) > 50 and len(linked_pairs) > 500
    got = {r["id"]: r["component_id"] for r in minhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), rule=minhash.Rule(2, 80)).collect()}
    assert [got[i] for i in range(len(texts))] == want


def test_components(spark):
    edges = [(5, 4), (4, 3), (9, 8), (7, 7), (3, 5), (10, 9), (None, 1)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t")).collect()}
    assert got == {5: 3, 4: 3, 3: 3, 9: 8, 8: 8, 10: 8}
    chain = spark.range(200).selectExpr("id AS a", "id + 1 AS b")
    assert {r["component"] for r in components(chain, Scratch(spark, "t")).collect()} == {0}
    assert components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "t")).count() == 0
    star = spark.range(1, 3000).selectExpr("id * 2 AS a", "1 AS b").union(spark.range(1, 10).selectExpr("id * 2 AS a", "id * 2 + 1 AS b"))
    assert {r["component"] for r in components(star, Scratch(spark, "t")).collect()} == {1}


def test_components_end_with_stars(spark):
    """Edges that are stars around their smallest nodes take no round, a pair of stars two."""
    saved = []

    class Counting(Scratch):
        def save(self, df, name):
            saved.append(name)
            return super().save(df, name)

    stars = spark.range(10, 600).selectExpr("id AS a", "id % 7 AS b")
    got = {r["node"]: r["component"] for r in components(stars, Counting(spark, "t")).collect()}
    assert got == {i: i % 7 if i >= 10 else i for i in [*range(7), *range(10, 600)]} and saved.count("edges") == 1
    saved.clear()
    joined = stars.union(spark.createDataFrame([(599, 1)], "a long, b long"))  # 599 % 7 == 4
    got = {r["node"]: r["component"] for r in components(joined, Counting(spark, "t")).collect()}
    assert got[4] == got[599] == 1 and got[11] == 1 and got[10] == 3 and saved.count("edges") == 5


def test_vectors_against_all_pairs(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(120, 16))
    near = base[:60] + rng.normal(size=(60, 16)) * rng.uniform(0.01, 0.35, size=(60, 1))
    far = near[:30] * 1e200
    x = np.concatenate([base, near, far, base[:5], base[:5]]).tolist()
    labels = [i % 3 for i in range(120)] + [i % 3 for i in range(60)] + [i % 3 for i in range(30)] + [i % 3 for i in range(5)] + [2 - i % 3 for i in range(5)]
    rows = [(i, v, l) for i, (v, l) in enumerate(zip(x, labels, strict=True))]
    n = len(rows)
    odd = [None, [], [0.0] * 16, [float("nan")] * 16, [None] + [1.0] * 15, [float("inf")] + [1.0] * 15, [1.0, 2.0]]
    rows += [(n + i, v, 0) for i, v in enumerate(odd)] + [(n + len(odd), x[0], None)]
    df = spark.createDataFrame([(i, v, l, "clash") for i, v, l in rows], "vec_id long, embedding array<double>, label int, block string")
    got = {r["vec_id"]: r for r in grid_join.near_vectors(df).collect()}
    pairs = []
    for i in range(n):
        for j in range(i):
            a, b = np.array(x[i]), np.array(x[j])
            a, b = a / np.abs(a).max(), b / np.abs(b).max()
            if labels[i] == labels[j] and a @ b / (np.sqrt(a @ a) * np.sqrt(b @ b)) >= 0.98:
                pairs.append((i, j))
    assert len(got) == len(rows) and len(pairs) > 60
    degree = [sum(i in p for p in pairs) for i in range(n)]
    want = linked(n, pairs)
    assert [got[i]["n_links"] for i in range(n)] == degree
    assert [got[i]["component_id"] for i in range(n)] == want
    for i in range(n, len(rows)):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True)
    assert grid_join.near_vectors(df.limit(0)).count() == 0
