import hashlib
import math
import random
import re
import string

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewright.llm import quality, repair, whitening
from tidewright.llm.common import table

NEXT = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
WANT = {"": "u", "s": "u", "u": "a", "a": "u"}


def plain_edits(rows):
    """(cost, audit) of rows (initial, gone, cut): the least from the last row back, at every state; three inserts at once are more than any path needs."""
    best = {"": (0, ""), "a": (0, ""), "u": (3, "I"), "s": (6, "II")}
    for initial, gone, cut in reversed(rows):
        now = {}
        for q in NEXT:
            found = [(4 + best[q][0], "D" + best[q][1])]
            if not gone:
                if initial in NEXT[q]:
                    found.append((3 * cut + best[initial][0], "K" + best[initial][1]))
                found.append((3 + 3 * cut + best[WANT[q]][0], "R" + best[WANT[q]][1]))
            now[q] = min(found)
        for _ in range(3):
            now = {q: min(v, (3 + now[WANT[q]][0], "I" + now[WANT[q]][1])) for q, v in now.items()}
        best = now
    return best[""]


def plain_repair(rows):
    """The counts, edits and hash of one conversation's rows (turn, role, text)."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "", hashlib.md5((r[2] or "").encode()).hexdigest()))
    rows = [(t, r or "", x or "") for t, r, x in rows]
    seen, marks = set(), []
    for _, r, x in rows:
        e = x.strip(" \t\n\x0b\x0c\r")
        marks.append(1 if not e else 2 if (r, x) in seen else 3 if e[-1] not in ".!?" else 0)
        seen.add((r, x))
    turns = {t for t, _, _ in rows if t is not None}
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    cost, audit = plain_edits([(r[:1], m in (1, 2), m == 3) for (_, r, _), m in zip(rows, marks)])
    out, i, q = [], 0, ""
    for what in audit:
        if what == "D":
            i += 1
            continue
        q = rows[i][1][:1] if what == "K" else WANT[q]
        name = rows[i][1] if what == "K" else {"u": "user", "a": "assistant"}[q]
        out.append(name + ":" + ("" if what == "I" else rows[i][2]))
        i += what != "I"
    assert re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in out)) and i == len(rows)
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, marks.count(1), marks.count(2), marks.count(3), illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


def test_repairs_are_the_cheapest_and_least(spark):
    rng = random.Random(12)
    texts = ["Yes.", "no", "", " \t", "Why?", "so. ", "x. ", "é!", None, "well"]
    roles = ["user", "assistant", "system", "tool", "", None, "ugly", "user", "assistant"]
    rows = []
    for c in range(300):
        kind = rng.choice((roles, roles[:3], roles[:2]))
        for t in range(rng.randrange(1, 12)):
            text = rng.choice(texts) if rng.random() < 0.6 else f"text {rng.randrange(9)}{rng.choice(['.', ''])}"
            rows.append((c if c else None, rng.choice((t, t, t, None, t // 2, 3 * t)), rng.choice(kind), text))
    rows += [(1000, t, rng.choice(roles[:2]), f"{t}{rng.choice('.!x')}") for t in range(700)]
    rows += [(1001, t, "user", "same.") for t in range(200)] + [(1002, t, "assistant", "x" * 100_000 + ".") for t in range(2)]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "conv_id long, turn int, role string, text string, audit string, key int").repartition(3)
    got = {r["conv_id"]: tuple(r)[1:] for r in repair.repair(df).collect()}
    by = {}
    for c, *r in rows:
        by.setdefault(c, []).append(tuple(r))
    assert {c: plain_repair(r) for c, r in by.items()} == got
    assert repair.repair(df.limit(0)).count() == 0


@pytest.mark.parametrize("n", [0, 1, 31, 32, 33, 64, 5000])
def test_search_of_long_conversations(n):
    rng = random.Random(n)
    for _ in range(3 if n > 100 else 60):
        rows = [(rng.choice("suua a"), rng.random() < 0.1, rng.random() < 0.2) for _ in range(n)]
        codes = bytes(repair._KIND.get(c, 0) | (repair.GONE if gone else repair.SHORT if cut else 0) for c, gone, cut in rows)
        assert repair.Search(codes).run() == plain_edits([(c, gone, cut and not gone) for c, gone, cut in rows])


def test_damage(spark):
    rows = [(c, t, r, "One. Two! Three") for c in range(40) for t, r in ((0, "user"), (1, "assistant"), (None, None))]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    import zlib

    want = []
    for c, t, r, x in rows:
        fate, r = zlib.crc32(f"{c}:{' ' if t is None else t}".encode()) % 20, " " if r is None else r
        one = (c, t, "user" if fate == 4 else r, "" if fate == 1 else "One Two Three" if fate == 2 else x)
        want += [one] * (0 if fate == 0 else 2 if fate == 3 else 1)
    got = [tuple(r) for r in repair.with_damage(df).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want)) and len({len(want), len(rows)}) == 2


def plain_whitening(vectors, k):
    x = np.floor(1024 * np.array(vectors, float)) + 100_000
    n, d = x.shape
    v = (x - x.sum(0) / n).T @ (x - x.sum(0) / n) / n
    e, q = np.linalg.eigh(v)
    e, q = e[::-1][:k], q[:, ::-1][:, :k]
    return x.astype(object), e, (x - x.mean(0)) @ q / np.sqrt(e), v


def test_whitening(spark):
    rng = np.random.default_rng(13)
    base = rng.standard_normal((400, 12)) @ np.diag([3, 3, 2, 1, 1, 1, 1, 0.5, 0.3, 0.1, 0.1, 0.05]) * 0.1
    rows = [(i, [float(c) for c in v], 1) for i, v in enumerate(base)]
    odd = [(-1, None, 1), (-2, [], 1), (-3, [1.0] * 3, 1), (-4, [float("nan")] + [0.0] * 11, 1), (-5, [float("inf")] + [0.0] * 11, 1), (-6, [None] + [0.0] * 11, 1), (-7, [1e300] + [0.0] * 11, 1)]
    df = spark.createDataFrame(rows + rows[:1] + odd, "vec_id long, embedding array<double>, n int").repartition(5)
    got = whitening.whiten(df).collect()
    x, e, w, v = plain_whitening([r[1] for r in rows + rows[:1]], 8)
    n, sums = len(x), x.sum(0)
    assert len(got) == 8 * n and {r["n"] for r in got} == {n}
    sign = {}
    for r in got:
        i, k = r["vec_id"], r["component"] - 1
        s = sign.setdefault(k, np.sign(r["whitened"] * w[i, k])) if abs(w[i, k]) > 0.1 else sign.get(k, 0)
        assert not s or abs(s * r["whitened"] - w[i, k]) < 1e-9
        assert r["deviation"] == sum(int(n * a - b) ** 2 for a, b in zip(x[i], sums))
        assert abs(r["explained"] / (e[k] / np.trace(v)) - 1) < 1e-10 and r["identity_error"] < 1e-9
    assert len(sign) == 8
    assert whitening.whiten(df.limit(0)).count() == 0 and whitening.whiten(df.where("vec_id < 0 and vec_id <> -3")).count() == 0
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(5)], "vec_id int, embedding array<float>")
    assert whitening.whiten(same).count() == 0 and whitening.whiten(same).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    line = spark.createDataFrame([("a", [0.0, 1.0]), ("b", [1.0, 1.0]), (None, [5.0, 1.0])], "vec_id string, embedding array<float>")
    assert sorted((str(r["vec_id"]), r["component"], r["explained"]) for r in whitening.whiten(line).collect()) == [("None", 1, 1.0), ("a", 1, 1.0), ("b", 1, 1.0)]


def test_slices():
    rng = np.random.default_rng(5)
    for n, values in [(1, [4.0]), (2, [1.0, 1.0]), (6, [5, 5, 5, 2, 1, 0]), (30, np.exp(-np.arange(30.0))), (40, 1 + 1e-9 * np.arange(40)), (50, rng.random(50))]:
        values = np.array(sorted(values, reverse=True), float)
        q = np.linalg.qr(rng.standard_normal((n, n)))[0]
        a = (q * values) @ q.T
        a = (a + a.T) / 2
        for shift in (-1.0, 0.3, 1.5, 1e-3):
            assert whitening.below(a, shift) == (values < shift).sum()
        e, x = whitening.Slicer(a).leading(8)
        want = values[: len(e)]
        assert len(e) == min(8, (values > 1e-10 * values[0]).sum())
        assert np.abs(e - want).max() < 1e-12 * n and np.abs(x.T @ x - np.eye(len(e))).max() < 1e-12 and np.abs(a @ x - x * e).max() < 1e-11
    big = np.array([[2**33, 0], [1, 2**40]])
    assert whitening.deviations(big, 3, np.array([5, 7])) == [(3 * 2**33 - 5) ** 2 + 49 if (3 * 2**33 - 5) ** 2 + 49 < 2**63 else None, None]


def plain_statistics(t):
    kinds = {c: k for k, x in (("A", string.ascii_uppercase), ("0", string.digits), (".", ".,;:"), ("!", "!?"), ("#", "#$%&*+/<=>@[\\]^_`{|}~")) for c in x}
    shape = "".join(kinds.get(c, "x" if c not in " \n" else c) for c in t)
    words = re.split(r"[ \t\n\x0b\x0c\r]+", t.lower().strip(" "))
    lines, solid, n = t.split("\n"), len(t) - t.count(" "), len(words)
    count = lambda k, of: shape.count(k) / of if of else 0.0
    gone = lambda p: len(shape) - len(re.sub(p, "", shape))
    return [math.log1p(len(t)), solid / n, count("A", solid), count("0", solid), count("#", solid), count("!", n), count(".", n), gone("[#!]{2,}(?=[ \n]|$)") / solid if solid else 0.0, gone("(?<![^ \n])#+(?=[ \n]|$)") / n,
            sum(len(w) < 3 for w in words) / n, len(set(words)) / n, n / len(lines), 1 - len(set(lines)) / len(lines)]


def test_quality_scores_by_hand(spark, sf_dir):
    docs, held = table(spark, sf_dir, "documents"), quality.held_out()
    labels = table(spark, sf_dir, "labels")
    model = quality.fit(docs, labels.where(~held))
    assert model.rules and len(model.rules) < 200
    odd = [(-1, None), (-2, ""), (-3, " "), (-4, "!!"), (-5, "Wow $$$ ||| A  b\nA  b\n"), (-6, "é" * 50_000 + " ### x")]
    df = docs.select("doc_id", "text").union(spark.createDataFrame(odd, "doc_id long, text string")).withColumn("score", F.lit("clash"))
    got = quality.with_score(df, model).collect()
    assert len(got) == df.count()
    for r in got:
        values = plain_statistics(r["text"] or "")
        z = model.bias + sum(w for rule, w in model.rules if all(a < values[i] <= b for i, a, b in rule.bounds))
        assert abs(r["score"] - 1 / (1 + math.exp(-z))) < 1e-9, r["text"]


def test_quality_of_rows_held_out(spark):
    sf_dir = "/root/testdata/sf0.01"
    docs, held = table(spark, sf_dir, "documents"), quality.held_out()
    labels = table(spark, sf_dir, "labels")
    model = quality.fit(docs, labels.where(~held))
    rows = quality.with_score(docs, model).where(held).join(labels.where("quality is not null").select("doc_id", "quality"), "doc_id").collect()
    good, bad = [r["score"] for r in rows if r["quality"] == 1], [r["score"] for r in rows if r["quality"] == 0]
    assert good and bad and sum((g > b) + (g == b) / 2 for g in good for b in bad) >= 0.95 * len(good) * len(bad)
    assert sum((r["score"] >= quality.THRESHOLD) == r["quality"] for r in rows) >= 0.95 * len(rows)


def test_quality_of_poor_labels(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None), (None, "b")], "doc_id long, text string")
    kinds = "doc_id long, quality int"
    share = lambda rows: {r["score"] for r in quality.with_score(docs, quality.fit(docs, spark.createDataFrame(rows, kinds))).collect()}
    assert share([]) == {0.5} and len(share([(1, 1), (2, 1), (None, 0), (2, 7), (1, None)])) == 1 and min(share([(1, 1), (2, 1)])) > 0.5
    assert share([(1, 1), (1, 0)]) == {0.5}
    assert quality.with_score(docs.limit(0), quality.Model((), 0.0)).count() == 0
