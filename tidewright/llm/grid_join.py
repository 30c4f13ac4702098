"""Embedding near-duplicates by an epsilon grid order join.

Unit vectors with a cosine of at least c are at most ``eps = sqrt(2 - 2 c)``
apart. Vectors are turned to their principal axes, and sorted by the cells of a
grid of that width on the leading axes. The sorted sequence is cut into
intervals; the join goes down a hierarchy of intervals, keeps only the pairs
whose boxes come within ``eps`` of each other, and compares vectors block
against block, in double precision on the original vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch
from .components import components

COSINE = 0.98
#: Leading axes of the grid, vectors in a block, and blocks in an interval of the next level up.
AXES, BLOCK, FAN = 8, 256, 8


def _rows(series: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(series), np.float64).reshape(len(series), -1)


def _clean(df: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """(id, label, dim, v) of the rows that can be compared: v is the vector in doubles, as bytes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i, l, e in zip(b["id"], b["label"], b["e"], strict=True):
                if e is None or pd.isna(l) or pd.isna(i) or not len(e):
                    continue
                v = np.array([np.nan if x is None else x for x in e], np.float64)
                if np.isfinite(v).all() and v.any():
                    # a power of two changes no cosine, and keeps the squares of huge and tiny numbers finite
                    out.append((int(i), str(l), len(v), np.ldexp(v, -np.frexp(np.abs(v).max())[1]).tobytes()))
            yield pd.DataFrame(out, columns=["id", "label", "dim", "v"])

    src = df.select(F.col(key).alias("id"), F.col(label).cast("string").alias("label"), F.col(vector).alias("e"))
    return src.mapInPandas(run, "id long, label string, dim int, v binary")


def _axes(classes: DataFrame, dims: list[int]) -> dict[int, np.ndarray]:
    """Per dimension, the leading principal axes of the unit vectors: sums of products gathered per task, one matrix per dimension on the driver."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for d, g in b.groupby("dim"):
                x = _rows(g["v"])
                x = np.hstack([x / np.linalg.norm(x, axis=1, keepdims=True), np.ones((len(x), 1))])
                total[d] = total.get(d, 0) + x.T @ x
        for d, m in total.items():
            yield pd.DataFrame({"dim": d, "at": np.arange(m.size, dtype=np.int64), "s": m.ravel()})

    out: dict[int, np.ndarray] = {d: np.zeros((d + 1, d + 1)) for d in dims}
    for r in classes.select("dim", "v").mapInPandas(run, "dim int, at long, s double").groupBy("dim", "at").agg(F.sum("s").alias("s")).collect():
        out[r["dim"]].ravel()[r["at"]] = r["s"]
    axes = {}
    for d, m in out.items():
        n, mean = max(1.0, m[-1, -1]), m[-1, :-1] / max(1.0, m[-1, -1])
        axes[d] = np.ascontiguousarray(np.linalg.eigh(m[:-1, :-1] / n - np.outer(mean, mean))[1][:, ::-1][:, :AXES])
    return axes


def _placed(classes: DataFrame, axes: dict[int, np.ndarray], eps: float) -> DataFrame:
    """Classes with their coordinates on the leading axes and the cells of the grid."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = b.copy()
            at: dict[int, np.ndarray] = {}
            for d, g in b.groupby("dim"):
                x = _rows(g["v"])
                for i, row in zip(g.index, (x / np.linalg.norm(x, axis=1, keepdims=True)) @ axes[d], strict=True):
                    at[i] = row
            out["at"] = [at[i].tolist() for i in b.index]
            out["cell"] = [np.floor(at[i] / eps).astype(int).tolist() for i in b.index]
            yield out

    return classes.mapInPandas(run, "rep long, copies long, label string, dim int, v binary, at array<double>, cell array<int>")


def _parent(boxes: DataFrame) -> DataFrame:
    """Boxes of the intervals one level up."""
    d = F.size(F.first("lo"))
    n = AXES
    lo = F.array(*[F.min(F.get("lo", F.lit(i))) for i in range(n)])
    hi = F.array(*[F.max(F.get("hi", F.lit(i))) for i in range(n)])
    return boxes.groupBy("label", "dim", F.floor(F.col("block") / FAN).cast("long").alias("block")).agg(lo.alias("lo"), hi.alias("hi"), d.alias("d")).drop("d")


def _near(lo1, hi1, lo2, hi2, eps: float) -> F.Column:
    """Whether two boxes come within ``eps`` of each other; absent axes count as equal."""
    gap = F.lit(0.0)
    for i in range(AXES):
        apart = F.greatest(F.lit(0.0), F.get(lo1, F.lit(i)) - F.get(hi2, F.lit(i)), F.get(lo2, F.lit(i)) - F.get(hi1, F.lit(i)))
        gap = gap + F.coalesce(apart * apart, F.lit(0.0))
    return gap <= eps * eps * (1 + 1e-9) + 1e-12


def _block_pairs(boxes: DataFrame, levels: int, eps: float) -> DataFrame:
    """(label, dim, b1, b2) of the block pairs, b1 <= b2, that the recursion from the top level leaves."""
    stack = [boxes]
    for _ in range(levels):
        stack.append(_parent(stack[-1]))
    pairs = stack[-1].select("label", "dim", F.col("block").alias("b1"), F.col("block").alias("b2"))
    for level in reversed(stack[:-1]):
        one = level.select("label", "dim", F.col("block").alias("b1"), F.col("lo").alias("lo1"), F.col("hi").alias("hi1"), F.floor(F.col("block") / FAN).cast("long").alias("p1"))
        two = level.select("label", "dim", F.col("block").alias("b2"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"), F.floor(F.col("block") / FAN).cast("long").alias("p2"))
        up = pairs.select("label", "dim", F.col("b1").alias("p1"), F.col("b2").alias("p2"))
        pairs = up.join(one, ["label", "dim", "p1"]).join(two, ["label", "dim", "p2"]).where(F.col("b1") <= F.col("b2")).where(_near("lo1", "hi1", "lo2", "hi2", eps)).select("label", "dim", "b1", "b2")
    return pairs


def _compare(batch: pd.DataFrame, cosine: float) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """(rep, links) counts and the spanning links (a, b) of block pairs in a batch."""
    links: list[tuple[int, int]] = []
    counts: list[tuple[int, int]] = []
    for r1, c1, v1, r2, c2, v2, same in zip(*(batch[c] for c in ("r1", "c1", "v1", "r2", "c2", "v2", "same")), strict=True):
        i1, i2, n1, n2 = (np.asarray(x, np.int64) for x in (r1, r2, c1, c2))
        x, y = (np.frombuffer(b"".join(v), np.float64).reshape(len(i), -1) for v, i in ((v1, i1), (v2, i2)))
        near = (x @ y.T) / np.outer(np.sqrt((x * x).sum(1)), np.sqrt((y * y).sum(1))) >= cosine
        if same:
            np.fill_diagonal(near, False)
        counts += zip(i1.tolist(), (near @ n2).tolist(), strict=True)
        if not same:
            counts += zip(i2.tolist(), (n1 @ near).tolist(), strict=True)
        # a forest of the links of this pair of blocks: as good as all of them for reachability
        root: dict[int, int] = {}

        def find(a: int) -> int:
            while root.setdefault(a, a) != a:
                root[a] = root[root[a]]
                a = root[a]
            return a

        for a, b in zip(*np.nonzero(near), strict=True):
            a, b = int(i1[a]), int(i2[b])
            if (p := find(a)) != (q := find(b)):
                root[max(p, q)] = min(p, q)
                links.append((a, b))
    return [c for c in counts if c[1]], links


def near_vectors(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", cosine: float = COSINE) -> DataFrame:
    """One row per row of ``df``: key, n_links, component_id, kept.

    Rows with equal labels that aren't null are linked when their cosine, in
    doubles, is at least ``cosine``. ``n_links`` counts the other rows linked
    directly, exact copies included; ``component_id`` is the smallest key
    reachable. A row whose vector is null, empty, zero or holds a null or
    non-finite number links with nothing, nor does one with a null key or label,
    nor do vectors of different lengths. Repeated rows are rows of their own:
    each counts the other. Equal vectors are compared once, as one class.
    """
    if not 0 < cosine <= 1:
        raise ValueError("the cosine is above 0 and at most 1")
    scratch = Scratch(df.sparkSession, "grid")
    eps = float(np.sqrt(max(2 - 2 * cosine, 1e-6))) + 1e-9
    rows = scratch.save(_clean(df, key, vector, label), "vectors")
    classes = scratch.save(rows.groupBy("label", "dim", "v").agg(F.min("id").alias("rep"), F.count("*").alias("copies")).select("rep", "copies", "label", "dim", "v"), "classes")
    dims = [r[0] for r in classes.select("dim").distinct().collect()]
    placed = scratch.save(_placed(classes, _axes(classes, dims), eps), "placed")
    # a class's number in grid order: cells in ranges, counted per range, then numbered within each
    ranged = scratch.save(placed.repartitionByRange(F.col("label"), F.col("dim"), F.col("cell"), F.col("rep")).withColumn("part", F.spark_partition_id()), "ranged")
    before = ranged.groupBy("label", "dim", "part").count().withColumn("skip", F.coalesce(F.sum("count").over(Window.partitionBy("label", "dim").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("count")
    order = F.row_number().over(Window.partitionBy("label", "dim", "part").orderBy("cell", "rep"))
    numbered = scratch.save(ranged.withColumn("n", order).join(before, ["label", "dim", "part"]).withColumn("block", F.floor((F.col("skip") + F.col("n") - 1) / BLOCK).cast("long")), "numbered")
    blocks = numbered.groupBy("label", "dim", "block").agg(F.collect_list("rep").alias("r"), F.collect_list("copies").alias("c"), F.collect_list("v").alias("v"))
    lo = F.array(*[F.min(F.get("at", F.lit(i))) for i in range(AXES)]).alias("lo")
    hi = F.array(*[F.max(F.get("at", F.lit(i))) for i in range(AXES)]).alias("hi")
    boxes = scratch.save(numbered.groupBy("label", "dim", "block").agg(lo, hi), "boxes")
    most = boxes.agg(F.max("block")).first()[0] or 0
    levels = 1
    while FAN**levels <= most:
        levels += 1
    pairs = scratch.save(_block_pairs(boxes, levels, eps), "pairs")
    one = blocks.select("label", "dim", F.col("block").alias("b1"), F.col("r").alias("r1"), F.col("c").alias("c1"), F.col("v").alias("v1"))
    two = blocks.select("label", "dim", F.col("block").alias("b2"), F.col("r").alias("r2"), F.col("c").alias("c2"), F.col("v").alias("v2"))
    met = pairs.join(one, ["label", "dim", "b1"]).join(two, ["label", "dim", "b2"]).select("r1", "c1", "v1", "r2", "c2", "v2", (F.col("b1") == F.col("b2")).alias("same"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            counts, links = _compare(b, cosine)
            yield pd.DataFrame([(a, None, n) for a, n in counts] + [(a, b2, 0) for a, b2 in links], columns=["a", "b", "n"]).astype({"a": "int64", "b": "Int64", "n": "int64"})

    compared = scratch.save(met.mapInPandas(run, "a long, b long, n long"), "compared")
    counts = compared.where("b is null").groupBy("a").agg(F.sum("n").alias("n")).withColumnRenamed("a", "rep")
    found = components(compared.where("b is not null").select("a", "b"), scratch).withColumnRenamed("node", "rep")
    told = classes.join(counts, "rep", "left").join(found, "rep", "left").select("label", "dim", "v", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    each = rows.join(told, ["label", "dim", "v"]).select("id", "n_links", "component_id")
    unlinked = scratch.save(_unlinked(df, key, vector, label), "unlinked")
    out = each.unionByName(unlinked)
    return out.select(F.col("id").alias(key), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _unlinked(df: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    v = F.col(vector)
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    usable = F.col(key).isNotNull() & F.col(label).isNotNull() & v.isNotNull() & (F.size(v) > 0) & F.forall(v, number) & F.exists(v, lambda x: x != 0)
    return df.where(~F.coalesce(usable, F.lit(False))).select(F.col(key).cast("long").alias("id"), F.lit(0).cast("long").alias("n_links"), F.col(key).cast("long").alias("component_id"))
