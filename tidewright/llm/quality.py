"""A quality classifier made of rules.

Built-in functions turn each text into a few statistics. A random forest of
shallow trees over them, grown by Spark on labelled rows, gives conjunctive
rules: each path from a root to a node is one. A logistic regression with a
lasso penalty weighs the rules and drops most. What is left is one Spark
expression over the statistics, so that scoring needs no model at all.
"""

from __future__ import annotations

import math
import string
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, crc_of, fresh

#: Labelled rows that the classifier is fitted on at most.
MAX_LABELLED = 20_000
TREES, DEPTH, SEED = 30, 3, 11
#: Weight of the lasso penalty, and the least weight that a rule keeps.
PENALTY, LEAST = 2e-3, 1e-6
THRESHOLD = 0.3


#: A text's shape: each ASCII character by its kind. Others stay as they are, and count as letters.
_KINDS = (("A", string.ascii_uppercase), ("a", string.ascii_lowercase), ("0", string.digits), (".", ".,;:"), ("!", "!?"), ("'", "'\"()-"), ("#", "#$%&*+/<=>@[\\]^_`{|}~"))
NAMES = ("length", "word_length", "upper", "digits", "signs", "shouts", "stops", "decorated", "alone", "tiny", "varied", "line_words", "repeated_lines")


def with_statistics(df: DataFrame, text: str, column: str) -> DataFrame:
    """``df`` with an array of the statistics ``NAMES`` of a text; shares hardly change with its length, and are 0 where there is nothing to share."""
    plain, shape, words, gaps = fresh(df, "__plain", "__shape", "__words", "__gaps")
    size = lambda c: F.length(c).cast("double")
    less = lambda c, rest: size(c) - size(rest)  # noqa: E731  characters that went
    shaped = F.translate(plain, "".join(x for _, x in _KINDS), "".join(k * len(x) for k, x in _KINDS))
    # each of these is used more than once, and so is made once
    df = df.withColumn(plain, F.coalesce(F.col(text), F.lit("")))
    df = df.withColumns({shape: shaped, words: F.split(F.trim(F.lower(plain)), r"\s+"), gaps: less(plain, F.replace(F.col(plain), F.lit(" "), F.lit("")))})
    n, lines = F.size(words).cast("double"), F.split(plain, "\n")
    solid = size(plain) - F.col(gaps)
    kind = lambda k: less(shape, F.replace(F.col(shape), F.lit(k), F.lit("")))
    runs = lambda pattern: less(shape, F.regexp_replace(shape, pattern, ""))
    per = lambda x, of: F.when(of > 0, x / of).otherwise(0.0)
    found = {
        "length": F.log1p(size(plain)),
        "word_length": per(solid, n),
        "upper": per(kind("A"), solid),
        "digits": per(kind("0"), solid),
        "signs": per(kind("#"), solid),
        "shouts": per(kind("!"), n),
        "stops": per(kind("."), n),
        "decorated": per(runs("[#!]{2,}(?=[ \n]|$)"), solid),
        "alone": per(runs("(?<![^ \n])#+(?=[ \n]|$)"), n),
        "tiny": per(F.size(F.filter(words, lambda w: F.length(w) < 3)).cast("double"), n),
        "varied": per(F.size(F.array_distinct(words)).cast("double"), n),
        "line_words": per(n, F.size(lines).cast("double")),
        "repeated_lines": 1 - F.size(F.array_distinct(lines)) / F.size(lines).cast("double"),
    }
    return df.withColumn(column, F.array(*[found[k] for k in NAMES])).drop(plain, shape, words, gaps)


@dataclass(frozen=True, order=True)
class Rule:
    """Bounds on statistics that hold together: (statistic, above, at most), by number; an open bound is infinite."""

    bounds: tuple[tuple[int, float, float], ...]

    def holds(self, values: Column) -> Column:
        """Whether the rule holds for an array of statistics."""
        out = F.lit(True)
        for i, above, most in self.bounds:
            if above > -math.inf:
                out = out & (values[i] > above)
            if most < math.inf:
                out = out & (values[i] <= most)
        return out

    def __str__(self) -> str:
        parts = [f"{NAMES[i]} > {a:.6g}" for i, a, _ in self.bounds if a > -math.inf] + [f"{NAMES[i]} <= {b:.6g}" for i, _, b in self.bounds if b < math.inf]
        return " and ".join(parts)


@dataclass(frozen=True)
class Model:
    rules: tuple[tuple[Rule, float], ...]
    bias: float

    def score(self, values: Column) -> Column:
        """The probability of label 1 for an array of statistics."""
        z = F.lit(float(self.bias))
        for rule, w in self.rules:
            z = z + F.when(rule.holds(values), float(w)).otherwise(0.0)
        return 1 / (1 + F.exp(-z))


def paths(node, bounds: dict[int, tuple[float, float]] | None = None) -> list[Rule]:
    """The rules of all nodes below the root of a Spark tree: the conjunction of the splits on the way there."""
    bounds = bounds or {}
    out = [Rule(tuple((i, *b) for i, b in sorted(bounds.items())))] if bounds else []
    if node.subtreeDepth() == 0:
        return out
    split = node.split()
    i, at = split.featureIndex(), split.threshold()
    above, most = bounds.get(i, (-math.inf, math.inf))
    return out + paths(node.leftChild(), bounds | {i: (above, min(most, at))}) + paths(node.rightChild(), bounds | {i: (max(above, at), most)})


def fit(documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", max_labelled: int = MAX_LABELLED) -> Model:
    """A model of ``label`` (0 or 1) in ``labels``, from at most ``max_labelled`` labelled rows, those with the smallest hashes of their key.

    Rows with a null key or another label, or whose key has no document, are left
    out; repeated labels count as often as they occur. With labels of one kind
    only, or none, every text gets the same score.
    """
    chosen = labels.where(F.col(label).isin(0, 1)).select(F.col(key).alias("__k"), F.col(label).cast("double").alias("label"))
    chosen = chosen.where(F.col("__k").isNotNull()).orderBy(F.xxhash64("__k"), "__k", "label").limit(max_labelled)
    # chosen has max_labelled rows at most
    rows = documents.select(F.col(key).alias("__k"), F.col(text).alias("__t")).join(F.broadcast(chosen), "__k")
    scratch = Scratch(documents.sparkSession, "quality")
    rows = scratch.save(with_statistics(rows, "__t", "values").select("label", "values"), "labelled")
    size = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}  # two rows
    pos, neg = size.get(1.0, 0), size.get(0.0, 0)
    if not pos or not neg:
        return Model((), math.log((pos + 0.5) / (neg + 0.5)))
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, subsamplingRate=0.7, minInstancesPerNode=3, featureSubsetStrategy="onethird", labelCol="label", featuresCol="x")
    trees = forest.fit(rows.select("label", array_to_vector("values").alias("x"))).trees
    rules = sorted({rule for t in trees for rule in paths(t._call_java("rootNode"))})
    if not rules:  # no statistic tells the labels apart
        return Model((), math.log(pos / neg))
    hits = rows.select("label", array_to_vector(F.array(*[r.holds(F.col("values")).cast("double") for r in rules])).alias("x"))
    lasso = LogisticRegression(elasticNetParam=1.0, regParam=PENALTY, maxIter=100, labelCol="label", featuresCol="x").fit(scratch.save(hits, "hits"))
    weighed = tuple((r, float(w)) for r, w in zip(rules, lasso.coefficients, strict=True) if abs(w) > LEAST)
    return Model(weighed, float(lasso.intercept))


def with_score(df: DataFrame, model: Model, text: str = "text", column: str = "score") -> DataFrame:
    """``df`` with the score (0 to 1) of each whole text; null texts count as empty.

    Built-in functions only, row by row: nothing is shuffled, whatever the length,
    skew or repeats. Other columns are kept, one named ``column`` is replaced.
    """
    own = fresh(df, "__values")[0]
    counted = with_statistics(df, text, own)
    return counted.withColumn(column, model.score(F.col(own))).drop(own)


def held_out(key: str = "doc_id", parts: int = 5, part: int = 0) -> Column:
    """Rows whose labels are not learned from."""
    return crc_of(F.col(key)) % parts == part
