"""Toxicity with noisy-channel deobfuscation.

A token that looks disguised (digits or signs among letters, runs of a letter,
letters set apart) becomes a lattice of the characters it may stand for. A
Viterbi search under a character trigram model of the corpus picks the reading,
and a logistic regression scores the restored words. Tokens of plain letters
have one reading and pass as they are.
"""

from __future__ import annotations

import math
import os
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, crc_of, fresh

#: Letters that a sign or digit is written for.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "li", "+": "t", "(": "c", "€": "e", "£": "l", "#": "h",
}
#: Log costs of writing a letter as itself, as a sign, of a repeated letter, and of a sign that stands for nothing.
SUBSTITUTE, REPEAT, NOISE = -1.0, -0.7, -2.5
EDGE = "\"'()[]{}<>.,;:!?%&*#$|-_=+/\\~`^«»“”‘’…"
#: Marks at a token's ends that never stand for a letter; the language model decides on tokens of more places than that.
PUNCTUATION, LONGEST = ".,;:?\"'", 24
_TRIPLE = re.compile(r"([^\W\d_])\1\1")
_ODD = re.compile(r"[^\W\d_][\d@$!|+(€£#*.\-_]+[^\W\d_]|[\d@$|€£][^\W\d_]|[^\W\d_][\d@$€£]|([^\W\d_])\1\1")
_APART = re.compile(r"(?<!\S)(?:\S\s++){2,}\S(?!\S)")
_REPEATS = re.compile(r"(.)\1+", re.DOTALL)
#: Long tokens that their form tells from words: addresses, mail addresses, hexadecimal keys and hashes.
_FORM = re.compile(r"\w://|^www\.|^[\w.+\-]+@[\w\-]+\.[\w.\-]+$|^(?:0x)?[0-9a-f\-:]+$")
_JOINED = re.compile(r"^(?:[^\W_][.\-_*])+[^\W_]$")
#: Symbols of the language model: 0 a boundary, 1 to 26 the letters, 27 any other letter.
SYMBOLS = 28
_SYMBOL = bytes(c - 96 if 97 <= c <= 122 else c - 64 if 65 <= c <= 90 else 27 if c >= 128 else 0 for c in range(256))
#: Labelled rows that the classifier is fitted on at most, and features that it keeps.
MAX_LABELLED, MAX_FEATURES = 6000, 2500
THRESHOLD = 0.3


def symbol(c: str) -> int:
    return _SYMBOL[ord(c)] if ord(c) < 128 else 27


@dataclass
class CharModel:
    """log P(c | a, b) of character trigrams, smoothed by bigrams and unigrams; an empty corpus gives a uniform model."""

    logp: np.ndarray

    @staticmethod
    def of(counts: np.ndarray) -> CharModel:
        c3 = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS).astype(float)
        c2, c1 = c3.sum(0), c3.sum((0, 1))
        p1 = (c1 + 1) / (c1.sum() + SYMBOLS)
        p2 = (c2 + 5 * p1) / (c2.sum(1, keepdims=True) + 5)
        return CharModel(np.log((c3 + 5 * p2[None]) / (c3.sum(2, keepdims=True) + 5)))


def char_counts(df: DataFrame, text: str = "text") -> np.ndarray:
    """Trigram counts of symbols over all texts; what reaches the driver is one number per trigram."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SYMBOLS**3, np.int64)
        for b in batches:
            for t in b.column(0):
                if s := t.as_py():
                    x = np.frombuffer((" " + s + " ").encode("utf-8", "surrogatepass").translate(_SYMBOL), np.uint8).astype(np.int32)
                    total += np.bincount((x[:-2] * SYMBOLS + x[1:-1]) * SYMBOLS + x[2:], minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["g", "n"])

    out = np.zeros(SYMBOLS**3)
    for g, n in df.select(text).mapInArrow(run, "g long, n long").groupBy("g").agg(F.sum("n")).collect():
        out[g] = n
    return out


def lattice(token: str) -> list[list[tuple[str, float]]]:
    """For each place of a token, the strings that it may stand for and their log costs."""
    out: list[list[tuple[str, float]]] = []
    i = 0
    while i < len(token):
        c = token[i]
        j = i + 1
        while j < len(token) and token[j] == c:
            j += 1
        options: list[tuple[str, float]] = []
        if c.isalpha():
            options.append((c, 0.0 if j == i + 1 else REPEAT))
            if j > i + 1:
                options.append((c + c, 0.0 if j == i + 2 else REPEAT))
        else:
            for letter in LEET.get(c, ""):
                options.append((letter, SUBSTITUTE))
                if j > i + 1:
                    options.append((letter + letter, 2 * SUBSTITUTE))
            options.append(("", NOISE))
        out.append(options)
        i = j
    return out


def decode(token: str, model: CharModel) -> str:
    """The likeliest reading of a token: Viterbi over its lattice; a state is the last two symbols."""
    best: dict[tuple[int, int], tuple[float, str]] = {(0, 0): (0.0, "")}
    done: list[str] = []
    for i, options in enumerate(lattice(token), 1):
        then: dict[tuple[int, int], tuple[float, str]] = {}
        for (a, b), (score, word) in best.items():
            for text, cost in options:
                s, x, y = score + cost, a, b
                for c in text:
                    z = symbol(c)
                    s += model.logp[x, y, z]
                    x, y = y, z
                if (x, y) not in then or (s, word + text) > then[x, y]:
                    then[x, y] = (s, word + text)
        best = then
        if i % 64 == 0:  # what all readings begin with is settled, so that long tokens take time in proportion
            n = len(same := os.path.commonprefix([w for _, w in best.values()]))
            done.append(same)
            best = {k: (s, w[n:]) for k, (s, w) in best.items()}
    return "".join(done) + max(((s + model.logp[x, y, 0], w) for (x, y), (s, w) in best.items()), default=(0.0, ""))[1]


def likely(word: str, model: CharModel) -> bool:
    """Whether a reading is likelier under the language model than letters drawn evenly."""
    z = [0, 0, *map(symbol, word), 0]
    return bool(word) and sum(model.logp[x] for x in zip(z, z[1:], z[2:])) > -(len(z) - 2) * math.log(SYMBOLS)


@dataclass
class Restorer:
    """Restores words, remembering up to ``limit`` decoded tokens at a time."""

    model: CharModel
    limit: int = 300_000
    known: dict[str, str] = field(default_factory=dict)

    def __call__(self, token: str) -> str:
        """The word that a token stands for; empty for one without letters and digits at its ends."""
        if (w := self.known.get(token)) is None:
            if len(self.known) >= self.limit:
                self.known.clear()
            core = token.strip(EDGE)
            w = self.known[token] = core if core.isalpha() and core == token.strip(PUNCTUATION) and not _TRIPLE.search(core) else self._restore(token, core)
        return w

    def _restore(self, token: str, core: str) -> str:
        outer = token.strip(PUNCTUATION)
        if not _ODD.search(core) and not _ODD.search(outer):
            return core
        if _JOINED.match(core):
            return decode(re.sub(r"[.\-_*]", "", core), self.model)
        places = len(_REPEATS.sub(r"\1", core))
        if places > LONGEST and _FORM.search(core):
            return core
        # a run of signs at an end is decoration; a single sign there may be a letter
        w = decode(outer if len(outer) <= len(core) + 1 else core, self.model)
        doubtful = places > LONGEST or 3 * sum(map(str.isalpha, core)) < len(core)
        return w if not doubtful or likely(w, self.model) else core

    def _apart(self, run: str) -> Iterator[str]:
        """Letters set apart as one word; with wider gaps among narrow ones, also the words between those."""
        least = min(map(len, re.findall(r"\s+", run)))
        parts = ["".join(x.split()) for x in re.split(r"\s{%d,}" % (least + 1), run)]
        for x in dict.fromkeys(["".join(parts), *(x for x in parts if len(x) > 2)]):
            if 2 * sum(map(str.isalpha, x)) >= len(x):
                yield decode(x, self.model)

    def words(self, text: str | None) -> Counter:
        """Restored words of a whole text in lower case, with their counts."""
        low = (text or "").lower()
        out: Counter = Counter()
        for m in _APART.finditer(low):
            out.update(self._apart(m[0]))
        for token, n in Counter(low.split()).items():
            if w := self(token):
                out[w] += n
        return out


def features(words: Counter) -> tuple[dict[str, int], int]:
    """Counts of words and of the beginnings of longer words, and the number of words."""
    out: dict[str, int] = {}
    for w, n in words.items():
        out[w] = out.get(w, 0) + n
        for k in (5, 7):
            if len(w) > k:
                p = f"{w[:k]}*"
                out[p] = out.get(p, 0) + n
    return out, max(1, sum(words.values()))


def weight(n: int, total: int) -> float:
    """A feature's value: the log of its share in hundredths of the words, which length hardly changes."""
    return math.log1p(100.0 * n / total)


@dataclass
class Model:
    chars: CharModel
    weights: dict[str, float]
    bias: float
    #: The share of label 1 among the rows learned from: the score of a text without words.
    share: float = 0.0

    def __post_init__(self):
        #: The first five characters of the features that are beginnings.
        self.starts = {f[:5] for f in self.weights if f.endswith("*")}

    def score(self, text: str | None, restorer: Restorer) -> float:
        found = restorer.words(text)
        if not found:
            return self.share
        total = sum(found.values())
        hits: dict[str, int] = {}
        for w, n in found.items():
            if w in self.weights:
                hits[w] = hits.get(w, 0) + n
            if len(w) > 5 and w[:5] in self.starts:
                for f in (f"{w[:5]}*", f"{w[:7]}*")[: 1 + (len(w) > 7)]:
                    if f in self.weights:
                        hits[f] = hits.get(f, 0) + n
        z = self.bias + sum(self.weights[f] * weight(n, total) for f, n in sorted(hits.items()))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 2e-3, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Weights and bias by Nesterov's gradient method on the mean log loss with a squared penalty."""
    w = v = np.zeros(x.shape[1] + 1, x.dtype)  # the bias is last
    rate = 1 / (0.25 * (1 + float(np.einsum("ij,ij->i", x, x).mean())) + penalty)
    for i in range(rounds):
        at = w + (i / (i + 3)) * (w - v)
        off = 1 / (1 + np.exp(-np.clip(x @ at[:-1] + at[-1], -30, 30))) - y
        grad = np.append(x.T @ off, off.sum()) / len(x)
        grad[:-1] += penalty * at[:-1]
        v, w = w, (at - rate * grad).astype(x.dtype)
    return w[:-1], float(w[-1])


def fit(documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", max_labelled: int = MAX_LABELLED) -> Model:
    """A model of ``label`` (0 or 1) in ``labels``. Character counts come from all texts of ``documents``.

    The classifier is fitted on at most ``max_labelled`` labelled rows, those
    with the smallest hashes of their key, and has the ``MAX_FEATURES`` features
    of at least three rows that tell the labels apart best; rows with a null key or label, or
    whose key has no document, are left out. With labels of one kind only, or
    none, every text gets the same score.
    """
    chars = CharModel.of(char_counts(documents, text))
    chosen = labels.where(F.col(label).isin(0, 1)).select(F.col(key).alias("__k"), F.col(label).cast("int").alias("__y"))
    chosen = chosen.where(F.col("__k").isNotNull()).orderBy(F.xxhash64("__k"), "__k", "__y").limit(max_labelled)
    # chosen has max_labelled rows at most; their texts are written once, and read three times
    rows = documents.select(F.col(key).alias("__k"), F.col(text).alias("__t")).join(F.broadcast(chosen), "__k").select("__k", "__t", "__y")
    rows = Scratch(documents.sparkSession, "toxicity").save(rows, "labelled")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        restorer = Restorer(chars)
        for b in batches:
            out = []
            for t, y in zip(b["__t"], b["__y"], strict=True):
                found, total = features(restorer.words(t))
                out += [(f, y, weight(n, total)) for f, n in found.items()]
            yield pd.DataFrame(out, columns=["f", "y", "v"])

    gathered = rows.mapInPandas(run, "f string, y int, v double").groupBy("f").agg(
        F.sum(F.when(F.col("y") == 1, F.col("v")).otherwise(0.0)).alias("a"), F.sum(F.when(F.col("y") == 0, F.col("v")).otherwise(0.0)).alias("b"), F.count("*").alias("n"))
    size = {y: n for y, n in rows.groupBy("__y").count().collect()}
    pos, neg = size.get(1, 0), size.get(0, 0)
    if not pos or not neg:
        return Model(chars, {}, math.log((pos + 0.5) / (neg + 0.5)), (pos + 0.5) / (pos + neg + 1))
    a, b = F.col("a") / pos, F.col("b") / neg
    top = gathered.where("n >= 3").withColumn("gain", F.abs(a - b) / F.sqrt(a + b + 1e-3)).orderBy(F.desc("gain"), "f").limit(MAX_FEATURES)
    names = {r["f"]: i for i, r in enumerate(top.select("f").collect())}

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        restorer = Restorer(chars)
        for b in batches:
            out = []
            for k, t, y in zip(b["__k"], b["__t"], b["__y"], strict=True):
                found, total = features(restorer.words(t))
                hit = sorted((names[f], weight(n, total)) for f, n in found.items() if f in names)
                out.append((str(k), y, np.array([i for i, _ in hit], np.int32).tobytes(), np.array([v for _, v in hit], np.float32).tobytes()))
            yield pd.DataFrame(out, columns=["k", "y", "at", "v"])

    # max_labelled rows at most, as bytes, which are a tenth of lists of numbers in the driver
    sample = sorted(map(tuple, rows.mapInPandas(vectors, "k string, y int, at binary, v binary").collect()))
    x, y = np.zeros((len(sample), len(names)), np.float32), np.array([r[1] for r in sample], np.float32)
    for i, (_, _, at, v) in enumerate(sample):
        x[i, np.frombuffer(at, np.int32)] = np.frombuffer(v, np.float32)
    w, bias = logistic(x, y)
    return Model(chars, {f: float(w[i]) for f, i in names.items() if abs(w[i]) > 1e-4}, bias, pos / (pos + neg))


def with_score(df: DataFrame, model: Model, text: str = "text", column: str = "score") -> DataFrame:
    """``df`` with the score (0 to 1) of each whole text. Texts without words, null ones too, get the share of label 1.

    Per row: nothing is shuffled, whatever the length, skew or repeats; other columns are kept, one named ``column`` is replaced.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = shared.value
        restorer = Restorer(m.chars)
        for b in batches:
            yield pd.Series([m.score(t, restorer) for t in b], dtype="float64")

    return df.withColumn(column, F.pandas_udf(run, "double")(F.col(text)))


def held_out(key: str = "doc_id", parts: int = 4, part: int = 2) -> F.Column:
    """Rows whose labels are not learned from."""
    return crc_of(F.col(key)) % parts == part


def drop_toxic(df: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``df`` with a score below ``threshold``, unchanged."""
    own = fresh(df, "__score")[0]
    return with_score(df, model, text, own).where(F.col(own) < threshold).drop(own)
