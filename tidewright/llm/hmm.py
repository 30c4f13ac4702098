"""Language-model scoring with a hidden Markov model.

The model's symbols are all words of the training texts, however many, each with
emissions of its own in every state; each of ``CLASSES`` classes of words by
their first and last bytes has one more place for words that training hasn't
seen. So the probability of a text is exact: the forward recursion over its words.

Texts are kept in chunks of some ``CHUNK`` tokens with a dictionary of their own,
sorted by hash. In a round of Baum-Welch each chunk is given the emissions of its
own words and gives back its expected counts of them, bucket by bucket of the
hashes; Spark adds up the counts of a bucket's words over all chunks. No table of
all words is ever in one place: the driver sees sums by state alone. Between rounds
emissions and counts travel in 16 bits; the last emissions, which score, in 32.
Forward and backward messages run over whole texts: those of over ``PART`` tokens
are cut into parts that go side by side, once the messages at the cuts are known.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, crc_of, words

STATES, CLASSES = 8, 2048
ROUNDS = 6
#: Added to each word's count, in the model's shares as in the base score; tokens of the corpus's shares that each state's counts get.
ADD, SHARED = 0.1, 100
_LOW = (1 << 52) - 1
END = (xxhash.xxh64_intdigest(b"\n") & _LOW) << 11
#: Tokens of a chunk, places of texts and padding that one recursion works on at a time.
CHUNK, CELLS = 2_500_000, 600_000
#: Texts of more tokens are cut into parts of so many.
LONG, PART = 4096, 512
#: Rows of a chunk that are worked on at a time where that needs several numbers beside each.
BLOCK = 1 << 14


class WordCode(dict):
    """word -> 63-bit code: a hash in the upper 52 bits, the class below."""

    limit = 400_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        self[word] = c = (xxhash.xxh64_intdigest(word) & _LOW) << 11 | zlib.crc32(word[:2] + b" " + word[-2:]) % CLASSES
        return c

    def of(self, text: str | None) -> np.ndarray:
        """Codes of a whole text's tokens, the end included."""
        tokens = words(text)
        out = np.empty(len(tokens) + 1, np.int64)
        out[:-1] = np.fromiter(map(self.__getitem__, tokens), np.int64, len(tokens))
        out[-1] = END
        return out


@dataclass
class Symbols:
    """Some words' codes in order with their training counts, and the mass of each class's place for unseen words."""

    codes: np.ndarray
    counts: np.ndarray
    mass: np.ndarray

    def weights(self) -> np.ndarray:
        """Smoothed counts; a word that training hasn't seen has its class's place."""
        return np.where(self.counts > 0, self.counts + ADD, self.mass[self.codes & (CLASSES - 1)])


def _noise(codes: np.ndarray, states: int) -> np.ndarray:
    """Standard normal numbers by code and state, the same wherever they are made."""

    def uniform(salt: int) -> np.ndarray:
        x = codes.astype(np.uint64)[:, None] + np.arange(salt, salt + states, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for shift, times in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(times)
        return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(float) / (1 << 53) + 1e-17

    if len(codes) > BLOCK:
        return np.concatenate([_noise(codes[lo : lo + BLOCK], states) for lo in range(0, len(codes), BLOCK)])
    return np.sqrt(-2 * np.log(uniform(1))) * np.cos(2 * np.pi * uniform(1001))


@dataclass
class Hmm:
    """Start of a text, start of a later piece, transitions, and emissions by symbol and state."""

    start: np.ndarray
    inner: np.ndarray
    move: np.ndarray
    emit: np.ndarray

    @staticmethod
    def first(share: np.ndarray, states: int) -> Hmm:
        emit = share[:, None] * np.exp(0.7 * _noise(np.arange(len(share)), states))
        move = np.full((states, states), 0.05 / max(1, states - 1)) if states > 1 else np.ones((1, 1))
        if states > 1:
            np.fill_diagonal(move, 0.95)
        flat = np.full(states, 1 / states)
        return Hmm(flat, flat.copy(), move, emit / emit.sum(0))

    def edges(self, parts: list[np.ndarray], nth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What is known at the ends of parts from the rest of their texts, by state and part: forward messages at the end of the part before, backward ones at a part's own end.

        A text's parts stand one after the other, ``nth`` counts them. The matrix of
        a part, which leads from its first place to its end, is made for all parts side by
        side, so a long text takes a part's number of steps and not its own.
        """
        k, more = len(self.start), np.append(nth[1:] > 0, False)
        before, after = np.full((k, len(parts)), 1 / k), np.ones((k, len(parts)))
        cut = np.flatnonzero((nth > 0) | more)
        if not len(cut):
            return before, after
        cut = cut[np.argsort([-len(parts[i]) for i in cut], kind="stable")]
        lengths = np.array([len(parts[i]) for i in cut])
        starts, flat = np.cumsum(lengths) - lengths, np.concatenate([parts[i] for i in cut])
        move, back = self.move, np.ascontiguousarray(self.move.T)
        through = np.zeros((k, k, len(cut)))  # (state, first state, part)
        for t in range(int(lengths[0])):
            m = int(np.searchsorted(-lengths, -t))
            e = self.emit.take(flat[starts[:m] + t], axis=0).T.astype(float)
            e /= e.max(axis=0)  # a factor of a part's matrix doesn't matter
            if t == 0:
                through[np.arange(k), np.arange(k)] = e
                continue
            now = (back @ through[:, :, :m].reshape(k, -1)).reshape(k, k, m)
            now *= e[:, None]
            if t % 8 == 0:
                now /= now.sum(axis=(0, 1))
            through[:, :, :m] = now
        place = np.full(len(parts), -1)
        place[cut] = np.arange(len(cut))
        for i in range(int(nth.max())):
            at = np.flatnonzero((nth == i) & more)
            ahead = back @ before[:, at] if i else np.repeat(self.start[:, None], len(at), axis=1)
            got = np.einsum("jip,ip->jp", through[:, :, place[at]], ahead)
            before[:, at + 1] = got / got.sum(axis=0)
        for i in range(int(nth.max()), 0, -1):
            at = np.flatnonzero(nth == i)
            got = move @ np.einsum("jip,jp->ip", through[:, :, place[at]], after[:, at])
            after[:, at - 1] = got / got.sum(axis=0)
        return before, after

    def expected(self, pieces: np.ndarray, lengths: np.ndarray, opens: np.ndarray, before: np.ndarray | None = None, after: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
        """Expected counts of pieces, longest first: pieces is (time, piece); ``opens`` marks those that begin a text.

        Others go on from the messages ``before`` them, and all of them end in those ``after`` them, where these are given (see ``edges``).
        """
        steps, k, kind = pieces.shape[0], len(self.start), self.emit.dtype
        active = np.searchsorted(-lengths, -np.arange(steps)).tolist()  # pieces longer than t
        at = np.cumsum([0, *active]).tolist()
        # one row for each state, without gaps, place after place: the pieces of a place are side by side
        syms = pieces[np.arange(steps)[:, None] < lengths]
        move = self.move.astype(kind)
        back = np.ascontiguousarray(move.T)
        alpha, scale, ahead = np.empty((k, len(syms)), kind), np.empty(len(syms), kind), np.ascontiguousarray(self.emit.take(syms, axis=0).T)
        inner = self.inner[:, None] if before is None else self.move.T @ before
        a = np.where(opens, self.start[:, None], inner).astype(kind)
        for t, m in enumerate(active):
            now, c = alpha[:, at[t] : at[t + 1]], scale[at[t] : at[t + 1]]
            np.multiply(a if t == 0 else back @ a[:, :m], ahead[:, at[t] : at[t + 1]], out=now)
            np.add.reduce(now, axis=0, out=c)
            now /= c
            a = now
        # from here on what is ahead of each place
        ahead /= scale
        beta = np.ones((k, len(syms)), kind)
        if after is not None:
            ends = np.array(at)[lengths - 1] + np.arange(len(lengths))
            beta[:, ends] = after / (alpha[:, ends] * after).sum(axis=0)
        for t in range(steps - 1, -1, -1):
            now = ahead[:, at[t] : at[t + 1]]
            now *= beta[:, at[t] : at[t + 1]]
            if t:
                np.matmul(move, now, out=beta[:, at[t - 1] : at[t - 1] + active[t]])
        moves = np.zeros((k, k))
        if before is not None:
            moves += before[:, ~opens] @ ahead[:, : len(lengths)][:, ~opens].T
        t = 1
        while t < steps:
            # places that as many pieces reach as the one before go together
            end = t + 1
            while end < steps and active[end] == active[t - 1] and at[end] - at[t] < BLOCK:
                end += 1
            moves += alpha[:, at[t - 1] : at[t - 1] + at[end] - at[t]] @ ahead[:, at[t] : at[end]].T
            t = end
        alpha *= beta
        emitted = np.stack([np.bincount(syms, weights=x, minlength=len(self.emit)) for x in alpha])
        first = alpha[:, : len(lengths)]
        return emitted.T, moves * self.move, first[:, opens].sum(axis=1), first[:, ~opens].sum(axis=1)

    def forward(self, texts: list[np.ndarray]) -> np.ndarray:
        """log10 of the probability of each whole symbol sequence, by the scaled forward recursion."""
        parts, nth = _cut(texts)
        if not parts:
            return np.zeros(0)
        before, _ = self.edges(parts, nth)
        order = np.argsort([-len(p) for p in parts], kind="stable")
        lengths = np.array([len(parts[i]) for i in order])
        starts, flat = np.cumsum(lengths) - lengths, np.concatenate([parts[i] for i in order])
        back = np.ascontiguousarray(self.move.T)
        total, a, m = np.zeros(len(order)), np.where(nth > 0, back @ before, self.start[:, None])[:, order], len(order)
        for t in range(int(lengths[0])):
            while lengths[m - 1] <= t:
                m -= 1
            a = a[:, :m] if t == 0 else back @ a[:, :m]
            a *= self.emit.take(flat[starts[:m] + t], axis=0).T
            c = a.sum(axis=0)
            a /= c
            total[:m] += np.log10(c)
        out = np.empty(len(total))
        out[order] = total
        return np.add.reduceat(out, np.flatnonzero(nth == 0))


def _cut(texts: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """Texts of more than ``LONG`` tokens in parts of ``PART``, others whole, one after the other, and each part's number in its text."""
    parts, nth = [], []
    for t in texts:
        cuts = range(0, len(t), PART) if len(t) > LONG else (0,)
        parts += [t[lo : lo + PART] for lo in cuts] if len(t) > LONG else [t]
        nth += range(len(cuts))
    return parts, np.array(nth, np.int64)


def _padded(parts: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(places in the list, symbols by time and part, lengths), longest first, some ``CELLS`` places at a time."""
    order = np.argsort([-len(p) for p in parts], kind="stable")
    lo = 0
    while lo < len(order):
        at = order[lo : lo + max(1, CELLS // len(parts[order[lo]]))]
        out = np.zeros((len(parts[at[0]]), len(at)), np.int64)
        for j, i in enumerate(at):
            out[: len(parts[i]), j] = parts[i]
        yield at, out, np.array([len(parts[i]) for i in at])
        lo += len(at)


def encode(df: DataFrame, key: str, text: str, train: F.Column) -> DataFrame:
    """(keys, train, lens, syms, codes): chunks of whole texts; syms are places in the chunk's sorted codes."""
    field = df.select(F.col(key).alias("key")).schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, held, keys, trained, n = WordCode(), [], [], [], 0

        def flush() -> pa.RecordBatch:
            found, syms = np.unique(np.concatenate(held), return_inverse=True)
            lens = np.array([len(w) for w in held], np.int64)
            key = pa.concat_arrays(keys)
            ends = pa.array([0, len(key)], pa.int32())
            blobs = [pa.array([x.tobytes()], pa.binary()) for x in (lens, syms.astype(np.int32), found)]
            return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(ends, key), pa.ListArray.from_arrays(ends, pa.concat_arrays(trained)), *blobs], ["keys", "train", "lens", "syms", "codes"])

        for b in batches:
            lo = 0
            for i, t in enumerate(b.column(2)):
                held.append(codes.of(t.as_py()))
                n += len(held[-1])
                if n >= CHUNK or i == b.num_rows - 1:
                    keys.append(b.column(0).slice(lo, i + 1 - lo))
                    trained.append(b.column(1).slice(lo, i + 1 - lo))
                    lo = i + 1
                if n >= CHUNK:
                    yield flush()
                    held, keys, trained, n = [], [], [], 0
        if held:
            yield flush()

    return df.select(F.col(key).alias("key"), train.alias("train"), F.col(text).alias("text")).mapInArrow(run, f"keys array<{field}>, train array<boolean>, lens binary, syms binary, codes binary")


def _texts(lens: pa.Scalar, syms: pa.Scalar) -> list[np.ndarray]:
    return np.split(np.frombuffer(syms.as_py(), np.int32), np.cumsum(np.frombuffer(lens.as_py(), np.int64))[:-1])


def _sent(chunk: int, codes: np.ndarray, sums: np.ndarray, bits: int) -> Iterator[pa.RecordBatch]:
    """A chunk's numbers by word, one row for each bucket of the codes."""
    edges = np.searchsorted(codes, np.arange(1 << bits, dtype=np.int64) << (63 - bits)).tolist() + [len(codes)]
    rows = [(i, lo, hi) for i, (lo, hi) in enumerate(zip(edges, edges[1:])) if lo < hi]
    yield pa.RecordBatch.from_arrays(
        [pa.array([i for i, _, _ in rows], pa.int32()), pa.array([chunk] * len(rows), pa.int64()), pa.array([codes[lo:hi].tobytes() for _, lo, hi in rows], pa.binary()), pa.array([sums[lo:hi].tobytes() for _, lo, hi in rows], pa.binary())],
        ["bucket", "chunk", "codes", "sums"])


SENT = "bucket int, chunk long, codes binary, sums binary"
#: ``stats`` rows have no chunk: training tokens, training words and sums by state of a bucket, or with bucket -1 the sums of moves and starts.
SERVED = "chunk long, bucket int, x binary, stats binary"


#: Places of a float's bits below those that travel, and the least number's: 2^-64. Exponents take 7 of 16 bits.
_CUT, _LEAST = 14, (127 - 64) << 9


def _packed(x: np.ndarray) -> np.ndarray:
    """Numbers from 0 to 2^64 in 16 bits, rounded to a 1,024th of themselves at most; those under 2^-64 are 0."""
    bits = np.ascontiguousarray(x, np.float32).view(np.uint32)
    return (np.maximum((bits + (1 << (_CUT - 1))) >> _CUT, _LEAST) - _LEAST).astype(np.uint16)


def _unpacked(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, ((x.astype(np.uint32) + _LEAST) << _CUT).view(np.float32), np.float32(0))


def _first(s: Symbols, states: int) -> np.ndarray:
    return s.weights()[:, None] * np.exp(0.7 * _noise(s.codes, states))


def _serve(states: int, mass: float | None, packed: bool = False):
    """Adds up a bucket's numbers by word and answers each chunk with its words' emissions, not yet divided by their sums by state, in full or ``packed``.

    Without ``mass``, the whole smoothed count, the numbers are training counts, and so are the answers.
    """

    def run(rows: pa.Table) -> pa.Table:
        bucket, chunks = rows.column("bucket")[0].as_py(), rows.column("chunk").to_pylist()
        sums = [np.frombuffer(x.as_py(), np.float64 if mass is None or bucket < 0 else np.uint16) for x in rows.column("sums")]
        if bucket < 0:
            out = [(-1, bucket, b"", np.sum(sums, axis=0).tobytes())]
        else:
            parts = [np.frombuffer(x.as_py(), np.int64) for x in rows.column("codes")]
            codes, at = np.unique(np.concatenate(parts), return_inverse=True)
            sums = np.concatenate(sums).reshape(len(at), -1)
            total = np.stack([np.bincount(at, x if mass is None else _unpacked(x), len(codes)) for x in sums.T], axis=1)
            s = Symbols(codes, np.rint(total.sum(axis=1)), np.full(CLASSES, ADD))
            emit = _first(s, states) if mass is None else total + SHARED / mass * s.weights()[:, None]
            known = s.counts > 0
            out = [(-1, bucket, b"", np.concatenate([[s.counts.sum(), known.sum()], emit[known].sum(axis=0)]).tobytes())]
            answer, ends = s.counts.astype(np.int64) if mass is None else _packed(emit) if packed else emit.astype(np.float32), np.cumsum([0, *map(len, parts)])
            for c, lo, hi in zip(chunks, ends, ends[1:]):
                out.append((c, bucket, answer[at[lo:hi]].tobytes(), b""))
        kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary())
        return pa.table([pa.array(x, k) for x, k in zip(zip(*out), kinds)], ["chunk", "bucket", "x", "stats"])

    return run


def _answered(chunks: DataFrame, answers: dict[str, DataFrame], run, schema: str) -> DataFrame:
    """``run`` on each chunk's row and its answers by name, a chunk at a time, so that a task holds one however many it has."""
    names = list(answers)
    parts = None
    for name, served in answers.items():
        part = served.where("chunk >= 0").select("chunk", "bucket", "x", F.lit(names.index(name)).alias("of"))
        parts = part if parts is None else parts.union(part)

    def one(left: pa.Table, right: pa.Table) -> pa.Table:
        of, bucket, x = (right.column(c).to_pylist() for c in ("of", "bucket", "x"))
        found = {name: b"".join(x[i] for i in sorted(range(len(x)), key=bucket.__getitem__) if of[i] == k) for k, name in enumerate(names)}
        del right, x
        return pa.Table.from_batches(list(run({c: left.column(c)[0] for c in left.column_names}, found)))

    return chunks.groupBy("chunk").cogroup(parts.groupBy("chunk")).applyInArrow(one, schema)


def _emissions(codes: np.ndarray, answer: bytes, kind, sums: np.ndarray) -> np.ndarray:
    """A chunk's emissions by word and state from answers of a kind: the words' counts, of which the first ones are made, or emissions, packed or in full."""
    got = np.frombuffer(answer, kind)
    if kind is np.int64:
        return _first(Symbols(codes, got, np.full(CLASSES, ADD)), len(sums)) / sums
    return (_unpacked(got) if kind is np.uint16 else got).reshape(-1, len(sums)) / sums


def _stats(served: DataFrame, states: int) -> tuple[int, int, np.ndarray, np.ndarray]:
    """Training tokens, training words, sums of emissions by state, and the moves and starts one after the other."""
    got = {r["bucket"]: np.frombuffer(r["stats"], np.float64) for r in served.where("chunk = -1").select("bucket", "stats").collect()}
    other = got.pop(-1, np.zeros(states * (states + 1)))
    whole = np.sum([got[k] for k in sorted(got)], axis=0) if got else np.zeros(2 + states)
    return int(whole[0]), int(whole[1]), whole[2:], other


def _counted(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chunk, train, lens, syms, codes in zip(*(b.column(i) for i in range(5)), strict=True):
                codes = np.frombuffer(codes.as_py(), np.int64)
                of = np.repeat(np.array(train.as_py(), bool), np.frombuffer(lens.as_py(), np.int64))
                n = np.bincount(np.frombuffer(syms.as_py(), np.int32)[of], minlength=len(codes)).astype(np.float64)
                yield from _sent(chunk.as_py(), codes, n, bits)

    return run


def _expect(model: Hmm, sums: np.ndarray, bits: int, kind):
    """Expected counts of each chunk's training texts under ``model``, whose emissions are answers of a kind divided by ``sums``. They are sent packed."""
    states = len(sums)

    def run(row: dict[str, pa.Scalar], answers: dict[str, bytes]) -> Iterator[pa.RecordBatch]:
        codes = np.frombuffer(row["codes"].as_py(), np.int64)
        m = Hmm(model.start, model.inner, model.move, _emissions(codes, answers["emit"], kind, sums).astype(np.float32))
        emitted, other = np.zeros(m.emit.shape[::-1]).T, np.zeros(states * (states + 1))
        parts, nth = _cut([t for t, y in zip(_texts(row["lens"], row["syms"]), row["train"].as_py(), strict=True) if y])
        before, after = m.edges(parts, nth)
        for at, pieces, lengths in _padded(parts):
            e, moves, start, _ = m.expected(pieces, lengths, nth[at] == 0, before[:, at], after[:, at])
            emitted += e
            other += np.concatenate([moves.ravel(), start])
        yield from _sent(row["chunk"].as_py(), codes, _packed(emitted), bits)
        yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([-1], pa.int64()), pa.array([b""], pa.binary()), pa.array([other.tobytes()], pa.binary())], ["bucket", "chunk", "codes", "sums"])

    return run


def train(chunks: DataFrame, states: int, rounds: int, scratch: Scratch) -> tuple[Hmm, np.ndarray, DataFrame, DataFrame, int, int]:
    """Baum-Welch over all training texts: the model without emissions, their sums by state, the tables of counts and emissions, and the numbers of training tokens and words."""
    bits = max(6, (chunks.count() // 4).bit_length())
    read = ["chunk", "train", "lens", "syms", "codes"]
    counts = served = scratch.save(chunks.select(*read).mapInArrow(_counted(bits), SENT).groupBy("bucket").applyInArrow(_serve(states, None), SERVED), "served")
    total, kinds, sums, _ = _stats(served, states)
    mass, sums = total + ADD * (kinds + CLASSES), sums + ADD * CLASSES
    model = Hmm.first(np.ones(1), states)
    for i in range(rounds):
        kind = np.int64 if served is counts else np.uint16
        sent = _answered(chunks.select(*read), {"emit": served}, _expect(model, sums, bits, kind), SENT)
        last, served = served, scratch.save(sent.groupBy("bucket").applyInArrow(_serve(states, mass, i < rounds - 1), SERVED), "served")
        if last is not counts:
            scratch.forget(last)
        _, _, sums, other = _stats(served, states)
        sums = sums + SHARED / mass * ADD * CLASSES
        move, start = other[: states * states].reshape(states, states) + 1, other[states * states :] + 1
        model = Hmm(start / start.sum(), model.inner, move / move.sum(axis=1, keepdims=True), model.emit)
        del sent, last
        chunks.sparkSession.sparkContext._jvm.System.gc()  # lets Spark delete the round's shuffle files
    return model, sums, counts, served, total, kinds


def score(df: DataFrame, key: str = "doc_id", text: str = "text", states: int = STATES, rounds: int = ROUNDS, train_on: F.Column | None = None) -> DataFrame:
    """One row per row of ``df``: key, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Scores are log10 probabilities of whole texts, the end included. Null and
    empty texts are an end alone. Rows are learned from where ``train_on``
    holds, by default those whose crc32 of the key as text isn't divisible by
    ten; a null key has crc 0 here, so its row is held out. Without training
    rows all words are unseen. Repeated rows are scored alike. Words are told
    apart by a class and a 52-bit hash.
    """
    spark = df.sparkSession
    train_on = crc_of(F.col(key)) % 10 != 0 if train_on is None else train_on
    scratch = Scratch(spark, "hmm")
    # bucketed by chunk, so that rounds don't shuffle the texts
    name = f"hmm_{uuid.uuid4().hex}"
    chunks = encode(df, key, text, train_on).withColumn("chunk", F.monotonically_increasing_id())
    chunks.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), "chunk").option("path", f"{scratch.root}/chunks").option("compression", "zstd").format("parquet").saveAsTable(name)
    scratch.tables.append(name)
    chunks = spark.table(name)
    model, sums, counts, served, total, kinds = train(chunks, states, rounds, scratch)
    kind = np.int64 if served is counts else np.float32

    def run(row: dict[str, pa.Scalar], answers: dict[str, bytes]) -> Iterator[pa.RecordBatch]:
        m = Hmm(model.start, model.inner, model.move, _emissions(np.frombuffer(row["codes"].as_py(), np.int64), answers["emit"], kind, sums))
        c, texts = np.frombuffer(answers["seen"], np.int64), _texts(row["lens"], row["syms"])
        logs, n = np.log10(c + ADD), np.array([len(t) for t in texts], np.int64)
        base = np.array([float(logs[t].sum()) for t in texts]) - n * np.log10(total + ADD * (kinds + 1))
        known = np.array([int((c[t] > 0).sum()) for t in texts], np.int64)
        held = pa.array(~np.array(row["train"].as_py(), bool))
        yield pa.RecordBatch.from_arrays([row["keys"].values, held, pa.array(n), pa.array(known), pa.array(base), pa.array(m.forward(texts))], ["key", "held_out", "n_tokens", "n_known", "base_score", "score"])

    field = df.select(F.col(key).alias("key")).schema["key"].dataType.simpleString()
    out = _answered(chunks, {"seen": counts, "emit": served}, run, f"key {field}, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return out.select(F.col("key").alias(key), "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
