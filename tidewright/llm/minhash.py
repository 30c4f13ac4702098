"""Near-duplicate documents by an inverted join over MinHash signature coordinates.

A document's set of word shingles is cut down to ``COORDS`` minima. Every
(coordinate, value) pair is a posting list of documents, and a pair of documents
is a candidate when at least ``MATCHES`` coordinates collide:

* values that one document alone has can't collide and are skipped;
* of what is left, only the rarest ``left - MATCHES + 1`` values are posted
  (a pair with ``MATCHES`` collisions meets in that prefix), so the values that
  common passages give to many documents are skipped as well;
* collisions of the pairs that meet are counted on the whole signatures.

With 128 coordinates, a pair at similarity 0.8 has fewer than 77 collisions with
a probability below 1e-6. Candidates are confirmed on the full shingle sets.

Groups of thousands of near copies would meet in all pairs, so pairs are never
written out. Documents that are connected by enough collisions are a neighbourhood:
each is compared with a few hubs of its posting lists, and then, block against
block, the documents of a list that are still in different neighbourhoods; a pair
of blocks gives a forest of its candidates, at most a row for each document. All links
lie within neighbourhoods. There the candidates among the hubs' pairs are confirmed
on the full sets, what they link becomes one component, and the documents outside a
neighbourhood's main component are compared with all of it, block against block:
collisions pick the candidates, the full sets confirm them on the spot, and
a forest of the links is what comes out. Blocks hold documents of like sizes, and sets whose
sizes alone keep them apart don't meet. No list or neighbourhood is gathered in
one place, and no pair that could join two components is left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, WordHash, fresh, words
from .components import components, spread_join

COORDS, MATCHES = 128, 77
#: Document ids (24 bytes each) that are broadcast at most.
BROADCAST_IDS = 100_000
#: Documents of a posting list that are compared as one block.
BLOCK = 256
#: Documents and shingles of a neighbourhood that are about one block.
ROWS, SHINGLES = 768, 300_000
#: Hubs that each posting list names, and those that a document is compared with first: the ones it shares most lists with.
HUBS, TRIED = 3, 6
_MIX = np.uint64(0x9E3779B97F4A7C15)
_rng = np.random.default_rng(20_240_229)
_XOR = _rng.integers(0, 1 << 63, COORDS, dtype=np.uint64)
_TIMES = _rng.integers(0, 1 << 63, COORDS, dtype=np.uint64) | np.uint64(1)


@dataclass(frozen=True)
class Rule:
    """Shingles of ``width`` words, linked at a Jaccard similarity of ``percent`` hundredths."""

    width: int = 5
    percent: int = 80


def shingles(text: str | None, width: int, hashes: WordHash) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles. A text of fewer words is one shingle; one without words has none."""
    h = hashes.of(words(text))
    if not len(h):
        return h
    n = max(1, len(h) - width + 1)
    out = np.zeros(n, np.uint64)
    for i in range(min(width, len(h))):
        out = (out ^ h[i : i + n]) * _MIX
        out ^= out >> np.uint64(29)
    return np.unique(out)


def signature(found: np.ndarray) -> np.ndarray:
    """32-bit minima under each of the hash functions; very long sets are taken in pieces."""
    least = np.full(COORDS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(found), 4096):
        x = (found[i : i + 4096][None, :] ^ _XOR[:, None]) * _TIMES[:, None]
        np.minimum(least, x.min(axis=1), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)


def signatures(df: DataFrame, key: str, text: str, rule: Rule) -> DataFrame:
    """(id, th, n_shingles, d1, d2, sig) of each row: th is a hash of the text, d1 and d2 a 128-bit digest of the shingle set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHash()
        for b in batches:
            n, d, sigs = [], [], []
            for t in b.column(2):
                found = shingles(t.as_py(), rule.width, hashes)
                n.append(len(found))
                d.append(xxhash.xxh3_128_digest(found.tobytes()))
                sigs.append(signature(found).tobytes() if len(found) else b"")
            pair = np.frombuffer(b"".join(d), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(pair[:, 0]), pa.array(pair[:, 1]), pa.array(sigs, pa.binary())], ["id", "th", "n_shingles", "d1", "d2", "sig"])

    rows = df.select(F.col(key).cast("long").alias("id"), F.xxhash64(text).alias("th"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "id long, th long, n_shingles long, d1 long, d2 long, sig binary")


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    at = np.arange(COORDS, dtype=np.int64) << 32
    for b in batches:
        sig = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint32).reshape(-1, COORDS)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.column(0).to_numpy(), COORDS)), pa.array((sig.astype(np.int64) | at).ravel())], ["rep", "tok"])


def _postings(reps: DataFrame) -> DataFrame:
    """(rep, tok): the rarest colliding values of each document, enough of them to meet any partner."""
    # dealt out by value once, for the counts and for the join with them
    tok = reps.select("rep", "sig").mapInArrow(_tokens, "rep long, tok long").repartition("tok")
    shared = tok.groupBy("tok").agg(F.count("*").alias("n")).where("n > 1")
    left = tok.join(shared, "tok").groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("n", "tok"))).alias("t")).where(F.size("t") >= MATCHES)
    return left.select("rep", F.explode(F.slice("t", F.lit(1), F.size("t") - F.lit(MATCHES - 1))).alias("t")).select("rep", "t.tok")


def _bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One byte of each coordinate: equal values have equal bytes, others one time in 256."""
    for b in batches:
        sig = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint32).reshape(-1, COORDS).astype(np.uint8)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x.tobytes() for x in sig], pa.binary())], ["rep", "low"])


def _colliding(pairs: DataFrame, low: DataFrame) -> DataFrame:
    """Those of the pairs (hub, rep) whose whole signatures have enough collisions, by their bytes: none is missed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            one, two = (np.frombuffer(b"".join(b.column(i).to_pylist()), np.uint8).reshape(-1, COORDS) for i in (2, 3))
            yield b.select([0, 1]).filter(pa.array((one == two).sum(axis=1) >= MATCHES))

    one, two = (low.select(F.col("rep").alias(x), F.col("low").alias(f"low_{x}")) for x in ("rep", "hub"))
    return spread_join(pairs, two, "hub").join(one, "rep").select("hub", "rep", "low_rep", "low_hub").mapInArrow(run, "hub long, rep long")


def _texts(df: DataFrame, key: str, text: str, wanted: DataFrame, rule: Rule, scratch: Scratch) -> DataFrame:
    """(rep, text) of the wanted documents (rep, d1, d2). Ids are broadcast when they are few, else joined by a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHash()
        for b in batches:
            d = np.frombuffer(b"".join(xxhash.xxh3_128_digest(shingles(t.as_py(), rule.width, hashes).tobytes()) for t in b.column(1)), np.int64).reshape(-1, 2)
            yield b.select([0, 1]).filter(pa.array((d[:, 0] == b.column(2).to_numpy()) & (d[:, 1] == b.column(3).to_numpy())))

    wanted = scratch.save(wanted, "wanted")
    wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_IDS else wanted
    texts = df.select(F.col(key).cast("long").alias("rep"), F.col(text).alias("text"))
    found = texts.join(wanted, "rep").select("rep", "text", "d1", "d2").mapInArrow(run, "rep long, text string")
    # repeated rows, and texts with one set of shingles under one id, are one document
    return scratch.save(found.groupBy("rep").agg(F.min("text").alias("text")), "texts")


def _confirmed(pairs: DataFrame, texts: DataFrame, reps: DataFrame, rule: Rule) -> DataFrame:
    """Those of the pairs (hub, rep) with enough shingles in common: a hub's text meets its partners' in blocks of ``BLOCK`` documents or ``SHINGLES`` shingles. Texts travel, which pack better than their hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHash()
        for b in batches:
            found = []
            for hub, one, reps, others in zip(*(b.column(i) for i in range(4)), strict=True):
                x, ends = shingles(one.as_py(), rule.width, hashes), reps.values.to_numpy()
                for rep, other in zip(ends.tolist(), others.values, strict=True):
                    y = shingles(other.as_py(), rule.width, hashes)
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    if 100 * both >= rule.percent * (len(x) + len(y) - both):
                        found.append((hub.as_py(), rep))
            ends = np.array(found, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(ends[:, 0])), pa.array(np.ascontiguousarray(ends[:, 1]))], ["a", "b"])

    sized = pairs.join(reps.select("rep", "n_shingles"), "rep")
    sizes = sized.groupBy("hub").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n_shingles") / SHINGLES)).alias("parts"))
    placed = spread_join(pairs, sizes, "hub").select("hub", F.pmod(F.xxhash64("rep"), F.col("parts")).alias("part"), "rep")
    blocks = placed.join(texts, "rep").groupBy("hub", "part").agg(F.collect_list("rep").alias("reps"), F.collect_list("text").alias("texts"))
    own = texts.select(F.col("rep").alias("hub"), F.col("text").alias("own"))
    return blocks.join(own, "hub").select("hub", "own", "reps", "texts").mapInArrow(run, "a long, b long")


def _hub_pairs(posted: DataFrame) -> DataFrame:
    """(hub, rep): each document with the hubs that it shares most posting lists with. What hubs miss is found later."""
    hubs = posted.groupBy("tok").agg(*[F.min(F.struct(F.xxhash64("rep", F.lit(i)).alias("h"), "rep")).alias(f"h{i}") for i in range(HUBS)])
    named = hubs.select("tok", F.array_distinct(F.array(*[F.col(f"h{i}.rep") for i in range(HUBS)])).alias("hubs"))
    met = posted.join(named, "tok").select("rep", F.explode("hubs").alias("hub")).where("rep != hub").groupBy("rep", "hub").agg((-F.count("*")).alias("n"))
    # a document has at most HUBS * COORDS of them
    best = met.groupBy("rep").agg(F.slice(F.array_sort(F.collect_list(F.struct("n", "hub"))), 1, TRIED).alias("best"))
    return best.select(F.explode("best.hub").alias("hub"), "rep")


def _collisions(low_x: list[bytes], low_y: list[bytes]) -> np.ndarray:
    """Colliding coordinates of each x with each y, by their bytes: never fewer than there are."""
    one, two = (np.ascontiguousarray(np.frombuffer(b"".join(v), np.uint8).reshape(-1, COORDS).T) for v in (low_x, low_y))
    same = np.zeros((len(low_x), len(low_y)), np.uint8)
    for i, j in zip(one, two, strict=True):
        same += i[:, None] == j[None, :]
    return same


def _forest(cx: np.ndarray, cy: np.ndarray, candidates: np.ndarray, confirm: Callable | None = None) -> Iterator[tuple[int, int]]:
    """Places (i, j) of links that join the components cx and cy as all candidates do: a forest, so fewer than there are documents.

    ``confirm(i, js)`` tells which of the candidates are links; those that would join nothing are not asked for.
    """
    names, at = np.unique(np.concatenate([cx, cy]), return_inverse=True)
    root, of_x, of_y = np.arange(len(names)), at[: len(cx)], at[len(cx) :]
    for i in range(len(cx)):
        js = np.flatnonzero(candidates[i])
        js = js[root[of_y[js]] != root[of_x[i]]]
        if confirm is not None and len(js):
            js = js[confirm(i, js)]
        while len(js):
            yield i, int(js[0])
            root[root == root[of_y[js[0]]]] = root[of_x[i]]
            js = js[root[of_y[js]] != root[of_x[i]]]


def _ends(found: list[tuple[int, int]]) -> pa.RecordBatch:
    ends = np.unique(np.array(found, np.int64).reshape(-1, 2), axis=0)
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(ends[:, 0])), pa.array(np.ascontiguousarray(ends[:, 1]))], ["a", "b"])


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Forests of the colliding pairs of each pair of blocks."""
    for b in batches:
        found = []
        for x, cx, lx, y, cy, ly in zip(*(b.column(i) for i in range(6)), strict=True):
            x, cx, y, cy = (v.values.to_numpy() for v in (x, cx, y, cy))
            found += [(int(x[i]), int(y[j])) for i, j in _forest(cx, cy, _collisions(lx.as_py(), ly.as_py()) >= MATCHES)]
        yield _ends(found)


def _apart(rows: DataFrame, by: str) -> DataFrame:
    """(by, main, n): the largest component and the rows of each group of ``rows`` (by, c) with several."""
    sizes = rows.groupBy(by, "c").count()
    return sizes.groupBy(by).agg(F.max(F.struct("count", "c")).alias("m"), F.count("*").alias("kinds"), F.sum("count").alias("n")).where("kinds > 1").select(by, F.col("m.c").alias("main"), "n")


def _near_lists(posted: DataFrame, known: DataFrame, low: DataFrame, scratch: Scratch) -> DataFrame:
    """Forests (a, b) of the colliding pairs of documents of one posting list that ``known`` has in different components."""
    own = posted.join(known.withColumnRenamed("node", "rep"), "rep", "left").select("tok", "rep", F.coalesce("component", "rep").alias("c"))
    mixed = own.join(_apart(own, "tok"), "tok").join(low, "rep")
    parts = F.ceil(F.col("n") / BLOCK)
    mixed = scratch.save(mixed.select("tok", "rep", "c", "low", F.pmod(F.xxhash64("rep"), parts).alias("k"), parts.alias("parts"), (F.col("c") != F.col("main")).alias("rare")), "mixed")

    def blocks(rows: DataFrame, x: str) -> DataFrame:
        return rows.groupBy("tok", "k").agg(*[F.collect_list(c).alias(f"{c}_{x}") for c in ("rep", "c", "low")], F.first("parts").alias(f"parts_{x}"))

    # each block of documents outside the main component goes to every block of its list, one row each
    rare = blocks(mixed.where("rare"), "a").withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts_a") - 1)))
    met = rare.join(blocks(mixed, "b"), ["tok", "k"])
    return met.select("rep_a", "c_a", "low_a", "rep_b", "c_b", "low_b").mapInArrow(_compare, "a long, b long").distinct()


class _Sets:
    """The shingle sets of a block, made when they are asked for, and the documents of each shingle."""

    def __init__(self, texts: pa.Array, width: int, hashes: WordHash):
        self.texts, self.width, self.hashes = texts, width, hashes
        self.sets: dict[int, np.ndarray] = {}
        self.posted: tuple[np.ndarray, np.ndarray] | None = None

    def __getitem__(self, i: int) -> np.ndarray:
        if i not in self.sets:
            self.sets[i] = shingles(self.texts[i].as_py(), self.width, self.hashes)
        return self.sets[i]

    def common(self, x: np.ndarray, js: np.ndarray) -> np.ndarray:
        """How many shingles ``x`` has in common with each of the documents ``js``."""
        if len(js) < 8 and self.posted is None:
            return np.array([len(np.intersect1d(x, self[j], assume_unique=True)) for j in js.tolist()])
        if self.posted is None:
            all_sets = [self[j] for j in range(len(self.texts))]
            h, of = np.concatenate(all_sets), np.repeat(np.arange(len(all_sets)), [len(s) for s in all_sets])
            order = np.argsort(h, kind="stable")
            self.posted = h[order], of[order]
        h, of = self.posted
        lo = np.searchsorted(h, x, "left")
        n = np.searchsorted(h, x, "right") - lo
        each = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
        return np.bincount(of[each], minlength=len(self.texts))[js]


def _within(near: DataFrame, first: DataFrame, reps: DataFrame, low: DataFrame, texts: DataFrame, rule: Rule, scratch: Scratch) -> DataFrame:
    """Forests (a, b) of the links between documents of one neighbourhood that ``first`` has in different components.

    A block holds documents of one neighbourhood whose sizes differ by less than
    the threshold allows, so that only blocks of the same and of the next size meet.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHash()
        for b in batches:
            found = []
            for x, cx, nx, lx, tx, y, cy, ny, ly, ty in zip(*(b.column(i) for i in range(10)), strict=True):
                x, cx, nx, y, cy, ny = (v.values.to_numpy() for v in (x, cx, nx, y, cy, ny))
                one, two = _Sets(tx.values, rule.width, hashes), _Sets(ty.values, rule.width, hashes)
                likely = (_collisions(lx.as_py(), ly.as_py()) >= MATCHES) & (100 * np.minimum.outer(nx, ny) >= rule.percent * np.maximum.outer(nx, ny))

                def linked(i: int, js: np.ndarray) -> np.ndarray:
                    both = two.common(one[i], js)
                    return 100 * both >= rule.percent * (nx[i] + ny[js] - both)

                found += [(int(x[i]), int(y[j])) for i, j in _forest(cx, cy, likely, linked)]
            yield _ends(found)

    own = near.select(F.col("node").alias("rep"), F.col("component").alias("g")).join(first.withColumnRenamed("node", "rep"), "rep", "left").select("rep", "g", F.coalesce("component", "rep").alias("c"))
    size = F.floor(F.log("n_shingles") / F.lit(log(100 / rule.percent * (1 + 1e-9)))).cast("long")
    told = reps.select("rep", "n_shingles").withColumn("size", size)
    rows = spread_join(own, _apart(own, "g").select("g", "main"), "g").join(told, "rep").select("rep", "g", "c", "n_shingles", "size", (F.col("c") != F.col("main")).alias("rare"))
    rows = scratch.save(rows, "apart")
    kind = ["g", "size", "rare"]
    parts = F.ceil(F.greatest(F.count("*") / ROWS, F.sum("n_shingles") / SHINGLES))
    counts = rows.groupBy(*kind).agg(parts.cast("long").alias("parts"))
    # (g, size, rare) has no bound on its rows, but a row of counts each
    placed = rows.join(counts, kind).withColumn("k", F.pmod(F.xxhash64("rep"), F.col("parts"))).join(low, "rep").join(texts, "rep")
    columns = ("rep", "c", "n_shingles", "low", "text")
    blocks = scratch.save(placed.groupBy(*kind, "k").agg(*[F.collect_list(c).alias(c) for c in columns]), "blocks")
    names = blocks.select(*kind, "k")
    a, b = (names.select("g", *[F.col(c).alias(f"{c}_{x}") for c in ("size", "rare", "k")]) for x in "ab")
    both, order = F.col("rare_a") & F.col("rare_b"), [F.struct(f"size_{x}", f"k_{x}") for x in "ab"]
    near_sizes = F.explode(F.array(*[F.col("size_a") + i for i in (-1, 0, 1)])).alias("size_b")
    meet = a.where("rare_a").select("*", near_sizes).join(b, ["g", "size_b"]).where(~F.col("rare_b") | (both & (order[0] <= order[1])))
    for x in "ab":
        own = blocks.select("g", *[F.col(c).alias(f"{c}_{x}") for c in ("size", "rare", "k", *columns)])
        meet = meet.join(own, ["g", *(f"{c}_{x}" for c in ("size", "rare", "k"))])
    return meet.select(*[f"{c}_{x}" for x in "ab" for c in columns]).mapInArrow(run, "a long, b long")


def _classes(df: DataFrame, key: str, text: str, rule: Rule) -> tuple[DataFrame, DataFrame]:
    """The rows (id, th, n_shingles, d1, d2), and the component of each set of shingles that a row with an id has."""
    kept, scratch = (Scratch(df.sparkSession, "minhash") for _ in range(2))
    signed = scratch.save(signatures(df, key, text, rule), "signatures")
    reps = signed.where("n_shingles > 0 and id is not null").groupBy("d1", "d2").agg(F.min("id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig"))
    reps = scratch.save(reps, "classes")
    all_rows = kept.save(signed.drop("sig"), "rows")
    scratch.forget(signed)
    low = scratch.save(reps.select("rep", "sig").mapInArrow(_bytes, "rep long, low binary"), "bytes")
    posted = scratch.save(_postings(reps), "postings")
    signed, reps = reps, scratch.save(reps.drop("sig"), "classes")
    scratch.forget(signed)
    tried = scratch.save(_hub_pairs(posted), "pairs")
    close = scratch.save(_colliding(tried, low), "close")
    scratch.forget(tried)
    hubs = scratch.save(components(close.select(F.col("hub").alias("a"), F.col("rep").alias("b")), scratch), "near")
    edges = hubs.select(F.col("node").alias("a"), F.col("component").alias("b"))
    near = scratch.save(components(edges.union(_near_lists(posted, hubs, low, scratch)), scratch), "near")
    scratch.forget(posted)
    texts = _texts(df, key, text, reps.join(near.select(F.col("node").alias("rep")), "rep", "left_semi").select("rep", "d1", "d2"), rule, scratch)
    first = scratch.save(components(_confirmed(close, texts, reps, rule), scratch), "components")
    more = _within(near, first, reps, low, texts, rule, scratch)
    last = components(first.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more), scratch)
    classes = reps.join(last.withColumnRenamed("node", "rep"), "rep", "left").select("d1", "d2", F.coalesce("component", "rep").alias("component_id"))
    classes = kept.save(classes, "classes")
    scratch.drop()
    return all_rows, classes


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", rule: Rule = Rule()) -> DataFrame:
    """One row per row of ``df``: id, n_shingles, component_id, kept.

    Documents are linked when ``100 * |A & B| >= percent * |A | B|`` for their
    shingle sets; ``component_id`` is the smallest id reachable by links and
    ``kept`` marks the rows that have that id. Empty and null texts have no
    shingles and link with nothing. Rows that share an id are one document; rows
    with a null id are linked to exact copies only, and kept when they have
    none. Shingles are compared by 64-bit hashes. Other columns are not read.
    """
    rows, classes = _classes(df, key, text, rule)
    out = rows.join(classes, ["d1", "d2"], "left")
    component = F.when(F.col("n_shingles") > 0, F.coalesce("component_id", "id")).otherwise(F.col("id"))
    return out.select("id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("id") == component, component.isNull()).alias("kept"))


def drop_near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", rule: Rule = Rule()) -> DataFrame:
    """``df`` with one row of each group of near duplicates, unchanged: the one with the smallest id, then text hash.

    Rows are told apart by id and text. Of repeated rows, which agree in both,
    one stays. A row with a null id goes when another row has the same shingles,
    and of several such rows without an id one stays. Texts without words are in no group; all their rows stay.
    """
    rows, classes = _classes(df, key, text, rule)
    rows = Scratch(df.sparkSession, "minhash").save(rows.where("n_shingles > 0").join(classes, ["d1", "d2"], "left"), "groups")
    # rows without an id whose set no other row has are a group by that set
    group = [F.col("component_id"), F.when(F.col("component_id").isNull(), F.struct("d1", "d2"))]
    order = F.struct(F.col("id").isNull(), "id", "th")
    best = rows.groupBy(*[c.alias(n) for c, n in zip(group, ("g", "set"))]).agg(F.min(order).alias("best"), F.count("*").alias("n")).where("n > 1")
    own_id, own_th, stays = fresh(df, "__id", "__th", "__stays")
    keyed = rows.select(group[0].alias("g"), group[1].alias("set"), order.alias("o"))
    told = keyed.join(best, keyed["g"].eqNullSafe(best["g"]) & keyed["set"].eqNullSafe(best["set"]))
    told = told.groupBy(F.col("o.id").alias(own_id), F.col("o.th").alias(own_th)).agg(F.max(F.col("o") == F.col("best")).alias(stays), F.count("*").alias("n"))
    told = Scratch(df.sparkSession, "minhash").save(told.where(~F.col(stays) | (F.col("n") > 1)).drop("n"), "told")
    joined = df.join(told, F.col(key).cast("long").eqNullSafe(F.col(own_id)) & (F.xxhash64(text) == F.col(own_th)), "left")
    out = joined.where(F.col(stays).isNull()).drop(own_id, own_th, stays)
    if told.where(F.col(stays)).limit(1).count():  # repeated rows
        out = out.union(joined.where(F.col(stays)).dropDuplicates([own_id, own_th]).drop(own_id, own_th, stays))
    return out
