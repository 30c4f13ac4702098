"""Benchmark decontamination by q-gram counting and banded alignment.

An item of m characters that occurs in a text with at most k edits shares at
least ``m - q + 1 - k q`` of its q-grams with that place (the q-gram lemma), all
of them on neighbouring diagonals. So a text's q-grams are looked up in an index
of the items, hits are counted in overlapping bands of diagonals, and only
regions whose count meets the bound are aligned, within the band.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, fresh

Q = 12
#: Edits allowed for each character of an item.
RATE = 0.05
#: Bytes of items that one index holds; more items are looked up in several passes.
BLOCK_BYTES = 2_000_000
#: Hits that are written out at a time, hits of one q-gram above which they are counted as a correlation, and diagonals aligned at a time.
HITS, MANY, WIDE = 1_000_000, 100_000, 65_536
#: Lower-cases A-Z, keeps a-z, 0-9 and bytes beyond ASCII, and turns all else into spaces.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_ONE, _TWO = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def normal(text: str | None) -> bytes:
    """Words in lower case with single spaces between them, as UTF-8."""
    return b" ".join((text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split())


def grams(text: bytes) -> np.ndarray:
    """64-bit hashes of the q-grams at each position."""
    if len(text) < Q:
        return np.zeros(0, np.uint64)
    a = np.frombuffer(text, np.uint8).astype(np.uint64)
    a = a[:-1] | (a[1:] << np.uint64(8))
    a = a[:-2] | (a[2:] << np.uint64(16))
    a = a[:-4] | (a[4:] << np.uint64(32))
    h = (a[: 8 - Q] * _ONE) ^ (a[Q - 8 :] * _TWO)
    return h ^ (h >> np.uint64(31))


@dataclass
class Index:
    ids: list[int]
    texts: list[bytes]
    #: Edits allowed and shared q-grams needed, per item; items under Q characters are looked up as they are.
    edits: np.ndarray
    needed: np.ndarray
    keys: np.ndarray
    starts: np.ndarray
    items: np.ndarray
    places: np.ndarray
    maybe: np.ndarray
    short: list[int]

    @staticmethod
    def of(rows: list[tuple[int, bytes]], rate: float = RATE) -> Index:
        ids, texts = [i for i, _ in rows], [t for _, t in rows]
        m = np.array([len(t) for t in texts], np.int64)
        edits = np.minimum((m * rate).astype(np.int64), np.maximum(0, (m - Q) // Q))
        g = [grams(t) for t in texts]
        h = np.concatenate([*g, np.zeros(0, np.uint64)])
        item = np.repeat(np.arange(len(g)), [len(x) for x in g]).astype(np.int64)
        place = np.concatenate([*(np.arange(len(x)) for x in g), np.zeros(0)]).astype(np.int64)
        order = np.argsort(h, kind="stable")
        keys, first = np.unique(h[order], return_index=True)
        bits = max(16, int(len(keys) * 16).bit_length())
        maybe = np.zeros(1 << bits, bool)
        maybe[(keys >> np.uint64(64 - bits)).astype(np.int64)] = True
        return Index(ids, texts, edits, m - Q + 1 - edits * Q, keys, np.append(first, len(h)), item[order], place[order], maybe, [i for i, t in enumerate(texts) if 0 < len(t) < Q])

    def regions(self, text: bytes) -> dict[int, list[tuple[int, int]]]:
        """Item -> (first diagonal, width) of the runs of bands that hold enough shared q-grams."""
        h = grams(text)
        bits = len(self.maybe).bit_length() - 1
        at = np.flatnonzero(self.maybe[(h >> np.uint64(64 - bits)).astype(np.int64)])
        if not len(at) or not len(self.keys):
            return {}
        k = np.minimum(np.searchsorted(self.keys, h[at]), len(self.keys) - 1)
        sure = self.keys[k] == h[at]
        at, k = at[sure], k[sure]
        if not len(k):
            return {}
        order = np.argsort(k, kind="stable")
        at, k = at[order], k[order]
        found, first, times = np.unique(k, return_index=True, return_counts=True)
        many = times * (self.starts[found + 1] - self.starts[found]) > MANY
        parts = [self._few(at, k, np.repeat(~many, times))]
        parts += self._many([(int(x), at[i : i + n]) for x, i, n in zip(found[many], first[many], times[many], strict=True)], len(text))
        keys, of = np.unique(np.concatenate([x for x, _ in parts]), return_inverse=True)
        count = np.bincount(of, np.concatenate([n for _, n in parts]), len(keys))
        item, band = keys >> 32, (keys & 0xFFFFFFFF) - (1 << 31)
        enough = count >= self.needed[item]
        out: dict[int, list[tuple[int, int]]] = {}
        for i, b in zip(item[enough].tolist(), band[enough].tolist(), strict=True):
            edits, runs = int(self.edits[i]), out.setdefault(i, [])
            lo, hi = b * (edits + 1) - edits, b * (edits + 1) + 2 * edits + 2
            if runs and lo <= runs[-1][0] + runs[-1][1]:
                runs[-1] = (runs[-1][0], hi - runs[-1][0])
            else:
                runs.append((lo, hi - lo))
        return out

    def _bands(self, item: np.ndarray, diagonal: np.ndarray, hits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Keys of item and band with their hits; a band overlaps the next, so a hit counts in two."""
        band = diagonal // (self.edits[item] + 1) + (1 << 31)
        keys, of = np.unique(np.concatenate([item << 32 | band, item << 32 | (band - 1)]), return_inverse=True)
        return keys, np.bincount(of, np.concatenate([hits, hits]), len(keys))

    def _few(self, at: np.ndarray, k: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at, k = at[wanted], k[wanted]
        n = self.starts[k + 1] - self.starts[k]
        parts, lo, ends = [(np.zeros(0, np.int64), np.zeros(0))], 0, np.cumsum(n)
        while lo < len(k):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + HITS, "right")))
            m = n[lo:hi]
            each = np.repeat(self.starts[k[lo:hi]] - np.cumsum(m) + m, m) + np.arange(m.sum())
            parts.append(self._bands(self.items[each], np.repeat(at[lo:hi], m) - self.places[each], np.ones(len(each))))
            lo = hi
        return np.concatenate([x for x, _ in parts]), np.concatenate([x for _, x in parts])

    def _many(self, grams_at: list[tuple[int, np.ndarray]], length: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Hits by band of q-grams (number, places in the text) that are often in both: by diagonal, they are a correlation of the places."""
        whole: dict[int, np.ndarray] = {}
        for x, at in grams_at:
            items, places = (v[self.starts[x] : self.starts[x + 1]] for v in (self.items, self.places))
            for i in np.unique(items).tolist():
                own, m = places[items == i], len(self.texts[i])
                size = 1 << (length + m).bit_length()
                one, two = np.zeros(size), np.zeros(size)
                one[at], two[m - own] = 1, 1
                whole[i] = whole.get(i, 0) + np.rint(np.fft.irfft(np.fft.rfft(one) * np.fft.rfft(two), size))
        parts = []
        for i, hits in whole.items():
            some = np.flatnonzero(hits)
            parts.append(self._bands(np.full(len(some), i), some - len(self.texts[i]), hits[some]))
        return parts

    def matches(self, text: bytes) -> list[tuple[int, int, int]]:
        """(item id, place, edits) of the items in a normalized text, each at its best place."""
        out = []
        for i, diagonals in self.regions(text).items():
            if (at := text.find(self.texts[i])) >= 0:
                out.append((self.ids[i], at, 0))
                continue
            k = int(self.edits[i])
            pieces = ((lo, min(hi, lo + WIDE + 2 * k)) for start, width in diagonals for hi in [start + width] for lo in range(start, hi - 2 * k if width > 2 * k else start + 1, WIDE))
            found = min((got for lo, hi in pieces if (got := align(self.texts[i], text, lo, hi - lo, k))), default=None)
            if found:
                out.append((self.ids[i], found[1], found[0]))
        if self.short:
            padded = b" " + text + b" "
            out += [(self.ids[i], at, 0) for i in self.short if (at := padded.find(b" " + self.texts[i] + b" ")) >= 0]
        return sorted(out)


def align(item: bytes, text: bytes, start: int, width: int, most: int) -> tuple[int, int] | None:
    """(edits, place) of the best alignment of all of ``item`` within ``text`` on ``width`` diagonals from ``start``; None above ``most`` edits."""
    lo = max(0, -start)
    padded = np.frombuffer(b"\0" * lo + text[max(0, start) : start + width + len(item)] + b"\0" * (width + len(item)), np.uint8)
    offsets = np.arange(width)
    cost = np.zeros(width, np.int64)
    for i, c in enumerate(item):
        step = cost + (padded[i : i + width] != c)
        step[:-1] = np.minimum(step[:-1], cost[1:] + 1)
        cost = np.minimum.accumulate(step - offsets) + offsets
        if cost.min() > most:
            return None
    best = int(cost.argmin())
    return int(cost[best]), max(0, start + best)


def _blocks(benchmark: DataFrame, key: str, text: str) -> Iterator[list[tuple[int, bytes]]]:
    """The distinct items, in blocks of bounded size, read one partition at a time."""
    block, size = [], 0
    for row in benchmark.select(F.col(key).cast("long"), F.col(text)).where(F.col(text).isNotNull() & F.col(key).isNotNull()).distinct().toLocalIterator():
        if not (t := normal(row[1])):
            continue
        if block and size + len(t) > BLOCK_BYTES:
            yield block
            block, size = [], 0
        block.append((row[0], t))
        size += len(t)
    if block:
        yield block


def _finder(shared: Broadcast, kind: str):
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        index = shared.value
        for b in batches:
            yield pd.Series([[{"item_id": i, "place": p, "edits": e} for i, p, e in index.matches(normal(t))] for t in b])

    return F.pandas_udf(find, kind)


def with_matches(df: DataFrame, benchmark: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text", column: str = "matches", rate: float = RATE) -> DataFrame:
    """``df`` with an array of the benchmark items in each text: (item_id, place, edits), by item.

    A place is a byte of the normalized text. Items of under ``Q`` characters
    have to be there as whole words; longer ones may begin or end within a word.
    All rows and columns stay, but a column named ``column``; a
    null or empty text has an empty array. The work is per row, so nothing is
    shuffled and neither skew nor repeated rows matter; a repetitive text or item
    takes a correlation for each q-gram that is often in both. The index ships to the executors in
    blocks of at most ``BLOCK_BYTES`` of items; for each block beyond the first,
    the table is written and passed over once more. Null or empty items are skipped.
    """
    kind = "array<struct<item_id:long,place:long,edits:long>>"
    out, scratch = df.withColumn(column, F.array().cast(kind)), None
    for block in _blocks(benchmark, item_key, item_text):
        if scratch is not None:
            out = scratch.save(out, "matches")
        scratch = scratch or Scratch(df.sparkSession, "decontaminate")
        shared = df.sparkSession.sparkContext.broadcast(Index.of(block, rate))

        out = out.withColumn(column, F.concat(column, _finder(shared, kind)(F.col(text))))
    return out.withColumn(column, F.array_sort(column))


def drop_contaminated(df: DataFrame, benchmark: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``df`` whose text holds no benchmark item, unchanged."""
    own = fresh(df, "__matches")[0]
    return with_matches(df, benchmark, text, item_key, item_text, own).where(F.size(own) == 0).drop(own)
