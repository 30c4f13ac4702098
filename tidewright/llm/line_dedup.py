"""Line dedup over overlapping windows of three lines.

A line ends at a line break or, as long lines hold whole paragraphs, after the
end of a sentence. Each three consecutive lines that aren't blank are one window,
hashed to 128 bits. A window's first occurrence in the corpus, by (id, text hash,
line), stays; the lines of every later occurrence are covered, and covered lines go.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, fresh
from .components import spread_join

WIDTH = 3
#: What ends a sentence within a line: a stop and white space, or a full-width stop.
STOP = r"[.!?][ \t\x0b\x0c\r]+|[。！？]"
_STOP = re.compile("|".join((r"[.!?][ \t\x0b\x0c\r]+", *"。！？")).encode())


def pieces(text: str) -> list[list[bytes]]:
    """The parts of each line of a text: one, or one for each sentence, with the white space after it."""
    lines = text.encode("utf-8", "surrogatepass").split(b"\n")
    return [_STOP.sub(b"\\g<0>\n", x).split(b"\n") if _STOP.search(x) else [x] for x in lines]


def windows(df: DataFrame, width: int = WIDTH) -> DataFrame:
    """(id, dg, n, h1, h2) from (id, dg, text): the window of the n-th to the (n + width - 1)-th part that isn't blank, and its hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = 16 * width
        for b in batches:
            row, nth, digests = [], [], []
            for r, t in enumerate(b.column(2)):
                if not (text := t.as_py()):
                    continue
                keys = b"".join([xxhash.xxh3_128_digest(k) for line in pieces(text) for x in line if (k := x.strip())])
                n = len(keys) // 16 - width + 1
                if n > 0:
                    row.append(np.full(n, r, np.int64))
                    nth.append(np.arange(n, dtype=np.int32))
                    digests += [xxhash.xxh3_128_digest(keys[i : i + size]) for i in range(0, 16 * n, 16)]
            if row:
                pair, take = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2), pa.array(np.concatenate(row))
                yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array(np.concatenate(nth)), pa.array(pair[:, 0]), pa.array(pair[:, 1])], ["id", "dg", "n", "h1", "h2"])

    return df.mapInArrow(run, f"id {df.schema['id'].dataType.simpleString()}, dg long, n int, h1 long, h2 long")


def covered(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """(id, dg, gone): the parts to remove, by number among those that aren't blank, from the text with hash ``dg`` of document ``id``.

    A later occurrence that overlaps the first one in the same document covers
    only parts outside it, so the first occurrence stays whole. Hashes alone
    tell which windows repeat; very common ones are broadcast to their
    occurrences, and each of those then meets its window's first one by hash and
    document, so a very common window is no single task's work.
    """
    scratch = Scratch(df.sparkSession, "lines")
    rows = df.select(F.col(key).alias("id"), F.xxhash64(text).alias("dg"), F.col(text).alias("text"))
    found = scratch.save(windows(rows, width), "windows")
    repeated = scratch.save(found.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "repeated")
    hits = scratch.save(spread_join(found, repeated, ["h1", "h2"], n="c").drop("c"), "hits")
    first = hits.groupBy("h1", "h2").agg(F.min(F.struct("id", "dg", "n")).alias("f")).select(F.col("h1").alias("f1"), F.col("h2").alias("f2"), F.col("f.id").alias("fid"), F.col("f.dg").alias("fdg"), F.col("f.n").alias("fn"))
    same = (F.col("h1") == F.col("f1")) & (F.col("h2") == F.col("f2")) & (F.col("dg") == F.col("fdg")) & F.col("id").eqNullSafe(F.col("fid"))
    start = F.greatest("n", F.coalesce(F.col("fn") + width, "n"))  # past the first occurrence if that is in the same text
    later = hits.join(first, same, "left").where(F.col("fn").isNull() | (F.col("n") > F.col("fn"))).select("id", "dg", start.alias("lo"), (F.col("n") + width - 1).alias("hi"))
    parts = later.where("lo <= hi").select("id", "dg", F.explode(F.sequence("lo", "hi")).alias("part"))
    gone = scratch.save(parts.groupBy("id", "dg").agg(F.array_sort(F.collect_set("part")).alias("gone")), "gone")
    for used in (found, repeated, hits):
        scratch.forget(used)
    return gone


def without(text: str, gone: np.ndarray) -> str:
    """A text without some of its parts. A line that has no others goes with its line break."""
    left, drop, n = [], set(gone.tolist()), 0
    for line in pieces(text):
        kept, lost = [], False
        for x in line:
            if filled := bool(x.strip()):
                n += 1
            if filled and n - 1 in drop:
                lost = True
            else:
                kept.append(x)
        if not lost or any(x.strip() for x in kept):
            left.append(b"".join(kept))
    return b"\n".join(left).decode("utf-8", "surrogatepass")


def dedup_lines(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """``df`` with ``text`` rid of repeated windows, and the columns n_lines and n_removed (replaced where they are there).

    Lines end at line breaks and after the ends of sentences. Both counts are of
    such lines that aren't blank: n_lines of those there were, n_removed of those
    that went. Every row stays; a text may become shorter or empty. Null texts
    stay null, and have no lines, nor has an empty text. Lines are compared without white space at their
    ends; blank lines are in no window and stay. Repeated rows (the same id and
    text) are one document and get the same text. Rows with a null id come first
    in the order.
    """
    own_id, own_dg, own_gone = fresh(df, "__id", "__dg", "__gone")
    gone = covered(df, key, text, width).select(F.col("id").alias(own_id), F.col("dg").alias(own_dg), F.col("gone").alias(own_gone))
    joined = df.join(gone, F.col(key).eqNullSafe(F.col(own_id)) & (F.xxhash64(text) == F.col(own_dg)), "left")
    parts = F.split(F.regexp_replace(text, f"({STOP})", "$1\n"), "\n")
    lines = F.coalesce(F.size(F.filter(parts, lambda x: F.trim(x, F.lit(" \t\x0b\x0c\r")) != "")), F.lit(0)).cast("long")
    removed = F.when(F.col(own_gone).isNull(), 0).otherwise(F.size(own_gone)).cast("long")

    @F.pandas_udf("string")
    def left(texts: pd.Series, parts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else without(t, p) for t, p in zip(texts, parts)], dtype=object)

    rid = left(F.when(F.col(own_gone).isNotNull(), F.col(text)), F.col(own_gone))
    out = joined.withColumns({"n_lines": lines, "n_removed": removed, text: F.when(F.col(own_gone).isNull(), F.col(text)).otherwise(rid)})
    return out.drop(own_id, own_dg, own_gone)
