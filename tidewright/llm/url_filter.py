"""URL filter: rules by host and path, then a weighted vocabulary found by an Aho-Corasick automaton.

A strict term rejects a URL alone; soft terms reject it when the weights of the
distinct ones that occur reach a limit, which is more than any one of them has. A term counts only between boundaries: the characters before and
after it are not ASCII letters or digits.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER

STRICT = ("casino", "escort", "malware", "phishing", "porn", "spam", "torrent", "viagra", "warez", "xxx")
#: Soft terms with their weights.
SOFT = {
    "adult": 1.0, "bet": 1.0, "bonus": 1.0, "cheap": 1.0, "click": 0.75, "coupon": 0.75, "crypto": 1.0, "deal": 0.75, "farm": 0.75, "free": 1.0, "loan": 1.0, "pills": 1.5, "poker": 1.5, "prize": 1.25, "sexy": 1.5,
    "win": 1.0,
}
SOFT_LIMIT = 2.0
#: Terms of a vocabulary at most: an automaton of so many fits any task.
MAX_TERMS = 200_000
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
ALNUM = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path. Both are empty for null and for a URL without ``://``."""
    start = F.instr(url, "://")
    rest = F.when(start > 0, F.substring(url, start + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits the host or a domain above it and the path's start; nulls if none does."""
    rule = verdict = F
    for what, h, p in sorted(rules, key=lambda r: (-len(r[1]) - len(r[2]), -len(r[1]), r)):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, verdict = rule.when(fits, F.lit(h + p)), verdict.when(fits, F.lit(what))
    return rule, verdict


def vocabulary(terms: DataFrame) -> tuple[tuple[str, ...], dict[str, float]]:
    """(strict, soft) of a table (term, kind, weight) of at most ``MAX_TERMS`` rows, ``kind`` being strict or soft.

    Terms are lower-cased (A-Z); rows with a null or empty term or another kind
    are left out. A soft term without a weight weighs 1; of several weights the
    greatest counts, and a strict term is never soft as well.
    """
    low = ascii_lower(F.col("term")).alias("term")
    kept = terms.select(low, "kind", F.coalesce(F.col("weight").cast("double"), F.lit(1.0)).alias("weight")).where("term <> '' and kind in ('strict', 'soft')")
    rows = kept.groupBy("term").agg(F.bool_or(F.col("kind") == "strict").alias("strict"), F.max("weight").alias("weight")).limit(MAX_TERMS + 1).collect()
    if len(rows) > MAX_TERMS:
        raise ValueError(f"a vocabulary has at most {MAX_TERMS} terms")
    return tuple(sorted(r["term"] for r in rows if r["strict"])), {r["term"]: r["weight"] for r in sorted(rows) if not r["strict"]}


def automaton(strict, soft):
    a = ahocorasick.Automaton()
    for term in {*strict, *soft}:
        a.add_word(term, (term, term in strict))
    a.make_automaton()
    return a


def hits(text: str, a) -> tuple[set[str], set[str]]:
    """Distinct strict and soft terms that stand between boundaries in lower-cased text."""
    found: tuple[set[str], set[str]] = (set(), set())
    for end, (term, is_strict) in a.iter(text):
        start = end - len(term) + 1
        if (start == 0 or text[start - 1] not in ALNUM) and (end + 1 == len(text) or text[end + 1] not in ALNUM):
            found[0 if is_strict else 1].add(term)
    return found


def judge(df: DataFrame, url: str = "url", key: str = "page_id", rules=RULES, strict=STRICT, soft=SOFT, soft_limit: float = SOFT_LIMIT) -> DataFrame:
    """One row per row of ``df``: key, host, path, rule, verdict, strict_hits, soft_hits, soft_weight.

    The verdict is the rule's; without a rule it is ``block`` for one strict term, or
    distinct soft terms (a mapping to weights) of ``soft_limit`` together, else ``allow``. A null URL has no hits
    and is allowed. The work is per row: no shuffle, any length, any skew;
    repeated rows are judged alike and other columns are not read.
    """
    if any(t != t.lower() or not t for t in (*strict, *soft)):
        raise ValueError("terms are lower-case and not empty")
    low = str.maketrans(UPPER, LOWER)

    def count(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        a = automaton(strict, soft)
        for urls in batches:
            got = [hits(u.translate(low), a) if isinstance(u, str) else ((), ()) for u in urls]
            yield pd.DataFrame({"strict": [len(s) for s, _ in got], "soft": [len(s) for _, s in got], "weight": [float(sum(soft[t] for t in sorted(s))) for _, s in got]})

    counted = F.pandas_udf(count, "strict long, soft long, weight double")
    host, path = split_url(F.col(url))
    out = df.select(F.col(key), host.alias("host"), path.alias("path"), counted(F.col(url)).alias("__hits"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules) if rules else (F.lit(None).cast("string"),) * 2
    rejected = (F.col("__hits.strict") >= 1) | (F.col("__hits.weight") >= soft_limit)
    return out.select(
        key, "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(rejected, "block").otherwise("allow")).alias("verdict"),
        F.col("__hits.strict").alias("strict_hits"), F.col("__hits.soft").alias("soft_hits"), F.col("__hits.weight").alias("soft_weight"),
    )
