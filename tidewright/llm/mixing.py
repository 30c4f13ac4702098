"""Mixing to target weights with soft membership, as DataFrame functions only.

A naive Bayes classifier, fitted on a labelled table, gives each text a posterior
over the domains. Rates of the documents, none below zero, are then fitted by
projected gradient steps so that the expected tokens of each domain meet its
target:

    minimize sum_d (sum_i r_i n_i p_id - T_d)^2 / C_d,  r >= 0,  C_d = sum_i n_i p_id

In the metric that weighs a rate by its document's tokens, a gradient step is
``r_i <- max(0, r_i - sum_d p_id (E_d - T_d) / C_d)`` and a step of one is safe. A rate
depends on its document's posterior and the few residuals so far, so each round
is one aggregate over the posteriors and no rates are stored in between.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, fresh

#: Hash buckets of words, labelled rows fitted on at most, domains at most, words that the evidence of a text comes near to as it gets longer.
BUCKETS, MAX_LABELLED, MAX_DOMAINS, CERTAINTY = 1024, 5000, 64, 24
ROUNDS, CLOSE = 40, 1e-4


#: ASCII white space.
_SPACE = " \t\n\x0b\x0c\r"


def _words(text: str) -> Column:
    """Lower-cased words between runs of white space; one empty word if there is none."""
    return F.split(F.trim(F.translate(F.lower(F.coalesce(F.col(text), F.lit(""))), _SPACE[1:], " " * 5)), " +")


def _bucket(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(BUCKETS)).cast("int")


def fit(labelled: DataFrame, text: str = "text", domain: str = "domain", order: str | None = None, max_labelled: int = MAX_LABELLED) -> tuple[list[str], list[list[float]], list[float]]:
    """(domains, log word weights per domain and bucket, log priors) of a labelled table.

    At most ``max_labelled`` rows are learned from: those with the smallest hash
    of ``order``, or of the text. Rows with a null domain are left out.
    """
    from math import log

    rows = labelled.where(F.col(domain).isNotNull()).withColumn("__h", F.xxhash64(order or text)).orderBy("__h", domain).limit(max_labelled).select(F.col(domain).cast("string").alias("d"), F.col(text).alias("__t"))
    priors = {r["d"]: r["count"] for r in rows.groupBy("d").count().limit(MAX_DOMAINS + 1).collect()}
    if not priors or len(priors) > MAX_DOMAINS:
        raise ValueError(f"between 1 and {MAX_DOMAINS} domains are needed")
    counts = {d: [1.0] * BUCKETS for d in priors}
    # one row per domain and bucket
    for d, b, n in rows.select("d", F.explode(_words("__t")).alias("w")).where("w <> ''").groupBy("d", _bucket(F.col("w")).alias("b")).count().collect():
        counts[d][b] += n
    domains = sorted(priors)
    return domains, [[log(x / sum(counts[d])) for x in counts[d]] for d in domains], [log(priors[d] / sum(priors.values())) for d in domains]


def _log_likelihood(buckets: str, weights: list[float]) -> Column:
    known = F.expr(f"array({','.join(f'{x!r}D' for x in weights)})")  # folded into one literal
    return F.aggregate(buckets, F.lit(0.0), lambda s, b: s + F.get(known, b))


def with_posteriors(df: DataFrame, model, text: str, tokens: str, names: list[str]) -> DataFrame:
    """``df`` with the number of words and a posterior column per domain; texts without words get the priors.

    ``n`` words are the evidence of ``n * CERTAINTY / (n + CERTAINTY)`` ones, which keeps memberships soft.
    """
    domains, weights, priors = model
    found = fresh(df, "__buckets")[0]
    out = df.withColumn(found, F.filter(F.transform(_words(text), lambda w: F.when(w != "", _bucket(w))), lambda b: b.isNotNull()))
    out = out.withColumn(tokens, F.size(found).cast("long"))
    sums = [_log_likelihood(found, w) for w in weights]
    logs = fresh(df, *[f"__log{i}" for i in range(len(domains))])
    out = out.withColumns({c: s * (F.lit(float(CERTAINTY)) / (F.col(tokens) + CERTAINTY)) + F.lit(p) for c, s, p in zip(logs, sums, priors, strict=True)})
    top = F.greatest(*logs) if len(logs) > 1 else F.col(logs[0])
    out = out.withColumns({c: F.exp(F.col(c) - top) for c in logs})
    whole = sum((F.col(c) for c in logs), F.lit(0.0))
    return out.withColumns(dict(zip(names, [F.col(c) / whole for c in logs], strict=True))).drop(found, *logs)


#: Columns that a mix adds.
NEW = ("tokens", "domain", "posterior", "rate", "copies")


def mix(df: DataFrame, model, weights: dict[str, float], text: str = "text", key: str = "doc_id", total: float | str | None = None, least: float = 0.0, rounds: int = ROUNDS) -> DataFrame:
    """``df`` with tokens, domain (the likeliest), posterior (its share), rate and copies.

    ``weights`` gives each domain's share of the mix; one it doesn't name gets
    none. ``total`` is the expected tokens of the mix: a number, ``"same"`` for
    as many as ``df`` has, or by default the least at which no domain shrinks. Rates are ``least`` or more: 0, or 1 where no
    document may go. Rounds end when the totals are met to ``CLOSE``, or change
    no more because of that bound, or after ``rounds``. ``copies`` rounds the rate up or down by a hash of the key, to the rate on average: repeated
    rows have equal copies. Null and empty texts have no tokens and the priors
    as posterior; their rate follows from those. An empty table stays empty. All
    columns of ``df`` stay, but for those with the names of the new ones, which are replaced.
    """
    domains = model[0]
    new = NEW
    df = df.drop(*[c for c in df.columns if c.lower() in new])
    if any(w < 0 for w in weights.values()) or not sum(weights.get(d, 0) for d in domains):
        raise ValueError("weights are not negative, and one of the known domains has more than zero")
    p = fresh(df, *[f"__p{i}" for i in range(len(domains))])
    rows = Scratch(df.sparkSession, "mixing").save(with_posteriors(df, model, text, "tokens", p), "posteriors")

    def expected(rate: Column) -> list[float]:
        got = rows.agg(*[F.coalesce(F.sum(rate * F.col("tokens") * F.col(c)), F.lit(0.0)).alias(f"{c}_sum") for c in p]).first()
        return list(got)

    whole = sum(weights.get(d, 0) for d in domains)
    share = [weights.get(d, 0) / whole for d in domains]
    have = expected(F.lit(1.0))
    want = sum(have) if total == "same" else total if total is not None else max((h / s for h, s in zip(have, share, strict=True) if s), default=0.0)
    target = [want * s for s in share]
    steps: list[list[float]] = []

    def rate() -> Column:
        """The rate after the steps so far, as one fold over them."""
        if not steps:
            return F.lit(1.0)
        known = F.array(*[F.array(*map(F.lit, s)) for s in steps])
        return F.aggregate(known, F.lit(1.0), lambda r, s: F.greatest(F.lit(float(least)), r - sum((F.col(c) * s[i] for i, c in enumerate(p)), F.lit(0.0))))

    now, last = have, None
    for _ in range(rounds):
        step = [(e - t) / h if h else 0.0 for e, t, h in zip(now, target, have, strict=True)]
        still = last and max(abs(a - b) / max(1.0, b) for a, b in zip(now, last, strict=True)) <= CLOSE / 10
        if still or max(map(abs, step)) <= CLOSE * max(1.0, want / max(1.0, sum(have))):
            break
        steps.append(step)
        now, last = expected(rate()), now
    best = F.greatest(*p) if len(p) > 1 else F.col(p[0])
    domain = F.coalesce(*[F.when(F.col(c) == best, F.lit(d)) for c, d in zip(p, domains, strict=True)])
    dice = F.pmod(F.xxhash64(key), F.lit(1 << 30)) / F.lit(float(1 << 30))
    out = rows.withColumns({"domain": domain, "posterior": best, "rate": rate()})
    return out.withColumn("copies", (F.floor("rate") + (dice < F.col("rate") - F.floor("rate")).cast("long")).cast("long")).drop(*p)


def mixed(df: DataFrame, model, weights: dict[str, float], text: str = "text", key: str = "doc_id", total: float | str | None = None, least: float = 0.0) -> DataFrame:
    """The mix itself: each row of ``df`` as often as :func:`mix` says, with the columns of ``df``."""
    aside = {c: n for c, n in zip(df.columns, fresh(df, *[f"__own_{c}" for c in df.columns]), strict=True) if c.lower() in NEW}
    out = mix(df.withColumnsRenamed(aside), model, weights, aside.get(text, text), aside.get(key, key), total, least)
    again = fresh(out, "__copy")[0]
    repeated = out.where("copies > 0").withColumn(again, F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return repeated.select(*[F.col(f"`{aside.get(c, c)}`").alias(c) for c in df.columns])
