import random
import re

import numpy as np
from pyspark.sql import functions as F

from tidewright.llm import decontaminate, hmm, line_dedup, mixing, toxicity


def plain_lines(rows):
    """(id, text) -> text without later windows, by (id, place); ids are distinct here."""
    first, gone = {}, {}
    for i, t in sorted(rows):
        if t is None:
            continue
        lines = [(k, x.strip(" \t\r\x0b\x0c")) for k, x in enumerate(t.split("\n")) if x.strip(" \t\r\x0b\x0c")]
        for n in range(len(lines) - 2):
            key, at = tuple(x for _, x in lines[n : n + 3]), {k for k, _ in lines[n : n + 3]}
            if key in first:
                gone.setdefault(i, set()).update(at - first[key][1] if first[key][0] == i else at)
            else:
                first[key] = (i, at)
    return {i: None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone.get(i, ())) for i, t in rows}, {i: len(gone.get(i, ())) for i, _ in rows}


def test_line_windows(spark):
    rng = random.Random(6)
    rows = [(i, "\n".join(rng.choice(["a", "b", "c", " d ", "", "e"]) for _ in range(rng.randrange(0, 14)))) for i in range(150)]
    rows += [(200, None), (201, ""), (202, "x\n" * 20_000), (203, "p\nq\nr\nextra"), (204, "0\np\nq\nr")]
    df = spark.createDataFrame([(i, t, 1, "clash") for i, t in rows], "doc_id long, text string, n_lines int, __gone string")
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(df).collect()}
    texts, removed = plain_lines(rows)
    assert {i: r["text"] for i, r in got.items()} == texts
    assert {i: r["n_removed"] for i, r in got.items()} == removed
    assert got[204]["text"] == "0" and got[203]["text"] == "p\nq\nr\nextra" and got[200]["n_lines"] == 0
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0
    twice = spark.createDataFrame([(1, "a\nb\nc"), (1, "a\nb\nc"), (None, "a\nb\nc")], "doc_id long, text string")
    assert sorted(str(r["doc_id"]) + r["text"] for r in line_dedup.dedup_lines(twice).collect()) == ["1", "1", "Nonea\nb\nc"]


def plain_sentences(rows):
    """id -> (text without later windows, parts removed), where lines also end after sentences; ids are distinct here."""
    first, gone, cut = {}, {}, {}
    for i, t in sorted(rows):
        cut[i] = [re.findall(r".*?(?:[.!?][ \t]+|[。！？])|.+", x) for x in t.split("\n")]
        flat = [(k, j) for k, line in enumerate(cut[i]) for j, x in enumerate(line) if x.strip()]
        for n in range(len(flat) - 2):
            at = flat[n : n + 3]
            seen = first.setdefault(tuple(cut[i][k][j].strip() for k, j in at), (i, at))
            if seen != (i, at):
                gone.setdefault(i, set()).update(set(at) - set(seen[1] if seen[0] == i else ()))
    out = {}
    for i, _ in rows:
        left = [([x for j, x in enumerate(line) if (k, j) not in gone.get(i, ())], len(line)) for k, line in enumerate(cut[i])]
        out[i] = ("\n".join("".join(kept) for kept, n in left if len(kept) == n or any(x.strip() for x in kept)), len(gone.get(i, ())))
    return out


def test_windows_within_long_lines(spark):
    rng = random.Random(16)
    rows = [(i, "".join(rng.choice(["a", "b. ", "c! ", "d?", "e.", " f ", "\n", "g。", "\n\n", "h. \n"]) for _ in range(rng.randrange(0, 30)))) for i in range(200)]
    rows += [(300, "x. " * 20_000), (301, "one. two. three. four."), (302, "zero one. two. three. four. five")]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert {r["doc_id"]: (r["text"], r["n_removed"]) for r in got.collect()} == plain_sentences(rows)
    parts = {i: sum(bool(x.strip()) for line in t.split("\n") for x in re.findall(r".*?(?:[.!?][ \t]+|[。！？])|.+", line)) for i, t in rows}
    assert {r["doc_id"]: r["n_lines"] for r in got.collect()} == parts
    twice = line_dedup.dedup_lines(spark.createDataFrame([(i, "One. Two. Three. Four. Five.") for i in (1, 2)], "doc_id long, text string"))
    assert sorted((r["n_lines"], r["n_removed"]) for r in twice.collect()) == [(5, 0), (5, 5)]
    # a passage of more than fifty words in one line, started in mid-line elsewhere
    passage = " ".join(f"Word {i} of it stands here and says little about things." for i in range(6))
    rows = [("a", "Before it " + passage + " After it."), ("b", passage + "\nIts own end."), ("c", "Nothing. In. Common.")]
    left = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    assert left == {"a": rows[0][1], "b": passage[: passage.index("Word 1")] + "\nIts own end.", "c": rows[2][1]}


def edit_distance_within(item: bytes, text: bytes) -> int:
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        prev, row[0] = row[0], i
        for j, d in enumerate(text, 1):
            prev, row[j] = row[j], min(prev + (c != d), row[j] + 1, row[j - 1] + 1)
    return min(row)


def test_items_are_found_within_the_budget(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 8)))
    items = [" ".join(word() for _ in range(rng.randrange(12, 40))) for _ in range(12)] + ["tiny one", "", None, "!?"]
    docs = []
    for _ in range(60):
        text, k = " ".join(word() for _ in range(60)), rng.randrange(12)
        item = list(items[k])
        for _ in range(rng.randrange(0, 2 + len(item) // 12)):
            at, how = rng.randrange(len(item)), rng.randrange(3)
            item[at : at + 1] = [] if how == 0 else [rng.choice("klm")] if how == 1 else [item[at], rng.choice("klm")]
        docs.append(text[:100] + " " + "".join(item).upper().replace(" ", ",\n ") + " " + text[100:])
    docs += ["a tiny one here", "a tiny onehere", "", None, items[0] * 300]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(docs)], "doc_id long, text string, matches int")
    bench = spark.createDataFrame([(i, t, t) for i, t in enumerate(items)], "item_id long, text string, doc_id string")
    got = {r["doc_id"]: {m["item_id"]: m["edits"] for m in r["matches"]} for r in decontaminate.with_matches(df, bench).collect()}
    for d, t in enumerate(docs[:64]):
        n, want = decontaminate.normal(t), {}
        for i, x in enumerate(items[:12]):
            m = decontaminate.normal(x)
            if n and (e := edit_distance_within(m, n)) <= min(int(len(m) * decontaminate.RATE), (len(m) - decontaminate.Q) // decontaminate.Q):
                want[i] = e
        if "a tiny one here" == t:
            want[12] = 0
        assert got[d] == want, d
    assert 0 in got[len(docs) - 1] and sum(bool(v) for v in got.values()) > 20
    clean = decontaminate.drop_contaminated(df, bench)
    assert clean.columns == df.columns and clean.count() == sum(not v for v in got.values())
    assert decontaminate.with_matches(df.limit(0), bench).count() == 0
    assert decontaminate.with_matches(df, bench.limit(0)).where("size(matches) > 0").count() == 0


def test_blocks_of_items_give_the_same(spark, monkeypatch):
    items = [f"item number {i} says something quite long about topic {i * 7} and ends with {i}" for i in range(6)]
    df = spark.createDataFrame([(i, f"before {t} after") for i, t in enumerate(items)], "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 150)
    found = lambda: {r["doc_id"]: [(m["item_id"], m["edits"]) for m in r["matches"]] for r in decontaminate.with_matches(df, bench).collect()}
    blocks = found()
    monkeypatch.undo()
    assert blocks == found() and all(i in dict(blocks[i]) for i in range(6))


def test_repetitive_texts_take_time_in_proportion():
    import time

    cases = [
        ("ha " * 600, "ha " * 8000, 0), ("ha " * 600, ("ha " * 300 + "hx ") * 27, 1), ("ha " * 600, "ho ha " * 170_000, None),
        ("abc def ghi jkl mno " * 30, "abc def ghi jkl mnp " * 5000, None), ("to be or not to be " * 4, "to be or not to be" + " x" * 30 + " to be or not to bee" * 4, 3),
    ]
    for item, text, edits in cases:
        index = decontaminate.Index.of([(1, decontaminate.normal(item))])
        start = time.perf_counter()
        got = index.matches(decontaminate.normal(text))
        assert time.perf_counter() - start < 10
        assert [e for _, _, e in got] == ([] if edits is None else [edits]), (item[:20], got)


def test_counts_by_correlation_are_those_of_all_hits(monkeypatch):
    rng = random.Random(5)
    items = [(i, " ".join(rng.choice(["ab", "ba", "abab"]) for _ in range(30)).encode()) for i in range(3)]
    index = decontaminate.Index.of(items)
    for _ in range(20):
        text = " ".join(rng.choice(["ab", "ba", "abab", "c"]) for _ in range(200)).encode()
        monkeypatch.setattr(decontaminate, "MANY", 10**9)
        monkeypatch.setattr(decontaminate, "HITS", 500)
        want = index.regions(text)
        monkeypatch.setattr(decontaminate, "MANY", 3)
        assert index.regions(text) == want


def plain_forward(model, syms):
    a, total = None, 0.0
    for s in syms:
        a = model.start * model.emit[s] if a is None else (a @ model.move) * model.emit[s]
        total += np.log10(a.sum())
        a = a / a.sum()
    return total


def test_forward_and_counts_match_plain_recursions():
    rng = np.random.default_rng(1)
    m = hmm.Hmm.first(rng.dirichlet(np.ones(20)), 3)
    m.move = rng.dirichlet(np.ones(3), 3)
    m.start, m.inner = rng.dirichlet(np.ones(3)), rng.dirichlet(np.ones(3))
    texts = [rng.integers(0, 20, n) for n in (1, 7, 7, 30, 2)]
    assert np.allclose(m.forward(texts), [plain_forward(m, t) for t in texts])
    # expected counts against sums over all paths
    import itertools

    seq = rng.integers(0, 20, 5)
    paths = {p: m.start[p[0]] * np.prod([m.move[a, b] for a, b in zip(p, p[1:])]) * np.prod([m.emit[s, k] for s, k in zip(seq, p)]) for p in itertools.product(range(3), repeat=5)}
    whole = sum(paths.values())
    emitted, moves, start, inner = m.expected(np.concatenate([seq[:, None], np.r_[seq[:3], 0, 0][:, None]], axis=1), np.array([5, 3]), np.array([True, False]))
    alone = m.expected(seq[:, None], np.array([5]), np.array([True]))
    for k in range(3):
        assert np.isclose(alone[2][k], sum(v for p, v in paths.items() if p[0] == k) / whole)
        for s in set(seq.tolist()):
            assert np.isclose(alone[0][s, k], sum(v * sum(a == k and x == s for a, x in zip(p, seq)) for p, v in paths.items()) / whole)
        for j in range(3):
            assert np.isclose(alone[1][k, j], sum(v * sum((a, b) == (k, j) for a, b in zip(p, p[1:])) for p, v in paths.items()) / whole)
    assert np.isclose(emitted.sum(), 8)
    assert np.isclose(inner.sum(), 1)


def test_long_texts_go_in_parts(monkeypatch):
    """Counts and scores of texts in parts are those of whole texts, in no more steps than a part has tokens."""
    rng = np.random.default_rng(4)
    m = hmm.Hmm.first(rng.dirichlet(np.ones(20)), 3)
    m.move, m.start = rng.dirichlet(np.ones(3), 3), rng.dirichlet(np.ones(3))
    texts = [rng.integers(0, 20, n) for n in (1, 40, 8, 9, 16, 17, 100, 3)]

    def counted():
        parts, nth = hmm._cut(texts)
        assert np.array_equal(np.concatenate(parts), np.concatenate(texts)) and (nth == 0).sum() == len(texts)
        before, after = m.edges(parts, nth)
        got = [(m.expected(pieces, lengths, nth[at] == 0, before[:, at], after[:, at]), len(pieces)) for at, pieces, lengths in hmm._padded(parts)]
        return [sum(g[i] for g, _ in got) for i in range(3)], max(n for _, n in got)

    want, steps = counted()
    assert steps == 100 and np.isclose(want[0].sum(), sum(map(len, texts))) and np.isclose(want[1].sum(), sum(len(t) - 1 for t in texts))
    monkeypatch.setattr(hmm, "LONG", 8)
    monkeypatch.setattr(hmm, "PART", 5)
    monkeypatch.setattr(hmm, "CELLS", 60)
    got, steps = counted()
    assert steps == 8 and all(np.allclose(a, b) for a, b in zip(got, want, strict=True))
    assert np.allclose(m.forward(texts), [plain_forward(m, t) for t in texts])


def test_scores(spark):
    import math
    import zlib
    from collections import Counter

    rng = random.Random(3)
    a, b = [f"a{i}" for i in range(30)], [f"b{i}" for i in range(30)]
    texts = [" ".join(rng.choice(v) for _ in range(rng.randrange(1, 60))) for v in (a, b) for _ in range(60)] + ["", None, "  ", "unseen words only", "A1 a1\x0bA1", "long " * 5000]
    rows = list(enumerate(texts)) + [(3, texts[3]), (None, "a1 b1")]
    df = spark.createDataFrame([(i, t, 1.0) for i, t in rows], "doc_id long, text string, score double")
    got = hmm.score(df, states=2, rounds=4).collect()
    assert len(got) == len(rows)
    tokens = lambda t: [*(t or "").encode().lower().split(), None]
    counts: Counter = Counter()
    for i, t in rows:
        if i is not None and zlib.crc32(str(i).encode()) % 10 != 0:
            counts.update(tokens(t))
    n, v = sum(counts.values()), len(counts)
    by_id = {r["doc_id"]: r for r in got}
    for i, t in rows:
        r, w = by_id[i], tokens(t)
        assert r["train_tokens"] == n and r["n_tokens"] == len(w) and r["n_known"] == sum(x in counts for x in w)
        assert r["held_out"] == (i is None or zlib.crc32(str(i).encode()) % 10 == 0)
        assert math.isclose(r["base_score"], sum(math.log10((counts[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), rel_tol=1e-9)
        assert r["score"] < 0 and math.isfinite(r["score"])
    held = [r for r in got if r["held_out"] and r["n_tokens"] > 5 and r["n_known"] > 5]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    assert hmm.score(df.limit(0)).count() == 0


def test_rare_words_have_emissions_of_their_own(spark):
    """80,000 words of one class, each in four texts of one topic: held-out texts of such words alone follow the topic."""
    rng = random.Random(12)
    rows, k = [], 0
    for topic in "ab":
        rare = [f"qq{topic}{i}zz" for i in range(40_000)] * 4
        rng.shuffle(rare)
        for lo in range(0, len(rare), 200):
            rows.append((k, " ".join(w for x in rare[lo : lo + 200] for w in (x, *([f"{topic}{rng.randrange(20)}"] if rng.random() < 0.4 else []))), True))
            k += 1
        rows += [(k + i, " ".join(rng.choice(rare) for _ in range(200)), False) for i in range(5)]
        k += 5
    df = spark.createDataFrame(rows, "doc_id long, text string, train boolean")
    got = [r for r in hmm.score(df, states=2, train_on=F.col("train")).collect() if r["held_out"]]
    gain = sum(r["score"] - r["base_score"] for r in got) / sum(r["n_tokens"] for r in got)
    assert len(got) == 10 and gain > 0.25, gain


def plain_model(texts, states, rounds):
    """Baum-Welch over raw words: (emission of a word's code, start, move), one text after the other."""
    from collections import Counter

    counts = Counter(c for t in texts for c in t)
    known = np.array(sorted(counts))
    at = {c: i for i, c in enumerate(known.tolist())}
    weight = np.array([counts[c] + hmm.ADD for c in known.tolist()])
    mass = sum(counts.values()) + hmm.ADD * (len(counts) + hmm.CLASSES)
    emit = weight[:, None] * np.exp(0.7 * hmm._noise(known, states))
    sums = emit.sum(0) + hmm.ADD * hmm.CLASSES
    first = True
    start, move = np.full(states, 1 / states), np.full((states, states), 0.05 / (states - 1))
    np.fill_diagonal(move, 0.95)
    for _ in range(rounds):
        p, total, moves, starts = emit / sums, np.zeros(emit.shape), np.zeros(move.shape), np.zeros(states)
        for t in texts:
            o = p[[at[c] for c in t]]
            alpha, beta = np.zeros(o.shape), np.ones(o.shape)
            for i in range(len(t)):
                alpha[i] = (start if i == 0 else alpha[i - 1] @ move) * o[i]
                alpha[i] /= alpha[i].sum()
            for i in range(len(t) - 2, -1, -1):
                beta[i] = move @ (o[i + 1] * beta[i + 1])
                beta[i] /= beta[i].sum()
                both = alpha[i][:, None] * move * (o[i + 1] * beta[i + 1])[None]
                moves += both / both.sum()
            gamma = alpha * beta
            gamma /= gamma.sum(1, keepdims=True)
            np.add.at(total, [at[c] for c in t], gamma)
            starts += gamma[0]
        emit, first = total + hmm.SHARED / mass * weight[:, None], False
        sums = emit.sum(0) + hmm.SHARED / mass * hmm.ADD * hmm.CLASSES
        start, move = (starts + 1) / (starts + 1).sum(), (moves + 1) / (moves + 1).sum(1, keepdims=True)
    unseen = hmm.ADD * (1 if first else hmm.SHARED / mass)
    return lambda c: emit[at[c]] / sums if c in at else np.full(states, unseen) / sums, start, move


def plain_score(model, text):
    emission, start, move = model
    total, a = 0.0, None
    for c in text:
        a = (start if a is None else a @ move) * emission(c)
        total += np.log10(a.sum())
        a = a / a.sum()
    return total


def test_scores_are_those_of_a_plain_training(spark):
    rng = random.Random(31)
    words = [f"w{i}" for i in range(25)]
    rows = [(i, " ".join(rng.choice(words[:15] if i % 2 else words[10:]) for _ in range(rng.randrange(0, 40))), i % 5 != 0) for i in range(40)]
    rows += [(100, "never seen these", False), (101, None, True), (102, "w1 " * 300, True)]
    got = {r["doc_id"]: r["score"] for r in hmm.score(spark.createDataFrame(rows, "doc_id long, text string, train boolean"), states=3, rounds=3, train_on=F.col("train")).collect()}
    codes = hmm.WordCode()
    texts = {i: codes.of(t).tolist() for i, t, _ in rows}
    model = plain_model([texts[i] for i, _, y in rows if y], 3, 3)
    for i, _, _ in rows:
        assert abs(got[i] - plain_score(model, texts[i])) <= 2e-4 * abs(got[i]), (i, got[i], plain_score(model, texts[i]))


def test_emissions_of_each_state_sum_to_one(spark):
    """All known words, and one place for unseen words in each class."""
    texts = [[5, 9, 9, hmm.END], [9, 7, hmm.END]]
    emission, start, move = plain_model(texts, 2, 2)
    known = sum(emission(c) for c in (5, 7, 9, hmm.END))
    assert np.allclose(known + hmm.CLASSES * emission(-1), 1) and np.allclose(move.sum(1), 1) and np.isclose(start.sum(), 1)


def test_decoding_of_disguised_words():
    model = toxicity.CharModel.of(np.zeros(toxicity.SYMBOLS**3))
    rng = random.Random(1)
    counts = np.zeros((toxicity.SYMBOLS,) * 3)
    for _ in range(2000):
        t = [0, *[toxicity.symbol(c) for c in rng.choice(["idiot", "moron", "trash", "hello", "world", "loser"])], 0]
        for x in zip(t, t[1:], t[2:]):
            counts[x] += 1
    model = toxicity.CharModel.of(counts.ravel())
    r = toxicity.Restorer(model)
    assert [r(w) for w in ("1d10t", "m0r0n!!", "tr@sh", "l.o.s.e.r", "idiooooot", "hello,", "WORLD".lower())] == ["idiot", "moron", "trash", "loser", "idiot", "hello", "world"]
    assert r.words("you i d i o t now")["idiot"] == 1
    assert r("9233a8ecf7c5b09fe5949719b6b82bc439e9329b9233") and r("***") == ""


def test_stretched_and_sign_heavy_tokens_are_decoded():
    rng = random.Random(1)
    counts = np.zeros((toxicity.SYMBOLS,) * 3)
    for _ in range(2000):
        t = [0, *[toxicity.symbol(c) for c in rng.choice(["idiot", "moron", "asshole", "hello", "bad"])], 0]
        for x in zip([0, *t], t, t[1:]):
            counts[x] += 1
    model = toxicity.CharModel.of(counts.ravel())
    r = toxicity.Restorer(model)
    assert [r(w) for w in ("idi" + "o" * 40 + "t", "@$$h0l3", "m" * 30 + "0r0n")] == ["idiot", "asshole", "moron"]
    assert r.words("so b a d here")["bad"] == r.words("you i  d  i  o  t now")["idiot"] == 1
    assert r.words("b a d  i d i o t")["idiot"] == r.words("b a d  i d i o t")["bad"] == 1
    assert r("9233a8ecf7c5b09fe5949719b6b82bc439e9329b9233") == "9233a8ecf7c5b09fe5949719b6b82bc439e9329b9233" and r("1234567q") == "1234567q"
    assert toxicity.decode("m0r0n" * 20_000, model) == "moron" * 20_000


def plain_viterbi(token, model):
    """The best reading by trying all of them."""
    import itertools

    best = None
    for combo in itertools.product(*toxicity.lattice(token)):
        word, s, x, y = "".join(t for t, _ in combo), sum(c for _, c in combo), 0, 0
        for c in word:
            s += model.logp[x, y, toxicity.symbol(c)]
            x, y = y, toxicity.symbol(c)
        s += model.logp[x, y, 0]
        best = max(best or (s, word), (s, word))
    return best[1]


def test_viterbi_is_exact():
    rng = np.random.default_rng(2)
    model = toxicity.CharModel.of(rng.integers(0, 50, toxicity.SYMBOLS**3).astype(float))
    for token in ("1d10t", "aaab1", "5$$x", "s7up1d", "ééé0", "a+1|b", "0"):
        assert toxicity.decode(token, model) == plain_viterbi(token, model)


def test_toxicity_learns_and_reads_through_disguise(spark):
    rng = random.Random(4)
    words = ["river", "stone", "light", "paper", "green", "walk", "table", "music"]
    docs = []
    for i in range(240):
        t = [rng.choice(words) for _ in range(20)]
        bad = i % 4 == 0
        if bad:
            t[3], t[9] = rng.choice(["idiot", "moron"]), rng.choice(["1d10t", "m0ron", "i.d.i.o.t"])
        docs.append((i, " ".join(t), int(bad)))
    documents = spark.createDataFrame([(i, t) for i, t, _ in docs] + [(900, None), (901, ""), (902, "idiot " * 30_000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in docs] + [(None, 1, 1), (5, None, None), (7777, 1, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(documents, labels.where(~toxicity.held_out()))
    probes = documents.unionByName(spark.createDataFrame([(1000, "river stone m 0 r 0 n light"), (1001, "river stone light")], "doc_id long, text string")).withColumn("score", documents.doc_id * 0)
    got = {r["doc_id"]: r["score"] for r in toxicity.with_score(probes, model).collect()}
    assert all((got[i] >= 0.3) == bool(y) for i, _, y in docs)
    assert got[902] >= 0.3 and got[900] == got[901] < 0.3 and got[1001] < 0.3
    assert toxicity.drop_toxic(documents, model).count() == 240 - 60 + 2
    flat = toxicity.fit(documents, labels.limit(0))
    assert len({r["score"] for r in toxicity.with_score(documents, flat).collect()}) == 1
    assert toxicity.with_score(documents.limit(0), model).count() == 0


def test_the_driver_fits_without_a_copy_of_the_features():
    import tracemalloc

    import numpy as np

    rng = np.random.default_rng(5)
    x = rng.random((1500, 800), np.float32)
    y = (x[:, 0] > 0.5).astype(np.float32)
    tracemalloc.start()
    w, _ = toxicity.logistic(x, y, rounds=20)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < x.nbytes / 4 and len(w) == 800 and w.argmax() == 0


def test_toxicity_scores_by_hand(spark, sf_dir):
    """Features and the logistic value of texts of plain words, to nine places."""
    import math
    from collections import Counter

    from tidewright.llm.common import table

    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").where(~toxicity.held_out()))
    rng = random.Random(8)
    plain = sorted(w for w in model.weights if w.isalpha() and w.isascii()) + ["riverside", "an", "unheard", "meadowlarks"]
    starts = sorted(f[:-1] for f in model.weights if f.endswith("*"))
    tails = ["arm", "bell", "down", "s"]
    pool = [w for w in plain + [p + t for p in starts for t in tails] if not re.search(r"(.)\1\1", w)]
    texts = [" ".join(rng.choice(pool) for _ in range(rng.randrange(1, 60))) for _ in range(60)]
    assert model.weights and starts
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in toxicity.with_score(df, model).collect():
        words = r["text"].lower().split()
        found = Counter(words) + Counter(f"{w[:5]}*" for w in words if len(w) > 5) + Counter(f"{w[:7]}*" for w in words if len(w) > 7)
        z = model.bias + sum(model.weights[f] * math.log1p(100 * n / len(words)) for f, n in found.items() if f in model.weights)
        assert abs(r["score"] - 1 / (1 + math.exp(-z))) < 1e-9


def test_mix_meets_its_targets(spark):
    rng = random.Random(9)
    vocabulary = {"x": [f"x{i}" for i in range(50)], "y": [f"y{i}" for i in range(50)]}
    docs = [(i, " ".join(rng.choice(vocabulary[d]) for _ in range(rng.randrange(5, 40))), d) for i, d in enumerate("x" * 150 + "y" * 50)]
    labelled = spark.createDataFrame(docs + [(999, "x1", None)], "doc_id long, text string, domain string")
    df = spark.createDataFrame([(i, t, "own") for i, t, _ in docs] + [(900, None, "n"), (901, "", "e"), (0, docs[0][1], "again")], "doc_id long, text string, tokens string")
    model = mixing.fit(labelled, order="doc_id")
    out = mixing.mix(df, model, {"x": 0.5, "y": 0.5}).collect()
    assert len(out) == len(docs) + 3 and all(r["rate"] >= 0 for r in out)
    total = {d: sum(r["rate"] * r["tokens"] for r in out if r["domain"] == d) for d in "xy"}
    assert abs(total["x"] / total["y"] - 1) < 0.02
    assert all(r["domain"] == d for r in out if r["doc_id"] < 200 for d in [docs[r["doc_id"]][2]])
    assert {r["tokens"] for r in out if r["doc_id"] >= 900} == {0}
    half = {r["doc_id"]: r for r in mixing.mix(df, model, {"x": 1.0}, total=500.0).collect()}
    assert abs(sum(r["rate"] * r["tokens"] * (r["posterior"] if r["domain"] == "x" else 1 - r["posterior"]) for r in half.values()) - 500) < 80
    mixed = mixing.mixed(df, model, {"x": 0.5, "y": 0.5}, least=1.0)
    assert mixed.columns == df.columns and {r["tokens"] for r in mixed.select("tokens").distinct().collect()} == {"own", "n", "e", "again"}
    assert {r["doc_id"] for r in mixed.collect()} == {i for i, _, _ in docs} | {900, 901}
    assert mixing.mix(df.limit(0), model, {"x": 1.0}).count() == 0


def test_posteriors_are_those_of_a_plain_naive_bayes(spark):
    import math

    labelled = spark.createDataFrame([("red red blue", "p"), ("green blue", "q"), ("green green sky", "q")], "text string, domain string")
    domains, weights, priors = model = mixing.fit(labelled)
    text = "\t red\n sky \x0b unknown  "
    got = mixing.mix(spark.createDataFrame([(1, text)], "doc_id long, text string"), model, {"p": 1.0, "q": 1.0}).first()
    bucket = {r["w"]: r["b"] for r in spark.createDataFrame([(w,) for w in text.split()], "w string").select("w", mixing._bucket(F.col("w")).alias("b")).collect()}
    n = len(text.split())
    logs = [p + sum(w[bucket[x]] for x in text.split()) * mixing.CERTAINTY / (n + mixing.CERTAINTY) for w, p in zip(weights, priors)]
    whole = [math.exp(x - max(logs)) for x in logs]
    assert math.isclose(got["posterior"], max(whole) / sum(whole), rel_tol=1e-9)
    assert got["domain"] == domains[logs.index(max(logs))]


def plain_rates(n, p, target, least):
    """The same problem's rates after very many plain projected gradient steps."""
    rate, have = np.ones(len(n)), p.T @ n
    for _ in range(5000):
        rate = np.maximum(least, rate - 0.5 * p @ ((p.T @ (n * rate) - target) / have))
    return rate


def test_rates_are_those_of_a_plain_solver_with_the_bound_active(spark):
    rng = random.Random(31)
    docs = [(i, " ".join(f"{rng.choice('xyz' if i % 4 == 0 else 'xyz'[i % 3])}{rng.randrange(40)}" for _ in range(rng.randrange(3, 60)))) for i in range(160)]
    labelled = spark.createDataFrame([(i, t, "xyz"[i % 3]) for i, t in docs if i % 4], "doc_id long, text string, domain string")
    model, df = mixing.fit(labelled, order="doc_id"), spark.createDataFrame(docs, "doc_id long, text string")
    names = ["px", "py", "pz"]
    known = {r["doc_id"]: r for r in mixing.with_posteriors(df, model, "text", "tokens", names).collect()}
    n, p = np.array([known[i]["tokens"] for i, _ in docs], float), np.array([[known[i][c] for c in names] for i, _ in docs])
    assert n.tolist() == [len(t.split()) for _, t in docs] and np.allclose(p.sum(1), 1)
    for weights, least in (({"x": 0.97, "y": 0.03}, 0.0), ({"x": 0.5, "y": 0.3, "z": 0.2}, 0.8)):
        share = np.array([weights.get(d, 0.0) for d in "xyz"])
        target = share * n.sum()
        got = {r["doc_id"]: r["rate"] for r in mixing.mix(df, model, weights, total="same", least=least, rounds=150).collect()}
        rates = np.array([got[i] for i, _ in docs])
        want = plain_rates(n, p, target, least)
        assert (rates >= least).all()
        assert np.allclose(p.T @ (n * rates), p.T @ (n * want), atol=5e-3 * n.sum())
    assert (plain_rates(n, p, np.array([0.97, 0.03, 0.0]) * n.sum(), 0.0) == 0).any()


def test_numbers_of_a_round_travel_in_two_bytes():
    """And a chunk's first emissions take no more memory than a few times their own size."""
    import tracemalloc

    x = np.concatenate([[0, 1e-30], np.random.default_rng(1).lognormal(0, 8, 100_000), [1e9]])
    got = hmm._unpacked(hmm._packed(x))
    assert hmm._packed(x).nbytes == 2 * len(x) and got[0] == got[1] == 0 and np.all(abs(got[2:] - x[2:]) <= x[2:] / 1024)
    codes = np.sort(np.random.default_rng(2).integers(0, 1 << 62, 100_000))
    tracemalloc.start()
    noise = hmm._noise(codes, 8)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 3 * noise.nbytes and np.array_equal(noise[-5:], hmm._noise(codes[-5:], 8))
