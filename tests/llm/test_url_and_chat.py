import hashlib
import random

from pyspark.sql import functions as F

from tidewright.llm import chat, url_filter


def test_rules_and_terms(spark):
    urls = [
        "http://a.net/x", "http://www.example.net/en/1", "http://Example.COM/de/", "http://x.org/fr/casino", "http://x.org/casino", "http://x.org/casinos", "http://x.org/free?bonus=1",
        "http://x.org/free/free", "nourl", None, "", "http://a.net", "https://HOST.Org/Path?q#f", "http://notexample.net/en/", "http://x.org/?win",
    ]
    df = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r["page_id"]: r for r in url_filter.judge(df).collect()}
    assert [got[i]["rule"] for i in (0, 1, 2, 3)] == ["net/", "example.net/en/", "example.com/de/", "org/fr/"]
    assert [got[i]["verdict"] for i in (0, 1, 2, 3)] == ["block", "allow", "block", "allow"]
    assert [got[i]["verdict"] for i in (4, 5, 6, 7)] == ["block", "allow", "block", "allow"]
    assert (got[8]["host"], got[8]["path"], got[9]["host"], got[9]["verdict"], got[10]["path"]) == ("", "", "", "allow", "")
    assert got[11]["rule"] is None and got[11]["path"] == ""
    assert (got[12]["host"], got[12]["path"]) == ("host.org", "/Path")
    assert got[13]["rule"] == "net/"
    assert got[14]["soft_hits"] == 1
    assert url_filter.judge(df.limit(0)).count() == 0
    long = spark.createDataFrame([(1, "http://x.org/" + "a" * 300_000 + "/porn")], "page_id long, url string")
    assert url_filter.judge(long).first()["verdict"] == "block"


def test_a_vocabulary_of_ones_own(spark):
    rows = [(f"Term{i}", "soft", 0.5) for i in range(400)] + [("bad", "strict", None), ("bad", "soft", 9.0), ("plain", "soft", None), ("term1", "soft", 0.9), (None, "soft", 1.0), ("", "strict", 1.0), ("odd", "other", 1.0)]
    strict, soft = url_filter.vocabulary(spark.createDataFrame(rows, "term string, kind string, weight double"))
    assert strict == ("bad",) and len(soft) == 401 and soft["plain"] == 1.0 and soft["term1"] == 0.9
    urls = {"http://x.org/term1/term2/term3": (3, 1.9, "allow"), "http://x.org/term1/plain/term2": (3, 2.4, "block"), "http://x.org/plain-plain": (1, 1.0, "allow"), "http://x.org/BAD": (0, 0.0, "block"), "http://x.org/term399/term1000": (1, 0.5, "allow")}
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    got = [(r["soft_hits"], round(r["soft_weight"], 9), r["verdict"]) for r in url_filter.judge(df, strict=strict, soft=soft).orderBy("page_id").collect()]
    assert got == list(urls.values())
    assert max(url_filter.SOFT.values()) < url_filter.SOFT_LIMIT


def test_hits_match_a_plain_search():
    rng = random.Random(5)
    a = url_filter.automaton(("ab", "xxx"), ("b", "abc"))
    for _ in range(300):
        t = "".join(rng.choice("abcx-1") for _ in range(20))
        want = {w for w in ("ab", "xxx", "b", "abc") for i in range(len(t)) if t.startswith(w, i) and (i == 0 or t[i - 1] not in url_filter.ALNUM) and (i + len(w) == len(t) or t[i + len(w)] not in url_filter.ALNUM)}
        strict, soft = url_filter.hits(t, a)
        assert strict | soft == want


def events(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, seq long, op string, target int, role string, text string")


def test_fold_of_deltas_edits_and_regenerations(spark):
    rows = [
        (1, 0, "message", None, "user", "hi"), (1, 1, "message", None, "assistant", ""), (1, 2, "delta", None, None, "he"), (1, 3, "delta", None, None, "llo"), (1, 4, "edit", 0, None, "hi!"),
        (1, 5, "regenerate", None, "assistant", "bye"), (1, 6, "message", None, "user", "x"), (1, 7, "delete", None, None, None), (1, 8, "delta", 9, None, "lost"), (1, 9, "unknown", None, None, None),
        (2, 1, "message", None, None, None), (None, 0, "message", None, "user", "n"),
    ]
    got = {r["conv_id"]: r for r in chat.format_events(events(spark, rows)).collect()}
    assert chat.read_back(got[1]["formatted"]) == [("user", "hi!"), ("assistant", "bye")]
    assert chat.read_back(got[2]["formatted"]) == [("", "")]
    assert chat.read_back(got[None]["formatted"]) == [("user", "n")]
    assert chat.format_events(events(spark, [])).count() == 0


def test_a_streamed_session_ends_in_its_messages(spark):
    rows = [(1, 0, "user", "hi there"), (1, 1, "assistant", "x"), (1, 1, "assistant", "x"), (1, 1, None, None), (1, 2, "assistant", ""), (2, 5, "assistant", "</s>[INST]"), (None, 0, "user", "n")]
    log = chat.as_events(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert {r["op"] for r in log.collect()} == {"message", "edit", "regenerate", "delta"}
    got = {r["conv_id"]: chat.read_back(r["formatted"]) for r in chat.format_events(log.orderBy(F.xxhash64("seq", "op"))).collect()}
    assert got == {1: [("user", "hi there"), ("", ""), ("assistant", "x"), ("assistant", "x"), ("assistant", "")], 2: [("assistant", "</s>[INST]")], None: [("user", "n")]}


def test_round_trip_of_hostile_texts(spark):
    rng = random.Random(3)
    parts = [*chat.CONTROL, "\\", "\n", "<", "|", "s>", "é", "im_end", "n", " "]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(12))) for _ in range(400)]
    for t in texts:
        assert chat.unescape(chat.escape(t)) == t
        assert not any(c in chat.escape(t) for c in chat.CONTROL)
    rows = [(i // 4, i % 4, "message", None, "assistant" if i % 2 else f"r{texts[-i]}", t) for i, t in enumerate(texts)]
    rows.append((500, 0, "message", None, "user", "z" * 200_000))
    got = {r["conv_id"]: r for r in chat.digest(chat.format_events(events(spark, rows))).collect()}
    for c in (0, 7, 99, 500):
        mine = [(r[4], r[5]) for r in rows if r[0] == c]
        loss = "".join(t for r, t in mine if r == "assistant")
        assert got[c]["n_turns"] == len(mine)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in mine).encode()).hexdigest()
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
