import zlib

from tidewright.llm import sharding


def plain_jump(key: int, n: int) -> int:
    key %= 1 << 64
    last, at = -1, 0
    while at < n:
        last = at
        key = (key * sharding.MULTIPLIER + 1) % (1 << 64)
        at = int((last + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return last


def test_jump_hash_is_the_published_one(spark):
    keys = [0, 1, 2, 17, 10**12, 2**63 - 1, -1, -5]
    for n in (1, 2, 8, 9, 200):
        got = {r["k"]: r["shard"] for r in sharding.with_shard(spark.createDataFrame([(k,) for k in keys], "k long"), "k", n).collect()}
        assert got == {k: plain_jump(k, n) for k in keys}


def test_a_new_shard_takes_rows_only_into_itself(spark):
    out = sharding.assign(spark.range(5000).selectExpr("id AS doc_id", "'x' AS text"), shards=8).collect()
    moved = [r for r in out if r["shard"] != r["grown_shard"]]
    assert all(r["grown_shard"] == 8 for r in moved) and 400 < len(moved) < 720
    sizes = [sum(r["shard"] == s for r in out) for s in range(8)]
    assert min(sizes) > 500
    for s in range(8):
        assert sorted(r["slot"] for r in out if r["shard"] == s) == list(range(sizes[s]))


def test_edge_rows(spark):
    rows = [(1, "é", "a"), (1, "é", "a"), (None, None, None), (2, "", "b"), (3, "y" * 100_000, None)]
    out = sharding.assign(spark.createDataFrame(rows, "doc_id long, text string, size string"))
    got = sorted((r["doc_id"] or 0, r["size"], r["text_crc32"]) for r in out.collect())
    want = sorted((d or 0, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, _ in rows)
    assert got == want
    assert sharding.assign(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    text_keys = sharding.assign(spark.createDataFrame([("a", "x"), ("b", "y")], "doc_id string, text string"))
    assert {r["law"] for r in text_keys.collect()} == {"key"}


def test_written_shards(spark, tmp_path):
    df = spark.range(200).selectExpr("id AS doc_id", "'x' AS text")
    sharding.write_shards(df, str(tmp_path / "out"), shards=4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 200
    assert {(r["doc_id"], r["shard"]) for r in back.collect()} == {(i, plain_jump(i, 4)) for i in range(200)}
