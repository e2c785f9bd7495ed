"""Shards against plain recursive splitting."""

import hashlib

from rainrisk.llm import sharding

SCHEMA = "doc_id long, text string, shard string"


def plain(rows, limit):
    bits = {i: bin(int(hashlib.md5(str(i).encode()).hexdigest(), 16))[2:].zfill(128) for i, _ in rows}
    size = {i: len((t or "").encode()) for i, t in rows}

    def split(ids, prefix):
        if sum(size[i] for i in ids) <= limit or len(ids) == 1:
            return dict.fromkeys(ids, prefix)
        out = {}
        for b in "01":
            own = [i for i in ids if bits[i][len(prefix)] == b]
            out |= split(own, prefix + b) if own else {}
        return out

    return split(list(size), ""), size


def test_same_as_splitting(spark):
    rows = [(i, ("é" if i % 3 else "x") * (i * 37 % 400)) for i in range(500)] + [(900, "y" * 5000), (901, None), (902, "")]
    want, size = plain(rows, 2000)
    got = sharding.sharded(spark.createDataFrame([(*r, "s") for r in rows], SCHEMA), limit=2000).collect()
    assert {r["doc_id"]: r["shard"] for r in got} == want and all(r["depth"] == len(r["shard"]) and r["n_bytes"] == size[r["doc_id"]] for r in got)
    for r in got:
        assert r["shard_bytes"] == sum(size[i] for i, s in want.items() if s == r["shard"])
        assert r["shard_bytes"] <= 2000 or sum(s == r["shard"] for s in want.values()) == 1


def test_repeated_and_null_keys_still_split(spark):
    rows = [(1, "a" * 100, None)] * 60 + [(None, "b" * 100, None)] * 60
    got = sharding.sharded(spark.createDataFrame(rows, SCHEMA), limit=1000).collect()
    assert len(got) == 120 and max(r["shard_bytes"] for r in got) <= 1000


def test_written_shards(spark, tmp_path):
    docs = spark.createDataFrame([(i, "z" * 50, "old") for i in range(100)], SCHEMA).drop("shard")
    sharding.write_shards(docs, str(tmp_path / "s"), limit=1000)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == 100 and back.groupBy("shard").count().agg({"count": "max"}).first()[0] <= 20


def test_empty(spark):
    assert sharding.sharded(spark.createDataFrame([], SCHEMA)).count() == 0
