import zlib

import numpy as np

from comarca.llm import sharding


def plain_jump(key, shards):
    at, to = -1, 0
    while to < shards:
        at = to
        key = (key * 2862933555777941757 + 1) % 2**64
        to = int((at + 1) * (float(1 << 31) / ((key >> 33) + 1)))
    return at


def test_jump_equals_the_plain_loop():
    keys = [0, 1, 2, 77, 2**63, 2**64 - 1, *range(1000, 1200)]
    for shards in (1, 2, 40, 41, 1000):
        assert sharding.jump(np.array(keys, np.uint64), shards).tolist() == [plain_jump(k, shards) for k in keys]


def test_one_more_shard_takes_rows_only_into_itself(docs_of):
    rows = [(i, "t" * (i % 7)) for i in range(2000)] + [(None, None), (-5, None), (3, "ttt"), (3, "ttt")]
    found = sharding.shard(docs_of(rows)).collect()
    assert len(found) == len(rows)
    for r in found:
        assert r["grown_shard"] in (r["shard"], 40)
        assert r["shard"] == plain_jump((r["doc_id"] or 0) % 2**64, 40)
    moved = sum(r["grown_shard"] == 40 for r in found)
    assert 20 < moved < 90
    by = {}
    for r in found:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in by.values())


def test_sizes_and_checksums(docs_of):
    found = {r["doc_id"]: r for r in sharding.shard(docs_of([(1, "hé"), (2, None), (3, "")])).collect()}
    assert [found[i]["size"] for i in (1, 2, 3)] == [19, 16, 16]
    assert [found[i]["text_crc32"] for i in (1, 2)] == [zlib.crc32("hé".encode()), 0]
    assert found[1]["law"] == "key"


def test_text_keys_and_empty_table(spark, docs_of):
    named = spark.createDataFrame([("a", "x"), ("b", None), (None, "y")], "doc_id string, text string")
    assert len(sharding.shard(named).collect()) == 3
    assert sharding.shard(docs_of([])).collect() == []
