import hashlib

import numpy as np
import pytest

from comarca.llm import line_dedup as L

LONG = "this line is long enough to be a key of its own {}"


def expected(rows, min_chars=40, min_docs=5):
    keys = {}
    strip = " \t\n\x0b\x0c\r"
    lower = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
    key = lambda x: x.strip(strip).translate(lower)
    for i, t in rows:
        for x in (t or "").split("\n"):
            if i is not None and len(key(x)) >= min_chars:
                keys.setdefault(key(x), set()).add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if not (len(keys.get(key(x), ())) >= min_docs and i is not None and i != max(keys[key(x)]))]
        out.append((i, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def table():
    many = "\n".join(LONG.format(k) for k in range(3000))
    rows = [(i, f"own {i}\n{LONG.format('A')}\n  {LONG.format('a').upper()}\t\nshort\nshort") for i in range(6)]
    rows += [(10 + i, LONG.format("B")) for i in range(4)]
    rows += [(20 + i, "é" * 39 + "\n" + "é" * 40 + "\r") for i in range(5)]
    rows += [(30, None), (31, ""), (32, "\n\n"), (None, LONG.format("A")), (5, rows[5][1]), (33, many), (34, "x" * 200_000)]
    return rows


def test_against_brute_force(docs_of, rows, table):
    docs = docs_of(table)
    cleaned = L.clean(docs, L.index_of(docs))
    assert set(docs.columns) <= set(cleaned.columns)
    assert rows(cleaned, "doc_id", "n_lines", "n_dropped", "text") == expected(table)


def test_deleting_undoes_inserting(spark, docs_of, rows, table):
    old = [r for r in table if r[0] is None or r[0] < 30]
    new = [(100 + i, f"{LONG.format('B')}\n{LONG.format('C')}") for i in range(5)]
    index = L.insert(L.empty_index(spark, 4), docs_of(old))
    grown = L.insert(index, docs_of(new))
    both = old + new
    assert rows(L.clean(docs_of(both), grown), "doc_id", "n_lines", "n_dropped", "text") == expected(both)
    assert grown.counts.count() == index.counts.count() + 1
    again = L.insert(grown, docs_of(new))  # already there
    assert rows(again.counts) == rows(grown.counts)
    back = L.delete(grown, docs_of(new + [(999, "never inserted")]))
    assert rows(back.counts) == rows(index.counts)
    assert rows(back.refs) == rows(index.refs)
    assert rows(L.clean(docs_of(old), back), "doc_id", "text") == rows(L.clean(docs_of(old), index), "doc_id", "text")
    keeper = L.delete(grown, docs_of([(104, None)]))
    left = [r for r in both if r[0] != 104]
    assert rows(L.clean(docs_of(left), keeper), "doc_id", "n_lines", "n_dropped", "text") == expected(left)


def test_the_filters_follow_the_threshold(spark, docs_of):
    lines = [(i, "\n".join(LONG.format(k) for k in range(300))) for i in range(5)]
    index = L.insert(L.empty_index(spark, 2), docs_of(lines[:4]))
    assert index.filters.count() == 0
    index = L.insert(index, docs_of(lines[4:]))
    assert index.filters.count() == 2
    index = L.delete(index, docs_of(lines[:1]))
    for f in index.filters.collect():
        assert not np.frombuffer(f["slots"], np.uint16).any()


@pytest.mark.parametrize("refs", [1, 7, 1000])
def test_split_shards_give_the_same(monkeypatch, docs_of, rows, table, refs):
    monkeypatch.setattr(L, "SALT_REFS", refs)
    docs = docs_of(table)
    index = L.index_of(docs)
    assert rows(L.clean(docs, index), "doc_id", "n_lines", "n_dropped", "text") == expected(table)
    # one copy of a filter for each part of its shard, in front of its references
    parts = L._sides(index).where("slots is not null").groupBy("shard", "salt").count()
    assert parts.count() > 0 and parts.where("count > 1").count() == 0


def test_the_filters_pass_repeated_keys_and_few_others(docs_of, rows, table):
    index = L.index_of(docs_of(table))
    often = {r["key"] for r in index.counts.where("n_docs >= 5").collect()}
    found = rows(L.passed(index), "key", "doc_id")
    every = rows(index.refs, "key", "doc_id")
    assert [r for r in every if r[0] in often] == [r for r in found if r[0] in often]
    assert len(found) < len(every) / 10


def test_cuckoo_never_misses_and_deletes():
    hashes = np.array([int.from_bytes(hashlib.md5(bytes([i % 256, i // 256])).digest()[:8], "little") for i in range(9000)], np.uint64)
    made = L.Cuckoo.sized(6000)
    assert made.add(hashes[:6000])
    assert made.holds(hashes[:6000]).all()
    assert made.holds(hashes[6000:]).mean() < 0.01
    made.remove(hashes[:3000])
    assert made.holds(hashes[3000:6000]).all() and made.holds(hashes[:3000]).mean() < 0.01
    assert not L.Cuckoo(16).add(hashes)


def test_empty_table(docs_of):
    docs = docs_of([])
    assert L.clean(docs, L.index_of(docs)).collect() == []
