import zlib
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from comarca.llm import packing


def held(patterns):
    out = Counter()
    for pattern, count in patterns:
        for n in pattern:
            out[n] += count
    return out


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 20), st.integers(1, 30), max_size=12))
def test_plan_holds_every_length_within_capacity(lengths):
    patterns = packing.plan(lengths, 20)
    assert held(patterns) == Counter(lengths)
    assert all(sum(p) <= 20 and c > 0 for p, c in patterns)


def fewest(items, capacity):
    """The fewest sequences, by trying every placement."""
    best = len(items)

    def place(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(items):
            best = len(rooms)
            return
        for k in sorted(set(range(len(rooms))), key=lambda k: rooms[k]):
            if rooms[k] >= items[i]:
                place(i + 1, rooms[:k] + [rooms[k] - items[i]] + rooms[k + 1 :])
        place(i + 1, [*rooms, capacity - items[i]])

    place(0, [])
    return best


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(3, 12), min_size=1, max_size=8))
def test_reduction_keeps_the_fewest_sequences(items):
    items = sorted(items, reverse=True)
    fixed, left = packing.reduce_instance(Counter(items), 12)
    rest = [n for n, c in left.items() for _ in range(c)]
    assert sum(fixed.values()) + (fewest(sorted(rest, reverse=True), 12) if rest else 0) == fewest(items, 12)


def test_parts_have_the_ids_of_the_whole_text():
    coder = packing.Ids()
    texts = [
        "", " ", "a", "It's a test, isn't it?", "two  blanks", " lead", "trail ", "a\n\nb \n c", "x\t y z    w",
        "été 中文 123 4,5", "<|endoftext|> in the text", "tab\tand\x1cseparator \x1c x", "\U0001f600 \U0001f600\U0001f600",
    ]
    for text, ids in zip(texts, coder.of(texts), strict=True):
        assert ids == coder.whole(text), text


def test_pack_places_every_token_once(docs_of, rows):
    texts = {1: "some words here", 2: None, 3: "", 4: "long text " * 900, 5: "some words here"}
    found = packing.pack(docs_of([*texts.items(), (None, "no id"), (5, "some words here")])).collect()
    coder = packing.Ids()
    end = np.array([packing.END], "<u4").tobytes()
    for r in found:
        text = "no id" if r["doc_id"] is None else texts[r["doc_id"]]
        ids = coder.whole(text or "") + end
        assert r["ids_crc32"] == zlib.crc32(ids[4 * r["start"] : 4 * (r["start"] + r["length"])])
    assert sum(r["doc_id"] == 5 for r in found) == 2
    long = sorted((r["piece"], r["start"], r["length"]) for r in found if r["doc_id"] == 4)
    assert [p[0] for p in long] == list(range(len(long))) and all(n == 1024 for _, _, n in long[1:])
    by = {}
    for r in found:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024


def test_empty_table(docs_of):
    assert packing.pack(docs_of([])).collect() == []
