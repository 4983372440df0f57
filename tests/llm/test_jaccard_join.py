import random
import re

import numpy as np
import pytest

from comarca.llm import jaccard_join as J

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def shingle_set(text):
    w = WORD.findall((text or "").translate(LOWER))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))


def expected(rows):
    sets = [shingle_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                parent[root(i)] = root(j)
    out = []
    for k, (i, _) in enumerate(rows):
        ids = [rows[m][0] for m in range(len(rows)) if root(m) == root(k) and rows[m][0] is not None]
        out.append((i, len(sets[k]), (min(ids) if ids else None) if sets[k] else i))
    return sorted(out, key=repr)


def copies(seed, bases, each, sizes, edits):
    draw = random.Random(seed)
    vocabulary = [f"{a}{b}" for a in "ka lo mi Ten ru é".split() for b in range(40)]
    out = []
    for _ in range(bases):
        words = draw.choices(vocabulary, k=draw.choice(sizes))
        for _ in range(each):
            own = list(words)
            for _ in range(draw.randint(0, max(1, int(len(own) * edits)))):
                at = draw.randrange(len(own))
                own[at : at + draw.randint(0, 1)] = draw.choices(vocabulary, k=draw.randint(0, 2))
            out.append(" ".join(own))
    return out


def check(docs_of, rows, table):
    found = J.join(docs_of(table))
    assert rows(found, "doc_id", "n_shingles", "component_id") == expected(table)


def test_against_brute_force(docs_of, rows):
    texts = copies(1, 25, 5, [3, 5, 6, 9, 14, 30, 60], 0.06) + copies(2, 6, 12, [40, 90, 150], 0.03)
    table = list(enumerate(texts))
    table += [(900, None), (901, ""), (902, " \t\n"), (903, "One"), (904, "one"), (905, "a b c d"), (906, "A\tb  c d")]
    table += [(None, texts[0]), (None, "nothing like it at all here"), (5, texts[5]), (5, texts[5]), (907, "w " * 30_000)]
    random.Random(9).shuffle(table)
    check(docs_of, rows, table)


def test_a_passage_that_many_share(docs_of, rows):
    draw = random.Random(4)
    shared = " ".join(f"p{draw.randrange(999)}" for _ in range(60))
    texts = [f"{shared} " + " ".join(f"o{draw.randrange(9999)}" for _ in range(draw.choice([8, 14, 30, 60]))) for _ in range(120)]
    check(docs_of, rows, list(enumerate(texts)))


def test_links_that_no_likely_partner_gives(monkeypatch, docs_of, rows):
    monkeypatch.setattr(J, "verified", _only_late(J.verified))
    check(docs_of, rows, list(enumerate(copies(7, 10, 8, [25, 60], 0.05))))


def _only_late(verify):
    calls = []

    def run(pairs, bodies):
        calls.append(1)
        return verify(pairs if len(calls) > 1 else pairs.limit(0), bodies)

    return run


def test_shuffled_hashes_give_the_same(monkeypatch, docs_of, rows):
    monkeypatch.setattr(J, "SENT_ROWS", -1)
    monkeypatch.setattr(J, "SENT_BYTES", -1)
    check(docs_of, rows, list(enumerate(copies(8, 10, 4, [12, 40], 0.05))))


def test_only_wanted_texts_are_hashed_again(docs_of):
    docs = docs_of([(i, f"a b c d e f {i}") for i in range(9)] + [(20, "a b c d e f 3"), (21, None)]).select("doc_id", "text")
    sets = J.sets_of(docs)
    wanted = sets.where("doc_id in (3, 5)").select("set_id")
    found = J.bodies(docs, sets, wanted)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("MapInArrow") < plan.index("LeftSemi")
    got = {r["set_id"]: bytes(r["body"]) for r in found.collect()}
    hashes = [J.shingles(f"a b c d e f {i}") for i in (3, 5)]
    assert got == {J.set_id(h): h.tobytes() for h in hashes}


def test_signatures_are_handed_on_in_small_batches(spark):
    texts = [(" ".join(f"{i}x{j}" for j in range(12_000)),) for i in range(200)]
    packed = J.packed_signatures(spark.createDataFrame(texts, "text string").coalesce(1), 1)
    held = [r[0] // 4 for r in packed.selectExpr("octet_length(signs)").collect()]
    assert sum(held) > 600_000 and max(held) < 600_000


def test_tens_of_megabytes_of_hashes_are_not_sent(spark):
    known = spark.range(20_000).selectExpr("id as set_id", "cast(repeat('x', 1000) as binary) as body")
    pairs = spark.range(19_999).selectExpr("id as a", "id + 1 as b")
    assert "broadcast" not in J.verified(pairs, known)._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("text", ["One two  THREE\tfour five six", "x" * 70_000 + " é \x1c y", "late " * 40_000 + "Wörd"])
def test_words_are_hashed_as_polynomials(text):
    m = 1 << 64
    words = [b for b in text.encode().lower().split()]
    sums = []
    for w in words:
        at, total = 1, 0
        for b in w:
            at = at * int(J.BASE) % m
            total = (total + (b + 1) * at) % m
        sums.append(total)
    sums = J.mix(np.array(sums, np.uint64))
    n = max(1, len(words) - 4)
    k = min(5, len(words))
    with np.errstate(over="ignore"):
        whole = [np.uint64(k) + np.sum(sums[i : i + k] * np.array(J.ODD[:k]), dtype=np.uint64) for i in range(n)]
    assert (J.shingles(text) == np.unique(J.mix(np.array(whole, np.uint64)))).all()


def test_a_family_short_of_the_threshold_gives_few_pairs(monkeypatch, docs_of, rows):
    draw = random.Random(12)
    base = [f"b{i}" for i in range(400)]
    texts = []
    for m in range(40):  # each lacks a tenth of the shingles of the base, two of them about a fifth of each other's
        own = list(base)
        for at in draw.sample(range(0, 400, 5), 9 if m else 0):
            own[at] = f"m{m}x{at}"
        texts.append(" ".join(own))
    seen = []
    verify = J.verified
    monkeypatch.setattr(J, "verified", lambda pairs, known: seen.append(pairs.distinct().count()) or verify(pairs, known))
    check(docs_of, rows, list(enumerate(texts[1:])))
    assert sum(seen) < 39 * 38 // 2 // 4


def test_parities_never_rule_out_a_link():
    draw = np.random.default_rng(3)
    for size in (3, 40, 400, 4000):
        x = np.unique(J.mix(draw.integers(0, 2**63, size).astype(np.uint64)))
        y = np.unique(np.concatenate([x[size // 10 :], J.mix(draw.integers(0, 2**63, size // 10).astype(np.uint64))]))
        bits = lambda h: np.unpackbits(np.array(J.parities(h), np.int64).view(np.uint8))
        assert len(bits(x)) == 64 * J.SKETCH
        assert (bits(x) != bits(y)).sum() <= len(np.setxor1d(x, y))
        assert (bits(x) == bits(x[::-1])).all()


def test_meetings_are_dealt_once_to_be_costed(spark):
    rows = [(1, 7, 0, 1), (2, 7, 8, 1), (3, 7, 0, 3), (1, 9, 16, 1), (2, 9, 16, 1), (3, 8, 0, 3), (4, 8, 0, 4), (5, 8, 0, 4)]
    met = spark.createDataFrame(rows, "set_id long, meeting long, code int, root long")
    mixed = J._mixed(met, "root")
    costed = J._costed(mixed)
    assert sorted((r.set_id, r.meeting, r.all, r.is_major) for r in costed.collect()) == [
        (1, 7, 3, True), (2, 7, 3, True), (3, 7, 3, False), (3, 8, 3, False), (4, 8, 3, True), (5, 8, 3, True),
    ]
    for df in (mixed, costed):
        assert df._jdf.queryExecution().sparkPlan().toString().count("Join") == 0
        assert df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("hashpartitioning(") == 1


def test_empty_table(docs_of):
    assert J.join(docs_of([])).collect() == []


@pytest.mark.parametrize("size", [1, 4, 9, 27, 80, 260, 1300])
def test_linked_sets_agree_in_more_units_than_they_may_lack(size):
    """The pigeonhole bound itself: agreeing segments of any linked pair exceed what the units leave over."""
    draw = np.random.default_rng(size)
    for _ in range(60):
        x = np.unique(J.mix(draw.integers(0, 2**63, size).astype(np.uint64)))
        y = np.concatenate([draw.permutation(x)[draw.integers(0, size // 8 + 1) :], J.mix(draw.integers(0, 2**63, draw.integers(0, size // 8 + 1)).astype(np.uint64))])
        y = np.unique(y)
        both = len(np.intersect1d(x, y))
        if not len(y) or 100 * both < 80 * (len(x) + len(y) - both):
            continue
        x, y = (x, y) if len(x) >= len(y) else (y, x)
        band = J.BANDS.of(len(y))
        below = dict(J.BANDS.schemes(len(x)))[band]
        (sx, cx), (sy, cy) = J.signatures(x, band, below), J.signatures(y, band, 0)
        filled = (cx % 4 == J.EXACT).sum()
        agree = len(np.intersect1d(sx[cx % 4 == J.EXACT], sy[cy % 4 == J.EXACT]))
        first = J.BANDS.neighboured(band)
        assert filled + first >= (len(x) + len(y)) // 9 + 1
        assert filled - agree <= (len(x) + len(y)) // 9
