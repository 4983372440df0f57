import random

import xxhash

from comarca.llm import simhash


def plain(text):
    words = (text or "").encode().lower().split()
    runs = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def grouped(codes, radius):
    root = list(range(len(codes)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(codes)):
        for j in range(i):
            if (codes[i] ^ codes[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(codes))]


def expected(table, radius=2):
    codes = [plain(text) for _, text in table]
    groups = grouped(codes, radius)
    least = {}
    for (doc_id, _), g in zip(table, groups, strict=True):
        if doc_id is not None:
            least[g] = min(least.get(g, doc_id), doc_id)
    return sorted(((d, f"{c:016x}", least.get(g)) for (d, _), c, g in zip(table, codes, groups, strict=True)), key=repr)


def texts(n, seed):
    draw = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    out = []
    for _ in range(n):
        if out and draw.random() < 0.6:
            some = draw.choice(out).split(" ")
            for _ in range(draw.randint(0, 2)):
                some[draw.randrange(len(some))] = draw.choice(words)
            out.append(" ".join(some))
        else:
            out.append(" ".join(draw.choice(words) for _ in range(draw.randint(1, 300))))
    return out


def run(spark, rows, docs_of, table):
    return rows(simhash.dedup(docs_of(table).repartition(3)), "doc_id", "fingerprint", "component_id")


def test_fingerprints():
    cases = [None, "", " \t\n", "One", "one  TWO", " a b\nc ", "Ä b c d", "x\x0by\x0cz\rw v u", "a b c " * 40_000]
    for text in cases + texts(50, 3):
        assert simhash.fingerprint(text) % (1 << 64) == plain(text)


def test_whole_table_against_brute_force(spark, rows, docs_of):
    table = list(enumerate(texts(300, 5)))
    table += [(1000, None), (1001, ""), (1002, " \n"), (None, table[3][1]), (None, "alone in this"), (7, table[7][1])]
    assert run(spark, rows, docs_of, table) == expected(table)


def test_empty_table(spark, rows, docs_of):
    assert run(spark, rows, docs_of, []) == []


def pairs(codes, radius):
    signed = [c - (1 << 64) if c >> 63 else c for c in codes]
    return sorted(
        (min(a, b), max(a, b))
        for i, a in enumerate(signed)
        for b in signed[:i]
        if ((a ^ b) % (1 << 64)).bit_count() <= radius
    )


def found(spark, codes, radius, crowd):
    df = spark.createDataFrame([(c - (1 << 64) if c >> 63 else c,) for c in codes], "code long").repartition(3)
    return sorted(tuple(r) for r in simhash.linked(df, radius, crowd).collect())


def test_crowded_entries_are_indexed_again(spark):
    draw = random.Random(9)
    codes = {draw.getrandbits(64) for _ in range(100)}
    for base in list(codes)[:3]:  # families: many codes around one, in high bits, in low bits and anywhere
        for low, high in ((0, 32), (32, 64), (0, 64)):
            for _ in range(120):
                code = base
                for _ in range(draw.randint(1, 3)):
                    code ^= 1 << draw.randrange(low, high)
                codes.add(code)
    for radius, crowd in ((2, 2), (2, 64), (1, 3), (3, 8), (0, 4)):
        assert found(spark, sorted(codes), radius, crowd) == pairs(sorted(codes), radius), (radius, crowd)


def test_a_look_meets_a_bounded_number_of_codes():
    for level, free in enumerate(simhash.FREE):
        assert all(64 - m.bit_count() == free for m in simhash.masks(level))
    assert simhash.FREE[-1] == 8
