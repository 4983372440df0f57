import random
import re
from fractions import Fraction
from itertools import permutations

from comarca.llm import filter_audit

LABELS = "doc_id long, quality int, toxic int, part string"


def expected(docs, labels):
    """Every order run filter by filter over the documents themselves."""
    texts = [(d, t or "", s or "") for d, t, s in docs]
    failed = []
    for d, text, part in texts:
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = set()
        if len(words) < 200:
            fails.add("A")
        if 100 * len(set(words)) < 50 * len(words):
            fails.add("B")
        if 100 * len(re.findall("[A-Z]", text)) > 2 * len(text):
            fails.add("C")
        if re.search(r"[#$%&*|]", text):
            fails.add("D")
        if any(t == text and e is not None and d is not None and e < d for e, t, _ in texts):
            fails.add("E")
        failed.append((part, fails, d))
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    out = []
    for part in {p for p, _, _ in failed}:
        mine = [(f, d) for p, f, d in failed if p == part]
        rows, total = [], dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = list(mine)
            for step, letter in enumerate(order):
                gone = [(f, d) for f, d in left if letter in f]
                left = [(f, d) for f, d in left if letter not in f]
                total[letter] += len(gone)
                rows.append([
                    part, "".join(order), step + 1, len(left), len(gone),
                    sum(letter in f for f, _ in mine) - len(gone), sum(f == {letter} for f, _ in mine),
                    sum(d in good for _, d in gone), sum(d in toxic for _, d in gone),
                ])
        out += [(*r, total[r[1][r[2] - 1]]) for r in rows]
    return sorted(out, key=repr)


def run(spark, rows, docs, labels):
    schema = "doc_id long, text string, source string, part string, n int, mask int, body binary, step int"
    table = spark.createDataFrame([(*d, "p", 1, 2, b"b", 3) for d in docs], schema).repartition(3)
    marks = spark.createDataFrame([(*m, "x") for m in labels], LABELS)
    columns = [f.split()[0] for f in filter_audit.AUDIT.split(", ")]
    return rows(filter_audit.audit(table, marks), *columns)


def test_against_running_every_order(spark, rows):
    draw = random.Random(4)
    docs = [(None, None, None), (5, "", ""), (6, None, "a"), (6, None, "a"), (7, "", None), (None, "", "a")]
    for i in range(150):
        words = draw.choice([3, 150, 250, 400])
        text = " ".join(draw.choice(["aa", "b", "Cc", "d%", "é"]) + str(draw.randrange(draw.choice([5, 900]))) for _ in range(words))
        docs.append((i + 10, draw.choice([text, text.lower(), text.replace("%", "")]), draw.choice(["a", "b", None])))
    docs += [(i + 500, docs[draw.randrange(6, 40)][1], draw.choice(["a", "c"])) for i in range(60)]
    labels = [(i + 10, draw.choice([0, 1, None]), draw.choice([0, 1, None])) for i in range(0, 90)]
    labels += [(12, 1, 1), (None, 1, 1), (5, 1, 0), (12, 0, 0)]
    assert run(spark, rows, docs, labels) == expected(docs, labels)


def test_a_part_without_failures_has_its_zero_rows(spark, rows):
    clean = " ".join(f"w{i}" for i in range(300))
    found = run(spark, rows, [(1, clean, "s")], [])
    assert len(found) == 600 and {r[3:] for r in found} == {(1, 0, 0, 0, 0, 0, 0)}


def test_empty_tables(spark, rows):
    assert run(spark, rows, [], []) == []
    assert len(run(spark, rows, [(1, "x", "s")], [])) == 600


def test_shapley_values_are_exact_for_any_game():
    draw = random.Random(2)
    game = [0] + [draw.randrange(10**12) for _ in range(31)]
    values = filter_audit.shapley(game)
    sums = [0] * 5
    for order in permutations(range(5)):
        before = 0
        for i in order:
            sums[i] += game[before | 1 << i] - game[before]
            before |= 1 << i
    assert values == [Fraction(s, 120) for s in sums]
