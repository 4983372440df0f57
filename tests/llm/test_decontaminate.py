import hashlib
import random
import re

from comarca.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def expected(docs, items):
    spans = {}
    for i, t in items:
        w = words(t)
        for s in range(max(len(w) - 9, 1) if w else 0):
            spans.setdefault(tuple(w[s : s + 10]), set()).add(i)
    sizes = {len(s) for s in spans}
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for n in sizes:
            for s in range(len(w) - n + 1):
                if (owners := spans.get(tuple(w[s : s + n]))) is not None:
                    hit.update(range(s, s + n))
                    found |= owners
        names = ",".join(sorted(map(str, found)))
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(names.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def tables():
    draw = random.Random(5)
    vocabulary = [f"w{i}" for i in range(60)] + ["Été", "ÉTÉ", "été", "straße", "İx", "the", "The", "of", "10"]
    text = lambda n: " ".join(draw.choices(vocabulary, k=n))
    items = [(i, text(draw.choice([3, 9, 10, 14, 30]))) for i in range(25)]
    items += [(25, "same same same same same same same same same same same same"), (26, None), (27, "?!"), (28, items[4][1])]
    items += [(29, "rarest")]
    docs = [(i, text(draw.randint(0, 80))) for i in range(60)]
    for i in range(60, 100):
        body = draw.choice([t for _, t in items if t])
        docs.append((i, f"{text(draw.randint(0, 12))} {draw.choice([body, body.upper(), body.replace(' ', ', ')])} {text(5)}"))
    docs += [(100, None), (101, ""), (None, items[3][1]), (60, docs[60][1]), (60, "other text of the same id")]
    docs += [(102, "same " * 40), (103, text(6000)), (104, items[0][1] + " " + items[0][1])]
    return docs, items


def test_against_brute_force(spark, docs_of, rows):
    docs, items = tables()
    bench = spark.createDataFrame([(i, t, "c", 1, 2) for i, t in items], "item_id long, text string, term string, row int, n int")
    found = D.decontaminate(docs_of(docs), bench)
    assert rows(found, "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == expected(docs, items)


def test_shuffled_joins_give_the_same(monkeypatch, spark, docs_of, rows):
    docs, items = tables()
    bench = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(D, "BROADCAST_ROWS", -1)
    assert rows(D.decontaminate(docs_of(docs), bench)) == expected(docs, items)


def test_empty_tables(spark, docs_of, rows):
    none = spark.createDataFrame([], "item_id long, text string")
    assert rows(D.decontaminate(docs_of([(1, "a b")]), none)) == expected([(1, "a b")], [])
    some = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert D.decontaminate(docs_of([]), some).collect() == []


def test_proximity(spark, docs_of, rows):
    items = spark.createDataFrame([(1, "alpha beta")], "item_id long, text string")
    docs = docs_of([(1, "beta x x Alpha"), (2, "alpha x x x x beta"), (3, "alpha alpha"), (4, "alpha beta beta"), (5, "beta beta beta")])
    found = D.proximity(docs, items, within=3)
    assert rows(found, "doc_id", "first", "gap") == [(1, 3, 3), (4, 0, 1)]


def test_no_python_in_the_plan(spark, docs_of):
    items = spark.createDataFrame([(1, "alpha beta")], "item_id long, text string")
    plan = D.decontaminate(docs_of([(1, "alpha beta")]), items)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
