import random

import numpy as np

from comarca.llm import toxicity

FILL = [a + b for a in "ba ko mi ten ru sol va".split() for b in "na lo ti ker mu dan".split()]


def table(n=700):
    """An insult or the mention of a group alone is harmless; together they are toxic."""
    draw = random.Random(3)
    docs, labels = [], []
    for i in range(n):
        words = draw.choices(FILL, k=draw.randint(20, 60))
        insult, group = draw.random() < 0.5, draw.random() < 0.5
        for on, word in ((insult, "vermin"), (group, "outlanders")):
            if on:
                words.insert(draw.randrange(len(words)), word)
        docs.append((i, " ".join(words)))
        labels.append((i, 1, int(insult and group)))
    return docs, labels


def scores(spark, docs_of, docs, labels):
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    machine = toxicity.learn(docs_of(docs), marks.where("doc_id % 5 <> 0"))
    return machine, toxicity.score(docs_of(docs), machine).collect()


def test_pairs_of_terms_are_learned(spark, docs_of):
    docs, labels = table()
    machine, found = scores(spark, docs_of, docs, labels)
    truth = {i: y for i, _, y in labels}
    unseen = [(r["score"] >= 0.5) == bool(truth[r["doc_id"]]) for r in found if r["doc_id"] % 5 == 0]
    assert np.mean(unseen) > 0.95
    alone = max(machine.score("vermin and others"), machine.score("outlanders came by"))
    assert machine.score("vermin and outlanders") > max(0.5, alone + 0.3)


def test_odd_rows(spark, docs_of):
    docs, labels = table(200)
    marks = [*labels, (None, 0, 1), (3, 1, 1 - labels[3][2]), (9999, 0, 1), (5, None, None)]
    machine, _ = scores(spark, docs_of, docs + [(9998, None)], marks)
    odd = [(1, None), (2, ""), (None, "vermin"), (4, "a"), (4, "a"), (5, "vermin outlanders " * 20_000)]
    found = toxicity.score(docs_of(odd), machine).collect()
    assert len(found) == len(odd) and all(0 <= r["score"] <= 1 for r in found)
    assert len({r["score"] for r in found if r["doc_id"] in (1, 2)}) == 1
    assert toxicity.score(docs_of([]), machine).collect() == []


def test_one_label_only(spark, docs_of):
    docs, labels = table(20)
    machine, found = scores(spark, docs_of, docs, [(i, 1, 0) for i, _, _ in labels])
    assert all(r["score"] < 1e-9 for r in found)
    machine, found = scores(spark, docs_of, docs, [])
    assert all(r["score"] < 1e-9 for r in found)


def test_terms_do_not_depend_on_case_or_signs():
    assert (np.sort(toxicity.terms("Ab, cdé!")) == np.sort(toxicity.terms("ab   CDÉ"))).all()
    assert len(toxicity.terms("?!")) == len(toxicity.terms(None)) == 0


def test_the_sample_is_bounded_whatever_repeats(spark, docs_of):
    """One labelled doc_id on many documents fills its label's share and no more; repeated rows count once."""
    docs = docs_of([(1, f"text {i}") for i in range(500)] + [(1, "text 1")] * 50 + [(2, "other")] * 9 + [(3, "third")])
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0), (3, 1)], "doc_id long, toxic int")
    got = [(r["text"], r["toxic"]) for r in toxicity.sample(docs, labels, rows=40).collect()]
    assert len(got) == len(set(got)) and sum(y for _, y in got) == 40
    assert sorted(t for t, y in got if y == 0) == ["other", "third"]
