import random
import zlib

from comarca.llm import language

SYLLABLES = {"aa": "ka lo mi ten ru".split(), "bb": "schr ung pfe zei tz".split(), "cc": "eau que oi ment ai".split()}


def speech(lang, seed, words=60):
    draw = random.Random(f"{lang}{seed}")
    return " ".join("".join(draw.choices(SYLLABLES[lang], k=draw.randint(1, 3))) for _ in range(words))


def table(n=60):
    return [(i, speech(lang, i), lang) for k, lang in enumerate(SYLLABLES) for i in range(k * n, k * n + n)]


def test_held_out_accuracy(docs_of):
    docs = docs_of(table())
    known = language.learn(language.training_rows(docs))
    assert sorted(known) == sorted(SYLLABLES)
    found = language.classify(docs, known).collect()
    unseen = [r for r in found if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    right = [r["lang"] == r["lang_pred"] for r in unseen]
    assert len(right) > 20 and sum(right) / len(right) > 0.97
    assert all(0 <= r["lang_score"] <= 1 for r in found)


def test_only_the_text_counts(docs_of, rows):
    docs = docs_of(table(20))
    known = language.learn(docs)
    odd = [(None, speech("aa", 999), "bb"), (1, None, "aa"), (2, "", "aa"), (3, "123 !?", "aa"), (3, "123 !?", "aa")]
    odd += [(4, speech("cc", 5, 40_000), None), (5, speech("bb", 5).upper() + "!!", "cc")]
    found = language.classify(docs_of(odd), known)
    assert rows(found, "doc_id", "lang_pred") == sorted(
        [(None, "aa"), (1, "und"), (2, "und"), (3, "und"), (3, "und"), (4, "cc"), (5, "bb")], key=repr
    )
    by = {r["doc_id"]: r for r in found.collect()}
    assert by[1]["lang_score"] == 0.0 and by[1]["lang_rejected"] and not by[4]["lang_rejected"]


def test_narrow_margins_are_rejected(docs_of):
    known = language.learn(docs_of(table(20)))
    same = {"x": known["aa"], "y": known["aa"]}
    found = language.classify(docs_of([(1, speech("aa", 3))]), same).first()
    assert found["lang_pred"] == "x" and found["lang_score"] == 0.0 and found["lang_rejected"]


def test_nothing_to_learn_and_nothing_to_classify(docs_of):
    assert language.learn(docs_of([(1, "text", None), (2, None, "aa")])) == {}
    assert language.classify(docs_of([(1, "text")]), {}).first()["lang_pred"] == "und"
    assert language.classify(docs_of([]), {}).collect() == []


def test_any_number_of_languages(monkeypatch, docs_of):
    """More languages than fit in full give fewer texts each, and none is left out."""
    monkeypatch.setattr(language, "LANGUAGES", 2)
    docs = docs_of([(i, speech("aa", i), f"l{i % 9}") for i in range(90)])
    few, some = language.learn(docs, sample_docs=9), language.learn(docs, sample_docs=1)
    assert sorted(few) == sorted(some) == [f"l{i}" for i in range(9)]
    assert all(d.count(b"\n") == 1 for d in few.values()) and all(d.count(b"\n") == 0 for d in some.values())
