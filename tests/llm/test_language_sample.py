from comarca.llm import language
from tests.llm.test_language import SYLLABLES, speech

HEAD = "qwx vyj zgh " * 100


def test_a_common_opening_does_not_fill_the_dictionaries(docs_of):
    docs = [(i, HEAD + speech(lang, i, 600), lang) for k, lang in enumerate(SYLLABLES) for i in range(40 * k, 40 * k + 40)]
    known = language.learn(docs_of(docs))
    for lang, raw in known.items():
        own = sum(raw.count(s.encode()) * len(s) for s in SYLLABLES[lang])
        assert own > len(raw) / 3, lang
    bodies = [(1000 + i, speech(lang, 1000 + i), lang) for i, lang in enumerate(list(SYLLABLES) * 10)]
    found = language.classify(docs_of(bodies), known).collect()
    assert all(r["lang"] == r["lang_pred"] and not r["lang_rejected"] for r in found)


def test_copies_count_once(docs_of):
    other = [(i, speech("aa", i), "aa") for i in range(5)]
    known = language.learn(docs_of([*other, *[(100 + i, speech("aa", 99), "aa") for i in range(50)]]), sample_docs=6)
    assert known["aa"].count(speech("aa", 99).encode()) == 1
    assert all(t.encode() in known["aa"] for _, t, _ in other)


def test_wide_letters_are_taken_from_the_whole_text(docs_of):
    text = "".join("แ" * 90 + c for c in "กขคงจฉชซญด")  # 910 letters of three bytes
    raw = language.learn(docs_of([(1, text, "th")]))["th"]
    assert len(raw) <= language.SAMPLE_BYTES + language.PLACES
    assert sum(c.encode() in raw for c in "ฉชซญด") >= 1
