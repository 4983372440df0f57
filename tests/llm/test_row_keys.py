import corpus_pipeline as C
from tests.llm.test_language import speech

PASSAGE = speech("aa", "passage", 20)


def kept(spark, stage, docs, folder):
    out = stage(spark, docs, folder)
    assert out.columns == docs.columns
    return sorted((tuple(r) for r in out.select("doc_id", "text").collect()), key=repr)


def test_contamination_goes_by_row(spark, docs_of, tmp_path):
    folder = f"file://{tmp_path}"
    spark.createDataFrame([(1, PASSAGE)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    dirty = f"{speech('bb', 1)} {PASSAGE}"
    clean = [(None, speech("bb", 2)), (None, None), (5, speech("bb", 3)), (6, None)]
    docs = docs_of([(None, dirty), (5, dirty), *clean])
    assert kept(spark, C.drop_contaminated, docs, folder) == sorted(clean, key=repr)


def test_texts_of_one_id_are_copies_only_when_linked(spark, docs_of, tmp_path):
    a, b, c, d, e = (speech("bb", i) for i in range(5))
    rows = [
        (1, a), (1, b), (1, b),  # two unlinked texts, one repeated
        (3, c), (7, c), (7, d),  # the copy of 3 goes, the other text of 7 stays
        (None, c), (None, e), (None, e + " ka"),  # copies without an id
        (9, None), (9, None), (None, ""), (None, ""),  # nothing to link
    ]
    stay = [(1, a), (1, b), (3, c), (7, d), (9, None), (9, None), (None, ""), (None, "")]
    got = kept(spark, C.one_of_each, docs_of(rows), str(tmp_path))
    bare = [r for r in got if r[0] is None and r[1]]
    assert sorted((r for r in got if r not in bare), key=repr) == sorted(stay, key=repr)
    assert len(bare) == 1 and bare[0][1] in (e, e + " ka")
