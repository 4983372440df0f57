import os
import random

import corpus_pipeline as C
from tests.llm.test_jaccard_join import expected as groups_of
from tests.llm.test_line_dedup import expected as lines_of
from tests.llm.test_decontaminate import expected as hits_of


def write(spark, folder, docs, items):
    schema = "doc_id long, text string, lang string, source string, n_chars long, extra string"
    spark.createDataFrame(docs, schema).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def corpus():
    draw = random.Random(2)
    kinds = {"aa": "ka lo mi ten ru".split(), "bb": "schr ung pfe zei tz".split()}
    word = lambda lang: "".join(draw.choices(kinds[lang], k=draw.randint(2, 4)))
    text = lambda lang, n: " ".join(word(lang) for _ in range(n))
    shared = text("aa", 14)
    items = [(1, text("aa", 20)), (2, text("bb", 12))]
    docs = []
    for i in range(80):
        lang = "aa" if i % 3 else "bb"
        docs.append([i, "\n".join(text(lang, 12) for _ in range(4)), lang])
    for i in range(6):
        docs[3 * i + 1][1] += "\n" + shared
    docs[40][1] += "\n" + items[0][1]
    docs[70][1] = docs[60][1].upper()
    docs[71][1] = docs[61][1] + " " + word("aa")
    docs += [[80, None, "aa"], [81, "12 34", "aa"], [82, docs[62][1], "aa"]]
    return [(*d, "s", len(d[1] or ""), "e") for d in docs], items


def test_every_stage_against_brute_force(spark, tmp_path):
    docs, items = corpus()
    folder = f"file://{tmp_path}"
    write(spark, folder, docs, items)
    frame = spark.read.parquet(f"{folder}/documents.parquet")
    seen = {}
    for name, stage in C.STAGES:
        rows = [tuple(r) for r in frame.select("doc_id", "text").collect()]
        columns = frame.columns
        frame = stage(spark, frame, folder)
        path = os.path.join(folder, name)
        frame.write.parquet(path)
        frame = spark.read.parquet(path)
        if name != "packing":
            assert frame.columns == columns
        got = sorted((tuple(r) for r in frame.select("doc_id", "text").collect()), key=repr) if name != "packing" else None
        if name == "language":
            assert {i for i, _ in rows} - {i for i, _ in got} == {80, 81}
        elif name == "line_dedup":
            assert got == [(i, t) for i, _, _, t in lines_of(rows)]
            assert all(r["n_chars"] == len(r["text"]) for r in frame.collect())
        elif name == "ngram_join":
            keep = {i for i, _, c in groups_of(rows) if i == c}
            assert {i for i, _ in got} == keep and {70, 71, 82}.isdisjoint(keep)
        elif name == "decontamination":
            keep = {r[0] for r in hits_of(rows, items) if not r[5]}
            assert {i for i, _ in got} == keep and 40 not in keep
        seen[name] = frame.count()
    assert {r["doc_id"] for r in frame.collect()} == {i for i, _ in rows}
    assert C.run(spark, folder).count() == seen["packing"]


def test_empty_tables(spark, tmp_path):
    folder = f"file://{tmp_path}"
    write(spark, folder, [], [])
    assert C.run(spark, folder).collect() == []
