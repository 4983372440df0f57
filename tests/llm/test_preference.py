from comarca.llm import preference as P

SCHEMA = "pair_id long, turn long, role string, text string, part string, said string"


def frame(spark, turns):
    return spark.createDataFrame([(*t, "x", "y") for t in turns], SCHEMA)


def shown(role, text):
    return f"<|im_start|>{role}\n{text}<|im_end|>\n"


def test_common_turns_are_the_prompt(spark, rows):
    common = [(1, 0, "system", "s"), (1, 1, "user", "u")]
    chosen = [*common, (1, 2, "assistant", "good"), (1, 3, "user", "thanks")]
    rejected = [*common, (1, 2, "assistant", "bad")]
    found = rows(P.format_pairs(frame(spark, chosen), frame(spark, rejected)), "part", "turn", "rendered", "train_from", "train_to")
    good, bad = shown("assistant", "good"), shown("assistant", "bad")
    assert found == sorted(
        [
            ("prompt", 0, shown("system", "s"), 0, 0),
            ("prompt", 1, shown("user", "u"), 0, 0),
            ("chosen", 2, good, 22, len(good)),
            ("chosen", 3, shown("user", "thanks"), 0, 0),
            ("rejected", 2, bad, 22, len(bad)),
        ],
        key=repr,
    )
    assert good[22:] == "good<|im_end|>\n"


def test_turns_after_the_split_are_not_prompt_again(spark, rows):
    a = [(1, 0, "user", "x"), (1, 1, "assistant", "a"), (1, 2, "user", "same")]
    b = [(1, 0, "user", "x"), (1, 1, "assistant", "b"), (1, 2, "user", "same")]
    found = rows(P.format_pairs(frame(spark, a), frame(spark, b)), "part", "turn")
    assert found == [("chosen", 1), ("chosen", 2), ("prompt", 0), ("rejected", 1), ("rejected", 2)]


def test_alike_one_sided_null_and_repeated(spark, rows):
    a = [(1, 0, "user", "x"), (1, 0, "user", "x"), (2, 0, None, None), (3, 5, "user", "b"), (3, 5, "user", "a")]
    a += [(None, 0, "user", "x"), (1, None, "user", "x"), (5, 0, "assistant", "w " * 50_000)]
    b = [(1, 0, "user", "x"), (2, 0, "", ""), (4, 0, "assistant", "only")]
    found = P.format_pairs(frame(spark, a), frame(spark, b))
    assert rows(found, "pair_id", "part", "turn", "role") == [
        (1, "prompt", 0, "user"), (2, "prompt", 0, ""), (3, "chosen", 5, "user"), (4, "rejected", 0, "assistant"),
        (5, "chosen", 0, "assistant"),
    ]
    assert found.where("pair_id = 3").first()["rendered"] == shown("user", "a")


def test_swapped_replies(spark, rows):
    turns = spark.createDataFrame(
        [(1, 0, "user", "q1"), (1, 1, "assistant", "a1"), (1, 2, "user", "end"), (2, 0, "user", "q2"), (2, 1, "assistant", "a2"),
         (7, 0, "user", "no reply")],
        "conv_id long, turn long, role string, text string",
    )
    found = P.format_pairs(*P.swapped_replies(turns))
    assert rows(found, "pair_id", "part", "turn", "rendered") == sorted(
        [
            (1, "prompt", 0, shown("user", "q1")), (1, "chosen", 1, shown("assistant", "a1")),
            (1, "rejected", 1, shown("assistant", "a2")), (2, "prompt", 0, shown("user", "q2")),
            (2, "chosen", 1, shown("assistant", "a2")),
        ],
        key=repr,
    )
    assert P.format_pairs(*P.swapped_replies(turns.limit(0))).collect() == []


def test_gapped_and_text_ids_follow_each_other(spark, rows):
    ids = [(i,) for i in (70, 10, 5, 1000)]
    found = rows(P.successors(spark.createDataFrame(ids, "pair_id long")))
    assert found == sorted([(5, 10), (10, 70), (70, 1000), (1000, None)], key=repr)
    turns = [("b", 0, "user", "q"), ("b", 1, "assistant", "yes"), ("d", 0, "assistant", "no"), ("c", 0, "user", "?")]
    turns = spark.createDataFrame(turns, "conv_id string, turn long, role string, text string")
    found = P.paired(P.format_pairs(*P.swapped_replies(turns)))
    yes, no = shown("assistant", "yes"), shown("assistant", "no")
    assert rows(found) == sorted(
        [
            ("b", 0, shown("user", "q"), yes, no, f"22-{len(yes)}", f"22-{len(no)}"),
            ("d", 0, "", no, "", f"22-{len(no)}", ""),
        ],
        key=repr,
    )


def test_joined_texts_and_spans_in_pieces(monkeypatch, spark, rows):
    monkeypatch.setattr(P, "PIECE_TURNS", 4)
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "assistant"]
    chosen = [(1, n, r, f"{r} \u00e9\U0001f600 {n}") for n, r in enumerate(roles)]
    rejected = [*chosen[:2], (1, 2, "assistant", ""), (1, 3, "user", None), (2, -1, "assistant", "w " * 50_000)]
    found = rows(P.paired(P.format_pairs(frame(spark, chosen), frame(spark, rejected))))
    whole = {}
    for part, turns in (("prompt", chosen[:2]), ("chosen", chosen[2:]), ("rejected", rejected[2:])):
        for pair, n, role, text in turns:
            texts, spans = whole.setdefault((pair, n // 4), {}).setdefault(part, ([], []))
            at = sum(map(len, texts))
            texts.append(shown(role, text or ""))
            if part != "prompt" and role == "assistant":
                spans.append(f"{at + 22}-{at + len(texts[-1])}")
    none = ([], [])
    expected = [
        (*key, *["".join(parts.get(p, none)[0]) for p in ("prompt", "chosen", "rejected")],
         *[",".join(parts.get(p, none)[1]) for p in ("chosen", "rejected")])
        for key, parts in whole.items()
    ]
    assert found == sorted(expected, key=repr)
    assert {r[:2] for r in found} == {(1, 0), (1, 1), (2, -1)}
    assert P.paired(P.format_pairs(frame(spark, []), frame(spark, []))).collect() == []
