from evalspark.llm import preference

SCHEMA = "pair_id long, turn long, role string, text string, part string, block int"


def side(spark, rows):
    return spark.createDataFrame([(*r, "x", 0) for r in rows], SCHEMA)


def parts(frame):
    """{(pair, part): (text, characters that carry loss)} read in order of offsets."""
    out = {}
    for r in sorted(frame.collect(), key=lambda r: (r["pair_id"], r["part"], r["start_char"])):
        text, loss = out.get((r["pair_id"], r["part"]), ("", ""))
        assert r["start_char"] == len(text) and r["end_char"] == len(text) + len(r["rendered"])
        if r["loss_start"] is not None:
            loss += r["rendered"][r["loss_start"] - r["start_char"]:]
        out[r["pair_id"], r["part"]] = (text + r["rendered"], loss)
    return out


def show(role, text):
    return f"<|{role}|>\n{text}<|end|>\n"


def test_prompt_is_the_common_prefix(spark):
    chosen = [(1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (1, 2, "user", "more"), (1, 3, "assistant", "good")]
    rejected = chosen[:3] + [(1, 3, "assistant", "bad"), (1, 4, "user", "why"), (1, 5, "assistant", "so")]
    got = parts(preference.preference_segments(side(spark, chosen), side(spark, rejected)))
    assert got == {(1, "prompt"): ("".join(show(*t[2:]) for t in chosen[:3]), ""),
                   (1, "chosen"): (show("assistant", "good"), "good<|end|>\n"),
                   (1, "rejected"): ("".join(show(*t[2:]) for t in rejected[3:]), "bad<|end|>\nso<|end|>\n")}


def test_awkward_rows(spark):
    same = [(2, 0, "user", "a"), (2, 1, "assistant", "b")]
    chosen = same + [(None, 0, "user", "lost"), (3, 0, "user", "only here"), (4, 0, None, None), (4, None, "assistant", "late"),
                     (5, 0, "user", "x"), (5, 0, "user", "x"), (5, 1, "assistant", "y"), (6, 0, "user", "p" * 50_000)]
    rejected = same + [(4, 0, None, None), (5, 0, "user", "x"), (5, 1, "assistant", "y"), (7, 0, "assistant", "")]
    got = parts(preference.preference_segments(side(spark, chosen).repartition(4), side(spark, rejected)))
    assert got[2, "prompt"] == (show("user", "a") + show("assistant", "b"), "") and (2, "chosen") not in got
    assert got[3, "chosen"] == (show("user", "only here"), "") and (3, "prompt") not in got
    assert got[4, "prompt"] == (show("", ""), "") and got[4, "chosen"] == (show("assistant", "late"), "late<|end|>\n")
    assert got[5, "chosen"] == (show("user", "x") * 2 + show("assistant", "y"), "y<|end|>\n")
    assert got[5, "rejected"] == (show("user", "x") + show("assistant", "y"), "y<|end|>\n")
    assert got[6, "chosen"][0] == show("user", "p" * 50_000) and got[7, "rejected"] == (show("assistant", ""), "<|end|>\n")
    assert {k[0] for k in got} == {2, 3, 4, 5, 6, 7}


def test_offsets_across_blocks(spark):
    rows = [(1, i, "user" if i % 2 else "assistant", f"t{i}") for i in range(3 * preference.BLOCK_TURNS)]
    got = parts(preference.preference_segments(side(spark, rows), side(spark, rows[:5])))
    assert got[1, "prompt"][0] == "".join(show(*r[2:]) for r in rows[:5])
    assert got[1, "chosen"][0] == "".join(show(*r[2:]) for r in rows[5:])


def test_empty_tables(spark):
    assert preference.preference_segments(side(spark, []), side(spark, [])).collect() == []


def test_pairs_of_conversations(spark):
    rows = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "a"), (1, 2, "user", "r"), (1, 3, "assistant", "b"),
                                  (2, 0, "user", "q"), (2, 1, "assistant", "a"), (3, 0, "user", "q")],
                                 "conv_id long, turn long, role string, text string")
    chosen, rejected = preference.pairs_of(rows)
    assert chosen.count() == rejected.count() == 7
    assert {tuple(r) for r in rejected.where("role = 'assistant'").collect()} == {
        (1, 1, "assistant", "a"), (1, 3, "assistant", "a"), (2, 1, "assistant", "")}
