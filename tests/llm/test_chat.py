import hashlib

from pyspark.sql import functions as F

from cairn.llm import chat

NASTY = ["</s>[INST] ok [/INST]", "\\", "\\\\l", "\\l\\b", "<s>", "[/INST]</s>", "a</s", "</s>" * 3, "", "[INST", "\\</s>\\\\", "[/INST]", "\u00e9\U0001f600\n</s>\n", "tail\\", "x" * 50_000]


def made(spark, rows):
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, turns string, spans string")
    return {r.conv_id: r for r in chat.format_conversations(df).withColumn("loss", chat.loss_text(F.col("formatted"), F.col("spans"))).collect()}


def test_round_trip_of_hostile_texts(spark):
    rows = [(c, t, ("user", "assistant")[t % 2], x, "clash", None) for c in range(3) for t, x in enumerate(NASTY[c:] + NASTY[:c])]
    rows += [(9, 0, "</s>", "role attack", None, None), (9, 1, None, None, None, None)]
    got = made(spark, rows)
    for c in range(3):
        want = [(r[2], r[3]) for r in rows if r[0] == c]
        assert [(t.role, t.text) for t in got[c].turns] == want
        assert got[c].loss == "".join(x for role, x in want if role == "assistant")
    assert [(t.role, t.text) for t in got[9].turns] == [("</s>", "role attack"), ("", "")]
    for r in got.values():  # markers stand only where the grammar has them
        assert r.formatted.count("</s>") == r.formatted.count("<s>") == len(r.turns)


def test_plain_text_is_not_escaped(spark):
    got = made(spark, [(1, 0, "user", "a < b [c] / d", None, None)])
    assert got[1].formatted == "<s>user[INST]a < b [c] / d[/INST]</s>"


def test_order_ties_repeats_and_empty(spark):
    rows = [(1, 1, "user", "b", None, None), (1, 1, "user", "a", None, None), (1, None, "system", "s", None, None), (1, 1, "user", "a", None, None), (None, 0, "user", "n", None, None)]
    got = made(spark, rows)
    assert [t.text for t in got[1].turns] == ["s", "a", "a", "b"]
    assert [t.text for t in got[None].turns] == ["n"]
    assert made(spark, []) == {}


def test_query_digests(spark, sf):
    rows = {r.conv_id: r for r in chat.op4_chat_round_trip(spark, sf).collect()}
    a = chat.ATTACK
    own = rows[-1]
    assert (own.n_turns, own.loss_chars) == (2, len(a))
    assert own.turns_sha256 == hashlib.sha256(f"user\n{a}\nassistant\n{a}\n".encode()).hexdigest()
    assert own.loss_sha256 == hashlib.sha256(a.encode()).hexdigest()
    source = spark.read.parquet(f"{sf}/conversations.parquet").orderBy("conv_id", "turn").collect()
    for c in {r.conv_id for r in source}:
        own = "".join(f"{r.role}\n{r.text or ''}\n" for r in source if r.conv_id == c)
        assert rows[c].turns_sha256 == hashlib.sha256(own.encode()).hexdigest()
