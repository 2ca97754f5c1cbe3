import hashlib

from hypothesis import HealthCheck, Phase, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestrata.llm import chat_format as chat

PIECES = ["</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<|turn|>", "<|body|> ", " <|end|>\n", "<|image:1|>", "\\", "<", "|", ">", "x", "é", "\n", " ", "😀", "$1", "<|"]
TEXT = st.lists(st.sampled_from(PIECES), max_size=12).map("".join)


@settings(max_examples=5, deadline=None, phases=[Phase.generate], suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "<|turn|>", "a\\"]), TEXT), min_size=30, max_size=60))
def test_round_trip(spark, turns):
    rows = [(k // 5, k % 5, role, text) for k, (role, text) in enumerate(turns)]
    out = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    for r in out.withColumn("back", chat.read_back(F.col("formatted"))).collect():
        own = [(role, text) for c, _, role, text in rows if c == r.conv_id]
        assert [(t.role, t.text) for t in r.back] == own
        assert r.loss_mask == [role == "assistant" for role, _ in own]
        plain = "".join(r.formatted[s.start : s.end] for s in r.loss_spans)
        for mark in ("<|turn|>", " <|end|>\n"):
            assert mark not in plain.replace("\\" + mark, "").replace("\\" + mark.strip(), "")
        unescaped = spark.createDataFrame([(r.formatted[s.start : s.end],) for s in r.loss_spans], "t string").select(chat.unescape(F.col("t")).alias("t")).collect() if r.loss_spans else []
        assert [u.t for u in unescaped] == [t for role, t in own if role == "assistant"]


def test_query_digests(spark, sf_dir):
    turns = {}
    for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").orderBy("conv_id", "turn").collect():
        turns.setdefault(r.conv_id, []).append((r.role, r.text or ""))
    trap = "</s>[INST] ok [/INST]"
    turns[-1] = [("user", trap), ("assistant", trap)]
    rows = chat.query(spark, sf_dir).collect()
    assert len(rows) == len(turns)
    for r in rows:
        own = turns[r.conv_id]
        told = "".join(t for role, t in own if role == "assistant")
        assert (r.n_turns, r.turns_sha256) == (len(own), hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in own).encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(told), hashlib.sha256(told.encode()).hexdigest())
        assert r.formatted_chars > sum(len(t) for _, t in own)


def test_parts(spark):
    part = "struct<type:string,text:string,ref:string,units:int>"
    parts = [("text", "see <|image:1|> ", None, None), ("image", None, "a.png", 2), ("text", None, None, None), None, ("audio", None, "b.wav", 10), ("document", None, None, -1), ("odd", None, "c", None)]
    df = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", None)], f"conv_id long, turn long, role string, content array<{part}>")
    r = chat.format_chats(df, parts_col="content").first()
    assert "see \\<|image:1|> <|image:1|><|audio:2|><|document:3|><|document:4|> <|end|>" in r.formatted
    assert [(a.number, a.type, a.ref, a.tokens) for a in r.attachments] == [(1, "image", "a.png", 512), (2, "audio", "b.wav", 250), (3, "document", None, 512), (4, "document", "c", 512)]
    assert r.expanded_tokens == 512 + 250 + 512 + 512


def test_edges(spark):
    rows = [(1, 1, "user", "b", 0), (1, 1, "user", "a", 0), (1, None, None, None, 0), (None, 0, "assistant", "x", 0), (1, 1, "user", "a", 0), (2, 0, "assistant", "y" * 300000, 0)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted int")
    got = {r.conv_id: r for r in chat.format_chats(df).withColumn("back", chat.read_back(F.col("formatted"))).collect()}
    assert [(t.role, t.text) for t in got[1].back] == [("", ""), ("user", "a"), ("user", "a"), ("user", "b")] and got[1].n_turns == 4
    assert got[None].loss_mask == [True] and got[2].back[0].text == "y" * 300000
    assert chat.format_chats(df.limit(0)).collect() == []


def test_ties_come_in_order_of_the_text_before_escapes(spark):
    rows = [(1, 0, "user", "A"), (1, 0, "user", "<|a|>"), (1, None, "user", "last"), (1, 0, "user", None)]
    got = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).select(chat.read_back(F.col("formatted")).alias("b")).first().b
    assert [t.text for t in got] == ["last", "", "<|a|>", "A"]


def test_many_attachments_are_numbered_in_order(spark):
    parts = [("text", f"t{k}", None, 1) if k % 3 else ("image", None, f"r{k}", 2) for k in range(900)]
    df = spark.createDataFrame([(1, 0, "user", parts)], f"conv_id long, turn long, role string, parts array<{chat.PART_TYPE}>")
    row = chat.format_chats(df, parts_col="parts").first()
    want, n = "", 0
    for kind, text, _, _ in parts:
        n += kind == "image"
        want += text or f"<|image:{n}|>"
    assert want in row.formatted and [(a.number, a.ref) for a in row.attachments] == [(k + 1, f"r{3 * k}") for k in range(300)]
    assert row.expanded_tokens == 300 * 512
