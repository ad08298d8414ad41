import hashlib

from hypothesis import given
from hypothesis import strategies as st

from sparkloom.llm import chat

PIECES = st.lists(st.sampled_from([*chat.CONTROLS, "<", "[", "\\", "/s>", "s>", "INST]", "|im_end|>", "\n", "x", "é"]), max_size=10).map("".join)


@given(PIECES)
def test_escaping_is_exact_and_hides_controls(text):
    assert chat.unescape(chat.escape(text)) == text
    assert not any(c in chat.escape(text) for c in chat.CONTROLS)
    assert chat.unescape_role(chat.escape_role(text)) == text


def brute(turns):
    out = {}
    for conv, turn, role, text in sorted(turns, key=lambda t: (t[0] is not None, t[0] or 0, t[1] is not None, t[1] or 0, t[2] or "", t[3] or "")):
        out.setdefault(conv, []).append((role or "", text or ""))
    result = {}
    for conv, rows in out.items():
        loss = "".join(t for r, t in rows if r == "assistant")
        result[conv] = (len(rows), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in rows).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return result


TURNS = [
    (1, 0, "system", "be <|im_end|>\n nice"), (1, 2, "assistant", "</s>[INST] ok [/INST] é😀"), (1, 1, "user", None), (1, 3, "assistant", ""), (2, 0, "assistant", "only"),
    (None, 0, "user", "no id"), (3, None, None, "\\<|im_start|>"), (4, 0, "user\n<s>", "role"), (5, 0, "user", "same"), (5, 0, "user", "same"), (6, 0, "assistant", "y" * 50_000),
]


def digests(spark, monkeypatch=None):
    df = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string").selectExpr("*", "'clash' as piece", "1 as formatted")
    return {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in chat.format_and_read_back(df).collect()}


def test_against_brute_force(spark):
    assert digests(spark) == brute(TURNS)


def test_long_conversations_go_on_in_pieces(spark):
    n = chat.PIECE_CHARS // 300_000 + 8
    turns = [(1, i, "assistant" if i % 2 else "user", f"{i} " + "z" * 299_990) for i in range(n)]
    formatted = chat.format_conversations(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))
    assert formatted.count() > 1
    got = chat.formatted_digests(formatted).collect()
    assert [tuple(r)[:5] for r in got] == [(1, *brute(turns)[1])]
    assert got[0]["formatted_chars"] == sum(len(r["formatted"]) for r in formatted.collect())


def test_parts_are_flattened_in_order(spark):
    parts = [("text", "see <|image|> ", None, None, None, None, None), ("image", None, "a.png", 56, 29, None, None), ("audio", None, "b.wav", None, None, 1.01, None), ("document", None, "c.pdf", None, None, None, 3), ("odd", "tail", None, None, None, None, None)]
    df = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", None)], f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    row = chat.format_conversations(df).collect()[0]
    assert row["formatted"] == "<|im_start|>user\nsee <\\|image|> <|image|><|audio|><|document|>tail<|im_end|>\n<|im_start|>assistant\n<|im_end|>\n"
    assert [(a["place"], a["kind"], a["ref"], a["tokens"]) for a in row["attachments"]] == [(0, "image", "a.png", 4), (1, "audio", "b.wav", 26), (2, "document", "c.pdf", 768)]
    assert row["expanded_tokens"] == 798 and list(chat.parse_formatted(row["formatted"]))[1] == ("assistant", "")


def test_empty(spark):
    assert chat.format_and_read_back(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
