import hashlib
import random

from feedloom.llm import chat_format as chat

SCHEMA = "conv_id long, turn long, role string, text string"
PARTS = ["<", "|", "\\", "<|", "<\\|", "<\\\\|", "<|im_end|>", "<|im_start|>", "assistant", "\n", "<|image|>", "ok ", "", "é", "🙂", "%0A", "%25", "$1", "|>"]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def expected(rows):
    chats = {}
    for conv, turn, role, text in rows:
        chats.setdefault(conv, []).append((turn, role or "", text or ""))
    out = []
    for conv, turns in chats.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1], written(t[2]).encode()))
        loss = "".join(x for _, r, x in turns if r == "assistant")
        whole = "".join(f"{r}\n{x}\n" for _, r, x in turns)
        out.append((conv, len(turns), sha(whole), len(loss), sha(loss)))
    return sorted(out, key=repr)


def written(text):
    """The escape rule by hand: walk over the characters."""
    out, at = "", 0
    while at < len(text):
        end = at + 1
        if text[at] == "<":
            while end < len(text) and text[end] == "\\":
                end += 1
            if end < len(text) and text[end] == "|":
                out, at = out + "<\\" + text[at + 1 : end] + "|", end + 1
                continue
        out, at = out + text[at], at + 1
    return out


def conversations():
    rng = random.Random(5)
    text = lambda: "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 12)))
    roles = ["user", "assistant", "system", None, "a|b\n%7C", "<|im_start|>"]
    rows = [(c, t, rng.choice(roles), text()) for c in range(60) for t in range(rng.randint(1, 7))]
    rows += [(70, 0, "user", None), (71, None, None, None), (71, None, "user", "x"), (72, 1, "assistant", "b"), (72, 1, "assistant", "a"), (72, 1, "assistant", "a")]
    return rows + [(None, 0, "user", "no id"), (None, 1, "assistant", "still"), (73, 0, "assistant", "long " * 20_000)]


def test_round_trip_equals_the_rows(spark):
    rows = conversations()
    docs = spark.createDataFrame([(*r, "s", 1) for r in rows], SCHEMA + ", segments string, turns int").repartition(7)
    found = chat.digests(docs).collect()
    assert sorted([tuple(r)[:5] for r in found], key=repr) == expected(rows)
    chars = {}
    for conv, _, role, text in rows:
        head = (role or "").replace("%", "%25").replace("\n", "%0A").replace("|", "%7C")
        chars[conv] = chars.get(conv, 0) + len(f"<|im_start|>{head}\n{written(text or '')}<|im_end|>\n")
    assert {r["conv_id"]: r["formatted_chars"] for r in found} == chars


def test_control_strings_stand_where_the_template_put_them(spark):
    docs = spark.createDataFrame([(-1, 0, "user", chat.PLANTED), (-1, 1, "assistant", chat.PLANTED)], SCHEMA)
    (row,) = chat.formatted(docs).select(chat.formatted_text(chat.F.col("segments")).alias("t"), "segments").collect()
    assert row["t"].count("<|im_start|>") == 2 and row["t"].count("<|im_end|>") == 2 and row["t"].count("<|") == 4
    assert [s["loss"] for s in row["segments"]] == [False, False, False, False, True, False]


def test_escaping_is_reversible(spark):
    rng = random.Random(6)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 9))) for _ in range(3000)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escaped(chat.F.col("t")).alias("e"))
    for row in rows.select("t", "e", chat.unescaped(chat.F.col("e")).alias("u")).collect():
        assert row["u"] == row["t"] and row["e"] == written(row["t"]) and "<|" not in row["e"]


PART = "struct<kind:string,text:string,uri:string,width:int,height:int,seconds:double,pages:int,kind_:string>"


def test_parts_become_placeholders_in_order(spark):
    def part(kind, text=None, uri=None, width=None, height=None, seconds=None, pages=None):
        return (kind, text, uri, width, height, seconds, pages, "x")

    rows = [
        (1, 0, "user", [part("text", "see <|image|>: "), part("image", uri="s://a", width=1025, height=512), part("text", " and "), part("audio", uri="s://b", seconds=2.5), part("document", pages=3)]),
        (1, 1, "assistant", [part("text", "a cat"), part("image", uri="s://c")]),
        (2, 0, "user", None),
        (2, 1, "assistant", []),
        (3, 0, "user", [None, part("video", uri="s://v"), part(None), part("text")]),
    ]
    docs = spark.createDataFrame(rows, f"conv_id long, turn long, role string, content array<{PART}>")
    got = {r["conv_id"]: r for r in chat.formatted(docs, "content").withColumn("t", chat.formatted_text(chat.F.col("segments"))).collect()}
    assert got[1]["t"] == (
        "<|im_start|>user\nsee <\\|image|>: <|image|> and <|audio|><|document|><|im_end|>\n"
        "<|im_start|>assistant\na cat<|image|><|im_end|>\n"
    )
    wanted = [(0, 1, "image", "s://a", 85 + 3 * 170), (0, 3, "audio", "s://b", 75), (0, 4, "document", None, 3072), (1, 1, "image", "s://c", 255)]
    assert [tuple(a) for a in got[1]["attachments"]] == wanted
    assert got[1]["expanded_tokens"] == sum(w[-1] for w in wanted)
    assert got[2]["t"] == "<|im_start|>user\n<|im_end|>\n<|im_start|>assistant\n<|im_end|>\n" and got[2]["attachments"] == []
    assert got[3]["t"].count("<|part|>") == 3 and got[3]["expanded_tokens"] == 0
    few = docs.select("conv_id", "turn", "role", chat.F.transform("content", lambda p: chat.F.struct(p["kind"].alias("kind"), p["text"].alias("text"))).alias("content"))
    assert chat.formatted(few, "content").count() == 3


def test_no_python_in_the_plan_and_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    found = chat.digests(empty)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and plan.count("Exchange hashpartitioning") == 1
    assert found.collect() == []
