import random
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from feedloom.llm import token_output as out

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def whole(text):
    return Tokenizer.from_file(out.vocabulary_path()).encode(text or "", add_special_tokens=False).ids


LIBRARY = Tokenizer.from_file(out.vocabulary_path())
ENCODER = out.Encoder(out.vocabulary_path())
PARTS = ["µª", "ÀÉß", "\u212b", "Ǆ", "ﬁ", "it's", "'s", "don't", "É", "İ", "ΑΣ", "e\u0301", "\u0301", " ", "\n", "\t", "\u00a0", "\x1c", "--", "!'re", "12", "½", "a1b", "<|endoftext|>", "Wörd,", "東京", "#tag", "x=y", "\u3000"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(PARTS), st.text(max_size=6)), max_size=12).map("".join))
def test_pieces_give_the_ids_of_whole_texts(text):
    ids = np.frombuffer(ENCODER(text), "<u4").tolist()
    assert ids == LIBRARY.encode(text, add_special_tokens=False).ids + [1]


def test_forgetting_changes_nothing(monkeypatch):
    monkeypatch.setattr(out, "PIECES", 5)
    monkeypatch.setattr(out, "WORDS", 4)
    encode, rng = out.Encoder(out.vocabulary_path()), random.Random(1)
    for _ in range(60):
        text = " ".join(rng.choice("one two, three Four five! six seven? (eight) nine ten".split()) for _ in range(12))
        assert np.frombuffer(encode(text), "<u4").tolist() == LIBRARY.encode(text, add_special_tokens=False).ids + [1]


def rows():
    rng = random.Random(2)
    texts = [None, "", "a", "a", "b " * 50_000, "'s", "<|startoftext|> x"] + [" ".join(rng.choice(PARTS) for _ in range(rng.randint(0, 40))) for _ in range(200)]
    out_ = [(i * 3 % 400 - 5, t) for i, t in enumerate(texts)]
    return out_ + [(4, "twice"), (4, "again"), (None, "no id")]


def test_offsets_come_from_the_files(spark, tmp_path):
    docs = spark.createDataFrame([(i, t, None, None, None, "f", 1) for i, t in rows()], SCHEMA + ", file string, ids int")
    path = f"{tmp_path}/ids"
    out.write_ids(docs, path, out.vocabulary_path())
    stored = {}
    for r in out.read_ids(spark, path).collect():
        stored.setdefault(r["doc_id"], []).append(r["ids"])
    wanted = {}
    for i, t in rows():
        wanted.setdefault(i, []).append(LIBRARY.encode(t or "", add_special_tokens=False).ids + [1])
    assert {k: sorted(v) for k, v in stored.items()} == {k: sorted(v) for k, v in wanted.items()}
    got = sorted(out.tokenized(docs).collect(), key=lambda r: r["start"])
    at = 0
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
        ids = [x for x in wanted[r["doc_id"]] if zlib.crc32(np.array(x, "<u4").tobytes()) == r["ids_crc32"]]
        assert len(ids[0]) == r["n_tokens"]
    order = [r["doc_id"] for r in got]
    assert len(got) == len(rows()) and order[0] is None and order[1:] == sorted(order[1:])
    one = out.read_ids(spark, path).where("doc_id = 4")
    assert one.count() == len(wanted[4]) > 2 and "EqualTo(doc_id,4)" in one._jdf.queryExecution().toString()
    assert out.tokenized(spark.createDataFrame([], SCHEMA)).count() == 0
