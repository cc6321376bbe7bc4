import hashlib
import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from feedloom.llm import token_align as align

A, B = align.vocabulary_path("byte_bpe_50k.json"), align.vocabulary_path("piece_bpe_32k.model")
VOC = align.vocabularies(A, B)
FIND = align.Aligner(A, B)
PARTS = ["thstion", "errors", "don't", "'s", ",", ".", "...", "\n", "\n\n", " ", "  ", "\t", " ", "\x1c", "Wörd,", "東京", "é", "é", "́", "12", "3.5", "a.b", "▁", "<0x41>", "<|endoftext|>", "<s>", "</s>", "🙂", "\x00", "x\n y", "(a)", "　", "A"]
TEXTS = st.lists(st.one_of(st.sampled_from(PARTS), st.text(max_size=5)), max_size=14).map("".join)


def tokens(text):
    """Ids and byte ends of both tokenizers by the plain libraries; None where the bytes differ."""
    a = Tokenizer.from_file(A) if not hasattr(tokens, "a") else tokens.a
    tokens.a = a
    a.encode_special_tokens = True
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, VOC.b.encode(text)
    raw = (" " + text).encode()
    if b"".join(VOC.a_bytes[i] for i in ids_a) != raw or b"".join(VOC.b_bytes[i] for i in ids_b) != raw:
        return None
    return ids_a, ids_b


def spans(ids, sizes):
    at, out = 0, []
    for i in ids:
        out.append((at, at + len(sizes[i]), i))
        at = out[-1][1]
    return out


def brute(text):
    """(n_a, n_b, groups as text, links) by comparing all byte ranges."""
    found = tokens(text) if text else None
    if found is None:
        return 0, 0, [], []
    a, b = spans(found[0], VOC.a_bytes), spans(found[1], VOC.b_bytes)
    ends = sorted({y for _, y, _ in a} & {y for _, y, _ in b})
    groups, start = [], 0
    for end in ends:
        groups.append(",".join(str(i) for x, y, i in a if start <= x and y <= end) + "|" + ",".join(str(i) for x, y, i in b if start <= x and y <= end))
        start = end
    links = [(i, j) for x, y, i in a for u, v, j in b if x < v and u < y]
    return len(a), len(b), groups, links


@settings(max_examples=400, deadline=None)
@given(TEXTS)
def test_pieces_give_the_groups_of_whole_texts(text):
    if not text:
        return
    (records,) = FIND([text])
    n_a, n_b, groups, links = brute(text)
    if not groups:
        assert align.ODD in records
        return
    found, rest = align.joined(records), Counter()
    rest.update((i, int(VOC.identity[i])) for i in align.np.frombuffer(found[1], "<i4").tolist())
    rest.update(divmod(k, VOC.b_size) for k in align.np.frombuffer(found[2], VOC.key_type).tolist())
    assert said(records) == ";".join(groups) and rest == Counter(links)
    columns = align._of_text([records], align.np.dtype(VOC.key_type).itemsize)
    assert columns[:5] == (n_a, n_b, len(groups), len(links), hashlib.sha256(said(records).encode()).hexdigest())


def said(records):
    """The groups of a text; none if its tokens do not give its bytes."""
    return align.joined(records)[0].decode().replace("/", ",")


def corpus():
    rng = random.Random(3)
    texts = [None, "", " ", "a", "a", "▁", "<|endoftext|> <s>", "x" * 3000, "word " * 4000, "日本語" * 500]
    texts += ["".join(rng.choice([*PARTS, " ", " ", " "]) for _ in range(rng.randint(1, 60))) for _ in range(150)]
    return [(i // 2 if i % 7 else None, t) for i, t in enumerate(texts)]


def expected(rows):
    found = [brute(t) for _, t in rows]
    count = Counter(link for *_, links in found for link in links)
    most = Counter()
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    out = []
    for (doc_id, _), (n_a, n_b, groups, links) in zip(rows, found):
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        best = sum(count[link] == most[link[1]] for link in links)
        out.append((doc_id, n_a, n_b, len(groups), len(links), best, sum(count[link] for link in links), digest))
    return sorted(out, key=repr)


@pytest.mark.parametrize("shares", [1 << 17, 40, 1])
def test_scores_equal_brute_force(spark, monkeypatch, shares):
    """With all, some and almost no irregular pairs in the broadcast table."""
    monkeypatch.setattr(align, "SLICE", 200)
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "r", 1, "k") for i, t in rows], "doc_id long, text string, row string, n int, key string")
    got = align.Alignment(docs.repartition(5), A, B).scores(shares)
    assert sorted(map(tuple, got.collect()), key=repr) == expected(rows)


def test_whole_texts_without_cuts(spark, monkeypatch):
    rows = corpus()[:40]
    want = expected(rows)
    monkeypatch.setattr(VOC, "cuts", False)
    digests = [hashlib.sha256(said(FIND([t])[0]).encode()).hexdigest() if said(FIND([t])[0]) else "" for _, t in rows if t]
    assert sorted(d for d in digests if d) == sorted(w[-1] for w in want if w[-1])


def test_slices_end_at_cuts():
    rng = random.Random(8)
    for size in (1, 7, 40):
        text = " ".join(rng.choice([*PARTS, "one", "two,"]) for _ in range(60))
        cut = list(align.slices(text, size))
        found = FIND(cut)
        assert " ".join(cut) == text and len(cut) > 1
        assert said([r for part in found for r in part]) == ";".join(brute(text)[2])


def test_forgetting_changes_nothing(monkeypatch):
    monkeypatch.setattr(align, "PIECES", 4)
    monkeypatch.setattr(align, "WORDS", 3)
    find, rng = align.Aligner(A, B), random.Random(4)
    for _ in range(40):
        texts = [" ".join(rng.choice("one, two three. four five\nsix seven! eight".split(" ")) for _ in range(9)) for _ in range(3)]
        for text, records in zip(texts, find(texts)):
            assert said(records) == ";".join(brute(text)[2])


def test_empty_table_and_vocabulary_tests(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert align.Alignment(empty, A, B).scores().collect() == []
    assert VOC.cuts and not VOC._cuts({"pre_tokenizer": None, "added_tokens": [], "normalizer": None, "model": {"type": "BPE"}})
