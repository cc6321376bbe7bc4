import hashlib
import random

from feedloom.llm import line_dedup as ld

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def longest_runs_brute(a, b):
    """Longest ascending run of lines that occur once on both sides, by trying all."""
    pairs = [(a.index(x), j) for j, x in enumerate(b) if a.count(x) == 1 and b.count(x) == 1]
    best = 0
    for mask in range(1 << len(pairs)):
        some = [p for i, p in enumerate(pairs) if mask >> i & 1]
        if all(x[0] < y[0] for x, y in zip(some, some[1:])):
            best = max(best, len(some))
    return best


def brute(docs, seed_words=ld.SEED_WORDS):
    """Texts left, from plain dictionaries; documents in order of id."""
    texts = {i: t for i, t in docs if i is not None and t is not None}
    hashes = {i: [ld.line_hash(x, seed_words) for x in t.split("\n")] for i, t in texts.items()}
    first_text, earliest, left = {}, {}, {}
    for i in sorted(texts):
        first_text.setdefault(texts[i], i)
    firsts = sorted(set(first_text.values()))
    for i in firsts:
        for h in hashes[i]:
            if h & 1:
                earliest.setdefault(h, i)
    for i in sorted(texts):
        lines = texts[i].split("\n")
        if i not in firsts:
            left[i] = ""
            continue
        gone = set()
        for other in {earliest[h] for h in hashes[i] if h & 1} - {i}:
            for start, end in ld.common_blocks(hashes[other], hashes[i]):
                gone |= set(range(start, end))
        left[i] = "\n".join(x for at, x in enumerate(lines) if at not in gone)
    return left


def documents(n=120):
    rng = random.Random(11)
    word = lambda: rng.choice("alpha beta gamma delta eps zeta eta theta iota kappa".split()) + str(rng.randint(0, 99))
    line = lambda: " ".join(word() for _ in range(rng.choice([2, 6, 8, 9])))
    passages = [[line() for _ in range(rng.randint(1, 5))] for _ in range(15)]
    common = "this very common line is in nearly every document"
    out = []
    for i in range(n):
        parts = []
        for _ in range(rng.randint(0, 4)):
            parts += [line() for _ in range(rng.randint(0, 3))] + rng.choice(passages)
        out.append("\n".join([*parts, common] if rng.random() < 0.7 else parts))
    # The same passages in other orders, and one of them twice.
    for i in range(20):
        out.append("\n".join(x for part in rng.sample(passages, 6) for x in [*part, *part[:1]]))
    out += ["\u6700\u521d\u306e\u884c\u306f\u9577\u3044\u65e5\u672c\u8a9e\u3067\u3059\n\u77ed\u3044" + end for end in ("", "\nend")]
    out += out[:30] + ["", "x", "x\n\ny", out[0] + "\n", " " + out[1], "long line of words " * 20_000, "a\n" * 30_000]
    return list(enumerate(out))


def test_alignment_is_ordered_and_anchors_are_longest():
    rng = random.Random(2)
    for _ in range(300):
        a = [rng.randint(0, 9) for _ in range(rng.randint(0, 9))]
        b = [rng.randint(0, 9) for _ in range(rng.randint(0, 9))]
        found = ld.patience(a, b)
        assert all(a[x] == b[y] for x, y in found)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(found, found[1:]))
        assert len(ld.anchors(a, b, 0, len(a), 0, len(b))) == longest_runs_brute(a, b)
    assert ld.patience([1, 2, 3, 4], [9, 1, 2, 8, 3, 4]) == [(0, 1), (1, 2), (2, 4), (3, 5)]


def test_texts_equal_brute_force(spark, tmp_path):
    docs = documents()
    rng = random.Random(1)
    rng.shuffle(docs)
    frame = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in docs], SCHEMA)
    wanted = brute(docs)
    got = {r["doc_id"]: r["text"] for r in ld.dedup_lines(frame).collect()}
    assert got == wanted
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    for row in ld.op4_line_dedup(spark, str(tmp_path)).collect():
        assert row["text_sha256"] == hashlib.sha256(wanted[row["doc_id"]].encode()).hexdigest()
        assert row["n_lines"] == len(dict(docs)[row["doc_id"]].split("\n"))


def test_seeds_stay_only_where_no_earlier_document_holds_them(spark):
    docs = documents()
    frame = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in docs], SCHEMA)
    left = {r["doc_id"]: r["text"] for r in ld.dedup_lines(frame).collect()}
    seen, seed = set(), lambda x: len(x.split()) >= 5 or not x.isascii() and len(x) >= 10
    for i, text in docs:
        own = [x.strip() for x in text.split("\n") if seed(x)]
        assert [x.strip() for x in left[i].split("\n") if seed(x)] == [x for x in own if x not in seen]
        seen |= set(own)


def test_lines_in_another_order():
    a, b, c = 3, 5, 7
    assert ld.common_blocks([a, b], [b, a, c]) == [(0, 1), (1, 2)]
    assert ld.common_blocks([a, 2, b, a], [a, a, 2]) in ([(0, 1), (1, 3)], [(0, 3)])
    assert ld.common_blocks([2, 4], [4, 2]) == []


def test_defined_cases(spark):
    schema = SCHEMA + ", gone int, parts string, whole long"
    empty = spark.createDataFrame([], schema)
    assert ld.dedup_lines(empty).count() == 0 and ld.dedup_lines(empty).columns == empty.columns
    text = "one two three four five six\nand more words to make a seed"
    rows = [(1, text), (2, text), (2, text), (None, text), (3, None), (4, ""), (2, "another text of this id here now")]
    frame = spark.createDataFrame([(i, t, None, None, None, 1, "p", 2) for i, t in rows], schema)
    got = sorted(((r["doc_id"] or 0), r["text"]) for r in ld.dedup_lines(frame).collect() if r["text"] is not None)
    kept = [t for i, t in got if i == 2]
    assert (0, text) in got and (1, text) in got and (4, "") in got and len(got) == 6
    assert kept in (["", "", "another text of this id here now"], ["another text of this id here now", text, text])
