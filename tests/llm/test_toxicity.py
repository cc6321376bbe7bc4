import random

from feedloom.llm import toxicity as tox

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"


def test_automaton_equals_plain_distances():
    rng = random.Random(1)
    terms = [tox.Term(x, False) for x in ("idiot", "moron", "scum", "pathetic", "disgusting", "abcab")]
    terms += [tox.Term("abcdefg", True), tox.Term("bomente", True), tox.Term("idi", True)]
    matcher = tox.Matcher(terms)
    for _ in range(5000):
        word = list(rng.choice(terms).text + rng.choice(["", "", "x", "er"]))
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(word)) if word else 0
            kind = rng.randint(0, 3)
            if kind == 0 and word:
                word[at] = rng.choice("abcdefgiot")
            elif kind == 1:
                word.insert(at, rng.choice("abcdeiot"))
            elif kind == 2 and word:
                del word[at]
            elif at + 1 < len(word):
                word[at], word[at + 1] = word[at + 1], word[at]
        word = "".join(word)
        assert matcher.match(word) == tox.distance_match(terms, word), word


def corpus(n=900):
    rng = random.Random(12)
    syllables = "th er on an re he in ed nd ha st ou".split()
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    bad, stems = ["idiot", "pathetic", "worthless", "scum"], ["zuwider"]
    docs, labels, truth = [], [], {}
    for i in range(n):
        words = [word() for _ in range(rng.randint(20, 80))]
        toxic = rng.random() < 0.25
        if toxic:
            for _ in range(rng.randint(2, 4)):
                term = rng.choice(bad) if i % 3 else rng.choice(stems) + rng.choice(syllables)
                words.insert(rng.randrange(len(words)), term)
        docs.append((i, " ".join(words)))
        truth[i] = int(toxic)
        if rng.random() < 0.8:
            labels.append((i, 1, int(toxic)))
    return docs, labels + [(None, 1, 1), (5, 1, None), (10**9, 1, 0)], truth


def test_held_out_and_misspelled(spark, tmp_path):
    docs, labels, truth = corpus()
    text = docs[2][1]
    odd = [(2000, None), (2001, ""), (2002, text + " idoit"), (2003, text + " wortlhess, PATHETIK!"), (2004, "x" * 100_000), (2005, text), (2005, text)]
    frame = spark.createDataFrame([(i, t, None, None, None, 1) for i, t in docs + odd], SCHEMA + ", score int")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    rows = tox.op8_toxicity(spark, str(tmp_path)).collect()
    got = {r["doc_id"]: r for r in rows}
    assert len(rows) == len(docs) + len(odd)
    held = [r for r in rows if r["held_out"] and r["doc_id"] in truth]
    right = sum(r["predicted"] == truth[r["doc_id"]] for r in held)
    assert right >= 0.97 * len(held)
    assert got[2003]["predicted"] == 1 and got[2002]["score"] > got[2005]["score"]
    assert got[2000]["score"] == got[2001]["score"] and got[2000]["predicted"] == 0


def test_quotation_weighs_less():
    model = tox.Model([tox.Term("idiot", False)], {(0, 0): 5.0, (0, 1): 3.0}, quoted=-2.0, near=1.0)
    reader = tox.Reader(model.terms)
    plain, _ = reader.hits("you are an idiot really")
    quoted, n = reader.hits("they wrote \"what an idiot\" in a letter")
    assert plain == [(0, 0, 0, 0)] and quoted == [(0, 0, 1, 0)] and n == 8
    assert model.features(quoted, n)[0] < model.features(plain, n)[0]
    assert reader.hits("idiot idiot")[0] == [(0, 0, 0, 1)] and reader.hits(None) == ([], 0)


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "idiot", None, None, None)], SCHEMA)
    none = spark.createDataFrame([], LABELS)
    assert [r["score"] < 0.01 for r in tox.scores(docs, tox.train(docs, none)).collect()] == [True]
    assert tox.scores(spark.createDataFrame([], SCHEMA), tox.Model()).count() == 0
