import numpy as np
import pytest
from pyspark.sql import functions as F

from feedloom import rules
from feedloom.functions import text
from feedloom.functions.scoring import TEXT_WORDS, scan
from feedloom.functions.text import words_found, words_in


def test_words_in_long_texts_equal_words_found(spark):
    words = (*TEXT_WORDS, "é", "日本", "a b", "it's", "back\\slash")
    texts = [None, "", " ", "é", "café 日本語", "a  b", "a b", "it's back\\slash", "x" * 5_000 + words[3], words[0][:-1]]
    texts += [f"{a}{b}{a}" for a, b in zip(words, words[1:])] + ["\u0000" + words[1] + "\u0000", "😀" + words[2]]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string")
    rows = rows.unionByName(spark.range(1).select((F.col("id") - 1).alias("i"), F.expr("cast(X'ff6120622fc3' as string)").alias("t")))
    both = rows.select(words_in(F.col("t"), words).alias("a"), words_found("t", words).alias("b")).collect()
    assert len(both) == len(texts) + 1 and all(r.a == r.b for r in both)
    assert sum(len(r.a) for r in both) > len(words)


def test_the_scan_of_a_text_is_one_pass(spark):
    """The long text is not looked through once per word in the JVM; only the guard of the years is left there."""
    schema = "title string, description_text string, location_text string, is_remote boolean"
    plan = scan(spark.createDataFrame([("a", "b", "c", True)], schema), rules.Profile())._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    assert "contains(_text" not in plan


@pytest.mark.parametrize("block", [1, 3, 64, 1 << 20])
def test_hits_equal_a_plain_search(block, monkeypatch):
    monkeypatch.setattr(text, "BLOCK", block)
    rng = np.random.default_rng(5)
    needles = [b"a", b"ab", b"abc", b"aa", b"aaaa", b"ba", b"cab", b"\x00\x00", b"abcabca"]
    for n in (0, 1, 2, 7, 300):
        data = rng.integers(97, 100, n).astype(np.uint8)
        found = {i: set() for i in range(len(needles))}
        for i, places in text.hits(data, needles):
            found[i] |= {int(p) for p in places if p + len(needles[i]) <= n}
        wanted = {i: {p for p in range(n) if data.tobytes()[p : p + len(w)] == w} for i, w in enumerate(needles)}
        assert found == wanted
