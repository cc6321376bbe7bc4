import random
import zlib

import numpy as np

from feedloom.llm import langid

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def all_cuts(model, word):
    """Probability per language and expected pieces, over every segmentation."""
    total, counts = np.zeros(len(model.languages)), {}
    for mask in range(1 << (len(word) - 1)):
        at = [0, *[i + 1 for i in range(len(word) - 1) if mask >> i & 1], len(word)]
        parts = [word[a:b] for a, b in zip(at, at[1:])]
        ids = [model.pieces.get(p, len(model.pieces) if len(p) == 1 else None) for p in parts]
        if None in ids:
            continue
        chance = np.prod([model.probabilities[i] for i in ids], axis=0)
        total = total + chance
        for i in ids:
            counts[i] = counts.get(i, 0) + chance
    return total, {k: v / total for k, v in counts.items()}


def small_model():
    pieces = {p: i for i, p in enumerate(["a", "b", "ab", "ba", "aba"])}
    table = np.array([[0.2, 0.1], [0.1, 0.3], [0.3, 0.2], [0.2, 0.2], [0.2, 0.2], [1e-7, 1e-7]])
    return langid.Model(["x", "y"], pieces, 3, table, np.zeros(2))


def test_sums_and_expectations_equal_all_segmentations():
    model, words = small_model(), ["a", "ab", "zab", "ababaabbab", "abzzabab", "zzz", "bbbb"]
    together = langid.log_probabilities(model, words)
    for word, row in zip(words, together):
        total, counts = all_cuts(model, word)
        assert np.allclose(np.log(total), model.log_probability(word)) and np.allclose(np.log(total), row)
        for language in (0, 1):
            one = langid.expected_pieces(model, language, word)
            many = langid.Lattice(model, [word], len(word)).expected(langid._with_zero(model.probabilities)[:, language], np.array([2.0]))
            for piece, value in counts.items():
                assert abs(one[piece] - value[language]) < 1e-9 and abs(many[piece] - 2 * value[language]) < 1e-9
    long = "ab" * 60_000
    assert np.isfinite(model.log_probability(long)).all()


def corpus():
    rng, out = random.Random(6), []
    syllables = {"en": "th er on an re he in ed nd ha".split(), "de": "sch ein ung ich keit heit ver ß ö ge".split(), "fr": "é eau oi que ment eux ç tion elle ou".split()}
    for i in range(300):
        lang = rng.choice(list(syllables))
        words = ["".join(rng.choice(syllables[lang]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(5, 60))]
        out.append((i, " ".join(words), lang if rng.random() < 0.9 else None, lang))
    return out


def test_held_out_accuracy_and_defined_cases(spark, tmp_path):
    known = corpus()
    odd = [(1000, None, "en"), (1001, "", "en"), (1002, "123 -- ½ ²", None), (None, "the then", "xx"), (1003, "a" * 50_000, None), (1004, known[0][1], None), (1004, known[0][1], None)]
    rows = [(i, t, g, None, None, 1, "p") for i, t, g, _ in known] + [(i, t, g, None, None, 1, "p") for i, t, g in odd]
    docs = spark.createDataFrame(rows, SCHEMA + ", score int, lang_pred string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = langid.op3_language_id(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    truth = {i: lang for i, _, _, lang in known}
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got if r["doc_id"] is not None)
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) >= 0.97 * len(held) and len(held) > 30
    assert all(r["lang_pred"] == "und" and r["score"] == 0 for r in got if r["doc_id"] in (1000, 1001, 1002))
    assert all(0 <= r["score"] <= 1 and r["lang_pred"] in ("en", "de", "fr", "und") for r in got)
    kept = langid.keep_determined(docs, langid.train(docs))
    assert kept.columns == docs.columns
    assert {1000, 1001, 1002}.isdisjoint(r["doc_id"] for r in kept.collect())
    empty = spark.createDataFrame([], SCHEMA)
    assert langid.predictions(empty, langid.train(empty)).count() == 0
    assert langid.predictions(docs, langid.train(empty)).where("lang_pred != 'und'").count() == 0


def test_a_rare_language_is_learned(spark):
    common = [(i, f"the house and the water of the old town {i}", "en") for i in range(1500)]
    rare = [(10_000 + i, f"das haus und das wasser der alten stadt {i}", "de") for i in range(20)]
    docs = spark.createDataFrame([(i, t, g, "s", 0) for i, t, g in common + rare], "doc_id long, text string, lang string, source string, n_chars long")
    model = langid.train(docs, sample_docs=30)
    assert model.languages == ["de", "en"]
    scorer = langid.Scorer(model)
    assert [lang for lang, _ in scorer(["das alte haus und die stadt", "the old house and the town"])] == ["de", "en"]
