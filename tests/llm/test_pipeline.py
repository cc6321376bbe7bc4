import random

import corpus_pipeline
from feedloom.llm import decontaminate, langid, mixing, simhash
from tests.llm.test_decontaminate import brute as brute_hits
from tests.llm.test_langid import corpus
from tests.llm.test_mixing import brute as brute_mix
from tests.llm.test_simhash import brute_fingerprint, brute_roots
from tests.llm.test_token_output import LIBRARY

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_equal_brute_force(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, t, g, rng.choice(["src0", "src3", "src9", "src15", None]), 0) for i, t, g, _ in corpus()]
    rows += [(1000 + i, *rows[i][1:]) for i in range(40)] + [rows[7]]
    bench = [(i, " ".join(rows[i][1].split()[:12])) for i in (50, 51)] + [(99, None)]
    rows += [(2000, None, "en", "src0", 0), (2001, "12 34", None, None, None), (2002, "x " + rows[52][1] + " " + bench[0][1] + " y", "en", "src0", 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    kept = []
    stages = dict(corpus_pipeline.STAGES)
    found = stages["language_id"](spark, docs, str(tmp_path))
    assert found.columns == docs.columns
    score = langid.Scorer(langid.train(docs))
    for row in rows:
        lang, value = score([row[1]])[0]
        if lang != "und" and value >= corpus_pipeline.LEAST_POSTERIOR:
            kept.append(row)
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(kept, key=repr)

    found = stages["simhash_dedup"](spark, spark.createDataFrame(kept, SCHEMA), str(tmp_path))
    prints = {r[0]: brute_fingerprint(r[1]) for r in kept}
    roots = brute_roots(sorted(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= simhash.THRESHOLD)
    kept = list({r[0]: r for r in kept if roots[r[0]] == r[0]}.values())
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(kept, key=repr)

    found = stages["decontamination"](spark, spark.createDataFrame(kept, SCHEMA), str(tmp_path))
    bad = {i for i, *_, hit in brute_hits([(r[0], r[1]) for r in kept], bench, decontaminate.WINDOW) if hit}
    assert bad
    kept = [r for r in kept if r[0] not in bad]
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(kept, key=repr)

    found = stages["mixing"](spark, spark.createDataFrame(kept, SCHEMA), str(tmp_path))
    copies = {r[0]: r[-1] for r in brute_mix([r[:4] for r in kept], mixing.PRODUCTION)[0]}
    kept = [r for r in kept for _ in range(copies[r[0]])]
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(kept, key=repr)

    last = sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "start", "n_tokens").collect()), key=lambda r: r[1])
    at, wanted = 0, []
    for doc_id, text, *_ in sorted(kept, key=lambda r: r[0]):
        n = len(LIBRARY.encode(text, add_special_tokens=False).ids) + 1
        wanted.append((doc_id, at, n))
        at += n
    assert last == wanted


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
