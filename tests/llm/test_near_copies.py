import random

import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F
from feedloom.llm import near_copies, simhash
from tests.llm.test_simhash import brute_fingerprint, brute_roots

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def brute_shingles(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_linked(a, b):
    union = len(a | b)
    return 10 * len(a & b) >= 8 * union


def texts():
    rng, out = random.Random(8), []
    word = lambda: "w%d" % rng.randint(0, 2000)
    for size in (3, 30, 120, 200, 300):
        base = [word() for _ in range(size)]
        out.append(" ".join(base))
        for edits in range(1, 9):
            near = list(base)
            for _ in range(edits):
                near[rng.randrange(size)] = word()
            out.append(" ".join(near).upper() if edits == 2 else " ".join(near))
    for _ in range(40):
        base = [word() for _ in range(25)]
        out.append(" ".join([*base, *[word() for _ in range(rng.randint(0, 8))]]))
    # A family that shares most of its text, below the similarity, with a few near copies inside.
    common = [word() for _ in range(80)]
    for i in range(20):
        own = [*common, *[word() for _ in range(30)]]
        out += [" ".join(own), " ".join([*own, word()])] if i % 4 == 0 else [" ".join(own)]
    return out + ["", None, " ", "one", "ONE"]


def test_stage_equals_brute_jaccard(spark, tmp_path):
    rows = list(enumerate(texts()))
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA)
    sets = {i: brute_shingles(t) for i, t in rows}
    roots = brute_roots(sorted(sets), lambda a, b: brute_linked(sets[a], sets[b]))
    stage = dict(corpus_pipeline.STAGES)["simhash_dedup"]
    assert sorted(r["doc_id"] for r in stage(spark, docs, str(tmp_path)).collect()) == sorted(set(roots.values()))
    pairs = [(a, b) for a in sets for b in sets if a < b and sets[a] != sets[b] and brute_linked(sets[a], sets[b])]
    prints = {i: brute_fingerprint(t) for i, t in rows}
    assert sum((prints[a] ^ prints[b]).bit_count() > simhash.THRESHOLD for a, b in pairs) > 20
    for stars in (0, 1):
        kept = near_copies.groups(docs, stars=stars).where("first").collect()
        assert sorted(r["doc_id"] for r in kept) == sorted(set(roots.values()))


def test_defined_cases(spark):
    schema = SCHEMA + ", whole int, _id string, n long, first int"
    empty = spark.createDataFrame([], schema)
    assert near_copies.keep_first(empty).count() == 0
    assert near_copies.keep_first(empty).columns == empty.columns
    rows = [(1, None), (2, ""), (None, "a b c d"), (4, "a b c d"), (4, "a b c d"), (None, None), (4, "another text"), (None, "lone"), (None, "lone")]
    docs = spark.createDataFrame([(i, t, None, None, None, 1, "x", 2, 3) for i, t in rows], schema)
    kept = near_copies.keep_first(docs)
    assert kept.columns == docs.columns
    found = sorted(((r["doc_id"] or 0, r["text"]) for r in kept.collect()), key=repr)
    assert found == [(0, "lone"), (1, None), (4, "a b c d"), (4, "another text")]


def as_sets(spark, found):
    """(rest, sets) of lists of shingle numbers; every class is in a group of its own."""
    rows = [(i, len(x), i, np.unique(np.array(sorted(x), np.uint64)).tobytes()) for i, x in enumerate(found)]
    table = spark.createDataFrame(rows, "node long, n int, label long, hashes binary")
    return table.select("node", "n", "label"), table.select("node", "hashes")


def test_rest_pairs_hold_every_similar_pair(spark):
    rng, found = random.Random(3), [set(), set(), {5}, {5}, {5, 6}]
    for _ in range(60):
        base = set(rng.sample(range(1, 400), rng.randint(3, 30)))
        found += [base, base - {min(base)}, base | {rng.randint(400, 900)}]
    rest, sets = as_sets(spark, found)
    got = {(r["a"], r["b"]) for r in near_copies.rest_pairs(rest, sets, 0.8).collect()}
    similar = {(a, b) for a in range(len(found)) for b in range(a + 1, len(found)) if brute_linked(found[a], found[b])}
    assert len(similar) > 120 and similar <= got
    # Classes of one group are not compared again.
    assert near_copies.rest_pairs(rest.withColumn("label", F.lit(0).cast("long")), sets, 0.8).count() == 0


def test_family_below_the_similarity_gives_few_pairs(spark):
    rng, size = random.Random(4), 1500
    common = set(range(1, 101))
    # 100 of 121 shingles are common to all: a similarity of 0.70 for every pair; every tenth text has a near copy.
    found = [common | {1000 + 21 * i + k for k in range(21)} for i in range(size)]
    near = [(i, size + k) for k, i in enumerate(range(0, size, 10))]
    found += [(found[i] - {rng.choice(sorted(found[i]))}) | {10**6 + k} for k, (i, _) in enumerate(near)]
    rest, sets = as_sets(spark, found)
    got = [(r["a"], r["b"]) for r in near_copies.rest_pairs(rest, sets, 0.8).collect()]
    assert set(near) <= set(got) and len(got) < len(found)


def test_stage_links_by_simhash_and_decides_exactly(spark, monkeypatch):
    rng = random.Random(9)
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(600)]
    near = [" ".join([*base, "end"]), " ".join(base[1:])]
    far = [" ".join(f"v{rng.randint(0, 10**6)}" for _ in range(600)) for _ in range(3)]
    rows = [(i, t) for i, t in enumerate([" ".join(base), *near, *far])]
    sets = [near_copies.shingle_hashes(t.encode()) for _, t in rows]
    fps = [simhash.majority(found) for found in sets]
    assert max((fps[0] ^ fps[i]).bit_count() for i in (1, 2)) <= simhash.THRESHOLD
    # No two classes share a band; the fourth is given the fingerprint of the first, which its shingles do not bear out.
    fps[3] = fps[0]
    signed = lambda x: int(np.uint64(x).view(np.int64))
    classes = spark.createDataFrame([(i, len(s), signed(f), [i]) for i, (s, f) in enumerate(zip(sets, fps))], "node long, n int, fp long, keys array<long>")
    texts = spark.createDataFrame(rows, "node long, text string").select("node", F.col("text").cast("binary").alias("text"))
    proposed = {(r["a"], r["b"]) for r in near_copies.proposals(classes).collect()}
    assert (0, 3) in proposed and all(b < 4 for _, b in proposed)
    found = near_copies.links(classes, lambda nodes: texts.join(nodes, "node", "left_semi")).collect()
    ends = {i for r in found for i in (r["a"], r["b"])}
    assert ends == {0, 1, 2}

    calls, plain = [], simhash.links
    monkeypatch.setattr(simhash, "links", lambda *args, **kwargs: calls.append(args) or plain(*args, **kwargs))
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA)
    kept = dict(corpus_pipeline.STAGES)["simhash_dedup"](spark, docs, "")
    assert calls and sorted(r["doc_id"] for r in kept.collect()) == [0, 3, 4, 5]
