import random
import re

import numpy as np
from xxhash import xxh64_intdigest

from feedloom.llm import simhash
from feedloom.llm.components import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def brute_fingerprint(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0d]+", lowered)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_roots(nodes, linked):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a in nodes:
        for b in nodes:
            if a < b and linked(a, b):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {n: find(n) for n in nodes}


def texts():
    rng = random.Random(5)
    words = ["w%d" % i for i in range(400)] + ["É", "ÀB", "x\x0by", "東京", "Ab"]
    base = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 400))) for _ in range(25)]
    out = list(base)
    for text in base:
        parts = text.split(" ")
        for _ in range(4):
            near = list(parts)
            near[rng.randrange(len(near))] = rng.choice(words)
            out.append(" ".join(near).upper() if rng.random() < 0.3 else " ".join(near))
    return out + ["", None, " \t\n", "one", "one two", "ONE two", "a" * 200_000, "w " * 60_000]


def test_groups_equal_brute_force(spark):
    rows = [(i, t) for i, t in enumerate(texts())] + [(3, texts()[3])]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA)
    prints = {i: brute_fingerprint(t) for i, t in rows}
    wanted = brute_roots(sorted(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 2)
    for hot in (simhash.HOT, 0):
        got = simhash.groups(docs, hot=hot).collect()
        assert len(got) == len(rows)
        for row in got:
            assert row["fp"] % 2**64 == prints[row["doc_id"]]
            assert row["component_id"] == wanted[row["doc_id"]]
    kept = sorted(row["doc_id"] for row in simhash.keep_first(docs).collect())
    assert kept == sorted(set(wanted.values()))


def test_links_cover_every_pair_within_the_threshold(spark):
    rng = random.Random(7)
    seeds = [rng.getrandbits(64) for _ in range(12)]
    prints = set(seeds)
    for s in seeds:
        for _ in range(60):
            prints.add(s ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    near = [(s ^ 1 << i) for i in range(64) for s in seeds[:1]]  # a dense group for the forest
    prints = sorted(prints | set(near))
    wanted = brute_roots(prints, lambda a, b: (a ^ b).bit_count() <= 2)
    signed = lambda x: int(np.uint64(x).view(np.int64))
    fps = spark.createDataFrame([(signed(x),) for x in prints], "fp long")
    for hot in (simhash.HOT, 3):
        pairs = simhash.links(fps, hot=hot).collect()
        assert all(((p["a"] ^ p["b"]) % 2**64).bit_count() <= 2 for p in pairs)
        assert len(pairs) < 40 * len(prints)
        roots = {r["node"]: r["root"] for r in components(simhash.links(fps, hot=hot)).collect()}
        classes = lambda m: sorted(sorted(k for k in m if m[k] == r) for r in set(m.values()))
        full = {signed(x): roots.get(signed(x), signed(x)) for x in prints}
        assert classes(full) == classes({signed(k): signed(v) for k, v in wanted.items()})


def test_components_of_paths_stars_and_nothing(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (None, 3), (200, 199)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}, 199: 199, 200: 199}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_defined_cases(spark):
    schema = SCHEMA + ", fp long, _id string, component_id int"
    empty = spark.createDataFrame([], schema)
    assert simhash.groups(empty).count() == 0
    assert simhash.keep_first(empty).columns == empty.columns
    rows = [(1, None), (2, ""), (None, "a b c d"), (4, "a b c d"), (4, "a b c d"), (None, None)]
    docs = spark.createDataFrame([(i, t, None, None, None, 1, "x", 2) for i, t in rows], schema)
    got = sorted((r["doc_id"] or 0, r["component_id"]) for r in simhash.groups(docs).collect())
    assert got == [(0, 1), (0, 4), (1, 1), (2, 1), (4, 4), (4, 4)]
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 0, 1, 4]
