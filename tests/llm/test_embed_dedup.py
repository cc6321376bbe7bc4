import numpy as np

from feedloom.llm import embed_dedup as ed

SCHEMA = "vec_id long, embedding array<float>, label int"


def vectors(size=48):
    rng = np.random.default_rng(8)
    base = rng.standard_normal((60, size))
    rows = []
    for i, v in enumerate(base):
        rows.append(v)
        for _ in range(4 if i else 150):
            noise = rng.standard_normal(size)
            noise -= noise @ v / (v @ v) * v
            target = rng.uniform(0.86, 0.99)
            rows.append((v / np.linalg.norm(v) * target + noise / np.linalg.norm(noise) * np.sqrt(1 - target**2)) * rng.uniform(0.1, 9))
    rows = [[float(x) for x in np.float32(v)] for v in rows]
    rows += [rows[0]] * 5 + [[x * 4 for x in rows[1]]]
    bad = [None, [], [0.0] * size, [float("nan")] * size, [float("inf")] + rows[0][1:], [None] + rows[0][1:], rows[0][:10]]
    return rows + bad


def brute(rows, threshold=0.9):
    def unit(v):
        if v is None or not v or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            return None
        v = np.array(v, dtype=np.float64)
        return v / np.linalg.norm(v)

    units, n = [unit(v) for v in rows], len(rows)
    near = [[i != j and a is not None and b is not None and len(a) == len(b) and a @ b >= threshold for j, b in enumerate(units)] for i, a in enumerate(units)]
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(n):
        for j in range(i):
            if near[i][j]:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [(i, sum(near[i]), find(i), find(i) == i) for i in range(n)]


def test_links_and_components_equal_brute_force(spark):
    rows = vectors()
    frame = spark.createDataFrame([(i, v, None, "x", 1) for i, v in enumerate(rows)], SCHEMA + ", id string, vector int")
    for block in (ed.BLOCK, 20):
        got = sorted(tuple(r) for r in ed.near_duplicates(frame, block=block).collect())
        assert got == brute(rows)


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(3)
    units = ed._units(rng.standard_normal((400, 64)))
    units[200:] = ed._units(units[:200] + 0.05 * rng.standard_normal((200, 64)))
    turn = ed.rotation(64)
    assert np.allclose(turn.T @ turn, np.eye(64))
    guess, bound = ed.estimates(*ed.encode(units, turn), units, turn)
    error = guess - units @ units.T
    off = ~np.eye(400, dtype=bool)
    assert abs(error[off].mean()) < 0.002 and (np.abs(error) <= bound[:, None]).mean() > 0.9999


def test_recall_of_the_tables_at_the_threshold():
    rng = np.random.default_rng(5)
    a = ed._units(rng.standard_normal((3000, 64)))
    noise = rng.standard_normal(a.shape)
    noise -= (noise * a).sum(axis=1, keepdims=True) * a
    b = a * 0.9 + ed._units(noise) * np.sqrt(1 - 0.81)
    turn = ed.rotation(64)
    for n in (50_000, 10_000_000):
        width, tables = ed.layout(n, 0.9, ed.RECALL)
        places = ed.key_bits(turn.shape[0], width, tables)
        same = ed.keys_of(ed.encode(a, turn)[0], places) == ed.keys_of(ed.encode(b, turn)[0], places)
        assert same.any(axis=1).mean() >= 0.97


def test_repeated_ids_and_empty(spark):
    assert ed.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    v, w = [1.0, 0.0], [0.0, 1.0]
    frame = spark.createDataFrame([(1, v, 0), (1, v, 0), (1, w, 0), (None, v, 0), (None, None, 0)], SCHEMA)
    got = sorted(((r["vec_id"] or 0), r["n_links"], r["component_id"] or 0) for r in ed.near_duplicates(frame).collect())
    assert got == [(0, 0, 0), (0, 2, 1), (1, 0, 1), (1, 2, 1), (1, 2, 1)]
