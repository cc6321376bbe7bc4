import hashlib
import random

from feedloom.llm import mixing
from feedloom.llm.mixing import Mix

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def share(budget, children):
    """Water level by filling: children {name: (capacity, weight)}; whole numbers, rounded down at the end."""
    left, full, active = budget, {}, {n: c for n, c in children.items() if c[1] > 0}
    while True:
        weight = sum(w for _, w in active.values())
        over = [n for n, (c, w) in active.items() if c * weight <= left * w]
        if not over:
            break
        first = min(over, key=lambda n: (active[n][0] / active[n][1], n))
        full[first] = active.pop(first)[0]
        left -= full[first]
    weight = sum(w for _, w in active.values())
    return full | {n: left * w // weight for n, (c, w) in active.items()}


def brute(docs, mix):
    rows = [(i, mix.domains.get(s or "none", mix.other_domain), g or "none", s or "none", len((t or "").encode().split())) for i, t, g, s in docs]
    leaves = {}
    for _, *leaf, n in rows:
        leaves[tuple(leaf)] = leaves.get(tuple(leaf), 0) + n
    capacity = lambda path: sum(n for leaf, n in leaves.items() if leaf[: len(path)] == path) * mix.max_epochs
    budgets = {(): sum(leaves.values()) * mix.budget_num // mix.budget_den}
    for depth, level in enumerate(mixing.LEVELS, 1):
        nodes = {leaf[:depth] for leaf in leaves}
        for parent in {node[:-1] for node in nodes}:
            own = {n[-1]: (capacity(n), mix.weights(level).get(n[-1], 1)) for n in nodes if n[:-1] == parent}
            for name, value in share(budgets.get(parent, 0), own).items():
                budgets[(*parent, name)] = value
    out = []
    for leaf, total in leaves.items():
        budget = budgets.get(leaf, 0)
        own = [r for r in rows if tuple(r[1:4]) == leaf]
        epochs, rest = divmod(budget, total) if total and budget else (0, 0)
        place = lambda r: hashlib.md5(f"{mix.seed}:{epochs}:{'null' if r[0] is None else r[0]}".encode()).hexdigest()
        for r in own:
            start = sum(o[4] for o in own if place(o) < place(r))
            out.append((r[0], *leaf, r[4], epochs + (start < rest) if total and budget else 0))
    return sorted(out, key=repr), budgets


def documents(n=400):
    rng = random.Random(9)
    out = []
    for i in range(n):
        source = rng.choice(["src0"] * 12 + [f"src{k}" for k in range(1, 9)] + [None])
        text = rng.choice([None, "", "a\x0bb c"] + ["w " * rng.randint(1, 60)] * 20)
        out.append((i, text, rng.choice(["en", "en", "de", "fr", None]), source))
    return out + [out[3], out[4], (None, "x y z", "en", "src0"), (None, "x y", "en", "src0")]


MIXES = [
    mixing.PRODUCTION,
    Mix(domains={"src1": "a", "src2": "a", "src3": "b"}, domain_weights={"a": 5, "web": 1}, source_weights={"src2": 0}, max_epochs=3, budget_num=2),
    Mix(budget_num=1, budget_den=7, lang_weights={"en": 1, "de": 100}, max_epochs=1),
    Mix(budget_num=50, max_epochs=2),
]


def test_copies_equal_brute_force(spark):
    docs = documents()
    frame = spark.createDataFrame([(i, t, g, s, 0) for i, t, g, s in docs], SCHEMA)
    for mix in MIXES:
        wanted, _ = brute(docs, mix)
        got = sorted((tuple(r) for r in mixing.counted(frame, mix).collect()), key=repr)
        assert got == wanted
        mixed = mixing.mix_documents(frame, mix)
        assert mixed.columns == frame.columns and mixed.count() == sum(r[-1] for r in wanted)


def test_shortage_goes_to_siblings_before_ancestors():
    docs = [(0, "w " * 10, "en", "s1"), (1, "w " * 90, "en", "s2"), (2, "w " * 100, "de", "s3")]
    _, budgets = brute(docs, Mix(max_epochs=1, budget_num=1, budget_den=2))
    assert budgets[("web", "en", "s1")] == 10 and budgets[("web", "en", "s2")] == 40 and budgets[("web", "de", "s3")] == 50


def test_large_leaves_keep_the_budget(spark):
    for unit in (1, 10**12, 10**15 + 1):
        leaves = spark.createDataFrame([("web", "en", "s1", 15 * unit), ("web", "en", "s2", 10 * unit)], "domain string, lang string, source string, tokens long")
        found = mixing.budgets(leaves, Mix(max_epochs=1, budget_num=9, budget_den=10)).collect()
        total = 25 * unit * 9 // 10
        assert {r["source"]: r["budget"] for r in found} == {"s1": total - 10 * unit, "s2": 10 * unit}


def test_empty_and_clashing(spark):
    schema = SCHEMA + ", domain int, copies string, packed int"
    assert mixing.counted(spark.createDataFrame([], schema)).count() == 0
    frame = spark.createDataFrame([(1, "a b", "en", "s", 0, 1, "c", 2)], schema)
    assert mixing.mix_documents(frame, Mix(budget_num=2)).collect() == frame.collect() * 2
