import hashlib
import random
import re

from feedloom.llm import decontaminate as dc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, n=10):
    out = []
    for doc_id, text in docs:
        own, hit, names = words(text), set(), set()
        for item_id, item in items:
            found = words(item)
            size = min(n, len(found))
            grams = {tuple(found[i : i + size]) for i in range(len(found) - size + 1)} if size else set()
            for i in range(len(own) - size + 1) if size else ():
                if tuple(own[i : i + size]) in grams:
                    hit |= set(range(i, i + size))
                    if item_id is not None:
                        names.add(str(item_id))
        digest = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
        out.append((doc_id, len(own), len(hit), len(names), digest, bool(hit)))
    return sorted(out, key=repr)


def tables(seed=4):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)] + ["É", "é", "ΑΣ", "ας", "K", "2024", "İx"]
    say = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    items = [(i, say(rng.choice([1, 2, 3, 5, 7, 9, 10, 11, 25, 40]))) for i in range(25)]
    items += [(100, None), (101, ""), (102, "!!"), (103, items[0][1]), (None, say(12)), (7, say(14))]
    docs = []
    for i in range(150):
        parts = [say(rng.randint(0, 25))]
        for _ in range(rng.randint(0, 3)):
            found = rng.choice(items)[1] or ""
            cut = found.split(" ")
            cut = cut[rng.randint(0, 2) : len(cut) - rng.randint(0, 2)]
            parts += [rng.choice([", ", " - ", "\n", "..."]).join(cut).upper(), say(rng.randint(0, 12))]
        docs.append((i, " ".join(parts)))
    return docs + [(900, None), (901, ""), (902, " .,"), (None, docs[3][1]), (5, docs[5][1]), (903, "w1 " * 40_000 + items[9][1])], items


def frames(spark, docs, items, more=""):
    extra = (1, "x") if more else ()
    docs = spark.createDataFrame([(i, t, "en", "s", 0, *extra) for i, t in docs], SCHEMA + more)
    return docs, spark.createDataFrame(items, "item_id long, text string")


def test_report_equals_brute_force(spark):
    docs, items = tables()
    frame, bench = frames(spark, docs, items, ", hit int, parts string")
    got = sorted((tuple(r) for r in dc.report(frame, bench).collect()), key=repr)
    assert got == brute(docs, items)
    clean = dc.drop_documents(frame, bench)
    assert clean.columns == frame.columns
    kept = {i for i, *_, bad in brute(docs, items) if not bad}
    assert {r["doc_id"] for r in clean.collect()} == kept


def test_spans_are_removed(spark):
    item = "one two three four five six seven eight nine ten eleven"
    rows = [(1, f"(Keep, this) {item.upper()}; and this"), (2, "left alone!"), (3, None), (4, item)]
    frame, bench = frames(spark, rows, [(1, item)])
    got = {r["doc_id"]: r["text"] for r in dc.drop_spans(frame, bench).collect()}
    assert got == {1: "(Keep, this) and this", 2: "left alone!", 3: None, 4: ""}


def test_empty_tables(spark):
    docs, items = tables()
    frame, bench = frames(spark, docs[:5], items)
    none, nothing = frames(spark, [], [])
    assert dc.report(none, bench).count() == 0
    assert [r["n_hit"] for r in dc.report(frame, nothing).collect()] == [0] * 5
    assert dc.drop_documents(frame, nothing).count() == 5


def test_no_python_in_the_plan(spark):
    docs, items = tables()
    plan = dc.report(*frames(spark, docs, items))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
