"""Benchmark decontamination: windows of benchmark words found in documents, by DataFrame functions only.

Every window of ``n`` consecutive words of a benchmark item (a shorter item is one window) is searched in
every document. Words are maximal runs of ASCII letters, digits and characters beyond ASCII; A-Z are
lower-cased.

1. Scan. A window of L words holds, wherever it starts in a document, a whole aligned block of
   b = (L + 1) div 2 words (block k covers the words k*b to k*b+b-1). So a document is cut into blocks
   that do not overlap, an n-th of its windows in number, and the blocks are looked up in a broadcast
   hash set of all b-word runs of the benchmark. This only finds candidates; none is lost.
2. Verify. Documents with a hit are read again; all their windows are compared, as whole strings, with
   the benchmark's windows, and words under a true occurrence are marked.
3. Remove. Either documents with a marked word go, or the marked words do.

The benchmark side is counted; it is broadcast up to ``runtime.BROADCAST_ROWS`` rows and joined by a
shuffle beyond that, with the same result.

Defined cases: a null or empty text has no words and is never hit; a null item has no windows; an item
with a null id marks words but is not listed; repeated rows are each judged, with equal results; a null
doc_id is an id like any other; other columns of the documents are kept as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom import runtime
from feedloom.llm.common import ascii_lower, landed, table, unused

WINDOW = 10
# Characters between words: all of ASCII but digits and lower-case letters (of lower-cased text).
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# The same for text in either case.
BETWEEN_ANY = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WORD_ANY = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Words of a text, lower-cased; none for null."""
    found = F.array_remove(F.split(ascii_lower(text), BETWEEN), "")
    return F.coalesce(found, F.array().cast("array<string>"))


def _loose(text: Column) -> Column:
    """Words of a text joined by spaces, in full lower case: equal for texts with equal words.

    Coarser than ``ascii_lower``, but cheap. Both forms of a small sigma become one, as the choice
    between them depends on what stands around the word.
    """
    lowered = F.replace(F.lower(text), F.lit("ς"), F.lit("σ"))
    return F.coalesce(F.trim(F.regexp_replace(lowered, BETWEEN, " ")), F.lit(""))


def _runs(found: Column, size: int) -> Column:
    """All runs of ``size`` consecutive words, joined by spaces."""
    last = F.size(found) - size
    return F.when(
        last >= 0,
        # Word by word: slice() would copy the whole array for every run.
        F.transform(F.sequence(F.lit(0), last), lambda i: F.concat_ws(" ", *[F.get(found, i + k) for k in range(size)])),
    ).otherwise(F.array().cast("array<string>"))


def benchmark_windows(benchmark: DataFrame, n: int = WINDOW) -> DataFrame:
    """(item_id, size, gram) of every window; an item shorter than ``n`` words is one window."""
    items = benchmark.select("item_id", words(F.col("text")).alias("found")).where(F.size("found") > 0)
    whole = items.where(F.size("found") < n).select(
        "item_id", F.size("found").alias("size"), F.array_join("found", " ").alias("gram")
    )
    # Outer, as a plain explode makes a filter of its input that is pushed down and computes it twice.
    longer = items.where(F.size("found") >= n).select(
        "item_id", F.lit(n).alias("size"), F.explode_outer(_runs(F.col("found"), n)).alias("gram")
    )
    return whole.unionByName(longer).distinct()


def _block(size: int) -> int:
    return (size + 1) // 2


def _lookup(rows: DataFrame, lookup: DataFrame, on: str) -> DataFrame:
    """Inner join; the lookup is broadcast if it was counted and is small."""
    return rows.join(F.broadcast(lookup) if runtime.fits_broadcast(lookup) else lookup, on)


def _identity(df: DataFrame) -> DataFrame:
    """(doc_id, text_key, text): rows with the same id and text have the same result."""
    return df.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"), "text")


def _scan(docs: DataFrame, grams: DataFrame, sizes: list[int]) -> DataFrame:
    """First pass, one row per id and text: n_words, copies (rows), candidate (a block is known)."""
    blocks = sorted({_block(size) for size in sizes})
    known = None
    for size in sizes:
        # The runs of a window are runs of its item; taking them from windows keeps to what can occur.
        split = grams.where(F.col("size") == size).select(F.split(_loose(F.col("gram")), " ").alias("split"))
        runs = split.select(F.explode_outer(_runs(F.col("split"), _block(size))).alias("block"))
        known = runs if known is None else known.unionByName(runs)
    loose = _identity(docs).select("doc_id", "text_key", _loose(F.col("text")).alias("loose"))
    # Every space of the joined words stands between two of them.
    spaces = F.length("loose") - F.length(F.replace("loose", F.lit(" "), F.lit("")))
    counted = F.when(F.col("loose") == "", 0).otherwise(spaces + 1).cast("long").alias("n_words")
    cut = [F.expr(f"regexp_extract_all(loose, '[^ ]++(?: [^ ]++){{{b - 1}}}', 0)") for b in blocks]
    pieces = F.concat(*cut) if cut else F.array().cast("array<string>")
    # Count and cut first: what stands beside an explode is copied, or computed, for each of its rows.
    cuts = loose.select("doc_id", "text_key", counted, pieces.alias("pieces"))
    rows = cuts.select("doc_id", "text_key", "n_words", F.posexplode_outer("pieces").alias("at", "block"))
    if known is None:
        rows = rows.withColumn("seen", F.lit(False))
    else:
        known = known.distinct().withColumn("seen", F.lit(True))
        rows = rows.join(F.broadcast(known) if runtime.fits_broadcast(known) else known, "block", "left")
    # Merged ahead of the shuffle: all rows of a document come from one task.
    return rows.groupBy("doc_id", "text_key", "n_words").agg(
        F.sum(F.when(F.coalesce("at", F.lit(0)) == 0, 1).otherwise(0)).alias("copies"),
        F.coalesce(F.max("seen"), F.lit(False)).alias("candidate"),
    )


def _verify(docs: DataFrame, grams: DataFrame, sizes: list[int], candidates: DataFrame) -> DataFrame:
    """Second pass, over the candidates: all windows, compared as strings."""
    none = "doc_id, text_key, cast(array() as array<int>) hit, cast(array() as array<string>) items"
    if not sizes:
        return candidates.where(F.lit(False)).selectExpr(*none.split(", "))
    ids = candidates.select(F.col("doc_id").alias("c_id"), F.col("text_key").alias("c_key"))
    keyed = _identity(docs)
    same = F.col("doc_id").eqNullSafe(F.col("c_id")) & (F.col("text_key") == F.col("c_key"))
    suspects = keyed.join(F.broadcast(ids) if runtime.fits_broadcast(ids) else ids, same, "left_semi")
    read = suspects.select("doc_id", "text_key", words(F.col("text")).alias("found"))

    def windows_of(size: int) -> Column:
        return F.transform(
            _runs(F.col("found"), size),
            lambda gram, at: F.struct(at.alias("at"), F.lit(size).alias("size"), gram.alias("gram")),
        )

    every = F.concat(*[windows_of(size) for size in sizes]).alias("every")
    windows = read.select("doc_id", "text_key", every).select("doc_id", "text_key", F.explode_outer("every").alias("w"))
    windows = windows.select("doc_id", "text_key", "w.*")
    named = grams.groupBy("gram").agg(F.collect_set(F.col("item_id").cast("string")).alias("names"))
    # Sets of places are bounded by the length of a text, sets of items by the benchmark.
    marked = (
        _lookup(windows, named, "gram")
        .groupBy("doc_id", "text_key")
        .agg(
            F.collect_set(F.struct("at", "size")).alias("spans"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_set("names")))).alias("items"),
        )
    )
    places = F.transform("spans", lambda s: F.sequence(s["at"], s["at"] + s["size"] - 1))
    return marked.select(
        "doc_id", "text_key", F.array_sort(F.array_distinct(F.flatten(places))).alias("hit"), "items"
    )


def _passes(docs: DataFrame, benchmark: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    grams = landed(benchmark_windows(benchmark, n), "benchmark-windows")
    sizes = sorted(row["size"] for row in grams.select("size").distinct().collect())  # at most n rows
    scanned = landed(_scan(docs, grams, sizes), "scanned")
    return scanned, _verify(docs, grams, sizes, scanned.where("candidate"))


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW) -> DataFrame:
    """Marked words of every document with a hit: (doc_id, text_key, hit array<int>, items array<string>).

    ``hit`` are the places of marked words, counted from 0; ``items`` the ids of items with an
    occurring window, sorted as strings. ``text_key`` is the hash of the text.
    """
    return _passes(docs, benchmark, n)[1]


def report(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    scanned, verified = _passes(docs, benchmark, n)
    found = landed(verified, "contaminated").withColumnsRenamed({"doc_id": "f_id", "text_key": "f_key"})
    same = F.col("doc_id").eqNullSafe(F.col("f_id")) & (F.col("text_key") == F.col("f_key"))
    side = F.broadcast(found) if runtime.fits_broadcast(found) else found
    hit = F.col("hit").isNotNull()
    return (
        scanned.join(side, same, "left")
        .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
        .select(
            "doc_id",
            "n_words",
            F.when(hit, F.size("hit")).otherwise(0).cast("long").alias("n_hit"),
            F.when(hit, F.size("items")).otherwise(0).cast("long").alias("n_items"),
            F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"),
            hit.alias("contaminated"),
        )
    )


def _with_hits(docs: DataFrame, benchmark: DataFrame, n: int) -> tuple[DataFrame, str]:
    """The documents with one more column, the marked places, null where nothing was found."""
    hit = unused(docs, "hit")
    found = contamination(docs, benchmark, n).withColumnRenamed("hit", hit).drop("items")
    found = landed(found, "contaminated")
    same = docs["doc_id"].eqNullSafe(found["doc_id"]) & (
        F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == found["text_key"]
    )
    side = F.broadcast(found) if runtime.fits_broadcast(found) else found
    return docs.join(side, same, "left").select(*[docs[c] for c in docs.columns], found[hit]), hit


def drop_documents(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW) -> DataFrame:
    """The documents without a single marked word, all columns kept."""
    joined, hit = _with_hits(docs, benchmark, n)
    return joined.where(F.col(hit).isNull()).drop(hit)


def drop_spans(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW) -> DataFrame:
    """All documents, without their marked words and the characters that follow each of these."""
    joined, hit = _with_hits(docs, benchmark, n)
    parts = unused(joined, "parts")
    found = F.regexp_extract_all("text", F.lit(f"{WORD_ANY}{BETWEEN_ANY[:-1]}*"), F.lit(0))
    # A column of its own, as an expression inside transform() is computed for every element.
    joined = joined.withColumn(parts, F.when(F.col(hit).isNotNull(), found))
    lead = F.regexp_extract("text", f"^{BETWEEN_ANY}", 0)
    left = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), hit)
    kept = F.concat(lead, F.array_join(F.transform(left, lambda i: F.get(F.col(parts), i)), ""))
    return joined.withColumn("text", F.when(F.col(hit).isNull(), F.col("text")).otherwise(kept)).drop(hit, parts)


SQL = """
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
             'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
g AS (SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(list_slice(w, p, p + 9), ' ') AS gram
      FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS p FROM b WHERE len(w) > 0)),
o AS (SELECT doc_id, p, size, array_to_string(list_slice(w, p, p + size - 1), ' ') AS gram
      FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS p
            FROM d, (SELECT DISTINCT size FROM g) WHERE len(w) >= size)),
f AS (SELECT o.doc_id, o.p, o.size, g.item_id FROM o JOIN g USING (gram, size)),
h AS (SELECT doc_id, count(DISTINCT place) AS n_hit
      FROM (SELECT doc_id, unnest(range(p, p + size)) AS place FROM f) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256
      FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM f) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       coalesce(items_sha256, sha256('')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN i USING (doc_id)
"""


def op9_decontaminate(spark, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
