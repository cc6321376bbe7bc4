"""Near copies by Jaccard similarity of word shingles: SimHash anchors propose pairs, min-hash bands those beyond; whole sets decide.

Two texts link if their sets of ``SHINGLE`` = 5-word shingles have a Jaccard similarity of ``SIMILARITY`` = 0.8 or
more; texts in the same component of links are one group. Every link is computed from the whole sets; a shingle stands in
them as a hash of 64 bits, so two shingles of a pair of texts are taken for one with a probability of about 1 in 1e19.

SimHash. Rows with the same text are one class. A class has a fingerprint of its shingles; classes of one fingerprint, and of
fingerprints that the anchors of ``simhash.links`` connect at 2 or fewer bits, are proposed and decided first (``proposals``). What
this joins is one group from then on and is not compared again.

Beyond. Texts at 0.8 mostly differ in 3 to 11 bits, more than anchors cover. A class has therefore ``BANDS`` keys as well, each a hash of ``ROWS`` min-hashes; classes
that share a key meet in a bucket. At similarity s that fails with probability (1 - s^ROWS)^BANDS, which is 0.0007 at 0.8
and less than 1e-7 at 0.9; this is the only loss.

Scale. In a bucket all members are compared with its first and the first leaves, ``STARS`` times; members that were
found in one group are not compared again, so a bucket of n near copies gives about n pairs. Classes that are then left in a
bucket of different groups meet by prefixes (``rest_pairs``): shingles are ordered from rare to frequent, and two similar sets share one
of the first few. What a family of texts below the similarity has in common is frequent and stands behind the prefix, so
such a family gives no pairs of its own. Lengths that cannot reach the similarity are not compared. Texts are moved once, and only
for classes that share a key; pairs meet as hashes, 8 bytes a shingle. Keys are a few hundred bytes a text.

Defined cases: words are parted and lower-cased by ASCII alone; fewer than 5 words make one shingle; null and
empty texts have no shingle and are copies of one another; rows that share a doc_id but not the text are different rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from feedloom import runtime
from feedloom.llm import simhash
from feedloom.llm.common import landed, released, small_batches, unused
from feedloom.llm.components import components

SHINGLE = 5
SIMILARITY = 0.8
ROWS, BANDS = 6, 24
STARS = 3
SEED = 42
CHUNK = 2048
# Tokens that leave a task together.
TOKENS = 1 << 16


@lru_cache
def _random(n: int) -> np.ndarray:
    return np.random.default_rng(SEED).integers(0, 2**64, (2, n, 1), dtype=np.uint64)


def shingle_hashes(text: bytes | None, size: int = SHINGLE) -> np.ndarray:
    """Hashes of the distinct shingles of a UTF-8 text, ascending."""
    from xxhash import xxh64_intdigest

    found = (text or b"").lower().split()
    hashes = np.fromiter(map(xxh64_intdigest, found), np.uint64, len(found))
    width = min(size, len(found))
    out = np.full(len(found) - width + 1 if found else 0, width, np.uint64)
    for i, factor in enumerate((_random(size)[0, :width, 0] | np.uint64(1)) if found else ()):
        out += hashes[i : i + len(out)] * factor
    return np.unique(out)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two ascending sets; 1 for two empty ones."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def _factors() -> tuple[np.ndarray, np.ndarray]:
    times, plus = _random(ROWS * BANDS)
    return times | np.uint64(1), plus


def band_keys(hashes: np.ndarray, factors: tuple[np.ndarray, np.ndarray]) -> list[int]:
    """Keys of a text's buckets; texts without shingles share one set of them."""
    from xxhash import xxh64_intdigest

    times, plus = factors
    least = np.full(len(times), np.iinfo(np.uint64).max)
    for start in range(0, len(hashes), CHUNK):
        least = np.minimum(least, (hashes[start : start + CHUNK] * times + plus).min(axis=1))
    bands = least.reshape(BANDS, ROWS)
    return [xxh64_intdigest(band.tobytes(), i) - 2**63 for i, band in enumerate(bands)]


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    factors = _factors()
    for batch in batches:
        sizes, fps, keys = [], [], []
        for text in batch.column("text"):  # one text at a time; those of a batch would fill the worker
            found = shingle_hashes(text.as_py())
            sizes.append(len(found))
            fps.append(simhash.majority(found))
            keys.append(band_keys(found, factors))
        columns = [batch.column("doc_id"), batch.column("whole"), pa.array(sizes, pa.int32())]
        columns += [pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(keys, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "whole", "n", "fp", "keys"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [shingle_hashes(text.as_py()).tobytes() for text in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(found, pa.binary())], names=["node", "hashes"])


def _decide(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = lambda value: np.frombuffer(value.as_buffer(), np.uint64)
        for batch in batches:
            sides = zip(batch.column("a_hashes"), batch.column("b_hashes"))
            good = pa.array([similarity(held(one), held(other)) >= least for one, other in sides], pa.bool_())
            yield batch.select(["a", "b"]).filter(good)

    return run


def _whole(docs: DataFrame) -> Column:
    """128 bits that stand for a row's text; null is as empty."""
    text = F.coalesce(docs["text"].cast("string"), F.lit("")).cast("binary")
    return F.substring(F.unhex(F.sha2(text, 256)), 1, 16)


def _verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose sets are that similar."""
    side = lambda end: sets.select(F.col("node").alias(end), F.col("hashes").alias(f"{end}_hashes"))
    rows = pairs.join(side("b"), "b").join(side("a").hint("merge"), "a").select("a", "b", "a_hashes", "b_hashes")
    with small_batches(rows.sparkSession):
        return landed(rows.mapInArrow(released(_decide(least)), "a long, b long"), "near-links")


def _alike(one: str, other: str, least: float) -> Column:
    """Sets of these sizes can be that similar."""
    return F.least(one, other) >= F.greatest(one, other) * F.lit(least * (1 - 1e-9))


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, token): every shingle of a set; an empty set has the one token 0."""
    for batch in batches:
        for node, value in zip(batch.column("node"), batch.column("hashes")):
            held = np.frombuffer(value.as_buffer(), np.int64) if len(value.as_buffer()) else np.zeros(1, np.int64)
            for start in range(0, len(held), TOKENS):
                some = held[start : start + TOKENS]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), node.as_py())), pa.array(some)], names=["node", "token"])


def prefixes(rest: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """(node, n, label, token, i, indexed): the leading tokens of every set, from rare to frequent, that another set has too.

    Of n tokens, the first n - ceil(least * n) + 1 must hold one of any similar set that is no larger; of the smaller set, the first
    n - ceil(2 * least / (1 + least) * n) + 1 are enough, and ``indexed`` tells of these.
    """
    with small_batches(rest.sparkSession):
        held = sets.join(rest.select("node"), "node", "left_semi").mapInArrow(released(_tokens), "node long, token long")
        tokens = landed(held, "near-tokens")
    shared = landed(tokens.groupBy("token").agg(F.count("*").alias("times")).where("times > 1"), "near-shared")
    ranked = runtime.skew_join(tokens, shared, ["token"], "node", "left")
    order = Window.partitionBy("node").orderBy(F.coalesce("times", F.lit(1)), "token")
    placed = ranked.withColumn("i", F.row_number().over(order)).where("times IS NOT NULL").drop("times")
    size = F.greatest("n", F.lit(1))

    def length(share: float) -> Column:
        return size - F.ceil(size * F.lit(share) - 1e-6) + 1

    marked = placed.join(rest, "node").where(F.col("i") <= length(least))
    return marked.select("node", "n", "label", "token", "i", (F.col("i") <= length(2 * least / (1 + least))).alias("indexed"))


def rest_pairs(rest: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) of classes (node, n, label) with different labels, among them all that are that similar.

    The smaller set of a pair comes by its short prefix, the larger by its long one, and the places of a token in both must leave
    room for enough common ones. A frequent token is dealt to salts.
    """
    held = landed(prefixes(rest, sets, least), "near-prefixes")
    names = ("node", "n", "label", "i")
    large = held.select("token", *[F.col(c).alias(f"large_{c}") for c in names])
    small = held.where("indexed").select("token", *[F.col(c).alias(f"small_{c}") for c in names])
    met = runtime.skew_join(large, small, ["token"], "large_node")
    met = met.where("struct(small_n, small_node) < struct(large_n, large_node) AND small_label != large_label")
    both = F.greatest("small_n", F.lit(1)) + F.greatest("large_n", F.lit(1))
    room = F.least(*[F.greatest(f"{side}_n", F.lit(1)) - F.col(f"{side}_i") for side in ("small", "large")]) + 1
    met = met.where(_alike("small_n", "large_n", least) & (room >= both * F.lit(least / (1 + least)) - 1e-6))
    return met.select(F.least("small_node", "large_node").alias("a"), F.greatest("small_node", "large_node").alias("b")).distinct()


def proposals(classes: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """Pairs (a, b) of classes (node, n, fp) by SimHash: the first of a fingerprint with its others and with the firsts of linked ones."""
    firsts = landed(classes.groupBy("fp").agg(F.min(F.struct("node", "n")).alias("first")), "near-fingerprints")
    small = F.broadcast(firsts) if runtime.fits_broadcast(firsts) else firsts
    same = classes.join(small, "fp").where("node != first.node").select("first", F.struct("node", "n").alias("other"))
    side = lambda end, name: small.select(F.col("fp").alias(end), F.col("first").alias(name))
    near = simhash.links(firsts.select("fp")).join(side("a", "first"), "a").join(side("b", "other"), "b").select("first", "other")
    pairs = same.unionByName(near).where(_alike("first.n", "other.n", least))
    return pairs.select(F.least("first.node", "other.node").alias("a"), F.greatest("first.node", "other.node").alias("b")).distinct()


def _apart(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Rows (key, node, n) of the buckets that hold several groups of links, with their group as ``label``."""
    roots = components(found).withColumnRenamed("node", "_node")
    rest = rows.join(roots, F.col("node") == F.col("_node"), "left")
    rest = landed(rest.select("key", "node", "n", F.coalesce("root", "node").alias("label")), "near-rest")
    mixed = rest.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high")
    return landed(rest.join(mixed.select("key"), "key"), "near-buckets")


def links(classes: DataFrame, texts_of, least: float = SIMILARITY, stars: int = STARS) -> DataFrame:
    """Links (a, b) that connect all classes (node, n, fp, keys) that SimHash proposes or that share a key, and are that similar.

    ``texts_of`` gives the texts (node, text) of a table of nodes.
    """
    proposed = landed(proposals(classes.select("node", "n", "fp"), least), "near-proposed")
    rows = landed(classes.select("node", "n", F.explode("keys").alias("key")), "near-keys")
    shared = rows.groupBy("key").count().where("count > 1").select("key")
    buckets = landed(rows.join(shared, "key"), "near-buckets")
    ends = [proposed.select(F.col(end).alias("node")) for end in ("a", "b")]
    texts = texts_of(buckets.select("node").unionByName(ends[0]).unionByName(ends[1]).distinct())
    with small_batches(texts.sparkSession):
        sets = landed(texts.mapInArrow(released(_sets), "node long, hashes binary"), "near-sets")
    found = _verified(proposed, sets, least)
    buckets = _apart(buckets, found)
    for _ in range(stars):
        if buckets.isEmpty():
            break
        firsts = buckets.groupBy("key").agg(F.min(F.struct("node", "n", "label")).alias("first"))
        met = buckets.join(firsts, "key").where("node != first.node")
        unlike = met.where((F.col("label") != F.col("first.label")) & _alike("n", "first.n", least))
        pairs = landed(unlike.select(F.col("first.node").alias("a"), F.col("node").alias("b")).distinct(), "near-pairs")
        found = landed(found.unionByName(_verified(pairs, sets, least)), "near-links")
        buckets = _apart(met.select("key", "node", "n"), found)
    if not buckets.isEmpty():
        pairs = landed(rest_pairs(buckets.select("node", "n", "label").distinct(), sets, least), "near-pairs")
        found = found.unionByName(_verified(pairs, sets, least))
    return found


def groups(docs: DataFrame, least: float = SIMILARITY, stars: int = STARS) -> DataFrame:
    """(doc_id, whole, n, first): every distinct id and text, its number of rows, and whether it is the first of its group.

    The first is the smallest doc_id, a null one last, then the smallest hash of the text.
    """
    rows = docs.select(
        docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("binary").alias("text"), _whole(docs).alias("whole")
    )
    with small_batches(docs.sparkSession):
        marks = landed(rows.mapInArrow(released(_marks), "doc_id long, whole binary, n int, fp long, keys array<long>"), "near-marks")
    # Rows of one class have the same fingerprint and keys. The number is fixed by writing it.
    classes = marks.groupBy("whole").agg(*[F.first(c).alias(c) for c in ("n", "fp", "keys")])
    classes = landed(classes.withColumn("node", F.monotonically_increasing_id()), "near-classes")

    def texts_of(nodes: DataFrame) -> DataFrame:
        wanted = landed(classes.select("node", "whole").join(nodes, "node", "left_semi"), "near-candidates")
        side = F.broadcast(wanted) if runtime.fits_broadcast(wanted) else wanted
        return rows.join(side, "whole").groupBy("node").agg(F.first("text").alias("text"))

    roots = components(links(classes.select("node", "n", "fp", "keys"), texts_of, least, stars))
    named = classes.select("whole", "node").join(roots, "node", "left")
    named = named.select("whole", F.coalesce("root", "node").alias("root"))
    ids = marks.groupBy("doc_id", "whole").agg(F.count("*").alias("n")).join(named, "whole")
    ids = landed(ids.withColumn("rank", F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("whole"))), "near-ids")
    firsts = ids.groupBy("root").agg(F.min("rank").alias("least"))
    return ids.join(firsts, "root").select("doc_id", "whole", "n", (F.col("rank") == F.col("least")).alias("first"))


def keep_first(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """One row of each group, that of the smallest doc_id, with all columns.

    A row without an id stays only if no row of its group has one. Of rows that share the id and the text, the one with the
    smallest hash of all columns stays.
    """
    found = landed(groups(docs, least), "near-copies")
    key = unused(docs, "whole")
    marked = docs.withColumn(key, _whole(docs))

    def same(side: DataFrame):
        return marked["doc_id"].cast("long").eqNullSafe(side["_id"]) & (marked[key] == side["_whole"])

    side = lambda rows: rows.select(F.col("doc_id").alias("_id"), F.col("whole").alias("_whole"))
    gone, repeated = side(found.where("NOT first")), side(found.where("first AND n > 1"))
    once = repeated.isEmpty()
    out = side(found.where("NOT first OR n > 1")) if not once else gone
    out = F.broadcast(out) if runtime.fits_broadcast(out) else out
    kept = marked.join(out, same(out), "left_anti").select(*[marked[c] for c in docs.columns])
    if once:
        return kept
    again = marked.join(repeated, same(repeated), "left_semi")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    again = again.groupBy("doc_id", key).agg(F.min_by(F.struct(*columns), F.xxhash64(*columns)).alias("_row"))
    return kept.unionByName(again.select("_row.*"))
