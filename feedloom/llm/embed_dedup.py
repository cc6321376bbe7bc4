"""Embedding near-duplicates by randomised-rotation binary codes.

Code. A unit vector is rotated into ``BITS`` (or more) dimensions by a random matrix with orthonormal columns, and the signs of
the rotated coordinates are its code. The code's vector o' (entries +-1 / sqrt(B)) has the inner product f with the
rotated vector o; f is stored as the correction factor. For any vector q, <o', q> / f is an unbiased estimate of <o, q>,
and with probability 1 - exp(-c * e^2) it is off by at most ``e * sqrt((1 - f^2) / f^2) / sqrt(B - 1)``. A pair whose estimate
plus this bound (``ERROR`` deviations) is below the threshold is dropped; the cosine of all others is computed again
in double precision from the vectors, and decides.

Candidates. Pairs come from tables keyed by some bits of the code. Two vectors at cosine t differ in a sign with probability
p = acos(t) / pi, so k bits agree with (1 - p)^k; with k = log2(n / ``BUCKET``) bits and enough tables a pair at the
threshold shares a key with probability ``recall`` or more, closer pairs more often. The bits of a table are drawn at random from the
code. A pair counts in the first table in which its keys agree, so that it counts once.

Scale. n vectors cost about n^1.2 rows, dealt out by key. A key with more than ``BLOCK`` vectors is cut into blocks, and each pair of
blocks is a group of its own, so that no group is larger than two blocks. Links are counted where they are found and only
their counts, and a spanning forest of each group's links, leave a task: n_links needs every pair of a dense group to be looked at, but
none is returned. Equal vectors are one, with a multiplicity.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components link with nothing, and are
their own component; vectors of different lengths do not link; rows that share a vec_id are linked by their own vectors
and counted separately; a null vec_id is linked like others, but is never a component_id if another id is there; an empty
table gives an empty one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom import runtime
from feedloom.llm.common import landed, table
from feedloom.llm.components import components

THRESHOLD = 0.9
RECALL = 0.999
BITS = 256
BUCKET = 32
BLOCK = 2048
ERROR = 5.0
SEED = 20240


def bits_of(size: int) -> int:
    """Code bits of vectors of this length: at least BITS, and no fewer than the length, in whole words."""
    return max(BITS, -(-size // 64) * 64)


def rotation(size: int, seed: int = SEED) -> np.ndarray:
    """(bits, size) matrix with orthonormal columns, the same in every task."""
    rows = np.random.default_rng([seed, size]).standard_normal((bits_of(size), size))
    q, r = np.linalg.qr(rows)
    return q * np.sign(np.diag(r))


def encode(units: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Signs (n, bits) and correction factors (n) of unit vectors."""
    turned = units @ turn.T
    return turned >= 0, np.abs(turned).sum(axis=1) / math.sqrt(turn.shape[0])


def estimates(signs: np.ndarray, factors: np.ndarray, units: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unbiased estimates of all inner products of coded vectors with ``units``, and their error bounds per code."""
    bits = turn.shape[0]
    back = (np.where(signs, 1.0, -1.0) @ turn) / math.sqrt(bits)
    bound = ERROR * np.sqrt(np.maximum(1 - factors**2, 0) / factors**2 / (bits - 1))
    return (back / factors[:, None]) @ units.T, bound


def layout(n: int, threshold: float, recall: float) -> tuple[int, int]:
    """Bits per key and number of tables for n vectors."""
    agree = 1 - math.acos(threshold) / math.pi
    width = min(48, max(1, math.ceil(math.log2(max(2, n / BUCKET)))))
    return width, math.ceil(math.log(1 - recall) / math.log1p(-(agree**width)))


def key_bits(bits: int, width: int, tables: int, seed: int = SEED) -> np.ndarray:
    """(tables, width) places of the code that make up the keys."""
    rng = np.random.default_rng([seed, bits, width, tables])
    return np.stack([rng.choice(bits, size=min(width, bits), replace=False) for _ in range(tables)])


def keys_of(signs: np.ndarray, places: np.ndarray) -> np.ndarray:
    """(n, tables) keys."""
    powers = 1 << np.arange(places.shape[1], dtype=np.int64)
    return np.stack([signs[:, at] @ powers for at in places], axis=1) if len(signs) else np.zeros((0, len(places)), np.int64)


def _matrix(column: pa.Array, size: int, rows: np.ndarray) -> np.ndarray:
    values = np.asarray(column.take(pa.array(rows)).flatten(), dtype=np.float64)
    return values.reshape(len(rows), size)


def _units(vectors: np.ndarray) -> np.ndarray:
    # Scaled first, so that squares neither vanish nor overflow.
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def _deal(width: int, tables: int):
    """(size, at, key, id, vector): every distinct vector once for every table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns = {}
        for batch in batches:
            column = batch.column("vector")
            sizes = np.diff(np.asarray(column.offsets))
            for size in np.unique(sizes):
                rows = np.flatnonzero(sizes == size)
                if size not in turns:
                    turns[size] = rotation(int(size))
                turn = turns[size]
                signs, _ = encode(_units(_matrix(column, int(size), rows)), turn)
                keys = keys_of(signs, key_bits(turn.shape[0], width, tables))
                for at in range(tables):
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(rows), size, np.int32)),
                            pa.array(np.full(len(rows), at, np.int32)),
                            pa.array(keys[:, at]),
                            batch.column("id").take(pa.array(rows)),
                            batch.column("times").take(pa.array(rows)),
                            column.take(pa.array(rows)),
                        ],
                        names=["size", "at", "key", "id", "times", "vector"],
                    )

    return run


def _forest(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Places of links that join what was apart: a spanning forest."""
    label, keep = np.arange(n), np.zeros(len(left), dtype=bool)
    order = np.arange(len(left))
    while len(order):
        a, b = label[left[order]], label[right[order]]
        order = order[a != b]
        if not len(order):
            break
        a, b = label[left[order]], label[right[order]]
        low, high = np.minimum(a, b), np.maximum(a, b)
        # For every label, one link to a smaller one.
        heads, first = np.unique(high, return_index=True)
        keep[order[first]] = True
        label[heads] = low[first]
        while True:  # point everything at its root
            after = label[label]
            if np.array_equal(after, label):
                break
            label = after
    return np.flatnonzero(keep)


def _compare(width: int, tables: int, threshold: float):
    """(id, links, other): counts of links of each vector, then the forest's links with ``other``."""

    def group(at: int, ids, times, side, vectors, turn, places):
        units = _units(vectors)
        signs, factors = encode(units, turn)
        keys, n = keys_of(signs, places[: at + 1]), len(ids)
        links, found = np.zeros(n, dtype=np.int64), []
        rows, two = np.flatnonzero(side == 0), bool(side.any())
        for start in range(0, len(rows), 512):
            some = rows[start : start + 512]
            guess, bound = estimates(signs[some], factors[some], units, turn)
            left, right = np.nonzero(guess + bound[:, None] >= threshold)
            left = some[left]
            # Within one block every pair once; between two blocks, from the first to the second.
            wanted = side[right] == 1 if two else right > left
            left, right = left[wanted], right[wanted]
            if at:
                again = np.zeros(len(left), dtype=bool)
                for t in range(at):
                    again |= keys[left, t] == keys[right, t]
                left, right = left[~again], right[~again]
            for first in range(0, len(left), 1 << 16):
                a, b = left[first : first + (1 << 16)], right[first : first + (1 << 16)]
                near = np.einsum("ij,ij->i", units[a], units[b]) >= threshold
                a, b = a[near], b[near]
                np.add.at(links, a, times[b])
                np.add.at(links, b, times[a])
                found.append((a, b))
        pairs = [np.concatenate([pair[i] for pair in found] or [np.zeros(0, np.int64)]) for i in (0, 1)]
        tree = _forest(n, *pairs)
        linked = np.flatnonzero(links)
        return (
            np.concatenate([ids[linked], ids[pairs[0][tree]]]),
            np.concatenate([links[linked], np.zeros(len(tree), np.int64)]),
            np.concatenate([ids[linked], ids[pairs[1][tree]]]),
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns, rest = {}, None
        names = ("size", "at", "key", "block", "id", "times", "side")

        def done(part: pa.Table) -> Iterator[pa.RecordBatch]:
            data = {name: part.column(name).to_numpy() for name in names}
            order = np.stack([data[name] for name in names[:4]], axis=1)
            starts = np.flatnonzero(np.r_[True, (order[1:] != order[:-1]).any(axis=1)])
            vectors, out = part.column("vector").combine_chunks(), []
            for a, b in zip(starts, np.r_[starts[1:], len(order)]):
                if b - a < 2:
                    continue
                size, at = int(data["size"][a]), int(data["at"][a])
                if size not in turns:
                    turn = rotation(size)
                    turns[size] = (turn, key_bits(turn.shape[0], width, tables))
                some = _matrix(vectors, size, np.arange(a, b))
                out.append(group(at, data["id"][a:b], data["times"][a:b], data["side"][a:b], some, *turns[size]))
            columns = [np.concatenate([x[i] for x in out] or [np.zeros(0, np.int64)]) for i in range(3)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["id", "links", "other"])

        for batch in batches:
            if not batch.num_rows:
                continue
            part = pa.Table.from_batches([batch])
            if rest is not None:
                part = pa.concat_tables([rest, part])
            last = np.stack([part.column(name).to_numpy() for name in names[:4]], axis=1)
            same = (last == last[-1]).all(axis=1)
            cut = len(last) - int(same[::-1].argmin()) if not same.all() else 0
            rest = part.slice(cut)
            if cut:
                yield from done(part.slice(0, cut))
        if rest is not None:
            yield from done(rest)

    return run


def _blocks(rows: DataFrame, block: int) -> DataFrame:
    """``rows`` with (block, side): keys with many vectors are cut, and every two blocks meet in a group.

    side is 0 in a block by itself, and 0 or 1 for the two blocks of a pair.
    """
    sizes = rows.groupBy("size", "at", "key").count().where(F.col("count") > block)
    sizes = landed(sizes.select("size", "at", "key", F.ceil(F.col("count") / block).cast("int").alias("n")), "crowded-keys")
    joined = rows.join(F.broadcast(sizes) if runtime.fits_broadcast(sizes) else sizes, ["size", "at", "key"], "left")
    joined = joined.withColumn("n", F.coalesce("n", F.lit(1)))
    joined = joined.withColumn("own", F.pmod(F.xxhash64("id"), F.col("n")).cast("int"))
    meets = F.transform(
        F.sequence(F.lit(0), F.col("n") - 1),
        lambda other: F.struct(
            (F.least(F.col("own"), other) * F.col("n") + F.greatest(F.col("own"), other)).alias("block"),
            (F.col("own") > other).cast("int").alias("side"),
        ),
    )
    joined = joined.withColumn("meets", F.explode(meets))
    return joined.select("size", "at", "key", "meets.block", "id", "times", "meets.side", "vector")


def prepared(vectors: DataFrame) -> DataFrame:
    """(vec_id, vector): null for a vector that can link with nothing."""
    values = vectors["embedding"].cast("array<double>")
    rows = vectors.select(vectors["vec_id"].cast("long").alias("vec_id"), values.alias("vector"))
    # NaN is greater than any number in Spark, so the largest component tells of it.
    good = (F.size("vector") > 0) & ~F.exists("vector", lambda x: x.isNull()) & (F.array_max("vector") < float("inf"))
    good = good & (F.array_min("vector") > float("-inf")) & F.exists("vector", lambda x: x != 0)
    return rows.select("vec_id", F.when(good, F.col("vector")).alias("vector"))


def links(distinct: DataFrame, n: int, threshold: float = THRESHOLD, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """(id, links, other) of distinct vectors (id, times, vector): counts where other = id, else forest links."""
    width, tables = layout(n, threshold, recall)
    rows = distinct.mapInArrow(
        _deal(width, tables), "size int, at int, key long, id long, times long, vector array<double>"
    )
    grouped = ["size", "at", "key", "block"]
    dealt = _blocks(rows, block).repartition(*grouped).sortWithinPartitions(*grouped)
    return dealt.mapInArrow(_compare(width, tables, threshold), "id long, links long, other long")


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    rows = landed(prepared(vectors).withColumn("hash", F.xxhash64("vector")), "vectors")
    classes = rows.where("vector IS NOT NULL").groupBy("hash", "vector").agg(
        F.count("*").alias("times"), F.min("vec_id").alias("first")
    )
    # Numbered once, in a written table: the numbers do not change when it is read again.
    classes = landed(classes.withColumn("id", F.monotonically_increasing_id()), "distinct-vectors")
    n = classes.count()
    found = landed(links(classes.select("id", "times", "vector"), n, threshold, recall, block), "vector-links")
    counts = found.where("id = other").groupBy("id").agg(F.sum("links").alias("links"))
    roots = components(found.where("id != other").select(F.col("id").alias("a"), F.col("other").alias("b")))
    named = classes.join(roots.withColumnRenamed("node", "id"), "id", "left")
    named = named.withColumn("root", F.coalesce("root", "id"))
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    named = named.join(least, "root").join(counts, "id", "left")
    named = landed(
        named.select("hash", "vector", "component_id", (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("n_links")),
        "named-vectors",
    )
    side = F.broadcast(named) if runtime.fits_broadcast(named) else named
    usable = rows.where("vector IS NOT NULL").join(side, ["hash", "vector"])
    usable = usable.select("vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id")
    alone = rows.where("vector IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    both = usable.unionByName(alone)
    return both.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op6_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
