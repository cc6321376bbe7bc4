"""SimHash near-duplicates by anchor points of a covering code.

Fingerprint: 64 bits; a bit is set if it is set in more than half of the hashes of a text's 3-word shingles.
Two fingerprints link at ``THRESHOLD`` = 2 or fewer differing bits, and documents in the same component of
links are one group.

Search. Two fingerprints that differ in at most 2 bits differ in at most 1 bit in one of their 32-bit halves.
For a half, the anchors are the code words of the perfect Hamming code of length 31 (the half's top bit is not
looked at): its covering radius is 1, so every half has one home anchor within radius 1, and whatever differs
from it in at most 1 bit lies within 1 + 1 = 2 of that anchor. A fingerprint is therefore sent to every anchor
within 2 of each of its halves, at most 16, one of which is its home; in every anchor, the fingerprints at
home are compared with all others over all 64 bits. No pair within the threshold is missed.

Scale. Copies share a fingerprint, so only distinct fingerprints are sent. Anchors are dealt out by a shuffle
and read as a sorted stream. An anchor where more than ``HOT`` fingerprints are at home is split: its members
go, thrice, by a third of their other half, one of which is equal wherever two differ in 2 bits or fewer.
Inside an anchor only a spanning forest of its links is returned, never all pairs.

Defined cases: null and empty texts have no words and the fingerprint zero, which is linked like any other;
fewer than 3 words make one shingle; repeated rows are each returned; rows with a null doc_id get a
fingerprint and take part in links, but a group's id is its smallest doc_id that is not null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom import runtime
from feedloom.llm.common import landed, table
from feedloom.llm.components import components

THRESHOLD = 2
SHINGLE = 3
SEED = 42
# Fingerprints at home in one anchor beyond which the anchor is split.
HOT = 4096
# Groups of up to this many are compared row by row in one sweep over the batch.
SMALL = 16
CHUNK = 1 << 16


def fingerprint(text: bytes | None, size: int = SHINGLE) -> int:
    """Fingerprint of a UTF-8 text; ``bytes`` are split and lower-cased by ASCII alone."""
    from xxhash import xxh64_intdigest

    found = (text or b"").lower().split()
    if not found:
        return 0
    if len(found) <= size:
        shingles = [b" ".join(found)]
    else:
        shingles = map(b" ".join, zip(*[found[i:] for i in range(size)]))
    return majority(np.array([xxh64_intdigest(x, SEED) for x in shingles], dtype=np.uint64))


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in more than half of some 64-bit hashes."""
    ones = np.zeros(64, dtype=np.int64)
    for start in range(0, len(hashes), CHUNK):
        part = hashes[start : start + CHUNK].astype(">u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text")
        found = np.fromiter((fingerprint(x.as_py()) for x in texts), dtype=np.uint64, count=len(texts))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(found.view(np.int64))], names=["doc_id", "fp"]
        )


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp long): the fingerprint's 64 bits as a signed number."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(_fingerprints, "doc_id long, fp long")


def _anchors(half: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor, at home) of all code words within 2 of each 31-bit word.

    The syndrome is the xor of the places, 1 to 31, of the set bits. Flipping the place it names gives the
    home anchor; flipping two places whose xor it is gives the others.
    """
    syndrome = np.zeros(len(half), dtype=np.uint32)
    for place in range(1, 32):
        syndrome ^= np.where(half >> np.uint32(place - 1) & np.uint32(1), np.uint32(place), np.uint32(0))
    flip = lambda word, place: word ^ np.where(place > 0, np.uint32(1) << (np.maximum(place, 1) - 1), 0).astype(np.uint32)
    rows, words, home = [np.arange(len(half))], [flip(half, syndrome)], [np.ones(len(half), dtype=bool)]
    for place in range(1, 32):
        other = syndrome ^ np.uint32(place)
        wanted = np.flatnonzero((syndrome > 0) & (other > place))
        rows.append(wanted)
        words.append(flip(half[wanted] ^ (np.uint32(1) << np.uint32(place - 1)), other[wanted]))
        home.append(np.zeros(len(wanted), dtype=bool))
    return np.concatenate(rows), np.concatenate(words), np.concatenate(home)


def _dealt(home_only: bool):
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            for side in (0, 1):
                half = (fps >> np.uint64(32 * side)).astype(np.uint32) & np.uint32(0x7FFFFFFF)
                rows, words, home = _anchors(half)
                if home_only:
                    rows, words, home = rows[home], words[home], home[home]
                anchor = words.astype(np.int64) * 2 + side
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor), pa.array(fps[rows].view(np.int64)), pa.array(home)],
                    names=["anchor", "fp", "home"],
                )

    return deal


def dealt(fps: DataFrame, home_only: bool = False) -> DataFrame:
    """(anchor, fp, home): every distinct fingerprint at each of its anchors."""
    return fps.mapInArrow(_dealt(home_only), "anchor long, fp long, home boolean")


def _forest(fps: np.ndarray, home: np.ndarray, threshold: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Spanning forest of the links of one anchor's members with those at home."""
    left, edges = np.ones(len(fps), dtype=bool), []
    for start in np.flatnonzero(home):
        if not left[start]:
            continue
        left[start], ahead = False, [start]
        while ahead:
            at = ahead.pop()
            among = np.flatnonzero(left if home[at] else left & home)
            near = among[np.bitwise_count(fps[among] ^ fps[at]) <= threshold]
            if len(near):
                left[near] = False
                edges.append((np.full(len(near), fps[at]), fps[near]))
                ahead.extend(near.tolist())
    return edges


def _linked(threshold: int):
    def compare(keys: np.ndarray, fps: np.ndarray, home: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        starts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)]) if len(keys) else np.zeros(0, int)
        sizes, found = np.diff(np.r_[starts, len(keys)]), []
        group = np.repeat(np.arange(len(starts)), sizes)
        small = np.repeat(sizes <= SMALL, sizes)
        for gap in range(1, min(SMALL, int(sizes.max(initial=0)))):
            near = np.flatnonzero(small[gap:] & (group[gap:] == group[:-gap]))
            near = near[np.bitwise_count(fps[near] ^ fps[near + gap]) <= threshold]
            found.append((fps[near], fps[near + gap]))
        for at in np.flatnonzero(sizes > SMALL):
            one = slice(starts[at], starts[at] + sizes[at])
            found += _forest(fps[one], home[one], threshold)
        return found

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None  # the last anchor of a batch may go on in the next one
        for batch in batches:
            columns = [batch.column(name).to_numpy(zero_copy_only=False) for name in ("anchor", "part", "fp", "home")]
            if not len(columns[0]):
                continue
            if rest is not None:
                columns = [np.concatenate(pair) for pair in zip(rest, columns)]
            last = (columns[0] == columns[0][-1]) & (columns[1] == columns[1][-1])
            rest = [column[last] for column in columns]
            yield made(*[column[~last] for column in columns])
        if rest is not None:
            yield made(*rest)

    def made(anchor: np.ndarray, part: np.ndarray, fp: np.ndarray, home: np.ndarray) -> pa.RecordBatch:
        found = compare(np.stack([anchor, part], axis=1), fp.view(np.uint64), home.astype(bool))
        ends = [np.concatenate([pair[i] for pair in found] or [np.zeros(0, np.uint64)]) for i in (0, 1)]
        return pa.RecordBatch.from_arrays([pa.array(end.view(np.int64)) for end in ends], names=["a", "b"])

    return link


def links(fps: DataFrame, threshold: int = THRESHOLD, hot: int = HOT) -> DataFrame:
    """Links (a, b) between distinct fingerprints; they connect all that are within the threshold.

    ``fps`` has one column ``fp`` without repeats. ``threshold`` is at most 2, what the anchors cover.
    """
    if not 0 <= threshold <= 2:
        raise ValueError("the anchors cover thresholds from 0 to 2")
    crowded = dealt(fps, home_only=True).groupBy("anchor").count().where(F.col("count") > hot).select("anchor")
    crowded = landed(crowded, "crowded-anchors").withColumn("crowded", F.lit(True))
    rows = dealt(fps)
    rows = rows.join(F.broadcast(crowded) if runtime.fits_broadcast(crowded) else crowded, "anchor", "left")
    # The half that the anchor does not look at, in three parts of 11, 11 and 10 bits.
    other = F.shiftrightunsigned("fp", 32).bitwiseAND(F.lit(0xFFFFFFFF))
    other = F.when(F.col("anchor") % 2 == 0, other).otherwise(F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)))
    parts = F.array(
        *[
            F.lit(place * 4096) + F.shiftright(other, 11 * place).bitwiseAND(F.lit(2047)).cast("int")
            for place in range(3)
        ]
    )
    rows = rows.withColumn("part", F.explode(F.when(F.col("crowded"), parts).otherwise(F.array(F.lit(-1)))))
    rows = rows.select("anchor", "part", "fp", "home")
    dealt_out = rows.repartition("anchor", "part").sortWithinPartitions("anchor", "part")
    return dealt_out.mapInArrow(_linked(threshold), "a long, b long")


def groups(docs: DataFrame, threshold: int = THRESHOLD, hot: int = HOT) -> DataFrame:
    """(doc_id, fp, component_id) of every document; component_id is its group's smallest doc_id."""
    marked = landed(fingerprints(docs), "fingerprints")
    distinct = landed(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct-fingerprints")
    roots = components(links(distinct.select("fp"), threshold, hot))
    rooted = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
    rooted = rooted.withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = landed(rooted.join(least, "root").select("fp", "component_id"), "named-fingerprints")
    # A fingerprint may have a third of all documents; such a partition of this join is split at run time.
    return marked.join(F.broadcast(named) if runtime.fits_broadcast(named) else named, "fp")


def keep_first(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """One document of each group, that of the smallest doc_id, with all columns.

    Of repeated rows with that id, one stays. A document without an id cannot be named as a copy and stays;
    so does an id that stands for several texts, if one of them is the first of its group.
    """
    grouped = groups(docs, threshold).where("doc_id IS NOT NULL")
    ids = grouped.groupBy("doc_id").agg(
        F.max(F.col("doc_id") == F.col("component_id")).alias("first"), F.count("*").alias("n")
    )
    ids = landed(ids, "copies").withColumnRenamed("doc_id", "_id")
    gone, repeated = ids.where("NOT first").select("_id"), ids.where("first AND n > 1").select("_id")
    doc_id = docs["doc_id"].cast("long")
    side = F.broadcast(gone) if runtime.fits_broadcast(gone) else gone
    kept = docs.join(side, doc_id == gone["_id"], "left_anti")
    if repeated.isEmpty():
        return kept
    again = kept.join(repeated, doc_id == repeated["_id"], "left_semi").dropDuplicates(["doc_id"])
    return kept.join(repeated, doc_id == repeated["_id"], "left_anti").unionByName(again)


def op7_simhash(spark, sf_dir: str) -> DataFrame:
    found = groups(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )
