"""Line deduplication by pairwise alignment.

Lines are compared by a hash of their text without white space at the ends. A line is rare enough to show a
copy, a seed, if it holds ``SEED_WORDS`` words or more; shorter ones (headings, blank lines) recur by chance. Two letters of a
script without spaces count as a word.

1. Copies. Documents with the same text are one class, by its hash; in all but the first everything is
   aligned with the first, so it is deleted. Only the first goes on.
2. Pairs. A seed that several documents hold links each later one with the earliest that holds it. So a line of n documents
   gives n - 1 pairs and not n * n, and no link is dropped however frequent the line is.
3. Alignment. The line hashes of both documents are aligned by patience diff: lines that occur once on each side and
   match are put in order by a longest increasing run, matching lines around these anchors extend them, and the
   gaps are aligned in the same way. Blocks of adjacent aligned lines that hold a seed are common blocks. Seeds of the earlier document
   that are left, as they stand in another order, are anchors of their own. So a seed stays only where no earlier document holds it.
4. Deletion. The lines of all its common blocks are deleted from the later document.

Documents are in order of doc_id. Texts are moved once, to meet the lines to delete; all else is hashes. Aggregates
merge ahead of the shuffle; joins split hot keys at run time.

Defined cases: a null text has no lines and stays null; an empty text has one blank line, which is no seed; lines are parted
by line feeds; of rows that share a doc_id, the text with the smallest hash stands for the document, each row with
that text loses the same lines and others are left alone; rows with a null doc_id are left alone and give no
seeds; empty tables give empty ones; other columns are kept.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import landed, table, unused

SEED_WORDS = 5
# Letters of scripts that are written without spaces (Thai, Lao, Burmese, Khmer, kana, Han); so many count as one more word.
UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff]")
UNSPACED_WORD = 2


def line_hash(line: str, seed_words: int = SEED_WORDS) -> int:
    """Hash of a line without white space at its ends; odd for a seed, even for another line."""
    from xxhash import xxh64_intdigest

    value = xxh64_intdigest(line.strip().encode("utf-8")) >> 2 << 1
    words = len(line.split(None, seed_words))
    if words < seed_words and not line.isascii():
        words += len(UNSPACED.findall(line)) // UNSPACED_WORD
    return value | (words >= seed_words)


def _lines(seed_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = [[line_hash(x, seed_words) for x in text.split("\n")] for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("whole"), pa.array(lines, pa.list_(pa.int64()))],
                names=["doc_id", "whole", "lines"],
            )

    return run


def anchors(a: list[int], b: list[int], a0: int, a1: int, b0: int, b1: int) -> list[tuple[int, int]]:
    """Lines that occur once in each range and match, in the longest run that ascends on both sides."""
    once_a, once_b = {}, {}
    for lines, start, end, once in ((a, a0, a1, once_a), (b, b0, b1, once_b)):
        for at in range(start, end):
            once[lines[at]] = -1 if lines[at] in once else at
    pairs = [(once_a[line], at) for line, at in once_b.items() if at >= 0 and once_a.get(line, -1) >= 0]
    pairs.sort(key=lambda pair: pair[1])
    # Patience sorting: the top of each pile, and for every pair the one below it.
    tops, at_top, below = [], [], {}
    for i, (x, _) in enumerate(pairs):
        pile = bisect_left(tops, x)
        below[i] = at_top[pile - 1] if pile else None
        if pile == len(tops):
            tops.append(x)
            at_top.append(i)
        else:
            tops[pile], at_top[pile] = x, i
    out, i = [], at_top[-1] if at_top else None
    while i is not None:
        out.append(pairs[i])
        i = below[i]
    return out[::-1]


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned lines of two documents, ascending on both sides."""
    out, ranges = [], [(0, len(a), 0, len(b))]
    while ranges:
        a0, a1, b0, b1 = ranges.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        found = anchors(a, b, a0, a1, b0, b1)
        if not found:
            continue
        x, y = a0, b0
        for at_a, at_b in [*found, (a1, b1)]:
            ranges.append((x, at_a, y, at_b))
            if at_a < a1:
                out.append((at_a, at_b))
            x, y = at_a + 1, at_b + 1
    return sorted(out)


def common_blocks(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """(start, end) in ``b`` of the blocks that it has in common with ``a``.

    First the blocks of adjacent aligned lines that hold a seed. A seed of ``a`` that is then left in ``b``, as it stands in another
    order or more than once, is an anchor of its own, with its first place in ``a``; equal lines beside it extend it.
    """
    out, block, gone = [], [], bytearray(len(b))
    for pair in [*patience(a, b), None]:
        if block and (pair is None or pair != (block[-1][0] + 1, block[-1][1] + 1)):
            if any(b[at] & 1 for _, at in block):
                out.append((block[0][1], block[-1][1] + 1))
                gone[out[-1][0] : out[-1][1]] = b"\1" * len(block)
            block = []
        if pair is not None:
            block.append(pair)
    places = {line: at for at, line in reversed(list(enumerate(a))) if line & 1}
    for at, line in enumerate(b):
        if gone[at] or line not in places:
            continue
        x, start, end = places[line], at, at + 1
        while x > 0 and start > 0 and not gone[start - 1] and a[x - 1] == b[start - 1]:
            x, start = x - 1, start - 1
        x = places[line] + 1
        while x < len(a) and end < len(b) and not gone[end] and a[x] == b[end]:
            x, end = x + 1, end + 1
        out.append((start, end))
        gone[start:end] = b"\1" * (end - start)
    return sorted(out)


def _align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pairs = zip(batch.column("first_lines").to_pylist(), batch.column("lines").to_pylist())
        found = [[at for start, end in common_blocks(*pair) for at in range(start, end)] for pair in pairs]
        columns = [batch.column("doc_id"), pa.array(found, pa.list_(pa.int32()))]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "gone"])


def _text_key(df: DataFrame) -> Column:
    return F.xxhash64(df["text"])


def document_lines(docs: DataFrame, seed_words: int = SEED_WORDS) -> DataFrame:
    """(doc_id, whole, lines): the hash of the text and those of its lines."""
    rows = docs.select(
        docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"), _text_key(docs).alias("whole")
    ).where("doc_id IS NOT NULL AND text IS NOT NULL")
    return rows.mapInArrow(_lines(seed_words), "doc_id long, whole long, lines array<long>")


def deletions(docs: DataFrame, seed_words: int = SEED_WORDS) -> DataFrame:
    """(doc_id, whole, gone): the lines to delete, ascending, of every document that loses any."""
    rows = landed(document_lines(docs, seed_words), "lines")
    # One text stands for a doc_id: of repeated rows, that with the smallest hash.
    ids = rows.groupBy("doc_id").agg(F.min("whole").alias("whole"), F.min_by(F.size("lines"), "whole").alias("n_lines"))
    ids = landed(ids, "line-documents")
    classes = landed(ids.groupBy("whole").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "line-classes")
    copies = ids.join(classes.where("n > 1").select("whole", "first"), "whole").where("doc_id != first")
    copies = copies.select("doc_id", "whole", F.sequence(F.lit(0), F.col("n_lines") - 1).alias("gone"))
    firsts = classes.select(F.col("first").alias("doc_id"), "whole")
    kept = rows.join(firsts, ["doc_id", "whole"])
    if ids.count() < rows.count():
        kept = kept.dropDuplicates(["doc_id", "whole"])
    kept = landed(kept, "first-lines")
    # Seeds that several documents hold, with the earliest.
    held = kept.select("doc_id", F.explode_outer(F.array_distinct("lines")).alias("seed")).where("seed % 2 = 1")
    earliest = held.groupBy("seed").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    pairs = held.join(earliest.select("seed", "first"), "seed").where("doc_id != first")
    pairs = landed(pairs.select("first", "doc_id").distinct(), "line-pairs")
    later = pairs.join(kept.select("doc_id", "lines"), "doc_id")
    sides = later.join(kept.select(F.col("doc_id").alias("first"), F.col("lines").alias("first_lines")), "first")
    aligned = sides.select("doc_id", "first_lines", "lines").mapInArrow(_align, "doc_id long, gone array<int>")
    # Lines of one document; its length bounds them.
    gone = aligned.where("size(gone) > 0").groupBy("doc_id").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("gone")))).alias("gone")
    )
    gone = gone.join(firsts, "doc_id").select("doc_id", "whole", "gone")
    return landed(gone.unionByName(copies), "line-deletions")


def _without_lines(docs: DataFrame, seed_words: int) -> tuple[DataFrame, str]:
    """The documents without common lines, and the name of one more column: the places that went, or null."""
    names = [unused(docs, name) for name in ("gone", "parts")]
    places, parts = names
    gone = deletions(docs, seed_words).withColumnRenamed("gone", places)
    same = (docs["doc_id"].cast("long") == gone["doc_id"]) & (_text_key(docs) == gone["whole"])
    # The deletions grow with the documents, so this is one join by shuffle at every size.
    joined = docs.join(gone.hint("merge"), same, "left").select(*[docs[c] for c in docs.columns], gone[places])
    # A column of its own, as an expression inside transform() is computed for every element.
    joined = joined.withColumn(parts, F.when(F.col(places).isNotNull(), F.split("text", "\n", -1)))
    left = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), places)
    text = F.array_join(F.transform(left, lambda i: F.get(F.col(parts), i)), "\n")
    return joined.withColumn("text", F.when(F.col(places).isNull(), F.col("text")).otherwise(text)).drop(parts), places


def dedup_lines(docs: DataFrame, seed_words: int = SEED_WORDS) -> DataFrame:
    """The documents, all columns kept, without the lines they share with earlier ones.

    A document that loses all its lines stays, with an empty text.
    """
    cleaned, places = _without_lines(docs, seed_words)
    return cleaned.drop(places)


def op4_line_dedup(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_lines before, n_deleted, and the hash of the text that is left (of an empty one for null)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    cleaned, places = _without_lines(docs.withColumn("n_lines", F.size(F.split("text", "\n", -1))), SEED_WORDS)
    return cleaned.select(
        "doc_id",
        F.when(F.col("n_lines") < 0, 0).otherwise(F.col("n_lines")).cast("long").alias("n_lines"),
        F.when(F.col(places).isNull(), 0).otherwise(F.size(places)).cast("long").alias("n_deleted"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"),
    )
