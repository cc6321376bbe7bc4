"""Token ids as ORC files: integer run-length encoding, row indexes, Bloom filters on document ids.

Documents are dealt out by ranges of doc_id and sorted within a range, so that file k holds smaller ids than
file k + 1 and the rows of a file ascend. A row is (doc_id, ids), the ids of the text by a public tokenizer and
the end id. ORC writes the ids by integer run lengths, splits a file into stripes that can be read in parallel, and
keeps, per stripe and row group, the range of doc_id and a Bloom filter on it: a reader of one document skips all
other stripes by metadata.

Encoding. The tokenizer drops white space and encodes what stands between two blanks or line ends alone, so a text is
cut there, and each task remembers the ids of pieces, and of the words inside them, that it has met. A word that stands as a piece of
its own is remembered once. A new word of Latin-1 letters goes to the tokenizer's model without its normaliser. Both
memories are bounded (``PIECES``, ``WORDS``): when one is full, what was not met since the last time is forgotten. A text with a special token's string is given to
the tokenizer whole. The ids equal those of whole texts, which the tests check.

Offsets. ``start`` is the number of ids of all documents before one. It comes from the files: a running sum within
a file plus the sum of the files before it, one number per file.

Defined cases: a null or empty text has the end id alone; documents with the same doc_id are each written, in the order
of a hash of their texts; a null doc_id comes before all others; an empty table gives no rows.
"""

from __future__ import annotations

import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from feedloom import runtime
from feedloom.llm.common import landed, released, small_batches, table

END_ID = 1
# Entries of a generation of remembered pieces and words; two generations are kept.
PIECES = 100_000
WORDS = 50_000
# Marks that the tokenizer never joins with letters; an apostrophe may begin a suffix of its own.
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
# Characters that stand for bytes in a byte-level vocabulary: a byte that prints stands for itself, the others
# follow from 256 up.
PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTES = dict(zip(PRINTED, PRINTED)) | {b: 256 + i for i, b in enumerate(sorted(set(range(256)) - set(PRINTED)))}
OPTIONS = {
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
    "orc.create.index": "true",
    "orc.row.index.stride": "1000",
    "orc.stripe.size": str(64 << 20),
    "compression": "zstd",
}


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def latin(text: str) -> bool:
    """No character beyond Latin-1."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class Encoder:
    """Ids of texts, as little-endian 32-bit numbers."""

    def __init__(self, path: str, end_id: int = END_ID):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.specials = [token.content for token in self.tokenizer.get_added_tokens_decoder().values()]
        self.end = end_id.to_bytes(4, "little")
        self.pieces: dict[str, bytes] = {"": b""}
        self.words: dict[str, bytes] = {}
        self.old_pieces: dict[str, bytes] = {}
        self.old_words: dict[str, bytes] = {}

    def encoded(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def learn(self, missing: list[str], plain: bool) -> None:
        """Add pieces that were not met before, or not lately. ``plain``: lower-case Latin-1."""
        if len(self.pieces) > PIECES:
            self.old_pieces, self.pieces = self.pieces, {"": b""}
        if len(self.words) > WORDS:
            self.old_words, self.words = self.words, {}
        pieces, words, old_pieces, old_words = self.pieces, self.words, self.old_pieces, self.old_words
        for piece in missing:
            ids = old_pieces.get(piece)
            if ids is not None:
                pieces[piece] = ids
                continue
            # A word with ASCII marks around it: the tokenizer parts letters from marks.
            word = piece.strip(MARKS)
            if not word.isalpha():
                pieces[piece] = self.encoded(piece)
                continue
            if len(word) == len(piece):
                ids = words.pop(word, None) or old_words.get(word)
                pieces[piece] = ids or (self.word(word) if plain else self.encoded(word))
                continue
            ids = words.get(word) or pieces.get(word)
            if ids is None:
                ids = old_words.get(word) or old_pieces.get(word) or (self.word(word) if plain else self.encoded(word))
                words[word] = ids
            at = piece.find(word)
            pieces[piece] = self.marks(piece[:at]) + ids + self.marks(piece[at + len(word) :])

    def word(self, word: str) -> bytes:
        """Ids of a run of letters. Lower-case Latin-1 needs no normalising and goes to the model at once."""
        letters = word if word.isascii() else word.encode().decode("latin-1").translate(BYTES)
        return array("I", [token.id for token in self.model.tokenize(letters)]).tobytes()

    def marks(self, run: str) -> bytes:
        if run and run not in self.words:
            self.words[run] = self.encoded(run)
        return self.words[run] if run else b""

    def __call__(self, text: str | None) -> bytes:
        if not text:
            return self.end
        if any(special in text for special in self.specials):
            return self.encoded(text) + self.end
        # The tokenizer lower-cases; doing so first makes fewer pieces. Beyond Latin-1, lower() is not the same.
        plain = latin(text)
        cut = (text.lower() if plain else text).replace("\n", " ").split(" ")
        found = list(map(self.pieces.get, cut))
        if None in found:
            places = [at for at, ids in enumerate(found) if ids is None]
            self.learn(list(dict.fromkeys([cut[at] for at in places])), plain)
            for at in places:
                found[at] = self.pieces[cut[at]]
        return b"".join(found) + self.end


@lru_cache(maxsize=2)
def encoder(path: str, end_id: int) -> Encoder:
    return Encoder(path, end_id)


def _encode(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, end_id)
        for batch in batches:
            found = [encode(text) for text in batch.column("text").to_pylist()]
            ends = np.cumsum([0, *(len(ids) // 4 for ids in found)], dtype=np.int64)
            ids = pa.array(np.frombuffer(b"".join(found), "<u4").view("<i4"))
            lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), ids)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists], names=["doc_id", "ids"])

    return run


def write_ids(docs: DataFrame, path: str, vocabulary: str, end_id: int = END_ID) -> None:
    """Write (doc_id, ids) as ORC files in ascending doc_id order."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # A hash of the text as well, so that a doc_id with a third of all rows does not go to one file. The ranges
    # come from a sample of these two numbers that the driver gets; it holds no texts.
    rows = rows.withColumn("text_key", F.xxhash64("text"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(parts, "doc_id", "text_key").sortWithinPartitions("doc_id", "text_key")
    encoded = ordered.mapInArrow(released(_encode(vocabulary, end_id)), "doc_id long, ids array<int>")
    with small_batches(docs.sparkSession):
        encoded.write.options(**OPTIONS).orc(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, ids) as written; a filter on doc_id reads only the stripes that may hold it."""
    return spark.read.schema("doc_id long, ids array<int>").orc(path)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("ids")
        ends, flat = np.asarray(lists.offsets), np.asarray(lists.values).astype("<u4", copy=False)
        crcs = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(ends[:-1], ends[1:])]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("file"),
                batch.column("at"),
                batch.column("doc_id"),
                pa.array(np.diff(ends).astype(np.int64)),
                pa.array(crcs, pa.int64()),
            ],
            names=["file", "at", "doc_id", "n_tokens", "ids_crc32"],
        )


def offsets(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files alone."""
    rows = read_ids(spark, path).select(
        F.element_at(F.split("_metadata.file_name", "-"), 2).cast("long").alias("file"),
        F.struct("_metadata.file_block_start", F.monotonically_increasing_id()).alias("at"),
        "doc_id",
        "ids",
    )
    digests = rows.mapInArrow(released(_digest), "file long, at struct<block: long, row: long>, doc_id long, n_tokens long, ids_crc32 long")
    with small_batches(spark):
        digests = landed(digests, "token-digests")
    files = digests.groupBy("file").agg(F.sum("n_tokens").alias("n"))
    # One row per file.
    earlier = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("file", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    within = Window.partitionBy("file").orderBy("doc_id", "at").rowsBetween(Window.unboundedPreceding, -1)
    side = F.broadcast(files) if runtime.fits_broadcast(files) else files
    start = F.col("before") + F.coalesce(F.sum("n_tokens").over(within), F.lit(0))
    return digests.join(side, "file").select("doc_id", start.alias("start"), "n_tokens", "ids_crc32")


def tokenized(docs: DataFrame, vocabulary: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Write the ids to the shared scratch folder and return the offsets read from the files."""
    path = f"{runtime.checkpoint_folder(docs.sparkSession)}/token-ids-{uuid.uuid4().hex}"
    write_ids(docs, path, vocabulary or vocabulary_path(), end_id)
    return offsets(docs.sparkSession, path)


def op10_token_output(spark, sf_dir: str) -> DataFrame:
    return tokenized(table(spark, sf_dir, "documents"))
