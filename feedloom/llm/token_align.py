"""Cross-tokenizer alignment: which ids of tokenizer A stand over which ids of tokenizer B, by bytes.

A text is read as a space and the text. Places where a token of A and a token of B both end cut the two id
sequences into groups; within a group every two tokens whose byte ranges overlap are linked, and an id pair
counts as many links as hold it in all documents.

* Identity map. An array gives for each id of A the id of B with the same bytes (or -1). A group of one token each
  that the map knows is *regular*: it is one link and is counted in a vector as long as A's vocabulary, one per task.
* Only links of irregular groups become pairs (a, b) that are counted, per batch first, and then shuffled.
* Looking the counts up again, regular links read the vector, which is broadcast (its length is the vocabulary's).
  Of the other pairs those that hold at least 1 / ``SHARES`` of all links are broadcast too: there are at most
  ``SHARES`` of them, whatever the data. The rest is joined by a shuffle, in which no key has more than that share.

Alignment of pieces. Both tokenizers of this repository's queries never join what stands on the two sides of a cut
(``SPACE``, ``CUT``): A's pattern ends a run there, and no entry of B holds such a place. So texts are cut, and each
task remembers the groups of pieces, and of words inside them, that it has met, up to ``PIECES`` and ``WORDS``; when a
memory is full, what was not met since the last time is forgotten. The two files are tested for this when they are loaded; with
other files texts are encoded whole.

Defined cases: texts that are null or empty, or whose joined token bytes differ from a space and the text, have no
tokens: zeros and an empty digest, and they count nowhere. Long texts are worked on in slices of ``SLICE`` characters, ended
at a cut. Repeated rows and doc_ids, and null doc_ids, are each a document. An empty table gives an empty one. Only
doc_id and text are read, so other columns may have any name.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom import runtime
from feedloom.llm.common import landed, table

# Pairs with at least this share of all links are looked up in a broadcast table: 1 / SHARES.
SHARES = 1 << 17
# Entries of a generation of remembered pieces and words; two generations are kept.
PIECES = 120_000
WORDS = 120_000
# Longest piece, in characters, that is remembered.
LONGEST = 64
# Characters of texts worked on at a time.
SLICE = 1 << 20

# A space behind a character that prints.
SPACE = re.compile(r" (?<=[!-~\w] )")
# Inside a piece: a mark behind a letter, and a line end between two characters that print.
CUT = re.compile(r"(?<=[A-Za-z])(?=[,.;:!?])|(?<=[!-~\w])(?=\n)|(?<=[!-~\w]\n)(?=[!-~\w])")
# What no entry of B may hold if texts are to be cut.
ACROSS = re.compile("[^▁]▁|[A-Za-z][,.;:!?]|\n")
# Characters that stand for bytes in a byte-level vocabulary: a byte that prints stands for itself, the others
# follow from 256 up.
PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTES = dict(zip(map(chr, PRINTED), PRINTED)) | {
    chr(256 + at): byte for at, byte in enumerate(sorted(set(range(256)) - set(PRINTED)))
}


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Vocabularies:
    """The two tokenizers, the bytes of their entries and the identity map."""

    def __init__(self, a_path: str, b_path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a_size, self.b_size = self.a.get_vocab_size(), self.b.get_piece_size()
        entries = self.a.get_vocab()
        self.a_bytes = [b""] * (max(entries.values()) + 1)
        for entry, at in entries.items():
            self.a_bytes[at] = self.of_a(entry)
        self.b_bytes = [self.of_b(at) for at in range(self.b_size)]
        # The first entry of B with the bytes, in the order of ids, leaving single-byte entries for last.
        order = sorted(range(self.b_size), key=lambda at: (self.b.is_byte(at), at))
        same: dict[bytes, int] = {}
        for at in order:
            if not self.b.is_control(at) and not self.b.is_unknown(at):
                same.setdefault(self.b_bytes[at], at)
        self.identity_list = [same.get(x, -1) if x else -1 for x in self.a_bytes]
        self.identity = np.array(self.identity_list, "i8")
        self.a_sizes, self.b_sizes = list(map(len, self.a_bytes)), list(map(len, self.b_bytes))
        self.cuts = self._cuts(json.loads(self.a.to_str()))

    @staticmethod
    def of_a(entry: str) -> bytes:
        # An added entry may hold characters that stand for no byte; those are themselves.
        return b"".join(bytes([BYTES[c]]) if c in BYTES else c.encode() for c in entry)

    def of_b(self, at: int) -> bytes:
        piece = self.b.id_to_piece(at)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(at) else piece.replace("▁", " ").encode()

    def _cuts(self, file: dict) -> bool:
        """True if neither tokenizer joins what stands on the two sides of a cut."""
        ahead = file["pre_tokenizer"] or {}
        plain = ahead.get("type") == "ByteLevel" and ahead["use_regex"] and not ahead["add_prefix_space"]
        special = all(token["special"] for token in file["added_tokens"])
        pieces = (self.b.id_to_piece(at) for at in range(self.b_size))
        lead = [self.b.id_to_piece(at) for at in self.b.encode("\n x ")]
        return (
            bool(plain) and special and file["normalizer"] is None and file["model"]["type"] == "BPE"
            and lead == ["▁", "<0x0A>", "▁x", "▁"]
            and not any(ACROSS.search(piece) for piece in pieces)
        )

    @property
    def key_type(self) -> str:
        """Smallest integers that hold a * b_size + b."""
        return "i4" if self.a_size * self.b_size < 1 << 31 else "i8"

    @property
    def key_code(self) -> str:
        """The same for the array module."""
        return {"i4": "i", "i8": "q"}[self.key_type]


@lru_cache(maxsize=2)
def vocabularies(a_path: str, b_path: str) -> Vocabularies:
    return Vocabularies(a_path, b_path)


# (groups as text, ids of A of regular groups, keys of irregular links), the last two as bytes. In the text a comma stands between
# ids of A and a stroke between ids of B, so that both can be counted; a digest has commas for both.
Record = tuple[bytes, bytes, bytes]
# Stands for a text whose tokens do not give its bytes.
ODD: Record = (b"", b"", b"")


def align(a: list[int], b: list[int], words: Vocabularies) -> Record:
    """Groups and links of two id sequences over the same bytes."""
    groups, regular, irregular = [], [], []
    sizes_a, sizes_b, size, identity = words.a_sizes, words.b_sizes, words.b_size, words.identity_list
    i, j, n = 0, 0, len(a)
    while i < n:
        x, y = a[i], b[j]
        end_a, end_b = sizes_a[x], sizes_b[y]
        i, j = i + 1, j + 1
        if end_a == end_b:
            groups.append(f"{x}|{y}")
            if identity[x] == y:
                regular.append(x)
            else:
                irregular.append(x * size + y)
            continue
        irregular.append(x * size + y)
        text_a, text_b = str(x), str(y)
        while end_a != end_b:
            # The side that ends first goes on, and meets the token that the other side is in.
            if end_a < end_b:
                x = a[i]
                end_a += sizes_a[x]
                i += 1
                text_a += f",{x}"
            else:
                y = b[j]
                end_b += sizes_b[y]
                j += 1
                text_b += f"/{y}"
            irregular.append(x * size + y)
        groups.append(text_a + "|" + text_b)
    return ";".join(groups).encode(), array("i", regular).tobytes(), array(words.key_code, irregular).tobytes()


class Aligner:
    """Records of texts; ODD where the tokens do not give the text's bytes."""

    def __init__(self, a_path: str, b_path: str):
        self.voc = vocabularies(a_path, b_path)
        self.pieces: dict[str, Record] = {}
        self.words: dict[str, Record] = {}
        self.old_pieces: dict[str, Record] = {}
        self.old_words: dict[str, Record] = {}

    def record(self, text: str, a: list[int], b: list[int]) -> Record:
        voc, wanted = self.voc, text.encode()
        parts_a, parts_b = [voc.a_bytes[x] for x in a], [voc.b_bytes[y] for y in b]
        # Entries without bytes would stand nowhere; no public file has them in a text.
        if b"".join(parts_a) != wanted or b"".join(parts_b) != wanted or b"" in parts_a or b"" in parts_b:
            return ODD
        return align(a, b, voc)

    def whole(self, text: str) -> Record:
        """Of a whole text, without cuts."""
        a = self.voc.a.encode(" " + text, add_special_tokens=False).ids
        return self.record(" " + text, a, self.voc.b.encode(text))

    def learn(self, pieces: set[str]) -> dict[str, Record]:
        """Records of pieces that were not met before, or not lately."""
        if len(self.pieces) > PIECES:
            self.old_pieces, self.pieces = self.pieces, {}
        if len(self.words) > WORDS:
            self.old_words, self.words = self.words, {}
        found, cut = {}, {}
        for piece in pieces:
            record = self.old_pieces.get(piece)
            if record is None:
                cut[piece] = CUT.split(" " + piece)
            else:
                found[piece] = record
        known, missing = {}, []
        for word in set(chain.from_iterable(cut.values())):
            record = self.words.get(word) or self.old_words.get(word)
            if record is None:
                missing.append(word)
            else:
                known[word] = record
        if missing:
            a = self.voc.a.encode_batch(missing, add_special_tokens=False)
            # A line end before the word takes the space that B puts in front of a text.
            b = self.voc.b.encode(["\n" + word for word in missing], num_threads=1)
            for word, ids_a, ids_b in zip(missing, a, b):
                known[word] = self.record(word, ids_a.ids, ids_b[2:])
        self.words.update((word, record) for word, record in known.items() if len(word) <= LONGEST)
        for piece, words in cut.items():
            found[piece] = known[words[0]] if len(words) == 1 else joined([known[word] for word in words])
        self.pieces.update((piece, record) for piece, record in found.items() if len(piece) <= LONGEST)
        return found

    def __call__(self, texts: list[str]) -> list[list[Record]]:
        """For each text the records of its pieces."""
        if not self.voc.cuts:
            return [[self.whole(text)] for text in texts]
        cut = [SPACE.split(text) for text in texts]
        # Pieces that are remembered now may be forgotten by ``learn``.
        now, missing = self.pieces, set(chain.from_iterable(cut)).difference(self.pieces)
        new = self.learn(missing) if missing else {}
        found = []
        for pieces in cut:
            records = list(map(now.get, pieces))
            if None in records:
                records = [new[piece] if record is None else record for piece, record in zip(pieces, records)]
            found.append(records)
        return found


def joined(records: list[Record]) -> Record:
    """One record of records that follow each other."""
    if ODD in records:
        return ODD
    return b";".join([r[0] for r in records]), b"".join([r[1] for r in records]), b"".join([r[2] for r in records])


@lru_cache(maxsize=1)
def aligner(a_path: str, b_path: str) -> Aligner:
    return Aligner(a_path, b_path)


def slices(text: str, size: int | None = None) -> Iterator[str]:
    """Parts of a text that end at a cut, the space there left out."""
    size, at = size or SLICE, 0
    while len(text) - at > size and (cut := SPACE.search(text, at + size)):
        yield text[at : cut.start()]
        at = cut.end()
    yield text[at:]


ALIGNED = (
    "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
    "regular binary, irregular binary"
)
NO_TOKENS = (0, 0, 0, 0, "", b"", b"")


def _of_text(parts: list[list[Record]], key_size: int) -> tuple:
    """Columns of one text, given the records of its slices."""
    groups, regular, irregular = joined([record for part in parts for record in part])
    if not groups:
        return NO_TOKENS
    n_groups = groups.count(b";") + 1
    n_a, n_b = groups.count(b",") + n_groups, groups.count(b"/") + n_groups
    digest = hashlib.sha256(groups.replace(b"/", b",")).hexdigest()
    return n_a, n_b, n_groups, len(regular) // 4 + len(irregular) // key_size, digest, regular, irregular


def _align(a_path: str, b_path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = aligner(a_path, b_path)
        key_size, whole = np.dtype(find.voc.key_type).itemsize, not find.voc.cuts
        schema = pa.schema([
            ("row", pa.int64()), ("doc_id", pa.int64()), *((n, pa.int64()) for n in ("n_a", "n_b", "n_groups", "n_links")),
            ("groups_sha256", pa.string()), ("regular", pa.binary()), ("irregular", pa.binary()),
        ])

        def results(keys: list[tuple], texts: list[str | None]) -> pa.RecordBatch:
            parts = [[] if not text else [text] if whole else list(slices(text)) for text in texts]
            records = iter(find([part for own in parts for part in own]))
            rows = []
            for key, own in zip(keys, parts):
                rows.append((*key, *(_of_text([next(records) for _ in own], key_size) if own else NO_TOKENS)))
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), schema)], schema=schema)

        for batch in batches:
            keys, texts, held = [], [], 0
            for row, doc_id, text in zip(batch.column("row").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("text")):
                keys.append((row, doc_id))
                texts.append(text.as_py() or None)
                held += len(texts[-1] or "")
                if held >= SLICE:
                    yield results(keys, texts)
                    keys, texts, held = [], [], 0
            if keys:
                yield results(keys, texts)

    return run


def _written(df: DataFrame, name: str) -> DataFrame:
    """Like ``landed``, with a stronger compression for columns of packed integers."""
    path = f"{runtime.checkpoint_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Alignment:
    """Documents aligned, and the counts of id pairs; both are written tables.

    ``documents``: one row per document, with its links packed as little-endian integers: ``regular`` holds ids of A,
    ``irregular`` keys a * b_size + b. ``pairs``: (key, a, b, n), n the links that hold the pair.
    """

    def __init__(self, docs: DataFrame, a_path: str, b_path: str):
        self.a_path, self.b_path, self.voc = a_path, b_path, vocabularies(a_path, b_path)
        rows = docs.select(
            F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")
        )
        self.documents = _written(rows.mapInArrow(_align(a_path, b_path), ALIGNED), "aligned")
        self.pairs = landed(self._pairs(), "id-pairs")

    def _pairs(self) -> DataFrame:
        identity, size, kind = self.voc.identity, self.voc.b_size, self.voc.key_type

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            vector = np.zeros(len(identity), "i8")
            for batch in small(batches):
                vector += np.bincount(flat(batch.column("regular"), "<i4"), minlength=len(vector))
                yield counted(*np.unique(flat(batch.column("irregular"), kind), return_counts=True))
            met = np.flatnonzero(vector)
            yield counted(met * size + identity[met], vector[met])

        def counted(keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(keys.astype("i8")), pa.array(n.astype("i8"))], names=["key", "n"])

        rows = self.documents.select("regular", "irregular").mapInArrow(count, "key long, n long")
        totals = rows.groupBy("key").agg(F.sum("n").alias("n"))
        a, b = F.floor(F.col("key") / F.lit(size)).cast("int"), F.pmod("key", F.lit(size)).cast("int")
        return totals.select("key", a.alias("a"), b.alias("b"), "n")

    def best(self) -> DataFrame:
        """(b, most): highest count of a pair of each id of B; at most one row per entry of the vocabulary."""
        return self.pairs.groupBy("b").agg(F.max("n").alias("most"))

    def scores(self, shares: int = SHARES) -> DataFrame:
        """One row per document, with n_best and count_sum over its links."""
        spark, size, kind = self.documents.sparkSession, self.voc.b_size, self.voc.key_type
        best, most = self.best().toArrow(), np.zeros(size, "i8")
        most[best["b"].to_numpy()] = best["most"].to_numpy()
        links = self.pairs.agg(F.sum("n")).first()[0] or 0
        # At most ``shares`` rows: each holds at least that share of all links.
        common = self.pairs.where(F.col("n") * F.lit(shares) >= F.lit(links)).select("key", "n").toArrow().sort_by("key")
        hot, hot_n = common["key"].to_numpy(), common["n"].to_numpy()
        # One number per id of A: the count of its pair in the identity map.
        vector, own = np.zeros(len(self.voc.identity), "i8"), self.voc.identity >= 0
        same = self.pairs.join(F.broadcast(self._identities(spark)), "key").select("a", "n").toArrow()
        vector[same["a"].to_numpy()] = same["n"].to_numpy()
        best_of = np.where(own, most[np.where(own, self.voc.identity, 0)], -1)
        shared = spark.sparkContext.broadcast((vector, vector == best_of, hot.astype(kind), hot_n, hot_n == most[hot % size]))

        def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n_of, is_best, hot, hot_n, hot_best = shared.value
            for batch in small(batches):
                regular, ends = flat(batch.column("regular"), "<i4"), bounds(batch.column("regular"), 4)
                irregular = flat(batch.column("irregular"), kind)
                found_ends = bounds(batch.column("irregular"), np.dtype(kind).itemsize)
                if len(hot):
                    at = np.searchsorted(hot, irregular)
                    at[at == len(hot)] = 0
                    known = hot[at] == irregular
                    n, best = np.where(known, hot_n[at], 0), known & hot_best[at]
                else:
                    known, n, best = (np.zeros(len(irregular), t) for t in (bool, "i8", bool))
                count_sum = summed(n_of[regular], ends) + summed(n, found_ends)
                n_best = summed(is_best[regular], ends) + summed(best, found_ends)
                left = summed(~known, found_ends)
                rest = pa.ListArray.from_arrays(
                    pa.array(np.concatenate([[0], np.cumsum(left)]).astype("i4")), pa.array(irregular[~known].astype("i8"))
                )
                kept = [batch.column(name) for name in KEPT]
                yield pa.RecordBatch.from_arrays(
                    [*kept, pa.array(n_best), pa.array(count_sum), rest], names=[*KEPT, "n_best", "count_sum", "rest"]
                )

        plain = ", ".join(f"{name} {'string' if name == 'groups_sha256' else 'long'}" for name in KEPT)
        looked = landed(
            self.documents.mapInArrow(look, f"{plain}, n_best long, count_sum long, rest array<bigint>"), "links"
        )
        is_best = (F.col("n") == F.col("most")).cast("long").alias("best")
        best = self.pairs.join(F.broadcast(self.best()), "b").select("key", "n", is_best)
        rest = looked.select("row", F.explode("rest").alias("key")).groupBy("row", "key").agg(F.count("*").alias("times"))
        sums = rest.join(best.where(F.col("n") * F.lit(shares) < F.lit(links)), "key").groupBy("row").agg(
            F.sum(F.col("times") * F.col("best")).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more")
        )
        joined_rows = looked.join(sums, "row", "left")
        return joined_rows.select(
            "doc_id", "n_a", "n_b", "n_groups", "n_links",
            (F.col("n_best") + F.coalesce("more_best", F.lit(0))).alias("n_best"),
            (F.col("count_sum") + F.coalesce("more", F.lit(0))).alias("count_sum"),
            "groups_sha256",
        )

    def _identities(self, spark: SparkSession) -> DataFrame:
        """Keys of the identity map, at most one per id of A."""
        met = np.flatnonzero(self.voc.identity >= 0)
        keys = met * self.voc.b_size + self.voc.identity[met]
        return spark.createDataFrame([(int(key),) for key in keys], "key long")


KEPT = ("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")


def small(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """Batches of a few rows each, as every row holds many numbers."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def flat(column: pa.Array, kind: str) -> np.ndarray:
    """All integers of a column of packed integers."""
    ends = np.frombuffer(column.buffers()[1], "i4")[column.offset : column.offset + len(column) + 1] if len(column) else [0, 0]
    data = column.buffers()[2]
    return np.frombuffer(data, "u1")[ends[0] : ends[-1]].view(kind) if data and ends[-1] > ends[0] else np.zeros(0, kind)


def bounds(column: pa.Array, size: int) -> np.ndarray:
    """Ends of the rows of a column of packed integers, from 0."""
    if not len(column):
        return np.zeros(1, "i8")
    ends = np.frombuffer(column.buffers()[1], "i4")[column.offset : column.offset + len(column) + 1].astype("i8")
    return (ends - ends[0]) // size


def summed(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sum of the values of each row."""
    running = np.concatenate([[0], np.cumsum(values, dtype="i8")])
    return running[ends[1:]] - running[ends[:-1]]


def op11_token_align(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return Alignment(docs, vocabulary_path("byte_bpe_50k.json"), vocabulary_path("piece_bpe_32k.model")).scores()
