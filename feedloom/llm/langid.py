"""Language identification by unigrams over pieces, summed over all segmentations.

A language is a probability for each piece of a fixed public vocabulary (the letter pieces of a tokenizer, lower-cased).
The probability of a word in a language is the sum, over all ways to cut it into pieces, of the product of
the pieces' probabilities; the forward algorithm computes it from left to right. A letter that is no piece has a small
fixed probability, so every word can be cut. Words are maximal runs of letters; their log-probabilities add
up to the text's, and with the share of each language among the training texts they give a posterior.

Training. Piece probabilities come from expectation maximisation: each round computes, for every distinct word of a
language, the expected count of its pieces over all segmentations (forward and backward sums), on Spark; the driver gets
one number per language and piece. The training texts are a hash sample of the labelled ones, of
``sample_docs`` per language in expectation and all of a language that has fewer; shares count all rows. Rows are used for training if ``crc32(doc_id) mod 5`` is not 0.

Scale. The model is (languages x vocabulary) numbers, broadcast. Texts are scored in one pass without a shuffle; a
task remembers the words it has met, up to ``REMEMBERED``.

Defined cases: null texts and texts without a letter are ``und`` with score 0, as is every text if nothing was learned;
languages of equal posterior go by name; repeated rows are each scored; texts and words of any length are
read whole; a null doc_id is not used for training, and not held out.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import crc_mod, landed, released, small_batches, table

SAMPLE_DOCS = 1_000
ROUNDS = 3
SMOOTHING = 0.01
UNKNOWN = 1e-7
REMEMBERED = 300_000
UNDETERMINED = "und"
LETTERS = re.compile(r"[^\W\d_]+")
# Words of up to this length are taken together, so many at a time; no sum of theirs can vanish.
TOGETHER = 30
CHUNK = 20_000
# Texts whose new words are taken together.
DOCS = 256
# Sums are brought back to about 1 after so many letters.
RESCALE = 8


def vocabulary_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def letter_pieces(path: str) -> list[str]:
    """Distinct lower-cased letter pieces of a sentencepiece vocabulary, sorted."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = {model.id_to_piece(i).strip("▁").lower() for i in range(model.get_piece_size())}
    return sorted(piece for piece in found if piece.isalpha())


def words_of(text: str | None) -> list[str]:
    """Maximal runs of letters, lower-cased."""
    lowered = (text or "").lower()
    found = LETTERS.findall(lowered)
    if lowered.isascii() or all(map(str.isalpha, found)):
        return found
    # Numbers that are no decimal digits count as word characters above.
    return [w for word in found for w in "".join(c if c.isalpha() else " " for c in word).split()]


@dataclass
class Model:
    languages: list[str]
    pieces: dict[str, int]
    longest: int
    probabilities: np.ndarray  # (pieces + 1, languages); the last row is that of an unknown letter
    prior: np.ndarray  # log share of each language

    def cuts(self, word: str) -> list[list[tuple[int, int]]]:
        """For every end, the (start, piece) that may end there; an unknown letter is its own piece."""
        known, out = self.pieces, []
        for end in range(1, len(word) + 1):
            ways = []
            for start in range(max(0, end - self.longest), end):
                piece = known.get(word[start:end])
                if piece is not None:
                    ways.append((start, piece))
            if word[end - 1] not in known:
                ways.append((end - 1, len(known)))
            out.append(ways)
        return out

    def log_probability(self, word: str) -> np.ndarray:
        """Log of the summed probability of all segmentations, per language."""
        table_, sums = self.probabilities, {0: np.ones(len(self.languages))}
        scale = np.zeros(len(self.languages))
        for end, ways in enumerate(self.cuts(word), 1):
            total = 0.0
            for start, piece in ways:
                total = total + sums[start] * table_[piece]
            sums[end] = total
            if end % RESCALE == 0:
                top = np.max([sums[i] for i in range(max(0, end - self.longest + 1), end + 1) if i in sums], axis=0)
                sums = {i: sums[i] / top for i in range(max(0, end - self.longest), end + 1)}
                scale += np.log(top)
        return np.log(sums[len(word)]) + scale


def expected_pieces(model: Model, language: int, word: str) -> dict[int, float]:
    """Expected count of each piece in a word over all its segmentations, in one language."""
    column, cuts, size = model.probabilities[:, language], model.cuts(word), len(word)
    ahead, scales = [1.0] + [0.0] * size, [1.0] * (size + 1)
    # ahead[i] holds the sum up to i over the product of the scales up to i.
    for end, ways in enumerate(cuts, 1):
        total = 0.0
        for start, piece in ways:
            factor = 1.0
            for i in range(start + 1, end):
                factor /= scales[i]
            total += ahead[start] * column[piece] * factor
        scales[end], ahead[end] = total, 1.0
    back, found = [0.0] * size + [1.0], {}
    for end in range(size, 0, -1):
        for start, piece in cuts[end - 1]:
            factor = 1.0
            for i in range(start + 1, end + 1):
                factor /= scales[i]
            share = column[piece] * factor * back[end]
            back[start] += share
            found[piece] = found.get(piece, 0.0) + share
    return found


def _by_length(words: list[str]) -> dict[int, list[int]]:
    found: dict[int, list[int]] = {}
    for at, word in enumerate(words):
        found.setdefault(len(word), []).append(at)
    return found


class Lattice:
    """All cuts of many words of one length, at once: the piece of every span, word by word."""

    def __init__(self, model: Model, words: list[str], size: int):
        get, self.size = model.pieces.get, size
        unknown, absent = len(model.pieces), len(model.pieces) + 1
        self.spans = [(s, e) for e in range(1, size + 1) for s in range(max(0, e - model.longest), e)]
        other = {span: unknown if span[1] - span[0] == 1 else absent for span in self.spans}
        found = np.array(
            [[get(word[s:e], -1) for s, e in self.spans] for word in words], dtype=np.int32
        ).reshape(len(words), len(self.spans))
        self.pieces = {span: np.where(found[:, i] < 0, other[span], found[:, i]) for i, span in enumerate(self.spans)}

    def forward(self, table_: np.ndarray) -> list[np.ndarray]:
        """Sums up to every end; ``table_`` has a row per piece, one of an unknown letter, one of zeros."""
        sums = [np.ones((len(next(iter(self.pieces.values()))), table_.shape[1]))]
        for end in range(1, self.size + 1):
            starts = [s for s, e in self.spans if e == end]
            sums.append(sum(sums[s] * table_[self.pieces[s, end]] for s in starts))
        return sums

    def expected(self, column: np.ndarray, times: np.ndarray) -> np.ndarray:
        """Expected counts of all pieces in one language, each word counted ``times``."""
        ahead = [x[:, 0] for x in self.forward(column[:, None])]
        back = [None] * self.size + [np.ones(len(times))]
        for start in range(self.size - 1, -1, -1):
            ends = [e for s, e in self.spans if s == start]
            back[start] = sum(back[e] * column[self.pieces[start, e]] for e in ends)
        found = np.zeros(len(column))
        for (start, end), pieces in self.pieces.items():
            share = ahead[start] * column[pieces] * back[end] / back[0] * times
            found += np.bincount(pieces, weights=share, minlength=len(column))
        return found


def _with_zero(table_: np.ndarray) -> np.ndarray:
    return np.vstack([table_, np.zeros((1, table_.shape[1]))])


def log_probabilities(model: Model, words: list[str]) -> np.ndarray:
    """Row by row what ``Model.log_probability`` gives; short words are taken together by length."""
    out, table_ = np.empty((len(words), len(model.languages))), _with_zero(model.probabilities)
    for size, places in _by_length(words).items():
        if size > TOGETHER:
            for at in places:
                out[at] = model.log_probability(words[at])
        else:
            for first in range(0, len(places), CHUNK):
                some = places[first : first + CHUNK]
                out[some] = np.log(Lattice(model, [words[at] for at in some], size).forward(table_)[-1])
    return out


def _expect(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = model.value
        table_, sums = _with_zero(held.probabilities), np.zeros((len(held.pieces) + 2, len(held.languages)))
        for batch in batches:
            langs, words, times = (batch.column(c).to_pylist() for c in ("lang", "word", "n"))
            for at, lang in enumerate(held.languages):
                own = [i for i, x in enumerate(langs) if x == lang]
                for size, places in _by_length([words[i] for i in own]).items():
                    places = [own[i] for i in places]
                    if size > TOGETHER:
                        for i in places:
                            for piece, count in expected_pieces(held, at, words[i]).items():
                                sums[piece, at] += times[i] * count
                        continue
                    for first in range(0, len(places), CHUNK):
                        some = places[first : first + CHUNK]
                        lattice = Lattice(held, [words[i] for i in some], size)
                        sums[:, at] += lattice.expected(table_[:, at], np.array([times[i] for i in some], float))
        # One row per language and piece of the vocabulary at most.
        pieces, ats = np.nonzero(sums[: len(held.pieces)])
        yield pa.RecordBatch.from_arrays(
            [pa.array(ats.astype(np.int32)), pa.array(pieces.astype(np.int32)), pa.array(sums[pieces, ats])],
            names=["lang", "piece", "n"],
        )

    return run


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts: Counter = Counter()
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
            counts.update((lang, word) for word in words_of(text))
        kinds = (pa.string(), pa.string())
        columns = [pa.array([key[i] for key in counts], kind) for i, kind in enumerate(kinds)]
        columns.append(pa.array(list(counts.values()), pa.int64()))
        yield pa.RecordBatch.from_arrays(columns, names=["lang", "word", "n"])


def train(docs: DataFrame, path: str | None = None, sample_docs: int = SAMPLE_DOCS, rounds: int = ROUNDS) -> Model:
    """Learn from the labelled documents whose crc32(doc_id) mod 5 is not 0."""
    spark = docs.sparkSession
    pieces = letter_pieces(path or vocabulary_path())
    longest = max(map(len, pieces), default=1)
    labelled = docs.where((crc_mod(docs["doc_id"], 5) != 0) & docs["lang"].isNotNull())
    shares = labelled.groupBy("lang").count().orderBy("lang").collect()  # one row per language
    languages, total = [row["lang"] for row in shares], sum(row["count"] for row in shares)
    prior = np.log([row["count"] / total for row in shares]) if shares else np.zeros(0)
    numbers = {piece: i for i, piece in enumerate(pieces)}
    flat = np.full((len(pieces) + 1, len(languages)), 1.0 / max(1, len(pieces)))
    flat[-1] = UNKNOWN
    model = Model(languages, numbers, longest, flat, prior)
    if not languages:
        return model
    steps = 1 << 40
    least = [math.ceil(steps * min(1.0, sample_docs / row["count"])) for row in shares]
    least = F.create_map(*[F.lit(x) for pair in zip(languages, least) for x in pair])
    chance = F.pmod(F.xxhash64("doc_id"), F.lit(steps)) < least[labelled["lang"]]
    sample = labelled.where(chance).select(F.col("lang").cast("string"), F.col("text").cast("string"))
    words = sample.mapInArrow(_words, "lang string, word string, n long")
    words = landed(words.groupBy("lang", "word").agg(F.sum("n").alias("n")), "training-words")
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(model)
        sums = words.mapInArrow(_expect(sent), "lang int, piece int, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n"))
        counts = np.full((len(pieces), len(languages)), SMOOTHING)
        for row in sums.collect():  # at most languages x pieces rows
            counts[row["piece"], row["lang"]] += row["n"]
        table_ = np.vstack([counts / counts.sum(axis=0), np.full(len(languages), UNKNOWN)])
        model = Model(languages, numbers, longest, table_, prior)
    return model


class Scorer:
    """Predictions for texts; remembers the words of lately read texts."""

    def __init__(self, model: Model):
        self.model, self.places = model, {}
        self.rows = np.empty((REMEMBERED, len(model.languages)))

    def __call__(self, texts: list[str | None]) -> list[tuple[str, float]]:
        out = []
        for first in range(0, len(texts), DOCS):
            out += self.some(texts[first : first + DOCS])
        return out

    def some(self, texts: list[str | None]) -> list[tuple[str, float]]:
        counts, languages = [Counter(words_of(text)) for text in texts], self.model.languages
        new = list({word: None for found in counts for word in found if word not in self.places})
        if len(self.places) + len(new) > len(self.rows):
            self.places, new = {}, list({word: None for found in counts for word in found})
            if len(new) > len(self.rows):
                self.rows = np.empty((len(new), len(languages)))
        at = len(self.places)
        if languages:
            self.rows[at : at + len(new)] = log_probabilities(self.model, new)
        self.places.update(zip(new, range(at, at + len(new))))
        out = []
        for found in counts:
            if not found or not languages:
                out.append((UNDETERMINED, 0.0))
                continue
            rows = self.rows[[self.places[word] for word in found]]
            total = self.model.prior + np.fromiter(found.values(), np.float64, len(found)) @ rows
            best = int(np.argmax(total))
            out.append((languages[best], float(1.0 / np.exp(np.maximum(total - total[best], -700.0)).sum())))
        return out


def predictions(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score) of every document."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = Scorer(sent.value)
        for batch in batches:
            found = score(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([lang for lang, _ in found], pa.string()),
                    pa.array([value for _, value in found], pa.float64()),
                ],
                names=["doc_id", "lang_pred", "score"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double")


def keep_determined(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The documents with a language of at least that posterior, all columns kept; one pass, no join.

    They are written here, since the size of the batches that go to Python holds for what is planned now.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = Scorer(sent.value)
        for batch in batches:
            found = score(batch.column("text").to_pylist())
            yield batch.filter(pa.array([lang != UNDETERMINED and value >= least for lang, value in found], pa.bool_()))

    with small_batches(docs.sparkSession):
        return landed(docs.mapInArrow(released(run), docs.schema), "determined")


def op3_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = predictions(docs, train(docs))
    held_out = F.coalesce(crc_mod(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out")
    return found.select("doc_id", held_out, "lang_pred", "score")
