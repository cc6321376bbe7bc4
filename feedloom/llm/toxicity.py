"""Toxicity: a lexicon trie read through Levenshtein automata, and the context of each hit.

Lexicon. Terms are learned from labelled texts: whole words, and stems that begin several words. In rounds, those
far more frequent in toxic than in clean texts are taken, the most frequent first, and the toxic texts they cover
are set aside; copies of one text thus lend no weight to the harmless words around a term.

Search. A state of the search is a set of (trie node, edits so far): the Levenshtein automaton of the word that is read,
run over all paths of the trie at once. An edit is a replaced, added, missing or swapped letter; terms of
5 letters or more allow one, of 9 or more two, stems of 7 or more one. States are made when first met and kept,
so that a word costs a few table look-ups. Words are what stands between white space, lower-cased, without the marks at
its ends.

Score. The evidence of a hit is the log-odds of its term at its number of edits, plus the log-odds of its context: whether
it stands inside quotation marks, and whether another hit stands within ``WINDOW`` words. A logistic
model over a text's strongest hit, the number and sum of its hits (a word counts once) and the sum for its length
gives the score.

Training uses rows with crc32(doc_id) mod 3 other than 1, distinct texts, in a hash sample of ``sample_toxic`` toxic and
``sample_clean`` clean ones in expectation; clean ones are weighted to their true share. The driver gets candidate
terms (at most ``CANDIDATES``) and the hits of the sample.

Scale. Scoring is one pass without a shuffle; the model is a few thousand numbers.

Defined cases: null and empty texts have no hits and the score of such texts; without labels of both kinds there are no
terms, and the score is the share of toxic labels (0 without labels); repeated rows are each scored; texts of any
length are read whole; labels that are null are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import crc_mod, landed, table

SAMPLE_TOXIC, SAMPLE_CLEAN = 3_000, 6_000
ROUNDS, CANDIDATES = 8, 400
LEAST_TEXTS, LEAST_ODDS = 5, 20.0
STEM_FROM, STEM_TO = 4, 10
WINDOW = 10
THRESHOLD = 0.7
REMEMBERED = 400_000
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~«»“”„‘’‹›…"
QUOTES = frozenset("\"“”„«»‹›")
# Doubt about a misspelled term, and about a quoted one, before anything is learned of it, as log-odds.
EDIT_DOUBT, QUOTE_DOUBT = 1.0, 1.0


@dataclass(frozen=True)
class Term:
    text: str
    stem: bool

    @property
    def edits(self) -> int:
        if self.stem:
            return int(len(self.text) >= 7)
        return int(len(self.text) >= 5) + int(len(self.text) >= 9)


class Matcher:
    """The trie of the terms and the states met so far."""

    def __init__(self, terms: list[Term]):
        self.terms = terms
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[list[int]] = [[]]
        self.most = [0]  # edits that any term below a node allows
        for number, term in enumerate(terms):
            node = 0
            self.most[0] = max(self.most[0], term.edits)
            for letter in term.text:
                if letter not in self.children[node]:
                    self.children[node][letter] = len(self.children)
                    self.children.append({})
                    self.ends.append([])
                    self.most.append(0)
                node = self.children[node][letter]
                self.most[node] = max(self.most[node], term.edits)
            self.ends[node].append(number)
        self.numbers: dict[frozenset, int] = {}
        self.states: list[frozenset] = []
        self.steps: list[dict[str, int]] = []
        self.whole: list[tuple[int, int] | None] = []  # best (edits, term) if the word ends here
        self.begun: list[tuple[int, int] | None] = []  # best (edits, stem) if the word goes on
        self.start = self._number({(0, "", 0)})

    def _number(self, found: set[tuple[int, str, int]]) -> int:
        """State of a set of (node, letter still due from a swap, edits), missing letters included."""
        least: dict[tuple[int, str], int] = {}
        ahead = list(found)
        while ahead:
            node, due, edits = ahead.pop()
            if edits > self.most[node] or least.get((node, due), 99) <= edits:
                continue
            least[node, due] = edits
            if not due:
                ahead += [(child, "", edits + 1) for child in self.children[node].values()]
        state = frozenset((node, due, edits) for (node, due), edits in least.items())
        if state not in self.numbers:
            self.numbers[state] = len(self.states)
            self.states.append(state)
            self.steps.append({})
            over = [
                (edits, number)
                for node, due, edits in state
                if not due
                for number in self.ends[node]
                if edits <= self.terms[number].edits
            ]
            self.whole.append(min((x for x in over if not self.terms[x[1]].stem), default=None))
            self.begun.append(min((x for x in over if self.terms[x[1]].stem), default=None))
        return self.numbers[state]

    def _step(self, at: int, letter: str) -> int:
        found = set()
        for node, due, edits in self.states[at]:
            if due:
                if due == letter:
                    found.add((node, "", edits))
                continue
            found.add((node, "", edits + 1))
            for other, child in self.children[node].items():
                found.add((child, "", edits + (other != letter)))
                if other != letter and letter in self.children[child]:
                    found.add((self.children[child][letter], other, edits + 1))
        self.steps[at][letter] = self._number(found)
        return self.steps[at][letter]

    def match(self, word: str) -> tuple[int, int] | None:
        """Best (edits, term) of a word: a whole term, or a stem that the word begins with and goes beyond."""
        at, best = self.start, None
        for letter in word:
            if self.begun[at] is not None and (best is None or self.begun[at] < best):
                best = self.begun[at]
            after = self.steps[at].get(letter)
            at = self._step(at, letter) if after is None else after
            if not self.states[at]:
                return best
        whole = self.whole[at]
        return whole if whole is not None and (best is None or whole <= best) else best


def distance_match(terms: list[Term], word: str) -> tuple[int, int] | None:
    """What ``Matcher.match`` gives, from plain distances to every term; for tests."""

    def distance(a: str, b: str) -> int:
        rows = [list(range(len(b) + 1))]
        for i, x in enumerate(a, 1):
            row = [i]
            for j, y in enumerate(b, 1):
                value = min(rows[-1][j] + 1, row[-1] + 1, rows[-1][j - 1] + (x != y))
                if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y and x != y:
                    value = min(value, rows[-2][j - 2] + 1)
                row.append(value)
            rows.append(row)
        return rows[-1][-1]

    found = []
    for number, term in enumerate(terms):
        ways = [word[:i] for i in range(len(word))] if term.stem else [word]
        edits = min((distance(term.text, way) for way in ways), default=99)
        if edits <= term.edits:
            found.append((edits, term.stem, number))
    whole = min(((e, n) for e, stem, n in found if not stem), default=None)
    begun = min(((e, n) for e, stem, n in found if stem), default=None)
    return whole if whole is not None and (begun is None or whole <= begun) else begun


def _plain(token: str) -> str:
    return token.strip(MARKS)


class Reader:
    """Hits of texts; remembers the words of lately read ones."""

    def __init__(self, terms: list[Term]):
        self.matcher, self.known = Matcher(terms), {}

    def hits(self, text: str | None) -> tuple[list[tuple[int, int, int, int]], int]:
        """(term, edits, quoted, near another hit) of every distinct word that hits, and the number of words.

        Of the places of a word, one outside quotation marks and near another hit counts first.
        """
        tokens = (text or "").lower().split()
        if len(self.known) > REMEMBERED:
            self.known = {}
        known = self.known
        for token in tokens:
            if token not in known:
                known[token] = self.matcher.match(_plain(token))
        found = [(at, known[token]) for at, token in enumerate(tokens) if known[token] is not None]
        best: dict[str, tuple[int, int, int, int]] = {}
        for i, (at, (edits, term)) in enumerate(found):
            near = i > 0 and at - found[i - 1][0] <= WINDOW or i + 1 < len(found) and found[i + 1][0] - at <= WINDOW
            hit, word = (term, edits, int(self.quoted(tokens, at)), int(near)), _plain(tokens[at])
            if word not in best or (-hit[2], hit[3]) > (-best[word][2], best[word][3]):
                best[word] = hit
        return list(best.values()), len(tokens)

    def quoted(self, tokens: list[str], at: int) -> bool:
        """An opening quotation mark is the last one before the word, a closing one follows, both in the window."""
        lead = tokens[at][: tokens[at].find(_plain(tokens[at]) or tokens[at])]
        before = " ".join([*tokens[max(0, at - WINDOW) : at], lead])
        after = " ".join([tokens[at][len(lead) :], *tokens[at + 1 : at + 1 + WINDOW]])
        return sum(c in QUOTES for c in before) % 2 == 1 and any(c in QUOTES for c in after)


@dataclass
class Model:
    terms: list[Term] = field(default_factory=list)
    evidence: dict[tuple[int, int], float] = field(default_factory=dict)  # (term, edits)
    quoted: float = 0.0
    near: float = 0.0
    weights: np.ndarray = field(default_factory=lambda: np.array([-30.0, 0.0, 0.0, 0.0, 0.0]))

    def features(self, hits: list[tuple[int, int, int, int]], n_words: int) -> tuple[float, ...]:
        """Strongest hit, number of hits, their sum, and the sum for the length; the latter three on log scales."""
        values = [
            self.evidence.get((term, edits), 0.0) + quoted * self.quoted + near * self.near
            for term, edits, quoted, near in hits
        ]
        kept = [value for value in values if value > 0]
        total = sum(kept)
        return max(kept, default=0.0), math.log1p(len(kept)), math.log1p(total), math.log1p(100 * total / (n_words + 20))

    def score(self, hits: list[tuple[int, int, int, int]], n_words: int) -> float:
        value = float(self.weights[0] + self.weights[1:] @ np.array(self.features(hits, n_words)))
        return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, value))))


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text_id, toxic, word) of the distinct words of training texts."""
    for batch in batches:
        ids, kinds, words = [], [], []
        for text_id, toxic, text in zip(*[batch.column(c).to_pylist() for c in ("text_id", "toxic", "text")]):
            found = {_plain(token) for token in (text or "").lower().split()} - {""}
            found = [word for word in found if len(word) <= 64]  # what is longer is no word of a lexicon
            ids += [text_id] * len(found)
            kinds += [toxic] * len(found)
            words += found
        columns = [pa.array(ids, pa.int64()), pa.array(kinds, pa.int32()), pa.array(words, pa.string())]
        yield pa.RecordBatch.from_arrays(columns, names=["text_id", "toxic", "word"])


def _lexicon(words: DataFrame, n_toxic: int, n_clean: int) -> list[Term]:
    """Terms by rounds over (text_id, toxic, word)."""
    whole = words.select("text_id", "toxic", F.col("word").alias("key"), F.lit(False).alias("stem"), "word")
    stems = words.select(
        "text_id",
        "toxic",
        F.explode(
            F.transform(
                F.sequence(F.lit(STEM_FROM), F.greatest(F.lit(STEM_FROM), F.least(F.lit(STEM_TO), F.length("word") - 1))),
                lambda n: F.col("word").substr(F.lit(1), n),
            )
        ).alias("key"),
        F.lit(True).alias("stem"),
        "word",
    ).where("length(word) > length(key)")
    # A text uses a stem if two of its words have it: by chance, one may.
    keys = whole.unionByName(stems).groupBy("text_id", "toxic", "key", "stem").agg(F.count("*").alias("words"))
    keys = landed(keys.where("NOT stem OR words > 1").drop("words"), "term-candidates")
    terms: list[Term] = []
    left = keys
    for _ in range(ROUNDS):
        counts = left.groupBy("key", "stem").agg(F.sum("toxic").alias("pos"), F.sum(1 - F.col("toxic")).alias("neg"))
        odds = (F.col("pos") + 0.5) / (n_toxic + 1) / ((F.col("neg") + 0.5) / (n_clean + 1))
        good = counts.where((F.col("pos") >= LEAST_TEXTS) & (odds >= LEAST_ODDS))
        order = [F.desc("pos"), F.asc("stem"), F.desc(F.length("key")), F.asc("key")]
        rows = good.orderBy(*order).limit(CANDIDATES).collect()
        if not rows:
            break
        taken: list[Term] = []
        for row in rows:
            if row["pos"] < 0.3 * rows[0]["pos"]:
                break
            related = any(row["key"].startswith(t.text) or t.text.startswith(row["key"]) for t in taken)
            if not related:
                taken.append(Term(row["key"], row["stem"]))
        terms += taken
        names = words.sparkSession.createDataFrame([(t.text, t.stem) for t in taken], "key string, stem boolean")
        hit = keys.where("toxic = 1").join(F.broadcast(names), ["key", "stem"]).select("text_id").distinct()
        # What is covered stays covered; the rest is written, as each round reads it anew.
        left = landed(left.join(hit, "text_id", "left_anti"), "term-candidates")
    return terms


def _log_ratio(pos: float, neg: float, n_pos: float, n_neg: float, prior: float, strength: float = 2.0) -> float:
    """Log-odds of an event, drawn towards ``prior`` by ``strength`` texts."""
    share = strength / (n_pos + n_neg + strength)
    toxic = (pos + strength * share * math.exp(min(prior, 6.0))) / (n_pos + strength)
    clean = (neg + strength * share) / (n_neg + strength)
    return math.log(toxic / clean)


def _logistic(rows: np.ndarray, labels: np.ndarray, weights: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weighted logistic regression by Newton's method."""
    data = np.hstack([np.ones((len(rows), 1)), rows])
    beta = np.zeros(data.shape[1])
    penalty = ridge * np.eye(len(beta))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(data @ beta, -30, 30)))
        slope = data.T @ (weights * (labels - p)) - penalty @ beta
        curve = (data * (weights * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ data + penalty
        step = np.linalg.solve(curve, slope)
        beta += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-8:
            break
    return beta


def _read(terms):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(terms.value)
        for batch in batches:
            found = [reader.hits(text) for text in batch.column("text").to_pylist()]
            hits = pa.array([[list(hit) for hit in hits] for hits, _ in found], pa.list_(pa.list_(pa.int32())))
            sizes = pa.array([n_words for _, n_words in found], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), hits, sizes], names=["toxic", "hits", "n_words"])

    return run


def train(docs: DataFrame, labels: DataFrame, sample_toxic: int = SAMPLE_TOXIC, sample_clean: int = SAMPLE_CLEAN) -> Model:
    """Learn from labelled documents whose crc32(doc_id) mod 3 is not 1."""
    spark = docs.sparkSession
    marks = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").where(crc_mod(F.col("doc_id"), 3) != 1)
    marks = marks.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    counts = {row["toxic"]: row["count"] for row in marks.groupBy("toxic").count().collect()}
    n_toxic, n_clean = counts.get(1, 0), counts.get(0, 0)
    if not n_toxic or not n_clean:
        share = n_toxic / (n_toxic + n_clean) if n_toxic + n_clean else 0.0
        return Model(weights=np.array([30.0 if share else -30.0, 0.0, 0.0, 0.0, 0.0]))
    steps = 1_000_000
    chances = F.when(F.col("toxic") == 1, math.ceil(steps * min(1, sample_toxic / n_toxic)))
    chances = chances.otherwise(math.ceil(steps * min(1, sample_clean / n_clean)))
    marks = landed(marks.where(F.pmod(F.xxhash64("doc_id"), F.lit(steps)) < chances), "training-labels")
    sample = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(marks), "doc_id")
    texts = sample.groupBy(F.xxhash64("text").alias("text_id")).agg(F.max("toxic").alias("toxic"), F.first("text").alias("text"))
    texts = landed(texts, "training-texts")
    words = landed(texts.mapInArrow(_tokens, "text_id long, toxic int, word string"), "training-words")
    n = {row["toxic"]: row["count"] for row in texts.groupBy("toxic").count().collect()}
    pos, neg = n.get(1, 0), n.get(0, 0)
    terms = _lexicon(words, pos, neg)
    sent = spark.sparkContext.broadcast(terms)
    read = texts.mapInArrow(_read(sent), "toxic int, hits array<array<int>>, n_words long")
    # The bounded sample.
    rows = [(row["toxic"], [tuple(hit) for hit in row["hits"]], row["n_words"]) for row in read.collect()]
    model = Model(terms)
    seen: dict[tuple, list[int]] = {}
    context: dict[tuple[str, int], list[int]] = {}
    for toxic, hits, _ in rows:
        for key in {(term, edits) for term, edits, _, _ in hits}:
            seen.setdefault(key, [0, 0])[toxic] += 1
        for _, edits, quoted, near in hits:
            if not edits:
                context.setdefault(("quoted", quoted), [0, 0])[toxic] += 1
                context.setdefault(("near", near), [0, 0])[toxic] += 1
    for number, term in enumerate(terms):
        exact = 0.0
        for edits in range(term.edits + 1):
            clean, toxic = seen.get((number, edits), [0, 0])
            prior = exact - EDIT_DOUBT * edits if edits else 3.0
            value = _log_ratio(toxic, clean, pos, neg, prior)
            model.evidence[number, edits] = value
            exact = value if not edits else exact

    def contrast(name: str, prior: float) -> float:
        no, yes = context.get((name, 0), [0, 0]), context.get((name, 1), [0, 0])
        with_ = math.log((yes[1] + 1) / (yes[0] + 1)) - math.log((no[1] + 1) / (no[0] + 1))
        trust = sum(yes) / (sum(yes) + 20)
        return trust * with_ + (1 - trust) * prior

    model.quoted, model.near = min(0.0, contrast("quoted", -QUOTE_DOUBT)), max(0.0, contrast("near", 0.5))
    features = np.array([model.features(hits, n_words) for _, hits, n_words in rows])
    truth = np.array([toxic for toxic, _, _ in rows], dtype=float)
    model.weights = _logistic(features, truth, np.where(truth > 0, n_toxic / max(1, pos), n_clean / max(1, neg)))
    return model


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every document."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = sent.value
        reader = Reader(held.terms)
        for batch in batches:
            found = [held.score(*reader.hits(text)) for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.float64())], names=["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double")


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = scores(docs, train(docs, table(spark, sf_dir, "labels")))
    held_out = F.coalesce(crc_mod(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out")
    return found.select("doc_id", held_out, "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
