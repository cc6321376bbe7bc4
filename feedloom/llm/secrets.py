"""Secret scan: keyword automaton first, anchored patterns near its hits, then embedded checksums.

One Aho-Corasick pass over a text finds where a keyword of a kind stands. Only there is the kind's pattern
tried, anchored at the hit, so that no pattern ever searches a text. A kind with an embedded checksum is
accepted only if that fits.

Kinds, in the order of ties: ``assign`` (a name like password, set to a value of 8 or more characters),
``access`` (AKIA keys), ``hex`` (runs of 32 or more lower-case hex digits, found through all pairs of
four hex digits), and, with a checksum, ``github`` and ``npm`` tokens: 30 characters and the CRC32 of these
in six base-62 digits. Within a kind, matches are leftmost and do not overlap; a match that fails its length or
checksum still takes its place.

Defined cases: null is read as an empty text, which has no spans; spans are code points, end exclusive; repeated
rows are each scanned; texts of any length are read whole. Names match in either case by ASCII alone.
"""

from __future__ import annotations

import hashlib
import itertools
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import table

# Kinds, their patterns, the group that is measured and its least length.
BASE = {
    "assign": (
        re.compile(
            r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
            re.IGNORECASE | re.ASCII,
        ),
        2,
        8,
    ),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 16),
    "hex": (re.compile(r"[0-9a-f]+"), 0, 32),
}
NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
CHECKED = {
    "github": re.compile(r"gh[pousr]_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])"),
    "npm": re.compile(r"npm_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])"),
}
PREFIXES = {"github": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), "npm": ("npm_",)}
KINDS = (*BASE, *CHECKED)
DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
HEX = "0123456789abcdef"


def base62(number: int, width: int = 6) -> str:
    out = ""
    while number:
        number, digit = divmod(number, 62)
        out = DIGITS[digit] + out
    return out.rjust(width, "0")


def checksum_fits(body: str, check: str) -> bool:
    return base62(zlib.crc32(body.encode("ascii"))) == check


@lru_cache(maxsize=1)
def automaton():
    """All keywords with their kind and length; names in every mix of cases, as texts are not lower-cased."""
    import ahocorasick

    found = ahocorasick.Automaton()
    for name in NAMES:
        for word in map("".join, itertools.product(*[{c, c.upper()} for c in name])):
            found.add_word(word, ("assign", len(word)))
    found.add_word("AKIA", ("access", 4))
    for four in map("".join, itertools.product(HEX, repeat=4)):
        found.add_word(four, ("hex", 4))
    for kind, prefixes in PREFIXES.items():
        for prefix in prefixes:
            found.add_word(prefix, (kind, len(prefix)))
    found.make_automaton()
    return found


def spans(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, kind) of every accepted match, by start and then kind."""
    if not text:
        return []
    done, out = dict.fromkeys(KINDS, 0), []
    for last, (kind, size) in automaton().iter(text):
        start = last + 1 - size
        if start < done[kind]:
            continue
        if kind in BASE:
            pattern, group, least = BASE[kind]
            match = pattern.match(text, start)
            if match is None:
                continue
            done[kind] = match.end()
            if kind == "hex":
                # Of a maximal run, the first four digits are the first hit.
                accepted = match.end() - start >= least
            else:
                accepted = match.end(group) - match.start(group) >= least
        else:
            match = CHECKED[kind].match(text, start)
            if match is None:
                continue
            done[kind] = match.end()
            accepted = checksum_fits(*match.groups())
        if accepted:
            out.append((start, match.end(), kind))
    return sorted(out, key=lambda span: (span[0], KINDS.index(span[2])))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [spans(text.as_py()) for text in batch.column("text")]
        kinds = pa.array([[kind for _, _, kind in row] for row in found], pa.list_(pa.string()))
        starts = pa.array([[start for start, _, _ in row] for row in found], pa.list_(pa.int64()))
        ends = pa.array([[end for _, end, _ in row] for row in found], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), kinds, starts, ends], names=["doc_id", "kinds", "starts", "ends"]
        )


def find_secrets(docs: DataFrame) -> DataFrame:
    """(doc_id, spans array<struct<kind, start, end>>) of every document, sorted by start and kind."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = rows.mapInArrow(_scan, "doc_id long, kinds array<string>, starts array<long>, ends array<long>")
    zipped = F.arrays_zip(F.col("kinds").alias("kind"), F.col("starts").alias("start"), F.col("ends").alias("end"))
    return found.select("doc_id", zipped.alias("spans"))


def masked(text: str | None, mask: str = "[secret]") -> str | None:
    """A text with its spans, merged where they overlap, replaced by a mask."""
    if text is None:
        return None
    out, at = [], 0
    for start, end, _ in spans(text):
        if start >= at:
            out += [text[at:start], mask]
        at = max(at, end)
    return "".join([*out, text[at:]])


def mask_secrets(docs: DataFrame, mask: str = "[secret]") -> DataFrame:
    """The documents, all columns kept, with every span replaced."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            texts = pa.array([masked(x.as_py(), mask) for x in batch.column(at)], pa.string())
            columns = [texts if i == at else column for i, column in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return docs.mapInArrow(run, docs.schema)


def op2_secrets(spark, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"))

    def joined(spans_: str):
        return F.array_join(F.transform(spans_, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    kept = found.withColumn("base", F.filter("spans", lambda s: s["kind"].isin(*BASE)))
    counts = [count(kind) for kind in BASE]
    return kept.select(
        "doc_id", *counts, F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans")
    )


def digest(found: list[tuple[int, int, str]]) -> str:
    """The hash of the base spans, for tests."""
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, e, k in found if k in BASE).encode()).hexdigest()
